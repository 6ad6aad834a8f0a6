"""Progress as streaming state: running mean, remaining time and trend of every key, kept between batches.

The state of a key is how many items it has done, the sum of their seconds and the last few of them, so its size does
not follow the stream.  It lies in the state store beside the checkpoint: a restarted query goes on
where its last finished batch ended.  A key without items for `idle_s` seconds is reported as stalled and forgotten;
timers need a query that goes on, as one that runs to its end has none to wait for.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

#: Items whose mean is held against that of all.
LAST = 5
OUTPUT = "done long, mean_all double, mean_last5 double, eta_s double, trend string"


def _half_up(value: float, places: int) -> float:
    """Rounded half up by its shortest decimal form, as Spark rounds."""
    return float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def _units(value: float | None) -> int:
    """Whole ten-thousandths; a missing time counts as none."""
    return 0 if pd.isna(value) else int(Decimal(repr(float(value))).scaleb(4).quantize(Decimal(1), ROUND_HALF_UP))


def trend(last: float, mean: float) -> str:
    return "slower" if last > mean * 1.1 else "faster" if last < mean * 0.9 else "stable"


class Progress(StatefulProcessor):
    """Counts and sums per key; seconds are held in whole ten-thousandths, so that sums do not depend on batches."""

    def __init__(self, order: str, seconds: str, key: str, total: int, idle_s: int | None = None):
        self.order, self.seconds, self.key, self.total, self.idle_s = order, seconds, key, total, idle_s

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", "done long, total string, last array<long>")

    def _row(self, key: tuple, place: int | None, done: int, total: int, last: list[int], mark: str | None = None) -> tuple:
        mean, short = _half_up(total / 10_000 / done, 6), _half_up(sum(last) / 10_000 / len(last), 6)
        return (key[0], place, done, mean, short, _half_up(mean * max(self.total - done, 0), 4), mark or trend(short, mean))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (names of the interface)
        held = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        state = self.state.get() if self.state.exists() else (0, "0", [])
        done, total, last = int(state[0]), int(state[1]), [int(x) for x in state[2]]
        found = []
        for place, value in zip(held[self.order].tolist(), held[self.seconds].tolist(), strict=True):
            units = _units(value)
            done, total, last = done + 1, total + units, [*last, units][-LAST:]
            found.append(self._row(key, place, done, total, last))
        self.state.update((done, str(total), last))
        if self.idle_s is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.idle_s)
        yield pd.DataFrame(found, columns=[self.key, self.order, *(c.split()[0] for c in OUTPUT.split(", "))])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            done, total, last = self.state.get()
            row = self._row(key, None, int(done), int(total), [int(x) for x in last], "stalled")
            self.state.clear()
            found = pd.DataFrame([row], columns=[self.key, self.order, *(c.split()[0] for c in OUTPUT.split(", "))])
            yield found.astype({self.order: "Int64"})

    def close(self) -> None:
        pass


def stateful(spark: SparkSession) -> None:
    """Timers and values of `transformWithState` need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def progress_stream(items: DataFrame, key: str, order: str, seconds: str, total: int, idle_s: int | None = None) -> DataFrame:
    """key, order, done, mean_all, mean_last5, eta_s and trend of each item of a stream, in the order of arrival and, within a batch, of `order`."""
    stateful(items.sparkSession)
    kinds = dict(items.dtypes)
    return items.select(key, order, seconds).groupBy(key).transformWithStateInPandas(
        Progress(order, seconds, key, total, idle_s), outputStructType=f"{key} {kinds[key]}, {order} {kinds[order]}, {OUTPUT}", outputMode="Append", timeMode="None" if idle_s is None else "ProcessingTime"
    )


def run_to_end(stream: DataFrame, target: str, checkpoint: str, form: str = "parquet") -> int:
    """Runs a stream over all that has arrived and stops; returns how many batches ran. A batch that is run again replaces its own files."""
    query = stream.writeStream.format(form).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
    query.awaitTermination()
    return len(query.recentProgress)
