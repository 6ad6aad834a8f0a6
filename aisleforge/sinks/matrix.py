"""Embedding matrices as parts that any NumPy reads, with an index by which one row is found.

Vectors are sorted by id and cut into ranges.  Each task writes its range as two .npy files, the vectors [rows, dims] and their ids,
and the manifest says which ids and rows each part holds.  A lookup finds the part by its ids' range, the row by a binary search
in the ids, and reads that row's bytes alone, as rows of a .npy file stand at known offsets.

Files are written and read by the tasks through Arrow's file systems (local and mounted folders, HDFS, object stores), under
names of their own for every attempt, so a repeated task harms nothing.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.places import place

PART = "part int, file string, first_id long, last_id long, n long, dims int"


def _header(rows: int, dims: int | None, kind: str) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": kind, "fortran_order": False, "shape": (rows,) if dims is None else (rows, dims)})
    return out.getvalue()


def write_matrix(vectors: DataFrame, folder: str, id_col: str = "vec_id", vector_col: str = "embedding", parts: int | None = None) -> dict:
    """Writes the vectors and returns the manifest. Rows without id or vector have no place in a matrix; other lengths than the first's are an error."""
    files, root = place(folder)
    files.create_dir(root, recursive=True)
    held = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    dealt = (held.repartitionByRange(parts, "id") if parts else held.repartitionByRange("id")).sortWithinPartitions("id", "v").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, at = place(folder)
        name, ids, n, dims, part, body = uuid.uuid4().hex, [], 0, None, None, None
        # vectors go out batch by batch; the header, which holds their number, has a fixed size and is joined with them at the end
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("v").value_lengths().to_numpy()
            dims = int(sizes[0]) if dims is None else dims
            if (sizes != dims).any() or batch.column("v").flatten().null_count:
                raise ValueError(f"a matrix of {dims} columns cannot hold vectors of another length or with missing components")
            body = local.open_output_stream(f"{at}/{name}.body") if body is None else body
            body.write(batch.column("v").flatten().to_numpy().astype("<f4").tobytes())
            ids.append(batch.column("id").to_numpy())
            n, part = n + batch.num_rows, batch.column("part")[0].as_py()
        if body is None:
            return
        body.close()
        with local.open_output_stream(f"{at}/{name}.npy") as out, local.open_input_stream(f"{at}/{name}.body") as rows:
            out.write(_header(n, dims, "<f4"))
            while chunk := rows.read(1 << 22):
                out.write(chunk)
        local.delete_file(f"{at}/{name}.body")
        every = np.concatenate(ids)
        with local.open_output_stream(f"{at}/{name}.ids.npy") as out:
            out.write(_header(n, None, "<i8") + every.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "first_id": int(every[0]), "last_id": int(every[-1]), "n": n, "dims": dims}], pa.schema([("part", pa.int32()), ("file", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n", pa.int64()), ("dims", pa.int32())]))

    made = sorted(dealt.mapInArrow(run, PART).collect())  # a row per task
    if len({r["dims"] for r in made}) > 1:
        raise ValueError("vectors of different lengths are no matrix")
    ahead, listed = 0, []
    for r in made:
        listed.append({"file": r["file"], "first_id": r["first_id"], "last_id": r["last_id"], "first_row": ahead, "rows": r["n"]})
        ahead += r["n"]
    manifest = {"rows": ahead, "dims": made[0]["dims"] if made else 0, "parts": listed}
    with files.open_output_stream(f"{root}/index.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    files, root = place(folder)
    with files.open_input_stream(f"{root}/index.json") as held:
        return json.loads(held.read())


def _array_at(held: pa.NativeFile, kind: str, width: int, first: int, n: int) -> np.ndarray:
    """n rows of `width` numbers of an open .npy file from row `first`, by their place in it."""
    start = io.BytesIO(held.read_at(128, 0))
    np.lib.format.read_magic(start)
    np.lib.format.read_array_header_1_0(start)
    size = np.dtype(kind).itemsize * width
    return np.frombuffer(held.read_at(n * size, start.tell() + first * size), kind).reshape(n, width)


def _parts(spark: SparkSession, manifest: dict) -> DataFrame:
    """A row per part: bounded by the tasks that wrote them."""
    return spark.createDataFrame([(p["file"], p["first_id"], p["last_id"], p["first_row"], p["rows"]) for p in manifest["parts"]], "file string, first_id long, last_id long, first_row long, n long")


def read_matrix(spark: SparkSession, folder: str, rows: int = 4096) -> DataFrame:
    """row, id and vector of the whole matrix; a task reads its parts some rows at a time."""
    manifest = read_manifest(folder)
    dims = manifest["dims"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = place(folder)
        for batch in batches:
            for part in batch.to_pylist():
                with files.open_input_file(f"{root}/{part['file']}.npy") as held, files.open_input_file(f"{root}/{part['file']}.ids.npy") as names:
                    for lo in range(0, part["n"], rows):
                        n = min(rows, part["n"] - lo)
                        x = _array_at(held, "<f4", dims, lo, n)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(x.reshape(-1)))
                        yield pa.RecordBatch.from_arrays([pa.array(part["first_row"] + lo + np.arange(n)), pa.array(_array_at(names, "<i8", 1, lo, n)[:, 0]), lists], ["row", "id", "vector"])

    listed = _parts(spark, manifest)
    return listed.repartition(max(1, len(manifest["parts"])), "file").mapInArrow(run, "row long, id long, vector array<float>")


def lookup(wanted: DataFrame, folder: str, id_col: str = "id") -> DataFrame:
    """row, id and vector of the wanted ids: each goes to the parts whose range of ids holds it, and of those only its own rows are read."""
    spark, manifest = wanted.sparkSession, read_manifest(folder)
    dims = manifest["dims"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = place(folder)
        open_file, name, ids = None, None, None
        for batch in batches:
            found = []
            for part in batch.to_pylist():
                if part["file"] != name:  # rows come sorted by their part
                    name, open_file = part["file"], files.open_input_file(f"{root}/{part['file']}.npy")
                    with files.open_input_file(f"{root}/{name}.ids.npy") as names:
                        ids = _array_at(names, "<i8", 1, 0, part["n"])[:, 0]
                for at in range(*np.searchsorted(ids, [part["id"], part["id"] + 1])):
                    found.append((part["first_row"] + at, part["id"], _array_at(open_file, "<f4", dims, at, 1)[0].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.float32())))], ["row", "id", "vector"])

    asked = wanted.select(F.col(id_col).cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    met = asked.join(F.broadcast(_parts(spark, manifest)), F.col("id").between(F.col("first_id"), F.col("last_id")))
    sorted_parts = met.select("file", "first_row", "n", "id").repartition("file").sortWithinPartitions("file", "id")
    return sorted_parts.mapInArrow(run, "row long, id long, vector array<float>")
