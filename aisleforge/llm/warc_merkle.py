"""WARC fixity audit with Merkle trees.

Pages become WARC response records; FANOUT ** 2 consecutive ids share a file, in which records
stand in ascending order of id at known byte offsets.  Every record's bytes are hashed
(SHA-256).  FANOUT neighbours form a node whose hash is that of their hashes and byte ranges in
order, and so on up to one root.  Two replicas are compared from the root down: only children of
nodes that differ are looked at, so the cost of an audit follows the damage, not the archive.  A lost record
moves those after it in its file, so their nodes differ and are descended; whether a record itself is intact
its own hash says.  The replicas are tables of records; the bytes are those that a file would hold.

All steps are SQL functions, and a group has at most FANOUT members whatever the data hold: records that
repeat an id are folded into one leaf by sums over their hashes, with partial sums before
the shuffle.

Defined results: a null url or html counts as empty; a null id counts as -1; repeated rows are one leaf
together; an id that only one replica has is "missing" or "extra"; two empty archives agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import forget, stored

SHIFT = 5
FANOUT = 1 << SHIFT


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.0 response record: header, blank line, payload, two line ends."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, length, sha256 of each row's record."""
    page_id = F.coalesce(F.col(id_col).cast("long"), F.lit(-1))
    made = pages.select(page_id.alias("page_id"), record_text(page_id, F.col(url_col), F.col(html_col)).alias("record"))
    return made.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record"), 256).alias("sha256"))


def leaves(made: DataFrame) -> DataFrame:
    """One leaf per id: node (the id), file, length, n, hash; offset in the file."""
    pieces = [F.sum(F.conv(F.substring("sha256", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"h{k}") for k in range(8)]
    grouped = made.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.min("sha256").alias("only"), *pieces)
    folded = F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.col(f"h{k}").cast("string") for k in range(8)]), 256)
    held = grouped.select(F.col("page_id").alias("node"), F.shiftright("page_id", 2 * SHIFT).alias("file"), "n", "length", F.when(F.col("n") == 1, F.col("only")).otherwise(folded).alias("hash"))
    # a file holds at most FANOUT ** 2 leaves
    ahead = Window.partitionBy("file").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))


@dataclass
class Tree:
    """levels[0] holds leaves; every level: node, hash, first and last file, offset and end in these files."""

    levels: list[DataFrame]

    @property
    def root(self) -> str | None:
        top = self.levels[-1].select("hash").take(1)
        return top[0][0] if top else None


def build(leaf_table: DataFrame, depth: int) -> Tree:
    """depth: levels above the leaves, so that FANOUT ** depth ids lie under one root."""
    level = leaf_table.select("node", "hash", F.col("file").alias("first_file"), F.col("file").alias("last_file"), "offset", (F.col("offset") + F.col("length")).alias("end"))
    levels = [stored(level, "merkle-0")]
    for k in range(1, depth + 1):
        ordered = F.array_sort(F.collect_list(F.struct("node", "hash", "first_file", "last_file", "offset", "end")))
        grouped = levels[-1].groupBy(F.shiftright("node", SHIFT).alias("up")).agg(ordered.alias("x"))
        children = F.transform("x", lambda c: F.concat_ws(":", *[c[x].cast("string") for x in ("node", "hash", "first_file", "offset", "last_file", "end")]))
        level = grouped.select(F.col("up").alias("node"), F.sha2(F.concat_ws(",", children), 256).alias("hash"), F.col("x")[0]["first_file"].alias("first_file"), F.element_at("x", -1)["last_file"].alias("last_file"), F.col("x")[0]["offset"].alias("offset"), F.element_at("x", -1)["end"].alias("end"))
        levels.append(stored(level, f"merkle-{k}"))
    return Tree(levels)


def depth_for(*tables: DataFrame) -> int:
    """Levels that put all ids of the tables under one node on either side of zero."""
    # -1 - id has the bits of a negative id and fits where -id does not
    most = max((int(t.agg(F.max(F.when(F.col("page_id") < 0, -1 - F.col("page_id")).otherwise(F.col("page_id")))).first()[0] or 0) for t in tables), default=0)
    depth = 1
    while most >> (SHIFT * depth):
        depth += 1
    return depth


def differences(ours: Tree, theirs: Tree) -> DataFrame:
    """node (id) and status of the leaves that differ, found by descending only where hashes differ."""
    wanted = None
    for k in range(len(ours.levels) - 1, -1, -1):
        a, b = ours.levels[k].select("node", F.col("hash").alias("ours")), theirs.levels[k].select("node", F.col("hash").alias("theirs"))
        if wanted is not None:
            inside = wanted.select(F.col("node").alias("up"))
            a, b = (t.withColumn("up", F.shiftright("node", SHIFT)).join(inside, "up", "left_semi").drop("up") for t in (a, b))
        wanted = a.join(b, "node", "full_outer").filter(~F.col("ours").eqNullSafe(F.col("theirs")))
        if k:
            wanted = stored(wanted.select("node"), f"differ-{k}")
    return wanted.select("node", F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").otherwise("changed").alias("status"))


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, file, offset, length, sha256 and status (intact, changed, missing, extra) of every id of either replica.

    Offsets, lengths and hashes are those of `pages`, null for an extra id.
    """
    ours, theirs = records(pages), records(replica)
    depth = depth_for(ours, theirs)
    mine = stored(leaves(ours), "leaves")
    trees = build(mine, depth), build(leaves(theirs), depth)
    found = stored(differences(*trees), "differences")
    forget(*trees[0].levels, *trees[1].levels)
    joined = mine.join(found, "node", "full_outer")
    return joined.select(F.col("node").alias("page_id"), "file", "offset", "length", F.col("hash").alias("sha256"), F.coalesce("status", F.lit("intact")).alias("status"))
