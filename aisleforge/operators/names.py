"""Joins of names by difflib's ratio, without comparing every name with every other.

The ratio is twice the matched characters over all characters, and a match takes a character of either name once, so
it is at most that of the multisets of characters.  Those are sets of (character, how many of it so far) and go
through a prefix filter: two that are alike enough share one of the rarest characters of each.  Edit distance is a further
bound.  Only what passes all is matched, on distinct pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .scratch import forget, stored

#: Pairs that one task matches.
DEAL = 8192


def letters(name: Column) -> Column:
    """The characters of a name, each with its running number: distinct, and as many as the name has."""
    characters = F.array_sort(F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0)))
    return F.transform(characters, lambda c, i: F.concat(c, (i + 1 - F.array_position(characters, c)).cast("string")))


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(x, y, ratio) of names x of `left` and y of `right` (tables of one column, name) with SequenceMatcher(None, x, y).ratio() >= least > 0.

    Empty and null names are like none.
    """
    overlap = least / (2 - least)  # of the union, where the ratio is of the mean size
    sides = [d.select(F.col(d.columns[0]).cast("string").alias("name")).filter("length(name) > 0").distinct() for d in (left, right)]
    held = stored(sides[0].unionByName(sides[1]).distinct().withColumn("t", letters(F.col("name"))), "names")
    spread = held.select("name", F.size("t").alias("n"), F.explode("t").alias("c"))
    rarity = spread.groupBy("c").agg(F.count("*").alias("df"))
    ordered = spread.join(rarity, "c").groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct("df", "c"))).alias("o"))
    take = F.col("n") - F.ceil(F.col("n") * F.lit(overlap) - 1e-9).cast("int") + 1
    keys = stored(ordered.select("name", "n", F.posexplode(F.slice(F.col("o.c"), F.lit(1), take)).alias("at", "c")), "name-keys")
    side = lambda d, x: keys.join(d, "name").select("c", F.col("name").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at{x}"))
    # up to a shared character at most as many are shared as the shorter way there has, after it as the shorter rest has
    most = F.least("atx", "aty") + F.least(F.col("nx") - F.col("atx"), F.col("ny") - F.col("aty"))
    fits = 2 * most >= (F.col("nx") + F.col("ny")) * F.lit(least) - 1e-9
    met = side(sides[0], "x").join(side(sides[1], "y"), "c").filter(fits).select("x", "y").distinct()
    shared = F.size(F.array_intersect("tx", "ty"))
    both = met.join(held.select(F.col("name").alias("x"), F.col("t").alias("tx")), "x").join(held.select(F.col("name").alias("y"), F.col("t").alias("ty")), "y")
    total = F.size("tx") + F.size("ty")
    close = both.filter(2 * shared >= total * F.lit(least) - 1e-9)
    # matched characters are a common subsequence, so all others are inserted or deleted: at least as many as there are edits
    likely = stored(close.filter(F.levenshtein("x", "y") <= total * F.lit(1 - least) + 1e-9).select("x", "y"), "likely-names")
    # few bytes, much work: dealt by rows
    dealt = likely.repartition(max(1, -(-likely.count() // DEAL)))
    found = stored(dealt.withColumn("ratio", text.sequence_ratio("x", "y")).filter(F.col("ratio") >= least), "similar-names")
    forget(held, keys, likely)
    return found


def greedy_leaders(order: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, leader) of greedy clustering in the order of `node`: a node follows the first earlier leader it has an edge from, else it leads.

    order: node, sortable and distinct; edges: (a, b) with a < b.  A node is settled as soon as the first of its earlier neighbours that does not
    follow another is known to lead, or all of them follow; so a round settles all nodes whose neighbours are settled, and
    there are as many rounds as the longest chain of such dependencies, not as nodes.
    """
    edges = stored(edges.select("a", "b").distinct(), "edges")
    met = edges.select(F.col("b").alias("node")).distinct()
    settled = stored(order.select("node").join(met, "node", "left_anti").select("node", F.col("node").alias("leader")), "settled")

    def flagged(rows: DataFrame, leaders: DataFrame) -> DataFrame:
        """Marks the edges from new leaders."""
        known = leaders.select(F.col("node").alias("a"), F.lit(True).alias("new"))
        return rows.join(known, "a", "left").select("a", "b", (F.col("leads") | F.col("new").isNotNull()).alias("leads"))

    waiting = stored(flagged(edges.withColumn("leads", F.lit(False)), settled), "open-edges")
    forget(edges)
    while not waiting.isEmpty():
        first = waiting.groupBy("b").agg(F.min(F.struct("a", "leads")).alias("x"))
        followers = stored(first.filter("x.leads").select(F.col("b").alias("node"), F.col("x.a").alias("leader")), "followers")
        gone = followers.select("node")
        left = stored(waiting.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"), "open-edges")
        still = waiting.select(F.col("b").alias("node")).distinct().join(gone, "node", "left_anti")
        freed = stored(still.join(left.select(F.col("b").alias("node")).distinct(), "node", "left_anti").select("node", F.col("node").alias("leader")), "leaders")
        before, settled = (waiting, settled), stored(settled.unionByName(followers).unionByName(freed), "settled")
        waiting = stored(flagged(left, freed), "open-edges")
        forget(*before, followers, freed, left)
    return settled
