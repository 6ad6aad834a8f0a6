"""Category discovery by TF-IDF, k-means and density clusters with pyspark.ml and DataFrame joins.

Items are distinct product types, a dimension; vectors have at most `features` terms.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .names import greedy_leaders
from .scratch import stored
from .similarity import jaccard_pairs


def tfidf(df: DataFrame, text_col: str, features: int = 1000, min_df: float = 2.0, bigrams: bool = True) -> tuple[DataFrame, list[str]]:
    """df with `features` (TF-IDF of words and word pairs) and the vocabulary."""
    steps = [RegexTokenizer(inputCol=text_col, outputCol="__words", pattern=r"[^\p{L}\p{N}]+"), NGram(n=2, inputCol="__words", outputCol="__pairs")]
    both = "concat(__words, __pairs)" if bigrams else "__words"
    steps += [SQLTransformer(statement=f"SELECT *, {both} AS __terms FROM __THIS__"), CountVectorizer(inputCol="__terms", outputCol="__counts", vocabSize=features, minDF=min_df), IDF(inputCol="__counts", outputCol="features")]
    model = Pipeline(stages=steps).fit(df)
    return model.transform(df).drop("__words", "__pairs", "__terms", "__counts"), model.stages[3].vocabulary


def tfidf_clusters(df: DataFrame, text_col: str, k: int, features: int = 1000, min_df: float = 2.0, bigrams: bool = True, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """df with `features` and the `cluster` of one k-means, and the vocabulary."""
    weighted, vocabulary = tfidf(df, text_col, features, min_df, bigrams)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(weighted).transform(weighted), vocabulary


def dbscan(vectors: DataFrame, id_col: str, vector_col: str = "features", eps: float = 0.5, min_samples: int = 3) -> DataFrame:
    """(id, cluster) by density over the cosine distance; noise and zero vectors have no row.

    A cluster is named by its smallest core id; a border item goes to the smallest such cluster in reach. Weights must not be
    negative. Equal vectors are one point with a count. A pair within eps shares a term among the rarest of each whose other
    terms have a norm under 1 - eps; only those meet.
    """
    bare = vectors.select(F.col(id_col).alias("id"), vector_to_array(vector_col).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    scaled = bare.withColumn("n", length).filter("n > 0").select("id", F.transform("v", lambda x: F.round(x / F.col("n"), 12)).alias("v"))
    points = stored(scaled.groupBy("v").agg(F.min("id").alias("p"), F.count("*").alias("copies"), F.collect_list("id").alias("ids")), "points")
    terms = points.select("p", F.posexplode("v").alias("t", "w")).filter("w > 0")
    ranked = terms.join(terms.groupBy("t").agg(F.count("*").alias("df")), "t")
    rarest = Window.partitionBy("p").orderBy("df", "t")
    # the norm of this term and all more frequent ones; below 1 - eps they cannot carry a pair alone
    rest = F.sqrt(F.sum(F.col("w") * F.col("w")).over(rarest.rowsBetween(0, Window.unboundedFollowing)))
    prefix = ranked.withColumn("rest", rest).filter(F.col("rest") >= 1 - eps - 1e-9).select("p", "t")
    met = prefix.select("t", F.col("p").alias("a")).join(prefix.select("t", F.col("p").alias("b")), "t").filter("a < b").select("a", "b").distinct()
    held = points.select("p", "v", "copies")
    pairs = met.join(held.select(F.col("p").alias("a"), F.col("v").alias("va")), "a").join(held.select(F.col("p").alias("b"), F.col("v").alias("vb")), "b")
    cosine = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = pairs.filter(cosine >= 1 - eps - 1e-9).select("a", "b")
    both = stored(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(points.select(F.col("p").alias("a"), F.col("p").alias("b"))), "near")
    core = stored(both.join(held.select(F.col("p").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("n")).filter(F.col("n") >= min_samples).select(F.col("a").alias("core")), "cores")
    links = both.join(core.select(F.col("core").alias("a")), "a").join(core.select(F.col("core").alias("b")), "b").select("a", "b")
    roots = connected_components(links)
    reached = both.join(roots.select(F.col("node").alias("b"), "root"), "b").join(core.select(F.col("core").alias("a"), F.lit(True).alias("own")), "a", "left")
    found = reached.groupBy(F.col("a").alias("p")).agg(F.min("root").alias("cluster"))
    return points.join(found, "p").select(F.explode("ids").alias(id_col), "cluster")


def pooled_clusters(df: DataFrame, text_col: str, least: int = 3, eps: float = 0.5, features: int = 1000, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """df's rows with features, run, cluster and confidence, once for every cluster of at least `least` rows they are in, and the vocabulary.

    Runs are k-means for k from 3 to 14, at most a third of the rows (exclusive), which count with two such clusters or more
    (confidence 0.7), and density clusters (0.8). Under five rows there are none.
    """
    weighted, vocabulary = tfidf(df.withColumn("__id", F.col(text_col)), text_col, features)
    weighted = stored(weighted, "weighted")
    n = weighted.count()
    runs = []
    for k in range(3, min(15, n // 3)) if n >= 5 else ():
        labelled = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(weighted).transform(weighted)
        runs.append(labelled.select("*", F.lit(f"kmeans-{k:02}").alias("run"), F.lit(0.7).alias("confidence")).withColumn("cluster", F.col("cluster").cast("string")))
    if n >= 5:
        dense = dbscan(weighted, "__id", eps=eps, min_samples=least)
        runs.append(weighted.join(dense, "__id").select(*weighted.columns, F.col("cluster").cast("string").alias("cluster"), F.lit("density").alias("run"), F.lit(0.8).alias("confidence")))
    empty = weighted.limit(0).select("*", F.lit("").alias("cluster"), F.lit("").alias("run"), F.lit(0.0).alias("confidence"))
    for run in runs:
        empty = empty.unionByName(run)
    sized = empty.withColumn("__n", F.count("*").over(Window.partitionBy("run", "cluster"))).filter(F.col("__n") >= least)
    firsts = F.size(F.collect_set("cluster").over(Window.partitionBy("run")))
    kept = sized.withColumn("__clusters", firsts).filter((F.col("__clusters") >= 2) | (F.col("run") == "density"))
    return kept.drop("__n", "__clusters", "__id"), vocabulary


def coherent_clusters(df: DataFrame, type_col: str, text_col: str, features: int = 100, seed: int = 42) -> DataFrame:
    """(cluster, size, top_types, coherence) of one k-means with k = min(15, max(3, types // 2)).

    Coherence is the share of the cluster's most frequent type; top_types are its three most frequent, ties by name.
    """
    kinds = df.agg(F.countDistinct(type_col)).first()[0]
    if kinds == 0:
        return df.sparkSession.createDataFrame([], "cluster int, size long, top_types array<string>, coherence double")
    clustered, _ = tfidf_clusters(df, text_col, min(15, max(3, kinds // 2)), features, 1.0, seed=seed)
    counted = clustered.groupBy("cluster", F.col(type_col).alias("t")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "t"))
    top = counted.withColumn("rank", rank).groupBy("cluster")
    held = top.agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "t")))).alias("x"), F.max("n").alias("most"))
    return held.select("cluster", "size", F.col("x.t").alias("top_types"), (F.col("most") / F.col("size")).alias("coherence"))


def cluster_names(clustered: DataFrame, vocabulary: list[str], terms: int = 2, by: Iterable[str] = ("cluster",)) -> DataFrame:
    """(*by, name): the terms with the largest mean weight, title-cased."""
    by = list(by)
    words = F.array(*map(F.lit, vocabulary))
    weights = clustered.select(*by, F.posexplode(vector_to_array("features")).alias("pos", "w")).filter("w > 0").groupBy(*by, "pos").agg(F.sum("w").alias("w"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("w"), "pos"))
    best = weights.withColumn("rank", rank).filter(F.col("rank") <= terms)
    return best.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "pos"))).alias("x")).select(*by, F.initcap(F.array_join(F.transform("x", lambda t: F.element_at(words, t["pos"] + 1)), " ")).alias("name"))


def merged_names(named: DataFrame, order: Iterable[str] = ("cluster",), over: float = 0.8) -> DataFrame:
    """The rows of named (name, n, ...) that are left when, largest first, each name goes whose word Jaccard with a kept one is over `over`.

    Of equal size the first in `order` comes first. Alike names come from the prefix filter, and who stays is settled in rounds.
    """
    order, kinds = list(order), dict(named.dtypes)
    words = stored(named.withColumn("__w", F.array_sort(F.array_distinct(F.split(F.lower("name"), " ")))), "named-clusters")
    # equal names fall together at once; places in the order as text
    place = F.concat_ws("|", F.lpad((F.lit(2**62) - F.col("n")).cast("string"), 19, "0"), *[F.col(c) if kinds[c] == "string" else F.lpad(F.col(c).cast("string"), 20, "0") for c in order])
    heads = stored(words.groupBy("__w").agg(F.min(place).alias("node")), "names")
    pairs = jaccard_pairs(heads, "node", "__w", over).filter(F.col("jaccard") > over + 1e-12).select("a", "b")
    kept = greedy_leaders(heads, pairs).filter("node = leader").select("node")
    return words.withColumn("node", place).join(kept, "node").drop("node", "__w")
