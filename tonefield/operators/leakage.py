"""Split leakage and duplicates: overlaps as set operations, near-duplicates by TF-IDF cosine over shared terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import written


def overlap(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values in both."""
    return a.select(*columns).intersect(b.select(*columns))


def duplicate_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, distinct rows, and how many rows are copies; copies are counted before they meet."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"), (F.sum("n") - F.count("*")).alias("duplicates"))


def label_conflicts(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("n")).where("labels > 1")


def terms(c: Column) -> Column:
    """Lower-case words of two letters or digits and more."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9_à-öø-ÿ]+"), lambda x: F.length(x) >= 2)


def tfidf(docs: DataFrame, key: str, column: str, corpus: DataFrame | None = None) -> DataFrame:
    """(key, term, w): tf * (ln((1 + n) / (1 + df)) + 1), each document's weights of unit length. df and n come from corpus, itself by default."""
    count = lambda d: d.select(key, F.explode(terms(F.col(column))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    tf = count(docs)
    base = corpus if corpus is not None else docs
    n = base.count()
    df = (tf if corpus is None else count(base)).groupBy("term").agg(F.count("*").alias("df"))
    joined = tf.join(df, "term", "left")
    raw = joined.withColumn("x", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("x") / F.col("norm")).alias("w"))


def nearest(queries: DataFrame, corpus: DataFrame, key: str, column: str, top: int = 20) -> DataFrame:
    """Each query document's most similar corpus document by cosine, the `top` most similar pairs of these.

    Terms that stand in many documents weigh little, so a query's rarest terms decide which documents can be its best. A query is scored in two
    steps: by its heavy terms alone (in falling weight, until the rest can add no more than a share REST of its length), and then, for the pairs that those found and
    that can still be the best, exactly by all its terms. A query whose best partial score is below what the rest could give alone is scored by all terms."""
    q = tfidf(queries, key, column, corpus).withColumnsRenamed({key: "query", "w": "qw"})
    c = tfidf(corpus, key, column)
    falling = W.partitionBy("query").orderBy(F.desc("qw"), "term")
    q = q.withColumn("rest", F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.sum(F.col("qw") * F.col("qw")).over(falling.rowsBetween(W.unboundedPreceding, -1)))))
    q = written(q.withColumn("rest", F.coalesce("rest", F.lit(1.0))))  # the length of this term's part and all after it
    c = written(c)
    heavy, light = q.where(F.col("rest") > REST), q.where(F.col("rest") <= REST)
    first = written(heavy.join(c, "term").groupBy("query", key).agg(F.sum(F.col("qw") * F.col("w")).alias("part")))
    # the rest of a query can add REST at most to any pair (both are of unit length)
    lead = first.groupBy("query").agg(F.max("part").alias("lead"))
    able = first.join(lead, "query").where((F.col("part") + REST + NEAR >= F.col("lead")) & (F.col("lead") >= REST + NEAR)).select("query", key, "part")
    tail = light.join(able.select("query", key), "query").join(c, [key, "term"]).groupBy("query", key).agg(F.sum(F.col("qw") * F.col("w")).alias("more"))
    found = able.join(tail, ["query", key], "left").select("query", key, (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("s"))
    open_ = q.select("query").distinct().join(lead.where(F.col("lead") >= REST + NEAR), "query", "left_anti")
    whole = q.join(open_, "query").join(c, "term").groupBy("query", key).agg(F.sum(F.col("qw") * F.col("w")).alias("s"))
    scores = found.unionByName(whole).select("query", key, F.round("s", 6).alias("similarity"))
    best = scores.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), key))).where("r = 1").drop("r")
    return best.orderBy(F.desc("similarity"), "query").limit(top)


#: What the light terms of a query may add to a cosine, and what rounding hides.
REST, NEAR = 0.3, 1e-6
