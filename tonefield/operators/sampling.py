"""Labelling samples. A seeded hash takes the place of a shuffle: quotas and caps are the contract, not identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V

WEIGHTS = {"Negative": 2, "Neutral": 1, "Positive": 2}


def record_id(url: Column, sentence: Column, target: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", url, sentence, target)), 1, 10)


def sampler_outlet(url: Column | str) -> Column:
    host = T.netloc(url)
    out = host
    for name, shown in V.SAMPLER_OUTLETS.items():
        out = F.when(host == name, shown).otherwise(out)
    return out


def shuffled(seed: int, c: Column) -> Column:
    return F.sha1(F.concat(F.lit(f"{seed}|"), c))


def stratified(facts: DataFrame, size: int = 150, per_sentence: int = 2, seed: int = 13) -> DataFrame:
    """record_id, outlet, sentiment, sentence, target_text. One row a record id, at most `per_sentence` a sentence, quotas by outlet and
    label, filled up from the rest to `size`. Ranks inside strata keep `size` rows at most, so only these meet in one place."""
    rows = facts.where(F.col("sentiment").isin(*V.SENTIMENTS)).select("article_url", "feed_url", "sentence", "target_text", "sentiment")
    rows = rows.withColumn("record_id", record_id(F.col("article_url"), F.col("sentence"), F.col("target_text"))).withColumn("outlet", sampler_outlet("feed_url"))
    rows = rows.groupBy("record_id", "outlet", "sentence", "target_text").agg(F.min("sentiment").alias("sentiment")).withColumn("s", shuffled(seed, F.col("record_id")))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("sentence").orderBy("s", "record_id"))).where(F.col("k") <= per_sentence)
    n = rows.select("outlet").distinct().count()
    if not n:
        return rows.select("record_id", "outlet", "sentiment", "sentence", "target_text")
    total = sum(WEIGHTS.values()) * n
    quota = F.lit(0)
    for label, w in WEIGHTS.items():
        quota = F.when(F.col("sentiment") == label, round(size * w / total)).otherwise(quota)
    inside = W.partitionBy("outlet", "sentiment").orderBy("s", "record_id")
    ranked = rows.withColumn("r", F.row_number().over(inside)).where(F.col("r") <= size).withColumn("late", (F.col("r") > quota).cast("int"))
    return ranked.orderBy("late", "s", "record_id").limit(size).select("record_id", "outlet", "sentiment", "sentence", "target_text")


def buckets(facts: DataFrame, size: int = 40, seed: int = 13) -> DataFrame:
    """Rows of each (role, confidence) bucket in equal number, capped at `size` in all."""
    rows = facts.select("row_id", "role", "extraction_confidence").withColumn("s", shuffled(seed, F.col("row_id").cast("string")))
    n = rows.select("role", "extraction_confidence").distinct().count()
    each = max(1, size // max(n, 1))
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("role", "extraction_confidence").orderBy("s"))).where(F.col("r") <= each)
    return ranked.orderBy("s").limit(size).select("row_id", "role", "extraction_confidence")


def simple(facts: DataFrame, size: int = 15, seed: int = 13) -> DataFrame:
    return facts.select("row_id").withColumn("s", shuffled(seed, F.col("row_id").cast("string"))).orderBy("s").limit(size).select("row_id")
