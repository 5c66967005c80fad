"""Readers with explicit schemas: fact rows, gold tables, sentence lists, annotated articles, seen URLs, labels with their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V

FACT = """feed_url STRING, article_url STRING, fetched_at STRING, sentence STRING, target_text STRING, role STRING, extraction_confidence STRING,
embedded_entities ARRAY<STRING>, resolved_mentions ARRAY<STRING>, sentiment STRING, sentiment_confidence DOUBLE,
predicted_sentiment_label STRING, predicted_confidence DOUBLE, probabilities STRUCT<Negative: DOUBLE, Neutral: DOUBLE, Positive: DOUBLE>, error STRING"""
ANNOTATED = "primary_gid STRING, sentence_normalized STRING, targets ARRAY<STRUCT<mention: STRING, `from`: INT, `to`: INT, polarity: DOUBLE>>"
GOLD = "sentence STRING, target STRING, target_from INT, target_to INT, polarity STRING"
CANDIDATE = "sentence STRING, target STRING, candidate STRING, candidate_start INT, candidate_end INT, source STRING, ner_label STRING, label INT"


def facts(spark: SparkSession, path: str) -> DataFrame:
    """Fact rows; both spellings of the prediction are read, empty and zero values count as missing."""
    rows = spark.read.schema(FACT).option("mode", "FAILFAST").json(path)
    label = F.coalesce(T.blank_as_null("predicted_sentiment_label"), T.blank_as_null("sentiment"))
    confidence = F.coalesce(F.nullif("predicted_confidence", F.lit(0.0)), F.nullif("sentiment_confidence", F.lit(0.0)), F.lit(0.0))
    return rows.withColumns({"sentiment": label, "sentiment_confidence": confidence}).drop("predicted_sentiment_label", "predicted_confidence")


def labelable(spark: SparkSession, path: str) -> DataFrame:
    """Fact rows without an error whose sentiment is known."""
    return facts(spark, path).where(T.blank_as_null("error").isNull() & F.col("sentiment").isin(*V.SENTIMENTS))


def _ordered(df: DataFrame) -> DataFrame:
    return df.withColumn("row_id", F.monotonically_increasing_id())


def gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """(sentence, first_row, golds): targets by stripped sentence in file order; a polarity that is no number is null."""
    rows = _ordered(spark.read.schema(GOLD).option("header", True).csv(path))
    head = spark.read.option("header", True).csv(path).columns
    if {"sentence", "target"} - {c.lstrip("﻿") for c in head}:
        raise ValueError("the gold table lacks sentence or target")
    item = F.struct("row_id", T.strip("target").alias("target"), F.expr("try_cast(polarity AS DOUBLE)").alias("polarity"))
    return rows.groupBy(T.strip("sentence").alias("sentence")).agg(F.min("row_id").alias("first_row"), F.array_sort(F.collect_list(item)).alias("golds"))


def sentence_lines(spark: SparkSession, path: str) -> DataFrame:
    return _ordered(spark.read.text(path)).select("row_id", T.strip("value").alias("sentence")).where("sentence <> ''")


def parse_gid(c: Column | str) -> Column:
    """source_a_b_index_mention_from_to, where the mention may hold underscores; null unless six parts and whole numbers."""
    p = F.split(T.col(c), "_")
    n = F.size(p)
    number = lambda i: F.element_at(p, i).try_cast("int")
    mention = F.array_join(F.slice(p, F.lit(5), F.greatest(n - 6, F.lit(0))), "_")
    made = F.struct(F.array_join(F.slice(p, 1, 3), "_").alias("article_id"), number(4).alias("sentence_index"), mention.alias("mention"), number(-2).alias("start"), number(-1).alias("stop"))
    return F.when((n >= 6) & number(4).isNotNull() & number(-2).isNotNull() & number(-1).isNotNull(), made)


def group_articles(rows: DataFrame) -> DataFrame:
    """rows (gid, sentence, targets, row_id) -> (article_id, sentence_index, sentence: the first seen, targets in row order)."""
    parsed = rows.where(F.coalesce("sentence", F.lit("")) != "").withColumn("g", parse_gid("gid")).where("g IS NOT NULL")
    grouped = parsed.groupBy("g.article_id", "g.sentence_index").agg(F.min_by("sentence", "row_id").alias("sentence"), F.array_sort(F.collect_list(F.struct("row_id", "targets"))).alias("t"))
    return grouped.select("article_id", "sentence_index", "sentence", F.flatten(F.transform("t", lambda x: x["targets"])).alias("targets"))


def articles(spark: SparkSession, path: str) -> DataFrame:
    rows = _ordered(spark.read.schema(ANNOTATED).json(path)).withColumnRenamed("primary_gid", "gid").withColumnRenamed("sentence_normalized", "sentence")
    return group_articles(rows)


def flat_targets(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(ANNOTATED).json(path).select(F.col("sentence_normalized").alias("sentence"), F.explode("targets").alias("t"))
    return rows.select("sentence", F.col("t.mention").alias("target"), F.col("t.from").alias("target_from"), F.col("t.to").alias("target_to"), "t.polarity")


def projected(flat: DataFrame, columns: list[str]) -> DataFrame:
    """Annotated targets by sentence alone, with the target, or with the polarity too."""
    return flat.select(*columns)


def candidates_csv(spark: SparkSession, path: str) -> DataFrame:
    """Only an empty field is null; words such as NA or None stay text."""
    return spark.read.schema(CANDIDATE).option("header", True).option("nullValue", "").csv(path)


def seen_urls(spark: SparkSession, path: str) -> DataFrame:
    """A missing file is an empty set."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(path).select(T.strip("value").alias("url")).where("url <> ''").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "url string")


def labels_with_key(labels: DataFrame, key: DataFrame) -> DataFrame:
    """Hand labels joined to predictions by record_id. Blank labels stay null; an unknown label or a record without its key is an error."""
    from ..operators.evaluate import hand_label

    joined = labels.join(key, "record_id", "left")
    missing = F.when(F.col("predicted_label").isNull(), F.raise_error(F.concat(F.lit("no key for "), "record_id")).cast("string")).otherwise(F.col("predicted_label"))
    return joined.withColumn("predicted_label", missing).withColumn("gold_label", hand_label(F.coalesce("gold_label", F.lit(""))))
