"""The engine's inputs made from the star-schema test tables, one rule for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows: one target mention with its sentiment. Part and page keys are dense, so a remainder picks one."""
    part, pages = table(spark, sf_dir, "part"), table(spark, sf_dir, "pages")
    n_part, n_pages = part.count(), pages.count()  # read from the files' footers
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    events = events.withColumns({"pid": F.col("event_id") % n_part, "gid": F.col("event_id") % n_pages})
    rows = events.join(part.select(F.col("p_partkey").alias("pid"), "p_name"), "pid").join(pages.select(F.col("page_id").alias("gid"), "url"), "gid")
    last = F.substring_index("p_name", " ", -1)
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 10**6))
    surname, full = cap(last), cap(F.col("p_name"))
    base = F.when(F.col("event_id") % 3 == 0, surname).otherwise(full)
    host = T.netloc("url")
    return rows.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("https://"), host).alias("feed_url"),
        F.col("url").alias("article_url"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"),
        F.concat(base, F.lit(" met investors at "), host, F.lit(".")).alias("sentence"),
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("White "), base)).otherwise(base).alias("target_text"),
        F.element_at(F.array(*map(F.lit, ("subject", "object", "entity", "noun_phrase"))), (F.col("event_id") % 4 + 1).cast("int")).alias("role"),
        F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), (F.col("event_id") % 3 + 1).cast("int")).alias("extraction_confidence"),
        F.when(F.col("event_id") % 5 == 0, F.array(surname)).otherwise(F.array().cast("array<string>")).alias("embedded_entities"),
        F.when(F.col("event_id") % 11 == 0, None)
        .when(F.col("event_type").isin("purchase", "signup"), "Positive")
        .when(F.col("event_type").isin("view", "click"), "Neutral")
        .otherwise("Negative")
        .alias("sentiment"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("sentiment_confidence"),
    )


MENTIONS = r"""named AS (
  SELECT event_id AS row_id, ts, event_type, value, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
         upper(substr(regexp_extract(p_name, '[^ ]*$'), 1, 1)) || substr(regexp_extract(p_name, '[^ ]*$'), 2) AS surname,
         upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS fullname
  FROM events JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part) JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages)),
mentions AS (
  SELECT row_id, 'https://' || host AS feed_url, url AS article_url, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS fetched_at,
         CASE WHEN row_id % 3 = 0 THEN surname ELSE fullname END || ' met investors at ' || host || '.' AS sentence,
         CASE WHEN row_id % 7 = 0 THEN 'White ' ELSE '' END || CASE WHEN row_id % 3 = 0 THEN surname ELSE fullname END AS target_text,
         (['subject', 'object', 'entity', 'noun_phrase'])[row_id % 4 + 1] AS role, (['high', 'medium', 'low'])[row_id % 3 + 1] AS extraction_confidence,
         CASE WHEN row_id % 5 = 0 THEN [surname] ELSE [] END AS embedded_entities,
         CASE WHEN row_id % 11 = 0 THEN NULL WHEN event_type IN ('purchase', 'signup') THEN 'Positive' WHEN event_type IN ('view', 'click') THEN 'Neutral' ELSE 'Negative' END AS sentiment,
         least(value / 100, 1.0) AS sentiment_confidence
  FROM named)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, line, pos, sentence): newlines are hard boundaries, then an end mark before white space."""
    from ..operators.sentences import split_sentences

    return split_sentences(table(spark, sf_dir, "documents"), keep=["doc_id", "lang"])


SENTENCES = r"""lined AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
cut AS (
  SELECT doc_id, lang, line, string_split(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM lined),
sentences AS (
  SELECT doc_id, lang, line, pos, regexp_replace(part, '^\s+|\s+$', '', 'g') AS sentence
  FROM (SELECT doc_id, lang, line, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM cut) WHERE regexp_replace(part, '^\s+|\s+$', '', 'g') <> '')"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a gold label, a rule's prediction and its confidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return rows.select(
        "doc_id", "lang", "source",
        F.when(F.col("toxic") == 1, "Negative").when(F.col("quality") == 1, "Positive").otherwise("Neutral").alias("gold"),
        F.when(F.col("n_chars") < 700, "Negative").when(F.col("n_chars") < 1500, "Neutral").otherwise("Positive").alias("predicted"),
        F.when(F.col("n_chars") % 3 == 0, "high").when(F.col("n_chars") % 3 == 1, "medium").otherwise("low").alias("extraction_confidence"),
    )


GOLD = """gold AS (
  SELECT doc_id, lang, source, CASE WHEN toxic = 1 THEN 'Negative' WHEN quality = 1 THEN 'Positive' ELSE 'Neutral' END AS gold,
         CASE WHEN n_chars < 700 THEN 'Negative' WHEN n_chars < 1500 THEN 'Neutral' ELSE 'Positive' END AS predicted,
         CASE WHEN n_chars % 3 = 0 THEN 'high' WHEN n_chars % 3 = 1 THEN 'medium' ELSE 'low' END AS extraction_confidence
  FROM labels JOIN documents USING (doc_id))"""
