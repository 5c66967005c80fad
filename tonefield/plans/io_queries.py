"""Queries that write tables in the engine's file formats and read them back through its readers, over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import leakage as L
from ..operators import marking as M
from ..sources import adapters as A
from ..sources import readers, sinks
from .registry import query

_FACT_SQL = A.MENTIONS + """,
facts AS (SELECT row_id, feed_url, article_url, fetched_at, sentence, target_text, role, array_to_string(embedded_entities, '|') AS embedded, sentiment, coalesce(nullif(sentiment_confidence, 0), 0.0)::DOUBLE AS sentiment_confidence,
  CASE WHEN row_id % 10 = 0 THEN 'failed' WHEN row_id % 10 = 1 THEN '' END AS error FROM mentions)"""


def _facts(spark, sf_dir):
    """Every third row spells its prediction the other way; some hold an error, some an empty one."""
    rows = A.mentions(spark, sf_dir)
    other = F.col("row_id") % 3 == 0
    error = F.when(F.col("row_id") % 10 == 0, "failed").when(F.col("row_id") % 10 == 1, "")
    return rows.select(
        "feed_url", "article_url", "fetched_at", "sentence", "target_text", "role", "embedded_entities", F.when(~other, F.col("sentiment")).alias("sentiment"), F.when(~other, F.col("sentiment_confidence")).alias("sentiment_confidence"),
        F.when(other, F.col("sentiment")).alias("predicted_sentiment_label"), F.when(other, F.col("sentiment_confidence")).alias("predicted_confidence"), error.alias("error"),
    )


def _written_facts(spark, sf_dir) -> str:
    path = f"{sinks.working_dir(spark)}/facts"
    sinks.write_jsonl(_facts(spark, sf_dir), path)
    return path


@query(f"WITH {_FACT_SQL} SELECT article_url, fetched_at, sentence, target_text, role, embedded, sentiment, round(sentiment_confidence, 6) AS sentiment_confidence, error FROM facts")
def facts_jsonl(spark, sf_dir):
    rows = readers.facts(spark, _written_facts(spark, sf_dir))
    return rows.select("article_url", "fetched_at", "sentence", "target_text", "role", F.array_join("embedded_entities", "|").alias("embedded"), "sentiment", F.round("sentiment_confidence", 6).alias("sentiment_confidence"), "error")


@query(f"WITH {_FACT_SQL} SELECT article_url, target_text, sentiment FROM facts WHERE coalesce(error, '') = '' AND sentiment IS NOT NULL")
def labelable_facts(spark, sf_dir):
    return readers.labelable(spark, _written_facts(spark, sf_dir)).select("article_url", "target_text", "sentiment")


def _gold(spark, sf_dir):
    m = A.mentions(spark, sf_dir)
    polarity = F.when(F.col("row_id") % 4 == 0, "unknown").otherwise(F.element_at(F.array(*map(F.lit, ("2.0", "4.0", "6.0"))), (F.col("row_id") % 3 + 1).cast("int")))
    return m.select(F.concat(F.lit("  "), "sentence").alias("sentence"), F.col("target_text").alias("target"), F.lit(0).alias("target_from"), F.length("target_text").alias("target_to"), polarity.alias("polarity"))


_GOLD_SQL = A.MENTIONS + ", gold AS (SELECT sentence, target_text AS target, CASE WHEN row_id % 4 = 0 THEN NULL ELSE ([2.0, 4.0, 6.0])[row_id % 3 + 1]::DOUBLE END AS polarity, length(target_text)::INTEGER AS target_to FROM mentions)"


@query(f"WITH {_GOLD_SQL} SELECT sentence, count(*) AS n, count(polarity) AS labelled, coalesce(sum(polarity), 0)::DOUBLE AS polarities, list_sort(list(DISTINCT target))[1] AS least, list_sort(list(DISTINCT target))[-1] AS most FROM gold GROUP BY sentence")
def gold_table(spark, sf_dir):
    """Gold targets by stripped sentence, from a CSV file; a polarity that is no number is null."""
    path = f"{sinks.working_dir(spark)}/gold"
    sinks.write_csv(_gold(spark, sf_dir), path)
    rows = readers.gold_csv(spark, path)
    polarity, target = F.transform("golds", lambda g: g["polarity"]), F.transform("golds", lambda g: g["target"])
    total = F.aggregate(F.array_compact(polarity), F.lit(0.0), lambda a, x: a + x)
    return rows.select("sentence", F.size("golds").cast("long").alias("n"), F.size(F.array_compact(polarity)).cast("long").alias("labelled"), total.alias("polarities"), F.array_min(target).alias("least"), F.array_max(target).alias("most"))


@query(r"WITH lines AS (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS sentence FROM documents) SELECT sentence, count(*) AS n FROM lines WHERE sentence <> '' GROUP BY sentence")
def sentence_lines(spark, sf_dir):
    """Every line of every document, through a text file."""
    path = f"{sinks.working_dir(spark)}/lines"
    A.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("text").write.text(path)
    return readers.sentence_lines(spark, path).groupBy("sentence").agg(F.count("*").alias("n"))


def _annotated(spark, sf_dir) -> str:
    m = A.mentions(spark, sf_dir)
    at = F.position("target_text", F.col("sentence")) - 1
    item = F.struct(F.col("target_text").alias("mention"), at.cast("int").alias("from"), (at + F.length("target_text")).cast("int").alias("to"), F.when(F.col("sentiment") == "Positive", 6.0).when(F.col("sentiment") == "Negative", 2.0).otherwise(4.0).alias("polarity"))
    gid = F.concat_ws("_", F.lit("src"), (F.col("row_id") % 97).cast("string"), F.lit("7"), (F.col("row_id") % 5).cast("string"), F.replace("target_text", F.lit(" "), F.lit("_")), at.cast("string"), (at + F.length("target_text")).cast("string"))
    path = f"{sinks.working_dir(spark)}/annotated"
    sinks.write_jsonl(m.select(gid.alias("primary_gid"), F.col("sentence").alias("sentence_normalized"), F.array(item).alias("targets")), path)
    return path


_FLAT_SQL = A.MENTIONS + ", flat AS (SELECT row_id, sentence, target_text AS target, (position(target_text IN sentence) - 1)::INTEGER AS target_from, (position(target_text IN sentence) - 1 + length(target_text))::INTEGER AS target_to, CASE sentiment WHEN 'Positive' THEN 6.0 WHEN 'Negative' THEN 2.0 ELSE 4.0 END::DOUBLE AS polarity FROM mentions)"


@query(f"WITH {_FLAT_SQL} SELECT sentence, target, target_from, target_to, polarity FROM flat")
def flat_targets(spark, sf_dir):
    return readers.flat_targets(spark, _annotated(spark, sf_dir))


@query(f"WITH {_FLAT_SQL} SELECT 'src_' || row_id % 97 || '_7' AS article_id, (row_id % 5)::INTEGER AS sentence_index, count(*) AS targets, count(DISTINCT target) AS names FROM flat GROUP BY 1, 2")
def annotated_articles(spark, sf_dir):
    """Annotated rows grouped to the sentences of their articles, from a file."""
    rows = readers.articles(spark, _annotated(spark, sf_dir))
    return rows.select("article_id", "sentence_index", F.size("targets").cast("long").alias("targets"), F.size(F.array_distinct(F.transform("targets", lambda t: t["mention"]))).cast("long").alias("names"))


_PROJECTIONS = (("sentence",), ("sentence", "target"), ("sentence", "target", "polarity"))


@query(f"WITH {_FLAT_SQL} " + " UNION ALL ".join(f"SELECT '{'+'.join(p)}' AS level, sum(n)::BIGINT AS rows, count(*) AS distinct_rows, (sum(n) - count(*))::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM flat GROUP BY {', '.join(p)})" for p in _PROJECTIONS))
def projection_duplicates(spark, sf_dir):
    """The three projections of annotated rows, and how many rows of each are copies."""
    flat = readers.flat_targets(spark, _annotated(spark, sf_dir))
    parts = [L.duplicate_counts(readers.projected(flat, list(p)), list(p)).select(F.lit("+".join(p)).alias("level"), "rows", "distinct_rows", "duplicates") for p in _PROJECTIONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_FLAT_SQL} SELECT sentence, target, target AS candidate, target_from AS candidate_start, target_to AS candidate_end, (['NA', 'None', 'NER', 'null'])[row_id % 4 + 1] AS source, CASE WHEN row_id % 2 = 0 THEN 'ORG' END AS ner_label, (row_id % 2)::INTEGER AS label FROM flat")
def candidates_table(spark, sf_dir):
    """Candidate rows through a CSV file: words that mean null elsewhere stay words, empty fields are null."""
    m = A.mentions(spark, sf_dir)
    at = F.position("target_text", F.col("sentence")) - 1
    source = F.element_at(F.array(*map(F.lit, ("NA", "None", "NER", "null"))), (F.col("row_id") % 4 + 1).cast("int"))
    rows = m.select("sentence", F.col("target_text").alias("target"), F.col("target_text").alias("candidate"), at.cast("int").alias("candidate_start"), (at + F.length("target_text")).cast("int").alias("candidate_end"), source.alias("source"), F.when(F.col("row_id") % 2 == 0, "ORG").alias("ner_label"), (F.col("row_id") % 2).cast("int").alias("label"))
    path = f"{sinks.working_dir(spark)}/candidates"
    sinks.write_csv(rows, path)
    return readers.candidates_csv(spark, path)


@query("SELECT doc_id::VARCHAR AS record_id, CASE WHEN toxic = 1 THEN 'Negative' WHEN quality = 1 THEN 'Positive' END AS gold_label, CASE WHEN quality = 1 THEN 'Positive' ELSE 'Neutral' END AS predicted_label FROM labels")
def labels_with_key(spark, sf_dir):
    """Hand labels by their aliases, joined to the key of the same records."""
    labels = A.table(spark, sf_dir, "labels").withColumn("record_id", F.col("doc_id").cast("string"))
    hand = labels.select("record_id", F.when(F.col("toxic") == 1, " NEG ").when(F.col("quality") == 1, "pos").otherwise("").alias("gold_label"))
    return readers.labels_with_key(hand, labels.select("record_id", F.when(F.col("quality") == 1, "Positive").otherwise("Neutral").alias("predicted_label")))


@query(f"WITH {A.MENTIONS} SELECT target_text || chr(9) || sentence AS value, count(*) AS n FROM mentions GROUP BY 1")
def not_found_tsv(spark, sf_dir):
    path = f"{sinks.working_dir(spark)}/tsv"
    sinks.write_tsv(A.mentions(spark, sf_dir), ["target_text", "sentence"], path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@query(f"WITH {A.GOLD} SELECT count(*) AS n, sum((gold = predicted)::BIGINT)::BIGINT AS correct, round(avg((gold = predicted)::INTEGER), 6) AS accuracy FROM gold")
def metrics_document(spark, sf_dir):
    """A report as a JSON document, read again."""
    said = json.loads(sinks.metrics_document(EV.accuracy(A.gold(spark, sf_dir))))
    return spark.createDataFrame([(said["n"], said["correct"], said["accuracy"])], "n long, correct long, accuracy double")


@query(f"WITH {A.MENTIONS} SELECT row_id, '[' || array_to_string(list_transform(embedded_entities, lambda x: '\"' || x || '\"'), ',') || ']' AS cell, '{{\"role\":\"' || role || '\",\"text\":\"' || target_text || '\"}}' AS object FROM mentions")
def compact_cells(spark, sf_dir):
    """Nested values as compact JSON in a CSV cell, read again."""
    rows = A.mentions(spark, sf_dir).select("row_id", F.col("embedded_entities").alias("cell"), F.struct("role", F.col("target_text").alias("text")).alias("object"))
    path = f"{sinks.working_dir(spark)}/cells"
    sinks.write_csv(rows, path)
    return spark.read.schema("row_id long, cell string, object string").option("header", True).option("escape", '"').csv(path)


@query(f"WITH {A.MENTIONS} SELECT substr(fetched_at, 1, 10) AS day, role, count(*) AS n FROM mentions GROUP BY 1, 2")
def stream_ingest(spark, sf_dir):
    """Facts land as files twice and are taken as a stream; articles seen in the first batch do not come again."""
    from ..streaming import ingest as I

    base = sinks.working_dir(spark)
    rows = A.mentions(spark, sf_dir)
    for turn in ("first", "again"):
        rows.drop("row_id").write.mode("append").json(f"{base}/landing")
        run = I.ingest(I.landing(spark, f"{base}/landing", 10**6), f"{base}/out", f"{base}/checkpoint")
        run.awaitTermination()
    facts = spark.read.parquet(f"{base}/out/facts")
    return facts.groupBy(F.date_format("fetched_date", "yyyy-MM-dd").alias("day"), "role").agg(F.count("*").alias("n"))


@query(f"WITH {A.MENTIONS} SELECT substr(fetched_at, 1, 10) AS day, 2 * count(*) AS n FROM mentions GROUP BY 1")
def appended_facts(spark, sf_dir):
    """Facts appended twice to a table by day."""
    path = f"{sinks.working_dir(spark)}/appended"
    rows = A.mentions(spark, sf_dir).withColumn("fetched_date", F.substring("fetched_at", 1, 10))
    sinks.append_facts(rows, path)
    sinks.append_facts(rows, path)
    return spark.read.parquet(path).groupBy(F.date_format("fetched_date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query(f"WITH {_FLAT_SQL} SELECT row_id, CASE WHEN target_from >= 0 THEN substr(sentence, 1, target_from) || '[TARGET] ' || target || ' [/TARGET]' || substr(sentence, target_to + 1) END AS marked, sentence || ' [TARGET] ' || target AS baseline FROM flat")
def training_mark(spark, sf_dir):
    rows = A.mentions(spark, sf_dir)
    at = (F.position("target_text", F.col("sentence")) - 1).cast("int")
    s, t = F.col("sentence"), F.col("target_text")
    return rows.select("row_id", F.when(at >= 0, M.training_mark(s, t, at, at + F.length(t))).alias("marked"), M.baseline_text(s, t).alias("baseline"))


_ENTRIES = 5


@query("WITH hosts AS (SELECT DISTINCT 'https://' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS feed_url FROM pages) SELECT feed_url, feed_url || '/' || unnest([1, 2, 3]) AS article_url FROM hosts")
def feed_scan(spark, sf_dir):
    """A feed a host, made by the fetcher: five entries with a link after one without; the first three count."""
    from ..functions import text as T
    from ..sources import feeds

    hosts = A.table(spark, sf_dir, "pages").select(F.concat(F.lit("https://"), T.netloc("url")).alias("feed_url")).distinct()
    entry = lambda url: "<rss><item><title>none</title></item>" + "".join(f"<item><title>t</title><link>{url}/{k}</link></item>" for k in range(1, _ENTRIES + 1)) + "</rss>"
    return feeds.feed_urls(hosts, entry, 3)


@query(rf"""WITH {A.MENTIONS}, said AS (SELECT row_id, target_text || CASE row_id % 3 WHEN 0 THEN ' ''s  plan ' WHEN 1 THEN ' ''S' ELSE '   of  May' END AS m FROM mentions)
SELECT row_id, trim(regexp_replace(regexp_replace(m, '\s+''\s*[sS]\b', '''s', 'g'), '\s+', ' ', 'g')) AS mention FROM said""")
def normalised_mentions(spark, sf_dir):
    from ..functions import text as T

    tail = F.element_at(F.array(F.lit(" 's  plan "), F.lit(" 'S"), F.lit("   of  May")), (F.col("row_id") % 3 + 1).cast("int"))
    return A.mentions(spark, sf_dir).select("row_id", T.normalise_mention(F.concat("target_text", tail)).alias("mention"))
