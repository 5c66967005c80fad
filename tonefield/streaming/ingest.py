"""Facts as a stream: a landing folder in, Parquet by day out, each article once, trends by event time.

A batch writes its facts and the URLs it has seen under its own batch id, so a batch that runs again after a failure replaces what it
wrote before: exactly once, where marking URLs after writing would repeat an article.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.entities import label_counts, with_entities
from ..sources.readers import FACT


def landing(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(FACT).option("maxFilesPerTrigger", files_per_batch).json(path)


def with_time(facts: DataFrame) -> DataFrame:
    return facts.withColumn("event_time", F.expr("try_to_timestamp(fetched_at)"))


def once(facts: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row a fact, within the watermark."""
    return with_time(facts).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["article_url", "sentence", "target_text"])


#: Parts of the table of seen URLs; a batch reads those that its own URLs fall in.
SEEN_PARTS = 256
SEEN = "url string, batch_id long, part int"


def seen_part(url: str) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(SEEN_PARTS)).cast("int")


def unseen(batch: DataFrame, seen: DataFrame) -> DataFrame:
    return batch.join(seen.select(F.col("url").alias("article_url")), "article_url", "left_anti")


def ingest(facts: DataFrame, out: str, checkpoint: str, force: bool = False) -> StreamingQuery:
    """Appends facts of articles not seen in earlier batches; force takes them again, and still notes their URLs."""
    spark = facts.sparkSession
    spark.createDataFrame([], "url string").write.mode("ignore").parquet(f"{out}/seen/batch_id=-1/part=0")  # so that the table is there

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("fetched_date", T.day("fetched_at"))
        if not force:
            parts = [r[0] for r in batch.select(seen_part("article_url")).distinct().collect()]  # at most SEEN_PARTS numbers
            seen = batch.sparkSession.read.schema(SEEN).parquet(f"{out}/seen").where((F.col("batch_id") < batch_id) & F.col("part").isin(parts))
            rows = unseen(rows, seen)
        rows.write.mode("overwrite").partitionBy("fetched_date").parquet(f"{out}/facts/batch_id={batch_id}")
        urls = rows.select(F.col("article_url").alias("url")).distinct().withColumn("part", seen_part("url"))
        urls.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{out}/seen/batch_id={batch_id}")

    return facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_trend(facts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts by entity and day window. Alias merging re-routes history, so it is applied to these counts when they are read."""
    rows = with_entities(with_time(facts)).where("key IS NOT NULL AND sentiment IS NOT NULL").withWatermark("event_time", delay)
    return rows.groupBy(F.window("event_time", "1 day").alias("w"), "key").agg(*label_counts()).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "key", "negative", "neutral", "positive", "total")
