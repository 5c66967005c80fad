"""Writers: facts, datasets, tables, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def working_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; it goes when the application ends. Without that setting a local
    session gets one below /tmp, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/tonefield-work"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/files-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def written(df: DataFrame) -> DataFrame:
    """df from a working table, written once."""
    path = f"{working_dir(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_facts(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("fetched_date").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns as compact JSON in their cell."""
    flat = [compact(F.col(n)).alias(n) if t.startswith(("array", "struct", "map")) else F.col(n) for n, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def compact(c: Column) -> Column:
    return F.to_json(c)


def write_tsv(df: DataFrame, columns: list[str], path: str) -> None:
    df.select(F.concat_ws("\t", *columns).alias("value")).write.mode("overwrite").text(path)


def metrics_document(df: DataFrame) -> str:
    """A one-row report as JSON."""
    row = df.first()
    return json.dumps(row.asDict(recursive=True) if row else {}, sort_keys=True, default=str)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
