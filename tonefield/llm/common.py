"""What several operators share: working tables in the shared folder, row identity, connected components."""

from __future__ import annotations

import contextlib
import threading
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. It is deleted when the application ends, if not before.

    Where that setting is missing, a folder below /tmp is taken on one machine (a local master); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/tonefield-work"
    path = f"{base.rstrip('/')}/tonefield-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(there)
    files.deleteOnExit(there)
    return path


class _Tables(threading.local):
    """Working tables of this thread: those of each open scratch, and those that results still read."""

    def __init__(self):
        self.scratch: list[list[str]] = []
        self.kept: list[str] = []


_tables = _Tables()


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Writes df once to the shared folder and returns a reader of it: the lineage ends there,
    so a lost executor costs no more than the tasks it ran. Inside `scratch` the table goes at its end, unless kept."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table"
    df.write.parquet(path)
    if keep or not _tables.scratch:
        _tables.kept.append(path)
    else:
        _tables.scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Working tables written inside are deleted at the end. What is returned must have been written with keep=True."""
    _tables.scratch.append([])
    try:
        yield
    finally:
        for path in _tables.scratch.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path.removesuffix("/table"))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def kept_since(mark: int) -> list[str]:
    return _tables.kept[mark:]


def kept() -> int:
    return len(_tables.kept)


def release(paths: list[str], docs: DataFrame) -> None:
    """Deletes tables whose results have been written elsewhere, unless docs still reads one of them."""
    if paths and not any(f"/{path.split('/')[-2]}/" in f for f in docs.inputFiles() for path in paths):
        for path in paths:
            _delete(docs.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(run):
    """A task's function that hands its freed memory back at the end: workers live on and share an executor's limit."""

    def kept(batches):
        yield from run(batches)
        import ctypes

        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another C library
            pass

    return kept


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), text. Rows that agree in doc_id and text are one document that stands in
    the table more than once; (doc_id, h) tells all others apart, also where doc_id is null or not unique."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"),
        F.col("text").cast("string").alias("text"),
    )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) over any integers -> (node, smallest node of its component) within these edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            up = new[new]
            if np.array_equal(up, new):
                break
            new = up
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _local_stars(batches):
    """Each task folds the edges it holds into stars, so that at most one edge a node leaves it."""
    import pandas as pd

    held_a, held_b, n = [], [], 0

    def folded():
        v, m = forest(np.concatenate(held_a), np.concatenate(held_b))
        return v[v != m], m[v != m]

    for pdf in batches:
        if len(pdf):
            held_a.append(pdf["a"].to_numpy())
            held_b.append(pdf["b"].to_numpy())
            n += len(pdf)
            if n > 500_000:
                v, m = folded()
                held_a, held_b, n = [v], [m], 0
    if held_a:
        v, m = folded()
        yield pd.DataFrame({"a": v, "b": m})


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) longs -> (a, b): every node of an edge but the smallest of its component, with that smallest one.

    Alternating large-star and small-star steps over a table that is never larger than the edges;
    each round is written to the shared folder. Hot nodes are reduced by map-side minima, the joins
    back are plain inner joins which adaptive execution may split.
    """
    now = materialize(edges.select("a", "b").where("a <> b").mapInPandas(trimmed(_local_stars), "a long, b long"))
    before = None
    for _ in range(rounds):
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written first, so that both sides of the joins below are plain exchanges, which can be split where a node is hot
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        large = materialize(large)
        small_low = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = (
            large.join(small_low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        now = materialize(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if state[0] == state[2] and tuple(state) == before:
            return now
        before = tuple(state)
    raise RuntimeError("components did not settle")
