"""Operator 5: exact top-k search, term at a time.

Queries and candidates are dealt onto a grid of cells: a query's row of cells, a candidate's column of cells, so that every pair meets in one cell.
A cell holds its queries (at most some QUERY_CELL) and reads its candidates in groups: each query row's nonzero terms scatter their
weighted postings (the group's candidates with that term) into a dense array of scores, a partition selects the k highest, and they are
merged with the query's best so far. Cells give k rows a query, which a window merges. What is shuffled is candidates times rows of the
grid and queries times its columns; small tables still spread over all partitions.

Scores are computed as exact whole numbers of any size; one beyond 64 bits counts as the largest (least) long but one of that sign.

Empty cases: vectors that are null, or hold null or non-finite components, take no part; an empty vector has no terms and scores
0 with all. Vectors of different length meet on their common terms, of any length. Repeated ids are candidates each; a query never meets rows of its
own id; rows with a null id take no part. Equal scores: the smaller id first. An empty table gives no rows. Other columns never meet the operator's names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Queries a cell holds, candidates of a shuffled block, candidates scored at once.
QUERY_CELL, BLOCK, GROUP = 16_384, 512, 4_096


def sound(vector: str) -> str:
    """SQL condition: there is a vector, and all its components are numbers."""
    return f"{vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"


def rows_of(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    return rows.where(f"id IS NOT NULL AND {sound('v')}")


def _blocks(scale: int):
    """Rows -> blocks: ids and weights floor(scale * v), padded to the longest, as bytes."""

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for pdf in batches:
            for k in range(0, len(pdf), BLOCK):
                own = pdf.iloc[k : k + BLOCK]
                v = np.zeros((len(own), max(map(len, own["v"]))))
                for j, r in enumerate(own["v"]):
                    v[j, : len(r)] = r
                with np.errstate(over="ignore"):
                    w = np.nan_to_num(np.floor(scale * v))  # beyond a double: the largest one
                yield pd.DataFrame({"no": [part + 1_000_003 * made], "ids": [own["id"].to_numpy(np.int64).tobytes()], "w": [w.tobytes()]})
                made += 1

    return run


BLOCK_SCHEMA = "no long, ids binary, w binary"


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, in order."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bar)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _stacked(blocks: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks as one array of ids and one of weights."""
    ids = [np.frombuffer(i, np.int64) for i, _ in blocks]
    own = [np.frombuffer(w, np.float64).reshape(len(i), -1) for i, (_, w) in zip(ids, blocks, strict=True)]
    out = np.zeros((sum(map(len, ids)), max(w.shape[1] for w in own)))
    at = 0
    for w in own:
        out[at : at + len(w), : w.shape[1]] = w
        at += len(w)
    return np.concatenate(ids), out


def scored(q_ids, q, c_ids, c, k: int):
    """For each query its k best of these candidates: (scores, ids), as whole numbers."""
    terms = min(q.shape[1], c.shape[1])
    q, c = q[:, :terms], c[:, :terms]
    wide = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(terms, 1) >= 2.0**62
    kind = object if wide else np.int64
    q, c = ((np.frompyfunc(int, 1, 1)(x) if wide else x).astype(kind) for x in (q, c))
    postings = []
    for t in range(terms):
        at = np.flatnonzero(c[:, t])
        postings.append((slice(None) if len(at) == len(c_ids) else at, np.ascontiguousarray(c[at, t])))
    for i, row in zip(q_ids, q, strict=True):
        scores = np.zeros(len(c_ids), kind)
        for t in np.flatnonzero(row):
            at, weights = postings[t]
            scores[at] += row[t] * weights
        if wide:
            scores = np.clip(scores, 1 - 2**63, 2**63 - 1).astype(np.int64)
        other = np.flatnonzero(c_ids != i)
        at = other[best(scores[other], c_ids[other], k)]
        yield scores[at], c_ids[at]


def _search(k: int):
    def run(batches):
        import pandas as pd

        cell, queries, candidates, size, top = None, [], [], 0, None
        q_ids = q = None

        def score():
            nonlocal q_ids, q, top, candidates, size
            if queries and top is None:
                q_ids, q = _stacked(queries)
                top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids)
            if queries and candidates:
                c_ids, c = _stacked(candidates)
                for j, (s, i) in enumerate(scored(q_ids, q, c_ids, c, k)):
                    s, i = np.concatenate([top[j][0], s]), np.concatenate([top[j][1], i])
                    at = best(s, i, k)
                    top[j] = s[at], i[at]
            candidates, size = [], 0

        def found():
            score()
            if top is not None:
                yield pd.DataFrame({"query_id": np.repeat(q_ids, [len(s) for s, _ in top]), "vec_id": np.concatenate([i for _, i in top]), "score": np.concatenate([s for s, _ in top])})

        for pdf in batches:
            for c, is_query, ids, w in zip(pdf["cell"].tolist(), pdf["is_query"].tolist(), pdf["ids"], pdf["w"], strict=True):
                if c != cell:
                    yield from found()
                    cell, queries, candidates, size, top = c, [], [], 0, None
                if is_query:
                    queries.append((ids, w))
                    continue
                if not queries:
                    continue
                candidates.append((ids, w))
                size += len(ids) // 8
                if size >= GROUP:
                    score()
        yield from found()

    return run


def grid(queries: int, candidates: int, cells: int) -> tuple[int, int]:
    """Rows (queries are dealt to them) and columns (candidates) of the grid, for about `cells` cells or as many as the queries need."""
    rows = max(1, -(-queries // QUERY_CELL))
    return rows, max(1, min(-(-cells // rows), -(-candidates // BLOCK)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score)."""
    cells = 2 * max(common.width(vectors.sparkSession), vectors.sparkSession.sparkContext.defaultParallelism)
    rows, columns = grid(queries.count(), vectors.count(), cells)
    q = rows_of(queries, id_column, vector_column).mapInPandas(_blocks(scale), BLOCK_SCHEMA)
    c = rows_of(vectors, id_column, vector_column).mapInPandas(_blocks(scale), BLOCK_SCHEMA)
    place = F.xxhash64("no")
    q = q.select(F.pmod(place, F.lit(rows)).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"), F.lit(True).alias("is_query"), "ids", "w")
    c = c.select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"), F.pmod(F.col("no") % 1_000_003 + F.floor(F.col("no") / 1_000_003), F.lit(columns)).alias("column"), F.lit(False).alias("is_query"), "ids", "w")
    dealt = q.unionByName(c).select((F.col("row") * columns + F.col("column")).cast("int").alias("cell"), "is_query", "ids", "w")
    dealt = dealt.repartitionById(rows * columns, "cell").sortWithinPartitions("cell", F.desc("is_query"))
    found = dealt.mapInPandas(common.trimmed(_search(k)), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
