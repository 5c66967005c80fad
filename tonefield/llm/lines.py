"""Operator 3: line deduplication over a suffix array of line sequences, by distributed prefix doubling.

A line's id is the rank of its text's hash. Doubling ranks the suffixes by their first 2^k lines, from the ranks of both halves;
only those that share them with another go on, so the tables shrink. Suffixes of equal rank are an interval of the suffix array whose
common prefix is 2^k lines at least. Going down through the powers again finds the longest-common-prefix intervals between the powers, and for every
place the deepest one that has an earlier suffix: the longest run that also starts earlier. A run of at least `min_words` words is deleted with all
its lines; the earliest copy stays, so one copy of every run is kept.

Lines are what newlines separate, without outer white space; blank lines count for nothing and stay where they are. Each
round is written to the shared folder; hot lines are reduced by map-side minima before anything is joined.

Empty cases: null text is empty and has no lines. A null id sorts first and is returned as null. Rows of one id with different texts are documents
of their own, in the order of their hashes; the same row twice does not repeat itself. Lines and texts of any length are taken whole; an empty table
gives no rows. Ids are whole numbers. Of equal runs the one of the smallest (id, place) stays. Other columns of the input never meet the operator's
names, since it takes only the two it is told.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exchange

#: Every repeated run goes; a higher number keeps the short ones.
MIN_WORDS = 1


def lines_of(text: bytes) -> list[tuple[int, bytes]]:
    """(number among all lines, stripped line) of those that are not blank."""
    return [(k, line) for k, line in enumerate(map(bytes.strip, text.split(b"\n"))) if line]


def line_ids(lines: list[tuple[int, bytes]]) -> np.ndarray:
    """(n, 2) uint64."""
    import hashlib

    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for _, x in lines), np.uint64).reshape(-1, 2)


def _all_ids(docs) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents' lines in order, and how many each document has."""
    lines = [lines_of(t) for t in docs.texts]
    return line_ids([x for own in lines for x in own]), np.array([len(x) for x in lines], np.int64)


def _values(docs):
    return np.unique(_all_ids(docs)[0][:, 0], return_counts=True)


def _places(chunk, docs, answers):
    """A row for each line that may occur again. left: how many such lines stand together from here on."""
    import pandas as pd

    ids, counts = _all_ids(docs)
    if not len(ids):
        return
    _, which = np.unique(ids[:, 0], return_inverse=True)
    again = exchange.levels_of(answers)[which] > 0
    n, ends = len(ids), np.cumsum(counts)
    d = np.repeat(np.arange(len(counts)), counts)
    other = np.minimum.accumulate(np.where(again, n, np.arange(n))[::-1])[::-1]
    left = np.minimum(other, ends[d]) - np.arange(n)
    k = np.flatnonzero(again)
    d = d[k]
    yield pd.DataFrame({"chunk": chunk, "d": d, "doc_id": docs.ids[d], "h": docs.hashes[d], "line": k - (ends - counts)[d], "v1": ids[k, 0].view(np.int64), "v2": ids[k, 1].view(np.int64), "left": left[k]})


PLACES = "chunk string, d int, doc_id long, h long, line long, v1 long, v2 long, left long"


def _numbered(batches):
    import pandas as pd
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for pdf in batches:
        gap = pdf["gap"].to_numpy().astype(np.int64)
        nth = n + np.arange(len(pdf)) + np.cumsum(gap) - gap
        yield pdf.assign(part=part, nth=nth)
        n += len(pdf) + int(gap.sum())


def numbered(rows: DataFrame, order: list[str], name: str, gap: str = "false") -> DataFrame:
    """rows with name: their number in the order of these columns, from 0, with a number left out after each row where gap holds. Tasks of a
    range-partitioned sort count their own rows; what stands before a task is added up over a row a task."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    own = common.materialize(rows.withColumn("gap", F.expr(gap)).orderBy(*order).mapInPandas(_numbered, f"{kinds}, gap boolean, part int, nth long"))
    sizes = {r["part"]: r["n"] for r in own.groupBy("part").agg((F.max(F.col("nth") + F.col("gap").cast("long")) + 1).alias("n")).collect()}  # a row a task
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    offsets = rows.sparkSession.createDataFrame(before, "part int, before long")
    return common.materialize(own.join(offsets, "part").select(*rows.columns, (F.col("before") + F.col("nth")).alias(name)))


def in_order(places: DataFrame) -> DataFrame:
    """places with pos: their number by (doc_id, h, line), with one left out after each stretch of such lines, so
    that no window runs beyond its stretch. The same document twice shares its numbers."""
    own = places.groupBy("doc_id", "h", "line").agg(F.first("v1").alias("v1"), F.first("v2").alias("v2"), F.first("left").alias("left"))
    return numbered(own, ["doc_id", "h", "line"], "pos", "left = 1")


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (pos, left, keys): those whose keys occur again, with r = the rank of their keys among these, and first = the earliest pos of theirs."""
    rows = common.materialize(rows)
    again = rows.groupBy(*keys).agg(F.min("pos").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    return common.materialize(rows.join(numbered(again, keys, "rank"), keys).select("pos", "left", F.col("rank").alias("r"), "first"))


def doubled(ordered: DataFrame) -> list[DataFrame]:
    """Level k: (pos, left, r, first) of the windows of 2^k lines that occur more than once: the suffixes' ranks by their first 2^k lines. Those of
    equal rank are neighbours in the suffix array, an interval whose common prefix is 2^k lines at least; first is the interval's earliest suffix."""
    now = ranked(ordered.select("pos", "left", "v1", "v2"), ["v1", "v2"])
    out = []
    while not now.isEmpty():
        out.append(now)
        span = 1 << (len(out) - 1)
        second = now.select((F.col("pos") - span).alias("pos"), F.col("r").alias("r2"))
        now = ranked(now.where(F.col("left") >= 2 * span).join(second, "pos").select("pos", "left", "r", "r2"), ["r", "r2"])
    return out


def longest(levels: list[DataFrame]) -> DataFrame:
    """(pos, off): the longest run from pos that also starts earlier, the deepest interval around pos that has an earlier suffix.

    A suffix begins in the deepest interval of a power of two that has an earlier suffix, and then enters narrower ones as the powers go down. The earliest member of
    an interval stays behind as its witness (ghost), so later members still find it.
    """
    found = None
    for k, t in enumerate(levels):
        later = t.where("pos > first").select("pos", F.lit(k).alias("k"), "first")
        found = later if found is None else found.unionAll(later)
    best = common.materialize(found.groupBy("pos").agg(F.max(F.struct("k", "first")).alias("b")).select("pos", "b.k", "b.first"))
    off = F.expr("shiftleft(1L, k)")
    single = best.where("k = 0").select("pos", F.lit(1).cast("long").alias("off"))
    longer = best.where("k > 0")
    ghosts = longer.select(F.col("first").alias("pos"), off.alias("off"), F.col("first").alias("interval")).distinct().withColumn("ghost", F.lit(True))
    state = longer.select("pos", off.alias("off"), F.col("first").alias("interval"), F.lit(False).alias("ghost")).unionAll(ghosts)
    for j in range(len(levels) - 2, -1, -1):
        ranks = levels[j].select(F.col("pos").alias("to"), "r")
        active = state.withColumn("to", F.when(F.col("off") >= (2 << j), F.col("pos") + F.col("off")).otherwise(-1 - F.col("pos")))
        state = common.materialize(active.join(ranks, "to", "left").select("pos", "off", "interval", "ghost", "r"))
        inner = common.materialize(state.where("r IS NOT NULL").groupBy("interval", "off", "r").agg(F.min("pos").alias("m"), F.count("*").alias("c")).where("c > 1").drop("c"))
        met = state.join(inner, ["interval", "off", "r"], "left")
        go = F.coalesce((F.col("pos") > F.col("m")) & ~F.col("ghost"), F.lit(False))
        state = met.select("pos", F.when(go, F.col("off") + (1 << j)).otherwise(F.col("off")).alias("off"), F.when(go, F.col("m")).otherwise(F.col("interval")).alias("interval"), "ghost")
        if j:
            state = state.unionAll(inner.select(F.col("m").alias("pos"), (F.col("off") + (1 << j)).alias("off"), F.col("m").alias("interval"), F.lit(True).alias("ghost")))
    return common.materialize(state.where("NOT ghost").select("pos", "off").unionAll(single))


def _blobs(batches):
    import pandas as pd

    for pdf in batches:
        rows = [(chunk, 0, pickle.dumps((own["d"].to_numpy(np.int32).tobytes(), own["line"].to_numpy(np.int64).tobytes(), own["off"].to_numpy(np.int64).tobytes()))) for chunk, own in pdf.groupby("chunk")]
        if rows:
            yield pd.DataFrame(rows, columns=["chunk", "part", "data"])


RESULT = "doc_id long, no_id boolean, h long, n_lines long, n_removed long, n_runs long, text string"


def _finished(min_words: int):
    def then(_, docs, answers):
        import pandas as pd

        runs: dict[int, list[tuple[int, int]]] = {}
        for _, data in answers:
            d, line, off = (np.frombuffer(x, kind) for x, kind in zip(pickle.loads(data), (np.int32, np.int64, np.int64), strict=True))
            for a, b, c in zip(d.tolist(), line.tolist(), off.tolist(), strict=True):
                runs.setdefault(a, []).append((b, c))
        rows = []
        for d, (i, no, h, text) in enumerate(docs.rows()):
            own = lines_of(text)
            if d not in runs:
                rows.append((i, no, h, len(own), 0, 0, text.decode("utf-8", "surrogatepass")))
                continue
            words = np.cumsum([0] + [len(x.split()) for _, x in own])
            gone = np.zeros(len(own) + 1, np.int64)
            for start, n in set(runs.get(d, ())):
                if words[start + n] - words[start] >= min_words:
                    gone[start] += 1
                    gone[start + n] -= 1
            lost = np.cumsum(gone)[:-1] > 0
            kept = text
            if lost.any():
                out = {own[k][0] for k in np.flatnonzero(lost)}
                kept = b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in out)
            rows.append((i, no, h, len(own), int(lost.sum()), int((np.diff(lost.astype(int), prepend=0) > 0).sum()), kept.decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return then


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, h, n_lines, n_removed, n_runs, text: what is kept), a row for each row of docs."""
    keyed = common.with_key(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))
    with common.scratch(docs.sparkSession):
        table = exchange.chunks(keyed)
        places = exchange.answered(table, exchange.count(table, _values), _places, PLACES)
        ordered = in_order(places)
        levels = doubled(ordered)
        answers = docs.sparkSession.createDataFrame([], "chunk string, part int, data binary")
        if levels:
            found = ordered.join(longest(levels), "pos").select("doc_id", "h", "line", "off")
            runs = places.join(found, ["doc_id", "h", "line"]).select("chunk", "d", "line", "off").repartition("chunk").sortWithinPartitions("chunk")
            answers = common.materialize(runs.mapInPandas(_blobs, "chunk string, part int, data binary"))
        out = exchange.answered(table, answers, _finished(min_words), RESULT, keep=True)
    return exchange.with_nulls(out).withColumnRenamed("doc_id", id_column)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, how many lines, how many of them and in how many runs went, and a digest of what is kept."""
    return dedup(common.table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))
