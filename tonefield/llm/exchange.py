"""How often values occur in the whole corpus, told to every piece of it that holds them.

Documents are packed into chunks, which are the rows of a working table. `count` sends each chunk's values (64-bit hashes,
each once a chunk, with its number there) to the partition that their leading bits name, as one sorted block of four bytes a value;
that partition adds up and answers with one byte a value. `answered` brings the answers back to their chunks.
So a value costs five bytes on the way, blocks are dealt evenly whatever repeats, and nothing is collected or broadcast.
"""

from __future__ import annotations

import contextlib
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK_BYTES = 4 << 20
CHUNK = "chunk string, n int, docs binary"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Rows here are blocks of megabytes, so fewer go into an Arrow batch."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {x: spark.conf.get(x) for x in names}
    for x in names:
        spark.conf.set(x, str(rows))
    try:
        yield
    finally:
        for x in names:
            spark.conf.set(x, before[x])


#: Stands for a null id where only its order counts.
LOWEST = -(2**63)


@dataclass
class Docs:
    ids: np.ndarray  # int64; LOWEST where there is none
    hashes: np.ndarray  # int64, of the texts
    texts: list[bytes]
    no_id: np.ndarray  # bool

    def pack(self) -> bytes:
        import zstandard

        blob = pickle.dumps((self.ids.tobytes(), self.hashes.tobytes(), self.no_id.tobytes(), [len(t) for t in self.texts], b"".join(self.texts)))
        return zstandard.ZstdCompressor(level=3).compress(blob)

    @staticmethod
    def unpack(blob: bytes) -> Docs:
        import zstandard

        ids, hashes, no_id, lengths, text = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        ends = np.cumsum([0, *lengths])
        texts = [text[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return Docs(np.frombuffer(ids, np.int64), np.frombuffer(hashes, np.int64), texts, np.frombuffer(no_id, bool))

    def rows(self):
        """(id, whether there is none, hash, text) of each."""
        return zip(self.ids.tolist(), self.no_id.tolist(), self.hashes.tolist(), self.texts, strict=True)


def chunks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, h, text) -> the table of chunks, written once. A null text is empty."""

    def run(batches):
        import uuid

        import pandas as pd

        own, made = uuid.uuid4().hex, 0
        ids, hashes, texts, none, size = [], [], [], [], 0

        def packed():
            d = Docs(np.array(ids, np.int64), np.array(hashes, np.int64), texts, np.array(none, bool))
            return pd.DataFrame({"chunk": [f"{own}-{made}"], "n": [len(ids)], "docs": [d.pack()]})

        for pdf in batches:
            for i, h, t, no in zip(pdf["doc_id"].tolist(), pdf["h"].tolist(), pdf["text"], pdf["no_id"].tolist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                if ids and size + len(raw) > CHUNK_BYTES:
                    yield packed()
                    ids, hashes, texts, none, size, made = [], [], [], [], 0, made + 1
                ids.append(i), hashes.append(h), texts.append(raw), none.append(no)
                size += len(raw)
        if ids:
            yield packed()

    rows = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"), "h", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNull().alias("no_id"))
    with small_batches(docs.sparkSession, 1000):
        return common.materialize(rows.mapInPandas(common.trimmed(run), CHUNK))


def with_nulls(rows: DataFrame) -> DataFrame:
    """rows (doc_id, no_id, ...) with null ids again, without no_id."""
    return rows.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def parts_for(spark: SparkSession) -> int:
    """How many parts values are cut into by their leading bits: a power of two, four a partition or more."""
    return 1 << max(6, (4 * common.width(spark) - 1).bit_length())


def cut(values: np.ndarray, bits: int) -> np.ndarray:
    """Where each part's run of the sorted values ends."""
    return np.searchsorted(values >> np.uint64(64 - bits), np.arange(1, 1 << bits, dtype=np.uint64))


def level(total: np.ndarray) -> np.ndarray:
    """A count as a byte: 0 for one, then rising with its logarithm (four steps a doubling)."""
    return np.minimum(255, np.ceil(4 * np.log2(np.maximum(total, 1)))).astype(np.uint8)


def count(table: DataFrame, values: Callable[[Docs], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """values(docs) -> sorted distinct uint64 values and how often each counts in this chunk.

    (chunk, part, data): for each part of the chunk's sorted values, in order, the level of the value's total count.
    Values are compared by 32 bits beyond their part's; two different values that agree there are counted together.
    """
    spark = table.sparkSession
    bits = parts_for(spark).bit_length() - 1

    def send(batches):
        import pandas as pd

        for pdf in batches:
            for chunk, blob in zip(pdf["chunk"], pdf["docs"], strict=True):
                v, times = values(Docs.unpack(blob))
                low = ((v << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                at = cut(v, bits)
                rows = []
                for p, (a, b) in enumerate(zip(np.split(low, at), np.split(times, at), strict=True)):
                    if len(a):
                        more = np.flatnonzero(b > 1).astype(np.uint32)
                        rows.append((p, chunk, a.tobytes(), more.tobytes(), b[more].astype(np.uint32).tobytes()))
                yield pd.DataFrame(rows, columns=["part", "chunk", "low", "at", "times"])

    def add(batches):
        import pandas as pd

        held: dict[int, list] = {}
        for pdf in batches:
            for r in pdf.itertuples():
                held.setdefault(r.part, []).append((r.chunk, r.low, r.at, r.times))
        for part in list(held):
            rows = held.pop(part)
            low = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows])
            times = np.ones(len(low), np.uint32)
            ends = np.cumsum([0] + [len(r[1]) // 4 for r in rows])
            for e, r in zip(ends, rows, strict=False):
                times[e + np.frombuffer(r[2], np.uint32).astype(np.int64)] = np.frombuffer(r[3], np.uint32)
            order = np.argsort(low, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], low[order][1:] != low[order][:-1]]))
            total = np.add.reduceat(times[order].astype(np.int64), first)
            out = np.empty(len(low), np.uint8)
            out[order] = np.repeat(level(total), np.diff(np.append(first, len(low))))
            yield pd.DataFrame({"chunk": [r[0] for r in rows], "part": part, "data": [out[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]})

    sent = table.select("chunk", "docs").mapInPandas(common.trimmed(send), "part int, chunk string, low binary, at binary, times binary")
    with small_batches(spark, 8):
        return common.materialize(sent.repartition(common.width(spark), "part").mapInPandas(common.trimmed(add), "chunk string, part int, data binary"))


def answered(table: DataFrame, answers: DataFrame, then: Callable[[str, Docs, list[tuple[int, bytes]]], Iterator], schema: str, keep: bool = False) -> DataFrame:
    """answers (chunk, part, data): then(chunk, docs, the chunk's [(part, data)] by part) -> frames."""
    spark, last = table.sparkSession, 2**31 - 1
    both = answers.select("chunk", "part", "data").unionAll(table.select("chunk", F.lit(last).alias("part"), F.col("docs").alias("data")))

    def run(batches):
        held: list[tuple[int, bytes]] = []
        for pdf in batches:
            for chunk, part, data in zip(pdf["chunk"], pdf["part"].tolist(), pdf["data"], strict=True):
                if part < last:
                    held.append((part, data))
                    continue
                yield from then(chunk, Docs.unpack(data), held)
                held = []

    with small_batches(spark, 8):
        return common.materialize(both.repartition(common.width(spark), "chunk").sortWithinPartitions("chunk", "part").mapInPandas(common.trimmed(run), schema), keep)


def levels_of(answers: list[tuple[int, bytes]]) -> np.ndarray:
    """What `count` answered, for the chunk's sorted distinct values."""
    return np.frombuffer(b"".join(data for _, data in answers), np.uint8)
