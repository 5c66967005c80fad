"""Operator 1: best-two-fit packing of token sequences.

Each bin is filled greedily with the largest pieces that still fit; then its smallest piece is replaced by the two
unpacked pieces that fit the widened gap more tightly, if there are such. What a bin gets depends on lengths alone, so the
plan is made from the histogram of lengths (at most `capacity` rows, whatever the corpus holds): the same bin content is
repeated until one of its lengths runs out. The plan's size is bounded by capacity alone. Pieces then find their
places by their rank among pieces of their length, which tasks count locally and prefix sums over tasks make global.

Empty cases: null text counts as empty, and an empty document is its end token alone. Repeated rows are packed each, null ids like others.
An empty table has no sequences. Texts of any length are encoded whole, in blocks; runs of millions of blanks, letters or signs too.
Ties: pieces of one length are alike to the plan; among them the writing task's order decides, which changes numbers of sequences and nothing
else. Other columns of the input never meet the operator's names, since it takes only the two it is told.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .tokens import BLOCK, BacktrackingBPE, blocks, public, ranks

CAPACITY = 1024
END_ID = 2
PIECES = "piece int, start long, length long, ids_crc32 long, part int, nth long"


@functools.lru_cache(maxsize=2)
def _encoder(path: str, fast: str):
    """text -> little-endian uint32 ids, as the tokenizers library gives them for the file at `path`.

    Texts are encoded in blocks. Blocks that hold one of the file's added tokens go through that library. All others are encoded from the same
    vocabulary's rank file at `fast`, which gives the same ids at five times the speed: by tiktoken, and where a run without
    a place to cut is too long for its pattern matcher, by operator 10's codec, which is linear in any text. Tests compare all three.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(fast), special_tokens={})

    @functools.cache
    def library():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    @functools.cache
    def linear():
        return BacktrackingBPE(fast, public_tokenizers.PATTERN)

    def block(text: str) -> np.ndarray:
        if any(x in text for x in special):
            return np.asarray(library().encode(text, add_special_tokens=False).ids)
        if len(text) > 2 * BLOCK:
            return np.asarray(linear().encode(text))
        return plain.encode_to_numpy(text, disallowed_special=())

    def encode(text: str) -> bytes:
        return b"".join(block(x).astype("<u4").tobytes() for x in blocks(text))

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, after a first one that takes what is over."""
    first = n % capacity
    starts = [0] * bool(first) + list(range(first, n, capacity))
    return [(s, (first if s == 0 and first else capacity)) for s in starts]


def pieces(docs: DataFrame, id_column: str, text_column: str, vocabulary: str, capacity: int, carry_ids: bool, fast_vocabulary: str) -> DataFrame:
    """One row a piece, with the writing task and the rank among the task's pieces of that length."""
    kind = docs.schema[id_column].dataType.simpleString()
    extra = ", ids binary" if carry_ids else ""

    def run(batches):
        import os
        import zlib
        from collections import Counter

        import pandas as pd
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part, seen = _encoder(public(vocabulary), public(fast_vocabulary)), TaskContext.get().partitionId(), Counter()
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["i"].array, pdf["t"].array, strict=True):
                ids = encode("" if pd.isna(text) else text) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((i, k, start, length, zlib.crc32(own), part, seen[length], *[own] * carry_ids))
                    seen[length] += 1
            out = pd.DataFrame(rows, columns=[id_column, *[x.split()[0] for x in (PIECES + extra).split(", ")]])
            if len(out):
                yield out

    return docs.selectExpr(f"`{id_column}` AS i", f"`{text_column}` AS t").mapInPandas(common.trimmed(run), f"`{id_column}` {kind}, {PIECES}{extra}")


def fill(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """counts[l] pieces of length l, l up to the capacity -> [(content of a bin as {length: how many}, how many such bins)]."""
    capacity, left, plan = len(counts) - 1, counts.astype(np.int64).copy(), []
    while left.any():
        content: dict[int, int] = {}
        gap = capacity
        free = left.copy()
        below = np.flatnonzero(free)
        k = len(below) - 1
        while k >= 0 and gap > 0:
            length = int(below[k])
            take = int(min(free[length], gap // length)) if length else 0
            if take:
                content[length] = content.get(length, 0) + take
                free[length] -= take
                gap -= take * length
            k = min(k - 1, int(np.searchsorted(below, gap, "right")) - 1)
        needed = dict(content)
        if gap and content:
            small = min(content)
            room, best, pair = gap + small, small, None
            lengths = np.flatnonzero(free[: room + 1])
            if len(lengths):
                partner = np.searchsorted(lengths, room - lengths, "right") - 1
                for a, p in zip(lengths[::-1], partner[::-1], strict=True):
                    if p >= 0 and lengths[p] == a and free[a] < 2:
                        p -= 1
                    if p >= 0 and a + lengths[p] > best:
                        best, pair = int(a + lengths[p]), (int(a), int(lengths[p]))
                        if best == room:
                            break
            if pair:
                content[small] -= 1
                if not content[small]:
                    del content[small]
                for x in pair:
                    content[x] = content.get(x, 0) + 1
                    needed[x] = needed.get(x, 0) + 1
        often = int(min(left[x] // n for x, n in needed.items()))
        for x, n in content.items():
            left[x] -= n * often
        plan.append((content, often))
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks for each length: from rank `first` on, `each` a bin, at `offset`, from bin `base` on. Sorted by (length, first)."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for content, often in plan:
        offset = 0
        for length in sorted(content, reverse=True):
            n = content[length]
            rows.append((length, used.get(length, 0), n, offset, base))
            used[length] = used.get(length, 0) + n * often
            offset += n * length
        base += often
    rows.sort()
    return {k: np.array([r[j] for r in rows], dtype=np.int64) for j, k in enumerate(("length", "first", "each", "offset", "base"))}


def place(found: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the rank-th piece of a length."""
    high = int(rank.max(initial=0)) + int(found["first"].max(initial=0)) + 1
    if high * (int(found["length"].max(initial=0)) + 1) < 2**62:
        k = np.searchsorted(found["length"] * high + found["first"], length * high + rank, "right") - 1
    else:  # counts beyond 2^51: length by length
        k = np.zeros(len(length), np.int64)
        for x in np.unique(length):
            lo, hi = np.searchsorted(found["length"], [x, x + 1])
            k[length == x] = lo + np.searchsorted(found["first"][lo:hi], rank[length == x], "right") - 1
    over = rank - found["first"][k]
    return found["base"][k] + over // found["each"][k], found["offset"][k] + over % found["each"][k] * length


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, carry_ids: bool = False, fast_vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids as little-endian uint32])."""
    cut_up = common.materialize(pieces(docs, id_column, text_column, vocabulary, capacity, carry_ids, fast_vocabulary))
    by_task = cut_up.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length: capacity rows at most
        counts[r["length"]] = r["n"]
    found = places(fill(counts))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut_up.join(offsets, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    names = [id_column, "piece", "start", "length", "ids_crc32", *["ids"] * carry_ids]

    def run(batches):
        for pdf in batches:
            bins, offset = place(found, pdf["length"].to_numpy(), pdf["rank"].to_numpy())
            yield pdf[names].assign(sequence_id=bins, offset=offset)

    kind = docs.schema[id_column].dataType.simpleString()
    extra = ", ids binary" if carry_ids else ""
    return ranked.select(*names, "rank").mapInPandas(run, f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long{extra}, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
