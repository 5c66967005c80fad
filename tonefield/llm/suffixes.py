"""Operator 7: removal of repeated 100-byte strings by difference-cover suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller id, or earlier in the same document).

1. Every window of `length` bytes names its anchor: the leftmost k-gram of least hash inside it. Equal windows have equal
   anchors at the same place, so windows whose anchor occurs once in the corpus are unique, and only runs of windows around
   repeated anchors go on. How often anchors occur comes from exchange.count.
2. These runs are dealt by anchor; equal runs count once, with their earliest place, first inside their chunk, then
   where they meet; hashes find them, their bytes decide. Anchors of very many places are dealt by more of their surroundings.
3. Where an anchor has different runs, they are cut into bands of 17 windows with 84 bytes in common, and bands that share these with another
   are kept. Where such bands differ, the suffixes of all of them are sorted by the difference-cover algorithm: sampled
   triples are sorted and named, the names' string is sorted recursively, the remaining suffixes are sorted by their first byte and the
   rank of the next suffix, and both are merged. Neighbours that agree in `length` bytes are equal windows; all but the earliest go.
4. Removed ranges return to their chunks, which join them and hash what is left.

Empty cases: null text is empty; nothing is removed from it. A null id sorts first and is returned as null. Rows that share an id count
as one document; the same row twice does not repeat itself. Texts of any length are taken whole; an empty table gives no rows. Ids are whole
numbers. Of equal strings the one of the smallest (id, place) stays. Other columns of the input never
meet the operator's names, since it takes only the two it is told.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exchange
from .words import mix, powers

LENGTH, GRAM = 100, 32
PIECE = 1 << 18
BYTE = np.random.default_rng(77).integers(0, 2**64, 256, dtype=np.uint64)
#: Level (see exchange.level) from which an anchor's runs are dealt by their surroundings: 4096 places.
HOT = 48


class Runs:
    """Maximal runs of windows with the same anchor: places in the chunk's joined bytes."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.length, self.gram = length, gram
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.doc_start = np.cumsum([0, *map(len, texts)])
        found = [self._piece(a, length, gram) for a in range(0, max(len(self.raw) - length + 1, 0), PIECE)]
        names = ("anchor_at", "first", "last", "value", "content", "left", "right")
        for k, name in enumerate(names):
            kind = np.int64 if k < 3 else np.uint64
            setattr(self, name, np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind))
        self.doc = np.searchsorted(self.doc_start, self.first, "right") - 1

    def _piece(self, a: int, length: int, gram: int):
        stop = min(a + PIECE, len(self.raw) - length + 1)
        b = self.raw[a : stop + length - 1]
        up, down = powers(PIECE + length + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[b] * up[: len(b)], dtype=np.uint64)])

        def hashed(s, e):
            return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))

        n = len(b) - gram + 1
        at = np.arange(n)
        grams = mix((total[gram:] - total[:-gram]) * down[:n])
        low = np.uint64((1 << 21) - 1)
        least = (grams & ~low) | at.astype(np.uint64)
        width, span = length - gram + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        anchor = (least & low).astype(np.int64)  # of the window at each place
        valid = np.zeros(len(anchor), bool)
        d = int(np.searchsorted(self.doc_start, a, "right")) - 1
        while d < len(self.doc_start) - 1 and self.doc_start[d] < stop:
            valid[max(0, self.doc_start[d] - a) : max(0, self.doc_start[d + 1] - length + 1 - a)] = True
            d += 1
        anchor[~valid] = -1
        edge = np.flatnonzero(np.diff(anchor, prepend=-2, append=-2))
        first, last = edge[:-1], edge[1:] - 1
        keep = anchor[first] >= 0 if len(first) else np.zeros(0, bool)
        first, last = first[keep], last[keep]
        p = anchor[first]
        half = (length - gram) // 2
        left = hashed(np.maximum(p - half, 0), p + gram)
        right = hashed(p, np.minimum(p + gram + half, len(b)))
        return p + a, first + a, last + a, mix(grams[p] + np.uint64(0x3C6EF372FE94F82B)), hashed(first, last + length), left, right


def anchors(length: int, gram: int):
    def values(docs):
        r = Runs(docs.texts, length, gram)
        at = np.unique(r.anchor_at, return_index=True)[1]
        return np.unique(r.value[at], return_counts=True)

    return values


def gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """raw[start:start + size] of all, one after another."""
    ends = np.cumsum(size)
    return raw[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def ranges_blob(doc, start, stop) -> bytes:
    return pickle.dumps((np.asarray(doc, np.int32).tobytes(), np.asarray(start, np.int64).tobytes(), np.asarray(stop, np.int64).tobytes()))


def sent(length: int, gram: int, bits: int, hot_level: int):
    """Runs around repeated anchors: equal ones of a chunk once, the others removed on the spot (part -1)."""

    def then(chunk, docs, answers):
        import pandas as pd
        import zstandard

        levels = exchange.levels_of(answers)
        r = Runs(docs.texts, length, gram)
        level = levels[np.searchsorted(np.unique(r.value), r.value)] if len(r.value) else np.zeros(0, np.uint8)
        at = np.flatnonzero(level > 0)
        key, first, last, anchor = r.value[at], r.first[at], r.last[at], r.anchor_at[at]
        content, left, right, level, doc = r.content[at], r.left[at], r.right[at], level[at], r.doc[at]
        hot = level >= hot_level
        if hot.any():  # cut at the window that has half of what is free on either side of the anchor
            half = (length - gram) // 2
            seam = anchor - half
            to_left, to_right = hot & (first <= seam), hot & (last > seam)
            parts = [np.flatnonzero(~hot), np.flatnonzero(to_left), np.flatnonzero(to_right)]
            first2 = np.concatenate([first[parts[0]], first[parts[1]], np.maximum(first, seam + 1)[parts[2]]])
            last2 = np.concatenate([last[parts[0]], np.minimum(last, seam)[parts[1]], last[parts[2]]])
            key = np.concatenate([key[parts[0]], mix(key ^ left)[parts[1]], mix(key + right)[parts[2]]])
            whole = np.concatenate(parts)
            content = mix(content[whole] + (first2 - first[whole]).astype(np.uint64) * np.uint64(257) + (last2 - last[whole]).astype(np.uint64) * np.uint64(0x10001F))
            # runs that differ outside the cut part may still be equal inside: they then meet as different runs, which is right too
            doc, first, last, anchor = doc[whole], first2, last2, anchor[whole]
        start = first - r.doc_start[doc]
        size = last - first + length
        order = np.lexsort((start, docs.ids[doc], content, key))
        ahead = anchor - first
        key, content, doc, first, start, size, ahead = (x[order] for x in (key, content, doc, first, start, size, ahead))
        ids = docs.ids[doc] if len(doc) else np.zeros(0, np.int64)
        gone = earliest(key, content, ids, start, eights(r.raw), first, size)
        rows = [(-1, chunk, ranges_blob(doc[gone], start[gone], (start + size)[gone]))] if gone.any() else []
        stays = ~gone
        key, content, doc, first, start, size, ahead, ids = (x[stays] for x in (key, content, doc, first, start, size, ahead, ids))
        cut = exchange.cut(key, bits)
        edges = [0, *cut.tolist(), len(key)]
        packer = zstandard.ZstdCompressor(level=3)
        for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a:
                s = slice(a, b)
                data = (key[s].tobytes(), content[s].tobytes(), ids[s].tobytes(), start[s].astype(np.int64).tobytes(), doc[s].astype(np.int32).tobytes(), size[s].astype(np.int32).tobytes(), ahead[s].astype(np.int32).tobytes(), gathered(r.raw, first[s], size[s]).tobytes())
                rows.append((p, chunk, packer.compress(pickle.dumps(data))))
        yield pd.DataFrame(rows, columns=["part", "chunk", "data"])

    return then


def ranks_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Order of the keys, rank of each (equal keys share one, from 1), whether all differ."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank, bool(new.all())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (positive integers below 2^31) in order, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.concatenate([s, [0, 0, 0]]).astype(np.int64)
    ones = np.arange(1, n + (n % 3 == 1), 3)  # with one position of zeros in between where n leaves 1
    sample = np.concatenate([ones, np.arange(2, n, 3)])
    if t.max() < 1 << 20:
        name = ranks_of((t[sample] << 40) | (t[sample + 1] << 20) | t[sample + 2])[1]
    else:
        pair = ranks_of((t[sample] << 31) | t[sample + 1])[1]
        name = ranks_of((pair << 31) | t[sample + 2])[1]
    if name.max() == len(name):
        ranked = sample[np.argsort(name)]
    else:
        ranked = sample[suffix_array(name)]
    ranked = ranked[ranked < n]
    rank = np.zeros(n + 3, np.int64)
    rank[ranked] = np.arange(1, len(ranked) + 1)
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort((t[rest] << 32) | rank[rest + 1], kind="stable")]
    # merge: a rest suffix meets those of residue 1 by (symbol, rank), those of residue 2 by (two symbols, rank)
    is_one = ranked % 3 == 1
    one, two = ranked[is_one], ranked[~is_one]
    below = np.searchsorted((t[one] << 32) | rank[one + 1], (t[rest] << 32) | rank[rest + 1])
    pairs = ranks_of(np.concatenate([(t[two] << 31) | t[two + 1], (t[rest] << 31) | t[rest + 1]]))[1]
    below = below + np.searchsorted((pairs[: len(two)] << 32) | rank[two + 2], (pairs[len(two) :] << 32) | rank[rest + 2])
    out = np.empty(n, np.int64)
    taken = below + np.arange(len(rest))
    out[taken] = rest
    free = np.ones(n, bool)
    free[taken] = False
    out[free] = ranked
    return out


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    out = np.zeros(len(text) + 8, np.uint64)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    for k in range(8):
        out |= padded[k : k + len(out)].astype(np.uint64) << np.uint64(8 * k)
    return out


def steps(length: int) -> list[int]:
    """Where eight-byte pieces of `length` bytes begin."""
    return [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]


def equal_windows(eight: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """starts of windows in the order of the suffix array -> number of each one's class of equal windows (ascending)."""
    a, b = starts[:-1], starts[1:]
    same = np.ones(len(a), bool)
    for off in steps(length):
        same &= eight[a + off] == eight[b + off]
    return np.concatenate([[0], np.cumsum(~same)])


#: Windows of a run whose anchors lie within so many bytes of each other inside the window share all but that many bytes.
BAND = 16


def shared_cores(raw: np.ndarray, at: np.ndarray, size: np.ndarray, ahead: np.ndarray, key: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs (at, size in raw; the anchor is `ahead` bytes in) are cut into bands of windows that place the anchor alike. A band's windows
    have a core of length - BAND bytes in common; bands whose core no other run has are unique and go.

    (run, first window in raw, windows) of the others, and the band's key and content as hashes.
    """
    eight = eights(raw)
    free = length - gram
    anchor, last = at + ahead, at + size - length
    out = []
    for low in range(0, free + 1, BAND + 1):
        high = min(low + BAND, free)  # bytes before the anchor
        first, stop = np.maximum(anchor - high, at), np.minimum(anchor - low, last)
        run = np.flatnonzero(first <= stop)
        core, wide = anchor[run] - low, length - (high - low)
        h = key[run] + np.uint64(low + 1)
        for off in steps(wide):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + eight[core + off])
        _, which, times = np.unique(h, return_inverse=True, return_counts=True)
        again = times[which] > 1
        run, h = run[again], h[again]
        first, stop = first[run], stop[run]
        c = mix((anchor[run] - first).astype(np.uint64) * np.uint64(1024) + (stop - first).astype(np.uint64))
        for place in (first, first + 8, stop + length - 16, stop + length - 8):
            c = mix(c * np.uint64(0xD6E8FEB86659FD93) + eight[place])
        out.append((run, first, stop - first + 1, h, c))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def same_bytes(eight: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size[k] bytes from a[k] on equal those from b[k] on; 8 bytes at least."""
    out, words, k = np.ones(len(a), bool), -(-size // 8), 0
    ends = np.cumsum(words)
    while k < len(a):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + 1_000_000, "right")))
        n = words[k:stop]
        begin = np.cumsum(n) - n
        off = np.minimum(8 * (np.arange(int(n.sum())) - np.repeat(begin, n)), np.repeat(size[k:stop] - 8, n))
        out[k:stop] = np.logical_and.reduceat(eight[np.repeat(a[k:stop], n) + off] == eight[np.repeat(b[k:stop], n) + off], begin)
        k = stop
    return out


def earliest(key, content, ids, start, eight, at, size) -> np.ndarray:
    """Of rows in the order of (key, content, ids, start): whether the first row of its (key, content) stands earlier and holds the same bytes.
    at, size: the row's bytes in the text behind `eight`."""
    if not len(key):
        return np.zeros(0, bool)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    gone = (ids > ids[head]) | (start > start[head]) & (ids == ids[head])
    gone &= size == size[head]
    k = np.flatnonzero(gone)
    gone[k] = same_bytes(eight, at[k], at[head[k]], size[k])
    return gone


def repeated(length: int, gram: int):
    """Runs of one part from all chunks -> removed ranges, a row a chunk."""

    def of_part(rows):
        import zstandard

        unpacked = [pickle.loads(zstandard.ZstdDecompressor().decompress(data)) for _, data in rows]
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int32, np.int32)
        key, content, ids, start, doc, size, ahead = (np.concatenate([np.frombuffer(u[k], kind) for u in unpacked]) for k, kind in enumerate(kinds))
        raw = np.frombuffer(b"".join(u[7] for u in unpacked), np.uint8)
        chunk = np.repeat(np.arange(len(rows)), [len(u[0]) // 8 for u in unpacked])
        del unpacked
        at = np.concatenate([[0], np.cumsum(size[:-1], dtype=np.int64)])
        order = np.lexsort((start, ids, content, key))
        key, content, ids, start, doc, size, ahead, chunk, at = (x[order] for x in (key, content, ids, start, doc, size, ahead, chunk, at))
        size = size.astype(np.int64)
        gone = earliest(key, content, ids, start, eights(raw), at, size)
        out = [(chunk[gone], doc[gone], start[gone], start[gone] + size[gone])]
        # what is first of its kind, where its anchor has other kinds too: bands of windows with a core in common
        heads = np.flatnonzero(~gone)  # the same document twice stays twice
        k = key[heads]
        same = k[1:] == k[:-1]
        h = heads[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(k) else heads
        run, first, windows, core, kind = shared_cores(raw, at[h], size[h], ahead[h].astype(np.int64), key[h], length, gram)
        run = h[run]
        begin = start[run] + first - at[run]
        order = np.lexsort((begin, ids[run], kind, core))
        run, first, windows, core, kind, begin = (x[order] for x in (run, first, windows, core, kind, begin))
        gone = earliest(core, kind, ids[run], begin, eights(raw), first, windows + length - 1)
        out.append((chunk[run][gone], doc[run][gone], begin[gone], (begin + windows + length - 1)[gone]))
        heads = np.flatnonzero(~gone)  # the same document twice stays twice
        k = core[heads]
        same = k[1:] == k[:-1]
        g = heads[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(k) else heads
        if len(g):
            run, first, windows, begin = run[g], first[g], windows[g], begin[g]
            sizes = windows + length  # with an end mark
            text = np.zeros(int(sizes.sum()), np.uint8)
            to = np.cumsum(sizes) - sizes
            inside = np.ones(len(text), bool)
            inside[to + sizes - 1] = False
            text[inside] = gathered(raw, first, sizes - 1)
            symbols = text.astype(np.int64) + 2
            symbols[~inside] = 1
            edges = np.zeros(len(text) + 1, np.int64)
            np.add.at(edges, to, 1), np.add.at(edges, to + windows, -1)
            is_window = np.cumsum(edges[:-1]) > 0
            sa = suffix_array(symbols)
            sa = sa[is_window[sa]]
            group = equal_windows(eights(text), sa, length)
            own = np.searchsorted(to, sa, "right") - 1
            w_start, w_ids = begin[own] + sa - to[own], ids[run][own]
            by = np.lexsort((w_start, w_ids, group))
            edge = np.flatnonzero(np.concatenate([[True], group[by][1:] != group[by][:-1]]))
            lead = np.repeat(by[edge], np.diff(np.append(edge, len(by))))
            later = (w_ids[by] > w_ids[lead]) | (w_start[by] > w_start[lead]) & (w_ids[by] == w_ids[lead])
            lost = np.sort(sa[by[later]])  # ascending in the text of runs: neighbours join
            if len(lost):
                r = np.searchsorted(to, lost, "right") - 1
                cut = np.flatnonzero(np.concatenate([[True], (lost[1:] != lost[:-1] + 1) | (r[1:] != r[:-1])]))
                a, b = lost[cut], lost[np.append(cut[1:], len(lost)) - 1]
                r = r[cut]
                base = begin[r] - to[r]
                out.append((chunk[run[r]], doc[run[r]], a + base, b + base + length))
        c, d, s, e = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(c, kind="stable")
        c, d, s, e = c[order], d[order], s[order], e[order]
        cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        for a, b in zip(cut, np.append(cut[1:], len(c)), strict=False):
            yield rows[c[a]][0], ranges_blob(d[a:b], s[a:b], e[a:b])

    def run(batches):
        import pandas as pd

        held, part = [], None
        for pdf in batches:
            for p, chunk, data in zip(pdf["part"].tolist(), pdf["chunk"], pdf["data"], strict=True):
                if p != part and held:
                    yield pd.DataFrame([(c, part, blob) for c, blob in of_part(held)], columns=["chunk", "part", "data"])
                    held = []
                part = p
                held.append((chunk, data))
        if held:
            yield pd.DataFrame([(c, part, blob) for c, blob in of_part(held)], columns=["chunk", "part", "data"])

    return run


def joined(ranges: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[int, list[tuple[int, int]]]:
    """Document -> its removed ranges, disjoint and in order."""
    if not ranges:
        return {}
    doc, start, stop = (np.concatenate(x) for x in zip(*ranges, strict=True))
    out: dict[int, list[list[int]]] = {}
    order = np.lexsort((start, doc))
    for d, s, e in zip(doc[order].tolist(), start[order].tolist(), stop[order].tolist(), strict=True):
        own = out.setdefault(d, [])
        if own and s <= own[-1][1]:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([s, e])
    return out


RESULT = "doc_id long, no_id boolean, h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def finished(with_spans: bool, with_text: bool):
    def then(_, docs, answers):
        import hashlib

        import pandas as pd

        ranges = [tuple(np.frombuffer(x, kind) for x, kind in zip(pickle.loads(data), (np.int32, np.int64, np.int64), strict=True)) for _, data in answers]
        spans, rows = joined(ranges), []
        for k, (i, no, h, text) in enumerate(docs.rows()):
            own, at, kept = spans.get(k, []), 0, []
            for s, e in own:
                kept.append(text[at:s])
                at = e
            kept.append(text[at:])
            plain = b"".join(kept)
            rows.append((i, no, h, len(text), len(text) - len(plain), len(own), hashlib.sha256(plain).hexdigest(), *[[x for r in own for x in r]] * with_spans, *[plain.decode("utf-8", "ignore")] * with_text))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")] + ["spans"] * with_spans + ["text"] * with_text)

    return then


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text", with_spans: bool = False, with_text: bool = False, hot_level: int = HOT) -> DataFrame:
    """(id, h, n_bytes, n_removed, n_spans, kept_sha256[, spans: start, stop, start, stop ... in bytes][, text: what is kept, without
    characters of which only a part is kept]), a row for each row of docs."""
    spark = docs.sparkSession
    bits = exchange.parts_for(spark).bit_length() - 1
    keyed = common.with_key(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))
    with common.scratch(spark):
        table = exchange.chunks(keyed)
        runs = exchange.answered(table, exchange.count(table, anchors(length, gram)), sent(length, gram, bits, hot_level), "part int, chunk string, data binary")
        with exchange.small_batches(spark, 8):
            met = common.materialize(runs.where("part >= 0").repartition(common.width(spark), "part").sortWithinPartitions("part").mapInPandas(common.trimmed(repeated(length, gram)), "chunk string, part int, data binary"))
        answers = met.unionByName(runs.where("part < 0"))
        out = exchange.answered(table, answers, finished(with_spans, with_text), RESULT + ", spans array<long>" * with_spans + ", text string" * with_text, keep=True)
    return exchange.with_nulls(out).withColumnRenamed("doc_id", id_column)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(common.table(spark, sf_dir, "documents")).drop("h")
