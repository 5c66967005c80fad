"""Operator 4: n-gram Jaccard join by grouped prefixes.

Two documents are linked when percent * |union| <= 100 * |intersection| of their word n-gram sets. A total order puts rare shingles
first (by how many documents hold them, then by hash). A set's prefix is its first |x| - ceil(percent |x| / 100) + 1
elements: linked sets share an element of their prefixes. Then

1. equal sets become one; sets of the same prefix and size become one group (groups of very many sets become several);
2. groups that share a prefix element (shingles that only one document holds cannot be shared and are left out) are filtered pair by pair: by their
   sizes, and by what is left behind the shared element's places in both. Pairs are formed element by element in memory; what leaves a
   task is a spanning forest of those that pass;
3. the forest says which groups are worked on together: a unit of work is a set of groups that fits a tile, or a pair of tiles of a larger one, and a
   group is sent to a pair of tiles only if a pair that passed lies there. So the sets sent are no more than twice the pairs that passed;
4. groups are expanded to their members, whose sets are verified exactly against each other, skipping pairs already known to be connected;
5. verified links are closed to components.

Nothing lists all pairs of a cluster outside a task; no list, cluster or candidate set is capped.

Empty cases: null text or no word: an empty set, linked with nothing. A null id takes part like others; its component is the smallest id that it
reaches, null if it reaches none. Rows that share an id with different texts are documents of their own; the same row twice is one document, and
keeps both rows. Texts of any length are taken whole; an empty table gives no rows. Ids are whole numbers. Other columns of the input never meet the
operator's names, since it takes only the two it is told.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exchange
from .embeddups import groups_of
from .words import mix, shingle_sets

#: Sets of a tile, sets of a group, postings of an element that meet in one go.
TILE, GROUP, POSTINGS = 512, 256, 4096


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if not len(s):
        return 0, 0
    a, b = mix(s ^ np.uint64(0x5851F42D4C957F2D)), mix(s + np.uint64(0x14057B7EF767814F))
    return int(np.sum(a, dtype=np.uint64).astype(np.int64)), int(np.sum(b, dtype=np.uint64).astype(np.int64))


def _values(n: int):
    def values(docs):
        sets = shingle_sets(docs.texts, n)
        return np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)

    return values


INFO = "doc_id long, no_id boolean, h long, n long, k1 long, k2 long, p1 long, prefix binary, places binary, own binary"


def _info(n: int, percent: int):
    """A row a document: size, key of the set, key of the prefix; what can be shared of the prefix and where it stands there, and the set itself
    if anything can."""

    def then(_, docs, answers):
        import pandas as pd

        levels = exchange.levels_of(answers)
        sets = shingle_sets(docs.texts, n)
        known = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]))
        rows = []
        for (i, no, h, _), s in zip(docs.rows(), sets, strict=True):
            k1, k2 = _set_key(s)
            if not len(s):
                rows.append((i, no, h, 0, k1, k2, 0, None, None, None))
                continue
            rare = levels[np.searchsorted(known, s)]
            p = prefix_length(len(s), percent)
            order = np.argsort(rare, kind="stable")[:p]  # s ascends, so ties go by hash
            head, at = s[order], np.flatnonzero(rare[order] > 0)
            p1 = int(np.sum(mix(head), dtype=np.uint64).astype(np.int64))
            rows.append((i, no, h, len(s), k1, k2, p1, *((head[at].tobytes(), at.astype(np.int32).tobytes(), s.tobytes()) if len(at) else (None,) * 3)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in INFO.split(", ")])

    return then


def _postings(percent: int):
    """Groups (node, n, prefix, places) -> (key, node, n, place) of their sharable prefix elements.

    A key names an element and a class of sizes; sizes in reach of each other fall in the same class or in neighbouring
    ones, so each group stands in its own and the next.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for node, n, prefix, places in zip(pdf["node"].tolist(), pdf["n"].tolist(), pdf["prefix"], pdf["places"], strict=True):
                tokens, at = np.frombuffer(prefix, np.uint64), np.frombuffer(places, np.int32)
                size = int(np.floor(np.log(n) / -np.log(percent / 100))) if percent < 100 else n
                for c in (size, size + 1):
                    out.append((mix(tokens + np.uint64(c * 0x632BE59BD9B4E019 % 2**64)).astype(np.int64), np.full(len(tokens), node), np.full(len(tokens), n), at))
            if out:
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("key", "node", "n", "place"), zip(*out, strict=True), strict=True)})

    return run


UNIT = ["key", "ki", "kj"]


def met(posted: DataFrame, most: int = POSTINGS) -> DataFrame:
    """Postings dealt by key; those of a key with very many by pairs of tiles."""
    large = posted.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > most).select("key", F.ceil(F.col("c") / most).cast("int").alias("tiles"))
    dealt = posted.join(large, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.expr("cast(pmod(xxhash64(node), tiles) AS int)")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(*posted.columns, F.least("own", "other").alias("ki"), F.greatest("own", "other").alias("kj"))
    return dealt.repartition(*UNIT).sortWithinPartitions(*UNIT, "n")


def filtered(unit: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int):
    """Postings in the order of (unit, size) -> index pairs of the same unit that pass: sizes in reach, and enough elements left from the
    shared one on in both. The first shared element of linked sets always passes."""
    at, step = np.arange(len(unit)), 1
    left = n - place
    while True:
        at = at[at + step < len(unit)]
        other = at + step
        go = (unit[at] == unit[other]) & (100 * n[at] >= percent * n[other])  # sizes ascend: later ones are out of reach too
        at, other = at[go], other[go]
        if not len(at):
            return
        ok = (100 + percent) * np.minimum(left[at], left[other]) >= percent * (n[at] + n[other])
        yield at[ok], other[ok]
        step += 1


def whole_units(batches, rows: int = 200_000):
    """Batches sorted by UNIT -> frames of many whole units."""
    import pandas as pd

    held, size = [], 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size < rows:
            continue
        every = pd.concat(held, ignore_index=True)
        last = (every[UNIT].to_numpy() == every[UNIT].iloc[-1].to_numpy()).all(1)
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield every.iloc[:cut]
        held = [every.iloc[cut:]]
        size = len(held[0])
    if size:
        yield pd.concat(held, ignore_index=True)


def _numbers(frame) -> np.ndarray:
    """A number for each unit."""
    k = frame[UNIT].to_numpy()
    return np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).any(1)]))


def _forest(percent: int):
    """Postings -> edges of a spanning forest of the pairs that pass."""

    def run(batches):
        import pandas as pd

        held_a, held_b, size = [], [], 0

        def folded():
            v, m = common.forest(np.concatenate(held_a), np.concatenate(held_b))
            return v[v != m], m[v != m]

        for frame in whole_units(batches):
            node = frame["node"].to_numpy()
            for i, j in filtered(_numbers(frame), frame["n"].to_numpy(), frame["place"].to_numpy(), percent):
                held_a.append(node[i]), held_b.append(node[j])
                size += len(i)
                if size > 1_000_000:
                    v, m = folded()
                    held_a, held_b, size = [v], [m], 0
        if held_a:
            v, m = folded()
            yield pd.DataFrame({"a": v, "b": m})

    return run


def _units(percent: int):
    """Postings with (cluster, tile) -> (node, cluster, ti, tj): where a pair of the node that passes is verified."""

    def run(batches):
        import pandas as pd

        for frame in whole_units(batches):
            node, cluster, tile = (frame[c].to_numpy() for c in ("node", "cluster", "tile"))
            found = []
            for i, j in filtered(_numbers(frame), frame["n"].to_numpy(), frame["place"].to_numpy(), percent):
                low, high = np.minimum(tile[i], tile[j]), np.maximum(tile[i], tile[j])
                found.append(pd.DataFrame({"node": np.append(node[i], node[j]), "cluster": np.append(cluster[i], cluster[j]), "ti": np.append(low, low), "tj": np.append(high, high)}).drop_duplicates())
                if len(found) > 50:
                    found = [pd.concat(found).drop_duplicates()]
            if found:
                yield pd.concat(found).drop_duplicates()

    return run


def linked(sets: list[np.ndarray], ids: np.ndarray, percent: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among sets (with side: between sets of different sides), enough of them to connect all that are connected:
    (node, smallest of its component)."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    tokens = np.concatenate([sets[k] for k in order])
    owner = np.repeat(np.arange(m), sizes[order])
    by = np.argsort(tokens, kind="stable")
    ranked, owners = tokens[by], owner[by]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(ranked))
    which = np.empty(len(tokens), np.int64)
    which[by] = np.cumsum(new) - 1
    bounds = np.concatenate([[0], np.cumsum(sizes[order])])
    size = sizes[order]
    side = np.arange(m) if side is None else side[order]
    root = np.arange(m)
    for i in range(m):
        reach = np.searchsorted(size, size[i] * 100 // percent, "right")  # larger ones are out of reach
        others = np.arange(i + 1, reach)
        others = others[(root[others] != root[i]) & (side[others] != side[i])]
        if not len(others):
            continue
        own = which[bounds[i] : bounds[i + 1]]
        a, n = start[own], stop[own] - start[own]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common_ = np.bincount(owners[at], minlength=m)[others]
        hit = others[100 * common_ >= percent * (size[i] + size[others] - common_)]
        if len(hit):
            roots = np.unique(root[np.append(hit, i)])
            root[np.isin(root, roots)] = roots[0]
    ids = ids[order]
    low = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(low, root, ids)
    return ids, low[root]


def _verify(percent: int):
    def run(batches):
        import pandas as pd

        for group in groups_of(batches, ["cluster", "ti", "tj"]):
            across = group["ti"][0] != group["tj"][0]
            ids, low = linked([np.frombuffer(x, np.uint64) for x in group["own"]], group["sid"], percent, group["tile"] if across else None)
            other = ids != low
            if other.any():
                yield pd.DataFrame({"a": ids[other], "b": low[other]})

    return run


#: By what documents of a component are ordered: null ids last.
FIRST = "struct(doc_id IS NULL AS no_id, doc_id, h)"


def join(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", tile: int = TILE, group: int = GROUP, postings: int = POSTINGS) -> DataFrame:
    """(id, h: hash of the text, n_shingles, component_id, first: whether no other document of its component has a smaller (id, h)), a row for each row of docs."""
    spark = docs.sparkSession
    keyed = common.with_key(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))
    with common.scratch(spark):
        table = exchange.chunks(keyed)
        info = exchange.with_nulls(exchange.answered(table, exchange.count(table, _values(words)), _info(words, percent), INFO))
        # 1. equal sets, and groups of equal prefix and size
        sets = info.where("n > 0").groupBy("n", "k1", "k2").agg(F.min(F.expr(FIRST)).alias("first"), F.min("p1").alias("p1"), F.count("prefix").alias("able"))
        sets = common.materialize(sets.withColumn("sid", F.monotonically_increasing_id()))
        chosen = sets.where("able > 0").select("n", "k1", "k2", "first.doc_id", "first.h", "sid")
        able = info.where("prefix IS NOT NULL").alias("i")
        same = [F.col(f"i.{c}") == F.col(f"c.{c}") for c in ("n", "k1", "k2", "h")] + [F.col("i.doc_id").eqNullSafe(F.col("c.doc_id"))]
        one = able.join(chosen.alias("c"), same).select("sid", "i.n", "p1", "prefix", "places", "own").dropDuplicates(["sid"])
        one = common.materialize(one)
        often = one.groupBy("n", "p1").agg(F.ceil(F.count("*") / group).cast("int").alias("subs"))
        placed = one.select("sid", "n", "p1").join(often, ["n", "p1"]).withColumn("sub", F.expr("pmod(xxhash64(sid), subs)"))
        placed = common.materialize(placed.select("sid", "n", "p1", "sub"))
        placed = common.materialize(placed.join(placed.groupBy("n", "p1", "sub").agg(F.min("sid").alias("node")), ["n", "p1", "sub"]).select("sid", "node"))
        heads = one.join(placed.where("sid = node"), "sid").select("node", "n", "prefix", "places")
        # 2. pairs of groups that pass
        posted = common.materialize(heads.mapInPandas(common.trimmed(_postings(percent)), "key long, node long, n long, place int"))
        near = common.materialize(met(posted, postings).mapInPandas(common.trimmed(_forest(percent)), "a long, b long"))
        # groups that are alike in prefix and size are candidates of each other too
        # 3. units of work
        clusters = common.components(near.unionAll(placed.where("sid <> node").select(F.col("sid").alias("a"), F.col("node").alias("b"))))
        member = clusters.select(F.col("a").alias("sid"), F.col("b").alias("cluster")).unionAll(clusters.select("b", "b").distinct())
        sizes = member.groupBy("cluster").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
        member = member.join(placed, "sid").join(sizes, "cluster").withColumn("tile", F.expr("cast(pmod(xxhash64(node), tiles) AS int)"))
        member = common.materialize(member.select("sid", "node", "cluster", "tiles", "tile"))
        wide = member.where("tiles > 1 AND sid = node").select("node", "cluster", "tile")
        across = met(posted.join(wide, "node"), postings).mapInPandas(common.trimmed(_units(percent)), "node long, cluster long, ti int, tj int")
        across = common.materialize(across.where("ti <> tj").distinct())
        units = member.select("sid", "cluster", F.col("tile").alias("ti"), F.col("tile").alias("tj"), "tile")
        units = units.unionByName(member.select("sid", "node", "tile").join(across, "node").select("sid", "cluster", "ti", "tj", "tile"))
        dealt = one.select("sid", "own").join(units, "sid").select("cluster", "ti", "tj", "tile", "sid", "own")
        # 4. members, verified
        with exchange.small_batches(spark, 500):
            verified = common.materialize(dealt.repartition("cluster", "ti", "tj").sortWithinPartitions("cluster", "ti", "tj").mapInPandas(common.trimmed(_verify(percent)), "a long, b long"))
        # 5. components
        roots = common.components(verified)
        rooted = sets.join(roots.select(F.col("a").alias("sid"), F.col("b").alias("root")), "sid", "left").select("n", "k1", "k2", "first", F.coalesce("root", "sid").alias("root"))
        rooted = common.materialize(rooted)
        lowest = rooted.groupBy("root").agg(F.min("first").alias("low"))
        named = rooted.join(lowest, "root").select("n", "k1", "k2", "low")
        rows = info.select("doc_id", "h", "n", "k1", "k2").distinct().join(named, ["n", "k1", "k2"], "left").withColumn("low", F.coalesce("low", F.expr(FIRST)))
        rows = common.materialize(rows.select("doc_id", "h", F.col("n").alias("n_shingles"), F.col("low.doc_id").alias("component_id"), (F.col("low") == F.expr(FIRST)).alias("first")), keep=True)
    out = keyed.select("doc_id", "h").alias("k").join(rows.alias("r"), F.col("k.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("k.h") == F.col("r.h")), "left")
    return out.select(F.col("k.doc_id").alias(id_column), F.col("k.h").alias("h"), "n_shingles", "component_id", "first")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"), words=4, percent=85).drop("h", "first")
