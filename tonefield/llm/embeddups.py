"""Operator 8: near-duplicate embeddings by randomised-rotation binary codes.

A vector is brought to unit length, rotated by fixed random rotations, and coded once by the signs: packed bits, the correction factor (its
inner product with its code) and, for the other side of an estimate, its rotation in eight-bit steps. Bands of the signs make
candidates: two vectors meet if they agree in one band. Where vectors meet, only codes travel: they give an unbiased estimate of
each pair's inner product and a confidence bound. Vectors of pairs whose bound reaches the threshold are then fetched, and their
cosines computed in double precision; only these make links.

A pair at the threshold is met with the chance `met`. Bits a band grow with the logarithm of the largest label's
vectors, so that chance agreements fill no more than a tile a bucket; bands follow from `met`. 8 bands of 8 bits are the least for 0.98.

Equal vectors are one representative with a count. Large buckets are dealt into tiles, pairs of tiles are
separate units of work that return link counts and a spanning forest, never the pairs; there is no cap on partners.

Empty cases: null labels, null ids, null, empty or zero vectors and vectors with null or non-finite components link with nothing and keep
their row. Vectors of different length never link. Components of any size count: vectors are scaled by their largest one first. Repeated rows count
as vectors each, under one id. An empty table gives no rows. Other columns of the input never meet the operator's names.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .topk import sound

LEAST_BITS, TILE, MET = 8, 1024, 0.999
#: Standard errors of the estimate that the bound allows for.
EPSILON = 4.0


def banding(vectors: int, threshold: float, tile: int = TILE, met: float = MET) -> tuple[int, int]:
    """(bands, bits) for so many vectors of a label."""
    bits = min(48, max(LEAST_BITS, math.ceil(math.log2(max(vectors, 1) / tile))))
    agree = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return (1 if agree >= 1 else math.ceil(math.log(1 - met) / math.log(1 - agree))), bits


@functools.lru_cache(maxsize=16)
def rotations(dim: int, code_bits: int, seed: int = 7) -> np.ndarray:
    """(rotations, dim, dim), as many as the code needs."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(-(-code_bits // dim)):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


def codes(unit: np.ndarray, bands: int, bits: int) -> np.ndarray:
    """(n, bands): the bits of each band as a number."""
    turned = np.concatenate([unit @ r for r in rotations(unit.shape[1], bands * bits)], axis=1)[:, : bands * bits] >= 0
    return turned.reshape(len(unit), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))


class Coded:
    """Unit vectors as binary codes of one rotation with correction factors, and as rotations in eight-bit steps."""

    def __init__(self, code: np.ndarray, factor: np.ndarray, steps: np.ndarray, step: np.ndarray):
        self.code, self.factor, self.steps, self.step = code, factor, steps, step
        dim = steps.shape[1]
        self.signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
        self.error = EPSILON * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / np.sqrt(max(dim - 1, 1))

    @staticmethod
    def of(unit: np.ndarray) -> Coded:
        turned = unit @ rotations(unit.shape[1], 1)[0]
        step = np.abs(turned).max(axis=1) / 127
        return Coded(np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / np.sqrt(unit.shape[1]), np.rint(turned / step[:, None]).astype(np.int8), step)

    def part(self, at) -> Coded:
        out = object.__new__(Coded)
        for name in ("code", "factor", "steps", "step", "signs", "error"):
            setattr(out, name, getattr(self, name)[at])
        return out


def estimated(a: Coded, b: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products and their bounds: what the code may miss, and half a step in each place."""
    dim = a.steps.shape[1]
    found = (a.steps.astype(np.float32) @ b.signs.T) * (a.step[:, None] / np.sqrt(dim)) / b.factor
    return found, b.error + a.step[:, None] / 2 * np.sqrt(dim) / b.factor


def open_pairs(a: Coded, b: Coded, threshold: float, block: int = 512):
    """Index pairs that the bound leaves open."""
    for k in range(0, len(a.step), block):
        estimate, bound = estimated(a.part(slice(k, k + block)) if len(a.step) > block else a, b)
        i, j = np.nonzero(estimate + bound >= threshold)
        yield i + k, j


def unit_of(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def _coded(bands: int, bits: int):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            if not len(pdf):
                continue
            lengths = pdf["v"].map(len)
            for dim, own in pdf.groupby(lengths):
                unit = unit_of(np.stack(own["v"].to_numpy()).astype(np.float64))
                c = Coded.of(unit)
                yield pd.DataFrame(
                    {"bucket": own["bucket"].to_numpy(), "dim": dim, "id": own["id"].to_numpy(), "h1": own["h1"].to_numpy(), "copies": own["copies"].to_numpy(), "unit": [x.tobytes() for x in unit]}
                    | {"code": [x.tobytes() for x in c.code], "factor": c.factor, "steps": [x.tobytes() for x in c.steps], "step": c.step, "codes": list(codes(unit, bands, bits))}
                )

    return run


CODED = "bucket long, dim int, id long, h1 long, copies long, unit binary, code binary, factor double, steps binary, step double, codes array<long>"


def groups_of(batches, keys: list[str]):
    """Batches sorted by keys -> the columns of each key's rows as arrays, also where a key runs across batches. Keys of one row are left out."""
    held = None
    for pdf in batches:
        now = {c: pdf[c].to_numpy() for c in pdf.columns}
        if held is not None:
            now = {c: np.concatenate([held[c], x]) for c, x in now.items()}
        n = len(now[keys[0]])
        if not n:
            continue
        other = np.zeros(n - 1, bool)
        for k in keys:
            other |= now[k][1:] != now[k][:-1]
        edges = [0, *(np.flatnonzero(other) + 1).tolist(), n]
        for s, e in zip(edges[:-2], edges[1:-1], strict=True):
            if e - s > 1:
                yield {c: x[s:e] for c, x in now.items()}
        held = {c: x[edges[-2] :] for c, x in now.items()}
    if held is not None and len(held[keys[0]]) > 1:
        yield held


UNIT = ["bucket", "dim", "band", "code_of_band", "ti", "tj"]


def _matrix(column, kind) -> np.ndarray:
    """Binary values of equal length as rows."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _pairs_of(group, threshold: float):
    """Index pairs of a unit of work that are open, each in the first band where it meets."""
    band, ti, tj = (int(group[c][0]) for c in ("band", "ti", "tj"))
    coded = Coded(_matrix(group["code"], np.uint8), group["factor"], _matrix(group["steps"], np.int8), group["step"])
    before = np.concatenate(group["before"]).reshape(len(group["id"]), band)
    if ti == tj:
        a = b = np.arange(len(group["id"]))
        sides = coded, coded
    else:
        side = group["tile"]
        a, b = np.flatnonzero(side == ti), np.flatnonzero(side == tj)
        sides = coded.part(a), coded.part(b)
    for i, j in open_pairs(*sides, threshold):
        i, j = a[i], b[j]
        keep = (i < j) if ti == tj else np.ones(len(i), bool)
        keep[keep] &= ~(before[i[keep]] == before[j[keep]]).any(1)
        yield i[keep], j[keep]


def _open(threshold: float):
    """The rows of a unit whose vectors are needed."""

    def run(batches):
        import pandas as pd

        for group in groups_of(batches, UNIT):
            needed = np.zeros(len(group["id"]), bool)
            for i, j in _pairs_of(group, threshold):
                needed[i] = needed[j] = True
            if needed.any():
                yield pd.DataFrame({c: x[needed] for c, x in group.items()})

    return run


def _links(threshold: float):
    def run(batches):
        import pandas as pd

        for group in groups_of(batches, UNIT):
            ids, copies = group["id"], group["copies"]
            unit = _matrix(group["unit"], np.float64)
            parts = []
            for i, j in _pairs_of(group, threshold):
                for m in range(0, len(i), 1_000_000):
                    x, y = i[m : m + 1_000_000], j[m : m + 1_000_000]
                    hit = np.einsum("nd,nd->n", unit[x], unit[y]) >= threshold
                    parts.append((x[hit], y[hit]))
            if not parts:
                continue
            i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(i):
                continue
            links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            root = dict(zip(*(x.tolist() for x in common.forest(ids[i], ids[j])), strict=True))
            at = np.flatnonzero(links)
            yield pd.DataFrame({"id": ids[at], "h1": group["h1"][at], "links": links[at].astype(np.int64), "root": [root[x] for x in ids[at].tolist()]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", tile: int = TILE, met: float = MET) -> DataFrame:
    """(id, n_links, component_id, kept), a row for every row of vectors."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    valid = F.expr(f"label IS NOT NULL AND id IS NOT NULL AND size(v) > 0 AND {sound('v')} AND exists(v, x -> x <> 0)")
    rows = rows.withColumn("v", F.when(valid, F.col("v"))).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    with common.scratch(vectors.sparkSession):
        one = rows.where("v IS NOT NULL").groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
        one = common.materialize(one)
        most = one.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # one number
        coded = one.select(F.xxhash64("label").alias("bucket"), "id", "h1", "copies", "v").mapInPandas(_coded(*banding(most, threshold, tile, met)), CODED)
        coded = common.materialize(coded)
        key = UNIT[:4]
        sizes = coded.select("bucket", "dim", F.posexplode("codes").alias("band", "code_of_band")).groupBy(*key).agg(F.count("*").alias("n"))
        met_ones = sizes.where("n > 1").select(*key, F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
        banded = coded.select("bucket", "dim", "id", "h1", "copies", "code", "factor", "steps", "step", "codes", F.posexplode("codes").alias("band", "code_of_band")).withColumn("before", F.expr("slice(codes, 1, band)")).drop("codes")
        dealt = banded.join(met_ones, key).withColumn("tile", F.expr("cast(pmod(xxhash64(id, h1), tiles) AS int)"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = dealt.select(*key, F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "tile", "id", "h1", "copies", "code", "factor", "steps", "step", "before")
        needed = dealt.repartition(*UNIT).sortWithinPartitions(*UNIT)
        needed = common.materialize(needed.mapInPandas(_open(threshold), dealt.schema))
        fetched = needed.join(coded.select("bucket", "id", "h1", "unit"), ["bucket", "id", "h1"]).repartition(*UNIT).sortWithinPartitions(*UNIT)
        found = common.materialize(fetched.mapInPandas(_links(threshold), "id long, h1 long, links long, root long"))
        linked = found.groupBy("id", "h1").agg(F.sum("links").alias("links"))
        roots = common.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        member = one.select("label", "h1", "h2", F.col("id").alias("rep"), "copies")
        member = member.join(linked.withColumnRenamed("id", "rep"), ["rep", "h1"], "left").join(roots.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left")
        member = common.materialize(member.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), keep=True)
    own = rows.select("id", F.when(F.col("v").isNotNull(), F.col("label")).alias("label"), "h1", "h2")
    out = own.join(member, ["label", "h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id)::BIGINT AS n_links, min(r.y)::BIGINT AS component_id, min(r.y) = e.vec_id AS kept
FROM embeddings e JOIN reach r ON r.x = e.vec_id GROUP BY e.vec_id
"""
