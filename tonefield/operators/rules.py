"""Selection and resolution rules as column expressions, for rows that already hold phrases, entities, mentions and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from . import references


def usable_phrases(phrases: Column) -> Column:
    """Without pronouns, generic terms and later phrases that differ in case only."""
    low = lambda x: F.lower(T.strip(x))
    return T.first_wins(F.filter(phrases, lambda x: ~low(x).isin(*V.PRONOUNS) & ~low(x).isin(*V.GENERIC_TERMS)))


def is_entity(phrase: Column, names: Column) -> Column:
    bare = F.regexp_replace(F.lower(T.strip(phrase)), "^(the|a|an) ", "")
    return F.exists(names, lambda n: (F.lower(n) == bare) | ((F.length(bare) >= 4) & F.contains(F.lower(n), bare)))


def candidates(phrases: Column, names: Column) -> Column:
    """Usable phrases; of several, those that are entities, else the first."""
    def pick(kept: Column) -> Column:
        matched = F.filter(kept, lambda p: is_entity(p, names))
        return F.when(F.size(kept) < 2, kept).when(F.size(matched) > 0, matched).otherwise(F.slice(kept, 1, 1))

    return T.let(usable_phrases(phrases), pick)


def embedded(target: Column, entities: Column) -> Column:
    """entities: structs (text, label). Strong ones of two letters and more inside the target, but not the target itself."""
    low = F.lower(target)
    kept = F.filter(entities, lambda e: ~e["label"].isin(*V.WEAK_ENTITY_LABELS) & (F.length(T.strip(e["text"])) >= 2) & (F.lower(e["text"]) != low) & F.contains(low, F.lower(e["text"])))
    return T.first_wins(F.transform(kept, lambda e: e["text"]))


def capped(target: Column, embedded_: Column) -> Column:
    """The target, the first entity in it if it is too long, or null."""
    return F.when(T.word_count(target) <= V.MAX_TARGET_WORDS, target).otherwise(F.get(embedded_, F.lit(0)))


def confidence(lemma: Column, role: Column) -> Column:
    low = F.lower(lemma)
    focus = F.when(low.isin(*V.OBJECT_FOCUSED_EVENTS), "object").when(low.isin(*V.SUBJECT_FOCUSED_EVENTS), "subject")
    return F.when(F.coalesce(focus == role, F.lit(False)), "high").otherwise("medium")


def select_all(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, event_pos, lemma, role, cand_pos, target): objects before subjects, event by event; the first of a name wins."""
    place = F.struct("event_pos", F.when(F.col("role") == "object", 0).otherwise(1).alias("r"), "cand_pos")
    first = W.partitionBy(*keys, F.lower(T.strip("target"))).orderBy(place)
    kept = rows.withColumn("confidence", confidence(F.col("lemma"), F.col("role"))).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return kept.withColumn("target_pos", F.row_number().over(W.partitionBy(*keys).orderBy(place)))


def select_best(targets: DataFrame, keys: list[str]) -> DataFrame:
    level = F.element_at(F.create_map(*[F.lit(x) for kv in V.CONFIDENCE_RANK.items() for x in kv]), F.col("confidence"))
    w = W.partitionBy(*keys).orderBy(level.desc(), "target_pos")
    return targets.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def compatible_types(text: Column) -> Column:
    """Types that a reference may stand for; empty if any."""
    none = F.array().cast("array<string>")
    low, out = F.lower(T.strip(text)), none
    kind, head = references.mention_type(text), references.generic_head(text)
    for word, types in V.PRONOUN_TYPES.items():
        out = F.when((kind == "pronoun") & (low == word), F.array(*map(F.lit, types))).otherwise(out)
    for word, types in V.GENERIC_HEAD_TYPES.items():
        out = F.when((kind == "definite_description") & (head == word), F.array(*map(F.lit, types))).otherwise(out)
    return out


def gender(text: Column) -> Column:
    low = F.lower(T.strip(text))
    return F.when(low.isin(*V.MALE_PRONOUNS), "male").when(low.isin(*V.FEMALE_PRONOUNS), "female")


def score(mention: Column, start: Column, event: Column, label: Column, role: Column, c_start: Column, c_event: Column, elsewhere: Column, c_gender: Column) -> Column:
    """Score of a candidate for a reference; null rejects."""
    types = compatible_types(mention)
    fits = F.array_contains(types, label)
    fit = F.when((F.size(types) > 0) & label.isNotNull(), 30).otherwise(5)
    near = F.when(role == "subject", 30).when(role == "object", 10).otherwise(0) + F.when((event >= 0) & (event == c_event), 25).otherwise(0)
    both = (start >= 0) & (c_start >= 0)
    distance = F.when(both, F.greatest(F.lit(0), 20 - F.least(F.floor((start - c_start) / 10), F.lit(20)))).otherwise(0)
    conflict = F.coalesce(gender(mention) != c_gender, F.lit(False))
    wrong = (F.size(types) > 0) & label.isNotNull() & ~fits
    return F.when(conflict | wrong, None).when(elsewhere, 15 + fit).when(both & (start < c_start), None).otherwise(fit + near + distance).cast("int")


def decide(scored: DataFrame, keys: list[str], least: int = 40, gap: int = 10) -> DataFrame:
    """scored (keys, candidate, cand_pos, score): each reference's candidate, or null where none is good or clear enough."""
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_last("score"), "cand_pos")
    ranked = scored.withColumns({"r": F.row_number().over(w), "second": F.lead("score").over(w)}).where("r = 1")
    clear = (F.col("score") >= least) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= gap))
    return ranked.select(*keys, F.when(clear, F.col("candidate")).alias("candidate"), F.when(clear, F.col("score")).alias("score"))
