"""Evaluation: match tiers, confusion, precision and recall, ranking metrics, span matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V


def confusion(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by, "gold", "predicted").agg(F.count("*").alias("n"))


def per_class(rows: DataFrame, empty: float | None = None) -> DataFrame:
    """label, tp, predicted_n, support, precision, recall, f1; an empty denominator gives `empty`."""
    cells = confusion(rows)
    sides = cells.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("s"), "n", (F.col("gold") == F.col("predicted")).alias("hit"))
    agg = sides.groupBy("s.label").agg(
        F.sum(F.when(F.col("hit"), F.col("n") * F.col("s.g")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("s.p")).alias("predicted_n"), F.sum(F.col("n") * F.col("s.g")).alias("support")
    )
    share = lambda n, d: F.round(F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(F.lit(empty).cast("double")), 6)
    f1 = F.when(F.col("predicted_n") + F.col("support") > 0, 2 * F.col("tp") / (F.col("predicted_n") + F.col("support"))).otherwise(F.lit(empty).cast("double"))
    return agg.select("label", "tp", "predicted_n", "support", share("tp", "predicted_n").alias("precision"), share("tp", "support").alias("recall"), F.round(f1, 6).alias("f1"))


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    hit = (F.col("gold") == F.col("predicted")).cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(hit).alias("correct"), F.round(F.sum(hit) / F.count("*"), 6).alias("accuracy"))


def macro_f1(rows: DataFrame) -> DataFrame:
    return per_class(rows, 0.0).where("support > 0").agg(F.count("*").alias("classes"), F.round(F.avg("f1"), 5).alias("macro_f1"))


def misclassified(rows: DataFrame) -> DataFrame:
    return rows.where("gold <> predicted")


def hand_label(c: Column | str) -> Column:
    """A hand-written label by its aliases; null if blank; anything else is an error."""
    low = F.lower(T.strip(c))
    out = F.when(low == "", None)
    for alias, label in V.LABEL_ALIASES.items():
        out = out.when(low == alias, label)
    return out.otherwise(F.raise_error(F.concat(F.lit("invalid label: "), low)).cast("string"))


def tier(gold: Column, exact: Column, pool: Column) -> Column:
    """EXACT > RESOLVED_OR_EMBEDDED > SUBSTRING (either way round) > NOT_FOUND, case and outer space ignored."""
    g = F.lower(T.strip(gold))
    low = lambda a: F.transform(a, lambda x: F.lower(T.strip(x)))
    both = F.concat(low(exact), low(pool))
    sub = F.exists(both, lambda x: (x != "") & (F.contains(x, g) | F.contains(g, x)))
    return F.when(g == "", "NOT_FOUND").when(F.array_contains(low(exact), g), "EXACT").when(F.array_contains(low(pool), g), "RESOLVED_OR_EMBEDDED").when(sub, "SUBSTRING").otherwise("NOT_FOUND")


def match_pools(targets: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """targets (keys, target, embedded_entities), entities as resolve_articles gives them, keys (article_id, sentence_index) -> keys, exact: selected targets; pool: what is embedded in
    them, names and mentions of entities that the sentence mentions, and its open references."""
    own = targets.groupBy(*keys).agg(F.collect_set("target").alias("exact"), F.array_distinct(F.flatten(F.collect_list("embedded_entities"))).alias("inside"))
    rows = entities.where("error IS NULL").select(keys[0], "canonical_name", F.transform("mentions", lambda m: m["text"]).alias("texts"), F.explode(F.array_distinct(F.transform("mentions", lambda m: m["sentence_index"]))).alias(keys[1]))
    named = rows.groupBy(*keys).agg(F.array_distinct(F.concat(F.collect_list("canonical_name"), F.flatten(F.collect_list("texts")))).alias("named"))
    none = F.array().cast("array<string>")
    both = own.join(named, keys, "full")
    return both.select(*keys, F.coalesce("exact", none).alias("exact"), F.array_distinct(F.concat(F.coalesce("inside", none), F.coalesce("named", none))).alias("pool"))


def selection_tiers(gold: DataFrame, pools: DataFrame, keys: list[str]) -> DataFrame:
    """gold (keys, gold) with the tier in which each gold target is met."""
    none = F.array().cast("array<string>")
    rows = gold.join(pools, keys, "left")
    return rows.select(*keys, "gold", tier(F.col("gold"), F.coalesce("exact", none), F.coalesce("pool", none)).alias("tier"))


def tier_summary(rows: DataFrame) -> DataFrame:
    """rows (model, tier) -> counts by tier, recall, and its difference to the first model's."""
    one = lambda t: F.sum((F.col("tier") == t).cast("long"))
    agg = rows.groupBy("model").agg(F.count("*").alias("gold"), one("EXACT").alias("exact"), one("RESOLVED_OR_EMBEDDED").alias("resolved"), one("SUBSTRING").alias("substring"), one("NOT_FOUND").alias("not_found"))
    agg = agg.withColumn("r", (F.col("gold") - F.col("not_found")) / F.col("gold"))
    first = F.first("r").over(W.orderBy("model").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))  # a row a model
    return agg.withColumn("d", F.col("r") - first).select("model", "gold", "exact", "resolved", "substring", "not_found", F.round("r", 6).alias("recall"), F.round("d", 6).alias("recall_delta"))


def span_match(gold: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """gold (key, g_start, g_end), spans (key, s_start, s_end): exact, partial or missed for each gold span. A key's spans (a sentence's) are gathered and
    joined once; the overlap is judged inside the row."""
    own = spans.groupBy(key).agg(F.collect_list(F.struct("s_start", "s_end")).alias("spans"))
    both = gold.join(own, key, "left")
    same = F.exists("spans", lambda s: (s["s_start"] == F.col("g_start")) & (s["s_end"] == F.col("g_end")))
    meets = F.exists("spans", lambda s: (s["s_start"] < F.col("g_end")) & (s["s_end"] > F.col("g_start")))
    return both.select(key, "g_start", "g_end", F.when(same, "exact").when(meets, "partial").otherwise("missed").alias("match"))


def nested_recall(gold: DataFrame, spans: DataFrame, key: str, tiers: list[tuple[str, list[str]]]) -> DataFrame:
    """Recall by exact offsets as candidate sources are added one after another."""
    found = spans.select(key, F.col("s_start").alias("g_start"), F.col("s_end").alias("g_end"), "source")
    any_of = lambda sources: F.max(F.coalesce(F.col("source").isin(*sources), F.lit(False)).cast("int"))
    rows = gold.join(found, [key, "g_start", "g_end"], "left").groupBy(key, "g_start", "g_end").agg(*[any_of(s).alias(name) for name, s in tiers])
    return rows.agg(F.count("*").alias("gold"), *[F.sum(name).alias(name) for name, _ in tiers])


def gold_ranks(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """ranked (keys, rank, hit): the best rank of a hit for each gold target; null if there is none."""
    return ranked.groupBy(*keys).agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("rank"))


def ranking_metrics(ranks: DataFrame, all_targets: bool) -> DataFrame:
    """top-1/3/5, MRR and the median rank. The denominator is all targets, or those that have a candidate; the median is the upper
    middle for the former, the average of both middles for the latter. Ranks are counted first, so the rest works on a row a rank."""
    rows = ranks if all_targets else ranks.where("rank IS NOT NULL")
    counts = rows.groupBy("rank").agg(F.count("*").alias("n"))
    counts = counts.withColumn("upto", F.sum(F.when(F.col("rank").isNotNull(), F.col("n")).otherwise(0)).over(W.orderBy(F.asc_nulls_last("rank"))))  # a row a rank
    found = F.sum(F.when(F.col("rank").isNotNull(), F.col("n")).otherwise(0))
    counts = counts.withColumn("found", found.over(W.partitionBy()))
    at = lambda place: F.min(F.when((F.col("upto") >= place) & F.col("rank").isNotNull(), F.col("rank")))
    upper, lower = at(F.floor(F.col("found") / 2) + 1), at(F.floor((F.col("found") + 1) / 2))
    median = upper.cast("double") if all_targets else (upper + lower) / 2
    share = lambda x: F.round(F.sum(x * F.col("n")) / F.sum("n"), 6)
    top = lambda k: share(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("targets"), F.coalesce(found, F.lit(0)).alias("found"), top(1).alias("top1"), top(3).alias("top3"), top(5).alias("top5"), share(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), median.alias("median_rank"))


def first_of_each(rows: DataFrame, kind: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each kind, numbered from 1."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy(kind).orderBy(*order))).where(F.col("n") <= most)


def error_type(gold: Column, predicted: Column, gold_source: Column, predicted_source: Column) -> Column:
    """Ordered rules; trailing apostrophes and s are stripped as a set of characters."""
    g, p = F.lower(gold), F.lower(predicted)
    gw, pw = T.word_count(gold), T.word_count(predicted)
    bare = lambda x: F.regexp_replace(x, "['s]+$", "")
    has = lambda c, w: F.contains(F.coalesce(c, F.lit("")), F.lit(w))
    known = gold_source.isNotNull() & predicted_source.isNotNull()
    return (
        F.when(gold == predicted, "CORRECT")
        .when(F.contains(p, g) & (pw > gw), "LARGER_SPAN")
        .when(F.contains(g, p) & (pw < gw), "SMALLER_SPAN")
        .when(bare(g) == bare(p), "POSSESSIVE_VARIATION")
        .when(known & has(gold_source, "SUBSPAN") & (predicted_source == "NER"), "NER_VS_SUBSPAN")
        .when(known & has(gold_source, "NER") & has(predicted_source, "SUBSPAN"), "SUBSPAN_VS_NER")
        .when(has(predicted_source, "COORDINATION"), "COORDINATION_ERROR")
        .otherwise("OTHER")
    )
