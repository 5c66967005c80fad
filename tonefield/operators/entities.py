"""Entity analytics over fact rows: canonical entities, alias merging, leaderboards, trends and outlet framing.

Every aggregate is partial before it shuffles; facts are read once, and alias merging works on the aggregates by key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V


def canonical_entity(embedded: Column, target: Column) -> Column:
    """First embedded entity, else a target of one to three words that begins with a capital, else null."""
    t = T.strip(F.coalesce(target, F.lit("")))
    alone = T.word_count(t).between(1, 3) & T.capitalised(t)
    return F.when(F.size(F.coalesce(embedded, F.array().cast("array<string>"))) > 0, T.strip(F.get(embedded, F.lit(0)))).when(alone, t)


def with_entities(facts: DataFrame) -> DataFrame:
    """facts with entity (as shown) and key (lower case). An empty or missing prediction counts as none."""
    entity = canonical_entity(F.col("embedded_entities"), F.col("target_text"))
    return facts.withColumns({"sentiment": T.blank_as_null("sentiment"), "entity": entity}).withColumn("key", F.lower("entity"))


def usable(facts: DataFrame) -> DataFrame:
    return with_entities(facts).where(F.col("sentiment").isin(*V.SENTIMENTS) & F.col("key").isNotNull())


def with_merged(keyed: DataFrame) -> DataFrame:
    """keyed (key, more), a row a key -> key, merged, more. A key of two words or more, unless it begins with an institutional modifier, goes to its
    shortest proper suffix that is a key itself, others to themselves.

    Each key stands once under itself and once under every proper suffix; a suffix is a key if some key stands there under itself. So the
    keys are read once and never joined with themselves."""
    more = [c for c in keyed.columns if c != "key"]
    words, none = F.split("key", " "), F.array().cast("array<struct<suffix:string,n:int,own:boolean>>")
    part = lambda w, n, own: F.struct(F.array_join(F.slice(w, F.size(w) - n + 1, n), " ").alias("suffix"), n.alias("n"), F.lit(own).alias("own"))
    folds = lambda w: (F.size(w) > 1) & ~F.get(w, F.lit(0)).isin(*V.INSTITUTIONAL_MODIFIERS)
    parts = T.let(words, lambda w: F.concat(F.array(part(w, F.size(w), True)), F.when(folds(w), F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda n: part(w, n, False))).otherwise(none)))
    rows = keyed.select("*", F.explode_outer(parts).alias("x")).select("key", "x.suffix", "x.n", *[F.when(F.col("x.own"), F.col(c)).alias(c) for c in more], "x.own")
    there = rows.withColumn("there", F.max("own").over(W.partitionBy("suffix"))).where("there")
    return there.groupBy("key").agg(F.min_by("suffix", "n").alias("merged"), *[F.first(c, ignorenulls=True).alias(c) for c in more])


def alias_mapping(keys: DataFrame) -> DataFrame:
    """keys (key) -> (key, merged)."""
    return with_merged(keys.select("key").where(F.col("key").isNotNull()).distinct())


def label_counts() -> list[Column]:
    return [F.sum((F.col("sentiment") == s).cast("long")).alias(s.lower()) for s in V.SENTIMENTS] + [F.count("*").alias("total")]


def percentages(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{s.lower()}_pct": F.round(100.0 * F.col(s.lower()) / F.col("total"), 4) for s in V.SENTIMENTS})


def merged_counts(facts: DataFrame, *by: str) -> DataFrame:
    """merged, by..., counts by label, total: facts are read once and aggregated by their own keys; aliases are merged on these
    aggregates, packed to a row a key, and added up again."""
    names = [s.lower() for s in V.SENTIMENTS] + ["total"]
    packed = facts.groupBy("key", *by).agg(*label_counts()).groupBy("key").agg(F.collect_list(F.struct(*by, *names)).alias("counts"))  # as many as days or outlets
    rows = with_merged(packed).select("merged", F.explode_outer("counts").alias("c")).select("merged", "c.*")
    return rows.groupBy("merged", *by).agg(*[F.sum(n).alias(n) for n in names])


def leaderboard(facts: DataFrame, min_mentions: int = 3, top: int | None = 20) -> DataFrame:
    """Counts, confidence and shares by merged entity; the mention floor applies after merging. The name shown is the last one
    seen under the surviving key."""
    names = [s.lower() for s in V.SENTIMENTS] + ["total", "confidence"]
    keyed = usable(facts).groupBy("key").agg(F.max_by("entity", "row_id").alias("entity"), *label_counts(), F.sum(F.coalesce("sentiment_confidence", F.lit(0.0))).alias("confidence"))
    own = F.when(F.col("key") == F.col("merged"), F.col("entity"))
    agg = with_merged(keyed).groupBy("merged").agg(F.max(own).alias("entity"), *[F.sum(n).alias(n) for n in names])
    agg = agg.where(F.col("total") >= min_mentions).withColumn("avg_confidence", F.round(F.col("confidence") / F.col("total"), 6)).drop("confidence")
    out = percentages(agg)
    return out.orderBy(F.desc("total"), "merged").limit(top) if top else out


def skip_counters(facts: DataFrame) -> DataFrame:
    none = ~F.coalesce(F.col("sentiment").isin(*V.SENTIMENTS), F.lit(False))
    return with_entities(facts).agg(F.count("*").alias("records"), F.count_if(none).alias("no_prediction"), F.count_if(~none & F.col("key").isNull()).alias("not_entity_like"))


def daily(facts: DataFrame) -> DataFrame:
    """Counts by merged entity and day; rows without a whole date go."""
    return percentages(merged_counts(usable(facts).withColumn("day", T.day("fetched_at")), "day").where("day IS NOT NULL"))


def multi_day(facts: DataFrame, min_mentions: int = 2) -> DataFrame:
    rows = daily(facts).groupBy("merged").agg(F.count("*").alias("days"), F.sum("total").alias("total"), F.array_join(F.array_sort(F.collect_list("day")), ",").alias("dates"))
    return rows.where((F.col("days") >= 2) & (F.col("total") >= min_mentions))


def thin_days(facts: DataFrame, floor: int = 10) -> DataFrame:
    return daily(facts).select("merged", "day", "total", (F.col("total") < floor).alias("thin"))


def entity_trend(facts: DataFrame, key: str) -> DataFrame:
    return daily(facts).where(F.col("merged") == key).orderBy("day")


def kpis(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count("*").alias("records"), F.count_distinct("article_url").alias("articles"), F.count_distinct(T.day("fetched_at")).alias("days"))


def long_shares(df: DataFrame, keys: list[str]) -> DataFrame:
    """Wide counts -> (keys, sentiment, n, pct), for charts."""
    rows = df.select(*keys, "total", F.explode(F.array(*[F.struct(F.lit(s).alias("sentiment"), F.col(s.lower()).alias("n")) for s in V.SENTIMENTS])).alias("x"))
    return rows.select(*keys, "x.sentiment", "x.n", F.round(100.0 * F.col("x.n") / F.col("total"), 4).alias("pct"))


def article_summary(facts: DataFrame, top: int = 8) -> DataFrame:
    """Entities of each article, without merging; the name shown is the first one seen."""
    agg = usable(facts).groupBy("article_url", "key").agg(F.min_by("entity", "row_id").alias("entity"), *label_counts())
    w = W.partitionBy("article_url").orderBy(F.desc("total"), "key")
    return agg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def outlet_name(url: Column | str) -> Column:
    """Known outlets by domain, else the first label of the host in capitals."""
    host = F.regexp_replace(F.regexp_replace(T.netloc(url), r"^feeds\.", ""), r"^www\.", "")
    out = F.upper(F.substring_index(host, ".", 1))
    for domain, name in reversed(V.DASHBOARD_OUTLETS.items()):
        out = F.when(F.contains(host, F.lit(domain)), name).otherwise(out)
    return out


def outlet_counts(facts: DataFrame) -> DataFrame:
    return percentages(merged_counts(usable(facts).withColumn("outlet", outlet_name("feed_url")), "outlet"))


def comparable(counts: DataFrame, min_mentions: int = 3) -> DataFrame:
    """Entities that two outlets or more mention, each often enough; most mentioned first."""
    agg = counts.groupBy("merged").agg(F.count("*").alias("outlets"), F.min("total").alias("fewest"), F.sum("total").alias("total"))
    return agg.where((F.col("outlets") >= 2) & (F.col("fewest") >= min_mentions))


def framing_gap(counts: DataFrame, min_mentions: int = 3, similar: float = 5.0) -> DataFrame:
    """Entities of exactly two outlets: the larger first, the difference of their negative shares, and a verdict."""
    pair = comparable(counts, min_mentions).where("outlets = 2").select("merged")
    w = W.partitionBy("merged").orderBy(F.desc("total"), "outlet")
    rows = counts.join(pair, "merged", "left_semi").withColumn("r", F.row_number().over(w))
    one = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    agg = rows.groupBy("merged").agg(one("outlet", 1).alias("outlet_a"), one("outlet", 2).alias("outlet_b"), (one("negative_pct", 1) - one("negative_pct", 2)).alias("g"))
    gap = F.round("g", 4)
    verdict = F.when(F.abs(F.col("g")) < similar, "similar").when(F.col("g") > 0, F.concat("outlet_a", F.lit(" is more negative"))).otherwise(F.concat("outlet_b", F.lit(" is more negative")))
    return agg.select("merged", "outlet_a", "outlet_b", gap.alias("gap"), verdict.alias("verdict"))


def variants(facts: DataFrame, word: str) -> DataFrame:
    """Keys that end with a word, before merging."""
    return usable(facts).where((F.col("key") == word) | F.col("key").endswith(f" {word}")).groupBy("key").agg(F.count("*").alias("n"))
