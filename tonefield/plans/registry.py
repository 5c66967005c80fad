"""Queries over the test tables, each with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V

from ..operators import entities as E
from ..operators import evaluate as EV
from ..operators import leakage as L
from ..operators import marking as M
from ..operators import sampling as S
from ..operators import sentences as SE
from ..sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put

_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
_WORDS = lambda x: f"list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> '')"
USABLE = (
    A.MENTIONS
    + rf""",
entities AS (
  SELECT *, CASE WHEN len(embedded_entities) > 0 THEN trim(embedded_entities[1])
    WHEN len({_WORDS("target_text")}) BETWEEN 1 AND 3 AND substr(trim(target_text), 1, 1) = upper(substr(trim(target_text), 1, 1)) AND substr(trim(target_text), 1, 1) <> lower(substr(trim(target_text), 1, 1)) THEN trim(target_text) END AS entity
  FROM mentions),
usable AS (SELECT *, lower(entity) AS key FROM entities WHERE sentiment IS NOT NULL AND entity IS NOT NULL)"""
)
MERGED = (
    USABLE
    + rf""",
keys AS (SELECT DISTINCT key FROM usable),
suffixes AS (
  SELECT key, n, array_to_string(string_split(key, ' ')[-n:], ' ') AS suffix
  FROM (SELECT key, unnest(range(1, len(string_split(key, ' ')))) AS n FROM keys WHERE string_split(key, ' ')[1] NOT IN ({_quoted(V.INSTITUTIONAL_MODIFIERS)}))),
folded AS (SELECT s.key, arg_min(s.suffix, s.n) AS merged FROM suffixes s JOIN keys k ON k.key = s.suffix GROUP BY s.key),
mapping AS (SELECT k.key, coalesce(f.merged, k.key) AS merged FROM keys k LEFT JOIN folded f USING (key)),
facts AS (SELECT u.*, m.merged FROM usable u JOIN mapping m USING (key))"""
)
COUNTS = "sum((sentiment = 'Negative')::BIGINT)::BIGINT AS negative, sum((sentiment = 'Neutral')::BIGINT)::BIGINT AS neutral, sum((sentiment = 'Positive')::BIGINT)::BIGINT AS positive, count(*) AS total"
PCT = ", ".join(f"round(100.0::DOUBLE * {s} / total, 4) AS {s}_pct" for s in ("negative", "neutral", "positive"))
DAILY = MERGED + f""",
per_day AS (SELECT merged, substr(fetched_at, 1, 10) AS day, {COUNTS} FROM facts WHERE length(fetched_at) >= 10 GROUP BY 1, 2),
daily AS (SELECT *, {PCT} FROM per_day)"""
OUTLET = "CASE WHEN contains(h, 'npr.org') THEN 'NPR' WHEN contains(h, 'bbci.co.uk') THEN 'BBC' ELSE upper(string_split(h, '.')[1]) END"
OUTLETS = MERGED + rf""",
hosted AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(feed_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^feeds\.', ''), '^www\.', '') AS h FROM facts),
per_outlet AS (SELECT merged, {OUTLET} AS outlet, {COUNTS} FROM hosted GROUP BY 1, 2),
outlets AS (SELECT *, {PCT} FROM per_outlet),
comparable AS (SELECT merged, count(*) AS outlets, min(total) AS fewest, sum(total)::BIGINT AS total FROM outlets GROUP BY merged HAVING count(*) >= 2 AND min(total) >= 3)"""

@query(f"""WITH {MERGED},
agg AS (SELECT merged, arg_max(CASE WHEN key = merged THEN entity END, CASE WHEN key = merged THEN row_id END) AS entity, {COUNTS}, round(avg(coalesce(sentiment_confidence, 0)), 6) AS avg_confidence FROM facts GROUP BY merged)
SELECT *, {PCT} FROM agg WHERE total >= 3 ORDER BY total DESC, merged LIMIT 20""")
def entity_leaderboard(spark, sf_dir):
    return E.leaderboard(A.mentions(spark, sf_dir))

@query(f"WITH {MERGED} SELECT key, merged FROM mapping")
def alias_mapping(spark, sf_dir):
    return E.alias_mapping(E.usable(A.mentions(spark, sf_dir)))

@query(f"WITH {USABLE} SELECT count(*) AS records, (count(*) FILTER (sentiment IS NULL))::BIGINT AS no_prediction, (count(*) FILTER (sentiment IS NOT NULL AND entity IS NULL))::BIGINT AS not_entity_like FROM entities")
def skip_counters(spark, sf_dir):
    return E.skip_counters(A.mentions(spark, sf_dir))

@query(f"WITH {DAILY} SELECT * FROM daily")
def entity_daily_trend(spark, sf_dir):
    return E.daily(A.mentions(spark, sf_dir))

@query(f"WITH {DAILY} SELECT merged, count(*) AS days, sum(total)::BIGINT AS total, string_agg(day, ',' ORDER BY day) AS dates FROM daily GROUP BY merged HAVING count(*) >= 2 AND sum(total) >= 2")
def multi_day_entities(spark, sf_dir):
    return E.multi_day(A.mentions(spark, sf_dir))

@query(f"WITH {DAILY} SELECT merged, day, total, total < 10 AS thin FROM daily")
def thin_days(spark, sf_dir):
    return E.thin_days(A.mentions(spark, sf_dir))

@query(f"WITH {DAILY} SELECT * FROM daily WHERE merged = 'ring'")
def entity_trend(spark, sf_dir):
    return E.entity_trend(A.mentions(spark, sf_dir), "ring")

@query(f"WITH {A.MENTIONS} SELECT count(*) AS records, count(DISTINCT article_url) AS articles, count(DISTINCT substr(fetched_at, 1, 10)) AS days FROM mentions")
def dashboard_kpis(spark, sf_dir):
    return E.kpis(A.mentions(spark, sf_dir))

_LONG = "(SELECT {k}, total, unnest(['Negative', 'Neutral', 'Positive']) AS sentiment, unnest([negative, neutral, positive]) AS n FROM {t})"

@query(f"""WITH {MERGED}, agg AS (SELECT merged, {COUNTS} FROM facts GROUP BY merged), best AS (SELECT * FROM agg WHERE total >= 3 ORDER BY total DESC, merged LIMIT 20)
SELECT merged, sentiment, n, round(100.0::DOUBLE * n / total, 4) AS pct FROM {_LONG.format(k="merged", t="best")}""")
def leaderboard_pivot(spark, sf_dir):
    return E.long_shares(E.leaderboard(A.mentions(spark, sf_dir)), ["merged"])

@query(f"WITH {DAILY} SELECT merged, day, sentiment, n, round(100.0::DOUBLE * n / total, 4) AS pct FROM {_LONG.format(k='merged, day', t='daily')}")
def trend_percent(spark, sf_dir):
    return E.long_shares(E.daily(A.mentions(spark, sf_dir)), ["merged", "day"])

@query(f"""WITH {USABLE}, agg AS (SELECT article_url, key, arg_min(entity, row_id) AS entity, {COUNTS} FROM usable GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY article_url ORDER BY total DESC, key)::INTEGER AS rank FROM agg) SELECT * FROM ranked WHERE rank <= 8""")
def article_entity_summary(spark, sf_dir):
    return E.article_summary(A.mentions(spark, sf_dir))

@query(f"WITH {OUTLETS} SELECT * FROM outlets")
def outlet_entity_counts(spark, sf_dir):
    return E.outlet_counts(A.mentions(spark, sf_dir))

@query(f"WITH {OUTLETS} SELECT * FROM comparable")
def outlet_comparable(spark, sf_dir):
    return E.comparable(E.outlet_counts(A.mentions(spark, sf_dir)))

@query(f"WITH {OUTLETS} SELECT * FROM comparable ORDER BY total DESC, merged LIMIT 10")
def outlet_ranked(spark, sf_dir):
    return E.comparable(E.outlet_counts(A.mentions(spark, sf_dir))).orderBy(F.desc("total"), "merged").limit(10)

@query(f"""WITH {OUTLETS.replace(OUTLET, "CASE WHEN ends_with(h, 'com') THEN 'COM' WHEN ends_with(h, 'net') THEN 'NET' ELSE 'NET' END")},
ranked AS (SELECT o.*, row_number() OVER (PARTITION BY merged ORDER BY o.total DESC, outlet) AS r FROM outlets o JOIN comparable c USING (merged) WHERE c.outlets = 2),
pairs AS (SELECT merged, max(CASE WHEN r = 1 THEN outlet END) AS outlet_a, max(CASE WHEN r = 2 THEN outlet END) AS outlet_b, max(CASE WHEN r = 1 THEN negative_pct END) - max(CASE WHEN r = 2 THEN negative_pct END) AS g FROM ranked GROUP BY merged)
SELECT merged, outlet_a, outlet_b, round(g, 4) AS gap, CASE WHEN abs(g) < 5 THEN 'similar' WHEN g > 0 THEN outlet_a || ' is more negative' ELSE outlet_b || ' is more negative' END AS verdict FROM pairs""")
def framing_gap(spark, sf_dir):
    """Two outlets: hosts under com, and all others."""
    facts = E.usable(A.mentions(spark, sf_dir)).withColumn("outlet", F.when(T.netloc("feed_url").endswith("com"), "COM").otherwise("NET"))
    return E.framing_gap(E.percentages(E.merged_counts(facts, "outlet")))

@query(f"WITH {USABLE} SELECT key, count(*) AS n FROM usable WHERE key = 'ring' OR ends_with(key, ' ring') GROUP BY key")
def entity_variants(spark, sf_dir):
    return E.variants(A.mentions(spark, sf_dir), "ring")

_RECORD = "substr(sha1(article_url || '|' || sentence || '|' || target_text), 1, 10)"

@query(f"WITH {A.MENTIONS} SELECT row_id, {_RECORD} AS record_id FROM mentions")
def record_ids(spark, sf_dir):
    return A.mentions(spark, sf_dir).select("row_id", S.record_id(F.col("article_url"), F.col("sentence"), F.col("target_text")).alias("record_id"))

@query(f"""WITH {A.MENTIONS},
ids AS (SELECT {_RECORD} AS record_id, regexp_extract(feed_url, '://([^/?#]*)', 1) AS outlet, sentence, target_text, min(sentiment) AS sentiment FROM mentions WHERE sentiment IS NOT NULL GROUP BY ALL),
capped AS (SELECT *, sha1('13|' || record_id) AS s, row_number() OVER (PARTITION BY sentence ORDER BY sha1('13|' || record_id), record_id) AS k FROM ids),
pool AS (SELECT * FROM capped WHERE k <= 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY outlet, sentiment ORDER BY s, record_id) AS r, round_even(150.0 * CASE WHEN sentiment = 'Neutral' THEN 1 ELSE 2 END / (5 * (SELECT count(DISTINCT outlet) FROM pool)), 0) AS quota FROM pool)
SELECT record_id, outlet, sentiment, sentence, target_text FROM ranked ORDER BY (r > quota)::INTEGER, s, record_id LIMIT 150""")
def stratified_sample(spark, sf_dir):
    return S.stratified(A.mentions(spark, sf_dir))

@query(f"""WITH {A.MENTIONS}, hashed AS (SELECT row_id, role, extraction_confidence, sha1('13|' || row_id::VARCHAR) AS s FROM mentions),
ranked AS (SELECT *, row_number() OVER (PARTITION BY role, extraction_confidence ORDER BY s) AS r FROM hashed)
SELECT row_id, role, extraction_confidence FROM ranked WHERE r <= greatest(1, 40 // (SELECT count(*) FROM (SELECT DISTINCT role, extraction_confidence FROM hashed))) ORDER BY s LIMIT 40""")
def bucket_sample(spark, sf_dir):
    return S.buckets(A.mentions(spark, sf_dir))

@query(f"WITH {A.MENTIONS} SELECT row_id FROM mentions ORDER BY sha1('13|' || row_id::VARCHAR) LIMIT 15")
def simple_sample(spark, sf_dir):
    return S.simple(A.mentions(spark, sf_dir))

@query(f"WITH {A.SENTENCES} SELECT doc_id, lang, line::INTEGER AS line, pos::INTEGER AS pos, sentence FROM sentences")
def sentence_split(spark, sf_dir):
    return A.sentences(spark, sf_dir)

@query(f"""WITH {A.SENTENCES}, n AS (SELECT len({_WORDS("sentence")})::INTEGER AS n FROM sentences), l AS (SELECT list_sort(list(n)) AS l FROM n)
SELECT l[1] AS fewest, l[len(l) // 2 + 1] AS median, l[-1] AS most, round(list_sum(l)::DOUBLE / len(l), 4) AS mean FROM l""")
def sentence_lengths(spark, sf_dir):
    return SE.length_stats(A.sentences(spark, sf_dir), "sentence")

def _html_sql() -> str:
    t = "html"
    for tag in ("script", "style", "nav", "head"):
        t = rf"regexp_replace({t}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{char}')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"

@query(f"SELECT page_id, {_html_sql()} AS text FROM pages")
def html_text(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", SE.html_to_text("html").alias("text"))

_GID = "('src_' || (conv_id % 7) || '_' || conv_id || '_' || turn || '_' || role || '_x_' || turn || '_' || (turn + length(role)))"

@query(f"""WITH g AS (SELECT string_split({_GID}, '_') AS p FROM conversations)
SELECT array_to_string(p[1:3], '_') AS article_id, TRY_CAST(p[4] AS INTEGER) AS sentence_index, array_to_string(p[5:-3], '_') AS mention, TRY_CAST(p[-2] AS INTEGER) AS start, TRY_CAST(p[-1] AS INTEGER) AS stop FROM g""")
def gid_parse(spark, sf_dir):
    from ..sources.readers import parse_gid

    return _gids(spark, sf_dir).select(parse_gid("gid").alias("g")).select("g.*")

def _gids(spark, sf_dir):
    turn = F.col("turn").cast("string")
    gid = F.concat(F.lit("src_"), (F.col("conv_id") % 7).cast("string"), F.lit("_"), F.col("conv_id").cast("string"), F.lit("_"), turn, F.lit("_"), F.col("role"), F.lit("_x_"), turn, F.lit("_"), (F.col("turn") + F.length("role")).cast("string"))
    return A.table(spark, sf_dir, "conversations").select(gid.alias("gid"), F.col("text").alias("sentence"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("role").alias("target"))

@query(f"""WITH g AS (SELECT string_split({_GID}, '_') AS p, text AS sentence, role AS target, conv_id * 1000 + turn AS row_id FROM conversations WHERE text <> ''),
r AS (SELECT array_to_string(p[1:3], '_') AS article_id, TRY_CAST(p[4] AS INTEGER) AS sentence_index, sentence, target, row_id FROM g)
SELECT article_id, sentence_index, arg_min(sentence, row_id) AS sentence, string_agg(target, ',' ORDER BY row_id) AS targets FROM r GROUP BY 1, 2""")
def article_group(spark, sf_dir):
    from ..sources.readers import group_articles

    out = group_articles(_gids(spark, sf_dir).select("gid", "sentence", "row_id", F.array("target").alias("targets")))
    return out.withColumn("targets", F.array_join("targets", ","))

@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & Co. ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def canonical_slug(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" & Co. "), "p_brand")).alias("slug"))

@query(rf"""WITH {A.SENTENCES} SELECT doc_id, line::INTEGER AS line, pos::INTEGER AS pos, array_to_string(list_filter(list_transform({_WORDS("sentence")}, lambda w: trim(w, '.,!?;:"''()[]{{}}')), lambda w: list_contains([{_quoted(V.PRONOUNS)}], lower(w))), ' ') AS pronouns
FROM sentences WHERE lang = 'en'""")
def embedded_pronouns(spark, sf_dir):
    from ..operators.references import embedded_pronouns as found

    return A.sentences(spark, sf_dir).where("lang = 'en'").select("doc_id", "line", "pos", F.array_join(found("sentence"), " ").alias("pronouns"))

@query(rf"""WITH base AS (SELECT event_id, (['the company''s', 'The  firm', 'the nation’s', 'a company', 'the ring', '(the country)'])[event_id % 6 + 1] || ' cut its prices in the government' AS phrase FROM events),
w AS (SELECT event_id, list_transform({_WORDS("phrase")}, lambda w: trim(w, '.,!?;:"''()[]{{}}')) AS w FROM base),
h AS (SELECT event_id, w, list_transform(w, lambda x: regexp_replace(lower(x), '[''’]s$', '')) AS head FROM w)
SELECT event_id, array_to_string(list_transform(list_filter(range(1, len(w)), lambda i: lower(w[i]) = 'the' AND list_contains([{_quoted(V.GENERIC_HEAD_TYPES)}], head[i + 1])), lambda i: w[i] || ' ' || w[i + 1]), '|') AS found FROM h""")
def embedded_generics(spark, sf_dir):
    from ..operators.references import embedded_generics as found

    forms = F.array(*map(F.lit, ("the company's", "The  firm", "the nation’s", "a company", "the ring", "(the country)")))
    rows = A.table(spark, sf_dir, "events").select("event_id", F.concat(F.get(forms, (F.col("event_id") % 6).cast("int")), F.lit(" cut its prices in the government")).alias("phrase"))
    return rows.select("event_id", F.array_join(F.transform(found("phrase"), lambda x: x["surface"]), "|").alias("found"))

@query(r"""WITH base AS (SELECT event_id, (['“', '"', ' ', '', '`'])[event_id % 5 + 1] || p_name || (['"', ' ''', ',', '  ', '”'])[event_id % 5 + 1] AS raw FROM events JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part))
SELECT event_id, regexp_replace(regexp_replace(raw, '^[\s"''“”‘’`´]+|[\s"''“”‘’`´]+$', '', 'g'), '\s+', ' ', 'g') AS candidate FROM base""")
def candidate_normalise(spark, sf_dir):
    return _framed(spark, sf_dir, ("“", '"', " ", "", "`"), ('"', " '", ",", "  ", "”")).select("event_id", T.normalise_candidate("raw").alias("candidate"))

def _framed(spark, sf_dir, left, right):
    part = A.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = part.count()
    events = A.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % n).alias("p_partkey"))
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("event_id") % len(xs)).cast("int"))
    return events.join(part, "p_partkey").select("event_id", F.concat(pick(left), "p_name", pick(right)).alias("raw"))

@query("""WITH base AS (SELECT event_id, p_name, event_id % 6 AS k FROM events JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part))
SELECT event_id, CASE k WHEN 5 THEN '(' || p_name || ')' ELSE p_name END AS cleaned FROM base""")
def clean_punctuation(spark, sf_dir):
    """Frames of orphaned punctuation come off; a real pair of parentheses stays."""
    return _framed(spark, sf_dir, ("", "(", "— ", "“", "", "("), (" ( )", "", " —", "", " ”", ")")).select("event_id", T.clean_edges("raw").alias("cleaned"))

@query(rf"""WITH {A.MENTIONS} SELECT row_id, CASE WHEN contains(sentence, target_text) THEN target_text END AS located,
  CASE WHEN contains(sentence, target_text) THEN trim(rtrim(substr(sentence, 1, position(target_text IN sentence) - 1)) || ' [TARGET] ' || target_text || ' [/TARGET] ' || ltrim(substr(sentence, position(target_text IN sentence) + length(target_text)))) END AS marked,
  sentence || ' [TARGET] ' || target_text AS baseline FROM mentions""")
def mark_target(spark, sf_dir):
    s, t = F.col("sentence"), F.col("target_text")
    return A.mentions(spark, sf_dir).select("row_id", M.locate_target(s, t).alias("located"), M.mark_target(s, t).alias("marked"), M.baseline_text(s, t).alias("baseline"))

@query("""SELECT p_partkey, p_name || ', sold' AS sentence, replace(p_name, ' ', ', ') || ' and more' AS listed, replace(p_name, ' ', ', ') AS located FROM part WHERE contains(p_name, ' ')""")
def locate_target(spark, sf_dir):
    """A target without its separators is found in a sentence that has them."""
    part = A.table(spark, sf_dir, "part").where(F.contains("p_name", F.lit(" ")))
    listed = F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(" and more"))
    return part.select("p_partkey", F.concat("p_name", F.lit(", sold")).alias("sentence"), listed.alias("listed"), M.locate_target(listed, F.col("p_name")).alias("located"))

_LABELLED = A.MENTIONS + """,
gold AS (SELECT gid AS sentence_key, t.pos AS gold_pos, t.target AS gold_target, t.polarity FROM (
  SELECT p_partkey AS gid, unnest([{'pos': 0, 'target': upper(p_name), 'polarity': 2.0::DOUBLE}, {'pos': 1, 'target': regexp_extract(p_name, '[^ ]*$'), 'polarity': 6.0::DOUBLE}]) AS t FROM part WHERE p_partkey % 2 = 0)),
keyed AS (SELECT *, row_id % (SELECT count(*) FROM part) AS sentence_key FROM mentions),
labelled AS (SELECT k.row_id, k.sentiment, (SELECT arg_min(polarity, gold_pos) FROM gold g WHERE g.sentence_key = k.sentence_key AND lower(g.gold_target) = lower(k.target_text)) AS e,
  (SELECT arg_min(polarity, gold_pos) FROM gold g WHERE g.sentence_key = k.sentence_key AND list_contains(list_transform(k.embedded_entities, lambda x: lower(x)), lower(g.gold_target))) AS n FROM keyed k),
matched AS (SELECT row_id, sentiment, CASE WHEN e IS NOT NULL THEN 'gold_exact' WHEN n IS NOT NULL THEN 'gold_embedded_or_resolved' ELSE 'needs_annotation' END AS label_source, coalesce(e, n) AS sentiment_label FROM labelled)"""

def _labelled(spark, sf_dir):
    part = A.table(spark, sf_dir, "part")
    n = part.count()
    pairs = F.array(F.struct(F.lit(0).alias("pos"), F.upper("p_name").alias("target"), F.lit(2.0).alias("polarity")), F.struct(F.lit(1).alias("pos"), F.substring_index("p_name", " ", -1).alias("target"), F.lit(6.0).alias("polarity")))
    gold = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("sentence_key"), F.explode(pairs).alias("t")).select("sentence_key", F.col("t.pos").alias("gold_pos"), F.col("t.target").alias("gold_target"), "t.polarity")
    rows = A.mentions(spark, sf_dir).select("row_id", "sentiment", "target_text", F.col("embedded_entities").alias("pool"), (F.col("row_id") % n).alias("sentence_key"))
    return M.gold_label(rows, gold, ["sentence_key"])

@query(f"WITH {_LABELLED} SELECT row_id, label_source, sentiment_label FROM matched")
def gold_label_match(spark, sf_dir):
    return _labelled(spark, sf_dir).select("row_id", "label_source", "sentiment_label")

@query(f"WITH {_LABELLED} SELECT label_source, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM matched), 4) AS pct FROM matched GROUP BY 1")
def label_source_breakdown(spark, sf_dir):
    return M.breakdown(_labelled(spark, sf_dir), "label_source")

_POLARITY_SQL = "CASE sentiment WHEN 'Negative' THEN 2.0 WHEN 'Neutral' THEN 4.0 WHEN 'Positive' THEN 6.0 END"

@query(f"WITH {_LABELLED} SELECT CASE WHEN sentiment_label IS NOT NULL THEN sentiment_label = {_POLARITY_SQL} END AS agrees, count(*) AS n FROM matched GROUP BY 1")
def agreement(spark, sf_dir):
    number = F.create_map(*[F.lit(x) for kv in V.POLARITY.items() for x in kv])
    return _labelled(spark, sf_dir).groupBy(M.agreement(F.col("sentiment_label"), F.try_element_at(number, "sentiment")).alias("agrees")).agg(F.count("*").alias("n"))

@query(f"WITH {A.GOLD} SELECT gold, predicted, count(*) AS n FROM gold GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return EV.confusion(A.gold(spark, sf_dir))

_PER_CLASS = A.GOLD + """,
labels_ AS (SELECT gold AS label FROM gold UNION SELECT predicted FROM gold),
cells AS (SELECT label, (SELECT count(*) FROM gold WHERE gold = label AND predicted = label) AS tp, (SELECT count(*) FROM gold WHERE predicted = label) AS predicted_n, (SELECT count(*) FROM gold WHERE gold = label) AS support FROM labels_),
per_class AS (SELECT *, round(CASE WHEN predicted_n > 0 THEN tp::DOUBLE / predicted_n END, 6) AS precision, round(CASE WHEN support > 0 THEN tp::DOUBLE / support END, 6) AS recall,
  round(CASE WHEN predicted_n + support > 0 THEN 2.0::DOUBLE * tp / (predicted_n + support) END, 6) AS f1 FROM cells)"""

@query(f"WITH {_PER_CLASS} SELECT * FROM per_class")
def precision_recall(spark, sf_dir):
    return EV.per_class(A.gold(spark, sf_dir))

@query(f"WITH {A.GOLD} SELECT source, count(*) AS n, sum((gold = predicted)::BIGINT)::BIGINT AS correct, round(sum((gold = predicted)::BIGINT)::DOUBLE / count(*), 6) AS accuracy FROM gold GROUP BY 1")
def accuracy_by_group(spark, sf_dir):
    return EV.accuracy(A.gold(spark, sf_dir), "source")

@query(f"WITH {A.GOLD} SELECT extraction_confidence, count(*) AS n, sum((gold = predicted)::BIGINT)::BIGINT AS correct, round(sum((gold = predicted)::BIGINT)::DOUBLE / count(*), 6) AS accuracy FROM gold GROUP BY 1")
def accuracy_by_confidence(spark, sf_dir):
    return EV.accuracy(A.gold(spark, sf_dir), "extraction_confidence")

@query(f"WITH {_PER_CLASS} SELECT count(*) AS classes, round(avg(coalesce(f1, 0)), 5) AS macro_f1 FROM per_class WHERE support > 0")
def macro_f1(spark, sf_dir):
    return EV.macro_f1(A.gold(spark, sf_dir))

@query(f"WITH {A.GOLD} SELECT * FROM gold WHERE gold <> predicted")
def misclassified(spark, sf_dir):
    return EV.misclassified(A.gold(spark, sf_dir))

@query(f"WITH {A.GOLD} SELECT lang, gold AS label, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY lang), 4) AS pct FROM gold GROUP BY lang, gold")
def polarity_distribution(spark, sf_dir):
    n = A.gold(spark, sf_dir).groupBy("lang", F.col("gold").alias("label")).agg(F.count("*").alias("n"))
    total = n.groupBy("lang").agg(F.sum("n").alias("total"))
    return n.join(total, "lang").select("lang", "label", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))

@query(f"WITH {A.MENTIONS} SELECT sentence, target_text, count(DISTINCT sentiment) AS labels, count(*) AS n FROM mentions GROUP BY 1, 2 HAVING count(DISTINCT sentiment) > 1")
def label_conflicts(spark, sf_dir):
    return L.label_conflicts(A.mentions(spark, sf_dir), ["sentence", "target_text"], "sentiment")

@query(f"""WITH {A.MENTIONS}, w AS (SELECT target_text, {_WORDS("target_text")} AS w FROM mentions)
SELECT count(*) AS total, count(DISTINCT target_text) AS distinct_targets, round(avg(len(w)), 4) AS mean_words, sum((len(w) = 1)::BIGINT)::BIGINT AS single_word, sum((len(w) > 1)::BIGINT)::BIGINT AS multi_word,
  sum((list_contains([{_quoted(V.PRONOUNS)}], lower(target_text)))::BIGINT)::BIGINT AS pronouns, sum((list_has_any([{_quoted(V.COMMON_TARGET_WORDS)}], list_transform(w, lambda x: lower(x))))::BIGINT)::BIGINT AS common_words FROM w""")
def target_profile(spark, sf_dir):
    t, w = F.col("target_text"), T.words("target_text")
    flag = lambda c: F.sum(c.cast("long"))
    return A.mentions(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count_distinct(t).alias("distinct_targets"), F.round(F.avg(F.size(w)), 4).alias("mean_words"), flag(F.size(w) == 1).alias("single_word"), flag(F.size(w) > 1).alias("multi_word"),
        flag(F.lower(t).isin(*V.PRONOUNS)).alias("pronouns"), flag(F.arrays_overlap(F.transform(w, lambda x: F.lower(x)), F.array(*map(F.lit, V.COMMON_TARGET_WORDS)))).alias("common_words"),
    )

@query(f"WITH {A.MENTIONS} SELECT target_text, count(*) AS n FROM mentions GROUP BY 1 ORDER BY n DESC, target_text LIMIT 30")
def frequent_targets(spark, sf_dir):
    return A.mentions(spark, sf_dir).groupBy("target_text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_text").limit(30)

@query("SELECT text FROM documents WHERE lang = 'en' INTERSECT SELECT text FROM documents WHERE lang <> 'en'")
def split_overlap(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return L.overlap(d.where("lang = 'en'"), d.where("lang <> 'en'"), ["text"])

@query("SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_rows, (sum(n) - count(*))::BIGINT AS duplicates FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)")
def exact_duplicates(spark, sf_dir):
    return L.duplicate_counts(A.table(spark, sf_dir, "documents"), ["text"])

@query("""WITH t AS (SELECT item_id AS id, text FROM benchmark), tf AS (
  SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_à-öø-ÿ]+'), lambda x: length(x) >= 2)) AS term FROM t) GROUP BY 1, 2),
qtf AS (SELECT id, term, count(*) AS tf FROM (SELECT conv_id * 1000 + turn AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_à-öø-ÿ]+'), lambda x: length(x) >= 2)) AS term FROM conversations) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM t),
x AS (SELECT id, term, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term), n), w AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM x),
qx AS (SELECT id, term, tf * (ln((1.0::DOUBLE + n) / (1 + coalesce(df, 0))) + 1) AS x FROM (SELECT * FROM qtf LEFT JOIN df USING (term)), n), qw AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM qx),
s AS (SELECT qw.id AS query, w.id AS id, round(sum(qw.w * w.w), 6) AS similarity FROM qw JOIN w USING (term) GROUP BY 1, 2),
b AS (SELECT query, id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS r FROM s)
SELECT query, id, similarity FROM b WHERE r = 1 ORDER BY similarity DESC, query LIMIT 20""")
def near_duplicates(spark, sf_dir):
    """Conversation turns against the benchmark."""
    bench = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    turns = A.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return L.nearest(turns, bench, "id", "text")

@query()
def near_duplicates_documents(spark, sf_dir):
    """All documents against the benchmark: where its passages leak. No SQL: a test holds it against brute force."""
    bench = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    documents = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return L.nearest(documents, bench, "id", "text")

@query("SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM (SELECT url AS u FROM pages WHERE page_id % 3 = 0) s WHERE s.u = p.url)")
def seen_url_anti(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.join(pages.where("page_id % 3 = 0").select("url"), "url", "left_anti").select("page_id", "url")


@query(f"WITH {A.MENTIONS} SELECT len({_WORDS('target_text')})::INTEGER AS words, count(*) AS n FROM mentions GROUP BY 1")
def target_word_histogram(spark, sf_dir):
    return A.mentions(spark, sf_dir).groupBy(T.word_count("target_text").alias("words")).agg(F.count("*").alias("n"))


@query(f"WITH {A.SENTENCES} SELECT DISTINCT sentence, length(sentence)::INTEGER AS n FROM sentences ORDER BY n DESC, sentence LIMIT 20")
def longest_sentences(spark, sf_dir):
    rows = A.sentences(spark, sf_dir).select("sentence", F.length("sentence").alias("n")).distinct()
    return rows.orderBy(F.desc("n"), "sentence").limit(20)


@query("WITH x AS (SELECT d.doc_id, d.text, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT a.text, max(a.quality) AS quality_a, max(b.quality) AS quality_b, max(a.quality) = max(b.quality) AS agrees FROM x a JOIN x b ON a.text = b.text WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 GROUP BY a.text")
def overlap_label_agreement(spark, sf_dir):
    """Texts in both halves, and whether their labels agree; each half is reduced to a row a text before they meet."""
    rows = A.table(spark, sf_dir, "documents").select("doc_id", "text").join(A.table(spark, sf_dir, "labels"), "doc_id", "left")
    half = lambda k, name: rows.where(F.col("doc_id") % 2 == k).groupBy("text").agg(F.max("quality").alias(name))
    return half(0, "quality_a").join(half(1, "quality_b"), "text").withColumn("agrees", F.col("quality_a") == F.col("quality_b"))


@query(f"WITH {A.GOLD} SELECT lang, count(*) AS n, sum((gold = predicted)::BIGINT)::BIGINT AS correct, round(sum((gold = predicted)::BIGINT)::DOUBLE / count(*), 6) AS accuracy FROM gold GROUP BY 1")
def accuracy_by_language(spark, sf_dir):
    return EV.accuracy(A.gold(spark, sf_dir), "lang")


@query("SELECT conv_id, turn, text FROM conversations WHERE regexp_matches(text, ' ([,.;!?]|''s)') OR contains(text, '  ')")
def spacing_artifacts(spark, sf_dir):
    """Data quality: blanks before punctuation or a possessive, and double blanks."""
    bad = F.col("text").rlike(" ([,.;!?]|'s)") | F.contains("text", F.lit("  "))
    return A.table(spark, sf_dir, "conversations").where(bad).select("conv_id", "turn", "text")
