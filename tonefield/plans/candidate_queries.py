"""Queries over candidates: spans, recall, ranking and its errors, match tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import candidates as C
from ..operators import evaluate as EV
from ..sources import adapters as A
from .registry import _WORDS, _quoted, query

KEYS = ["doc_id", "line", "pos"]
_EDGE = """'.,!?;:"''()[]{}'"""
_CAPS = "substr({0}, 1, 1) = upper(substr({0}, 1, 1)) AND substr({0}, 1, 1) <> lower(substr({0}, 1, 1))"
TOKENS = A.SENTENCES + rf""",
pieces AS (SELECT doc_id, line::INTEGER AS line, pos::INTEGER AS pos, sentence, unnest(string_split(sentence, ' ')) AS raw, (generate_subscripts(string_split(sentence, ' '), 1) - 1)::INTEGER AS i FROM sentences),
placed AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id, line, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(raw) - length(ltrim(raw, {_EDGE})) AS start, trim(raw, {_EDGE}) AS token FROM pieces),
tokens AS (SELECT doc_id, line, pos, sentence, i, token, start::INTEGER AS start, (start + length(token))::INTEGER AS stop FROM placed WHERE token <> ''),
caps AS (SELECT * FROM tokens WHERE {_CAPS.format("token")}),
runs AS (SELECT doc_id, line, pos, sentence, substr(sentence, min(start) + 1, max(stop) - min(start)) AS candidate, min(start) AS start, max(stop) AS stop
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, line, pos ORDER BY i) AS g FROM caps) GROUP BY doc_id, line, pos, sentence, g)"""
CANDIDATES = TOKENS + rf""",
normed AS (SELECT *, regexp_replace(regexp_replace(candidate, '^[\s"''“”‘’`´]+|[\s"''“”‘’`´]+$', '', 'g'), '\s+', ' ', 'g') AS n FROM runs),
titled AS (SELECT doc_id, line, pos, start, lag(token) OVER w AS title, lag(start) OVER w AS title_start FROM tokens WINDOW w AS (PARTITION BY doc_id, line, pos ORDER BY i)),
every AS (
  SELECT doc_id, line, pos, sentence, candidate, start, stop, 'NER' AS source, 0 AS gen FROM runs
  UNION ALL SELECT doc_id, line, pos, sentence, n, position(n IN sentence) - 1, position(n IN sentence) - 1 + length(n), 'NER_NORMALIZED', 1 FROM normed WHERE n <> candidate AND n <> '' AND contains(sentence, n)
  UNION ALL SELECT c.doc_id, c.line, c.pos, c.sentence, c.token, c.start, c.stop, 'SUBSPAN_TOKEN', 2 FROM caps c JOIN runs r ON c.doc_id = r.doc_id AND c.line = r.line AND c.pos = r.pos AND c.start >= r.start AND c.stop <= r.stop AND c.stop - c.start < r.stop - r.start
  UNION ALL SELECT doc_id, line, pos, sentence, token, start, stop, 'PRONOUN', 3 FROM tokens WHERE lower(token) IN ({_quoted(V.RANKER_PRONOUNS)})
  UNION ALL SELECT r.doc_id, r.line, r.pos, r.sentence, substr(r.sentence, t.title_start + 1, r.stop - t.title_start), t.title_start, r.stop, 'TITLE_EXPANSION', 4 FROM titled t JOIN runs r ON t.doc_id = r.doc_id AND t.line = r.line AND t.pos = r.pos AND t.start = r.start WHERE lower(t.title) IN ({_quoted(V.HONORIFICS)})),
candidates AS (SELECT doc_id, line, pos, sentence, candidate, start::INTEGER AS start, stop::INTEGER AS stop, arg_min(source, gen) AS source FROM every WHERE start >= 0 AND stop > start GROUP BY ALL),
firsts AS (SELECT doc_id, line, pos, arg_min(token, i) AS gold FROM tokens GROUP BY 1, 2, 3),
labelled AS (SELECT c.*, f.gold, (lower(trim(c.candidate)) = lower(f.gold))::INTEGER AS label FROM candidates c JOIN firsts f USING (doc_id, line, pos)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line, pos ORDER BY (CASE WHEN source = 'NER' THEN 100 ELSE 0 END + 2 * length(candidate) - start) DESC, start, stop, candidate)::INTEGER AS rank FROM labelled),
ranks AS (SELECT doc_id, line, pos, min(CASE WHEN label = 1 THEN rank END) AS rank FROM ranked GROUP BY 1, 2, 3)"""


def _found(spark, sf_dir):
    """A row a sentence; the first token stands for its gold target."""
    return C.with_candidates(A.sentences(spark, sf_dir), KEYS).withColumnRenamed("first", "gold")


def _labelled(spark, sf_dir, with_sentence=False):
    """Candidates with their label; with_sentence: and the sentence."""
    rows = _found(spark, sf_dir).select(*KEYS, *["sentence"] * with_sentence, "gold", F.inline("candidates"))
    return rows.withColumn("label", (F.lower(F.trim("candidate")) == F.lower("gold")).cast("int")).drop("gold")


def _ranked(spark, sf_dir):
    """candidates in the order of a score. A linear score in whole numbers stands in for a trained ranker, so that SQL gives the same order."""
    score = lambda x: F.when(x["source"] == "NER", 100).otherwise(0) + 2 * F.length(x["candidate"]) - x["start"]
    placed = F.transform("candidates", lambda x: F.struct((-score(x)).alias("order"), *[x[k].alias(k) for k in ("start", "stop", "candidate", "source")]))
    return _found(spark, sf_dir).select(*KEYS, "gold", F.sort_array(placed).alias("candidates"))


def _counts(spark, sf_dir):
    return _found(spark, sf_dir).select(F.size("candidates").alias("n"))


@query(f"WITH {CANDIDATES} SELECT doc_id, line, pos, candidate, start, stop, source, label FROM labelled")
def candidate_rows(spark, sf_dir):
    return _labelled(spark, sf_dir).select(*KEYS, "candidate", "start", "stop", "source", "label")


_STATS = f"""count(*) AS n, sum(label)::BIGINT AS positive, round(avg(label), 6) AS rate, round(avg(start), 4) AS mean_start, round(avg(start::DOUBLE / greatest(length(sentence), 1)), 4) AS mean_relative_start,
round(avg(length(candidate)), 4) AS mean_length, round(avg(len({_WORDS("candidate")})), 4) AS mean_words"""


@query(f"WITH {CANDIDATES} SELECT source, {_STATS} FROM labelled GROUP BY source")
def candidate_signal_stats(spark, sf_dir):
    return C.signal_stats(_labelled(spark, sf_dir, True), "source")


@query(f"WITH {CANDIDATES} SELECT CASE WHEN length(candidate) <= 5 THEN 'short' WHEN length(candidate) <= 15 THEN 'medium' ELSE 'long' END AS bucket, {_STATS} FROM labelled GROUP BY 1")
def candidate_length_stats(spark, sf_dir):
    n = F.length("candidate")
    return C.signal_stats(_labelled(spark, sf_dir, True), F.when(n <= 5, "short").when(n <= 15, "medium").otherwise("long").alias("bucket"))


@query(f"""WITH {CANDIDATES}, n AS (SELECT count(*) AS n FROM candidates GROUP BY doc_id, line, pos)
SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 30 THEN '21-30' ELSE '31+' END AS bucket, count(*) AS sentences, min(n) AS fewest, max(n) AS most FROM n GROUP BY 1""")
def candidate_count_buckets(spark, sf_dir):
    return C.count_buckets(_counts(spark, sf_dir))


@query(f"""WITH {CANDIDATES}, n AS (SELECT count(*) AS n FROM candidates GROUP BY doc_id, line, pos)
SELECT count(*) AS sentences, min(n) AS fewest, max(n) AS most, round(avg(n), 6) AS mean, round(median(n), 6) AS median FROM n""")
def candidate_count_stats(spark, sf_dir):
    return C.count_stats(_counts(spark, sf_dir))


@query(f"WITH {CANDIDATES}, kinds AS (SELECT *, CASE WHEN source IN ('NER', 'NER_NORMALIZED') THEN 'ORG' WHEN source = 'TITLE_EXPANSION' THEN 'PERSON' ELSE 'NONE' END AS ner_label FROM labelled) SELECT ner_label, {_STATS} FROM kinds GROUP BY ner_label")
def candidate_ner_stats(spark, sf_dir):
    """Runs count as organisations, titled ones as persons; candidates without a label as NONE."""
    source = F.col("source")
    ner = F.when(source.isin("NER", "NER_NORMALIZED"), "ORG").when(source == "TITLE_EXPANSION", "PERSON")
    return C.signal_stats(_labelled(spark, sf_dir, True), F.coalesce(ner, F.lit("NONE")).alias("ner_label"))


def _golds(spark, sf_dir):
    """Every token is a gold span."""
    return C.tokens(A.sentences(spark, sf_dir), KEYS).select(*KEYS, F.col("start").alias("g_start"), F.col("stop").alias("g_end"), "token")


def _key(df):
    return df.withColumn("key", F.struct(*KEYS)).drop(*KEYS)


_GOLD_SPANS = TOKENS + ", gold AS (SELECT doc_id, line, pos, start AS g_start, stop AS g_end, token FROM tokens)"


@query(f"""WITH {_GOLD_SPANS}, hits AS (SELECT g.doc_id, g.line, g.pos, g.g_start, g.g_end, max(CASE WHEN r.start = g.g_start AND r.stop = g.g_end THEN 2 WHEN r.start < g.g_end AND r.stop > g.g_start THEN 1 ELSE 0 END) AS best
  FROM gold g LEFT JOIN runs r USING (doc_id, line, pos) GROUP BY ALL)
SELECT doc_id, line, pos, g_start, g_end, CASE best WHEN 2 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'missed' END AS "match" FROM hits""")
def span_match(spark, sf_dir):
    spans = C.capitalised_runs(A.sentences(spark, sf_dir), KEYS).select(*KEYS, F.col("start").alias("s_start"), F.col("stop").alias("s_end"))
    return EV.span_match(_key(_golds(spark, sf_dir).drop("token")), _key(spans), "key").select("key.*", "g_start", "g_end", "match")


@query(f"""WITH {CANDIDATES}, gold AS (SELECT doc_id, line, pos, start, stop FROM tokens),
hits AS (SELECT g.doc_id, g.line, g.pos, g.start, g.stop, max((coalesce(c.source, '') = 'NER')::INTEGER) AS named, max((coalesce(c.source, '') IN ('NER', 'SUBSPAN_TOKEN'))::INTEGER) AS with_subspans,
  max((coalesce(c.source, '') IN ('NER', 'SUBSPAN_TOKEN', 'PRONOUN'))::INTEGER) AS with_pronouns FROM gold g LEFT JOIN candidates c ON g.doc_id = c.doc_id AND g.line = c.line AND g.pos = c.pos AND g.start = c.start AND g.stop = c.stop GROUP BY ALL)
SELECT count(*) AS gold, sum(named)::BIGINT AS named, sum(with_subspans)::BIGINT AS with_subspans, sum(with_pronouns)::BIGINT AS with_pronouns FROM hits""")
def candidate_recall_nested(spark, sf_dir):
    spans = C.candidate_rows(A.sentences(spark, sf_dir), KEYS).select(*KEYS, F.col("start").alias("s_start"), F.col("stop").alias("s_end"), "source")
    tiers = [("named", ["NER"]), ("with_subspans", ["NER", "SUBSPAN_TOKEN"]), ("with_pronouns", ["NER", "SUBSPAN_TOKEN", "PRONOUN"])]
    return EV.nested_recall(_key(_golds(spark, sf_dir).drop("token")), _key(spans), "key", tiers)


@query(f"""WITH {_GOLD_SPANS} SELECT lower(token) AS word, count(*) AS n FROM gold g WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = g.doc_id AND r.line = g.line AND r.pos = g.pos AND r.start < g.g_end AND r.stop > g.g_start)
GROUP BY 1 ORDER BY n DESC, word LIMIT 30""")
def missed_targets(spark, sf_dir):
    spans = C.capitalised_runs(A.sentences(spark, sf_dir), KEYS).select(*KEYS, F.col("start").alias("a"), F.col("stop").alias("b"))
    gold = _golds(spark, sf_dir)
    missed = gold.join(spans, [gold[k] == spans[k] for k in KEYS] + [F.col("a") < F.col("g_end"), F.col("b") > F.col("g_start")], "left_anti")
    return missed.groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(30)


_TOP = "round(avg(CASE WHEN rank <= {0} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS top{0}"
_METRICS = f"count(*) AS targets, count(rank) AS found, {', '.join(_TOP.format(k) for k in (1, 3, 5))}, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr"


@query(f"WITH {CANDIDATES} SELECT {_METRICS}, (list_sort(list(rank) FILTER (rank IS NOT NULL))[count(rank) // 2 + 1])::DOUBLE AS median_rank FROM ranks")
def ranking_metrics_all(spark, sf_dir):
    return EV.ranking_metrics(_ranks(spark, sf_dir), True)


@query(f"WITH {CANDIDATES} SELECT {_METRICS}, median(rank)::DOUBLE AS median_rank FROM ranks WHERE rank IS NOT NULL")
def ranking_metrics_with_candidate(spark, sf_dir):
    return EV.ranking_metrics(_ranks(spark, sf_dir), False)


def _ranks(spark, sf_dir, text=F.trim):
    """The rank of the first candidate whose text is the gold target's, case ignored; null if there is none."""
    place = lambda o, g: F.array_position(F.transform(o, lambda x: F.lower(text(x["candidate"])) == F.lower(g)), True)
    return _ranked(spark, sf_dir).select(*KEYS, F.nullif(place(F.col("candidates"), F.col("gold")), F.lit(0)).cast("int").alias("rank"))


@query(rf"""WITH {CANDIDATES}, same AS (SELECT *, lower(regexp_replace(regexp_replace(candidate, '^[\s"''“”‘’`´]+|[\s"''“”‘’`´]+$', '', 'g'), '\s+', ' ', 'g')) = lower(gold) AS hit FROM ranked),
r AS (SELECT doc_id, line, pos, min(CASE WHEN hit THEN rank END) AS rank FROM same GROUP BY 1, 2, 3)
SELECT {_METRICS}, median(rank)::DOUBLE AS median_rank FROM r WHERE rank IS NOT NULL""")
def ranking_metrics_normalised(spark, sf_dir):
    """Candidates made anew from the sentences, matched by their normalised text; targets without a candidate do not count."""
    return EV.ranking_metrics(_ranks(spark, sf_dir, T.normalise_candidate), False)


_ERRORS = f"""{CANDIDATES}, best AS (SELECT doc_id, line, pos, gold, candidate AS predicted, source AS ps FROM ranked WHERE rank = 1),
sources AS (SELECT doc_id, line, pos, candidate AS gold, arg_min(source, rank) AS gs FROM ranked GROUP BY 1, 2, 3, 4),
pairs AS (SELECT b.*, s.gs, lower(b.gold) AS g, lower(b.predicted) AS p, len({_WORDS("b.gold")}) AS gw, len({_WORDS("b.predicted")}) AS pw FROM best b LEFT JOIN sources s USING (doc_id, line, pos, gold)),
typed AS (SELECT *, CASE WHEN gold = predicted THEN 'CORRECT' WHEN contains(p, g) AND pw > gw THEN 'LARGER_SPAN' WHEN contains(g, p) AND pw < gw THEN 'SMALLER_SPAN' WHEN rtrim(g, '''s') = rtrim(p, '''s') THEN 'POSSESSIVE_VARIATION'
  WHEN contains(gs, 'SUBSPAN') AND ps = 'NER' THEN 'NER_VS_SUBSPAN' WHEN contains(gs, 'NER') AND contains(ps, 'SUBSPAN') THEN 'SUBSPAN_VS_NER' WHEN contains(ps, 'COORDINATION') THEN 'COORDINATION_ERROR' ELSE 'OTHER' END AS error FROM pairs)"""


@query(f"""WITH {_ERRORS}
SELECT error, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM typed), 4) AS pct FROM typed GROUP BY 1""")
def ranking_errors(spark, sf_dir):
    from ..operators.marking import breakdown

    return breakdown(_errors(spark, sf_dir).select("error"), "error")


def _errors(spark, sf_dir):
    """The best candidate of each sentence against its gold target."""
    own = F.get(F.filter("candidates", lambda x: x["candidate"] == F.col("gold")), F.lit(0))["source"]
    best = F.get("candidates", F.lit(0))
    rows = _ranked(spark, sf_dir).select(*KEYS, "gold", best["candidate"].alias("predicted"), own.alias("gs"), best["source"].alias("ps"))
    return rows.withColumn("error", EV.error_type(F.col("gold"), F.col("predicted"), F.col("gs"), F.col("ps")))


@query(f"""WITH {_ERRORS} SELECT error, n::INTEGER AS n, doc_id, line, pos, gold, predicted
FROM (SELECT *, row_number() OVER (PARTITION BY error ORDER BY doc_id, line, pos) AS n FROM typed WHERE error <> 'CORRECT') WHERE n <= 10""")
def ranking_error_samples(spark, sf_dir):
    """The first ten errors of each kind."""
    wrong = _errors(spark, sf_dir).where("error <> 'CORRECT'")
    return EV.first_of_each(wrong, "error", KEYS, 10).select("error", "n", *KEYS, "gold", "predicted")


@query(f"WITH {CANDIDATES} SELECT doc_id, line, pos, rank FROM ranks WHERE rank IS NOT NULL ORDER BY rank DESC, doc_id, line, pos LIMIT 10")
def worst_ranked(spark, sf_dir):
    return _ranks(spark, sf_dir).where("rank IS NOT NULL").orderBy(F.desc("rank"), *KEYS).limit(10)


_TIERS = A.MENTIONS + """,
golds AS (SELECT row_id, CASE WHEN contains(feed_url, '.com') THEN 'a' WHEN contains(feed_url, '.net') THEN 'b' ELSE 'c' END AS model, CASE WHEN row_id % 13 = 0 THEN 'Nobody' WHEN row_id % 4 = 0 THEN lower(target_text) ELSE regexp_extract(target_text, '[^ ]*$') END AS gold,
  lower(target_text) AS t, list_transform(embedded_entities, lambda x: lower(x)) AS pool FROM mentions),
tiers AS (SELECT row_id, model, gold, CASE WHEN lower(gold) = t THEN 'EXACT' WHEN list_contains(pool, lower(gold)) THEN 'RESOLVED_OR_EMBEDDED' WHEN contains(t, lower(gold)) OR contains(lower(gold), t) OR len(list_filter(pool, lambda x: contains(x, lower(gold)) OR contains(lower(gold), x))) > 0 THEN 'SUBSTRING' ELSE 'NOT_FOUND' END AS tier FROM golds)"""


def _tiers(spark, sf_dir):
    rows, t = A.mentions(spark, sf_dir), F.col("target_text")
    gold = F.when(F.col("row_id") % 13 == 0, "Nobody").when(F.col("row_id") % 4 == 0, F.lower(t)).otherwise(F.substring_index(t, " ", -1))
    model = F.when(F.contains("feed_url", F.lit(".com")), "a").when(F.contains("feed_url", F.lit(".net")), "b").otherwise("c")
    rows = rows.select("row_id", model.alias("model"), gold.alias("gold"), F.array(t).alias("exact"), F.col("embedded_entities").alias("pool"))
    return rows.withColumn("tier", EV.tier(F.col("gold"), F.col("exact"), F.col("pool"))).select("row_id", "model", "gold", "tier")


@query(f"WITH {_TIERS} SELECT * FROM tiers")
def tier_match(spark, sf_dir):
    return _tiers(spark, sf_dir)


@query(f"""WITH {_TIERS}, s AS (SELECT model, count(*) AS gold, sum((tier = 'EXACT')::BIGINT)::BIGINT AS exact, sum((tier = 'RESOLVED_OR_EMBEDDED')::BIGINT)::BIGINT AS resolved, sum((tier = 'SUBSTRING')::BIGINT)::BIGINT AS substring, sum((tier = 'NOT_FOUND')::BIGINT)::BIGINT AS not_found FROM tiers GROUP BY model),
r AS (SELECT *, (gold - not_found)::DOUBLE / gold AS r FROM s)
SELECT model, gold, exact, resolved, substring, not_found, round(r, 6) AS recall, round(r - first_value(r) OVER (ORDER BY model), 6) AS recall_delta FROM r""")
def model_comparison(spark, sf_dir):
    return EV.tier_summary(_tiers(spark, sf_dir))


_FLAGS = {
    "f_start": "start::DOUBLE", "f_relative_start": "start::DOUBLE / greatest(length(sentence), 1)", "f_length": "length(candidate)::DOUBLE", "f_words": f"len({_WORDS('candidate')})::DOUBLE",
    "f_capitalised": f"({_CAPS.format('candidate')})::INTEGER::DOUBLE", "f_upper": "(candidate = upper(candidate) AND candidate <> lower(candidate))::INTEGER::DOUBLE",
    "f_pronoun": f"(lower(candidate) IN ({_quoted(V.RANKER_PRONOUNS)}))::INTEGER::DOUBLE", "f_possessive": "ends_with(lower(candidate), '''s')::INTEGER::DOUBLE", "f_digit": "regexp_matches(candidate, '[0-9]')::INTEGER::DOUBLE",
    "f_first": "(start = 0)::INTEGER::DOUBLE", "f_determiner": "regexp_matches(lower(candidate), '^(the|a|an) ')::INTEGER::DOUBLE", "f_length_squared": "(length(candidate) * length(candidate))::DOUBLE",
    "f_end": "stop::DOUBLE", "f_relative_end": "stop::DOUBLE / greatest(length(sentence), 1)", "f_relative_length": "length(candidate)::DOUBLE / greatest(length(sentence), 1)",
    "f_is_ner": "(source = 'NER')::INTEGER::DOUBLE", "f_is_pronoun": "(source = 'PRONOUN')::INTEGER::DOUBLE", "f_is_subspan": "starts_with(source, 'SUBSPAN')::INTEGER::DOUBLE", "f_is_normalized": "contains(source, 'NORMALIZED')::INTEGER::DOUBLE",
    "f_single_word": f"(len({_WORDS('candidate')}) = 1)::INTEGER::DOUBLE", "f_two_words": f"(len({_WORDS('candidate')}) = 2)::INTEGER::DOUBLE", "f_long": f"(len({_WORDS('candidate')}) >= 4)::INTEGER::DOUBLE",
    "f_starts_with_the": "starts_with(lower(candidate), 'the ')::INTEGER::DOUBLE", "f_hyphen": "contains(candidate, '-')::INTEGER::DOUBLE", "f_at_start": "(start <= 2)::INTEGER::DOUBLE", "f_near_start": "(start <= 20)::INTEGER::DOUBLE",
    "f_at_end": "(stop >= greatest(length(sentence), 1) - 2)::INTEGER::DOUBLE", "f_near_end": "(stop >= greatest(length(sentence), 1) - 20)::INTEGER::DOUBLE",
}


@query(f"WITH {CANDIDATES} SELECT source, count(*) AS n, {', '.join(f'round(avg({x}), 6) AS {k}' for k, x in _FLAGS.items())} FROM labelled GROUP BY source")
def candidate_features(spark, sf_dir):
    """Means of the ranker's features by source."""
    rows = C.features(_labelled(spark, sf_dir, True))
    return rows.groupBy("source").agg(F.count("*").alias("n"), *[F.round(F.avg(k), 6).alias(k) for k in _FLAGS])


@query(f"""WITH {CANDIDATES}, scored AS (SELECT (CASE WHEN source = 'NER' THEN 100 ELSE 0 END + 2 * length(candidate) - start)::DOUBLE AS score, label FROM labelled),
counts AS (SELECT score, sum(label)::DOUBLE AS p, count(*)::DOUBLE - sum(label) AS n FROM scored GROUP BY score),
above AS (SELECT *, sum(p) OVER (ORDER BY score DESC) - p AS more FROM counts)
SELECT round(sum(n * (more + p / 2)) / (sum(p) * sum(n)), 6) AS auc FROM above""")
def ranking_auc(spark, sf_dir):
    """Area under the ROC curve of the linear score."""
    from ..operators.ranker import roc_auc

    score = F.when(F.col("source") == "NER", 100).otherwise(0) + 2 * F.length("candidate") - F.col("start")
    rows = _labelled(spark, sf_dir).select(score.cast("double").alias("score"), F.col("label").cast("double").alias("label"))
    return spark.createDataFrame([(round(roc_auc(rows, "score"), 6),)], "auc double")
