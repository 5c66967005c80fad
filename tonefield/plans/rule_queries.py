"""Queries of the selection and resolution rules over phrases made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import references, rules
from ..sources import adapters as A
from .registry import _WORDS, _quoted, query

_FIRST = "list_filter({x}, lambda p, i: trim(p) <> '' AND NOT list_contains(list_transform({x}[1:i - 1], lambda q: lower(trim(q))), lower(trim(p))))"
_PHRASED = A.MENTIONS + f""",
phrased AS (SELECT row_id, target_text, sentence, [CASE WHEN row_id % 4 = 0 THEN 'it' ELSE target_text END, 'the company', upper(target_text), CASE WHEN row_id % 3 = 0 THEN 'new plans' ELSE 'their deal' END] AS phrases,
  [{{'text': regexp_extract(target_text, '[^ ]*$'), 'label': 'ORG'}}, {{'text': 'Monday', 'label': 'DATE'}}] AS entities FROM mentions),
kept AS (SELECT *, list_filter(phrases, lambda p: NOT list_contains([{_quoted(V.PRONOUNS)}], lower(trim(p))) AND NOT list_contains([{_quoted(V.GENERIC_TERMS)}], lower(trim(p)))) AS k FROM phrased),
uniq AS (SELECT *, {_FIRST.format(x="k")} AS u FROM kept),
hits AS (SELECT *, list_filter(u, lambda p: len(list_filter(entities, lambda e: lower(e.text) = regexp_replace(lower(p), '^(the|a|an) ', '') OR length(regexp_replace(lower(p), '^(the|a|an) ', '')) >= 4 AND contains(lower(e.text), regexp_replace(lower(p), '^(the|a|an) ', '')))) > 0) AS h FROM uniq)"""


def _phrased(spark, sf_dir):
    t = F.col("target_text")
    phrases = F.array(F.when(F.col("row_id") % 4 == 0, "it").otherwise(t), F.lit("the company"), F.upper(t), F.when(F.col("row_id") % 3 == 0, "new plans").otherwise("their deal"))
    entity = lambda text, label: F.struct(text.alias("text"), F.lit(label).alias("label"))
    return A.mentions(spark, sf_dir).select("row_id", "target_text", "sentence", phrases.alias("phrases"), F.array(entity(F.substring_index(t, " ", -1), "ORG"), entity(F.lit("Monday"), "DATE")).alias("entities"))


@query(f"WITH {_PHRASED} SELECT row_id, array_to_string(u, '|') AS phrases FROM uniq")
def unique_phrases(spark, sf_dir):
    return _phrased(spark, sf_dir).select("row_id", F.array_join(rules.usable_phrases(F.col("phrases")), "|").alias("phrases"))


@query(f"WITH {_PHRASED} SELECT row_id, array_to_string(CASE WHEN len(u) < 2 THEN u WHEN len(h) > 0 THEN h ELSE u[1:1] END, '|') AS candidates FROM hits")
def target_candidates(spark, sf_dir):
    names = F.transform("entities", lambda e: e["text"])
    return _phrased(spark, sf_dir).select("row_id", F.array_join(rules.candidates(F.col("phrases"), names), "|").alias("candidates"))


_LONG = "CASE WHEN row_id % 2 = 0 THEN repeat('very ', 15) || target_text ELSE target_text END"


@query(f"""WITH {_PHRASED}, inside AS (SELECT row_id, {_LONG} AS t, list_transform(list_filter(entities, lambda e: e.label NOT IN ({_quoted(V.WEAK_ENTITY_LABELS)}) AND length(e.text) >= 2 AND lower(e.text) <> lower({_LONG}) AND contains(lower({_LONG}), lower(e.text))), lambda e: e.text) AS inside FROM phrased)
SELECT row_id, array_to_string(inside, '|') AS embedded, CASE WHEN len({_WORDS("t")}) <= 15 THEN t ELSE inside[1] END AS target FROM inside""")
def embedded_and_capped(spark, sf_dir):
    t = F.when(F.col("row_id") % 2 == 0, F.concat(F.repeat(F.lit("very "), 15), "target_text")).otherwise(F.col("target_text"))
    rows = _phrased(spark, sf_dir).withColumn("t", t).withColumn("inside", rules.embedded(F.col("t"), F.col("entities")))
    return rows.select("row_id", F.array_join("inside", "|").alias("embedded"), rules.capped(F.col("t"), F.col("inside")).alias("target"))


_LEMMAS = ("announce", "say", "hold", "cut", "be")
_EVENTS = A.MENTIONS + f""",
event_rows AS (SELECT row_id // 5 AS sent, (row_id % 5)::INTEGER AS event_pos, ([{_quoted(_LEMMAS)}])[row_id % 5 + 1] AS lemma, CASE WHEN row_id % 2 = 0 THEN 'object' ELSE 'subject' END AS role, 0 AS cand_pos, target_text AS target FROM mentions),
graded AS (SELECT *, CASE WHEN role = CASE WHEN lemma IN ({_quoted(V.OBJECT_FOCUSED_EVENTS)}) THEN 'object' WHEN lemma IN ({_quoted(V.SUBJECT_FOCUSED_EVENTS)}) THEN 'subject' ELSE '' END THEN 'high' ELSE 'medium' END AS confidence,
  row_number() OVER (PARTITION BY sent, lower(target) ORDER BY event_pos, (role <> 'object')::INTEGER, cand_pos) AS n FROM event_rows),
chosen AS (SELECT sent, event_pos, lemma, role, target, confidence, row_number() OVER (PARTITION BY sent ORDER BY event_pos, (role <> 'object')::INTEGER, cand_pos)::INTEGER AS target_pos FROM graded WHERE n = 1)"""


def _selected(spark, sf_dir):
    k = (F.col("row_id") % 5).cast("int")
    rows = A.mentions(spark, sf_dir).select(F.floor(F.col("row_id") / 5).alias("sent"), k.alias("event_pos"), F.get(F.array(*map(F.lit, _LEMMAS)), k).alias("lemma"), F.when(F.col("row_id") % 2 == 0, "object").otherwise("subject").alias("role"), F.lit(0).alias("cand_pos"), F.col("target_text").alias("target"))
    return rules.select_all(rows, ["sent"]).select("sent", "event_pos", "lemma", "role", "target", "confidence", "target_pos")


@query(f"WITH {_EVENTS} SELECT * FROM chosen")
def target_selection(spark, sf_dir):
    return _selected(spark, sf_dir)


@query(f"WITH {_EVENTS} SELECT sent, arg_max(target, 100 * (confidence = 'high')::INTEGER - target_pos) AS target FROM chosen GROUP BY sent")
def best_target(spark, sf_dir):
    return rules.select_best(_selected(spark, sf_dir), ["sent"]).select("sent", "target")


_MENTIONS_ = ("he", "it", "they", "the company", "the government's", "Acme")
_LABELS_ = ("PERSON", "ORG", "GPE")
_PAIRS = f"""pairs AS (SELECT e.event_id // 4 AS ref, (e.event_id % 4)::INTEGER AS cand_pos, ([{", ".join("'" + m.replace("'", "''") + "'" for m in _MENTIONS_)}])[(e.event_id // 4) % 6 + 1] AS mention, (user_id % 80)::INTEGER - 1 AS start, ((e.event_id // 4) % 3)::INTEGER - 1 AS event,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE ([{_quoted(_LABELS_)}])[user_id % 3 + 1] END AS label, (['subject', 'object'])[event_id % 2 + 1] AS role, (event_id % 60)::INTEGER - 1 AS c_start, (user_id % 3)::INTEGER - 1 AS c_event, event_id % 7 = 0 AS elsewhere,
  CASE event_id % 9 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS c_gender FROM events e),
typed AS (SELECT *, CASE mention WHEN 'he' THEN ['PERSON'] WHEN 'it' THEN [{_quoted(V.THING_TYPES)}] WHEN 'the company' THEN ['ORG'] WHEN 'the government''s' THEN ['ORG', 'GPE'] ELSE [] END AS types FROM pairs),
scored AS (SELECT ref, cand_pos, 'c' || cand_pos AS candidate, CASE
  WHEN mention = 'he' AND c_gender = 'female' OR len(types) > 0 AND label IS NOT NULL AND NOT list_contains(types, label) THEN NULL
  WHEN elsewhere THEN 15 + CASE WHEN len(types) > 0 AND label IS NOT NULL THEN 30 ELSE 5 END
  WHEN start >= 0 AND c_start >= 0 AND start < c_start THEN NULL
  ELSE CASE WHEN len(types) > 0 AND label IS NOT NULL THEN 30 ELSE 5 END + CASE role WHEN 'subject' THEN 30 ELSE 10 END + CASE WHEN event >= 0 AND event = c_event THEN 25 ELSE 0 END
    + CASE WHEN start >= 0 AND c_start >= 0 THEN greatest(0, 20 - least((start - c_start) // 10, 20)) ELSE 0 END END::INTEGER AS score FROM typed)"""


def _scored(spark, sf_dir):
    e, u, ref = F.col("event_id"), F.col("user_id"), F.floor(F.col("event_id") / 4)
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    rows = A.table(spark, sf_dir, "events").select(
        ref.alias("ref"), (e % 4).cast("int").alias("cand_pos"), pick(_MENTIONS_, ref % 6).alias("mention"), ((u % 80).cast("int") - 1).alias("start"), ((ref % 3).cast("int") - 1).alias("event"),
        F.when(e % 5 != 0, pick(_LABELS_, u % 3)).alias("label"), pick(("subject", "object"), e % 2).alias("role"), ((e % 60).cast("int") - 1).alias("c_start"), ((u % 3).cast("int") - 1).alias("c_event"), (e % 7 == 0).alias("elsewhere"),
        F.when(e % 9 == 0, "female").when(e % 9 == 1, "male").alias("c_gender"),
    )
    c = F.col
    score = rules.score(c("mention"), c("start"), c("event"), c("label"), c("role"), c("c_start"), c("c_event"), c("elsewhere"), c("c_gender"))
    return rows.select("ref", "cand_pos", F.concat(F.lit("c"), "cand_pos").alias("candidate"), score.alias("score"))


@query(f"WITH {_PAIRS} SELECT * FROM scored")
def resolver_scores(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(f"""WITH {_PAIRS}, ranked AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM scored WINDOW w AS (PARTITION BY ref ORDER BY score DESC NULLS LAST, cand_pos))
SELECT ref, CASE WHEN score >= 40 AND (second IS NULL OR score - second >= 10) THEN candidate END AS candidate, CASE WHEN score >= 40 AND (second IS NULL OR score - second >= 10) THEN score END AS score FROM ranked WHERE r = 1""")
def resolver_decisions(spark, sf_dir):
    return rules.decide(_scored(spark, sf_dir), ["ref"])


@query(rf"""WITH {A.SENTENCES}, w AS (SELECT doc_id, line, pos, sentence, unnest({_WORDS("sentence")}) AS raw FROM sentences WHERE lang = 'en'), p AS (SELECT DISTINCT doc_id, line, pos, sentence, lower(trim(raw, '.,!?;:"''()[]{{}}')) AS mention FROM w)
SELECT doc_id, line::INTEGER AS line, pos::INTEGER AS pos, mention, (position(mention IN lower(sentence)) - 1)::INTEGER AS start FROM p WHERE mention IN ({_quoted(V.PRONOUNS)})""")
def located_references(spark, sf_dir):
    """Pronouns of each sentence at their first place, word boundaries ignored."""
    rows = A.sentences(spark, sf_dir).where("lang = 'en'")
    found = rows.select("doc_id", "line", "pos", "sentence", F.explode(F.array_distinct(F.transform(references.embedded_pronouns("sentence"), lambda w: F.lower(w)))).alias("mention"))
    return found.select("doc_id", "line", "pos", "mention", T.locate0(F.col("mention"), F.col("sentence")).cast("int").alias("start"))


@query(r"""WITH t AS (SELECT conv_id, turn, lower(trim(text)) AS x, text FROM conversations)
SELECT conv_id, turn, c.turn - lag(c.turn) OVER (PARTITION BY conv_id ORDER BY turn) AS step, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role FROM conversations c""")
def previous_sentence(spark, sf_dir):
    """The row before in the same article, as the resolver's pool uses it."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") - F.lag("turn").over(w)).alias("step"), F.lag("role").over(w).alias("previous_role"))
