"""Target candidates from tokens, and their features' statistics.

Everything up to a sentence's candidates is worked out inside its row by a kernel over Arrow batches: one pass along the words, linear in the sentence's
length, and nothing is shuffled before rows are counted or joined. (The same as array expressions took nearly three times the time: offsets and runs
depend on what stands before, which higher-order functions can only look up again.) Without a parser, capitalised runs stand for named entities.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V

_PRONOUNS, _HONORIFICS = frozenset(V.RANKER_PRONOUNS), frozenset(V.HONORIFICS)
_EDGE, _GAP = re.compile("^[\\s\"'“”‘’`´]+|[\\s\"'“”‘’`´]+$", re.A), re.compile(r"\s+", re.A)


def token_list(sentence: str) -> list[tuple[int, str, int, int]]:
    """(i, token, start, stop): words between blanks without their outer punctuation, with 0-based offsets. i counts all words between blanks."""
    out, at = [], 0
    for i, raw in enumerate(sentence.split(" ")):
        token = raw.strip(V.EDGE_PUNCTUATION)
        if token:
            start = at + len(raw) - len(raw.lstrip(V.EDGE_PUNCTUATION))
            out.append((i, token, start, start + len(token)))
        at += len(raw) + 1
    return out


def _capitalised(token: str) -> bool:
    return token[0] == token[0].upper() != token[0].lower()


def run_list(tokens_: list[tuple[int, str, int, int]]) -> list[list[int]]:
    """Maximal runs of neighbouring capitalised tokens: their places in the list."""
    out: list[list[int]] = []
    for k, (i, token, _, _) in enumerate(tokens_):
        if _capitalised(token):
            if out and tokens_[out[-1][-1]][0] + 1 == i:
                out[-1].append(k)
            else:
                out.append([k])
    return out


def candidate_list(sentence: str, tokens_: list[tuple[int, str, int, int]]) -> list[tuple[int, int, str, str]]:
    """(start, stop, candidate, source) in this order: named runs and their normalised forms, single capitalised tokens inside longer
    runs, pronouns, title expansions. The first source in this order keeps a span."""
    first: dict[tuple[int, int, str], str] = {}
    runs = run_list(tokens_)
    spans = [(tokens_[r[0]][2], tokens_[r[-1]][3]) for r in runs]
    for a, b in spans:
        first[a, b, sentence[a:b]] = "NER"
    for a, b in spans:
        text = _GAP.sub(" ", _EDGE.sub("", sentence[a:b]))
        if text and text != sentence[a:b] and (at := sentence.find(text)) >= 0:
            first.setdefault((at, at + len(text), text), "NER_NORMALIZED")
    for r in runs:
        for k in r if len(r) > 1 else ():
            first.setdefault((tokens_[k][2], tokens_[k][3], tokens_[k][1]), "SUBSPAN_TOKEN")
    for _, token, a, b in tokens_:
        if token.lower() in _PRONOUNS:
            first.setdefault((a, b, token), "PRONOUN")
    for r, (_, b) in zip(runs, spans, strict=True):
        if r[0] and tokens_[r[0] - 1][1].lower() in _HONORIFICS:
            a = tokens_[r[0] - 1][2]
            first.setdefault((a, b, sentence[a:b]), "TITLE_EXPANSION")
    return sorted((*span, source) for span, source in first.items())


def _flat(sentences: DataFrame, keys: list[str], rows_of: Callable, schema: str, column: str) -> DataFrame:
    """keys and what rows_of(sentence) gives, a row each."""
    kinds = ", ".join(f"`{k}` {sentences.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        import pyarrow as pa

        kind = {"int": pa.int32(), "string": pa.string()}
        fields = [x.split() for x in schema.split(", ")]
        for batch in batches:
            at, rows = [], []
            for k, sentence in enumerate(batch.column(len(keys)).to_pylist()):
                found = rows_of(sentence or "")
                rows += found
                at += [k] * len(found)
            index = pa.array(at, pa.int64())
            made = [pa.array([r[j] for r in rows], kind[t]) for j, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(j).take(index) for j in range(len(keys))] + made, names=[*keys, *[n for n, _ in fields]])

    return sentences.select(*keys, column).mapInArrow(run, f"{kinds}, {schema}")


def tokens(sentences: DataFrame, keys: list[str], column: str = "sentence") -> DataFrame:
    """(keys, i, token, start, stop)."""
    return _flat(sentences, keys, token_list, "i int, token string, start int, stop int", column)


def capitalised_runs(sentences: DataFrame, keys: list[str], column: str = "sentence") -> DataFrame:
    """(keys, start, stop)."""

    def rows_of(sentence: str):
        t = token_list(sentence)
        return [(t[r[0]][2], t[r[-1]][3]) for r in run_list(t)]

    return _flat(sentences, keys, rows_of, "start int, stop int", column)


def candidate_rows(sentences: DataFrame, keys: list[str], column: str = "sentence") -> DataFrame:
    """(keys, candidate, start, stop, source)."""
    return _flat(sentences, keys, lambda s: candidate_list(s, token_list(s)), "start int, stop int, candidate string, source string", column)


def with_candidates(sentences: DataFrame, keys: list[str], column: str = "sentence") -> DataFrame:
    """keys, sentence, first (its first token), candidates (array of start, stop, candidate, source): a row a sentence that has a candidate."""
    kinds = ", ".join(f"`{k}` {sentences.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, first, ends, rows = [], [], [0], []
            for k, sentence in enumerate(batch.column(len(keys)).to_pylist()):
                t = token_list(sentence or "")
                found = candidate_list(sentence, t) if t else []
                if found:
                    at.append(k)
                    first.append(t[0][1])
                    rows += found
                    ends.append(len(rows))
            index = pa.array(at, pa.int64())
            kind = (pa.int32(), pa.int32(), pa.string(), pa.string())
            item = pa.StructArray.from_arrays([pa.array([r[j] for r in rows], x) for j, x in enumerate(kind)], names=["start", "stop", "candidate", "source"])
            yield pa.RecordBatch.from_arrays([c.take(index) for c in batch.columns] + [pa.array(first, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), item)], names=[*keys, column, "first", "candidates"])

    return sentences.select(*keys, column).mapInArrow(run, f"{kinds}, `{column}` string, first string, candidates array<struct<start:int,stop:int,candidate:string,source:string>>")


def count_stats(counts: DataFrame) -> DataFrame:
    """counts (n) -> how many sentences, and the fewest, most, mean and median candidates."""
    return counts.agg(F.count("*").alias("sentences"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.median("n"), 6).alias("median"))


def count_buckets(n: DataFrame) -> DataFrame:
    """n (n): a row a sentence, how many candidates it has."""
    bucket = F.when(F.col("n") <= 5, "1-5").when(F.col("n") <= 10, "6-10").when(F.col("n") <= 20, "11-20").when(F.col("n") <= 30, "21-30").otherwise("31+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("sentences"), F.min("n").alias("fewest"), F.max("n").alias("most"))


def signal_stats(rows: DataFrame, by: Column | str, column: str = "sentence") -> DataFrame:
    """rows (candidate, start, label 0/1) -> how often the label is 1, and mean features, by a column."""
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.sum("label").alias("positive"), F.round(F.avg("label"), 6).alias("rate"), F.round(F.avg("start"), 4).alias("mean_start"),
        F.round(F.avg(F.col("start") / F.greatest(F.length(column), F.lit(1))), 4).alias("mean_relative_start"), F.round(F.avg(F.length("candidate")), 4).alias("mean_length"),
        F.round(F.avg(T.word_count("candidate")), 4).alias("mean_words"),
    )


#: C12's named entity flags, by label.
NER_FLAGS = ("PERSON", "ORG", "GPE", "NORP", "DATE", "TIME", "CARDINAL", "PRODUCT", "EVENT", "WORK_OF_ART", "LAW", "LOC", "FAC")
TITLES = (
    "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "dr", "dr.", "president", "senator", "sen.", "governor", "gov.", "rep", "rep.", "judge", "general", "gen", "mayor", "minister",
    "prime", "professor", "prof.", "chief", "captain", "col", "colonel",
)
_QUOTES, _DASHES = ("\"", "'", "\u201c", "\u2018"), ("-", "\u2013", "\u2014")
_CLOSING = ("\"", "'", "\u201d", "\u2019")


def features(rows: DataFrame, column: str = "sentence") -> DataFrame:
    """The one feature function that training and scoring share: numbers as columns f_*, categories as source and ner_label (NONE where rows have
    none). The end is stop, or start and the candidate's length."""
    c, s, source, start = F.col("candidate"), F.col(column), F.col("source"), F.col("start")
    ner = F.coalesce(F.col("ner_label"), F.lit("NONE")) if "ner_label" in rows.columns else F.lit("NONE")
    end = F.col("stop") if "stop" in rows.columns else start + F.length(c)
    size, low, n = F.greatest(F.length(s), F.lit(1)), F.lower(c), T.word_count(c)
    number = lambda x: x.cast("double")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    before, after = F.when(start > 0, F.substring(s, start, F.lit(1))), F.when(end < F.length(s), F.substring(s, end + 1, F.lit(1)))
    upper, lower, other = r"[\p{Lu}\p{Lt}]", r"\p{Ll}", r"[^\p{Lu}\p{Lt}\p{Ll}]"
    return rows.withColumns({
        "ner_label": ner,
        "f_start": number(start),
        "f_relative_start": start / size,
        "f_length": number(F.length(c)),
        "f_words": number(n),
        "f_capitalised": flag(T.capitalised(c)),
        "f_upper": flag((c == F.upper(c)) & (c != F.lower(c))),
        "f_pronoun": flag(low.isin(*V.RANKER_PRONOUNS)),
        "f_common": flag(F.arrays_overlap(T.words(low), F.array(*map(F.lit, V.COMMON_TARGET_WORDS)))),
        "f_possessive": flag(low.endswith("'s")),
        "f_digit": flag(c.rlike("[0-9]")),
        "f_first": flag(start == 0),
        "f_determiner": flag(low.rlike("^(the|a|an) ")),
        "f_length_squared": number(F.length(c) * F.length(c)),
        "f_words_squared": number(n * n),
        "f_end": number(end),
        "f_relative_end": end / size,
        "f_relative_length": F.length(c) / size,
        **{f"f_is_{k.lower()}": flag(source == k) for k in ("NER", "NOUN_CHUNK", "PRONOUN", "SUBSPAN_TOKEN", "SUBSPAN_PROPER_NAME", "COORDINATION", "APPOSITIVE_EXPANSION", "TITLE_EXPANSION")},
        "f_is_subspan": flag(source.startswith("SUBSPAN")),
        "f_is_normalized": flag(source.contains("NORMALIZED")),
        **{f"f_is_{k.lower()}": flag(ner == k) for k in NER_FLAGS},
        "f_single_word": flag(n == 1),
        "f_two_words": flag(n == 2),
        "f_three_words": flag(n == 3),
        "f_multi_word": flag(n > 1),
        "f_long": flag(n >= 4),
        "f_very_long": flag(n >= 8),
        **{f"f_starts_with_{k}": flag(low.startswith(f"{k} ")) for k in ("the", "a", "an")},
        "f_starts_with_title": flag(F.get(T.words(low), 0).isin(*TITLES)),
        "f_hyphen": flag(c.contains("-")),
        "f_apostrophe": flag(c.rlike("['\u2019]")),
        "f_starts_with_quote": flag(F.substring(c, 1, 1).isin(*_QUOTES)),
        "f_ends_with_quote": flag(F.substring(c, -1, 1).isin(*_CLOSING)),
        "f_starts_with_dash": flag(F.substring(c, 1, 1).isin(*_DASHES)),
        "f_edge_punctuation": flag((c != "") & ~(c.rlike(r"^[\p{L}\p{N}]") & c.rlike(r"[\p{L}\p{N}]\z"))),
        "f_first_word_capitalised": flag(c.rlike(r"(?U)^\s*\p{Lu}")),
        "f_contains_upper": flag(c.rlike(r"\p{Lu}")),
        "f_all_upper": flag(c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")),
        "f_all_lower": flag(c.rlike(lower) & ~c.rlike(upper)),
        "f_title_case": flag(c.rlike(f"^{other}*{upper}{lower}*(?:{other}+{upper}{lower}*)*{other}*\\z")),
        "f_at_start": flag(start <= 2),
        "f_near_start": flag(start <= 20),
        "f_at_end": flag(end >= size - 2),
        "f_near_end": flag(end >= size - 20),
        "f_preceded_by_space": flag(before.rlike(r"(?U)^\s")),
        "f_followed_by_space": flag(after.rlike(r"(?U)^\s")),
        "f_preceded_by_quote": flag(before.isin(*_QUOTES)),
        "f_followed_by_quote": flag(after.isin(*_CLOSING)),
        "f_preceded_by_dash": flag(before.isin(*_DASHES)),
        "f_followed_by_dash": flag(after.isin(*_DASHES)),
    })


def parsed_candidates(parse) -> list[tuple[str, int, int, str]]:
    """Candidates that need a parse (text, start, end, source): entities, noun chunks, proper names inside chunks, coordinated words with their head,
    appositive expansions. The first source of a span wins."""
    tokens, sentence = parse.tokens, parse.sentence
    end = lambda t: t.start + len(t.text)
    out: dict[tuple[int, int], tuple[str, int, int, str]] = {}

    def add(a: int, b: int, source: str) -> None:
        if 0 <= a < b:
            out.setdefault((a, b), (sentence[a:b], a, b, source))

    for e in parse.entities:
        add(e.start, e.end, "NER")
    for c in parse.chunks:
        add(c.start, c.end, "NOUN_CHUNK")
    for c in parse.chunks:
        inside = [t for t in tokens if c.start <= t.start < c.end]
        for t in inside:
            if t.pos in ("PROPN", "PRON"):
                add(t.start, end(t), "SUBSPAN_TOKEN")
        run: list = []
        for t in [*inside, None]:
            if t is not None and t.pos == "PROPN" and (not run or run[-1].i + 1 == t.i):
                run.append(t)
                continue
            if len(run) > 1:
                add(run[0].start, end(run[-1]), "SUBSPAN_PROPER_NAME")
            run = [t] if t is not None and t.pos == "PROPN" else []
    for t in tokens:
        head = tokens[t.head]
        if t.dep == "conj" and {t.pos, head.pos} <= {"PROPN", "NOUN", "PRON"}:
            a, b = sorted((t, head), key=lambda x: x.i)
            if any(x.text.lower() in ("and", "or") for x in tokens[a.i + 1 : b.i]):
                add(a.start, end(b), "COORDINATION")
    for e in parse.entities:
        if e.label != "PERSON":
            continue
        after = [t for t in tokens if t.start >= e.end][:APPOSITIVE_REACH]
        comma = next((t for t in after if t.text in ",.!?"), None)
        if comma is None or comma.text != ",":
            continue
        close = next((t for t in tokens[comma.i + 1 : comma.i + 1 + APPOSITIVE_REACH] if t.text in ",.!?"), None)
        if close is not None and close.i > comma.i + 1:
            add(e.start, end(tokens[close.i - 1]), "APPOSITIVE_EXPANSION")
    return list(out.values())


def parsed_candidate_rows(sentences: DataFrame, keys: list[str], provider) -> DataFrame:
    """(keys, candidate, start, stop, source) by a parser."""
    from .resolve import by_sentence

    return by_sentence(sentences, keys, parsed_candidates, "candidate string; start int; stop int; source string", provider)


#: Words between a name, its comma and the end of the appositive, at most.
APPOSITIVE_REACH = 15
