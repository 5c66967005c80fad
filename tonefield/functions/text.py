"""Text expressions with the semantics the engine's results depend on: Unicode-aware strip and split, 0-based code point offsets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends, any Unicode white space."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def words(c: Column | str) -> Column:
    """White-space separated words; none for an empty text."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def blank_as_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def let(c: Column, then) -> Column:
    """then(c), with c worked out once however often it is used."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def locate0(needle: Column, text: Column) -> Column:
    """0-based place of the first occurrence, case ignored, no word boundaries; -1 if there is none."""
    return F.when(F.length(needle) > 0, F.position(F.lower(needle), F.lower(text)) - 1).otherwise(-1)


def slug(c: Column | str) -> Column:
    """Lower-case id: runs of other characters become one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def capitalised(c: Column | str) -> Column:
    first = F.substring(col(c), 1, 1)
    return (first == F.upper(first)) & (first != F.lower(first))


def first_wins(items: Column, key=lambda x: F.lower(strip(x))) -> Column:
    """Array without later items of an earlier item's key, order kept; empty keys go."""
    seen = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        skip = (key(x) == "") | F.array_contains(acc["keys"], key(x))
        added = F.struct(F.concat(acc["keys"], F.array(key(x))).alias("keys"), F.concat(acc["out"], F.array(strip(x))).alias("out"))
        return F.when(skip, acc).otherwise(added)

    return F.aggregate(F.filter(items, lambda x: x.isNotNull()), seen, step, lambda acc: acc["out"])


def normalise_mention(c: Column | str) -> Column:
    """A possessive joined again, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(col(c), r"(?i)\s+'\s*s\b", "'s"), r"(?U)\s+", " "))


def normalise_candidate(c: Column | str) -> Column:
    """Without white space and quotes at both ends, white space collapsed."""
    edge = "[\\s\"'“”‘’`´]+"
    return F.regexp_replace(F.regexp_replace(col(c), f"^{edge}|{edge}$", ""), r"\s+", " ")


def _unpaired(edge: str, other: str) -> tuple[tuple[str, bool], tuple[str, bool]]:
    """Rules for a character at the start, and at the end, whose counterpart is nowhere else."""
    return (rf"^{edge}\s*([^{other}]*)$", True), (rf"^([^{other}]*?)\s*{edge}$", True)


def _edge_rules() -> list[tuple[str, bool]]:
    """(pattern, whether its group stays), one after another, for Java's and Python's matcher alike: empty parentheses go, then halves of pairs,
    then a quote on one side only, then dashes and separators."""
    out = [(r"\(\s*\)", False)]
    for a, b in ((r"\(", r"\)"), ("“", "”")):
        (a_first, a_last), (b_first, b_last) = _unpaired(a, b), _unpaired(b, a)
        out += [a_first, b_last, a_last, b_first]
    for q in ("'", '"'):
        out += [(rf"^{q}\s*((?s:.*)[^{q}])$", True), (rf"^([^{q}](?s:.*?))\s*{q}$", True)]
    return [*out, (r"^[\s—–\-:;,]+|[\s—–\-:;,]+$", False)]


EDGE_RULES = _edge_rules()


def clean_edges(c: Column | str) -> Column:
    """Orphaned punctuation at the ends goes, by EDGE_RULES."""
    t = col(c)
    for pattern, stays in EDGE_RULES:
        t = strip(F.regexp_replace(t, pattern, "$1" if stays else ""))
    return t


def cleaned(text: str) -> str:
    """clean_edges for a string."""
    for pattern, stays in EDGE_RULES:
        text = re.sub(pattern, r"\1" if stays else "", text).strip()
    return text


def netloc(url: Column | str) -> Column:
    """Authority of a URL with its port; empty if there is none."""
    return F.coalesce(F.regexp_extract(col(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def day(c: Column | str) -> Column:
    """YYYY-MM-DD of an ISO text; null if the text is shorter."""
    return F.when(F.length(col(c)) >= 10, F.substring(col(c), 1, 10))
