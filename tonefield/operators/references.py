"""References inside phrases: pronouns, generic descriptions, canonical forms. Pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V

EDGE = r"^[.,!?;:\"'()\[\]{}]+|[.,!?;:\"'()\[\]{}]+$"


def bare_words(c: Column | str) -> Column:
    return F.transform(T.words(c), lambda w: F.regexp_replace(w, EDGE, ""))


def embedded_pronouns(c: Column | str) -> Column:
    return F.filter(bare_words(c), lambda w: F.lower(w).isin(*V.PRONOUNS))


def embedded_generics(c: Column | str) -> Column:
    """Array of (surface, canonical): `the` with a generic noun, possessive or not."""
    def found(w):
        def at(i):
            second = F.lower(F.get(w, i + 1))
            head = F.regexp_replace(second, "['’]s$", "")
            hit = (F.lower(F.get(w, i)) == "the") & head.isin(*V.GENERIC_HEAD_TYPES)
            return F.when(hit, F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)).alias("surface"), F.concat(F.lit("the "), head).alias("canonical")))

        return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), at), lambda x: x.isNotNull())

    return T.let(bare_words(c), found)


def generic_head(c: Column | str) -> Column:
    """Last word in lower case without a possessive ending."""
    return F.regexp_replace(F.lower(F.element_at(T.words(c), -1)), "['’]s$", "")


def mention_type(c: Column | str) -> Column:
    low = F.lower(T.strip(c))
    return F.when(low.isin(*V.PRONOUNS), "pronoun").when(low.startswith("the ") & generic_head(c).isin(*V.GENERIC_HEAD_TYPES), "definite_description").otherwise("named_entity")
