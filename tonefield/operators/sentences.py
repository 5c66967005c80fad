"""Text to sentences, HTML to text, length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def split_sentences(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """keep, line, pos, sentence. Newlines are hard boundaries; inside a line an end mark before white space ends a sentence."""
    lines = docs.select(*keep, F.posexplode(F.split(text_column, "\n", -1)).alias("line", "raw"))
    marked = F.regexp_replace(T.strip("raw"), r"([.!?])\s+", "$1\n")
    cut = lines.select(*keep, "line", F.posexplode(F.split(marked, "\n", -1)).alias("pos", "part"))
    return cut.select(*keep, "line", "pos", T.strip("part").alias("sentence")).where("sentence <> ''")


def html_to_text(html: Column | str) -> Column:
    """Boilerplate elements and comments go with their content, other tags alone; the common entities are read; white space collapses."""
    t = T.col(html)
    for tag in ("script", "style", "nav", "head"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def length_stats(texts: DataFrame, column: str) -> DataFrame:
    """Word counts: fewest, upper middle, most, mean."""
    n = texts.select(T.word_count(column).alias("n")).groupBy("n").agg(F.count("*").alias("c"))  # a row for each length
    lengths = F.array_sort(F.collect_list(F.struct("n", "c")))
    total = F.sum("c")
    out = n.agg(lengths.alias("l"), total.alias("total"), F.sum(F.col("n") * F.col("c")).alias("words"))
    upper = F.aggregate("l", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("m")), lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"), F.when(a["m"].isNull() & (a["seen"] + x["c"] > F.floor(F.col("total") / 2)), x["n"]).otherwise(a["m"]).alias("m")))
    return out.select(F.get("l", F.lit(0))["n"].alias("fewest"), upper["m"].alias("median"), F.element_at("l", -1)["n"].alias("most"), F.round(F.col("words") / F.col("total"), 4).alias("mean"))
