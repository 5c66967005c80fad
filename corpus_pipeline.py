"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows to the shared folder and reads them again
as the next one's docs. All stages but the last return the columns of documents, in order, and any further columns of docs unchanged,
whatever their names: inside a stage columns go by number. doc_id is a whole number, text a string.

All stages: a null text is empty, null ids are documents like others, texts of any length are taken whole, an empty table gives no rows.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonefield.llm import common, langid, lines, ngram_join, packing, suffixes

#: A document is kept if its language's posterior reaches this.
LEAST_SCORE = 0.5


class _Numbered:
    """docs with columns in_0, in_1 ... and, beside them, what a stage needs: `at(name)` is a column's number's name."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.rows = docs.toDF(*[f"in_{k}" for k in range(len(self.names))])

    def at(self, name: str) -> str:
        return f"in_{self.names.index(name)}"

    def keyed(self) -> DataFrame:
        """With own_id and own_h, by which the operators name a document."""
        return self.rows.withColumns({"own_id": F.col(self.at("doc_id")).cast("long"), "own_h": F.xxhash64(F.coalesce(self.at("text"), F.lit("")))})

    def back(self, rows: DataFrame, text: str | None = None) -> DataFrame:
        """The columns of docs again; with text: that column as the text, and n_chars with it."""
        found = {x: F.col(self.at(x)) for x in self.names}
        if text:
            found["text"] = F.col(text)
            if "n_chars" in found:
                found["n_chars"] = F.length(text).cast(rows.schema[self.at("n_chars")].dataType)
        return rows.select(*[c.alias(x) for x, c in found.items()])


def _named(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left (own_id, own_h) with right (made_id, made_h), null ids with null ids."""
    return left.join(right, F.col("own_id").eqNullSafe(F.col("made_id")) & (F.col("own_h") == F.col("made_h")), how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those whose language stays open (posterior below LEAST_SCORE). The model learns from docs.

    Null and empty texts have no letter and go. Repeated rows are judged alike and all stay or go. Of languages with equal scores the first in order counts;
    three or more such languages leave a document open. Without any labelled row every document goes.
    """
    own = _Numbered(docs)
    columns = {"id_column": own.at("doc_id"), "text_column": own.at("text")}
    judged = langid.predict(own.rows, langid.fit(own.rows, **columns, lang_column=own.at("lang")), **columns, keep=own.rows.columns)
    return own.back(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def _with_text(docs: DataFrame, made: DataFrame) -> DataFrame:
    """docs with the texts of made (doc_id, h, text: what is left of it). Documents that lost everything go; n_chars follows the text."""
    own = _Numbered(docs)
    new = made.select(F.col("doc_id").alias("made_id"), F.col("h").alias("made_h"), F.col("text").alias("made_text")).dropDuplicates(["made_id", "made_h"])
    had = F.regexp_replace(F.coalesce(own.at("text"), F.lit("")), r"\s+", "") != ""
    rows = own.keyed().withColumn("had", had).drop(own.at("text"))
    both = _named(rows, new, "inner").where(~(F.col("had") & (F.regexp_replace("made_text", r"\s+", "") == "")))
    return own.back(both, "made_text")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs.

    Null texts come back empty. Documents that had none but blank text stay as they are. The same row twice is one document, and both rows stay; rows of one id with
    different texts are documents of their own. Of equal runs the one of the smallest (id, place) stays, null ids first.
    """
    return _with_text(docs, lines.dedup(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8): that of the smallest (id, hash of the text), null ids last.

    Rows equal in id and text are one document, of which one row stays. Rows of one id with different texts are documents of their own.
    Texts without a word are near copies of nothing.
    """
    own = _Numbered(docs)
    found = ngram_join.join(docs, words=5, percent=80)
    marks = found.groupBy("doc_id", "h").agg(F.count("*").alias("made_n"), F.min("first").alias("made_first")).where("NOT made_first OR made_n > 1")
    marks = common.materialize(marks.select(F.col("doc_id").alias("made_id"), F.col("h").alias("made_h"), "made_first"), keep=True)
    once = _named(own.keyed(), marks, "left_anti")
    many = _named(own.keyed(), marks.where("made_first"), "left_semi").dropDuplicates(["own_id", "own_h"])
    return own.back(once.unionByName(many))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes 100-byte strings that also start earlier.

    Null texts come back empty. Documents that had none but blank text stay as they are. Rows that share an id count as one document, the same row twice does not
    repeat itself. Of equal strings the one of the smallest (id, place) stays, null ids first. Characters of which a part goes, go.
    """
    return _with_text(docs, suffixes.repeats(docs, with_text=True))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1024 tokens. Every row is packed, repeated ones and null ids too; an empty text is its end token."""
    return packing.pack(docs)


class _Before(threading.local):
    """Working tables behind the last stage of this thread."""

    def __init__(self):
        self.tables: list[str] = []


_before = _Before()


def _stage(function):
    """The stage, which first deletes the working tables behind the stage before it: its rows are written by now."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(_before.tables, docs)
        mark = common.kept()
        out = function(spark, docs, sf_dir)
        _before.tables = common.kept_since(mark)
        return out

    run_stage.__doc__ = function.__doc__
    return run_stage


STAGES = [
    (f.__name__, _stage(f)) for f in (language, repeated_lines, near_copies, repeated_passages, packed)
]

#: SQL expresses neither the models nor the components; tests/llm/test_llm_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return docs
