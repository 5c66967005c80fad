"""Command lines over the engine: `python -m tonefield.cli NAME --help`. Defaults are the functions' own."""

from __future__ import annotations

import argparse
import sys


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()


def predict(spark, a) -> None:
    """Sentences, one a line -> facts as JSON lines."""
    from pyspark.sql import functions as F

    from .operators.resolve import extract_targets
    from .operators.sentiment import predict as scored
    from .sources.readers import sentence_lines
    from .sources.sinks import write_jsonl

    rows = sentence_lines(spark, a.input)
    found = extract_targets(rows, ["row_id"]).where(F.col("confidence") != "none").withColumnRenamed("target", "target_text")
    write_jsonl(scored(found), a.output)


def dataset(spark, a) -> None:
    """Annotated articles -> records with gold labels as JSON lines."""
    from pyspark.sql import functions as F

    from .operators.marking import dataset as labelled
    from .operators.resolve import extract_targets, first_sentences, resolve_articles
    from .operators.sentiment import records
    from .sources.readers import articles
    from .sources.sinks import write_jsonl

    keys = ["article_id", "sentence_index"]
    rows = articles(spark, a.input)
    gold = rows.select(*keys, F.posexplode("targets").alias("gold_pos", "t")).select(*keys, "gold_pos", F.col("t.mention").alias("gold_target"), "t.polarity")
    texts = first_sentences(rows.select(*keys, "sentence"), a.max_sentences)
    write_jsonl(labelled(records(extract_targets(texts, keys), resolve_articles(texts)), gold, keys), a.output)


def ingest(spark, a) -> None:
    """A landing folder of facts -> the table by day, each article once."""
    from .streaming.ingest import ingest as run
    from .streaming.ingest import landing

    run(landing(spark, a.input), a.output, a.checkpoint, a.force).awaitTermination()


def leaderboard(spark, a) -> None:
    """Facts as JSON lines -> the entities most spoken of."""
    from pyspark.sql import functions as F

    from .operators.entities import leaderboard as best
    from .sources.readers import facts

    best(facts(spark, a.input).withColumn("row_id", F.monotonically_increasing_id()), a.min_mentions, a.top).show(a.top, False)


def trend(spark, a) -> None:
    """Facts as JSON lines -> entities of several days."""
    from .operators.entities import multi_day
    from .sources.readers import facts

    multi_day(facts(spark, a.input), a.min_mentions).show(100, False)


def evaluate(spark, a) -> None:
    """A gold table -> tiers in which selection meets its targets, and recall."""
    from pyspark.sql import functions as F

    from .operators import evaluate as EV
    from .operators.resolve import extract_targets, resolve_articles
    from .sources.readers import gold_csv

    keys = ["article_id", "sentence_index"]
    rows = gold_csv(spark, a.input).withColumns({"article_id": F.col("first_row").cast("string"), "sentence_index": F.lit(0)})
    texts = rows.select(*keys, "sentence")
    pools = EV.match_pools(extract_targets(texts, keys), resolve_articles(texts), keys)
    gold = rows.select(*keys, F.explode("golds").alias("g")).select(*keys, F.col("g.target").alias("gold"))
    EV.tier_summary(EV.selection_tiers(gold, pools, keys).withColumn("model", F.lit(a.model))).show(truncate=False)


COMMANDS = {
    "predict": (predict, {"output": {}}),
    "dataset": (dataset, {"output": {}, "--max-sentences": {"type": int, "default": 15}}),
    "ingest": (ingest, {"output": {}, "checkpoint": {}, "--force": {"action": "store_true"}}),
    "leaderboard": (leaderboard, {"--min-mentions": {"type": int, "default": 3}, "--top": {"type": int, "default": 20}}),
    "trend": (trend, {"--min-mentions": {"type": int, "default": 2}}),
    "evaluate": (evaluate, {"--model": {"default": "rules"}}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tonefield")
    names = out.add_subparsers(dest="command", required=True)
    for name, (run, options) in COMMANDS.items():
        p = names.add_parser(name, help=run.__doc__)
        p.add_argument("input")
        for option, how in options.items():
            p.add_argument(option, **how)
    return out


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    COMMANDS[a.command][0](_session(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
