"""Feeds and pages. Fetching is a function the caller gives, so that everything runs without a network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def feed_urls(feeds: DataFrame, fetch: Callable[[str], str | None], per_feed: int = 3) -> DataFrame:
    """feeds (feed_url) -> (feed_url, article_url): the first entries that have a link."""

    def run(batches):
        import re

        import pandas as pd

        for pdf in batches:
            rows = []
            for url in pdf["feed_url"]:
                body = fetch(url) or ""
                items = re.findall(r"(?s)<(?:item|entry)\b.*?</(?:item|entry)>", body)
                links = [m[1] or m[2] for x in items if (m := re.search(r"<link>\s*([^<\s]+)\s*</link>|<link[^>]*href=\"([^\"]+)\"", x))]
                rows += [(url, k, link) for k, link in enumerate(links)]
            yield pd.DataFrame(rows, columns=["feed_url", "k", "article_url"])

    found = feeds.select("feed_url").mapInPandas(run, "feed_url string, k int, article_url string")
    return found.withColumn("r", F.row_number().over(W.partitionBy("feed_url").orderBy("k"))).where(F.col("r") <= per_feed).select("feed_url", "article_url")


def article_texts(urls: DataFrame, fetch: Callable[[str], str | None]) -> DataFrame:
    """urls (article_url) -> (article_url, text); pages that cannot be fetched go."""
    from ..operators.sentences import html_to_text

    def run(batches):
        for pdf in batches:
            yield pdf.assign(html=[fetch(u) for u in pdf["article_url"]])

    return urls.select("article_url").mapInPandas(run, "article_url string, html string").where("html IS NOT NULL").select("article_url", html_to_text("html").alias("text"))
