import json

import pytest
from pyspark.sql import functions as F

from tonefield import api
from tonefield.operators import candidates, leakage, ranker, sampling
from tonefield.operators.sentiment import predict
from tonefield.sources import feeds, readers, sinks
from tonefield.streaming import ingest

FACT = {"feed_url": "https://feeds.npr.org/x", "article_url": "u1", "fetched_at": "2024-05-01T10:00:00", "sentence": "A met B.", "target_text": "A", "role": "subject", "extraction_confidence": "high", "embedded_entities": [], "resolved_mentions": [], "sentiment": "Neutral", "sentiment_confidence": 0.5}


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_facts_unify_both_spellings(spark, tmp_path):
    p = lines(tmp_path / "f.jsonl", [FACT, FACT | {"sentiment": None, "predicted_sentiment_label": "Positive", "predicted_confidence": 0.9}, FACT | {"sentiment": "", "error": "x"}])
    assert sorted((r["sentiment"] or "-", r["sentiment_confidence"]) for r in readers.facts(spark, p).collect()) == [("-", 0.5), ("Neutral", 0.5), ("Positive", 0.9)]
    assert readers.labelable(spark, p).count() == 2


def test_gold_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text("sentence,target,target_from,target_to,polarity\n A ,b,0,1,2.0\nA,c,0,1,x\n")
    row = readers.gold_csv(spark, str(tmp_path / "g.csv")).first()
    assert row["sentence"] == "A" and [(g["target"], g["polarity"]) for g in row["golds"]] == [("b", 2.0), ("c", None)]
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        readers.gold_csv(spark, str(tmp_path / "bad.csv"))


def test_missing_seen_log_is_empty(spark, tmp_path):
    assert readers.seen_urls(spark, str(tmp_path / "none.txt")).count() == 0


def test_labels_need_their_key(spark):
    labels = spark.createDataFrame([("a", "neg"), ("b", "")], "record_id string, gold_label string")
    key = spark.createDataFrame([("a", "Negative"), ("b", "Neutral")], "record_id string, predicted_label string")
    assert sorted(readers.labels_with_key(labels, key).select("gold_label").collect(), key=str)[0]["gold_label"] == "Negative"
    with pytest.raises(Exception, match="no key for"):
        readers.labels_with_key(labels, key.where("record_id = 'a'")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x"])], "k string, v array<string>")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()["v"] == '["x"]'
    sinks.write_tsv(df, ["k", "k"], str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "a\ta"
    assert json.loads(sinks.metrics_document(df)) == {"k": "a", "v": ["x"]}


def test_feeds_without_a_network(spark):
    pages = {"f": "<item><link>u1</link></item><item></item><entry><link href=\"u2\"/></entry>", "u1": "<p>Hi</p>", "u2": None}
    urls = feeds.feed_urls(spark.createDataFrame([("f",)], "feed_url string"), pages.get, 3)
    assert [r["article_url"] for r in urls.orderBy("article_url").collect()] == ["u1", "u2"]
    assert [tuple(r) for r in feeds.article_texts(urls, pages.get).collect()] == [("u1", "Hi")]


def test_stream_takes_each_article_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: ingest.ingest(ingest.landing(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    lines(tmp_path / "in" / "a.json", [FACT])
    run()
    lines(tmp_path / "in" / "b.json", [FACT, FACT | {"article_url": "u2"}])
    run()
    assert sorted(r["article_url"] for r in spark.read.parquet(str(tmp_path / "out" / "facts")).collect()) == ["u1", "u2"]


def test_streamed_trend_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "a.json", [FACT, FACT | {"fetched_at": "2024-05-02T00:00:00"}, FACT])
    q = ingest.daily_trend(ingest.landing(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("trend").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["day"], r["total"]) for r in spark.table("trend").collect()) == [("2024-05-01", 2), ("2024-05-02", 1)]


def test_api_rules(spark):
    assert api.predict(spark, "Profits rose, good gains for Apple.", "Apple")["sentiment"] == "Positive"
    for bad in ({"sentence": "a", "target": ""}, {"sentence": "abc", "target": "b", "target_from": 1}, {"sentence": "abc", "target": "b", "target_from": 0, "target_to": 1}, {"sentence": "abc", "target": "b", "target_from": 1, "target_to": 9}, {"sentence": "abc", "target": "x"}):
        with pytest.raises(ValueError):
            api.predict_batch(spark, [{"sentence": "abc", "target": "b"}, bad])
    with pytest.raises(ValueError):
        api.predict_batch(spark, [])


def test_errors_stay_rows(spark):
    rows = predict(spark.createDataFrame([("abc", "b"), ("abc", "zz")], "sentence string, target_text string")).orderBy("target_text").collect()
    assert rows[0]["error"] is None and rows[0]["sentiment"] and rows[1]["error"] and rows[1]["sentiment"] is None


def test_sample_quotas(spark):
    rows = [(f"u{i}", f"https://{'ab'[i % 2]}.com", f"s{i // 3}", f"t{i}", ("Negative", "Neutral", "Positive")[i % 3]) for i in range(600)]
    facts = spark.createDataFrame(rows, "article_url string, feed_url string, sentence string, target_text string, sentiment string")
    got = sampling.stratified(facts, 50).collect()
    assert len(got) == 50 and len({r["record_id"] for r in got}) == 50
    counts = {s: sum(r["sentiment"] == s for r in got) for s in ("Negative", "Neutral", "Positive")}
    assert counts == {"Negative": 20, "Neutral": 10, "Positive": 20}
    per = {}
    for r in got:
        per[r["sentence"]] = per.get(r["sentence"], 0) + 1
    assert max(per.values()) <= 2


def test_nearest_is_itself(spark):
    df = spark.createDataFrame([(1, "red fox jumps"), (2, "blue whale sings"), (3, "")], "id long, text string")
    got = {r["query"]: (r["id"], r["similarity"]) for r in leakage.nearest(df, df, "id", "text").collect()}
    assert got == {1: (1, 1.0), 2: (2, 1.0)}


def test_ranker_learns(spark):
    rows = [(k, "Acme fell on bad news", c, s, src, lab) for k in range(20) for c, s, src, lab in (("Acme", 0, "NER", 1), ("bad news", 13, "NOUN_CHUNK", 0))]
    df = spark.createDataFrame(rows, "k int, sentence string, candidate string, start int, source string, label int").withColumn("stop", F.col("start") + F.length("candidate"))
    model = ranker.train(df)
    assert all(r["candidate"] == "Acme" for r in ranker.rank(model, df, ["k"]).where("rank = 1").collect())
    assert len(ranker.coefficients(model, df, 3)) == 3


def test_tfidf_classifier(spark):
    df = spark.createDataFrame([("good gains here", 1.0), ("bad losses here", 0.0)] * 10, "t string, y double")
    model = ranker.tfidf_classifier(df, "t", "y", c=10.0)
    assert model.transform(df).where("prediction <> y").count() == 0


def test_a_model_plugs_into_predict(spark):
    from tonefield.operators.sentiment import model_scorer

    rows = spark.createDataFrame([("a met b", "b"), ("a met b", "c"), ("a met b", "a")], "sentence string, target_text string")
    model = lambda texts: [(0.1, 0.2, 0.7) if x.startswith("[TARGET] a") else (0.6, 0.3, 0.1) for x in texts]
    got = {r["target_text"]: (r["sentiment"], r["sentiment_confidence"], r["error"]) for r in predict(rows, model_scorer(lambda: model)).collect()}
    assert got == {"b": ("Negative", 0.6, None), "a": ("Positive", 0.7, None), "c": (None, None, "target not found in sentence")}


def test_tokens_of_long_sentences(spark):
    words = [f"w{k}" if k % 7 else f"(W{k}," for k in range(1000)]
    s = " ".join(words)
    got = [tuple(r)[1:] for r in candidates.tokens(spark.createDataFrame([(1, s), (2, "")], "k int, sentence string"), ["k"]).orderBy("i").collect()]
    want, at = [], 0
    for k, w in enumerate(words):
        t = w.strip("(,")
        want.append((k, t, at + w.index(t), at + w.index(t) + len(t)))
        at += len(w) + 1
    assert got == want


def test_near_duplicates_documents_equals_brute_force(spark, tmp_path):
    import math
    import re
    from collections import Counter

    from tonefield.plans.registry import QUERIES

    bench = {1: "the river runs past the old mill", 2: "a short note on tax law", 3: "wheat prices rose again in spring"}
    found = {k: f"own words {k} come first and then {bench[1 + k % 3]} and w{k} follows" for k in range(24)} | {50: bench[2], 51: "nothing shared here", 52: None}
    spark.createDataFrame(list(bench.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(found.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    terms = lambda t: Counter(x for x in re.split("[^a-z0-9_à-öø-ÿ]+", (t or "").lower()) if len(x) >= 2)
    df = Counter(x for t in bench.values() for x in terms(t))

    def weights(t):
        w = {x: n * (math.log((1 + len(bench)) / (1 + df[x])) + 1) for x, n in terms(t).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / norm for x, v in w.items()}

    own = {i: weights(t) for i, t in bench.items()}
    want = []
    for q, t in found.items():
        mine = weights(t)
        scores = [(-round(sum(v * other.get(x, 0) for x, v in mine.items()), 6), i) for i, other in own.items() if mine.keys() & other.keys()]
        want += [(q, i, -s) for s, i in sorted(scores)[:1]]
    want = sorted(want, key=lambda r: (-r[2], r[0]))[:20]
    got = [(r["query"], r["id"], r["similarity"]) for r in QUERIES["near_duplicates_documents"](spark, str(tmp_path)).collect()]
    assert want[0] == (50, 2, 1.0) and [r[:2] for r in got] == [r[:2] for r in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))


def _plain_features(sentence, c, start, end, source, ner):
    """C12 in Python, by the names of features()."""
    n, low, w = max(len(sentence), 1), c.lower(), c.split()
    before, after = sentence[start - 1 : start] if start > 0 else "", sentence[end : end + 1]
    out = {"start": start, "end": end, "relative_start": start / n, "relative_end": end / n, "relative_length": len(c) / n, "length": len(c), "words": len(w), "length_squared": len(c) ** 2, "words_squared": len(w) ** 2}
    out |= {f"is_{k.lower()}": source == k for k in ("NER", "NOUN_CHUNK", "PRONOUN", "SUBSPAN_TOKEN", "SUBSPAN_PROPER_NAME", "COORDINATION", "APPOSITIVE_EXPANSION", "TITLE_EXPANSION")}
    out |= {f"is_{k.lower()}": ner == k for k in candidates.NER_FLAGS} | {f"starts_with_{k}": low.startswith(k + " ") for k in ("the", "a", "an")}
    out |= {"is_subspan": source.startswith("SUBSPAN"), "is_normalized": "NORMALIZED" in source, "single_word": len(w) == 1, "two_words": len(w) == 2, "three_words": len(w) == 3, "multi_word": len(w) > 1, "long": len(w) >= 4, "very_long": len(w) >= 8}
    out |= {"starts_with_title": bool(w) and low.split()[0] in candidates.TITLES, "hyphen": "-" in c, "apostrophe": "'" in c or "’" in c, "starts_with_quote": c.startswith(('"', "'", "“", "‘")), "ends_with_quote": c.endswith(('"', "'", "”", "’"))}
    out |= {"starts_with_dash": c.startswith(("-", "–", "—")), "edge_punctuation": c != "" and not (c[0].isalnum() and c[-1].isalnum()), "first_word_capitalised": bool(w) and w[0][0].isupper(), "contains_upper": any(x.isupper() for x in c)}
    out |= {"all_upper": c.isupper(), "all_lower": c.islower(), "title_case": c.istitle(), "at_start": start <= 2, "near_start": start <= 20, "at_end": end >= n - 2, "near_end": end >= n - 20}
    out |= {"preceded_by_space": before.isspace(), "followed_by_space": after.isspace(), "preceded_by_quote": before != "" and before in "\"'“‘", "followed_by_quote": after != "" and after in "\"'”’", "preceded_by_dash": before != "" and before in "-–—", "followed_by_dash": after != "" and after in "-–—"}
    return {f"f_{k}": float(v) for k, v in out.items()}


def test_features_are_all_of_c12(spark):
    text = "“President O'Neil” met U.S.-Iran envoys of the World Bank — an IBM-led group, said Mr. Élan Vital of a very long list of many odd names 12"
    found = [("President O'Neil", "NER", "PERSON"), ("U.S.-Iran", "SUBSPAN_TOKEN", None), ("the World Bank", "NOUN_CHUNK_NORMALIZED", "ORG"), ("an IBM", "TITLE_EXPANSION", None), ("Mr. Élan Vital", "SUBSPAN_PROPER_NAME", "LAW")]
    found += [("“President O'Neil”", "PRONOUN", "GPE"), ("— an IBM-led group", "COORDINATION", None), ("a very long list of many odd names 12", "APPOSITIVE_EXPANSION", "DATE"), ("envoys", "NOUN_CHUNK", None), ("12", "NER", "CARDINAL"), ("IBM", "NER", "ORG")]
    rows = [(text, c, text.index(c), text.index(c) + len(c), source, ner) for c, source, ner in found]
    df = candidates.features(spark.createDataFrame(rows, "sentence string, candidate string, start int, stop int, source string, ner_label string"))
    for r in df.collect():
        want = _plain_features(r["sentence"], r["candidate"], r["start"], r["stop"], r["source"], r["ner_label"])
        assert len(want) == 63 and {k: round(r[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}
    assert {r["ner_label"] for r in df.collect()} >= {"NONE", "PERSON"}


def test_ranker_report_and_sweep(spark):
    rows = [("Acme fell on bad news", c, s, src, lab) for _ in range(10) for c, s, src, lab in (("Acme", 0, "NER", 1), ("bad news", 13, "NOUN_CHUNK", 0))]
    df = spark.createDataFrame(rows, "sentence string, candidate string, start int, source string, label int")
    table, auc = ranker.report(ranker.train(df), df)
    assert auc == 1.0 and {(r["label"], r["f1"], r["support"]) for r in table.collect()} == {(0, 1.0, 10), (1, 1.0, 10)}
    texts = spark.createDataFrame([("good gains here", 1.0), ("bad losses here", 0.0)] * 10, "t string, y double")
    _, c, tried = ranker.tfidf_sweep(texts, texts, "t", "y", (0.5, 10.0))
    assert [x for x, _ in tried] == [0.5, 10.0] and dict(tried)[c] == max(f for _, f in tried) == 1.0
