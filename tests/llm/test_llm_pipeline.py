import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from test_llm_text import brute_join, brute_lines, brute_word

from tonefield.llm import common, langid, packing

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that stages might use for themselves.
CLASH = ["h", "had", "score", "lang_pred", "made_text", "made_id", "made_h", "own_id", "own_h", "first", "component_id", "held_out", "in_0", "in_9", "piece", "no_id"]
STAGE = dict(corpus_pipeline.STAGES)


def odd_rows():
    """Copies, shared lines and passages, repeated rows, null ids and texts, long texts, one id with several texts."""
    rng = random.Random(11)
    word = ["the", "house", "and", "water", "of", "green", "river", "under", "nation", "with", "people", "long", "story", "was", "told", "in", "winter"]
    text = lambda n: " ".join(rng.choices(word, k=n))
    rows = [(k, "\n".join(text(12) for _ in range(4))) for k in range(12)]
    rows += [(20, rows[3][1]), (21, rows[4][1].replace("house", "casa", 1)), (22, rows[5][1] + "\nown ending"), (None, rows[6][1]), (None, "nothing but an own text without an id, told in winter")]
    rows += [(23, rows[7][1]), (23, rows[7][1]), (23, "another text under the same number, told by the river"), (24, rows[8][1] + " x"), (24, rows[8][1] + " y z")]
    passage = text(60)
    rows += [(30 + k, f"{text(10)} {passage} {text(10)}") for k in range(4)] + [(40, None), (41, ""), (42, " \n "), (43, "12 34"), (44, "the house " * 30_000), (45, "river" * 120), (25, rows[9][1]), (25, rows[9][1]), (25, rows[9][1])]
    return [(i, t, ("en", None, "de")[k % 3], "s", len(t or "")) for k, (i, t) in enumerate(rows)]


def frame(spark, rows):
    schema = COLUMNS + "".join(f", {c} string" for c in CLASH)
    return spark.createDataFrame([(*r, *[f"{c} of {k}" for c in CLASH]) for k, r in enumerate(rows)], schema)


def brute_language(docs, rows):
    model = langid.fit(docs)
    score = {}

    def kept(text):
        found = langid.words_of(text or "")
        if not any(c.isalpha() for w in found for c in w):
            return False
        for w in found:
            if w not in score:
                score[w] = np.array([brute_word(w, model, k) for k in range(len(model.languages))])
        total = sum(score[w] for w in found)
        return 1 / np.exp(total - total.max()).sum() >= corpus_pipeline.LEAST_SCORE

    return [r for r in rows if kept(r[1])]


def brute_stage(name, docs, rows):
    """rows (doc_id, text, lang, source, n_chars, *more), in the order of table -> what the stage keeps."""
    order = lambda i, t: (i is not None, i or 0, hashes[t or ""])
    hashes = {r["t"]: r["h"] for r in docs.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS h").collect()}
    if name == "language":
        return brute_language(docs, rows)
    texts = sorted({(i, t or "") for i, t, *_ in rows}, key=lambda r: order(*r))
    if name == "near_copies":
        roots = {k: c for k, (_, c) in brute_join(list(enumerate(texts_of(texts))), 5, 80).items()}
        groups = {}
        for k, r in enumerate(texts):
            groups.setdefault(roots[k], []).append(r)
        stay = {min(g, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]])) for g in groups.values()}
        out = {}
        for r in rows:
            if (r[0], r[1] or "") in stay:
                out.setdefault((r[0], r[1] or ""), r)
        return list(out.values())
    if name == "repeated_lines":
        left = {r: made[3] for r, made in zip(texts, brute_lines(texts, 1), strict=True)}
    else:
        left = dict(zip(texts, passages_gone(texts), strict=True))
    return [(r[0], t, *r[2:4], len(t), *r[5:]) for r in rows for t in [left[r[0], r[1] or ""]] if t.strip() or not (r[1] or "").strip()]


def texts_of(rows):
    return [t for _, t in rows]


def passages_gone(texts, length=100):
    seen, out = {}, []
    for i, t in texts:
        b, i = t.encode(), -(2**63) if i is None else i
        lost = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen.setdefault(b[s : s + length], (i, s)) < (i, s):
                lost[s : s + length] = True
        out.append(np.frombuffer(b, np.uint8)[~lost].tobytes().decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize("name", ["language", "repeated_lines", "near_copies", "repeated_passages"])
def test_stage_equals_a_plain_version(spark, name):
    rows = odd_rows()
    if name == "repeated_passages":  # one id with several texts is one document there
        rows = [r for r in rows if r[0] not in (23, 24) and "own text" not in (r[1] or "")]
    docs = frame(spark, rows)
    got = [tuple(r) for r in STAGE[name](spark, docs, SF).collect()]
    want = brute_stage(name, docs, [tuple(r) for r in docs.collect()])
    if name == "near_copies":  # of rows equal in id and text any may stay
        got, want = ([r[:5] for r in x] for x in (got, want))
        got, want = ([(i, t, s) for i, t, _, s, _ in x] for x in (got, want))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert 0 < len(got) < len(rows) or name.startswith("repeated")


def test_lost_texts_and_lengths(spark):
    rows = [(1, "a b\nc d e", "en", "s", 0), (2, "a b", "en", "s", 0), (3, "x\n\nc d e", "en", "s", 0), (4, " ", "en", "s", 0), (5, None, "en", "s", 0)]
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["h"]) for r in STAGE["repeated_lines"](spark, frame(spark, rows), SF).collect()}
    assert got == {1: ("a b\nc d e", 9, "h of 0"), 3: ("x\n", 2, "h of 2"), 4: (" ", 1, "h of 3"), 5: ("", 0, "h of 4")}


def test_packed_places_every_row(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = odd_rows()
    got = STAGE["packed"](spark, frame(spark, rows), SF).collect()
    want = []
    for i, text, *_ in rows:
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        first = len(ids) % 1024
        cuts = [0, *range(first or 1024, len(ids), 1024), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted((w[0] or -1, *w[1:]) if w[0] != 0 else (-1, *w[1:]) for w in want)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"] and r["offset"] + r["length"] <= 1024
        ends[r["sequence_id"]] = r["offset"] + r["length"]


def test_run_equals_its_stages_one_by_one(spark, tmp_path):
    rows = [r for r in odd_rows() if r[0] not in (23, 24)]
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for name, _ in corpus_pipeline.STAGES[:-1]:
        now = brute_stage(name, docs, [tuple(r) for r in docs.collect()])
        docs = spark.createDataFrame(now, COLUMNS)
    want = packing.pack(docs).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "repeated_lines", "near_copies", "repeated_passages", "packed"]
    before, seen = docs.count(), docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = common.materialize(stage(spark, seen, SF))
        assert seen.columns == names and 0 < seen.count() <= before
        before = seen.count()
    assert all(r["n_chars"] == len(r["text"]) for r in seen.collect())


def test_clean_documents_stay_and_copies_go(spark):
    words = lambda k: " ".join(f"wort{k}x{j}" for j in range(80))
    rows = [(k, words(k), "en", "s", 0) for k in range(20)] + [(50, words(3), "en", "s", 0), (51, words(4).replace("wort4x40", "other"), "en", "s", 0), (52, "12 34", "en", "s", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {k: words(k) for k in range(20)}


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
