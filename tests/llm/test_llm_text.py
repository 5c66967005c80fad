import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tonefield.llm import bpe, common, langid, lines, ngram_join, packing, suffixes, tokens, words

SF = "/root/testdata/sf0.001"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, EMPTY)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (5, "é漢😀 <|endoftext|> x"), (6, "ab " * 3000), (7, "same text here"), (8, "same text here"), (8, "same text here"), (None, "no id at all")]


# byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_bpe_equals_tiktoken(tiktoken_):
    encode = bpe._encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  \n\té漢😀'stx--__==00 1") for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(0, 70))) for _ in range(2000)] + ["a" * 5000, " " * 3000, "-" * 4000, "x \x1c y", "don't  stop "]
    for t in texts:
        assert encode(t) == tiktoken_.encode_ordinary(t)


def test_bpe_query(spark, corpus, tiktoken_):
    every = corpus.unionByName(docs(spark, ODD))
    got = Counter(tuple(r) for r in bpe.encode_decode(every, digest=True).collect())
    want = Counter()
    for r in every.collect():
        ids = tiktoken_.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert got == want


def test_memory_of_words_is_bounded():
    r = tokens.Remembered(lambda xs: [[x] for x in xs], lambda parts: list(itertools.chain.from_iterable(parts)), memory=5)
    for k in range(50):
        assert "".join(r(" ".join(f"w{k}{j}" for j in range(9)))) == " ".join(f"w{k}{j}" for j in range(9))
    assert len(r.known) <= 9


# packing


def test_fast_ids_equal_the_tokenizers_library(corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = packing._encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    for text in [r["text"] for r in corpus.limit(60).collect()] + [x or "" for _, x in ODD]:
        assert encode(text) == np.asarray(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_of_very_long_runs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = packing._encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    n, rng = 2_000_000, random.Random(1)
    texts = [" " * n + "x", "a" * n, "-" * n, "".join(rng.choices(" \n\t\r", k=n)) + "x y", " " * 300_000 + "<|endoftext|> " + "b" * 300_000 + " x y", "alpha  beta gamma\n" * 60_000]
    for text in texts:
        assert encode(text) == np.asarray(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_blocks_join_to_the_text():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices("ab \n", k=rng.randint(0, 60)))
        parts = tokens.blocks(text, 7)
        assert "".join(parts) == text
        assert all(p[0] == " " and not p[1].isspace() and not q[-1].isspace() for q, p in itertools.pairwise(parts))


def test_packing_long_and_clashing(spark):
    rows = [(1, " " * 600_000 + "x", 0, 0), (1, " " * 600_000 + "x", 1, 1), (None, "a b", 2, 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, piece long, sequence_id long")
    got = packing.pack(d).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 2 * sum(r["length"] for r in packing.pack(d.limit(1)).collect())
    assert [r["length"] for r in got if r["doc_id"] is None] == [3]


@pytest.mark.parametrize("n, want", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2048, [(0, 1024), (1024, 1024)]), (2050, [(0, 2), (2, 1024), (1026, 1024)])])
def test_cut(n, want):
    assert packing.cut(n) == want


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_and_few_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1025, rng.integers(1, 4000))
    counts = np.bincount(lengths, minlength=1025)
    plan = packing.fill(counts)
    used = Counter()
    for content, often in plan:
        assert sum(k * n for k, n in content.items()) <= 1024 and often > 0
        for k, n in content.items():
            used[k] += n * often
    assert used == Counter(lengths.tolist())
    bins = []  # best fit decreasing, piece by piece
    for x in sorted(lengths.tolist(), reverse=True):
        fit = [k for k, room in enumerate(bins) if room >= x]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= x
        else:
            bins.append(1024 - x)
    assert sum(n for _, n in plan) <= len(bins) * 1.01 + 1


def plain_best_two_fit(lengths, capacity):
    """Bin by bin over single pieces: the largest that fits goes in; then the smallest is replaced by the two left-over pieces whose sum is largest, if that
    is more than it and still fits; of equal sums the pair with the larger piece."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own, gap, k = [], capacity, 0
        while k < len(left):
            if left[k] <= gap:
                gap -= left[k]
                own.append(left.pop(k))
            else:
                k += 1
        if gap:
            small = min(own)
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= gap + small]
            if pairs:
                _, a, b = max(pairs, key=lambda p: (p[0], p[1]))
                own.remove(small)
                left.remove(a), left.remove(b)
                own += [a, b]
                left = sorted([*left, small], reverse=True)
        bins.append(tuple(sorted(own)))
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_plan_equals_plain_best_two_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 60))]
    plan = packing.fill(np.bincount(lengths, minlength=capacity + 1))
    got = [tuple(sorted(x for x, n in content.items() for _ in range(n))) for content, often in plan for _ in range(often)]
    assert Counter(got) == Counter(plain_best_two_fit(lengths, capacity))


def test_smallest_is_replaced_by_two():
    counts = np.zeros(11, np.int64)
    for x in (6, 3, 2, 2):
        counts[x] += 1
    assert packing.fill(counts)[0] == ({6: 1, 2: 2}, 1)


def test_packing_places(spark, corpus):
    every = corpus.unionByName(docs(spark, ODD))
    rows = packing.pack(every).collect()
    by_bin = defaultdict(list)
    for r in rows:
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_bin.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    encode = packing._encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    want = Counter()
    for r in every.collect():
        ids = encode(r["text"] or "") + np.array([2], "<u4").tobytes()
        for k, (s, n) in enumerate(packing.cut(len(ids) // 4)):
            want[r["doc_id"], k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert packing.pack(docs(spark, [])).count() == 0


# language


def random_model(languages=("x",), seed=1):
    pieces = langid.vocabulary_pieces("piece_bpe_32k.model")
    return langid.Model(list(languages), "piece_bpe_32k.model", np.random.default_rng(seed).random((len(pieces.row) + 1, len(languages))) / 100)


def brute_word(word, model, language=0):
    """Log of the sum over all segmentations, place by place, with numbers of any size."""
    from fractions import Fraction

    pieces, marked = langid.vocabulary_pieces(model.vocabulary), langid.START + word
    p = [Fraction(float(x)) for x in model.probability[:, language]]
    sums = [Fraction(1)]
    for end in range(1, len(marked) + 1):
        total = Fraction(0)
        for n in range(1, min(end, pieces.longest) + 1):
            piece = marked[end - n : end]
            if piece in pieces.row:
                total += sums[end - n] * p[pieces.row[piece]]
            elif n == 1:
                total += sums[end - 1] * p[-1]
        sums.append(total)
        if len(sums) > 40:
            sums[-40] = None
    return float(np.log(float(sums[-1].numerator >> max(0, sums[-1].numerator.bit_length() - 60))) + max(0, sums[-1].numerator.bit_length() - 60) * np.log(2) - (sums[-1].denominator.bit_length() - 1) * np.log(2))


def test_forward_sums_all_segmentations():
    model = random_model()
    pieces = langid.vocabulary_pieces(model.vocabulary)

    def brute(marked):
        if not marked:
            return 1.0
        total = sum(model.probability[pieces.row[marked[:n]], 0] * brute(marked[n:]) for n in range(1, min(len(marked), pieces.longest) + 1) if marked[:n] in pieces.row)
        return total + (0 if marked[:1] in pieces.row else model.probability[-1, 0] * brute(marked[1:]))

    for w in ("the", "nation", "xé漢", "z", "Ж\U00020000"):
        assert np.isclose(langid.log_scores([w], model)[0, 0], np.log(brute(langid.START + w)))
        assert np.isclose(brute_word(w, model), np.log(brute(langid.START + w)))


def test_long_words_score_by_their_own_pieces(monkeypatch):
    model, rng = random_model(("x", "y")), random.Random(3)
    found = ["字" * 100, "ж" * 300, "".join(rng.choices("etaoinжé字\U00020000", k=700)), "nation" * 60]
    got = langid.log_scores(found, model)
    for w, row in zip(found, got, strict=True):
        assert np.allclose(row, [brute_word(w, model, k) for k in (0, 1)], rtol=1e-9)
    for cut in (3, 17, 64):  # segment by segment gives the same
        monkeypatch.setattr(langid, "LONG", cut)
        assert np.allclose(langid.log_scores(found, model), got, rtol=1e-12)
    monkeypatch.undo()
    longer = ["".join(rng.choices("etaoin", k=5000)), "ж" * 5000]
    split = langid.log_scores(longer, model)
    monkeypatch.setattr(langid, "LONG", 10_000)
    assert np.allclose(split, langid.log_scores(longer, model), rtol=1e-12) and (split < -5000).all()


def test_fit_equals_plain_expectation_maximisation():
    """Two rounds over a few words against sums over listed segmentations."""
    found, languages = ["the", "then", "nation", "字字"], ["a", "b"]
    counts = np.array([[3, 0], [1, 2], [0, 5], [2, 1]], float)
    pieces = langid.vocabulary_pieces("piece_bpe_32k.model")
    n = len(pieces.row) + 1

    def ways(marked):
        if not marked:
            return [[]]
        out = [[pieces.row[marked[:k]], *w] for k in range(1, len(marked) + 1) if marked[:k] in pieces.row for w in ways(marked[k:])]
        return out if marked[0] in pieces.row else out + [[n - 1, *w] for w in ways(marked[1:])]

    def arcs(marked):
        for s in range(len(marked)):
            hit = [pieces.row[marked[s:e]] for e in range(s + 1, len(marked) + 1) if marked[s:e] in pieces.row]
            yield from hit if marked[s] in pieces.row else [*hit, n - 1]

    expected = np.zeros((n, 2))
    for w, c in zip(found, counts, strict=True):
        for p in arcs(langid.START + w):
            expected[p] += c / (len(w) + 1)
    for turn in range(3):
        if turn:
            expected = np.zeros((n, 2))
            for w, c in zip(found, counts, strict=True):
                each = ways(langid.START + w)
                weight = np.array([np.prod(probability[way], axis=0) for way in each])  # noqa: F821
                for way, share in zip(each, weight / weight.sum(0), strict=True):
                    for p in way:
                        expected[p] += share * c
        expected += 0.01
        expected[-1] = 0
        probability = expected / expected.sum(0)
        probability[-1] = langid.UNKNOWN
    assert np.allclose(langid.fit_counts(found, counts, languages, "piece_bpe_32k.model").probability, probability)


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(d, langid.fit(d))
    right = got.join(d.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    held = {r["doc_id"] for r in got.where("held_out").collect()}
    assert held == {r["doc_id"] for r in d.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}


def test_language_odd_rows(spark, corpus):
    model = langid.fit(corpus)
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.predict(docs(spark, ODD + [(9, "²³ 12")]), model).collect()}
    assert got[1, "und"] == got[2, "und"] == got[3, "und"] == got[9, "und"] == 0
    assert all(0 <= s <= 1 for s in got.values())
    long = [(1, "字" * 3000), (2, "ж" * 300), (3, "the " * 20000 + "x" * 5000), (3, "the " * 20000 + "x" * 5000)]
    clash = spark.createDataFrame([(*r, "kept", 7) for r in long], "doc_id long, text string, lang_pred string, held_out int")
    own = langid.predict(clash, model).collect()
    assert [r["lang_pred"] for r in own if r["doc_id"] == 3] == ["en", "en"] and all(r["lang_pred"] != "und" for r in own)
    none = langid.fit(docs(spark, []))
    assert [r["lang_pred"] for r in langid.predict(docs(spark, [(1, "abc")]), none).collect()] == ["und"]


# columns that operators might use for themselves


@pytest.mark.parametrize("apply", [lambda d: lines.dedup(d), lambda d: suffixes.repeats(d), lambda d: ngram_join.join(d), lambda d: bpe.encode_decode(d, digest=True), lambda d: packing.pack(d)])
def test_other_columns_do_not_matter(spark, apply):
    names = ("h", "line", "part", "chunk", "n", "sid", "i", "t", "no_id", "first", "start", "pos", "DATA")
    rows = [(1, "a b c d e f\nx"), (2, "a b c d e f\ny " * 20), (None, "z"), (2, "a b c d e f\ny " * 20), (3, None)]
    plain = apply(spark.createDataFrame(rows, "doc_id long, text string"))
    wide = apply(spark.createDataFrame([(*r, *["?"] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{x} string" for x in names)))
    assert plain.columns == wide.columns
    drop = [c for c in ("sequence_id", "offset") if c in plain.columns]
    assert Counter(map(str, plain.drop(*drop).collect())) == Counter(map(str, wide.drop(*drop).collect()))


@pytest.mark.parametrize("apply", [lambda d: lines.dedup(d), lambda d: suffixes.repeats(d, with_text=True), lambda d: ngram_join.join(d), lambda d: bpe.encode_decode(d)])
def test_very_long_texts(spark, apply):
    rows = [(1, "word " * 200_000), (2, "x" * 1_000_000 + "\n" + "y" * 10), (3, "\n" * 300_000 + "y" * 10)]
    assert apply(docs(spark, rows)).count() == 3


# lines


def brute_lines(rows, least):
    out, first = [], defaultdict(list)
    seqs = [(i, lines.lines_of((t or "").encode()), (t or "").encode()) for i, t in rows]
    for a, (i, own, text) in enumerate(seqs):
        lost = np.zeros(len(own), bool)
        for k in range(len(own)):
            far = 0
            for b, m in first[own[k][1]]:
                n = 0
                while k + n < len(own) and m + n < len(seqs[b][1]) and own[k + n][1] == seqs[b][1][m + n][1]:
                    n += 1
                far = max(far, n)
            first[own[k][1]].append((a, k))
            if far and sum(len(x.split()) for _, x in own[k : k + far]) >= least:
                lost[k : k + far] = True
        gone = {own[k][0] for k in np.flatnonzero(lost)}
        kept = b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in gone)
        out.append((i, len(own), int(lost.sum()), kept.decode()))
    return out


@pytest.mark.parametrize("least", [1, 5])
def test_lines_equal_brute_force(spark, least):
    rng = random.Random(least)
    rows = [(i, "\n".join(rng.choice(["a b", "c", "d e f", "g", "", "h i j k l"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100, None), (101, "x y\n" * 40), (102, "x y\n" * 37)]
    got = sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in lines.dedup(docs(spark, rows), least).collect())
    assert got == brute_lines(rows, least)


def test_runs_across_tasks(spark):
    """One long document's lines are numbered by several tasks; its run of all lines must stay whole."""
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.enabled")
    before = {x: spark.conf.get(x) for x in names}
    for x in names:
        spark.conf.set(x, "false")
    try:
        whole = "\n".join(f"w{k}" for k in range(2000))
        got = {r["doc_id"]: r["n_removed"] for r in lines.dedup(docs(spark, [(1, whole), (2, whole), (3, "w7\nw8")]), 1500).collect()}
    finally:
        for x in names:
            spark.conf.set(x, before[x])
    assert got == {1: 0, 2: 2000, 3: 0}


def test_ranks_are_those_of_a_suffix_array(spark):
    rng = random.Random(9)
    table, at = [], 0
    for _ in range(12):
        n = rng.randint(1, 9)
        own = [rng.randint(0, 3) for _ in range(n)]
        table += [(at + k, v, 0, n - k) for k, v in enumerate(own)]
        at += n + 1
    word = {p: v for p, v, _, _ in table}
    levels = lines.doubled(spark.createDataFrame(table, "pos long, v1 long, v2 long, left long"))
    for k, level in enumerate(levels):
        span = 1 << k
        windows = {p: tuple(word[p + j] for j in range(span)) for p, _, _, left in table if left >= span}
        times = Counter(windows.values())
        order = sorted(w for w, n in times.items() if n > 1)
        want = {p: (order.index(w), min(q for q, x in windows.items() if x == w)) for p, w in windows.items() if times[w] > 1}
        assert {r["pos"]: (r["r"], r["first"]) for r in level.collect()} == want
    assert len(levels) > 1


def test_lines_odd_rows(spark):
    got = lines.dedup(docs(spark, ODD), 1).collect()
    assert len(got) == len(ODD)
    assert [r["n_removed"] for r in got if r["doc_id"] == 8] == [1, 1]
    assert lines.dedup(docs(spark, [])).count() == 0


def test_short_repeated_lines_go_by_default(spark, tmp_path):
    rows = [(1, "one two\nfirst own line"), (2, "one two\nsecond own line\nx"), (3, "x\nthird own line\none two\nsecond own line")]
    want = brute_lines(rows, 0)
    assert [r[2] for r in want] == [0, 1, 3]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, lines.op3_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()))
    assert got == [(i, n, lost, hashlib.sha256(text.encode()).hexdigest()) for i, n, lost, text in want]
    left = corpus_pipeline.repeated_lines(spark, docs(spark, rows), SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(r[0], r[3]) for r in want]


# n-gram join


def brute_join(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n, percent, tile, group, postings", [(4, 85, 512, 256, 4096), (5, 80, 512, 256, 4096), (2, 50, 3, 2, 5), (1, 60, 4, 1, 7)])
def test_join_equals_brute_force(spark, n, percent, tile, group, postings):
    rng = random.Random(n)
    base = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 60))) for _ in range(25)]
    rows = []
    for i in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"W{rng.randint(0, 60)}"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "ONE  two"), (204, "one\x0btwo"), (205, "one two")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs(spark, rows), n, percent, tile=tile, group=group, postings=postings).collect()}
    assert got == brute_join(rows, n, percent)


def test_join_odd_rows(spark, corpus):
    got = ngram_join.join(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (7, 8)} == {7}
    assert next(r for r in got if r["doc_id"] is None)["component_id"] is None
    text = "a b c d e f"
    odd = [(None, text, 0), (None, text + " g h", 0), (9, "own words here and there " * 9, 0), (9, "own words here and there " * 9 + "x", 0), (9, "of another kind, this one is", 0), (None, "own words here and there " * 9 + "y", 0)]
    rows = sorted((r["n_shingles"], r["component_id"] or 0, r["first"]) for r in ngram_join.join(spark.createDataFrame(odd, "doc_id long, text string, h int")).collect())
    assert rows[0] == (2, 0, True) and rows[1][:2] == (2, 9) and rows[2] == (4, 0, True)  # a null id has its shingles
    assert [r[1] for r in rows[3:]] == [9, 9, 9] and sorted(r[2] for r in rows[3:]) == [False, False, True]
    assert ngram_join.join(docs(spark, [])).count() == 0
    rows = [tuple(r) for r in corpus.select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(corpus).collect()} == brute_join(rows, 5, 80)


def test_words_of_long_texts_do_not_depend_on_the_cut(monkeypatch):
    text = ("alpha Beta\tgamma  delta " * 500).encode()
    whole = words.word_hashes([text, b"", b"x"])
    monkeypatch.setattr(words, "PIECE", 64)
    cut = words.word_hashes([text, b"", b"x"])
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5100)]
    got = {r["a"]: r["b"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    node, low = common.forest(*map(np.array, zip(*edges, strict=True)))
    assert got == {int(v): int(m) for v, m in zip(node, low, strict=True) if v != m}


# suffixes


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        covered = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                covered[s : s + length] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~covered].tobytes()
        spans = int((np.diff(covered.astype(int), prepend=0) > 0).sum())
        out.append((i, len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    for _ in range(300):
        s = rng.integers(1, rng.choice([2, 3, 4, 250]), rng.integers(1, 60)).astype(np.int64)
        assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_repeats_equal_brute_force(spark, corpus, hot):
    rows = [tuple(r) for r in corpus.select("doc_id", "text").orderBy("doc_id").collect()]
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    n = max(r[0] for r in rows) + 1
    rows += [(n, "a" * 3000), (n + 1, "ab" * 400 + "x" * 300), (n + 2, None), (n + 3, "é" * 80), (n + 4, "zé" * 120), (n + 5, "q" + "ab" * 60)]
    rows += [(n + 10 + k, f"{k} " * k + passage[k : 150 + 7 * k] + " tail" * k) for k in range(30)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.repeats(docs(spark, rows), hot_level=hot).collect())
    assert got == brute_repeats(rows)


def test_bytes_decide_where_hashes_agree(spark, monkeypatch):
    """With hashes of a few bits, runs that differ meet as equal ones; none of them may go."""
    real = suffixes.mix
    monkeypatch.setattr(suffixes, "mix", lambda x: real(x) & np.uint64(0xF00000000000000F) if np.ndim(x) else real(x))
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefgh ", k=300))
    rows = [(k, "".join(rng.choices("abcdefgh ", k=rng.randint(90, 500))) + passage[k : 120 + 5 * k]) for k in range(30)]
    table = suffixes.exchange.Docs(np.arange(30), np.zeros(30, np.int64), [t.encode() for _, t in rows], np.zeros(30, bool))
    found = np.concatenate([np.unique(suffixes.Runs(table.texts, 100, 32).value)])
    answers = [(0, np.full(len(found), 3, np.uint8).tobytes())]
    frames = list(suffixes.sent(100, 32, 6, 48)("c", table, answers))
    sent = [(r.part, r.chunk, r.data) for f in frames for r in f.itertuples()]
    import pandas as pd

    met = pd.DataFrame(sorted((p, c, d) for p, c, d in sent if p >= 0), columns=["part", "chunk", "data"])
    back = [(r.part, r.data) for f in suffixes.repeated(100, 32)([met]) for r in f.itertuples()] + [(p, d) for p, _, d in sent if p < 0]
    out = next(iter(suffixes.finished(False, False)("c", table, back)))
    assert [tuple(r) for r in out[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False)] == brute_repeats(rows)


def test_repeats_odd_rows(spark):
    twin = "p" * 60 + "".join(map(chr, range(97, 122))) * 6
    got = suffixes.repeats(docs(spark, [*ODD, (20, twin), (20, twin), (21, twin)]), with_text=True, with_spans=True).collect()
    assert [r["n_removed"] for r in got if r["doc_id"] == 20] == [0 + got[[x["doc_id"] for x in got].index(20)]["n_removed"]] * 2
    last = next(r for r in got if r["doc_id"] == 21)
    assert (last["n_removed"], last["text"], last["spans"]) == (len(twin), "", [0, len(twin)])
    assert suffixes.repeats(docs(spark, [])).count() == 0
