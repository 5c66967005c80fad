import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import same

from tonefield.llm import embeddups, queries, topk, urls, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name]))


# URLs

PAGES = "page_id long, url string, html string"


def test_urls_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.ORG"), (5, "http://a.example.org/es/x?y#z"), (6, "http://example.org/en/12"), (7, "x://b.com/de/1"), (8, "x://b.com/fr/1"), (9, "http://É.net?q"), (9, "http://É.net?q"), (10, "a://b://c/d")]
    pages = spark.createDataFrame([(i, u, None) for i, u in rows], PAGES)
    none = spark.createDataFrame([], "page_id long, bad int")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, none).collect())
    assert got[:8] == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.example.org", "", None, "allow"), (5, "a.example.org", "/es/x", "example.org/es/", "block"),
        (6, "example.org", "/en/12", "example.org/en/1", "allow"), (7, "b.com", "/de/1", "com/de/", "block"), (8, "b.com", "/fr/1", "com/fr/", "allow"),
    ]
    assert got[8:] == [(9, "É.net", "", None, "allow")] * 2 + [(10, "b:", "//c/d", None, "allow")]
    assert urls.filter_urls(spark.createDataFrame([], PAGES), none).count() == 0


def test_urls_clashing_columns_long_urls_and_null_ids(spark):
    long = "http://a.example.org/" + "é/" * 500_000 + "?q"
    pages = spark.createDataFrame([(1, long, "h", 1.0), (None, "http://b.net/", "h", 2.0), (1, long, "h", 1.0)], "page_id long, url string, host string, lower double")
    got = urls.filter_urls(pages, spark.createDataFrame([(1, 0), (None, 1)], "page_id long, bad int")).collect()
    assert sorted((r["page_id"] or 0, r["host"], len(r["path"]), r["n_labelled"]) for r in got) == [(0, "b.net", 1, 0), (1, "a.example.org", 1_000_001, 2), (1, "a.example.org", 1_000_001, 2)]


def test_suffix_list(spark, tmp_path):
    (tmp_path / "list").write_text("// comment\ncom\nco.uk\n*.ck\n!www.ck\nCOM.au // more\n\na.b.c\n")
    two = urls.two_label_suffixes(spark, str(tmp_path / "list"))
    assert two == ("co.uk", "com.au")
    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.y.com",), ("com.au",)], "h string")
    assert [tuple(r) for r in hosts.select(urls.domain_of(hosts["h"], two), urls.suffix_of(hosts["h"], two)).collect()] == [("b.co.uk", "co.uk"), ("y.com", "com"), ("com.au", "com.au")]


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    rows = [(i, f"http://{h}.example.net/p", None) for i, h in enumerate(["bad"] * 40 + ["good"] * 400 + ["one"])]
    bad = [(i, int(i < 40 or i == 440)) for i in range(441)]
    got = urls.filter_urls(spark.createDataFrame(rows, PAGES), spark.createDataFrame(bad, "page_id long, bad int"))
    assert {(r["host"].split(".")[0], r["verdict"]) for r in got.select("host", "verdict").distinct().collect()} == {("bad", "block"), ("good", "allow"), ("one", "allow")}


# top-k

VECTORS = "vec_id long, embedding array<float>, label int"


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = {i: rng.normal(size=6).round(2).tolist() for i in range(300)}
    rows = [(i, v, 0) for i, v in vecs.items()] + [(1000, None, 0), (1050, [1.0, None], 0), (1100, [float("nan")] * 6, 0), (1150, [float("inf")] * 6, 0), (1200, [], 0), (1250, [0.5, 0.5], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist() for i, v in [*vecs.items(), (1200, []), (1250, [0.5, 0.5])]}
    for q in (i for i in whole if i % 50 == 0):
        scored = sorted(((-sum(a * b for a, b in zip(whole[q], w, strict=False)), i) for i, w in whole.items() if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in scored]
    assert set(got) == {i for i in whole if i % 50 == 0}
    empty = spark.createDataFrame([], VECTORS)
    assert topk.top_k(empty, empty).count() == 0


def test_grid():
    assert topk.grid(1026, 51_282, 12) == (1, 12) and topk.grid(100_000, 5_000_000, 12)[0] == 7 and topk.grid(0, 0, 12) == (1, 1)


def test_top_k_cells_ties_and_huge_components(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), "extra") for i in range(400)] + [(7, [1.0], "again"), (None, [1.0], "no id")]
    rows += [(5000, [1e300, 1.0], "x"), (5001, [2.0, 1.0], "x"), (5002, [1e-300, -1e308], "x"), (5003, [3e17, 3e17], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    monkeypatch.setattr(topk, "QUERY_CELL", 40)
    for group in (64, 4096):
        monkeypatch.setattr(topk, "GROUP", group)
        got = defaultdict(list)
        for r in topk.top_k(df, df.where("vec_id % 4 = 0 or vec_id >= 5000")).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        whole = [(i, [int(min(max(np.floor(256 * x), -1.7976931348623157e308), 1.7976931348623157e308)) for x in v]) for i, v, _ in rows if i is not None]
        for q, v in whole:
            if q % 4 == 0 or q >= 5000:
                top = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=False)), 1 - 2**63), 2**63 - 1), i) for i, w in whole if i != q)[:5]
                assert got[q] == [(i, -s) for s, i in top]


# near-duplicate embeddings


def brute_near(rows, threshold=0.98):
    ok = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, v, x), (j, w, y) = ok[a], ok[b]
            if x == y and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (links[i], find(i)) for i, _, _ in rows}


@pytest.mark.parametrize("tile", [1024, 16])
def test_near_duplicates_recall_and_exactness(spark, tile):
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for _ in range(40):
        base = rng.normal(size=32)
        for _ in range(rng.integers(1, 8)):
            rows.append((n, (base + rng.normal(size=32) * 0.05).astype(np.float32).tolist(), int(rng.integers(0, 3))))
            n += 1
    rows += [(n + k, rows[0][1], rows[0][2]) for k in range(40)]
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [None] * 32, 1), (903, rows[0][1], None), (904, [1.0], 1), (905, [float("nan")] * 32, 1), (906, [], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddups.near_duplicates(spark.createDataFrame(rows, VECTORS), tile=tile).collect()}
    want = brute_near(rows)
    assert len(got) == len(rows)
    assert all(got[i][0] <= want[i][0] and got[i][2] == (got[i][1] == i) for i in got)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert sum(got[i][1] == want[i][1] for i in got) >= 0.99 * len(got)
    assert embeddups.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    for dim in (64, 13):
        a, b = (embeddups.unit_of(rng.normal(size=(400, dim))) for _ in range(2))
        estimate, bound = embeddups.estimated(embeddups.Coded.of(a), embeddups.Coded.of(b))
        error = estimate - a @ b.T
        assert abs(error.mean()) < 0.02 and (abs(error) <= bound).mean() > 0.999


def test_bands_grow_with_the_vectors():
    assert embeddups.banding(100, 0.98) == embeddups.banding(256 * 1024, 0.98) == (8, 8)
    bands, bits = embeddups.banding(10**10, 0.98)
    assert 10**10 / 2**bits <= 1024 and bands <= 32
    assert embeddups.banding(5, 1.0) == (1, 8)


def test_near_duplicates_tiny_and_huge_components(spark):
    rng = np.random.default_rng(2)
    rows = [(1, [2e-200, 1e-200], 1, "x"), (2, [3e-200, 1e-200], 1, "x"), (3, [2e300, 1e300], 2, "x"), (4, [3e300, 1e300], 2, "x"), (5, [5e-324, 0.0], 3, "x"), (6, [1e-320, 0.0], 3, "x")]
    rows += [(10 + k, v, 4, "y") for k, v in enumerate((rng.normal(size=5000) + 0 * 1j).real.tolist() for _ in range(1))]
    rows += [(20, rows[-1][1], 4, "y"), (20, rows[-1][1], 4, "y"), (20, [1.0, 2.0], 4, "z"), (20, [1.0, 2.01], 4, "z"), (None, [1.0, 2.0], 4, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component_id string")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embeddups.near_duplicates(df).collect())
    assert got[1:7] == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 5)]
    assert got[0] == (0, 0, None) and got[7] == (10, 2, 10) and sorted(n for i, n, _ in got if i == 20) == [1, 1, 2, 2]


# WARC


def test_warc_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}", rng.choice(["", None, "<p>é</p>\r\n\r\nWARC/1.1", "x" * 300_000, f"page {i}"])) for i in range(60)] + [(70, None, "p"), (70, "u", "p"), (71, "a\r\nb", "q")]
    pages = spark.createDataFrame(rows, PAGES.replace("html", "html")).select("page_id", "url", "html")
    import tempfile

    folder = f"file://{tempfile.mkdtemp()}"
    manifest = warc.write(warc.decided(pages), folder)
    got = warc.read(manifest, folder).collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", -1))
    texts = defaultdict(list)
    for i, _, h in rows:
        texts[i].append(h or "")
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    for r in got:
        h = texts[r["page_id"]][0]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h.encode()), warc.digest32(h.encode()))
        assert r["refers_to"] == (None if last[h] == r["page_id"] else last[h])
        assert r["record_type"] == ("response" if r["refers_to"] is None else "revisit")
        assert r["body"] == (h.encode() if r["refers_to"] is None else b"")
    empty = warc.write(warc.decided(spark.createDataFrame([], PAGES)), folder)
    assert warc.read(empty, folder).count() == 0


def test_warc_null_ids_and_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "p", 1), (1, "u", "p", 2), (2, "v", "p", 3), (None, None, None, 4)], "page_id long, url string, html string, refers_to int")
    folder = f"file://{tmp_path}"
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.read(warc.write(warc.decided(pages), folder), folder).collect())
    assert got == [(0, "response", None), (0, "revisit", 2), (1, "revisit", 2), (2, "response", None)]


def test_bundles_are_seekable():
    import zstandard

    b = warc.Bundle()
    for i in range(200):
        b.add(i, warc.record(i, "u", bytes([i]) * 5000, None, ""))
    data = b.done()
    assert len(b.frames) > 1 and warc.read_seek_table(data) == b.frames
    for key, frame, at, offset, _ in b.records[::17]:
        plain = zstandard.ZstdDecompressor().decompress(data[at : at + b.frames[frame][0]])
        assert warc.parse(plain, offset)[1] == bytes([key]) * 5000
