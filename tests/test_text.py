import pytest
from pyspark.sql import functions as F

from tonefield.functions import text as T
from tonefield.operators import entities as E
from tonefield.operators import evaluate as EV
from tonefield.operators import marking, references
from tonefield.sources.readers import group_articles, parse_gid


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw, want", [("Paul Ryan ( )", "Paul Ryan"), ("the first Indian American (", "the first Indian American"), ("James O'Keefe's — —", "James O'Keefe's"), ("the chairman ”", "the chairman"), ("'Reid Rule'", "'Reid Rule'"), ("(a) b", "(a) b"), ("", ""), ("— (", "")])
def test_clean_edges(spark, raw, want):
    assert one(spark, raw, T.clean_edges) == want == T.cleaned(raw)


@pytest.mark.parametrize("raw, want", [("“President Trump", "President Trump"), ('Powell,"', "Powell,"), ("  a   b ", "a b")])
def test_normalise_candidate(spark, raw, want):
    assert one(spark, raw, T.normalise_candidate) == want


def test_unicode_strip_and_words(spark):
    assert one(spark, "  a b  ", T.strip) == "a b"
    assert one(spark, "", T.words) == []
    assert one(spark, None, T.words) is None


def test_references(spark):
    assert one(spark, "his stake in the company", references.embedded_pronouns) == ["his"]
    assert [r["canonical"] for r in one(spark, "The country's bid, (the firm)", references.embedded_generics)] == ["the country", "the firm"]
    assert one(spark, "", references.embedded_generics) == []
    assert one(spark, "the country's", references.generic_head) == "country"


def test_locate_and_mark(spark):
    s = "He named most Americans, including wealthy ones (50%)."
    row = spark.createDataFrame([(s, "most Americans including wealthy ones")], "s string, t string").select(marking.locate_target(F.col("s"), F.col("t")).alias("l"), marking.mark_target(F.col("s"), F.lit("wealthy")).alias("m"), marking.locate_target(F.col("s"), F.lit("ones (50%)")).alias("p"), marking.locate_target(F.col("s"), F.lit("absent")).alias("n")).first()
    assert row["l"] == "most Americans, including wealthy ones"
    assert row["m"] == "He named most Americans, including [TARGET] wealthy [/TARGET] ones (50%)."
    assert row["p"] == "ones (50%)"
    assert row["n"] is None


def test_outlets_and_days(spark):
    assert one(spark, "https://feeds.npr.org/1001/rss.xml", E.outlet_name) == "NPR"
    assert one(spark, "https://www.thehindu.com/feed", E.outlet_name) == "THEHINDU"
    assert one(spark, "2024-01", T.day) is None


def test_alias_mapping(spark):
    keys = ["donald trump", "trump", "white house", "house", "j d vance", "d vance", "x y"]
    got = {r["key"]: r["merged"] for r in E.alias_mapping(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert got == {"donald trump": "trump", "trump": "trump", "white house": "white house", "house": "house", "j d vance": "d vance", "d vance": "d vance", "x y": "x y"}


def test_canonical_entity(spark):
    df = spark.createDataFrame([(["Trump "], "President Trump"), ([], "the possibility of X"), (None, "Fed"), ([], "A b c d")], "e array<string>, t string")
    assert [r[0] for r in df.select(E.canonical_entity(F.col("e"), F.col("t"))).collect()] == ["Trump", None, "Fed", None]


def test_gid(spark):
    got = one(spark, "allsides_1044_417_3_New_York_5_13", parse_gid)
    assert (got["article_id"], got["sentence_index"], got["mention"], got["start"], got["stop"]) == ("allsides_1044_417", 3, "New_York", 5, 13)
    assert one(spark, "a_b_c_x_y_1_2", parse_gid) is None
    assert one(spark, "a_b", parse_gid) is None


def test_articles_keep_the_first_sentence(spark):
    rows = [("s_1_2_0_m_0_1", "first", 1, ["a"]), ("s_1_2_0_m_0_1", "second", 2, ["b", "c"]), ("bad", "x", 3, ["d"]), ("s_1_2_1_m_0_1", None, 4, ["e"])]
    got = group_articles(spark.createDataFrame(rows, "gid string, sentence string, row_id long, targets array<string>")).collect()
    assert [(r["sentence"], r["targets"]) for r in got] == [("first", ["a", "b", "c"])]


@pytest.mark.parametrize("gold, predicted, gs, ps, want", [("Trump", "Trump", "NER", "NER", "CORRECT"), ("Trump", "Donald Trump", "NER", "NER", "LARGER_SPAN"), ("Donald Trump", "Trump", "NER", "NER", "SMALLER_SPAN"), ("Trump", "Trump's", "NER", "NER", "POSSESSIVE_VARIATION"), ("A", "B", "SUBSPAN_TOKEN", "NER", "NER_VS_SUBSPAN"), ("A", "B", "NER", "SUBSPAN_TOKEN", "SUBSPAN_VS_NER"), ("A", "B", None, "COORDINATION", "COORDINATION_ERROR"), ("A", "B", None, None, "OTHER")])
def test_error_types(spark, gold, predicted, gs, ps, want):
    df = spark.createDataFrame([(gold, predicted, gs, ps)], "g string, p string, a string, b string")
    assert df.select(EV.error_type(F.col("g"), F.col("p"), F.col("a"), F.col("b"))).first()[0] == want


def test_hand_labels(spark):
    assert one(spark, " NEG ", EV.hand_label) == "Negative"
    assert one(spark, "  ", EV.hand_label) is None
    with pytest.raises(Exception, match="invalid label"):
        one(spark, "meh", EV.hand_label)
