from test_io_and_stream import FACT, lines

from tonefield import api, cli


def test_service_answers(spark):
    ask = lambda *x: api.respond(spark, *x)
    assert ask("GET", "/health") == (200, {"status": "ok"}) and ask("GET", "/")[0] == 200 and ask("GET", "/predict")[0] == 404
    assert ask("POST", "/predict", {"sentence": "", "target": "x", "target_from": -1}) == (422, {"detail": ["sentence is empty", "target_from is negative"]})
    assert ask("POST", "/predict/batch", {"requests": []})[0] == 422
    assert ask("POST", "/predict", {"sentence": "a met b", "target": "c"}) == (400, {"detail": "target not found in sentence"})
    status, out = ask("POST", "/predict/batch", {"requests": [{"sentence": "a met b", "target": "a"}, {"sentence": "good gains", "target": "gains", "target_from": 5, "target_to": 10}]})
    assert status == 200 and [r["sentiment"] for r in out["results"]] == ["Neutral", "Positive"]


def test_registered_functions(spark):
    api.register(spark)
    rows = spark.sql("SELECT target, role, confidence FROM extract_targets('Microsoft acquired Activision Blizzard.')").collect()
    assert [tuple(r) for r in rows] == [("Activision Blizzard", "object", "high"), ("Microsoft", "subject", "medium")]
    assert [r[0] for r in spark.sql("SELECT clean_edges(x) FROM VALUES ('Paul Ryan ( )'), (NULL), ('a') AS t(x)").collect()] == ["Paul Ryan", None, "a"]


def test_command_lines(spark, tmp_path, capsys):
    (tmp_path / "s.txt").write_text("Microsoft acquired Activision Blizzard.\n\n")
    cli.main(["predict", str(tmp_path / "s.txt"), str(tmp_path / "facts")])
    assert {r["target_text"] for r in spark.read.json(str(tmp_path / "facts")).collect()} == {"Microsoft", "Activision Blizzard"}
    rows = [{"primary_gid": "src_1_2_0_Microsoft_0_9", "sentence_normalized": "Microsoft acquired Activision Blizzard.", "targets": [{"mention": "Microsoft", "from": 0, "to": 9, "polarity": 4.0}]}]
    cli.main(["dataset", lines(tmp_path / "a.jsonl", rows), str(tmp_path / "dataset")])
    got = {r["target_text"]: (r["label_source"], r["sentiment_label"]) for r in spark.read.json(str(tmp_path / "dataset")).collect()}
    assert got == {"Microsoft": ("gold_exact", 4.0), "Activision Blizzard": ("needs_annotation", None)}
    facts = lines(tmp_path / "f.jsonl", [FACT, FACT, FACT])
    cli.main(["leaderboard", facts, "--top", "5"])
    assert "avg_confidence" in capsys.readouterr().out
    (tmp_path / "g.csv").write_text("sentence,target,target_from,target_to,polarity\nMicrosoft acquired Activision Blizzard.,Microsoft,0,9,4.0\n")
    cli.main(["evaluate", str(tmp_path / "g.csv")])
    assert "1.0" in capsys.readouterr().out
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "x.json", [FACT])
    cli.main(["ingest", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")])
    assert spark.read.parquet(str(tmp_path / "out" / "facts")).count() == 1
