"""Strings of files: nested literals are found and screened, files that don't parse are named, nothing is run."""

import json

from corpusloom.sources import literals

LEAK = "the model improved the accuracy of every tested baseline by two points"


def test_strings_of_files_and_their_leaks(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.py").write_text(f'"""Doc."""\nCASES = {{"k": [("x", f"y {{1}}", ["{LEAK.upper()}"])]}}\nraise SystemExit("never run 2401.01234v2")\n')
    (tmp_path / "deep" / "b.json").write_text(json.dumps({"rows": [{"a": {"b": ["z", LEAK + " again"]}, "n": 1}], "same": [LEAK, LEAK]}))
    (tmp_path / "deep" / "c.jsonl").write_text('{"t": "one"}\n\n{"t": ["two"]}\n')
    (tmp_path / "bad.py").write_text("def (:\n")
    (tmp_path / "other.txt").write_text(LEAK)
    df = literals.read_strings(spark, f"file://{tmp_path}").cache()
    found = {}
    for r in df.orderBy("path", "at").collect():
        found.setdefault(r.path.rsplit("/", 1)[1], []).append(r.value or r.issue)
    assert found["a.py"] == ["Doc.", "k", "x", "y ", LEAK.upper(), "never run 2401.01234v2"] and found["bad.py"] == ["unparsed"] and found["c.jsonl"] == ["one", "two"]
    assert found["b.json"] == ["z", LEAK + " again", LEAK, LEAK] and set(found) == {"a.py", "b.json", "c.jsonl", "bad.py"}
    targets = spark.createDataFrame([(1, LEAK, "2401.01234"), (2, "quite other words in a row that nobody else has", "2402.00001")], "target_id int, text string, paper_id string")
    flags = literals.screen_strings(df, targets).collect()
    assert sorted((r.target_id, r.path.rsplit("/", 1)[1], r.jaccard == 1.0) for r in flags) == [(1, "a.py", True), (1, "b.json", False), (1, "b.json", True)]
    blocked = literals.blocked_targets(df, targets, r"\d{4}\.\d{5}(?:v\d+)?").collect()
    assert [(r.target_id, r.paper_id, r.path.rsplit("/", 1)[1]) for r in blocked] == [(1, "2401.01234", "a.py")]
