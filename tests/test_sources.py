"""Annotated claims from files to examples, JSON lines out and in, and the gate of a probe."""

import json

from corpusloom.operators import examples, metrics
from corpusloom.sources import readers


def test_annotated_claims_of_files(spark, tmp_path):
    docs = [{"doc_id": 4, "title": " T ", "abstract": ["One.", "Two. "]}, {"doc_id": "7", "title": "U", "abstract": ["Three."]}]
    claims = [
        {"id": 1, "claim": "c", "evidence_doc_id": "4", "evidence_label": "SUPPORT", "evidence_sentences": [1], "cited_doc_ids": [4, 7]},
        {"id": 2, "claim": "d", "evidence_doc_id": "", "evidence_label": "", "evidence_sentences": None, "cited_doc_ids": ["7"]},
        {"id": 3, "claim": "e", "evidence_doc_id": "9", "evidence_label": "CONTRADICT", "evidence_sentences": [0], "cited_doc_ids": None},
    ]
    for name, rows in (("corpus", docs), ("claims", claims)):
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    for end in ("jsonl", "parquet"):
        if end == "parquet":
            for name in ("corpus", "claims"):
                spark.read.json(f"file://{tmp_path}/{name}.jsonl").write.parquet(f"file://{tmp_path}/{name}.parquet")
        got = examples.build_examples(*readers.read_scifact(spark, f"file://{tmp_path}/corpus.{end}", f"file://{tmp_path}/claims.{end}")).collect()
        assert sorted((r.example_id, r.label, r.sentences, r.context.split("\n")[0]) for r in got) == [
            ("1:4:0", "support", ["Two. "], "Title: T"), ("1:7:nei", "not_enough_info", [], "Title: U"), ("2:7:nei", "not_enough_info", [], "Title: U"),
        ]


def test_json_lines_go_out_with_their_number(spark, tmp_path):
    df = spark.createDataFrame([(1, "ü", None), (2, None, 3.5)], "a int, b string, c double")
    assert readers.write_jsonl(df, f"file://{tmp_path}/out") == 2 and readers.write_jsonl(df.limit(0), f"file://{tmp_path}/none") == 0
    rows = sorted((json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()), key=lambda r: r["a"])
    assert rows == [{"a": 1, "b": "ü", "c": None}, {"a": 2, "b": None, "c": 3.5}]


def test_gate_of_a_probe(spark):
    cases = spark.createDataFrame([(k,) for k in range(3)], "example_id int")
    out = [(0, "completed", 2), (1, "completed", 1), (2, "failed", 4)]
    gate = lambda rows, *a: metrics.probe_gate(spark.createDataFrame(rows, "example_id int, status string, calls int"), cases, *a).first()
    r = gate(out, 2, 7)
    assert (r.n, r.valid, r.incomplete, r.calls, r.passes) == (3, 2, 1, 7, True)
    assert not gate(out, 2, 6).within_calls and not gate(out[:2], 2, 9).all_present and not gate([*out, (9, "failed", 0)], 2, 9).all_present and not gate([*out, out[0]], 3, 20).all_present and not gate(out, 3, 9).passes
