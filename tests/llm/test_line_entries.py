"""How operator 9's entries are dealt: a row for each part of the keys, each entry once, and members as by brute force."""

import random

import numpy as np
import pyarrow as pa

from corpusloom.llm import line_dedup


def lines_of(rng, n):
    words = [f"w{i}" for i in range(40)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 14))) for _ in range(n)]
    return out + [x[:-1] + "é" for x in out[: n // 3]] + out[:5]


def test_entries_travel_packed_and_members_are_those_of_shared_keys(monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", 600)
    rng = random.Random(3)
    lines = lines_of(rng, 200)
    batches = [pa.RecordBatch.from_arrays([pa.array(["\n".join(lines[i : i + 9])])], ["t"]) for i in range(0, len(lines), 9)]
    want = {}
    for x in set(lines):
        short = int(line_dedup._short([line_dedup._node(x)])[0])
        for key, kind in line_dedup.line_keys(x):
            mine = want.setdefault(key, {})
            mine[short] = mine.get(short, 0) | kind
    n = sum(len(line_dedup.line_keys(x)) for x in set(lines))
    want = {(k, s, kind) for k, mine in want.items() if len(mine) > 1 and np.bitwise_or.reduce(list(mine.values())) == 3 for s, kind in mine.items()}
    assert want
    for held in (1 << 20, 500):
        monkeypatch.setattr(line_dedup, "HELD", held)
        rows = [r for b in line_dedup._entries(5, 7, iter(batches)) for r in b.to_pylist()]
        assert len(rows) <= 7 * (1 + n // held) and sum(len(r["keys"]) for r in rows) == sum(len(r["marks"]) for r in rows) == 8 * n
        got = []
        for p in range(7):
            mine = [r for r in rows if r["part"] == p]
            got += map(tuple, (r.values() for r in line_dedup._members(pa.Table.from_pylist(mine)).to_pylist()))
        assert len(got) == len(set(got)) and set(got) == want


def test_entries_are_shuffled_once_in_parts(spark):
    """Two shuffles of all entries, or a row for each of them, were most of the operator's work."""
    df = spark.createDataFrame([(i, "\n".join(lines_of(random.Random(i), 60))) for i in range(4)], "doc_id long, text string")
    dealt = []
    plain = line_dedup.materialize
    line_dedup.materialize = lambda t, name="t": (dealt.append(t._jdf.queryExecution().optimizedPlan().toString()) if name == "members" else None, plain(t, name))[1]
    try:
        line_dedup.line_classes(df).count()
    finally:
        line_dedup.materialize = plain
    assert dealt[0].count("MapInArrow") == 1 and "Join" not in dealt[0] and "FlatMapGroupsInArrow [part" in dealt[0]


def test_normal_form_squeezes_any_blank():
    rng = random.Random(1)
    letters = "aB İΣ\t\r\x0b\x1c\x85\xa0  \xad​ é"
    for _ in range(5000):
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 7)))
        assert line_dedup.normal(x) == " ".join(x.split()).lower()
