"""Operator 12 against a trie of plain dictionaries."""

import hashlib
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

from corpusloom.llm import prefix_trie as pt

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def expected(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = own.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append((c, len(seq)))
    children, total = {}, {}
    for s in members:
        if s:
            children.setdefault(s[:-1], []).append(s)
    for s in sorted(members, key=len, reverse=True):
        kids = children.get(s, [])
        saved = (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
        total[s] = (sum(total[k][0] for k in kids) + (not kids), sum(total[k][1] for k in kids) + saved)
    out = set()
    for s, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, n in who if n == len(s)))
        parent = min(c for c, _ in members[s[:-1]]) if s else None
        out.add((min(c for c, _ in who), len(s), parent, len(who), len(children.get(s, [])), *total[s], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_query(spark):
    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.001/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()]
    df = pt.op12_prefix_trie(spark, "/root/testdata/sf0.001")
    assert [f"{c} {dict(df.dtypes)[c]}" for c in COLUMNS[:-1]] == [f"{c} bigint" for c in COLUMNS[:-1]] and dict(df.dtypes)["ends_sha256"] == "string"
    assert got(df) == expected(rows)
    db = duckdb.connect()
    db.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = db.execute(pt.SQL["op12_prefix_trie"])
    assert tuple(x[0] for x in want.description) == COLUMNS == tuple(df.columns) and set(want.fetchall()) == expected(rows)


def test_nulls_ties_repeats_and_missing_bases(spark):
    rows = [(0, 1, "u", "b"), (0, None, "u", "a"), (0, 1, "u", "b"), (0, 2, None, None), (3, 5, "u", "x"), (3, 5, "a", "y"), (7, 0, "u", ""), (8, 0, "", "u"), (None, 0, "u", "lost"), (11, 0, "u", "b")]
    rows += [(c, t, "u", f"same {t}") for c in range(20, 60) for t in range(c % 4 + 1)]
    df = frame(spark, rows).selectExpr("*", "'own' as owner", "1 as depth", "2 as pos", "3 as k1")
    assert got(pt.prefix_trie(pt.rebuilt(df))) == expected(rows)


def test_conversations_without_turns_of_their_own_end_at_the_root(spark):
    lone = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(lone, 0, "u", "gone")]
    assert expected(rows) == got(pt.prefix_trie(pt.rebuilt(frame(spark, rows)))) == {(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())}


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_long_conversations_in_blocks(spark, block):
    rows = [(c, t, "u" if t % 2 else "a", f"t{t}" if t < 3 * c else f"t{t} of {c}") for c in (0, 5, 6, 10, 15, 20) for t in range(3 + 4 * c)]
    rows += [(25, t, "u", "again") for t in range(200)] + [(30, t, "u", "again") for t in range(180)]
    assert got(pt.prefix_trie(pt.rebuilt(frame(spark, rows)), block)) == expected(rows)


def test_many_members_of_one_node_and_hot_first_turns(spark, monkeypatch):
    from corpusloom.llm import components

    monkeypatch.setattr(components, "HOT_ROWS", 8)
    monkeypatch.setattr(pt, "CHUNK", 7)
    rows = [(c, t, "s", "common" if t == 0 or c % 3 == 0 else f"{c % 7}") for c in range(0, 600, 5) for t in range(1 + c % 4)]
    assert got(pt.prefix_trie(pt.rebuilt(frame(spark, rows)))) == expected(rows)


def test_empty(spark):
    df = pt.prefix_trie(pt.rebuilt(frame(spark, [])))
    assert set(COLUMNS) <= set(df.columns) and df.count() == 0
