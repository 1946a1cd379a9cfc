"""Arrow streams, append-only logs, budgets of sessions in batch and stream, and table contexts."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import context
from corpusloom.sources import streams
from corpusloom.streaming import budgets

UTC = dt.timezone.utc


def test_arrow_streams(spark, tmp_path):
    for n, names in enumerate([("id", "text"), ("text", "id", "more")]):
        columns = {"id": pa.array([n * 10 + k for k in range(5)], pa.int32()), "text": pa.array([f"t{n}{k}" if k else None for k in range(5)]), "more": pa.array(range(5))}
        t = pa.table({c: columns[c] for c in names})
        with pa.OSFile(str(tmp_path / f"{n}.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
            w.write_table(t, max_chunksize=2)
    with pa.OSFile(str(tmp_path / "2.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("id", pa.int64())])) as w:
        w.write_table(pa.table({"id": pa.array([99])}))
    df = streams.read_arrow_streams(spark, f"file://{tmp_path}", "id long, text string")
    assert sorted((r.id, r.text) for r in df.collect()) == sorted([(n * 10 + k, f"t{n}{k}" if k else None) for n in (0, 1) for k in range(5)] + [(99, None)], key=lambda x: x[0])


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_append_log(spark, tmp_path, piece):
    path = tmp_path / "log.jsonl"
    lines = [f'{{"n": {k}, "t": "ü{"x" * (k % 9)}"}}' for k in range(40)]
    path.write_bytes(("\n".join(lines[:20]) + "\n\n" + lines[20][:5]).encode())
    read = lambda offset: spark.read.format("append_log").option("offset", offset).option("piece", piece).load(str(path)).orderBy("offset").collect()
    streams.append_log(spark, str(path))
    got = read(0)
    assert [r.line for r in got] == lines[:20] and all(path.read_bytes()[r.offset :].startswith(r.line.encode()) for r in got)
    assert [r.line for r in read(got[7].offset)] == lines[7:20]
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        s = spark.readStream.format("append_log").option("piece", piece).load(str(path))
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        return [r.line for r in spark.read.parquet(out).orderBy("offset").collect()]

    assert run() == lines[:20]
    with path.open("ab") as f:
        f.write(("\n".join([lines[20][5:], *lines[21:]]) + "\n").encode())
    assert run() == lines and run() == lines
    empty = tmp_path / "empty"
    empty.write_bytes(b"partial")
    assert streams.append_log(spark, str(empty)).count() == 0


def expected(rows, limits):
    out = {}
    for s in {r[0] for r in rows}:
        steps, spent, searches, seen, reason, at = 0, 0.0, 0, set(), None, None
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1]))
        end = own[0][2] + dt.timedelta(seconds=limits.seconds)
        for _, _, ts, cost, search, request in own:
            cost, search = cost or 0.0, bool(search)
            if ts >= end:
                reason, at = budgets.REASONS[0], end
            elif steps >= limits.steps:
                reason = budgets.REASONS[1]
            elif limits.cost is not None and spent + cost > limits.cost:
                reason = budgets.REASONS[2]
            elif search and searches >= limits.searches:
                reason = budgets.REASONS[3]
            elif search and request in seen:
                reason = budgets.REASONS[4]
            if reason:
                at = at or ts
                break
            steps, spent, searches = steps + 1, spent + cost, searches + search
            if search:
                seen.add(request)
        out[s] = (steps, round(spent, 6), searches, reason, at and at.replace(tzinfo=None))
    return out


def events(n=500):
    rng = random.Random(6)
    begin = dt.datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(f"s{rng.randint(0, 24)}", k, begin + dt.timedelta(seconds=rng.randint(0, 5000)), rng.choice([None, 1.0, 2.5, 0.0]), rng.choice([True, False, None]), f"q{rng.randint(0, 9)}") for k in range(n)]
    return [*rows, ("lone", n, begin, 1.0, False, "q"), ("dear", n + 1, begin, 99.0, False, "q")]


SCHEMA = "session string, event_id long, ts timestamp, cost double, search boolean, request string"


@pytest.mark.parametrize("bucket", [60, 3600, 10**7])
@pytest.mark.parametrize("limits", [budgets.Limits(2000, 9, 12.0, 4), budgets.Limits(10**6, 10**6, None, 10**6), budgets.Limits(400, 3, None, 2)])
def test_session_stops(spark, limits, bucket):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.session: (r.steps, r.spent, r.searches, r.reason, r["at"]) for r in budgets.session_stops(df, limits, bucket).collect()}
    assert got == expected(rows, limits)


def test_stream_stops_as_the_table_does(spark, tmp_path):
    limits = budgets.Limits(2000, 9, 12.0, 4)
    rows = sorted(events(), key=lambda r: r[2])
    for k in range(4):
        part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # An event far ahead moves the watermark past all deadlines.
    spark.createDataFrame([("late", 10**6, rows[-1][2] + dt.timedelta(days=1), 0.0, False, "q")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = budgets.stop_stream(src, limits, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.session: (r.steps, r.spent, r.searches, r.reason, r["at"]) for r in spark.read.schema(budgets.STOP).parquet(str(tmp_path / "out")).collect() if r.session != "late"}
    table = {r.session: (r.steps, r.spent, r.searches, r.reason, r["at"]) for r in budgets.session_stops(spark.createDataFrame(rows, SCHEMA), limits, until=F.lit("2024-01-02").cast("timestamp")).collect()}
    assert got == table and all(x[3] for x in table.values()) and len({x[3] for x in table.values()}) >= 4


def test_context_of_a_referenced_table(spark):
    box = "case_id int, page int, chunk string, x0 double, y0 double, x1 double, y1 double, text string"
    chunks = [
        (1, 5, "cap", 0.0, 300.0, 100.0, 310.0, "Table 2: rows"), (1, 5, "near", 10.0, 280.0, 90.0, 290.0, "a"), (1, 5, "first", 10.0, 200.0, 90.0, 210.0, "b"), (1, 5, "far", 10.0, 90.0, 90.0, 100.0, "c"),
        (1, 5, "beside", 200.0, 280.0, 290.0, 290.0, "d"), (1, 6, "other page", 10.0, 280.0, 90.0, 290.0, "e"), (1, 5, "no box", None, 1.0, 2.0, 3.0, "f"),
        (2, 1, "cap", 0.0, 100.0, 100.0, 110.0, "Table 2. x"), (2, 1, "above", 0.0, 80.0, 100.0, 90.0, "y"), (2, 1, "head", 0.0, 120.0, 100.0, 130.0, "Statistic Train Test"), (2, 1, "row", 0.0, 140.0, 100.0, 150.0, "Rows 1 2"),
        (3, 1, "cap", 0.0, 100.0, 100.0, 110.0, "Table 2. x"), (3, 1, "again", 0.0, 200.0, 100.0, 210.0, "Table 2: x"), (4, 1, "cap", 0.0, 100.0, 100.0, 110.0, "Table 2. x"), (5, 1, "cap", 0.0, 100.0, 100.0, 110.0, "Table 2. x"),
    ]
    questions = [(1, "What does Table 2 say (table 2)?"), (2, "table 2"), (3, "table 2"), (4, "table 2 or table 3"), (5, "Table 2")]
    hits = [(1, 5), (2, 1), (3, 1), (4, 1), (5, 9)]
    got = {}
    for r in context.referenced_table_context(spark.createDataFrame(questions, "case_id int, question string"), spark.createDataFrame(hits, "case_id int, page int"), spark.createDataFrame(chunks, box)).orderBy("rank").collect():
        got.setdefault(r.case_id, []).append(r.chunk)
    assert got == {1: ["cap", "first", "near"], 2: ["cap", "head", "row"]}
    cells = [(1, f"c{k}", k, table, col, row, "") for k, (table, col, row) in enumerate([("2", "dev", "-base"), ("2", "dev", "base"), ("2", "test", "base"), ("3", "dev", "base"), ("2", "dev", "large"), ("2", "", "base")])]
    df = spark.createDataFrame(cells, "case_id int, cell string, at int, table_number string, column string, row_label string, row_group string")
    ask = spark.createDataFrame([(1, "In Table 2, what is base on dev?")], "case_id int, question string")
    assert [(r.rank, r.cell) for r in context.relevant_cells(ask, df).orderBy("rank").collect()] == [(1, "c1")]
    ask = spark.createDataFrame([(1, "In Table 2, what are -base and base on dev?")], "case_id int, question string")
    assert [r.cell for r in context.relevant_cells(ask, df).orderBy("rank").collect()] == ["c0", "c1"]
