"""Following a ledger gives what reading it at once gives."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators import compare
from marginalia.sources.ledger import ENVELOPE, read_ledger
from marginalia.streaming import ledger as S

ACTIVITY = T.StructType([*ENVELOPE.fields, T.StructField("lens", T.StringType()), T.StructField("type", T.StringType()), T.StructField("status", T.StringType())])


def write(path, records, tail=""):
    path.write_text("".join(json.dumps(r) + "\n" for r in records) + tail)


def test_tail_equals_batch(spark, tmp_path):
    land, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    land.mkdir()
    record = lambda i: {"id": f"r{i}", "kind": "memo", "at": "2026-06-01T00:00:00Z", "by": "l"}
    write(land / "a.jsonl", [record(1), record(2), record(1)])
    S.run_available(S.tail_ledger(spark, str(land)), out, mark)
    write(land / "b.jsonl", [record(2), record(3)], '{"id": "r4", "ki')
    S.run_available(S.tail_ledger(spark, str(land)), out, mark)
    seen = sorted(r.id for r in spark.read.parquet(out).collect())
    assert seen == sorted(r.id for r in read_ledger(spark, str(land)).collect()) == ["r1", "r2", "r3"]


def test_finished_records_wait_for_their_activity(spark, tmp_path):
    recs, acts = tmp_path / "recs", tmp_path / "acts"
    recs.mkdir()
    acts.mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    at = "2026-06-01T00:00:00Z"
    coding = lambda i, a, by="l": {"id": i, "kind": "coding", "at": at, "activity": a, "by": by}
    act = lambda i, status: {"id": i, "kind": "activity", "at": at, "lens": "l", "type": "read", "status": status}
    write(recs / "a.jsonl", [coding("c1", "x"), coding("c2", "y"), coding("c3", "x", "other")])
    write(acts / "a.jsonl", [act("w", "ok")])

    def run():
        records = S.tail_ledger(spark, str(recs)).withColumn("at_time", F.to_timestamp("at"))
        activities = S.tail_ledger(spark, str(acts), ACTIVITY).withColumn("at_time", F.to_timestamp("at"))
        S.run_available(S.finished_stream(records, activities).select("id"), out, mark)
        return sorted(r.id for r in spark.read.schema("id string").parquet(out).collect())

    assert run() == []
    write(acts / "b.jsonl", [act("x", "ok"), act("y", "failed")])
    assert run() == ["c1"]
    batch = compare.finished_records(read_ledger(spark, str(recs)), read_ledger(spark, str(acts), ACTIVITY))
    assert [r.id for r in batch.collect()] == ["c1"]


def test_a_line_finished_later(spark, tmp_path):
    """Half a line is left alone; once it is finished, and with what follows, it is read whole. New files are read too."""
    land, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    land.mkdir()
    line = lambda i: json.dumps({"id": f"r{i}", "kind": "memo é"}) + "\n"
    seen = lambda: sorted(r.id for r in spark.read.schema("id string").parquet(out).collect())
    whole = line(2)
    (land / "a.jsonl").write_text(line(1) + whole[:9])
    S.run_available(S.tail_ledger(spark, str(land)), out, mark)
    assert seen() == ["r1"]
    with (land / "a.jsonl").open("a") as f:
        f.write(whole[9:] + line(3) + "not json\n" + line(1))
    (land / "b.jsonl").write_text(line(4) + line(5)[:-1])
    S.run_available(S.tail_ledger(spark, str(land)), out, mark)
    assert seen() == ["r1", "r2", "r3", "r4"]
    with (land / "b.jsonl").open("a") as f:
        f.write("\n")
    S.run_available(S.tail_ledger(spark, str(land)), out, mark)
    assert seen() == ["r1", "r2", "r3", "r4", "r5"]


def test_pieces_of_a_file(tmp_path, monkeypatch):
    """Whatever the sizes of pieces and chunks, every whole line is read once, at its place."""
    import random

    from marginalia.streaming import tail

    rng = random.Random(3)
    lines = ["x" * rng.randrange(0, 30) + "é" for _ in range(300)]
    (tmp_path / "f").write_text("\n".join(lines) + "\nhalf")
    (tmp_path / "_left_out").write_text("a\n")
    raw = (tmp_path / "f").read_bytes()
    for piece, chunk in ((7, 5), (64, 16), (1000, 3), (10**6, 10**6)):
        monkeypatch.setattr(tail, "PIECE", piece)
        monkeypatch.setattr(tail, "CHUNK", chunk)
        reader = tail.TailReader(f"file:{tmp_path}")
        end = reader.latestOffset()
        assert list(end.values()) == [len(raw) - 4]
        found = [(s, v) for p in reader.partitions({}, end) for b in reader.read(p) for s, v in zip(b["start"].to_pylist(), b["value"].to_pylist(), strict=True)]
        assert [v for _, v in found] == lines and all(raw[s : s + len(v.encode())].decode() == v for s, v in found)
        middle = raw.index(b"\n", 500) + 1
        later = [v for p in reader.partitions({next(iter(end)): middle}, end) for b in reader.read(p) for v in b["value"].to_pylist()]
        assert later == raw[middle:-4].decode().splitlines() and reader.partitions(end, end) == []


def test_activities_days_late(spark, tmp_path):
    """Whichever comes first, however far apart in time; a record passes once, and one of another lens never."""
    recs, acts, out, mark = tmp_path / "recs", tmp_path / "acts", str(tmp_path / "out"), str(tmp_path / "mark")
    coding = lambda i, a, at, by="l": {"id": i, "activity": a, "by": by, "at": at}
    act = lambda i, at, status="ok", kind="read": {"id": i, "lens": "l", "type": kind, "status": status, "at": at}

    def run(name, new, done, forget=None):
        for at, rows in ((recs, new), (acts, done)):
            at.mkdir(exist_ok=True)
            write(at / name, rows)
        schema = lambda cols: T.StructType([T.StructField(c, T.StringType()) for c in cols])
        time = F.to_timestamp("at").alias("at_time")
        records = S.tail_ledger(spark, str(recs), schema(["id", "activity", "by", "at"])).select("id", "activity", "by", time)
        activities = S.tail_ledger(spark, str(acts), schema(["id", "lens", "type", "status", "at"])).select("id", "lens", "type", "status", time)
        S.run_available(S.finished_stream(records, activities, forget), out, mark)
        return sorted((r.id, r.at_time.isoformat(), r.done, r.done_at.isoformat()) for r in spark.read.parquet(out).collect()) if list((tmp_path / "out").glob("*.parquet")) else []

    early, late = "2026-06-01T00:00:00.123456Z", "2026-07-30T00:00:00Z"
    assert run("1", [coding("c1", "x", early), coding("c2", "y", early), coding("c3", "x", early, "m"), coding("c6", "z", early), coding("c7", "v", early)], [act("w", late)]) == []
    one = ("c1", "2026-06-01T00:00:00.123456", "x", "2026-07-30T00:00:00")
    assert run("2", [], [act("x", late), act("z", late, "failed"), act("v", late, "ok", "merge")]) == [one]
    two = ("c4", "2026-01-01T00:00:00", "x", "2026-07-30T00:00:00")
    assert run("3", [coding("c4", "x", "2026-01-01T00:00:00Z"), coding("c5", "x", early, "m")], [act("x", late)]) == [one, two]
    assert [r[0] for r in run("4", [], [act("y", early)])] == ["c1", "c2", "c4"]


def test_finished_activities_are_forgotten(spark, tmp_path):
    schema = "id string, activity string, by string, at_time timestamp"
    done = "id string, lens string, type string, status string, at_time timestamp"
    recs, acts, out, mark = (str(tmp_path / x) for x in ("recs", "acts", "out", "mark"))

    def run(new, ended):
        spark.createDataFrame(new, schema.replace("timestamp", "string")).withColumn("at_time", F.to_timestamp("at_time")).write.mode("append").parquet(recs)
        spark.createDataFrame(ended, done.replace("timestamp", "string")).withColumn("at_time", F.to_timestamp("at_time")).write.mode("append").parquet(acts)
        stream = S.finished_stream(spark.readStream.schema(schema).parquet(recs), spark.readStream.schema(done).parquet(acts), "1 day")
        S.run_available(stream, out, mark)
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert run([("a", "x", "l", "2026-06-01 00:00:00")], [("x", "l", "read", "ok", "2026-06-01 01:00:00")]) == ["a"]
    assert run([("b", "x", "l", "2026-06-01 02:00:00"), ("c", "y", "l", "2026-06-09 00:00:00")], [("z", "l", "read", "ok", "2026-06-09 00:00:00")]) == ["a", "b"]
    assert run([("d", "q", "l", "2026-06-09 00:00:00")], [("q", "l", "read", "ok", "2026-06-09 00:00:00")]) == ["a", "b", "d"]
    assert run([("e", "x", "l", "2026-06-09 00:00:00")], [("y", "l", "read", "ok", "2026-06-09 00:00:00")]) == ["a", "b", "c", "d"]


def gated(spark, at, new, ended, forget=None):
    """One run of the gate over records and activities of the folder ``at``, after ``new`` and ``ended`` are added to them."""
    sides = []
    for name, rows, schema in (("recs", new, "id string, activity string, by string, at_time string"), ("acts", ended, "id string, lens string, type string, status string, at_time string")):
        df = spark.createDataFrame(rows, schema).withColumn("at_time", F.to_timestamp("at_time")).coalesce(1)
        df.write.mode("append").parquet(f"{at}/{name}")
        sides.append(spark.readStream.schema(df.schema).parquet(f"{at}/{name}"))
    S.run_available(S.finished_stream(*sides, forget), f"{at}/out", f"{at}/mark")
    return sorted(r.id for r in spark.read.parquet(f"{at}/out").collect())


def test_groups_do_not_grow_with_activities(spark, tmp_path, monkeypatch):
    """A call for a group takes milliseconds: activities share groups, and each still passes by itself."""
    monkeypatch.setattr(S, "BUCKETS", 8, raising=False)
    at = "2026-06-01 00:00:00"
    first = gated(spark, tmp_path, [(f"r{i}", f"a{i}", f"l{i % 3}", at) for i in range(300)], [(f"a{i}", "l1", "read", "ok", at) for i in range(0, 300, 2)])
    assert first == sorted(f"r{i}" for i in range(0, 300, 2) if i % 3 == 1)
    assert spark.read.format("statestore").load(f"{tmp_path}/mark").count() <= 8
    second = gated(spark, tmp_path, [(f"s{i}", f"a{i}", "l1", at) for i in range(300)] + [("n", None, "l1", at)], [("a1", "l1", "read", "ok", at), ("a2", "l0", "read", "ok", at)])
    assert second == sorted([*first, "r1", "s1", *(f"s{i}" for i in range(0, 300, 2))])


def test_activities_of_a_group_are_forgotten_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 1, raising=False)
    day = lambda n: f"2026-06-{n:02} 00:00:00"
    ends = lambda i, n: (i, "l", "read", "ok", day(n))
    assert gated(spark, tmp_path, [("a", "x", "l", day(1)), ("w", "open", "l", day(1))], [ends("x", 1), ends("y", 5)], "1 day") == ["a"]
    assert gated(spark, tmp_path, [("b", "y", "l", day(5)), ("c", "x", "l", day(5))], [ends("z", 6)], "1 day") == ["a", "b"]
    assert gated(spark, tmp_path, [("d", "z", "l", day(7)), ("e", "y", "l", day(7))], [ends("open", 7)], "1 day") == ["a", "b", "d", "e", "w"]
    assert gated(spark, tmp_path, [("f", "y", "l", day(9)), ("g", "open", "l", day(9))], [ends("q", 9)], "1 day") == ["a", "b", "d", "e", "g", "w"]


def test_daily_terms(spark, tmp_path):
    land, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    land.mkdir()
    schema = "term string, unit long, at_time timestamp"
    hits = [("live", 1, "2026-06-01T01:00:00Z"), ("live", 2, "2026-06-01T02:00:00Z"), ("live", 3, "2026-06-02T02:00:00Z"), ("live", 4, "2026-06-09T00:00:00Z")]
    write(land / "a.json", [dict(zip(("term", "unit", "at_time"), h, strict=True)) for h in hits])
    for _ in range(2):  # the second run closes what the watermark has passed
        S.run_available(S.daily_terms_stream(spark.readStream.schema(schema).json(str(land))), out, mark)
    closed = sorted((r.day, r.units) for r in spark.read.parquet(out).collect())
    assert closed == [("2026-06-01", 2), ("2026-06-02", 1)]
