"""Ranking against sorting by hand, in groups of any size, and its plan."""

import random

from pyspark.sql import functions as F

from marginalia.operators import board
from marginalia.operators.ranks import ranked


def by_hand(rows):
    groups = {}
    for g, t, i in rows:
        groups.setdefault(g, []).append((t is not None, t, i))
    return sorted(((g, t, i, n, len(v)) for g, v in groups.items() for n, (_, t, i) in enumerate(sorted(v))), key=repr)


def test_ranked(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, "x", "y", "z"]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t string, i long").repartition(7)
    found = ranked(df, ["g"], ["t", "i"])
    assert sorted((tuple(r) for r in found.select("g", "t", "i", "_rn", "_n").collect()), key=repr) == by_hand(rows)
    whole = ranked(df, [], [F.col("i").desc()])
    assert sorted((r.i, r._rn, r._n) for r in whole.collect()) == [(i, 2999 - i, 3000) for i in range(3000)]
    assert ranked(df.limit(0), ["g"], ["i"]).collect() == [] and ranked(df.limit(0), [], ["i"]).collect() == []


def test_input_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    rows = spark.range(500).select(F.udf(count, "long")("id").alias("i"))
    out = ranked(rows, [], ["i"])
    assert out.count() == 500 and seen.value == 500
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert all("_part" in line for line in windows)


def test_many_times(spark):
    """Threads first made at as many times as there are notes."""
    n = 20_000
    notes = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("b").alias("notebook"), F.format_string("2026-06-01T%06d", F.lit(n) - F.col("id")).alias("at"), F.array(F.col("id").cast("string")).alias("about"), F.lit("x").alias("body"), F.lit("s").alias("signed"))
    found = board.threads(notes).agg(F.min("thread"), F.max(F.struct(F.length("thread"), "thread")), F.countDistinct("thread")).first()
    assert found[0] == "t001" and found[1][1] == f"t{n}" and found[2] == n
    assert board.threads(notes).filter(f"id = '{n - 1}'").first().thread == "t001"


def test_running_max(spark):
    from marginalia.operators.ranks import running_max

    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, *range(40)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(5)
    found = {(r.g, r.i): r.m for r in running_max(df, ["g"], ["i"], F.col("v"), "m").collect()}
    best = {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        assert found[g, i] == best.get(g)
        if v is not None:
            best[g] = max(v, best.get(g, v))
    assert len(found) == len(rows)
    spread = running_max(spark.range(50_000).selectExpr("1 as g", "id as i", "id % 977 as v").repartition(8), ["g"], ["i"], F.col("v"), "m")
    assert spread.filter("i > 976 and m <> 976 or i > 0 and i < 977 and m <> i - 1 or i = 0 and m is not null").count() == 0


def test_one_unit_with_all_spans(spark):
    """A unit that all have marked: passages as one window over it would make them, ties and touching spans included."""
    from marginalia.operators.passages import merge_passages, passages

    rng = random.Random(6)
    spans = [(i, rng.randrange(0, 40_000), rng.randrange(1, 12)) for i in range(5000)]
    rows = [(i, "u", "s", a, a + n, i % 3) for i, a, n in spans] + [(9000, "u", "s", None, None, 1), (9001, "u", None, 3, 5, 1)]
    found = passages(merge_passages(spark.createDataFrame(rows, "id long, unit string, source string, start long, end long, family int").repartition(6)))
    want, reach = [], None
    for i, _, _, a, b, _ in sorted((r for r in rows[:5000]), key=lambda r: (r[3], r[4], r[0])):
        if reach is None or a >= reach:
            want.append([a, b, 0])
        want[-1][1], want[-1][2] = max(want[-1][1], b), want[-1][2] + 1
        reach = b if reach is None else max(reach, b)
    assert sorted((r.start, r.end, r.entries) for r in found.filter("source = 's' and start is not null").collect()) == sorted(map(tuple, want))
    assert found.filter("start is null or source is null").count() == 2


def test_busy_page(spark):
    from marginalia.operators.ingest import deleted_after

    rng = random.Random(7)
    units = [(i, rng.choice("aaab"), rng.randrange(1000)) for i in range(3000)]
    gone = [(rng.choice("aaac"), rng.randrange(1000)) for _ in range(40)]
    found = deleted_after(spark.createDataFrame(units, "unit long, page string, time int"), spark.createDataFrame(gone, "page string, time int"))
    assert {r.unit: r.page_deleted_after for r in found.collect()} == {u: min((t for p, t in gone if p == page and t >= at), default=None) for u, page, at in units}
