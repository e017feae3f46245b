"""A page counted again: a sound page passes every check, and each fault shows in the check that is meant for it."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import recount as R

TEXT = "The kettle boiled over, and nobody — not one — saw it. Later they all did."


def cut(a, b):
    return TEXT.encode()[a:b].decode()


@pytest.fixture(scope="module")
def ledger(spark):
    lenses = [("l0", "cb", "focused-coding", "1", ["analytic"]), ("l1", "cb", "focused-coding", "1", ["analytic"]), ("l2", "cb", "focused-coding", "1", ["analytic"]), ("old", "other", "focused-coding", "1", ["analytic"]), ("test", "cb", "focused-coding", "2", ["analytic"]), ("vivo", "cb", "focused-coding", "1", ["analytic", "in_vivo"])]
    # reader a reads by l0 and l1, reader b by l2; the page saw two activities of a and one of b
    acts = [("a1", "l0", "read", "ok", 1), ("a2", "l0", "read", "failed", 2), ("a3", "l1", "read", "ok", 3), ("a4", "l0", "merge", "ok", 4), ("b1", "l2", "read", "ok", 5), ("a5", "l0", "read", "ok", 6), ("b2", "l2", "read", "ok", 7), ("t1", "test", "read", "ok", 0)]
    records = [
        ("c1", "l0", "a1", "u1", 0, 10, "w1"), ("c2", "l1", "a3", "u1", 4, 17, "w2"), ("c3", "l2", "b1", "u1", 9, 22, "w3"), ("c4", "l2", "b1", "u1", 24, 42, "w4"), ("c5", "l0", "a1", "u2", None, None, "w5"),
        ("late", "l0", "a5", "u1", 0, 5, "x"), ("later", "l2", "b2", "u1", 0, 5, "x"), ("failed", "l0", "a2", "u1", 0, 5, "x"), ("other", "l0", "a3", "u1", 0, 5, "x"), ("old", "test", "t1", "u1", 0, 5, "x"),
    ]
    return R.Ledger(
        spark.createDataFrame(lenses, "lens string, codebook string, method string, version string, code_types array<string>"),
        spark.createDataFrame(acts, "id string, lens string, type string, status string, seq int"),
        spark.createDataFrame(records, "id string, by string, activity string, unit string, start int, end int, words string"),
        spark.createDataFrame([("s", TEXT.encode())], "source string, content binary"),
    )


SOUND = {
    "readers": [("a", ["l0", "l1"], 2, 3), ("b", ["l2"], 1, 2)],
    "passages": [("p1", 0, "u1", "s", 0, 22, cut(0, 22), 2, "1"), ("p2", 1, "u1", "s", 24, 42, cut(24, 42), 1, "1"), ("p3", 2, "u2", "s", None, None, None, 1, "2")],
    "entries": [("p1", "c1", "a", "A", 0, 10, cut(0, 10), "w1"), ("p1", "c2", "a", "A", 4, 17, cut(4, 17), "w2"), ("p1", "c3", "b", "B", 9, 22, cut(9, 22), "w3"), ("p2", "c4", "b", "B", 24, 42, cut(24, 42), "w4"), ("p3", "c5", "a", "A", None, None, None, "w5")],
    "tiers": [(2, 1), (1, 2)],
    "totals": [(5, 3)],
}
KINDS = {
    "readers": "reader string, lenses array<string>, activities int, entries int",
    "passages": "passage string, place int, unit string, source string, start int, end int, text string, tier int, first_seen string",
    "entries": "passage string, id string, reader string, family string, start int, end int, exact string, words string",
    "tiers": "tier int, passages int",
    "totals": "entries int, passages int",
}


def failing(spark, ledger, **changed):
    page = R.Page(*[spark.createDataFrame((SOUND | changed)[name], KINDS[name]) for name in R.Page._fields])
    rows = R.audit_page(page, ledger, "cb").collect()
    assert len(rows) == 14
    return {(r.check, r.about): r.detail for r in rows if not r.ok}


def altered(*faults):
    """SOUND with the value at a place of a row of a table replaced."""
    rows = {name: [list(r) for r in SOUND[name]] for name, *_ in faults}
    for name, at, place, value in faults:
        rows[name][at][place] = value
    return {name: [tuple(r) for r in table] for name, table in rows.items()}


def test_sound_page(spark, ledger):
    assert failing(spark, ledger) == {}


RECORDS, GROUPS, BYTES, QUOTES, ORDER, FAMILIES = "entries say what records say", "grouped by overlap", "passages are bytes of the source", "quotations are bytes of the source", "order of passages", "tiers are numbers of families"


@pytest.mark.parametrize(
    ("faults", "want"),
    [
        ([("readers", 0, 1, ["l0"])], {"lenses of the run", RECORDS}),
        ([("readers", 1, 2, 3)], {"finished activities", "entries of a reader", "entries of all readers", RECORDS}),
        ([("readers", 1, 3, 4), ("entries", 3, 6, "Kettle"), ("passages", 2, 8, "0"), ("tiers", 0, 1, 2), ("totals", 0, 0, 6)], {"entries of a reader", QUOTES, ORDER, "passages by tier", "entries of all readers"}),
        ([("entries", 4, 1, "c9"), ("passages", 1, 6, "nobody"), ("totals", 0, 1, 2), ("entries", 2, 3, "A")], {RECORDS, BYTES, "passages listed", FAMILIES}),
        ([("passages", 1, 3, "no such source"), ("passages", 2, 1, 5), ("entries", 0, 7, "another")], {BYTES, QUOTES, ORDER, RECORDS}),
        ([("passages", 1, 4, 21)], {GROUPS, BYTES}),
        ([("entries", 4, 0, "p2")], {GROUPS, RECORDS, FAMILIES}),
    ],
)
def test_faults(spark, ledger, faults, want):
    assert {check for check, _ in failing(spark, ledger, **altered(*faults))} == want


def test_touching_spans_do_not_chain(spark):
    passages = spark.createDataFrame([("p", "u", "s", 0, 9), ("q", "u", "s", 9, 12), ("r", "u", "s", 2, 3)], "passage string, unit string, source string, start int, end int")
    entries = spark.createDataFrame([("p", "1", 0, 5), ("p", "2", 5, 9), ("q", "3", 9, 12), ("q", "4", 9, 11), ("r", "5", 2, 3)], "passage string, id string, start int, end int")
    found = sorted((r.passage, r.reason) for r in R.broken_groups(passages, entries).collect())
    assert found == [("p", "entries do not chain"), ("r", "shares bytes")]


def test_bytes_beyond_the_end(spark):
    spans = spark.createDataFrame([("s", 1, 3), ("s", 2, 9), ("s", 5, 9), ("s", 3, 2), ("t", 0, 1)], "source string, start int, end int")
    kept = spark.createDataFrame([("s", b"\xc3\xa9ab")], "source string, content binary")
    held = {(r.source, r.start, r.end): r.held and bytes(r.held) for r in R.source_bytes(spans, kept).collect()}
    assert held == {("s", 1, 3): b"\xa9a", ("s", 2, 9): b"ab", ("s", 5, 9): b"", ("s", 3, 2): None, ("t", 0, 1): None}
    assert R.source_bytes(spans, kept).filter(F.col("held").isNull()).count() == 2
