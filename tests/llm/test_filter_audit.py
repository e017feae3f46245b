"""The filter audit against a version by hand, document by document and order by order, and against its SQL."""

import re
from itertools import permutations

import duckdb
import pytest

from marginalia.llm import filter_audit as audit
from marginalia.llm import queries

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def by_hand(docs, labels):
    """Each document is sent through each order by itself."""
    low = lambda d: -(2**63) if d is None else d
    first = {}
    for d, t, _ in docs:
        first[t or ""] = min(low(d), first.get(t or "", 2**63))
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    seen = {}
    for d, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": first[t] < low(d),
        }
        row = (frozenset(f for f in fails if fails[f]), d is not None and d in good, d is not None and d in toxic)
        seen.setdefault(part or "", []).append(row)
    out = {}
    for part, rows in seen.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive, gone = list(rows), []
            for step, f in enumerate(order, 1):
                here = [r for r in alive if f in r[0]]
                late = sum(f in r[0] for r in gone)
                alive = [r for r in alive if f not in r[0]]
                gone += here
                removed_by[f] += len(here)
                out[part, "".join(order), step] = [len(alive), len(here), late, sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(removed_by[f])
    return out


def texts():
    plain = " ".join(f"word{i}" for i in range(200))
    return [None, "", " \n\t", plain, plain + " more", "Cap " + plain, "ABC DEF " + plain, plain + " 5%", "same " * 300, "same same " * 99 + "x", plain.replace("word", "Word"), "é " * 250, "\U0001f600 # " + plain, "A" * 3, "x\x0by\x1cz " * 100]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("audit")
    docs = [(i, t, f"src{i % 3}") for i, t in enumerate(texts())]
    docs += [(100 + i, t, None if i % 2 else "") for i, t in enumerate(texts())]  # copies under larger ids
    docs += [(None, texts()[3], "src1"), (None, "of no id", None), (3, texts()[3], "src0"), (3, texts()[3], "src9"), (3, "another text of that id", "src0")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(130)] + [(7, None, 1), (8, 0, None), (9, 1, 0), (9, 0, 0), (None, 1, 1), (4, 1, 1)]
    spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, failed string, n int").repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), docs, labels


def test_query_by_hand_and_sql(spark, tables):
    at, docs, labels = tables
    df = queries.QUERIES["op13_filter_audit"](spark, at)
    assert df.columns == ["part", "filter_order", "step", *COUNTS]
    found = sorted(map(tuple, df.collect()))
    want = by_hand(docs, labels)
    assert len(want) == 5 * 600 and found == sorted((*k, *v) for k, v in want.items())
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    rel = con.sql(queries.SQL["op13_filter_audit"])
    assert rel.columns == df.columns and sorted(rel.fetchall()) == found


def test_cells(spark):
    """Two documents that fail A and C, one that fails all, one that fails none; every total by reasoning."""
    cells = spark.createDataFrame([("p", 0b00101, 2, 1, 0), ("p", 0b11111, 1, 1, 1), ("p", 0, 1, 0, 0)], "part string, failed int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): r for r in audit.audit_cells(cells).collect()}
    assert len(rows) == 600
    r = rows["ABCDE", 1]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == (1, 3, 0, 0, 2, 1)
    r = rows["BCADE", 3]
    assert (r.kept, r.removed, r.redundant, r.good_lost) == (1, 0, 3, 0)
    by = {"A": 2 * 60 + 24, "B": 24, "C": 2 * 60 + 24, "D": 24, "E": 24}
    assert all(r.shapley == by[order[step - 1]] for (order, step), r in rows.items())
    assert all(rows[o, 5].kept == 1 for o, _ in rows)


def test_empty_and_long(spark):
    docs = spark.createDataFrame([(1, "w " * 1_000_000, "s"), (2, "w " * 1_000_000, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_filters(docs.limit(0), labels).collect() == []
    rows = {(r.filter_order, r.step): r for r in audit.audit_filters(docs, labels).collect()}
    assert rows["EBACD", 1].removed == 1 and rows["EBACD", 2].removed == 1 and rows["BEACD", 2].redundant == 1
