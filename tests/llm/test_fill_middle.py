"""Fill-in-the-middle against its wording by hand, its SQL, and odd tables."""

import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import fill_middle as fm
from marginalia.llm import queries


def by_hand(doc_id, text, rate=100, spm=50):
    """n, form, prefix, middle, output of the contract, with regular expressions and plain strings."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", None, "\n", "\n\n\n", "one", "one\n", "é\n日本語\nend", "has <P> inside\nline", "a<\nP>b\n<", "<S", "\r\n\r\n", "x" * 70_000 + "\n" + "y", "a b\x0bc\n\x00d\n"]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_odd_texts(spark):
    rows = [(i * 7 + k, t) for i, t in enumerate(ODD) for k in range(5)] + [(None, "null id\nb\n"), (5, "twice\nb"), (5, "twice\nb"), (5, "other\ntext\n")]
    out = fm.fill_in_middle(table(spark, rows).repartition(3), as_digest=True)
    found = sorted((tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256").collect()), key=repr)
    want = [(d, *by_hand(d, t)) for d, t in rows]
    assert found == sorted(((*w, hashlib.sha256(w[-1].encode()).hexdigest()) for w in want), key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = fm.restore(out).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in back), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)


def test_rates_and_columns(spark):
    rows = [(i, f"a{i}\nb\nc\nd", "x", 1, "kept") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N string, form int, `other col` string")
    for rate, spm in ((0, 50), (40, 0), (100, 100)):
        out = fm.fill_in_middle(docs, rate=rate, spm=spm)
        assert out.columns == ["doc_id", "other col", "n", "form", "prefix_chars", "middle_chars", "output"]
        assert sorted(tuple(r)[2:] for r in out.collect()) == sorted(by_hand(r[0], r[1], rate, spm) for r in rows) or rate < 100
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=repr) == sorted(((r[0], *by_hand(r[0], r[1], rate, spm)) for r in rows), key=repr)
    assert fm.fill_in_middle(docs.limit(0)).collect() == [] and fm.restore(fm.fill_in_middle(docs.limit(0))).collect() == []


def test_long_text_of_many_lines(spark):
    text = "".join(f"line {i} é\n" for i in range(300_000)) + "end"
    rows = [(d, text) for d in (1, 2, 3)]
    out = fm.fill_in_middle(table(spark, rows))
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()) == [(d, *by_hand(d, t)) for d, t in rows]
    assert [r.text == text for r in fm.restore(out).collect()] == [True] * 3


@given(st.lists(st.text("ab\né<", max_size=9), max_size=5), st.data())
@settings(max_examples=200, deadline=None)
def test_splitting_descriptors(parts, data):
    """Any cuts, one after the other, leave the text as it is."""
    texts = [p.encode() for p in parts]
    buffer = memoryview(b"".join(texts))
    at, pieces = 0, []
    for t in texts:
        pieces.append(fm.Piece(0, at, len(t)))
        at += len(t)
    for _ in range(4):
        cut = data.draw(st.integers(0, len(buffer)))
        left, right = fm.split(pieces, cut)
        assert b"".join(fm.runs(left, (buffer,))) == bytes(buffer[:cut])
        pieces = left + right
        assert fm.digest(pieces, (buffer,)) == hashlib.sha256(buffer).hexdigest()
    with pytest.raises(ValueError, match="beyond"):
        fm.split(pieces, len(buffer) + 1)


@given(st.text("ab<>PSM", max_size=6), st.text("ab<>PSM", max_size=6), st.text("ab<>PSM", max_size=6), st.sampled_from(sorted(fm.FORMS)))
@settings(max_examples=500, deadline=None)
def test_restored_from_output_alone(p, m, s, form):
    """Parts that end or start like a sentinel are no trouble, as long as the text holds none."""
    if any(x in p + m + s for x in fm.SENTINELS):
        return
    out = (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}").encode()
    pieces = fm.parts_of(memoryview(out), 0, len(out), form, fm.Marks(fm.SENTINELS))
    assert b"".join(fm.runs(pieces, (memoryview(out),))).decode() == p + m + s


def test_wrong_sentinels_and_forms(spark):
    for wrong in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "a<P>", "<M>"), ("ab", "bc", "x")):
        with pytest.raises(ValueError):
            fm.Marks(wrong)
    marks = fm.Marks(fm.SENTINELS)
    for output, form in ((b"<P>a<S>b", "psm"), (b"x<P>a<S>b<M>", "psm"), (b"<P>a<S>b<M>", "spm"), (b"a", "odd")):
        with pytest.raises(ValueError):
            fm.parts_of(memoryview(output), 0, len(output), form, marks)
    out = fm.fill_in_middle(table(spark, [(1, "a\nb\n[s]")]), sentinels=("[p]", "[s]", "[m]"))
    assert out.first().form == "plain"


def test_query_against_sql_and_by_hand(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, f"x{i}\n" * (i % 7) + "z" * (i % 3)) for i in range(200)] + [(None, "a\nb\nc\n")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.QUERIES["op11_fill_in_middle"](spark, str(tmp_path))
    found = sorted((tuple(r) for r in df.collect()), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == sorted(((d, n, form, p, m, sha(out), sha(t or "")) for d, t in rows for n, form, p, m, out in [by_hand(d, t)]), key=repr)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(queries.SQL["op11_fill_in_middle"]).fetchall(), key=repr) == found
