"""Operators without a query over the tables, and golden cases of some that have one."""

import datetime
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from marginalia.operators import anchors, answers, board, checks, compare, ingest, lexicon, sampled, sampling
from marginalia.sources import ledger, terms

PAGE = (
    "= A heading =\n\nFirst line of prose.\nSecond line. -- OneName08\nA question? -- OtherName ?\n\n* [https://example.org/a first]\n"
    "* [https://example.org/b second]\n[[SomePage]]\n\nloose prose\n* a bullet, signed. -- ThirdName\n"
)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_segment(spark):
    german = "Größe ok. -- MünchenX\r\n\r\nzweite -- Zweiter\r\n"
    src = spark.createDataFrame([(1, PAGE), (2, german), (3, "")], "source int, text string")
    units = ingest.with_text(ingest.segment(src), src)
    one = [(r.kind, r.lines, r.signature, r.uncertain) for r in units.filter("source = 1").orderBy("start").collect()]
    assert one == [("heading", 1, None, False), ("post", 2, "OneName08", False), ("post", 1, "OtherName", True), ("list", 3, None, False), ("text", 1, None, False), ("post", 1, "ThirdName", False)]
    two = [(r.kind, r.text) for r in units.filter("source = 2").orderBy("start").collect()]
    assert two == [("text", "Größe ok. -- MünchenX"), ("post", "zweite -- Zweiter")]
    for r in units.collect():
        assert {1: PAGE, 2: german}[r.source].encode()[r.start : r.end].decode() == r.text


def test_follow(spark):
    seen = [("p", 0, "A"), ("p", 0, "A"), ("p", 2, "A"), ("q", 0, "A"), ("q", 1, "A"), ("q", 1, "B"), ("q", 2, "B")]
    pieces = spark.createDataFrame([(p, i, "post", t) for p, i, t in seen], "page string, idx long, kind string, text string")
    revs = spark.createDataFrame([(p, i) for p in "pq" for i in range(3)], "page string, idx long")
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in "AB"}
    out = {(r.page, sha[r.hash]): r for r in ingest.follow(pieces, revs).collect()}
    a, qa, qb = out["p", "A"], out["q", "A"], out["q", "B"]
    assert (a.first_absent, a.returned, a.gone_after, a.copies_at_first, a.revisions_present) == (1, True, None, 2, 2)
    assert (qa.first, qa.last, qa.first_absent, qa.gone_after, qa.returned) == (0, 1, 2, 2, False)
    assert (qb.first_absent, qb.gone_after, qb.returned) == (None, None, False)


def test_repair_bytes(spark):
    def row(raw: bytes, encoding: str, good: bool = True):
        return (raw.decode("latin-1"), hashlib.sha256(raw).hexdigest() if good else "0", encoding)

    df = spark.createDataFrame([row("é".encode(), "utf-8"), row(b"\xe9", "latin-1"), row(b"\xe9", "utf-8"), row(b"x", "utf-8", False)], "body string, body_sha256 string, body_encoding string")
    assert [(r.ok, r.utf8 and bytes(r.utf8)) for r in ingest.repair_bytes(df).collect()] == [(True, "é".encode()), (True, "é".encode()), (True, None), (False, b"x")]


def test_resolve_quotes(spark):
    text = "Please relay here.  Do not assume tools survive. aaa ünï cödé\nline"
    units = spark.createDataFrame([(1, text, 100)], "unit long, text string, start long")
    asked = ["tools survive", "cödé\tline", "relay here. Do not", "not there", "  ", "aa", "it is \\E gone"]
    quotes = spark.createDataFrame([(i, 1, q) for i, q in enumerate(asked)], "quote_id long, unit long, quote string")
    out = {r.quote_id: r for r in anchors.resolve_quotes(quotes, units).collect()}
    raw = b"#" * 100 + text.encode()
    assert [out[i].match for i in range(7)] == ["exact", "ws-normalized", "ws-normalized", None, None, "exact", None]
    assert out[2].exact == "relay here.  Do not" and out[5].occurrences == 2 and out[0].occurrences == 1
    for i in (0, 1, 2, 5):
        assert raw[out[i].start : out[i].end].decode() == out[i].exact
    src = spark.createDataFrame([(1, text)], "source int, text string")
    found = anchors.with_context(spark.createDataFrame([(1, 13, 17)], "source int, start long, end long"), src).first()
    assert (found.prefix, found.suffix) == (text[:13], text[17:49])


def test_terms(spark):
    text = "# about time\nahead cohort\nLIVE\nlive\n\n# a note\n\nhuman\n# given\nones = [0-9]+\nlive\n"
    listed = terms.terms_of(spark, text)
    assert [(r.term, r.heading) for r in listed.orderBy("ord").collect()] == [("ahead cohort", "about time"), ("LIVE", "about time"), ("live", "about time"), ("human", "about time"), ("ones", "given"), ("live (2)", "given")]
    posts = [(1, "The Ahead-cohort is LIVE now, alive. We are live.", "2026-06-01T09:00:00Z", "A", "p", True), (2, "ahead  cohort 12", "2026-06-02T09:00:00Z", "B", "p", False), (3, "nothing here", None, None, "q", False)]
    units = spark.createDataFrame(posts, "unit int, text string, time string, signer string, page string, removed boolean")
    hits = lexicon.term_hits(units, listed)
    out = {r.term: r for r in lexicon.trace_terms(hits, listed).collect()}
    assert (out["ahead cohort"].units, out["ahead cohort"].signers, out["ahead cohort"].first_use) == (2, 2, "2026-06-01T09:00:00Z")
    assert (out["LIVE"].units, out["LIVE"].occurrences, out["live"].units, out["live"].occurrences) == (1, 1, 1, 2)
    assert (out["human"].units, out["human"].peak_day, out["ones"].occurrences) == (0, None, 1)
    assert rows(lexicon.absent_terms(listed, hits), "term") == [("human",)]
    lines = lexicon.concordance(units, r"(?i)\blive\b").orderBy("unit", "use").collect()
    assert [r.said for r in lines] == ["LIVE", "live"] and lines[1].left.endswith("We are") and lines[0].right.startswith("now,")


def test_thinning_rounds_half_to_even(spark):
    df = spark.range(8).withColumn("g", F.lit(1))
    assert [r.id for r in lexicon.thin(df, ["g"], ["id"], 3).orderBy("id").collect()] == [0, round(3.5), 7]
    assert [r.id for r in lexicon.spread_examples(df, ["g"], ["id"], 3).orderBy("id").collect()] == [0, 3, 7]


def test_ledger_reading(spark, tmp_path):
    records = [{"id": "a", "kind": "unit", "v": "1"}, {"id": "b", "kind": "unit", "v": "2"}, {"id": "a", "kind": "unit", "v": "3"}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, records)) + '\n\n{"id": "c", "ki')
    raw = ledger.parsed(ledger.raw_lines(spark, str(tmp_path / "x.jsonl")))
    assert [r.skipped for r in ledger.bad_lines(raw).collect()] == [1]
    assert rows(ledger.read_ledger(spark, str(tmp_path / "x.jsonl")), "id", "v") == [("a", "1"), ("b", "2")]
    (tmp_path / "y.jsonl").write_text('{"id": "c", "ki\n{"id": "d"}\n')
    with pytest.raises(Exception, match="not a record"):
        ledger.read_ledger(spark, str(tmp_path / "y.jsonl")).collect()
    new = spark.createDataFrame([("a", 1), ("z", 2), ("z", 2)], "id string, x int")
    old = spark.createDataFrame([("a",)], "id string")
    assert rows(ledger.append_records(new, old, "unit"), "id") == [("z",)]
    with pytest.raises(Exception, match="in the ledger already"):
        ledger.append_records(new, old, "memo").collect()


def test_files(spark, tmp_path):
    (tmp_path / "ab").mkdir()
    sha = hashlib.sha256(b"hello").hexdigest()
    (tmp_path / "ab" / sha).write_bytes(b"hello")
    blobs = ledger.read_blobs(spark, str(tmp_path / "ab"))
    src = spark.createDataFrame([("s1", sha), ("s2", "0")], "id string, blob string")
    assert rows(checks.check_blobs(src, blobs), "id", "reason") == [("s2", "source bytes missing")]
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as out:
        out.write('{"page_id": 1, "seq": 2}\n{"page_id": 2, "seq": 1}\n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("seq", T.LongType())])
    assert rows(ledger.read_export(spark, str(tmp_path / "r.jsonl.gz"), schema), "page_id", "seq") == [(1, 2), (2, 1)]
    ledger.write_page_data(spark.createDataFrame([(1, "x"), (2, "y")], "tier int, t string"), str(tmp_path / "page"), "tier")
    assert spark.read.json(str(tmp_path / "page")).count() == 2


def test_checks_find_each_damage(spark):
    src = spark.createDataFrame([("s", "aé b".encode())], "source string, content binary")
    units = spark.createDataFrame([("u1", "s", 0, 3), ("u2", "s", 0, 2), ("u3", "s", 2, 9), ("u4", "t", 0, 1)], "id string, source string, start long, end long")
    assert rows(checks.check_units(units, src), "id", "reason") == [("u2", "unit span splits a character"), ("u3", "unit span outside source"), ("u4", "unit points at unusable source")]
    found = spark.createDataFrame([("c1", "anchor", "u1", "s", 0, 3, "aé"), ("c2", "anchor", "u1", "s", 4, 5, "b"), ("c3", "anchor", None, "s", 0, 1, "x")], "id string, what string, unit string, source string, start long, end long, exact string")
    assert rows(checks.check_all_anchors(found, units, src), "id", "reason") == [("c2", "anchor lies outside its unit"), ("c3", "anchor text does not match source bytes")]
    spans = spark.createDataFrame([(1, 1, 0, 5), (1, 1, 5, 8)], "unit int, source int, start long, end long")
    inside = spark.createDataFrame([(1, 1, 1, 2), (1, 1, 4, 6)], "unit int, source int, start long, end long")
    assert rows(checks.passage_spans(inside, spans), "unit", "reason") == [(1, "entry in no passage")]


FOCUSED = "batch string, codings array<struct<unit:string,code:string,quote:string,note:string>>, unfit array<struct<unit:string,quote:string,why:string,suggested_name:string>>, field_note string, signed string"


def test_land_answers(spark):
    units = spark.createDataFrame([(1, "one  two three", 0), (2, "four five", 50), (3, "six", 90)], "unit long, text string, start long")
    shown = spark.createDataFrame([("b", f"u{i}", i) for i in (1, 2, 3)], "batch string, unit string, unit_id long")
    codes = spark.createDataFrame([("k", "code:1")], "code string, code_id string")
    coded = [("u1", "k", "one two", ""), ("u2", "k", "gone", ""), ("u9", "k", "x", ""), ("u2", "zz", "four", "")]
    given = spark.createDataFrame([("b", coded, [("u2", "five", "why", "A Name"), ("u2", "nope", "w", None)], " note ", " ")], FOCUSED)
    out = answers.land_answers(given, shown, codes, units)
    assert rows(out["codings"], "unit_id", "start", "end", "exact", "match") == [(1, 0, 8, "one  two", "ws-normalized")]
    assert rows(out["failures"], "reason") == [(answers.NOT_FOUND,), ("unknown code",), ("unknown unit",)]
    assert rows(out["unfit"], "start", "quote_not_found") == [(55, None), (None, "nope")]
    assert rows(out["notes"], "body", "signed") == [(" note ", None)]
    c = out["counts"].first()
    assert (c.codings, c.ws_normalized, c.failures, c.unfit, c.units_uncoded) == (1, 1, 3, 2, 2)


def test_land_open_codes(spark):
    units = spark.createDataFrame([(1, "the Ahead cohort", 0)], "unit long, text string, start long")
    shown = spark.createDataFrame([("b", "u1", 1)], "batch string, unit string, unit_id long")
    items = [("u1", "Ahead", " ahead  cohort", "in_vivo", "", ""), ("u1", "the", "absent", "in_vivo", "", ""), ("u1", "the", "act", "process", "", ""), ("u7", "the", "x", "process", "", "")]
    given = spark.createDataFrame([("b", items)], "batch string, codings array<struct<unit:string,quote:string,code:string,code_type:string,definition:string,note:string>>")
    out = answers.land_open_codes(given, shown, units)
    assert rows(out["codings"], "name", "in_vivo_in_unit") == [("absent", False), ("act", None), ("ahead cohort", True)]
    assert rows(out["failures"], "reason") == [("unknown unit",)]


def test_land_board_answers(spark):
    given = spark.createDataFrame([("r", [("t001", "x", 'you say "words that were shown" and "words that were never shown"'), ("t9", "x", "hm"), ("board", "x", "to all"), ("t001", "x", "  ")], [("t001", "why")], "", None)], "reader string, replies array<struct<thread:string,to:string,message:string>>, look_again array<struct<thread:string,why:string>>, closing string, signed string")
    out = answers.land_board_answers(given, spark.createDataFrame([("t001",)], "thread string"), spark.createDataFrame([("r", "here are words that were shown.")], "reader string, text string"))
    assert rows(out["messages"], "kind", "thread") == [("reply", "board"), ("reply", "t001"), ("request", "t001")]
    assert rows(out["failures"], "thread") == [("t9",)] and rows(out["lost"], "passage") == [("words that were never shown",)]


def test_land_codebook(spark):
    names = spark.createDataFrame([("n001", ["c2", "c1"]), ("n002", ["c3"])], "id string, code_ids array<string>")
    given = [(1, "key", "Name", ["n001", "n002"]), (2, "", "Name", ["n001"]), (3, "other", "Name", ["n9"]), (4, " KEY", "Name", ["n002"])]
    out = answers.land_codebook(spark.createDataFrame(given, "place int, key string, name string, merged array<string>"), names)
    assert [(r.place, r.merges) for r in out["codes"].collect()] == [(1, ["c1", "c2", "c3"])]
    assert rows(out["refused"], "place", "reason") == [(2, "no key or name"), (3, "no known name"), (4, "repeated key")]
    codes = spark.createDataFrame([("a", "k1"), ("b", "k2"), ("c", "k1")], "id string, key string")
    memo = lambda *ids: spark.createDataFrame([(list(ids),)], "about array<string>")
    assert [r.key for r in answers.codebook_codes(memo("b", "a"), codes).orderBy("place").collect()] == ["k2", "k1"]
    for ids, why in ((("a", "c"), "repeated key"), (("a", "x"), "unknown record")):
        with pytest.raises(Exception, match=why):
            answers.codebook_codes(memo(*ids), codes).collect()


def test_lenses(spark):
    made = spark.createDataFrame([("l1", ("cb",), ("focused-coding", "1", ["analytic"])), ("l2", ("cb",), ("focused-coding", "0", ["analytic"])), ("l3", ("no",), ("focused-coding", "1", ["analytic"]))], "lens string, reader struct<codebook:string>, method struct<name:string,version:string,code_types:array<string>>")
    assert rows(answers.run_lenses(made, "cb"), "lens") == [("l1",)]
    labels = spark.createDataFrame([("l1", "m", "F", None, True), ("l2", "m", None, "big", False)], "lens string, model string, family string, requested string, framed boolean")
    assert rows(answers.reader_name(labels), "label") == [("m (F)",), ("m, answering in place of big, no frame",)]
    tried = spark.createDataFrame([("a1", "f", "l1", "ok"), ("a2", "f", "l1", "failed"), ("a3", "g", "l1", "failed")], "activity string, framework string, lens string, status string")
    memos = spark.createDataFrame([("a1", "f", "l1"), ("a2", "f", "l1"), ("a1", "g", "l1")], "activity string, framework string, by string")
    assert rows(answers.theory_readings(tried, memos), "framework", "attempts", "finished", "published") == [("f", 2, 1, 1), ("g", 1, 0, 0)]


def test_evidence(spark):
    shown = spark.createDataFrame([("r1", "some words"), ("r2", "others")], "id string, text string")
    given = spark.createDataFrame([(1, "r1", "words"), (1, "r2", "words"), (1, "r3", "x")], "reading int, id string, quote string")
    assert rows(anchors.evidence_check(given, shown), "id", "reason") == [("r2", "not in that record"), ("r3", "no such record was shown")]
    refs = spark.createDataFrame([("k", "supports", 0, "cdg:1", None), ("k", "supports", 1, "unit:1", None), ("k", "counters", 0, None, ("s", 0, 2, "he")), ("k", "counters", 1, "memo:1", None)], "claim string, side string, place int, ref string, anchor struct<source:string,start:long,end:long,exact:string>")
    codings = spark.createDataFrame([("cdg:1", "s", 0, 5, "hello")], "id string, source string, start long, end long, exact string")
    units = spark.createDataFrame([("unit:1", "s", 0, 5, "HELLO")], "id string, source string, start long, end long, text string")
    out = sampled.claim_evidence(refs, codings, units, spark.createDataFrame([("s", b"hello")], "source string, content binary"))
    assert rows(out, "side", "place", "kind", "ok") == [("counters", 0, "anchor", True), ("counters", 1, "other", None), ("supports", 0, "coding", True), ("supports", 1, "unit", False)]


def test_sample_side_by_side(spark):
    sample = spark.createDataFrame([(1,), (2,)], "unit int")
    codings = spark.createDataFrame([(1, "b", 5, "c", "x", ""), (1, "a", 9, "c", "y", ""), (3, "a", 0, "c", "z", "")], "unit int, lens string, start int, code string, exact string, note string")
    lost = spark.createDataFrame([(2, "a", "c", "gone")], "unit int, lens string, code string, quote string")
    read = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "unit int, lens string")
    hits = spark.createDataFrame([(1, "live")], "unit int, term string")
    out = {r.unit: r for r in sampled.side_by_side(sample, codings, lost, read, hits).collect()}
    assert [c.lens for c in out[1].codings] == ["a", "b"] and out[1].readers == ["a", "b"] and out[1].terms == ["live"] and out[1].lost == []
    assert out[2].codings == [] and out[2].lost[0].quote == "gone"
    coded = spark.createDataFrame([(1, "a", "exact", "in_vivo", False, " Loaded: x"), (1, "a", "ws-normalized", "process", None, ""), (9, "a", "exact", "process", None, "")], "unit int, by string, match string, code_type string, in_vivo_in_unit boolean, note string")
    acts = spark.createDataFrame([("x", "a", "ok", [1, 9], 10, 5), ("y", "a", "failed", [2], None, None), ("z", "a", "ok", [9], 99, 99)], "id string, lens string, status string, used array<int>, tokens_in long, tokens_out long")
    r = sampled.sample_readers(sample, coded, acts).first()
    assert (r.codings, r.ws_normalized, r.in_vivo, r.in_vivo_absent, r.loaded, r.batches, r.failed, r.tokens_in) == (2, 1, 1, 1, 1, 2, 1, 10)


def test_pick_passages(spark):
    at = lambda h: datetime.datetime(2026, 6, 1) + datetime.timedelta(hours=h)
    said = [(0, "first"), (1, "FIRST "), (2, "b"), (5, "c"), (6, "first"), (9, "d"), (10, "d")]
    hits = spark.createDataFrame([("t", i, at(h), p) for i, (h, p) in enumerate(said)], "term string, unit int, ts timestamp, passage string")
    assert [r.unit for r in sampled.pick_passages(hits, 3).orderBy("unit").collect()] == [0, 3, 6]
    assert [r.unit for r in sampled.pick_passages(hits, 1).collect()] == [0]
    assert sampled.pick_passages(hits, 9).count() == 4


def test_two_readers(spark):
    acts = spark.createDataFrame([("x", "a", "read", "ok", [1, 2, 3]), ("y", "b", "read", "ok", [1, 2, 3]), ("z", "b", "read", "failed", [4])], "id string, lens string, type string, status string, used array<int>")
    coded = [(1, "k1", "a", "x"), (2, "k2", "a", "x"), (3, "k1", "a", "x"), (1, "k1", "b", "y"), (2, "k2", "b", "y"), (3, "k1", "b", "y"), (1, "k3", "b", "y"), (4, "k1", "b", "z"), (1, "k2", "a", "y")]
    codings = compare.finished_records(spark.createDataFrame(coded, "unit int, code string, by string, activity string"), acts)
    read = compare.readings(acts, codings)
    assert rows(compare.unit_divergence(read, codings), "unit", "divergence") == [(1, 1), (2, 0), (3, 0)]
    assert rows(compare.pair_overlap(read, codings), "units", "both", "jaccard") == [(3, 3, 0.75)]


def test_sampling_is_seeded(spark):
    units = spark.createDataFrame([(i, "post", 0, 10, "2026-06-01", f"g{i % 3}", f"t{i // 2}") for i in range(30)], "unit long, unit_kind string, start long, end long, time string, group string, text_key string")
    strata = [{"label": "a", "unit_kind": "post", "n": 9}, {"label": "b", "unit_kind": "post", "n": 9}]
    draw = lambda seed: rows(sampling.stratified_sample(units, strata, seed), "stratum", "unit")
    one = draw(7)
    assert one == draw(7) != draw(8) and len(one) == 15 and len({u // 2 for _, u in one}) == 15
    assert max(sum(u % 3 == g for s, u in one if s == "a") for g in range(3)) <= 4
    assert sampling.stratified_sample(units.withColumn("text_key", F.lit(None).cast("string")), strata, 7).count() == 18


def test_board(spark):
    made = [("n1", 0, "2", [1, 2]), ("n2", 1, "1", [1, 2]), ("n3", 1, "1", [2, 1]), ("n4", 0, "1", [3]), ("n5", 0, "3", [3]), ("n6", 0, "1", [4])]
    notes = spark.createDataFrame([(i, b, at, about, "body", None) for i, b, at, about in made], "id string, notebook int, at string, about array<int>, body string, signed string")
    out = board.threads(notes)
    assert rows(out, "id", "thread", "stands") == [("n1", "t003", True), ("n2", "t003", True), ("n3", "t004", True), ("n4", "t001", True), ("n5", "t001", False), ("n6", "t002", True)]
    answered = spark.createDataFrame([(1, 0, "a", "ok"), (1, 1, "b", "ok"), (1, 1, "c", "failed")], "round int, seat int, activity string, status string")
    seats = spark.createDataFrame([(0,), (1,)], "seat int")
    assert rows(board.round_answers(answered, seats), "seat", "activity") == [(0, "a"), (1, "b")]
    with pytest.raises(Exception, match="not exactly one"):
        board.round_answers(answered.filter("seat = 0"), seats).collect()


def test_shared_folder_is_shared(spark, monkeypatch):
    from types import SimpleNamespace

    from marginalia.sources.folders import shared_folder

    def session(master, **conf):
        conf = {"spark.sql.warehouse.dir": "file:/nowhere/warehouse", **conf}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, *d: conf.get(k, *d)), sparkContext=SimpleNamespace(master=master, applicationId="app-1"), _jvm=spark._jvm, _jsc=spark._jsc)

    assert shared_folder(session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://store/x/"})) == "hdfs://store/x"
    assert shared_folder(session("local[2]")) == shared_folder(session("local[2]"))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))


def test_identity_of_a_body_that_cannot_be_encoded(spark):
    records = spark.createDataFrame([("code:x", "code", '{"a": "\\ud800"}'), ("code:y", "code", "{"), ("m", "memo", '{"a": "\\udfff"}')], "id string, kind string, body string")
    assert rows(checks.check_identity(records), "id", "reason") == [("code:x", "record id does not match its content"), ("code:y", "record id does not match its content")]


def test_many_terms_at_once(spark):
    """Terms found through their first words are those that each pattern finds by itself."""
    import random

    rng = random.Random(8)
    words = ["cat", "CAT", "cats", "Ca", "c", "naïve", "don't", "x9", "set", "is", "foo_bar", "éa", "end"]
    lines = ["cat", "CAT", "cats", "ca", "c", "naïve cat", "don't", "x9 end", "set", "is", "foo_bar", "foo", "éa", "cat cat", "end-is", "both = [Cc]at|end", "edge = (?<![A-Za-z0-9])ca(?![A-Za-z0-9])", "digit = (?<![A-Za-z0-9])x\\d(?![A-Za-z0-9])", "SET IS", "cat"]
    seps = [" ", " ", "-", "_", ". ", "\n", "", " \u00a0"]
    texts = ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(30))) for _ in range(200)] + ["", "\u017fet \u0130s ıs", "ſTHE SET IS", "x\u212a c\u212a"]
    table = terms.terms_of(spark, "\n".join(lines))
    units = spark.createDataFrame(list(enumerate(texts)), "unit int, text string")
    found = {(r.unit, r.term): r.n for r in lexicon.term_hits(units, table).collect()}
    each = units.select("unit", F.explode(F.array(*[F.struct(F.lit(r.term).alias("term"), F.regexp_count("text", F.lit(r.pattern)).alias("n")) for r in table.collect()])).alias("f")).select("unit", "f.*")
    assert found == {(r.unit, r.term): r.n for r in each.filter("n > 0").collect()} and len(found) > 300
    assert lexicon.term_hits(units, table.limit(0)).collect() == []


def test_trie_pattern():
    import re

    words = {"a", "ab", "abc", "b", "bcd", "bce", "xyz"}
    assert {w for w in [*words, "", "abcd", "bc", "xy"] if re.fullmatch(lexicon.trie_pattern(words), w)} == words


def test_appending_a_known_record_is_an_error(spark):
    new = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(ledger.append_records(new, spark.createDataFrame([("c",)], "id string"), "coding"), "id") == [("a",), ("b",)]
    with pytest.raises(Exception, match="id is in the ledger already: b"):
        ledger.append_records(new, spark.createDataFrame([("b",)], "id string"), "coding").collect()


def test_blobs_written_and_read(spark, tmp_path):
    texts = [b"one", b"", b"two", b"one", "é".encode()]
    df = spark.createDataFrame([(t,) for t in texts], "content binary")
    for _ in range(2):
        ledger.write_blobs(df, f"file:{tmp_path}/blobs")
    back = ledger.read_blobs(spark, f"{tmp_path}/blobs").collect()
    assert sorted((r.sha, bytes(r.content)) for r in back) == sorted({(hashlib.sha256(t).hexdigest(), t) for t in texts})


def test_blobs_are_read_without_a_list_on_the_driver(spark, tmp_path):
    """Wherever they lie, and files without bytes too; hidden names and other folders are passed over."""
    held = {"ab/one": b"1", "ab/cd/two": b"22", "three": b"333", "ab/cut": b"", "a b%20/\u00e9": b"4", "_no/x": b"5", ".no": b"6", "ab/_no": b"7"}
    for name, content in held.items():
        (tmp_path / "s p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "s p" / name).write_bytes(content)
    want = [("cut", b""), ("one", b"1"), ("three", b"333"), ("two", b"22"), ("\u00e9", b"4")]
    for path in (f"{tmp_path}/s p", f"file:{tmp_path}/s p/"):
        back = ledger.read_blobs(spark, path)
        assert sorted((r.sha, bytes(r.content)) for r in back.collect()) == want
        assert back.inputFiles() == []
        found = checks.check_blobs(spark.createDataFrame([("s1", "two")], "id string, blob string"), back)
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.sha for r in ledger.read_blobs(spark, f"{tmp_path}/s p/ab/one").collect()] == ["one"]
    with pytest.raises(Exception, match="no such folder"):
        ledger.read_blobs(spark, f"{tmp_path}/no such folder").collect()


def test_no_blobs(spark, tmp_path):
    ledger.write_blobs(spark.createDataFrame([], "content binary"), f"{tmp_path}/blobs")
    assert ledger.read_blobs(spark, f"{tmp_path}/blobs").collect() == []


def test_blobs_in_a_store_that_only_spark_opens(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.blobs.link./in", f"file://{tmp_path}")
    ledger.write_blobs(spark.createDataFrame([(b"one",), (b"",)], "content binary"), f"{tmp_path}/x")
    assert sorted(bytes(r.content) for r in ledger.read_blobs(spark, "viewfs://blobs/in/x").collect()) == [b"", b"one"]


def test_blobs_in_batches(tmp_path, monkeypatch):
    """Whatever the sizes of batches, every file once."""
    import pyarrow as pa

    for i in range(20):
        (tmp_path / f"{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"{i % 3}" / f"f{i}").write_bytes(b"x" * i)
    for listed, read in ((1, 1), (3, 40), (100, 10**6)):
        monkeypatch.setattr(ledger, "LISTED", listed)
        monkeypatch.setattr(ledger, "READ", read)
        rows_ = [pa.RecordBatch.from_arrays([pa.array([str(tmp_path)]), pa.array([True])], names=["at", "folder"])]
        for step in (ledger._listed(str(tmp_path), False), ledger._listed(str(tmp_path), True)):
            rows_ = list(step(rows_))
            assert all(b.num_rows <= listed for b in rows_)
        found = [(r["sha"], len(r["content"])) for b in ledger._contents(str(tmp_path))(rows_) for r in b.to_pylist()]
        assert sorted(found) == sorted((f"f{i}", i) for i in range(20))


def test_first_use_with_its_place(spark):
    table = terms.terms_of(spark, "the pot\nlid = [Ll]id\nnothing")
    units = spark.createDataFrame([(1, 100, "é The  pot, the pot", "2026-06-02"), (2, 0, "A lid on the-pot", "2026-06-03"), (3, 50, "the pot", None)], "unit int, start int, text string, time string")
    found = lexicon.first_use_anchors(lexicon.term_hits(units.select("unit", "text", "time"), table), units, table)
    assert rows(found, "term", "unit", "start", "end", "exact") == [("lid", 2, 2, 5, "lid"), ("the pot", 3, 50, 57, "the pot")]


def test_passages_by_their_rarest_word(spark):
    """Those of the plain search, without comparing a passage with texts that lack its word."""
    import random

    rng = random.Random(9)
    words = ["the", "cat", "sat", "é", "mat", "don't", "a", "naïve", "rare1", "rare2"]
    texts = [(rng.choice("xyz"), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for _ in range(60)] + [("x", None), ("x", "")]
    said = [(m, r, t[a : a + rng.randrange(1, 25)]) for m, (r, t) in enumerate(texts) if t for a in [rng.randrange(len(t))]]
    said += [(m, rng.choice("xyzw"), "".join(rng.choice("thecat sé'") for _ in range(rng.randrange(1, 9)))) for m in range(100, 160)]
    said += [(None, "x", "cat"), (200, "x", None), (201, None, "cat"), (202, "x", "the zebra sat"), (202, "x", "the zebra sat")]
    found = anchors.quotes_in_shown(spark.createDataFrame(said, "message int, reader string, passage string"), spark.createDataFrame(texts, "reader string, text string"))
    want = {(m, r, p) for m, r, p in said if p is None or not any(p in (t or "") and t is not None for q, t in texts if q == r)}
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr) and 5 < len(want) < len(said)


def test_names_without_letters(spark):
    from marginalia.operators import names

    posts = [(1, "asked ★★☆☆★★☆☆ about it", "x"), (2, "日本語の名前です、と言う", "y"), (3, "★★☆☆★★☆", "z"), (4, "--------- and ★★☆☆★★☆☆", "★★☆☆★★☆☆"), (5, "plain words only", "x"), (6, "日本語の名前で", "y")]
    known = ["★★☆☆★★☆☆", "日本語の名前です", "---------", "never seen ★☆", "☆☆☆☆☆☆☆☆☆", "Some Name"]
    found = names.mentions(spark.createDataFrame(posts, "post int, body string, signature string"), spark.createDataFrame([(n,) for n in known], "name string"))
    assert rows(found, "post", "name") == [(1, "★★☆☆★★☆☆"), (2, "日本語の名前です"), (4, "---------")]
