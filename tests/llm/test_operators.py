"""Each operator against a brute-force version on a small table with nulls, blanks, copies, ties and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from marginalia.llm import bpe, decontamination, line_dedup, near_dedup, nearest, quality, secrets, substring_dedup, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    """About 80 documents: words from a small vocabulary, near and exact copies, shared lines and long passages."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["Über", "naïve", "The", "tHE", "don't"]
    some = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, line = some(70), "This Line is shared by many documents."
    texts = [some(rng.randint(1, 180)) for _ in range(40)]
    texts += [t + " tail" for t in texts[5:12]]
    texts += [" ".join([*t.split()[:-1], "x"]) for t in texts[12:18]]
    texts += texts[:5]
    texts += [f"{some(30)} {passage} {some(20)}" for _ in range(5)] + [passage]
    texts += [f"{some(8)}\n  {line.upper()}\t\n{some(5)}" for _ in range(4)] + [f"{line}\n{line}"]
    texts += ["", " \n\t ", "one", "a b c", "A  B\nC", "é" * 3000, some(6000), "x\x1cy\x85z", 'token = "abcdef0123456789abcdef0123456789"', "AKIA" + "Z" * 16]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows.append((len(rows), None, None, None, None))
    return rows


ROWS = corpus()
TEXTS = [r[:2] for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def crowded(df, *cols):
    """The table with null ids, repeated rows and columns that clash with what operators add or use."""
    from pyspark.sql import functions as F

    more = df.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    out = df.unionByName(more).unionByName(df.filter("doc_id in (1, 60)"))
    taken = {c.lower() for c in cols}
    names = [c for c in ("id", "row", "start", "kept", "n_words", "ids", "Score", "kmer", "node") if c.lower() not in taken]
    return out.withColumns({c: F.lit(7) for c in (*names, *cols)})


def lines_by_hand(rows, least=20, docs=3):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", s))
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < docs or max(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


def test_line_dedup(spark, docs, none):
    from pyspark.sql import functions as F

    found = line_dedup.dedup_lines(docs)
    assert got(found, "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256)) == lines_by_hand(TEXTS)
    assert found.filter("n_dropped > 0").count() >= 4
    assert line_dedup.dedup_lines(none).count() == 0
    out = line_dedup.dedup_lines(crowded(docs, "N_LINES", "n_dropped"))
    assert out.count() == len(ROWS) + 3 + 2 and out.columns.count("n_lines") == 1


def test_decontamination(spark, docs, none):
    items = [(1, ROWS[3][1]), (2, "one"), (3, None), (4, ""), (5, ROWS[3][1]), (6, "nowhere at all"), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontamination.brute_force(TEXTS, items[:-1]))
    for block in (decontamination.BLOCK, 40):
        found = decontamination.mark_contamination(docs, bench, block_bytes=block)
        assert [(r[0], r[1], r[2], r[3], r[5]) for r in want] == got(found, "doc_id", "n_words", "n_hit", "n_items", "contaminated")
    spans = {r.doc_id: (r.text, r.hit_spans) for r in found.filter("contaminated").collect()}
    text, (span,) = spans[3][0], spans[3][1]
    assert decontamination.normal_words(text[span.start : span.end]) == decontamination.normal_words(ROWS[3][1])
    assert decontamination.mark_contamination(none, bench).count() == 0
    assert decontamination.mark_contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.mark_contamination(crowded(docs, "items", "N_HIT"), bench).count() == len(ROWS) + 5


def test_near_dedup(spark, docs, none):
    found = near_dedup.near_duplicates(docs)
    want = sorted(near_dedup.brute_force(TEXTS))
    assert got(found, "doc_id", "n_shingles", "component_id", "kept") == want
    assert sum(not r[3] for r in want) >= 10
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.near_duplicates(crowded(docs, "component_id", "N_SHINGLES")).count() == len(ROWS) + 5


def test_near_dedup_chains_and_crowds(spark):
    """Links through others count; a crowd of variants of one text, some of them too far from it, ends as by hand."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        words = list(base)
        for k in range(rng.choice([0, 1, 1, 2, 3, 4])):
            words[rng.randrange(120)] = f"v{i}_{k}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        rows.append((200 + i, " ".join([f"d{j}" for j in range(i * 3)] + chain[i * 3 :])))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(near_dedup.brute_force(rows))


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    regs = near_dedup.registers([a, b, a[:1], a[:7]])
    assert abs(near_dedup.estimate(regs[:1], regs[1:2])[0] - 1500 / 2500) < 0.12
    assert len(set(regs[2].tolist())) == 1


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1200, 16)).round(3)
    v[300:420] = v[300]
    rows = [(i, [float(x) for x in v[i]]) for i in range(1200)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, []), (None, [1.0] * 16), (5100, [1.0] * 3)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    found = nearest.nearest_neighbours(df, df.filter("vec_id % 100 = 0"), shard=300)
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(out) == set(range(0, 1200, 100))
    hits = 0
    for q, near in out.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(1200), d)) if i != q][:10]
        hits += len(set(order) & {x[1] for x in near})
        assert [x[0] for x in near] == list(range(1, 11)) and all(abs(d[i] - s) < 1e-9 for _, i, s in near)
    assert hits >= 0.9 * 120
    assert [x[1] for x in out[300]] == list(range(301, 311))
    assert nearest.nearest_neighbours(df.limit(0), df).count() == 0
    few = df.filter("vec_id in (0, 1, 2)")
    assert nearest.nearest_neighbours(few, few.filter("vec_id = 0")).count() == 2


def test_substring_dedup(spark, docs, none):
    from pyspark.sql import functions as F

    want = sorted(substring_dedup.brute_force(TEXTS))
    assert got(substring_dedup.cut_repeats(docs, digest=True), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert got(substring_dedup.cut_repeats(docs), "doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "utf-8"), 256)) == want
    assert sum(r[2] > 0 for r in want) >= 10
    assert substring_dedup.cut_repeats(none).count() == 0
    out = substring_dedup.cut_repeats(crowded(docs, "removed", "N_removed"))
    assert out.count() == len(ROWS) + 5


def test_first_minimum():
    rng = np.random.default_rng(0)
    for size in (1, 2, 5, 35, 43):
        x = rng.integers(0, 9, 300).astype(np.uint64)
        assert substring_dedup.first_minimum(x, size).tolist() == [i + int(np.argmin(x[i : i + size])) for i in range(300 - size + 1)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def test_bpe(spark, docs, none, tokenizer):
    want = []
    for d, t in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    coded = bpe.encode(docs)
    for df in (bpe.digests(coded), bpe.encode(docs, digest=True)):
        assert got(df, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)
    text = {r.doc_id: r.decoded for r in bpe.decode(coded).collect()}
    assert all(sha(text[d]) == s for d, _, _, s in want)
    assert bpe.encode(none).count() == 0
    assert bpe.encode(crowded(docs, "IDS", "n_tokens")).count() == len(ROWS) + 5


def test_word_encoder_agrees_with_the_library(tokenizer):
    import pyarrow as pa

    rng = random.Random(4)
    signs = [*"abXY019 !.,'<>|@#$%\"\n", "é", "É", "ß", "İ", "×", "Σ", "ς", "ſ", "Ÿ", "中", "🙂", "́", "<|endoftext|>", "'s", "\x1c", "\x85"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(3000)]
    ids, starts = bpe.WordEncoder(bpe.default_tokenizer()).encode(pa.array(texts))
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(ids[a:b].tolist() == w.ids for a, b, w in zip(starts[:-1], starts[1:], want, strict=True))


def test_chunks_follow_content():
    rng = np.random.default_rng(3)
    body = rng.integers(97, 123, 50_000, dtype=np.uint8)
    a, b = bpe.chunk_ends(body), bpe.chunk_ends(np.concatenate((body[:10], rng.integers(97, 123, 777, dtype=np.uint8), body[10:])))
    assert len(a) > 20 and len(set(a.tolist()) & set((b - 777).tolist())) > len(a) - 3


def test_token_files(spark, docs, none, tokenizer, tmp_path):
    token_files.write_token_files(docs, f"file://{tmp_path}/a")
    at, want = 0, []
    for d, t in sorted(TEXTS):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, token_files.END_ID]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got(token_files.read_token_files(spark, f"file://{tmp_path}/a", digest=True), "doc_id", "start", "n_tokens", "ids_crc32") == want
    token_files.write_token_files(none, f"file://{tmp_path}/b")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/b").count() == 0
    token_files.write_token_files(crowded(docs), f"file://{tmp_path}/c")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/c").count() == len(ROWS) + 5


def test_packing():
    ranks = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 3], np.uint32)
    for n in range(len(ranks) + 1):
        control, data = token_files.pack(ranks[:n])
        assert token_files.unpack(control, data, n).tolist() == ranks[:n].tolist() and len(control) == -(-n // 4)


def test_quality(spark, none):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        words = [f"{'J!!' if bad else 'k'}{rng.randrange(500)}" for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    rows += [(900, ""), (901, None)]
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (1, None), (77777, 1)], "doc_id long, quality int")
    model = quality.fit_quality(df, marks)
    out = quality.score_quality(df, model).withColumn("held", quality.held_out(quality.F.col("doc_id"))).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert {r.held for r in out} == {True, False} and all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held and r.doc_id < 900]
    assert sum(r.predicted == (r.doc_id % 6 != 0) for r in held) >= 0.98 * len(held)
    again = quality.score_quality(df.repartition(7), quality.fit_quality(df.repartition(3), marks)).collect()
    assert {r.doc_id: round(r.score, 9) for r in again} == {r.doc_id: round(r.score, 9) for r in out}
    assert quality.score_quality(df, quality.fit_quality(df, marks.limit(0))).filter("predicted = 0").count() == 0
    assert quality.score_quality(none, model).count() == 0
    assert quality.score_quality(crowded(df, "predicted"), model).count() == len(rows) + 3 + 2


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets_by_hand(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_secrets(spark, docs, none):
    rng = random.Random(8)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_one, dull = "".join(rng.choices(b64, k=60)), "Aa1" * 20
    more = [
        (1000, "é" * 5 + " PassWord : 'hunter2hunter2' AKIAAKIA" + "Q" * 14 + " end secret=token:abcdefgh token=ab"),
        (1001, f"key {random_one} and {dull} done"), (1002, "password=secret=abcdefghij " * 300), (1003, "0123456789abcdef" * 4 + " \U0001f642 " + "f" * 23),
    ]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    texts = dict(TEXTS) | dict(more)
    out = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    for d, t in texts.items():
        found = [(x.kind, x.start, x.end) for x in out[d].secrets]
        want = secrets_by_hand(t)
        assert [x for x in found if not x[0].startswith("random")] == want
        assert (out[d].n_assign, out[d].n_access, out[d].n_hex) == tuple(sum(x[0] == k for x in want) for k in secrets.KINDS[:3])
    assert [texts[1001][x.start : x.end] for x in out[1001].secrets] == [random_one]
    assert secrets.scan_secrets(none).count() == 0
    assert secrets.scan_secrets(crowded(docs, "secrets", "N_hex")).count() == len(ROWS) + 5
