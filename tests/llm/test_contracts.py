"""Every opN query against a version by hand, on every column, over a table with null ids, null and empty texts, repeated
rows, an id with two texts, ties, and columns whose names clash with those that operators add."""

import hashlib
import zlib

import numpy as np
import pytest

from marginalia.llm import bpe, decontamination, near_dedup, nearest, quality, queries, secrets, substring_dedup, token_files

from .test_operators import lines_by_hand, secrets_by_hand

SF = "/root/testdata/sf0.001"
LOW = -(2**63)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """A folder of tables and the documents' rows."""
    at = tmp_path_factory.mktemp("crowd")
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.orderBy("doc_id").limit(12)
    passage = " ".join(f"word{i}" for i in range(70))
    own = spark.createDataFrame([(9001, f"a {passage} b"), (9002, f"{passage} c"), (9003, None), (9004, ""), (9005, " \n\t "), (9001, "another text of the same id")], "doc_id long, text string")
    more = own.select("doc_id", "text", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns[2:]])
    out = docs.unionByName(some).unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(more)
    taken = ("id", "row", "node", "n_words", "N_LINES", "score", "ids", "component_id", "secrets", "start", "kept")
    out.withColumns({c: F.lit("x") for c in taken}).coalesce(2).write.parquet(f"{at}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    return str(at), rows


def result(spark, crowd, name, *cols):
    found = queries.QUERIES[name](spark, crowd[0])
    assert tuple(found.columns[: len(cols)]) == cols
    return sorted((tuple(r) for r in found.select(*cols).collect()), key=repr)


def by_row(rows, one):
    return sorted(((d, *one(t or "")) for d, t in rows), key=repr)


def test_op1(spark, crowd):
    def one(text):
        base = secrets_by_hand(text)
        counts = (sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
        return (*counts, sha(",".join(f"{k}:{a}:{b}" for k, a, b in base)))

    assert result(spark, crowd, "op1_secret_scan", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == by_row(crowd[1], one)
    texts = {}
    for d, t in crowd[1]:
        texts.setdefault(d, []).append(t or "")
    for r in queries.QUERIES["op1_secret_scan"](spark, crowd[0]).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x]
        base = [tuple(x) for x in spans if not x[0].startswith("random")]
        assert any(base == [(k, str(a), str(b)) for k, a, b in secrets_by_hand(t)] for t in texts[r.doc_id])
        assert [(int(x[1]), secrets.KINDS.index(x[0])) for x in spans] == sorted((int(x[1]), secrets.KINDS.index(x[0])) for x in spans)


def test_op1_rate_by_hand(spark):
    """Benjamini-Hochberg over all candidates of a class, those that the other tests reject included."""
    rows = [(k % 2, p) for k in range(2) for p in (1e-6, 1e-5, 1e-3, 0.004, 0.03, *[1.0] * 5)]
    cut = secrets._cutoffs(spark.createDataFrame(rows, "class int, p double"), 0.01)
    assert set(cut) == {0, 1} and all(1e-3 <= c < 0.004 for c in cut.values())  # 3 of 10: 1e-3 <= 0.01 * 3 / 10; 4: 0.004 = 0.01 * 4 / 10 is cut at the next fiftieth
    assert secrets._cutoffs(spark.createDataFrame([(0, 0.5)], "class int, p double"), 0.01) == {}


def test_op2(spark, crowd):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in crowd[1]:
        w = (t or "").translate(upper).encode().split()
        sets.setdefault(LOW if d is None else d, set()).add(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, d in enumerate(ids):
        for e in ids[:i]:
            if any(a and b and 100 * len(a & b) >= 85 * len(a | b) for a in sets[d] for b in sets[e]):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    want = []
    for d, _ in crowd[1]:
        d = LOW if d is None else d
        comp = find(d)
        want.append((None if d == LOW else d, max(map(len, sets[d])), None if comp == LOW else comp, comp == d))
    assert result(spark, crowd, "op2_near_dedup", "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)


def test_op3(spark, crowd):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    one = lambda t: decontamination.brute_force([(0, t)], items)[0][1:]
    assert result(spark, crowd, "op3_benchmark_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == by_row(crowd[1], one)


def test_op3_memory_follows_words():
    """The automaton has no more nodes than the benchmark has words."""
    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50_000, 200))) for i in range(300)]
    built = decontamination.Windows(items, 10)
    assert built.found.get_stats()["nodes_count"] <= 200 * 300 and len(built.owner) == 300 * 191


def test_op4(spark):
    found = {}
    for r in queries.QUERIES["op4_nearest_neighbours"](spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect() if r.embedding is not None}
    rows = {k: v for k, v in rows.items() if np.isfinite(v).all() and v.any()}
    assert set(found) == {k for k in rows if k % 100 == 0}
    hits = total = 0
    for q, got in found.items():
        near = sorted((float(np.sqrt(((v - rows[q]) ** 2).sum())), k) for k, v in rows.items() if k != q)[:10]
        assert [x[0] for x in got] == list(range(1, len(near) + 1))
        assert all(abs(float(np.sqrt(((rows[k] - rows[q]) ** 2).sum())) - s) < 1e-9 for _, k, s in got)
        assert [(s, k) for _, k, s in got] == sorted((s, k) for _, k, s in got)
        hits += len({k for _, k in near} & {k for _, k, _ in got})
        total += len(near)
    assert hits >= 0.95 * total


def test_op4_recall_in_a_full_shard():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(nearest.SHARD, 32))
    asked = rng.choice(len(v), 100, replace=False)
    near, _ = nearest.build(v, np.arange(len(v))).search(v[asked], 11)
    hits = sum(len(set(near[i]) & set(np.argsort(((v - v[q]) ** 2).sum(1), kind="stable")[:11])) for i, q in enumerate(asked))
    assert hits >= 0.95 * 1100


def test_op5(spark, crowd):
    ids = [(LOW if d is None else d, t) for d, t in crowd[1]]
    split = [(d, (t or "").encode().split()) for d, t in ids]
    first = {}
    for d, w in split:
        for i in range(len(w) - 49):
            x = tuple(w[i : i + 50])
            first[x] = min(first.get(x, d), d)
    want = []
    for d, w in split:
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        want.append((None if d == LOW else d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    assert result(spark, crowd, "op5_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_op5_paths_are_compacted(spark):
    """A passage that two documents share is one path: its edges all have one head."""
    from marginalia.llm.common import Scratch

    words = " ".join(f"w{i}" for i in range(900))
    found = []
    for d, t in ((1, f"x y z {words}"), (2, f"{words} q")):
        import pyarrow as pa

        rows = pa.RecordBatch.from_arrays([pa.array([t]), pa.array([d]), pa.array([0])], names=["t", "id", "row"])
        (cells,) = substring_dedup._paths(50, 8)(iter([rows]))
        paths = [{"kmer": r["kmer"], "start": r["start"], "last": r["last"], "at": r["at"]} for r in cells.to_pylist()]
        read = pa.RecordBatch.from_arrays([pa.array([t]), pa.array([paths]), pa.array([d])], names=["t", "p", "id"])
        (out,) = substring_dedup._read_at(50, True)(iter([read]))
        found += [(d, p["kmer"], p["start"], p["last"], p["edge"], p["next"], p["before"]) for p in out.column(4).to_pylist()[0]]
    df = spark.createDataFrame(found, "id long, kmer long, start int, last int, edge binary, next binary, before binary")
    both = {r[4] for r in found if r[0] == 1} & {r[4] for r in found if r[0] == 2}
    shared = df.filter(df.edge.isin(list(both)))
    paths = substring_dedup._compacted(substring_dedup._graph(shared), Scratch(spark)).collect()
    assert len(both) > 15 and len({bytes(r.head) for r in paths}) == 1 and len(paths) == len(both) - 1
    start = {bytes(r[4]): r[2] for r in found if r[0] == 2}
    assert all(r.far == start[bytes(r.edge)] - start[bytes(r.head)] for r in paths)


def test_op7(spark, crowd):
    want = sorted(((None if d == LOW else d, *rest) for d, *rest in lines_by_hand([(LOW if d is None else d, t) for d, t in crowd[1]])), key=repr)
    assert result(spark, crowd, "op7_line_dedup", "doc_id", "n_lines", "n_dropped", "kept_sha256") == want


def test_op7_many_lines(spark):
    from marginalia.llm.line_dedup import dedup_lines

    rows = [(d, "\n".join(["a line that all of these documents share", *(f"line {d} {i} of its own" for i in range(60_000))])) for d in range(3)]
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {d: (60_001, int(d < 2), t if d == 2 else t.split("\n", 1)[1]) for d, t in rows}


def test_op8(spark, crowd):
    """Scores are those of the fitted model on each text alone."""
    model = quality.fit_quality(spark.read.parquet(f"{crowd[0]}/documents.parquet"), spark.read.parquet(f"{crowd[0]}/labels.parquet"))
    found = result(spark, crowd, "op8_quality_classifier", "doc_id", "held_out", "score", "predicted")

    def one(text):
        score = float(model.score(np.array([quality.features(text)]))[0])
        return score, int(score >= 0.7)

    want = sorted(((d, zlib.crc32(str(d).encode()) % 4 == 2 if d is not None else False, *one(t or "")) for d, t in crowd[1]), key=repr)
    assert [(r[0], r[1], r[3]) for r in found] == [(r[0], r[1], r[3]) for r in want]
    assert all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(found, want, strict=True))


def test_op8_prior_and_risk():
    """Half of the unlabelled rows are like the positives: the prior says so, and the negatives score low, unseen."""
    rng = np.random.default_rng(3)
    good, bad = (lambda n: rng.normal(1.5, 1, (n, 6))), (lambda n: rng.normal(-1.5, 1, (n, 6)))
    unlabelled = np.concatenate((good(1000), bad(1000)))
    model = quality.Model(1.0).fit(good(800), unlabelled)
    assert abs(model.prior - 0.5) < 0.05
    assert (model.score(good(500)) > 0.5).mean() > 0.98 and (model.score(bad(500)) < 0.5).mean() > 0.98
    scores = np.linspace(0, 1, 1000)
    assert abs(quality.best_cut(scores + 10, np.concatenate((scores + 10, scores[::2], scores[1::2] - 5))) - 0.5) < 0.05


@pytest.fixture(scope="module")
def coder():
    return bpe.load_tokenizer(bpe.default_tokenizer())


def test_op9(spark, crowd, coder):
    """Documents in ascending order, a null id first; rows of one id in any order among themselves."""
    found = queries.QUERIES["op9_token_files"](spark, crowd[0]).select("doc_id", "start", "n_tokens", "ids_crc32").collect()

    def one(text):
        ids = [*coder.encode(text, add_special_tokens=False).ids, token_files.END_ID]
        return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())

    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=repr) == by_row(crowd[1], one)
    placed = sorted(found, key=lambda r: r.start)
    assert [r.start for r in placed] == [0, *np.cumsum([r.n_tokens for r in placed]).tolist()[:-1]]
    ids = [LOW if r.doc_id is None else r.doc_id for r in placed]
    assert ids == sorted(ids)


def test_op10(spark, crowd, coder):
    def one(text):
        ids = coder.encode(text, add_special_tokens=False).ids
        return len(ids), sha(" ".join(map(str, ids))), sha(coder.decode(ids, skip_special_tokens=False))

    assert result(spark, crowd, "op10_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == by_row(crowd[1], one)


def test_op10_other_tokenizer(spark, crowd):
    """A tokenizer whose tokens take the blank before a word along."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = bpe.load_tokenizer(path)
    with pytest.raises(ValueError, match="white space"):
        bpe.WordEncoder(path)
    docs = spark.read.parquet(f"{crowd[0]}/documents.parquet").select("doc_id", "text")
    found = bpe.decode(bpe.encode(docs, path=path).withColumn("same", bpe.F.col("ids")), path=path)
    want = sorted(((d, other.encode(t or "", add_special_tokens=False).ids, t or "") for d, t in crowd[1]), key=repr)
    assert sorted(((r.doc_id, list(r.same), r.decoded) for r in found.collect()), key=repr) == want


def test_op10_joins_widen():
    """Tokens that cross blanks: joins of parts encoded alone are repaired until they agree with the whole."""
    import random

    from tokenizers import Tokenizer, models

    merges = [("a", " "), ("a ", "b"), (" ", "c"), ("d", " c"), ("b", "b"), ("c", "d"), ("a b", "a b")]
    vocab = {x: i for i, x in enumerate([*"abcd ", *(x + y for x, y in merges)])}
    coder = bpe.TextEncoder(Tokenizer(models.BPE(vocab, merges)))
    rng, wrong = random.Random(2), 0
    for _ in range(30):
        text = "".join(rng.choices("abcd  ", k=2000))
        cuts = bpe.word_cuts(np.frombuffer(text.encode(), np.uint8)).tolist()[40::60]
        ends = [*cuts, len(text)]
        parts = [np.array(coder.together([text[a:b]])[0], np.uint32) for a, b in zip([0, *cuts], ends, strict=True)]
        want = coder.together([text])[0]
        wrong += np.concatenate(parts).tolist() != want
        (joined,) = bpe.join_ids([text.encode()], [ends], [list(parts)], coder)
        assert np.concatenate(joined).tolist() == want
    assert wrong > 20


def test_pairs_near_the_threshold_in_one_band(spark):
    """A family whose members lie on both sides of the threshold, without a centre, ends as by hand."""
    import random

    rng = random.Random(11)
    base = [f"b{i}" for i in range(146)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            words[rng.randrange(146)] = f"v{rng.randrange(12)}"
        rows.append((i, " ".join(words)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id", "kept").collect()) == sorted(near_dedup.brute_force(rows))


def test_components(spark):
    from marginalia.llm.common import Scratch

    edges = [(f"c{i}", f"c{i + 1}") for i in range(200)] + [("hub", f"h{i}") for i in range(300)] + [("x", "x"), ("y", "z"), ("z", "y")]
    found = near_dedup.components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark)).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.comp, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, 201, 301] and all(c in g for c, g in groups.items())
    assert near_dedup.components(spark.createDataFrame([], "a string, b string"), Scratch(spark)).count() == 0
