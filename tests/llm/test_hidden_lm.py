"""Language-model scores: recursions against plain ones and against all ways through the states, counts and rounds by hand."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import hidden_lm as lm
from marginalia.llm import queries
from marginalia.llm.common import word_hashes
from marginalia.llm.markov import Chain, Sequences

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(chain, x):
    """Log likelihood, shares at the start, expected moves and emissions of one sequence, unscaled."""
    k, n = len(chain.start), len(x)
    a, b = np.zeros((n, k)), np.ones((n, k))
    a[0] = chain.start * chain.emit[x[0]]
    for t in range(1, n):
        a[t] = (a[t - 1] @ chain.move) * chain.emit[x[t]]
    for t in range(n - 2, -1, -1):
        b[t] = chain.move @ (chain.emit[x[t + 1]] * b[t + 1])
    p = a[-1].sum()
    moves, emit = np.zeros((k, k)), np.zeros((k, len(chain.emit)))
    for t in range(n):
        emit[:, x[t]] += a[t] * b[t] / p
        if t + 1 < n:
            moves += np.outer(a[t], chain.emit[x[t + 1]] * b[t + 1]) * chain.move / p
    return math.log(p), a[0] * b[0] / p, moves, emit


@pytest.fixture(scope="module")
def chain():
    rng = np.random.default_rng(0)
    return Chain(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(7), 3).T.copy())


@pytest.mark.parametrize(("stretch", "group"), [(2048, 300_000), (5, 40), (1, 7), (16, 100), (39, 1)])
def test_recursions(chain, stretch, group):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 40, 60)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    x = rng.integers(0, 7, offsets[-1])
    want = [plain(chain, x[a:b]) for a, b in itertools.pairwise(offsets.tolist())]
    s = Sequences(x, offsets, stretch, group)
    counts = s.counts(chain)
    assert np.allclose(s.logs(chain), [w[0] for w in want], atol=1e-10)
    assert np.isclose(counts.log, sum(w[0] for w in want))
    for got, i in ((counts.start, 1), (counts.move, 2), (counts.emit, 3)):
        assert np.allclose(got, sum(w[i] for w in want), atol=1e-9)


def test_likelihood_is_the_sum_over_all_ways(chain):
    for x in ([3], [0, 6, 2], [1, 1, 5, 4, 0, 2]):
        total = sum(
            math.prod([chain.start[way[0]], *(chain.move[a, b] for a, b in itertools.pairwise(way)), *(chain.emit[s, w] for s, w in zip(x, way, strict=True))])
            for way in itertools.product(range(3), repeat=len(x))
        )
        assert np.isclose(Sequences(np.array(x), np.array([0, len(x)]), 2).logs(chain)[0], math.log(total))


def test_long_sequences_do_not_vanish(chain):
    x = np.random.default_rng(2).integers(0, 7, 200_000)
    a, b = (Sequences(x, np.array([0, len(x)]), s).logs(chain)[0] for s in (2048, 10**6))
    assert np.isfinite(a) and np.isclose(a, b, rtol=1e-12)


def tokens_of(text):
    return [*(text or "").translate(UPPER).encode().split(), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def classes(words):
    real = [w for w in words if w is not None]
    high = iter(word_hashes(pa.array(real, pa.binary()), 0).tolist())
    return [lm.END if w is None else lm.WORDS + next(high) % (lm.CLASSES - lm.WORDS) for w in words]


ROWS = [(i, f"The cat {i % 7} sat ON the mat é {'x' * (i % 3)} word{i % 11}" * (i % 4 + 1)) for i in range(60)]
ODD = [(100, None), (101, ""), (102, " \n\t\x0b"), (None, "a null id"), (None, None), (7, "twice the same id"), (3, ROWS[3][1]), (200, "UNSEEN unseen Unseen é É")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("texts")
    rows = ROWS + ODD
    docs = spark.createDataFrame([(d, t, "x", 0.5) for d, t in rows], "doc_id long, text string, BLOCK string, score double")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    return str(at), rows


def test_query_by_hand(spark, tables):
    """Counts and base scores from the wording of the contract; scores from the fitted model by the plain recursion."""
    at, rows = tables
    counts = Counter(w for d, t in rows if not held(d) for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    fitted = []
    lm.score_texts(spark.read.parquet(f"{at}/documents.parquet"), fitted=fitted).collect()
    chain, base = fitted[0].chain, fitted[0].base
    assert (base.tokens, base.distinct) == (n, v)
    shares = np.zeros(lm.CLASSES)
    shares[lm.UNSEEN] = 0.5
    for w, c in zip(counts, classes(list(counts)), strict=True):
        shares[c] += counts[w] + 0.5
    assert np.allclose(base.shares, shares / (n + 0.5 * (v + 1)))

    def one(d, t):
        words = tokens_of(t)
        score = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        x = [c if counts[w] else lm.UNSEEN for c, w in zip(classes(words), words, strict=True)]
        return d, held(d), len(words), sum(counts[w] > 0 for w in words), n, score, score + plain(chain, x)[0] / math.log(10)

    df = queries.QUERIES["op12_lm_score"](spark, at)
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    found, want = sorted(map(tuple, df.collect()), key=key), sorted((one(d, t) for d, t in rows), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in want], atol=1e-8)
    assert any(r[1] for r in want) and any(r[3] < r[2] for r in want)


def test_rounds_by_hand(spark, tables):
    """Three rounds of Baum-Welch, by plain recursions over all training texts; likelihood rises; each state's words sum to one."""
    at, rows = tables
    texts = [classes(tokens_of(t)) for d, t in rows if not held(d)]
    fitted = []
    lm.score_texts(spark.read.parquet(f"{at}/documents.parquet"), states=3, rounds=3, prior=50.0, fitted=fitted).collect()
    model = fitted[0]
    chain, logs = lm.first_model(3, model.base), []
    for _ in range(3):
        parts = [plain(chain, x) for x in texts]
        logs.append(sum(p[0] for p in parts))
        flat = np.concatenate([[logs[-1]], *(np.ravel(sum(p[i] for p in parts)) for i in (1, 2, 3))])
        chain = lm.maximised(flat, 3, model.base, 50.0)
    assert np.allclose(model.logs, logs) and logs == sorted(logs)
    for a, b in zip(chain, model.chain, strict=True):
        assert np.allclose(a, b)
    assert np.allclose(model.base.shares @ model.chain.emit, 1) and np.isclose(model.base.shares.sum(), 1)
    assert np.allclose(model.chain.start.sum(), 1) and np.allclose(model.chain.move.sum(1), 1)


def test_seen_in_other_blocks(spark):
    """Results do not depend on how documents are dealt over tasks."""
    docs = spark.createDataFrame(ROWS + ODD, "doc_id long, text string")
    a, b = (sorted(map(tuple, lm.score_texts(docs.repartition(n), rounds=2).collect()), key=lambda r: (str(r[0]), r[2], r[5])) for n in (1, 13))
    assert [r[:5] for r in a] == [r[:5] for r in b] and np.allclose([r[5:] for r in a], [r[5:] for r in b], atol=1e-9)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.score_texts(docs.limit(0)).collect() == []
    out = next(i for i in range(100) if held(i))
    (r,) = lm.score_texts(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).collect()
    assert tuple(r) == (out, True, 3, 0, 0, 0.0, 0.0)
    only = next(i for i in range(100) if not held(i))
    (r,) = lm.score_texts(spark.createDataFrame([(only, None)], "doc_id long, text string")).collect()
    assert tuple(r)[:5] == (only, False, 1, 1, 1) and math.isclose(r.base_score, math.log10(1.5 / 2)) and math.isclose(r.score, r.base_score)


def test_held_out_texts_score_above_base(spark):
    found = lm.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    gain = sum(r.score - r.base_score for r in found) / sum(r.n_tokens for r in found)
    assert gain > 0.2 and sum(r.score > r.base_score for r in found) > 0.97 * len(found)


def test_very_long_text(spark):
    """Half a million words in one text take a few seconds and score like the plain sum of steps."""
    text = " ".join(f"w{i * i % 9973}" for i in range(500_000))
    rows = [(1, text), (2, "w1 w2 w3"), (3, "w4 w9 w16 W25")]
    fitted = []
    found = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1, fitted=fitted).collect()}
    assert found[1].n_tokens == 500_001 and math.isfinite(found[1].score)
    words = tokens_of(text)
    x = np.array(classes(words))
    chain, now, log = fitted[0].chain, fitted[0].chain.start, 0.0
    for i, s in enumerate(x.tolist()):
        now = (now @ chain.move if i else now) * chain.emit[s]
        total = now.sum()
        log, now = log + math.log(total), now / total
    if not held(1):
        assert math.isclose(found[1].score - found[1].base_score, log / math.log(10), rel_tol=1e-9)
