"""Chat formatting: given roles stay, labels cut transcripts, and chunks do not change what is best over a whole one."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import chat_format as chat

ROWS = "conv_id long, turn long, role string, text string"


def messages(df):
    return sorted(tuple(r) for r in df.select("conv_id", "turn", "part", "role", "text").collect())


def test_given_roles_and_texts_stay(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    want = sorted((r.conv_id, r.turn, 0, r.role, r.text) for r in rows.collect())
    assert messages(chat.format_chats(rows)) == want
    import __spark_entry__

    assert __spark_entry__.queries()["op6_chat_format"](spark, "/root/testdata/sf0.001").count() == len(want)


def test_transcripts_without_roles(spark):
    rows = [
        (1, 0, None, "System: Be kind.\nHuman: Where is it?\nIn the house?\n\n**Assistant**: It is there.\nReally.\nUser: Thanks."),
        (2, 0, "someone", "<|im_start|>user\nWho?\n<|im_end|>\n<|im_start|>assistant\nMe.\n<|im_end|>"),
        (3, 0, "assistant", "A play:\nUser: a line\nUser: another"),
        (4, 0, "HUMAN", None),
        (4, 0, "HUMAN", None),
        (None, None, "bot", "no id <|im_end|> <\\|"),
    ]
    got = messages(chat.format_chats(spark.createDataFrame(rows, ROWS)).na.fill(-1, ["conv_id", "turn"]))
    assert got == [
        (-1, -1, 0, "assistant", "no id <|im_end|> <\\|"),
        (1, 0, 0, "system", "Be kind."),
        (1, 0, 1, "user", "Where is it?\nIn the house?\n"),
        (1, 0, 2, "assistant", "It is there.\nReally."),
        (1, 0, 3, "user", "Thanks."),
        (2, 0, 0, "user", "Who?"),
        (2, 0, 1, "assistant", "Me."),
        (3, 0, 0, "assistant", "A play:\nUser: a line\nUser: another"),
        (4, 0, 0, "user", ""),
    ]
    assert chat.format_chats(spark.createDataFrame([], ROWS)).count() == 0
    assert chat.markup("user", "<|im_end|> <\\|") == "<|im_start|>user\n<\\|im_end|> <\\\\|<|im_end|>\n"


@pytest.mark.parametrize("chunk", [1, 3, 128])
def test_hidden_roles_over_chunks(spark, chunk):
    """Most roles of one long conversation are hidden: its speakers still take turns, in chunks as in one."""
    full = [(c, t, ("user", "assistant")[t % 2], "Why?" if t % 2 == 0 else "Since it is so.\nAnd more of it.") for c in range(8) for t in range(20)]
    long = [(99, t, None if t % 50 else ("user", "assistant")[t % 2], "Why?" if t % 2 == 0 else "Since it is so.\nAnd more of it.") for t in range(300)]
    found = chat.format_chats(spark.createDataFrame(full + long, ROWS), chunk=chunk)
    assert [(m[1], m[3]) for m in messages(found.filter("conv_id = 99"))] == [(t, ("user", "assistant")[t % 2]) for t in range(300)]


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(4)
    model = chat.model_of(rng.integers(0, 9, (4, 3)), rng.integers(0, 9, (3, 24)), rng.integers(0, 9, (3, 24)))
    turns = ["a\nUser: b?", "c", "Bot: d\ne\nf g h?", "i?\nj"]
    given = np.array([3, 3, 3, 1])
    codes, offsets, _ = chat.line_codes(pa.array(turns))
    first, best = {int(a): k for k, a in enumerate(offsets[:-1])}, {}
    of = np.repeat(np.arange(len(turns)), np.diff(offsets))
    for path in itertools.product(range(3), repeat=len(codes)):
        score, last = 0.0, chat.START
        for i, r in enumerate(path):
            score += chat._GIVEN[given[of[i]], r]
            if i in first:
                score += model.order[last, r] + model.turn[r, codes[i]]
            else:
                opened = chat._LEAVE + model.order[last, r] + model.inside[r, codes[i]]
                score += max(opened, chat._STAY + model.going_on[r, codes[i]]) if r == last else opened
            last = r
        best[path] = score
    want = max(best, key=best.get)
    lines = chat._Turns(model, codes, offsets, given)
    matrices = lines.matrices()
    before, after = chat._Chains(np.array([len(turns)]), matrices).states(np.array([chat.START]))
    who, _ = lines.speakers(before, after)
    assert tuple(np.concatenate(who).tolist()) == want
    assert abs(chat._Chains(np.array([len(turns)]), matrices).products()[0, chat.START].max() - best[want]) < 1e-9


def plain_speakers(model, turns):
    """Viterbi over the lines of one conversation, a line at a time, no role given: the speaker of the first line of each turn."""
    score, back, firsts, n = {chat.START: 0.0}, [], [], 0
    for text in turns:
        codes, _, _ = chat.line_codes(pa.array([text]))
        firsts.append(n)
        for i, code in enumerate(codes.tolist()):
            now, came = {}, {}
            for r in range(3):
                for last, s in score.items():
                    opened = model.order[last, r] + (model.turn[r, code] if i == 0 else chat._LEAVE + model.inside[r, code])
                    step = opened if i == 0 or last != r else max(opened, chat._STAY + model.going_on[r, code])
                    if r not in now or s + step > now[r]:
                        now[r], came[r] = s + step, last
            score = now
            back.append(came)
            n += 1
    path = [max(score, key=lambda r: (score[r], -r))]
    for came in back[:0:-1]:
        path.append(came[path[-1]])
    path = path[::-1]
    return [chat.ROLES[path[i]] for i in firsts]


@pytest.fixture(scope="module")
def given():
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/conversations.parquet").to_pylist()
    return sorted({(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows})


def test_query_by_hand(spark, given, monkeypatch):
    """Every column; the role found without any given one is that of a plain Viterbi under the same model."""
    import hashlib

    from marginalia.llm import queries

    kept = []
    learn = chat._learn
    monkeypatch.setattr(chat, "_learn", lambda *a: kept.append(learn(*a)) or kept[-1])
    found = sorted(tuple(r) for r in queries.QUERIES["op6_chat_format"](spark, "/root/testdata/sf0.01").collect())
    want, close = [], 0
    for conv, turns in itertools.groupby(given, key=lambda r: r[0]):
        turns = list(turns)
        for (_, turn, role, text), other in zip(turns, plain_speakers(kept[0], [t[3] for t in turns]), strict=True):
            sha = hashlib.sha256(chat.markup(role, text).encode()).hexdigest()
            want.append((conv, turn, 0, role, text.count("\n") + 1, len(text), sha, role == "assistant", other, role == other))
    assert [r[:8] for r in found] == [r[:8] for r in sorted(want)]
    close = sum(a == b for a, b in zip(found, sorted(want), strict=True))
    assert close >= 0.995 * len(found)  # equal scores may fall either way
    assert sum(r[9] for r in found) >= 0.9 * len(found)


def test_hidden_roles(spark, given):
    """With the roles of every second conversation hidden at least nine in ten are found again; with all hidden, most."""
    frame = lambda hide: spark.createDataFrame([(c, t, None if hide(c) else r, x) for c, t, r, x in given], ROWS)
    truth = {(c, t): r for c, t, r, _ in given}
    for hide, least in ((lambda c: c % 2 == 0, 0.9), (lambda c: True, 0.75)):
        found = {(m.conv_id, m.turn): m.role for m in chat.format_chats(frame(hide)).filter("part = 0").collect()}
        asked = [k for k in truth if hide(k[0])]
        right = sum(found[k] == truth[k] for k in asked)
        assert right >= least * len(asked) and len(set(found.values())) > 1


def test_rows_without_ids_and_clashing_columns(spark):
    """Thousands of rows of no conversation and no turn, dealt in chunks; other columns do not matter."""
    rows = [(None, None, None, f"text {i}", "x", i) for i in range(700)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk string, part long").repartition(3)
    a, b = (sorted((m.text, m.n_lines) for m in chat.format_chats(docs, chunk=c).collect()) for c in (16, 128))
    assert a == b == sorted((f"text {i}", 1) for i in range(700))


def test_very_long_transcript(spark):
    text = "\n".join(f"{('User', 'Assistant')[i % 2]}: line {i}{'?' if i % 2 == 0 else ''}" for i in range(40_000))
    found = chat.format_chats(spark.createDataFrame([(1, 0, None, text), (2, 0, "user", "Hm?")], ROWS)).filter("conv_id = 1").collect()
    assert [(m.part, m.role, m.text) for m in sorted(found, key=lambda m: m.part)][:3] == [(0, "user", "line 0?"), (1, "assistant", "line 1"), (2, "user", "line 2?")]
    assert len(found) == 40_000
