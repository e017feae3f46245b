"""What a worker keeps while it encodes texts of ever new words, and how often it asks the tokenizer."""

import random
import string
import tracemalloc

import pyarrow as pa


def new_words(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices(string.ascii_lowercase, k=9)) + "." * (k % 2) for k in range(n)]


def test_memory_is_bounded_where_all_words_are_new():
    from marginalia.llm import bpe

    coder = bpe.WordEncoder(bpe.default_tokenizer())
    blocks = [pa.array([" ".join(new_words(k, 60_000))]) for k in range(6)]
    tracemalloc.start()
    try:
        for block in blocks:
            coder.encode(block)
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert kept < 50 << 20 and most < 80 << 20, (kept >> 20, most >> 20)
    texts = [" ".join(new_words(9, 500)), blocks[0][0].as_py()[:2000], ""]
    ids, starts = coder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == coder.together(texts)


def test_token_files_encode_a_piece_once(monkeypatch):
    """Words that differ only in case or in the signs and digits around the same letters bring nothing new."""
    from marginalia.llm import bpe, token_files

    asked, learn = [], bpe.WordEncoder.learn
    monkeypatch.setattr(bpe, "_encoders", {})
    monkeypatch.setattr(bpe.WordEncoder, "learn", lambda self, found: (asked.extend(found), learn(self, found))[1])
    stems = [w.rstrip(".") for w in new_words(1, 50)] + ["été", "ñandú"]
    texts = [" ".join(f"{a}{form}{b}" for w in stems for form in (w, w.upper(), w.title())) for a in ("", "(", "1") for b in ("", ",", ").", "20")]
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts))), pa.array(range(len(texts)))], names=["text", "id", "row"])
    path, found = bpe.default_tokenizer(), {}
    for block in token_files._encode(path)(iter([rows])):
        found |= {r["id"]: token_files._ids(r["n"], r["ids"]).tolist() for r in block.to_pylist()}
    assert len(asked) == len(set(asked)) == len(stems) + len("(,120") + len([")."])
    assert found == {k: [*x, token_files.END_ID] for k, x in enumerate(bpe.encoder(path).together(texts))}
