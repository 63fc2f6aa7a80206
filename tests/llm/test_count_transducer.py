import random

import numpy as np
import public_tokenizers as P
import sentencepiece

from panelforge.llm import count_transducer as ct

PATH = P.path("piece_bpe_32k.model")


def texts():
    r = random.Random(9)
    odd = [None, "", " ", "   ", "  a  b ", "a\tb\nc", "<s> hi </s><unk>", "a<0x41>b", "ﬁ é é Ａ 🎉", "▁a▁▁b", "x▁", "\0 \0",
           "a" * 1000, "ab" * 400 + " " * 300 + "c", " " * 1000, "日本語のテキスト" * 60]
    odd += ["".join(r.choice("abcdehinorst  é日<>_0") for _ in range(r.randint(0, 600))) for _ in range(300)]
    odd.append(" ".join("".join(r.choice("abcdefhinorst") for _ in range(r.randint(1, 12))) for _ in range(30_000)))
    return odd


def test_same_as_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = list(enumerate(texts())) + [(None, "a b"), (4, "  a  b ")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted(map(tuple, ct.token_counts(df, PATH).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in rows]
    assert got == sorted(want, key=str)


def test_chunks_of_any_size(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    t = [x for x in texts() if x is not None and len(x) < 2000]
    data = [x.encode() for x in t]
    off = np.concatenate([[0], np.cumsum(list(map(len, data)))])
    for c in (1, 2, 7, 5000):
        monkeypatch.setattr(ct, "CHUNK", c)
        got = ct.TextCounts(PATH).count(np.frombuffer(b"".join(data), np.uint8), off)
        assert got.tolist() == [len(x) for x in sp.encode(t)]


def test_long_units_in_segments(monkeypatch):
    """Texts without spaces over many chunks and segments, periodic ones too."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(4)
    t = ["".join(r.choice("abcdehinorsté日🎉") for _ in range(20_000)), "a" * 20_000, "ab" * 9000 + "c" * 3001, " " * 5000 + "x", "the " * 5000, "é" * 7000 + " " * 40]
    monkeypatch.setattr(ct, "SEGMENT", 1000)
    monkeypatch.setattr(ct, "CHUNK", 16)
    monkeypatch.setattr(ct, "WARM", 4)
    data = [x.encode() for x in t]
    off = np.concatenate([[0], np.cumsum(list(map(len, data)))])
    assert ct.TextCounts(PATH).count(np.frombuffer(b"".join(data), np.uint8), off).tolist() == [len(x) for x in sp.encode(t)]


def test_tables_that_start_anew(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    monkeypatch.setattr(ct, "STATES", 50)
    c = ct.TextCounts(PATH)
    for t in texts()[-40:]:
        b = np.frombuffer((t or "").encode(), np.uint8)
        assert c.count(b, np.array([0, len(b)])).tolist() == [len(sp.encode(t))]


def test_states_come_from_the_model_alone():
    """Words in another order are the same states; the last token of a prefix
    is the library's."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    m = ct.Transducer(ct.Model(PATH))
    for word in ("internationalization", "unhappiness", "xyzzy", "aaaaaaaaaaa"):
        state, total = 0, 0
        for k, x in enumerate(ct.MARK + word):
            state, change = m.step(state, ord(x))
            total += change
            if k:
                assert m.states[state][1][-1] == sp.encode(word[:k], out_type=str)[-1] and total == len(sp.encode(word[:k]))


def test_empty(spark):
    assert ct.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
