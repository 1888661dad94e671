import random

import numpy as np
import pytest

import public_tokenizers as P
import tiktoken
from vigil.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
HARD = ["", "a", " ", "  ", "it's we'll I'd  you've 'S 'll' ''s don't\n\n 's", "tab\t\tx \n y\r\n", "été über ñandú 中文字 १२३ x²½", "a b  c　d", "\x1c\x1d x\x85y", "emoji 😀😃 ok", "<|endoftext|>", "'r 'l 'v 're", "x's's't", "x" * 3000, " " * 500 + "a", "'", "''", " 's", "\n's", "a 's", "9's", "!'s", "' s", "s'"]


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(bpe.read_ranks(PATH))


@pytest.fixture(scope="module")
def theirs(vocab):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def test_minimal_perfect_hash(vocab):
    assert len(vocab.keys) == len(vocab.ranks)
    assert sorted(vocab.ids) == sorted(vocab.ranks.values())


def test_encode_equals_library(vocab, theirs):
    rng = random.Random(1)
    alphabet = list("abst'lredvm  \n\t!?9²é中 😀\x1c") + ["'s", "'ll", " the", "tion"]
    texts = HARD + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    ids, at = bpe.Encoder(vocab).encode(np.frombuffer(b"".join(raw), np.uint8), offs)
    for k, t in enumerate(texts):
        got = ids[at[k] : at[k + 1]]
        assert got.tolist() == theirs.encode_ordinary(t), repr(t)
        assert vocab.decode(got) == raw[k]


def test_frames(spark, vocab, theirs):
    rows = [(1, "it's fine", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (4, "long " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(bpe.encode(df, vocab).collect(), key=lambda r: r.doc_id)
    assert [r.ids for r in got] == [theirs.encode_ordinary(t or "") for _, t, _ in rows]
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(df, vocab), vocab).collect()}
    assert back[4] == b"long " * 5000 and back[2] == b""
    empty = bpe.encode_digests(df.limit(0), vocab)
    assert empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and empty.count() == 0


def test_thue_morse_words_keep_apart(vocab, theirs):
    """Words that agree under any polynomial hash modulo 2 ** 64."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = one.translate({97: "b", 98: "a"})
    for text in (one, other, f"{one} {one[::-1]} {other}"):
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, _ = bpe.Encoder(vocab).encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == theirs.encode_ordinary(text)
        assert vocab.decode(ids) == text.encode()


def test_equal_hashes_are_told_apart_by_bytes(vocab, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "span_hashes", lambda buf, s, e, seed=0: np.full(len(s), 12345, np.uint64))
    text = "some quite different words, some again"
    raw = np.frombuffer(text.encode(), np.uint8)
    ids, _ = bpe.Encoder(vocab).encode(raw, np.array([0, len(raw)]))
    assert vocab.decode(ids) == text.encode()
