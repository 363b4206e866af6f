"""Byte-level BPE and the binary id format against the public tokenizers."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from patronage.llm import binary, bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
MULTI = P.path("byte_bpe_multi_50k.tiktoken")
VOCAB = P.path("word_bpe_49k.json")


def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=3000, alphabet="ab'strelvmdSTé 12\n\t!.　́Σİ中"):
    rng = random.Random(5)
    fixed = ["", " ", "a  b\n\n c", "'s", " 's", "\n's", "x'll'd", "''re", "  \n", "1a23", "<|endoftext|> a",
             "'s's 't", "ab\x1cc", "thethethe", "ÀÉ é"]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("path", [RANKS, MULTI])
def test_replay_equals_library(path):
    enc, ranks, texts = library(path), bpe.load_ranks(path), odd_texts()
    rng = random.Random(3)
    texts += ["".join(rng.choice("abeinorsth") for _ in range(rng.randint(2, 40))) for _ in range(3000)]
    part = bpe.Slice()
    part.add(texts)
    got = [i.tolist() for i in part.encoded(ranks)]
    assert got == [enc.encode_ordinary(t) for t in texts]
    assert all(bpe.decode_ids(i, ranks) == t.encode() for i, t in zip(got, texts))


def test_long_pieces_and_repeats():
    enc, ranks = library(RANKS), bpe.load_ranks(RANKS)
    texts = ["ab" * 3000, "the" * 500, " " * 1000 + "x", "a" * 4097]
    part = bpe.Slice()
    part.add(texts)
    assert [i.tolist() for i in part.encoded(ranks)] == [enc.encode_ordinary(t) for t in texts]


def test_round_trip_digest(spark, odd_docs, small_docs):
    enc = library(RANKS)
    for docs, pieces in ((odd_docs, 50), (small_docs, bpe.REPLAY_PIECES)):
        rows = docs.select("doc_id", "text").collect()
        want = []
        for r in rows:
            ids = enc.encode_ordinary(r["text"] or "")
            want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((r["text"] or "").encode()).hexdigest()))
        got = [tuple(r) for r in bpe.round_trip_digest(docs, RANKS, pieces=pieces).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_encode_then_decode(odd_docs, no_docs):
    out = bpe.decode(bpe.encode(odd_docs, RANKS, keep=("doc_id", "source")), RANKS)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "decoded"]
    want = sorted((r["text"] or "").encode() for r in odd_docs.select("text").collect())
    rows = out.collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == want
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)
    assert bpe.round_trip_digest(no_docs, RANKS).count() == 0


def test_encoder_equals_library():
    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    texts = odd_texts()
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    got = [i.tolist() for i in binary.Encoder(VOCAB).encode(texts)]
    bad = [(x, a, b) for x, a, b in zip(texts, got, want) if a != b]
    assert not bad, bad[:3]


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 100, 1000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    planes = binary.pack_ids(ids, 64, bits)
    assert np.array_equal(binary.unpack_ids(planes, n, 64), ids)


@pytest.mark.parametrize("bits", [False, True])
def test_write_and_read(spark, odd_docs, small_docs, no_docs, bits):
    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    for docs in (odd_docs, small_docs):
        folder = binary.write_ids(docs, VOCAB, block=50, chunk=400, bits=bits)
        got = binary.read_ids(spark, folder, with_ids=True).orderBy("start").collect()
        want = docs.select("doc_id", "text").collect()
        start = 0
        assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in want), key=lambda x: (x is not None, x or 0))
        texts = {}
        for r in want:
            texts.setdefault(r["doc_id"], []).append(t.encode(r["text"] or "", add_special_tokens=False).ids + [2])
        for r in got:
            assert r["ids"] in texts[r["doc_id"]]
            assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]))
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            start += r["n_tokens"]
    assert binary.read_ids(spark, binary.write_ids(no_docs, VOCAB)).count() == 0


ADDED = ["<|endoftext|>", "<|startoftext|>"]


def test_encoder_cuts_at_added_tokens():
    t, rng = Tokenizer.from_file(VOCAB), random.Random(7)
    parts = [*ADDED, "<|EndOfText|>", "<|endoftext", "|>", "<|", " ", "'s", "a", "\u0301", "\u03a3", "12", "\n", "The words"]
    texts = odd_texts(300) + ["a <|endoftext|> b", *ADDED, "<|<|endoftext|>|>", "x<|endoftext|><|endoftext|>\u0301y"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    got = [i.tolist() for i in binary.Encoder(VOCAB, encode_special_tokens=False).encode(texts)]
    bad = [(x, a, b) for x, a, b in zip(texts, got, want) if a != b]
    assert not bad, bad[:3]
    assert got[texts.index("a <|endoftext|> b")] == [320, 49407, 321]


def test_written_ids_equal_unchanged_library(spark):
    t = Tokenizer.from_file(VOCAB)
    rows = [(1, "a <|endoftext|> b"), (2, "plain"), (3, "<|startoftext|>x<|endoftext|>"), (4, None)]
    folder = binary.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), VOCAB)
    want, start = [], 0
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert [tuple(r) for r in binary.read_ids(spark, folder, with_ids=True).orderBy("start").collect()] == want
