import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(tokens):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_random_texts(tokens, reference):
    codec, rng = bpe.Codec(tokens, PATTERN), random.Random(2)
    alphabets = ["abcdefghijklmnopqrstuvwxyz ", "aeiou st\n", "0123456789 .,", "éèüß漢字😀‍ ", "==--__ \t\r\x0b\x1c\x85", "ab"]
    texts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 50))) for _ in range(4000)]
    texts += ["".join(tokens[rng.randrange(len(tokens))].decode("utf-8", "ignore") for _ in range(4)) for _ in range(3000)]
    for t in texts:
        ids = codec.encode(t)
        assert ids.tolist() == reference.encode_ordinary(t) and codec.decode(ids) == t


def test_long_pieces_leave_the_machine_early(tokens, reference, monkeypatch):
    monkeypatch.setattr(bpe, "AGREE_AFTER", 300)
    for t in ("a" * 5000, "ab" * 3000, "-" * 4097, "thequickbrownfox" * 300):
        assert bpe.Codec(tokens, PATTERN).encode(t).tolist() == reference.encode_ordinary(t)


def test_small_tables_start_anew(tokens, reference, monkeypatch):
    monkeypatch.setattr(bpe, "STATES_KEPT", 20)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 20)
    monkeypatch.setattr(bpe, "PIECES_KEPT", 5)
    codec = bpe.Codec(tokens, PATTERN)
    for t in ("Unusual wordings, invented spellings and zyzzyvas; repeated repeatedly.", "Überraschung für alle"):
        assert codec.encode(t).tolist() == reference.encode_ordinary(t)


def test_utf8_stream_at_every_cut():
    data = "aé漢😀z".encode() + b"\xff\xc3(\xe2\x82"
    for cut in range(len(data) + 1):
        s = bpe.Utf8Stream()
        assert s.feed(data[:cut]) + s.feed(data[cut:]) + s.feed(b"", last=True) == data.decode("utf-8", "replace")


def test_documents(spark, reference):
    rows = [(1, None), (2, ""), (3, "Hello <|endoftext|> world"), (3, "Hello <|endoftext|> world"), (4, "x" * 20_000 + " né")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = bpe.round_trip_digests(df, PATH, PATTERN, keep=["doc_id", "n_tokens"]).collect()
    want = sorted((i, len(ids := reference.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = bpe.decode_documents(bpe.encode_documents(df, PATH, PATTERN), PATH).collect()
    assert all(r.decoded == (r.text or "") and r.n_tokens == "c" for r in back)
