import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from tidemark.llm import token_counts as C

PATH = public_tokenizers.path("piece_bpe_32k.model")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return C.read_model(PATH)


def slow_count(text: str, ranks: dict[str, float]) -> int:
    """The definition: join the lowest-ranked adjacent pair, leftmost first, until none is left."""
    parts = list(C.SPACE + text.replace(" ", C.SPACE)) if text else []
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return sum(1 if p in ranks else len(p.encode()) for p in parts)


def test_random_texts(library, vocabulary):
    counter, rng = C.Counter(vocabulary), random.Random(5)
    alphabets = ["abcdefghijklmnopqrstuvwxyz ", "  \t\n\r a", "éèüß漢字😀‍ ", "▁ ab", "0123456789 .,<s></s>", "執벨ゼ梦 \0\x85\xa0　", "<0x0A>"]
    texts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 60))) for _ in range(4000)]
    pieces = [library.id_to_piece(i).replace(C.SPACE, " ") for i in range(library.get_piece_size())]
    texts += ["".join(rng.choice(pieces) for _ in range(6)) for _ in range(3000)]
    for t in texts:
        assert counter.count(t) == len(library.encode(t)), t


def test_against_the_definition():
    rng = random.Random(6)
    for _ in range(300):
        tokens = {"".join(rng.choices("ab" + C.SPACE, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 8))}
        ranks = {t: float(rng.randint(0, 4)) for t in tokens}
        counter = C.Counter(C.Vocabulary(ranks, None, True))
        for _ in range(20):
            t = "".join(rng.choices("abß ", k=rng.randint(0, 14)))
            assert counter.count(t) == slow_count(t, ranks), (ranks, t)


def test_long_pieces(library, vocabulary):
    counter = C.Counter(vocabulary)
    for t in ("a" * 60_000, "ab" * 20_000, " " * 30_001, "-" * 30_001, "thequickbrownfox" * 3000, "漢" * 20_000, "\n" * 20_000):
        assert counter.count(t) == len(library.encode(t))


def test_small_store_starts_anew(library, vocabulary, monkeypatch):
    monkeypatch.setattr(C, "PIECES_KEPT", 3)
    counter = C.Counter(vocabulary)
    for t in ("one two three four five one two three", "repeated repeatedly, unusual spellings; zyzzyvas"):
        assert counter.count(t) == len(library.encode(t))


def test_byte_level_ranks():
    vocabulary = C.read_ranks(RANKS, PATTERN)
    ranks = {t.encode("latin-1"): int(r) for t, r in vocabulary.ranks.items()}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    counter, rng = C.Counter(vocabulary), random.Random(7)
    for _ in range(2000):
        t = "".join(rng.choices(rng.choice(["etaoin shrdlu", "é漢😀 z", "==--\n\t 12"]), k=rng.randint(0, 50)))
        assert counter.count(t) == len(library.encode_ordinary(t))


def test_documents(spark, library, vocabulary):
    rows = [(1, None), (2, ""), (3, "<s> special </s> <unk>"), (3, "<s> special </s> <unk>"), (None, "no id"), (4, "word " * 5000), (5, " ")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = C.count_tokens(df, vocabulary, keep=["doc_id", "n_tokens"]).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=key) == sorted(want, key=key)
    assert C.count_tokens(df, vocabulary).columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    assert C.count_tokens(df.limit(0), vocabulary).collect() == []


def test_other_models_are_refused(tmp_path):
    broken = tmp_path / "unigram.model"
    broken.write_bytes(b"\x12\x02\x18\x01")  # trainer: model type 1
    with pytest.raises(ValueError):
        C.read_model(str(broken))
