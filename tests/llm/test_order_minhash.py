import hashlib

import numpy as np

from tidemark.llm import order_minhash as O


def slow_signature(text, k=O.K, ell=O.ELL, slots=O.SLOTS):
    """The selected places per slot, from numbered k-mers one at a time."""
    if not text:
        return [()] * slots
    k = min(k, len(text))
    base = O.kmer_digests(np.array(list(map(ord, text)), np.uint32), k)
    seen, mers = {}, []
    for i, d in enumerate(base):
        key = int(d) >> O.PLACE_BITS
        n = seen.get(key, 0)
        seen[key] = n + 1
        with np.errstate(over="ignore"):
            mers.append((int(O._mix(np.array([key], np.uint64) + np.uint64(n) * O._BASE)[0]), i))
    bits = 64 - (slots.bit_length() - 1)
    return [tuple(m for m, i in sorted(sorted(x for x in mers if x[0] >> bits == s)[:ell], key=lambda x: x[1])) for s in range(slots)]


def test_slots_select_the_smallest_in_text_order():
    for t in ["abc", "hello world, hello world", "the same the same the same " * 40, "".join(chr(97 + i * i % 23) for i in range(9000))]:
        slow, fast = slow_signature(t), O.signature(t)
        assert [bool(s) for s in slow] == [bool(f) for f in fast]
        groups = {}
        for s, f in zip(slow, fast):
            assert groups.setdefault(s, f) == f


def test_digests_are_of_the_window_only():
    a, b = "xxxxHELLOyyyy", "zHELLO"
    code = lambda t: np.array(list(map(ord, t)), np.uint32)
    assert O.kmer_digests(code(a), 5)[4] == O.kmer_digests(code(b), 5)[1]


def test_order_and_edits_cost():
    t = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
    s = O.signature(t)
    swapped = O.signature(t[len(t) // 2 :] + t[: len(t) // 2])
    assert O.likeness(s, O.signature(t)) == 1.0 > O.likeness(s, O.signature(t[:2000] + "X" + t[2000:])) > 0.9 > O.likeness(s, swapped) > 0
    assert O.likeness(O.signature(""), O.signature("")) == 1.0 and O.likeness(s, O.signature("")) == 0.0


def test_swapped_halves_of_short_texts_cost():
    rng = np.random.default_rng(3)
    for size in (20, 50, 100, 200):
        found = []
        for _ in range(50):
            t = "".join(map(chr, rng.integers(97, 123, size)))
            found.append(O.likeness(O.signature(t), O.signature(t[size // 2 :] + t[: size // 2])))
        # about half of the pairs stand within one half and stay, the others change order
        assert np.mean(found) < 0.55
    assert O.likeness(O.signature("abcde"), O.signature("abcde")) == 1.0 and np.count_nonzero(O.signature("abcde")) == 1
    assert O.likeness(O.signature("abcdeXfghij"), O.signature("abcdeXfghij")) == 1.0


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fingerprint int")
    got = sorted(map(tuple, O.with_next_edits(df).collect()), key=repr)
    line = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for n, (i, t) in enumerate(line):
        after = line[(n + 1) % len(line)][1]
        new = O.edited(t, after)
        a, b, c = map(O.signature, (t, new, after))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), O.as_text(a), O.as_text(b), O.likeness(a, b), O.likeness(a, c)))
    assert got == sorted(want, key=repr)


def test_next_document_over_ranges(spark, monkeypatch):
    rows = [(i * 3 % 101, f"document {i} " * (i % 9)) for i in range(101)] + [(None, "no id"), (None, None), (7, "twin"), (7, "twin"), (100_000, "é😀" * 50)]
    check(spark, rows)
    monkeypatch.setattr(O, "RANGE_ROWS", 7)
    check(spark, rows)
    check(spark, [(1, "alone in here")])
    check(spark, [(5, "first text"), (2, "second text")])
