"""Near duplicates by sketches against all pairs, and the sketches' own properties."""

import random
import re

import numpy as np
import pytest

from tessera.llm import jaccard, minhash
from tessera.llm.minhash import EMPTY, bands_for, near_duplicates_by_sketch, sketches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def shingles(t, k=2):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, percent=80):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    own = [ids.get(find(i)) if s else d for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]
    return sorted(((d, len(s), c, None if d is None or c is None else d == c) for (d, _), s, c in zip(docs, sets, own, strict=True)), key=str)


def edit(r, words, rate):
    return [r.choice("pqrs") + str(r.randrange(99)) if r.random() < rate else w for w in words]


def cases(seed, groups=30):
    r, docs = random.Random(seed), []
    passage = [f"s{i}" for i in range(40)]
    for _ in range(groups):
        base = [r.choice("abcdefgh") + str(r.randrange(30)) for _ in range(r.randrange(1, 150))]
        for _ in range(r.randrange(1, 9)):
            w = edit(r, base, r.choice([0, 0.01, 0.03, 0.06, 0.1]))
            w = w + passage if r.random() < 0.4 else w[: len(w) - r.randrange(0, 5)] or w
            docs.append(" ".join(x.upper() if r.random() < 0.1 else x for x in w))
    r.shuffle(docs)
    return list(enumerate(docs))


def found(spark, docs, parts=5, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r) for r in near_duplicates_by_sketch(df, **options).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", (1 << 20, 4000)[seed - 1])
    monkeypatch.setattr(jaccard, "FEW", (200_000, 0)[seed - 1])
    docs = cases(seed)
    assert found(spark, docs) == brute(docs)


def test_large_group_of_which_many_are_not_quite_similar(spark, monkeypatch):
    """Their keys hold several components, so they meet in blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 30_000)
    met, blocks = [], minhash.hot_links
    monkeypatch.setattr(minhash, "hot_links", lambda *a: (met.append(a[3].count()), blocks(*a))[1])
    r = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    docs = [(i, " ".join(edit(r, base, r.choice([0.02, 0.06, 0.09])))) for i in range(250)]
    want = brute(docs)
    assert found(spark, docs) == want and met and met[0] > 20
    assert 2 < len({c for _, _, c, _ in want}) < 200


@pytest.mark.parametrize("size", [100, 200])
def test_sets_of_a_large_group_are_sent_once_and_not_for_each_key(spark, monkeypatch, size):
    """Near copies share most of their keys, so what is sent for each key grows faster than the group."""
    sent, rows = [], jaccard.map_rows
    monkeypatch.setattr(jaccard, "map_rows", lambda df, *a: (sent.append(df.count() if "own" in df.columns else 0), rows(df, *a))[1])
    r = random.Random(4)
    base = [f"w{i}" for i in range(90)]
    docs = [(i, " ".join(edit(r, base, r.choice([0.02, 0.06, 0.09])))) for i in range(size)]
    assert found(spark, docs) == brute(docs)
    assert 0 < sum(sent) <= 6 * size


def test_lists_are_merged_only_if_that_compares_no_more_pairs(spark):
    node = lambda x: x.to_bytes(16, "big")
    # one list of a component and others, twice; and a component whose nodes each are in a list with another one
    member = [(tok, node(i), node(1 if i < 6 else i), 10) for tok in (1, 2) for i in range(1, 9)]
    member += [(tok, node(i), node(r), n) for tok in range(10, 15) for i, r, n in ((tok * 10, 100, 20), (tok * 10 + 1, tok, 10))]
    got = [(bytes(u), bytes(m), bytes(x)) for u, m, x, _, _ in jaccard.units(spark.createDataFrame(member, "tok long, node binary, root binary, n long")).collect()]
    want = [(node(1), node(1), node(i)) for i in range(1, 9)]
    want += [(tok.to_bytes(8, "big").lstrip(b"\0"), node(100), node(tok * 10 + k)) for tok in range(10, 15) for k in (0, 1)]
    assert sorted(got) == sorted(want)


def test_odd_texts_and_repeated_rows(spark):
    docs = [(i, "same old text of six words") for i in range(1000, 1150)]
    docs += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "ONE"), (505, "one two"), (None, "one two"), (None, "alone here"), (506, "a " * 5000), (507, "A " * 4000), (508, "x" * 200_000 + " b c d e"), (509, "X" * 200_000 + " b c d e"), (3, "another text with the same id"), (3, "another text with the same id"), (3, "same id but not at all the same words")]
    assert found(spark, docs, 7) == brute(docs)


@pytest.mark.parametrize("size", [1024, 2048, 4096, 100_000])
def test_long_words_made_to_collide_are_different(spark, size):
    """Thue-Morse words and their complements have equal polynomial hashes modulo powers of two."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
    docs = [(1, one), (2, one.translate({97: 98, 98: 97})), (3, one.upper())]
    assert found(spark, docs, 1) == brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.near_duplicates(df).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_empty_table_extra_columns_and_ids_of_text(spark):
    df = spark.createDataFrame([("1", "a b c", 3), ("2", "a b c", 4), ("x", "q r", 5)], "doc_id string, text string, node int").selectExpr("*", "1 as bands", "2 as root", "3 as kept")
    assert sorted((tuple(r) for r in near_duplicates_by_sketch(df).collect()), key=str) == [(1, 2, 1, True), (2, 2, 1, False), (None, 1, None, None)]
    assert near_duplicates_by_sketch(df.limit(0)).collect() == []


def plain_sketch(tokens, t, seed=7):
    """A round at a time, a shingle at a time."""
    mix = lambda x: int(minhash.mix(np.array([x], np.uint64))[0])
    out = [None] * t
    for i in range(2 * t):
        key = mix(((i + 1) * 0x9E3779B97F4A7C15 + seed) % 2**64)
        for x in tokens:
            h = mix(x ^ key)
            j = (h >> 32) * t >> 32 if i < t else i - t
            value = i << 32 | h & (2**32 - 1)
            out[j] = value if out[j] is None else min(out[j], value)
        if None not in out:
            break
    return out


@pytest.mark.parametrize("thrown", [1 << 16, 1, 50])
def test_sketches_equal_a_plain_loop(thrown, monkeypatch):
    monkeypatch.setattr(minhash, "THROWN", thrown)
    r = np.random.default_rng(2)
    sets = [r.integers(0, 2**64, n, dtype=np.uint64) for n in (1, 0, 2, 9, 40, 200)]
    got = sketches(sets, 24)
    assert (got[1] == EMPTY).all()
    for i in (0, 2, 3, 4, 5):
        assert got[i].tolist() == plain_sketch(sets[i].tolist(), 24)


def test_agreement_is_concentrated_around_similarity():
    r = np.random.default_rng(5)
    off = []
    for n in (3, 20, 150, 1000):
        for _ in range(30):
            shared = r.integers(0, 2**64, max(1, int(0.89 * n)), dtype=np.uint64)
            a, b = (np.concatenate((shared, r.integers(0, 2**64, n - len(shared), dtype=np.uint64))) for _ in range(2))
            got = sketches([a, b], 366)
            off.append((got[0] == got[1]).mean() - len(shared) / (2 * n - len(shared)))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.03


def test_number_of_bands():
    for percent, rows, miss in ((80, 6, 1e-8), (75, 4, 1e-6), (90, 8, 1e-9)):
        n, p = bands_for(percent, rows, miss), (percent / 100) ** rows
        assert (1 - p) ** n <= miss < (1 - p) ** (n - 1)
