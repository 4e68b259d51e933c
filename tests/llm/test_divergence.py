"""Source divergence against plain loops over dictionaries."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tessera.llm import divergence
from tessera.llm.divergence import source_divergence
from tessera.llm.text import LETTERS, cut_words

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string"


def expected(docs, least=10, top=10):
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        terms = TERM.findall((text or "").translate(LOW))
        counts[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    out = []
    for lang, seen in documents.items():
        kept = sorted((t for t, n in seen.items() if n >= least), key=str.encode)
        groups = {s: c for (of, s), c in counts.items() if of == lang}
        groups[None] = sum(groups.values(), Counter())
        p = {}
        for s, c in groups.items():
            total = sum(c[t] for t in kept) + 2 * len(kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}
        value = lambda a, b, t: (p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t])  # noqa: B023, E731
        for s in groups:
            if s is not None:
                pairs = sorted((-sum(value(s, o, t) for t in kept), o.encode()) for o in groups if o not in (None, s))
                terms = sorted((-value(s, None, t), t.encode()) for t in kept if groups[s][t] and p[s][t] > p[None][t])[:top]
                out += [(lang, s, part, item.decode(), -v, i) for part, rows in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(rows, 1)]
    return sorted(out)


def corpus(seed, n=300):
    r = random.Random(seed)
    words = ["Alpha", "beta", "été", "ÉTÉ", "naïve", "x", "straße", "日本", "don't", "a1b", "zeta", *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]]
    docs = []
    for i in range(n):
        lang, source = r.choice(["en", "de", None, "few"] if i % 40 == 0 else ["en", "de", None]), r.choice(["s1", "s2", "s10", "ß", "", None])
        own = words if source != "s2" else words[20:]
        text = " ".join(r.choice(own).upper() if r.random() < 0.2 else r.choice(own) for _ in range(r.randrange(0, 40)))
        docs.append((i, text, lang, source))
    return docs


def audited(spark, docs, **options):
    return sorted(tuple(r) for r in source_divergence(spark.createDataFrame(docs, SCHEMA).repartition(4), **options).collect())


@pytest.mark.parametrize("cells", [1 << 18, 60])
def test_equals_plain_loops(spark, cells, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", cells)
    docs = corpus(1)
    got = audited(spark, docs)
    assert got == expected(docs) and {r[2] for r in got} == {"pair", "term"}


def test_odd_texts_and_groups_without_terms(spark):
    docs = corpus(2, 120) + [(900, None, "en", "none"), (901, "", "en", "blank"), (902, "1 2 3 _", None, None), (903, "solo", "alone", "a"), (904, "solo", "alone", "b"), (905, None, "empty", "only")]
    docs += [(906, "Tie tie TIE", "en", "s1")] * 12  # repeated rows are documents of their own
    docs += [(907, ("long word " * 40_000 + "y" * 1_500_000 + " end ") * 2, "en", "s2")]  # parts of a text don't cut words
    assert audited(spark, docs) == expected(docs)
    assert audited(spark, docs, least_documents=2, top=3) == expected(docs, 2, 3)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame(corpus(3, 60), SCHEMA)
    assert source_divergence(df.limit(0)).collect() == []
    more = df.selectExpr("*", "1 as term", "2 as n", "3 as per", "4 as chunk", "5 as value", "6 as rank", "7 as kept")
    assert sorted(tuple(r) for r in source_divergence(more).collect()) == expected(corpus(3, 60))


@pytest.mark.parametrize("flush, dense", [(400_000, 1 << 22), (50, 1 << 22), (400_000, 0), (7, 0)])
def test_counts_are_whole_however_often_they_are_sent(flush, dense, monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH", flush)
    monkeypatch.setattr(divergence, "DENSE", dense)
    monkeypatch.setattr(divergence, "PIECE", 64)
    docs = [(i, t, a or "", b or "") for i, t, a, b in corpus(4)]
    batches = [pa.RecordBatch.from_pylist([{"text": t, "lang": a, "source": b} for _, t, a, b in docs[lo : lo + 37]]) for lo in range(0, len(docs), 37)]
    n, seen = Counter(), Counter()
    for out in divergence.count_terms(iter(batches)):
        for key in zip(out["lang"], out["source"], out["term"].to_pylist(), out["n"].tolist(), out["docs"].tolist(), strict=True):
            n[key[:3]] += key[3]
            seen[key[:3]] += key[4]
    want, docs_of = Counter(), Counter()
    for _, t, a, b in docs:
        terms = Counter(TERM.findall(t.translate(LOW)))
        for term, c in terms.items():
            want[a, b, term] += c
            docs_of[a, b, term] += 1
    assert n == want and seen == docs_of


def test_cut_words_never_cuts_a_word():
    import numpy as np

    data = np.frombuffer(b"ab cde  fghij k" * 9, np.uint8)
    for size in range(1, 20):
        parts = list(cut_words(data, LETTERS, size))
        assert b"".join(data[a:b].tobytes() for a, b in parts) == data.tobytes()
        assert all(not (LETTERS[data[b - 1]] and LETTERS[data[b]]) for _, b in parts[:-1])


def test_shares_are_exact_for_large_counts():
    import numpy as np

    r = random.Random(1)
    for _ in range(500):
        total = r.randrange(2, 8 * 10**15)
        count = r.randrange(0, total - 1)
        assert int(divergence.shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 2) // total
