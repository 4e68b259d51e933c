import hashlib
import random
import re

from tessera.llm.decontam import decontaminate
from tessera.llm.queries import digest_decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items, span=10):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, t in items:
            b = words(t)
            n = min(span, len(b))
            wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    ids.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    r = random.Random(5)
    vocabulary = ["a", "b", "Ünder", "x9", "the", "of", "Straße"]
    say = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", ".", "\n"]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([0, 1, 4, 9, 10, 11, 40, 40, 60])] + [(3, say(12)), (20, None), (21, "a " * 30), (22, "...")]
    docs = [(i, say(r.randrange(0, 80))) for i in range(60)] + [(100, None), (101, ""), (102, "A a " * 500), (103, "--"), (104, items[6][1].upper()), (104, items[6][1].upper())]
    docs += [(200 + i, say(7) + " " + t + " " + say(7)) for i, (_, t) in enumerate(items) if t] + [(300, "zzz " * 3000 + items[8][1] + " yyy" * 3000), (301, "q" * 300_000 + " " + items[7][1])]
    return docs, items


def test_matches_brute_force_in_one_block_and_in_several(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 60):
        got = sorted((tuple(r) for r in digest_decontam(decontaminate(d, b, keep=["doc_id"], block_bytes=size)).collect()), key=str)
        assert got == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    d, b = spark.createDataFrame([(1, "x y", 7)], "doc_id long, text string, n_words int"), spark.createDataFrame([], "item_id long, text string")
    row = decontaminate(d, b).first()
    assert (row.n_words, row.hit_spans, row.hit_items, row.text) == (2, [], [], "x y")
    assert decontaminate(d.limit(0), b).collect() == []


def test_any_column_names_in_several_blocks(spark):
    text = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(1, "x " + text, 7, 8, 9, 10), (2, None, 1, 2, 3, 4)], "doc_id long, text string, hit_spans_0 int, a int, `row` int, s int")
    b = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(4 * i, 4 * i + 12))) for i in range(7)], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate(d, b, block_bytes=50).drop("text").collect())
    assert got == [(1, 7, 8, 9, 10, 41, [(1, 37)], [str(i) for i in range(7)]), (2, 1, 2, 3, 4, 0, [], [])]
