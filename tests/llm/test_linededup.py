import random

from tessera.llm.linededup import drop_repeated_lines


def brute(docs):
    seen, out = set(), []
    for i, t in sorted(docs, key=lambda d: d[0]):
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not "".join(w).strip():
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone)))
    return out


def test_matches_brute_force(spark):
    r = random.Random(1)
    docs = [(i, "\n".join(r.choice(["a", "b", "", "c c", "ü", " "]) for _ in range(r.randrange(0, 14)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "\n\n\n\n"), (503, "x\ny\nz\n" * 3000), (504, "\r\n".join("pqrst"))]
    got = drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=str) == sorted(brute(docs), key=str)


def test_shuffled_join_gives_the_same(spark):
    docs = [(i, "a\nb\nc\nd" if i % 3 else f"{i}\nb\nc\nd") for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = drop_repeated_lines(df), drop_repeated_lines(df, broadcast_bytes=-1)
    assert sorted(a.collect()) == sorted(b.collect())


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    docs = [(1, "a\nb\nc", 5), (1, "a\nb\nc", 5), (None, "a\nb\nc", 5), (2, "q\na\nb\nc", 5)]
    got = sorted(((r.doc_id, r.text, r.n_lines) for r in drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string, n_lines int")).collect()), key=str)
    assert got == sorted([(1, "a\nb\nc", 3), (1, "a\nb\nc", 3), (2, "q", 4), (None, "", 3)], key=str)
    assert drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_any_column_names_and_text_ids(spark):
    docs = [("a", "x\ny\nz", 1, 2, 3, 4), ("b", "x\ny\nz\nw", 5, 6, 7, 8)]
    df = spark.createDataFrame(docs, "doc_id string, text string, at int, key int, `gone` int, `lines` int")
    got = sorted(tuple(r) for r in drop_repeated_lines(df).collect())
    assert got == [("a", "x\ny\nz", 1, 2, 3, 4, 3, 0, []), ("b", "w", 5, 6, 7, 8, 4, 3, [0, 1, 2])]
