from collections import Counter

import pytest
from test_decontam import brute as brute_hits
from test_jaccard import brute as brute_groups
from test_linededup import brute as brute_lines
from test_packing import check

import corpus_pipeline
from tessera.llm.shared import shared_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """Input and output of each stage, each written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        path = shared_folder(spark)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_names(tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    for df in tables[1:5]:
        assert df.columns == tables[0].columns and df.dtypes == tables[0].dtypes


def test_language_stage_keeps_clean_documents(tables):
    before, after = ({r.doc_id: r for r in t.collect()} for t in tables[:2])
    assert set(after) <= set(before) and len(after) >= 0.98 * len(before)
    assert sum(after[i].lang == before[i].lang for i in after) >= 0.95 * len(after)
    assert all(after[i].text == before[i].text for i in after)


def test_line_stage_matches_brute_force(tables):
    want = {i: t for i, t, _, n in brute_lines([(r.doc_id, r.text) for r in tables[1].collect()]) if not n or t.strip()}
    got = {r.doc_id: r for r in tables[2].collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_duplicate_stage_matches_brute_force(tables):
    groups = brute_groups([(r.doc_id, r.text) for r in tables[2].collect()])
    assert sorted(r.doc_id for r in tables[3].collect()) == sorted(i for i, _, c in groups if i == c)


def test_decontamination_stage_matches_brute_force(spark, tables):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in tables[3].collect()], items)
    assert sorted(r.doc_id for r in tables[4].collect()) == sorted(h[0] for h in hits if not h[-1])


def test_packing_stage_packs_every_token(tables):
    check(tables[5].collect(), [(r.doc_id, r.text) for r in tables[4].collect()], (512, 1024, 2048, 4096))


def test_run_gives_the_last_stage(spark, tables):
    size = lambda df: Counter((r.doc_id, r.piece, r.n_tokens) for r in df.collect())
    assert size(corpus_pipeline.run(spark, SF)) == size(tables[5])


def test_nulls_and_an_empty_table(spark, tables):
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (None, "the of and to in " * 9, None, None, None), (2, "", "en", "s", 0)], tables[0].schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() <= 1


def test_repeated_rows_clashing_columns_and_long_texts(spark):
    """Each stage by itself: repeated rows stay or go together, other columns are left out, long texts are read whole."""
    long = "\n".join(f"the of and to in {i} was that it for on are with as" for i in range(20_000))
    rows = [(1, long, "en", "s", len(long)), (1, long, "en", "s", len(long)), (2, long + "\nx", "en", "s", len(long) + 2), (3, "the of and to in\nwas that it\nfor on are", "en", "s", 9)]
    odd = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, key int, __key int, component_id int, hit_items int")
    kept = [[1, 1, 2, 3], [1, 1, 2, 3], [1, 1, 3], [1, 1, 2, 3]]  # of 2 its last line stays, and then the text as a whole is a near copy of 1
    for (_, stage), want in zip(corpus_pipeline.STAGES[:4], kept, strict=True):
        got = stage(spark, odd, SF)
        assert got.columns == corpus_pipeline.COLUMNS and sorted(r.doc_id for r in got.select("doc_id").collect()) == want
    packed = corpus_pipeline.STAGES[4][1](spark, odd, SF)
    assert sorted((r.doc_id, r.n) for r in packed.groupBy("doc_id").sum("n_tokens").toDF("doc_id", "n").collect()) == [(1, 2 * len(long.split())), (2, len(long.split()) + 1), (3, 11)]


def test_rows_that_repeat_an_id_with_another_text(spark):
    """Each stage judges a row by its own text, against brute force."""
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    one, two = "the of and to in was that it for on are with as be this", "on with for it that was in to and of the so far away then"
    lines = "\n".join(["the of and", "to in was", "that it for", "on are with"])
    rows = [(1, one), (5, one), (5, two), (7, lines), (8, lines + "\nthis is the last"), (8, "only this and that"), (9, f"the of and {items[0][1]} to in"), (9, "clean text of the day and of the night"), (None, one)]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = lambda k, where="true": sorted(((r.doc_id, r.text) for r in corpus_pipeline.STAGES[k][1](spark, odd.where(where), SF).collect()), key=str)
    assert found(0) == sorted(rows, key=str)
    kept = [(i, t) for i, t, _, n in brute_lines([x for x in rows if x[0] is not None]) if not n or t.strip()]
    assert found(1, "doc_id is not null") == sorted(kept, key=str)
    # brute_groups gives no texts: an id's rows come in order
    texts, groups = sorted(rows, key=str), brute_groups(rows)
    assert {c for i, _, c in groups if i == 5} == {1, 5}
    near = {(i, t): c for i, t in texts for j, _, c in brute_groups([*[x for x in rows if x[0] != i], (i, t)]) if j == i}
    assert [x for x in texts if x[0] is None or near[x] == x[0]] == found(2)
    assert (5, two) in found(2) and (5, one) not in found(2)
    clean = [(h[0], t) for t, h in ((t, brute_hits([(i, t)], items)[0]) for i, t in rows) if not h[-1]]
    assert found(3) == sorted(clean, key=str)
    packed = corpus_pipeline.STAGES[4][1](spark, odd, SF).groupBy("doc_id").sum("n_tokens").collect()
    size = Counter()
    for i, t in rows:
        size[i] += len(t.split())
    assert {r[0]: r[1] for r in packed} == size
