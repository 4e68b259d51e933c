"""Subtitles: files, alignment, substitution and reconciliation, each against plain loops."""

import random
import string

import pytest
from pyspark.sql import functions as F

from tessera.operators import subtitles as st
from tessera.operators import diff
from tessera.operators.diff import edit_script, sequence_diff
from tessera.sources.subtitles import read_subtitles, subtitle_block, write_subtitles

CUES = "job_id long, cue_index int, start long, end long, text string"
WORDS = "job_id long, word_index int, word string, start long, end long, score int"


def test_files_are_read_back(spark, tmp_path):
    rows = [(1, 2, 5_000, 7_001, "two\nlines"), (1, 1, 0, 1, "first, é"), (2, 1, 359_999_999, 400_000_000, ""), (2, 2, 400_000_000, 400_000_000, "a\n\nblank  \n \nline inside")]
    df = spark.createDataFrame(rows, CUES)
    write_subtitles(df.select("job_id", "cue_index", subtitle_block(F.col("cue_index"), F.col("start"), F.col("end"), F.col("text")).alias("block")), f"{tmp_path}/s", "job_id", ["cue_index"])
    got = read_subtitles(spark, f"{tmp_path}/s")
    assert sorted(tuple(r) for r in got.select("job_id", "cue_index", "start", "end", "text").collect()) == [(1, 1, 0, 1, "first, é"), (1, 2, 5_000, 7_001, "two\nlines"), (2, 1, 359_999_999, 400_000_000, ""), (2, 2, 400_000_000, 400_000_000, "a\nblank  \nline inside")]
    assert got.where("error is not null").isEmpty() and got.select("file").distinct().count() == 2


def test_odd_files(spark, tmp_path):
    (tmp_path / "crlf.srt").write_bytes("﻿1\r\n00:00:01,5 --> 00:00:02.25  X1:1 Y1:2\r\nhello\r\nthere\r\n\r\n\r\n2\r\n0:00:03 --> 00:00:04,000\r\nno hundreds\r\n".encode())
    (tmp_path / "bad.srt").write_text("\n\n\nno times\nat all\n\n00:00:05,000 --> 00:00:06,000\nno number\n\nseven\n00:00:07,000 --> 00:00:08,000\nwords for a number\n\n8\n00:00:09,000 --> 00:00:08,999\nbackwards\n\n9\n99999999999999999999:00:00,000 --> 00:00:08,999\nhuge\n \t\n10\n00:00:10,000 --> 00:00:11,000\nlast")
    (tmp_path / "empty.srt").write_text("")
    (tmp_path / "blank.srt").write_text("\n \n\n")
    rows = {r.raw or r.text: r for r in read_subtitles(spark, str(tmp_path)).collect()}
    good = {t: (r.cue_index, r.start, r.end, r.position) for t, r in rows.items() if r.error is None}
    assert good == {"hello\nthere": (1, 1500, 2250, "X1:1 Y1:2"), "no hundreds": (2, 3000, 4000, None), "no number": (None, 5000, 6000, None), "last": (10, 10_000, 11_000, None)}
    assert sorted(r.error for r in rows.values() if r.error) == ["ends before it starts", "no line of times", "no number", "times out of range"]
    assert all((r.text is None) == (r.raw is not None) for r in rows.values())


def test_large_files_are_split_between_blocks(spark, tmp_path):
    (tmp_path / "a.srt").write_text("\n\n".join(f"{i}\n00:00:{i % 60:02d},000 --> 00:01:00,000\ntext {i} {'x' * (i % 50)}" for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = read_subtitles(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 5
        rows = got.orderBy("split_start", "at").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.cue_index for r in rows] == list(range(1, 3001)) and all(r.error is None for r in rows)


@pytest.mark.parametrize("size", [1000, 1009, 1013, 1021])
def test_files_may_be_split_anywhere(spark, tmp_path, size):
    """Behind each line feed too, and within the three that follow an empty text."""
    (tmp_path / "a.srt").write_text("\n\n".join(f"{i}\n00:00:01,000 --> 00:01:00,000\n{'' if i % 4 == 0 else 'a' * (i % 3)}" for i in range(1, 1501)))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_subtitles(spark, str(tmp_path)).orderBy("split_start", "at").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert [(r.cue_index, r.error) for r in rows] == [(i, None) for i in range(1, 1501)]
    assert len({r.split_start for r in rows}) > 40


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def normal(word):
    return word.strip(string.punctuation).lower()


def ratio(a, b):
    n = max(len(a), len(b))
    return 100 * (n - distance(a, b)) // n if n else None


def conversation(r, jobs=6, n=40):
    words, cues = [], []
    for job in range(jobs):
        text = [r.choice(["the", "The", "in", "in", "rain,", "spain", "\"falls\"", "mainly", "étude", "plain.", "—", "x"]) for _ in range(n)]
        words += [(job, i, w, None if r.random() < 0.1 else i * 400, i * 400 + 300, r.choice([None, 20, 90, 99])) for i, w in enumerate(text)]
        words = [(j, i, w, s, None if s is None else e, c) for j, i, w, s, e, c in words]
        for k in range(0, n, 5):
            own = [w + r.choice(["", "", "!"]) if r.random() < 0.8 else w[:-1] + "y" for w in text[k : k + 5] if r.random() < 0.9]
            cues.append((job, k, k * 400 - r.randrange(0, 300), k * 400 + 2000 + r.randrange(-200, 600), r.choice(["", "  "]) + r.choice([" ", "  ", "\n"]).join(own)))
    return words, cues


@pytest.mark.parametrize("strategy", st.STRATEGIES)
def test_alignment_equals_a_plain_loop(spark, strategy):
    words, cues = conversation(random.Random(1))
    want = []
    for job, i, w, s, e, score in words:
        best = None
        for cue in cues if s is not None else []:
            if cue[0] == job and cue[2] <= s and e <= cue[3]:
                scores = [x for x in (ratio(normal(w), normal(t)) for t in cue[4].split()) if x is not None and x >= 85]
                if scores:
                    best = min(best or (0,), (-max(scores), cue[2], cue[1], cue[3]))
        wins = best is not None and (strategy == "srt_primary" or strategy == "highest_confidence" and -best[0] > (score or 0))
        want.append((job, i, best[1] if wins else s, best[3] if wins else e, "subtitle" if wins else "transcript", best and best[2], best and -best[0]))
    got = st.align(spark.createDataFrame(words, WORDS), spark.createDataFrame(cues, CUES), strategy=strategy, text="word", width=3000)
    assert sorted(map(tuple, got.select("job_id", "word_index", "start", "end", "timing", "cue_index", "fuzzy").collect()), key=str) == sorted(want, key=str)
    assert sum(x[5] is not None for x in want) > 50


def test_phrases_align_with_runs_of_words(spark):
    spans = spark.createDataFrame([(1, 0, "In the, rain", 100, 900, None), (1, 3, "gone away", 100, 900, 5), (1, 4, "...", 100, 900, 5)], "job_id long, word_index int, matched_text string, start long, end long, score int")
    cues = spark.createDataFrame([(1, 7, 0, 1000, "singing «in the rian» now"), (1, 8, 0, 2000, "in the rain in the rain"), (1, 9, 200, 2000, "in the rain")], CUES)
    got = {r.word_index: (r.start, r.end, r.cue_index, r.fuzzy) for r in st.align(spans, cues, strategy="srt_primary", threshold=80).collect()}
    assert got == {0: (0, 2000, 8, 100), 3: (100, 900, None, None), 4: (100, 900, None, None)}
    with pytest.raises(ValueError):
        st.align(spans, cues, strategy="other")


def censor(words, cues, matches, style, other):
    """A loop over cues: which of their words are flagged, in runs of each match; then from right to left."""
    out = []
    for job, index, start, end, text in cues:
        spots, at = [], 0
        for raw in text.split():
            at = text.index(raw, at)
            token = raw.strip(string.punctuation)
            lead = len(raw) - len(raw.lstrip(string.punctuation))
            spots.append((token.lower(), at + lead, at + lead + len(token)))
            at += len(raw)
        heard, seen = {}, {}
        for j, i, w, s, _, _ in words:
            if j == job and s is not None and (start <= s < end or start == end == s):
                n = seen[normal(w)] = seen.get(normal(w), 0) + 1
                places = [k for k, x in enumerate(spots) if x[0] == normal(w) and x[0]]
                if n <= len(places):
                    heard[i] = places[n - 1]
        ranges = []
        for j, first, span, entry, line in matches:
            if j == job:
                places = sorted({heard[i] for i in range(first, first + span) if i in heard})
                runs = []
                for p in places:
                    if runs and runs[-1][-1] == p - 1 and not (style == "stars" and entry not in other):
                        runs[-1].append(p)
                    else:
                        runs.append([p])
                for run in runs:
                    a, b = spots[run[0]][1], spots[run[-1]][2]
                    put = other.get(entry) or ("[censored]" if style == "tag" else text[a] + "*" * (b - a - 1))
                    ranges.append((a, -b, line, put))
        merged = []
        for a, minus, _, put in sorted(ranges):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], -minus)
            else:
                merged.append([a, -minus, put])
        for a, b, put in reversed(merged):
            text = text[:a] + put + text[b:]
        out.append((job, index, text, len(merged)))
    return sorted(out)


@pytest.mark.parametrize("style", ["tag", "stars"])
def test_substitution_equals_a_plain_loop(spark, style):
    words, cues = conversation(random.Random(2), jobs=8)
    matches = []
    by = {(j, i): (normal(w), s) for j, i, w, s, _, _ in words}
    for (j, i), (w, s) in by.items():
        if s is not None:
            if w in ("the", "falls", "étude"):
                matches.append((j, i, 1, w, 1))
            if w == "in" and by.get((j, i + 1), ("", None))[0] == "the" and by[j, i + 1][1] is not None:
                matches.append((j, i, 2, "in the", 2))
            if w == "in" and i % 4 == 0 and by.get((j, i + 2), ("", None))[1] is not None:
                matches.append((j, i, 3, "three", 3))
    other = {"falls": "drops $1 \\", "three": "<3>"}
    got = st.substitute(spark.createDataFrame(cues, CUES), spark.createDataFrame(words, WORDS), spark.createDataFrame(matches, "job_id long, word_index int, span int, entry string, line_no int"), style=style, substitutions=spark.createDataFrame(list(other.items()), "entry string, replacement string"), width=3000)
    want = censor(words, cues, matches, style, other)
    assert sorted(map(tuple, got.select("job_id", "cue_index", "text", "n_replaced").collect())) == want
    assert sum(x[3] for x in want) > 40


def test_a_phrase_over_two_cues_and_odd_cues(spark):
    words = spark.createDataFrame([(1, 0, "kiss", 900, 1000, 9), (1, 1, "goodbye", 1000, 1400, 9), (1, 2, "now", 1500, 1600, 9)], WORDS)
    cues = spark.createDataFrame([(1, 1, 0, 1000, "(Kiss..."), (1, 2, 1000, 2000, "...goodbye), now"), (1, 3, 0, 2000, None), (1, 4, 0, 2000, ""), (2, 1, 0, 2000, "kiss goodbye"), (1, 5, None, None, "kiss")], CUES)
    matches = spark.createDataFrame([(1, 0, 2, "kiss goodbye", 1)], "job_id long, word_index int, span int, entry string, line_no int")
    rows = {(r.job_id, r.cue_index): (r.text, r.n_replaced) for r in st.substitute(cues, words, matches).collect()}
    assert rows == {(1, 1): ("([censored]...", 1), (1, 2): ("...[censored]), now", 1), (1, 3): (None, 0), (1, 4): ("", 0), (2, 1): ("kiss goodbye", 0), (1, 5): ("kiss", 0)}
    assert {r.cue_index: r.text for r in st.substitute(cues.where("job_id = 1 and cue_index < 3"), words, matches, style="stars").collect()} == {1: "(K***...", 2: "...g******), now"}
    assert st.substitute(cues.limit(0), words, matches).collect() == []


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def applied(script, a, b):
    """b, made from a by a script; fails where it isn't one."""
    out, i, j = [], 0, 0
    for op, x, y, z, w in script:
        assert (x, z) == (i, j) and (op == "equal") <= (a[x:y] == b[z:w])
        assert op == ("equal" if op == "equal" else "replace" if y > x and w > z else "delete" if y > x else "insert")
        out += a[x:y] if op == "equal" else b[z:w]
        i, j = y, w
    assert (i, j) == (len(a), len(b))
    return out


def cost(script):
    return sum(y - x + w - z for op, x, y, z, w in script if op != "equal")


def edited(r, words, rate, letters):
    out = []
    for w in words:
        x = r.random()
        out += [] if x < rate else [w, r.choice(letters)] if x < 2 * rate else [r.choice(letters)] if x < 3 * rate else [w]
    return out


def test_scripts_cost_what_dynamic_programming_says():
    r = random.Random(4)
    for n in range(400):
        letters = "abcdefghij"[: r.randrange(1, 11)]
        a = [r.choice(letters) for _ in range(r.randrange(0, 60))]
        b = [r.choice(letters) for _ in range(r.randrange(0, 60))] if n % 2 else edited(r, a, r.random() * 0.3, letters)
        script = edit_script(a, b)
        assert applied(script, a, b) == b and cost(script) == len(a) + len(b) - 2 * common(a, b)


def test_long_sequences_take_little_memory_and_time():
    import time
    import tracemalloc

    r = random.Random(5)
    a = [f"w{r.randrange(3000)}" for _ in range(20_000)]
    b = edited(r, a, 0.05, ["x", "y", "z"])
    tracemalloc.start()
    begun = time.process_time()
    script = edit_script(a, b)
    assert time.process_time() - begun < 20 and tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert applied(script, a, b) == b


@pytest.mark.parametrize("longest", [50_000, 40, 100])
def test_jobs_of_any_length(spark, longest):
    """With small bounds most jobs are cut at anchors, and cost no more."""
    r, sides = random.Random(6), {}
    for job in range(12):
        a = [f"w{r.randrange(500)}" for _ in range(r.choice([0, 1, 30, 150, 400]))]
        sides[job] = (a, edited(r, a, r.choice([0, 0.02, 0.1]), ["x", "y"]))
    sides[20] = ([f"u{i}" for i in range(300)], [])
    sides[21] = ([], ["only", "b"])
    sides[22] = (["same"] * 200, ["same"] * 210)
    sides[23] = ([f"m{i}" for i in range(200)], [f"m{i}" for i in range(100, 200)] + [f"m{i}" for i in range(100)])  # halves that change places
    frames = [spark.createDataFrame([(j, i, w) for j, pair in sides.items() for i, w in enumerate(pair[k])], "job_id long, at int, token string") for k in (0, 1)]
    rows = {}
    for x in sequence_diff(*frames, longest=longest, anchor=3).collect():
        rows.setdefault(x.job_id, []).append((x.op, x.a_start, x.a_end, x.b_start, x.b_end))
    for job, (a, b) in sides.items():
        script = sorted(rows.get(job, []), key=lambda s: s[1:])
        assert applied(script, a, b) == b and cost(script) == len(a) + len(b) - 2 * common(a, b), job
    assert longest > 400 or len(rows[0]) + len(rows[1]) >= 2


def test_reconciliation(spark):
    words = [(1, i, w, i * 100, i * 100 + 50, c) for i, (w, c) in enumerate([("We", 90), ("are", 90), ("leaving", 90), ("now,", 90), ("quite", 20), ("soon", 30), ("I", 10), ("think", 95), ("so", 95)])]
    cues = [(1, 1, 0, 400, "We are leaving now"), (1, 2, 400, 600, "Very late"), (1, 3, 600, 900, "I drink so"), (1, 4, 900, 950, ""), (2, 1, 0, 10, "nothing said")]
    w, c = spark.createDataFrame(words, WORDS), spark.createDataFrame(cues, CUES)
    rows = lambda mode, **o: {(r.job_id, r.cue_index): (r.action, r.text, r.n_differ, r.percent) for r in st.reconcile(c, w, mode=mode, **o).collect()}
    assert rows("report") == {(1, 1): ("keep", "We are leaving now", 0, 0), (1, 2): ("flag", "Very late", 2, 100), (1, 3): ("flag", "I drink so", 1, 33), (1, 4): ("keep", "", 0, 0), (2, 1): ("flag", "nothing said", 2, 100)}
    assert rows("auto", confidence=60)[1, 2][:2] == ("keep", "Very late") and rows("auto", confidence=60)[1, 3][:2] == ("replace", "I think so")
    hybrid = rows("hybrid", confidence=60)
    assert hybrid[1, 2][:2] == ("flag", "Very late") and hybrid[1, 3][:2] == ("replace", "I think so") and hybrid[2, 1][0] == "flag"
    assert rows("auto", confidence=0)[1, 2][:2] == ("replace", "quite soon") and rows("report", divergence=50)[1, 3][0] == "keep"
    with pytest.raises(ValueError):
        st.reconcile(c, w, mode="other")


def test_words_that_a_cue_has_need_no_edits(spark, monkeypatch):
    rows = spark.createDataFrame([(["the"], ["them", "the"]), (["in", "the"], ["x", "in", "the"]), (["quite"], ["the", "of"]), ([], ["a"]), (["a"], [])], "want array<string>, own array<string>")
    monkeypatch.setattr(st, "similarity", lambda a, b, least: F.raise_error(F.lit("edits counted")).cast("int"))
    got = rows.select(st.fuzzy_score(F.col("want"), F.col("own"), 85)).collect()
    assert [r[0] for r in got] == [100, 100, None, None, None]


@pytest.mark.parametrize("held", [1 << 24, 40])
def test_scripts_are_minimal_whether_tables_are_held_or_not(monkeypatch, held):
    monkeypatch.setattr(diff, "HELD", held)
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(30))] for _ in range(2))
        same = [(a[x:y], b[z:w]) for op, x, y, z, w in edit_script(a, b) if op == "equal"]
        assert all(x == y for x, y in same) and sum(len(x) for x, _ in same) == diff.common_lengths(a, b)[-1]


def test_small_sides_are_gone_through_once(monkeypatch):
    monkeypatch.setattr(diff, "common_lengths", None)
    assert edit_script(list("abcabba"), list("cbabac"))


@pytest.mark.parametrize("longest", [50_000, 30])
def test_scripts_are_minimal_however_long_jobs_are(spark, longest):
    """Runs that occur once on each side need not be in a minimal script, so long jobs can't be cut there."""
    once, r = ["u1", "u2", "u3"], random.Random(8)
    sides = {1: (["s"] * 5 + once + ["s"] * 60, ["s"] * 60 + once + ["s"] * 5), 2: ([r.choice("abc") for _ in range(100)], [r.choice("abc") for _ in range(70)]), 3: (["x"] * 61, ["y", "x"])}
    frames = [spark.createDataFrame([(f"j{j}", i, w) for j, pair in sides.items() for i, w in enumerate(pair[k])], "job_id string, at int, token string") for k in (0, 1)]
    rows = [tuple(x) for x in sequence_diff(*frames, longest=longest, anchor=3).collect()]
    for job, (a, b) in sides.items():
        script = sorted((x[1:] for x in rows if x[0] == f"j{job}"), key=lambda s: s[1:])
        same = [(a[x:y], b[z:w]) for op, x, y, z, w in script if op == "equal"]
        assert all(x == y for x, y in same) and applied(script, a, b) == b
        assert cost(script) == len(a) + len(b) - 2 * common(a, b), job
        assert not any(x[0] == y[0] == "equal" for x, y in zip(script, script[1:], strict=False))
