"""Operators against plain restatements of their rules, and their edge cases."""

import json
import random
import string

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import config
from tessera.functions import text as tx
from tessera.operators import audio, jobs
from tessera.operators import flag as fl
from tessera.operators import resolve as rs
from tessera.operators import review as rv
from tessera.operators import segments as sg
from tessera.plans import QUERIES, transcript
from tessera.sources import readers, writers
from tessera.sources.tables import saved, spread
from tessera.streaming.progress import session_intervals

WORDS = "job_id long, word_index int, word string, start int, end int, score int"


def plain_matches(words, rules):
    """One job's matches by a loop over its words."""
    toks = [w[2].strip(string.punctuation) for w in words]
    timed = [w[3] is not None and w[4] is not None and bool(t) for w, t in zip(words, toks, strict=True)]
    out = []
    for i, w in enumerate(words):
        best = None
        for r in rules:
            if len(r.tokens) == 1 and timed[i]:
                t, root = (toks[i], r.tokens[0]) if r.case_sensitive else (toks[i].lower(), r.tokens[0].lower())
                hit = {"exact": t == root, "startswith": t.startswith(root), "contains": root in t}[r.match_type]
                if hit and (best is None or (r.rank, r.line_no) < (best.rank, best.line_no)):
                    best = r
        if best:
            out.append((i, 1, w[2], best.raw, w[3], w[4], w[5] or 0))
        for r in rules:
            n = len(r.tokens)
            if n > 1 and i + n <= len(words) and all(timed[i : i + n]):
                same = [a == b if r.case_sensitive else a.lower() == b.lower() for a, b in zip(toks[i : i + n], r.tokens, strict=True)]
                if all(same):
                    out.append((i, n, " ".join(x[2] for x in words[i : i + n]), r.raw, w[3], words[i + n - 1][4], min(x[5] or 0 for x in words[i : i + n])))
    return out


def parsed(spark, lines):
    return fl.rules(fl.parse_lexicon(spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string")))


def test_matches_agree_with_a_loop(spark):
    r = random.Random(3)
    rules = parsed(spark, ["The", "=of", "cl*", "*io*", "of the", "=Of the", "the of the", "of the", "THE", "don't", "=*Ti*"])
    vocabulary = ["the", "The", "of", "Of", "don't,", "--", "clown!", "nation", "tion", "Tip", "x"]
    rows = []
    for job in range(6):
        for i in range(80):
            a = r.random()
            rows.append((job, i, r.choice(vocabulary), None if a < 0.08 else i * 400, None if a < 0.04 or a > 0.97 else i * 400 + 300, None if r.random() < 0.1 else r.randrange(100)))
    got = fl.flag(spark.createDataFrame(rows, WORDS).repartition(3), rules).orderBy("job_id", "match_rank").collect()
    for job in range(6):
        own = [(m.word_index, m.span, m.matched_text, m.entry, m.start, m.end, m.score) for m in got if m.job_id == job]
        assert own == plain_matches([w for w in rows if w[0] == job], rules)


def test_large_lexicon_uses_the_dictionary(spark):
    rules = [fl.Rule(f"w{i}", (f"w{i}",), "exact", False, i) for i in range(300)] + [fl.Rule("w1*", ("w1",), "startswith", False, 400)]
    rows = [(1, i, f"W{i}.", i, i, 1) for i in range(0, 400, 7)]
    got = {m.word_index: m.line_no for m in fl.single_matches(spark.createDataFrame(rows, WORDS), rules).collect()}
    assert got == {i: i for i in range(0, 300, 7)}
    assert fl.single_matches(spark.createDataFrame(rows, WORDS), []).count() == 0


def test_lexicon_notation(spark):
    df = fl.parse_lexicon(spark.createDataFrame(list(enumerate(["  =Foo  ", "= *foo*", "* *", "a\tb *", "#x", "", "**"], 1)), "line_no int, line string"))
    got = {r.line_no: (r.tokens, r.match_type, r.case_sensitive, r.status) for r in df.collect()}
    assert got == {1: (["Foo"], "exact", True, "ok"), 2: (["*foo"], "startswith", True, "ok"), 3: ([], "contains", False, "empty"), 4: (["a", "b"], "exact", False, "phrase"), 7: ([], "contains", False, "empty")}


def test_intervals_agree_with_a_loop(spark):
    r = random.Random(1)
    rows = [(k, s := r.randrange(300), s + r.randrange(12)) for k in range(5) for _ in range(40)] + [(9, 1, 5), (9, 5, 7), (9, 2, 3), (9, None, 4)]
    got = sorted((x.k, x.start, x.end) for x in rs.merge_intervals(spark.createDataFrame(rows, "k int, start int, end int"), ["k"]).collect())
    want = []
    for k in sorted({x[0] for x in rows}):
        own = []
        for _, s, e in sorted(x for x in rows if x[0] == k and x[1] is not None):
            if own and s <= own[-1][1]:
                own[-1][1] = max(own[-1][1], e)
            else:
                own.append([s, e])
        want += [(k, s, e) for s, e in own]
    assert got == want


def test_overrides_and_statistics(spark):
    m = spark.createDataFrame([(1, 0, 1, "a", "a", 1, 20, 300, 90, 1), (1, 0, 2, "a b", "a b", 2, 20, 700, 80, 2), (1, 4, 1, "c", "c", 3, 1600, 1900, 5, 3)], "job_id long, word_index int, span int, matched_text string, entry string, line_no int, start int, end int, score int, match_rank int")
    none = spark.createDataFrame([], "job_id long, action string, word_index int, text string, start int, end int")
    o = rs.apply_corrections(none, m, spark.createDataFrame([(1, 0), (1, 0), (1, 77)], "job_id long, word_index int"), spark.createDataFrame([(1, "x", 5, 9)], "job_id long, text string, start int, end int"))
    assert sorted(((r.word_index, r.text) for r in o.where("action = 'skip'").collect())) == [(0, "a b"), (77, None)]
    log = rs.redaction_log(m, o, 50).orderBy("log_rank").collect()
    assert [(r.source, r.padded_start, r.padded_end) for r in log] == [("review_add", 0, 59), ("matched", 1550, 1950)]
    assert rs.redaction_log(m, none, 50).count() == 3
    merged = rs.merge_intervals(rs.redaction_log(m, o, 50).select("job_id", F.col("padded_start").alias("start"), F.col("padded_end").alias("end")), ["job_id"])
    assert rs.statistics(m, o, merged).first().asDict() == {"job_id": 1, "candidates": 3, "skipped": 2, "added": 1, "muted_intervals": 2}
    with pytest.raises(Exception, match="must end after"):
        rs.apply_corrections(none, m, spark.createDataFrame([], "job_id long, word_index int"), spark.createDataFrame([(1, "x", 9, 9)], "job_id long, text string, start int, end int")).collect()


def test_review_quit_and_rest(spark):
    m = spark.createDataFrame([(j, i, 1, "w", "w", 1, 0, 1, s, i) for j in (1, 2, 3) for i, s in enumerate((10, 99, 10, 10, 10), 1)], "job_id long, word_index int, span int, matched_text string, entry string, line_no int, start int, end int, score int, match_rank int")
    answers = spark.createDataFrame([(1, 1, "n"), (1, 2, "q"), (1, 3, "s"), (1, 4, "q"), (2, 3, "q")], "job_id long, match_rank int, answer string")
    got = {}
    for r in rv.replay(m, answers, 50).orderBy("match_rank").collect():
        got.setdefault(r.job_id, []).append(r.outcome)
    assert got == {1: ["rejected", "auto_approved", "approved", "approved", "approved"], 3: ["approved", "auto_approved", "approved", "approved", "approved"]}
    assert {r.outcome for r in rv.replay(m, answers.limit(0), 0).collect()} == {"approved"}


def test_readers_and_writers(spark, tmp_path):
    for i, doc in enumerate([{"job_id": "x", "status": "done", "steps_completed": ["5_mute"]}, None, {"job_id": "x", "status": "later"}]):
        (tmp_path / f"j{i}").mkdir()
        (tmp_path / f"j{i}" / "job.json").write_text(json.dumps(doc) if doc else '{"job_id": ')
    jobs_ = readers.read_jobs(spark, f"{tmp_path}/*/job.json").cache()
    assert readers.corrupt_jobs(jobs_).count() == 1
    with pytest.warns(UserWarning, match="j1/job.json"):
        assert readers.find_job(jobs_, "x").first().status == "done"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "transcript.json").write_text(json.dumps({"language": "en", "segment_index": 1, "words": [{"word": "a", "start": 1.5}, {"word": "b", "score": 0.25}]}))
    rows = readers.transcript_words(readers.read_transcripts(spark, f"{tmp_path}/t/transcript.json")).orderBy("word_index").collect()
    assert [(r.word, r.start, r.end, r.score) for r in rows] == [("a", 1.5, None, None), ("b", None, None, 0.25)]
    (tmp_path / "t" / "m.json").write_text(json.dumps({"matches": [{"word_index": 3, "span": 1, "matched_text": "x"}]}))
    assert readers.read_matches(spark, f"{tmp_path}/t/m.json").first().word_index == 3
    (tmp_path / "t" / "o.json").write_text(json.dumps({"overrides": [{"action": "add", "text": "x", "start": 1.0, "end": 2.0}]}))
    assert readers.read_overrides(spark, f"{tmp_path}/t/o.json").first().end == 2.0
    (tmp_path / "l.txt").write_text("a\n# b\r\nc*")
    assert [r.line for r in readers.read_lines(spark, f"{tmp_path}/l.txt").orderBy("line_no").collect()] == ["a", "# b", "c*"]
    assert readers.resolve_lexicon(None, tmp_path / "l.txt") == str(tmp_path / "l.txt")
    with pytest.raises(FileNotFoundError):
        readers.resolve_lexicon("/nowhere", "/nowhere")
    probe = spark.createDataFrame([('{"streams":[{"codec_name":"aac","tags":{"a":"b"}}],"format":{"duration":"2.5"}}',), ('{"streams":[]}',)], "p string")
    assert [(r.stream.codec_name if r.stream else None, r.duration_sec) for r in readers.read_probe(probe, "p").collect()] == [("aac", 2.5), (None, None)]
    with pytest.raises(Exception, match="no audio stream"):
        readers.read_probe(probe, "p", strict=True).select("stream").collect()
    with pytest.raises(Exception, match="duration can't be determined"):
        readers.read_probe(probe, "p", strict=True).select("duration_sec").collect()
    for name, text, want in (("c.json", '{"output": {"log_level": "INFO"}}', {"output": {"log_level": "WARN"}}), ("none.json", None, {"output": {"log_level": "WARN"}})):
        if text:
            (tmp_path / name).write_text(text)
        assert config.load(tmp_path / name, {"AC_LOG_LEVEL": "WARN"}) == want
    (tmp_path / "a.pcm").write_bytes(b"\x01\x00\xff\xff\x07")
    assert readers.pcm_files(spark, f"{tmp_path}/a.pcm").first().samples == [1, -1]
    for df in (spark.range(3), spark.range(2)):
        path = writers.write(df, str(tmp_path / "out"), "matches")
    assert spark.read.parquet(path).count() == 2 == writers.read(spark, str(tmp_path / "out"), "matches").count()
    assert len(list((tmp_path / "out" / "matches").iterdir())) >= 3
    writers.clean(spark, str(tmp_path / "out"), "matches")
    assert writers.read(spark, str(tmp_path / "out"), "matches").count() == 2
    writers.write(spark.createDataFrame([("a", "en", 1), ("b", "de", 2)], "job_id string, language string, word_index int"), str(tmp_path / "out"), "words")
    assert sorted(tuple(r) for r in writers.read(spark, str(tmp_path / "out"), "words").select("job_id", "language", "word_index").collect()) == [("a", "en", 1), ("b", "de", 2)]
    with pytest.raises(FileNotFoundError):
        writers.read(spark, str(tmp_path / "out"), "intervals")
    failure = spark.createDataFrame([("x", "5_mute", 1, False, "oh", "trace")], "job_id string, step string, seq int, done boolean, error string, traceback string")
    for _ in range(2):
        path = writers.append_failure(failure, str(tmp_path / "out"))
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        writers.write(spark.range(1), str(tmp_path), "nonsense")


def test_nested_segments_and_backends(spark):
    df = spark.createDataFrame([(1, [{"words": [{"word": "a"}, {"word": ""}]}, {"words": [{"word": None}, {"word": "b"}]}]), (2, None)], "id int, segments array<struct<words:array<struct<word:string>>>>")
    assert [[w.word for w in r.words] for r in sg.flatten_words(df).orderBy("id").collect()] == [["a", "b"], []]
    with pytest.raises(NotImplementedError):
        audio.check_method("beep", 1)
    audio.check_method("beep", 0)
    blocks = spark.sql("select array(1, 2, 3) a, array(10) b").select(audio.mix_blocks(F.col("a"), F.col("b")).alias("x"))
    assert blocks.first().x == [11, 2, 3]


def test_flags_config_and_steps(spark):
    for bad in ({}, {"input_path": "a", "redo_review": True, "skip": (1,)}, {"input_path": "a", "redo_steps": ("nope",)}, {"input_path": "a", "add": (("x", 2, 1),)}, {"input_path": "a", "interactive": True, "terminal": False}, {"input_path": "a", "interactive": True, "not_interactive": True}, {"input_path": "a", "redo_review": True, "not_interactive": True}):
        with pytest.raises(ValueError):
            jobs.check_flags(**bad)
    jobs.check_flags(input_path="a", skip=(1,))
    env = {"AC_KEEP_INTERMEDIATES": "yes", "AC_KEEP_CORRECTION_ARTIFACTS": "0", "AC_SEGMENT_SIZE": "60", "AC_LOG_LEVEL": "DEBUG"}
    got = config.overlay({"output": {"log_level": "INFO", "x": None}}, env)
    assert got == {"output": {"log_level": "DEBUG", "x": None, "keep_correction_artifacts": False}, "audio": {"segment_size_sec": 60}}
    assert config.get(got, "output", "x", default=5) == 5 and config.get(got, "audio", "segment_size_sec") == 60
    with pytest.raises(Exception, match="no such step"):
        jobs.redo(spark.createDataFrame([(1, "a")], "job_id int, step string"), spark.createDataFrame([(1, "1a_extract")], "job_id int, step string")).collect()


def test_times_in_seconds_are_rounded(spark):
    w = spark.createDataFrame([(1, 1, 0, "a", 0.30004, None, 1800.1, 0.5), (1, 2, 0, "b", 12.34567, 12.78, 3600.00001, None)], "job_id int, segment_index int, pos int, word string, start double, end double, offset double, score double")
    assert [(r.start, r.end) for r in sg.merge_transcripts(w).orderBy("word_index").collect()] == [(1800.4, None), (3612.3457, 3612.78)]
    m = spark.createDataFrame([(1, 0, 1, "a", "a", 1, 1.00004, 1.50006, 0.9, 1), (1, 9, 1, "b", "b", 2, 1.00001, 1.2, 0.9, 2)], "job_id int, word_index int, span int, matched_text string, entry string, line_no int, start double, end double, score double, match_rank int")
    o = spark.createDataFrame([(1, "add", None, "x", 0.99996, 2.00004)], "job_id int, action string, word_index int, text string, start double, end double")
    log = rs.redaction_log(m, o, 0.25).orderBy("log_rank").collect()
    assert [(r.source, r.word, r.padded_start, r.padded_end) for r in log] == [("matched", "a", 0.75, 1.7501), ("matched", "b", 0.75, 1.45), ("review_add", "x", 0.75, 2.25)]
    got = rs.muted_intervals(m, o, 0.25).first()
    assert (got.start, got.end) == (0.99996 - 0.25, 2.00004 + 0.25)


def test_downmix_and_encode(spark):
    import struct

    frame = struct.pack("<6h", 1000, 2000, 300, 9999, 400, -500)
    rows = spark.createDataFrame([(1, frame * 2, 6), (2, struct.pack("<2h", 5, -6), 1), (3, struct.pack("<2h", 5, -6), 2)], "job_id long, audio binary, channels int")
    got = {r.job_id: struct.unpack(f"<{len(r.stereo) // 2}h", r.stereo) for r in audio.downmix(rows, audio.PlainDownmixer).collect()}
    blocks = spark.sql("select array(1000, 2000, 300, 9999, 400, -500, 1000, 2000, 300, 9999, 400, -500) s").select(audio.downmix_block(F.col("s"), 6).alias("x"), audio.downmix_block(F.array(), 2).alias("none")).first()
    assert got == {1: tuple(blocks.x), 2: (5, 5, -6, -6), 3: (5, -6)} and blocks.none == []
    with pytest.raises(ValueError):
        audio.downmix_block(F.col("s"), 5)
    probed = spark.createDataFrame([(1, b"pcm", "TrueHD", None, None, 8, "Unknown"), (2, b"pcm", "aac", "LC", "128000", 2, "")], "job_id long, audio binary, codec_name string, profile string, bit_rate string, channels int, channel_layout string")
    assert [(r.encoder, r.bitrate, r.encoded) for r in audio.encode(probed, audio.PlainEncoder).orderBy("job_id").collect()] == [("ac3", 640000, b"ac3 640000 7.1\npcm"), ("aac", 128000, b"aac 128000 stereo\npcm")]


def test_phrases_of_a_large_lexicon(spark):
    found = [fl.Rule(f"w{i} v{i}", (f"w{i}", f"v{i}"), "exact", i % 2 == 0, i) for i in range(300)] + [fl.Rule("W7 v7", ("W7", "v7"), "exact", True, 400)]
    rows = [(1, 2 * i + j, w, 1, 2, 3) for i in range(0, 300, 7) for j, w in enumerate((f"W{i}.", f"v{i},"))]
    got = sorted((m.word_index, m.line_no) for m in fl.phrase_matches(spark.createDataFrame(rows, WORDS), found).collect())
    assert got == sorted([(2 * i, i) for i in range(0, 300, 7) if i % 2] + [(14, 400)])


def test_text_examples(spark):
    row = spark.sql("select 'don\\'t,' w, '--' p, 'İ' u").select(tx.strip_punctuation(F.col("w")), tx.strip_punctuation(F.col("p")), tx.size(F.lit(450 * 1024**2)), tx.duration(F.lit(7389.9)), tx.slug(F.lit("Harbour Lights- A Winter Story (2031).1080p.hevc.mkv"))).first()
    assert tuple(row) == ("don't", "", "450.0 MB", "02:03:09", "harbour-lights-a-winter-story")


def test_sessions_touch(spark):
    e = spark.sql("select 1 k, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) t from values (0),(20),(41) v(m)")
    assert session_intervals(e, "k", "t", 600).count() == 2


def test_context_rules_agree_with_a_loop(spark):
    r = random.Random(14)
    text = [(j, i, r.choice(["God", "thank", "Praise,", "oh", "dear", "my", "x", "god!"])) for j in range(6) for i in range(80)]
    matches = [(j, i, r.choice([1, 2]), r.choice(["god", "my god"])) for j in range(6) for i in range(0, 78, 3)]
    rules = [("god", "thank", 3, 0), ("god", "PRAISE", 1, 2), ("my god", "oh", 0, 1), ("none", "x", 9, 9), ("god", "dear", None, None)]
    at = {(j, i): w.strip("!,").lower() for j, i, w in text}
    near = lambda m, e: any(at.get((m[0], k)) == word.lower() for entry, word, b, a in rules if entry == e and a is not None for k in (*range(m[1] - b, m[1]), *range(m[1] + m[2], m[1] + m[2] + a)))
    want = sorted(m for m in matches if not near(m, m[3]))
    frame = spark.createDataFrame
    got = fl.keep_by_context(frame(matches, "job_id long, word_index int, span int, entry string"), frame(text, "job_id long, word_index int, word string"), frame(rules, "entry string, near string, before int, after int"))
    assert sorted(tuple(x) for x in got.collect()) == want and 0 < len(want) < len(matches)


def test_yaml_configuration_under_the_environment(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "config.yaml"
    path.write_text("output:\n  log_level: INFO\n  keep_intermediates: false\naudio:\n  segment_size_sec: 1800\nsrt:\n  strategy: srt_primary\n  fuzzy_threshold: 85\n")
    got = config.load(path, {"AC_SEGMENT_SIZE": "60", "AC_KEEP_INTERMEDIATES": "1", "AC_INTERACTIVE": "", "AC_KEEP_CORRECTION_ARTIFACTS": "0"})
    assert got == {"output": {"log_level": "INFO", "keep_intermediates": True, "keep_correction_artifacts": False}, "audio": {"segment_size_sec": 60}, "srt": {"strategy": "srt_primary", "fuzzy_threshold": 85}}
    assert config.get(got, "srt", "strategy") == "srt_primary" and config.get(got, "srt", "none", default=3) == 3
    path.write_text("")
    assert config.load(path, {}) == {} == config.load(tmp_path / "none.yaml", {})
    path.write_text("a: [1")
    with pytest.raises(Exception, match="flow sequence"):
        config.load(path, {})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_matches_are_exploded_to_is_not_broadcast(spark, tmp_path):
    """A table of matches that is small on disk gives several times its rows, which a driver could not hold."""
    spark.range(200).selectExpr("id AS job_id", "CAST(id AS INT) AS word_index", "1 AS span", "2 AS line_no", "'the' AS entry").write.parquet(f"{tmp_path}/m")
    spark.range(200).selectExpr("id AS job_id", "CAST(id AS INT) AS word_index", "'the' AS word", "1 AS start", "2 AS end").write.parquet(f"{tmp_path}/w")
    m, w = spark.read.parquet(f"{tmp_path}/m"), spark.read.parquet(f"{tmp_path}/w")
    assert "Broadcast" not in plan_of(rv.context(m, w, 3))
    intervals = m.selectExpr("job_id", "word_index AS start", "word_index + 9 AS end")
    assert "Broadcast" not in plan_of(rs.covered_words(w, intervals, 5)) + plan_of(rs.mark_covered(w, intervals, 5))
    assert rs.covered_words(w, intervals, 5).columns == w.columns and rs.mark_covered(w, intervals, 5).columns == [*w.columns, "covered"]
    rules = spark.createDataFrame([("the", "in", 2, 1)], "entry string, near string, before int, after int")
    plan = plan_of(fl.keep_by_context(m, w, rules))
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_tokens_are_worked_out_once_for_each_word(spark, tmp_path):
    """As plain columns they would stand in a filter once for each rule that mentions them."""
    spark.range(50).selectExpr("id AS job_id", "CAST(id AS INT) AS word_index", "'the' AS word", "1 AS start", "2 AS end", "3 AS score").write.parquet(f"{tmp_path}/w")
    some = [fl.Rule(w, (w,), "exact", False, i) for i, w in enumerate(["a", "b", "c", "d", "the"])] + [fl.Rule("of the", ("of", "the"), "exact", False, 9)]
    for found in (fl.flag, fl.single_matches, fl.phrase_matches):
        plan = plan_of(found(spark.read.parquet(f"{tmp_path}/w"), some))
        assert plan.count("trim(") == 1 and plan.count("lower(tok") == 1
    assert fl.flag(spark.read.parquet(f"{tmp_path}/w"), some).count() == 50


def test_large_tables_are_dealt_out_too(spark, tmp_path):
    """One file with one row group was one task, if it had more than 128 MB."""
    spark.range(3000).selectExpr("id", "sha2(CAST(id AS STRING), 512) AS text").coalesce(1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert spread(table, most=1, each=size // 9).rdd.getNumPartitions() >= 9
    assert spread(table, most=1).rdd.getNumPartitions() == table.rdd.getNumPartitions()
    assert spread(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(table, most=1, each=size // 9).count() == 3000


def test_samples_are_worked_out_once_for_a_downmix(spark):
    """Samples that are made by an expression were made again for each sample that was looked at."""
    made = F.transform(F.sequence(F.lit(0), F.col("id") * 6 + 5), lambda i: (i + 777_777).cast("int"))
    plan = spark.range(1).select(audio.downmix_block(made, 6).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("777777") == 1


def test_words_of_many_segments_come_in_bounded_batches(spark):
    """All words of 10,000 segments were one table of a worker."""
    rows = spark.range(900).selectExpr("id AS job_id", "1 AS segment_index", "CAST(repeat('ab ', 100) AS BINARY) AS dialogue").coalesce(1)
    batches = list(audio._bounded(iter([pd.DataFrame({"audio": [b"x" * (3 << 20), b"", b"y" * (2 << 20), b"z" * (9 << 20), b"w"]})]), "audio"))
    assert [list(b.index) for b in batches] == [[0, 1], [2], [3], [4]]
    whole = audio.transcribe(rows, audio.TextTranscriber)
    assert whole.count() == 90_000 and whole.where("pos = 99").count() == 900
    run = {}

    class Rows:
        def mapInPandas(self, f, schema):
            run["f"] = f

        def select(self, *_):
            return self

    audio.transcribe(Rows(), audio.TextTranscriber)
    held = [len(b) for b in run["f"](iter([pd.DataFrame({"job_id": range(900), "segment_index": 1, "dialogue": [b"ab " * 100] * 900})]))]
    assert sum(held) == 90_000 and max(held) <= audio.BATCH_WORDS


def test_contexts_in_texts_agree_with_those_in_words(spark):
    texts = [(1, " a b\tc d  e f g "), (2, "one"), (3, "x y z"), (4, None), (5, "p q")]
    found = [(1, 0, 1, 7), (1, 3, 2, 8), (1, 3, 1, 8), (1, 6, 1, 7), (2, 0, 1, 7), (3, 1, 2, 9)]
    m = spark.createDataFrame(found, "job_id long, word_index int, span int, line_no int")
    t = spark.createDataFrame(texts, "job_id long, text string")
    w = spark.createDataFrame([(j, i, x) for j, text in texts for i, x in enumerate((text or "").split())], "job_id long, word_index int, word string")
    for k in (0, 1, 3):
        one, other = rv.context_in_texts(m, t, k), rv.context(m, w, k)
        assert sorted(map(tuple, one.select(other.columns).collect())) == sorted(map(tuple, other.collect())) and one.count() == len(found)
    assert "Broadcast" not in plan_of(rv.context_in_texts(m, t, 3))


def test_words_around_matches_go_through_no_exchange(spark, monkeypatch):
    """Every word and every index that a match wants was a row of an exchange, beside a saved table of matches."""
    kept = []
    monkeypatch.setattr(transcript, "saved", lambda df: (kept.append(df), saved(df))[1])
    plan = plan_of(QUERIES["match_context"](spark, "/root/testdata/sf0.001"))
    assert not kept and plan.count("Exchange hashpartitioning(") == 2 and "sequence(" not in plan.split("Exchange hashpartitioning(", 1)[1]


def test_words_are_exchanged_once_for_phrases(spark, tmp_path):
    """As structs that a window looks ahead to, each word was exchanged several times."""
    spark.range(50).selectExpr("id DIV 10 AS job_id", "CAST(id % 10 AS INT) AS word_index", "IF(id % 2 = 0, 'of', 'the') AS word", "1 AS start", "2 AS end", "CAST(NULLIF(id % 3, 0) AS INT) AS score").write.parquet(f"{tmp_path}/w")
    found = fl.flag(spark.read.parquet(f"{tmp_path}/w"), [fl.Rule("of the", ("of", "the"), "exact", False, 1), fl.Rule("the of the", ("the", "of", "the"), "exact", False, 2)])
    assert "struct(" not in plan_of(found).split("Exchange hashpartitioning(", 1)[1].split("BroadcastExchange", 1)[0]
    assert sorted((r.job_id, r.word_index, r.span, r.score) for r in found.collect()) == sorted((j, i, n, min((10 * j + i + x) % 3 for x in range(n))) for j in range(5) for i in range(10) for n in (2, 3) if i % 2 == n - 2 and i + n <= 10)
