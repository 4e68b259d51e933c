"""Subtitles against transcripts: alignment, substitution and reconciliation.

words: job_id, word_index, word, start, end, score (0 to 100). cues: job_id,
cue_index, start, end, text. Times are in one unit, say milliseconds. Words
without times meet no cue. Joins of words and cues are equi-joins on the job and
bins of time with the exact test in the join, so a job of any length is dealt
out over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import PUNCTUATION, strip_punctuation, tokens
from tessera.operators.diff import sequence_diff
from tessera.operators.scan import Ordered
from tessera.sources.tables import saved

#: The settings that choose whose times win.
STRATEGIES = ("whisperx_primary", "srt_primary", "highest_confidence")
#: Fixed value: what stands for a flagged word that has no substitution of its own.
CENSORED = "[censored]"


def normal(word: Column) -> Column:
    """What is compared: lower case, without punctuation at both ends."""
    return F.lower(strip_punctuation(word))


def similarity(a: Column, b: Column, least: int) -> Column:
    """floor(100 * (1 - edit distance / longer length)), or null where that is below `least`.

    The distance is computed in a band: it is given up beyond what `least` allows.
    """
    longer = F.greatest(F.length(a), F.length(b))
    most = F.floor(longer * (100 - least) / 100).cast("int")
    distance = F.call_function("levenshtein", a, b, most)
    return F.when(longer == 0, None).when(distance >= 0, F.floor(100 * (longer - distance) / longer).cast("int"))


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def covering(spans: DataFrame, cues: DataFrame, width: int) -> DataFrame:
    """Pairs of spans (job_id, start, end, ...) and the cues that cover them whole, with the cue's columns as cue_start, cue_end, cue_index and cue_text."""
    own = cues.where(F.col("start") <= F.col("end")).select(
        F.col("job_id").alias("__job"), F.col("start").alias("cue_start"), F.col("end").alias("cue_end"), "cue_index", F.col("text").alias("cue_text"), F.explode(_bins(F.col("start"), F.col("end"), width)).alias("__bin")
    )
    at = spans.where(F.col("start").isNotNull() & F.col("end").isNotNull()).withColumn("__at", F.floor(F.col("start") / width))
    inside = (F.col("cue_start") <= F.col("start")) & (F.col("end") <= F.col("cue_end"))
    return at.join(own, (F.col("job_id") == F.col("__job")) & (F.col("__at") == F.col("__bin")) & inside).drop("__job", "__bin", "__at")


def plain_tokens(text: Column) -> Column:
    return F.transform(tokens(text), normal)


def fuzzy_score(want: Column, own: Column, least: int, phrase: Column | None = None) -> Column:
    """The best similarity of words with as many of a cue's own words in a row (arrays of plain words); null where none reaches `least`.

    phrase, the words in one text, is given where it is at hand, as it is looked at for each run. Edits are
    counted only where no run is the phrase itself.
    """
    n, phrase = F.size(want), F.array_join(want, " ") if phrase is None else phrase
    runs = F.when(n == 1, own).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(own, i, n), " ")))
    equal = F.lit(least <= 100) & (F.length(phrase) > 0) & F.array_contains(runs, phrase)
    likely = F.filter(runs, lambda run: F.abs(F.length(run) - F.length(phrase)) * 100 <= F.greatest(F.length(run), F.length(phrase)) * (100 - least))  # at least so many edits
    near = F.array_max(F.transform(likely, lambda run: similarity(phrase, run, least)))
    return F.when((n > 0) & (F.size(own) >= n), F.when(equal, 100).otherwise(near))


def confirmations(spans: DataFrame, cues: DataFrame, *, threshold: int = 85, text: str = "matched_text", key: tuple[str, ...] = ("job_id", "word_index"), width: int = 10_000) -> DataFrame:
    """The key of each span that a cue confirms, and cue: struct(cue_index, fuzzy, cue_start, cue_end).

    A cue confirms a span if it covers it and has text like it: of several the
    one with the best score, then the earliest. Rows that repeat a key are one span.
    """
    want = spans.select(*key, "start", "end", plain_tokens(F.col(text)).alias("__want")).withColumn("__phrase", F.array_join("__want", " "))
    own = cues.select("job_id", "cue_index", "start", "end", plain_tokens(F.col("text")).alias("text"))
    scored = covering(want, own, width).withColumn("fuzzy", fuzzy_score(F.col("__want"), F.col("cue_text"), threshold, F.col("__phrase"))).where("fuzzy is not null")
    return scored.groupBy(*key).agg(F.min_by(F.struct("cue_index", "fuzzy", "cue_start", "cue_end"), F.struct(-F.col("fuzzy"), "cue_start", "cue_index")).alias("cue"))


def decide(spans: DataFrame, confirmed: DataFrame, strategy: str, key: tuple[str, ...] = ("job_id", "word_index")) -> DataFrame:
    """spans with start and end as the strategy decides, and timing, cue_index and fuzzy.

    whisperx_primary keeps the span's own times, srt_primary takes those of a
    confirming cue, and highest_confidence takes them if the cue's score is above
    the span's (no score counts as 0).
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}: one of {', '.join(STRATEGIES)}")
    both = spans.join(confirmed.select(*key, F.col("cue").alias("__cue")), list(key), "left")
    wins = {"whisperx_primary": F.lit(False), "srt_primary": F.lit(True), "highest_confidence": F.col("__cue.fuzzy") > F.coalesce("score", F.lit(0))}[strategy]
    both = both.withColumn("__wins", F.col("__cue").isNotNull() & wins)
    for c in ("start", "end"):
        both = both.withColumn(c, F.when(F.col("__wins"), F.col(f"__cue.cue_{c}")).otherwise(F.col(c)))
    timing = F.when(F.col("__wins"), "subtitle").otherwise("transcript")
    return both.withColumn("timing", timing).withColumn("cue_index", F.col("__cue.cue_index")).withColumn("fuzzy", F.col("__cue.fuzzy")).drop("__cue", "__wins")


def align(spans: DataFrame, cues: DataFrame, *, strategy: str = "whisperx_primary", threshold: int = 85, text: str = "matched_text", key: tuple[str, ...] = ("job_id", "word_index"), width: int = 10_000) -> DataFrame:
    """spans (matches or words) with the times that the strategy decides on: decide over confirmations."""
    return decide(spans, confirmations(spans, cues, threshold=threshold, text=text, key=key, width=width), strategy, key)


def cue_tokens(cues: DataFrame) -> DataFrame:
    """The words of cues that are more than punctuation: place, token, and begin and stop, the characters of it without punctuation around (from 0, stop exclusive)."""
    text = F.coalesce("text", F.lit(""))
    found = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    gaps = F.split(text, r"\S+")  # what stands before each word, and behind the last
    begins = F.aggregate(
        F.arrays_zip(F.transform(found, F.length).alias("w"), F.transform(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))), F.length).alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, x: F.struct((s["at"] + x["g"] + x["w"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["g"])).alias("out")),
        lambda s: s["out"],
    )
    rows = cues.where(F.size(found) > 0).select("job_id", "cue_index", "start", "end", F.posexplode(F.arrays_zip(found.alias("word"), begins.alias("at"))).alias("place", "x"))
    token = strip_punctuation(F.col("x.word"))
    lead = F.length("x.word") - F.length(F.ltrim(F.col("x.word"), F.lit(PUNCTUATION)))
    begin = F.col("x.at") + lead
    return rows.select("job_id", "cue_index", "start", "end", "place", token.alias("token"), begin.alias("begin"), (begin + F.length(token)).alias("stop")).where("token <> ''")


def cue_of_words(words: DataFrame, cues: DataFrame, width: int = 10_000) -> DataFrame:
    """(job_id, word_index, word, cue_index): the cues on screen when a word begins (begin inclusive, end exclusive)."""
    shown = covering(words.where(F.col("start").isNotNull()).select("job_id", "word_index", "word", "start", F.col("start").alias("end")), cues, width)
    return shown.where((F.col("start") < F.col("cue_end")) | (F.col("cue_start") == F.col("cue_end"))).select("job_id", "word_index", "word", "cue_index")


def flagged_tokens(matches: DataFrame, words: DataFrame, cues: DataFrame, width: int = 10_000) -> DataFrame:
    """The cue words that matches are heard as: job_id, cue_index, place, begin, stop, token and of its match word_index, span, entry, line_no.

    The n-th time that a word is heard while a cue is shown is the n-th time that
    the cue has it. A phrase whose words are shown by two cues has words in both.
    """
    heard = cue_of_words(words, cues, width).withColumn("norm", normal(F.col("word")))
    heard = heard.withColumn("nth", F.row_number().over(Window.partitionBy("job_id", "cue_index", "norm").orderBy("word_index")))
    shown = cue_tokens(cues).withColumn("norm", F.lower("token"))
    shown = shown.withColumn("nth", F.row_number().over(Window.partitionBy("job_id", "cue_index", "norm").orderBy("place")))
    flagged = matches.select("job_id", F.col("word_index").alias("first"), "span", "entry", "line_no", F.explode(F.sequence(F.col("word_index"), F.col("word_index") + F.col("span") - 1)).alias("word_index"))
    both = heard.join(flagged, ["job_id", "word_index"]).join(shown.select("job_id", "cue_index", "norm", "nth", "place", "begin", "stop", "token"), ["job_id", "cue_index", "norm", "nth"])
    return both.select("job_id", "cue_index", "place", "begin", "stop", "token", F.col("first").alias("word_index"), "span", "entry", "line_no")


def substitute(cues: DataFrame, words: DataFrame, matches: DataFrame, *, style: str = "tag", substitutions: DataFrame | None = None, width: int = 10_000) -> DataFrame:
    """cues with the flagged words of their text replaced, and n_replaced.

    style tag puts CENSORED for each run of a match's words in a cue, style
    stars keeps each word's first character. substitutions (entry, replacement)
    goes before the style for its entries. Where ranges of several matches meet,
    they are one range, with the replacement of the one that begins first (the
    longest of those, then the earliest rule). Punctuation around words stays.
    """
    if style not in ("tag", "stars"):
        raise ValueError(f"unknown style {style!r}: tag or stars")
    found = flagged_tokens(matches, words, cues, width)
    if substitutions is None:
        found = found.withColumn("replacement", F.lit(None).cast("string"))
    else:
        found = found.join(substitutions.select("entry", "replacement"), "entry", "left")
    one = ["job_id", "cue_index", "word_index", "span", "line_no"]
    alone = F.lit(style == "stars") & F.col("replacement").isNull()
    run = F.col("place") - F.row_number().over(Window.partitionBy(*one).orderBy("place"))
    ranges = found.withColumn("__run", F.when(alone, F.col("place")).otherwise(run)).groupBy(*one, "__run", alone.alias("__alone")).agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"), F.first("replacement").alias("replacement"), F.min("token").alias("token"))
    stars = F.concat(F.left("token", F.lit(1)), F.repeat(F.lit("*"), F.length("token") - 1))
    put = F.coalesce("replacement", F.when(F.col("__alone"), stars).otherwise(CENSORED))
    ranges = ranges.select("job_id", "cue_index", F.struct("begin", (-F.col("stop")).alias("minus"), "line_no", put.alias("put")).alias("r"))
    gathered = ranges.groupBy("job_id", "cue_index").agg(F.array_sort(F.collect_list("r")).alias("__ranges"))  # of one cue
    kind = "array<struct<begin:int,stop:int,put:string>>"

    def joined(done: Column, r: Column) -> Column:
        """done, the latest range first, with r, which begins no earlier."""
        stop, last = -r["minus"], F.get(done, F.lit(0))
        fresh = F.concat(F.array(F.struct(r["begin"].alias("begin"), stop.alias("stop"), r["put"].alias("put"))), done)
        longer = F.concat(F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["stop"], stop).alias("stop"), last["put"].alias("put"))), F.slice(done, 2, F.greatest(F.size(done) - 1, F.lit(0))))
        return F.when((F.size(done) == 0) | (r["begin"] >= last["stop"]), fresh).otherwise(longer)

    whole = F.aggregate("__ranges", F.array().cast(kind), joined)
    rewritten = F.aggregate("__whole", F.col("text"), lambda text, r: F.concat(F.substr(text, F.lit(1), r["begin"]), r["put"], F.substr(text, r["stop"] + 1)))
    both = cues.join(gathered, ["job_id", "cue_index"], "left").withColumn("__whole", whole)
    return both.withColumn("text", F.when(F.col("__whole").isNull(), F.col("text")).otherwise(rewritten)).withColumn("n_replaced", F.coalesce(F.size("__whole"), F.lit(0))).drop("__ranges", "__whole")


def shown_words(cues: DataFrame) -> DataFrame:
    """All words of cues in the order in which they are shown: job_id, at (dense from 0), token (normal), cue_index, place."""
    own = cues.select("job_id", "start", "cue_index", tokens(F.col("text")).alias("w"))
    ahead = Ordered.of(own, ["job_id"], ["start", "cue_index"]).scan("ahead", "sum", F.size("w").cast("long"), before=True).rows
    return ahead.select("job_id", "cue_index", F.coalesce("ahead", F.lit(0)).alias("ahead"), F.posexplode("w").alias("place", "word")).select("job_id", (F.col("ahead") + F.col("place")).alias("at"), normal(F.col("word")).alias("token"), "cue_index", "place")


MODES = ("report", "auto", "hybrid")


def reconcile(cues: DataFrame, words: DataFrame, *, mode: str = "report", divergence: int = 30, confidence: int = 80, longest: int = 50_000) -> DataFrame:
    """cues with spoken (the transcript's words for them), n_differ, percent (of differing words), confidence (mean score of the spoken words), action and text.

    words are numbered from 0 without gaps in each job. Both sides are compared as
    whole sequences; words that only the transcript has belong to the cue of the
    words that they stand in for, or else to that of the cue word before them. A cue differs if at least
    `divergence` percent of its words do. report flags such cues; auto replaces
    their text where the confidence is at least `confidence` and leaves the
    others; hybrid replaces as auto does and flags the others. Words without a
    score count as 0. Cues of equal job and index are one cue.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: one of {', '.join(MODES)}")
    shown = saved(shown_words(cues))
    heard = words.select("job_id", F.col("word_index").cast("long").alias("at"), "word", F.coalesce("score", F.lit(0)).alias("score"))
    script = saved(sequence_diff(heard.select("job_id", "at", normal(F.col("word")).alias("token")), shown.select("job_id", "at", "token"), longest=longest))
    # what differs in each cue: its own words without a partner, and spoken ones that it lacks
    runs = script.where("op <> 'equal'")
    own = runs.where("b_end > b_start").select("job_id", F.explode(F.expr("sequence(b_start, b_end - 1)")).alias("at")).join(shown, ["job_id", "at"]).groupBy("job_id", "cue_index").agg(F.count("*").alias("lacking"))
    # each spoken word's place on the other side: its partner's, or its share of the run, or the word before the run
    width_b = F.col("b_end") - F.col("b_start")
    spot = F.when(width_b > 0, F.col("b_start") + F.least(F.col("k"), width_b - 1)).otherwise(F.greatest(F.col("b_start") - 1, F.lit(0)))
    placed = script.where("a_end > a_start").select("job_id", "op", "a_start", "a_end", "b_start", "b_end", F.explode(F.expr("sequence(0L, a_end - a_start - 1)")).alias("k"))
    placed = placed.select("job_id", (F.col("a_start") + F.col("k")).alias("__at"), spot.alias("at"), (F.col("op") != "equal").cast("int").alias("extra"))
    spoken = placed.join(shown.select("job_id", "at", "cue_index"), ["job_id", "at"]).drop("at").withColumnRenamed("__at", "at").join(heard, ["job_id", "at"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    of_cue = spoken.groupBy("job_id", "cue_index").agg(text.alias("spoken"), F.sum("extra").alias("extra"), F.floor(F.avg("score")).cast("int").alias("confidence"))
    size = shown.groupBy("job_id", "cue_index").agg(F.count("*").alias("n"))
    both = cues.join(size, ["job_id", "cue_index"], "left").join(own, ["job_id", "cue_index"], "left").join(of_cue, ["job_id", "cue_index"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    differ = F.greatest(zero("lacking"), zero("extra"))
    both = both.withColumn("n_differ", differ).withColumn("percent", F.when(differ == 0, 0).otherwise(F.floor(100 * differ / F.greatest(zero("n"), differ))).cast("int"))
    apart = (F.col("n_differ") > 0) & (F.col("percent") >= divergence)
    sure = (zero("confidence") >= confidence) & F.col("spoken").isNotNull()
    action = {"report": F.when(apart, "flag"), "auto": F.when(apart & sure, "replace"), "hybrid": F.when(apart & sure, "replace").when(apart, "flag")}[mode]
    both = both.withColumn("action", F.coalesce(action, F.lit("keep")))
    return both.withColumn("text", F.when(F.col("action") == "replace", F.col("spoken")).otherwise(F.col("text"))).drop("n", "lacking", "extra")
