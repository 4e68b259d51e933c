"""Context lines, review replay and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens


def context(matches: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """matches with context: the words from k before to k after, quoted; clipped at the job's ends.

    Each match names the indices that it wants, so this is an equi-join on
    (job_id, word_index) and not a range join. The wanted indices are several
    times the matches, which the size of their table doesn't show, so neither
    they nor the lines may be broadcast.
    """
    keys = ["job_id", "word_index", "span", "line_no"]
    want = matches.select(*keys, F.explode(F.sequence(F.greatest(F.lit(0), F.col("word_index") - k), F.col("word_index") + F.col("span") + (k - 1))).alias("at"))
    own = words.select("job_id", F.col("word_index").alias("at"), "word")
    lines = want.hint("merge").join(own, ["job_id", "at"]).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    return matches.join(lines.hint("merge"), keys, "left").withColumn("context", F.concat(F.lit('"...'), F.coalesce("text", F.lit("")), F.lit('..."'))).drop("text")


def context_in_texts(matches: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """What context gives, where the words of a job are the tokens of one text (job_id, text); matches of jobs without a text are left out.

    A job's matches meet its text, and each takes its words from it by their places, so neither words nor
    the indices that matches want are rows of an exchange. A job's matches are one row of a task.
    """
    own = [c for c in matches.columns if c != "job_id"]
    of_job = matches.groupBy("job_id").agg(F.collect_list(F.struct(*own)).alias("__found"))
    # how large they are isn't seen in the sizes of tables, so neither side is broadcast; words are worked out once for each job
    both = of_job.hint("merge").join(texts.select("job_id", "text").hint("merge"), "job_id").select("job_id", "__found", F.explode(F.array(tokens(F.col("text")))).alias("__words"))

    def line(m: Column) -> Column:
        # by place, as a slice would copy all words for each match; places behind the end are null, which array_join leaves out
        at = F.sequence(F.greatest(F.lit(0), m["word_index"] - k), m["word_index"] + m["span"] + (k - 1))
        return F.concat(F.lit('"...'), F.array_join(F.transform(at, lambda i: F.get("__words", i)), " "), F.lit('..."'))

    lines = F.transform("__found", lambda m: F.struct(*[m[c].alias(c) for c in own], line(m).alias("context")))
    return both.select("job_id", F.inline(lines))


def replay(matches: DataFrame, decisions: DataFrame, least_score: float) -> DataFrame:
    """The outcome of a review from a table of answers (job_id, match_rank, answer y/n/s/q; y where absent).

    A candidate above least_score (if that is above 0) is approved without a
    question. s approves it and all that follow; q, if asked before any s,
    aborts the job, which then has no outcomes. Outcomes: approved, rejected,
    auto_approved.
    """
    by = Window.partitionBy("job_id").orderBy("match_rank")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    auto = F.lit(least_score > 0) & (F.col("score") > least_score)
    asked = matches.join(decisions, ["job_id", "match_rank"], "left").withColumn("auto", auto).withColumn("answer", F.when(F.col("auto"), None).otherwise(F.coalesce("answer", F.lit("y"))))
    rest = F.coalesce(F.max(F.when(F.col("answer") == "s", 1).otherwise(0)).over(before), F.lit(0)) == 1
    asked = asked.withColumn("rest", rest)
    quit_ = F.max(F.when((F.col("answer") == "q") & ~F.col("rest"), 1).otherwise(0)).over(Window.partitionBy("job_id"))
    outcome = F.when(F.col("rest"), "approved").when(F.col("auto"), "auto_approved").when(F.col("answer") == "n", "rejected").otherwise("approved")
    numbered = asked.withColumn("aborted", quit_).withColumn("of", F.count("*").over(Window.partitionBy("job_id")))
    return numbered.where("aborted = 0").withColumn("outcome", outcome).drop("auto", "answer", "rest", "aborted")


def review_overrides(outcomes: DataFrame) -> DataFrame:
    """A skip for each rejected candidate; approval needs no override."""
    return outcomes.where("outcome = 'rejected'").select("job_id", F.lit("skip").alias("action"), "word_index", F.col("matched_text").alias("text"))


def review_statistics(outcomes: DataFrame, adds: DataFrame | None = None) -> DataFrame:
    count = lambda kind: F.count_if(F.col("outcome") == kind).alias(kind)
    out = outcomes.groupBy("job_id").agg(F.count("*").alias("candidates"), count("approved"), count("rejected"), count("auto_approved"))
    if adds is None:
        return out.withColumn("added", F.lit(0).cast("long"))
    return out.join(adds.groupBy("job_id").agg(F.count("*").alias("added")), "job_id", "left").fillna(0, ["added"])


def pick(hits: DataFrame, n: int) -> DataFrame:
    """The n-th hit (from 1) of each job, in word order."""
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy("word_index"))).where(F.col("n") == n).drop("n")


def term_report(matches: DataFrame, low_score: float) -> DataFrame:
    """Counts for each rule, and how many of them are unsure."""
    return matches.groupBy("entry", "line_no").agg(F.count("*").alias("n"), F.countDistinct("job_id").alias("jobs"), F.count_if(F.col("score") < low_score).alias("low"))
