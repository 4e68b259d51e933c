"""Job state as a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The steps, in order, and those that a correction has to run again.
STEPS = ("1a_extract", "1b_downmix", "1c_segment", "2_separate", "3_transcribe", "3b_merge", "4b_flag", "4b_review", "5_mute", "6_recombine", "6b_encode", "7_mux")
CORRECTED = ("5_mute", "6_recombine", "6b_encode", "7_mux")
REDO = ("4b_flag", "4b_review", "5_mute", "6_recombine", "6b_encode", "7_mux")


#: Steps whose outputs stand for all of these are skipped whole once the last of them is done.
BLOCK = ("1a_extract", "1b_downmix", "1c_segment", "2_separate", "3_transcribe", "3b_merge")
#: A step's output, and the step that uses it up (null if it is always kept).
OUTPUTS = (("3b_merge", "transcript.json", None), ("3b_merge", "dialog.wav", "5_mute"), ("3b_merge", "score_sfx.wav", "6_recombine"), ("4b_flag", "matches.json", None), ("4b_review", "review.json", None), ("5_mute", "censor_log.json", None), ("5_mute", "dialog_censored.wav", "6_recombine"), ("6_recombine", "audio_censored.wav", "6b_encode"))


def completed(events: DataFrame) -> DataFrame:
    """Steps that are done, from events (job_id, step, seq, done): the last event of a step decides."""
    return events.groupBy("job_id", "step").agg(F.max_by("done", "seq").alias("done")).where("done").select("job_id", "step")


def invalidate(done: DataFrame, corrected: DataFrame, steps: tuple[str, ...] = CORRECTED) -> DataFrame:
    """Done steps without those that the given jobs have to run again."""
    return done.join(corrected.select("job_id").distinct().withColumn("__again", F.lit(True)), "job_id", "left").where(F.col("__again").isNull() | ~F.col("step").isin(*steps)).drop("__again")


def redo(done: DataFrame, wanted: DataFrame) -> DataFrame:
    """Done steps without those wanted again (job_id, step); unknown steps are an error."""
    ok = F.when(F.col("step").isin(*REDO), F.col("step")).otherwise(F.raise_error(F.concat(F.lit("no such step to redo: "), F.col("step"))).cast("string"))
    return done.join(wanted.select("job_id", ok.alias("step")).distinct(), ["job_id", "step"], "left_anti")


def with_block(done: DataFrame) -> DataFrame:
    """Done steps; where the block's last step is done, all of the block counts as done, as its other outputs may be gone."""
    whole = done.where(F.col("step") == BLOCK[-1]).select("job_id", F.explode(F.array(*map(F.lit, BLOCK))).alias("step"))
    return done.unionByName(whole).distinct()


def steps_to_run(done: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, n, step) of the steps that each job still has to run."""
    steps = jobs.sparkSession.createDataFrame(list(enumerate(STEPS)), "n int, step string")
    return jobs.select("job_id").crossJoin(F.broadcast(steps)).join(with_block(done), ["job_id", "step"], "left_anti").select("job_id", "n", "step")  # a dozen rows for each job


def next_step(done: DataFrame, jobs: DataFrame) -> DataFrame:
    """The first step that each job still has to run; null once all are done."""
    return jobs.select("job_id").join(steps_to_run(done, jobs).groupBy("job_id").agg(F.min_by("step", "n").alias("step")), "job_id", "left")


def missing_outputs(done: DataFrame, present: DataFrame) -> DataFrame:
    """(job_id, step, output) that a done step should have left but that are not present (job_id, output).

    What a later step uses up is only needed until that step is done.
    """
    needs = F.broadcast(done.sparkSession.createDataFrame(OUTPUTS, "step string, output string, until string"))
    wanted = done.join(needs, "step")
    used = done.select("job_id", F.col("step").alias("until"))
    return wanted.join(used, ["job_id", "until"], "left_anti").join(present.select("job_id", "output"), ["job_id", "output"], "left_anti").select("job_id", "step", "output")


def reviewed(done: DataFrame, corrected: DataFrame) -> DataFrame:
    """Done steps after corrections of the given jobs: their review counts as done, and what depends on it has to run again."""
    jobs = corrected.select("job_id").distinct()
    return invalidate(done, jobs).unionByName(jobs.select("job_id", F.lit("4b_review").alias("step"))).distinct()


def check_flags(*, input_path: str | None = None, redo_steps: tuple[str, ...] = (), redo_review: bool = False, skip: tuple[int, ...] = (), add: tuple[tuple, ...] = (), interactive: bool = False, not_interactive: bool = False, terminal: bool = True) -> None:
    """Rejects combinations that no run can honour."""
    if not input_path:
        raise ValueError("an input is needed")
    if interactive and not_interactive:
        raise ValueError("a run is interactive or not")
    if redo_review and not_interactive:
        raise ValueError("a new review is interactive")
    if redo_review and (skip or add):
        raise ValueError("a new review and corrections exclude each other")
    if redo_steps and (skip or add or redo_review):
        raise ValueError("steps to redo and corrections exclude each other")
    if unknown := [s for s in redo_steps if s not in REDO]:
        raise ValueError(f"no such step to redo: {unknown}")
    if (interactive or redo_review) and not terminal:
        raise ValueError("a review needs a terminal")
    if bad := [a for a in add if float(a[2]) <= float(a[1])]:
        raise ValueError(f"an added interval must end after it starts: {bad}")
