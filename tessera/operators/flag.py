"""Lexicon rules and their matches in word-level transcripts.

Words are rows (job_id, word_index, word, start, end, score) with the position
in the job as key. Rules are held by the driver; words are the large side and
are scanned once. Single-word rules become one CASE expression, or, for a large
lexicon, a join on the dictionary of distinct tokens, in which pattern rules
meet the prefixes and substrings of their own lengths. Only words that a single
rule takes or that some phrase holds are shuffled; one window for each job then
looks ahead, and phrases of any number are found by a join on their lower-case
text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip, strip_punctuation
from tessera.sources.tables import saved

MATCHES = ["job_id", "word_index", "span", "matched_text", "entry", "line_no", "start", "end", "score"]
#: Up to this many single-word rules stay one expression.
EXPRESSION_RULES = 200


@dataclass(frozen=True)
class Rule:
    raw: str
    tokens: tuple[str, ...]
    match_type: str
    case_sensitive: bool
    line_no: int

    @property
    def rank(self) -> int:
        """Precedence of single-word rules: exact, exact with case, starts-with, contains."""
        return {"exact": 2 if self.case_sensitive else 1, "startswith": 3, "contains": 4}[self.match_type]


def parse_lexicon(lines: DataFrame) -> DataFrame:
    """Rules of lines (line_no, line): raw, tokens, match_type, case_sensitive, line_no and status.

    Blank and # lines are left out. Status is ok, phrase (a star in a phrase
    is literal), empty or leading_star (both unusable).
    """
    df = lines.select("line_no", strip(F.col("line")).alias("raw")).where((F.col("raw") != "") & ~F.col("raw").startswith("#"))
    df = df.withColumn("case_sensitive", F.col("raw").startswith("="))
    df = df.withColumn("body", F.when(F.col("case_sensitive"), F.substring("raw", 2, 1_000_000)).otherwise(F.col("raw")))
    df = df.withColumn("lead", F.col("body").startswith("*"))
    df = df.withColumn("body", F.when(F.col("lead"), F.substring("body", 2, 1_000_000)).otherwise(F.col("body")))
    df = df.withColumn("trail", F.col("body").endswith("*"))
    df = df.withColumn("root", strip(F.when(F.col("trail"), F.left("body", F.length("body") - 1)).otherwise(F.col("body"))))
    df = df.withColumn("tokens", F.filter(F.split("root", r"\s+"), lambda t: t != ""))
    phrase = F.size("tokens") > 1
    starred = F.col("trail") | F.col("root").contains("*")
    status = F.when(F.col("root") == "", "empty").when(F.col("lead") & ~F.col("trail"), "leading_star").when(phrase & starred, "phrase").otherwise("ok")
    kind = F.when(phrase, "exact").when(F.col("lead") & F.col("trail"), "contains").when(F.col("trail"), "startswith").otherwise("exact")
    return df.select("raw", "tokens", kind.alias("match_type"), "case_sensitive", "line_no", status.alias("status"))


def rules(lexicon: DataFrame, most: int = 100_000) -> list[Rule]:
    """The usable rules of a parsed lexicon, in file order."""
    got = lexicon.where(F.col("status").isin("ok", "phrase")).orderBy("line_no").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a lexicon holds at most {most} rules")
    return [Rule(r.raw, tuple(r.tokens), r.match_type, r.case_sensitive, r.line_no) for r in got]


def _test(rule: Rule, token: Column, low: Column) -> Column:
    own, root = (token, rule.tokens[0]) if rule.case_sensitive else (low, rule.tokens[0].lower())
    return {"exact": own == root, "startswith": own.startswith(root), "contains": own.contains(F.lit(root))}[rule.match_type]


def first_rule(token: Column, low: Column, single: list[Rule]) -> Column:
    """Line number of the rule that takes a token (low: in lower case), by precedence and then file order; null if none does."""
    out = None
    for rule in sorted(single, key=lambda r: (r.rank, r.line_no)):
        out = F.when(_test(rule, token, low), rule.line_no) if out is None else out.when(_test(rule, token, low), rule.line_no)
    return (out if out is not None else F.lit(None)).cast("int")


def token_dictionary(tokens: DataFrame, single: list[Rule]) -> DataFrame:
    """(tok, line_no) of the distinct tokens that a rule takes; for lexicons too large for one expression.

    All joins are on equal text: pattern rules meet the prefixes (starts-with) or
    substrings (contains) of a token that are as long as some rule.
    """
    spark = tokens.sparkSession
    table = spark.createDataFrame([(r.rank, r.line_no, r.case_sensitive, r.tokens[0], r.tokens[0].lower()) for r in single], "rank int, line_no int, cs boolean, root string, low string")
    own = tokens.select("tok").distinct()
    low = F.lower("tok")
    as_key = lambda rank, texts: F.transform(texts, lambda t: F.struct(F.lit(rank).alias("rank"), t.alias("key")))
    sizes = {rank: sorted({len(r.tokens[0].lower()) for r in single if r.rank == rank}) for rank in (3, 4)}
    every = [as_key(1, F.array(low)), as_key(2, F.array(low))]
    every += [F.when(F.length(low) >= n, as_key(3, F.array(F.left(low, F.lit(n))))) for n in sizes[3]]
    substrings = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n))))
    every += [F.when(F.length(low) >= n, as_key(4, substrings(n))) for n in sizes[4]]
    none = F.array().cast("array<struct<rank:int,key:string>>")
    keys = own.select("tok", F.explode(F.concat(*[F.coalesce(x, none) for x in every])).alias("x")).select("tok", "x.*")
    exact = F.when(F.col("rank") == 2, F.col("tok") == F.col("root")).when(F.col("rank") == 3, F.col("tok").startswith(F.col("root"))).when(F.col("rank") == 4, F.col("tok").contains(F.col("root")))
    hits = keys.join(F.broadcast(table.withColumnRenamed("low", "key")), ["rank", "key"]).where(~F.col("cs") | exact)
    return hits.groupBy("tok").agg(F.min(F.struct("rank", "line_no")).alias("m")).select("tok", "m.line_no")


def _names(spark: SparkSession, found: list[Rule]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(r.line_no, r.raw) for r in found], "line_no int, entry string"))


def _timed(words: DataFrame) -> DataFrame:
    """Words that can match: timed, with something left of them as tok, and low, that in lower case.

    Both are worked out once for each word: as columns of a projection, filters
    on them and on what is made of them would repeat them for each mention.
    """
    timed = words.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    for name, text in (("tok", strip_punctuation(F.col("word"))), ("low", F.lower("tok"))):
        timed = timed.select("*", F.explode(F.array(text)).alias(name))
    return timed.where("tok <> ''")


def _with_rule(timed: DataFrame, single: list[Rule]) -> DataFrame:
    """timed with the line number of the single-word rule that takes each, null for none."""
    if len(single) <= EXPRESSION_RULES:
        return timed.withColumn("line_no", first_rule(F.col("tok"), F.col("low"), single))
    return timed.join(token_dictionary(timed, single), "tok", "left")


def single_matches(words: DataFrame, found: list[Rule]) -> DataFrame:
    """One match at most for each timed word."""
    single = [r for r in found if len(r.tokens) == 1]
    hit = _with_rule(_timed(words), single).where("line_no is not null").join(_names(words.sparkSession, single), "line_no")
    return hit.select("job_id", "word_index", F.lit(1).alias("span"), F.col("word").alias("matched_text"), "entry", "line_no", "start", "end", F.coalesce("score", F.lit(0)).alias("score"))


def _hits(words: DataFrame, found: list[Rule], with_single: bool) -> DataFrame:
    """Matches of all rules, or of phrases only, from one scan of the words and one exchange of those that can take part."""
    spark = words.sparkSession
    single, phrases = [r for r in found if len(r.tokens) == 1 and with_single], [r for r in found if len(r.tokens) > 1]
    timed, parts = _with_rule(_timed(words), single), sorted({t.lower() for r in phrases for t in r.tokens})
    in_phrase = F.lit(False)
    if 0 < len(parts) <= EXPRESSION_RULES:
        in_phrase = F.col("low").isin(parts)
    elif parts:
        some = F.broadcast(spark.createDataFrame([(t,) for t in parts], "__part string"))
        timed, in_phrase = timed.join(some, F.col("low") == F.col("__part"), "left"), F.col("__part").isNotNull()
    rows = timed.where(F.col("line_no").isNotNull() | in_phrase)
    own = ["word_index", "word", "tok", "end", "score"]
    by = Window.partitionBy("job_id").orderBy("word_index")
    lengths = sorted({len(r.tokens) for r in phrases})
    # columns, as structs would be exchanged beside what they are made of
    ahead = rows.select("*", *[F.lead(c, j).over(by).alias(f"__{c}{j}") for j in range(1, max(lengths, default=1)) for c in own])

    def word(j: int) -> dict[str, Column]:
        of = {c: F.col(f"__{c}{j}" if j else c) for c in own}
        return of | {"score": F.coalesce(of["score"], F.lit(0))}

    def found_at(n: int) -> Column:
        """What a phrase of n words here would match; null unless the words follow each other."""
        at = [word(j) for j in range(n)]
        text = F.concat_ws(" ", *[w["tok"] for w in at])
        what = F.struct(F.lit(n).alias("span"), F.lit(None).cast("int").alias("line_no"), F.concat_ws(" ", *[w["word"] for w in at]).alias("matched_text"), at[-1]["end"].alias("end"), F.least(*[w["score"] for w in at]).alias("score"), text.alias("text"))
        return F.when(at[-1]["word_index"] == F.col("word_index") + (n - 1), what)

    alone = F.struct(F.lit(1).alias("span"), F.col("line_no"), F.col("word").alias("matched_text"), F.col("end"), F.coalesce("score", F.lit(0)).alias("score"), F.lit(None).cast("string").alias("text"))
    every = F.array(F.when(F.col("line_no").isNotNull(), alone), *[found_at(n) for n in lengths])
    hits = ahead.select("job_id", "word_index", "start", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("m")).select("job_id", "word_index", "start", "m.*")
    rules_ = spark.createDataFrame([(len(r.tokens), " ".join(r.tokens).lower(), " ".join(r.tokens), r.case_sensitive, r.line_no) for r in phrases], "span int, low string, exact string, cs boolean, rule int")
    hits = hits.withColumn("low", F.lower("text")).join(F.broadcast(rules_), ["span", "low"], "left").where((F.col("span") == 1) | (F.col("rule").isNotNull() & (~F.col("cs") | (F.col("text") == F.col("exact")))))
    hits = hits.withColumn("line_no", F.coalesce("line_no", "rule")).join(_names(spark, single + phrases), "line_no")
    return hits.select(*MATCHES)


def phrase_matches(words: DataFrame, found: list[Rule]) -> DataFrame:
    """A match for each phrase rule at each place where all its words are timed and equal."""
    return _hits(words, found, False)


def flag(words: DataFrame, found: list[Rule]) -> DataFrame:
    """All matches: single words first, then phrases in file order, at each index (match_rank is that order in the job)."""
    by = Window.partitionBy("job_id").orderBy("word_index", F.col("span") > 1, "line_no")
    return _hits(words, found, True).withColumn("match_rank", F.row_number().over(by))


def term_search(words: DataFrame, query: str) -> DataFrame:
    """Occurrences of a word or phrase, case-insensitively; the query keeps its punctuation, words lose theirs."""
    tokens = tuple(query.split())
    if not tokens:
        raise ValueError("a search needs a word")
    # an open end counts as timed here, so it is filled for the search alone
    timed = words.withColumn("end", F.coalesce("end", "start"))
    rule = Rule(query, tokens, "exact", False, 1)
    return (single_matches if len(tokens) == 1 else phrase_matches)(timed, [rule]).drop("entry", "line_no")


def keep_by_context(matches: DataFrame, words: DataFrame, rules: DataFrame) -> DataFrame:
    """matches without those whose context says that they are meant otherwise.

    A rule (entry, near, before, after) drops an entry's match if the word `near`
    (any case, without punctuation around) is among the `before` words ahead of it or the
    `after` words behind it. Words that are near a place are joined with the
    matches there by (job, index, entry), so the cost follows the words that some rule
    names. A phrase's context lies around the whole phrase. Rules for other entries, and null widths, do nothing.
    """
    # saved, as it is read twice and far smaller than the words
    named = saved(words.withColumn("__near", F.lower(strip_punctuation(F.col("word")))).join(F.broadcast(rules.select("entry", F.lower("near").alias("__near"), "before", "after")), "__near").where("before > 0 or after > 0").select("job_id", "entry", "word_index", "before", "after"))
    # ahead of a match that starts at index + d, or behind one whose last word is at index - d
    ahead = named.where("before > 0").select("job_id", "entry", F.explode(F.expr("sequence(1, before)")).alias("__d"), "word_index").select("job_id", "entry", (F.col("word_index") + F.col("__d")).alias("__first"))
    behind = named.where("after > 0").select("job_id", "entry", F.explode(F.expr("sequence(1, after)")).alias("__d"), "word_index").select("job_id", "entry", (F.col("word_index") - F.col("__d")).alias("__last"))
    own = matches.withColumn("__first", F.col("word_index")).withColumn("__last", F.col("word_index") + F.col("span") - 1)
    # places are several times the words that the size of a table shows, so they are not broadcast
    return own.join(ahead.hint("merge"), ["job_id", "entry", "__first"], "left_anti").join(behind.hint("merge"), ["job_id", "entry", "__last"], "left_anti").select(matches.columns)
