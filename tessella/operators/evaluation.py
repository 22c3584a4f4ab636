"""Scores of answers, samples, quotas, resuming and failure streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases by which an answer declines; scores depend on them.
DECLINES = ("don't have enough information", "do not have enough information", "not in the data", "cannot answer", "can't answer", "no information")
#: Types of question that have no gold documents by design.
NO_GOLD = ("info_not_found", "high_level")


def declines(answer: Column) -> Column:
    """An empty answer, or one with a declining phrase."""
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return (low == "") | low.rlike("|".join(DECLINES))


def score_each(questions: DataFrame, answers: DataFrame, traces: DataFrame) -> DataFrame:
    """A row for each question (question_id, question_type, gold): answered, abstained, recall, precision, extra.

    answers: question_id, answer, cited; traces: question_id, abstained. Nothing cited scores 0; without gold the
    scores are null, but a type that should have gold has recall 0.
    """
    joined = questions.join(answers, "question_id", "left").join(traces.select("question_id", F.col("abstained").alias("traced")), "question_id", "left")
    cited, gold = F.array_distinct(F.coalesce("cited", F.array().cast("array<string>"))), F.array_distinct(F.coalesce("gold", F.array().cast("array<string>")))
    answered = F.col("answer").isNotNull()
    abstained = answered & F.coalesce("traced", (F.size(cited) == 0) & declines(F.col("answer")))
    common = F.size(F.array_intersect(cited, gold))
    scored, missing = answered & (F.size(gold) > 0), answered & (F.size(gold) == 0) & ~F.col("question_type").isin(*NO_GOLD)
    recall = F.when(scored, common / F.size(gold)).when(missing, F.lit(0.0))
    precision = F.when(scored, F.when(F.size(cited) == 0, F.lit(0.0)).otherwise(common / F.greatest(F.size(cited), F.lit(1))))
    extra = F.when(scored, F.size(F.array_except(cited, gold)))
    return joined.select("question_id", "question_type", answered.alias("answered"), abstained.alias("abstained"), (F.size(gold) > 0).alias("has_gold"), recall.alias("recall"), precision.alias("precision"), extra.alias("extra"))


def score_types(each: DataFrame) -> DataFrame:
    """Per type: averages and counts of answered, unanswered and abstained questions."""
    return each.groupBy("question_type").agg(
        F.count_if("answered").alias("answered"),
        F.count_if(~F.col("answered")).alias("unanswered"),
        F.count_if("abstained").alias("abstained"),
        F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg("precision"), 6).alias("precision"),
        F.round(F.avg("extra"), 6).alias("extra"),
    )


def score_totals(each: DataFrame) -> DataFrame:
    """One row over all: pooled averages of questions with gold, false confidence and abstention where there is nothing to find."""
    none, gold = (F.col("question_type") == "info_not_found") & F.col("answered"), F.col("has_gold") & F.col("answered")
    share = lambda a, b: F.round(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 6)
    return each.agg(
        F.round(F.avg(F.when(gold, F.col("recall"))), 6).alias("recall"),
        F.round(F.avg(F.when(gold, F.col("precision"))), 6).alias("precision"),
        share(none & ~F.col("abstained"), none).alias("false_confidence"),
        share(none & F.col("abstained"), none).alias("abstention_accuracy"),
        share(gold & F.col("abstained"), gold).alias("false_abstention"),
    )


def prf(found: Column, gold: Column) -> list[Column]:
    """precision, recall and f1 of two sets as arrays; 0 if either is empty."""
    f, g = F.array_distinct(found), F.array_distinct(gold)
    common = F.size(F.array_intersect(f, g))
    empty = (F.size(f) == 0) | (F.size(g) == 0)
    p, r = (F.when(empty, F.lit(0.0)).otherwise(common / F.greatest(F.size(x), F.lit(1))) for x in (f, g))
    both = F.when((p + r) == 0, F.lit(0.0)).otherwise(2 * p * r / F.when((p + r) == 0, F.lit(1.0)).otherwise(p + r))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(both, 6).alias("f1")]


def failed(abstained: Column, reason: Column, calls: Column) -> Column:
    """An abstention that came from an error: the router's, or no reason and no call at all."""
    empty = F.coalesce(reason, F.lit("")) == ""
    return F.coalesce(abstained, F.lit(False)) & (F.coalesce(reason, F.lit("")).startswith("router error") | (empty & (F.coalesce(calls, F.lit(0)) == 0)))


def streak(rows: DataFrame, part: list[str], order: list[str], bad: Column, limit: int) -> DataFrame:
    """rows with the length of the run of bad rows so far, and whether a run has reached the limit before or here (0: never)."""
    w = Window.partitionBy(*part).orderBy(*order)
    marked = rows.withColumn("_bad", bad).withColumn("_island", F.count_if(~bad).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*part, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("streak", F.count_if("_bad").over(run))
    tripped = F.max(F.col("streak") >= limit).over(w.rowsBetween(Window.unboundedPreceding, 0)) if limit else F.lit(False)
    return counted.withColumn("tripped", tripped).drop("_bad", "_island")


def head_of_each(rows: DataFrame, part: str, order: list[str], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(part).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def stratified(rows: DataFrame, part: str, order: list[str], n: int) -> DataFrame:
    """The first rows of each part, in proportion to its size, one at least; halves round to even."""
    counts = rows.groupBy(part).agg(F.count("*").alias("_size"))
    total = counts.agg(F.sum("_size").alias("_total"))
    want = F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("_size") / F.col("_total"), 0).cast("int"))
    wanted = counts.crossJoin(F.broadcast(total)).select(part, want.alias("_want"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(part).orderBy(*order))).join(wanted, part).where("_n <= _want").drop("_n", "_want")


def quota(counts: DataFrame, n: int) -> DataFrame:
    """source, take from counts (source, size): shares of n by largest remainder, one at least and no more than there is.

    Shortfall goes one at a time by remainder, round and round; excess comes off the largest shares, one each, never
    below one. There is a row for each source, so the windows here are as small.
    """
    whole = Window.partitionBy(F.lit(1))
    exact = F.lit(n) * F.col("size") / F.sum("size").over(whole)
    rows = counts.withColumn("exact", exact).withColumn("base", F.greatest(F.lit(1), F.floor("exact")))
    rows = rows.withColumn("short", F.lit(n) - F.sum("base").over(whole)).withColumn("sources", F.count("*").over(whole))
    rows = rows.withColumn("up", F.row_number().over(whole.orderBy(F.desc(F.col("exact") - F.floor("exact")), "source"))).withColumn("down", F.row_number().over(whole.orderBy(F.desc("base"), "source")))
    more = F.when(F.col("short") > 0, F.floor(F.col("short") / F.col("sources")) + (F.col("up") <= F.col("short") % F.col("sources")).cast("long"))
    less = F.when((F.col("short") < 0) & (F.col("down") <= -F.col("short")) & (F.col("base") > 1), F.lit(-1))
    return rows.select("source", F.least(F.col("base") + F.coalesce(more, less, F.lit(0)), F.col("size")).cast("long").alias("take"))


def hash_sample(rows: DataFrame, part: str, key: str, quotas: DataFrame, seed: int) -> DataFrame:
    """`take` rows of each part, chosen by a hash of seed, part and key: the same everywhere and at any parallelism."""
    at = F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col(part).cast("string"), F.col(key).cast("string")))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(part).orderBy(at, key))).join(quotas, part).where("_n <= take").drop("_n", "take")


def still_to_do(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def attempted(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_semi")
