"""Cross-tables, histograms and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

FAILED = "[INFERENCE_FAILED]"


def failure_class(tokens: Column) -> Column:
    """No input tokens: before the model; anything else, null included: in the model."""
    return F.when(tokens == 0, "pre_llm").otherwise("llm_stage")


def failures_by(runs: DataFrame, by: str) -> DataFrame:
    """Runs, failures, classes, means over failures and rate, with a row for every value even without failures."""
    bad = F.col("prediction") == FAILED
    pre = bad & (failure_class(F.col("input_tokens")) == "pre_llm")
    return runs.groupBy(by).agg(
        F.count("*").alias("n_runs"),
        F.count_if(bad).alias("n_failed"),
        F.count_if(pre).alias("n_pre_llm"),
        F.count_if(bad & ~pre).alias("n_llm_stage"),
        F.round(F.coalesce(F.avg(F.when(bad, F.col("latency_s"))), F.lit(0.0)), 6).alias("mean_latency_s"),
        F.round(F.coalesce(F.avg(F.when(bad, F.col("input_tokens"))), F.lit(0.0)), 6).alias("mean_input_tokens"),
        F.round(F.count_if(bad) / F.count("*"), 6).alias("failure_rate"),
    )


def crosstab_with_margins(df: DataFrame, a: str, b: str, missing: str = "(null)") -> DataFrame:
    """Counts of a x b with totals named All (told from nulls by the grouping id)."""
    out = df.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
    name = lambda c, g: F.when(F.col(g) == 1, "All").otherwise(F.coalesce(F.col(c).cast("string"), F.lit(missing)))
    return out.select(name(a, "ga").alias(a), name(b, "gb").alias(b), "n")


def histogram(df: DataFrame, group: str, attributes: Sequence[str]) -> DataFrame:
    """Counts and percent of each attribute's labels per group (long form)."""
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(null)"))
    long = df.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), label(c).alias("label")) for c in attributes])).alias("x")).select(group, "x.attribute", "x.label")
    n = long.groupBy(group, "attribute", "label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.Window.partitionBy(group, "attribute"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / total, 6))


def low_coverage(df: DataFrame, covariate: str, minimum: int) -> DataFrame:
    return df.groupBy(covariate).agg(F.count("*").alias("n")).where(F.col("n") < minimum)


def with_median(df: DataFrame, column: str, out: str) -> DataFrame:
    """Nulls of a column replaced by its exact median."""
    m = df.agg(F.median(column)).first()[0]
    return df.withColumn(out, F.coalesce(F.col(column).cast("double"), F.lit(m).cast("double")))


def failure_notes(prediction: Column, n_hit: Column, n_gold: Column, correct: Column) -> Column:
    """Tags of a run for inspection."""
    tag = lambda cond, name: F.when(cond, name)
    low = F.lower(F.coalesce(prediction, F.lit("")))
    return F.array_compact(
        F.array(
            tag(low.contains("insufficient information"), F.lit("abstained")),
            tag(prediction == FAILED, F.lit("inference failed")),
            tag((n_gold > 0) & (n_hit == n_gold) & ~correct, F.lit("full retrieval, wrong answer")),
            tag((n_gold > 0) & (n_hit == 0), F.lit("retrieval miss")),
            tag((n_hit > 0) & (n_hit < n_gold), F.lit("partial recall")),
        )
    )


def retrieved_list(found: Column, gold: Column) -> Column:
    """What was retrieved, numbered in order, gold marked. found, gold: arrays of ids."""
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.when(F.array_contains(gold, x), " [gold]").otherwise(""))
    return F.coalesce(F.array_join(F.transform(F.array_compact(found), line), "\n"), F.lit(""))


def missed_gold(found: Column, gold: Column) -> Column:
    """The gold that was not retrieved, sorted."""
    return F.array_join(F.array_sort(F.array_except(gold, F.coalesce(found, F.expr("cast(array() as array<string>)")))), ", ")
