"""Corpus quality: token retention, run summaries, regressions, diagnostics, expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Metrics of a summary: +1 where more is better.
METRICS = {"retention_mean": 1, "spurious_mean": -1, "warning_rate": -1, "failure_rate": -1}


def token_counts(texts: DataFrame, key: str, source: Column, output: Column) -> DataFrame:
    """key, token, a and b: how often the source and the output of each text have it (one pass, one shuffle)."""
    side = lambda tokens, a: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(a).cast("long").alias("a"), F.lit(1 - a).cast("long").alias("b")))
    both = texts.select(key, F.explode(F.concat(side(source, 1), side(output, 0))).alias("x"))
    return both.groupBy(key, F.col("x.token").alias("token")).agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b"))


def retention(counts: DataFrame, key: str) -> DataFrame:
    """Share of the source's tokens found in the output, and of the output's tokens not in the source; counts: see ``token_counts``."""
    sums = counts.groupBy(key).agg(
        F.sum("a").alias("source_tokens"), F.sum("b").alias("output_tokens"), F.sum(F.least("a", "b")).alias("shared"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("spurious"),
    )
    ratio = lambda x, y: F.when(F.col(y) > 0, F.round(F.col(x) / F.col(y), 6))
    return sums.select(key, "source_tokens", "output_tokens", ratio("shared", "source_tokens").alias("retention"), ratio("spurious", "output_tokens").alias("spurious_rate"))


def missing_tokens(counts: DataFrame, key: str, top: int = 20) -> DataFrame:
    """The tokens that the output lacks most."""
    both = counts.withColumn("missing", F.col("a") - F.col("b")).where("missing > 0")
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("missing"), "token"))
    return both.withColumn("rank", rank).where(F.col("rank") <= top).select(key, "rank", "token", "missing")


def summarize(runs: DataFrame) -> DataFrame:
    """Rates, means, median and 95th percentile (interpolated) of each run, overall (format null) and by format."""
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    grouped = runs.groupingSets([["run"], ["run", "format"]], "run", "format")
    return grouped.agg(
        F.count("*").alias("count"), rate(F.col("failed")).alias("failure_rate"), rate(F.col("has_warning")).alias("warning_rate"),
        F.round(F.avg("retention"), 6).alias("retention_mean"), F.count("retention").alias("retention_samples"), F.round(F.avg("spurious"), 6).alias("spurious_mean"),
        F.round(F.percentile("elapsed_ms", F.lit(0.5)), 3).alias("median_ms"), F.round(F.percentile("elapsed_ms", F.lit(0.95)), 3).alias("p95_ms"),
    )


def code_histogram(runs: DataFrame) -> DataFrame:
    codes = runs.select("run", F.explode(F.filter(F.array("code_a", "code_b"), lambda c: c.isNotNull())).alias("code"))
    counts = codes.groupBy("run", "code").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("run").orderBy(F.desc("n"), "code")))


def regressions(summary: DataFrame, tolerance: float) -> DataFrame:
    """Metrics of the current run that are worse than the baseline's by more than tolerance percentage points."""
    long = summary.select("run", "format", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(d).alias("better")) for m, d in METRICS.items()])).alias("m")).select("run", F.coalesce("format", F.lit("overall")).alias("scope"), "m.*")
    now, base = long.where("run = 'current'").drop("run"), long.where("run = 'baseline'").select("scope", "metric", F.col("value").alias("baseline"))
    delta = F.round((F.col("value") - F.col("baseline")) * 100, 3)
    return now.join(base, ["scope", "metric"]).select("scope", "metric", delta.alias("delta_points"), F.coalesce(delta * F.col("better") < -tolerance, F.lit(False)).alias("regressed"))


def file_regressions(runs: DataFrame, tolerance: float) -> DataFrame:
    """By file: lost retention, new failures, new warning codes."""
    codes = F.filter(F.array("code_a", "code_b"), lambda c: c.isNotNull())
    own = runs.select("file_id", "run", "retention", "failed", codes.alias("codes"))
    a = own.where("run = 'current'").drop("run").alias("a")
    b = own.where("run = 'baseline'").drop("run").alias("b")
    both = a.join(b, F.col("a.file_id") == F.col("b.file_id"))
    drop = F.round((F.col("b.retention") - F.col("a.retention")) * 100, 3)
    lost = both.where(drop > tolerance).select(F.col("a.file_id").alias("file_id"), F.lit("retention_drop").alias("kind"), drop.cast("string").alias("detail"))
    failed = both.where(~F.col("b.failed") & F.col("a.failed")).select(F.col("a.file_id").alias("file_id"), F.lit("new_failure").alias("kind"), F.lit(None).cast("string").alias("detail"))
    fresh = both.select(F.col("a.file_id").alias("file_id"), F.lit("new_warning").alias("kind"), F.explode(F.array_except("a.codes", "b.codes")).alias("detail"))
    return lost.unionByName(failed).unionByName(fresh)


def grouped_diagnostics(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("doc_id", "code", "severity").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("code", "severity")))


def coalesced_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """One row for equal diagnostics, with how many there were and the first of them."""
    return diagnostics.groupBy("doc_id", "code", "node_id", "message", "severity").agg(F.count("*").alias("n"), F.min("diag_id").alias("first_id"))


def review_required(items: DataFrame, kinds=("page", "ocr", "table", "sharing", "image")) -> DataFrame:
    return items.groupBy("doc_id").agg(F.bool_or(F.col("kind").isin(*kinds)).alias("required"), F.count("*").alias("n_items"))


def export_summary(nodes: DataFrame) -> DataFrame:
    """Counters of a document's nodes."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return nodes.groupBy("doc_id").agg(
        F.count("*").alias("nodes"), n("Heading").alias("headings"), n("ListItem").alias("list_items"), n("Image").alias("images"), n("Comment", "Footnote").alias("notes"),
        F.count_if(F.col("layer") == "Hidden").alias("hidden"), F.count_distinct("part_uri").alias("parts"),
    )


def expectations(outputs: DataFrame, checks: DataFrame) -> DataFrame:
    """Checks of output texts: contains, not_contains, unique, regex, count (between least and most).

    checks: target, id, severity, type, value, least, most; outputs: target, text.  The two are joined by target.
    """
    both = outputs.join(checks, "target")
    text, value = F.col("text"), F.col("value")
    times = ((F.length(text) - F.length(F.replace(text, value, F.lit("")))) / F.length(value)).cast("long")
    passed = (
        F.when(F.col("type") == "contains", times > 0).when(F.col("type") == "not_contains", times == 0).when(F.col("type") == "unique", times == 1)
        .when(F.col("type") == "regex", F.regexp_like(text, value)).otherwise(times.between(F.col("least"), F.col("most")))
    )
    return both.select("target", "id", "severity", passed.alias("passed"))


def expectation_summary(results: DataFrame) -> DataFrame:
    """Passed and failed checks by severity; a failed guard fails the run."""
    return results.groupBy("severity").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), (F.bool_or(~F.col("passed")) & (F.first("severity") == "guard")).alias("fails_run"))


def output_collisions(outputs: DataFrame) -> DataFrame:
    """Targets (without case) that more than one input writes."""
    return outputs.groupBy(F.lower("target").alias("target")).agg(F.count_distinct("input").alias("n")).where("n > 1")


def capability_verdict(statuses: DataFrame, key: str) -> DataFrame:
    """Whether what an installation can do suffices, by key.

    statuses: key, id, tier (required, optional), status, provider, satisfied_by.  Plainly all required ones must be ready;
    strictly all must, but for an optional one whose stand-in (the provider in satisfied_by) is ready.
    """
    ready = statuses.where("status = 'ready'").select(key, F.col("provider").alias("satisfied_by")).distinct().withColumn("_stands_in", F.lit(True))
    own = statuses.join(ready, [key, "satisfied_by"], "left")
    unready, optional = F.col("status") != "ready", F.col("tier") == "optional"
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("id")))), ",")
    out = own.groupBy(key).agg(
        F.bool_and(~((F.col("tier") == "required") & unready)).alias("required_ready"), listed(optional & unready).alias("optional_gaps"),
        listed(unready & ~(optional & F.coalesce("_stands_in", F.lit(False)))).alias("strict_failures"),
    )
    return out.withColumns({"exit_code": F.when(F.col("required_ready"), 0).otherwise(1), "strict_exit_code": F.when(F.col("strict_failures") == "", 0).otherwise(1)})
