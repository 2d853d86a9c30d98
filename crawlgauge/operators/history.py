"""Monitoring: composite scores, changes between consecutive runs, report roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import band, card_colour, layer_colour, mean_of_present, schema_score, whole
from .skew import previous_values, top_per_group, trailing_sums

STEP = 5


def composite(scores: DataFrame) -> DataFrame:
    """Mean, cut, of the main, advanced and validator scores that are present."""
    parts = [F.col(c) for c in ("main", "advanced", "validator")]
    return scores.withColumn("composite", whole(mean_of_present(*parts)))


def change_kind(delta: Column, step: int = STEP) -> Column:
    return F.when(delta <= -step, "regression").when(delta >= step, "improvement")


def layer_changes(runs: DataFrame, order=("run_ts",), period: str = "month") -> DataFrame:
    """Score of each run and layer against the run before: (site, layer, run_ts, score, prev_score, delta, change).

    Runs without a score are skipped. ``period`` is the stretch of history one task sorts.
    """
    scored = runs.where(F.col("score").isNotNull()).withColumn("_period", F.date_trunc(period, "run_ts"))
    before = previous_values(scored, ["site", "layer"], list(order), ["score"], "_period").drop("_period")
    delta = F.col("score") - F.col("prev_score")
    return before.withColumn("delta", delta).withColumn("change", change_kind(F.col("delta")))


def run_pairs(history: DataFrame) -> DataFrame:
    """Consecutive runs of each site: (site, run_ts, next_ts, n). Findings are reduced to runs before the window."""
    runs = history.groupBy("site", "run_ts").agg(F.count("*").alias("n"))
    by_site = Window.partitionBy("site").orderBy("run_ts")
    return runs.withColumn("next_ts", F.lead("run_ts").over(by_site))


def _appeared_and_gone(facts: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Set difference between consecutive runs: (site, run_ts, key, change) with change 'new' or 'gone'.

    Each fact is counted as +1 in its run and -1 in the next; what does not cancel has changed. One aggregation per
    (site, key, run), no self-join.
    """
    distinct = facts.select("site", "run_ts", key).distinct()
    placed = distinct.join(runs, ["site", "run_ts"])
    here = placed.select("site", "run_ts", key, F.lit(1).alias("d"))
    after = placed.where(F.col("next_ts").isNotNull()).select(
        "site", F.col("next_ts").alias("run_ts"), key, F.lit(-1).alias("d")
    )
    first = runs.groupBy("site").agg(F.min("run_ts").alias("first_ts"))
    changed = (
        here.unionByName(after).groupBy("site", "run_ts", key).agg(F.sum("d").alias("d")).where(F.col("d") != 0)
    )
    return (
        changed.join(first, "site")
        .where(F.col("run_ts") > F.col("first_ts"))
        .select("site", "run_ts", key, F.when(F.col("d") > 0, "new").otherwise("gone").alias("change"))
    )


def failure_changes(history: DataFrame) -> DataFrame:
    """Checks that started or stopped failing, by ``check_id``: (site, run_ts, check_id, change)."""
    fails = history.where(F.col("status") == "fail")
    return _appeared_and_gone(fails, run_pairs(history), "check_id")


def type_changes(types: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Structured-data types that appeared or vanished between runs: (site, run_ts, schema_type, change)."""
    return _appeared_and_gone(types, run_pairs(types) if runs is None else runs, "schema_type")


def first_changes(changes: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first ``n`` changes of each kind per run, as the diff report lists them."""
    return top_per_group(changes, ["site", "run_ts", "change"], [key], n)


def diff_status(layers: DataFrame, failures: DataFrame, types: DataFrame) -> DataFrame:
    """Regressions, improvements and status per site and run; all changes count, whatever the report lists."""

    def counted(df: DataFrame, bad: Column, good: Column) -> DataFrame:
        return df.groupBy("site", "run_ts").agg(
            F.count_if(bad).alias("regressions"), F.count_if(good).alias("improvements")
        )

    change = F.col("change")
    by_layer = counted(layers, change == "regression", change == "improvement")
    by_failure = counted(failures, change == "new", change == "gone")
    by_type = counted(types, change == "gone", change == "new")
    totals = (
        by_layer.unionByName(by_failure)
        .unionByName(by_type)
        .groupBy("site", "run_ts")
        .agg(F.sum("regressions").alias("regressions"), F.sum("improvements").alias("improvements"))
    )
    return totals.withColumn("status", status_of(F.col("regressions"), F.col("improvements")))


def status_of(regressions: Column, improvements: Column) -> Column:
    return (
        F.when(regressions > improvements, "REGRESSION").when(improvements > 0, "IMPROVEMENT").otherwise("STABLE")
    )


def alerts(diffs: DataFrame) -> DataFrame:
    return diffs.where(F.col("status") == "REGRESSION")


def score_trend(runs: DataFrame, order=("run_ts",), period: str = "month") -> DataFrame:
    """Scores in time order with the score before; label to the minute, as charts show it."""
    changes = layer_changes(runs, order, period)
    return changes.withColumn("label", F.date_format("run_ts", "yyyy-MM-dd HH:mm"))


def composite_trend(scores: DataFrame, order=("run_ts",), period: str = "month") -> DataFrame:
    """Composite score of each run with the one before: (site, run_ts, score, prev_score, delta, label)."""
    runs = composite(scores).select("site", F.lit("composite").alias("layer"), *order, F.col("composite").cast("double").alias("score"))
    return score_trend(runs, order, period).drop("layer", "change")


def moving_mean(runs: DataFrame, days: int = 30, period: str = "month") -> DataFrame:
    """Mean of the scores of the last ``days`` days beside each score: ``mean`` and the number of runs in it, ``n_runs``.

    A run exactly ``days`` days before counts, and so do all runs of the same time. Runs without a score are skipped.
    Scores are added up with six decimals.
    """
    scored = runs.where(F.col("score").isNotNull()).withColumns(
        {"_score": F.col("score").cast("decimal(18,6)"), "_n": F.lit(1).cast("bigint")}
    )
    sums = trailing_sums(scored, ["site", "layer"], "run_ts", ["_score", "_n"], f"{days} DAYS", period)
    mean = F.col("sum__score").cast("double") / F.col("sum__n")
    return sums.withColumns({"mean": mean, "n_runs": F.col("sum__n")}).drop("_score", "_n", "sum__score", "sum__n")


#: Registers of the distinct-count sketches as a power of two; their standard error is 1.04 / sqrt(registers).
SKETCH_BITS = 12


def daily_sketches(runs: DataFrame) -> DataFrame:
    """One row for each layer and day: runs, and mergeable sketches of the sites that ran and of their scores.

    (layer, day, n_runs, sites, scores); rows without a score count as runs only.
    """
    day = F.date_trunc("day", "run_ts").alias("day")
    return runs.groupBy("layer", day).agg(
        F.count("*").alias("n_runs"),
        F.hll_sketch_agg("site", SKETCH_BITS).alias("sites"),
        F.kll_sketch_agg_double(F.col("score").cast("double")).alias("scores"),
    )


def merged_sketches(daily: DataFrame, period: str = "month") -> DataFrame:
    """From the daily sketches alone: runs, about how many sites ran, and about the median score.

    (layer, period, n_runs, n_sites, median); the median's rank is off by some 1.3 % in one of a hundred cases.
    """
    merged = daily.groupBy("layer", F.date_trunc(period, "day").alias("period")).agg(
        F.sum("n_runs").alias("n_runs"),
        F.hll_sketch_estimate(F.hll_union_agg("sites")).alias("n_sites"),
        F.kll_merge_agg_double("scores").alias("_scores"),
    )
    return merged.withColumn("median", F.kll_sketch_get_quantile_double("_scores", F.lit(0.5))).drop("_scores")


def finding_counts(findings: DataFrame) -> DataFrame:
    """ok / fail / warn over all findings of all modules, per site."""
    return findings.groupBy("site").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "fail", "warn")])


def after_core(findings: DataFrame) -> DataFrame:
    """Findings of the quality modules with report positions behind those of the core audit, module by module."""
    place = {"performance": 1000, "accessibility": 2000, "content": 3000}
    offset = F.coalesce(*[F.when(F.col("module") == m, n) for m, n in place.items()], F.lit(4000))
    return findings.withColumn("ord", F.col("ord") + offset)


def top_recommendations(findings: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` problems per site: fails in report order, then warnings."""
    problems = findings.where(F.col("status").isin("fail", "warn"))
    first = [F.desc(F.col("status") == "fail"), "ord", "module", "check_id", F.coalesce("detail", F.lit(""))]
    return top_per_group(problems, ["site"], first, n).select(
        "site", "rank", "module", "check_id", "status", "detail"
    )


def core_module_status(findings: DataFrame) -> DataFrame:
    """A core module fails when any of its findings does."""
    failing = F.coalesce(F.bool_or(F.col("status") == "fail"), F.lit(False))
    return findings.groupBy("site", "module").agg(
        F.when(failing, "fail").otherwise("ok").alias("status"), F.count("*").alias("n_findings")
    )


def scored_module_status(scores: DataFrame) -> DataFrame:
    """ok from 80, warn from 50, else fail, for (site, module, score) rows."""
    return scores.withColumn("status", band(F.col("score"), (80, "ok"), (50, "warn"), default="fail"))


def layer_scores(core: DataFrame, modules: DataFrame, validator: DataFrame) -> DataFrame:
    """The score table of the report: one row per site and layer with its colour."""
    both = core.select("site", F.col("score").alias("main")).join(modules, "site", "full").join(
        validator.select("site", schema_score(F.col("errors"), F.col("warnings")).alias("validator")), "site", "full"
    )
    layers = ("main", "performance", "accessibility", "content", "validator")
    rows = F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).cast("bigint").alias("score")) for n in layers])
    return (
        both.select("site", F.explode(rows).alias("r"))
        .select("site", "r.*")
        .where(F.col("score").isNotNull())
        .withColumn("colour", layer_colour(F.col("score")))
    )


def headline_cards(categories: DataFrame, core: DataFrame) -> DataFrame:
    """Four headline scores per site; SEO falls back to the core score when it is missing or 0."""
    joined = categories.join(core.select("site", F.col("score").alias("main")), "site", "left")
    cards = (
        ("performance", F.col("performance")),
        ("accessibility", F.col("accessibility")),
        ("best_practices", F.col("best_practices")),
        ("seo", F.coalesce(F.nullif("seo", F.lit(0)), F.col("main"))),
    )
    rows = F.array(*[F.struct(F.lit(n).alias("card"), c.cast("bigint").alias("score")) for n, c in cards])
    return (
        joined.select("site", F.explode(rows).alias("r"))
        .select("site", "r.*")
        .withColumn("colour", card_colour(F.col("score")))
    )


def gates(
    core: DataFrame, validator: DataFrame, categories: DataFrame | None = None, citation_rates: DataFrame | None = None
) -> DataFrame:
    """Pass / fail per site and gate: no core fails, no schema errors, category mean >= 80, citation rate >= 30."""
    tables = [
        core.select("site", F.lit("core").alias("gate"), (F.col("fail") == 0).alias("passed")),
        validator.select("site", F.lit("schema").alias("gate"), (F.col("errors") == 0).alias("passed")),
    ]
    if categories is not None:
        mean = sum(F.col(c) for c in ("performance", "accessibility", "best_practices", "seo")) / 4
        tables.append(categories.select("site", F.lit("pagespeed").alias("gate"), (mean >= 80).alias("passed")))
    if citation_rates is not None:
        tables.append(
            citation_rates.select(
                "site", F.lit("citation").alias("gate"), (F.col("overall_citation_rate") >= 30).alias("passed")
            )
        )
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out
