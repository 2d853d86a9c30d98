"""Stored page-speed responses (one JSON document per row) to scores, metrics, opportunities and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonld import elements, field, part
from ..functions.rows import each
from ..functions.scoring import psi_band
from ..sources.dimensions import ACCESSIBILITY_AUDITS, FIELD_METRICS, LAB_METRICS, OPPORTUNITY_AUDITS
from .skew import top_per_group

KEYS = ["url", "strategy"]
CATEGORIES = (
    ("performance", "performance"),
    ("accessibility", "accessibility"),
    ("best_practices", "best-practices"),
    ("seo", "seo"),
)


def parsed(responses: DataFrame) -> DataFrame:
    return responses.withColumn("v", F.try_parse_json("body"))


def _audits(v: Column) -> Column:
    return part(v, "$.lighthouseResult.audits")


def category_scores(psi: DataFrame) -> DataFrame:
    """The four scores, 0-100, rounded; a missing score is 0."""

    def score(key: str) -> Column:
        raw = part(F.col("v"), f'$.lighthouseResult.categories["{key}"].score', "double")
        return F.coalesce(F.round(raw * 100), F.lit(0)).cast("bigint")

    return psi.select(*KEYS, *[score(key).alias(name) for name, key in CATEGORIES])


def score_bands(scores: DataFrame) -> DataFrame:
    """One row per response and category with its band."""
    rows = F.array(*[F.struct(F.lit(n).alias("category"), F.col(n).alias("score")) for n, _ in CATEGORIES])
    return (
        scores.select(*KEYS, F.explode(rows).alias("r"))
        .select(*KEYS, "r.*")
        .withColumn("band", psi_band(F.col("score")))
    )


def lab_metrics(psi: DataFrame) -> DataFrame:
    """Six lab metrics, one row each: display value, number, score and band."""

    def metric(name: str, key: str) -> Column:
        audit = field(_audits(F.col("v")), key)
        return F.struct(
            F.lit(name).alias("metric"),
            F.coalesce(field(audit, "displayValue", "string"), F.lit("—")).alias("display"),
            field(audit, "numericValue", "double").alias("numeric"),
            field(audit, "score", "double").alias("score"),
        )

    rows = F.array(*[metric(name, key) for name, key in LAB_METRICS])
    return (
        each(psi, KEYS, rows, "m")
        .select(*KEYS, "m.*")
        .withColumn("band", psi_band(F.col("score"), 0.9, 0.5))
    )


def field_metrics(psi: DataFrame) -> DataFrame:
    """Real-user metrics that are present: value as shown, and category. CLS is stored in hundredths."""
    metrics = part(F.col("v"), "$.loadingExperience.metrics")

    def metric(name: str, key: str) -> Column:
        m = field(metrics, key)
        p = field(m, "percentile", "double")
        number = field(m, "percentile", "string")
        if name == "CLS":
            shown = F.format_string("%.3f", p / 100)
        else:
            shown = F.concat(number, F.lit(" ms")) if "MS" in key else number
        present = F.when(
            m.isNotNull(),
            F.struct(
                F.lit(name).alias("metric"),
                shown.alias("value"),
                F.coalesce(field(m, "category", "string"), F.lit("")).alias("category"),
            ),
        )
        return present

    rows = F.array_compact(F.array(*[metric(name, key) for name, key in FIELD_METRICS]))
    return each(psi, KEYS, rows, "m").select(*KEYS, "m.*")


def _first_sentence(text: Column) -> Column:
    return F.concat(F.substring_index(F.coalesce(text, F.lit("")), ".", 1), F.lit("."))


def _kb(size: Column) -> Column:
    return F.coalesce(F.round(size / 1024), F.lit(0)).cast("bigint")


def _audit_rows(psi: DataFrame, ids) -> DataFrame:
    """The listed audits that are present: (url, strategy, ord, id, a)."""
    audits = _audits(F.col("v"))
    listed = [
        F.struct(F.lit(i).alias("ord"), F.lit(key).alias("id"), field(audits, key).alias("a"))
        for i, key in enumerate(ids)
    ]
    present = F.filter(F.array(*listed), lambda r: r["a"].isNotNull())
    return (
        each(psi, KEYS, present, "r")
        .select(*KEYS, "r.*")
        .withColumn("score", field(F.col("a"), "score", "double"))
        .withColumn("title", F.coalesce(field(F.col("a"), "title", "string"), F.col("id")))
        .withColumn("description", _first_sentence(field(F.col("a"), "description", "string")))
        .withColumn(
            "items",
            F.coalesce(elements(part(F.col("a"), "$.details.items")), F.array().cast("array<variant>")),
        )
        .withColumn("items_count", F.size("items").cast("bigint"))
    )


def opportunities(psi: DataFrame, top_n: int | None = 15) -> DataFrame:
    """Opportunity audits scoring under 0.9 with their savings; largest savings first."""
    a = F.col("a")

    def item(i: Column) -> Column:
        url = F.coalesce(
            F.nullif(part(i, "$.url", "string"), F.lit("")), F.nullif(part(i, "$.source.url", "string"), F.lit("")), F.lit("—")
        )
        return F.struct(
            url.alias("url"),
            F.coalesce(part(i, "$.wastedMs", "double"), F.lit(0.0)).alias("wasted_ms"),
            _kb(part(i, "$.wastedBytes", "double")).alias("wasted_kb"),
        )

    found = (
        _audit_rows(psi, OPPORTUNITY_AUDITS)
        .where(F.col("score") < 0.9)
        .withColumn("display", F.coalesce(field(a, "displayValue", "string"), F.lit("")))
        .withColumn("savings_ms", F.coalesce(part(a, "$.details.overallSavingsMs", "double"), F.lit(0.0)))
        .withColumn("savings_kb", _kb(part(a, "$.details.overallSavingsBytes", "double")))
        .withColumn("items_top3", F.transform(F.slice("items", 1, 3), item))
    )
    kept = [
        *KEYS, "id", "title", "description", "score", "display", "savings_ms", "savings_kb", "items_count", "items_top3", "ord",
    ]
    found = found.select(*kept)
    if top_n is None:
        return found
    return top_per_group(found, KEYS, [F.desc("savings_ms"), F.desc("savings_kb"), "ord"], top_n)


def accessibility_issues(psi: DataFrame, top_n: int | None = 15) -> DataFrame:
    """Accessibility audits that did not pass, in list order."""

    def node(i: Column) -> Column:
        def text(name: str) -> Column:
            return F.coalesce(part(i, f"$.node.{name}", "string"), F.lit(""))

        return F.struct(
            text("selector").alias("selector"),
            F.replace(text("snippet"), F.lit("\n"), F.lit(" ")).alias("snippet"),
            text("explanation").alias("explanation"),
        )

    found = (
        _audit_rows(psi, ACCESSIBILITY_AUDITS)
        .where(F.col("score") != 1)
        .withColumn("items_top3", F.transform(F.slice("items", 1, 3), node))
        .select(*KEYS, "id", "title", "description", "items_count", "items_top3", "ord")
    )
    return found if top_n is None else top_per_group(found, KEYS, ["ord"], top_n)


def recommendations(found: DataFrame, issues: DataFrame, n_found: int = 8, n_issues: int = 5) -> DataFrame:
    """Texts of the first opportunities with their savings, then of the first accessibility issues."""
    savings = F.concat_ws(
        " ",
        F.when(F.col("savings_ms") > 0, F.concat(F.lit("-"), F.floor("savings_ms").cast("string"), F.lit("ms"))),
        F.when(F.col("savings_kb") > 0, F.concat(F.lit("-"), F.col("savings_kb").cast("string"), F.lit("KB"))),
    )
    text = F.when(savings != "", F.concat("title", F.lit(" ("), savings, F.lit(")"))).otherwise(F.col("title"))
    first = found.where(F.col("rank") <= n_found).select(*KEYS, F.lit(1).alias("part"), "rank", text.alias("text"))
    second = issues.where(F.col("rank") <= n_issues).select(
        *KEYS,
        F.lit(2).alias("part"),
        "rank",
        F.concat("title", F.lit(" ("), F.col("items_count").cast("string"), F.lit(")")).alias("text"),
    )
    return first.unionByName(second)
