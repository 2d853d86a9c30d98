"""How stored assistant answers cite a site: per answer, per provider, per query, overall."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import find_all
from ..sources.dimensions import NEGATIVE_STEMS, POSITIVE_STEMS
from .skew import top_per_group


def clean_domain(domain: str) -> str:
    """Host without scheme, trailing slashes and a leading www., lower-cased."""
    bare = domain.replace("https://", "").replace("http://", "").rstrip("/")
    return bare.removeprefix("www.").lower()


def normalised_domain(domain: Column) -> Column:
    """``clean_domain`` for a column."""
    bare = F.regexp_replace(F.regexp_replace(domain, "https?://", ""), "/+$", "")
    return F.lower(F.regexp_replace(bare, r"^www\.", ""))


def _stems_in(text: Column, stems) -> Column:
    total = F.lit(0)
    for stem in stems:
        total = total + F.contains(text, F.lit(stem)).cast("int")
    return total


def citations(responses: DataFrame, domain: str, brand: str | None = None) -> DataFrame:
    """Citation measures of each answer: count, position in percent, clickable URL, sentiment around the first hit.

    Domain and brand are one alternation, the longer first, so a brand inside the domain is not counted twice.
    """
    host = clean_domain(domain)
    names = sorted({host, (brand or host).lower()}, key=len, reverse=True)
    names_pattern = "|".join(re.escape(n) for n in names)
    text = F.lower(F.coalesce("response_text", F.lit("")))
    hits = F.size(find_all(F.col("_text"), names_pattern)).cast("bigint")
    before = F.length(F.regexp_extract("_text", rf"(?s)^(.*?)(?:{names_pattern})", 1))
    staged = (
        responses.withColumn("_text", text)
        .withColumn("citation_count", hits)
        .withColumn("_first", F.when(F.col("citation_count") > 0, before))
    )
    first = F.col("_first")
    start = F.greatest(first - 100, F.lit(0))
    context = F.substring("_text", start + 1, first + 100 - start)
    staged = staged.withColumn("_context", context)
    good, bad = _stems_in(F.col("_context"), POSITIVE_STEMS), _stems_in(F.col("_context"), NEGATIVE_STEMS)
    return (
        staged.withColumn("cited", F.col("citation_count") > 0)
        .withColumn("position", F.round(first / F.greatest(F.length("_text"), F.lit(1)) * 100, 1))
        .withColumn("has_url", F.col("_text").rlike(rf"https?://(?:www\.)?{re.escape(host)}"))
        .withColumn(
            "sentiment",
            F.when(~F.col("cited"), "n/a").when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral"),
        )
        .drop("_text", "_first", "_context")
    )


def _failed() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) != ""


def by_provider(results: DataFrame) -> DataFrame:
    """Per provider: queries, errors, cited, rate (errors stay in the denominator), mean position, sentiments."""
    cited = F.col("cited")
    sums = results.groupBy("provider").agg(
        F.count("*").alias("total_queries"),
        F.count_if(_failed()).alias("errors"),
        F.count_if(cited).alias("cited_count"),
        F.round(F.avg(F.when(cited, F.col("position"))), 1).alias("avg_position"),
        *[F.count_if(cited & (F.col("sentiment") == s)).alias(s) for s in ("positive", "neutral", "negative")],
    )
    return sums.withColumn("citation_rate", F.round(F.col("cited_count") / F.col("total_queries") * 100, 1))


def by_query(results: DataFrame) -> DataFrame:
    """Per query: answers in all and answers that cite."""
    return results.groupBy("query").agg(
        F.count("*").alias("providers_total"), F.count_if("cited").alias("providers_cited")
    )


def query_lists(per_query: DataFrame, n: int = 10) -> DataFrame:
    """Content gaps (cited by none) and strong queries (cited by all), the first ``n`` of each by query text."""
    kind = F.when(F.col("providers_cited") == 0, "gap").when(
        F.col("providers_cited") == F.col("providers_total"), "strong"
    )
    listed = per_query.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return top_per_group(listed, ["kind"], ["query"], n).select("kind", "rank", "query")


def overall(results: DataFrame) -> DataFrame:
    """All answers, failed answers, and the citation rate among the answers that did not fail."""
    fine = ~_failed()
    return results.agg(
        F.count("*").alias("total_probes"),
        F.count_if(fine).alias("successful_probes"),
        F.count_if(_failed()).alias("errors"),
        F.round(F.count_if(F.col("cited") & fine) / F.greatest(F.count_if(fine), F.lit(1)) * 100, 1).alias(
            "overall_citation_rate"
        ),
    )


def roll_up(results: DataFrame) -> DataFrame:
    """Provider, query and overall counts in one pass: GROUPING SETS ((provider), (query), ())."""
    results = results.withColumn("_failed", _failed())
    return (
        results.groupingSets([[F.col("provider")], [F.col("query")], []], F.col("provider"), F.col("query"))
        .agg(
            F.grouping_id().alias("_g"),
            F.count("*").alias("answers"),
            F.count_if("_failed").alias("errors"),
            F.count_if("cited").alias("cited"),
        )
        .withColumn("level", F.when(F.col("_g") == 1, "provider").when(F.col("_g") == 2, "query").otherwise("overall"))
        .select("level", "provider", "query", "answers", "errors", "cited")
    )
