"""Structured data (JSON-LD): objects, rule checks, page and site summaries, graph references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import jsonld as J
from ..functions.rows import each
from ..functions.scoring import schema_score
from ..sources.dimensions import RULE_SCHEMA, known_types, schema_rule_rows

OBJECT_KEYS = ["site", "page_id", "blob_pos", "obj_pos"]


def blobs(pages: DataFrame) -> DataFrame:
    """One row per JSON-LD script: (site, page_id, blob_pos, blob, v, is_valid)."""
    return (
        each(pages, ["site", "page_id"], H.jsonld_blobs(F.col("html")), "blob", "blob_pos")
        .withColumn("v", J.parse(F.col("blob")))
        .withColumn("is_valid", F.col("v").isNotNull())
    )


def types_anywhere(pages: DataFrame) -> DataFrame:
    """Distinct @type values at any depth, per site, with the number of pages that have them."""
    found = each(blobs(pages), ["site", "page_id"], J.types_anywhere(F.col("v")), "schema_type")
    return (
        found.dropDuplicates(["site", "page_id", "schema_type"])
        .groupBy("site", "schema_type")
        .agg(F.count("*").alias("pages"))
    )


def typed_nodes(pages: DataFrame) -> DataFrame:
    """Which types a page's structured data has and where: (site, page_id, blob_pos, path, schema_type)."""
    found = each(blobs(pages).where("is_valid"), ["site", "page_id", "blob_pos"], J.typed_nodes(F.col("v")), "node")
    return found.select("site", "page_id", "blob_pos", "node.*")


def declared_types(pages: DataFrame) -> DataFrame:
    """Types a page declares itself: at the top, in lists and inside @graph, not in other nested fields."""
    valid = blobs(pages).where("is_valid")
    return each(valid, ["site", "page_id"], J.declared_types(F.col("v")), "schema_type").distinct()


def objects(pages: DataFrame) -> DataFrame:
    """Objects that get validated: (site, page_id, blob_pos, obj_pos, obj, schema_type)."""
    valid = blobs(pages).where("is_valid")
    found = each(valid, ["site", "page_id", "blob_pos"], J.objects(F.col("v")), "obj", "obj_pos")
    return found.withColumn("schema_type", J.object_type(F.col("obj")))


def _rules(df: DataFrame, extra_rules) -> DataFrame:
    """The rule table, one row per check; the any-of fields of a type are one row. Built from Python rows."""
    rows, any_of = [], {}
    for schema_type, kind, field, fmt, ord_ in schema_rule_rows() + list(extra_rules or []):
        if kind == "any_of":
            any_of.setdefault(schema_type, (ord_, []))[1].append(field)
        else:
            rows.append((schema_type, kind, field, fmt, ord_))
    rows += [(t, "any_of", "|".join(fields), None, ord_) for t, (ord_, fields) in any_of.items()]
    return df.sparkSession.createDataFrame(rows, RULE_SCHEMA)


def _broken_rule() -> Column:
    """What is wrong with ``obj`` under the joined rule, NULL when nothing is."""
    obj, kind = F.col("obj"), F.col("kind")
    value = J.part(obj, F.concat(F.lit('$["'), F.col("field"), F.lit('"]')))
    given = J.members(obj)
    some_given = F.exists(F.split("field", r"\|"), lambda f: J.is_truthy(F.try_element_at(given, f)))
    return (
        F.when(kind.isin("required", "recommended"), F.when(~J.is_filled(value), "missing"))
        .when(kind == "any_of", F.when(~F.coalesce(some_given, F.lit(False)), "none_given"))
        .when(kind == "check", F.when(J.is_truthy(value), J.format_error(value, F.col("fmt"))))
    )


def _severity() -> Column:
    return F.when(F.col("kind") == "recommended", "warning").otherwise("error")


def issues(found: DataFrame, extra_rules: list[tuple] | None = None) -> DataFrame:
    """Broken rules of each object. Types without rules have no issues.

    The rule table is a few hundred rows made from Python values, so it is broadcast; each object is checked where
    it is, without a shuffle.
    """
    checked = found.join(F.broadcast(_rules(found, extra_rules)), "schema_type")
    return (
        checked.withColumn("detail", _broken_rule())
        .where(F.col("detail").isNotNull())
        .select(
            *OBJECT_KEYS, "schema_type", _severity().alias("severity"), F.col("kind").alias("rule"), "field", "detail", "ord"
        )
    )


def untyped_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages without any typed object: one warning each."""
    typed = found.where(F.col("schema_type") != "").select("site", "page_id")
    return (
        pages.select("site", "page_id")
        .join(typed, ["site", "page_id"], "left_anti")
        .select("site", "page_id", F.lit("warning").alias("severity"), F.lit("no_jsonld").alias("detail"))
    )


def page_reports(pages: DataFrame, extra_rules: list[tuple] | None = None) -> DataFrame:
    """Types, errors and warnings per page, from one pass over the HTML.

    Outer explodes keep pages without blobs or objects. Every object gives one row for itself (part 0) and one per
    rule of its type (part 1), so its type and its issues are counted in the same aggregation.
    """
    page = ["site", "page_id"]
    roots = pages.select(*page, F.posexplode_outer(H.jsonld_blobs(F.col("html"))).alias("blob_pos", "blob")).select(
        *page, "blob_pos", J.parse(F.col("blob")).alias("v")
    )
    found = roots.select(*page, "blob_pos", F.posexplode_outer(J.objects(F.col("v"))).alias("obj_pos", "obj")).withColumn(
        "schema_type", F.when(F.col("obj").isNotNull(), J.object_type(F.col("obj")))
    )
    parts = found.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    rules = _rules(pages, extra_rules).withColumn("part", F.lit(1))
    checked = parts.join(F.broadcast(rules), ["schema_type", "part"], "left").withColumn("detail", _broken_rule())
    typed = (F.col("part") == 0) & (F.col("schema_type") != "")
    listed = F.collect_list(F.when(typed, F.struct("blob_pos", "obj_pos", "schema_type")))

    def broken(severity: str) -> Column:
        return F.count_if(F.col("detail").isNotNull() & (_severity() == severity))

    counts = checked.groupBy(*page).agg(
        F.count_if(typed).alias("n_types"),
        F.array_join(F.transform(F.array_sort(listed), lambda t: t["schema_type"]), ",").alias("types"),
        broken("error").alias("errors"),
        broken("warning").alias("warnings"),
    )
    return counts.withColumn("warnings", F.col("warnings") + (F.col("n_types") == 0).cast("bigint"))


def site_summary(reports: DataFrame) -> DataFrame:
    """Pages, errors, warnings and the validator score per site."""
    sums = reports.groupBy("site").agg(
        F.count("*").alias("pages"),
        F.sum("errors").cast("bigint").alias("errors"),
        F.sum("warnings").cast("bigint").alias("warnings"),
    )
    return sums.withColumn("score", schema_score(F.col("errors"), F.col("warnings")))


def type_histogram(found: DataFrame) -> DataFrame:
    """How often each object type occurs per site, and whether it has rules."""
    return (
        found.where(F.col("schema_type") != "")
        .groupBy("site", "schema_type")
        .agg(F.count("*").alias("n"))
        .withColumn("is_known", F.col("schema_type").isin(*known_types()))
    )


def dangling_publishers(found: DataFrame) -> DataFrame:
    """publisher.@id references with no Organization of that @id on the same page."""
    wanted = found.select(
        *OBJECT_KEYS, J.text(J.part(F.col("obj"), '$.publisher["@id"]')).alias("ref")
    ).where(F.col("ref").isNotNull())
    defined = found.where(F.col("schema_type") == "Organization").select(
        "site", "page_id", J.text(J.field(F.col("obj"), "@id")).alias("ref")
    )
    return wanted.join(defined, ["site", "page_id", "ref"], "left_anti").select(*OBJECT_KEYS, "ref")
