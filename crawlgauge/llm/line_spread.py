"""Line dedup by distinct-site spread, with DataFrame functions only.

A HyperLogLog sketch of the sites of each line hash is built by aggregation, partial sketches merging before and after
the shuffle. Lines whose estimate is far from the threshold are decided by it; lines near it get an exact distinct
count. A line on at least ``MIN_SITES`` sites is boilerplate: it goes from every document but the first (least doc_id)
that has it, so each text stays somewhere.

Only line hashes, site hashes and ids are shuffled by line; whole texts move once, by doc_id, to lose their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgauge.llm.common import prepared, table, written

MIN_SITES = 10
#: Shorter lines (code points, spaces at the ends not counted) carry too little text to be called shared.
MIN_CHARS = 20
LG_K = 10
#: Relative error of the sketch at ``LG_K`` is about 3 %; estimates within this share of the threshold are counted anew.
NEAR = 0.25


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def line_table(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Narrow rows, written once: doc_id, site, key of every counted line, distinct within a row."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x)) >= min_chars)
    keys = F.array_distinct(F.transform(lines, _key))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("source").isNotNull(), F.xxhash64("source")).alias("site"), F.explode(keys).alias("key"))
    return written(rows, "lines")


def spread(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """Boilerplate lines: key, first_doc. ``lines`` has doc_id, site and key."""
    # exact and cheap: a line whose least and greatest site agree is on one site
    sketched = lines.groupBy("key").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("site").alias("low"), F.max("site").alias("high"), F.min("doc_id").alias("first_doc"))
    several = sketched.where("low < high") if min_sites > 1 else sketched.where("low IS NOT NULL")
    estimated = written(several.select("key", "first_doc", F.hll_sketch_estimate("sketch").cast("double").alias("sites")), "spread")
    low, high = min_sites * (1 - near), min_sites * (1 + near) + 1
    sure = estimated.where(F.col("sites") > high).select("key", "first_doc")
    unsure = estimated.where(F.col("sites").between(low, high)).select("key", "first_doc")
    pairs = lines.join(unsure.select("key"), "key", "left_semi").select("key", "site").distinct()
    counted = pairs.groupBy("key").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.unionByName(unsure.join(counted.select("key"), "key", "left_semi"))


def drop_lines(documents: DataFrame, lines: DataFrame, boilerplate: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """row (all columns of ``documents``), text_left (without its boilerplate lines), n_lines (counted lines), n_removed."""
    bad = (
        lines.join(boilerplate, "key")
        .where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("keys"))
    )
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    joined = rows.join(bad, F.col("row.doc_id").cast("long").eqNullSafe(bad.doc_id), "left").select("row", "keys")
    text = F.col("row.text")
    split = F.split(text, "\n", -1)
    counted = lambda x: F.length(F.trim(x)) >= min_chars
    left = F.filter(split, lambda x: ~(counted(x) & F.array_contains("keys", _key(x))))
    return joined.select(
        "row",
        F.when(F.col("keys").isNull(), text).otherwise(F.array_join(left, "\n")).alias("text_left"),
        F.coalesce(F.size(F.filter(split, counted)), F.lit(0)).alias("n_lines"),
        F.when(F.col("keys").isNull() | text.isNull(), 0).otherwise(F.size(split) - F.size(left)).alias("n_removed"),
    )


def _dropped(documents: DataFrame, min_sites: int, min_chars: int) -> DataFrame:
    prepared(documents.sparkSession)
    lines = line_table(documents, min_chars)
    return drop_lines(documents, lines, spread(lines, min_sites), min_chars)


def cleaned(documents: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``documents`` with __text, __lines and __removed; columns of these names in the input give way to the results.

    A null text has no lines and stays null. A null source is no site: its lines count no spread but are removed like
    others. Repeated rows of one doc_id share their fate; a null doc_id is never the first holder of a line. Lines that
    repeat inside one document are one occurrence and go or stay together. Other columns pass unchanged.
    """
    own = {"__text": "text_left", "__lines": "n_lines", "__removed": "n_removed"}
    rows = _dropped(documents, min_sites, min_chars)
    return rows.select(*[F.col(f"row.`{c}`") for c in documents.columns if c not in own], *[F.col(c).alias(name) for name, c in own.items()])


def without_boilerplate(documents: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``documents`` with the same columns and the text left; rows of which boilerplate was all go."""
    rows = _dropped(documents, min_sites, min_chars).where("n_removed = 0 OR text_left RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    changed = {"text": F.col("text_left")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text_left")).otherwise(F.col("row.n_chars")).cast(documents.schema["n_chars"].dataType)
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns])


def op5_line_spread(spark, sf_dir: str) -> DataFrame:
    """Lines counted, lines removed, length and digest of the text left, of every document."""
    rows = cleaned(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__removed").cast("long").alias("n_removed"),
        F.coalesce(F.length("__text"), F.lit(0)).cast("long").alias("n_chars_left"), F.md5("__text").alias("text_md5"),
    )


OP5_SQL = """
WITH docs AS (
    SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
),
held AS (
    SELECT DISTINCT doc_id, source, trim(line) AS line
    FROM (SELECT doc_id, source, unnest(lines) AS line FROM docs)
    WHERE length(trim(line)) >= 20
),
shared AS (
    SELECT line, min(doc_id) AS first_doc FROM held GROUP BY line HAVING count(DISTINCT source) >= 10
),
bad AS (
    SELECT held.doc_id, list(DISTINCT held.line) AS gone
    FROM held JOIN shared USING (line) WHERE held.doc_id IS DISTINCT FROM shared.first_doc GROUP BY held.doc_id
),
kept AS (
    SELECT docs.doc_id, docs.lines,
           CASE WHEN bad.gone IS NULL THEN docs.lines ELSE list_filter(docs.lines, lambda x: NOT list_contains(bad.gone, trim(x))) END AS left_lines
    FROM docs LEFT JOIN bad ON docs.doc_id IS NOT DISTINCT FROM bad.doc_id
)
SELECT doc_id,
       coalesce(len(list_filter(lines, lambda x: length(trim(x)) >= 20)), 0)::BIGINT AS n_lines,
       coalesce(len(lines) - len(left_lines), 0)::BIGINT AS n_removed,
       coalesce(length(array_to_string(left_lines, chr(10))), 0)::BIGINT AS n_chars_left,
       md5(array_to_string(left_lines, chr(10))) AS text_md5
FROM kept
"""
