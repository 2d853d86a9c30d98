"""Readers and the look-ups over crawl tables: pages, resources, headers, assets, CSS, queries, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.rows import each
from .dimensions import EXPECTED_FILES, QUERY_TEMPLATES

PAGES = "site string, page_id string, url string, path string, html string, html_bytes bigint, fetched_at timestamp"
RESOURCES = "site string, path string, content string, size bigint, error string"
PROBE_RESPONSES = "provider string, model string, query string, response_text string, error string"
#: Folders that snapshots of one day are spread over.
SITE_BUCKETS = 64


def site_bucket(site: Column) -> Column:
    return F.pmod(F.xxhash64(site), F.lit(SITE_BUCKETS)).cast("int")




def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table kept in fewer files than there are cores; larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if len(df.inputFiles()) < cores else df


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name``.parquet of ``folder`` as a stream, whether it is one file or a folder of part files."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(there).isDirectory():
        return reader.parquet(path)
    # a stream's path must be a folder
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def site_of(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://([^/?#]+)", 1)


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, "^https?://[^/?#]+([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def decode(content: Column) -> Column:
    """Bytes to text, dropping what is not UTF-8."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def read_html_folder(spark: SparkSession, folder: str, site: str, max_pages: int | None = None) -> DataFrame:
    """Recursive *.html scan of a folder as ``pages``; ``max_pages`` keeps the first ones by path."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.html")
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    root = folder.rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), root, -1)
    pages = files.select(
        F.lit(site).alias("site"),
        relative.alias("page_id"),
        F.concat(F.lit("/"), relative).alias("path"),
        F.concat(F.lit(f"https://{site}/"), relative).alias("url"),
        decode(F.col("content")).alias("html"),
        F.col("length").alias("html_bytes"),
        F.col("modificationTime").alias("fetched_at"),
    )
    return pages if max_pages is None else first_per_site(pages, max_pages, "path")


def first_per_site(df: DataFrame, n: int, *order) -> DataFrame:
    """First ``n`` rows of each site. Spark limits each partition to ``n`` per site before the shuffle."""
    w = Window.partitionBy("site").orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def read_resource_folder(spark: SparkSession, folder: str, site: str, pattern: str = "*") -> DataFrame:
    """Text files of a folder as ``resources``."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    root = folder.rstrip("/") + "/"
    return files.select(
        F.lit(site).alias("site"),
        F.substring_index(F.col("path"), root, -1).alias("path"),
        decode(F.col("content")).alias("content"),
        F.col("length").alias("size"),
        F.lit(None).cast("string").alias("error"),
    )


def look_up_files(sites: DataFrame, resources: DataFrame, paths=EXPECTED_FILES) -> DataFrame:
    """Every expected file of every site, found or not: (site, path, exists, content, size, error)."""
    wanted = sites.select("site", F.explode(F.array(*[F.lit(p) for p in paths])).alias("path"))
    found = resources.where(F.col("path").isin(*paths)).select("site", "path", "content", "size", "error")
    return wanted.join(found, ["site", "path"], "left").select(
        "site",
        "path",
        F.col("content").isNotNull().alias("exists"),
        "content",
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
        F.when(F.col("content").isNull(), F.coalesce("error", F.lit("file not found"))).alias("error"),
    )


def sitemap_urls(resources: DataFrame, limit: int | None = None) -> DataFrame:
    """URLs of each sitemap under the site's own prefix, first occurrence kept: (site, base, loc, pos)."""
    base = F.concat(F.lit("https://"), F.col("site"))
    maps = resources.where((F.col("path") == "sitemap.xml") & F.col("content").isNotNull())
    listed = F.regexp_extract_all("content", F.lit("<loc>(.*?)</loc>"), 1)
    locs = (
        each(maps, ["site", base.alias("base")], listed, "loc", "pos")
        .withColumn("loc", F.trim("loc"))
        .where((F.col("loc") != "") & F.startswith("loc", F.col("base")))
    )
    urls = locs.groupBy("site", "base", "loc").agg(F.min("pos").alias("pos"))
    return urls if limit is None else first_per_site(urls, limit, "pos")


def crawl_set(pages: DataFrame, resources: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages of a site in crawl order: home first, then sitemap order; only bodies with an <html tag.

    ``ord`` is -1 for the home page. Both join keys are single URLs, so no site is a hot key.
    """
    queue = sitemap_urls(resources).select("site", F.col("loc").alias("url"), "pos")
    bodies = pages.where(F.contains(F.lower("html"), F.lit("<html")))
    home = F.col("url") == F.concat(F.lit("https://"), F.col("site"), F.lit("/"))
    ordered = bodies.join(queue, ["site", "url"], "left").withColumn(
        "ord", F.when(home, F.lit(-1)).otherwise(F.col("pos"))
    )
    kept = ordered.where(F.col("ord").isNotNull()).drop("pos")
    return kept if limit is None else first_per_site(kept, limit, "ord", "page_id")


def lower_headers(headers: DataFrame) -> DataFrame:
    return headers.withColumn("headers", F.transform_keys("headers", lambda k, _: F.lower(k)))


def asset_key(ref: Column) -> Column:
    """Path of a relative reference, NULL for remote and inline ones."""
    remote = (
        F.startswith(ref, F.lit("http://"))
        | F.startswith(ref, F.lit("https://"))
        | F.startswith(ref, F.lit("//"))
        | F.startswith(ref, F.lit("data:"))
    )
    return F.when(~remote, F.regexp_replace(ref, "^/+", ""))


def with_asset_bytes(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """Bytes of each distinct (site, ref); 0 when remote or missing. ``refs`` must be distinct on (site, ref)."""
    keyed = refs.withColumn("_key", asset_key(F.col("ref")))
    size = F.coalesce("bytes", F.lit(0)).cast("bigint")
    # remote references have no row to meet: they stay where they are, so no task gets all of a site's
    remote = keyed.where(F.col("_key").isNull()).withColumn("bytes", F.lit(0).cast("bigint"))
    local = keyed.where(F.col("_key").isNotNull()).join(assets.select("site", F.col("path").alias("_key"), "bytes"), ["site", "_key"], "left")
    return local.withColumn("bytes", size).select(*refs.columns, "bytes").unionByName(remote.select(*refs.columns, "bytes"))


def first_css_files(css_files: DataFrame, n: int = 5) -> DataFrame:
    return first_per_site(css_files, n, "path")


def read_query_list(spark: SparkSession, path: str) -> DataFrame:
    """One query per line, trimmed; blank lines and lines starting with # are left out."""
    lines = spark.read.text(path)
    return lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).select(
        F.trim("value").alias("query")
    )


def topic_queries(topics: DataFrame, max_queries: int | None = None) -> DataFrame:
    """The question templates filled in for each topic: (topic, ord, query)."""
    templates = F.array(*[F.lit(t) for t in QUERY_TEMPLATES[:max_queries]])
    return topics.select("topic", F.posexplode(templates).alias("ord", "template")).select(
        "topic", "ord", F.replace("template", F.lit("{topic}"), F.col("topic")).alias("query")
    )


def read_history(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """Stored audit runs, sorted by site and time within each partition; a site filter prunes by its bucket."""
    runs = spark.read.parquet(path)
    if site is not None:
        runs = runs.where((F.col("site_bucket") == site_bucket(F.lit(site))) & (F.col("site") == site))
    return runs.sortWithinPartitions("site", "run_ts")


def read_psi_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Stored page-speed responses, one JSON document per file in the folder or below it: (source, body).

    A task reads many of the small files, so their number does not become a number of tasks.
    """
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    read = files.select(F.input_file_name().alias("source"), F.col("value").alias("body"))
    return read.coalesce(16 * spark.sparkContext.defaultParallelism)


def read_probe_responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    schema = T.StructType.fromDDL(PROBE_RESPONSES)
    return spark.read.schema(schema).format(fmt).load(path)
