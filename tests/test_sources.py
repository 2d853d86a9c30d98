"""Readers and sinks on small folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from crawlgauge.sources import sinks, tables


def test_html_folder(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.html").write_bytes(b"<html>ok\xff caf\xc3\xa9</html>")
    (tmp_path / "a.html").write_text("<html>a</html>")
    (tmp_path / "n.txt").write_text("no")
    pages = tables.read_html_folder(spark, str(tmp_path), "s")
    got = {r.path: (r.html, r.html_bytes) for r in pages.collect()}
    assert got == {"/a.html": ("<html>a</html>", 14), "/b/x.html": ("<html>ok café</html>", 22)}
    assert [r.path for r in tables.read_html_folder(spark, str(tmp_path), "s", max_pages=1).collect()] == ["/a.html"]
    files = tables.read_resource_folder(spark, str(tmp_path), "s", "*.txt")
    assert [(r.path, r.content, r.size) for r in files.collect()] == [("n.txt", "no", 2)]


def test_expected_files(spark):
    sites = spark.createDataFrame([("a",), ("b",)], "site string")
    resources = spark.createDataFrame([("a", "sw.js", "x", 1, None), ("a", "other", "x", 1, None)], tables.RESOURCES)
    found = tables.look_up_files(sites, resources, ("sw.js", "llms.txt"))
    got = {(r.site, r.path): (r.exists, r.error) for r in found.collect()}
    assert got[("a", "sw.js")] == (True, None) and got[("b", "sw.js")] == (False, "file not found") and len(got) == 4


def test_sitemap_frontier_and_crawl_order(spark):
    text = "<loc> https://s/b </loc><loc>https://s/a</loc><loc>https://s/b</loc><loc>https://t/x</loc><loc></loc>"
    resources = spark.createDataFrame([("s", "sitemap.xml", text, 1, None)], tables.RESOURCES)
    assert [(r["loc"], r["pos"]) for r in tables.sitemap_urls(resources).orderBy("pos").collect()] == [("https://s/b", 0), ("https://s/a", 1)]
    rows = [("s", "1", u, "<HTML>") for u in ("https://s/a", "https://s/", "https://s/other")] + [("s", "2", "https://s/b", "pdf")]
    pages = spark.createDataFrame(rows, "site string, page_id string, url string, html string")
    assert [r.url for r in tables.crawl_set(pages, resources).orderBy("ord").collect()] == ["https://s/", "https://s/a"]
    assert [r.url for r in tables.crawl_set(pages, resources, 1).collect()] == ["https://s/"]


def test_asset_keys(spark):
    refs = ["/i/a.png", "//cdn/x", "https://a/b", "data:x", "i/a.png"]
    df = spark.createDataFrame([("s", r) for r in refs], "site string, ref string")
    assets = spark.createDataFrame([("s", "i/a.png", 7)], "site string, path string, bytes long")
    got = {r.ref: r.bytes for r in tables.with_asset_bytes(df, assets).collect()}
    assert got == {"/i/a.png": 7, "i/a.png": 7, "//cdn/x": 0, "https://a/b": 0, "data:x": 0}


def test_first_css_files(spark):
    css = spark.createDataFrame([("s", f"{i}.css", "") for i in range(9)], "site string, path string, content string")
    assert sorted(r.path for r in tables.first_css_files(css).collect()) == [f"{i}.css" for i in range(5)]


def test_query_list(spark, tmp_path):
    file = tmp_path / "q.txt"
    file.write_text("# no\n\n  one \ntwo\n   \n")
    assert [r.query for r in tables.read_query_list(spark, str(file)).collect()] == ["one", "two"]
    topics = spark.createDataFrame([("sen",)], "topic string")
    assert [r.query for r in tables.topic_queries(topics, 2).collect()] == ["co to jest sen", "najlepsze sen 2026"]


def test_headers_lower_case(spark):
    df = spark.createDataFrame([("s", {"X-A": "B"})], "site string, headers map<string,string>")
    assert tables.lower_headers(df).first().headers == {"x-a": "B"}


def test_stored_documents(spark, tmp_path):
    (tmp_path / "psi").mkdir()
    (tmp_path / "psi" / "1.json").write_text('{"a":\n1}')
    assert [r.body for r in tables.read_psi_folder(spark, str(tmp_path / "psi")).collect()] == ['{"a":\n1}']
    (tmp_path / "probe.json").write_text(json.dumps({"provider": "p", "query": "q", "response_text": "t"}))
    assert tables.read_probe_responses(spark, str(tmp_path / "probe.json")).first().provider == "p"


def test_snapshots_are_appended_and_pruned(spark, tmp_path):
    path = str(tmp_path / "history")
    for day, score in (("2024-01-02", 5.0), ("2024-01-01", 4.0)):
        runs = spark.createDataFrame([("my site/1", score), ("b", score)], "site string, score double")
        sinks.save_snapshot(runs.withColumn("run_ts", F.to_timestamp(F.lit(day))), path)
    got = tables.read_history(spark, path, "my site/1")
    assert sorted((r.score, r.site_slug) for r in got.collect()) == [(4.0, "my_site_1"), (5.0, "my_site_1")]
    one = spark.read.parquet(path).where("site = 'b' and run_date = date'2024-01-01'").where(F.col("site_bucket") == tables.site_bucket(F.lit("b")))
    assert "PartitionFilters: [isnotnull" in one._jdf.queryExecution().toString() and one.count() == 1


def test_reports_and_site_files(spark, tmp_path):
    df = spark.createDataFrame([("s", "f", "c")], "site string, path string, content string")
    sinks.write_site_files(df, str(tmp_path / "files"))
    assert spark.read.parquet(str(tmp_path / "files")).first().content == "c"
    sinks.write_report(df.withColumn("run_ts", F.to_timestamp(F.lit("2024-01-01"))), str(tmp_path / "r"), "json")
    assert spark.read.json(str(tmp_path / "r")).count() == 1


def test_slug(spark):
    names = spark.createDataFrame([("a.b/c",), ("",), ("x" * 70,)], "n string")
    assert [r[0] for r in names.select(sinks.site_slug(F.col("n"))).collect()] == ["a_b_c", "site", "x" * 60]


def test_shared_folder_must_be_named_off_local_masters():
    import pytest

    from crawlgauge import session

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Spark:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Spark())


def test_written_tables_are_removed(spark):
    import os

    from crawlgauge import session

    df = session.written_table(spark.range(3), "some")
    path = session.WRITTEN[-1]
    assert df.count() == 3 and os.path.isdir(path)
    session.remove_written(spark)
    assert not os.path.exists(path) and not session.WRITTEN


def test_remote_references_stay_spread(spark):
    refs = spark.range(2000).select(F.lit("s").alias("site"), F.concat(F.lit("https://cdn/"), "id").alias("ref"))
    refs = refs.unionByName(spark.createDataFrame([("s", "/a.png")], "site string, ref string"))
    assets = spark.createDataFrame([("s", "a.png", 7)], "site string, path string, bytes long")
    got = tables.with_asset_bytes(refs, assets)
    assert got.count() == 2001 and got.where("bytes = 7").count() == 1
    assert got.groupBy(F.spark_partition_id()).count().count() > 4


def test_documents_are_files_of_their_own_in_few_folders(spark, tmp_path):
    rows = [(f"{i}~mobile", f'{{"n":\n"ż{i}"}}') for i in range(700)] + [("empty", "")]
    sinks.write_documents(spark.createDataFrame(rows, "name string, body string").repartition(5), str(tmp_path / "out"))
    files = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert sorted((p.name, p.read_text(encoding="utf-8")) for p in files) == sorted(rows)
    assert len({p.parent for p in files}) <= sinks.DOCUMENT_FOLDERS
    back = tables.read_psi_folder(spark, str(tmp_path / "out"))
    # however many files there are, the number of tasks has a bound
    assert back.rdd.getNumPartitions() <= 16 * spark.sparkContext.defaultParallelism
    assert sorted((r.source.rsplit("/", 1)[1], r.body) for r in back.collect()) == sorted(rows[:-1])  # an empty file has no document


def test_documents_need_file_names(spark, tmp_path):
    with pytest.raises(Exception, match="not a file name"):
        sinks.write_documents(spark.createDataFrame([("a/b", "{}")], "name string, body string"), str(tmp_path / "out"))
