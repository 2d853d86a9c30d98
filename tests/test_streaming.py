"""Streams driven file by file."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from crawlgauge.plans import catalog
from crawlgauge.streaming import alerts, page_audit

SCORES = "site string, layer string, run_ts timestamp, tie long, score double"


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def test_alerts_carry_the_last_score_over_batches(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame(list(rows), SCORES).coalesce(1).write.mode("append").parquet(source)
        runs = spark.readStream.schema(SCORES).parquet(source)
        alerts.start_alerts(runs, folder).awaitTermination()

    arrive(("s", "main", at(1), 1, 50.0), ("s", "main", at(2), 2, 44.0), ("t", "main", at(1), 3, 10.0))
    arrive(("s", "main", at(3), 4, 60.0), ("s", "main", at(1, 5), 5, 1.0), ("t", "main", at(2), 6, 5.0))
    arrive(("s", "main", at(4), 7, 30.0))
    # row 5 came late: it follows row 1 and precedes row 2
    got = {(r.site, r.tie): (r.prev_score, r.change) for r in alerts.read_changes(spark, folder).collect()}
    assert got == {
        ("s", 5): (50.0, "regression"), ("s", 2): (1.0, "improvement"), ("s", 4): (44.0, "improvement"),
        ("t", 6): (10.0, "regression"), ("s", 7): (60.0, "regression"),
    }
    assert alerts.read_alerts(spark, folder).count() == 3


def test_any_order_of_files_gives_the_same_changes(spark, tmp_path):
    import random

    rows = [("s" if i % 3 else "t", "main", at(1 + i // 24, i % 24), i, float((i * 7) % 30)) for i in range(90)]
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    results = []
    for name, parts in (("one", [rows]), ("ten", [shuffled[i::10] for i in range(10)])):
        source, folder = str(tmp_path / name / "in"), str(tmp_path / name / "out")
        for part in parts:
            spark.createDataFrame(part, SCORES).coalesce(1).write.mode("append").parquet(source)
        runs = spark.readStream.schema(SCORES).option("maxFilesPerTrigger", 1).parquet(source)
        alerts.start_alerts(runs, folder).awaitTermination()
        results.append(sorted(map(tuple, alerts.read_changes(spark, folder).collect())))
    assert results[0] == results[1] and len(results[0]) > 20


def test_a_hot_key_in_one_batch(spark):
    rows = [("s", "main", at(1 + i // 24, i % 24), i, float((i * 7) % 30)) for i in range(100)]
    batch = spark.createDataFrame(rows, SCORES)
    got = {r.tie: r.prev_score for r in alerts.score_changes(batch, batch.limit(0), "day").collect()}
    assert got == {i: (rows[i - 1][4] if i else None) for i in range(100)}


def test_daily_audit_drops_repeats_and_late_rows(spark, tmp_path):
    schema = "site string, page_id long, path string, html string, fetched_at timestamp"
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def arrive(*rows):
        spark.createDataFrame([("s", i, "/x", html, ts) for i, html, ts in rows], schema).coalesce(1).write.mode("append").parquet(source)
        pages = spark.readStream.schema(schema).parquet(source)
        page_audit.start_daily_audit(pages, out, progress).awaitTermination()

    good = '<html lang="en"><header><nav><main>'
    arrive((1, good, at(1)), (2, "<p>", at(1, 3)), (1, good, at(1)))
    arrive((3, good, at(9)))
    arrive((4, good, at(1)), (5, good, at(20)))  # page 4 is later than the watermark
    got = {r.day.day: (r.pages, r.poor_pages) for r in spark.read.parquet(out).collect()}
    assert got == {1: (2, 1), 9: (1, 0)}


def test_batch_and_stream_agree(spark, tmp_path):
    schema = "site string, page_id long, path string, html string, fetched_at timestamp"
    rows = [("s", i, "/x", "<p>", at(1 + i % 5)) for i in range(20)] + [("s", 99, "/x", "<p>", at(25))]
    pages = spark.createDataFrame(rows, schema)
    pages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    page_audit.start_daily_audit(stream, str(tmp_path / "out"), str(tmp_path / "p")).awaitTermination()
    batch = page_audit.daily_page_audit_batch(pages).where(F.dayofmonth("day") < 20)
    assert sorted(batch.collect()) == sorted(spark.read.parquet(str(tmp_path / "out")).collect())


@pytest.mark.parametrize("parts", [0, 3])
def test_tables_are_streamed_from_one_file_or_from_part_files(spark, tmp_path, parts):
    """A table of part files is a folder named like the file."""
    small = "/root/testdata/sf0.001"
    for name in ("pages", "events"):
        if parts:
            spark.read.parquet(f"{small}/{name}.parquet").repartition(parts).write.parquet(str(tmp_path / f"{name}.parquet"))
        else:
            (tmp_path / f"{name}.parquet").symlink_to(f"{small}/{name}.parquet")
    for name in ("daily_page_audit_st01", "regression_alerts_st02"):
        got, want = (sorted(map(tuple, catalog.QUERIES[name](spark, d).collect())) for d in (str(tmp_path), small))
        assert got == want and got


def test_no_closed_day_gives_no_rows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where("page_id % 400 = 7").write.parquet(str(tmp_path / "pages.parquet"))
    assert catalog.QUERIES["daily_page_audit_st01"](spark, str(tmp_path)).count() == 0


def folder_of(spark, tmp_path, name, parts, lateness=alerts.LATENESS):
    source, folder = str(tmp_path / name / "in"), str(tmp_path / name / "out")
    for part in parts:
        spark.createDataFrame(part, SCORES).coalesce(1).write.mode("append").parquet(source)
        runs = spark.readStream.schema(SCORES).parquet(source)
        alerts.start_alerts(runs, folder, lateness).awaitTermination()
    return folder


def test_state_is_cut_at_the_lateness_bound(spark, tmp_path):
    parts = [
        [("s", "main", at(1), 1, 50.0), ("s", "main", at(2), 2, 40.0), ("s", "main", at(10), 3, 30.0)],
        [("s", "main", at(11), 4, 60.0)],
        # row 5 is before all that is known, row 6 within the bound, row 7 has no time, row 8 is a key of its own
        [("s", "main", at(1, 5), 5, 9.0), ("s", "main", at(10, 5), 6, 1.0), ("s", "main", None, 7, 5.0), ("t", "main", at(1), 8, 5.0)],
    ]
    folder = folder_of(spark, tmp_path, "bound", parts, datetime.timedelta(days=3))
    got = {(r.site, r.tie): (r.prev_score, r.change) for r in alerts.read_changes(spark, folder).collect()}
    assert got == {
        ("s", 2): (50.0, "regression"), ("s", 3): (40.0, "regression"), ("s", 6): (30.0, "regression"), ("s", 4): (1.0, "improvement"),
        ("s", 5): (None, "late"), ("s", 7): (None, "late"),
    }
    assert {r.tie for r in alerts.read_late(spark, folder).collect()} == {5, 7}
    # what the state holds: the bound's rows and the one before them
    state = spark.read.format("statestore").option("path", f"{folder}/progress").option("stateVarName", "scores").load()
    held = {tuple(r.key): r.list_element.tie for r in state.where("key.site = 't'").collect()}
    assert held == {("t", "main"): 8}
    assert sorted(r.list_element.tie for r in state.where("key.site = 's'").collect()) == [2, 3, 4, 6]


def test_stream_equals_the_batch_form(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), rng.choice(["main", "advanced"]), at(rng.randrange(1, 28), rng.randrange(24)), i, float(rng.randrange(40)) if i % 17 else None) for i in range(400)]
    again = rows[5:25]  # delivered twice
    want = sorted(map(tuple, alerts.score_changes(spark.createDataFrame(rows, SCORES), spark.createDataFrame([], SCORES)).where("change IS NOT NULL").collect()))
    for seed in range(2):
        shuffled = rows + again
        random.Random(seed).shuffle(shuffled)
        folder = folder_of(spark, tmp_path, f"order{seed}", [shuffled[i::4] for i in range(4)])
        assert sorted(map(tuple, alerts.read_changes(spark, folder).collect())) == want


def test_a_batch_reads_no_more_than_it_brings(spark, tmp_path):
    """Later micro-batches read the new file only; what was written before is never read again."""
    parts = [[("s", "main", at(1 + d, h), 24 * d + h, float(h % 9)) for h in range(24)] for d in range(6)]
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, SCORES).coalesce(1).write.mode("append").parquet(source)
    runs = spark.readStream.schema(SCORES).option("maxFilesPerTrigger", 1).parquet(source)
    query = alerts.start_alerts(runs, folder, datetime.timedelta(days=2))
    query.awaitTermination()
    done = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in done] == [24] * 6
    state = spark.read.format("statestore").option("path", f"{folder}/progress").option("stateVarName", "scores").load()
    assert state.count() <= 2 * 24 + 2
