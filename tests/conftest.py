from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from crawlgauge.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("crawlgauge-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def page(spark):
    """One page as the tables hold it."""

    def make(html: str, path: str = "/a.html", site: str = "s", page_id: str = "p"):
        return spark.createDataFrame(
            [(site, page_id, f"https://{site}{path}", path, html)], "site string, page_id string, url string, path string, html string"
        )

    return make
