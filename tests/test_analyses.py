"""Analyses on small hand-made sites."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from crawlgauge.functions import jsonld as J
from crawlgauge.operators import core, generate, history, pagespeed, quality, registry, signals, visibility
from crawlgauge.operators import keywords as K
from crawlgauge.operators import structured_data as SD
from crawlgauge.sources import dimensions as dim
from crawlgauge.sources import sinks


def robots(spark, text):
    df = spark.createDataFrame([("s", text)], "site string, content string")
    return {r.bot: (r.status, r.compat_status) for r in core.robots_verdicts(df).collect()}


def test_grouped_robots_records_apply_to_every_agent(spark):
    got = robots(spark, "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n")
    assert got["GPTBot"] == ("warn", "ok")
    assert got["CCBot"] == ("warn", "warn")
    assert got["Diffbot"] == ("fail", "fail")


def test_robots_blank_line_does_not_stop_the_compat_block(spark):
    assert robots(spark, "User-agent: GPTBot\nAllow: /\n\nSitemap: x\nDisallow: /")["GPTBot"] == ("warn", "warn")


def test_robots_name_inside_another_name_is_not_named(spark):
    got = robots(spark, "User-agent: omgilibot\nAllow: /")
    assert got["omgilibot"] == ("ok", "ok")
    assert got["omgili"] == ("fail", "warn")


def test_robots_partial_disallow_is_allowed(spark):
    assert robots(spark, "User-agent: GPTBot\nDisallow: /data/x\nDisallow: /api\n")["GPTBot"] == ("ok", "ok")


def test_robots_with_very_many_lines(spark):
    text = "User-agent: GPTBot\n" + "\n".join(f"Disallow: /x{i}" for i in range(20000)) + "\nDisallow: /"
    assert robots(spark, text)["GPTBot"] == ("warn", "warn")


def test_performance_score(spark, page):
    images = '<img src="a.webp" alt="" loading="lazy"><img src="b.avif" alt="x" loading="lazy"><img src="c.webp" alt="y"><img src="d.png" alt="z">'
    got = quality.performance(signals.page_signals(page(images))).first()
    assert (got.modern_pct, got.lazy_pct, got.alt_pct, got.score) == (75.0, 50.0, 100.0, 81)


def test_accessibility_counts(spark, page):
    html = '<html lang="pl"><h1>a</h1><h1>b</h1><h3>c</h3><nav><main><header><img><img src="x" alt=""><input id="a"><a href="#main">'
    got = quality.accessibility(signals.page_signals(page(html))).first()
    assert (got.lang_pages, got.multi_h1_pages, got.level_skip_pages, got.landmark_pages) == (1, 1, 1, 1)
    assert (got.n_img, got.n_img_alt, got.n_img_decorative, got.n_inputs, got.n_inputs_unlabelled) == (2, 1, 1, 1, 1)
    assert got.skip_link_pages == 1
    assert got.score == math.floor((100 + 100 + 50 + 0 + 100 + 0) / 6)


def test_content_falls_back_to_all_pages(spark):
    long = "<p>" + "Ala ma kota i psa. " * 30 + "</p>"
    rows = [("a", "1", "/x", long), ("a", "2", "/artykul/1", long + "<h2>Why?</h2>"), ("b", "3", "/y", long), ("b", "4", "/z", "short")]
    pages = spark.createDataFrame(rows, "site string, page_id string, path string, html string")
    got = {r.site: r for r in quality.content_quality(signals.page_signals(pages)).collect()}
    assert (got["a"].pages, got["b"].pages) == (1, 2)
    assert got["a"].h2_question_pct == 100.0 and got["b"].h2_question_pct is None
    assert got["a"].avg_sentence_words == 5.0
    capped = {r.site: r.pages for r in quality.content_quality(signals.page_signals(pages), max_pages=1).collect()}
    assert capped == {"a": 1, "b": 1}


@pytest.mark.parametrize(
    "published, modified, stale",
    [
        ("2024-05-31T00:00:00Z", None, True),
        ("2024-06-01T00:00:00Z", None, False),
        ("2020-01-01", "2025-01-01T00:00:00+02:00", False),
        ("2020-01-01", "soon", False),
        ("soon", "2020-01-01", False),
        (None, "2020-01-01", False),
    ],
)
def test_freshness(spark, page, published, modified, stale):
    html = "".join(
        f'<meta content="{v}" property="article:{k}_time">' for k, v in (("published", published), ("modified", modified)) if v
    )
    assert signals.page_signals(page(html), "2025-06-01 00:00:00").first().is_stale is stale


def test_idf_and_boost(spark):
    def article(site, doc, text, title=""):
        return (site, doc, title, "", [], "", [], text, len(text.split()), 0, 0)

    schema = (
        "site string, doc long, title string, h1 string, h2_list array<string>, meta_description string, "
        "article_tags array<string>, body_text string, word_count long, citation_count long, fact_count long"
    )
    filler = " ".join(f"word{i}x" for i in range(97))
    articles = spark.createDataFrame(
        [
            article("s", 1, f"depresja depresja depresja {filler}"),
            article("s", 2, f"sennosc sennosc sennosc {filler}", "O sennosc"),
            article("s", 3, "nic tutaj"),
        ],
        schema,
    )
    idfs = {r.term: r.idf for r in K.idf(articles).collect()}
    assert idfs["depresja"] == pytest.approx(1.693147, abs=1e-6)
    assert idfs["word5x"] == pytest.approx(1.287682, abs=1e-6)
    got = {(r.doc, r.term): round(r.score, 2) for r in K.keywords(articles).collect()}
    assert got[(1, "depresja")] == 50.79
    assert got[(2, "sennosc")] == 304.77
    # equal scores: shorter terms first, then the first seen
    assert [t for (d, t) in got if d == 1] == ["depresja", "depresja depresja"]


def test_merit(spark):
    row = ("s", 1, "", "", ["Why?", "How"], "d" * 100, ["a"] * 5, "alpha beta gamma", 2000, 8, 20)
    schema = (
        "site string, doc long, title string, h1 string, h2_list array<string>, meta_description string, "
        "article_tags array<string>, body_text string, word_count long, citation_count long, fact_count long"
    )
    assert K.merit(spark.createDataFrame([row], schema)).first().merit == 100
    empty = ("s", 2, "", "", [], "", [], "", 0, 0, 0)
    assert K.merit(spark.createDataFrame([empty], schema)).first().merit == math.floor((0 + 0 + 0 + 30) / 4)


def blob(*objects):
    return "".join(f'<script type="application/ld+json">{o}</script>' for o in objects)


def test_required_recommended_and_any_of(spark, page):
    pages = page(blob('{"@type":"Product"}', '{"@type":"HowToStep","name":""}', '{"@type":"Unknown"}'))
    got = [(r.schema_type, r.severity, r.rule, r.field) for r in SD.issues(SD.objects(pages)).collect()]
    assert got.count(("Product", "error", "required", "name")) == 1
    assert sum(1 for g in got if g[:2] == ("Product", "warning")) == 6
    assert ("HowToStep", "error", "any_of", "name|text") in got
    assert not [g for g in got if g[0] == "Unknown"]


def test_zero_and_false_count_as_given_but_not_for_checks(spark, page):
    pages = page(blob('{"@type":"ListItem","position":0,"name":false}'))
    assert sorted(r.field for r in SD.issues(SD.objects(pages)).collect()) == ["item", "url"]


def test_own_rules_can_be_added(spark, page):
    pages = page(blob('{"@type":"Boat","length":"x"}'))
    extra = [("Boat", "required", "name", None, 0), ("Boat", "check", "length", "int", 1)]
    got = {(r.field, r.detail) for r in SD.issues(SD.objects(pages), extra).collect()}
    assert got == {("name", "missing"), ("length", "not_integer")}


def test_rule_table_covers_30_types():
    assert len(dim.known_types()) == 30
    assert len(dim.AI_BOTS) == 26 and len(dim.OPPORTUNITY_AUDITS) == 25 and len(dim.ACCESSIBILITY_AUDITS) == 22


def test_page_without_typed_objects_warns(spark, page):
    report = SD.page_reports(page(blob("{bad", '{"name":"x"}'))).first()
    assert (report.n_types, report.errors, report.warnings) == (0, 0, 1)
    assert SD.untyped_pages(page("<p>"), SD.objects(page("<p>"))).count() == 1


def test_citation_measures(spark):
    text = "See https://www.acme.pl for help. Acme.pl is the best."
    rows = [("p1", "m", "q", text, ""), ("p1", "m", "q2", "", "HTTP 500"), ("p2", "m", "q", "nothing", "")]
    answers = spark.createDataFrame(rows, "provider string, model string, query string, response_text string, error string")
    got = visibility.citations(answers, "https://www.Acme.pl/")
    first = got.where("query = 'q' and provider = 'p1'").first()
    assert (first.citation_count, first.position, first.has_url, first.sentiment) == (2, 29.6, True, "positive")
    providers = {r.provider: r for r in visibility.by_provider(got).collect()}
    assert (providers["p1"].citation_rate, providers["p1"].errors, providers["p2"].avg_position) == (50.0, 1, None)
    assert visibility.overall(got).first().overall_citation_rate == 50.0
    lists = {(r.kind, r.query) for r in visibility.query_lists(visibility.by_query(got)).collect()}
    assert lists == {("gap", "q2")}


def test_brand_inside_domain_counts_once(spark):
    answers = spark.createDataFrame([("acme.pl and Acme and xacme.pl", "")], "response_text string, error string")
    assert visibility.citations(answers, "acme.pl", "Acme").first().citation_count == 3


PSI = """{"lighthouseResult":{"categories":{"performance":{"score":0.29},"seo":{"score":null}},"audits":{
"largest-contentful-paint":{"displayValue":"1.5 s","numericValue":1500.5,"score":0.9},
"unused-css-rules":{"title":"CSS","score":0.4,"details":{"overallSavingsMs":10,"items":[]}},
"redirects":{"score":0.5,"details":{"overallSavingsMs":300,"overallSavingsBytes":5120,"items":[{"source":{"url":"u"},"wastedBytes":2048}]}},
"dom-size":{"score":null},"user-timings":{"score":0.95},"image-alt":{"score":0,"details":{"items":[{"node":{"selector":"img"}}]}},"label":{"score":1}}},
"loadingExperience":{"metrics":{"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":5,"category":"FAST"},"INTERACTION_TO_NEXT_PAINT":{"percentile":120},
"FIRST_CONTENTFUL_PAINT_MS":{"percentile":900,"category":"AVERAGE"}}}}"""


def test_page_speed(spark):
    psi = pagespeed.parsed(spark.createDataFrame([("u", "mobile", PSI), ("broken", "mobile", "{")], "url string, strategy string, body string"))
    scores = {r.url: r for r in pagespeed.category_scores(psi).collect()}
    assert (scores["u"].performance, scores["u"].seo, scores["u"].accessibility, scores["broken"].performance) == (29, 0, 0, 0)
    lab = {r.metric: r for r in pagespeed.lab_metrics(psi.where("url = 'u'")).collect()}
    assert (lab["LCP"].display, lab["LCP"].numeric, lab["LCP"].band, lab["SI"].display, lab["SI"].band) == ("1.5 s", 1500.5, "good", "—", None)
    crux = {r.metric: r.value for r in pagespeed.field_metrics(psi).collect()}
    assert crux == {"CLS": "0.050", "INP": "120", "FCP": "900 ms"}
    found = pagespeed.opportunities(psi).orderBy("rank").collect()
    assert [(r.id, r.savings_ms, r.savings_kb, r.items_count) for r in found] == [("redirects", 300.0, 5, 1), ("unused-css-rules", 10.0, 0, 0)]
    assert found[0].items_top3[0].asDict() == {"url": "u", "wasted_ms": 0.0, "wasted_kb": 2}
    issues = pagespeed.accessibility_issues(psi).collect()
    assert [(r.id, r.items_count, r.items_top3[0].selector) for r in issues] == [("image-alt", 1, "img")]
    texts = [r.text for r in pagespeed.recommendations(pagespeed.opportunities(psi), pagespeed.accessibility_issues(psi)).orderBy("part", "rank").collect()]
    assert texts == ["redirects (-300ms -5KB)", "CSS (-10ms)", "image-alt (1)"]


@pytest.mark.parametrize("worse, better, status", [(2, 1, "REGRESSION"), (1, 1, "IMPROVEMENT"), (0, 0, "STABLE")])
def test_status(spark, worse, better, status):
    row = spark.range(1).select(history.status_of(F.lit(worse), F.lit(better)).alias("s")).first()
    assert row.s == status


def test_layer_changes(spark):
    rows = [("s", "main", f"2024-01-0{i + 1} 00:00:00", v) for i, v in enumerate([50.0, 45.0, None, 49.0, 54.0])]
    runs = spark.createDataFrame(rows, "site string, layer string, run_ts string, score double").withColumn("run_ts", F.to_timestamp("run_ts"))
    got = [(r.score, r.prev_score, r.change) for r in history.layer_changes(runs, period="day").orderBy("run_ts").collect()]
    assert got == [(50.0, None, None), (45.0, 50.0, "regression"), (49.0, 45.0, None), (54.0, 49.0, "improvement")]


def test_seo_card_falls_back_to_core_score(spark):
    categories = spark.createDataFrame([("a", 90, 50, 49, 0), ("b", 1, 1, 1, 70)], "site string, performance long, accessibility long, best_practices long, seo long")
    core_scores = spark.createDataFrame([("a", 33)], "site string, score long")
    cards = {(r.site, r.card): (r.score, r.colour) for r in history.headline_cards(categories, core_scores).collect()}
    assert cards[("a", "seo")] == (33, "red") and cards[("b", "seo")] == (70, "amber")
    assert [cards[("a", c)][1] for c in ("performance", "accessibility", "best_practices")] == ["green", "amber", "red"]


# --- generation ------------------------------------------------------------------------------------------------


def site_pages(spark):
    html = "<html lang='en'><head><title>T {}</title></head><body><h1>H</h1><p>" + "some words here " * 8 + "</p></body></html>"
    rows = [
        ("s", "1", "/index.html", html.format(1)),
        ("s", "2", "/blog/my-post.html", html.format(2)),
        ("s", "3", "/404.html", html.format(3)),
        ("s", "4", "/raw.html", "<p>no head end"),
    ]
    pages = spark.createDataFrame(rows, "site string, page_id string, path string, html string")
    return pages.withColumn("fetched_at", F.to_timestamp(F.lit("2024-03-04 05:06:07")))


@pytest.fixture
def about(spark):
    return spark.createDataFrame([("s", "https://s", "Site", "About")], "site string, base_url string, site_name string, description string")


def test_generated_files_pass_the_audit(spark, about):
    pages = site_pages(spark)
    new_pages = generate.with_schema(pages, about, "2025-01-01")
    texts = generate.joined_files(generate.llms_txt(pages, about).unionByName(generate.llms_full_txt(pages, about)))
    parts = generate.sitemap_files(generate.sitemap_entries(pages, about))
    # the audit reads one sitemap.xml; here it gets the only part
    files = generate.robots_txt(about).unionByName(texts).unionByName(parts.withColumn("path", F.lit("sitemap.xml")))
    resources = files.withColumn("size", F.length("content")).withColumn("error", F.lit(None).cast("string"))
    found = core.core_audit(signals.page_signals(new_pages), resources).where("module in ('ai_files', 'robots', 'structured_data')")
    bad = [r.check_id for r in found.where("status = 'fail'").collect()]
    assert bad == ["type:Person"]
    report = {r.page_id: r.errors for r in SD.page_reports(new_pages).collect()}
    assert report["1"] == 1  # a home page has no second breadcrumb item
    assert report["2"] == 1  # the article has no image


def test_schema_is_added_once(spark, about):
    once = generate.with_schema(site_pages(spark), about, "2025-01-01")
    assert {r.page_id: r.added for r in once.collect()} == {
        "1": "WebSite,Organization,BreadcrumbList", "2": "WebSite,Organization,BreadcrumbList,Article",
        "3": "WebSite,Organization,BreadcrumbList,Article", "4": "",
    }
    twice = generate.with_schema(once.drop("added"), about, "2025-01-01")
    assert {r.added for r in twice.collect()} == {""}


def test_breadcrumbs(spark):
    rel, base, title = F.lit("a-b/c/x.html"), F.lit("https://s"), F.lit("T")
    items = spark.range(1).select(generate.breadcrumbs(rel, base, title).alias("i")).first().i
    assert [(i["position"], i["name"], i["item"]) for i in items] == [
        (1, "Home", "https://s"), (2, "A B", "https://s/a-b"), (3, "C", "https://s/a-b/c"), (4, "T", "https://s/a-b/c/x.html"),
    ]


def test_sitemap_parts_hold_every_page(spark, about):
    pages = spark.range(45).select(
        F.lit("s").alias("site"), F.col("id").cast("string").alias("page_id"), F.concat(F.lit("/p"), F.col("id"), F.lit("&.html")).alias("path"),
        F.lit('<img src="i.png">').alias("html"), F.to_timestamp(F.lit("2024-01-01")).alias("fetched_at"),
    )
    entries = generate.sitemap_entries(pages, about)
    files = generate.sitemap_files(entries, per_file=10)
    rows = files.collect()
    assert len(rows) > 1 and sum(r.content.count("<url>") for r in rows) == 45
    assert "&amp;.html" in rows[0].content and "https://s/i.png" in rows[0].content
    index = generate.sitemap_index(files, about).first()
    assert index.path == "sitemap.xml" and index.content.count("<sitemap>") == len(rows)
    assert generate.sitemap_files(entries).first().path == "sitemap-1.xml"


def test_generated_files_hold_every_page_and_image(spark, about, tmp_path):
    pages = spark.range(450).select(
        F.lit("s").alias("site"), F.col("id").cast("string").alias("page_id"), F.format_string("/p%03d.html", "id").alias("path"),
        F.concat(F.lit("<title>T"), F.col("id"), F.lit("</title>"), F.repeat(F.lit('<img src="i.png">'), 9)).alias("html"), F.to_timestamp(F.lit("2024-01-01")).alias("fetched_at"),
    )
    rows = generate.llms_txt(pages, about).unionByName(generate.llms_full_txt(pages, about))
    assert {r.path: r["count"] for r in rows.groupBy("path").count().collect()} == {"llms.txt": 451, "llms-full.txt": 451}
    sinks.write_file_rows(rows, str(tmp_path / "files"))
    assert spark.read.parquet(str(tmp_path / "files")).count() == 902
    content = {r.path: r.content for r in generate.joined_files(rows).collect()}
    assert content["llms.txt"].startswith("# Site\n\n> About\n\n## Articles\n\n- [T0](https://s/p000.html)\n- [T1]")
    assert generate.sitemap_entries(pages, about).first().xml.count("<image:image>") == 9
    assert "# Allow: https://s/ai.txt\n" in generate.robots_txt(about).first().content


def test_all_changes_count(spark):
    empty_layers = spark.createDataFrame([], "site string, run_ts string, change string")
    failures = spark.createDataFrame([("s", "r", "new")] * 40 + [("s", "r", "gone")] * 15, "site string, run_ts string, change string")
    row = history.diff_status(empty_layers, failures, empty_layers).first()
    assert (row.regressions, row.improvements, row.status) == (40, 15, "REGRESSION")


def test_fixed_values_are_whole():
    assert (len(dim.AI_BOTS), len(dim.known_types()), len(dim.schema_rule_rows())) == (26, 30, 234)
    assert (len(dim.OPPORTUNITY_AUDITS), len(dim.ACCESSIBILITY_AUDITS), len(dim.ENGLISH_STOPWORDS)) == (25, 22, 31)
    assert dim.with_stopwords(dim.ENGLISH_STOPWORDS, ("oraz", "the")) == (*dim.ENGLISH_STOPWORDS, "oraz")


def test_pages_under_a_hundred_words_are_no_articles(spark):
    rows = [("s", i, "gadget " * n, n) for i, n in enumerate((99, 100, 400))]
    found = K.long_enough(spark.createDataFrame(rows, "site string, doc long, body_text string, word_count long"))
    assert sorted(r.doc for r in found.collect()) == [1, 2]


def test_article_window(spark, page):
    html = F.lit("x" * 996 + "article")
    near, far = (spark.range(1).select(signals.is_article(F.lit("/a"), html, n)).first()[0] for n in (1003, 1002))
    assert near and not far


def test_fonts_are_replaced_once(spark, page):
    html = '<head><link href="https://fonts.googleapis.com/css" rel="x"><link rel="preconnect" href="https://fonts.gstatic.com"></head></head>'
    got = generate.self_hosted_fonts(page(html)).first()
    assert got.changed and got.html == '<head>  <link rel="stylesheet" href="/fonts/fonts.css">\n</head></head>'
    assert generate.self_hosted_fonts(page("<head></head>")).first().html == "<head></head>"


# --- properties ------------------------------------------------------------------------------------------------


def test_a_page_of_one_site_does_not_change_another(spark):
    pages = site_pages(spark)
    other = pages.limit(1).withColumn("site", F.lit("t"))
    before = quality.accessibility(signals.page_signals(pages)).collect()
    after = quality.accessibility(signals.page_signals(pages.unionByName(other))).where("site = 's'").collect()
    assert before == after


def test_results_do_not_depend_on_partitioning(spark):
    pages = site_pages(spark)
    sorted_rows = [sorted(map(repr, quality.content_quality(signals.page_signals(p)).collect())) for p in (pages.coalesce(1), pages.repartition(7))]
    assert sorted_rows[0] == sorted_rows[1]


def test_module_selection(spark):
    assert registry.select_modules(registry.QUALITY_MODULES, "a11y, content") == ["a11y", "content"]
    with pytest.raises(ValueError):
        registry.select_modules(registry.QUALITY_MODULES, "speed")
    found = registry.run(registry.QUALITY_MODULES, "all", signals.page_signals(site_pages(spark)))
    assert {r.module for r in found.select("module").distinct().collect()} == {"performance", "accessibility", "content"}


def test_types_are_found_with_their_paths(spark):
    def walk(node, path="$", depth=0):
        if depth > 25:
            return
        if isinstance(node, dict):
            types = node.get("@type")
            for t in types if isinstance(types, list) else [types]:
                if isinstance(t, str):
                    yield path, t
        inner = [(f'{path}."{k}"', v) for k, v in node.items()] if isinstance(node, dict) else [(f"{path}[{i}]", v) for i, v in enumerate(node)] if isinstance(node, list) else []
        for below, value in inner:
            yield from walk(value, below, depth + 1)

    deep = {"@type": "T0"}
    for k in range(1, 40):
        deep = {"@type": f"T{k}", "a": deep} if k % 2 else [deep, {"@type": ["L", 5, None, "M"]}]
    values = [deep, {}, [], 5, "x", None, {"@type": "A", "x.y": {'k"q': [{"@type": "B"}, [[{"@type": "C"}]]]}, "n": None, "@graph": [None, {"@type": ["D", "D"]}]}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, j string").select("id", F.try_parse_json("j").alias("v"))
    got = {(r["id"], r["path"], r["schema_type"]) for r in df.select("id", F.explode(J.typed_nodes(F.col("v"))).alias("n")).select("id", "n.*").collect()}
    assert got == {(i, p, t) for i, v in enumerate(values) for p, t in walk(v)}


def test_sketches_merge_to_any_period(spark):
    rows = [(f"s{i % 700}", "main", f"2024-0{1 + i % 3}-{1 + i % 28:02d} 10:00:00", float(i % 100) if i % 11 else None) for i in range(6000)]
    runs = spark.createDataFrame(rows, "site string, layer string, t string, score double").withColumn("run_ts", F.to_timestamp("t"))
    year = history.merged_sketches(history.daily_sketches(runs), "year").collect()
    assert len(year) == 1 and year[0]["n_runs"] == 6000
    assert abs(year[0]["n_sites"] - 700) <= 45 and 44 <= year[0]["median"] <= 55
    assert history.merged_sketches(history.daily_sketches(runs.limit(0))).count() == 0
