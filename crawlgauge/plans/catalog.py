"""The registered queries: name, Spark query over (spark, sf_dir), and the SQL that checks it.

Names end in the blueprint's operator ids. Every query reads the given tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import html as H
from ..functions import text as T
from ..operators import clusters as CL
from ..operators import core, generate, history, pagespeed, quality, signals, visibility
from ..operators import keywords as K
from ..operators import structured_data as SD
from ..session import WRITTEN, configure, shared_dir, written_folder, written_table
from ..sources import dimensions as dim
from ..sources import archives, sinks, tables
from ..streaming import alerts, page_audit
from . import derived as D
from . import oracles as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so both engines give the same types."""
    small = (ST.IntegerType, ST.ShortType, ST.ByteType)
    columns = [
        F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, small) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*columns)


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(fn(configure(spark), sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def _signals(spark, d) -> DataFrame:
    return signals.page_signals(D.pages(spark, d), D.AS_OF)


def _articles(spark, d, *columns) -> DataFrame:
    return K.long_enough(signals.article_fields(D.pages(spark, d)).select(*columns or "*"))


def _documents(spark, d) -> DataFrame:
    """Of the documents only what the keyword analyses read."""
    articles = signals.document_articles(tables.spread(D.table(spark, d, "documents"), "doc_id"))
    return K.long_enough(articles.select("site", "doc", "body_text", "word_count"))


def _document_keywords(spark, d) -> DataFrame:
    return K.keywords(_documents(spark, d), boost=False)


#: What keywords of pages are computed from.
PAGE_FIELDS = ["site", "doc", "title", "h1", "h2_list", "meta_description", "article_tags", "body_text", "word_count"]


#: What open questions are found in.
QUESTION_FIELDS = ["site", "doc", "title", "h2_list", "word_count"]


def _page_keywords(spark, d) -> DataFrame:
    return K.keywords(_articles(spark, d, *PAGE_FIELDS))


def rounded(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


# --- sources and sinks -----------------------------------------------------------------------------------------


@query(
    "expected_files_src02",
    O.sql(
        f"""SELECT s.site, p.path, r.content IS NOT NULL AS exists, coalesce(CAST(strlen(r.content) AS BIGINT), 0) AS size,
 CASE WHEN r.content IS NULL THEN 'file not found' END AS error FROM sites s CROSS JOIN (SELECT unnest([{O.text_list(dim.EXPECTED_FILES)}]) AS path) p
 LEFT JOIN res r ON r.site = s.site AND r.path = p.path""",
        sites=O.SITES,
        res=O.RES,
    ),
)
def _(spark, d):
    return tables.look_up_files(D.sites(spark, d), D.resources(spark, d)).drop("content")


FRONTIER = r"""SELECT site, loc, min(pos) AS pos FROM (SELECT site, trim(unnest(regexp_extract_all(content, '<loc>(.*?)</loc>', 1))) AS loc,
 unnest(range(len(regexp_extract_all(content, '<loc>(.*?)</loc>', 1)))) AS pos FROM res WHERE path = 'sitemap.xml')
 WHERE loc <> '' AND starts_with(loc, concat('https://', site)) GROUP BY site, loc"""


@query("sitemap_frontier_src04", O.sql(FRONTIER, sites=O.SITES, res=O.RES))
def _(spark, d):
    return tables.sitemap_urls(D.resources(spark, d)).drop("base")


CRAWLED = "SELECT * REPLACE (CASE WHEN page_id % 5 = 1 THEN concat('https://', site, '/') ELSE concat('https://', site, path) END AS url) FROM pg"


CRAWL_SET = O.sql(
    """SELECT * FROM (SELECT c.site, c.page_id, c.url, CASE WHEN c.url = concat('https://', c.site, '/') THEN -1 ELSE f.pos END AS ord
 FROM c LEFT JOIN f ON f.site = c.site AND f.loc = c.url WHERE contains(lower(c.html), '<html')) WHERE ord IS NOT NULL""",
    pg=O.PG,
    sites=O.SITES,
    res=O.RES,
    f=FRONTIER,
    c=CRAWLED,
)


def _with_own_urls(spark, d) -> DataFrame:
    own = F.concat(F.lit("https://"), "site", F.when(F.expr("page_id % 5 = 1"), "/").otherwise(F.col("path")))
    return D.pages(spark, d).withColumn("url", own)


@query("crawl_set_src03", CRAWL_SET)
def _(spark, d):
    return tables.crawl_set(_with_own_urls(spark, d), D.resources(spark, d)).select("site", "page_id", "url", "ord")


@query("archived_crawl_set_src03", CRAWL_SET)
def _(spark, d):
    """The crawl set of pages that were written to crawl archives and read back."""
    folder = written_folder(spark, "archives")
    pages = _with_own_urls(spark, d)
    archives.write_archives(
        pages.select(
            F.concat(F.lit("<urn:page:"), "page_id", F.lit(">")).alias("record_id"),
            F.col("url").alias("target_uri"),
            F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
            F.lit(200).alias("status"),
            F.create_map(F.lit("Content-Type"), F.lit("text/html")).alias("http_headers"),
            F.encode("html", "UTF-8").alias("body"),
        ),
        folder,
    )
    back = archives.archived_pages(archives.read_archives(spark, folder))
    page_id = F.regexp_extract("record_id", r"(\d+)>$", 1).cast("bigint").alias("page_id")
    site = F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("site")
    return tables.crawl_set(back.select(site, page_id, "url", "html", "fetched_at"), D.resources(spark, d)).select("site", "page_id", "url", "ord")


@query(
    "lower_headers_src05",
    O.sql("SELECT site, lower(name) AS name, value FROM h", sites=O.SITES, h=O.HDR),
)
def _(spark, d):
    low = tables.lower_headers(D.headers(spark, d))
    return low.select("site", F.explode("headers").alias("name", "value"))


@query(
    "asset_bytes_src06_j05",
    O.sql(
        "SELECT site, kind, ref, any_value(bytes) AS bytes, count(*) AS uses FROM sized GROUP BY site, kind, ref",
        pg=O.PG,
        sites=O.SITES,
        assets=O.ASSETS,
        el=O.ELEMENTS,
        sized=O.SIZED,
    ),
)
def _(spark, d):
    refs = signals.page_elements(D.pages(spark, d)).groupBy("site", "kind", "ref").agg(F.count("*").alias("uses"))
    return tables.with_asset_bytes(refs, D.assets(spark, d))


@query(
    "topic_queries_src08_j13",
    "SELECT t.topic, q.ord, replace(q.template, '{topic}', t.topic) AS query FROM (SELECT DISTINCT p_name AS topic FROM part) t "
    f"CROSS JOIN (SELECT unnest([{O.text_list(dim.QUERY_TEMPLATES)}]) AS template, unnest(range({len(dim.QUERY_TEMPLATES)})) AS ord) q",
)
def _(spark, d):
    return tables.topic_queries(D.table(spark, d, "part").select(F.col("p_name").alias("topic")).distinct())


@query(
    "site_slug_snk02",
    O.sql(
        "SELECT site, coalesce(nullif(substr(regexp_replace(site, '[^A-Za-z0-9_-]', '_', 'g'), 1, 60), ''), 'site') AS slug FROM sites",
        sites=O.SITES,
    ),
)
def _(spark, d):
    return D.sites(spark, d).select("site", sinks.site_slug(F.col("site")).alias("slug"))


def _folder(spark, name: str) -> str:
    """A folder of its own in the shared folder; removed with the written tables."""
    path = f"{shared_dir(spark)}/crawlgauge/{name}-{_run_id()}"
    WRITTEN.append(path)
    return path


@query(
    "stored_history_src09_snk02",
    O.sql("SELECT site, layer, run_ts, tie, score, coalesce(nullif(substr(regexp_replace(site, '[^A-Za-z0-9_-]', '_', 'g'), 1, 60), ''), 'site') AS site_slug FROM ls", ls=O.LAYERS),
)
def _(spark, d):
    """Scores saved as snapshots and read back."""
    path = _folder(spark, "history")
    sinks.save_snapshot(D.layer_scores(spark, d), path)
    return tables.read_history(spark, path).select("site", "layer", "run_ts", "tie", "score", "site_slug")


@query("stored_report_snk01", O.sql("SELECT site, layer, CAST(run_ts AS DATE) AS run_date, count(*) AS n FROM ls GROUP BY ALL", ls=O.LAYERS))
def _(spark, d):
    """Scores appended as a report by run date and read back."""
    path = _folder(spark, "report")
    sinks.write_report(D.layer_scores(spark, d), path)
    return spark.read.parquet(path).groupBy("site", "layer", "run_date").agg(F.count("*").alias("n"))


@query(
    "stored_answers_src11",
    O.sql("SELECT provider, query, response_text, error, count(*) AS n FROM pr GROUP BY ALL", pr=O.PROBES),
)
def _(spark, d):
    """Answers written as JSON lines and read by the reader."""
    path = _folder(spark, "answers")
    D.probe_responses(spark, d).select("provider", "model", "query", "response_text", "error").write.json(path)
    found = tables.read_probe_responses(spark, path)
    return found.groupBy("provider", "query", "response_text", "error").agg(F.count("*").alias("n"))


@query("stored_psi_src10", O.sql("SELECT url, strategy, v->>'$.lighthouseResult.categories.performance.score' AS score FROM psi", psi=O.PSI))
def _(spark, d):
    """Stored page-speed documents, one file each, read from their folder."""
    path = _folder(spark, "psi")
    bodies = D.psi_responses(spark, d)
    name = F.concat_ws("~", F.regexp_extract("url", "#([0-9]+)$", 1), "strategy").alias("name")
    sinks.write_documents(bodies.select(name, "body"), path)
    score = F.get_json_object("body", "$.lighthouseResult.categories.performance.score").alias("score")
    read = tables.read_psi_folder(spark, path).select(F.regexp_extract("source", "([^/]*)$", 1).alias("name"), score)
    return read.join(bodies.select(name, "url", "strategy"), "name").select("url", "strategy", "score")


@query("first_stylesheets_src07", O.sql("SELECT site, path FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY path) AS rn FROM css) WHERE rn <= 5", sites=O.SITES, css=O.CSS))
def _(spark, d):
    """The first five stylesheets of a site (the number is the reader's option; ``worst_contrast`` reads all)."""
    return tables.first_css_files(D.css_files(spark, d)).select("site", "path")


# --- page signals ----------------------------------------------------------------------------------------------


@query("visible_text_p01", O.sql(f"SELECT page_id, {O.strip('html')} AS text FROM pg", pg=O.PG))
def _(spark, d):
    return D.pages(spark, d).select("page_id", H.visible_text(F.col("html")).alias("text"))


@query(
    "image_attributes_p02",
    O.sql(
        f"""SELECT page_id, pos, {O.attr('t', 'src')} AS src, {O.attr('t', 'alt')} AS alt, {O.attr('t', 'loading')} AS loading
 FROM (SELECT page_id, unnest({O.IMGS}) AS t, unnest(range(len({O.IMGS}))) AS pos FROM pg)""",
        pg=O.PG,
    ),
)
def _(spark, d):
    tags = D.pages(spark, d).select("page_id", F.posexplode(H.find_all(F.col("html"), H.IMG, 1)).alias("pos", "t"))
    given = tags.withColumn("m", H.attribute_map(F.col("t")))
    return given.select("page_id", "pos", *[F.col("m")[n].alias(n) for n in ("src", "alt", "loading")])


@query(
    "meta_lookup_p03",
    O.sql(
        f"SELECT page_id, {O.meta('article:published_time')} AS published, {O.meta('article:modified_time')} AS modified, "
        f"{O.meta('og:image')} AS og_image, {O.meta('description')} AS description FROM pg",
        pg=O.PG,
    ),
)
def _(spark, d):
    html = F.col("html")
    return D.pages(spark, d).select(
        "page_id",
        H.meta_content(html, "article:published_time").alias("published"),
        H.meta_content(html, "article:modified_time").alias("modified"),
        H.meta_content(html, "og:image").alias("og_image"),
        H.meta_content(html, "description").alias("description"),
    )


@query(
    "article_extraction_k01_p04_p06_p17_p22",
    O.sql(
        "SELECT doc, title, h1, array_to_string(h2_list, '|') AS h2, array_to_string(h3_list, '|') AS h3, meta_description, "
        "array_to_string(article_tags, '|') AS tags, body_text, word_count, first_200, citation_count, fact_count FROM art",
        **O.ART_CTES,
    ),
)
def _(spark, d):
    lists = {"h2": "h2_list", "h3": "h3_list", "tags": "article_tags"}
    return _articles(spark, d).select(
        "doc", "title", "h1", "meta_description", "body_text", "word_count", "first_200", "citation_count", "fact_count",
        *[F.array_join(c, "|").alias(name) for name, c in lists.items()],
    )


@query(
    "boilerplate_removal_p05",
    O.sql(
        f"SELECT page_id, {O.BODY} AS content_body, {O.KW_BODY} AS keyword_body, {O.FULL_BODY} AS full_body FROM pg", pg=O.PG
    ),
)
def _(spark, d):
    html = F.col("html")
    return D.pages(spark, d).select(
        "page_id",
        H.without_blocks(html, H.CONTENT_BOILERPLATE).alias("content_body"),
        H.without_blocks(html, H.KEYWORD_BOILERPLATE).alias("keyword_body"),
        H.without_blocks(html, H.FULL_TEXT_BOILERPLATE).alias("full_body"),
    )


@query(
    "heading_steps_p07",
    O.sql(
        f"SELECT page_id, i - 1 AS pos, lv[i] AS level, CASE WHEN i > 1 THEN lv[i - 1] END AS prev_level FROM (SELECT page_id, lv, unnest(range(1, len(lv) + 1)) AS i FROM (SELECT page_id, {O.LEVELS} AS lv FROM pg))",
        pg=O.PG,
    ),
)
def _(spark, d):
    return quality.heading_steps(D.pages(spark, d)).drop("site")


@query("page_elements_p08_p09_p10", O.sql(O.ELEMENTS, pg=O.PG))
def _(spark, d):
    return signals.page_elements(D.pages(spark, d))


SIGNAL_DOUBLES = ["fog", "fact_density", "citation_density", "h2_question_pct"]
SIGNAL_FLAGS = [
    "html_bytes", "has_picture", "n_stylesheets", "n_blocking_scripts", "has_font_preload", "n_img", "n_img_alt",
    "n_img_described", "n_img_decorative", "n_img_src", "n_img_src_modern", "n_img_src_lazy", "n_img_src_alt", "lang",
    "has_lang", "has_skip_link", "n_landmarks", "n_h1", "skips_level", "n_inputs", "n_inputs_unlabelled",
]
MARKS = [
    "n_question_headings", "has_bibliography", "has_author", "has_og_image", "has_nosnippet", "uses_google_fonts",
    "is_article",
]
TEXTUAL = ["judged", "n_words", "n_sentences", "sum_sentence_words", "n_long_sentences", "has_tldr", "age_days"]


@query(
    "page_flags_p08_p16",
    O.sql("SELECT page_id, " + ", ".join(SIGNAL_FLAGS) + " FROM s", **O.SIG_CTES),
)
def _(spark, d):
    return _signals(spark, d).select("page_id", *SIGNAL_FLAGS)


@query("page_marks_p24_p26_f02", O.sql("SELECT page_id, " + ", ".join(MARKS) + " FROM s", **O.SIG_CTES))
def _(spark, d):
    return _signals(spark, d).select("page_id", *MARKS)


@query(
    "page_text_signals_p17_p27",
    O.sql(
        "SELECT page_id, " + ", ".join(TEXTUAL + [f"round({c}, 6) AS {c}" for c in SIGNAL_DOUBLES]) + " FROM s", **O.SIG_CTES
    ),
)
def _(spark, d):
    return _signals(spark, d).select("page_id", *TEXTUAL, *rounded(*SIGNAL_DOUBLES))


@query(
    "document_facts_p19_p20",
    f"SELECT doc_id, {O.n_of('text', O.WORD)} AS n_words, {O.n_of('text', O.NUM)} AS n_numbers, {O.n_of('text', O.YEAR)} AS n_years, {O.n_of('text', O.PROPER)} AS n_proper FROM documents",
)
def _(spark, d):
    text = F.col("text")
    return tables.spread(D.table(spark, d, "documents"), "doc_id").select(
        "doc_id",
        T.word_count(text).alias("n_words"),
        H.count_of(text, T.NUMBER_WITH_UNIT).alias("n_numbers"),
        H.count_of(text, T.YEAR).alias("n_years"),
        H.count_of(text, T.PROPER_RUN).alias("n_proper"),
    )


@query(
    "font_links_p24",
    O.sql(
        r"""SELECT DISTINCT site, unnest(regexp_extract_all(html, '(?i)<link[^>]+href=["''](https?://fonts\.googleapis\.com[^"'']+)["''][^>]*>', 1)) AS url FROM pg""",
        pg=O.PG,
    ),
)
def _(spark, d):
    return generate.font_links(D.pages(spark, d))


PAGE_TEXTS = rf"""SELECT page_id, coalesce(nullif(t, ''), nullif(h, ''), ltrim(path, '/')) AS title, coalesce(nullif(m, ''), p[1:300], concat('About ', site)) AS description FROM (
 SELECT page_id, site, path, {O.strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS t, {O.strip("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h,
 regexp_extract(html, '(?i)<meta\s+name=["'']description["'']\s+content=["'']([^"'']*)["'']', 1) AS m,
 list_filter(list_transform({O.every('html', '(?is)<p[^>]*>(.*?)</p>', 1)}, lambda x: {O.strip('x')}), lambda x: len(string_split(x, ' ')) >= 15)[1] AS p FROM pg)"""


@query(
    "titles_and_descriptions_p28_g09",
    O.sql(
        PAGE_TEXTS,
        pg=O.PG,
    ),
)
def _(spark, d):
    html = F.col("html")
    return D.pages(spark, d).select(
        "page_id",
        generate.page_title(html, generate.relative_path(F.col("path"))).alias("title"),
        generate.page_description(html, F.concat(F.lit("About "), "site")).alias("description"),
    )


@query(
    "home_urls_p30",
    O.sql("SELECT page_id, regexp_replace(concat('https://', site, path), '/index[.]html$', '/') AS url FROM pg", pg=O.PG),
)
def _(spark, d):
    return D.pages(spark, d).select(
        "page_id", H.home_url(F.concat(F.lit("https://"), "site", "path")).alias("url")
    )


# --- core audit ------------------------------------------------------------------------------------------------


def _core_inputs(spark, d):
    sig = _signals(spark, d).select(*core.SIGNALS)
    return sig, D.resources(spark, d), D.headers(spark, d), D.assets(spark, d)


@query("core_audit_a01_a08", O.sql("SELECT * FROM fi", **O.CORE_CTES))
def _(spark, d):
    return core.core_audit(*_core_inputs(spark, d))


@query("site_score_a09_m07", O.sql("SELECT * FROM core", **O.CORE_CTES))
def _(spark, d):
    sig, *others = _core_inputs(spark, d)
    return core.site_score(core.core_audit(written_table(sig, "signals"), *others))


@query("robots_verdicts_a02_j02", O.sql("SELECT * FROM verdicts", **O.FILE_CTES, **O.ROBOT_CTES))
def _(spark, d):
    robots = D.resources(spark, d).where(F.col("path") == "robots.txt")
    return core.robots_verdicts(robots.select("site", "content"))


@query(
    "schema_coverage_a03_j03",
    O.sql(
        O.all_of(O.SCHEMA_FINDINGS),
        **{k: O.CORE_CTES[k] for k in ("pg", "b0", "b", "roots", "anyt", "sites", "broken")},
    ),
)
def _(spark, d):
    return core.structured_data(_signals(spark, d))


@query("htaccess_security_a05", O.sql(O.all_of(O.HTACCESS_FINDINGS), **O.FILE_CTES))
def _(spark, d):
    return core.security_from_htaccess(core.site_files(D.sites(spark, d), D.resources(spark, d)))


# --- quality modules -------------------------------------------------------------------------------------------

PERF_SHARES = ["avg_html_bytes", "modern_pct", "lazy_pct", "alt_pct"]


@query(
    "performance_b01_b02",
    O.sql(
        "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in PERF_SHARES) + ") FROM pa",
        **O.SIG_CTES, sites=O.SITES, assets=O.ASSETS, el=O.ELEMENTS, sized=O.SIZED, perf=O.PERF, ps=O.PERF_SIZES, pa=O.PERF_ALL,
    ),
)
def _(spark, d):
    stats = quality.performance(_signals(spark, d), signals.page_elements(D.pages(spark, d)), D.assets(spark, d))
    return stats.withColumns({c: F.round(c, 6) for c in PERF_SHARES})


@query(
    "image_formats_b01", O.sql("SELECT site, ext, count(*) AS n_images FROM el WHERE kind = 'img' GROUP BY site, ext", pg=O.PG, el=O.ELEMENTS)
)
def _(spark, d):
    return quality.image_formats(signals.page_elements(D.pages(spark, d)))


@query(
    "largest_images_b03",
    O.sql(
        """SELECT site, rank, ref, page_id, bytes, bytes > 200000 AS too_large FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY bytes DESC, ref, page_id) AS rank
 FROM sized WHERE kind = 'img' AND bytes > 0) WHERE rank <= 5""",
        pg=O.PG, sites=O.SITES, assets=O.ASSETS, el=O.ELEMENTS, sized=O.SIZED,
    ),
)
def _(spark, d):
    return quality.largest_images(signals.page_elements(D.pages(spark, d)), D.assets(spark, d))


@query("accessibility_b04_b07", O.sql("SELECT * FROM a11y", **O.SIG_CTES, a11y=O.A11Y))
def _(spark, d):
    return quality.accessibility(_signals(spark, d))


@query(
    "worst_contrast_b05_b06_j07",
    O.sql("SELECT * FROM contrast", sites=O.SITES, css=O.CSS, contrast=O.CONTRAST),
)
def _(spark, d):
    return quality.worst_contrast(D.css_files(spark, d)).withColumn("ratio", F.round("ratio", 6))


CONTENT_SHARES = ["fog", "avg_sentence_words", "long_sentence_pct", "fact_density", "citation_density", "h2_question_pct"]


@query(
    "content_quality_b08_b09",
    O.sql(
        "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in CONTENT_SHARES) + ") FROM content",
        **O.SIG_CTES,
        content=O.CONTENT,
    ),
)
def _(spark, d):
    return quality.content_quality(_signals(spark, d)).withColumns({c: F.round(c, 6) for c in CONTENT_SHARES})


@query("module_scores_b10", O.sql("SELECT * FROM modules", **O.SIG_CTES, **O.QUALITY_CTES))
def _(spark, d):
    sig = written_table(_signals(spark, d), "signals")
    return quality.module_scores(quality.performance(sig), quality.accessibility(sig), quality.content_quality(sig))


@query(
    "readability_b11_b13",
    f"""SELECT doc_id, rule, w AS n_words, n AS n_sentences, h AS n_hard, round((w / n + h / w * 100) / 3, 6) AS fog FROM (
 SELECT doc_id, 'pl' AS rule, {O.n_of('text', O.WORD)} AS w, {O.sentence_count('text')} AS n, {O.hard_words('text')} AS h FROM documents WHERE lang = 'pl'
 UNION ALL SELECT doc_id, 'latin', {O.n_of('text', O.WORD)}, {O.latin_sentence_count('text')}, {O.latin_hard_words('text')} FROM documents WHERE lang IS DISTINCT FROM 'pl')""",
)
def _(spark, d):
    """Rules by the document's language; ``rule`` names them."""
    text, lang = F.col("text"), F.col("lang")
    counted = tables.spread(D.table(spark, d, "documents"), "doc_id").select(
        "doc_id",
        T.rule_name(lang).alias("rule"),
        T.word_count(text).alias("n_words"),
        T.by_language(lang, lambda rules: F.size(T.sentences(text, rules))).cast("bigint").alias("n_sentences"),
        T.by_language(lang, lambda rules: T.hard_word_count(text, rules)).alias("n_hard"),
    )
    return counted.withColumn("fog", F.round(T.fog(F.col("n_words"), F.col("n_sentences"), F.col("n_hard")), 6))


# --- structured data -------------------------------------------------------------------------------------------


@query("jsonld_blobs_p29_json01", O.sql("SELECT page_id, blob_pos, blob, is_valid FROM b", pg=O.PG, b0=O.BLOB, b=O.BLOB_OK))
def _(spark, d):
    return SD.blobs(D.pages(spark, d)).select("page_id", "blob_pos", "blob", "is_valid")


@query(
    "types_anywhere_json02",
    O.sql(
        "SELECT site, schema_type, count(*) AS pages FROM anyt GROUP BY ALL",
        **{k: O.JSON_CTES[k] for k in ("pg", "b0", "b", "roots")},
        anyt=O.ANY_TYPES,
    ),
)
def _(spark, d):
    return SD.types_anywhere(D.pages(spark, d))


@query(
    "typed_nodes_json02",
    O.sql(
        """SELECT DISTINCT site, page_id, blob_pos, regexp_replace(path, '\\.([A-Za-z0-9_]+)', '."\\1"', 'g') AS path, unnest(types) AS schema_type FROM (
 SELECT r.site, r.page_id, r.blob_pos, t.fullkey AS path, CASE json_type(t.value, '$."@type"') WHEN 'ARRAY' THEN
 list_filter(CAST(json_extract(t.value, '$."@type"') AS VARCHAR[]), lambda x: x IS NOT NULL) WHEN 'VARCHAR' THEN [json_extract_string(t.value, '$."@type"')] ELSE [] END AS types
 FROM roots r, json_tree(r.v) t WHERE t.type = 'OBJECT')""",
        **{k: O.JSON_CTES[k] for k in ("pg", "b0", "b", "roots")},
    ),
)
def _(spark, d):
    return SD.typed_nodes(D.pages(spark, d))


@query(
    "declared_types_json03",
    O.sql(
        """SELECT DISTINCT site, page_id, unnest(CASE json_type(n, '$."@type"') WHEN 'ARRAY' THEN json_extract_string(n, '$."@type"[*]')
 WHEN 'VARCHAR' THEN [json_extract_string(n, '$."@type"')] ELSE [] END) AS schema_type FROM (
 SELECT site, page_id, obj AS n FROM o UNION ALL SELECT site, page_id, v FROM roots WHERE json_type(v) = 'OBJECT')""",
        **O.JSON_CTES,
    ),
)
def _(spark, d):
    return SD.declared_types(D.pages(spark, d))


@query("jsonld_objects_json04_json05", O.sql("SELECT site, page_id, blob_pos, schema_type, count(*) AS n FROM o GROUP BY ALL", **O.JSON_CTES))
def _(spark, d):
    found = SD.objects(D.pages(spark, d))
    return found.groupBy("site", "page_id", "blob_pos", "schema_type").agg(F.count("*").alias("n"))


@query("schema_issues_json06_json09_j04", O.sql("SELECT * FROM iss", **O.ISSUE_CTES))
def _(spark, d):
    return SD.issues(SD.objects(D.pages(spark, d))).drop("obj_pos", "ord")


@query("page_reports_json10", O.sql("SELECT site, page_id, n_types, types, errors, warnings FROM rep", **O.REPORT_CTES))
def _(spark, d):
    return SD.page_reports(D.pages(spark, d))


@query("validator_summary_json11_json12", O.sql(O.VALIDATOR, **O.REPORT_CTES))
def _(spark, d):
    return SD.site_summary(SD.page_reports(D.pages(spark, d)))


@query(
    "type_histogram_json11",
    O.sql(
        f"SELECT site, schema_type, count(*) AS n, schema_type IN ({O.text_list(dim.known_types())}) AS is_known FROM o WHERE schema_type <> '' GROUP BY site, schema_type",
        **O.JSON_CTES,
    ),
)
def _(spark, d):
    return SD.type_histogram(SD.objects(D.pages(spark, d)))


@query(
    "dangling_publishers_json13",
    O.sql(
        """SELECT site, page_id, blob_pos, json_extract_string(obj, '$.publisher."@id"') AS ref FROM o
 WHERE json_extract_string(obj, '$.publisher."@id"') IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o p WHERE p.page_id = o.page_id
 AND p.schema_type = 'Organization' AND json_extract_string(p.obj, '$."@id"') = json_extract_string(o.obj, '$.publisher."@id"'))""",
        **O.JSON_CTES,
    ),
)
def _(spark, d):
    return SD.dangling_publishers(SD.objects(D.pages(spark, d))).drop("obj_pos")


# --- keyword strategy ------------------------------------------------------------------------------------------


@query(
    "term_counts_k02_k03_f07",
    O.sql("SELECT doc, term, tf FROM terms", **{k: O.DOC_KW[k] for k in ("docs0", "docs", "tok", "grams", "terms")}),
)
def _(spark, d):
    return K.article_terms(_documents(spark, d)).select("doc", "term", "tf")


@query(
    "term_weights_k04",
    O.sql("SELECT site, term, n, df, round(idf, 6) AS idf FROM df", **{k: O.DOC_KW[k] for k in ("docs0", "docs", "tok", "grams", "terms", "ns", "df")}),
)
def _(spark, d):
    articles = _documents(spark, d)
    weights = K.idf(articles)
    return weights.select("site", "term", "n", "df", F.round("idf", 6).alias("idf"))


@query("document_keywords_k05_j08", O.sql("SELECT site, doc, rank, term, round(score, 6) AS score, round(idf, 6) AS idf FROM kw", **O.DOC_KW))
def _(spark, d):
    return _document_keywords(spark, d).withColumns({c: F.round(c, 6) for c in ("score", "idf")})


@query("page_keywords_k05_j12", O.sql("SELECT site, doc, rank, term, round(score, 6) AS score, round(idf, 6) AS idf FROM kw", **O.PAGE_KW))
def _(spark, d):
    return _page_keywords(spark, d).withColumns({c: F.round(c, 6) for c in ("score", "idf")})


@query(
    "cannibalisation_k06",
    O.sql(
        """SELECT site, term, n_articles, round(best - second, 6) AS winner_delta, doc, score FROM (SELECT site, term, doc, round(score, 2) AS score,
 count(*) OVER w AS n_articles, max(round(score, 2)) OVER w AS best, nth_value(round(score, 2), 2) OVER (PARTITION BY site, term ORDER BY round(score, 2) DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
 FROM kw WHERE rank <= 5 WINDOW w AS (PARTITION BY site, term)) WHERE n_articles > 1""",
        **O.DOC_KW,
    ),
)
def _(spark, d):
    return K.cannibalisation(written_table(_document_keywords(spark, d), "keywords"))


# edges between similar articles, then one article per step in order: it leads unless a leader is among its neighbours
CLUSTER_CTES = dict(
    sets="SELECT site, doc, list(term) AS ts FROM kw GROUP BY site, doc",
    nodes="SELECT site, doc, row_number() OVER (PARTITION BY site ORDER BY doc) AS i FROM docs",
    edges="""SELECT a.site, a.doc AS a, b.doc AS b FROM sets a JOIN sets b ON a.site = b.site AND a.doc < b.doc
 WHERE len(list_intersect(a.ts, b.ts)) >= 3 OR len(list_intersect(a.ts, b.ts)) / len(list_distinct(a.ts || b.ts)) >= 0.1""",
    near="SELECT n.site, n.doc, n.i, coalesce(e.l, CAST([] AS BIGINT[])) AS lower FROM nodes n LEFT JOIN (SELECT site, b AS doc, list(a) AS l FROM edges GROUP BY ALL) e USING (site, doc)",
    steps="""SELECT site, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS lead FROM near GROUP BY site
 UNION ALL SELECT s.site, n.i, CASE WHEN len(list_intersect(s.lead, n.lower)) = 0 THEN list_append(s.lead, n.doc) ELSE s.lead END
 FROM steps s JOIN near n ON n.site = s.site AND n.i = s.i + 1""",
    final="SELECT site, arg_max(lead, i) AS lead FROM steps GROUP BY site",
    cl="SELECT n.site, n.doc, coalesce(list_min(list_intersect(f.lead, n.lower)), n.doc) AS leader FROM near n JOIN final f USING (site)",
)


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("topic_clusters_k08_j09", recursive(O.sql("SELECT site, doc, leader FROM cl", **O.DOC_KW, **CLUSTER_CTES)))
def _(spark, d):
    return CL.clusters(_documents(spark, d), written_table(_document_keywords(spark, d), "keywords"))


@query(
    "leader_similarity_k07",
    recursive(
        O.sql(
            """SELECT cl.site, cl.doc, cl.leader, coalesce(len(list_intersect(a.ts, b.ts)), 0) AS shared,
 CASE WHEN a.ts IS NULL THEN 0 ELSE round(len(list_intersect(a.ts, b.ts)) / len(list_distinct(a.ts || b.ts)), 6) END AS jaccard
 FROM cl LEFT JOIN sets a ON a.site = cl.site AND a.doc = cl.doc LEFT JOIN sets b ON b.site = cl.site AND b.doc = cl.leader""",
            **O.DOC_KW,
            **CLUSTER_CTES,
        )
    ),
)
def _(spark, d):
    kw = written_table(_document_keywords(spark, d), "keywords")
    clustered = CL.clusters(_documents(spark, d), kw)
    return CL.leader_similarity(clustered, kw).withColumn("jaccard", F.round("jaccard", 6))


MERIT_PARTS = {
    "length_part": "CASE WHEN word_count >= 2000 THEN 100 WHEN word_count >= 1200 THEN 80 WHEN word_count >= 600 THEN 50 WHEN word_count >= 300 THEN 20 ELSE 0 END",
    "fact_part": "CASE WHEN word_count = 0 THEN NULL WHEN fact_count / word_count * 1000 >= 10 THEN 100 WHEN fact_count / word_count * 1000 >= 5 THEN 70 ELSE 30 END",
    "citation_part": "CASE WHEN citation_count >= 8 THEN 100 WHEN citation_count >= 4 THEN 70 WHEN citation_count >= 1 THEN 40 ELSE 0 END",
    "variety_part": "CASE WHEN len(toks) = 0 THEN NULL WHEN len(list_distinct(toks)) / len(toks) >= 0.5 THEN 100 WHEN len(list_distinct(toks)) / len(toks) >= 0.35 THEN 70 ELSE 30 END",
    "question_part": "CASE WHEN len(h2_list) = 0 THEN NULL WHEN q / len(h2_list) * 100 >= 30 THEN 100 WHEN q / len(h2_list) * 100 >= 10 THEN 60 ELSE 20 END",
    "description_part": "CASE WHEN length(meta_description) BETWEEN 70 AND 165 THEN 100 WHEN meta_description <> '' THEN 50 ELSE 0 END",
    "tag_part": "CASE WHEN len(article_tags) >= 5 THEN 100 WHEN len(article_tags) >= 3 THEN 70 ELSE 30 END",
}
MERIT_CTES = dict(
    **O.ART_CTES,
    mt=f"SELECT *, {O.tokens('body_text')} AS toks, len(list_filter(h2_list, lambda h: contains(h, '?'))) AS q FROM art",
    mp="SELECT site, doc, word_count, citation_count, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in MERIT_PARTS.items()) + " FROM mt",
    merit=f"SELECT *, {O.whole(O.mean(*MERIT_PARTS))} AS merit FROM mp",
)


@query("merit_k09_f07", O.sql("SELECT * FROM merit", **MERIT_CTES))
def _(spark, d):
    return K.merit(_articles(spark, d))


@query(
    "corpus_summary_k11",
    O.sql(
        "SELECT site, count(*) AS articles, round(avg(merit), 6) AS avg_merit, CAST(sum(word_count) AS BIGINT) AS total_words, CAST(sum(citation_count) AS BIGINT) AS total_citations FROM merit GROUP BY site",
        **MERIT_CTES,
    ),
)
def _(spark, d):
    return K.corpus_summary(K.merit(_articles(spark, d))).withColumn("avg_merit", F.round("avg_merit", 6))


QUESTION_CTES = dict(
    qs="SELECT site, doc, unnest(h2_list) AS question, unnest(range(len(h2_list))) AS pos FROM art",
    qp=f"""SELECT *, array_to_string(list_filter(string_split_regex(regexp_replace(lower(question), '[?!,.:;]', '', 'g'), '\\s+'),
 lambda t: length(t) > 3 AND t NOT IN ({O.text_list(dim.STOPWORDS)}))[1:3], ' ') AS phrase FROM qs WHERE contains(question, '?')""",
    oq="SELECT * FROM qp WHERE length(phrase) >= 8 AND NOT EXISTS (SELECT 1 FROM art a WHERE a.site = qp.site AND contains(lower(a.title), qp.phrase))",
)


@query("open_questions_k10_j10", O.sql("SELECT * FROM oq", **O.ART_CTES, **QUESTION_CTES))
def _(spark, d):
    return K.open_questions(_articles(spark, d))


@query(
    "content_gaps_k10",
    O.sql(
        """SELECT site, rank, kind, key, doc, priority FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority DESC, k, doc, pos) AS rank FROM (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, key ORDER BY k, doc, pos) AS nth FROM (
 SELECT site, term AS key, 'expand_topic' AS kind, 0 AS k, min(doc) AS doc, min(rank) AS pos, round(max(idf), 2) AS priority FROM kw WHERE rank <= 10 GROUP BY site, term
 HAVING count(*) = 1 AND max(idf) >= 1.5 AND contains(term, ' ')
 UNION ALL SELECT site, phrase, 'h2_to_article', 1, doc, pos, 1.0 FROM oq)) WHERE nth = 1)) WHERE rank <= 10""",
        **O.PAGE_KW,
        **QUESTION_CTES,
    ),
)
def _(spark, d):
    return K.content_gaps(_page_keywords(spark, d), _articles(spark, d, *QUESTION_FIELDS))


# --- answer visibility -----------------------------------------------------------------------------------------


def _citations(spark, d) -> DataFrame:
    return visibility.citations(D.probe_responses(spark, d), D.DOMAIN, D.BRAND)


@query(
    "normalised_domains_c01",
    "SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, 'https?://', ''), '/+$', ''), '^www\\.', '')) AS domain FROM pages",
)
def _(spark, d):
    return D.table(spark, d, "pages").select("page_id", visibility.normalised_domain(F.col("url")).alias("domain"))


@query("citations_c02_c05_src11", O.sql("SELECT * FROM c", **O.CITE_CTES))
def _(spark, d):
    return _citations(spark, d).drop("model", "response_text")


@query(
    "providers_c06",
    O.sql(
        """SELECT *, round(cited_count / total_queries * 100, 1) AS citation_rate FROM (SELECT provider, count(*) AS total_queries, count(*) FILTER (error <> '') AS errors,
 count(*) FILTER (cited) AS cited_count, round(avg(position) FILTER (cited), 1) AS avg_position, count(*) FILTER (sentiment = 'positive') AS positive,
 count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative FROM c GROUP BY provider)""",
        **O.CITE_CTES,
    ),
)
def _(spark, d):
    return visibility.by_provider(_citations(spark, d))


BY_QUERY = "SELECT query, count(*) AS providers_total, count(*) FILTER (cited) AS providers_cited FROM c GROUP BY query"


@query("queries_c07", O.sql(BY_QUERY, **O.CITE_CTES))
def _(spark, d):
    return visibility.by_query(_citations(spark, d))


@query(
    "query_lists_c07",
    O.sql(
        """SELECT kind, rank, query FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY query) AS rank FROM (
 SELECT query, CASE WHEN providers_cited = 0 THEN 'gap' WHEN providers_cited = providers_total THEN 'strong' END AS kind FROM bq) WHERE kind IS NOT NULL) WHERE rank <= 10""",
        **O.CITE_CTES,
        bq=BY_QUERY,
    ),
)
def _(spark, d):
    return visibility.query_lists(visibility.by_query(_citations(spark, d)))


@query(
    "overall_citation_c08",
    O.sql(
        """SELECT count(*) AS total_probes, count(*) FILTER (error = '') AS successful_probes, count(*) FILTER (error <> '') AS errors,
 round(count(*) FILTER (cited AND error = '') / greatest(count(*) FILTER (error = ''), 1) * 100, 1) AS overall_citation_rate FROM c""",
        **O.CITE_CTES,
    ),
)
def _(spark, d):
    return visibility.overall(_citations(spark, d))


@query(
    "citation_roll_up_c06_c08",
    O.sql(
        """SELECT CASE WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(query) = 0 THEN 'query' ELSE 'overall' END AS level, provider, query,
 count(*) AS answers, count(*) FILTER (error <> '') AS errors, count(*) FILTER (cited) AS cited FROM c GROUP BY GROUPING SETS ((provider), (query), ())""",
        **O.CITE_CTES,
    ),
)
def _(spark, d):
    return visibility.roll_up(_citations(spark, d))


# --- page-speed responses --------------------------------------------------------------------------------------


def _psi(spark, d) -> DataFrame:
    return pagespeed.parsed(D.psi_responses(spark, d))


SCORE = "CAST(coalesce(round(100 * CAST(v->>'$.lighthouseResult.categories.{}.score' AS DOUBLE)), 0) AS BIGINT) AS {}"
CATS = "SELECT url, strategy, " + ", ".join(
    SCORE.format(key, name)
    for name, key in (("performance", "performance"), ("accessibility", "accessibility"), ("best_practices", '"best-practices"'), ("seo", "seo"))
) + " FROM psi"


@query("psi_categories_ps01_src10", O.sql(CATS, psi=O.PSI))
def _(spark, d):
    return pagespeed.category_scores(_psi(spark, d))


@query(
    "psi_bands_ps06",
    O.sql(
        "SELECT *, CASE WHEN score >= 90 THEN 'good' WHEN score >= 50 THEN 'needs_work' ELSE 'poor' END AS band FROM (UNPIVOT cats ON performance, accessibility, best_practices, seo INTO NAME category VALUE score)",
        psi=O.PSI,
        cats=CATS,
    ),
)
def _(spark, d):
    return pagespeed.score_bands(pagespeed.category_scores(_psi(spark, d)))


@query(
    "psi_lab_metrics_ps02",
    O.sql(
        f"""SELECT url, strategy, metric, coalesce(a->>'$.displayValue', '—') AS display, CAST(a->>'$.numericValue' AS DOUBLE) AS numeric, CAST(a->>'$.score' AS DOUBLE) AS score,
 CASE WHEN CAST(a->>'$.score' AS DOUBLE) >= 0.9 THEN 'good' WHEN CAST(a->>'$.score' AS DOUBLE) >= 0.5 THEN 'needs_work' WHEN CAST(a->>'$.score' AS DOUBLE) IS NOT NULL THEN 'poor' END AS band FROM (
 SELECT url, strategy, m.metric, json_extract(v, concat('$.lighthouseResult.audits."', m.key, '"')) AS a FROM psi CROSS JOIN (SELECT unnest([{O.text_list(n for n, _ in dim.LAB_METRICS)}]) AS metric, unnest([{O.text_list(k for _, k in dim.LAB_METRICS)}]) AS key) m)""",
        psi=O.PSI,
    ),
)
def _(spark, d):
    return pagespeed.lab_metrics(_psi(spark, d))


@query(
    "psi_field_metrics_ps03",
    O.sql(
        f"""SELECT url, strategy, metric, CASE WHEN metric = 'CLS' THEN printf('%.3f', CAST(m->>'$.percentile' AS DOUBLE) / 100) WHEN contains(key, 'MS') THEN concat(m->>'$.percentile', ' ms') ELSE m->>'$.percentile' END AS value,
 coalesce(m->>'$.category', '') AS category FROM (SELECT url, strategy, k.metric, k.key, json_extract(v, concat('$.loadingExperience.metrics."', k.key, '"')) AS m FROM psi
 CROSS JOIN (SELECT unnest([{O.text_list(n for n, _ in dim.FIELD_METRICS)}]) AS metric, unnest([{O.text_list(k for _, k in dim.FIELD_METRICS)}]) AS key) k) WHERE m IS NOT NULL""",
        psi=O.PSI,
    ),
)
def _(spark, d):
    return pagespeed.field_metrics(_psi(spark, d))


def _audits(ids) -> str:
    return f"""SELECT url, strategy, k.id, k.ord, json_extract(v, concat('$.lighthouseResult.audits."', k.id, '"')) AS a FROM psi
 CROSS JOIN (SELECT unnest([{O.text_list(ids)}]) AS id, unnest(range({len(ids)})) AS ord) k"""


OPPORTUNITIES = """SELECT url, strategy, rank, id, title, savings_ms, savings_kb, items_count, first_url FROM (
 SELECT *, row_number() OVER (PARTITION BY url, strategy ORDER BY savings_ms DESC, savings_kb DESC, ord) AS rank FROM (
 SELECT url, strategy, id, ord, coalesce(a->>'$.title', id) AS title, coalesce(CAST(a->>'$.details.overallSavingsMs' AS DOUBLE), 0.0) AS savings_ms,
 CAST(coalesce(round(CAST(a->>'$.details.overallSavingsBytes' AS DOUBLE) / 1024), 0) AS BIGINT) AS savings_kb, coalesce(CAST(json_array_length(a, '$.details.items') AS BIGINT), 0) AS items_count,
 a->>'$.details.items[0].url' AS first_url FROM oa WHERE a IS NOT NULL AND CAST(a->>'$.score' AS DOUBLE) < 0.9)) WHERE rank <= 15"""
ISSUES = """SELECT url, strategy, rank, id, title, items_count FROM (SELECT *, row_number() OVER (PARTITION BY url, strategy ORDER BY ord) AS rank FROM (
 SELECT url, strategy, id, ord, coalesce(a->>'$.title', id) AS title, coalesce(CAST(json_array_length(a, '$.details.items') AS BIGINT), 0) AS items_count
 FROM ia WHERE a IS NOT NULL AND CAST(a->>'$.score' AS DOUBLE) <> 1)) WHERE rank <= 15"""


@query("psi_opportunities_ps04_f09", O.sql(OPPORTUNITIES, psi=O.PSI, oa=_audits(dim.OPPORTUNITY_AUDITS)))
def _(spark, d):
    return pagespeed.opportunities(_psi(spark, d)).select(
        "url", "strategy", "rank", "id", "title", "savings_ms", "savings_kb", "items_count",
        F.get("items_top3", F.lit(0))["url"].alias("first_url"),
    )


@query("psi_accessibility_ps05_f09", O.sql(ISSUES, psi=O.PSI, ia=_audits(dim.ACCESSIBILITY_AUDITS)))
def _(spark, d):
    return pagespeed.accessibility_issues(_psi(spark, d)).select("url", "strategy", "rank", "id", "title", "items_count")


ITEMS = """SELECT url, strategy, id, i, pos FROM (SELECT url, strategy, id, unnest(CAST(json_extract(a, '$.details.items') AS JSON[])[1:3]) AS i,
 unnest(range(least(3, CAST(json_array_length(a, '$.details.items') AS BIGINT)))) AS pos FROM {} WHERE a IS NOT NULL AND {}) WHERE i IS NOT NULL"""


@query(
    "psi_opportunity_items_ps04",
    O.sql(
        """SELECT url, strategy, id, pos, coalesce(nullif(i->>'$.url', ''), nullif(i->>'$.source.url', ''), '—') AS item_url, coalesce(CAST(i->>'$.wastedMs' AS DOUBLE), 0.0) AS wasted_ms,
 CAST(coalesce(round(CAST(i->>'$.wastedBytes' AS DOUBLE) / 1024), 0) AS BIGINT) AS wasted_kb FROM items""",
        psi=O.PSI,
        oa=_audits(dim.OPPORTUNITY_AUDITS),
        items=ITEMS.format("oa", "CAST(a->>'$.score' AS DOUBLE) < 0.9"),
    ),
)
def _(spark, d):
    """The first three items of each opportunity (the list of three is the feature)."""
    rows = pagespeed.opportunities(_psi(spark, d)).select("url", "strategy", "id", F.posexplode("items_top3").alias("pos", "i"))
    return rows.select("url", "strategy", "id", "pos", F.col("i.url").alias("item_url"), "i.wasted_ms", "i.wasted_kb")


@query(
    "psi_accessibility_items_ps05",
    O.sql(
        """SELECT url, strategy, id, pos, coalesce(i->>'$.node.selector', '') AS selector, replace(coalesce(i->>'$.node.snippet', ''), chr(10), ' ') AS snippet,
 coalesce(i->>'$.node.explanation', '') AS explanation FROM items""",
        psi=O.PSI,
        ia=_audits(dim.ACCESSIBILITY_AUDITS),
        items=ITEMS.format("ia", "CAST(a->>'$.score' AS DOUBLE) <> 1"),
    ),
)
def _(spark, d):
    """The first three items of each issue (the list of three is the feature)."""
    rows = pagespeed.accessibility_issues(_psi(spark, d)).select("url", "strategy", "id", F.posexplode("items_top3").alias("pos", "i"))
    return rows.select("url", "strategy", "id", "pos", "i.*")


@query(
    "psi_recommendations_m11",
    O.sql(
        """SELECT url, strategy, 1 AS part, rank, CASE WHEN savings_ms > 0 OR savings_kb > 0 THEN concat(title, ' (', concat_ws(' ', CASE WHEN savings_ms > 0 THEN concat('-', CAST(CAST(savings_ms AS BIGINT) AS VARCHAR), 'ms') END,
 CASE WHEN savings_kb > 0 THEN concat('-', CAST(savings_kb AS VARCHAR), 'KB') END), ')') ELSE title END AS text FROM opp WHERE rank <= 8
 UNION ALL SELECT url, strategy, 2, rank, concat(title, ' (', CAST(items_count AS VARCHAR), ')') FROM iss WHERE rank <= 5""",
        psi=O.PSI,
        oa=_audits(dim.OPPORTUNITY_AUDITS),
        ia=_audits(dim.ACCESSIBILITY_AUDITS),
        opp=OPPORTUNITIES,
        iss=ISSUES,
    ),
)
def _(spark, d):
    psi = _psi(spark, d)
    return pagespeed.recommendations(pagespeed.opportunities(psi), pagespeed.accessibility_issues(psi))


# --- monitoring ------------------------------------------------------------------------------------------------


def _daily_layers(spark, d) -> DataFrame:
    """Daily score per site and layer: the largest of the day."""
    day = F.date_trunc("day", "run_ts").alias("run_ts")
    return D.layer_scores(spark, d).groupBy("site", day).agg(
        *[F.max(F.when(F.col("layer") == n, F.floor("score"))).alias(n) for n in ("main", "advanced", "validator")]
    )


@query(
    "composite_scores_m01",
    O.sql(
        f"""SELECT *, {O.whole(O.mean('main', 'advanced', 'validator'))} AS composite FROM (SELECT site, CAST(date_trunc('day', run_ts) AS TIMESTAMP) AS run_ts,
 {', '.join(f"CAST(max(floor(score)) FILTER (layer = '{n}') AS BIGINT) AS {n}" for n in ('main', 'advanced', 'validator'))} FROM ls GROUP BY ALL)""",
        ls=O.LAYERS,
    ),
)
def _(spark, d):
    return history.composite(_daily_layers(spark, d))


def _layer_changes(spark, d) -> DataFrame:
    return history.layer_changes(D.layer_scores(spark, d), ("run_ts", "tie"), "day")


@query(
    "layer_changes_m02_m06_j11",
    O.sql("SELECT site, layer, run_ts, tie, score, prev_score, round(delta, 6) AS delta, change FROM ch", ls=O.LAYERS, ch=O.CHANGES),
)
def _(spark, d):
    return _layer_changes(spark, d).withColumn("delta", F.round("delta", 6))


@query("failure_changes_m03", O.sql("SELECT site, CAST(run_ts AS TIMESTAMP) AS run_ts, check_id, change FROM fc", **{k: O.HIST_CTES[k] for k in ("ah", "fails", "runs", "fc")}))
def _(spark, d):
    return history.failure_changes(D.audit_history(spark, d))


@query("type_changes_m04", O.sql("SELECT site, CAST(run_ts AS TIMESTAMP) AS run_ts, schema_type, change FROM tc", **{k: O.HIST_CTES[k] for k in ("ah", "runs", "th", "tc")}))
def _(spark, d):
    return history.type_changes(D.type_history(spark, d))


def _diffs(spark, d) -> DataFrame:
    layers = _layer_changes(spark, d).withColumn("run_ts", F.date_trunc("day", "run_ts"))
    failures = history.failure_changes(D.audit_history(spark, d))
    return history.diff_status(layers, failures, history.type_changes(D.type_history(spark, d)))


@query("diff_status_m05", O.sql("SELECT site, CAST(run_ts AS TIMESTAMP) AS run_ts, regressions, improvements, status FROM st", **O.HIST_CTES))
def _(spark, d):
    return _diffs(spark, d)


@query("alerts_m12", O.sql("SELECT site, CAST(run_ts AS TIMESTAMP) AS run_ts, regressions, improvements FROM st WHERE status = 'REGRESSION'", **O.HIST_CTES))
def _(spark, d):
    return history.alerts(_diffs(spark, d)).drop("status")


@query(
    "score_trend_m06_src09",
    O.sql(
        "SELECT site, layer, strftime(run_ts, '%Y-%m-%d %H:%M') AS label, tie, score, prev_score FROM ch WHERE layer = 'main'",
        ls=O.LAYERS,
        ch=O.CHANGES,
    ),
)
def _(spark, d):
    main = D.layer_scores(spark, d).where(F.col("layer") == "main")
    return history.score_trend(main, ("run_ts", "tie"), "day").select("site", "layer", "label", "tie", "score", "prev_score")


@query(
    "moving_mean_m06",
    O.sql(
        """SELECT site, layer, run_ts, tie, score, CAST(sum(CAST(score AS DECIMAL(18,6))) OVER w AS DOUBLE) / count(*) OVER w AS mean, count(*) OVER w AS n_runs
 FROM ls WHERE score IS NOT NULL WINDOW w AS (PARTITION BY site, layer ORDER BY run_ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)""",
        ls=O.LAYERS,
    ),
)
def _(spark, d):
    return history.moving_mean(D.layer_scores(spark, d))


@query(
    "monthly_sketches",
    O.sql(
        """SELECT layer, CAST(date_trunc('month', run_ts) AS TIMESTAMP) AS period, count(*) AS n_runs, count(DISTINCT site) AS n_exact,
 true AS sites_close, true AS median_close FROM ls GROUP BY ALL""",
        ls=O.LAYERS,
    ),
)
def _(spark, d):
    """Sites and median score of each month by merged daily sketches, held against exact ones: sites within four standard
    errors, the median's rank within 4 %."""
    runs = D.layer_scores(spark, d)
    merged = history.merged_sketches(history.daily_sketches(runs))
    held = runs.withColumn("period", F.date_trunc("month", "run_ts")).join(merged, ["layer", "period"])
    below, upto = F.count_if(F.col("score") < F.col("median")), F.count_if(F.col("score") <= F.col("median"))
    exact = held.groupBy("layer", "period", "n_runs", "n_sites").agg(
        F.count_distinct("site").alias("n_exact"),
        # half of the scores lie between the two ranks of the median, give or take
        ((below <= 0.54 * F.count("score") + 1) & (upto >= 0.46 * F.count("score") - 1)).alias("median_close"),
    )
    bound = 4 * 1.04 / 2 ** (history.SKETCH_BITS / 2) * F.col("n_exact")
    return exact.withColumn("sites_close", F.abs(F.col("n_sites") - F.col("n_exact")) <= bound).drop("n_sites")


@query(
    "composite_trend_m06",
    O.sql(
        f"""SELECT site, run_ts, composite AS score, prev_score, composite - prev_score AS delta, strftime(run_ts, '%Y-%m-%d %H:%M') AS label FROM (
 SELECT *, lag(composite) OVER (PARTITION BY site ORDER BY run_ts) AS prev_score FROM (SELECT site, run_ts, CAST({O.whole(O.mean('main', 'advanced', 'validator'))} AS DOUBLE) AS composite
 FROM (SELECT site, CAST(date_trunc('day', run_ts) AS TIMESTAMP) AS run_ts, {', '.join(f"CAST(max(floor(score)) FILTER (layer = '{n}') AS BIGINT) AS {n}" for n in ('main', 'advanced', 'validator'))} FROM ls GROUP BY ALL)))""",
        ls=O.LAYERS,
    ),
)
def _(spark, d):
    return history.composite_trend(_daily_layers(spark, d))


@query(
    "first_changes_m03",
    O.sql(
        "SELECT site, CAST(run_ts AS TIMESTAMP) AS run_ts, change, check_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY site, run_ts, change ORDER BY check_id) AS rank FROM fc) WHERE rank <= 10",
        **{k: O.HIST_CTES[k] for k in ("ah", "fails", "runs", "fc")},
    ),
)
def _(spark, d):
    """The first ten changes of each kind, as the report lists them (the list is the feature; ``diff_status`` counts all)."""
    return history.first_changes(history.failure_changes(D.audit_history(spark, d)), "check_id")


def _quality_findings(spark, d) -> DataFrame:
    sig = written_table(_signals(spark, d), "signals")
    stats = quality.performance(sig, signals.page_elements(D.pages(spark, d)), D.assets(spark, d))
    found = quality.performance_findings(stats).unionByName(quality.accessibility_findings(quality.accessibility(sig)))
    found = found.unionByName(quality.contrast_findings(quality.worst_contrast(D.css_files(spark, d))))
    return found.unionByName(quality.content_findings(quality.content_quality(sig)))


@query("quality_findings_b01_b04_b05_b08", O.sql("SELECT site, module, check_id, status, round(value, 6) AS value FROM qf", **O.FINDING_CTES))
def _(spark, d):
    """Findings of performance, accessibility, contrast and content, with their bands."""
    return _quality_findings(spark, d).select("site", "module", "check_id", "status", F.round("value", 6).alias("value"))


@query(
    "finding_counts_m07",
    O.sql(
        """SELECT site, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'warn') AS warn
 FROM (SELECT site, status FROM fi UNION ALL SELECT site, status FROM qf) GROUP BY site""",
        **{**O.CORE_CTES, **O.FINDING_CTES},
    ),
)
def _(spark, d):
    """ok, fail and warn over the findings of all modules."""
    columns = ["site", "status"]
    return history.finding_counts(_core_findings(spark, d).select(*columns).unionByName(_quality_findings(spark, d).select(*columns)))


def _core_findings(spark, d) -> DataFrame:
    sig, *others = _core_inputs(spark, d)
    return core.core_audit(written_table(sig, "signals"), *others)


@query(
    "top_recommendations_m08",
    O.sql(
        """SELECT site, rank, module, check_id, status, detail FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN status = 'fail' THEN 0 ELSE 1 END, ord, module, check_id, coalesce(detail, '')) AS rank
 FROM (SELECT site, module, check_id, status, detail, ord FROM fi UNION ALL SELECT site, module, check_id, status, detail, ord FROM qf) WHERE status IN ('fail', 'warn')) WHERE rank <= 10""",
        **{**O.CORE_CTES, **O.FINDING_CTES},
    ),
)
def _(spark, d):
    """Ten problems a site, over the findings of all modules (the list of ten is the feature)."""
    later = history.after_core(_quality_findings(spark, d))
    return history.top_recommendations(_core_findings(spark, d).unionByName(later))


@query(
    "module_status_m09",
    O.sql(
        """SELECT site, module, CASE WHEN bool_or(status = 'fail') THEN 'fail' ELSE 'ok' END AS status, count(*) AS n_findings FROM fi GROUP BY site, module
 UNION ALL SELECT site, concat('[adv] ', module), CASE WHEN score >= 80 THEN 'ok' WHEN score >= 50 THEN 'warn' ELSE 'fail' END, NULL FROM (UNPIVOT (SELECT site, performance, accessibility, content FROM modules) ON performance, accessibility, content INTO NAME module VALUE score)""",
        **O.CORE_CTES,
        **O.QUALITY_CTES,
    ),
)
def _(spark, d):
    _, *others = _core_inputs(spark, d)
    sig = written_table(_signals(spark, d), "signals")
    scores = quality.module_scores(quality.performance(sig), quality.accessibility(sig), quality.content_quality(sig))
    names = ("performance", "accessibility", "content")
    rows = F.array(*[F.struct(F.lit(f"[adv] {n}").alias("module"), F.col(n).alias("score")) for n in names])
    scored = history.scored_module_status(scores.select("site", F.explode(rows).alias("r")).select("site", "r.*"))
    extra = scored.select("site", "module", "status", F.lit(None).cast("bigint").alias("n_findings"))
    return history.core_module_status(core.core_audit(sig, *others)).unionByName(extra)


def _layer_table(spark, d) -> DataFrame:
    _, *others = _core_inputs(spark, d)
    sig = written_table(_signals(spark, d), "signals")
    modules = quality.module_scores(quality.performance(sig), quality.accessibility(sig), quality.content_quality(sig))
    validator = SD.site_summary(SD.page_reports(D.pages(spark, d)))
    return history.layer_scores(core.site_score(core.core_audit(sig, *others)), modules.drop("avg_score"), validator)


ALL_CTES = {**O.CORE_CTES, **O.QUALITY_CTES, **{k: O.REPORT_CTES[k] for k in ("o0", "o", "rules", "vals", "iss", "rep")}, "val": O.VALIDATOR}


@query(
    "layer_scores_m10",
    O.sql(
        """SELECT *, CASE WHEN score >= 80 THEN '#16a34a' WHEN score >= 50 THEN '#d97706' ELSE '#dc2626' END AS colour FROM (
 SELECT site, 'main' AS layer, score FROM core UNION ALL SELECT site, 'validator', score FROM val UNION ALL SELECT site, 'performance', performance FROM modules
 UNION ALL SELECT site, 'accessibility', accessibility FROM modules UNION ALL SELECT site, 'content', content FROM modules)""",
        **ALL_CTES,
    ),
)
def _(spark, d):
    return _layer_table(spark, d)


def _site_categories(spark, d) -> DataFrame:
    """Page-speed scores of a site: mean of its pages, cut; the lowest SEO score."""
    scores = pagespeed.category_scores(_psi(spark, d)).withColumn("site", tables.site_of(F.col("url")))
    means = [F.floor(F.avg(c)).alias(c) for c in ("performance", "accessibility", "best_practices")]
    return scores.groupBy("site").agg(*means, F.min("seo").alias("seo"))


@query(
    "headline_cards_m13",
    O.sql(
        """SELECT *, CASE WHEN score IS NULL THEN 'gray' WHEN score >= 90 THEN 'green' WHEN score >= 50 THEN 'amber' ELSE 'red' END AS colour FROM (
 SELECT site, 'performance' AS card, performance AS score FROM cards UNION ALL SELECT site, 'accessibility', accessibility FROM cards
 UNION ALL SELECT site, 'best_practices', best_practices FROM cards UNION ALL SELECT cards.site, 'seo', coalesce(nullif(seo, 0), core.score) FROM cards LEFT JOIN core ON core.site = cards.site)""",
        **O.CORE_CTES,
        psi=O.PSI,
        cards=O.CARDS,
    ),
)
def _(spark, d):
    return history.headline_cards(_site_categories(spark, d), core.site_score(_core_findings(spark, d)))


@query(
    "gates_f10",
    O.sql(
        """SELECT site, 'core' AS gate, fail = 0 AS passed FROM core UNION ALL SELECT site, 'schema', errors = 0 FROM val
 UNION ALL SELECT site, 'pagespeed', (performance + accessibility + best_practices + seo) / 4 >= 80 FROM cards
 UNION ALL SELECT provider, 'citation', rate >= 30 FROM (SELECT provider, count(*) FILTER (cited AND error = '') / greatest(count(*) FILTER (error = ''), 1) * 100 AS rate FROM c GROUP BY provider)""",
        **ALL_CTES,
        psi=O.PSI,
        cards=O.CARDS,
        **O.CITE_CTES,
    ),
)
def _(spark, d):
    fine = F.coalesce("error", F.lit("")) == ""
    rates = _citations(spark, d).groupBy(F.col("provider").alias("site")).agg(
        (F.count_if(F.col("cited") & fine) / F.greatest(F.count_if(fine), F.lit(1)) * 100).alias("overall_citation_rate")
    )
    validator = SD.site_summary(SD.page_reports(D.pages(spark, d)))
    return history.gates(core.site_score(_core_findings(spark, d)), validator, _site_categories(spark, d), rates)


# --- generation ------------------------------------------------------------------------------------------------

TITLE_OR_REL = f"coalesce(nullif({O.strip(chr(39).join(['regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)']))}, ''), rel)"
REL = "SELECT *, ltrim(path, '/') AS rel FROM pg"
NL = "chr(10)"


def _file_rows(name: str, head: str, lines: str) -> str:
    """Head rows of the sites that have lines, then a row for each page."""
    return f"""SELECT site, '{name}' AS path, 1 AS part, path AS page_path, page_id, text FROM ({lines})
 UNION ALL SELECT site, '{name}', 0, '', NULL, {head} FROM about WHERE site IN (SELECT site FROM ({lines}))"""


@query(
    "llms_txt_g01_snk03",
    O.sql(
        _file_rows(
            "llms.txt",
            f"concat('# ', site_name, {NL}, {NL}, '> ', description, {NL}, {NL}, '## Articles', {NL})",
            f"SELECT site, path, page_id, concat('- [', {TITLE_OR_REL}, '](', base_url, '/', rel, ')') AS text FROM r JOIN about USING (site) WHERE rel NOT IN ('404.html', '500.html')",
        ),
        pg=O.PG, r=REL, sites=O.SITES, about=O.ABOUT,
    ),
)
def _(spark, d):
    """All pages of every site."""
    return generate.llms_txt(D.pages(spark, d), D.about(spark, d))


@query(
    "llms_full_txt_g02",
    O.sql(
        _file_rows(
            "llms-full.txt",
            f"concat('# ', site_name, ' — full content', {NL}, {NL}, '> ', description, {NL})",
            f"SELECT site, path, page_id, concat({NL}, '## ', {TITLE_OR_REL.replace(', rel)', ", split_part(rel, '/', -1))")}, {NL}, {NL}, {O.strip(O.FULL_BODY)}, {NL}) AS text FROM r",
        ),
        pg=O.PG, r=REL, sites=O.SITES, about=O.ABOUT,
    ),
)
def _(spark, d):
    """All pages of every site."""
    return generate.llms_full_txt(D.pages(spark, d), D.about(spark, d))


ROBOT_HEAD = "concat_ws(chr(10), '# AI crawlers', " + ", ".join(f"'User-agent: {b}'" for b, _, _ in dim.AI_BOTS) + ", 'Allow: /', '', '# Other crawlers', 'User-agent: *', 'Allow: /', 'Disallow: /admin/', 'Disallow: /private/', 'Disallow: /.git/', 'Disallow: /data/', '', '')"


@query(
    "robots_txt_g03",
    O.sql(
        f"SELECT site, 'robots.txt' AS path, concat({ROBOT_HEAD}, 'Sitemap: ', base_url, '/sitemap.xml', {NL}, '# Text files: ', base_url, '/llms.txt, ', base_url, '/llms-full.txt', {NL}, {NL}, '# AI training data manifest', {NL}, '# Allow: ', base_url, '/llms.txt', {NL}, '# Allow: ', base_url, '/llms-full.txt', {NL}, '# Allow: ', base_url, '/ai.txt', {NL}) AS content FROM about",
        sites=O.SITES,
        about=O.ABOUT,
    ),
)
def _(spark, d):
    return generate.robots_txt(D.about(spark, d))


ENTRY = rf"""SELECT site, path, page_id, regexp_replace(concat(base_url, '/', rel), '/index\.html$', '/') AS loc, strftime(fetched_at, '%Y-%m-%d') AS lastmod,
 CASE WHEN rel = 'index.html' THEN 'daily' ELSE 'weekly' END AS changefreq, CASE WHEN rel = 'index.html' THEN '1.0' ELSE '0.8' END AS priority,
 coalesce(array_to_string(list_transform(regexp_extract_all(html, '<img[^>]+src=["'']([^"'']+)["'']', 1), lambda i: concat('    <image:image>', chr(10), '      <image:loc>',
 CASE WHEN starts_with(i, 'http') THEN i WHEN starts_with(i, '/') THEN concat(base_url, i) ELSE concat(base_url, '/', i) END, '</image:loc>', chr(10), '    </image:image>', chr(10))), ''), '') AS images
 FROM r JOIN about USING (site) WHERE rel NOT IN ('404.html', '500.html')"""


def _sitemap_sql(per_file: int) -> str:
    parts = f"""SELECT site, concat('sitemap-', CAST(part AS STRING), '.xml') AS path, concat('<?xml version="1.0" encoding="UTF-8"?>', {NL}, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"', {NL},
 '        xmlns:image="http://www.google.com/schemas/sitemap-image/0.9">', {NL}, string_agg(concat('  <url>', {NL}, '    <loc>', loc, '</loc>', {NL}, '    <lastmod>', lastmod, '</lastmod>', {NL},
 '    <changefreq>', changefreq, '</changefreq>', {NL}, '    <priority>', priority, '</priority>', {NL}, images, '  </url>'), {NL} ORDER BY path, page_id), {NL}, '</urlset>') AS content
 FROM (SELECT *, ('0x' || substr(md5(concat(path, '#', CAST(page_id AS STRING))), 1, 8))::BIGINT % CAST(ceil(count(*) OVER (PARTITION BY site) / {per_file}) AS BIGINT) + 1 AS part FROM e) GROUP BY site, part"""
    body = f"""SELECT site, path, content FROM parts UNION ALL SELECT site, 'sitemap.xml', concat('<?xml version="1.0" encoding="UTF-8"?>', {NL}, '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', {NL},
 string_agg(concat('  <sitemap><loc>https://', site, '/', path, '</loc></sitemap>'), {NL} ORDER BY path), {NL}, '</sitemapindex>') FROM parts GROUP BY site"""
    return O.sql(body, pg=O.PG, r=REL, sites=O.SITES, about=O.ABOUT, e=ENTRY, parts=parts)


def _sitemaps(spark, d, **options) -> DataFrame:
    about = D.about(spark, d)
    files = generate.sitemap_files(generate.sitemap_entries(D.pages(spark, d), about), **options)
    return files.unionByName(generate.sitemap_index(files, about))


@query("sitemap_xml_g04", _sitemap_sql(20_000))
def _(spark, d):
    return _sitemaps(spark, d)


@query("sitemap_parts_g04", _sitemap_sql(7))
def _(spark, d):
    """The same files with small parts, so that sites of any size have several."""
    return _sitemaps(spark, d, per_file=7)


@query(
    "self_hosted_fonts_g06",
    O.sql(
        r"""SELECT page_id, bare <> html AS changed, CASE WHEN bare <> html THEN regexp_replace(bare, '(?i)</head>', concat('  <link rel="stylesheet" href="/fonts/fonts.css">', chr(10), '</head>')) ELSE html END AS html FROM (
 SELECT page_id, html, regexp_replace(html, '(?i)<link[^>]+(fonts\.googleapis\.com|fonts\.gstatic\.com)[^>]*>', '', 'g') AS bare FROM pg)""",
        pg=O.PG,
    ),
)
def _(spark, d):
    return generate.self_hosted_fonts(D.pages(spark, d)).select("page_id", "changed", "html")


DECLARED = """SELECT page_id, list(DISTINCT schema_type) AS ts FROM (SELECT page_id, unnest(CASE json_type(n, '$."@type"') WHEN 'ARRAY' THEN json_extract_string(n, '$."@type"[*]')
 WHEN 'VARCHAR' THEN [json_extract_string(n, '$."@type"')] ELSE [] END) AS schema_type FROM (SELECT page_id, obj AS n FROM o UNION ALL SELECT page_id, v FROM roots WHERE json_type(v) = 'OBJECT')) GROUP BY page_id"""


def _ld(body: str) -> str:
    return f"concat('<script type=\"application/ld+json\">', CAST(to_json({body}) AS VARCHAR), '</script>', chr(10))"


ORGANIZATION_ID = "{'@id': concat(base_url, '/#organization')}"
LD_WEBSITE = f"""{{'@context': 'https://schema.org', '@type': 'WebSite', '@id': concat(base_url, '/#website'), 'name': site_name, 'url': base_url, 'description': about_text, 'inLanguage': 'pl-PL',
 'publisher': {ORGANIZATION_ID}, 'potentialAction': {{'@type': 'SearchAction', 'target': concat(base_url, '/?q={{search_term_string}}'), 'query-input': 'required name=search_term_string'}}}}"""
LD_ORGANIZATION = """{'@context': 'https://schema.org', '@type': 'Organization', '@id': concat(base_url, '/#organization'), 'name': site_name, 'url': base_url, 'description': about_text,
 'logo': concat(base_url, '/icons/icon-512.png'), 'sameAs': CAST([] AS VARCHAR[])}"""
LD_CRUMBS = "{'@context': 'https://schema.org', '@type': 'BreadcrumbList', 'itemListElement': crumbs}"
LD_ARTICLE = f"""{{'@context': 'https://schema.org', '@type': 'Article', 'headline': title, 'description': description, 'url': regexp_replace(concat(base_url, '/', rel), '/index[.]html$', '/'),
 'datePublished': '{D.TODAY}', 'dateModified': '{D.TODAY}', 'inLanguage': 'pl-PL', 'isPartOf': {{'@id': concat(base_url, '/#website')}}, 'publisher': {ORGANIZATION_ID},
 'author': {{'@type': 'Organization', '@id': concat(base_url, '/#organization')}}}}"""
LACKING = {
    "WebSite": ("NOT list_contains(ts, 'WebSite')", LD_WEBSITE),
    "Organization": ("NOT list_contains(ts, 'Organization')", LD_ORGANIZATION),
    "BreadcrumbList": ("NOT list_contains(ts, 'BreadcrumbList')", LD_CRUMBS),
    "Article": ("NOT list_contains(ts, 'Article') AND rel <> 'index.html' AND rel LIKE '%.html'", LD_ARTICLE),
}
CRUMBS = """SELECT page_id, list({'@type': 'ListItem', 'position': position, 'name': name, 'item': item} ORDER BY position) AS crumbs FROM (
 SELECT page_id, CAST(1 AS INTEGER) AS position, 'Home' AS name, base_url AS item FROM tr UNION ALL
 SELECT page_id, CAST(i + 1 AS INTEGER), array_to_string(list_transform(string_split(replace(ps[i], '-', ' '), ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' '), concat(base_url, '/', array_to_string(ps[1:i], '/')) FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM tr)
 UNION ALL SELECT page_id, CAST(len(ps) + 2 AS INTEGER), title, concat(base_url, '/', rel) FROM tr WHERE rel LIKE '%.html' AND rel <> 'index.html') GROUP BY page_id"""
TITLED_PAGES = """SELECT tp.page_id, tp.title, tp.description, r.rel, r.html, a.base_url, a.site_name, a.description AS about_text,
 list_filter(string_split(replace(rel, 'index.html', ''), '/'), lambda p: p <> '' AND NOT p LIKE '%.html') AS ps FROM tp JOIN r ON r.page_id = tp.page_id JOIN about a ON a.site = r.site"""


@query(
    "schema_injection_g07",
    O.sql(
        f"""SELECT page_id, CASE WHEN headed THEN concat_ws(',', {', '.join(f"CASE WHEN {test} THEN '{name}' END" for name, (test, _) in LACKING.items())}) ELSE '' END AS added,
 replace(html, '</head>', concat({', '.join(f"CASE WHEN {test} THEN {_ld(body)} ELSE '' END" for test, body in LACKING.values())}, '</head>')) AS html
 FROM (SELECT tr.*, coalesce(d.ts, CAST([] AS VARCHAR[])) AS ts, crumbs, contains(html, '</head>') AS headed FROM tr LEFT JOIN dt d ON d.page_id = tr.page_id JOIN cr ON cr.page_id = tr.page_id)""",
        **O.JSON_CTES,
        r=REL, sites=O.SITES, about=O.ABOUT, dt=DECLARED, tp=PAGE_TEXTS, tr=TITLED_PAGES, cr=CRUMBS,
    ),
)
def _(spark, d):
    """Types added and the whole new page."""
    return generate.with_schema(D.pages(spark, d), D.about(spark, d), D.TODAY).select("page_id", "added", "html")


TITLED = f"SELECT page_id, rel, base_url, {TITLE_OR_REL} AS title, list_filter(string_split(replace(rel, 'index.html', ''), '/'), lambda p: p <> '' AND NOT p LIKE '%.html') AS ps FROM r JOIN about USING (site)"


@query(
    "breadcrumbs_g08",
    O.sql(
        """SELECT page_id, 1 AS position, 'Home' AS name, base_url AS item FROM t UNION ALL
 SELECT page_id, i + 1, array_to_string(list_transform(string_split(replace(ps[i], '-', ' '), ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' '), concat(base_url, '/', array_to_string(ps[1:i], '/')) FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM t)
 UNION ALL SELECT page_id, len(ps) + 2, title, concat(base_url, '/', rel) FROM t WHERE rel LIKE '%.html' AND rel <> 'index.html'""",
        pg=O.PG, r=REL, sites=O.SITES, about=O.ABOUT, t=TITLED,
    ),
)
def _(spark, d):
    rel = generate.relative_path(F.col("path"))
    pages = D.pages(spark, d).join(D.about(spark, d), "site").withColumn("title", generate.page_title(F.col("html"), rel))
    items = generate.breadcrumbs(rel, F.col("base_url"), F.col("title"))
    return pages.select("page_id", F.explode(items).alias("i")).select("page_id", "i.position", "i.name", "i.item")


# --- streams ---------------------------------------------------------------------------------------------------


@query(
    "daily_page_audit_st01",
    O.sql(
        """SELECT site, CAST(date_trunc('day', fetched_at) AS TIMESTAMP) AS day, count(*) AS pages, count(*) FILTER (NOT has_lang OR skips_level OR n_landmarks < 3) AS poor_pages,
 count(*) FILTER (age_days > 365) AS stale_pages FROM s JOIN (SELECT page_id, fetched_at FROM pg) USING (page_id)
 WHERE CAST(date_trunc('day', fetched_at) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(fetched_at) FROM pg) - INTERVAL 2 DAY GROUP BY ALL""",
        **O.SIG_CTES,
    ),
)
def _(spark, d):
    """The pages file as a stream, run until it is used up: the days the watermark has closed."""
    pages = tables.table_stream(spark, d, "pages").select(
        F.expr(D.SITE).alias("site"),
        "page_id",
        F.expr(D.PATH).alias("path"),
        F.expr(D.HTML).alias("html"),
        F.expr(D.FETCHED_AT).alias("fetched_at"),
    )
    folder = f"{shared_dir(spark)}/crawlgauge/daily-{_run_id()}"
    page_audit.start_daily_audit(pages, f"{folder}/days", f"{folder}/progress", as_of=D.AS_OF).awaitTermination()
    # as long as no day is closed there is no file to take the schema from
    return spark.read.schema(page_audit.daily_page_audit(pages, D.AS_OF).schema).parquet(f"{folder}/days")


@query(
    "daily_page_audit_batch_st01",
    O.sql(
        """SELECT site, CAST(date_trunc('day', fetched_at) AS TIMESTAMP) AS day, count(*) AS pages, count(*) FILTER (NOT has_lang OR skips_level OR n_landmarks < 3) AS poor_pages,
 count(*) FILTER (age_days > 365) AS stale_pages FROM s JOIN (SELECT page_id, fetched_at FROM pg) USING (page_id) GROUP BY ALL""",
        **O.SIG_CTES,
    ),
)
def _(spark, d):
    """Every day of a finished crawl."""
    return page_audit.daily_page_audit_batch(D.pages(spark, d), D.AS_OF)


@query(
    "regression_alerts_st02",
    O.sql(
        "SELECT site, layer, run_ts, tie, score, prev_score, change FROM ch WHERE change = 'regression'", ls=O.LAYERS, ch=O.CHANGES
    ),
)
def _(spark, d):
    """The events file as a stream of scores, run until it is used up: the drops."""
    runs = tables.table_stream(spark, d, "events").select(
        F.expr("concat('site-', CAST(user_id AS STRING))").alias("site"),
        F.expr(D.LAYER).alias("layer"),
        F.col("ts").alias("run_ts"),
        F.col("event_id").alias("tie"),
        F.col("value").alias("score"),
    )
    folder = f"{shared_dir(spark)}/crawlgauge/alerts-{_run_id()}"
    alerts.start_alerts(runs, folder).awaitTermination()
    return alerts.read_alerts(spark, folder)


def _run_id() -> str:
    import uuid

    return uuid.uuid4().hex
