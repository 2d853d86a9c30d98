"""Site tables derived from the given ones, by expressions that Spark and DuckDB both run.

The given pages have no images, structured data or forms, so markup is inserted by rules on ``page_id``; every page is
kept. Resources, headers, assets and CSS follow from the sites; page-speed documents from the pages; assistant answers
from the conversations; audit history from the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from ..sources.tables import spread

AS_OF = "2025-06-01 00:00:00"
TODAY = "2025-06-01"
DOMAIN = "www.acme.example"
BRAND = "Acme"

SITE = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
RAW_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
# folders become index pages: the site's own home page is index.html
PATH = f"""CASE WHEN {RAW_PATH} = '' THEN '/index.html'
 WHEN {RAW_PATH} LIKE '%/' THEN concat({RAW_PATH}, 'index.html')
 WHEN page_id % 17 = 0 THEN '/index.html' ELSE {RAW_PATH} END"""

TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"

HEAD_PARTS = [
    ("page_id % 3 = 0", """concat('<meta name="description" content="', repeat('d', CAST(20 + page_id % 160 AS INT)), '">')"""),
    (
        "page_id % 5 = 2",
        """concat('<meta property="article:tag" content="t1"><meta property="article:tag" content="t2">',
 '<meta property="article:tag" content="t3"><meta property="article:tag" content="t4">',
 CASE WHEN page_id % 2 = 0 THEN '<meta property="article:tag" content="t5">' ELSE '' END)""",
    ),
    ("page_id % 7 = 1", """'<link href="https://fonts.googleapis.com/css?family=A" rel="stylesheet">'"""),
    ("page_id % 14 = 1", """'<link rel="preconnect" href="https://fonts.gstatic.com">'"""),
    (
        "page_id % 8 = 0",
        """concat('<meta content="', CAST(2021 + page_id % 5 AS STRING), '-01-15T00:00:00Z" property="article:published_time">')""",
    ),
    ("page_id % 16 = 8", """'<meta property="article:modified_time" content="2025-03-01">'"""),
    ("page_id % 9 = 4", """'<link rel="preload" href="/f/a.woff2" as="font">'"""),
    ("page_id % 3 = 2", """concat('<link rel="stylesheet" href="/css/s', CAST(page_id % 4 AS STRING), '.css">')"""),
    ("page_id % 4 = 3", """'<script src="/js/app.js"></script>'"""),
    ("page_id % 8 = 5", """'<script type="module" src="/js/m.js"></script>'"""),
    ("page_id % 8 = 6", """'<script async src="/js/a.js"></script>'"""),
    ("page_id % 6 = 2", """'<meta property="og:image" content="/og.png">'"""),
    (
        "page_id % 5 = 0",
        """concat('<script type="application/ld+json">{"@type":"Article","headline":"h","image":"/i.png","datePublished":"',
 CASE WHEN page_id % 2 = 0 THEN '2024-01-01' ELSE '01/01/2024' END,
 '","inLanguage":"en","wordCount":', CASE WHEN page_id % 3 = 0 THEN '"9"' ELSE '9' END,
 ',"author":{"@type":"Person","name":"A"},"publisher":{"@id":"#o"}}</script>')""",
    ),
    (
        "page_id % 5 = 1",
        """concat('<script type="application/ld+json">{"@graph":[{"@type":"WebSite","url":"u","name":"n"},',
 '{"@type":["Organization","X"],"name":"n","@id":"#o"},{"@type":"WebPage","url":"https://a.b/c","publisher":{"@id":"',
 CASE WHEN page_id % 2 = 0 THEN '#o' ELSE '#gone' END, '"}}]}</script>')""",
    ),
    ("page_id % 10 = 2", """'<script type="application/ld+json">{bad</script>'"""),
    (
        "page_id % 10 = 3",
        """concat('<script type="application/ld+json">[{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"q"}]},',
 '{"@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"a","item":"u"}]},',
 '{"@type":"HowTo","name":"n","step":{"@type":"HowToStep"}},5]</script>')""",
    ),
    (
        "page_id % 10 = 7",
        """concat('<script type="application/ld+json">{"@type":"Product"}</script>',
 '<script type="application/ld+json">{"@type":"ImageObject","url":"https://a.b/i.png","width":"x"}</script>',
 '<script type="application/ld+json">{"@type":"SpeakableSpecification","cssSelector":[]}</script>')""",
    ),
]

BODY_PARTS = [
    ("page_id % 4 = 1", """concat('<img src="/i/', CAST(page_id AS STRING), '.webp" alt="x" loading="lazy">')"""),
    ("page_id % 4 = 2", """concat('<img src="/i/', CAST(page_id AS STRING), '.PNG?v=1.png"><img alt="">')"""),
    ("page_id % 6 = 3", """'<img src="/i/logo.jpg" alt="logo"><img src="https://cdn.example/x.avif" alt="c" loading="eager">'"""),
    ("page_id % 6 = 1", f"""concat('<h2>', {TITLE}, '?</h2><h2>How</h2>')"""),
    ("page_id % 6 = 4", """concat('<h2>Why choose gadget', CAST(page_id % 7 AS STRING), ' today really?</h2><h2>Because</h2><h3>Sub?</h3>')"""),
    ("page_id % 6 = 0", """'<header></header><main></main>'"""),
    ("page_id % 7 = 0", """'<a href="https://x.edu/p">r</a> 10.1234/abc <a href="https://doi.org/10.5/z">d</a>'"""),
    ("page_id % 7 = 3", """'<h4>Jump</h4>'"""),
    ("page_id % 7 = 5", """'<h1>Again</h1>'"""),
    ("page_id % 5 = 3", """'<a class="skip-link" href="#main">s</a>'"""),
    ("page_id % 6 = 5", """'<div role="doc-bibliography"></div>'"""),
    ("page_id % 8 = 2", """'<span itemprop="author">A</span>'"""),
    ("page_id % 9 = 2", """'<p data-nosnippet>cta</p>'"""),
    ("page_id % 11 = 0", """'<picture></picture>'"""),
    ("page_id % 9 = 0", """'<input type="text" id="q"><label for="q">Q</label><input id="z">'"""),
    ("page_id % 9 = 1", """'<input type="hidden" id="h"><input aria-label="n">'"""),
    ("page_id % 10 = 4", """'<p>In 2024 about 35 people paid 3,5 kg for Jan Kowalski. Prof. Anna Nowak agreed in 1999.</p>'"""),
]


def _inserted(parts) -> str:
    return "concat(" + ",\n".join(f"CASE WHEN {test} THEN {text} ELSE '' END" for test, text in parts) + ")"


HTML = f"""replace(replace(CASE WHEN page_id % 13 = 0 THEN replace(html, '<html lang=', '<html data-l=') ELSE html END,
 '</head>', concat({_inserted(HEAD_PARTS)}, '</head>')),
 '</article>', concat({_inserted(BODY_PARTS)}, '</article>'))"""

FETCHED_AT = "CAST(date_add(DATE '2024-01-01', CAST(page_id % 400 AS INT)) AS TIMESTAMP)"

# robots.txt by k, llms.txt, sitemap.xml and so on: which site has which file, and its text
ROBOTS = """CASE WHEN k % 8 = 0 THEN concat_ws(chr(10), 'User-agent: GPTBot', 'User-agent: CCBot', 'Disallow: /', '', 'Sitemap: x')
 WHEN k % 8 = 2 THEN concat_ws(chr(10), 'User-agent: GPTBot', 'Allow: /', '', 'User-agent: omgilibot', 'Disallow: /data', '# llms.txt')
 WHEN k % 8 = 4 THEN concat_ws(chr(10), 'user-agent: *', 'Disallow:', 'User-agent: PerplexityBot # all', 'Disallow: /', 'Crawl-delay: 5', 'User-agent: ClaudeBot', 'Allow: /')
 ELSE concat_ws(chr(10), 'Sitemap: https://a.b/sitemap.xml', 'User-agent: Bytespider', 'User-agent: Diffbot', 'Disallow: /private/', 'User-agent: GPTBot', 'Disallow: /') END"""
RESOURCE_RULES = [
    ("robots.txt", "k % 2 = 0", ROBOTS),
    (
        "llms.txt",
        "k % 3 = 0",
        """concat('# ', site, chr(10), chr(10), CASE WHEN k % 2 = 0 THEN '## Articles' ELSE '## Pages' END, chr(10), '- one', chr(10))""",
    ),
    ("llms-full.txt", "k % 5 = 1", """concat('full text of ', site, chr(10), 'in  five', chr(9), 'more words')"""),
    (
        "sitemap.xml",
        "k % 2 = 1",
        """concat('<urlset>', CASE WHEN k % 3 = 0 THEN '<url>' ELSE '' END, '<loc>https://', site, '/index.html</loc><loc> https://', site, '/en/1.html </loc>',
 '<loc>https://', site, '/index.html</loc><loc>https://other.example/x</loc>',
 CASE WHEN k % 4 = 1 THEN '<lastmod>2024-01-01</lastmod><image:loc>i</image:loc>' ELSE '' END,
 CASE WHEN k % 5 = 3 THEN '<changefreq>daily</changefreq><priority>1.0</priority>' ELSE '' END, '</urlset>')""",
    ),
    (".htaccess", "k % 4 <> 3", """concat_ws(chr(10), 'Header set X-Frame-Options DENY', CASE WHEN k % 3 = 1 THEN 'Header set Strict-Transport-Security max-age=1' ELSE '' END, CASE WHEN k % 5 = 2 THEN 'mod_deflate' ELSE '' END)"""),
    ("sw.js", "k % 7 = 2", "'self'"),
    ("manifest.json", "k % 5 = 0", "'{}'"),
]
HEADER_RULES = [
    ("X-Content-Type-Options", "nosniff", "k % 2 = 0"),
    ("X-Frame-Options", "DENY", "k % 3 = 0"),
    ("Strict-Transport-Security", "max-age=31536000", "k % 5 = 0"),
    ("Content-Security-Policy", "default-src self", "k % 7 = 0"),
    ("Referrer-Policy", "no-referrer", "k % 4 = 1"),
    ("Permissions-Policy", "geolocation=()", "k % 6 = 1"),
    ("Content-Encoding", "br", "k % 3 = 1"),
    ("Cache-Control", "public", "k % 8 = 1"),
]
OWN_IMAGE_BYTES = "1000 * (page_id % 400)"
SHARED_ASSETS = [
    ("'i/logo.jpg'", "250000 + 1000 * (k % 7)"),
    ("'css/s2.css'", "90000 + k % 10"),
    ("'css/s1.css'", "80000"),
    ("'js/app.js'", "1000 * (k % 3)"),
    ("CASE WHEN k % 2 = 0 THEN 'fonts/a.woff2' ELSE 'other/a.woff2' END", "30000 + k"),
]
CSS = """concat(':root{--color-text:#', CASE WHEN k % 2 = 0 THEN '1a2b3c' ELSE '777777' END, ';--color-ink-soft: #5a6b7',
 CAST(k % 10 AS STRING), ';--color-bg:#', CASE WHEN k % 3 = 0 THEN 'fff' ELSE 'F0F0E8' END, ';--color-surface: #d0d4d8}')"""

N_CSS = 7


def css_text(i: int) -> str:
    """Text of a site's ``i``-th stylesheet."""
    return CSS.replace("k %", f"(k + {i - 1}) %")


# One stored page-speed document per page. Numbers stay short so both engines print them alike.
PSI_BODY = """concat('{"lighthouseResult":{"categories":{"performance":{"score":0.', CAST(10 + page_id % 90 AS STRING),
 '},"accessibility":{"score":0.', CAST(10 + (page_id * 7) % 90 AS STRING),
 '},"best-practices":{"score":1},"seo":{"score":', CASE WHEN page_id % 5 = 0 THEN 'null' ELSE '0.9' END,
 '}},"audits":{"largest-contentful-paint":{"displayValue":"', CAST(page_id % 9 AS STRING), '.5 s","numericValue":',
 CAST(500 + page_id % 9000 AS STRING), ',"score":0.', CAST(page_id % 10 AS STRING),
 '},"cumulative-layout-shift":{"numericValue":0,"score":1},"unused-css-rules":{"title":"Reduce unused CSS","description":"Drop rules. More text.","score":0.',
 CAST(page_id % 10 AS STRING), ',"displayValue":"x","details":{"overallSavingsMs":', CAST(page_id % 700 AS STRING),
 ',"overallSavingsBytes":', CAST((page_id % 50) * 3000 AS STRING),
 ',"items":[{"url":"https://a.b/1","wastedMs":5,"wastedBytes":4096},{"source":{"url":"s"}},{},{}]}},',
 '"redirects":{"score":', CASE WHEN page_id % 3 = 0 THEN '0.95' ELSE '0.5' END, ',"details":{"overallSavingsMs":', CAST(page_id % 300 AS STRING),
 '}},"image-alt":{"title":"Images need alt","score":', CASE WHEN page_id % 4 = 0 THEN '1' ELSE '0' END,
 ',"details":{"items":[{"node":{"selector":"img","snippet":"<img>"}}]}},"list":{"score":0,"title":"Lists"}}},',
 '"loadingExperience":{"metrics":{',
 CASE WHEN page_id % 2 = 0 THEN concat('"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":', CAST(1000 + page_id % 3000 AS STRING),
 ',"category":"FAST"},"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":', CAST(page_id % 40 AS STRING),
 ',"category":"SLOW"},"INTERACTION_TO_NEXT_PAINT":{"percentile":', CAST(page_id % 500 AS STRING), '}') ELSE '' END,
 '}}}')"""

ANSWER = f"""concat(a.text,
 CASE WHEN a.conv_id % 3 = 0 THEN ' see https://{DOMAIN}/x I recommend it' ELSE '' END,
 CASE WHEN a.conv_id % 4 = 1 THEN ' Acme is outdated and poor, ACME.example is unreliable.' ELSE '' END)"""

LAYER = "CASE event_type WHEN 'click' THEN 'main' WHEN 'view' THEN 'advanced' WHEN 'error' THEN 'validator' ELSE 'other' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, page_id, url, path, html, fetched_at) with the markup inserted."""
    configure(spark)
    raw = spread(table(spark, sf_dir, "pages"), "page_id")
    return raw.select(
        F.expr(SITE).alias("site"),
        "page_id",
        "url",
        F.expr(PATH).alias("path"),
        F.expr(HTML).alias("html"),
        F.expr(FETCHED_AT).alias("fetched_at"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, k): k is the smallest page of the site and decides which files it has."""
    raw = table(spark, sf_dir, "pages")
    return raw.groupBy(F.expr(SITE).alias("site")).agg(F.min("page_id").alias("k"))


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.array(
        *[
            F.when(F.expr(test), F.struct(F.lit(path).alias("path"), F.expr(text).alias("content")))
            for path, test, text in RESOURCE_RULES
        ]
    )
    listed = sites(spark, sf_dir).select("site", F.explode(F.array_compact(files)).alias("f"))
    return listed.select(
        "site",
        "f.*",
        F.octet_length("f.content").cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("error"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = F.array(
        *[
            F.when(F.expr(test), F.struct(F.lit(name), F.lit(value)))
            for name, value, test in HEADER_RULES
        ]
    )
    return sites(spark, sf_dir).select("site", F.map_from_entries(F.array_compact(sent)).alias("headers"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, path, bytes): the pages' own images, shared stylesheets, scripts and fonts."""
    raw = table(spark, sf_dir, "pages").select(F.expr(SITE).alias("site"), "page_id")
    own = raw.where("page_id % 4 = 1").select(
        "site", F.expr("concat('i/', CAST(page_id AS STRING), '.webp')").alias("path"), F.expr(OWN_IMAGE_BYTES).cast("bigint").alias("bytes")
    )
    shared = F.array(
        *[F.struct(F.expr(path).alias("path"), F.expr(size).cast("bigint").alias("bytes")) for path, size in SHARED_ASSETS]
    )
    common = sites(spark, sf_dir).select("site", F.explode(shared).alias("a")).select("site", "a.*")
    return own.unionByName(common)


def css_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven stylesheets a site, each with colours of its own."""
    files = F.array(*[F.struct(F.lit(f"css/s{i}.css").alias("path"), F.expr(css_text(i)).alias("content")) for i in range(1, N_CSS + 1)])
    return sites(spark, sf_dir).select("site", F.explode(files).alias("f")).select("site", "f.*")


def psi_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    raw = spread(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    return raw.select(
        F.expr("concat(url, '#', CAST(page_id AS STRING))").alias("url"),
        F.expr("CASE WHEN page_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END").alias("strategy"),
        F.expr(PSI_BODY).alias("body"),
    )


def probe_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers, the user turn before as the query (null where there is none). Both join keys together
    are one turn."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").alias("a")
    asked = turns.where("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query")
    )
    failed = "a.conv_id % 11 = 0"
    return answers.join(asked.alias("q"), ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        F.expr("concat('provider-', CAST(a.conv_id % 4 AS STRING))").alias("provider"),
        F.lit("m").alias("model"),
        "query",
        F.expr(f"CASE WHEN {failed} THEN '' ELSE {ANSWER} END").alias("response_text"),
        F.expr(f"CASE WHEN {failed} THEN 'HTTP 500' ELSE '' END").alias("error"),
    )


def layer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scores: user is the site, event type the layer. ``tie`` orders equal times."""
    configure(spark)
    return table(spark, sf_dir, "events").select(
        F.expr("concat('site-', CAST(user_id AS STRING))").alias("site"),
        F.expr(LAYER).alias("layer"),
        F.col("ts").alias("run_ts"),
        F.col("event_id").alias("tie"),
        F.col("value").alias("score"),
    )


def audit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings of daily runs: a check is failing when its smallest value of the day is under 4."""
    configure(spark)
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.expr("concat('site-', CAST(user_id AS STRING))").alias("site"),
            F.date_trunc("day", "ts").alias("run_ts"),
            F.col("event_type").alias("check_id"),
        )
        .agg(F.min("value").alias("value"))
        .withColumn("status", F.when(F.col("value") < 4, "fail").otherwise("ok"))
    )


def type_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the types seen per daily run."""
    configure(spark)
    return table(spark, sf_dir, "events").select(
        F.expr("concat('site-', CAST(user_id AS STRING))").alias("site"),
        F.date_trunc("day", "ts").alias("run_ts"),
        F.col("event_type").alias("schema_type"),
    )


def about(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).select(
        "site",
        F.concat(F.lit("https://"), "site").alias("base_url"),
        F.concat(F.lit("Site "), "site").alias("site_name"),
        F.concat(F.lit("About "), "site").alias("description"),
    )
