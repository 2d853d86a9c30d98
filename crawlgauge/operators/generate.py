"""Generated site files and rewritten pages, as rows.

``pages`` has (site, page_id, path, html) and for sitemaps ``fetched_at``. ``about`` has one row per site:
(site, base_url, site_name, description); ``base_url`` has no trailing slash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import jsonld as J
from ..functions.rows import each
from ..sources.dimensions import AI_BOTS
from ..sources.tables import first_per_site

ERROR_PAGES = ("404.html", "500.html")
DISALLOWED = ("/admin/", "/private/", "/.git/", "/data/")
FONT_STYLESHEET = '<link rel="stylesheet" href="/fonts/fonts.css">'
# Fixed pattern: the description as the generator reads it (name before content, nothing between)
GENERATOR_DESCRIPTION = r"""(?i)<meta\s+name=["']description["']\s+content=["']([^"']*)["']"""


def relative_path(path: Column) -> Column:
    return F.regexp_replace(path, "^/+", "")


def _or(*choices: Column) -> Column:
    """First choice that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def page_title(html: Column, rel: Column) -> Column:
    h1 = H.visible_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return _or(H.title(html), h1, rel)


def page_description(html: Column, fallback: Column) -> Column:
    return _or(F.regexp_extract(html, GENERATOR_DESCRIPTION, 1), H.first_long_paragraph(html), fallback)


FILE_ROWS = ("site", "path", "part", "page_path", "page_id", "text")


def joined_files(rows: DataFrame) -> DataFrame:
    """(site, path, content): the rows of each file joined. For sites whose files fit into one cell; the rows themselves,
    written in order by ``sinks.write_file_rows``, are the form that holds for any size."""
    lines = F.array_sort(F.collect_list(F.struct("part", "page_path", "page_id", "text")))
    return rows.groupBy("site", "path").agg(F.concat(F.array_join(F.transform(lines, lambda s: s["text"]), "\n"), F.lit("\n")).alias("content"))


def _with_head(lines: DataFrame, about: DataFrame, name: str, head: Column) -> DataFrame:
    """File rows: the head (part 0) of every site that has lines, then a row for each page (part 1)."""
    heads = about.join(lines.select("site").distinct(), "site", "left_semi").select(
        "site", F.lit(0).alias("part"), F.lit("").alias("page_path"), F.lit(None).cast(lines.schema["page_id"].dataType).alias("page_id"), head.alias("text")
    )
    every = heads.unionByName(lines.select("site", F.lit(1).alias("part"), F.col("path").alias("page_path"), "page_id", "text"))
    return every.withColumn("path", F.lit(name)).select(*FILE_ROWS)


def llms_txt(pages: DataFrame, about: DataFrame, max_pages: int | None = None) -> DataFrame:
    """llms.txt as file rows, a row for each page by path, error pages left out.

    ``max_pages`` is the index's own option to list only the first pages; off unless asked for.
    """
    narrow = pages.select("site", "page_id", "path", H.title(F.col("html")).alias("title"))
    first = narrow if max_pages is None else first_per_site(narrow, max_pages, "path", "page_id")
    kept = first.withColumn("rel", relative_path(F.col("path"))).where(~F.col("rel").isin(*ERROR_PAGES))
    named = kept.join(about.select("site", "base_url"), "site")
    line = F.concat(F.lit("- ["), _or(F.col("title"), F.col("rel")), F.lit("]("), "base_url", F.lit("/"), "rel", F.lit(")"))
    head = F.concat(F.lit("# "), "site_name", F.lit("\n\n> "), "description", F.lit("\n\n## Articles\n"))
    return _with_head(named.withColumn("text", line), about, "llms.txt", head)


def llms_full_txt(pages: DataFrame, about: DataFrame, max_pages: int | None = None) -> DataFrame:
    """llms-full.txt as file rows: title and whole visible text of each page by path. ``max_pages`` as in ``llms_txt``."""
    first = pages if max_pages is None else first_per_site(pages, max_pages, "path", "page_id")
    body = H.without_blocks(F.col("html"), H.FULL_TEXT_BOILERPLATE)
    name = F.substring_index(relative_path(F.col("path")), "/", -1)
    section = F.concat(F.lit("\n## "), _or(H.title(F.col("html")), name), F.lit("\n\n"), H.visible_text(body), F.lit("\n"))
    head = F.concat(F.lit("# "), "site_name", F.lit(" — full content\n\n> "), "description", F.lit("\n"))
    return _with_head(first.select("site", "page_id", "path", section.alias("text")), about, "llms-full.txt", head)


def robots_txt(about: DataFrame, allow_ai: bool = True, disallowed=DISALLOWED) -> DataFrame:
    """robots.txt naming every known crawler, the disallowed folders, the sitemap and the text files."""
    # Fixed format of the file; its two comment headings are in English here
    crawlers = [f"User-agent: {name}" for name, _, _ in AI_BOTS]
    rules = ["# AI crawlers", *crawlers, f"{'Allow' if allow_ai else 'Disallow'}: /", ""]
    rules += ["# Other crawlers", "User-agent: *", "Allow: /", *[f"Disallow: {p}" for p in disallowed], ""]
    content = F.concat(
        F.lit("\n".join(rules) + "\nSitemap: "),
        "base_url",
        F.lit("/sitemap.xml\n# Text files: "),
        "base_url",
        F.lit("/llms.txt, "),
        "base_url",
        F.lit("/llms-full.txt\n\n# AI training data manifest\n# Allow: "),
        "base_url",
        F.lit("/llms.txt\n# Allow: "),
        "base_url",
        F.lit("/llms-full.txt\n# Allow: "),
        "base_url",
        F.lit("/ai.txt\n"),
    )
    return about.select("site", F.lit("robots.txt").alias("path"), content.alias("content"))


def _xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def sitemap_entries(pages: DataFrame, about: DataFrame) -> DataFrame:
    """One <url> element per page: (site, path, page_id, loc, priority, changefreq, lastmod, xml)."""
    rel, base, html = F.col("rel"), F.col("base_url"), F.col("html")
    home = rel == "index.html"
    loc = F.concat(base, F.regexp_replace(F.concat(F.lit("/"), rel), r"/index\.html$", "/"))
    refs = H.find_all(html, r"""<img[^>]+src=["']([^"']+)["']""", 1)
    absolute = F.transform(
        refs,
        lambda r: F.when(F.startswith(r, F.lit("http")), r)
        .when(F.startswith(r, F.lit("/")), F.concat(base, r))
        .otherwise(F.concat(base, F.lit("/"), r)),
    )
    images = F.array_join(
        F.transform(
            absolute,
            lambda u: F.concat(F.lit("    <image:image>\n      <image:loc>"), _xml(u), F.lit("</image:loc>\n    </image:image>\n")),
        ),
        "",
    )
    staged = (
        pages.select("site", "page_id", "path", "html", "fetched_at")
        .withColumn("rel", relative_path(F.col("path")))
        .where(~rel.isin(*ERROR_PAGES))
    )
    staged = staged.join(about.select("site", "base_url"), "site")
    entry = F.concat(
        F.lit("  <url>\n    <loc>"), _xml(F.col("loc")), F.lit("</loc>\n    <lastmod>"), "lastmod",
        F.lit("</lastmod>\n    <changefreq>"), "changefreq", F.lit("</changefreq>\n    <priority>"), "priority",
        F.lit("</priority>\n"), "images", F.lit("  </url>"),
    )
    return staged.select(
        "site",
        "path",
        "page_id",
        loc.alias("loc"),
        F.date_format("fetched_at", "yyyy-MM-dd").alias("lastmod"),
        F.when(home, "daily").otherwise("weekly").alias("changefreq"),
        F.when(home, "1.0").otherwise("0.8").alias("priority"),
        images.alias("images"),
    ).withColumn("xml", entry)


SITEMAP_OPEN = (
    '<?xml version="1.0" encoding="UTF-8"?>\n'
    '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"\n'
    '        xmlns:image="http://www.google.com/schemas/sitemap-image/0.9">\n'
)


def sitemap_files(entries: DataFrame, per_file: int = 20_000) -> DataFrame:
    """Numbered parts, sitemap-1.xml and so on, of about ``per_file`` URLs each; ``sitemap_index`` lists them.

    All sites get parts and an index, whatever their size. Parts are cut by a hash of the page, so a large site is
    written by many tasks; 20 000 keeps parts well under the protocol's 50 000 URLs.
    """
    sizes = entries.groupBy("site").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / per_file).cast("bigint"))
    placed = entries.join(sizes, "site")
    code = F.conv(F.left(F.md5(F.concat_ws("#", "path", "page_id")), F.lit(8)), 16, 10).cast("bigint")
    numbered = placed.withColumn("part", F.pmod(code, F.col("parts")) + 1)
    urls = F.array_sort(F.collect_list(F.struct("path", "page_id", F.col("xml").alias("text"))))
    listed = numbered.groupBy("site", "part").agg(F.array_join(F.transform(urls, lambda s: s["text"]), "\n").alias("urls"))
    return listed.select(
        "site",
        F.concat(F.lit("sitemap-"), F.col("part").cast("string"), F.lit(".xml")).alias("path"),
        F.concat(F.lit(SITEMAP_OPEN), "urls", F.lit("\n</urlset>")).alias("content"),
    )


def sitemap_index(files: DataFrame, about: DataFrame) -> DataFrame:
    """sitemap.xml of every site: the list of its parts."""
    parts = files.select("site", "path")
    base = parts.join(about.select("site", "base_url"), "site")
    line = F.concat(F.lit("  <sitemap><loc>"), "base_url", F.lit("/"), "path", F.lit("</loc></sitemap>"))
    return base.groupBy("site").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("parts")).select(
        "site",
        F.lit("sitemap.xml").alias("path"),
        F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'),
            "parts",
            F.lit("\n</sitemapindex>"),
        ).alias("content"),
    )


def font_links(pages: DataFrame) -> DataFrame:
    """Distinct Google Fonts stylesheets per site."""
    return each(pages, ["site"], H.google_font_links(F.col("html")), "url").distinct()


def self_hosted_fonts(pages: DataFrame) -> DataFrame:
    """Pages without Google Fonts links and preconnects, with the local stylesheet instead: adds ``changed``."""
    html = F.col("html")
    bare = F.regexp_replace(F.regexp_replace(html, H.GOOGLE_FONT_LINK, ""), H.FONT_HOST_LINK, "")
    return (
        pages.withColumn("_bare", bare)
        .withColumn("changed", F.col("_bare") != html)
        .withColumn(
            "html",
            F.when(
                F.col("changed"), H.insert_before_head_end(F.col("_bare"), F.lit(f"  {FONT_STYLESHEET}\n"))
            ).otherwise(html),
        )
        .drop("_bare")
    )


def breadcrumbs(rel: Column, base: Column, title: Column, home_name: str = "Home") -> Column:
    """array<struct<type, position, name, item>>: home, each folder, then the page itself."""
    folders = F.filter(
        F.split(F.replace(rel, F.lit("index.html"), F.lit("")), "/"),
        lambda p: (p != "") & ~F.endswith(p, F.lit(".html")),
    )

    def item(position: Column, name: Column, url: Column) -> Column:
        return F.struct(
            F.lit("ListItem").alias("@type"),
            position.cast("int").alias("position"),
            name.alias("name"),
            url.alias("item"),
        )

    home = F.array(item(F.lit(1), F.lit(home_name), base))
    inner = F.transform(
        folders,
        lambda p, i: item(
            i + 2,
            F.initcap(F.replace(p, F.lit("-"), F.lit(" "))),
            F.concat(base, F.lit("/"), F.array_join(F.slice(folders, F.lit(1), i + 1), "/")),
        ),
    )
    page = F.when(
        F.endswith(rel, F.lit(".html")) & (rel != "index.html"),
        F.array(item(F.size(folders) + 2, title, F.concat(base, F.lit("/"), rel))),
    ).otherwise(F.slice(home, 1, 0))
    return F.concat(home, inner, page)


def _block(body: Column) -> Column:
    return F.concat(F.lit('<script type="application/ld+json">'), F.to_json(body), F.lit("</script>\n"))


def _thing(kind: str, **fields) -> list[Column]:
    return [F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type")] + [
        c.alias(name) for name, c in fields.items()
    ]


def with_schema(pages: DataFrame, about: DataFrame, today: str, lang: str = "pl-PL") -> DataFrame:
    """Pages with the missing structured data added before </head>: adds ``added`` (type names) and new ``html``.

    WebSite, Organization and BreadcrumbList go on every page, Article on all but the home page. Pages without
    </head> stay as they are. Existing types are read in the same row, so nothing is shuffled but ``about``.
    """
    html, base, rel = F.col("html"), F.col("base_url"), F.col("rel")
    existing = F.flatten(F.transform(H.jsonld_blobs(html), lambda b: J.declared_types(J.parse(b))))
    staged = (
        pages.join(about, "site")
        .withColumn("rel", relative_path(F.col("path")))
        .withColumn("_types", existing)
        .withColumn("_title", page_title(html, rel))
        .withColumn("_text", page_description(html, F.col("description")))
    )

    def lacks(kind: str) -> Column:
        return ~F.array_contains("_types", kind)

    def ref(name: str) -> Column:
        return F.struct(F.concat(base, F.lit(f"/#{name}")).alias("@id"))

    search = F.struct(
        F.lit("SearchAction").alias("@type"),
        F.concat(base, F.lit("/?q={search_term_string}")).alias("target"),
        F.lit("required name=search_term_string").alias("query-input"),
    )
    # Fixed format: names, order and wording of the inserted structured data
    website = _thing("WebSite", **{"@id": F.concat(base, F.lit("/#website"))}, name=F.col("site_name"), url=base,
                     description=F.col("description"), inLanguage=F.lit(lang), publisher=ref("organization"),
                     potentialAction=search)
    organization = _thing("Organization", **{"@id": F.concat(base, F.lit("/#organization"))}, name=F.col("site_name"),
                          url=base, description=F.col("description"),
                          logo=F.concat(base, F.lit("/icons/icon-512.png")), sameAs=F.array().cast("array<string>"))
    crumbs = _thing("BreadcrumbList", itemListElement=breadcrumbs(rel, base, F.col("_title")))
    author = F.struct(F.lit("Organization").alias("@type"), F.concat(base, F.lit("/#organization")).alias("@id"))
    article = _thing("Article", headline=F.col("_title"), description=F.col("_text"),
                     url=H.home_url(F.concat(base, F.lit("/"), rel)), datePublished=F.lit(today),
                     dateModified=F.lit(today), inLanguage=F.lit(lang), isPartOf=ref("website"),
                     publisher=ref("organization"), author=author)
    is_article = (rel != "index.html") & F.endswith(rel, F.lit(".html"))
    wanted = [
        ("WebSite", lacks("WebSite"), website),
        ("Organization", lacks("Organization"), organization),
        ("BreadcrumbList", lacks("BreadcrumbList"), crumbs),
        ("Article", lacks("Article") & is_article, article),
    ]
    has_head = html.rlike(r"(?i)</head>")
    blocks = F.concat(*[F.when(test, _block(F.struct(*body))).otherwise(F.lit("")) for _, test, body in wanted])
    names = F.concat_ws(",", *[F.when(test & has_head, F.lit(name)) for name, test, _ in wanted])
    return staged.withColumn("added", names).withColumn("html", H.insert_before_head_end(html, blocks)).select(
        *pages.columns, "added"
    )
