"""Core audit per site: well-known files, crawler rules, structured data, sitemap, security, fonts, content marks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html as H
from ..functions import text as T
from ..functions.rows import each
from ..sources.dimensions import AI_BOTS, EXPECTED_FILES, OPTIONAL_TYPES, REQUIRED_TYPES, SECURITY_HEADERS
from ..sources.tables import look_up_files
from .findings import Check, all_checks, check, ok_or, one_row_per_check


def site_files(sites: DataFrame, resources: DataFrame, paths=EXPECTED_FILES) -> DataFrame:
    """One row per site with the content of each expected file (NULL when missing), columns named by path."""
    found = look_up_files(sites, resources, paths)
    one = [F.max(F.when(F.col("path") == p, F.col("content"))).alias(p) for p in paths]
    return found.groupBy("site").agg(*one)


def _file(path: str) -> Column:
    return F.col(f"`{path}`")


def ai_file_checks() -> list[Check]:
    """llms.txt and llms-full.txt: present, line count, article section, word count."""
    short, full = _file("llms.txt"), _file("llms-full.txt")
    trimmed = F.regexp_replace(short, r"(?U)^\s+|\s+$", "")
    lines = F.size(F.split(trimmed, r"\r\n|\r|\n"))
    return [
        check("llms_txt", 101, ok_or(short.isNotNull()), F.when(trimmed == "", 0).otherwise(lines)),
        check(
            "llms_txt_articles",
            102,
            F.when(short.isNotNull(), ok_or(H.contains_any(F.lower(short), ("# artykuly", "articles")))),
        ),
        check("llms_full_txt", 103, ok_or(full.isNotNull()), F.size(T.space_tokens(full))),
    ]


def ai_files(files: DataFrame) -> DataFrame:
    return one_row_per_check(files, "ai_files", ai_file_checks())


def robots_directives(robots: DataFrame) -> DataFrame:
    """Lines of each robots.txt as (site, pos, field, value, grp).

    Consecutive User-agent lines open one group; the rules after them apply to all of its agents. A window sorts the
    lines of one file, which is one row of ``robots``.
    """
    line = F.trim(F.regexp_replace("line", r"#.*$", ""))
    parsed = (
        each(robots, ["site"], F.split("content", r"\r\n|\r|\n"), "line", "pos")
        .select(
            "site",
            "pos",
            F.lower(F.trim(F.substring_index(line, ":", 1))).alias("field"),
            F.trim(F.regexp_replace(line, r"^[^:]*:?", "")).alias("value"),
        )
        .where(F.col("field").isin("user-agent", "allow", "disallow"))
    )
    by_line = Window.partitionBy("site").orderBy("pos")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(by_line), F.lit("")) != "user-agent")
    running = by_line.rowsBetween(Window.unboundedPreceding, 0)
    return (
        parsed.withColumn("_opens", opens.cast("int")).withColumn("grp", F.sum("_opens").over(running)).drop("_opens")
    )


def compat_status(content: Column, bot: str) -> Column:
    """The line-block verdict: the text from the bot's first User-agent line up to the next one decides.

    In grouped records all bots but the last get an empty block there and pass; ``robots_verdicts`` reports this
    next to the group-aware status.
    """
    pattern = rf"(?iU)User-agent:\s*\Q{bot}\E\b((?:[^\n]*\n(?!\s*User-agent:|\s*\z))*+[^\n]*)"
    block = F.lower(F.regexp_extract(content, pattern, 1))
    cleaned = F.regexp_replace(block, r"(?U)disallow:\s*/(data|admin|api|private)\b[^\n]*", "")
    closed = cleaned.rlike(r"(?mdU)disallow:\s*/\s*$")
    named = F.contains(F.lower(content), F.lit(bot.lower()))
    return F.when(~named, "fail").when(content.rlike(pattern) & ~closed, "ok").otherwise("warn")


def robots_verdicts(robots: DataFrame) -> DataFrame:
    """Each known crawler against each robots.txt: ok (allowed), warn (blocked) or fail (not named).

    The crawlers are a fixed list of 26, put on each robots row as an array: no join against them.
    """
    directives = robots_directives(robots)
    blocked = directives.groupBy("site", "grp").agg(
        F.bool_or((F.col("field") == "disallow") & (F.col("value") == "/")).alias("blocked")
    )
    agents = (
        directives.where(F.col("field") == "user-agent")
        .select("site", "grp", F.lower("value").alias("agent"))
        .join(blocked, ["site", "grp"])
        .groupBy("site", "agent")
        .agg(F.bool_or("blocked").alias("blocked"))
    )
    # one literal pattern for each crawler: compiled once, not for each row
    bots = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(name).alias("bot"), F.lit(name.lower()).alias("agent"), compat_status(F.col("content"), name).alias("compat_status"))
            for i, (name, _, _) in enumerate(AI_BOTS)
        ]
    )
    asked = each(robots, ["site"], bots, "b").select("site", "b.*")
    status = F.when(F.col("blocked").isNull(), "fail").when(F.col("blocked"), "warn").otherwise("ok")
    return asked.join(agents, ["site", "agent"], "left").select(
        "site", "ord", "bot", status.alias("status"), "compat_status"
    )


def robots_file_checks() -> list[Check]:
    """robots.txt present, sitemap and llms.txt declared."""
    content = _file("robots.txt")
    given = content.isNotNull()
    return [
        check("robots_txt", 201, ok_or(given)),
        check("sitemap_declared", 298, F.when(given, ok_or(F.contains(F.lower(content), F.lit("sitemap:"))))),
        check(
            "llms_declared", 299, F.when(given, ok_or(H.contains_any(content, ("llms.txt", "llms-full.txt")), "warn"))
        ),
    ]


def robots_bot_findings(files: DataFrame) -> DataFrame:
    """One finding per crawler of each site with a robots.txt; ``detail`` is the line-block verdict."""
    content = _file("robots.txt")
    given = files.where(content.isNotNull()).select("site", content.alias("content"))
    return robots_verdicts(given).select(
        "site",
        F.lit("robots").alias("module"),
        F.concat(F.lit("bot:"), F.col("bot")).alias("check_id"),
        "status",
        F.lit(None).cast("double").alias("value"),
        F.col("compat_status").alias("detail"),
        (F.col("ord") + 202).alias("ord"),
    )


def robots(files: DataFrame) -> DataFrame:
    return one_row_per_check(files, "robots", robots_file_checks()).unionByName(robots_bot_findings(files))


def site_marks(signals: DataFrame) -> DataFrame:
    """Everything the core audit needs from the pages of a site, in one aggregation."""
    wanted = [*REQUIRED_TYPES, *OPTIONAL_TYPES]
    has = [F.bool_or(F.array_contains("jsonld_types", t)).alias(f"type:{t}") for t in wanted]
    return signals.groupBy("site").agg(
        F.count("*").alias("pages"),
        F.sum("n_jsonld_broken").alias("broken_blobs"),
        *has,
        F.min(F.when(F.col("uses_google_fonts"), F.struct("path", "page_id"))).alias("first_font_page"),
        F.sum("n_question_headings").alias("question_headings"),
        F.count_if("has_bibliography").alias("bibliography_pages"),
        F.count_if("has_author").alias("author_pages"),
        F.count_if("has_og_image").alias("og_image_pages"),
        F.count_if("has_nosnippet").alias("nosnippet_pages"),
    )


def structured_data_checks() -> list[Check]:
    """Syntax without errors, and each required and optional type found somewhere on the site."""
    checks = [check("jsonld_syntax", 301, F.when(F.col("broken_blobs") == 0, "ok"), F.col("broken_blobs"))]
    for i, t in enumerate(REQUIRED_TYPES):
        checks.append(check(f"type:{t}", 302 + i, ok_or(F.col(f"`type:{t}`"))))
    for i, t in enumerate(OPTIONAL_TYPES):
        checks.append(check(f"type:{t}", 307 + i, ok_or(F.col(f"`type:{t}`"), "info")))
    return checks


def jsonld_error_findings(signals: DataFrame) -> DataFrame:
    """One failure per blob that does not parse, naming the page."""
    bad = signals.where(F.col("n_jsonld_broken") > 0)
    each = F.sequence(F.lit(1), F.col("n_jsonld_broken").cast("int"))
    return bad.select("site", "page_id", F.explode(each)).select(
        "site",
        F.lit("structured_data").alias("module"),
        F.lit("jsonld_syntax").alias("check_id"),
        F.lit("fail").alias("status"),
        F.lit(None).cast("double").alias("value"),
        F.col("page_id").cast("string").alias("detail"),
        F.lit(301).alias("ord"),
    )


def structured_data(signals: DataFrame) -> DataFrame:
    checked = one_row_per_check(site_marks(signals), "structured_data", structured_data_checks())
    return checked.unionByName(jsonld_error_findings(signals))


def _occurrences(text: Column, needle: str) -> Column:
    return F.regexp_count(text, F.lit(re.escape(needle))).cast("bigint")


def sitemap_checks() -> list[Check]:
    """sitemap.xml present, URL count, image namespace, lastmod, changefreq, priority."""
    c = _file("sitemap.xml")
    urls = F.coalesce(F.nullif(_occurrences(c, "<url>"), F.lit(0)), _occurrences(c, "<loc>"))
    return [
        check("sitemap_xml", 401, ok_or(c.isNotNull()), urls),
        check("sitemap_images", 402, F.when(c.isNotNull(), ok_or(F.contains(c, F.lit("image:"))))),
        check("sitemap_lastmod", 403, F.when(c.isNotNull(), ok_or(F.contains(c, F.lit("<lastmod>")), "warn"))),
        check("sitemap_changefreq", 404, F.when(F.contains(c, F.lit("<changefreq>")), "ok")),
        check("sitemap_priority", 405, F.when(F.contains(c, F.lit("<priority>")), "ok")),
    ]


def sitemap(files: DataFrame) -> DataFrame:
    return one_row_per_check(files, "sitemap", sitemap_checks())


def _header_checks(applies: Column, present, compressed: Column, cached: Column) -> list[Check]:
    names = [
        check(check_id, 502 + i, F.when(applies, ok_or(present(header))))
        for i, (header, check_id) in enumerate(SECURITY_HEADERS)
    ]
    return [
        *names,
        check("compression", 508, F.when(applies, ok_or(compressed))),
        check("cache", 509, F.when(applies, ok_or(cached))),
    ]


def header_dump(headers: DataFrame) -> DataFrame:
    """All sent headers of a site as one lower-case text."""
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return headers.select("site", F.lower(F.array_join(lines, "\n")).alias("header_dump"))


def sent_header_checks() -> list[Check]:
    """Security headers as sent."""
    text = F.coalesce("header_dump", F.lit(""))
    return [
        check("headers", 501, ok_or(text != "")),
        *_header_checks(
            text != "",
            lambda h: F.contains(text, F.lit(h.lower())),
            F.contains(text, F.lit("content-encoding")),
            H.contains_any(text, ("cache-control", "max-age")),
        ),
    ]


def htaccess_checks() -> list[Check]:
    """Security headers as configured; the compression and cache tests differ from those on sent headers."""
    c = _file(".htaccess")
    return [
        check("htaccess", 501, ok_or(c.isNotNull())),
        *_header_checks(
            c.isNotNull(),
            lambda h: F.contains(F.lower(c), F.lit(h.lower())),
            H.contains_any(c, ("mod_deflate", "AddOutputFilterByType")),
            H.contains_any(c, ("ExpiresByType", "max-age")),
        ),
    ]


def security_from_headers(sites: DataFrame, headers: DataFrame) -> DataFrame:
    known = sites.select("site").join(header_dump(headers), "site", "left")
    return one_row_per_check(known, "security", sent_header_checks())


def security_from_htaccess(files: DataFrame) -> DataFrame:
    return one_row_per_check(files, "security", htaccess_checks())


def pwa_checks() -> list[Check]:
    return [
        check("service_worker", 601, ok_or(_file("sw.js").isNotNull())),
        check("manifest", 602, ok_or(_file("manifest.json").isNotNull())),
    ]


def pwa(files: DataFrame) -> DataFrame:
    return one_row_per_check(files, "pwa", pwa_checks())


def own_fonts(assets: DataFrame) -> DataFrame:
    """Self-hosted .woff2 files per site."""
    own = assets.where(F.col("path").rlike(r"^fonts/[^/]*\.woff2$"))
    return own.groupBy("site").agg(F.count("*").alias("n_fonts"), F.sum("bytes").alias("font_bytes"))


def font_checks(with_own: bool) -> list[Check]:
    """Google Fonts use, naming the first page by path; and the self-hosted files."""
    first = F.col("first_font_page")
    checks = [check("google_fonts", 703, F.when(first.isNotNull(), "fail").otherwise("ok"), None, first["page_id"])]
    if with_own:
        size = F.col("font_bytes")
        checks += [
            check("own_fonts", 701, ok_or(F.col("n_fonts").isNotNull()), F.col("n_fonts")),
            check("own_fonts_kb", 702, F.when(size.isNotNull(), "info"), F.floor(size / 1024)),
        ]
    return checks


def fonts(signals: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    marks = site_marks(signals)
    if assets is not None:
        marks = marks.join(own_fonts(assets), "site", "left")
    return one_row_per_check(marks, "fonts", font_checks(assets is not None))


def content_mark_checks() -> list[Check]:
    """Question headings and pages with bibliography, author, og:image and nosnippet marks, of how many pages."""
    names = ["question_headings", "bibliography_pages", "author_pages", "og_image_pages", "nosnippet_pages"]
    return [check(n, 801 + i, F.lit("info"), F.col(n), F.col("pages")) for i, n in enumerate(names)]


def content_marks(signals: DataFrame) -> DataFrame:
    return one_row_per_check(site_marks(signals), "content_marks", content_mark_checks())


SIGNALS = [
    "site", "page_id", "path", "jsonld_types", "n_jsonld_broken", "uses_google_fonts", "n_question_headings",
    "has_bibliography", "has_author", "has_og_image", "has_nosnippet",
]  # what the core audit reads of the page signals


def core_audit(
    signals: DataFrame,
    resources: DataFrame,
    headers: DataFrame | None = None,
    assets: DataFrame | None = None,
) -> DataFrame:
    """All core findings. With ``headers`` security is read from them, else from .htaccess.

    The pages of a site are aggregated once and the well-known files are looked up once; all checks are then read
    from that one row per site. ``signals`` is used three times: write it to a table first for a large crawl.
    """
    marks = site_marks(signals)
    files = site_files(marks.select("site"), resources)
    wide = marks.join(files, "site")
    if headers is not None:
        wide = wide.join(header_dump(headers), "site", "left")
    if assets is not None:
        wide = wide.join(own_fonts(assets), "site", "left")
    modules = {
        "ai_files": ai_file_checks(),
        "robots": robots_file_checks(),
        "structured_data": structured_data_checks(),
        "sitemap": sitemap_checks(),
        "security": htaccess_checks() if headers is None else sent_header_checks(),
        "pwa": pwa_checks(),
        "fonts": font_checks(assets is not None),
        "content_marks": content_mark_checks(),
    }
    return (
        all_checks(wide, modules)
        .unionByName(robots_bot_findings(files))
        .unionByName(jsonld_error_findings(signals))
    )


def site_score(findings: DataFrame) -> DataFrame:
    """ok / fail / warn counts and the core score: share of ok among ok and fail, cut."""
    counts = findings.groupBy("site").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "fail", "warn")])
    share = F.col("ok") / F.greatest(F.col("ok") + F.col("fail"), F.lit(1)) * 100
    return counts.withColumn("score", F.floor(share).cast("bigint"))
