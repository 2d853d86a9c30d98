"""Column expressions that read signals out of raw HTML.

Everything here is Column -> Column and runs inside the JVM; patterns are literals, so Spark compiles each
one once per task. Python-style Unicode classes need ``(?U)`` in Java patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: what counts as a tag, an attribute, a heading and so on.
ATTRIBUTE = r'(?U)(\w[\w:-]*)\s*=\s*"([^"]*)"'
IMG = r"(?i)<img\b([^>]*)>"
INPUT = r"(?i)<input\b([^>]*)>"
META = r"(?i)<meta\b([^>]*)/?>"
LABEL_FOR = r"""(?i)<label\b[^>]*for\s*=\s*["']([^"']+)["']"""
STYLESHEET = r"""(?i)<link\b[^>]*rel\s*=\s*["']stylesheet["'][^>]*>"""
HREF = r"""(?i)href\s*=\s*["']([^"']+)["']"""
SRC = r"""(?i)src\s*=\s*["']([^"']+)["']"""
FONT_PRELOAD = r"""(?i)<link\b[^>]*rel\s*=\s*["']preload["'][^>]*as\s*=\s*["']font["']"""
# a script that holds up parsing: external, not async, not deferred, not a module
BLOCKING_SCRIPT = (
    r"""(?i)<script\b(?![^>]*\b(?:async|defer)\b)(?![^>]*\btype\s*=\s*["']module["'])[^>]*\bsrc=[^>]*>"""
)
HEADING = r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>"
ANCHOR_HREF = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
PARAGRAPH = r"(?is)<p\b[^>]*>(.*?)</p>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HTML_LANG = r"""(?i)<html\b[^>]*\blang\s*=\s*["']([^"']+)["']"""
META_DESCRIPTION = r"""(?i)<meta\b[^>]*name=["']description["'][^>]*content=["']([^"']*)["']"""
ARTICLE_TAG = r"""(?i)<meta\b[^>]*property=["']article:tag["'][^>]*content=["']([^"']*)["']"""
QUESTION_HEADING = r"(?s)<h[23][^>]*>.*?\?</h[23]>"
JSONLD_BLOB = r"""(?is)<script\s+type=["']application/ld\+json["']>(.*?)</script>"""
GOOGLE_FONT_LINK = r"""(?i)<link[^>]+href=["'](https?://fonts\.googleapis\.com[^"']+)["'][^>]*>"""
FONT_HOST_LINK = r"(?i)<link[^>]+(fonts\.googleapis\.com|fonts\.gstatic\.com)[^>]*>"
PLAIN_DOI = r"""\b10\.\d{4,}/[^\s<>"]+"""
PLAIN_AUTHORITY_URL = (
    r"https?://(?:www\.)?(?:pubmed|ncbi\.nlm\.nih\.gov|scholar\.google|arxiv\.org|biorxiv\.org)/\S+"
)

# Fixed value lists
MODERN_IMAGE_FORMATS = ("webp", "avif")
UNLABELLED_INPUT_TYPES = ("hidden", "submit", "button", "reset")
LANDMARKS = ("<header", "<main", "<nav", "<aside", "<footer")
SKIP_LINK_MARKS = ("skip-link", "skip-to-main", 'href="#main', "href='#main")
# boilerplate dropped before reading a page's own text, per use
CONTENT_BOILERPLATE = ("head", "script", "style", "nav", "footer")
KEYWORD_BOILERPLATE = ("head", "script", "style", "nav", "footer", "aside")
FULL_TEXT_BOILERPLATE = ("head", "script", "style")


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def contains_any(c: Column, needles) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(c, F.lit(needle))
    return found


def visible_text(html: Column) -> Column:
    """Tags become spaces, white space collapses, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"(?U)\s+", " "))


def attribute(tag: Column, name: str) -> Column:
    """Value of a double-quoted attribute; the last one wins, NULL when absent."""
    names = F.reverse(find_all(F.lower(tag), ATTRIBUTE, 1))
    values = F.reverse(find_all(tag, ATTRIBUTE, 2))
    at = F.array_position(names, name).cast("int")
    return F.when(at > 0, F.element_at(values, at))


def attribute_map(tag: Column) -> Column:
    """All attributes as a map with lower-case keys; the last duplicate wins."""
    names = find_all(F.lower(tag), ATTRIBUTE, 1)
    return F.map_from_entries(
        F.transform(F.array_distinct(names), lambda n: F.struct(n, _last_value(tag, n)))
    )


def _last_value(tag: Column, name: Column) -> Column:
    names = F.reverse(find_all(F.lower(tag), ATTRIBUTE, 1))
    values = F.reverse(find_all(tag, ATTRIBUTE, 2))
    return F.element_at(values, F.array_position(names, name).cast("int"))


def meta_content(html: Column, key: str) -> Column:
    """Content of the first <meta> whose property (else name) is ``key`` and whose content is not empty."""
    metas = F.transform(
        find_all(html, META, 1),
        lambda tag: F.struct(
            F.lower(F.coalesce(F.nullif(attribute(tag, "property"), F.lit("")), attribute(tag, "name"))).alias("key"),
            attribute(tag, "content").alias("content"),
        ),
    )
    hits = F.filter(metas, lambda m: (m["key"] == key.lower()) & (m["content"] != ""))
    return F.get(hits, 0)["content"]


def without_blocks(html: Column, tags) -> Column:
    """HTML with whole elements removed, one tag after the other."""
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}>", "")
    return html


def paragraphs(body: Column) -> Column:
    return F.transform(find_all(body, PARAGRAPH, 1), visible_text)


def title(html: Column) -> Column:
    return visible_text(F.regexp_extract(html, TITLE, 1))


def first_heading(html: Column, level: int) -> Column:
    return visible_text(F.regexp_extract(html, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", 1))


def headings(html: Column, level: int) -> Column:
    return F.transform(find_all(html, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", 1), visible_text)


def heading_levels(html: Column) -> Column:
    return F.transform(find_all(html, HEADING, 1), lambda level: level.cast("int"))


def skips_heading_level(levels: Column) -> Column:
    """True when some heading is more than one level below the heading before it."""
    steps = F.zip_with(levels, F.slice(levels, 2, F.size(levels)), lambda a, b: b - a)
    return F.coalesce(F.exists(steps, lambda step: step > 1), F.lit(False))


def images(html: Column) -> Column:
    """array<struct<src, alt, loading, ext>>; src and alt are NULL when the attribute is missing."""
    tags = F.transform(
        find_all(html, IMG, 1),
        lambda tag: F.struct(
            attribute(tag, "src").alias("src"),
            attribute(tag, "alt").alias("alt"),
            attribute(tag, "loading").alias("loading"),
        ),
    )
    return F.transform(tags, lambda i: i.withField("ext", image_format(i["src"])))


def image_format(src: Column) -> Column:
    return F.substring_index(F.substring_index(F.lower(src), ".", -1), "?", 1)


def inputs(html: Column) -> Column:
    """array<struct<type, id, aria>> of the form inputs that need a label."""
    tags = F.transform(
        find_all(html, INPUT, 1),
        lambda tag: F.struct(
            F.lower(F.coalesce(attribute(tag, "type"), F.lit("text"))).alias("type"),
            F.coalesce(attribute(tag, "id"), F.lit("")).alias("id"),
            (attribute(tag, "aria-label").isNotNull() | attribute(tag, "aria-labelledby").isNotNull()).alias("aria"),
        ),
    )
    return F.filter(tags, lambda i: ~i["type"].isin(*UNLABELLED_INPUT_TYPES))


def label_targets(html: Column) -> Column:
    return find_all(html, LABEL_FOR, 1)


def stylesheet_refs(html: Column) -> Column:
    return F.transform(find_all(html, STYLESHEET), lambda tag: F.regexp_extract(tag, HREF, 1))


def blocking_script_refs(html: Column) -> Column:
    return F.transform(find_all(html, BLOCKING_SCRIPT), lambda tag: F.regexp_extract(tag, SRC, 1))


def landmark_count(html: Column) -> Column:
    lowered = F.lower(html)
    total = F.lit(0).cast("bigint")
    for mark in LANDMARKS:
        total = total + F.contains(lowered, F.lit(mark)).cast("bigint")
    return total


def jsonld_blobs(html: Column) -> Column:
    return find_all(html, JSONLD_BLOB, 1)


def link_targets(html: Column) -> Column:
    return find_all(html, ANCHOR_HREF, 1)


def citation_count(html: Column, plain_text_from: Column, fragments) -> Column:
    """Links to authorities, or plain-text DOIs plus authority URLs, whichever is larger."""
    links = F.size(F.filter(link_targets(html), lambda href: contains_any(F.lower(href), fragments)))
    plain = count_of(plain_text_from, r"(?U)" + PLAIN_DOI) + count_of(plain_text_from, r"(?U)" + PLAIN_AUTHORITY_URL)
    return F.greatest(links.cast("bigint"), plain)


def google_font_links(html: Column) -> Column:
    return find_all(html, GOOGLE_FONT_LINK, 1)


def insert_before_head_end(html: Column, addition: Column) -> Column:
    """``addition`` goes before the first </head>; pages without one come back unchanged."""
    at = F.regexp_instr(html, F.lit(r"(?i)</head>"))
    return F.when(
        at > 0, F.concat(F.substring(html, F.lit(1), at - 1), addition, F.substring(html, at, F.length(html)))
    ).otherwise(html)


def home_url(url: Column) -> Column:
    return F.regexp_replace(url, r"/index\.html$", "/")


def first_long_paragraph(html: Column, min_words: int = 15, max_chars: int = 300) -> Column:
    found = F.filter(
        F.transform(find_all(html, r"(?is)<p[^>]*>(.*?)</p>", 1), visible_text),
        lambda p: F.size(F.split(p, " ")) >= min_words,
    )
    return F.coalesce(F.substring(F.get(found, 0), 1, max_chars), F.lit(""))


def css_colours(css: Column, names) -> Column:
    """Hex values of the colour variables whose name starts with one of ``names``."""
    return find_all(css, rf"--color-({'|'.join(names)})[^:]*:\s*(#[0-9a-fA-F]+)", 2)
