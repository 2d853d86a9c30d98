"""Per-page signals: one narrow pass over the HTML that every audit aggregates from.

``page_signals`` is lazy: an audit that needs three signals only pays for those three, because Catalyst prunes the
other columns. For several audits over one crawl, write it to Parquet once and read it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import jsonld as J
from ..functions import text as T
from ..functions.rows import each
from ..functions.scoring import percent
from ..sources.dimensions import AUTHORITIES_CONTENT, AUTHORITIES_KEYWORDS

KEYS = ["site", "page_id"]


def performance_columns(html: Column) -> dict[str, Column]:
    return {
        "html_bytes": F.octet_length(html).cast("bigint"),
        "has_picture": F.contains(F.lower(html), F.lit("<picture>")),
        "n_stylesheets": H.count_of(html, H.STYLESHEET),
        "n_blocking_scripts": H.count_of(html, H.BLOCKING_SCRIPT),
        "has_font_preload": html.rlike(H.FONT_PRELOAD),
    }


def image_columns(images: Column) -> dict[str, Column]:
    """Counts over all <img> (accessibility) and over those with a source (performance)."""

    def n(test) -> Column:
        return F.size(F.filter(images, test)).cast("bigint")

    def sourced(i: Column) -> Column:
        return F.coalesce(i["src"], F.lit("")) != ""

    return {
        "n_img": F.size(images).cast("bigint"),
        "n_img_alt": n(lambda i: i["alt"].isNotNull()),
        "n_img_described": n(lambda i: i["alt"] != ""),
        "n_img_decorative": n(lambda i: i["alt"] == ""),
        "n_img_src": n(sourced),
        "n_img_src_modern": n(lambda i: sourced(i) & i["ext"].isin(*H.MODERN_IMAGE_FORMATS)),
        "n_img_src_lazy": n(lambda i: sourced(i) & (i["loading"] == "lazy")),
        "n_img_src_alt": n(lambda i: sourced(i) & i["alt"].isNotNull()),
    }


def accessibility_columns(html: Column, levels: Column, inputs: Column, labels: Column) -> dict[str, Column]:
    unlabelled = F.filter(inputs, lambda i: ~(F.array_contains(labels, i["id"]) | i["aria"]))
    return {
        "lang": F.regexp_extract(html, H.HTML_LANG, 1),
        "has_lang": html.rlike(H.HTML_LANG),
        "has_skip_link": H.contains_any(html, H.SKIP_LINK_MARKS),
        "n_landmarks": H.landmark_count(html),
        "n_h1": F.size(F.filter(levels, lambda v: v == 1)).cast("bigint"),
        "skips_level": H.skips_heading_level(levels),
        "n_inputs": F.size(inputs).cast("bigint"),
        "n_inputs_unlabelled": F.size(unlabelled).cast("bigint"),
    }


def mark_columns(html: Column) -> dict[str, Column]:
    """Marks counted by the core audit."""
    lowered = F.lower(html)
    return {
        "n_question_headings": H.count_of(html, H.QUESTION_HEADING),
        "has_bibliography": F.contains(html, F.lit('role="doc-bibliography"'))
        | F.contains(lowered, F.lit("bibliography")),
        "has_author": F.contains(html, F.lit('itemprop="author"'))
        | F.contains(F.replace(html, F.lit(" "), F.lit("")), F.lit('"@type":"Person"')),
        "has_og_image": F.contains(html, F.lit("og:image")),
        "has_nosnippet": F.contains(html, F.lit("data-nosnippet")),
        "uses_google_fonts": F.contains(html, F.lit("fonts.googleapis.com")),
    }


def jsonld_columns(html: Column) -> dict[str, Column]:
    """Types found anywhere in the page's structured data, and blobs that do not parse."""
    roots = F.transform(H.jsonld_blobs(html), J.parse)
    return {
        "jsonld_types": F.array_distinct(F.flatten(F.transform(F.array_compact(roots), J.types_anywhere))),
        "n_jsonld_broken": F.size(F.filter(roots, lambda v: v.isNull())).cast("bigint"),
    }


#: Characters of a page in which the word "article" makes it one; the rule's own window.
ARTICLE_WINDOW = 1000


def is_article(path: Column, html: Column, window: int = ARTICLE_WINDOW) -> Column:
    """Article pages by address, or by the word "article" in the first ``window`` characters."""
    return F.contains(F.lower(path), F.lit("/artykul")) | F.contains(F.substring(F.lower(html), 1, window), F.lit("article"))


def freshness_columns(published: Column, modified: Column, as_of) -> dict[str, Column]:
    """Age in whole days of the modified (else published) time; bad dates give no age."""

    def when(value: Column) -> Column:
        return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(value))

    pub, mod = when(published), when(modified)
    shown = F.when(pub.isNotNull(), F.when(modified.isNull(), pub).otherwise(mod))
    age = F.timestamp_diff("DAY", shown, F.lit(as_of).cast("timestamp"))
    return {"age_days": age.cast("bigint"), "is_stale": F.coalesce(age > 365, F.lit(False))}


def content_columns(
    html: Column, body: Column, paras: Column, text: Column, lang: T.Readability
) -> dict[str, Column]:
    """Readability and density of the article text; NULL where the text is too short to judge."""
    long_enough = F.length(text) >= 200
    n_words = T.word_count(text)
    spoken = T.sentences(text, lang)
    per_sentence = F.transform(spoken, lambda s: F.size(T.space_tokens(s)))
    facts = H.count_of(text, T.NUMBER_WITH_UNIT) + H.count_of(text, T.YEAR) + H.count_of(text, T.PROPER_RUN)
    cited = H.citation_count(html, body, AUTHORITIES_CONTENT)
    h2 = H.headings(body, 2)
    asked = F.size(F.filter(h2, lambda h: F.contains(h, F.lit("?"))))
    intro = T.first_tokens(F.array_join(F.slice(paras, 1, 3), " "), 150)
    dense = long_enough & (n_words >= 100)
    return {
        "judged": long_enough,
        "n_words": n_words,
        "n_sentences": F.when(long_enough, F.size(spoken).cast("bigint")),
        "sum_sentence_words": F.when(
            long_enough, F.aggregate(per_sentence, F.lit(0), lambda a, x: a + x).cast("bigint")
        ),
        "n_long_sentences": F.when(long_enough, F.size(F.filter(per_sentence, lambda n: n > 35)).cast("bigint")),
        "fog": F.when(long_enough, T.fog(n_words, F.size(spoken), T.hard_word_count(text, lang))),
        "fact_density": F.when(dense, facts / n_words * 100),
        "citation_density": F.when(dense, cited / n_words * 1000),
        "h2_question_pct": F.when(long_enough, percent(asked, F.size(h2))),
        "has_tldr": long_enough
        & (H.count_of(intro, T.PLAIN_NUMBER) >= 2)
        & (H.count_of(intro, T.CAPITALISED) >= 1),
    }


def page_signals(
    pages: DataFrame, as_of="2025-06-01 00:00:00", lang: T.Readability = T.POLISH, keep: tuple[str, ...] = ()
) -> DataFrame:
    """All signals of ``pages(site, page_id, path, html)``, one row per page, without the HTML.

    ``as_of`` is the day freshness is measured from; ``keep`` names further columns to carry along.
    """
    html = F.col("html")
    staged = (
        pages.select(*KEYS, "path", "html", *keep)
        .withColumn("_images", H.images(html))
        .withColumn("_levels", H.heading_levels(html))
        .withColumn("_inputs", H.inputs(html))
        .withColumn("_labels", H.label_targets(html))
        .withColumn("_body", H.without_blocks(html, H.CONTENT_BOILERPLATE))
        .withColumn("_paras", H.paragraphs(F.col("_body")))
        .withColumn("_text", F.array_join("_paras", " "))
    )
    columns = {
        **performance_columns(html),
        **image_columns(F.col("_images")),
        **accessibility_columns(html, F.col("_levels"), F.col("_inputs"), F.col("_labels")),
        **mark_columns(html),
        **jsonld_columns(html),
        "is_article": is_article(F.col("path"), html),
        **content_columns(html, F.col("_body"), F.col("_paras"), F.col("_text"), lang),
    }
    published = H.meta_content(html, "article:published_time")
    modified = H.meta_content(html, "article:modified_time")
    dated = staged.withColumn("_published", published).withColumn("_modified", modified)
    columns |= freshness_columns(F.col("_published"), F.col("_modified"), as_of)
    return dated.select(*KEYS, "path", *keep, *[c.alias(name) for name, c in columns.items()])


def page_elements(pages: DataFrame) -> DataFrame:
    """Images, stylesheets and blocking scripts of each page, one row each: (site, page_id, kind, ref, ext)."""
    html = F.col("html")
    none = F.lit(None).cast("string")

    def as_elements(refs: Column, kind: str) -> Column:
        return F.transform(refs, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref"), none.alias("ext")))

    images = F.transform(
        F.filter(H.images(html), lambda i: F.coalesce(i["src"], F.lit("")) != ""),
        lambda i: F.struct(F.lit("img").alias("kind"), i["src"].alias("ref"), i["ext"].alias("ext")),
    )
    all_elements = F.concat(
        images, as_elements(H.stylesheet_refs(html), "css"), as_elements(H.blocking_script_refs(html), "js")
    )
    return each(pages, KEYS, all_elements, "e").select(*KEYS, "e.*")


def article_fields(pages: DataFrame) -> DataFrame:
    """Articles for the keyword analyses, from ``pages``: titles, headings, tags, own text and counts."""
    html, body, text = F.col("html"), F.col("_body"), F.col("body_text")
    staged = (
        pages.select(*KEYS, "path", "html")
        .withColumn("_body", H.without_blocks(html, H.KEYWORD_BOILERPLATE))
        .withColumn("body_text", F.array_join(H.paragraphs(body), " "))
    )
    return staged.select(
        "site",
        F.col("page_id").alias("doc"),
        "path",
        H.title(html).alias("title"),
        H.first_heading(body, 1).alias("h1"),
        H.headings(body, 2).alias("h2_list"),
        H.headings(body, 3).alias("h3_list"),
        F.regexp_extract(html, H.META_DESCRIPTION, 1).alias("meta_description"),
        H.find_all(html, H.ARTICLE_TAG, 1).alias("article_tags"),
        "body_text",
        T.word_count(text).alias("word_count"),
        T.first_tokens(text, 200).alias("first_200"),
        H.citation_count(html, html, AUTHORITIES_KEYWORDS).alias("citation_count"),
        (H.count_of(text, T.NUMBER_WITH_UNIT_KEYWORDS) + H.count_of(text, T.YEAR)).alias("fact_count"),
    )


def document_articles(documents: DataFrame) -> DataFrame:
    """Plain documents as articles without markup: ``source`` is the site, ``doc_id`` the path."""
    none = F.array().cast("array<string>")
    empty = F.lit("")
    return documents.select(
        F.col("source").alias("site"),
        F.col("doc_id").alias("doc"),
        empty.alias("title"),
        empty.alias("h1"),
        none.alias("h2_list"),
        empty.alias("meta_description"),
        none.alias("article_tags"),
        F.col("text").alias("body_text"),
        T.word_count(F.col("text")).alias("word_count"),
        F.lit(0).cast("bigint").alias("citation_count"),
        (H.count_of(F.col("text"), T.NUMBER_WITH_UNIT_KEYWORDS) + H.count_of(F.col("text"), T.YEAR)).alias(
            "fact_count"
        ),
    )
