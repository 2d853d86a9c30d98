"""Performance, accessibility and content quality per site, from page signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import colour as C
from ..functions import html as H
from ..functions.rows import each
from ..functions.scoring import band, clamp, mean_of_present, percent, whole
from ..sources.tables import first_css_files, with_asset_bytes
from .findings import check, ok_or, one_row_per_check
from .skew import top_per_group


def _pages_with(flag: str, name: str) -> Column:
    return F.count_if(F.col(flag)).alias(name)


def _total(column: str) -> Column:
    return F.sum(column).cast("bigint").alias(column)


# --- performance -----------------------------------------------------------------------------------------------


def asset_bytes_by_kind(elements: DataFrame, assets: DataFrame) -> DataFrame:
    """Bytes of the images, stylesheets and blocking scripts used per site.

    References are counted per distinct (site, ref) before the join, so a logo used on every page is one row.
    """
    refs = elements.groupBy("site", "kind", "ref").agg(F.count("*").alias("uses"))
    sized = with_asset_bytes(refs, assets)

    def total(kind: str) -> Column:
        return F.coalesce(
            F.sum(F.when(F.col("kind") == kind, F.col("bytes") * F.col("uses"))), F.lit(0)
        ).cast("bigint").alias(f"{kind}_bytes")

    return sized.groupBy("site").agg(total("img"), total("css"), total("js"))


def image_formats(elements: DataFrame) -> DataFrame:
    """Histogram of image formats per site."""
    images = elements.where(F.col("kind") == "img")
    return images.groupBy("site", "ext").agg(F.count("*").alias("n_images"))


def largest_images(elements: DataFrame, assets: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` heaviest image uses per site, with a warning flag above 200 000 bytes.

    At most ``n`` uses of one image can be among them, so uses are limited per image before sizes are joined.
    """
    images = elements.where(F.col("kind") == "img")
    uses = top_per_group(images, ["site", "ref"], ["page_id"], n, "_use")
    sized = with_asset_bytes(uses, assets).where(F.col("bytes") > 0)
    top = top_per_group(sized, ["site"], [F.desc("bytes"), "ref", "page_id", "_use"], n)
    return top.select("site", "rank", "ref", "page_id", "bytes", (F.col("bytes") > 200_000).alias("too_large"))


def performance(signals: DataFrame, elements: DataFrame | None = None, assets: DataFrame | None = None) -> DataFrame:
    """One row per site with totals, shares and the performance score."""
    sums = signals.groupBy("site").agg(
        F.count("*").alias("pages"),
        _total("html_bytes"),
        _total("n_img_src"),
        _total("n_img_src_modern"),
        _total("n_img_src_lazy"),
        _total("n_img_src_alt"),
        _pages_with("has_picture", "picture_pages"),
        _total("n_stylesheets"),
        _total("n_blocking_scripts"),
        _pages_with("has_font_preload", "font_preload_pages"),
    )
    images = F.col("n_img_src")
    weight = F.col("html_bytes") / F.col("pages")
    stats = sums.select(
        "*",
        weight.alias("avg_html_bytes"),
        percent(F.col("n_img_src_modern"), images).alias("modern_pct"),
        percent(F.col("n_img_src_lazy"), images).alias("lazy_pct"),
        percent(F.col("n_img_src_alt"), images).alias("alt_pct"),
    )
    weight_part = F.when(F.col("avg_html_bytes") < 100_000, 100).when(F.col("avg_html_bytes") < 200_000, 60).otherwise(20)
    preload_part = F.when(F.col("font_preload_pages") > 0, 100)
    score = mean_of_present(F.col("modern_pct"), F.col("lazy_pct"), F.col("alt_pct"), weight_part, preload_part)
    stats = stats.withColumn("score", whole(score))
    if elements is None or assets is None:
        return stats
    sizes = asset_bytes_by_kind(elements, assets)
    return stats.join(sizes, "site", "left").fillna(0, ["img_bytes", "css_bytes", "js_bytes"])


def performance_findings(stats: DataFrame) -> DataFrame:
    """Findings of a ``performance`` table; byte checks need the asset columns."""
    weight, has_images = F.col("avg_html_bytes"), F.col("n_img_src") > 0
    checks = [
        check("html_weight", 1, F.when(weight > 200_000, "fail").when(weight > 100_000, "warn").otherwise("ok"), weight),
        check("modern_images", 2, F.when(has_images, band(F.col("modern_pct"), (80, "ok"), (50, "warn"), default="fail")), F.col("modern_pct")),
        check("lazy_images", 3, F.when(has_images, band(F.col("lazy_pct"), (80, "ok"), (30, "warn"), default="fail")), F.col("lazy_pct")),
        check("image_alt", 4, F.when(has_images, ok_or(F.col("alt_pct") >= 95)), F.col("alt_pct")),
        check("picture", 5, F.when(F.col("picture_pages") > 0, "ok"), F.col("picture_pages")),
        check("font_preload", 9, ok_or(F.col("font_preload_pages") > 0), F.col("font_preload_pages")),
    ]
    if "css_bytes" in stats.columns:
        checks += [
            check("css_weight", 6, F.when(F.col("css_bytes") > 150_000, "warn"), F.col("css_bytes")),
            check(
                "blocking_scripts",
                7,
                F.when((F.col("js_bytes") > 0) & (F.col("n_blocking_scripts") > 0), "warn"),
                F.col("n_blocking_scripts"),
            ),
        ]
    return one_row_per_check(stats, "performance", checks)


# --- accessibility ---------------------------------------------------------------------------------------------


def accessibility(signals: DataFrame) -> DataFrame:
    """One row per site with coverage counts and the accessibility score."""
    sums = signals.groupBy("site").agg(
        F.count("*").alias("pages"),
        _pages_with("has_lang", "lang_pages"),
        _pages_with("has_skip_link", "skip_link_pages"),
        _total("n_img"),
        _total("n_img_alt"),
        _total("n_img_described"),
        _total("n_img_decorative"),
        F.count_if(F.col("n_h1") > 1).alias("multi_h1_pages"),
        _pages_with("skips_level", "level_skip_pages"),
        F.count_if(F.col("n_landmarks") >= 3).alias("landmark_pages"),
        _total("n_inputs"),
        _total("n_inputs_unlabelled"),
    )
    pages = F.col("pages")
    skip = F.when(F.col("skip_link_pages") > 0, F.col("skip_link_pages") / pages * 100).otherwise(50.0)
    score = mean_of_present(
        F.col("lang_pages") / pages * 100,
        skip,
        percent(F.col("n_img_alt"), F.col("n_img")),
        (pages - F.col("level_skip_pages")) / pages * 100,
        F.col("landmark_pages") / pages * 100,
        percent(F.col("n_inputs") - F.col("n_inputs_unlabelled"), F.col("n_inputs")),
    )
    return sums.withColumn("score", whole(score))


def accessibility_findings(stats: DataFrame) -> DataFrame:
    pages = F.col("pages")
    return one_row_per_check(
        stats,
        "accessibility",
        [
            check("html_lang", 1, ok_or(F.col("lang_pages") == pages), pages - F.col("lang_pages")),
            check("skip_link", 2, ok_or(F.col("skip_link_pages") > 0, "warn"), F.col("skip_link_pages")),
            check("alt_coverage", 3, F.when(F.col("n_img") > 0, "info"), percent(F.col("n_img_alt"), F.col("n_img"))),
            check("single_h1", 4, ok_or(F.col("multi_h1_pages") == 0, "warn"), F.col("multi_h1_pages")),
            check("heading_order", 5, ok_or(F.col("level_skip_pages") == 0), F.col("level_skip_pages")),
            check("landmarks", 6, ok_or(F.col("landmark_pages") == pages, "warn"), F.col("landmark_pages")),
            check(
                "input_labels",
                7,
                F.when(F.col("n_inputs") > 0, ok_or(F.col("n_inputs_unlabelled") == 0)),
                F.col("n_inputs_unlabelled"),
            ),
        ],
    )


def heading_steps(pages: DataFrame) -> DataFrame:
    """Heading levels in page order with the level before each: (site, page_id, pos, level, prev_level)."""
    levels = H.heading_levels(F.col("html"))
    before = F.concat(F.array(F.lit(None).cast("int")), levels)
    pairs = F.arrays_zip(levels.alias("level"), F.slice(before, 1, F.size(levels)).alias("prev_level"))
    return each(pages, ["site", "page_id"], pairs, "s", "pos").select(
        "site", "page_id", "pos", F.col("s.level").alias("level"), F.col("s.prev_level").alias("prev_level")
    )


def worst_contrast(css_files: DataFrame, n_files: int | None = None) -> DataFrame:
    """The text / background colour pair of each site with the lowest contrast, over all its stylesheets.

    ``n_files`` reads only the first ones by path.

    Contrast falls with the distance of luminance, so the worst partner of a text colour is its nearest background
    neighbour in luminance order, above or below: no colour pairs are formed. Equal colours (ignoring case) are not
    a pair; colours of equal luminance are compared through their smallest names.
    """
    css = css_files if n_files is None else first_css_files(css_files, n_files)

    def role(names, is_text: bool) -> Column:
        return F.transform(
            H.css_colours(F.col("content"), names),
            lambda c: F.struct(c.alias("colour"), F.lit(is_text).alias("is_text")),
        )

    both = F.concat(role(("text", "ink", "fg"), True), role(("bg", "background", "surface"), False))
    lowered = F.lower("colour")
    colours = (
        each(css, ["site"], both, "c")
        .select("site", "c.*")
        .groupBy("site", lowered.alias("hex"))
        .agg(
            F.min(F.when(F.col("is_text"), F.col("colour"))).alias("text"),
            F.min(F.when(~F.col("is_text"), F.col("colour"))).alias("background"),
        )
        .withColumn("lum", C.luminance(F.col("hex")))
        .where(F.col("lum").isNotNull())
    )
    order = Window.partitionBy("site").orderBy("lum", "hex")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    above = order.rowsBetween(1, Window.unboundedFollowing)
    neighbour = F.when(F.col("background").isNotNull(), F.struct("lum", "background"))
    pairs = (
        colours.withColumn("_below", F.last(neighbour, ignorenulls=True).over(below))
        .withColumn("_above", F.first(neighbour, ignorenulls=True).over(above))
        .where(F.col("text").isNotNull())
        .select("site", "lum", "text", F.explode(F.array_compact(F.array("_below", "_above"))).alias("b"))
        .select(
            "site",
            F.col("text").alias("text_colour"),
            F.col("b.background").alias("background_colour"),
            C.ratio_of_luminance(F.col("lum"), F.col("b.lum")).alias("ratio"),
        )
    )
    best = F.struct("text_colour", "background_colour", "ratio")
    return (
        pairs.groupBy("site")
        .agg(F.min_by(best, F.struct("ratio", "text_colour", "background_colour")).alias("w"))
        .select("site", "w.*")
        .withColumn("band", C.contrast_band(F.col("ratio")))
    )


def contrast_findings(contrast: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("band").isin("AAA", "AA"), "ok").when(F.col("band") == "large_text_only", "warn").otherwise("fail")
    )
    pair = F.concat_ws("/", "text_colour", "background_colour")
    return one_row_per_check(contrast, "accessibility", [check("contrast", 8, status, F.col("ratio"), pair)])


# --- content ---------------------------------------------------------------------------------------------------


def content_quality(signals: DataFrame, max_pages: int | None = None) -> DataFrame:
    """One row per site over its article pages, or over all pages when it has none.

    Both candidates are aggregated side by side, per (site, is_article), and the article row wins if there is one:
    no second pass and no join. ``max_pages`` keeps the first ones by path (the interactive rule uses 30).
    """
    pages = signals
    if max_pages is not None:
        pages = top_per_group(pages, ["site", "is_article"], ["path", "page_id"], max_pages)
    judged = F.col("judged")
    sums = pages.groupBy("site", "is_article").agg(
        F.count("*").alias("pages"),
        F.avg("fog").alias("fog"),
        F.sum("sum_sentence_words").alias("sentence_words"),
        F.sum("n_sentences").alias("sentences"),
        F.sum("n_long_sentences").alias("long_sentences"),
        F.avg("fact_density").alias("fact_density"),
        F.avg("citation_density").alias("citation_density"),
        F.avg("h2_question_pct").alias("h2_question_pct"),
        F.count_if(F.col("has_tldr")).alias("tldr_pages"),
        F.count_if(judged & F.col("is_stale")).alias("stale_pages"),
    )
    chosen = sums.groupBy("site").agg(
        F.max_by(F.struct(*[c for c in sums.columns if c not in ("site", "is_article")]), "is_article").alias("s")
    ).select("site", "s.*")
    score = mean_of_present(
        clamp(100 - (F.col("fog") - 9) * 6),
        F.when(F.col("fact_density").isNotNull(), F.least(F.lit(100.0), F.col("fact_density") * 10)),
        F.when(F.col("citation_density").isNotNull(), F.least(F.lit(100.0), F.col("citation_density") * 15)),
        F.when(F.col("h2_question_pct").isNotNull(), F.least(F.lit(100.0), F.col("h2_question_pct") * 2)),
        F.col("tldr_pages") / F.col("pages") * 100,
    )
    return chosen.select(
        "site",
        "pages",
        "fog",
        (F.col("sentence_words") / F.nullif("sentences", F.lit(0))).alias("avg_sentence_words"),
        percent(F.col("long_sentences"), F.col("sentences")).alias("long_sentence_pct"),
        "fact_density",
        "citation_density",
        "h2_question_pct",
        "tldr_pages",
        "stale_pages",
        whole(score).alias("score"),
    )


def content_findings(stats: DataFrame) -> DataFrame:
    def known(c: str, status: Column) -> Column:
        return F.when(F.col(c).isNotNull(), status)

    fog = F.col("fog")
    return one_row_per_check(
        stats,
        "content",
        [
            check("readability", 1, known("fog", F.when(fog < 13, "ok").when(fog < 17, "warn").otherwise("fail")), fog),
            check(
                "sentence_length",
                2,
                known("avg_sentence_words", F.when(F.col("avg_sentence_words") > 25, "warn").otherwise("info")),
                F.col("avg_sentence_words"),
            ),
            check("fact_density", 3, known("fact_density", band(F.col("fact_density"), (8, "ok"), (4, "warn"), default="fail")), F.col("fact_density")),
            check("citation_density", 4, known("citation_density", band(F.col("citation_density"), (5, "ok"), (2, "warn"), default="fail")), F.col("citation_density")),
            check("question_headings", 5, known("h2_question_pct", ok_or(F.col("h2_question_pct") >= 30, "warn")), F.col("h2_question_pct")),
            check("tldr", 6, F.lit("info"), F.col("tldr_pages")),
            check("stale", 7, F.when(F.col("stale_pages") > 0, "info"), F.col("stale_pages")),
        ],
    )


# --- all three -------------------------------------------------------------------------------------------------


def module_scores(performance_stats: DataFrame, accessibility_stats: DataFrame, content_stats: DataFrame) -> DataFrame:
    """Scores of the three modules side by side and their mean, cut; a missing module counts as 0."""
    joined = (
        performance_stats.select("site", F.col("score").alias("performance"))
        .join(accessibility_stats.select("site", F.col("score").alias("accessibility")), "site", "full")
        .join(content_stats.select("site", F.col("score").alias("content")), "site", "full")
        .fillna(0)
    )
    mean = (F.col("performance") + F.col("accessibility") + F.col("content")) / 3
    return joined.withColumn("avg_score", whole(mean))
