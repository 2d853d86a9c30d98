"""JSON-LD as VARIANT columns.

Needs ``spark.sql.variant.allowDuplicateKeys=true`` (set by ``crawlgauge.session.configure``) so that the last
of two equal keys wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the format checks
URL = r"""(?U)^https?://[^\s<>"]+$"""
URL_OR_RELATIVE = r"""(?U)^(?:https?://[^\s<>"]+|/[^\s<>"]*|\.{0,2}/[^\s<>"]*)$"""
ISO_DATE = r"(?U)^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
ISO_DURATION = r"(?U)^P(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+S)?)?$"
LANG_CODE = r"^[a-z]{2,3}(-[A-Z]{2})?$"
EMPTY_JSON = ("null", '""', "[]", "{}")


def parse(blob: Column) -> Column:
    """Root value of a blob, NULL when it is not exactly one JSON value.

    The blob is parsed inside an array: text after the value makes the array invalid or longer than one.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.trim(blob), F.lit("]")))
    one = part(wrapped, "$[0]")
    return F.when(part(wrapped, "$[1]").isNull(), one)


def part(v: Column, path: str | Column, as_type: str = "variant") -> Column:
    return F.try_variant_get(v, path, as_type)


def field(v: Column, name: str, as_type: str = "variant") -> Column:
    return part(v, f'$["{name}"]', as_type)


def kind(v: Column) -> Column:
    """First word of the value's schema: OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID."""
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def is_kind(v: Column, *names: str) -> Column:
    return F.coalesce(kind(v).isin(*names), F.lit(False))


def text(v: Column) -> Column:
    """String value, NULL for any other kind."""
    return F.when(is_kind(v, "STRING"), F.try_variant_get(v, "$", "string"))


def elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def is_filled(v: Column) -> Column:
    """Present and not null, "", [] or {}; 0 and false count as filled."""
    return v.isNotNull() & ~F.coalesce(F.to_json(v), F.lit("null")).isin(*EMPTY_JSON)


def is_truthy(v: Column) -> Column:
    """Filled, and neither false nor zero."""
    zero = is_kind(v, "BIGINT", "DECIMAL", "DOUBLE") & (F.try_variant_get(v, "$", "double") == 0)
    false = is_kind(v, "BOOLEAN") & ~F.try_variant_get(v, "$", "boolean")
    return is_filled(v) & ~F.coalesce(zero, F.lit(False)) & ~F.coalesce(false, F.lit(False))


def types_anywhere(v: Column) -> Column:
    """Every @type at any depth: read from the canonical text, where quotes inside strings stay escaped."""
    listed = F.regexp_extract_all(F.to_json(v), F.lit(r'"@type":("(?:[^"\\]|\\.)*"|\[[^\[\]{}]*\])'), 1)
    each = F.flatten(
        F.transform(listed, lambda t: F.regexp_extract_all(t, F.lit(r'"((?:[^"\\]|\\.)*)"'), 1))
    )
    return F.array_distinct(each)


def typed_nodes(v: Column, max_depth: int = 25) -> Column:
    """Every @type of every object with the object's path: array<struct<path, schema_type>>.

    The walk goes through all members and list elements, level by level down to ``max_depth``, the root being level 0.
    Paths look like $."@graph"[0]."author"; keys stand in quotes as they are.
    """
    node = "struct<path:string,v:variant>"
    start = F.struct(
        F.array(F.struct(F.lit("$").alias("path"), v.alias("v"))).alias("nodes"),
        F.array().cast("array<struct<path:string,schema_type:string>>").alias("found"),
    )

    def types_of(n: Column) -> Column:
        types = F.when(is_kind(n["v"], "OBJECT"), F.array_compact(_own_types(n["v"])))
        pairs = F.transform(F.array_distinct(types), lambda t: F.struct(n["path"].alias("path"), t.alias("schema_type")))
        return F.coalesce(pairs, F.array().cast("array<struct<path:string,schema_type:string>>"))

    def below(n: Column) -> Column:
        listed = F.transform(
            elements(n["v"]), lambda x, i: F.struct(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("v"))
        )
        named = F.transform(
            F.map_entries(members(n["v"])), lambda e: F.struct(F.concat(n["path"], F.lit('."'), e["key"], F.lit('"')).alias("path"), e["value"].alias("v"))
        )
        return F.coalesce(listed, named, F.array().cast(f"array<{node}>"))

    def deeper(s: Column, _: Column) -> Column:
        found = F.flatten(F.transform(s["nodes"], types_of))
        return F.struct(F.flatten(F.transform(s["nodes"], below)).alias("nodes"), F.concat(s["found"], found).alias("found"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(max_depth)), start, deeper, lambda s: s["found"])


def declared_types(v: Column) -> Column:
    """Types declared at the top, in lists and inside @graph at any depth, not in other nested fields.

    Lists are opened level by level; a value has no more levels than opening brackets.
    """
    brackets = F.coalesce(F.regexp_count(F.to_json(v), F.lit(r"\[")), F.lit(0))
    start = F.struct(F.array(v).alias("nodes"), F.array().cast("array<string>").alias("types"))

    def deeper(s: Column, _: Column) -> Column:
        found = F.flatten(F.transform(s["nodes"], _own_types))
        return F.struct(F.flatten(F.transform(s["nodes"], _inner_nodes)).alias("nodes"), F.concat(s["types"], found).alias("types"))

    return F.aggregate(F.sequence(F.lit(0), brackets), start, deeper, lambda s: F.array_distinct(F.array_compact(s["types"])))


def _inner_nodes(n: Column) -> Column:
    return F.coalesce(elements(n), elements(field(n, "@graph")), F.array().cast("array<variant>"))


def _own_types(n: Column) -> Column:
    t = field(n, "@type")
    return F.transform(F.coalesce(elements(t), F.array(t)), text)


def objects(v: Column) -> Column:
    """Objects to validate: the root, or the members of its @graph list, or of a root list."""
    listed = F.coalesce(elements(v), elements(field(v, "@graph")), F.array(v))
    return F.filter(listed, lambda o: is_kind(o, "OBJECT"))


def object_type(o: Column) -> Column:
    """@type as a string, the first of a list, or ''."""
    t = field(o, "@type")
    return F.coalesce(text(field_at(o, "@type", 0)), text(t), F.lit(""))


def field_at(v: Column, name: str, i: int) -> Column:
    return part(v, f'$["{name}"][{i}]')


def matches(s: Column, pattern: str) -> Column:
    return F.coalesce(s.rlike(pattern), F.lit(False))


def format_error(v: Column, fmt: Column) -> Column:
    """Name of the broken rule for a truthy value, NULL when the value is fine."""
    s, items = text(v), elements(v)
    own_url = text(field(v, "url"))
    one_or_many = F.coalesce(items, F.array(v))

    def bad_text(pattern: str) -> Column:
        return s.isNotNull() & ~matches(s, pattern)

    def bad_url(u: Column, pattern: str) -> Column:
        return u.isNotNull() & (u != "") & ~matches(u, pattern)

    image_type = field(v, "@type")
    not_image = image_type.isNotNull() & ~is_kind(image_type, "VOID") & (
        F.coalesce(text(image_type), F.lit("")) != "ImageObject"
    )
    is_int = is_kind(v, "BIGINT", "BOOLEAN") | F.coalesce(
        F.schema_of_variant(v).rlike(r"^DECIMAL\((?:19|[23]\d),0\)$"), F.lit(False)
    )

    def first_bad(xs: Column, problem) -> Column:
        """Problem of the first element that has one."""
        return F.get(F.array_compact(F.transform(xs, problem)), 0)

    def crumb(x: Column) -> Column:
        keys = F.map_keys(members(x))
        out = F.when(~is_kind(x, "OBJECT"), "item_not_object")
        for name in ("@type", "position", "name", "item"):
            out = out.when(~F.array_contains(keys, name), f"item_missing_{name}")
        return out

    def question(x: Column) -> Column:
        answer = field(x, "acceptedAnswer")
        answered = is_kind(answer, "OBJECT") & is_truthy(field(answer, "text"))
        return (
            F.when(~is_kind(x, "OBJECT"), "item_not_object")
            .when(F.coalesce(text(field(x, "@type")), F.lit("")) != "Question", "item_not_question")
            .when(~F.coalesce(is_truthy(field(x, "name")), F.lit(False)), "question_without_name")
            .when(~F.coalesce(answered, F.lit(False)), "question_without_answer")
        )

    def step(x: Column) -> Column:
        typed = is_kind(x, "OBJECT") & (F.coalesce(text(field(x, "@type")), F.lit("")) == "HowToStep")
        told = is_truthy(field(x, "name")) | is_truthy(field(x, "text"))
        return F.when(~typed, "item_not_step").when(~F.coalesce(told, F.lit(False)), "step_without_text")

    return (
        F.when(fmt == "url", F.when(bad_url(F.coalesce(s, own_url), URL), "bad_url"))
        .when(
            fmt == "url_or_imageobject",
            F.when(bad_text(URL_OR_RELATIVE), "bad_url")
            .when(is_kind(v, "OBJECT") & not_image, "not_image_object")
            .when(is_kind(v, "OBJECT") & bad_url(own_url, URL_OR_RELATIVE), "bad_url"),
        )
        .when(
            fmt == "url_list",
            F.when(F.exists(one_or_many, lambda u: F.coalesce(text(u), F.lit("http://x")).rlike(URL) == F.lit(False)), "bad_url"),
        )
        .when(fmt == "iso_date", F.when(bad_text(ISO_DATE), "bad_date"))
        .when(fmt == "iso_duration", F.when(bad_text(ISO_DURATION), "bad_duration"))
        .when(fmt == "lang_code", F.when(bad_text(LANG_CODE), "bad_language"))
        .when(fmt == "int", F.when(~is_int, "not_integer"))
        .when(
            fmt == "breadcrumb_items",
            F.when(items.isNull() | (F.size(items) < 2), "fewer_than_two_items").otherwise(first_bad(items, crumb)),
        )
        .when(fmt == "faq_questions", first_bad(one_or_many, question))
        .when(
            fmt == "howto_steps",
            F.when(items.isNull() | (F.size(items) < 1), "not_a_list").otherwise(first_bad(items, step)),
        )
    )
