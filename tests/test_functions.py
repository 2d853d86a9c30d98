"""Column functions against values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crawlgauge.functions import colour as C
from crawlgauge.functions import html as H
from crawlgauge.functions import jsonld as J
from crawlgauge.functions import scoring as S
from crawlgauge.functions import sql as SQL
from crawlgauge.functions import text as T


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{n} string" for n in inputs) or "x string")
    return row.select(column.alias("v")).first()["v"]


def on(spark, fn, text):
    return value(spark, fn(F.col("x")), x=text)


@pytest.mark.parametrize(
    "a, b, ratio", [("#000000", "#ffffff", 21.0), ("#777777", "#ffffff", 4.478089), ("#000", "#888", 5.924027)]
)
def test_contrast(spark, a, b, ratio):
    assert value(spark, C.contrast_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(ratio, abs=1e-5)


@pytest.mark.parametrize(
    "word, n", [("administracja", 5), ("kota", 2), ("źle", 2), ("rzeczywistość", 4), ("brzmi", 1), ("hmm", 1)]
)
def test_syllables(spark, word, n):
    assert on(spark, T.syllables, word) == n


def test_fog(spark):
    text = "Ala ma kota. To jest administracja publiczna."
    assert on(spark, T.word_count, text) == 7
    assert on(spark, lambda c: F.size(T.sentences(c)), text) == 2
    assert on(spark, T.hard_word_count, text) == 1
    fog = T.fog(T.word_count(F.col("x")), F.size(T.sentences(F.col("x"))), T.hard_word_count(F.col("x")))
    assert value(spark, fog, x=text) == pytest.approx(5.928571, abs=1e-6)


def test_abbreviations_do_not_end_sentences(spark):
    assert on(spark, T.sentences, "To np. Warszawa. Prof. Nowak wie... Tak! Nie") == [
        "To np. Warszawa.", "Prof. Nowak wie… Tak!", "Nie",
    ]


def test_facts(spark):
    text = "W 2024 roku 35% ludzi; 3,5 kg. Jan Kowalski i Anna Nowak Maj."
    assert on(spark, lambda c: H.count_of(c, T.NUMBER_WITH_UNIT), text) == 3
    assert on(spark, lambda c: H.count_of(c, T.YEAR), text) == 1
    assert on(spark, lambda c: H.count_of(c, T.PROPER_RUN), text) == 2


def test_unicode_words(spark):
    assert on(spark, T.words, "zażółć gęślą-jaźń 3_x") == ["zażółć", "gęślą", "jaźń", "3_x"]


def test_tokens_and_ngrams(spark):
    assert on(spark, lambda c: T.tokens(c, ["the"]), "The Quick 123 ox brown the FOX") == ["quick", "brown", "fox"]
    assert on(spark, lambda c: T.ngrams(c, 2), "a b c") == ["a b", "b c"]
    assert on(spark, lambda c: T.ngrams(c, 3), "a b") == []
    assert on(spark, lambda c: T.ngrams_upto3(F.split(c, " "), c), "a b c a") == [
        "a", "b", "c", "a", "a b", "b c", "c a", "a b c", "b c a",
    ]


def test_question_headings_may_span(spark):
    assert on(spark, lambda c: H.count_of(c, H.QUESTION_HEADING), "<h2>A</h2><h2>B?</h2><h3>C?</h3><H2>D?</H2>") == 2


@pytest.mark.parametrize(
    "html, n",
    [
        ('<script src="a">', 1),
        ('<script type="module" src="a">', 0),
        ('<script async src="a">', 0),
        ('<script src="a" defer>', 0),
        ("<script>x</script>", 0),
    ],
)
def test_blocking_scripts(spark, html, n):
    assert on(spark, lambda c: H.count_of(c, H.BLOCKING_SCRIPT), html) == n


def test_attributes_last_wins_and_needs_double_quotes(spark):
    tag = """ SRC="a.png" data-src="b" src="c.webp" alt='x' loading="lazy" """
    assert on(spark, lambda c: H.attribute(c, "src"), tag) == "c.webp"
    assert on(spark, lambda c: H.attribute(c, "alt"), tag) is None
    assert on(spark, H.attribute_map, tag) == {"src": "c.webp", "data-src": "b", "loading": "lazy"}


def test_meta_any_attribute_order_and_empty_content_is_skipped(spark):
    html = '<meta name="K" content=""><meta content="v" property="k"/><meta name="k" content="w">'
    assert on(spark, lambda c: H.meta_content(c, "k"), html) == "v"
    assert on(spark, lambda c: H.meta_content(c, "none"), html) is None


def test_boilerplate_is_removed_whole(spark):
    html = "<head><title>t</title></head><body><nav>n\n</nav><p>a<p-x>b</p><aside>s</aside></body>"
    body = H.without_blocks(F.col("x"), H.KEYWORD_BOILERPLATE)
    assert value(spark, H.visible_text(body), x=html) == "a b"
    assert value(spark, H.paragraphs(body), x=html) == ["a b"]


def test_heading_levels(spark):
    html = "<h1>a</h1><H3 class=x>b</H3><h2>c</h3></h2>"
    assert on(spark, H.heading_levels, html) == [1, 3, 2]
    assert on(spark, lambda c: H.skips_heading_level(H.heading_levels(c)), html) is True
    assert on(spark, lambda c: H.skips_heading_level(H.heading_levels(c)), "<h1>a</h1>") is False
    assert on(spark, lambda c: H.skips_heading_level(H.heading_levels(c)), "none") is False


def test_inputs(spark):
    html = '<input id="a"><input type="HIDDEN"><input type="submit"><input aria-label="x"><label for="a">'
    found = on(spark, H.inputs, html)
    assert [(i["id"], i["aria"]) for i in found] == [("a", False), ("", True)]
    assert on(spark, H.label_targets, html) == ["a"]


def test_image_format_is_cut_at_query(spark):
    assert on(spark, H.image_format, "/x/A.B.WEBP?v=1") == "webp"
    assert on(spark, H.image_format, "noext") == "noext"


def test_insert_before_first_head_end_only(spark):
    assert on(spark, lambda c: H.insert_before_head_end(c, F.lit("$1\\")), "a</HEAD>b</head>") == "a$1\\</HEAD>b</head>"
    assert on(spark, lambda c: H.insert_before_head_end(c, F.lit("x")), "none") == "none"


def test_mean_skips_missing_parts(spark):
    parts = [F.lit(75), F.lit(None).cast("int"), F.lit(50), F.lit(100), F.lit(100)]
    assert value(spark, S.whole(S.mean_of_present(*parts)), x="") == 81
    assert value(spark, S.whole(S.mean_of_present(F.lit(None).cast("double"))), x="") == 0
    assert value(spark, S.clamp(F.lit(None).cast("double")), x="") is None


@pytest.mark.parametrize("errors, warnings, score", [(10, 104, 0), (0, 9, 91), (3, 0, 85)])
def test_validator_score(spark, errors, warnings, score):
    assert value(spark, S.schema_score(F.lit(errors), F.lit(warnings)), x="") == score


@pytest.mark.parametrize(
    "blob, ok",
    [('{"a":1}', True), (' {"a":1}\n', True), ('{"a":1}x', False), ("{a", False), ("", False), ('{"a":1},null', False), ("[1,2]", True), ('{"a":1,"a":2}', True)],
)
def test_blob_must_be_one_json_value(spark, blob, ok):
    assert (on(spark, lambda c: F.to_json(J.parse(c)), blob) is not None) is ok


def test_last_of_equal_keys_wins(spark):
    assert on(spark, lambda c: F.to_json(J.parse(c)), '{"a":1,"a":2}') == '{"a":2}'


def test_types_at_any_depth_but_not_inside_strings(spark):
    blob = r'{"@type":["A","B"],"x":[{"y":{"@type":"C"}}],"s":"{\"@type\":\"D\"}","e":"\"@type\":\"E\""}'
    assert sorted(on(spark, lambda c: J.types_anywhere(J.parse(c)), blob)) == ["A", "B", "C"]


def test_declared_types_are_top_level_list_and_graph(spark):
    blob = '[{"@type":"A","x":{"@type":"No"}},{"@graph":[{"@type":["B","C"]},{"@graph":[{"@type":"D"}]}]}]'
    assert sorted(on(spark, lambda c: J.declared_types(J.parse(c)), blob)) == ["A", "B", "C", "D"]


@pytest.mark.parametrize(
    "blob, types",
    [
        ('{"@type":"A"}', ["A"]),
        ('{"@type":"Box","@graph":[{"@type":["B","X"]},3,{"name":"n"}]}', ["B", ""]),
        ('{"@type":"A","@graph":{"@type":"B"}}', ["A"]),
        ('[{"@type":"A"},"x",{"@type":[]}]', ["A", ""]),
        ("3", []),
    ],
)
def test_objects_and_types(spark, blob, types):
    got = on(spark, lambda c: F.transform(J.objects(J.parse(c)), J.object_type), blob)
    assert got == types


FORMATS = [
    ("int", "3", None), ("int", "3.0", "not_integer"), ("int", '"3"', "not_integer"), ("int", "true", None),
    ("int", "123456789012345678901", None),
    ("iso_date", '"2024-01-01"', None), ("iso_date", '"2024-01-01T10:00Z"', None), ("iso_date", '"01/01/2024"', "bad_date"),
    ("iso_duration", '"PT10M"', None), ("iso_duration", '"10 min"', "bad_duration"),
    ("lang_code", '"pl-PL"', None), ("lang_code", '"PL"', "bad_language"),
    ("url", '"https://a.b/c"', None), ("url", '"/c"', "bad_url"), ("url", '{"url":"x"}', "bad_url"), ("url", "5", None),
    ("url_or_imageobject", '"/c.png"', None), ("url_or_imageobject", '"c png"', "bad_url"),
    ("url_or_imageobject", '{"@type":"Thing"}', "not_image_object"), ("url_or_imageobject", '{"url":"/x"}', None),
    ("url_list", '["https://a.b","x"]', "bad_url"), ("url_list", '"https://a.b"', None), ("url_list", "[5]", None),
    ("breadcrumb_items", '[{"@type":"L"}]', "fewer_than_two_items"),
    ("breadcrumb_items", '[{"@type":"L","position":1,"name":"n","item":"i"},{"@type":"L","position":2,"name":"n"}]', "item_missing_item"),
    ("breadcrumb_items", '[{"@type":"L","position":1,"name":"n","item":"i"},7]', "item_not_object"),
    ("faq_questions", '{"@type":"Question","name":"q","acceptedAnswer":{"text":"a"}}', None),
    ("faq_questions", '[{"@type":"Question","name":"q","acceptedAnswer":{"text":""}}]', "question_without_answer"),
    ("faq_questions", '[{"@type":"Question","name":""}]', "question_without_name"),
    ("faq_questions", '["q"]', "item_not_object"),
    ("howto_steps", '{"@type":"HowToStep"}', "not_a_list"), ("howto_steps", '[{"@type":"HowToStep"}]', "step_without_text"),
    ("howto_steps", '[{"@type":"HowToStep","text":"t"}]', None), ("howto_steps", '[{"@type":"X"}]', "item_not_step"),
    ("non_empty_list_or_str", '["x"]', None),
]


def test_formats(spark):
    rows = spark.createDataFrame(FORMATS, "fmt string, json string, expected string")
    got = rows.withColumn("got", J.format_error(F.try_parse_json("json"), F.col("fmt")))
    assert [r.asDict() for r in got.where(~F.col("got").eqNullSafe(F.col("expected"))).collect()] == []


def test_filled_and_truthy(spark):
    rows = [("null", False, False), ('""', False, False), ("[]", False, False), ("{}", False, False), ("0", True, False),
            ("0.0", True, False), ("false", True, False), ('"0"', True, True), ("[0]", True, True)]
    df = spark.createDataFrame(rows, "json string, filled boolean, truthy boolean").withColumn("v", F.try_parse_json("json"))
    got = df.select("json", "filled", "truthy", J.is_filled(F.col("v")).alias("f"), J.is_truthy(F.col("v")).alias("t"))
    assert [r for r in got.collect() if (r["f"], r["t"]) != (r["filled"], r["truthy"])] == []


def test_sql_functions(spark):
    SQL.register(spark)
    row = spark.sql(
        "SELECT strip_tags('<b>a</b>  c') s, syllables('kota') n, contrast_ratio('777777', 'ffffff') r, "
        "jaccard(array('a', 'b'), array('b', 'c')) j, jaccard(array(), array()) z"
    ).first()
    assert (row.s, row.n, round(row.r, 6), round(row.j, 6), row.z) == ("a c", 2, 4.478089, 0.333333, 0.0)
