"""Licence scan with DataFrame functions only: Dice coefficient over word bigrams against licence templates.

Text is normalised (letters A-Z lowered, all but ASCII letters and digits to one space). Compared are a document's lines,
its paragraphs (parts between empty lines), the document as a whole, and the sentences of lines that hold several, each a
set of distinct word bigrams. Templates are short notices and, from ``licences``, whole texts. A template
of ``b`` bigrams can reach Dice ``t`` only with units of ``b*t/(2-t)`` to ``b*(2-t)/t`` bigrams, so most templates are
never compared. Before that, documents and then units go that hold none of the bigrams without which no template can reach
``t`` (see ``anchors_of``); that is exact, too. There is no shuffle.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgauge.functions.rows import each
from crawlgauge.llm.common import prepared, table

MIN_DICE = 0.8

# Licence notices and texts as their licensors publish them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
]

#: Whole texts with their disclaimers, without a copyright line: (licence, text) of each file in ``licences``.
WHOLE_TEXTS = [(p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))]

#: Words that stand in any text; they say little about a licence.
EVERYDAY = {"a", "an", "and", "any", "as", "at", "be", "by", "for", "from", "general", "if", "in", "international", "is", "it", "may", "of", "on", "or", "project", "public", "that", "the", "this", "to", "under", "with", "work", "you"}

#: End of a sentence inside a line.
SENTENCE_END = r"[.!?][\"')\]]*\s+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams_of(text: str) -> list[str]:
    words = [w for w in re.split("[^a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER))) if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def least_shared(n_template: int, min_dice: float = MIN_DICE) -> int:
    """Bigrams that any unit with Dice ``min_dice`` shares with a template of so many: as many as the smallest one has."""
    return math.ceil(n_template * min_dice / (2 - min_dice) - 1e-9)


def rarest_word(bigram: str) -> str:
    return max(bigram.split(), key=lambda w: (w not in EVERYDAY, len(w)))


def anchors_of(bigrams: list[str], min_dice: float = MIN_DICE) -> list[str]:
    """Bigrams of a template of which every close unit holds at least one: without them too few are left to share.

    Those with the longest words, everyday ones aside, as these are the rarest in other text; any others would be as exact.
    """
    rarest = sorted(bigrams, key=lambda g: (-len(rarest_word(g)) if rarest_word(g) not in EVERYDAY else 0, g))
    return rarest[: len(bigrams) - least_shared(len(bigrams), min_dice) + 1]


#: Normalised words of a text column, and an empty one where the text begins or ends with none. Two letters outside ASCII
#: have lower-case forms with an ASCII letter; they go first, the others don't matter.
WORDS = "split(lower(replace(replace({0}, '\u0130', ' '), '\u212a', ' ')), '[^a-z0-9]+', -1)"


def _holds(array: str, values: set[str]) -> Column:
    """Whether the array has one of ``values``, by one set made once; as SQL, since thousands of literals are slow to hand over."""
    return F.expr(f"exists({array}, x -> x IN ({', '.join(repr(v) for v in sorted(values))}))")


def _pairs(words: Column) -> Column:
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b))


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES + WHOLE_TEXTS, min_dice: float = MIN_DICE) -> DataFrame:
    """Every match: doc_id, kind (line, paragraph, document, sentence), place (from 0), license, dice; units under ``min_dice`` absent.

    Sentences are those of lines with more than one, numbered through the document; runs of several sentences inside a longer
    line are no unit, so a notice of several sentences is found only as a line, paragraph or document of its own.
    Ties between licences of one unit go to the name first in order. Null and empty texts match nothing; a unit of
    fewer than two words has no bigram and matches nothing. Repeated rows give repeated matches; other columns are not read.
    """
    sets = [(name, bigrams_of(text)) for name, text in templates]
    sets = [(name, grams) for name, grams in sets if grams]
    low = min(least_shared(len(g), min_dice) for _, g in sets)
    high = math.floor(max(len(g) for _, g in sets) * (2 - min_dice) / min_dice + 1e-9)
    anchors = {a for _, g in sets for a in anchors_of(g, min_dice)}
    strings = lambda values: F.split(F.lit("|".join(values)), "[|]")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a unit's bigrams are bigrams of the document, so a document without any anchor has no match; single words are cheaper to look up
    words = F.array(F.expr(WORDS.format("text")))
    likely = each(rows.where(_holds(WORDS.format("text"), set(map(rarest_word, anchors)))), ["doc_id", "text"], words, "words")
    rows = each(likely, ["doc_id", "text"], F.array(_pairs(F.col("words"))), "pairs").where(_holds("pairs", anchors))
    unit = lambda kind: lambda text, place: F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"), text.alias("unit"))
    lines, paragraphs = F.split("text", "\n", -1), F.split("text", "\n\n+", -1)
    sentences = F.flatten(F.transform(F.filter(lines, lambda x: F.rlike(x, F.lit(SENTENCE_END + r"\S"))), lambda x: F.split(x, SENTENCE_END, -1)))
    units = F.concat(
        F.transform(lines, unit("line")),
        F.when(F.size(paragraphs) > 1, F.transform(F.filter(paragraphs, lambda p: F.contains(p, F.lit("\n"))), unit("paragraph"))).otherwise(F.array().cast("array<struct<kind:string,place:int,unit:string>>")),
        F.transform(sentences, unit("sentence")),
        F.when(F.size(lines) > 1, F.array(F.struct(F.lit("document").alias("kind"), F.lit(0).alias("place"), F.col("text").alias("unit")))).otherwise(F.array().cast("array<struct<kind:string,place:int,unit:string>>")),
    )
    # each step's arrays are computed once: a filter on them stays above the explode that holds them
    key = ["doc_id", "kind", "place"]
    worded = each(each(rows, ["doc_id"], units, "u").select("doc_id", "u.kind", "u.place", "u.unit"), key, F.array(F.filter(F.expr(WORDS.format("unit")), lambda w: w != "")), "words")
    paired = each(worded.where(F.size("words") > low), key, F.array(_pairs(F.col("words"))), "pairs").where(_holds("pairs", anchors))
    grams = each(paired, key, F.array(F.array_distinct("pairs")), "grams").withColumn("n", F.size("grams")).where(F.col("n").between(low, high))
    close = []
    for name, template in sets:
        b = len(template)
        wanted = F.col("n").between(least_shared(b, min_dice), math.floor(b * (2 - min_dice) / min_dice + 1e-9))
        dice = 2.0 * F.size(F.array_intersect(strings(template), "grams")) / (F.col("n") + b)
        close.append(F.when(wanted, F.struct((-dice).alias("less"), F.lit(name).alias("license"))))
    best = each(grams, key, F.array(F.array_min(F.array(*close))), "best")
    return best.where(F.col("best.less") <= -min_dice).select("doc_id", "kind", "place", "best.license", (-F.col("best.less")).alias("dice"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """All licence notices found in all documents."""
    prepared(spark)
    return scan(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 9))


_ROWS = ",\n".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES + WHOLE_TEXTS))
_SPACE = r"\t\n\x0B\f\r "
_END = r"""[.!?]["'')\]]*[""" + _SPACE + "]+"
OP4_SQL = rf"""
WITH templates(id, license, body) AS (VALUES
{_ROWS}
),
docs AS (
    SELECT doc_id, text, row_number() OVER () AS n, string_split(text, chr(10)) AS l, regexp_split_to_array(text, '\n\n+') AS p FROM documents
),
sentences AS (
    SELECT doc_id, flatten(list_transform(list_filter(l, lambda x: regexp_matches(x, '{_END}[^{_SPACE}]')), lambda x: regexp_split_to_array(x, '{_END}'))) AS s FROM docs
),
units AS (
    SELECT doc_id, 'line' AS kind, (unnest(range(len(l))))::INTEGER AS place, unnest(l) AS unit FROM docs
    UNION ALL
    SELECT doc_id, 'paragraph', unnest(range(len(p)))::INTEGER, unnest(p)
    FROM (SELECT doc_id, list_filter(p, lambda x: contains(x, chr(10))) AS p FROM docs WHERE len(p) > 1)
    UNION ALL
    SELECT doc_id, 'sentence', unnest(range(len(s)))::INTEGER, unnest(s) FROM sentences
    UNION ALL
    SELECT doc_id, 'document', 0, text FROM docs WHERE contains(text, chr(10))
),
words AS (
    SELECT doc_id, kind, place, list_filter(regexp_split_to_array(translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM units
),
grams AS (
    SELECT doc_id, kind, place, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1
),
template_words AS (
    SELECT id, license, list_filter(regexp_split_to_array(translate(body, '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM templates
),
template_grams AS (
    SELECT id, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM template_words
),
scored AS (
    SELECT doc_id, kind, place, license, 2.0::DOUBLE * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice
    FROM grams JOIN template_grams ON len(g) BETWEEN len(t) * 0.6 AND len(t) * 1.6
),
best AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, kind, place ORDER BY dice DESC, license) AS r FROM scored WHERE dice >= 0.8
)
SELECT doc_id, kind, place, license, round(dice, 9) AS dice FROM best WHERE r = 1
"""
