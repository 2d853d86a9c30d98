"""The registered queries on a whole small data set against plain versions."""

from __future__ import annotations

import hashlib
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import helpers as plain  # noqa: E402

from crawlgauge.llm import catalog, packing, page_blocks  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def result(spark, name):
    return catalog.QUERIES[name](spark, SF).toPandas()


def test_op1(spark, documents):
    got = result(spark, "op1_line_labels").set_index("doc_id")
    for i, text, _ in documents:
        r = got.loc[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain.base_counts(text)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    sound = got[~got["base_failed"]].join(labels, how="inner")
    assert sound[sound["quality"] == 1]["kept"].mean() > 0.97 and sound[sound["quality"] == 0]["kept"].mean() < 0.1


def test_op2(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = result(spark, "op2_best_fit_packing")
    want = Counter()
    for i, text, _ in documents:
        ids = np.array([*tokens.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.update((i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024)))
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    used = got.sort_values("offset").groupby("sequence_id")["length"].sum()
    assert used.max() <= 1024 and len(used) <= -(-got["length"].sum() // 1024) + 2


def test_op3(spark, documents):
    got = result(spark, "op3_near_copies").set_index("doc_id")
    assert got["component_id"].to_dict() == plain.near_components([(i, t) for i, t, _ in documents])
    assert all(got.loc[i, "n_shingles"] == len(plain.shingles(t)) for i, t, _ in documents)


def test_op6(spark, documents):
    got = result(spark, "op6_repeated_spans").set_index("doc_id")
    for i, raw, gone in plain.repeated_bytes([(i, t) for i, t, _ in documents]):
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        assert tuple(got.loc[i, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]]) == (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_op7(spark, documents):
    got = result(spark, "op7_mixing")
    sizes = Counter()
    for _, text, source in documents:
        sizes[source] += len(plain.words(text))
    want = plain.mix_targets(dict(sizes))
    assert sorted(got["doc_id"]) == [i for i, _, _ in documents] and (got["taken"] <= 2 * got["size"]).all()
    source_of = {i: s for i, _, s in documents}
    for source, rows in got.groupby(got["doc_id"].map(source_of)):
        assert abs(rows["taken"].sum() - want[source]) <= 1 and (rows["source_size"] == sizes[source]).all()
        assert rows["target"].tolist() == pytest.approx([want[source]] * len(rows))


def test_op8(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = result(spark, "op8_dimension_scan")
    hits, asked = 0, np.flatnonzero(ids % 20 == 0)
    for q in asked:
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        own = got[got["query_id"] == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert own["score"].tolist() == pytest.approx(score[np.searchsorted(ids, own["vec_id"])].tolist(), abs=1e-12)
        hits += len(set(own["vec_id"]) & set(ids[np.lexsort((ids, -score))[:20]]))
    assert hits >= 0.9 * 20 * len(asked)


def test_op9(spark):
    got = result(spark, "op9_quality_grades").merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert got[(got["quality"] == 1) & (got["toxic"] == 0)]["kept"].mean() > 0.95 and got[got["quality"] == 0]["kept"].mean() < 0.1
    assert ((got["expected_grade"] >= 0) & (got["expected_grade"] <= 2)).all()


def test_op10(spark):
    got = result(spark, "op10_page_blocks").set_index("page_id")
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        blocks = page_blocks.blocks_of(r["html"])
        text = "\n".join(b.text for b, y in zip(blocks, page_blocks.rule_labels(blocks), strict=True) if y)
        assert got.loc[r["page_id"], "text"] == text and got.loc[r["page_id"], "n_chars"] == len(text)
