"""The Merkle manifest against a plain tree, built level by level."""

from __future__ import annotations

import hashlib
import os
import random
import sys
import zlib
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import helpers as plain  # noqa: E402

from crawlgauge.llm import merkle_manifest as merkle  # noqa: E402

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(digests):
    """Root and, for each leaf, the (left, right) texts of its runs."""
    at, paths, level = list(range(len(digests))), [[] for _ in digests], list(digests)
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for i, p in enumerate(at):
            run, k = runs[p // 16], p % 16
            paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            at[i] = p // 16
        level = [sha("".join(r)) for r in runs]
    return (level[0] if level else None), paths


def plain_leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def plain_manifest(rows):
    by = {}
    for r in rows:
        text, id_ = r["text"], r["doc_id"]
        other = text.translate(plain.LOWER) if id_ is not None and text is not None and zlib.crc32(str(id_).encode()) % 5 == 0 else text
        by.setdefault(r["source"], []).append(((id_ is not None, id_ or 0), plain_leaf(r, text), plain_leaf(r, other), id_))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([x[1] for x in sorted(by[s])]) for s in order}
    root, tops = tree([built[s][0] for s in order])
    out = Counter()
    for s, top in zip(order, tops, strict=True):
        for (_, leaf, presented, id_), path in zip(sorted(by[s]), built[s][1], strict=True):
            fold = presented
            for a, b in path + top:
                fold = sha(a + fold + b)
            out[id_, leaf, built[s][0], root, sha("".join(a + b for a, b in path + top)), fold, fold == root] += 1
    return out


def test_open_subtrees_grow_into_the_plain_tree():
    for n in [*range(1, 35), 255, 256, 257, 4095, 4096, 4097, 5000]:
        digests = [sha(str(i)) for i in range(n)]
        grown = merkle.OpenSubtrees()
        for d in digests:
            grown.append(d)
        want, paths = tree(digests)
        assert grown.finish() == want and grown.witnesses == paths


def test_blocks_of_fixed_height_are_subtrees():
    digests = [sha(str(i)) for i in range(4096 * 2 + 5)]
    roots = []
    for i in range(0, len(digests), 4096):
        grown = merkle.OpenSubtrees(witnesses=False)
        for d in digests[i : i + 4096]:
            grown.append(d)
        roots.append(grown.finish(3))
    above = merkle.OpenSubtrees()
    for d in roots:
        above.append(d)
    assert above.finish() == tree(digests)[0]


def odd_rows():
    rng = random.Random(6)
    rows = [(i, rng.choice(["Ab C", "x", "", None, "É ÀB", "LONG " * 30_000 if i % 97 == 0 else "Word"]), rng.choice(["en", None]), rng.choice(["hot"] * 8 + ["b", "ä", "", None, "Z"]), rng.choice([None, i]), 1) for i in range(700)]
    rows += [(5, "twice", "en", "hot", 5, 1)] * 3 + [(5, "other", "en", "hot", 5, 1), (None, "No Id", "en", None, 1, 1), (None, "No Id", "en", None, 1, 1), (None, None, None, "alone", None, 1)]
    rows += [(1000 + i, "Few", "en", f"s{i}", 3, 1) for i in range(40)] + [(-7, "Minus", "en", "b", 5, 1)]
    return rows


@pytest.mark.parametrize("block", [16, 256, 4096])
def test_manifest_of_odd_rows(spark, block, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_PER_PART", 60)
    frame = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long, root int")
    got = merkle.manifest(frame, block).collect()
    assert Counter(map(tuple, got)) == plain_manifest([r.asDict() for r in frame.collect()])


def test_a_witness_proves_its_leaf_only(spark):
    frame = spark.createDataFrame(plain.rows_of([f"Text {i}" for i in range(60)]), plain.DOCS)
    rows = merkle.witnesses(merkle.leaves_of(frame)).collect()
    assert len({r["root"] for r in rows}) == 1 and len(rows) == 60
    for r, other in zip(rows, rows[1:] + rows[:1], strict=True):
        fold = {}
        for name, node in (("own", r["leaf"]), ("other", other["leaf"])):
            for a, b in zip(r["lefts"], r["rights"], strict=True):
                node = sha(a + node + b)
            fold[name] = node
        assert fold["own"] == r["root"] != fold["other"]


def test_few_rows(spark):
    empty = spark.createDataFrame([], plain.DOCS)
    assert merkle.manifest(empty).count() == 0
    one = spark.createDataFrame([(4, "only", "en", "s", 4)], plain.DOCS)
    r = merkle.manifest(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == sha("") and r["verified"]


def test_op12(spark):
    from crawlgauge.llm import catalog

    sys.path.insert(0, os.path.join(ROOT, "tests"))
    from check_oracles import compare, connect

    got = catalog.QUERIES["op12_merkle_manifest"](spark, SF).persist()
    assert Counter(map(tuple, got.collect())) == plain_manifest([r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    assert compare(connect(SF), got, catalog.ORACLES["op12_merkle_manifest"]) == ""
