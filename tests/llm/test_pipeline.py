"""The pipeline against a plain run of its stages, and the subpackage as an optional part."""

from __future__ import annotations

import os
import subprocess
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402
import helpers as plain  # noqa: E402

from crawlgauge.llm import quality_grades  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_step_by_step(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    now, before = documents, {r["doc_id"]: r["text"] for r in documents.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert now.columns == documents.columns
        kept[name] = now.toPandas()
    # quality: verdicts of the classifier, texts unchanged
    grades = {r["doc_id"]: r["kept"] for r in quality_grades.op9_quality_grades(spark, SF).collect()}
    assert sorted(kept["quality"]["doc_id"]) == sorted(i for i, k in grades.items() if k)
    assert all(before[i] == t for i, t in zip(kept["quality"]["doc_id"], kept["quality"]["text"], strict=True))
    # lines on ten sites or more stay with their first document
    source = {i: (s, t) for i, s, t in kept["quality"][["doc_id", "source", "text"]].itertuples(index=False)}
    sites, first = {}, {}
    for i, (s, t) in sorted(source.items()):
        for line in {x.strip(" ") for x in t.split("\n") if len(x.strip(" ")) >= 20}:
            sites.setdefault(line, set()).add(s)
            first.setdefault(line, i)
    bad = {line for line, on in sites.items() if len(on) >= 10}
    want = {i: "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad or first[x.strip(" ")] == i) for i, (_, t) in source.items()}
    have = dict(zip(kept["line_dedup"]["doc_id"], kept["line_dedup"]["text"], strict=True))
    assert have == {i: t for i, t in want.items() if t == source[i][1] or plain.words(t)}
    # one document of each component
    component = plain.near_components(list(have.items()), corpus_pipeline.NEAR_PERCENT)
    assert sorted(kept["near_dedup"]["doc_id"]) == sorted(i for i, c in component.items() if i == c)
    # the mix: words near the targets
    left = kept["near_dedup"]
    sizes = {}
    for s, t in zip(left["source"], left["text"], strict=True):
        sizes[s] = sizes.get(s, 0) + len(plain.words(t))
    taken = {}
    for s, t in zip(kept["mix"]["source"], kept["mix"]["text"], strict=True):
        taken[s] = taken.get(s, 0) + len(plain.words(t))
    for s, target in plain.mix_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 1
    # packing: every token of every row
    import public_tokenizers
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert kept["pack"]["length"].sum() == sum(len(tokens.encode(t, add_special_tokens=False).ids) + 1 for t in kept["mix"]["text"])
    # sequence numbers aside, a whole run gives the same rows
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, whole[columns].to_numpy())) == sorted(map(tuple, kept["pack"][columns].to_numpy()))


def test_near_copies_from_80_percent_on_go(spark):
    """The stage over raw documents, among them pairs between 80 and 85 percent, against all pairs."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    component = plain.near_components(rows, 80)
    assert component != plain.near_components(rows, 85)
    got = corpus_pipeline.near_dedup(spark, documents, SF).select("doc_id").toPandas()["doc_id"]
    assert sorted(got) == sorted(i for i, c in component.items() if i == c)


def test_bands_hold_the_miss_at_every_threshold():
    from crawlgauge.llm import near_copies

    assert near_copies.bands_for(85) == near_copies.BANDS
    for percent in (60, 70, 80, 85, 95, 100):
        assert (1 - (percent / 100) ** near_copies.ROWS) ** near_copies.bands_for(percent) <= near_copies.MISS


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


@pytest.mark.parametrize("name", ["op4_license_scan", "op5_line_spread"])
def test_queries_with_sql(spark, name):
    import __spark_entry__ as entry

    sys.path.insert(0, os.path.join(ROOT, "tests"))
    from check_oracles import compare, connect

    assert compare(connect(SF), entry.queries()[name](spark, SF), entry.oracle_sql()[name]) == ""


def test_entry_without_the_subpackage(tmp_path):
    """The rest imports when the folders and the pipeline are gone."""
    for item in ("__spark_entry__.py", "crawlgauge"):
        os.symlink(f"{ROOT}/{item}", tmp_path / item) if item.endswith(".py") else None
    os.makedirs(tmp_path / "crawlgauge")
    for item in os.listdir(f"{ROOT}/crawlgauge"):
        if item != "llm":
            os.symlink(f"{ROOT}/crawlgauge/{item}", tmp_path / "crawlgauge" / item)
    code = "import sys; sys.path.insert(0, '.'); import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py'); m = u.module_from_spec(s); sys.modules['e'] = m; s.loader.exec_module(m); print('pipeline' in m.queries(), len(m.queries()) > 50)"
    source = open(f"{ROOT}/__spark_entry__.py").read()
    os.unlink(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(source)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert out.stdout.split() == ["False", "True"], out.stderr[-800:]


def test_classifier_keeps_clean_documents(spark):
    """Held-out labels at a larger size: clean documents stay, poor ones go."""
    sf = "/root/testdata/sf0.1"
    got = quality_grades.op9_quality_grades(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    clean, poor = got[(got["quality"] == 1) & (got["toxic"] == 0)], got[got["quality"] == 0]
    assert clean["kept"].mean() > 0.98 and poor["kept"].mean() < 0.05
    assert np.isfinite(got["expected_grade"]).all()
