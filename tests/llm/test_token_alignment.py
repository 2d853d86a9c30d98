"""Token alignment against all pairs of tokens, with the tokenizers that own the vocabularies."""

from __future__ import annotations

import hashlib
import os
import random
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import helpers as plain  # noqa: E402

from crawlgauge.llm import token_alignment  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def owners():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbol = {b: chr(b) for b in plain_bytes}
    for k, b in enumerate(b for b in range(256) if b not in plain_bytes):
        symbol[b] = chr(256 + k)
    byte = {c: b for b, c in symbol.items()}
    return first, second, byte


def spelled(owners, text):
    """Both sides as (id, first byte, end byte), or nothing."""
    first, second, byte = owners
    if not text:
        return [], []
    want, out = (" " + text).encode(), []
    a = [(i, bytes(byte[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i in second.encode(text) for p in [second.id_to_piece(i)]]
    for side in (a, b):
        if b"".join(t for _, t in side) != want:
            return [], []
        at, spans = 0, []
        for i, t in side:
            spans.append((i, at, at + len(t)))
            at += len(t)
        out.append(spans)
    return out


def brute_force(owners, rows):
    docs, holders = [], Counter()
    for doc_id, text in rows:
        a, b = spelled(owners, text)
        links = []
        for i, lo, hi in a:
            links += [(i, j) for j, lo2, hi2 in b if max(lo, lo2) < min(hi, hi2)]
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, before = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, lo, hi in side if lo >= before and hi <= e) for side in (a, b)))
            before = e
        text = ";".join(groups)
        holders.update(set(links))
        docs.append((doc_id, len(a), len(b), len(ends), links, hashlib.sha256(text.encode()).hexdigest() if a else "", text))
    best = {}
    for (i, _), n in holders.items():
        best[i] = max(best.get(i, 0), n)
    return Counter(
        (doc_id, n_a, n_b, n_groups, len(links), sum(holders[p] == best[p[0]] for p in links), sum(holders[p] for p in links), digest, text)
        for doc_id, n_a, n_b, n_groups, links, digest, text in docs
    )


ODD = [
    None, "", " ", "one", "  two  spaces\n\n\ttabs ", "It's WE'LL 12,345 €--… naïve café", "日本語のテキスト 🙂🙂👩‍👩‍👧", "a ▁ b", "▁▁", "<s> </s> <unk> <0x41> <|endoftext|>x",
    "é ẛ̣ ﬁ Å ​ 　 \xa0z", "\x00\x01\x7f", "x" * 700, "!" * 300 + "?" * 5, "new \U0001df25 Ᲊ", "unbelievably antidisestablishmentarian tokenization",
]


@pytest.mark.parametrize("links_per_chunk", [1, 300, 1 << 20])
def test_odd_texts_match_all_pairs(spark, owners, links_per_chunk):
    rng = random.Random(3)
    words = "the of and tokenization misaligned überraschend naïve 12 3456 don't co-operate résumé 東京 \n\n  ... (x) http://a.b/c?d=e".split(" ")
    texts = ODD + [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(60)] + ["".join(rng.choices(words, k=20)) for _ in range(20)]
    rows = list(enumerate(texts)) + [(5, texts[5])] * 3 + [(None, "no id"), (None, None)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, chunk int, links string")
    got = token_alignment.aligned_documents(frame, links_per_chunk, keep_groups=True).collect()
    assert Counter(map(tuple, got)) == brute_force(owners, rows)


def test_no_rows(spark):
    frame = spark.createDataFrame([], plain.DOCS)
    assert token_alignment.aligned_documents(frame).count() == 0


def test_packed_places_come_back():
    for places in ([], [0], [0, 0, 3], [5, 70_000, 70_000, 200_000], list(range(0, 300_000, 3)), [65_536]):
        assert token_alignment.unpacked(token_alignment.packed(np.array(places, np.int64))).tolist() == places


def test_op11(spark, owners):
    from crawlgauge.llm import catalog

    got = catalog.QUERIES["op11_token_alignment"](spark, SF).collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"] or "") < 6000]
    small = {i for i, _ in rows}
    # the counts need all documents, so only what a document has by itself is compared here
    want = {w[0]: w for w in brute_force(owners, rows)}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        if r["doc_id"] in small:
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (*want[r["doc_id"]][1:5], want[r["doc_id"]][7])
            assert r["count_sum"] >= want[r["doc_id"]][6]


def test_no_token_goes_over_a_single_space():
    import public_tokenizers

    first = token_alignment.ByteTokens(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    second = token_alignment.PieceTokens(public_tokenizers.path("piece_bpe_32k.model"))
    for tokens in (first.bytes, second.bytes):
        over = [t.decode("utf-8", "ignore") for t in tokens if token_alignment.BETWEEN_UNITS.search(t.decode("utf-8", "replace"))]
        ends = [t for t in tokens if t.endswith(b" ") and t.decode("utf-8", "replace").strip()]
        assert over == [] and ends == []


@pytest.mark.parametrize("units, links, at_once", [(0, 1, 1), (3, 1 << 22, 2), (200_000, 5, 7)])
def test_forgetting_changes_nothing(monkeypatch, units, links, at_once):
    import public_tokenizers

    def aligner():
        return token_alignment.Aligner(token_alignment.ByteTokens(public_tokenizers.path("byte_bpe_50k.tiktoken")), token_alignment.PieceTokens(public_tokenizers.path("piece_bpe_32k.model")))

    texts = [*ODD, "one two one  two\none two", " ".join(f"word{k % 9}" for k in range(50))]
    want = [aligner().align(t) for t in texts]
    monkeypatch.setattr(token_alignment, "REMEMBERED_UNITS", units)
    monkeypatch.setattr(token_alignment, "REMEMBERED_LINKS", links)
    monkeypatch.setattr(token_alignment, "UNITS_AT_ONCE", at_once)
    forgetful = aligner()
    for text, w in zip(texts, want, strict=True):
        got = forgetful.align(text)
        assert got[:3] == w[:3] and got.text == w.text
        assert got.pairs.tolist() == w.pairs.tolist() and got.times.tolist() == w.times.tolist()
