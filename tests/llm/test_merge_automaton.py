"""The tokenization automaton against the merges applied one by one, and against the library that owns the vocabulary."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crawlgauge.llm import merge_automaton  # noqa: E402

SF = "/root/testdata/sf0.001"


def merged(word, merges):
    """Every merge in its order, each from the left through the whole word."""
    out = list(word)
    for a, b in merges:
        k = 0
        while k < len(out) - 1:
            if (out[k], out[k + 1]) == (a, b):
                out[k : k + 2] = [a + b]
            k += 1
    return out


@pytest.mark.parametrize("seed", range(12))
def test_small_automata_spell_what_the_merges_give(seed):
    rng = random.Random(seed)
    tokens, merges = ["a", "b", "c"][: 2 + seed % 2], []
    while len(merges) < 4 + seed:
        pair = rng.choice(tokens), rng.choice(tokens)
        if "".join(pair) not in tokens:
            merges.append(pair)
            tokens.append("".join(pair))
    automaton = merge_automaton.Automaton.compile({t: i for i, t in enumerate(tokens)}, merges)
    for n in range(1, 8):
        for word in itertools.product(tokens[: 2 + seed % 2], repeat=n):
            want = merged(word, merges)
            got = automaton.encode("".join(word))
            assert [automaton.labels[t] for t in got] == want and automaton.decode(got) == " ".join(want)


def test_transitions_accept_one_spelling_only():
    merges = [("a", "b"), ("ab", "a"), ("b", "b")]
    names = ["a", "b", "ab", "aba", "bb"]
    automaton = merge_automaton.Automaton.compile({t: i for i, t in enumerate(names)}, merges)
    for n in range(1, 6):
        for word in map("".join, itertools.product("ab", repeat=n)):
            spelled = []
            for k in range(1, n + 1):
                for path in itertools.product(range(5), repeat=k):
                    if "".join(names[t] for t in path) == word:
                        state = 0
                        for t in path:
                            state = automaton.step(state, t) if state >= 0 else -1
                        spelled += [[names[t] for t in path]] * (state >= 0)
            assert spelled == [merged(word, merges)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(merge_automaton.vocabulary_file())
    found.no_truncation()
    found.no_padding()
    return found


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_texts_equal_the_library(spark, library):
    rng = random.Random(4)
    pieces = [t.replace("</w>", "") for t in library.get_vocab() if t.isascii()]
    texts = [
        None, "", " \n\t ", "one", "It's WE'LL they'd 12,5 €--… naïve", "ΣΑΣ ΟΔΟΣ. İstanbul ẞ ǅ", "é ẛ̣ ﬁ Å", "日本語のテキスト 12３",
        "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "e<|endoftext|>́", "🙂🙂👩‍👩‍👧 ​  x\x1cy\x85z",
        "new ᲉꟋ\U0001df25 letters ՘", "x" * 5000, "ab" * 3000 + "!" * 999, "the quick " * 20_000, "\x00\x01 \x7f", "'s's 'S I'VE'VE",
    ]
    texts += ["".join(rng.choices(pieces, k=30)) for _ in range(200)] + [" ".join(rng.choices(pieces, k=60)) for _ in range(100)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x370, 0x2000), rng.randrange(0x3000, 0xD000), rng.randrange(0x1F000, 0x20000)])) for _ in range(40)) for _ in range(200)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, "one", 1), (None, "one two", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = merge_automaton.encoded(frame).collect()
    assert Counter(map(tuple, got)) == Counter((i, *wanted(library, t)) for i, t, _ in rows)
    assert merge_automaton.encoded(frame.limit(0)).count() == 0
    kept = merge_automaton.encoded(frame.where("doc_id = 4"), keep_ids=True).first()
    assert kept["ids"] == library.encode(texts[4], add_special_tokens=False).ids and kept["decoded"] == library.decode(kept["ids"], skip_special_tokens=False)


def test_every_pair_of_frequent_tokens(library):
    automaton, _ = merge_automaton.compiled(merge_automaton.vocabulary_file())
    frequent = [t for t in automaton.labels[512:700] if t.isascii() and t.isalpha()]
    for a, b in itertools.product(frequent, repeat=2):
        assert automaton.encode(a + b) == library.encode(a + b, add_special_tokens=False).ids


def test_words_are_forgotten_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(merge_automaton, "REMEMBERED_WORDS", 5)
    automaton, _ = merge_automaton.compiled(merge_automaton.vocabulary_file())
    words = merge_automaton.WordTokens(automaton)
    for k in range(40):
        assert words[f"word{k}"][0].split() == [str(i) for i in words.ids(f"word{k}")]
        assert len(words) <= 5
    assert words["y" * 65] and "y" * 65 not in words


def test_words_met_again_stay_known(monkeypatch):
    """Only words not met since the time before are encoded anew; tasks of one process share the memory."""
    monkeypatch.setattr(merge_automaton, "REMEMBERED_WORDS", 5)
    automaton, _ = merge_automaton.compiled(merge_automaton.vocabulary_file())
    words, encoded = automaton.words(), []
    real = automaton.encode
    monkeypatch.setattr(automaton, "encode", lambda symbols: encoded.append(symbols) or real(symbols))
    for k in range(40):
        assert words["often"] and words[f"word{k}"]
    assert encoded.count("often") == 1 and len(encoded) == 41
    assert automaton.words() is words
    assert [words.ids(w) for w in ("a\x7fb", "ż")] == [real("".join(words.symbols[b] for b in w.encode())) for w in ("a\x7fb", "ż")]


def test_op13(spark, library):
    from crawlgauge.llm import catalog

    got = catalog.QUERIES["op13_merge_automaton"](spark, SF).collect()
    want = [(r["doc_id"], *wanted(library, r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, got)) == sorted(want)
