"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled into one deterministic automaton whose arcs carry tokens. It begins with one state and a loop for
every base symbol. Each merge (u, v) in turn is a gadget: beside every arc u an arc uv is laid to where v leads, and the
arcs u are led to a copy of their state without its arc v, so u v can't be spelled any more. What the automaton spells in
the end are exactly the token sequences that the merges give, one for every word and one for each of its beginnings.
Encoding goes through a word once: at each place it keeps the one token that ends there, found by table-driven
transitions from the states of the places before. Decoding emits the labels of the arcs.

A state of a vocabulary of 50,000 tokens has nearly as many arcs, so its row of the table holds what it refuses. A
refused label refuses with it the tokens later merged onto it from the left. Tokens are numbered along these merges, the
newest first, so each refusal is one interval, and a transition is one binary search in a row.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgauge.llm.common import prepared, table

TOKENIZER = "word_bpe_49k.json"
#: Words met since the memory last aged; beyond it those not met since the time before are forgotten. Longer words are never kept.
REMEMBERED_WORDS = 400_000
REMEMBERED_LENGTH = 64
#: Symbols by which the longest token that can end at a place is looked up.
TAIL = 3

# The splitting pattern of the vocabulary file, and the same for lower-case ASCII text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D\x20a-z0-9]+"


def most_symbols(tokens: Iterable[str]) -> dict[str, int]:
    """The last ``TAIL`` symbols of a token -> symbols of the longest token that ends in them."""
    most: dict[str, int] = {}
    for token in tokens:
        if len(token) >= TAIL:
            most[token[-TAIL:]] = max(most.get(token[-TAIL:], 0), len(token))
    return most


class Automaton:
    """States, arcs and labels of a vocabulary; ``compile`` builds one. All of it is as large as the vocabulary."""

    def __init__(self, labels: list[str], end: str, arcs: dict[str, int], state: array, number: array, row: array, refused: array):
        self.labels, self.end, self.arcs = labels, end, arcs
        #: by token: the state that its arc leads to, and its number in the order of the intervals
        self.state, self.number = state, number
        #: by state: where its intervals of refused numbers begin in ``refused``, as alternating starts and ends
        self.row, self.refused = row, refused
        self.remembered: WordTokens | None = None
        # inside a word and at its end: token by its symbols, and the most symbols of a token that ends in these
        inside = {a: t for a, t in arcs.items() if not end or not a.endswith(end)}
        final = {a[: len(a) - len(end)]: t for a, t in arcs.items() if a.endswith(end)}
        self.ending = [(tokens, most_symbols(tokens)) for tokens in (inside, final)]

    @classmethod
    def compile(cls, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = "") -> Automaton:
        """The automaton after the gadgets of all ``merges``, in their order. ``end`` marks the last symbol of a word."""
        merged = {a + b for a, b in merges}
        base = [i for t, i in vocabulary.items() if t not in merged]
        target = dict.fromkeys(base, 0)
        refused: list[dict[int, int]] = [{}]  # by state: label -> time from which it is refused
        shared = [len(base) + 1]  # by state: arcs that lead to it; words begin in the first
        left: dict[int, int] = {}
        born: dict[int, int] = {}

        def refuses(state: int, label: int) -> bool:
            row, time = refused[state], len(merges)
            while True:
                if row.get(label, time + 1) <= time:
                    return True
                if label not in left:
                    return False
                label, time = left[label], born[label]

        for time, (a, b) in enumerate(merges):
            u, v, w = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if u not in target or v not in target or w in target or refuses(target[u], v):
                continue  # the two are never neighbours
            target[w], left[w], born[w] = target[v], u, time
            shared[target[v]] += 1
            if shared[target[u]] > 1:
                shared[target[u]] -= 1
                refused.append(dict(refused[target[u]]))
                shared.append(1)
                target[u] = len(refused) - 1
            refused[target[u]].setdefault(v, time)
        return cls._tables(vocabulary, end, target, refused, left, born)

    @classmethod
    def _tables(cls, vocabulary, end, target, refused, left, born) -> Automaton:
        newest_last: dict[int, list[int]] = {}
        for w in sorted(born, key=born.get):
            newest_last.setdefault(left[w], []).append(w)
        order, todo = [], [t for t in target if t not in left]
        while todo:
            order.append(todo.pop())
            todo.extend(newest_last.get(order[-1], ()))
        size = dict.fromkeys(order, 1)
        for t in reversed(order):
            if t in left:
                size[left[t]] += size[t]
        n = max(vocabulary.values(), default=-1) + 1
        state, number = array("i", [-1]) * n, array("i", [-1]) * n
        for place, t in enumerate(order):
            state[t], number[t] = target[t], place
        # the tokens merged onto a label from a time on, newest first, follow it in the numbering without a gap
        reach: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for t, kids in newest_last.items():
            sizes = np.array([size[k] for k in kids])
            reach[t] = (np.array([born[k] for k in kids]), np.append(np.cumsum(sizes[::-1])[::-1], 0))
        ends: dict[tuple[int, int], int] = {}
        row, flat = array("i", [0]), array("i")
        for labels in refused:
            spans = []
            for label, time in labels.items():
                if (label, time) not in ends:
                    times, behind = reach.get(label, (np.empty(0), np.zeros(1, int)))
                    ends[label, time] = number[label] + 1 + int(behind[np.searchsorted(times, time)])
                spans.append((number[label], ends[label, time]))
            at = len(flat)
            for a, b in sorted(spans):
                if len(flat) > at and a <= flat[-1]:
                    flat[-1] = max(flat[-1], b)
                else:
                    flat.extend((a, b))
            row.append(len(flat))
        labels = [""] * n
        for t, i in vocabulary.items():
            labels[i] = t
        return cls(labels, end, {t: i for t, i in vocabulary.items() if i in target}, state, number, row, flat)

    def step(self, state: int, token: int) -> int:
        """State behind the arc ``token`` of ``state``; -1 if there is no such arc."""
        lo = self.row[state]
        inside = bisect_right(self.refused, self.number[token], lo, self.row[state + 1]) - lo
        return -1 if inside & 1 else self.state[token]

    def encode(self, symbols: str) -> list[int]:
        """Tokens of one word, given as its symbols without the end mark. Linear in the word's length."""
        n, row, refused, number, after = len(symbols), self.row, self.refused, self.number, self.state
        whole = self.ending[1][0].get(symbols)
        if whole is not None:
            return [whole]  # words begin in a state that refuses nothing
        token, start, state = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)

        def settle(i: int) -> None:
            tokens, most = self.ending[i == n]
            longest = most.get(symbols[i - TAIL : i], TAIL - 1) if i >= TAIL else i
            for k in range(i - longest if i > longest else 0, i):
                label = tokens.get(symbols[k:i])
                if label is not None:
                    if k and token[k] < 0:
                        settle(k)
                    lo = row[state[k]]  # as in step
                    if not (bisect_right(refused, number[label], lo, row[state[k] + 1]) - lo) & 1:
                        token[i], start[i], state[i] = label, k, after[label]
                        return
            raise ValueError(f"no token ends at {i} of {symbols[:40]!r}")

        # of a short word only the places that matter, asked for from its end
        for i in range(1, n + 1) if n > REMEMBERED_LENGTH else [n] if n else []:
            settle(i)
        out = []
        while n:
            out.append(token[n])
            n = start[n]
        return out[::-1]

    def words(self) -> WordTokens:
        """The memory of words; it stays with the automaton, so all tasks of a worker process share one."""
        if self.remembered is None:
            self.remembered = WordTokens(self)
        return self.remembered

    def decode(self, tokens: list[int]) -> str:
        """Labels of the tokens' arcs, with a space between them."""
        return " ".join([self.labels[t] for t in tokens])


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + other.index(b)) for b in range(256)]


class Unassigned(dict):
    """character -> whether this Python's Unicode tables don't know it; the library's tables may be newer."""

    def __missing__(self, character: str) -> bool:
        self[character] = unknown = unicodedata.category(character) == "Cn"
        return unknown


class WordTokens(dict):
    """word -> (its ids, their decoding), both as texts; encoded by the automaton when first met.

    Holds the words met since it last aged, and beside them those from the time before, of which every one that is met
    again is taken over.
    """

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.symbols = automaton, byte_symbols()
        self.before: dict[str, tuple[str, str]] = {}

    def ids(self, word: str) -> list[int]:
        if word.isascii() and word.isprintable() and " " not in word:
            return self.automaton.encode(word)  # such bytes are their own symbols
        return self.automaton.encode("".join([self.symbols[b] for b in word.encode("utf-8")]))

    def __missing__(self, word: str) -> tuple[str, str]:
        found = self.before.get(word)
        if found is None:
            ids = self.ids(word)
            found = " ".join(map(str, ids)), self.automaton.decode(ids)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found


class Splitter:
    """Texts to words as the vocabulary file says: NFC, lower case, white space dropped, added tokens whole.

    Added tokens are cut out of the raw text first. Lower case is by code point, so a final sigma is like any other.
    Texts with code points unknown to this Python go through the library's own normaliser and splitter.
    """

    def __init__(self, path: str, added: dict[str, int]):
        self.path, self.added = path, added
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.unknown, self.words, self.ascii_words = Unassigned(), regex.compile(WORDS), re.compile(ASCII_WORDS)
        self.library = None

    def parts(self, text: str) -> list[str]:
        """Stretches between added tokens at even places, added tokens at odd ones."""
        return self.cut.split(text) if self.cut else [text]

    def split(self, part: str) -> list[str]:
        if part.isascii():
            return self.ascii_words.findall(part.lower())
        if any(map(self.unknown.__getitem__, set(part))):
            return self._by_library(part)
        return self.words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())

    def _by_library(self, part: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.bytes = {s: b for b, s in enumerate(byte_symbols())}
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes([self.bytes[s] for s in word]).decode("utf-8") for word, _ in words]


def vocabulary_file(name: str = TOKENIZER, folder: str | None = None) -> str:
    """Path of the public vocabulary; ``folder`` replaces the installed place."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def compiled(path: str) -> tuple[Automaton, dict[str, int]]:
    """The automaton of a vocabulary file with word ends, and its added tokens."""
    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    model = read["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    added = {t["content"]: t["id"] for t in read["added_tokens"]}
    automaton = Automaton.compile(model["vocab"], merges, model["end_of_word_suffix"] or "")
    automaton.labels += [""] * (max(added.values(), default=-1) + 1 - len(automaton.labels))
    for content, i in added.items():
        automaton.labels[i] = content
    return automaton, added


def encoded(documents: DataFrame, keep_ids: bool = False, tokenizer_dir: str | None = None) -> DataFrame:
    """Every row's tokens: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` ids and decoded, too.

    A null or empty text, and one of white space only, has no tokens: both digests are those of the empty text. Texts
    are taken whole, one at a time, however long. Repeated rows give repeated results, a null doc_id stays null, an
    empty table gives no rows; other columns are not read. The automaton is compiled once and broadcast: its size
    depends on the vocabulary alone (some 6 MB of tables beside the labels).
    """
    spark = prepared(documents.sparkSession)
    path = vocabulary_file(folder=tokenizer_dir)
    automaton, added = compiled(path)
    shipped = spark.sparkContext.broadcast(automaton)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * keep_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, splitter = shipped.value.words(), Splitter(path, added)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found: list[tuple[str, str]] = []
                for k, part in enumerate(splitter.parts(text or "")):
                    if k % 2:
                        found.append((str(added[part]), words.automaton.decode([added[part]])))
                    else:
                        found.extend(map(words.__getitem__, splitter.split(part)))
                ids, labels = " ".join([f[0] for f in found]), " ".join([f[1] for f in found])
                n = ids.count(" ") + bool(ids)
                row = [doc_id, n, hashlib.sha256(ids.encode("ascii")).hexdigest(), hashlib.sha256(labels.encode("utf-8")).hexdigest()]
                for column, value in zip(out, row + [list(map(int, ids.split())), labels] * keep_ids, strict=False):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, schema)


def op13_merge_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents and their decoding, as digests."""
    return encoded(table(spark, sf_dir, "documents"))
