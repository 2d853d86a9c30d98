"""Alignment of the tokens of two tokenizers over the same bytes.

Both token lists of a document end at byte offsets. A dictionary from end to index is made of each list, and the ends in
both, sorted, cut the two id lists into groups, each group the same bytes. Within a group every pair of tokens that share
a byte is a link. An id pair counts the documents of the whole corpus that hold it linked. Both lists always end at a
single space between other characters, so a text is aligned unit by unit, and a unit met before is not aligned again.

Documents are aligned in one pass and written in chunks of about ``LINKS_PER_CHUNK`` links. A chunk is one row with its
distinct pairs and how many of its documents hold each, and a row for each document whose links point into the chunk's
pairs. So a pair that every document holds is one row for each chunk, not for each document, where pairs meet to be
counted and where the counts go back.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgauge.llm.common import prepared, table, written

BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
LINKS_PER_CHUNK = 1 << 20
#: Pair of ids as one number: the first times this, plus the second, which is smaller than this.
SECOND_IDS = 1 << 16
#: Units of a text meet at single spaces between other characters; no token of either vocabulary goes over such a place.
BETWEEN_UNITS = re.compile(r" (?=\S)(?<=\S )")
UNITS_AT_ONCE = 1 << 16
#: Units and links that a task remembers; beyond them the memory starts anew.
REMEMBERED_UNITS, REMEMBERED_LINKS = 400_000, 1 << 22


def vocabulary_file(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary; ``folder`` replaces the installed place."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteTokens:
    """The byte-level vocabulary over a space and the text; strings of special tokens are plain text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(" " + text)


class PieceTokens:
    """The piece vocabulary, which puts the space before the text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode("utf-8"))

    def encode(self, text: str) -> list[int]:
        return self.pieces.encode(text)


class Aligned(NamedTuple):
    """A text's tokens by both tokenizers: counts, distinct pair numbers of its links, how often each is linked, groups."""

    n_a: int
    n_b: int
    n_groups: int
    pairs: np.ndarray
    times: np.ndarray
    text: bytes


class Aligner:
    """Groups and links of texts by two tokenizers.

    Neither tokenizer has a token that goes from a character over into a single space behind it. So both lists end a
    token before each such space, a text's groups are those of its units one after another, and a unit met before is
    looked up. Units are remembered up to ``REMEMBERED_UNITS`` and ``REMEMBERED_LINKS``; then the memory starts anew.
    """

    def __init__(self, first, second):
        self.sides = first, second
        self.widths = [np.array([len(b) for b in t.bytes], np.int64) for t in self.sides]
        # an id's text and what stands behind it: inside a group, at the end of its side, and at the end of the unit
        behind = ((first, ",||"), (second, ",;\n"))
        self.id_texts = np.array([f"{i}{c}".encode() for t, marks in behind for i in range(len(t.bytes)) for c in marks])
        self._forget()

    def _forget(self) -> None:
        self.units: dict[str, int] = {}
        self.texts: list[bytes] = []
        #: by unit: tokens of both sides, groups; links of all units one after another, and where each unit's begin
        self.counts, self.links, self.begin = array("q"), array("q"), array("q", [0])

    def _spelled(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]] | None:
        """Of units joined by spaces: tokens and groups of each, all links, links of each, and groups of each as text.

        None if a side doesn't spell the joined units and the space before them.
        """
        text = " ".join(units)
        want, ids = (" " + text).encode("utf-8"), []
        for side in self.sides:
            found = side.encode(text)
            if b"".join(map(side.bytes.__getitem__, found)) != want:
                return None
            ids.append(np.array(found, np.int64))
        ends = [np.cumsum(w[i]) for w, i in zip(self.widths, ids, strict=True)]
        index = [dict(zip(e.tolist(), range(1, len(e) + 1))) for e in ends]  # noqa: B905
        common = sorted(index[0].keys() & index[1].keys())
        cuts = [np.fromiter(map(i.__getitem__, common), np.int64, len(common)) for i in index]
        # the bytes between two neighbouring ends of either list belong to one token of each side, and two tokens share
        # at most one such stretch; so a slice has one link for each end within it
        every = np.sort(np.concatenate(ends), kind="stable")
        every = every[np.append(True, every[1:] != every[:-1])]
        first, second = (i[np.searchsorted(e, every)] for i, e in zip(ids, ends, strict=True))
        stops = np.cumsum([len(u) + 1 if u.isascii() else len(u.encode("utf-8")) + 1 for u in units])
        n_a, n_b, n_groups, n_links = (np.diff(np.searchsorted(e, stops, "right"), prepend=0) for e in (*ends, np.array(common), every))
        return np.stack([n_a, n_b, n_groups], 1), first * SECOND_IDS + second, n_links, self._group_texts(ids, cuts, n_groups)

    def _group_texts(self, ids: list[np.ndarray], cuts: list[np.ndarray], n_groups: np.ndarray) -> list[bytes]:
        """By unit: ids of a side joined by commas, the two sides by a bar, groups by a semicolon."""
        out = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for side in (0, 1):
            own, other = cuts[side], cuts[1 - side]
            before = np.concatenate([[0], other[:-1]]) if side == 0 else other
            mark = np.zeros(len(ids[side]), np.int64)
            mark[own - 1] = 1
            mark[own[np.cumsum(n_groups) - 1] - 1] = 2
            place = np.arange(len(mark)) + np.repeat(before, np.diff(own, prepend=0))
            out[place] = 3 * (ids[side] + side * len(self.sides[0].bytes)) + mark
        # texts are as wide as the longest; what fills them up goes
        return self.id_texts[out].tobytes().replace(b"\0", b"").split(b"\n")[:-1]

    def _remember(self, units: list[str]) -> None:
        """Place each unit in the memory; -1 stands for one that a side doesn't spell."""
        # white space at its edge would stand beside the space that joins
        edged = [u for u in units if u[0].isspace() or u[-1].isspace()]
        joined = [u for u in units if not (u[0].isspace() or u[-1].isspace())] if edged else units
        todo = [[u] for u in edged] + [joined] * bool(joined)
        while todo:
            some = todo.pop()
            found = self._spelled(some)
            if found:
                counts, links, n_links, texts = found
                self.units.update(zip(some, range(len(self.texts), len(self.texts) + len(some)), strict=True))
                self.texts.extend(texts)
                self.counts.frombytes(counts.astype(np.int64).tobytes())
                self.begin.frombytes((np.cumsum(n_links) + self.begin[-1]).astype(np.int64).tobytes())
                self.links.frombytes(links.tobytes())
            elif len(some) > 1:
                todo.extend((some[: len(some) // 2], some[len(some) // 2 :]))
            else:
                self.units[some[0]] = -1

    def align(self, text: str | None) -> Aligned:
        """Without tokens if the text is null or empty, or if a side doesn't spell the space and the text."""
        nothing = np.empty(0, np.int64)
        if not text:
            return Aligned(0, 0, 0, nothing, nothing, b"")
        units, parts = BETWEEN_UNITS.split(text), []
        for at in range(0, len(units), UNITS_AT_ONCE):
            some = units[at : at + UNITS_AT_ONCE]
            if len(self.units) > REMEMBERED_UNITS or len(self.links) > REMEMBERED_LINKS:
                self._forget()
            missing = [u for u in dict.fromkeys(some) if u not in self.units]
            if missing:
                self._remember(missing)
            places = list(map(self.units.__getitem__, some))
            if min(places) < 0:
                found = self._spelled([text])
                if not found:
                    return Aligned(0, 0, 0, nothing, nothing, b"")
                counts, links, _, texts = found
                return Aligned(*counts[0].tolist(), *np.unique(links, return_counts=True), texts[0])
            parts.append((*self._added_up(places), b";".join(map(self.texts.__getitem__, places))))
        if len(parts) == 1:
            counts, pairs, times, joined = parts[0]
        else:
            counts, joined = sum(p[0] for p in parts), b";".join([p[3] for p in parts])
            pairs, times = _summed(np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
        return Aligned(*counts.tolist(), pairs, times, joined)

    def _added_up(self, places: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the units together, their distinct pairs, and how often each pair is linked."""
        unit, uses = np.unique(np.array(places), return_counts=True)
        counts = uses @ np.frombuffer(self.counts, np.int64).reshape(-1, 3)[unit]
        begin = np.frombuffer(self.begin, np.int64)
        sizes = begin[unit + 1] - begin[unit]
        at = np.repeat(begin[unit] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return counts, *_summed(np.frombuffer(self.links, np.int64)[at], np.repeat(uses, sizes))


def _summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, ascending, with the sums of their times."""
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    return pairs[new], np.add.reduceat(times, new)


ALIGNED_SCHEMA = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary, pairs binary, holders binary"
ALIGNED = [("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("links", pa.binary()), ("pairs", pa.binary()), ("holders", pa.binary())]


def packed(places: np.ndarray) -> bytes:
    """Ascending numbers as steps of two bytes each, or of four behind one zero byte."""
    steps = np.diff(places, prepend=0)
    return steps.astype("<u2").tobytes() if steps.max(initial=0) < 1 << 16 else b"\0" + steps.astype("<u4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u2") if len(raw) % 2 == 0 else np.frombuffer(raw[1:], "<u4"), dtype=np.int64)


def chunks_of(documents: DataFrame, links_per_chunk: int = LINKS_PER_CHUNK, keep_groups: bool = False, tokenizer_dir: str | None = None) -> DataFrame:
    """A row for each document, and for each chunk of documents one with its pairs and their holders."""
    paths = [vocabulary_file(name, tokenizer_dir) for name in (BYTE_TOKENIZER, PIECE_TOKENIZER)]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteTokens(paths[0]), PieceTokens(paths[1]))
        number, rows, found, n_links = TaskContext.get().partitionId() << 32, [], [], 0

        def chunk() -> pa.RecordBatch:
            pairs, place = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
            at, out = 0, []
            for row, (own, times) in zip(rows, found, strict=True):
                out.append((number, *row, packed(np.repeat(place[at : at + len(own)], times)), None, None))
                at += len(own)
            out.append((number, *[None] * 8, pairs.astype("<u4").tobytes(), np.bincount(place, minlength=len(pairs)).astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), ALIGNED, strict=True)], [n for n, _ in ALIGNED])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                aligned = aligner.align(text)
                own = int(aligned.times.sum())
                digest = hashlib.sha256(aligned.text).hexdigest() if aligned.text else ""
                rows.append((doc_id, aligned.n_a, aligned.n_b, aligned.n_groups, own, digest, aligned.text.decode("ascii") if keep_groups else None))
                found.append((aligned.pairs, aligned.times))
                n_links += own
                if n_links >= links_per_chunk:
                    yield chunk()
                    number, rows, found, n_links = number + 1, [], [], 0
        if rows:
            yield chunk()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(align, ALIGNED_SCHEMA)


def held_pairs(chunks: DataFrame) -> DataFrame:
    """chunk, place (of the pair in the chunk), pair, holders (documents of the chunk that hold it)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, holders in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "holders")), strict=True):
                pair = np.frombuffer(pairs, "<u4")
                columns = [pa.array(np.full(len(pair), chunk)), pa.array(np.arange(len(pair), dtype=np.int32)), pa.array(pair.astype(np.int64)), pa.array(np.frombuffer(holders, "<u4").astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "place", "pair", "holders"])

    return chunks.where("pairs IS NOT NULL").select("chunk", "pairs", "holders").mapInArrow(explode, "chunk long, place int, pair long, holders long")


def pair_counts(held: DataFrame) -> DataFrame:
    """first_id, second_id, documents: how many documents of the corpus hold the pair linked."""
    return held.groupBy("pair").agg(F.sum("holders").alias("documents")).select(F.expr(f"pair div {SECOND_IDS}").alias("first_id"), F.expr(f"pair % {SECOND_IDS}").alias("second_id"), "documents")


OUT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def aligned_documents(documents: DataFrame, links_per_chunk: int = LINKS_PER_CHUNK, keep_groups: bool = False, tokenizer_dir: str | None = None) -> DataFrame:
    """Every row's alignment: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups.

    ``groups`` is null unless ``keep_groups``. A text that is null or empty, or that one of the tokenizers doesn't spell
    byte for byte (the piece vocabulary reads U+2581 as a space), has no tokens: all counts are 0 and the digest is the
    empty text. Whole texts are aligned, one at a time, however long. Repeated rows are documents of their own, a null
    doc_id stays null, an empty table gives no rows; other columns are not read.
    """
    prepared(documents.sparkSession)
    chunks = written(chunks_of(documents, links_per_chunk, keep_groups, tokenizer_dir), "aligned-chunks")
    held = held_pairs(chunks)
    counts = written(pair_counts(held), "pair-counts")
    # one row for each id of the first vocabulary: no more than that vocabulary has
    best = counts.groupBy("first_id").agg(F.max("documents").alias("most"))
    known = counts.join(F.broadcast(best), "first_id").select((F.col("first_id") * SECOND_IDS + F.col("second_id")).alias("pair"), "documents", (F.col("documents") == F.col("most")).alias("best"))
    back = held.select("chunk", "place", "pair").join(known, "pair").select("chunk", "place", "documents", "best")
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]

    def total(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        count, top = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
        place = pairs.column("place").to_numpy()
        count[place], top[place] = pairs.column("documents").to_numpy(), pairs.column("best").to_numpy().astype(np.int64)
        links = [unpacked(raw) for raw in docs.column("links").to_pylist()]
        columns = {c: docs.column(c) for c in own}
        columns["n_best"] = pa.array([int(top[i].sum()) for i in links], pa.int64())
        columns["count_sum"] = pa.array([int(count[i].sum()) for i in links], pa.int64())
        names = [c.split(" ")[0] for c in OUT_SCHEMA.split(", ")]
        return pa.table([columns[n] for n in names], names=names)

    docs = chunks.where("pairs IS NULL").select("chunk", *own, "links")
    return docs.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(total, OUT_SCHEMA)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of both tokenizers over all documents, with the corpus-wide counts of their id pairs."""
    return aligned_documents(table(spark, sf_dir, "documents")).drop("groups")
