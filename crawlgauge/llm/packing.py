"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best-fit: at most ``OPEN_BINS`` bins are open at a time. Open bins are kept in a bitset keyed by
their free space, so the best fitting bin is the lowest set bit at or above the piece's length. If no open bin fits and
the bound is reached, the fullest open bin closes first.

Pieces meet in shards of about ``PIECES_PER_SHARD`` by a hash of their id, so no task depends on the size of the corpus
and each shard leaves a few bins partly filled. A shard arrives in waves of ``WAVE`` pieces, the longest of a wave first:
the bins that a wave could not fill stay open for the next ones until the bound closes the fullest of them. Pieces as
long as a sequence fill one by themselves and are never shuffled. Only lengths are shuffled, never tokens.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgauge.llm.common import prepared, table, written

CAPACITY = 1024
OPEN_BINS = 2048
PIECES_PER_SHARD = 65_536
WAVE = 4096
END_ID = 2
TOKENIZER = "byte_bpe_50k"
#: Added tokens of the vocabulary's JSON file: whole wherever they stand in a text, cut out before it is split.
ADDED_TOKENS = {"<|endoftext|>": 50256}

PIECE_FIELDS = [
    ("doc_id", pa.int64()),
    ("piece", pa.int32()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("own_sequence", pa.int64()),
    ("ids", pa.binary()),
]


def tokenizer_file(name: str = TOKENIZER, folder: str | None = None) -> str:
    """Path of the public vocabulary; ``folder`` replaces the installed place."""
    if folder:
        return f"{folder}/{name}.tiktoken"
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def encoder(path: str):
    """The public byte-level vocabulary, read by its ranks, with the added tokens of its JSON file.

    ``text_ids`` gives with it the ids that ``tokenizers`` gives with that file (a test compares them), about four times
    as fast. Its ``encode_ordinary`` alone takes the strings of added tokens as ordinary text.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED_TOKENS)


def text_ids(tokens, text: str | None) -> list[int]:
    """Ids of a whole text, added tokens included; no end id. ``tokens`` is an ``encoder``."""
    return tokens.encode(text or "", allowed_special="all", disallowed_special=())


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: one, or full ones after a first that may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    starts = [0] * bool(first) + list(range(first, length, capacity))
    return [(s, min(capacity, (first or capacity) if s == 0 else capacity)) for s in starts]


def tokenized_pieces(documents: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False, tokenizer_dir: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, own_sequence (full pieces), ids if ``keep_ids``.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur; a null doc_id stays null.
    Texts are tokenised whole, one at a time, with ``ADDED_TOKENS`` as ids of their own; other columns are not read. ``own_sequence`` is null for pieces to be
    packed and else numbers the sequence that the piece fills by itself.
    """
    path = tokenizer_file(folder=tokenizer_dir)
    fields = PIECE_FIELDS if keep_ids else PIECE_FIELDS[:-1]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, full = encoder(path), (1 << 62) + (TaskContext.get().partitionId() << 36)
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(np.asarray(text_ids(tokens, text), "<u4"), np.uint32(END_ID)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own, raw = None, ids[start : start + length].tobytes()
                    if length == capacity:
                        own, full = full, full + 1
                    for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(raw), own, raw), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], [n for n, _ in fields])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, own_sequence long" + ", ids binary" * keep_ids
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, schema)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, in the given order, with at most ``open_bins`` bins open."""
    free_bins: dict[int, list[int]] = {}
    bitset = n_open = n_bins = 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        fitting = bitset >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            stack = free_bins[free]
            bin_number = stack.pop()
            if not stack:
                bitset ^= 1 << free
        else:
            if n_open == open_bins:
                fullest = (bitset & -bitset).bit_length() - 1
                free_bins[fullest].pop()
                if not free_bins[fullest]:
                    bitset ^= 1 << fullest
                n_open -= 1
            bin_number, free = n_bins, capacity
            n_bins += 1
            n_open += 1
        bins[i], offsets[i] = bin_number, capacity - free
        left = free - length
        if left:
            free_bins.setdefault(left, []).append(bin_number)
            bitset |= 1 << left
        else:
            n_open -= 1
    return bins, offsets


def arrival(lengths: np.ndarray, wave: int = WAVE) -> np.ndarray:
    """Order of arrival of pieces given in any order: wave after wave, the longest of each first."""
    return np.lexsort((-lengths, np.arange(len(lengths)) // wave))


def assigned(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """``pieces`` with sequence_id and offset. Sequences are gapless from 0 and hold at most ``capacity`` tokens.

    ``pieces`` should be a written table: it is counted and read twice. Pieces come in the order of a hash, ties by doc_id, then piece, null first,
    so reruns agree.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    part = pieces.where("own_sequence IS NULL")
    shards = max(1, math.ceil(part.count() / per_shard))

    def pack(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["turn", "doc_id", "piece", "ids_crc32", "length"], kind="stable", na_position="first")
        shard = shard.iloc[arrival(shard["length"].to_numpy())]
        bins, offsets = best_fit(shard["length"].to_numpy(), capacity, open_bins)
        return shard.assign(sequence_id=(int(key[0]) << 36) + bins, offset=offsets)[[*columns, "sequence_id", "offset"]]

    packed = (
        part.select(*columns, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).alias("shard"), F.xxhash64(F.lit("turn"), "doc_id", "piece", "ids_crc32").alias("turn"))
        .groupBy("shard")
        .applyInPandas(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
    alone = pieces.where("own_sequence IS NOT NULL").select(*columns, F.col("own_sequence").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(packed)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """Place of every piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    prepared(documents.sparkSession)
    return assigned(written(tokenized_pieces(documents, capacity), "pieces"), capacity, open_bins, per_shard)


def packed_sequences(documents: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, doc_ids and ids, in the order of their offsets."""
    prepared(documents.sparkSession)
    pieces = written(tokenized_pieces(documents, capacity, keep_ids=True), "token-pieces")
    key = ["doc_id", "piece", "ids_crc32"]
    # repeated rows of one document give equal keys: one of their equal id lists serves all places
    place = assigned(pieces, capacity, open_bins, per_shard).alias("p")
    ids = pieces.select(*key, "ids").dropDuplicates(key).alias("i")
    same = (F.col("p.doc_id").eqNullSafe(F.col("i.doc_id"))) & (F.col("p.piece") == F.col("i.piece")) & (F.col("p.ids_crc32") == F.col("i.ids_crc32"))
    joined = place.join(ids, same).select("p.sequence_id", "p.offset", "p.doc_id", "p.length", "i.ids")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.concatenate([np.frombuffer(x, "<u4") for x in parts]).tolist() for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sequence_id", "n_tokens", "doc_ids")), pa.array(out, pa.list_(pa.int32()))], ["sequence_id", "n_tokens", "doc_ids", "ids"])

    gathered = (
        joined.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("rows"))
        .select("sequence_id", "n_tokens", F.expr("transform(rows, r -> r.doc_id)").alias("doc_ids"), F.expr("transform(rows, r -> r.ids)").alias("parts"))
    )
    return gathered.mapInArrow(lists, "sequence_id long, n_tokens long, doc_ids array<long>, ids array<int>")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens; one row per piece."""
    return pack_documents(table(spark, sf_dir, "documents"))
