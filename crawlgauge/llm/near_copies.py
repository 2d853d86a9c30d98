"""MinHash near-dedup: circulant signatures, banding, exact Jaccard verification, components.

A document is the set of its distinct five-word shingles, hashed to 64 bits. Circulant MinHash draws one permutation that
places a shingle, ``y``, and a second one, ``p``; coordinate ``k`` of the signature is the least ``p(y + k)`` over the
set, so the second permutation, circularly shifted, gives all coordinates. Documents that agree in all rows of a band
are candidates.

Copies (equal sets) collapse first, by aggregation, to the one with the least id, so groups of copies of any size cost
one row. Within a bucket no pairs are formed: members are compared with the bucket's hub, the member that meets most
others in all its buckets. Members of a bucket that stay in different components are then compared in blocks, and
candidates among them verified on the full sets, until each bucket is one component or its pairs are known.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgauge.llm.common import mix64, prepared, table, written

WORDS = 5
MIN_PERCENT = 85
BANDS, ROWS = 25, 5
#: Chance that the bands miss a pair at the threshold, at most; 25 bands hold it at 85 percent.
MISS = 4.4e-7
PLACE_SEED, SHIFT_SEED = 0x5851F42D4C957F2D, 0x2545F491
#: Set elements hashed at once; bounds the scratch memory for very long texts.
CHUNK = 1024


class WordHashes(dict):
    """Word -> 64-bit hash, filled as words are met, emptied when it is large."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        code = xxhash.xxh64_intdigest(word)
        self[word] = code
        return code


def shingle_set(text: str | None, hashes: WordHashes, n_words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; fewer words: the whole sequence as one; none: empty."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    code = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, n_words)
    out = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += code[j : j + len(out)]
    return np.unique(mix64(out))


def signature(elements: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a non-empty set: ``k`` coordinates from two permutations."""
    place = (mix64(elements ^ np.uint64(PLACE_SEED)) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(k, dtype=np.uint32) + np.uint32(SHIFT_SEED)
    least = np.full(k, 0xFFFFFFFF, np.uint32)
    scratch = np.empty((min(CHUNK, len(place)), k), np.uint32)
    for at in range(0, len(place), CHUNK):
        x = place[at : at + CHUNK, None] + shift
        t = scratch[: len(x)]
        for right, times in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            np.right_shift(x, right, out=t)
            np.bitwise_xor(x, t, out=x)
            np.multiply(x, np.uint32(times), out=x)
        np.right_shift(x, 16, out=t)
        np.bitwise_xor(x, t, out=x)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    part = least[: bands * rows].reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + part[:, j])
    return key.view(np.int64)


def bands_for(min_percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed for ``MISS`` at the threshold: 25 at 85 percent, 37 at 80; lower thresholds take more."""
    apart = 1 - (min_percent / 100) ** rows
    return max(1, math.ceil(math.log(miss) / math.log(apart))) if apart else 1


def similar(a: np.ndarray, b: np.ndarray, min_percent: int = MIN_PERCENT) -> bool:
    """Exact: 100 * |a & b| >= min_percent * |a | b| of two sorted distinct arrays."""
    few, many = sorted((len(a), len(b)))
    if 100 * few < min_percent * many or not few:
        return False
    both = int(np.count_nonzero(np.isin(a, b, assume_unique=True)))
    return 100 * both >= min_percent * (few + many - both)


def signed(documents: DataFrame, n_bands: int = BANDS) -> DataFrame:
    """One row per document row, written once: doc_id, text_hash, n_shingles, digest of the set, band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, digests, bands = [], [], []
            for text in batch.column("text").to_pylist():
                elements = shingle_set(text, hashes)
                sizes.append(len(elements))
                digests.append(hashlib.blake2b(elements.tobytes(), digest_size=16).digest())
                bands.append(band_keys(signature(elements, n_bands * ROWS), n_bands) if len(elements) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "digest", "bands"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return written(rows.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>"), "signatures")


def shingle_sets(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, elements) for ``nodes`` (node, first, digest): the set with that digest among the rows of the document ``first``.

    The node stands in doc_id. A merge join, alike at every size.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, got = [], []
            for node, digest, text in zip(*(batch.column(c).to_pylist() for c in ("node", "digest", "text")), strict=True):
                elements = shingle_set(text, hashes)
                if hashlib.blake2b(elements.tobytes(), digest_size=16).digest() == digest:
                    ids.append(node)
                    got.append(elements.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "elements"])

    rows = documents.select(F.col("doc_id").cast("long").alias("first"), "text").join(nodes.hint("merge"), "first").select("node", "digest", "text")
    return rows.mapInArrow(sets, "doc_id long, elements array<long>")


def sharing(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of some sets, by products of 0/1 matrices over the elements that two or more share."""
    n = len(sets)
    if n == 2:
        both = int(np.count_nonzero(np.isin(sets[0], sets[1], assume_unique=True)))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float32)
    element, times = np.unique(np.concatenate(sets), return_counts=True)
    element = element[times > 1]
    out = np.zeros((n, n), np.float32)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    every = np.concatenate(sets)
    at = np.searchsorted(element, every)
    at[at == len(element)] = 0
    known = element[at] == every if len(element) else np.zeros(len(every), bool)
    row, at = row[known], at[known]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for start in range(0, len(element), columns):
        a, b = np.searchsorted(at, [start, start + columns])
        part = np.zeros((n, min(columns, len(element) - start)), np.float32)
        part[row[a:b], at[a:b] - start] = 1
        out += part @ part.T
    return out


def joins_of(ids: np.ndarray, components: np.ndarray, sets: list[np.ndarray], min_percent: int = MIN_PERCENT) -> list[tuple[int, int]]:
    """Links between the given documents that join different components: a spanning choice, not all pairs."""
    size = np.array([len(s) for s in sets], np.int64)
    both = sharing(sets).astype(np.int64)
    close = 100 * both >= min_percent * (size[:, None] + size[None, :] - both)
    close &= components[:, None] != components[None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(close)), strict=True):
        a, b = root(int(components[i])), root(int(components[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def with_hubs(members: DataFrame) -> DataFrame:
    """``members`` (key, doc_id, n, met) with their bucket's hub and its size: the member that meets most others."""
    hubs = members.groupBy("key").agg(F.max(F.struct("met", -F.col("doc_id"), "n")).alias("h")).select("key", (-F.col("h.col2")).alias("hub"), F.col("h.n").alias("hub_n"))
    return members.join(hubs, "key").select("key", "doc_id", "n", "hub", "hub_n")


def hub_links(members: DataFrame, sets: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """Verified links (a, b) of bucket members with their bucket's hub."""
    fit = (100 * F.least("n", "hub_n") >= min_percent * F.greatest("n", "hub_n")) & (F.col("doc_id") != F.col("hub"))
    pairs = members.where(fit).select("doc_id", "hub").distinct()
    own = pairs.join(sets, "doc_id").select("doc_id", "hub", F.col("elements").alias("own"))
    both = own.join(sets.select(F.col("doc_id").alias("hub"), "elements"), "hub")
    common = F.size(F.array_intersect("own", "elements"))
    return both.where(100 * common >= min_percent * (F.size("own") + F.size("elements") - common)).select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))


#: Members of a block; a block is compared with one other at a time.
BLOCK_MEMBERS = 400
#: Rows that one call compares: many small cells, or one of two blocks.
BATCH_ROWS = 2000


def block_links(members: DataFrame, found: DataFrame, sets: DataFrame, min_percent: int = MIN_PERCENT, size: int = BLOCK_MEMBERS) -> DataFrame:
    """Links (a, b) that still join components of a bucket: all pairs of members in different components, by blocks.

    Buckets with the same members are compared once. Members of a bucket's largest component are never compared with
    each other. Others meet all, a block with a block, so neither a large bucket nor a third of all documents in it lands
    in one task; small buckets share a call.
    """
    labelled = members.join(found, members.doc_id == found.id, "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    counts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("sum"), F.min("doc_id").alias("low"))
    about = counts.groupBy("key").agg(
        F.sum("n").alias("all"), F.sum("sum").alias("sum"), F.min("low").alias("low"), F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("kinds")
    )
    about = about.where("kinds > 1").groupBy("sum", "low", "all").agg(F.min(F.struct("key", "most")).alias("one")).select("one.key", "one.most", "all")
    about = about.select("key", F.col("most.component").alias("main"), F.ceil(F.col("most.n") / size).alias("mains"), F.ceil((F.col("all") - F.col("most.n")) / size).alias("others"))
    placed = labelled.join(about, "key").select(
        "key", "doc_id", "component", "mains", "others", (F.col("component") == F.col("main")).alias("is_main"), F.xxhash64("doc_id").alias("h")
    )
    block = F.pmod(F.col("h"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others")))
    cell = lambda a, kind, b: F.xxhash64(F.col("key"), a.cast("long"), F.lit(kind), b.cast("long"))
    cells = F.when(F.col("is_main"), F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: cell(o, "main", F.col("block")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda m: cell(F.col("block"), "main", m)),
            F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: cell(F.least(F.col("block"), o), "other", F.greatest(F.col("block"), o))),
        )
    )
    rows = written(placed.withColumn("block", block).select("doc_id", "component", F.explode(cells).alias("cell")), "cells")
    batches = max(1, math.ceil(rows.count() / BATCH_ROWS))

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["cell", "doc_id"], kind="stable").drop_duplicates(["cell", "doc_id"])
        ids, components, sets_ = batch["doc_id"].to_numpy(), batch["component"].to_numpy(), list(batch["elements"])
        edges = np.flatnonzero(np.diff(batch["cell"].to_numpy())) + 1
        links = []
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
            if b - a > 1 and len(np.unique(components[a:b])) > 1:
                links += joins_of(ids[a:b], components[a:b], sets_[a:b], min_percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    dealt = rows.withColumn("batch", F.pmod("cell", F.lit(batches))).join(sets, "doc_id")
    return dealt.groupBy("batch").applyInPandas(compare, "a long, b long")


def components_of(documents: DataFrame, min_percent: int = MIN_PERCENT) -> tuple[DataFrame, DataFrame]:
    """Every row's (doc_id, text_hash, n_shingles, digest), and for each set's digest its component_id and keep_hash.

    Links are between sets, each a node with a number of its own: rows of one doc_id with different texts are as apart as
    those of different ids. component_id is the least doc_id of a component, keep_hash the text_hash of the row that
    stands for it, the least one of that id.
    """
    from crawlgauge.llm.components import connected

    prepared(documents.sparkSession)
    rows = signed(documents, bands_for(min_percent))
    able = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = able.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    groups = written(least.select("digest", F.col("least.doc_id").alias("first"), F.col("least.text_hash").alias("first_hash"), F.monotonically_increasing_id().alias("node")), "copies")
    one = able.join(groups, (able.digest == groups.digest) & (able.doc_id == groups["first"]) & (able.text_hash == groups.first_hash)).select("node", "n_shingles", "bands")
    banded = one.dropDuplicates(["node"]).select(F.col("node").alias("doc_id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    banded = written(banded, "bands")
    crowded = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = banded.join(crowded, "key")
    members = written(met, "met")
    score = members.groupBy("doc_id").agg(F.sum("c").alias("met"))
    members = written(with_hubs(members.join(score, "doc_id").select("key", "doc_id", "n", "met")), "members")
    asked = members.select(F.col("doc_id").alias("node")).distinct()
    sets = written(shingle_sets(documents, groups.join(asked, "node").select("node", "first", "digest")), "sets")
    hubs = written(hub_links(members, sets, min_percent), "links")
    found = connected(hubs, "hubs")
    # a hub has been compared with all its bucket
    rest = block_links(members.where("doc_id <> hub").select("key", "doc_id"), found, sets, min_percent)
    final = connected(hubs.unionByName(rest), "all")
    labelled = groups.join(final, groups["node"] == final.id, "left").select("digest", "first", "first_hash", F.coalesce("component", "node").alias("component"))
    heads = labelled.groupBy("component").agg(F.min(F.struct("first", "first_hash")).alias("head"))
    return rows, labelled.join(heads, "component").select("digest", F.col("head.first").alias("component_id"), F.col("head.first_hash").alias("keep_hash"))


def copy_groups(documents: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Null and empty texts, and texts of white space, have no shingle: linked with nothing, component their own id, kept. A
    null doc_id can't be linked: component null, kept. Repeated rows give repeated results. Rows of one doc_id with different
    texts each follow the links of their own text. Other columns are not read.
    """
    rows, component = components_of(documents, min_percent)
    linked = rows.where("doc_id IS NOT NULL AND n_shingles > 0").join(component, "digest").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_copies(documents: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """``documents``, all columns, with one row of each group: that of the least id, of several texts of that id the least by hash.

    Rows without a word and rows without an id stay. Rows equal in id and text are one.
    """
    rows, component = components_of(documents, min_percent)
    heads = component.select(F.col("component_id").alias("id"), F.col("keep_hash").alias("hash")).distinct()
    wordless = rows.where("n_shingles = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    named = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")).where("row.doc_id IS NOT NULL")
    keyed = named.select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("hash"))
    one = keyed.join(heads.unionByName(wordless).hint("merge"), ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    return one.select("row.*").unionByName(documents.where("doc_id IS NULL"))


def op3_near_copies(spark, sf_dir: str) -> DataFrame:
    """Component of every document under Jaccard similarity of at least 0.85 of five-word shingles."""
    return copy_groups(table(spark, sf_dir, "documents"))
