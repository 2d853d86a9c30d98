"""Mixing sources to target weights: blocks of words, multinomial draws per output shard, index permutations.

The words of a source's documents form one stream, cut into blocks of ``BLOCK`` words. The mix is a list of slots, each
holding one block. Output shards draw how many slots they take from each source: multinomial counts given that each source
ends at its target, which makes them multivariate hypergeometric. The shards are halved again and again and each half's
counts are drawn from those of the whole, so a task draws for its own shards alone and all draws add up. A source's slots
are numbered through the shards, and slot ``j`` holds block ``P(j)`` for a pseudorandom permutation ``P`` of the source's
block numbers (a Feistel network with cycle walking, so nothing is stored or shuffled to permute). Slots and blocks meet
in an equality join on (source, block).

Streams are laid out by prefix sums over hashed chunks: no task sees all rows of a source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlgauge.llm.common import WORD_PATTERN, mix64, prepared, table, written

BLOCK = 256
SLOTS_PER_SHARD = 256
ROWS_PER_CHUNK = 4_000
SHARDS_PER_TASK = 1024
#: numpy's bound for hypergeometric draws; beyond it the normal distribution, then within a ten-thousandth, stands in.
EXACT_DRAWS = 10**9
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2
#: Bound of the list of sources that the driver reads; more is an error, not a cut.
MAX_SOURCES = 100_000
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MAX_REPEATS) -> list[float]:
    """Wanted words of each source: by weight, at most ``most`` times its size, the excess shared anew by weight."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _round(side: np.ndarray, key: int, mask: int) -> np.ndarray:
    return mix64(side + np.uint64(key)) & np.uint64(mask)


def permuted(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Images of ``index`` under a pseudorandom permutation of 0..n-1, chosen by ``key``; vectorised, nothing stored."""
    bits = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
    mask, keys = (1 << bits) - 1, [int(k) for k in mix64(np.arange(1, 5, dtype=np.uint64) + np.uint64(key % (1 << 63)) * np.uint64(8))]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> np.uint64(bits), out[todo] & np.uint64(mask)
        for k in reversed(keys) if inverse else keys:
            if inverse:
                a, b = b ^ _round(a, k, mask), a
            else:
                a, b = b, a ^ _round(b, k, mask)
        out[todo] = (a << np.uint64(bits)) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def with_starts(rows: DataFrame, group: list[str], chunk: str, order: list[str], amount: str, name: str) -> DataFrame:
    """Running sum of ``amount`` before each row within ``group``, in two levels: over chunks, then inside a chunk."""
    inside = Window.partitionBy(*group, chunk).orderBy(*order)
    chunks = rows.groupBy(*group, chunk).agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(chunk)
    offsets = chunks.select(*group, chunk, (F.sum("__sum").over(before) - F.col("__sum")).alias("__before"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*group, chunk]]
    placed = rows.withColumn("__inside", F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount))
    joined = placed.alias("r").join(offsets.alias("o"), same)
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("r.__inside") + F.col("o.__before")).alias(name))


class Plan:
    """Per source: size, target, blocks, slots, the last slot's number and its word limit; from the sums of sizes."""

    def __init__(self, sizes: list[tuple[str | None, int]], block: int = BLOCK, seed: int = SEED):
        ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
        self.sources = [s for s, _ in ordered]
        self.sizes = [int(n) for _, n in ordered]
        self.block, self.seed = block, seed
        self.targets = targets(self.sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(ordered))])
        self.blocks = [-(-n // block) for n in self.sizes]
        self.slots, self.limits = [], []
        for i, (size, blocks) in enumerate(zip(self.sizes, self.blocks, strict=True)):
            want = min(round(self.targets[i]), MAX_REPEATS * size)
            rounds, rest = divmod(want, size) if size else (0, 0)
            slots, limit = 0, block
            if rest:
                short = int(permuted(np.array([blocks - 1]), blocks, self.key(i), inverse=True)[0])
                missing = blocks * block - size  # words that the short last block lacks
                reach = rest if rest <= short * block + block - missing else rest + missing
                slots = -(-reach // block)
                limit = reach - (slots - 1) * block
            self.slots.append(rounds * blocks + slots)
            self.limits.append(limit)

    def key(self, i: int) -> int:
        return self.seed * 1_000_003 + i

    @property
    def total(self) -> int:
        return sum(self.slots)


def sized(documents: DataFrame) -> DataFrame:
    """Narrow rows: doc_id, source, size, text_hash."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))


def plan_of(sizes: DataFrame, block: int = BLOCK, seed: int = SEED) -> tuple[Plan, dict[str | None, int]]:
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return Plan([(r["source"], r["size"]) for r in rows], block, seed), {r["source"]: r["n"] for r in rows}


def shared_out(counts: np.ndarray, n: int, draw: np.random.Generator) -> np.ndarray:
    """How many of each kind are among ``n`` drawn from ``counts`` without putting back."""
    if counts.sum() < EXACT_DRAWS:
        return draw.multivariate_hypergeometric(counts, n, method="marginals")
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        share = c / rest if rest else 0.0
        spread = math.sqrt(n * share * (1 - share) * (rest - n) / max(rest - 1, 1))
        rest -= c
        out[i] = min(max(round(draw.normal(n * share, spread)), n - rest, 0), c, n)
        n -= int(out[i])
    return out


def shard_draws(slots: list[int], per_shard: int, first: int, end: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, counts by source, slots of each source in the shards before) of the shards from ``first`` to before ``end``."""
    todo = [(0, -(-sum(slots) // per_shard), np.array(slots, np.int64), np.zeros(len(slots), np.int64))]
    while todo:
        lo, hi, counts, before = todo.pop()
        if hi <= first or lo >= end:
            continue
        if hi - lo == 1:
            yield lo, counts, before
            continue
        middle = (lo + hi) // 2
        left = shared_out(counts, (middle - lo) * per_shard, np.random.default_rng([seed, lo, hi]))
        todo += [(middle, hi, counts - left, before + left), (lo, middle, left, before)]


def drawn_slots(spark, plan: Plan, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """The mix slot by slot: shard, place (in the shard), rank (of the source), slot, block, words (that the slot takes of
    its block, at most). Every shard but the last has ``per_shard`` slots."""
    shards, slots, blocks, limits, block = -(-plan.total // per_shard), plan.slots, plan.blocks, plan.limits, plan.block
    keys, seed = [plan.key(i) for i in range(len(plan.sources))], plan.seed

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # ids of a partition are consecutive
            for shard, counts, before in shard_draws(slots, per_shard, int(frame["id"].min()), int(frame["id"].max()) + 1, seed) if len(frame) else ():
                rank = np.repeat(np.arange(len(counts)), counts)
                slot = np.arange(len(rank)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(before, counts)
                at = np.empty(len(rank), np.int64)
                for r in np.unique(rank):
                    at[rank == r] = permuted(slot[rank == r] % blocks[r], blocks[r], keys[r])
                most = np.where(slot == np.array(slots)[rank] - 1, np.array(limits)[rank], block)
                place = permuted(np.arange(len(rank)), len(rank), seed * 1_000_003 + shard)
                yield pd.DataFrame({"shard": shard, "place": place, "rank": rank.astype(np.int32), "slot": slot, "block": at, "words": most})

    return spark.range(0, shards, 1, max(1, shards // SHARDS_PER_TASK)).mapInPandas(lay, "shard long, place long, rank int, slot long, block long, words long")


def taken_parts(sizes: DataFrame, plan: Plan, n_rows: dict[str | None, int], per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """One row per document row and block of it: the document's columns, rank, start (in its source's stream),
    lo, hi (its words there, from 0), and shard, place, slot and upto (words up to which the slot takes it), null if not taken."""
    spark, block = sizes.sparkSession, plan.block
    chunks = [max(1, math.ceil(n_rows.get(s, 0) / ROWS_PER_CHUNK)) for s in plan.sources]
    ranks = spark.createDataFrame([(s, i, c) for i, (s, c) in enumerate(zip(plan.sources, chunks, strict=True))], "source string, rank int, chunks long")
    ranked = sizes.alias("s").join(F.broadcast(ranks).alias("k"), F.col("s.source").eqNullSafe(F.col("k.source"))).select("s.doc_id", "s.size", "s.text_hash", "k.rank", "k.chunks")
    filled = ranked.where("size > 0").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("chunks"))).drop("chunks")
    placed = with_starts(filled, ["rank"], "chunk", ["doc_id", "text_hash"], "size", "start").drop("chunk")
    parts = placed.select(
        "*", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block")
    ).select(
        "doc_id", "size", "text_hash", "rank", "start", "block",
        F.greatest(F.lit(0), F.col("start") - F.col("block") * block).alias("lo"),
        F.least(F.lit(block), F.col("start") + F.col("size") - F.col("block") * block).alias("hi"),
    )
    slots = drawn_slots(spark, plan, per_shard).alias("t")
    joined = parts.alias("p").join(slots, (F.col("p.rank") == F.col("t.rank")) & (F.col("p.block") == F.col("t.block")), "left")
    return joined.select("p.*", "t.shard", "t.place", "t.slot", F.when(F.col("t.slot").isNotNull(), F.least("p.hi", "t.words")).alias("upto"))


def mix_sizes(documents: DataFrame, block: int = BLOCK, seed: int = SEED, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """Words that the mix takes of each row: doc_id, size, source_size, target, taken, source.

    Null and empty texts have size 0 and are not taken. A null source is a source of its own, last in order. Repeated
    rows are separate documents, each at most twice its size. An empty table gives no rows. Other columns are not read.
    """
    spark = prepared(documents.sparkSession)
    sizes = written(sized(documents), "sizes")
    plan, n_rows = plan_of(sizes, block, seed)
    parts = taken_parts(sizes, plan, n_rows, per_shard)
    taken = parts.groupBy("rank", "start").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum(F.greatest(F.lit(0), F.coalesce(F.col("upto") - F.col("lo"), F.lit(0)))).cast("long").alias("taken")
    )
    about = spark.createDataFrame(list(zip(range(len(plan.sources)), plan.sources, plan.sizes, plan.targets, strict=True)), "rank int, source string, source_size long, target double")
    rows = taken.join(F.broadcast(about), "rank").select("doc_id", "size", "source_size", "target", "taken", "source")
    empty = sizes.where("size = 0").alias("s").join(F.broadcast(about).alias("a"), F.col("s.source").eqNullSafe(F.col("a.source"))).select("s.doc_id", "s.size", "a.source_size", "a.target", F.lit(0).cast("long").alias("taken"), "s.source")
    return rows.unionByName(empty)


def _taken_runs(documents: DataFrame, block: int, seed: int, per_shard: int) -> tuple[DataFrame, DataFrame]:
    """One row for each distinct (doc_id, source, text): row and its runs (shard, place, time, a, b); and the sources.

    Rows equal in all three are one after another in their source, so they are laid out as one document of as many
    times its words, and a run's words count through all of them.
    """
    prepared(documents.sparkSession)
    key = ["doc_id", "source", "text_hash"]
    sizes = written(sized(documents), "sizes")
    distinct = sizes.groupBy(*key).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    repeated = not distinct.where("n > 1").isEmpty()
    single = distinct.drop("n") if repeated else sizes
    plan, n_rows = plan_of(single, block, seed)
    names = documents.sparkSession.createDataFrame(list(zip(range(len(plan.sources)), plan.sources, plan.blocks, strict=True)), "rank int, source string, blocks long")
    runs = (
        taken_parts(single, plan, n_rows, per_shard)
        .where("upto > lo")
        .join(F.broadcast(names), "rank")
        .withColumn("base", F.col("block") * block - F.col("start"))
        .select(*key, F.struct("shard", "place", F.expr("cast(slot div blocks as int)").alias("time"), (F.col("base") + F.col("lo")).alias("a"), (F.col("base") + F.col("upto")).alias("b"), "lo").alias("run"))
        .groupBy(*key)
        .agg(F.collect_list("run").alias("runs"))
    )
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    whole = whole.select("row", F.col("row.doc_id").cast("long").alias("id"), F.col("row.source").cast("string").alias("of"), F.xxhash64("row.text").alias("hash"))
    if repeated:
        whole = whole.dropDuplicates(["id", "of", "hash"])
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("of").eqNullSafe(F.col("source")) & (F.col("hash") == F.col("text_hash"))
    return whole.join(runs, same).select("row", "runs"), names


def _pieces(text: str, runs: list[dict]) -> Iterator[tuple[dict, int, int, int, tuple[int, int]]]:
    """(run, copy, first word, end word, characters) of each run's part in each copy of the text."""
    spans = [m.span() for m in regex.finditer(WORD_PATTERN, text)]
    n = len(spans)
    for run in runs:
        a = run["a"]
        while a < run["b"]:
            copy = a // n
            b = min(run["b"], (copy + 1) * n)
            yield run, copy, a - copy * n, b - copy * n, (spans[a - copy * n][0], spans[b - copy * n - 1][1])
            a = b


def mixed_documents(documents: DataFrame, block: int = BLOCK, seed: int = SEED, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """The mix as rows of ``documents``: each row's taken words, one row for each time round its source.

    Words next to each other keep the text between them; separate runs are joined by a line break. Rows of which nothing
    is taken are absent. n_chars, where there is such a column, is that of the new text; other columns stay, those of rows
    equal in doc_id, source and text from one of them.
    """
    rows, _ = _taken_runs(documents, block, seed, per_shard)
    names_out = documents.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.RecordBatch.from_struct_array(batch.column("row"))
            picked, texts = [], []
            for i, (text, runs) in enumerate(zip(whole.column(names_out.index("text")).to_pylist(), batch.column("runs").to_pylist(), strict=True)):
                found: dict[tuple[int, int], list[list]] = {}
                for run, copy, a, b, (first, end) in sorted(_pieces(text, runs), key=lambda p: (p[1], p[0]["time"], p[2])):
                    merged = found.setdefault((copy, run["time"]), [])
                    if merged and merged[-1][0] == a:
                        merged[-1][0], merged[-1][2] = b, end
                    else:
                        merged.append([b, first, end])
                for merged in found.values():
                    picked.append(i)
                    texts.append("\n".join(text[first:end] for _, first, end in merged))
            out = whole.take(pa.array(picked, pa.int64()))
            columns = list(out.columns)
            columns[names_out.index("text")] = pa.array(texts, out.schema.field("text").type)
            if "n_chars" in names_out:
                columns[names_out.index("n_chars")] = pa.array(map(len, texts), out.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, schema=out.schema)

    return rows.mapInArrow(cut, documents.schema)


def mixed_slots(documents: DataFrame, block: int = BLOCK, seed: int = SEED, per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """The mix as the shards hold it: shard, place, source, n_words and text of each slot; documents of a block joined by a line break."""
    rows, _ = _taken_runs(documents.select("doc_id", "source", "text"), block, seed, per_shard)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "place", "source", "at", "n_words", "text"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row, runs in zip(batch.column("row").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                n = len(regex.findall(WORD_PATTERN, row["text"]))
                for run, copy, a, b, (first, end) in _pieces(row["text"], runs):
                    at = run["lo"] + copy * n + a - run["a"]
                    for column, value in zip(out, (run["shard"], run["place"], row["source"], at, b - a, row["text"][first:end]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    parts = rows.mapInArrow(cut, "shard long, place long, source string, at long, n_words long, text string")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n")
    return parts.groupBy("shard", "place").agg(F.first("source").alias("source"), F.sum("n_words").alias("n_words"), joined.alias("text"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix_sizes(table(spark, sf_dir, "documents"))
