"""Approximate nearest neighbours by an adaptive dimension scan over probed lists.

Largest inner product is turned into least distance by one more dimension (``sqrt(M^2 - |x|^2)``, 0 for queries, ``M`` the
greatest length). Vectors are rotated by a random orthogonal matrix and put into lists by their nearest centre. A
query scans its nearest lists: first a few of them whole, which gives a distance that its k-th neighbour can't exceed,
then the others in column blocks. After each block a test compares the distance so far, scaled to all dimensions, with
that bound, and abandons candidates that would exceed it but for a small chance; distances of all dimensions are exact.
The scores returned are exact inner products of the original vectors.

Centres, and the number of lists to probe, come from a bounded sample (``SAMPLE`` vectors, ``TRIALS`` of them as queries
against brute force within the sample). All vectors are indexed. Lists, and the queries that probe them, are split into
chunks of bounded size, so a list with a third of all vectors is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlgauge.llm.common import by_hash, prepared, table, written

NEIGHBOURS = 20
QUERY_EVERY = 20
SAMPLE = 8192
TRIALS = 400
SAMPLE_RECALL = 0.97
MAX_LISTS = 1024
#: Lists that a query scans whole before the others.
WHOLE = 2
COLUMNS = 16
#: Standard deviations of the test that abandons a candidate.
CAUTION = 2.5
VECTORS_PER_CHUNK, QUERIES_PER_CHUNK = 2000, 4000
SEED = 5


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of vectors that take part.

    Left out: null ids, null, empty or zero vectors, null or non-finite components, and vectors of another length than
    most (of equally frequent lengths the least). Of repeated ids the least vector stays. Other columns are not read.
    """
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    rows = written(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    usual = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    return rows.where(F.size("embedding") == (usual[0]["size"] if usual else -1))


class Index:
    """Length bound, rotation, centres and probes; fitted on a sample, small whatever the size of the table."""

    def __init__(self, sample: np.ndarray, greatest: float, total: int, k: int = NEIGHBOURS):
        self.greatest, self.dimensions, self.k = greatest, sample.shape[1] + 1, k
        draw = np.random.default_rng(SEED)
        q, r = np.linalg.qr(draw.normal(size=(self.dimensions, self.dimensions)))
        self.rotation = q * np.sign(np.diag(r))
        lists = max(1, min(MAX_LISTS, int(math.sqrt(total) / 2), len(sample) // 8 or 1))
        x = self.lifted(sample)
        self.centres = x[draw.choice(len(x), lists, replace=False)].copy()
        for _ in range(12):
            own = self.order(x)[:, 0]
            n = np.bincount(own, minlength=lists)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, x)
            self.centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.centres)
        self.probes = self._probes(sample, x)

    def lifted(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors with the added dimension."""
        more = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0, self.greatest**2 - (vectors**2).sum(1)))
        return np.hstack([vectors, more[:, None]]) @ self.rotation

    def order(self, lifted: np.ndarray) -> np.ndarray:
        """Lists by the distance of their centres."""
        return np.argsort((self.centres**2).sum(1)[None] - 2 * lifted @ self.centres.T, axis=1, kind="stable")

    def _probes(self, sample: np.ndarray, x: np.ndarray) -> int:
        lists, n = len(self.centres), len(sample)
        if n <= self.k + 1 or lists == 1:
            return lists
        some = sample[:: max(1, n // TRIALS)]
        score = some @ sample.T
        score[np.arange(len(some)), np.arange(0, n, max(1, n // TRIALS))] = -np.inf
        best = np.argpartition(-score, self.k, axis=1)[:, : self.k]
        order = self.order(self.lifted(some, query=True))
        rank = np.empty_like(order)
        rank[np.arange(len(some))[:, None], order] = np.arange(lists)
        need = rank[np.arange(len(some))[:, None], self.order(x)[:, 0][best]]
        return int(np.sort(need.ravel())[math.ceil(SAMPLE_RECALL * need.size) - 1]) + 1


def fitted(vectors: DataFrame, k: int = NEIGHBOURS) -> Index | None:
    about = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("aggregate(embedding, 0D, (s, x) -> s + x * x)")).alias("most")).first()
    if not about["n"]:
        return None
    rows = vectors.where(by_hash("vec_id", SAMPLE, about["n"])).collect()
    if len(rows) < 2:  # a tiny table may leave the hash without a row
        rows = vectors.limit(SAMPLE).collect()
    rows.sort(key=lambda r: r["vec_id"])
    return Index(np.array([r["embedding"] for r in rows], float), math.sqrt(about["most"]), about["n"], k)


def scan(query: np.ndarray, blocks: list[np.ndarray], bound: float, caution: float = CAUTION) -> np.ndarray:
    """Candidates (rows of the column ``blocks``) whose squared distance does not exceed ``bound``, tested block by block."""
    total = sum(b.shape[1] for b in blocks)
    left = np.arange(len(blocks[0]))
    so_far, seen = np.zeros(len(left)), 0
    for block in blocks:
        part = block if len(left) == len(block) else block[left]
        gap = part - query[seen : seen + block.shape[1]]
        so_far = so_far + np.einsum("ij,ij->i", gap, gap)
        seen += block.shape[1]
        # spread of the scaled distance when ``seen`` of ``total`` rotated dimensions are known
        slack = 1 + caution * math.sqrt((1 - seen / total) / seen)
        near = so_far * (total / seen) <= bound * slack * slack * (1 + 1e-9)
        left, so_far = left[near], so_far[near]
        if not len(left):
            break
    return left


def best_of(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best, ties to the smaller id."""
    other = ids != own
    vectors, ids = vectors[other], ids[other]
    score = (vectors * query).sum(axis=1)
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


RESULT = "query_id long, vec_id long, score double"


def nearest(embeddings: DataFrame, k: int = NEIGHBOURS, every: int = QUERY_EVERY, index: Index | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found. Queries are rows with an id divisible by ``every``.

    No usable vector: no rows. Fewer than ``k`` candidates: all of them.
    """
    spark = prepared(embeddings.sparkSession)
    vectors = usable(embeddings)
    index = index or fitted(vectors, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("embedding").to_pylist(), float).reshape(batch.num_rows, index.dimensions - 1)
            lists = index.order(index.lifted(x))[:, 0] if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(lists, pa.int32())], ["vec_id", "embedding", "list"])

    placed = written(vectors.mapInArrow(place, "vec_id long, embedding array<double>, list int"), "placed")
    sizes = np.zeros(len(index.centres), np.int64)
    for row in placed.groupBy("list").count().collect():  # one row a list
        sizes[row["list"]] = row["count"]
    chunks = [max(1, math.ceil(n / VECTORS_PER_CHUNK)) for n in sizes.tolist()]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("embedding").to_pylist(), float).reshape(batch.num_rows, index.dimensions - 1)
            order = index.order(index.lifted(x, query=True))
            # few vectors in the nearest lists: go on until there are enough
            enough = np.maximum(index.probes, 1 + (np.cumsum(sizes[order], axis=1) < k + 1).sum(1)) if len(x) else []
            out = [(i, int(p), step) for i, n in enumerate(enough) for step, p in enumerate(order[i, :n].tolist())]
            row, lists, step = (np.array([o[j] for o in out], np.int64) for j in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(row)), pa.array(lists, pa.int32()), pa.array(step, pa.int32())], ["query_id", "list", "step"])

    queries = placed.where(F.pmod("vec_id", F.lit(every)) == 0)
    probes = written(queries.select("vec_id", "embedding").mapInArrow(probe, "query_id long, list int, step int"), "probes")
    crowd = np.ones(len(sizes), np.int64)
    for row in probes.groupBy("list").count().collect():
        crowd[row["list"]] = max(1, math.ceil(row["count"] / QUERIES_PER_CHUNK))
    pieces = spark.createDataFrame([(i, int(c), int(q)) for i, (c, q) in enumerate(zip(chunks, crowd, strict=True))], "list int, parts long, crowds long")

    def candidates(rows: DataFrame) -> DataFrame:
        """Vectors of each list in chunks, once for each chunk of queries."""
        return (
            rows.join(F.broadcast(pieces), "list")
            .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
            .withColumn("crowd", F.explode(F.sequence(F.lit(0).cast("long"), F.col("crowds") - 1)))
            .select("list", "part", "crowd", "vec_id", "embedding")
        )

    def asked(rows: DataFrame) -> DataFrame:
        """Queries that probe each list, in chunks, once for each chunk of vectors."""
        return (
            rows.join(F.broadcast(pieces), "list")
            .withColumn("crowd", F.pmod(F.xxhash64("query_id"), F.col("crowds")))
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .drop("parts", "crowds")
        )

    def whole(key: tuple, have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        return answers(have, ask, None)

    def tested(key: tuple, have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        return answers(have, ask, ask["bound"].to_numpy())

    def answers(have: pd.DataFrame, ask: pd.DataFrame, bounds: np.ndarray | None) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(have) and len(ask):
            have = have.sort_values("vec_id", kind="stable")
            x, ids = np.stack(have["embedding"].to_numpy()), have["vec_id"].to_numpy()
            q, own = np.stack(ask["asked"].to_numpy()), ask["query_id"].to_numpy()
            if bounds is not None:
                turned = index.lifted(x)
                blocks = [np.ascontiguousarray(turned[:, i : i + COLUMNS]) for i in range(0, index.dimensions, COLUMNS)]
                asking = index.lifted(q, query=True)
            for i in range(len(q)):
                if bounds is None:
                    got, score = best_of(q[i], x, ids, own[i], k)
                else:
                    left = scan(asking[i], blocks, bounds[i])
                    got, score = best_of(q[i], x[left], ids[left], own[i], k)
                found.append((np.full(len(got), own[i]), got, score))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    vector_of = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    cell = ["list", "part", "crowd"]
    first = asked(probes.where(F.col("step") < WHOLE).join(vector_of, "query_id"))
    begun = candidates(placed).groupBy(*cell).cogroup(first.groupBy(*cell)).applyInPandas(whole, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    begun = written(begun.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "begun")
    # squared lifted distance at the k-th score so far: |q|^2 + M^2 - 2 * score
    kth = begun.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    length = F.expr("aggregate(asked, 0D, (s, x) -> s + x * x)")
    bounded = vector_of.join(kth, "query_id", "left").select(
        "query_id", "asked", F.when(F.col("kth").isNull(), float("inf")).otherwise(length + index.greatest**2 - 2 * F.col("kth")).alias("bound")
    )
    second = asked(probes.where(F.col("step") >= WHOLE).join(bounded, "query_id"))
    later = candidates(placed).groupBy(*cell).cogroup(second.groupBy(*cell)).applyInPandas(tested, RESULT)
    everything = begun.select("query_id", "vec_id", "score").unionByName(later)
    return everything.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_dimension_scan(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, against all vectors."""
    return nearest(table(spark, sf_dir, "embeddings"))
