"""Merkle manifest of a data set with a witness for every document.

Each source is a tree over its documents in order of doc_id, and the sources' roots are leaves of one more tree. A node
is the hash of up to 16 consecutive nodes below it.

Trees grow by aligned appends. ``OpenSubtrees`` takes nodes one after another and keeps, of each level, only the run that
is not full yet. When a run is complete, the witnesses of the nodes below it are extended by their siblings, and the
run's hash is appended to the level above. Documents are ranked within their source by a range sort and prefix sums, and
dealt out in aligned blocks of ``BLOCK`` nodes, a whole number of levels. A task appends one block at a time; the blocks'
roots are nodes of further appends, until each tree has one root. The witnesses then go back the same way: what a block's
root got by later appends extends the witnesses within the block. So a hot source is as many blocks as it needs, and
nothing grows in one task but a block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlgauge.llm.common import prepared, table, written

FAN = 16
LEVELS_OF_BLOCK = 3
BLOCK = FAN**LEVELS_OF_BLOCK
ROWS_PER_PART = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def combined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode("ascii")).hexdigest()


class OpenSubtrees:
    """A tree under aligned appends: by level the nodes of the run that is still open, each with the appended nodes below it."""

    def __init__(self, fan: int = FAN, witnesses: bool = True):
        self.fan, self.open, self.n = fan, [[]], 0
        self.witnesses: list[list[tuple[str, str]]] | None = [] if witnesses else None

    def append(self, digest: str) -> None:
        if self.witnesses is not None:
            self.witnesses.append([])
        self._add(0, digest, self.n, self.n + 1)
        self.n += 1

    def _add(self, level: int, digest: str, first: int, end: int) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((digest, first, end))
        if len(self.open[level]) == self.fan:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """Close the run of a level: its siblings extend the witnesses below, its hash is a node of the level above."""
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        if self.witnesses is not None:
            for k, (_, first, end) in enumerate(run):
                step = "".join(digests[:k]), "".join(digests[k + 1 :])
                for i in range(first, end):
                    self.witnesses[i].append(step)
        self._add(level + 1, combined(digests), run[0][1], run[-1][2])

    def finish(self, levels: int | None = None) -> str:
        """Close what is open and return the root: at exactly ``levels`` levels, or as soon as one node is left."""
        level = 0
        while level < levels if levels is not None else len(self.open[level]) > 1 or any(self.open[level + 1 :]):
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with rank (from 0) and total within ``group``, by ``order``; null first.

    A range sort deals out all rows evenly, whatever the groups; ranks are places in a part plus the rows of the group in
    the parts before. Only one row for each part and group meets in a window.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    parts = max(1, math.ceil(rows.count() / ROWS_PER_PART))
    placed = written(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select(F.col(group).alias("g"), F.col("part").alias("p"), (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total"))
    joined = placed.join(starts, F.col(group).eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return joined.select(*rows.columns, (F.col("at") + F.col("shift")).alias("rank"), "total")


BLOCK_SCHEMA = "tree long, block long, blocks long, root string, members array<string>, carried array<string>, ids array<long>"
PATH_SCHEMA = "tree long, rank long, digest string, subroot string, root string, lefts array<string>, rights array<string>"
STRINGS = pa.list_(pa.string())


def blocks_of(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes (tree, rank, total, digest, carried, id) appended block by block: one row for each block with its root."""
    levels = round(math.log(block, FAN))

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: tuple, members: list, carried: list, ids: list) -> pa.RecordBatch:
            tree = OpenSubtrees(witnesses=False)
            for digest in members:
                tree.append(digest)
            root = tree.finish(levels if key[2] > 1 else None)
            arrays = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64()), pa.array([root]), pa.array([members], STRINGS), pa.array([carried], STRINGS), pa.array([ids], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, ["tree", "block", "blocks", "root", "members", "carried", "ids"])

        now, members, carried, ids = None, [], [], []
        for batch in batches:
            for tree, number, blocks, digest, payload, id_ in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "blocks", "digest", "carried", "id")), strict=True):
                if (tree, number, blocks) != now:
                    if now is not None:
                        yield row(now, members, carried, ids)
                    now, members, carried, ids = (tree, number, blocks), [], [], []
                members.append(digest)
                carried.append(payload)
                ids.append(id_)
        if now is not None:
            yield row(now, members, carried, ids)

    dealt = nodes.select("tree", F.expr(f"rank div {block}").alias("block"), F.expr(f"(total + {block - 1}) div {block}").alias("blocks"), "rank", "digest", "carried", "id")
    return dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank").drop("rank").mapInArrow(append, BLOCK_SCHEMA)


def climb(nodes: DataFrame, name: str, block: int = BLOCK) -> list[DataFrame]:
    """Written tables of blocks from the nodes up: each level's roots are the nodes of the next, until every tree has one."""
    levels = []
    while True:
        levels.append(written(blocks_of(nodes, block), f"{name}-{len(levels)}"))
        more = levels[-1].where("blocks > 1")
        if more.isEmpty():
            return levels
        nodes = more.select("tree", F.col("block").alias("rank"), F.col("blocks").alias("total"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("carried"), F.lit(None).cast("long").alias("id"))


def extended(blocks: DataFrame, paths: DataFrame, block: int, leaves: bool) -> DataFrame:
    """Witness of every node of ``blocks``: the one within its block, then that of the block's root in ``paths``."""
    levels = round(math.log(block, FAN))
    names = ["tree", "rank", "digest", "subroot", "root", "lefts", "rights"] + ["carried", "id"] * leaves
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), STRINGS, STRINGS] + [pa.string(), pa.int64()] * leaves

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                tree = OpenSubtrees()
                for digest in r["members"]:
                    tree.append(digest)
                tree.finish(levels if r["blocks"] > 1 else None)
                n = len(r["members"])
                columns = [
                    [r["tree"]] * n, [r["block"] * block + i for i in range(n)], r["members"], [r["subroot"]] * n, [r["root"]] * n,
                    [[a for a, _ in w] + r["lefts"] for w in tree.witnesses], [[b for _, b in w] + r["rights"] for w in tree.witnesses],
                ]
                if leaves:
                    columns += [r["carried"], r["ids"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    own = blocks.select("tree", "block", "blocks", "members", *["carried", "ids"] * leaves)
    joined = own.join(paths.select("tree", F.col("rank").alias("block"), "subroot", "root", "lefts", "rights"), ["tree", "block"])
    return joined.mapInArrow(extend, PATH_SCHEMA + ", carried string, id long" * leaves)


def descend(levels: list[DataFrame], tops: DataFrame, name: str, block: int = BLOCK) -> DataFrame:
    """Witnesses of the nodes that ``climb`` began with; ``tops`` holds those of the trees' roots, at rank 0."""
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        here = tops.join(levels[k].where("blocks = 1").select("tree"), "tree", "left_semi").select(*tops.columns)
        paths = here if paths is None else here.unionByName(paths.select(*tops.columns))
        paths = extended(levels[k], paths, block, leaves=k == 0)
        if k:
            paths = written(paths, f"{name}-paths-{k}")
    return paths


def leaf_of(text: Column, others: dict[str, Column]) -> Column:
    """Hash of a document's fields: for each ``-`` if null, else its bytes in UTF-8, ``:`` and the value."""
    values = [text if c == "text" else others[c] for c in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def leaves_of(documents: DataFrame) -> DataFrame:
    """doc_id, source, leaf and presented of every row; presented is the leaf after tampering, where 5 divides the CRC of the id.

    Tampering lower-cases A-Z of the text, so the leaf of a text without these, or of a null text, stays as it is. A null
    doc_id has no CRC and is not tampered with.
    """
    others = {c: F.col(c).cast("long").cast("string") if c in ("doc_id", "n_chars") else F.col(c).cast("string") for c in FIELDS}
    tampered = F.crc32(others["doc_id"].cast("binary")) % 5 == 0
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        others["source"].alias("source"),
        leaf_of(others["text"], others).alias("leaf"),
        F.when(tampered, leaf_of(F.translate(others["text"], UPPER, LOWER), others)).alias("changed"),
    ).select("doc_id", "source", "leaf", F.coalesce("changed", "leaf").alias("presented"))


def witnesses(leaves: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, source, leaf, presented) with their tree's subroot, the root, and their witness: lefts and rights.

    A witness holds for each level, from the leaf's run to the root, the digests left and right of the node in its run.
    ``presented`` is carried along unread. Within a source leaves ascend by doc_id, null first, then by digest, so
    repeated rows are leaves of their own, next to each other; a null source is a tree of its own, first in order. No
    rows give no rows. Texts play no part here.
    """
    prepared(leaves.sparkSession)
    placed = written(ranked(leaves.select("doc_id", "source", "leaf", "presented"), "source", ["doc_id", "leaf", "presented"]), "ranked-leaves")
    sources = placed.groupBy("source").agg(F.max("total").alias("size")).withColumn("forest", F.lit(0).cast("long"))
    numbers = written(ranked(sources, "forest", ["source"]).select("source", F.col("rank").alias("tree"), F.col("total").alias("trees")), "sources")
    numbered = placed.join(numbers.alias("n"), placed["source"].eqNullSafe(F.col("n.source")))
    levels = climb(numbered.select("n.tree", "rank", "total", F.col("leaf").alias("digest"), F.col("presented").alias("carried"), F.col("doc_id").alias("id")), "blocks", block)

    # the sources' roots are the leaves of one more tree
    subroots = None
    for level in levels:
        tops = level.where("blocks = 1").select("tree", F.col("root").alias("digest"))
        subroots = tops if subroots is None else subroots.unionByName(tops)
    forest = subroots.join(numbers, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("trees").alias("total"), "digest", F.lit(None).cast("string").alias("carried"), F.lit(None).cast("long").alias("id"))
    above = climb(forest, "forest", block)
    nothing = F.array().cast("array<string>")
    start = above[-1].select("tree", F.lit(0).cast("long").alias("rank"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("subroot"), "root", nothing.alias("lefts"), nothing.alias("rights"))
    of_sources = descend(above, start, "forest", block)
    tops = written(of_sources.select(F.col("rank").alias("tree"), F.lit(0).cast("long").alias("rank"), "digest", F.col("digest").alias("subroot"), "root", "lefts", "rights"), "source-paths")

    found = descend(levels, tops, "blocks", block).alias("w")
    names = numbers.select(F.col("tree").alias("number"), "source")
    return found.join(names, F.col("w.tree") == F.col("number")).select(F.col("w.id").alias("doc_id"), "source", F.col("w.digest").alias("leaf"), F.col("w.carried").alias("presented"), "w.subroot", "w.root", "w.lefts", "w.rights")


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """Root that a leaf and its witness give."""
    return F.aggregate(F.zip_with(lefts, rights, lambda a, b: F.struct(a.alias("l"), b.alias("r"))), leaf, lambda node, step: F.sha2(F.concat(step["l"], node, step["r"]), 256))


def manifest(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``documents``.

    proof_sha256 is the hash of all siblings of the witness; folded_root is what the presented leaf gives with it, and
    verified whether that is the root. Columns other than the hashed ones are not read; an empty table gives no rows.
    """
    found = witnesses(written(leaves_of(documents), "leaves"), block)
    siblings = F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), "")
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("presented"), F.col("lefts"), F.col("rights")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and checked witness of all documents."""
    prepared(spark)
    return manifest(table(spark, sf_dir, "documents"))


def _sql(document_levels: int = 6, source_levels: int = 4) -> str:
    """The same tree level by level: 16**levels leaves at most, far beyond the tables that the SQL runs on."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
    parts = " || ".join(field.format(c) for c in FIELDS[:-1])
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    # CRC-32 of the id, bit by bit
    crc = (
        "xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [1000 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0])), "
        "lambda a, b: CASE WHEN b >= 1000 THEN xor(a, b - 1000) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295), 4294967295)"
    )
    steps = [f"""
leaves AS (
    SELECT doc_id, source, sha256({parts} || {field.format("text")}) AS leaf,
        CASE WHEN {crc} % 5 = 0 THEN sha256({parts} || {field.format(lowered)}) ELSE sha256({parts} || {field.format("text")}) END AS presented
    FROM documents
),
doc0 AS (
    SELECT *, leaf AS digest, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, presented) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
        presented AS fold, '' AS proof, row_number() OVER () AS k
    FROM leaves
)"""]

    def level(kind: str, k: int, by: str) -> str:
        return f"""
{kind}_run{k} AS (SELECT {by}, pos // 16 AS run, list(digest ORDER BY pos) AS run_digests FROM (SELECT DISTINCT {by}, pos, digest FROM {kind}{k}) GROUP BY {by}, pos // 16),
{kind}{k + 1} AS (
    SELECT t.* EXCLUDE (digest, pos, n, fold, proof),
        CASE WHEN n > 1 THEN sha256(array_to_string(run_digests, '')) ELSE digest END AS digest, pos // 16 AS pos, (n + 15) // 16 AS n,
        CASE WHEN n > 1 THEN sha256(array_to_string(run_digests[:pos % 16], '') || fold || array_to_string(run_digests[pos % 16 + 2:], '')) ELSE fold END AS fold,
        CASE WHEN n > 1 THEN proof || array_to_string(run_digests[:pos % 16], '') || array_to_string(run_digests[pos % 16 + 2:], '') ELSE proof END AS proof
    FROM {kind}{k} t JOIN {kind}_run{k} r ON t.{by} IS NOT DISTINCT FROM r.{by} AND t.pos // 16 = r.run
)"""

    steps += [level("doc", k, "source") for k in range(document_levels)]
    steps.append(f"""
src0 AS (
    SELECT *, 0 AS forest, digest AS subroot FROM (SELECT * EXCLUDE (pos, n) FROM doc{document_levels})
    JOIN (SELECT source AS s, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM leaves)) ON source IS NOT DISTINCT FROM s
)""")
    steps += [level("src", k, "forest") for k in range(source_levels)]
    return "WITH" + ",".join(steps) + f"\nSELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = digest AS verified FROM src{source_levels}\n"


OP12_SQL = _sql()
