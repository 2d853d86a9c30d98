"""Topic clusters: greedy leaders over shared keywords, computed without forming article pairs.

In article order, an article that no earlier leader has taken becomes a leader and takes every later article that is
similar to it. Two articles are similar when their keyword sets share ``min_shared`` keywords or reach a Jaccard
index of ``threshold``; for sets of sizes a and b that is the same as sharing at least ``need(a, b)`` keywords.

Articles only ever have to be compared with leaders, and leaders are unlike each other, so few of them share a keyword.
The first ``block`` open articles of each site are decided one after another in one task. Their leaders then take from
all later articles of the site, in one similarity join: keywords are ordered from the rarest of the site on, similar sets
share one within the first ``size - need + 1`` of both, and only those prefixes meet; size and position say at once whether
enough keywords can follow, and what is left is verified on the whole sets. Each turn decides a block of every site and
all that is similar to it, so a chain of similar articles takes as many turns as it has blocks.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import each
from ..session import written_folder, written_table
from .skew import top_per_group

DOC = ["site", "doc"]
#: Open articles of a site that one task decides in one turn; a row holds their ``top_k`` keywords.
BLOCK = 20_000


def needed_overlap(a: int, b: int, threshold: float, min_shared: int) -> int | None:
    """Smallest number of shared keywords that makes sets of sizes a and b similar; NULL when they cannot be."""
    for shared in range(1, min(a, b) + 1):
        if shared >= min_shared or shared / (a + b - shared) >= threshold:
            return shared
    return None


def term_sets(keyword_table: DataFrame, top_k: int) -> DataFrame:
    """(site, doc, size, terms): each article's distinct best ``top_k`` keywords, the rarest of the site first."""
    targets = keyword_table.where(F.col("rank") <= top_k).select(*DOC, "term").distinct()
    rarity = targets.groupBy("site", "term").agg(F.count("*").alias("df"))
    ordered = targets.join(rarity, ["site", "term"]).groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("t"))
    return ordered.select(*DOC, F.size("t").alias("size"), F.col("t.term").alias("terms"))


def _needed(a: Column, b: Column, threshold: float, min_shared: int) -> Column:
    """``needed_overlap`` of two sizes: the least number of shared keywords; beyond both sizes it can't be reached."""
    # shared / (a + b - shared) >= threshold, a little less strict than that; pairs are verified afterwards
    by_share = F.ceil(F.lit(threshold) * (a + b) / (1 + threshold) - 1e-9)
    return F.greatest(F.least(by_share, F.lit(min_shared)), F.lit(1))


def _prefixes(sets: DataFrame, top_k: int, threshold: float, min_shared: int, doc: str) -> DataFrame:
    """(site, term, doc, size, pos): the keywords of each set by which a similar one of any size can meet it.

    Fewest keywords are needed for the smallest partner that can reach them; the prefix for it holds all others.
    """
    least = F.array_min(F.array(*[F.when(_needed(F.col("size"), F.lit(b), threshold, min_shared) <= F.least(F.col("size"), F.lit(b)), _needed(F.col("size"), F.lit(b), threshold, min_shared)) for b in range(1, top_k + 1)]))
    cut = sets.withColumn("least", least).where("least IS NOT NULL")
    prefix = F.slice("terms", F.lit(1), F.col("size") - F.col("least") + 1)
    return each(cut, ["site", F.col("doc").alias(doc), F.col("size").alias(f"{doc}_size")], prefix, "term", f"{doc}_pos")


def candidates(sets: DataFrame, leaders: DataFrame, top_k: int, threshold: float, min_shared: int) -> DataFrame:
    """(site, doc, leader): pairs that share a prefix keyword at places behind which enough keywords can follow."""
    left = _prefixes(sets, top_k, threshold, min_shared, "doc")
    right = _prefixes(leaders, top_k, threshold, min_shared, "leader")
    need = _needed(F.col("doc_size"), F.col("leader_size"), threshold, min_shared)
    # positions of the first keyword that both have; a later common one says less and is tried as well
    left_of = F.least(F.col("doc_size") - F.col("doc_pos"), F.col("leader_size") - F.col("leader_pos"))
    in_both = (F.col("doc_pos") <= F.col("doc_size") - need) & (F.col("leader_pos") <= F.col("leader_size") - need)
    met = left.join(right, ["site", "term"]).where((need <= F.least("doc_size", "leader_size")) & in_both & (left_of >= 1))
    return met.select("site", "doc", "leader").distinct()


def _taken(sets: DataFrame, leaders: DataFrame, top_k: int, threshold: float, min_shared: int) -> DataFrame:
    """(site, doc, leader): articles of ``sets`` that a leader takes, with the first that does; verified on whole sets."""
    met = candidates(sets, leaders, top_k, threshold, min_shared)
    of_leader = leaders.select("site", F.col("doc").alias("leader"), F.col("terms").alias("leader_terms"))
    both = met.join(sets.select(*DOC, "terms"), DOC).join(of_leader, ["site", "leader"])
    shared = F.size(F.array_intersect("terms", "leader_terms"))
    union = F.size("terms") + F.size("leader_terms") - shared
    return both.where((shared >= min_shared) | (shared / union >= threshold)).groupBy(*DOC).agg(F.min("leader").alias("leader"))


def _decided(block: DataFrame, threshold: float, min_shared: int) -> DataFrame:
    """(site, doc, leader) of a block, each article in its turn against the leaders before it."""

    def decide(articles: pd.DataFrame) -> pd.DataFrame:
        articles = articles.sort_values("doc", kind="stable")
        holders: dict[str, list[int]] = {}
        sizes: list[int] = []
        names, out = [], []
        for doc, terms in zip(articles["doc"], articles["terms"], strict=True):
            shared: Counter = Counter()
            for term in terms:
                shared.update(holders.get(term, ()))
            close = [k for k, n in shared.items() if n >= min_shared or n / (len(terms) + sizes[k] - n) >= threshold]
            if close:
                out.append(names[min(close)])
                continue
            for term in terms:
                holders.setdefault(term, []).append(len(names))
            sizes.append(len(terms))
            names.append(doc)
            out.append(doc)
        return pd.DataFrame({"site": articles["site"], "doc": articles["doc"], "leader": out})

    kind = block.schema["doc"].dataType.simpleString()
    return block.select(*DOC, "terms").groupBy("site").applyInPandas(decide, f"site string, doc {kind}, leader {kind}")


def clusters(
    articles: DataFrame, keyword_table: DataFrame, threshold: float = 0.1, min_shared: int = 3, top_k: int = 15, block: int = BLOCK
) -> DataFrame:
    """(site, doc, leader): every article of ``articles`` with the leader of its cluster (itself if it leads).

    Each turn's results are written to a folder and what is left to another, so no plan grows with the turns.
    """
    if threshold <= 0 or min_shared < 1 or block < 1:
        raise ValueError("threshold must be positive, min_shared and block at least 1")
    spark, folder = articles.sparkSession, written_folder(articles.sparkSession, "clusters")
    sets = written_table(term_sets(keyword_table, top_k), "term-sets")
    left, turn = sets, 0
    while turn == 0 or not left.isEmpty():
        first = top_per_group(left, ["site"], ["doc"], block, "place").drop("place")
        _decided(first, threshold, min_shared).write.parquet(f"{folder}/turn={turn}/part=block")
        done = spark.read.parquet(f"{folder}/turn={turn}/part=block")
        later = left.join(done.select(*DOC), DOC, "left_anti")
        if later.isEmpty():
            break
        later = written_table(later, "later")
        leaders = left.join(done.where("leader = doc").select(*DOC), DOC, "left_semi")
        _taken(later, leaders, top_k, threshold, min_shared).write.parquet(f"{folder}/turn={turn}/part=taken")
        left = written_table(later.join(spark.read.parquet(f"{folder}/turn={turn}/part=taken"), DOC, "left_anti"), "open")
        turn += 1
    found = spark.read.parquet(folder).select(*DOC, "leader")
    return articles.select(*DOC).join(found, DOC, "left").select(*DOC, F.coalesce("leader", "doc").alias("leader"))


def leader_similarity(clustered: DataFrame, keyword_table: DataFrame, top_k: int = 15) -> DataFrame:
    """Shared keywords and Jaccard index of each article with its leader: (site, doc, leader, shared, jaccard)."""
    sets = keyword_table.where(F.col("rank") <= top_k).groupBy(*DOC).agg(F.collect_set("term").alias("terms"))
    own = clustered.join(sets, DOC, "left")
    of_leader = sets.select("site", F.col("doc").alias("leader"), F.col("terms").alias("leader_terms"))
    both = own.join(of_leader, ["site", "leader"], "left")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("terms", none), F.coalesce("leader_terms", none)
    shared = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return both.select(
        *DOC,
        "leader",
        shared.cast("bigint").alias("shared"),
        F.when(union > 0, shared / union).otherwise(0.0).alias("jaccard"),
    )
