"""Suffix-array dedup: byte strings of ``LENGTH`` that also start in a document with a smaller id are removed.

Documents are dealt to shards of about ``SHARD_BYTES`` by a hash. Every string of ``LENGTH`` bytes has an anchor: the
least hash of the short grams inside it, so equal strings have equal anchors wherever they stand.

1. Each shard sends its distinct anchors, about one for 20 bytes, to parts by hash; a part returns to each shard those
   that another shard has, too. Strings with other anchors occur in one document only.
2. For the anchors left, a shard cuts maximal runs of strings with one anchor. Equal runs collapse within the shard to
   their least document before they move, so copies of any number are one row a shard.
3. A part puts its runs into shards of bounded size, builds a suffix array of each (Larsson-Sadakane), takes common
   prefixes (Kasai) to find the distinct strings and their least document, and merges shards that share an anchor by
   binary search. Places where a smaller document holds the string go back to the shard that sent the run.
4. Each shard marks and removes the bytes covered.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgauge.llm.common import mix64, prepared, table
from crawlgauge.llm.suffix_arrays import Shard

LENGTH = 50
GRAM = 16
SHARD_BYTES = 16_000_000
#: Parts for each shard of documents: runs are some tenths of the text.
PARTS_PER_SHARD = 4
#: Bytes of one suffix array.
ARRAY_BYTES = 1_000_000
#: Bytes hashed at once; bounds scratch memory for very long texts.
CHUNK = 1 << 22
FACTOR = 0x9E3779B97F4A7C15


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the gram at every position, by doubling."""
    h, width = raw.astype(np.uint64) + np.uint64(1), 1
    while 2 * width <= gram:
        h = h[: len(h) - width] * np.uint64(pow(FACTOR, width, 1 << 64)) + h[width:]
        width *= 2
    if width < gram:
        rest = gram - width
        h = mix64(h[: len(h) - rest]) * np.uint64(FACTOR) + h[rest:]
    return mix64(h)


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For every string of ``length`` bytes, by its start: the least gram hash inside it."""
    if len(raw) < length:
        return np.zeros(0, np.uint64)
    out = []
    for at in range(0, len(raw) - length + 1, CHUNK):
        least, span, window = gram_hashes(raw[at : at + CHUNK + length - 1], gram), 1, length - gram + 1
        while 2 * span <= window:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < window:
            least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
        out.append(least)
    return np.concatenate(out)


def in_order(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(ids, whether there is one, texts as bytes) of a shard's documents in a fixed order."""
    part = part.assign(text=part["text"].fillna("")).sort_values(["doc_id", "text"], kind="stable", na_position="last")
    known = part["doc_id"].notna().to_numpy()
    ids = part["doc_id"].fillna(0).astype("int64").to_numpy()
    return ids, known, [t.encode("utf-8", "replace") for t in part["text"]]


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def distinct_anchors(raw: np.ndarray, length: int) -> np.ndarray:
    m = anchors(raw, length)
    return np.unique(m[np.concatenate([[True], m[1:] != m[:-1]])]) if len(m) else m


#: Bytes of an anchor's key that are sent. Equal keys of different anchors only make some strings be sorted in vain.
KEY_BYTES = 6


def anchor_keys(values: np.ndarray) -> np.ndarray:
    return mix64(values) >> np.uint64(64 - 8 * KEY_BYTES)


def short(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays behind their lengths, compressed."""
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head, *raw]))


def unpacked(body: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    sizes = np.frombuffer(raw[8 : 8 * (n + 1)], np.int64)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [raw[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]


class Sub:
    """Runs of one part, by anchor, as one text with a suffix array."""

    def __init__(self, pieces: list[bytes], owner: np.ndarray, length: int):
        lens = np.array([len(p) for p in pieces], np.int64)
        self.text = np.frombuffer(b"".join(pieces), np.uint8)
        self.start = np.concatenate([[0], np.cumsum(lens)[:-1]])
        place = np.arange(len(self.text)) - np.repeat(self.start, lens)
        self.valid = place <= np.repeat(lens, lens) - length
        self.owner = np.repeat(owner, lens)
        self.row = np.repeat(np.arange(len(pieces)), lens)
        self.place = place
        self.shard = Shard(self.text, self.valid, self.owner, length)

    def smaller(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first place, places) of stretches whose strings some smaller document holds."""
        less = self.shard.owners(len(self.text)) < self.owner
        edge = np.flatnonzero(less & ~np.concatenate([[False], less[:-1] & (self.row[1:] == self.row[:-1])]))
        stop = np.flatnonzero(less & ~np.concatenate([less[1:] & (self.row[1:] == self.row[:-1]), [False]]))
        return self.row[edge], self.place[edge], stop - edge + 1


def removed(documents: DataFrame, length: int = LENGTH, keep_bytes: bool = False, shard_bytes: int = SHARD_BYTES, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of each removed run), and kept (the bytes
    left) if ``keep_bytes``.

    Null and empty texts have no bytes. A null doc_id is neither smaller nor greater than another: such rows lose and
    give nothing. Rows of one doc_id are not smaller than each other; repeated rows give repeated results. Strings of
    invalid text don't occur, as columns hold UTF-8; a cut may fall inside a character, so what is kept is bytes. Other
    columns are not read.
    """
    prepared(documents.sparkSession)
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    parts = shards * PARTS_PER_SHARD
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"))

    def part_of(keys: np.ndarray) -> np.ndarray:
        return (keys % np.uint64(parts)).astype(np.int64)

    def send_anchors(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        ids, known, texts = in_order(docs)
        found = [distinct_anchors(np.frombuffer(t, np.uint8), length) for t, k in zip(texts, known, strict=True) if k]
        values = np.unique(anchor_keys(np.concatenate(found))) if found else np.zeros(0, np.uint64)
        part = part_of(values)
        order = np.argsort(part, kind="stable")
        values, part = values[order], part[order]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        return pd.DataFrame({"part": part[cuts], "shard": int(key[0]), "anchors": [short(v) for v in np.split(values, cuts[1:])] if len(cuts) else []})

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        each = [long(b) for b in group["anchors"]]
        ordered = np.sort(np.concatenate(each))
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        both = [v[member(v, twice)] for v in each]
        out = [(s, short(v)) for s, v in zip(group["shard"], both, strict=True) if len(v)]
        return pd.DataFrame(out, columns=["shard", "anchors"])

    def cut_runs(key: tuple, docs: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        ids, known, texts = in_order(docs)
        elsewhere = [long(b) for b in shared["anchors"]]
        scanned, own = [], []
        for text, k in zip(texts, known, strict=True):
            m = anchors(np.frombuffer(text, np.uint8), length) if k else np.zeros(0, np.uint64)
            edge = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])) if len(m) else np.zeros(0, np.int64)
            keys = anchor_keys(m[edge])
            scanned.append((keys, edge, len(m)))
            own.append(np.unique(keys))
        values = np.sort(np.concatenate([np.zeros(0, np.uint64), *own]))
        here = values[1:][values[1:] == values[:-1]]
        wanted = np.unique(np.concatenate([here, *elsewhere]))
        numbers: dict[bytes, int] = {}
        anchor, owner, seen = [], [], []
        for d, (text, (value, edge, n)) in enumerate(zip(texts, scanned, strict=True)):
            hit = np.flatnonzero(member(value, wanted))
            stop = np.append(edge[1:], n)[hit] if len(edge) else edge
            start = edge[hit]
            for a, s, e in zip(value[hit].tolist(), start.tolist(), stop.tolist(), strict=True):
                content = text[s : e - 1 + length]
                number = numbers.setdefault(content, len(numbers))
                if number == len(owner):  # documents come by id, so the first holder is the least
                    owner.append(ids[d])
                    anchor.append(a)
                seen.append((d, s, e - s, number))
        contents, anchor, owner = list(numbers), np.array(anchor, np.uint64), np.array(owner, np.int64)
        part = part_of(anchor)
        out = []
        order = np.lexsort((anchor, part))
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for rows_ in np.split(order, cuts) if len(order) else []:
            some = [contents[i] for i in rows_]
            body = packed(anchor[rows_], owner[rows_], rows_.astype(np.int32), np.array([len(c) for c in some], np.int32), b"".join(some))
            out.append((int(part[rows_[0]]), int(key[0]), body))
        # the shard's own record travels with the runs, under a key of its own
        out.append((-1 - int(key[0]), int(key[0]), packed(owner, np.array(seen, np.int32).reshape(-1, 4))))
        return pd.DataFrame(out, columns=["key", "shard", "body"])

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return group.assign(kind="own")[["shard", "kind", "body"]]
        columns: list[list] = [[], [], [], []]
        contents: list[bytes] = []
        for body in group["body"]:
            *arrays, data = unpacked(body)
            for column, raw, kind in zip(columns, arrays, (np.uint64, np.int64, np.int32, np.int32), strict=True):
                column.append(np.frombuffer(raw, kind))
            ends = np.cumsum(columns[3][-1]).tolist()
            contents += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        sender = np.repeat(group["shard"].to_numpy(), [len(n) for n in columns[0]])
        anchor, owner, number = (np.concatenate(c) for c in columns[:3])
        # equal runs of several shards are one here: all but those of its least document go whole
        numbers: dict[bytes, int] = {}
        which = np.fromiter((numbers.setdefault(c, len(numbers)) for c in contents), np.int64, len(contents))
        distinct = list(numbers)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, which, owner)
        of = np.zeros(len(distinct), np.uint64)
        of[which] = anchor
        lens = np.array([len(c) for c in distinct], np.int64)
        late = np.flatnonzero(owner > least[which])
        marks = [np.stack([sender[late], number[late], np.zeros(len(late), np.int64), lens[which[late]] - length + 1], axis=1)]
        holders = np.flatnonzero(owner == least[which])
        holders = holders[np.argsort(which[holders], kind="stable")]
        order = np.argsort(of, kind="stable")
        sizes = np.cumsum(lens[order])
        subs, bounds = [], []
        for rows_ in np.split(order, np.searchsorted(sizes, np.arange(array_bytes, sizes[-1], array_bytes))):
            if len(rows_):
                subs.append((rows_, Sub([distinct[i] for i in rows_], least[rows_], length)))
                bounds.append((of[rows_[0]], of[rows_[-1]]))
        for i in range(len(subs)):
            for j in range(i + 1, len(subs)):
                if bounds[j][0] > bounds[i][1]:
                    break
                subs[i][1].shard.merge(subs[j][1].shard)
        for rows_, sub in subs:
            row, first, many = sub.smaller()
            low, high = (np.searchsorted(which[holders], rows_[row], side) for side in ("left", "right"))
            times = high - low
            at = holders[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            marks.append(np.stack([sender[at], number[at], np.repeat(first, times), np.repeat(many, times)], axis=1).astype(np.int64))
        every = np.concatenate(marks)
        every = every[np.argsort(every[:, 0], kind="stable")]
        cuts = np.flatnonzero(np.diff(every[:, 0])) + 1
        out = [(int(m[0, 0]), "less", packed(m[:, 1:].astype(np.int32))) for m in np.split(every, cuts) if len(m)]
        return pd.DataFrame(out, columns=["shard", "kind", "body"])

    def finish(key: tuple, docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        ids, known, texts = in_order(docs)
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        edge = np.zeros(base[-1] + 1, np.int64)
        mine = marks["body"][marks["kind"] == "own"]
        if len(mine):
            owners, places = unpacked(mine.iloc[0])
            owner, seen = np.frombuffer(owners, np.int64), np.frombuffer(places, np.int32).reshape(-1, 4).astype(np.int64)
            at = base[seen[:, 0]] + seen[:, 1]
            later = ids[seen[:, 0]] > owner[seen[:, 3]]
            np.add.at(edge, at[later], 1)
            np.add.at(edge, at[later] + seen[later, 2] - 1 + length, -1)
            firsts = np.flatnonzero(~later)
            back = [np.frombuffer(unpacked(b)[0], np.int32).reshape(-1, 3).astype(np.int64) for b in marks["body"][marks["kind"] == "less"]]
            if back and len(firsts):
                less = np.concatenate(back)
                less = less[np.argsort(less[:, 0], kind="stable")]
                low, high = np.searchsorted(less[:, 0], seen[firsts, 3], "left"), np.searchsorted(less[:, 0], seen[firsts, 3], "right")
                many = high - low
                which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                start = np.repeat(at[firsts], many) + less[which, 1]
                np.add.at(edge, start, 1)
                np.add.at(edge, start + less[which, 2] - 1 + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for d, text in enumerate(texts):
            cut = gone[base[d] : base[d + 1]]
            if not cut.any():
                kept, spans, n = text, [], 0
            else:
                change = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]])))
                spans, n = [{"start": a, "end": b} for a, b in change.reshape(-1, 2).tolist()], int(cut.sum())
                kept = np.frombuffer(text, np.uint8)[~cut].tobytes()
            row = (int(ids[d]) if known[d] else None, len(text), n, len(spans), hashlib.sha256(kept).hexdigest(), spans)
            out.append((*row, kept) if keep_bytes else row)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * keep_bytes
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    sent = dealt.groupBy("shard").applyInPandas(send_anchors, "part long, shard long, anchors binary")
    shared = sent.groupBy("part").applyInPandas(meet, "shard long, anchors binary")
    cut = dealt.groupBy("shard").cogroup(shared.groupBy("shard")).applyInPandas(cut_runs, "key long, shard long, body binary")
    marks = cut.groupBy("key").applyInPandas(compare, "shard long, kind string, body binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * keep_bytes
    return dealt.groupBy("shard").cogroup(marks.groupBy("shard")).applyInPandas(finish, schema)


def op6_repeated_spans(spark, sf_dir: str) -> DataFrame:
    """Bytes removed of every document, and the digest of what is left."""
    return removed(table(spark, sf_dir, "documents")).drop("spans")
