"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line of a text gets a small vector of surface features. The chain scores a labelling by line features and by the
step from one line's label to the next; Viterbi decoding finds the best labelling of the whole document. A document is
kept if enough of its words are in content lines, after plain base rules.

The chain is fitted on a bounded, documented sample of labelled documents (about ``N_LABELS``, all lines of each). Line
labels come from what is known of them: lines of poor documents are boilerplate, lines of good ones content but for
repeats of an earlier line. As such a document rarely changes its label, each good one is learned once more with a poor
one spliced in before, behind or between its lines, so the steps between labels are learned at places that are known.
Decoding is a map over all documents, whole texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgauge.llm.common import labelled_sample, prepared, table

N_LABELS = 800
#: Longer documents are learned in stretches of so many lines, one after another.
STRETCH = 64
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Share of a document's words that must be in content lines.
MIN_CONTENT = 0.5
WINDOW = 8

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _set(members: bytes) -> np.ndarray:
    found = np.zeros(256, np.int32)
    found[list(members)] = 1
    return found


#: Byte classes counted in each line.
CLASSES = {
    "inside": (~SPACE).astype(np.int32),
    "upper": _set(bytes(range(ord("A"), ord("Z") + 1))),
    "digit": _set(b"0123456789"),
    "symbol": _set(b"#*$%&|<>"),
    "shout": _set(b"!?"),
    "mark": _set(b".,;:'\"()-"),
    "start": np.isin(np.arange(256), np.arange(0x80, 0xC0), invert=True).astype(np.int32) * ~SPACE,
}
N_FEATURES = 11


class Measures:
    """What one whole text gives: base counts and a feature row for each line that has a word."""

    __slots__ = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features", "line_words")

    def __init__(self, text: str | None):
        data = (text or "").encode("utf-8", "replace")
        words = data.split()
        self.n_words = n = len(words)
        self.word_chars = self.n_symbols = self.n_dup_lines = self.n_repeat_words = 0
        self.features, self.line_words = np.zeros((0, N_FEATURES)), np.zeros(0, np.int64)
        if not n:
            return
        code = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
        self.n_repeat_words = repeated_words(code)
        raw = np.frombuffer(data, np.uint8)
        starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
        ends = np.append(starts[1:] - 1, len(raw))
        filled = ends > starts
        starts, ends = starts[filled], ends[filled]
        total = {k: np.add.reduceat(t[raw], starts) for k, t in CLASSES.items()}
        inside = SPACE[raw]
        first = ~inside
        first[1:] &= inside[:-1]
        line_words = np.add.reduceat(first.astype(np.int32), starts)
        self.word_chars, self.n_symbols = int(total["start"].sum()), int(total["symbol"].sum())
        has = line_words > 0
        starts, ends, line_words = starts[has], ends[has], line_words[has]
        total = {k: v[has].astype(float) for k, v in total.items()}
        seen: set[bytes] = set()
        again = np.zeros(len(starts), bool)
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            line = data[a:b]
            again[i] = line in seen
            seen.add(line)
        self.n_dup_lines = int(again.sum())
        same = np.zeros(n, np.int32)
        same[1:] = code[1:] == code[:-1]
        word_line = np.concatenate([[0], np.cumsum(line_words)[:-1]])
        size = np.maximum(total["inside"], 1)
        last = raw[np.maximum(ends - 1, 0)]
        self.line_words = line_words.astype(np.int64)
        self.features = np.stack(
            [
                np.ones(len(starts)),
                np.log1p(line_words) / 3,
                np.minimum(size / line_words, 15) / 5,
                4 * total["upper"] / size,
                4 * total["digit"] / size,
                6 * total["symbol"] / size,
                6 * total["shout"] / size,
                6 * total["mark"] / size,
                (last == 46).astype(float),
                2.0 * again,
                3 * np.add.reduceat(same, word_line) / line_words,
            ],
            axis=1,
        )

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


def repeated_words(code: np.ndarray) -> int:
    """Words in windows of ``WINDOW`` words that are found twice or more in the text, the first one included."""
    n = len(code) - WINDOW + 1
    if n < 2:
        return 0
    window = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        window *= np.uint64(0x9E3779B97F4A7C15)
        window += code[j : j + n]
    window ^= window >> np.uint64(29)
    ordered = np.sort(window)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(window, twice))
    edge = np.zeros(len(code) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


class LineField:
    """Chain over two labels (0 boilerplate, 1 content): line weights, steps between labels, and a start score."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None, start: np.ndarray | None = None):
        if weights is None:  # nothing to learn from: every line is content
            weights, steps, start = np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.array([0.0, 1.0])
            weights[0, 1] = 1.0
        self.weights, self.steps, self.start = weights, steps, start

    @classmethod
    def fit(cls, documents: list[np.ndarray], labels, rounds: int = 80, decay: float = 1e-3) -> LineField:
        """Adam on the mean negative log likelihood of the labels, by forward and backward sums over padded lines.

        ``labels`` has one label for all lines of a document, or an array with one for each of its lines.
        """
        known = [(d, np.full(len(d), y) if np.ndim(y) == 0 else np.asarray(y)) for d, y in zip(documents, labels, strict=True) if len(d)]
        known = [(d[a : a + STRETCH], y[a : a + STRETCH].astype(np.int64)) for d, y in known for a in range(0, len(d), STRETCH)]
        if not known or len(np.unique(np.concatenate([y for _, y in known]))) < 2:
            return cls()
        n, longest = len(known), max(len(d) for d, _ in known)
        x, on, truth = np.zeros((n, longest, N_FEATURES)), np.zeros((n, longest), bool), np.zeros((n, longest, 2))
        true_steps = np.zeros((n, 2, 2))
        for i, (d, y) in enumerate(known):
            x[i, : len(d)], on[i, : len(d)] = d, True
            truth[i, np.arange(len(d)), y] = 1
            np.add.at(true_steps[i], (y[:-1], y[1:]), 1)
        most = np.array([int(y.mean() >= 0.5) for _, y in known])
        weight = (0.5 / np.maximum(np.bincount(most, minlength=2) / n, 1e-9))[most] / n
        params = np.zeros(N_FEATURES * 2 + 4 + 2)
        m, v = np.zeros_like(params), np.zeros_like(params)
        for k in range(1, rounds + 1):
            w, steps, start = params[: N_FEATURES * 2].reshape(N_FEATURES, 2), params[-6:-2].reshape(2, 2), params[-2:]
            score = x @ w
            ahead, back = np.zeros_like(score), np.zeros_like(score)
            ahead[:, 0] = score[:, 0] + start
            for t in range(1, longest):
                nxt = score[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + steps[None], axis=1)
                ahead[:, t] = np.where(on[:, t, None], nxt, ahead[:, t - 1])
            z = np.logaddexp.reduce(ahead[:, -1], axis=1)
            for t in range(longest - 2, -1, -1):
                nxt = np.logaddexp.reduce((score[:, t + 1] + back[:, t + 1])[:, None, :] + steps[None], axis=2)
                back[:, t] = np.where(on[:, t + 1, None], nxt, 0.0)
            here = np.exp(ahead + back - z[:, None, None]) * on[:, :, None]
            gap = (here - truth) * weight[:, None, None]
            pair = np.exp(ahead[:, :-1, :, None] + steps[None, None] + (score[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None])
            pair *= (on[:, 1:] * weight[:, None])[:, :, None, None]
            d_steps = pair.sum((0, 1))
            d_steps -= np.einsum("nij,n->ij", true_steps, weight)
            grad = np.concatenate([np.einsum("ntf,ntk->fk", x, gap).ravel(), d_steps.ravel(), gap[:, 0].sum(0)]) + decay * params
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            params = params - 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return cls(params[: N_FEATURES * 2].reshape(N_FEATURES, 2), params[-6:-2].reshape(2, 2), params[-2:])

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Viterbi: True for content lines. Ties prefer content."""
        if not len(features):
            return np.zeros(0, bool)
        score = features @ self.weights
        (s00, s01), (s10, s11) = self.steps.tolist()
        rows = score.tolist()
        (x, y), (u, v) = rows[0], self.start.tolist()
        a, b = x + u, y + v
        came = []
        for x, y in rows[1:]:
            p, q = a + s00, b + s10
            r, s = a + s01, b + s11
            came.append((q >= p, s >= r))
            a, b = (q if q >= p else p) + x, (s if s >= r else r) + y
        label = b >= a
        out = np.empty(len(rows), bool)
        out[-1] = label
        for i in range(len(came) - 1, -1, -1):
            label = came[i][label]
            out[i] = label
        return out


REPEATED = 9  # the feature that marks a line equal to an earlier one


def line_truth(features: np.ndarray, good: bool) -> np.ndarray:
    return (features[:, REPEATED] == 0).astype(np.int64) if good else np.zeros(len(features), np.int64)


def spliced(good: np.ndarray, poor: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines and labels of a good document with a poor one before, behind, or in the middle of it."""
    at = (0, len(good), len(good) // 2)[way % 3]
    y = line_truth(good, True)
    return np.concatenate([good[:at], poor, good[at:]]), np.concatenate([y[:at], line_truth(poor, False), y[at:]])


def fit_documents(features: list[np.ndarray], good: np.ndarray) -> LineField:
    """The chain from documents known as good or poor: each as it is, and each good one with a poor one spliced in."""
    sequences = [(f, line_truth(f, bool(g))) for f, g in zip(features, good, strict=True)]
    poor = [f for f, g in zip(features, good, strict=True) if not g and len(f)]
    fine = [f for f, g in zip(features, good, strict=True) if g and len(f)]
    sequences += [spliced(f, poor[i % len(poor)], i) for i, f in enumerate(fine)] if poor else []
    return LineField.fit([f for f, _ in sequences], [y for _, y in sequences])


def train(documents: DataFrame, labels: DataFrame, n_labels: int = N_LABELS) -> LineField:
    """Fit on all lines of about ``n_labels`` labelled documents; only features reach the driver."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [Measures(t).features.ravel().tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(got, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    sample = labelled_sample(documents, labels, n_labels).select("doc_id", "text", "quality")
    rows = sample.mapInArrow(extract, "doc_id long, quality int, x array<double>").toPandas().sort_values(["doc_id", "quality"], kind="stable")
    return fit_documents([np.asarray(x, float).reshape(-1, N_FEATURES) for x in rows["x"]], (rows["quality"] > 0).to_numpy())


def labelled_lines(documents: DataFrame, field: LineField) -> DataFrame:
    """The operator's labels: doc_id, line (from 0, among lines with a word), n_words, content."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = Measures(text)
                n = len(got.features)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(got.line_words, pa.int64()), pa.array(field.decode(got.features), pa.bool_())],
                    ["doc_id", "line", "n_words", "content"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(decode, "doc_id long, line int, n_words long, content boolean")


def line_quality(documents: DataFrame, field: LineField, min_content: float = MIN_CONTENT) -> DataFrame:
    """Counts, base verdict, content share and verdict of every row.

    Null and empty texts, and texts of white space, have no words: all counts 0, base_failed, content share 0. Repeated
    rows give repeated results; a null doc_id stays null; other columns are not read.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "n_content_lines"]
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64(), pa.int64()]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = Measures(text)
                content = field.decode(got.features)
                share = float(got.line_words[content].sum() / got.n_words) if got.n_words else 0.0
                failed = got.base_failed
                rows.append((doc_id, got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, failed, not failed and share >= min_content, share, int(content.sum())))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_content_lines long"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, schema)


def op1_line_labels(spark, sf_dir: str) -> DataFrame:
    """Base counts and the chain's verdict for every document."""
    prepared(spark)
    documents = table(spark, sf_dir, "documents")
    return line_quality(documents, train(documents, table(spark, sf_dir, "labels")))
