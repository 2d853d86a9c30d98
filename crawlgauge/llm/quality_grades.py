"""Quality classifier: ordinal cumulative-link regression over hashed text.

Ratings are ordered grades 0 < 1 < ... < G-1. One weight vector over hashed text features is shared by all grades and
ordered thresholds cut its score: ``P(grade >= g) = sigmoid(w.x - t_g)``. From these come the expected grade and the
tail probability that decides whether a document is kept.

Fitting runs on the driver over a bounded, documented sample of labelled rows (``n_labels``); scoring is a map over all
documents, whole texts, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgauge.llm.common import labelled_sample, prepared, table

DIMENSIONS = 1 << 16
N_LABELS = 4000
#: A document is kept if the chance of the top grades is at least this.
KEEP_TAIL = 0.5
SYMBOLS = "#*$%&|<>"
WORD_SCALE, SHAPE_SCALE = 0.2, 0.5


def grade_column() -> Column:
    """Grades from the label table: 0 poor, 1 well written but toxic, 2 well written and not toxic."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).cast("int")


def _share(part: float, whole: float) -> int:
    """Eleven steps of a share."""
    return int(10 * part / whole) if whole else 0


class WordCodes(dict):
    """Word -> hashed index, with four marks above the index bits; filled as words are met, emptied when it is large."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        folded = word.strip(".,;:!?\"'()[]").lower()
        code = zlib.crc32(f"w {folded}".encode("utf-8", "replace")) % DIMENSIONS
        code |= (len(word) > 1 and word.isupper()) << 20
        code |= any(c in SYMBOLS for c in word) << 21
        code |= any(c.isdigit() for c in word) << 22
        code |= word.endswith("!") << 23
        self[word] = code
        return code


def features(text: str | None, codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text: (sorted distinct indices, values). No word: no feature."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    n = len(words)
    code = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    index, times = np.unique(code & (DIMENSIONS - 1), return_counts=True)
    lines = [line for line in text.split("\n") if line]
    upper, marked, digits, bang = (int(np.count_nonzero(code & (1 << bit))) for bit in (20, 21, 22, 23))
    shape = {
        "upper": _share(upper, n),
        "marked": _share(marked, n),
        "digits": _share(digits, n),
        "bang": _share(bang, n),
        "distinct": _share(len(index), n),
        "lines": _share(len(set(lines)), len(lines)),
        "top": _share(int(times.max()), n),
        "length": min(12, len(text) // n),
        "size": int(np.log2(n)),
    }
    value = WORD_SCALE * (1 + np.log(times))
    extra = np.array([zlib.crc32(f"s {k} {v}".encode()) % DIMENSIONS for k, v in shape.items()])
    index, back = np.unique(np.concatenate([index, extra]), return_inverse=True)
    return index, np.bincount(back, np.concatenate([value, np.full(len(extra), SHAPE_SCALE)]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class CumulativeLink:
    """Shared weights ``w`` and ordered thresholds ``t``; no training rows: every document gets the top grade."""

    def __init__(self, grades: int, w: np.ndarray | None = None, t: np.ndarray | None = None):
        self.grades = grades
        self.w = np.zeros(DIMENSIONS) if w is None else w
        self.t = np.full(grades - 1, -50.0) if t is None else t

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, grades: int, rounds: int = 250, decay: float = 3e-5) -> CumulativeLink:
        """Full-batch Adam on the negative log likelihood; thresholds stay ordered as a start plus positive steps."""
        model = cls(grades)
        if not len(rows) or len(np.unique(grade)) < 2:
            return model
        index = np.concatenate([r[0] for r in rows])
        value = np.concatenate([r[1] for r in rows])
        row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        share = np.array([max(1e-3, (grade >= g).mean()) for g in range(1, grades)])
        start = -np.log(share / np.maximum(1e-3, 1 - share))
        step = np.maximum(0.05, np.diff(start))
        params = np.concatenate([np.zeros(DIMENSIONS), start[:1], np.log(step)])
        m, v = np.zeros_like(params), np.zeros_like(params)
        n = len(rows)
        for k in range(1, rounds + 1):
            w, t = params[:DIMENSIONS], np.cumsum(np.concatenate([params[DIMENSIONS : DIMENSIONS + 1], np.exp(params[DIMENSIONS + 1 :])]))
            score = np.bincount(row, w[index] * value, n)
            above = np.hstack([np.ones((n, 1)), sigmoid(score[:, None] - t[None, :]), np.zeros((n, 1))])
            at = np.arange(n)
            p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-9)
            slope = above * (1 - above)
            d_score = -(slope[at, grade] - slope[at, grade + 1]) / p / n
            d_t = np.zeros(grades - 1)
            for g in range(1, grades):
                d_t[g - 1] = ((grade == g) * slope[:, g] / p - (grade == g - 1) * slope[:, g] / p).sum() / n
            tail = np.cumsum(d_t[::-1])[::-1]
            grad = np.concatenate([np.bincount(index, d_score[row] * value, DIMENSIONS) + decay * w, tail[:1], tail[1:] * np.exp(params[DIMENSIONS + 1 :])])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            params -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        model.w = params[:DIMENSIONS]
        model.t = np.cumsum(np.concatenate([params[DIMENSIONS : DIMENSIONS + 1], np.exp(params[DIMENSIONS + 1 :])]))
        return model

    def tails(self, feature: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """P(grade >= 1), ..., P(grade >= G-1)."""
        return sigmoid(float(self.w[feature[0]] @ feature[1]) - self.t)


def train(documents: DataFrame, labels: DataFrame, n_labels: int = N_LABELS) -> CumulativeLink:
    """Fit on about ``n_labels`` labelled documents (chosen by hashed ids); only their features come to the driver."""
    sample = labelled_sample(documents, labels, n_labels).select("doc_id", "text", grade_column().alias("grade"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            got = [features(t, codes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), pa.array([list(g[0]) for g in got], pa.list_(pa.int64())), pa.array([list(g[1]) for g in got], pa.list_(pa.float64()))],
                ["doc_id", "grade", "index", "value"],
            )

    rows = sample.mapInArrow(extract, "doc_id long, grade int, index array<long>, value array<double>").toPandas()
    rows = rows.sort_values(["doc_id", "grade"], kind="stable")
    got = [(np.asarray(i, np.int64), np.asarray(v, float)) for i, v in zip(rows["index"], rows["value"], strict=True)]
    return CumulativeLink.fit(got, rows["grade"].to_numpy(np.int64), 3)


def grade_documents(documents: DataFrame, model: CumulativeLink, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every row.

    A text without a word (null, empty or white space) has no evidence of quality: grade 0, tail 0, not kept, unless the
    model was fitted without rows, which keeps everything. Repeated rows give repeated results; other columns are unused.
    """
    w, t, grades = model.w.astype(np.float32), model.t, model.grades
    trained = bool(np.any(w))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codes = CumulativeLink(grades, w, t), WordCodes()
        for batch in batches:
            expected, tail = [], []
            for text in batch.column("text").to_pylist():
                feature = features(text, codes)
                p = own.tails(feature) if len(feature[0]) or not trained else np.zeros(grades - 1)
                expected.append(float(p.sum()))
                tail.append(float(p[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], ["doc_id", "expected_grade", "tail_probability"])

    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, expected_grade double, tail_probability double")
    return scored.withColumn("kept", F.col("tail_probability") >= keep_tail)


def keep_good(documents: DataFrame, model: CumulativeLink, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """Rows of ``documents`` (all columns, unchanged) that the classifier keeps; one pass, no join."""
    w, t, grades = model.w.astype(np.float32), model.t, model.grades
    trained = bool(np.any(w))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codes = CumulativeLink(grades, w, t), WordCodes()
        for batch in batches:
            keep = []
            for text in batch.column("text").to_pylist():
                feature = features(text, codes)
                keep.append(not trained or (len(feature[0]) > 0 and float(own.tails(feature)[-1]) >= keep_tail))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(select, documents.schema)


def op9_quality_grades(spark, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and verdict of every document."""
    prepared(spark)
    documents = table(spark, sf_dir, "documents")
    return grade_documents(documents, train(documents, table(spark, sf_dir, "labels")))
