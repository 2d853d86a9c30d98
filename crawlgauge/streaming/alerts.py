"""Regression alerts on a stream of layer scores.

The state of a key (site, layer) is the list of its scores within the lateness bound, counted back from the newest one,
and the one score before them. A micro-batch puts its rows into the lists of the keys it touches and settles each new
row and each known row that a new one now precedes; both are written as changes of this batch, and a reader takes the
newest version of a change. So rows may come in any order and in any files within the bound: late rows correct what was
said before, and the result is that of all rows in time order. Nothing written is read again by the stream, so a batch
costs what it brings, however long the history is. A batch that is run again after a failure starts from the state of the
batch before it and overwrites its own output, so nothing is counted twice.

A row that comes later than the bound has no known predecessor; it is written with the change ``late`` and corrects
nothing. A row without a time is ``late``, too.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import STEP, change_kind
from ..operators.skew import previous_values

KEYS = ["site", "layer"]
ROW = [*KEYS, "run_ts", "tie"]
COLUMNS = [*ROW, "score"]
#: How much older than the newest score of its key a row may be to be put in its place.
LATENESS = datetime.timedelta(days=60)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times are microseconds inside the stream.
CHANGES = "site string, layer string, run_us long, tie long, score double, prev_score double, change string"
Change = Row(*KEYS, "run_us", "tie", "score", "prev_score", "change")


def score_changes(batch: DataFrame, known: DataFrame, period: str = "day") -> DataFrame:
    """Rows whose predecessor is settled by ``batch``: its own rows, and known rows that now follow one of them.

    (site, layer, run_ts, tie, score, prev_score, change). ``known`` are the rows of earlier batches; only those of keys
    that the batch touches are read on. Rows delivered twice count once. The batch form of the stream.
    """
    new = batch.select(*COLUMNS).dropDuplicates(ROW).withColumn("is_new", F.lit(True))
    touched = new.select(*KEYS).distinct()
    old = known.select(*COLUMNS).join(touched, KEYS, "left_semi").join(new.select(*ROW), ROW, "left_anti")
    rows = new.unionByName(old.withColumn("is_new", F.lit(False))).withColumn("_period", F.date_trunc(period, "run_ts"))
    before = previous_values(rows, KEYS, ["run_ts", "tie"], ["score", "is_new"], "_period")
    settled = before.where(F.col("is_new") | F.coalesce("prev_is_new", F.lit(False)))
    return settled.select(*COLUMNS, "prev_score", change_kind(F.col("score") - F.col("prev_score")).alias("change"))


def settled_rows(known: list[tuple], new: list[tuple], cut_off: bool) -> tuple[list[tuple], list[tuple]]:
    """All rows (run_us, tie, score) of a key in time order, and those that ``new`` settles, with prev_score and change.

    ``cut_off`` says that rows before the first known one have been forgotten: new rows before it come too late. A row
    delivered again takes the place of the one before.
    """
    place = lambda r: (r[0], r[1] is not None, r[1] or 0)
    begin = known[0][0] if cut_off and known else None
    late = [r for r in new if r[0] is None or (begin is not None and r[0] < begin)]
    fresh = {place(r): r for r in new if r[0] is not None and not (begin is not None and r[0] < begin)}
    rows = sorted(({place(r): r for r in known} | fresh).items())
    settled, before = [], (None, None)
    for at, row in rows:
        if at in fresh or before[0] in fresh:
            prev = before[1][2] if before[1] else None
            delta = row[2] - prev if row[2] is not None and prev is not None else 0
            settled.append((*row, prev, "regression" if delta <= -STEP else "improvement" if delta >= STEP else None))
        before = (at, row)
    return [r for _, r in rows], settled + [(*r, None, "late") for r in dict.fromkeys(late)]


class ScoreHistory(StatefulProcessor):
    """Scores of each key within the lateness bound, and the changes that new rows bring.

    With ``idle_ms`` a key that gets no row for so long is forgotten, whatever its scores' times; its next row is the first.
    """

    def __init__(self, lateness: datetime.timedelta = LATENESS, idle_ms: int | None = None):
        self.lateness, self.idle_ms = lateness // datetime.timedelta(microseconds=1), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # first is true in the first row if rows before it have been forgotten
        self.scores = handle.getListState("scores", "run_us long, tie long, score double, first boolean", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = list(self.scores.get())
        cut_off = bool(kept and kept[0][3])
        every, settled = settled_rows([tuple(r[:3]) for r in kept], [(r.run_us, r.tie, r.score) for r in rows], cut_off)
        if every:
            # the last row before the bound stays: the first row within it follows that one
            bound = every[-1][0] - self.lateness
            first = max(next(i for i, r in enumerate(every) if r[0] >= bound) - 1, 0)
            self.scores.put([(*r, i == 0 and (cut_off or first > 0)) for i, r in enumerate(every[first:])])
        for row in settled:
            yield Change(*key, *row)

    def close(self) -> None:
        pass


def start_alerts(runs: DataFrame, folder: str, lateness: datetime.timedelta = LATENESS, available_now: bool = True, idle_ms: int | None = None):
    """Write score changes of every micro-batch under ``folder``; read them back with ``read_changes``.

    ``runs`` is a stream of (site, layer, run_ts, tie, score). A key's rows of one micro-batch are handled together, so the
    source's limits (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bound what one task holds. The session's state stores
    become RocksDB, which list state needs.
    """
    runs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    runs.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    changes = runs.select(*KEYS, F.unix_micros(F.col("run_ts").cast("timestamp")).alias("run_us"), "tie", "score").groupBy(*KEYS).transformWithState(
        statefulProcessor=ScoreHistory(lateness, idle_ms), outputStructType=CHANGES, outputMode="Update", timeMode="None" if idle_ms is None else "ProcessingTime"
    )

    kind = runs.schema["run_ts"].dataType

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.select(*KEYS, F.timestamp_micros("run_us").cast(kind).alias("run_ts"), "tie", "score", "prev_score", "change").write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")

    writer = changes.writeStream.foreachBatch(on_batch).outputMode("update").option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_changes(spark, folder: str) -> DataFrame:
    """Newest version of each row's change; rows without one are left out."""
    every = spark.read.parquet(f"{folder}/changes")
    newest = every.groupBy(*ROW).agg(F.max_by(F.struct("score", "prev_score", "change"), "batch").alias("c"))
    return newest.select(*ROW, "c.*").where(F.col("change").isNotNull())


def read_alerts(spark, folder: str) -> DataFrame:
    """Only the drops."""
    return read_changes(spark, folder).where(F.col("change") == "regression")


def read_late(spark, folder: str) -> DataFrame:
    """Rows that came later than the bound, or without a time."""
    return read_changes(spark, folder).where(F.col("change") == "late").select(*COLUMNS)
