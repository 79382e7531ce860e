"""Following changes of the note tree with Structured Streaming.

A change is a row (path, deleted boolean, ts timestamp). Changes are coalesced per path, the last one wins, and are applied
batch by batch to the store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.config import Settings

CHANGE = "path string, deleted boolean, ts timestamp"


def change_log(spark: SparkSession, folder: str, settings: Settings = Settings(), max_files: int = 1000) -> DataFrame:
    """The stream of changes that are written as JSON lines to ``folder``; other files than notes are left out."""
    raw = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", max_files).json(folder)
    return raw.where(is_note(settings))


def is_note(settings: Settings = Settings(), column: str = "path"):
    """Whether a relative path is a note outside dot folders and ignored ones, inside the tree."""
    parts = F.split(column, "/")
    ext = F.lower(F.regexp_extract(column, r"(\.[^./]+)$", 1))
    return ext.isin(*settings.extensions) & ~F.exists(parts, lambda p: p.startswith(".") | p.isin(*settings.ignored_folders)) & ~F.startswith(F.col(column), F.lit("/"))


def coalesced(changes: DataFrame, gap_s: float = 2.0, watermark: str = "10 minutes") -> DataFrame:
    """One change per path and burst, as (path, deleted, ts, n): changes at most ``gap_s`` seconds apart are a burst, and its
    last one counts. Works on streams, whose state the watermark bounds, and on tables."""
    own = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.withWatermark("ts", watermark) if own.isStreaming else own
    burst = own.groupBy("path", F.session_window("ts", f"{int(gap_s * 1000)} milliseconds"))
    return burst.agg(F.max_by("deleted", "ts").alias("deleted"), F.max("ts").alias("ts"), F.count("*").alias("n")).select("path", "deleted", "ts", "n")


def _hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, wait_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        deleted, ts = state.get
        state.remove()
        yield pd.DataFrame({"path": [key[0]], "deleted": [deleted], "ts": [pd.Timestamp(ts, unit="us")]})
        return
    last = state.get if state.exists else None
    for b in batches:
        for deleted, ts in zip(b["deleted"], b["ts"], strict=True):
            at = int(pd.Timestamp(ts).value // 1000)
            if last is None or at >= last[1]:
                last = (bool(deleted), at)
    if last is not None:
        state.update(last)
    state.setTimeoutDuration(wait_ms)


def debounced(changes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The last change of each path once no other has come for ``settings.debounce_s``, by the clock of the cluster: every new change starts
    the wait anew."""
    own = changes.select("path", "deleted", F.col("ts").cast("timestamp").alias("ts"))
    wait_ms = int(settings.debounce_s * 1000)

    def hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from _hold(key, batches, state, wait_ms)

    return own.groupBy("path").applyInPandasWithState(hold, CHANGE, "deleted boolean, ts long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def without_own_writes(changes: DataFrame, written: DataFrame) -> DataFrame:
    """Changes whose revision (path, mtime_ns, size) is not among ``written``, the revisions that this system wrote itself."""
    return changes.join(written.select("path", "mtime_ns", "size").distinct(), ["path", "mtime_ns", "size"], "left_anti")


def _admit(batches: Iterator[pa.RecordBatch], most: int, window_us: int) -> Iterator[pa.RecordBatch]:
    path, first, used = None, 0, 0
    for batch in batches:
        ok = []
        for p, t in zip(batch.column("path").to_pylist(), batch.column("us").to_pylist(), strict=True):
            if p != path or t - first > window_us:
                path, first, used = p, t, 0
            used += 1
            ok.append(used <= most)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_())], names=[*batch.schema.names, "allowed"])


def allowed_attempts(attempts: DataFrame, path: str = "path", ts: str = "ts", most: int = 3, window_s: float = 60.0) -> DataFrame:
    """Attempts (path, ts) with ``allowed``: false from the fourth on within ``window_s`` seconds of the first of a window.

    A window starts with the first attempt after the one before has run out; refused attempts do not prolong it. Attempts further apart
    than a window never share one, so a path is cut there: what must stay in order in one task is one unbroken run of attempts,
    which is read as a stream and never held. Runs are found by hours, whose first and last attempts are then put in order.
    """
    width = int(window_s * 1e6)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = attempts.select(F.col(path).alias("path"), F.col(ts).alias("ts"), us.alias("us")).where("path IS NOT NULL AND us IS NOT NULL").withColumn("hour", F.floor(F.col("us") / int(3.6e9)))
    ends = rows.groupBy("path", "hour").agg(F.max("us").alias("last"))
    by_hour = Window.partitionBy("path").orderBy("hour")
    before = ends.select("path", "hour", F.lag("last").over(by_hour).alias("before"))
    within = Window.partitionBy("path", "hour").orderBy("us")
    marked = rows.join(before, ["path", "hour"]).withColumn("prev", F.coalesce(F.lag("us").over(within), "before"))
    marked = marked.withColumn("start", F.when(F.col("prev").isNull() | (F.col("us") - F.col("prev") > width), F.col("us")))
    starts = marked.groupBy("path", "hour").agg(F.max("start").alias("s"))
    carried = starts.select("path", "hour", F.max("s").over(by_hour.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    running = within.rangeBetween(Window.unboundedPreceding, 0)
    runs = marked.withColumn("own", F.max("start").over(running)).join(carried, ["path", "hour"]).withColumn("run", F.coalesce("own", "carried"))
    placed = runs.select("path", "ts", "us", "run").repartition("path", "run").sortWithinPartitions("path", "run", "us")
    kind = dict(attempts.dtypes)[ts]
    out = placed.select("path", "ts", "us").mapInArrow(lambda it: _admit(it, most, width), f"path string, ts {kind}, us long, allowed boolean")
    return out.select("path", "ts", "allowed")


def follow(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = "2 seconds") -> StreamingQuery:
    """Apply each batch's last change per path with ``apply(changes, batch number)``.

    ``apply`` must be repeatable: after a failure a batch comes again with the same number.
    """

    def batch(df: DataFrame, n: int) -> None:
        last = df.groupBy("path").agg(F.max_by("deleted", "ts").alias("deleted"), F.max("ts").alias("ts"))
        apply(last, n)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


STATUS = "path string, status string, at timestamp"


def statuses(spark: SparkSession, store) -> DataFrame:
    """What became of each change that was applied, as (path, status, at): the parser's status, ``deleted``, ``refused``, or why a file
    could not be read."""
    return spark.read.schema(STATUS).parquet(f"{store.base}/status") if store.has("status") else spark.createDataFrame([], STATUS)


def apply_to_store(spark: SparkSession, store, root: str, settings: Settings = Settings(), embedder=None, pdf_pages=None) -> Callable[[DataFrame, int], None]:
    """The function for ``follow`` that reads the changed notes, and no others, anew and replaces their rows in ``store``.

    A generation is published once, vectors and resolved links included. A path that cannot be read keeps its rows and takes none of the
    others with it; one that failed ``breaker_attempts`` times within ``breaker_window_s`` is refused until the window has passed. ``statuses`` has what became of each.
    """
    from marginalia.functions.lineage import Scratch, scratch_scope
    from marginalia.providers import HashingEmbedder
    from marginalia.sources.notes import read_notes, resolved, stored_tables, tables_of

    def relinked(links: DataFrame, catalog: DataFrame, aliases: DataFrame) -> DataFrame:
        external = F.col("link_type") == "external"
        open_ = links.withColumns({"to_note_path": F.when(external, F.col("to_note_path")).otherwise(""), "is_resolved": external})
        return resolved(open_, catalog, aliases)

    def apply(changes: DataFrame, n: int) -> None:
        with scratch_scope():
            run(changes)

    def run(changes: DataFrame) -> None:
        disk = Scratch(spark, "changes")
        own = disk.table(changes.select("path", "deleted"))
        if own.isEmpty():
            return
        since = F.current_timestamp() - F.make_dt_interval(secs=F.lit(settings.breaker_window_s))
        failed = statuses(spark, store).where(F.col("status").startswith("failed") & (F.col("at") > since)).groupBy("path").agg(F.count("*").alias("n"))
        refused = disk.table(failed.where(F.col("n") >= settings.breaker_attempts).join(own, "path", "left_semi").select("path"))
        files = disk.table(read_notes(own.where("NOT deleted").join(refused, "path", "left_anti"), root))
        good = files.where("problem IS NULL").drop("problem")
        corpus = tables_of(good, settings, pdf_pages)
        changed = stored_tables(corpus, settings, embedder or HashingEmbedder())
        changed |= {t: disk.table(changed[t]) for t in ("chunks", "links")}
        gone = own.where("deleted").select("path").unionByName(files.where("problem = 'missing'").select("path"))
        store.replace_notes(changed, gone, relinked)

        unread = files.where("problem IS NOT NULL").select("path", F.when(F.col("problem") == "missing", "deleted").otherwise(F.concat(F.lit("failed: "), "problem")).alias("status"))
        said = corpus.parsed.select("path", F.when(F.col("status_of_file") == "error", "failed: unreadable").otherwise(F.col("status_of_file")).alias("status"))
        every = said.unionByName(unread).unionByName(own.where("deleted").select("path", F.lit("deleted").alias("status"))).unionByName(refused.select("path", F.lit("refused").alias("status")))
        every.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{store.base}/status")

    return apply
