"""Documents processed as they arrive (O4) and latest status per document.

The grouping scope is one document, so a micro-batch needs nothing from
earlier batches: ``foreachBatch`` runs the batch plan (parse, group, outcome)
on each micro-batch and appends its tables. Each batch's output goes to its
own ``batch_id`` partition with dynamic partition overwrite, so a batch that is
replayed after a failure replaces its own rows instead of duplicating them
(with the query checkpoint this gives exactly-once tables).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoset.operators.report import RUN_TTL_MINUTES, document_outcomes, live_runs
from echoset.session import ensure_checkpoint_dir
from echoset.sources.documents import DEFAULT_ELEMENTS, DEFAULT_THRESHOLD, lines_as_xml


def xml_file_stream(spark: SparkSession, path: str) -> DataFrame:
    """O4 source: one row per arriving file, ``doc_id`` = path, ``xml`` = content."""
    return (spark.readStream.format("text").option("wholetext", "true").load(path)
            .select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("xml")))


def text_table_stream(spark: SparkSession, path: str, schema: T.StructType, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """O4 source over a growing parquet table of plain texts; lines become ``<p>`` elements."""
    rows = spark.readStream.schema(schema).parquet(path)
    return lines_as_xml(rows.select(id_col, text_col), text_col, id_col)


def _writer(out_dir: str, elements: str, threshold: float, group_kw: dict):
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        outcomes, members = document_outcomes(batch, elements, threshold, **group_kw)
        stamp = F.current_timestamp()
        for name, df in (("runs", outcomes.withColumn("created_at", stamp)), ("groups", members)):
            (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
             .parquet(f"{out_dir}/{name}"))
    return write_batch


def start_document_stream(stream: DataFrame, out_dir: str, checkpoint: str | None = None,
                          elements: str = DEFAULT_ELEMENTS, threshold: float = DEFAULT_THRESHOLD,
                          available_now: bool = True, **group_kw):
    """Run the batch plan on every micro-batch of ``(doc_id, xml)`` rows.

    Writes ``{out_dir}/runs`` (one outcome row per document) and
    ``{out_dir}/groups`` (grouped passages). ``checkpoint`` defaults to a
    fresh folder under the session's ``spark.checkpoint.dir``.
    """
    spark = stream.sparkSession
    if checkpoint is None:
        checkpoint = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.foreachBatch(_writer(out_dir, elements, threshold, group_kw)).option(
        "checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def latest_status(runs: DataFrame, as_of=None, ttl_minutes: int = RUN_TTL_MINUTES) -> DataFrame:
    """The newest outcome of each document, dropping expired ones when ``as_of`` is given.

    ``max_by`` keeps one row per document without a window over the document's
    history.
    """
    if as_of is not None:
        runs = live_runs(runs, as_of, ttl_minutes)
    cols = [c for c in runs.columns if c != "doc_id"]
    latest = runs.groupBy("doc_id").agg(
        F.max_by(F.struct(*cols), F.struct("created_at", "batch_id")).alias("_r"))
    return latest.select("doc_id", "_r.*")


def latest_status_stateful(runs: DataFrame, ttl_minutes: int = RUN_TTL_MINUTES) -> DataFrame:
    """O5 on a stream of outcome rows: the newest status per document, kept in
    state for ``ttl_minutes`` after its last update (processing time).

    ``runs`` is a streaming DataFrame with ``doc_id, status, n_groups,
    created_at``. Each update emits the document's current status; when a
    document's time-to-live passes without news its state is dropped and one
    final row with ``expired = true`` is emitted. State per document is one
    small tuple, spread over the cluster by ``doc_id``.

    Timeouts fire in no-data micro-batches, so a continuously triggered query
    expires documents on time; a run-to-completion (``availableNow``) query
    must set ``spark.sql.streaming.noDataMicroBatches.enabled=false``, or it
    keeps servicing the pending timeouts instead of finishing.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    id_type = runs.schema["doc_id"].dataType.simpleString()
    out_schema = f"doc_id {id_type}, status string, n_groups bigint, created_at timestamp, expired boolean"
    state_schema = "status string, n_groups bigint, created_at timestamp"
    ttl_ms = int(ttl_minutes) * 60 * 1000

    def step(key, batches, state):
        if state.hasTimedOut:
            status, n_groups, created = state.get
            state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "status": [status], "n_groups": [n_groups],
                                "created_at": [created], "expired": [True]})
            return
        best = state.get if state.exists else None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            row = pdf.loc[pdf["created_at"].idxmax()]
            if best is None or row["created_at"] >= pd.Timestamp(best[2]):
                best = (row["status"], int(row["n_groups"]), row["created_at"].to_pydatetime())
        if best is None:
            return
        state.update(best)
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"doc_id": [key[0]], "status": [best[0]], "n_groups": [best[1]],
                            "created_at": [best[2]], "expired": [False]})

    return (runs.select("doc_id", "status", F.col("n_groups").cast("bigint").alias("n_groups"), "created_at")
            .groupBy("doc_id")
            .applyInPandasWithState(step, out_schema, state_schema, "update", GroupStateTimeout.ProcessingTimeTimeout))


RUN_BUCKETS = 2048  # lists that the runs alive are dealt over


def status_by_creation(events: DataFrame, ttl_minutes: int = RUN_TTL_MINUTES, late: str = "3 hours") -> DataFrame:
    """O5 by creation time: each run's status while it lives, from a stream of status events.

    ``events``: ``doc_id, status, n_groups, created_at, at`` (``at``: the time of the event; a run's first is
    ``PROCESSING``). Time is the watermark, ``late`` behind the newest event, not the clock: the status with the newest ``at`` counts, a run
    expires once the watermark is past ``created_at`` + ``ttl_minutes`` (strictly), and news for a run that has
    expired change nothing. Events further back than ``late`` may be dropped, as with any watermark. Emits ``doc_id, status, n_groups, created_at, expired`` at each change. The
    runs alive are kept in ``RUN_BUCKETS`` lists by a hash of the id, so a micro-batch costs a few Python calls and not one a
    run; a list's event-time timer fires for its first run to expire.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    id_type = events.schema["doc_id"].dataType.simpleString()
    ttl_ms = int(ttl_minutes) * 60 * 1000

    def step(_key, batches, state):
        names = ("ids", "status", "n_groups", "created_ms", "at_ms")
        runs = {r[0]: r[1:] for r in zip(*state.get)} if state.exists else {}
        now = state.getCurrentWatermarkMs()
        news: dict = {}
        for pdf in batches:
            for doc_id, *row in zip(pdf["id"], pdf["at_ms"], pdf["created_ms"], pdf["status"], pdf["n_groups"]):
                news.setdefault(None if pd.isna(doc_id) else doc_id, []).append((int(row[0]), int(row[1]), row[2], int(row[3])))
        out = []
        for doc_id, rows in news.items():
            held = runs.get(doc_id)
            at, created, status, n = max(rows)
            created = min(r[1] for r in rows) if held is None else held[2]
            if created + ttl_ms < now:  # it has expired: the news came too late
                if held is not None:
                    status, n = held[0], held[1]
                    del runs[doc_id]
                out.append((doc_id, status, n, created, True))
                continue
            if held is not None and held[3] > at:
                status, n, at = held[0], held[1], held[3]
            runs[doc_id] = (status, n, created, at)
            out.append((doc_id, status, n, created, False))
        for doc_id in [d for d, r in runs.items() if r[2] + ttl_ms < now]:
            status, n, created, _at = runs.pop(doc_id)
            out.append((doc_id, status, n, created, True))
        if runs:
            state.update(tuple(map(list, zip(*((d, *r) for d, r in runs.items())))))
            state.setTimeoutTimestamp(min(r[2] for r in runs.values()) + ttl_ms)  # the first to expire
        elif state.exists:
            state.remove()
        if out:
            cols = dict(zip(("id", *names[1:4], "expired"), zip(*out)))
            yield pd.DataFrame({"id": pd.Series(cols["id"], dtype=object), "status": cols["status"], "n_groups": cols["n_groups"],
                                "created_at": pd.to_datetime(pd.Series(cols["created_ms"]), unit="ms"), "expired": cols["expired"]})

    timed = events.withWatermark("at", late).select(
        F.col("doc_id").cast("string").alias("id"), "status", F.col("n_groups").cast("bigint").alias("n_groups"), "at",
        F.unix_millis("at").alias("at_ms"), F.unix_millis("created_at").alias("created_ms"),
        F.pmod(F.xxhash64("doc_id"), F.lit(RUN_BUCKETS)).alias("bucket"))
    changes = timed.groupBy("bucket").applyInPandasWithState(
        step, "id string, status string, n_groups bigint, created_at timestamp, expired boolean",
        "ids array<string>, status array<string>, n_groups array<bigint>, created_ms array<bigint>, at_ms array<bigint>",
        "update", GroupStateTimeout.EventTimeTimeout)
    return changes.select(F.col("id").cast(id_type).alias("doc_id"), "status", "n_groups", "created_at", "expired")


def start_status_stream(events: DataFrame, out_dir: str, checkpoint: str | None = None, **kw):
    """Run :func:`status_by_creation` over what has arrived and write its changes to ``{out_dir}`` by batch."""
    if checkpoint is None:
        checkpoint = f"{ensure_checkpoint_dir(events.sparkSession)}/status-{uuid.uuid4().hex}"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_dir))

    return (status_by_creation(events, **kw).writeStream.outputMode("update").foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_states(changes: DataFrame) -> DataFrame:
    """The last change of each document."""
    cols = [c for c in changes.columns if c not in ("doc_id", "batch_id")]
    return changes.groupBy("doc_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("_r")).select("doc_id", "_r.*")
