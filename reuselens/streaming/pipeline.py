"""Streaming admission, audit rates, dedupe and ledger.

Correctness contract: on the same log, every streaming output equals the
batch output of ``reuselens.operators`` (tests/test_streaming.py)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import admission, search
from ..operators.decisions import EXACT_KEY, SCOPE
from ..operators.ledger import SEGMENT_ROWS, budget_ledger
from ..session import materialize
from ..sources import commits
from ..sources import serving as S


def stage_request_files(requests: DataFrame, path: str, files: int = 4) -> None:
    """Write requests as ``files`` parquet files ordered by time: the file
    source then replays them in arrival order."""
    (requests.repartitionByRange(files, "ts").sortWithinPartitions("ts", "request_id")
     .write.mode("overwrite").parquet(path))


def dedupe_requests(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A request id seen twice within the watermark delay is dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


def admission_stream(stream: DataFrame, entries: DataFrame, out_path: str, checkpoint: str,
                     tau: float = S.TAU, k: int = S.TOP_K):
    """Each micro-batch searches the snapshot cache (a static table,
    stream-static) and writes its decisions to ``out_path/batch=<id>`` with
    overwrite, so a retried batch replaces its own output."""

    def run(batch: DataFrame, batch_id: int) -> None:
        cands = search.topk_candidates(batch, entries, SCOPE, k, req_id="request_id", entry_id="entry_id",
                                       vec="embedding", req_time="ts", entry_time="created_at")
        cands = cands.join(entries.select("entry_id", "entry_constraints"), "entry_id")
        dec = admission.admit(batch.select("request_id", "constraints"), cands, tau)
        dec.drop("trail").withColumn("batch_id", F.lit(batch_id)) \
            .write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


ENTRY_COLS = ["entry_id", "created_at", *SCOPE, "embedding", "entry_constraints"]


def serving_stream(stream: DataFrame, root: str, checkpoint: str, tau: float = S.TAU, k: int = S.TOP_K,
                   snapshot: DataFrame | None = None):
    """Micro-batches that search the cache and add to it. A request sees
    the entries that earlier batches committed, and those of ``snapshot``
    (``ENTRY_COLS``), written before it. Decisions and the entries of the misses that
    store a response (``writes``) become visible in one commit, so a batch that is
    killed leaves neither, and its repeat, which reads the same earlier batches, gives
    the same rows once. ``stream``: request_id, ts, the scope columns, embedding,
    constraints, writes. Read the results with ``commits.read_committed(spark, root,
    "decisions" | "entries")``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in commits.committed(spark, root):
            return
        new = batch.filter("writes").select(F.col("request_id").alias("entry_id"), F.col("ts").alias("created_at"), *SCOPE,
                                            "embedding", F.col("constraints").alias("entry_constraints"))
        parts = [x.select(*ENTRY_COLS) for x in (snapshot, commits.read_committed(spark, root, "entries", before=batch_id)) if x is not None]
        entries = parts[0] if parts else new.limit(0)
        for x in parts[1:]:
            entries = entries.unionByName(x)
        cands = search.topk_candidates(batch, entries, SCOPE, k, req_id="request_id", entry_id="entry_id",
                                       vec="embedding", req_time="ts", entry_time="created_at")
        cands = cands.join(entries.select("entry_id", "entry_constraints"), "entry_id")
        dec = materialize(admission.admit(batch.select("request_id", "constraints"), cands, tau), "served")
        stored = new.join(dec.filter(F.col("decision").startswith("MISS")).select(F.col("request_id").alias("entry_id")),
                          "entry_id", "left_semi")
        commits.commit_batch(spark, root, batch_id, {"decisions": dec.withColumn("batch_id", F.lit(batch_id)), "entries": stored})

    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def audit_rate_stream(decisions: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """T4: audited / failed hits per (day window, decision), append mode
    after the watermark closes a window."""
    hits = decisions.filter(F.col("decision").isin("HIT_EXACT", "HIT_SEMANTIC"))
    return (hits.withWatermark("ts", delay)
            .groupBy(F.window("ts", window).alias("w"), "decision")
            .agg(F.count_if(F.col("output_audit_ok").isNotNull()).alias("audited"),
                 F.count_if(~F.col("output_audit_ok")).alias("failures"))
            .select(F.col("w.start").alias("window_start"), "decision", "audited", "failures",
                    F.round(F.try_divide(F.col("failures"), F.col("audited")), 6).alias("failure_rate")))


def _read_table(spark, path: str):
    """A table that an earlier batch wrote, or none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return spark.read.parquet(path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def ledger_stream(events: DataFrame, budgets: DataFrame, out_path: str, checkpoint: str, strict_refund: bool = False,
                  segment_rows: int = SEGMENT_ROWS):
    """T5: the budget ledger in micro-batches that arrive in time order. A
    batch runs through the batch ledger, which cuts it into segments of at most
    ``segment_rows`` rows, from the balances that the batch before it left;
    these are one row per tenant, written with the batch. Rows go to
    ``out_path/rows/batch=<id>`` and balances to ``out_path/balances/batch=<id>``;
    a repeated batch reads the same balances and replaces its own output.
    ``events`` as in ``budget_ledger``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _read_table(spark, f"{out_path}/balances/batch={batch_id - 1}")
        rows = budget_ledger(batch, budgets, strict_refund, before, segment_rows)
        rows.write.mode("overwrite").parquet(f"{out_path}/rows/batch={batch_id}")
        now = spark.read.parquet(f"{out_path}/rows/batch={batch_id}").groupBy("tenant_id").agg(
            F.max_by("spent_after", F.struct("ts", "request_id")).alias("spent_after"))
        if before is not None:
            now = now.unionByName(before.join(now, "tenant_id", "left_anti"))
        now.write.mode("overwrite").parquet(f"{out_path}/balances/batch={batch_id}")

    return (events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY = T.StructType([T.StructField("entry_id", T.LongType()), T.StructField("created_us", T.LongType())])
EXACT_OUT = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("exact_hit", T.BooleanType()),
    T.StructField("exact_entry_id", T.LongType())])


class ExactCache(StatefulProcessor):
    """The cache entry of one exact key, as it grows.

    The state is the key's first writer. A request hits if that was written
    strictly before it; else, if it stores a response (``writes``), it becomes the
    writer. Once a key has an entry, its rows pass through without being held.
    Before that, a micro-batch's rows of the key are held as two numbers each,
    since they come in no order; how large a micro-batch is, the source's
    options say. ``ttl_ms`` forgets an entry that long after it was stored."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", ENTRY, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        kept = self.entry.get() if self.entry.exists() else None
        held = []
        for pdf in rows:
            if kept is not None:
                yield self._answers(pdf.request_id, pdf.ts_us, kept)
            else:
                held.append(pdf[["request_id", "ts_us", "writes"]])
        if not held:
            return
        pdf = pd.concat(held)
        writers = pdf[pdf.writes].sort_values(["ts_us", "request_id"])
        if len(writers):
            kept = (int(writers.request_id.iloc[0]), int(writers.ts_us.iloc[0]))
            self.entry.update(kept)
        yield self._answers(pdf.request_id, pdf.ts_us, kept)

    @staticmethod
    def _answers(ids, ts, kept) -> pd.DataFrame:
        hit = ts > kept[1] if kept is not None else ts != ts
        return pd.DataFrame({"request_id": ids, "exact_hit": hit,
                             "exact_entry_id": pd.array([kept[0] if h else None for h in hit], "Int64")})

    def close(self) -> None:
        pass


def exact_match_stream(requests: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """``(request_id, exact_hit, exact_entry_id)`` of a stream of requests
    against the cache that they build. ``requests``: request_id, ts, the
    columns of ``EXACT_KEY``, ``writes`` (whether the request stores a response
    unless it hits). State is one entry per exact key, spread over tasks by the
    whole key, so a busy tenant is no hot key. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``: ``STATE_STORE``)."""
    keyed = requests.select("request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "writes", *EXACT_KEY)
    return keyed.groupBy(*EXACT_KEY).transformWithStateInPandas(
        ExactCache(ttl_ms), EXACT_OUT, "Append", "None" if ttl_ms is None else "ProcessingTime")
