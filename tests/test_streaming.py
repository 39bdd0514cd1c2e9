"""Streaming result = batch result on the same request log (sf0.001)."""

import uuid

from pyspark.sql import functions as F

from reuselens.operators import decisions as D, ledger as L
from reuselens.session import scratch_path
from reuselens.sources import serving as S
from reuselens.streaming import pipeline as P

SF = "/root/testdata/sf0.001"


def _dir(spark, name):
    return scratch_path(spark, f"test-{name}-{uuid.uuid4().hex}")


def _write_in_time_order(df, path, cuts):
    """Sequential writes, so file modification order = time order."""
    lo = None
    for c in cuts + [None]:
        part = df
        if lo is not None:
            part = part.filter(F.col("ts") >= lo)
        if c is not None:
            part = part.filter(F.col("ts") < c)
        part.coalesce(1).write.mode("append").parquet(path)
        lo = c


def test_ledger_stream_equals_batch(spark):
    ev = D.replay(spark, SF)["decisions"].select(
        "tenant_id", "request_id", "ts", "is_miss", "upstream_error", "est_cost", "real_cost")
    tenants = S.tenants(spark, SF)
    want = {r.request_id: (r.outcome, r.spent_after) for r in L.budget_ledger(ev, tenants).collect()}
    src = _dir(spark, "ledger-src")
    _write_in_time_order(ev, src, ["2024-01-08", "2024-01-16", "2024-01-24"])
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = _dir(spark, "ledger-out")
    q = P.ledger_stream(stream, tenants, out, _dir(spark, "ledger-ckpt"), segment_rows=50)
    q.awaitTermination(600)
    got = spark.read.parquet(f"{out}/rows")
    assert {r.request_id: (r.outcome, r.spent_after) for r in got.collect()} == want
    assert got.select("batch").distinct().count() == 4 and len({o for o, _ in want.values()}) >= 3


def test_a_repeated_ledger_batch_replaces_itself(spark):
    import datetime as dt
    from decimal import Decimal
    rows = [(t, i, dt.datetime(2024, 1, 1, 0, i), True, False, Decimal("0.5"), Decimal("0.4")) for i in range(9) for t in (1, 2)]
    ev = spark.createDataFrame(rows, "tenant_id long, request_id long, ts timestamp, is_miss boolean, "
                                     "upstream_error boolean, est_cost decimal(10,6), real_cost decimal(10,6)")
    limits = spark.createDataFrame([(1, Decimal(2)), (2, Decimal(9))], "tenant_id long, budget_cents decimal(12,4)")
    src, out, ckpt = (_dir(spark, n) for n in ("twice-src", "twice-out", "twice-ckpt"))
    _write_in_time_order(ev, src, [dt.datetime(2024, 1, 1, 0, 3), dt.datetime(2024, 1, 1, 0, 6)])
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    P.ledger_stream(stream, limits, out, ckpt).awaitTermination(600)
    first = sorted(map(tuple, spark.read.parquet(f"{out}/rows").collect()))
    # the last batch's commit is lost: the stream runs that batch again
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ckpt}/commits/2")
    assert hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, False)
    P.ledger_stream(stream, limits, out, ckpt).awaitTermination(600)
    assert sorted(map(tuple, spark.read.parquet(f"{out}/rows").collect())) == first and len(first) == 18


def test_growing_exact_cache_equals_batch_over_a_restart(spark):
    rp = D.replay(spark, SF)
    wrote = rp["entries"].select(F.col("entry_id").alias("request_id"), F.lit(True).alias("writes"))
    log = (rp["decisions"].select("request_id", "ts", *D.EXACT_KEY, "decision", "candidate_id")
           .join(wrote, "request_id", "left").na.fill(False, ["writes"]))
    want = {r.request_id: r.candidate_id for r in log.filter("decision = 'HIT_EXACT'").collect()}
    fed = log.drop("decision", "candidate_id")
    src, out, ckpt = (_dir(spark, n) for n in ("exact-src", "exact-out", "exact-ckpt"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.STATE_STORE)
    try:
        for lo, hi, cuts in (("2000-01-01", "2024-01-13", ["2024-01-05", "2024-01-09"]), ("2024-01-13", "2100-01-01", ["2024-01-20", "2024-01-26"])):
            _write_in_time_order(fed.filter((F.col("ts") >= lo) & (F.col("ts") < hi)), src, cuts)
            stream = spark.readStream.schema(fed.schema).option("maxFilesPerTrigger", 1).parquet(src)
            q = (P.exact_match_stream(stream).writeStream.format("parquet").option("path", out)
                 .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start())
            q.awaitTermination(600)  # then the query starts anew from its checkpoint
            assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = spark.read.parquet(out).collect()
    assert len(got) == fed.count()
    assert {r.request_id: r.exact_entry_id for r in got if r.exact_hit} == want and len(want) > 100


def test_late_rows_are_dropped_and_counted(spark):
    import datetime as dt
    hits = [[(dt.datetime(2024, 1, 1, h), "HIT_EXACT", h % 3 == 0) for h in range(24)],
            [(dt.datetime(2024, 1, 4, 5), "HIT_SEMANTIC", True)],
            [(dt.datetime(2024, 1, 4, 5, 30), "HIT_SEMANTIC", None)],  # lateness is that of the batch before
            [(dt.datetime(2024, 1, 1, 23, 59), "HIT_EXACT", False), (dt.datetime(2024, 1, 4, 6), "HIT_SEMANTIC", False)],
            [(dt.datetime(2024, 1, 9), "HIT_EXACT", None)]]
    schema = "ts timestamp, decision string, output_audit_ok boolean"
    src = _dir(spark, "late-src")
    for rows in hits:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = "late_" + uuid.uuid4().hex[:8]
    q = (P.audit_rate_stream(stream).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", _dir(spark, "late-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = {(str(r.window_start)[:10], r.decision): (r.audited, r.failures) for r in spark.table(name).collect()}
    assert got == {("2024-01-01", "HIT_EXACT"): (24, 16), ("2024-01-04", "HIT_SEMANTIC"): (2, 1)}  # the last day is still open
    assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) == 1


def test_audit_rate_stream_equals_batch(spark):
    log = D.decision_log(spark, SF).select("request_id", "ts", "decision", "output_audit_ok")
    src = _dir(spark, "audit-src")
    log.write.parquet(src)
    stream = spark.readStream.schema(log.schema).parquet(src)
    name = "audit_" + uuid.uuid4().hex[:8]
    q = (P.audit_rate_stream(stream).writeStream.format("memory").queryName(name).outputMode("complete")
         .option("checkpointLocation", _dir(spark, "audit-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = {(r.window_start, r.decision): (r.audited, r.failures) for r in spark.table(name).collect()}
    hits = log.filter(F.col("decision").isin("HIT_EXACT", "HIT_SEMANTIC"))
    want = hits.groupBy(F.window("ts", "1 day").start.alias("s"), "decision").agg(
        F.count_if(F.col("output_audit_ok").isNotNull()).alias("a"), F.count_if(~F.col("output_audit_ok")).alias("f"))
    want = {(r.s, r.decision): (r.a, r.f) for r in want.collect()}
    assert got == want and len(got) > 0


def test_dedupe_stream_one_row_per_request(spark):
    r = S.requests(spark, SF).select("request_id", "ts")
    src = _dir(spark, "dedupe-src")
    r.write.parquet(src)
    r.write.mode("append").parquet(src)  # every request twice
    stream = spark.readStream.schema(r.schema).parquet(src)
    name = "dedupe_" + uuid.uuid4().hex[:8]
    q = (P.dedupe_requests(stream).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", _dir(spark, "dedupe-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = spark.table(name)
    assert got.count() == r.count() == got.select("request_id").distinct().count()


def test_admission_stream_equals_batch(spark):
    rp = D.replay(spark, SF)
    x = rp["decisions"].filter(F.col("decision") != "HIT_EXACT")
    misses = (rp["requests"].join(x.select("request_id"), "request_id")
              .join(S.conv_embeddings(spark, SF), "conv_id")
              .select("request_id", "ts", *D.SCOPE, "embedding", "constraints"))
    # only a miss that succeeded wrote an entry
    entries = misses.join(rp["entries"].select(F.col("entry_id").alias("request_id")), "request_id", "left_semi").select(
        F.col("request_id").alias("entry_id"), F.col("ts").alias("created_at"), *D.SCOPE, "embedding",
        F.col("constraints").alias("entry_constraints"))
    src = _dir(spark, "adm-src")
    misses.write.parquet(src)
    out = _dir(spark, "adm-out")
    q = P.admission_stream(spark.readStream.schema(misses.schema).parquet(src), entries, out, _dir(spark, "adm-ckpt"))
    q.awaitTermination(600)
    got = {r.request_id: (r.decision, r.candidate_id) for r in spark.read.parquet(out).collect()}
    want = {r.request_id: (r.decision, r.candidate_id) for r in x.collect()}
    assert got == want
