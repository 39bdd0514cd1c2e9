"""Replay of the request log into decisions.

The cache grows as the log is served: a request is HIT_EXACT when its exact
key (tenant, prompt_hash, model, params_hash) was written before it; otherwise
it searches the entries of its scope (tenant, model, params_hash, embedding
model) that were written before it, and the admission fold over the top k by
cosine decides. Only a miss whose upstream call succeeded writes an entry: a
semantic hit, a budget rejection and an upstream error write none.

Who writes depends on the decisions, and they on who wrote earlier. The replay
decides the whole log once, in parallel, from a guess of the writers, and then
evaluates differences only (semi-naive): the writers that changed name the
requests that see one of them (a candidate that is gone, a new one that is near
enough, the entry of its key), and only those are decided again; only requests
that lost a candidate are searched anew, the others merge the new entries into
the candidates that they have. Few rounds do where writers depend little on each
other. Where a round has not halved the requests that see a change, a change
whose own request sees another one waits, as it may yet be taken back: that goes
forward in time, so the earliest change never waits, every round settles some,
and a long chain of dependent writers is decided link by link and not over and
over. The ledger is
folded again from the first request of a tenant that became a miss or ceased to
be one. The only state that agrees with itself is that of serving one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import audit as U
from ..functions.keys import MODEL_RATES, DEFAULT_RATE, token_cost_cents
from ..session import intermediates, materialize
from ..sources import serving as S
from . import admission, search

EXACT_KEY = ["tenant_id", "prompt_hash", "model", "params_hash"]
SCOPE = ["tenant_id", "model", "params_hash", "embedding_model"]
#: Digests of the exact key and of the scope: the replay shuffles these and not the columns.
KEY = ["key_digest", "key_has_null"]
DIGESTS = [*KEY, "scope_digest"]


def with_digests(reqs: DataFrame) -> DataFrame:
    """``DIGESTS`` beside the columns. Nulls are alike in a key, but a key that holds one equals no other; a scope that holds one has no digest."""
    digest = lambda cols: F.unhex(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256))
    has_null = lambda cols: F.exists(F.array(*[F.col(c).isNull() for c in cols]), lambda x: x)
    return (reqs.withColumn("key_digest", digest(EXACT_KEY)).withColumn("key_has_null", has_null(EXACT_KEY))
            .withColumn("scope_digest", F.when(~has_null(SCOPE), digest(SCOPE))))


def resolve_tenants(reqs: DataFrame, tenants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """api_key_hash -> tenant. Unknown keys go to a reject output and
    are not logged. The tenant table has one row per tenant."""
    t = tenants.select("api_key_hash", "tenant_id", "budget_cents")
    ok = reqs.drop("tenant_id").join(t, "api_key_hash")
    rejects = reqs.join(t.select("api_key_hash"), "api_key_hash", "left_anti")
    return ok, rejects


def with_rates(df: DataFrame, model_col: str = "model") -> DataFrame:
    """P14 rate lookup: a literal per-model table with a default."""
    rates = F.create_map(*[x for m, i, o in MODEL_RATES for x in (F.lit(m), F.array(F.lit(i), F.lit(o)))])
    r = F.element_at(rates, F.col(model_col))
    return (df.withColumn("in_rate", F.coalesce(r[0], F.lit(DEFAULT_RATE[0])))
            .withColumn("out_rate", F.coalesce(r[1], F.lit(DEFAULT_RATE[1]))))


SHRINK = 0.5  # of the requests that see a change, from one round to the next; more, and dependent changes wait
SEMANTIC_MISSES = ["MISS_LOW_SIM", "MISS_GATE", "MISS_NO_CANDIDATE"]


def replay(spark: SparkSession, sf_dir: str, tau: float = S.TAU, k: int = S.TOP_K, strict_refund: bool = False) -> dict:
    """Serves the request log of the driver tables (see ``replay_log``)."""
    tenants = S.tenants(spark, sf_dir)
    reqs, rejects = resolve_tenants(S.keyed_requests(spark, sf_dir, with_constraints=True), tenants)
    # the long texts are not needed any more (keys, constraints and the audit's list-noun flag are computed)
    vectors = materialize(S.conv_embeddings(spark, sf_dir).withColumn("vec_key", F.monotonically_increasing_id()), "vectors")
    reqs = materialize(with_digests(with_costs(reqs.drop("messages", "request_text", "prompt_normalized")
                                               .join(vectors.select("conv_id", "vec_key"), "conv_id"))), "requests")
    return {"rejects": rejects, **replay_log(reqs, tenants, tau, k, strict_refund, vectors.select("vec_key", "embedding"))}


def _decided(misses: DataFrame, cands: DataFrame, hits: DataFrame, tau: float) -> DataFrame:
    """Decisions of searched requests and of exact hits ``(request_id, exact_entry_id)``."""
    sem = admission.admit(misses.select("request_id", "constraints"), cands, tau)
    exact = hits.select(
        "request_id", F.lit("HIT_EXACT").alias("decision"), F.col("exact_entry_id").alias("candidate_id"),
        F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("boolean").alias("gate_passed"),
        F.lit(0).alias("gate_checked"), F.lit(None).alias("trail"))
    return exact.unionByName(sem, allowMissingColumns=True).withColumn("is_miss", F.col("decision").isin(*SEMANTIC_MISSES))


def replay_log(reqs: DataFrame, tenants: DataFrame, tau: float = S.TAU, k: int = S.TOP_K, strict_refund: bool = False,
               vectors: DataFrame | None = None) -> dict:
    """Serves a log of resolved requests with their keys, constraints,
    embeddings and costs: the final requests, entries, candidates, decisions
    and ledger, the number of ``rounds``, and how many requests were ``decided``
    and ``searched`` in all of them. The embeddings are a column of ``reqs`` or, with
    ``vectors`` (vec_key, embedding; a key is there once), named by its ``vec_key``. Only a search
    joins them to its requests and entries; no other shuffle of requests carries them."""
    if vectors is None:
        reqs = materialize(reqs.withColumn("vec_key", F.monotonically_increasing_id()), "requests")
        vectors, reqs = reqs.select("vec_key", "embedding"), reqs.drop("embedding")
    if not set(DIGESTS) <= set(reqs.columns):
        reqs = with_digests(reqs)
    with intermediates(reqs.sparkSession) as drop_but:
        return _replayed(reqs, tenants, tau, k, strict_refund, vectors, drop_but)


def _replayed(reqs, tenants, tau, k, strict_refund, vectors, drop_but) -> dict:
    """The rounds of ``replay_log``; what a step wrote goes once nothing later reads it."""
    from .ledger import budget_ledger
    charge = ["tenant_id", "request_id", "ts", "is_miss", "upstream_error", "est_cost", "real_cost"]

    def entries_of(w):
        return reqs.join(w.select(F.col("entry_id").alias("request_id")), "request_id", "left_semi").select(
            F.col("request_id").alias("entry_id"), F.col("ts").alias("created_at"), "scope_digest", "vec_key",
            F.col("constraints").alias("entry_constraints"))

    def searched(requests, ent):
        found = materialize(search.topk_of_keys(requests, ent, vectors, ["scope_digest"], k, req_time="ts", entry_time="created_at"),
                            "near")
        return found.join(ent.select("entry_id", "entry_constraints"), "entry_id").select(
            "request_id", "entry_id", "rank", "sim", "entry_constraints")

    def only(df, ids):
        return df.join(ids.select("request_id"), "request_id", "left_semi")

    def without(df, ids):
        return df.join(ids.select("request_id"), "request_id", "left_anti")

    def first_of(dec, led, keys=None):
        asked = reqs if keys is None else reqs.join(keys, KEY, "left_semi")
        served = led.filter(F.col("outcome") == "ok").select("request_id").join(
            asked.select("request_id", "ts", *KEY), "request_id").join(dec.filter("is_miss").select("request_id"), "request_id")
        return search.first_writer(served, KEY, "request_id", "ts")

    # first guess: every first request of a key that does not fail is a miss that succeeds
    writers = materialize(search.first_writer(reqs.filter(~F.col("upstream_error")), KEY, "request_id", "ts"), "writers")
    x = materialize(search.exact_match(reqs.select("request_id", "ts", *KEY), writers.filter(~F.col("key_has_null")), KEY)
                    .select("request_id", "exact_hit", "exact_entry_id"), "exact")
    misses = only(reqs, x.filter(~F.col("exact_hit")))
    cands = materialize(searched(misses, entries_of(writers)), "candidates")
    dec = materialize(_decided(misses, cands, x.filter("exact_hit"), tau), "decisions")
    led = materialize(budget_ledger(reqs.join(dec.select("request_id", "is_miss"), "request_id").select(*charge), tenants,
                                    strict_refund), "ledger")
    decided, looked_up, rounds, before = dec.count(), misses.count(), 1, float("inf")
    drop_but(writers, cands, dec, led)
    wrote = materialize(first_of(dec, led), "writers")
    while True:
        rounds += 1
        on = [F.col(f"w.{c}") == F.col(f"n.{c}") for c in KEY]
        changed = materialize(
            writers.alias("w").join(wrote.alias("n"), on, "full_outer")
            .filter(~F.col("w.entry_id").eqNullSafe(F.col("n.entry_id")))
            .select(*[F.coalesce(f"w.{c}", f"n.{c}").alias(c) for c in KEY], F.col("w.entry_id").alias("old"),
                    F.col("n.entry_id").alias("new"), F.col("w.created_at").alias("old_at"), F.col("n.created_at").alias("new_at")),
            "changed")
        if changed.isEmpty():
            drop_but(writers, cands, dec, led)
            served = reqs.drop("vec_key", *DIGESTS)
            of = reqs.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in EXACT_KEY])
            return {"requests": served, "entries": writers.join(of, KEY).select(*EXACT_KEY, "entry_id", "created_at"),
                    "candidates": cands, "decisions": served.join(dec, "request_id"), "ledger": led,
                    "rounds": rounds - 1, "decided": decided, "searched": looked_up}
        drop_but(writers, cands, dec, led, wrote, changed)
        state = dec.select("request_id", "decision", F.col("candidate_id").alias("had"))

        def seen(by):
            """Requests that see a change: exact ones, lost candidates, new near entries."""
            # the entry of the key, before and after
            key = reqs.select("request_id", "ts", *KEY).join(by.filter(~F.col("key_has_null")), KEY).join(state, "request_id")
            key = key.withColumn("exact_hit", F.coalesce(F.col("new_at") < F.col("ts"), F.lit(False)))
            moved = key.filter(F.when(F.col("exact_hit"), (F.col("decision") != "HIT_EXACT") | ~F.col("had").eqNullSafe(F.col("new")))
                               .otherwise(F.col("decision") == "HIT_EXACT")).select(
                "request_id", "exact_hit", F.col("new").alias("exact_entry_id"))
            moved = materialize(moved, "moved")
            missing = without(state.filter("decision <> 'HIT_EXACT'").select("request_id"), moved)
            gone = by.filter("old is not null").select(F.col("old").alias("entry_id"))
            lost = only(cands.join(gone, "entry_id", "left_semi").select("request_id").distinct(), missing)
            again = materialize(lost.unionByName(moved.filter(~F.col("exact_hit")).select("request_id")), "again")
            fresh = entries_of(by.filter("new is not null").select(F.col("new").alias("entry_id")))
            rest = without(only(reqs, missing), again)
            near = materialize(searched(rest, fresh), "near")
            mixed = only(cands, near.select("request_id").distinct()).withColumn("is_new", F.lit(False)).unionByName(
                near.withColumn("is_new", F.lit(True)))
            best = Window.partitionBy("request_id").orderBy(F.desc("sim"), "entry_id")
            mixed = mixed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            mixed = materialize(mixed.withColumn("got", F.max("is_new").over(Window.partitionBy("request_id")))
                                .filter("got").drop("got", "is_new"), "merged")
            return moved, again, mixed

        moved, again, mixed = seen(changed)
        hot = materialize(moved.select("request_id").unionByName(again).unionByName(mixed.select("request_id")).distinct(), "touched")
        n_hot = hot.count()
        waiting, before = n_hot > SHRINK * before, n_hot
        if waiting:
            flag = lambda c: hot.select(F.col("request_id").alias(c), F.lit(True).alias(f"{c}_hot"))
            held = changed.join(flag("old"), "old", "left").join(flag("new"), "new", "left")
            # an entry goes, or comes, only if its own request sees no change; the earlier of two entries of a key decides
            comes = F.col("new").isNotNull() & F.col("new_hot").isNull() & (
                F.col("old").isNull() | (F.col("new_at") <= F.col("old_at")) | F.col("old_hot").isNull())
            goes = F.col("old").isNotNull() & F.col("old_hot").isNull()
            changed = materialize(held.filter(comes | goes).select(
                *KEY, "old", F.when(comes, F.col("new")).alias("new"), "old_at",
                F.when(comes, F.col("new_at")).alias("new_at")), "changed")
            moved, again, mixed = seen(changed)
        keys = changed.select(*KEY)
        writers = materialize(
            writers.join(keys, KEY, "left_anti").unionByName(changed.filter("new is not null").select(
                *KEY, F.col("new").alias("entry_id"), F.col("new_at").alias("created_at"))), "writers")
        fresh = materialize(searched(only(reqs, again), entries_of(writers)), "found")
        redo = materialize(again.unionByName(mixed.select("request_id").distinct()), "redo")
        settled = redo.unionByName(moved.filter("exact_hit").select("request_id"))
        cands = materialize(without(cands, settled).unionByName(fresh).unionByName(mixed), "candidates")
        part = materialize(_decided(only(reqs, redo), only(cands, redo), moved.filter("exact_hit"), tau), "decisions")
        flips = materialize(part.select("request_id", "is_miss").join(
            dec.select("request_id", F.col("is_miss").alias("was")), "request_id").filter("is_miss <> was")
            .join(reqs.select("request_id", "ts", "tenant_id"), "request_id"), "flips")
        dec = materialize(without(dec, part).unionByName(part), "decisions")
        decided, looked_up = decided + part.count(), looked_up + again.count()
        drop_but(writers, cands, dec, led, wrote, flips)
        if flips.isEmpty():
            continue
        # the ledger from the first flip of a tenant on, and the writers of the keys that it or a flip concerns
        place = F.struct("ts", "request_id")
        cut = flips.groupBy("tenant_id").agg(F.min(place).alias("cut"))
        old = led.join(cut, "tenant_id", "left")
        head = old.filter(F.col("cut").isNull() | (place < F.col("cut")))
        start = head.filter("cut is not null").groupBy("tenant_id").agg(F.max_by("spent_after", place).alias("spent_after"))
        tail = reqs.join(cut, "tenant_id").filter(place >= F.col("cut")).join(dec.select("request_id", "is_miss"), "request_id")
        after = materialize(budget_ledger(tail.select(*charge), tenants, strict_refund, start), "ledger")
        drop_but(writers, cands, dec, led, wrote, flips, after)
        other = after.select("request_id", F.col("outcome").alias("now")).join(led.select("request_id", "outcome"), "request_id") \
            .filter("outcome <> now").select("request_id").unionByName(flips.select("request_id")).distinct()
        about = materialize(only(reqs, other).select(*KEY).distinct(), "keys")
        led = materialize(head.drop("cut").unionByName(after), "ledger")
        wrote = materialize(wrote.join(about, KEY, "left_anti").unionByName(first_of(dec, led, about)), "writers")
        drop_but(writers, cands, dec, led, wrote)


def with_audit(dec: DataFrame) -> DataFrame:
    """U9 on every hit: the served entry's response against the request."""
    served = F.when(F.col("decision").isin("HIT_EXACT", "HIT_SEMANTIC"), F.col("candidate_id"))
    d = dec.withColumn("response_text", F.when(served.isNotNull(), S.response_for(served)))
    d = d.withColumn("_props", U.response_properties(F.col("response_text")))
    d = d.withColumn("_audit", U.audit_output(F.col("constraints"), F.col("count_list_type"), F.col("_props")))
    return (d.withColumn("output_audit_ok", F.when(served.isNotNull(), F.col("_audit.ok")))
            .withColumn("output_audit_diff", F.when(served.isNotNull(), F.col("_audit.diff_dims")))
            .drop("_props", "_audit"))


def with_costs(dec: DataFrame) -> DataFrame:
    """Estimate (P13 + max_tokens) and real cost of a miss, in cents,
    decimal(10,6). The real completion is the entry's own response, a
    quarter token per character."""
    d = with_rates(dec)
    resp_tokens = F.ceil(F.length(S.response_for(F.col("request_id"))) / 4)
    return (d.withColumn("est_cost", token_cost_cents(F.col("est_prompt_tokens"), F.col("max_tokens"),
                                                      F.col("in_rate"), F.col("out_rate")).cast("decimal(10,6)"))
            .withColumn("real_cost", token_cost_cents(F.col("est_prompt_tokens"), resp_tokens,
                                                      F.col("in_rate"), F.col("out_rate")).cast("decimal(10,6)"))
            .withColumn("upstream_error", F.col("event_type") == "error")
            .drop("in_rate", "out_rate"))


def decision_log(spark: SparkSession, sf_dir: str, tau: float = S.TAU, k: int = S.TOP_K,
                 strict_refund: bool = False, replayed: dict | None = None) -> DataFrame:
    """One row per resolved request (unknown keys are not logged),
    with budget outcome, audit of served responses and stage timings.
    Timings are a deterministic function of ``events.value`` (the log has
    no clock of its own)."""
    rp = replayed or replay(spark, sf_dir, tau, k, strict_refund)
    d = rp["decisions"].join(rp["ledger"].select("request_id", "outcome", "spent_after", "charged"), "request_id")
    pre = F.col("outcome") == "budget_rejected_preflight"
    final = (F.when(F.col("outcome").startswith("budget_rejected"), F.lit("MISS_BUDGET_EXCEEDED"))
             .when(F.col("outcome") == "upstream_error_refunded", F.lit("MISS_UPSTREAM_ERROR"))
             .otherwise(F.col("decision")))
    d = (d.withColumn("admission_decision", F.col("decision")).withColumn("decision", final)
         .withColumn("candidate_id", F.when(~pre & F.col("decision").isin("HIT_EXACT", "HIT_SEMANTIC"),
                                            F.col("candidate_id")))
         .withColumn("similarity", F.when(~pre, F.col("similarity")))
         .withColumn("gate_passed", F.when(~pre, F.col("gate_passed"))))
    d = with_audit(d)
    v = F.col("value")
    semantic = ~pre & (F.col("admission_decision") != "HIT_EXACT")
    upstream = F.col("decision").isin(*SEMANTIC_MISSES, "MISS_UPSTREAM_ERROR")
    d = (d.withColumn("embed_ms", F.when(semantic, v))
         .withColumn("search_ms", F.when(semantic, v * 0.5))
         .withColumn("gate_ms", F.when(semantic, v * 0.01))
         .withColumn("upstream_ms", F.when(upstream, v * 100.0))
         .withColumn("total_ms", F.when(pre, v * 0.05).when(F.col("decision") == "HIT_EXACT", v * 0.1)
                     .otherwise(v + v * 0.5 + v * 0.01 + F.coalesce(F.col("upstream_ms"), F.lit(0.0)))))
    trail_dims = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(
        F.col("trail"), lambda t: F.split(t["diff_dims"], r"\|"))))), "|")
    return d.select(
        "request_id", "tenant_id", "ts", F.to_date("ts").alias("dt"), "decision", "admission_decision",
        "candidate_id", F.round("similarity", 6).alias("cosine_similarity"), F.lit(tau).alias("threshold_used"),
        "gate_passed", "gate_checked", F.when(F.col("decision") == "MISS_GATE", trail_dims).alias("constraint_diff"),
        "output_audit_ok", "output_audit_diff", "embed_ms", "search_ms", "gate_ms", "upstream_ms", "total_ms",
        F.col("charged").alias("cost_cents"), "spent_after", F.lit(S.EMBEDDING_MODEL).alias("embedding_model"),
        F.lit("mixed").alias("workload_label"), "outcome", "response_text")
