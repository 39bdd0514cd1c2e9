"""Serving-side views derived from the driver tables (FIXTURES.md part B):
chat message arrays, a request log, tenants, conversation embeddings and
cached responses. Plain expressions, mirrored in the DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.constraints import extract_constraints
from ..functions.hashing import hash_u32
from .fixtures import FAMILIES
from .tables import load

# ---------------------------------------------------------------------
# Fixed values of the request-log design.
# ---------------------------------------------------------------------
N_TENANTS = 5
TEMPERATURES = [0.0, 0.7, 1.0]
MAX_TOKENS = [256, 512, 1024]
MODEL = "m0"
EMBEDDING_MODEL = "conv-embeddings"
TAU = 0.95   # admission threshold (reference default)
TOP_K = 3    # candidates per search (reference default)
# the 16 suffixes: family order, suffix_a of each then suffix_b of each
SUFFIXES = [f[2] for f in FAMILIES] + [f[3] for f in FAMILIES]
RESPONSES = [
    "- first point\n- second point\n- third point",
    "\n".join(f"{i}. step {i}" for i in range(1, 11)),
    "| item | value |\n|------|-------|\n| a | 1 |\n| b | 2 |",
    '{"answer": 42, "items": [1, 2, 3]}',
    '{"answer": 42} and some trailing words',
    "   ",
    "Voilà une réponse détaillée, très précise et complète.",
    "Here is a short answer written as plain prose without any list.",
]
# what stands before and after a turn's text, so that audited responses take every form
RESPONSE_FRAMES = [
    ("", ""),
    ("", "\n- first\n* second\n• third"),
    ("", "\n1. one\n 2) two"),
    ("", "\n| item | value |\n|------|-------|\n| a | 1 |"),
    ("", "\n- first\n| item | value |"),
    ('{"answer": "', '"}'),
    ('  ["', '", 1, null]\n'),
    ('{"answer": ', ""),
    ("[1, 2] ", ""),
]
BUDGET_BASE_CENTS = 1    # tenant t gets 4^t cents, so small tenants run out
# ---------------------------------------------------------------------


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, messages) with messages = array<struct<role, content>> in turn order."""
    c = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return (c.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
            .select("conv_id", F.transform("_t", lambda m: F.struct(m["role"].alias("role"),
                                                                     m["text"].alias("content"))).alias("messages")))


def _pick(values, i):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event, before its payload is assembled. tenant =
    user % 5; each user cycles over 4 conversations (k % 4), 3 parameter
    variants and the two suffixes of one perturbation family."""
    ev = load(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    n_conv = (load(spark, sf_dir, "conversations", "conv_id").agg(F.countDistinct("conv_id").alias("_nconv"))
              .withColumn("_one", F.lit(1)))
    k = F.get_json_object("props", "$.k").cast("int")
    r = (ev.withColumn("k", k).withColumn("_one", F.lit(1)).join(F.broadcast(n_conv), "_one")
         .withColumn("tenant_id", F.pmod(F.col("user_id"), F.lit(N_TENANTS)))
         .withColumn("conv_id", F.pmod(F.col("user_id") * 31 + F.pmod(F.col("k"), F.lit(4)), F.col("_nconv")))
         .withColumn("variant", F.pmod(F.floor(F.col("k") / 4), F.lit(3)).cast("int"))
         .withColumn("suffix", _pick(SUFFIXES, F.pmod(F.col("user_id"), F.lit(8))
                                     + F.lit(8) * F.pmod(F.floor(F.col("k") / 12), F.lit(2)))))
    return r.select(
        F.col("event_id").alias("request_id"), "ts", "tenant_id", "user_id", "conv_id", "variant", "suffix",
        "event_type", "value",
        F.when(F.col("k") == 99, F.lit("key-unknown"))
         .otherwise(F.concat(F.lit("key-"), F.col("tenant_id").cast("string"))).alias("api_key"),
        F.lit(MODEL).alias("model"),
        _pick(TEMPERATURES, F.col("variant")).alias("temperature"),
        _pick(MAX_TOKENS, F.col("variant")).alias("max_tokens"))


PAYLOAD = ["conv_id", "suffix", "variant"]


def payloads(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """Distinct request payloads (conversation + suffix + parameters) with
    their message array: the suffix is appended to the last user turn."""
    p = events.select(*PAYLOAD, "temperature", "max_tokens", "model").distinct()
    p = p.join(messages(spark, sf_dir), "conv_id")
    last_user = F.aggregate(F.sequence(F.lit(0), F.size("messages") - 1), F.lit(-1),
                            lambda acc, i: F.when(F.col("messages")[i]["role"] == "user", i).otherwise(acc))
    p = p.withColumn("_lu", last_user)
    msgs = F.transform("messages", lambda mm, i: F.when(i == F.col("_lu"), F.struct(
        mm["role"].alias("role"), F.concat(mm["content"], F.lit(" "), F.col("suffix")).alias("content")))
        .otherwise(mm))
    return p.withColumn("messages", msgs).drop("_lu")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request rows with their message arrays."""
    ev = request_events(spark, sf_dir)
    p = payloads(spark, sf_dir, ev).select(*PAYLOAD, "messages")
    return ev.join(p, PAYLOAD)


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tenant seen in the log; budget 4^t cents, key hash
    of ``key-<t>``."""
    ev = load(spark, sf_dir, "events", "user_id")
    t = ev.select(F.pmod(F.col("user_id"), F.lit(N_TENANTS)).alias("tenant_id")).distinct()
    return t.select("tenant_id", F.concat(F.lit("tenant-"), F.col("tenant_id").cast("string")).alias("name"),
                    (F.lit(BUDGET_BASE_CENTS) * F.pow(F.lit(4), F.col("tenant_id"))).cast("decimal(12,4)")
                    .alias("budget_cents"),
                    K.api_key_hash(F.concat(F.lit("key-"), F.col("tenant_id").cast("string"))).alias("api_key_hash"))


def keyed_requests(spark: SparkSession, sf_dir: str, with_constraints: bool = False) -> DataFrame:
    """Requests with every key and projection the pipeline needs. Keys,
    texts and (optionally) constraints are pure functions of the payload,
    so they are computed once per distinct payload and joined back; the
    payload side has one row per payload, so a payload repeated by a
    third of all requests cannot skew the join."""
    ev = request_events(spark, sf_dir)
    p = payloads(spark, sf_dir, ev)
    p = (p.withColumn("prompt_hash", K.raw_hash(F.col("messages")))
         .withColumn("params_hash", K.params_hash(F.col("messages"), F.col("temperature"),
                                                  F.col("max_tokens"), F.col("model")))
         .withColumn("request_text", K.user_text(F.col("messages")))
         .withColumn("prompt_normalized", K.normalize_text(F.col("request_text")))
         .withColumn("est_prompt_tokens", K.estimated_prompt_tokens(F.col("messages"))))
    if with_constraints:
        from ..functions.audit import count_is_list_type
        p = (p.withColumn("constraints", extract_constraints(F.col("request_text")))
             .withColumn("count_list_type", count_is_list_type(F.col("request_text"))))
    p = p.drop("temperature", "max_tokens", "model")
    return (ev.join(p, PAYLOAD)
            .withColumn("api_key_hash", K.api_key_hash(F.col("api_key")))
            .withColumn("embedding_model", F.lit(EMBEDDING_MODEL)))


def conv_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding plug-in of the request log: conversation c uses the
    stored vector ``vec_id = c mod |embeddings|`` (a lookup-table model)."""
    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    n = e.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    convs = load(spark, sf_dir, "conversations", "conv_id").distinct().withColumn("_one", F.lit(1))
    return (convs.join(F.broadcast(n), "_one").withColumn("vec_id", F.pmod(F.col("conv_id"), F.col("_n")))
            .join(e, "vec_id").select("conv_id", "embedding"))


def assistant_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, response_text) of every assistant turn."""
    c = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return c.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("response_text"))


def framed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn, whole, inside one of the ``RESPONSE_FRAMES``: lists,
    tables and JSON, valid or not, occur beside the turns' own prose."""
    frame = F.element_at(F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("after")) for a, b in RESPONSE_FRAMES]),
                         (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(RESPONSE_FRAMES))) + 1).cast("int"))
    t = assistant_turns(spark, sf_dir).withColumn("_f", frame)
    return t.select("conv_id", "turn", F.concat("_f.before", "response_text", "_f.after").alias("response_text"))


def response_for(entry_id) -> F.Column:
    """Cached response text of an entry: one of 8 templates by hash."""
    i = F.pmod(hash_u32(F.concat(F.lit("resp:"), entry_id.cast("string"))), F.lit(len(RESPONSES)))
    return _pick(RESPONSES, i)
