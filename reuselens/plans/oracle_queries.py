"""Oracle SQL bodies for the registered queries (see ``oracle.py``)."""

from __future__ import annotations

import math

from . import oracle as o
from .oracle import ORACLE, q, with_ctes

ORACLE["first_n"] = "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 20000"
ORACLE["hash_sample"] = (f"SELECT doc_id, lang FROM documents ORDER BY {o.hash_key(0, 'doc_id')}, doc_id LIMIT 100")
ORACLE["stratified_sample"] = with_ctes(["strat_p3"], "SELECT * FROM strat_p3")
_PC = "pair_id, population, family, split, prompt_a, prompt_b, safe_to_reuse, workload_label"
ORACLE["p3_pairs"] = with_ctes(["p3_sample"], f"SELECT {_PC} FROM p3_sample")
ORACLE["p3_control_pairs"] = with_ctes(["p3c_sample"], f"SELECT {_PC} FROM p3c_sample")
ORACLE["pairs_natural_positive"] = with_ctes(["natural1"], o.natural_pop_sql("P1", 400))
ORACLE["pairs_natural_negative"] = with_ctes(["natural2"], o.natural_pop_sql("P2", 400))
ORACLE["pairs_natural_control"] = with_ctes(["natural2"], o.natural_pop_sql("P2_control", 400))
ORACLE["pair_length_filter"] = with_ctes(
    ["natural1"], "SELECT base_a, base_b, label FROM natural1 "
                  "WHERE length(text_a) BETWEEN 20 AND 300 AND length(text_b) BETWEEN 20 AND 300")

ORACLE["constraint_count"] = with_ctes(["prompted"], f"SELECT doc_id, {o.count_sql('text')} AS count FROM prompted")
ORACLE["constraint_negation"] = with_ctes(["prompted"], f"SELECT doc_id, {o.negation_sql('text')} AS negation FROM prompted")
ORACLE["constraint_language"] = with_ctes(["prompted"], f"SELECT doc_id, {o.language_sql('text')} AS language FROM prompted")
ORACLE["constraint_entities"] = (f"SELECT doc_id, array_to_string({o.entities_sql('text')}, '|') AS entities "
                                 f"FROM documents")
ORACLE["constraint_format"] = with_ctes(["prompted"], f"SELECT doc_id, {o.format_sql('text')} AS format FROM prompted")

_dims = ["count", "negation", "language", "entities", "format"]
ORACLE["constraints_all"] = with_ctes(["pair_constraints"], "SELECT pair_id, " + ", ".join(
    (f"array_to_string({s}_{d}, '|') AS {s}_{d}" if d == "entities" else f"{s}_{d}")
    for s in ("a", "b") for d in _dims) + " FROM pair_constraints")
ORACLE["pair_compatibility"] = with_ctes(
    ["pair_compat"], "SELECT pair_id, population, compatible, array_to_string(diff_dims, '|') AS diff_dims "
                     "FROM pair_compat")

_FAM_DET = ("SELECT f.family, f.split, f.family_ord, COALESCE(r.n_pairs, 0) AS n_pairs, "
            "COALESCE(r.n_detected, 0) AS n_detected, round(r.n_detected / r.n_pairs, 6) AS detection_rate "
            "FROM families f LEFT JOIN (SELECT family, count(*) AS n_pairs, "
            "count(*) FILTER (WHERE NOT compatible) AS n_detected FROM pair_compat "
            "WHERE population = 'P3' GROUP BY family) r USING (family)")
ORACLE["family_detection"] = with_ctes(["pair_compat", "families"], _FAM_DET)
ORACLE["family_detection_split"] = with_ctes(
    ["pair_compat", "families"],
    f"SELECT split, round(avg(detection_rate), 6) AS mean_detection_rate, count(detection_rate) AS n_families "
    f"FROM ({_FAM_DET}) GROUP BY split")
ORACLE["rejections_by_dimension"] = with_ctes(
    ["pair_compat"],
    "SELECT d.population, d.dimension, d.n_rejections, t.n_rejected, "
    "round(d.n_rejections / t.n_rejected, 6) AS share FROM "
    "(SELECT population, dimension, count(*) AS n_rejections FROM "
    "(SELECT population, unnest(diff_dims) AS dimension FROM pair_compat WHERE NOT compatible) "
    "GROUP BY population, dimension) d JOIN "
    "(SELECT population, count(*) AS n_rejected FROM pair_compat WHERE NOT compatible GROUP BY population) t "
    "USING (population)")

# ------------------------------------------------------------ metrics

ORACLE["pair_cosine"] = with_ctes(["scored"], "SELECT pair_id, round(sim, 6) AS sim FROM scored")
ORACLE["score_variants"] = with_ctes(["variants"], "SELECT pair_id, variant, round(score, 6) AS score FROM variants")
_SWEEP = ("SELECT group_name, variant, round(CAST(700 + 5 * i AS DOUBLE) / 1000.0, 3) AS threshold, tp, fp, "
          "n_pos, n_neg, round(tp / n_pos, 6) AS tpr, round(fp / n_neg, 6) AS fpr, "
          "round((tp + fp) / (n_pos + n_neg), 6) AS hit_rate_on_eval_set FROM ("
          "SELECT group_name, variant, i, "
          "CAST(count(*) FILTER (WHERE y AND score >= CAST(700 + 5 * i AS DOUBLE) / 1000.0) AS BIGINT) AS tp, "
          "CAST(count(*) FILTER (WHERE NOT y AND score >= CAST(700 + 5 * i AS DOUBLE) / 1000.0) AS BIGINT) AS fp, "
          "CAST(count(*) FILTER (WHERE y) AS BIGINT) AS n_pos, CAST(count(*) FILTER (WHERE NOT y) AS BIGINT) AS n_neg "
          "FROM long CROSS JOIN range(0, 62) t(i) GROUP BY group_name, variant, i)")
ORACLE["threshold_sweep"] = with_ctes(["long"], _SWEEP)
ORACLE["hit_vs_false_hit"] = with_ctes(
    ["long"], f"SELECT group_name, variant, threshold, fpr AS false_hit_rate, hit_rate_on_eval_set FROM ({_SWEEP})")
_AUC = (f"SELECT group_name, variant, CAST(P + N AS BIGINT) AS n, CAST(P AS BIGINT) AS n_pos, "
        f"CAST(N AS BIGINT) AS n_neg, round(auc, 6) AS auc FROM ({o.auc_sql('long', 'group_name, variant')})")
ORACLE["auc"] = with_ctes(["long"], _AUC)
ORACLE["roc_points"] = with_ctes(
    ["long"],
    "SELECT group_name, variant, round(score, 6) AS threshold, round((P - pos_below) / P, 6) AS tpr, "
    "round((N - neg_below) / N, 6) AS fpr FROM (SELECT *, "
    "COALESCE(sum(pos) OVER (PARTITION BY group_name, variant ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below, "
    "COALESCE(sum(neg) OVER (PARTITION BY group_name, variant ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below, "
    "sum(pos) OVER (PARTITION BY group_name, variant) AS P, sum(neg) OVER (PARTITION BY group_name, variant) AS N "
    "FROM (SELECT group_name, variant, score, CAST(count(*) FILTER (WHERE y) AS DOUBLE) AS pos, "
    "CAST(count(*) FILTER (WHERE NOT y) AS DOUBLE) AS neg FROM long GROUP BY group_name, variant, score))")
ORACLE["roc_breakdown"] = with_ctes(
    ["long"], f"SELECT variant, max(auc) FILTER (WHERE group_name = 'roc_b') AS auc_all8, "
              f"max(auc) FILTER (WHERE group_name = 'roc_b_indesign5') AS auc_indesign5, "
              f"max(auc) FILTER (WHERE group_name = 'roc_b_heldout3') AS auc_heldout3 FROM ({_AUC}) GROUP BY variant")
ORACLE["admission_rate"] = with_ctes(
    ["scored"], "SELECT t.tau, s.n, round(CASE t.tau WHEN 0.90 THEN r0 WHEN 0.95 THEN r1 ELSE r2 END, 6) AS admission_rate, "
                "s.mean_sim, s.median_sim FROM (SELECT count(*) AS n, round(avg(sim), 6) AS mean_sim, "
                "round(quantile_cont(sim, 0.5), 6) AS median_sim, avg(CASE WHEN sim >= 0.90 THEN 1.0 ELSE 0.0 END) AS r0, "
                "avg(CASE WHEN sim >= 0.95 THEN 1.0 ELSE 0.0 END) AS r1, avg(CASE WHEN sim >= 0.99 THEN 1.0 ELSE 0.0 END) AS r2 "
                "FROM scored WHERE population = 'P1') s CROSS JOIN (VALUES (0.90), (0.95), (0.99)) t(tau)")
ORACLE["false_hits_by_family"] = with_ctes(
    ["scored"], "SELECT family, count(*) AS n_pairs, count(*) FILTER (WHERE sim >= 0.95) AS false_hits, "
                "round(count(*) FILTER (WHERE sim >= 0.95) / count(*), 6) AS false_hit_rate "
                "FROM scored WHERE population = 'P3' GROUP BY family")
ORACLE["family_similarity"] = with_ctes(
    ["scored"], "SELECT family, count(*) AS n_pairs, round(avg(sim), 6) AS mean_sim, "
                "round(quantile_cont(sim, 0.5), 6) AS median_sim, "
                "(SELECT round(avg(sim), 6) FROM scored WHERE population = 'P3_control') AS control_mean "
                "FROM scored WHERE population = 'P3' GROUP BY family")

# ------------------------------------------------------------ serving
from .queries import EMBEDDING_DIMS, K_GRID, TAU_GRID, TRAIL_TAU, VEC_TAU  # noqa: E402

ORACLE["user_text"] = with_ctes(["keyed"], "SELECT request_id, request_text AS user_text FROM keyed")
ORACLE["normalized_prompt"] = with_ctes(["keyed"], "SELECT request_id, prompt_normalized FROM keyed")
ORACLE["raw_hash"] = with_ctes(["keyed"], "SELECT request_id, prompt_hash FROM keyed")
ORACLE["params_hash"] = with_ctes(["keyed"], "SELECT request_id, params_hash FROM keyed")


def _cost_sql(tokens_out: str) -> str:
    from ..functions.keys import DEFAULT_RATE, MODEL_RATES
    rin = " ".join(f"WHEN {q(m)} THEN {i!r}" for m, i, _ in MODEL_RATES)
    rout = " ".join(f"WHEN {q(m)} THEN {o!r}" for m, _, o in MODEL_RATES)
    return (f"CAST((est_prompt_tokens / 1000.0) * (CASE model {rin} ELSE {DEFAULT_RATE[0]!r} END) + "
            f"({tokens_out} / 1000.0) * (CASE model {rout} ELSE {DEFAULT_RATE[1]!r} END) AS DECIMAL(10,6))")


def _resp_sql(entry: str) -> str:
    from ..sources.serving import RESPONSES
    return (f"list_extract({o._lit_list(RESPONSES)}, CAST({o.hash_u32(chr(39) + 'resp:' + chr(39) + ' || CAST(' + entry + ' AS VARCHAR)')} "
            f"% {len(RESPONSES)} + 1 AS INTEGER))")


EST_COST_SQL = _cost_sql("max_tokens")
REAL_COST_SQL = _cost_sql(f"CAST(ceil(length({_resp_sql('request_id')}) / 4) AS BIGINT)")
ORACLE["estimated_cost"] = with_ctes(["keyed"], f"SELECT request_id, est_prompt_tokens, {EST_COST_SQL} AS est_cost FROM keyed")
ORACLE["token_cost"] = with_ctes(["keyed"], f"SELECT request_id, {REAL_COST_SQL} AS real_cost FROM keyed")
ORACLE["tenant_resolution"] = with_ctes(["resolved"], "SELECT request_id, tenant_id FROM resolved")
ORACLE["tenant_rejects"] = with_ctes(
    ["keyed", "tenants_t"], "SELECT request_id, api_key FROM keyed WHERE api_key_hash NOT IN (SELECT api_key_hash FROM tenants_t)")
ORACLE["cache_first_writer"] = with_ctes(["first_writer"], "SELECT * FROM first_writer")
ORACLE["exact_match"] = with_ctes(["exact"], "SELECT request_id, exact_hit, exact_entry_id FROM exact")
ORACLE["topk_candidates"] = with_ctes(["vec_cands3"], "SELECT request_id, entry_id, rank, round(sim, 6) AS sim FROM vec_cands3")
ORACLE["topk_pruned"] = ORACLE["topk_candidates"]
_VEC_ADMIT = o.admit_sql("vec_replay", "vec_cands3", "vec_replay", "vec_replay", VEC_TAU, rid="vec_id")
_VEC_TRAIL = o.admit_sql("vec_replay", "vec_cands3", "vec_replay", "vec_replay", TRAIL_TAU, rid="vec_id")
ORACLE["admission"] = with_ctes(
    ["vec_replay", "vec_cands3"],
    f"SELECT request_id, decision, candidate_id, round(similarity, 6) AS similarity, gate_passed, gate_checked FROM ({_VEC_ADMIT})")
ORACLE["gate_trail"] = with_ctes(
    ["vec_replay", "vec_cands3"],
    f"SELECT c.request_id, c.rank, c.entry_id, round(c.sim, 6) AS similarity, "
    f"array_to_string({o.diff_dims_sql('rq.c_', 'en.c_')}, '|') AS diff_dims, "
    f"{o.diff_text_sql('rq.c_', 'en.c_')} AS diff FROM vec_cands3 c "
    f"JOIN vec_replay rq ON c.request_id = rq.vec_id JOIN vec_replay en ON c.entry_id = en.vec_id "
    f"WHERE c.request_id IN (SELECT request_id FROM ({_VEC_TRAIL}) WHERE decision = 'MISS_GATE')")
_TK = []
for _t in TAU_GRID:
    for _k in K_GRID:
        _c = f"(SELECT * FROM vec_cands5 WHERE rank <= {_k})"
        _TK.append(f"SELECT {_t!r} AS tau, {_k} AS k, decision, count(*) AS n FROM "
                   f"({o.admit_sql('vec_replay', _c, 'vec_replay', 'vec_replay', _t, rid='vec_id')}) GROUP BY decision")
ORACLE["tau_k_surface"] = with_ctes(["vec_replay", "vec_cands5"], " UNION ALL ".join(_TK))
ORACLE["tenant_isolation"] = with_ctes(
    [f"cands_{o.LAST}", "resolved"],
    "SELECT count(*) AS n_candidates, count(*) FILTER (WHERE " + " OR ".join(
        f"rq.{c} IS DISTINCT FROM en.{c}" for c in o.SCOPE_SQL) + ") AS n_cross_scope FROM " + f"cands_{o.LAST} c "
    "JOIN resolved rq ON c.request_id = rq.request_id JOIN resolved en ON c.entry_id = en.request_id")

# ------------------------------------------------------------ decision log, audit, ledger
ORACLE["decision_log"] = with_ctes(["dlog"], "SELECT *, CAST(ts AS DATE) AS dt, 'mixed' AS workload_label FROM dlog")
ORACLE["hits_without_writer"] = with_ctes(
    ["dlog"], "SELECT count(*) AS n_hits, count(*) FILTER (WHERE NOT coalesce(w.ts < d.ts AND w.tenant_id = d.tenant_id, false)) "
    "AS n_without_writer FROM dlog d LEFT JOIN (SELECT * FROM dlog WHERE outcome = 'ok' AND decision IN ('MISS_LOW_SIM', "
    "'MISS_GATE', 'MISS_NO_CANDIDATE')) w ON w.request_id = d.candidate_id WHERE d.decision IN ('HIT_EXACT', 'HIT_SEMANTIC')")
ORACLE["budget_ledger"] = with_ctes(["dlog"], "SELECT request_id, tenant_id, outcome, spent_after, cost_cents AS charged FROM dlog")
ORACLE["tenant_spend"] = with_ctes(
    ["dlog"], "SELECT tenant_id, arg_max(spent_after, (ts, request_id)) AS spent_cents, sum(cost_cents) AS charged_total, "
              "count(*) FILTER (WHERE cost_cents > 0) AS n_charged FROM dlog GROUP BY tenant_id")
ORACLE["audit_rates"] = with_ctes(
    ["dlog", "tenants_t"],
    "SELECT g.tenant_id, g.decision, COALESCE(a.audited, 0) AS audited, COALESCE(a.failures, 0) AS failures, "
    "round(a.failures / nullif(a.audited, 0), 6) AS failure_rate FROM (SELECT t.tenant_id, h.decision FROM tenants_t t "
    "CROSS JOIN (VALUES ('HIT_EXACT'), ('HIT_SEMANTIC')) h(decision)) g LEFT JOIN (SELECT tenant_id, decision, "
    "count(*) FILTER (WHERE output_audit_ok IS NOT NULL) AS audited, count(*) FILTER (WHERE NOT output_audit_ok) AS failures "
    "FROM dlog WHERE decision IN ('HIT_EXACT', 'HIT_SEMANTIC') GROUP BY tenant_id, decision) a USING (tenant_id, decision)")
ORACLE["decision_mix"] = with_ctes(
    ["dlog"], "SELECT decision, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM "
              "(SELECT decision, count(*) AS n FROM dlog GROUP BY decision)")
ORACLE["exact_share"] = with_ctes(
    ["dlog"], "SELECT n_exact, n_no_candidate, round(n_exact / nullif(n_exact + n_no_candidate, 0), 6) AS exact_share FROM "
              "(SELECT count(*) FILTER (WHERE decision = 'HIT_EXACT') AS n_exact, "
              "count(*) FILTER (WHERE decision = 'MISS_NO_CANDIDATE') AS n_no_candidate FROM dlog)")
ORACLE["latency_percentiles"] = with_ctes(
    ["dlog"], "SELECT decision, count(*) AS n, " + ", ".join(
        f"round(avg({c}), 6) AS avg_{c}" for c in ("embed_ms", "search_ms", "gate_ms", "upstream_ms", "total_ms"))
    + ", round(quantile_cont(total_ms, 0.5), 6) AS p50_ms, round(quantile_cont(total_ms, 0.99), 6) AS p99_ms "
      "FROM dlog GROUP BY decision")
ORACLE["entry_hit_counts"] = with_ctes(
    ["dlog"], "SELECT candidate_id AS entry_id, count(*) AS hit_count FROM dlog "
              "WHERE decision IN ('HIT_EXACT', 'HIT_SEMANTIC') GROUP BY candidate_id")
C_MISS_SQL = ("SELECT round(avg(CAST(cost_cents AS DOUBLE)), 9) AS c_miss, count(*) AS n FROM dlog "
              "WHERE decision LIKE 'MISS%' AND cost_cents > 0")
ORACLE["c_miss"] = with_ctes(["dlog"], C_MISS_SQL)
ORACLE["gate_saving_share"] = with_ctes(
    ["dlog"], "SELECT round(h, 6) AS hit_mean_ms, round(m, 6) AS miss_mean_ms, round(g, 6) AS gate_mean_ms, "
              "round(g / (m - h), 6) AS gate_latency_share FROM (SELECT "
              "avg(total_ms) FILTER (WHERE decision IN ('HIT_EXACT', 'HIT_SEMANTIC')) AS h, "
              "avg(total_ms) FILTER (WHERE decision IN ('MISS_LOW_SIM', 'MISS_GATE', 'MISS_NO_CANDIDATE')) AS m, "
              "avg(gate_ms) AS g FROM dlog)")
ORACLE["output_audit"] = with_ctes(
    ["dlog"], "SELECT request_id, decision, output_audit_ok, output_audit_diff FROM dlog WHERE output_audit_ok IS NOT NULL")
ORACLE["response_bullets"] = with_ctes(["entry_resp"], f"SELECT conv_id, turn, {o.bullets_sql('response_text')} AS bullet_count FROM entry_resp")
ORACLE["response_table"] = with_ctes(["entry_resp"], f"SELECT conv_id, turn, {o.table_sql('response_text')} AS table_present FROM entry_resp")
ORACLE["response_json_valid"] = with_ctes(["entry_resp"], f"SELECT conv_id, turn, {o.json_valid_sql('response_text')} AS json_valid FROM entry_resp")
ORACLE["response_language"] = with_ctes(["entry_resp"], f"SELECT conv_id, turn, {o.language_resp_sql('response_text')} AS language FROM entry_resp")
ORACLE["response_length_band"] = with_ctes(["entry_resp"], f"SELECT conv_id, turn, {o.band_sql('response_text')} AS length_band FROM entry_resp")
ORACLE["response_format"] = with_ctes(["entry_resp"], f"SELECT conv_id, turn, {o.format_resp_sql('response_text')} AS format FROM entry_resp")
ORACLE["response_properties"] = with_ctes(
    ["entry_resp"], f"SELECT conv_id, turn, {o.bullets_sql('response_text')} AS bullet_count, {o.table_sql('response_text')} AS table_present, "
                    f"{o.json_valid_sql('response_text')} AS json_valid, {o.language_resp_sql('response_text')} AS language, "
                    f"{o.band_sql('response_text')} AS length_band, {o.format_resp_sql('response_text')} AS format FROM entry_resp")

# ------------------------------------------------------------ costs, gate, review
from ..operators.costs import TABLE_RATIOS  # noqa: E402
from .queries import REVIEW_BLOCK  # noqa: E402

ORACLE["expected_cost"] = with_ctes(
    ["gated_curve", "cmiss"], f"SELECT rho, ratio, threshold, round(expected_cost, 12) AS expected_cost FROM ({o.cost_sql(TABLE_RATIOS)})")
_TS = ("SELECT rho, i, ratio, arg_min(threshold, (expected_cost, threshold)) AS tau_star, min(expected_cost) AS min_cost "
       "FROM ({}) GROUP BY rho, i, ratio")
ORACLE["tau_star"] = with_ctes(
    ["gated_curve", "cmiss"], f"SELECT rho, ratio, tau_star, round(min_cost, 12) AS min_cost FROM ({_TS.format(o.cost_sql(TABLE_RATIOS))})")
ORACLE["tau_star_surface"] = with_ctes(
    ["gated_curve", "cmiss"], f"SELECT rho, i, round(ratio, 9) AS ratio, tau_star FROM ({_TS.format(o.cost_sql(None))})")
ORACLE["frozen_subset"] = with_ctes(["frozen"], "SELECT pair_id, population, family, y, round(sim, 6) AS sim FROM frozen")
_DIMS = ["count", "negation", "language", "entities", "format"]
_LOST = ", ".join(f"('{'without ' + d if d else 'live'}', '{d}')" for d in ["", *_DIMS])
# Poisson(1) by inverse CDF: how many of the cuts the 32-bit hash of pair and replicate reaches
_CUTS = [math.floor(2 ** 32 * sum(math.exp(-1) / math.factorial(j) for j in range(k))) for k in range(1, 11)]
_W = "(" + " + ".join(f"CAST(u >= {c} AS INTEGER)" for c in _CUTS) + ")"
_JUDGED = ("SELECT x.extractor, f.pair_id, f.y, r.run, CASE WHEN (CASE r.run WHEN 'baseline' THEN f.compatible ELSE "
           "len(list_filter(c.diff_dims, lambda d: d <> x.lost)) = 0 END) THEN f.sim ELSE -1.0 END AS score "
           f"FROM frozen f JOIN pair_compat c USING (pair_id) CROSS JOIN (VALUES {_LOST}) x(extractor, lost) "
           "CROSS JOIN (VALUES ('baseline'), ('current')) r(run)")
_ASIDE = "max(auc) FILTER (WHERE run = 'baseline') AS b, max(auc) FILTER (WHERE run = 'current') AS c"
ORACLE["auc_regression_gate"] = with_ctes(
    ["frozen", "pair_compat"],
    f"SELECT p.extractor, (SELECT count(*) FROM frozen) AS n, round(p.b, 6) AS baseline_auc, round(p.c, 6) AS current_auc, "
    f"round(lo, 6) AS diff_low, round(hi, 6) AS diff_high, 0.02 AS tolerance, p.c >= p.b - 0.02 AS passed FROM "
    f"(SELECT extractor, {_ASIDE} FROM ({o.auc_sql('(' + _JUDGED + ')', 'extractor, run')}) GROUP BY extractor) p JOIN "
    f"(SELECT extractor, quantile_cont(c - b, 0.025) AS lo, quantile_cont(c - b, 0.975) AS hi FROM (SELECT extractor, rep, {_ASIDE} FROM ("
    + o.auc_sql(f"(SELECT j.*, rep, {o.hash_u32(chr(40) + 'CAST(pair_id AS VARCHAR) || chr(58) || CAST(rep AS VARCHAR)' + chr(41))} AS u "
                f"FROM ({_JUDGED}) j CROSS JOIN range(0, 200) t(rep))", "extractor, rep, run", _W)
    + ") GROUP BY extractor, rep) WHERE c - b IS NOT NULL GROUP BY extractor) d ON d.extractor = p.extractor")
ORACLE["label_review_sample"] = with_ctes(
    ["p3_all"], f"SELECT pair_id, family, printf({q(REVIEW_BLOCK)}, row_number() OVER (ORDER BY family, "
                f"{o.hash_key(0, 'pair_id')}, pair_id), pair_id, family, prompt_a, prompt_b) AS block FROM "
                f"(SELECT * FROM p3_all ORDER BY {o.hash_key(0, 'pair_id')}, pair_id LIMIT 100)")

# ------------------------------------------------------------ sources/sinks, corpus profile
ORACLE["eval_pairs_by_population"] = with_ctes(
    ["eval_pairs"], f"SELECT {_PC} FROM eval_pairs WHERE population IN ('P3', 'P3_control')")
ORACLE["population_replace"] = with_ctes(
    ["eval_pairs", "p3_sample"], "SELECT population, count(*) AS n FROM (SELECT population FROM eval_pairs WHERE population <> 'P3' "
                                 "UNION ALL SELECT population FROM p3_sample) GROUP BY population")
ORACLE["cache_entries_build"] = with_ctes(
    [f"writers_{o.ROUNDS}", "resolved"],
    f"SELECT f.entry_id, f.tenant_id, f.prompt_hash, f.model AS upstream_model, f.params_hash, r.prompt_normalized, "
    f"r.embedding_model, CAST(ceil(length({o.resp_sql('f.entry_id')}) / 4) AS INTEGER) AS response_tokens, f.created_at "
    f"FROM writers_{o.ROUNDS} f JOIN resolved r ON r.request_id = f.entry_id")
_T = lambda c: o.normalize_sql(c)
ORACLE["embedding_cache_missing"] = with_ctes(
    ["eval_pairs", "p3_sample"],
    f"SELECT key, text FROM (SELECT text, sha256('hashed-bow' || chr(0) || text) AS key FROM (SELECT DISTINCT text FROM ("
    f"SELECT {_T('prompt_a')} AS text FROM eval_pairs UNION ALL SELECT {_T('prompt_b')} AS text FROM eval_pairs))) "
    f"WHERE key NOT IN (SELECT sha256('hashed-bow' || chr(0) || {_T('prompt_a')}) FROM p3_sample)")
ORACLE["embedding_quality"] = (
    "SELECT label, count(*) AS n, min(dim) AS min_dim, max(dim) AS max_dim, round(min(norm), 6) AS min_norm, "
    "round(max(norm), 6) AS max_norm, round(avg(norm), 6) AS avg_norm FROM (SELECT label, len(embedding) AS dim, "
    "sqrt(list_reduce(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)), lambda x, y: x + y)) AS norm "
    "FROM embeddings) GROUP BY label")
ORACLE["corpus_profile"] = with_ctes(
    ["eval_pairs"], " UNION ALL ".join(
        f"SELECT '{level}' AS level, {cols}, count(*) AS n, min(length(prompt_a)) AS min_a, round(quantile_cont(length(prompt_a), 0.5), 6) AS p50_a, "
        "round(quantile_cont(length(prompt_a), 0.95), 6) AS p95_a, max(length(prompt_a)) AS max_a, "
        "min(length(prompt_b)) AS min_b, round(quantile_cont(length(prompt_b), 0.5), 6) AS p50_b, "
        f"round(quantile_cont(length(prompt_b), 0.95), 6) AS p95_b, max(length(prompt_b)) AS max_b FROM eval_pairs {by}"
        for level, cols, by in (
            ("total", "NULL AS population, NULL AS family, NULL AS workload_label", ""),
            ("population", "population, NULL AS family, NULL AS workload_label", "GROUP BY population"),
            ("family", "population, family, NULL AS workload_label", "GROUP BY population, family"),
            ("workload", "population, NULL AS family, workload_label", "GROUP BY population, workload_label"))))
ORACLE["base_rates"] = with_ctes(
    ["eval_pairs"], "SELECT population, count(*) AS n, count(*) FILTER (WHERE safe_to_reuse) AS n_safe, "
                    "round(count(*) FILTER (WHERE safe_to_reuse) / count(*), 6) AS base_rate FROM eval_pairs GROUP BY population")
ORACLE["operating_point"] = with_ctes(
    ["scored"], "SELECT population, family, count(*) AS n, count(*) FILTER (WHERE sim >= 0.8) AS hits, "
                "round(avg(CASE WHEN sim >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, "
                "round(count(*) FILTER (WHERE sim >= 0.8 AND y) / nullif(count(*) FILTER (WHERE y), 0), 6) AS tpr, "
                "round(count(*) FILTER (WHERE sim >= 0.8 AND NOT y) / nullif(count(*) FILTER (WHERE NOT y), 0), 6) AS fpr "
                "FROM scored GROUP BY population, family")
ORACLE["constraints_json_round_trip"] = with_ctes(
    ["pair_constraints"], "SELECT pair_id, true AS same, a_count AS count, a_format AS format FROM pair_constraints")
ORACLE["embedding_cosine"] = with_ctes(["eval_pairs"], " UNION ALL ".join(
    f"SELECT pair_id, '{_m}' AS model, round({o.sim_sql('ba', 'bb')}, 6) AS sim FROM (SELECT pair_id, "
    f"{o.bow_sql('prompt_a', _d)} AS ba, {o.bow_sql('prompt_b', _d)} AS bb FROM eval_pairs)" for _m, _d in EMBEDDING_DIMS.items()))
_EMB = " UNION ALL ".join(
    f"SELECT * EXCLUDE (ba, bb), '{_m}' AS model, {o.sim_sql('ba', 'bb')} AS sim FROM (SELECT pair_id, population, split, compatible, "
    f"safe_to_reuse AS y, {o.bow_sql('prompt_a', _d)} AS ba, {o.bow_sql('prompt_b', _d)} AS bb FROM pair_compat)"
    for _m, _d in EMBEDDING_DIMS.items())
_BY_MODEL = (f"(SELECT m.model, g.group_name, v.variant, m.y, CASE WHEN v.variant = 'gated' AND NOT m.compatible THEN -1.0 ELSE m.sim END "
             f"AS score FROM ({_EMB}) m JOIN roc_group_map g ON m.population = g.population AND (g.split IS NULL OR m.split = g.split) "
             "CROSS JOIN (VALUES ('cosine_only'), ('gated')) v(variant))")
ORACLE["auc_by_model"] = with_ctes(
    ["pair_compat", "roc_group_map"],
    "SELECT model, group_name, variant, CAST(P + N AS BIGINT) AS n, CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg, "
    f"round(auc, 6) AS auc FROM ({o.auc_sql(_BY_MODEL, 'model, group_name, variant')})")
ORACLE["embedding_store"] = with_ctes(
    ["eval_pairs"], f"SELECT sha256('hashed-64' || chr(0) || text) AS key, 'hashed-64' AS model, 64 AS dim FROM ("
    f"SELECT {_T('prompt_a')} AS text FROM eval_pairs UNION SELECT {_T('prompt_b')} AS text FROM eval_pairs)")
# a sketch has no SQL twin: what the rows must say is that every quantile keeps its tolerance
ORACLE["latency_sketch"] = with_ctes(
    ["dlog"], "SELECT decision, count(total_ms) AS n, true AS p50_within, true AS p99_within FROM dlog GROUP BY decision")
ORACLE["gate_cost_share"] = with_ctes(
    ["dlog"], "SELECT gate, round(t, 6) AS saved_ms, round(c, 6) AS saved_cents, round(ms / nullif(t, 0), 6) AS latency_share, "
    "round(cents / nullif(c, 0), 6) AS cost_share FROM (SELECT avg(total_ms) FILTER (WHERE decision IN ('MISS_LOW_SIM', 'MISS_GATE', "
    "'MISS_NO_CANDIDATE')) - avg(total_ms) FILTER (WHERE decision IN ('HIT_EXACT', 'HIT_SEMANTIC')) AS t, "
    "avg(CAST(cost_cents AS DOUBLE)) FILTER (WHERE decision LIKE 'MISS%' AND cost_cents > 0) AS c, avg(gate_ms) AS g FROM dlog) "
    "CROSS JOIN LATERAL (VALUES ('rules', CAST(g AS DOUBLE), 0.0), ('model', 1508.0, 0.00289)) x(gate, ms, cents)")

# ------------------------------------------------------------ bootstrap: the draws of operators.bootstrap, in SQL
def _uniform(salt: int) -> str:
    x = f"((h + (rep + 1) * 1013904223 + {salt * 715827883}) % 2147483647)"
    for m in (48271, 69621, 39373):
        y = f"(({x} * {m}) % 2147483647)"
        x = f"list_transform([{y}], lambda v: xor(v, v >> 13))[1]"
    return f"(({x} + 0.5) / 2147483648.0)"


def _poisson_cdf(mean: int) -> list[float]:
    out = [math.exp(-mean)]
    while out[-1] < 1 - 1e-11:
        out.append(out[-1] + math.exp(-mean) * mean ** len(out) / math.factorial(len(out)))
    return out


def _draw(c: str, u: str, v: str) -> str:
    cuts = "[" + ", ".join(f"[{', '.join(repr(x) for x in _poisson_cdf(m))}]" for m in range(1, 13)) + "]"
    return (f"CASE WHEN {c} = 0 THEN 0.0 WHEN {c} <= 12 THEN "
            f"CAST(len(list_filter(list_extract({cuts}, CAST({c} AS INTEGER)), lambda t: t <= {u})) AS DOUBLE) "
            f"ELSE greatest(0.0, floor({c} + sqrt({c}) * sqrt(-2.0 * ln({u})) * cos(2.0 * pi() * {v}) + 0.5)) END")


_CELLS = ("SELECT group_name, variant, score, CAST(count(*) FILTER (WHERE y) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE NOT y) "
          "AS DOUBLE) AS neg FROM long GROUP BY group_name, variant, score")
_HASHED = ("SELECT *, " + o.hash_u32("(group_name || ':' || variant || ':' || CAST(CAST(round(score * 1e9) AS BIGINT) AS VARCHAR))")
           + f" AS h FROM ({_CELLS})")
_DRAWN = (f"SELECT group_name, variant, score, rep, {_draw('pos', 'u1', 'u2')} AS wp, {_draw('neg', 'u3', 'u4')} AS wn FROM ("
          f"SELECT *, {', '.join(f'{_uniform(i)} AS u{i}' for i in range(1, 5))} FROM ({_HASHED}) CROSS JOIN "
          f"range(0, 1000) t(rep))")
_REPLICATES = (
    "SELECT group_name, variant, rep, sum(wp * (below + wn / 2)) / nullif(sum(wp) * sum(wn), 0) AS auc FROM (SELECT *, "
    "coalesce(sum(wn) OVER (PARTITION BY group_name, variant, rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
    f"AS below FROM ({_DRAWN})) GROUP BY group_name, variant, rep")
_CI = (f"SELECT group_name, variant, count(auc) AS n_valid, round(quantile_cont(auc, 0.025), 6) AS ci_low, "
       f"round(quantile_cont(auc, 0.975), 6) AS ci_high FROM ({_REPLICATES}) GROUP BY group_name, variant")
_REPORT = f"SELECT * FROM ({_AUC}) JOIN ({_CI}) USING (group_name, variant)"
ORACLE["auc_bootstrap_ci"] = with_ctes(["long"], _CI)
ORACLE["roc_report"] = with_ctes(["long"], _REPORT)
ORACLE["auc_table"] = with_ctes(
    ["long"], "SELECT group_name, 'hashed-bow' AS model, variant, auc, ci_low, ci_high, "
    f"printf('%.3f [%.3f, %.3f]', auc, ci_low, ci_high) AS display FROM ({_REPORT})")
