"""DuckDB oracle SQL for every registered query.

Each fixture view of ``reuselens.sources.fixtures`` has a CTE here with
the same definition; regexes use the RE2 forms of
``reuselens.functions.text`` (RE2 has no lookaround, so boundaries are
consumed instead of asserted). ``with_ctes`` pulls in dependencies.
"""

from __future__ import annotations

import re

from ..functions import constraints as C
from ..functions.text import NOT_W, RE2_B_END, RE2_B_START, WS, _digit_blocks
from ..sources import fixtures as fx

CTES: dict[str, tuple[str, list[str]]] = {}
ORACLE: dict[str, str] = {}
RECURSIVE: set[str] = set()
MATERIALIZED: set[str] = set()


def cte(name, deps=()):
    def deco(fn):
        CTES[name] = (fn(), list(deps))
        return fn
    return deco


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_ctes(names, body: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)
    for n in names:
        visit(n)
    if not order:
        return body
    head = "WITH RECURSIVE " if any(n in RECURSIVE for n in order) else "WITH "
    kept = lambda n: " MATERIALIZED" if n in MATERIALIZED else ""
    return head + ",\n".join(f"{n} AS{kept(n)} ({CTES[n][0]})" for n in order) + "\n" + body


def oracle(name):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


def hash_u32(x: str) -> str:
    return f"CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"


def hash_key(seed, x: str) -> str:
    return f"md5(concat('{seed}:', CAST({x} AS VARCHAR)))"


def r6(x: str) -> str:
    return f"round({x}, 6)"


# ---------------------------------------------------------------- text
WS_RUN = WS + "+"


def normalize_sql(t: str) -> str:
    return f"trim(regexp_replace(lower({t}), {q(WS_RUN)}, ' ', 'g'))"


_NUM_ALT = r"(?:\p{Nd}+|" + "|".join(C.NUM_WORDS) + ")"
_NOUN_ALT = "(?:" + "|".join(C.OUTPUT_NOUNS) + ")"
_WSTAR = r"[\p{L}\p{N}_]*"
COUNT_RE2 = rf"(?i){RE2_B_START}({_NUM_ALT}){WS}+{_WSTAR}{WS}*{_NOUN_ALT}{RE2_B_END}"
COUNT_NOUN_RE2 = rf"(?i){RE2_B_START}{_NUM_ALT}{WS}+{_WSTAR}{WS}*({_NOUN_ALT}){RE2_B_END}"
NEG_RE2 = (rf"(?i){RE2_B_START}(?:{'|'.join(re.escape(c) for c in C.NEG_CUES)})"
           rf"((?:[^\p{{L}}\p{{N}}_.!?][^.!?]*)?)(?:[.!?]|$)")
LANG_RE2 = rf"(?i){RE2_B_START}(?:in|into|to){WS}+({'|'.join(C.LANGUAGES)}){RE2_B_END}"
FORMAT_RE2 = rf"(?i){RE2_B_START}({'|'.join(re.escape(p) for p, _ in C.FORMAT_PHRASES)}){RE2_B_END}"


def digits_sql(t: str) -> str:
    src, dst = _digit_blocks()
    return f"translate({t}, {q(src)}, {q(dst)})"


def count_sql(t: str) -> str:
    tok = f"lower(regexp_extract({t}, {q(COUNT_RE2)}, 1))"
    words = " ".join(f"WHEN {q(w)} THEN '{i + 1}'" for i, w in enumerate(C.NUM_WORDS))
    return (f"(CASE WHEN {tok} <> '' THEN regexp_replace(COALESCE(CASE {tok} {words} END, {digits_sql(tok)}), "
            "'^0+(.)', '\\1') END)")


def negation_sql(t: str) -> str:
    scope = f"lower(trim(regexp_replace(regexp_extract({t}, {q(NEG_RE2)}, 1), {q(WS_RUN)}, ' ', 'g')))"
    return f"(CASE WHEN regexp_matches({t}, {q(NEG_RE2)}) THEN nullif({scope}, '') END)"


def language_sql(t: str) -> str:
    return f"nullif(lower(regexp_extract({t}, {q(LANG_RE2)}, 1)), '')"


def entities_sql(t: str) -> str:
    marked = (f"regexp_replace(regexp_replace({t}, chr(1), chr(2), 'g'), {q('([.!?])' + WS + '+')}, "
              f"'\\1' || chr(1), 'g')")
    caps = (f"flatten(list_transform(string_split({marked}, chr(1)), lambda s: list_slice(list_filter("
            f"regexp_split_to_array(s, {q(NOT_W + '+')}), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]*')), 2, 1073741824)))")
    nums = f"list_filter(regexp_split_to_array({t}, {q(NOT_W + '+')}), lambda w: regexp_full_match(w, '\\p{{Nd}}+'))"
    ents = f"list_sort(list_distinct(list_concat({caps}, {nums})))"
    return f"(CASE WHEN len({ents}) > 0 THEN {ents} END)"


def format_sql(t: str) -> str:
    ph = f"lower(regexp_extract({t}, {q(FORMAT_RE2)}, 1))"
    cases = " ".join(f"WHEN {q(p)} THEN {q(lbl)}" for p, lbl in C.FORMAT_PHRASES)
    return f"(CASE {ph} {cases} END)"


def constraint_cols_sql(t: str, prefix: str = "") -> str:
    return (f"{count_sql(t)} AS {prefix}count, {negation_sql(t)} AS {prefix}negation, "
            f"{language_sql(t)} AS {prefix}language, {entities_sql(t)} AS {prefix}entities, "
            f"{format_sql(t)} AS {prefix}format")


def compatible_sql(a: str, b: str) -> str:
    return " AND ".join(f"({a}{d} IS NOT DISTINCT FROM {b}{d})" for d in C.DIMENSIONS)


def diff_dims_sql(a: str, b: str) -> str:
    parts = ", ".join(f"CASE WHEN {a}{d} IS DISTINCT FROM {b}{d} THEN '{d}' END" for d in C.DIMENSIONS)
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


# ------------------------------------------------------------ fixtures
@cte("sentences")
def _():
    return (f"SELECT doc_id * {1 << 24} + n AS base_id, doc_id, n, base, category FROM ("
            "SELECT doc_id, lang AS category, generate_subscripts(x, 1) - 1 AS n, unnest(x) AS base FROM ("
            f"SELECT doc_id, lang, regexp_split_to_array(text, {q(chr(92) + 'n|' + chr(92) + '. ')}) AS x FROM documents)) "
            "WHERE length(base) BETWEEN 20 AND 300")


@cte("base_prompts", ["sentences"])
def _():
    return "SELECT min(base_id) AS base_id, base, category FROM sentences GROUP BY base, category"


@cte("families")
def _():
    rows = ", ".join(f"({i}, {q(f)}, {q(s)}, {q(a)}, {q(b)})" for i, (f, s, a, b) in enumerate(fx.FAMILIES))
    return f"SELECT * FROM (VALUES {rows}) t(family_ord, family, split, suffix_a, suffix_b)"


def stratified_sql(src: str, n: int, seed) -> str:
    return (f"SELECT r.base_id, r.base, r.category FROM (SELECT b.*, row_number() OVER (PARTITION BY category "
            f"ORDER BY {hash_key(seed, 'base_id')}, base_id) AS rn FROM {src} b) r JOIN ("
            f"SELECT category, CAST(floor({n} / c) AS INTEGER) + CASE WHEN i < {n} % c THEN 1 ELSE 0 END AS quota "
            f"FROM (SELECT category, row_number() OVER (ORDER BY category) - 1 AS i, count(*) OVER () AS c "
            f"FROM (SELECT DISTINCT category FROM {src}))) qt USING (category) WHERE rn <= quota")


@cte("strat_p3", ["base_prompts"])
def _():
    return stratified_sql("base_prompts", 150, 0)


@cte("strat_p3c", ["base_prompts"])
def _():
    return stratified_sql("base_prompts", 100, 1)


def make_pair_sql(base: str, sfx: str) -> str:
    return f"(rtrim({base}, '.') || '. ' || {sfx})"


def perturb_sql(bases: str) -> str:
    return (f"SELECT 'P3:' || CAST(b.base_id AS VARCHAR) || ':' || f.family AS pair_id, 'P3' AS population, "
            f"f.family, f.split, {make_pair_sql('b.base', 'f.suffix_a')} AS prompt_a, "
            f"{make_pair_sql('b.base', 'f.suffix_b')} AS prompt_b, false AS safe_to_reuse, "
            f"b.category AS workload_label FROM {bases} b CROSS JOIN families f")


def _choice_sql(values, h):
    return f"list_extract([{', '.join(q(str(v)) for v in values)}], CAST(({h}) % {len(values)} + 1 AS INTEGER))"


def control_sql(bases: str, seed) -> str:
    h = hash_u32(f"concat('{seed}:', CAST(b.base_id AS VARCHAR), ':', fam.family)")
    n, lang, fmt = (_choice_sql(fx.CONTROL_NUMBERS, h), _choice_sql(fx.CONTROL_LANGUAGES, h),
                    _choice_sql(fx.CONTROL_FORMATS, h))

    def pick(i):
        t = fx.CONTROL_TEMPLATES
        return (f"CASE fam.family WHEN 'numeric' THEN replace({q(t['numeric'][i])}, '{{}}', {n}) "
                f"WHEN 'language' THEN replace({q(t['language'][i])}, '{{}}', {lang}) "
                f"WHEN 'format' THEN replace({q(t['format'][i])}, '{{}}', {fmt}) END")
    fams = ", ".join(f"({q(f)})" for f in fx.CONTROL_FAMILIES)
    return (f"SELECT 'P3_control:' || CAST(b.base_id AS VARCHAR) || ':' || fam.family AS pair_id, "
            f"'P3_control' AS population, fam.family, 'in_design' AS split, "
            f"{make_pair_sql('b.base', pick(0))} AS prompt_a, {make_pair_sql('b.base', pick(1))} AS prompt_b, "
            f"true AS safe_to_reuse, b.category AS workload_label "
            f"FROM {bases} b CROSS JOIN (VALUES {fams}) fam(family)")


@cte("p3_sample", ["strat_p3", "families"])
def _():
    return perturb_sql("strat_p3")


@cte("p3c_sample", ["strat_p3c"])
def _():
    return control_sql("strat_p3c", 1)


@cte("p3_all", ["base_prompts", "families"])
def _():
    return perturb_sql("base_prompts")


@cte("p3c_all", ["base_prompts"])
def _():
    return control_sql("base_prompts", 1)


def natural_sql(offset: int) -> str:
    return (f"SELECT a.base_id AS base_a, b.base_id AS base_b, a.base AS text_a, b.base AS text_b, a.category, "
            f"CASE WHEN {normalize_sql('a.base')} = {normalize_sql('b.base')} OR "
            f"COALESCE(qa.quality = 1 AND qb.quality = 1, false) THEN 1 ELSE 0 END AS label "
            f"FROM sentences a LEFT JOIN labels qa ON a.doc_id = qa.doc_id "
            f"JOIN sentences b ON b.doc_id = a.doc_id + {offset} AND a.n = b.n AND a.category = b.category "
            f"LEFT JOIN labels qb ON b.doc_id = qb.doc_id")


@cte("natural1", ["sentences"])
def _():
    return natural_sql(1)


@cte("natural2", ["sentences"])
def _():
    return natural_sql(2)


def natural_pop_sql(pop: str, n) -> str:
    from ..operators.pairs import NATURAL
    offset, label, safe, seed = NATURAL[pop]
    inner = (f"SELECT '{pop}:' || CAST(base_a AS VARCHAR) AS pair_id, text_a, text_b FROM natural{offset} "
             f"WHERE label = {label} AND length(text_a) BETWEEN 20 AND 300 AND length(text_b) BETWEEN 20 AND 300")
    if n is not None:
        inner = f"SELECT * FROM ({inner}) ORDER BY {hash_key(seed, 'pair_id')}, pair_id LIMIT {n}"
    return (f"SELECT pair_id, '{pop}' AS population, CAST(NULL AS VARCHAR) AS family, "
            f"CAST(NULL AS VARCHAR) AS split, text_a AS prompt_a, text_b AS prompt_b, "
            f"{'true' if safe else 'false'} AS safe_to_reuse, CAST(NULL AS VARCHAR) AS workload_label "
            f"FROM ({inner})")


@cte("eval_pairs", ["p3_all", "p3c_all", "natural1", "natural2"])
def _():
    return " UNION ALL ".join(["SELECT * FROM p3_all", "SELECT * FROM p3c_all"]
                              + [natural_pop_sql(p, None) for p in ("P1", "P2", "P2_control")])


@cte("pair_constraints", ["eval_pairs"])
def _():
    return (f"SELECT *, {constraint_cols_sql('prompt_a', 'a_')}, {constraint_cols_sql('prompt_b', 'b_')} "
            f"FROM eval_pairs")


@cte("pair_compat", ["pair_constraints"])
def _():
    return (f"SELECT pair_id, population, family, split, safe_to_reuse, workload_label, prompt_a, prompt_b, "
            f"{compatible_sql('a_', 'b_')} AS compatible, {diff_dims_sql('a_', 'b_')} AS diff_dims "
            f"FROM pair_constraints")


# ------------------------------------------------------------ metrics
def bow_sql(t: str, buckets: int = 1 << 18) -> str:
    toks = f"list_filter(regexp_split_to_array({normalize_sql(t)}, {q(NOT_W + '+')}), lambda x: x <> '')"
    return f"list_transform({toks}, lambda x: {hash_u32('x')} % {buckets})"


def sim_sql(a: str, b: str) -> str:
    dot = f"COALESCE(list_sum(list_transform({a}, lambda x: len(list_filter({b}, lambda y: y = x)))), 0)"
    na = f"COALESCE(list_sum(list_transform({a}, lambda x: len(list_filter({a}, lambda y: y = x)))), 0)"
    nb = f"COALESCE(list_sum(list_transform({b}, lambda x: len(list_filter({b}, lambda y: y = x)))), 0)"
    den = f"sqrt(CAST({na} * {nb} AS DOUBLE))"
    return f"(CASE WHEN {den} > 0 THEN least(greatest(CAST({dot} AS DOUBLE) / {den}, 0.0), 1.0) END)"


@cte("scored", ["pair_compat"])
def _():
    return (f"SELECT pair_id, population, family, split, workload_label, safe_to_reuse AS y, compatible, "
            f"{sim_sql('ba', 'bb')} AS sim FROM (SELECT *, {bow_sql('prompt_a')} AS ba, {bow_sql('prompt_b')} AS bb "
            f"FROM pair_compat)")


@cte("roc_group_map")
def _():
    return ("SELECT * FROM (VALUES ('P2', NULL, 'roc_a'), ('P2_control', NULL, 'roc_a'), "
            "('P3_control', NULL, 'roc_b'), ('P3_control', NULL, 'roc_b_indesign5'), "
            "('P3_control', NULL, 'roc_b_heldout3'), ('P3', 'in_design', 'roc_b'), "
            "('P3', 'in_design', 'roc_b_indesign5'), ('P3', 'held_out', 'roc_b'), "
            "('P3', 'held_out', 'roc_b_heldout3')) t(population, split, group_name)")


@cte("variants", ["scored"])
def _():
    return ("SELECT *, 'cosine_only' AS variant, sim AS score FROM scored UNION ALL "
            "SELECT *, 'gated' AS variant, CASE WHEN compatible THEN sim ELSE -1.0 END AS score FROM scored")


@cte("long", ["variants", "roc_group_map"])
def _():
    return ("SELECT v.*, g.group_name FROM variants v JOIN roc_group_map g ON v.population = g.population "
            "AND (g.split IS NULL OR v.split = g.split)")


def auc_sql(src: str, keys: str, weight: str = "1") -> str:
    return (f"SELECT {keys}, sum(pos) AS P, sum(neg) AS N, "
            f"CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (neg_below + neg / 2.0)) / (sum(pos) * sum(neg)) END AS auc "
            f"FROM (SELECT *, COALESCE(sum(neg) OVER (PARTITION BY {keys} ORDER BY score "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM ("
            f"SELECT {keys}, score, CAST(sum(CASE WHEN y THEN {weight} ELSE 0 END) AS DOUBLE) AS pos, "
            f"CAST(sum(CASE WHEN NOT y THEN {weight} ELSE 0 END) AS DOUBLE) AS neg FROM {src} GROUP BY {keys}, score)) "
            f"GROUP BY {keys}")


# ------------------------------------------------------------ serving
def _sv():
    from ..sources import serving as SV
    return SV


@cte("msgs")
def _():
    return ("SELECT conv_id, list_transform(list_sort(list(struct_pack(turn := turn, role := role, text := text))), "
            "lambda m: struct_pack(role := m.role, content := m.text)) AS messages FROM conversations GROUP BY conv_id")


def _lit_list(vals):
    return "[" + ", ".join(q(v) if isinstance(v, str) else repr(v) for v in vals) + "]"


@cte("requests", ["msgs"])
def _():
    SV = _sv()
    k = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
    base = (f"SELECT e.*, {k} AS k, user_id % {SV.N_TENANTS} AS tenant_id0, "
            f"(user_id * 31 + {k} % 4) % (SELECT count(DISTINCT conv_id) FROM conversations) AS conv_id FROM events e")
    sfx = f"list_extract({_lit_list(SV.SUFFIXES)}, CAST(user_id % 8 + 8 * (CAST(floor(k / 12) AS BIGINT) % 2) + 1 AS INTEGER))"
    var = "CAST(CAST(floor(k / 4) AS BIGINT) % 3 AS INTEGER)"
    lu = "list_max(list_transform(messages, lambda m, i: CASE WHEN m.role = 'user' THEN i - 1 ELSE -1 END))"
    msgs = ("list_transform(messages, lambda m, i: CASE WHEN i - 1 = lu THEN struct_pack(role := m.role, "
            "content := m.content || ' ' || suffix) ELSE m END)")
    return (f"SELECT event_id AS request_id, ts, tenant_id0 AS tenant_id, user_id, conv_id, event_type, value, "
            f"CASE WHEN k = 99 THEN 'key-unknown' ELSE 'key-' || CAST(tenant_id0 AS VARCHAR) END AS api_key, "
            f"{q(SV.MODEL)} AS model, {msgs} AS messages, "
            f"list_extract({_lit_list(SV.TEMPERATURES)}, variant + 1) AS temperature, "
            f"list_extract({_lit_list(SV.MAX_TOKENS)}, variant + 1) AS max_tokens FROM ("
            f"SELECT b.*, m.messages, {sfx} AS suffix, {var} AS variant, {lu.replace('messages', 'm.messages')} AS lu "
            f"FROM ({base}) b JOIN msgs m USING (conv_id))")


def user_text_sql(m: str) -> str:
    return f"array_to_string(list_transform(list_filter({m}, lambda x: x.role = 'user'), lambda x: x.content), ' ')"


@cte("keyed", ["requests"])
def _():
    SV = _sv()
    raw = "sha256(array_to_string(list_transform(messages, lambda x: x.role || ':' || x.content), chr(0)))"
    sysp = "COALESCE(list_filter(messages, lambda x: x.role = 'system')[1].content, '')"
    ph = (f"sha256(concat_ws(chr(0), {sysp}, CAST(temperature AS VARCHAR), CAST(max_tokens AS VARCHAR), model))")
    est = "CAST(floor(length(array_to_string(list_transform(messages, lambda x: x.content), '')) / 4) AS BIGINT)"
    return (f"SELECT *, {raw} AS prompt_hash, {ph} AS params_hash, {user_text_sql('messages')} AS request_text, "
            f"{normalize_sql(user_text_sql('messages'))} AS prompt_normalized, {est} AS est_prompt_tokens, "
            f"sha256(api_key) AS api_key_hash, {q(SV.EMBEDDING_MODEL)} AS embedding_model FROM requests")


@cte("tenants_t")
def _():
    SV = _sv()
    return (f"SELECT tenant_id, 'tenant-' || CAST(tenant_id AS VARCHAR) AS name, "
            f"CAST({SV.BUDGET_BASE_CENTS} * pow(4, tenant_id) AS DECIMAL(12,4)) AS budget_cents, "
            f"sha256('key-' || CAST(tenant_id AS VARCHAR)) AS api_key_hash "
            f"FROM (SELECT DISTINCT user_id % {SV.N_TENANTS} AS tenant_id FROM events)")


@cte("resolved", ["keyed", "tenants_t"])
def _():
    return ("SELECT k.* EXCLUDE (tenant_id), t.tenant_id, t.budget_cents FROM keyed k "
            "JOIN tenants_t t ON k.api_key_hash = t.api_key_hash")


@cte("resolved_c", ["resolved"])
def _():
    return f"SELECT *, {constraint_cols_sql('request_text', 'c_')} FROM resolved"


EXACT_KEY_SQL = "tenant_id, prompt_hash, model, params_hash"


@cte("first_writer", ["resolved"])
def _():
    return (f"SELECT {EXACT_KEY_SQL}, first(request_id ORDER BY ts, request_id) AS entry_id, min(ts) AS created_at "
            f"FROM resolved GROUP BY {EXACT_KEY_SQL}")


@cte("exact", ["resolved_c", "first_writer"])
def _():
    return ("SELECT r.*, COALESCE(f.entry_id IS NOT NULL AND f.created_at < r.ts, false) AS exact_hit, "
            "CASE WHEN f.created_at < r.ts THEN f.entry_id END AS exact_entry_id FROM resolved_c r "
            "LEFT JOIN first_writer f USING (tenant_id, prompt_hash, model, params_hash)")


@cte("conv_emb")
def _():
    return ("SELECT c.conv_id, e.embedding FROM (SELECT DISTINCT conv_id FROM conversations) c "
            "JOIN embeddings e ON e.vec_id = c.conv_id % (SELECT count(*) FROM embeddings)")


def cos_sql(a: str, b: str) -> str:
    dot = f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)), lambda x, y: x + y)"
    na = f"sqrt(list_reduce(list_transform({a}, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)), lambda x, y: x + y))"
    nb = f"sqrt(list_reduce(list_transform({b}, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)), lambda x, y: x + y))"
    return f"({dot} / ({na} * {nb}))"


@cte("misses", ["exact", "conv_emb"])
def _():
    return "SELECT x.*, ce.embedding FROM exact x JOIN conv_emb ce USING (conv_id) WHERE NOT exact_hit"


SCOPE_SQL = ["tenant_id", "model", "params_hash", "embedding_model"]


def topk_sql(req: str, ent: str, rid: str, eid: str, scope: list[str], visible: str, k: int) -> str:
    on = " AND ".join(f"r.{c} = e.{c}" for c in scope)
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(sim, 12) DESC, entry_id) AS rank "
            f"FROM (SELECT r.{rid} AS request_id, e.{eid} AS entry_id, {cos_sql('r.embedding', 'e.embedding')} AS sim "
            f"FROM {req} r JOIN {ent} e ON {on} AND {visible})) WHERE rank <= {k}")


@cte("ent", ["resolved_c", "conv_emb", "first_writer"])
def _():
    return ("SELECT x.*, ce.embedding FROM resolved_c x JOIN conv_emb ce USING (conv_id) "
            "WHERE request_id IN (SELECT entry_id FROM first_writer)")


@cte("cands", ["misses", "ent"])
def _():
    SV = _sv()
    return topk_sql("misses", "ent", "request_id", "request_id", SCOPE_SQL, "e.ts < r.ts", SV.TOP_K)


def admit_sql(reqs: str, cands: str, req_c: str, ent_c: str, tau: float, rid: str = "request_id",
              with_trail: bool = False) -> str:
    """reqs: (rid, <req_c>count...); cands: (request_id, entry_id, rank, sim) joined to entry constraints."""
    ok = compatible_sql("rq.c_", "en.c_")
    dims = diff_dims_sql("rq.c_", "en.c_")
    c = (f"SELECT c.*, {ok} AS ok, array_to_string({dims}, '|') AS dims, c.sim < {tau!r} AS low FROM {cands} c "
         f"JOIN {reqs} rq ON c.request_id = rq.{rid} JOIN {ent_c} en ON c.entry_id = en.{rid}")
    agg = (f"SELECT request_id, arg_min(low, rank) FILTER (WHERE low OR ok) AS t_low, "
           f"arg_min(entry_id, rank) FILTER (WHERE low OR ok) AS t_entry, arg_min(sim, rank) FILTER (WHERE low OR ok) AS t_sim, "
           f"min(rank) FILTER (WHERE low OR ok) AS t_rank, arg_min(sim, rank) AS top_sim, count(*) AS n_candidates, list(dims) AS all_dims "
           f"FROM ({c}) GROUP BY request_id")
    trail = (", CASE WHEN decision = 'MISS_GATE' THEN array_to_string(list_sort(list_distinct(flatten("
             "list_transform(all_dims, lambda t: string_split(t, '|'))))), '|') END AS trail_dims") if with_trail else ""
    dec = ("CASE WHEN a.n_candidates IS NULL THEN 'MISS_NO_CANDIDATE' WHEN a.t_rank IS NULL THEN 'MISS_GATE' "
           "WHEN a.t_low THEN 'MISS_LOW_SIM' ELSE 'HIT_SEMANTIC' END")
    return (f"SELECT request_id, decision, CASE WHEN decision = 'HIT_SEMANTIC' THEN t_entry END AS candidate_id, "
            f"CASE WHEN decision = 'MISS_GATE' THEN top_sim ELSE t_sim END AS similarity, "
            f"CASE WHEN decision = 'HIT_SEMANTIC' THEN true WHEN decision = 'MISS_GATE' THEN false END AS gate_passed, "
            f"CAST(COALESCE(CASE WHEN decision = 'MISS_GATE' THEN n_candidates WHEN decision = 'HIT_SEMANTIC' THEN t_rank "
            f"WHEN decision = 'MISS_LOW_SIM' THEN t_rank - 1 END, 0) AS INTEGER) AS gate_checked{trail} FROM ("
            f"SELECT r.{rid} AS request_id, a.*, {dec} AS decision FROM {reqs} r LEFT JOIN ({agg}) a "
            f"ON a.request_id = r.{rid})")


@cte("semantic", ["misses", "cands", "ent"])
def _():
    SV = _sv()
    return admit_sql("misses", "cands", "misses", "ent", SV.TAU, with_trail=True)


@cte("decisions", ["exact", "semantic"])
def _():
    return ("SELECT x.*, 'HIT_EXACT' AS decision, x.exact_entry_id AS candidate_id, CAST(NULL AS DOUBLE) AS similarity, "
            "CAST(NULL AS BOOLEAN) AS gate_passed, 0 AS gate_checked, CAST(NULL AS VARCHAR) AS trail_dims "
            "FROM exact x WHERE exact_hit UNION ALL "
            "SELECT x.*, s.decision, s.candidate_id, s.similarity, s.gate_passed, s.gate_checked, s.trail_dims "
            "FROM exact x JOIN semantic s USING (request_id)")


# embeddings replay: every vector searches the earlier vectors of its label
@cte("vec_replay")
def _():
    SV = _sv()
    sfx = f"list_extract({_lit_list(SV.SUFFIXES)}, CAST(vec_id % 16 + 1 AS INTEGER))"
    return f"SELECT vec_id, label, embedding, {constraint_cols_sql(sfx, 'c_')} FROM embeddings"


def vec_cands_sql(k: int) -> str:
    return topk_sql("vec_replay", "vec_replay", "vec_id", "vec_id", ["label"], "e.vec_id < r.vec_id", k)


@cte("vec_cands3", ["vec_replay"])
def _():
    return vec_cands_sql(3)


@cte("vec_cands5", ["vec_replay"])
def _():
    return vec_cands_sql(5)


# ------------------------------------------------------------ audit, ledger, decision log
def _audit_mod():
    from ..functions import audit as U
    return U


def resp_sql(entry: str) -> str:
    from ..sources.serving import RESPONSES
    h = hash_u32(f"'resp:' || CAST({entry} AS VARCHAR)")
    return f"list_extract({_lit_list(RESPONSES)}, CAST({h} % {len(RESPONSES)} + 1 AS INTEGER))"


def bullets_sql(t: str) -> str:
    pat = rf"(?m)^{WS}*(?:[-*•]|\p{{Nd}}+[.)]){WS}+"
    n = f"len(regexp_extract_all({t}, {q(pat)}))"
    return f"(CASE WHEN {n} > 0 THEN CAST({n} AS INTEGER) END)"


def table_sql(t: str) -> str:
    return f"regexp_matches({t}, {q(rf'(?m)^{WS}*\|.+\|{WS}*$')})"


def json_valid_sql(t: str) -> str:
    st = f"regexp_replace({t}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"
    return (f"(CASE WHEN {st} = '' THEN false WHEN substr({st}, 1, 1) IN ('{{', '[') "
            f"THEN json_valid({st}) END)")


def language_resp_sql(t: str) -> str:
    U = _audit_mod()
    parts = [f"WHEN regexp_matches({t}, '[\\x{{{lo:X}}}-\\x{{{hi:X}}}]') THEN '{lang}'" for lang, lo, hi in U.SCRIPT_RANGES]
    parts += [f"WHEN regexp_matches(lower({t}), '[{chars}]') THEN '{lang}'" for lang, chars in U.LATIN_MARKERS]
    return "(CASE " + " ".join(parts) + " ELSE 'english' END)"


def band_sql(t: str) -> str:
    U = _audit_mod()
    return (f"(CASE WHEN length({t}) < {U.SHORT_BELOW} THEN 'short' WHEN length({t}) < {U.MEDIUM_BELOW} "
            f"THEN 'medium' ELSE 'long' END)")


def format_resp_sql(t: str) -> str:
    return (f"(CASE WHEN COALESCE({json_valid_sql(t)}, false) THEN 'json' WHEN {table_sql(t)} THEN 'table' "
            f"WHEN COALESCE({bullets_sql(t)}, 0) > 0 THEN 'bullets' ELSE 'prose' END)")


@cte("entry_resp")
def _():
    frames = _sv().RESPONSE_FRAMES
    at = f"CAST((conv_id + turn) % {len(frames)} + 1 AS INTEGER)"
    before, after = (f"list_extract({_lit_list([f[i] for f in frames])}, {at})" for i in (0, 1))
    return f"SELECT conv_id, turn, {before} || text || {after} AS response_text FROM conversations WHERE role = 'assistant'"


@cte("prompted")
def _():
    ph = fx.lexicon_phrases()
    return (f"SELECT doc_id, text || chr(10) || list_extract({_lit_list(ph)}, CAST(doc_id % {len(ph)} + 1 AS INTEGER)) AS text "
            "FROM documents")


def diff_text_sql(a: str, b: str) -> str:
    def shown(c, d):
        return f"coalesce({f'array_to_string({c}{d}, chr(44))' if d == 'entities' else f'CAST({c}{d} AS VARCHAR)'}, 'null')"
    parts = ", ".join(f"CASE WHEN {a}{d} IS DISTINCT FROM {b}{d} THEN '{d}:' || {shown(a, d)} || '->' || {shown(b, d)} END"
                      for d in C.DIMENSIONS)
    return f"concat_ws('|', {parts})"


def _est_real():
    from ..functions.keys import DEFAULT_RATE, MODEL_RATES
    rin = " ".join(f"WHEN {q(m)} THEN {i!r}" for m, i, _ in MODEL_RATES)
    rout = " ".join(f"WHEN {q(m)} THEN {o!r}" for m, _, o in MODEL_RATES)

    def cost(tokens_out):
        return (f"CAST((est_prompt_tokens / 1000.0) * (CASE model {rin} ELSE {DEFAULT_RATE[0]!r} END) + "
                f"({tokens_out} / 1000.0) * (CASE model {rout} ELSE {DEFAULT_RATE[1]!r} END) AS DECIMAL(10,6))")
    return cost("max_tokens"), cost(f"CAST(ceil(length({resp_sql('request_id')}) / 4) AS BIGINT)")


@cte("dec_costs", ["decisions"])
def _():
    est, real = _est_real()
    return (f"SELECT *, {est} AS est_cost, {real} AS real_cost, event_type = 'error' AS upstream_error, "
            f"decision IN ('MISS_LOW_SIM', 'MISS_GATE', 'MISS_NO_CANDIDATE') AS is_miss FROM decisions")


@cte("ledger_ev", ["dec_costs"])
def _():
    return ("SELECT tenant_id, request_id, ts, is_miss, upstream_error, CAST(est_cost * 1000000 AS BIGINT) AS est_u, "
            "CAST(real_cost * 1000000 AS BIGINT) AS real_u, CAST(budget_cents * 1000000 AS BIGINT) AS budget_u, "
            "row_number() OVER (PARTITION BY tenant_id ORDER BY ts, request_id) AS i FROM dec_costs")


def r4(x: str) -> str:
    return f"(CAST(sign({x}) AS BIGINT) * ((abs({x}) + 50) // 100) * 100)"


@cte("ledger_fold", ["ledger_ev"])
def _():
    s, b, est, real = "f.spent", "e.budget_u", "e.est_u", "e.real_u"
    rej = f"({s} > {b} OR NOT e.is_miss OR {s} + {est} > {b})"
    new = (f"CASE WHEN {rej} THEN {s} WHEN e.upstream_error THEN {r4(r4(f'{s} + {est}') + f' - {est}')} "
           f"ELSE {r4(r4(f'{s} + {est}') + f' + ({real} - {est})')} END")
    outcome = (f"CASE WHEN {s} > {b} THEN 'budget_rejected_preflight' WHEN NOT e.is_miss THEN 'ok' "
               f"WHEN {s} + {est} > {b} THEN 'budget_rejected_estimate' WHEN e.upstream_error "
               f"THEN 'upstream_error_refunded' ELSE 'ok' END")
    charged = f"CASE WHEN NOT {rej} AND NOT e.upstream_error THEN {real} ELSE 0 END"
    return ("SELECT tenant_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS spent, CAST(NULL AS BIGINT) AS request_id, "
            "CAST(NULL AS VARCHAR) AS outcome, CAST(0 AS BIGINT) AS charged FROM (SELECT DISTINCT tenant_id FROM ledger_ev) "
            f"UNION ALL SELECT e.tenant_id, e.i, {new}, e.request_id, {outcome}, {charged} "
            "FROM ledger_fold f JOIN ledger_ev e ON e.tenant_id = f.tenant_id AND e.i = f.i + 1")


RECURSIVE.add("ledger_fold")


@cte("ledger", ["ledger_fold", "ledger_ev"])
def _():
    return ("SELECT f.tenant_id, f.request_id, e.ts, f.outcome, CAST(f.spent / 1000000.0 AS DECIMAL(12,4)) AS spent_after, "
            "CAST(f.charged / 1000000.0 AS DECIMAL(10,6)) AS charged FROM ledger_fold f "
            "JOIN ledger_ev e ON e.tenant_id = f.tenant_id AND e.i = f.i WHERE f.i > 0")


# The replay serves the log in rounds, each from the writers of the round
# before; ``ROUNDS`` are enough at the scale of the comparison (a test counts
# the hits on entries that no successful miss wrote: none).
ROUNDS = 5
_ROUND = ["exact", "misses", "ent", "cands", "semantic", "decisions", "dec_costs", "ledger_ev", "ledger_fold", "ledger"]


def _in_round(text: str, r: int) -> str:
    text = re.sub(r"\b(" + "|".join(_ROUND) + r")\b", rf"\1_{r}", text)
    return re.sub(r"\bfirst_writer\b", f"writers_{r}", text)


CTES["writers_0"] = (
    f"SELECT {EXACT_KEY_SQL}, first(request_id ORDER BY ts, request_id) AS entry_id, min(ts) AS created_at "
    f"FROM resolved WHERE event_type <> 'error' GROUP BY {EXACT_KEY_SQL}", ["resolved"])
for _r in range(ROUNDS):
    for _n in _ROUND:
        CTES[f"{_n}_{_r}"] = (_in_round(CTES[_n][0], _r), [_in_round(d, _r) for d in CTES[_n][1]])
        (RECURSIVE if _n == "ledger_fold" else MATERIALIZED).add(f"{_n}_{_r}")
    CTES[f"writers_{_r + 1}"] = (
        f"SELECT {EXACT_KEY_SQL}, first(d.request_id ORDER BY d.ts, d.request_id) AS entry_id, min(d.ts) AS created_at "
        f"FROM dec_costs_{_r} d JOIN ledger_{_r} l ON d.request_id = l.request_id AND d.is_miss AND l.outcome = 'ok' "
        f"GROUP BY {', '.join('d.' + c.strip() for c in EXACT_KEY_SQL.split(','))}".replace(
            f"SELECT {EXACT_KEY_SQL}", "SELECT " + ", ".join("d." + c.strip() for c in EXACT_KEY_SQL.split(","))),
        [f"dec_costs_{_r}", f"ledger_{_r}"])
MATERIALIZED |= {f"writers_{_r}" for _r in range(ROUNDS + 1)} | {"resolved_c", "conv_emb"}
LAST = ROUNDS - 1


@cte("dlog", [f"dec_costs_{LAST}", f"ledger_{LAST}"])
def _():
    from ..sources.serving import EMBEDDING_MODEL, TAU
    U = _audit_mod()
    final = ("CASE WHEN l.outcome LIKE 'budget_rejected%' THEN 'MISS_BUDGET_EXCEEDED' "
             "WHEN l.outcome = 'upstream_error_refunded' THEN 'MISS_UPSTREAM_ERROR' ELSE d.decision END")
    pre = "(l.outcome = 'budget_rejected_preflight')"
    base = (f"SELECT d.*, l.outcome, l.spent_after, l.charged AS cost_cents, d.decision AS admission_decision, "
            f"{final} AS final_decision, {pre} AS pre FROM dec_costs_{LAST} d JOIN ledger_{LAST} l USING (request_id)")
    served = "CASE WHEN NOT pre AND final_decision IN ('HIT_EXACT', 'HIT_SEMANTIC') THEN candidate_id END"
    s1 = f"SELECT *, {served} AS served FROM ({base})"
    s2 = f"SELECT *, CASE WHEN served IS NOT NULL THEN {resp_sql('served')} END AS resp FROM ({s1})"
    nouns = ", ".join(q(n) for n in U.LIST_TYPE_NOUNS)
    lt = f"lower(regexp_extract(request_text, {q(COUNT_NOUN_RE2)}, 1)) IN ({nouns})"
    c_cnt = f"(c_count IS NOT NULL AND {lt} AND c_count IS DISTINCT FROM CAST({bullets_sql('resp')} AS VARCHAR))"
    c_fmt = f"(c_format IS NOT NULL AND {format_resp_sql('resp')} <> c_format)"
    c_lang = f"(c_language IS NOT NULL AND {language_resp_sql('resp')} <> c_language)"
    dims = (f"nullif(concat_ws('|', CASE WHEN {c_cnt} THEN 'count' END, CASE WHEN {c_fmt} THEN 'format' END, "
            f"CASE WHEN {c_lang} THEN 'language' END), '')")
    v = "value"
    sem = "(NOT pre AND admission_decision <> 'HIT_EXACT')"
    ups = "final_decision IN ('MISS_LOW_SIM', 'MISS_GATE', 'MISS_NO_CANDIDATE', 'MISS_UPSTREAM_ERROR')"
    return (f"SELECT request_id, tenant_id, ts, final_decision AS decision, admission_decision, "
            f"served AS candidate_id, CASE WHEN NOT pre THEN round(similarity, 6) END AS cosine_similarity, "
            f"{TAU!r} AS threshold_used, CASE WHEN NOT pre THEN gate_passed END AS gate_passed, gate_checked, "
            f"CASE WHEN final_decision = 'MISS_GATE' THEN trail_dims END AS constraint_diff, "
            f"CASE WHEN served IS NOT NULL THEN {dims} IS NULL END AS output_audit_ok, "
            f"CASE WHEN served IS NOT NULL THEN {dims} END AS output_audit_diff, "
            f"CASE WHEN {sem} THEN {v} END AS embed_ms, CASE WHEN {sem} THEN {v} * 0.5 END AS search_ms, "
            f"CASE WHEN {sem} THEN {v} * 0.01 END AS gate_ms, CASE WHEN {ups} THEN {v} * 100.0 END AS upstream_ms, "
            f"CASE WHEN pre THEN {v} * 0.05 WHEN final_decision = 'HIT_EXACT' THEN {v} * 0.1 ELSE "
            f"{v} + {v} * 0.5 + {v} * 0.01 + COALESCE(CASE WHEN {ups} THEN {v} * 100.0 END, 0.0) END AS total_ms, "
            f"cost_cents, spent_after, {q(EMBEDDING_MODEL)} AS embedding_model, outcome FROM ({s2})")


# ------------------------------------------------------------ costs, frozen subset
@cte("gated_curve", ["long"])
def _():
    return ("SELECT round(CAST(700 + 5 * i AS DOUBLE) / 1000.0, 3) AS threshold, tp / n_pos AS tpr, fp / n_neg AS fpr FROM ("
            "SELECT i, count(*) FILTER (WHERE y AND score >= CAST(700 + 5 * i AS DOUBLE) / 1000.0) AS tp, "
            "count(*) FILTER (WHERE NOT y AND score >= CAST(700 + 5 * i AS DOUBLE) / 1000.0) AS fp, "
            "count(*) FILTER (WHERE y) AS n_pos, count(*) FILTER (WHERE NOT y) AS n_neg "
            "FROM long CROSS JOIN range(0, 62) t(i) WHERE group_name = 'roc_b' AND variant = 'gated' GROUP BY i)")


def cost_sql(ratios) -> str:
    from ..operators.costs import RHOS, SURFACE_HI, SURFACE_LO, SURFACE_POINTS
    rho = "(VALUES " + ", ".join(f"({r!r})" for r in RHOS) + ") rh(rho)"
    if ratios is None:
        rat = (f"(SELECT i, pow(10.0, {SURFACE_LO} + {SURFACE_HI - SURFACE_LO} * i / {SURFACE_POINTS - 1}) AS ratio "
               f"FROM range(0, {SURFACE_POINTS}) t(i)) ra")
    else:
        rat = "(VALUES " + ", ".join(f"({i}, {r!r})" for i, r in enumerate(ratios)) + ") ra(i, ratio)"
    c = "cm.c_miss"
    phit = "(rho * tpr + (1.0 - rho) * fpr)"
    pfh = "((1.0 - rho) * fpr)"
    return (f"SELECT rho, i, ratio, threshold, tpr, fpr, (1.0 - {phit}) * {c} + {pfh} * (ratio * {c}) AS expected_cost "
            f"FROM gated_curve CROSS JOIN {rho} CROSS JOIN {rat} CROSS JOIN cmiss cm")


@cte("cmiss", ["dlog"])
def _():
    return ("SELECT round(avg(CAST(cost_cents AS DOUBLE)), 9) AS c_miss FROM dlog "
            "WHERE decision LIKE 'MISS%' AND cost_cents > 0")


@cte("frozen", ["scored_p"])
def _():
    return ("SELECT * EXCLUDE (rn, nf) FROM (SELECT s.*, row_number() OVER (PARTITION BY stratum ORDER BY "
            f"{hash_key(0, 'pair_id')}, pair_id) AS rn, (SELECT count(DISTINCT family) FROM scored_p WHERE population = 'P3') AS nf "
            "FROM (SELECT *, CASE WHEN population = 'P3_control' THEN 'control' ELSE family END AS stratum FROM scored_p "
            "WHERE population IN ('P3', 'P3_control')) s) WHERE rn <= CASE WHEN stratum = 'control' THEN 50 ELSE CAST(floor(150 / nf) AS BIGINT) END")


@cte("scored_p", ["pair_compat"])
def _():
    return (f"SELECT pair_id, population, family, split, workload_label, safe_to_reuse AS y, compatible, prompt_a, prompt_b, "
            f"{sim_sql('ba', 'bb')} AS sim FROM (SELECT *, {bow_sql('prompt_a')} AS ba, {bow_sql('prompt_b')} AS bb "
            f"FROM pair_compat)")
