"""Structure repair of conversations by rank-convergence parallel Viterbi.

The rows of a conversation in turn order are edited at least cost until their
role initials read ``(s?(ua)+)?``. Four states tell what may come next; the
backward cost of a state is that of the cheapest edits of all rows from here on.
A row maps the cost vector behind it to the one before it, linearly in the
(min, +) algebra.

Rows are range-partitioned by conversation and turn. The rows of a conversation
in one partition are a chunk, so no task holds more than a partition, however
long a conversation is. A conversation that lies inside a partition is settled
there. The others, those at the edges of partitions, go on in chunks:

* each chunk runs backward from speculative cost vectors, one per state (zero
  there, unreachable elsewhere), which give its result for any vector. Only
  finitely many vectors can occur up to a constant (``VECTORS``); if their
  results differ only by constants the chunk is settled, whatever follows it;
* a fix-up pass reruns every open chunk on the result of the chunk behind it,
  which settles it, or, if that one is open too, on its speculative vectors, and
  then looks behind that one; so the passes are logarithmic in the number of
  open chunks in a row;
* from the stitched vectors each chunk traces the least audit for every state
  that it may start in; the same doubling, from the front, tells which one it is.

What a chunk leaves for the last step is one piece of audit and repaired text."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1  # costs of edits, and of an undeleted truncated row
CHUNK_ROWS = 50_000   # rows of a partition
START, SYSTEM, USER, ASSISTANT = range(4)  # at the start, after a system row, a user's or an assistant's turn
STEP = (ASSISTANT, ASSISTANT, ASSISTANT, USER)  # after a user's row, or an assistant's
WANTED = ("user", "user", "user", "assistant")
KEPT = {"s": (SYSTEM, None, None, None), "u": (ASSISTANT, ASSISTANT, ASSISTANT, None), "a": (None, None, None, USER)}
NONE = (None,) * 4
FAR = 1 << 40
END = (0, 2 * INSERT, 0, INSERT)  # what inserts complete the sequence


def _closed(v) -> tuple:
    """Costs with inserts before the next row."""
    one = [min(v[s], INSERT + v[STEP[s]]) for s in range(4)]
    return tuple(min(one[s], INSERT + one[STEP[s]]) for s in range(4))


def _before(row, v) -> tuple:
    """Cost vector before a row ``(must go, initial, truncated)``."""
    gone, initial, cut = row
    if gone:
        return tuple(DELETE + x for x in v)
    kept = KEPT.get(initial, NONE)
    return _closed([min(DELETE + v[s], REROLE + cut + v[STEP[s]], FAR if kept[s] is None else cut + v[kept[s]])
                    for s in range(4)])


def _level(v) -> tuple:
    """A vector up to a constant."""
    return tuple(x - v[USER] for x in v)


def _vectors() -> list[tuple]:
    """All cost vectors that some rows lead to, up to a constant."""
    rows = [(True, "", 0)] + [(False, c, cut) for c in "sua?" for cut in (0, CUT_OFF)]
    seen, todo = {_level(END)}, [_level(END)]
    while todo:
        v = todo.pop()
        for w in (_level(_before(r, v)) for r in rows):
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return sorted(seen)


VECTORS = _vectors()


def _times(m, v) -> tuple:
    """A chunk's result for the vector behind it; ``m[4 * s + t]`` is the cost from state s before it to t behind."""
    return tuple(min(m[4 * s + t] + v[t] for t in range(4)) for s in range(4))


def _agreed(m):
    """The chunk's vector, if all vectors behind it lead to the same one up to a constant."""
    found = {_level(_times(m, v)) for v in VECTORS}
    return list(found.pop()) if len(found) == 1 else None


def _speculate(rows) -> list[int]:
    out = [[FAR] * 4 for _ in range(4)]
    for t in range(4):
        v = tuple(0 if s == t else FAR for s in range(4))
        for row in reversed(rows):
            v = tuple(min(x, FAR) for x in _before(row, v))
        for s in range(4):
            out[s][t] = v[s]
    return sum(out, [])


def _backward(rows, end) -> list[tuple]:
    out = [tuple(end)]
    for row in reversed(rows):
        out.append(_before(row, out[-1]))
    return out[::-1]


def _trace(rows, costs, state: int, last: bool):
    """Least cheapest edits from a state: their initials, the state behind the
    rows. Delete, Insert, Keep and Rerole are tried in the order of their letters."""
    audit = []
    for (gone, initial, cut), v, w in zip(rows, costs, costs[1:]):
        kept = KEPT.get(initial, NONE)
        while True:
            if v[state] == DELETE + w[state]:
                audit.append("D")
            elif v[state] == INSERT + v[STEP[state]]:
                audit.append("I")
                state = STEP[state]
                continue
            elif kept[state] is not None and v[state] == cut + w[kept[state]]:
                audit.append("K")
                state = kept[state]
            else:
                audit.append("R")
                state = STEP[state]
            break
    while last and state in (SYSTEM, ASSISTANT):
        audit.append("I")
        state = STEP[state]
    return "".join(audit), state


def _carry_out(rows, texts, audit: str, state: int):
    """Cost and repaired lines of a traced audit."""
    cost, lines, at = 0, [], 0
    for edit in audit:
        if edit == "I":
            cost += INSERT
            lines.append(WANTED[state] + ":")
            state = STEP[state]
            continue
        (_, initial, cut), (role, text) = rows[at], texts[at]
        at += 1
        if edit == "D":
            cost += DELETE
        elif edit == "K":
            cost += cut
            lines.append(f"{role}:{text}")
            state = KEPT[initial][state]
        else:
            cost += REROLE + cut
            lines.append(f"{WANTED[state]}:{text}")
            state = STEP[state]
    return cost, lines


def _counts(faults, roles, turns):
    """Rows by fault, illegal neighbours, and least, greatest and number of distinct turns (nulls left out)."""
    pairs = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    known = [t for t in turns if t is not None and t == t]
    return (faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), pairs,
            int(known[0]) if known else None, int(known[-1]) if known else None, len(set(known)))


def _rows(faults, roles):
    return [(f in ("blank", "duplicate"), r[:1], CUT_OFF if f == "truncated" else 0) for f, r in zip(faults, roles)]


# --- Spark -------------------------------------------------------------------
def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, gone)`` with faults put in by a hash of
    conversation and turn: of 20 values 0 drops a row (it comes back ``gone``),
    1 empties its text, 2 takes its end marks out, 3 repeats it, 4 makes it the
    user's. A null is one space in the hash, the role and the text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    d = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), space(role_col).alias("role"),
                             space(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_PIECE = ("blank bigint, duplicate bigint, truncated bigint, illegal bigint, least bigint, most bigint, turns bigint, "
          "cost bigint, audit string, lines bigint, repaired string")


def _names(ddl: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in ddl.split(",")]


def _gaps(least, most, turns) -> int:
    return 0 if least is None else most - least + 1 - turns


def _sorted_rows(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Rows in the order of conversation and turn, each with its fault. The
    first holder of a conversation's (role, text) is found by a grouped minimum;
    a mark with the same sort key precedes it, so the texts are shuffled once. Copies of one row differ in
    ``salt`` alone, which spreads them over partitions."""
    space = r"[\x20\x09-\x0D]"
    d = rows.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.coalesce("gone", F.lit(False)).alias("gone"), F.monotonically_increasing_id().alias("salt"))
    d = stage_table(d.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)),
                    "conversation-rows")
    first = d.filter("not gone").groupBy("conv_id", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "salt")).alias("f"))
    marks = first.select("conv_id", "f.turn", "digest", "f.salt", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("fault"))
    fault = (F.when(F.col("gone"), "gone").when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
             .when(~F.col("text").rlike(rf"[.!?]{space}*\z"), "truncated").otherwise("none"))
    every = d.select("conv_id", "turn", "digest", "salt", F.lit(1).alias("kind"), "role", "text", fault.alias("fault"))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-d.count() // chunk_rows))
    key = ["conv_id", "turn", "digest", "salt"]
    return marks.unionByName(every).repartitionByRange(parts, *key).sortWithinPartitions(*key, "kind").select(
        "conv_id", "turn", "kind", "role", "text", "fault")


def _inside(kind: str, turn: str, with_text: bool):
    """Conversations inside a partition, whole; the rows of the first and the last one, as they are."""
    result = _names(RESULT)
    ddl = (f"conv_id {kind}, part int, open boolean, {RESULT}, repaired string, seq bigint, turn {turn}, role string, "
           "text string, fault string")
    schema = _arrow(ddl)

    def run(batches):
        part, nothing = TaskContext.get().partitionId(), object()
        conv, rows, first, marked = nothing, [], True, False
        out = []

        def close(is_open: bool):
            if is_open:
                out.extend((conv, part, True, *(None,) * (len(result) + 1), k, *r) for k, r in enumerate(rows))
                return
            live = [r for r in rows if r[3] != "gone"]
            turns, roles, texts, faults = (list(c) for c in zip(*live)) if live else ([],) * 4
            chain = _rows(faults, roles)
            audit, _ = _trace(chain, _backward(chain, END), START, True)
            cost, lines = _carry_out(chain, list(zip(roles, texts)), audit, START)
            *faulty, illegal, least, most, distinct = _counts(faults, roles, turns)
            text = "\n".join(lines)
            out.append((conv, part, False, _gaps(least, most, distinct), *faulty, illegal, cost, audit,
                        hashlib.sha256(text.encode()).hexdigest(), text if with_text else None, None, None, None, None, None))

        def batch_of():
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * len(schema), schema)],
                                             schema=schema)
            out.clear()
            return got

        for batch in batches:
            for c, t, k, role, text, fault in zip(*(x.to_pylist() for x in batch.columns)):
                if conv is nothing or c != conv:
                    if conv is not nothing:
                        close(first)
                        first = False
                    conv, rows = c, []
                if k == 0:
                    marked = True
                    continue
                # the first fault counts: a blank row stays blank, whatever was seen earlier
                if fault not in ("gone", "blank") and not marked:
                    fault = "duplicate"
                marked = marked and fault == "gone"
                rows.append((t, role, text, fault))
            if len(out) > 1000:
                yield batch_of()
        if conv is not nothing:
            close(True)
            yield batch_of()

    return run, ddl


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(ddl))


def _settled(chunks: DataFrame, behind: str, rerun, name: str) -> DataFrame:
    """Fix-up passes over ``(conv_id, part, link, f, v)``: an open chunk (null
    ``v``) takes what the chunk that it is linked to has, by ``rerun(f, f of
    that, v of that)``, and the link of that one."""
    schema = chunks.schema

    def step(pdfs):
        for pdf in pdfs:
            f, v, link = [], [], []
            for mine, known, at, theirs, value, on in zip(pdf.f, pdf.v, pdf.link, pdf["_f"], pdf["_v"], pdf["_link"]):
                if known is None and theirs is not None:
                    mine, known = rerun([int(x) for x in mine], [int(x) for x in theirs],
                                        None if value is None else [int(x) for x in value])
                    at = on
                f.append(mine)
                v.append(known)
                link.append(None if pd.isna(at) else int(at))
            yield pd.DataFrame({"conv_id": pdf.conv_id, "part": pdf.part, "link": pd.array(link, "Int32"), "f": f, "v": v})

    while not chunks.filter("v is null").isEmpty():
        on = chunks.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.col("link").alias("_link"),
                           F.col("f").alias("_f"), F.col("v").alias("_v"))
        joined = chunks.join(on, chunks["conv_id"].eqNullSafe(on["_c"]) & (chunks["link"] == on["_p"])
                             & chunks["v"].isNull(), "left")
        chunks = stage_table(joined.drop("_c", "_p").mapInPandas(step, schema), name)
    return chunks


def _chunked(rows: DataFrame, kind: str, with_text: bool) -> DataFrame:
    """Conversations at the edges of partitions, chunk by chunk."""
    groups = ["conv_id", "part"]

    def columns(pdf):
        pdf = pdf[pdf.fault != "gone"].sort_values("seq")
        return pdf.fault.tolist(), pdf.role.tolist(), pdf.text.tolist(), [None if pd.isna(t) else t for t in pdf.turn]

    def summary(pdf):
        faults, roles, _, turns = columns(pdf)
        *numbers, least, most, distinct = _counts(faults, roles, turns)
        m = _speculate(_rows(faults, roles))
        return pd.DataFrame([[pdf.conv_id.iloc[0], pdf.part.iloc[0], m, _agreed(m), *numbers, least, most, distinct,
                              roles[0][:1] if roles else None, roles[-1][:1] if roles else None]],
                            columns=[*groups, "f", "v", *_names(SUMMARY)]).astype({"least": "Int64", "most": "Int64"})

    SUMMARY = ("blank bigint, duplicate bigint, truncated bigint, illegal bigint, least bigint, most bigint, turns bigint, "
               "opens string, ends string")
    chunks = rows.groupBy(*groups).applyInPandas(
        summary, f"conv_id {kind}, part int, f array<bigint>, v array<bigint>, {SUMMARY}")
    # a row for each partition that a conversation reaches
    order = Window.partitionBy("conv_id").orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ended, most = F.last("ends", True).over(before), F.max("most").over(before)
    joint = F.when(F.col("opens").isNotNull() & ended.isNotNull()
                   & ~F.concat(ended, "opens").isin("su", "ua", "au"), 1).otherwise(0)
    chunks = chunks.withColumn("after", F.lead("part").over(order)).withColumn("prior", F.lag("part").over(order)) \
        .withColumn("illegal", F.col("illegal") + joint) \
        .withColumn("turns", F.col("turns") - F.when(most == F.col("least"), 1).otherwise(0))
    end = F.array(*[F.lit(x).cast("long") for x in END])
    chunks = stage_table(chunks, "conversation-chunks")

    # the vector behind each chunk
    def onto(mine, theirs, value):
        if value is not None:
            return mine, list(_level(_times(mine, value)))
        m = sum(([min(FAR, min(mine[4 * s + k] + theirs[4 * k + t] for k in range(4))) for t in range(4)] for s in range(4)), [])
        return m, _agreed(m)

    ends = chunks.select(*groups, F.col("after").alias("link"), "f", "v")
    stop = ends.filter("link is null").select(  # the end itself, as a chunk behind the last
        "conv_id", F.lit(-1).alias("part"), F.lit(None).cast("int").alias("link"), "f", end.alias("v"))
    vectors = _settled(stage_table(ends.withColumn("link", F.coalesce("link", F.lit(-1))).unionByName(stop), "conversation-ends"),
                       "link", onto, "conversation-ends")
    vectors = vectors.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.col("v").alias("behind"))
    placed = chunks.select(*groups, "after", "prior").join(
        vectors, chunks["conv_id"].eqNullSafe(vectors["_c"]) & (F.coalesce("after", F.lit(-1)) == vectors["_p"])).select(
        F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "after", "prior", "behind")
    ready = stage_table(rows.join(placed, rows["conv_id"].eqNullSafe(placed["_c"]) & (rows["part"] == placed["_p"]))
                        .drop("_c", "_p"), "conversation-open")

    # the state before each chunk
    def through(pdf):
        faults, roles, _, _ = columns(pdf)
        chain, last = _rows(faults, roles), bool(pd.isna(pdf.after.iloc[0]))
        costs = _backward(chain, [int(x) for x in pdf.behind.iloc[0]])
        f = [_trace(chain, costs, s, last)[1] for s in range(4)]
        first = pd.isna(pdf.prior.iloc[0])
        v = [f[START]] if first else [f[0]] if len(set(f)) == 1 else None
        return pd.DataFrame({"conv_id": pdf.conv_id.iloc[:1], "part": pdf.part.iloc[:1],
                             "link": pd.array([None if first else int(pdf.prior.iloc[0])], "Int32"), "f": [f], "v": [v]})

    def upon(mine, theirs, value):
        if value is not None:
            return mine, [mine[value[0]]]
        f = [mine[s] for s in theirs]
        return f, [f[0]] if len(set(f)) == 1 else None

    passed = _settled(stage_table(ready.groupBy(*groups).applyInPandas(
        through, f"conv_id {kind}, part int, link int, f array<bigint>, v array<bigint>"), "conversation-states"),
        "link", upon, "conversation-states")
    state = passed.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.col("v")[0].alias("state"))
    ready = ready.join(state, ready["conv_id"].eqNullSafe(state["_c"]) & (ready["prior"] == state["_p"]), "left").drop("_c", "_p")

    def piece(pdf):
        faults, roles, texts, _ = columns(pdf)
        chain, last = _rows(faults, roles), bool(pd.isna(pdf.after.iloc[0]))
        begin = START if pd.isna(pdf.state.iloc[0]) else int(pdf.state.iloc[0])
        audit, _ = _trace(chain, _backward(chain, [int(x) for x in pdf.behind.iloc[0]]), begin, last)
        cost, lines = _carry_out(chain, list(zip(roles, texts)), audit, begin)
        return pd.DataFrame({"conv_id": pdf.conv_id.iloc[:1], "part": pdf.part.iloc[:1], "cost": [cost], "audit": [audit],
                             "lines": [len(lines)], "repaired": ["\n".join(lines)]})

    pieces = ready.groupBy(*groups).applyInPandas(
        piece, f"conv_id {kind}, part int, cost bigint, audit string, lines bigint, repaired string")
    told = chunks.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "blank", "duplicate", "truncated", "illegal",
                         "least", "most", "turns")
    pieces = pieces.join(told, pieces["conv_id"].eqNullSafe(told["_c"]) & (pieces["part"] == told["_p"]))

    types = [f.type for f in _arrow(f"conv_id {kind}, {RESULT}, repaired string")]
    names = ["conv_id", *_names(RESULT), "repaired"]

    # SHA-256 goes through a text in order: pieces stream by, one at a time
    def stitch(batches):
        nothing = object()
        conv, sums, turn, audit, sha, texts, lines = nothing, None, None, [], None, [], 0

        def row():
            least, most, turns = turn
            return (conv, _gaps(least, most, turns), *sums[:4], sums[4], "".join(audit), sha.hexdigest(),
                    "\n".join(texts) if with_text else None)

        def batch_of(r):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(r, types)], names)

        for batch in batches:
            for c, *n, least, most, turns, cost, audited, count, text in zip(*(x.to_pylist() for x in batch.columns)):
                if conv is nothing or c != conv:
                    if conv is not nothing:
                        yield batch_of(row())
                    conv, sums, turn, audit, sha, texts, lines = c, [0] * 5, (None, None, 0), [], hashlib.sha256(), [], 0
                sums = [a + b for a, b in zip(sums, [*n, cost])]
                if least is not None:
                    turn = (least if turn[0] is None else turn[0], most, turn[2] + turns)
                audit.append(audited)
                if count:
                    sha.update(("\n" if lines else "").encode() + text.encode())
                    lines += count
                    if with_text:
                        texts.append(text)
        if conv is not nothing:
            yield batch_of(row())

    return (pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part")
            .select("conv_id", *_names(_PIECE)).mapInArrow(stitch, f"conv_id {kind}, {RESULT}, repaired string"))


def repair(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS, with_text: bool = False) -> DataFrame:
    """One row per ``conv_id`` of ``conversations(conv_id, turn, role, text)``
    (and ``gone``, if there: such rows only name their conversation): ``gaps``
    (turn numbers that are missing), rows that are ``blank``, ``duplicate`` or
    ``truncated`` (a row's first fault counts), ``illegal`` neighbours, the
    ``cost`` of the cheapest edits, their initials (``audit``, the least of
    several), the SHA-256 of the repaired rows (``role:text`` lines) and, if
    wanted, these lines as ``repaired``.

    Rows go by turn, nulls first; those of one turn by a hash of role and text.
    A null role or text is one space; null ``conv_id`` rows are one
    conversation; repeated rows are duplicates; other columns are not read; a
    conversation without rows has zeros, an empty audit and the hash of an
    empty text; an empty table gives no rows. The audit and the hash of one
    conversation are one row's values: their pieces, one per partition, are put
    together in order in one task, which keeps no text."""
    gone = F.col("gone") if "gone" in conversations.columns else F.lit(False)
    rows = conversations.select("conv_id", "turn", "role", "text", gone.alias("gone"))
    kind, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    run, ddl = _inside(kind, turn, with_text)
    found = stage_table(_sorted_rows(rows, chunk_rows).mapInArrow(run, ddl), "conversation-parts")
    done = found.filter("not open").select("conv_id", *_names(RESULT), "repaired")
    rest = _chunked(found.filter("open").select("conv_id", "part", "seq", "turn", "role", "text", "fault"), kind, with_text)
    out = done.unionByName(rest)
    return out if with_text else out.drop("repaired")
