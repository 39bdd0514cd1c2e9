import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from reuselens.llm import conversations as C

BLANK = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def harm(rows):
    out = []
    for c, t, r, x in rows:
        z = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{z(c)}:{z(t)}".encode()) % 20
        r, x = z(r), z(x)
        if k == 0:
            continue
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def cheapest(rows):
    """Least cost and audit by a search over (cost, audit, rows done, initials so far)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, at, lines = heapq.heappop(heap)
        if i == len(rows) and at in ("", "a"):
            return cost, audit, "\n".join(lines)
        if (i, at) in done:
            continue
        done.add((i, at))
        for role in ("user", "assistant"):
            if (at, role[0]) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], lines + (role + ":",)))
        if i < len(rows):
            fault, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, at, lines))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if (at, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, role[:1], lines + (f"{role}:{text}",)))
                for new in ("user", "assistant"):
                    if (at, new[0]) in NEXT:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, new[0], lines + (f"{new}:{text}",)))


def brute(rows, every):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t, r, x))
    out = []
    for c in every:
        mine = sorted(convs.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(
            f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, r, x in mine:
            end = x.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("blank" if not BLANK.search(x) else "duplicate" if (r, x) in seen else
                          "truncated" if end[-1] not in ".!?" else "none")
            seen.add((r, x))
        turns = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        cost, audit, text = cheapest([(f, r, x) for f, (_, r, x) in zip(faults, mine)])
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
                    faults.count("duplicate"), faults.count("truncated"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", *C._names(C.RESULT), "repaired").collect()), key=str)


def test_whole_table(spark):
    convs = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in convs.collect()]
    want = brute(harm(rows), {r[0] for r in rows})
    for chunk in (50_000, 3):
        assert got(C.repair(C.damaged(convs), chunk, with_text=True)) == want
    assert {c for r in want for c in r[7]} == set("DIKR")


@pytest.mark.parametrize("chunk", [2, 1000])
def test_long_conversations_in_chunks(spark, chunk):
    rng = random.Random(chunk)
    rows = []
    for c in range(12):
        roles = rng.choice([["user", "assistant"], ["tool"], ["user"], ["system", "user", "assistant", "tool", ""]])
        texts = rng.choice([["one."], ["one.", "two", " ", "three! "], [f"{k}." for k in range(100)]])
        for t in range(rng.choice([1, 5, 40, 60])):
            rows.append((c, rng.choice([t, t, t, None, t + 5]), roles[t % len(roles)] if rng.random() < 0.7 else rng.choice(roles),
                         rng.choice(texts)))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(C.repair(frame, chunk, with_text=True)) == brute(rows, {r[0] for r in rows})


def test_chain_that_never_converges(spark, monkeypatch):
    # rows of a foreign role: the parity of what follows decides, through all chunks
    rows = [(1, t, "tool", f"{t}.") for t in range(301)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    passes, stage = [], C.stage_table
    monkeypatch.setattr(C, "stage_table", lambda df, name: passes.append(name) or stage(df, name))
    got_rows = got(C.repair(frame, 5, with_text=True))
    (cost, audit, text), = [cheapest([("none", "tool", x) for _, _, _, x in rows])]
    assert got_rows == [(1, 0, 0, 0, 0, 300, cost, audit, hashlib.sha256(text.encode()).hexdigest(), text)]
    assert passes.count("conversation-ends") <= 10 and passes.count("conversation-states") <= 10  # 61 chunks


def test_machines():
    assert len(C.VECTORS) < 100
    rng = random.Random(2)
    for _ in range(300):
        rows = [(rng.choice(["none", "none", "truncated", "blank"]), rng.choice(["system", "user", "assistant", "tool", ""]), "x")
                for _ in range(rng.randint(0, 9))]
        chain = C._rows([f for f, _, _ in rows], [r for _, r, _ in rows])
        audit, state = C._trace(chain, C._backward(chain, C.END), C.START, True)
        cost, lines = C._carry_out(chain, [(r, x) for _, r, x in rows], audit, C.START)
        assert (cost, audit, "\n".join(lines)) == cheapest(rows) and state in (C.START, C.USER)
        v = rng.choice(C.VECTORS)
        assert C._level(C._times(C._speculate(chain), v)) == C._level(C._backward(chain, v)[0])


def test_odd_rows(spark):
    rows = [(None, 1, "user", "hi."), (None, None, None, None), (None, 1, "user", "hi."), (5, None, "user", None),
            (5, None, "assistant", "\t\n"), (6, 3, "user", "long " * 200_000 + "."), (6, 4, "assistant", "x "),
            (7, -3, "User", "A?"), (7, 9, "assistant", "b!\r\n"), (8, 0, "", "a."), (8, 0, "user", "a."), (9, 1, "system", "s."),
            *[(10, t, "user", "again.") for t in range(30)], *[(11, 2, "assistant", "same.")] * 20]
    frame = spark.createDataFrame([(t, c, "k", x, r, 0, "n") for c, t, r, x in rows],
                                  "turn long, conv_id long, kind string, text string, role string, part int, fault string")
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for chunk in (4, 1000):
        assert got(C.repair(frame, chunk, with_text=True)) == brute(plain, {r[0] for r in rows})
        assert got(C.repair(C.damaged(frame), chunk, with_text=True)) == brute(harm(rows), {r[0] for r in rows})
    assert C.repair(frame.limit(0)).collect() == []
    everything = spark.createDataFrame([(1, 1, "user", "a.", True)], "conv_id long, turn long, role string, text string, gone boolean")
    assert got(C.repair(everything, with_text=True)) == brute([], {1})
    named = spark.createDataFrame([("b", 1, "user", "a."), (None, 1, "assistant", "c.")], "conv_id string, turn int, role string, text string")
    assert [r.audit for r in C.repair(named).orderBy("conv_id").collect()] == ["IK", "KI"]
