"""Conversation repair against a plain search over all rows of a conversation at once."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from airlens.llm import conversations, queries

SPACES = " \t\n\v\f\r"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * {0: 0, 3: 2}.get(d, 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by extending the least (cost, audit) of each role the rows so far may end in."""
    best = {"": (0, "", [])}

    def put(into, state, entry):
        if state not in into or entry[:2] < into[state][:2]:
            into[state] = entry

    def after(state):
        return "a" if state == "u" else "u"

    names = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(3):
            for state, (cost, audit, done) in list(states.items()):
                put(states, after(state), (cost + 5, audit + "I", [*done, (names[after(state)], "")]))
        return states

    for role, text, forced, cut in rows:
        now = {}
        for state, (cost, audit, done) in inserted(best).items():
            put(now, state, (cost + 2, audit + "D", done))
            if not forced:
                to = after(state)
                put(now, to, (cost + 1 + 5 * cut, audit + "R", [*done, (names[to], text)]))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    put(now, role[:1], (cost + 5 * cut, audit + "K", [*done, (role, text)]))
        best = now
    return min(v for k, v in inserted(best).items() if k in ("", "a"))


def plain(rows, convs):
    out = []
    for conv in convs:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, steps = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in own:
            shown = text.rstrip(SPACES)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            steps.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        turns = {r[0] for r in own if r[0] is not None}
        cost, audit, done = cheapest(steps)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, digest))
    return sorted(map(repr, out))


def taken(df):
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in df.collect())


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert taken(queries.QUERIES["op11_conversation_repair"](spark, sf_dir)) == plain(damage(rows), {r[0] for r in rows})


def odd(seed, n, convs):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "Three", "", None, " \t", "A\n", "Four? ", "é…", "x" * 5000 + ".", "One.", "q "]
    roles = ["user", "assistant", "system", "user", "assistant", "", None, "tool", "Sys", "ü"]
    return [(rng.choice([None, *range(convs)]), rng.choice([None, *range(40), 2**53 + 1, -5]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("steps", [4096, 5])
def test_odd_rows_in_blocks(spark, steps):
    rows = odd(steps, 700, 12) + [(99, 1, "user", "same.")] * 40
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, cost int")
    got = conversations.report(conversations.damaged(docs), steps=steps)
    assert taken(got) == plain(damage(rows), {r[0] for r in rows})


def test_large_conversation_and_repaired_rows(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"No {t}", f"Well {t}."])) for t in range(2500)]
    rows += [(c, t, "ua"[t % 2] + "x", f"{c}.") for c in range(2, 40) for t in range(3)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = taken(conversations.report(docs, steps=1 << 12))
    assert whole == plain(rows, {r[0] for r in rows}) == taken(conversations.report(docs, steps=64))
    lines = {}
    for r in sorted(conversations.repaired(docs, steps=100).collect(), key=lambda r: (r.part, r.no, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    found = {r.conv_id: r.repaired_sha256 for r in conversations.report(docs).collect()}
    assert all(found[c] == hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in found)


def test_no_rows(spark):
    docs = spark.createDataFrame([(7, 1, "user", "Hi.", 0), (7, None, None, None, 0), (8, 3, "system", "Be kind.", 1)], "conv_id long, turn long, role string, text string, times int")
    empty = hashlib.sha256(b"").hexdigest()
    assert taken(conversations.report(docs)) == sorted(map(repr, [(7, 0, 0, 0, 0, 0, 0, "", empty), (8, 0, 0, 0, 0, 0, 2, "D", empty)]))
    assert conversations.report(docs.where("false")).count() == conversations.repaired(docs.where("false")).count() == 0


def test_ranks_follow_audits():
    rng = np.random.default_rng(5)
    codes = rng.choice(np.array([1, 2, 3, 4, 10, 11, 0], dtype=np.uint8), 40)
    arcs = conversations.Arcs([(codes, np.array(conversations.END), True)])
    names = [(bytes(arcs.letter[p[p > 0]].tolist()), n) for n, p in enumerate(arcs.paths(np.arange(4 * 41)))]
    first = arcs._least(arcs.rank)
    some = [(name, n) for name, n in names if name]
    assert [name for name, _ in sorted(some, key=lambda x: arcs.rank[first[x[1]]])] == sorted(name for name, _ in some)


def test_costs_of_blocks_compose():
    rng = np.random.default_rng(6)
    codes = rng.choice(np.array([1, 2, 3, 4, 10, 11, 0], dtype=np.uint8), 33)
    whole = conversations.costs(codes)
    assert (conversations._then(conversations.costs(codes[:10]), conversations.costs(codes[10:])) == whole).all()
    end = np.array(conversations.END)
    assert ((whole + end).min(axis=1) == conversations._to_go(codes, end)[0]).all()
