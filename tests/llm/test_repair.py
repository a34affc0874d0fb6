"""Conversation repair: the search against a table over all states, whole results against a plain version."""

import hashlib
import itertools
import random
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigilog.llm import repair
from vigilog.llm.queries import QUERIES
from vigilog.llm.repair import CUT_OFF, FINAL, MUST_GO, START, STATES, Repair, joined, lower_bounds, repair_codes, search, stretches, summary, ways

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
GIVES = {0: "u", 1: "u", 2: "a", 3: "u"}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def table_of(codes, entry=START):
    """Cheapest letters at each state after all rows, by a table over rows and states."""
    best = {entry: (0, "")}

    def insert():
        for _ in range(4):
            for s, (c, a) in list(best.items()):
                t = (c + 5, a + "I")
                if NEXT[s] not in best or t < best[NEXT[s]]:
                    best[NEXT[s]] = t

    insert()
    for code in codes:
        old, best = best, {}
        for s, (c, a) in old.items():
            moves = [(s, c + 2, a + "D")]
            if not code & MUST_GO:
                more = 5 if code & CUT_OFF else 0
                moves.append((NEXT[s], c + 1 + more, a + "R"))
                role = "?sua"[code & 3]
                if role == "s" and s == 0:
                    moves.append((1, c + more, a + "K"))
                elif role == GIVES[s]:
                    moves.append((NEXT[s], c + more, a + "K"))
            for t, c2, a2 in moves:
                if t not in best or (c2, a2) < best[t]:
                    best[t] = (c2, a2)
        insert()
    return best


CODES = st.binary(max_size=40).map(lambda b: bytes(x % 4 + (MUST_GO if x % 16 == 4 else CUT_OFF if x % 16 == 9 else 0) for x in b))


@settings(max_examples=300, deadline=None)
@given(CODES)
def test_search_is_cheapest_and_least(codes):
    table = table_of(codes)
    assert search(codes) == min(table[s] for s in FINAL if s in table)
    for entry in STATES:
        table = table_of(codes, entry)
        for exit_ in STATES:
            assert search(codes, entry, exit_) == table.get(exit_)
    best = min(c for c, _ in table_of(codes).values())
    assert all(x <= best for x in lower_bounds(codes)[:1])


def test_all_short_conversations():
    """Every sequence of up to three rows of six kinds, by trying all letters with up to two inserts."""
    for n in range(4):
        for codes in itertools.product([1, 2, 3, 0, 2 + CUT_OFF, 3 + MUST_GO], repeat=n):
            tried = []
            for extra in range(3):
                for slots in itertools.combinations_with_replacement(range(n + 1), extra):
                    for letters in itertools.product("DKR", repeat=n):
                        audit = "".join("I" * slots.count(i) + (letters[i] if i < n else "") for i in range(n + 1))
                        cost, state, i = 0, 0, 0
                        for x in audit:
                            if x == "I":
                                cost, state = cost + 5, NEXT[state]
                                continue
                            code, i = codes[i], i + 1
                            if x == "D":
                                cost += 2
                                continue
                            if code & MUST_GO:
                                break
                            cost += 5 if code & CUT_OFF else 0
                            if x == "R":
                                cost, state = cost + 1, NEXT[state]
                            elif code & 3 == 1 and state == 0:
                                state = 1
                            elif "?sua"[code & 3] == GIVES[state]:
                                state = NEXT[state]
                            else:
                                break
                        else:
                            if state in FINAL:
                                tried.append((cost, audit))
            assert search(bytes(codes)) == min(tried)


def test_pieces_and_parts():
    rng = random.Random(3)
    for size in (0, 1, 5, 300):
        codes = bytes(rng.choice([1, 2, 3, 2, 3, 0, 2 + CUT_OFF, MUST_GO]) for _ in range(size))
        table = table_of(codes)
        assert repair_codes(codes) == min(table[s] for s in FINAL if s in table)
        cut = size // 3
        both = joined(ways(codes[:cut], (START,)), ways(codes[cut:]))
        assert min(both[START, s] for s in FINAL if (START, s) in both) == repair_codes(codes)
    # Only the first and the last conversation of a part are open.
    rows = [(c, p, i, 2) for i, (c, p) in enumerate([(1, 0), (1, 0), (2, 0), (2, 0), (None, 0), (1, 1)])]
    assert {(r[0], r[1], r[4]) for r in stretches(iter(rows))} == {(1, 0, True), (2, 0, False), (None, 0, True), (1, 1, True)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows, all_ids):
    """The summary of rows (conv_id, turn, role, text), without its search."""
    out = []
    for conv in all_ids:
        own = sorted(((t is not None, t or 0, r, x) for c, t, r, x in rows if c == conv))
        turns = {t for has, t, _, _ in own if has}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        seen, codes = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + (CUT_OFF if fault == "truncated" else MUST_GO if fault else 0))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        table = table_of(codes)
        cost, audit = min(table[s] for s in FINAL if s in table)
        lines, state, at = [], 0, iter(own)
        for x in audit:
            name = {"u": "user", "a": "assistant"}[GIVES[state]]
            if x == "I":
                lines.append(f"{name}:")
            else:
                _, _, role, text = next(at)
                if x == "D":
                    continue
                lines.append(f"{role if x == 'K' else name}:{text}")
                if x == "K" and role[:1] == "s":
                    state = 1
                    continue
            state = NEXT[state]
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, sha("\n".join(lines))))
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


ROWS = [(1, 0, "system", "Be good."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes!"), (1, 3, "user", "Hi?"), (1, 4, "assistant", "Cut off"), (1, 9, "assistant", " .\n"),
        (2, None, "user", "a."), (2, None, "user", "a."), (2, None, "tool", "b"), (None, 1, None, None), (None, 2, "assistant", "c."), (3, 5, "", "x. "), (3, 5, "", "x. "),
        (4, 0, "user", "q" * 100_000 + "."), (4, 1, "assistant", "퟿ ."), (5, 0, "assistant", ""), (6, -1, "u", "a:b\nc."), (6, 7, "assistant", "?")]


def test_odd_rows(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 place", "2 part", "3 code", "4 copies", "5 c", "6 said", "7 at")
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ROWS]
    assert order(summary(turns).collect()) == order(plain(rows, {r[0] for r in rows}))
    assert summary(turns.limit(0)).collect() == []


def test_long_conversation_over_parts(spark, monkeypatch):
    """A conversation with most of all rows: several parts hold it, and a repeated row is held once."""
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"t{i}."])) for i in range(700)]
    rows += [(1, 350, "user", "again.")] * 300 + [(c, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for c in (0, 2, 3) for i in range(4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        work = Repair(spark.createDataFrame(rows, SCHEMA))
        assert work.faults.filter("conv_id = 1").select("part").distinct().count() > 2
        assert work.faults.filter("copies > 1").count() == 1
        found = summary(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert order(found) == order(plain(rows, [0, 1, 2, 3]))


def test_repaired_rows(spark):
    rows = Repair(spark.createDataFrame(ROWS[:6], SCHEMA)).rows().orderBy("n").collect()
    assert "".join(r.edit for r in rows) == "KKDDDK"
    assert [(r.role, r.text) for r in rows if r.role] == [("system", "Be good."), ("user", "Hi?"), ("assistant", " .\n")]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op11_repair"](spark, folder)
    assert dict(found.dtypes)["gaps"] == dict(found.dtypes)["cost"] == "bigint"
    assert order(found.collect()) == order(plain(damage(rows), {r[0] for r in rows}))


def test_a_lost_conversation(spark, tmp_path):
    """One whose rows are all left out still has a result."""
    lost = next((c, 0) for c in range(100) if crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(*lost, "user", "x.")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = QUERIES["op11_repair"](spark, f"file://{tmp_path}").collect()
    assert tuple(row) == (lost[0], 0, 0, 0, 0, 0, 0, "", sha(""))
    assert repair.search(b"") == (0, "")
