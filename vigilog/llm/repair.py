"""Repair of conversations by the cheapest edits, proved by branch and bound.

Rows of a conversation are kept, given another role, deleted, or joined by inserted rows, so that the
roles make an optional system turn followed by pairs of user and assistant. A depth-first search with
an explicit stack goes through edits in the order of their letters. A prefix is cut when its cost and
the lower bound of the rows to come exceed the incumbent, or when its node (row, state) was reached
before at no higher cost; the first to come is also the least in letters, so ties need no comparison.

Conversations of any length are repaired without meeting in one task: rows are dealt out by ranges of
(conversation, turn), and a stretch that another task may continue is searched from each state it may
be entered in to each it may be left in. Only these small tables meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise

#: Costs. Fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Codes of a row: its role's initial, and whether it must go or is truncated.
INITIALS = {"s": 1, "u": 2, "a": 3}
OTHER, SYSTEM, USER, ASSISTANT = range(4)
MUST_GO, CUT_OFF = 4, 8
#: States: nothing yet, after the system turn, after a user's, after an assistant's. Empty and complete ones end.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STATES = range(4)
FINAL = (START, AFTER_ASSISTANT)
#: The role that a rerole or an insert gives, by state, and the state after it.
GIVES = (USER, USER, ASSISTANT, USER)
NEXT = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
#: Initials that may follow each other, other than at the beginning.
FOLLOWS = ("su", "ua", "au")
ROLE_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Rows that are searched at once; longer stretches are searched piece by piece, from state to state.
PIECE = 128
NO_COST = 1 << 60


def kept_state(state: int, code: int) -> int | None:
    """The state after keeping a row, or None where its role doesn't fit."""
    role = code & 3
    if role == SYSTEM:
        return AFTER_SYSTEM if state == START else None
    return NEXT[state] if role and role == GIVES[state] else None


def lower_bounds(codes: bytes) -> list[int]:
    """What the rows from each on cost at least, whatever came before and follows.

    A row that must go or is truncated costs a deletion. Of the others, each of unknown role, and each
    of a set of disjoint neighbours that can't follow each other, needs one more edit in or between
    its rows; what stands between and isn't deleted costs more than that already.
    """
    found = [0] * (len(codes) + 1)
    # Least cost from the next clean row on, and from the one after it, without forced costs.
    forced, here, later, after = 0, 0, 0, None
    for i in range(len(codes) - 1, -1, -1):
        code = codes[i]
        if code & (MUST_GO | CUT_OFF):
            forced += DELETE
        else:
            role = code & 3
            if not role:
                own = here + 1
            else:
                fits = after is None or (role, after) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
                own = here if fits else max(here, later + 1)
            # An unknown role is paid for by itself: no pair with it.
            here, later, after = own, here, (role or None)
        found[i] = forced + here
    return found


def _greedy(codes: bytes, entry: int, exit_: int | None) -> tuple[int, str] | None:
    """Some way through, to start with: keep what fits, else give another role, delete what must go."""
    cost, state, audit = 0, entry, []
    for code in codes:
        if code & (MUST_GO | CUT_OFF):
            cost += DELETE
            audit.append("D")
        elif (kept := kept_state(state, code)) is not None:
            state = kept
            audit.append("K")
        elif code & 3 != SYSTEM and NEXT[state] != AFTER_ASSISTANT and state != START:
            cost += DELETE
            audit.append("D")
        else:
            cost += REROLE
            state = NEXT[state]
            audit.append("R")
    for _ in range(3):
        if state in FINAL if exit_ is None else state == exit_:
            return cost, "".join(audit)
        cost += INSERT
        state = NEXT[state]
        audit.append("I")
    return None


@lru_cache(maxsize=1 << 16)
def search(codes: bytes, entry: int = START, exit_: int | None = None) -> tuple[int, str] | None:
    """Least cost and, among those, ASCII-least letters of edits that lead from state ``entry`` through
    the rows to state ``exit_`` (None: to any in which a conversation may end). None if there are none."""
    n = len(codes)
    bounds = lower_bounds(codes)
    best = _greedy(codes, entry, exit_)
    # Least cost at which each node was reached so far.
    reached = [NO_COST] * (4 * (n + 1))
    limit = NO_COST if best is None else best[0]
    # A node of the search: row, state, cost, and its letters as a chain (letter, chain before).
    stack = [(0, entry, 0, None)]
    while stack:
        at, state, cost, audit = stack.pop()
        node = 4 * at + state
        if cost >= reached[node] or cost + bounds[at] > limit:
            continue
        reached[node] = cost
        if at == n and (state in FINAL if exit_ is None else state == exit_):
            letters = _letters(audit)
            if best is None or (cost, letters) < best:
                best, limit = (cost, letters), cost
        # Pushed from the last letter to the first, so that the first is looked at first.
        if at < n:
            code = codes[at]
            if not code & MUST_GO:
                more = TRUNCATED if code & CUT_OFF else 0
                stack.append((at + 1, NEXT[state], cost + REROLE + more, ("R", audit)))
                kept = kept_state(state, code)
                if kept is not None:
                    stack.append((at + 1, kept, cost + more, ("K", audit)))
        stack.append((at, NEXT[state], cost + INSERT, ("I", audit)))
        if at < n:
            stack.append((at + 1, state, cost + DELETE, ("D", audit)))
    return best


def _letters(chain) -> str:
    found = []
    while chain is not None:
        letter, chain = chain
        found.append(letter)
    return "".join(reversed(found))


def ways(codes: bytes, entries=STATES) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest edits of a piece for each pair of states it may be entered and left in."""
    found = {}
    for a in entries:
        for b in STATES:
            way = search(codes, a, b)
            if way is not None:
                found[a, b] = way
    return found


def joined(left: dict, right: dict) -> dict:
    """Cheapest edits of two pieces one after the other.

    Of two equally cheap ways through the same rows none is the beginning of the other (more letters
    would be inserted rows, which cost), so the lesser stays the lesser whatever follows."""
    found: dict = {}
    for (a, b), (cost, audit) in left.items():
        for c in STATES:
            way = right.get((b, c))
            if way is not None:
                both = (cost + way[0], audit + way[1])
                if (a, c) not in found or both < found[a, c]:
                    found[a, c] = both
    return found


def repair_codes(codes: bytes) -> tuple[int, str]:
    """Least cost and letters for a whole conversation."""
    if len(codes) <= PIECE:
        return search(codes)
    table = {(START, START): (0, "")}
    for i in range(0, len(codes), PIECE):
        table = joined(table, ways(codes[i : i + PIECE], {b for _, b in table}))
    return min(table[START, b] for b in FINAL if (START, b) in table)


def per_row(audit: str) -> list[str]:
    """Letters by row: those of rows inserted before it and its own; at the end what is inserted after all."""
    found, start = [], 0
    for i, letter in enumerate(audit):
        if letter != "I":
            found.append(audit[start : i + 1])
            start = i + 1
    return [*found, audit[start:]]


def ends_open(text: Column) -> Column:
    """Whether the last character that isn't blank is no end of a sentence."""
    return ~F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1).isin(*ENDS)


def is_blank(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS)) == ""


#: A stretch of a conversation's rows as a task saw it, and one way through it.
STRETCH = "conv_id bigint, part int, first bigint, rows bigint, open boolean, entry int, exit int, cost bigint, audit string"
CHOSEN = "conv_id bigint, part int, first bigint, rows bigint, audit string"
#: A row of a repaired conversation, or one that was taken out (without role and text).
REPAIRED = "conv_id bigint, n bigint, edit string, role string, text string, old_role string, cost bigint"
SUMMARY = "conv_id bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
OUT_ROWS, OUT_BYTES = 4096, 8 << 20


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches bounded by number and size."""
    fields = pa.schema([(name, ARROW[kind]) for name, kind in map(str.split, schema.split(","))])
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), fields, strict=True)], schema=fields)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= OUT_ROWS or size >= OUT_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        for row in zip(*(batch.column(n) for n in names), strict=True):
            yield tuple(x.as_py() for x in row)


def stretches(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows ``conv_id, part, place, code`` in order: the cheapest edits of each stretch, as ``STRETCH``.

    The first and the last conversation of a part may go on in others: all their ways are told."""
    now = part = table = None
    opened, first, n = False, 0, 0
    held = bytearray()

    def entries() -> Iterable[int]:
        return (STATES if opened else (START,)) if table is None else {b for _, b in table}

    def piece() -> None:
        nonlocal table
        own = ways(bytes(held), entries())
        table = own if table is None else joined(table, own)
        held.clear()

    def close(last: bool) -> Iterator[tuple]:
        open_ = opened or last
        if not open_ and table is None:
            found = {(START, None): search(bytes(held))}
            held.clear()
        else:
            piece()
            found = table if open_ else {(START, None): min(table[START, b] for b in FINAL if (START, b) in table)}
        for (a, b), (cost, audit) in found.items():
            yield now[0], part, first, n, open_, a, b, cost, audit

    for conv, own_part, place, code in rows:
        if now is None or own_part != part or (conv,) != now:
            other = now is None or own_part != part
            if now is not None:
                yield from close(other)
            now, part, table, opened, first, n = (conv,), own_part, None, other, place, 0
        if len(held) == PIECE:
            piece()
        held.append(code)
        n += 1
    if now is not None:
        yield from close(True)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches(stretches(_columns(batches, "conv_id", "part", "place", "code")), STRETCH)


def _chosen(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One way through the stretches of a conversation that may span several parts."""
    tables: dict = {}
    for r in rows.sort_values(["part", "first"]).itertuples():
        tables.setdefault((r.part, r.first, r.rows), {})[int(r.entry), int(r.exit)] = (int(r.cost), r.audit)
    total = {(START, START): (0, "")}
    for table in tables.values():
        total = joined(total, table)
    edits = per_row(min(total[START, b] for b in FINAL if (START, b) in total)[1])
    found, start = [], 0
    for part, first, n in tables:
        last = start + n == len(edits) - 1
        found.append((key[0], part, first, n, "".join(edits[start : start + n + last])))
        start += n
    return pd.DataFrame(found, columns=["conv_id", "part", "first", "rows", "audit"])


def apply_edits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows ``conv_id, role, text, copies, code, letters, after`` in order, as ``REPAIRED``. Holds a row at a time."""
    now = None
    state = n = 0

    def inserted(letters: int) -> Iterator[tuple]:
        nonlocal state, n
        for _ in range(letters):
            yield now[0], n, "I", ROLE_NAMES[GIVES[state]], "", None, INSERT
            state, n = NEXT[state], n + 1

    for conv, role, text, copies, code, letters, after in rows:
        if (conv,) != now:
            now, state, n = (conv,), START, 0
        yield from inserted(len(letters) - 1)
        more = TRUNCATED if code & CUT_OFF else 0
        if letters[-1] == "D":
            yield conv, n, "D", None, None, role, DELETE
        elif letters[-1] == "K":
            yield conv, n, "K", role, text, role, more
            state = kept_state(state, code)
        else:
            yield conv, n, "R", ROLE_NAMES[GIVES[state]], text, role, REROLE + more
            state = NEXT[state]
        n += 1
        for _ in range(copies - 1):
            yield conv, n, "D", None, None, role, DELETE
            n += 1
        yield from inserted(len(after))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches(apply_edits(_columns(batches, "conv_id", "role", "text", "copies", "code", "letters", "after")), REPAIRED)


def summaries(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Repaired rows ``conv_id, edit, role, text, old_role, cost`` in order, as ``SUMMARY``: one per conversation."""
    now = None
    for conv, edit, role, text, old, own in rows:
        if (conv,) != now:
            if now is not None:
                yield now[0], illegal, cost, "".join(audit), sha.hexdigest()
            now, illegal, cost, audit, sha, begun, before = (conv,), 0, 0, [], hashlib.sha256(), False, None
        cost += own
        audit.append(edit)
        if old is not None:
            illegal += before is not None and before + old[:1] not in FOLLOWS
            before = old[:1]
        if role is not None:
            sha.update(b"\n" * begun + f"{role}:{text}".encode())
            begun = True
    if now is not None:
        yield now[0], illegal, cost, "".join(audit), sha.hexdigest()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches(summaries(_columns(batches, "conv_id", "edit", "role", "text", "old_role", "cost")), SUMMARY)


class Repair:
    """Faults, edits and repaired rows of ``turns`` (``conv_id, turn, role, text``).

    Rows of a conversation follow each other by turn (null first), then role and text. Null roles and
    texts are one space. The first of these faults of a row counts: ``blank``; ``duplicate``, if role and
    text were seen earlier in the conversation; ``truncated``, if its text ends in no ``.``, ``!`` or ``?``.
    Repeated rows are held once with their number (the others are duplicates), so that rows
    repeated without end don't meet in a task. Null is a conversation of its own. An empty table gives
    empty results. Columns not named are not looked at.

    ``turns`` are the rows with ``copies`` and ``place``, which ascends in a conversation; ``faults`` their faults.
    """

    def __init__(self, turns: DataFrame):
        space = F.lit(" ")
        named = turns.select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            F.col("turn").cast("bigint").alias("turn"),
            F.coalesce(F.col("role").cast("string"), space).alias("role"),
            F.coalesce(F.col("text").cast("string"), space).alias("text"),
        )
        keys = ["conv_id", "turn", "role", "text"]
        merged = named.groupBy(*keys).agg(F.count("*").alias("copies"))
        ranged = merged.repartitionByRange(*keys).sortWithinPartitions(*keys)
        said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
        placed = ranged.select(
            *keys, "copies", F.unhex(F.sha2(said, 256)).alias("said"), is_blank(F.col("text")).alias("blank"),
            ends_open(F.col("text")).alias("cut"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"),
        )
        placed = materialise(placed, "repair-rows")
        # Equal texts under other turns of a conversation: few, and without their texts.
        firsts = placed.filter("NOT blank").groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min("place").alias("earliest"), F.count("*").alias("n"))
        firsts = materialise(firsts.filter("n > 1").drop("n"), "repair-firsts")
        seen = (F.col("said") == F.col("s")) & F.col("conv_id").eqNullSafe(F.col("c"))
        coded = placed.drop("text").join(firsts, seen, "left")
        again = F.coalesce(F.col("place") > F.col("earliest"), F.lit(False)) & ~F.col("blank")
        fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("cut"), "truncated")
        initial = F.substring("role", 1, 1)
        code = F.coalesce(F.create_map(*[F.lit(x) for pair in INITIALS.items() for x in pair])[initial], F.lit(OTHER))
        code = code + F.when(fault == "truncated", CUT_OFF).when(fault.isNotNull(), MUST_GO).otherwise(0)
        self.turns = placed
        self.faults = materialise(
            coded.select("conv_id", "turn", "part", "place", "copies", fault.alias("fault"), code.cast("int").alias("code")), "repair-faults"
        )

    def _chosen(self) -> DataFrame:
        """Letters by stretch, as ``CHOSEN``."""
        # So many tasks as the session has for a shuffle: the search is work, however few bytes its rows have.
        tasks = int(self.faults.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = self.faults.select("conv_id", "part", "place", "code").repartition(tasks, "part").sortWithinPartitions("part", "place")
        found = materialise(dealt.mapInArrow(_stretches, STRETCH), "repair-stretches")
        several = found.filter("open").groupBy("conv_id").applyInPandas(_chosen, CHOSEN)
        return found.filter("NOT open").select("conv_id", "part", "first", "rows", "audit").unionByName(several)

    def edits(self) -> DataFrame:
        """``conv_id, place, letters, after``: each row's letter after those of rows inserted before it, and at
        the last row of a conversation those of rows inserted at its end. Repeats of a row are deleted and not told."""
        letters = F.regexp_extract_all(F.col("audit"), F.lit("I*[DKR]"), F.lit(0))
        each = self._chosen().select("conv_id", "first", "rows", F.regexp_extract("audit", "(I*)$", 1).alias("rest"), F.posexplode(letters).alias("i", "letters"))
        after = F.when(F.col("i") == F.col("rows") - 1, F.col("rest")).otherwise("")
        return each.select("conv_id", (F.col("first") + F.col("i")).alias("place"), "letters", after.alias("after"))

    def rows(self) -> DataFrame:
        """The repaired conversations, as ``REPAIRED``: ``n`` counts the edits of a conversation, ``edit`` is its
        letter; kept, reroled and inserted rows have ``role`` and ``text``. Conversations are each in one
        partition and in order; a task goes through their rows one by one."""
        edits = self.edits().select(F.col("place").alias("at"), "letters", "after")
        codes = self.faults.select(F.col("place").alias("of"), "code")
        rows = self.turns.join(edits.join(codes, F.col("at") == F.col("of")), F.col("place") == F.col("at"))
        rows = rows.select("conv_id", "place", "role", "text", "copies", "code", "letters", "after")
        return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_apply, REPAIRED)

    def counts(self) -> DataFrame:
        """Per conversation ``gaps`` (missing turn numbers, null turns aside) and rows by fault."""
        fault, copies = F.col("fault"), F.col("copies")
        repeats = F.when(fault == "blank", 0).when(fault == "duplicate", copies).otherwise(copies - 1)
        by_turn = self.faults.groupBy("conv_id", "turn").agg(
            F.sum(F.when(fault == "blank", copies).otherwise(0)).alias("blank"),
            F.sum(repeats).alias("duplicate"),
            F.sum(F.when(fault == "truncated", 1).otherwise(0)).alias("truncated"),
        )
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
        return by_turn.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])


def summary(turns: DataFrame) -> DataFrame:
    """Per conversation of ``turns``: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``illegal`` counts neighbours whose roles can't follow each other, ``audit`` has the letters of the
    cheapest edits (Delete, Insert, Keep, Rerole), and ``repaired_sha256`` is the digest of the repaired rows
    ``role:text``, one per line, through which one task goes in order."""
    work = Repair(turns)
    ended = work.rows().mapInArrow(_summaries, SUMMARY).withColumnRenamed("conv_id", "c")
    found = work.counts().join(ended, F.col("conv_id").eqNullSafe(F.col("c")))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
