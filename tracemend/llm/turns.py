"""Conversation repair as a cheapest path through composed weighted finite-state machines.

A conversation is a chain of turns, the input acceptor. An edit transducer keeps, reroles, deletes and inserts turns at a
cost, and a role grammar accepts what may come out. The three are composed lazily: a state of the composition (position,
grammar state) comes into being when a path reaches it, and steps that were seen before are looked up. Positions are the
topological order, insertions at one position its refinement. Weights are pairs (cost, labels) in lexicographic order.

Concatenation with a string on the right doesn't respect the order of strings of unequal length, so labels are never
compared as prefixes: costs to the end are found backwards, and of the arcs that keep to them the one with the least label is
taken forwards, which gives the least string since an arc's label fixes its target.

A conversation may hold any number of turns. Its turns are cut into blocks; a block is a matrix of least costs from grammar
state to grammar state, matrices of a conversation give the costs to the end at the end of each block and the state in which
the best path enters it, and then each block finds its own labels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemend.llm.common import Scratch, map_arrow, table

BLOCK_ROWS = 1 << 15
FAR = 1 << 60  #: the cost of no path
SPACES = " \t\n\x0b\f\r"

# the role grammar (s?(ua)+)?: states, what they accept next, where that leads, and which are final
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = {START, ASSISTANT}
STATES = range(4)
ROLES = {"u": "user", "a": "assistant"}
DELETE, INSERT, KEEP, REROLE, CUT_SHORT = 3, 2, 0, 2, 1  #: costs of edits; the last for a truncated turn that stays

Costs = tuple[int, ...]
NOTHING: Costs = (FAR,) * 4


def wanted(q: int) -> tuple[str, int]:
    """The role that an inserted or reroled turn takes in a grammar state, and the state after it."""
    return next((r, to) for r, to in GRAMMAR[q].items() if r in ROLES)


def arcs(symbol: int, q: int) -> Iterator[tuple[str, int, int]]:
    """(label, cost, grammar state after it) of the edits of a turn in a grammar state, the composition's arcs that consume it."""
    role, must_go, short = chr(symbol >> 2), symbol & 1, CUT_SHORT * (symbol >> 1 & 1)
    yield "D", DELETE, q
    if not must_go:
        if role in GRAMMAR[q]:
            yield "K", KEEP + short, GRAMMAR[q][role]
        yield "R", REROLE + short, wanted(q)[1]


def symbol_of(role: str, must_go: bool, short: bool) -> int:
    """What the machines see of a turn: one of s, u, a and anything else, and two faults."""
    return ord(role if role in ("s", "u", "a") else "x") << 2 | short << 1 | must_go


def with_insertions(costs: Costs) -> Costs:
    """Costs to the end at a position before insertions, from those after them; a grammar state is entered once at most."""
    out = list(costs)
    for _ in STATES:
        for q in STATES:
            out[q] = min(out[q], INSERT + out[wanted(q)[1]])
    return tuple(min(c, FAR) for c in out)


AT_END = with_insertions(tuple(0 if q in FINAL else FAR for q in STATES))


@lru_cache(maxsize=1 << 16)
def step_back(symbol: int, after: Costs) -> tuple[Costs, int]:
    """Costs to the end before a turn from those after it, less their least, which comes beside."""
    before = with_insertions(tuple(min((c + after[to] for _, c, to in arcs(symbol, q)), default=FAR) for q in STATES))
    least = min(before)
    return (before, 0) if least >= FAR else (tuple(c - least if c < FAR else FAR for c in before), least)


@lru_cache(maxsize=1 << 16)
def step_on(symbol: int, q: int, after: Costs) -> tuple[str, int]:
    """Labels of the best arcs from a state up to and with the turn's own, least label first; the state after it."""
    consume = tuple(min((c + after[to] for _, c, to in arcs(symbol, p)), default=FAR) for p in STATES)
    before, labels = with_insertions(consume), ""
    while True:
        best = {label: to for label, c, to in arcs(symbol, q) if c + after[to] == before[q]}
        to = wanted(q)[1]
        if INSERT + before[to] == before[q]:
            best["I"] = to
        label = min(best)
        labels, q = labels + label, best[label]
        if label != "I":
            return labels, q


def at_end(q: int) -> str:
    """Labels of the insertions after the last turn."""
    labels = ""
    while AT_END[q]:
        labels, q = labels + "I", wanted(q)[1]
    return labels


def block_costs(symbols: bytes | list[int], after: Costs) -> tuple[Costs, int]:
    """Costs to the end before a block of turns, given those after it, as (costs less their least, that least)."""
    least = min(after)
    now, total = tuple(c - least if c < FAR else FAR for c in after), least
    for s in reversed(symbols):
        now, more = step_back(s, now)
        total += more
    return now, total


def block_matrix(symbols: list[int]) -> list[int]:
    """Least costs through a block of turns from each grammar state to each, row by row; insertions after its last turn belong to what follows."""
    columns = []
    for q in STATES:
        costs, total = block_costs(symbols, tuple(0 if p == q else FAR for p in STATES))
        columns.append([c + total if c < FAR else FAR for c in costs])
    return [columns[q][p] for p in STATES for q in STATES]


def through(matrix: list[int], after: Costs) -> Costs:
    """Costs to the end before a block from its matrix and the costs after it."""
    return tuple(min(FAR, *(matrix[4 * p + q] + after[q] for q in STATES)) for p in STATES)


def block_path(symbols: list[int], q: int, after: Costs) -> tuple[str, int]:
    """The least labels among the cheapest paths through a block entered in q, and the state after it."""
    least = min(after)
    seen = [tuple(c - least if c < FAR else FAR for c in after)]
    for s in reversed(symbols):
        seen.append(step_back(s, seen[-1])[0])
    labels = []
    for k, s in enumerate(symbols):
        some, q = step_on(s, q, seen[len(symbols) - 1 - k])
        labels.append(some)
    return "".join(labels), q


def shortest_path(symbols: list[int]) -> tuple[int, str]:
    """Cost and labels of the best repair of a conversation in one block."""
    costs, total = block_costs(symbols, AT_END)
    labels, q = block_path(symbols, START, AT_END)
    return costs[START] + total, labels + at_end(q)


def faulty(text: str = "text") -> dict[str, F.Column]:
    """Whether a text is blank, and whether it ends without a closing mark."""
    bare = F.rtrim(text, F.lit(SPACES))
    return {"blank": bare == "", "short": ~F.substring(bare, -1, 1).isin(".", "!", "?")}


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of rows (conv_id, turn, role, text) after damage by a checksum of their place; conv is conv_id as text, one space for null.

    A twentieth each is dropped, emptied, stripped of closing marks, repeated, or given to the user. Null roles and texts are
    one space; repeated rows are damaged alike.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = rows.select(named("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), named("role").alias("role"), named("text").alias("text"), (F.crc32(F.concat_ws(":", named("conv_id"), named("turn"))) % 20).alias("how"))
    t = t.where("how <> 0").select(
        "conv", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), F.when(F.col("how") == 3, 2).otherwise(1).alias("copies"),
    )
    return t.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def seen_first(slim: DataFrame) -> DataFrame:
    """slim (conv, turn, role, print, n, ...) with `first`: no earlier turn of the conversation has its role and text."""
    earliest = F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn"))
    firsts = slim.groupBy("conv", "role", "print").agg(earliest.alias("e")).select(F.col("conv").alias("c_"), F.col("role").alias("r_"), F.col("print").alias("p_"), F.col("e.turn").alias("t_"))
    same = (F.col("conv") == F.col("c_")) & (F.col("role") == F.col("r_")) & (F.col("print") == F.col("p_"))
    return slim.join(firsts, same).withColumn("first", F.col("turn").eqNullSafe(F.col("t_"))).drop("c_", "r_", "p_", "t_")


BLOCK = "conv string, part long, nth long, turn long, role string, print binary, symbols binary, stats array<long>, matrix array<long>"
#: of a block: turns kept apart by value (distinct, least, most), faults, illegal pairs inside, first and last turn and initial (-1: none)
DISTINCT, LEAST, MOST, BLANK, DUPLICATE, TRUNCATED, ILLEGAL, TURN_IN, TURN_OUT, ROLE_IN, ROLE_OUT = range(11)
LEGAL = {"su", "ua", "au"}


def blocks(slim: DataFrame, block_rows: int) -> DataFrame:
    """Rows of BLOCK from slim rows in order: each partition's turns of a conversation, `block_rows` at most to a block."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        names = ("conv", "turn", "role", "print", "n", "blank", "short", "first")
        lines = (x for b in batches for x in zip(*(b[c].to_pylist() for c in names), strict=True))
        out: dict[str, list] = {c.split()[0]: [] for c in BLOCK.split(", ")}
        held = 0
        for conv, mine in groupby(lines, key=lambda x: x[0]):
            nth = 0
            for symbols, key, stats in cut(mine, block_rows):
                packed = b"".join(s.to_bytes(2, "little") for s in symbols)
                for c, v in zip(out, (conv, part, nth, *key, packed, stats, block_matrix(symbols)), strict=True):
                    out[c].append(v)
                nth, held = nth + 1, held + len(symbols) + 64
                if held >= 4 * BLOCK_ROWS:
                    yield out
                    out, held = {c: [] for c in out}, 0
        yield out

    return map_arrow(slim, BLOCK, each)


def cut(lines: Iterator[tuple], most: int) -> Iterator[tuple[list[int], tuple, list]]:
    """Symbols, key of the first turn, and counts of blocks of one conversation's turns; n equal turns are n symbols."""
    symbols: list[int] = []
    for _, turn, role, mark, n, blank, short, first in lines:
        for copy in range(n):
            if not symbols:
                key, stats, initial, last = (turn, role, mark), [0] * 11, None, None
                stats[LEAST] = stats[MOST] = stats[TURN_OUT] = None
                stats[TURN_IN], stats[ROLE_IN] = turn, ord(role[0]) if role else -1
            again = not blank and not (first and copy == 0)
            fault = BLANK if blank else DUPLICATE if again else TRUNCATED if short else None
            if fault is not None:
                stats[fault] += 1
            if symbols and initial + role[:1] not in LEGAL:
                stats[ILLEGAL] += 1
            if turn is not None and turn != last:
                stats[DISTINCT] += 1
                stats[LEAST] = turn if stats[LEAST] is None else stats[LEAST]
                stats[MOST] = last = turn
            initial = role[:1]
            stats[TURN_OUT], stats[ROLE_OUT] = turn, ord(initial) if initial else -1
            symbols.append(symbol_of(initial, fault in (BLANK, DUPLICATE), fault == TRUNCATED))
            if len(symbols) >= most:
                yield symbols, key, stats
                symbols = []
    if symbols:
        yield symbols, key, stats


PLAN = "conv string, part long, nth long, after array<long>, cost long, counts array<long>, head boolean"


def joined(many: list[tuple]) -> tuple[list[int], list[int]]:
    """Of a conversation's blocks in order: [gaps, blank, duplicate, truncated, illegal]."""
    total = [0] * 11
    least = most = None
    for k, (stats, before) in enumerate(zip(many, [None, *many], strict=False)):
        for i in (DISTINCT, BLANK, DUPLICATE, TRUNCATED, ILLEGAL):
            total[i] += stats[i]
        if stats[LEAST] is not None:
            least = stats[LEAST] if least is None else least
            most = stats[MOST]
        if k:
            if stats[TURN_IN] is not None and stats[TURN_IN] == before[TURN_OUT]:
                total[DISTINCT] -= 1
            pair = "".join(chr(c) if c >= 0 else "" for c in (before[ROLE_OUT], stats[ROLE_IN]))
            total[ILLEGAL] += pair not in LEGAL
    gaps = most - least + 1 - total[DISTINCT] if least is not None else 0
    return [gaps, total[BLANK], total[DUPLICATE], total[TRUNCATED], total[ILLEGAL]]


def plans(found: DataFrame) -> DataFrame:
    """For each block the costs to the end after it; beside the first one what the whole conversation counts. A task holds the matrices of one conversation."""

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        lines = (x for b in batches for x in zip(*(b[c].to_pylist() for c in ("conv", "part", "nth", "stats", "matrix")), strict=True))
        out: dict[str, list] = {c.split()[0]: [] for c in PLAN.split(", ")}
        for conv, mine in groupby(lines, key=lambda x: x[0]):
            mine = list(mine)
            after, ends = AT_END, []
            for *_, matrix in reversed(mine):
                ends.append(after)
                after = through(matrix, after)
            counts = joined([stats for *_, stats, _ in mine])
            for k, ((_, part, nth, *_), end) in enumerate(zip(mine, reversed(ends), strict=True)):
                head = k == 0
                for c, v in zip(out, (conv, part, nth, end, after[START] if head else None, counts if head else None, head), strict=True):
                    out[c].append(v)
            if len(out["conv"]) >= BLOCK_ROWS:
                yield out
                out = {c: [] for c in out}
        yield out

    return map_arrow(found.select("conv", "part", "nth", "stats", "matrix").repartition("conv").sortWithinPartitions("conv", "part", "nth"), PLAN, each)


PATHS = "conv string, turn long, role string, print binary, tag int, nth long, text string, paths array<string>, exits array<int>, cost long, counts array<long>"


def paths(found: DataFrame, planned: DataFrame) -> DataFrame:
    """For each block the labels of its best path, and the state after it, from each grammar state in which it may be entered."""
    p = planned.select(F.col("conv").alias("c_"), F.col("part").alias("p_"), F.col("nth").alias("n_"), "after", "cost", "counts", "head")
    t = found.join(p, (F.col("conv") == F.col("c_")) & (F.col("part") == F.col("p_")) & (F.col("nth") == F.col("n_"))).drop("c_", "p_", "n_")

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            got = []
            for packed, after, head in zip(b["symbols"].to_pylist(), b["after"].to_pylist(), b["head"].to_pylist(), strict=True):
                symbols = [int.from_bytes(packed[i : i + 2], "little") for i in range(0, len(packed), 2)]
                reach = block_costs(symbols, tuple(after))[0]
                got.append([block_path(symbols, q, tuple(after)) if reach[q] < FAR and (q == START or not head) else ("", START) for q in STATES])
            size = len(got)
            yield {c: b[c] for c in ("conv", "turn", "role", "print", "nth", "cost", "counts")} | {"tag": [0] * size, "text": [None] * size, "paths": [[x for x, _ in g] for g in got], "exits": [[q for _, q in g] for g in got]}

    return map_arrow(t.drop("part", "stats", "matrix"), PATHS, each)


FOUND = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """A row of FOUND for each conversation: its turns are read in order, with each block's labels before its first turn, and the repaired ones hashed as they pass."""
    null = lambda t: F.lit(None).cast(t)
    turns = rows.select("conv", "turn", "role", F.unhex(F.md5("text")).alias("print"), F.lit(1).alias("tag"), F.lit(0).cast("long").alias("nth"), "text", *(null(t).alias(c) for c, t in (x.split(" ", 1) for x in PATHS.split(", ")[7:])))
    dealt = turns.unionByName(marked).repartition("conv").sortWithinPartitions("conv", "turn", "role", "print", "tag", "nth")

    def each(batches: Iterator[dict]) -> Iterator[dict]:
        names = ("conv", "role", "tag", "text", "paths", "exits", "cost", "counts")
        lines = (x for b in batches for x in zip(*(b[c].to_pylist() for c in names), strict=True))
        out: dict[str, list] = {c.split()[0]: [] for c in FOUND.split(", ")}
        for conv, mine in groupby(lines, key=lambda x: x[0]):
            digest, audit, q, ahead, said = hashlib.sha256(), [], START, iter(()), False
            cost, counts, state = 0, [0] * 5, START

            def say(role: str, text: str) -> None:
                nonlocal said
                digest.update(f"{chr(10) if said else ''}{role}:{text}".encode())
                said = True

            waiting: list[str] = []  # blocks whose first turn is one of equal turns come one after another
            for _, role, tag, text, path, exits, c, k in mine:
                if tag == 0:
                    if k is not None:
                        cost, counts = c, k
                    waiting.append(path[state])
                    state = exits[state]
                    continue
                label = next(ahead, "")
                while label in ("", "I"):
                    if label:
                        say(ROLES[wanted(q)[0]], "")
                        q = wanted(q)[1]
                        label = next(ahead, "")
                    else:
                        audit.append(waiting.pop(0))
                        ahead = iter(audit[-1])
                        label = next(ahead)
                if label == "K":
                    say(role, text)
                    q = GRAMMAR[q][role[:1]]
                elif label == "R":
                    say(ROLES[wanted(q)[0]], text)
                    q = wanted(q)[1]
            for _ in (end := at_end(q)):
                say(ROLES[wanted(q)[0]], "")
                q = wanted(q)[1]
            for c, v in zip(out, (conv, *counts, cost, "".join(audit) + end, digest.hexdigest()), strict=True):
                out[c].append(v)
            if len(out["conv"]) >= 1 << 12:
                yield out
                out = {c: [] for c in out}
        yield out

    return map_arrow(dealt, FOUND, each)


def repair_conversations(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row of FOUND for each conv of rows (conv, turn, role, text), none of them null but turn.

    Turns go in order, null ones first, ties by role and then by the md5 of the text. A turn's first fault counts: blank,
    duplicate (role and text stand earlier), truncated. Blank and duplicate turns must go. Repeated rows are turns like
    others; other roles than system, user and assistant count by their initial; an empty table gives an empty one.
    """
    scratch = Scratch(rows.sparkSession, "turns")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = rows.select("conv", "turn", "role", F.unhex(F.md5("text")).alias("print"), *(v.alias(c) for c, v in faulty().items()))
    slim = slim.groupBy("conv", "turn", "role", "print").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("short").alias("short"))
    order = ("conv", "turn", "role", "print")
    found = scratch.keep(blocks(seen_first(slim).repartitionByRange(n, *order).sortWithinPartitions(*order), block_rows))
    return repaired(rows, paths(found, plans(found)))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's faults after damage, and its cheapest repair; a null conv_id is one. Nulls, ties and repeats as in `damaged` and `repair_conversations`."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").withColumn("conv_id", F.col("conv_id").cast("long"))
    found = repair_conversations(damaged(rows)).withColumnRenamed("conv", "c_")
    every = rows.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    none = hashlib.sha256().hexdigest()
    return every.join(found, F.col("conv") == F.col("c_"), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"),
    )


QUERIES = {"op11_turn_repair": op11_turn_repair}

# backwards over each conversation's turns: for each grammar state (1 start, 2 system, 3 user, 4 assistant) the best cost, labels and repaired text to the end
_INSERTED = "list_transform([1, 2, 3, 4], lambda q: list_sort([v[q], {'c': v[[3, 3, 4, 3][q]].c + 2, 'a': 'I' || v[[3, 3, 4, 3][q]].a, 'r': chr(10) || ['user', 'user', 'assistant', 'user'][q] || ':' || v[[3, 3, 4, 3][q]].r}])[1])"
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), named AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(turn AS VARCHAR), ' ') AS spot FROM conversations
), dealt AS (
  SELECT conv, turn, role, text, xor(list_reduce([4294967295] || list_transform(string_split(conv || ':' || spot, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS how FROM named, crc
), rows_after AS (
  SELECT conv, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) FROM dealt WHERE how <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text)) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM rows_after
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(role[1]) OVER (PARTITION BY conv ORDER BY i) || role[1] AS pair FROM placed
), facts AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1
), best AS (
  SELECT conv, n + 1 AS i, [{{'c': 0, 'a': '', 'r': ''}}, {{'c': 4, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{'c': 2, 'a': 'I', 'r': chr(10) || 'assistant:'}}, {{'c': 0, 'a': '', 'r': ''}}] AS v FROM facts
  UNION ALL
  SELECT conv, i, {_INSERTED} FROM (SELECT conv, i, {_INSERTED} AS v FROM (
    SELECT b.conv, j.i, list_transform([1, 2, 3, 4], lambda q: list_sort([{{'c': v[q].c + 3, 'a': 'D' || v[q].a, 'r': v[q].r}}]
      || CASE WHEN fault IN (0, 3) THEN [{{'c': v[[3, 3, 4, 3][q]].c + 2 + fault // 3, 'a': 'R' || v[[3, 3, 4, 3][q]].a, 'r': chr(10) || ['user', 'user', 'assistant', 'user'][q] || ':' || text || v[[3, 3, 4, 3][q]].r}}] ELSE [] END
      || CASE WHEN fault IN (0, 3) AND contains(['su', 'u', 'a', 'u'][q], role[1]) AND role <> '' THEN [{{'c': v[strpos('-sua', role[1])].c + fault // 3, 'a': 'K' || v[strpos('-sua', role[1])].a, 'r': chr(10) || role || ':' || text || v[strpos('-sua', role[1])].r}}] ELSE [] END)[1]) AS v
    FROM best b JOIN judged j ON b.conv = j.conv AND j.i = b.i - 1))
)
SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v[1].c, 0) AS BIGINT) AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(substr(v[1].r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM named) n LEFT JOIN facts f ON f.conv = n.conv LEFT JOIN best b ON b.conv = n.conv AND b.i = 1
"""
ORACLES = {"op11_turn_repair": ORACLE}
