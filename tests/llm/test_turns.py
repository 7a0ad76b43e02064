"""Conversation repair against SQL, against every edit sequence, and in blocks of any size."""

import hashlib
import os
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import duckdb
import pytest

from tracemend.llm import turns

ROWS = "conv_id long, turn long, role string, text string"


def talk(draw, n=60):
    out = []
    for c in range(n):
        for t in range(draw.randrange(0, 9)):
            role = draw.choice(["user", "assistant"] * 4 + ["system", "tool", "", "unknown", None])
            text = draw.choice([f"Said {c} {t}.", f"Cut {t}", f"Why {t}?", "Again!", "", " \t\n", "No. Yes! So?", "end.  ", None, "é\x0b"])
            out.append((c, t * draw.choice([1, 1, 1, 3]), role, text))
    return out


def awkward():
    draw = random.Random(7)
    rows = talk(draw)
    rows += [(None, 0, "user", "hi."), (None, 1, "assistant", "ho."), (900, None, "user", "a."), (900, None, "user", "b."), (900, None, None, None), (901, None, "user", None), (-5, -3, "user", "x."), (-5, 4, "assistant", "y.")]
    rows += rows[:9] + rows[:4]  # repeated rows
    rows += [(902, k, "system", "s.") for k in range(4)] + [(903, k, "user", f"{k}.") for k in range(25)] + [(904, 0, "user", "long " * 40_000 + ".")]
    rows += [(next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "all of it is dropped.")]
    return rows


def plainly(rows):
    """The contract, a conversation at a time."""
    every = {r[0] for r in rows}
    after = {}
    for conv, turn, role, text in rows:
        c, t, role, text = *(" " if x is None else str(x) for x in (conv, turn)), *(" " if x is None else x for x in (role, text))
        how = zlib.crc32(f"{c}:{t}".encode()) % 20
        if how:
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            after.setdefault(conv, []).extend([(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1))
    out = {}
    for conv in every:
        mine = sorted(after.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        kinds, seen = [], set()
        for _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\f\r")
            kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        known = {t for t, *_ in mine if t is not None}

        @lru_cache(None)
        def best(i, state, inserted):
            options = [(0, "", ())] if i == len(mine) and state in ("", "a") else []
            nxt = "assistant" if state == "u" else "user"
            step = lambda cost, label, said, rest: (cost + rest[0], label + rest[1], said + rest[2])
            if inserted < 2:
                options.append(step(2, "I", ((nxt, ""),), best(i, nxt[0], inserted + 1)))
            if i < len(mine):
                _, role, text = mine[i]
                options.append(step(3, "D", (), best(i + 1, state, 0)))
                if kinds[i] in ("", "truncated"):
                    extra = int(kinds[i] == "truncated")
                    options.append(step(2 + extra, "R", ((nxt, text),), best(i + 1, nxt[0], 0)))
                    if role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[state] and role:
                        options.append(step(extra, "K", ((role, text),), best(i + 1, role[0], 0)))
            return min(options, default=(10**9, "", ()))

        cost, audit, said = best(0, "", 0)
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    return out


def values(r):
    return (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("talk"))
    spark.createDataFrame(awkward(), ROWS).selectExpr("*", "1 AS conv", "2 AS print", "'x' AS audit").repartition(5).write.parquet(f"{path}/conversations.parquet")
    return path


def test_query(spark, folder):
    got = {r["conv_id"]: values(r) for r in turns.op11_turn_repair(spark, folder).collect()}
    want = plainly(awkward())
    assert got == want
    assert all(any(k in v[6] for v in want.values()) for k in "DIKR") and any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for v in want.values())


def test_sql(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM '{os.path.join(folder, 'conversations.parquet')}/*.parquet' WHERE conv_id IS NULL OR conv_id <> 904")
    ran = con.execute(turns.ORACLE)
    names = [d[0] for d in ran.description]
    got = {r["conv_id"]: values(r) for r in (dict(zip(names, x, strict=True)) for x in ran.fetchall())}
    want = plainly(awkward())
    assert got == {c: v for c, v in want.items() if c != 904}


@pytest.mark.parametrize("block_rows", [1, 2, 3, 7])
def test_blocks(spark, folder, block_rows):
    """However a conversation is cut, its repair is the same; equal turns may fill several blocks."""
    rows = turns.damaged(spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    rows = rows.unionByName(spark.sql("SELECT 'many' AS conv, 1L AS turn, 'user' AS role, 'So.' AS text FROM range(11)")).unionByName(spark.sql("SELECT 'many', 2L, 'assistant', concat('n', id % 2) FROM range(9)").toDF("conv", "turn", "role", "text"))
    whole = {r["conv"]: values(r) for r in turns.repair_conversations(rows).collect()}
    parts = {r["conv"]: values(r) for r in turns.repair_conversations(rows, block_rows).collect()}
    assert parts == whole and whole["many"][:5] == (0, 0, 17, 2, 18)


def test_empty(spark):
    assert turns.repair_conversations(spark.createDataFrame([], "conv string, turn long, role string, text string")).count() == 0


def test_path_is_the_least_of_all():
    """Against all edit sequences of up to three turns, two insertions between turns at most."""
    kinds = [turns.symbol_of(r, g, s) for r in "suax" for g, s in ((False, False), (False, True), (True, False))]
    for n in range(4):
        for symbols in product(kinds, repeat=n):
            def walk(i, q, label="", cost=0, added=0):
                if i == n and q in turns.FINAL:
                    yield cost, label
                if added < 2:
                    yield from walk(i, turns.wanted(q)[1], label + "I", cost + turns.INSERT, added + 1)
                if i < n:
                    for k, c, to in turns.arcs(symbols[i], q):
                        yield from walk(i + 1, to, label + k, cost + c)

            if n < 3 or hash(symbols) % 13 == 0:
                assert turns.shortest_path(list(symbols)) == min(walk(0, turns.START))
