"""Conversation repair against a plain forward search, also where conversations are cut into stretches."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from srcloom.llm import repair as R

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """rows: (role, text), in order. (counts, cost, audit, sha) by a forward search that keeps the least (cost, letters) of each state."""
    best = {"": (0, "", [])}
    blank = duplicate = truncated = 0
    seen = set()

    def inserted(best):
        for _ in range(4):
            for state, (cost, letters, out) in list(best.items()):
                to = "a" if state == "u" else "u"
                found = (cost + 2, letters + "I", [*out, ("user:" if to == "u" else "assistant:")])
                if to not in best or found[:2] < best[to][:2]:
                    best[to] = found
        return best

    for role, text in rows:
        body = text.strip(SPACE)
        must = not body or (role, text) in seen
        blank += not body
        duplicate += bool(body) and (role, text) in seen
        cut = bool(body) and not must and body[-1] not in ".!?"
        truncated += cut
        seen.add((role, text))
        now = {}
        for state, (cost, letters, out) in inserted(best).items():
            options = [("D", 3, state, None)]
            if not must:
                first = role[:1]
                if (state, first) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    options.append(("K", cut, first, role))
                to = "a" if state == "u" else "u"
                options.append(("R", 2 + cut, to, "user" if to == "u" else "assistant"))
            for letter, more, to, name in options:
                found = (cost + more, letters + letter, out if name is None else [*out, f"{name}:{text}"])
                if to not in now or found[:2] < now[to][:2]:
                    now[to] = found
        best = now
    cost, letters, out = min((v for k, v in inserted(best).items() if k in ("", "a")), key=lambda v: v[:2])
    pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(rows, rows[1:], strict=False)]
    return (blank, duplicate, truncated, sum(p not in ("su", "ua", "au") for p in pairs)), cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute(table, damage=True):
    """table: (conv, turn, role, text). Rows of the query by conv."""
    held = defaultdict(list)
    for conv, turn, role, text in table:
        held[conv]
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how = zlib.crc32(name.encode()) % 20 if damage else 99
        role, text = " " if role is None else role, " " if text is None else text
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        held[conv] += [(turn, role, text)] * (2 if how == 3 else 1)
    out = {}
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{r[1]}:{r[2]}".encode()).digest()))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts, cost, audit, sha = cheapest([(r, t) for _, r, t in rows])
        out[conv] = (gaps, *counts, cost, audit, sha)
    return out


def found(df):
    rows = [tuple(r) for r in df.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def random_table(seed, convs, most):
    rng = random.Random(seed)
    table = []
    for conv in range(convs):
        texts = ["Yes.", "no", "", " \t", "So what?", "a\nb.", "Ünü. ", "end!\n"] + [f"{k}{rng.choice('.!? x')}" for k in range(9)]
        for turn in range(rng.randint(1, most)):
            t = rng.choice([turn, turn, turn, turn + 2, None, 0])
            table.append((rng.choice([conv, conv, None]) if conv == 3 else conv, t, rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice([*texts, None])))
    return table


@pytest.mark.parametrize("seed", range(4))
def test_random_conversations(spark, seed):
    table = random_table(seed, 60, 12)
    df = R.plain_rows(spark.createDataFrame([(*r, 1, "x") for r in table], "conv_id long, turn int, role string, text string, conv int, digest string").repartition(3))
    assert found(R.repair(df, R.damaged(df))) == brute(table)
    assert found(R.repair(df, df)) == brute(table, damage=False)


def test_query_on_the_small_tables(spark):
    got = R.op12_conversation_repair(spark, SF)
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(got.withColumnRenamed("conv_id", "conv")) == brute(table)
    kinds = dict(got.dtypes)
    assert kinds.pop("conv_id") == dict(spark.read.parquet(f"{SF}/conversations.parquet").dtypes)["conv_id"]
    assert set(kinds.values()) == {"bigint", "string"}


def test_conversations_cut_over_tasks(spark):
    table = [(c if c < 2 else None, *r[1:]) for c in range(3) for r in random_table(7 + c, 1, 1)]
    rng = random.Random(1)
    for conv, n in ((5, 700), (None, 300), (9, 3)):
        for turn in range(n):
            table.append((conv, turn, rng.choice(["user", "assistant", "assistant", "system", "x"]), rng.choice(["Hm.", "ok", "", f"{turn}.", f"{turn}"])))
    rows = spark.createDataFrame(table, "conv_id int, turn int, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 13)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        df = R.plain_rows(rows)
        assert found(R.repair(df, df)) == brute(table, damage=False)
        _, edits = R.edited(df)
        assert edits.where("conv = 5").select("part").distinct().count() > 3
        made = defaultdict(list)
        for r in R.repaired_rows(df, edits).orderBy("part", "ord", "sub").collect():
            made[r.conv].append(f"{r.role}:{r.text}")
        want = brute(table, damage=False)
        assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in made.items()} == {c: v[-1] for c, v in want.items() if c in made}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_one_text_ten_thousand_times_and_a_long_one(spark):
    table = [(1, 0, "user", "Hi.")] * 3000 + [(1, 1, "assistant", "x" * 300_000 + " ! ")]
    df = R.plain_rows(spark.createDataFrame(table, "conv_id int, turn int, role string, text string"))
    assert found(R.repair(df, df)) == brute(table, damage=False)


def test_empty_table(spark):
    df = R.plain_rows(spark.createDataFrame([], "conv_id int, turn int, role string, text string"))
    assert R.repair(df, df).collect() == []
    one = R.plain_rows(spark.createDataFrame([(1, 2, "user", "x")], "conv_id int, turn int, role string, text string"))
    assert found(R.repair(one, one.where(F.lit(False)))) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 400])
def test_walks_from_checkpoints_lose_nothing(n):
    rng = random.Random(n)
    rows = [(rng.choice(["user", "assistant", "system", "x"]), f"{k}{rng.choice('.x')}" if rng.random() < 0.9 else "") for k in range(n)]
    codes = [3 * {"u": 1, "a": 2, "s": 0}.get(r[0], 3) + (2 if not t else t[-1] != ".") for r, t in rows]
    stretch = R.Stretch(bytes(codes), [1] * n)
    audit, to, _ = stretch.walk(R.START, R.ending(), True)
    assert (stretch.costs(R.ending(), 0, n)[R.START], audit) == cheapest(rows)[1:3]
    assert len(stretch.checkpoints(R.ending())[1]) <= n**0.5 + 3
