"""Conversation repair against a plain search over all edits, small and in blocks, and the registered query by its contract."""

import hashlib
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\v\f\r"


def cheapest(rows):
    """(cost, audit) by trying every edit at every place; rows of (initial, must go, late)."""

    @cache
    def best(place, state, inserted):
        found = [(0, "")] if place == len(rows) and state in (0, 3) else []
        steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
        fits = [t for c, t in steps.items() if c in "ua"]
        after = [(2, "I", place, t, inserted + 1) for t in fits] if inserted < 4 else []
        if place < len(rows):
            initial, gone, late = rows[place]
            after.append((3, "D", place + 1, state, 0))
            if not gone:
                after += [(2 + late, "R", place + 1, t, 0) for t in fits]
                after += [(late, "K", place + 1, steps[initial], 0)] if initial in steps else []
        for cost, letter, *to in after:
            if (more := best(*to)) is not None:
                found.append((cost + more[0], letter + more[1]))
        return min(found, default=None)

    return best(0, 0, 0)


def expected(turns):
    """The contract's row for one conversation's rows (turn, role, text), after damage."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in turns:
        end = text.strip(BLANK)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    cost, audit = cheapest(tuple((r[1][:1], f in ("blank", "duplicate"), int(f == "truncated")) for r, f in zip(turns, faults, strict=True)))
    left, kept, state = iter(turns), [], "start"
    for letter in audit:
        fitting = "assistant" if state == "u" else "user"
        if letter == "I":
            kept.append((fitting, ""))
        else:
            _, role, text = next(left)
            if letter != "D":
                kept.append((role if letter == "K" else fitting, text))
        state = kept[-1][0][:1] if kept else "start"
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def some_rows(seed, conversations, most, ids=None):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", " ", "", "Tool", "ünder"], ["Hi.", "yes!", "cut", "", " \n", "ok?", "é. \t", "…", "a\nb."]
    return [(c, r.choice([None, *range(9)]), r.choice(roles[: r.choice([2, 3, 9])]), r.choice(texts)) for c in (ids or range(conversations)) for _ in range(r.randint(0, most))]


def check(got, rows):
    of = {}
    for conv, *row in rows:
        of.setdefault(conv, []).append((row[0], " " if row[1] is None else row[1], " " if row[2] is None else row[2]))
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: expected(own) for c, own in of.items()} and len(got) == len(of)


def test_all_edits_are_tried(spark):
    rows = some_rows(1, 120, 8) + [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (777, 5, "user", "x" * 300_000)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("edit", F.lit(1)).withColumn("block", F.lit(2)).repartition(5)
    check(repair.digests(repair.repaired(table)).collect(), rows)


@pytest.mark.parametrize(("most", "block"), [(3, 2), (6, 4), (12, 65_536)])
def test_blocks_agree_with_the_whole(spark, most, block):
    rows = some_rows(2, 14, 40, ids=[None, *range(13)]) + [(50, 3, "user", "same.")] * 30
    table = spark.createDataFrame(rows, SCHEMA)
    blocks = repair.repaired(table, most=most, block=block)
    check(repair.digests(blocks).collect(), rows)
    steps = {}
    for r in blocks.collect():
        steps.setdefault(r.conv_id, []).append(r.step)
    assert all(sorted(s) == list(range(len(s))) for s in steps.values())


def test_search_stops_early_and_is_exact():
    r = random.Random(3)
    for _ in range(2000):
        rows = [(r.choice("suaax"), r.random() < 0.2, int(r.random() < 0.3)) for _ in range(r.randint(0, 7))]
        cost, audit = cheapest(tuple(rows))
        far = repair.distances(rows, whole=False)
        assert (far[0], repair.walk(rows, far)[0]) == (cost, audit)
        assert repair.distances(rows)[0] == cost


def test_no_rows(spark):
    assert repair.digests(repair.repaired(spark.createDataFrame([], SCHEMA))).collect() == []


def damage(rows):
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else text.translate({ord(c): None for c in ".!?"}) if how == 2 else text
        yield from [(conv, turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)


@pytest.mark.parametrize("odd", [False, True])
def test_query_by_its_contract(spark, sf_dir, tmp_path, odd):
    if odd:
        rows = some_rows(4, 200, 6) + [(None, None, None, "x."), (5000, None, "user", None)] + [(6000 + k, k, "user", "one.") for k in range(60)]
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
        sf_dir = str(tmp_path)
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    of = {conv: [] for conv, *_ in rows}
    for conv, *row in damage(rows):
        of[conv].append(tuple(row))
    got = queries.queries()["op11_conversation_repair"](spark, sf_dir)
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert got.dtypes == [*((n, "bigint") for n in names[:7]), ("audit", "string"), ("repaired_sha256", "string")]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == {c: expected(own) for c, own in of.items()}
