"""Repair of conversations against brute force over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from actispark.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(key.encode()) % 20
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying every sequence of edits, best first by dynamic programming over whole strings."""
    best = {"": (0, "", ())}  # by role initials so far

    def put(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def inserts(table):
        for _ in range(3):
            for key, (cost, audit, got) in list(table.items()):
                role = "assistant" if key.endswith("u") else "user"
                put(table, key + role[0], (cost + 2, audit + "I", (*got, (role, ""))))

    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        inserts(best)
        new = {}
        for key, (cost, audit, got) in best.items():
            put(new, key, (cost + 3, audit + "D", got))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if GOOD.fullmatch(key + role[:1]) or GOOD.fullmatch(key + role[:1] + "a") or GOOD.fullmatch(key + role[:1] + "ua"):
                    if role:
                        put(new, key + role[:1], (cost + more, audit + "K", (*got, (role, text))))
                for r in ("user", "assistant"):
                    if GOOD.fullmatch(key + r[0]) or GOOD.fullmatch(key + r[0] + "a"):
                        put(new, key + r[0], (cost + 2 + more, audit + "R", (*got, (r, text))))
        best = new
    inserts(best)
    return min(v for k, v in best.items() if GOOD.fullmatch(k))


def expected(rows):
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        left = sorted((r[1:] for r in damaged(r for r in rows if r[0] == conv)), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        cost, audit, got = cheapest(left)
        turns = [r[0] for r in left if r[0] is not None]
        f = faults(left)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(left))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        text = "\n".join(f"{r}:{t}" for r, t in got)
        out.append((conv, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    draw = random.Random(seed)
    texts = ["Yes.", "no", "", " \n", "Why?!", "so. ", "Ünï.", "…", None, "a b\n."]
    roles = ["user", "assistant", "system", "tool", "", None, "stranger"]
    rows = [
        (None if conv == 7 else conv, draw.choice([None, *range(12)]), draw.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], draw.choices(texts, [6, 4, 1, 1, 3, 3, 2, 1, 1, 2])[0])
        for conv in range(40) for _ in range(draw.randrange(1, 9))
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(c.repair_reports(c.damage(df))) == expected(rows)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(c.op11_streamed_repair(spark, sf_dir)) == expected(rows)


def test_giant_conversation_across_batches(spark):
    """More rows than an Arrow batch, ties and hot texts: its repair is the one of the whole."""
    rows = [(1, i // 2, ("user", "assistant", "user", "system")[i % 4], f"t{i % 900}.") for i in range(9_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["seq"], r["edit"], r["role"]) for r in c.repair_conversations(df).collect()}
    left = [(t, r, x) for _, t, r, x in sorted(rows, key=lambda r: (r[1], r[2], r[3]))]
    # states of the automaton instead of whole strings
    after = [c.LAST]
    f = faults(left)
    for (_, role, _), fault in zip(reversed(left), reversed(f), strict=True):
        after.append(c.choices(role[:1], fault, after[-1])[0])
    edits = [e for _, e, _ in sorted(got)]
    cost = sum({"D": 3, "I": 2, "K": 0, "R": 2}[e] for e in edits)
    assert cost == after[-1][c.START]
    assert GOOD.fullmatch("".join(r[0] for _, e, r in sorted(got) if e != "D"))
    assert sum(e != "I" for e in edits) == len(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Alone."), (3, 5, "system", "Be kind.")]
    got = c.repair_conversations(spark.createDataFrame(rows, SCHEMA).withColumn("copy", c.F.lit(1)).withColumn("choice", c.F.lit(1))).orderBy("conv_id", "seq").collect()
    assert [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in got] == [
        (1, "K", "user", "Hi."), (1, "I", "assistant", ""), (1, "K", "user", "Still there?"), (1, "K", "assistant", "Yes."),
        (2, "I", "user", ""), (2, "K", "assistant", "Alone."), (3, "D", "system", "Be kind."),
    ]


def test_empty_and_all_dropped(spark):
    assert c.repair_reports(c.damage(spark.createDataFrame([], SCHEMA))).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = c.repair_reports(c.damage(spark.createDataFrame([(gone, 0, "user", "x")], SCHEMA))).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_large_numbers_among_nulls(spark):
    """Ids and turns beyond what a float holds, beside null ones."""
    big = 2**60 + 1
    rows = [(None, None, "user", "a."), (None, big, "user", "b."), (big, big + 2, "user", "c."), (big, None, "user", "d."), (big, big, "assistant", "e."), (big + 1, 0, "user", "f."), (big, -(2**63), "system", "g.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(1)
    assert found(c.repair_reports(c.damage(df))) == [(*r[:1], min(r[1], 2**63 - 1), *r[2:]) for r in expected(rows)]
    assert {r["turn"] for r in c.repair_conversations(df).collect()} >= {r[1] for r in rows}
