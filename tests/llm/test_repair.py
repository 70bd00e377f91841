"""Conversation repair against an exhaustive shortest path over all edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import repair

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for i, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (i, turn))
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(i, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit) with its lines by relaxing every edit until nothing changes."""
    labels = {"": (0, "", [])}

    def offer(into, state, label):
        if state not in into or label[:2] < into[state][:2]:
            into[state] = label
            return True
        return False

    def insert():
        while any([offer(labels, c, (labels[p][0] + 2, labels[p][1] + "I", labels[p][2] + [ROLES[c] + ":"]))
                   for p in list(labels) for c in NEXT[p] if c in ROLES]):
            pass

    insert()
    for (_, _, role, text), fault in zip(rows, found, strict=True):
        after = {}
        for p, (cost, audit, lines) in labels.items():
            offer(after, p, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            for c in NEXT[p]:
                if role[:1] == c:
                    offer(after, c, (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                if c in ROLES:
                    offer(after, c, (cost + 2 + more, audit + "R", [*lines, f"{ROLES[c]}:{text}"]))
        labels = after
        insert()
    return min((labels[s] for s in ("", "a") if s in labels), key=lambda x: x[:2])


def plain(rows, ids):
    out = []
    for i in ids:
        own = in_order([r for r in rows if r[0] == i])
        found = faults(own)
        cost, audit, lines = cheapest(own, found) if own else (0, "", [])
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((i, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def conversation(rng, i, n, distinct=None):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "assistant"]
    texts = ["Yes.", "No!", "and then", "why ? \n", "", " \t", "Done.\v", "né ", None]
    rows = []
    for k in range(n):
        role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[k % 2]
        text = rng.choice(texts) if rng.random() < 0.4 else f"Turn {rng.randrange(distinct or 10 ** 6)}{rng.choice(['.', '!', '', ' '])}"
        rows.append((i, rng.choice([k, k, k, 2 * k, k // 2, None]) if rng.random() < 0.2 else k, role, text))
    return rows + rng.sample(rows, min(len(rows), rng.randrange(3)))


def rows_of(seed, sizes, **kw):
    rng = random.Random(seed)
    rows = [r for i, n in enumerate(sizes) for r in conversation(rng, i if i else None, n, **kw)]
    rng.shuffle(rows)
    return rows


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def key(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("segment", [256, 3])
def test_repair_equals_exhaustive(spark, segment, monkeypatch):
    rows = rows_of(segment, [0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 8, 8, 9, 40, 90], distinct=30)
    df = spark.createDataFrame(rows, TURNS).repartition(3).withColumns(
        {c: F.lit("own") for c in ("place", "edit", "letters", "part", "digest", "first", "x", "step")})
    monkeypatch.setattr(repair, "SEGMENT", segment)
    init = repair.Repair.__init__
    monkeypatch.setattr(repair.Repair, "__init__", lambda self, c: init(self, c, segment))
    got = repair.repair_report(df, repair.damage(df)).collect()
    want = plain(damaged(rows), {r[0] for r in rows})
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=key) == sorted(want, key=key)


def test_repair_of_whole_turns(spark):
    rows = [(7, 0, "system", "Be kind."), (7, 1, "assistant", "Hi."), (7, 2, "assistant", "cut off"), (7, 3, "user", " ")]
    fix = repair.Repair(spark.createDataFrame(rows, TURNS))
    turns = [tuple(r)[3:] for r in fix.repaired().orderBy("place", "step").collect()]
    audit = fix.summary().first()["audit"]
    want = cheapest(rows, faults(rows))
    assert audit == want[1] and [f"{role}:{text}" for role, text, _ in turns] == want[2]
    assert "".join(e for _, _, e in turns) == audit.replace("D", "")


def test_repair_of_nothing_and_of_dropped_rows(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.repair_report(none, repair.damage(none)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hi.")], TURNS)
    got = repair.repair_report(one, repair.damage(one)).first()
    assert tuple(got[c] for c in COLUMNS) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repair_of_one_long_conversation_and_many_copies(spark):
    """A conversation of several segments, a turn repeated 3,000 times, and a text of a million characters."""
    rng = random.Random(5)
    rows = [(1, k, ("user", "assistant")[k % 2] if rng.random() < 0.9 else "user", f"Turn {rng.randrange(500)}{rng.choice('. ')}")
            for k in range(1500)] + [(1, 10, "user", "Same.")] * 3000 + [(1, 2000, "user", "word " * 200_000)]
    got = repair.repair_report(*[spark.createDataFrame(rows, TURNS).repartition(4)] * 2).first()
    assert tuple(got[c] for c in COLUMNS) == plain(rows, [1])[0]


def test_bidirectional_search_equals_one_direction():
    rng = random.Random(1)
    for _ in range(400):
        steps = [repair.turn_edges(rng.choice(["s", "u", "a", "t", ""]), rng.random() < 0.2, rng.random() < 0.3,
                                   rng.choice([1, 1, 1, 2, 3])) for _ in range(rng.randrange(9))]
        for p in range(4):
            labels = {p: (0, "")}

            def insert(labels=labels):
                for a, b, c, w in repair.INSERTS * 3:
                    if a in labels:
                        labels[b] = min(labels.get(b, (99999, "")), (labels[a][0] + c, labels[a][1] + w))
            insert()
            for step in steps:
                after = {}
                for a, b, c, w in step:
                    if a in labels:
                        after[b] = min(after.get(b, (99999, "")), (labels[a][0] + c, labels[a][1] + w))
                labels.clear()
                labels.update(after)
                insert()
            for q in range(4):
                found = repair.cheapest(steps, repair.INSERTS, p, q)
                if steps:
                    assert found == labels.get(q)
