"""Conversation repair: the cheapest edits that make a conversation well formed.

Role initials must read ``(s?(ua)+)?``. Edits: K keeps a turn (0), R gives it the
role user or assistant (2), D deletes it (3), I inserts an empty turn of the
user or the assistant (2); a truncated turn that stays costs 1 more. Blank turns
and repeats of an earlier turn must go. Of the cheapest edits, those whose
letters in order (the audit) come first as ASCII.

A node of the edit lattice is a number of turns read and the state of that
pattern (nothing, system, user or assistant written last). Two heaps, forward
from the start and backward from the goal, settle nodes by cost; an edge
between a node settled forward and one settled backward is a crossing. The
search goes on until no crossing of the least cost can be missing, then the
least concatenated audit wins. Labels hold a cost and the least audit that has
it: audits of one cost to one node never begin with each other, so the least
parts make the least whole.

A conversation is cut into segments of ``SEGMENT`` turns. A segment's result is
the cheapest edits between each pair of states at its ends, found by such a
search; up to ``SEGMENT`` results are the edges of a coarser lattice, searched the
same way, until one is left. Turns are numbered by the range-sliced rank,
equal turns are one row with a count, and texts are replaced by their digest
until the edits are known, so a conversation with a third of all rows is spread
over tasks like any other rows. Only its final digest is a stream through one task
(SHA-256 is sequential); that stream holds one batch in memory.

Defined cases: a null role or text is one space, a null turn sorts first (its
own damage key is one space, as a null conversation's is), rows with a null
conv_id are a conversation; turns of equal number go by role, then by the SHA-256
of their text; rows that repeat are repeats of a turn; roles with any other
initial can only be rewritten or deleted; an empty repaired conversation is the
digest of the empty string. An audit is one cell, so it must stay below 2 GB.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.store import materialize
from tillroll.operators.ranking import rank_within

SEGMENT = 256
BLANKS = " \t\n\x0b\x0c\r"

NONE, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (NONE, ASSISTANT)
# What an edit may write next: the state before, the initial, the state after.
WRITES = [(NONE, "s", SYSTEM), (NONE, "u", USER), (SYSTEM, "u", USER), (ASSISTANT, "u", USER), (USER, "a", ASSISTANT)]
CHOICES = [(p, q) for p, letter, q in WRITES if letter != "s"]
INSERTS = [(p, q, 2, "I") for p, q in CHOICES]
INFINITE = float("inf")


def turn_edges(initial: str, must_go: bool, truncated: bool, copies: int):
    """(state before, state after, cost, letters) of the edits of one turn. L
    keeps a leading system turn; d deletes a further copy of the turn."""
    rest, extra = "d" * (copies - 1), 3 * (copies - 1)
    edges = [(p, p, 3 + extra, "D" + rest) for p in range(4)]
    if must_go:
        return edges
    keep = [(p, q, truncated + extra, ("L" if letter == "s" else "K") + rest)
            for p, letter, q in WRITES if letter == initial]
    return edges + keep + [(p, q, 2 + truncated + extra, "R" + rest) for p, q in CHOICES]


class _Side:
    """One direction of the search: labels, settled nodes, heap."""

    def __init__(self, at: int, state: int):
        self.label = {(at, state): (0, "")}
        self.settled: set = set()
        self.heap = [(0, 0, at, state)]

    def top(self):
        return self.heap[0][0] if self.heap else INFINITE

    def offer(self, node, cost, letters, depth):
        old = self.label.get(node)
        if old is None or (cost, letters) < old:
            self.label[node] = (cost, letters)
            if old is None or cost < old[0]:
                heapq.heappush(self.heap, (cost, depth, *node))


def cheapest(steps: list[list], inserts: list, start: int, goal: int):
    """(cost, letters) of the cheapest edits from state ``start`` before all
    ``steps`` to ``goal`` after them, or None. ``steps``: per turn or segment its
    edges; ``inserts``: edges that read nothing. Free edges read a step, so nodes of
    one cost are settled by how many steps they are from their side's end."""
    n = len(steps)
    ahead, back = _Side(0, start), _Side(n, goal)
    best = (INFINITE, "")
    while min(ahead.top(), back.top()) < INFINITE and ahead.top() + back.top() <= best[0]:
        forward = ahead.top() <= back.top()
        side, other = (ahead, back) if forward else (back, ahead)
        _, _, at, state = heapq.heappop(side.heap)
        if (at, state) in side.settled:
            continue
        side.settled.add((at, state))
        cost, letters = side.label[at, state]
        step = at if forward else at - 1
        around = [(at, e) for e in inserts]
        if 0 <= step < n:
            around += [(at + (1 if forward else -1), e) for e in steps[step]]
        for to, (p, q, price, word) in around:
            here, there = (p, q) if forward else (q, p)
            if here != state:
                continue
            node = (to, there)
            far = other.label[node] if node in other.settled else None
            if forward:
                side.offer(node, cost + price, letters + word, to)
                if far:
                    best = min(best, (cost + price + far[0], letters + word + far[1]))
            else:
                side.offer(node, cost + price, word + letters, n - to)
                if far:
                    best = min(best, (far[0] + price + cost, far[1] + word + letters))
    return None if best[0] == INFINITE else best


def _between(steps: list[list], inserts: list, first: bool) -> list[dict]:
    """The cheapest edits between all states at the ends of some steps."""
    out = []
    for p in (NONE,) if first else range(4):
        for q in range(4):
            found = cheapest(steps, inserts, p, q)
            if found:
                out.append({"p": p, "q": q, "cost": found[0], "letters": found[1]})
    return out


EDGES = "array<struct<p:int,q:int,cost:long,letters:string>>"
PART = f"conv_id {{}}, part long, head string, tail string, illegal long, edges {EDGES}"
LEGAL = ("su", "ua", "au")


def _arrow(out: list[dict], like: pa.RecordBatch) -> pa.RecordBatch:
    edge = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())])
    return pa.RecordBatch.from_pylist(out, schema=pa.schema([
        like.schema.field("conv_id"), ("part", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
        ("illegal", pa.int64()), ("edges", pa.list_(edge))]))


def _segments(batches):
    """Turns of a segment in order -> its edges, its outer initials and its illegal pairs."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            turns = row["turns"]
            initials = [t["initial"] for t in turns]
            illegal = sum(t["copies"] - 1 for t in turns)
            illegal += sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            steps = [turn_edges(t["initial"], t["must_go"], t["truncated"], t["copies"]) for t in turns]
            out.append({"conv_id": row["conv_id"], "part": row["part"], "head": initials[0], "tail": initials[-1],
                        "illegal": illegal, "edges": _between(steps, INSERTS, row["part"] == 0)})
        yield _arrow(out, batch)


def _joined(batches):
    """Segments that follow each other -> one."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            parts = row["parts"]
            edges = parts[0]["edges"]
            if len(parts) > 1:
                edges = _between([[(e["p"], e["q"], e["cost"], e["letters"]) for e in x["edges"]] for x in parts],
                                 [], row["part"] == 0)
            illegal = sum(x["illegal"] for x in parts) + sum(
                a["tail"] + b["head"] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
            out.append({"conv_id": row["conv_id"], "part": row["part"], "head": parts[0]["head"],
                        "tail": parts[-1]["tail"], "illegal": illegal, "edges": edges})
        yield _arrow(out, batch)


_TURN = re.compile("(I*)([DKLR])d*")


def _pieces(segment: int):
    """An audit -> per segment the edits of its turns. A turn's edits are the
    roles inserted before it, its own letter (U and A: rewritten to user and
    assistant), and the roles inserted after it, which only the last one has."""
    def written(letters, last):
        out = []
        for c in letters:
            last = "u" if last != "u" else "a"
            out.append(last.upper() if c == "R" else last)
        return "".join(out), last

    def run(batches):
        for batch in batches:
            ids, parts, edits = [], [], []
            for k, audit in enumerate(batch.column(1).to_pylist()):
                last, turns, end = "", [], 0
                for m in _TURN.finditer(audit):
                    before, last = written(m[1], last)
                    if m[2] in "DL":
                        turns.append(before + m[2].replace("L", "K"))
                    else:
                        own, last = written("R", last)
                        turns.append(before + (own if m[2] == "R" else "K"))
                    end = m.end()
                turns[-1] += written(audit[end:], last)[0]
                for at in range(0, len(turns), segment):
                    ids.append(k)
                    parts.append(at // segment)
                    edits.append(turns[at:at + segment])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(parts, pa.int64()),
                 pa.array(edits, pa.list_(pa.string()))], ["conv_id", "part", "edits"])
    return run


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with a fault by
    crc32(conv_id:turn) % 20: 0 drops the row, 1 empties its text, 2 removes its
    sentence marks, 3 repeats it (``copies`` is 2), 4 sets its role to user."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.filter(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 3, 2).otherwise(1).cast("long").alias("copies"))


class Repair:
    """The repair of ``conversations`` (conv_id, turn, role, text and, where
    there is one, copies). Numbering and edits run when it is built."""

    def __init__(self, conversations: DataFrame, segment: int = SEGMENT):
        self.segment = segment
        copies = F.col("copies").cast("long") if "copies" in conversations.columns else F.lit(1).cast("long")
        role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
        self.rows = conversations.select("conv_id", "turn", role, text, copies.alias("copies"))
        ids = conversations.schema["conv_id"].dataType.simpleString()
        self.turns = materialize(self._numbered(), "turns")
        turn = F.struct("place", F.substring("role", 1, 1).alias("initial"), "must_go", "truncated", "copies")
        # Segments are few bytes but much work: a stated number of tasks, which is not merged by size.
        tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        segments = (self.turns.withColumn("part", F.expr(f"(place - 1) div {segment}"))
                    .repartition(tasks, "conv_id", "part").groupBy("conv_id", "part"))
        parts = materialize(segments.agg(F.sort_array(F.collect_list(turn)).alias("turns"))
                            .mapInArrow(_segments, PART.format(ids)), "parts")
        last = parts.agg(F.max("part")).first()[0] or 0
        while last:
            last //= segment
            grouped = parts.groupBy("conv_id", F.expr(f"part div {segment}").alias("part")).agg(
                F.sort_array(F.collect_list(F.struct("part", "head", "tail", "illegal", "edges"))).alias("parts"))
            parts = materialize(grouped.mapInArrow(_joined, PART.format(ids)), "parts")
        goals = ", ".join(map(str, GOALS))
        best = F.expr(f"array_min(transform(filter(edges, e -> e.q in ({goals})), e -> struct(e.cost, e.letters)))")
        self.edits = materialize(parts.select("conv_id", "illegal", best.alias("best")).select(
            "conv_id", "illegal", F.col("best.cost").alias("cost"), F.col("best.letters").alias("letters")), "edits")

    def _numbered(self) -> DataFrame:
        """Distinct turns with their copies, faults and place in the conversation."""
        end = F.rtrim("text", F.lit(BLANKS))
        narrow = self.rows.select(
            "conv_id", "turn", "role", F.sha2(F.col("text"), 256).alias("digest"), (end == "").alias("blank"),
            (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open_end"), "copies")
        keys = ["conv_id", "turn", "role", "digest", "blank", "open_end"]
        narrow = materialize(narrow.groupBy(*keys).agg(F.sum("copies").alias("copies")), "narrow")
        first = materialize(narrow.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
                            .withColumnsRenamed({c: f"_{c}" for c in ("conv_id", "role", "digest")}), "first")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv_id", "role", "digest")]
        repeat = ~F.col("first.turn").eqNullSafe(F.col("turn"))
        flagged = narrow.join(first, same).select(
            "conv_id", "turn", "role", "digest", "copies", "blank", (~F.col("blank") & repeat).alias("repeat"),
            (F.col("blank") | repeat).alias("must_go"),
            (~F.col("blank") & ~repeat & F.col("open_end")).alias("truncated"))
        return rank_within(flagged, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")],
                           name="place", method="range")

    def summary(self) -> DataFrame:
        """Per conversation: gaps, faults, illegal neighbours, cost and audit."""
        n = F.col("copies")
        by_turn = self.turns.groupBy("conv_id", "turn").agg(
            F.sum(F.when(F.col("blank"), n)).alias("blank"),
            F.sum(F.when(F.col("repeat"), n).when(~F.col("blank"), n - 1)).alias("duplicate"),
            F.sum(F.when(F.col("truncated"), 1)).alias("truncated"))
        stats = by_turn.groupBy("conv_id").agg(
            (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"),
            *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
        edits = self.edits.withColumnRenamed("conv_id", "_conv_id")
        return stats.join(edits, F.col("conv_id").eqNullSafe(F.col("_conv_id"))).select(
            "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated")),
            "illegal", "cost", F.translate("letters", "Ld", "KD").alias("audit"))

    def repaired(self) -> DataFrame:
        """The repaired turns: conv_id, place and step (their order), role, text, and edit (K, R or I)."""
        ids = self.edits.schema["conv_id"].dataType.simpleString()
        pieces = materialize(self.edits.select("conv_id", "letters").mapInArrow(
            _pieces(self.segment), f"conv_id {ids}, part long, edits array<string>"), "pieces")
        pieces = pieces.withColumnsRenamed({"conv_id": "_conv_id", "part": "_part"})
        placed = self.turns.select("conv_id", "turn", "role", "digest", "place").join(pieces, [
            F.col("conv_id").eqNullSafe(F.col("_conv_id")), F.expr(f"(place - 1) div {self.segment}") == F.col("_part")])
        edit = F.element_at("edits", (F.expr(f"(place - 1) % {self.segment}") + 1).cast("int"))
        placed = placed.select("conv_id", "turn", "role", "digest", "place", edit.alias("edit")).filter("edit <> 'D'")
        placed = materialize(placed.withColumnsRenamed({c: f"_{c}" for c in ("conv_id", "turn", "role", "digest")}), "placed")
        texts = self.rows.select("conv_id", "turn", "role", "text", F.sha2(F.col("text"), 256).alias("digest"))
        texts = texts.dropDuplicates(["conv_id", "turn", "role", "digest"])
        both = placed.join(texts, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in ("conv_id", "turn", "role", "digest")])
        steps = F.expr("""filter(transform(split(edit, ''), (e, i) -> struct(i as step,
            case when e in ('u', 'U') then 'user' when e in ('a', 'A') then 'assistant' else role end as role,
            if(e in ('u', 'a'), '', text) as text,
            case when e in ('u', 'a') then 'I' when e in ('U', 'A') then 'R' else e end as edit)), x -> x.edit in ('K', 'R', 'I'))""")
        return both.select("conv_id", "place", F.explode(steps).alias("x")).select("conv_id", "place", "x.*")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``turns`` (conv_id, place, step, role,
    text): SHA-256 of their ``role:text`` lines. A stream of each conversation in order."""
    ids = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        last, state = None, None
        for batch in batches:
            keys, found = batch.column(0).to_pylist(), []
            for key, line in zip(keys, batch.column(1), strict=True):
                if state is None or key != last:
                    if state is not None:
                        found.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.as_py().encode())
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in found], batch.schema.types[0]), pa.array([h for _, h in found])],
                    ["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], batch.schema.types[0]), pa.array([state.hexdigest()])],
                                             ["conv_id", "repaired_sha256"])

    lines = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step").select(
        "conv_id", F.concat_ws(":", "role", "text").alias("line"))
    return lines.mapInArrow(run, f"conv_id {ids}, repaired_sha256 string")


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: what was wrong with its ``rows``,
    the edits, and the digest of what they give."""
    fix = Repair(rows)
    zero = F.lit(0).cast("long")
    summary = fix.summary().withColumnRenamed("conv_id", "_id")
    hashes = digests(fix.repaired()).withColumnRenamed("conv_id", "_key")
    return (conversations.select("conv_id").distinct()
            .join(summary, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
            .join(hashes, F.col("conv_id").eqNullSafe(F.col("_key")), "left")
            .select("conv_id", *(F.coalesce(c, zero).alias(c) for c in (
                "gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                F.coalesce("audit", F.lit("")).alias("audit"),
                F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")))
