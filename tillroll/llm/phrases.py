"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed into phrases, level by level, until one symbol
is left. On each level, runs of one repeated symbol become one symbol; then
deterministic coin tossing gives every symbol a label from the lowest bit in
which it differs from its predecessor, three more rounds on the labels bring
the alphabet below six, and every local maximum of the labels starts a new
phrase. A phrase is named by a 64-bit hash of the symbols in it. Where a phrase
starts depends on a bounded neighbourhood only, so equal substrings get equal
phrase names in their interior, at any offset and in any document.

The fingerprint is the name of the whole text (its root, two 64-bit names under
different seeds) and two parts: the ``size`` smallest hashes among its phrase
names of level ``level`` and above, where a phrase spans about eighteen bytes or
more (no hashes if there are fewer than ``FEW`` phrases on that level), and the
``size`` smallest among its bytes and the names of all levels. Two fingerprints
estimate the share of phrases in common, by the first parts if both have one and
by the second parts if either text is too short: with J the Jaccard estimate from
the smallest ``size`` hashes of both, the likeness is 2J / (1 + J); 1 for equal roots.

``fingerprint_edits`` pairs each text with the next one by descending doc_id.
The ids alone are scanned first to lay out ranges of ids; the texts are
shuffled once by range, the first text of each range goes to the range before
it as well, and every range is then read in order as a stream.

Defined cases: null text is empty; the empty text has the root of no symbols
and no hashes, and is like another text only if both are empty. Rows with equal
doc_id are ordered by text; a null id comes last. A single row's next document
is itself.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64
SIZE = 128
LEVEL = 2
FEW = 8
SLICE = 125_000  # bytes parsed at once: their arrays stay in a core's cache
MOST_SLOTS = 100_000  # bounds what the driver lays out; beyond it slots grow


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    """Lengths of the ranges that begin at ``starts``; the last ends at ``n``."""
    out = np.empty_like(starts)
    np.subtract(starts[1:], starts[:-1], out=out[:-1])
    out[-1:] = n - starts[-1:]
    return out


def _toss(now: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Twice the index of the lowest bit in which a symbol differs from the one
    before it, plus that bit of the symbol."""
    d = now ^ before
    low = d & (~d + now.dtype.type(1))
    at = np.bitwise_count(low - now.dtype.type(1)).astype(now.dtype)
    return ((at << now.dtype.type(1)) | ((now & low) != 0)).astype(np.uint8)


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six in which neighbours inside a text differ."""
    for _ in range(4):  # alphabets: 2^64 or 2^32, 128, 14, 8, 6
        before = np.empty_like(x)
        before[1:] = x[:-1]
        before[first] = ~x[first]
        x = _toss(x, before)
    return x


def _names(x: np.ndarray, starts: np.ndarray, seed: U) -> np.ndarray:
    """A name for each block of ``x`` that begins at ``starts``."""
    lengths = _lengths(starts, len(x))
    place = np.arange(len(x)) - np.repeat(starts, lengths)
    places = _mix(np.arange(lengths.max(), dtype=U) + seed)
    terms = _mix(x.astype(U) + places[place])
    return _mix(np.add.reduceat(terms, starts) + lengths.astype(U))


def _collapse(x: np.ndarray, first: np.ndarray, seed: U):
    """Runs of one symbol become one symbol, named with its length (bytes: the
    length above the byte)."""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[first] = True
    starts = np.flatnonzero(new)
    lengths = _lengths(starts, len(x))
    symbols, at = x[starts], np.searchsorted(starts, first)
    if x.dtype == np.uint8:
        return symbols | (lengths.astype(np.uint32) << np.uint32(8)), at
    long = np.flatnonzero(lengths > 1)
    symbols[long] = _mix(_mix(symbols[long] + seed) + lengths[long].astype(U))
    return symbols, at


def parse_levels(texts: list[bytes], seed: int = 1):
    """Yield per level (names, index of each text's first name); all texts are
    non-empty. The last level has one name per text."""
    x = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    first = np.cumsum(lengths) - lengths
    level = 0
    done = False
    while not done:
        s = _mix(np.array([seed * 1009 + level], U))[0]
        x, first = _collapse(x, first, s)
        label = _labels(x, first).astype(np.int8)
        left, right = np.empty_like(label), np.empty_like(label)
        left[1:], right[:-1] = label[:-1], label[1:]
        last = np.append(first[1:], len(x)) - 1
        left[first], right[last] = 99, 99
        cut = (label > left) & (label > right)
        cut[first] = True
        starts = np.flatnonzero(cut)
        x = _names(x, starts, s)
        first = np.searchsorted(starts, first)
        level += 1
        done = len(x) == len(texts)
        yield x, first


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return keys[new]


def _smallest(names: list[np.ndarray], owner: list[np.ndarray], n: int, size: int) -> list[np.ndarray]:
    """Per text the smallest of its hashes, ascending."""
    name, of = np.concatenate(names), np.concatenate(owner)
    # Hashes are spread evenly: below twice the share asked for there are nearly always enough.
    count = np.bincount(of, minlength=n)
    bound = (np.minimum(2 * size / np.maximum(count, 1), 1) * 2.0 ** 32).astype(U)
    low = name < bound[of]
    key = _distinct((of[low].astype(U) << U(32)) | name[low])
    few = (np.bincount((key >> U(32)).astype(np.int64), minlength=n) < size) & (count > 2 * size)
    if few.any():  # texts of repeated names: from all of them
        rest = few[of] & ~low
        key = _distinct(np.concatenate([key, (of[rest].astype(U) << U(32)) | name[rest]]))
    begin = np.searchsorted((key >> U(32)).astype(np.int64), np.arange(n + 1))
    low = (key & U(0xFFFFFFFF)).astype("<u4")
    return [low[i: min(j, i + size)] for i, j in zip(begin[:-1], begin[1:], strict=True)]


def sketches(texts: list[bytes], size: int = SIZE, level: int = LEVEL) -> list[bytes]:
    """Per text: 16 bytes of root names; if it is not empty, little-endian 32-bit
    numbers: how many hashes the coarse part has, that part, the fine part."""
    out: list[bytes] = [b"\0" * 16] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    body = [texts[i] for i in full]
    levels = list(parse_levels(body))
    raw = np.frombuffer(b"".join(body), np.uint8)
    sizes = np.array([len(t) for t in body])
    depth = np.zeros(len(body), int)  # levels until a text is one symbol
    short = np.ones(len(body), bool)  # too few phrases on the chosen level: no coarse part
    for k, (x, first) in enumerate(levels):
        count = _lengths(first, len(x))
        depth[count > 1] = k + 1
        if k == level:
            short = count < FEW
    met = np.zeros(len(body) << 8, bool)
    met[(np.repeat(np.arange(len(body)), sizes) << 8) | raw] = True
    cells = np.flatnonzero(met)
    names, owner = [_mix((cells & 255).astype(U)) >> U(32)], [cells >> 8]
    coarse, above = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for k, (x, first) in enumerate(levels):
        count = _lengths(first, len(x))
        of = np.repeat(np.arange(len(body)), count)
        use = k <= depth[of]
        names.append(_mix(x[use] + U(k)) >> U(32))
        owner.append(of[use])
        if k >= level:
            long = ~short[owner[-1]]
            coarse.append(names[-1][long])
            above.append(owner[-1][long])
    fine = _smallest(names, owner, len(body), size)
    coarse = _smallest(coarse, above, len(body), size)
    root = np.zeros(len(body), U)
    for k, (x, first) in enumerate(levels):
        root[depth == k] = x[first[depth == k]]
    other = _mix(root ^ _mix(sizes.astype(U) + U(77)))
    for j, i in enumerate(full):
        out[i] = (root[j].tobytes() + other[j].tobytes()
                  + np.array([len(coarse[j])], "<u4").tobytes() + coarse[j].tobytes() + fine[j].tobytes())
    return out


def likeness(a: bytes, b: bytes, size: int = SIZE) -> float:
    """Estimated share of phrases that two sketches have in common."""
    if a[:16] == b[:16]:
        return 1.0
    x, y = np.frombuffer(a, "<u4", offset=16), np.frombuffer(b, "<u4", offset=16)
    if not len(x) or not len(y):
        return 0.0
    m, n = 1 + int(x[0]), 1 + int(y[0])
    x, y = (x[1:m], y[1:n]) if m > 1 and n > 1 else (x[m:], y[n:])
    every = np.sort(np.concatenate((x, y)))  # a hash of both stands twice
    again = every[1:] == every[:-1]
    union = np.flatnonzero(np.append(True, ~again))[:size]
    j = np.append(again, False)[union].mean()
    return float(2 * j / (1 + j))


def _text(sketch: bytes) -> str:
    return base64.b64encode(sketch).decode()


def fingerprints(documents: DataFrame, column: str = "text") -> DataFrame:
    """``documents`` with a string column ``fingerprint`` (base64 of the sketch)."""
    schema = T.StructType([*documents.schema.fields, T.StructField("fingerprint", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column(batch.schema.get_field_index(column))]
            prints = [_text(s) for s in _sketched(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())],
                                             [*batch.schema.names, "fingerprint"])
    return documents.mapInArrow(run, schema)


def _sketched(texts: list[bytes]) -> list[bytes]:
    return [s for i, j in _slices(texts) for s in sketches(texts[i:j])]


def _slices(texts: list, limit: int = SLICE):
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def _edits(batches):
    """Rows (slot, lead, doc_id, text) in order; per slot the last row is the
    lead of the next slot and serves only as a next document."""
    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def pairs():
        before = None
        for slot, lead, doc_id, text in rows():
            if before is not None and before[0] == slot:
                yield before[1], before[2], text
            before = None if lead else (slot, doc_id, text)

    def emit(chunk):
        own = [t.encode() for _, t, _ in chunk]
        edited = []
        for _, t, after in chunk:
            half = len(t) // 2
            edited.append((t[: len(t) - half] + after[:half]).encode())
        # The next document's sketch is the following pair's own, but for the last one.
        follows = _sketched([*own, chunk[-1][2].encode()])
        marks, follows = follows[:-1], follows[1:]
        changed = _sketched(edited)
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _, _ in chunk], pa.int64()), pa.array([len(t) for _, t, _ in chunk], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            pa.array([_text(m) for m in marks]), pa.array([_text(m) for m in changed]),
            pa.array([likeness(a, b) for a, b in zip(marks, changed, strict=True)], pa.float64()),
            pa.array([1.0 if t == n else likeness(a, b) for (_, t, n), a, b in
                      zip(chunk, marks, follows, strict=True)], pa.float64()),
        ], [f.split()[0] for f in EDITED.split(", ")])

    chunk, size = [], 0
    for pair in pairs():
        if chunk and (size > 1_000_000 or chunk[-1][2] != pair[1]):
            yield emit(chunk)
            chunk, size = [], 0
        chunk.append(pair)
        size += len(pair[1])
    if chunk:
        yield emit(chunk)


def fingerprint_edits(documents: DataFrame, rows_per_slot: int = 4096) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of its
    code points replaced by the first as many of the next document, by
    descending doc_id (after the last document: the first)."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.coalesce("text", F.lit("")).alias("text"))
    # Slots: ranges of ids of about equal counts, laid out from the ids alone.
    # Slot numbers ascend as ids descend; null ids come last.
    n_slots = max(1, min(MOST_SLOTS, -(-docs.count() // rows_per_slot)))
    cuts = np.array(sorted({c for c in docs.filter("doc_id is not null").agg(F.percentile_approx(
        "doc_id", [i / n_slots for i in range(1, n_slots)], 10 * n_slots)).first()[0] or []})
        if n_slots > 1 else [], np.int64)

    @F.arrow_udf("int")
    def slot_of(ids: pa.Array) -> pa.Array:
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        slot = len(cuts) - np.searchsorted(cuts, known, side="right")
        slot[ids.is_null().to_numpy(zero_copy_only=False)] = len(cuts) + 1
        return pa.array(slot, pa.int32())

    leads = sorted((r["slot"], r["lead"]) for r in  # a row per slot
                   docs.select("doc_id", slot_of("doc_id").alias("slot"))
                   .groupBy("slot").agg(F.max("doc_id").alias("lead")).collect())
    before = [(lead, leads[i - 1][0]) for i, (_, lead) in enumerate(leads)]
    # Of rows that share a slot's largest id, the one whose text sorts first leads.
    heads = (docs.join(F.broadcast(spark.createDataFrame(before, "lead_id long, slot int")),
                       F.col("doc_id").eqNullSafe(F.col("lead_id")))
             .groupBy("slot").agg(F.min("text").alias("text"))
             .select("slot", F.lit(True).alias("lead"), F.lit(None).cast("long").alias("doc_id"), "text"))
    rows = docs.select(slot_of("doc_id").alias("slot"), F.lit(False).alias("lead"), "doc_id", "text").unionByName(heads)
    ordered = rows.repartition("slot").sortWithinPartitions(
        "slot", "lead", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_edits, EDITED)
