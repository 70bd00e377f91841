"""Harmonic packing of tokenized documents into sequences of bounded length.

A document's ids end with a separator. Whole sequences are cut off its front;
the rest goes by reciprocal classes: a piece of length l belongs to class
j = capacity // l, and a bin of class j takes exactly j pieces. Where j pieces
of length l would leave more than 1 / 32 of a bin unused, the largest
reciprocal length below l, capacity // (j + 1), is cut off as a piece that
fills its class's bins, and what remains is classed anew.

Workers fill bins independently: each task keeps a counter per class and needs
no other task. Pieces of bins that a task could not fill (fewer than j per
class) meet by class in groups of ``GROUP`` tasks, what is left then in groups
of such groups, until one group is left: no step gathers more than GROUP * j
pieces of a class, however many tasks there are. The bounded remainder (fewer
than j pieces for each class, at most about 4,600) is packed first-fit
decreasing.

Ids are those of the tokenizers file as it stands, without special tokens
around the text. Texts whose characters all lie below U+0250 and which hold no
added token of the file (such as <|endoftext|>, one id there) get the same ids
from the tiktoken ranks of the same vocabulary, several times faster.

Defined cases: null and empty texts are one separator; repeated rows and null
ids pack one by one; a document longer than a sequence spans several.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.store import materialize

CAPACITY = 1024
SEPARATOR = 0
GROUP = 8  # tasks, or groups of them, whose unfilled bins meet
PLAIN = re.compile("[ɐ-\U0010ffff]")

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "class int, task long, nth long, offset long")


class Encoder:
    """Ids of texts under the byte-level BPE vocabulary."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(json_path)
        added = [re.escape(t.content) for t in self.full.get_added_tokens_decoder().values()]
        self.slow = re.compile("|".join([PLAIN.pattern, *added]))

    def __call__(self, text: str) -> list[int]:
        if self.slow.search(text):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of ``length`` ids, in order."""
    whole, rest = divmod(length, capacity)
    pieces = [capacity] * whole
    while rest:
        j = capacity // rest
        if 32 * (capacity - j * rest) <= capacity:
            pieces.append(rest)
            break
        pieces.append(capacity // (j + 1))
        rest -= pieces[-1]
    return pieces


def _pieces(capacity: int, files: tuple[str, str, str] | None):
    def run(batches):
        if files is None:
            import public_tokenizers as public

            encode = Encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
        else:
            encode = Encoder(*files)
        task, counters = TaskContext.get().partitionId(), {}
        names = [f.split()[0] for f in PIECES.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.int64()] * 3
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(SEPARATOR)
                raw, start = np.asarray(ids, "<u4").tobytes(), 0
                for n in cut(len(ids), capacity):
                    c = capacity // n
                    nth, offset = counters.get(c, (0, 0))
                    out.append((doc_id, start, n, zlib.crc32(raw[4 * start: 4 * (start + n)]), len(ids), c, task,
                                nth, offset))
                    counters[c] = nth + 1, 0 if (nth + 1) % c == 0 else offset + n
                    start += n
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names)
    return run


def _first_fit(capacity: int):
    """Pack one bounded set of pieces: longest first, each into the first bin with room."""
    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"], r["start"], r["ids_crc32"]))
        used: list[int] = []
        for r in rows:
            at = next((i for i, u in enumerate(used) if u + r["length"] <= capacity), len(used))
            if at == len(used):
                used.append(0)
            r["bin"], r["offset"] = at, used[at]
            used[at] += r["length"]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "offset"]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.int64()) for n in names], names)
    return run


def _regrouped(pieces: DataFrame, order: list[str]) -> DataFrame:
    """Pieces with the group of their ``owner`` as the new one, and bins of a
    ``class`` of them in it; ``full`` tells whether the bin has all its pieces."""
    by = Window.partitionBy("class", "owner")
    numbered = (pieces.withColumn("owner", F.floor(F.col("owner") / GROUP))
                .withColumn("nth", F.row_number().over(by.orderBy(*order)) - 1)
                .withColumn("bin", F.floor(F.col("nth") / F.col("class"))))
    before = Window.partitionBy("class", "owner", "bin").orderBy("nth")
    return (numbered.withColumn("full", (F.col("bin") + 1) * F.col("class") <= F.count("*").over(by))
            .withColumn("offset", F.sum("length").over(before) - F.col("length")))


def pack(documents: DataFrame, capacity: int = CAPACITY,
         files: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. ``files``: the tokenizer's json, its ranks and its
    split pattern (default: the installed public 50k byte-level BPE)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(docs.mapInArrow(_pieces(capacity, files), PIECES), "pieces")
    sizes = pieces.groupBy("task", "class").agg(F.count("*").alias("n"))
    data = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    key = ["task", "class"]
    order = ["doc_id", "start", "ids_crc32", "task", "piece"]

    # Stage 1: bins of one task. Counts per task and class are joined, not windowed.
    one = (pieces.join(sizes, key).withColumn("bin", F.floor(F.col("nth") / F.col("class")))
           .withColumn("full", (F.col("bin") + 1) * F.col("class") <= F.col("n")).drop("n"))
    rest = materialize(one.filter("not full").drop("bin", "full", "offset")
                       .withColumnsRenamed({"nth": "piece"}).withColumn("owner", F.col("task")), "unfilled")

    def placed(df: DataFrame, stage: int) -> DataFrame:
        return df.select(*data, "class", "owner", "bin", F.lit(stage).alias("stage"), "offset")

    parts = placed(one.filter("full").withColumn("owner", F.col("task")), 1)
    # Further stages: unfilled bins of a group of owners, as long as there are several.
    stage, last = 1, rest.agg(F.coalesce(F.max("owner"), F.lit(0))).first()[0]
    while last:
        stage, last = stage + 1, last // GROUP
        rest = materialize(_regrouped(rest, order), "regrouped")
        parts = parts.unionByName(placed(rest.filter("full"), stage))
        rest = rest.filter("not full")
    tail = (rest.select(*data).repartition(1)
            .mapInArrow(_first_fit(capacity), "doc_id long, start long, length long, ids_crc32 long, "
                        "doc_tokens long, bin long, offset long"))
    parts = parts.unionByName(tail.withColumns({
        "class": F.lit(0), "owner": F.lit(0).cast("long"), "stage": F.lit(stage + 1)}))
    # An id names stage, class, owner and bin; stage: 4 bits, class: 11, owner: 20 (a million tasks), bin: 28
    sequence = (F.shiftleft(F.col("stage").cast("long"), 59) + F.shiftleft(F.col("class").cast("long"), 48)
                + F.shiftleft(F.col("owner"), 28) + F.col("bin"))
    return parts.select(*data, sequence.alias("sequence_id"), "offset")
