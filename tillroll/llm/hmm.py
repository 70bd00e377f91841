"""Hidden Markov language model trained by Baum-Welch over the whole corpus.

Tokens are the words of a text and one end mark. The model emits *symbols*: a
word with at least ``own_count`` training tokens is a symbol of its own at any
size of the corpus, every rarer or unknown word belongs to the class of its last
three bytes, and P(word | class) is the add-a-half estimate over the class's
training words. A text's probability is the exact scaled forward probability
of its symbols times P(word | class) of each word without an own symbol.

Emissions of words are a distributed table that grows with the vocabulary, in
blocks of about ``block_words`` words; the driver holds those of the classes and
the end mark only. Texts are cut into chunks of about ``chunk_tokens`` tokens, each
with its distinct words once and its tokens as places in that list. Spark jobs:
(1) chunks; (2) word counts (counts per chunk, then one shuffle by word), joined
back to the chunks' words, by which each chunk has one row of places for each block;
(3) for each step the blocks answer these rows with slices of emissions, the slices
meet their chunk's tokens, which gives expected counts per chunk and block, added up
by block into the next table; (4) one forward pass over all tokens by the same way. A block answers, and adds up,
at most about ``salt_chunks`` chunks in one group, whatever their number. Words'
emissions and a chunk's counts travel as 32-bit floats, all recursions and sums run in
doubles: scores are exact under emissions so rounded (1e-7 of a token's probability).

Baum-Welch is incremental: the training chunks lie in ``parts`` parts, each but the
second twice as large as the one before, a step replaces the expected counts of one part by
those under the present model, and the next model comes from the sum over all parts'
latest counts: early steps are cheap, one pass over all training tokens improves the
model ``parts`` times, and each token weighs once. Starting values are the symbols'
frequencies over all training tokens with a seeded perturbation.
Passes, each over all training tokens, go on until the model was improved ``steps`` times
(two passes where all parts hold chunks, more for a corpus of a few chunks) or the log
likelihood gains less than ``gain`` of its size, or for ``iterations`` passes if that is given.

Defined cases: null text is empty (one end mark); a null id belongs to the
training part (crc32 of '' is 0); repeated rows count and score one by one;
without training rows every probability is the uniform start.
"""

from __future__ import annotations

import functools
import gc
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.store import discard, materialize
from tillroll.llm.text import crc_mod, text_bytes

SEGMENT = 1024
LN10 = float(np.log(10.0))


@dataclass
class HmmParams:
    states: int = 6
    iterations: int | None = None
    steps: int = 10
    parts: int = 5
    gain: float = 1e-3
    own_count: int = 16
    chunk_tokens: int = 1 << 21
    block_words: int = 4096
    salt_chunks: int = 32
    classes: int = 1024
    prior_weight: float = 50.0
    seed: int = 7


@dataclass
class Hmm:
    """``start`` is the state before the first token, ``trans`` moves before
    every token, ``emit`` holds P(symbol | state) with a row per symbol."""

    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray
    top: np.ndarray = field(init=False)
    scaled: np.ndarray = field(init=False)

    def __post_init__(self):
        self.top = self.emit.max(axis=1)
        self.scaled = self.emit / self.top[:, None]


def suffix_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


class Segments:
    """Documents' codes cut into segments of SEGMENT steps, longest first, so
    that all segments advance together and those that ended drop off."""

    def __init__(self, docs: list[np.ndarray]):
        n = np.array([len(d) for d in docs])
        self.per_doc = -(-n // SEGMENT)
        flat = np.concatenate(docs).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.per_doc)[:-1]])
        doc = np.repeat(np.arange(len(docs)), self.per_doc)
        nth = np.arange(len(doc)) - self.first[doc]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])[doc] + nth * SEGMENT
        length = np.minimum(SEGMENT, n[doc] - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        self.place = np.empty_like(order)
        self.place[order] = np.arange(len(doc))
        begin, self.length = begin[order], length[order]
        self.active = [int((self.length > t).sum()) for t in range(SEGMENT)]
        padded = np.concatenate([flat, np.zeros(SEGMENT, np.int64)])
        self.obs = [padded[begin[:k] + t] for t, k in enumerate(self.active)]
        self.by_docs = np.argsort(-self.per_doc, kind="stable")
        self.several = np.flatnonzero(self.per_doc[doc][order] > 1)
        self.n_docs, self.flat, self.ends, self.padded, self.begin = len(docs), flat, np.cumsum(n), padded, begin

    def transfer(self, m: Hmm) -> np.ndarray:
        """The K x K product of the steps of each segment of the documents with several, up to scale."""
        k, s, moves = len(m.start), len(self.several), np.ascontiguousarray(m.trans.T)
        x = np.empty((k, k, s))
        now = np.broadcast_to(np.eye(k)[:, :, None], x.shape)
        length, begin = self.length[self.several], self.begin[self.several]
        for t in range(int(length[0]) if s else 0):
            a = int(np.searchsorted(-length, -t))
            x[:, :, a:now.shape[2]] = now[:, :, a:]
            now = moves @ now[:, :, :a]
            now *= m.scaled[self.padded[begin[:a] + t]].T
            if t % 16 == 15:
                now /= now.sum(axis=(0, 1))
        x[:, :, :now.shape[2]] = now
        return x.transpose(2, 0, 1)

    def rounds(self):
        """Per position of a segment in its document, for documents with several: the
        documents that have one, where the segments lie, and where their products."""
        counts = self.per_doc[self.by_docs]
        for j in range(int(counts[0])):
            docs = self.by_docs[: int((counts > max(j, 1)).sum())]
            at = self.place[self.first[docs] + j]
            yield docs, at, np.searchsorted(self.several, at)

    def enter(self, m: Hmm) -> tuple[np.ndarray, np.ndarray]:
        """The state distribution that enters each segment, and the products."""
        x = self.transfer(m)
        enter = np.broadcast_to(m.start, (len(self.length), len(m.start))).copy()
        v = np.broadcast_to(m.start, (self.n_docs, len(m.start))).copy()
        for docs, at, product in self.rounds():
            enter[at] = v[docs]
            out = np.einsum("dk,dkj->dj", v[docs], x[product])
            v[docs] = out / out.sum(axis=1, keepdims=True)
        return enter, x

    def forward(self, m: Hmm, enter: np.ndarray, keep: bool) -> tuple[list, list, np.ndarray, np.ndarray]:
        """Of each step, if ``keep``, the state distributions before it (a row per state) and its
        emissions over its scale; each segment's last distribution; the natural log likelihood per document."""
        moves, last = np.ascontiguousarray(m.trans.T), np.empty(enter.T.shape)
        now, ahead, steps, logs = np.ascontiguousarray(enter.T), [], [], np.zeros(len(enter))
        for a, o in zip(self.active, self.obs, strict=True):
            last[:, a:now.shape[1]] = now[:, a:]
            now = now[:, :a]
            if not a:
                break
            emit = np.ascontiguousarray(m.scaled[o].T)
            if keep:
                ahead.append(now)
            now = moves @ now
            now *= emit
            scale = now.sum(axis=0)
            now /= scale
            logs[:a] += np.log(scale)
            if keep:
                emit /= scale
                steps.append(emit)
        last[:, :now.shape[1]] = now
        tops = np.concatenate([[0.0], np.cumsum(np.log(m.top)[self.flat])])[self.ends]
        return ahead, steps, last, np.add.reduceat(logs[self.place], self.first) + np.diff(tops, prepend=0.0)


def log_likelihood(m: Hmm, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log of each document's probability, by the scaled forward recursion."""
    seg = Segments(docs)
    return seg.forward(m, seg.enter(m)[0], keep=False)[3]


def expected_counts(m: Hmm, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact posterior counts of start states, moves and emissions."""
    return _expected(m, docs)[:3]


def _expected(m: Hmm, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The expected counts and the log likelihood of ``docs``."""
    seg = Segments(docs)
    enter, x = seg.enter(m)
    ahead, steps, last, loglik = seg.forward(m, enter, keep=True)
    k = len(m.start)
    behind = np.ones(enter.shape)
    w = np.ones((seg.n_docs, k))
    for docs_j, at, product in reversed(list(seg.rounds())):
        behind[at] = w[docs_j]
        back = np.einsum("dkj,dj->dk", x[product], w[docs_j])
        w[docs_j] = back / back.sum(axis=1, keepdims=True)

    # Scaled so that the two sides' product sums to one at every step of a segment.
    behind = np.ascontiguousarray(behind.T)
    behind /= (last * behind).sum(axis=0)
    moves, gammas, symbols = np.zeros((k, k)), [], []
    for t in range(len(steps) - 1, -1, -1):
        a = seg.active[t]
        after = last[:, :a].copy()
        if t + 1 < len(steps):
            after[:, :ahead[t + 1].shape[1]] = ahead[t + 1]
        after *= behind[:, :a]
        gammas.append(after)
        symbols.append(seg.obs[t])
        tmp = steps[t] * behind[:, :a]
        moves += ahead[t] @ tmp.T
        behind[:, :a] = m.trans @ tmp
    start = m.start[:, None] * behind[:, seg.place[seg.first]]
    start = (start / start.sum(axis=0)).sum(axis=1)
    gamma, symbol = np.concatenate(gammas, axis=1), np.concatenate(symbols)
    emit = np.stack([np.bincount(symbol, weights=g, minlength=len(m.emit)) for g in gamma], axis=1)
    return start, m.trans * moves, emit, float(loglik.sum())


def _chunks(classes: int, limit: int, parts: int):
    """Rows (doc_id, held_out, text) to chunks, of training or held-out texts only.
    Every other training chunk is of the last part, every other one of the rest of the part before,
    and so on, counted from a task's own number; chunks of held-out texts have part -1."""
    def run(batches):
        task = TaskContext.get().partitionId()
        base, nth, dealt = task << 32, 0, task
        open_: dict = {}

        def emit(held):
            nonlocal nth, dealt
            ids, lens, codes, seen, _ = open_.pop(held)
            flat = np.concatenate(codes)
            nth += 1
            dealt += not held
            halvings = min(parts - 1, (dealt & -dealt).bit_length() - 1) if dealt else parts - 1
            words = list(seen)
            counts = np.bincount(flat, minlength=len(words) + 1)[1:]
            cls = [suffix_class(w, classes) for w in words]
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([base + nth], pa.int64()), "held_out": pa.array([held]),
                "part": pa.array([-1 if held else parts - 1 - halvings], pa.int32()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "lens": pa.array([np.array(lens, "<i8").tobytes()], pa.binary()),
                "codes": pa.array([flat.astype("<u2" if len(words) < 1 << 16 else "<u4").tobytes()], pa.binary()),
                "cls": pa.array([np.array([classes, *cls], "<u4").tobytes()], pa.binary()),
                "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(range(1, len(words) + 1), pa.int32()), pa.array(words, pa.binary()),
                     pa.array(counts, pa.int64()), pa.array(cls, pa.int32())], ["idx", "word", "times", "cls"]))})

        for batch in batches:
            for doc_id, held, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.lower().split()
                if held not in open_:
                    open_[held] = [[], [], [], {}, 0]
                part = open_[held]
                seen = part[3]
                code = np.zeros(len(words) + 1, np.int32)  # 0 is the end mark
                code[:-1] = [seen.setdefault(w, len(seen) + 1) for w in words]
                part[0].append(doc_id)
                part[1].append(len(code))
                part[2].append(code)
                part[4] += len(code)
                if part[4] >= limit:
                    yield emit(held)
        for held in list(open_):
            yield emit(held)
    return run


CHUNKS = ("chunk long, held_out boolean, part int, doc_ids array<long>, lens binary, codes binary, cls binary, "
          "words array<struct<idx:int,word:binary,times:long,cls:int>>")
SLICES = "chunk long, kind int, block int, salt int, idx binary, place binary, e binary, n binary"
COUNTED = "block int, salt int, place binary, v binary, sums array<double>"


@dataclass
class Shared:
    """What every task knows: starts, moves, and emissions of classes and, last, the end mark."""

    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray


def _doc_slices(lens: np.ndarray, limit: int = 400_000):
    """Slices of documents of about ``limit`` tokens."""
    start = size = 0
    for i, n in enumerate(lens.tolist()):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    yield start, len(lens)


def _by_chunk(batches):
    """Sorted rows to each chunk's slices of emissions, rarer words' counts and tokens."""
    slices, counts = [], None
    for batch in batches:
        kinds = batch.column("kind").to_pylist()
        for i, kind in enumerate(kinds):
            cell = lambda c: batch.column(c)[i].as_py()  # noqa: E731, B023
            if kind == 0:
                slices.append({c: cell(c) for c in ("block", "salt", "idx", "place", "e", "n")})
            elif kind == 1:
                known = batch.column("known")[i].values
                counts = [known.field(c).to_numpy(zero_copy_only=False) for c in (0, 1)]
            else:
                yield slices, counts, {c: cell(c) for c in ("chunk", "held_out", "doc_ids", "lens", "codes", "cls")}
                slices, counts = [], None


def _local(shared: Shared, slices: list, tokens: dict):
    """The model with rows for the classes, the end mark and the chunk's own words, slice by
    slice; the lengths of its documents; the place of each word of the chunk; the tokens."""
    place = np.frombuffer(tokens["cls"], "<u4").astype(np.int64)
    lens = np.frombuffer(tokens["lens"], "<i8")
    width = len(tokens["codes"]) // int(lens.sum())
    flat = np.frombuffer(tokens["codes"], f"<u{width}")
    emit, size = [shared.emit], len(shared.emit)
    for part in slices:
        idx = np.frombuffer(part["idx"], "<u4")
        place[idx] = size + np.arange(len(idx))
        emit.append(np.frombuffer(part["e"], "<f4").reshape(len(idx), -1))
        size += len(idx)
    return Hmm(shared.start, shared.trans, np.concatenate(emit)), lens, place, flat


def _docs(place: np.ndarray, flat: np.ndarray, lens: np.ndarray):
    """The symbols of the documents, in slices of about 400,000 tokens."""
    ends = np.cumsum(lens)
    for i, j in _doc_slices(lens):
        begin = ends[i] - lens[i]
        yield np.split(place[flat[begin:ends[j - 1]]], ends[i:j - 1] - begin)


def _expect(shared: Shared, salts: int):
    """Expected counts: per chunk and block those of its words; per task, as block -1, those of
    classes, starts, moves and, first value of the last row, the log likelihood."""
    k, dense = len(shared.start), len(shared.emit)

    def row(block, salt, place, v):
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([place], pa.binary()),
             pa.array([v.tobytes()], pa.binary()), pa.nulls(1, pa.list_(pa.float64()))],
            [c.split()[0] for c in COUNTED.split(", ")])

    def run(batches):
        few = np.zeros((dense + 1 + k + 1, k))
        for slices, _, tokens in _by_chunk(batches):
            model, lens, place, flat = _local(shared, slices, tokens)
            total = np.zeros(model.emit.shape)
            for docs in _docs(place, flat, lens):
                start, moves, part, loglik = _expected(model, docs)
                total += part
                few[dense] += start
                few[dense + 1: dense + 1 + k] += moves
                few[-1, 0] += loglik
            few[:dense] += total[:dense]
            at = dense
            for part in slices:
                n = len(part["idx"]) // 4
                yield row(part["block"], part["salt"], part["place"], total[at:at + n].astype("<f4"))
                at += n
        yield row(-1, TaskContext.get().partitionId() % salts, np.arange(len(few), dtype="<u4").tobytes(), few)
    return run


def _add(k: int):
    """The counts of a group of rows of one block, added up by place."""
    def run(table: pa.Table) -> pa.Table:
        places = [np.frombuffer(x.as_py(), "<u4") for x in table["place"]]
        total = np.zeros((max(int(x.max()) for x in places) + 1, k))
        for x, v in zip(places, table["v"], strict=True):  # a row names a place once
            v = v.as_py()  # numbers of 4 bytes from chunks, of 8 from tasks and sums
            total[x] += np.frombuffer(v, f"<f{len(v) // (len(x) * k)}").reshape(-1, k)
        return pa.table({
            "block": table["block"][:1], "salt": table["salt"][:1],
            "place": pa.array([np.arange(len(total), dtype="<u4").tobytes()], pa.binary()),
            "v": pa.array([total.tobytes()], pa.binary()),
            "sums": pa.array([total.sum(axis=0)], pa.list_(pa.float64()))})
    return run


def _packed(k: int):
    """Rows (block, words: place, n, starting value per state) to (block, n, v, sums)."""
    def run(batches):
        for batch in batches:
            for block, words in zip(batch.column(0), batch.column(1), strict=True):
                x = words.values.flatten()
                v = np.stack([c.to_numpy() for c in x[2:]], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()], pa.int32()), pa.array([x[1].to_numpy().astype("<i8").tobytes()], pa.binary()),
                     pa.array([v.tobytes()], pa.binary()), pa.array([v.sum(axis=0)], pa.list_(pa.float64()))],
                    ["block", "n", "v", "sums"])
    return run


def _slice(lean: float, norm: float, sums: np.ndarray, counts: bool):
    """What chunks ask of one block, with the emissions of the words they name: the block's
    values plus ``lean`` times the words' frequencies, over their ``sums``; and their ``counts``."""
    k = len(sums)

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        out: dict = {c.split()[0]: [] for c in SLICES.split(", ")}
        if len(asked):
            n = np.frombuffer(block["n"][0].as_py(), "<i8")
            e = np.repeat(lean * ((n + 0.5) / norm)[:, None], k, axis=1)
            v = np.frombuffer(block["v"][0].as_py() or b"").reshape(-1, k)  # words not met so far have no counts
            e[:len(v)] += v
            e /= sums
            for i in range(len(asked)):
                idx, place = (x.to_numpy().astype("<u4") for x in asked["at"][i].values.flatten())
                for c, v in (("kind", 0), ("idx", idx.tobytes()), ("place", place.tobytes()), ("e", e[place].astype("<f4").tobytes()), ("n", n[place].tobytes() if counts else None),
                             *((c, asked[c][i].as_py()) for c in ("chunk", "block", "salt"))):
                    out[c].append(v)
        return pa.table([pa.array(out[c], t) for c, t in zip(out, (
            pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
            names=list(out))
    return run


SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def _forward(shared: Shared, log_den: np.ndarray, n_docs: int, total: int, distinct: int):
    base_den = np.log10(total + 0.5 * (distinct + 1))

    def run(batches):
        for slices, rare, tokens in _by_chunk(batches):
            model, lens, place, flat = _local(shared, slices, tokens)
            logs = np.concatenate([log_likelihood(model, docs) for docs in _docs(place, flat, lens)]) / LN10
            begin = np.cumsum(lens) - lens
            count = np.zeros(len(place), np.int64)
            count[0] = n_docs  # place 0 is the end mark
            for part in slices:
                count[np.frombuffer(part["idx"], "<u4")] = np.frombuffer(part["n"], "<i8")
            if rare:
                count[rare[0]] = rare[1]
            log_c = np.log10(count + 0.5)
            in_class = place < len(log_den)
            inside = np.zeros(len(place))
            inside[in_class] = log_c[in_class] - log_den[place[in_class]]
            per_doc = lambda x: np.add.reduceat(x[flat], begin)  # noqa: E731, B023
            ids = tokens["doc_ids"]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([tokens["held_out"]] * len(ids), pa.bool_()),
                pa.array(lens, pa.int64()), pa.array(per_doc((count > 0).astype(np.int64)), pa.int64()),
                pa.array([total] * len(ids), pa.int64()), pa.array(per_doc(log_c) - lens * base_den),
                pa.array(logs + per_doc(inside))], [c.split()[0] for c in SCORED.split(", ")])
    return run


def hmm_scores(documents: DataFrame, params: HmmParams | None = None, held_mod: int = 5,
               held_rest: int = 1) -> DataFrame:
    """Score every text of ``documents`` (doc_id, text): columns doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score (add-a-half unigram)
    and score (log10 probability of the text under the trained model)."""
    p = params or HmmParams()
    spark, k = documents.sparkSession, p.states
    states = [f"s{z}" for z in range(k)]
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            (crc_mod("doc_id", held_mod) == held_rest).alias("held_out"),
                            text_bytes().alias("text"))
    chunks = materialize(docs.mapInArrow(_chunks(p.classes, p.chunk_tokens, p.parts), CHUNKS), "chunks", part="part")
    listed = chunks.select("chunk", "part", F.explode("words").alias("w")).select("chunk", "part", "w.*")
    counts = materialize(listed.filter("part >= 0").groupBy("word").agg(
        F.sum("times").alias("n"), F.first("cls").alias("cls")), "counts")
    has_own = F.col("n") >= p.own_count
    tables = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(
        F.when(~F.col("held_out"), F.size("doc_ids"))), F.lit(0)).alias("docs"), F.sort_array(F.collect_set(
            F.when(~F.col("held_out"), F.col("part")))).alias("parts")).first()
    size = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(has_own).alias("own"),
        F.coalesce(F.sum(F.when(has_own, F.col("n") + 0.5)), F.lit(0.0)).alias("own_n")).first()
    n_docs, total, distinct = tables["docs"], size["n"] + tables["docs"], size["v"] + (tables["docs"] > 0)
    class_n, class_v = np.zeros(p.classes), np.zeros(p.classes)
    for r in counts.filter(~has_own).groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[r["cls"]], class_v[r["cls"]] = r["n"], r["v"]  # a row per class
    log_den = np.log10(class_n + 0.5 * (class_v + 1))

    # Words with an emission of their own lie in blocks; a chunk asks a block for its words at once.
    blocks, salts = 1 + size["own"] // p.block_words, 1 + tables["chunks"] // p.salt_chunks
    block = F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int")
    numbered = counts.filter(has_own).select("word", "n", block.alias("block")).withColumn(
        "place", F.row_number().over(Window.partitionBy("block").orderBy("word")) - 1)
    vocab = materialize(numbered.unionByName(counts.filter(~has_own).select("word", "n"), allowMissingColumns=True), "vocab")
    # Rows of block -1 name a chunk's rarer training words with their counts in place of a place.
    entries = listed.select("chunk", "part", "idx", "word").join(vocab.hint("shuffle_hash"), "word").select(
        "chunk", "part", "idx", F.coalesce("block", F.lit(-1)).alias("block"), F.coalesce("place", "n").cast("int").alias("place"))
    rows = materialize(entries.groupBy("chunk", "part", "block").agg(
        F.collect_list(F.struct("idx", "place")).alias("at")).withColumn(
        "salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")), "asked", part="part")
    asked = rows.filter("block >= 0")
    rare = rows.filter("block < 0").select("chunk", "part", F.lit(1).alias("kind"), F.col("at").alias("known"))

    # Frequencies of all symbols, and the start: each times a seeded draw per state.
    unigram = np.append(class_n, n_docs) + 0.5
    norm = float(unigram.sum()) + size["own_n"]
    unigram /= norm
    few = unigram[:, None] * (np.random.default_rng(p.seed).gamma(1.0, 1.0, (len(unigram), k)) + 1e-3)
    draw = [-F.log((F.pmod(F.xxhash64("word", F.lit(p.seed), F.lit(z)), F.lit(1 << 31)) + 0.5) / (1 << 31)) + 1e-3
            for z in range(k)]
    start = [((F.col("n") + 0.5) / norm * d).alias(f"s{z}") for z, d in enumerate(draw)]
    first = materialize(vocab.filter("block is not null").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("place", "n", *start))).alias("words"))
        .mapInArrow(_packed(k), "block int, n binary, v binary, sums array<double>"), "start")

    def normal(few: np.ndarray, values: DataFrame, lean: float) -> tuple[np.ndarray, DataFrame, tuple]:
        """Emissions in proportion to ``few`` and ``values``, plus ``lean`` times the frequencies."""
        few = few + lean * unigram[:, None]
        sums = values.agg(*(F.coalesce(F.sum(F.col("sums")[z]), F.lit(0.0)) for z in range(k))).first()
        sums = few.sum(axis=0) + np.array(sums) + lean * size["own_n"] / norm
        return few / sums, values, (lean, norm, sums)

    def met(asked: DataFrame, values: DataFrame, scale: tuple, *others: DataFrame, counts: bool = False) -> DataFrame:
        """Each chunk's slices of emissions and, behind them, its rows of ``others``."""
        rows = asked.groupBy("block", "salt").cogroup(
            values.select("block", "n", "v", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
            .groupBy("block", "salt")).applyInArrow(_slice(*scale, counts), SLICES)
        for other in others:
            rows = rows.unionByName(other, allowMissingColumns=True)
        return rows.repartition("chunk").sortWithinPartitions("chunk", "kind")

    def added(rows: DataFrame) -> DataFrame:
        """Counts per block, by rounds that each bring at most ``salt_chunks`` chunks or sums into a group."""
        left = salts
        while True:
            rows = rows.groupBy("block", "salt").applyInArrow(_add(k), COUNTED)
            if left == 1:
                return rows
            left = 1 + left // p.salt_chunks if left > p.salt_chunks else 1
            rows = rows.withColumn("salt", F.pmod("salt", F.lit(left)))

    def free():
        gc.collect()
        spark._jvm.System.gc()  # shuffles that no table needs any more go

    free()
    trans = np.full((k, k), 0.1 / max(1, k - 1))
    np.fill_diagonal(trans, 0.9 if k > 1 else 1.0)
    few, table, scale = normal(few, first, 0.0)
    model = Shared(np.full(k, 1 / k), trans, few)
    tokens = chunks.select("chunk", F.lit(2).alias("kind"), "part", "held_out", "doc_ids", "lens", "codes", "cls")
    training = tokens.withColumn("doc_ids", F.lit(None).cast("array<long>")).filter("part >= 0")
    counted, dense, old, last, passes = {}, {}, [], None, 0
    most = -(-p.steps // max(1, len(tables["parts"]))) if p.iterations is None else p.iterations
    while n_docs and passes < most:
        loglik = 0.0
        for part in tables["parts"]:
            mine = F.col("part") == part
            spent = [*old, *([counted[part]] if part in counted else [])]
            counted[part] = materialize(added(met(asked.filter(mine), table, scale, training.filter(mine)).mapInArrow(
                _expect(model, salts), COUNTED)), "expected")
            dense[part] = np.frombuffer(counted[part].filter("block = -1").first()["v"]).reshape(-1, k)
            loglik += dense[part][-1, 0]
            few = sum(dense.values())
            start, moves = few[p.classes + 1], few[p.classes + 2: p.classes + 2 + k]
            values = functools.reduce(DataFrame.unionByName, counted.values()).filter("block >= 0")
            if len(counted) > 1:
                values = materialize(values.groupBy("block", "salt").applyInArrow(_add(k), COUNTED), "emissions")
            few, table, scale = normal(few[: p.classes + 1], first.select("block", "n").join(
                values.select("block", "v", "sums"), "block", "left"), p.prior_weight)
            model = Shared((start + 1) / (start + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), few)
            old = [] if len(counted) == 1 else [values]
            discard(*spent)
            free()
        passes += 1
        done = last is not None and loglik - last < p.gain * abs(last)
        last = loglik
        if done:
            break
    scored = []
    for part in [-1, *tables["parts"]]:
        mine = F.col("part") == part
        scored.append(materialize(met(asked.filter(mine), table, scale, rare.filter(mine), tokens.filter(mine), counts=True)
                                  .mapInArrow(_forward(model, log_den, int(n_docs), int(total), int(distinct)), SCORED), "scored"))
        free()
    return functools.reduce(DataFrame.unionByName, scored)
