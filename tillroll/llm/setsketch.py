"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct shingles of ``width`` words. Register i of
a set keeps floor(1 - log_b(h)) of the smallest h among its elements' i-th
hashes, which are exponential variates: exponentially spaced, truncated to
[0, limit], mergeable by maximum. Two sets agree in a register with about
their Jaccard similarity, so bands of registers find candidates; the
similarity of a candidate pair is estimated jointly from the registers that
are larger, smaller and equal, by maximum likelihood with the known set sizes;
pairs that could reach the threshold are verified on their full sets.

Equal sets are one class from the start (128-bit set hash), so exact copies
cost one row. Classes that share a band bucket with another class are written
once with their registers and full sets. Then three rounds per bucket:
(1) every class against the bucket's smallest class, (2) against a class drawn
as leader, as long as leaders find links, (3) every pair that is still in
different components. Tables joined on a bucket or a root are written before, as
adaptive execution splits a hot key only between two scans. Pairs of one component need no test, so a bucket of n
copies costs about n pairs; nothing is capped. A table that a join asks for few of
its rows (texts, sets, buckets) is sifted by a bitmap of the keys before its shuffle. In the third round the pairs of
small buckets are joined; a large bucket is cut into blocks of about ``block``
classes by a hash, its blocks meet, and each pair is compared in the first
bucket that both share. Components come from alternating hook-and-shorten joins over the links.

With ``bands`` = 40 of 5 registers, two sets of similarity 0.8 share no bucket
with probability 1.3e-7; the likelihood test drops a pair only if 0.8 is less
likely than the best estimate by a factor of e^18.

Defined cases: null and empty texts have no set and link with nothing; a null
doc_id is never a component's id unless no other is there (``kept`` is then
true); rows that repeat a doc_id are documents of their own with that id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.components import components
from tillroll.llm.store import materialize, sift
from tillroll.llm.text import WORD, byte_groups, text_bytes

U = np.uint64


@dataclass(frozen=True)
class SketchParams:
    width: int = 5
    threshold_pct: int = 80
    bands: int = 40
    rows: int = 5
    base: float = 1.02
    limit: int = 4000
    seed: int = 11
    slack: float = 18.0
    block: int = 256

    @property
    def registers(self) -> int:
        return self.bands * self.rows


class _Ids(dict):
    """64-bit ids of words, remembered for a bounded number of words."""

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def shingle_sets(texts: list[bytes], width: int, ids: _Ids) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes; fewer words than ``width``: the
    whole sequence as one; no words: empty."""
    sets = []
    for text in texts:
        words = text.lower().split()
        if not words:
            sets.append(np.zeros(0, U))
            continue
        w = np.fromiter(map(ids.__getitem__, words), U, len(words))
        n = min(width, len(w))
        h = np.full(len(w) - n + 1, n, U)
        for i in range(n):
            h = _mix(h * U(0x9E3779B97F4A7C15) + w[i: len(w) - n + 1 + i])
        sets.append(np.unique(h))
    return sets


def registers(sets: list[np.ndarray], p: SketchParams) -> np.ndarray:
    """A row of registers per non-empty set."""
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), p.registers), np.uint16)
    x = np.concatenate(sets)
    starts = np.cumsum(sizes) - sizes
    salt = _mix(_mix(np.arange(1, p.registers + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(p.seed))) | U(1)
    for i in range(p.registers):
        y = x * salt[i]
        y ^= y >> U(29)
        y *= U(0xBF58476D1CE4E5B9)
        least = np.minimum.reduceat(y ^ (y >> U(32)), starts)
        h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 64)
        out[:, i] = np.clip(np.floor(1.0 - np.log(h) / np.log(p.base)), 0, p.limit)
    return out


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, p: SketchParams):
    """Per pair of register rows: the joint maximum-likelihood estimate of the
    Jaccard similarity, and whether the threshold is within the slack of it."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(u / v, v / u)
    floor = p.threshold_pct / 100
    best, at = np.full(len(a), -np.inf), np.zeros(len(a))
    target = np.full(len(a), -np.inf)
    lose = lambda x: -np.log1p(-np.clip(x, 0, 1) * (p.base - 1) / p.base) / np.log(p.base)
    for step in np.linspace(0, 1, 51):
        j = step * most
        more, less = lose(u - v * j), lose(v - u * j)
        ll = (up * np.log(np.maximum(more, 1e-12)) + down * np.log(np.maximum(less, 1e-12))
              + same * np.log(np.maximum(1 - more - less, 1e-12)))
        better = ll > best
        best, at = np.where(better, ll, best), np.where(better, j, at)
        target = np.where((j >= floor - 0.02) & (ll > target), ll, target)
    return at, target >= best - p.slack


SIGNED = "key_a long, key_b long, doc_id long, n_shingles long, set_hash binary, sketch binary"


def _sign(p: SketchParams):
    """(key_a, key_b, doc_id, text) -> SIGNED."""
    def run(batches):
        ids = _Ids()
        for batch in batches:
            column = batch.column(3)
            for i, j in byte_groups(column, 1_000_000):
                sets = shingle_sets([x.as_py() for x in column[i:j]], p.width, ids)
                hashes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                one = {h: s for h, s in zip(hashes, sets, strict=True) if h}  # equal sets: sketched once
                rows = dict(zip(one, registers(list(one.values()), p), strict=True)) if one else {}
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c)[i:j] for c in range(3)]
                    + [pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()),
                       pa.array([rows[h].tobytes() if h else None for h in hashes], pa.binary())],
                    [f.split()[0] for f in SIGNED.split(", ")])
    return run


def _full(p: SketchParams):
    """(set_hash, text) -> (set_hash, members): the full sorted set."""
    def run(batches):
        ids = _Ids()
        for batch in batches:
            column = batch.column(1)
            for i, j in byte_groups(column, 1_000_000):
                sets = shingle_sets([x.as_py() for x in column[i:j]], p.width, ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["set_hash", "members"])
    return run


def _estimate(p: SketchParams):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                    for c in ("sketch_a", "sketch_b"))
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            _, keep = likely(a, b, n_a, n_b, p)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def _verify(p: SketchParams):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
                s, t = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= p.threshold_pct * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _links(pairs: DataFrame, rows: int, classes: DataFrame, sets: DataFrame, p: SketchParams) -> DataFrame:
    """Those of the ``rows`` pairs (a, b) of classes that are similar enough."""
    def side(df, name, *columns):
        return df.select(F.col("set_hash").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    near = (pairs.join(side(classes, "a", "n", "sketch"), "a").join(side(classes, "b", "n", "sketch"), "b")
            .filter(100 * low >= p.threshold_pct * high)  # else even nested sets fall short
            .mapInArrow(_estimate(p), "a binary, b binary"))
    near = materialize(near, "near", rows, per_task=20_000)  # a pair brings two sketches
    ends = near.select(F.explode(F.array("a", "b")).alias("set_hash")).distinct()
    sets = sift(sets, "set_hash", ends, 2 * near.count())
    return (near.join(side(sets, "a", "members"), "a").join(side(sets, "b", "members"), "b")
            .mapInArrow(_verify(p), "a binary, b binary"))


def text_keyed(documents: DataFrame) -> DataFrame:
    """``documents`` with a 128-bit key over doc_id and text, the same in every scan."""
    return documents.withColumns({"key_a": F.xxhash64("doc_id", "text"),
                                  "key_b": F.xxhash64(F.lit(1), "doc_id", "text")})


def _ordered(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def sign(documents: DataFrame, p: SketchParams) -> DataFrame:
    """SIGNED rows of ``documents``, written to the shared folder."""
    docs = text_keyed(documents).select("key_a", "key_b", F.col("doc_id").cast("long").alias("doc_id"),
                                        text_bytes().alias("text"))
    return materialize(docs.mapInArrow(_sign(p), SIGNED), "signed")


def link_classes(documents: DataFrame, signed: DataFrame, p: SketchParams) -> DataFrame:
    """(set_hash, root) for every class with a verified link to another class."""
    own = signed.filter("set_hash is not null")
    width = 2 * p.rows
    bands = F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda b: F.xxhash64(
        b, F.substring(F.col("sketch"), b * width + 1, F.lit(width))))
    buckets = own.select(F.posexplode(bands).alias("band", "bucket"), "set_hash")
    one = F.xxhash64("set_hash")
    crowded = materialize(buckets.groupBy("bucket").agg(F.min(one).alias("x"), F.max(one).alias("y"))
                          .filter("x != y").select("bucket"), "crowded")
    members = materialize(sift(buckets, "bucket", crowded, crowded.count()).distinct().join(crowded, "bucket")
                          .select("bucket", "band", "set_hash"), "members")
    total = members.count()
    if not total:
        return members.select("set_hash", F.col("set_hash").alias("root"))
    candidates = materialize(members.select("set_hash").distinct(), "candidates", total)
    n_classes = candidates.count()
    known = materialize(sift(own, "set_hash", candidates, n_classes).groupBy("set_hash").agg(
        F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
        F.min(F.struct("key_a", "key_b")).alias("key")).join(candidates, "set_hash", "left_semi"), "classes")
    source = known.select("set_hash", "key.*")
    texts = (sift(text_keyed(documents).select("key_a", "key_b", text_bytes().alias("text")), "key_a", source, n_classes)
             .join(source, ["key_a", "key_b"]).dropDuplicates(["key_a", "key_b"]).select("set_hash", "text"))
    sets = materialize(texts.mapInArrow(_full(p), "set_hash binary, members binary"), "sets")

    tested = links = labels = None
    turn, last, n_links = 0, False, 0
    while True:
        placed = members.withColumn("comp", F.col("set_hash")) if labels is None else (
            members.join(labels, "set_hash", "left").withColumn("comp", F.coalesce("root", "set_hash")).drop("root"))
        open_pairs = total
        if labels is not None:  # pairs of a bucket that are not within its largest component
            counts = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
            open_pairs = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("n").alias("most")).agg(
                F.coalesce(F.sum(F.expr("n * (n - most)")), F.lit(0))).first()[0]
            if not open_pairs:
                return labels
        last = last or (labels is not None and open_pairs <= total)
        crowds = None
        if last:  # all pairs that may still join two components
            info = counts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n")).select(
                "bucket", F.col("main.comp").alias("main"), "n", F.expr("n * (n - main.n)").alias("open"))
            mixed = placed.join(materialize(info.filter("open > 0"), "open", total), "bucket")
            small, large = mixed.filter(F.col("open") <= 4 * p.block), mixed.filter(F.col("open") > 4 * p.block)
            pairs = small.filter("comp != main").select(
                "bucket", F.col("set_hash").alias("x"), F.col("comp").alias("comp_x")).join(
                small.select("bucket", "set_hash", "comp"), "bucket").filter("comp != comp_x")
            crowds = materialize(_crowd_links(large, known, sets, p), "crowds")
        else:
            lead = F.min(F.struct(F.xxhash64("set_hash", F.lit(turn)) if turn else F.lit(0), "set_hash", "comp"))
            leaders = placed.groupBy("bucket").agg(lead.alias("l")).select(
                "bucket", F.col("l.set_hash").alias("x"), F.col("l.comp").alias("comp_x"))
            pairs = placed.join(materialize(leaders, "leaders", total), "bucket").filter("comp != comp_x")
        pairs = pairs.select(*_ordered("x", "set_hash")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs", open_pairs if last else total)
        tests = pairs.count()
        found = materialize(_links(pairs, tests, known, sets, p), "links")
        if crowds is not None:
            found = found.unionByName(crowds)
        gained = found.count()
        n_links += gained
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        if gained or labels is None:
            labels = materialize(components(links, n_links).select(
                F.col("node").alias("set_hash"), "root"), "labels", 2 * n_links)
        if last:
            return labels
        last = 20 * gained < tests  # leaders find little more: settle the rest pair by pair
        turn += 1


def _crowd_links(rows: DataFrame, classes: DataFrame, sets: DataFrame, p: SketchParams) -> DataFrame:
    """Links between different components inside large buckets, block against
    block; ``rows``: bucket, band, set_hash, comp, main, n."""
    rows = materialize(rows, "crowd")
    keys, n = rows.select("set_hash").distinct(), rows.count()
    content = sift(classes.select("set_hash", "sketch"), "set_hash", keys, n).join(
        sift(sets, "set_hash", keys, n), "set_hash")
    full = (rows.join(content, "set_hash")
            .withColumn("block", F.pmod(F.xxhash64(F.lit(p.seed), "set_hash"), F.ceil(F.col("n") / p.block))))
    # A block's size is bounded by the hash; a large bucket has many blocks.
    entry = F.struct("set_hash", "comp", "sketch", "members")
    blocks = full.groupBy("bucket", "band", "block").agg(
        F.collect_list(entry).alias("every"),
        F.collect_list(F.when(F.col("comp") != F.col("main"), entry)).alias("others"))
    left = blocks.filter(F.size("others") > 0).select("bucket", "band", "others")
    return (left.join(blocks.select("bucket", "every"), "bucket").select("band", "others", "every")
            .mapInArrow(_compare(p), "a binary, b binary"))


def _common(set_x: list, set_y: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``i`` (ascending) with the sets ``j``."""
    out = np.zeros(len(i), np.int64)
    for k in np.unique(i):
        at, x = np.flatnonzero(i == k), set_x[k]
        sizes = np.array([len(set_y[m]) for m in j[at]])
        flat = np.concatenate([set_y[m] for m in j[at]])
        hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
        out[at] = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return out


def _compare(p: SketchParams):
    def side(entries):
        return ([e["set_hash"] for e in entries], [e["comp"] for e in entries],
                np.array([np.frombuffer(e["sketch"], np.uint16) for e in entries]),
                [np.frombuffer(e["members"], U) for e in entries])

    def run(batches):
        for batch in batches:
            a, b = [], []
            for band, others, every in zip(*batch.columns, strict=True):
                band = band.as_py()
                hash_x, comp_x, reg_x, set_x = side(others.as_py())
                hash_y, comp_y, reg_y, set_y = side(every.as_py())
                size_x, size_y = np.array([len(s) for s in set_x]), np.array([len(s) for s in set_y])
                code = {c: i for i, c in enumerate(dict.fromkeys(comp_x + comp_y))}
                low = np.minimum(size_x[:, None], size_y[None])
                use = (np.array([code[c] for c in comp_x])[:, None] != np.array([code[c] for c in comp_y])[None]) & (
                    100 * low >= p.threshold_pct * np.maximum(size_x[:, None], size_y[None]))
                xs, ys = np.nonzero(use)
                for part in range(0, len(xs), 20_000):
                    i, j = xs[part: part + 20_000], ys[part: part + 20_000]
                    ra, rb = reg_x[i], reg_y[j]
                    # Each pair is tested in the first bucket that both share.
                    shared = (ra == rb).reshape(len(i), p.bands, p.rows).all(axis=2).argmax(axis=1) == band
                    i, j = i[shared], j[shared]
                    if not len(i):
                        continue
                    keep = likely(ra[shared], rb[shared], size_x[i], size_y[j], p)[1]
                    i, j = i[keep], j[keep]
                    both = _common(set_x, set_y, i, j)
                    near = 100 * both >= p.threshold_pct * (size_x[i] + size_y[j] - both)
                    for k, m in zip(i[near], j[near], strict=True):
                        first, second = sorted((hash_x[k], hash_y[m]))
                        a.append(first)
                        b.append(second)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
    return run


def near_duplicates(documents: DataFrame, params: SketchParams | None = None) -> DataFrame:
    """(key_a, key_b, doc_id, n_shingles, set_hash, component_id, kept) per row
    of ``documents``: component_id is the smallest doc_id of all documents that
    verified links reach, itself included."""
    p = params or SketchParams()
    signed = sign(documents, p)
    labels = link_classes(documents, signed, p)
    classes = signed.filter("set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("least"))
    rooted = (classes.join(labels, "set_hash", "left")
              .withColumn("root", F.coalesce("root", "set_hash")).withColumnRenamed("set_hash", "member"))
    groups = materialize(rooted.groupBy("root").agg(F.min("least").alias("component")), "components")
    component = rooted.join(groups, "root").select(F.col("member").alias("set_hash"), "component", "root")
    joined = signed.drop("sketch").join(component, "set_hash", "left")
    named = joined.withColumn("component_id", F.when(F.col("set_hash").isNull(), F.col("doc_id"))
                              .otherwise(F.col("component")))
    return named.select("key_a", "key_b", "doc_id", "n_shingles", "set_hash", "root", "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_per_group(documents: DataFrame, params: SketchParams | None = None) -> DataFrame:
    """The rows of ``documents`` that stay when each group of near-duplicates
    keeps its document of smallest doc_id (ties: smallest key; rows that repeat
    id and text: one). Documents without words all stay."""
    groups = near_duplicates(documents, params)
    stay = (groups.filter("set_hash is not null").groupBy("root")
            .agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), "key_a", "key_b")).alias("k"))
            .select("k.key_a", "k.key_b"))
    keyed = text_keyed(documents.select("doc_id", "text", F.struct("*").alias("_whole")))
    words = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    chosen = keyed.filter(words).join(stay, ["key_a", "key_b"], "left_semi").dropDuplicates(["key_a", "key_b"])
    return chosen.unionByName(keyed.filter(~words)).select("_whole.*")
