"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled 1; unlabelled are all training
rows, labels ignored. A linear model over binned text statistics minimises the
non-negative unbiased risk

    pi E_P[l(+)] + max(0, E_U[l(-)] - pi E_P[l(-)])

with the logistic loss, by full-gradient steps; where the second term is
negative its gradient is reversed, so the negative risk stays non-negative. The
class prior pi is estimated from all labelled training rows (the share of 1s,
add-one); where labels hold positives only, by the lower quartile of the ratios of
unlabelled to positive mass over the statistics' usual bins.

Statistics come from the whole text alone: its byte classes, words, repeats and
lines. Fitting takes a bounded sample of training rows (``most_rows`` of each
kind, chosen by a hash of the id); the prior counts all labels, and every row
is scored. Scoring streams texts through Arrow with a model of a few kilobytes.

Defined cases: null and empty texts have statistics of zero and a score like
any other; labels that contradict each other for one id, or are null, are not
used; without training positives every score is the prior.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.text import text_bytes


@dataclass(frozen=True)
class QualityParams:
    most_rows: int = 12_000
    bins: int = 16
    steps: int = 300
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 5


# Byte classes: lower case, upper case, digits, blanks, line feeds, sentence
# marks, exclamation and question marks, quotes and brackets, other symbols,
# bytes beyond ASCII, control characters.
CLASSES = 11
_CLASS = np.full(256, 8)
for _k, _bytes in ((0, range(97, 123)), (1, range(65, 91)), (2, range(48, 58)), (3, b" \t\r\x0b\x0c"), (4, b"\n"),
                   (5, b".,;:"), (6, b"!?"), (7, b"\"'()[]{}-"), (9, range(128, 256)),
                   (10, [b for b in range(32) if b not in b"\t\n\r\x0b\x0c"] + [127])):
    _CLASS[list(_bytes)] = _k
_LINKED = re.compile(rb"https?:|www\.|@")
N_STATS = CLASSES + 15


def statistics(text: bytes) -> list[float]:
    """Numbers that describe a text; all zero for the empty text."""
    words = text.split()
    if not words:
        return [0.0] * N_STATS
    n = len(words)
    share = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256),
                        minlength=CLASSES) / len(text)
    seen = Counter(words)
    most = seen.most_common(1)[0][1]
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    longest = max(map(len, words))
    length = sum(map(len, words))
    marked = sum(not w.isalnum() for w in words if w.isascii())
    upper = sum(map(bytes.isupper, words))
    titled = sum(map(bytes.istitle, words))
    ends = sum(w[-1] in b".!?" for w in words)
    return [*share, float(np.log1p(len(text))), float(np.log1p(n)), length / n, len(seen) / n,
            len(seen) / n ** 0.8, most / n, repeats / n, pairs / max(1, n - 1),
            len(set(lines)) / len(lines), float(np.log1p(longest)), marked / n, upper / n,
            titled / n, ends / n, len(_LINKED.findall(text)) / n]


def _describe(extra: int):
    """Keep the first ``extra`` columns, replace the text after them by its statistics."""
    def run(batches):
        for batch in batches:
            rows = [statistics(x.as_py()) for x in batch.column(extra)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(extra)] + [pa.array(rows, pa.list_(pa.float64()))],
                [*batch.schema.names[:extra], "stats"])
    return run


class PuModel:
    """Bin edges per statistic, a weight per bin, and an intercept."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, bias: float, prior: float):
        self.edges, self.weights, self.bias, self.prior = edges, weights, bias, prior

    def score(self, stats: np.ndarray) -> np.ndarray:
        z = self.bias + self.weights[bin_numbers(self.edges, stats)].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-z))


def bin_numbers(edges: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
    """Per row and statistic the number of its bin, counted over all statistics."""
    out, base = np.empty(stats.shape, np.int64), 0
    for k, e in enumerate(edges):
        out[:, k] = base + np.searchsorted(e, stats[:, k], side="right")
        base += len(e) + 1
    return out


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, p: QualityParams) -> PuModel:
    """Minimise the non-negative risk; ``prior`` None: estimated from the bins."""
    if not len(positive) or not len(unlabelled):
        share = 0.5 if prior is None else prior
        return PuModel([np.zeros(0)] * N_STATS, np.zeros(N_STATS), float(np.log(share / (1 - share))), share)
    both = np.concatenate([positive, unlabelled])
    edges = [np.unique(np.quantile(both[:, k], np.linspace(0, 1, p.bins + 1)[1:-1])) for k in range(both.shape[1])]
    xp, xu = bin_numbers(edges, positive), bin_numbers(edges, unlabelled)
    size = sum(len(e) + 1 for e in edges)
    mass_p = np.bincount(xp.ravel(), minlength=size) / len(xp)
    mass_u = np.bincount(xu.ravel(), minlength=size) / len(xu)
    if prior is None:
        usual = mass_p >= 0.05
        ratio = mass_u[usual] / mass_p[usual]
        prior = float(np.clip(np.quantile(ratio, 0.25) if len(ratio) else 0.5, 0.05, 0.95))
    w, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    moment, speed = np.zeros(size + 1), np.zeros(size + 1)
    # Bins a text falls into are few: gradients are sums over rows per bin.
    for step in range(1, p.steps + 1):
        zp, zu = bias + w[xp].sum(axis=1), bias + w[xu].sum(axis=1)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = prior * (sp - 1) / len(xp), np.zeros(len(xu))
        down_p, down_u = -prior * sp / len(xp), su / len(xu)
        if negative >= 0:
            gp, gu = gp + down_p, gu + down_u
        else:
            gp, gu = -down_p, -down_u
        grad = np.bincount(xp.ravel(), weights=np.repeat(gp, xp.shape[1]), minlength=size)
        grad += np.bincount(xu.ravel(), weights=np.repeat(gu, xu.shape[1]), minlength=size) + p.decay * w
        grad = np.append(grad, gp.sum() + gu.sum())
        moment, speed = 0.9 * moment + 0.1 * grad, 0.999 * speed + 0.001 * grad ** 2
        move = p.rate * (moment / (1 - 0.9 ** step)) / (np.sqrt(speed / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return PuModel(edges, w, float(bias), prior)


def _clean_labels(labels: DataFrame) -> DataFrame:
    return (labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
            .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
            .filter("low = high").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("low").alias("quality")))


def train(documents: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> PuModel:
    """Fit on ``documents`` (doc_id, text) and their ``labels`` (doc_id, quality)."""
    p = params or QualityParams()
    known = _clean_labels(labels)
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    shares = {r["quality"]: r["n"] for r in
              ids.join(known, "doc_id").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    pos, neg = shares.get(1, 0), shares.get(0, 0)
    prior = (pos + 1) / (pos + neg + 2) if neg else None
    drawn = F.xxhash64(F.lit(p.seed), "doc_id")

    def sample(rows: DataFrame) -> np.ndarray:
        chosen = F.broadcast(rows.select("doc_id").distinct().orderBy(drawn).limit(p.most_rows))  # bounded by most_rows
        texts = (documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
                 .join(chosen, "doc_id", "left_semi"))
        stats = texts.mapInArrow(_describe(1), "doc_id long, stats array<double>").dropDuplicates(["doc_id"]).collect()
        return np.array([r["stats"] for r in sorted(stats)]).reshape(-1, N_STATS)

    return fit(sample(ids.join(known.filter("quality = 1"), "doc_id", "left_semi")),
               sample(ids.filter("doc_id is not null")), prior, p)


def scored(documents: DataFrame, model: PuModel) -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted`` added (columns of
    these names are replaced)."""
    rows = documents.select(F.struct("*").alias("row"), text_bytes().alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            stats = np.array([statistics(x.as_py()) for x in batch.column(1)]).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(stats))], ["row", "score"])

    keep = [F.col(f"row.`{c}`") for c in documents.columns if c not in ("score", "predicted")]
    return rows.mapInArrow(run, schema).select(
        *keep, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
