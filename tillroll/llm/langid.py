"""Language identification by word-first backoff.

A text is lower-cased and cut into words (runs of letters and marks, at most
``longest_word`` code points; a longer run is cut into several). A word that
the model knows scores the log10 of its relative frequency in each language.
A word it does not know falls back to its character n-grams of the greatest
length of which any is known, and scores the mean over those: lengths go down
one by one to single characters; above one the word counts with a blank on
each side. A feature that a language lacks scores ``floor``. The text's score
is the mean over its words, repeats counted, and the best language wins.

Counts come from all training rows: words are counted per task, then summed
by (language, word) and written; n-grams are counted from that table, so each
distinct word is cut once per language, not once per occurrence. The model
keeps the features whose relative frequency in a language reaches a cut-off,
so it has at most 1 / cut-off features per language and length whatever the
corpus. The cut-off is ``cutoff``, or more where that many languages would pass
``most_features`` in all, which bounds the driver's and the tasks' memory.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a
text with letters of which no word or n-gram is known gets the language of
most training words and its share of them as score; equal scores go to the
language that is least by code points. Languages are the non-null values of
``lang`` with at least one training word (the empty string is one like any
other); without any, every text is ``und`` with score 0. Otherwise the score
is the best language's part, from 0 to 1, of the languages' geometric mean
likelihoods a word. Rows that repeat count as often as they stand there.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.store import materialize

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LangidParams:
    longest: int = 6            # n-grams
    longest_word: int = 48
    cutoff: float = 1e-5
    most_features: int = 1 << 21
    held: int = 1 << 19         # distinct words or n-grams counted in a task before they are handed on

    @property
    def floor(self) -> float:
        """Log10 frequency of a feature that a language lacks: a tenth of the cut-off."""
        return float(np.log10(self.cutoff)) - 1


def splitter(p: LangidParams):
    """A function from a lower-cased text to its words."""
    return regex.compile(r"[\p{L}\p{M}]{1,%d}" % p.longest_word).findall


def grams(word: str, n: int) -> list[str]:
    s = word if n == 1 else f" {word} "
    return [s[k:k + n] for k in range(len(s) - n + 1)]


def _counted(held: int, count):
    """Partial counts of a task: ``count`` adds a batch to a Counter per (language, n) and yields now and
    then; they are handed on as (lang, n, feature, count) when there are more than ``held`` of them."""
    def run(batches):
        def out():
            for (lang, n), seen in tables.items():
                if seen:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(seen), int))),
                         pa.array(np.full(len(seen), n, np.int32)), pa.array(seen.keys(), pa.string()),
                         pa.array(seen.values(), pa.int64())], ["lang", "n", "feature", "count"])
                    seen.clear()

        tables: defaultdict = defaultdict(Counter)
        for batch in batches:
            for _ in count(batch, tables):
                if sum(map(len, tables.values())) > held:
                    yield from out()
        yield from out()
    return run


COUNTS = "lang string, n int, feature string, count long"


def _summed(partial: DataFrame) -> DataFrame:
    return partial.groupBy("lang", "n", "feature").agg(F.sum("count").alias("count"))


def word_counts(documents: DataFrame, p: LangidParams) -> DataFrame:
    """(lang, n = 0, feature, count) of the words of all rows with a language and a text."""
    def count(batch, tables):
        words = splitter(p)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tables[lang, 0].update(words(text.as_py().lower()))
            yield

    rows = documents.filter("lang is not null and text is not null").select("lang", "text")
    return _summed(rows.mapInArrow(_counted(p.held, count), COUNTS))


def _gram_tables(words: list[str], times: np.ndarray, longest: int):
    """(n, distinct n-grams, their counts) of words that occur ``times`` times. The words stand
    one after another with single blanks; an n-gram's number follows from the number of the one
    that is a character shorter and the character after it."""
    line = f" {' '.join(words)} "
    _, char = np.unique(np.frombuffer(line.encode("utf-32-le"), np.uint32), return_inverse=True)
    blank = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
    at = np.arange(len(line) - 1)
    word = np.searchsorted(blank, at, side="right") - 1  # a word with the blank before it
    end = blank[word + 1]
    number, alphabet = char[:-1], int(char.max()) + 1
    inside = np.flatnonzero(at != blank[word])
    for n in range(1, longest + 1):
        if n > 1:
            keep = end[at] >= at + n - 1
            at, number = at[keep], number[keep] * alphabet + char[at[keep] + n - 1]
        some = inside if n == 1 else slice(None)
        _, first, number_of = np.unique(number[some], return_index=True, return_inverse=True)
        counts = np.bincount(number_of, weights=times[word[at[some]]]).astype(np.int64)
        yield n, [line[k:k + n] for k in at[some][first].tolist()], counts
        if n > 1:
            number = number_of


def gram_counts(words: DataFrame, p: LangidParams) -> DataFrame:
    """(lang, n, feature, count) of the character n-grams of all counted words."""
    def run(batches):
        def out():
            for lang, (features, times) in waiting.items():
                for n, found, counts in _gram_tables(features, np.array(times, float), p.longest):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found), pa.string()), pa.array(np.full(len(found), n, np.int32)),
                         pa.array(found, pa.string()), pa.array(counts)], ["lang", "n", "feature", "count"])
            waiting.clear()

        waiting: dict[str, tuple[list, list]] = {}
        size = 0
        for batch in batches:
            for lang, word, times in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                features, counts = waiting.setdefault(lang, ([], []))
                features.append(word)
                counts.append(times)
                size += len(word)
                if size > 2 * p.held:
                    yield from out()
                    size = 0
        yield from out()

    return _summed(words.mapInArrow(run, COUNTS))


class LanguageModel:
    """Log frequencies by feature length (0: words), and the languages' training words."""

    def __init__(self, params: LangidParams, sizes: dict[str, int], features):
        """``features``: (n, feature, language, log10 of its relative frequency)."""
        self.params, self.languages = params, sorted(sizes)
        total = sum(sizes.values())
        self.usual = min(self.languages, key=lambda g: (-sizes[g], g), default=UNKNOWN)
        self.share = sizes[self.usual] / total if total else 0.0
        at = {g: k for k, g in enumerate(self.languages)}
        self.index: list[dict[str, int]] = [{} for _ in range(params.longest + 1)]
        rows, columns, values = [], [], []
        size = 0
        for n, feature, lang, value in sorted(features):  # known words take the first rows
            rows.append(self.index[n].setdefault(feature, size))
            size = max(size, rows[-1] + 1)
            columns.append(at[lang])
            values.append(value)
        self.table = np.full((size, len(at) + 1), params.floor)
        self.table[:, -1] = 1  # last column: the row is a known feature
        self.table[rows, columns] = values

    def known(self, word: str) -> list[int]:
        """The rows of the table that make up a word's score: its own, or those of its longest known n-grams."""
        k = self.index[0].get(word)
        if k is not None:
            return [k]
        for n in range(self.params.longest, 0, -1):
            index = self.index[n]
            found = [index[g] for g in grams(word, n) if g in index]
            if found:
                return found
        return []

    def rows(self, words: list[str]) -> np.ndarray:
        """The scores of words; zero with a last column of zero where nothing of a word is known."""
        found = [self.known(w) for w in words]
        sizes = np.fromiter(map(len, found), int, len(found))
        out = np.zeros((len(words), self.table.shape[1]))
        some = np.flatnonzero(sizes)
        if len(some):
            starts = np.cumsum(sizes[some]) - sizes[some]
            flat = np.fromiter(chain.from_iterable(found), int, sizes.sum())
            out[some] = np.add.reduceat(self.table[flat], starts) / sizes[some, None]
        return out

    def best(self, total: np.ndarray) -> tuple[str, float]:
        """Language and score of a text from the sum of its words' rows."""
        if not total[-1]:
            return self.usual, self.share
        mean = total[:-1] / total[-1]
        k = int(mean.argmax())
        return self.languages[k], float(1 / (10 ** (mean - mean[k])).sum())


class Scorer:
    """A model with the rows of words met lately (``held`` of them beside the known words)."""

    def __init__(self, model: LanguageModel, held: int = 1 << 18):
        self.model, self.words = model, splitter(model.params)
        known = len(model.index[0])
        self.first, self.last = known, known + held
        self.slots = dict(model.index[0])
        self.rows = np.concatenate([model.table[:known], np.zeros((held, model.table.shape[1]))])

    def score(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.model.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        counts = Counter(self.words(text.lower()))
        total = np.zeros(self.rows.shape[1])
        words, times = list(counts), np.fromiter(counts.values(), float, len(counts))
        step = self.last - self.first
        for at in range(0, len(words), step):
            part = words[at:at + step]
            new = [w for w in part if w not in self.slots]
            if len(new) > self.last - len(self.slots):
                self.slots = dict(self.model.index[0])
                new = [w for w in part if w not in self.slots]
            if new:
                first = len(self.slots)
                self.rows[first:first + len(new)] = self.model.rows(new)
                self.slots.update(zip(new, range(first, first + len(new)), strict=True))
            total += times[at:at + step] @ self.rows[[self.slots[w] for w in part]]
        return self.model.best(total)


def train(documents: DataFrame, params: LangidParams | None = None) -> LanguageModel:
    """Count all rows of ``documents`` (text, lang) that have both."""
    p = params or LangidParams()
    words = materialize(word_counts(documents, p), "words")
    size, most = F.char_length("feature"), p.most_features // (p.longest + 1)
    totals = words.groupBy("lang").agg(F.sum("count").alias("t0"), F.sum(F.col("count") * size).alias("t1"), *(
        F.sum(F.col("count") * F.greatest(F.lit(0), size + 3 - n)).alias(f"t{n}") for n in range(2, p.longest + 1)))
    sizes = totals.limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages: raise most_features")
    if not sizes:
        return LanguageModel(p, {}, [])
    p = replace(p, cutoff=max(p.cutoff, len(sizes) / most))
    total = words.sparkSession.createDataFrame(
        [(r["lang"], n, r[f"t{n}"]) for r in sizes for n in range(p.longest + 1)], "lang string, n int, total long")
    kept = (words.union(gram_counts(words, p)).join(F.broadcast(total), ["lang", "n"])  # at most ``most_features`` rows
            .filter(F.col("count") >= p.cutoff * F.col("total"))
            .select("n", "feature", "lang", F.log10(F.col("count") / F.col("total")).alias("value")).toArrow())
    return LanguageModel(p, {r["lang"]: r["t0"] for r in sizes},
                         zip(*(c.to_pylist() for c in kept.columns), strict=True))


def predicted(documents: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``documents`` (default: all) with ``lang_pred``
    and ``score`` from the whole ``text`` added; columns of these names are replaced."""
    keep = [c for c in (documents.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(0)
    rows = documents.select(kept.alias("row"), F.col("text").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g for g, _ in found], pa.string()),
                 pa.array([s for _, s in found], pa.float64())], ["row", "lang_pred", "score"])

    return rows.mapInArrow(run, schema).select(*(F.col(f"row.`{c}`") for c in keep), "lang_pred", "score")
