"""Language identification: against plain Python, on edge cases, and on held-out documents."""

import math
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from tests.llm.conftest import DOCS, edge_rows
from tillroll.llm import langid, queries
from tillroll.sources.tables import read_table

WORD = regex.compile(r"[\p{L}\p{M}]{1,48}")


def plain(train, texts, p):
    """(lang, score) of each text, by the definition, one word at a time."""
    counts = {}
    for text, lang in train:
        if lang is not None and text is not None:
            for w in WORD.findall(text.lower()):
                tables = counts.setdefault(lang, [Counter() for _ in range(p.longest + 1)])
                tables[0][w] += 1
                tables[1].update(w)
                for n in range(2, p.longest + 1):
                    s = f" {w} "
                    tables[n].update(s[k:k + n] for k in range(len(s) - n + 1))
    cutoff = max(p.cutoff, len(counts) / (p.most_features // (p.longest + 1)))
    floor = math.log10(cutoff) - 1
    logs = {g: [{f: math.log10(c / t.total()) for f, c in t.items() if c / t.total() >= cutoff} for t in tables]
            for g, tables in counts.items()}
    known = [set().union(*(logs[g][n] for g in logs)) for n in range(p.longest + 1)]
    size = {g: counts[g][0].total() for g in counts}

    def word(w, g):
        for n in (0, *range(p.longest, 0, -1)):
            s = w if n < 2 else f" {w} "
            found = [f for f in ([s] if n == 0 else [s[k:k + n] for k in range(len(s) - n + 1)]) if f in known[n]]
            if found:
                return sum(logs[g][n].get(f, floor) for f in found) / len(found)
        return None

    out = []
    for text in texts:
        if not counts or text is None or not regex.search(r"\p{L}", text):
            out.append(("und", 0.0))
            continue
        scores = {g: [x for w in WORD.findall(text.lower()) if (x := word(w, g)) is not None] for g in sorted(logs)}
        if not any(scores.values()):
            g = min(size, key=lambda g: (-size[g], g))
            out.append((g, size[g] / sum(size.values())))
            continue
        mean = {g: sum(x) / len(x) for g, x in scores.items()}
        best = max(sorted(mean), key=mean.get)
        out.append((best, 1 / sum(10 ** (x - mean[best]) for x in mean.values())))
    return out


EDGE = [("The cat and the dog", "en"), ("le chat et le chien", "fr"), ("LE CHIEN", "fr"), (None, "en"), ("und so", None),
        ("", "de"), ("", ""), ("123 !!", "xx"), ("नमस्ते दुनिया", "hi"), ("Ιστορία", "el"), ("ab" * 3000, "en"), ("the " * 9000, "en"),
        ("le chat", "fr"), ("le chat", "fr"), ("mot", "")]


@pytest.mark.parametrize("params", [langid.LangidParams(), langid.LangidParams(longest=3, cutoff=0.02, held=50),
                                    langid.LangidParams(most_features=350)])
def test_langid_equals_plain(spark, params):
    rows = [(k, t, g, None, None) for k, (t, g) in enumerate(EDGE + [(r[1], r[2]) for r in edge_rows()])]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns(
        {c: F.lit("own") for c in ("row", "n", "count", "word", "feature", "score", "value")})
    asked = [(k, t, None, None, None) for k, t in enumerate(
        [t for t, _ in EDGE] + ["chatte", "dogs catsle", "日本", "日本 the", "é", "12", "ÉTÉ le", "the chien", "abab " * 4000])]
    model = langid.train(docs, params)
    got = {r["doc_id"]: r for r in langid.predicted(spark.createDataFrame(asked, DOCS), model).collect()}
    want = plain([(r[1], r[2]) for r in rows], [r[1] for r in asked], params)
    assert len(got) == len(asked)
    for (k, text, *_), (lang, score) in zip(asked, want, strict=True):
        assert got[k]["lang_pred"] == lang and got[k]["score"] == pytest.approx(score), text
        assert got[k]["text"] == text


def test_langid_small_cache_gives_the_same():
    features = [(0, "the", "en", -1.0), (0, "le", "fr", -1.0), (1, "e", "en", -1.2), (1, "h", "en", -1.3), (1, "l", "fr", -1.1)]
    model = langid.LanguageModel(langid.LangidParams(longest=1), {"en": 2, "fr": 1}, features)
    small, large = langid.Scorer(model, held=2), langid.Scorer(model)
    for text in ("the le eh lh he ll hhh le", "ee eel", "zz", "heel eel ee e h l the", "the", "el le hl lh eh"):
        assert small.score(text)[0] == large.score(text)[0]
        assert small.score(text)[1] == pytest.approx(large.score(text)[1])


def test_langid_without_rows_or_languages(spark, no_docs):
    assert langid.predicted(no_docs, langid.train(no_docs)).collect() == []
    unlabelled = spark.createDataFrame([(1, "some words", None, None, None), (1, "some words", None, None, None)], DOCS)
    got = langid.predicted(unlabelled, langid.train(unlabelled)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2


def test_langid_refuses_more_languages_than_fit(spark):
    rows = [(k, f"w{'abcdefgh'[k]}", f"l{k}", None, None) for k in range(8)]
    with pytest.raises(ValueError, match="languages"):
        langid.train(spark.createDataFrame(rows, DOCS), langid.LangidParams(most_features=49))


def test_langid_model_is_bounded(spark):
    docs = read_table(spark, SF_CHECK, "documents")
    p = langid.LangidParams(most_features=2000)
    model = langid.train(docs, p)
    assert 0 < np.isfinite(model.table).all() and (model.table[:, :-1] > model.params.floor).sum() <= 2000


def test_langid_held_out_accuracy(spark):
    truth = {r["doc_id"]: r for r in read_table(spark, SF_CHECK, "documents").collect()}
    got = queries.op11_langid(spark, SF_CHECK).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(truth)
    held = [r for r in got if r["held_out"]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held)
    assert 150 < len(held) < 250 and right >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
