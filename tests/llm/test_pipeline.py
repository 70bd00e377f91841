"""The corpus pipeline, stage by stage against brute force, and its registration."""

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SF_SMOKE
from tests.llm import brute
from tests.llm.test_operators import check_sequences
from tillroll.llm import queries
from tillroll.sources.tables import read_table


def test_registered():
    assert set(queries.QUERIES) <= set(entry.queries())
    assert sum(name.startswith("op") for name in queries.QUERIES) == 13
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = read_table(spark, SF_SMOKE, "documents")
    out = {"input": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF_SMOKE).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, SF_SMOKE, "labels").collect()}
    stay = {r["doc_id"] for r in stages["quality"]}
    good = [r["doc_id"] in stay for r in stages["input"] if labels.get(r["doc_id"]) == 1]
    bad = [r["doc_id"] in stay for r in stages["input"] if labels.get(r["doc_id"]) == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) < 0.7 * len(bad)  # 200 documents train little


def test_line_dedup_stage(stages):
    want = brute.dedup_lines({r["doc_id"]: r["text"] for r in stages["quality"]}, 50)
    before = {r["doc_id"]: r["text"] for r in stages["quality"]}
    want = {i: t for i, t in want.items() if t == before[i] or brute.words(t)}
    assert {r["doc_id"]: r["text"] for r in stages["line_dedup"]} == want


def test_near_dedup_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["line_dedup"]]
    found = brute.near_components(rows, 5)
    assert sorted(r["doc_id"] for r in stages["near_dedup"]) == sorted(
        i for (i, _), (n, c) in zip(rows, found, strict=True) if n == 0 or i == c)


def test_mixing_stage(stages):
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in stages["near_dedup"]}
    source = {r["doc_id"]: r["source"] for r in stages["near_dedup"]}
    total, taken, longest = Counter(), Counter(), Counter()
    for i, n in size.items():
        total[source[i]] += n
        longest[source[i]] = max(longest[source[i]], n)
    for r in stages["mixing"]:
        taken[r["source"]] += size[r["doc_id"]]
    for s, t in brute.targets(dict(total)).items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 5


def test_packing_stage(stages):
    check_sequences(stages["packing"])
    starts = Counter(r["doc_id"] for r in stages["packing"] if r["start"] == 0)
    assert starts == Counter(r["doc_id"] for r in stages["mixing"])


def test_run_equals_the_stages(spark, stages):
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    got = sorted(tuple(r[c] for c in columns) for r in corpus_pipeline.run(spark, SF_SMOKE).collect())
    assert got == sorted(tuple(r[c] for c in columns) for r in stages["packing"])
