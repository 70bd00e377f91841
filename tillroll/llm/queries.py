"""The registered queries of this subpackage, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import langid
from tillroll.llm.hmm import hmm_scores
from tillroll.llm.line_dedup import dedup_lines
from tillroll.llm.mixing import mix_quotas
from tillroll.llm.negatives import hard_negatives
from tillroll.llm.packing import pack
from tillroll.llm.phrases import fingerprint_edits
from tillroll.llm.pu_quality import scored, train
from tillroll.llm.repair import damage, repair_report
from tillroll.llm.setsketch import SketchParams, near_duplicates
from tillroll.llm.sharding import assign_shards
from tillroll.llm.text import crc_mod
from tillroll.llm.topk import top_k
from tillroll.llm.warc import archive_roundtrip
from tillroll.sources.tables import read_table

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_lines", "removed_lines", "text")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"), SketchParams(width=2)).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_quotas(read_table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = crc_mod("doc_id", 3) == 1
    model = train(documents.filter(~held_out), read_table(spark, sf_dir, "labels", "doc_id", "quality"))
    return scored(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_roundtrip(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents", "doc_id"), "doc_id", SHARDS)


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 5) == 0
    model = langid.train(documents.filter(~held_out))
    return langid.predicted(documents, model, keep=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repair_report(conversations, damage(conversations))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_line_dedup": op2_line_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_near_dedup": op4_near_dedup,
    "op5_packing": op5_packing,
    "op6_topk_search": op6_topk_search,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_sharding": op10_sharding,
    "op11_langid": op11_langid,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
weighed AS (SELECT *, len({WORDS.format("line")}) AS words FROM lines),
placed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS last, last - words AS before
  FROM weighed WHERE words > 0),
runs AS (
  SELECT doc_id, pos AS first_pos, max(pos) OVER f AS last_pos, list(line) OVER f AS run, sum(words) OVER f AS n
  FROM placed WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER b, pos, list(line) OVER b, sum(words) OVER b
  FROM placed WINDOW b AS (PARTITION BY doc_id ORDER BY last RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
firsts AS (SELECT run, min((doc_id, first_pos)) AS place FROM runs WHERE n >= 50 GROUP BY run),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(first_pos, last_pos + 1)) AS pos
  FROM runs JOIN firsts USING (run) WHERE n >= 50 AND (doc_id, first_pos) <> place)
SELECT d.doc_id, CAST(count(l.pos) AS INTEGER) AS n_lines, CAST(count(g.pos) AS INTEGER) AS removed_lines,
       CASE WHEN any_value(d.text) IS NULL THEN NULL
            ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') END AS text
FROM documents d LEFT JOIN lines l USING (doc_id)
     LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
GROUP BY d.doc_id"""

NEAR_DEDUP_SQL = f"""
WITH RECURSIVE tokens AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM tokens),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
component AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM component LEFT JOIN sizes USING (doc_id)"""

TOPK_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored QUALIFY rank <= 5"""

WARC_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest
  FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM payloads"""



def _edit(label: str, cost: str, letter: str, line: str) -> str:
    return f"{{'c': {label}.c + {cost}, 'a': {label}.a || '{letter}', 't': list_append({label}.t, {line})}}"


def _delete(label: str) -> str:
    return f"{{'c': {label}.c + 3, 'a': {label}.a || 'D', 't': {label}.t}}"


def _written(label: str, initial: str, role: str) -> str:
    """Keep or rewrite a turn as the next one of a role."""
    return (f"CASE WHEN initial = '{initial}' THEN {_edit(label, 'cut', 'K', 'line')} "
            f"ELSE {_edit(label, '2 + cut', 'R', repr(role + ':') + ' || text')} END")


_NOWHERE = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}"
_INSERTED = (", ".join(_edit(x, "2", "I", "'user:'") for x in "nsa"), _edit("u1", "2", "I", "'assistant:'"))

# Labels n, s, u, a: cheapest edits so far that have written nothing, or system,
# user or assistant last; u1, a1: the same with insertions before the next turn.
REPAIR_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)
              ORDER BY b) AS t FROM range(256) AS bytes(b)),
faults AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' ||
               coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
             lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1]), 4294967295), 4294967295) % 20 AS fault
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM faults WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS r,
         substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM damaged),
turns AS (
  SELECT *, role || ':' || text AS line, NOT blank AND seen > 1 AS repeat,
         CAST(NOT blank AND seen = 1 AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS BIGINT) AS cut
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) AS seen,
               lag(initial) OVER (PARTITION BY conv_id ORDER BY r) AS before FROM placed)),
stats AS (
  SELECT conv_id, count(*) AS m, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (repeat) AS duplicate, CAST(sum(cut) AS BIGINT) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS r, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} AS n,
         {_NOWHERE} AS s, {_NOWHERE} AS u, {_NOWHERE} AS a FROM stats
  UNION ALL
  SELECT x.conv_id, x.r + 1, {_delete("n")},
         CASE WHEN initial = 's' AND NOT gone THEN list_min([{_delete("s")}, {_edit("n", "cut", "K", "line")}]) ELSE {_delete("s")} END,
         CASE WHEN gone THEN {_delete("u1")} ELSE list_min([{_delete("u1")}, {_written("n", "u", "user")},
           {_written("s", "u", "user")}, {_written("a1", "u", "user")}]) END,
         CASE WHEN gone THEN {_delete("a1")} ELSE list_min([{_delete("a1")}, {_written("u1", "a", "assistant")}]) END
  FROM (SELECT *, list_min([a, {_INSERTED[1]}]) AS a1 FROM (SELECT *, list_min([u, {_INSERTED[0]}]) AS u1 FROM walk)) AS x
  JOIN (SELECT *, blank OR repeat AS gone FROM turns) AS y ON x.conv_id IS NOT DISTINCT FROM y.conv_id AND y.r = x.r + 1),
ends AS (
  SELECT conv_id, list_min([n, a, {_INSERTED[1]}]) AS best
  FROM (SELECT w.*, list_min([u, {_INSERTED[0]}]) AS u1 FROM walk AS w JOIN stats AS z
        ON w.conv_id IS NOT DISTINCT FROM z.conv_id AND w.r = z.m)),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM ids AS i LEFT JOIN stats AS z ON i.conv_id IS NOT DISTINCT FROM z.conv_id
     LEFT JOIN ends AS e ON i.conv_id IS NOT DISTINCT FROM e.conv_id"""

NEGATIVES_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""

# Scoring, fingerprints, tokenization, seeded draws, the classifier, the slot
# table and the pipeline are not SQL: tests/llm compares those with brute force.
ORACLE: dict[str, str] = {
    "op2_line_dedup": LINE_DEDUP_SQL,
    "op4_near_dedup": NEAR_DEDUP_SQL,
    "op6_topk_search": TOPK_SQL,
    "op9_warc": WARC_SQL,
    "op12_conversation_repair": REPAIR_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
