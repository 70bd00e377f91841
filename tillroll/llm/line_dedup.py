"""Line dedup by winnowing over line hashes.

A line's identity is a 128-bit hash of its text, its weight the number of its
words. Blank lines are passed over, and go only where they lie inside a deleted
run. A *run* is a sequence of consecutive non-blank lines; a run of
``min_words`` words or more that already occurred earlier (smaller doc_id, then
smaller key, then earlier line; also inside one document, overlaps included) is
deleted, its first occurrence stays.

1. Fingerprints. From every line starts a gram: the shortest run of at least
   ``min_words // 2`` words, hashed. Over the shortest stretch of
   ``min_words - min_words // 2`` words of gram starts from every line the
   smallest hash is selected. The selected grams of a run of ``min_words``
   words lie inside it, so equal runs select equal fingerprints.
2. Positions are joined on fingerprints that occur at more than one place; all
   other lines drop out here.
3. Matches are extended both ways: around every matched position stand the
   shortest runs of ``min_words`` words that start, and those that end, at each
   line. These two families cover each repeated run exactly, to both its ends.
   A run is compared with the first occurrence of the same run, whichever
   document holds it, so a passage that thousands share costs one row each and
   never pairs.
4. Lines in a run that is not a first occurrence are deleted.

All steps are DataFrame operations: windows are partitioned by document, the
grouping by run hash is pre-aggregated, and only hashes are shuffled up to the
last join, which brings the deleted positions back to their texts.

Defined cases: null text stays null, empty text stays empty; rows that repeat
both doc_id and text are one document and share its result; a null doc_id
sorts first; an empty table gives an empty result; extra columns pass through, but for ones
named ``n_lines`` or ``removed_lines``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.store import materialize
from tillroll.llm.text import WORD

#: A document's key: 128 bits over its id and text. Row numbers would change
#: when a lost executor changes how a scan is split between two jobs.
KEY = ["_line_key_a", "_line_key_b"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash128(column: str) -> Column:
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(1), column).alias("b"))


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.withColumns({KEY[0]: F.xxhash64("doc_id", "text"),
                                  KEY[1]: F.xxhash64(F.lit(1), "doc_id", "text")})


def line_spans(rows: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of ``min_words`` words that start or end at a line:
    KEY, doc_id, first_pos, last_pos, the hash of the run's lines, and the
    fingerprint (``mark``, at line ``mark_pos``) that lies in the run."""
    gram, stretch = min_words // 2, min_words - min_words // 2
    lines = (rows.select(*KEY, "doc_id", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
             .withColumn("words", F.regexp_count("line", F.lit(WORD)).cast("long"))
             .filter("words > 0")
             .select(*KEY, "doc_id", "pos", "words", _hash128("line").alias("h"))
             .dropDuplicates([*KEY, "pos"]))
    by_row = Window.partitionBy(*KEY)
    upto = by_row.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("end", F.sum("words").over(upto)).withColumn("begin", F.col("end") - F.col("words"))

    def starting(words: int):
        return by_row.orderBy("begin").rangeBetween(0, words - 1)

    # A run that ends here and is not the one that starts at its first line.
    ending = by_row.orderBy("end").rangeBetween(1 - min_words, 0)
    total = F.sum("words").over(ending)
    behind = F.when(total - F.col("words") >= min_words, F.collect_list("h").over(ending))
    lines = lines.withColumn("behind", behind).withColumn("behind_pos", F.min("pos").over(ending)).withColumn(
        "behind", F.when(F.col("behind").isNotNull(), _hash128("behind")))

    def list_from(words: int):
        return F.when(F.sum("words").over(starting(words)) >= words, F.collect_list("h").over(starting(words)))

    lines = (lines.withColumn("ahead", list_from(min_words)).withColumn("gram", list_from(gram))
             .withColumn("ahead_pos", F.max("pos").over(starting(min_words)))
             .withColumn("ahead", F.when(F.col("ahead").isNotNull(), _hash128("ahead")))
             .withColumn("gram", F.when(F.col("gram").isNotNull(), F.struct(F.xxhash64("gram").alias("g"), "pos")))
             .withColumn("least", F.min("gram").over(starting(stretch)))
             .withColumn("behind_least", F.when(F.col("behind").isNotNull(), F.first("least").over(ending))))
    spans = F.array(
        F.when(F.col("ahead").isNotNull(), F.struct(
            F.col("ahead").alias("run"), F.col("pos").alias("first_pos"), F.col("ahead_pos").alias("last_pos"),
            F.col("least").alias("mark"))),
        F.when(F.col("behind").isNotNull(), F.struct(
            F.col("behind").alias("run"), F.col("behind_pos").alias("first_pos"), F.col("pos").alias("last_pos"),
            F.col("behind_least").alias("mark"))))
    return lines.select(*KEY, "doc_id", F.explode(F.array_compact(spans)).alias("s")).select(
        *KEY, "doc_id", "s.run", "s.first_pos", "s.last_pos", F.col("s.mark.g").alias("mark"),
        F.col("s.mark.pos").alias("mark_pos"))


def repeated_lines(rows: DataFrame, min_words: int = 50) -> DataFrame:
    """KEY and pos of every line to delete; ``rows`` has KEY, doc_id and text."""
    spans = materialize(line_spans(rows, min_words), "line-spans")
    at = F.struct(*KEY, "mark_pos")
    # Both small sides are written first: a join of two scans is one whose hot
    # keys adaptive execution can split, a join with an aggregate is not.
    shared = materialize(spans.groupBy("mark").agg(F.min(at).alias("x"), F.max(at).alias("y"))
                         .filter("x != y").select("mark"), "line-marks")
    matched = spans.join(shared, "mark", "left_semi")
    place = F.struct("doc_id", *KEY, "first_pos")
    matched = materialize(matched.select("run", place.alias("place"), "last_pos"), "line-matches")
    first = materialize(matched.groupBy("run").agg(F.min("place").alias("first"), F.max("place").alias("last"))
                        .filter("first != last").select("run", "first"), "line-firsts")
    later = matched.join(first, "run").filter("place != first")
    return later.select(*(F.col(f"place.{c}") for c in KEY), F.explode(
        F.sequence("place.first_pos", "last_pos")).alias("pos")).distinct()


def dedup_lines(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """``documents`` (doc_id, text and any other columns) with ``text`` rid of
    later repeated runs, and two columns more: ``n_lines``, ``removed_lines``."""
    whole = F.struct("*").alias("_whole")  # out of reach of other names
    rows = _keyed(documents.select("doc_id", "text", whole))
    gone = (repeated_lines(rows.select(*KEY, "doc_id", "text"), min_words)
            .groupBy(*KEY).agg(F.collect_set("pos").alias("_gone")))
    joined = rows.join(gone, KEY, "left")
    # Kept positions by a hash set, lines bound once: linear in the lines of a text.
    both = F.array(F.struct(_lines(F.col("text")).alias("lines"), F.col("_gone").alias("gone")))
    kept = F.array_join(F.transform(both, lambda s: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"]),
        lambda i: F.get(s["lines"], i)))[0], "\n")
    own = {"n_lines": F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)),
           "removed_lines": F.coalesce(F.size("_gone"), F.lit(0)),
           "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)}
    names = [c for c in documents.columns if c not in ("n_lines", "removed_lines")]
    return joined.select(*(own["text"].alias(c) if c == "text" else F.col(f"_whole.`{c}`") for c in names),
                         *(own[c].alias(c) for c in ("n_lines", "removed_lines")))
