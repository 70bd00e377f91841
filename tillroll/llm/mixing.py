"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: the mix has ``share`` times all words; sources in code point order
(null last) weigh ``weights``, repeating; a target stops at ``epochs`` times
its source's size and the excess is reshared by weight (each target is
min(cap, level * weight) for the one level that adds up).

A seat is one word of the mix, at any size of the corpus. A source gets its
target rounded down or up, up by highest quotients target / (2 s + 1) as far as
words are left; then each source's quota goes to its shards by highest
quotients size / (2 s + 1). A quota of at most ``epochs`` times the source gives
no shard more than ``epochs`` times its size: (2 s + 1) / size is below
2 * ``epochs`` for all seats up to there and above it for all others.
A shard lays its documents out in an order drawn from ``seed`` and takes the
first words of that order, in as many rounds as the quota asks for.

Highest quotients are found without listing all seats: rounding the exact share
is off by at most half a seat per party, so only seats around that value are
ranked, a number in proportion to the number of parties.

Everything is DataFrame functions: sums per source and shard (pre-aggregated),
windows over the few sources, per source over its shards, and per shard over
its documents. A source of any size is split into shards of about
``shard_words`` words by a hash of the document.

Defined cases: null text has size 0 and takes 0; a null source is a source of
its own, last; repeated rows are documents of their own; a source of size 0
has target 0; an empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.store import materialize
from tillroll.llm.text import WORD


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    epochs: int = 2
    shard_words: int = 1 << 18
    seed: int = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, p: MixParams) -> DataFrame:
    """(source, source_size) -> (source, source_size, target)."""
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in p.weights)), F.pmod(rank - 1, F.lit(len(p.weights))) + 1)
    s = sizes.withColumn("w", w).withColumn("cap", (p.epochs * F.col("source_size")).cast("double"))
    by_ratio = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    capped_before = F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1))
    weight_from = F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = p.share * F.sum("source_size").over(everything)
    # The level if all sources of smaller cap / weight are capped and no other is.
    s = s.withColumn("level", (total - F.coalesce(capped_before, F.lit(0.0))) / weight_from)
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything)
    return s.withColumn("at", level).select(
        "source", "source_size",
        F.when(F.col("source_size") == 0, F.lit(0.0))
        .otherwise(F.least("cap", F.coalesce(F.col("at") * F.col("w"), F.col("cap")))).alias("target"))


def sainte_lague(parties: DataFrame, by: list[str], votes: str, seats: str, order: list[Column],
                 most: str | None = None) -> DataFrame:
    """``parties`` with a column ``quota``: the ``seats`` of each group ``by``
    go to its parties by highest quotients votes / (2 s + 1), ties to the
    first in ``order``. A group without votes gets none. With ``most``, every
    party gets its exact share rounded down or up, and at most ``most``."""
    group = Window.partitionBy(*by)
    exact = F.col(seats) * F.col(votes).cast("double") / F.sum(votes).over(group)
    reach = F.ceil(F.col("_exact") * F.col("_parties") / (2 * F.greatest(F.col(seats), F.lit(1)))) + 2
    reach = F.lit(0) if most else reach
    base = parties.withColumn("_exact", F.coalesce(exact, F.lit(0.0))).withColumn(
        "_parties", F.count("*").over(group)).withColumn(
        "_low", F.greatest(F.lit(0), F.floor("_exact") - reach).cast("long")).withColumn(
        "_high", (F.floor("_exact") + reach).cast("long"))
    base = base.withColumn("_open", F.col(seats) - F.sum("_low").over(group)).withColumn(
        "_id", F.row_number().over(group.orderBy(*order)))
    keys = [*by, "_id"]
    inside = (F.col("_exact") > F.col("_low")) & (F.col("_low") < F.col(most)) if most else F.lit(True)
    seat = base.filter((F.col(votes) > 0) & inside).select(
        *(F.col(c).alias(f"_won_{c}") for c in keys), "_open", F.col(votes).cast("double").alias("_votes"),
        F.explode(F.sequence("_low", "_high")).alias("_s"))
    won = (seat.withColumn("_rank", F.row_number().over(
        Window.partitionBy(*(f"_won_{c}" for c in by))
        .orderBy(F.desc(F.col("_votes") / (2 * F.col("_s") + 1)), "_won__id", "_s")))
        .filter("_rank <= _open").groupBy(*(f"_won_{c}" for c in keys)).agg(F.count("*").alias("_won")))
    same = [F.col(c).eqNullSafe(F.col(f"_won_{c}")) for c in keys]
    return base.join(won, same, "left").select(
        *parties.columns,
        F.when(F.col(votes) > 0, F.col("_low") + F.coalesce("_won", F.lit(0))).otherwise(0)
        .cast("long").alias("quota"))


def _sized(documents: DataFrame, p: MixParams) -> DataFrame:
    """doc_id, source, _size, _draw and the whole row, out of reach of other names."""
    return documents.select("doc_id", "source", word_count(F.col("text")).alias("_size"), F.xxhash64(
        F.lit(p.seed), "doc_id", "text", "source").alias("_draw"), F.struct("*").alias("_row"))


def _shard(p: MixParams) -> Column:
    """A shard of the document's source: one of as many as its words need."""
    shards = F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / F.lit(p.shard_words)).cast("long")
    return F.pmod(F.xxhash64(F.lit(p.seed + 1), "_draw"), shards)


def _with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``per_source``, which is broadcast if it is small."""
    few = per_source.withColumnRenamed("source", "_source")
    few = F.broadcast(few) if few.count() <= 10_000 else few
    return rows.join(few, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _plan(small: DataFrame, p: MixParams) -> tuple[DataFrame, DataFrame]:
    """Targets per source, and quotas in words per (source, shard)."""
    sizes = small.groupBy("source").agg(F.sum("_size").alias("source_size"))
    targets = materialize(source_targets(sizes, p), "targets")
    words = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    seats = int(min(p.share, p.epochs) * words)
    parties = targets.withColumns({"_all": F.lit(0), "_seats": F.lit(seats).cast("long"),
                                   "_most": p.epochs * F.col("source_size")})
    quotas = sainte_lague(parties, ["_all"], "target", "_seats", [F.col("source").isNull(), F.col("source")], "_most")
    quotas = quotas.select("source", "source_size", F.col("quota").alias("source_quota"))
    shards = (_with_source(small, targets).withColumn("_shard", _shard(p))
              .groupBy("source", "_shard").agg(F.sum("_size").alias("shard_size")))
    shards = _with_source(shards, quotas.drop("source_size"))
    placed = sainte_lague(shards, ["source"], "shard_size", "source_quota", [F.col("_shard")])
    return targets, materialize(placed.select(
        "source", "_shard", "shard_size", F.col("quota").alias("_words")), "shards")


def _taken(rows: DataFrame, targets: DataFrame, shards: DataFrame, p: MixParams, whole: bool) -> DataFrame:
    """``rows`` (source, _size, _draw, ...) with source_size, target and taken."""
    keyed = _with_source(rows, targets).withColumn("_shard", _shard(p))
    quota = shards.select(F.col("source").alias("_s"), F.col("_shard").alias("_k"), "shard_size", "_words")
    keyed = keyed.join(quota, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_k"))).drop("_s", "_k")
    laid = Window.partitionBy("source", "_shard").orderBy("_draw", "doc_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = F.sum("_size").over(laid) - F.col("_size")
    words = F.least("_words", p.epochs * F.col("shard_size"))
    rounds = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("_size"), words - F.col("_rounds") * F.col("shard_size") - F.col("_before")))
    if whole:  # a document that the quota's end cuts is taken if at least half of it is
        part = F.when(2 * part >= F.col("_size"), F.col("_size")).otherwise(0)
    return (keyed.withColumn("_before", before).withColumn("_rounds", rounds)
            .withColumn("taken", (F.col("_rounds") * F.col("_size") + part).cast("long")))


def mix_quotas(documents: DataFrame, params: MixParams | None = None) -> DataFrame:
    """Per row of ``documents`` (doc_id, text, source): doc_id, size,
    source_size, target, taken (words the mix takes, repeats counted)."""
    p = params or MixParams()
    small = materialize(_sized(documents, p).drop("_row"), "sizes")
    targets, shards = _plan(small, p)
    return _taken(small, targets, shards, p, whole=False).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


def mix_documents(documents: DataFrame, params: MixParams | None = None) -> DataFrame:
    """The mix itself, of whole documents: each row of ``documents`` as often
    as it is taken (once and again, once, or not at all)."""
    p = params or MixParams()
    rows = _sized(documents, p)
    small = materialize(rows.drop("_row"), "sizes")
    targets, shards = _plan(small, p)
    mixed = _taken(rows, targets, shards, p, whole=True)
    copies = F.when(F.col("_size") > 0, F.floor(F.col("taken") / F.col("_size"))).otherwise(1).cast("int")
    return (mixed.withColumn("_copies", copies).filter("_copies > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*"))
