"""Operator 8: mixing sources by temperature (DataFrame functions only).

A source's share of the words is raised to an exponent between 0 and 1 and
normalised.  The exponent is found by bisection: the largest at which the
entropy of the weights reaches a target, or the smallest at which no source is
repeated more than a limit, when the budget is what gives every source at
least one pass.  Each step evaluates a whole grid of exponents in one
aggregate over the sources, so sources aren't gathered at the driver.

Weights become budgets of words.  A source's documents are hashed to blocks,
about the square root of their number.  Every pass over a source takes its
blocks in an order of their own, a permutation by hash; the last pass stops
within the block where the budget ends, and there within the documents.  Only
block totals are summed along a source, and documents along a block, so a
source with a third of all rows is spread over its blocks.

Defined cases: a null source is a source of its own; a null text has no words;
sources without words have weight 0 and one pass; repeated rows are mixed each;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Exponents tried in a step, and steps: the exponent is within 32 ** -4 of the exact one.
GRID, STEPS = 32, 4


def word_count(text: Column) -> Column:
    """Words of a text, with one regular expression and no array of them."""
    return (F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")) - F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), "x", ""))).cast("long")


def source_totals(docs: DataFrame, source_col: str = "source", words_col: str = "_words") -> DataFrame:
    """source, docs, words and share of the words."""
    totals = common.checkpoint(docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("docs"), F.sum(words_col).alias("words")))
    every = totals.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]
    return totals.withColumn("share", F.col("words") / F.lit(float(max(every, 1))))


def _search(totals: DataFrame, holds) -> float:
    """The least exponent in [0, 1] at which ``holds`` (a Column of sums over sources, given an exponent) is true and stays so; 1 if none."""
    low, width = 0.0, 1.0
    for _ in range(STEPS):
        tried = [low + width * k / GRID for k in range(GRID + 1)]
        row = totals.where("words > 0").agg(*(holds(F.lit(a)).alias(f"h{k}") for k, a in enumerate(tried))).first()
        k = next((k for k in range(GRID + 1) if row[k]), GRID)
        if k == 0:
            return tried[0]
        low, width = tried[k - 1], width / GRID
    return low + width


def exponent_for_repetition(totals: DataFrame, limit: float) -> float:
    """The least exponent whose weights, at the budget that gives every source a pass, repeat no source more than ``limit`` times."""

    def holds(a: Column) -> Column:
        # repetitions are weight / share = share ** (a - 1), relative to the least of them
        times = F.pow(F.col("share"), a - 1)
        return F.coalesce(F.max(times) / F.min(times) <= limit + 1e-12, F.lit(True))

    return _search(totals, holds)


def exponent_for_entropy(totals: DataFrame, nats: float) -> float:
    """The largest exponent whose weights have an entropy of at least ``nats``; 0 (even weights) if none."""

    def below(a: Column) -> Column:
        p = F.pow(F.col("share"), a)
        entropy = F.log(F.sum(p)) - F.sum(p * F.log(p)) / F.sum(p)
        return F.coalesce(entropy < nats - 1e-12, F.lit(False))

    return max(0.0, _search(totals, below))


def weights(totals: DataFrame, exponent: float) -> DataFrame:
    """Adds weight: share ** exponent, normalised over sources with words."""
    powered = totals.withColumn("_p", F.when(F.col("words") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0))
    total = powered.agg(F.sum("_p").alias("t")).first()["t"]
    return powered.withColumn("weight", F.col("_p") / F.lit(float(total or 1.0))).drop("_p")


def mix_sources(docs: DataFrame, *, repetition_limit: float | None = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of the mixture: the columns ``keep`` (all by default), with _epoch (from 0), _weight and _place, an order within the pass.

    ``budget``: words of the mixture; by default the least that gives every
    source one whole pass.  Where a column kept has one of the three names, the
    new column's has more underscores; the three are always the last.
    """
    keep = keep or docs.columns
    # texts don't travel: only ids, sizes and sources are ranked, and the copies of a document are made at the end
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col))
    sized = docs.select(common.packed(docs, keep).alias("row"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("_words"), key.alias("_key"))
    rows = common.checkpoint(sized.select("source", "_key", "_words"))
    totals = source_totals(rows, "source")
    exponent = exponent_for_entropy(totals, entropy) if entropy is not None else exponent_for_repetition(totals, repetition_limit) if repetition_limit is not None else 1.0
    plan = weights(totals, exponent)
    whole = plan.where("weight > 0").agg(F.max(F.col("words") / F.col("weight")).alias("b")).first()["b"] or 0.0
    asked = float(budget if budget is not None else whole)
    plan = plan.select(
        F.col("source").alias("_s"), "weight", "words",
        F.when(F.col("words") > 0, F.floor(F.col("weight") * asked + 1e-6).cast("long")).otherwise(F.lit(0).cast("long")).alias("goal"),
        F.greatest(F.lit(1), F.ceil(F.sqrt("docs"))).cast("long").alias("blocks"),
    )
    plan = plan.withColumn("full", F.when(F.col("words") > 0, F.expr("goal div words")).otherwise(1)).withColumn("rest", F.when(F.col("words") > 0, F.expr("goal % words")).otherwise(F.lit(0).cast("long")))
    plan = common.checkpoint(plan)
    blocked = rows.join(plan, rows["source"].eqNullSafe(plan["_s"])).withColumn("_block", F.pmod(F.xxhash64("_key", F.lit(1)), F.col("blocks")))
    # the last pass: blocks in its own order, as far as the rest goes
    order = F.xxhash64(F.lit(seed), F.col("full"), F.col("_block"))
    by_block = blocked.groupBy("_s", "_block", "full", "rest").agg(F.sum("_words").alias("n")).withColumn("_order", order)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_s").orderBy("_order", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_block = by_block.withColumn("before", before).select(F.col("_s").alias("_bs"), F.col("_block").alias("_bb"), (F.col("rest") - F.col("before")).alias("_room"))
    within = Window.partitionBy("_s", "_block").orderBy(F.xxhash64("_key", "full"), "_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocked.withColumn("_upto", F.sum("_words").over(within))
    placed = placed.join(by_block, F.col("_s").eqNullSafe(F.col("_bs")) & (F.col("_block") == F.col("_bb")))
    extra = ((F.col("rest") > 0) & (F.col("_upto") <= F.col("_room"))).cast("long")
    copies = placed.groupBy("_key").agg(F.max("weight").alias("_weight"), F.max("full").alias("_full"), F.sum(extra).alias("_extra"), F.max("_block").alias("_block"))
    # rows with the same id, source and text are told apart by a number, and as many of them as were placed get a copy more
    mixed = sized.select("row", "_key").join(copies, "_key").withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("_block")))
    mixed = mixed.withColumn("_copies", F.col("_full") + (F.col("_nth") <= F.col("_extra")).cast("long"))
    mixed = mixed.where("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    place = F.struct(F.xxhash64(F.lit(seed), F.col("_epoch"), F.col("_block")), F.xxhash64("_key", "_epoch"))
    added = {"_epoch": F.col("_epoch"), "_weight": F.col("_weight"), "_place": place}
    return mixed.select(*(F.col(f"row.`{c}`").alias(c) for c in keep), *(c.alias(common.unused(name, keep)) for name, c in added.items()))
