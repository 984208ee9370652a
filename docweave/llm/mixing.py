"""Mixing sources to target weights by Pareto order sampling (operator 5).

Every source gets a target number of words. A document's expected number of copies is in
proportion to its weight (by default the logarithm of its size: longer documents are rarer and
kept more readily) at the level that meets its source's target, ``cap`` at most. The integer part
are certain whole copies; the rest is its inclusion probability p for one more. Documents
are ranked by Pareto's ratio, random odds u / (1 - u) over inclusion odds p / (1 - p), and taken
in that order until the source's remaining words are reached: an unequal-probability sample
whose size is fixed in words, so a source misses its target by less than the one document at
the border.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.storage import running_sum, small_side, staged

WORD = r"[^\x20\x09-\x0D]+"


def source_positions(sources: DataFrame, column: str = "source") -> DataFrame:
    """``sources`` (distinct) with ``position``: 0, 1, ... by code point, null last. No single-task sort:
    positions are running counts over range partitions."""
    ranked = sources.select(column, F.col(column).isNull().cast("int").alias("_null"), F.lit(0).alias("_all"), F.lit(1).alias("_one"))
    return running_sum(ranked, ["_all"], ["_null", column], "_one", "_n").select(column, (F.col("_n") - 1).alias("position"))


def source_targets(totals: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources by position. The level t solves
    sum(min(w * t, cap * size)) = sum(size): sources above their cap are fixed there and the
    rest is shared by weight again, until none is above. Each round is one small aggregate.
    """
    array = F.array(*[F.lit(w) for w in weights])
    at = source_positions(totals.select("source")).withColumnRenamed("source", "_s")
    table = staged(totals.join(at, F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "source_size", F.element_at(array, (F.col("position") % len(weights) + 1).cast("int")).cast("double").alias("w")),
        "sources")
    level = 0.0
    while True:
        full = F.col("w") * level > cap * F.col("source_size")
        r = table.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, cap * F.col("source_size")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if not r["all"] or not r["w"]:
            break
        new = (r["all"] - r["fixed"]) / r["w"]
        if new <= level:
            break
        level = new
    return table.select("source", "source_size",
                        F.least(F.col("w") * level, cap * F.col("source_size")).alias("target"))


def source_levels(rows: DataFrame, targets: DataFrame, cap: float, rounds: int = 50) -> DataFrame:
    """(source, source_size, target, level): sum(min(level * weight, cap) * size) = target in each source, by Newton steps.

    The sum is concave in the level, so steps from 0 rise to the solution and reach it when no
    further document meets the cap. Each round is one small aggregate.
    """
    full = F.col("target") >= F.lit(cap * (1 - 1e-12)) * F.col("source_size")  # every document at the cap
    at = targets.withColumn("level", F.when(full, F.lit(1e300)).otherwise(F.lit(0.0)))
    for _ in range(rounds):
        level = at.select(F.col("source").alias("_s"), "level")
        copies = F.least(F.col("level") * F.col("w"), F.lit(cap))
        now = rows.join(small_side(level), F.col("source").eqNullSafe(F.col("_s"))).groupBy(F.col("source").alias("_s")).agg(
            F.sum(copies * F.col("size")).alias("words"), F.sum(F.when(F.col("level") * F.col("w") < cap, F.col("w") * F.col("size")).otherwise(0.0)).alias("slope"))
        step = F.when(F.col("slope") > 0, F.greatest((F.col("target") - F.col("words")) / F.col("slope"), F.lit(0.0))).otherwise(0.0)
        at = staged(at.join(now, F.col("source").eqNullSafe(F.col("_s"))).select(
            "source", "source_size", "target", (F.col("level") + step).alias("level"), step.alias("step")), "levels")
        if not at.where(F.col("step") > 1e-12 * F.col("level")).limit(1).count():
            break
        at = at.drop("step")
    return at.drop("step").withColumn("level", F.round("level", 12))  # sums of doubles differ in their last digits from run to run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix-1", keep: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Per row: doc_id, size (words), source_size, target, expected, copies, taken (= copies * size); ``keep`` adds columns.

    ``expected`` is the document's expected number of copies, in proportion to the column
    ``weight`` of ``docs`` (null, negative or not finite: 0) or, left out, to ln(size + 2).
    A source whose weights can't meet its target, all documents at ``cap`` or of weight 0,
    takes what they allow. A null text has size 0 and is never drawn; a null source is a
    source of its own; a null id is hashed as empty. Equal rows are drawn one by one (they
    differ only in the order in which they were read, and are alike in the result). Only the
    drawn copies differ from row to row: the same table and seed give the same result.
    Empty table: no rows.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10)
    given = F.lit(None).cast("double") if weight is None else F.col(weight).cast("double")
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), given.alias("w"),
        ((digest.cast("double") + 0.5) / float(1 << 48)).alias("u"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    fit = (F.col("w") > 0) & (F.col("w") < F.lit(float("inf")))
    slim = slim.withColumn("w", F.log(F.col("size") + 2.0) if weight is None else F.when(fit, F.col("w")).otherwise(0.0))
    slim = staged(slim.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    levels = source_levels(slim.where(F.col("size") > 0).select("source", "size", "w"), staged(source_targets(totals, weights, cap), "targets"), cap)
    # sources without words have no level
    levels = staged(totals.select("source", "source_size").join(levels.select(F.col("source").alias("_l"), "target", "level"),
                                                               F.col("source").eqNullSafe(F.col("_l")), "left").select(
        F.col("source").alias("_s"), "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("level", F.lit(0.0)).alias("level")), "source-levels")
    rows = slim.join(small_side(levels), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("expected", F.when(F.col("size") > 0, F.least(F.col("level") * F.col("w"), F.lit(cap))).otherwise(0.0))
    rows = rows.withColumn("whole", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.col("whole"))
    rows = staged(rows, "odds")
    certain = staged(rows.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("whole") * F.col("size")).alias("certain")), "certain")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.join(small_side(certain), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("q", F.when(F.col("p") > 0, odds).otherwise(F.lit(float("inf"))))
    ranked = running_sum(rows.withColumn("open", F.when(F.col("p") > 0, F.col("size")).otherwise(0)), ["source"], ["q", "size", "rid"], "open", "upto")
    # the document at the border is taken where that comes nearer to the rest than leaving it
    drawn = (F.col("p") > 0) & (F.col("upto") - F.col("size") / 2 <= F.col("target") - F.col("certain"))
    copies = F.col("whole") + drawn.cast("long")
    return ranked.select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", "expected", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), *[F.col(f"_keep_{c}").alias(c) for c in keep])
