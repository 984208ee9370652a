"""Cross-site line removal by distinct-site spread (operator 8).

Every line's hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge by
aggregation, before and after the shuffle, so a line found in a third of all documents
reaches its reducer as one sketch a task. Lines whose estimate lies clearly above the
threshold are boilerplate; for lines near it the distinct sites are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.storage import staged, unused
from docweave.session import spread

_BLANK = "' \\t\\r\\u000b\\u000c'"


def _line_rows(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """(t1, t2: hash of the text; h1, h2: hash of the line; pos; site) for every line that is not blank."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(site_col).alias("site"), text.alias("text")).select(
        "site", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", F.expr(f"trim(BOTH {_BLANK} FROM line)")).where(F.col("line") != "")
    return lines.select("t1", "t2", "pos", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate_lines(lines: DataFrame, min_sites: int, margin: float, lg_k: int) -> DataFrame:
    """(b1, b2): hashes of the lines found on ``min_sites`` distinct sites or more. Exact near the threshold."""
    spread_ = lines.where(F.col("site").isNotNull()).groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    wide = max(2.0, margin * min_sites)
    rough = staged(spread_.where(F.col("sites") >= min_sites - wide).select(
        F.col("h1").alias("b1"), F.col("h2").alias("b2"), "sites"), "spread")
    near = rough.where(F.col("sites") < min_sites + wide).select("b1", "b2")
    exact = lines.where(F.col("site").isNotNull()).join(near, (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2")), "left_semi") \
        .select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return staged(rough.where(F.col("sites") >= min_sites + wide).select("b1", "b2").union(exact.select("h1", "h2")), "boilerplate")


def remove_boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = 10,
                       margin: float = 0.25, lg_k: int = 10) -> DataFrame:
    """``docs`` with the cleaned ``text`` and two columns: n_lines and n_removed.

    Lines are compared without white space at their ends; blank lines stay. ``margin``
    (of ``min_sites``, 2 sites at least) is the zone that is counted exactly: several
    standard errors of a sketch with 2^``lg_k`` registers. A null site is no site; a null
    text becomes empty (one blank line); repeated rows are cleaned alike; no rows give none.
    Texts are joined with their hits by a hash of the text, so copies share one row there.
    Other columns pass through whatever their names; n_lines and n_removed replace such of ``docs``.
    """
    lines = staged(_line_rows(spread(docs), text_col, site_col), "lines")
    bad = boilerplate_lines(lines, min_sites, margin, lg_k)
    hits = lines.join(bad, (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2")), "left_semi").select("t1", "t2", "pos").distinct()
    # one row for each text that has hits; its positions number its lines at most
    t1, t2, h1, h2, found = unused(docs, "_t1", "_t2", "_h1", "_h2", "_hits")
    hits = staged(hits.groupBy("t1", "t2").agg(F.collect_list("pos").alias(found)).select(
        F.col("t1").alias(h1), F.col("t2").alias(h2), found), "line-hits")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn(t1, F.xxhash64(text)).withColumn(t2, F.xxhash64(F.lit(1), text))
    joined = keyed.join(hits, (F.col(t1) == F.col(h1)) & (F.col(t2) == F.col(h2)), "left")
    split = F.split(text, "\n", -1)
    # positions as a set difference, and the lines bound once: linear in the text's lines
    left = F.transform(F.array(split), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(found)), lambda i: F.get(lines, i)), "\n"))[0]
    return joined.withColumn("n_lines", F.size(split).cast("long")).withColumn(
        "n_removed", F.coalesce(F.size(found), F.lit(0)).cast("long")).withColumn(
        text_col, F.when(F.col(found).isNull(), text).otherwise(left)).drop(t1, t2, h1, h2, found)
