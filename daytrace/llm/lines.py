"""Removal of lines that many sites share, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def dedup_lines(
    docs: DataFrame,
    scratch: Scratch,
    *,
    text: str = "text",
    site: str = "source",
    row_key: str = "doc_id",
    min_sites: int = 10,
    lg_k: int = 12,
    band: float = 0.1,
) -> DataFrame:
    """Keeps one copy of every line that occurs on at least ``min_sites`` distinct sites.

    Lines are cut at line feeds and compared as they are, by a 64-bit hash.  A HyperLogLog sketch of
    the sites of each line hash is merged by aggregation.  Estimates that differ from ``min_sites`` by
    no more than max(1, ``band`` * min_sites), six standard errors with ``lg_k`` = 12, are settled by an
    exact distinct count; only those lines are counted again.  The copy in the first document (by
    ``row_key``, null first, then by a digest of site and text, then by place) stays; all others go.

    Returns all columns of ``docs`` with the text replaced, and lines (number of lines), removed
    (lines that went); input columns with these names are replaced.  Lines of white space alone are
    never removed.  A null text stays null with 0 lines; an empty text is one empty line.  A null site
    is no site.  Every row is a document of its own, also where keys are null, repeated, or whole rows
    are equal: rows are numbered once, in a table, and the places to cut come back by that number, so no
    task holds the rows of one key.  A line on a third of all rows is pre-aggregated before the
    shuffle, and the join that marks its copies can be split anywhere.
    """
    kept = [c for c in docs.columns if c not in ("lines", "removed")]
    row, of, cut, gone = "_line_row", "_line_of", "_line_cut", "_line_gone"
    base = scratch.put(docs.select(*kept).withColumn(row, F.monotonically_increasing_id()))
    lines = base.select(
        F.struct(F.col(row_key).alias("doc"), F.xxhash64(site, text).alias("digest"), F.col(row).alias("row")).alias("at"),
        F.col(site).alias("site"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    )
    lines = lines.where(F.col("line").rlike(r"\S")).select("at", "site", "pos", F.xxhash64("line").alias("h"))
    near = max(1.0, band * min_sites)
    sketch = F.hll_sketch_agg(F.col("site").cast("string"), F.lit(lg_k))
    copy = F.min(F.struct("at", "pos"))
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(sketch).alias("sites"), copy.alias("first"))
    spread = scratch.put(spread.where(F.col("sites") >= min_sites - near))
    unsure = F.col("sites") <= min_sites + near
    again = lines.join(spread.where(unsure).select("h"), "h", "left_semi")
    exact = again.groupBy("h").agg(F.countDistinct("site").alias("n"), copy.alias("first"))
    common = scratch.put(
        exact.where(F.col("n") >= min_sites).select("h", "first").union(spread.where(~unsure).select("h", "first"))
    )
    stays = (F.col("at.row") == F.col("first.at.row")) & (F.col("pos") == F.col("first.pos"))
    marks = lines.join(common, "h").where(~stays).groupBy(F.col("at.row").alias(of)).agg(F.collect_list("pos").alias(gone))

    split = base.withColumn(cut, F.split(text, "\n"))
    marked = split.drop(text).join(marks, F.col(row) == F.col(of), "left")
    n = F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut))
    left = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), gone)
    new_text = F.when(F.col(gone).isNull(), F.array_join(cut, "\n")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(cut, i)), "\n")
    )
    return marked.select(
        *[new_text.alias(c) if c == text else F.col(c) for c in kept],
        n.cast("long").alias("lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("removed"),
    )
