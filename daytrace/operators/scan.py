"""Ordered scans over groups of any size.

A window over a device's history or day would put all of it in one task.  Every group is
therefore cut into time chunks of a fixed width: the window runs inside a chunk, one small row
per chunk carries what the next (or earlier) chunks need, and the two are joined.  The chunk
rows of one group are bounded by its time span / chunk width, however many events it holds.
There is no other path; the width does not change the rows.

Everything one order needs belongs into one call: values carried along and the runs of rows that
belong together are found in the same pass, with one table of chunk rows and one join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

CHUNK = "chunk_id"


def chunked(df: DataFrame, keys: list[str], us: str, width_us: int) -> DataFrame:
    """Add the chunk id and place rows by (keys, chunk); later scans reuse this exchange."""
    df = df.withColumn(CHUNK, F.floor(F.col(us) / F.lit(width_us)).cast("long"))
    return df.repartition(*keys, CHUNK)


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    joins: Callable[[Column, Column], Column] | None = None,
    uses: tuple[str, ...] = (),
    next_island: bool = False,
    **cols: tuple[str, Column],
) -> DataFrame:
    """Add ordered-scan columns to a frame from ``chunked``.  ``order`` must be unique per group.

    Kinds: ``last`` = newest non-null value up to the row, ``before`` = same without the row,
    ``after`` = first non-null value of later rows, ``lead`` = next row's value (never null in
    the data), ``sum`` = running sum, ``max_before`` = largest value of earlier rows, ``all_max`` =
    largest value of the whole group.

    ``joins(previous, row)`` says of two neighbours, given as structs of the columns ``order`` and
    ``uses``, that the row goes on with the previous one's island (null: it does not).  It adds
    ``island``, the ``order`` of the island's first row as a struct, and with ``next_island`` that of the
    next island, null for the last one.
    """
    part = [*keys, CHUNK]
    up = Window.partitionBy(*part).orderBy(*order)
    down = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    to_row = up.rowsBetween(Window.unboundedPreceding, 0)
    to_prev = up.rowsBetween(Window.unboundedPreceding, -1)
    from_next = down.rowsBetween(Window.unboundedPreceding, -1)

    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    past = chunks.rowsBetween(Window.unboundedPreceding, -1)
    future = (
        Window.partitionBy(*keys)
        .orderBy(F.col(CHUNK).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    columns = df.columns

    local, edges, carried, merged = {}, [], [], {}
    for name, (kind, expr) in cols.items():
        mine, theirs = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        at = F.when(expr.isNotNull(), F.struct(*order, expr.alias("v")))
        if kind in ("last", "before"):
            local[f"_l_{name}"] = F.last(expr, True).over(to_row if kind == "last" else to_prev)
            edge, carry = F.max(at)["v"], lambda e: F.last(e, True).over(past)
            merged[name] = F.coalesce(mine, theirs)
        elif kind in ("after", "lead"):
            local[f"_l_{name}"] = (
                F.last(expr, True).over(from_next) if kind == "after" else F.lead(expr).over(up)
            )
            edge, carry = F.min(at)["v"], lambda e: F.last(e, True).over(future)
            merged[name] = F.coalesce(mine, theirs)
        elif kind == "sum":
            local[f"_l_{name}"] = F.sum(expr).over(to_row)
            edge, carry = F.sum(expr), lambda e: F.sum(e).over(past)
            merged[name] = F.coalesce(mine, F.lit(0)) + F.coalesce(theirs, F.lit(0))
        elif kind == "max_before":
            local[f"_l_{name}"] = F.max(expr).over(to_prev)
            edge, carry = F.max(expr), lambda e: F.max(e).over(past)
            merged[name] = F.greatest(mine, theirs)
        elif kind == "all_max":
            edge, carry = F.max(expr), lambda e: F.max(e).over(Window.partitionBy(*keys))
            merged[name] = theirs
        else:
            raise ValueError(kind)
        edges.append(edge.alias(f"_e_{name}"))
        carried.append(carry(F.col(f"_e_{name}")).alias(f"_c_{name}"))

    extra = []
    if joins is not None:
        first = F.struct(*order)
        here = F.struct(*order, *[c for c in uses if c not in order])
        df = df.withColumn("_p", F.lag(here).over(up))
        starts = F.col("_p").isNotNull() & ~F.coalesce(joins(F.col("_p"), here), F.lit(False))
        # heads of islands; whether a chunk's first row is one is not known inside the chunk
        df = df.withColumn("_head", F.when(starts, first)).drop("_p")
        extra = ["_head"]
        local["_l_island"] = F.last("_head", True).over(to_row)
        edges += [F.min(here).alias("_e_first"), F.max(here).alias("_e_last")]
        edges += [F.min("_head").alias("_e_low"), F.max("_head").alias("_e_high")]
        opening = F.struct(*[F.col(f"_e_first.{c}").alias(c) for c in order])
        goes_on = F.col("_e_goes_on")
        carried.append(
            F.when(goes_on, F.last(F.coalesce("_e_high", F.when(~goes_on, opening)), True).over(past))
            .otherwise(opening).alias("_c_island")
        )
        merged["island"] = F.coalesce("_l_island", "_c_island")
        if next_island:
            local["_l_next"] = F.last("_head", True).over(from_next)
            lowest = F.when(goes_on, F.col("_e_low")).otherwise(opening)
            carried.append(F.last(lowest, True).over(future).alias("_c_next"))
            merged["next_island"] = F.coalesce("_l_next", "_c_next")

    carry_rows = df.groupBy(*part).agg(*edges)
    if joins is not None:
        carry_rows = carry_rows.withColumn("_e_prev", F.lag("_e_last").over(chunks))
        goes_on = F.col("_e_prev").isNotNull() & joins(F.col("_e_prev"), F.col("_e_first"))
        carry_rows = carry_rows.withColumn("_e_goes_on", F.coalesce(goes_on, F.lit(False)))
    carry_rows = carry_rows.select(*part, *carried)
    return (
        df.withColumns(local)
        .join(carry_rows, part)
        .drop(*extra)
        .select(*columns, *[c.alias(n) for n, c in merged.items()])
    )
