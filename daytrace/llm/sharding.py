"""Shards of near equal bytes by sampled splitters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import Scratch, utf8_size

TEXT_BITS, ROW_BITS = 40, 23


def assign_shards(
    docs: DataFrame,
    scratch: Scratch,
    *,
    shards: int = 8,
    text: str = "text",
    row_key: str = "doc_id",
    keep: tuple[str, ...] = ("doc_id",),
    ranges: int = 1024,
    samples: int = 32_768,
    whole: float = 0.01,
) -> DataFrame:
    """Puts every row into one of ``shards`` shards of near equal bytes (law ``bytes``).

    A row's size is the UTF-8 bytes of its text plus 1.  Its sort key is a hash of the text, then of
    ``row_key`` and the row's number, so equal texts are neighbours and can be cut anywhere, also where
    ids are null or repeated.  Keys are sampled with a chance in proportion to
    size (about ``samples`` of them, the bound on what the driver sees), their quantiles split the
    keys into ``ranges`` ranges, and a range that turns out to hold over twice its share of bytes or
    rows is split again by keys drawn inside it.  Ranges are then dealt to tasks; exact running sums
    inside and between them give each row its place, and a row goes to the shard that holds the
    middle of its bytes in that order.  A group of equal texts of at most ``whole`` of a shard
    follows the middle of the group, so it is not cut; larger groups are cut.  Shards differ by at
    most twice ``whole`` of their size or one row.

    Returns the columns of ``keep``, then size, text_crc32, law, shard, slot (the row's place in its
    shard, gapless from 0) and grown_shard (null: it belongs to another law); columns of ``keep`` with
    these names are replaced.  A null text has size 1 and the checksum of no bytes, 0.  Null keys are
    values like any other; repeated rows are rows of their own; equal keys take any order among
    themselves.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in keep if c not in made]
    head = F.xxhash64(F.col(text), F.col(text).isNull()).bitwiseAND(F.lit((1 << TEXT_BITS) - 1))
    tail = F.xxhash64(F.lit("row"), F.col(row_key), F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    slim = scratch.put(
        docs.select(
            *kept,
            (utf8_size(F.col(text)) + 1).alias("size"),
            F.coalesce(F.crc32(F.encode(F.col(text), "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
            (head * F.lit(1 << ROW_BITS) + tail).alias("_key"),
            F.rand(17).alias("_draw"),
        )
    )
    n, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    step = max(1.0, total / samples)
    drawn = slim.select("_key", F.floor(F.col("size") / step + F.col("_draw")).alias("_times")).where("_times > 0")
    cuts = np.unique(_quantiles(drawn.toPandas(), ranges) >> ROW_BITS << ROW_BITS)  # where a text begins

    for _ in range(3):
        counted = slim.groupBy(_range_of(cuts)("_key").alias("_range")).agg(
            F.sum("size").alias("_bytes"), F.count("*").alias("_rows")
        )
        full = counted.where(
            (F.col("_bytes") > 2.0 * total / ranges) & (F.col("_rows") > 1) | (F.col("_rows") > 2.0 * n / ranges + 64)
        ).toPandas()
        inner = _split(slim, cuts, full, total / ranges, n / ranges, samples)
        more = np.unique(np.concatenate([cuts, inner]))
        if len(more) == len(cuts):
            break
        cuts = more

    placed = slim.withColumn("_range", _range_of(cuts)("_key"))
    by_range = Window.partitionBy("_range")
    order = by_range.orderBy("_key")
    same = Window.partitionBy("_range", "_group")
    in_range = placed = scratch.put(
        placed.withColumn("_group", F.shiftright("_key", ROW_BITS))
        .withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_nth", F.row_number().over(order))
        .withColumn("_group_from", F.min(F.col("_end") - F.col("size")).over(same))
        .withColumn("_group_to", F.max("_end").over(same))
    )
    # one row per range
    sums = placed.groupBy("_range").agg(F.sum("size").alias("_b"), F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
    )
    per_shard = total / shards
    group = F.col("_group_to") - F.col("_group_from")
    middle = F.when(
        group <= whole * per_shard, F.col("_b0") + (F.col("_group_from") + F.col("_group_to")) / 2
    ).otherwise(F.col("_b0") + F.col("_end") - F.col("size") / 2)
    placed = placed.join(offsets, F.col("_range") == F.col("_r")).select(
        *kept,
        "size",
        "text_crc32",
        F.least(F.floor(middle / max(per_shard, 1e-9)), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("_n0") + F.col("_nth") - 1).alias("_at"),
    )
    placed = scratch.put(placed)
    scratch.drop(slim, in_range)
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first")).withColumnRenamed("shard", "_s")
    return placed.join(F.broadcast(first), F.col("shard") == F.col("_s")).select(  # one row per shard
        *kept,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_at") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, scratch: Scratch, **options) -> None:
    """Writes whole rows below ``path``/shard=N, in the order of their slots."""
    placed = assign_shards(docs, scratch, keep=tuple(docs.columns), **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


def _quantiles(drawn: pd.DataFrame, parts: int) -> np.ndarray:
    """Boundaries between ``parts`` parts of equal weight; drawn: _key and how often it was drawn."""
    if not len(drawn):
        return np.empty(0, np.int64)
    d = drawn.sort_values("_key")
    weight = d["_times"].to_numpy().cumsum()
    at = np.searchsorted(weight, np.arange(1, parts) * (weight[-1] / parts))
    return np.unique(d["_key"].to_numpy()[np.minimum(at, len(d) - 1)])


def _range_of(cuts: np.ndarray):
    @pandas_udf("long")
    def of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right"))

    return of


def _split(slim, cuts, full: pd.DataFrame, share: float, rows: float, samples: int) -> np.ndarray:
    """Boundaries inside overfull ranges, from rows drawn there: as many parts as the range is over its
    share of bytes or rows."""
    if not len(full):
        return np.empty(0, np.int64)
    parts = np.ceil(np.maximum(full["_bytes"] / share, full["_rows"] / max(rows, 1))).astype(int)
    parts_of = dict(zip(full["_range"], parts))
    chance = min(1.0, samples / float(full["_rows"].sum()))
    inside = slim.withColumn("_range", _range_of(cuts)("_key")).where(
        F.col("_range").isin([int(r) for r in parts_of])
    )
    drawn = inside.where(F.rand(29) < chance).select("_range", "_key", F.lit(1).alias("_times")).toPandas()
    inner = np.concatenate(
        [np.empty(0, np.int64), *(_quantiles(d, parts_of[r]) for r, d in drawn.groupby("_range"))]
    ).astype(np.int64)
    text, times = np.unique(inner >> ROW_BITS << ROW_BITS, return_counts=True)
    large = text[times > 1]  # one text fills several parts: cut it between rows
    return np.concatenate([text, inner[np.isin(inner >> ROW_BITS << ROW_BITS, large)]])
