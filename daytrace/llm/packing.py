"""Packing of tokenised documents into sequences under several capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .tokens import prefix_counts

CHUNK = 1 << 16


def tokenised_pieces(
    docs: DataFrame,
    path: str,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    capacity: int = 1024,
    end_id: int = 2,
    ids: bool = False,
) -> DataFrame:
    """One row per piece of a document's ids and ``end_id``: piece, start, length, ids_crc32, and the ids
    themselves (little-endian unsigned 32 bit) with ``ids``.  A document of more than ``capacity`` ids
    is cut into pieces of ``capacity``; its first piece is the shorter one."""
    made = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    made += [("ids", T.BinaryType())] if ids else []
    names = [n for n, _ in made]
    kept = [c for c in keep if c not in names]
    slim = docs.select(*kept, F.col(text).alias("_text"))
    schema = T.StructType([slim.schema[c] for c in kept] + [T.StructField(n, t) for n, t in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counts(path)
        for batch in batches:
            rows: list[int] = []
            out: list[list] = [[] for _ in made]
            for row, value in enumerate(batch.column("_text")):
                got = np.append(counter.encode(value.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(got) % capacity or capacity
                edges = [0, *range(min(first, len(got)), len(got) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    raw = got[a:b].tobytes()
                    rows.append(row)
                    for col, v in zip(out, (k, a, b - a, zlib.crc32(raw), raw)):
                        col.append(v)
            take = pa.array(rows, pa.int64())
            cols = [batch.column(c).take(take) for c in kept]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            cols += [pa.array(v, k) for v, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *names])

    return slim.mapInArrow(run, schema)


def plan_bins(
    lengths: np.ndarray,
    counts: np.ndarray,
    capacity: tuple[int, int, int],
    select: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0),
) -> np.ndarray:
    """Best fit of equal pieces by the thousand.

    A piece of n tokens needs (n tokens, 1 document, n * n attention cost) of a bin that offers
    ``capacity`` of them.  Lengths come longest first; all pieces of one length go together.  Bins with
    equal contents form one class, so a step looks at classes of residual capacities, takes the one
    that can hold the piece under every constraint and has, with the piece in, the least weighted
    residual norm (``norm``) or, before, the largest weighted dot product of needs and used capacity
    (``dot``), and fills as many of its bins as there are pieces for, each with as many as it holds.
    An empty bin is opened when no class fits.

    Returns int64 rows (length, first, count, bin, per_bin, offset): pieces ``first`` .. ``first + count``
    of this length lie ``per_bin`` together in bins from ``bin`` on, the first of each at ``offset``.
    """
    cap = np.array(capacity, np.float64)
    w = np.array(weights) / cap
    left = np.empty((0, 3))  # residual capacities of each class
    size = np.empty(0, np.int64)  # bins of each class
    base = np.empty(0, np.int64)  # number of the first bin of each class
    plan: list[tuple[int, ...]] = []
    bins = 0
    for n, todo in sorted(zip(lengths.tolist(), counts.tolist()), reverse=True):
        need = np.array([n, 1, n * n], np.float64)
        most = int(min(cap // need))
        if most < 1:
            raise ValueError(f"a piece of {n} tokens fits no empty bin")
        done = 0
        while done < todo:
            fits = np.flatnonzero((left >= need).all(1))
            if len(fits):
                room = left[fits]
                if select == "dot":
                    k = fits[np.lexsort((base[fits], -((cap - room) * w * w * need).sum(1)))[0]]
                else:
                    k = fits[np.lexsort((base[fits], (((room - need) * w) ** 2).sum(1)))[0]]
                here, start, number = left[k], int(base[k]), int(size[k])
                keep = np.arange(len(size)) != k
                left, size, base = left[keep], size[keep], base[keep]
            else:
                here, start = cap, bins
                number = -(-(todo - done) // most)
                bins += number
            each = int(min(here // need))
            full = min(number, (todo - done) // each)
            used = [(full, each)] if full else []
            rest = min(each, todo - done - full * each) if full < number else 0
            used += [(1, rest)] if rest else []
            new = []
            for many, per in used:
                plan.append((n, done, many * per, start, per, int(cap[0] - here[0])))
                new.append((here - per * need, many, start))
                done += many * per
                start += many
                number -= many
            if number:
                new.append((here, number, start))
            for room, many, at in new:
                if room[0] >= 1 and room[1] >= 1:
                    left = np.vstack([left, room])
                    size, base = np.append(size, many), np.append(base, at)
    return np.array(plan, np.int64).reshape(-1, 6)


def pack(
    docs: DataFrame,
    path: str,
    scratch: Scratch,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    capacity: int = 1024,
    max_docs: int = 1024,
    max_cost: int = 1024 * 1024,
    select: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0),
    end_id: int = 2,
    ids: bool = False,
) -> DataFrame:
    """Packs documents into sequences of at most ``capacity`` tokens, ``max_docs`` pieces and
    ``max_cost`` attention cost (sum of squared lengths) by vector best fit; see ``plan_bins``.

    Pieces with equal needs are interchangeable, so the choice of bins needs only how many pieces there
    are of each length: at most ``capacity`` rows, whatever the corpus.  That plan (its size depends on
    ``capacity`` alone) is applied to all pieces in parallel, by each piece's number within its length;
    long runs of one length are numbered in chunks.  With the default limits only tokens bind.

    Returns the columns of ``keep`` (replaced where a result column has the name), piece, start, length,
    ids_crc32, sequence_id, offset, and ids on request.  Null text counts as empty: one piece with the
    end id alone.  Repeated rows are packed once each.  An empty table gives an empty result.
    """
    pieces = tokenised_pieces(
        docs, path, text=text, keep=keep, capacity=capacity, end_id=end_id, ids=ids
    ).drop("sequence_id", "offset")
    pieces = scratch.put(pieces.withColumn("_chunk", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    chunk = F.concat_ws("/", "_chunk", F.shiftright("_at", 16) % CHUNK)
    pieces = pieces.withColumn("_chunk", chunk)
    sizes = pieces.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = scratch.put(
        sizes.select("length", "_chunk", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    counts = sizes.groupBy("length").agg(F.sum("_n").alias("n")).toPandas()  # at most `capacity` rows
    plan = plan_bins(
        counts["length"].to_numpy(np.int64), counts["n"].to_numpy(np.int64), (capacity, max_docs, max_cost), select, weights
    )
    offsets = sizes.select(F.col("length").alias("_l"), F.col("_chunk").alias("_c"), "_before")
    local = Window.partitionBy("length", "_chunk").orderBy("_at")
    numbered = (
        pieces.withColumn("_nth", F.row_number().over(local) - 1)
        .join(offsets, (F.col("length") == F.col("_l")) & (F.col("_chunk") == F.col("_c")))
        .withColumn("_nth", F.col("_nth") + F.col("_before"))
        .drop("_l", "_c", "_chunk", "_at", "_before")
    )
    return _placed(numbered, plan)


def _placed(numbered: DataFrame, plan: np.ndarray) -> DataFrame:
    """Applies a plan: piece number _nth of its length goes to the bin the plan has for it."""
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    key = (plan[:, 0] << 44) + plan[:, 1]
    out = [f for f in numbered.schema.fields if f.name != "_nth"]
    schema = T.StructType([*out, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            nth = batch.column("_nth").to_numpy()
            p = plan[np.searchsorted(key, (length << 44) + nth, side="right") - 1]
            within = nth - p[:, 1]
            sequence = p[:, 3] + within // p[:, 4]
            offset = p[:, 5] + within % p[:, 4] * length
            cols = [batch.column(f.name) for f in out] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return numbered.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of a packing with ``ids``: sequence_id and its ids, pieces in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )
