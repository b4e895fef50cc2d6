"""Near-duplicate vectors by hashing to points of the E8 lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, grouped
from .components import components

#: Steps per lattice unit to which projections are rounded; all later decisions are exact integers.
GRID = 64


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, times 2: all vectors of two entries +-2 and all of eight entries
    +-1 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-2, 2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(s) for s in product((-1, 1), repeat=8) if np.prod(s) == 1]
    return np.array(out, np.int64)


ROOTS = roots()


def nearest(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point, times 2, of points given in GRID steps: the nearer of the nearest points of
    D8 (integers of even sum) and of D8 shifted by a half in every entry."""

    def d8(z: np.ndarray) -> np.ndarray:  # z in grid steps
        r = np.floor_divide(2 * z + GRID, 2 * GRID)
        off = z - r * GRID
        k = np.abs(off).argmax(1)
        odd = np.flatnonzero(r.sum(1) % 2)
        r[odd, k[odd]] += np.where(off[odd, k[odd]] >= 0, 1, -1)
        return r

    whole = 2 * d8(y)
    half = 2 * d8(y - GRID // 2) + 1
    return np.where((distance(y, whole) <= distance(y, half))[:, None], whole, half)


def distance(y: np.ndarray, point2: np.ndarray) -> np.ndarray:
    """Squared distance, in squared grid steps, of points to doubled lattice points."""
    d = y - point2 * (GRID // 2)
    return (d * d).sum(-1)


def pack_cell(point2: np.ndarray) -> np.ndarray:
    """A doubled lattice point as one integer, a byte per entry."""
    return np.ascontiguousarray(point2.astype(np.int8)).view(np.int64).reshape(-1)


class Lattice:
    """``tables`` random projections to 8 dimensions, in units of ``width``, each with its shift."""

    def __init__(self, tables: int, width: float, radius: float, seed: int):
        self.tables, self.width, self.seed = tables, width, seed
        self.reach = int(radius * radius * GRID * GRID)
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def project(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables, 8) grid steps of unit vectors."""
        d = unit.shape[1]
        if d not in self.made:
            rng = np.random.default_rng([self.seed, d])
            self.made[d] = (rng.normal(size=(d, self.tables * 8)) / self.width, rng.uniform(-0.5, 0.5, self.tables * 8))
        g, shift = self.made[d]
        y = np.rint(np.clip(unit @ g + shift, -60, 60) * GRID)
        return y.astype(np.int16).reshape(len(unit), self.tables, 8)

    def cells(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For one table's (n, 8) points: row, cell and whether it is the row's own cell, for the own cell and
        every neighbouring cell whose centre is within the radius."""
        y = y.astype(np.int64)
        own = nearest(y)
        off = (y - own * (GRID // 2)).astype(np.float64)  # whole numbers, exact
        far = (off * off).sum(1)[:, None] - (off @ ROOTS.T) * GRID + 2 * GRID * GRID
        row, root = np.nonzero(far <= self.reach)
        n = len(y)
        return (
            np.concatenate([np.arange(n), row]),
            pack_cell(np.concatenate([own, own[row] + ROOTS[root]])),
            np.concatenate([np.ones(n, bool), np.zeros(len(row), bool)]),
        )


def link_vectors(
    rows: DataFrame,
    scratch: Scratch,
    *,
    row_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least: float = 0.93,
    tables: int = 4,
    width: float = 1.5,
    radius: float = 1.1,
    chunk: int = 512,
    seed: int = 8,
) -> DataFrame:
    """Links rows of equal label whose vectors have a cosine of at least ``least``.

    Equal vectors of a label form one class, which takes part once with its number of rows.  Each
    class is projected at random in ``tables`` tables and posted to the E8 cell of its point and to the
    neighbouring cells within ``radius``.  Two classes meet in a cell that is the own cell of at least
    one of them; their cosine decides.  A pair that meets several times counts only in its first table
    (and there in the cell of the smaller digest), which both sides work out from their points, so links
    are counted where they are found and no list of pairs is written.  Cells of more than ``chunk`` posts
    are split into pairs of chunks that go to different tasks.  A pair at cosine 0.93 is missed with
    a chance of about 3 in 10,000, nearer pairs less often.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest id reachable, itself
    included) and kept (vec_id = component_id).  Vectors that are null, zero, or hold null or non-finite
    components, and rows without label, link with nothing and stand for themselves; vectors of
    different lengths do not link.  Repeated rows link with each other.  A null id gets a null
    component_id unless others are reachable, and is not kept.
    """
    lattice = Lattice(tables, width, radius, seed)
    slim = rows.select(
        F.col(row_id).cast("long").alias("vec_id"),
        F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs = [], []
            for lab, value in zip(batch.column("label").to_pylist(), batch.column("v")):
                key, raw = None, None
                if lab is not None and value.is_valid and len(value) and not value.values.null_count:
                    x = value.values.to_numpy(zero_copy_only=False) + 0.0
                    norm = np.sqrt(x @ x)
                    if np.isfinite(norm) and norm > 0:
                        raw = x.tobytes()
                        key = hashlib.md5(lab.encode() + b"\0" + raw).digest()
                keys.append(key)
                vecs.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())],
                names=["vec_id", "label", "key", "raw"],
            )

    known = scratch.put(slim.mapInArrow(digest, "vec_id long, label string, key binary, raw binary"))
    classes = known.where("key is not null").groupBy("key").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("raw").alias("raw")
    )

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            points: list[bytes] = [b""] * len(raws)
            for part in _by_length(raws):
                x, norm = unit_rows([raws[i] for i in part])
                for i, y in zip(part, lattice.project(x / norm[:, None])):
                    points[i] = y.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(points, pa.binary())], names=[*batch.schema.names, "y"])

    classes = classes.select("key", "copies", "first", F.xxhash64("label").alias("lab"), "raw")
    # projected once: every later step sees the same points
    classes = scratch.put(
        classes.mapInArrow(project, "key binary, copies long, first long, lab long, raw binary, y binary")
    )

    found = scratch.put(_meet(classes, lattice, least, chunk, scratch))
    links = found.groupBy("key").agg(F.sum("links").alias("_links"))
    comps = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")), scratch)
    own = classes.select("key", "copies", "first").join(links, "key", "left").join(comps.toDF("key", "root"), "key", "left")
    own = scratch.put(own.withColumn("root", F.coalesce("root", "key")))
    scratch.drop(classes, found)
    least_id = own.groupBy("root").agg(F.min("first").alias("component"))
    per_class = own.join(least_id, "root").select(
        F.col("key").alias("_key"), (F.col("copies") - 1 + F.coalesce("_links", F.lit(0))).alias("n"), "component"
    )
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return known.join(per_class, F.col("key") == F.col("_key"), "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def unit_rows(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([np.frombuffer(r) for r in raws])
    return x, np.sqrt((x * x).sum(1))


def _by_length(raws: list[bytes]) -> Iterator[np.ndarray]:
    size = np.array([len(r) for r in raws])
    for s in np.unique(size):
        yield np.flatnonzero(size == s)


def _meet(classes: DataFrame, lattice: Lattice, least: float, chunk: int, scratch: Scratch) -> DataFrame:
    """(key, links, other): per class and cell the rows linked there, and a class it is connected with."""
    tables = lattice.tables

    def points(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("y").to_pylist()), np.int16).reshape(-1, tables, 8)

    def posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = points(batch)
            for t in range(tables if len(y) else 0):
                row, cell, _ = lattice.cells(y[:, t])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lab").take(take), pa.array(np.full(len(row), t, np.int32)), pa.array(cell), batch.column("key").take(take)],
                    names=["lab", "t", "cell", "key"],
                )

    slim = classes.select("lab", "key", "y").mapInArrow(posts, "lab long, t int, cell long, key binary")
    where = ["lab", "t", "cell"]
    large = scratch.put(
        slim.groupBy(*where).count().where(F.col("count") > chunk).select(*where, F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    )
    split = slim.join(large, where).groupBy("key").agg(F.collect_list(F.struct("t", "cell", "parts")).alias("split"))
    full = classes.select("key", "lab", "copies", "raw", "y").join(split, "key", "left")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = points(batch)
            if not len(y):
                continue
            chunk_of = [int.from_bytes(k[:8], "big") for k in batch.column("key").to_pylist()]
            splits = [{(s["t"], s["cell"]): s["parts"] for s in v or ()} for v in batch.column("split").to_pylist()]
            own = np.stack([nearest(y[:, t].astype(np.int64)) for t in range(tables)], 1).astype(np.int8)
            owns = pa.array([o.tobytes() for o in own], pa.binary())
            for t in range(tables):
                row, cell, home = lattice.cells(y[:, t])
                out = []
                for i, (r, c) in enumerate(zip(row.tolist(), cell.tolist())):
                    parts = splits[r].get((t, c), 1)
                    mine = chunk_of[r] % parts
                    out += [(i, min(mine, p) << 20 | max(mine, p), mine) for p in range(parts)]
                for at in range(0, len(out), 4096):
                    i, pair, mine = np.array(out[at : at + 4096], np.int64).T
                    take = pa.array(row[i])
                    cols = [pa.array(np.full(len(i), t)), pa.array(cell[i]), pa.array(pair), pa.array(mine), pa.array(home[i])]
                    carried = [batch.column(c).take(take) for c in ("key", "copies", "raw", "y")]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("lab").take(take), *cols, *carried, owns.take(take)],
                        names=["lab", "t", "cell", "pair", "mine", "home", "key", "copies", "raw", "y", "own"],
                    )

    dealt = full.mapInArrow(
        deal,
        "lab long, t long, cell long, pair long, mine long, home boolean, key binary, copies long, raw binary, y binary, own binary",
    )
    group = ["lab", "t", "cell", "pair"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches, group):
            if cell.num_rows > 1:
                out = _cell_links(cell, lattice, least)
                if out is not None:
                    yield out

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(meet, "key binary, links long, other binary")


def _cell_links(cell: pa.Table, lattice: Lattice, least: float) -> pa.RecordBatch | None:
    """Links that count in this cell, between two chunks of its posts or within one."""
    home = cell["home"].to_numpy()
    if not home.any():
        return None
    t, pair, mine = cell["t"][0].as_py(), cell["pair"][0].as_py(), cell["mine"].to_numpy()
    raws, keys = cell["raw"].to_pylist(), cell["key"].to_pylist()
    copies = cell["copies"].to_numpy()
    cross = (pair >> 20) != (pair & ((1 << 20) - 1))
    left, right = [], []
    for part in _by_length(raws):
        x, norm = unit_rows([raws[i] for i in part])
        near = (x @ x.T) / np.outer(norm, norm) >= least
        near = np.triu(near, 1) & (home[part][:, None] | home[part][None, :])
        if cross:
            near &= mine[part][:, None] != mine[part][None, :]
        i, j = np.nonzero(near)
        left.append(part[i])
        right.append(part[j])
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return None
    n = len(keys)
    y = np.frombuffer(b"".join(cell["y"].to_pylist()), np.int16).reshape(n, lattice.tables, 8).astype(np.int64)
    own = np.frombuffer(b"".join(cell["own"].to_pylist()), np.int8).reshape(n, lattice.tables, 8).astype(np.int64)
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=keys.__getitem__)] = np.arange(n)

    def probes(a: np.ndarray, b: np.ndarray, s: int) -> np.ndarray:
        """Whether rows a were posted to the neighbouring own cells of rows b in table s."""
        gap = own[a, s] - own[b, s]
        return ((gap * gap).sum(1) == 8) & (distance(y[a, s], own[b, s]) <= lattice.reach)

    counts = np.ones(len(i), bool)
    for s in range(t):
        counts &= ~((own[i, s] == own[j, s]).all(1) | probes(i, j, s) | probes(j, i, s))
    here = np.where(home[i], i, j)  # its own cell is this one
    there = np.where(home[i], j, i)
    both = home[i] & home[j]
    counts &= both | ~probes(here, there, t) | (rank[here] < rank[there])
    i, j = i[counts], j[counts]
    if not len(i):
        return None
    links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([keys[k] for k in some], pa.binary()),
            pa.array(links[some].astype(np.int64)),
            pa.array([keys[low[k]] if low[k] != k else None for k in some], pa.binary()),
        ],
        names=["key", "links", "other"],
    )
