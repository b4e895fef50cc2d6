"""Near-duplicate texts by an inverted join on MinHash coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, grouped
from .components import components

REMEMBER_WORDS = 500_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; a bounded number is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``size`` words; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out * ODD + h[k : k + len(out)])
    return np.unique(out if n == size else mixed(out + np.uint64(n)))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def signature(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least of each seeded order of a set; 31 bits of it."""
    out = np.empty(len(seeds), np.int32)
    for k, seed in enumerate(seeds):
        out[k] = (((s ^ seed) * ODD) >> np.uint64(33)).min()
    return out


def link_texts(
    docs: DataFrame,
    scratch: Scratch,
    *,
    text: str = "text",
    row_key: str = "doc_id",
    shingle: int = 5,
    percent: int = 80,
    coordinates: int = 32,
    matches: int = 14,
    rounds: int = 2,
    short: int = 64,
    block: int = 512,
    seed: int = 1,
) -> DataFrame:
    """Groups documents whose shingle sets have 100 * intersection >= ``percent`` * union.

    Texts of equal word sequences form a class, which takes part once.  A class has ``coordinates``
    MinHash values and is posted under each (coordinate, value).  Two classes may link if at least
    ``matches`` values are equal (a pair at 0.8 falls short with a chance of about one in a million);
    such a pair shares a posting among the coordinates - matches + 1 rarest ones of each (rarest by the length of
    the posting list), so only that prefix is joined, and lists of frequent values are skipped.  The
    equal values of candidate pairs are then counted in full, and pairs above the threshold are
    confirmed on their full sets.

    Long lists do not yield all their pairs: first each member is compared with one leader of the list
    (the member whose values are most common, then one drawn by a hash, ``rounds`` in all), which joins
    most of a group of copies; afterwards all pairs of a list whose ends are still in different
    components are compared, so no link between components is left out.  Lists of up to ``short`` members
    give these pairs as rows; longer ones are cut into blocks, and every two blocks of a list are
    multiplied in one task, which returns only links that join components.

    Returns doc_id, n_shingles (set size), component_id (smallest id reachable, itself included) and
    kept (doc_id = component_id).  A null text or one without words has an empty set and links with
    nothing, also not with its equals; a text of fewer words than a shingle is one shingle.  Repeated rows are
    copies.  A null id gets the smallest id of its component, null if there is none, and is not kept.
    """
    rng = np.random.default_rng(seed)
    seeds = rng.integers(0, 2**63, coordinates, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for value in batch.column("text"):
                words = words_of(value.as_py())
                s = shingle_set(words, shingle, hashes)
                sizes.append(len(s))
                keys.append(hashlib.md5(b" ".join(words)).digest() if words else None)
                sigs.append(signature(s, seeds) if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))],
                names=["doc_id", "key", "n", "sig"],
            )

    texts = docs.select(F.col(row_key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = scratch.put(texts.mapInArrow(sign, "doc_id long, key binary, n long, sig array<int>"))
    classes = scratch.put(
        known.where("key is not null")
        .groupBy("key")
        .agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    )

    prefix = scratch.put(_prefix(classes, coordinates, matches))
    members = prefix.select("key").distinct()
    wanted = known.where("key is not null").join(members, "key", "left_semi")
    one_row = wanted.groupBy("key").agg(F.min(F.struct("doc_id")).alias("_first"))
    sets = scratch.put(_sets(texts, one_row, shingle))

    roots: DataFrame | None = None
    links: DataFrame | None = None
    for k in range(rounds + 1):
        posts = prefix
        if roots is not None:
            posts = posts.join(roots.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        else:
            posts = posts.withColumn("root", F.col("key"))
        if k < rounds:
            new = _confirmed(_leader_pairs(posts, k), classes, sets, matches, percent)
        else:
            lists = scratch.put(_open_lists(posts))
            new = _confirmed(_cross_pairs(posts, lists.where(F.col("size") <= short)), classes, sets, matches, percent)
            new = new.union(_block_links(posts, lists.where(F.col("size") > short), sets, block, percent))
        new = scratch.put(new)
        if new.isEmpty():
            continue
        links = new if links is None else links.union(new)
        roots = components(links, scratch)

    own = classes.select("key", "first")
    if roots is not None:
        own = own.join(roots.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    else:
        own = own.withColumn("root", F.col("key"))
    own = scratch.put(own)
    least = own.groupBy("root").agg(F.min("first").alias("component"))
    per_class = own.join(least, "root").select(F.col("key").alias("_key"), "component")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return known.join(per_class, F.col("key") == F.col("_key"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def _prefix(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(post, size, key, n, common): the postings of each class that its prefix keeps and another class
    shares; common tells how many postings its values share in all."""
    posts = classes.select("key", "n", F.posexplode("sig").alias("c", "v")).select(
        "key", "n", (F.col("c").cast("long") * F.lit(1 << 32) + F.col("v")).alias("post")
    )
    shared = posts.groupBy("post").agg(F.count("*").alias("size")).where("size > 1")
    mine = posts.join(shared, "post").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("size", "post"))).alias("p"))
    # values that nobody shares are the rarest and fill the prefix first
    common = F.aggregate("p", F.lit(0).cast("long"), lambda a, q: a + q["size"])
    return mine.where(F.size("p") >= matches).select(
        "key", "n", common.alias("common"), F.explode(F.slice("p", F.lit(1), F.size("p") - matches + 1)).alias("q")
    ).select("q.post", "q.size", "key", "n", "common")


def _leader_pairs(posts: DataFrame, k: int) -> DataFrame:
    """Each member of a list with the list's leader, once, if they are not in one component yet."""
    first = -F.col("common") if k == 0 else F.xxhash64(F.lit(k), "key")
    order = F.struct(first.alias("h"), "key", "root", "n")
    lead = posts.groupBy("post").agg(F.min(order).alias("lead"))
    pairs = posts.join(lead, "post").where(F.col("root") != F.col("lead.root"))
    return pairs.select(F.col("key").alias("a"), F.col("lead.key").alias("b"), F.col("n").alias("na"), F.col("lead.n").alias("nb")).distinct()


def _open_lists(posts: DataFrame) -> DataFrame:
    """(post, size, main): lists whose members are in several components, and the largest of these."""
    parts = posts.groupBy("post", "root").agg(F.count("*").alias("m"))
    lists = parts.groupBy("post").agg(
        F.sum("m").alias("size"), F.max_by("root", F.struct("m", "root")).alias("main"), F.count("*").alias("parts")
    )
    return lists.where("parts > 1").drop("parts")


def _cross_pairs(posts: DataFrame, lists: DataFrame) -> DataFrame:
    """All pairs of a list whose ends are in different components.  Members outside the list's largest
    component meet all members, so a large component does not meet itself."""
    some = posts.drop("size").join(lists, "post")
    left = some.where(F.col("root") != F.col("main")).select(
        "post", F.col("key").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na")
    )
    right = some.select("post", "main", F.col("key").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"))
    once = (F.col("rb") == F.col("main")) | (F.col("ra") < F.col("rb"))
    return left.join(right, "post").where((F.col("ra") != F.col("rb")) & once).select("a", "b", "na", "nb").distinct()


def _block_links(posts: DataFrame, lists: DataFrame, sets: DataFrame, block: int, percent: int) -> DataFrame:
    """Links (a, b) that join components, from all pairs of long lists, block by block."""
    some = posts.drop("size").join(lists.drop("main"), "post")
    parts = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("key"), parts).cast("long")
    some = some.select("post", "key", "root", mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    pair = F.shiftleft(F.least("mine", "other"), 20) + F.greatest("mine", "other")
    dealt = some.select("post", pair.cast("long").alias("pair"), "mine", "key", "root").join(sets, "key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["post", "pair"]):
            out = _links_of_blocks(group, percent)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])

    columns = dealt.select("post", "pair", "mine", "key", "root", "set")
    return columns.repartition("post", "pair").sortWithinPartitions("post", "pair").mapInArrow(meet, "a binary, b binary")


def _links_of_blocks(group: pa.Table, percent: int, width: int = 8192) -> list[tuple[bytes, bytes]]:
    """Links between two blocks of sets (or within one) that join components not joined before."""
    pair, mine = group["pair"][0].as_py(), group["mine"].to_numpy()
    keys, roots = group["key"].to_pylist(), group["root"].to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in group["set"].to_pylist()]
    left = np.flatnonzero(mine == pair >> 20)
    right = np.flatnonzero(mine == pair & ((1 << 20) - 1))
    if not len(left) or not len(right):
        return []
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    value, col = np.unique(np.concatenate(sets), return_inverse=True)
    several = np.bincount(col, minlength=len(value)) > 1
    keep = several[col]
    row, col = row[keep], np.cumsum(several)[col[keep]] - 1
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(several.sum()), width):
        a, b = np.searchsorted(col, (at, at + width))
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], col[a:b] - at] = 1
        both += m[left] @ m[right].T
    union = size[left][:, None] + size[right][None, :] - both
    names, comp = np.unique(np.array(roots, object), return_inverse=True)
    good = (100 * both >= percent * union) & (comp[left][:, None] != comp[right][None, :])
    i, j = np.nonzero(good)
    joined = list(range(len(names)))

    def top(c: int) -> int:
        while joined[c] != c:
            joined[c] = c = joined[joined[c]]
        return c

    out = []
    for x, y in zip(left[i].tolist(), right[j].tolist()):
        p, q = top(comp[x]), top(comp[y])
        if p != q:
            joined[p] = q
            out.append((keys[x], keys[y]))
    return out


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs (a, b) above both thresholds."""
    near = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    sig = classes.select("key", "sig")
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    above = (
        pairs.where(near)
        .join(sig.toDF("a", "sa"), "a")
        .join(sig.toDF("b", "sb"), "b")
        .where(same >= matches)
        .select("a", "b")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"))):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    good.append(i)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("a", "b")], names=["a", "b"])

    full = above.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    return full.select("a", "b", "xa", "xb").mapInArrow(check, "a binary, b binary")


def _sets(texts: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """(key, set): the full shingle set of one document of each class."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, sets = [], []
            for value in batch.column("text"):
                words = words_of(value.as_py())
                keys.append(hashlib.md5(b" ".join(words)).digest() if words else None)
                sets.append(shingle_set(words, shingle, hashes).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "set"])

    ids = members.select(F.col("_first.doc_id").alias("_id")).distinct()
    some = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id"))).select("text")
    built = some.mapInArrow(build, "key binary, set binary").join(members.select("key"), "key", "left_semi")
    return built.dropDuplicates(["key"])
