"""Phrases whose words come together more often than apart, mined level by level from occurrence relations."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ranked

#: Bytes that end a piece (a fixed list), words, and what lies between words.
ENDS = b".,;:!?\n\x0b\x0c\r"
TOKENS = re.compile(rb"[^ \t.,;:!?\n\x0b\x0c\r]+|[.,;:!?\n\x0b\x0c\r]")
BLANK = re.compile(rb"[ \t\n]")
#: Words after which a block is closed, and bytes of text that are cut into words at a time.
BLOCK_WORDS, SLICE = 1 << 20, 1 << 24
#: Parts into which the candidates of a group are dealt before its first ones are chosen.
DEAL = 64


def _codes(raw: bytes, index: dict[bytes, int]) -> Iterator[np.ndarray]:
    """Codes of the words and piece ends of a text, a slice at a time; slices end at white space."""
    at = 0
    while at < len(raw):
        cut = BLANK.search(raw, at + SLICE)
        end = cut.start() if cut else len(raw)
        yield np.array([index[t] for t in TOKENS.findall(raw, at, end)], np.int32)
        at = end


def _fresh() -> dict[bytes, int]:
    """A dictionary that numbers what is asked for; piece ends come first."""
    index: dict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    for i in range(len(ENDS)):
        index[ENDS[i : i + 1]]
    return index


def word_blocks(docs: DataFrame, text: str, group: str) -> DataFrame:
    """The occurrences of all words, in blocks of whole documents of one group: block (unique), grp,
    n_words, codes (int32 in text order, -1 between pieces), words (by code) and counts."""
    slim = docs.select(
        F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("g"), F.col(text).cast("binary").alias("t")
    )
    schema = "block long, grp string, n_words long, codes binary, words array<binary>, counts array<long>"
    first = len(ENDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        base, size, made = TaskContext.get().partitionId() << 32, 0, 0
        gap = np.zeros(1, np.int32)  # a piece end

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for g, (index, parts) in held.items():
                codes = np.concatenate([*parts, gap]) - first
                codes[codes < 0] = -1
                counts = np.bincount(codes[codes >= 0], minlength=len(index) - first)
                row = [base + made], [g], [int(counts.sum())], [codes.tobytes()], [list(index)[first:]], [counts]
                kinds = pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=names)
                made += 1

        for batch in batches:
            for g, t in zip(batch.column("g").to_pylist(), batch.column("t")):
                if g not in held:
                    held[g] = _fresh(), []
                index, parts = held[g]
                for part in _codes((t.as_py() or b"").lower(), index):
                    parts.append(part)
                    size += len(part)
                parts.append(gap)
                if size >= BLOCK_WORDS:
                    yield from close()
                    held, size = {}, 0
        yield from close()

    names = ["block", "grp", "n_words", "codes", "words", "counts"]
    return slim.mapInArrow(run, schema)


class Relation:
    """The occurrences of frequent phrases of ``k`` words in one block, sorted by place: the words' ids
    in text order (-1 where no frequent phrase passes) and the places where a phrase begins."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, k: int):
        self.ids, self.at, self.k = ids, at, k

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Merge join with itself on the next place of the same piece: an occurrence and the one that begins at its
        second word make one of k + 1 words.  Returns their places, the distinct phrases (a row of packed
        ids each), the phrase of each place, and occurrences per phrase."""
        at = self.at[:-1][self.at[1:] == self.at[:-1] + 1]
        words = [self.ids[at + i].astype(np.int64) for i in range(self.k + 1)]
        packed = [(a << 32) | b for a, b in zip(words[::2], [*words[1::2], np.zeros(len(at), np.int64)])]
        order = np.lexsort(packed[::-1])
        new = np.zeros(len(at), bool)
        new[:1] = True
        for p in packed:
            new[1:] |= p[order][1:] != p[order][:-1]
        starts = np.flatnonzero(new)
        which = np.empty(len(at), np.int64)
        which[order] = np.cumsum(new) - 1
        distinct = np.array([p[order][starts] for p in packed])
        return at, distinct, which, np.diff(np.append(starts, len(at)))


def _relation(table: pa.Table, k: int) -> Relation:
    ids = np.frombuffer(table.column("ids")[0].as_py(), np.int32)
    at = np.frombuffer(table.column("at")[0].as_py(), np.int32)
    return Relation(ids, at, k)


def _row(block: pa.Table, ids: np.ndarray, at: np.ndarray) -> pa.Table:
    cells = [block.column("block").combine_chunks(), block.column("grp").combine_chunks()]
    blobs = [pa.array([np.ascontiguousarray(v, np.int32).tobytes()], pa.binary()) for v in (ids, at)]
    return pa.table([*cells, *blobs], names=["block", "grp", "ids", "at"])


RELATION = "block long, grp string, ids binary, at binary"


def _first_relation(block: pa.Table, frequent: pa.Table) -> pa.Table:
    """Words of a block as occurrences of frequent words (code -> id)."""
    codes = np.frombuffer(block.column("codes")[0].as_py(), np.int32) if block.num_rows else np.empty(0, np.int32)
    if not frequent.num_rows or not len(codes):
        return pa.table({n: pa.array([], t) for n, t in zip(["block", "grp", "ids", "at"], [pa.int64(), pa.string(), pa.binary(), pa.binary()])})
    found = frequent.column("code").to_numpy()
    ids = np.full(max(int(codes.max()), int(found.max())) + 2, -1, np.int32)  # the last one is for -1
    ids[found] = frequent.column("id").to_numpy()
    words = ids[codes]
    return _row(block, words, np.flatnonzero(words >= 0))


def _next_relation(k: int):
    """Occurrences of k + 1 words whose phrase is frequent."""

    def rule(block: pa.Table, frequent: pa.Table) -> pa.Table:
        if not frequent.num_rows or not block.num_rows:
            return block.slice(0, 0)
        r = _relation(block, k)
        at, distinct, which, _ = r.joined()
        good = np.zeros(distinct.shape[1], bool)
        good[frequent.column("code").to_numpy()] = True
        at = at[good[which]]
        used = np.zeros(len(r.ids), bool)
        for i in range(k + 1):
            used[at + i] = True
        return _row(block, np.where(used, r.ids, np.int32(-1)), at)

    return rule


def _group_counts(relation: DataFrame, k: int) -> DataFrame:
    """Phrases of k + 1 words per block: block, grp, code, key_0.. (two ids each), n."""
    keys = [f"key_{i}" for i in range((k + 2) // 2)]
    schema = "block long, grp string, code int, " + ", ".join(f"{c} long" for c in keys) + ", n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                _, distinct, _, counts = _relation(row, k).joined()
                n = len(counts)
                cols = [pa.array(np.full(n, row.column("block")[0].as_py())), pa.array([row.column("grp")[0].as_py()] * n, pa.string())]
                cols += [pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, distinct), pa.array(counts.astype(np.int64))]
                out = pa.RecordBatch.from_arrays(cols, names=["block", "grp", "code", *keys, "n"])
                for a in range(0, n, 10_000):
                    yield out.slice(a, 10_000)

    return relation.mapInArrow(run, schema)


def _frequent(counts: DataFrame, phrase: list[str], least: int) -> DataFrame:
    """Rows of phrases with at least ``least`` occurrences in their group, the total as ``a``.
    A phrase has at most one row per block."""
    total = F.sum("n").over(Window.partitionBy("grp", *phrase))
    return counts.withColumn("a", total).where(F.col("a") >= least).drop("n")


def _semi_join(relation: DataFrame, frequent: DataFrame, rule) -> DataFrame:
    return relation.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(rule, RELATION)


def frequent_phrases(
    docs: DataFrame, scratch: Scratch, *, text: str, group: str, longest: int, least: int
) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with at least ``least`` occurrences in their group
    (grp, k, phrase, a), and the number of words of each group (grp, n).

    Level by level: the relation of the frequent phrases' occurrences is kept sorted by block and place,
    merge-joined with itself on the next place of the piece, counted per phrase, and reduced to the
    occurrences of frequent phrases before the next level.  Counts are summed per block before
    they are shuffled.
    """
    blocks = scratch.put(word_blocks(docs, text, group))
    totals = scratch.put(blocks.groupBy("grp").agg(F.sum("n_words").alias("n")))
    per_block = blocks.select("block", "grp", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w"))
    per_block = per_block.select("block", "grp", "code", F.col("w.words").cast("string").alias("word"), F.col("w.counts").alias("n"))
    found = scratch.put(_frequent(per_block, ["word"], least))
    words = found.groupBy("grp", "word").agg(F.max("a").alias("a"))
    words = scratch.put(ranked(words, [F.col("grp"), F.col("word")], scratch, "id"))
    named = words.select("grp", "word", F.col("id").cast("int").alias("id"))
    codes = found.join(named, ["grp", "word"]).select("block", "code", "id")
    relation = scratch.put(_semi_join(blocks.select("block", "grp", "codes"), codes, _first_relation))
    scratch.drop(blocks, found)
    levels = [words.select("grp", F.lit(1).alias("k"), F.col("word").alias("phrase"), "a")]
    # texts of the phrases of the last level, by their packed ids
    texts = words.select("grp", F.shiftleft(F.col("id"), 32).alias("key_0"), F.col("word").alias("phrase"))
    for k in range(1, longest):
        keys = [f"key_{i}" for i in range((k + 2) // 2)]
        found = scratch.put(_frequent(_group_counts(relation, k), keys, least))
        groups = found.groupBy("grp", *keys).agg(F.max("a").alias("a"))
        # the phrase of the first k words and the last word
        end = keys[-1]
        if k % 2:
            prefix = {end: F.col(end) - F.col(end).bitwiseAND(F.lit(0xFFFFFFFF))}
            last, parent = F.col(end).bitwiseAND(F.lit(0xFFFFFFFF)), keys
        else:
            prefix, last, parent = {}, F.shiftright(end, 32), keys[:-1]
        split = groups.withColumns({"_last": last, **{f"_{c}": prefix.get(c, F.col(c)) for c in parent}})
        joined = split.join(
            texts.select(F.col("grp").alias("_g"), *[F.col(c).alias(f"_p{c}") for c in parent], F.col("phrase").alias("_prefix")),
            (F.col("grp") == F.col("_g")) & _all_equal([(f"_{c}", f"_p{c}") for c in parent]),
        )
        ids = words.select(F.col("id").alias("_id"), "word")
        joined = joined.join(ids, F.col("_last") == F.col("_id"))
        texts = scratch.put(joined.select("grp", *keys, F.concat_ws(" ", "_prefix", "word").alias("phrase"), "a"))
        levels.append(texts.select("grp", F.lit(k + 1).alias("k"), "phrase", "a"))
        last_relation = relation
        if k + 1 < longest:
            relation = scratch.put(_semi_join(relation, found.select("block", "code"), _next_relation(k)))
        scratch.drop(last_relation, found)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def _all_equal(pairs: list[tuple[str, str]]):
    out = F.lit(True)
    for a, b in pairs:
        out = out & (F.col(a) == F.col(b))
    return out


def collocations(
    docs: DataFrame,
    scratch: Scratch,
    *,
    text: str = "text",
    group: str = "lang",
    longest: int = 4,
    least: int = 30,
    cover: int = 80,
    top: int | None = 2000,
) -> DataFrame:
    """The phrases of 2 to ``longest`` words that hold together best, per group.

    Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line ends and these into words
    at spaces and tabs.  A candidate has a >= ``least`` occurrences in its group (overlaps count).  Cut
    after its first j words, it scores floor(2000000 * a / (l + r)), l and r the occurrences of both parts;
    its lowest-scoring cut counts, of equals that of the smallest j.  Candidates inside a longer one that has
    ``cover`` percent of their occurrences or more are left out.  Returns each group's first ``top`` (None:
    all) by score and occurrences, falling, then phrase: the group's column, rank (from 1), phrase, a, l, r,
    n (words of the group), score.

    Null texts count as empty, null groups as ``und``.  Every row counts by itself, so repeated rows count
    again and keys need no rule.  Words of any length are kept whole.  An empty table gives an empty result.
    """
    phrases, totals = frequent_phrases(docs, scratch, text=text, group=group, longest=longest, least=least)
    phrases = scratch.put(phrases)
    words = F.split("phrase", " ")
    longer = phrases.where("k > 1").select("grp", "k", "phrase", "a", words.alias("w"))

    def part(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    cuts = longer.select("grp", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    cuts = cuts.select(
        "grp", "phrase", "a", "j", part(F.lit(1), F.col("j")).alias("head"),
        part(F.col("j") + 1, F.col("k") - F.col("j")).alias("tail"),
    )
    heads = phrases.select("grp", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = phrases.select("grp", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    score = F.expr("cast(2000000 as decimal(18,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + r)")
    scored = (
        cuts.join(heads, ["grp", "head"])
        .join(tails, ["grp", "tail"])
        .groupBy("grp", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "j", "l", "r")).alias("cut"))
    )
    # the most frequent longer candidate around each phrase
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("k") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: part(i, n)),
        )
    )
    around = longer.where("k > 2").select("grp", F.explode(inner).alias("phrase"), "a")
    around = around.groupBy("grp", "phrase").agg(F.max("a").alias("around"))
    big = "decimal(19,0)"
    covered = F.col("around").cast(big) * 100 >= F.col("a").cast(big) * cover
    kept = scored.join(around, ["grp", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    kept = kept.select("grp", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # no group is ordered in one task: its parts first give their own first ones
        deal = F.pmod(F.xxhash64("phrase"), F.lit(DEAL))
        place = F.row_number().over(Window.partitionBy("grp", deal).orderBy(*order))
        kept = kept.withColumn("_p", place).where(F.col("_p") <= top).drop("_p")
        rank = F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("long")
        kept = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    else:
        kept = _ranks(kept, order, scratch)
    kept = kept.join(totals, "grp")
    return kept.select(F.col("grp").alias(group), "rank", "phrase", "a", "l", "r", "n", "score")


def _ranks(kept: DataFrame, order, scratch: Scratch) -> DataFrame:
    """Ranks of all candidates: places in the order of all groups less the place where the group begins."""
    placed = scratch.put(ranked(kept, [F.col("grp").asc(), *order], scratch, "place"))
    begins = placed.groupBy("grp").agg(F.min("place").alias("begin"))
    return placed.join(begins, "grp").withColumn("rank", F.col("place") - F.col("begin") + 1)
