"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ranked

#: The golden ratio's fraction in units of 10 ** -18 (a fixed value).
GOLDEN, UNIT = "618033988749894848", "1000000000000000000"
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 1 << 16


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, *, most: int = 3, cycle: int = 3) -> DataFrame:
    """source, source_size, weight and target of each source of ``sizes`` (source, size).

    Sources in code point order, null last, weigh 1 .. ``cycle`` in turn.  All words are shared by
    weight; a share above ``most`` times its source's size stops there, and what it leaves is shared
    again by weight, until none is above.  Each round is one aggregation.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    s = ranked(totals, order, scratch, "_rank").select(
        "source", "source_size", (F.col("_rank") % cycle + 1).alias("weight")
    )
    s = scratch.put(s)
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    cap = F.col("source_size") * most
    rest, weight = total, s.agg(F.coalesce(F.sum("weight"), F.lit(1))).first()[0]
    while True:
        # the level rest / weight only rises, so what stopped before stays stopped
        over = cap * F.lit(weight) < F.col("weight") * F.lit(rest)
        got = s.agg(
            F.sum(F.when(over, cap)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("weight")
        ).first()
        now = (total - (got["held"] or 0), got["weight"] or 1)
        if now == (rest, weight):
            break
        rest, weight = now
    share = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(weight))
    return s.withColumn("target", F.when(over, cap.cast("double")).otherwise(share))


def mix(
    docs: DataFrame,
    scratch: Scratch,
    *,
    text: str = "text",
    source: str = "source",
    row_key: str = "doc_id",
    row: str | None = None,
    block: int = 1024,
    most: int = 3,
    cycle: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """The mixture, and what it takes of each document.

    Documents of a source are shuffled by a digest of ``row_key``, and those without key by a digest of
    source and text; they are laid end to end, again and again;
    the stretch is cut into blocks of ``block`` words (the last of each pass is shorter).  A source needs
    as many blocks as hold its target.  Slot n of the mixture is the n-th golden-ratio point mapped
    through the cumulated needs of all sources; slots of a source are ranked, and its k-th slot takes its
    k-th block.  Where a few points too many fall on a source, its last slots pass, in order, to the sources
    on which too few fall.  So slots 0 .. n - 1 hold one block each, and each source gives its target to
    the word (rounded down).

    Returns two frames.  The mixture: slot, source, pass, block, row (a document's number), size (its words),
    from_word, to_word (of the document).  The documents: row, doc_id (``row_key``), size (words), source_size,
    target, taken (words, repeats counted; at most ``most`` times the size), first_slot (null where nothing is
    taken) and n_slots (parts of it in the mixture).  Words are runs of other than ASCII
    white space; a null or empty text has size 0 and is never taken.  Null sources are one source.
    Documents with equal keys are neighbours, by size, then by the digest of their text, then by row.
    Repeated rows are documents of their own.  ``row`` names a column of distinct numbers, one a row, that
    the result carries as row; without it rows are numbered here.  Sources are numbered in parts (by
    range of the shuffled order, by block range), so no task holds a source, nor the rows of one key.
    """
    digest = F.xxhash64(F.col(source).cast("string"), F.col(text))
    d = docs.select(
        F.col(row_key).alias("doc_id"),
        F.col(source).alias("source"),
        words(F.col(text)).alias("size"),
        digest.alias("_digest"),
        (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"),
    )
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("_digest").cast("string"))))
    d = scratch.put(d.withColumn("_key", key))
    targets = scratch.put(source_targets(d.select("source", "size"), scratch, most=most, cycle=cycle))

    # where each document lies in its source
    order = ["_key", "doc_id", "size", "_digest", "row"]
    d = scratch.put(d.repartitionByRange("source", *order).withColumn("_part", F.spark_partition_id()))
    parts = d.groupBy("source", "_part").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_b")
    )
    inside = Window.partitionBy("source", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("_b")
    d = d.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    placed = scratch.put(d.select("row", "doc_id", "source", "size", at.alias("at")))

    # how many blocks each source needs, and their stretch of all blocks
    words_due = F.floor("target").cast("long")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    left = words_due % F.greatest(F.col("source_size"), F.lit(1))
    need = F.when(
        F.col("source_size") > 0,
        F.expr("cast(floor(target) as bigint) div source_size") * blocks + F.ceil(left / block).cast("long"),
    ).otherwise(0)
    t = targets.withColumn("due", words_due).withColumn("blocks", blocks).withColumn("need", need).where("need > 0")
    t = ranked(t, [F.col("source").isNull(), F.col("source")], scratch, "_rank")
    t = t.withColumn("_chunk", F.expr(f"_rank div {CHUNK}"))
    chunks = t.groupBy("_chunk").agg(F.sum("need").alias("_n"))
    chunks = chunks.select(
        F.col("_chunk").alias("_c"),
        F.coalesce(F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"),
    )
    above = Window.partitionBy("_chunk").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    t = scratch.put(
        t.withColumn("lo", F.coalesce(F.sum("need").over(above), F.lit(0)))
        .join(chunks, F.col("_chunk") == F.col("_c"))
        .select("source", "source_size", "blocks", "due", "need", (F.col("lo") + F.col("_b")).alias("lo"))
    )
    slots = scratch.put(_schedule(t, scratch))

    # the k-th slot of a source takes its k-th block
    taken = slots.join(t.select(F.col("source").alias("_s"), "source_size", "blocks", "due"), F.col("source").eqNullSafe(F.col("_s")))
    start = F.col("pass") * F.col("source_size") + F.col("block") * block
    room = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    taken = (
        taken.withColumn("pass", F.expr("k div blocks"))
        .withColumn("block", F.col("k") % F.col("blocks"))
        .withColumn("_words", F.least(room, F.col("due") - start))
        .select("slot", F.col("_s").alias("source"), "pass", "block", "_words")
        .where("_words > 0")
    )
    spans = placed.where("size > 0").select(
        "row",
        F.col("source").alias("_src"),
        "at",
        "size",
        F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("_blk"),
    )
    on = F.col("source").eqNullSafe(F.col("_src")) & (F.col("block") == F.col("_blk"))
    lo = F.greatest(F.col("at"), F.col("block") * block)
    hi = F.least(F.col("at") + F.col("size"), F.col("block") * block + F.col("_words"))
    mixture = taken.join(spans, on).where(hi > lo).select(
        "slot", "source", "pass", "block", "row", "size", (lo - F.col("at")).alias("from_word"), (hi - F.col("at")).alias("to_word")
    )
    used = mixture.groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken"),
        F.min("slot").alias("first_slot"),
        F.count("*").alias("n_slots"),
    )
    per_source = targets.select(F.col("source").alias("_s"), "source_size", "target")
    result = (
        placed.join(used, F.col("row") == F.col("_row"), "left")
        .join(per_source, F.col("source").eqNullSafe(F.col("_s")))
        .select(
            "row",
            "doc_id",
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).alias("taken"),
            "first_slot",
            F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
        )
    )
    return mixture, result


def _schedule(t: DataFrame, scratch: Scratch) -> DataFrame:
    """slot, source and k (its number among the source's slots) for all needed blocks: each slot holds one."""
    spark = scratch.spark
    n = t.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    tile = max(1, n // 4096)
    points = spark.range(n).select(
        F.col("id").alias("slot"),
        F.expr(f"cast(((cast(id as decimal(20,0)) * {GOLDEN}BD) % {UNIT}BD) * {n}BD div {UNIT}BD as bigint)").alias("x"),
    )
    # every place of the cumulated needs and its source, unfolded in tiles so that no array holds a hot source
    tiles = t.select(
        "source", "lo", "need", F.explode(F.sequence(F.expr(f"lo div {tile}"), F.expr(f"(lo + need - 1) div {tile}"))).alias("_tile")
    )
    first = F.greatest(F.col("lo"), F.col("_tile") * tile)
    last = F.least(F.col("lo") + F.col("need"), (F.col("_tile") + 1) * tile) - 1
    places = tiles.select("source", F.col("lo").alias("_of"), "need", F.explode(F.sequence(first, last)).alias("x"))
    hit = scratch.put(points.join(places, "x").select("slot", "source", "_of", "need", F.expr(f"slot div {CHUNK}").alias("_chunk")))
    counts = hit.groupBy("_of", "_chunk").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_of").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        F.col("_of").alias("_o"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_b")
    )
    local = Window.partitionBy("_of", "_chunk").orderBy("slot")
    k = hit.withColumn("_k", F.row_number().over(local) - 1).join(
        before, (F.col("_of") == F.col("_o")) & (F.col("_chunk") == F.col("_c"))
    )
    k = scratch.put(k.select("slot", "source", "need", (F.col("_k") + F.col("_b")).alias("k")))
    over = ranked(k.where("k >= need").select("slot"), [F.col("slot")], scratch, "_rank")
    have = counts.groupBy("_of").agg(F.sum("_n").alias("_have"))
    short = t.join(have, F.col("lo") == F.col("_of"), "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    short = short.where("_have < need").select(
        "lo", "source", F.explode(F.sequence(F.col("_have"), F.col("need") - 1)).alias("k")
    )
    short = ranked(short, [F.col("lo"), F.col("k")], scratch, "_rank")
    moved = over.join(short, "_rank").select("slot", "source", "k")
    return k.where("k < need").select("slot", "source", "k").unionByName(moved)


def mixed_documents(docs: DataFrame, scratch: Scratch, *, slot: str | None = None, **options) -> DataFrame:
    """Whole documents as often as the mixture takes them: one copy for each pass that takes at least half of
    the document's words.  Documents with no words are not part of a mixture.  Each row counts by itself,
    whatever its key: rows are numbered once, in a table, and what the mixture takes of a row comes back by
    that number.  ``slot`` names a column to add: the first slot of the copy in the schedule, to order by."""
    numbered = scratch.put(docs.withColumn("_row", F.monotonically_increasing_id()))
    mixture, _ = mix(numbered, scratch, row="_row", **options)
    copies = mixture.groupBy(F.col("row").alias("_of"), "pass").agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("_words"),
        F.first("size").alias("_size"),
        F.min("slot").alias("_slot"),
    )
    copies = copies.where("2 * _words >= _size").select("_of", "_slot")
    out = [F.col(f"`{c}`") for c in docs.columns if c != slot]
    if slot is not None:
        out.append(F.col("_slot").alias(slot))
    return numbered.join(copies, F.col("_row") == F.col("_of")).select(*out)
