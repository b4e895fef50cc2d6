"""Token ids in directly addressable codes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .tokens import prefix_counts

MAGIC = b"DAC1"
#: Bits of a chunk, and bits of a continuation bitmap between two entries of its rank directory.
CHUNK_BITS, RANK_BITS = 8, 512
#: Ids after which a segment is closed; a segment holds whole documents.
SEGMENT_IDS = 1 << 18
#: Logarithm of the most questions for single ids that go to an image together.
LOT_BITS = 14


class Codes:
    """A sequence of unsigned ids, stored level by level.

    Level 0 has the lowest eight bits of every id.  Its bitmap marks the ids that go on; these have their
    next eight bits on level 1, and so forth; the last level has no bitmap.  The place of an id on the next
    level is the number of marks before it (its rank): a directory has that count for every 512 bits, and
    the rest is counted in at most 64 bytes.  So any id is read without reading those before it.

    Image: magic, number of ids (uint64), levels (uint8); then per level its length (uint64), chunks,
    and unless it is the last the bitmap (most significant bit first) and its directory (uint32 each).
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]):
        self.levels = levels

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def encode(ids: np.ndarray) -> bytes:
        """The image of a sequence of ids below 2^32."""
        rest = np.asarray(ids, np.uint32)
        parts, count = [], 0
        while True:
            parts.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes())
            rest = rest >> CHUNK_BITS
            more = rest > 0
            count += 1
            if not more.any():
                return MAGIC + struct.pack("<QB", len(ids), count) + b"".join(parts)
            parts.append(np.packbits(more).tobytes())
            blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64)
            parts.append((np.cumsum(blocks) - blocks).astype("<u4").tobytes())
            rest = rest[more]

    @classmethod
    def open(cls, image: bytes) -> "Codes":
        """Views into an image; nothing is decoded."""
        if image[:4] != MAGIC:
            raise ValueError("not an image of directly addressable codes")
        n, count = struct.unpack_from("<QB", image, 4)
        at, levels = 13, []
        for level in range(count):
            (size,) = struct.unpack_from("<Q", image, at)
            at += 8
            chunks = np.frombuffer(image, np.uint8, size, at)
            at += size
            bits = ranks = None
            if level < count - 1:
                bits = np.frombuffer(image, np.uint8, -(-size // 8), at)
                at += len(bits)
                ranks = np.frombuffer(image, "<u4", -(-size // RANK_BITS), at)
                at += 4 * len(ranks)
            levels.append((chunks, bits, ranks))
        if at != len(image) or len(levels[0][0]) != n:
            raise ValueError("the image is damaged")
        return cls(levels)

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Marks before place i."""
        block = i // RANK_BITS
        if block == len(ranks):  # just behind the last full block
            block -= 1
        first = block * RANK_BITS // 8
        whole, odd = bits[first : i // 8], i % 8
        out = int(ranks[block]) + int(np.bitwise_count(whole).sum())
        return out + (int(bits[i // 8]) >> (8 - odd)).bit_count() if odd else out

    def __getitem__(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        out, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if bits is None or not bits[i // 8] >> (7 - i % 8) & 1:
                break
            i = self._rank(bits, ranks, i)
            shift += CHUNK_BITS
        return out

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids from place a to before b: one rank per level, then its chunks in a row."""
        a, b = max(0, a), min(b, len(self))
        out = np.zeros(max(0, b - a), np.uint32)
        at, shift = np.arange(len(out)), 0
        for chunks, bits, ranks in self.levels:
            if b <= a:
                break
            out[at] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            if bits is None:
                break
            more = np.unpackbits(bits[a // 8 : -(-b // 8)])[a % 8 : a % 8 + b - a].astype(bool)
            a = self._rank(bits, ranks, a)
            at = at[more]
            b = a + len(at)
            shift += CHUNK_BITS
        return out


def write_codes(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    text: str = "text",
    key: str = "doc_id",
    end_id: int = 2,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Writes the ids of all documents, each with ``end_id`` behind it, in ascending order of ``key``.

    The table at ``path`` is uncompressed Parquet with one row per segment: part and segment (their order
    is that of the ids), n_ids, the keys of its documents, their ends (ids from the segment's first up to
    the document's end) and the image of its ids.  Rows are dealt to parts by ranges of the key and encoded
    there in one pass; a segment is closed after the document that fills it, so a task holds the ids of one
    segment and one document.

    Null texts count as empty: the end id alone.  Rows without key come first.  Rows that share a key (or
    have none) are ordered by a hash of their text and then as they come, so a hot key is cut between parts
    like any other.  Other columns are not read.  An empty table gives a table without rows.
    """
    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumns(
        {"h": F.xxhash64("t"), "r": F.monotonically_increasing_id()}
    )
    order = [F.col("k").asc_nulls_first(), "h", "r"]
    parts = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = parts.select("k", "t", F.spark_partition_id().alias("part"))
    kind = slim.schema["k"].dataType
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType())]
        + [T.StructField("n_ids", T.LongType()), T.StructField("keys", T.ArrayType(kind))]
        + [T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("image", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counts(tokenizer)
        end = np.array([end_id], np.uint32)
        keys: list = []
        ids: list[np.ndarray] = []
        ends: list[int] = []
        segment = part = 0

        def close() -> pa.RecordBatch:
            k = pa.array([keys], pa.list_(key_type))
            cols = [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([ends[-1]], pa.int64())]
            cols += [k, pa.array([ends], pa.list_(pa.int64()))]
            cols += [pa.array([Codes.encode(np.concatenate(ids))], pa.large_binary()).cast(pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            key_type = batch.schema.field("k").type
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t")):
                got = np.append(counter.encode(t.as_py() or ""), end)
                keys.append(k)
                ids.append(got)
                ends.append((ends[-1] if ends else 0) + len(got))
                if ends[-1] >= segment_ids:
                    yield close()
                    segment += 1
                    keys, ids, ends = [], [], []
        if ends:
            yield close()

    parts.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str, *, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """The documents of a table of ``write_codes``: the key, start (ids of all documents before it),
    n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids) and the ids themselves on request.

    Each document is cut out of its segment's image by rank.  Starts come from the numbers of ids of the
    segments before, summed per part and over the parts (one row each).
    """
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select(
        F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part")
    )
    segments = files.select("part", "segment", "n_ids")
    inside = Window.partitionBy("part").orderBy("segment")
    segments = segments.select(
        F.col("part").alias("p"), F.col("segment").alias("s"), (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("before")
    )
    segments = segments.join(parts, "p").select("p", "s", (F.col("before") + F.col("before_part")).alias("before"))
    kind = files.schema["keys"].dataType.elementType
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField(key, kind)]
        + [T.StructField(c, T.LongType()) for c in ("inside", "n_tokens", "ids_crc32")]
        + ([T.StructField("ids", T.BinaryType())] if ids else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes = Codes.open(batch.column("image")[row].as_py())
                ends = batch.column("ends")[row].as_py()
                raws = [codes.slice(a, b).astype("<u4").tobytes() for a, b in zip([0, *ends[:-1]], ends)]
                n = len(ends)
                cols = [pa.array([batch.column(c)[row].as_py()] * n, pa.int32()) for c in ("part", "segment")]
                cols += [batch.column("keys")[row].values]
                cols += [pa.array([0, *ends[:-1]], pa.int64()), pa.array([len(r) // 4 for r in raws], pa.int64())]
                cols += [pa.array([zlib.crc32(r) for r in raws], pa.int64())]
                cols += [pa.array(raws, pa.binary())] if ids else []
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    found = files.drop("n_ids").mapInArrow(run, schema)
    found = found.join(segments, (F.col("part") == F.col("p")) & (F.col("segment") == F.col("s")))
    out = [key, (F.col("inside") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else [])]
    return found.select(*out)


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame, *, key: str = "doc_id", at: str = "at") -> DataFrame:
    """Single ids: for each row (key, at) of ``wanted`` the id at that place of that document, as ``id``.

    Only the asked ids are read from the images.  Places outside the document give null, as do keys that are not there
    (null keys among them).  A key that several documents share gives a row for each.
    """
    files = spark.read.parquet(path)
    directory = files.select("part", "segment", F.posexplode(F.arrays_zip("keys", "ends")).alias("nth", "d"), "ends")
    directory = directory.select(
        F.col("d.keys").alias("_k"), "part", "segment",
        F.when(F.col("nth") > 0, F.element_at("ends", F.col("nth"))).otherwise(0).alias("_from"), F.col("d.ends").alias("_to"),
    )
    asked = wanted.select(F.col(key).alias("_key"), F.col(at).cast("long").alias("_at"))
    asked = asked.join(directory, F.col("_key") == F.col("_k"), "left")
    place = F.col("_from") + F.col("_at")
    place = F.when((F.col("_at") >= 0) & (place < F.col("_to")), place)
    # questions go to their segment's image in lots, so an image is sent once per lot, not per question
    lot = F.shiftright(F.monotonically_increasing_id(), LOT_BITS)
    lots = asked.withColumns({"_place": place, "_lot": lot}).groupBy("part", "segment", "_lot")
    lots = lots.agg(F.collect_list(F.struct("_key", "_at", "_place")).alias("_asked"))
    images = files.select(F.col("part").alias("p"), F.col("segment").alias("s"), "image")
    lots = lots.join(images, (F.col("part") == F.col("p")) & (F.col("segment") == F.col("s")), "left").select("_asked", "image")
    schema = T.StructType([T.StructField(key, asked.schema["_key"].dataType), T.StructField(at, T.LongType()), T.StructField("id", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                image = batch.column("image")[row].as_py()
                codes = None if image is None else Codes.open(image)
                questions = batch.column("_asked")[row].values
                ids = [None if p is None else codes[p] for p in questions.field("_place").to_pylist()]
                cols = [questions.field("_key"), questions.field("_at"), pa.array(ids, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return lots.mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str, scratch: Scratch, **options) -> DataFrame:
    """Writes the documents' ids to a table of the scratch folder and returns its documents as read back;
    options as for ``write_codes``."""
    path = f"{scratch.folder}/codes"
    scratch.free_shuffles(lambda: write_codes(docs, path, tokenizer, **options))
    return read_documents(scratch.spark, path, key=options.get("key", "doc_id"))
