"""Language identification by compression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def learn_dictionaries(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    row_key: str = "doc_id",
    dictionary_bytes: int = 262_144,
    snippet: int = 256,
    all_bytes: int = 67_108_864,
) -> dict[str, bytes]:
    """Raw-content dictionaries, one for every label, from a bounded sample of labelled rows.

    A label's dictionary has at most ``dictionary_bytes``, and less where there are so many labels that
    all of them together would pass ``all_bytes``; with more than all_bytes / snippet labels an error is
    raised.  About 4 times the bytes of a dictionary / snippet rows are drawn per label by a hash of
    ``row_key`` and text, never more than twice that; each gives ``snippet`` characters from a place that
    the hash sets, and the first bytes of them in hash order, in lower case, form the dictionary.  That is
    all that reaches the driver.  Rows with a null or empty text or a null label teach nothing.
    """
    known = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("lang"), F.col(row_key).alias("key"), F.col(text).alias("text")
    )
    counts = known.groupBy("lang").count()
    labels = counts.count()
    if not labels:
        return {}
    if labels > all_bytes // snippet:
        raise ValueError(f"{labels} labels in {lang}: more than {all_bytes // snippet} cannot be learned within all_bytes")
    share = min(dictionary_bytes, all_bytes // labels)
    rows = max(1, 4 * share // snippet)
    draw = F.xxhash64(F.lit("sample"), "key", "text")
    place = F.pmod("draw", F.greatest(F.length("text") - snippet + 1, F.lit(1)))
    chance = F.least(F.lit(1.0), F.lit(rows) / F.col("count"))
    sample = (
        known.withColumn("draw", draw)
        .join(F.broadcast(counts), "lang")  # at most all_bytes / snippet rows, as checked
        .where(F.pmod("draw", F.lit(1 << 30)) < chance * (1 << 30))
        .select("lang", "draw", F.substring("text", place.cast("int") + 1, F.lit(snippet)).alias("s"))
    )
    # the bound also holds where many rows are equal; it is applied before the shuffle and after it
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "s"))
    sample = sample.withColumn("_n", first).where(F.col("_n") <= 2 * rows).drop("_n").toPandas()
    out = {}
    for label, part in sample.sort_values(["draw", "s"]).groupby("lang"):
        out[label] = "\n".join(part["s"]).lower().encode()[:share]
    return out


class Compressors:
    """Compressed sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, block: int):
        self.names = sorted(dictionaries)
        self.block = block
        self.by_lang = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by_lang.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        """Whole text, in blocks, so that the dictionary counts in all of it and not only at its start."""
        raw = text.lower().encode()
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.by_lang])


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    *,
    text: str = "text",
    keep: tuple[str | Column, ...] = ("doc_id",),
    margin: float = 0.0,
    level: int = 6,
    block: int = 4096,
) -> DataFrame:
    """The language whose dictionary compresses the whole text best.

    Returns the columns of ``keep`` (replaced where a result column has the name), lang_pred, score and
    rejected.  Score is the share of bytes that the best language saves against the next one (in lower case), 1 if there
    is only one, between 0 and 1.  Ties go to the first label in code point order.  lang_pred is ``und``,
    with score 0, if the text is null or has no letter, or nothing was learned.  rejected is true for
    these and where the score is below ``margin``.  Repeated rows get equal answers.  No shuffle; each
    worker holds one dictionary per language.
    """
    made = ("lang_pred", "score", "rejected")
    kept = [c for c in keep if isinstance(c, Column) or c not in made]
    slim = docs.select(*kept, F.col(text).alias("_text"))
    names = [c for c in slim.columns if c != "_text"]
    schema = T.StructType(
        [slim.schema[c] for c in names]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
        + [T.StructField("rejected", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(dictionaries, level, block)
        for batch in batches:
            pred, score = [], []
            for value in batch.column("_text"):
                t = value.as_py()
                if not compressors.names or t is None or not LETTER.search(t):
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                size = compressors.sizes(t)
                best = int(size.argmin())
                other = np.delete(size, best)
                pred.append(compressors.names[best])
                score.append(float(1 - size[best] / other.min()) if len(other) else 1.0)
            low = [p == UNDETERMINED or s < margin for p, s in zip(pred, score)]
            cols = [batch.column(c) for c in names]
            cols += [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return slim.mapInArrow(run, schema)


def held_out(row_key: str = "doc_id") -> Column:
    """Rows that no dictionary is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(row_key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
