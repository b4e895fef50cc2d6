"""Exact nearest rows by integer inner product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def integer_vector(v: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null where the vector or a component is null or not finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))
    return F.when(~F.coalesce(bad, F.lit(True)), whole)


def top_k(
    rows: DataFrame,
    scratch: Scratch,
    *,
    row_id: str = "vec_id",
    vector: str = "embedding",
    is_query: Column | None = None,
    k: int = 10,
    block: int = 1024,
) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each query row, ties to the smaller id.

    Queries (ids divisible by 100 unless ``is_query`` says otherwise) and candidates are dealt into
    blocks of about ``block`` rows, and every pair of a query and a candidate block is one group.  In
    a group, the candidates' non-zero components form one posting list per term; each term of the
    sparse query rows scatters its weighted postings into dense score arrays, whose best ``k`` are
    selected by partition.  A query's best of all groups are then merged.  Every pair is scored.

    Returns query_id, rank (from 1), vec_id, score.  Rows with a null id, and vectors that are null or
    hold null or non-finite components, take no part; vectors of different lengths meet in their common
    terms.  A query is no candidate for its own id.  Rows that repeat an id count once, with their best
    score.  Scores are 64-bit sums.  Fewer than k candidates give fewer ranks; none, or an empty table,
    no rows.
    """
    ok = rows.select(F.col(row_id).cast("long").alias("id"), integer_vector(F.col(vector)).alias("v"))
    ok = scratch.put(
        ok.where(F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn(
            "_deal", F.xxhash64(F.monotonically_increasing_id())
        )
    )
    chosen = F.col("id") % 100 == 0 if is_query is None else is_query
    n = ok.count()
    q = ok.where(chosen)
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-q.count() // block))
    deal = lambda m: F.pmod(F.col("_deal"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = q.select(deal(query_blocks).alias("qb"), every(blocks).alias("cb"), "id", "v")
    right = ok.select(every(query_blocks).alias("qb"), deal(blocks).alias("cb"), "id", "v")

    def score(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        return best_of_block(queries, candidates, k)

    partial = (
        left.groupBy("qb", "cb")
        .cogroup(right.groupBy("qb", "cb"))
        .applyInArrow(score, "query_id long, vec_id long, score long")
    )
    best = partial.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the non-zero components of a block."""
    v = table["v"].combine_chunks()
    if not len(v):
        return (np.empty(0, np.int64),) * 3
    lengths = v.value_lengths().to_numpy()
    weight = v.flatten().to_numpy()
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = weight != 0
    return row[some], term[some], weight[some]


def by_term(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The posting lists of a block: term, rows, weights."""
    row, term, weight = flat(table)
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    edges = [0, *(np.flatnonzero(np.diff(term)) + 1).tolist(), len(term)]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield int(term[a]), row[a:b], weight[a:b]


def best_of_block(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The best k candidates of a block for each query of a block."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    nq, nc = queries.num_rows, candidates.num_rows
    if nq and nc:
        ids, qids = candidates["id"].to_numpy(), queries["id"].to_numpy()
        scores = np.zeros((nq, nc), np.int64)
        asked = {t: (rows, weights) for t, rows, weights in by_term(queries)}
        for term, rows, weights in by_term(candidates):
            if term in asked:
                q, w = asked[term]
                if len(rows) == nc and len(q) == nq:
                    scores += np.multiply.outer(w, weights)
                else:
                    scores[np.ix_(q, rows)] += np.multiply.outer(w, weights)
        order = np.argsort(ids, kind="stable")
        ids, scores = ids[order], scores[:, order]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        if len(starts) < len(ids):
            ids, scores = ids[starts], np.maximum.reduceat(scores, starts, axis=1)
        for i, query in enumerate(qids):
            s = scores[i]
            other = ids != query
            some = np.flatnonzero(other)
            if len(some) > k:
                floor = np.partition(s[some], len(some) - k)[len(some) - k]
                some = some[s[some] >= floor]
            some = some[np.lexsort((ids[some], -s[some]))[:k]]
            out.append((np.full(len(some), query, np.int64), ids[some], s[some]))
    cols = [np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3
    return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, cols))))
