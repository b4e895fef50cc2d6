"""Sequential rules over bounded groups, fed by Spark's shuffle and sort."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fold_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    uses: list[str],
    rule: Callable[[dict[str, list]], dict[str, list]],
    new_columns: str,
) -> DataFrame:
    """Add columns computed by ``rule`` from the columns ``uses`` of a group, in order.

    Rows are placed by ``keys`` and sorted by Spark; a task walks its sorted batches and holds
    one group at a time.  Groups must be bounded (callers cut them at exact boundaries first).
    """
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(new_columns).fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def apply(block: pd.DataFrame) -> pd.DataFrame:
            block = block.reset_index(drop=True)
            change = (block[keys] != block[keys].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], len(block))
            out: dict[str, list] = {}
            columns = {c: block[c].tolist() for c in uses}
            for a, b in zip(starts, ends):
                for name, values in rule({c: v[a:b] for c, v in columns.items()}).items():
                    out.setdefault(name, []).extend(values)
            return block.assign(**out)[names]

        held: pd.DataFrame | None = None
        for batch in batches:
            if batch.empty:
                continue
            block = batch if held is None else pd.concat([held, batch], ignore_index=True)
            tail = (block[keys] == block[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = len(block) - int(np.argmin(tail[::-1])) if not tail.all() else 0
            held = block.iloc[cut:]
            if cut:
                yield apply(block.iloc[:cut])
        if held is not None and len(held):
            yield apply(held)

    return (
        df.repartition(*keys)
        .sortWithinPartitions(*keys, *order)
        .mapInPandas(run, schema)
    )


def fold_stream(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    uses: list[str],
    fresh: Callable[[], object],
    step: Callable[..., tuple],
    new_columns: str,
) -> DataFrame:
    """Add columns computed row by row: ``step(state, *uses)`` returns their values and changes the
    group's state, which ``fresh`` makes.  A task holds one batch and one state, however large a group is."""
    added = T.StructType.fromDDL(new_columns)
    schema = T.StructType(df.schema.fields + added.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        state: object = None
        for batch in batches:
            out = []
            for key, row in zip(zip(*(batch[k] for k in keys)), zip(*(batch[c].tolist() for c in uses))):
                if key != last:
                    last, state = key, fresh()
                out.append(step(state, *row))
            columns = zip(*out) if out else [()] * len(added)
            yield batch.assign(**{f.name: list(c) for f, c in zip(added, columns)})

    return (
        df.repartition(*keys)
        .sortWithinPartitions(*keys, *order)
        .mapInPandas(run, schema)
    )
