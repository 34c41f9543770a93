"""Folds over rows in their order, for what depends on all that went before: a throttle, a trigger, an utterance.

Rows are dealt by key and sorted, and a task walks over them keeping the state of one key at a time. So a key of a
third of all rows takes one task long, but no more memory than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

#: step(state, row) gives the next state and the rows that come out, as tuples without the key; a row is a named tuple.
Step = Callable[[Any, Any], tuple[Any, Iterable[tuple]]]


def fold(rows: DataFrame, key: str, order: list[str], start: Any, step: Step, columns: str) -> DataFrame:
    """key and columns of what step gives for each row of a key in its order; every key begins with start.

    Rows with a null key are one key's.
    """
    names = [key, *(c.split()[0] for c in columns.split(", "))]
    kind = rows.schema[key].dataType.simpleString()

    def walk(batches):
        last, state, begun = None, start, False
        for batch in batches:
            keys = batch[key]
            same = keys.eq(keys.shift()) | (keys.isna() & keys.shift().isna())
            if len(batch):
                first = keys.iloc[0]
                same.iloc[0] = begun and (first == last or (pd.isna(first) and pd.isna(last)))
            out = []
            for row, goes_on in zip(batch.itertuples(index=False), same):
                if not goes_on:
                    state = start
                own = getattr(row, key)
                state, given = step(state, row)
                out += [(own, *g) for g in given]
                last, begun = own, True
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(walk, f"{key} {kind}, {columns}")
