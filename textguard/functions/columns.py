"""Small column helpers."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def constant(rows: list, schema: str) -> Column:
    """A literal array of structs; folded once when the query is planned."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), schema)


def total(col: Column) -> Column:
    return F.aggregate(col, F.lit(0), lambda a, x: a + x)


BLOCK = 128


def running_total(col: Column) -> Column:
    """Inclusive prefix sums of an array<int>, in blocks so that long arrays stay cheap."""

    def block(i):
        return F.floor(i / BLOCK).cast("int")

    def sums(steps):
        return F.transform(
            F.sequence(F.lit(0), block(F.size(steps) - 1)),
            lambda b: total(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))),
        )

    def spread(steps):
        return let(
            let(sums(steps), lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))),
            lambda starts: F.transform(
                steps,
                lambda _, i: F.get(starts, block(i))
                + total(F.slice(steps, block(i) * BLOCK + 1, i - block(i) * BLOCK + 1)),
            ),
        )

    return F.when(F.size(col) <= 1, col).otherwise(let(col, spread))
