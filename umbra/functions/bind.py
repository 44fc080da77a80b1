"""Binding a value once in a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names
    it: as the variable of a lambda it can't be copied into several places."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gathered(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], rows: str, block: int = 64) -> Column:
    """Rows that a walk over items gives: ``step(state, item)`` is the next state
    and an array of rows (of type ``rows``). A long array is walked block by
    block, as each row that is added copies the rows before it."""
    none = F.array().cast(rows)

    def walk(at: Column, part: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            after, more = step(acc["state"], x)
            return F.struct(after.alias("state"), F.concat(acc["rows"], more).alias("rows"))

        return F.aggregate(part, F.struct(at.alias("state"), none.alias("rows")), one)

    def blocks(acc: Column, i: Column) -> Column:
        return let(walk(acc["state"], F.slice(items, i * block + 1, F.lit(block))), lambda w: F.struct(w["state"].alias("state"), F.concat(acc["rows"], F.array(w["rows"])).alias("rows")))

    many = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int"))
    long_ = F.aggregate(many, F.struct(state.alias("state"), F.array().cast(f"array<{rows}>").alias("rows")), blocks, lambda acc: F.flatten(acc["rows"]))
    return F.when(F.size(items) <= block, walk(state, items)["rows"]).otherwise(long_)
