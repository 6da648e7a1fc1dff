"""Bin numbers and labels from an array of edges, as generated-code expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "Missing"
OTHERS = "Others"
NO_BINS = "No_Bins"

INFINITY = float("inf")


def _edges_passed(edges: Column, most: int | None, test) -> Column:
    """How many of the sorted edges pass `test`.

    By binary search where `most`, a bound on their number, is known; absent edges fail every
    test, so shorter arrays need no padding. Without a bound all edges are looked at.
    """
    if most is None:
        return F.size(F.filter(edges, test))

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(test(F.get(edges, F.lit(middle))), search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, most)


def right_closed(value: Column, edges: Column, most: int | None = None, include_lowest: bool = True) -> Column:
    """1-based bin with (low, high] bins; null below the first edge or above the last."""
    below = _edges_passed(edges, most, lambda e: e < value)
    first, last = F.get(edges, F.lit(0)), F.element_at(edges, -1)
    lowest = F.when(value == first, F.lit(1)) if include_lowest else F.when(F.lit(False), F.lit(1))
    return F.when(
        value.isNotNull() & (F.size(edges) > 1) & (value <= last),
        F.when(value > first, below).otherwise(lowest),
    )


def left_closed(value: Column, edges: Column, most: int | None = None) -> Column:
    """1-based bin with [low, high) bins, the last one closed on both sides."""
    upto = _edges_passed(edges, most, lambda e: e <= value)
    first, last = F.get(edges, F.lit(0)), F.element_at(edges, -1)
    return F.when(
        value.isNotNull() & (F.size(edges) > 1) & (value >= first) & (value <= last),
        F.least(upto, F.size(edges) - 1),
    )


def open_ended(edges: Column) -> Column:
    """Replace the outer edges by minus and plus infinity."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(
        F.size(edges) > 1, F.concat(F.array(F.lit(-INFINITY)), inner, F.array(F.lit(INFINITY)))
    ).otherwise(edges)


# Positions of rows without a bin number.
POSITION_MISSING, POSITION_NO_BINS = -1, -2


def numeric_position(value: Column, edges: Column, most: int | None = None, include_lowest: bool = True) -> Column:
    """Bin number, or a marker for null values and for features without edges."""
    return (
        F.when(value.isNull(), F.lit(POSITION_MISSING))
        .when(edges.isNull() | (F.size(edges) < 2), F.lit(POSITION_NO_BINS))
        .otherwise(right_closed(value, edges, most, include_lowest))
    )


def numeric_label(position: Column) -> Column:
    """`Bin_i`, `Missing` for null and `No_Bins` when the baseline had no values."""
    return (
        F.when(position == POSITION_MISSING, F.lit(MISSING))
        .when(position == POSITION_NO_BINS, F.lit(NO_BINS))
        .when(position > 0, F.concat(F.lit("Bin_"), position.cast("string")))
    )


def category_label(value: Column, top: Column, others: str = OTHERS) -> Column:
    """The category itself when it is one of the baseline's top ones."""
    return (
        F.when(value.isNull(), F.lit(MISSING))
        .when(F.array_contains(F.coalesce(top, F.array().cast("array<string>")), value), value)
        .otherwise(F.lit(others))
    )


def range_text(low: Column, high: Column) -> Column:
    """Readable bounds of a bin, open ends spelled out."""
    def text(edge: Column) -> Column:
        return (
            F.when(edge == F.lit(INFINITY), F.lit("inf"))
            .when(edge == F.lit(-INFINITY), F.lit("-inf"))
            .otherwise(F.format_string("%.2f", edge))
        )

    return F.concat(F.lit("("), text(low), F.lit(", "), text(high), F.lit("]"))


def fixed_bins(
    value: Column, ranges: Sequence[tuple[str, float | None, float | None]], missing: str | None = "missing"
) -> Column:
    """Hand-set bins `(label, low, high)`, both ends included, with an ordering letter.

    An open `high` means strictly above `low`. Null gets the last letter and the `missing`
    label; values between two ranges get null.
    """
    chain = None
    for i, (label, low, high) in enumerate(ranges):
        test = (value > low) if high is None else value.between(low, high)
        text = F.lit(f"{chr(97 + i)}. {label}")
        chain = F.when(test, text) if chain is None else chain.when(test, text)
    if missing is not None:
        chain = F.when(value.isNull(), F.lit(f"{chr(97 + len(ranges))}. {missing}")).otherwise(chain)
    return chain
