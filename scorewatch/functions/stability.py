"""The stability index and the ways to treat empty bins.

Every index is the sum over bins of (a - e) * ln(a / e), where e and a are the expected and
actual shares of the bin. The treatments of empty bins differ and change the result, so each
one is a named policy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ZeroPolicy:
    """How shares are adjusted before the logarithm.

    absent: share of a bin that does not occur on that side
    zero: share given to a bin that occurs with share 0 (None keeps 0)
    floor: smallest share allowed
    add: constant added to every share
    renormalise: divide by the adjusted sum on each side
    on_zero: what a term with an empty side gives: 'infinite' or 'nothing'
    """

    absent: float = 0.0
    zero: float | None = None
    floor: float | None = None
    add: float = 0.0
    renormalise: bool = False
    on_zero: str = "infinite"


POLICIES: dict[str, ZeroPolicy] = {
    "absent_1e-10": ZeroPolicy(absent=1e-10),
    "zero_1e-4_renormalised": ZeroPolicy(absent=1e-4, zero=1e-4, renormalise=True),
    "floor_1e-10_renormalised": ZeroPolicy(absent=1e-10, floor=1e-10, renormalise=True),
    "unprotected": ZeroPolicy(),
    "empty_is_nothing": ZeroPolicy(on_zero="nothing"),
    "zero_1e-7": ZeroPolicy(absent=1e-7, zero=1e-7),
    "absent_1e-4": ZeroPolicy(absent=1e-4),
    "floor_1e-4": ZeroPolicy(absent=1e-4, floor=1e-4),
    "zero_1e-6": ZeroPolicy(absent=1e-6, zero=1e-6),
    "add_1e-6": ZeroPolicy(add=1e-6),
    "absent_1e-4_renormalised": ZeroPolicy(absent=1e-4, renormalise=True),
}


def policy_named(policy: str | ZeroPolicy) -> ZeroPolicy:
    if isinstance(policy, ZeroPolicy):
        return policy
    try:
        return POLICIES[policy]
    except KeyError:
        raise ValueError(f"unknown zero policy {policy!r}; choose from {sorted(POLICIES)}") from None


def adjusted(share: Column, policy: ZeroPolicy) -> Column:
    """A share after the policy; a null share means the bin is absent on that side."""
    result = share
    if policy.zero is not None:
        result = F.when(result == 0, F.lit(policy.zero)).otherwise(result)
    result = F.coalesce(result, F.lit(policy.absent))
    if policy.floor is not None:
        result = F.greatest(result, F.lit(policy.floor))
    if policy.add:
        result = result + F.lit(policy.add)
    return result


def term(expected: Column, actual: Column, on_zero: str = "infinite") -> Column:
    """One bin's part of the index; 0/0 gives null, which sums skip."""
    proper = (expected > 0) & (actual > 0)
    value = F.when(proper, (actual - expected) * F.ln(F.try_divide(actual, expected)))
    if on_zero == "nothing":
        return value.otherwise(F.lit(0.0))
    return value.when((expected > 0) | (actual > 0), F.lit(float("inf")))


def labelled(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The label of the first threshold above `value`."""
    chain = None
    for limit, label in steps:
        test = value < F.lit(limit)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return F.when(value.isNotNull(), chain.otherwise(F.lit(last)))


# Thresholds and wordings of the published band labels.
BANDS: dict[str, tuple[list[tuple[float, str]], str]] = {
    "status": ([(0.1, "stable"), (0.25, "warning")], "critical"),
    "change": (
        [(0.1, "No significant change"), (0.2, "Minor change"), (0.5, "Moderate change")],
        "Significant change",
    ),
    "shift": ([(0.1, "Very Stable"), (0.2, "Stable"), (0.5, "Moderate Shift")], "Significant Shift"),
    "size": ([(0.01, "Very Small"), (0.05, "Small"), (0.1, "Moderate")], "Large"),
}


def band(value: Column, name: str) -> Column:
    """Band label; `size` looks at the absolute value, `traffic` closes bands on the right."""
    if name == "traffic":
        return (
            F.when(value.isNull() | (value <= F.lit(-0.001)), F.lit(None).cast("string"))
            .when(value <= F.lit(0.1), F.lit("Green"))
            .when(value <= F.lit(0.25), F.lit("Amber"))
            .otherwise(F.lit("Red"))
        )
    steps, last = BANDS[name]
    return labelled(F.abs(value) if name == "size" else value, steps, last)
