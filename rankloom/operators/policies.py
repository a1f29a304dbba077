"""Settings of a policy: limits, per-jaw overrides, and the check of recorded scores against their candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import join_null_safe

# The limits of a candidate budget.
BUDGET = (1, 10_000)


def budget(value: object) -> int:
    """A whole number within the limits; a boolean is none."""
    if isinstance(value, bool) or not isinstance(value, int) or not BUDGET[0] <= value <= BUDGET[1]:
        raise ValueError(f"a budget is a whole number from {BUDGET[0]} to {BUDGET[1]}, not {value!r}")
    return value


def switch(value: object) -> bool:
    if not isinstance(value, bool):
        raise ValueError(f"a switch is true or false, not {value!r}")
    return value


def share(value: object) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0.0 <= value <= 1.0:
        raise ValueError(f"a share lies between 0 and 1, not {value!r}")
    return float(value)


def policy_faults(policies: DataFrame, keys: Sequence[str], budgets: Sequence[str] = (), switches: Sequence[str] = (), shares: Sequence[str] = ()) -> DataFrame:
    """(keys, setting, value) of the settings of a table of policies, given as text, that break their rule. Absent ones are fine."""
    def fault(name: str, good: Column) -> Column:
        bad = F.col(name).isNotNull() & ~F.coalesce(good, F.lit(False))
        return F.when(bad, F.struct(F.lit(name).alias("setting"), F.col(name).cast("string").alias("value")))

    found = [fault(n, F.rlike(F.col(n), F.lit(r"^[0-9]+$")) & F.col(n).try_cast("bigint").between(*BUDGET)) for n in budgets]
    found += [fault(n, F.col(n).isin("true", "false")) for n in switches]
    found += [fault(n, F.col(n).try_cast("double").between(0.0, 1.0)) for n in shares]
    return policies.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("_f")).select(*keys, "_f.*")


def resolved_settings(rows: DataFrame, overrides: DataFrame, on: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Each setting from the override of the row's key if it names one, else the common one."""
    own = overrides.select(*on, *[F.col(n).alias(f"_own_{n}") if n in overrides.columns else F.lit(None).alias(f"_own_{n}") for n in defaults])
    out = join_null_safe(rows, own, on, "left")
    return out.withColumns({n: F.coalesce(F.col(f"_own_{n}"), F.lit(v)) for n, v in defaults.items()}).drop(*[f"_own_{n}" for n in defaults])


def checked_scores(scores: DataFrame, candidates: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Recorded scores beside their candidates: (keys, status), status ok, value_differs, no_candidate or no_score.

    A value agrees within ``tolerance``, absolute or relative to the larger one; two absent values agree.
    """
    keys = list(keys)
    left = scores.select(*keys, F.col(value).alias("_recorded"), F.lit(True).alias("_has_score"))
    right = candidates.select(*keys, F.col(value).alias("_actual"), F.lit(True).alias("_has_candidate"))
    both = left.join(right, keys, "full_outer")
    gap = F.abs(F.col("_recorded") - F.col("_actual"))
    near = (gap <= tolerance) | (gap <= tolerance * F.greatest(F.abs("_recorded"), F.abs("_actual")))
    same = F.coalesce(near, F.col("_recorded").isNull() & F.col("_actual").isNull())
    status = F.when(F.col("_has_candidate").isNull(), "no_candidate").when(F.col("_has_score").isNull(), "no_score").when(same, "ok").otherwise("value_differs")
    return both.select(*keys, status.alias("status"))
