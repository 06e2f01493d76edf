"""Severity weights, ranks, grades, bands and rounding."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEVERITY_WEIGHT = {"Critical": 25, "High": 10, "Medium": 4, "Low": 1}
SEVERITY_RANK = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}
GRADES = ((90, "A", "#22C55E"), (75, "B", "#84CC16"), (60, "C", "#F5A623"), (40, "D", "#F97316"))
FAIL_GRADE = ("F", "#EF4444")
CONFIDENCE_BANDS = ((80, "#22C55E"), (60, "#F5A623"))
LOW_BAND = "#EF4444"
VERIFY_BELOW = 80


def _lookup(col: Column, table: dict[str, int], default: int) -> Column:
    result = None
    for key, value in table.items():
        result = (F if result is None else result).when(col == key, F.lit(value))
    return result.otherwise(F.lit(default))


def _steps(col: Column, steps: list[tuple[int, str]], last: str) -> Column:
    result = None
    for floor, value in steps:
        result = (F if result is None else result).when(col >= floor, F.lit(value))
    return result.otherwise(F.lit(last))


def severity_weight(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_WEIGHT, 1)


def severity_rank(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_RANK, 3)


def grade(score: Column) -> Column:
    return _steps(score, [(f, g) for f, g, _ in GRADES], FAIL_GRADE[0])


def grade_color(score: Column) -> Column:
    return _steps(score, [(f, c) for f, _, c in GRADES], FAIL_GRADE[1])


def confidence_band(confidence: Column) -> Column:
    return _steps(confidence, list(CONFIDENCE_BANDS), LOW_BAND)


def clamp_confidence(confidence: Column) -> Column:
    """0..100; NULL stays NULL."""
    bounded = F.greatest(F.lit(0), F.least(F.lit(100), confidence))
    return F.when(confidence.isNotNull(), bounded)


def is_high_priority(severity: Column) -> Column:
    return severity.isin("Critical", "High")


def round_to_int(value: Column, rounding: str = "half_even") -> Column:
    """half_even as the service rounds, half_up as the web client does."""
    if rounding == "half_even":
        return F.bround(value, 0).cast("long")
    if rounding == "half_up":
        return F.floor(value + F.lit(0.5)).cast("long")
    raise ValueError(f"unknown rounding {rounding!r}")


def percent_text(value: Column, rounding: str = "half_even") -> Column:
    return F.concat(round_to_int(value, rounding).cast("string"), F.lit("%"))
