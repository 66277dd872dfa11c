"""Field transforms, their text form, and binding aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def _numeric(c: Column, result: Column) -> Column:
    """``result`` where the value is a number, else the value as it was."""
    return F.when(_number(c).isNotNull(), result.cast("string")).otherwise(c.cast("string"))


def multiply(c: Column, by: float) -> Column:
    return _numeric(c, _number(c) * by)


def add(c: Column, by: float) -> Column:
    return _numeric(c, _number(c) + by)


def subtract(c: Column, by: float) -> Column:
    return _numeric(c, _number(c) - by)


def divide(c: Column, by: float) -> Column:
    """Division by zero leaves the value."""
    return c.cast("string") if by == 0 else _numeric(c, _number(c) / by)


def round_half_up(c: Column, precision: int = 0) -> Column:
    """Rounds half towards plus infinity, unlike SQL's ``round``."""
    scale = 10.0**precision
    return F.floor(c * scale + 0.5) / scale


def round_to(c: Column, precision: int = 0) -> Column:
    return _numeric(c, round_half_up(_number(c), precision))


def floor(c: Column) -> Column:
    return _numeric(c, F.floor(_number(c)).cast("double"))


def ceil(c: Column) -> Column:
    return _numeric(c, F.ceil(_number(c)).cast("double"))


def negate(c: Column) -> Column:
    """Numbers change sign, booleans flip, others stay."""
    return F.when(F.lower(c.cast("string")) == "true", F.lit("false")).when(F.lower(c.cast("string")) == "false", F.lit("true")).otherwise(_numeric(c, -_number(c)))


def uppercase(c: Column) -> Column:
    return F.upper(c.cast("string"))


def lowercase(c: Column) -> Column:
    return F.lower(c.cast("string"))


def prefix(c: Column, text: str) -> Column:
    return F.concat(F.lit(text), c.cast("string"))


def suffix(c: Column, text: str) -> Column:
    return F.concat(c.cast("string"), F.lit(text))


_NUMERIC_ARG = {"multiply": multiply, "add": add, "subtract": subtract, "divide": divide}
_TEXT_ARG = {"prefix": prefix, "suffix": suffix}
_PLAIN = {"floor": floor, "ceil": ceil, "negate": negate, "uppercase": uppercase, "lowercase": lowercase}


def parse_transform(spec: str) -> list[tuple[str, str | None]]:
    """'multiply:2|round:1|prefix:x' as (name, argument) steps."""
    steps = []
    for part in filter(None, (p.strip() for p in spec.split("|"))):
        name, _, arg = part.partition(":")
        if name not in {*_NUMERIC_ARG, *_TEXT_ARG, *_PLAIN, "round"}:
            raise ValueError(f"no such transform: {name}")
        steps.append((name, arg or None))
    return steps


def serialize_transform(steps: list[tuple[str, str | None]]) -> str:
    return "|".join(name if arg is None else f"{name}:{arg}" for name, arg in steps)


def apply_chain(c: Column, spec: str | list[tuple[str, str | None]]) -> Column:
    """The steps from left to right."""
    for name, arg in parse_transform(spec) if isinstance(spec, str) else spec:
        if name in _NUMERIC_ARG:
            c = _NUMERIC_ARG[name](c, float(arg or 0))
        elif name in _TEXT_ARG:
            c = _TEXT_ARG[name](c, arg or "")
        elif name == "round":
            c = round_to(c, int(arg or 0))
        else:
            c = _PLAIN[name](c)
    return c


def agg_sum(c: Column) -> Column:
    """Sum of what can be a number; 0 if nothing can."""
    return F.coalesce(F.sum(_number(c)), F.lit(0.0))


def agg_avg(c: Column) -> Column:
    return F.coalesce(F.avg(_number(c)), F.lit(0.0))


def agg_count(c: Column) -> Column:
    return F.count(c)


def agg_min(c: Column) -> Column:
    return F.min(_number(c))


def agg_max(c: Column) -> Column:
    return F.max(_number(c))


def agg_concat(c: Column, order: Column, separator: str = ", ") -> Column:
    """Non-null values joined in the order given."""
    pairs = F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct(order.alias("o"), c.cast("string").alias("v")))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), separator)


AGGREGATIONS = {"sum": agg_sum, "avg": agg_avg, "count": agg_count, "min": agg_min, "max": agg_max}
#: Field types each aggregation takes.
VALID_TYPES = {"sum": {"number"}, "avg": {"number"}, "min": {"number"}, "max": {"number"}, "count": {"number", "text", "boolean", "date"}, "concat": {"text", "number"}}


def aggregation_valid(name: str, field_type: str) -> bool:
    return field_type in VALID_TYPES.get(name, set())


def available_aggregations(field_type: str) -> list[str]:
    return sorted(n for n, kinds in VALID_TYPES.items() if field_type in kinds)
