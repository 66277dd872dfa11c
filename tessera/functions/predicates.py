"""Typed filters over metadata, with the missing-field rules of a schemaless store.

A comparison with a missing field is false, but for ``neq``, which is true: the
three-valued logic of SQL is folded away, so the results can be negated safely.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(field: str | Column) -> Column:
    return F.col(field) if isinstance(field, str) else field


def eq(field, value) -> Column:
    return F.coalesce(_col(field) == F.lit(value), F.lit(False))


def neq(field, value) -> Column:
    return F.coalesce(_col(field) != F.lit(value), F.lit(True))


def is_in(field, values) -> Column:
    return F.coalesce(_col(field).isin(list(values)), F.lit(False)) if len(values) else F.lit(False)


def in_range(field, low=None, high=None) -> Column:
    """Inclusive; an open side is not tested; a missing field is false."""
    tests = [_col(field).isNotNull()]
    if low is not None:
        tests.append(_col(field) >= F.lit(low))
    if high is not None:
        tests.append(_col(field) <= F.lit(high))
    return F.coalesce(reduce(and_, tests), F.lit(False))


def contains(field, value, is_array: bool = True) -> Column:
    """Membership of an array, or exact equality of a string (not a substring)."""
    c = _col(field)
    return F.coalesce(F.array_contains(c, value), F.lit(False)) if is_array else eq(c, value)


def all_of(*tests: Column) -> Column:
    return reduce(and_, tests, F.lit(True))


def any_of(*tests: Column) -> Column:
    return reduce(or_, tests, F.lit(False))


class FilterBuilder:
    """Collects conditions; ``build`` is their conjunction."""

    def __init__(self):
        self.tests: list[Column] = []

    def _add(self, test: Column) -> FilterBuilder:
        self.tests.append(test)
        return self

    def eq(self, field, value):
        return self._add(eq(field, value))

    def neq(self, field, value):
        return self._add(neq(field, value))

    def is_in(self, field, values):
        return self._add(is_in(field, values))

    def in_range(self, field, low=None, high=None):
        return self._add(in_range(field, low, high))

    def contains(self, field, value, is_array=True):
        return self._add(contains(field, value, is_array))

    def build(self) -> Column:
        return all_of(*self.tests)


def in_scope(path, scope: str) -> Column:
    """Scope strings: note:<path> exactly, folder:<prefix> below it, vault:... all."""
    kind, _, rest = scope.partition(":")
    if kind == "note":
        return _col(path) == rest
    if kind == "folder":
        return F.startswith(_col(path), F.lit(rest))
    return F.lit(True)


def name_contains(name, needle: str, aliases=None) -> Column:
    """Case-insensitive substring of the name or of one of the aliases."""
    low = needle.lower()
    hit = F.contains(F.lower(_col(name)), F.lit(low))
    if aliases is not None:
        hit = hit | F.coalesce(F.exists(_col(aliases), lambda a: F.contains(F.lower(a), F.lit(low))), F.lit(False))
    return F.coalesce(hit, F.lit(False))
