"""Custom calendars: columns over months, eras and moons given as Python values.

A calendar's parts are few and known when a query is built, so they become
constants of the expression and need no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Month:
    name: str
    days: int
    leap_interval: int | None = None
    leap_days: int = 1
    unless_divisible_by: int | None = None


@dataclass(frozen=True)
class Era:
    name: str
    abbreviation: str
    start: int
    end: int | None = None
    negative: bool = False


@dataclass(frozen=True)
class Calendar:
    months: tuple[Month, ...]
    weekdays: tuple[str, ...]
    eras: tuple[Era, ...] = ()
    default_era: int = 0
    has_year_zero: bool = False
    moons: dict[str, tuple[float, float]] = field(default_factory=dict)


def days_in_month(calendar: Calendar, month: int, year: Column) -> Column:
    m = calendar.months[month]
    if m.leap_interval is None:
        return F.lit(m.days)
    leap = year % m.leap_interval == 0
    if m.unless_divisible_by:
        leap = leap & (year % m.unless_divisible_by != 0)
    return F.when(leap, m.days + m.leap_days).otherwise(m.days)


def days_in_year(calendar: Calendar, year: Column) -> Column:
    return sum((days_in_month(calendar, i, year) for i in range(len(calendar.months))), F.lit(0))


def era_number(calendar: Calendar, year: Column) -> Column:
    """Place of the first era that holds the year, else of the default."""
    out = F.lit(calendar.default_era)
    for i in reversed(range(len(calendar.eras))):
        e = calendar.eras[i]
        inside = year >= e.start
        out = F.when(inside if e.end is None else inside & (year <= e.end), i).otherwise(out)
    return out


def format_year(calendar: Calendar, year: Column) -> Column:
    """'812 FA'; eras that count down, and years below 0, show no sign."""
    if not calendar.eras:
        return year.cast("string")
    out = None
    number = era_number(calendar, year)
    for i, e in enumerate(calendar.eras):
        text = F.concat_ws(" ", F.when(F.lit(e.negative) | (year < 0), F.abs(year)).otherwise(year).cast("string"), F.lit(e.abbreviation))
        out = F.when(number == i, text) if out is None else out.when(number == i, text)
    return out


def navigate_year(year: Column, step: int, has_year_zero: bool) -> Column:
    moved = year + step
    return moved if has_year_zero else F.when(moved == 0, 1 if step > 0 else -1).otherwise(moved)


def day_of_year(calendar: Calendar, month: Column, day: Column, year: Column | None = None) -> Column:
    """Days before a date in its year; without a year, leap days don't count."""
    total = F.lit(0)
    for i, m in enumerate(calendar.months):
        total = total + F.when(month > i, days_in_month(calendar, i, year) if year is not None else F.lit(m.days)).otherwise(0)
    return total + day


def weekday_index(calendar: Calendar, year: Column, month: Column, day: Column) -> Column:
    """Years before do not count: each year begins on weekday 0."""
    return day_of_year(calendar, month, day, year) % len(calendar.weekdays)


def moon_phase(calendar: Calendar, moon: str, month: Column, day: Column) -> Column:
    cycle, offset = calendar.moons[moon]
    phase = day_of_year(calendar, month, day) / cycle + offset
    return phase - F.floor(phase)


def format_date(calendar: Calendar, year: Column, month: Column, day: Column) -> Column:
    names = F.array(*[F.lit(m.name) for m in calendar.months])
    return F.concat((day + 1).cast("string"), F.lit(" "), F.coalesce(F.get(names, month), F.lit("Unknown")), F.lit(", "), format_year(calendar, year))


def date_valid(calendar: Calendar, year: Column, month: Column, day: Column) -> Column:
    """Day within its month, counted from 0; an unknown month has 31 days and is valid."""
    most = F.lit(31)
    for i in range(len(calendar.months)):
        most = F.when(month == i, days_in_month(calendar, i, year)).otherwise(most)
    return (day >= 0) & (day < most)


#: Physical constants of the orbital model.
G, SUN_MASS, AU = 6.67430e-11, 1.989e30, 1.496e11


def year_length(star_mass: Column, distance_au: Column) -> Column:
    """Orbital period in Earth days, by Kepler's third law."""
    seconds = 2 * math.pi * F.sqrt(F.pow(distance_au * AU, F.lit(3.0)) / (G * SUN_MASS * star_mass))
    return seconds / 86_400


def habitable_zone(star_mass: Column) -> Column:
    optimal = F.sqrt(F.pow(star_mass, F.lit(3.5)))
    return F.struct((optimal * 0.95).alias("min"), (optimal * 1.37).alias("max"), optimal.alias("optimal"))


def week_length(days_per_year: Column) -> Column:
    return F.when(days_per_year < 100, 5).when(days_per_year < 400, 7).when(days_per_year < 600, 8).otherwise(10)
