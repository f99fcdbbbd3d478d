"""Exact quantiles of many columns without sorting or shuffling the columns.

The built-in exact ``percentile`` keeps every distinct value of a column in one buffer, which a single task cannot hold for a
large column. This is a radix selection on the order of doubles instead: the first digit is sign and binary
exponent, each further one up to ``BITS`` bits of the mantissa. A round counts the values per digit of all open zones, a
zone being the values that share the digits so far (a map-side aggregate; at most ``BUDGET`` small rows reach the driver a
round, whatever the data and the number of zones). Running sums tell which digits hold the wanted ranks; those are the next
round's zones. A digit with one value is settled at once, so a value that fills a third of a column ends its zone, and
when at most ``READ`` values are left in all zones together they are grouped and ranked.

Zones enter a round as literal bounds, so a round's plan is as long as its zones are many, at any depth, and a double has no more
than 2 + 52 / ``BITS`` digits. Within a binary exponent, differences and divisions by powers of two are exact: every value
falls into the digit that its bits say, infinities, subnormal numbers and both zeros included.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framevitals.functions import columns as C

BITS = 12
BUDGET = 1 << 18
READ = 200_000
BATCH = 48
#: Of IEEE 754 doubles: least and largest binary exponent, bits of the mantissa.
LEAST, MOST, MANTISSA = -1074, 1023, 52
ENDS = MOST - LEAST + 2
SPAN = 2 * ENDS + 1


@dataclass
class _Zone:
    """Values with ``low <= sign * value < low + 2 ** size``, within one binary exponent."""

    column: int
    sign: int
    low: float
    size: int
    least: int  # the values are multiples of 2 ** least
    base: int  # values of the column that sort before the zone
    count: int
    ranks: set[int]

    def holds(self) -> Column:
        y = self.value()
        high = self.low + 2.0**self.size if self.size < MOST or self.low < 2.0**MOST else math.inf
        return (y >= F.lit(self.low)) & (y < F.lit(high))

    def value(self) -> Column:
        v = F.col(f"v{self.column}")
        return v if self.sign > 0 else -v

    def digit(self, bits: int) -> Column:
        """Number of the value's part of the zone, in the order of values; the zone has 2 ** ``bits`` parts."""
        part = F.floor((self.value() - F.lit(self.low)) / F.lit(2.0 ** (self.size - bits)))
        return part if self.sign > 0 else F.lit((1 << bits) - 1) - part

    def part(self, digit: int, bits: int, base: int, count: int, ranks: set[int]) -> _Zone:
        place = digit if self.sign > 0 else (1 << bits) - 1 - digit
        size = self.size - bits
        return _Zone(self.column, self.sign, self.low + place * 2.0**size, size, self.least, base, count, ranks)


def _exponent(v: Column) -> Column:
    """The first digit: 0 for zero, else sign * (binary exponent - LEAST + 1), infinities outermost."""
    size = F.abs(v)
    guess = F.floor(F.log2(size)).cast("int")
    power = F.pow(F.lit(2.0), guess)  # the logarithm may be off by one next to a power of two
    exact = F.when(size < power, guess - 1).when(size >= power * 2.0, guess + 1).otherwise(guess)
    digit = F.when(size == F.lit(math.inf), F.lit(ENDS)).otherwise(exact - F.lit(LEAST - 1))
    return F.when(v == 0.0, 0).when(v > 0.0, digit).when(v < 0.0, -digit)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str] | dict[str, Column], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Column -> quantiles at ``probs`` with linear interpolation; NULLs when empty.

    ``columns`` are numeric column names, or name -> numeric expression. NaN must have been
    turned into NULL before. The result has (number of columns) x (number of probs) values.
    """
    exprs = columns if isinstance(columns, dict) else {c: C.ref(c) for c in columns}
    if not exprs:
        return {}
    values = df.select(*[e.cast("double").alias(f"v{i}") for i, e in enumerate(exprs.values())])
    counts = [0] * len(exprs)
    found: dict[tuple[int, int], float] = {}
    zones: list[_Zone] = []
    for start in range(0, len(exprs), BATCH):
        zones += _first(values, range(start, min(start + BATCH, len(exprs))), probs, counts, found)
    while sum(z.count for z in zones) > READ:
        zones = _deeper(values, zones, found)
    if zones:
        _read(values, zones, found)

    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(exprs):
        out[c] = []
        for p in probs:
            if counts[i] == 0:
                out[c].append(None)
                continue
            pos = p * (counts[i] - 1)
            low, high = found[(i, math.floor(pos))], found[(i, math.ceil(pos))]
            out[c].append(low if low == high else low + (high - low) * (pos - math.floor(pos)))
    return out


def bin_number(value: Column, edges: Sequence[float]) -> Column:
    """Number of distinct edges below the value (0 for the lowest bin), by halving the edges."""
    cuts = sorted(set(edges))

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low).cast("bigint")
        middle = (low + high) // 2
        return F.when(value > F.lit(cuts[middle]), between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(cuts))


def _counted(values: DataFrame, keys: dict[int, Column]) -> dict[str, np.ndarray]:
    """Per key, ascending: how many values have it, the least and the largest. ``keys``: column -> key of its value or NULL."""
    cells = [c for i, key in keys.items() for c in (key.cast("long"), F.col(f"v{i}"))]
    long = values.select(F.stack(F.lit(len(keys)), *cells).alias("key", "v")).where("key is not null and v is not null")
    table = long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).toArrow()
    order = np.argsort(table["key"].to_numpy())
    return {c: table[c].to_numpy()[order] for c in ("key", "n", "low", "high")}


def _wanted(counted: dict[str, np.ndarray], mine: slice, base: int, ranks: set[int], column: int, found) -> list[tuple]:
    """(place, values before it, its values, ranks) of the keys that hold ranks and have several values; settles the others."""
    upto = np.cumsum(counted["n"][mine])
    by_place: dict[int, set[int]] = {}
    for r in ranks:
        by_place.setdefault(int(np.searchsorted(upto, r - base, side="right")), set()).add(r)
    out = []
    for place, some in by_place.items():
        at, n = mine.start + place, int(counted["n"][mine][place])
        if counted["low"][at] == counted["high"][at]:
            found.update({(column, r): float(counted["low"][at]) for r in some})
        else:
            out.append((at, base + int(upto[place]) - n, n, some))
    return out


def _first(values: DataFrame, columns: range, probs, counts: list[int], found) -> list[_Zone]:
    """The round over signs and exponents: at most ``SPAN`` keys a column."""
    # one row a value before the digit is taken: the expression is long, and once in the generated code is enough
    cells = [c for i in columns for c in (F.lit(i), F.col(f"v{i}"))]
    long = values.select(F.stack(F.lit(len(columns)), *cells).alias("column", "v0")).where("v0 is not null")
    counted = _counted(long, {0: F.col("column") * SPAN + ENDS + _exponent(F.col("v0"))})
    zones = []
    for i in columns:
        mine = slice(*np.searchsorted(counted["key"], [i * SPAN, (i + 1) * SPAN]).tolist())
        counts[i] = n = int(counted["n"][mine].sum())
        ranks = {f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)} if n else set()
        for at, base, size, some in _wanted(counted, mine, 0, ranks, i, found):
            digit = int(counted["key"][at]) - i * SPAN - ENDS
            exponent = abs(digit) + LEAST - 1
            zones.append(_Zone(i, 1 if digit > 0 else -1, 2.0**exponent, exponent, max(exponent - MANTISSA, LEAST), base, size, some))
    return zones


def _chain(zones: list[tuple[int, _Zone]], key) -> Column:
    """``key(number, zone)`` of the zone a column's value lies in."""
    found = None
    for number, zone in zones:
        found = F.when(zone.holds(), key(number, zone)) if found is None else found.when(zone.holds(), key(number, zone))
    return found


def _by_column(zones: list[_Zone], key) -> dict[int, Column]:
    own: dict[int, list[tuple[int, _Zone]]] = {}
    for number, zone in enumerate(zones):
        own.setdefault(zone.column, []).append((number, zone))
    return {i: _chain(some, key) for i, some in own.items()}


def _deeper(values: DataFrame, zones: list[_Zone], found) -> list[_Zone]:
    """One round over the next bits of all zones."""
    wide = max(1, min(BITS, int(math.log2(max(2, BUDGET // len(zones))))))
    bits = [min(wide, z.size - z.least) for z in zones]
    counted = _counted(values, _by_column(zones, lambda k, z: F.lit(k << wide) + z.digit(bits[k])))
    out = []
    for k, z in enumerate(zones):
        mine = slice(*np.searchsorted(counted["key"], [k << wide, (k + 1) << wide]).tolist())
        for at, base, n, some in _wanted(counted, mine, z.base, z.ranks, z.column, found):
            out.append(z.part(int(counted["key"][at]) - (k << wide), bits[k], base, n, some))
    return out


def _read(values: DataFrame, zones: list[_Zone], found) -> None:
    """Group the values of zones that hold few together, and read the wanted ranks."""
    keys = _by_column(zones, lambda k, z: F.lit(k))
    cells = [c for i, key in keys.items() for c in (key, F.col(f"v{i}"))]
    long = values.select(F.stack(F.lit(len(keys)), *cells).alias("key", "v")).where("key is not null")
    table = long.groupBy("key", "v").agg(F.count(F.lit(1)).alias("n")).toArrow()  # READ rows at most
    key, v, n = (table[c].to_numpy() for c in ("key", "v", "n"))
    order = np.lexsort((v, key))
    key, v, n = key[order], v[order], n[order]
    for k, z in enumerate(zones):
        mine = slice(*np.searchsorted(key, [k, k + 1]).tolist())
        upto = np.cumsum(n[mine])
        for r in z.ranks:
            found[(z.column, r)] = float(v[mine][int(np.searchsorted(upto, r - z.base, side="right"))])
