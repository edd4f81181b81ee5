"""Quantities in mixed units: numbers and unit expressions are parsed with a grammar, units are exponent
vectors over the SI base dimensions with a scale and an offset, and values come out in one unit.

Cases: null, empty or unparsable text gives no value; a range ("5-10 min"), a bound ("< 2 h") or a text
without a number gives no value; a bare number takes the hinted unit, without one it gives no value; text of
any length is parsed whole. Exact arithmetic (Fraction) keeps results equal at every size and order.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of the exponents: length, mass, time, current, temperature, amount.
Dims = tuple[int, int, int, int, int, int]
NONE: Dims = (0, 0, 0, 0, 0, 0)
LENGTH: Dims = (1, 0, 0, 0, 0, 0)
MASS: Dims = (0, 1, 0, 0, 0, 0)
TIME: Dims = (0, 0, 1, 0, 0, 0)
CURRENT: Dims = (0, 0, 0, 1, 0, 0)
TEMPERATURE: Dims = (0, 0, 0, 0, 1, 0)
AMOUNT: Dims = (0, 0, 0, 0, 0, 1)


@dataclass(frozen=True)
class Unit:
    """SI value = number * scale + offset."""

    dims: Dims
    scale: Fraction = Fraction(1)
    offset: Fraction = Fraction(0)

    def __mul__(self, other: "Unit") -> "Unit":
        return Unit(tuple(a + b for a, b in zip(self.dims, other.dims)), self.scale * other.scale)

    def __pow__(self, n: int) -> "Unit":
        return self if n == 1 else Unit(tuple(a * n for a in self.dims), self.scale**n)


ZERO_C, F_SCALE = Fraction("273.15"), Fraction(5, 9)
SECOND, MINUTE, HOUR, DAY = (Unit(TIME, Fraction(n)) for n in (1, 60, 3600, 86400))
KELVIN, CELSIUS = Unit(TEMPERATURE), Unit(TEMPERATURE, Fraction(1), ZERO_C)
FAHRENHEIT = Unit(TEMPERATURE, F_SCALE, ZERO_C - 32 * F_SCALE)
_VOLT = Unit((2, 1, -3, -1, 0, 0))
#: Names in lower case; a name may mean one unit per dimension, the expected dimension decides.
NAMES: dict[str, list[Unit]] = {}
for _unit, _names in (
    (SECOND, "s sec secs second seconds"),
    (MINUTE, "min mins minute minutes m"),
    (HOUR, "h hr hrs hour hours"),
    (DAY, "d day days"),
    (Unit(TIME, Fraction(604800)), "week weeks"),
    (KELVIN, "k kelvin kelvins"),
    (CELSIUS, "c celsius centigrade"),
    (FAHRENHEIT, "f fahrenheit"),
    (Unit(LENGTH), "m metre metres meter meters"),
    (Unit(MASS, Fraction(1, 1000)), "g gram grams"),
    (Unit(CURRENT), "a amp ampere amperes"),
    (Unit(AMOUNT), "mol mole moles"),
    (Unit((3, 0, 0, 0, 0, 0), Fraction(1, 1000)), "l litre litres liter liters"),
    (Unit((-3, 0, 0, 0, 0, 1), Fraction(1000)), "molar"),
    (_VOLT, "v volt volts"),
    (Unit((2, 1, -2, 0, 0, 0)), "j joule joules"),
    (Unit((2, 1, -2, 0, 0, 0), Fraction("1.602176634e-19")), "ev electronvolt"),
    (Unit((2, 1, -3, 0, 0, 0)), "w watt watts"),
    (Unit((2, 1, -3, -2, 0, 0)), "ohm ohms"),
    (Unit((-1, 1, -2, 0, 0, 0)), "pa pascal pascals"),
    (Unit((-1, 1, -2, 0, 0, 0), Fraction(100000)), "bar bars"),
    (Unit((0, 0, -1, 0, 0, 0)), "hz hertz"),
    (Unit((0, 0, -1, 0, 0, 0), Fraction(1, 60)), "rpm"),
    (Unit(NONE, Fraction(1, 100)), "% percent"),
):
    for _n in _names.split():
        NAMES.setdefault(_n, []).append(_unit)
PREFIXES = {"n": Fraction(1, 10**9), "u": Fraction(1, 10**6), "μ": Fraction(1, 10**6), "m": Fraction(1, 1000), "c": Fraction(1, 100), "d": Fraction(1, 10), "k": Fraction(1000), "mega": Fraction(10**6), "milli": Fraction(1, 1000), "micro": Fraction(1, 10**6), "nano": Fraction(1, 10**9), "kilo": Fraction(1000), "centi": Fraction(1, 100)}
#: Of these only the first letters of a longer unit name may be a prefix.
_PREFIXED = {"s", "m", "g", "a", "mol", "l", "v", "j", "ev", "w", "ohm", "pa", "bar", "hz", "metre", "meter", "metres", "meters", "second", "seconds", "gram", "grams", "volt", "volts", "litre", "liter", "mole", "moles"}

_SMALL = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20)))
_TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10)))
_FRACTIONS = {"half": Fraction(1, 2), "quarter": Fraction(1, 4)}
_BOUND = re.compile(r"[<>≤≥≲≳]|\b(?:at least|at most|up to|more than|less than|no more|no less|not more|not less|longer than|shorter than|over|under|below|above|exceeding|minimum|maximum|max|until|beyond|within|several|few|some)\b")
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*(?:e[+-]?\d+)?|[a-zμ]+|%|\S")
_DASH = str.maketrans({c: "-" for c in "‐‑‒–—−"})


def _number(t: str) -> Fraction | None:
    """Digits with a decimal point or comma; a comma before exactly three digits groups thousands."""
    if not t[0].isdigit():
        return None
    if re.fullmatch(r"[1-9]\d{0,2}(?:,\d{3})+(?:\.\d+)?", t):
        t = t.replace(",", "")
    t = t.replace(",", ".")
    try:
        return Fraction(t)
    except ValueError:
        return None


def _word_number(tokens: list[str], i: int) -> tuple[Fraction, int] | None:
    """A number in words from token i on: "forty-five", "a hundred", "half an", "two and a half"."""
    total, j, seen = Fraction(0), i, False
    if tokens[i] in ("a", "an"):
        if i + 1 < len(tokens) and tokens[i + 1] in ("hundred", "thousand", "half", "quarter"):
            j, total, seen = i + 1, Fraction(0), False
            if tokens[j] in ("hundred", "thousand"):
                total, seen, j = Fraction(100 if tokens[j] == "hundred" else 1000), True, j + 1
        elif i + 1 < len(tokens) and any(u.dims != NONE for u in NAMES.get(tokens[i + 1], ())) and len(tokens[i + 1]) > 2:
            return Fraction(1), i + 1
        else:
            return None
    while j < len(tokens):
        t = tokens[j]
        if t in _SMALL:
            total += _SMALL[t]
        elif t in _TENS:
            total += _TENS[t]
        elif t == "hundred" and seen:
            total *= 100
        elif t == "thousand" and seen:
            total *= 1000
        elif t in _FRACTIONS:
            total += _FRACTIONS[t]
            j += 1
            if j < len(tokens) and tokens[j] in ("a", "an"):
                j += 1
            return total, j
        elif seen and t == "-" and j + 1 < len(tokens) and tokens[j + 1] in _SMALL:
            pass
        elif seen and t == "and" and j + 1 < len(tokens) and (tokens[j + 1] in _SMALL or tokens[j + 1] in _TENS or tokens[j + 1] in ("a", "half")):
            if tokens[j + 1] == "a":
                j += 1
        else:
            break
        seen, j = True, j + 1
    return (total, j) if seen else None


def _lookup(name: str, expected: Dims | None) -> Unit | None:
    found = NAMES.get(name)
    if found:
        return next((u for u in found if u.dims == expected), found[0])
    for prefix, scale in PREFIXES.items():
        rest = name[len(prefix) :]
        if name.startswith(prefix) and rest in _PREFIXED:
            base = NAMES[rest][0] if rest != "m" else Unit(LENGTH)
            return Unit(base.dims, base.scale * scale)
    return None


def _unit(tokens: list[str], i: int, expected: Dims | None) -> tuple[Unit, int] | None:
    """unit := ["°"|"o"|"deg"|"degree(s)"] name [exponent] { ["/"|"per"|"·"|"*"] name [exponent] }"""
    j = i
    if j < len(tokens) and tokens[j] in ("°", "º", "o", "deg", "degree", "degrees", "oc", "of", "ok"):
        if tokens[j] in ("oc", "of", "ok"):
            return _lookup(tokens[j][1], TEMPERATURE), j + 1
        k = j + 1
        if k < len(tokens) and tokens[k] in (".", "-"):
            k += 1
        if k < len(tokens) and tokens[k] in NAMES and NAMES[tokens[k]][0].dims == TEMPERATURE:
            return _lookup(tokens[k], TEMPERATURE), k + 1
        return None
    out, power = None, 1
    while j < len(tokens):
        u = _lookup(tokens[j], expected if out is None else None)
        if u is None or tokens[j] in ("a", "in", "at"):
            break
        k, n = j + 1, 1
        if k < len(tokens) and tokens[k] == "^":
            k += 1
        if k + 1 < len(tokens) and tokens[k] == "-" and tokens[k + 1].isdigit() and len(tokens[k + 1]) == 1 and (u.dims != TIME or out):
            n, k = -int(tokens[k + 1]), k + 2
        elif k < len(tokens) and tokens[k].isdigit() and len(tokens[k]) == 1 and tokens[k - 1] == "^":
            n, k = int(tokens[k]), k + 1
        part = u ** (n * power)
        if out is None:
            out = part
        else:
            out = out * part
        j = k
        if j + 1 < len(tokens) and tokens[j] in ("/", "per"):
            power, j = -1, j + 1
        elif j + 1 < len(tokens) and tokens[j] in ("·", "*"):
            power, j = 1, j + 1
        elif out.dims in (TIME, TEMPERATURE):
            break
        else:
            power = 1
    return (out, j) if out is not None else None


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(unicodedata.normalize("NFKC", text.replace("º", "°").replace("℃", "°C").replace("℉", "°F")).translate(_DASH).lower())


def parse_unit(text: str | None, expected: Dims | None = None) -> Unit | None:
    """The unit named anywhere in a text ("all temperatures in degrees Fahrenheit"), the last one named."""
    if not text:
        return None
    tokens, found, i = _tokens(text), None, 0
    while i < len(tokens):
        if (len(tokens[i]) > 2 or len(tokens) <= 2 or expected is None or tokens[i] in "°") and (hit := _unit(tokens, i, expected)) and (expected is None or hit[0].dims == expected):
            found, i = hit
        else:
            i += 1
    return found


@dataclass(frozen=True)
class Quantity:
    """si: value in SI; bare: the number had no unit of its own, si is then the plain number."""

    si: Fraction
    bare: bool


def parse_quantity(text: str | None, expected: Dims) -> Quantity | None:
    """The one quantity that a text states, else None (no number, a range, a bound, several quantities)."""
    if not text or not text.strip():
        return None
    tokens = _tokens(text)
    if _BOUND.search(" ".join(tokens)):
        return None
    i, found, last_end = 0, [], -1
    while i < len(tokens):
        hit = None
        if (n := _number(tokens[i])) is not None:
            hit = n, i + 1
        elif tokens[i] in _SMALL or tokens[i] in _TENS or tokens[i] in _FRACTIONS or tokens[i] in ("a", "an"):
            hit = _word_number(tokens, i)
        if hit is None:
            i += 1
            continue
        value, j = hit
        if found and i - last_end == 1 and tokens[last_end] in ("-", "to", "~", "/", "or", "and", "±") or (found and tokens[last_end:i] == [".", "."]):
            return None
        if i and tokens[i - 1] == "-" and not found and (i == 1 or tokens[i - 2] in ("=", "at", "to", ":")):
            value = -value
        u = _unit(tokens, j, expected)
        if u and u[0].dims == expected:
            found.append((value, u[0]))
            j = u[1]
        else:
            found.append((value, None))
        i = last_end = j
    if not found:
        return None
    if len(found) == 1:
        value, unit = found[0]
        return Quantity(value, True) if unit is None else Quantity(value * unit.scale + unit.offset, False)
    units = [u for _, u in found]
    if expected == TEMPERATURE or None in units or any(a.scale <= b.scale for a, b in zip(units, units[1:])):
        return None
    return Quantity(sum(v * u.scale for v, u in found), False)


def convert(text: str | None, hint: str | None, default: str | None, expected: Dims, common: Unit, step: Fraction) -> int | None:
    """The value in steps of the common unit, rounded half up.

    A bare number takes the unit named in `hint`, else in `default`; a bare number that is already in the
    common unit gives None, as it needs no conversion.
    """
    q = parse_quantity(text, expected)
    if q is None:
        return None
    si = q.si
    if q.bare:
        unit = parse_unit(hint, expected) or parse_unit(default, expected)
        if unit is None or unit == common:
            return None
        si = q.si * unit.scale + unit.offset
    out = (si - common.offset) / common.scale / step
    out = (2 * out.numerator + out.denominator) // (2 * out.denominator)
    return out if -(2**63) <= out < 2**63 else None


def to_common(value: Column, hint: Column, default: Column, expected: Dims, common: Unit, step: Fraction) -> Column:
    """convert() as a column (bigint). Each distinct triple of a task is parsed once.

    The function counts as nondeterministic, so that a filter on its result isn't pushed below it and run again.
    """

    @F.pandas_udf("bigint")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo: dict = {}
        for v, h, d in batches:
            out = []
            for key in zip(v, h, d):
                if key not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[key] = convert(*(x if isinstance(x, str) else None for x in key), expected, common, step)
                out.append(memo[key])
            yield pd.Series(out, dtype="Int64")

    return run.asNondeterministic()(value, hint, default)


def common_quantities(devices: DataFrame, extractions: DataFrame, source_units: DataFrame) -> DataFrame:
    """p3: each stated quantity of the three mixed fields in seconds or hundredths of a degree Celsius."""
    time_field, temperature, duration = "Perovskite_deposition_thermal_annealing_time", "process_conditions.temperature", "process_conditions.duration"
    units = source_units.select(F.col("source").alias("_unit_source"), F.col("field_name").alias("_unit_field"), "unit_text").dropDuplicates(["_unit_source", "_unit_field"])

    def field(rows: DataFrame, table: str, rec: str, name: str, value: Column, hint: Column, expected: Dims, common: Unit, step: Fraction) -> DataFrame:
        own = units.where(F.col("_unit_field") == name)
        t = rows.select(F.col(rec).alias("rec_id"), "source", value.alias("_value"), hint.cast("string").alias("_hint")).where(F.length(F.trim("_value")) > 0)
        t = t.join(own, t["source"] == own["_unit_source"], "left")
        return t.select(F.lit(table).alias("table_name"), "rec_id", F.lit(name).alias("field_name"), to_common(F.col("_value"), F.col("_hint"), F.col("unit_text"), expected, common, step).alias("common_value")).where("common_value IS NOT NULL")

    p = "process_conditions"
    return (
        field(devices, "devices", "row_id", time_field, F.col(time_field), F.lit(None), TIME, MINUTE, Fraction(1, 60))
        .unionByName(field(extractions, "extractions", "record_id", duration, F.col(f"{p}.duration"), F.lit(None), TIME, MINUTE, Fraction(1, 60)))
        .unionByName(field(extractions, "extractions", "record_id", temperature, F.col(f"{p}.temperature"), F.col(f"{p}.annealing"), TEMPERATURE, CELSIUS, Fraction(1, 100)))
    )
