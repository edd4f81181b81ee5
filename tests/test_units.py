from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedge.operators.units import CELSIUS, LENGTH, MINUTE, TEMPERATURE, TIME, common_quantities, convert, parse_quantity, parse_unit

SECONDS, CENTI = Fraction(1, 60), Fraction(1, 100)


@pytest.mark.parametrize(
    "text, unit, seconds",
    [
        ("10 min", None, 600), ("1,5 h", None, 5400), ("1h30m", None, 5400), ("1 min 30 s", None, 90), ("half an hour in air", None, 1800), ("held for forty-five minutes", None, 2700), ("ca. 3 min", None, 180), ("~1.5 hr", None, 5400),
        ("90", "seconds", 90), ("2", "hours", 7200), ("5", "minutes", None), ("5", None, None), ("5-10 min", None, None), ("10–15 min", None, None), ("< 2 h", None, None), ("several hours", None, None), ("overnight", None, None),
        ("two and a half hours", None, 9000), ("1,200 s", None, 1200), ("an hour", None, 3600), ("3 to 5 min", None, None), (None, "seconds", None), ("", "seconds", None), ("0 s", None, 0),
    ],
)
def test_times(text, unit, seconds):
    assert convert(text, None, unit, TIME, MINUTE, SECONDS) == seconds


@pytest.mark.parametrize(
    "text, hint, unit, value",
    [
        ("373.15 K", None, None, 10000), ("212 °F", None, None, 10000), ("147 º C", None, None, 14700), ("185 oC", None, None, 18500), ("93 ℃", None, None, 9300), ("one hundred degrees Celsius", None, None, 10000), ("a hundred degrees C", None, None, 10000),
        ("373", "all temperatures in kelvin", "degrees Celsius", 9985), ("100", "set point in degrees Celsius", "kelvin", None), ("338F", None, None, 17000), ("T = 416 K", None, None, 14285), ("-5 °C", None, None, -500), ("> 90 °C", None, None, None), ("room temperature", None, None, None), ("80–100", "kelvin", None, None),
    ],
)
def test_temperatures(text, hint, unit, value):
    assert convert(text, hint, unit, TEMPERATURE, CELSIUS, CENTI) == value


def test_units_are_exponent_vectors():
    assert parse_unit("mA cm-2").dims == (-2, 0, 0, 1, 0, 0)
    assert parse_unit("mol/L").scale == 1000 and parse_unit("nm", LENGTH).scale == Fraction(1, 10**9)
    assert parse_quantity("x" * 200_000 + " 5 min", TIME).si == 300


def test_common_quantities_defines_every_case(spark):
    c = "Perovskite_deposition_thermal_annealing_time"
    devices = spark.createDataFrame([(1, "a", "10 min", "x"), (2, None, "30", "x"), (3, "a", "30", "x"), (3, "a", "30", "x"), (4, "a", None, "x")], f"row_id bigint, source string, `{c}` string, unit_text string")
    ex = spark.createDataFrame([(1, "a", ("373 K", None, None, None)), (2, "a", None)], "record_id bigint, source string, process_conditions struct<temperature:string,duration:string,atmosphere:string,annealing:string>")
    units = spark.createDataFrame([("a", c, "seconds")], "source string, field_name string, unit_text string")
    got = sorted((r["table_name"], r["rec_id"], r["common_value"]) for r in common_quantities(devices, ex, units).collect())
    assert got == [("devices", 1, 600), ("devices", 3, 30), ("devices", 3, 30), ("extractions", 1, 9985)]
    assert common_quantities(devices.limit(0), ex.limit(0), units.limit(0)).count() == 0


#: Written forms with what a number in them is in seconds or kelvin.
TIMES = {"s": 1, "sec": 1, " seconds": 1, " min": 60, "min.": 60, " minutes": 60, "h": 3600, " hrs": 3600, " hours": 3600, " days": 86400, " ms": Fraction(1, 1000)}
KELVINS = {" K": (1, 0), " kelvin": (1, 0), " °C": (1, Fraction("273.15")), "°C": (1, Fraction("273.15")), " deg C": (1, Fraction("273.15")), " °F": (Fraction(5, 9), Fraction("459.67") * Fraction(5, 9)), " degrees Fahrenheit": (Fraction(5, 9), Fraction("459.67") * Fraction(5, 9))}


def _half_up(x):
    return (2 * x.numerator + x.denominator) // (2 * x.denominator)


@settings(max_examples=300, deadline=None)
@given(st.decimals(0, 5000, places=2), st.sampled_from(sorted(TIMES)), st.sampled_from(["{}", "ca. {}", "~{}", "annealed for {} in air", "approx. {}"]), st.booleans())
def test_written_times_come_back(value, unit, around, comma):
    said = str(value).replace(".", ",") if comma else str(value)
    assert convert(around.format(said + unit), None, None, TIME, MINUTE, SECONDS) == _half_up(Fraction(value) * TIMES[unit])


@settings(max_examples=300, deadline=None)
@given(st.decimals(0, 2000, places=1), st.sampled_from(sorted(KELVINS)), st.sampled_from(["{}", "about {}", "heated to {} in nitrogen"]))
def test_written_temperatures_come_back(value, unit, around):
    scale, offset = KELVINS[unit]
    assert convert(around.format(f"{value}{unit}"), None, None, TEMPERATURE, CELSIUS, CENTI) == _half_up((Fraction(value) * scale + offset - Fraction("273.15")) * 100)
