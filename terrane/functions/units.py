"""Speeds, weights and lengths as tags write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*(\d+(?:[.,]\d+)?)\s*"


def _number(c, unit: str) -> Column:
    """The number of a text that is a number and a unit, else null."""
    text = F.regexp_extract(c, NUMBER + unit + r"\s*$", 1)
    return F.regexp_replace(F.nullif(text, F.lit("")), ",", ".").try_cast("double")


def speed_kmh(c) -> Column:
    """Kilometres an hour of '50', '50 km/h', '30 mph', '10 knots'."""
    return F.coalesce(_number(c, r"(?:km/?h|kmh|kph)?"), _number(c, "mph") * 1.60934, _number(c, "knots") * 1.852)


def weight_kg(c) -> Column:
    """Kilograms of '1500', '1500 kg', '3.5 t'; a bare number is in tonnes."""
    return F.coalesce(_number(c, "kg"), _number(c, "(?:t|tonnes)?") * 1000)


def length_m(c) -> Column:
    """Metres of '2', '2 m', 6'7\"."""
    feet = F.nullif(F.regexp_extract(c, r"^\s*(\d+)'\s*(?:(\d+)\")?\s*$", 1), F.lit("")).try_cast("double")
    inches = F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*(\d+)'\s*(?:(\d+)\")?\s*$", 2), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.coalesce(_number(c, "m?"), feet * 0.3048 + inches * 0.0254)
