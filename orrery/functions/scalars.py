"""Scalar functions as column expressions, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in km."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def planar_square(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared planar distance in degrees, with longitudes shortened by the first point's latitude."""
    return F.pow(lat2 - lat1, 2) + F.pow((lon2 - lon1) * F.cos(F.radians(lat1)), 2)


def proximity(distance: Column, scale: Column | float) -> Column:
    return F.exp(-distance / scale)


def round_cut(value: Column, digits: int = 3) -> Column:
    """Rounded half-even to significant digits."""
    size = F.floor(F.log10(F.abs(value)))
    scale = F.pow(F.lit(10.0), F.greatest(digits - 1 - size, F.lit(0)))
    return F.when(value == 0, 0.0).otherwise(F.rint(value * scale) / scale)


def month_number(ts: str) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("long")


def quarter_key(m: Column) -> Column:
    return F.concat(F.floor(m / 12).cast("string"), F.lit("Q"), (F.floor(m % 12 / 3) + 1).cast("string"))


def decimal(text: Column) -> Column:
    """A number that may have a decimal comma."""
    return F.try_to_number(F.replace(F.trim(text), F.lit(","), F.lit(".")), F.lit("S99999999999999999999.999999999999999")).cast("double")


def untagged(text: Column) -> Column:
    """Scalars of a service that tags its values (`__number__1.5`, `__null__`, `__string__` with base64), as text."""
    tag, raw = F.regexp_extract(text, r"(?s)^__([a-z]+)__", 1), F.regexp_replace(text, r"^__[a-z]+__", "")
    return F.when(tag == "", text).when(tag == "null", F.lit(None)).when(tag == "string", F.unbase64(raw).cast("string")).otherwise(raw)


def unescape_unicode(text: Column) -> Column:
    """\\uXXXX sequences of a script's text as characters, by reading it as a JSON string."""
    quoted = F.replace(text, F.lit('"'), F.lit('\\"'))
    return F.from_json(F.concat(F.lit('{"t":"'), quoted, F.lit('"}')), "t string")["t"]


def one_hot(df: DataFrame, column: str, values, prefix: str) -> DataFrame:
    """A column of zeros and ones for each value, named by prefix and value."""
    return df.withColumns({f"{prefix}{v}": (F.col(column) == v).cast("int") for v in values})


def comma_list(items: Column) -> Column:
    return F.array_join(items, ", ")


def from_comma_list(text: str) -> Column:
    """Items of a list written with commas, without the space around them."""
    return F.transform(F.split(F.col(text), ","), lambda x: F.trim(x))


def configuration_name(method: Column, alpha: Column) -> Column:
    """A method with its weight of the graph, if it has one."""
    return F.concat(method, F.coalesce(F.when(alpha.isNotNull(), F.concat(F.lit(" α "), F.format_string("%.1f", alpha))), F.lit("")))


def conditions_text(conditions: list[tuple[Column, Column, Column]]) -> Column:
    return F.concat_ws(" and ", *(F.concat_ws(" ", *c) for c in conditions))
