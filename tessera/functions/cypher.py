"""Scalar functions of the pattern language as Column builders, by the name used in query text.

Where Spark's function of the same name differs (zero-based substring, integer
division, literal split, power), the builder has the pattern language's meaning.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geo, science

_TYPE_NAMES = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "FLOAT", "float": "FLOAT", "string": "STRING", "boolean": "BOOLEAN", "date": "DATE", "void": "NULL"}


def divide(a: Column, b: Column, integers: bool) -> Column:
    """Division; two integers give the quotient cut towards zero."""
    return F.call_function("div", a, b) if integers else a / b


def xor(a: Column, b: Column) -> Column:
    return a != b


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """Zero-based."""
    return F.substring(s, start + 1, length) if length is not None else F.substring(s, start + 1, F.length(s))


def split(s: Column, literal: str) -> Column:
    return F.split(s, re.sub(r"([^\w\s])", r"\\\1", literal))


def to_integer(x: Column) -> Column:
    return F.coalesce(x.try_cast("bigint"), x.try_cast("double").try_cast("bigint"))


def to_float(x: Column) -> Column:
    return x.try_cast("double")


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def round_half_up(x: Column) -> Column:
    return F.round(x.cast("double"), 0)


def value_type(x: Column) -> Column:
    """Type name: INTEGER, FLOAT, STRING, BOOLEAN, NULL, LIST, MAP, DATE, LOCAL TIME, LOCAL DATETIME or DURATION."""
    kind = F.typeof(x)
    out = F.when(x.isNull(), "NULL")
    for name, shown in _TYPE_NAMES.items():
        out = out.when(kind == name, shown)
    return out.when(kind.startswith("array"), "LIST").when(kind.startswith("map") | kind.startswith("struct"), "MAP").when(kind.startswith("interval"), "DURATION").when(kind.startswith("time("), "LOCAL TIME").when(kind.startswith("timestamp"), "LOCAL DATETIME").otherwise(F.upper(kind))


def size(x: Column, text: bool) -> Column:
    return (F.length(x) if text else F.size(x)).cast("bigint")


def head(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def last(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def tail(xs: Column) -> Column:
    return F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0)))


def range_list(a: Column, b: Column) -> Column:
    """Inclusive; empty if a is beyond b."""
    return F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<bigint>"))


def duration(text: str) -> tuple[int, int]:
    """(months, seconds) of an ISO 8601 duration such as ``P1Y2M3DT4H5M6S``."""
    m = re.fullmatch(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", text)
    if not m or text in ("P", "PT") or text.endswith("T"):
        raise ValueError(f"not a duration: {text}")
    y, mo, w, d, h, mi, s = (int(g or 0) for g in m.groups())
    return 12 * y + mo, ((7 * w + d) * 24 + h) * 3600 + 60 * mi + s


def plus_duration(x: Column, text: str) -> Column:
    """A date or timestamp moved by a duration; a date stays a date if whole days are added."""
    months, seconds = duration(text)
    out = x + F.make_ym_interval(F.lit(0), F.lit(months)) if months else x
    days, rest = divmod(seconds, 86400)
    return out + F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), F.lit(rest)) if rest else F.date_add(out, days) if days and not months else out + F.make_dt_interval(F.lit(days)) if days else out


def point(x: Column, y: Column, z: Column | None = None, srid: int = 7203) -> Column:
    parts = [x.cast("double").alias("x"), y.cast("double").alias("y")]
    if z is not None:
        parts.append(z.cast("double").alias("z"))
    return F.struct(*parts, F.lit(srid).alias("srid"))


def normal_cdf(x: Column) -> Column:
    """By the error function's rational form of Abramowitz and Stegun 7.1.26."""
    z = F.abs(x) / 2**0.5
    t = 1 / (1 + 0.3275911 * z)
    # The five coefficients of that form.
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def probit(p: Column) -> Column:
    """By the rational form of Abramowitz and Stegun 26.2.23."""
    low = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(low))
    # The six coefficients of that form.
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p < 0.5, -z).otherwise(z)


#: name in query text (lower case) -> builder of columns
REGISTRY: dict[str, Callable[..., Column]] = {
    "toupper": F.upper, "tolower": F.lower, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim,
    "replace": F.replace, "substring": substring, "left": F.left, "right": F.right,
    "startswith": lambda a, b: F.startswith(a, b), "endswith": lambda a, b: F.endswith(a, b), "contains": lambda a, b: F.contains(a, b),
    "reverse": F.reverse, "abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"),
    "round": round_half_up, "sign": sign, "tointeger": to_integer, "tofloat": to_float, "tostring": lambda x: x.cast("string"),
    "rand": lambda: F.rand(), "sqrt": F.sqrt, "log": F.log, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "atan2": F.atan2, "pi": F.pi, "radians": F.radians, "degrees": F.degrees,
    "coalesce": F.coalesce, "head": head, "last": last, "tail": tail, "range": range_list, "valuetype": value_type,
    "date": lambda s: F.to_date(s), "localdatetime": lambda s: F.to_timestamp_ntz(s), "point": point,
    "haversine_distance": geo.haversine_distance, "geo.bearing": geo.bearing, "geo.is_ahead": geo.is_ahead, "geo.destination": geo.destination, "geo.to_utm": geo.to_utm, "geo.to_mgrs": geo.to_mgrs,
    "orbital.velocity": science.orbital_velocity, "orbital.period": science.orbital_period, "orbital.escape_velocity": science.escape_velocity, "orbital.hohmann": science.hohmann,
    "physics.lorentz": science.lorentz, "physics.time_dilation": science.time_dilation, "physics.gps_correction": science.gps_correction,
    "ocean.sound_speed": science.sound_speed, "ocean.drift": science.drift, "mil.radar_horizon": science.radar_horizon, "mil.ballistic_range": science.ballistic_range,
    "list.sort": F.array_sort,
}


def returns_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)
