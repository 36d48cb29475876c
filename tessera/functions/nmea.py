"""NMEA sentences as column expressions; no Python runs on the executors."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often use names it: Spark copies an expression to each place that names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def xor_of(text: Column) -> Column:
    """The exclusive or of a text's characters."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: a.bitwiseXOR(F.ascii(c)))


def strip_checksum(sentence: Column) -> Column:
    """The body after '$'; null if a checksum after the last '*' is wrong or no hexadecimal number. Without '*' all is accepted."""

    def checked(body: Column) -> Column:
        tail = F.substring_index(body, "*", -1)
        head = F.left(body, F.length(body) - F.length(tail) - 1)
        told = F.left(tail, F.lit(2))
        good = told.rlike("^[0-9A-Fa-f]{1,2}$") & (F.conv(told, 16, 10).cast("int") == xor_of(head))
        return F.when(~F.contains(body, F.lit("*")), body).when(good, head)

    return bound(sentence, lambda s: bound(F.when(F.startswith(s, F.lit("$")), F.substring(s, 2, 1 << 30)).otherwise(s), checked))


def _coordinate(value: Column, hemisphere: Column, degrees: int, negative: str) -> Column:
    whole = F.substring(value, 1, degrees).try_cast("double")
    minutes = F.substring(value, degrees + 1, 30).try_cast("double")
    v = whole + minutes / 60
    return F.when(value == "", F.lit(0.0)).otherwise(F.when(F.upper(hemisphere) == negative, -v).otherwise(v))


def parse_lat(value: Column, hemisphere: Column) -> Column:
    """ddmm.mmmm to degrees; empty is 0."""
    return _coordinate(value, hemisphere, 2, "S")


def parse_lon(value: Column, hemisphere: Column) -> Column:
    return _coordinate(value, hemisphere, 3, "W")


def _number(f: Column, kind: str = "double") -> Column:
    """A field as a number; empty is 0, nonsense null."""
    return F.when(f == "", F.lit(0).cast(kind)).otherwise(f.try_cast(kind))


def parse_sentence(sentence: Column) -> Column:
    """struct of a GGA or RMC sentence of a GP or GN talker; null for others, short or damaged ones."""
    fields = F.split(strip_checksum(F.trim(sentence)), ",")
    return bound(fields, _parse_fields)


def _parse_fields(f: Column) -> Column:
    kind = F.upper(F.get(f, F.lit(0)))
    at = lambda i: F.get(f, F.lit(i))
    gga = F.struct(
        F.lit("GGA").alias("kind"), at(1).alias("time"), parse_lat(at(2), at(3)).alias("lat"), parse_lon(at(4), at(5)).alias("lon"),
        _number(at(6), "int").alias("quality"), _number(at(7), "int").alias("satellites"), _number(at(8)).alias("hdop"), _number(at(9)).alias("altitude"), _number(at(11)).alias("geoid"),
        F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("speed_knots"), F.lit(None).cast("double").alias("course"), F.lit(None).cast("string").alias("date"),
    )
    nothing = lambda t: F.lit(None).cast(t)
    rmc = F.struct(
        F.lit("RMC").alias("kind"), at(1).alias("time"), parse_lat(at(3), at(4)).alias("lat"), parse_lon(at(5), at(6)).alias("lon"),
        nothing("int").alias("quality"), nothing("int").alias("satellites"), nothing("double").alias("hdop"), nothing("double").alias("altitude"), nothing("double").alias("geoid"),
        at(2).alias("status"), _number(at(7)).alias("speed_knots"), _number(at(8)).alias("course"), at(9).alias("date"),
    )
    sound = lambda s, names: bound(s, lambda x: F.when(reduce(and_, [x[n].isNotNull() for n in names]), x))
    return F.when(kind.isin("GPGGA", "GNGGA") & (F.size(f) >= 15), sound(gga, ["lat", "lon", "quality", "satellites", "hdop", "altitude", "geoid"])).when(kind.isin("GPRMC", "GNRMC") & (F.size(f) >= 10), sound(rmc, ["lat", "lon", "speed_knots", "course"]))


def is_valid(status: Column) -> Column:
    return status == "A"


def with_fix(lines: DataFrame, column: str = "value", alias: str = "fix") -> DataFrame:
    """lines and the fix of each; those without one are dropped. A filter on the fix would be pushed below it and parse each line again, so lines are dropped as they are parsed."""
    return lines.select("*", F.explode(F.array_compact(F.array(parse_sentence(F.col(column))))).alias(alias))


def parse_nmea(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fixes of a table of lines (as spark.read.text gives it); other lines are dropped."""
    s = F.trim(F.col(column))
    return with_fix(lines.where(F.startswith(s, F.lit("$"))).select(F.col(column).alias("value"))).select("fix.*")
