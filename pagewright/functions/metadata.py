"""Identity and metadata of elements: ids, file names, regex metadata, merging, coordinates, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import METADATA, METADATA_FIELDS


def element_id(t: Column) -> Column:
    """The first 32 hexadecimal digits of the text's SHA-256, so equal texts share an id."""
    return F.substring(F.sha2(t, 256), 1, 32)


def uuid_id() -> Column:
    return F.uuid()


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_directory(path: Column) -> Column:
    """What comes before the file's name; null where there is no folder."""
    return F.nullif(F.regexp_replace(path, r"/?[^/]*$", ""), F.lit(""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def last_modified(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def exif_datetime(s: Column) -> Column:
    return F.try_to_timestamp(s, F.lit("yyyy:MM:dd HH:mm:ss"))


def base64_content(c: Column) -> Column:
    """The bytes of base64 text, with or without a data-URL head."""
    return F.unbase64(F.element_at(F.split(c, ","), -1))


def merge_metadata(own: Column, new: Column) -> Column:
    """New fields win; where they are null, the element's own stay."""
    return F.struct(*[F.coalesce(new[k], own[k]).alias(k) for k in METADATA_FIELDS])


def strip_metadata(elements: DataFrame) -> DataFrame:
    return elements.withColumn("metadata", F.lit(None).cast(METADATA))


def regex_metadata(t: Column, patterns: dict[str, str]) -> Column:
    """For each named pattern its matches as (text, start, end); names without any aren't in the map."""

    def matches(pattern: str) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        none = F.array().cast("array<struct<text:string,start:int,end:int>>")

        def step(a: Column, m: Column) -> Column:
            # a match starts where the pattern, at or after the end of the one before, is found next
            start = (a["at"] + F.regexp_instr(F.substring(t, a["at"] + 1, F.length(t)), F.lit(pattern)) - 1).cast("int")
            end = (start + F.length(m)).cast("int")
            return F.struct(F.array_append(a["done"], F.struct(m.alias("text"), start.alias("start"), end.alias("end"))).alias("done"), end.alias("at"))

        return F.aggregate(F.filter(found, lambda m: m != ""), F.struct(none.alias("done"), F.lit(0).alias("at")), step, lambda a: a["done"])

    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), matches(p).alias("value")) for k, p in patterns.items()]))
    return F.map_filter(pairs, lambda _, v: F.size(v) > 0)


#: Name of a coordinate system, and whether its y axis points up.
SYSTEMS = {"RelativeCoordinateSystem": True, "PixelSpace": False, "PointSpace": True, "Relative": True, "CoordinateSystem": True}


def convert_point(x: Column, y: Column, width: Column, height: Column, new_width: Column, new_height: Column, up: bool, new_up: bool) -> Column:
    """A point of one system in another, by way of shares of width and height with y pointing up."""
    rx = x / width
    ry = y / height if up else F.lit(1.0) - y / height
    return F.struct((rx * new_width).alias("x"), (ry * new_height if new_up else new_height - ry * new_height).alias("y"))


def convert_coordinates(c: Column, system: str, width: float, height: float) -> Column:
    """A coordinates struct in another system; null where the old or the new one has no extent."""
    w, h = F.lit(float(width)), F.lit(float(height))

    def points(up: bool) -> Column:
        return F.transform(c["points"], lambda p: convert_point(p["x"], p["y"], c["layout_width"], c["layout_height"], w, h, up, SYSTEMS[system]))

    old_up = c["system"].isin([k for k, v in SYSTEMS.items() if v])
    there = (c["layout_width"] > 0) & (c["layout_height"] > 0) & (w > 0) & (h > 0)
    return F.when(there, F.struct(F.when(old_up, points(True)).otherwise(points(False)).alias("points"), F.lit(system).alias("system"), w.alias("layout_width"), h.alias("layout_height")))


def flat_columns(schema: T.StructType, prefix: str = "", separator: str = "_", cut: str = "") -> list[Column]:
    """Columns for all leaves of a schema, nested names joined, without ``cut`` at the front."""
    out: list[Column] = []
    for f in schema.fields:
        path = f"{prefix}.`{f.name}`" if prefix else f"`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            out += flat_columns(f.dataType, path, separator, cut)
        else:
            out.append(F.col(path).alias(path.replace("`", "").replace(".", separator).removeprefix(cut)))
    return out


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    return df.select(*flat_columns(df.schema, separator=separator))
