"""Entity tags: quoted MD5 in hex, with a part count for multipart uploads."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stocktake.schema import NO_ETAG

_QUOTED = r'^"([0-9a-fA-F]{32})(?:-([0-9]+))?"$'


def parse(raw: Column) -> Column:
    """``struct(md5, parts)`` of a raw tag with its quotes; the unavailable one where it is malformed.

    A well-formed digest with a part count that is no 32-bit number counts as malformed.
    """
    md5 = F.lower(F.regexp_extract(raw, _QUOTED, 1))
    count = F.regexp_extract(raw, _QUOTED, 2)
    parts = F.when(count == "", F.lit(0)).otherwise(count.try_cast("bigint"))
    fine = F.coalesce((md5 != "") & (parts <= 4294967295), F.lit(False))
    return F.struct(F.when(fine, md5).otherwise(NO_ETAG).alias("md5"), F.when(fine, parts).otherwise(F.lit(0)).cast("long").alias("parts"))


def render(md5: Column, parts: Column) -> Column:
    return F.when(parts == 0, md5).otherwise(F.concat(md5, F.lit("-"), parts.cast("string")))


def normalise(raw: Column) -> Column:
    """A raw tag as inventories show it."""
    tag = parse(raw)
    return render(tag["md5"], tag["parts"])


def available(etag: Column) -> Column:
    return etag != NO_ETAG
