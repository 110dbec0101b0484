"""Uniform numbers that are the same in Spark, SQL text and Python, whatever the partitioning."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = 4294967296.0


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by ``|``."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(_SPAN)


def uniform_sql(*parts: str) -> str:
    """The same for DuckDB; parts are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::bigint / {_SPAN})"


def uniform_py(*parts: object) -> float:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / _SPAN
