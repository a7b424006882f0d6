"""Result shaping shared by the registered queries: ISO text for dates and times, joined text for arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso(df: DataFrame) -> DataFrame:
    """Dates as yyyy-MM-dd, times as yyyy-MM-dd HH:mm:ss, string arrays joined by '; '."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampNTZType | T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "; ")
        out.append(c.alias(f.name))
    return df.select(*out)
