"""Delimited text: reading a source, and writing what another system loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.transforms import scrub_non_finite
from ..naming import quoted


def write_delimited(df: DataFrame, path: str, sep: str = "\t", null: str = "\\N", header: bool = False, quote: str = '"') -> None:
    """Write df as delimited text: non-finite numbers as null, booleans as 0 and 1, times as text in the
    session's zone. Values with a separator, quote or line break are quoted, so they read back whole."""
    clean = scrub_non_finite(df)
    shown = []
    for f in clean.schema.fields:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        shown.append(c.alias(f.name))
    clean.select(*shown).write.csv(path, sep=sep, nullValue=null, emptyValue=2 * quote, header=header, quote=quote, escape=quote)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t", null: str = "\\N", header: bool = False, quote: str = '"') -> DataFrame:
    """Read delimited text by a declared schema; nothing is inferred. 0 and 1 are booleans."""
    raw = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.BooleanType) else f.dataType) for f in schema.fields])
    rows = spark.read.csv(path, schema=raw, sep=sep, nullValue=null, emptyValue="", header=header, quote=quote, escape=quote, multiLine=True)
    flags = {f.name: F.col(quoted(f.name)).cast("int").cast("boolean") for f in schema.fields if isinstance(f.dataType, T.BooleanType)}
    return rows.select(*[flags.get(f.name, F.col(quoted(f.name))).alias(f.name) for f in schema.fields])
