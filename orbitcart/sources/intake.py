"""A1 — CSV intake in one pass, with a quarantine for rows that do not fit.

The files are read as lines of raw bytes. Each line is taken as UTF-8 where that is valid,
else as ISO-8859-1, so the encoding is settled line by line and no file is read twice for it.
The line is split into text columns once, and each is cast to its type; what fails is known by
name. The result is written in one job and read as good rows and bad ones.

Good rows have the schema's columns. Bad rows keep file, line, the reason (``columns``: the
number of fields is wrong; ``values``: a field does not parse; ``required``: a column that must
not be null is empty) and the names of the failing columns.

Defined cases: empty fields are nulls; blank lines are skipped; a line equal to the header is
one (every part file has its own); a column that the header lacks raises an error, one that the
schema lacks is not read, and their order is free; an empty folder of headers gives no rows. A
quoted field that runs over lines is not joined: its lines are quarantined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitcart.session import written_table


def decoded(line: Column) -> Column:
    """Raw line -> text."""
    return F.when(F.expr("is_valid_utf8(value)"), line).otherwise(F.decode(line.cast("binary"), "ISO-8859-1"))


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names from the first line of a file."""
    line = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).filter("trim(value) <> ''").first()
    if line is None:
        return []
    names = spark.range(1).select(F.split(F.lit(line["value"].rstrip("\r")), f"[{sep}]").alias("n")).first()["n"]
    return [n.strip().strip('"') for n in names]


def _typed(name: str, kind: T.DataType) -> Column:
    text = F.col(f"t.`{name}`")
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.try_to_timestamp(F.trim(text)).cast(kind)
    return F.trim(text).try_cast(kind)


def parsed(spark: SparkSession, path: str, schema: T.StructType, *, required: Sequence[str] = (), sep: str = ",",
           header: Sequence[str] | None = None) -> DataFrame:
    """The schema's columns, file, line, reason (null: good) and bad_columns of every row.

    ``header`` names the columns of files that have no header line.
    """
    header = list(header or header_of(spark, path, sep))
    lacking = [f.name for f in schema if header and f.name not in header]
    if lacking:
        raise ValueError(f"{path} lacks the columns {lacking}")
    header = header or schema.names
    text_schema = T.StructType([T.StructField(h, T.StringType()) for h in header] + [T.StructField("_broken", T.StringType())])
    lines = (spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), decoded(F.col("value")).alias("_line"))
             .withColumn("_line", F.regexp_replace("_line", "^﻿|\r$", "")).filter("trim(_line) <> ''"))
    lines = lines.filter(F.regexp_replace("_line", '["\\s]', "") != sep.join(h.replace(" ", "") for h in header))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "sep": sep, "escape": '"'}
    fields = lines.withColumn("t", F.from_csv("_line", text_schema.simpleString(), options))
    typed = fields.select("*", *[_typed(f.name, f.dataType).alias(f.name) for f in schema])
    failing = F.filter(F.array(*[F.when(F.col(f"t.`{f.name}`").isNotNull() & F.col(f"`{f.name}`").isNull(), F.lit(f.name)) for f in schema]),
                       lambda c: c.isNotNull())
    empty = F.filter(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in required]).cast("array<string>"), lambda c: c.isNotNull())
    reason = (F.when(F.col("t._broken").isNotNull(), "columns").when(F.size(failing) > 0, "values").when(F.size(empty) > 0, "required"))
    return typed.select(*[F.col(f"`{n}`") for n in schema.names], F.col("_file").alias("file"), F.col("_line").alias("line"), reason.alias("reason"),
                        F.when(reason == "values", failing).when(reason == "required", empty).alias("bad_columns"))


def take_in(spark: SparkSession, path: str, schema: T.StructType, *, required: Sequence[str] = (), sep: str = ",",
            header: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine: file, line, reason, bad_columns), both read from one written table."""
    rows = parsed(spark, path, schema, required=required, sep=sep, header=header)
    taken = written_table(rows.withColumn("line", F.when(F.col("reason").isNotNull(), F.col("line"))), "intake")
    return taken.filter("reason IS NULL").select(*[F.col(f"`{n}`") for n in schema.names]), \
        taken.filter("reason IS NOT NULL").select("file", "line", "reason", "bad_columns")
