"""Text corpora: csv, json lines, plain text, tables; batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_SCHEMA = T.StructType(
    [T.StructField("prefix", T.StringType()), T.StructField("text", T.StringType())]
)
INSTRUCTION_SCHEMA = T.StructType(
    [
        T.StructField("instruction", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
    ]
)
PLAIN_SCHEMA = T.StructType([T.StructField("text", T.StringType())])

FORMATS = ("csv", "json", "txt")


def corpus_format(paths: list[str], fmt: str | None = None) -> str:
    """The format named, or the extension of the first path."""
    found = fmt or paths[0].rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1]
    if found not in FORMATS:
        raise ValueError(f"a corpus must be one of {FORMATS}, not {found!r}")
    return found


def read_corpus(
    spark: SparkSession,
    paths: str | list[str],
    fmt: str | None = None,
    schema: T.StructType | None = None,
    keep_linebreaks: bool = True,
) -> DataFrame:
    """One data set from one or many files; a string may name several, comma-separated.

    Give ``schema`` for large inputs: inference reads them once more.
    """
    files = paths.split(",") if isinstance(paths, str) else list(paths)
    kind = corpus_format(files, fmt)
    if kind == "txt":
        return read_text(spark, files, keep_linebreaks)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "json":
        return reader.json(files)
    return reader.csv(files, header=True, multiLine=True, escape='"')


def read_text(spark: SparkSession, paths: list[str], keep_linebreaks: bool = True) -> DataFrame:
    """One row per line; the line end is kept by default.

    A last line that has no line end in the file gets one as well.
    """
    lines = spark.read.text(paths)
    end = F.lit("\n" if keep_linebreaks else "")
    return lines.select(F.concat("value", end).alias("text"))


def load_table(spark: SparkSession, name: str) -> DataFrame:
    """A data set by name: any table or view the session knows."""
    return spark.table(name)


def read_corpus_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", keep_linebreaks: bool = True, **options
) -> DataFrame:
    """The same files as a stream; a stream needs its schema. Text lines keep their line end as in a batch."""
    kind = corpus_format([path], fmt)
    reader = spark.readStream.schema(schema).options(**options)
    if kind == "csv":
        return reader.csv(path, header=True, multiLine=True, escape='"')
    if kind == "txt":
        lines = spark.readStream.options(**options).text(path)
        return lines.select(F.concat("value", F.lit("\n" if keep_linebreaks else "")).alias("text"))
    return reader.json(path)


def showcase(df: DataFrame, key: str, n: int = 4) -> DataFrame:
    """The first prepared samples, to look at."""
    return df.orderBy(key).limit(n)
