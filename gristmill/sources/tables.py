"""Tables from files of several formats, and tables to files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The reader and its options for each suffix; ``.gz`` may follow the text ones.
FORMATS: dict[str, tuple[str, dict[str, str]]] = {
    ".csv": ("csv", {"header": "true", "sep": ","}),
    ".txt": ("csv", {"header": "true", "sep": ","}),
    ".tsv": ("csv", {"header": "true", "sep": "\t"}),
    ".tab": ("csv", {"header": "true", "sep": "\t"}),
    ".jsonl": ("json", {}),
    ".ndjson": ("json", {}),
    ".json": ("json", {"multiLine": "true"}),
    ".parquet": ("parquet", {}),
    ".pq": ("parquet", {}),
}


def source_suffix(path: str) -> str:
    """The suffix that tells the format; a closing ``.gz`` is looked through."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    name = name.removesuffix(".gz")
    return f".{name.rsplit('.', 1)[1]}" if "." in name else ""


def is_supported(path: str) -> bool:
    return source_suffix(path) in FORMATS


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sampling_ratio: float = 1.0, suffix: str | None = None) -> DataFrame:
    """A table by its path's suffix (or by ``suffix``, for folders). Without a schema, text formats are inferred from a sample.

    A gzipped text file is one partition; repartition what is read if much follows.
    """
    suffix = suffix or source_suffix(path)
    if suffix not in FORMATS:
        raise ValueError(f"no reader for {suffix or 'files without a suffix'}; there is one for {', '.join(FORMATS)}")
    kind, options = FORMATS[suffix]
    reader = spark.read.format(kind).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.options(inferSchema="true", samplingRatio=str(sampling_ratio))
    elif kind == "json":
        reader = reader.options(samplingRatio=str(sampling_ratio))
    return reader.load(path)


def misfits(text: DataFrame, schema: T.StructType) -> DataFrame:
    """One row: for each column, how many non-null strings of ``text`` the type in ``schema`` cannot hold."""
    return text.select(
        *(F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name) for f in schema)
    )


def load_csv_checked(spark: SparkSession, path: str, sampling_ratio: float = 0.1) -> DataFrame:
    """A CSV whose types come from a sample, but from all rows if a later row does not fit them."""
    guess = load_table(spark, path, sampling_ratio=sampling_ratio, suffix=".csv").schema
    text = load_table(spark, path, T.StructType([T.StructField(f.name, T.StringType()) for f in guess]), suffix=".csv")
    if any(misfits(text, guess).first()):
        return load_table(spark, path, suffix=".csv")
    return text.select(*(F.col(f.name).cast(f.dataType) for f in guess))


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def with_header(df: DataFrame, names: Sequence[str], renames: Mapping[str, str] | None = None) -> DataFrame:
    """Names for a table without a header, then renames."""
    return df.toDF(*names).withColumnsRenamed(dict(renames or {}))


def save_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet (zstd) or CSV with a header."""
    if kind == "parquet":
        df.write.option("compression", "zstd").parquet(path)
    elif kind == "csv":
        df.write.option("header", True).csv(path)
    else:
        raise ValueError(f"no writer for {kind}")


EVENT = "seq long, run_id string, ts timestamp, stage string, agent string, kind string, message string, payload string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An event log in JSON lines; blank lines are skipped, payloads stay JSON."""
    return spark.read.schema(EVENT).json(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A result CSV: blanks are null, types are those of the schema."""
    return spark.read.option("header", True).option("nullValue", "").schema(schema).csv(path)


def append_known(df: DataFrame, path: str, known: Sequence[str]) -> None:
    """Appends the columns that the table at ``path`` knows; others are dropped."""
    df.select(*(c for c in known if c in df.columns)).write.mode("append").parquet(path)


def union_ragged(frames: Mapping[str, DataFrame], source_col: str = "source") -> DataFrame:
    """All rows of tables with different columns, with the name of the table that each comes from."""
    named = [df.withColumn(source_col, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def register(spark: SparkSession, path: str, destination: str, catalogue: str, suffix: str | None = None) -> DataFrame:
    """Copies a source to Parquet at ``destination`` and appends (source, destination, rows, columns) to the catalogue table."""
    save_table(require_rows(load_table(spark, path, suffix=suffix)), destination)
    stored = spark.read.parquet(destination)
    entry = stored.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(path).alias("source_path"), F.lit(destination).alias("parquet_path"), "n_rows", F.lit(len(stored.columns)).alias("n_columns")
    )
    entry.write.mode("append").parquet(catalogue)
    return stored
