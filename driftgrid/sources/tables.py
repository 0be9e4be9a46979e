"""Readers and writers of the long tables: missing values become NULL at the door."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.functions.columns import missing, wrap_longitude
from driftgrid.operators.fields import season_means
from driftgrid.schemas import SCHEMAS


def read_cells(spark: SparkSession, path: str, *, variable: str | None = None, months: list[int] | None = None, years: tuple[int, int] | None = None, member: int | None = None) -> DataFrame:
    """Cells of a partitioned table; the filters prune partitions and row groups."""
    df = spark.read.parquet(path)
    for on, want in (("variable", variable), ("member", member)):
        df = df if want is None else df.where(F.col(on) == want)
    df = df if months is None else df.where(F.col("month").isin(months))
    df = df if years is None else df.where(F.col("year").between(*years))
    return df.withColumn("value", missing(F.col("value")))


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named columns of a table; an unknown name is an error."""
    return spark.read.parquet(path).select(*columns)


def read_typed(spark: SparkSession, name: str, path: str, **equal: object) -> DataFrame:
    """The table ``name`` of SCHEMAS: its columns and types, missing numbers NULL.

    ``equal`` gives a value or a list of values for columns; partitions and row
    groups without them aren't read, and a value that no partition has gives no
    rows. A column that the files lack is an error.
    """
    df = spark.read.parquet(path)
    for on, want in equal.items():
        df = df.where(F.col(on).isin(want) if isinstance(want, list | tuple) else F.col(on) == want)
    kinds = spark.createDataFrame([], SCHEMAS[name]).schema
    number = ("float", "double")
    return df.select(*((missing(F.col(f.name)) if f.dataType.typeName() in number else F.col(f.name)).cast(f.dataType).alias(f.name) for f in kinds))


def typed(df: DataFrame, name: str) -> DataFrame:
    """The columns of the table ``name`` of SCHEMAS, in its types."""
    kinds = df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds))


def read_labels(spark: SparkSession, path: str, *, variable: str, month: int, years: tuple[int, int]) -> DataFrame:
    """Events of one variable and calendar month whose windows start within the years; their partition alone is read."""
    return read_typed(spark, "events", path, variable=variable, month=month).where(F.col("start_year").between(*years))


def read_where_present(spark: SparkSession, name: str, paths: list[str]) -> DataFrame:
    """The tables at ``paths``, one below the other; a path that doesn't exist is skipped."""
    out = spark.createDataFrame([], SCHEMAS[name])
    for path in paths:
        try:
            one = read_typed(spark, name, path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = out.unionByName(one)
    return out


def seasonal_indices(indices: DataFrame, names: list[str], season: str) -> DataFrame:
    """member, year, index, value: season means of the named indices; one that isn't there has no rows."""
    return season_means(indices.where(F.col("index").isin(names)), season, keys=["member", "year", "index"])


def read_observed(spark: SparkSession, path: str, *, epoch: str = "1800-01-01", drop_last: int = 6, fill_below: float = -9e3, years: tuple[int, int] | None = None) -> DataFrame:
    """Observed cells: day offsets to dates, the last steps dropped, fill values missing."""
    df = spark.read.parquet(path)
    day = F.date_add(F.lit(epoch).cast("date"), F.col("day_offset"))
    out = df.select(F.year(day).alias("year"), F.month(day).alias("month"), "lat", "lon", F.when(F.col("value") >= fill_below, missing(F.col("value"))).alias("value"))
    t = F.col("year") * 12 + F.col("month")
    last = out.agg(F.max(t).alias("__last"))
    out = out.join(F.broadcast(last)).where(t <= F.col("__last") - drop_last).drop("__last")
    return out if years is None else out.where(F.col("year").between(*years))


def read_monthly(sheets: dict[int, DataFrame], column: str, bounds: dict[int, tuple[int, int]]) -> DataFrame:
    """Twelve monthly sheets as one series (year, month, value), each within its own first and last year."""
    out = None
    for month, df in sheets.items():
        one = df.where(F.col("year").between(*bounds[month])).select(F.col("year").cast("int"), F.lit(month).alias("month"), missing(F.col(column).cast("double")).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def grid_from_axes(lats: DataFrame, lons: DataFrame) -> DataFrame:
    """The mesh of two axes with wrapped longitudes; i and j number them."""
    nj = lons.agg(F.count("*").alias("nj"))
    mesh = lats.select("i", "lat").join(lons.select("j", wrap_longitude(F.col("lon")).alias("lon"))).join(F.broadcast(nj))
    return mesh.select((F.col("i") * F.col("nj") + F.col("j")).cast("int").alias("cell_id"), "i", "j", "lat", "lon")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Training histories: JSON objects of arrays by epoch."""
    return spark.read.schema(SCHEMAS["history"]).json(path)


def as_at(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """``df`` with the value types of the table at ``path``, if there is one; other columns than the table has are an error."""
    try:
        held = df.sparkSession.read.parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return df
    if set(held.names) != set(df.columns):
        raise ValueError(f"{path} has the columns {sorted(held.names)}, the rows {sorted(df.columns)}")
    return df.select(*(F.col(f.name) if f.name in by else F.col(f.name).cast(f.dataType).alias(f.name) for f in held))


def write_table(df: DataFrame, path: str, *, by: list[str], mode: str = "overwrite", whole: bool = False, codec: str = "zstd", units: dict[str, str] | None = None, sort: list[str] | None = None) -> None:
    """Partitioned Parquet; units go to column metadata.

    Overwriting replaces the partitions that ``df`` has rows of and leaves the
    others, so writing the same rows again changes nothing; values take the
    types that the table has. With ``whole`` the table is replaced. Rows are rebalanced by partition: small ones become one
    file, and one with very many rows as many as its size asks for.
    """
    if by and not whole:
        df = as_at(df, path, by)
    for name, unit in (units or {}).items():
        df = df.withMetadata(name, {"units": unit})
    if by:
        df = df.hint("rebalance", *by)
    if sort:
        df = df.sortWithinPartitions(*by, *sort)
    df.write.mode(mode).option("compression", codec).option("partitionOverwriteMode", "static" if whole or not by else "dynamic").partitionBy(*by).parquet(path)


def write_complete(df: DataFrame, path: str, *, keys: list[str], years: int, by: list[str]) -> None:
    """Write monthly series after checking that each has 12 rows a year."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") != 12 * years).limit(1).count()
    if bad:
        raise ValueError(f"a series doesn't have {12 * years} months")
    write_table(df, path, by=by)
