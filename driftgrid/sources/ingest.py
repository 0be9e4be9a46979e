"""From raw chunks to one table: coverage, overlaps, and runs that go on where the last one ended.

A chunk is a file, or the files of a folder ``chunk=...``, with some years of
one member and variable. What a chunk holds is told by its name and by the first
and last step of its rows; cells themselves are never compared with each other.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgrid.functions.columns import missing, month_index
from driftgrid.session import cut
from driftgrid.sources.catalog import require
from driftgrid.sources.tables import write_table

PATTERN = "*.parquet"
NAME = r"\.([0-9]{4}\.[0-9]{3})\.(\w+)\."
LISTERS = 64  # tasks that list folders


def place() -> Column:
    """The folder ``chunk=...`` of a row's file, or the file itself."""
    path = F.col("_metadata.file_path")
    return F.coalesce(F.nullif(F.regexp_extract(path, "^(.*/chunk=[^/]+)/", 1), F.lit("")), path)


def named(name: str) -> dict[str, Column]:
    own = F.regexp_extract("chunk", "(?:/chunk=|/)([^/]+)$", 1)
    return {"file": own, "member_code": F.regexp_extract(own, name, 1), "variable": F.regexp_extract(own, name, 2)}


def few_listers(spark: SparkSession, most: int = LISTERS) -> None:
    """Bound the tasks of a listing, which else has one for each folder or path."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if int(spark.conf.get(key)) > most:
        spark.conf.set(key, str(most))


def chunk_files(spark: SparkSession, raw: str, *, pattern: str = PATTERN, name: str = NAME) -> DataFrame:
    """path, chunk (its place), file (its name), member_code, variable, bytes of the raw files; nothing is read but their listing."""
    few_listers(spark)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(raw)
    return listed.select(F.col("_metadata.file_path").alias("path"), place().alias("chunk"), F.col("_metadata.file_size").alias("bytes")).withColumns(named(name))


def read_chunks(spark: SparkSession, path: str | list[str], *, pattern: str = PATTERN, name: str = NAME) -> DataFrame:
    """Rows of raw chunks with chunk, file, member_code and variable of their files; floats and NULLs at rest."""
    few_listers(spark)
    df = spark.read.option("pathGlobFilter", pattern).parquet(*([path] if isinstance(path, str) else path))
    return df.withColumn("chunk", place()).withColumns({**named(name), "value": missing(F.col("value")).cast("float")})


def chunk_ranges(cells: DataFrame) -> DataFrame:
    """chunk, file, member_code, variable, first, last, rows: a row for each chunk. Steps are months since year 0; only they are read."""
    step = month_index(F.col("year"), F.col("month"))
    return cells.groupBy("chunk", "file", "member_code", "variable").agg(F.min(step).alias("first"), F.max(step).alias("last"), F.count("*").alias("rows"))


def overlaps(ranges: DataFrame) -> DataFrame:
    """Chunks that start before an earlier one of their member and variable has ended: chunk, other, member_code, variable, first."""
    before = Window.partitionBy("member_code", "variable").orderBy("first", "last", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranges.withColumns({"other": F.max_by("chunk", "last").over(before), "until": F.max("last").over(before)})
    return ends.where(F.col("first") <= F.col("until")).select("chunk", "other", "member_code", "variable", "first")


def gaps(ranges: DataFrame) -> DataFrame:
    """Steps between two chunks that none of the member and variable holds: member_code, variable, from_step, to_step."""
    before = Window.partitionBy("member_code", "variable").orderBy("first", "last", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranges.withColumn("until", F.max("last").over(before))
    return ends.where(F.col("first") > F.col("until") + 1).select("member_code", "variable", (F.col("until") + 1).alias("from_step"), (F.col("first") - 1).alias("to_step"))


def refuse_overlaps(ranges: DataFrame) -> None:
    if two := overlaps(ranges).first():
        raise ValueError(f"chunks overlap: {two.other} and {two.chunk}")


def process_variable(spark: SparkSession, raw: str, out: str, *, expected: DataFrame | None = None, by: list[str] = ["variable", "month"]) -> DataFrame:  # noqa: B006
    """Combine the chunks of ``raw`` and write them by variable and month to ``out``; returns the table as it is read back.

    A file of ``expected`` that isn't there is an error that names it, and so is
    a step that two chunks hold. Partitions of ``out`` that the chunks don't
    touch stay.
    """
    if expected is not None:
        require(expected, chunk_files(spark, raw))
    cells = read_chunks(spark, raw)
    refuse_overlaps(chunk_ranges(cells))
    write_table(cells.drop("chunk", "file"), out, by=by)
    return spark.read.parquet(out)


def known_chunks(spark: SparkSession, out: str) -> DataFrame | None:
    """The manifest of ``ingest``: a row for each chunk that has been taken in, with its files, bytes, time range, rows and batch."""
    try:
        return spark.read.parquet(f"{out}/chunks")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def ingest(spark: SparkSession, raw: str, out: str, *, expected: DataFrame | None = None) -> DataFrame:
    """Take the chunks of ``raw`` that aren't in the manifest yet into ``out``; returns ``ingested(out)``.

    ``expected`` files that are missing, chunks that have another size than when
    they were taken in, and steps that two chunks hold, old or new, are errors;
    nothing has been written then. New cells are written as one batch, named by
    a hash of its chunks, and count once the manifest has them: a run that was
    lost is repeated with the same batch, and what it has left is overwritten or
    never read. Old chunks aren't read again. One run at a time may write.
    """
    files = cut(chunk_files(spark, raw))
    if expected is not None:
        require(expected, files)
    chunks = files.groupBy("chunk").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    known = known_chunks(spark, out)
    fresh = chunks
    if known is not None:
        was = known.select("chunk", F.col("files").alias("__files"), F.col("bytes").alias("__bytes"))
        if one := chunks.join(was, "chunk").where("files != __files OR bytes != __bytes").first():
            raise ValueError(f"{one.chunk} has changed: {one['__bytes']} bytes in {one['__files']} files then, {one.bytes} in {one.files} now")
        fresh = chunks.join(known.select("chunk"), "chunk", "left_anti")
    paths = sorted(r.path for r in files.join(fresh.select("chunk"), "chunk", "left_semi").select("path").collect())  # names of files
    if not paths:
        return ingested(spark, out)
    cells = read_chunks(spark, paths)
    ranges = cut(chunk_ranges(cells))  # read twice: for overlaps, and to be written
    refuse_overlaps(ranges if known is None else ranges.unionByName(known.select(ranges.columns)))
    batch = fresh.agg(F.concat(F.lit("b"), F.hex(F.bit_xor(F.xxhash64("chunk", "files", "bytes"))))).first()[0]
    write_table(cells.drop("chunk", "file").withColumn("batch", F.lit(batch)), f"{out}/cells", by=["batch", "variable", "month"])
    write_table(ranges.join(fresh, "chunk").withColumn("batch", F.lit(batch)), f"{out}/chunks", by=["batch"])
    return ingested(spark, out)


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """Cells of the batches that the manifest has."""
    batches = spark.read.parquet(f"{out}/chunks").select("batch").distinct()
    return spark.read.parquet(f"{out}/cells").join(batches, "batch", "left_semi").drop("batch")
