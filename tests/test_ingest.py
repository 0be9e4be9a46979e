from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from driftgrid.sources import ingest, tables

SCHEMA = "chunk string, year int, month int, cell_id int, value double"


def chunk(member, first, last):
    return f"ens.hist.{member:04d}.001.sst.{first}01-{last}12.parquet"


def add(spark, raw, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").partitionBy("chunk").parquet(raw)


def rows(member, first, last, value=1.0):
    return [(chunk(member, first, last), y, m, c, value + y) for y in range(first, last + 1) for m in (1, 2, 12) for c in range(2)]


def files_under(path):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)


def test_variables_and_months_that_are_not_written_stay(spark, tmp_path):
    out = str(tmp_path / "t")
    cells = spark.range(24).select((F.col("id") % 12 + 1).cast("int").alias("month"), F.col("id").cast("int").alias("cell_id"), F.lit(1.0).alias("value"))
    for variable in ("sst", "aice"):
        tables.write_table(cells.withColumn("variable", F.lit(variable)), out, by=["variable", "month"])
    for _ in range(2):
        tables.write_table(cells.where("month = 3").withColumns({"variable": F.lit("sst"), "value": F.lit(7.0)}), out, by=["variable", "month"])
    got = {(r.variable, r.value): r.n for r in spark.read.parquet(out).groupBy("variable", "value").agg(F.count("*").alias("n")).collect()}
    assert got == {("aice", 1.0): 24, ("sst", 1.0): 22, ("sst", 7.0): 2}
    tables.write_table(cells.where("month = 4").select(F.lit("sst").alias("variable"), "month", "cell_id", F.lit(8).alias("value")), out, by=["variable", "month"])
    assert dict(spark.read.parquet(out).dtypes)["value"] == "double" and spark.read.parquet(out).where("value = 8").count() == 2
    with pytest.raises(ValueError, match="columns"):
        tables.write_table(cells.drop("value").withColumn("variable", F.lit("sst")), out, by=["variable", "month"])
    tables.write_table(cells.where("month = 3").withColumn("variable", F.lit("sst")), out, by=["variable", "month"], whole=True)
    assert spark.read.parquet(out).count() == 2


def test_a_large_partition_becomes_many_files_and_a_small_one_few(spark, tmp_path):
    out, size = str(tmp_path / "t"), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    df = spark.range(0, 600_000, 1, 8).select(F.when(F.col("id") % 1000 == 0, 2).otherwise(1).alias("month"), F.rand(1).alias("value"), F.col("id").alias("cell_id"))
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
        tables.write_table(df, out, by=["month"], sort=["cell_id"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert files_under(f"{out}/month=1") >= 6 and files_under(f"{out}/month=2") == 1
    one = next(f"{out}/month=1/{f}" for f in os.listdir(f"{out}/month=1") if f.endswith(".parquet"))
    ids = [r.cell_id for r in spark.read.parquet(one).collect()]
    assert ids == sorted(ids) and spark.read.parquet(out).count() == 600_000


def test_missing_chunk_stops_the_run_and_is_named(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    add(spark, raw, rows(1, 1990, 1999) + rows(2, 1990, 1999))
    expected = spark.createDataFrame([(chunk(m, 1990, 1999),) for m in (1, 2, 3)], "file string")
    for run in (lambda: ingest.process_variable(spark, raw, out, expected=expected), lambda: ingest.ingest(spark, raw, out, expected=expected)):
        with pytest.raises(FileNotFoundError, match=r"ens\.hist\.0003\.001\.sst\.199001-199912"):
            run()
    assert not os.path.exists(out)
    assert ingest.process_variable(spark, raw, out, expected=expected.where("file NOT LIKE '%0003%'")).count() == 120


def test_a_second_run_reads_only_new_chunks(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    add(spark, raw, rows(1, 1990, 1999))
    assert ingest.ingest(spark, raw, out).count() == 60
    first = {r.chunk: r.batch for r in ingest.known_chunks(spark, out).collect()}
    old = [r.path for r in ingest.chunk_files(spark, raw).collect()]
    add(spark, raw, rows(1, 2000, 2009) + rows(2, 1990, 1999))
    got = ingest.ingest(spark, raw, out)
    assert got.count() == 180 and sorted(got.columns) == ["cell_id", "member_code", "month", "value", "variable", "year"]
    known = ingest.known_chunks(spark, out).collect()
    assert len({r.batch for r in known}) == 2 and all(r.batch == first[r.chunk] for r in known if r.chunk in first)
    assert {(r.first, r.last, r.member_code) for r in known} == {(1990 * 12, 1999 * 12 + 11, "0001.001"), (2000 * 12, 2009 * 12 + 11, "0001.001"), (1990 * 12, 1999 * 12 + 11, "0002.001")}
    before = files_under(out)
    assert ingest.ingest(spark, raw, out).count() == 180 and files_under(out) == before
    for path in old:  # a chunk that was taken in isn't needed any more
        os.rename(path.removeprefix("file:"), path.removeprefix("file:") + ".gone")
    assert ingest.ingest(spark, raw, out).count() == 180


def test_a_lost_run_leaves_nothing_that_is_read(spark, tmp_path, monkeypatch):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    add(spark, raw, rows(1, 1990, 1999))
    ingest.ingest(spark, raw, out)
    add(spark, raw, rows(2, 1990, 1999))
    write = ingest.write_table

    def lost(df, path, **kw):
        if path.endswith("/chunks"):
            raise RuntimeError("lost")
        write(df, path, **kw)

    monkeypatch.setattr(ingest, "write_table", lost)
    with pytest.raises(RuntimeError):
        ingest.ingest(spark, raw, out)
    assert ingest.ingested(spark, out).count() == 60
    monkeypatch.setattr(ingest, "write_table", write)
    add(spark, raw, rows(3, 1990, 1999))  # another batch than the lost one
    assert ingest.ingest(spark, raw, out).groupBy("member_code").count().collect() == ingest.ingested(spark, out).groupBy("member_code").count().collect()
    assert ingest.ingested(spark, out).count() == 180


def test_changed_and_overlapping_chunks_are_refused(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    add(spark, raw, rows(1, 1990, 1999))
    ingest.ingest(spark, raw, out)
    add(spark, raw, rows(1, 1999, 2004))
    with pytest.raises(ValueError, match="overlap"):
        ingest.ingest(spark, raw, out)
    assert ingest.ingested(spark, out).count() == 60
    folder = f"{raw}/chunk={chunk(1, 1990, 1999)}"
    part = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
    spark.createDataFrame([(1990, 1, 0, 5.0)], "year int, month int, cell_id int, value double").coalesce(1).write.parquet(str(tmp_path / "other"))
    new = next(f for f in os.listdir(tmp_path / "other") if f.endswith(".parquet"))
    os.replace(tmp_path / "other" / new, f"{folder}/{part}")
    with pytest.raises(ValueError, match="has changed"):
        ingest.ingest(spark, raw, out)


def test_gaps_between_chunks(spark, tmp_path):
    raw = str(tmp_path / "raw")
    add(spark, raw, rows(1, 1990, 1999) + rows(1, 2003, 2009) + rows(2, 1990, 1999) + rows(2, 2000, 2001))
    got = ingest.gaps(ingest.chunk_ranges(ingest.read_chunks(spark, raw))).collect()
    assert [(r.member_code, r.from_step, r.to_step) for r in got] == [("0001.001", 2000 * 12, 2002 * 12 + 11)]


def test_only_steps_are_read_for_ranges(spark, tmp_path):
    raw = str(tmp_path / "raw")
    add(spark, raw, rows(1, 1990, 1999))
    plan = ingest.chunk_ranges(ingest.read_chunks(spark, raw))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<year:int,month:int" in plan and "value" not in plan.split("ReadSchema")[1]


def test_a_chunk_is_one_file_whatever_tasks_read_its_cells(spark, tmp_path):
    from driftgrid.plans.records import chunk_table

    e = spark.range(240).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0).cast("float"), F.col("id").cast("float")).alias("embedding"), F.lit(0).alias("label"))
    e.repartition(6).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        chunk_table(spark, str(tmp_path), f"{tmp_path}/raw", (0, 9999))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    files = ingest.chunk_files(spark, f"{tmp_path}/raw")
    assert files.count() == files.select("chunk").distinct().count() == 10
    ingest.ingest(spark, f"{tmp_path}/raw", f"{tmp_path}/out")
    assert {(r.rows, r.last - r["first"]) for r in ingest.known_chunks(spark, f"{tmp_path}/out").collect()} == {(48, 23)}
