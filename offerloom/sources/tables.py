"""Reading and writing tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.operators.validate import CONTRACTS
from offerloom.sources import schemas


def load_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str
) -> DataFrame:
    """One table.

    ``json`` reads files that hold one array (or object) each, one task a file;
    ``multiLine="false"`` reads json lines, whose files Spark can split.
    """
    if fmt == "json":
        options = {"multiLine": "true", **options}
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than there are cores.

    A small or unsplittable file would leave per-row work to one task.  Large
    inputs have more splits than cores and are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table that may not exist yet; only a missing path counts as empty."""
    try:
        return load_table(spark, path, fmt, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_snapshot(tables: dict[str, DataFrame], root: str, snapshot_date: str, fmt: str = "parquet") -> None:
    """Write tables under ``root/name/snapshot_date=…``; one day is replaced, others stay."""
    for name, df in tables.items():
        (
            df.withColumn("snapshot_date", F.to_date(F.lit(snapshot_date)))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("snapshot_date")
            .format(fmt)
            .save(f"{root}/{name}")
        )


@dataclass(frozen=True)
class Dataset:
    """The published tables of one snapshot, lazy."""

    retailers: DataFrame
    offers: DataFrame
    shoes: DataFrame
    aliases: DataFrame
    deals: DataFrame
    source_health: DataFrame
    warnings: DataFrame
    metadata: DataFrame


def load_dataset(
    spark: SparkSession, root: str, snapshot_date: str | None = None, fmt: str = "parquet", check: str = "enforce"
) -> Dataset:
    """The published tables, row contracts applied ("enforce", "report" or "off")."""

    def one(name: str) -> DataFrame:
        df = load_table(spark, f"{root}/{name}", fmt, schemas.PUBLISHED[name] + ", snapshot_date date")
        if snapshot_date is not None:
            df = df.filter(F.col("snapshot_date") == F.to_date(F.lit(snapshot_date)))
        contract = CONTRACTS[name]
        return {"enforce": contract.enforce, "report": contract.report, "off": lambda x: x}[check](df)

    return Dataset(**{name: one(name) for name in schemas.PUBLISHED})


def load_benchmarks(spark: SparkSession, folder: str, fmt: str = "json") -> DataFrame:
    """All expectation lists of a folder; none, or two for one source, is an error."""
    df = load_table(spark, folder, fmt, schemas.BENCHMARK).withColumn(
        "expected_models", F.coalesce("expected_models", F.array().cast("array<string>"))
    )
    if df.isEmpty():
        raise ValueError("no coverage benchmark found")
    twice = duplicate_benchmarks(df).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate coverage benchmark for {twice[0]['retailer_id']}")
    return CONTRACTS["coverage_benchmark"].enforce(df)


def duplicate_benchmarks(benchmarks: DataFrame) -> DataFrame:
    return benchmarks.groupBy("retailer_id").agg(F.count("*").alias("lists")).filter("lists > 1")


def union_sources(*offers: DataFrame) -> DataFrame:
    """Rows of all sources; a column a source lacks is null."""
    out = offers[0]
    for df in offers[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def with_fallback(live: DataFrame, fixture: DataFrame, key: str = "source") -> DataFrame:
    """Live rows, plus fixture rows of the sources that have none, flagged."""
    have = live.select(key).distinct()
    return live.withColumn("used_fixture", F.lit(False)).unionByName(
        fixture.join(have, key, "left_anti").withColumn("used_fixture", F.lit(True))
    )


def write_tickets(tickets: DataFrame, folder: str) -> None:
    """One text file group per ticket name; writing a ticket again replaces it."""
    rows = tickets.select("ticket_name", F.col("body").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticket_name").text(folder)
