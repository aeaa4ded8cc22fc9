"""Readers of captured snapshots: pages of records, their manifest, logs of lines, enumerated tables.

A snapshot is a folder of JSON pages, each an array of records, and a manifest that names the
records which belong to it. All readers say what they refused: nothing is dropped uncounted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORRUPT = "_corrupt"


def load_pages(spark: SparkSession, folder: str, schema: str, key: str, names: str = "*.json") -> DataFrame:
    """Records of all pages by key; of records with one key the last by path and place stays (O1.1).

    A page is read whole by one task. Records without a key are left out; a page that is no JSON
    stops the query.
    """
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", names).json(folder)
    columns = spark.createDataFrame([], schema).columns  # without those that folders' names add
    at = F.struct(read.metadataColumn("_metadata")["file_path"].alias("file"), F.monotonically_increasing_id().alias("place"))
    placed = read.select(*columns, at.alias("at"))
    last = placed.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), "at").alias("record"))
    return last.select("record.*")


def load_manifest(spark: SparkSession, path: str, row_schema: str, rows: str = "observations") -> DataFrame:
    """The manifest's rows; none if the path has no file (O1.3)."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], row_schema)
    read = spark.read.schema(f"`{rows}` array<struct<{', '.join(_typed(row_schema))}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return read.select(F.explode(rows).alias("row")).select("row.*")


def _typed(schema: str) -> list[str]:
    return [f"{name}:{kind}" for name, kind in (field.strip().split(" ", 1) for field in schema.split(","))]


def load_snapshot(pages: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """The pages' records that the manifest names; a manifest row without a record stops the query (O1.2).

    The gate is part of the plan: it is checked when the rows are read, in the same job.
    """
    named = manifest.select(key).distinct()
    found = named.join(pages.select(F.col(key).alias("found")), F.col(key) == F.col("found"), "left")
    missing = found.agg(F.count_if(F.col("found").isNull()).alias("missing"))  # one row
    fine = F.when(F.col("missing") == 0, True).otherwise(F.raise_error(F.concat(F.col("missing").cast("string"), F.lit(" rows of the manifest have no record"))).cast("boolean"))
    return pages.join(named, key, "left_semi").join(F.broadcast(missing)).where(fine).drop("missing")


def orphans(pages: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """One row: records, how many the manifest names, how many it does not (O1.2, O5.6)."""
    marked = pages.select(key).join(manifest.select(F.col(key).alias("named")).distinct(), F.col(key) == F.col("named"), "left")
    return marked.agg(F.count("*").alias("records"), F.count("named").alias("named"), F.count_if(F.col("named").isNull()).alias("orphans"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1) and value of every line of text files, which Spark may read in parts.

    Ids rise within a part of a file; a line's number is its place in its part and the lines of
    the parts before.
    """
    read = spark.read.text(path)
    place = read.metadataColumn("_metadata")
    lines = read.select("value", place["file_path"].alias("file"), place["file_block_start"].alias("part"), F.monotonically_increasing_id().alias("id"))
    parts = lines.groupBy("file", "part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("part")) - F.col("n")  # a row for each part
    placed = parts.select("file", "part", (before - F.col("first") + 1).alias("shift"))
    return lines.join(placed, ["file", "part"]).select("file", (F.col("id") + F.col("shift")).alias("number"), "value")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, number, record (null if refused) of the JSON lines that are not blank (O1.17)."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    whole = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = lines.withColumn("parsed", whole)
    fields = [f for f in parsed.schema["parsed"].dataType.names if f != CORRUPT]
    good = F.col("parsed").isNotNull() & F.col(f"parsed.{CORRUPT}").isNull()
    return parsed.select("file", "number", F.when(good, F.struct(*(F.col(f"parsed.{f}").alias(f) for f in fields))).alias("record"))


def accepted(lines: DataFrame) -> DataFrame:
    """The records of read_lines; a refused line stops the query with its number (O1.17)."""
    said = F.concat(F.lit("line "), F.col("number").cast("string"), F.lit(" of "), F.col("file"), F.lit(" is no record"))
    fine = F.when(F.col("record").isNotNull(), True).otherwise(F.raise_error(said).cast("boolean"))
    return lines.where(fine).select("record.*")


def read_enumerated(spark: SparkSession, path: str, key: str, answers: dict[str, list[str]]) -> DataFrame:
    """Rows of a CSV file with a header: blank rows are skipped, a value outside its list or a repeated key stops the query (O1.16)."""
    columns = [key, *answers]
    read = spark.read.option("header", True).csv(path).select(*(F.trim(c).alias(c) for c in columns))
    filled = read.where(F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns)).isNotNull())

    def checked(c: str) -> Column:
        bad = F.raise_error(F.concat(F.lit(f"{c} of "), F.coalesce(key, F.lit("a row without a key")), F.lit(" has no listed value")))
        return F.when(F.col(c).isin(answers[c]), F.col(c)).otherwise(bad.cast("string"))

    once = filled.groupBy(key).agg(F.count("*").alias("n"), F.first(F.struct(*answers)).alias("row"))
    repeated = F.raise_error(F.concat(F.col(key), F.lit(" stands there more than once"))).cast("string")
    return once.select(F.when(F.col("n") == 1, F.col(key)).otherwise(repeated).alias(key), "row.*").select(key, *(checked(c).alias(c) for c in answers))


def hash_errors(spark: SparkSession, folder: str, manifest: DataFrame, name: str, sha: str) -> DataFrame:
    """name, error: files of the manifest that are missing or have another SHA-256, and files that it does not name (O2.4)."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    stored = read.select(F.element_at(F.split("path", "/"), -1).alias("stored"), F.sha2("content", 256).alias("own"))
    both = manifest.select(name, sha).join(stored, F.col(name) == F.col("stored"), "full")
    error = F.when(F.col("stored").isNull(), "missing").when(F.col(name).isNull(), "not in the manifest").when(~F.col("own").eqNullSafe(F.lower(sha)), "other content")
    return both.select(F.coalesce(name, "stored").alias(name), error.alias("error")).where("error is not null")
