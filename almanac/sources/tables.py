"""Readers and writers (inventory A)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import parse_yyyymm
from ..operators.reshape import dedupe


def read_csv(spark: SparkSession, path: str, schema: StructType | str, cols: Sequence[str] | None = None) -> DataFrame:
    """A1: headed CSV with an explicit schema; only an empty field is null, so the text ``NA`` survives."""
    df = spark.read.schema(schema).option("nullValue", "").csv(path, header=True)
    return df.select(*cols) if cols else df


def read_wide(spark: SparkSession, path: str, ids: Sequence[str], years: Sequence[int], null: str = "..") -> DataFrame:
    """A2: indicator table with one column per year; ``..`` means missing."""
    fields = [StructField(c, StringType()) for c in [*ids, *map(str, years)]]
    return spark.read.schema(StructType(fields)).option("nullValue", null).csv(path, header=True)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """A3: one code per line, trimmed, upper case, distinct, empty lines dropped."""
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("code")).where("code <> ''").distinct()


def codes_from_list(df: DataFrame, text: Column | str, sep: str = ",") -> DataFrame:
    """A4: codes of a delimited inline list column."""
    t = F.col(text) if isinstance(text, str) else text
    return df.select(F.explode(F.split(t, sep)).alias("code")).select(F.upper(F.trim("code")).alias("code")).where("code <> ''").distinct()


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Recursive file listing without reading any content."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return r.load(root).select("path", "length", "modificationTime")


def catalog(spark: SparkSession, root: str, pattern: str = r"([0-9A-Za-z]+)_(\d{6})", glob: str = "*", folders: bool = False) -> DataFrame:
    """A5: files whose stem matches ``pattern`` (code, yyyymm) as (code, month, path); the last path wins.

    With ``folders`` the name is that of the file's folder, for tables written in several parts.
    """
    stem = F.regexp_extract("path", r"([^/]+)/[^/]*$" if folders else r"([^/]+?)(\.[^./]*)?$", 1)
    f = list_files(spark, root, glob).withColumn("_s", stem)
    f = f.select(F.lower(F.regexp_extract("_s", pattern, 1)).alias("code"), F.regexp_extract("_s", pattern, 2).alias("yyyymm"), "path")
    f = f.where("code <> '' AND yyyymm <> ''")
    return f.groupBy("code", "yyyymm").agg(F.max("path").alias("path")).withColumn("month", parse_yyyymm("yyyymm"))


def crop(cells: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """Cells of a bounding box; on a parquet cell table both ranges reach the scan."""
    return cells.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Parquet cell table (month, c, y, x, v), partitioned by channel."""
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Parquet partitioned by low-cardinality columns, read back."""
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Headed CSV, one file per task."""
    df.write.mode("errorifexists").csv(path, header=True)


def write_meta(df: DataFrame, path: str) -> None:
    """Metadata document (one row) as JSON; nulls are written too."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def read_meta(spark: SparkSession, path: str, schema: StructType | str, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Typed read; absent keys take their defaults."""
    df = spark.read.schema(schema).json(path)
    for k, v in (defaults or {}).items():
        df = df.withColumn(k, F.coalesce(F.col(k), F.lit(v)))
    return df


def scan_pairs(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """A10: columns of a pair table; the others are never read."""
    return spark.read.parquet(path).select(*cols)


def report_lines(stats: DataFrame) -> DataFrame:
    """``key=value`` lines of a one-row statistics table."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in stats.columns])
    return stats.select(F.inline(pairs)).select(F.concat_ws("=", "key", F.coalesce("value", F.lit(""))).alias("value"))


def write_report(stats: DataFrame, path: str) -> None:
    """The lines as a text file."""
    report_lines(stats).write.mode("errorifexists").text(path)


def land(df: DataFrame, source: str, licence: str, path: str, layer: str = "bronze") -> DataFrame:
    """Rows as received plus source, licence and retrieval time, partitioned by retrieval day."""
    out = df.withColumns({"_source": F.lit(source), "_licence": F.lit(licence), "_retrieved": F.current_timestamp(), "_day": F.current_date()})
    return write_parquet(out, f"{path}/{layer}/{source}", ["_day"])


def refine(bronze: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Silver layer, the latest retrieved row of every key."""
    keep = [c for c in bronze.columns if c != "_day"]
    newest = bronze.select(*keep).withColumn("_o", -F.unix_micros("_retrieved"))
    rest = [c for c in keep if c not in keys]
    return dedupe(newest, keys, ["_o"]).select(*keys, *rest)


def stream_files(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", per_trigger: int | None = 16, glob: str | None = None) -> DataFrame:
    """File stream with a fixed schema and a bounded number of files per batch.

    Files are not ordered in time: with a watermark, replay an archive with ``per_trigger=None``.
    """
    r = spark.readStream.schema(schema).format(fmt)
    r = r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def lay_out(df: DataFrame, by: str, path: str, files: int) -> None:
    """An archive as about ``files`` files in the order of ``by``, for replay as a stream.

    A file stream takes files by their time of modification, so the files, which Spark writes side by side,
    are stamped a second apart in the order of their rows.  A store that does not let times be set is refused.
    """
    spark = df.sparkSession
    df.repartitionByRange(files, by).sortWithinPartitions(by).write.mode("errorifexists").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(str(f.getPath().toString()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    start = fs.getFileStatus(folder).getModificationTime() // 1000 * 1000 - 1000 * len(parts)
    for i, part in enumerate(parts):
        target = spark._jvm.org.apache.hadoop.fs.Path(part)
        fs.setTimes(target, start + 1000 * i, -1)
        if fs.getFileStatus(target).getModificationTime() != start + 1000 * i:
            raise RuntimeError("this store does not keep the order of the files")


def table_path(d: str, table: str) -> str:
    """Stream path of a table stored as one file or as a folder of files (a pattern matches either)."""
    return f"{d}/{table}.parque[t]"


def export_topk(neighbours: DataFrame, path: str) -> None:
    """Neighbour table for spreadsheets."""
    write_csv(neighbours, path)


def manifest(spark: SparkSession, root: str, params: Mapping[str, object], glob: str = "*") -> DataFrame:
    """Artefacts under ``root`` with size and SHA-256, and the parameter snapshot as JSON.

    Meant for reports and metadata files; tables are fingerprinted by :func:`fingerprint`.
    """
    import json

    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return r.select("path", "length", F.sha2("content", 256).alias("sha256"), F.lit(json.dumps(dict(params), sort_keys=True)).alias("params"))


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Row count and order-free content hash of a table of any size, in one aggregation."""
    return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("fingerprint"))


