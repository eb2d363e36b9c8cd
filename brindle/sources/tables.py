"""Tables: Parquet in and out, catalog views, layout and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column types of the data model and their Spark types.
TYPES = {"INT32": T.IntegerType(), "INT64": T.LongType(), "FLOAT64": T.DoubleType(), "STRING": T.StringType()}
CODECS = {"NONE": "none", "SNAPPY": "snappy", "ZSTD": "zstd"}
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
#: Rows of a file, and of the task that writes it, where a table is dealt anew.
FILE_ROWS = 1 << 20
#: Formats besides Parquet, and what makes each keep nulls, empty strings and line ends apart.
FORMATS = {
    "csv": {"header": "true", "nullValue": "\\N", "emptyValue": "", "quoteAll": "true", "escape": '"', "multiLine": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"},
    "json": {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"},
    "orc": {},
}


def schema(**columns: str) -> T.StructType:
    """A nullable schema from names and data model types, in order."""
    return T.StructType([T.StructField(name, TYPES[kind.upper()], True) for name, kind in columns.items()])


def scan(spark: SparkSession, base: str, name: str, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """A table; the filter and the columns reach the Parquet reader, which skips
    row groups by their statistics."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def register(spark: SparkSession, base: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views over the tables in a folder."""
    for name in names:
        scan(spark, base, name).createOrReplaceTempView(name)


def write(df: DataFrame, path: str, codec: str = "ZSTD", row_group_bytes: int = 128 << 20, sort_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write Parquet.  ``sort_by`` sorts inside partitions, which is what makes
    row-group statistics selective; it never shuffles."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode(mode).option("compression", CODECS[codec.upper()]).option("parquet.block.size", str(row_group_bytes)).parquet(path)


def partition_id(key: Column, n: int) -> Column:
    """The hash partition of an integer key: its floor modulus; null has none and is an error."""
    checked = F.when(key.isNull(), F.raise_error(F.lit("a partitioning key is null")).cast("bigint")).otherwise(key.cast("bigint"))
    return F.pmod(checked, F.lit(n)).cast("int")


def write_ranges(df: DataFrame, path: str, key: str, codec: str = "ZSTD", row_group_bytes: int = 128 << 20) -> None:
    """Write Parquet in files of about ``FILE_ROWS`` rows, each a range of ``key`` and
    sorted by it, so that the bounds of row groups do not overlap however the rows came."""
    files = max(1, -(-df.count() // FILE_ROWS))
    write(df.repartitionByRange(files, key) if files > 1 else df.coalesce(1), path, codec, row_group_bytes, [key])


def write_partitioned(df: DataFrame, path: str, key: str, n: int, mode: str = "errorifexists") -> None:
    """Split a table by ``key`` into ``partition_id=i`` folders.

    A folder has a file for about ``FILE_ROWS`` rows, each written by a task of its
    own: rows of a partition are dealt by a hash of the row."""
    dealt = df.withColumn("partition_id", partition_id(F.col(key), n))
    files = max(1, -(-dealt.select("partition_id").count() // (n * FILE_ROWS)))
    # A task for each partition and slot; a hash of both would put some together.
    slot = F.pmod(F.xxhash64(*df.columns), F.lit(files)).cast("int")
    dealt = dealt.repartitionById(n * files, F.col("partition_id") * files + slot)
    dealt.write.mode(mode).partitionBy("partition_id").parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, n: int, mode: str = "errorifexists") -> None:
    """A catalog table bucketed by ``key``: joins of such tables on it need no shuffle."""
    df.write.mode(mode).bucketBy(n, key).sortBy(key).saveAsTable(name)


def save(df: DataFrame, path: str, form: str, mode: str = "errorifexists") -> None:
    """Write a table as CSV, JSON lines or ORC."""
    df.write.mode(mode).format(form).options(**FORMATS[form]).save(path)


def load(spark: SparkSession, path: str, form: str, columns: T.StructType | str) -> DataFrame:
    """Read a table that :func:`save` wrote.  The schema is given, so that nothing is
    read twice to guess it; ORC takes its own."""
    reader = spark.read.format(form).options(**FORMATS[form])
    return (reader if form == "orc" else reader.schema(columns)).load(path)


def load_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a database, read by ranges of ``key`` in so many tasks."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options)
    return reader.load()


_GROUPS = "file string, row_group int, n_rows bigint, column string, low string, high string, nulls bigint, codec string"


def _footers(batches):
    """Row groups of the files named, of which only the footers are read."""
    import pyarrow as pa
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    kind = pa.schema([("file", pa.string()), ("row_group", pa.int32()), ("n_rows", pa.int64()), ("column", pa.string()), ("low", pa.string()), ("high", pa.string()), ("nulls", pa.int64()), ("codec", pa.string())])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, name = fs.FileSystem.from_uri(path.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1).replace("s3a://", "s3://", 1))
            out = []
            with store.open_input_file(name) as file:
                meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for c in range(group.num_columns):
                    col = group.column(c)
                    s = col.statistics
                    known = s is not None and s.has_min_max
                    out.append({"file": path, "row_group": g, "n_rows": group.num_rows, "column": col.path_in_schema, "low": str(s.min) if known else None, "high": str(s.max) if known else None, "nulls": s.null_count if s is not None else None, "codec": col.compression})
            yield pa.RecordBatch.from_pylist(out, schema=kind)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """Row-group statistics of a Parquet table: file, group, rows, column, low, high, nulls, codec.

    Files are listed by Spark; a task opens each where it is and reads its last
    bytes, however large the file.  The store must be one that Arrow reaches
    too (local, S3, GCS, HDFS)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select("path").mapInArrow(_footers, _GROUPS)


def pruned_groups(spark: SparkSession, path: str, column: str, op: str, value, kind: str = "bigint") -> DataFrame:
    """(total, skipped): row groups of a table, and those whose bounds on ``column`` rule a match out."""
    groups = row_groups(spark, path).filter(F.col("column") == column)
    keep = might_match(F.col("low").cast(kind), F.col("high").cast(kind), op, F.lit(value))
    return groups.agg(F.count("*").alias("total"), F.coalesce(F.sum((~keep).cast("long")), F.lit(0).cast("long")).alias("skipped"))


def might_match(low: Column, high: Column, op: str, value: Column) -> Column:
    """Zone-map test: can a group with these bounds hold a match?  Unknown bounds or
    operators keep the group."""
    tests = {
        ">": high > value, ">=": high >= value, "<": low < value, "<=": low <= value,
        "=": (low <= value) & (value <= high), "!=": ~((low == value) & (high == value)), "<>": ~((low == value) & (high == value)),
    }
    return F.coalesce(tests.get(op, F.lit(True)), F.lit(True))
