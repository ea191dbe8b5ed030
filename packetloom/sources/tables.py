"""Table files: delimited text, JSON, Parquet and plain text. Schemas are always given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.names import local_path
from packetloom.functions.octets import byte_length, from_hex

FEATURE_SCHEMA = "x binary, feature_len long, labels string"
OLD_FEATURE_SCHEMA = "label long, feature array<double>, feature_len long"
PACKET_ROW_SCHEMA = "label_id long, file_path string, packet binary, length long"
TEMPLATE_SCHEMA = "label long, text_a string"
CSV_OPTIONS = {"header": "true", "mode": "DROPMALFORMED", "columnPruning": "false"}
BURST_SCHEMA = "burst binary, len int, label int"


def field_extract_schema(protocol: str = "tcp") -> str:
    """Columns of a field-extract file, as it names them."""
    p = protocol
    return (
        "`frame.number` long, `frame.time_relative` double, "
        f"`{p}.stream` long, `ip.src` string, `{p}.srcport` int, `ip.dst` string, `{p}.dstport` int, "
        f"`frame.len` long, `ip.len` long, `{p}.payload` string"
    )


WIDE_EXTRACT_SCHEMA = (
    "`frame.number` long, `frame.time_relative` double, `frame.protocols` string, `ip.src` string, "
    "`ip.dst` string, `ip.proto` int, `tcp.srcport` int, `tcp.dstport` int, `frame.len` long, "
    "`_ws.col.Info` string, `tcp.payload` string"
)


def plain_names(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores."""
    return df.toDF(*[c.replace(".", "_").lstrip("_") for c in df.columns])


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, file_column: str | None = None) -> DataFrame:
    """CSV with a header; blank and malformed lines are skipped. Optionally adds the file path.

    Lines are split into all their fields whatever columns are used, so a line of the wrong width is
    skipped always; one with a value of the wrong type is skipped by queries that use that column.
    """
    df = plain_names(spark.read.schema(schema).options(**CSV_OPTIONS).csv(paths))
    return df.withColumn(file_column, local_path(F.input_file_name())) if file_column else df


def read_tsv(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    return plain_names(spark.read.schema(schema).option("header", True).option("sep", "\t").csv(paths))


def read_templates(spark: SparkSession, paths: str | list[str], on_odd: str = "error") -> DataFrame:
    """Template rows with their hex text as bytes: ``label_id, packet``."""
    df = read_tsv(spark, paths, TEMPLATE_SCHEMA)
    return df.select(F.col("label").alias("label_id"), from_hex("text_a", on_odd).alias("packet"))


def burst_rows(templates: DataFrame) -> DataFrame:
    """Template rows as ``burst, len, label``."""
    return templates.select(
        F.col("packet").alias("burst"), byte_length("packet").alias("len"), F.col("label_id").cast("int").alias("label")
    )


def read_json(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, partitions: int | None = None) -> DataFrame:
    """JSON lines, also gzipped. Gzip cannot be split, so few large files need ``partitions``."""
    df = spark.read.schema(schema).json(paths)
    return df.repartition(partitions) if partitions else df


def read_parquet(
    spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Parquet by path or glob; only the wanted columns are read."""
    paths = [paths] if isinstance(paths, str) else paths
    df = (spark.read.schema(schema) if schema else spark.read).parquet(*paths)
    return df.select(*columns) if columns else df


def read_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "snappy", by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_parts(df: DataFrame, path: str, by: str = "part") -> None:
    """Train and test rows side by side in one write, as partitions of ``by``."""
    write_parquet(df, path, by=[by])


def read_part(spark: SparkSession, path: str, part: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One side of a split; the other is pruned."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path).where(F.col("part") == part).drop("part")


def write_side_table(df: DataFrame, path: str) -> None:
    """A small table such as a label mapping, as JSON lines."""
    df.write.mode("overwrite").json(path)


def label_count(mapping: DataFrame) -> int:
    return mapping.count()
