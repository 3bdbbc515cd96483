"""Readers for CSV tables and decoder replies."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorspark.functions import fixed_values as fixed
from motorspark.functions.values import lenient_number, nullify
from motorspark.sources import schemas
from motorspark.sources.records import records


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names in file order; only the header line is read."""
    return spark.read.option("header", True).csv(path).columns


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    columns: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    multi_line: bool = False,
    trimmed: bool = False,
    whole_files: bool = False,
) -> DataFrame:
    """CSV with a header, by column name, with missing-value spellings read as missing.

    With ``multi_line`` values may hold line breaks, and a file is still read by many tasks (see ``records``); only files with
    single quotes in unquoted values need ``whole_files``, which makes one file one task. With ``trimmed`` spellings may stand
    between blanks.

    Every column is read as text and cast leniently to its declared type, so ``NA`` in a number
    column is missing and not an error. Column names are trimmed. Unselected columns are pruned
    by the reader.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    if multi_line and not whole_files:
        names = [c.strip() for c in reader.csv(path).columns]
        df = parsed(records(spark, path), names, [c for c in (columns or names) if c not in exclude])
    else:
        df = trim_columns(reader.option("multiLine", multi_line).csv(path))
    kept = [c for c in (columns or df.columns) if c not in exclude]
    df = nullify(df.select(*[_quoted(c) for c in kept]), kept, trimmed=trimmed)
    types = {f.name: f.dataType for f in schema.fields} if schema else {}
    return df.select(*[_typed(c, types.get(c)) for c in kept])


def parsed(rows: DataFrame, names: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """The kept fields of CSV records as text columns; missing ones at the end of a record are missing values.

    The parser walks over the other fields, which have a number for a name.
    """
    schema = ", ".join(f"{_quoted(n if n in kept else f'_unread_{i}')} string" for i, n in enumerate(names))
    fields = F.from_csv("value", schema, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    return rows.select(fields.alias("fields")).select(*[F.col("fields")[n].alias(n) for n in names if n in kept])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _typed(name: str, dtype: T.DataType | None):
    column = F.col(_quoted(name))
    return (column if dtype is None or isinstance(dtype, T.StringType) else column.try_cast(dtype)).alias(name)


def trim_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_listings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Descriptions hold line breaks, though they are not kept; without ``multi_line`` such rows are cut at the break."""
    df = read_csv(spark, path, schemas.LISTINGS, exclude=fixed.UNREAD_COLUMNS, multi_line=multi_line)
    return df.withColumn("year", F.col("year").cast("int"))


def read_recalls(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Recalls with short column names and a parsed report date; their texts may hold line breaks."""
    df = read_csv(spark, path, multi_line=multi_line)
    date = F.coalesce(
        *[F.try_to_timestamp("Report Received Date", F.lit(f)) for f in ("MM/dd/yyyy", "M/d/yyyy", "yyyy-MM-dd")]
    )
    return df.select(
        F.col("NHTSA ID").alias("recall_id"),
        date.cast("date").alias("report_date"),
        F.year(date).alias("year"),
        F.col("Manufacturer").alias("manufacturer"),
        F.col("Recall Type").alias("recall_type"),
        F.col("Component").alias("component"),
        lenient_number(F.col("Potentially Affected")).alias("units"),
        F.col("Subject").alias("subject"),
        F.col("Recall Description").alias("description"),
        F.col("Consequence Summary").alias("consequence"),
        F.col("Park Outside Advisory").alias("park_outside"),
        F.col("Do Not Drive Advisory").alias("do_not_drive"),
    )


def read_telematics(spark: SparkSession, path: str) -> DataFrame:
    """Readings with a leniently parsed time and a row digest as tie-break."""
    names = [f.name for f in schemas.TELEMATICS.fields]
    df = read_csv(spark, path, schemas.TELEMATICS, columns=names)
    return df.withColumn("ts", F.try_to_timestamp("timeStamp", F.lit("dd-MM-yyyy HH:mm:ss"))).withColumn(
        "row_id", F.xxhash64(*names)
    )


def read_spec_batches(spark: SparkSession, folder: str, fields: dict[str, str] = fixed.SPEC_FIELDS) -> DataFrame:
    """Decoder replies, one JSON document per file, as one row per decoded item."""
    replies = spark.read.text(folder, wholetext=True)
    return spec_items(reply_items(replies, "value", "$.Results", fields), fields)


def reply_items(replies: DataFrame, column: str, path: str, fields: Iterable[str]) -> DataFrame:
    """The items under ``path`` of JSON replies, one row each: the given fields as text and the whole as ``item``, a variant.

    Numbers and texts are read alike, fields that are not asked for stay in ``item``. A reply that is no JSON, or holds no items,
    gives one row without any field, which counts as not decoded.
    """
    items = F.try_variant_get(F.try_parse_json(column), path, "array<variant>")
    rows = replies.select(F.explode_outer(items).alias("item"))
    return rows.select("item", *[F.try_variant_get("item", f"$.{name}", "string").alias(name) for name in fields])


def spec_items(items: DataFrame, fields: dict[str, str] = fixed.SPEC_FIELDS) -> DataFrame:
    """Renamed fields, empty text as missing, lenient numbers, one line per VIN, and the status."""
    named = items.select(*[F.nullif(F.col(_quoted(old)), F.lit("")).alias(new) for old, new in fields.items()])
    rest = [c for c in named.columns if c != "VIN"]
    one_each = named.groupBy("VIN").agg(F.max(F.struct(*rest)).alias("_item")).select("VIN", "_item.*")
    return decoded_status(one_each)


def decoded_status(specs: DataFrame) -> DataFrame:
    """Numbers parsed leniently; decoded when at least the make is known."""
    return specs.withColumns(
        {
            "API_Year": lenient_number(F.col("API_Year")),
            "API_Engine": lenient_number(F.nullif(F.col("API_Engine").cast("string"), F.lit(""))),
            "Status": F.when(F.col("API_Make").isNotNull(), "Success").otherwise("Failed"),
        }
    )
