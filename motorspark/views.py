"""Vehicle views over the driver tables.

Each view is a list of plain expressions that Spark and DuckDB read alike, so the same text
builds the DataFrame here and the common table expression in ``oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTINGS = {
    "id": "l_orderkey * 10 + l_linenumber",
    "price": "CASE WHEN l_orderkey % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice END",
    "year": "CAST(year(l_shipdate) AS INT)",
    "odometer": "l_quantity * 8000",
    "manufacturer": "CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE p_brand END",
    "model": "p_name",
    "mfr_group": "CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE 'NATION_' || CAST(CAST(split_part(p_brand, '#', 2) AS INT) % 25 AS STRING) END",
    "type": "p_type",
    "fuel": "l_returnflag",
    "transmission": "l_linestatus",
    "drive": "CASE l_linenumber % 4 WHEN 0 THEN 'fwd' WHEN 1 THEN 'rwd' WHEN 2 THEN '4wd' END",
    "VIN": "CASE WHEN l_orderkey % 5 < 2 THEN NULL ELSE 'V' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey % 10 AS STRING) END",
    "posting_date": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
    "l_orderkey": "l_orderkey",
    "l_partkey": "l_partkey",
    "l_linenumber": "l_linenumber",
    "p_size": "p_size",
}

RECALLS = {
    "recall_id": "o_orderkey",
    "report_date": "CAST(o_orderdate AS DATE)",
    "year": "CAST(year(o_orderdate) AS INT)",
    "month": "CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT)",
    "manufacturer": "n_name || CASE o_orderkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' (US) Co., Ltd.' ELSE '' END",
    "mfr_group": "CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_name END",
    "units": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice END",
    "component": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_mktsegment END",
    "recall_type": "CASE WHEN o_orderkey % 9 = 0 THEN 'Tire' ELSE 'Vehicle' END",
    "subject": "'Subject ' || CAST(o_orderkey AS STRING)",
    "description": (
        "CASE WHEN o_orderkey % 7 = 0 THEN 'No sentence for ' || n_name || '. Done.' "
        "ELSE n_name || ' Corp. (N) is recalling certain ' || CAST(year(o_orderdate) - 2 AS STRING) || '-' "
        "|| CAST(year(o_orderdate) AS STRING) || ' ' "
        "|| CASE o_orderkey % 8 WHEN 0 THEN 'Blue' WHEN 1 THEN 'cold' WHEN 2 THEN 'hot' WHEN 3 THEN 'lar-ge' "
        "WHEN 4 THEN 'new' WHEN 5 THEN 'OLD' WHEN 6 THEN 'red' ELSE 'small' END "
        "|| ' vehicles. The red bolt of 1999 may break.' END"
    ),
    "advisory": "CASE WHEN o_orderkey % 37 = 0 THEN 'Yes' ELSE 'No' END",
}

TELEMATICS = {
    "event_id": "event_id",
    "deviceID": "CASE WHEN event_id % 97 = 5 THEN NULL ELSE user_id % 8 END",
    "tripID": "user_id",
    "ts": "CASE WHEN event_id % 89 = 7 THEN NULL ELSE CAST(ts AS TIMESTAMP) END",
    "speed": "CAST(floor(value / 2) AS DOUBLE)",
    "gps_speed": "CAST(floor(value / 2) + (CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) - 50) / 2.0 AS DOUBLE)",
    "rpm": "CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) * 40 AS DOUBLE)",
    "x": "CAST(floor(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) / 34.0) AS DOUBLE)",
}

SPECS = {
    "VIN": "VIN",
    "API_Make": "CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 50 = 3 THEN 'OTHER MAKE' ELSE upper(manufacturer) END",
    "API_Year": "CASE WHEN l_orderkey % 41 = 0 THEN year + 2 ELSE year END",
    "API_Body": "CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN 'Crew Pickup' ELSE 'Sedan' END",
    "API_Engine": "CASE WHEN l_partkey % 29 = 0 THEN '' ELSE CAST(p_size / 10.0 AS STRING) END",
    "API_Drive": "CASE p_size % 5 WHEN 0 THEN 'AWD/All-Wheel Drive' WHEN 1 THEN 'FWD/Front-Wheel Drive' WHEN 2 THEN 'RWD/Rear-Wheel Drive' WHEN 3 THEN '4x2' END",
    "API_Fuel": "CASE WHEN l_partkey % 10 < 7 THEN 'Gasoline' WHEN l_partkey % 10 < 9 THEN 'Diesel' ELSE 'Electric' END",
    "API_ErrorCode": "CASE WHEN l_partkey % 6 = 0 THEN '1' ELSE '0' END",
}

DOCUMENTS = {"doc_id": "doc_id", "text": "text", "lang": "lang", "source": "source"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return _select(lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left"), LISTINGS)


def recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return _select(joined, RECALLS)


def telematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "events"), TELEMATICS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "documents"), DOCUMENTS)
