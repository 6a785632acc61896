"""Table definitions and constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow import schemas as S
from meterflow.functions import expressions as X


def define_tables(spark: SparkSession, root: str, database: str = "metering") -> list[str]:
    """Create the four tables (idempotent) as Parquet tables under ``root``,
    with NOT NULL and DEFAULT as the columns have them. Spark fills in a default
    that an insert leaves out, but does not enforce NOT NULL on Parquet tables, and
    Parquet has no unique keys: ``insert_rows`` and ``check_constraints`` do."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}'")
    made = []
    for name, schema in S.TABLE_SCHEMAS.items():
        cols = ", ".join(_column(f, S.TABLE_DEFAULTS[name].get(f.name)) for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({cols}) USING parquet "
                  f"LOCATION '{root}/{name}'")
        made.append(f"{database}.{name}")
    return made


def _column(field, default: str | None) -> str:
    sql = f"`{field.name}` {field.dataType.simpleString()}"
    if not field.nullable:
        sql += " NOT NULL"
    return sql + (f" DEFAULT {default}" if default else "")


def insert_rows(rows: DataFrame, table: str, database: str = "metering") -> DataFrame:
    """Insert ``rows``, which may lack columns, into a defined table; a column
    they lack gets its default (the surrogate id comes from the event id), other
    columns they have are left out. A row with a null where the table says NOT NULL
    is refused, as is every row when such a column without a default is lacking; a
    given null is never replaced by a default. Returns the refused rows with
    ``refused``, the names of those columns in table order; the rows accepted are
    written by this call."""
    schema, defaults = S.TABLE_SCHEMAS[table], S.TABLE_DEFAULTS[table]
    if table in S.TABLE_SERIALS and "id" not in rows.columns and "event_id" in rows.columns:
        rows = rows.withColumn("id", X.stable_id(F.col("event_id")))
    given = [f for f in schema.fields if f.name in rows.columns]
    broken = []
    for f in schema.fields:
        if not f.nullable and f.name in rows.columns:
            broken.append(F.when(F.col(f.name).isNull(), F.lit(f.name)))
        elif not f.nullable and f.name not in defaults:
            broken.append(F.lit(f.name))
    checked = rows.withColumn("refused", F.array_compact(F.array(*broken)))
    good = checked.filter(F.size("refused") == 0).select(*[F.col(f.name).cast(f.dataType) for f in given])
    names = ", ".join(f"`{f.name}`" for f in given)
    rows.sparkSession.sql(f"INSERT INTO {database}.{table} ({names}) SELECT * FROM {{rows}}", rows=good)
    return checked.filter(F.size("refused") > 0).withColumn("refused", F.concat_ws(",", "refused"))


def check_constraints(df: DataFrame, table: str) -> DataFrame:
    """Violations of PK/UNIQUE, NOT NULL and enum rules as rows
    ``(constraint, value, n)``; empty when the frame is clean.

    One pass: every row names its keys and the rules it breaks, and one aggregate
    (map-side combined) counts them; a key counted once breaks nothing. A duplicate
    ``event_id`` is its own, distinguishable ``unique:event_id`` row.
    """
    schema = S.TABLE_SCHEMAS[table]

    def entry(rule: str, value):
        return F.struct(F.lit(rule).alias("constraint"), value.cast("string").alias("value"))

    found = [entry(f"unique:{k}", F.col(k)) for k in S.TABLE_KEYS.get(table, ())]
    found += [F.when(F.col(f.name).isNull(), entry(f"not_null:{f.name}", F.lit(None)))
              for f in schema.fields if not f.nullable and f.name in df.columns]
    found += [F.when(~F.col(c).isin(*allowed), entry(f"enum:{c}", F.col(c)))
              for c, allowed in S.TABLE_ENUMS.get(table, {}).items()]
    named = df.select(F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.constraint", "x.value")
    return (named.groupBy("constraint", "value").agg(F.count(F.lit(1)).alias("n"))
            .filter((F.col("n") > 1) | ~F.col("constraint").startswith("unique:")))
