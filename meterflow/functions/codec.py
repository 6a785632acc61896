"""JSON encode / strict decode of wire records.

Rules:
* decode is PERMISSIVE with a ``_corrupt_record`` column, which is filled for a
  wrong-typed value, broken text, ``null`` and arrays; it is not filled for an
  empty string or SQL NULL, so those reject by a separate test;
* times decode as zone-aware timestamps and convert to NTZ in UTC (a value with
  ``Z`` does not parse into timestamp_ntz);
* encode keeps microseconds and drops null fields (a null resource is omitted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow import schemas as S

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
JSON_OPTS = {"timestampFormat": TS_FORMAT, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
CORRUPT = "_corrupt_record"


def encode(struct_col: Column, pretty: bool = False) -> Column:
    """K8: record -> JSON text."""
    opts = dict(JSON_OPTS)
    if pretty:
        opts["pretty"] = "true"
    return F.to_json(struct_col, opts)


def chunk_struct(from_col: str = "from_ts", to_col: str = "to_ts") -> Column:
    """Wire chunk struct from a flat chunk row; times become UTC instants."""
    fields = []
    for name in S.CHUNK_FIELDS:
        if name == "from":
            fields.append(F.col(from_col).cast(T.TimestampType()).alias("from"))
        elif name == "to":
            fields.append(F.col(to_col).cast(T.TimestampType()).alias("to"))
        elif name == "region_type":
            fields.append(F.coalesce(F.col("region_type"), F.lit("")).alias("region_type"))
        else:
            fields.append(F.col(name))
    return F.struct(*fields)


def encode_chunks(from_col: str = "from_ts", to_col: str = "to_ts") -> Column:
    return encode(chunk_struct(from_col, to_col))


def _decode(value: Column, schema: T.StructType) -> Column:
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return F.from_json(value, with_corrupt, opts)


def decode_split(df: DataFrame, value_col: str, schema: T.StructType,
                 time_fields: tuple[str, ...], rename: dict | None = None) -> DataFrame:
    """Strict JSON decode. Adds the decoded fields plus ``decode_error``
    (null when the row decoded). Undecodable rows are kept, flagged, never dropped.
    Input columns with a decoded field's name are replaced by the decoded value.
    """
    rename = rename or {}
    raw = F.col(value_col).cast("string")
    # Parse exactly once: the parsed struct comes out of a one-row generator,
    # so a later filter on decoded fields (e.g. ``decode_error IS NULL``) stays
    # above it instead of being pushed below with ``from_json`` inlined into
    # the predicate (which would parse every message twice).
    parsed = df.select("*", F.inline(F.array(F.struct(_decode(raw, schema).alias("__d")))))
    error = (F.when(F.col(value_col).isNull(), F.lit("null_value"))
              .when(F.trim(raw) == "", F.lit("empty_value"))
              .when(F.col("__d").isNull() | F.col(f"__d.{CORRUPT}").isNotNull(), F.lit("undecodable")))
    cols = []
    for f in schema.fields:
        c = F.col(f"__d.`{f.name}`")
        if f.name in time_fields:
            c = c.cast("timestamp_ntz")
        cols.append(F.when(error.isNull(), c).alias(rename.get(f.name, f.name)))
    out_names = {rename.get(f.name, f.name) for f in schema.fields} | {"decode_error"}
    keep = [F.col(c) for c in df.columns if c not in out_names]
    return parsed.select(*keep, *cols, error.alias("decode_error"))


def decode_chunks(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Wire JSON -> typed chunk columns (``from_ts``/``to_ts``) + decode_error."""
    return decode_split(df, value_col, S.CHUNK_WIRE, ("from", "to"),
                        rename={"from": "from_ts", "to": "to_ts"})


def decode_processed(df: DataFrame, value_col: str = "value") -> DataFrame:
    return decode_split(df, value_col, S.PROCESSED_WIRE, ("processed_at",))


def to_wire(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stored chunk -> wire chunk, fourteen fields one to one (region_type
    kept, empty when never set); ``keep`` names columns that ride along."""
    return df.select(
        "event_id", "session_id", "sandbox_id", "organization_id", "sequence",
        "from_ts", "to_ts", "cpu", "gpu", "ram_gb", "disk_gb", "region",
        F.coalesce(F.col("region_type"), F.lit("")).alias("region_type"),
        "sandbox_class", *keep)
