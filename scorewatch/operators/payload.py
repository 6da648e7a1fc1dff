"""Feature payloads: unpacking text to columns and packing columns to text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.text import literal_to_json


def with_payload_map(df: DataFrame, payload: str, output: str = "payload_map") -> DataFrame:
    """Parse the payload into a string map.

    Empty and unparsable text gives an empty map; a list is kept under the key `raw_list`.
    """
    text = F.trim(literal_to_json(F.col(payload)))
    parsed = F.from_json(text, "map<string,string>")
    is_list = text.startswith("[") & F.from_json(text, "array<string>").isNotNull()
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return df.withColumn(
        output,
        F.when(is_list, F.create_map(F.lit("raw_list"), text)).otherwise(F.coalesce(parsed, empty)),
    )


def payload_keys(df: DataFrame, payload_map: str = "payload_map", exclude: Sequence[str] = ()) -> list[str]:
    """Sorted distinct keys. Only the key names reach the driver, where they become columns."""
    keys = df.select(F.explode(F.map_keys(payload_map)).alias("key")).distinct().orderBy("key").collect()
    return [r["key"] for r in keys if r["key"] not in set(exclude)]


def expand_payload(
    df: DataFrame,
    payload: str,
    prefix: str = "calc_",
    keys: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    drop_source: bool = False,
) -> DataFrame:
    """One string column per payload key. Pass `keys` to spare the pass that finds them."""
    parsed = with_payload_map(df, payload, "__payload")
    names = [k for k in keys if k not in set(exclude)] if keys is not None else payload_keys(
        parsed, "__payload", exclude
    )
    result = parsed.withColumns({f"{prefix}{k}": F.col("__payload").getItem(k) for k in names})
    return result.drop("__payload", payload) if drop_source else result.drop("__payload")


def plain_names(df: DataFrame, marker: str = "_Calc_", by: str = "_") -> DataFrame:
    """Shorten `<version>_Calc_<feature>` column names."""
    return df.withColumnsRenamed({c: c.replace(marker, by) for c in df.columns if marker in c})


def pack_features(
    df: DataFrame,
    features: Sequence[str],
    score: str,
    model: str,
    trench: str = "",
    subscription: str = "",
    version: str = "v1",
) -> DataFrame:
    """Scored-log rows with the features as JSON; null features are left out of it."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    present = [f for f in features if f in df.columns]
    packed = F.to_json(
        F.struct(*present), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    )
    prediction = F.col(score) if score in df.columns else F.lit(0)
    return df.select(
        F.col("customer_id").alias("customerId"),
        "digitalLoanAccountId",
        F.uuid().alias("crifApplicationId"),
        prediction.alias("prediction"),
        now.alias("start_time"),
        now.alias("end_time"),
        F.lit(model).alias("modelDisplayName"),
        F.lit(version).alias("modelVersionId"),
        packed.alias("calcFeature"),
        F.lit(subscription).alias("subscription_name"),
        F.uuid().alias("message_id"),
        now.alias("publish_time"),
        F.lit("{}").alias("attributes"),
        F.lit(trench).alias("trenchCategory"),
        F.col("osType").alias("deviceOs"),
        "Data_selection",
        F.col("application_date").alias("Application_date"),
    )


def map_columns(df: DataFrame, source: str, keys: Sequence[str], prefix: str) -> DataFrame:
    """Selected keys of a map column as columns."""
    return df.withColumns({f"{prefix}{k}": F.col(source).getItem(k) for k in keys})


def filled_features(
    df: DataFrame, features: Sequence[str], version: str, version_value: str, trench: str, trenches: Sequence[str]
) -> list[str]:
    """Features with at least one value for a version and some trenches."""
    row = (
        df.where((F.col(version) == version_value) & F.col(trench).isin(*trenches))
        .agg(*[F.count(f).alias(f"n{i}") for i, f in enumerate(features)])
        .first()
    )
    return [f for i, f in enumerate(features) if row[f"n{i}"] > 0]


def feature_fill_counts(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Number of values per feature and key in long form, features without any left out."""
    counts = df.groupBy(*keys).agg(*[F.count(f).alias(f) for f in features])
    return counts.unpivot(list(keys), list(features), "feature", "filled").where(F.col("filled") > 0)
