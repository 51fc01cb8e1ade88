"""Result tables to CSV or Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the result tables.
RESULT_TABLES = [
    "model_benchmark", "shap_feature_importance", "local_hotspot_explanations", "shap_interactions",
    "vif_screening", "local_climate_zones", "gwr_nonstationarity", "gatekeeper_validation",
    "spatial_leakage_audit", "temporal_trends", "change_detection_drivers"]


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no nested values: they are written as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt == "csv":
        _flat(df).write.mode("overwrite").option("header", True).csv(path)
    else:
        w = df.write.mode("overwrite")
        (w.partitionBy("Zone") if "Zone" in df.columns and len(df.columns) > 1 else w).parquet(path)


def write_results(results: dict[str, DataFrame], folder: str, fmt: str = "csv") -> list[str]:
    """Write every known result table that is present; returns the folders."""
    done = []
    for name in RESULT_TABLES:
        if results.get(name) is not None:
            write_table(results[name], f"{folder}/{name}", fmt)
            done.append(f"{folder}/{name}")
    return done
