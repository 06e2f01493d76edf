"""Repository metadata out of JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import REPO_META_JSON

# Output column, JSON key, default for an absent key, default without metadata.
FIELDS = (
    ("size_kb", "size", 0, 0),
    ("stars", "stargazers_count", 0, 0),
    ("language", "language", "Unknown", None),
    ("description", "description", "", ""),
    ("default_branch", "default_branch", "main", "main"),
)


def parse_repo_meta(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Replace `json_col` by five typed columns.

    A key that is absent gets its default; one that is null stays null. Text that is no JSON
    object gives the defaults of a repository without metadata.
    """
    kept = [c for c in df.columns if c != json_col]
    parsed = df.select(
        *kept,
        F.from_json(json_col, REPO_META_JSON).alias("_meta"),
        F.from_json(json_col, "map<string,string>").alias("_keys"),
    )

    def field(name: str, key: str, absent, missing) -> Column:
        kind = REPO_META_JSON[key].dataType
        return (
            F.when(F.col("_keys").isNull(), F.lit(missing).cast(kind))
            .when(F.map_contains_key("_keys", key), F.col(f"_meta.{key}"))
            .otherwise(F.lit(absent).cast(kind)).alias(name)
        )

    return parsed.select(*kept, *[field(*f) for f in FIELDS])
