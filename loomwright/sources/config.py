"""Source configurations: enabled entries, selections and key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = "column_id string, source_id string, name string, list_url string, adapter string, enabled boolean"


def enabled_columns(spark: SparkSession, columns: list[dict], selected: str = "") -> DataFrame:
    """The configured columns that are on (the default) and, if a comma-separated selection is given, in it.

    Keys stated twice, and selected names that are not configured, are errors: a configuration is a
    short list of the caller's, checked before anything runs.
    """
    names = [c["column_id"] for c in columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    wanted = [w.strip() for w in selected.split(",") if w.strip()]
    unknown = sorted(set(wanted) - set(names))
    if twice or unknown:
        raise ValueError(f"columns stated twice: {twice}; unknown columns: {unknown}")
    keys = [f.split()[0] for f in SOURCES.split(", ")]
    kept = [c for c in columns if c.get("enabled", True) and (not wanted or c["column_id"] in wanted)]
    return spark.createDataFrame([tuple(c.get(k, True) if k == "enabled" else c.get(k) for k in keys) for c in kept], SOURCES)
