"""Sinks: tables by document, append-only logs, upserts, exports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.triage import Rule


def overwrite(rows: DataFrame, path: str, form: str = "parquet") -> None:
    rows.write.mode("overwrite").format(form).save(path)


def append(rows: DataFrame, path: str, form: str = "json") -> None:
    rows.write.mode("append").format(form).save(path)


def by_key(rows: DataFrame, path: str, key: str, form: str = "json") -> None:
    """A folder for each value of key; tasks hold one value or a few, so files stay few."""
    rows.repartition(key).write.mode("overwrite").partitionBy(key).format(form).save(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def json_lines(rows: DataFrame) -> DataFrame:
    """A row as one JSON text; null fields stay."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def rules_yaml(rules: Sequence[Rule], corpus_size: int) -> str:
    """Rules as YAML, keys in order: the shape that readers.category_rules reads."""
    import yaml

    names = {"table_count": "detected_table_count", "column_count": "x_cluster_count"}
    ends = lambda values, end: {f"{names.get(m, m)}_{end}": v for m, v in values.items()}
    body = {r.category: {"criteria": ends(r.least, "min") | ends(r.most, "max"), "confidence_threshold": r.threshold, "recommended_strategy": r.strategy} for r in rules}
    return yaml.safe_dump(json.loads(json.dumps({"document_categories": body, "metadata": {"corpus_size": corpus_size}})), sort_keys=True)
