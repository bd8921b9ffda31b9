"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``root/name.parquet``, a file or a folder of part files."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A CSV with header, every column text; a byte order mark is taken off, a missing column is an error that names it."""
    df = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return df


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, alias) of a dictionary in YAML or JSON: kind -> list of names or of {name, aliases}. A name is its own alias."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            import json

            tree = json.load(f)
        else:
            import yaml

            tree = yaml.safe_load(f)
    rows = []
    for kind, entries in (tree or {}).items():
        for e in entries or []:
            name, aliases = (e, []) if isinstance(e, str) else (e["name"], e.get("aliases") or [])
            rows += [(kind, name, a) for a in dict.fromkeys([name, *aliases])]
    return spark.createDataFrame(rows, "kind string, name string, alias string")
