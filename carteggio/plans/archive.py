"""Queries over the mail archive that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carteggio.operators import timestamps
from carteggio.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    emails = table(spark, root, "emails").select("id", "source_file_id", "sent_at", "imported_at")
    return timestamps.normalise(emails, table(spark, root, "source_files")).where("sent_us is not null").select("id", "sent_us")


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
