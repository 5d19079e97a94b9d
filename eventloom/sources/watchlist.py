"""The watch list: settings and entries from documents or a file."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "kind string, label string, role string, aliases array<string>, searched boolean"
# Settings that a list need not name.
DEFAULTS = {"categories": ["revival", "screening_event", "exhibition", "concert", "goods"], "include_unmatched": False, "drop_past_events": True, "max_queries": 100, "max_x_queries": 20, "venue_queries": True}


def pending(documents: DataFrame) -> DataFrame:
    """Entries not searched yet: only those whose flag is literally false."""
    return documents.filter("searched = false")


def entries(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, kind, label, role, aliases) with trimmed texts; blank labels go, other kinds than person are works."""
    label = F.trim(F.coalesce("label", F.lit("")))
    aliases = F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    return documents.filter(label != "").select("doc_id", F.when(F.col("kind") == "person", "person").otherwise("work").alias("kind"), label.alias("label"), F.coalesce("role", F.lit("")).alias("role"), aliases.alias("aliases"))


def from_documents(documents: DataFrame, fallback: Mapping | None = None, pending_only: bool = False) -> dict:
    """The watch list that a run goes by. It is kept by hand, and so small enough for the driver; pending_only leaves out the
    fixed venue queries."""
    settings = DEFAULTS | dict((fallback or {}).get("settings", {})) | ({"venue_queries": False} if pending_only else {})
    rows = entries(pending(documents) if pending_only else documents).orderBy("doc_id").collect()
    people = [{"name": r.label, "role": r.role, "aliases": list(r.aliases)} for r in rows if r.kind == "person"]
    return {"settings": settings, "people": people, "works": [{"title": r.label, "aliases": list(r.aliases)} for r in rows if r.kind == "work"]}


def from_file(spark: SparkSession, path: str) -> dict:
    """A JSON watch list, read by Spark so that any store will do."""
    found = json.loads(spark.read.text(path, wholetext=True).first().value)
    return {"people": [], "works": []} | found | {"settings": DEFAULTS | found.get("settings", {})}
