"""CSV sinks with every field quoted, and a store of trained models."""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECTIONS = ["recordingId", "recordingName", "frameIndex", "timeSec", "PC1", "PC2", "cluster"]
TIMELINE = ["timeSec", "frameIndex", "cluster"]


def write_csv(df: DataFrame, path: str, columns: list[str] = PROJECTIONS) -> None:
    """One folder of CSV parts with a header; nulls are empty fields, quotes are doubled, blanks at either end stay."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    text.write.option("header", True).option("quoteAll", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str] = PROJECTIONS) -> DataFrame:
    """What write_csv() wrote, as strings; an empty field is null. Values may hold line ends, so a part is read by one task."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    found = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return found.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


class ModelStore:
    """Models as a log of events under a path all machines see; the last event of a model counts.

    A model is a small JSON document, so an event is one row; nothing is rewritten in
    place and a write that fails leaves no half model.
    """

    EVENT = "at double, seq string, kind string, id string, name string, body string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self, kind: str, model_id: str, name: str | None = None, body: str | None = None) -> None:
        row = (time.time(), uuid.uuid4().hex, kind, model_id, name, body)
        self.spark.createDataFrame([row], self.EVENT).coalesce(1).write.mode("append").json(self.path)

    def save(self, name: str, pca: dict | None = None, kmeans: dict | None = None, meta: dict | None = None) -> str:
        model_id = uuid.uuid4().hex
        self._log("save", model_id, name, json.dumps({"pca": pca, "kmeans": kmeans, "meta": meta or {}}))
        return model_id

    def rename(self, model_id: str, name: str) -> None:
        self._log("rename", model_id, name)

    def delete(self, model_id: str) -> None:
        """The model goes; if it was active, none is."""
        self._log("delete", model_id)

    def activate(self, model_id: str) -> None:
        self._log("activate", model_id)

    def _events(self) -> DataFrame:
        return self.spark.read.schema(self.EVENT).json(self.path)

    def models(self) -> DataFrame:
        """id, name, created_at, has_pca, has_kmeans, active, body; the newest first."""
        last = F.struct("at", "seq")
        e = self._events()
        by = e.groupBy("id").agg(
            F.max_by("name", F.when(F.col("name").isNotNull(), last)).alias("name"),
            F.min("at").alias("created_at"),
            F.max_by("body", F.when(F.col("kind") == "save", last)).alias("body"),
            F.bool_or(F.col("kind") == "delete").alias("gone"),
        )
        active = e.agg(F.max_by("id", F.when(F.col("kind") == "activate", last)).alias("active_id"))
        has = lambda part: F.coalesce(F.get_json_object("body", f"$.{part}"), F.lit("null")) != "null"
        rows = by.where("not gone and body is not null").join(F.broadcast(active))
        return rows.select("id", "name", "created_at", has("pca").alias("has_pca"), has("kmeans").alias("has_kmeans"), (F.col("id") == F.coalesce("active_id", F.lit(""))).alias("active"), "body").orderBy(F.desc("created_at"), "id")

    def load(self, model_id: str) -> dict[str, Any]:
        row = self.models().where(F.col("id") == model_id).first()
        if row is None:
            raise KeyError(model_id)
        return {"id": row["id"], "name": row["name"], **json.loads(row["body"])}

    def active(self) -> str | None:
        row = self.models().where("active").first()
        return row["id"] if row else None
