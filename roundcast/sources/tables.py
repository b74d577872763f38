"""History tables on shared storage: append, route, upsert, reconcile, export."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundcast.operators.labels import dedupe, label_ticks, upsert

TABLES = ("ticks", "rounds", "matches", "training_data")

TICK_SCHEMA = {
    "match_id": "string",
    "sequence": "bigint",
    "timestamp": "timestamp",
    "map_name": "string",
    "round_number": "int",
    "phase": "string",
    "seconds_remaining": "double",
    "bomb_planted": "boolean",
    "bomb_seconds": "double",
    "score_ct": "int",
    "score_t": "int",
    "alive_ct": "int",
    "alive_t": "int",
    "health_ct": "int",
    "health_t": "int",
    "money_ct": "int",
    "money_t": "int",
    "equipment_ct": "int",
    "equipment_t": "int",
    "losses_ct": "int",
    "losses_t": "int",
    "kills_ct_window": "int",
    "kills_t_window": "int",
    "window_seconds": "double",
}
DEFAULTS = {
    "string": "",
    "bigint": 0,
    "int": 0,
    "double": 0.0,
    "boolean": False,
    "timestamp": None,
}
#: Columns that tables of older schemas lack.
FILLED = ("kills_ct_window", "kills_t_window", "window_seconds")


def route(events: DataFrame, kinds: Sequence[str], kind: str = "event_type") -> dict[str, DataFrame]:
    """One branch per event type; the wildcard branch is the input itself."""
    return {name: events.filter(F.col(kind) == name) for name in kinds}


def reconcile(
    df: DataFrame, schema: dict[str, str] = TICK_SCHEMA
) -> tuple[DataFrame, list[str]]:
    """Add columns an older table lacks, with typed defaults; return their names.

    Columns the table already has keep their values, so running it again adds nothing; rows of older files, which
    have nothing there, get the default too.
    """
    missing = [name for name in schema if name not in df.columns]
    added = {name: F.lit(DEFAULTS[schema[name]]).cast(schema[name]) for name in missing}
    held = {
        name: F.coalesce(F.col(name), F.lit(DEFAULTS[kind]).cast(kind))
        for name, kind in schema.items()
        if name in df.columns and name in FILLED
    }
    out = df.withColumns({**added, **held})
    rest = [c for c in df.columns if c not in schema]
    return out.select(*schema, *rest), missing


class History:
    """The four history tables under one folder.

    Ticks are append-only. Rounds and matches are appended as arrivals with the
    batch id and reduced to the last arrival on read, so a retried batch or a
    replay never rewrites a table in place. A writer's batches lie under its run,
    whose names grow with time: another writer, or one that counts from 0 again,
    replaces nothing.
    """

    def __init__(self, spark: SparkSession, root: str, run: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.run = run or f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}"

    def _known(self, table: str) -> str:
        if table not in TABLES:
            raise ValueError(f"no history table is called {table}")
        return table

    def write(self, ticks: DataFrame, rounds: DataFrame, matches: DataFrame, batch: int) -> None:
        """Append one batch; a repeated batch id replaces what it wrote before."""
        for name, rows in (("ticks", ticks), ("rounds", rounds), ("matches", matches)):
            rows.drop("run", "batch").write.mode("overwrite").parquet(
                f"{self.root}/{name}/run={self.run}/batch={int(batch)}"
            )

    def read(self, table: str) -> DataFrame:
        self._known(table)
        if table == "training_data":
            return label_ticks(dedupe(self.read("ticks")), self.read("rounds"))
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{table}")
        if table == "ticks":
            return reconcile(rows.drop("run", "batch"))[0]
        keys = ["match_id", "round_number"] if table == "rounds" else ["match_id"]
        rows = rows.withColumn("run", F.col("run").cast("string"))
        columns = [c for c in rows.columns if c not in (*keys, "run", "batch", "sequence")]
        return upsert(rows, keys, ["run", "batch", "sequence"], columns)

    def count(self, table: str) -> int:
        return self.read(table).count()

    def export(self, destination: str, table: str = "training_data") -> str:
        self.read(table).write.mode("overwrite").parquet(destination)
        return destination
