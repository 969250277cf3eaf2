"""Record of a run: settings, digests of its files, counts."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinescape.config import run_id, to_json


def digests(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each data file under a path, by its name; hashed where the file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    return {r.name: r.digest for r in rows.orderBy("name").collect()}


def manifest(
    settings, inputs: dict[str, str], counts: dict[str, int], warnings: tuple[str, ...] = (), outputs: dict[str, dict[str, str]] | None = None
) -> dict:
    """The run's identity, settings, inputs, units, counts, warnings, and the digests of each output's files."""
    c = settings.calibration
    return {
        "run_id": run_id(settings, *inputs.values()), "made": datetime.now(timezone.utc).isoformat(), "settings": json.loads(to_json(settings)),
        "inputs": inputs, "units": {"length": c.length_unit, "speed": c.speed_unit}, "counts": counts, "warnings": list(warnings),
        "outputs": outputs or {},
    }


def write_manifest(spark: SparkSession, told: dict, path: str) -> None:
    """One JSON record at a path that must not exist; infinities and NaN are refused."""
    row = spark.createDataFrame([(json.dumps(told, sort_keys=True, allow_nan=False),)], "value string")
    row.coalesce(1).write.mode("errorifexists").text(path)
