"""spark-submit entry: ``python -m kinescape ROUTE FRAMES SETTINGS.json OUT``.

ROUTE is baseline or particles; FRAMES a table of frame rows, or TIFF files if it ends in .tif;
each result goes to OUT/<name>, in order of movie, track, frame and label.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from kinescape.config import MovieSettings, ParticleSettings, from_json
from kinescape.operators.movies import baseline, particles
from kinescape.sources.exchange import write_table
from kinescape.sources.frames import FRAME_SCHEMA
from kinescape.sources.tiff import read_tiff
from kinescape.sources.manifest import digests, manifest, write_manifest


#: Columns that tables are written in order of.
ORDER = ("movie", "channel", "track_id", "frame", "label")


def main(route: str, frames: str, settings: str, out: str) -> None:
    spark = SparkSession.builder.appName("kinescape").getOrCreate()
    kind, run = {"baseline": (MovieSettings, baseline), "particles": (ParticleSettings, particles)}[route]
    with open(settings, encoding="utf-8") as f:
        chosen = from_json(kind, f.read())
    source = read_tiff(spark, frames) if frames.endswith((".tif", ".tiff")) else spark.read.schema(FRAME_SCHEMA).parquet(frames)
    counts, outputs = {}, {}
    for name, table in run(source, chosen).items():
        write_table(table, f"{out}/{name}", order=tuple(c for c in ORDER if c in table.columns))
        counts[name] = spark.read.parquet(f"{out}/{name}").count()
        outputs[name] = digests(spark, f"{out}/{name}")
    write_manifest(spark, manifest(chosen, digests(spark, frames), counts, outputs=outputs), f"{out}/manifest")


if __name__ == "__main__":
    main(*sys.argv[1:5])
