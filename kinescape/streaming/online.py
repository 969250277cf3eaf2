"""Streams of events and of detections."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinescape.config import LinkSettings
from kinescape.kernels.matching import Live, advance


def file_stream(spark: SparkSession, folder: str, schema, name: str | None = None, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a few a batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return (reader.option("pathGlobFilter", name) if name else reader).parquet(folder)


def window_counts(events: DataFrame, width: str = "1 day", late: str = "2 days", time: str = "ts", by: str = "event_type") -> DataFrame:
    """Number and sum of values of each window and kind; rows later than ``late`` are dropped from the state."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    got = stamped.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), by, "n", "total")


def _folder(spark: SparkSession) -> str:
    """A new place in the folder that driver and executors share; in local sessions without one, a temporary one."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(told or tempfile.mkdtemp(prefix='kinescape-stream-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream gives for all that is there now, as a written table.

    A batch that is run again replaces what it wrote. In complete mode the last batch stays.
    """
    folder = _folder(stream.sparkSession)
    part = (lambda n: f"{folder}/rows") if mode == "complete" else (lambda n: f"{folder}/rows/batch={n}")
    keep = lambda rows, n: rows.write.mode("overwrite").parquet(part(n))
    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(part(-1))
    run = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/rows").select(stream.columns)


_OUT = "movie string, frame int, track_id long, ordinal int, x double, y double, link_status string, link_distance double"
_STATE = "count long, first int, frame int, ids array<long>, ys array<double>, xs array<double>"


def link_online(points: DataFrame, settings: LinkSettings | None = None) -> DataFrame:
    """The particle linker without gaps or prediction over a stream of points (movie, frame, ordinal, x, y).

    State holds one frame of each movie. Frames of a movie come in order, each whole in a
    batch; what an earlier frame brings late is refused.
    """
    s = settings or LinkSettings()
    if s.gap or s.prediction:
        raise ValueError("online linking has neither gaps nor prediction")
    names = [c.split()[0] for c in _OUT.split(", ")]

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        live, count, first, last = Live.none(), 0, int(rows.frame.min()), None
        if state.exists:
            count, first, last, ids, ys, xs = state.get
            place = np.column_stack([ys, xs]).reshape(-1, 2)
            live = Live(np.array(ids, np.int64), np.full(len(ids), last, np.int64), place, np.zeros(place.shape))
        if last is not None and rows.frame.min() <= last:
            raise ValueError(f"frame {rows.frame.min()} of {key[0]} came after frame {last}")
        for frame, now in rows.sort_values(["frame", "ordinal"]).groupby("frame"):
            live, told = advance(live, int(frame), now[["y", "x"]].to_numpy(float), s, count, frame == first)
            count, last = max(count, int(told["track_id"].max()) + 1), int(frame)
            yield now[["frame", "ordinal", "x", "y"]].assign(movie=key[0], **told)[names]
        live = live.only(live.frame == last)
        state.update((count, first, last, live.track.tolist(), live.place[:, 0].tolist(), live.place[:, 1].tolist()))

    return points.groupBy("movie").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
