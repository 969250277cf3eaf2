"""Steps and summaries of trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinescape.config import Calibration
from kinescape.functions.scalars import floored, ratio


def check_unique(df: DataFrame, *keys: str) -> None:
    """Raise if any combination of ``keys`` comes twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{keys} must be unique; {twice[0].asDict()} is not")


def steps(
    tracks: DataFrame,
    keys: tuple[str, ...] = ("track_id",),
    calibration: Calibration | None = None,
    drop_ambiguous: bool = True,
) -> DataFrame:
    """Tracks with delta_frame, dx, dy, step_distance, step_duration, accepted, speed.

    One sort by (keys, frame). A step is accepted if it is matched (or ambiguous, if these are
    wanted) and joins adjacent frames; speed is null elsewhere. First rows have null steps.
    """
    c = calibration or Calibration()
    order = Window.partitionBy(*keys).orderBy("frame")
    good = F.col("link_status") == "matched"
    if not drop_ambiguous:
        good = good | (F.col("link_status") == "ambiguous")
    out = tracks
    for name, source in (("delta_frame", "frame"), ("dx", "x"), ("dy", "y")):
        out = out.withColumn(name, F.col(source) - F.lag(source).over(order))
    out = out.withColumn("step_distance", F.hypot("dx", "dy") * F.lit(float(c.pixel_um or 1.0)))
    out = out.withColumn("step_duration", F.col("delta_frame") * F.lit(float(c.frame_s or 1.0)))
    out = out.withColumn("accepted", F.coalesce(good & (F.col("delta_frame") == 1), F.lit(False)))
    return out.withColumn("speed", F.when(F.col("accepted"), ratio(F.col("step_distance"), F.col("step_duration"))))


def summary(
    walked: DataFrame, keys: tuple[str, ...] = ("track_id",), calibration: Calibration | None = None
) -> DataFrame:
    """One row a track, from :func:`steps`: path, net displacement, time and mean speed of accepted steps."""
    c = calibration or Calibration()
    scale = F.lit(float(c.pixel_um or 1.0))
    end = lambda name: F.max_by(name, "frame") - F.min_by(name, "frame")
    got = walked.groupBy(*keys).agg(
        F.count("*").alias("observations"),
        F.count_if("accepted").alias("accepted_steps"),
        F.count_if(F.col("link_status") == "ambiguous").alias("ambiguous_steps"),
        F.sum(F.when(F.col("accepted"), F.col("step_distance"))).alias("path_length"),
        F.sum(F.when(F.col("accepted"), F.col("step_duration"))).alias("accepted_duration"),
        F.hypot(end("x"), end("y")).alias("net"),
    )
    whole = (F.col("observations") > 1) & (F.col("accepted_steps") == F.col("observations") - 1)
    return got.select(
        *keys, "observations", "accepted_steps", "ambiguous_steps", "path_length",
        F.when(whole, F.col("net") * scale).alias("net_displacement"),
        "accepted_duration",
        ratio(F.col("path_length"), F.col("accepted_duration")).alias("mean_speed"),
        whole.alias("complete"),
        F.lit(c.length_unit).alias("length_unit"), F.lit(c.speed_unit).alias("speed_unit"),
    )


def by_frame(walked: DataFrame, *by: str) -> DataFrame:
    """Mean speed and number of accepted steps of each frame."""
    return walked.groupBy(*by, "frame").agg(
        F.avg("speed").alias("mean_speed"), F.count_if("accepted").alias("accepted_steps")
    )


def floor_summary(
    tracks: DataFrame, keys: tuple[str, ...] = ("track_id",), least: float = 0.0, rate: float = 1.0
) -> DataFrame:
    """Mean and total displacement and velocity of a track; displacements below ``least`` count as 0."""
    order = Window.partitionBy(*keys).orderBy("frame")
    dx, dy = (F.col(n) - F.lag(n).over(order) for n in ("x", "y"))
    moved = tracks.withColumn("displacement", F.sqrt(dx * dx + dy * dy))
    if least > 0:
        moved = moved.withColumn("displacement", floored(F.col("displacement"), least))
    return moved.groupBy(*keys).agg(
        F.avg("displacement").alias("mean_displacement"),
        F.sum("displacement").alias("total_displacement"),
        (F.avg("displacement") * rate).alias("mean_velocity"),
        F.count("*").alias("observations"),
    )


def retained(tracks: DataFrame, least: int, *keys: str) -> DataFrame:
    """Rows of tracks with at least ``least`` observations; one shuffle by the track."""
    held = tracks.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    return held.where(F.col("__n") >= least).drop("__n")
