"""Frame rows: movie, frame, channel, height, width, pixels (row-major)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_SCHEMA = "movie string, frame int, channel int, height int, width int, pixels array<double>"


def normalised(array: np.ndarray, axes: str) -> np.ndarray:
    """An array under the letters of ``axes`` as time, row, column, channel.

    S is a channel; a missing time or channel is added; a depth of one is dropped, a larger
    one refused, as are empty, non-finite or negative arrays.
    """
    array, letters = np.asarray(array), axes.upper().replace("S", "C")
    sizes = dict(zip(letters, array.shape, strict=False))
    faults = {
        f"axes {axes} do not describe an array of {array.ndim} dimensions with Y and X once each": (
            len(letters) != array.ndim or len(sizes) != array.ndim or not {"Y", "X"} <= sizes.keys() <= set("TZYXC")
        ),
        "only a depth of one can be dropped": sizes.get("Z", 1) != 1,
        "a movie must not be empty, negative or non-finite": not (array.size and np.isfinite(array).all() and (array >= 0).all()),
    }
    for fault, met in faults.items():
        if met:
            raise ValueError(fault)
    # the depth comes first, where reshaping drops it
    moved = np.transpose(array, [letters.index(a) for a in "ZTYXC" if a in sizes])
    return moved.reshape([sizes.get(a, 1) for a in "TYXC"])


def checked_axes(native: str, override: str | None, reason: str | None) -> str:
    """The axes to use; another order than the file's needs a reason."""
    if override and override.upper() != native.upper() and not reason:
        raise ValueError("axes that differ from the file's need a reason")
    return override or native


def from_array(spark: SparkSession, movie: str, array: np.ndarray, axes: str = "TYXC") -> DataFrame:
    """Frame rows of a small movie held by the driver (fixtures); files come as frame rows."""
    a = normalised(array, axes)
    rows = [
        (movie, t, c, a.shape[1], a.shape[2], a[t, :, :, c].astype(float).ravel().tolist())
        for t in range(a.shape[0])
        for c in range(a.shape[3])
    ]
    return spark.createDataFrame(rows, FRAME_SCHEMA)


def pixel_rows(frames: DataFrame, value: str = "pixels") -> DataFrame:
    """One row for each pixel: movie, frame, channel, y, x, intensity."""
    return frames.select("movie", "frame", "channel", "width", F.posexplode(value).alias("pos", "intensity")).select(
        "movie", "frame", "channel", F.expr("pos div width").cast("int").alias("y"), F.expr("pos % width").cast("int").alias("x"), "intensity"
    )


def labels_above(frames: DataFrame) -> DataFrame:
    """Imported label frames as masks: positive is inside."""
    return frames.withColumn("pixels", F.transform("pixels", lambda v: (v > 0).cast("double")))


def check_frames(frames: DataFrame) -> None:
    """Raise on frames without all their pixels, or with one that is null, negative or not finite."""
    bad = F.exists("pixels", lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf")))
    bad = bad | F.col("pixels").isNull() | (F.size("pixels") != F.col("height") * F.col("width")) | (F.size("pixels") < 1)
    if not frames.where(bad).limit(1).isEmpty():
        raise ValueError("frames must be whole, finite and not negative")


def check_labels(labels: DataFrame, column: str = "pixels") -> None:
    """Raise on labels that are null, negative, fractional or beyond 32 bits."""
    bad = F.exists(column, lambda v: v.isNull() | (v < 0) | (v != F.floor(v)) | (v >= 2**32))
    if not labels.where(bad).limit(1).isEmpty():
        raise ValueError("labels must be whole numbers from 0 to 2^32 - 1")
