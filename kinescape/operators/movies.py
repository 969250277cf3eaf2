"""Segmenting and measuring frame rows; the two routes from frames to tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescape.config import MaskSettings, MovieSettings, ParticleSettings, SpotSettings
from kinescape.functions.scalars import morphology
from kinescape.kernels import regions, segment
from kinescape.kernels.morphology import components, skeleton_counts, thinned
from kinescape.operators import linking, motion, overlap, report, stats
from kinescape.operators.evaluate import mask_scores, scored
from kinescape.sources.frames import check_frames, check_labels

_KEYS = "movie string, frame int, channel int"
OBJECTS = (
    f"{_KEYS}, label int, x double, y double, area double, contour_area double, contour_length double, circularity double, "
    "crofton_length double, eccentricity double, solidity double, aspect_ratio double, orientation double"
)


def _image(row) -> np.ndarray:
    return np.asarray(row.pixels, float).reshape(row.height, row.width)


def label_frames(frames: DataFrame, settings: dict[int, MaskSettings] | MaskSettings | None = None) -> DataFrame:
    """Frame rows with labels (array<int>) and the threshold; frames are independent, nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples():
                own = settings.get(row.channel, MaskSettings()) if isinstance(settings, dict) else settings or MaskSettings()
                found.append(segment.mask(_image(row), own))
            yield batch.assign(labels=[x.ravel().astype(np.int32) for x, _ in found], threshold=[t for _, t in found])

    return frames.mapInPandas(run, f"{_KEYS}, height int, width int, pixels array<double>, labels array<int>, threshold double")


def label_masks(frames: DataFrame) -> DataFrame:
    """Frame rows whose pixels are a mask: its connected parts as labels, 8 neighbours, raster order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(labels=[components(_image(r) > 0).ravel().astype(np.int32) for r in batch.itertuples()])

    return frames.mapInPandas(run, f"{_KEYS}, height int, width int, pixels array<double>, labels array<int>")


def backend_frames(frames: DataFrame, backend: str, **settings) -> DataFrame:
    """Frame rows with labels by a named thresholding method."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(labels=[segment.segment(_image(r), backend, **settings).ravel().astype(np.int32) for r in batch.itertuples()])

    return frames.mapInPandas(run, f"{_KEYS}, height int, width int, pixels array<double>, labels array<int>")


def backend_pixels(frames: DataFrame, backends: tuple[str, ...], **settings) -> DataFrame:
    """backend, movie, frame, pixels: labelled pixels of each frame by each named thresholding method, in one pass over frames.

    Frames are dealt out first, as a movie's frames may come from one task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                image = _image(r)
                out += [(b, r.movie, r.frame, int((segment.segment(image, b, **settings) > 0).sum())) for b in backends]
            yield pd.DataFrame(out, columns=["backend", "movie", "frame", "pixels"])

    tasks = 4 * frames.sparkSession.sparkContext.defaultParallelism
    dealt = frames.select("movie", "frame", "height", "width", "pixels").repartition(tasks, "movie", "frame")
    return dealt.mapInPandas(run, "backend string, movie string, frame int, pixels int")


def measure(labelled: DataFrame) -> DataFrame:
    """One row for each label of each frame, with moments, contour and hull measures."""
    names = [c.split()[0] for c in OBJECTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                labels = np.asarray(row.labels, int).reshape(row.height, row.width)
                out += [{"movie": row.movie, "frame": row.frame, "channel": row.channel, **m} for m in regions.measured(labels)]
            yield pd.DataFrame(out, columns=names)

    return labelled.select("movie", "frame", "channel", "height", "width", "labels").mapInPandas(run, OBJECTS)


def classed(objects: DataFrame, settings: MovieSettings) -> DataFrame:
    """Objects with their area in square micrometres and their class."""
    px = settings.calibration.pixel_um
    area = F.lit(None).cast("double") if px is None else F.col("area") * px**2
    out = objects.withColumn("area_um2", area)
    kind = morphology(
        F.col("eccentricity"), F.col("area_um2"), settings.elongated, settings.punctate,
        settings.least_elongated_um2, settings.least_punctate_um2,
    )
    return out.withColumn("morphology", kind)


def spot_frames(frames: DataFrame, settings: SpotSettings | None = None) -> DataFrame:
    """Frame rows with spot labels, centres (array<struct<y, x>>), noise_response, threshold and detections."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [segment.spots(_image(r), settings) for r in batch.itertuples()]
            yield batch.assign(
                labels=[x.labels.ravel().astype(np.int32) for x in found],
                centres=[[{"y": float(y), "x": float(x)} for y, x in f.centres] for f in found],
                noise_response=[x.noise for x in found], threshold=[x.level for x in found], detections=[len(x.centres) for x in found],
            )[names]

    schema = (
        f"{_KEYS}, height int, width int, pixels array<double>, labels array<int>, centres array<struct<y: double, x: double>>, "
        "noise_response double, threshold double, detections long"
    )
    names = ["movie", "frame", "channel", "height", "width", "pixels", "labels", "centres", "noise_response", "threshold", "detections"]
    return frames.mapInPandas(run, schema)


def skeletons(labelled: DataFrame) -> DataFrame:
    """Per frame: parts, area, skeleton length, branch points and end points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                labels = np.asarray(r.labels, int).reshape(r.height, r.width)
                out.append((r.movie, r.frame, r.channel, len(np.unique(labels[labels > 0])), int((labels > 0).sum()), *skeleton_counts(thinned(labels > 0))))
            yield pd.DataFrame(out, columns=["movie", "frame", "channel", "objects", "area", "length", "branches", "ends"])

    return labelled.select("movie", "frame", "channel", "height", "width", "labels").mapInPandas(
        run, f"{_KEYS}, objects long, area long, length long, branches long, ends long"
    )


def drifts(frames: DataFrame) -> DataFrame:
    """Shift of each frame onto the one before, channels summed; frame 0 is unmoved, constant frames null."""
    summed = frames.groupBy("movie", "frame", "height", "width").agg(F.collect_list("pixels").alias("all"))
    added = F.aggregate(
        F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.element_at("all", 1),
        lambda s, x: F.zip_with(s, x, lambda p, q: p + q),
    )
    whole = summed.select("movie", "frame", "height", "width", added.alias("pixels"))
    before = whole.select("movie", (F.col("frame") + 1).alias("frame"), F.col("pixels").alias("earlier"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.earlier is None:
                    out.append((r.movie, r.frame, 0.0, 0.0, None))
                    continue
                got = segment.drift(np.asarray(r.earlier).reshape(r.height, r.width), _image(r))
                out.append((r.movie, r.frame, *(got or (None, None, None))))
            yield pd.DataFrame(out, columns=["movie", "frame", "shift_y", "shift_x", "error"])

    return whole.join(before, ["movie", "frame"], "left").mapInPandas(run, "movie string, frame int, shift_y double, shift_x double, error double")


def agreement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Scores of our labels against another tool's, frame by frame; any label is inside."""
    keys = ["movie", "frame", "channel"]
    flat = lambda d, n: d.select(*keys, F.posexplode("labels").alias("pos", "v")).select(*keys, "pos", (F.col("v") > 0).alias(n))
    return mask_scores(flat(ours, "found").join(flat(theirs, "truth"), [*keys, "pos"]), keys)


def sensitivity(
    frames: DataFrame, backend: str, parameter: str, values: list, truth: Callable[[str, int], np.ndarray] | DataFrame, **fixed
) -> DataFrame:
    """Scores of a thresholding method for each value of one of its parameters.

    ``truth`` is a function of movie and frame that gives a mask, or frame rows with labels.
    Every frame is segmented once a value; scores are counted where the frame is.
    """
    answer = truth if callable(truth) else None
    if answer is None:
        known = truth.select("movie", "frame", "channel", F.col("labels").alias("truth"))
        frames = frames.join(known, ["movie", "frame", "channel"])
    grid = frames.withColumn("value", F.explode(F.array(*(F.lit(float(v)) for v in values))))
    kinds = {float(v): v for v in values}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                found = segment.segment(_image(r), backend, **{parameter: kinds[r.value]}, **fixed) > 0
                want = np.asarray(answer(r.movie, r.frame) if answer else r.truth).reshape(found.shape) > 0
                out.append((r.movie, r.frame, r.channel, r.value, int((found & want).sum()), int((found & ~want).sum()), int((~found & want).sum())))
            yield pd.DataFrame(out, columns=["movie", "frame", "channel", "value", "tp", "fp", "fn"])

    return scored(grid.mapInPandas(run, f"{_KEYS}, value double, tp long, fp long, fn long"))


def overlap_frames(
    labelled: DataFrame, first: int, second: int, region: DataFrame | None = None, percentile: float | None = None
) -> DataFrame:
    """Overlap metrics of two channels of labelled frame rows, over their pixel rows in a region."""

    def flat(channel: int, name: str) -> DataFrame:
        each = F.arrays_zip(F.sequence(F.lit(1), F.size("pixels")).alias("pos"), F.col("pixels").alias("v"), F.col("labels").alias("l"))
        rows = labelled.where(F.col("channel") == channel).select("movie", "frame", F.explode(each).alias("p"))
        return rows.select("movie", "frame", "p.pos", F.col("p.v").alias(name), (F.col("p.l") > 0).alias(f"in_{name}"))

    pixels = flat(first, "a").join(flat(second, "b"), ["movie", "frame", "pos"])
    if region is not None:
        on = [c for c in ("movie", "frame", "pos") if c in region.columns]
        pixels = pixels.join(region.select(*on).distinct(), on, "left_semi")
    if percentile is not None:
        pixels = overlap.less_background(pixels, percentile, ("movie", "frame"), ("a", "b"))
    return overlap.overlap(pixels, ("movie", "frame"))


#: Measures of objects whose means a frame report holds.
MEASURES = ["area", "circularity", "eccentricity", "solidity", "aspect_ratio"]


def retained_labels(found: DataFrame, kept: DataFrame) -> DataFrame:
    """Label frames without the labels of tracks that were not kept (movie/channel, frame, ordinal from 0)."""
    held = kept.groupBy(F.col("movie").alias("name"), "frame").agg(F.collect_set(F.col("ordinal") + 1).alias("kept"))
    named = found.withColumn("name", F.concat_ws("/", "movie", "channel")).join(held, ["name", "frame"], "left")
    inside = lambda v: F.when(F.array_contains("kept", v), v).otherwise(F.lit(0))
    return named.select(*(F.transform("labels", inside).alias(c) if c == "labels" else F.col(c) for c in found.columns))


def baseline(
    frames: DataFrame, settings: MovieSettings | None = None, labels: DataFrame | None = None, region: DataFrame | None = None,
    checked: bool = True,
) -> dict[str, DataFrame]:
    """The baseline route: labels, objects, tracks, steps, summaries, overlap of two channels, drift,
    a report of each frame with its rank correlations, and the sample's row.

    ``labels`` are given label frames (movie, frame, channel, labels) in place of segmentation;
    ``region`` (pos from 1, frame if it moves) bounds the overlap. The tables share labelled
    frames; write or persist them where several are wanted. ``checked`` refuses frames and
    labels that are not whole, finite and not negative, in one pass over them.
    """
    s = settings or MovieSettings()
    wanted = frames.where(F.col("channel").isin(*s.channels))
    if checked:
        check_frames(wanted)
        if labels is not None:
            check_labels(labels, "labels")
    if labels is None:
        labelled = label_frames(wanted, dict(zip(s.channels, s.masks, strict=True)))
    else:
        labelled = wanted.join(labels.select("movie", "frame", "channel", "labels"), ["movie", "frame", "channel"])
    objects = classed(measure(labelled), s)
    points = objects.select(
        F.concat_ws("/", "movie", "channel").alias("movie"), "frame", (F.col("label") - 1).alias("ordinal"), "x", "y"
    )
    tracks = linking.link_adjacent(points, s.gate)
    walked = motion.steps(tracks, ("movie", "track_id"), s.calibration, s.drop_ambiguous)
    by_frame, shared = motion.by_frame(walked, "movie"), overlap_frames(labelled, *s.channels, region=region, percentile=s.background_percentile)
    kind = lambda c: F.concat(F.lit("channel_"), c)
    told = report.frame_report(
        wanted, objects.withColumn("kind", kind(F.col("channel").cast("string"))),
        by_frame.select(
            F.regexp_extract("movie", "^(.*)/[^/]*$", 1).alias("movie"), "frame", kind(F.regexp_extract("movie", "([^/]*)$", 1)).alias("kind"), "mean_speed"
        ),
        MEASURES, [f"channel_{c}" for c in s.channels], shared, by=("movie", "frame"),
    )
    numbers = [c for c, k in told.dtypes if k in ("double", "bigint", "int") and c != "frame"]
    return {
        "labels": labelled, "objects": objects, "tracks": tracks, "steps": walked,
        "motility": motion.summary(walked, ("movie", "track_id"), s.calibration),
        "frame_motility": by_frame, "overlap": shared, "report": told, "ranks": stats.spearman(told, numbers, ("movie",)),
        "sample": report.sample_report(told, s.sample, s.replicate), "drift": drifts(wanted),
    }


def particles(frames: DataFrame, settings: ParticleSettings | None = None, checked: bool = True) -> dict[str, DataFrame]:
    """The particle route: spots, raw and retained tracks, labels of retained tracks alone, steps,
    summaries, shapes of retained labels, and with two channels the overlap of retained labels."""
    s = settings or ParticleSettings()
    wanted = frames.where(F.col("channel").isin(*s.channels))
    if checked:
        check_frames(wanted)
    found = spot_frames(wanted, s.spots)
    name = F.concat_ws("/", "movie", "channel")
    points = found.select(name.alias("movie"), "frame", F.posexplode("centres").alias("ordinal", "c")).select(
        "movie", "frame", "ordinal", F.col("c.x").alias("x"), F.col("c.y").alias("y")
    )
    raw = linking.link_particles(points, s.links)
    kept = motion.retained(raw, s.least_observations, "movie", "track_id")
    walked = motion.steps(kept, ("movie", "track_id"), s.calibration)
    shapes = measure(found).withColumn("movie", name).withColumnsRenamed({"x": "mask_x", "y": "mask_y"})
    shapes = shapes.join(kept.select("movie", "frame", (F.col("ordinal") + 1).alias("label"), "x", "y", "track_id"), ["movie", "frame", "label"])
    left = retained_labels(found, kept)
    both = {"overlap": overlap_frames(left, *s.channels[:2])} if len(s.channels) > 1 else {}
    return both | {
        "spots": found, "labels": left, "raw_tracks": raw, "tracks": kept, "steps": walked, "shapes": shapes,
        "motility": motion.summary(walked, ("movie", "track_id"), s.calibration),
        "frame_motility": motion.by_frame(walked, "movie"),
        "thresholds": found.select("movie", "frame", "channel", "noise_response", "threshold", "detections"),
    }
