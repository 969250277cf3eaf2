"""Queries of kernels and linkers over tiles and detections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinescape.config import LinkSettings, MaskSettings, MovieSettings, SpotSettings
from kinescape.operators import linking, motion, movies
from kinescape.plans import adapters as A
from kinescape.plans.relational import _rounded
from kinescape.sources import exchange
from kinescape.sources.frames import pixel_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def frames(spark: SparkSession, sf_dir: str, shift: float = 1.0) -> DataFrame:
    """Tiles as frame rows of one channel, lifted above 0."""
    return A.tiles(spark, sf_dir).select(
        "movie", F.col("frame").cast("int").alias("frame"), F.lit(0).alias("channel"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.transform("values", lambda v: v + shift).alias("pixels"),
    )


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask of each tile's values over 0.1; the movie is the tile."""
    return A.tiles(spark, sf_dir).select(
        F.col("vec_id").cast("string").alias("movie"), F.lit(0).alias("frame"), F.lit(0).alias("channel"), F.lit(8).alias("height"),
        F.lit(8).alias("width"), F.transform("values", lambda v: (v > 0.1).cast("double")).alias("pixels"),
    )


def _labelled_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_rows(movies.label_masks(_masks(spark, sf_dir)), "labels").where("intensity > 0").select(
        F.col("movie").cast("long").alias("vec_id"), "y", "x", F.col("intensity").alias("label")
    )


_PARTS = """WITH RECURSIVE px AS (
  SELECT vec_id, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x FROM (
    SELECT vec_id, unnest(range(1, 65)) AS pos, unnest(embedding) AS v FROM embeddings) WHERE CAST(v AS DOUBLE) > 0.1),
r AS (SELECT vec_id, y, x, y * 8 + x AS root FROM px UNION
  SELECT p.vec_id, p.y, p.x, r.root FROM r JOIN px p ON p.vec_id = r.vec_id AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1),
parts AS (SELECT vec_id, y, x, min(root) AS root FROM r GROUP BY ALL)
"""


@_query(_PARTS + "SELECT vec_id, count(DISTINCT root) AS objects FROM parts GROUP BY vec_id")
def object_counts(spark, sf_dir):
    return _labelled_pixels(spark, sf_dir).groupBy("vec_id").agg(F.countDistinct("label").alias("objects"))


@_query(_PARTS + """SELECT vec_id, dense_rank() OVER (PARTITION BY vec_id ORDER BY root) AS label, size, round(cy, 6) AS y, round(cx, 6) AS x FROM (
  SELECT vec_id, root, count(*) AS size, avg(y) AS cy, avg(x) AS cx FROM parts GROUP BY vec_id, root)""")
def object_centres(spark, sf_dir):
    got = _labelled_pixels(spark, sf_dir).groupBy("vec_id", F.col("label").cast("long").alias("label")).agg(
        F.count("*").alias("size"), F.avg("y").alias("y"), F.avg("x").alias("x")
    )
    return _rounded(got, "y", "x")


@_query(_PARTS + """, s AS (SELECT vec_id, root, count(*) AS size FROM parts GROUP BY ALL)
SELECT vec_id, round(avg(size), 6) AS mean_size, count(*) AS objects FROM s GROUP BY vec_id""")
def object_sizes(spark, sf_dir):
    return _rounded(exchange.mean_size(_labelled_pixels(spark, sf_dir), ["vec_id"]), "mean_size")


@_query()
def tile_objects(spark, sf_dir):
    """Baseline masks and their measures."""
    labelled = movies.label_frames(frames(spark, sf_dir), MaskSettings(border_free=False, opening=0))
    return movies.classed(movies.measure(labelled), MovieSettings())


@_query()
def tile_spots(spark, sf_dir):
    got = movies.spot_frames(frames(spark, sf_dir), SpotSettings(sigma=1.0, background_sigma=3.0, snr=1.5))
    return got.select("movie", "frame", F.round("noise_response", 9).alias("noise"), F.round("threshold", 9).alias("threshold"), "detections")


@_query()
def tile_backends(spark, sf_dir):
    """Labelled pixels of each thresholding method."""
    names = ("otsu", "sauvola", "niblack", "local_mean", "subtracted")
    return movies.backend_pixels(frames(spark, sf_dir), names, least=2, opening=0, border_free=False)


@_query()
def tile_skeletons(spark, sf_dir):
    return movies.skeletons(movies.label_masks(_masks(spark, sf_dir)))


@_query("""WITH px AS (SELECT vec_id, unnest(embedding) AS v FROM embeddings), c AS (SELECT vec_id, count(*) FILTER (v > 0.1 AND v > 0) AS tp,
  count(*) FILTER (v > 0.1 AND v <= 0) AS fp, count(*) FILTER (v <= 0.1 AND v > 0) AS fn FROM (SELECT vec_id, CAST(v AS DOUBLE) AS v FROM px) GROUP BY vec_id)
SELECT vec_id, tp, fp, fn, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS dice,
  round(coalesce(tp / nullif(CAST(tp + fp + fn AS DOUBLE), 0), 0), 6) AS iou FROM c""")
def tile_agreement(spark, sf_dir):
    both = A.tiles(spark, sf_dir).select(
        F.col("vec_id").cast("string").alias("movie"), F.lit(0).alias("frame"), F.lit(0).alias("channel"),
        F.transform("values", lambda v: (v > 0.1).cast("int")).alias("labels"), F.transform("values", lambda v: (v > 0).cast("int")).alias("other"),
    )
    got = movies.agreement(both, both.withColumn("labels", F.col("other")))
    return _rounded(got.select(F.col("movie").cast("long").alias("vec_id"), "tp", "fp", "fn", "dice", "iou"), "dice", "iou")


@_query()
def tile_sensitivity(spark, sf_dir):
    """Otsu masks at several factors against the tiles' own masks."""
    source = frames(spark, sf_dir)
    truth = source.withColumn("labels", F.transform("pixels", lambda v: (v > 1.1).cast("int")))
    got = movies.sensitivity(source, "otsu", "factor", [0.8, 1.0, 1.2], truth, least=1, opening=0, border_free=False)
    return _rounded(got, "dice", "iou", "precision", "recall", "f1")


@_query()
def tile_drift(spark, sf_dir):
    return _rounded(movies.drifts(frames(spark, sf_dir)), "shift_y", "shift_x", "error")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part: one movie for each size class, a frame for each brand, detections by size and price."""
    part = A.table(spark, sf_dir, "part")
    names = part.select("p_brand").distinct().withColumn("frame", F.dense_rank().over(Window.orderBy("p_brand")) - 1)
    order = Window.partitionBy("movie", "frame").orderBy("p_partkey")
    return part.join(names, "p_brand").select(
        F.when(F.col("p_size") > 25, "large").otherwise("small").alias("movie"), F.col("frame").cast("int").alias("frame"), "p_partkey",
        F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"),
    ).withColumn("ordinal", (F.row_number().over(order) - 1).cast("int")).drop("p_partkey")


_POINTS = """WITH points AS (SELECT CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS movie, dense_rank() OVER (ORDER BY p_brand) - 1 AS frame, p_partkey,
  CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), o AS (
  SELECT *, row_number() OVER (PARTITION BY movie, frame ORDER BY p_partkey) - 1 AS ordinal FROM points), e AS (
  SELECT n.movie, CAST(n.frame AS INTEGER) AS frame, CAST(p.ordinal AS INTEGER) AS a, CAST(n.ordinal AS INTEGER) AS b, sqrt(pow(n.x - p.x, 2) + pow(n.y - p.y, 2)) AS d
  FROM o n JOIN o p ON n.movie = p.movie AND n.frame = p.frame + 1 WHERE sqrt(pow(n.x - p.x, 2) + pow(n.y - p.y, 2)) <= 8)"""


@_query(_POINTS + """ SELECT movie, frame, a, b, round(d, 6) AS distance, count(*) OVER (PARTITION BY movie, frame, a) AS n_a,
  count(*) OVER (PARTITION BY movie, frame, b) AS n_b FROM e""")
def link_candidates(spark, sf_dir):
    return linking.candidates(points(spark, sf_dir), 8.0, digits=6)


@_query(_POINTS + " SELECT movie, frame, a, arg_min(b, (d, b)) AS b, round(min(d), 6) AS distance FROM e GROUP BY movie, frame, a")
def nearest_links(spark, sf_dir):
    return _rounded(linking.nearest_link(points(spark, sf_dir), 8.0), "distance")


@_query()
def linked_tracks(spark, sf_dir):
    """Baseline linker: identities, statuses and candidate counts."""
    return _rounded(linking.link_adjacent(points(spark, sf_dir), 8.0), "link_distance")


@_query()
def linked_particles(spark, sf_dir):
    """Particle linker with gaps and prediction."""
    got = linking.link_particles(points(spark, sf_dir), LinkSettings(gate=8.0, gap=1, prediction=0.5))
    return _rounded(got, "link_distance", "prediction_error", "assignment_margin")


@_query()
def linked_margins(spark, sf_dir):
    """Particle linker between adjacent frames in parallel, ambiguity by margin."""
    return _rounded(linking.link_adjacent(points(spark, sf_dir), 8.0, margin=0.5), "link_distance", "assignment_margin")


@_query()
def linked_motility(spark, sf_dir):
    tracks = linking.link_adjacent(points(spark, sf_dir), 8.0)
    got = motion.summary(motion.steps(tracks, ("movie", "track_id")), ("movie", "track_id"))
    return _rounded(got, "path_length", "net_displacement", "mean_speed")
