"""Queries of the relational operators over the adapters, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescape.config import Calibration
from kinescape.functions import scalars
from kinescape.operators import evaluate, motion, overlap, report, spatial, stats, temporal
from kinescape.plans import adapters as A
from kinescape.sources import exchange

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CALIBRATION = Calibration(pixel_um=0.5, frame_s=2.0, source="fixed")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


STEPS = f"""WITH {A.TRAJECTORY}, lagged AS (
  SELECT *, frame - lag(frame) OVER w AS delta_frame, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy
  FROM trajectory WINDOW w AS (PARTITION BY KEYS ORDER BY frame)), walked AS (
  SELECT *, sqrt(dx * dx + dy * dy) * 0.5 AS step_distance, delta_frame * 2.0 AS step_duration,
    coalesce(link_status = 'matched' AND delta_frame = 1, false) AS accepted FROM lagged), steps AS (
  SELECT *, CASE WHEN accepted THEN step_distance / step_duration END AS speed FROM walked)"""
SUMMARY = """, told AS (SELECT KEYS, count(*) AS observations, count(*) FILTER (accepted) AS accepted_steps,
  count(*) FILTER (link_status = 'ambiguous') AS ambiguous_steps, sum(step_distance) FILTER (accepted) AS path_length,
  sum(step_duration) FILTER (accepted) AS accepted_duration,
  sqrt(pow(max_by(x, frame) - min_by(x, frame), 2) + pow(max_by(y, frame) - min_by(y, frame), 2)) * 0.5 AS net
  FROM steps GROUP BY KEYS)
SELECT KEYS, observations, accepted_steps, ambiguous_steps, round(path_length, 6) AS path_length,
  round(CASE WHEN observations > 1 AND accepted_steps = observations - 1 THEN net END, 6) AS net_displacement,
  accepted_duration, round(path_length / accepted_duration, 6) AS mean_speed,
  observations > 1 AND accepted_steps = observations - 1 AS complete, 'um' AS length_unit, 'um/s' AS speed_unit FROM told"""


def _walked(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return motion.steps(A.trajectory(spark, sf_dir), keys, CALIBRATION)


@_query(STEPS.replace("KEYS", "track_id") + """
SELECT track_id, frame, link_status, delta_frame, round(dx, 6) AS dx, round(dy, 6) AS dy, round(step_distance, 6) AS step_distance,
  step_duration, accepted, round(speed, 6) AS speed FROM steps""")
def motility_steps(spark, sf_dir):
    got = _walked(spark, sf_dir, "track_id").drop("x", "y", "week", "event_type")
    return _rounded(got, "dx", "dy", "step_distance", "speed")


@_query(STEPS.replace("KEYS", "track_id") + SUMMARY.replace("KEYS", "track_id"))
def motility_summary(spark, sf_dir):
    got = motion.summary(_walked(spark, sf_dir, "track_id"), ("track_id",), CALIBRATION)
    return _rounded(got, "path_length", "net_displacement", "mean_speed")


@_query(STEPS.replace("KEYS", "track_id, week") + SUMMARY.replace("KEYS", "track_id, week"))
def motility_summary_weekly(spark, sf_dir):
    keys = ("track_id", "week")
    return _rounded(motion.summary(_walked(spark, sf_dir, *keys), keys, CALIBRATION), "path_length", "net_displacement", "mean_speed")


@_query(STEPS.replace("KEYS", "track_id") + """
SELECT frame, round(avg(speed), 6) AS mean_speed, count(*) FILTER (accepted) AS accepted_steps FROM steps GROUP BY frame""")
def motility_by_frame(spark, sf_dir):
    return _rounded(motion.by_frame(_walked(spark, sf_dir, "track_id")), "mean_speed")


@_query(f"""WITH {A.TRAJECTORY}, moved AS (
  SELECT track_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM trajectory
  WINDOW w AS (PARTITION BY track_id ORDER BY frame)), cut AS (SELECT track_id, CASE WHEN d < 50 THEN 0.0 ELSE d END AS d FROM moved)
SELECT track_id, round(avg(d), 6) AS mean_displacement, round(sum(d), 6) AS total_displacement, round(avg(d) * 5, 6) AS mean_velocity,
  count(*) AS observations FROM cut GROUP BY track_id""")
def legacy_motility(spark, sf_dir):
    got = motion.floor_summary(A.trajectory(spark, sf_dir), least=50.0, rate=5.0)
    return _rounded(got, "mean_displacement", "total_displacement", "mean_velocity")


@_query(f"""WITH {A.TRAJECTORY} SELECT track_id, frame, x, y FROM trajectory
WHERE track_id IN (SELECT track_id FROM trajectory GROUP BY track_id HAVING count(*) >= 20)""")
def retained_tracks(spark, sf_dir):
    return motion.retained(A.trajectory(spark, sf_dir), 20, "track_id").select("track_id", "frame", "x", "y")


@_query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


_PEARSON = """CASE WHEN count(*) > 1 AND min(a) < max(a) AND min(b) < max(b) THEN round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) END"""
_OVERLAP = f"""SELECT frame, round(count(*) FILTER (in_a AND in_b) / nullif(CAST(count(*) FILTER (in_a OR in_b) AS DOUBLE), 0), 6) AS jaccard,
  round(sum(CASE WHEN in_a AND in_b THEN a ELSE 0 END) / nullif(sum(CASE WHEN in_a THEN a ELSE 0 END), 0), 6) AS manders_m1,
  round(sum(CASE WHEN in_a AND in_b THEN b ELSE 0 END) / nullif(sum(CASE WHEN in_b THEN b ELSE 0 END), 0), 6) AS manders_m2,
  {_PEARSON} AS pearson, round(sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0), 6) AS cosine,
  count(*) AS roi_pixels, count(*) FILTER (in_a AND in_b) AS overlap_pixels, count(*) FILTER (in_a) AS a_pixels, count(*) FILTER (in_b) AS b_pixels
FROM pixels GROUP BY frame"""
_METRICS = ("jaccard", "manders_m1", "manders_m2", "pearson", "cosine")


@_query(f"WITH {A.PIXELS} {_OVERLAP}")
def channel_overlap(spark, sf_dir):
    return _rounded(overlap.overlap(A.pixels(spark, sf_dir)), *_METRICS)


@_query(f"""WITH {A.PIXELS.replace('pixels AS', 'raw AS', 1)}, lows AS (
  SELECT frame, quantile_cont(a, 0.05) AS la, quantile_cont(b, 0.05) AS lb FROM raw GROUP BY frame), pixels AS (
  SELECT raw.frame, greatest(a - la, 0.0) AS a, greatest(b - lb, 0.0) AS b, in_a, in_b FROM raw JOIN lows USING (frame)) {_OVERLAP}""")
def background_overlap(spark, sf_dir):
    clean = overlap.less_background(A.pixels(spark, sf_dir), 5.0, ("frame",), ("a", "b"))
    return _rounded(overlap.overlap(clean), *_METRICS)


@_query(f"""WITH {A.PIXELS}, region AS (SELECT DISTINCT s_suppkey AS frame FROM supplier WHERE s_acctbal > 0)
{_OVERLAP.replace('FROM pixels', 'FROM pixels SEMI JOIN region USING (frame)')}""")
def region_overlap(spark, sf_dir):
    region = A.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("frame"))
    return _rounded(overlap.overlap(A.pixels(spark, sf_dir).join(region, "frame", "left_semi")), *_METRICS)


@_query(f"""WITH {A.PIXELS} SELECT frame, round(coalesce(count(*) FILTER (in_a AND in_b) / nullif(CAST(count(*) FILTER (in_a OR in_b) AS DOUBLE), 0), 0), 6) AS jaccard,
  round(100 * coalesce(count(*) FILTER (in_a AND in_b) / nullif(CAST(count(*) FILTER (in_a OR in_b) AS DOUBLE), 0), 0), 6) AS overlap_percent,
  round(coalesce(sum(CASE WHEN in_b THEN a ELSE 0 END) / nullif(sum(a), 0), 0), 6) AS manders_m1,
  round(coalesce(sum(CASE WHEN in_a THEN b ELSE 0 END) / nullif(sum(b), 0), 0), 6) AS manders_m2,
  coalesce({_PEARSON}, 0) AS pearson, round(coalesce(sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0), 0), 6) AS cosine,
  round(sum(a), 3) AS a_total, round(sum(b), 3) AS b_total FROM pixels GROUP BY frame""")
def legacy_overlap(spark, sf_dir):
    got = overlap.legacy_overlap(A.pixels(spark, sf_dir))
    return _rounded(_rounded(got, *_METRICS, "overlap_percent"), "a_total", "b_total", digits=3)


@_query(f"""WITH {A.PIXELS}, span AS (SELECT flag, min(a) AS lo, max(a) AS hi FROM pixels GROUP BY flag), counts AS (
  SELECT flag, lo, hi, CAST(least(floor((a - lo) / ((hi - lo) / 256)), 255) AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS n
  FROM pixels JOIN span USING (flag) GROUP BY ALL), mid AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 256) AS c FROM counts), sums AS (
  SELECT flag, bin, c, sum(n) OVER u AS w1, sum(n * c) OVER u AS s1, sum(n) OVER g AS w, sum(n * c) OVER g AS s FROM mid
  WINDOW u AS (PARTITION BY flag ORDER BY bin), g AS (PARTITION BY flag)), scored AS (
  SELECT flag, bin, c, coalesce(w1 * (w - w1) * pow(s1 / w1 - (s - s1) / nullif(w - w1, 0), 2), -1) AS score FROM sums)
SELECT flag, round(arg_max(c, score) * 0.8, 4) AS threshold FROM scored GROUP BY flag""")
def otsu_threshold(spark, sf_dir):
    return _rounded(overlap.otsu(A.pixels(spark, sf_dir), ("flag",), "a", factor=0.8), "threshold", digits=4)


_SPEARMAN = """, pairs AS (PAIRS), ranked AS (
  SELECT var_a, var_b, rank() OVER (PARTITION BY var_a, var_b ORDER BY p) + (count(*) OVER (PARTITION BY var_a, var_b, p) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY var_a, var_b ORDER BY q) + (count(*) OVER (PARTITION BY var_a, var_b, q) - 1) / 2.0 AS b
  FROM pairs WHERE p IS NOT NULL AND q IS NOT NULL)
SELECT var_a, var_b, CASE WHEN count(*) >= 3 AND min(a) < max(a) AND min(b) < max(b)
  THEN round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), DIGITS) + 0.0 END AS rho, count(*) AS n FROM ranked GROUP BY var_a, var_b"""
_FOUR = ("area", "eccentricity", "solidity", "aspect_ratio")


def _pair_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, '{b}' AS var_b, CAST({a} AS DOUBLE) AS p, CAST({b} AS DOUBLE) AS q FROM {source}"
        for i, a in enumerate(_FOUR) for b in _FOUR[i + 1 :]
    )


@_query(f"WITH {A.SHAPES}" + _SPEARMAN.replace("PAIRS", _pair_sql("shapes")).replace("DIGITS", "6"))
def spearman_matrix(spark, sf_dir):
    return stats.spearman(A.shapes(spark, sf_dir), list(_FOUR), digits=6)


@_query(f"WITH {A.SHAPES}, whole AS (SELECT * FROM shapes WHERE solidity IS NOT NULL)" + _SPEARMAN.replace("PAIRS", _pair_sql("whole")).replace("DIGITS", "2"))
def spearman_complete(spark, sf_dir):
    return stats.spearman(A.shapes(spark, sf_dir).na.drop(subset=list(_FOUR)), list(_FOUR), digits=2)


@_query(f"WITH {A.SHAPES} " + " UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM shapes" for a in _FOUR for b in _FOUR))
def pair_counts(spark, sf_dir):
    return stats.pair_counts(A.shapes(spark, sf_dir), list(_FOUR))


def _long(metrics, extra=""):
    return " UNION ALL ".join(f"SELECT kind, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM shapes WHERE {m} IS NOT NULL" for m in metrics)


@_query(f"""WITH {A.SHAPES}, long AS ({_long(_FOUR)}) SELECT kind, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round(median(value), 6) AS median, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS q1,
  round(quantile_cont(value, 0.75), 6) AS q3, count(*) AS n FROM long GROUP BY kind, metric""")
def five_numbers(spark, sf_dir):
    got = stats.five_numbers(A.shapes(spark, sf_dir), ["kind"], list(_FOUR))
    return _rounded(got, "mean", "std", "median", "q1", "q3")


_TOLD = f"""WITH {A.SHAPES}, long AS ({_long(_FOUR)}), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY metric, value) AS ties,
    rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS r FROM long), told AS (
  SELECT metric, count(*) FILTER (kind = 'p') AS n1, count(*) FILTER (kind = 'q') AS n2, CAST(sum(r) FILTER (kind = 'p') AS DOUBLE) AS r1,
    CAST(sum(ties * ties - 1) AS DOUBLE) AS tied, avg(value) FILTER (kind = 'p') AS m1, avg(value) FILTER (kind = 'q') AS m2,
    var_samp(value) FILTER (kind = 'p') AS v1, var_samp(value) FILTER (kind = 'q') AS v2 FROM ranked GROUP BY metric), s AS (
  SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, CAST(n1 + n2 AS DOUBLE) AS n, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS pooled FROM told)"""


def _normal_sql(z: str) -> str:
    """Two-sided tail, from the density between 0 and z in 20000 steps."""
    return f"""greatest(1 - sqrt(2 / pi()) * {z} / 20000 * list_sum(list_transform(range(20000), lambda i: exp(-0.5 * pow({z} * (i + 0.5) / 20000, 2)))), 0.0)"""


def _student_sql(t: str, v: str) -> str:
    """Two-sided tail, from the density between 0 and t in 20000 steps."""
    area = f"list_sum(list_transform(range(20000), lambda i: pow(1 + pow({t} * (i + 0.5) / 20000, 2) / {v}, -({v} + 1) / 2)))"
    return f"greatest(1 - 2 * {t} / 20000 * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi()) * {area}, 0.0)"


@_query(_TOLD + """ SELECT metric, n1, n2, round(u, 3) AS u, round(1 - 2 * u / (CAST(n1 AS DOUBLE) * n2), 6) AS rank_biserial, round((m1 - m2) / pooled, 6) AS cohens_d,
  round((m1 - m2) / (sqrt((v1 + v2) / 2) + 1e-12), 6) AS cohens_d_plain, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS welch_t,
  round((m1 - m2) / (pooled * sqrt(1.0 / n1 + 1.0 / n2)), 6) AS student_t FROM s""")
def population_tests(spark, sf_dir):
    got = stats.two_populations(A.shapes(spark, sf_dir), "kind", "p", "q", list(_FOUR))
    got = got.drop("p", "p_adjusted", "significant", "welch_p", "student_p")
    return _rounded(_rounded(got, "u", digits=3), "rank_biserial", "cohens_d", "cohens_d_plain", "welch_t", "student_t")


@_query(_TOLD + f""", z AS (
  SELECT metric, greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0.0) / sqrt(n1 * n2 / 12.0 * (n + 1 - tied / (n * (n - 1)))) AS z,
    abs(m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS tw, abs(m1 - m2) / (pooled * sqrt(1.0 / n1 + 1.0 / n2)) AS ts, n - 2 AS vs,
    pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS vw FROM s), p AS (
  SELECT metric, {_normal_sql("z")} AS p, {_student_sql("tw", "vw")} AS welch_p, {_student_sql("ts", "vs")} AS student_p FROM z)
SELECT metric, round(p, 6) AS p, round(least(p * count(p) OVER (), 1.0), 6) AS p_adjusted, round(welch_p, 6) AS welch_p, round(student_p, 6) AS student_p,
  CASE WHEN least(p * count(p) OVER (), 1.0) < 0.05 THEN 'Yes' ELSE 'No' END AS significant FROM p""")
def population_p_values(spark, sf_dir):
    """p of U by normal approximation, adjusted; p of either t."""
    got = stats.two_populations(A.shapes(spark, sf_dir), "kind", "p", "q", list(_FOUR))
    return _rounded(got.select("metric", "p", "p_adjusted", "welch_p", "student_p", "significant"), "p", "p_adjusted", "welch_p", "student_p")


@_query("""SELECT event_type, value, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 8) AS share FROM events WHERE value IS NOT NULL""")
def speed_ecdf(spark, sf_dir):
    return _rounded(stats.ecdf(A.table(spark, sf_dir, "events").select("event_type", "value"), "value", "event_type"), "share", digits=8)


@_query(f"""WITH {A.SHAPES}, span AS (SELECT kind, min(area) AS lo, max(area) AS hi FROM shapes GROUP BY kind)
SELECT kind, CAST(least(floor((area - lo) * 30 / (hi - lo)), 29) AS BIGINT) AS bin, count(*) AS n FROM shapes JOIN span USING (kind) GROUP BY 1, 2""")
def area_histogram(spark, sf_dir):
    return stats.histogram(A.shapes(spark, sf_dir).select("kind", "area"), "area", ["kind"])


_NEAR = f"""WITH {A.DETECTIONS}, within_d AS (
  SELECT p.frame, p.point_id, p.kind, min(sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2))) AS d
  FROM detections p JOIN detections o ON p.frame = o.frame AND p.point_id <> o.point_id GROUP BY ALL), between_d AS (
  SELECT p.frame, p.point_id, min(sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2))) AS d
  FROM detections p JOIN detections o ON p.frame = o.frame AND p.kind = 'a' AND o.kind = 'b' GROUP BY ALL)"""


@_query(_NEAR + " SELECT frame, point_id, round(d, 6) AS distance FROM within_d")
def nearest_within(spark, sf_dir):
    points = A.detections(spark, sf_dir)
    return _rounded(spatial.nearest(points, points, same=True), "distance")


@_query(_NEAR + " SELECT frame, point_id, round(d, 6) AS distance FROM between_d")
def nearest_between(spark, sf_dir):
    points = A.detections(spark, sf_dir)
    return _rounded(spatial.nearest(points.where("kind = 'a'"), points.where("kind = 'b'")), "distance")


@_query(_NEAR + f""", k AS (SELECT frame, kind, point_id, x, y FROM detections), w AS (
  SELECT p.kind, p.frame, p.point_id, min(sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2))) AS d FROM k p JOIN k o
  ON p.frame = o.frame AND p.kind = o.kind AND p.point_id <> o.point_id GROUP BY ALL)
SELECT round(coalesce((SELECT avg(d) FROM w WHERE kind = 'a'), 0), 6) AS mean_a, round(coalesce((SELECT avg(d) FROM w WHERE kind = 'b'), 0), 6) AS mean_b,
  round(coalesce((SELECT avg(d) FROM between_d), 0), 6) AS mean_between""")
def spatial_summary(spark, sf_dir):
    points = A.detections(spark, sf_dir)
    a, b = points.where("kind = 'a'"), points.where("kind = 'b'")
    got = spatial.spatial_summary(spatial.nearest(a, a, same=True), spatial.nearest(b, b, same=True), spatial.nearest(a, b))
    return _rounded(got, "mean_a", "mean_b", "mean_between")


@_query(_NEAR + """ SELECT frame, count(*) AS n, round(avg(d) / (0.5 * sqrt(100000.0 / count(*)) + 1e-12), 6) AS r FROM within_d GROUP BY frame""")
def clark_evans(spark, sf_dir):
    return _rounded(spatial.clark_evans(A.detections(spark, sf_dir), 100000.0), "r")


_RADII = [5.0 * i for i in range(1, 11)]


@_query(f"""WITH {A.DETECTIONS}, n AS (SELECT frame, count(*) AS n FROM detections GROUP BY frame), pairs AS (
  SELECT p.frame, sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)) AS d FROM detections p JOIN detections o ON p.frame = o.frame AND p.point_id <> o.point_id),
radii AS (SELECT unnest([{', '.join(str(r) for r in _RADII)}])::DOUBLE AS radius)
SELECT n.frame, radius, round(CASE WHEN n.n < 2 THEN 0 ELSE 100000.0 / (n.n * n.n) * (SELECT count(*) FROM pairs WHERE pairs.frame = n.frame AND d <= radius) END, 6) AS k
FROM n CROSS JOIN radii""")
def ripley_k(spark, sf_dir):
    return _rounded(spatial.ripley(A.detections(spark, sf_dir), _RADII, 100000.0), "k")


@_query(f"WITH {A.DETECTIONS} SELECT round((max(x) - min(x)) * (max(y) - min(y)), 6) AS area FROM detections")
def field_area(spark, sf_dir):
    return _rounded(spatial.field_area(A.detections(spark, sf_dir)), "area")


@_query(f"""WITH {A.DETECTIONS} SELECT p.frame, p.point_id, o.point_id AS o_point_id, round(sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)), 6) AS distance
FROM detections p JOIN detections o ON p.frame = o.frame AND p.kind = 'a' AND o.kind = 'b' WHERE sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)) <= 6""")
def pairs_in_reach(spark, sf_dir):
    points = A.detections(spark, sf_dir)
    got = spatial.pairs_within(points.where("kind = 'a'"), points.where("kind = 'b'"), 6.0, digits=6)
    return got.select("frame", "point_id", "o_point_id", "distance")


@_query(f"""WITH {A.DETECTIONS}, t AS (SELECT * FROM detections WHERE kind = 'a'), f AS (SELECT * FROM detections WHERE kind = 'b'),
h AS (SELECT f.frame, f.point_id FROM f JOIN t ON f.frame = t.frame GROUP BY ALL HAVING min(sqrt(pow(f.x - t.x, 2) + pow(f.y - t.y, 2))) <= 5),
s AS (SELECT t.frame, t.point_id FROM f JOIN t ON f.frame = t.frame GROUP BY ALL HAVING min(sqrt(pow(f.x - t.x, 2) + pow(f.y - t.y, 2))) <= 5),
c AS (SELECT frame, count(*) FILTER (kind = 'a') AS truths, count(*) FILTER (kind = 'b') AS predictions,
  (SELECT count(*) FROM h WHERE h.frame = d.frame) AS correct, (SELECT count(*) FROM s WHERE s.frame = d.frame) AS seen FROM detections d GROUP BY frame)
SELECT frame, truths, predictions, correct, predictions - correct AS false_positives, truths - seen AS false_negatives,
  round(coalesce(seen / nullif(CAST(truths AS DOUBLE), 0), 0), 6) AS recall, round(correct / nullif(CAST(predictions AS DOUBLE), 0), 6) AS precision FROM c""")
def point_evaluation(spark, sf_dir):
    points = A.detections(spark, sf_dir)
    return _rounded(spatial.evaluate_points(points.where("kind = 'a'"), points.where("kind = 'b'"), 5.0), "recall", "precision")


@_query(f"""WITH {A.SERIES}, c AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY frame) AS t,
  value - avg(value) OVER (PARTITION BY event_type) AS v FROM series), s AS (
  SELECT a.event_type, b.t - a.t AS lag, sum(a.v * b.v) AS s FROM c a JOIN c b ON a.event_type = b.event_type AND b.t - a.t BETWEEN 0 AND 10 GROUP BY 1, 2)
SELECT event_type, CAST(lag AS BIGINT) AS lag, round(coalesce(s / nullif(max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY event_type), 0), 0), 6) AS acf FROM s""")
def autocorrelation(spark, sf_dir):
    return _rounded(temporal.autocorrelation(A.series(spark, sf_dir), "value", ["event_type"], "frame", 10), "acf")


@_query(f"""WITH {A.SERIES}, d AS (SELECT * FROM (SELECT event_type, frame, value - lag(value) OVER (PARTITION BY event_type ORDER BY frame) AS d FROM series) WHERE d IS NOT NULL),
z AS (SELECT event_type, frame, abs((d - avg(d) OVER g) / nullif(stddev_pop(d) OVER g, 0)) AS z FROM d WINDOW g AS (PARTITION BY event_type)),
n AS (SELECT *, lag(z) OVER w AS b, lead(z) OVER w AS a FROM z WINDOW w AS (PARTITION BY event_type ORDER BY frame))
SELECT event_type, frame, round(z, 6) AS z FROM n WHERE z >= 1.2 AND z > b AND z > a""")
def change_points(spark, sf_dir):
    return _rounded(temporal.change_points(A.series(spark, sf_dir), "value", ["event_type"], "frame", 1.2), "z")


@_query(f"""WITH {A.SERIES} SELECT event_type, round(coalesce(stddev_pop(value) / nullif(avg(value), 0), 0), 6) AS stability, count(*) AS n FROM series GROUP BY event_type""")
def stability_index(spark, sf_dir):
    return _rounded(temporal.stability(A.series(spark, sf_dir), "value", ["event_type"]), "stability")


@_query(f"""WITH {A.SERIES}, o AS (SELECT event_type, frame, row_number() OVER (PARTITION BY event_type ORDER BY frame) - 1 AS place,
  count(*) OVER (PARTITION BY event_type) AS n FROM (SELECT DISTINCT event_type, frame FROM series)) SELECT event_type, frame FROM o WHERE place = n // 2""")
def middle_frame(spark, sf_dir):
    return temporal.middle(A.series(spark, sf_dir), ["event_type"], "frame")


_CLASS = "CASE WHEN eccentricity >= 0.8 AND coalesce(area >= 10, false) THEN 'Elongated' WHEN eccentricity <= 0.3 THEN 'Punctate' ELSE 'Intermediate' END"


@_query(f"""WITH {A.SHAPES}, c AS (SELECT kind, frame, {_CLASS} AS morphology FROM shapes), s AS (
  SELECT kind, frame, count(*) FILTER (morphology = 'Elongated') AS elongated, count(*) FILTER (morphology = 'Punctate') AS punctate FROM c GROUP BY 1, 2)
SELECT *, round(elongated / nullif(CAST(elongated + punctate AS DOUBLE), 0), 6) AS ratio FROM s""")
def elongation_ratio(spark, sf_dir):
    kind = scalars.morphology(F.col("eccentricity"), F.col("area"), 0.8, 0.3, least_elongated=10.0)
    return _rounded(temporal.elongation(A.shapes(spark, sf_dir).withColumn("morphology", kind), ["kind", "frame"]), "ratio")


@_query(f"WITH {A.SHAPES} SELECT kind, {_CLASS} AS morphology, count(*) AS n FROM shapes GROUP BY 1, 2")
def morphology_counts(spark, sf_dir):
    kind = scalars.morphology(F.col("eccentricity"), F.col("area"), 0.8, 0.3, least_elongated=10.0)
    return A.shapes(spark, sf_dir).groupBy("kind", kind.alias("morphology")).agg(F.count("*").alias("n"))


_FRAME_REPORT = f"""WITH {A.SHAPES}, spine AS (SELECT unnest(range(0, 10)) AS frame), told AS (
  SELECT frame, avg(area) FILTER (kind = 'p') AS p_area, avg(solidity) FILTER (kind = 'p') AS p_solidity, avg(area) FILTER (kind = 'q') AS q_area,
    avg(solidity) FILTER (kind = 'q') AS q_solidity, count(*) FILTER (kind = 'p') AS p_count, count(*) FILTER (kind = 'q') AS q_count,
    avg(aspect_ratio) FILTER (kind = 'p') AS p_mean_speed, avg(aspect_ratio) FILTER (kind = 'q') AS q_mean_speed FROM shapes GROUP BY frame), report AS (
  SELECT CAST(spine.frame AS BIGINT) AS frame, round(p_area, 6) AS p_area, round(p_solidity, 6) AS p_solidity, round(q_area, 6) AS q_area, round(q_solidity, 6) AS q_solidity,
    coalesce(p_count, 0) AS p_count, coalesce(q_count, 0) AS q_count, round(p_mean_speed, 6) AS p_mean_speed, round(q_mean_speed, 6) AS q_mean_speed
  FROM spine LEFT JOIN told USING (frame))"""


def _frames(spark, sf_dir):
    objects = A.shapes(spark, sf_dir)
    speeds = objects.groupBy("kind", "frame").agg(F.avg("aspect_ratio").alias("mean_speed"))
    got = report.frame_report(spark.range(10).select(F.col("id").alias("frame")), objects, speeds, ["area", "solidity"], ["p", "q"])
    return _rounded(got, "p_area", "p_solidity", "q_area", "q_solidity", "p_mean_speed", "q_mean_speed")


@_query(_FRAME_REPORT + " SELECT * FROM report")
def frame_report(spark, sf_dir):
    return _frames(spark, sf_dir)


_REPORTED = ("p_area", "p_solidity", "q_area", "q_solidity", "p_count", "q_count", "p_mean_speed", "q_mean_speed")


@_query(_FRAME_REPORT + " SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _REPORTED)
        + ", count(*) AS frames, 's1' AS sample_id, 'r1' AS replicate_id, 'frame mean' AS analysis_unit FROM report")
def sample_report(spark, sf_dir):
    return _rounded(report.sample_report(_frames(spark, sf_dir), "s1", "r1"), *_REPORTED)


@_query("""SELECT c_mktsegment AS replicate_id, round(avg(c_acctbal), 6) AS c_acctbal, count(*) AS samples FROM customer GROUP BY 1""")
def replicate_report(spark, sf_dir):
    samples = A.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("replicate_id"), F.col("c_custkey").alias("sample_id"), "c_acctbal")
    return _rounded(report.replicate_report(samples), "c_acctbal")


@_query(f"""WITH {A.DETECTIONS}, o AS (SELECT dense_rank() OVER (ORDER BY frame) - 1 AS f, point_id, x, y FROM detections)
SELECT CAST(f + 1 AS BIGINT) AS "ImageNumber", CAST(row_number() OVER (ORDER BY f, point_id) AS BIGINT) AS "ObjectNumber", x AS "AreaShape_Area", y AS "AreaShape_Solidity" FROM o""")
def export_objects(spark, sf_dir):
    points = A.detections(spark, sf_dir)
    from pyspark.sql import Window

    names = points.select("frame").distinct().withColumn("f", F.dense_rank().over(Window.orderBy("frame")) - 1)
    objects = points.join(names, "frame").select(F.col("f").alias("frame"), "point_id", F.col("x").alias("area"), F.col("y").alias("solidity"))
    return exchange.per_object(objects, ["point_id"])


@_query(f"""WITH {A.SHAPES} SELECT frame, round(sum(area), 3) AS total_area, round(avg(area), 6) AS mean_area, count(area) AS objects,
  round(avg(aspect_ratio), 6) AS mean_aspect_ratio, round(avg(solidity), 6) AS mean_solidity FROM shapes GROUP BY frame""")
def export_frames(spark, sf_dir):
    got = exchange.per_frame(A.shapes(spark, sf_dir))
    return _rounded(_rounded(got, "mean_area", "mean_aspect_ratio", "mean_solidity"), "total_area", digits=3)


@_query(f"""WITH {A.SHAPES} SELECT frame AS "Frame", count(*) AS "Individuals", CAST(NULL AS BIGINT) AS "Networks", CAST(NULL AS DOUBLE) AS "Mean_Branch_Length",
  CAST(NULL AS DOUBLE) AS "Median_Branch_Length", CAST(NULL AS DOUBLE) AS "Mean_Network_Size", round(sum(area), 3) AS "Footprint", CAST(NULL AS DOUBLE) AS "Mean_Summed_Length"
FROM shapes GROUP BY frame""")
def export_network(spark, sf_dir):
    frames = A.shapes(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("objects"), F.round(F.sum("area"), 3).alias("area"))
    return exchange.network_table(frames)


@_query("""SELECT p_partkey AS frame, p_size AS area, p_retailprice AS eccentricity FROM part""")
def import_objects(spark, sf_dir):
    theirs = A.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ImageNumber"), F.col("p_size").alias("AreaShape_Area"), F.col("p_retailprice").alias("AreaShape_Eccentricity")
    )
    return exchange.renamed(theirs)


@_query("""WITH a AS (SELECT row_number() OVER (ORDER BY p_partkey) AS place, CAST(p_size AS DOUBLE) AS a FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT row_number() OVER (ORDER BY p_partkey) AS place, CAST(p_size AS DOUBLE) AS b FROM part WHERE p_partkey % 2 = 1),
r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS p, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS q FROM a JOIN b USING (place)),
c AS (SELECT covar_pop(p, q) / (stddev_pop(p) * stddev_pop(q)) AS rho, CAST(count(*) - 2 AS DOUBLE) AS v FROM r), h AS (SELECT abs(rho) * sqrt(v / (1 - rho * rho)) AS t, v FROM c),
tail AS (SELECT """ + _student_sql("t", "v") + """ AS tail FROM h)
SELECT 'size' AS metric, round(avg(a), 4) AS mean_a, round(stddev_samp(a), 4) AS std_a, round(avg(b), 4) AS mean_b, round(stddev_samp(b), 4) AS std_b,
  round(covar_pop(p, q) / (stddev_pop(p) * stddev_pop(q)), 4) AS rho, round((SELECT tail FROM tail), 6) AS p, count(*) AS n, round(100 * (avg(b) - avg(a)) / avg(a), 2) AS percent_difference FROM r""")
def tool_comparison(spark, sf_dir):
    part = A.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    return stats.tool_comparison(part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1"), ["size"], "p_partkey")


_SCORES = """SELECT KEYS, tp, fp, fn, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS dice,
  round(coalesce(tp / nullif(CAST(tp + fp + fn AS DOUBLE), 0), 0), 6) AS iou, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1 FROM c"""
_SCORED = ("dice", "iou", "precision", "recall", "f1")


@_query(f"WITH {A.PIXELS}, c AS (SELECT frame, count(*) FILTER (in_a AND in_b) AS tp, count(*) FILTER (in_a AND NOT in_b) AS fp, count(*) FILTER (NOT in_a AND in_b) AS fn FROM pixels GROUP BY frame) "
        + _SCORES.replace("KEYS", "frame"))
def mask_scores(spark, sf_dir):
    return _rounded(evaluate.mask_scores(A.pixels(spark, sf_dir), ["frame"], "in_a", "in_b"), *_SCORED)


@_query(f"""WITH {A.PIXELS}, g AS (SELECT unnest([10000.0, 30000.0, 50000.0])::DOUBLE AS threshold), c AS (
  SELECT flag, threshold, count(*) FILTER (a > threshold AND in_b) AS tp, count(*) FILTER (a > threshold AND NOT in_b) AS fp, count(*) FILTER (a <= threshold AND in_b) AS fn
  FROM pixels CROSS JOIN g GROUP BY 1, 2) """ + _SCORES.replace("KEYS", "flag, threshold"))
def threshold_sweep(spark, sf_dir):
    return _rounded(evaluate.threshold_sweep(A.pixels(spark, sf_dir), "a", "in_b", [10000.0, 30000.0, 50000.0], ["flag"]), *_SCORED)


@_query(f"WITH {A.PIXELS}, c AS (SELECT flag, count(*) FILTER (in_a AND in_b) AS tp, count(*) FILTER (in_a AND NOT in_b) AS fp, count(*) FILTER (NOT in_a AND in_b) AS fn FROM pixels GROUP BY flag) "
        + " UNION ALL ".join(f"SELECT flag AS category, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM c" for m in ("tp", "fp", "fn")))
def flat_report(spark, sf_dir):
    return evaluate.flat_report(evaluate.mask_scores(A.pixels(spark, sf_dir), ["flag"], "in_a", "in_b"), "flag", ["tp", "fp", "fn"])


@_query(f"""WITH {A.DETECTIONS} SELECT frame, point_id, round((y - min(y) OVER g) / (max(y) OVER g - min(y) OVER g + 1e-12), 6) AS y
FROM detections WINDOW g AS (PARTITION BY frame)""")
def min_max_scaled(spark, sf_dir):
    return A.detections(spark, sf_dir).select("frame", "point_id", F.round(scalars.min_max(F.col("y"), "frame"), 6).alias("y"))


@_query(f"""WITH {A.DETECTIONS} SELECT frame FROM detections WHERE kind = 'a' INTERSECT SELECT frame FROM detections WHERE kind = 'b'""")
def shared_frames(spark, sf_dir):
    points = A.detections(spark, sf_dir)
    return points.where("kind = 'a'").select("frame").intersect(points.where("kind = 'b'").select("frame"))


@_query(f"""WITH {A.SHAPES}, s AS (SELECT kind, frame, count(*) AS n, sum(area) AS total FROM shapes GROUP BY 1, 2)
SELECT kind, frame, round(coalesce(1000.0 * n / nullif(total, 0), 0), 6) AS fragmentation, round(n / (frame + 1.0), 6) AS connectivity FROM s""")
def network_indices(spark, sf_dir):
    got = A.shapes(spark, sf_dir).groupBy("kind", "frame").agg(F.count("*").alias("n"), F.sum("area").alias("total"))
    return got.select(
        "kind", "frame", F.round(scalars.fragmentation(F.col("n"), F.col("total")), 6).alias("fragmentation"),
        F.round(scalars.connectivity(F.col("n"), F.col("frame")), 6).alias("connectivity"),
    )


@_query(f"""WITH {A.SHAPES}, p AS (SELECT frame, count(*) AS n, round(avg(area), 6) AS mean FROM shapes WHERE kind = 'p' GROUP BY 1),
  q AS (SELECT frame, count(*) AS n, round(avg(area), 6) AS mean FROM shapes WHERE kind = 'q' GROUP BY 1), r AS (SELECT frame, round(avg(aspect_ratio), 4) AS ratio FROM shapes GROUP BY 1)
SELECT frame, p.n AS n_p, p.mean AS mean_p, q.n AS n_q, q.mean AS mean_q, ratio FROM p JOIN q USING (frame) JOIN r USING (frame)""")
def chained_frames(spark, sf_dir):
    objects = A.shapes(spark, sf_dir)
    each = {k: objects.where(F.col("kind") == k).groupBy("frame").agg(F.count("*").alias("n"), F.round(F.avg("area"), 6).alias("mean")) for k in ("p", "q")}
    return report.chained(each | {"r": objects.groupBy("frame").agg(F.round(F.avg("aspect_ratio"), 4).alias("ratio"))})


@_query(f"""WITH {A.SHAPES} SELECT kind, frame, object_id, count(*) AS n, round(sum(least(1.0, 4 * pi() * area / (aspect_ratio * aspect_ratio + 1e-9))), 6) AS legacy,
  round(sum(4 * pi() * area / nullif(aspect_ratio * aspect_ratio, 0)), 6) AS plain FROM shapes GROUP BY 1, 2, 3""")
def circularities(spark, sf_dir):
    got = A.shapes(spark, sf_dir).groupBy("kind", "frame", "object_id")
    area, length = F.col("area"), F.col("aspect_ratio")
    return got.agg(
        F.count("*").alias("n"), F.round(F.sum(scalars.legacy_circularity(area, length)), 6).alias("legacy"),
        F.round(F.sum(scalars.circularity(area, length)), 6).alias("plain"),
    )


@_query(f"""WITH {A.SHAPES} SELECT kind, CASE WHEN eccentricity >= 0.8 AND area >= 20 THEN 'Elongated' WHEN eccentricity <= 0.6 AND area >= 10 THEN 'Punctate'
  ELSE 'Intermediate' END AS morphology, count(*) AS n FROM shapes GROUP BY 1, 2""")
def gated_morphology(spark, sf_dir):
    kind = scalars.morphology(F.col("eccentricity"), F.col("area"), least_elongated=20, least_punctate=10)
    return A.shapes(spark, sf_dir).groupBy("kind", kind.alias("morphology")).agg(F.count("*").alias("n"))


@_query(f"""WITH {A.SHAPES} SELECT kind, frame, 'a' AS source, area FROM shapes WHERE kind = 'p' UNION ALL BY NAME SELECT kind, frame, 'b' AS source, area FROM shapes WHERE kind = 'q'""")
def union_by_name(spark, sf_dir):
    objects = A.shapes(spark, sf_dir).select("kind", "frame", "area")
    first = objects.where("kind = 'p'").withColumn("source", F.lit("a"))
    return first.unionByName(objects.where("kind = 'q'").withColumn("source", F.lit("b")), allowMissingColumns=True)
