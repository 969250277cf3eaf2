"""Quartile bucket digests of whole texts, and of texts edited with their successor's start."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescape.llm.common import OUT_ROWS, _arrow_schema, arrow_rows, mapped, range_count, stored

#: Second and third byte of the triplets in a window of five, and the number of buckets.
TRIPLETS, BUCKETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)), 256
#: A difference counts up to so much for each bucket on average.
BOUND = 2 * BUCKETS
_draw = np.random.default_rng(7)
_PLACES = [bytes(_draw.permutation(256).astype(np.uint8)) for _ in range(5)]
_TURNS = [_draw.permutation(BUCKETS) for _ in TRIPLETS]
_STEPS = np.array([0, 1, 2, 6])


def quartiles(data: bytes) -> np.ndarray:
    """256 codes from 0 to 3: how many quartiles of all bucket counts a bucket's count is over.

    Then one code of the length, a logarithm to 1.1.
    """
    counts = np.zeros(BUCKETS, np.int64)
    placed = [np.frombuffer(data.translate(t), np.uint8) for t in _PLACES]
    n = len(data)
    for (i, j), turn in zip(TRIPLETS, _TURNS, strict=True):
        if n > j:
            mixed = placed[0][: n - j] ^ placed[i][i : n - j + i] ^ placed[j][j:]
            counts += np.bincount(mixed, minlength=BUCKETS)[turn]
    bars = np.partition(counts, (63, 127, 191))[[63, 127, 191]]
    codes = (counts[:, None] > bars).sum(axis=1)
    return np.append(codes, min(255, int(math.log(n + 1, 1.1)))).astype(np.uint8)


def digest(codes: np.ndarray) -> str:
    """Hexadecimal: two digits of length, then four buckets a byte."""
    four = codes[:BUCKETS].reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    return f"{codes[BUCKETS]:02x}" + np.bitwise_or.reduce(four, axis=1).astype(np.uint8).tobytes().hex()


def parsed(text: str) -> np.ndarray:
    """The codes of a digest."""
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    four = (raw[1:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return np.append(four.reshape(-1), raw[0])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 less the difference over its bound: 1 for equal codes, never below 0.

    Buckets differ by 1, 2 or 6 (three quartiles apart), lengths by their codes beyond one.
    The bound is twice the number of buckets, or less where both texts fill few buckets.
    """
    x, y = a[:BUCKETS].astype(np.int64), b[:BUCKETS].astype(np.int64)
    apart = int(_STEPS[np.abs(x - y)].sum()) + max(0, abs(int(a[BUCKETS]) - int(b[BUCKETS])) - 1)
    bound = min(BOUND, max(int(_STEPS[np.maximum(x, y)].sum()), 8))
    return 1 - min(apart, bound) / bound


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each text and of its edited text, and likenesses, one row per row.

    The edited text has the last n_chars // 4 code points replaced by as many first ones of
    the next text (or all of it) in ascending ``key``; after the last comes the first. Nulls
    of ``key`` come last, rows of one key by a hash of the text; a null text is empty. A single
    row is its own successor. Returns ``key``, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Other columns are not read.

    Texts are dealt once, by ranges of key, hash and a random number, so no key or repeated
    row is too large for a range. Each range also tells its first and its last text; the
    last is settled with the next range's first in a second, small step.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    texts = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("key"), texts.alias("text"), F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("k"),
        F.xxhash64(texts).alias("h"), F.rand(3).alias("r"),
    )
    dealt = rows.repartitionByRange(range_count(df), "k", "h", "r").sortWithinPartitions("k", "h", "text").select("key", "text")
    told = (
        f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    schema = f"{told}, `part of` int, `first of` string, `last of` string"
    target = _arrow_schema(spark, schema)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first, held = [], None, None
        for b in batches:
            for name, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                codes = quartiles(s.encode())
                if held is None:
                    first = s
                else:
                    out.append((*_row(*held, s, codes), None, None, None))
                held = name, s, codes
                if len(out) >= OUT_ROWS:
                    yield batch(out)
        if held is not None:
            out.append((held[0], *[None] * 6, TaskContext.get().partitionId(), first, held[1]))
            yield batch(out)

    found = stored(mapped(dealt, run, schema))
    ends = found.where("`part of` IS NOT NULL")
    parts = sorted(r[0] for r in ends.select("part of").collect())  # a number for each range
    after = spark.createDataFrame([*zip(parts, parts[1:] + parts[:1], strict=True)], "`part of` int, `next` int")
    successor = ends.select(F.col("part of").alias("next"), F.col("first of").alias("successor"))
    pairs = ends.join(after, "part of").join(successor, "next").select(key, "last of", "successor")

    def settle(b: pa.RecordBatch) -> Iterator[dict[str, list]]:
        rows = [
            _row(name, s, quartiles(s.encode()), t, quartiles(t.encode()))
            for name, s, t in zip(*(c.to_pylist() for c in b.columns), strict=True)
        ]
        if rows:
            yield dict(zip(target.names, map(list, zip(*rows, strict=True)), strict=False))

    return found.where("`part of` IS NULL").select(*target.names[:7]).unionByName(arrow_rows(pairs, told, settle))


def _row(name, s: str, own: np.ndarray, after: str, codes: np.ndarray) -> tuple:
    cut = len(s) // 4
    edited = (s[: len(s) - cut] + after[:cut]).encode()
    new = quartiles(edited)
    return (
        name, len(s), hashlib.sha256(edited).hexdigest(), digest(own), digest(new), likeness(own, new), likeness(own, codes)
    )
