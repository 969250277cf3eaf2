"""b-bit MinHash near-duplicates: bands, packed signatures, a check on full sets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescape.llm.common import _arrow_schema, arrow_rows, components, dropped, mapped, slices, stored
from kinescape.llm.words import mixed, shingle_sets

#: Minima of a signature, bands and their rows, and low bits kept of each minimum.
MINIMA, BANDS, ROWS, BITS = 256, 32, 6, 4
#: Standard errors of the estimate below the threshold at which a pair is still checked.
ERRORS = 3.5
#: Members of a bucket that are compared in one group.
BLOCK = 512
_NIBBLES = np.uint64(0x1111111111111111)


#: Terms of the multipliers of the 32-bit hash functions and of band hashes.
_draw = np.random.default_rng(20240229)
_TIMES, _PLUS = (_draw.integers(0, 1 << 32, (MINIMA, 1), np.uint32) | np.uint32(1), _draw.integers(0, 1 << 32, (MINIMA, 1), np.uint32))
_ROW = _draw.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) << np.uint64(1) | np.uint64(1)


def minima(items: np.ndarray) -> np.ndarray:
    """The least value of each hash function over ``items``, in blocks of bounded memory."""
    low = np.full(MINIMA, np.iinfo(np.uint32).max, np.uint32)
    short = (items ^ (items >> np.uint64(32))).astype(np.uint32)[None, :]
    for at in range(0, len(items), 2048):
        values = short[:, at : at + 2048] * _TIMES
        values += _PLUS
        np.minimum(low, values.min(axis=1), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """Low bits of each minimum (rows of minima), after a mixing that all its bits enter; 16 a 64-bit word."""
    x = (low ^ (low >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    kept = (x & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(low), -1, 16)
    return np.bitwise_or.reduce(kept << (np.arange(16, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def band_hashes(low: np.ndarray) -> np.ndarray:
    """One hash for the rows of each band, of full minima (rows of minima)."""
    parts = mixed(low[:, : BANDS * ROWS].astype(np.uint64).reshape(len(low), BANDS, ROWS))
    return mixed((parts * _ROW).sum(axis=2, dtype=np.uint64)).view(np.int64)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity by bit counts of packed signatures (rows of 64-bit words), corrected for collisions."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    same = MINIMA - np.bitwise_count(d & _NIBBLES).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return (same / MINIMA - chance) / (1 - chance)


def sketch(df: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the whole set, null if empty), sig and band hashes."""

    def work(batch):
        for part in slices(batch):
            sets = list(shingle_sets(part.column(1).to_pylist(), width))
            known = np.array([len(x) > 0 for x in sets])
            low = np.stack([minima(x) for x in sets])
            sigs, bands = packed(low), band_hashes(low)
            told = [xxhash.xxh128_digest(x.tobytes()) if len(x) else None for x in sets]
            yield {
                "doc_id": part.column(0), "n_shingles": [*map(len, sets)], "set_id": told,
                "sig": [x.tobytes() if k else None for x, k in zip(sigs, known, strict=True)],
                "bands": pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(known * BANDS)]).astype(np.int32), pa.array(bands[known].ravel())
                ),
            }

    return arrow_rows(
        df.select(F.col(key).cast("long").alias("doc_id"), text),
        "doc_id long, n_shingles long, set_id binary, sig binary, bands array<long>",
        work,
    )


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of equal ``key`` from sorted batches, several groups at a time."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if left is not None:
            table = pa.concat_tables([left, table])
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
        if cut:
            yield table.slice(0, cut)
        left = table.slice(cut)
    if left is not None and left.num_rows:
        yield left


def _candidates(members: DataFrame, cut: float, threshold: int, spread: bool) -> DataFrame:
    """Pairs a < b of a group whose estimate reaches ``cut``.

    members: slot, side, class_id, label, n_shingles, sig; side is 2 in a block of its own, else
    that of two blocks. Without ``spread``, a member and its likeliest partner that comes
    earlier; with it, each two different labels of which some members meet.
    """
    schema = "a long, b long"
    target = _arrow_schema(members.sparkSession, schema)

    def run(batches):
        for table in _runs(batches, "slot"):
            slot = table.column("slot").to_numpy()
            ids, labels = table.column("class_id").to_numpy(), table.column("label").to_numpy()
            sizes, side = table.column("n_shingles").to_numpy(), table.column("side").to_numpy()
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u8").reshape(len(ids), -1)
            firsts = np.concatenate([[0], np.flatnonzero(slot[1:] != slot[:-1]) + 1, [len(slot)]])
            out: set[tuple[int, int]] = set()
            for lo, hi in zip(firsts[:-1], firsts[1:], strict=True):
                if side[lo] != 2 and side[lo] == side[hi - 1]:
                    continue  # one side of two blocks is empty
                edge = int(np.searchsorted(side[lo:hi], 1)) + lo if side[lo] == 0 else 0
                for i in range(max(lo + 1, edge), hi):
                    end = edge or i
                    near = likeness(sigs[lo:end], sigs[i])
                    fit = (near >= cut) & (labels[lo:end] != labels[i])
                    fit &= 100 * np.minimum(sizes[lo:end], sizes[i]) >= threshold * np.maximum(sizes[lo:end], sizes[i])
                    if not fit.any():
                        continue
                    if spread:
                        own = int(labels[i])
                        out.update((min(own, x), max(own, x)) for x in np.unique(labels[lo:end][fit]).tolist())
                    else:
                        j = lo + int(np.where(fit, near, -1.0).argmax())
                        out.add((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
            if out:
                a, b = zip(*sorted(out), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=target)

    dealt = members.repartition("slot").sortWithinPartitions("slot", "side", "class_id")
    return mapped(dealt, run, schema).where("a <> b").distinct()


def _shared(p: np.ndarray, q: np.ndarray) -> int:
    """Common members of two sorted sets."""
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    return int((q[at] == p).sum())


def _joined(pairs: DataFrame, labelled: DataFrame, cut: float, threshold: int) -> tuple[DataFrame, DataFrame]:
    """a, b of the pairs of labels of which some members link by their full sets, and a table to drop after use.

    The smaller label's members go to the larger one's, in blocks of either side; what a block
    finds is one row for each two labels, however many members link.
    """
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"))
    by = lambda c: sizes.select(F.col("label").alias(c), F.col("n").alias(f"n_{c}"))
    told = pairs.join(by("a"), "a").join(by("b"), "b")
    larger = F.struct("n_b", "b") > F.struct("n_a", "a")
    told = told.select(F.when(larger, F.col("b")).otherwise(F.col("a")).alias("big"), F.when(larger, F.col("a")).otherwise(F.col("b")).alias("label"))
    small = told.join(labelled, "label")
    own = labelled.withColumnRenamed("label", "big").join(told.select("big").distinct(), "big").withColumn("label", F.col("big"))
    count = lambda d, n: d.groupBy("big").agg(F.ceil(F.count("*") / BLOCK).alias(n))
    # written before it is joined, so that a label of many members can be split over tasks
    blocks = stored(count(small, "rows").join(count(own, "columns"), "big"))
    at = F.xxhash64("class_id", "big")

    def side(df: DataFrame, number: int, mine: str, other: str) -> DataFrame:
        placed = df.join(blocks, "big").withColumn("own", F.pmod(at, F.col(mine)))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        cell = ("own", "other") if number == 0 else ("other", "own")
        return placed.select(
            F.xxhash64("big", *cell).alias("slot"), F.lit(number).alias("side"), "big", "label", "class_id", "items", "sig"
        )

    both = side(small, 0, "rows", "columns").unionByName(side(own, 1, "columns", "rows"))
    schema = "a long, b long"
    target = _arrow_schema(pairs.sparkSession, schema)

    def run(batches):
        for table in _runs(batches, "slot"):
            slot, sides = table.column("slot").to_numpy(), table.column("side").to_numpy()
            labels, big = table.column("label").to_numpy(), table.column("big").to_numpy()
            items = [np.frombuffer(x, "<u8") for x in table.column("items").to_pylist()]
            sizes = np.array([len(x) for x in items])
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u8").reshape(len(items), -1)
            firsts = np.concatenate([[0], np.flatnonzero(slot[1:] != slot[:-1]) + 1, [len(slot)]])
            out: set[tuple[int, int]] = set()
            for lo, hi in zip(firsts[:-1], firsts[1:], strict=True):
                edge = int(np.searchsorted(sides[lo:hi], 1)) + lo
                for i in range(lo, edge):
                    link = (int(min(labels[i], big[lo])), int(max(labels[i], big[lo])))
                    if link in out:
                        continue
                    near = likeness(sigs[edge:hi], sigs[i])
                    fit = (near >= cut) & (100 * np.minimum(sizes[edge:hi], sizes[i]) >= threshold * np.maximum(sizes[edge:hi], sizes[i]))
                    for j in edge + np.flatnonzero(fit)[np.argsort(-near[fit], kind="stable")]:
                        n = _shared(items[i], items[j])
                        if 100 * n >= threshold * (sizes[i] + sizes[j] - n):
                            out.add(link)
                            break
            if out:
                a, b = zip(*sorted(out), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=target)

    dealt = both.repartition("slot").sortWithinPartitions("slot", "side", "class_id")
    return mapped(dealt, run, schema).distinct(), blocks


def _checked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """a, b of the pairs whose full sets reach the threshold, by whole numbers."""
    both = (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
        .select("a", "b", "x", "y")
    )

    def work(batch):
        for part in slices(batch):
            good = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = _shared(p, q)
                good.append(100 * shared >= threshold * (len(p) + len(q) - shared))
            yield {"a": part.column(0), "b": part.column(1), "good": good}

    return arrow_rows(both, "a long, b long, good boolean", work).where("good").select("a", "b").distinct()


def _set_rows(df: DataFrame, width: int) -> DataFrame:
    def work(batch):
        for part in slices(batch):
            yield {
                "doc_id": part.column(0),
                "items": [x.astype("<u8").tobytes() for x in shingle_sets(part.column(1).to_pylist(), width)],
            }

    return arrow_rows(df, "doc_id long, items binary", work)


def near_duplicates(
    df: DataFrame, width: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Groups of near-duplicate texts: doc_id, n_shingles, component_id, kept, one row per row.

    Two texts link if 100 * shared >= ``threshold`` * united over their sets of distinct
    ``width``-word shingles (words of A-Z in lower case between blanks and characters 9 to 13;
    fewer words: the whole sequence as one shingle). component_id is the least doc_id that
    links reach; kept says doc_id = component_id. A null, empty or wordless text has no
    shingles and links with nothing; a null doc_id links with nothing, has a null component and
    is kept. Rows of one doc_id are one node; of different texts that have the same least
    doc_id, only that with the least digest seeks links. Other columns are not read.

    Equal sets become one class by their digest before anything else. 256 minima are kept as
    4 bits each; 32 bands of 6 full minima make buckets (a pair at 0.8 meets with probability
    0.99994). Buckets with the same members are looked at once, in blocks of 512 members.
    Estimates no more than 3.5 standard errors below the threshold go to a check on full sets. First
    each member tries its likeliest earlier partner; then components that meet in a bucket
    are held against each other, all members of either, in blocks that end at the first
    link. So no link that would join components is left out, and no group is spelled out in
    pairs.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(sketch(docs, width, "doc_id", "text"))
    known = rows.where("doc_id IS NOT NULL AND set_id IS NOT NULL")
    # equal sets have equal signatures, so any row of a class tells them
    unique = stored(
        known.groupBy("set_id").agg(
            F.min("doc_id").alias("class_id"), *(F.first(c).alias(c) for c in ("n_shingles", "sig", "bands"))
        )
    )
    classes = unique.select("set_id", "class_id")
    twice = unique.groupBy("class_id").agg(F.count("*").alias("sets"), F.min("set_id").alias("least")).where("sets > 1")
    if not twice.isEmpty():
        later = unique.join(twice, "class_id").where("set_id <> least").select("set_id")
        unique = unique.join(later, "set_id", "left_anti")
    posted = unique.select("class_id", F.explode("bands").alias("bucket"))
    buckets = (
        posted.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.min("class_id").alias("lo"), F.max("class_id").alias("hi"),
             F.sum(F.xxhash64("class_id").cast("decimal(38,0)")).alias("mark"))
        .where("lo < hi")
        .groupBy("n", "lo", "hi", "mark")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", "n")
    )
    members = stored(
        posted.join(buckets, "bucket")
        .join(unique.select("class_id", "n_shingles", "sig"), "class_id")
        .select("bucket", "n", "class_id", "n_shingles", "sig")
    )
    # the ids grow with the corpus: a merge join at every size, never a broadcast
    wanted = members.select(F.col("class_id").alias("doc_id")).distinct().hint("merge")
    sets = stored(_set_rows(docs.join(wanted, "doc_id", "left_semi"), width))
    share, chance = 0.01 * threshold, 1 / (1 << BITS)
    equal = share + (1 - share) * chance
    cut = share - ERRORS * (equal * (1 - equal) / MINIMA) ** 0.5 / (1 - chance)
    blocks = F.ceil(F.col("n") / BLOCK)
    block = F.pmod(F.xxhash64("class_id", "bucket"), blocks)

    near = members.select(
        F.xxhash64("bucket", block).alias("slot"), F.lit(2).alias("side"), "class_id", F.col("class_id").alias("label"), "n_shingles", "sig"
    )
    likely = stored(_candidates(near, cut, threshold, spread=False))
    labels = stored(components(_checked(likely, sets, threshold)))
    told = members.join(labels, members.class_id == labels.node, "left").withColumn("label", F.coalesce("component", "class_id"))
    differ = told.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("greatest")).where("least < greatest")
    differ = stored(differ.select("bucket"))  # so that a bucket of many members can be split over tasks
    at = told.drop("node", "component").join(differ, "bucket").withColumn("own", block)
    # each member meets every block once: as the lower or the upper side of the pair
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    at = at.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    at = at.withColumn("side", F.when(F.col("i") == F.col("j"), 2).otherwise((F.col("own") == F.col("j")).cast("int")))
    at = at.select(F.xxhash64("bucket", "i", "j").alias("slot"), "side", "class_id", "label", "n_shingles", "sig")
    pairs = stored(_candidates(at, cut, threshold, spread=True))
    marked = sets.withColumnRenamed("doc_id", "class_id").join(unique.select("class_id", "sig"), "class_id").join(labels, F.col("class_id") == labels.node, "left")
    marked = marked.select("class_id", F.coalesce("component", "class_id").alias("label"), "items", "sig")
    wanted = pairs.select(F.col("a").alias("label")).union(pairs.select("b")).distinct()
    labelled = stored(marked.join(wanted, "label", "left_semi"))
    linked, blocks = _joined(pairs, labelled, cut, threshold)
    last = components(linked).select(F.col("node").alias("component"), F.col("component").alias("final"))
    dropped(members, sets, likely, differ, pairs, labelled, blocks)
    out = rows.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    out = out.join(labels, out.class_id == labels.node, "left")
    out = out.withColumn("component", F.coalesce("component", "class_id")).join(last, "component", "left")
    group = F.coalesce("final", "component", "doc_id")
    group = F.when(F.col("doc_id").isNotNull(), group)
    return out.select(
        "doc_id", "n_shingles", group.alias("component_id"),
        F.coalesce(group == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
