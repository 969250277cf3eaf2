"""Near-duplicate vectors by permutations: ordered nearest reference points, inverted lists, shared counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinescape.llm.common import _arrow_schema, arrow_rows, components, dropped, mapped, slices, stored
from kinescape.llm.minhash import _runs

#: Members of a list that are compared in one group.
BLOCK = 1024


def usable(values) -> np.ndarray | None:
    """The vector in double precision, or None if it is null, empty, zero or not finite throughout."""
    if values is None:
        return None
    row = np.asarray([np.nan if v is None else v for v in values], np.float64)
    return row if len(row) and np.isfinite(row).all() and row.any() else None


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _apart(rows: np.ndarray, most: float = 0.7) -> np.ndarray:
    """Rows of a cosine of at most ``most`` to every row kept before.

    Points inside one dense group would order its members at random.
    """
    kept: list[int] = []
    for i in range(len(rows)):
        if not kept or (rows[kept] @ rows[i]).max() <= most:
            kept.append(i)
    return rows[kept]


def near_vectors(
    df: DataFrame,
    threshold: float = 0.98,
    nearest: int = 6,
    shared: int = 2,
    most_pivots: int = 4096,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Links between vectors of one label: vec_id, n_links, component_id, kept, a row per row.

    Two vectors of equal, non-null labels and equal length link if the cosine in double
    precision is at least ``threshold``. Null or zero vectors and such with null or non-finite
    components link with nothing, nor do rows of a null key (component null, kept). n_links
    counts the other rows linked with a row; copies of one vector are rows like others. Rows of
    one key are one node: components of their vectors join. Other columns are not read.

    Reference points are a sample of distinct vectors by hash order, four times the root of
    their number, from 64 to ``most_pivots``, less those close to another. Every vector is
    described by the permutation of its ``nearest`` points, in order of distance, and posted to
    the inverted list of each. In a list, permutations are compared first: a pair is retrieved
    if at least ``shared`` points stand among both and the depths at which they meet add up to
    more than that (how many points the first 1, 2, ... of both share, summed). Retrieved pairs
    are verified by their cosines. A pair that meets in several lists counts in that of its
    least point. Lists are compared in blocks of 1024 members by matrix products, and give
    counts and a forest of links, never pairs. Equal vectors are one class with a count.
    """
    kind = dict(df.dtypes)[vector]
    width = "<f8" if "double" in kind else "<f4"
    schema = "vec_id long, label string, mark binary, raw binary"

    def digest(batch):
        for part in slices(batch, 2048):
            marks, raws = [], []
            for name, values in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                row = usable(values) if name is not None else None
                raw = None if row is None else (row + 0.0).astype(width).tobytes()
                raws.append(raw)
                marks.append(None if raw is None else xxhash.xxh128_digest(raw + name.encode()))
            yield {"vec_id": part.column(0), "label": part.column(1), "mark": marks, "raw": raws}

    source = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), vector)
    rows = stored(arrow_rows(source, schema, digest))
    known = rows.where("vec_id IS NOT NULL AND mark IS NOT NULL")
    # rows of one mark have one vector and label
    unique = stored(
        known.groupBy("mark").agg(
            F.min("vec_id").alias("class_id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("label", "raw"))
        )
    )
    pivots = min(most_pivots, max(64, int(4 * unique.count() ** 0.5)))
    drawn = unique.select("raw", F.xxhash64("mark").alias("h")).orderBy("h", "raw").limit(pivots).collect()
    points: dict[int, np.ndarray] = {}
    for size in {len(r.raw) for r in drawn}:
        held = np.stack([np.frombuffer(r.raw, width) for r in drawn if len(r.raw) == size]).astype(np.float64)
        points[size] = _apart(unit(held))

    def post(batch):
        for part in slices(batch, 1024):
            raws, at, slot, orders = part.column(2).to_pylist(), [], [], []
            for size in {len(r) for r in raws}:
                where = [i for i, r in enumerate(raws) if len(r) == size]
                vectors = unit(np.stack([np.frombuffer(raws[i], width) for i in where]).astype(np.float64))
                # a length without reference points has one list
                dots = vectors @ points[size].T if size in points else np.zeros((len(where), 1))
                order = np.argsort(-dots, axis=1, kind="stable")[:, :nearest].astype("<u2")
                for i, o in zip(where, order, strict=True):
                    at += [i] * len(o)
                    slot += [size << 20 | p for p in o.tolist()]
                    orders += [o.tobytes()] * len(o)
            take = pa.array(at, pa.int64())
            yield {n: part.column(i).take(take) for i, n in enumerate(("mark", "copies", "raw", "label", "class_id"))} | {
                "slot": slot, "orders": orders
            }

    posted = stored(
        arrow_rows(
            unique.select("mark", "copies", "raw", "label", "class_id"),
            "mark binary, class_id long, copies long, raw binary, label string, slot long, orders binary", post,
        )
    )
    sizes = stored(posted.groupBy("label", "slot").agg(F.count("*").alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = posted.join(sizes, ["label", "slot"]).withColumn("own", F.pmod(F.xxhash64("mark"), blocks))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    # 2: a block with itself; else the side of two different blocks
    dealt = dealt.withColumn("side", F.when(F.col("i") == F.col("j"), 2).otherwise((F.col("own") == F.col("j")).cast("int")))
    dealt = dealt.withColumn("pivot", F.expr("slot & 1048575")).withColumn("slot", F.xxhash64("label", "slot", "i", "j"))
    found = stored(_linked(dealt.select("slot", "pivot", "side", "mark", "class_id", "copies", "raw", "orders"), threshold, shared, width))
    dropped(posted, sizes)
    links = found.groupBy("mark").agg(F.sum("n").alias("near"))
    # vectors of one key are one node
    twice = known.groupBy("vec_id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select("vec_id")
    same = known.join(twice, "vec_id").join(unique.select("mark", "class_id"), "mark").select(F.col("vec_id").alias("a"), F.col("class_id").alias("b"))
    nodes = components(found.select("a", "b").union(same).where("a <> b"))
    out = rows.select("vec_id", "mark").join(unique.select("mark", "class_id", "copies"), "mark", "left").join(links, "mark", "left")
    out = out.join(nodes, out.class_id == nodes.node, "left")
    group = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "class_id", "vec_id"))
    many = F.when(F.col("vec_id").isNotNull(), F.coalesce("near", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1)
    return out.select(
        "vec_id", F.coalesce(many, F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"),
        F.coalesce(group == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def meetings(orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each two permutations (rows of points) the points shared, and the sum of those shared at each depth."""
    names, at = np.unique(orders, return_inverse=True)
    held = np.zeros((len(orders), len(names)), np.float32)
    depth = np.zeros((len(orders), len(orders)), np.float32)
    rows = np.arange(len(orders))
    for d in range(orders.shape[1]):
        held[rows, at.reshape(orders.shape)[:, d]] = 1
        count = held @ held.T
        depth += count
    return count, depth


def _linked(members: DataFrame, threshold: float, shared: int, width: str) -> DataFrame:
    """For each member of a group with links: its mark, a (its class), b (a linked class towards the least), n (links here)."""
    schema = "mark binary, a long, b long, n long"
    target = _arrow_schema(members.sparkSession, schema)

    def group(ids, copies, vectors, orders, pivot, cut):
        least = min(shared, orders.shape[1])
        count, depth = meetings(orders)
        near = np.triu((count >= least) & (depth > least - (orders.shape[1] <= least)), 1)
        if cut:
            near[:cut, :cut] = near[cut:, cut:] = False
        some = np.flatnonzero(near.any(axis=0) | near.any(axis=1))
        dots = vectors[some] @ vectors[some].T
        x, y = np.nonzero(near[np.ix_(some, some)] & (dots >= threshold))
        x, y = some[x], some[y]
        if len(x):
            # the list of the least point in which both stand counts the pair
            both = (orders[x][:, :, None] == orders[y][:, None, :]).any(axis=2)
            first = np.where(both, orders[x], 1 << 30).min(axis=1) == pivot
            x, y = x[first], y[first]
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, x, copies[y])
        np.add.at(total, y, copies[x])
        root = np.arange(len(ids))
        while len(x):
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            root = root[root]
            if (before == root).all() and (root[x] == root[y]).all():
                break
        keep = np.flatnonzero(total)
        return keep, ids[keep], ids[root[keep]], total[keep]

    def run(batches):
        for table in _runs(batches, "slot"):
            slot, side = table.column("slot").to_numpy(), table.column("side").to_numpy()
            ids, copies = table.column("class_id").to_numpy(), table.column("copies").to_numpy()
            pivots, marks = table.column("pivot").to_numpy(), table.column("mark").combine_chunks()
            raws, orders = table.column("raw").to_pylist(), table.column("orders").to_pylist()
            firsts = np.concatenate([[0], np.flatnonzero(slot[1:] != slot[:-1]) + 1, [len(slot)]])
            for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                if hi - lo < 2 or side[lo] != 2 and side[lo] == side[hi - 1]:
                    continue  # nobody to meet
                cut = int(np.searchsorted(side[lo:hi], 1)) if side[lo] == 0 else 0
                vectors = unit(np.stack([np.frombuffer(r, width) for r in raws[lo:hi]]).astype(np.float64))
                held = np.stack([np.frombuffer(o, "<u2") for o in orders[lo:hi]]).astype(np.int64)
                at, a, b, n = group(ids[lo:hi], copies[lo:hi], vectors, held, int(pivots[lo]), cut)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(marks.take(pa.array(at + lo)), pa.binary()), *(pa.array(c, pa.int64()) for c in (a, b, n))], schema=target
                    )

    return mapped(members.repartition("slot").sortWithinPartitions("slot", "side", "class_id"), run, schema)
