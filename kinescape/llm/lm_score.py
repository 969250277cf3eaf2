"""Language-model scores of texts: word counts of the whole corpus, and self-attention over subword ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinescape.llm import attention
from kinescape.llm.attention import STEP
from kinescape.llm.common import _arrow_schema, dropped, mapped, stored
from kinescape.llm.pieces import encoder
from kinescape.llm.words import joined, span_hashes, spans

#: Bytes of text after which a block of documents ends, words of a block handled at once, words a bucket.
BLOCK_BYTES, PIECE_WORDS, BUCKET_WORDS = 1 << 24, 1 << 18, 1 << 19
#: Cells of a summed table in one row.
CELLS = 1 << 16


def _packed(numbers: np.ndarray, kind: str) -> bytes:
    """Numbers as bytes of equal place together, compressed."""
    raw = np.ascontiguousarray(numbers.astype(kind))
    return zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes())


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _block_row(number: int, keys: list, learn: list, texts: list[str | None], codes) -> dict:
    """Documents as indexes into the block's distinct words, most frequent first; index 0 is a text's end.

    Within a block words are told apart by 64 bits, over the corpus by 128.
    """
    raw, cuts = joined(texts)
    starts, stops = spans(raw)
    ends = np.concatenate([[0], np.searchsorted(starts, cuts)])
    own, first, at = np.unique(span_hashes(raw, starts, stops), return_index=True, return_inverse=True)
    times = np.bincount(at, minlength=len(first))
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    flat = rank[at]
    del at
    taught = np.repeat(learn, np.diff(ends)) if len(flat) else np.zeros(0, bool)
    counts = np.bincount(flat[taught], minlength=len(order) + 1)
    first = first[order]
    words = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
    second = span_hashes(raw, starts[first], stops[first], 1)
    ids, sizes = codes.words(words)
    return {
        "block": number, "keys": keys, "learn": np.array(learn, bool).tobytes(), "ends": _packed(ends, "<i8"),
        "flat": _packed(flat, "<i4"), "counts": _packed(counts, "<i4"), "ids": _packed(ids, "<i4"),
        "sizes": _packed(np.append(0, sizes), "<i4"), "hashes": np.stack([own[order], second]).tobytes(),
        "n_words": len(first), "n_learn": int(sum(learn)),
    }


_BLOCK = (
    "block long, keys array<long>, learn binary, ends binary, flat binary, counts binary, ids binary, sizes binary, "
    "hashes binary, n_words long, n_learn long"
)


def _blocks(df: DataFrame, path: str, pattern: str) -> DataFrame:
    target = _arrow_schema(df.sparkSession, _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, number = encoder(path, pattern), TaskContext.get().partitionId() << 32
        keys, learn, texts, held = [], [], [], 0

        def done() -> pa.RecordBatch:
            row = _block_row(number, keys, learn, texts, codes)
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in target], schema=target)

        for batch in batches:
            for k, known, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys.append(k)
                learn.append(known)
                texts.append(text)
                held += len(text or "") + 16
                if held >= BLOCK_BYTES:
                    yield done()
                    number, keys, learn, texts, held = number + 1, [], [], [], 0
        if keys:
            yield done()

    return mapped(df, run, _BLOCK)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of the batches one by one; binaries are not copied until they are asked for."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _posted(blocks: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, one row with the packed distinct words of a block whose hashes begin alike."""
    schema = "bucket int, block long, words binary, places binary, counts binary"
    target = _arrow_schema(blocks.sparkSession, schema)
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches):
        for r in _rows(batches):
            one, two = np.frombuffer(r["hashes"], np.uint64).reshape(2, -1)
            counts = _unpacked(r["counts"], "<i4")[1:]
            order = np.argsort(one, kind="stable")
            bucket = (one[order] >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(one), np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = order[a:b]
                words = np.stack([one[part], two[part]]).tobytes()
                out.append((int(bucket[a]), r["block"], words, _packed(part + 1, "<i4"), _packed(counts[part], "<i4")))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target
                )

    return mapped(blocks.select("block", "hashes", "counts"), run, schema)


def _totals(posted: DataFrame) -> DataFrame:
    """Of each block and bucket the words' places and their counts in the whole corpus; of each bucket,
    in a row without a block, the number of its words that count and the sum of their counts."""
    schema = "block long, places binary, totals binary, words long, tokens long"
    target = _arrow_schema(posted.sparkSession, schema)

    def total(rows: list[dict]) -> pa.RecordBatch:
        one, two = np.concatenate([np.frombuffer(r["words"], np.uint64).reshape(2, -1) for r in rows], axis=1)
        counts = [_unpacked(r["counts"], "<i4") for r in rows]
        n = np.concatenate(counts).astype(np.int64)
        order = np.argsort(one, kind="stable")
        a, b = one[order], two[order]
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
            order = np.lexsort((two, one))
            a, b = one[order], two[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        sums = np.add.reduceat(n[order], first)
        whole = np.empty(len(n), np.int64)
        whole[order] = np.repeat(sums, np.diff(first, append=len(n)))
        parts = np.split(whole, np.cumsum([len(c) for c in counts])[:-1])
        out = [(r["block"], r["places"], _packed(w, "<i8"), 0, 0) for r, w in zip(rows, parts, strict=True)]
        out.append((None, None, None, int((sums > 0).sum()), int(sums.sum())))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    def run(batches):
        held: list[dict] = []
        for r in _rows(batches):
            if held and held[0]["bucket"] != r["bucket"]:
                yield total(held)
                held = []
            held.append(r)
        if held:
            yield total(held)

    return mapped(posted.repartition("bucket").sortWithinPartitions("bucket"), run, schema)


def _summed(df: DataFrame, work: Callable[[Iterator[dict]], np.ndarray | None], size: int, kind: str) -> np.ndarray:
    """Sum over all tasks of the table that ``work`` makes of a task's rows; a row for each piece of a table.

    Pieces are summed in two steps, so none meets all tasks' pieces in one place. The sum is of
    a fixed size whatever the corpus.
    """
    schema = "cell int, salt int, raw binary"
    target = _arrow_schema(df.sparkSession, schema)

    def row(cell: int, salt: int, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((cell, salt, _packed(values, kind)), target, strict=True)], schema=target)

    def made(batches):
        table = work(_rows(batches))
        if table is not None:
            for cell in range(-(-len(table) // CELLS)):
                part = table[cell * CELLS : (cell + 1) * CELLS]
                if part.any():
                    yield row(cell, TaskContext.get().partitionId() % 64, part)

    def added(batches):
        held = None
        for r in _rows(batches):
            values = _unpacked(r["raw"], kind)
            if held is not None and held[:2] == [r["cell"], r["salt"]]:
                held[2] = held[2] + values
                continue
            if held is not None:
                yield row(*held)
            held = [r["cell"], r["salt"], values]
        if held is not None:
            yield row(*held)

    parts = mapped(df, made, schema).repartition("cell", "salt").sortWithinPartitions("cell", "salt")
    parts = mapped(parts, added, schema).withColumn("salt", F.lit(0)).repartition("cell").sortWithinPartitions("cell")
    out = np.zeros(size, kind)
    for r in mapped(parts, added, schema).collect():  # a bounded number of pieces
        out[r.cell * CELLS : (r.cell + 1) * CELLS] = _unpacked(r.raw, kind)
    return out


def _ends_of_words(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a block's words, how many each has, and where each begins."""
    ids, sizes = _unpacked(r["ids"], "<i4"), _unpacked(r["sizes"], "<i4").astype(np.int64)
    return ids, sizes, np.cumsum(sizes) - sizes


def _followed(r: dict, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Each id of the learning texts with the one after it, or the end (``size``), and how often: inside
    words from the words' counts, then from word to word."""
    (ids, sizes, begins), counts = _ends_of_words(r), _unpacked(r["counts"], "<i4")
    inner = np.ones(len(ids), bool)
    inner[begins[sizes > 0]] = False
    after = np.flatnonzero(inner)
    times = np.repeat(counts, sizes)[after]
    yield ids[after - 1], ids[after], times
    if not len(ids):
        return
    ends, flat = _unpacked(r["ends"], "<i8"), _unpacked(r["flat"], "<i4")
    taught = np.repeat(np.frombuffer(r["learn"], bool), np.diff(ends))
    closes = np.zeros(len(flat), bool)
    closes[ends[1:][np.diff(ends) > 0] - 1] = True
    first, last = ids[np.minimum(begins, len(ids) - 1)], ids[np.maximum(begins + sizes - 1, 0)]
    for lo in range(0, len(flat), 4 * PIECE_WORDS):
        own = slice(lo, min(lo + 4 * PIECE_WORDS, len(flat)))
        following = np.full(own.stop - lo, size, np.int64)  # the last word of all closes its text
        some = first[flat[lo + 1 : own.stop + 1]]
        following[: len(some)] = some
        following[closes[own]] = size
        yield last[flat[own]][taught[own]], following[taught[own]], None


def _vocabulary(blocks: DataFrame, size: int) -> tuple[attention.Vocabulary, attention.Cells]:
    """Classes and counts from all learning texts: of ids and ends, and of pairs of them."""

    def singles(rows):
        out = np.zeros(size + 1, np.int64)
        some = False
        for r in rows:
            some = True
            (ids, sizes, _), counts = _ends_of_words(r), _unpacked(r["counts"], "<i4")
            out += np.bincount(ids, weights=np.repeat(counts, sizes), minlength=size + 1).astype(np.int64)
            out[size] += int(np.frombuffer(r["learn"], bool).sum())
        return out if some else None

    counts = _summed(blocks.select("learn", "counts", "ids", "sizes"), singles, size + 1, "<i8")
    place = attention.paired(counts, counts[:size])
    wide = min(attention.PAIRED, size)
    rows_of = attention.ranked(counts, attention.OWN)
    lead = np.where(rows_of < attention.LEADERS, rows_of, -1)
    high, both = min(attention.OWN, size + 1), wide * (wide + 2)

    def pairs(rows):
        out = np.zeros(both + high * attention.LEADERS, np.int64)
        table, after = out[:both], out[both:]
        some = False
        for r in rows:
            some = True
            for one, two, times in _followed(r, size):
                p, q = place[one], place[two]
                a, b = lead[one], rows_of[two]
                for to, at, keep in (
                    (table, p * (wide + 2) + q, (p >= 0) & (q >= 0)), (table, p * (wide + 2) + wide + 1, p >= 0),
                    (after, b * attention.LEADERS + a, (a >= 0) & (b >= 0)),
                ):
                    to += np.bincount(at[keep], weights=None if times is None else times[keep], minlength=len(to)).astype(np.int64, copy=False)
        return out if some else None

    tables = _summed(blocks.select("learn", "ends", "flat", "counts", "ids", "sizes"), pairs, both + high * attention.LEADERS, "<i8")
    words = attention.Vocabulary.made(
        counts, counts, tables[:both].reshape(wide, wide + 2), tables[both:].reshape(high, attention.LEADERS), counts[:size]
    )
    return words, attention.Cells.made(words, counts)


class _Reader:
    """Streams of a block's documents; ``row`` and ``group`` are those of the vocabulary."""

    def __init__(self, r: dict, row: np.ndarray, group: np.ndarray, cells: attention.Cells):
        self.ends, self.flat = _unpacked(r["ends"], "<i8"), _unpacked(r["flat"], "<i4")
        self.ids, self.sizes, self.begins = _ends_of_words(r)
        self.row, self.group, self.cells = row, group, cells
        past = np.concatenate([[0], np.cumsum(self.sizes[self.flat])])
        self.n_ids = np.diff(past[self.ends])

    def shares(self) -> np.ndarray:
        """Of each word the log10 shares of its ids in their cells."""
        past = np.concatenate([[0.0], np.cumsum(self.cells.share[self.ids], dtype=np.float64)])
        return past[self.begins + self.sizes] - past[self.begins]

    def pieces(self, docs: np.ndarray) -> Iterator[np.ndarray]:
        """The given documents in runs of about ``PIECE_WORDS`` ids, a document at least."""
        past = np.cumsum(self.n_ids[docs])
        lo = 0
        while lo < len(docs):
            hi = max(lo + 1, int(np.searchsorted(past, (past[lo - 1] if lo else 0) + PIECE_WORDS, side="right")))
            yield docs[lo:hi]
            lo = hi

    def stream(self, docs: np.ndarray) -> tuple[attention.Stream, np.ndarray, np.ndarray]:
        """Places of the documents: a start and the ids, padded; the words, each document's places."""
        n_words, n = self.ends[docs + 1] - self.ends[docs], self.n_ids[docs]
        within = np.arange(int(n_words.sum())) - np.repeat(np.cumsum(n_words) - n_words, n_words)
        words = self.flat[within + np.repeat(self.ends[docs], n_words)]
        sizes = self.sizes[words]
        ids = self.ids[np.arange(int(n.sum())) + np.repeat(self.begins[words] - (np.cumsum(sizes) - sizes), sizes)]
        full = -(-(n + 1) // STEP) * STEP
        begins = np.cumsum(full) - full
        at = np.arange(len(ids)) + np.repeat(begins - (np.cumsum(n) - n), n)
        start, end = attention.OWN + attention.SHARED, len(self.group) - 1
        head, tail = (np.full(int(full.sum()) + 1, start, np.int32) for _ in range(2))
        head[at + 1] = self.row[ids]
        tail[1:] = head[:-1]
        head, tail = head[:-1], tail[:-1]
        wanted, cell = np.full(len(head), -1, np.int32), np.zeros(len(head), np.int32)
        lead = np.full(len(head) + 1, len(self.cells.spare) - 1, np.int32)
        wanted[at], wanted[begins + n] = self.group[ids], self.group[end]
        cell[at], cell[begins + n] = self.cells.cell[ids], self.cells.cell[end]
        lead[at + 1] = self.cells.lead[ids]
        first = np.zeros(len(head) // STEP, bool)
        first[begins // STEP] = True
        return attention.Stream(head, tail, wanted, first, cell, lead[:-1]), words, full


def trained(blocks: DataFrame, words: attention.Vocabulary, cells: attention.Cells, rounds: int, rate: float) -> dict[str, np.ndarray]:
    """Weights from one pass over every window of the learning texts.

    The documents of each block are dealt over the rounds. In a round each task starts from the
    same weights, learns from its share, and the tasks' changes are averaged by places.
    """
    p, row, group = attention.fresh(), words.row, words.group
    names, size = list(p), sum(v.size for v in p.values())
    columns = blocks.select("learn", "ends", "flat", "ids", "sizes")
    for n in range(rounds):
        start, pace = p, rate / (1 + n)

        def work(rows, start=start, pace=pace, n=n):
            learner = attention.Learner(start, pace, cells)
            for r in rows:
                docs = np.flatnonzero(np.frombuffer(r["learn"], bool))[n::rounds]
                if len(docs):
                    reader = _Reader(r, row, group, cells)
                    for some in reader.pieces(docs):
                        learner.learn(reader.stream(some)[0])
            if not learner.places:
                return None
            change = np.concatenate([(learner.p[k] - start[k]).ravel() for k in names]).astype(np.float64)
            return np.append(change * learner.places, learner.places)

        total = _summed(columns, work, size + 1, "<f8")
        if not total[-1]:
            continue
        at, p = 0, {}
        for k in names:
            p[k] = (start[k] + total[at : at + start[k].size].reshape(start[k].shape) / total[-1]).astype(np.float32)
            at += start[k].size
    return p


_SCORE = "key long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(
    df: DataFrame, learn: Column, path: str, pattern: str, key: str = "doc_id", text: str = "text", rounds: int = 4, rate: float = 4e-3
) -> DataFrame:
    """Scores of every whole text, learned from the rows where ``learn`` holds (null: not).

    Returns key (long), n_tokens, n_known, train_tokens, base_score, score, one row per row.
    Tokens are the words of the text with A-Z in lower case, then one end. base_score sums
    log10((c + 1) / (N + V + 1)) with counts of the whole learning corpus. score is the model's
    log10 probability of the words and the end: a causal self-attention network gives each
    subword id (of the vocabulary file ``path``, each word after a blank) and the end from the
    ids before, by a softmax over classes and one over the ids of a class, to both of which
    counts of pairs add. The rarest ids of a class share cells of that softmax by count. A null or empty text is its end alone; null keys
    and repeated rows are kept; a very long text is a block of its own. With nothing to learn
    from, every token is unknown and the model untrained.

    Documents go into blocks of 16 MB as indexes of distinct words, written once. Word counts
    are one shuffle of the blocks' distinct words by 128-bit hashes, whose sums go back to the
    blocks. Every window of every learning text trains the network once, in ``rounds`` shares.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    blocks = stored(_blocks(rows, path, pattern))
    seen, taught = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_learn"), F.lit(0))).first()
    buckets = 1 << max(0, int(seen // BUCKET_WORDS)).bit_length()
    totals = stored(_totals(_posted(blocks, buckets)))
    distinct, tokens = totals.where("block IS NULL").agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    total = int(tokens) + int(taught)
    bottom = np.log10(float(total + distinct + (taught > 0) + 1))
    size = encoder(path, pattern).size
    words, cells = _vocabulary(blocks, size)
    model, row, group = attention.Scorer(trained(blocks, words, cells, rounds, rate), cells), words.row, words.group
    target = _arrow_schema(df.sparkSession, _SCORE)

    def told(r: dict, known: np.ndarray) -> pa.RecordBatch:
        reader = _Reader(r, row, group, cells)
        ends = reader.ends
        known[0] = taught
        steps = np.log10(known + 1.0)
        n = np.diff(ends)
        out = {k: np.zeros(len(n)) for k in ("base", "seen", "score")}
        shares = reader.shares()
        for docs in reader.pieces(np.arange(len(n))):
            stream, flat, full = reader.stream(docs)
            owner = np.repeat(np.arange(len(docs)), n[docs])
            add = lambda to, w: np.bincount(to, weights=w, minlength=len(docs))
            out["base"][docs] = add(owner, steps[flat]) + steps[0] - (n[docs] + 1) * bottom
            out["seen"][docs] = add(owner, known[flat] > 0) + (known[0] > 0)
            out["score"][docs] = (
                add(np.repeat(np.arange(len(docs)), full), model.log10(stream)) + add(owner, shares[flat]) + float(cells.share[-1])
            )
        columns = (r["keys"], n + 1, out["seen"], np.full(len(n), total), out["base"], out["score"])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else pa.array(c).cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches):
        block, held = None, []
        for r in _rows(batches):
            if r["block"] != block:
                block, held = r["block"], []
            if r["places"] is not None:
                held.append((r["places"], r["totals"]))
                continue
            known = np.zeros(len(_unpacked(r["sizes"], "<i4")), np.int64)
            for places, totals_of in held:
                known[_unpacked(places, "<i4")] = _unpacked(totals_of, "<i8")
            yield told(r, known)

    wide = ("keys", "ends", "flat", "ids", "sizes")
    both = totals.where("block IS NOT NULL").select("block", "places", "totals").unionByName(blocks.select("block", *wide), allowMissingColumns=True)
    both = both.withColumn("last", F.col("places").isNull()).repartition("block").sortWithinPartitions("block", "last").drop("last")
    out = mapped(both, run, _SCORE)
    return out
