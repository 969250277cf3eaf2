"""Repeated runs of words, found by winnowing over grams of words inside and across lines."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinescape.llm.common import arrow_rows, dropped, slices, stored
from kinescape.llm.words import BASE, groups, mixed, word_hashes

_LAST = (1 << 63) - 1
_WORD = re.compile("[^ \t-\r]+")
#: Windows whose least gram is looked for at once, and bits of a place among them.
_SPAN, _BITS = 1 << 22, np.uint64(23)
#: Powers of the base and of its inverse modulo 2^64, as many as the longest group of texts so far had words.
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


class Words:
    """Hashes of runs of words of texts that follow each other, from sums over all beginnings."""

    def __init__(self, texts: list[str | None]):
        own, self.ends = word_hashes(texts, lower=False)
        up, self.down = _grown(len(own) + 1)
        self.sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * up[: len(own)], out=self.sums[1:])

    def runs(self, starts: np.ndarray, sizes) -> np.ndarray:
        """Hash of the ``sizes`` words from each of ``starts``."""
        return mixed((self.sums[starts + sizes] - self.sums[starts]) * self.down[starts])


def _least(values: np.ndarray, wide: int) -> np.ndarray:
    """The least of each ``wide`` neighbours."""
    now, n = values, 1
    while 2 * n <= wide:
        now, n = np.minimum(now[:-n], now[n:]), 2 * n
    return now if n == wide else np.minimum(now[: len(values) - wide + 1], now[wide - n :])


def windows(words: Words, least: int) -> tuple[np.ndarray, ...]:
    """Text, fingerprint, context, first window and number of windows of each chosen gram.

    Each window of ``least`` words chooses the first least of its grams of half as many words.
    The choice depends on the window's words alone, so equal windows have equal fingerprints.
    The context is a hash of all words of the windows that chose the gram, and of its place.
    """
    wide = (least + 1) // 2
    begins = np.concatenate([[0], words.ends[:-1]]).astype(np.int64)
    counts = np.maximum(words.ends - begins - least + 1, 0)
    if not counts.sum():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32))
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(text)) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    total = len(words.sums) - 1
    grams = words.runs(np.arange(total - wide + 1), wide)
    chosen = np.empty(total - least + 1, np.int64)
    for at in range(0, len(chosen), _SPAN):
        own = grams[at : at + _SPAN + least - wide]
        keys = ((own >> _BITS) << _BITS) | np.arange(len(own), dtype=np.uint64)
        found = _least(keys, least - wide + 1) & np.uint64((1 << int(_BITS)) - 1)
        chosen[at : at + len(found)] = found.view(np.int64) + at
    chosen = chosen[start]
    first = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    number = np.diff(first, append=len(chosen))
    at, own = chosen[first], start[first]
    context = words.runs(own, number - 1 + least)
    context = mixed(context + (number * 65_537 + (at - own)).astype(np.uint64) * np.uint64(BASE))
    return (
        text[first], grams[at].view(np.int64), context.view(np.int64), (own - begins[text[first]]).astype(np.int32),
        number.astype(np.int32),
    )


def repeated_windows(df: DataFrame, least_words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of words that stand earlier too: k, mark, runs array<struct<a, n>>.

    k is ``key`` as long (nulls last), mark a digest of the text; the two name a text, and
    order goes by k, mark and word. ``n`` windows of ``least_words`` words follow each other
    from word a; each of them, and no other window, equals an earlier one. Occurrences of a
    gram with one context are settled by the context's hash; where a gram has several
    contexts, the first occurrence of each is compared window by window.
    """
    rows = df.select(_order(key).alias("k"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))

    def cut(batch):
        k, mark = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        at = 0
        for texts in groups(batch.column(2).to_pylist()):
            text, h, c, a, n = windows(Words(texts), least_words)
            yield {"k": k[at + text], "mark": mark[at + text], "h": h, "c": c, "a": a, "n": n}
            at += len(texts)

    posted = stored(arrow_rows(rows, "k long, mark long, h long, c long, a int, n int", cut))
    # written before they are joined, so that a gram of many places can be split over tasks
    often = stored(posted.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"))
    again = stored(posted.join(often, "h", "left_semi"))
    place = F.struct("k", "mark", "a")
    contexts = stored(
        again.groupBy("h", "c").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("n").alias("n"))
    )
    whole = (
        again.join(contexts.where("first < last").select("h", "c", "first"), ["h", "c"])
        .where(place > F.col("first")).select("k", "mark", "a", "n")
    )
    several = stored(contexts.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"))
    asked = (
        contexts.join(several, "h", "left_semi").select("first.*", "n", "h")
        .groupBy("k", "mark").agg(F.collect_list(F.struct("a", "n", "h")).alias("asked"))
    )

    def spell(batch):
        for part in slices(batch):
            out = [[] for _ in range(5)]
            for k, mark, s, asked in zip(*(c.to_pylist() for c in part.columns), strict=True):
                starts = np.concatenate([np.arange(x["a"], x["a"] + x["n"]) for x in asked])
                grams = np.repeat([x["h"] for x in asked], [x["n"] for x in asked])
                spelled = Words([s]).runs(starts, least_words).view(np.int64)
                for column, values in zip(out, (np.full(len(starts), k), np.full(len(starts), mark), grams, spelled, starts), strict=True):
                    column.append(values)
            yield dict(zip(("k", "mark", "h", "w", "a"), map(np.concatenate, out), strict=True))

    texts = rows.join(asked, ["k", "mark"]).select("k", "mark", "text", "asked")
    spelled = stored(arrow_rows(texts, "k long, mark long, h long, w long, a int", spell))
    dropped(posted, often, several)
    firsts = stored(spelled.groupBy("h", "w").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last"))
    single = (
        spelled.join(firsts.select("h", "w", "first"), ["h", "w"]).where(place > F.col("first"))
        .select("k", "mark", "a", F.lit(1).alias("n"))
    )
    return whole.union(single).groupBy("k", "mark").agg(F.collect_set(F.struct("a", "n")).alias("runs"))


def _order(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(_LAST))


def without(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """``text`` without the words of ``runs`` (first word, end), and the number of lines that go.

    A line that loses all its words goes, with empty lines inside a run; of other lines the
    kept words stay as they are, with the space before the first and after the last word.
    """
    lines = text.split("\n")
    spans = [[m.span() for m in _WORD.finditer(line)] for line in lines]
    total = sum(map(len, spans))
    edges = np.zeros(total + 1, np.int64)
    inner = np.zeros(total + 2, np.int64)  # places between two words of one run
    for a, b in runs:
        edges[a] += 1
        edges[b] -= 1
        inner[a + 1] += 1
        inner[b] -= 1
    gone, inside = np.cumsum(edges) > 0, np.cumsum(inner) > 0
    out, at, lost = [], 0, 0
    for line, own in zip(lines, spans, strict=True):
        drop = gone[at : at + len(own)]
        if inside[at] if not own else drop.all():
            lost += 1
        elif not own or not drop.any():
            out.append(line)
        else:
            kept = np.flatnonzero(~drop)
            parts = [line[: own[0][0]]]
            for n, i in enumerate(kept):
                if n:
                    # words that were neighbours keep what stood between them
                    before = kept[n - 1]
                    parts.append(line[own[before][1] : own[i][0]] if i == before + 1 else " ")
                parts.append(line[own[i][0] : own[i][1]])
            out.append("".join([*parts, line[own[-1][1] :]]))
        at += len(own)
    return "\n".join(out), lost


def drop_repeated(df: DataFrame, least_words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without later repeats: ``text`` loses them; n_lines and n_dropped (long) are added.

    Every run of at least ``least_words`` words that stands earlier (by ``key``, then place;
    also in the same text) is deleted, wherever in a line it begins or ends; its first
    occurrence stays, and so does every word outside such runs. Of words that repeat with a
    period, so that a run overlaps its earlier occurrence, one period stays. Words are parted by blanks
    and the characters 9 to 13, line ends among them. Lines left without words go and are counted in n_dropped, with
    empty lines inside a run. A null text stays null with no
    lines; rows equal in key and text are one text and all keep what it keeps. Rows of a null
    key come after all others. Columns named n_lines or n_dropped are replaced.
    """
    df = df.drop("n_lines", "n_dropped")
    names = [*df.columns]
    kinds = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    runs = repeated_windows(df, least_words, key, text)
    runs = runs.select(F.col("k").alias("__k"), F.col("mark").alias("__m"), F.col("runs").alias("__runs"))
    placed = df.withColumn("__order", _order(key)).withColumn("__mark", F.xxhash64(text))
    joined = placed.join(runs, (F.col("__order") == F.col("__k")) & (F.col("__mark") == F.col("__m")), "left")
    joined = joined.select(*(F.col(f"`{c}`") for c in names), "__runs")

    def clean(batch):
        for part in slices(batch):
            texts, totals, gone = [], [], []
            for s, held in zip(
                part.column(names.index(text)).to_pylist(), part.column(len(names)).to_pylist(), strict=True
            ):
                lost = 0
                totals.append(0 if s is None else s.count("\n") + 1)
                if held:
                    s, lost = without(s, [(x["a"], x["a"] + x["n"] - 1 + least_words) for x in held])
                texts.append(s)
                gone.append(lost)
            out = {c: part.column(i) for i, c in enumerate(names)}
            yield out | {text: texts, "n_lines": totals, "n_dropped": gone}

    return arrow_rows(joined, f"{kinds}, n_lines long, n_dropped long", clean)
