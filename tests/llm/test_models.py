import collections
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from kinescape.llm import attention, langid  # noqa: E402
from kinescape.llm.common import crc_mod  # noqa: E402
from kinescape.llm.lm_score import score  # noqa: E402
from kinescape.llm.pieces import encoder  # noqa: E402
from kinescape.llm.words import words_of  # noqa: E402
from tests.llm.conftest import EDGES  # noqa: E402

DOCS = "/root/testdata/sf0.001/documents.parquet"
RANKS = P.path("byte_bpe_50k.tiktoken")
needs_data = pytest.mark.skipif(not os.path.exists(DOCS), reason="no test tables here")


@needs_data
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    part = crc_mod(F.col("doc_id"), 4)
    told = langid.predict(docs, langid.fit(docs, part != 2)).join(docs.select("doc_id", "lang"), "doc_id").where(part == 2)
    good, total = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert total > 20 and good >= 0.97


def test_kernel_counts_common_grams():
    a, b = "abcab", "bcx"
    sets = [{s.encode()[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} for s in (a, b)]
    assert [len(langid.grams(s)) for s in (a, b)] == [len(x) for x in sets]
    assert len(np.intersect1d(langid.grams(a), langid.grams(b))) == len(sets[0] & sets[1])


def test_language_of_edges(spark, edges, nothing):
    model = langid.fit(edges, F.lit(True))
    got = langid.predict(edges, model, carry=True).collect()
    assert len(got) == len(EDGES)
    for r in got:
        want = "en" if r.text and any(map(str.isalpha, r.text)) else "und"
        assert r.lang_pred == want and 0 <= r.score <= 1
    none = langid.fit(nothing, F.lit(True))
    assert {r.lang_pred for r in langid.predict(edges, none).collect()} == {"und"}
    assert langid.predict(nothing, model).count() == 0


def test_ids_of_words_equal_those_of_each_alone():
    import tiktoken

    codes = encoder(RANKS, P.PATTERN)
    ranks = {codes.decode(np.array([i])): i for i in range(codes.size)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["plain", "don't,", "\u00a0odd", "a\x1cb", "\u00e9\u00df", "x" * 500, "12.5", "\U0001f600!", "\x85", "end\u3000", "\0n"]
    ids, sizes = codes.words(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [plain.encode_ordinary(" " + w) for w in words]


def small(seed=0, size=100):
    draw = np.random.default_rng(seed)
    firsts, follows, lasts = draw.integers(0, 50, size + 1), draw.integers(0, 50, size + 1), draw.integers(0, 50, size)
    pairs = draw.integers(0, 3, (size, size + 1)) * 4
    return attention.Vocabulary.made(
        firsts, follows, np.concatenate([pairs, pairs.sum(axis=1, keepdims=True) + 5], axis=1), draw.random((60, 8)), lasts
    ), draw


def stream_of(draw, sizes, words):
    steps = [-(-(n + 1) // attention.STEP) for n in sizes]
    total = sum(steps) * attention.STEP
    head, tail = (draw.integers(0, 200, total).astype(np.int32) for _ in range(2))
    wanted, begins, at = np.full(total, -1, np.int32), np.zeros(sum(steps), bool), 0
    for n, k in zip(sizes, steps, strict=True):
        wanted[at : at + n + 1] = draw.integers(0, attention.CLASSES, n + 1)
        begins[at // attention.STEP] = True
        at += k * attention.STEP
    return attention.Stream(head, tail, wanted, begins)


def test_scoring_equals_the_forward_pass_and_short_blocks():
    words, draw = small(4)
    p, s = attention.fresh(), None
    p["place"] += draw.normal(0, 1, p["place"].shape).astype(np.float32)
    s = stream_of(draw, [0, 3, 7, 8, 40, 25], words)
    f = attention.forward(p, *s.windows(np.arange(len(s.begins))))
    z = f["z"] - np.log(f["e"].sum(axis=1, keepdims=True))
    want = np.where(s.wanted >= 0, z[np.arange(len(z)), s.wanted], 0) * np.log10(np.e)
    for steps in (1024, 1, 3):
        assert attention.Scorer(p).log10(s, steps) == pytest.approx(want, abs=1e-4)


def test_probabilities_sum_to_one():
    words, draw = small()
    share = np.bincount(words.group, weights=10.0 ** words.inner.astype(float), minlength=attention.CLASSES)
    assert share[np.unique(words.group)] == pytest.approx(1, abs=1e-4)
    # a word of one id before each id or the word's end: all that can follow it
    for one in (0, 17, 99):
        ends = words.tails(np.array([one]), np.array([1]))[0]
        pairs = words.tails(np.array([[one, i] for i in range(100)]).ravel(), np.full(100, 2))
        last = words.tails(np.arange(100), np.ones(100, int))
        assert 10**ends + (10.0 ** (pairs - last)).sum() == pytest.approx(1, abs=1e-3)


def test_classes_sum_to_one():
    words, draw = small()
    s = stream_of(draw, [30, 5], words)
    total = np.zeros(len(s.wanted))
    for c in range(attention.CLASSES):
        s.wanted[:] = c
        total += 10.0 ** attention.Scorer(attention.fresh()).log10(s).astype(float)
    assert total == pytest.approx(1, abs=1e-4)


def test_later_words_and_other_texts_change_nothing_before():
    words, draw = small()
    scorer = attention.Scorer(attention.fresh())
    s = stream_of(draw, [60, 20], words)
    base = scorer.log10(s)
    other = attention.Stream(s.head.copy(), s.tail.copy(), s.wanted, s.begins)
    other.head[40], other.tail[40] = 3, 4
    again = scorer.log10(other)
    assert base[:40] == pytest.approx(again[:40], abs=1e-6) and base[64:] == pytest.approx(again[64:], abs=1e-6)
    assert np.abs(base[40:48] - again[40:48]).max() > 1e-4


def test_gradients_match_differences():
    words, draw = small(1)
    p = {k: v.astype(np.float64) for k, v in attention.fresh().items()}
    s = stream_of(draw, [20, 4], words)
    steps = np.arange(len(s.begins))
    head, tail, first = s.windows(steps)
    _, g = attention.gradients(p, head, tail, first, s.wanted)
    for name in p:
        at = (int(head[1, 9]), 2) if name == "head" else (int(tail[1, 9]), 2) if name == "tail" else tuple(n // 2 for n in p[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        slope = (attention.gradients(up, head, tail, first, s.wanted)[0] - attention.gradients(down, head, tail, first, s.wanted)[0]) / 2e-4
        assert g[name][at] == pytest.approx(slope, rel=2e-2, abs=2e-5), name


def test_training_lowers_the_loss():
    words, draw = small(2)
    s = stream_of(draw, [400], words)
    s.head[:] = np.arange(len(s.head)) % 20
    s.tail[:] = s.head
    s.wanted[:401] = (np.arange(401) + 1) % 20
    before = attention.Scorer(attention.fresh()).log10(s).sum()
    learner = attention.Learner(attention.fresh(), 5e-3)
    for _ in range(30):
        learner.learn(s, batch=16)
    assert learner.places == 30 * 401 and attention.Scorer(learner.p).log10(s).sum() > before + 100


def plain_base(rows):
    words = [((t or "").encode().lower().split() + [b""], i is not None and zlib.crc32(str(i).encode()) % 7 != 2) for i, t in rows]
    counts = collections.Counter(w for ws, learn in words if learn for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted(
        ((i, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), (ws, _) in zip(rows, words, strict=True)),
        key=str,
    )


def test_base_scores_equal_plain_counts(spark, edges):
    got = score(edges.repartition(3), crc_mod(F.col("doc_id"), 7) != 2, RANKS, P.PATTERN).collect()
    assert sorted(((r.key, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == plain_base(EDGES)
    assert all(r.score < 0 for r in got)


def test_scores_without_anything_to_learn_from(spark, nothing):
    assert score(nothing, F.lit(True), RANKS, P.PATTERN).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (row,) = score(docs, F.lit(False), RANKS, P.PATTERN).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_every_learning_text_trains_and_blocks_do_not_change_the_base(spark, edges, monkeypatch):
    from kinescape.llm import lm_score

    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 64)
    monkeypatch.setattr(lm_score, "BUCKET_WORDS", 3)
    got = score(edges.repartition(2), crc_mod(F.col("doc_id"), 7) != 2, RANKS, P.PATTERN).collect()
    assert sorted(((r.key, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == plain_base(EDGES)


def bigram(taught, held):
    """log10 of texts by pairs of subword ids, discounted towards single ids: a plain reference."""
    codes = encoder(RANKS, P.PATTERN)
    spelled = lambda t: " ".join(["", *(w.decode() for w in words_of(t))])
    ids = lambda texts: [[codes.size, *x.tolist(), codes.size] for x in np.split(*(lambda i, n: (i, np.cumsum(n)[:-1]))(*codes.encode([*map(spelled, texts)])))]
    one, two, many = collections.Counter(), collections.Counter(), collections.Counter()
    for x in ids(taught):
        one.update(x[1:])
        two.update(zip(x[:-1], x[1:], strict=True))
    before = collections.Counter()
    for (a, _), n in two.items():
        before[a] += n
        many[a] += 1
    n = sum(one.values()) + codes.size + 1
    total = 0.0
    for x in ids(held):
        for a, b in zip(x[:-1], x[1:], strict=True):
            own = (one[b] + 1) / n
            total += math.log10((max(two[a, b] - 0.75, 0) + 0.75 * many[a] * own) / before[a] if before[a] else own)
    return total


@needs_data
def test_model_beats_a_smoothed_bigram_on_held_out_texts(spark):
    docs = spark.read.parquet(DOCS.replace("0.001", "0.01"))
    got = score(docs, crc_mod(F.col("doc_id"), 7) != 2, RANKS, P.PATTERN)
    told = docs.join(got, docs.doc_id == got.key).withColumn("held", crc_mod(F.col("doc_id"), 7) == 2).toPandas()
    assert told[told.held].score.sum() > bigram(told[~told.held].text, told[told.held].text)


def counted(seed=3, size=6000):
    """Vocabulary and cells where some ids are paired, some own a cell alone, and rare ones share cells."""
    draw = np.random.default_rng(seed)
    counts = np.maximum(draw.zipf(1.3, size + 1) % 1000, 1) * (np.arange(size + 1) < 5000)
    counts[size] = 40
    wide = min(attention.PAIRED, size)
    pairs = draw.integers(0, 3, (wide, wide + 1)) * (draw.random((wide, wide + 1)) < 0.02)
    words = attention.Vocabulary.made(
        counts, counts, np.concatenate([pairs, pairs.sum(axis=1, keepdims=True)], axis=1),
        draw.random((attention.OWN, attention.LEADERS)), counts[:size],
    )
    return words, attention.Cells.made(words, counts), draw


def weights(draw):
    p = attention.fresh()
    return p | {"cells": draw.normal(0, 0.5, p["cells"].shape).astype(np.float32)}


def wanting(words, cells, ids):
    """A stream of one text, as the operator's reader makes it."""
    full = -(-(len(ids) + 1) // attention.STEP) * attention.STEP
    head, tail, wanted, cell, lead = (np.full(full, x, np.int32) for x in (attention.OWN + attention.SHARED,) * 2 + (-1, 0, len(cells.spare) - 1))
    n = len(ids)
    head[1 : n + 1], tail[2 : n + 1], lead[1 : n + 1] = words.row[ids], words.row[ids[:-1]], cells.lead[ids]
    wanted[: n + 1], cell[: n + 1] = words.group[[*ids, words.end]], cells.cell[[*ids, words.end]]
    return attention.Stream(head, tail, wanted, np.arange(full // attention.STEP) == 0, cell, lead)


def test_the_network_gives_every_id_a_probability():
    words, cells, draw = counted()
    assert len(cells.alone) < words.end and (np.diff(cells.cuts) > 0).sum() > 32 and (cells.share < -0.1).any()
    assert words.end == 6000 and (cells.lead == len(cells.spare) - 1).any()
    ids = draw.integers(0, 6000, 40)
    ids[4], ids[32] = np.flatnonzero(words.place[:-1] >= 0)[7], np.flatnonzero(words.place[:-1] < 0)[7]
    s = wanting(words, cells, ids)
    every = attention.Stream(*(np.tile(x, 6001) for x in (s.head, s.tail, s.wanted, s.begins, s.cell, s.lead)))
    scorer = attention.Scorer(weights(draw), cells)
    for place in (0, 5, 33):  # after the start, a paired id, one that is not
        at = np.arange(6001) * len(s.head) + place
        every.wanted[at], every.cell[at] = words.group, cells.cell
        assert (10.0 ** (scorer.log10(every)[at] + cells.share)).sum() == pytest.approx(1, abs=1e-3)


def test_without_trained_weights_the_counts_of_pairs_remain():
    words, cells, draw = counted()
    p = attention.fresh() | {"out": np.zeros((attention.HIDDEN, attention.CLASSES), np.float32)}
    one, two = np.flatnonzero(words.place[:-1] >= 0)[3:5]
    got = attention.Scorer(p, cells).log10(wanting(words, cells, np.array([one, two])))
    total = 10 ** words.pairs[words.place[one]].astype(float)
    rest = 10 ** float(words.spare[words.place[one]]) * (10 ** words.follow[words.place < 0].astype(float)).sum()
    assert got[1] == pytest.approx(np.log10(total[words.place[two]] / (total.sum() + rest)), abs=1e-3)


def test_gradients_of_cells_match_differences():
    words, cells, draw = counted(5)
    p = {k: v.astype(np.float64) for k, v in weights(draw).items()}
    s = wanting(words, cells, draw.integers(0, 5200, 150))
    seen, own, wanted = s.runs(np.array([0, attention.RUN]))
    assert (wanted >= 0).sum() == 151  # each place once, none past the stream's end
    run = lambda q: attention.gradients(q, *seen, wanted, cells, s.cell[own], s.lead[own])
    g = run(p)[1]
    for name in p:
        at = np.unravel_index(np.abs(g[name]).argmax(), p[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert g[name][at] == pytest.approx((run(up)[0] - run(down)[0]) / 2e-4, rel=2e-2, abs=2e-5), name


@pytest.mark.parametrize("piece", [1, 2, 1 << 18])
def test_pairs_of_ids_equal_plain_counts(monkeypatch, piece):
    from kinescape.llm import lm_score

    monkeypatch.setattr(lm_score, "PIECE_WORDS", piece)
    codes = encoder(RANKS, P.PATTERN)
    texts = [t for _, t in EDGES] + ["Alpha qzxvomega don't, alpha", "one", ""]
    learn = [i % 3 != 1 for i in range(len(texts))]
    row = lm_score._block_row(0, list(range(len(texts))), learn, texts, codes)
    got = collections.Counter()
    for one, two, times in lm_score._followed(row, codes.size):
        for a, b, n in zip(one.tolist(), two.tolist(), [1] * len(one) if times is None else times.tolist(), strict=True):
            got[a, b] += n
    want = collections.Counter()
    for text, taught in zip(texts, learn, strict=True):
        ids = [x for w in words_of(text) for x in codes.words([w.decode()])[0].tolist()] + [codes.size]
        if taught:
            want.update(zip(ids[:-1], ids[1:], strict=True))
    assert +got == want


def test_words_before_change_the_ids_inside_words(spark):
    # both words begin with the same ids; which one follows is told by the word before
    rows = [(i, " ".join(["left qzxvalpha", "right qzxvomega"][(i + j) % 2] for j in range(40))) for i in range(1, 400)]
    asked = [(1000, "left qzxvalpha"), (1001, "right qzxvomega"), (1002, "left qzxvomega"), (1003, "right qzxvalpha")]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string").coalesce(1)
    got = {r.key: r.score for r in score(docs, F.col("doc_id") < 1000, RANKS, P.PATTERN).collect()}
    assert got[1000] + got[1001] > got[1002] + got[1003] + 0.3


@needs_data
def test_attention_adds_to_the_counts_on_held_out_texts(spark):
    docs = spark.read.parquet(DOCS.replace("0.001", "0.01"))
    got = score(docs, crc_mod(F.col("doc_id"), 7) != 2, RANKS, P.PATTERN)
    told = docs.join(got, docs.doc_id == got.key).withColumn("held", crc_mod(F.col("doc_id"), 7) == 2).toPandas()
    assert told[told.held].score.sum() > 0.98 * bigram(told[~told.held].text, told[told.held].text)


def test_ids_that_precede_the_same_do_not_all_share_a_class():
    # a place costs as many scores as its class has cells
    draw = np.random.default_rng(8)
    counts = np.sort(draw.zipf(1.2, 6000) % 100_000 + 1)[::-1]
    after = np.ones((attention.OWN, attention.LEADERS))
    after[::3] += draw.random((len(after[::3]), attention.LEADERS))
    group = attention._grouped(counts, after)
    sizes = np.bincount(group[: attention.OWN], minlength=attention.CLASSES)
    assert sizes[-attention.RARE :].sum() == 0 and (sizes > 0).sum() > attention.CLASSES // 2
    assert (counts[: attention.OWN] * sizes[group[: attention.OWN]]).sum() < attention.OWN / 64 * counts[: attention.OWN].sum()
    paired = np.bincount(group[: attention.PAIRED], minlength=attention.CLASSES)
    assert ((paired == 0) | (paired == sizes)).all()


def test_steps_of_rows_that_a_batch_does_not_see_equal_plain_steps():
    words, cells, draw = counted(7)
    s = wanting(words, cells, draw.integers(0, 5200, 900))
    p = weights(draw)
    learner = attention.Learner(p, 4e-3, cells)
    learner.learn(s, batch=16)
    q, starts = {k: v.astype(np.float64) for k, v in p.items()}, np.arange(0, len(s.begins), attention.RUN)
    one, two = ({k: np.zeros_like(v) for k, v in q.items()} for _ in range(2))
    starts = np.random.default_rng(len(s.begins)).permutation(starts)
    for t, at in enumerate(range(0, len(starts), 2), 1):
        seen, own, wanted = s.runs(starts[at : at + 2])
        for k, d in attention.gradients(q, *seen, wanted, cells, s.cell[own], s.lead[own])[1].items():
            fast = k in ("head", "tail", "cells")
            one[k] = d if fast else 0.9 * one[k] + 0.1 * d
            two[k] = 0.99 * two[k] + 0.01 * d * d
            q[k] -= 4e-3 * one[k] / (1 if fast else 1 - 0.9**t) / (np.sqrt(two[k] / (1 - 0.99**t)) + 1e-8)
    assert learner.t == t > 3
    for k in q:
        assert np.median(np.abs(learner.p[k] - q[k])) < 1e-5 and np.mean(np.abs(learner.p[k] - q[k]) > 1e-3) < 0.01, k
