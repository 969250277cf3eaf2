import os
import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from kinescape.llm import line_dedup, minhash, pivots  # noqa: E402
from kinescape.llm.common import components  # noqa: E402
from kinescape.llm.words import words_of  # noqa: E402
from tests.llm.conftest import EDGES  # noqa: E402


def joined(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {n: find(n) for n in nodes}


def test_components_match_a_plain_union(spark):
    draw = np.random.default_rng(0)
    links = [tuple(map(int, p)) for p in draw.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)]
    df = spark.createDataFrame([*links, (None, 3), (5, 5)], "a long, b long")
    want = joined({x for p in links for x in p}, links)
    got = {r.node: r.component for r in components(df).collect()}
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: c for n, c in want.items() if n not in alone}
    assert components(df.limit(0)).count() == 0


def plain_sets(rows, width):
    out = {}
    for i, t in rows:
        w = words_of(t)
        n = min(width, len(w))
        out[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    return out


def plain_groups(rows, width):
    sets = plain_sets(rows, width)
    ids = sorted(sets)
    links = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return sets, joined(ids, links)


def near_rows(seed, groups=14, copies=9):
    draw = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"w{g}x{int(k)}" for k in draw.integers(0, 80, int(draw.integers(3, 90)))]
        for c in range(copies):
            text = list(base)
            for _ in range(int(draw.integers(0, max(2, len(base) // 9)))):
                text[int(draw.integers(len(text)))] = f"new{g}-{c}-{int(draw.integers(9))}"
            rows.append((int(draw.integers(0, 10**6)), " ".join(text).upper() if c % 3 else " ".join(text)))
    return list(dict(rows).items())


@pytest.mark.parametrize("width,seed", [(2, 0), (5, 1)])
def test_near_duplicates_match_all_pairs(spark, width, seed):
    rows = near_rows(seed)
    sets, want = plain_groups(rows, width)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_hot_group_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = near_rows(7, groups=2, copies=60)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == plain_groups(rows, 2)[1]


def test_near_duplicates_of_edges(spark, edges, nothing):
    got = minhash.near_duplicates(edges, 2).collect()
    assert len(got) == len(EDGES)
    told = {r.doc_id: (r.component_id, r.kept, r.n_shingles) for r in got}
    assert told[7][:2] == (3, False) and told[1] == (1, True, 0) and told[2] == (2, True, 0) and told[5] == (5, True, 0)
    assert told[None][:2] == (None, True) and told[9] == (9, True, 1)
    assert minhash.near_duplicates(nothing, 2).count() == 0


def test_estimates_follow_similarity():
    draw = np.random.default_rng(3)
    for want in (0.2, 0.5, 0.8, 1.0):
        n = 4000
        shared = int(2 * n * want / (1 + want))
        x = draw.integers(0, 1 << 62, 2 * n, np.uint64)
        p, q = x[:n], np.concatenate([x[:shared], x[n : 2 * n - shared]])
        s, t = (minhash.packed(minhash.minima(v)[None])[0] for v in (p, q))
        assert minhash.likeness(s[None], t)[0] == pytest.approx(want, abs=0.13)


def lines_left(rows, least):
    """Lines with words that are in no run of ``least`` words seen earlier, by a plain search."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = [x for x in t.split("\n") if x.split()]
        key = [tuple(x.split()) for x in lines]
        drop, new = set(), set()
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += len(key[b])
                if total >= least:
                    run = tuple(key[a : b + 1])
                    if run in seen or run in new:
                        drop |= set(range(a, b + 1))
                    new.add(run)
                    break
        seen |= new
        out[i] = [x for n, x in enumerate(lines) if n not in drop]
    return out


def test_repeated_runs_match_a_plain_search(spark):
    draw = np.random.default_rng(5)
    pool = [" ".join(f"p{n}w{k}" for k in range(12)) for n in range(30)]
    rows = []
    for i in range(60):
        lines = [" ".join(f"d{i}l{n}w{k}" for k in range(int(draw.integers(1, 14)))) for n in range(4)]
        start = int(draw.integers(0, 24))
        lines[2:2] = pool[start : start + int(draw.integers(1, 7))]
        if draw.random() < 0.3:
            lines.insert(1, "")
        rows.append((i, "\n".join(lines)))
    got = line_dedup.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string"), 30).collect()
    want = lines_left(rows, 30)
    for r in got:
        left = [x for x in r.text.split("\n") if x.split()]
        # extension both ways may take equal lines around a run that the search leaves
        assert set(left) <= set(want[r.doc_id]) and all(x in pool for x in set(want[r.doc_id]) - set(left))
    every = {x for _, t in rows for x in t.split("\n")}
    assert {x for r in got for x in r.text.split("\n")} >= every - {""}


def test_a_passage_of_fifty_words_goes_from_later_documents(spark):
    passage = " ".join(f"word{i}" for i in range(51))
    rows = [(2, f"two\n{passage}\nrest"), (1, f"one\n{passage}"), (3, f"{passage}\n{passage}"), (4, "short\nshort"), (5, None), (6, "")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (f"one\n{passage}", 0), 2: ("two\nrest", 1), 3: ("", 2), 4: ("short\nshort", 0), 5: (None, 0), 6: ("", 0)}


def test_line_edges(edges, nothing):
    got = line_dedup.drop_repeated(edges).collect()
    assert len(got) == len(EDGES) and {r.mark for r in got} == {"k"}
    assert line_dedup.drop_repeated(nothing).count() == 0


def vectors(seed):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(40, 16))
    rows = []
    for i in range(600):
        v = base[i % 40] + draw.normal(size=16) * (0.05 if i % 3 else 0.6)
        rows.append((i * 3, v.astype(np.float32).tolist(), int(i % 4)))
    rows += [(5000 + i, rows[7][1], rows[7][2]) for i in range(5)]
    rows += [(6000, None, 1), (6001, [0.0] * 16, 1), (6002, [float("nan")] + [1.0] * 15, 1), (6003, rows[7][1], None),
             (6004, [1.0, 2.0], 1), (6005, [2.0, 4.0], 1), (None, rows[7][1], rows[7][2]), (6006, [None] + [1.0] * 15, 1)]
    return rows


def test_vectors_match_all_pairs(spark):
    rows = vectors(1)
    got = {r.vec_id: r for r in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect() if r.vec_id is not None}
    good = [(i, np.array(v), k) for i, v, k in rows if i is not None and k is not None and pivots.usable(v) is not None]
    links = []
    for n, (i, v, k) in enumerate(good):
        for j, w, m in good[n + 1 :]:
            if k == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links.append((i, j))
    found = sum(r.n_links for r in got.values())
    assert len(links) > 500 and 0.97 * 2 * len(links) <= found <= 2 * len(links)
    count = {i: 0 for i, _, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert all(r.n_links <= count[i] for i, r in got.items())
    want = joined([i for i, _, _ in rows if i is not None], links)
    assert sum(got[i].component_id == c for i, c in want.items()) >= 0.97 * len(want)
    assert all(got[i].n_links == 0 for i in (6000, 6001, 6002, 6003, 6006)) and got[6005].component_id == 6004


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pivots.near_vectors(empty).count() == 0
    blank = spark.createDataFrame([(1, None, 1), (2, [1.0], None)], empty.schema)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.near_vectors(blank).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_pipeline_over_edges(spark, edges, nothing):
    docs = edges
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == edges.columns
    left = {r.doc_id for r in docs.collect()}
    assert left == {3, 9, 11, 12, 13, None}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").select("doc_id").distinct().count() == 6
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables here")
def test_pipeline_keeps_what_plain_rules_keep(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        left = stage(spark, left, folder)
        if name == "language_id":
            assert {r.doc_id for r in left.collect()} == {i for i, t in texts.items() if any(map(str.isalpha, t))}
    rows = [(r.doc_id, r.text) for r in left.collect()]
    groups = plain_groups(rows, 5)[1]
    kept = corpus_pipeline.near(spark, left, folder)
    assert {r.doc_id for r in kept.collect()} == {i for i, c in groups.items() if i == c}
    packed = corpus_pipeline.run(spark, folder).select("doc_id").distinct()
    assert {r.doc_id for r in packed.collect()} == {i for i, c in groups.items() if i == c}


def words_left(rows, least):
    """Words in no window of ``least`` words that stands earlier, by a plain search."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        own = re.findall(r"[^\x20\x09-\x0D]+", t)
        drop = set()
        for a in range(len(own) - least + 1):
            run = tuple(own[a : a + least])
            if run in seen:
                drop |= set(range(a, a + least))
            seen.add(run)
        out[i] = [x for n, x in enumerate(own) if n not in drop]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_inside_lines_match_a_plain_search_by_words(spark, seed):
    draw = np.random.default_rng(seed)
    pool = [f"w{n}" for n in range(120)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(int(draw.integers(1, 5))):
            a = int(draw.integers(0, 100))
            words += pool[a : a + int(draw.integers(1, 40))] + [f"d{i}x{k}" for k in range(int(draw.integers(0, 4)))]
        if draw.random() < 0.2:
            words += ["z"] * int(draw.integers(1, 30))
        rows.append((i, "".join(w + str(draw.choice([" ", " ", " ", "\n", "\n\n"])) for w in words)))
    got = line_dedup.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()
    assert {r.doc_id: r.text.split() for r in got} == words_left(rows, 12)


def test_a_passage_that_ends_inside_lines_goes_exactly():
    passage = " ".join(f"word{i}" for i in range(60))
    assert line_dedup.without(f" a  b {passage} c  d ", [(2, 62)]) == (" a  b c  d ", 0)
    assert line_dedup.without(f"a {passage}\n\nb\n", [(1, 62)]) == ("a\n", 2)


def test_one_line_documents_and_edited_copies_lose_the_passage(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"first {passage} end"), (2, f"other words {passage} here"), (3, f"first {passage.replace('word9 ', 'changed ')} end"), (4, passage)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        1: (rows[0][1], 0), 2: ("other words here", 0), 4: ("", 1),
        3: ("first " + " ".join(f"word{i}" for i in range(9)) + " changed", 0),
    }
