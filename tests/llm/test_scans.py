import hashlib
import re

import numpy as np
import pytest

from kinescape.llm import fingerprints, licenses, secrets
from tests.llm.conftest import EDGES

PLAIN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEY = "AKIA" + "Q7" * 8
WEAK = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"


def test_base_spans_equal_plain_patterns():
    draw = np.random.default_rng(4)
    parts = ["password", "PassWd", "token", "api_key", "secret", "=", ":", " ", '"', "'", "abcdef", "0123456789abcdef" * 2, KEY, "AKIA", "x", "é", "\n", "Z9"]
    for _ in range(4000):
        s = "".join(draw.choice(parts, draw.integers(1, 14)))
        want = [(m.start(), 0, m.end()) for m in PLAIN.finditer(s) if len(m[1]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", s) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", s) if len(m[0]) >= 24]
        assert secrets.base_spans(s) == sorted(want)


def test_weak_parts_count_only_beside_their_complement():
    near = f"key {KEY} and {WEAK} at https://s3.example.org/x end"
    base, linked = secrets.find_spans(near)
    assert [k for _, k, _ in linked] == [3, 4]
    assert secrets.find_spans(f"{WEAK} https://s3.example.org/x")[1] == []
    assert secrets.find_spans(f"{KEY} {'x ' * 300}{WEAK}")[1] == []
    assert secrets.find_spans(f"{KEY}\n\n{WEAK}")[1] == []


@pytest.mark.parametrize("pair", ["{}={}", "{} = {}", '{}="{}"', "export {}={};", "{}: {}"])
def test_a_named_weak_secret_counts_beside_an_identifier(pair):
    text = "\n".join([pair.format("AWS_ACCESS_KEY_ID", KEY), pair.format("AWS_SECRET_ACCESS_KEY", WEAK)])
    at = text.index(WEAK)
    assert secrets.find_spans(text)[1] == [(at, 3, at + 40)]
    assert secrets.find_spans(f"{KEY} X={WEAK}=")[1] == secrets.find_spans(f"{KEY} X={WEAK}a")[1] == []


def test_scan_and_redaction(spark, edges, nothing):
    assert secrets.scan(edges).count() == len(EDGES) and secrets.scan(nothing).count() == 0
    docs = spark.createDataFrame([(1, f"a {KEY} b", 5), (2, None, 6), (3, "password=token:secretvalue", 7)], "doc_id long, text string, spans int")
    got = {r.doc_id: (r.text, r.spans) for r in secrets.redact(docs).collect()}
    assert got == {1: ("a [access] b", 5), 2: (None, 6), 3: ("password=token:secretvalue", 7)}


def test_license_wordings_are_found_with_their_spans(spark):
    whole = licenses.TEMPLATES["mit-header"]
    edited = whole.replace("charge", "any charge").replace("publish, ", "")
    texts = [
        "x. Released under the MIT License.\ny", "Licensed under the Apache License, Version 2.0.", f"é {edited} tail", None, "", "the license of the text",
        "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(m.license, m.start, m.end) for m in r.matches] for r in licenses.scan(docs).collect()}
    assert got[0] == [("mit", 3, 33)] and got[1] == [("apache-2.0", 0, 46)] and got[3] == got[4] == got[5] == []
    assert got[2] == [("mit-header", 2, 2 + len(edited))]
    assert got[6] == [("cc-by-nc-4.0", 0, 27), ("cc-by-nc-4.0", 29, 56)]


def test_versions_and_variants_are_told_apart():
    index = licenses.TemplateIndex.made(licenses.TEMPLATES, 0.8, licenses.HELD)
    for name, wording in licenses.TEMPLATES.items():
        got = licenses.scan_text(f"some text. {wording} more text", index, 0.8, 0.2)
        assert [m["license"] for m in got] == [name] and got[0]["coverage"] == 1, name
    for text in ("Licensed under CC BY-XX 4.0", "Licensed under CC BY 3.0", "licensed under the GNU General Public License, version 1"):
        assert licenses.scan_text(text, index, 0.8, 0.2) == []


def test_one_token_edits_of_short_templates_are_found():
    short = {k: v for k, v in licenses.TEMPLATES.items() if 5 <= len(licenses.token_hashes(v.encode())) <= 9}
    assert len(short) >= 6
    for name, wording in short.items():
        index = licenses.TemplateIndex.made({name: wording})
        own = re.findall("[A-Za-z0-9]+", wording)
        for i in range(len(own)):
            for put in ([], ["zzz"]):
                text = " ".join(["some", "text", *own[:i], *put, *own[i + 1 :], "more", "text"])
                got = licenses.scan_text(text, index, 0.8, 0.2)
                assert [m["license"] for m in got] == [name] and got[0]["coverage"] == (len(own) - 1) / len(own)


def test_alignment_counts_the_longest_common_subsequence():
    draw = np.random.default_rng(6)
    for _ in range(60):
        a, b = draw.integers(0, 4, 7), draw.integers(0, 4, 9)
        table = np.zeros((8, 10), int)
        for i in range(7):
            for j in range(9):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        n, first, last = licenses.aligned(a, b, 99)
        assert n == table[-1, -1] and (n == 0 or last - first + 1 >= n)


def test_license_scan_of_edges(edges, nothing):
    assert licenses.scan(edges).count() == len(EDGES) and licenses.scan(nothing).count() == 0


def plain_fingerprints(rows):
    order = sorted(rows, key=lambda r: ((1 << 63) - 1 if r[0] is None else r[0], r[1] or ""))
    out = []
    for n, (i, t) in enumerate(order):
        s, after = t or "", order[(n + 1) % len(order)][1] or ""
        cut = len(s) // 4
        edited = s[: len(s) - cut] + after[:cut]
        a, b, c = (fingerprints.quartiles(x.encode()) for x in (s, edited, after))
        out.append((i, len(s), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.digest(a), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    return sorted(out, key=str)


def test_fingerprints_equal_a_loop_over_sorted_rows(spark, edges):
    got = fingerprints.fingerprint_edits(edges.repartition(5))
    rows = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in got.collect()]
    assert sorted(rows, key=str) == plain_fingerprints(EDGES)


@pytest.mark.parametrize("rows", [[(5, "only")], [(1, "a"), (1, "b"), (1, "a")], [(None, "p"), (None, "q")]])
def test_fingerprints_of_few_rows(spark, rows):
    got = fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in got), key=str) == plain_fingerprints(rows)


def test_fingerprints_of_an_empty_table(nothing):
    assert fingerprints.fingerprint_edits(nothing).count() == 0


def test_likeness_bounds():
    draw = np.random.default_rng(8)
    text = " ".join(draw.choice(["lorem", "ipsum", "dolor", "sit", "amet"], 400)).encode()
    other = bytes(draw.integers(32, 127, 2000).astype(np.uint8))
    a, b = fingerprints.quartiles(text), fingerprints.quartiles(text[:1800] + other[:200])
    c = fingerprints.quartiles(other)
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, b) > fingerprints.likeness(a, c) >= 0
    assert (fingerprints.parsed(fingerprints.digest(a)) == a).all()
    assert fingerprints.likeness(fingerprints.quartiles(b""), fingerprints.quartiles(b"")) == 1
