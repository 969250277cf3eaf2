import base64
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
from tokenizers import Tokenizer  # noqa: E402

from kinescape.llm.byte_bpe import decode, encode  # noqa: E402
from kinescape.llm.packing import HarmonicPacker, pack  # noqa: E402
from kinescape.llm.pieces import encoder  # noqa: E402
from tests.llm.conftest import EDGES  # noqa: E402

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strange(seed):
    draw = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", " ", " ", "　", "a", "word", "'s", "12", "²", "é", "你", "\U0001f600", "!", "́", "_", "<|endoftext|>"]
    return "".join(draw.choice(parts) for _ in range(draw.randrange(40)))


def each(codes, texts):
    ids, sizes = codes.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_ids_equal_the_library_for_the_ranks(plain):
    texts = [t for _, t in EDGES] + [strange(i) for i in range(3000)] + ["\0nul word", "a \0b \0", "x. y, z\n! 'tis"]
    assert each(encoder(RANKS, P.PATTERN), texts) == [plain.encode_ordinary(t or "") for t in texts]


def test_json_ids_equal_its_library():
    full = Tokenizer.from_file(JSON)
    full.encode_special_tokens = True
    texts = [t or "" for _, t in EDGES] + [strange(i) for i in range(1000)]
    texts += ["x" * 300 + " " + "y" * 500, " é ß word. word, Ünï 你好 words"]
    want = [full.encode(t, add_special_tokens=False).ids for t in texts]
    for quick in (False, True):
        ids, sizes = encoder(JSON, P.PATTERN).encode(texts, quick)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_small_calls_give_the_same_ids(plain, monkeypatch):
    from kinescape.llm import pieces

    monkeypatch.setattr(pieces, "PIECES", 3)
    monkeypatch.setattr(pieces, "CHARACTERS", 20)
    texts = ["one two three four five one two three six, seven! eight", "", None, "nine ten one"] * 3
    assert each(encoder(RANKS, P.PATTERN), texts) == [plain.encode_ordinary(t or "") for t in texts]


def test_another_pattern_is_refused():
    from kinescape.llm.pieces import PieceEncoder

    with pytest.raises(ValueError):
        PieceEncoder(RANKS, "[a-z]+|[A-Z]+|.")


def test_round_trip_and_offsets(spark, edges, plain):
    ids = encode(edges, RANKS, P.PATTERN)
    back = decode(ids, RANKS, P.PATTERN)
    got = sorted(((r.doc_id, bytes(r.decoded)) for r in back.collect()), key=str)
    assert got == sorted(((i, (t or "").encode()) for i, t in EDGES), key=str)
    texts = {i: t or "" for i, t in EDGES}
    for r in ids.collect():
        s = texts[r.doc_id]
        assert r.ids == plain.encode_ordinary(s)
        inside = 0
        for n, (a, b) in enumerate(zip(r.starts, r.ends, strict=True)):
            piece = plain.decode_single_token_bytes(r.ids[n])
            assert piece in s[a:b].encode()
            inside += (piece[0] & 0xC0) == 0x80
        assert r.n_split == inside


def test_null_ids_decode_to_null(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in decode(rows, RANKS, P.PATTERN).collect()} == {1: None, 2: b""}


def test_empty_tables(nothing):
    assert encode(nothing, RANKS, P.PATTERN).count() == 0
    assert pack(nothing, JSON, P.PATTERN).count() == 0


def test_packing_holds_every_id_once(edges):
    got = pack(edges.repartition(3), JSON, P.PATTERN, with_ids=True).toPandas()
    full = Tokenizer.from_file(JSON)
    full.encode_special_tokens = True
    want = {}
    for i, t in EDGES:
        want.setdefault(-1 if i is None else i, []).append(full.encode(t or "", add_special_tokens=False).ids + [1])
    for i, rows in got.fillna({"doc_id": -1}).groupby("doc_id"):
        ids = want[int(i)][0]
        assert rows.length.sum() == len(ids) * len(want[int(i)])
        for r in rows.itertuples():
            part = ids[r.start : r.start + r.length]
            assert list(r.ids) == part and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        ends = rows.length.cumsum()
        assert list(rows.offset) == [0, *ends[:-1]] and ends.iloc[-1] <= 2048


def test_packer_pads_nothing_and_leaves_most_whole():
    draw = np.random.default_rng(0)
    packer, out, sizes = HarmonicPacker(256, 8), [], draw.integers(1, 900, 800)
    for d, n in enumerate(sizes.tolist()):
        out += packer.add(d, np.arange(n))
    out += packer.finish()
    fill, pieces = {}, {}
    for d, start, ids, total, sequence, offset in out:
        assert offset == fill.get(sequence, 0) and total == sizes[d]
        fill[sequence] = fill.get(sequence, 0) + len(ids)
        pieces.setdefault(d, []).append((start, len(ids)))
    assert max(fill.values()) <= 256 and not [n for n in fill.values() if n & (n - 1)]
    for d, parts in pieces.items():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist() and sum(n for _, n in parts) == sizes[d]
    short = [d for d in pieces if sizes[d] <= 256]
    assert sum(len(pieces[d]) == 1 for d in short) > 0.5 * len(short)
    with pytest.raises(ValueError):
        HarmonicPacker(100)


def test_equal_lengths_fill_their_class():
    packer = HarmonicPacker(64, 0)
    out = [p for d in range(9) for p in packer.add(d, np.arange(21))]  # three of 21 leave a place
    assert out == [] and len(packer.waiting) == 3 and all(len(h) == 3 for _, _, h in packer.waiting)
