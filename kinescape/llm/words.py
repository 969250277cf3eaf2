"""Words of batches of texts as 64-bit hashes, without a Python step for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Odd multipliers of the hashes.
MIX, BASE = np.uint64(0xBF58476D1CE4E5B9), 0x9E3779B97F4A7C15
_SEEDS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_TIMES = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xE7037ED1A0B428DB))
#: Words of more bytes are hashed alone; characters of texts taken at once.
LONG, SEGMENT = 1024, 1 << 21

_BLANKS = bytes(b == 0x20 or 0x09 <= b <= 0x0D for b in range(256))
LOWER_BYTES = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
#: The low bytes of a 64-bit number that belong to a word of so many bytes.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def joined(texts: list[str | None], lower: bool = True) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of the texts, a blank after each, with ``lower`` in lower case A-Z, and where each text ends."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    whole = b" ".join([*raw, b""])
    return whole.translate(LOWER_BYTES) if lower else whole, ends


def spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of each word: runs without blanks and the characters 9 to 13."""
    blank = np.frombuffer(b"\1" + raw.translate(_BLANKS) + b"\1", bool)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def span_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the bytes of each span, eight bytes a step; ``which`` picks one of two independent ones.

    Spans of one size up to eight bytes never collide.
    """
    sizes = ends - starts
    padded = raw + b"\0" * 8
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    times, shift = _TIMES[which], np.uint64(32)
    out = _SEEDS[which] + sizes.astype(np.uint64) * np.uint64(BASE)
    out = (out ^ (eight[starts] & _KEPT[np.minimum(sizes, 8)])) * times
    out ^= out >> shift
    rest, at = np.flatnonzero((sizes > 8) & (sizes <= LONG)), 8
    while len(rest):
        left = sizes[rest] - at
        more = (out[rest] ^ (eight[starts[rest] + at] & _KEPT[np.minimum(left, 8)])) * times
        out[rest] = more ^ (more >> shift)
        rest, at = rest[left > 8], at + 8
    for i in np.flatnonzero(sizes > LONG):
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]], seed=which)
    return mixed(out)


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other, and where each text's words end."""
    raw, ends = joined(texts, lower)
    starts, stops = spans(raw)
    return span_hashes(raw, starts, stops), np.searchsorted(starts, ends)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, cut at blanks and the characters 9 to 13."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def groups(texts: list[str | None], most: int = SEGMENT) -> Iterator[list[str | None]]:
    """The texts in groups of about ``most`` characters, a text at least."""
    some, held = [], 0
    for text in texts:
        some.append(text)
        held += len(text or "")
        if held >= most:
            yield some
            some, held = [], 0
    if some:
        yield some


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its runs of ``width`` words.

    A text of fewer words has one shingle, the whole sequence; one without words has none.
    """
    for some in groups(texts):
        h, ends = word_hashes(some)
        runs = _runs_of(h, width) if len(h) >= width else h[:0]
        lo = 0
        for hi in ends.tolist():
            if hi - lo >= width:
                yield np.unique(runs[lo : hi - width + 1])
            elif hi > lo:
                yield _runs_of(h[lo:hi], hi - lo)
            else:
                yield h[:0]
            lo = hi


def _runs_of(h: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(h) - n + 1, np.uint64(BASE * n % (1 << 64)))
    for j in range(n):
        out = (out ^ h[j : len(h) - n + 1 + j]) * MIX
        out ^= out >> np.uint64(29)
    return out
