"""Byte-level BPE of batches of texts through the tokenizers library, each distinct piece once a batch.

BPE never merges across a match of the splitting pattern, so a batch's distinct pieces are
encoded in one call and their ids are dealt out to the texts. Nothing is kept from batch to
batch but the vocabulary.
"""

from __future__ import annotations

import base64
import json
import os
import re
from itertools import chain, compress

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

#: White space before a blank: there a blank does not start a new match. ASCII part, rest.
_SPACED = re.compile("[ \t\n\r\x0b\x0c\x1c-\x1f\x85] ").search
_WIDE = regex.compile("[\u0085   -     　] ")
#: White space that words may hold, and control characters.
_ODD = regex.compile(r"[\s\x00-\x1f\x7f-\x9f]")
#: Signs that are no letter, digit, blank or apostrophe, so that a match begins at them after letters.
_SIGNS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: Distinct pieces of one call of the library, and characters of texts encoded at once.
PIECES, CHARACTERS = 4096, 1 << 23

_ready: dict[tuple[str, str], "PieceEncoder"] = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs of ``sizes`` from ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class PieceEncoder:
    """Ids of texts by a vocabulary file; ``rank`` files and ``json`` files are read.

    The pattern must be one that starts a new match at every blank that no white space
    precedes, as the files' own does; any other is refused.
    """

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        characters = byte_characters()
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            vocabulary = model["vocab"]
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            whole = bool(model.get("ignore_merges"))
            back = {c: b for b, c in enumerate(characters)}
            strings = {i: bytes(map(back.__getitem__, t)) if all(c in back for c in t) else t.encode() for t, i in vocabulary.items()}
        else:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
            mapped = lambda raw: "".join(map(characters.__getitem__, raw))
            vocabulary = {mapped(t): r for t, r in ranks.items()}
            merges = [(mapped(a), mapped(b)) for a, b in _merges(ranks)]
            strings = {r: t for t, r in ranks.items()}
            whole = True
        self.library = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=whole))
        # no byte's character is a blank, so blanks part the pieces of a call
        self.library.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.split = regex.compile(pattern)
        if self.split.findall("a b") != ["a", " b"] or self.split.findall("Ab.\nc d") != ["Ab", ".", "\n", "c", " d"]:
            raise ValueError("the pattern must start a match at a blank between words, and part words from signs")
        # the character of each byte as UTF-16; 255 is in no text and becomes the blank
        self.codes = np.array([ord(c) for c in characters], "<u2")
        self.codes[255] = 0x20
        self.ranks = None  # made when words are asked for
        self.size = max(strings) + 1
        self.widths = np.zeros(self.size, np.int64)
        for i, t in strings.items():
            self.widths[i] = len(t)
        self.begins = np.cumsum(self.widths) - self.widths
        self.raw = np.frombuffer(b"".join([strings.get(i, b"") for i in range(self.size)]), np.uint8)

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of matches of the pattern one after the other, and how many each has."""
        all_ids, all_sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), PIECES):
            raw = [*map(str.encode, pieces[at : at + PIECES])]
            text = self.codes[np.frombuffer(b"\xff".join(raw), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            past = np.cumsum(self.widths[ids])
            cuts = np.searchsorted(past, np.cumsum([*map(len, raw)]), side="right")
            all_ids.append(ids)
            all_sizes.append(np.diff(cuts, prepend=0))
        return np.concatenate(all_ids), np.concatenate(all_sizes)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct words, each with a blank before it, through the library for ranks.

        Words without white space cannot merge with their neighbours, so all go in one call; odd
        and long ones go by way of their matches.
        """
        if self.ranks is None:
            table = {self.raw[a : a + n].tobytes(): i for i, (a, n) in enumerate(zip(self.begins.tolist(), self.widths.tolist(), strict=True)) if n}
            self.ranks = tiktoken.Encoding("ranks", pat_str=self.split.pattern, mergeable_ranks=table, special_tokens={})
        raw = [*map(str.encode, words)]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        odd = length > 200
        if _ODD.search("".join(words)):
            odd |= np.fromiter(map(bool, map(_ODD.search, words)), bool, len(words))
        ids = np.array(self.ranks.encode_ordinary("".join([" " + w for w in compress(words, ~odd)])), np.int32)
        sizes = np.zeros(len(words), np.int64)
        cuts = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(length[~odd] + 1), side="right")
        sizes[~odd] = np.diff(cuts, prepend=0)
        if not odd.any():
            return ids, sizes
        more, sizes[odd] = self.chunks([*compress(words, odd)], False)
        begins = np.empty(len(words), np.int64)
        begins[~odd] = np.cumsum(sizes[~odd]) - sizes[~odd]
        begins[odd] = len(ids) + np.cumsum(sizes[odd]) - sizes[odd]
        return np.concatenate([ids, more])[ragged(begins, sizes)], sizes

    def either(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`pieces`, but words of letters alone go through the library for ranks, which has the same ids."""
        plain = np.fromiter((p[:1] == " " and p[1:].isalpha() for p in pieces), bool, len(pieces))
        words, some = self.words([p[1:] for p in compress(pieces, plain)])
        rest, more = self.pieces([*compress(pieces, ~plain)])
        sizes, begins = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        sizes[plain], sizes[~plain] = some, more
        begins[plain], begins[~plain] = np.cumsum(some) - some, len(words) + np.cumsum(more) - more
        return np.concatenate([words, rest])[ragged(begins, sizes)], sizes

    def chunks(self, chunks: list[str], marked: bool = True, quick: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct words that follow a blank, or of whole matches ``marked`` with a NUL."""
        plain = np.fromiter(map(str.isalpha, chunks), bool, len(chunks))
        pieces = [" " + c for c in compress(chunks, plain)]
        own, counts = [], []
        for c in compress(chunks, ~plain):
            if marked and c[:1] == "\0":
                found = [c[1:]]
            elif c[-1:] in _SIGNS and c[:-1].isalpha():
                found = [" " + c[:-1], c[-1]]
            else:
                found = self.split.findall(" " + c)
            counts.append(len(found))
            own += found
        known = list(dict.fromkeys(chain(pieces, own)))  # the plain words first, as they are
        place = dict(zip(known, range(len(known))))
        rest = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
        del place
        ids, sizes = self.either(known) if quick else self.pieces(known)
        begins = np.cumsum(sizes) - sizes
        counts = np.array(counts, np.int64)
        # ids of the plain words stand first already; those of the others are put after all
        tail = ids[ragged(begins[rest], sizes[rest])]
        first, each = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        first[plain], each[plain] = begins[: len(pieces)], sizes[: len(pieces)]
        past = np.concatenate([[0], np.cumsum(sizes[rest])])
        cut = np.concatenate([[0], np.cumsum(counts)])
        first[~plain], each[~plain] = len(ids) + past[cut[:-1]], np.diff(past[cut])
        return np.concatenate([ids, tail])[ragged(first, each)], each

    def _encoded(self, texts: list[str], quick: bool) -> tuple[np.ndarray, np.ndarray]:
        words, counts = [], []
        for text in texts:
            before = len(words)
            if "\0" in text or _SPACED(text) or (not text.isascii() and _WIDE.search(text)):
                words += ["\0" + p for p in self.split.findall(text)]
            elif text:
                first, *rest = text.split(" ")
                words += ["\0" + p for p in self.split.findall(first)]
                words += rest
            counts.append(len(words) - before)
        distinct = list(dict.fromkeys(words))
        index = dict(zip(distinct, range(len(distinct))))
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        del words, index
        ids, sizes = self.chunks(distinct, quick=quick)
        each = sizes[at]
        past = np.concatenate([[0], np.cumsum(each)])
        cut = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return ids[ragged((np.cumsum(sizes) - sizes)[at], each)], np.diff(past[cut])

    def encode(self, texts: list[str | None], quick: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids (int32) of whole texts one after the other (null: none), and how many each has.

        With ``quick`` words of letters go through the faster of the two libraries.
        """
        out, some, held = [(np.zeros(0, np.int32), np.zeros(0, np.int64))], [], 0
        for text in texts:
            some.append(text or "")
            held += len(some[-1])
            if held >= CHARACTERS:
                out.append(self._encoded(some, quick))
                some, held = [], 0
        if some:
            out.append(self._encoded(some, quick))
        ids, sizes = zip(*out, strict=True)
        return np.concatenate(ids), np.concatenate(sizes)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; a character may be split between ids."""
        return self.raw[ragged(self.begins[ids], self.widths[ids])].tobytes()

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character of each id; an id inside a character has that one."""
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = np.cumsum(self.widths[ids])
        lead = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and with each byte
        starts = ends - self.widths[ids]
        return lead[starts] - 1, lead[ends - 1]


def encoder(path: str, pattern: str) -> PieceEncoder:
    """The worker's encoder of this vocabulary; of two vocabularies only the last stays."""
    if (path, pattern) not in _ready:
        _ready.clear()
        _ready[path, pattern] = PieceEncoder(path, pattern)
    return _ready[path, pattern]


def _merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each token of a rank file is merged from, in order of rank."""
    found = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(
                range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60)
            )
            if ranks.get(parts[best] + parts[best + 1], 1 << 60) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            found.append((parts[0], parts[1]))
    return found
