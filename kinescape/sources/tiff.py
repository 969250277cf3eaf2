"""Uncompressed TIFF files as frame rows, decoded where they are read."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinescape.sources.frames import FRAME_SCHEMA, normalised

#: Fixed values of the format: bytes and struct letters of field types, numbers of the tags that are read, numpy kinds.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 16: (8, "Q")}
_TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 270: "description", 273: "places", 277: "samples",
    278: "rows", 279: "sizes", 339: "kind",
}
_KINDS = {1: "u", 2: "i", 3: "f"}


def _directory(raw: bytes, order: str, at: int) -> tuple[dict, int]:
    count = struct.unpack_from(f"{order}H", raw, at)[0]
    found = {}
    for n in range(count):
        place = at + 2 + 12 * n
        tag, kind, number = struct.unpack_from(f"{order}HHI", raw, place)
        if tag in _TAGS and kind in _TYPES:
            size, letter = _TYPES[kind]
            start = place + 8 if size * number <= 4 else struct.unpack_from(f"{order}I", raw, place + 8)[0]
            values = struct.unpack_from(f"{order}{number}{letter}", raw, start)
            found[_TAGS[tag]] = values[0] if kind == 2 else list(values)
    return found, struct.unpack_from(f"{order}I", raw, at + 2 + 12 * count)[0]


def decoded(raw: bytes) -> tuple[np.ndarray, str]:
    """All pages of a file, of one size and kind, and its description."""
    if raw[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file of 32-bit places")
    order = "<" if raw[:1] == b"I" else ">"
    at, pages, description = struct.unpack_from(f"{order}I", raw, 4)[0], [], b""
    while at:
        told, at = _directory(raw, order, at)
        if told.get("compression", [1])[0] != 1 or told.get("samples", [1])[0] != 1:
            raise ValueError("only uncompressed pages of one sample are read")
        kind = np.dtype(f"{order}{_KINDS[told.get('kind', [1])[0]]}{told.get('bits', [8])[0] // 8}")
        height, width = told["height"][0], told["width"][0]
        sizes = told.get("sizes") or [height * width * kind.itemsize]
        data = b"".join(raw[a : a + n] for a, n in zip(told["places"], sizes, strict=True))
        pages.append(np.frombuffer(data, kind, height * width).reshape(height, width))
        description = description or told.get("description", b"")
    if len({(p.shape, p.dtype) for p in pages}) != 1:
        raise ValueError("a file must hold one series of pages of one size")
    return np.stack(pages), description.rstrip(b"\0").decode("latin-1")


def shaped(pages: np.ndarray, description: str, axes: str | None = None) -> np.ndarray:
    """Pages as time, row, column, channel: by ``axes`` (of the pages, then Y and X; the pages' sizes from the
    description), else by the channels and frames that the description names, else pages as frames."""
    told = {k: int(v) for k, v in re.findall(r"^(channels|slices|frames)=(\d+)", description, re.MULTILINE)}
    sizes = {"C": told.get("channels", 1), "Z": told.get("slices", 1), "T": told.get("frames", 1)}
    letters = axes or ("TZCYX" if told else "TYX")
    outer = [a for a in letters if a not in "YX"]
    if len(outer) == 1:
        return normalised(pages, letters)
    if np.prod([sizes[a] for a in outer]) != len(pages):
        raise ValueError(f"{len(pages)} pages are not {sizes}")
    return normalised(pages.reshape(*(sizes[a] for a in outer), *pages.shape[1:]), letters)


def read_tiff(spark: SparkSession, path: str, axes: str | None = None) -> DataFrame:
    """Frame rows of the files at a path; a movie for each file, by its name. A file is decoded in one task."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("movie"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for movie, content in zip(batch.movie, batch.content, strict=True):
                a = shaped(*decoded(bytes(content)), axes)
                for t in range(a.shape[0]):
                    yield pd.DataFrame(
                        {"movie": movie, "frame": t, "channel": range(a.shape[3]), "height": a.shape[1], "width": a.shape[2],
                         "pixels": [a[t, :, :, c].astype(float).ravel() for c in range(a.shape[3])]}
                    )

    return files.mapInPandas(run, FRAME_SCHEMA)
