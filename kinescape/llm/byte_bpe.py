"""Byte-level BPE encoding and decoding over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinescape.llm.common import arrow_rows, slices
from kinescape.llm.pieces import encoder


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32, copy=False)))


def encode(
    df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", offsets: bool = True
) -> DataFrame:
    """Token ids of each whole text: ``key``, ids array<int>, n_split long and, with ``offsets``,
    starts and ends array<int> (code points; an id inside a character has that character's).

    ``path`` is a vocabulary file, ``pattern`` its splitting expression; each match is encoded
    separately, special tokens do not exist. n_split counts ids that begin inside a character.
    A null or empty text gives no ids; a null key is kept; other columns are not read.
    One scan, no shuffle; rows keep their partition.
    """
    kind = dict(df.dtypes)[key]

    def work(batch):
        codes = encoder(path, pattern)
        for part in slices(batch):
            texts = [s or "" for s in part.column(1).to_pylist()]
            ids, sizes = codes.encode(texts)
            ids = np.split(ids, np.cumsum(sizes)[:-1])
            starts, ends, split = [], [], []
            for s, row in zip(texts, ids, strict=True):
                if offsets or not s.isascii():
                    first, last = codes.offsets(s, row) if len(row) else (row, row)
                    split.append(_inside(s, codes, row))
                    starts.append(first)
                    ends.append(last)
                else:
                    split.append(0)
            out = {key: part.column(0), "ids": _lists(ids), "n_split": split}
            if offsets:
                out |= {"starts": _lists(starts), "ends": _lists(ends)}
            yield out

    more = ", starts array<int>, ends array<int>" if offsets else ""
    return arrow_rows(df.select(key, text), f"`{key}` {kind}, ids array<int>, n_split long{more}", work)


def _inside(text: str, codes, ids: np.ndarray) -> int:
    """Ids that begin at a byte which continues a character."""
    if not len(ids):
        return 0
    raw = np.frombuffer(text.encode(), np.uint8)
    begins = np.cumsum(codes.widths[ids]) - codes.widths[ids]
    return int(((raw[begins] & 0xC0) == 0x80).sum())


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Replace the column ``ids`` by decoded binary: the bytes of all ids, joined.

    Ids may split characters, so bytes are joined before any text is made of them. Null ids
    give null; an empty list gives no bytes. Other columns stay, but a column decoded is
    replaced. Unknown ids are an error. Ids of very long texts are one array, as they came.
    """
    kept = [c for c in df.columns if c not in (ids, "decoded")]
    schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in kept)
    place, at = df.columns.index(ids), {c: df.columns.index(c) for c in kept}

    def work(batch):
        codes = encoder(path, pattern)
        for part in slices(batch):
            column = part.column(place)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
            known = column.is_valid().to_pylist()
            out = [
                codes.decode(flat[ends[i] : ends[i + 1]]) if known[i] else None for i in range(len(part))
            ]
            yield {c: part.column(at[c]) for c in kept} | {"decoded": out}

    return arrow_rows(df, f"{schema + ', ' if schema else ''}decoded binary", work)
