"""Language identification by a blended-spectrum string kernel."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinescape.llm.common import arrow_rows, slices

#: First code of the 2-byte and 3-byte grams; codes below the end.
_TWO, _THREE, _END = 256, 256 + (1 << 16), 256 + (1 << 16) + (1 << 24)
NO_LANGUAGE = "und"


def grams(text: str) -> np.ndarray:
    """Sorted distinct codes of all runs of one to three bytes of the text in lower case."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    two = (raw[:-1] << np.uint32(8)) | raw[1:]
    three = (two[:-1] << np.uint32(8)) | raw[2:]
    return np.unique(np.concatenate([raw, two + np.uint32(_TWO), three + np.uint32(_THREE)]))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class KernelModel:
    """Weights of each landmark gram for each language.

    The kernel of two texts is the number of grams present in both over the root of the
    product of their numbers of grams. It is linear in a text's presence vector, so landmark
    kernels, the Nystroem map and the ridge weights multiply into one matrix.
    """

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    sharpness: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities of each language, one matrix product for the batch."""
        if not len(self.codes):
            return np.full((len(texts), len(self.languages)), 1 / max(len(self.languages), 1))
        present = np.zeros((len(texts), len(self.codes)), np.float32)
        norms = np.ones(len(texts), np.float32)
        for i, text in enumerate(texts):
            found = grams(text)
            norms[i] = np.sqrt(len(found))
            at = self._places(found)
            present[i, at] = 1
        margins = (present @ self.weights) / norms[:, None]
        p = np.exp(self.sharpness * (margins - margins.max(axis=1, keepdims=True)))
        return p / p.sum(axis=1, keepdims=True)

    def _places(self, found: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, found)
        at[at == len(self.codes)] = 0
        return at[self.codes[at] == found]


def fit(
    df: DataFrame,
    learn: Column,
    per_language: int = 300,
    landmarks: int = 256,
    ridge: float = 0.5,
    sharpness: float = 4.0,
    key: str = "doc_id",
    text: str = "text",
    label: str = "lang",
) -> KernelModel:
    """Kernel ridge regression, one language against the rest, on Nystroem features.

    Learns from the texts and labels of rows where ``learn`` holds and the label is not null,
    at most ``per_language`` rows of each label, those of least hash of ``key`` (the stated
    bound of the sample; whole texts). ``landmarks`` of them, dealt evenly over the labels,
    are the reference texts. Texts without a letter teach nothing.
    """
    rows = df.where(learn & F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return KernelModel([], np.zeros(0, np.uint32), np.zeros((0, 0), np.float32), sharpness)
    # twice as many as wanted are expected below the bar, so that fewer are very unlikely
    bar = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2 * per_language + 50) / n))))
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.withColumn("draw", draw).where(F.col("draw") < bar[F.col(label)])

    def work(batch):
        for part in slices(batch):
            texts = part.column(2).to_pylist()
            yield {
                "label": part.column(0),
                "draw": part.column(1),
                "codes": [grams(t).tobytes() if has_letter(t) else None for t in texts],
            }

    taught = arrow_rows(
        drawn.select(label, "draw", text), "label string, draw double, codes binary", work
    ).where("codes IS NOT NULL")
    sample: dict[str, list] = {}
    for row in sorted(taught.collect(), key=lambda r: (r.label, r.draw, r.codes)):
        held = sample.setdefault(row.label, [])
        if len(held) < per_language:
            held.append(np.frombuffer(row.codes, np.uint32))
    languages = sorted(sample)
    if not languages:
        return KernelModel([], np.zeros(0, np.uint32), np.zeros((0, 0), np.float32), sharpness)
    each = max(1, landmarks // len(languages))
    marks = [g for name in languages for g in sample[name][:each]]
    codes = np.unique(np.concatenate(marks))
    reference = np.zeros((len(marks), len(codes)), np.float32)
    for i, g in enumerate(marks):
        reference[i, np.searchsorted(codes, g)] = 1 / np.sqrt(len(g))
    inner = (reference @ reference.T).astype(np.float64)
    values, vectors = np.linalg.eigh(inner)
    kept = values > 1e-6 * values.max()
    project = vectors[:, kept] / np.sqrt(values[kept])
    texts = [(k, g) for k, name in enumerate(languages) for g in sample[name]]
    kernel = np.empty((len(texts), len(marks)))
    for at in range(0, len(texts), 256):
        block = np.zeros((min(256, len(texts) - at), len(codes)), np.float32)
        for i, (_, g) in enumerate(texts[at : at + 256]):
            place = np.searchsorted(codes, g)
            place[place == len(codes)] = 0
            block[i, place[codes[place] == g]] = 1 / np.sqrt(len(g))
        kernel[at : at + 256] = block @ reference.T
    features = kernel @ project
    target = np.where(np.array([k for k, _ in texts])[:, None] == np.arange(len(languages)), 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ target)
    weights = reference.T.astype(np.float64) @ (project @ solved)
    return KernelModel(languages, codes, weights.astype(np.float32), sharpness)


def predict(
    df: DataFrame, model: KernelModel, key: str = "doc_id", text: str = "text", carry: bool = False
) -> DataFrame:
    """``key`` (or with ``carry`` all columns), lang_pred, score (0 to 1) of every row, from the whole text alone.

    A null text or one without a letter is ``und`` with score 0, as is every text if nothing
    was learned. Equal texts get equal answers; null keys and repeated rows are kept. Columns
    that already have the new names are replaced.
    """
    kept = [c for c in df.columns if c not in ("lang_pred", "score")] if carry else [key]
    place = len(kept)

    def work(batch):
        for part in slices(batch, 256):
            texts = part.column(place).to_pylist()
            use = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
            names, scores = [NO_LANGUAGE] * len(texts), [0.0] * len(texts)
            if use:
                p = model.scores([texts[i] for i in use])
                for i, k, s in zip(use, p.argmax(axis=1), p.max(axis=1), strict=True):
                    names[i], scores[i] = model.languages[k], float(min(max(s, 0.0), 1.0))
            yield {c: part.column(i) for i, c in enumerate(kept)} | {"lang_pred": names, "score": scores}

    kinds = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in kept)
    source = df.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias("__text"))
    return arrow_rows(source, f"{kinds}, lang_pred string, score double", work)
