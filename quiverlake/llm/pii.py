"""Personal information in free text: a semi-Markov conditional random field over spans of tokens.

``pii_spans`` proposes spans of tokens and their whole-span features. The model is log-linear: a labelling
of a text is a set of spans that don't overlap, and its score is the sum of its spans' weights and of the
weights between a span and the last one before it, if that ended at most ``NEAR`` tokens earlier. Dynamic
programming over the spans' ends finds the labelling of the highest score, so boundaries and kinds are chosen
together. The weights (``pii_weights.json``) are fitted by ``pii_train``.
"""

from __future__ import annotations

import functools
import json
import os
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.llm.bpe import load_ranks
from quiverlake.llm.pii_spans import KINDS, Lexicon, Spans, word_classes
from quiverlake.llm.tokens import vocabulary_path

WEIGHTS = Path(__file__).with_name("pii_weights.json")
NEAR = 6  # tokens between two spans up to which their kinds bear on each other
SOME_CHARS = 2_000_000  # of text at once

Found = tuple[int, int, str, float]


class Model:
    """Weights by kind, group of features and value, in one flat array; and between kinds."""

    def __init__(self):
        self.at: dict[str, np.ndarray] = {}
        size = 0
        for kind in KINDS:
            groups = Spans.SIZES["number" if kind in ("phone", "identity_number") else kind]
            self.at[kind] = size + np.concatenate([[0], np.cumsum(groups[:-1])])
            size += sum(groups)
        self.flat = np.zeros(size)
        self.between = np.zeros((len(KINDS), len(KINDS)))

    def index(self, kind: str, features: np.ndarray) -> np.ndarray:
        return features + self.at[kind]

    def score(self, spans: Spans) -> np.ndarray:
        parts = [self.flat[self.index(kind, f)].sum(1) for kind, f in spans.features]
        return np.concatenate(parts) if parts else np.zeros(0)

    def save(self, path: Path = WEIGHTS) -> None:
        some = np.flatnonzero(np.abs(self.flat) >= 0.005)
        path.write_text(json.dumps({"size": len(self.flat), "between": self.between.round(3).tolist(), "weights": {int(i): round(float(self.flat[i]), 2) for i in some}}, separators=(",", ":")) + "\n")

    @staticmethod
    @functools.lru_cache(maxsize=2)
    def load(path: str = str(WEIGHTS)) -> Model:
        saved, model = json.loads(Path(path).read_text()), Model()
        if saved["size"] != len(model.flat):
            raise ValueError("these weights belong to other features")
        model.flat[[int(i) for i in saved["weights"]]] = list(saved["weights"].values())
        model.between = np.array(saved["between"])
        return model


def best_labelling(spans: list[tuple[int, int, int, float]], between: np.ndarray) -> list[int]:
    """Which of the spans ``(first token, last token, kind, score)``, sorted by their last token, make the labelling of the highest score."""
    ends: list[int] = []  # last tokens
    total: list[float] = []  # score of the best labelling whose last span this is
    came: list[int] = []
    top: list[tuple[float, int]] = [(0.0, -1)]  # the best of the first n, or none
    table = between.tolist()
    for n, (first, last, kind, score) in enumerate(spans):
        far = bisect_left(ends, first - NEAR)
        best, back = top[far]
        for p in range(far, bisect_left(ends, first)):
            value = total[p] + table[spans[p][2]][kind]
            if value > best:
                best, back = value, p
        ends.append(last)
        total.append(best + score)
        came.append(back)
        top.append(max(top[-1], (best + score, n), key=lambda x: x[0]))
    out, n = [], top[-1][1]
    while n >= 0:
        out.append(n)
        n = came[n]
    return out[::-1]


def find_all(texts: list[str], lex: Lexicon, model: Model) -> list[list[Found]]:
    """For every text its occurrences ``(start, end, kind, score)`` in code points, in order."""
    out: list[list[Found]] = [[] for _ in texts]
    at = 0
    while at < len(texts):  # some texts at once, so that the columns stay small
        stop, chars = at, 0
        while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= SOME_CHARS):
            chars += len(texts[stop])
            stop += 1
        spans = Spans(texts[at:stop], lex)
        score = model.score(spans)
        keep = np.flatnonzero(score > -2 * max(0.0, model.between.max()))  # others can't be in the best labelling
        keep = keep[np.lexsort((spans.j[keep], spans.text[keep]))]
        rows = list(zip(*(a[keep].tolist() for a in (spans.text, spans.i, spans.j, spans.kind, score, spans.start, spans.end))))
        n = 0
        while n < len(rows):
            m = n
            while m < len(rows) and rows[m][0] == rows[n][0]:
                m += 1
            one = rows[n:m]
            out[at + rows[n][0]] = [(one[c][5], one[c][6], KINDS[one[c][3]], one[c][4]) for c in best_labelling([r[1:5] for r in one], model.between)]
            n = m
        at = stop
    return out


def find(text: str | None, lex: Lexicon, model: Model) -> list[Found]:
    """Occurrences in one text; none in null and empty texts."""
    return find_all([text], lex, model)[0] if text else []


def vocabulary(path: str | None = None) -> dict[str, int]:
    """What the public vocabulary file says about words' capitals; without the file, nothing."""
    path = path or vocabulary_path()
    return word_classes(load_ranks(path).items()) if os.path.exists(path) else {}


def lexicon_of(parts: DataFrame, path: str | None = None, most: int = 200_000) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """The list of name parts, which must have at most ``most`` rows, and the vocabulary (some 50,000 words): what is broadcast."""
    rows = parts.select("name_part", "part_kind").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} name parts")
    return [(r["name_part"], r["part_kind"]) for r in rows], vocabulary(path)


class _Worker:
    """What a Python worker needs, made once for a broadcast value."""

    last: tuple | None = None

    @classmethod
    def of(cls, shared) -> tuple[Lexicon, Model]:
        value = shared.value
        if cls.last is None or cls.last[0] is not value or len(cls.last[1]) > 500_000:
            cls.last = (value, Lexicon(*value[0]), Model.load(value[1]) if isinstance(value[1], str) else value[1])
        return cls.last[1], cls.last[2]


def _share(docs: DataFrame, parts: DataFrame, weights: str, path: str | None):
    return docs.sparkSession.sparkContext.broadcast((lexicon_of(parts, path), Model.load(weights)))


def occurrences(docs: DataFrame, parts: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: str = str(WEIGHTS), path: str | None = None) -> DataFrame:
    """``(id_col, pii_kind, start_pos, end_pos)``: one row an occurrence; positions in code points, the end exclusive.

    Null and empty texts have none; a document that comes twice has its rows twice; names may lack in ``parts``,
    which may be empty; other columns aren't read. ``path`` is the public vocabulary file (read on the driver).
    Map-only.
    """
    shared = _share(docs, parts, weights, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = _Worker.of(shared)
        for batch in batches:
            found = find_all([t or "" for t in batch.column(1).to_pylist()], lex, model)
            rows = [(i, *f) for i, some in enumerate(found) for f in some]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[3], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["id", "pii_kind", "start_pos", "end_pos"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, pii_kind string, start_pos int, end_pos int")
    return out.withColumnRenamed("id", id_col)


def mask(text: str | None, found: list[Found]) -> str | None:
    """The text with ``[EMAIL]``, ``[PHONE]`` and so on in place of the occurrences, all else unchanged."""
    if not text:
        return text
    out, at = [], 0
    for s, e, k, _ in found:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def masked(docs: DataFrame, parts: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: str = str(WEIGHTS), path: str | None = None) -> DataFrame:
    """``(id_col, text_col)`` with typed placeholders; null stays null, empty stays empty. Map-only."""
    shared = _share(docs, parts, weights, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = _Worker.of(shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = find_all([t or "" for t in texts], lex, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mask(t, f) for t, f in zip(texts, found)], pa.string())], ["id", "text"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, text string")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col))


def chances(spans: list[tuple[int, int, int]], score: np.ndarray, between: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log of the sum over all labellings; each span's probability; expected numbers of near neighbours by kinds. Spans ``(first, last, kind)`` sorted by their last token."""
    n = len(spans)
    first, last, kind = (np.array([s[c] for s in spans]) for c in range(3)) if n else (np.zeros(0, int),) * 3
    ahead = last[:, None] < first[None, :]
    near = ahead & (first[None, :] - last[:, None] <= NEAR)
    step = np.where(near, np.exp(between[kind[:, None], kind[None, :]]), 1.0) * ahead
    weight = np.exp(np.clip(score, -60, 60))
    forward, backward = np.zeros(n), np.ones(n)
    for s in range(n):
        forward[s] = weight[s] * (1 + forward[:s] @ step[:s, s])
    for s in np.argsort(-first, kind="stable"):
        backward[s] = 1 + (step[s] * weight) @ np.where(ahead[s], backward, 0)
    z = 1 + forward.sum()
    pair = (forward[:, None] * step * (weight * backward)[None, :] / z) * near
    expected = np.zeros_like(between)
    np.add.at(expected, (np.broadcast_to(kind[:, None], pair.shape), np.broadcast_to(kind[None, :], pair.shape)), pair)
    return float(np.log(z)), forward * backward / z, expected
