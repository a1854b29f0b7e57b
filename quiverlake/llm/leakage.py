"""Evaluation items inside corpus documents, by latent semantic retrieval and exact checks.

Texts are cut into units (see ``units``) and windows of 24 units, every 12 units, so any 12 consecutive
units lie in one window. Windows become TF-IDF vectors over the items' vocabulary with document frequencies
of the whole corpus. A randomised SVD over all windows that could hold a leak, and all item windows, gives
the latent space; each pass over the windows is distributed and sums one fixed-size matrix. A window's
candidates are all item windows above a cosine there. Candidates are then held against the item's text:
12 consecutive units in common, or, for paraphrases, the longest common subsequence and the answers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.session import cut

RUN = 12
WINDOW, STRIDE, LOOSE = 2 * RUN, RUN, 8
UNIT_PATTERN = r"[一-鿿]|[\p{L}\p{Nd}--[一-鿿]]+"


@dataclass(frozen=True)
class Settings:
    rank: int = 192
    oversample: int = 16
    min_cosine: float = 0.25
    items_at_once: int = 500  # more items are taken in blocks of so many, which bounds what is broadcast
    seed: int = 5


def _unit_finder():
    import regex

    return regex.compile(UNIT_PATTERN, regex.V1).findall


def units(text: str | None, find=None) -> list[str]:
    """Units after NFKC and lower case: each ideograph U+4E00 to U+9FFF alone, else runs of letters and digits."""
    if not text:
        return []
    return (find or _unit_finder())(unicodedata.normalize("NFKC", text).lower())


def windows(n: int) -> range:
    """Starts of the windows over ``n`` units: every stretch of ``RUN`` units lies in one of them."""
    return range(0, max(1, n - RUN + 1), STRIDE)


def _grams(seq: np.ndarray) -> np.ndarray:
    """64-bit hashes of all stretches of ``RUN`` unit numbers, along the last axis; 0 where one is unknown (negative)."""
    n = seq.shape[-1] - RUN + 1
    h = np.zeros((*seq.shape[:-1], n), np.uint64)
    bad = np.zeros(h.shape, bool)
    with np.errstate(over="ignore"):
        for i in range(RUN):
            part = seq[..., i : i + n]
            bad |= part < 0
            h = (h ^ (part.astype(np.int64) + 1).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    h[bad] = 0
    return h


def _with_item(h: np.ndarray, item: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = (h ^ ((item.astype(np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    return np.where(h == 0, np.uint64(0), out)


def common_run(a: list, b: list) -> int:
    """Length of the longest stretch of consecutive units in both."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        after = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                after[j + 1] = row[j] + 1
                best = max(best, after[j + 1])
        row = after
    return best


def subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two sequences of unit numbers; negative ones match nothing."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        if x >= 0:
            up = np.where(b == x, row[:-1] + 1, 0)
            row = np.maximum(row, np.concatenate([[0], np.maximum.accumulate(up)]))
    return int(row[-1])


class Items:
    """A block of evaluation items: vocabulary, windows, and their stretches of units. Bounded by the block's size."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        find = _unit_finder()
        split = [(i, units(t, find)) for i, t in rows]
        self.vocabulary = {u: n for n, u in enumerate(sorted({u for _, us in split for u in us}))}
        self.ids = np.array([i for i, _ in split], np.int64)
        self.numbers = [np.array([self.vocabulary[u] for u in us], np.int64) for _, us in split]
        self.answers = [{self.vocabulary[u] for u in us[-RUN:] if u.isdigit()} for _, us in split]
        where = [(k, s) for k, x in enumerate(self.numbers) if len(x) >= RUN for s in windows(len(x))]
        self.window_item = np.array([k for k, _ in where], np.int64)
        self.window_units = np.full((len(where), WINDOW), -1, np.int64)
        for r, (k, s) in enumerate(where):
            part = self.numbers[k][s : s + WINDOW]
            self.window_units[r, : len(part)] = part
        keys = [_with_item(_grams(x), np.full(len(x) - RUN + 1, k)) for k, x in enumerate(self.numbers) if len(x) >= RUN]
        self.stretches = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def _weights(seq: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weight of each place of each window (rows of unit numbers), rows of length 1; repeats share their sum."""
    w = np.where(seq >= 0, idf[np.maximum(seq, 0)], 0.0)
    same = (seq[:, :, None] == seq[:, None, :]) & (seq >= 0)[:, :, None]
    count = same.sum(2)
    norm = np.sqrt((w * w * count).sum(1))  # a unit that comes c times has weight c * idf, spread over c places
    return w / np.where(norm > 0, norm, 1)[:, None]


def _latent(seq: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Windows projected on the basis."""
    out = np.zeros((len(seq), basis.shape[1]), basis.dtype)
    safe = np.maximum(seq, 0)
    for i in range(seq.shape[1]):
        out += basis[safe[:, i]] * weights[:, i, None].astype(basis.dtype)
    return out


def _gather(seq: np.ndarray, weights: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
    """Adds A^T y for the windows' matrix A."""
    for i in range(seq.shape[1]):
        on = seq[:, i] >= 0
        np.add.at(out, seq[on, i], weights[on, i, None] * y[on])


def _scan(docs: DataFrame, items: Items, id_col: str, text_col: str, loose: bool) -> DataFrame:
    """One pass over the corpus: rows ``(kind, doc_id, seq)``.

    Kind 0: a window that holds ``RUN`` consecutive units of the vocabulary, without which nothing in it can
    match; if ``loose``, one that holds at least ``LOOSE`` of its units, the least that a paraphrase shares.
    Kind 1: how many documents of an Arrow batch hold each unit (``doc_id`` is the number of documents).
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(items.vocabulary)
    size = len(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, number = _unit_finder(), vocabulary.value.get
        for batch in batches:
            frequency = np.zeros(size, np.int64)
            doc_ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seq = np.fromiter((number(u, -1) for u in units(text, find)), np.int64)
                if not len(seq):
                    continue
                frequency[np.unique(seq[seq >= 0])] += 1
                if doc is None or len(seq) < (LOOSE if loose else RUN):
                    continue
                held = np.concatenate([[0], np.cumsum(seq >= 0)])
                if loose:
                    starts = np.arange(0, max(1, len(seq) - RUN + 1), STRIDE)
                    starts = starts[held[np.minimum(starts + WINDOW, len(seq))] - held[starts] >= LOOSE]
                else:
                    starts = np.unique(np.flatnonzero(held[RUN:] - held[:-RUN] == RUN) // STRIDE * STRIDE)
                for s in starts.tolist():
                    part = seq[s : s + WINDOW]
                    doc_ids.append(doc)
                    found.append(np.pad(part, (0, WINDOW - len(part)), constant_values=-1).astype(np.int32))
            rows = [*found, frequency.astype(np.int32)]
            kinds = pa.array([0] * len(found) + [1], pa.int8())
            yield pa.RecordBatch.from_arrays([kinds, pa.array([*doc_ids, batch.num_rows], pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["kind", "doc_id", "seq"])

    return docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, "kind tinyint, doc_id bigint, seq array<int>")


def _sum_matrix(found: DataFrame, make, rows: int, cols: int, block: int = 512) -> np.ndarray:
    """Sum over all window batches of the matrices that ``make(seq)`` adds into; reduced in two rounds of bounded groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = np.zeros((rows, cols)) if total is None else total
                make(batch.column(0).flatten().to_numpy().reshape(-1, WINDOW).astype(np.int64), total)
        if total is not None:
            starts = list(range(0, rows, block))
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([total[b : b + block].tobytes() for b in starts], pa.binary())], ["block", "part"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py()) for p in group.column("part"))
        return pa.table({"block": group.column("block").slice(0, 1).cast(pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    parts = found.select("seq").mapInArrow(run, "block int, part binary").withColumn("salt", F.spark_partition_id() % 32)
    summed = parts.groupBy("block", "salt").applyInArrow(add, "block int, part binary").groupBy("block").applyInArrow(add, "block int, part binary")
    out = np.zeros((rows, cols))
    for r in summed.collect():  # rows x cols doubles: the vocabulary of a block of items times the rank
        got = np.frombuffer(r["part"]).reshape(-1, cols)
        out[r["block"] : r["block"] + len(got)] = got
    return out


def latent_basis(found: DataFrame, items: Items, idf: np.ndarray, s: Settings) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the windows' TF-IDF matrix, by a randomised range finder with one power step."""
    size = len(idf)
    width = min(size, s.rank + s.oversample)
    own = items.window_units

    def product(q: np.ndarray) -> np.ndarray:
        shared = found.sparkSession.sparkContext.broadcast((q, idf))

        def make(seq: np.ndarray, total: np.ndarray) -> None:
            basis, weight = shared.value
            w = _weights(seq, weight)
            _gather(seq, w, _latent(seq, w, basis), total)

        total = _sum_matrix(found, make, size, q.shape[1])
        make(own, total)
        return total

    q, _ = np.linalg.qr(product(np.random.default_rng(s.seed).standard_normal((size, width))))
    z = product(q)
    _, vectors = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    return (q @ vectors[:, ::-1])[:, : s.rank].astype(np.float32)


def _search(found: DataFrame, items: Items, idf: np.ndarray, basis: np.ndarray, s: Settings, close: float | None) -> DataFrame:
    """``(doc_id, item_id, cosine, exact, lcs, answers)`` of the candidates that pass a check."""
    own = _latent(items.window_units, _weights(items.window_units, idf), basis)
    own /= np.maximum(np.linalg.norm(own, axis=1), 1e-12)[:, None]
    shared = found.sparkSession.sparkContext.broadcast((items, idf, basis, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, idf, basis, own = shared.value
        for batch in batches:
            doc = batch.column(0).to_numpy()
            every = batch.column(1).flatten().to_numpy().reshape(-1, WINDOW).astype(np.int64)
            out = []
            for at in range(0, len(doc), 2048):
                seq = every[at : at + 2048]
                mine = _latent(seq, _weights(seq, idf), basis)
                mine /= np.maximum(np.linalg.norm(mine, axis=1), 1e-12)[:, None]
                cosine = mine @ own.T
                row, col = np.nonzero(cosine >= s.min_cosine)
                item = items.window_item[col]
                grams = _grams(seq)[row]
                keys = _with_item(grams, np.repeat(item[:, None], grams.shape[1], 1))
                place = np.searchsorted(items.stretches, keys).clip(max=max(len(items.stretches) - 1, 0))
                exact = ((items.stretches[place] == keys) & (keys != 0)).any(1)
                lcs, answers = np.zeros(len(row), np.int32), np.zeros(len(row), np.int32)
                take = exact.copy()
                if close is not None:
                    for j in np.flatnonzero(cosine[row, col] >= close):
                        lcs[j] = subsequence(seq[row[j]], items.window_units[col[j]])
                        answers[j] = len(items.answers[item[j]] & set(seq[row[j]].tolist()))
                        take[j] |= lcs[j] >= LOOSE
                row, col, item = row[take], col[take], item[take]
                out.append((doc[at + row], items.ids[item], cosine[row, col], exact[take], lcs[take], answers[take]))
            parts = [np.concatenate(x) for x in zip(*out)]
            if len(parts) and len(parts[0]):
                kinds = (pa.int64(), pa.int64(), pa.float32(), pa.bool_(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(parts, kinds)], ["doc_id", "item_id", "cosine", "exact", "lcs", "answers"])

    return found.select("doc_id", "seq").mapInArrow(run, "doc_id bigint, item_id bigint, cosine float, exact boolean, lcs int, answers int")


def candidates(docs: DataFrame, eval_items: DataFrame, settings: Settings = Settings(), close: float | None = None, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Checked candidates ``(doc_id, item_id, cosine, exact, lcs, answers)``, one row a window pair.

    ``exact``: at least 12 consecutive units of the item stand in the window. With ``close`` also pairs of at
    least that cosine whose longest common subsequence has 8 units or more. Null ids and texts of fewer than
    12 units match nothing; repeated rows repeat; an empty corpus or no items give no rows.
    """
    spark = docs.sparkSession
    s = settings
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint, cosine float, exact boolean, lcs int, answers int")
    known = eval_items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t"))
    blocks = -(-known.count() // s.items_at_once)
    for b in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        items = Items([(r["i"], r["t"]) for r in part.collect()])
        if not len(items.window_item):
            continue
        scanned = cut(_scan(docs, items, doc_id, text, close is not None), "windows")
        place = scanned.where("kind = 1").select("doc_id", F.posexplode("seq").alias("unit", "n")).groupBy("unit").agg(F.sum("n").alias("n"), F.sum("doc_id").alias("docs"))
        frequency, n_docs = np.zeros(len(items.vocabulary)), 0
        for r in place.collect():
            frequency[r["unit"]], n_docs = r["n"], r["docs"]
        idf = np.log((1 + n_docs) / (1 + frequency)) + 1
        found = scanned.where("kind = 0").select("doc_id", "seq")
        basis = latent_basis(found, items, idf, s)
        out = out.unionByName(_search(found, items, idf, basis, s, close))
    return out


def leaks(docs: DataFrame, eval_items: DataFrame, settings: Settings = Settings(), **names: str) -> DataFrame:
    """``(doc_id, item_id)`` of documents and items with at least 12 consecutive units in common, each once."""
    return candidates(docs, eval_items, settings, **names).where("exact").select("doc_id", "item_id").distinct()


def paraphrases(docs: DataFrame, eval_items: DataFrame, close: float = 0.6, settings: Settings = Settings(), **names: str) -> DataFrame:
    """``(doc_id, item_id, cosine, lcs, answers)`` of document and item that are close without a stretch of 12 units in common.

    The best cosine, longest common subsequence and number of the item's answer figures over their windows.
    """
    best = candidates(docs, eval_items, settings, close, **names).groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answers").alias("answers"), F.max("exact").alias("exact"))
    return best.where("NOT exact").drop("exact")
