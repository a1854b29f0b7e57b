"""Vector text lines through a quote-aware finite-state tokenizer, valid rows apart from failed ones.

The lines of an Arrow batch lie one after the other in one byte buffer, with a byte between them that no
UTF-8 text holds. The buffer is cut into chunks of equal length without regard to the lines. All chunks
run side by side: first from every state at once, which gives each chunk's map from the state before it
to the state after it; these maps are composed over the chunks by doubling, so each chunk's true starting
state is known; a second run from there gives the state at every byte. Tokens, quoted ids and the places
of errors are then read off the state changes. No step depends on how long a line is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER, SPACE, QUOTE, END = range(4)
START, TOKEN, GAP, QUOTED, AFTER_QUOTE, BROKEN = range(6)
#: Next state by state and byte class (other, white space, quote, end of the record).
STEP = np.array(
    [
        [TOKEN, START, QUOTED, START],
        [TOKEN, GAP, BROKEN, START],
        [TOKEN, GAP, BROKEN, START],
        [QUOTED, QUOTED, AFTER_QUOTE, START],
        [BROKEN, GAP, QUOTED, START],
        [BROKEN, BROKEN, BROKEN, START],
    ],
    dtype=np.uint8,
)
SEPARATOR = 0xFF
CLASS = np.zeros(256, np.uint8)
CLASS[list(b" \t\r\n\v\f")] = SPACE
CLASS[ord('"')] = QUOTE
CLASS[SEPARATOR] = END
FINITE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NAMED = r"^[+-]?(?i:nan|inf|infinity)$"
REASONS = np.array(["", "empty", "broken_quote", "column_count", "bad_value"])


def states(buffer: np.ndarray, chunk: int = 512) -> np.ndarray:
    """The state before each byte of ``buffer``, with the state after the last byte appended; it starts in START."""
    n = len(buffer)
    if not n:
        return np.array([START], np.uint8)
    rows = -(-n // chunk)
    kinds = np.full(rows * chunk, END, np.uint8)
    kinds[:n] = CLASS[buffer]
    kinds = np.ascontiguousarray(kinds.reshape(rows, chunk).T)  # a row for each position in the chunks
    flat = STEP.reshape(-1)
    maps = np.repeat(np.arange(6, dtype=np.uint8)[:, None], rows, 1)  # each chunk from every state at once
    for kind in kinds:
        maps = flat[(maps << 2) | kind]
    reach = 1  # doubling: maps[:, i] comes to cover all chunks up to i
    while reach < rows:
        earlier, later = maps[:, :-reach], maps[:, reach:]
        maps = np.concatenate([maps[:, :reach], np.take_along_axis(later, earlier, 0)], 1)
        reach *= 2
    now = np.concatenate([[START], maps[START, :-1]]).astype(np.uint8)
    out = np.empty((chunk + 1, rows), np.uint8)
    for i, kind in enumerate(kinds):
        out[i] = now
        now = flat[(now << 2) | kind]
    out[chunk] = now
    before = out[:chunk].T.reshape(-1)
    return np.append(before[:n], before[n] if n < rows * chunk else now[-1])


def _numbers(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are numbers, and their values (NaN elsewhere)."""
    finite = pc.match_substring_regex(tokens, FINITE).to_numpy(zero_copy_only=False)
    named = pc.match_substring_regex(tokens, NAMED).to_numpy(zero_copy_only=False)
    if len(tokens) == 0:
        return np.zeros(0, bool), np.zeros(0)
    plain = pc.if_else(pc.starts_with(tokens, "+"), pc.utf8_slice_codeunits(tokens, 1), tokens)
    values = pc.cast(pc.if_else(pa.array(finite), plain, "nan"), pa.float64()).to_numpy(zero_copy_only=False).copy()
    ok = finite & ~np.isinf(values)
    if named.any():
        at = np.flatnonzero(named)
        values[at] = [float(x) for x in tokens.take(pa.array(at)).to_pylist()]
    return ok | named, values


def tokenize(texts: pa.Array, dims: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """id, v, reason and error offset (bytes from the line's start) of each text."""
    n = len(texts)
    raw = [b"" if x is None else x for x in pc.cast(texts, pa.binary()).to_pylist()]
    buffer = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8) if n else np.zeros(0, np.uint8)
    state = states(buffer)
    before, after = state[:-1], state[1:]
    ends = np.flatnonzero(buffer == SEPARATOR)
    begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if n else np.zeros(0, np.int64)

    token_at = np.flatnonzero((after == TOKEN) & (before != TOKEN))
    token_to = np.flatnonzero((before == TOKEN) & (after != TOKEN))
    if len(token_to) < len(token_at):  # cannot happen: the buffer ends with a separator
        raise AssertionError("open token")
    row = np.searchsorted(ends, token_at)
    n_tokens = np.bincount(row, minlength=n)
    bounds = np.stack([token_at, token_to], 1).reshape(-1).astype(np.int64)
    if len(token_at):
        pieces = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(buffer)])
        tokens = pieces.take(pa.array(np.arange(0, len(bounds) - 1, 2)))
    else:
        tokens = pa.array([], pa.large_string())
    good, values = _numbers(tokens)

    quoted_at = np.flatnonzero((before == START) & (after == QUOTED))
    has_quoted = np.zeros(n, bool)
    has_quoted[np.searchsorted(ends, quoted_at)] = True
    open_end = before[ends] == QUOTED if n else np.zeros(0, bool)
    broken_at = np.flatnonzero((after == BROKEN) & (before != BROKEN))
    broken_row = np.searchsorted(ends, broken_at)
    broken = open_end.copy()
    broken[broken_row] = True

    first = np.concatenate([[0], np.cumsum(n_tokens)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
    any_token = n_tokens > 0
    first_good = np.zeros(n, bool)
    first_good[any_token] = good[first[any_token]]
    bare_id = any_token & ~first_good & ~has_quoted
    n_comp = n_tokens - bare_id
    want = np.array([-1 if d is None else d for d in dims.to_pylist()], np.int64)
    is_comp = np.ones(len(token_at), bool)
    is_comp[first[bare_id]] = False
    bad = np.flatnonzero(is_comp & ~good)
    has_bad = np.zeros(n, bool)
    has_bad[row[bad]] = True

    empty = ~any_token & ~has_quoted & ~broken
    code = np.select([empty, broken, n_comp != want, has_bad], [1, 2, 3, 4], 0)
    offset = np.zeros(n, np.int64)
    offset[broken_row[::-1]] = (broken_at - begins[broken_row])[::-1]
    only_open = open_end & (code == 2)
    offset[np.searchsorted(ends, quoted_at)[only_open[np.searchsorted(ends, quoted_at)]]] = (quoted_at - begins[np.searchsorted(ends, quoted_at)])[only_open[np.searchsorted(ends, quoted_at)]]
    few = code == 3
    offset[few] = (ends - begins)[few]
    surplus = few & (n_comp > want) & (want >= 0)
    offset[surplus] = token_at[(first + bare_id + want)[surplus]] - begins[surplus]
    late = code == 4
    firsts = np.full(n, -1, np.int64)
    firsts[row[bad][::-1]] = token_at[bad][::-1]
    offset[late] = (firsts - begins)[late]

    ids: list[str | None] = [None] * n
    fine = code == 0
    for i in np.flatnonzero(fine & bare_id):
        ids[i] = tokens[int(first[i])].as_py()
    quote_to = np.flatnonzero((before == AFTER_QUOTE) & ((after == GAP) | (buffer == SEPARATOR)))
    closes = dict(zip(np.searchsorted(ends, quote_to).tolist(), quote_to.tolist()))
    for at, i in zip(quoted_at.tolist(), np.searchsorted(ends, quoted_at).tolist()):
        if fine[i]:
            ids[i] = bytes(buffer[at + 1 : closes[i] - 1]).decode("utf-8").replace('""', '"')
    kept = is_comp & fine[row]
    sizes = np.where(fine, n_comp, 0)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values[kept]), mask=pa.array(~fine) if n else None) if n else pa.array([], pa.list_(pa.float64()))
    failed = pa.array(~fine)
    reason = pc.if_else(failed, pa.array(REASONS[code].tolist(), pa.string()), pa.scalar(None, pa.string()))
    return pa.array(ids, pa.string()), lists, reason, pc.if_else(failed, pa.array(offset), pa.scalar(None, pa.int64()))


def parse_lines(lines: DataFrame, text: str | Column = "raw_text", dim: str | Column = "file_dim", keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """Every line with ``keep`` columns and ``id, v, reason, error_offset``; a failed line has no id and no v.

    The first reason that applies counts: ``empty`` (null or only white space), ``broken_quote``,
    ``column_count`` (also when the expected number is null), ``bad_value``. ``error_offset`` is in bytes
    from the line's start. Lines delivered twice come out twice. Columns not kept are not read, so names
    may clash freely there. Map-only: no shuffle, and memory bounded by the Arrow batch.
    """
    text, dim = (F.col(x) if isinstance(x, str) else x for x in (text, dim))
    names = [f"_k{i}" for i in range(len(keep))]
    source = lines.select(*(lines[k].alias(a) for k, a in zip(keep, names)), text.cast("string").alias("_text"), dim.cast("int").alias("_dim"))
    kept = ", ".join(f"{a} {source.schema[a].dataType.simpleString()}" for a in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = tokenize(batch.column(len(names)), batch.column(len(names) + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *parsed], [*names, "id", "v", "reason", "error_offset"])

    out = source.mapInArrow(run, f"{kept}, id string, v array<double>, reason string, error_offset bigint")
    return out.select(*(F.col(a).alias(k) for k, a in zip(keep, names)), "id", "v", "reason", "error_offset")


def split_lines(lines: DataFrame, **kwargs) -> tuple[DataFrame, DataFrame]:
    """(valid rows with id and v, failed rows with reason and error_offset)."""
    parsed = parse_lines(lines, **kwargs)
    return parsed.where("reason IS NULL").drop("reason", "error_offset"), parsed.where("reason IS NOT NULL").drop("id", "v")
