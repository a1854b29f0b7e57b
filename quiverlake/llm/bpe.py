"""Byte-level BPE as a lazily determinised transducer, and streaming decode.

A rank file defines merges ``(left, right) -> token``. The encoding of a byte string by merges in rank
order has a prefix property: if ``e(w)`` ends in token ``t``, then ``e(w)`` without ``t`` is the encoding
of ``w`` without the bytes of ``t``, and ``t`` may follow the last token ``u`` of that encoding exactly
if encoding the bytes of ``u t`` alone gives ``[u, t]``. So the encoding of a prefix is known from the
last tokens of its shorter prefixes, and those reach back no further than the longest token. The state of
the transducer is that window: for each of the last ``max_token`` positions the last token there, with
the bytes in between. States are made when first entered and kept in a table (lazy determinisation);
a state's transition on a byte is one dictionary lookup afterwards. A boundary through which the
encodings of all positions of the window run is settled, and the tokens before it are emitted; long pieces
are emitted so block by block, short ones at their end.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

#: Fixed value: the public pattern that splits text into pieces before merging.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file ``path``: one base64 token and its id a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """The lazily built transducer of one vocabulary. ``max_states`` bounds its memory: beyond it, the tables start anew."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000, max_pieces: int = 300_000):
        self.ranks = ranks
        self.spelling = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.max_states, self.max_pieces = max_states, max_pieces
        self.split = self._splits()
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.window: list[tuple[bytes, tuple[int, ...]]] = [(b"", ())]
        self.number: dict[tuple[bytes, tuple[int, ...]], int] = {self.window[0]: 0}
        self.step: dict[int, int] = {}

    def _splits(self) -> dict[int, tuple[int, int]]:
        """The last merge that makes each token: its left and right part."""
        out = {}
        for t, i in self.ranks.items():
            if len(t) > 1 and len(parts := self._merge(t, i)) == 2:
                out[i] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return out

    def _merge(self, piece: bytes, below: int) -> list[bytes]:
        """Plain merging of ``piece`` with ranks under ``below``; used to take single tokens apart only."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            best, at = below, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1], below)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, u: int, t: int) -> bool:
        """Whether ``u t`` is the encoding of its own bytes: no merge across the border comes before the merges inside."""
        known = self.pair_ok.get((u, t))
        if known is None:
            joined = self.spelling[u] + self.spelling[t]
            known = self._merge(joined, 1 << 60) == [self.spelling[u], self.spelling[t]]
            if len(self.pair_ok) > 4 * self.max_states:
                self.pair_ok.clear()
            self.pair_ok[u, t] = known
        return known

    def _advance(self, state: int, byte: int) -> int:
        """The state after ``byte``; makes it when it is new."""
        seen, lasts = self.window[state]
        seen += bytes((byte,))
        n, last = len(seen), -1
        for size in range(min(n, self.longest), 0, -1):
            t = self.ranks.get(seen[n - size :])
            if t is None:
                continue
            if size == n and len(lasts) == n - 1 and n <= self.longest and self._whole(t):
                last = t
                break
            before = len(lasts) - size  # the position where t would begin
            if before >= 0 and self.follows(lasts[before], t):
                last = t
                break
        if last < 0:
            raise ValueError("the vocabulary lacks a byte")
        key = (seen[-self.longest :], (*lasts, last)[-self.longest :])
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.window)
            self.window.append(key)
        return number

    def _whole(self, t: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        return len(self.spelling[t]) == 1 or t in self.split

    def _settled(self, lasts: list[int]) -> int:
        """The last boundary that the encodings of all positions of the window share."""
        n = len(lasts)
        open_ends = set(range(max(0, n - self.longest), n + 1))
        while len(open_ends) > 1:
            at = max(open_ends)
            open_ends.remove(at)
            open_ends.add(at - len(self.spelling[lasts[at - 1]]))
        return open_ends.pop()

    def _read(self, lasts: list[int], end: int) -> list[int]:
        """The tokens of the first ``end`` positions, read off backwards."""
        out = []
        while end:
            out.append(lasts[end - 1])
            end -= len(self.spelling[out[-1]])
        return out[::-1]

    def encode_piece(self, piece: bytes, block: int = 4096) -> list[int]:
        """Ids of one piece; holds no more than ``block`` open positions, unless none of them is settled."""
        if len(self.window) > self.max_states:
            self._reset()
        state, step, window = 0, self.step, self.window
        out: list[int] = []
        lasts: list[int] = []
        for b in piece:
            after = step.get(state << 8 | b)
            if after is None:
                after = step[state << 8 | b] = self._advance(state, b)
            state = after
            lasts.append(window[state][1][-1])
            if len(lasts) % block == 0 and (end := self._settled(lasts)):
                out += self._read(lasts, end)
                del lasts[:end]
        return out + self._read(lasts, len(lasts))


class Encoder:
    """Splits text by the pattern and encodes the pieces; keeps the ids of pieces seen before (bounded)."""

    def __init__(self, path: str, pattern: str = SPLIT_PATTERN):
        import regex

        self.transducer = Transducer(load_ranks(path))
        self.pieces_of = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; an empty list for null and for the empty text. Special tokens' strings are ordinary text."""
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.pieces_of(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.transducer.encode_piece(piece.encode("utf-8"))
                if len(piece) <= 32:
                    if len(known) >= self.transducer.max_pieces:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


#: UTF-8 by rule: lead byte ranges, the number of continuation bytes, and the range of the first of them.
UTF8_LEADS = (
    (0x00, 0x7F, 0, 0x00, 0x00),
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)


class Utf8Stream:
    """Incremental UTF-8 decoding: ``feed`` returns the complete characters so far; ill-formed bytes become U+FFFD."""

    def __init__(self):
        self.lead = {b: row for row in UTF8_LEADS for b in range(row[0], row[1] + 1)}
        self.held, self.need, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for b in data:
            while True:
                if not self.need:
                    row = self.lead.get(b)
                    if row is None:
                        out.append("�")
                    elif row[2] == 0:
                        out.append(chr(b))
                    else:
                        self.held, self.need, self.low, self.high = bytearray((b,)), row[2], row[3], row[4]
                    break
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode("utf-8"))
                    break
                out.append("�")  # the held bytes end here; this byte is looked at again
                self.need, self.low, self.high = 0, 0x80, 0xBF
        return "".join(out)

    def close(self) -> str:
        """What is left at the end: one U+FFFD for an unfinished character."""
        left, self.need, self.low, self.high = self.need, 0, 0x80, 0xBF
        return "�" if left else ""


def decode_stream(ids: Iterable[int], spelling: dict[int, bytes]) -> Iterator[str]:
    """Text of token ids, piece by piece, as soon as whole characters are known."""
    stream = Utf8Stream()
    for i in ids:
        if i not in spelling:
            raise KeyError(f"no token {i}")
        if text := stream.feed(spelling[i]):
            yield text
    if rest := stream.close():
        yield rest
