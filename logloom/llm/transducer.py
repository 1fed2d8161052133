"""Byte-level BPE as a lazily determinised finite-state transducer, run over many lanes at once.

A sequence of tokens is what the merges make of a piece of text if and only if each two
neighbours are what the merges make of their joined bytes. So a nondeterministic transducer
reads bytes with two things in mind, the last whole token and a node of the token trie, and
may end a token where its neighbours agree. Its subset construction is made as texts need it:
a deterministic state is the set of readings still possible, each with the tokens that it has
but that aren't common to all readings. What is common is emitted at once. A reading dies
within the length of the longest token, which bounds the lookahead.

The text is cut into pieces first, by the usual pattern of such vocabularies, as flags on the
bytes. Both steps work on arrays of bytes: the transducer takes one byte of thousands of lanes
at a time, all lanes starting where a piece starts. No text is handled character by character
in Python.
"""

from __future__ import annotations

import base64
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

FLUSH = 512
WIDTH = 513
#: Rows of the transition table; when it is full it is made anew, with no change of results. The same number bounds
#: the outputs that are remembered, and eight times as many the pairs of tokens of which is known whether they may meet.
MAX_STATES = 60_000
#: Bytes of a lane at least, and of the texts that are handled at once.
LANE, CHUNK = 192, 2 << 20

LETTER, NUMBER, OTHER, SPACE, END = range(5)
#: The code points of white space in the Unicode standard.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that the pattern splits off.
ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def code_point_classes() -> np.ndarray:
    """The class of each code point; one more entry stands for the end of a text."""
    kinds = np.full(0x110001, OTHER, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            kinds[cp] = LETTER
        elif c == "N":
            kinds[cp] = NUMBER
    kinds[WHITE] = SPACE
    kinds[0x110000] = END
    return kinds


def byte_letters() -> dict[str, int]:
    """The letter by which vocabulary files write each byte: itself if it shows, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Vocabulary:
    """The tokens and merges of a byte-level BPE file.

    Files of the ``tokenizers`` library list the merges. Rank files give each token a rank, by base64; there
    two neighbours merge if their joined bytes are a token, lower ranks first, and a token's rank is its id.
    """

    def __init__(self, raw: bytes):
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.ranks: dict[bytes, int] | None = None
        if raw.lstrip()[:1] == b"{":
            self._from_merges(json.loads(raw)["model"])
        else:
            self._from_ranks(raw)
        self.of_byte = {b[0]: i for i, b in self.bytes.items() if len(b) == 1}
        self._right: dict[int, list[tuple[int, float, float]]] = {}
        self._left: dict[int, list[tuple[int, float, float]]] = {}
        self._agree: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _from_merges(self, model: dict) -> None:
        letters, vocab = byte_letters(), model["vocab"]
        self.bytes: dict[int, bytes] = {
            i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)
        }
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merged.setdefault((left, right), (rank, whole))
            self.parts.setdefault(whole, (left, right, rank))

    def _from_ranks(self, raw: bytes) -> None:
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line.strip())}
        self.bytes = {r: t for t, r in self.ranks.items()}
        for token, rank in self.ranks.items():
            at = [token[i : i + 1] for i in range(len(token))]
            while len(at) > 2:
                known = [(self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(at, at[1:], strict=False))]
                least, i = min(known)
                if least >= rank:
                    break
                at[i : i + 2] = [at[i] + at[i + 1]]
            if len(at) == 2:
                self.parts[rank] = (self.ranks[at[0]], self.ranks[at[1]], rank)

    def merge(self, a: int, b: int) -> tuple[int, int] | None:
        """The rank of the merge of two tokens and what it makes, if there is one."""
        if self.ranks is None:
            return self.merged.get((a, b))
        whole = self.ranks.get(self.bytes[a] + self.bytes[b])
        return None if whole is None else (whole, whole)

    def _edge(self, token: int, side: int, known: dict) -> list[tuple[int, float, float]]:
        """The tokens at one end of a token, from itself to a byte: each with the merge that makes it and that which takes it."""
        edge = known.get(token)
        if edge is None:
            edge, taken, at = [], float("inf"), token
            while at in self.parts:
                made = self.parts[at][2]
                edge.append((at, made, taken))
                at, taken = self.parts[at][side], made
            edge.append((at, -1, taken))
            known[token] = edge
        return edge

    def _merges_across(self, a: int, b: int, before: float) -> bool:
        """Whether the merges, up to one, join something across the border of two tokens.

        Two tokens at the border join if both are there when their merge comes. Of equal merges
        the one further left comes first: that within ``a``, before that across, before that in ``b``.
        """
        for x, made_x, taken_x in self._edge(a, 1, self._right):
            for y, made_y, taken_y in self._edge(b, 0, self._left):
                if made_y >= taken_x or made_x >= taken_y:
                    continue
                m = self.merge(x, y)
                if m and m[0] < before and made_x < m[0] < taken_x and made_y < m[0] <= taken_y:
                    return True
        return False

    def agree(self, a: int, b: int) -> bool:
        """Whether the merges make just these two tokens of their joined bytes."""
        known = self._agree.get((a, b))
        if known is None:
            known = self._agree[a, b] = not self._merges_across(a, b, float("inf"))
        return known

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of some tokens, gathered from one table. An id that isn't there is an error."""
        if self._table is None:
            lens = np.full(max(self.bytes) + 1, -1, np.int64)
            for i, text in self.bytes.items():
                lens[i] = len(text)
            data = np.frombuffer(b"".join(self.bytes[i] for i in sorted(self.bytes)), np.uint8)
            begin = np.cumsum(np.maximum(lens, 0)) - np.maximum(lens, 0)
            self._table = lens, begin, data
        lens, begin, data = self._table
        ids = ids.astype(np.int64)
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(lens) and lens[ids].min() >= 0):
            raise KeyError("an id that the vocabulary lacks")
        n = lens[ids]
        ends = np.cumsum(n)
        return data[np.repeat(begin[ids] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)].tobytes()

    def known(self) -> int:
        """How many pairs of tokens are remembered."""
        return len(self._agree)

    def forget(self) -> None:
        self._agree.clear()

    def whole(self, token: int) -> bool:
        """Whether the merges make this one token of its bytes."""
        known = self._whole.get(token)
        if known is None:
            if token not in self.parts:
                known = len(self.bytes[token]) == 1
            else:
                a, b, rank = self.parts[token]
                known = self.whole(a) and self.whole(b) and not self._merges_across(a, b, rank)
            self._whole[token] = known
        return known


class Transducer:
    """Texts to token ids. Deterministic states and transitions are made when first needed."""

    def __init__(self, vocabulary: Vocabulary, max_states: int = MAX_STATES):
        self.v = vocabulary
        self.max_states = max_states
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, text in vocabulary.bytes.items():
            at = 0
            for b in text:
                to = self.children[at].get(b)
                if to is None:
                    to = self.children[at][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                at = to
            self.token_at[at] = token
        self.kinds = code_point_classes()
        self._clear()

    def _clear(self) -> None:
        self._clear_states()
        self.outputs: dict[tuple[int, ...], int] = {(): 0}
        self._flat: np.ndarray | None = None
        self.out_ids, self.out_len = [()], np.zeros(1024, np.int32)

    def _clear_states(self) -> None:
        self.v.forget()
        self.states: dict[tuple, int] = {}
        self.readings: list[tuple] = []
        self.delta = np.full(1024 * WIDTH, -1, np.int32)
        self.next = np.zeros(4096, np.int32)
        self.out = np.zeros(4096, np.int32)
        self.made = 0
        self._state((((), -1, 0),))

    def _restart(self, state: np.ndarray) -> np.ndarray:
        """Makes the table anew with only the states that lanes are in, and returns what these are now."""
        live, at = np.unique(state, return_inverse=True)
        kept = [self.readings[s // WIDTH] for s in live.tolist()]
        self._clear_states()
        return np.array([self._state(r) * WIDTH for r in kept], np.int32)[at]

    def _state(self, readings: tuple) -> int:
        s = self.states.get(readings)
        if s is None:
            s = self.states[readings] = len(self.readings)
            self.readings.append(readings)
            if (s + 1) * WIDTH > len(self.delta):
                self.delta = np.concatenate([self.delta, np.full(len(self.delta), -1, np.int32)])
        return s

    def _output(self, ids: tuple[int, ...]) -> int:
        n = self.outputs.get(ids)
        if n is None:
            n = self.outputs[ids] = len(self.out_ids)
            self.out_ids.append(ids)
            if n >= len(self.out_len):
                self.out_len = np.concatenate([self.out_len, np.zeros_like(self.out_len)])
            self.out_len[n] = len(ids)
            self._flat = None
        return n

    def _flush(self, s: int) -> tuple[int, ...]:
        """The tokens still held back where a piece ends: those of the reading with no token begun."""
        return next(held for held, _, node in self.readings[s] if node == 0)

    def _step(self, s: int, byte: int) -> tuple[tuple[int, ...], tuple]:
        after = []
        for held, last, node in self.readings[s]:
            to = self.children[node].get(byte)
            if to is None:
                continue
            token = self.token_at[to]
            if token >= 0 and self.v.whole(token) and (last < 0 or self.v.agree(last, token)):
                after.append(((*held, token), token, 0))
            if self.children[to]:
                after.append((held, last, to))
        first = min(after, key=lambda r: len(r[0]))[0]
        common = 0
        while common < len(first) and all(r[0][common] == first[common] for r in after):
            common += 1
        rest = tuple(sorted((held[common:], last, node) for held, last, node in after))
        return first[:common], rest

    def _transition(self, cell: int) -> None:
        s, symbol = divmod(cell, WIDTH)
        if symbol == FLUSH:
            ids, to = self._flush(s), 0
        elif symbol >= 256:
            more, readings = self._step(0, symbol - 256)
            ids, to = self._flush(s) + more, self._state(readings)
        else:
            ids, readings = self._step(s, symbol)
            to = self._state(readings)
        if self.made == len(self.next):
            self.next = np.concatenate([self.next, np.zeros_like(self.next)])
            self.out = np.concatenate([self.out, np.zeros_like(self.out)])
        self.next[self.made] = to * WIDTH
        self.out[self.made] = self._output(ids)
        self.delta[cell] = self.made
        self.made += 1

    def _missing(self, cells: np.ndarray) -> None:
        for cell in np.unique(cells).tolist():
            self._transition(cell)

    def pieces(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each byte of the texts, which end at ``ends``, whether a piece starts there."""
        n = len(data)
        flags = np.zeros(n + 1, bool)
        if not n:
            return flags[:0]
        lead = (data & 0xC0) != 0x80
        at = None
        if lead.all() and data.max() < 128:
            points = data.astype(np.int32)
        else:
            at = np.flatnonzero(lead)
            b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
            b0, b1, b2, b3 = b[at], b[at + 1] & 63, b[at + 2] & 63, b[at + 3] & 63
            points = np.where(
                b0 < 0x80,
                b0,
                np.where(
                    b0 < 0xE0,
                    (b0 & 31) << 6 | b1,
                    np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3),
                ),
            )
            ends = np.searchsorted(at, ends)
        m = len(points)
        kind = self.kinds[points]
        stop = np.zeros(m + 1, bool)  # a text starts here, or all end
        stop[0] = stop[m] = True
        stop[ends[ends <= m]] = True
        starts = np.empty(m, bool)
        starts[0] = True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:])
        starts |= stop[:m]
        space = kind == SPACE
        # The last white space before something else is a piece, or a blank goes to what follows.
        last = np.zeros(m, bool)
        last[:-1] = space[:-1] & ~space[1:]
        last &= ~stop[1:]
        starts |= last
        blank = last & (points == 32)
        starts[1:] &= ~blank[:-1]
        for i in np.flatnonzero((points == 39) & starts).tolist():
            for ending in ENDINGS:
                e = len(ending)
                if i + e < m and not stop[i + 1 : i + e + 1].any() and all(points[i + 1 + k] == ending[k] for k in range(e)):
                    starts[i + 1] = False
                    if i + 1 + e < m:
                        starts[i + 1 + e] |= not (space[i + e])
                    break
        if at is None:
            return starts
        flags[at] = starts
        return flags[:n]

    def run(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The outputs of all texts in order, and how many slots of it belong to each text."""
        if len(self.readings) > self.max_states or len(self.out_ids) > self.max_states or self.v.known() > 8 * self.max_states:
            self._clear()
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        flags = self.pieces(data, ends)
        first = np.zeros(n, bool)
        begins = np.concatenate([[0], ends[:-1]])
        first[begins[begins < n]] = True
        at = np.flatnonzero(flags)
        lane = at // LANE
        keep = first[at]
        keep[0] = True
        keep[1:] |= lane[1:] != lane[:-1]
        start = at[keep]
        length = np.diff(np.append(start, n)) + 1
        begin = start + np.arange(len(start))
        symbols = np.empty(n + len(start), np.int32)
        is_flush = np.zeros(n + len(start), bool)
        is_flush[begin + length - 1] = True
        symbols[is_flush] = FLUSH
        symbols[~is_flush] = data.astype(np.int32) + (flags.astype(np.int32) << 8)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        active = len(order) - np.searchsorted(length[::-1], np.arange(1, length[0] + 1))
        taken = np.zeros(len(symbols), np.int32)
        state = np.zeros(len(order), np.int32)
        for t, k in enumerate(active.tolist()):
            where = begin[:k] + t
            cell = state[:k] + symbols[where]
            move = self.delta[cell]
            if move.min() < 0:
                if len(self.readings) > self.max_states + len(order):
                    state[:k] = self._restart(state[:k])
                    cell = state[:k] + symbols[where]
                    move = self.delta[cell]
                self._missing(cell[move < 0])
                move = self.delta[cell]
            taken[where] = self.out[move]
            state[:k] = self.next[move]
        lanes_before = np.searchsorted(start, ends)
        slots = np.diff(np.concatenate([[0], ends + lanes_before]))
        return taken, slots

    def _expand(self, outputs: np.ndarray) -> np.ndarray:
        outputs = outputs[outputs > 0]
        if self._flat is None:
            self._flat = np.array([i for ids in self.out_ids for i in ids], np.int32)
            lens = np.array([len(ids) for ids in self.out_ids])
            self._from = np.cumsum(lens) - lens
        lens = self.out_len[outputs]
        ends = np.cumsum(lens, dtype=np.int64)
        return self._flat[np.repeat(self._from[outputs] - ends + lens, lens) + np.arange(ends[-1] if len(lens) else 0)]

    def _all(self, data: np.ndarray, ends: np.ndarray, ids: bool) -> tuple[list[np.ndarray], np.ndarray]:
        found, counts = [np.zeros(0, np.int32)], np.zeros(len(ends), np.int64)
        cut, text = cut_long(data, ends)
        for i, j in chunks(np.concatenate([[0], cut])):
            start = cut[i - 1] if i else 0
            outputs, slots = self.run(data[start : cut[j - 1]], cut[i:j] - start)
            total = np.concatenate([[0], np.cumsum(self.out_len[outputs], dtype=np.int64)])
            np.add.at(counts, text[i:j], np.diff(total[np.concatenate([[0], np.cumsum(slots)])]))
            if ids:
                found.append(self._expand(outputs))
        return found, counts

    def count(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many tokens each text has."""
        return self._all(data, ends, False)[1]

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many each text has."""
        ids, counts = self._all(data, ends, True)
        return np.concatenate(ids), counts


def cut_long(data: np.ndarray, ends: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Where parts of texts end, and the text of each part. Only texts longer than ``size`` have several.

    A text may be cut between an ASCII letter or digit and a blank or line end: a piece always starts there,
    and nothing on one side bears on the other.
    """
    begins = np.concatenate([[0], ends[:-1]])
    out, text = [], []
    for n in np.flatnonzero(ends - begins > size).tolist():
        at = int(begins[n])
        while ends[n] - at > size:
            a, b = data[at + size // 2 : ends[n] - 1], data[at + size // 2 + 1 : ends[n]]
            step = 1 << 16
            cut = None
            for i in range(0, len(a), step):
                x, y = a[i : i + step], b[i : i + step]
                alnum = ((x >= 48) & (x <= 57)) | ((x | 32) >= 97) & ((x | 32) <= 122)
                hit = np.flatnonzero(alnum & ((y == 32) | (y == 10) | (y == 13)))
                if len(hit):
                    cut = at + size // 2 + 1 + i + int(hit[0])
                    break
            if cut is None:
                break
            out.append(cut)
            text.append(n)
            at = cut
    cuts = np.concatenate([ends, np.array(out, np.int64)]).astype(np.int64)
    texts = np.concatenate([np.arange(len(ends)), np.array(text, np.int64)])
    order = np.lexsort([texts, cuts])
    return cuts[order], texts[order]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have about ``size`` bytes together; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = j


class StreamDecoder:
    """Ids to text as they come. An incremental UTF-8 state machine holds back the bytes of a
    code point that isn't whole yet; bytes that can't be UTF-8 give U+FFFD."""

    def __init__(self, token_bytes: dict[int, bytes]):
        import codecs

        self.token_bytes = token_bytes
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self.push_bytes(b"".join([self.token_bytes[i] for i in ids]))

    def push_bytes(self, data: bytes) -> str:
        return self._machine.decode(data)

    def close(self) -> str:
        return self._machine.decode(b"", True)
