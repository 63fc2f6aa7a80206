"""Token counts by a compiled finite-state transducer (operator 10).

The tokenizer is sentencepiece BPE with byte fallback whose pieces hold the
space mark only at their start, so no token reaches over the start of a unit: a
run of spaces and the symbols up to the next space.

The transducer is compiled from the model's pieces and scores alone. BPE has a
property that makes it finite-state: of all pieces that end a prefix of a text,
the last token of that prefix is the one whose left neighbour, the last token of
the prefix before it, stays itself beside it (the pair, tokenized, is the pair).
So a state is what later pieces can still reach: the longest suffix that begins
some piece, with the last token and the tokens counted at each of its places,
counts relative to the present one. A transition is annotated with the change
that its symbol makes to the number of tokens; it may be negative, where a
longer piece takes the place of several. The count of a text is the sum of its
annotations. Determinisation is lazy, as usual where the whole automaton would
be large: a state's transition is worked out from the model when a symbol first
takes it, and stays in the worker's tables for all texts (STATES at most, then
they start anew). What a pair of pieces makes is a table of its own.

A stretch of symbols is cut in chunks of CHUNK, wherever that falls, which run
in lockstep. A chunk's state map is constant if a unit starts in it or shortly
before it (WARM symbols); else it is evaluated at the state that those symbols
lead to. The scan passes from chunk to chunk: where a chunk's entry is the exit
of the one before, its map is composed as it is; where not, its path is walked
from the right entry until it meets the path already known, so results are exact
for any text. Long texts go through in segments that hand on their state.

Defined results: null text is empty and has no tokens; texts of any length
count whole, in bounded memory; repeated rows give repeated results; a null
doc_id stays null. Extra columns, clashing names included, don't come through;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import HashIndex, mapped, mix, pick, slices, text_buffer

#: Symbols of a chunk, and of the stretch before it that guesses its entry.
CHUNK, WARM = 128, 32
#: Bytes of a long text that are decoded at one time.
SEGMENT = 1 << 19
#: States compiled at most; beyond it a worker's tables start anew.
STATES = 400_000
SPACE = 0x20
MARK = "▁"


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a sentencepiece model file."""
    with open(path, "rb") as f:
        b = f.read()

    def fields(b):
        i = 0
        while i < len(b):
            key, i = number(b, i)
            if key & 7 == 0:
                v, i = number(b, i)
            else:
                n, i = {5: (4, i), 1: (8, i)}[key & 7] if key & 7 != 2 else number(b, i)
                v, i = b[i:i + n], i + n
            yield key >> 3, v

    def number(b, i):
        r = s = 0
        while True:
            r |= (b[i] & 127) << s
            s, i = s + 7, i + 1
            if b[i - 1] < 128:
                return r, i

    pieces, norm, kind = [], {}, 1
    for k, v in fields(b):
        if k == 1:
            p = dict(fields(v))
            pieces.append((p[1].decode(), float(np.frombuffer(p.get(2, bytes(4)), "<f4")[0]), p.get(3, 1)))
        elif k == 2:
            kind = dict(fields(v)).get(3, 1)
        elif k == 3:
            norm = dict(fields(v))
    if kind != 2:
        raise ValueError("not a BPE model")
    if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1):
        raise ValueError("only models that leave texts as they are, with a space before, are supported")
    return pieces


class Model:
    """Pieces and merges, and which pieces can stand beside each other."""

    def __init__(self, path: str):
        pieces = read_model(path)
        if any(MARK in p.lstrip(MARK) for p, _, t in pieces if t in (1, 4)):
            raise ValueError("a piece holds a space mark after other symbols")
        if any(t in (4, 5) for _, _, t in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.rank = {p: -s for p, s, t in pieces if t == 1}
        self.symbols = {p for p in self.rank if len(p) == 1}
        if any(c not in self.symbols for p in self.rank for c in p):
            raise ValueError("a piece holds a symbol that is no piece")
        self.begins = {p[:k] for p in self.rank for k in range(1, len(p))}
        self._whole: dict[str, bool] = {}
        self._beside: dict[tuple[str, str], bool] = {}

    def merge(self, parts: list[str]) -> list[str]:
        """The tokens of few symbols: the best pair first, the leftmost of
        equals."""
        parts = list(parts)
        while True:
            ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks, default=np.inf)
            if best == np.inf:
                return parts
            k = ranks.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def whole(self, piece: str) -> bool:
        """Whether a string is a piece that its own symbols make."""
        got = self._whole.get(piece)
        if got is None:
            got = self._whole[piece] = piece in self.rank and self.merge(list(piece)) == [piece]
        return got

    def forget(self) -> None:
        self._whole.clear()
        self._beside.clear()

    def beside(self, a: str, b: str) -> bool:
        """Whether the tokens a and b stay what they are next to each other."""
        got = self._beside.get((a, b))
        if got is None:
            got = self._beside[a, b] = self.merge(list(a + b)) == [a, b]
        return got


class Transducer:
    """States and transitions over symbols (code points). State 0 is before a
    unit and behind a symbol without a piece, which joins with nothing."""

    def __init__(self, model: Model):
        self.model = model
        known = np.zeros(0x110000, bool)
        known[[ord(c) for c in model.symbols]] = True
        self.known = known
        self.clear()

    def clear(self) -> None:
        # (suffix, last token before each of its symbols and at its end, tokens
        # counted since then).
        self.states: list[tuple] = [("", ("",), (0,))]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.model.forget()
        self.table = HashIndex()
        self.next = np.zeros(1 << 10, np.int32)
        self.change = np.zeros(1 << 10, np.int32)

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, change of the count) of a transition, from the model."""
        suffix, tokens, since = self.states[state]
        text, m = suffix + chr(symbol), self.model
        for k in range(len(text)):
            piece = text[k:]
            if m.whole(piece) and (not tokens[k] or m.beside(tokens[k], piece)):
                break
        else:
            raise AssertionError("no token ends here")
        change = 1 - since[k]
        keep = next((j for j in range(len(text)) if text[j:] in m.begins), len(text))
        new = (text[keep:], (*tokens[keep:], piece), (*[x + change for x in since[keep:]], 0))
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
        return number, change

    def _learn(self, keys: np.ndarray) -> None:
        """Compile the transitions of new keys (state, symbol)."""
        first, last = self.table.n, self.table.n + len(keys)
        if last > len(self.next):
            size = 1 << int(last).bit_length()
            self.next, self.change = (np.concatenate([x, np.zeros(size - len(x), np.int32)]) for x in (self.next, self.change))
        for i, k in enumerate(keys.tolist()):
            self.next[first + i], self.change[first + i] = self._compile(k >> 21, k & 0x1FFFFF)
        self.table.add(mix(keys.astype(np.uint64)))

    def move(self, state: np.ndarray, symbol: np.ndarray, known: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of many states at once."""
        key = (state.astype(np.int64) << 21) | symbol
        at = self.table.get(mix(key.astype(np.uint64)))
        new = np.flatnonzero((at < 0) & known)
        if len(new):
            self._learn(np.unique(key[new]))
            at[new] = self.table.get(mix(key[new].astype(np.uint64)))
        at[~known] = 0
        return np.where(known, self.next[at], 0), np.where(known, self.change[at], alone)

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """One move; those made one by one are kept in a dictionary, too."""
        key = (state << 21) | symbol
        got = self.moves.get(key)
        if got is None:
            one, yes = np.array([state]), np.array([True])
            new, change = self.move(one, np.array([symbol]), yes, one)
            got = self.moves[key] = int(new[0]), int(change[0])
        return got

    def run(self, symbols: np.ndarray, starts: np.ndarray, alone: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """(change of the count at each symbol, last state) of a stretch that
        is entered in a state. starts: where units start; alone: tokens that a
        symbol without a piece is."""
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int64), entry
        rows = -(-n // CHUNK)
        place = np.arange(rows)[None, :] * CHUNK + np.arange(-WARM, CHUNK)[:, None]
        real = (place >= 0) & (place < n)
        place = np.clip(place, 0, n - 1)
        sym, begin, one = symbols[place].astype(np.int64), starts[place] & real, alone[place]
        known = self.known[sym]
        state = np.zeros(rows, np.int64)
        path = np.zeros((CHUNK + 1, rows), np.int32)
        change = np.zeros((CHUNK, rows), np.int32)
        for j in range(WARM + CHUNK):
            if j == WARM:
                state[0] = entry
                path[0] = state
            live = real[j]
            new, got = self.move(np.where(begin[j], 0, state), sym[j], known[j] & live, one[j])
            state = np.where(live, new, state)
            if j >= WARM:
                path[j - WARM + 1] = state
                change[j - WARM] = np.where(live, got, 0)
        # The scan over the chunks' maps.
        leaves = path[CHUNK].copy()
        c = 1
        while c < rows:
            wrong = np.flatnonzero(path[0, c:] != leaves[c - 1:-1])
            if not len(wrong):
                break
            c += int(wrong[0])
            now = int(leaves[c - 1])
            path[0, c] = now
            for j in range(min(CHUNK, n - c * CHUNK)):
                if starts[c * CHUNK + j]:
                    now = 0
                x = int(symbols[c * CHUNK + j])
                now, change[j, c] = self.step(now, x) if self.known[x] else (0, int(alone[c * CHUNK + j]))
                if now == path[j + 1, c]:
                    break
                path[j + 1, c] = now
            else:
                path[min(CHUNK, n - c * CHUNK):, c] = now
                leaves[c] = now
            c += 1
        return change.T.ravel()[:n].astype(np.int64), int(leaves[-1])


class TextCounts:
    """Numbers of tokens of whole texts."""

    def __init__(self, path: str):
        self.machine = Transducer(Model(path))

    def _stretch(self, data: bytes, entry: int, last_space: bool, at: np.ndarray) -> tuple[np.ndarray, int, bool]:
        """(tokens of each text, last state, whether it ends in a space) of
        bytes that texts begin in at the places `at` (a first piece without a
        beginning comes before them)."""
        symbols = np.frombuffer(data.decode().encode("utf-32-le"), "<u4").astype(np.int32)
        symbols[symbols == ord(MARK)] = SPACE  # the mark itself is a space to the model
        lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        chars = np.concatenate([[0], np.cumsum(lead)])[at]
        # Each text has a space put before it, where its first unit starts.
        put = chars + np.arange(len(at))
        own = np.ones(len(symbols) + len(at), bool)
        own[put] = False
        wide = np.full(len(own), SPACE, np.int32)
        wide[own] = symbols
        space = wide == SPACE
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[:1] &= not last_space
        starts[put] = True
        alone = 1 + (wide > 0x7F).astype(np.int32) + (wide > 0x7FF) + (wide > 0xFFFF)
        wide[space] = ord(MARK)
        change, state = self.machine.run(wide, starts, alone, entry)
        total = np.concatenate([[0], np.cumsum(change)])
        return np.diff(total[np.concatenate([[0], put, [len(wide)]])]), state, bool(len(space) and space[-1])

    def count(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each document of a slice."""
        if len(self.machine.states) + len(self.machine.moves) > STATES:
            self.machine.clear()
        out = np.zeros(len(off) - 1, np.int64)
        full = np.flatnonzero(np.diff(off))
        if not len(full):
            return out
        if len(buf) <= 2 * SEGMENT:
            out[full] = self._stretch(buf.tobytes(), 0, False, off[full] - off[0])[0][1:]
            return out
        for d in full:
            at, end, state, space, begin = int(off[d]), int(off[d + 1]), 0, False, np.zeros(1, np.int64)
            while at < end:
                to = min(at + SEGMENT, end)
                while to < end and buf[to] & 0xC0 == 0x80:
                    to -= 1
                got, state, space = self._stretch(buf[at:to].tobytes(), state, space, begin)
                out[d] += got.sum()
                at, begin = to, np.zeros(0, np.int64)
        return out


_COUNTERS: dict[str, TextCounts] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). A narrow map."""

    def run(batches):
        if path not in _COUNTERS:
            _COUNTERS[path] = TextCounts(path)
        c = _COUNTERS[path]
        for b in batches:
            buf, off = text_buffer(b.column("text"))
            n = [c.count(buf[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in slices(off)]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    d = pick(docs, "doc_id", "text")
    return d.select(d.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(
        mapped(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
