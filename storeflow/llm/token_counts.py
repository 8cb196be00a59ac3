"""Token counts by a compiled finite-state tokenizer.

The tokenizer (pre-tokenizer, then byte-level BPE inside each piece) is run
as two deterministic transducers whose transitions carry counts:

* the pre-tokenizer (``pretoken.py``) marks piece starts; texts are cut into
  chunks, each chunk gives a state map, and a parallel prefix scan composes
  the maps;
* inside a piece, the BPE machine reads bytes. Let c(x) be the number of
  tokens of a prefix x. Its transition from x to xb emits c(xb) - c(x), so
  the counts along a path add up to the tokens of the piece.

What the BPE machine must remember of a prefix x is finite: the node of the
vocabulary's trie reached by the longest suffix of x that some token begins
with, and, for every shorter such suffix, the last token before it and how
many tokens fewer that is. The encoding of xb ends in the one token t, a
suffix of xb, such that t and the last token before it stay two tokens when
encoded together; both are in that memory. States and transitions are
compiled when first met and kept per Python worker.

Null text counts as empty and has no tokens; extra columns are ignored; rows
that repeat a doc_id each give a row; an empty table gives an empty result.
A special token's string inside a text is one token, and the text on either
side of it is tokenized by itself, which is the library's default.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T
from .pretoken import pieces
from .stages import keyed_text

#: Compiled states, and counted pieces, kept by a worker before it starts afresh.
MAX_STATES = 400_000
MAX_PIECES = 1_000_000


def _byte_letters() -> dict[str, int]:
    """The vocabulary file's letter of each byte: printable Latin-1 stands
    for itself, the other bytes follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Transducer:
    """The BPE machine of a vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = _byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.tokens = [bytes([b]) for b in range(256)]
        number = {t: i for i, t in enumerate(self.tokens)}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, token)
        for rank, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            if a + b not in number:
                number[a + b] = len(self.tokens)
                self.tokens.append(a + b)
            self.merge[number[a], number[b]] = rank, number[a + b]
        self.specials = [t["content"].encode() for t in spec.get("added_tokens", []) if t.get("special")]
        self._trie()
        self._pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def _trie(self) -> None:
        """Trie of all tokens with suffix links (nodes in breadth-first
        order) and the token that each node spells, or -1."""
        self.child: list[dict[int, int]] = [{}]
        self.spells, self.depth, self.link = [-1], [0], [0]
        for i, t in enumerate(self.tokens):
            node = 0
            for b in t:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.spells.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.link.append(0)
                node = nxt
            self.spells[node] = i
        queue = list(self.child[0].values())
        for node in queue:
            for b, nxt in self.child[node].items():
                self.link[nxt] = self._go(self.link[node], b)
                queue.append(nxt)

    def _go(self, node: int, b: int) -> int:
        while b not in self.child[node]:
            if not node:
                return 0
            node = self.link[node]
        return self.child[node][b]

    def _stay_two(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens encode to just these two."""
        found = self._pairs.get((a, b))
        if found is None:
            ids = list(self.tokens[a] + self.tokens[b])
            while len(ids) > 1:
                best = min(range(len(ids) - 1), key=lambda k: self.merge.get((ids[k], ids[k + 1]), (1 << 60,))[0])
                made = self.merge.get((ids[best], ids[best + 1]))
                if made is None:
                    break
                ids[best: best + 2] = [made[1]]
            found = self._pairs[a, b] = ids == [a, b]
        return found

    # A state is (node, ((suffix length, last token before it, tokens fewer), ...)),
    # longest suffix first, down to length 0. Token -1: the piece begins there.

    def reset(self) -> None:
        start = (0, ((0, -1, 0),))
        self.states, self.number = [start], {start: 0}
        self.moves: dict[int, int] = {}  # state << 8 | byte -> next << 8 | (128 + count)
        if len(self._pairs) > 4 * MAX_STATES:
            self._pairs = {}

    def _compile(self, state: int, b: int) -> int:
        node, memory = self.states[state]
        before = {length: (last, fewer) for length, last, fewer in memory}
        to = self._go(node, b)
        # the last token of the longer prefix: a suffix that fits what precedes it
        at = to
        while True:
            t = self.spells[at]
            if t >= 0:
                last, fewer = before[self.depth[at] - 1]
                if last == -1 or self._stay_two(last, t):
                    break
            at = self.link[at]
        count = 1 - fewer  # c(xb) - c(x)
        keep = []
        at = to
        while at:
            last, less = before[self.depth[at] - 1]
            keep.append((self.depth[at], last, less + count))
            at = self.link[at]
        keep.append((0, t, 0))
        key = (to, tuple(keep))
        nxt = self.number.get(key)
        if nxt is None:
            nxt = self.number[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state << 8 | b] = nxt << 8 | (128 + count)
        return move

    def count(self, piece: bytes) -> int:
        """Tokens of one piece: the sum of the counts on its path."""
        if len(self.states) > MAX_STATES:
            self.reset()
        state = total = 0
        moves = self.moves
        for b in piece:
            move = moves.get(state << 8 | b)
            if move is None:
                move = self._compile(state, b)
            total += (move & 255) - 128
            state = move >> 8
        return total


def cut_specials(data: np.ndarray, offsets: np.ndarray, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with the strings of special tokens taken out: bytes, offsets of
    the parts between them, and the text of each part. A text with k of
    them has k + 1 parts."""
    raw = data.tobytes()
    found = []
    for s in specials:
        at = raw.find(s)
        while at >= 0:
            i = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(s) <= offsets[i + 1]:
                found.append((at, at + len(s)))
                at = raw.find(s, at + len(s))
            else:
                at = raw.find(s, at + 1)
    if not found:
        return data, offsets, np.arange(len(offsets) - 1)
    spans = np.array(sorted(found))
    keep = np.ones(len(data), bool)
    for a, b in spans:
        keep[a:b] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    cuts = np.sort(np.concatenate([offsets[:-1], spans[:, 0]]), kind="stable")
    text = np.sort(np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, spans[:, 0], "right") - 1]))
    return data[keep], np.append(kept[cuts], kept[-1]), text


class Counter:
    """Counts tokens of blocks, keeping the counts of pieces it has met."""

    def __init__(self, path: str):
        self.machine = Transducer(path)
        self.known: dict[bytes, int] = {}

    def block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a block."""
        n = len(offsets) - 1
        plain, cuts, text = cut_specials(data, offsets, self.machine.specials)
        starts, ends, first = pieces(plain, cuts)
        total = np.bincount(text, minlength=n) - 1  # one for each special token
        if not len(starts):
            return total
        one, number = T.distinct_spans(plain, starts, ends)
        if len(self.known) > MAX_PIECES:
            self.known = {}
        raw, known, count = plain.tobytes(), self.known, self.machine.count
        tokens = []
        for a, b in zip(starts[one].tolist(), ends[one].tolist()):
            piece = raw[a:b]
            c = known.get(piece)
            if c is None:
                c = known[piece] = count(piece)
            tokens.append(c)
        running = np.concatenate([[0], np.cumsum(np.array(tokens, np.int64)[number])])
        return total + np.bincount(text, running[first[1:]] - running[first[:-1]], minlength=n).astype(np.int64)


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens for every text, by the vocabulary
    file at ``path`` (present on every machine)."""
    def run(batches):
        if path not in _counters:
            _counters[path] = Counter(path)
        for rows, data, offsets in T.blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(offsets)), pa.array(_counters[path].block(data, offsets))],
                names=["doc_id", "n_bytes", "n_tokens"])

    return keyed_text(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
