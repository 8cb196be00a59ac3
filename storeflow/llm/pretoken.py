"""The pre-tokenizer of byte-level BPE as a deterministic transducer.

``public_tokenizers.PATTERN`` cuts text into pieces. Here it is a machine
with twelve states over seventeen character classes that marks where pieces
begin (a mark can come one character late: the pattern looks ahead). Texts
are cut into chunks of equal length. Each chunk gives a state map, the state
it ends in for every state it may start in; maps compose, so a parallel
prefix scan over the chunks gives the true state at each chunk's start, and
a second sweep over all chunks at once sets the marks.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

CHUNK = 128

# Character classes: letters that may follow an apostrophe stand alone.
SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, CL_STMD, CL_R, CL_V, CL_L, CL_E, START_OF_TEXT = range(12)
N_CLASSES = 12

# States: CLOSED (the next character begins a piece), inside a run of letters,
# numbers or others, a quote at a piece's start and a letter after it that may
# go on to 're 've 'll, and runs of white space of length one or more, by
# whether the last character is a plain space.
(CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L,
 ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE) = range(12)
N_STATES = 12

HERE, BEFORE = 1, 2  # a piece begins at this character, at the one before

#: Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_LETTERS = {LETTER, CL_STMD, CL_R, CL_V, CL_L, CL_E}


def _begin(c: int) -> int:
    """State after a piece has begun with class c."""
    if c in _LETTERS:
        return IN_LETTERS
    return {SPACE: ONE_SPACE, WHITE: ONE_WHITE, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: AFTER_QUOTE}[c]


def _joined(c: int) -> int:
    """State after a space has been joined by class c (not white)."""
    return IN_OTHERS if c == QUOTE else _begin(c)


def _step(state: int, c: int) -> tuple[int, int]:
    """(next state, marks) of one transition."""
    late = 0
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if c == (CL_L if state == QUOTE_L else CL_E):
            return CLOSED, 0
        late, state = BEFORE, IN_LETTERS  # no contraction: the letter began a piece
    if state == AFTER_QUOTE:
        if c == CL_STMD:
            return CLOSED, 0
        if c in (CL_R, CL_V, CL_L):
            return {CL_R: QUOTE_R, CL_V: QUOTE_V, CL_L: QUOTE_L}[c], 0
        state = IN_OTHERS
    white = c in (SPACE, WHITE)
    if state in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE):
        if white:
            return (MORE_SPACE if c == SPACE else MORE_WHITE), 0
        # of a longer run, the last character leaves the run
        late = BEFORE if state in (MORE_SPACE, MORE_WHITE) else 0
        if state in (ONE_SPACE, MORE_SPACE):
            return _joined(c), late
        return _begin(c), late | HERE
    same = {IN_LETTERS: c in _LETTERS, IN_NUMBERS: c == NUMBER, IN_OTHERS: c in (OTHER, QUOTE)}
    if same.get(state, False):
        return state, late
    return _begin(c), late | HERE


@cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks), flat by state * N_CLASSES + class. START_OF_TEXT
    closes whatever came before; the character after it begins a piece."""
    go = np.zeros(N_STATES * N_CLASSES, np.uint8)
    out = np.zeros(N_STATES * N_CLASSES, np.uint8)
    for s in range(N_STATES):
        for c in range(N_CLASSES):
            if c == START_OF_TEXT:
                move = CLOSED, BEFORE if s in (QUOTE_R, QUOTE_V, QUOTE_L) else 0
            else:
                move = _step(s, c)
            go[s * N_CLASSES + c], out[s * N_CLASSES + c] = move
    return go, out


@cache
def class_table() -> np.ndarray:
    """The class of every code point, from its Unicode category."""
    letters = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((letters.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    t[WHITE_SPACE] = WHITE
    t[0x20] = SPACE
    t[ord("'")] = QUOTE
    for c, k in (("s", CL_STMD), ("t", CL_STMD), ("m", CL_STMD), ("d", CL_STMD), ("r", CL_R), ("v", CL_V), ("l", CL_L), ("e", CL_E)):
        t[ord(c)] = k
    return t


def chunk_maps(classes: np.ndarray) -> np.ndarray:
    """State map of each chunk (rows of ``classes``): for each start state
    the state at its end."""
    go, _ = machine()
    state = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8)[:, None], (N_STATES, len(classes))).copy()
    columns = np.ascontiguousarray(classes.T)
    for column in columns:
        state = go[state * np.uint8(N_CLASSES) + column]
    return state.T


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """The state before each chunk, from CLOSED before the first: a prefix
    scan by doubling, each step composing every map with an earlier one."""
    prefix, reach = maps.copy(), 1
    while reach < len(prefix):
        prefix[reach:] = np.take_along_axis(prefix[reach:], prefix[:-reach], axis=1)
        reach *= 2
    return np.concatenate([[CLOSED], prefix[:-1, CLOSED]]).astype(np.uint8)


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """For characters of any number of texts, each preceded by one
    START_OF_TEXT: whether a piece begins at each character."""
    n = len(classes)
    rows = n // CHUNK + 1  # at least one START_OF_TEXT after the last text
    padded = np.full(rows * CHUNK, START_OF_TEXT, np.uint8)
    padded[:n] = classes
    grid = padded.reshape(rows, CHUNK)
    state = scan_maps(chunk_maps(grid))
    go, out = machine()
    marks = np.empty((CHUNK, rows), np.uint8)
    for k, column in enumerate(np.ascontiguousarray(grid.T)):
        at = state * np.uint8(N_CLASSES) + column
        marks[k] = out[at]
        state = go[at]
    marks = marks.T.reshape(-1)
    begin = (marks & HERE).astype(bool)
    begin[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return begin[:n]


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a block of UTF-8 texts: (starts, ends) in bytes, and the
    index of each text's first piece (one entry more than texts)."""
    n = len(offsets) - 1
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    at = np.cumsum(width) - width
    text_char = np.searchsorted(at, offsets[:-1])
    classes = np.insert(class_table()[code], text_char, START_OF_TEXT)
    begin = np.delete(piece_starts(classes), text_char + np.arange(n))
    starts = at[begin]
    first = np.searchsorted(starts, offsets)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return starts, ends, first
