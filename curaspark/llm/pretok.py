"""Byte-level pre-tokenisation without regular expressions.

The pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` is a small automaton over
eleven codepoint classes. Each class is a transition function on its ten states; the functions that arise by composition form
a finite monoid, so a function is one byte and composition one table look-up. An associative scan over these bytes
(blocks in parallel, then block totals, then both combined) gives the state after every codepoint; a token starts where
the states before and after a codepoint say so.
"""

from __future__ import annotations

import sys

import numpy as np
import tiktoken

#: White space as Unicode defines it.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

SPACE, BLANK, NUMBER, OTHER, APOSTROPHE, LETTER, STMD, RV, E, ELL = range(1, 11)
CLASSES = 11

# states, by what was read last: nothing, other white space, a space, a run of one class, an apostrophe at a token's
# start, that apostrophe and r or v, or and l, a whole contraction
START, AFTER_BLANK, AFTER_SPACE, IN_LETTERS, IN_NUMBER, IN_OTHER, QUOTE, QUOTE_RV, QUOTE_L, CONTRACTED = range(10)
STATES = 10


def step(state: int, cls: int) -> int:
    if cls == 0:
        return START
    if cls in (SPACE, BLANK):
        return AFTER_SPACE if cls == SPACE else AFTER_BLANK
    if cls == NUMBER:
        return IN_NUMBER
    if cls == OTHER:
        return IN_OTHER
    if cls == APOSTROPHE:
        return IN_OTHER if state in (AFTER_SPACE, IN_OTHER, QUOTE) else QUOTE
    if state == QUOTE and cls in (STMD, RV, ELL):
        return {STMD: CONTRACTED, RV: QUOTE_RV, ELL: QUOTE_L}[cls]
    if (state, cls) in ((QUOTE_RV, E), (QUOTE_L, ELL)):
        return CONTRACTED
    return IN_LETTERS


NEVER, ALWAYS, IF_SOLID_FOLLOWS, IF_NOT_CONTRACTED = range(4)


def starts_token(state: int, cls: int) -> int:
    """Whether a token starts at a codepoint of class cls read in a state."""
    if cls in (SPACE, BLANK):
        return IF_SOLID_FOLLOWS if state in (AFTER_SPACE, AFTER_BLANK) else ALWAYS
    letter = cls >= LETTER
    if state == AFTER_SPACE:
        return NEVER
    if state in (IN_LETTERS, QUOTE_RV, QUOTE_L):
        return NEVER if letter else ALWAYS
    if state == IN_NUMBER:
        return NEVER if cls == NUMBER else ALWAYS
    if state == IN_OTHER:
        return NEVER if cls in (OTHER, APOSTROPHE) else ALWAYS
    if state == QUOTE:
        if cls in (OTHER, APOSTROPHE, STMD):
            return NEVER
        return IF_NOT_CONTRACTED if cls in (RV, ELL) else ALWAYS
    return ALWAYS


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products and actions of all functions that compositions of the classes give; each class's element."""
    gens = [tuple(step(s, c) for s in range(STATES)) for c in range(CLASSES)]
    elements = list(dict.fromkeys([tuple(range(STATES)), *gens]))
    index = {f: i for i, f in enumerate(elements)}
    for f in elements:  # grows while it is read
        for g in gens:
            h = tuple(g[s] for s in f)
            if h not in index:
                index[h] = len(elements)
                elements.append(h)
    m = len(elements)
    assert m <= 256
    act = np.array(elements, np.uint8)
    product = np.empty((m, m), np.uint8)
    for i, f in enumerate(elements):
        for j, g in enumerate(elements):
            product[i, j] = index[tuple(g[s] for s in f)]
    return product, act, np.array([index[g] for g in gens], np.uint8)


PRODUCT, ACT, ELEMENT = _monoid()
RULE = np.array([[starts_token(s, c) for c in range(CLASSES)] for s in range(STATES)], np.uint8)
_table: np.ndarray | None = None


def members(pattern: str) -> np.ndarray:
    """The codepoints that the library counts to a class: of a text of all codepoints it encodes those that match, as bytes."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    found = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(every)
    return np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)


def class_table() -> np.ndarray:
    """The class of every codepoint, by the Unicode version of the library (newer than Python's own)."""
    global _table
    if _table is None:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        table[members(r"\p{L}+")] = LETTER
        table[members(r"\p{N}+")] = NUMBER
        table[SPACES] = BLANK
        table[0x20] = SPACE
        table[ord("'")] = APOSTROPHE
        for letters, cls in (("stmd", STMD), ("rv", RV), ("e", E), ("l", ELL)):
            table[[ord(x) for x in letters]] = cls
        _table = table
    return _table


BLOCK = 64


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of monoid elements (element 0 is the identity)."""
    n = len(functions)
    if n <= BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = PRODUCT[out[i - 1], functions[i]]
        return out
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat, width = PRODUCT.ravel(), len(PRODUCT)
    for j in range(1, BLOCK):
        grid[j] = flat[grid[j - 1].astype(np.int32) * width + grid[j]]
    before = np.zeros(rows, np.uint8)
    before[1:] = scan(grid[-1])[:-1]
    out = PRODUCT[before[None, :], grid]
    return np.ascontiguousarray(out.T).ravel()[:n]


def boundaries(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets in raw where tokens start. Rows (off: n+1 byte offsets from 0) never share a token."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    if raw.max() < 0x80:
        points, chars = raw, None
    else:
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        chars = np.flatnonzero((raw & 0xC0) != 0x80)
    cls = class_table()[points]
    edges = off if chars is None else np.searchsorted(chars, off)
    m = len(cls)
    heads = edges[:-1][edges[:-1] < edges[1:]]
    functions = ELEMENT[cls]
    functions[heads] = PRODUCT[ELEMENT[0], functions[heads]]  # a row starts anew
    after = ACT[scan(functions), START]
    before = np.empty(m, np.uint8)
    before[1:] = after[:-1]
    before[heads] = START
    rule = RULE[before, cls]
    last = np.zeros(m, bool)
    last[heads[1:] - 1] = True
    last[-1] = True
    follows = np.zeros(m, bool)
    follows[:-1] = (cls[1:] > BLANK) & ~last[:-1]
    contracted = np.zeros(m, bool)
    contracted[:-1] = (after[1:] == CONTRACTED) & ~last[:-1]
    begins = (rule == ALWAYS) | ((rule == IF_SOLID_FOLLOWS) & follows) | ((rule == IF_NOT_CONTRACTED) & ~contracted)
    starts = np.flatnonzero(begins)
    return starts if chars is None else chars[starts]
