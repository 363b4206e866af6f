"""Vectorised splitting of texts into the pieces that byte-level BPE merges
within, by two public split patterns:

* ``gpt`` (the one in the rank files' README):
  's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^ S L N]+|S+(?!not S)|S+
* ``clip``: 's|'t|'re|'ve|'m|'ll|'d|L+|N|[^ S L N]+ with white space dropped

(L letters, N numbers, S white space). Positions come from character classes
and class changes over whole texts at once, not from a regex walk.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# Code points with the Unicode White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)),
                    np.uint8, 0x110000)
    t[WHITE_SPACE] = SPACE
    return t


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def split_points(text: str, doc_starts: np.ndarray, attach_space: bool):
    """(starts, ends) of the pieces of ``text``; it holds several documents,
    which begin at ``doc_starts``, and no piece crosses a document."""
    cp = code_points(text)
    n = len(cp)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = char_classes()[cp]
    first = np.zeros(n + 1, bool)
    first[doc_starts[doc_starts < n]] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(c[1:], c[:-1], out=change[1:])
    change |= first[:n]
    st = np.zeros(n, bool)
    runs = np.flatnonzero(change & (c != SPACE))
    if attach_space:
        st[np.flatnonzero(change & (c == SPACE))] = True
        inner = runs[~first[runs]]
        after_space = inner[c[inner - 1] == SPACE]
        st[after_space - 1] = True
        plain = np.ones(len(runs), bool)
        pos = ~first[runs]
        plain[pos] = cp[runs[pos] - 1] != 32
        st[runs[plain]] = True
    else:
        st[change] = True
        st[c == NUMBER] = True
    # contractions: a lone apostrophe that opens a piece, then s t m d or re ve ll
    ap = np.flatnonzero((cp == 39) & st)
    ap = ap[change[ap] & (ap + 1 < n)]
    ap = ap[~first[ap + 1]]
    if len(ap):
        x = cp[ap + 1]
        two = np.zeros(len(ap), np.uint32)
        ok2 = (ap + 2 < n)
        ok2[ok2] = ~first[ap[ok2] + 2]
        two[ok2] = cp[ap[ok2] + 2]
        one = np.isin(x, [ord(ch) for ch in "stmd"])
        pair = ((x == ord("r")) & (two == ord("e"))) | ((x == ord("v")) & (two == ord("e"))) \
            | ((x == ord("l")) & (two == ord("l")))
        for sel, k in ((one, 1), (pair, 2)):
            a = ap[sel]
            st[a + 1] = False
            e = a + 1 + k
            e = e[e < n]
            e = e[(c[e] == LETTER) & ~first[e]]
            st[e] = True
    starts = np.flatnonzero(st)
    ends = np.append(starts[1:], n)
    if not attach_space:
        keep = c[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends


class Interner(dict):
    """Piece -> dense number, in order of first sight; ``order`` lists them."""

    def __init__(self):
        super().__init__()
        self.order: list[str] = []

    def __missing__(self, key):
        self[key] = v = len(self)
        self.order.append(key)
        return v


HASH_BASE = 0x9E3779B97F4A7C15  # any odd number does
HASHED_LENGTH = 64  # longer pieces are told apart by their text


@lru_cache(maxsize=1)
def _powers(n: int):
    """Powers of the hash base and of its inverse, modulo 2**64."""
    out = []
    for b in (HASH_BASE, pow(HASH_BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, out=p))
    return out


def piece_hashes(cp: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Two 64-bit hashes of each piece from prefix sums over the text: a
    polynomial one, and a sum of mixed code points that checks it."""
    n = len(cp)
    power, undo = _powers(1 << max(16, int(n - 1).bit_length()))
    x = cp.astype(np.uint64)
    x += np.uint64(1)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(x * x, out=total[1:])
    check = total[e] - total[s]
    x *= power[:n]
    np.cumsum(x, out=total[1:])
    h = (total[e] - total[s]) * undo[s]
    return h ^ (h >> np.uint64(31)), check


def intern_pieces(texts: list[str], seen: Interner, attach_space: bool = True):
    """Piece numbers of all texts in one array, and the number of pieces of
    each text. Every text is split whole; texts are joined only to share the
    array work. Equal short pieces are found by two 64-bit hashes, so that
    only one of each becomes a Python string; long ones by their text."""
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    doc_starts = np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(lens) else np.empty(0, np.int64)
    joined = "".join(texts)
    s, e = split_points(joined, doc_starts[lens > 0], attach_space)
    bounds = np.searchsorted(s, np.append(doc_starts, len(joined)), side="left")
    idx = np.empty(len(s), np.int32)
    long = (e - s) > HASHED_LENGTH
    for i in np.flatnonzero(long).tolist():
        idx[i] = seen[joined[s[i]:e[i]]]
    at = np.flatnonzero(~long)
    if len(at):
        cp = code_points(joined)
        ss, ee = s[at], e[at]
        h1, h2 = piece_hashes(cp, ss, ee)
        key = h1 + (ee - ss).astype(np.uint64)
        _, first, inv = np.unique(key, return_index=True, return_inverse=True)
        if np.array_equal(h2, h2[first][inv]):
            ids = [seen[joined[a:b]] for a, b in zip(ss[first].tolist(), ee[first].tolist())]
            idx[at] = np.array(ids, np.int32)[inv]
        else:  # a collision of the first hash
            idx[at] = [seen[joined[a:b]] for a, b in zip(ss.tolist(), ee.tolist())]
    return idx, np.diff(bounds)


def text_groups(texts, limit: int = 1 << 20):
    """Index ranges of consecutive texts of about ``limit`` characters; a
    longer text is a range of its own."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > limit:
            yield a, i
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield a, len(texts)
