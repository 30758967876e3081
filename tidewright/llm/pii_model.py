"""A character-level bidirectional LSTM with CRF transitions, in numpy.

A step reads `CHARS` characters, each through a table of its own place, and gives scores for all of them, so the
tags stay on characters while the recurrence is shorter. Gates and cells are clipped lines (hard sigmoids and hard
tangents), which numpy does many times faster. Tags are O and, for each type, the first character and a further one. The
transitions are fitted together with the rest by the likelihood of whole tag sequences, and forbid to go on with what
has not begun. The best sequence is searched for over all characters of a window.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np

from .pii_labels import TYPES

HIDDEN, CHARS, WINDOW, EDGE = 40, 4, 512, 32
TAGS = 1 + 2 * len(TYPES)
FILE = Path(__file__).with_name("pii_model.npz")


def _class(c: str) -> int:
    """ASCII stands for itself; other characters by what they are."""
    o = ord(c)
    if 32 <= o < 127:
        return o - 31
    if c in "\n\r\t":
        return {"\n": 96, "\r": 96, "\t": 97}[c]
    if c.isspace():
        return 98
    if c.isalpha():
        return 99 if c.islower() else 100 if c.isupper() else 101
    if c.isdigit():
        return 102
    return {"–": 103, "—": 103, "’": 104, "º": 105, "°": 105}.get(c, 106)


CLASSES = 107


class _Classes(dict):
    def __missing__(self, o: int) -> int:
        r = self[o] = _class(chr(o))
        return r


_KNOWN = _Classes()
_TABLE = np.array([_class(chr(o)) if not 0xD800 <= o < 0xE000 else 106 for o in range(0x3000)], np.int16)


def classes(text: str) -> np.ndarray:
    """The class of each character of text; 0 is left for padding."""
    o = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[np.minimum(o, len(_TABLE) - 1)]
    far = np.flatnonzero(o >= len(_TABLE))
    if len(far):
        out[far] = [_KNOWN[int(x)] for x in o[far]]
    return out


def starts(n: int) -> list[int]:
    """Where the windows of a text of n characters start; each overlaps the next by twice EDGE."""
    step = WINDOW - 2 * EDGE
    return list(range(0, max(n - 2 * EDGE, 1), step))


def _scan(tables: list[np.ndarray], index: list[np.ndarray], u: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """Hidden states (steps, windows, HIDDEN) of one direction; the gates are in the order in, forget, out, new.

    tables: input products; index: (steps, windows) rows of each.
    """
    (steps, n), h = index[0].shape, HIDDEN
    out, zero = np.empty((steps, n, h), np.float32), np.zeros((n, h), np.float32)
    state, cell, b, part = zero, zero.copy(), np.empty((n, 4 * h), np.float32), np.empty((n, h), np.float32)
    a = np.empty((n, 4 * h), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        if keep is not None:
            a, before = np.empty((n, 4 * h), np.float32), cell.copy()
        np.take(tables[0], index[0][t], axis=0, out=a, mode="clip")
        for w, i in zip(tables[1:], index[1:]):
            np.take(w, i[t], axis=0, out=b, mode="clip")
            a += b
        np.matmul(state, u, out=b)
        a += b
        np.clip(a[:, : 3 * h], 0, 1, out=a[:, : 3 * h])
        np.clip(a[:, 3 * h :], -1, 1, out=a[:, 3 * h :])
        cell *= a[:, h : 2 * h]
        np.multiply(a[:, :h], a[:, 3 * h :], out=part)
        cell += part
        np.clip(cell, -1, 1, out=part)
        if keep is not None:
            keep.append((t, a, before, cell.copy(), state))
        np.multiply(part, a[:, 2 * h : 3 * h], out=out[t])
        state = out[t]
    return out


def prepared(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The model with tables of two characters at once, which tagging reads."""
    out = dict(w)
    for s in "fb":
        for k in range(0, CHARS, 2):
            out[f"pair{k}_{s}"] = (w[f"in{k}_{s}"][:, None] + w[f"in{k + 1}_{s}"][None]).reshape(-1, 4 * HIDDEN)
    return out


def _emissions(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Scores (characters, TAGS, windows), as the search reads them. w: see prepared(); the characters are a multiple of CHARS."""
    x = x.astype(np.int64)
    index = [np.ascontiguousarray((x[:, k::CHARS] * CLASSES + x[:, k + 1 :: CHARS]).T) for k in range(0, CHARS, 2)]
    h = [_scan([w[f"pair{k}_{s}"] for k in range(0, CHARS, 2)], index, w[f"u_{s}"], s == "b").transpose(0, 2, 1) for s in "fb"]
    out = np.ascontiguousarray(w["out"].T)
    e = np.matmul(out[:, :HIDDEN], h[0])
    e += np.matmul(out[:, HIDDEN:], h[1])
    e += w["bias"][:, None]
    return e.reshape(x.shape[1], TAGS, len(x))


def emissions(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Scores (windows, characters, TAGS). w: see prepared(); the characters are a multiple of CHARS."""
    return _emissions(w, x).transpose(2, 0, 1)


def _decode(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """See decode(). e: scores (characters, TAGS, windows).

    Windows are the last axis, so that every step is a few operations on long rows. A further character has two tags
    that can come before it, O and first characters have all. On the way back only those windows are looked at that are
    not in O with O as the best before it.
    """
    length, k, n = e.shape
    trans = trans.astype(np.float32)
    t = np.ascontiguousarray(trans[:, np.r_[0, 1:k:2]])[:, :, None]
    further = np.arange(2, k, 2)
    begun, again = trans[further - 1, further][:, None], trans[further, further][:, None]
    scores, leaves = np.empty((length, k, n), np.float32), np.zeros((length, n), bool)
    all_, best, go_on, start = (np.empty(s, np.float32) for s in ((k, len(t[0]), n), (len(t[0]), n), (len(further), n), (len(further), n)))
    np.add(trans[0][:, None], e[0], out=scores[0])
    for i in range(1, length):
        score, new = scores[i - 1], scores[i]
        np.add(score[:, None], t, out=all_)
        np.maximum.reduce(all_, axis=0, out=best)
        np.not_equal(all_[0, 0], best[0], out=leaves[i])
        np.add(best[0], e[i, 0], out=new[0])
        np.add(best[1:], e[i, 1::2], out=new[1::2])
        np.add(score[1::2], begun, out=start)
        np.add(score[2::2], again, out=go_on)
        np.maximum(start, go_on, out=go_on)
        np.add(go_on, e[i, 2::2], out=new[2::2])
    tags = np.zeros((length, n), np.int8)
    tags[-1] = (scores[-1] + trans[:, 0][:, None]).argmax(axis=0)
    for i in range(length - 1, 0, -1):  # what came before is found again for the one tag that each window has
        some = np.flatnonzero(leaves[i] | (tags[i] > 0))
        if len(some):
            tags[i - 1, some] = (scores[i - 1][:, some] + trans.take(tags[i, some], axis=1)).argmax(axis=0)
    return tags.T


def decode(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tags (windows, characters) by the Viterbi algorithm over all characters; O stands before the first and after the last."""
    return _decode(np.ascontiguousarray(e.transpose(1, 2, 0), np.float32), trans)


def tag(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Tags (windows, characters) of the windows x; what is padded is O."""
    e = _emissions(w, x)
    pad = x.T == 0
    if pad.any():
        e.transpose(0, 2, 1)[pad] = np.r_[0, np.full(TAGS - 1, -1e4)].astype(np.float32)
    return _decode(e, w["trans"])


def load() -> dict[str, np.ndarray]:
    with np.load(FILE) as f:
        return prepared({k: f[k].astype(np.float32) for k in f.files})
