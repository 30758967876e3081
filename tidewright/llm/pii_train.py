"""Trains the tagger of problem 8:  python -m tidewright.llm.pii_train DOCUMENTS.parquet[,MORE.parquet] [epochs [minutes [warm]]]

At most `DOCS` documents are read and serve as templates, which pii_text fills with made names, streets and numbers anew
in every epoch, beside made documents. All parameters, the transitions among them, are fitted by Adam on the likelihood
of whole tag sequences (forward and backward over the CRF), with back-propagation through time; every process answers
with the gradients of its part of a batch.
"""

from __future__ import annotations

import os
import sys
import time

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # processes share the cores, not threads

import numpy as np

from . import pii_model as M
from .pii_labels import TYPES, spans
from .pii_text import Maker, document, template

DOCS = 20_000
#: Characters of a training window.
LENGTH = 256


def classed(text: str, found: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags) of a text and its mentions."""
    y = np.zeros(len(text), np.int8)
    for a, b, kind in found:
        k = 1 + 2 * TYPES.index(kind)
        y[a:b] = k + 1
        y[a] = k
    return M.classes(text), y


_LOWER = np.arange(M.CLASSES)
_LOWER[[ord(c) - 31 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = [ord(c) - 31 for c in "abcdefghijklmnopqrstuvwxyz"]
_LOWER[100] = 99
_UPPER = np.arange(M.CLASSES)
_UPPER[[ord(c) - 31 for c in "abcdefghijklmnopqrstuvwxyz"]] = [ord(c) - 31 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_UPPER[99] = 100


def windows(docs: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, tags, has mentions) of all windows; with rng at random places, some in one case or with wide spaces."""
    xs, ys = [], []
    for x, y in docs:
        shift = 0
        if rng is not None:
            shift, u = int(rng.integers(LENGTH)), rng.random()
            if u < 0.1:
                x = _LOWER[x]
            elif u < 0.18:
                x = _UPPER[x]
            if rng.random() < 0.06:
                wide = np.where(x == 1, 2, 1)
                x, y = np.repeat(x, wide), np.repeat(y, wide)
        for s in range(-shift, len(x), LENGTH):
            wx, wy = np.zeros(LENGTH, np.int16), np.zeros(LENGTH, np.int8)
            part = x[max(s, 0) : s + LENGTH]
            wx[: len(part)], wy[: len(part)] = part, y[max(s, 0) : s + LENGTH]
            if wy[0] and wy[0] % 2 == 0:  # the rest of a mention that begins before the window is no mention
                cut = int(np.argmin(wy == wy[0])) if (wy != wy[0]).any() else LENGTH
                wx[:cut], wy[:cut] = 0, 0
            xs.append(wx)
            ys.append(wy)
    x, y = np.stack(xs), np.stack(ys)
    return x, y, (y > 0).any(axis=1)


def _allowed() -> np.ndarray:
    """Transitions that may be: a further character follows its own type only."""
    ok = np.ones((M.TAGS, M.TAGS), bool)
    for k in range(2, M.TAGS, 2):
        ok[:, k] = False
        ok[[k - 1, k], k] = True
    return ok


ALLOWED = _allowed()


def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, c = M.HIDDEN, M.CLASSES
    w = {}
    for s in "fb":
        for k in range(M.CHARS):
            w[f"in{k}_{s}"] = rng.normal(0, 0.15, (c, 4 * h))
            w[f"in{k}_{s}"][:, : 3 * h] += 0.5 / M.CHARS
            w[f"in{k}_{s}"][:, h : 2 * h] += 0.3 / M.CHARS  # forget little at first
        w[f"u_{s}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)) * 0.4
    w["out"], w["bias"], w["trans"] = rng.normal(0, 0.1, (2 * h, M.CHARS * M.TAGS)), np.zeros(M.CHARS * M.TAGS), np.where(ALLOWED, 0, -1e4)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _back(dh: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = M.HIDDEN
    dz, du = np.empty((dh.shape[0], dh.shape[1], 4 * h), np.float32), np.zeros_like(u)
    dstate, dcell = np.zeros(dh.shape[1:], np.float32), np.zeros(dh.shape[1:], np.float32)
    for t, a, before, cell, state in reversed(kept):
        d = dh[t] + dstate
        dcell += d * a[:, 2 * h : 3 * h] * (np.abs(cell) < 1)
        da = dz[t]
        da[:, :h] = dcell * a[:, 3 * h :]
        da[:, h : 2 * h] = dcell * before
        da[:, 2 * h : 3 * h] = d * np.clip(cell, -1, 1)
        da[:, : 3 * h] *= (a[:, : 3 * h] > 0) & (a[:, : 3 * h] < 1)
        da[:, 3 * h :] = dcell * a[:, :h] * (np.abs(a[:, 3 * h :]) < 1)
        du += state.T @ da
        dstate = da @ u.T
        dcell = dcell * a[:, h : 2 * h]
    return dz, du


def likelihood(e: np.ndarray, trans: np.ndarray, gold: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood of the gold tags (steps, windows), and its derivatives by scores and transitions; forward and backward, scaled at every step."""
    steps, n, k = e.shape
    top = e.max(axis=2, keepdims=True)
    psi = np.exp(e - top)
    psi[~real] = 0
    psi[~real, 0] = 1
    t = np.exp(np.where(ALLOWED, trans, -1e4)).astype(np.float32)
    alpha, c, beta = np.empty_like(psi), np.empty((steps, n, 1), np.float32), np.ones_like(psi)
    a = np.broadcast_to(t[0], (n, k)) * psi[0]
    for i in range(steps):
        if i:
            a = (a @ t) * psi[i]
        c[i] = a.sum(axis=1, keepdims=True)
        a = a / c[i]
        alpha[i] = a
    end = (alpha[-1] * t[:, 0]).sum(axis=1, keepdims=True)
    after = psi / c
    b = np.broadcast_to(t[:, 0], (n, k)) / end
    beta[-1] = b
    for i in range(steps - 1, 0, -1):
        b = (after[i] * b) @ t.T
        beta[i - 1] = b
    marginal = alpha * beta
    flow = (after * beta)[1:].reshape(-1, k)
    expected = (alpha[:-1].reshape(-1, k).T @ flow) * t
    expected[0] += (t[0] * after[0] * beta[0]).sum(axis=0)
    expected[:, 0] += (alpha[-1] * t[:, 0] / end).sum(axis=0)
    seen = np.zeros((k, k), np.float32)
    np.add.at(seen, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    np.add.at(seen[0], gold[0], 1)
    np.add.at(seen[:, 0], gold[-1], 1)
    at = np.take_along_axis(e, gold[..., None], 2)[..., 0]
    z = float(np.log(c).sum() + np.log(end).sum() + (top[..., 0] * real).sum())
    loss = z - float((at * real).sum()) - float((seen * np.where(ALLOWED, trans, 0)).sum())
    d = marginal
    np.put_along_axis(d, gold[..., None], np.take_along_axis(d, gold[..., None], 2) - 1, 2)
    d[~real] = 0
    return loss, d.astype(np.float32), np.where(ALLOWED, expected - seen, 0).astype(np.float32)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    kept = {"f": [], "b": []}
    index = [np.ascontiguousarray(x[:, k :: M.CHARS].T.astype(np.int64)) for k in range(M.CHARS)]
    hs = [M._scan([w[f"in{k}_{s}"] for k in range(M.CHARS)], index, w[f"u_{s}"], s == "b", kept[s]) for s in "fb"]
    h = np.concatenate(hs, axis=2)
    steps, n = h.shape[:2]
    e = (h.reshape(-1, 2 * M.HIDDEN) @ w["out"] + w["bias"]).reshape(steps, n, M.CHARS, M.TAGS)
    by_char = e.transpose(0, 2, 1, 3).reshape(steps * M.CHARS, n, M.TAGS)
    loss, d, dtrans = likelihood(by_char, w["trans"], np.ascontiguousarray(y.T.astype(np.int64)), np.ascontiguousarray((x > 0).T))
    d = np.ascontiguousarray(d.reshape(steps, M.CHARS, n, M.TAGS).transpose(0, 2, 1, 3)).reshape(-1, M.CHARS * M.TAGS)
    g = {"out": h.reshape(-1, 2 * M.HIDDEN).T @ d, "bias": d.sum(axis=0), "trans": dtrans}
    dh = (d @ w["out"].T).reshape(steps, n, 2 * M.HIDDEN)
    for j, s in enumerate("fb"):
        dz, g[f"u_{s}"] = _back(dh[:, :, j * M.HIDDEN : (j + 1) * M.HIDDEN], kept[s], w[f"u_{s}"])
        flat = dz.reshape(-1, dz.shape[2])
        for k in range(M.CHARS):
            key = index[k].ravel()
            o = np.argsort(key, kind="stable")
            at_ = np.flatnonzero(np.r_[True, np.diff(key[o]) > 0])
            g[f"in{k}_{s}"] = np.zeros_like(w[f"in{k}_{s}"])
            g[f"in{k}_{s}"][key[o][at_]] = np.add.reduceat(flat[o], at_, axis=0)
    return loss / n, {k: a / n for k, a in g.items()}


def mentions(y: np.ndarray) -> set[tuple[int, int, int]]:
    i, j = np.nonzero(y % 2 == 1)
    return set(zip(i.tolist(), j.tolist(), y[i, j].tolist()))


def packed(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float32)


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _epoch(templates: list, made: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of one pass over the templates, filled anew, and of made documents; of those without mentions no more than twice as many as with."""
    rng, maker = np.random.default_rng(seed), Maker(seed)
    docs = [classed(*maker.fill(t)) for t in templates] + [classed(*maker.fill(document(maker))) for _ in range(made)]
    x, y, some = windows(docs, rng)
    p = rng.permutation(np.concatenate([np.flatnonzero(some), rng.permutation(np.flatnonzero(~some))[: int(some.sum() * 2)]]))
    return x[p], y[p]


def _work(k: int, texts: list, made: int, epochs: int, seed: int, batch: int, shared, out, size: int, like: dict, pipe) -> None:
    """A process that keeps a part of the documents and answers with the gradients of its part of each batch."""
    templates = [template(t) for t in texts]
    params, grads = np.frombuffer(shared, np.float32), np.frombuffer(out, np.float32)[k * size : (k + 1) * size]
    for epoch in range(epochs):
        x, y = _epoch(templates, made, [seed, epoch, k])
        pipe.send(len(x) // batch)
        for i in range(pipe.recv()):
            pipe.recv()
            loss, g = gradients(unpacked(params, like), x[i * batch : (i + 1) * batch], y[i * batch : (i + 1) * batch])
            grads[:] = packed(g)
            pipe.send(loss)


def agreement(model: dict[str, np.ndarray], docs: list[tuple[str, list[tuple[int, int, str]]]]) -> tuple[float, float]:
    """(recall, precision) of the starts of mentions that the finished tagger finds in labelled texts."""
    from .pii import find

    got = find([t for t, _ in docs], model)
    a = {(i, s, k) for i, f in enumerate(got) for s, _, k in f}
    b = {(i, s, k) for i, (_, f) in enumerate(docs) for s, _, k in f}
    return len(a & b) / max(len(b), 1), len(a & b) / max(len(a), 1)


def train(
    texts: list[str], epochs: int = 12, batch: int = 16, rate: float = 7e-3, seed: int = 1, workers: int = 8, made: float = 0.8, log=print,
    warm: dict[str, np.ndarray] | None = None, minutes: float = 1e9, checks: dict[str, list] | None = None,
) -> dict[str, np.ndarray]:
    """Parameters of the tagger. texts: documents that serve as templates; made: made documents for each of them; checks: labelled texts to report on; minutes: time after which the rate falls to its end."""
    import multiprocessing as mp

    rng, began = np.random.default_rng(seed), time.time()
    w = {k: v for k, v in warm.items() if not k.startswith("pair")} if warm else start(rng)
    flat = packed(w)
    ctx, size = mp.get_context("fork"), len(flat)
    shared, out = ctx.RawArray("f", size), ctx.RawArray("f", size * workers)
    params, grads = np.frombuffer(shared, np.float32), np.frombuffer(out, np.float32).reshape(workers, size)
    params[:] = flat
    pipes, procs = [], []
    for k in range(workers):
        mine, theirs = ctx.Pipe()
        part = texts[k::workers]
        procs.append(ctx.Process(target=_work, args=(k, part, int(made * len(part)), epochs, seed, batch, shared, out, size, w, theirs), daemon=True))
        procs[-1].start()
        pipes.append(mine)
    m, v, done, fixed = np.zeros(size), np.zeros(size), 0, packed({k: (~ALLOWED if k == "trans" else np.zeros(a.shape)) for k, a in w.items()}) > 0
    for epoch in range(epochs):
        steps = min(p.recv() for p in pipes)
        for p in pipes:
            p.send(steps)
        losses = []
        for i in range(steps):
            for p in pipes:
                p.send(0)
            losses.append(np.mean([p.recv() for p in pipes]))
            g = grads.mean(axis=0)
            done += 1
            share = max((epoch + i / steps) / epochs, (time.time() - began) / 60 / minutes)
            lr = rate * 0.5 * (1 + np.cos(np.pi * min(share, 0.995))) * min(1, done / 50)
            g = g * min(1, 5 / max(float(np.linalg.norm(g)), 1e-9))
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            step = lr * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.999**done)) + 1e-8)
            params -= np.where(fixed, 0, step).astype(np.float32)
        model = {k: a.copy() for k, a in unpacked(params, w).items()}
        np.savez_compressed(M.FILE, **{k: a.astype(np.float32 if k == "trans" else np.float16) for k, a in model.items()})
        ready = M.load()
        log(f"epoch {epoch}: loss {np.mean(losses):.4f}, {steps} steps, {time.time() - began:.0f} s;", "; ".join(f"{n}: recall {r:.4f}, precision {q:.4f}" for n, (r, q) in ((n, agreement(ready, c)) for n, c in (checks or {}).items())), flush=True)
        if time.time() - began > minutes * 60:
            break
    for p in procs:
        p.terminate()
    return model


if __name__ == "__main__":
    import pyarrow.parquet as pq

    docs = [t for p in sys.argv[1].split(",") for t in pq.read_table(p, columns=["text"]).column("text").to_pylist()]
    docs = list(dict.fromkeys(t for t in docs if t and t.strip()))[:DOCS]
    held = docs[:: len(docs) // 400 + 1]
    maker = Maker(12345)
    looks = {"made": [maker.fill(document(maker)) for _ in range(400)], "templates": [maker.fill(template(t)) for t in held], "documents": [(t, spans(t)) for t in held]}
    train([t for t in docs if t not in set(held)], int(sys.argv[2]) if len(sys.argv) > 2 else 12, minutes=float(sys.argv[3]) if len(sys.argv) > 3 else 1e9, warm=M.load() if "warm" in sys.argv else None, checks=looks)
