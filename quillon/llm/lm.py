"""Scoring by a gated recurrent language model, learned here.

A word-level GRU with a class-factored softmax, trained by truncated backpropagation in numpy.
Documents are dealt to rounds and groups by hash; in a round, tasks train on their groups from the
same weights, which are then averaged, weighted by tokens. For scoring, documents are laid end to end in lanes; the state goes on
from window to window, so a document's likelihood is that of its whole text.

The softmax covers the frequent words, the end of a text, and shapes: a word outside is emitted as
its shape (last character, plain or not) and then by its share among the training words of that shape,
counted over the whole corpus; words never seen share the estimated mass of new words.
"""

from __future__ import annotations

import ctypes
import functools
import heapq
import math
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import durable, keeps_names, public, slices

#: A worker keeps so much memory that its arrays gave back, and gets arrays up to a half of it from there: else each
#: window's arrays are fresh pages of the system, and faults on them take a quarter of the training.
KEPT_BYTES = 64 << 20
#: At most so many words' counts travel to the workers; the others' are joined.
HEAD = 65_536
#: A task holds words of about so many bytes, repeated ones too, before it counts them and passes the counts on.
HELD = 40 << 20
#: So many words of a partition are held in a table that documents' words are looked up in (about 100 bytes each).
HASHED = 1_000_000
#: Classes and words in each: the softmax has CLASSES * SLOTS outputs.
CLASSES, SLOTS = 64, 64
EMBED, HIDDEN = 16, 32
#: Training: rounds of averaging, each document in one of them; tokens of a group, which one task trains on;
#: lanes at most, window, updates of a group at least (if it has the tokens), step size, clipping.
ROUNDS, GROUP_TOKENS = 4, 500_000
LANES, WINDOW, LEAST_UPDATES, RATE, CLIP = 384, 16, 32, 0.02, 5.0
#: Weights of so many groups are averaged together; that many rows reach the driver at most.
FAN = 32
SCORE_LANES, SCORE_WINDOW = 256, 64
#: The softmax takes so many rows at a time, whose exponents then stay in a core's cache.
BLOCK = 768
#: Classes of at most so many rows are handled several at once.
FEW = 128
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ENDS = {c: k + 1 for k, c in enumerate(b".,*#$%&!|")}
N_SHAPES = 24


@functools.cache
def keep_memory() -> bool:
    """Let the C library of this process keep KEPT_BYTES; False where it has no such setting."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return False
    trim, by_map = -1, -3  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
    return bool(mallopt(by_map, KEPT_BYTES // 2) and mallopt(trim, KEPT_BYTES))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, as UTF-8; bytes.split knows just these six blanks."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


#: Twice the kind of a word's last byte: a listed mark, a digit, another one that is no small letter, the rest.
_KINDS = [2 * _ENDS.get(c, 10 if 48 <= c <= 57 else 11 if c < 128 and not 97 <= c <= 122 else 0) for c in range(256)]
_KINDS_OF = np.array(_KINDS, np.int64)


def shape_of(word: bytes) -> int:
    return _KINDS[word[-1]] + (not word.isascii())


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts in one array, how many each has), as ``words_of`` has them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # blanks at either end leave an empty word there
    upto = np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], ends])]
    return words.filter(pa.array(full)), np.diff(upto)


def shapes_of(words: pa.Array) -> np.ndarray:
    """``shape_of`` of each word."""
    if not len(words):
        return np.empty(0, np.int64)
    words = words.cast(pa.large_string())
    _, ends, data = words.buffers()
    last = np.frombuffer(ends, np.int64)[words.offset + 1 : words.offset + len(words) + 1] - 1
    return _KINDS_OF[np.frombuffer(data, np.uint8)[last]] + ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)


def shape_column(word: Column) -> Column:
    """``shape_of`` of a column of words."""
    last, kind = F.ascii(F.substring(word, -1, 1)), F
    for c, k in _ENDS.items():
        kind = kind.when(last == c, k)
    kind = kind.when(last.between(48, 57), 10).when((last < 128) & ~last.between(97, 122), 11).otherwise(0)
    return (2 * kind + (F.octet_length(word) > F.length(word)).cast("int")).cast("int")


class Vocabulary:
    """Head counts and what follows from them: ids of the softmax, base and shape probabilities.

    Ids: 0 is the end, 1 to N_SHAPES the shapes, then the most frequent words.
    """

    def __init__(self, head: list[tuple[str, int]], documents: int, tokens: int, types: int):
        """``head``: words and counts, most frequent first; tokens and types count the end too."""
        self.index = {w.encode("utf-8", "replace"): k for k, (w, _) in enumerate(head)}
        self.words = pa.array(list(self.index), pa.binary()).cast(pa.string())
        self.count = np.array([n for _, n in head], np.float64)
        self.documents, self.tokens, self.types = documents, tokens, types
        self.own = min(len(head), CLASSES * SLOTS - 1 - N_SHAPES)
        shapes = np.array([shape_of(w) for w in self.index], np.int64) if head else np.empty(0, np.int64)
        self.ids = 1 + shapes
        self.ids[: self.own] = 1 + N_SHAPES + np.arange(self.own)
        self.denominator = math.log10(tokens + types + 1)
        self.base = np.log10(self.count + 1)
        self.base_end = math.log10(documents + 1)

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        """From the attributes of another; broadcasts carry plain values only."""
        out = object.__new__(cls)
        out.__dict__.update(state)
        return out

    def with_shapes(self, totals: np.ndarray, singles: np.ndarray) -> Vocabulary:
        """``totals``, ``singles``: by shape, the tokens of words outside the softmax and of those seen once."""
        self.totals, self.singles = totals, singles
        self.mass = np.log10(totals + singles + 1)  # of a shape: its words by count, new words by singles + 1
        self.new = np.log10(singles + 1) - self.mass
        self.inner = np.where(self.ids > N_SHAPES, 0.0, np.log10(self.count) - self.mass[np.minimum(self.ids, N_SHAPES) - 1])
        n = 1 + N_SHAPES + self.own
        freq = np.concatenate([[self.documents], totals, self.count[: self.own]]) + 0.5
        order = np.argsort(-freq, kind="stable")
        self.place = np.empty(n, np.int64)  # id -> class * SLOTS + slot, the most frequent first
        self.place[order] = np.arange(n)
        self.order = order
        self.freq = np.zeros(CLASSES * SLOTS)
        self.freq[self.place] = freq
        return self


def initial(freq: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights, biases that give the training frequencies."""
    r, f = np.random.default_rng(seed), np.float32
    cells = freq.reshape(CLASSES, SLOTS)
    per_class = cells.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        slot = np.where(cells > 0, np.log(cells / per_class[:, None]), -1e9)
        group = np.where(per_class > 0, np.log(per_class / max(1.0, per_class.sum())), -1e9)
    return {
        "emb": (r.standard_normal((CLASSES * SLOTS, EMBED)) * 0.3).astype(f), "wx": (r.standard_normal((EMBED, 3 * HIDDEN)) * 0.25).astype(f),
        "wh": (r.standard_normal((HIDDEN, 3 * HIDDEN)) / HIDDEN**0.5 * 0.8).astype(f), "b": np.zeros(3 * HIDDEN, f),
        "wc": (r.standard_normal((HIDDEN, CLASSES)) * 0.02).astype(f), "bc": group.astype(f),
        "ww": (r.standard_normal((CLASSES, HIDDEN, SLOTS)) * 0.02).astype(f), "bw": slot.astype(f),
    }


def run_window(p: dict, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
    """(states after each of the T steps of x (T, B), last state, what backpropagation needs of them if ``keep``).

    A lane starts from zero where ``fresh``. Inside, lanes run along the last axis, so that the
    parts of a gate are contiguous; a step's input is the state, the embedding and a one for the bias.
    """
    n, (steps, lanes) = HIDDEN, x.shape
    some, emb = fresh.any(axis=1), p["emb"].take(x, axis=0).transpose(0, 2, 1)
    w = np.concatenate([p["wh"], p["wx"], p["b"][None]]).T
    gate, inner, given = -w[: 2 * n], np.ascontiguousarray(w[2 * n :, :n]), np.ascontiguousarray(w[2 * n :, n:])
    kept = steps if keep else 1
    states, u = np.empty((steps, n, lanes), h.dtype), np.ones((kept, n + EMBED + 1, lanes), h.dtype)
    zr, new, a = (np.empty((kept, k * n, lanes), h.dtype) for k in (2, 1, 1))
    part, last = np.empty((n, lanes), h.dtype), h.T
    with np.errstate(over="ignore"):  # an exponent that is infinite gives the gate's limit
        for t in range(steps):
            k = t % kept
            before = u[k, :n]
            if some[t]:
                np.multiply(last, ~fresh[t], out=before)
            else:
                before[:] = last
            u[k, n:-1] = emb[t]
            s = np.matmul(gate, u[k], out=zr[k])
            np.exp(s, out=s)
            s += 1
            np.reciprocal(s, out=s)
            np.multiply(s[n:], np.matmul(inner, before, out=a[k]), out=part)
            c = np.matmul(given, u[k, n:], out=new[k])
            c += part
            c += c  # tanh by way of the exponent of its argument twice, which takes half the time
            np.exp(c, out=c)
            c += 1
            np.divide(-2, c, out=c)
            c += 1
            last = np.subtract(before, c, out=states[t])
            last *= s[:n]
            last += c
    return np.ascontiguousarray(states.transpose(0, 2, 1)), last.T, (u, zr[:, :n], zr[:, n:], new, a)


def output(p: dict, h: np.ndarray, y: np.ndarray, grad: dict | None = None):
    """Natural log probabilities of targets y (places) given states h (N, HIDDEN), which lie within -1 and 1.

    With ``grad`` the gradients of minus their mean are added to it, and the states' returned.
    Rows are handled class by class, so many at a time that they stay in the cache; a last column
    of ones stands for the biases.
    """
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        return _output(p, h, y.astype(np.uint16), grad)


def _tame(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether exponents of w (..., HIDDEN, outputs) and biases b neither overflow nor all vanish, whatever the state."""
    most = np.abs(w).sum(axis=-2)
    return ((b + most).max(axis=-1) < 40) & ((b - most).max(axis=-1) > -40)


def _alike(sizes: np.ndarray) -> list[np.ndarray]:
    """Classes of FEW rows or less, but not none, the largest first, in groups that differ in size by less than two
    times and have about BLOCK rows."""
    few = np.flatnonzero((sizes > 0) & (sizes <= FEW))
    few, out = few[np.argsort(-sizes[few], kind="stable")], []
    while len(few):
        most = sizes[few[0]]
        k = min(int((2 * sizes[few] > most).sum()), max(1, BLOCK // int(most)))
        out.append(few[:k])
        few = few[k:]
    return out


def _output(p: dict, h: np.ndarray, y: np.ndarray, grad: dict | None):
    order = np.argsort(y, kind="stable")
    y = y.take(order).astype(np.int64)
    rows, n = np.arange(len(y)), HIDDEN
    back = np.empty_like(order)
    back[order] = rows
    wide = np.ones((len(y), n + 1), h.dtype)
    np.take(h, order, axis=0, out=wide[:, :n], mode="clip")  # all are there; "raise" takes a buffer
    c = y // SLOTS
    s = y - c * SLOTS
    edges = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
    wc, ww = np.concatenate([p["wc"], p["bc"][None]]), np.concatenate([p["ww"], p["bw"][:, None]], axis=1)
    tame, scale = _tame(p["ww"], p["bw"]).tolist(), h.dtype.type(1 / max(1, len(y)))
    logs, total, room = np.empty((2, len(y)), h.dtype), np.empty((2, len(y)), h.dtype), np.empty((BLOCK, max(CLASSES, SLOTS)), h.dtype)
    ones, dh = np.ones(room.shape[1], h.dtype), None if grad is None else np.empty((len(y), n), h.dtype)
    # first the classes, of all rows, then the words, of each class; of the gradients' products each has its own
    layers = [(0, wc, p["wc"].T, bool(_tame(p["wc"], p["bc"])), 0, len(y))]
    layers += [(1, ww[k], p["ww"][k].T, tame[k], edges[k], edges[k + 1]) for k in range(CLASSES) if edges[k + 1] - edges[k] > FEW]
    for k, w, back_w, safe, begin, end in layers:
        target, d = (c, s)[k], None
        for low in range(begin, end, BLOCK):
            part = slice(low, min(low + BLOCK, end))
            hidden, own, to = wide[part], rows[: part.stop - low], target[part]
            z = np.matmul(hidden, w, out=room[: len(own), : w.shape[1]])
            if not safe:  # less each row's maximum
                z -= z.max(axis=1, keepdims=True)
            logs[k, part] = z[own, to]
            e = np.exp(z, out=z)
            sums = np.matmul(e, ones[: w.shape[1]], out=total[k, part])
            if grad is not None:
                e *= (scale / sums)[:, None]
                e[own, to] -= scale
                product = hidden.T @ e
                d = product if d is None else np.add(d, product, out=d)
                if k:
                    dh[part] += e @ back_w
                else:
                    np.matmul(e, back_w, out=dh[part])
        if d is not None:
            to = (grad["wc"], grad["bc"]) if not k else (grad["ww"][(at := c[begin])], grad["bw"][at])
            to[0][:] += d[:n]
            to[1][:] += d[n]
    for some in _alike(np.diff(edges)):
        size = np.diff(edges)[some]
        at = np.array(edges)[some][:, None] + np.arange(size[0])
        real = np.arange(size[0]) < size[:, None]
        at[~real] = at[0, 0]  # rows that only fill up: they have no gradient
        hidden, to, own = wide[at], s[at], np.ogrid[: len(some), : size[0]]
        z = hidden @ ww[some]
        if not all(tame[k] for k in some):
            z -= z.max(axis=2, keepdims=True)
        picked = z[*own, to]
        e = np.exp(z, out=z)
        sums = e @ ones[:SLOTS]
        flat = at[real]
        logs[1, flat], total[1, flat] = picked[real], sums[real]
        if grad is not None:
            part = real * scale
            e *= (part / sums)[:, :, None]
            e[*own, to] -= part
            d = hidden.transpose(0, 2, 1) @ e
            grad["ww"][some] += d[:, :n]
            grad["bw"][some] += d[:, n]
            dh[flat] += (e @ p["ww"][some].transpose(0, 2, 1))[real]
    out = (logs - np.log(total)).sum(axis=0, dtype=np.float64)
    return out.take(back), None if dh is None else dh.take(back, axis=0)


def train_window(p: dict, x: np.ndarray, y: np.ndarray, valid: np.ndarray, fresh: np.ndarray, h: np.ndarray):
    """(gradients, last state): truncated backpropagation through one window."""
    n, some = HIDDEN, fresh.any(axis=1)
    states, last, (u, z, r, new, a) = run_window(p, x, fresh, h, keep=True)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    if valid.all():
        d_states = output(p, states.reshape(-1, n), y.ravel(), grad)[1].reshape(states.shape)
    else:
        d_states = np.zeros(states.shape, states.dtype)
        _, d_states[valid] = output(p, states[valid], y[valid], grad)
    d_states = np.ascontiguousarray(d_states.transpose(0, 2, 1))
    # step by step, so that a step's arrays stay in the cache; da: of the gates and of what the reset gate lets through, dn: of the new state
    da, dn, some_of, rest = np.empty((3 * n, x.shape[1]), states.dtype), *np.empty((3, n, x.shape[1]), states.dtype)
    d_emb, dh = np.empty((*x.shape, EMBED), states.dtype), np.zeros_like(dn)
    by_gate, by_state, by_given = (np.zeros(shape, states.dtype) for shape in ((n + EMBED + 1, 2 * n), (n, n), (EMBED + 1, n)))
    for t in range(len(x) - 1, -1, -1):
        dh += d_states[t]
        before, zt, rt, ct = u[t, :n], z[t], r[t], new[t]
        np.subtract(1, zt, out=rest)
        np.multiply(ct, ct, out=dn)
        np.subtract(1, dn, out=dn)
        dn *= rest
        dn *= dh
        dz = np.subtract(before, ct, out=da[:n])
        dz *= zt
        dz *= rest
        dz *= dh
        np.multiply(dn, rt, out=da[2 * n :])
        np.subtract(1, rt, out=some_of)
        some_of *= a[t]
        np.multiply(da[2 * n :], some_of, out=da[n : 2 * n])
        dh *= zt
        dh += p["wh"] @ da
        if some[t]:
            dh *= ~fresh[t]
        by_gate += u[t] @ da[: 2 * n].T
        by_state += before @ da[2 * n :].T
        by_given += u[t, n:] @ dn.T
        da[2 * n :] = dn
        d_emb[t] = (p["wx"] @ da).T
    grad["wh"][:, : 2 * n] = by_gate[:n]
    grad["wx"][:, : 2 * n] = by_gate[n:-1]
    grad["b"][: 2 * n] = by_gate[-1]
    grad["wh"][:, 2 * n :] = by_state
    grad["wx"][:, 2 * n :] = by_given[:-1]
    grad["b"][2 * n :] = by_given[-1]
    flat = x.ravel().astype(np.uint16)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(flat)) + 1])
    grad["emb"][flat[starts]] = np.add.reduceat(d_emb.reshape(-1, EMBED).take(order, axis=0), starts)
    return grad, last


def lanes_of(lengths: list[int], lanes: int) -> list[list[int]]:
    """Documents dealt to lanes of near equal length, longest first."""
    heap = [(0, k) for k in range(max(1, min(lanes, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (n + lengths[i], k))
    return out


def laid_out(lanes: list[np.ndarray], starts: list[np.ndarray], begin: int, window: int, rows: int = 0):
    """(x, y, valid, fresh) of each window over lanes of places, longest first: inputs, targets, and where a
    document begins (from input ``begin`` and a zero state). Lanes that have ended are left out; where few are
    left, a window is up to 8 times longer, to have about ``rows`` rows."""
    loads = np.array([len(lane) for lane in lanes], np.int64)
    shape = int(loads.max(initial=0)), len(lanes)
    y, first = np.zeros(shape[::-1], np.uint16), np.zeros(shape[::-1], bool)  # places fit in two bytes
    for b, (lane, at) in enumerate(zip(lanes, starts, strict=True)):
        y[b, : len(lane)] = lane
        first[b, at] = True
    low = 0
    while low < shape[0]:
        n = int((loads > low).sum())
        part = slice(low, min(low + max(window, min(8 * window, rows // n)), shape[0]))
        steps, fresh, now = np.arange(part.start, part.stop), first[:n, part], y[:n, part].astype(np.int64)
        x = np.concatenate([y[:n, low - 1 : low] if low else np.full((n, 1), begin), now[:, :-1]], axis=1)
        x[fresh] = begin
        yield x.T, now.T, steps[:, None] < loads[:n], fresh.T
        low = part.stop


def fit(p: dict, docs: list[np.ndarray], begin: int) -> dict:
    """Adam over one pass through ``docs``, each its places with the end last; the weights are changed in place.

    The documents are one stream, cut into lanes of equal length; the state goes on from window to
    window and starts anew with each document and lane.
    """
    keep_memory()
    # weights, ten times the first moments and a hundred times the second, a part that stays in the cache at a time
    parts_of = [(k, slice(low, low + 16_384)) for k, v in p.items() for low in range(0, v.size, 16_384)]
    m = [(v := p[k].reshape(-1)[part], np.zeros_like(v), np.zeros_like(v)) for k, part in parts_of]
    if not docs:
        return p
    stream = np.concatenate(docs).astype(np.int64)
    first = np.cumsum([0, *map(len, docs[:-1])])
    lanes = min(LANES, max(1, len(stream) // (WINDOW * LEAST_UPDATES)))
    edges = np.arange(lanes + 1) * len(stream) // lanes
    parts = sorted(((stream[a:b], np.concatenate([[0], first[(first > a) & (first < b)] - a])) for a, b in pairwise(edges)), key=lambda x: -len(x[0]))
    h, t = None, 0
    for x, y, valid, fresh in laid_out([q[0] for q in parts], [q[1] for q in parts], begin, WINDOW):
        h = np.zeros((x.shape[1], HIDDEN), np.float32) if h is None else h[: x.shape[1]]
        grad, h = train_window(p, x, y, valid, fresh, h)
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
        t += 1
        rate = np.float32(RATE * math.sqrt(1 - 0.99**t) / (1 - 0.9**t) * min(1.0, CLIP / (norm + 1e-9)))
        for (k, part), (w, a, b) in zip(parts_of, m, strict=True):
            g = grad[k].reshape(-1)[part]
            a *= np.float32(0.9)
            a += g
            b *= np.float32(0.99)
            g *= g
            b += g
            np.sqrt(b, out=g)
            g += np.float32(1e-5)
            np.divide(a, g, out=g)
            g *= rate
            w -= g
    return p


def score_docs(p: dict, docs: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each document's places (the end last)."""
    keep_memory()
    out = np.zeros(len(docs))
    if not docs:
        return out
    dealt = sorted((lane for lane in lanes_of([len(d) for d in docs], SCORE_LANES)), key=lambda lane: -sum(len(docs[i]) for i in lane))
    lanes = [np.concatenate([docs[i] for i in lane]) for lane in dealt]
    starts = [np.cumsum([0, *(len(docs[i]) for i in lane[:-1])]) for lane in dealt]
    h, logs, at = None, [np.empty(len(lane)) for lane in lanes], 0
    for x, y, valid, fresh in laid_out(lanes, starts, int(docs[0][-1]), SCORE_WINDOW, SCORE_LANES * SCORE_WINDOW):
        h = np.zeros((x.shape[1], HIDDEN), np.float32) if h is None else h[: x.shape[1]]
        states, h, _ = run_window(p, x, fresh, h)
        found = np.zeros(x.shape)
        if valid.all():
            found = output(p, states.reshape(-1, HIDDEN), y.ravel())[0].reshape(x.shape)
        else:
            found[valid], _ = output(p, states[valid], y[valid])
        for b, n in enumerate(valid.sum(axis=0)):
            logs[b][at : at + n] = found[:n, b]
        at += len(x)
    for lane, values, begin in zip(dealt, logs, starts, strict=True):
        out[lane] = np.add.reduceat(values, begin)
    return out / math.log(10)


_NAMES = ["emb", "wx", "wh", "b", "wc", "bc", "ww", "bw"]


def packed(p: dict) -> bytes:
    return b"".join(p[k].astype(np.float32).tobytes() for k in _NAMES)


def unpacked(raw: bytes, like: dict) -> dict:
    out, at, flat = {}, 0, np.frombuffer(raw, np.float32)
    for k in _NAMES:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _places(words: list[bytes] | pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(head index or -1, place) of each word and of the end."""
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary()).cast(pa.string())
    found = pc.index_in(words, value_set=v.words.cast(words.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = np.append(v.ids[found] if len(v.ids) else np.zeros(len(words), np.int64), 0)
    miss = found < 0
    ids[:-1][miss] = 1 + shapes_of(words.filter(pa.array(miss)))
    return found, v.place[ids]


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) over all texts of ``train``."""
    def counted(held):
        seen = pa.chunked_array(held, pa.string()).value_counts()
        return pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], names=["word", "n"])

    def run(batches):
        keep_memory()
        held, n = [], 0
        for batch in slices(batches, "text"):
            words, _ = split(batch.column("text"))
            held.append(words.cast(pa.string()))
            n += words.nbytes
            if n >= HELD:
                yield counted(held)
                held, n = [], 0
        yield counted(held)

    return durable(train.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


def vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    types, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # the most frequent HEAD words, ties by word: sought only among those of the steps (an eighth of a doubling) that hold them
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.s)
    reached, edge = 0, 0
    for r in sizes:
        reached, edge = reached + r.k, r.s
        if reached >= HEAD:
            break
    rows = counts.where(step >= edge).orderBy(F.desc("n"), "word").limit(HEAD).collect() if sizes else []
    head = sorted(((r.word, r.n) for r in rows), key=lambda x: (-x[1], x[0]))
    v = Vocabulary(head, documents, tokens + documents, types + (documents > 0))
    v.last = head[-1] if head else None
    # all words by shape, less those that the softmax has itself
    totals, singles = np.zeros(N_SHAPES), np.zeros(N_SHAPES)
    for r in counts.groupBy(shape_column(F.col("word")).alias("k")).agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("one")).collect():
        totals[r.k], singles[r.k] = r.n, r.one
    for w, n in head[: v.own]:
        k = shape_of(w.encode("utf-8", "replace"))
        totals[k] -= n
        singles[k] -= n == 1
    return v.with_shapes(totals, singles)


def _placed(rows: DataFrame, v: Vocabulary, text: str) -> DataFrame:
    """``rows`` with the places of their words and of the end for ``text``, and what follows from counts
    alone: n_tokens, _known, _base, _inner (log10) and _tail, the words outside the head; durable."""
    names = [c for c in rows.columns if c != text]
    sent = rows.sparkSession.sparkContext.broadcast({k: x for k, x in vars(v).items() if k != "index"})

    def run(batches):
        keep_memory()
        voc = Vocabulary.of(sent.value)
        for batch in slices(batches, text):
            words, sizes = split(batch.column(text))
            found, places = _places(words, voc)
            n, miss = sizes + 1, found < 0
            ends = np.cumsum(n)
            starts, inside = ends - n, np.ones(int(n.sum()), bool)
            inside[ends - 1] = False

            def by_text(values, end, kind=np.float64):
                out = np.full(len(inside), end, kind)  # noqa: B023
                out[inside] = values  # noqa: B023
                return out

            def sums(values, kind=np.float64):
                return np.add.reduceat(by_text(values, 0, kind), starts) if len(starts) else np.empty(0, kind)  # noqa: B023

            shares = np.empty(len(found))
            shares[~miss] = voc.inner[found[~miss]]
            shares[miss] = voc.new[voc.order[places[:-1][miss]] - 1]
            base = sums(np.append(voc.base, 0.0)[found]) + voc.base_end - n * voc.denominator
            cuts = np.concatenate([[0], np.cumsum(sums(miss, np.int64))]).astype(np.int32)
            raw = pa.py_buffer(by_text(places[:-1], places[-1], np.uint16).tobytes())
            arrays = [
                pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.concatenate([[0], ends]) * 2).astype(np.int32).tobytes()), raw]),
                pa.array(n, pa.int64()), pa.array(sums(~miss, np.int64) + (voc.documents > 0), pa.int64()), pa.array(base), pa.array(sums(shares)),
                pa.ListArray.from_arrays(pa.array(cuts), words.filter(pa.array(miss)).cast(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *arrays], names=[*names, "_places", "n_tokens", "_known", "_base", "_inner", "_tail"])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[f"`{c}`" for c in names]).schema.fields] + ["_places binary, n_tokens long, _known long, _base double, _inner double, _tail array<string>"])
    return durable(rows.mapInArrow(run, fields), "lm-placed")


def _dealt(docs: DataFrame, rounds: int, groups: int) -> DataFrame:
    """(round, grp, turn, places) of every row of ``docs`` (h, places; h: a hash of id and text), durable: where
    a row goes depends on these and on which of the rows alike it is, not on how the table is partitioned."""
    alike = docs.groupBy("h", "places").agg(F.count("*").alias("n"))  # rows alike are counted, then dealt out again
    each = alike.select("h", "places", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    seat = F.pmod(F.xxhash64("h", "copy"), F.lit(rounds * groups)).cast("int")
    return durable(each.select((seat % rounds).alias("round"), (seat / rounds).cast("int").alias("grp"), F.xxhash64("copy", "h").alias("turn"), "places"), "lm-train")


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row of weights for some, weighted by tokens, summed in the order of their groups."""
    pdf = pdf.sort_values("grp")
    n = int(pdf["tokens"].sum())
    total = sum(np.frombuffer(raw, np.float32).astype(np.float64) * (k / n) for raw, k in zip(pdf["weights"], pdf["tokens"], strict=True))
    return pd.DataFrame({"grp": [int(pdf["grp"].iloc[0]) // FAN], "tokens": [n], "weights": [total.astype(np.float32).tobytes()]})


def train(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> dict:
    """Weights after ``rounds`` of local training and averaging over ``docs`` (h, places).

    Every row takes part in one round, in one group of about GROUP_TOKENS tokens, by hash. A task
    trains on a group from the round's weights; these are averaged FAN at a time, so that the
    driver gets at most FAN rows however many groups there are. Groups and their order do not depend
    on partitions, so neither do the weights.
    """
    spark = docs.sparkSession
    p = initial(v.freq)
    groups = max(1, -(-v.tokens // (rounds * GROUP_TOKENS)))
    dealt, begin = _dealt(docs, rounds, groups), int(v.place[0])
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(p)

        def local(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["turn", "places"])
            docs = [np.frombuffer(x, np.uint16) for x in pdf["places"]]
            weights = fit({n: a.copy() for n, a in sent.value.items()}, docs, begin)
            return pd.DataFrame({"grp": [int(pdf["grp"].iloc[0])], "tokens": [sum(map(len, docs))], "weights": [packed(weights)]})

        shape = "grp long, tokens long, weights binary"
        rows = durable(dealt.where(F.col("round") == k).repartition(groups, "grp").groupBy("grp").applyInPandas(local, shape), "lm-weights")
        left = groups
        while left > FAN:
            rows, left = durable(rows.groupBy(F.floor(F.col("grp") / FAN).alias("some")).applyInPandas(_average, shape), "lm-weights"), -(-left // FAN)
        rows = rows.toPandas()
        if len(rows):
            p = unpacked(_average(rows)["weights"].iloc[0], p)
    return p


@keeps_names
def score(df: DataFrame, learns: Column, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The other columns of ``df`` with n_tokens, n_known, train_tokens, base_score and score (log10).

    Learns from the rows where ``learns`` holds. Null and empty texts are one token, the end.
    Repeated rows count as often as they stand there, and score alike. Without rows to learn from,
    frequencies are uniform. An empty table gives no rows. Columns named like the added ones are replaced.
    """
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    df = public(df, *added)
    names = [c for c in df.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    learns = F.coalesce(learns, F.lit(False))
    docs = df.where(learns).select(body.alias("text"))
    counts = count_words(docs)
    v = vocabulary(counts, docs.count())
    key = F.xxhash64(F.col(id_col).cast("string"), body)
    placed = _placed(df.select(*names, F.monotonically_increasing_id().alias("_rid"), learns.alias("_learns"), key.alias("_h"), text), v, text)
    sent = df.sparkSession.sparkContext.broadcast(train(placed.where("_learns").select(F.col("_h").alias("h"), F.col("_places").alias("places")), v))
    kept = [*names, "_rid", "n_tokens", "_known", "_base", "_inner"]

    def run(batches):
        p = sent.value
        for batch in slices(batches, "_places"):
            rows = batch.column("_places").to_pylist()
            at = {x: k for k, x in enumerate(dict.fromkeys(rows))}  # texts alike score alike
            logs = score_docs(p, [np.frombuffer(x, np.uint16).astype(np.int64) for x in at])[[at[x] for x in rows]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(logs, pa.float64())], names=[*kept, "_logs"])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*kept).schema.fields] + ["_logs double"])
    scored = placed.select(*kept, "_places").mapInArrow(run, fields)

    # words outside the head: what they have above a word never seen
    new = F.element_at(F.array(*[F.lit(math.log10(x + 1)) for x in v.singles.tolist()]), shape_column(F.col("word")) + 1)
    outside = counts.where(F.lit(False) if v.last is None else (F.col("n") < v.last[1]) | ((F.col("n") == v.last[1]) & (F.col("word") > v.last[0])))
    gains = outside.select("word", F.log10(F.col("n") + 1).alias("up_base"), (F.log10("n") - new).alias("up"))
    tail = placed.select("_rid", F.explode("_tail").alias("word"))
    # words are few enough for tables in memory, by partition, or else both sides are sorted, which spills
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gained = tail.join(gains.hint("shuffle_hash") if v.types <= HASHED * partitions else gains, "word").groupBy("_rid").agg(F.count("*").alias("k"), F.sum("up_base").alias("up_base"), F.sum("up").alias("up"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(gained, "_rid", "left").select(
        *names, "n_tokens", (F.col("_known") + zero(F.col("k"))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + zero(F.col("up_base"))).alias("base_score"), (F.col("_logs") + F.col("_inner") + zero(F.col("up"))).alias("score"),
    )
