"""A bidirectional gated recurrent network with attention pooling, in numpy.

Characters: the UTF-8 bytes of each distinct word run through a small recurrent layer in
both directions; its two end states and an embedding of the word, if it is one of the ``_V`` most
frequent ones of the training windows, are its input, with two fixed
numbers: how surely the word, and the surest of its 4-byte parts, is more frequent in
positive than in other training documents (the lower end of a confidence interval of
the logarithm of the ratio; 0 where it is not). Words: windows of consecutive words, each half
over the one before, run through a second such layer; attention
pools its states into one vector, from which the window's logit follows.

Input projections are tables over bytes and over distinct words, so a step only gathers
rows. A word longer than ``PIECE`` bytes is several words, so nothing is cut off.
"""

from __future__ import annotations

import numpy as np

from weftlink.llm.common import is_space, run_hashes, runs

WINDOW, STRIDE, PIECE = 32, 16, 24
_C, _H, _V, _E, _A = 8, 8, 4096, 8, 8
_F = np.float32


def new_net(seed: int = 0, words: np.ndarray | None = None) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s, by=None: (rng.standard_normal(s) / np.sqrt(by or s[0])).astype(_F)
    net = {"words": np.zeros(0, np.uint64) if words is None else words, "ce": draw(256, _C, by=2), "we": draw(_V + 1, _E, by=100), "aW": draw(2 * _H, _A), "av": draw(_A), "o": draw(2 * _H), "ob": np.zeros(1, _F)}
    none = (np.zeros(0, np.uint64), np.zeros(0, _F))
    net |= {"sure_words": none, "sure_parts": none}
    for name, width in (("cf", _C), ("cb", _C), ("wf", _E + 2 * _H + 2), ("wb", _E + 2 * _H + 2)):
        net |= {name + "W": draw(width, 3 * _H), name + "b": np.zeros(3 * _H, _F), name + "U": draw(_H, 3 * _H), name + "c": np.zeros(_H, _F)}
    return net


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _places(net, keys: np.ndarray) -> np.ndarray:
    """Rows of the word embedding: 0 for words outside the fixed vocabulary."""
    known = net["words"]
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at + 1, 0)


def _parts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For each place in words sorted by falling length: the 4-byte part there of the words that have one."""
    lengths = ends - starts
    for t in range(max(0, int(lengths[0]) - 3) if len(lengths) else 0):
        k = int(np.searchsorted(-lengths, -(t + 3), side="left"))
        at = starts[:k] + t
        yield k, sum(raw[at + i].astype(np.uint64) << np.uint64(8 * i) for i in range(4))


def _look_up(table, keys: np.ndarray) -> np.ndarray:
    known, values = table
    if not len(known):
        return np.zeros(len(keys), _F)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], _F(0))


def _fixed(net, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros((len(keys), 2), _F)
    out[:, 0] = _look_up(net["sure_words"], keys)
    for k, part in _parts(raw, starts, ends):
        np.maximum(out[:k, 1], _look_up(net["sure_parts"], part), out=out[:k, 1])
    return out


def _sure(doc: np.ndarray, key: np.ndarray, positive: np.ndarray, most: int = 16384):
    """(keys, values) of the keys found surely more often in positive documents."""
    keys, place = np.unique(key, return_inverse=True)
    pairs = np.unique(place.astype(np.uint64) * np.uint64(len(positive)) + doc.astype(np.uint64))
    place, doc = (pairs // np.uint64(len(positive))).astype(np.int64), (pairs % np.uint64(len(positive))).astype(np.int64)
    p = np.bincount(place[positive[doc]], minlength=len(keys)) + 0.5
    n = np.bincount(place[~positive[doc]], minlength=len(keys)) + 0.5
    value = np.log(p / n) - np.log((positive.sum() + 1) / ((~positive).sum() + 1)) - 2.0 * np.sqrt(1 / p + 1 / n)
    rows = np.flatnonzero(value > 0)
    rows = np.sort(rows[np.argsort(-value[rows], kind="stable")[:most]])
    return keys[rows], np.minimum(value[rows], 4).astype(_F)


class _Steps:
    """One direction of a layer over rows ``idx[t]`` of a table; ``active[t]`` first sequences take step t."""

    def __init__(self, net, name: str, table: np.ndarray, idx: list[np.ndarray], size: int, remember: bool):
        self.net, self.name, self.idx, self.table = net, name, idx, table
        U, c = net[name + "U"], net[name + "c"]
        h = np.zeros((size, _H), _F)
        self.cache: list = []
        self.states: list[np.ndarray] = []
        for rows in idx:
            k = len(rows)
            old = h[:k]
            a = table[rows]
            u = old @ U
            g = _sigmoid(a[:, : 2 * _H] + u[:, : 2 * _H])
            z, r = g[:, :_H], g[:, _H:]
            s = u[:, 2 * _H :] + c
            n = np.tanh(a[:, 2 * _H :] + r * s)
            new = n + z * (old - n)
            if remember:
                self.cache.append((old.copy(), z, r, s, n))
            if k == size:
                h = new
            else:
                h[:k] = new
            self.states.append(h)
        self.last = h

    def back(self, d_states: list[np.ndarray] | None, d_last: np.ndarray | None, grads: dict) -> np.ndarray:
        """Gradient of the table; adds those of the layer's own weights."""
        U = self.net[self.name + "U"]
        d_table = np.zeros_like(self.table)
        dh = np.zeros_like(self.last) if d_last is None else d_last.copy()
        dU, dc = np.zeros_like(U), np.zeros(_H, _F)
        for t in reversed(range(len(self.idx))):
            rows, (old, z, r, s, n) = self.idx[t], self.cache[t]
            k = len(rows)
            if d_states is not None:
                dh = dh + d_states[t]
            d = dh[:k]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (old - n) * z * (1 - z)
            dr = dn * s * r * (1 - r)
            da = np.concatenate([dz, dr, dn], 1)
            du = np.concatenate([dz, dr, dn * r], 1)
            np.add.at(d_table, rows, da)
            dU += old.T @ du
            dc += (dn * r).sum(0)
            dh[:k] = d * z + du @ U.T
        grads[self.name + "U"] = dU
        grads[self.name + "c"] = dc
        return d_table


class Windows:
    """Windows over texts given as bytes on end: distinct words and a word index for each place."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        starts, ends, doc = runs(raw, at, is_space(raw))
        pieces = -(-(ends - starts) // PIECE)
        if len(pieces) and pieces.max() > 1:
            which = np.repeat(np.arange(len(starts)), pieces)
            k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo = starts[which] + k * PIECE
            starts, ends, doc = lo, np.minimum(lo + PIECE, ends[which]), doc[which]
        keys, first, word = np.unique(run_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        order = np.argsort(starts[first] - ends[first], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys, self.raw = keys[order], raw
        self.starts, self.ends = starts[first][order], ends[first][order]
        count = np.bincount(doc, minlength=len(at) - 1)
        begin = np.cumsum(count) - count
        many = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
        self.doc = np.repeat(np.arange(len(count)), many)
        k = np.arange(len(self.doc)) - np.repeat(np.cumsum(many) - many, many)
        places = begin[self.doc][:, None] + k[:, None] * STRIDE + np.arange(WINDOW)
        inside = places < (begin + count)[self.doc][:, None]
        pad = len(self.keys)
        words = np.append(place[word], pad)
        self.words = np.where(inside, words[np.minimum(places, len(words) - 1)], pad)
        self.inside = inside


def _forward(net, keys, raw, starts, ends, words, inside, remember: bool):
    """Logits of windows; words index distinct words sorted by falling length."""
    lengths = ends - starts
    most = int(lengths[0]) if len(lengths) else 0
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(most)]
    front = [raw[starts[:k] + t].astype(np.int64) for t, k in enumerate(active)]
    rear = [raw[ends[:k] - 1 - t].astype(np.int64) for t, k in enumerate(active)]
    chars = [_Steps(net, n, net["ce"] @ net[n + "W"] + net[n + "b"], i, len(keys), remember) for n, i in (("cf", front), ("cb", rear))]
    bucket = _places(net, keys)
    x = np.zeros((len(keys) + 1, _E + 2 * _H + 2), _F)
    x[:-1] = np.concatenate([net["we"][bucket], chars[0].last, chars[1].last, _fixed(net, keys, raw, starts, ends)], 1)
    steps = [np.ascontiguousarray(words[:, t]) for t in range(words.shape[1])]
    layers = [_Steps(net, n, x @ net[n + "W"] + net[n + "b"], i, len(words), remember) for n, i in (("wf", steps), ("wb", steps[::-1]))]
    h = np.stack([np.concatenate([a, b], 1) for a, b in zip(layers[0].states, layers[1].states[::-1], strict=True)])
    q = np.tanh(h @ net["aW"])
    score = q @ net["av"]
    score = np.where(inside.T, score, _F(-1e9))
    w = np.exp(score - score.max(0))
    w /= w.sum(0)
    pooled = (w[:, :, None] * h).sum(0)
    return pooled @ net["o"] + net["ob"][0], (chars, bucket, x, layers, h, q, w, pooled)


def _backward(net, cache, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    chars, bucket, x, layers, h, q, w, pooled = cache
    g: dict[str, np.ndarray] = {"o": pooled.T @ d_logit, "ob": np.array([d_logit.sum()], _F)}
    d_pooled = d_logit[:, None] * net["o"]
    d_w = (h * d_pooled).sum(2)
    dh = w[:, :, None] * d_pooled
    d_score = w * (d_w - (w * d_w).sum(0))
    g["av"] = np.tensordot(d_score, q, ((0, 1), (0, 1)))
    dq = d_score[:, :, None] * net["av"] * (1 - q * q)
    g["aW"] = np.tensordot(h, dq, ((0, 1), (0, 1)))
    dh += dq @ net["aW"].T
    dx = np.zeros_like(x)
    for layer, parts in ((layers[0], list(dh[:, :, :_H])), (layers[1], list(dh[::-1, :, _H:]))):
        d_table = layer.back(parts, None, g)
        g[layer.name + "W"], g[layer.name + "b"] = x.T @ d_table, d_table.sum(0)
        dx += d_table @ net[layer.name + "W"].T
    dx = dx[:-1]
    g["we"] = np.zeros_like(net["we"])
    np.add.at(g["we"], bucket, dx[:, :_E])
    g["ce"] = np.zeros_like(net["ce"])
    for k, layer in enumerate(chars):
        d_table = layer.back(None, np.ascontiguousarray(dx[:, _E + k * _H : _E + (k + 1) * _H]), g)
        g[layer.name + "W"], g[layer.name + "b"] = net["ce"].T @ d_table, d_table.sum(0)
        g["ce"] += d_table @ net[layer.name + "W"].T
    return g


def logits(net, win: Windows, most: int = 8192) -> np.ndarray:
    """The logit of every window."""
    out = np.zeros(len(win.words), _F)
    if not len(out):
        return out
    lengths = win.ends - win.starts
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]))]
    x = np.zeros((len(win.keys) + 1, _E + 2 * _H + 2), _F)
    x[:-1, :_E] = net["we"][_places(net, win.keys)]
    x[:-1, _E + 2 * _H :] = _fixed(net, win.keys, win.raw, win.starts, win.ends)
    for k, (name, place) in enumerate((("cf", lambda n, t: win.starts[:n] + t), ("cb", lambda n, t: win.ends[:n] - 1 - t))):
        steps = [win.raw[place(n, t)] for t, n in enumerate(active)]
        x[:-1, _E + k * _H : _E + (k + 1) * _H] = _Steps(net, name, net["ce"] @ net[name + "W"] + net[name + "b"], steps, len(win.keys), False).last
    tables = {n: x @ net[n + "W"] + net[n + "b"] for n in ("wf", "wb")}
    for a in range(0, len(out), most):
        words, inside = win.words[a : a + most], win.inside[a : a + most]
        steps = [np.ascontiguousarray(words[:, t]) for t in range(WINDOW)]
        f = _Steps(net, "wf", tables["wf"], steps, len(words), False).states
        b = _Steps(net, "wb", tables["wb"], steps[::-1], len(words), False).states[::-1]
        total, pooled = np.zeros(len(words), _F), np.zeros(len(words), _F)
        for t in range(WINDOW):
            h = np.concatenate([f[t], b[t]], 1)
            # Scores are sums of a few bounded terms, so their exponentials need no shift.
            e = np.exp(np.tanh(h @ net["aW"]) @ net["av"]) * inside[:, t]
            total += e
            pooled += e * (h @ net["o"])
        out[a : a + most] = pooled / np.maximum(total, _F(1e-30)) + net["ob"][0]
    return out


def _subset(win: Windows, rows: np.ndarray):
    """The distinct words that some windows use, and those windows over them."""
    used, words = np.unique(win.words[rows], return_inverse=True)
    words = words.reshape(len(rows), WINDOW)
    pad = len(win.keys)
    if len(used) and used[-1] == pad:
        used = used[:-1]
    return win.keys[used], win.raw, win.starts[used], win.ends[used], words, win.inside[rows]


def frequent(win: Windows, most: int = _V, least: int = 8) -> np.ndarray:
    """Sorted keys of the words in most windows."""
    seen = np.bincount(win.words.ravel(), minlength=len(win.keys) + 1)[:-1]
    rows = np.argsort(-seen, kind="stable")[:most]
    return np.sort(win.keys[rows[seen[rows] >= least]])


def train(win: Windows, label: np.ndarray, group: np.ndarray, steps: int = 900, batch: int = 192, rate: float = 0.01, seed: int = 0, settle: int = 150, decay: float = 0.02) -> dict[str, np.ndarray]:
    """Weights fitted on windows whose label is their document's.

    Most windows of a positive document may hold nothing positive: after ``settle`` steps only
    the highest third of each document's windows are positives, and half of the negatives
    are drawn from those that score highest.
    """
    rng = np.random.default_rng(seed)
    net = new_net(seed, frequent(win))
    learned = [k for k, v in net.items() if k != "words" and isinstance(v, np.ndarray)]
    m = {k: np.zeros_like(net[k]) for k in learned}
    s = {k: np.zeros_like(net[k]) for k in learned}
    yes, no = np.flatnonzero(label > 0), np.flatnonzero(label == 0)
    if not len(yes) or not len(no):
        net["o"][:] = 0
        net["ob"][:] = 4.0 if len(yes) else -4.0
        return net
    size = np.bincount(group)
    positive = np.zeros(len(size), bool)
    positive[group[label > 0]] = True
    there = win.words < len(win.keys)
    pairs = np.unique(np.broadcast_to(group[:, None], win.words.shape)[there] * (len(win.keys) + 1) + win.words[there])
    doc, word = pairs // (len(win.keys) + 1), pairs % (len(win.keys) + 1)
    net["sure_words"] = _sure(doc, win.keys[word], positive)
    found = [(doc[word < k], part[word[word < k]]) for k, part in _parts(win.raw, win.starts, win.ends)]
    if found:
        net["sure_parts"] = _sure(np.concatenate([d for d, _ in found]), np.concatenate([g for _, g in found]), positive)
    hard = no
    for step in range(1, steps + 1):
        if step > settle and (step - settle) % 75 == 1:
            p = logits(net, win)
            order = np.lexsort((-p, group))
            rank = np.empty(len(p), np.int64)
            rank[order] = np.arange(len(p)) - np.repeat(np.cumsum(size) - size, size)
            yes = np.flatnonzero((label > 0) & (rank <= size[group] // 3))
            hard = no[np.argsort(-p[no], kind="stable")[: max(batch, len(no) // 50)]]
        rows = np.concatenate([rng.choice(yes, batch // 2), rng.choice(no, batch // 4), rng.choice(hard, batch // 4)])
        y = (label[rows] > 0).astype(_F)
        seen = dict(net, we=net["we"] * (rng.random(len(net["we"])) < 0.7)[:, None].astype(_F))
        out, cache = _forward(seen, *_subset(win, rows), True)
        grads = _backward(seen, cache, ((_sigmoid(out) - y) / len(rows)).astype(_F))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        lr = rate * min(1.0, step / 20) * (0.1 + 0.9 * (1 - step / steps))
        for k in learned:
            g = grads[k] * _F(min(1.0, 1.0 / (norm + 1e-9)))
            m[k] += 0.1 * (g - m[k])
            s[k] += 0.01 * (g * g - s[k])
            net[k] = (net[k] - lr * ((m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8) + decay * net[k])).astype(_F)
    return net
