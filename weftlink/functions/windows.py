"""The best window of many pairs of texts, by semi-local common subsequences.

Strands enter a grid of two texts at its left side (one a letter of ``s``) and at its top (one a letter of ``t``), and leave at the
right and at the bottom. At two unlike letters strands cross if they have not crossed before, else they turn. The common length
of ``s`` and ``t[i:j]`` is then j - i less the strands that enter at i or later and leave before j, for all windows
at once; windows of ``s`` in ``t`` follow likewise from the right side. A diagonal of cells is worked on at a time, for many pairs.
"""

from __future__ import annotations

import numpy as np

#: Pairs whose grids are worked on together; they stay in cache.
TOGETHER = 2048


def _combed(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For m and n letters in columns: the strands that leave at each letter of ``t``, and at each of ``s`` from its last one on.

    Strands have the numbers 0 to m - 1 from the bottom of the left side up, then m to m + n - 1 along the top.
    """
    m, n = len(s), len(t)
    kind = np.uint8 if m + n < 255 else np.uint16 if m + n < 65535 else np.uint32
    # Rows are held from the last to the first, so that the cells of a diagonal lie side by side.
    back = np.ascontiguousarray(s[::-1])
    width = s.shape[1]
    h = np.repeat(np.arange(m, dtype=kind)[:, None], width, axis=1)
    v = np.repeat(np.arange(m, m + n, dtype=kind)[:, None], width, axis=1)
    same, low = np.empty((m, width), bool), np.empty((m, width), kind)
    for d in range(m + n - 1):
        k0, k1 = m - 1 - min(m - 1, d), m - max(0, d - n + 1)
        j0, size = d - min(m - 1, d), k1 - k0
        left, above, e, b = h[k0:k1], v[j0 : j0 + size], same[:size], low[:size]
        np.equal(back[k0:k1], t[j0 : j0 + size], out=e)
        if kind is np.uint8:
            np.negative(e.view(np.uint8), out=b)
        else:
            np.multiply(e, kind(np.iinfo(kind).max), out=b)
        # Like letters let strands turn, as those do that have crossed: the higher number comes from the left.
        np.bitwise_or(b, left, out=b)
        np.minimum(b, above, out=b)
        np.bitwise_xor(above, left, out=above)
        np.bitwise_xor(above, b, out=above)
        left[...] = b
    return v, h


def _counts(strands: np.ndarray, first: list[int], below: range) -> np.ndarray:
    """How many strands of a column, from the row ``first`` of each number on, are below the numbers."""
    out = np.zeros((len(below), strands.shape[1]), strands.dtype)
    less = np.empty(strands.shape, bool)
    for i, (k, lo) in enumerate(zip(below, first, strict=True)):
        np.less(strands[lo:], strands.dtype.type(k), out=less[lo:])
        np.add.reduce(less[lo:], axis=0, dtype=strands.dtype, out=out[i])
    return out


def _best(s: np.ndarray, t: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts in columns, ``s`` of one length, ``t`` of these sizes that are no less: the best window's ratio, and the common length of both texts.

    Strands that enter behind a text's end leave where they entered. Numbers wrap around to high ones where a strand does not count.
    """
    m, n = len(s), len(t)
    v, h = _combed(s, t)
    kind, least = v.dtype.type, int(sizes.min())
    from_left = (v < m).view(np.uint8)
    whole = from_left.sum(axis=0, dtype=np.int64)
    # Whole windows: a strand is inside if it entered no more letters before its end than the window has there.
    gap = np.arange(m, m + n, dtype=kind)[:, None] - v
    windows = n - m + 1
    inside, hit = np.zeros((windows, s.shape[1]), kind), np.empty((windows, s.shape[1]), bool)
    for w in range(m):
        np.less_equal(gap[w : w + windows], kind(w), out=hit)
        np.add(inside, hit, out=inside)
    # Windows that would stick out count for nothing here.
    inside[np.arange(windows)[:, None] + m > sizes] = m
    best = 200.0 * (m - inside.min(axis=0).astype(np.int64)) / (2 * m)
    # Beginnings and ends of 1 to m - 1 letters.
    lengths = range(1, m)
    begin = np.cumsum(from_left[: m - 1], axis=0, dtype=kind)
    reach = (sizes + (m - 1)).astype(kind) - v
    letters = np.arange(1, m, dtype=kind)[:, None]
    part = np.maximum(begin, letters - _counts(reach, [max(0, least - k) for k in lengths], lengths))
    alike = np.flatnonzero(sizes == m)
    if len(alike):
        h = np.ascontiguousarray(h[:, alike])
        begin = np.cumsum(h[:0:-1] >= m, axis=0, dtype=kind)
        part[:, alike] = np.maximum(part[:, alike], np.maximum(begin, letters - _counts(h, [0] * len(lengths), lengths)))
    for k in lengths:
        np.maximum(best, 200.0 * part[k - 1] / (m + k), out=best)
    return best, whole


def best_windows(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partial ratio and common length of the texts ``x`` of ``a`` and ``y`` of ``b``: letters as positive numbers, a row a text, 0 behind its end and for letters without like."""
    most = int(max(a.max(initial=0), b.max(initial=0))) + 1
    kind = np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32
    a, b = a.astype(kind), b.astype(kind)
    out, common = np.zeros(len(x)), np.zeros(len(x), np.int64)
    nx, ny = size_a[x], size_b[y]
    out[(nx == 0) & (ny == 0)] = 100.0
    for turned, some in ((False, np.flatnonzero((nx <= ny) & (nx > 0))), (True, np.flatnonzero((ny < nx) & (ny > 0)))):
        short, long, p, q, m, n = (b, a, y, x, ny, nx) if turned else (a, b, x, y, nx, ny)
        some = some[np.lexsort((n[some], m[some]))]
        edges = [0, *(np.flatnonzero(np.diff(m[some])) + 1), len(some)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            for k in range(lo, hi, TOGETHER):
                group = some[k : min(k + TOGETHER, hi)]
                rows, columns = m[group[0]], n[group].max()
                s = np.ascontiguousarray(short[p[group], :rows].T)
                # What has no like is another number on the one side than on the other.
                s[s == 0] = most
                out[group], common[group] = _best(s, np.ascontiguousarray(long[q[group], :columns].T), n[group])
    return out, common
