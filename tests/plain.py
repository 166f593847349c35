"""Layer builds written plainly, cell by cell, to hold the operators against."""

import math

import numpy as np


def around(p, h, w):
    return [q for q in ((p[0], p[1] - 1), (p[0], p[1] + 1), (p[0] - 1, p[1]), (p[0] + 1, p[1])) if 0 <= q[0] < h and 0 <= q[1] < w]


def parts(g, value):
    """Cells of each 4-connected component, by the first cell of each in row order."""
    h, w = g.shape
    seen, out = set(), []
    for y in range(h):
        for x in range(w):
            if g[y, x] == value and (y, x) not in seen:
                stack, own = [(y, x)], []
                seen.add((y, x))
                while stack:
                    p = stack.pop()
                    own.append(p)
                    for q in around(p, h, w):
                        if g[q] == value and q not in seen:
                            seen.add(q)
                            stack.append(q)
                out.append(sorted(own))
    return out


def islands(g):
    h, w = g.shape
    return [c for c in parts(g, 0) if not any(y in (0, h - 1) or x in (0, w - 1) for y, x in c)]


def labels(g):
    out = np.zeros(g.shape, int)
    for k, cells in enumerate(islands(g), 1):
        for p in cells:
            out[p] = k
    return out


def despeckled(g, least):
    g = g.copy()
    if least > 1:
        for value in (1, 0):
            for cells in parts(g, value):
                if len(cells) < least:
                    for p in cells:
                        g[p] = 1 - value
    return g


def plain_ties(g, label, count_of, most):
    """Ties by a queue for each island, neighbour by neighbour."""
    h, w = g.shape
    sheet = (g == 0) & (label == 0)
    out = []
    for k in range(1, int(label.max()) + 1):
        cells = [tuple(map(int, c)) for c in np.argwhere(label == k)]
        cy, cx = sum(c[0] for c in cells) / len(cells), sum(c[1] for c in cells) / len(cells)
        seen, queue, best = {}, [], {}
        around = lambda p: [q for q in ((p[0], p[1] - 1), (p[0], p[1] + 1), (p[0] - 1, p[1]), (p[0] + 1, p[1])) if 0 <= q[0] < h and 0 <= q[1] < w]
        for c in cells:
            for q in around(c):
                if g[q] and q not in seen:
                    seen[q] = (1, c)
                    queue.append(q)
        for p in queue:
            far, (oy, ox) = seen[p]
            if far > most:
                continue
            for q in around(p):
                if g[q] and q not in seen:
                    seen[q] = (far + 1, (oy, ox))
                    queue.append(q)
                elif not g[q] and sheet[q]:
                    n = count_of(k)
                    sector = min(n - 1, int((math.atan2(oy - cy, ox - cx) + math.pi) / (2 * math.pi) * n))
                    if sector not in best or far < best[sector][0]:
                        best[sector] = (far, (k - 1, ox, oy, q[1], q[0]))
        out += [t for _, t in best.values()]
    return out


def sectors(cells, mm_per_px, spacing):
    if not mm_per_px:
        return 1
    span = max(max(c[i] for c in cells) - min(c[i] for c in cells) for i in (0, 1)) * mm_per_px
    return max(1 if span < 12 else 2, min(5, math.floor(span / spacing + 0.5) or 1))


def ties(g, width, mm_per_px, spacing):
    label, found = labels(g), islands(g)
    most = max(40, math.floor(0.3 * min(g.shape) + 0.5))
    return [(*map(float, t[1:]), float(width)) for t in plain_ties(g, label, lambda k: sectors(found[k - 1], mm_per_px, spacing), most)]


def burnt(g, lines):
    g = g.copy()
    for x1, y1, x2, y2, width in lines:
        r, n = max(0.5, width / 2), max(1, math.ceil(2 * math.hypot(x2 - x1, y2 - y1)))
        for i in range(n + 1):
            px, py = x1 + (x2 - x1) * (i / n), y1 + (y2 - y1) * (i / n)
            for y in range(max(0, math.floor(py - r)), min(g.shape[0], math.ceil(py + r) + 1)):
                for x in range(max(0, math.floor(px - r)), min(g.shape[1], math.ceil(px + r) + 1)):
                    if (x - px) ** 2 + (y - py) ** 2 <= r * r:
                        g[y, x] = 0
    return g


def prepared(g, bright, width, mm_per_px, spacing, most, least, highlights):
    """Mask, ties, islands kept and filled."""
    g = g.copy()
    found = islands(g)
    order = sorted(range(len(found)), key=lambda k: (-len(found[k]), k))
    keep = []
    for k in order:
        if len(keep) < most and len(found[k]) >= least:
            keep.append(k)
    if highlights:
        for k in order:
            n = len(found[k])
            if k not in keep and n >= max(16, 0.15 * least) and sum(bright[p] for p in found[k]) >= 0.5 * n and len(keep) < most + 12:
                keep.append(k)
    for k, cells in enumerate(found):
        if k not in keep:
            for p in cells:
                g[p] = 1
    lines = ties(g, width, mm_per_px, spacing)
    if lines:
        for cells in islands(burnt(g, lines)):
            for p in cells:
                g[p] = 1
    return g, lines, len(keep), len(found) - len(keep)


def framed(g):
    h, w = g.shape
    b = min(max(2, math.floor(0.01 * min(h, w) + 0.5)), min(h, w) // 2)
    return np.array([[g[y, x] if b <= y < h - b and b <= x < w - b else 0 for x in range(w)] for y in range(h)])


def boxed(g, pick, outside):
    h, w = g.shape
    at = lambda y, x: g[y, x] if 0 <= y < h and 0 <= x < w else outside
    return np.array([[pick(at(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) for x in range(w)] for y in range(h)])


def lines_of(lum, amount):
    """The edge layer: gradients, specks dropped, thickened, closed, despeckled, framed."""
    h, w = lum.shape
    g = np.zeros((h, w), int)
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            v = lambda dy, dx: int(lum[y + dy, x + dx])  # noqa: E731, B023
            gx = v(-1, 1) + 2 * v(0, 1) + v(1, 1) - v(-1, -1) - 2 * v(0, -1) - v(1, -1)
            gy = v(1, -1) + 2 * v(1, 0) + v(1, 1) - v(-1, -1) - 2 * v(-1, 0) - v(-1, 1)
            g[y, x] = abs(gx) + abs(gy) > (100 - min(100, max(0, amount))) * 4 + 20
    least = max(40, math.floor(0.00012 * h * w + 0.5))
    for cells in parts(g, 1):
        if len(cells) < least:
            for p in cells:
                g[p] = 0
    g = boxed(boxed(boxed(g, max, 0), max, 0), min, 0)
    return framed(despeckled(g, least))


def built(lum, thresholds, min_feature, width, mm_per_px, spacing, bridge, highlights, amount, span):
    """Threshold, mask and ties of each layer, light to dark, then the edge layer."""
    out = []
    for t in sorted(thresholds, reverse=True):
        g = framed(despeckled((lum < t).astype(int), min_feature**2))
        mask, lines, _, _ = prepared(g, lum >= 210, width, mm_per_px, spacing, 16 if bridge else 0, max(64, (min_feature * span) ** 2), highlights)
        out.append((t, mask, lines))
    if amount is not None:
        out.append((-1, lines_of(lum, amount), []))
    return out
