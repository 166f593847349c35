"""A causal self-attention model over subword ids, trained and applied in numpy.

A text is a sequence of ids after a start mark, closed by an end mark. It is cut into blocks of
``BLOCK`` positions; a block's queries see the block before and their own up to themselves, so
windows of two blocks overlap by half and each id is scored once. One head with a learned bias for
each distance and a feed-forward layer give a vector for each position; a softmax over classes adds
what that vector says of a class to the class's log share after the id before, counted over the
whole corpus. Frequent ids are classes of their own; the others are clustered by what stands before
them, and have their counted share of the cluster after the class before. So training starts from
the corpus counts, and attention learns what longer contexts change. All shares sum to one.
"""

from __future__ import annotations

import numpy as np

BLOCK = 32
PAD, START, RARE = 0, 1, 2
#: A training window: the ids that a block's queries see, and the last target; unsigned 16-bit, with marks for no id and the start.
WINDOW = 2 * BLOCK + 1
NONE, BEGIN = 65_535, 65_534
HEADS = 64
DISCOUNT = 0.75
#: Positions whose values for all classes are held at once; few enough for a processor's cache.
ROWS = 256
#: Beyond this size the numbers of a softmax are taken less their maximum, and then no lower than minus this.
SAFE = 80.0
#: A number times ``SCALE``, plus ``ZERO``, and cut to an integer, has the bits of about its exponential as a 32-bit float:
#: linear between powers of two and at most 3 % off, at a fifth of the time. A softmax over such values sums to one like any other.
SCALE, ZERO = 2**23 / np.log(2), 127 * 2**23 - 366_393


def powers(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """About the exponential of ``(x - ZERO) / SCALE``, in the place of ``held``; ``x`` must not be below zero."""
    np.copyto(held, x, casting="unsafe")
    return held.view(np.float32)


class CausalModel:
    """``known`` (ids that the training texts have, by input row from 3 on), class and counted shares of each id, and the weights."""

    def __init__(self, vocabulary: int, end: int, width: int = 16, hidden: int = 32, single: int = 192, clusters: int = 31, seed: int = 3) -> None:
        self.vocabulary, self.end, self.width, self.hidden, self.single, self.clusters = vocabulary, end, width, hidden, single, clusters
        self.n_classes = single + clusters + 1
        self.rng = np.random.default_rng(seed)
        self.causal = np.where(np.arange(2 * BLOCK)[None] <= np.arange(BLOCK)[:, None] + BLOCK, 0, -1e9).astype(np.float32)

    # --- classes and counts

    def heads(self, count: np.ndarray) -> np.ndarray:
        """For each input row the place of its id among the most frequent ones, or ``HEADS``; ``count``: of each id."""
        self.count = count.astype(float)
        if not count.any():
            self.count[self.end] = 1
        seen = np.flatnonzero(self.count)
        self.known = seen[np.argsort(-self.count[seen], kind="stable")]
        self.row = np.full(self.vocabulary, RARE, np.int32)
        self.row[self.known] = np.arange(3, 3 + len(self.known))
        head = np.full(3 + len(self.known), HEADS)
        head[3 : 3 + HEADS] = np.arange(len(self.known[:HEADS]))
        head[START] = head[self.row[self.end]]
        return head

    def classes(self, headed: np.ndarray) -> np.ndarray:
        """For each input row the class of its id; ``headed``: counts of each row (column) after each head (row)."""
        count, order = self.count, self.known
        cls = np.full(self.vocabulary, self.n_classes - 1, np.int32)  # the last class: ids never seen
        alone = order[: self.single]
        cls[alone] = np.arange(len(alone))
        tail = order[self.single :]
        if len(tail):
            table = headed[:, 3 + self.single :].T + 0.5
            x = np.sqrt(table / table.sum(1, keepdims=True))
            centre = x[self.rng.permutation(len(tail))[: self.clusters]]
            for _ in range(8):
                own = (x @ centre.T * 2 - (centre**2).sum(1)).argmax(1)
                total = np.bincount(own, count[tail], len(centre))
                for j in np.flatnonzero(total):
                    mine = own == j
                    centre[j] = np.average(x[mine], axis=0, weights=count[tail][mine])
            cls[tail] = self.single + own
        self.cls = cls
        return np.append([self.n_classes - 1, self.n_classes, self.n_classes - 1], cls[order])

    def shares(self, cell: np.ndarray, follow: np.ndarray) -> None:
        """Takes counts of each input row (column) after each class and the start (row), and of each class (row) after each input row (column)."""
        cls, known = self.cls, self.known
        total = np.bincount(cls, self.count + 0.05, self.n_classes)
        share = (self.count + 0.05) / total[cls]
        # share of each id in its class by the class before it (the last row: at the start); ids never seen share their class evenly
        self.after = np.zeros((len(cell), 3 + len(known)), np.float32)
        for i, own in enumerate(cell[:, 3:]):
            of_class = np.bincount(cls[known], own, self.n_classes)
            self.after[i, 3:] = np.log((own + 15 * share[known]) / (of_class[cls[known]] + 15))
        self.rest = np.where(self.row == RARE, np.log(share), 0)
        prior = np.maximum(total, 1e-3)
        prior /= prior.sum()
        # a class after an id: counts less a discount, which goes to the classes by their share of all
        self.next = np.empty((3 + len(known), self.n_classes), np.float32)
        self.next[[PAD, RARE]] = np.log(prior)
        for row in [START, *range(3, len(self.next))]:
            own = follow[:, row].astype(np.float64)
            n, kinds = own.sum(), np.count_nonzero(own)
            self.next[row] = np.log((np.maximum(own - DISCOUNT, 0) + (DISCOUNT * kinds + 1) * prior) / (n + 1))

    # --- training

    def begin(self) -> dict[str, np.ndarray]:
        """Weights from which every trainer starts."""
        d, m, rng = self.width, self.hidden, self.rng
        r = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        w = {"e": rng.normal(0, 0.3, (3 + len(self.known), d)).astype(np.float32), "q": r(d, d), "k": r(d, d), "v": r(d, d), "w1": r(d, m), "b1": np.zeros(m, np.float32), "w2": r(m, d) * 0.5, "c": np.zeros((d, self.n_classes), np.float32), "c0": np.zeros(self.n_classes, np.float32), "near": np.zeros((BLOCK, 2 * BLOCK), np.float32)}
        w["e"][PAD] = 0
        return w

    def _blocks(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input rows of two blocks and target classes (-1: none) for each window."""
        row, cls = np.full(1 << 16, PAD, np.int32), np.full(1 << 16, -1, np.int32)
        row[: self.vocabulary], row[BEGIN] = self.row, START
        cls[: self.vocabulary] = self.cls
        return row[windows[:, :-1]], cls[windows[:, BLOCK + 1 :]]

    def _gradient(self, w: dict, x: np.ndarray, y: np.ndarray, held: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the weights; that of ``e`` only for the rows in ``x``, which are the second value.

        Most of the time goes into passes over the classes' values, so these are made for ``ROWS``
        positions at once, in the same memory, and what scales a row of them is put on its vector instead.
        """
        d, c = self.width, self.n_classes
        f, n = np.float32, len(x)
        scale = f(1 / np.sqrt(d))
        if not held:
            held.update(p=np.empty((ROWS, c), f), g=np.empty((ROWS, c), f), ones=np.ones((max(c, 2 * BLOCK), 1), f))
        ones = held["ones"]
        flat = lambda t: t.reshape(-1, t.shape[-1])
        longest = lambda t: np.sqrt(np.einsum("ij,ij->i", t, t).max())
        e = np.take(w["e"], x, 0)
        kv = np.hstack([w["k"], w["v"]])
        t = flat(e) @ kv
        k, v = t[:, :d].reshape(n, -1, d), t[:, d:].reshape(n, -1, d)
        eq = np.ascontiguousarray(e[:, BLOCK:])
        q = (flat(eq) @ (w["q"] * scale)).reshape(n, BLOCK, d)
        a = q @ k.transpose(0, 2, 1)
        a += w["near"] + self.causal
        empty = np.flatnonzero((x == PAD).any(1))
        a[empty] += np.where(x[empty] == PAD, f(-1e9), f(0))[:, None, :]
        if longest(flat(q)) * longest(t[:, :d]) + np.abs(w["near"]).max() > SAFE:
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        a /= a @ ones[: 2 * BLOCK]
        av = a @ v
        h = flat(eq + av)
        u = h @ w["w1"]
        u += w["b1"]
        np.maximum(u, 0, out=u)
        z = np.ones((n * BLOCK, d + 1), f)  # the last column is for c0
        np.add(u @ w["w2"], h, out=z[:, :d])
        large = longest(z[:, :d]) * np.linalg.norm(w["c"], axis=0).max() + np.abs(w["c0"]).max() > SAFE
        y, before = y.ravel(), x[:, BLOCK:].ravel()
        share = np.where(y >= 0, f(1 / max(1, np.count_nonzero(y >= 0))), f(0))[:, None]
        c1, ct, gc, gz = np.vstack([w["c"], w["c0"]]), np.ascontiguousarray(w["c"].T), np.zeros((d + 1, c), f), np.empty((n * BLOCK, d), f)
        for i in range(0, n * BLOCK, ROWS):
            j = min(i + ROWS, n * BLOCK)
            p = np.matmul(z[i:j], c1, out=held["p"][: j - i])
            p += np.take(self.next, before[i:j], 0, held["g"][: j - i], "clip")
            if large:
                p -= p.max(1, keepdims=True)
            np.exp(p, out=p)
            total = p @ ones[:c]
            at = np.flatnonzero(y[i:j] >= 0)
            p[at, y[i:j][at]] -= total[at, 0]
            total = share[i:j] / total
            gc += (z[i:j] * total).T @ p
            np.matmul(p, ct, out=gz[i:j])
            gz[i:j] *= total
        g = {"c": gc[:d], "c0": gc[d]}
        gu = gz @ w["w2"].T
        gu *= u > 0
        g |= {"w2": u.T @ gz, "w1": h.T @ gu, "b1": gu.sum(0)}
        gh = (gz + gu @ w["w1"].T).reshape(n, BLOCK, d)
        gt = np.empty((n, 2 * BLOCK, 2 * d), f)
        np.matmul(a.transpose(0, 2, 1), gh, out=gt[:, :, d:])
        gs = gh @ v.transpose(0, 2, 1)
        gs -= np.einsum("nij,nij->ni", gh, av)[:, :, None]
        gs *= a
        g["near"] = gs.sum(0)
        gq = flat(gs @ k)
        np.matmul(gs.transpose(0, 2, 1), q, out=gt[:, :, :d])  # q holds the scale
        both = flat(e).T @ flat(gt)
        g |= {"q": flat(eq).T @ gq * scale, "k": both[:, :d], "v": both[:, d:]}
        ge = (flat(gt) @ kv.T).reshape(n, 2 * BLOCK, d)
        ge[:, BLOCK:] += gh + (gq @ (w["q"].T * scale)).reshape(n, BLOCK, d)
        rows = x.ravel().astype(np.uint16)  # rows are fewer than ids, and numbers of 16 bits are sorted by digits
        order = np.argsort(rows, kind="stable")
        rows = rows[order].astype(np.int64)
        cut = np.flatnonzero(np.diff(rows, prepend=-1))
        g["e"] = np.add.reduceat(flat(ge)[order], cut)
        return g, rows[cut]

    def freeze(self, w: dict[str, np.ndarray], met: np.ndarray) -> CausalModel:
        """Lays the weights out for scoring; ids met in no window, and those never seen, are read as an id of the clusters on average."""
        e, met = w["e"].copy(), met.copy()
        tail = np.flatnonzero(met[3 + self.single :]) + 3 + self.single
        met[[PAD, START]] = True
        e[~met] = e[tail].mean(0) if len(tail) else 0
        scale = np.float32(1 / np.sqrt(self.width))
        self.table = np.hstack([e @ w["q"] * scale * SCALE, e @ w["k"], e @ w["v"], e]).astype(np.float32)
        self.bias = ((w["near"] + self.causal) * SCALE + ZERO).astype(np.float32)
        self.w1, self.b1, self.w2 = w["w1"], w["b1"], w["w2"]
        self.next += w["c0"]
        self.reach, self.base = np.linalg.norm(w["c"], axis=0).max(), np.abs(self.next).max()
        self.c = (w["c"] * SCALE).astype(np.float32)
        self.next = (self.next * SCALE + ZERO).astype(np.float32)
        return self

    # --- scoring

    def score(self, ids: np.ndarray, lengths: np.ndarray, at_once: int = 64) -> np.ndarray:
        """Log10 probability of each sequence of ids (end to end in ``ids``), its end included."""
        log, begin = self.logs(ids, lengths, at_once)
        return np.add.reduceat(log, begin) / np.log(10) if len(lengths) else np.zeros(0)

    def logs(self, ids: np.ndarray, lengths: np.ndarray, at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each id and end after all before it, and where each sequence begins; blocks are filled up with zeros."""
        n = lengths.astype(np.int64) + 1
        blocks = -(-n // BLOCK)
        begin = (np.cumsum(blocks) - blocks) * BLOCK
        size = int(blocks.sum()) * BLOCK
        spot = np.arange(len(ids)) + np.repeat(begin - (np.cumsum(n - 1) - (n - 1)), n - 1)
        x = np.full(size, PAD, np.int32)
        x[begin] = START
        x[spot + 1] = self.row[ids]
        y = np.full(size, -1, np.int32)
        y[spot] = ids
        y[begin + n - 1] = self.end
        fresh = np.zeros(size // BLOCK, np.bool_)
        fresh[begin // BLOCK] = True
        previous = np.full(size, self.n_classes, np.int32)
        previous[spot + 1] = self.cls[ids]
        own = self.cls[y]
        out = np.zeros(size)
        tail = np.flatnonzero((own >= self.single) & (y >= 0))
        out[tail] = self.after[previous[tail], self.row[y[tail]]] + self.rest[y[tail]]
        d, c, at_once = self.width, self.n_classes, min(at_once, max(1, size // BLOCK))
        rows, share, ones, f = np.arange(ROWS), np.empty(at_once * BLOCK), np.ones((max(c, 2 * BLOCK), 1), np.float32), np.float32
        high, low = f(ZERO + SAFE * SCALE), f(ZERO - SAFE * SCALE)
        # the large arrays are made once, as new ones cost more than the numbers in them
        t0, both, s0, l0, p0 = np.empty((at_once * BLOCK, 4 * d), f), np.zeros((at_once, 2 * BLOCK, 2 * d), f), np.empty((at_once, BLOCK, 2 * BLOCK), f), np.empty((ROWS, c), f), np.empty((ROWS, c), f)
        s1, l1 = np.empty(s0.shape, np.int32), np.empty(l0.shape, np.int32)
        for a in range(0, size // BLOCK, at_once):
            b = min(a + at_once, size // BLOCK)
            i, j, n = a * BLOCK, b * BLOCK, b - a
            t = np.take(self.table, x[i:j], 0, t0[: j - i], "clip").reshape(n, BLOCK, 4 * d)
            both[0, :BLOCK] = both[-1, BLOCK:]
            both[:n, BLOCK:] = t[:, :, d : 3 * d]
            both[1:n, :BLOCK] = both[: n - 1, BLOCK:]
            s = np.matmul(t[:, :, :d], both[:n, :, :d].transpose(0, 2, 1), out=s0[:n])
            s += self.bias
            s[fresh[a:b], :, :BLOCK] = -1
            if s.max() > high:
                s += np.minimum(high - s.max(2, keepdims=True), 0)
            np.maximum(s, 0, out=s)
            s = powers(s, s1[:n])
            h = s @ both[:n, :, d:]
            h /= s @ ones[: 2 * BLOCK]
            h += t[:, :, 3 * d :]
            h = h.reshape(-1, d)
            u = h @ self.w1
            u += self.b1
            np.maximum(u, 0, out=u)
            h += u @ self.w2
            large = np.sqrt(np.einsum("ij,ij->i", h, h).max()) * self.reach + self.base > SAFE
            for r in range(i, j, ROWS):
                m = min(ROWS, j - r)
                logits = np.matmul(h[r - i : r - i + m], self.c, out=l0[:m])
                logits += np.take(self.next, x[r : r + m], 0, p0[:m], "clip")
                if large:
                    logits += f(ZERO) - logits.max(1, keepdims=True)
                    np.maximum(logits, low, out=logits)
                p = powers(logits, l1[:m])
                np.divide(p[rows[:m], own[r : r + m]], (p @ ones[:c])[:, 0], out=share[r - i : r - i + m], dtype=np.float64)
            out[i:j] += np.log(share[: j - i])
        out[y < 0] = 0
        return out, begin


class Trainer:
    """Adam from given weights over windows as they come; rows of ``e`` that a batch lacks stay as they are."""

    def __init__(self, model: CausalModel, w: dict[str, np.ndarray], from_: float, to: float, expected: float, batch: int = 64, rate: float = 0.01, seed: int = 5) -> None:
        """``from_`` and ``to``: what part of all training this is; the rate falls to its end, by the ``expected`` number of windows."""
        self.model, self.from_, self.to, self.expected, self.batch, self.rate = model, from_, to, max(1.0, expected), batch, rate
        self.w = {k: v.copy() for k, v in w.items()}
        self.first = {k: np.zeros_like(v) for k, v in w.items()}
        self.second = {k: np.zeros_like(v) for k, v in w.items()}
        self.met = np.zeros(len(w["e"]), np.bool_)
        self.rng, self.step, self.seen, self.held = np.random.default_rng(seed), 0, 0, {}

    def learn(self, windows: np.ndarray, least: int = 0) -> None:
        """One pass over the windows in an order of its own, more passes if ``least`` steps need them."""
        xs, ys = self.model._blocks(windows)
        size = max(len(xs), least * self.batch)
        self.expected = max(self.expected, size)
        order = np.concatenate([self.rng.permutation(len(xs)) for _ in range(-(-size // len(xs)))])[:size]
        for at in range(0, size, self.batch):
            own = order[at : at + self.batch]
            self._step(xs[own], ys[own])
            self.seen += len(own)

    def _step(self, x: np.ndarray, y: np.ndarray) -> None:
        g, rows = self.model._gradient(self.w, x, y, self.held)
        self.met[rows] = True
        self.step += 1
        now = self.rate * min(1.0, self.step / 20) * (1 - self.from_ - (self.to - self.from_) * min(0.999, self.seen / self.expected)) ** 0.7
        one, two = np.float32(now / (1 - 0.9**self.step)), np.float32(1 / (1 - 0.99**self.step))
        for k, v in g.items():
            i = rows if k == "e" else slice(None)
            first, second = self.first[k][i] * np.float32(0.9) + np.float32(0.1) * v, self.second[k][i] * np.float32(0.99) + np.float32(0.01) * v * v
            self.first[k][i], self.second[k][i] = first, second
            self.w[k][i] -= one * first / (np.sqrt(second * two) + np.float32(1e-6))
        self.w["e"][PAD] = 0
