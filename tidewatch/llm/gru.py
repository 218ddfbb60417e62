"""A gated recurrent network with a class-factored softmax, in numpy.

Every token belongs to one class; frequent words share classes of like frequency, all others belong to
the class of their shape. The network gives the class of the next token and, within a class of frequent
words, the word. It sees frequent words as themselves and others as their shape.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

#: Width of the state; words of a class of frequent words, and such classes.
WIDTH, PER_CLASS, WORD_CLASSES = 16, 32, 16
WORDS = PER_CLASS * WORD_CLASSES
#: Steps that gradients go back, and streams that are trained side by side.
WINDOW, STREAMS = 24, 256
RATE = 0.01


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place: a steep-enough curve from 0 to 1 without exponentials."""
    x /= 1 + np.abs(x)
    x *= 0.5
    x += 0.5
    return x


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of each entry and the sums of the rows. Entries are kept below where float32 ends."""
    e = np.exp(np.minimum(x, 60.0, out=x))
    return e, e @ np.ones(e.shape[1], np.float32)


@dataclass
class Network:
    """Input rows (x), recurrence (u), class weights (c, c0), word weights per class (w, w0)."""

    x: np.ndarray
    u: np.ndarray
    c: np.ndarray
    c0: np.ndarray
    w: np.ndarray
    w0: np.ndarray

    @classmethod
    def fresh(cls, shapes: int, classes: np.ndarray, words: np.ndarray, seed: int = 11) -> Network:
        """Random weights; the constants start at the log shares of classes and of words in their class."""
        rng = np.random.default_rng(seed)

        def of(scale: float, *shape: int) -> np.ndarray:
            return (scale * rng.standard_normal(shape)).astype(np.float32)

        return cls(
            of(0.5, WORDS + shapes, 3 * WIDTH),
            of(1 / np.sqrt(WIDTH), WIDTH, 3 * WIDTH),
            of(0.1, WIDTH, WORD_CLASSES + shapes),
            classes.astype(np.float32),
            of(0.1, WORD_CLASSES, WIDTH, PER_CLASS),
            words.astype(np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for p in self.parts():
            out.append(np.ascontiguousarray(flat[at : at + p.size].reshape(p.shape), dtype=np.float32))
            at += p.size
        return Network(*out)

    def step(self, h: np.ndarray, ids: np.ndarray, kept: list | None = None) -> np.ndarray:
        """The state behind one more token of each row."""
        g = h @ self.u
        x = self.x[ids]
        rz = _sigmoid(x[:, : 2 * WIDTH] + g[:, : 2 * WIDTH])
        r, z = rz[:, :WIDTH], rz[:, WIDTH:]
        n = x[:, 2 * WIDTH :] + r * g[:, 2 * WIDTH :]
        n /= 1 + np.abs(n)
        out = h - n
        out *= z
        out += n
        if kept is not None:
            kept.append((h, r, z, n, g[:, 2 * WIDTH :]))
        return out

    def outputs(
        self, states: np.ndarray, classes: np.ndarray, words: np.ndarray, slopes: bool = False, counted: np.ndarray | None = None
    ):
        """Natural log probabilities of the targets, and with ``slopes`` the gradients of their mean loss.

        ``words`` is the place of a frequent word in its class, -1 elsewhere. ``counted`` is 0 for rows that
        are no tokens and 1 for others.
        """
        rows = np.arange(len(states))
        x = states @ self.c
        x += self.c0
        e, sums = _exponentials(x)
        total = x[rows, classes] - np.log(sums)
        if slopes:
            if counted is None:
                share = np.full(len(states), 1.0 / len(states), np.float32)
            else:
                share = (counted / max(1.0, counted.sum())).astype(np.float32)
            d = e
            d *= (share / sums)[:, None]
            d[rows, classes] -= share
            back = d @ self.c.T
            c, c0 = states.T @ d, d.sum(axis=0)
            w, w0 = np.zeros_like(self.w), np.zeros_like(self.w0)
        own = np.flatnonzero(words >= 0)
        own = own[np.argsort(classes[own], kind="stable")]
        edges = np.searchsorted(classes[own], np.arange(WORD_CLASSES + 1))
        for k in range(WORD_CLASSES):
            at = own[edges[k] : edges[k + 1]]
            if len(at):
                state = states[at]
                x = state @ self.w[k]
                x += self.w0[k]
                e, sums = _exponentials(x)
                place = rows[: len(at)]
                total[at] += x[place, words[at]] - np.log(sums)
                if slopes:
                    d = e
                    d *= (share[at] / sums)[:, None]
                    d[place, words[at]] -= share[at]
                    back[at] += d @ self.w[k].T
                    w[k], w0[k] = state.T @ d, d.sum(axis=0)
        return (total, back, [c, c0, w, w0]) if slopes else total


def score_documents(net: Network, bounds: np.ndarray, inputs: np.ndarray, classes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The natural log probability of each document of a chunk.

    Documents run side by side, the longest first, so that at every step those still running are the
    first rows; the state goes on from window to window until a document ends.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = bounds[:-1][order], sizes[order]
    total = np.zeros(len(order))
    h = np.zeros((len(order), WIDTH), np.float32)
    longest = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(longest), side="left")
    t = 0
    while t < longest:
        # Wide at the start and narrow behind, a window has about as many tokens as fit a cache.
        states, where = [], []
        held = 0
        while t < longest and held < 1 << 14:
            n = int(running[t])
            states.append(h[:n])
            at = first[:n] + t
            where.append(at)
            h = net.step(h[:n], inputs[at])
            held += n
            t += 1
        at = np.concatenate(where)
        logs = net.outputs(np.concatenate(states), classes[at], words[at])
        doc = np.concatenate([np.arange(len(w)) for w in where])
        total += np.bincount(doc, weights=logs, minlength=len(total))
    out = np.zeros(len(order))
    out[order] = total
    return out


class Trainer:
    """Truncated back-propagation through time with Adam."""

    def __init__(self, net: Network):
        self.net = net
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
        self.steps = 0

    def update(self, slopes: list[np.ndarray], rate: float) -> None:
        self.steps += 1
        grow = np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for p, g, (m, v) in zip(self.net.parts(), slopes, self.moments):
            m += 0.1 * (g - m)
            g *= g
            v += 0.01 * (g - v)
            p -= (rate * grow) * m / (np.sqrt(v) + 1e-6)

    def window(
        self,
        h: np.ndarray,
        inputs: np.ndarray,
        begins: np.ndarray,
        classes: np.ndarray,
        words: np.ndarray,
        counted: np.ndarray | None,
        rate: float,
    ) -> tuple[np.ndarray, float]:
        """One update from a window (steps x streams); the state goes on, the gradient does not."""
        net, kept, states = self.net, [], []
        steps, streams = inputs.shape
        for t in range(steps):
            # A document starts from nothing.
            h = h * begins[t][:, None]
            states.append(h)
            h = net.step(h, inputs[t], kept)
        flat = np.concatenate(states)
        total, back, (c, c0, w, w0) = net.outputs(
            flat, classes.ravel(), words.ravel(), True, None if counted is None else counted.ravel()
        )
        back = back.reshape(steps, streams, WIDTH)
        u = np.zeros_like(net.u)
        gates = np.empty((steps, streams, 3 * WIDTH), np.float32)
        carry = np.zeros((streams, WIDTH), np.float32)
        for t in range(steps - 1, -1, -1):
            h0, r, z, n, g = kept[t]
            # The state behind step t stands in front of step t + 1, unless a document starts there.
            dh = carry
            dn = dh * (1 - z)
            dn *= (1 - np.abs(n)) ** 2
            out = gates[t]
            near = 2 * np.minimum(r, 1 - r)
            out[:, :WIDTH] = dn * g * (0.5 * near * near)
            near = 2 * np.minimum(z, 1 - z)
            out[:, WIDTH : 2 * WIDTH] = dh * (h0 - n) * (0.5 * near * near)
            out[:, 2 * WIDTH :] = dn
            inner = out.copy()
            inner[:, 2 * WIDTH :] *= r
            u += h0.T @ inner
            carry = dh * z + inner @ net.u.T + back[t]
            carry *= begins[t][:, None]
        rows = inputs.ravel()
        order = np.argsort(rows, kind="stable")
        ids, first = np.unique(rows[order], return_index=True)
        x = np.zeros_like(net.x)
        x[ids] = np.add.reduceat(gates.reshape(-1, 3 * WIDTH)[order], first, axis=0)
        self.update([x, u, c, c0, w, w0], rate)
        if counted is None:
            return h, float(-total.mean())
        return h, float(-(total * counted.ravel()).sum() / max(1.0, counted.sum()))

    def train(self, bounds: np.ndarray, inputs: np.ndarray, classes: np.ndarray, words: np.ndarray, rate: float = RATE) -> float:
        """Go once over a chunk of documents, cut into streams of equal length; the mean loss.

        The last places of the last streams may be no tokens: they do not count.
        """
        size = int(bounds[-1])
        if not size:
            return 0.0
        streams = int(np.clip(size // (WINDOW * 48), 1, STREAMS))
        length = -(-size // streams)
        begins = np.ones(size, np.float32)
        begins[bounds[:-1][bounds[:-1] < size]] = 0

        def laid(a: np.ndarray, filler: float = 0) -> np.ndarray:
            whole = np.concatenate([a, np.full(length * streams - size, filler, a.dtype)])
            return np.ascontiguousarray(whole.reshape(streams, length).T)

        grids = [laid(inputs), laid(begins), laid(classes), laid(words, -1)]
        counted = laid(np.ones(size, np.float32))
        # A stream that begins inside a document starts from nothing too.
        h = np.zeros((streams, WIDTH), np.float32)
        losses = []
        for t in range(0, length, WINDOW):
            part = [g[t : t + WINDOW] for g in grids]
            here = counted[t : t + WINDOW]
            h, loss = self.window(h, *part, None if here.all() else here, rate)
            losses.append(loss)
        return float(np.mean(losses))
