"""A character-level bidirectional LSTM with CRF transitions, forward, backward and decoding, in numpy."""

from __future__ import annotations

import numpy as np

#: Characters by class (fixed values): each listed one is a class of its own, the rest share by kind.
OWN = " \n\t.,:;@+-_%()/\\\"'=#$*|&<>[]{}!?~"
#: Letters that are told apart, whatever their case: those of the words at and dot.
SPELL = "adot"
CLASSES = len(OWN) + len(SPELL) + 6
HIDDEN = 20


def classes(codes: np.ndarray) -> np.ndarray:
    """Class numbers of code points: 0 padding, digits, a-z, A-Z, other non-ASCII, other, then those of OWN and SPELL."""
    table = np.full(129, 5, np.uint8)
    table[48:58], table[97:123], table[65:91], table[128] = 1, 2, 3, 4
    for i, c in enumerate(OWN):
        table[ord(c)] = 6 + i
    for i, c in enumerate(SPELL):
        table[ord(c)] = table[ord(c.upper())] = 6 + len(OWN) + i
    return table[np.minimum(codes, 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """``tags`` labels; inputs are (batch, time) class numbers, all windows of one length (padding is class 0).

    Both directions run side by side: the first axis of their weights and states is the direction, and the backward
    one reads reversed time.
    """

    def __init__(self, tags: int, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = hidden
        self.hidden = h
        bias = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]
        self.params = {
            "in": rng.normal(0, 0.3, (2, CLASSES, 4 * h)),
            "re": rng.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)),
            "bias": np.stack([bias, bias])[:, None],
            "out": rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, tags)),
            "out_b": np.zeros(tags),
            "trans": rng.normal(0, 0.1, (tags, tags)),
            "start": np.zeros(tags),
        }

    def _run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """(time, batch, 2 * hidden) states of both directions, and per step what going back needs."""
        p, h = self.params, self.hidden
        n, t = x.shape
        kind = p["in"].dtype
        out, kept = np.zeros((t, 2, n, h), kind), []
        hid, cell = np.zeros((2, n, h), kind), np.zeros((2, n, h), kind)
        given = p["in"] + p["bias"]
        for s in range(t):
            z = hid @ p["re"]
            z[0] += given[0][x[:, s]]
            z[1] += given[1][x[:, t - 1 - s]]
            g = _sigmoid(z[:, :, : 3 * h])
            i, f, o, c = g[:, :, :h], g[:, :, h : 2 * h], g[:, :, 2 * h :], np.tanh(z[:, :, 3 * h :])
            before, old = cell, hid
            cell = f * cell + i * c
            th = np.tanh(cell)
            hid = o * th
            out[s] = hid
            if keep:
                kept.append((i, f, o, c, th, before, old))
        return np.concatenate([out[:, 0], out[::-1, 1]], 2), kept

    def _back(self, x: np.ndarray, kept: list, grad: np.ndarray) -> dict:
        """Gradients of the input, recurrent and bias weights from those of the states."""
        p, (t, n, _) = self.params, grad.shape
        h = self.hidden
        both = np.stack([grad[:, :, :h], grad[::-1, :, h:]], 1)
        kind = p["re"].dtype
        dh, dc = np.zeros((2, n, h), kind), np.zeros((2, n, h), kind)
        steps, re = np.zeros((2, t, n, 4 * h), kind), np.zeros_like(p["re"])
        back = p["re"].transpose(0, 2, 1)
        for s in range(t - 1, -1, -1):
            i, f, o, c, th, before, old = kept[s]
            dh = dh + both[s]
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc * c * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - c * c)], 2)
            steps[:, s] = dz
            re += old.transpose(0, 2, 1) @ dz
            dh, dc = dz @ back, dc * f
        hot = np.eye(CLASSES, dtype=kind)[x.T].reshape(t * n, CLASSES)
        turned = np.eye(CLASSES, dtype=kind)[x.T[::-1]].reshape(t * n, CLASSES)
        given = np.stack([hot.T @ steps[0].reshape(t * n, -1), turned.T @ steps[1].reshape(t * n, -1)])
        return {"in": given, "re": re, "bias": steps.sum((1, 2))[:, None]}

    def light(self) -> Tagger:
        """The same network in single precision, for decoding."""
        other = Tagger.__new__(Tagger)
        other.hidden, other.params = self.hidden, {k: v.astype(np.float32) for k, v in self.params.items()}
        return other

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(time, batch, tags)"""
        return self._run(x)[0] @ self.params["out"] + self.params["out_b"]

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tag probabilities (time, batch, tags) by forward-backward, scaled at every step; also log Z and the expected
        numbers of transitions, summed over the batch."""
        tr, t = self.params["trans"], len(e)
        top = e.max(2, keepdims=True)
        given, move = np.exp(e - top), np.exp(tr)
        a, b, scale = np.zeros_like(e), np.ones_like(e), np.zeros_like(top)
        for s in range(t):
            now = given[s] * (np.exp(self.params["start"]) if s == 0 else a[s - 1] @ move)
            scale[s] = now.sum(1, keepdims=True)
            a[s] = now / scale[s]
        moves = np.zeros_like(tr)
        for s in range(t - 1, 0, -1):
            ahead = given[s] * b[s] / scale[s]
            b[s - 1] = ahead @ move.T
            moves += a[s - 1].T @ ahead
        return a * b, (np.log(scale) + top).sum((0, 2)), moves * move


    def decode(self, e: np.ndarray) -> np.ndarray:
        """The most probable tag sequences, (batch, time)."""
        tr, t = self.params["trans"], len(e)
        best, back = e[0] + self.params["start"], []
        for s in range(1, t):
            both = best[:, :, None] + tr
            back.append(both.argmax(1))
            best = both.max(1) + e[s]
        path = [best.argmax(1)]
        for step in reversed(back):
            path.append(np.take_along_axis(step, path[-1][:, None], 1)[:, 0])
        return np.stack(path[::-1], 1)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of tags ``y`` and its gradients."""
        p, (n, t) = self.params, x.shape
        both, kept = self._run(x, keep=True)
        e = both @ p["out"] + p["out_b"]
        prob, z, moves = self.marginals(e)
        rows = np.arange(n)
        gold = p["start"][y[:, 0]] + e[np.arange(t)[:, None], rows, y.T].sum(0) + p["trans"][y[:, :-1], y[:, 1:]].sum(1)
        de = prob.copy()
        de[np.arange(t)[:, None], rows, y.T] -= 1
        np.add.at(moves, (y[:, :-1], y[:, 1:]), -1)
        grads = {"trans": moves}
        grads["start"] = de[0].sum(0)
        grads["out"] = np.tensordot(both, de, ((0, 1), (0, 1)))
        grads["out_b"] = de.sum((0, 1))
        grads |= self._back(x, kept, de @ p["out"].T)
        return float((z - gold).mean()), {k: g / n for k, g in grads.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.03, seed: int = 4) -> float:
        """Adam with gradient clipping; returns the last epoch's mean loss."""
        rng, step, loss = np.random.default_rng(seed), 0, 0.0
        self.params = self.light().params
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(q) for k, q in self.params.items()}
        for epoch in range(epochs):
            order, losses = rng.permutation(len(x)), []
            for at in range(0, len(order), batch):
                one, grads = self.step(x[order[at : at + batch]], y[order[at : at + batch]])
                losses.append(one)
                norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
                scale, step = min(1.0, 5.0 / max(norm, 1e-12)), step + 1
                now = rate * (1 - epoch / epochs)
                for k, g in grads.items():
                    g = g * scale
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.params[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            loss = float(np.mean(losses))
        return loss
