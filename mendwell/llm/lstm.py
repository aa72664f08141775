"""A bidirectional LSTM that scores every step of a sequence, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def reversed_steps(lengths: np.ndarray, steps: int) -> np.ndarray:
    """For each step and sequence the step that stands there when the sequence alone is turned round."""
    at = np.arange(steps)[:, None]
    return np.where(at < lengths, lengths - 1 - at, at)


def run(z: np.ndarray, recurrent: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Hidden states (steps, sequences, units) of projected inputs; with ``keep`` also what going back needs."""
    steps, n, width = z.shape
    units = width // 4
    h, c = np.zeros((n, units), z.dtype), np.zeros((n, units), z.dtype)
    out, held = np.empty((steps, n, units), z.dtype), []
    for t in range(steps):
        a = z[t] + h @ recurrent
        gates, g = sigmoid(a[:, : 3 * units]), np.tanh(a[:, 3 * units :])
        i, f, o = gates[:, :units], gates[:, units : 2 * units], gates[:, 2 * units :]
        new = f * c + i * g
        bent = np.tanh(new)
        m = mask[t][:, None]
        if keep:
            held.append((h, c, i, f, o, g, bent))
        c, h = np.where(m, new, c), np.where(m, o * bent, h)
        out[t] = h
    return (out, held) if keep else out


def back(d_out: np.ndarray, held: list, recurrent: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of the recurrent weights."""
    steps, n, units = d_out.shape
    d_z, d_recurrent = np.zeros((steps, n, 4 * units), d_out.dtype), np.zeros_like(recurrent)
    d_h, d_c = np.zeros((n, units), d_out.dtype), np.zeros((n, units), d_out.dtype)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, bent = held[t]
        m = mask[t][:, None]
        d_h = d_h + d_out[t]
        d_new = np.where(m, d_c + d_h * o * (1 - bent**2), 0)
        d_a = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), np.where(m, d_h * bent, 0) * o * (1 - o), d_new * i * (1 - g**2)], axis=1)
        d_z[t] = d_a
        d_recurrent += h.T @ d_a
        d_h = np.where(m, d_a @ recurrent.T, d_h)
        d_c = np.where(m, d_new * f, d_c)
    return d_z, d_recurrent


class Labeller:
    """Log-odds of every step from what stands before and behind it."""

    NAMES = ("w_f", "u_f", "b_f", "w_b", "u_b", "b_b", "v_f", "v_b", "v_x", "bias")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, inputs: int, units: int, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        bias = np.zeros(4 * units, np.float32)
        bias[units : 2 * units] = 1
        parts = [small(inputs, 4 * units), small(units, 4 * units), bias, small(inputs, 4 * units), small(units, 4 * units), bias.copy()]
        return cls(dict(zip(cls.NAMES, [*parts, small(units), small(units), np.zeros(inputs, np.float32), np.zeros(1, np.float32)], strict=True)))

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        w = self.weights
        steps, n, _ = x.shape
        mask = np.arange(steps)[:, None] < lengths
        turn = reversed_steps(lengths, steps)
        column = np.arange(n)
        ahead = run(x @ w["w_f"] + w["b_f"], w["u_f"], mask, keep)
        behind = run((x @ w["w_b"] + w["b_b"])[turn, column], w["u_b"], mask, keep)
        h_f, h_b = (ahead[0], behind[0]) if keep else (ahead, behind)
        z = h_f @ w["v_f"] + h_b[turn, column] @ w["v_b"] + x @ w["v_x"] + w["bias"][0]
        return (z, mask, turn, column, ahead, behind) if keep else z

    def gradients(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        z, mask, turn, column, (h_f, held_f), (h_b, held_b) = self.forward(x, lengths, True)
        d = (np.where(mask, sigmoid(z) - y, 0) / mask.sum()).astype(np.float32)
        flat = x.reshape(-1, x.shape[2])
        d_f, g_uf = back(d[:, :, None] * w["v_f"], held_f, w["u_f"], mask)
        d_b, g_ub = back((d[:, :, None] * w["v_b"])[turn, column], held_b, w["u_b"], mask)
        d_b = d_b[turn, column]
        each = [
            flat.T @ d_f.reshape(len(flat), -1), g_uf, d_f.sum((0, 1)), flat.T @ d_b.reshape(len(flat), -1), g_ub, d_b.sum((0, 1)),
            np.einsum("tn,tnu->u", d, h_f), np.einsum("tn,tnu->u", d, h_b[turn, column]), flat.T @ d.reshape(-1), d.sum(keepdims=True).reshape(1),
        ]
        return dict(zip(self.NAMES, each, strict=True))

    def train(self, batches: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int, rate: float, seed: int) -> None:
        """Adam over the batches (inputs, labels, lengths) in random order."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                step += 1
                for name, grad in self.gradients(*batches[k]).items():
                    first[name] = 0.9 * first[name] + 0.1 * grad
                    second[name] = 0.99 * second[name] + 0.01 * grad**2
                    change = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                    self.weights[name] = (self.weights[name] - rate * change).astype(np.float32)
