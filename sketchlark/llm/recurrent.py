"""Small recurrent networks in numpy, trained by backpropagation through time with Adam."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.w[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def gru_weights(rng: np.random.Generator, n_in: int, hidden: int, name: str) -> dict[str, np.ndarray]:
    """Input table (one row per symbol, gates update, reset, new) and recurrent weights."""
    return {
        f"{name}x": (rng.standard_normal((n_in, 3 * hidden)) * 0.1).astype(np.float32),
        f"{name}h": (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32),
    }


def gru_forward(w: dict, name: str, symbols: np.ndarray, keep: bool = False):
    """States (time, batch, hidden) for symbols (time, batch); with keep also what the backward pass needs.

    A symbol without a row in the table stands for nothing: the state is zero after it, as it is before the first one.
    """
    table, rec = w[f"{name}x"], w[f"{name}h"]
    n = rec.shape[0]
    h = np.zeros((symbols.shape[1], n), np.float32)
    states, saved = np.empty((len(symbols), symbols.shape[1], n), np.float32), []
    live = (symbols < len(table)).astype(np.float32)[:, :, None]
    for t, s in enumerate(np.minimum(symbols, len(table) - 1)):
        x, u = table[s], h @ rec
        zr = sigmoid(x[:, : 2 * n] + u[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        new = np.tanh(x[:, 2 * n :] + r * u[:, 2 * n :])
        if keep:
            saved.append((h, z, r, new, u[:, 2 * n :], live[t]))
        h = (new + z * (h - new)) * live[t]
        states[t] = h
    return (states, saved) if keep else states


@np.errstate(over="ignore")  # 1 / inf is 0, as it should be
def gru_project(w: dict, name: str, symbols: np.ndarray, v: np.ndarray, skip: int) -> np.ndarray:
    """(time, outputs, batch): ``gru_forward``'s states times ``v`` for the symbols after the first ``skip``; states aren't kept."""
    table, rec = w[f"{name}x"], w[f"{name}h"]
    n, batch = rec.shape[0], symbols.shape[1]
    # Gates and new state apart, so that every array is contiguous. Exponentials are the cheapest way to both curves:
    # sigmoid(a) = 1 / (1 + exp(-a)) and tanh(a) = 1 - 2 / (1 + exp(2 a)), whose factors are put into the weights.
    update_table, reset_table, new_table = (np.ascontiguousarray(table[:, i * n : (i + 1) * n]) * np.float32(f) for i, f in enumerate((-1, -1, 2)))
    update_rec, reset_rec, new_rec = (np.ascontiguousarray(rec[:, i * n : (i + 1) * n]) * np.float32(f) for i, f in enumerate((-1, -1, 2)))
    one, two = np.float32(1), np.float32(2)
    h = np.zeros((batch, n), np.float32)
    x, z, r, new = (np.empty((batch, n), np.float32) for _ in range(4))
    out = np.empty((len(symbols) - skip, v.shape[1], batch), np.float32)
    across = np.ascontiguousarray(v.T)
    ended = (symbols >= len(table)).any(axis=1)
    for t, s in enumerate(symbols):
        for gate, gate_rec, gate_table in ((z, update_rec, update_table), (r, reset_rec, reset_table)):
            np.matmul(h, gate_rec, out=gate)
            np.take(gate_table, s, axis=0, out=x, mode="clip")
            gate += x
            np.exp(gate, out=gate)
            gate += one
            np.divide(one, gate, out=gate)
        np.matmul(h, new_rec, out=new)
        new *= r
        np.take(new_table, s, axis=0, out=x, mode="clip")
        new += x
        np.exp(new, out=new)
        new += one
        np.divide(two, new, out=new)
        np.subtract(one, new, out=new)
        h -= new
        h *= z
        h += new
        if ended[t]:
            h[s >= len(table)] = 0
        if t >= skip:
            np.matmul(across, h.T, out=out[t - skip])
    return out


def gru_backward(w: dict, name: str, symbols: np.ndarray, saved: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
    table, rec = w[f"{name}x"], w[f"{name}h"]
    n = rec.shape[0]
    g_rec, dh = np.zeros_like(rec), np.zeros_like(d_states[0])
    d_in = np.empty((*symbols.shape, 3 * n), np.float32)
    for t in range(len(symbols) - 1, -1, -1):
        h, z, r, new, un, live = saved[t]
        dh = (dh + d_states[t]) * live
        d_new = dh * (1 - z) * (1 - new * new)
        d_z = dh * (h - new) * z * (1 - z)
        d_r = d_new * un * r * (1 - r)
        d_in[t, :, :n], d_in[t, :, n : 2 * n], d_in[t, :, 2 * n :] = d_z, d_r, d_new
        d_u = np.concatenate([d_z, d_r, d_new * r], 1)
        g_rec += h.T @ d_u
        dh = dh * z + d_u @ rec.T
    # A row of the table gathers what all its symbols' places give.
    flat = np.minimum(symbols, len(table) - 1).ravel()
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    g_table = np.zeros_like(table)
    g_table[flat[order][first]] = np.add.reduceat(d_in.reshape(-1, 3 * n)[order], first, axis=0)
    return {f"{name}x": g_table, f"{name}h": g_rec}


def lstm_weights(rng: np.random.Generator, n_in: int, hidden: int, name: str) -> dict[str, np.ndarray]:
    """Gates in, forget, out, new; the forget bias starts at 1."""
    bias = np.zeros(4 * hidden, np.float32)
    bias[hidden : 2 * hidden] = 1
    return {
        f"{name}x": (rng.standard_normal((n_in, 4 * hidden)) / np.sqrt(n_in)).astype(np.float32),
        f"{name}h": (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32),
        f"{name}b": bias,
    }


def lstm_forward(w: dict, name: str, x: np.ndarray, live: np.ndarray, keep: bool = False):
    """States (time, batch, hidden) for inputs (time, batch, n_in); where live (time, batch) is 0 the state stays."""
    rec = w[f"{name}h"]
    n = rec.shape[0]
    drive = x @ w[f"{name}x"] + w[f"{name}b"]
    h = np.zeros((x.shape[1], n), np.float32)
    c = np.zeros_like(h)
    states, saved = np.empty((*x.shape[:2], n), np.float32), []
    for t in range(len(x)):
        a = drive[t] + h @ rec
        ifo, new = sigmoid(a[:, : 3 * n]), np.tanh(a[:, 3 * n :])
        i, f, o = ifo[:, :n], ifo[:, n : 2 * n], ifo[:, 2 * n :]
        c2 = f * c + i * new
        th = np.tanh(c2)
        on = live[t][:, None]
        if keep:
            saved.append((h, c, i, f, o, new, th, on))
        h, c = h + on * (o * th - h), c + on * (c2 - c)
        states[t] = h
    return (states, saved) if keep else states


def lstm_backward(w: dict, name: str, x: np.ndarray, saved: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
    rec = w[f"{name}h"]
    g_rec, dh, dc = np.zeros_like(rec), np.zeros_like(d_states[0]), np.zeros_like(d_states[0])
    d_drive = np.empty((*x.shape[:2], rec.shape[1]), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, new, th, on = saved[t]
        dh = dh + d_states[t]
        d_out, d_c2 = dh * on, dc * on
        d_c2 = d_c2 + d_out * o * (1 - th * th)
        da = np.concatenate([d_c2 * new * i * (1 - i), d_c2 * c * f * (1 - f), d_out * th * o * (1 - o), d_c2 * i * (1 - new * new)], 1)
        d_drive[t] = da
        g_rec += h.T @ da
        dh = dh * (1 - on) + da @ rec.T
        dc = dc * (1 - on) + d_c2 * f
    flat = d_drive.reshape(-1, d_drive.shape[2])
    return {f"{name}x": x.reshape(-1, x.shape[2]).T @ flat, f"{name}h": g_rec, f"{name}b": flat.sum(0)}
