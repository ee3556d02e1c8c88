"""Stacked recurrent regressors in numpy, for one series' windows: LSTM or GRU layers, layer norm and a small head.

Spark deals the series out (``models.trained``, ``models.forecasts``); this is what runs on one of them.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

VERSION = 1
GATES = {"lstm": 4, "gru": 3}


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * a))


@dataclass(frozen=True)
class Settings:
    """How wide a network is and how it is trained."""

    hidden: int = 64
    layers: int = 2
    dropout: float = 0.2
    epochs: int = 100
    batch: int = 32
    rate: float = 5e-4
    decay: float = 1e-5
    patience: int = 15
    clip: float = 1.0
    seed: int = 0


class Regressor:
    """Layers of ``kind``, dropout between them, and layer norm, ReLU and dropout over the last step's state."""

    def __init__(self, kind: str, features: int, settings: Settings = Settings()):
        self.kind, self.features, self.s = kind, features, settings
        rng, h, g = np.random.default_rng(settings.seed), settings.hidden, GATES[kind]
        m = max(16, h // 2)
        draw = lambda fan, *shape: rng.uniform(-1, 1, shape) / np.sqrt(fan)
        self.p: dict[str, np.ndarray] = {}
        for layer in range(settings.layers):
            width = features if layer == 0 else h
            self.p |= {f"x{layer}": draw(h, width, g * h), f"h{layer}": draw(h, h, g * h), f"b{layer}": draw(h, g * h)}
            if kind == "gru":
                self.p[f"c{layer}"] = draw(h, h)
        self.p |= {"gain": np.ones(h), "shift": np.zeros(h), "in": draw(h, h, m), "in_bias": draw(h, m), "out": draw(m, m), "out_bias": draw(m, 1)}

    def _mask(self, rng: np.random.Generator | None, shape: tuple[int, ...]) -> np.ndarray | None:
        if rng is None or not self.s.dropout:
            return None
        return (rng.random(shape) >= self.s.dropout) / (1 - self.s.dropout)

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None):
        """Outputs of (sequence, step, feature) windows, and what their gradients need; dropout only with ``rng``."""
        run = self._lstm if self.kind == "lstm" else self._gru
        trace = []
        for layer in range(self.s.layers):
            out, kept = run(x, layer)
            mask = self._mask(rng, out.shape) if layer + 1 < self.s.layers else None
            trace.append((x, kept, mask))
            x = out if mask is None else out * mask
        last = x[:, -1]
        centred = last - last.mean(1, keepdims=True)
        scale = 1 / np.sqrt((centred**2).mean(1, keepdims=True) + 1e-5)
        unit = centred * scale
        normed = unit * self.p["gain"] + self.p["shift"]
        a = normed @ self.p["in"] + self.p["in_bias"]
        mask = self._mask(rng, a.shape)
        lit = np.maximum(a, 0) if mask is None else np.maximum(a, 0) * mask
        return lit @ self.p["out"] + self.p["out_bias"][0], (trace, x.shape, unit, scale, normed, a, mask, lit)

    def _lstm(self, x: np.ndarray, layer: int):
        n, steps, _ = x.shape
        h, w = self.s.hidden, self.p[f"h{layer}"]
        given = x @ self.p[f"x{layer}"] + self.p[f"b{layer}"]
        state, cell = np.zeros((n, h)), np.zeros((n, h))
        out, kept = np.empty((n, steps, h)), []
        for t in range(steps):
            a = given[:, t] + state @ w
            gates, g = _sigmoid(a[:, : 3 * h]), np.tanh(a[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, cell = cell, f * cell + i * g
            lit = np.tanh(cell)
            kept.append((i, f, o, g, before, lit, state))
            state = out[:, t] = o * lit
        return out, kept

    def _gru(self, x: np.ndarray, layer: int):
        n, steps, _ = x.shape
        h, w, c = self.s.hidden, self.p[f"h{layer}"], self.p[f"c{layer}"]
        given = x @ self.p[f"x{layer}"] + self.p[f"b{layer}"]
        state, out, kept = np.zeros((n, h)), np.empty((n, steps, h)), []
        for t in range(steps):
            a = state @ w
            gates = _sigmoid(given[:, t, : 2 * h] + a[:, : 2 * h])
            r, u = gates[:, :h], gates[:, h:]
            own = a[:, 2 * h :] + c
            new = np.tanh(given[:, t, 2 * h :] + r * own)
            kept.append((r, u, own, new, state))
            state = out[:, t] = (1 - u) * new + u * state
        return out, kept

    def _back_lstm(self, down: np.ndarray, kept: list, layer: int, grads: dict) -> np.ndarray:
        """Gradients of the gates by step, from those of the layer's outputs."""
        n, steps, h = down.shape
        w, later, cell = self.p[f"h{layer}"], np.zeros((n, h)), np.zeros((n, h))
        gates = np.empty((n, steps, 4 * h))
        for t in range(steps - 1, -1, -1):
            i, f, o, g, before, lit, state = kept[t]
            d = down[:, t] + later
            cell = cell + d * o * (1 - lit * lit)
            a = gates[:, t]
            a[:, :h], a[:, h : 2 * h] = cell * g * i * (1 - i), cell * before * f * (1 - f)
            a[:, 2 * h : 3 * h], a[:, 3 * h :] = d * lit * o * (1 - o), cell * i * (1 - g * g)
            grads[f"h{layer}"] += state.T @ a
            later, cell = a @ w.T, cell * f
        return gates

    def _back_gru(self, down: np.ndarray, kept: list, layer: int, grads: dict) -> np.ndarray:
        n, steps, h = down.shape
        w, later = self.p[f"h{layer}"], np.zeros((n, h))
        gates = np.empty((n, steps, 3 * h))
        for t in range(steps - 1, -1, -1):
            r, u, own, new, state = kept[t]
            d = down[:, t] + later
            fresh = d * (1 - u) * (1 - new * new)
            a = gates[:, t]
            a[:, :h], a[:, h : 2 * h], a[:, 2 * h :] = fresh * own * r * (1 - r), d * (state - new) * u * (1 - u), fresh
            inner = np.concatenate([a[:, : 2 * h], fresh * r], 1)
            grads[f"h{layer}"] += state.T @ inner
            grads[f"c{layer}"] += inner[:, 2 * h :].sum(0)
            later = d * u + inner @ w.T
        return gates

    def gradients(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the mean squared error, and the error."""
        out, (trace, shape, unit, scale, normed, a, mask, lit) = self.forward(x, rng)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = 2 * (out - y) / len(y)
        grads["out"], grads["out_bias"] = lit.T @ d, np.array([d.sum()])
        da = np.outer(d, self.p["out"]) * (a > 0)
        da = da if mask is None else da * mask
        grads["in"], grads["in_bias"] = normed.T @ da, da.sum(0)
        dn = da @ self.p["in"].T
        grads["gain"], grads["shift"] = (dn * unit).sum(0), dn.sum(0)
        du = dn * self.p["gain"]
        down = np.zeros(shape)
        down[:, -1] = scale * (du - du.mean(1, keepdims=True) - unit * (du * unit).mean(1, keepdims=True))
        back = self._back_lstm if self.kind == "lstm" else self._back_gru
        for layer in range(self.s.layers - 1, -1, -1):
            given, kept, mask = trace[layer]
            gates = back(down if mask is None else down * mask, kept, layer, grads)
            flat = gates.reshape(-1, gates.shape[2])
            grads[f"x{layer}"], grads[f"b{layer}"] = given.reshape(-1, given.shape[2]).T @ flat, flat.sum(0)
            down = gates @ self.p[f"x{layer}"].T
        return grads, float(((out - y) ** 2).mean())

    def predict(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + rows])[0] for i in range(0, len(x), rows)]) if len(x) else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray) -> list[tuple[int, float, float | None]]:
        """Train by Adam on shuffled batches, keep the epoch of least validation error, and return the errors by epoch.

        Without validation rows the training error decides.
        """
        s, rng = self.s, np.random.default_rng(self.s.seed + 1)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        best, since, step, history = np.inf, 0, 0, []
        kept = {k: a.copy() for k, a in self.p.items()}
        self.best_epoch = 0
        for epoch in range(1, s.epochs + 1):
            order, errors = rng.permutation(len(y)), []
            for at in range(0, len(y), s.batch):
                rows = order[at : at + s.batch]
                grads, error = self.gradients(x[rows], y[rows], rng)
                errors.append(error)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                shrink = min(1.0, s.clip / (size + 1e-6)) if s.clip else 1.0
                for k, a in self.p.items():
                    g = grads[k] * shrink + s.decay * a
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    a -= s.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            trained = float(np.mean(errors))
            checked = float(((self.predict(xv) - yv) ** 2).mean()) if len(yv) else None
            history.append((epoch, trained, checked))
            value = trained if checked is None else checked
            if value < best:
                best, since, kept, self.best_epoch = value, 0, {k: a.copy() for k, a in self.p.items()}, epoch
            elif (since := since + 1) >= s.patience:
                break
        self.p = kept
        return history


class Linear:
    """Ridge regression on the flattened window, behind the same calls."""

    kind = "linear"

    def __init__(self, features: int, settings: Settings = Settings(), ridge: float = 10.0):
        self.features, self.s, self.ridge, self.best_epoch, self.p = features, settings, ridge, 0, {}

    def fit(self, x, y, xv, yv):
        a = x.reshape(len(x), -1)
        self.p = {"w": np.linalg.solve(a.T @ a + self.ridge * np.eye(a.shape[1]), a.T @ y)}
        return []

    def predict(self, x):
        return x.reshape(len(x), -1) @ self.p["w"]


@dataclass
class Forecaster:
    """A fitted network with the scales of its features and target."""

    network: Regressor | Linear
    mean: np.ndarray
    std: np.ndarray
    target_mean: float
    target_std: float

    @classmethod
    def fitted(cls, kind: str, x: np.ndarray, y: np.ndarray, split: np.ndarray, settings: Settings) -> tuple[Forecaster, list]:
        """Scales come from the training rows alone; a constant feature or target is divided by 1."""
        train, val = split == "train", split == "val"
        mean, std = x[train].mean((0, 1)), x[train].std((0, 1))
        std = np.where(std == 0, 1.0, std)
        centre, spread = float(y[train].mean()), float(y[train].std()) or 1.0
        network = Linear(x.shape[2], settings) if kind == "linear" else Regressor(kind, x.shape[2], settings)
        scaled, target = (x - mean) / std, (y - centre) / spread
        history = network.fit(scaled[train], target[train], scaled[val], target[val])
        return cls(network, mean, std, centre, spread), history

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.network.predict((x - self.mean) / self.std) * self.target_std + self.target_mean

    def dumps(self) -> bytes:
        s, out = self.network.s, io.BytesIO()
        about = np.array([VERSION, self.network.features, s.hidden, s.layers])
        np.savez(out, kind=np.array(self.network.kind), about=about, scale=np.array([self.target_mean, self.target_std, s.dropout]), mean=self.mean, std=self.std, **{f"p_{k}": v for k, v in self.network.p.items()})
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Forecaster:
        with np.load(io.BytesIO(data), allow_pickle=False) as f:
            version, features, hidden, layers = f["about"].tolist()
            if version != VERSION:
                raise ValueError(f"a model of version {version}; this reads {VERSION}")
            kind, scale = str(f["kind"]), f["scale"].tolist()
            settings = Settings(hidden=hidden, layers=layers, dropout=scale[2])
            network = Linear(features, settings) if kind == "linear" else Regressor(kind, features, settings)
            network.p = {k[2:]: f[k] for k in f.files if k.startswith("p_")}
            return cls(network, f["mean"], f["std"], scale[0], scale[1])
