"""Sequential kernels: ``run(state, x)`` takes rows of inputs in order and gives outputs and the next state.

Batch and stream share them; a state is a plain tuple of numbers and arrays. Cutting a series
anywhere and carrying the state over gives the same outputs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np


#: Kernels whose next state is linear in the state and the input, so that parts of a series can run from rest and be put together.
LINEAR: list[type] = []


def linear(cls):
    LINEAR.append(cls)
    return cls


def at_rest(kernel):
    """The state in which nothing has been seen."""
    return (0.0,) if isinstance(kernel, Ema) else tuple(map(at_rest, kernel.kernels)) if isinstance(kernel, (Chain, Bank)) else kernel.start()


def first_state(kernel, x: np.ndarray):
    """The state that a series starts from, given its first inputs (a row)."""
    if isinstance(kernel, Ema):
        return (float(x[0, 0]),)
    if isinstance(kernel, Kalman):
        return tuple(x[0, : kernel.dims].tolist()), (0.0,) * kernel.dims, (kernel.initial, 0.0, kernel.initial)
    if isinstance(kernel, Bank):
        return tuple(first_state(k, x) for k in kernel.kernels)
    if isinstance(kernel, Chain):
        out = []
        for k in kernel.kernels:
            out.append(first_state(k, x))
            x = np.asarray(k.run(out[-1], x)[0], np.float64).reshape(1, -1)
        return tuple(out)
    return kernel.start()


def is_linear(kernel) -> bool:
    return all(map(is_linear, kernel.kernels)) if isinstance(kernel, (Chain, Bank)) else type(kernel) in LINEAR


def flat(state) -> np.ndarray:
    """A state's numbers as a vector."""
    return np.concatenate([flat(x) for x in state] or [np.zeros(0)]) if isinstance(state, tuple) else np.atleast_1d(np.asarray(state, np.float64))


def like(state, v: np.ndarray):
    """A state of the form of ``state`` with the numbers ``v``."""
    if isinstance(state, tuple):
        out, at = [], 0
        for x in state:
            n = len(flat(x))
            out.append(like(x, v[at : at + n]))
            at += n
        return tuple(out)
    return v.copy() if isinstance(state, np.ndarray) else float(v[0])


def advance(kernel, width: int, state, n: int, ended):
    """The state after ``n`` rows from ``state``, if from rest these rows lead to ``ended``."""
    if isinstance(kernel, Fir) and n >= len(kernel.b) - 1:
        return ended  # nothing of the state is left
    if isinstance(kernel, Bank):
        return tuple(advance(k, width, s, n, e) for k, s, e in zip(kernel.kernels, state, ended, strict=True))
    return like(at_rest(kernel), _power(kernel, width, n) @ flat(state) + flat(ended))


@lru_cache(maxsize=256)
def _step(kernel, width: int) -> np.ndarray:
    """What one row of zeros makes of a state."""
    rest = at_rest(kernel)
    dim = len(flat(rest))
    return np.array([flat(kernel.run(like(rest, e), np.zeros((1, width)))[1]) for e in np.eye(dim)]).reshape(dim, dim).T


@lru_cache(maxsize=1024)
def _power(kernel, width: int, n: int) -> np.ndarray:
    return np.linalg.matrix_power(_step(kernel, width), n)


BLOCK = 64


@lru_cache(maxsize=256)
def _responses(a: tuple[float, ...], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of y = f - sum a y': the answers of a block to its own inputs (rows) and to each of the outputs before it (rows, the latest first)."""
    n = len(a)

    def run(past: list[float], first: float) -> list[float]:
        y = list(past)
        for i in range(length):
            y.append((first if i == 0 else 0.0) - sum(c * y[-1 - k] for k, c in enumerate(a)))
        return y[n:]

    h = np.array(run([0.0] * n, 1.0))
    own = np.zeros((length, length))
    for i in range(length):
        own[i, i:] = h[: length - i]
    before = np.array([run([1.0 if n - 1 - j == k else 0.0 for j in range(n)], 0.0) for k in range(n)]).reshape(n, length)
    return own, before


def recur(f: np.ndarray, a: tuple[float, ...], past: tuple[float, ...]) -> tuple[np.ndarray, tuple[float, ...]]:
    """y = f - sum a y' from the outputs ``past`` (the latest first), and the outputs to go on from.

    Of first order it is run as it stands. Of higher order, blocks are answered from rest at once by a matrix product; only what a block leaves to the next is carried one by one.
    """
    n = len(a)
    if not n or not len(f):
        return f, past
    if n == 1:
        c = -a[0]
        y = list(accumulate(f.tolist(), lambda y, v: v + c * y, initial=past[0]))
        return np.array(y[1:]), (y[-1],)
    length = max(BLOCK, n)
    own, before = _responses(a, length)
    if len(f) < 8 or not (np.isfinite(f).all() and np.isfinite(own).all() and np.isfinite(before).all()):
        y = list(past[::-1])
        for v in f.tolist():
            y.append(v - sum(c * y[-1 - k] for k, c in enumerate(a)))
        return np.array(y[n:]), tuple(y[: -n - 1 : -1])
    rest = np.concatenate([f, np.zeros(-len(f) % length)]).reshape(-1, length) @ own
    tails, carry = rest[:, : -n - 1 : -1], before[:, : -n - 1 : -1]
    seen = np.empty((len(rest), n))
    y = np.array(past)
    for i in range(len(rest)):
        seen[i] = y
        y = tails[i] + y @ carry
    out = (rest + seen @ before).ravel()[: len(f)]
    ends = np.concatenate([np.array(past[::-1]), out[-n:]])[: -n - 1 : -1]
    return out, tuple(ends.tolist())


@linear
@dataclass(frozen=True)
class Ema:
    """y = alpha x + (1 - alpha) y', from the first sample."""

    alpha: float

    def __post_init__(self):
        if not 0 < self.alpha <= 1:
            raise ValueError("alpha is in (0, 1]")

    def start(self):
        return (None,)

    def run(self, state, x):
        v = x[:, 0]
        if not len(v):
            return v, state
        if state[0] is not None:
            return recur(self.alpha * v, (self.alpha - 1,), state)
        y, past = recur(self.alpha * v[1:], (self.alpha - 1,), (float(v[0]),))
        return np.concatenate([v[:1], y]), past


@linear
@dataclass(frozen=True)
class LeakyIntegrator:
    """y = x + alpha y'."""

    alpha: float = 0.99

    def __post_init__(self):
        if not 0 < self.alpha <= 1:
            raise ValueError("alpha is in (0, 1]")

    def start(self):
        return (0.0,)

    def run(self, state, x):
        return recur(x[:, 0], (-self.alpha,), state)


@linear
@dataclass(frozen=True)
class Iir:
    """y = sum b x - sum a y, a without a0; direct form."""

    b: tuple[float, ...]
    a: tuple[float, ...] = ()

    def start(self):
        return np.zeros(len(self.b) - 1), (0.0,) * len(self.a)

    def run(self, state, x):
        k = len(self.b) - 1
        whole = np.concatenate([state[0], x[:, 0]])
        y, past = recur(np.convolve(whole, self.b)[k : len(whole)] if len(x) else x[:, 0], self.a, state[1])
        return y, (whole[len(whole) - k :], past)


@dataclass(frozen=True)
class Chain:
    """Kernels in a row, each on the output of the one before."""

    kernels: tuple

    def start(self):
        return tuple(k.start() for k in self.kernels)

    def run(self, state, x):
        new = []
        for k, s in zip(self.kernels, state, strict=True):
            y, s = k.run(s, x)
            new.append(s)
            x = np.asarray(y, np.float64).reshape(len(x), -1)
        return x, tuple(new)


@dataclass(frozen=True)
class Bank:
    """Kernels side by side, each on the same inputs; an output for each."""

    kernels: tuple

    def start(self):
        return tuple(k.start() for k in self.kernels)

    def run(self, state, x):
        made = [k.run(s, x) for k, s in zip(self.kernels, state, strict=True)]
        return np.column_stack([np.asarray(y, np.float64).reshape(len(x), -1) for y, _ in made]), tuple(s for _, s in made)


#: Taps from which a convolution goes by Fourier transforms.
LONG = 128


@lru_cache(maxsize=64)
def _transformed(b: tuple[float, ...], size: int) -> np.ndarray:
    return np.fft.rfft(np.array(b), size)


def _overlap_save(whole: np.ndarray, b: tuple[float, ...]) -> np.ndarray:
    """The valid part of the convolution, a block of some times the taps at a time: each holds the taps' reach before it, which its transform spoils and which is left out."""
    reach = len(b) - 1
    size = 1 << (8 * len(b) - 1).bit_length()
    size = min(size, 1 << (len(whole) - 1).bit_length()) if len(whole) > 2 * len(b) else size
    step = size - reach
    n = len(whole) - reach
    blocks = -(-n // step)
    padded = np.concatenate([whole, np.zeros(blocks * step + reach - len(whole))])
    h, out = _transformed(b, size), np.empty(blocks * step)
    views = np.lib.stride_tricks.sliding_window_view(padded, size)[::step]
    at_once = max(1, (1 << 20) // size)
    for at in range(0, blocks, at_once):
        z = np.fft.irfft(np.fft.rfft(views[at : at + at_once]) * h, size)[:, reach:]
        out[at * step : at * step + z.size] = z.ravel()
    return out[:n]


@linear
@dataclass(frozen=True)
class Fir:
    """y = sum b[k] x[n-k]: by a convolution a chunk, of ``LONG`` taps and more by blocks of Fourier transforms that overlap (of a chunk with values that are not finite, not)."""

    b: tuple[float, ...]

    def start(self):
        return (np.zeros(len(self.b) - 1),)

    def run(self, state, x):
        k = len(self.b) - 1
        whole = np.concatenate([state[0], x[:, 0]])
        if len(self.b) >= LONG and len(x) >= LONG and np.isfinite(whole).all():
            y = _overlap_save(whole, self.b)
        else:
            y = np.convolve(whole, self.b)[k : len(whole)]
        return y, (whole[len(whole) - k :],)


@dataclass(frozen=True)
class Lms:
    """Input x and desired d; gives the error d - w x of each sample. normalized: the step is divided by a running power.

    Starts from ``weights`` (zeros unless given); with ``adapt`` off it only filters. The first part of its state is the weights.
    """

    taps: int
    mu: float = 0.01
    leak: float = 0.0
    normalized: bool = False
    adapt: bool = True
    weights: tuple[float, ...] | None = None

    def __post_init__(self):
        if self.taps < 1 or not 0 < self.mu <= 1 or not 0 <= self.leak < 1:
            raise ValueError("taps are at least 1, mu in (0, 1], leak in [0, 1)")
        if self.weights is not None and len(self.weights) != self.taps:
            raise ValueError("a weight for each tap")

    def start(self):
        return np.zeros(self.taps) if self.weights is None else np.array(self.weights, np.float64), np.zeros(self.taps), 0.0

    def run(self, state, x):
        w, h, power = state[0].copy(), state[1].copy(), state[2]
        out = np.empty(len(x))
        for i, (v, d) in enumerate(x):
            h[1:] = h[:-1].copy()
            h[0] = v
            e = d - w @ h
            step = self.mu
            if self.normalized:
                power = 0.99 * power + 0.01 * v * v
                step = self.mu / (power * self.taps + 1e-6)
            if self.adapt:
                w = (1 - self.mu * self.leak) * w + step * e * h
            out[i] = e
        return out, (w, h, power)

    def run_many(self, states, x: np.ndarray, lengths: np.ndarray):
        """As ``run`` of many series side by side: inputs (series, row, 2), padded after ``lengths``, which do not rise. One step of all series for each row."""
        w, h, power = (np.array([s[j] for s in states], np.float64) for j in range(3))
        out = np.zeros(x.shape[:2])
        for i in range(x.shape[1]):
            n = int(np.searchsorted(-lengths, -i, "left"))  # the series that have a row i
            v, d = x[:n, i, 0], x[:n, i, 1]
            h[:n, 1:] = h[:n, :-1].copy()
            h[:n, 0] = v
            e = d - np.einsum("st,st->s", w[:n], h[:n])
            step = np.full(n, self.mu)
            if self.normalized:
                power[:n] = 0.99 * power[:n] + 0.01 * v * v
                step = self.mu / (power[:n] * self.taps + 1e-6)
            if self.adapt:
                w[:n] = (1 - self.mu * self.leak) * w[:n] + (step * e)[:, None] * h[:n]
            out[:n, i] = e
        return out, [(w[j], h[j], float(power[j])) for j in range(len(states))]


@dataclass(frozen=True)
class Rls:
    """Recursive least squares: the error of each sample before its update."""

    taps: int
    forget: float = 0.99
    delta: float = 0.01

    def __post_init__(self):
        if self.taps < 1 or not 0 < self.forget <= 1 or not self.delta > 0:
            raise ValueError("taps are at least 1, forget in (0, 1], delta positive")

    def start(self):
        return np.zeros(self.taps), np.zeros(self.taps), np.eye(self.taps) * self.delta

    def run(self, state, x):
        w, h, p = (s.copy() for s in state)
        out = np.empty(len(x))
        for i, (v, d) in enumerate(x):
            h[:-1] = h[1:].copy()  # oldest first
            h[-1] = v
            e = d - w @ h
            ph = p @ h
            k = ph / (self.forget + h @ ph)
            w = w + k * e
            p = (p - np.outer(k, ph)) / self.forget
            out[i] = e
        return out, (w, h, p)

    def run_many(self, states, x: np.ndarray, lengths: np.ndarray):
        """As ``run`` of many series side by side; see ``Lms.run_many``."""
        w, h, p = (np.array([s[j] for s in states], np.float64) for j in range(3))
        out = np.zeros(x.shape[:2])
        for i in range(x.shape[1]):
            n = int(np.searchsorted(-lengths, -i, "left"))
            h[:n, :-1] = h[:n, 1:].copy()  # oldest first
            h[:n, -1] = x[:n, i, 0]
            e = x[:n, i, 1] - np.einsum("st,st->s", w[:n], h[:n])
            ph = np.einsum("stu,su->st", p[:n], h[:n])
            k = ph / (self.forget + np.einsum("st,st->s", h[:n], ph))[:, None]
            w[:n] += k * e[:, None]
            p[:n] = (p[:n] - k[:, :, None] * ph[:, None, :]) / self.forget
            out[:n, i] = e
        return out, [(w[j], h[j], p[j]) for j in range(len(states))]


def _inverse(m: np.ndarray) -> np.ndarray:
    """Of a stack of 2 x 2 matrices."""
    a, b, c, d = m[..., 0, 0], m[..., 0, 1], m[..., 1, 0], m[..., 1, 1]
    return np.stack([np.stack([d, -b], -1), np.stack([-c, a], -1)], -2) / (a * d - b * c)[..., None, None]


@dataclass(frozen=True)
class Kalman:
    """Constant velocity in each of ``dims`` columns; a last column holds the seconds since the row before."""

    dims: int
    process: float = 1e-5
    measure: float = 1e-2
    initial: float = 1.0

    def __post_init__(self):
        if not 1 <= self.dims <= 10 or not (self.process >= 0 and self.measure > 0 and self.initial >= 0):
            raise ValueError("dims are 1 to 10, noises and the first covariance not negative, the measurement's positive")

    def start(self):
        return None, None, (self.initial, 0.0, self.initial)

    def run(self, state, x):
        # the dimensions share one 2 x 2 covariance (c00, c01, c11), as noise and motion are alike in all and independent
        d, q, r = self.dims, self.process, self.measure
        at, speed, (c00, c01, c11) = state
        out = []
        for row in x.tolist():
            dt = row[d]
            if at is None:
                at, speed, dt = row[:d], [0.0] * d, 0.0
            c00, c01, c11 = c00 + dt * (2 * c01 + dt * c11) + q, c01 + dt * c11, c11 + q
            s = c00 + r
            k0, k1 = c00 / s, c01 / s
            here, then = [], []
            for z, p, v in zip(row, at, speed):
                p += v * dt
                e = z - p
                here.append(p + k0 * e)
                then.append(v + k1 * e)
            at, speed = here, then
            c11 -= k1 * c01
            c00, c01 = (1 - k0) * c00, (1 - k0) * c01
            out.append(at)
        return np.array(out).reshape(len(x), d), (at, speed, (c00, c01, c11))

    # What rows do to any state before them, as matrices (A, C, J; b and eta for each dimension) that can be joined in any grouping:
    # covariance P -> A (I + P J)^-1 P A' + C, state x -> A (I + P J)^-1 (x + P eta) + b.

    def digest(self, x: np.ndarray):
        """Of the rows ``x``, joined pair by pair."""
        d, q, s = self.dims, self.process, self.process + self.measure
        n, z, dt = len(x), x[:, :d], x[:, d]
        one, zero = np.ones(n), np.zeros(n)
        k = q / s
        a = np.stack([np.stack([(1 - k) * one, (1 - k) * dt], -1), np.stack([zero, one], -1)], -2)
        c = np.broadcast_to(np.diag([(1 - k) * q, q]), (n, 2, 2))
        j = np.stack([np.stack([one, dt], -1), np.stack([dt, dt * dt], -1)], -2) / s
        b = np.stack([k * z, np.zeros((n, d))], 1)
        eta = np.stack([z / s, dt[:, None] * z / s], 1)
        e = (a, b, c, eta, j)
        while len(e[0]) > 1:
            m = len(e[0]) // 2 * 2
            joined = self._pairs(tuple(v[0:m:2] for v in e), tuple(v[1:m:2] for v in e))
            e = tuple(np.concatenate([v, w[m:]]) for v, w in zip(joined, e, strict=True))
        return tuple(np.ascontiguousarray(v[0]) for v in e)

    @staticmethod
    def _pairs(first, then):
        (a, b, c, eta, j), (a2, b2, c2, eta2, j2) = first, then
        t = lambda m: np.swapaxes(m, -1, -2)
        g = a2 @ _inverse(np.eye(2) + c @ j2)
        h = t(a) @ _inverse(np.eye(2) + j2 @ c)
        return g @ a, g @ (b + c @ eta2) + b2, g @ c @ t(a2) + c2, h @ (eta2 - j2 @ b) + eta, h @ j2 @ a + j

    def join(self, first, then):
        return tuple(v[0] for v in self._pairs(tuple(np.asarray(v)[None] for v in first), tuple(np.asarray(v)[None] for v in then)))

    def after(self, state, e):
        """The state after the rows of a digest."""
        at, speed, (c00, c01, c11) = state
        a, b, c, eta, j = e
        p, x = np.array([[c00, c01], [c01, c11]]), np.array([at, speed])
        g = a @ np.linalg.inv(np.eye(2) + p @ j)
        x, p = g @ (x + p @ eta) + b, g @ p @ a.T + c
        return tuple(x[0].tolist()), tuple(x[1].tolist()), (float(p[0, 0]), float(p[0, 1] + p[1, 0]) / 2, float(p[1, 1]))


@dataclass(frozen=True)
class Cooldown:
    """Of flagged samples keeps each that is at least ``distance`` after the last kept."""

    distance: int

    def start(self):
        return (10**9,)

    def run(self, state, x):
        last, out = -state[0] - 1, np.zeros(len(x))  # the place of the last one kept, counted from this batch
        for i in np.flatnonzero(x[:, 0]).tolist():
            if i - last >= self.distance:
                out[i], last = 1.0, i
        return out, (len(x) - 1 - last,)


@linear
@dataclass(frozen=True)
class IntervalPll:
    """A running estimate of the interval: an average of the intervals seen with weight 0.1, from 0."""

    weight: float = 0.1

    def start(self):
        return (0.0,)

    def run(self, state, x):
        return recur(self.weight * x[:, 0], (self.weight - 1,), state)
