"""Steps of a pipeline over one series in pieces: ``run(state, rows)`` takes the next rows in order and gives rows and the next state.

Rows out may differ from rows in: windows and kernels give a row for each, resampling, alignment and framing rows of their own grid. Cutting a series anywhere and
carrying the state over gives the same rows. States are nested tuples of numbers and arrays (``functions.states``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

from ..functions import design


@dataclass
class Rows:
    """Samples in order: values (a matrix for frames), microseconds if there are timestamps, further columns that stages read.

    ``place`` are the input rows that rows out belong to (their other columns pass through); on a grid of its own there are none, but ``index``.
    """

    value: np.ndarray
    us: np.ndarray | None = None
    place: np.ndarray | None = None
    index: np.ndarray | None = None
    more: dict[str, np.ndarray] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.value)


class Step:
    def start(self):
        return ()

    def run(self, state, r: Rows) -> tuple[Rows, tuple]:
        raise NotImplementedError


@dataclass(frozen=True)
class Map(Step):
    """A function of the values alone."""

    fn: Callable[[np.ndarray], np.ndarray]

    def run(self, state, r):
        return replace(r, value=self.fn(r.value)), state


@dataclass(frozen=True)
class Kernel(Step):
    """A sequential kernel on the value, or on the columns named."""

    kernel: object
    inputs: tuple[str | None, ...] = (None,)

    def start(self):
        return self.kernel.start()

    def run(self, state, r):
        if not len(r):
            return r, state
        x = np.column_stack([r.value if c is None else r.more[c] for c in self.inputs])
        y, state = self.kernel.run(state, x)
        return replace(r, value=np.asarray(y, np.float64).reshape(len(r), -1)[:, 0]), state


@dataclass(frozen=True)
class Timed(Step):
    """A kernel whose last input is the seconds since the row before (0 at the first, 1 without timestamps)."""

    kernel: object

    def start(self):
        return None, self.kernel.start()

    def run(self, state, r):
        last, inner = state
        if not len(r):
            return r, state
        dt = np.ones(len(r))
        if r.us is not None:
            seconds = r.us / 1e6
            dt = np.diff(seconds, prepend=seconds[0] if last is None else last / 1e6)
            last = int(r.us[-1])
        y, inner = self.kernel.run(inner, np.column_stack([r.value, dt]))
        return replace(r, value=np.asarray(y, np.float64).reshape(len(r), -1)[:, 0]), (last, inner)


def sums(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """x[low] + ... + x[high - 1] of each pair, every one added up by itself."""
    if not len(low):
        return np.zeros(0)
    return np.add.reduceat(np.append(x, 0.0), np.column_stack([low, high]).ravel())[::2]


@dataclass(frozen=True)
class Window(Step):
    """A statistic of the last ``size`` rows, or of those in (t - d, t] for a ``span`` of d microseconds. The state is the tail of the series that the next rows still see."""

    stat: str
    size: int | None = None
    span: int | None = None
    epsilon: float = 1e-6

    def start(self):
        return np.zeros(0), np.zeros(0, np.int64)

    def run(self, state, r):
        old, times = state
        if not len(r):
            return r, state
        x, n = np.concatenate([old, r.value]), len(old)
        high = np.arange(n, len(x)) + 1
        if self.span is None:
            low, us = np.maximum(high - self.size, 0), times
            tail = max(0, len(x) - self.size + 1)
        else:
            us = np.concatenate([times, r.us])
            # rows of one time see each other, as in a range frame; only those that have come count
            low = np.searchsorted(us, us[n:] - self.span, "right")
            tail = int(low[-1])
            us = us[tail:]
        y = self._of(x, low, high)
        return replace(r, value=y), (x[tail:], us)

    def _of(self, x, low, high):
        m = high - low
        if self.stat == "mean":
            return sums(x, low, high) / m
        if self.stat == "rms":
            return np.sqrt(sums(x * x, low, high) / m)
        if self.stat == "mean_absolute":
            return sums(np.abs(x), low, high) / m
        if self.stat == "sum":
            return sums(x, low, high)
        centre = x.mean()
        z = x - centre
        mean = sums(z, low, high) / m
        var = np.maximum(sums(z * z, low, high) / m - mean * mean, 0.0)
        if self.stat == "variance":
            return var
        sd = np.sqrt(var)
        return np.where(sd < self.epsilon, 0.0, (z[high - 1] - mean) / np.where(sd < self.epsilon, 1.0, sd))


@dataclass(frozen=True)
class Cumulative(Step):
    """The mean of all rows so far."""

    def start(self):
        return 0, 0.0

    def run(self, state, r):
        n, total = state
        if not len(r):
            return r, state
        t = total + np.cumsum(r.value)
        return replace(r, value=t / (n + np.arange(1, len(r) + 1))), (n + len(r), float(t[-1]))


@dataclass(frozen=True)
class Difference(Step):
    """x[n] - x[n-1], with x[-1] = 0."""

    def start(self):
        return (0.0,)

    def run(self, state, r):
        if not len(r):
            return r, state
        return replace(r, value=np.diff(r.value, prepend=state[0])), (float(r.value[-1]),)


@dataclass(frozen=True)
class Marks(Step):
    """Of each row a number from it and the two before it, summed over the last ``size`` rows (or, ``any_``, the greatest)."""

    kind: str
    size: int
    threshold: float = 0.0
    any_: bool = False

    def start(self):
        return np.zeros(0), np.zeros(0), 0

    def run(self, state, r):
        before, marks, n = state
        if not len(r):
            return r, state
        x, k = np.concatenate([before, r.value]), len(before)
        d = np.diff(x)
        if self.kind == "length":
            new = np.concatenate([[0.0], np.abs(d)])
        elif self.kind == "steps":
            new = np.concatenate([[0.0], (np.abs(d) > self.threshold) * 1.0])
        else:  # the slope turned at the row before
            new = np.concatenate([[0.0, 0.0], (-d[:-1] * d[1:] > self.threshold) * 1.0])[: len(x)]
        new = new[k:]
        if self.kind == "turns" and self.any_:
            new = np.where(np.arange(n, n + len(r)) < 3, 0.0, new)
        whole = np.concatenate([marks, new])
        high = np.arange(len(marks), len(whole)) + 1
        low = np.maximum(high - self.size, 0)
        y = sums(whole, low, high)
        return replace(r, value=(y > 0) * 1.0 if self.any_ else y), (x[-2:], whole[max(0, len(whole) - self.size + 1) :], n + len(r))


@dataclass(frozen=True)
class Regression(Step):
    """The line through the last n <= size samples at 0 .. n-1; 0 with fewer than two."""

    size: int
    output: str = "slope"

    def start(self):
        return (np.zeros(0),)

    def run(self, state, r):
        if not len(r):
            return r, state
        (old,) = state
        x, out = np.concatenate([old, r.value]), np.zeros(len(r))
        first = max(self.size - 1 - len(old), 0)  # rows before the window is full

        def of(views: np.ndarray) -> np.ndarray:
            n = views.shape[1]
            w = np.arange(n) - (n - 1) / 2
            mean = views.mean(1)
            slope = (views - mean[:, None]) @ w / (w @ w)
            last = mean + slope * (n - 1) / 2
            return {"slope": slope, "intercept": mean - slope * (n - 1) / 2, "predictions": last, "residuals": views[:, -1] - last}[self.output]

        for i in range(min(first, len(r))):
            if len(old) + i >= 1:
                out[i] = of(x[None, : len(old) + i + 1])[0]
        if len(x) >= self.size:
            out[first:] = of(np.lib.stride_tricks.sliding_window_view(x, self.size))[-(len(r) - first) :]
        return replace(r, value=out), (x[max(0, len(x) - self.size + 1) :],)


def _pack(xs: list, n: int) -> np.ndarray:
    return np.concatenate(xs) if xs else np.zeros((0, n) if n else 0)


@dataclass(frozen=True)
class Frames(Step):
    """``fn`` of each full frame: a row with its number. The state is the samples of frames to come, the frames made and, with a hop beyond the size, samples to pass over."""

    size: int
    hop: int
    fn: Callable[[np.ndarray], np.ndarray] | None = None

    def start(self):
        return np.zeros(0), 0, 0

    def run(self, state, r):
        held, done, skip = state
        part = r.value[skip:]
        skip = max(0, skip - len(r))
        whole = np.concatenate([held, part])
        n = (len(whole) - self.size) // self.hop + 1 if len(whole) >= self.size else 0
        views = np.lib.stride_tricks.sliding_window_view(whole, self.size)[:: self.hop] if n else np.zeros((0, self.size))
        if n or self.fn is None:
            got = np.array(views) if self.fn is None else self.fn(views)
        else:
            got = self.fn(np.zeros((1, self.size)))[:0]
        return Rows(np.asarray(got, np.float64), index=np.arange(done, done + n)), (whole[n * self.hop :], done + n, max(skip, n * self.hop - len(whole)))


@dataclass(frozen=True)
class Flatten(Step):
    """The elements of frames as samples."""

    def run(self, state, r):
        n = r.value.shape[1]
        return Rows(r.value.ravel(), index=(r.index[:, None] * n + np.arange(n)).ravel()), state


@dataclass(frozen=True)
class Resample(Step):
    """The rate times up / down by polyphase filters. The state is the count of inputs, the inputs that the filter still sees and, with timestamps, those that neighbour
    times to come. Where an output's time lies past its input, the input waits for the next one."""

    taps: tuple[float, ...]
    up: int
    down: int

    @classmethod
    def of(cls, up: int, down: int, order: int = 51) -> Resample:
        from math import gcd

        from ..operators.resample import lowpass_taps

        if up < 1 or down < 1:
            raise ValueError("factors are positive")
        g = gcd(up, down)
        up, down = up // g, down // g
        return cls(tuple(lowpass_taps(order, min(up, down) / (2 * up * down) if up > 1 else 1 / (2 * down), up)), up, down)

    @property
    def depth(self) -> int:
        return -(-len(self.taps) // self.up)

    @property
    def back(self) -> int:
        """Earlier timestamps that an output's time may need."""
        return -((1 - self.down) // self.up) + 1

    def start(self):
        return 0, np.zeros(self.depth - 1), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def run(self, state, r):
        n, tail, times, waiting, waiting_us = state
        x, us = np.concatenate([waiting, r.value]), r.us
        wait = us is not None and self.up > self.down
        if us is not None:
            us = np.concatenate([waiting_us, us])
        take = max(0, len(x) - 1) if wait else len(x)
        whole = np.concatenate([tail, x[:take]])
        i = np.arange(n, n + take)
        value, index, time = [], [], []
        for p in range(self.up):
            at = np.flatnonzero((i * self.up + p + 1) % self.down == 0)
            h = np.array(self.taps[p :: self.up])
            y = np.zeros(len(at))
            for k, c in enumerate(h):
                y += whole[at + self.depth - 1 - k] * c
            value.append(y)
            index.append((i[at] * self.up + p + 1) // self.down - 1)
            if us is not None:
                low, rest = divmod(p + 1 - self.down, self.up)
                known = np.concatenate([times, us])
                here = at + len(times) + low  # the input at or before the time
                step = np.where(here + 1 < len(known), known[np.minimum(here + 1, len(known) - 1)] - known[here], 0)
                time.append(np.round(known[here] + rest / self.up * step).astype(np.int64))
        order = np.argsort(np.concatenate(index), kind="stable")
        keep = self.back
        if us is not None:
            times = np.concatenate([times, us[:take]])[-keep:]
        out = Rows(np.concatenate(value)[order], np.concatenate(time)[order] if us is not None else None, index=np.concatenate(index)[order])
        rest_us = us[take:] if us is not None else np.zeros(0, np.int64)
        return out, (n + take, whole[len(whole) - (self.depth - 1) :], times, x[take:], rest_us)


@dataclass(frozen=True)
class Align(Step):
    """A uniform grid from the first timestamp, on the line between neighbours, with a policy for gaps. Points are made up to the last sample; the state is the first time, the last two samples."""

    rate: float
    policy: str = "interpolate"
    gap_us: int | None = None

    def start(self):
        return None, np.zeros(0), np.zeros(0, np.int64)

    def run(self, state, r):
        first, v, t = state
        if not len(r):
            return Rows(np.zeros(0), np.zeros(0, np.int64), index=np.zeros(0, np.int64)), state
        v, t = np.concatenate([v, r.value]), np.concatenate([t, r.us])
        last = np.append(t[1:] != t[:-1], True)  # of a time that repeats, the last sample
        v, t = v[last], t[last]
        first = int(t[0]) if first is None else first
        dt = 1e6 / self.rate
        dt = float(round(dt)) if abs(dt - round(dt)) < 1e-9 * dt else dt
        begin = max(0, len(state[1]) - 1)  # the interval from the last sample of before
        if begin >= len(t):
            begin = len(t) - 1
        low = np.maximum(np.ceil((t - first - 0.5) / dt), 0).astype(np.int64)
        value, index, time = [], [], []
        for j in range(begin, len(t) - 1):
            k = np.arange(low[j], low[j + 1])
            if not len(k):
                continue
            at = first + np.floor(k * dt + 0.5).astype(np.int64)
            y = v[j] + (v[j + 1] - v[j]) * ((at - t[j]) / (t[j + 1] - t[j]))
            if self.gap_us is not None and t[j + 1] - t[j] > self.gap_us and self.policy != "interpolate":
                inside = at > t[j]
                if self.policy == "error" and inside.any():
                    raise ValueError("a gap")
                slope = (v[j] - v[j - 1]) / (t[j] - t[j - 1]) if j else 0.0
                filled = {"zero-fill": 0.0, "hold": v[j], "extrapolate": v[j] + slope * (at - t[j]), "error": y}[self.policy]
                y = np.where(inside, filled, y)
            value.append(np.where(at == t[j], v[j], y))
            index.append(k)
            time.append(at)
        out = Rows(_pack(value, 0), _pack(time, 0).astype(np.int64), index=_pack(index, 0).astype(np.int64))
        return out, (first, v[-2:], t[-2:])


def frame_fn(name: str, p: dict) -> tuple[int, int, Callable | None]:
    """(size, hop, function) of a framing stage."""
    from ..operators import frames as f

    size = p["size"] if name != "hilbert" else p.get("size", 512)
    half = max(1, size // 2)
    hop = p.get("hop")
    if name == "frames":
        return size, size if hop is None else hop, None
    if name == "fft":
        return size, size, f.form_fn(p.get("form", "magnitude"))
    if name == "wavelet":
        return size, size, f.dwt_fn(p.get("name", "haar"))
    if name == "hilbert":
        return size, half if hop is None else hop, lambda x: np.abs(f.analytic(x))[:, -1]
    w, of = design.window(p.get("window", "hann"), size), f.form_fn(p.get("form", "magnitude"))
    return size, half if hop is None else hop, lambda x: of(x * w)
