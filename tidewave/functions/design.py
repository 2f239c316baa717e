"""Filter and filter-bank designs, on the driver. Frequencies are in Hz of a sample rate; ``a`` leaves out a0 = 1."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from .expr import bark_to_hz, hz_to_bark, hz_to_mel, mel_to_hz


@dataclass(frozen=True)
class Coefficients:
    """Of order above two, ``sections`` of up to second order are what is applied in cascade; b and a are their product, whose rounding moves poles."""

    b: tuple[float, ...]
    a: tuple[float, ...] = ()
    sections: tuple[Coefficients, ...] = ()

    @property
    def order(self) -> int:
        return max(len(self.b) - 1, len(self.a))

    @property
    def parts(self) -> tuple[Coefficients, ...]:
        return self.sections or (self,)

    def radius(self) -> float:
        """The largest pole's distance from zero."""
        return max((float(np.abs(np.roots([1.0, *c.a])).max(initial=0.0)) for c in self.parts if c.a), default=0.0)

    def is_stable(self) -> bool:
        """All poles inside the unit circle."""
        return self.radius() < 1.0

    def response(self, f: float, rate: float) -> complex:
        z = np.exp(-2j * np.pi * f / rate)
        return complex(np.prod([np.polyval(c.b[::-1], z) / np.polyval([1.0, *c.a][::-1], z) for c in self.parts]))


def _of(b, a) -> Coefficients:
    b, a = np.atleast_1d(b) / a[0], np.atleast_1d(a) / a[0]
    return Coefficients(tuple(map(float, b)), tuple(map(float, a[1:])))


def _cut(f: float, rate: float) -> float:
    if not 0 < f < rate / 2:
        raise ValueError("a cutoff lies between 0 and half the sample rate")
    return f / rate


def window(kind: str, n: int) -> np.ndarray:
    """Symmetric windows."""
    made = {"none": np.ones, "rect": np.ones, "hann": np.hanning, "hamming": np.hamming, "blackman": np.blackman, "bartlett": np.bartlett}
    if kind not in made:
        raise ValueError(f"unknown window {kind}")
    return made[kind](n)


def _odd(taps: int) -> int:
    if taps < 1:
        raise ValueError("a filter has at least one tap")
    return taps + 1 - taps % 2


def fir_lowpass(taps: int, cutoff: float, rate: float, kind: str = "hamming") -> Coefficients:
    """Windowed sinc with gain 1 at 0 Hz; an even number of taps becomes odd."""
    n = _odd(taps)
    m = np.arange(n) - n // 2
    h = 2 * _cut(cutoff, rate) * np.sinc(2 * _cut(cutoff, rate) * m) * window(kind, n)
    return Coefficients(tuple(map(float, h / h.sum())))


def _delta_minus(h: Coefficients) -> Coefficients:
    b = -np.array(h.b)
    b[len(b) // 2] += 1
    return Coefficients(tuple(map(float, b)))


def fir_highpass(taps: int, cutoff: float, rate: float, kind: str = "hamming") -> Coefficients:
    return _delta_minus(fir_lowpass(taps, cutoff, rate, kind))


def fir_bandpass(taps: int, low: float, high: float, rate: float, kind: str = "hamming") -> Coefficients:
    if not low < high:
        raise ValueError("low is below high")
    return Coefficients(tuple(float(x - y) for x, y in zip(fir_lowpass(taps, high, rate, kind).b, fir_lowpass(taps, low, rate, kind).b)))


def fir_bandstop(taps: int, low: float, high: float, rate: float, kind: str = "hamming") -> Coefficients:
    return _delta_minus(fir_bandpass(taps, low, high, rate, kind))


def fir_optimal(taps: int, bands: list[tuple[float, float, float]], rate: float) -> Coefficients:
    """Least-squares linear-phase design of (from, to, gain) bands; in the place of tables of coefficients."""
    n = _odd(taps)
    half = n // 2
    f = np.concatenate([np.linspace(a, b, 40 * (half + 1)) for a, b, _ in bands]) / rate
    want = np.concatenate([np.full(40 * (half + 1), g) for *_, g in bands])
    c = np.linalg.lstsq(np.cos(2 * np.pi * np.outer(f, np.arange(half + 1))), want, rcond=None)[0]
    return Coefficients(tuple(map(float, np.concatenate([c[:0:-1] / 2, c[:1], c[1:] / 2]))))


def optimal_lowpass(taps: int, cutoff: float, rate: float, gap: float = 0.1) -> Coefficients:
    c = cutoff
    return fir_optimal(taps, [(0, c * (1 - gap), 1.0), (min(c * (1 + gap), rate / 2), rate / 2, 0.0)], rate)


def optimal_highpass(taps: int, cutoff: float, rate: float, gap: float = 0.1) -> Coefficients:
    return fir_optimal(taps, [(0, cutoff * (1 - gap), 0.0), (min(cutoff * (1 + gap), rate / 2), rate / 2, 1.0)], rate)


def optimal_bandpass(taps: int, low: float, high: float, rate: float, gap: float = 0.1) -> Coefficients:
    return fir_optimal(taps, [(0, low * (1 - gap), 0.0), (low * (1 + gap), high * (1 - gap), 1.0), (min(high * (1 + gap), rate / 2), rate / 2, 0.0)], rate)


def power_line_notch(rate: float, line: float = 50.0, taps: int = 201, width: float = 4.0) -> Coefficients:
    return fir_optimal(taps, [(0, line - width, 1.0), (line - 0.25, line + 0.25, 0.0), (line + width, rate / 2, 1.0)], rate)


def cascade(*parts: Coefficients) -> Coefficients:
    """One after the other; of second order in all, one section."""
    b, a = np.ones(1), np.ones(1)
    for p in parts:
        b, a = np.convolve(b, p.b), np.convolve(a, [1.0, *p.a])
    each = tuple(c for p in parts for c in p.parts)
    return replace(_of(b, a), sections=each if len(each) > 1 and max(len(b), len(a)) > 3 else ())


def _bilinear(poles: np.ndarray, zeros: np.ndarray, gain: float) -> Coefficients:
    """Analog poles and zeros (for a sample interval of 2) to a digital filter."""
    z = np.concatenate([(1 + zeros) / (1 - zeros), -np.ones(len(poles) - len(zeros))])
    p = (1 + poles) / (1 - poles)
    k = gain * float(np.real(np.prod(1 - zeros) / np.prod(1 - poles)))
    if len(p) <= 2:
        return _of(k * np.real(np.poly(z)), np.real(np.poly(p)))
    made = _sections(z, p)
    return cascade(Coefficients(tuple(float(x * k / np.prod([g for _, g in made])) for x in made[0][0].b), made[0][0].a), *[c for c, _ in made[1:]])


def _sections(zeros: np.ndarray, poles: np.ndarray) -> list[tuple[Coefficients, float]]:
    """Pairs of conjugate (or two real) poles with two of the real zeros each, the widest first; gain 1 away from the zeros, and the factor put in for that."""
    upper = sorted(poles[poles.imag > 1e-12], key=abs)
    real = sorted(poles[np.abs(poles.imag) <= 1e-12].real, key=abs)
    groups = [real[i : i + 2] for i in range(0, len(real), 2)] + [[p, np.conj(p)] for p in upper]
    groups.sort(key=lambda g: max(map(abs, g)))
    out, left = [], list(np.real(zeros))
    for g in groups:
        own, left = left[: len(g)], left[len(g) :]
        b, a = np.poly(own), np.real(np.poly(g))
        at = -np.sign(own[0])
        gain = float(np.polyval(a, at) / np.polyval(b, at))
        out.append((_of(gain * b, a), gain))
    return out


def _prototype(order: int, ripple: float | None) -> tuple[np.ndarray, float]:
    """Poles of an analog low-pass at 1 rad/s and its gain; Butterworth, or Chebyshev I with a ripple in decibels."""
    if not 1 <= order <= 8:
        raise ValueError("orders are 1 to 8")
    t = np.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    if ripple is None:
        p = np.exp(1j * (t + np.pi / 2))
        return p, float(np.real(np.prod(-p)))
    if not 0 < ripple <= 3:
        raise ValueError("a ripple is in (0, 3] dB")
    eps = np.sqrt(10 ** (ripple / 10) - 1)
    mu = np.arcsinh(1 / eps) / order
    p = -np.sinh(mu) * np.sin(t) + 1j * np.cosh(mu) * np.cos(t)
    return p, float(np.real(np.prod(-p))) / (np.sqrt(1 + eps**2) if order % 2 == 0 else 1.0)


def _lowpass(order: int, cutoff: float, rate: float, ripple: float | None) -> Coefficients:
    w = np.tan(np.pi * _cut(cutoff, rate))
    p, g = _prototype(order, ripple)
    return _bilinear(p * w, np.zeros(0), g * w**order)


def _highpass(order: int, cutoff: float, rate: float, ripple: float | None) -> Coefficients:
    w = np.tan(np.pi * _cut(cutoff, rate))
    p, g = _prototype(order, ripple)
    return _bilinear(w / p, np.zeros(order), g / float(np.real(np.prod(-p))))


def butterworth_lowpass(order: int, cutoff: float, rate: float) -> Coefficients:
    return _lowpass(order, cutoff, rate, None)


def butterworth_highpass(order: int, cutoff: float, rate: float) -> Coefficients:
    return _highpass(order, cutoff, rate, None)


def butterworth_bandpass(order: int, low: float, high: float, rate: float) -> Coefficients:
    return cascade(_highpass(order, low, rate, None), _lowpass(order, high, rate, None))


def chebyshev_lowpass(order: int, cutoff: float, rate: float, ripple: float = 0.5) -> Coefficients:
    return _lowpass(order, cutoff, rate, ripple)


def chebyshev_highpass(order: int, cutoff: float, rate: float, ripple: float = 0.5) -> Coefficients:
    return _highpass(order, cutoff, rate, ripple)


def chebyshev_bandpass(order: int, low: float, high: float, rate: float, ripple: float = 0.5) -> Coefficients:
    return cascade(_highpass(order, low, rate, ripple), _lowpass(order, high, rate, ripple))


def first_order_lowpass(cutoff: float, rate: float) -> Coefficients:
    return _lowpass(1, cutoff, rate, None)


def first_order_highpass(cutoff: float, rate: float) -> Coefficients:
    return _highpass(1, cutoff, rate, None)


def peaking_eq(center: float, rate: float, q: float = 1.0, gain_db: float = 0.0) -> Coefficients:
    w, g = 2 * np.pi * _cut(center, rate), 10 ** (gain_db / 40)
    al, c = np.sin(w) / (2 * q), np.cos(w)
    return _of([1 + al * g, -2 * c, 1 - al * g], [1 + al / g, -2 * c, 1 - al / g])


def _shelf(cutoff: float, rate: float, gain_db: float, q: float, sign: float) -> Coefficients:
    """A low shelf, or with sign -1 a high shelf; they differ in the sign of the cosine terms."""
    w, g = 2 * np.pi * _cut(cutoff, rate), 10 ** (gain_db / 40)
    c, be = sign * np.cos(w), np.sqrt(g) / q * np.sin(w)
    b = [g * (g + 1 - (g - 1) * c + be), sign * 2 * g * (g - 1 - (g + 1) * c), g * (g + 1 - (g - 1) * c - be)]
    a = [g + 1 + (g - 1) * c + be, sign * -2 * (g - 1 + (g + 1) * c), g + 1 + (g - 1) * c - be]
    return _of(b, a)


def low_shelf(cutoff: float, rate: float, gain_db: float, q: float = 0.707) -> Coefficients:
    return _shelf(cutoff, rate, gain_db, q, 1.0)


def high_shelf(cutoff: float, rate: float, gain_db: float, q: float = 0.707) -> Coefficients:
    return _shelf(cutoff, rate, gain_db, q, -1.0)


def filter_of(kind: str, mode: str, rate: float, **o) -> Coefficients:
    """One entry for all designs: kind fir, butterworth, chebyshev or biquad; mode lowpass, highpass, bandpass, ..."""
    cut = [o[k] for k in (("cutoff",) if "cutoff" in o else ("low", "high")) if k in o]
    if kind == "fir":
        made = {"lowpass": fir_lowpass, "highpass": fir_highpass, "bandpass": fir_bandpass, "bandstop": fir_bandstop}
        return made[mode](o.get("taps", 51), *cut, rate, o.get("window", "hamming"))
    if kind in ("butterworth", "iir"):
        made = {"lowpass": butterworth_lowpass, "highpass": butterworth_highpass, "bandpass": butterworth_bandpass}
        return made[mode](o.get("order", 2), *cut, rate)
    if kind == "chebyshev":
        made = {"lowpass": chebyshev_lowpass, "highpass": chebyshev_highpass, "bandpass": chebyshev_bandpass}
        return made[mode](o.get("order", 2), *cut, rate, o.get("ripple", 0.5))
    if kind == "biquad":
        made = {"peak": peaking_eq, "lowshelf": low_shelf, "highshelf": high_shelf}
        if mode == "peak":
            return peaking_eq(*cut, rate, o.get("q", 1.0), o.get("gain_db", 0.0))
        if mode in made:
            return made[mode](*cut, rate, o.get("gain_db", 0.0), o.get("q", 0.707))
        return filter_of("butterworth", mode, rate, **o)
    raise ValueError(f"unknown filter kind {kind}")


SCALES = {
    "mel": (hz_to_mel, mel_to_hz),
    "bark": (hz_to_bark, bark_to_hz),
    "log": (np.log10, lambda x: 10.0**x),
    "linear": (lambda x: x, lambda x: x),
}


def bank_boundaries(scale: str, count: int, low: float, high: float) -> list[float]:
    """count + 1 frequencies at equal steps of a scale; 0 Hz counts as 1."""
    if count < 1 or not low < high:
        raise ValueError("a bank has bands between two frequencies")
    to, back = SCALES[scale]
    a, b = to(max(low, 1.0) if low == 0 else low), to(high)
    return [float(back(a + (b - a) * i / count)) for i in range(count + 1)]


def filter_bank(scale: str, count: int, low: float, high: float, rate: float, kind: str = "butterworth", order: int = 2, ripple: float = 0.5) -> list[Coefficients]:
    edges = [min(max(f / rate, 1e-4), 0.4999) * rate for f in bank_boundaries(scale, count, low, high)]
    make = (lambda a, b: butterworth_bandpass(order, a, b, rate)) if kind == "butterworth" else (lambda a, b: chebyshev_bandpass(order, a, b, rate, ripple))
    return [make(a, b) for a, b in zip(edges, edges[1:])]


def mel_bank(bands: int, bins: int, rate: float, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangular weights, one row per band over ``bins`` bins up to half the rate."""
    high = rate / 2 if high is None else high
    m = np.linspace(hz_to_mel(low), hz_to_mel(high), bands + 2)
    edge = np.array([mel_to_hz(x) for x in m])
    f = np.linspace(0, rate / 2, bins)
    return np.maximum(0, np.minimum((f - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None], (edge[2:, None] - f) / (edge[2:] - edge[1:-1])[:, None]))


def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II; its transpose is the inverse."""
    k, i = np.arange(n)[:, None], np.arange(n)[None]
    m = np.sqrt(2 / n) * np.cos(np.pi * k * (2 * i + 1) / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def daubechies(p: int) -> np.ndarray:
    """The scaling filter with p vanishing moments (2 p taps), from the roots of its polynomial inside the unit circle."""
    from math import comb

    if not 1 <= p <= 10:
        raise ValueError("db1 to db10")
    q = np.roots([comb(p - 1 + k, k) for k in range(p - 1, -1, -1)]) if p > 1 else np.zeros(0)
    roots = []
    for y in q:  # y = (2 - z - 1/z) / 4
        z = np.roots([1, 4 * y - 2, 1])
        roots.append(z[np.argmin(np.abs(z))])
    h = np.real(np.poly(np.concatenate([-np.ones(p), np.array(roots, complex)])))
    return h / h.sum() * np.sqrt(2)
