"""Element-wise stages as Catalyst expressions: code-generated, no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rectify(x, mode: str = "full") -> Column:
    if mode not in ("full", "half"):
        raise ValueError("mode is full or half")
    return F.abs(_col(x)) if mode == "full" else F.greatest(_col(x), F.lit(0.0))


def square(x) -> Column:
    return _col(x) * _col(x)


def amplify(x, gain: float) -> Column:
    if not gain > 0:
        raise ValueError("gain must be positive")
    return _col(x) * F.lit(float(gain))


def clip_detection(x, threshold: float) -> Column:
    if not threshold > 0:
        raise ValueError("threshold must be positive")
    return F.when(F.abs(_col(x)) >= threshold, 1.0).otherwise(0.0)


def to_decibels(magnitude, reference: float = 1.0) -> Column:
    return 20.0 * F.log10(F.greatest(_col(magnitude), F.lit(1e-10)) / F.lit(float(reference)))


def a_weighting(frequency, magnitude) -> Column:
    """IEC 61672 A-curve gain at a frequency times the magnitude."""
    f2 = _col(frequency) * _col(frequency)
    # fixed values of the standard: the curve's pole frequencies in Hz and its gain at 1 kHz
    p1, p2, p3, p4, gain = 20.6, 107.7, 737.9, 12194.0, 1.2589
    top = F.lit(p4**2) * f2 * f2
    low = (f2 + p1**2) * F.sqrt((f2 + p2**2) * (f2 + p3**2)) * (f2 + p4**2)
    return _col(magnitude) * F.when(low > 0, F.lit(gain) * top / low).otherwise(0.0)


def is_power_of_two(n) -> Column:
    n = _col(n).cast("bigint")
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def next_power_of_two(n) -> Column:
    """The least power of two that is not below n; 1 for n below 1. Exact: from the length of a binary numeral."""
    n = F.greatest(_col(n).cast("bigint"), F.lit(1).cast("bigint"))
    bits = F.when(n == 1, 0).otherwise(F.length(F.bin(n - 1)))
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int"))


def zero_pad(array, length) -> Column:
    array = _col(array)
    length = F.lit(length) if isinstance(length, int) else _col(length)
    return F.concat(array, F.array_repeat(F.lit(0.0), F.greatest(length - F.size(array), F.lit(0)).cast("int")))


def pad_to_power_of_two(array) -> Column:
    return zero_pad(array, next_power_of_two(F.size(_col(array))))


def peak_frequency(magnitudes, sample_rate: float, fft_size: int) -> Column:
    """Frequency of the first largest bin."""
    m = _col(magnitudes)
    return (F.array_position(m, F.array_max(m)) - 1) * F.lit(float(sample_rate) / fft_size)


def magnitude(re, im) -> Column:
    return F.sqrt(_col(re) * _col(re) + _col(im) * _col(im))


def power(re, im) -> Column:
    return _col(re) * _col(re) + _col(im) * _col(im)


def phase(re, im) -> Column:
    return F.atan2(_col(im), _col(re))


def bin_frequency(bin_, sample_rate: float, fft_size: int) -> Column:
    return _col(bin_) * F.lit(float(sample_rate) / fft_size)


def hz_to_mel(f: float) -> float:
    return 2595.0 * math.log10(1.0 + f / 700.0)


def mel_to_hz(m: float) -> float:
    return 700.0 * (10.0 ** (m / 2595.0) - 1.0)


def hz_to_bark(f: float) -> float:
    return 26.81 * f / (1960.0 + f) - 0.53


def bark_to_hz(b: float) -> float:
    return 1960.0 * (b + 0.53) / (26.28 - b)


#: To a scale and back, as columns.
_SCALES = {
    "mel": (lambda f: 2595.0 * F.log10(1.0 + f / 700.0), lambda m: 700.0 * (F.pow(F.lit(10.0), m / 2595.0) - 1.0)),
    "bark": (lambda f: 26.81 * f / (1960.0 + f) - 0.53, lambda b: 1960.0 * (b + 0.53) / (26.28 - b)),
    "log": (lambda f: F.log10(f), lambda x: F.pow(F.lit(10.0), x)),
    "linear": (lambda f: f, lambda x: x),
}


def bank_boundaries(scale: str, count: int, low, high) -> Column:
    """count + 1 frequencies between two columns at equal steps of a scale; 0 Hz counts as 1. Null where low is not below high."""
    if count < 1:
        raise ValueError("a bank has bands")
    to, back = _SCALES[scale]
    low, high = _col(low).cast("double"), _col(high).cast("double")
    a, b = to(F.when(low == 0, 1.0).otherwise(low)), to(high)
    edges = F.transform(F.sequence(F.lit(0), F.lit(count)), lambda i: back(a + (b - a) * i / count))
    return F.when(low < high, edges)


def spectral_centroid(magnitudes, sample_rate: float) -> Column:
    """Magnitude-weighted mean frequency, bin i of n at i * rate / (2 n); 0 for silence."""
    m = _col(magnitudes)
    total = F.aggregate(m, F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform(m, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return F.when(total == 0, 0.0).otherwise(weighted * sample_rate / (2.0 * F.size(m)) / total)


def spectral_rolloff(magnitudes, sample_rate: float, share: float = 0.85) -> Column:
    """Frequency of the first bin at which the running sum reaches a share of the whole."""
    m = _col(magnitudes)
    goal = F.aggregate(m, F.lit(0.0), lambda a, x: a + x) * share
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"), F.lit(False).alias("done"))

    def step(a, x):
        done = a["done"] | (a["s"] + x >= goal)
        return F.struct((a["s"] + x).alias("s"), F.when(done, a["k"]).otherwise(a["k"] + 1).alias("k"), done.alias("done"))

    k = F.aggregate(m, start, step, lambda a: F.least(a["k"], F.size(m) - 1))
    return k * sample_rate / (2.0 * F.size(m))


def spectral_flux(magnitudes, previous) -> Column:
    """Euclidean distance to the previous frame; 0 without one of the same length."""
    m, p = _col(magnitudes), _col(previous)
    return F.when(
        F.size(m) == F.size(p),
        F.sqrt(F.aggregate(F.zip_with(m, p, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)),
    ).otherwise(0.0)


def spectral_features(magnitudes, sample_rate: float, previous=None, share: float = 0.85) -> Column:
    """Struct of centroid, rolloff and flux (0 without a previous frame)."""
    flux = F.lit(0.0) if previous is None else F.coalesce(spectral_flux(magnitudes, previous), F.lit(0.0))
    return F.struct(spectral_centroid(magnitudes, sample_rate).alias("centroid"), spectral_rolloff(magnitudes, sample_rate, share).alias("rolloff"), flux.alias("flux"))
