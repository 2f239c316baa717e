"""Frame transforms: frames are views of sorted Arrow batches; transforms of array columns work on batches of equal lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import design, expr
from ..sources.signal import Signal
from .recursive import Cuts, doubles, sorted_rows

SPECTRUM = "struct<real:array<double>,imag:array<double>>"


#: Values of frames that are worked on at a time.
AT_ONCE = 1 << 21


def framed(s: Signal, size: int, hop: int | None = None, fn=None, out: str = "values") -> DataFrame:
    """Rows (keys, frame_idx, ``out``): ``fn`` (the identity unless given) of each full frame; a partial last one is left out.

    ``fn`` takes a matrix with a frame a row and gives one, or a vector of a double for each frame. Samples are sorted once by series; the last
    size - hop of a batch are kept for the next, and frames are views of them, so no sample is copied before ``fn`` and a task holds a batch.
    """
    hop = size if hop is None else hop
    if size < 1 or hop < 1:
        raise ValueError("size and hop are positive")
    keys, value = list(s.keys), s.value
    matrix = fn is None or fn(np.zeros((1, size))).ndim == 2
    kind = T.ArrayType(T.DoubleType()) if matrix else T.DoubleType()
    schema = T.StructType([*[s.df.schema[k] for k in keys], T.StructField("frame_idx", T.LongType()), T.StructField(out, kind)])
    step = max(1, AT_ONCE // size)

    def run(batches):
        cuts = Cuts(keys)
        held, done, skip = np.zeros(0), 0, 0  # samples kept, frames made, samples still to pass over (a hop beyond the size)
        for b in batches:
            if not b.num_rows:
                continue
            x = doubles(b, [value])[:, 0]
            for lo, hi, new in cuts(b):
                if new:
                    held, done, skip = np.zeros(0), 0, 0
                part = x[lo:hi][skip:]
                skip = max(0, skip - (hi - lo))
                whole = np.concatenate([held, part])
                n = (len(whole) - size) // hop + 1 if len(whole) >= size else 0
                views = np.lib.stride_tricks.sliding_window_view(whole, size)[::hop] if n else None
                for at in range(0, n, step):
                    got = views[at : at + step] if fn is None else fn(views[at : at + step])
                    m = len(got)
                    if matrix:
                        flat = np.ascontiguousarray(got, np.float64)
                        column = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel()))
                    else:
                        column = pa.array(np.asarray(got, np.float64))
                    row = [b.column(b.schema.get_field_index(k)).take(pa.array(np.full(m, lo))) for k in keys]
                    yield pa.RecordBatch.from_arrays([*row, pa.array(np.arange(done + at, done + at + m)), column], names=[*keys, "frame_idx", out])
                done += n
                skip = max(skip, n * hop - len(whole))
                held = whole[n * hop :]

    need = list(dict.fromkeys([*keys, *s.order, value]))
    return sorted_rows(s.with_(s.df.select(*need))).mapInArrow(run, schema)


def frames(s: Signal, size: int, hop: int | None = None) -> DataFrame:
    """Rows (keys, frame_idx, values) of the full frames."""
    return framed(s, size, hop)


def _arrays(fn, out: str):
    """A vectorized function of an array column, rows of equal length in one NumPy call."""

    def run(col: pd.Series) -> pd.Series:
        done = [None] * len(col)
        for at in _by_length(np.array([-1 if v is None else len(v) for v in col])):
            got = fn(np.stack([np.asarray(col.iloc[i], np.float64) for i in at]))
            for i, g in zip(at, got, strict=True):
                done[i] = g
        return pd.Series(done)

    return F.pandas_udf(run, out)


def _by_length(lengths: np.ndarray):
    """Positions of rows of each length; nulls have -1 and are left out."""
    for n in np.unique(lengths[lengths >= 0]):
        yield np.flatnonzero(lengths == n)


def _complex(fn):
    def run(col: pd.Series) -> pd.DataFrame:
        re, im = [None] * len(col), [None] * len(col)
        for at in _by_length(np.array([-1 if v is None else len(v) for v in col])):
            z = fn(np.stack([np.asarray(col.iloc[i], np.float64) for i in at]))
            for i, r, m in zip(at, np.ascontiguousarray(z.real), np.ascontiguousarray(z.imag), strict=True):
                re[i], im[i] = r, m
        return pd.DataFrame({"real": re, "imag": im})

    return F.pandas_udf(run, SPECTRUM)


def _of_complex(col: pd.DataFrame, fn) -> list:
    """``fn`` of the spectra, those of equal length in one NumPy call."""
    done = [None] * len(col)
    for at in _by_length(np.array([-1 if v is None else len(v) for v in col["real"]])):
        part = [np.stack([np.asarray(col[c].iloc[i], np.float64) for i in at]) for c in ("real", "imag")]
        for i, g in zip(at, fn(part[0] + 1j * part[1]), strict=True):
            done[i] = g
    return done


def fft(x: str | Column) -> Column:
    """Full complex spectrum of a real frame of any length (dft is the same)."""
    return _complex(np.fft.fft)(x)


def rfft(x: str | Column) -> Column:
    """The size / 2 + 1 bins of a real frame."""
    return _complex(np.fft.rfft)(x)


def ifft(z: str | Column) -> Column:
    def run(col: pd.DataFrame) -> pd.DataFrame:
        got = _of_complex(col, np.fft.ifft)
        part = lambda f: [None if g is None else np.ascontiguousarray(f(g)) for g in got]
        return pd.DataFrame({"real": part(np.real), "imag": part(np.imag)})

    return F.pandas_udf(run, SPECTRUM)(z)


def irfft(z: str | Column, size: int) -> Column:
    """The real frame of ``size`` samples, odd sizes too."""

    def run(col: pd.DataFrame) -> pd.Series:
        return pd.Series(_of_complex(col, lambda z: np.fft.irfft(z, size)))

    return F.pandas_udf(run, "array<double>")(z)


dft, rdft, idft, irdft = fft, rfft, ifft, irfft


def power_of(z: str) -> Column:
    return F.zip_with(F.col(z)["real"], F.col(z)["imag"], lambda a, b: a * a + b * b)


def magnitude_of(z: str) -> Column:
    return F.transform(power_of(z), F.sqrt)


def phase_of(z: str) -> Column:
    return F.zip_with(F.col(z)["real"], F.col(z)["imag"], lambda a, b: F.atan2(b, a))


def form_fn(form: str, half: bool = True):
    """The magnitude, power or phase of the spectrum of each row of a matrix."""
    kind = np.fft.rfft if half else np.fft.fft
    made = {"power": lambda x: np.abs(kind(x)) ** 2, "magnitude": lambda x: np.abs(kind(x)), "phase": lambda x: np.angle(kind(x))}
    if form not in made:
        raise ValueError("form is complex, magnitude, power or phase")
    return made[form]


def spectrum(df: DataFrame, form: str = "power", column: str = "values", out: str = "spectrum", half: bool = True) -> DataFrame:
    """complex, magnitude, power or phase of each frame; non-complex forms leave NumPy as one array each."""
    if form == "complex":
        return df.withColumn(out, (rfft if half else fft)(column))
    return df.withColumn(out, _arrays(form_fn(form, half), "array<double>")(column))


def stft(s: Signal, size: int, hop: int | None = None, window: str = "hann", form: str = "magnitude") -> DataFrame:
    """Rows (keys, frame_idx, spectrum) of windowed frames; hop is half the size unless given. form "complex" has a struct of arrays."""
    w = design.window(window, size)
    hop = max(1, size // 2) if hop is None else hop
    if form == "complex":
        return spectrum(framed(s, size, hop, lambda x: x * w), form).drop("values")
    of = form_fn(form)
    return framed(s, size, hop, lambda x: of(x * w), "spectrum")


def moving_fft(s: Signal, size: int, hop: int = 1, form: str = "magnitude") -> DataFrame:
    """Spectra of the window that ends at every hop-th sample."""
    return stft(s, size, hop, "none", form)


def spectral_tracker(df: DataFrame, keys, rate: float, order: str = "frame_idx", column: str = "spectrum", share: float = 0.85) -> DataFrame:
    """Columns centroid, rolloff and flux of each frame, the flux to the frame before in its series."""
    before = F.lag(column).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_before", before).withColumn("_f", expr.spectral_features(column, rate, "_before", share)).select(*df.columns, "_f.*")


def mel_fn(bank):
    """Rows times the rows of a bank."""
    m = np.asarray(bank, np.float64)
    return lambda x: x @ m.T


def mel_spectrogram(df: DataFrame, bank, column: str = "spectrum", out: str = "mel") -> DataFrame:
    """Power bins times the rows of a bank."""
    return df.withColumn(out, _arrays(mel_fn(bank), "array<double>")(column))


def mfcc_fn(coefficients: int = 13, log: bool = True, lifter: int = 0):
    """Logarithm of the rows of a matrix, orthonormal DCT-II, the first coefficients, lifted."""

    def run(x):
        y = (np.log(x + 1e-10) if log else x) @ design.dct_matrix(x.shape[1]).T
        y = y[:, :coefficients]
        return y * (1 + lifter / 2 * np.sin(np.pi * np.arange(y.shape[1]) / lifter)) if lifter else y

    return run


def mfcc(df: DataFrame, coefficients: int = 13, log: bool = True, lifter: int = 0, column: str = "mel", out: str = "mfcc") -> DataFrame:
    """Logarithm of band energies, orthonormal DCT-II, the first coefficients, lifted."""
    return df.withColumn(out, _arrays(mfcc_fn(coefficients, log, lifter), "array<double>")(column))


def dct_fn(v: np.ndarray) -> np.ndarray:
    return v @ design.dct_matrix(v.shape[1]).T


def dct(x: str) -> Column:
    return _arrays(dct_fn, "array<double>")(x)


def idct(x: str) -> Column:
    return _arrays(lambda v: v @ design.dct_matrix(v.shape[1]), "array<double>")(x)


def analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1)


def envelope(x: str) -> Column:
    """Magnitude of the analytic signal of each frame."""
    return _arrays(lambda v: np.abs(analytic(v)), "array<double>")(x)


def hilbert_envelope(s: Signal, size: int = 512, hop: int | None = None) -> DataFrame:
    """The envelope's last sample of each frame: rows (keys, frame_idx, envelope)."""
    return framed(s, size, max(1, size // 2) if hop is None else hop, lambda x: np.abs(analytic(x))[:, -1], "envelope")


def wavelet(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Scaling and wavelet filters of haar and db1 to db10."""
    low = design.daubechies(1 if name == "haar" else int(name.removeprefix("db")))
    return low, (low * (-1) ** np.arange(len(low)))[::-1]


def dwt_fn(name: str = "haar"):
    """One level of each row: approximation, then detail, of a symmetrically extended frame."""
    low, high = wavelet(name)

    def run(v):
        k = len(low)
        padded = np.pad(v, ((0, 0), (k - 2 + v.shape[1] % 2, k - 1) if k > 2 else (0, v.shape[1] % 2)), mode="symmetric")
        view = np.lib.stride_tricks.sliding_window_view(padded, k, axis=1)[:, ::2]
        return np.concatenate([view @ low, view @ high], axis=1)

    return run


def dwt(x: str, name: str = "haar") -> Column:
    """One level: approximation, then detail, of a symmetrically extended frame."""
    return _arrays(dwt_fn(name), "array<double>")(x)


def haar(s: Signal) -> DataFrame:
    """One level of the Haar transform as a window expression: rows (keys, idx, approx, detail) of sample pairs."""
    w = s.window()
    d = s.df.select(*s.keys, (F.row_number().over(w) - 1).cast("bigint").alias("_i"), s.v.alias("_v"), F.lead(s.v).over(w).alias("_n"))
    r = float(np.sqrt(0.5))
    return d.where("_i % 2 = 0 and _n is not null").select(*s.keys, (F.col("_i") / 2).cast("bigint").alias("idx"), ((F.col("_v") + F.col("_n")) * r).alias("approx"), ((F.col("_v") - F.col("_n")) * r).alias("detail"))


def distinct_spectra(df: DataFrame, form: str = "power", column: str = "values") -> DataFrame:
    """As ``spectrum``, each distinct frame transformed once and joined back: for tables with many equal frames."""
    one = spectrum(df.select(column).distinct(), form, column)
    return df.join(one, column)


def entropies(df: DataFrame, m: int = 2, r: float | None = None, column: str = "values") -> DataFrame:
    """Sample and approximate entropy of each frame (r: 0.2 deviations unless given); null for a null frame and for one of fewer than m + 2 samples.

    A frame's templates all meet; ``entropy.series_entropies`` takes series of any length.
    """

    def count(x, w, tolerance, stop):
        """Of each of the first ``stop`` templates of length ``w``, how many of these lie within the tolerance; some rows of the square at a time."""
        n, step = min(stop, len(x) - w + 1), max(1, (1 << 20) // max(len(x), 1))
        out = np.empty(max(n, 0), np.int64)
        for at in range(0, n, step):
            end = min(n, at + step)
            near = np.ones((end - at, n), bool)
            for k in range(w):
                near &= np.abs(x[at + k : end + k, None] - x[None, k : n + k]) <= tolerance
            out[at:end] = near.sum(1)
        return out

    def run(col: pd.Series) -> pd.DataFrame:
        se, ae = [], []
        for v in col:
            if v is None or len(v) < m + 2:
                se.append(None)
                ae.append(None)
                continue
            x = np.asarray(v, np.float64)
            tol = 0.2 * x.std() if r is None else r
            n = len(x)
            b, a = (count(x, m, tol, n - m) - 1).sum(), (count(x, m + 1, tol, n - m) - 1).sum()
            se.append(-np.log(a / b) if a > 0 and b > 0 else np.inf)
            phi = [np.mean(np.log(count(x, w, tol, n - w + 1) / (n - w + 1))) for w in (m, m + 1)]
            ae.append(phi[0] - phi[1])
        return pd.DataFrame({"sample_entropy": se, "approximate_entropy": ae}, dtype=object)

    udf = F.pandas_udf(run, T.StructType([T.StructField("sample_entropy", T.DoubleType()), T.StructField("approximate_entropy", T.DoubleType())]))
    return df.withColumn("_e", udf(column)).select(*df.columns, "_e.*")
