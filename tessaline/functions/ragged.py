"""Statistics of many short series at once: flat numpy arrays with the length of each series.

Every function takes values and lengths and gives one value per series (or per value), NaN where undefined.
Series may be empty.
"""

from __future__ import annotations

import numpy as np

NAN = np.nan


def owner_of(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)


def sums(v: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(owner_of(lengths), v, len(lengths)) if len(v) else np.zeros(len(lengths))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), NAN), where=b != 0)


def means(v: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return ratio(sums(v, lengths), lengths.astype(float))


def centred(v: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return v - means(v, lengths)[owner_of(lengths)]


def stds(v: np.ndarray, lengths: np.ndarray, ddof: int) -> np.ndarray:
    square = sums(centred(v, lengths) ** 2, lengths)
    return np.sqrt(np.divide(square, lengths - ddof, out=np.full(len(lengths), NAN), where=lengths > ddof))


def medians(v: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    order = np.lexsort((v, owner_of(lengths)))
    s, first = v[order], np.r_[0, np.cumsum(lengths)[:-1]].astype(int)
    out, some = np.full(len(lengths), NAN), lengths > 0
    n, at = lengths[some], first[some]
    out[some] = (s[at + (n - 1) // 2] + s[at + n // 2]) / 2
    return out


def mads(v: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return medians(np.abs(v - medians(v, lengths)[owner_of(lengths)]), lengths)


def extremes(v: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(len(lengths), np.inf), np.full(len(lengths), -np.inf)
    owner = owner_of(lengths)
    np.minimum.at(low, owner, v)
    np.maximum.at(high, owner, v)
    return np.where(lengths > 0, low, NAN), np.where(lengths > 0, high, NAN)


def differences(v: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = owner_of(lengths)
    same = owner[1:] == owner[:-1]
    return (v[1:] - v[:-1])[same], np.maximum(lengths - 1, 0)


def hampel(v: np.ndarray, lengths: np.ndarray, reach: int = 5, sigmas: float = 3.0) -> np.ndarray:
    """For each value whether it lies over ``sigmas`` robust deviations off the median of its neighbourhood; NaN never does."""
    if not len(v):
        return np.zeros(0, bool)
    owner = owner_of(lengths)
    at = np.arange(len(v)) + reach
    padded, owners = np.r_[np.full(reach, NAN), v, np.full(reach, NAN)], np.r_[np.full(reach, -1), owner, np.full(reach, -1)]
    around = at[:, None] + np.arange(-reach, reach + 1)[None, :]
    near = np.where(owners[around] == owner[:, None], padded[around], NAN)
    n = (~np.isnan(near)).sum(1)

    def middle(m: np.ndarray) -> np.ndarray:
        s, rows, k = np.sort(m, 1), np.arange(len(m)), np.maximum(n, 1)
        return (s[rows, (k - 1) // 2] + s[rows, k // 2]) / 2

    centre = middle(near)
    spread = middle(np.abs(near - centre[:, None]))
    with np.errstate(invalid="ignore"):
        return (n >= 3) & (spread > 0) & (np.abs(v - centre) > sigmas * 1.4826 * spread)


def interpolate(v: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """NaN filled on the line between its neighbours within the series, ends held."""
    owner, at = owner_of(lengths), np.arange(len(v))
    known = ~np.isnan(v)
    before = np.maximum.accumulate(np.where(known, at, -1)) if len(v) else at
    after = np.minimum.accumulate(np.where(known, at, len(v))[::-1])[::-1] if len(v) else at
    has_b = (before >= 0) & (owner[np.maximum(before, 0)] == owner)
    has_a = (after < len(v)) & (owner[np.minimum(after, len(v) - 1)] == owner)
    b, a = np.where(has_b, before, np.where(has_a, after, 0)), np.where(has_a, after, np.where(has_b, before, 0))
    share = np.divide(at - b, a - b, out=np.zeros(len(v)), where=a != b)
    filled = v[b] + (v[a] - v[b]) * share
    return np.where(known, v, np.where(has_a | has_b, filled, NAN))


def clean(rr: np.ndarray, lengths: np.ndarray, low: float = 300.0, high: float = 2000.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cleaned intervals, and how many of each series were invalid and how many outliers."""
    with np.errstate(invalid="ignore"):
        bad = ~((rr >= low) & (rr <= high))
    kept = np.where(bad, NAN, rr)
    odd = hampel(kept, lengths)
    return interpolate(np.where(odd, NAN, kept), lengths), sums(bad.astype(float), lengths).astype(int), sums(odd.astype(float), lengths).astype(int)


def amplitude_features(x: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    n, c = lengths.astype(float), centred(x, lengths)
    var = ratio(sums(c * c, lengths), n)
    m3, m4 = ratio(sums(c**3, lengths), n), ratio(sums(c**4, lengths), n)
    with np.errstate(invalid="ignore", divide="ignore"):
        skew = np.where((n >= 3) & (var > 0), m3 / var**1.5 * np.sqrt(n * (n - 1)) / (n - 2), NAN)
        excess = m4 / (var * var) - 3
        kurtosis = np.where((n >= 4) & (var > 0), ((n + 1) * excess + 6) * (n - 1) / ((n - 2) * (n - 3)), NAN)
    return {"ECG_Mean": means(x, lengths), "ECG_STD": np.sqrt(var), "ECG_VAR": var, "ECG_RMS": np.sqrt(means(x * x, lengths)), "ECG_Skew": skew, "ECG_Kurtosis": kurtosis}


def rate_features(nn: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    hr = 60000.0 / nn
    low, high = extremes(hr, lengths)
    return {"MeanHR": means(hr, lengths), "StdHR": stds(hr, lengths, 0), "MinHR": low, "MaxHR": high, "MeanRR": means(nn, lengths)}


def time_features(nn: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    d, k = differences(nn, lengths)
    two = lengths >= 2
    only = lambda v: np.where(two, v, NAN)
    return {
        "SDNN": only(stds(nn, lengths, 1)),
        "RMSSD": np.sqrt(means(d * d, k)),
        "SDSD": np.where(k >= 2, stds(d, k, 1), NAN),
        "MedianNN": only(medians(nn, lengths)),
        "MADNN": only(mads(nn, lengths)),
        "pNN20": 100 * means((np.abs(d) > 20).astype(float), k),
        "pNN50": 100 * means((np.abs(d) > 50).astype(float), k),
    }


def poincare_features(sdnn: np.ndarray, sdsd: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    three, tiny = lengths >= 3, 1e-9  # what rounding leaves of equal intervals counts as no spread
    sd1 = np.where(three, sdsd / np.sqrt(2.0), NAN)
    sd2 = np.where(three, np.sqrt(np.maximum(0.0, 2 * sdnn**2 - 0.5 * sdsd**2)), NAN)
    with np.errstate(invalid="ignore", divide="ignore"):
        return {
            "SD1": sd1,
            "SD2": sd2,
            "SD1_SD2": np.where(sd2 > tiny, sd1 / sd2, NAN),
            "CSI": np.where(sd1 > tiny, sd2 / sd1, NAN),
            "CVI": np.where((sd1 > tiny) & (sd2 > tiny), np.log10(16 * sd1 * sd2), NAN),
        }
