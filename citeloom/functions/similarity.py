"""String similarity: Levenshtein natively, Jaro as an Arrow UDF over batches of pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


SIDE_BY_SIDE = 256  # characters up to which many pairs are compared at once


def jaro_similarity(a: str | None, b: str | None) -> float | None:
    """Jaro's similarity without a prefix bonus; null for a null, 0 where one side alone is empty."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0 if a else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    # of each character the places in b that are left: a window only moves on, so places before it are never needed again
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    free, hits = [True] * len(b), []
    for i, x in enumerate(a):
        left = places.get(x, ())
        while left and left[-1] < i - reach:
            left.pop()
        if left and left[-1] <= i + reach:
            free[left.pop()] = False
            hits.append(x)
    if not hits:
        return 0.0
    other = [y for y, f in zip(b, free, strict=True) if not f]
    moved = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def _codes(strings: list[str], width: int) -> np.ndarray:
    return np.array(strings, dtype=f"<U{width}").view(np.uint32).reshape(len(strings), width)


def jaro_many(a: list[str], b: list[str], cells: int = 1 << 18) -> np.ndarray:
    """Jaro's similarity of many pairs at once; pairs of like lengths are compared side by side."""
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    out, order, at = np.zeros(len(a)), np.argsort(size, kind="stable"), 0
    while len(order) and size[order[-1]] > SIDE_BY_SIDE:  # in time that grows with their lengths
        i, order = order[-1], order[:-1]
        out[i] = jaro_similarity(a[i], b[i])
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * size[order[end]] <= cells:
            end += 1
        these = order[at:end]
        out[these] = _jaro_block([a[i] for i in these], [b[i] for i in these], max(1, int(size[these[-1]])))
        at = end
    return out


def _jaro_block(a: list[str], b: list[str], width: int) -> np.ndarray:
    x, y = _codes(a, width), _codes(b, width)
    n, m = (np.array([len(s) for s in side], np.int64) for side in (a, b))
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    free, hit, rows = np.arange(width)[None] < m[:, None], np.zeros(x.shape, bool), np.arange(len(a))
    far = int(reach.max(initial=0))
    for i in range(int(n.max(initial=0))):
        low, high = max(0, i - far), min(width, i + far + 1)
        fits = free[:, low:high] & (y[:, low:high] == x[:, i : i + 1]) & (i < n)[:, None] & (np.abs(np.arange(low, high) - i)[None] <= reach[:, None])
        found = fits.any(1)
        hit[:, i] = found
        free[rows[found], low + fits[found].argmax(1)] = False
    taken = (np.arange(width)[None] < m[:, None]) & ~free
    matched = hit.sum(1)
    lined = []
    for chars, which in ((x, hit), (y, taken)):  # the matched characters of each side, in order
        line = np.zeros(chars.shape, np.uint32)
        r, c = np.nonzero(which)
        line[r, np.cumsum(which, axis=1)[r, c] - 1] = chars[r, c]
        lined.append(line)
    moved = (lined[0] != lined[1]).sum(1) // 2
    some = np.maximum(matched, 1)
    score = (matched / np.maximum(n, 1) + matched / np.maximum(m, 1) + (matched - moved) / some) / 3
    return np.where(matched > 0, score, 0.0)


@pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro's similarity; equal pairs of a batch are compared once."""
    pairs = pd.DataFrame({"a": a.to_numpy(), "b": b.to_numpy()})
    known = pairs.dropna()
    one = known.drop_duplicates()
    one = one.assign(sim=jaro_many(one["a"].tolist(), one["b"].tolist()))
    found = known.merge(one, on=["a", "b"], how="left")["sim"].to_numpy()
    out = pd.Series(np.nan, index=pairs.index, dtype="float64").astype(object)
    out[pairs.notna().all(axis=1)] = found
    return out.where(out.notna(), None)


def with_jaro(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``pairs`` with Jaro's similarity of two columns; ``pairs`` is read once."""
    return pairs.withColumn(name, jaro(F.col(a), F.col(b)))


def jaro_possible(a: Column, b: Column, least: float) -> Column:
    """False only where the lengths alone keep Jaro's similarity under ``least``: filter before the UDF."""
    la, lb = F.char_length(a), F.char_length(b)
    return (2 + F.least(la, lb) / F.greatest(la, lb, F.lit(1))) / 3 >= least


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)
