"""Differences of two texts, unit by unit."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Profile, apply_profile
from .lexicon import dealt

#: Bytes of left texts that are compared in one task, about.
DEALT_BYTES = 1 << 20
#: Ranges of so many pairs of units are compared unit by unit, larger ones by runs of doubling length.
_FEW = 4096
_SEGMENTS = "array<struct<tag:string,left:string,right:string>>"


def _ranked(*sides: np.ndarray) -> list[np.ndarray] | None:
    """Small numbers for the values of two arrays, alike in both; None if they share none."""
    _, at = np.unique(np.concatenate(sides), return_inverse=True)
    x, y = np.split(at, [len(sides[0])])
    seen = np.zeros(at.max() + 1, bool)
    seen[x] = True
    return [x, y] if seen[y].any() else None


def longest_run(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """(i, j, size) of the longest run that two arrays of whole numbers share; of equal ones the first in x, then in y.

    Runs of doubling length are numbered, alike in both, as long as the arrays
    share one; the longest length is put together from these.
    """
    most = min(len(x), len(y))
    if len(x) == len(y) and (x == y).all():
        return 0, 0, most
    if not most or not (own := _ranked(x, y)):
        return 0, 0, 0
    levels = [own]

    def extended(now: list[np.ndarray], size: int, more: list[np.ndarray], by: int) -> list[np.ndarray] | None:
        """Numbers of the runs of ``size`` + ``by``."""
        if size + by > most:
            return None
        base = 1 + max(r.max() for r in more)
        return _ranked(*(a[: len(a) - by] * base + b[size:] for a, b in zip(now, more, strict=True)))

    while twice := extended(levels[-1], 1 << (len(levels) - 1), levels[-1], 1 << (len(levels) - 1)):
        levels.append(twice)
    now, size = levels[-1], 1 << (len(levels) - 1)
    for power in reversed(range(len(levels) - 1)):
        if longer := extended(now, size, levels[power], 1 << power):
            now, size = longer, size + (1 << power)
    seen = np.zeros(1 + max(r.max() for r in now), bool)
    seen[now[1]] = True
    i = int(seen[now[0]].argmax())
    return i, int((now[1] == now[0][i]).argmax()), size


class Matcher(difflib.SequenceMatcher):
    """difflib's matches, without its time quadratic in the number of equal units: spaces alone are half of a text's."""

    def __init__(self, x: list[str], y: list[str]):
        names: dict[str, int] = {}
        self.x, self.y = (np.array([names.setdefault(u, len(names)) for u in s], np.int64) for s in (x, y))
        super().__init__(None, x, y, autojunk=False)

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> difflib.Match:
        x, y = self.x[alo:ahi], self.y[blo:bhi]
        if len(x) * len(y) > _FEW:
            i, j, size = longest_run(x, y)
            return difflib.Match(alo + i, blo + j, size)
        places: dict[int, list[int]] = {}
        for j, u in enumerate(y.tolist()):
            places.setdefault(u, []).append(j)
        best, before = (0, 0, 0), {}
        for i, u in enumerate(x.tolist()):
            now = {}
            for j in places.get(u, ()):
                now[j] = size = before.get(j - 1, 0) + 1
                if size > best[2]:
                    best = i - size + 1, j - size + 1, size
            before = now
        return difflib.Match(alo + best[0], blo + best[1], best[2])


def diff(pairs: DataFrame, profile: Profile = Profile(lower=False)) -> DataFrame:
    """Adds ratio, the numbers of operations and segments to rows (left_text, right_text)."""

    @F.pandas_udf(f"ratio double, equal int, replace int, delete int, insert int, segments {_SEGMENTS}")
    def compare(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(left, right, strict=True):
            x, y = re.findall(r"\s+|\S+", a or ""), re.findall(r"\s+|\S+", b or "")
            m = Matcher(x, y)
            ops = [(tag, "".join(x[i:j]), "".join(y[k:n])) for tag, i, j, k, n in m.get_opcodes()]
            number = [sum(o[0] == t for o in ops) for t in ("equal", "replace", "delete", "insert")]
            rows.append((round(m.ratio(), 4), *number, [dict(zip(("tag", "left", "right"), o, strict=True)) for o in ops]))
        return pd.DataFrame(rows, columns=["ratio", "equal", "replace", "delete", "insert", "segments"])

    found = compare(apply_profile(F.col("left_text"), profile), apply_profile(F.col("right_text"), profile))
    return pairs.withColumn("d", found).select(*[c for c in pairs.columns if c not in ("left_text", "right_text")], "d.*")


def nearest_copies(docs: DataFrame) -> DataFrame:
    """Pairs of documents that follow each other among those with one first line: left_id, right_id and both texts, dealt by left_id."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.substring_index("text", "\n", 1)).orderBy("id")
    rows = docs.withColumn("right_id", F.lead("id").over(w)).withColumn("right_text", F.lead("text").over(w))
    return dealt(rows.where("right_id is not null"), DEALT_BYTES).select(F.col("id").alias("left_id"), "right_id", F.col("text").alias("left_text"), "right_text")
