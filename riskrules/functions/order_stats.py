"""Exact percentiles by grouped counts of shrinking ranges: no sort, no size switch.

The order statistics that the percentiles of a group need are looked for in value
ranges.  A range starts as [min, max] of the group.  As long as a range holds more
than ``STOP`` values it is cut into ``DIGITS`` equal parts, one grouped count over the
values gives the number, the least and the greatest value of each part, and every
rank moves into its part.  The part's own least and greatest value bound the next
range, so a range always shrinks, and n values need about log n / log DIGITS passes.
At last the few values of the remaining ranges are read.

The driver holds, per group, at most two ranges a percentile, DIGITS parts a range and
STOP values a range; the values themselves are only counted.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of a range, and values of a range that is read.
DIGITS, STOP = 1024, 1024


def _in_ranges(values: DataFrame, ranges: list[tuple]) -> DataFrame:
    """Values with the ranges they lie in (a small table, see above)."""
    table = values.sparkSession.createDataFrame(ranges, "g long, r int, lo double, hi double, base long, n long")
    return values.join(F.broadcast(table), (F.col("group") == F.col("g")) & (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))


def _moved(ranges: dict[tuple, set[int]], parts: dict[tuple, list]) -> dict[tuple, set[int]]:
    """Ranks of split ranges in the parts that hold them."""
    out: dict[tuple, set[int]] = defaultdict(set)
    for key, ranks in ranges.items():
        if key not in parts:
            out[key] |= ranks
            continue
        group, base = key[0], key[3]
        for _, n, lo, hi in sorted(parts[key]):
            inside = {k for k in ranks if base <= k < base + n}
            if inside:
                out[group, lo, hi, base, n] |= inside
            base += n
    return out


def percentiles(values: DataFrame, pcts: Sequence[float], *, digits: int = DIGITS, stop: int = STOP) -> dict[int, list[float]]:
    """Percentiles of the values (columns ``group long, value double``, no NULL or
    NaN) of each group, with linear interpolation between order statistics:
    percentile p over n values lies at position (n - 1) p.

    ``values`` is read once per pass; write it before.
    """
    ends = values.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    sizes = {r["group"]: r["n"] for r in ends}
    ranges: dict[tuple, set[int]] = {}
    for r in ends:
        places = [(r["n"] - 1) * p for p in pcts]
        ranges[r["group"], r["lo"], r["hi"], 0, r["n"]] = {k for x in places for k in (math.floor(x), math.ceil(x))}
    while wide := [key for key in ranges if key[4] > stop and key[1] < key[2]]:
        rows = _in_ranges(values, [(g, i, lo, hi, base, n) for i, (g, lo, hi, base, n) in enumerate(wide)])
        # halves first: the difference of two finite doubles may overflow
        share = (F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        part = F.least(F.floor(share * F.lit(float(digits))), F.lit(digits - 1))
        counts = rows.groupBy("r", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
        parts: dict[tuple, list] = defaultdict(list)
        for c in counts:
            parts[wide[c["r"]]].append((c["part"], c["n"], c["lo"], c["hi"]))
        ranges = _moved(ranges, parts)
    found: dict[tuple[int, int], float] = {}
    keys = list(ranges)
    if keys:
        rows = _in_ranges(values, [(g, i, lo, hi, base, n) for i, (g, lo, hi, base, n) in enumerate(keys)])
        # a range of equal values is one value; others hold at most `stop`
        held: dict[int, list] = defaultdict(list)
        for c in rows.groupBy("r", "value").agg(F.count(F.lit(1)).alias("n")).collect():
            held[c["r"]].append((c["value"], c["n"]))
        for i, key in enumerate(keys):
            at = key[3]
            for value, n in sorted(held[i]):
                found.update({(key[0], k): value for k in ranges[key] if at <= k < at + n})
                at += n
    out = {}
    for group, n in sizes.items():
        edges = []
        for p in pcts:
            x = (n - 1) * p
            lo, hi = found[group, math.floor(x)], found[group, math.ceil(x)]
            edges.append(lo + (x - math.floor(x)) * (hi - lo))
        out[group] = edges
    return out
