"""Reuse distances: how many other keys were used since a key's last use. A least-recently-used cache of n keys hits exactly where it is below n,
so one pass answers for caches of every size, and nothing replays a cache.

With places from 1, let prev(i) be where the key of access i was used before (0: nowhere). Between prev(i) and i stand as many different keys as there are
accesses j in between with prev(j) < prev(i), each being the first of its key there; and as prev(j) < j, that is

    #{j < i: prev(j) < prev(i)} - prev(i)

which is a count of smaller values before each value. Accesses are in ranges by place, so it is counted in three parts: within i's range, within the
accesses whose prev lies in the range of prev(i) (no more than that range has places), and, for whole ranges below both, from a matrix of counts by (range, range of prev).
A task holds one range, and the matrix's task ranges squared cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.operators import scan

#: Ranges at most: the matrix has their number squared.
RANGES = 2048
#: Neighbouring values that are compared with each other.
RUN = 64
_EARLIER = np.tri(RUN, k=-1, dtype=bool)


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value how many of those before it are smaller: within runs of ``RUN`` by comparison, then by merges of neighbouring runs."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    padded = np.full(-(-n // RUN) * RUN, n, np.int64)
    padded[:n] = rank
    runs = padded.reshape(-1, RUN)
    out = np.concatenate([((runs[k : k + 4096, None, :] < runs[k : k + 4096, :, None]) & _EARLIER).sum(axis=2).ravel() for k in range(0, len(runs), 4096)])[:n]
    at, width = np.arange(n), RUN
    while width < n:
        right = at // width & 1
        # of equal values those on the right come first, so they don't count the left
        order = np.argsort((at // (2 * width) * (n + 1) + rank) * 2 + 1 - right, kind="stable")
        left = 1 - right[order]
        seen, begins = np.cumsum(left), at // (2 * width) * (2 * width)
        before = np.concatenate([[0], seen])[begins]
        out[order[left == 0]] += (seen - before)[left == 0]
        width *= 2
    return out


def _count(order: str, value: str, name: str):
    """A function for groups of Arrow rows: adds to ``name`` the smaller values of ``value`` before each row by ``order``."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        more = pa.array(smaller_before(rows[value].to_numpy()) + rows[name].to_numpy())
        return rows.set_column(rows.column_names.index(name), name, more)

    return run


def distances(accesses: DataFrame, by: list[str], order: str, key: str, ranges: int | None = None) -> DataFrame:
    """``accesses`` with place (from 1, within ``by``) and distance: other keys since the last use of ``key``, null where there was none."""
    wanted = ranges or int(accesses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = scan.in_ranges(accesses, by, [order], min(RANGES, wanted))
    used = scan.previous_use(scan.running(parts, by, [order], "place"), by, key, "place")
    rows = used.select(*accesses.columns, "part", "place", F.coalesce("prev", F.lit(0)).cast("long").alias("prev"), F.coalesce("prev_part", F.lit(-1)).alias("prev_part"), F.lit(0).cast("long").alias("below"))
    schema = rows.schema
    rows = scan.stored(rows.groupBy(*by, "part").applyInArrow(_count("place", "prev", "below"), schema), "uses")
    again = rows.filter("prev > 0").groupBy(*by, "prev_part").applyInArrow(_count("prev", "part", "below"), schema)
    cells = rows.groupBy(*by, "part", "prev_part").agg(F.count("*").alias("n"))
    least = rows.groupBy(*by).agg(F.min("part").alias("_from"), F.max("part").alias("_to"))

    def whole(group: pa.Table) -> pa.Table:
        low, high = group["_from"][0].as_py(), group["_to"][0].as_py()
        a, b = group["part"].to_numpy() - low, group["prev_part"].to_numpy()
        b = np.where(b < 0, 0, b - low + 1)
        grid = np.zeros((high - low + 2, high - low + 3), np.int64)
        grid[a + 1, b + 1] = group["n"].to_numpy()
        sums = grid.cumsum(axis=0).cumsum(axis=1)  # sums[x, y]: parts below x, ranges of prev below y
        return group.select([*by, "part", "prev_part"]).append_column("_whole", pa.array(sums[a, b]))

    fields = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in [*by, "part", "prev_part"])
    below = scan.matched(cells, least, by).groupBy(*by).applyInArrow(whole, f"{fields}, _whole long")
    found = scan.matched(again, below, [*by, "part", "prev_part"]).select(*accesses.columns, "place", (F.col("below") + F.col("_whole") - F.col("prev")).alias("distance"))
    return found.unionByName(rows.filter("prev = 0").select(*accesses.columns, "place", F.lit(None).cast("long").alias("distance")))
