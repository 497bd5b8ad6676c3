"""Band joins: rows whose integer positions lie within a fixed distance of each other.

Spark has no range-join operator; a bare inequality would run as a nested loop. The narrow side
names every bucket its band touches, so the join becomes an equality on (keys, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], lo: int, hi: int,
              left_idx: str, right_idx: str, how: str = "inner",
              bucket: int | None = None) -> DataFrame:
    """``right_idx`` in ``[left_idx + lo, left_idx + hi]`` for equal ``on`` columns.

    ``left_idx`` and ``right_idx`` must have different names. ``left_semi``/``left_anti``
    first reduce to the matching positions, because a left row sits in several buckets.
    """
    size = bucket or max(hi - lo + 1, 1)
    low, high = F.col(left_idx) + lo, F.col(left_idx) + hi
    buckets = F.sequence(F.floor(low / size), F.floor(high / size))
    if how in ("left_semi", "left_anti"):
        ids = [*on, left_idx]
        hits = band_join(left.select(*ids).distinct(), right.select(*on, right_idx).distinct(),
                         on, lo, hi, left_idx, right_idx, bucket=size)
        return left.join(hits.select(*ids).distinct(), ids, how)
    if how != "inner":
        raise ValueError("band_join supports inner, left_semi and left_anti")
    wide = left.withColumn("_bucket", F.explode(buckets))
    narrow = right.withColumn("_bucket", F.floor(F.col(right_idx) / size))
    return (wide.join(narrow, [*on, "_bucket"])
            .filter(F.col(right_idx).between(low, high)).drop("_bucket"))
