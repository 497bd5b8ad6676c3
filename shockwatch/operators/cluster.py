"""Agreement of labelings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adjusted_rand(pairs: DataFrame, keys, left: str, right: str, count: Column | None = None
                  ) -> DataFrame:
    """Adjusted Rand index of two labelings of the same items, from their contingency table.

    ``count`` is given when the rows are already contingency cells.
    """
    keys = list(keys)

    def choose2(c):
        return F.sum(c * (c - 1) / 2)

    size = F.count("*") if count is None else F.sum(count)
    cell = pairs.groupBy(*keys, left, right).agg(size.alias("c"))
    joint = cell.groupBy(*keys).agg(choose2(F.col("c")).alias("joint"), F.sum("c").alias("n"),
                                    F.count("*").alias("cells"))

    def side(name: str, out: str) -> DataFrame:
        return (cell.groupBy(*keys, name).agg(F.sum("c").alias("c")).groupBy(*keys)
                .agg(choose2(F.col("c")).alias(out), F.count("*").alias(f"{out}_labels")))

    expected = F.try_divide(F.col("l") * F.col("r"), F.col("n") * (F.col("n") - 1) / 2)
    scale = (F.col("l") + F.col("r")) / 2 - expected
    same = (F.col("cells") == F.col("l_labels")) & (F.col("cells") == F.col("r_labels"))
    return (joint.join(side(left, "l"), keys).join(side(right, "r"), keys)
            .select(*keys, "n", F.when(F.col("n") < 2, 1.0)
                    .when(scale == 0, same.cast("double"))
                    .otherwise(F.try_divide(F.col("joint") - expected, scale)).alias("ari")))
