"""Content identities, stable seeds and comparability keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(prefix: str, *parts: str) -> Column:
    """``prefix`` plus the sha256 of the JSON of the named columns, in name order."""
    body = F.to_json(F.struct(*[F.col(p) for p in sorted(parts)]))
    return F.concat(F.lit(prefix), F.sha2(body, 256))


def stable_seed(*parts: Column) -> Column:
    """A 32-bit seed from the first eight hex digits of the sha256 of the joined parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def comparison_key(controls: Sequence[str]) -> Column:
    """Hash of the complete runtime controls; null as soon as one is missing."""
    known = F.lit(True)
    for name in controls:
        known = known & F.col(name).isNotNull()
    return F.when(known, content_id("", *controls))


def non_finite_tag(value: Column) -> Column:
    """Text of a value that may not be stored as a number."""
    return (F.when(value.isNull(), "null").when(F.isnan(value), "NaN")
            .when(value == float("inf"), "Infinity").when(value == float("-inf"), "-Infinity"))
