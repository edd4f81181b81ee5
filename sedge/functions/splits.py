"""Deterministic splits by hashed key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_bucket(key: Column, seed: int) -> Column:
    """A number in [0, 1] from the first 16 hex digits of sha256("seed:key")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(18446744073709551615.0)


def check_ratios(train: float, validation: float) -> None:
    if train <= 0 or validation < 0 or train + validation >= 1:
        raise ValueError("train must be positive, validation not negative, and their sum below 1")


def split_name(key: Column, train: float, validation: float, seed: int) -> Column:
    """train, validation or test; every row of a key lands in the same split, a null key in none."""
    check_ratios(train, validation)
    b = stable_bucket(key, seed)
    return F.when(b < train, "train").when(b < train + validation, "validation").when(b.isNotNull(), "test")
