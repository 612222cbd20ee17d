"""String helpers."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.rand import hash_rand

CHARACTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"  # fixed value


def get_extension(name: Column) -> Column:
    """Text after the last dot; empty without a dot."""
    return F.regexp_extract(name, r"\.([^.]*)$", 1)


def split_string(text: Column, delimiters: str) -> Column:
    """Non-empty tokens between any of the delimiter characters."""
    pattern = "[" + "".join(re.escape(c) for c in delimiters) + "]"
    return F.filter(F.split(text, pattern), lambda t: t != "")


def random_string(most: int, seed: int, key: Column) -> Column:
    """1 to most - 1 letters and digits (1 if most is 1), drawn by key."""
    size = F.greatest(F.lit(1), F.floor(hash_rand(seed, "size", key) * most)).cast("int")
    place = lambda i: F.floor(hash_rand(seed, "character", key, i) * len(CHARACTERS)).cast("int") + 1
    return F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: F.substr(F.lit(CHARACTERS), place(i), F.lit(1))), "")


def get_time() -> float:
    """Seconds since 1970 by the driver's clock."""
    return time.time()
