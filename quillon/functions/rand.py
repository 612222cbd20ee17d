"""Random numbers keyed by (seed, tag, id): the same wherever a row is processed, and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 12345
SCALE = float(1 << 32)


def hash_rand(seed: int, tag: str, *ids: Column) -> Column:
    """Uniform in (0, 1): the first 8 hex digits of md5('seed|tag|id...'), plus a half, over 2^32."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[i.cast("string") for i in ids])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(SCALE)
