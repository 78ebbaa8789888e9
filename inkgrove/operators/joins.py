"""Joins that keep their balance when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALT = "__join_salt"
_PARTS = "__join_parts"


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, most_share: float = 1 / 1024) -> DataFrame:
    """left LEFT JOIN right USING (key), with hot keys of left cut into salts.

    A key with more than most_share of the rows is hot; there are fewer than 1 / most_share of
    them, which is the proven bound of the only forced broadcast here. A hot key is cut into as
    many salts as it holds shares, and only its own right row is repeated that often. Where right
    is small the optimizer still broadcasts it by its own size check and no row is shuffled.
    Right must be unique in key. Rows with a null key are kept, unmatched. Columns of right that
    left has too are not allowed (rename them first).
    """
    total = left.count()
    share = max(1, int(total * most_share))
    hot = (
        left.groupBy(key)
        .agg(F.count(F.lit(1)).alias(_PARTS))
        .where(F.col(key).isNotNull() & (F.col(_PARTS) > share))
        .select(key, F.ceil(F.col(_PARTS) / F.lit(share)).cast("int").alias(_PARTS))
    )
    salt = F.when(F.col(_PARTS).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread_by), F.col(_PARTS)).cast("int"))
    many = left.join(F.broadcast(hot), key, "left").withColumn(_SALT, salt).drop(_PARTS)
    copies = F.when(F.col(_PARTS).isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(_PARTS) - 1))
    one = right.join(F.broadcast(hot), key, "left").withColumn(_SALT, F.explode(copies)).drop(_PARTS)
    return many.join(one, [key, _SALT], "left").drop(_SALT)
