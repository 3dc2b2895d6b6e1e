"""All pairs of the members of classes, where a result asks for them, without a hot key.

A class of more than ``BLOCK`` members is cut into blocks that meet pairwise as separate
keys, so a class that holds a third of all rows is spread over many tasks.

Defined results: a class of one gives no pair; a member listed twice in a class counts once;
null members and classes give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import cut

#: Members of a block.
BLOCK = 1_000


def blocked(members: DataFrame, key: str, of: str, block: int = BLOCK) -> DataFrame:
    """``members`` of classes of two or more, with ``blk`` and the number ``blks`` of blocks of the class."""
    several = members.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.ceil(F.col("n") / block).cast("int").alias("blks"))
    return members.join(several, key).withColumn("blk", F.pmod(F.xxhash64(F.lit(5), of), F.col("blks")).cast("int"))


def class_pairs(members: DataFrame, key: str, of: str, block: int = BLOCK) -> DataFrame:
    """``x, y`` (x < y): every pair of members ``of`` of one class ``key``."""
    one = members.select(key, of).where(F.col(key).isNotNull() & F.col(of).isNotNull()).distinct()
    m = cut(blocked(one, key, of, block))
    upper = m.select(key, F.col(of).alias("x"), F.col("blk").alias("p"), F.explode(F.sequence("blk", F.col("blks") - 1)).alias("q"))
    lower = m.select(key, F.col(of).alias("y"), F.col("blk").alias("q"), F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("p"))
    met = upper.join(lower, [key, "p", "q"]).where("p != q or x < y")
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
