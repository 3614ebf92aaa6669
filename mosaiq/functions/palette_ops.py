"""Operations over whole palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .color import channels15, from_hsv, hsv


def rotate(palette: DataFrame, hue: int, saturation: int, value: int, replicas: int, turn: int = 0, keep_first: bool = False) -> DataFrame:
    """(idx, replica, r, g, b, place): each entry turned in hue and moved in saturation and value, once more per replica.

    Each replica starts from the one before it, held within its bounds; as all steps of one
    operation have the same sign, that is the whole way at once, held once. ``place`` is where an entry
    of a replica goes: ``turn`` entries on for each replica, round the whole palette. With
    ``keep_first`` entry 0 keeps its colour and its place, and the others go round without it.
    """
    size = palette.agg((F.max("idx") + 1).alias("size"))
    first = (F.col("idx") == 0) & F.lit(keep_first)
    red, green, blue = channels15(F.col("color"))
    h, s, v = hsv(red, green, blue)
    p = palette.select("idx", h.alias("h"), s.alias("s"), v.alias("v"), red.alias("r0"), green.alias("g0"), blue.alias("b0")).withColumn("replica", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(replicas).cast("bigint"))))
    held = lambda c, step: F.least(F.greatest(F.col(c) + F.col("replica") * step, F.lit(0)), F.lit(100))
    p = p.select("idx", "replica", "r0", "g0", "b0", F.pmod(F.col("h") + F.col("replica") * hue, F.lit(360)).alias("h"), held("s", saturation).alias("s"), held("v", value).alias("v"))
    turned = from_hsv(F.col("h"), F.col("s"), F.col("v"))
    by = F.col("replica") * turn
    place = F.pmod(F.col("idx") + by, F.col("size")) if not keep_first else F.when(first, 0).otherwise(F.pmod(F.col("idx") - 1 + by, F.greatest(F.col("size") - 1, F.lit(1))) + 1)
    p = p.join(F.broadcast(size))  # one row
    return p.select("idx", "replica", *(F.when(first, F.col(f"{n}0")).otherwise(c).alias(n) for n, c in zip("rgb", turned, strict=True)), place.cast("bigint").alias("place"))
