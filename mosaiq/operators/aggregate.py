"""Aggregates over pixels, screens, sprites and textures; all combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import div, pack32
from ..functions.packed import bits, index_size, oam, screen_char, signed, texel_size

IGNORE_ALPHA, BINARY_ALPHA, KEEP_TRANSPARENT, SKIP_TRANSPARENT = 1, 2, 4, 8


def count_colors(px: DataFrame, mode: int, by: str = "img") -> DataFrame:
    """(img, n): different colours. Modes add up: all opaque; opacity of one bit; transparent ones
    keep their colour; transparent ones don't count."""
    a = F.col("a")
    if mode & IGNORE_ALPHA:
        a = F.lit(255).cast("bigint")
    if mode & BINARY_ALPHA:
        a = F.when(a < 128, 0).otherwise(255).cast("bigint")
    color = pack32(F.col("r"), F.col("g"), F.col("b"), a)
    if not mode & KEEP_TRANSPARENT:
        color = F.when(a == 0, 0).otherwise(color)
    if mode & SKIP_TRANSPARENT:
        color = F.when(a != 0, color)
    return px.groupBy(by).agg(F.count_distinct(color).alias("n"))


def highest_char(cells: DataFrame, clear: int | None = None) -> DataFrame:
    """(highest): the greatest character but for the clear value; 0 if there is none."""
    rows = cells if clear is None else cells.where(F.col("raw") != clear)
    return rows.agg(F.coalesce(F.max(screen_char(F.col("raw"))), F.lit(0)).alias("highest"))


def vram_totals(textures: DataFrame) -> DataFrame:
    """Bytes of texels and indices, all and block-compressed, and counts."""
    f, w, h = F.col("fmt"), F.col("width"), F.col("height")
    t = textures.select(f.alias("fmt"), texel_size(f, w, h).alias("texels"), index_size(f, w, h).alias("indices"))
    block = F.col("fmt") == 5
    total = F.col("texels") + F.col("indices")
    return t.agg(F.sum("texels").alias("texels"), F.sum("indices").alias("indices"), F.sum(total).alias("total"), F.sum(F.when(block, total).otherwise(0)).alias("block_total"), F.sum(F.when(block, 0).otherwise(total)).alias("other_total"), F.count_if(block).alias("n_block"))


def palette_bytes(palettes: DataFrame) -> DataFrame:
    """(n_palettes, bytes): video memory of palettes (n_colors), two bytes a colour."""
    return palettes.agg(F.count("*").alias("n_palettes"), (F.sum("n_colors") * 2).cast("bigint").alias("bytes"))


def opaque_box(px: DataFrame, by: str = "img") -> DataFrame:
    """(img, x0, y0, x1, y1): bounds of opaque pixels, ends exclusive; -1 where there are none."""
    solid = F.col("a") >= 128
    end = lambda c, fn, add: F.coalesce(fn(F.when(solid, F.col(c) + add)), F.lit(-1)).cast("bigint")
    return px.groupBy(by).agg(end("x", F.min, 0).alias("x0"), end("y", F.min, 0).alias("y0"), end("x", F.max, 1).alias("x1"), end("y", F.max, 1).alias("y1"))


def sprite_rects(sprites: DataFrame) -> DataFrame:
    """(obj, cell, n, x, y, w, h) with signed places and doubled sizes."""
    o = oam(F.col("attr0"), F.col("attr1"), F.col("attr2"))
    scale = F.when(o["double"] == 1, 2).otherwise(1)
    return sprites.select("obj", "cell", "n", signed(o["x"], 9).alias("x"), signed(o["y"], 8).alias("y"), (o["width"] * scale).alias("w"), (o["height"] * scale).alias("h"))


def cell_box(sprites: DataFrame) -> DataFrame:
    """(cell, x0, y0, x1, y1): bounds of each cell's objects."""
    return sprite_rects(sprites).groupBy("cell").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))


def _mean(c: str, when: Column | None = None) -> Column:
    v = F.col(c) if when is None else F.when(when, F.col(c))
    n = F.count(v)
    return F.when(n > 0, div(F.sum(v) + div(n, 2), F.greatest(n, F.lit(1)))).alias(c)


def average_color(px: DataFrame, by: str = "img") -> DataFrame:
    """(img, r, g, b): rounded means of all pixels."""
    return px.groupBy(by).agg(*map(_mean, "rgb"))


def edge_color(px: DataFrame, by: str = "img") -> DataFrame:
    """(img, r, g, b): rounded means of opaque pixels on the border or beside one that isn't; null if none.

    Neighbours come by window functions over rows and columns, not by joins.
    """
    row, column = Window.partitionBy(by, "y").orderBy("x"), Window.partitionBy(by, "x").orderBy("y")
    beside = [fn("a").over(w) for w in (row, column) for fn in (F.lag, F.lead)]
    edge = (F.col("a") >= 128) & (F.least(*(F.coalesce(b, F.lit(0)) for b in beside)) < 128)
    return px.withColumn("edge", edge).groupBy(by).agg(*(_mean(c, F.col("edge")) for c in "rgb"))


def transparent_count(px: DataFrame, by: str = "img") -> DataFrame:
    return px.groupBy(by).agg(F.count_if(F.col("a") < 128).alias("n"))


def chars_used(sprites: DataFrame, limit: int = 1024) -> DataFrame:
    """(char, n): how many objects use each character, over the run that each object spans."""
    o = oam(F.col("attr0"), F.col("attr1"), F.col("attr2"))
    run = F.sequence(o["char"], F.least(o["char"] + div(o["width"] * o["height"], 64) - 1, F.lit(limit - 1)))
    return sprites.select(F.explode(run).alias("char")).groupBy("char").agg(F.count("*").alias("n"))


def farthest_color(px: DataFrame, rounds: int = 7) -> DataFrame:
    """(r, g, b): a colour far from all opaque pixels, by going down the emptiest of eight octants each round.

    Pixels count in a round if they lie in its box or within half a box around it; of equally empty
    octants the lower red, then green, then blue wins; the last round's middle is the colour. Colours
    are counted once; each round then sums eight numbers over them.
    """
    hist = px.where(F.col("a") >= 128).groupBy("r", "g", "b").agg(F.count("*").alias("n")).persist()
    try:
        low, box = (0, 0, 0), 256
        for _ in range(rounds - 1):
            half = box // 2
            near = hist.where(" AND ".join(f"{c} >= {m - half} AND {c} < {m + box + half}" for c, m in zip("rgb", low, strict=True)))
            upper = [(F.col(c) >= m + half).cast("int") for c, m in zip("rgb", low, strict=True)]
            found = {x["o"]: x["n"] for x in near.groupBy((upper[0] * 4 + upper[1] * 2 + upper[2]).alias("o")).agg(F.sum("n").alias("n")).collect()}
            best = min(range(8), key=lambda o: (found.get(o, 0), o))
            low, box = tuple(m + half * (best >> k & 1) for m, k in zip(low, (2, 1, 0), strict=True)), half
    finally:
        hist.unpersist()
    return px.sparkSession.createDataFrame([tuple(m + box // 2 for m in low)], "r long, g long, b long")


def longest_runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, longest): length of the longest run of one non-zero value, by gaps and islands."""
    w = Window.partitionBy(by).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(by, value).orderBy(order))
    runs = rows.withColumn("_i", island).where(F.col(value) != 0).groupBy(by, value, "_i").agg(F.count("*").alias("_n"))
    return runs.groupBy(by).agg(F.max("_n").alias("longest"))


def longest_byte_run(binary: Column) -> Column:
    """Length of the longest run of one byte but 0, by a pattern over the bytes as Latin-1 characters."""
    runs = F.regexp_extract_all(F.decode(binary, "ISO-8859-1"), F.lit(r"(?s)([^\x00])\1*"), F.lit(0))
    return F.array_max(F.transform(runs, F.length)).cast("bigint")


def frequencies(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n"))


def used_bytes(intervals: DataFrame) -> DataFrame:
    """(start, stop): the union of intervals (start, stop) as maximal ones, in each group ``g``."""
    w = Window.partitionBy("g").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.withColumn("_o", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    return opened.withColumn("_k", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("g", "_k").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_k")
