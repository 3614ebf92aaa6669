"""Images to screens: palettes for groups of tiles, best palettes and references, assembly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import YIQ, distance, div
from ..functions.packed import screen_pack
from . import dedup, quantize


def tiled(px: DataFrame) -> DataFrame:
    """Pixels with their tile (img * 64 + row * 8 + column of 8 x 8) and place within it; opacity made one bit."""
    return px.withColumns({"tile_no": F.col("img") * 64 + div(F.col("y"), 8) * 8 + div(F.col("x"), 8), "pos": (F.col("y") % 8) * 8 + F.col("x") % 8, "a": F.when(F.col("a") < 128, 0).otherwise(255).cast("bigint")})


def tile_palettes(px: DataFrame, banks: int, colors: int = 16) -> list[list[tuple[int, int, int, int]]]:
    """``banks`` palettes of up to ``colors`` colours for all tiles.

    Tiles are clustered by their mean colours, a row a tile and 32,768 at most after rounding; each
    cluster's pixels, as one grouped histogram, are then reduced together.
    """
    t = tiled(px).where("a > 0")
    mean = t.groupBy("tile_no").agg(*(F.expr(f"(sum({c}) * 2 + count(*)) div (count(*) * 2)").alias(c) for c in "rgb"))
    centres = quantize.create_palette(mean.groupBy("r", "g", "b").agg(F.count("*").alias("w")), banks)
    if not centres:
        return []
    m = quantize.with_yiq(mean)
    bank = m.select("tile_no", quantize.nearest(m, centres)[0].alias("bank"))
    own = t.join(bank, "tile_no").groupBy("bank", *(F.expr(f"({c} div 8) * 8 + 4").alias(c) for c in "rgb")).agg(F.count("*").alias("w"))
    rows = own.toPandas()  # banks * 32,768 rows at most
    out = []
    for k in sorted(rows["bank"].unique()):
        part = rows[rows["bank"] == k].sort_values(["r", "g", "b"])
        means = quantize.divide(part[["r", "g", "b"]].to_numpy(float) @ np.array(YIQ).T, part["w"].to_numpy(float), colors - 1)
        rgb = np.clip(np.floor(means @ np.linalg.inv(np.array(YIQ)).T + 0.5), 0, 255).astype(int)
        out.append([(i, *c) for i, c in enumerate([(0, 0, 0), *map(tuple, rgb.tolist())])])
    return out


def best_palettes(px: DataFrame, banks: list[list[tuple[int, int, int, int]]]) -> DataFrame:
    """(tile_no, pal, error): the palette under which each tile's pixels lie nearest, the first at ties."""
    t = quantize.with_yiq(tiled(px).where("a > 0"))
    errors = [F.sum(quantize.nearest(t, bank[1:])[1]).alias(f"e{k}") for k, bank in enumerate(banks)]
    sums = t.groupBy("tile_no").agg(*errors)
    best = F.array_min(F.array(*(F.struct(F.round(f"e{k}", 4).alias("e"), F.lit(k).cast("bigint").alias("pal")) for k in range(len(banks)))))
    return sums.select("tile_no", best["pal"].alias("pal"), best["e"].alias("error"))


def generate(px: DataFrame, banks: int = 4) -> tuple[DataFrame, DataFrame, list]:
    """(cells (img, tile_no, raw), characters (img, id, px), palettes) of images: palettes, indices, merging, assembly.

    Images share the palettes; each has its own characters, of which a reference can name 1,024 and
    an image of 64 x 64 pixels needs 64 at most.
    """
    palettes = tile_palettes(px, banks)
    if not palettes:
        raise ValueError("no opaque pixels")
    of = best_palettes(px, palettes)
    t = tiled(px).join(of.select("tile_no", "pal"), "tile_no", "left").withColumn("pal", F.coalesce("pal", F.lit(0)))
    t = quantize.with_yiq(t)
    idx = F.lit(0).cast("bigint")
    for k, bank in enumerate(palettes):
        idx = F.when(F.col("pal") == k, quantize.nearest(t, bank[1:])[0]).otherwise(idx)
    own = t.select("tile_no", "pos", "pal", F.when(F.col("a") == 0, 0).otherwise(idx).alias("idx"))
    arrays = dedup.tile_arrays(own).withColumn("img", div(F.col("tile_no"), 64))
    merged = dedup.merge_flipped(arrays, group="img")
    cells = merged.join(own.groupBy("tile_no").agg(F.min("pal").alias("pal")), "tile_no").select("img", "tile_no", screen_pack(F.col("id"), F.col("flip"), F.col("pal")).alias("raw"))
    chars = merged.where("tile_no = master").join(arrays.select("tile_no", "px"), "tile_no").select("img", "id", "px")
    return cells, chars, palettes


def replace_blocks(blocks: DataFrame, tiles: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """(block, tile_no, flip, error): the tile and flip whose colours lie nearest each block (block, pos, r, g, b).

    ``tiles`` has (tile_no, px) of one character file, 1,024 rows at most: it is carried to the blocks.
    The first tile, and the first flip, at ties.
    """
    yiqs = [[sum(k * v for k, v in zip(row, c, strict=True)) for row in YIQ] for c in palette]
    table = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(y, "yiq", strict=True))) for y in yiqs))
    b = quantize.with_yiq(blocks).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "cy", "ci", "cq"))).alias("own"))
    if tiles.limit(dedup.TILES + 1).count() > dedup.TILES:
        raise ValueError(f"a character file has up to {dedup.TILES} tiles")
    pairs = b.join(F.broadcast(tiles))
    scored = []
    for k, mask in enumerate(dedup.FLIPS):
        turned = dedup.flipped(F.col("px"), mask)
        err = F.aggregate(F.zip_with("own", turned, lambda o, i: distance((o["cy"], o["ci"], o["cq"]), tuple(F.element_at(table, (i + 1).cast("int"))[n] for n in "yiq"))), F.lit(0.0), lambda s, v: s + v)
        scored.append(F.struct(F.round(err, 4).alias("error"), F.lit(k).cast("bigint").alias("flip")))
    best = pairs.select("block", "tile_no", F.array_min(F.array(*scored)).alias("b"))
    first = best.groupBy("block").agg(F.min(F.struct(F.col("b")["error"].alias("error"), "tile_no", F.col("b")["flip"].alias("flip"))).alias("m"))
    return first.select("block", F.col("m")["tile_no"].alias("tile_no"), F.col("m")["flip"].alias("flip"), F.col("m")["error"].alias("error"))


def masked15(px: DataFrame) -> DataFrame:
    """Pixels with the nearest 15-bit colour in the weighted metric, not channel by channel.

    The nearest lies within one level of the rounded channels, so 27 candidates are tried in place
    of 32,768; the smallest colour at ties.
    """
    p = quantize.with_yiq(px)
    level = lambda c: div(F.col(c) * 62 + 255, 510)
    options = []
    for dr in (-1, 0, 1):
        for dg in (-1, 0, 1):
            for db in (-1, 0, 1):
                five = [F.least(F.greatest(level(c) + d, F.lit(0)), F.lit(31)) for c, d in zip("rgb", (dr, dg, db), strict=True)]
                eight = [div(v * 510 + 31, 62) for v in five]
                q = tuple(sum((k * v for k, v in zip(row, eight, strict=True)), F.lit(0.0)) for row in YIQ)
                options.append(F.struct(F.round(distance((F.col("cy"), F.col("ci"), F.col("cq")), q), 6).alias("d"), (five[0] + five[1] * 32 + five[2] * 1024).alias("color")))
    return p.select(*px.columns, F.array_min(F.array(*options))["color"].alias("color"))


def linked(links: DataFrame) -> DataFrame:
    """(from_id, to_id): the last link of each object; linking again takes the earlier link away."""
    return links.groupBy("from_id").agg(F.max_by("to_id", "at").alias("to_id")).where("to_id IS NOT NULL")


def forest(events: DataFrame) -> DataFrame:
    """(from_id, to_id): what each object links to after events (from_id, to_id, at, what) of linking and unlinking.

    An object has one link: a new one takes the last away. Unlinking takes away only a link to the object it names.
    """
    last = events.where("what = 'link'").groupBy("from_id").agg(F.max_by("to_id", "at").alias("to_id"), F.max("at").alias("since"))
    undone = events.where("what = 'unlink'").groupBy("from_id", "to_id").agg(F.max("at").alias("until"))
    return last.join(undone, ["from_id", "to_id"], "left").where("until IS NULL OR until < since").select("from_id", "to_id")


def sorted_palette(palette: DataFrame, by: list[str]) -> DataFrame:
    """(idx, place): a palette's entries in order of columns, then of index."""
    return palette.select("idx", (F.row_number().over(Window.orderBy(*by, "idx")) - 1).cast("bigint").alias("place"))
