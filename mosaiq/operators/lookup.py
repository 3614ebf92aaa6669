"""Positional and keyed lookups: outer joins with defaults, ranges, cascades.

Tiles and palettes have a bounded number of rows by the format (1,024 characters of 64 pixels, 256
colours); they are broadcast after ``within`` has checked that bound, and joined by shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packed import screen_char, screen_flip, screen_palette

#: Rows of a lookup side that may be broadcast: a full character file.
LOOKUP_ROWS = 1024 * 64


def within(df: DataFrame, rows: int = LOOKUP_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has up to ``rows`` rows; counting stops just beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def carried(df: DataFrame, rows: int = LOOKUP_ROWS) -> DataFrame:
    """``df``, marked as ``within`` does; if it is larger, so that a join with it by equality shuffles both sides.

    Without that mark Spark may broadcast the other side, by an estimate from the size of its packed files.
    """
    side = within(df, rows)
    return df.hint("merge") if side is df else side


def cell_fields(cells: DataFrame) -> DataFrame:
    """Screen cells with their packed references taken apart."""
    return cells.withColumns({"char": screen_char(F.col("raw")), "flip": screen_flip(F.col("raw")), "pal": screen_palette(F.col("raw"))})


def render_cells(cells: DataFrame, tiles: DataFrame, palette: DataFrame, transparent: bool = True) -> DataFrame:
    """(cell, pos, color): every pixel of every screen cell.

    A missing tile, and index 0 where transparent, give 0; index 0 otherwise and a missing colour
    give colour 0 of the cell's palette and 0. Flips exchange pixel places: bit 0 across, bit 1 down.
    """
    mask = F.when(F.col("flip") == 1, 7).when(F.col("flip") == 2, 56).when(F.col("flip") == 3, 63).otherwise(0)
    grid = cell_fields(cells).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint")))).withColumn("src", F.col("pos").bitwiseXOR(mask))
    px = grid.join(within(tiles.select(F.col("tile_no").alias("char"), F.col("pos").alias("src"), F.col("idx").alias("px"))), ["char", "src"], "left")
    px = px.withColumn("idx", F.col("pal") * 16 + F.coalesce("px", F.lit(0)))
    px = px.join(within(palette.select("idx", "color")), "idx", "left")
    hidden = F.col("px").isNull() | (F.lit(transparent) & (F.col("px") == 0))
    return px.select("cell", "pos", F.when(hidden, 0).otherwise(F.coalesce("color", F.lit(0))).cast("bigint").alias("color"))


def palette_usage(cells: DataFrame, tiles: DataFrame, palette: DataFrame) -> DataFrame:
    """(idx, n): references of every palette entry by the screen's cells, repeats counted.

    Tiles are counted by index first and cells by tile and palette, so that the join meets counts
    and not pixels; missing tiles and entries beyond the palette count for nothing.
    """
    inks = tiles.groupBy(F.col("tile_no").alias("char"), F.col("idx").alias("px")).agg(F.count("*").alias("inks"))
    refs = cell_fields(cells).groupBy("char", "pal").agg(F.count("*").alias("refs"))
    used = refs.join(within(inks), "char").groupBy((F.col("pal") * 16 + F.col("px")).alias("idx")).agg(F.sum(F.col("refs") * F.col("inks")).alias("n"))
    return used.join(within(palette.select("idx")), "idx")


def remap(addresses: DataFrame, transfers: DataFrame, bucket: int = 4096) -> DataFrame:
    """Addresses in some transfer's destination [dst, dst + size) as their source, others as they are.

    A range join by buckets: a transfer is repeated for each bucket that it touches, so both sides
    meet by equality. The first transfer by (dst, src) wins.
    """
    t = transfers.where("size > 0").withColumn("bucket", F.explode(F.sequence(F.expr(f"dst div {bucket}"), F.expr(f"(dst + size - 1) div {bucket}"))))
    a = addresses.withColumn("bucket", F.expr(f"addr div {bucket}"))
    hit = a.join(t, (a["bucket"] == t["bucket"]) & (a["addr"] >= t["dst"]) & (a["addr"] < t["dst"] + t["size"]))
    first = hit.groupBy(a["id"], a["addr"]).agg(F.min_by(F.col("src") - F.col("dst"), F.struct("dst", "src")).alias("shift"))
    return addresses.join(first, ["id", "addr"], "left").select("id", "addr", (F.col("addr") + F.coalesce("shift", F.lit(0))).alias("mapped"))


def with_default(rows: DataFrame, found: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """Left lookup of ``value`` by ``key``; what misses has ``default``."""
    return rows.join(found.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), default))


#: Length that names are cut to, and the ending of a palette's name.
NAME, ENDING = 16, "_pl"
#: Palettes of a file that may be broadcast.
FILE_PALETTES = 4096
# Most colours of a palette by texture format, the format without one, the block format and its leeway.
MOST_COLORS = {1: 256, 2: 8, 3: 16, 4: 256, 6: 256}
DIRECT_FORMAT, BLOCK_FORMAT, BLOCK_LEEWAY = 7, 5, 7


def palette_fits(fmt: Column, highest: Column, n_colors: Column) -> Column:
    """Whether a palette has enough colours for a texture's highest index, and no more than its format allows."""
    most = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in MOST_COLORS.items() for x in kv)), fmt.cast("int")), F.lit(1 << 30))
    return (n_colors <= most) & (highest < n_colors) & ((fmt != BLOCK_FORMAT) | (highest + BLOCK_LEEWAY >= n_colors))


def guess_palettes(textures: DataFrame, palettes: DataFrame) -> DataFrame:
    """(id, pal, rule): the palette that suits a texture (id, name, fmt, highest), by the first rule that fits.

    1 equal names but for case; 2 with ``_pl``, cut to 16; 3 that cut to 15; 4 the name cut to 13 with
    ``_pl``; 5 cut to 12 with ``_pl``; of the palettes (pal, pal_name, n_colors) that fit by size 6 the
    only one, 7 the nearest by edits, the first at ties; 8 the first of all. Textures of the direct
    format have none and give no row. Rules 1 to 5 are lookups by an equal key; only the different
    (name, format, highest index) that they leave are compared with all palettes of a file. Palettes are
    carried to the textures, up to FILE_PALETTES of them; textures are only ever shuffled.
    """
    textures = textures.where(F.col("fmt") != DIRECT_FORMAT)
    low = F.lower("name")
    keys = [low, F.substring(F.concat(low, F.lit(ENDING)), 1, NAME), F.substring(F.concat(low, F.lit(ENDING)), 1, NAME - 1), F.concat(F.substring(low, 1, NAME - 3), F.lit(ENDING)), F.concat(F.substring(low, 1, NAME - 4), F.lit(ENDING))]
    wanted = textures.select("id", "name", F.posexplode(F.array(*keys)).alias("rule", "key"))
    first = palettes.groupBy(F.lower("pal_name").alias("key")).agg(F.min("pal").alias("pal"))
    by_key = wanted.join(carried(first, FILE_PALETTES), "key").groupBy("id").agg(F.min_by("pal", F.struct("rule", "pal")).alias("pal"), (F.min("rule") + 1).alias("rule"))
    rest = textures.join(by_key.select("id").hint("merge"), "id", "left_anti").select("id", "name", "fmt", "highest")
    kinds, few = rest.select("name", "fmt", "highest").distinct(), within(palettes, FILE_PALETTES)
    pairs = kinds.join(few) if few is not palettes else kinds.join(palettes.hint("shuffle_replicate_nl"))
    fits = palette_fits(F.col("fmt"), F.col("highest"), F.col("n_colors"))
    edits = F.when(fits, F.levenshtein("name", "pal_name"))
    near = pairs.groupBy("name", "fmt", "highest").agg(F.count(edits).alias("n"), F.min(F.when(fits, F.struct(edits.alias("e"), "pal"))).alias("best"), F.min("pal").alias("any"))
    pal = F.when(F.col("n") > 0, F.col("best")["pal"]).otherwise(F.col("any"))
    rule = F.when(F.col("n") == 1, 6).when(F.col("n") > 1, 7).otherwise(8)
    found = rest.join(near.hint("merge"), [rest[k].eqNullSafe(near[k]) for k in ("name", "fmt", "highest")]).select("id", pal.alias("pal"), rule.cast("bigint").alias("rule"))
    return by_key.select("id", "pal", F.col("rule").cast("bigint")).unionByName(found)


def by_name(wanted: DataFrame, named: DataFrame) -> DataFrame:
    """(id, found): the first of ``named(found, name)`` with the same name as each row of ``wanted(id, name)``; -1 if none.

    Names are told apart by their first NAME characters, as a file holds no more.
    """
    key = lambda c: F.substring(c, 1, NAME)
    first = named.groupBy(key("name").alias("key")).agg(F.min("found").alias("found"))
    return wanted.select("id", key("name").alias("key")).join(first, "key", "left").select("id", F.coalesce("found", F.lit(-1)).cast("bigint").alias("found"))


def highest_index(texels: DataFrame) -> DataFrame:
    """(id, highest): the greatest palette index of textures' texel bytes (id, fmt, byte); -1 for the direct format.

    Block textures are read from their index words instead: (id, fmt, word) with the mode in the two
    highest bits, which says whether a block has four colours or two, and the offset in pairs below.
    """
    b = F.col("byte")
    parts = lambda width: F.greatest(*(F.shiftright(b, s).bitwiseAND((1 << width) - 1) for s in range(0, 8, width)))
    word = F.col("word")
    mode = F.shiftright(word, 14).bitwiseAND(3)
    block = word.bitwiseAND(0x3FFF) * 2 + F.when(mode % 2 == 0, 3).otherwise(1)
    f = F.col("fmt")
    index = F.when(f == 1, b.bitwiseAND(31)).when(f == 2, parts(2)).when(f == 3, parts(4)).when(f == 4, b).when(f == 6, b.bitwiseAND(7)).when(f == BLOCK_FORMAT, block)
    return texels.groupBy("id").agg(F.when(F.max("fmt") == DIRECT_FORMAT, -1).otherwise(F.coalesce(F.max(index), F.lit(0))).cast("bigint").alias("highest"))


def overlapping(rects: DataFrame, group: str, tile: int = 64) -> DataFrame:
    """(group, a, b), a < b: pairs of a group's rectangles (id, x, y, w, h) that intersect.

    A group's rectangles meet by grid squares; a pair counts in the square of its intersection's
    corner alone, so that no pair comes twice and far ones never meet.
    """
    r = rects.withColumns({"gx": F.explode(F.sequence(F.floor(F.col("x") / tile), F.floor((F.col("x") + F.col("w") - 1) / tile)))})
    r = r.withColumn("gy", F.explode(F.sequence(F.floor(F.col("y") / tile), F.floor((F.col("y") + F.col("h") - 1) / tile))))
    a, b = r.alias("a"), r.alias("b")
    c = lambda side, name: F.col(f"{side}.{name}")
    same = (c("a", group) == c("b", group)) & (c("a", "gx") == c("b", "gx")) & (c("a", "gy") == c("b", "gy")) & (c("a", "id") < c("b", "id"))
    meet = (c("a", "x") < c("b", "x") + c("b", "w")) & (c("b", "x") < c("a", "x") + c("a", "w")) & (c("a", "y") < c("b", "y") + c("b", "h")) & (c("b", "y") < c("a", "y") + c("a", "h"))
    corner = (F.floor(F.greatest(c("a", "x"), c("b", "x")) / tile) == c("a", "gx")) & (F.floor(F.greatest(c("a", "y"), c("b", "y")) / tile) == c("a", "gy"))
    return a.join(b, same & meet & corner).select(c("a", group).alias(group), c("a", "id").alias("a"), c("b", "id").alias("b"))


def hit_test(points: DataFrame, rects: DataFrame, group: str) -> DataFrame:
    """(pid, hit): for each point the last rectangle of its group that holds it, -1 if none."""
    inside = (points[group] == rects[group]) & (F.col("px") >= F.col("x")) & (F.col("px") < F.col("x") + F.col("w")) & (F.col("py") >= F.col("y")) & (F.col("py") < F.col("y") + F.col("h"))
    return points.join(rects, inside, "left").groupBy("pid").agg(F.coalesce(F.max("id"), F.lit(-1)).cast("bigint").alias("hit"))


def insert_absent(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``rows`` and those of ``new`` whose key they lack, the first of each key by ``id``."""
    first = Window.partitionBy(key).orderBy("id")
    fresh = new.join(rows, key, "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.unionByName(fresh.select(*rows.columns))


def merge_prefixed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of (name, colors): the longer of two lists if one begins the other, else the old one with conflict true."""
    o, n = old.select("name", F.col("colors").alias("o")), new.select("name", F.col("colors").alias("n"))
    k = F.least(F.size("o"), F.size("n"))
    begins = F.slice("o", F.lit(1), k) == F.slice("n", F.lit(1), k)
    both = o.join(n, "name", "full")
    colors = F.when(F.col("n").isNull() | ~begins | (F.size("o") >= F.size("n")), F.coalesce("o", "n")).otherwise(F.col("n"))
    return both.select("name", colors.alias("colors"), F.coalesce(~begins, F.lit(False)).alias("conflict"))


def tile_attributes(objects: DataFrame, tiles: int = 1024) -> DataFrame:
    """(tile, pal): the palette of the last object that shows each tile, over objects (obj, char, n, pal) of ``n`` tiles from ``char`` on."""
    run = F.sequence(F.col("char"), F.least(F.col("char") + F.col("n") - 1, F.lit(tiles - 1)))
    return last_writer(objects.where(F.col("char") < tiles).select("obj", "pal", F.explode(run).alias("tile")), "tile", "obj", "pal")


def last_writer(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value): the value written last."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def nth_of_kind(members: DataFrame, group: str, kind: str, order: str, n: int) -> DataFrame:
    """The n-th (from 0) member of each kind in each group."""
    w = Window.partitionBy(group, kind).orderBy(order)
    return members.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == n + 1).drop("_n")
