"""Ordered rows: runs, filters, playback, segments, gaps, and the geometry of tiles and screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import div

FORWARD, FORWARD_LOOP, BACKWARD, BACKWARD_LOOP = 1, 2, 3, 4


def difference(rows: DataFrame, by: str, order: str, value: str, modulus: int = 256) -> DataFrame:
    """``value`` less the one before, modulo ``modulus``; the first less 0."""
    before = F.coalesce(F.lag(value).over(Window.partitionBy(by).orderBy(order)), F.lit(0))
    return rows.withColumn(value, F.pmod(F.col(value) - before, F.lit(modulus)))


def difference_array(values: Column, modulus: int = 256) -> Column:
    """``difference`` within an array: no rows move."""
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))))
    return F.zip_with(values, before, lambda v, b: F.pmod(v - b, F.lit(modulus)))


def running(rows: DataFrame, by: str, order: str, value: str, modulus: int = 256) -> DataFrame:
    """The inverse of ``difference``: a running sum modulo ``modulus``."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.pmod(F.sum(value).over(w), F.lit(modulus)))


def runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, start, value, n): maximal runs of equal neighbours."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    k = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_new", new).withColumn("_k", k).groupBy(by, "_k").agg(F.min(order).alias("start"), F.first(value).alias(value), F.count("*").alias("n")).drop("_k")


# ---- playback

def frame_path(n: Column, mode: Column, start: Column) -> tuple[Column, Column]:
    """Steps of a sequence of ``n`` frames from ``start``: (those played once, those that then repeat).

    Forward plays to the end and stays; a forward loop goes on at 0, wherever it began. Backward
    turns at the end, shows the last frame but one next, and stays at 0; a backward loop turns again
    at 0 and goes on at 1.
    """
    last = n - 1
    up = F.sequence(start, last)
    down = F.when(last > 0, F.sequence(last - 1, F.lit(0).cast("bigint"), F.lit(-1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    none = F.array().cast("array<bigint>")
    once = F.when(mode >= BACKWARD, F.concat(up, down)).otherwise(up)
    again = F.when(last > 0, F.concat(F.sequence(F.lit(1).cast("bigint"), F.greatest(last, F.lit(1))), down)).otherwise(F.array(F.lit(0).cast("bigint")))
    loop = F.when(mode == FORWARD_LOOP, F.sequence(F.lit(0).cast("bigint"), last)).when(mode == BACKWARD_LOOP, again).otherwise(none)
    return once, loop


def timeline(frames: DataFrame, key: str = "seq") -> DataFrame:
    """(seq, step, frame_no, from, until, period, intro): when each step of a sequence's path shows.

    ``until`` is null for a step that stays. A step of the repeating part shows again every
    ``period`` ticks. Paths are built per sequence and joined to their frames' durations.
    """
    head = frames.groupBy(key).agg(F.count("*").alias("n"), F.min("mode").alias("mode"))
    once, loop = frame_path(F.col("n"), F.col("mode"), F.lit(0).cast("bigint"))
    steps = head.select(key, "mode", F.size(once).cast("bigint").alias("once"), F.size(loop).alias("again"), F.posexplode(F.concat(once, loop)).alias("step", "frame_no"))
    t = steps.join(frames.select(key, "frame_no", "duration"), [key, "frame_no"])
    w = Window.partitionBy(key).orderBy("step")
    t = t.withColumn("until", F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("from", F.col("until") - F.col("duration"))
    all_ = Window.partitionBy(key)
    intro = F.sum(F.when(F.col("step") < F.col("once"), F.col("duration")).otherwise(0)).over(all_)
    period = F.sum(F.when(F.col("step") >= F.col("once"), F.col("duration")).otherwise(0)).over(all_)
    t = t.withColumns({"intro": intro, "period": period, "last": F.max("step").over(all_)})
    stays = (F.col("again") == 0) & (F.col("step") == F.col("last"))
    return t.select(key, F.col("step").cast("bigint").alias("step"), "frame_no", "from", F.when(~stays, F.col("until")).alias("until"), "period", "intro")


def at_ticks(frames: DataFrame, ticks: DataFrame, key: str = "seq") -> DataFrame:
    """(seq, tick, frame_no): the frame that shows after each tick of (seq, tick).

    Ticks past the intro are folded into the repeating part; then a join by sequence keeps the step
    whose stretch of time holds the tick.
    """
    t = timeline(frames, key)
    whole = t.select(key, "intro", "period").distinct()
    folded = ticks.join(whole, key).withColumn("_t", F.when((F.col("period") > 0) & (F.col("tick") >= F.col("intro")), F.col("intro") + (F.col("tick") - F.col("intro")) % F.greatest(F.col("period"), F.lit(1))).otherwise(F.col("tick")))
    s = t.select(key, "from", "until", "frame_no")
    return folded.join(s, key).where((F.col("_t") >= F.col("from")) & (F.col("until").isNull() | (F.col("_t") < F.col("until")))).select(key, "tick", "frame_no")


def interpolated(pairs: DataFrame, frames: int) -> DataFrame:
    """(id, i, x, duration): ``frames`` steps from x0 to x1, and an even division of ``total``.

    Weights are 2(n - i) and 2(i + 1), rounded half away from zero; each duration takes its share,
    rounded half up, of what is left.
    """
    i = F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))
    p = pairs.withColumn("i", i)
    w0, w1 = (F.lit(frames) - F.col("i")) * 2, (F.col("i") + 1) * 2
    total = F.lit(2 * frames + 2)
    x = F.col("x0") * w0 + F.col("x1") * w1
    x = div(x + F.when(x < 0, -div(total, 2)).otherwise(div(total, 2)), total)
    shares = F.aggregate(F.sequence(F.lit(0), F.lit(frames - 1)), F.struct(F.col("total").cast("bigint").alias("left"), F.array().cast("array<bigint>").alias("d")), lambda s, k: F.struct((s["left"] - div(s["left"] * 2 + F.lit(frames) - k, (F.lit(frames) - k) * 2)).alias("left"), F.concat(s["d"], F.array(div(s["left"] * 2 + F.lit(frames) - k, (F.lit(frames) - k) * 2))).alias("d")))
    return p.select("id", F.col("i").cast("bigint").alias("i"), x.alias("x"), F.get(shares["d"], F.col("i")).alias("duration"))


def interpolated_frames(pairs: DataFrame, frames: int, clockwise: bool) -> DataFrame:
    """(id, i, duration, index, px, py, sx, sy, rot_z): ``frames`` steps between two frames, their values numbered 0 and 1.

    As ``interpolated`` for every value. A turn goes the way asked for: the angle behind gains a whole
    turn. Index and turn round half up, the others half away from zero.
    """
    p = pairs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(frames - 1).cast("bigint"))))
    w0, w1, total = (F.lit(frames) - F.col("i")) * 2, (F.col("i") + 1) * 2, 2 * frames + 2
    mixed = lambda a, b: a * w0 + b * w1

    def away(name: str) -> Column:
        x = mixed(F.col(f"{name}0"), F.col(f"{name}1"))
        return div(x + F.when(x < 0, -(total // 2)).otherwise(total // 2), total).alias(name)

    a, b = F.col("rot_z0"), F.col("rot_z1")
    rot = mixed(a, F.when(b < a, b + 65536).otherwise(b)) if clockwise else mixed(F.when(a < b, a + 65536).otherwise(a), b)
    even = interpolated(pairs.select("id", F.lit(0).cast("bigint").alias("x0"), F.lit(0).cast("bigint").alias("x1"), "total"), frames).select("id", "i", "duration")
    index = div(mixed(F.col("index0"), F.col("index1")) + total // 2, total).alias("index")
    out = p.select("id", "i", index, *map(away, ("px", "py", "sx", "sy")), (div(rot + total // 2, total) % 65536).alias("rot_z"))
    return out.join(even, ["id", "i"])


def widened(frames: DataFrame) -> DataFrame:
    """Frames with every value that a frame type may leave out: no turn, a scale of one, no offset."""
    plain = {"rot_z": 0, "sx": 4096, "sy": 4096, "px": 0, "py": 0}
    return frames.withColumns({n: (F.coalesce(F.col(n), F.lit(v)) if n in frames.columns else F.lit(v)).cast("bigint") for n, v in plain.items()})


def frame_kind(frames: DataFrame, key: str = "seq") -> DataFrame:
    """(seq, kind): the narrowest frame type that keeps a sequence: 0 index, 1 with offsets, 2 with scale and turn."""
    turn = F.bool_or((F.col("sx") != 4096) | (F.col("sy") != 4096) | (F.col("rot_z") != 0))
    move = F.bool_or((F.col("px") != 0) | (F.col("py") != 0))
    return frames.groupBy(key).agg(F.when(turn, 2).when(move, 1).otherwise(0).cast("bigint").alias("kind"))


def transform_matrix(cx: Column, cy: Column, sx: Column, sy: Column, rot: Column, tx: Column, ty: Column) -> dict[str, Column]:
    """Scale, turn and move about a centre."""
    s, c = F.sin(rot), F.cos(rot)
    return {"a": sx * c, "b": -sy * s, "c": sx * s, "d": sy * c, "e": cx * (1 - sx * c) + sy * cy * s + tx, "f": cy * (1 - sy * c) - sx * cx * s + ty}


# ---- segments and gaps

def tiling_errors(segments: DataFrame, by: str) -> DataFrame:
    """(by, errors): where sorted segments (offset, size) don't begin at 0, leave a gap, overlap, or repeat an offset with another size."""
    w = Window.partitionBy(by).orderBy("offset", "size")
    o, s = F.lag("offset").over(w), F.lag("size").over(w)
    bad = F.when(o.isNull(), F.col("offset") != 0).when(F.col("offset") == o, F.col("size") != s).otherwise(F.col("offset") != o + s)
    return segments.withColumn("_b", bad.cast("int")).groupBy(by).agg(F.sum("_b").alias("errors"))


def first_gap(used: DataFrame, by: str, size: int, step: int, limit: int) -> DataFrame:
    """(by, place): the first multiple of ``step`` where ``size`` units are free below ``limit``; -1 if none.

    ``used`` has intervals (start, stop). Candidates are 0 and the places after each interval, not all multiples.
    """
    w = Window.partitionBy(by).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, 0))
    up = lambda c: F.expr(f"(({c}) + {step - 1}) div {step} * {step}")
    after = used.withColumn("_r", reach).select(by, up("_r").alias("place"), F.coalesce(F.lead("start").over(w), F.lit(limit)).alias("free_to"))
    before = used.groupBy(by).agg(F.min("start").alias("free_to")).select(by, F.lit(0).cast("bigint").alias("place"), "free_to")
    fits = after.unionByName(before).withColumn("_ok", F.col("place") + size <= F.least("free_to", F.lit(limit)))
    return fits.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("_ok"), F.col("place"))), F.lit(-1)).cast("bigint").alias("place"))


# ---- geometry

def swizzled(x: Column, y: Column, width: int, panel: int = 32) -> Column:
    """Place of a screen's cell when 32 x 32 panels are stored one after another."""
    across = width // panel
    return (div(y, panel) * across + div(x, panel)) * (panel * panel) + (y % panel) * panel + x % panel


def unswizzled(place: Column, width: int, panel: int = 32) -> tuple[Column, Column]:
    """(x, y) of a cell stored at ``place`` in panels: the inverse of ``swizzled``."""
    across, size = width // panel, panel * panel
    n, within = div(place, size), place % size
    return n % across * panel + within % panel, div(n, across) * panel + div(within, panel)


def guessed_width(n: Column) -> Column:
    """32 if that divides n, else the larger of the factors that are nearest each other."""
    low = F.array_max(F.filter(F.sequence(F.lit(1).cast("bigint"), F.floor(F.sqrt(n.cast("double")))), lambda k: n % k == 0))
    return F.when(n % 32 == 0, F.lit(32).cast("bigint")).otherwise(div(n, low))


def power_of_two(n: Column) -> Column:
    """The next power of two, 8 at least, of any n up to 2^62; a null counts as 8."""
    bits = F.length(F.bin(n.cast("bigint") - 1))
    return F.when(n > 8, F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)).otherwise(F.lit(8).cast("bigint"))


def flipped(px: DataFrame, across: bool, down: bool, by: str = "img") -> DataFrame:
    """Pixels mirrored within each image's bounds."""
    size = px.groupBy(by).agg(F.max("x").alias("_w"), F.max("y").alias("_h"))
    x = F.col("_w") - F.col("x") if across else F.col("x")
    y = F.col("_h") - F.col("y") if down else F.col("y")
    return px.join(size, by).withColumns({"x": x, "y": y}).drop("_w", "_h")


def cropped(px: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return px.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def area_scaled(px: DataFrame, width: int, height: int, out_w: int, out_h: int, by: str = "img") -> DataFrame:
    """(img, x, y, r, g, b, a): each new pixel the mean, by covered area and opacity, of those below it.

    Every pixel names the few new ones that it touches; one grouping adds them up. Halves round up.
    """
    def touched(c: str, old: int, new: int) -> Column:
        first, last = F.expr(f"{c} * {new} div {old}"), F.expr(f"({c} * {new} + {new} - 1) div {old}")
        return F.explode(F.sequence(first, last))

    def share(c: str, t: str, old: int, new: int) -> Column:
        return F.least((F.col(c) + 1) * new, (F.col(t) + 1) * old) - F.greatest(F.col(c) * new, F.col(t) * old)

    p = px.withColumn("u", touched("x", width, out_w)).withColumn("v", touched("y", height, out_h))
    p = p.withColumn("s", share("x", "u", width, out_w) * share("y", "v", height, out_h)).where("s > 0")
    mean = lambda c: F.coalesce(F.expr(f"(2 * sum(s * a * {c}) + sum(s * a)) div nullif(2 * sum(s * a), 0)"), F.lit(0).cast("bigint")).alias(c)
    return p.groupBy(by, F.col("u").alias("x"), F.col("v").alias("y")).agg(mean("r"), mean("g"), mean("b"), F.expr("(2 * sum(s * a) + sum(s)) div (2 * sum(s))").alias("a"))


def fitted(px: DataFrame, width: int, height: int, out_w: int, out_h: int, cover: bool, by: str = "img") -> DataFrame:
    """(img, x, y, r, g, b, a): images scaled with their proportions kept, centred: to cover all of a frame, or to fit into it.

    What lies outside the frame goes; cells that nothing reaches aren't given.
    """
    options = ((out_w, height * out_w // width), (width * out_h // height, out_h))
    w, h = (max if cover else min)(options)
    dx, dy = int((w - out_w) / 2), int((h - out_h) / 2)
    moved = area_scaled(px, width, height, w, h, by).withColumns({"x": F.col("x") - dx, "y": F.col("y") - dy})
    return moved.where(F.col("x").between(0, out_w - 1) & F.col("y").between(0, out_h - 1))


#: Rectangles of a cell, and glyphs of a font, that are carried to the other side; more are joined by shuffle.
RECTANGLES, GLYPHS = 1024, 65536


def owner(px: DataFrame, rects: DataFrame, by: str = "img") -> DataFrame:
    """(img, x, y, rect): the first rectangle (id, x0, y0, w, h) that holds each pixel; -1 if none."""
    from .lookup import within

    rects = within(rects, RECTANGLES)
    inside = (px["x"] >= rects["x0"]) & (px["x"] < rects["x0"] + rects["w"]) & (px["y"] >= rects["y0"]) & (px["y"] < rects["y0"] + rects["h"])
    return px.join(rects, inside, "left").groupBy(by, "x", "y").agg(F.coalesce(F.min("id"), F.lit(-1)).cast("bigint").alias("rect"))


def line_widths(messages: DataFrame, glyphs: DataFrame, keys: list[str], text: str, default: int) -> DataFrame:
    """(*keys, width): glyph widths of a text added up; characters without a glyph have the default's.

    Characters are counted within each message first, so that a message's letters, not its length, meet the font.
    """
    from .lookup import within

    chars = messages.select(*keys, F.explode(F.split(text, "")).alias("c")).where("c <> ''").groupBy(*keys, "c").agg(F.count("*").alias("n"))
    wide = chars.join(within(glyphs, GLYPHS), "c", "left")
    return wide.groupBy(*keys).agg(F.sum(F.col("n") * F.coalesce("w", F.lit(default))).alias("width"))


def flood(px: DataFrame, x: int, y: int, by: str = "img") -> DataFrame:
    """(img, x, y): the 4-connected region of equal value around (x, y) in each image.

    One image a group; within it a stack. Images have a bounded size by the format.
    """
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        value = dict(zip(zip(pdf["x"], pdf["y"], strict=True), pdf["idx"], strict=True))
        todo, seen = [(x, y)] if (x, y) in value else [], set()
        while todo:
            p = todo.pop()
            if p in seen or value.get(p) != value[x, y]:
                continue
            seen.add(p)
            todo += [(p[0] + dx, p[1] + dy) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        return pd.DataFrame(sorted((pdf[by].iloc[0], *p) for p in seen), columns=[by, "x", "y"]).astype("int64")

    return px.select(by, "x", "y", "idx").groupBy(by).applyInPandas(one, f"{by} long, x long, y long")


def covering(px: DataFrame, by: str = "img") -> DataFrame:
    """(img, k, x, y, w, h): object-sized rectangles, large before small, that cover an image's opaque pixels.

    Greedy over a grid of 8: at each place the size that covers most opaque cells not yet covered
    with the least waste; one image a group.
    """
    import numpy as np
    import pandas as pd

    from ..functions.packed import HEIGHTS, WIDTHS

    sizes = sorted({(w, h) for ws, hs in zip(WIDTHS, HEIGHTS, strict=True) for w, h in zip(ws, hs, strict=True)}, key=lambda s: -s[0] * s[1])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        solid = pdf[pdf["a"] >= 128]
        out = []
        if len(solid):
            x0, y0 = int(solid["x"].min()), int(solid["y"].min())
            grid = np.zeros(((int(solid["y"].max()) - y0) // 8 + 9, (int(solid["x"].max()) - x0) // 8 + 9), bool)
            grid[(solid["y"] - y0) // 8, (solid["x"] - x0) // 8] = True
            for w, h in sizes:
                cells = w * h // 64
                for r in range(grid.shape[0] - h // 8 + 1):
                    for c in range(grid.shape[1] - w // 8 + 1):
                        part = grid[r : r + h // 8, c : c + w // 8]
                        if part.any() and part.sum() * 4 >= cells * 3:
                            out.append((x0 + c * 8, y0 + r * 8, w, h))
                            part[:] = False
        out.sort(key=lambda s: (s[1], s[0]))
        return pd.DataFrame([(pdf[by].iloc[0], k, *s) for k, s in enumerate(out)], columns=[by, "k", "x", "y", "w", "h"]).astype("int64")

    return px.select(by, "x", "y", "a").groupBy(by).applyInPandas(one, f"{by} long, k long, x long, y long, w long, h long")


def affine_inverse(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, ...]:
    """The inverse of a 2 x 2 matrix; what has none is the largest that the format can hold."""
    det = a * d - b * c
    safe = F.when(det == 0, 1.0).otherwise(det)
    lost = F.lit(127.99609375)
    pick = lambda v, zero: F.when(det == 0, zero).otherwise(v / safe)
    return pick(d, lost), pick(-b, F.lit(0.0)), pick(-c, F.lit(0.0)), pick(a, lost)


def neighbour_chain(colors: list[tuple[float, float, float]]) -> list[int]:
    """Order of a palette in which each colour is the nearest left to the last: the shortest over all starts.

    For one palette, 256 colours at most. The metric weighs the parts by ``YUV_WEIGHTS``.
    """
    import numpy as np

    from ..functions.color import YUV_WEIGHTS

    p = np.array(colors, float)
    d = ((p[:, None] - p[None]) ** 2 * np.array(YUV_WEIGHTS)[: p.shape[1]]).sum(-1) if len(p) else np.zeros((0, 0))
    best, order = np.inf, []
    for start in range(len(p)):
        left, at, total, path = np.ones(len(p), bool), start, 0.0, [start]
        left[start] = False
        while left.any() and total < best:
            k = int(np.where(left, d[at], np.inf).argmin())
            total += d[at, k]
            left[k] = False
            at = k
            path.append(k)
        if not left.any() and total < best:
            best, order = total, path
    return order
