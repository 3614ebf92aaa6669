"""Colour reduction: weighted histograms, splits, Lloyd iteration, nearest-colour assignment.

Palettes have at most 256 entries, by the format; assignment carries them as an array literal or a
checked broadcast, so that pixels are never shuffled to meet them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import YIQ, distance, from_yiq, yiq

CLUSTERS = 256
#: Colours of a bank of palettes.
BANK = 256


def with_yiq(px: DataFrame) -> DataFrame:
    """Pixels taken as opaque, with y, i and q."""
    y, i, q, _ = yiq(F.col("r"), F.col("g"), F.col("b"), F.lit(255))
    return px.withColumns({"cy": y, "ci": i, "cq": q})


def edge_weights(px: DataFrame, by: str = "img") -> DataFrame:
    """Pixels with ``weight``: 16 less an eighth of how far the step to the four neighbours is from 16.

    Borders repeat themselves; weights are at least 1; pixels of opacity under 128 weigh 0. The
    neighbour below is the one below, not the one diagonally below it.
    """
    p = with_yiq(px)
    row, column = Window.partitionBy(by, "y").orderBy("x"), Window.partitionBy(by, "x").orderBy("y")
    around = [F.coalesce(fn("cy").over(w), F.col("cy")) for w in (row, column) for fn in (F.lag, F.lead)]
    step = F.abs(F.col("cy") - sum(around[1:], around[0]) * 0.25)
    weight = F.greatest(F.lit(16.0) - F.abs(F.lit(16.0) - step) / 8.0, F.lit(1.0))
    return p.withColumn("weight", F.when(F.col("a") < 128, 0.0).otherwise(weight))


def histogram(px: DataFrame, weight: Column | None = None) -> DataFrame:
    """(r, g, b, w): weights of equal colours added up, those without weight left out."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    return px.groupBy("r", "g", "b").agg(F.sum(w).alias("w")).where("w > 0")


def top_colors(hist: DataFrame, n: int) -> DataFrame:
    """The n heaviest colours, the smaller colour first at ties."""
    return hist.orderBy(F.desc("w"), "r", "g", "b").limit(n)


#: Distances are told apart to this many parts of one.
PARTS = 1_000_000


def nearest(px: DataFrame, palette: list[tuple[int, int, int, int]], w: tuple[int, int, int] = (20, 20, 20)) -> tuple[Column, Column]:
    """(index, distance) of the nearest of (idx, r, g, b) to the row's cy, ci, cq; the lowest index at ties.

    A candidate is one whole number, its distance in PARTS above its place among the ascending
    indices, so that the least of numbers is the nearest.
    """
    if len(palette) > CLUSTERS:
        raise ValueError(f"a palette has up to {CLUSTERS} colours")
    own = sorted(palette)
    keys = []
    for place, (_, r, g, b) in enumerate(own):
        y, i, q = (k[0] * r + k[1] * g + k[2] * b for k in YIQ)
        d = distance((F.col("cy"), F.col("ci"), F.col("cq")), (F.lit(y), F.lit(i), F.lit(q)), w)
        keys.append(F.floor(d * PARTS + 0.5) * CLUSTERS + place)
    best = F.least(*keys) if len(keys) > 1 else keys[0]
    place = (best % CLUSTERS + 1).cast("int")
    return F.element_at(F.array(*(F.lit(x[0]).cast("bigint") for x in own)), place), F.floor(best / CLUSTERS) / PARTS


def palette_rows(palette: DataFrame) -> list[tuple[int, int, int, int]]:
    """(idx, r, g, b) on the driver: 256 at most, which is checked."""
    rows = palette.select("idx", "r", "g", "b").orderBy("idx").limit(CLUSTERS + 1).collect()
    if len(rows) > CLUSTERS:
        raise ValueError(f"a palette has up to {CLUSTERS} colours")
    return [tuple(r) for r in rows]


def palette_error(hist: DataFrame, palette: list[tuple[int, int, int, int]]) -> DataFrame:
    """(error): weighted distances of all colours to their nearest entries."""
    _, d = nearest(hist, palette)
    return with_yiq(hist).select((d * F.col("w")).alias("e")).agg(F.sum("e").alias("error"))


def image_errors(px: DataFrame, palette: list[tuple[int, int, int, int]], by: str = "img") -> DataFrame:
    """(img, error, worst): distances of each image's opaque pixels to their nearest entries, added up, and the largest."""
    p = with_yiq(px.where("a >= 128"))
    return p.select(by, nearest(p, palette)[1].alias("d")).groupBy(by).agg(F.sum("d").alias("error"), F.max("d").alias("worst"))


def moments(hist: DataFrame) -> DataFrame:
    """Weighted means and covariances of y, i and q, in one pass."""
    p = with_yiq(hist)
    names = ("cy", "ci", "cq")
    total = F.sum("w")
    sums = {n: F.sum(F.col("w") * F.col(n)) / total for n in names}
    pairs = {a + b: F.sum(F.col("w") * F.col(a) * F.col(b)) / total - sums[a] * sums[b] for k, a in enumerate(names) for b in names[k:]}
    return p.agg(total.alias("w"), *(v.alias("mean_" + n) for n, v in sums.items()), *(v.alias("cov_" + n) for n, v in pairs.items()))


def principal_axis(hist: DataFrame) -> tuple[float, float, float]:
    """The direction of greatest variance, its first part not negative: nine sums reach the driver."""
    m = moments(hist).first()
    c = np.array([[m["cov_" + min(a, b, key=("cy", "ci", "cq").index) + max(a, b, key=("cy", "ci", "cq").index)] for b in ("cy", "ci", "cq")] for a in ("cy", "ci", "cq")], float)
    values, vectors = np.linalg.eigh(c)
    axis = vectors[:, values.argmax()]
    return tuple((axis if axis[0] >= 0 else -axis).tolist())


def principal_order(hist: DataFrame) -> DataFrame:
    """Colours with ``score``, how far along the direction of greatest variance they lie, and ``place`` in that order."""
    axis = principal_axis(hist)
    p = with_yiq(hist).withColumn("score", sum((F.col(n) * k for n, k in zip(("cy", "ci", "cq"), axis, strict=True)), F.lit(0.0)))
    return p.withColumn("place", (F.row_number().over(Window.orderBy("score", "r", "g", "b")) - 1).cast("bigint"))


def by_lightness(palettes: DataFrame) -> DataFrame:
    """(pal, place): palettes (pal, r, g, b, a) by their mean lightness, opacity weighing; those without any come first."""
    y, _, _, a = yiq(F.col("r"), F.col("g"), F.col("b"), F.col("a"))
    sums = palettes.groupBy("pal").agg(F.sum(y).alias("y"), F.sum(a).alias("a"))
    light = F.when(F.col("a") > 0, F.round(F.col("y") / F.col("a"), 6))
    return sums.select("pal", (F.row_number().over(Window.orderBy(light.asc_nulls_first(), "pal")) - 1).cast("bigint").alias("place"))


def layered_distance(rows: DataFrame, keys: list[str], d: Column) -> DataFrame:
    """(*keys, d): distances of colours with a value a layer, added up over the layers."""
    return rows.groupBy(*keys).agg(F.sum(d).alias("d"))


def closest_palettes(colors: DataFrame, uses: DataFrame) -> DataFrame:
    """(file, p, q, d): in each file the two palettes of one type that are least missed if made one, the first at ties.

    ``colors`` has (file, pal, pos, r, g, b), ``uses`` (file, pal, type, n): the difference of the colours,
    place by place, times the uses of both. Palettes meet within their file alone.
    """
    c = with_yiq(colors).select("file", "pal", "pos", "cy", "ci", "cq").join(uses, ["file", "pal"])
    a, b = c.alias("a"), c.alias("b")
    meet = (F.col("a.file") == F.col("b.file")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.pos") == F.col("b.pos")) & (F.col("a.pal") < F.col("b.pal"))
    d = distance(*(tuple(F.col(f"{s}.{n}") for n in ("cy", "ci", "cq")) for s in "ab"))
    pairs = a.join(b, meet).groupBy(F.col("a.file").alias("file"), F.col("a.pal").alias("p"), F.col("b.pal").alias("q"), (F.col("a.n") + F.col("b.n")).alias("n")).agg(F.sum(d).alias("d"))
    best = pairs.groupBy("file").agg(F.min(F.struct(F.round(F.col("d") * F.col("n"), 4).alias("d"), "p", "q")).alias("m"))
    return best.select("file", "m.p", "m.q", "m.d")


def best_split(hist: DataFrame, score: Column) -> DataFrame:
    """(gain, wl, n): the split of colours in order of ``score`` that lessens the weighted squared error most.

    Prefix sums run by window over the histogram of one image; colours, not pixels, are ordered.
    """
    p = with_yiq(hist).withColumn("s", score)
    w = Window.orderBy("s", "r", "g", "b")
    left = w.rowsBetween(Window.unboundedPreceding, 0)
    names = ("cy", "ci", "cq")
    p = p.withColumns({"wl": F.sum("w").over(left), "n": F.row_number().over(w).cast("bigint"), **{n + "l": F.sum(F.col("w") * F.col(n)).over(left) for n in names}})
    total = hist.agg(F.sum("w").alias("wt"))
    sums = with_yiq(hist).agg(*(F.sum(F.col("w") * F.col(n)).alias(n + "t") for n in names))
    p = p.join(F.broadcast(total)).join(F.broadcast(sums)).where("wl < wt")  # one row each
    square = lambda f: sum((f(n) * f(n) for n in names), F.lit(0.0))
    gain = square(lambda n: F.col(n + "l")) / F.col("wl") + square(lambda n: F.col(n + "t") - F.col(n + "l")) / (F.col("wt") - F.col("wl")) - square(lambda n: F.col(n + "t")) / F.col("wt")
    return p.select(F.round(gain, 4).alias("gain"), "wl", "n").orderBy(F.desc("gain"), "n").limit(1)


def lloyd_step(hist: DataFrame, palette: list[tuple[int, int, int, int]]) -> DataFrame:
    """(idx, w, y, i, q): each cluster's weight and mean after one assignment; empty clusters are left out."""
    p = with_yiq(hist)
    idx, _ = nearest(p, palette)
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    return p.withColumn("idx", idx).groupBy("idx").agg(F.sum("w").alias("w"), mean("cy").alias("y"), mean("ci").alias("i"), mean("cq").alias("q"))


def create_palette(hist: DataFrame, n: int, rounds: int = 8, pinned: list[tuple[int, int, int]] | None = None, reserve: int = 0) -> list[tuple[int, int, int, int]]:
    """(idx, r, g, b): up to n colours for a histogram, darkest first.

    ``pinned`` colours are among them as they are, and come first; the others are chosen for what lies
    nearer to them. ``reserve`` indices stay free before all.

    Divisive: the cluster whose best split along its principal axis lessens the error most is split
    until there are n; then Lloyd iterations, each one grouped sum over the histogram, move the
    means; a cluster that empties takes the colour with the greatest error. The division works on a
    histogram reduced to 5 bits a channel, which has 32,768 rows at most however large the image.
    """
    small = hist.groupBy(*(F.expr(f"({c} div 8) * 8 + 4").alias(c) for c in "rgb")).agg(F.sum("w").alias("w"))
    rows = small.orderBy("r", "g", "b").limit(32768).toPandas()
    if not len(rows):
        return []
    rgb = rows[["r", "g", "b"]].to_numpy(float)
    x, w = rgb @ np.array(YIQ).T, rows["w"].to_numpy(float)
    own = [tuple(c) for c in pinned or []][:n]
    if own:  # the division leaves out what a pinned colour hits
        far = ((x[:, None] - (np.array(own, float) @ np.array(YIQ).T)[None]) ** 2).sum(-1).min(1) > 0
        x, w = x[far], w[far]
    to_rgb = np.linalg.inv(np.array(YIQ)).T
    means = divide(x, w, n - len(own)) if len(x) and n > len(own) else np.zeros((0, 3))
    palette = [(k, *c) for k, c in enumerate([*own, *(tuple(np.clip(np.floor(m @ to_rgb + 0.5), 0, 255).astype(int).tolist()) for m in means)])]
    for _ in range(rounds):
        found = {r["idx"]: (r["y"], r["i"], r["q"]) for r in lloyd_step(hist, palette).collect()}  # 256 rows at most
        new = [(k, *np.clip(np.floor(np.array(found[k]) @ to_rgb + 0.5), 0, 255).astype(int).tolist()) if k in found and k >= len(own) else old for k, old in enumerate(palette)]
        if new == palette:
            break
        palette = new
    unique = sorted({p[1:] for p in palette[len(own) :]} - set(own), key=lambda c: (sum(k * v for k, v in zip(YIQ[0], c, strict=True)), c))
    return [(reserve + k, *c) for k, c in enumerate([*own, *unique])]


def divide(x: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Means of up to n clusters of weighted points, split along principal axes where the error falls most."""
    def cut(own: np.ndarray):
        if len(own) < 2:
            return 0.0, None
        p, v = x[own], w[own]
        mean = np.average(p, axis=0, weights=v)
        _, vectors = np.linalg.eigh(np.cov(p.T, aweights=v, ddof=0) if len(own) > 1 else np.eye(p.shape[1]))
        order = np.argsort((p - mean) @ vectors[:, -1], kind="stable")
        cw, cs = np.cumsum(v[order])[:-1], np.cumsum(v[order, None] * p[order], axis=0)[:-1]
        tw, ts = v.sum(), (v[:, None] * p).sum(axis=0)
        gain = (cs**2).sum(axis=1) / cw + ((ts - cs) ** 2).sum(axis=1) / (tw - cw) - (ts**2).sum() / tw
        k = int(gain.argmax())
        return float(gain[k]), (own[order[: k + 1]], own[order[k + 1 :]])

    parts = [(*cut(np.arange(len(x))), np.arange(len(x)))]
    while len(parts) < n:
        k = max(range(len(parts)), key=lambda i: parts[i][0])
        if parts[k][0] <= 1e-9:
            break
        _, (a, b), _ = parts.pop(k)
        parts += [(*cut(a), a), (*cut(b), b)]
    return np.stack([np.average(x[own], axis=0, weights=w[own]) for _, _, own in parts])


def indexed(px: DataFrame, palette: list[tuple[int, int, int, int]]) -> DataFrame:
    """(img, x, y, idx): nearest entries without diffusion."""
    p = with_yiq(px)
    return p.select("img", "x", "y", nearest(p, palette)[0].alias("idx"))


def diffused(px: DataFrame, palette: list[tuple[int, int, int, int]], amount: float = 1.0) -> DataFrame:
    """(img, x, y, idx): serpentine error diffusion, 7, 3, 5 and 1 sixteenths; one image a group, as each pixel needs the last."""
    import pandas as pd

    yiqs = np.array([[sum(k * v for k, v in zip(row, p[1:], strict=True)) for row in YIQ] for p in palette])
    ids = np.array([p[0] for p in palette], np.int64)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf["x"].max()) + 1, int(pdf["y"].max()) + 1
        plane, there, out = np.zeros((h, w, 3)), np.zeros((h, w), bool), np.zeros((h, w), np.int64)
        plane[pdf["y"], pdf["x"]] = pdf[["r", "g", "b"]].to_numpy(float) @ np.array(YIQ).T
        there[pdf["y"], pdf["x"]] = True
        for y in range(h):
            step = 1 if y % 2 == 0 else -1
            for x in range(w)[::step]:
                if not there[y, x]:
                    continue
                k = int(((yiqs - plane[y, x]) ** 2).sum(axis=1).argmin())
                out[y, x] = ids[k]
                error = (plane[y, x] - yiqs[k]) * amount
                for dx, dy, part in ((step, 0, 7), (-step, 1, 3), (0, 1, 5), (step, 1, 1)):
                    if 0 <= x + dx < w and y + dy < h:
                        plane[y + dy, x + dx] += error * part / 16
        return pd.DataFrame({"img": pdf["img"], "x": pdf["x"], "y": pdf["y"], "idx": out[pdf["y"], pdf["x"]]})

    return px.select("img", "x", "y", "r", "g", "b").groupBy("img").applyInPandas(one, "img long, x long, y long, idx long")


def palette_distances(palettes: DataFrame) -> DataFrame:
    """(p, q, d): for each ordered pair of palettes (pal, r, g, b) of a bank, the sum of each colour's distance to the other's nearest.

    A bank has at most 16 palettes of 16 colours, by the format; more raise.
    """
    if palettes.limit(BANK + 1).count() > BANK:
        raise ValueError(f"a bank has up to {BANK} colours")
    c = with_yiq(palettes)
    a, b = c.alias("a"), c.alias("b")
    d = distance(tuple(F.col("a." + n) for n in ("cy", "ci", "cq")), tuple(F.col("b." + n) for n in ("cy", "ci", "cq")))
    near = a.join(F.broadcast(b), F.col("a.pal") != F.col("b.pal")).groupBy(F.col("a.pal").alias("p"), F.col("b.pal").alias("q"), F.col("a.r"), F.col("a.g"), F.col("a.b")).agg(F.min(d).alias("d"))
    return near.groupBy("p", "q").agg(F.round(F.sum("d"), 4).alias("d"))


def round_trip(px: DataFrame) -> DataFrame:
    """Pixels through y, i, q and back."""
    y, i, q, a = yiq(F.col("r"), F.col("g"), F.col("b"), F.lit(255.0))
    back = from_yiq(y, i, q, a)
    return px.select("img", "x", "y", *(c.alias(n) for c, n in zip(back[:3], "rgb", strict=True)))
