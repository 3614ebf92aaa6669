"""One query for each operator, over relations that are derived from the driver's tables.

The inputs are synthetic encodings of those tables, not assets. Every query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import packed as P
from ..operators import aggregate as A
from ..operators import dedup as D
from ..operators import lookup as L
from ..operators import quantize as Q
from ..operators import sequence as S
from . import relations as R
from .registry import query
from .relations import sql

c = F.col
BIG = "bigint"


# ------------------------------------------------------------------ lookups

@query("palette_usage", sql("tile_dup screen_cell palette", """
SELECT p.idx AS idx, count(*) AS n FROM screen_cell s JOIN tile_dup t ON s.raw % 1024 = t.tile_no JOIN palette p ON p.idx = (s.raw // 4096) * 16 + t.idx GROUP BY p.idx"""))
def palette_usage(spark, d):
    return L.palette_usage(R.screen_cell(spark, d), R.tile_dup(spark), R.palette(spark, d)).select("idx", c("n").cast(BIG))


_RENDER = """
WITH g AS (SELECT cell, p AS pos, raw % 1024 AS ch, (raw // 4096) % 16 AS pal, xor(p, CASE (raw // 1024) % 4 WHEN 0 THEN 0 WHEN 1 THEN 7 WHEN 2 THEN 56 ELSE 63 END) AS src FROM screen_cell, range(64) b(p)),
j AS (SELECT g.cell, g.pos, t.idx AS px, p.color FROM g LEFT JOIN tile_dup t ON t.tile_no = g.ch AND t.pos = g.src LEFT JOIN palette p ON p.idx = g.pal * 16 + coalesce(t.idx, 0))
"""


@query("render_screen", sql("tile_dup screen_cell palette", _RENDER + "SELECT pos, sum(CASE WHEN px IS NULL OR px = 0 THEN 0 ELSE coalesce(color, 0) END) AS total, count(*) AS n FROM j GROUP BY pos"))
def render_screen(spark, d):
    px = L.render_cells(R.screen_cell(spark, d), R.tile_dup(spark), R.palette(spark, d))
    return px.groupBy("pos").agg(F.sum("color").alias("total"), F.count("*").alias("n"))


@query("missing_tiles", sql("tile_dup screen_cell", "SELECT raw % 1024 AS char, count(*) AS n FROM screen_cell WHERE raw % 1024 NOT IN (SELECT tile_no FROM tile_dup) GROUP BY raw % 1024"))
def missing_tiles(spark, d):
    known = R.tile_dup(spark).select(c("tile_no").alias("char")).distinct()
    return L.cell_fields(R.screen_cell(spark, d)).join(L.within(known), "char", "left_anti").groupBy("char").agg(F.count("*").alias("n"))


@query("render_opaque", sql("tile_dup screen_cell palette", _RENDER + "SELECT cell, sum(CASE WHEN px IS NULL THEN 0 ELSE coalesce(color, 0) END) AS total FROM j GROUP BY cell"))
def render_opaque(spark, d):
    px = L.render_cells(R.screen_cell(spark, d), R.tile_dup(spark), R.palette(spark, d), transparent=False)
    return px.groupBy("cell").agg(F.sum("color").alias("total"))


@query("vram_remap", """
WITH a AS (SELECT o_orderkey AS id, (o_custkey * 97) % 65536 AS addr FROM orders),
t AS (SELECT p_partkey * 640 AS dst, 300000 + p_partkey * 1000 AS src, 8 * p_size AS size FROM part),
h AS (SELECT a.id, arg_min(t.src - t.dst, t.dst) AS shift FROM a JOIN t ON a.addr >= t.dst AND a.addr < t.dst + t.size GROUP BY a.id)
SELECT a.id, a.addr, a.addr + coalesce(h.shift, 0) AS mapped FROM a LEFT JOIN h USING (id)""")
def vram_remap(spark, d):
    a = R.table(spark, d, "orders").selectExpr("o_orderkey AS id", "(o_custkey * 97) % 65536 AS addr")
    t = R.table(spark, d, "part").selectExpr("p_partkey * 640 AS dst", "300000 + p_partkey * 1000 AS src", "8 * p_size AS size")
    return L.remap(a, t)


@query("frame_cells", sql("anim_frame", "SELECT f.seq, f.frame_no, n.n_name AS name FROM anim_frame f JOIN (SELECT n_nationkey, n_name FROM nation) n ON f.cell = n.n_nationkey"))
def frame_cells(spark, d):
    n = R.table(spark, d, "nation").select(c("n_nationkey").alias("cell"), c("n_name").alias("name"))
    return R.anim_frame(spark, d).join(L.within(n), "cell").select("seq", "frame_no", "name")


@query("node_frames", sql("anim_frame", """
WITH f AS (SELECT seq, list(cell ORDER BY frame_no) AS cells FROM anim_frame GROUP BY seq)
SELECT o_orderkey AS node, o_custkey AS mc, coalesce(f.cells[o_orderkey % len(f.cells) + 1], -1) AS cell FROM orders LEFT JOIN f ON o_custkey = f.seq"""))
def node_frames(spark, d):
    """Every node's current frame's cell: nodes of one sequence stand at different frames."""
    f = R.anim_frame(spark, d)
    size = f.groupBy("seq").agg(F.count("*").alias("n"))
    nodes = R.table(spark, d, "orders").select(c("o_orderkey").alias("node"), c("o_custkey").alias("mc"))
    at = nodes.join(size.withColumnRenamed("seq", "mc"), "mc", "left").withColumn("frame_no", c("node") % c("n"))
    return at.join(f.select(c("seq").alias("mc"), "frame_no", "cell"), ["mc", "frame_no"], "left").select("node", "mc", F.coalesce("cell", F.lit(-1)).alias("cell"))


@query("guess_palette_names", """
WITH t AS (SELECT p_partkey AS id, substr(p_name, 1, 12) || CAST(p_partkey % 37 AS VARCHAR) AS name, p_partkey % 8 AS fmt, p_size % 20 AS highest FROM part),
p AS (SELECT n_nationkey AS pal, CASE WHEN n_nationkey % 2 = 0 THEN upper(substr(q.p_name, 1, 12)) || CAST(q.p_partkey % 37 AS VARCHAR) ELSE substr(substr(q.p_name, 1, 12) || CAST(q.p_partkey % 37 AS VARCHAR), 1, 13) || '_pl' END AS pal_name, n_nationkey * 7 % 22 + 1 AS n_colors FROM nation JOIN part q ON q.p_partkey = n_nationkey * 3),
x AS (SELECT id, name, lower(name) AS n, pal, pal_name, lower(pal_name) AS q, n_colors <= CASE fmt WHEN 2 THEN 8 WHEN 3 THEN 16 WHEN 5 THEN 1000000 ELSE 256 END AND highest < n_colors AND (fmt <> 5 OR highest + 7 >= n_colors) AS ok FROM t, p WHERE fmt <> 7),
k AS (SELECT id, pal, CASE WHEN q = n THEN 1 WHEN q = substr(n || '_pl', 1, 16) THEN 2 WHEN q = substr(n || '_pl', 1, 15) THEN 3 WHEN q = substr(n, 1, 13) || '_pl' THEN 4 WHEN q = substr(n, 1, 12) || '_pl' THEN 5 END AS rule FROM x),
a AS (SELECT id, arg_min(pal, (rule, pal)) AS pal, min(rule) AS rule FROM k WHERE rule IS NOT NULL GROUP BY id),
v AS (SELECT id, count_if(ok) AS n, arg_min(pal, (levenshtein(name, pal_name), pal)) FILTER (ok) AS pal, min(pal) AS least FROM x WHERE id NOT IN (SELECT id FROM a) GROUP BY id)
SELECT id, CAST(pal AS BIGINT) AS pal, CAST(rule AS BIGINT) AS rule FROM a UNION ALL SELECT id, CAST(coalesce(pal, least) AS BIGINT), CASE n WHEN 0 THEN 8 WHEN 1 THEN 6 ELSE 7 END FROM v""")
def guess_palette_names(spark, d):
    part = R.table(spark, d, "part").selectExpr("p_partkey AS id", "concat(substr(p_name, 1, 12), CAST(p_partkey % 37 AS STRING)) AS name", "p_partkey % 8 AS fmt", "p_size % 20 AS highest")
    n = R.table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS pal", "CAST(n_nationkey * 3 AS BIGINT) AS id", "n_nationkey * 7 % 22 + 1 AS n_colors")
    pal = part.select("id", "name").join(L.within(n), "id").selectExpr("pal", "CASE WHEN pal % 2 = 0 THEN concat(upper(substr(name, 1, 12)), substr(name, 13)) ELSE concat(substr(name, 1, 13), '_pl') END AS pal_name", "n_colors")
    return L.guess_palettes(part, pal)


@query("highest_indices", """
WITH b AS (SELECT o_custkey AS id, o_custkey % 8 AS fmt, o_orderkey % 256 AS byte, o_orderkey * 40503 % 65536 AS word FROM orders),
x AS (SELECT *, CASE fmt WHEN 1 THEN byte % 32 WHEN 2 THEN greatest(byte % 4, byte // 4 % 4, byte // 16 % 4, byte // 64) WHEN 3 THEN greatest(byte % 16, byte // 16) WHEN 4 THEN byte WHEN 5 THEN word % 16384 * 2 + CASE WHEN word // 16384 % 2 = 0 THEN 3 ELSE 1 END WHEN 6 THEN byte % 8 END AS i FROM b)
SELECT id, CAST(CASE WHEN max(fmt) = 7 THEN -1 ELSE coalesce(max(i), 0) END AS BIGINT) AS highest FROM x GROUP BY id""")
def highest_indices(spark, d):
    return L.highest_index(R.table(spark, d, "orders").selectExpr("o_custkey AS id", "o_custkey % 8 AS fmt", "o_orderkey % 256 AS byte", "o_orderkey * 40503 % 65536 AS word"))


@query("name_distance", "SELECT s_suppkey AS id, n_name AS name, levenshtein(upper(s_name), n_name) AS edits FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def name_distance(spark, d):
    n = R.table(spark, d, "nation").select(c("n_nationkey").alias("s_nationkey"), c("n_name").alias("name"))
    return R.table(spark, d, "supplier").join(L.within(n), "s_nationkey").select(c("s_suppkey").alias("id"), "name", F.levenshtein(F.upper("s_name"), "name").cast(BIG).alias("edits"))


@query("sprite_overlaps", sql("sprite", """
WITH o AS (SELECT cell, n AS id, CASE WHEN attr1 % 512 >= 256 THEN attr1 % 512 - 512 ELSE attr1 % 512 END AS x, CASE WHEN attr0 % 256 >= 128 THEN attr0 % 256 - 256 ELSE attr0 % 256 END AS y,
 [8,16,32,64,16,32,32,64,8,8,16,32,8,8,8,8][(attr0 // 16384) * 4 + attr1 // 16384 + 1] * (CASE WHEN (attr0 // 256) % 4 = 3 THEN 2 ELSE 1 END) AS w, [8,16,32,64,8,8,16,32,16,32,32,64,8,8,8,8][(attr0 // 16384) * 4 + attr1 // 16384 + 1] * (CASE WHEN (attr0 // 256) % 4 = 3 THEN 2 ELSE 1 END) AS h FROM sprite)
SELECT a.cell, a.id AS a, b.id AS b FROM o a JOIN o b ON a.cell = b.cell AND a.id < b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h"""))
def sprite_overlaps(spark, d):
    return L.overlapping(A.sprite_rects(R.sprite(spark, d)).withColumnRenamed("n", "id"), "cell")


@query("hit_test", """
WITH r AS (SELECT p_partkey // 20 AS g, p_partkey % 20 AS id, p_size * 3 AS x, (p_partkey * 7) % 100 AS y, 20 + p_size AS w, 30 AS h FROM part),
p AS (SELECT o_orderkey AS pid, o_orderkey % 50 AS g, o_custkey % 200 AS px, (o_orderkey * 13) % 130 AS py FROM orders)
SELECT p.pid, coalesce(max(r.id), -1) AS hit FROM p LEFT JOIN r ON p.g = r.g AND px >= x AND px < x + w AND py >= y AND py < y + h GROUP BY p.pid""")
def hit_test(spark, d):
    r = R.table(spark, d, "part").selectExpr("p_partkey div 20 AS g", "p_partkey % 20 AS id", "p_size * 3 AS x", "(p_partkey * 7) % 100 AS y", "20 + p_size AS w", "30 AS h")
    p = R.table(spark, d, "orders").selectExpr("o_orderkey AS pid", "o_orderkey % 50 AS g", "o_custkey % 200 AS px", "(o_orderkey * 13) % 130 AS py")
    return L.hit_test(p, r, "g")


@query("insert_textures", """
WITH a AS (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'twice' ELSE s_name END AS name FROM supplier),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM b WHERE name NOT IN (SELECT name FROM a))
SELECT id, name FROM a UNION ALL SELECT id, name FROM n WHERE k = 1""")
def insert_textures(spark, d):
    s = R.table(spark, d, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"))
    return L.insert_absent(s.where("id % 2 = 0"), s.withColumn("name", F.when(c("id") % 3 == 0, "twice").otherwise(c("name"))), "name")


@query("merge_palettes", """
WITH o AS (SELECT p_partkey AS k, [p_size, p_size + 1, p_partkey % 3] AS a FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN [p_size] WHEN p_partkey % 5 = 1 THEN [p_size, p_size + 1, p_partkey % 3, 9] ELSE [p_size, p_size + 2] END AS b FROM part WHERE p_partkey % 7 <> 0),
j AS (SELECT coalesce(o.k, n.k) AS k, a, b, a[1:least(len(a), len(b))] = b[1:least(len(a), len(b))] AS ok FROM o FULL JOIN n ON o.k = n.k)
SELECT k AS name, array_to_string(CASE WHEN b IS NULL OR NOT ok OR len(a) >= len(b) THEN coalesce(a, b) ELSE b END, ',') AS colors, coalesce(NOT ok, false) AS conflict FROM j""")
def merge_palettes(spark, d):
    p = R.table(spark, d, "part")
    o = p.where("p_partkey % 3 <> 0").selectExpr("p_partkey AS name", "array(CAST(p_size AS BIGINT), p_size + 1L, p_partkey % 3) AS colors")
    n = p.where("p_partkey % 7 <> 0").selectExpr("p_partkey AS name", "CASE WHEN p_partkey % 5 = 0 THEN array(CAST(p_size AS BIGINT)) WHEN p_partkey % 5 = 1 THEN array(CAST(p_size AS BIGINT), p_size + 1L, p_partkey % 3, 9L) ELSE array(CAST(p_size AS BIGINT), p_size + 2L) END AS colors")
    return L.merge_prefixed(o, n).select("name", F.array_join(c("colors").cast("array<string>"), ",").alias("colors"), "conflict")


@query("tile_last_palette", sql("sprite", "WITH s AS (SELECT obj, attr2 // 4096 AS pal, attr2 % 1024 AS a, [8,16,32,64,16,32,32,64,8,8,16,32,8,8,8,8][(attr0 // 16384) * 4 + attr1 // 16384 + 1] * [8,16,32,64,8,8,16,32,16,32,32,64,8,8,8,8][(attr0 // 16384) * 4 + attr1 // 16384 + 1] // 64 AS k FROM sprite) SELECT tile, arg_max(pal, obj) AS pal FROM (SELECT obj, pal, unnest(range(a, least(a + k, 1024))) AS tile FROM s) GROUP BY tile"))
def tile_last_palette(spark, d):
    """Every tile that an object spans, not its first alone."""
    o = P.oam(c("attr0"), c("attr1"), c("attr2"))
    s = R.sprite(spark, d).select("obj", o["char"].alias("char"), C.div(o["width"] * o["height"], 64).alias("n"), o["palette"].alias("pal"))
    return L.tile_attributes(s)


@query("nth_member", "SELECT l_orderkey, l_linestatus, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 2")
def nth_member(spark, d):
    m = R.table(spark, d, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return L.nth_of_kind(m, "l_orderkey", "l_linestatus", "o", 1).select("l_orderkey", "l_linestatus", "l_partkey", "l_suppkey", "l_linenumber")


@query("palette_permutation", sql("palette", "SELECT p.idx, (p.idx * 5 + 3) % 256 AS moved, q.color AS color, coalesce(q.idx, -1) AS source FROM palette p LEFT JOIN palette q ON p.idx = (q.idx * 5 + 3) % 256"))
def palette_permutation(spark, d):
    p = R.palette(spark, d)
    q = p.selectExpr("(idx * 5 + 3) % 256 AS idx", "color", "idx AS source")
    return p.select("idx", ((c("idx") * 5 + 3) % 256).alias("moved")).join(q, "idx", "left").select("idx", "moved", "color", F.coalesce("source", F.lit(-1)).alias("source"))


@query("glyph_lookup", """
WITH g AS (SELECT p_partkey AS cp, p_size AS width FROM part WHERE p_partkey BETWEEN 32 AND 220 AND p_partkey % 7 <> 0),
k AS (SELECT doc_id, unicode(ch) AS cp, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * coalesce(width, 5)) AS BIGINT) AS width, CAST(coalesce(sum(n) FILTER (width IS NULL), 0) AS BIGINT) AS missing FROM k LEFT JOIN g USING (cp) GROUP BY doc_id""")
def glyph_lookup(spark, d):
    """Every character's glyph: widths added up, and how many have none. Characters are counted by text before they meet the font."""
    g = R.table(spark, d, "part").where("p_partkey BETWEEN 32 AND 220 AND p_partkey % 7 <> 0").selectExpr("p_partkey AS cp", "CAST(p_size AS BIGINT) AS width")
    t = R.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("doc_id", "ch").agg(F.count("*").alias("n"))
    j = t.select("doc_id", F.ascii("ch").cast(BIG).alias("cp"), "n").join(L.within(g), "cp", "left")
    return j.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum(c("n") * F.coalesce("width", F.lit(5))).alias("width"), F.coalesce(F.sum(F.when(c("width").isNull(), c("n"))), F.lit(0)).alias("missing"))


# ------------------------------------------------------------------ aggregates

def _count_sql(mode):
    a = "255" if mode & 1 else "a"
    a = f"(CASE WHEN {a} < 128 THEN 0 ELSE 255 END)" if mode & 2 else a
    v = f"r + g * 256 + b * 65536 + {a} * 16777216::BIGINT"
    v = v if mode & 4 else f"CASE WHEN {a} = 0 THEN 0 ELSE {v} END"
    v = f"CASE WHEN {a} <> 0 THEN {v} END" if mode & 8 else v
    return sql("pixel", f"SELECT img, count(DISTINCT {v}) AS n FROM pixel GROUP BY img")


for _mode in (0, 1, 2, 4, 8, 10):
    query(f"count_colors_{_mode}", _count_sql(_mode))(lambda spark, d, m=_mode: A.count_colors(R.pixel(spark, d), m))


@query("highest_char", sql("screen_cell", "SELECT coalesce(max(raw % 1024), 0) AS highest FROM screen_cell WHERE raw <> 299"))
def highest_char(spark, d):
    return A.highest_char(R.screen_cell(spark, d), 299)


_TEX = "[0,8,2,4,8,2,8,16][fmt + 1]"
_TEXEL = f"((CASE WHEN fmt = 5 THEN (width + 3) // 4 * 4 ELSE width END) * (CASE WHEN fmt = 5 THEN (height + 3) // 4 * 4 ELSE height END) * {_TEX} // 8)"


@query("texture_sizes", sql("texture", f"SELECT id, {_TEXEL} AS texels, CASE WHEN fmt = 5 THEN {_TEXEL} // 2 ELSE 0 END AS indices FROM texture"))
def texture_sizes(spark, d):
    f = (c("fmt"), c("width"), c("height"))
    return R.texture(spark, d).select("id", P.texel_size(*f).alias("texels"), P.index_size(*f).alias("indices"))


@query("vram_totals", sql("texture", f"WITH s AS (SELECT fmt, {_TEXEL} AS t, CASE WHEN fmt = 5 THEN {_TEXEL} // 2 ELSE 0 END AS i FROM texture) SELECT CAST(sum(t) AS BIGINT) AS texels, CAST(sum(i) AS BIGINT) AS indices, CAST(sum(t + i) AS BIGINT) AS total, CAST(sum(CASE WHEN fmt = 5 THEN t + i ELSE 0 END) AS BIGINT) AS block_total, CAST(sum(CASE WHEN fmt = 5 THEN 0 ELSE t + i END) AS BIGINT) AS other_total, count_if(fmt = 5) AS n_block FROM s"))
def vram_totals(spark, d):
    return A.vram_totals(R.texture(spark, d))


@query("opaque_box", sql("pixel", "SELECT img, coalesce(min(x) FILTER (a >= 128), -1) AS x0, coalesce(min(y) FILTER (a >= 128), -1) AS y0, coalesce(max(x + 1) FILTER (a >= 128), -1) AS x1, coalesce(max(y + 1) FILTER (a >= 128), -1) AS y1 FROM pixel GROUP BY img"))
def opaque_box(spark, d):
    return A.opaque_box(R.pixel(spark, d))


_RECT = """o AS (SELECT obj, cell, n, CASE WHEN attr1 % 512 >= 256 THEN attr1 % 512 - 512 ELSE attr1 % 512 END AS x, CASE WHEN attr0 % 256 >= 128 THEN attr0 % 256 - 256 ELSE attr0 % 256 END AS y,
 [8,16,32,64,16,32,32,64,8,8,16,32,8,8,8,8][(attr0 // 16384) * 4 + attr1 // 16384 + 1] * (CASE WHEN (attr0 // 256) % 4 = 3 THEN 2 ELSE 1 END) AS w, [8,16,32,64,8,8,16,32,16,32,32,64,8,8,8,8][(attr0 // 16384) * 4 + attr1 // 16384 + 1] * (CASE WHEN (attr0 // 256) % 4 = 3 THEN 2 ELSE 1 END) AS h FROM sprite)"""


@query("cell_box", sql("sprite", f"WITH {_RECT} SELECT cell, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM o GROUP BY cell"))
def cell_box(spark, d):
    return A.cell_box(R.sprite(spark, d))


@query("average_color", sql("pixel", "SELECT img, CAST((sum(r) + count(*) // 2) // count(*) AS BIGINT) AS r, CAST((sum(g) + count(*) // 2) // count(*) AS BIGINT) AS g, CAST((sum(b) + count(*) // 2) // count(*) AS BIGINT) AS b FROM pixel GROUP BY img"))
def average_color(spark, d):
    return A.average_color(R.pixel(spark, d))


@query("edge_color", sql("pixel", """
WITH n AS (SELECT *, coalesce(lag(a) OVER rw, 0) AS l, coalesce(lead(a) OVER rw, 0) AS rr, coalesce(lag(a) OVER cl, 0) AS u, coalesce(lead(a) OVER cl, 0) AS dn FROM pixel WINDOW rw AS (PARTITION BY img, y ORDER BY x), cl AS (PARTITION BY img, x ORDER BY y)),
e AS (SELECT img, CASE WHEN a >= 128 AND least(l, rr, u, dn) < 128 THEN r END AS r, CASE WHEN a >= 128 AND least(l, rr, u, dn) < 128 THEN g END AS g, CASE WHEN a >= 128 AND least(l, rr, u, dn) < 128 THEN b END AS b FROM n)
SELECT img, CAST((sum(r) + count(r) // 2) // count(r) AS BIGINT) AS r, CAST((sum(g) + count(g) // 2) // count(g) AS BIGINT) AS g, CAST((sum(b) + count(b) // 2) // count(b) AS BIGINT) AS b FROM e GROUP BY img"""))
def edge_color(spark, d):
    return A.edge_color(R.pixel(spark, d))


@query("transparent_count", sql("pixel", "SELECT img, count_if(a < 128) AS n FROM pixel GROUP BY img"))
def transparent_count(spark, d):
    return A.transparent_count(R.pixel(spark, d))


@query("chars_used", sql("sprite", f"WITH {_RECT}, s AS (SELECT attr2 % 1024 AS a, [8,16,32,64,16,32,32,64,8,8,16,32,8,8,8,8][(attr0 // 16384) * 4 + attr1 // 16384 + 1] * [8,16,32,64,8,8,16,32,16,32,32,64,8,8,8,8][(attr0 // 16384) * 4 + attr1 // 16384 + 1] // 64 AS k FROM sprite) SELECT ch AS char, count(*) AS n FROM (SELECT unnest(range(a, least(a + k, 1024))) AS ch FROM s) GROUP BY ch"))
def chars_used(spark, d):
    return A.chars_used(R.sprite(spark, d))


def _far_sql():
    """Seven boxes, each half the one before; counts within half a box around; the last one's middle."""
    parts = ["px AS (SELECT r, g, b FROM pixel WHERE a >= 128)", "e AS (SELECT i, j, l FROM range(2) u(i), range(2) v(j), range(2) w(l))", "s0 AS (SELECT 0 AS r, 0 AS g, 0 AS b)"]
    for k in range(6):
        h = 128 >> k
        near = " AND ".join(f"px.{ch} >= s.{ch} - {h} AND px.{ch} < s.{ch} + {3 * h}" for ch in "rgb")
        parts.append(f"n{k} AS (SELECT CAST(px.r >= s.r + {h} AS INT) AS i, CAST(px.g >= s.g + {h} AS INT) AS j, CAST(px.b >= s.b + {h} AS INT) AS l, count(*) AS n FROM px, s{k} s WHERE {near} GROUP BY ALL)")
        parts.append(f"s{k + 1} AS (SELECT s.r + i * {h} AS r, s.g + j * {h} AS g, s.b + l * {h} AS b FROM s{k} s, e LEFT JOIN n{k} USING (i, j, l) ORDER BY coalesce(n, 0), i, j, l LIMIT 1)")
    return sql("pixel", "WITH " + ", ".join(parts) + " SELECT CAST(r + 2 AS BIGINT) AS r, CAST(g + 2 AS BIGINT) AS g, CAST(b + 2 AS BIGINT) AS b FROM s6")


@query("farthest_color", _far_sql())
def farthest_color(spark, d):
    return A.farthest_color(R.pixel(spark, d))


@query("longest_runs", sql("byte_seq", """
WITH i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, b ORDER BY pos) AS k FROM byte_seq)
SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, b, k, count(*) AS n FROM i WHERE b <> 0 GROUP BY ALL) GROUP BY doc_id"""))
def longest_runs(spark, d):
    runs = K.coded(_files(spark, d), "bytes", K.longest_run, "long", "longest", ("path",))
    return runs.where("longest IS NOT NULL").select(c("path").cast(BIG).alias("doc_id"), "longest")


@query("event_runs", """
WITH i AS (SELECT user_id, event_id % 3 AS v, event_id - 2 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS z, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS k FROM events)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, v, k, count(*) AS n FROM i WHERE v <> 0 GROUP BY ALL) GROUP BY user_id""")
def event_runs(spark, d):
    return A.longest_runs(R.table(spark, d, "events").selectExpr("user_id", "event_id", "event_id % 3 AS v"), "user_id", "event_id", "v")


@query("byte_frequencies", sql("byte_seq", "SELECT b, count(*) AS n FROM byte_seq GROUP BY b"))
def byte_frequencies(spark, d):
    return K.byte_counts(_files(spark, d), "bytes")


@query("used_intervals", """
WITH i AS (SELECT l_suppkey AS g, l_partkey AS a, l_partkey + CAST(l_quantity AS BIGINT) AS z FROM lineitem),
w AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY g ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM i),
k AS (SELECT *, sum(o) OVER (PARTITION BY g ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS k FROM w)
SELECT g, min(a) AS start, max(z) AS stop FROM k GROUP BY g, k""")
def used_intervals(spark, d):
    return A.used_bytes(R.table(spark, d, "lineitem").selectExpr("l_suppkey AS g", "l_partkey AS start", "l_partkey + CAST(l_quantity AS BIGINT) AS stop"))


# ------------------------------------------------------------------ scalars

@query("color_depths", sql("pixel", "SELECT img, x, y, (62 * r + 255) // 510 AS r5, (510 * ((62 * r + 255) // 510) + 31) // 62 AS r15, (510 * ((126 * g + 255) // 510) + 63) // 126 AS g18, (62 * r + 255) // 510 + (62 * g + 255) // 510 * 32 + (62 * b + 255) // 510 * 1024 AS packed, b + g * 256 + r * 65536 + a * 16777216 AS swapped FROM pixel"))
def color_depths(spark, d):
    return R.pixel(spark, d).select("img", "x", "y", C.to5(c("r")).alias("r5"), C.round15(c("r")).alias("r15"), C.round18(c("g")).alias("g18"), C.pack15(c("r"), c("g"), c("b")).alias("packed"), C.swap_red_blue(C.pack32(c("r"), c("g"), c("b"), c("a"))).alias("swapped"))


@query("palette_channels", sql("palette", "SELECT idx, (510 * (color % 32) + 31) // 62 AS r, (510 * ((color // 32) % 32) + 31) // 62 AS g, (510 * ((color // 1024) % 32) + 31) // 62 AS b FROM palette"))
def palette_channels(spark, d):
    r, g, b = C.channels15(c("color"))
    return R.palette(spark, d).select("idx", r.alias("r"), g.alias("g"), b.alias("b"))


_HSV = """h0 AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS sp FROM pixel),
h1 AS (SELECT *, CASE WHEN sp = 0 THEN 0 WHEN mx = r THEN 60 * (g - b) // sp WHEN mx = g THEN 120 + 60 * (b - r) // sp ELSE 240 + 60 * (r - g) // sp END AS h0, CASE WHEN mx = 0 THEN 0 ELSE 100 * sp // mx END AS s, 100 * mx // 255 AS v FROM h0),
h2 AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS h FROM h1)"""


@query("hsv", sql("pixel", f"WITH {_HSV} SELECT img, x, y, h, s, v FROM h2"))
def hsv(spark, d):
    h, s, v = C.hsv(c("r"), c("g"), c("b"))
    return R.pixel(spark, d).select("img", "x", "y", h.alias("h"), s.alias("s"), v.alias("v"))


_BACK = """, k AS (SELECT *, 255 * s * v // 10000 AS ch FROM hh), k2 AS (SELECT *, ch * (60 - abs(h % 120 - 60)) // 60 AS xx, v * 255 // 100 - ch AS m FROM k)
SELECT {keys}, m + CASE WHEN h <= 60 THEN ch WHEN h <= 120 THEN xx WHEN h <= 240 THEN 0 WHEN h <= 300 THEN xx ELSE ch END AS r, m + CASE WHEN h <= 60 THEN xx WHEN h <= 180 THEN ch WHEN h <= 240 THEN xx ELSE 0 END AS g, m + CASE WHEN h <= 120 THEN 0 WHEN h <= 180 THEN xx WHEN h <= 300 THEN ch ELSE xx END AS b FROM k2"""


@query("hsv_back", sql("pixel", f"WITH {_HSV}, hh AS (SELECT * FROM h2)" + _BACK.format(keys="img, x, y")))
def hsv_back(spark, d):
    p = R.pixel(spark, d)
    h, s, v = C.hsv(c("r"), c("g"), c("b"))
    p = p.select("img", "x", "y", h.alias("h"), s.alias("s"), v.alias("v"))
    r, g, b = C.from_hsv(c("h"), c("s"), c("v"))
    return p.select("img", "x", "y", r.alias("r"), g.alias("g"), b.alias("b"))


@query("palette_operation", sql("palette", """
WITH pixel AS (SELECT idx AS img, j AS x, 0 AS y, (510 * (color % 32) + 31) // 62 AS r, (510 * ((color // 32) % 32) + 31) // 62 AS g, (510 * ((color // 1024) % 32) + 31) // 62 AS b, 255 AS a FROM palette, range(1, 4) t(j)), """ + _HSV + """,
q AS (SELECT img, x, ((h + 50 * x) % 360) AS h, greatest(0, s - 10 * x) AS s, least(100, v + 15 * x) AS v FROM h2), hh AS (SELECT * FROM q)""" + _BACK.format(keys="img AS idx, x AS replica")))
def palette_operation(spark, d):
    from ..functions.palette_ops import rotate

    return rotate(R.palette(spark, d), hue=50, saturation=-10, value=15, replicas=3).drop("place")


@query("yiq", sql("pixel", "SELECT img, x, y, round((0.5146329 * r + 1.2303905 * g + 0.2588982 * b) * a / 255.0, 4) + 0.0 AS cy, round((-0.5885085 * r - 0.3060195 * g + 0.8945280 * b) * a / 255.0, 4) + 0.0 AS ci, round((0.7227111 * r - 1.3898515 * g + 0.6671403 * b) * a / 255.0, 4) + 0.0 AS cq FROM pixel_d").replace("pixel AS (", "pixel AS (", 1).replace("pixel_d", "(SELECT img, x, y, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, CAST(a AS DOUBLE) AS a FROM pixel)"))
def yiq(spark, d):
    y, i, q, _ = C.yiq(c("r"), c("g"), c("b"), c("a"))
    return R.pixel(spark, d).select("img", "x", "y", (F.round(y, 4) + 0.0).alias("cy"), (F.round(i, 4) + 0.0).alias("ci"), (F.round(q, 4) + 0.0).alias("cq"))


@query("yiq_round_trip", sql("pixel", "SELECT img, x, y, r, g, b FROM pixel"))
def yiq_round_trip(spark, d):
    return Q.round_trip(R.pixel(spark, d))


@query("gray", sql("pixel", "SELECT img, x, y, CAST(floor(pow(0.2126 * pow((62 * r + 255) // 510 / 31.0, 2.2) + 0.7152 * pow((62 * g + 255) // 510 / 31.0, 2.2) + 0.0722 * pow((62 * b + 255) // 510 / 31.0, 2.2), 1 / 2.2) * 31.0 + 0.5) AS BIGINT) AS v FROM pixel"))
def gray(spark, d):
    return R.pixel(spark, d).select("img", "x", "y", C.gray(*(C.to5(c(ch)) for ch in "rgb")).alias("v"))


@query("yuv", sql("pixel", "SELECT img, x, y, round(0.2990 * r + 0.5870 * g + 0.1140 * b, 4) + 0.0 AS cy, round(-0.1684 * r - 0.3316 * g + 0.5000 * b, 4) + 0.0 AS cu, round(0.5000 * r - 0.4187 * g - 0.0813 * b, 4) + 0.0 AS cv FROM (SELECT img, x, y, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM pixel)"))
def yuv(spark, d):
    return R.pixel(spark, d).select("img", "x", "y", *((F.round(v, 4) + 0.0).alias(n) for v, n in zip(C.yuv(c("r"), c("g"), c("b")), ("cy", "cu", "cv"), strict=True)))


@query("interpolated_colors", sql("palette", "SELECT idx, (2 * ((color % 32) * (8 - idx % 9) + (color * 3 % 32768 % 32) * (idx % 9)) + 8) // 16 + (2 * ((color // 32 % 32) * (8 - idx % 9) + (color * 3 % 32768 // 32 % 32) * (idx % 9)) + 8) // 16 * 32 + (2 * ((color // 1024) * (8 - idx % 9) + (color * 3 % 32768 // 1024) * (idx % 9)) + 8) // 16 * 1024 AS color FROM palette"))
def interpolated_colors(spark, d):
    return R.palette(spark, d).select("idx", C.interpolated15(c("color"), c("color") * 3 % 32768, c("idx") % 9, 8).alias("color"))


@query("texture_words", "SELECT o_orderkey AS id, w % 65536 AS \"offset\", 8 << CAST((w >> 20) % 8 AS INT) AS width, 8 << CAST((w >> 23) % 8 AS INT) AS height, (w >> 26) % 8 AS fmt, (w >> 29) % 2 AS color0, (w >> 16) % 2 AS repeat_s, (w >> 18) % 2 AS flip_s, (w >> 30) % 4 AS transform, w AS packed FROM (SELECT o_orderkey, o_orderkey * 2654435761 % 4294967296 AS w FROM orders)")
def texture_words(spark, d):
    f = P.texture_fields(F.expr("o_orderkey * 2654435761 % 4294967296"))
    return R.table(spark, d, "orders").select(c("o_orderkey").alias("id"), *(f[k].cast(BIG).alias(k) for k in ("offset", "width", "height", "fmt", "color0", "repeat_s", "flip_s", "transform")), P.texture_word(f).alias("packed"))


@query("screen_fields", sql("screen_cell", "SELECT cell, raw % 1024 AS ch, (raw // 1024) % 4 AS flip, (raw // 4096) % 16 AS pal, raw AS packed FROM screen_cell"))
def screen_fields(spark, d):
    s = R.screen_cell(spark, d)
    f = (P.screen_char(c("raw")), P.screen_flip(c("raw")), P.screen_palette(c("raw")))
    return s.select("cell", f[0].alias("ch"), f[1].alias("flip"), f[2].alias("pal"), P.screen_pack(*f).alias("packed"))


@query("oam_fields", sql("sprite", """
SELECT obj, attr1 % 512 AS x, attr0 % 256 AS y, [8,16,32,64,16,32,32,64,8,8,16,32,8,8,8,8][(attr0 // 16384) * 4 + attr1 // 16384 + 1] AS width, [8,16,32,64,8,8,16,32,16,32,32,64,8,8,8,8][(attr0 // 16384) * 4 + attr1 // 16384 + 1] AS height,
 attr2 % 1024 AS char, (attr2 // 1024) % 4 AS priority, attr2 // 4096 AS palette, (attr0 // 1024) % 4 AS mode, (attr0 // 4096) % 2 AS mosaic, (attr0 // 256) % 2 AS affine,
 CASE (attr0 // 256) % 2 WHEN 1 THEN 0 ELSE (attr1 // 4096) % 2 END AS flip_x, CASE (attr0 // 256) % 2 WHEN 1 THEN 0 ELSE (attr1 // 8192) % 2 END AS flip_y, CASE (attr0 // 256) % 2 WHEN 1 THEN (attr0 // 512) % 2 ELSE 0 END AS double,
 CASE (attr0 // 256) % 2 WHEN 1 THEN 0 ELSE (attr0 // 512) % 2 END AS disable, CASE (attr0 // 256) % 2 WHEN 1 THEN (attr1 // 512) % 32 ELSE 0 END AS matrix, CASE (attr0 // 8192) % 2 WHEN 1 THEN 8 ELSE 4 END AS bits FROM sprite"""))
def oam_fields(spark, d):
    return R.sprite(spark, d).select("obj", *(v.alias(k) for k, v in P.oam(c("attr0"), c("attr1"), c("attr2")).items()))


@query("layout_coordinates", "SELECT o_orderkey AS id, CASE WHEN o_custkey * 37 % 4096 >= 2048 THEN o_custkey * 37 % 4096 - 4096 ELSE o_custkey * 37 % 4096 END AS pos, (o_custkey * 37 // 4096) % 4 AS origin, CASE WHEN o_custkey * 37 % 4096 >= 2048 THEN o_custkey * 37 % 4096 - 4096 ELSE o_custkey * 37 % 4096 END - CASE o_orderkey % 3 WHEN 1 THEN (o_orderkey % 40 + 1) // 2 WHEN 2 THEN o_orderkey % 40 ELSE 0 END AS edge FROM orders")
def layout_coordinates(spark, d):
    o = R.table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey * 37 AS raw", "o_orderkey % 40 AS size", "o_orderkey % 3 AS anchor")
    pos, origin = P.layout_coordinate(c("raw"))
    return o.select("id", pos.alias("pos"), origin.alias("origin"), P.anchored(pos, c("size"), c("anchor")).alias("edge"))


@query("integer_functions", "SELECT o_orderkey AS id, CASE WHEN o_custkey <= o_orderkey + 1 THEN 1000 - (2000 * o_custkey + o_orderkey + 1) // (2 * (o_orderkey + 1)) ELSE (2000 * o_custkey + o_orderkey + 1) // (2 * (o_orderkey + 1)) - 1000 END AS permille, (o_orderkey % 4 * 14 + 3) // 6 AS level, xor(xor(xor(o_orderkey % 256, xor(o_orderkey % 256, o_custkey % 256) * 2), xor(o_orderkey % 256, o_orderkey // 256 % 256) * 4), xor(o_orderkey % 256, o_orderkey // 256 % 256) // 128) % 512 AS bucket, (o_orderkey % 65536) // 256 + (o_orderkey % 256) * 256 AS swapped, CAST(floor(log2(o_orderkey + 1)) AS BIGINT) AS ilog, list_sum(list_transform(range(8), lambda i: ((o_orderkey >> i) & 1) << (7 - i)))::BIGINT AS mirrored, CAST(CASE WHEN o_totalprice - 200000 < 0 THEN ceil(o_totalprice - 200000 - 0.5) ELSE floor(o_totalprice - 200000 + 0.5) END AS BIGINT) AS rounded FROM orders")
def integer_functions(spark, d):
    o = R.table(spark, d, "orders")
    k = c("o_orderkey")
    return o.select(k.alias("id"), P.permille_changed(k + 1, c("o_custkey")).alias("permille"), P.rescale_depth(k % 4, 3, 7).alias("level"), P.hash3(k % 256, c("o_custkey") % 256, C.div(k, 256) % 256).alias("bucket"), P.swap16(k).alias("swapped"), P.ilog2(k + 1).alias("ilog"), P.reverse_bits(k, 8).alias("mirrored"), P.round_half_away(c("o_totalprice") - 200000).alias("rounded"))


@query("suffix_and_base", "SELECT page_id, lower(url) LIKE '%.html' OR lower(url) LIKE '%/' AS ends, split_part(url, '/', -1) AS base FROM pages")
def suffix_and_base(spark, d):
    p = R.table(spark, d, "pages")
    return p.select("page_id", (F.lower("url").endswith(".html") | F.lower("url").endswith("/")).alias("ends"), F.substring_index("url", "/", -1).alias("base"))


# ------------------------------------------------------------------ colour reduction

_YIQ = "0.5146329 * r + 1.2303905 * g + 0.2588982 * b AS cy, -0.5885085 * r - 0.3060195 * g + 0.8945280 * b AS ci, 0.7227111 * r - 1.3898515 * g + 0.6671403 * b AS cq"
_DBL = "CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b"
_PAL8 = "pal AS (SELECT i AS idx, CAST((i * 37) % 256 AS DOUBLE) AS r, CAST((i * 91) % 256 AS DOUBLE) AS g, CAST((i * 151) % 256 AS DOUBLE) AS b FROM range(24) t(i)), py AS (SELECT idx, " + _YIQ + " FROM pal)"
PALETTE24 = [(i, i * 37 % 256, i * 91 % 256, i * 151 % 256) for i in range(24)]


@query("histogram", sql("pixel_q", "SELECT r, g, b, count(*) AS w FROM pixel_q GROUP BY r, g, b"))
def histogram(spark, d):
    return Q.histogram(R.pixel_q(spark, d))


@query("top_colors", sql("pixel_q", "SELECT r, g, b, count(*) AS w FROM pixel_q GROUP BY r, g, b ORDER BY w DESC, r, g, b LIMIT 16"))
def top_colors(spark, d):
    return Q.top_colors(Q.histogram(R.pixel_q(spark, d)), 16)


@query("edge_weights", sql("pixel", f"""
WITH p AS (SELECT img, x, y, a, {_YIQ} FROM (SELECT img, x, y, a, {_DBL} FROM pixel)),
n AS (SELECT *, coalesce(lag(cy) OVER rw, cy) + coalesce(lead(cy) OVER rw, cy) + coalesce(lag(cy) OVER cl, cy) + coalesce(lead(cy) OVER cl, cy) AS s FROM p WINDOW rw AS (PARTITION BY img, y ORDER BY x), cl AS (PARTITION BY img, x ORDER BY y))
SELECT img, x, y, round(CASE WHEN a < 128 THEN 0 ELSE greatest(16 - abs(16 - abs(cy - 0.25 * s)) / 8, 1.0) END, 4) AS weight FROM n"""))
def edge_weights(spark, d):
    return Q.edge_weights(R.pixel(spark, d)).select("img", "x", "y", F.round("weight", 4).alias("weight"))


@query("nearest_color", sql("pixel", f"""
WITH {_PAL8}, p AS (SELECT img, x, y, {_YIQ} FROM (SELECT img, x, y, {_DBL} FROM pixel)),
n AS (SELECT p.img, p.x, p.y, py.idx, round(400 * (p.cy - py.cy) ** 2 + 400 * (p.ci - py.ci) ** 2 + 400 * (p.cq - py.cq) ** 2, 6) AS dd FROM p, py)
SELECT img, x, y, arg_min(idx, (dd, idx)) AS idx FROM n GROUP BY img, x, y"""))
def nearest_color(spark, d):
    return Q.indexed(R.pixel(spark, d), PALETTE24)


@query("palette_error", sql("pixel_q", f"""
WITH {_PAL8}, p AS (SELECT w, {_YIQ} FROM (SELECT CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, count(*) AS w FROM pixel_q GROUP BY ALL)),
n AS (SELECT p.cy, p.ci, p.cq, w, min(round(400 * (p.cy - py.cy) ** 2 + 400 * (p.ci - py.ci) ** 2 + 400 * (p.cq - py.cq) ** 2, 6)) AS dd FROM p, py GROUP BY ALL)
SELECT round(sum(w * dd), 2) AS error FROM n"""))
def palette_error(spark, d):
    return Q.palette_error(Q.histogram(R.pixel_q(spark, d)), PALETTE24).select(F.round("error", 2).alias("error"))


@query("moments", sql("pixel_q", f"""
WITH p AS (SELECT w, {_YIQ} FROM (SELECT CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, count(*) AS w FROM pixel_q GROUP BY ALL))
SELECT CAST(sum(w) AS BIGINT) AS w, round(sum(w * cy) / sum(w), 5) AS mean_cy, round(sum(w * ci) / sum(w), 5) AS mean_ci, round(sum(w * cq) / sum(w), 5) AS mean_cq, round(sum(w * cy * cy) / sum(w) - (sum(w * cy) / sum(w)) ** 2, 3) AS cov_cycy, round(sum(w * cy * ci) / sum(w) - sum(w * cy) / sum(w) * sum(w * ci) / sum(w), 3) AS cov_cyci FROM p"""))
def moments(spark, d):
    m = Q.moments(Q.histogram(R.pixel_q(spark, d)))
    return m.select("w", *(F.round("mean_" + n, 5).alias("mean_" + n) for n in ("cy", "ci", "cq")), F.round("cov_cycy", 3).alias("cov_cycy"), F.round("cov_cyci", 3).alias("cov_cyci"))


@query("best_split", sql("pixel_q", f"""
WITH p AS (SELECT *, {_YIQ} FROM (SELECT CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, count(*) AS w FROM pixel_q GROUP BY ALL)),
s AS (SELECT *, sum(w) OVER o AS wl, row_number() OVER (ORDER BY round(cy, 6), r, g, b) AS n, sum(w * cy) OVER o AS yl, sum(w * ci) OVER o AS il, sum(w * cq) OVER o AS ql FROM p WINDOW o AS (ORDER BY round(cy, 6), r, g, b ROWS UNBOUNDED PRECEDING)),
t AS (SELECT sum(w) AS wt, sum(w * cy) AS yt, sum(w * ci) AS it, sum(w * cq) AS qt FROM p)
SELECT round((yl ** 2 + il ** 2 + ql ** 2) / wl + ((yt - yl) ** 2 + (it - il) ** 2 + (qt - ql) ** 2) / (wt - wl) - (yt ** 2 + it ** 2 + qt ** 2) / wt, 4) AS gain, CAST(wl AS BIGINT) AS wl, n FROM s, t WHERE wl < wt ORDER BY gain DESC, n LIMIT 1"""))
def best_split(spark, d):
    return Q.best_split(Q.histogram(R.pixel_q(spark, d)), F.round("cy", 6))


@query("lloyd_step", sql("pixel_q", f"""
WITH {_PAL8}, p AS (SELECT row_number() OVER () AS k, w, {_YIQ} FROM (SELECT CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, count(*) AS w FROM pixel_q GROUP BY ALL)),
n AS (SELECT k, any_value(w) AS w, any_value(p.cy) AS cy, arg_min(idx, (round(400 * (p.cy - py.cy) ** 2 + 400 * (p.ci - py.ci) ** 2 + 400 * (p.cq - py.cq) ** 2, 6), idx)) AS idx FROM p, py GROUP BY k)
SELECT idx, CAST(sum(w) AS BIGINT) AS w, round(sum(w * cy) / sum(w), 5) AS y FROM n GROUP BY idx"""))
def lloyd_step(spark, d):
    return Q.lloyd_step(Q.histogram(R.pixel_q(spark, d)), PALETTE24).select("idx", "w", F.round("y", 5).alias("y"))


@query("palette_distances", f"""
WITH b AS (SELECT p_partkey // 16 AS pal, CAST((p_partkey * 37) % 256 AS DOUBLE) AS r, CAST((p_partkey * 91) % 256 AS DOUBLE) AS g, CAST(p_size * 5 AS DOUBLE) AS b FROM part WHERE p_partkey < 256),
p AS (SELECT *, {_YIQ} FROM b), n AS (SELECT u.pal AS p, v.pal AS q, u.r, u.g, u.b, min(400 * (u.cy - v.cy) ** 2 + 400 * (u.ci - v.ci) ** 2 + 400 * (u.cq - v.cq) ** 2) AS dd FROM p u JOIN p v ON u.pal <> v.pal GROUP BY ALL)
SELECT p, q, round(sum(dd), 4) AS d FROM n GROUP BY p, q""")
def palette_distances(spark, d):
    bank = R.table(spark, d, "part").where("p_partkey < 256").selectExpr("p_partkey div 16 AS pal", "(p_partkey * 37) % 256 AS r", "(p_partkey * 91) % 256 AS g", "p_size * 5L AS b")
    return Q.palette_distances(bank)


@query("sort_palette_lightness", sql("palette", "WITH c AS (SELECT idx, CAST((510 * (color % 32) + 31) // 62 AS DOUBLE) AS r, CAST((510 * ((color // 32) % 32) + 31) // 62 AS DOUBLE) AS g, CAST((510 * ((color // 1024) % 32) + 31) // 62 AS DOUBLE) AS b FROM palette) SELECT idx, row_number() OVER (ORDER BY round(0.5146329 * r + 1.2303905 * g + 0.2588982 * b, 6), idx) - 1 AS place FROM c"))
def sort_palette_lightness(spark, d):
    from pyspark.sql import Window

    r, g, b = C.channels15(c("color"))
    y, *_ = C.yiq(r, g, b, F.lit(255))
    return R.palette(spark, d).withColumn("y", F.round(y, 6)).select("idx", (F.row_number().over(Window.orderBy("y", "idx")) - 1).cast(BIG).alias("place"))


@query("sort_palette_hue", sql("palette", "WITH pixel AS (SELECT idx AS img, 0 AS x, 0 AS y, (510 * (color % 32) + 31) // 62 AS r, (510 * ((color // 32) % 32) + 31) // 62 AS g, (510 * ((color // 1024) % 32) + 31) // 62 AS b FROM palette), " + _HSV + " SELECT img AS idx, row_number() OVER (ORDER BY h, s, img) - 1 AS place FROM h2"))
def sort_palette_hue(spark, d):
    from pyspark.sql import Window

    h, s, _ = C.hsv(*C.channels15(c("color")))
    return R.palette(spark, d).select("idx", h.alias("h"), s.alias("s")).select("idx", (F.row_number().over(Window.orderBy("h", "s", "idx")) - 1).cast(BIG).alias("place"))


@query("create_palette")
def create_palette(spark, d):
    return spark.createDataFrame(Q.create_palette(Q.histogram(R.pixel(spark, d)), 16), "idx long, r long, g long, b long")


@query("diffused")
def diffused(spark, d):
    return Q.diffused(R.pixel(spark, d), PALETTE24)


@query("chain_palette", sql("palette", """
WITH RECURSIVE h AS (SELECT idx, (510 * (color % 32) + 31) // 62 AS r, (510 * ((color // 32) % 32) + 31) // 62 AS g, (510 * ((color // 1024) % 32) + 31) // 62 AS b FROM palette),
k AS (SELECT idx, 2990 * r + 5870 * g + 1140 * b AS y, -1684 * r - 3316 * g + 5000 * b AS u, 5000 * r - 4187 * g - 813 * b AS v FROM h),
d AS MATERIALIZED (SELECT p.idx AS i, q.idx AS j, 4 * (p.y - q.y) ** 2 + (p.u - q.u) ** 2 + (p.v - q.v) ** 2 AS d FROM k p JOIN k q ON p.idx <> q.idx),
s AS (SELECT idx AS start, idx AS at, [idx] AS path, CAST(0 AS DOUBLE) AS total, 1 AS n FROM k
 UNION ALL SELECT start, nx['j'], list_append(path, nx['j']), total + nx['d'], n + 1 FROM (SELECT s.start, any_value(s.path) AS path, any_value(s.total) AS total, any_value(s.n) AS n, arg_min({'j': d.j, 'd': d.d}, (d.d, d.j)) AS nx FROM s JOIN d ON d.i = s.at AND NOT list_contains(s.path, d.j) GROUP BY s.start) z),
w AS (SELECT arg_min(path, (total, start)) AS path FROM s WHERE n = (SELECT count(*) FROM k))
SELECT unnest(range(len(path))) AS place, unnest(path) AS idx FROM w""").replace("WITH palette", "WITH RECURSIVE palette", 1).replace(", RECURSIVE h AS", ", h AS", 1))
def chain_palette(spark, d):
    """In whole ten-thousandths, so that equal distances are equal."""
    r, g, b = C.channels15(c("color"))
    rows = R.palette(spark, d).select("idx", *(sum((v * round(10000 * w) for v, w in zip((r, g, b), row, strict=True)), F.lit(0)).alias(n) for row, n in zip(C.YUV, "yuv", strict=True))).orderBy("idx").limit(Q.CLUSTERS + 1).collect()
    if len(rows) > Q.CLUSTERS:
        raise ValueError(f"a palette has up to {Q.CLUSTERS} colours")
    order = S.neighbour_chain([(x["y"], x["u"], x["v"]) for x in rows])
    return spark.createDataFrame([(k, rows[i]["idx"]) for k, i in enumerate(order)], "place long, idx long")


# ------------------------------------------------------------------ merging

@query("merge_tiles", sql("tile_copies", """
WITH f AS (SELECT tile_no, k, list(idx ORDER BY xor(pos, m)) AS px FROM tile_copies, (VALUES (0, 0), (1, 7), (2, 56), (3, 63)) v(k, m) GROUP BY ALL),
cn AS (SELECT tile_no, min(px) AS canon FROM f GROUP BY tile_no), ms AS (SELECT canon, min(tile_no) AS master FROM cn GROUP BY canon),
j AS (SELECT cn.tile_no, ms.master FROM cn JOIN ms USING (canon)), own AS (SELECT tile_no, px FROM f WHERE k = 0),
x AS (SELECT j.tile_no, j.master, min(f.k) AS flip FROM j JOIN own ON own.tile_no = j.tile_no JOIN f ON f.tile_no = j.master AND f.px = own.px GROUP BY ALL)
SELECT tile_no, master, CAST(flip AS BIGINT) AS flip, dense_rank() OVER (ORDER BY master) - 1 AS id FROM x"""))
def merge_tiles(spark, d):
    return D.merge_flipped(D.tile_arrays(R.tile_copies(spark, d)))


@query("tile_distances", sql("tile_px", """
WITH s AS (SELECT a.tile_no AS a, b.tile_no AS b, k, CAST(sum((a.idx - b.idx) ** 2) AS BIGINT) AS d FROM tile_px a JOIN tile_px b ON a.tile_no // 16 = b.tile_no // 16 AND a.tile_no < b.tile_no JOIN (VALUES (0, 0), (1, 7), (2, 56), (3, 63)) v(k, m) ON a.pos = xor(b.pos, m)
 WHERE a.tile_no IN (SELECT tile_no FROM tile_px GROUP BY tile_no HAVING count(*) = 64) AND b.tile_no IN (SELECT tile_no FROM tile_px GROUP BY tile_no HAVING count(*) = 64) GROUP BY ALL)
SELECT a, b, min(d) AS d, CAST(arg_min(k, (d, k)) AS BIGINT) AS flip FROM s GROUP BY a, b"""))
def tile_distances(spark, d):
    """Distances of all pairs within a character file of 16 tiles; pairs meet by file, never across."""
    t = D.tile_arrays(R.tile_px(spark, d)).where("NOT array_contains(px, -1)").withColumn("file", F.expr("tile_no div 16"))
    a, b = t.select("file", c("tile_no").alias("a"), c("px").alias("pa")), t.select("file", c("tile_no").alias("b"), c("px").alias("pb"))
    return D.tile_distances(a.join(b, "file").where("a < b"))


def _merge_to_sql(most, step):
    """The cheapest pair of each file is merged until ``most`` are left: a state per file holds masters and sizes as lists."""
    return sql("tile_px", f"""
WITH RECURSIVE t AS (SELECT tile_no // 8 AS file, tile_no, tile_no % 8 AS n, list(idx ORDER BY pos) AS px FROM tile_px GROUP BY tile_no HAVING count(*) = 64),
d AS (SELECT a.file, a.n AS i, b.n AS j, list_min(list_transform([0, 7, 56, 63], lambda m: list_sum(list_transform(range(64), lambda p: (a.px[p + 1] - b.px[xor(p, m) + 1]) ** 2)))) AS d FROM t a JOIN t b ON a.file = b.file AND a.n < b.n),
s AS (SELECT file, list(n ORDER BY n) AS live, list_transform(range(8), lambda x: x) AS master, list_transform(range(8), lambda x: 1) AS size FROM t GROUP BY file
 UNION ALL
 SELECT file, list_filter(live, lambda x: x <> lose), list_transform(master, lambda x: CASE WHEN x = lose THEN keep ELSE x END), list_transform(size, lambda x, k: CASE WHEN k = keep + 1 THEN x + size[lose + 1] ELSE x END) FROM (
  SELECT file, live, master, size, CASE WHEN size[i + 1] >= size[j + 1] THEN i ELSE j END AS keep, CASE WHEN size[i + 1] >= size[j + 1] THEN j ELSE i END AS lose FROM (
   SELECT *, best['i'] AS i, best['j'] AS j FROM (
    SELECT s.file, s.live, s.master, s.size, arg_min({{'i': d.i, 'j': d.j}}, (d.d * (s.size[d.i + 1] + s.size[d.j + 1]) ** 2, d.i, d.j)) AS best
    FROM s JOIN d ON d.file = s.file AND list_contains(s.live, d.i) AND list_contains(s.live, d.j) WHERE len(s.live) > {most} GROUP BY ALL) u) v) w),
l AS (SELECT file, arg_min(master, len(live)) AS master FROM s GROUP BY file)
SELECT t.file, t.tile_no, CAST(t.file * 8 + l.master[t.n + 1] AS BIGINT) AS master FROM t JOIN l USING (file)""").replace("WITH pixel", "WITH RECURSIVE pixel", 1).replace(", RECURSIVE t AS", ", t AS", 1)


@query("merge_tiles_to", _merge_to_sql(5, 0))
def merge_tiles_to(spark, d):
    t = D.tile_arrays(R.tile_px(spark, d)).where("NOT array_contains(px, -1)").withColumn("file", F.expr("tile_no div 8"))
    return D.merge_files_to(t, "file", 5)


@query("representatives", sql("tile_copies", """
WITH t AS (SELECT tile_no, pos, 4 * idx + (tile_no // 240 + pos) % 4 AS idx FROM tile_copies),
f AS MATERIALIZED (SELECT tile_no, k, list(idx // 4 ORDER BY xor(pos, m)) AS px FROM t, (VALUES (0, 0), (1, 7), (2, 56), (3, 63)) v(k, m) GROUP BY ALL),
cn AS (SELECT tile_no, min(px) AS canon FROM f GROUP BY tile_no), ms AS (SELECT canon, min(tile_no) AS master FROM cn GROUP BY canon),
j AS MATERIALIZED (SELECT cn.tile_no, ms.master FROM cn JOIN ms USING (canon)), own AS MATERIALIZED (SELECT tile_no, px FROM f WHERE k = 0),
x AS MATERIALIZED (SELECT j.tile_no, j.master, min(f.k) AS flip FROM j JOIN own ON own.tile_no = j.tile_no JOIN f ON f.tile_no = j.master AND f.px = own.px GROUP BY ALL)
SELECT master, xor(pos, [0, 7, 56, 63][flip + 1]) AS pos, CAST((2 * sum(idx) + count(*)) // (2 * count(*)) AS BIGINT) AS mean FROM t JOIN x USING (tile_no) GROUP BY ALL"""))
def representatives(spark, d):
    """Means of tiles that are alike but for their two lowest bits."""
    t = R.tile_copies(spark, d).selectExpr("tile_no", "pos", "4 * idx + (tile_no div 240 + pos) % 4 AS idx")
    return D.representative(t, D.merge_flipped(D.tile_arrays(t.selectExpr("tile_no", "pos", "idx div 4 AS idx"))))


@query("message_dedup", "SELECT conv_id, turn, min(conv_id * 1000 + turn) OVER (PARTITION BY text) AS first FROM conversations")
def message_dedup(spark, d):
    t = R.table(spark, d, "conversations").select("conv_id", "turn", "text", (c("conv_id") * 1000 + c("turn")).alias("k"))
    first = t.groupBy("text").agg(F.min("k").alias("first"))  # reduced before the join: copies of one text don't meet in a window
    return t.join(first, t["text"].eqNullSafe(first["text"])).select("conv_id", "turn", "first")


@query("previous_block", sql("tile_copies", "WITH f AS (SELECT tile_no, list(idx ORDER BY pos) AS px FROM tile_copies GROUP BY tile_no) SELECT tile_no, lag(tile_no) OVER (PARTITION BY px ORDER BY tile_no) AS previous FROM f"))
def previous_block(spark, d):
    return D.previous_equal(D.tile_arrays(R.tile_copies(spark, d)), ["px"], "tile_no").select("tile_no", "previous")


@query("first_block", sql("tile_copies", "WITH f AS (SELECT tile_no, list(idx ORDER BY pos) AS px FROM tile_copies GROUP BY tile_no), m AS (SELECT px, min(tile_no) AS first FROM f GROUP BY px) SELECT tile_no, first FROM f JOIN m USING (px)"))
def first_block(spark, d):
    return D.first_equal(D.tile_arrays(R.tile_copies(spark, d)), ["px"], "tile_no").select("tile_no", "first")


@query("compact_palettes", "WITH k AS (SELECT p_partkey // 16 AS pal, CASE WHEN (p_partkey // 16) % 3 = 0 THEN 0 ELSE p_size END AS color FROM part), s AS (SELECT pal FROM k GROUP BY pal HAVING bool_or(color <> 0)) SELECT row_number() OVER (ORDER BY pal) - 1 AS slot, pal FROM s")
def compact_palettes(spark, d):
    return D.compact_palettes(R.table(spark, d, "part").selectExpr("p_partkey div 16 AS pal", "CASE WHEN (p_partkey div 16) % 3 = 0 THEN 0 ELSE p_size END AS color"))


@query("code_runs", """
WITH k AS (SELECT l_suppkey AS font, l_partkey AS code, min(l_partkey * 2 - l_partkey % 10) AS glyph FROM lineitem GROUP BY ALL), g AS (SELECT *, code - row_number() OVER (PARTITION BY font ORDER BY code) AS r FROM k),
s AS (SELECT font, min(code) AS first, max(code) AS last, count(*) AS n, max(glyph - code) = min(glyph - code) AS dense FROM g GROUP BY font, r)
SELECT font, first, last, n, least(CASE WHEN dense THEN 24 ELSE 1000000 END, (20 + 2 * n + 3) // 4 * 4, 24 + 4 * n) AS cost FROM s""")
def code_runs(spark, d):
    k = R.table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("font"), c("l_partkey").alias("code")).agg(F.min(F.expr("l_partkey * 2 - l_partkey % 10")).alias("glyph"))
    return D.code_runs(k, "font")


@query("string_pool", sql("message", r"""
WITH RECURSIVE m AS (SELECT file_id, pos, regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1,', 'g') || '00,' AS h FROM message),
f AS MATERIALIZED (SELECT file_id, list(h ORDER BY strlen(h) DESC, pos) AS hs, list(pos ORDER BY strlen(h) DESC, pos) AS ps FROM m GROUP BY file_id),
s AS (SELECT file_id, 0 AS k, '' AS pool, CAST([] AS BIGINT[]) AS places FROM f
 UNION ALL SELECT s.file_id, k + 1, CASE WHEN contains(pool, hs[k + 1]) THEN pool ELSE pool || hs[k + 1] END, list_append(places, CASE WHEN contains(pool, hs[k + 1]) THEN (instr(pool, hs[k + 1]) - 1) // 3 ELSE strlen(pool) // 3 END) FROM s JOIN f USING (file_id) WHERE k < len(hs)),
l AS (SELECT file_id, arg_max(places, k) AS places FROM s GROUP BY file_id)
SELECT file_id, unnest(ps) AS pos, unnest(places) AS "offset" FROM l JOIN f USING (file_id)""").replace("WITH message", "WITH RECURSIVE message", 1).replace(", RECURSIVE m AS", ", m AS", 1))
def string_pool(spark, d):
    return D.pool_strings(R.message(spark, d))


# ------------------------------------------------------------------ ordered rows

@query("diff8", sql("byte_seq", "WITH t AS (SELECT doc_id, pos, (b - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY pos), 0) + 256) % 256 AS v FROM byte_seq) SELECT doc_id, count(*) AS n, CAST(sum(v * (pos % 251 + 1)) AS BIGINT) AS total FROM t GROUP BY doc_id"))
def diff8(spark, d):
    """Every document's difference bytes, weighed by place."""
    coded = K.coded(_files(spark, d).where("length(bytes) > 0"), "bytes", lambda x: K.weighed(K.diff8(x)[4:]), "long", "total", ("path", "bytes"))
    return coded.select(c("path").cast(BIG).alias("doc_id"), F.length("bytes").cast(BIG).alias("n"), "total")


@query("diff8_arrays", sql("byte_seq", "WITH t AS (SELECT doc_id, (b - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY pos), 0) + 256) % 256 AS v FROM byte_seq) SELECT doc_id, count_if(v = 0) AS zeros FROM t GROUP BY doc_id"))
def diff8_arrays(spark, d):
    """The same filter over arrays, by column functions alone."""
    rows = R.byte_arrays(spark, d).select("doc_id", S.difference_array(c("bytes")).alias("v"))
    return rows.select("doc_id", F.size(F.filter("v", lambda v: v == 0)).cast(BIG).alias("zeros"))


@query("diff16_back", """SELECT o_custkey AS g, o_orderkey AS pos, o_orderkey * 40503 % 65536 AS v FROM orders""")
def diff16_back(spark, d):
    k = R.table(spark, d, "orders").selectExpr("o_custkey AS g", "o_orderkey AS pos", "o_orderkey * 40503 % 65536 AS v")
    return S.running(S.difference(k, "g", "pos", "v", 65536), "g", "pos", "v", 65536)


@query("diff16", """
WITH k AS (SELECT o_custkey AS g, o_orderkey AS pos, o_orderkey * 40503 % 65536 AS v FROM orders) SELECT g, pos, (v - coalesce(lag(v) OVER (PARTITION BY g ORDER BY pos), 0) + 65536) % 65536 AS v FROM k""")
def diff16(spark, d):
    k = R.table(spark, d, "orders").selectExpr("o_custkey AS g", "o_orderkey AS pos", "o_orderkey * 40503 % 65536 AS v")
    return S.difference(k, "g", "pos", "v", 65536)


@query("runs", """
WITH k AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER o THEN 0 ELSE 1 END AS s FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS k FROM k)
SELECT user_id, min(event_id) AS start, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, k""")
def runs(spark, d):
    return S.runs(R.table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


def _playback_sql():
    """A player simulated tick by tick: state is (frame, time, direction, playing)."""
    return sql("anim_frame", """
    WITH RECURSIVE h AS (SELECT seq, count(*) AS n, min(mode) AS mode FROM anim_frame GROUP BY seq),
    p AS (SELECT seq, n, mode, CAST(0 AS BIGINT) AS tick, CAST(0 AS BIGINT) AS f, CAST(0 AS BIGINT) AS t, 1 AS dir, true AS playing FROM h
      UNION ALL
      SELECT p.seq, n, p.mode, tick + 1,
        CASE WHEN NOT playing OR t + 1 < a.duration THEN f WHEN dir = 1 AND f + 1 < n THEN f + 1 WHEN dir = 1 THEN CASE p.mode WHEN 1 THEN f WHEN 2 THEN 0 ELSE greatest(f - 1, 0) END WHEN f > 0 THEN f - 1 WHEN p.mode = 4 THEN least(1, n - 1) ELSE 0 END,
        CASE WHEN NOT playing THEN t WHEN t + 1 < a.duration THEN t + 1 ELSE 0 END,
        CASE WHEN NOT playing OR t + 1 < a.duration THEN dir WHEN dir = 1 AND f + 1 >= n AND p.mode >= 3 THEN -1 WHEN dir = -1 AND f = 0 AND p.mode = 4 THEN 1 ELSE dir END,
        playing AND NOT (t + 1 >= a.duration AND ((dir = 1 AND f + 1 >= n AND p.mode = 1) OR (dir = -1 AND f = 0 AND p.mode = 3)))
      FROM p JOIN anim_frame a ON a.seq = p.seq AND a.frame_no = p.f WHERE tick < 60)
    SELECT seq, tick, f AS frame_no FROM p""").replace("WITH anim_frame", "WITH RECURSIVE anim_frame", 1).replace(", RECURSIVE h AS", ", h AS", 1)


@query("playback", _playback_sql())
def playback(spark, d):
    f = R.anim_frame(spark, d)
    ticks = f.select("seq").distinct().withColumn("tick", F.explode(F.sequence(F.lit(0).cast(BIG), F.lit(60).cast(BIG))))
    return S.at_ticks(f, ticks)


@query("interpolation", """
WITH RECURSIVE p AS (SELECT p_partkey AS id, p_size * 40 - 1000 AS x0, (p_partkey * 31) % 2000 - 900 AS x1, 7 + p_size AS total FROM part), d AS (SELECT id, 0 AS i, CAST(total AS BIGINT) AS lft FROM p UNION ALL SELECT id, i + 1, lft - (2 * lft + 8 - i) // (2 * (8 - i)) FROM d WHERE i < 7)
SELECT p.id, CAST(d.i AS BIGINT) AS i, CAST((x0 * 2 * (8 - d.i) + x1 * 2 * (d.i + 1) + CASE WHEN x0 * 2 * (8 - d.i) + x1 * 2 * (d.i + 1) < 0 THEN -9 ELSE 9 END) // 18 AS BIGINT) AS x, (2 * lft + 8 - d.i) // (2 * (8 - d.i)) AS duration FROM p JOIN d USING (id)""")
def interpolation(spark, d):
    p = R.table(spark, d, "part").selectExpr("p_partkey AS id", "CAST(p_size * 40 - 1000 AS BIGINT) AS x0", "(p_partkey * 31) % 2000 - 900 AS x1", "CAST(7 + p_size AS BIGINT) AS total")
    return S.interpolated(p, 8)


@query("frame_kinds", "SELECT user_id AS seq, CAST(CASE WHEN bool_or(CASE WHEN user_id % 3 = 0 AND event_id % 50 = 0 THEN 2048 ELSE 4096 END <> 4096) THEN 2 WHEN bool_or(user_id % 5 = 0 AND event_id % 7 = 0) THEN 1 ELSE 0 END AS BIGINT) AS kind FROM events GROUP BY user_id")
def frame_kinds(spark, d):
    f = R.table(spark, d, "events").selectExpr("user_id AS seq", "CASE WHEN user_id % 3 = 0 AND event_id % 50 = 0 THEN 2048 ELSE 4096 END AS sx", "4096 AS sy", "0 AS rot_z", "CASE WHEN user_id % 5 = 0 AND event_id % 7 = 0 THEN 3 ELSE 0 END AS px", "0 AS py")
    return S.frame_kind(f)


@query("transforms", "SELECT o_orderkey AS id, round((o_custkey % 7 + 1) / 4.0 * cos(2 * pi() * (o_orderkey % 65536) / 65536.0), 6) AS a, round(3.0 * (1 - (o_custkey % 7 + 1) / 4.0 * cos(2 * pi() * (o_orderkey % 65536) / 65536.0)) + 0.5 * 5.0 * sin(2 * pi() * (o_orderkey % 65536) / 65536.0) + o_custkey % 11, 6) AS e FROM orders")
def transforms(spark, d):
    o = R.table(spark, d, "orders")
    m = S.transform_matrix(F.lit(3.0), F.lit(5.0), (c("o_custkey") % 7 + 1) / 4.0, F.lit(0.5), (c("o_orderkey") % 65536) * 2 * F.pi() / 65536.0, c("o_custkey") % 11, F.lit(0.0))
    return o.select(c("o_orderkey").alias("id"), F.round(m["a"], 6).alias("a"), F.round(m["e"], 6).alias("e"))


@query("affine_inverses", "SELECT o_orderkey AS id, round(CASE WHEN det = 0 THEN 127.99609375 ELSE d / det END, 6) + 0.0 AS a, round(CASE WHEN det = 0 THEN 0 ELSE -b / det END, 6) + 0.0 AS b FROM (SELECT o_orderkey, CAST(o_custkey % 4 AS DOUBLE) AS b, 2.0 AS d, (o_orderkey % 5) * 2.0 - (o_custkey % 4) * 1.0 AS det FROM orders)")
def affine_inverses(spark, d):
    o = R.table(spark, d, "orders")
    a, b, *_ = S.affine_inverse((c("o_orderkey") % 5).cast("double"), (c("o_custkey") % 4).cast("double"), F.lit(1.0), F.lit(2.0))
    return o.select(c("o_orderkey").alias("id"), (F.round(a, 6) + 0.0).alias("a"), (F.round(b, 6) + 0.0).alias("b"))


@query("segment_errors", """
WITH s AS (SELECT l_orderkey AS g, (l_linenumber - 1) * 32 AS o, CASE WHEN l_partkey % 9 = 0 THEN 16 ELSE 32 END AS z FROM lineitem),
w AS (SELECT *, lag(o) OVER k AS po, lag(z) OVER k AS pz FROM s WINDOW k AS (PARTITION BY g ORDER BY o, z))
SELECT g, CAST(sum(CASE WHEN po IS NULL THEN o <> 0 WHEN o = po THEN z <> pz ELSE o <> po + pz END) AS BIGINT) AS errors FROM w GROUP BY g""")
def segment_errors(spark, d):
    s = R.table(spark, d, "lineitem").selectExpr("l_orderkey AS g", "(l_linenumber - 1) * 32 AS offset", "CASE WHEN l_partkey % 9 = 0 THEN 16 ELSE 32 END AS size")
    return S.tiling_errors(s, "g")


@query("first_gap", """
WITH u AS (SELECT o_custkey AS g, o_orderkey % 900 AS a, o_orderkey % 900 + 20 AS z FROM orders), c AS (SELECT DISTINCT g, k * 4 AS p FROM u, range(251) t(k)),
f AS (SELECT c.g, c.p FROM c WHERE c.p + 40 <= 1000 AND NOT EXISTS (SELECT 1 FROM u WHERE u.g = c.g AND u.a < c.p + 40 AND c.p < u.z))
SELECT x.g, coalesce(min(f.p), -1) AS place FROM (SELECT DISTINCT g FROM u) x LEFT JOIN f ON f.g = x.g GROUP BY x.g""")
def first_gap(spark, d):
    u = R.table(spark, d, "orders").selectExpr("o_custkey AS g", "o_orderkey % 900 AS start", "o_orderkey % 900 + 20 AS stop")
    return S.first_gap(u, "g", 40, 4, 1000)


@query("swizzle", sql("pixel", "SELECT img, x, y, ((y // 32) * 2 + x // 32) * 1024 + (y % 32) * 32 + x % 32 AS place FROM pixel"))
def swizzle(spark, d):
    return R.pixel(spark, d).select("img", "x", "y", S.swizzled(c("x"), c("y"), 64).alias("place"))


@query("guess_width", "SELECT p_partkey AS id, CASE WHEN (p_partkey + 1) % 32 = 0 THEN 32 ELSE (p_partkey + 1) // list_max(list_filter(range(1, CAST(floor(sqrt(p_partkey + 1)) AS BIGINT) + 1), lambda k: (p_partkey + 1) % k = 0)) END AS width, greatest(8, CAST(pow(2, ceil(log2(p_partkey + 1))) AS BIGINT)) AS padded FROM part")
def guess_width(spark, d):
    return R.table(spark, d, "part").select(c("p_partkey").alias("id"), S.guessed_width(c("p_partkey") + 1).alias("width"), S.power_of_two(c("p_partkey") + 1).alias("padded"))


@query("flip_image", sql("pixel", "SELECT img, m.w - x AS x, m.h - y AS y, r FROM pixel JOIN (SELECT img, max(x) AS w, max(y) AS h FROM pixel GROUP BY img) m USING (img)"))
def flip_image(spark, d):
    return S.flipped(R.pixel(spark, d), True, True).select("img", "x", "y", "r")


@query("crop_image", sql("pixel", "SELECT img, x - 10 AS x, y - 20 AS y, r, g, b, a FROM pixel WHERE x BETWEEN 10 AND 29 AND y BETWEEN 20 AND 49"))
def crop_image(spark, d):
    return S.cropped(R.pixel(spark, d), 10, 20, 20, 30)


def _over_sql(ch):
    mixed = f"(p.{ch} * 255 * p.a + q.{ch} * (255 - p.a) * q.a) // greatest(255 * p.a + (255 - p.a) * q.a, 1)" if ch != "a" else "(255 * p.a + (255 - p.a) * q.a) // 255"
    return f"CASE p.a WHEN 255 THEN p.{ch} WHEN 0 THEN q.{ch} ELSE {mixed} END AS {ch}"


@query("composite", sql("pixel", "SELECT p.img, p.x, p.y, " + ", ".join(map(_over_sql, "rgba")) + " FROM pixel p JOIN pixel q ON q.img = 0 AND p.img > 0 AND p.x = q.x AND p.y = q.y"))
def composite(spark, d):
    p = R.pixel(spark, d)
    below = p.where("img = 0").select("x", "y", *(c(ch).alias(f"b{ch}") for ch in "rgba"))
    j = p.where("img > 0").join(L.within(below), ["x", "y"])
    return j.select("img", "x", "y", *(v.alias(n) for v, n in zip(C.over(tuple(map(c, "rgba")), tuple(c(f"b{ch}") for ch in "rgba")), "rgba", strict=True)))


@query("area_scale", sql("pixel", """
WITH u AS (SELECT *, unnest(range(x * 24 // 64, (x * 24 + 23) // 64 + 1)) AS u FROM pixel), v AS (SELECT *, unnest(range(y * 40 // 64, (y * 40 + 39) // 64 + 1)) AS v FROM u),
s AS (SELECT *, (least((x + 1) * 24, (u + 1) * 64) - greatest(x * 24, u * 64)) * (least((y + 1) * 40, (v + 1) * 64) - greatest(y * 40, v * 64)) AS s FROM v)
SELECT img, u AS x, v AS y, CAST(coalesce((2 * sum(s * a * r) + sum(s * a)) // nullif(2 * sum(s * a), 0), 0) AS BIGINT) AS r, CAST(coalesce((2 * sum(s * a * g) + sum(s * a)) // nullif(2 * sum(s * a), 0), 0) AS BIGINT) AS g, CAST(coalesce((2 * sum(s * a * b) + sum(s * a)) // nullif(2 * sum(s * a), 0), 0) AS BIGINT) AS b, CAST((2 * sum(s * a) + sum(s)) // (2 * sum(s)) AS BIGINT) AS a FROM s WHERE s > 0 GROUP BY img, u, v"""))
def area_scale(spark, d):
    return S.area_scaled(R.pixel(spark, d), 64, 64, 24, 40)


@query("rect_owner", sql("pixel", "SELECT img, x, y, coalesce(min(k), -1) AS rect FROM pixel LEFT JOIN (SELECT k, (k * 17) % 50 AS x0, (k * 29) % 50 AS y0, 16 AS w, 8 + k AS h FROM range(12) t(k)) q ON x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h GROUP BY img, x, y"))
def rect_owner(spark, d):
    rects = spark.range(12).selectExpr("id", "(id * 17) % 50 AS x0", "(id * 29) % 50 AS y0", "16 AS w", "8 + id AS h")
    return S.owner(R.pixel(spark, d), rects)


@query("line_widths", "WITH k AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS ch FROM conversations) SELECT conv_id, turn, CAST(sum(CASE WHEN ch BETWEEN 'a' AND 'z' AND length(ch) = 1 THEN unicode(ch) % 9 + 3 ELSE 11 END) AS BIGINT) AS width FROM k WHERE ch <> '' GROUP BY conv_id, turn")
def line_widths(spark, d):
    g = spark.range(97, 123).selectExpr("chr(id) AS c", "id % 9 + 3 AS w")
    return S.line_widths(R.table(spark, d, "conversations"), g, ["conv_id", "turn"], "text", 11)


@query("flood", sql("pixel", """
WITH RECURSIVE p AS MATERIALIZED (SELECT img, x, y, r // 128 AS idx FROM pixel),
s AS (SELECT * FROM p WHERE x = 5 AND y = 5 UNION SELECT p.* FROM s, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy), p WHERE p.img = s.img AND p.x = s.x + dx AND p.y = s.y + dy AND p.idx = s.idx)
SELECT img, x, y FROM s""").replace("WITH pixel", "WITH RECURSIVE pixel", 1).replace(", RECURSIVE p AS", ", p AS", 1))
def flood(spark, d):
    return S.flood(R.pixel(spark, d).selectExpr("img", "x", "y", "r div 128 AS idx"), 5, 5)


@query("covering")
def covering(spark, d):
    return S.covering(R.pixel(spark, d))


# ------------------------------------------------------------------ more of colours, frames, glyphs and links

@query("alpha_distances", sql("pixel", """
WITH p AS (SELECT img, x, y, a / 255.0 AS a, (0.5146329 * r + 1.2303905 * g + 0.2588982 * b) * a / 255.0 AS cy, (-0.5885085 * r - 0.3060195 * g + 0.8945280 * b) * a / 255.0 AS ci, (0.7227111 * r - 1.3898515 * g + 0.6671403 * b) * a / 255.0 AS cq FROM (SELECT img, x, y, """ + "CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b, CAST(a AS DOUBLE) AS a" + """ FROM pixel)),
q AS (SELECT 0.5 AS a, (0.5146329 * 200 + 1.2303905 * 100 + 0.2588982 * 50) * 0.5 AS cy, (-0.5885085 * 200 - 0.3060195 * 100 + 0.8945280 * 50) * 0.5 AS ci, (0.7227111 * 200 - 1.3898515 * 100 + 0.6671403 * 50) * 0.5 AS cq),
k AS (SELECT 127.5 * (0.5146329 + 1.2303905 + 0.2588982) AS my, 127.5 * (-0.5885085 - 0.3060195 + 0.8945280) AS mi, 127.5 * (0.7227111 - 1.3898515 + 0.6671403) AS mq, 5418.75 * (0.5146329 ** 2 + 1.2303905 ** 2 + 0.2588982 ** 2) AS vy, 5418.75 * (0.5885085 ** 2 + 0.3060195 ** 2 + 0.8945280 ** 2) AS vi, 5418.75 * (0.7227111 ** 2 + 1.3898515 ** 2 + 0.6671403 ** 2) AS vq)
SELECT img, x, y, round(400 * ((p.cy - q.cy) ** 2 + (p.ci - q.ci) ** 2 + (p.cq - q.cq) ** 2) + 400 * (p.a - q.a) ** 2 * (my ** 2 + vy + mi ** 2 + vi + mq ** 2 + vq) - 800 * (p.a - q.a) * (my * (p.cy - q.cy) + mi * (p.ci - q.ci) + mq * (p.cq - q.cq)), 3) + 0.0 AS d FROM p, q, k"""))
def alpha_distances(spark, d):
    """Distance from half opaque (200, 100, 50), over any background."""
    p = C.yiq(c("r"), c("g"), c("b"), c("a"))
    q = C.yiq(F.lit(200), F.lit(100), F.lit(50), F.lit(127.5))
    return R.pixel(spark, d).select("img", "x", "y", (F.round(C.alpha_distance(p, q), 3) + 0.0).alias("d"))


@query("layered_distances", sql("pixel", f"WITH p AS (SELECT img, x, y, {_YIQ} FROM (SELECT img, x, y, {_DBL} FROM pixel)) SELECT img // 3 AS stack, x, y, round(sum(400 * (cy * cy + ci * ci + cq * cq)), 2) AS d FROM p GROUP BY ALL"))
def layered_distances(spark, d):
    """Distance from black of pixels with a layer an image, three images a stack."""
    p = Q.with_yiq(R.pixel(spark, d)).withColumn("stack", F.expr("img div 3"))
    black = (F.lit(0.0),) * 3
    return Q.layered_distance(p, ["stack", "x", "y"], C.distance((c("cy"), c("ci"), c("cq")), black)).withColumn("d", F.round("d", 2))


@query("palettes_by_lightness", """
WITH b AS (SELECT p_partkey // 16 AS pal, CAST(p_partkey * 37 % 256 AS DOUBLE) AS r, CAST(p_partkey * 91 % 256 AS DOUBLE) AS g, CAST(p_size * 5 AS DOUBLE) AS b, CASE WHEN p_partkey // 16 % 5 = 0 THEN 0.0 WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 128 / 255.0 END AS a FROM part),
s AS (SELECT pal, sum((0.5146329 * r + 1.2303905 * g + 0.2588982 * b) * a) AS y, sum(a) AS a FROM b GROUP BY pal)
SELECT pal, row_number() OVER (ORDER BY CASE WHEN a > 0 THEN round(y / a, 6) END NULLS FIRST, pal) - 1 AS place FROM s""")
def palettes_by_lightness(spark, d):
    return Q.by_lightness(R.table(spark, d, "part").selectExpr("p_partkey div 16 AS pal", "p_partkey * 37 % 256 AS r", "p_partkey * 91 % 256 AS g", "p_size * 5L AS b", "CASE WHEN p_partkey div 16 % 5 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN 255 ELSE 128 END AS a"))


@query("sort_palette_frequency", sql("tile_dup screen_cell palette", """
WITH u AS (SELECT p.idx AS idx, count(*) AS n FROM screen_cell s JOIN tile_dup t ON s.raw % 1024 = t.tile_no JOIN palette p ON p.idx = (s.raw // 4096) * 16 + t.idx GROUP BY p.idx)
SELECT palette.idx, row_number() OVER (ORDER BY coalesce(n, 0) DESC, palette.idx) - 1 AS place FROM palette LEFT JOIN u USING (idx)"""))
def sort_palette_frequency(spark, d):
    used = L.palette_usage(R.screen_cell(spark, d), R.tile_dup(spark), R.palette(spark, d))
    own = R.palette(spark, d).select("idx").join(used, "idx", "left").withColumn("f", -F.coalesce("n", F.lit(0)))
    return B.sorted_palette(own, ["f"])


@query("closest_palettes", f"""
WITH b AS (SELECT p_partkey // 32 AS file, p_partkey % 32 // 4 AS pal, p_partkey % 4 AS pos, CAST(p_partkey * 37 % 256 AS DOUBLE) AS r, CAST(p_partkey * 91 % 256 AS DOUBLE) AS g, CAST(p_size * 5 AS DOUBLE) AS b FROM part), c AS (SELECT file, pal, pos, {_YIQ} FROM b),
u AS (SELECT DISTINCT file, pal, pal % 2 AS type, pal + 1 AS n FROM b),
x AS (SELECT u.file, u.pal AS p, v.pal AS q, round(sum(400 * ((c.cy - e.cy) ** 2 + (c.ci - e.ci) ** 2 + (c.cq - e.cq) ** 2)) * (u.n + v.n), 4) AS d FROM u JOIN v2 v ON u.file = v.file AND u.type = v.type AND u.pal < v.pal JOIN c ON c.file = u.file AND c.pal = u.pal JOIN c e ON e.file = v.file AND e.pal = v.pal AND e.pos = c.pos GROUP BY u.file, u.pal, v.pal, u.n, v.n)
SELECT file, arg_min(p, (d, p, q)) AS p, arg_min(q, (d, p, q)) AS q, min(d) AS d FROM x GROUP BY file""".replace("JOIN v2 v", "JOIN u v"))
def closest_palettes(spark, d):
    b = R.table(spark, d, "part").selectExpr("p_partkey div 32 AS file", "p_partkey % 32 div 4 AS pal", "p_partkey % 4 AS pos", "p_partkey * 37 % 256 AS r", "p_partkey * 91 % 256 AS g", "p_size * 5L AS b")
    return Q.closest_palettes(b, b.selectExpr("file", "pal", "pal % 2 AS type", "pal + 1 AS n").distinct())


@query("principal_order", sql("pixel_q", "SELECT r, g, b, count(*) AS w FROM pixel_q GROUP BY r, g, b"))
def principal_order(spark, d):
    """Colours in order of their principal score; what SQL can hold it against are the colours, the order is tested by itself."""
    return Q.principal_order(Q.histogram(R.pixel_q(spark, d))).select("r", "g", "b", "w")


@query("palette_turns", sql("palette", """
WITH n AS (SELECT max(idx) + 1 AS size FROM palette) SELECT idx, replica, CASE WHEN idx = 0 THEN 0 ELSE (idx - 1 + replica * 5) % (size - 1) + 1 END AS place, CASE WHEN idx = 0 THEN (510 * (color % 32) + 31) // 62 END AS kept FROM palette, n, range(1, 4) t(replica)"""))
def palette_turns(spark, d):
    """Where entries go when a palette is turned by five for each replica, the first one kept."""
    from ..functions.palette_ops import rotate

    return rotate(R.palette(spark, d), hue=50, saturation=-10, value=15, replicas=3, turn=5, keep_first=True).select("idx", "replica", "place", F.when(c("idx") == 0, c("r")).alias("kept"))


@query("layout_words", "SELECT o_orderkey AS id, CASE WHEN w % 4096 >= 2048 THEN w % 4096 - 4096 ELSE w % 4096 END AS pos, w // 4096 % 4 AS origin, w // 16384 AS align, w AS packed FROM (SELECT o_orderkey, o_orderkey * 40503 % 65536 AS w FROM orders)")
def layout_words(spark, d):
    raw = F.expr("o_orderkey * 40503 % 65536")
    (pos, origin), align = P.layout_coordinate(raw), P.layout_alignment(raw)
    return R.table(spark, d, "orders").select(c("o_orderkey").alias("id"), pos.alias("pos"), origin.alias("origin"), align.alias("align"), P.layout_word(pos, origin, align).alias("packed"))


def _frames_sql():
    away = lambda n, a, b: f"CAST(({a} * 2 * (6 - i) + {b} * 2 * (i + 1) + CASE WHEN {a} * 2 * (6 - i) + {b} * 2 * (i + 1) < 0 THEN -7 ELSE 7 END) // 14 AS BIGINT) AS {n}"
    return f"""WITH p AS (SELECT p_partkey AS id, p_size % 50 AS i0, p_partkey % 64 AS i1, p_size * 7 - 170 AS x0, p_partkey % 300 - 150 AS x1, p_size * 300 % 65536 AS r0, p_partkey * 997 % 65536 AS r1, 4096 + p_size * 10 AS s0, 2048 - p_size * 100 AS s1 FROM part)
    SELECT id, i, (i0 * 2 * (6 - i) + i1 * 2 * (i + 1) + 7) // 14 AS "index", {away("px", "x0", "x1")}, {away("sx", "s0", "s1")}, (r0 * 2 * (6 - i) + CASE WHEN r1 < r0 THEN r1 + 65536 ELSE r1 END * 2 * (i + 1) + 7) // 14 % 65536 AS rot_z FROM p, range(6) t(i)"""


@query("frame_interpolation", _frames_sql())
def frame_interpolation(spark, d):
    p = R.table(spark, d, "part").selectExpr("p_partkey AS id", "100L AS total", "CAST(p_size % 50 AS BIGINT) AS index0", "p_partkey % 64 AS index1", "p_size * 7L - 170 AS px0", "p_partkey % 300 - 150 AS px1", "0L AS py0", "0L AS py1", "4096L + p_size * 10 AS sx0", "2048L - p_size * 100 AS sx1", "4096L AS sy0", "4096L AS sy1", "p_size * 300L % 65536 AS rot_z0", "p_partkey * 997 % 65536 AS rot_z1")
    return S.interpolated_frames(p, 6, True).select("id", "i", "index", "px", "sx", "rot_z")


@query("unswizzle", "SELECT o_orderkey AS id, p // 1024 % 2 * 32 + p % 32 AS x, p // 2048 * 32 + p % 1024 // 32 AS y FROM (SELECT o_orderkey, o_orderkey % 4096 AS p FROM orders)")
def unswizzle(spark, d):
    x, y = S.unswizzled(c("o_orderkey") % 4096, 64)
    return R.table(spark, d, "orders").select(c("o_orderkey").alias("id"), x.alias("x"), y.alias("y"))


def _fitted_sql(w, h, dx, dy, out_w, out_h):
    s = "least((x + 1) * {w}, (u + 1) * 64) - greatest(x * {w}, u * 64)".format(w=w) + ") * (" + "least((y + 1) * {h}, (v + 1) * 64) - greatest(y * {h}, v * 64)".format(h=h)
    mean = lambda ch: f"CAST(coalesce((2 * sum(s * a * {ch}) + sum(s * a)) // nullif(2 * sum(s * a), 0), 0) AS BIGINT) AS {ch}"
    return sql("pixel", f"WITH u AS (SELECT *, unnest(range(x * {w} // 64, (x * {w} + {w - 1}) // 64 + 1)) AS u FROM pixel), v AS (SELECT *, unnest(range(y * {h} // 64, (y * {h} + {h - 1}) // 64 + 1)) AS v FROM u), s AS (SELECT *, ({s}) AS s FROM v), "
               f"o AS (SELECT img, u - {dx} AS x, v - {dy} AS y, {mean('r')}, {mean('g')}, {mean('b')}, CAST((2 * sum(s * a) + sum(s)) // (2 * sum(s)) AS BIGINT) AS a FROM s WHERE s > 0 GROUP BY img, u, v) SELECT * FROM o WHERE x BETWEEN 0 AND {out_w - 1} AND y BETWEEN 0 AND {out_h - 1}")


@query("cover_scale", _fitted_sql(40, 40, 0, 8, 40, 24))
def cover_scale(spark, d):
    return S.fitted(R.pixel(spark, d), 64, 64, 40, 24, True)


@query("fit_scale", _fitted_sql(24, 24, -8, 0, 40, 24))
def fit_scale(spark, d):
    return S.fitted(R.pixel(spark, d), 64, 64, 40, 24, False)


@query("glyph_widths", sql("tile_px", "SELECT tile_no, coalesce(max(CASE WHEN idx % 3 <> 0 AND pos % 8 < tile_no % 9 THEN pos % 8 + 1 END), 0) AS width FROM tile_px GROUP BY tile_no"))
def glyph_widths(spark, d):
    return D.used_widths(R.tile_px(spark, d).selectExpr("tile_no", "pos", "CASE WHEN pos % 8 < tile_no % 9 THEN idx % 3 ELSE 0 END AS idx"))


@query("glyph_dedup", sql("tile_copies", "WITH f AS (SELECT tile_no, tile_no % 2 AS width, list(idx ORDER BY pos) AS px FROM tile_copies GROUP BY tile_no) SELECT f.tile_no, m.first FROM f JOIN (SELECT px, width, min(tile_no) AS first FROM f GROUP BY ALL) m ON m.px = f.px AND m.width = f.width"))
def glyph_dedup(spark, d):
    """The first glyph with the same picture and the same width."""
    g = D.tile_arrays(R.tile_copies(spark, d)).withColumn("width", c("tile_no") % 2)
    return D.first_equal(g, ["px", "width"], "tile_no").select("tile_no", "first")


@query("code_maps")
def code_maps(spark, d):
    """Runs of codes of every font, made one where that saves."""
    k = R.table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("font"), c("l_partkey").alias("code")).agg(F.min("l_partkey").alias("glyph"))
    return D.merge_code_runs(D.code_runs(k, "font"), "font")


@query("object_forest", """
WITH e AS (SELECT o_custkey AS f, o_orderkey % 7 AS t, o_orderkey AS k, o_orderkey % 3 = 0 AS off FROM orders),
l AS (SELECT f, arg_max(t, k) AS t, max(k) AS since FROM e WHERE NOT off GROUP BY f), u AS (SELECT f, t, max(k) AS until FROM e WHERE off GROUP BY f, t)
SELECT l.f AS from_id, l.t AS to_id FROM l LEFT JOIN u ON u.f = l.f AND u.t = l.t WHERE until IS NULL OR until < since""")
def object_forest(spark, d):
    return B.forest(R.table(spark, d, "orders").selectExpr("o_custkey AS from_id", "o_orderkey % 7 AS to_id", "o_orderkey AS at", "CASE WHEN o_orderkey % 3 = 0 THEN 'unlink' ELSE 'link' END AS what"))


@query("image_errors", sql("pixel", f"""
WITH {_PAL8}, p AS (SELECT img, x, y, {_YIQ} FROM (SELECT img, x, y, {_DBL} FROM pixel WHERE a >= 128)),
n AS (SELECT img, x, y, min(round(400 * (p.cy - py.cy) ** 2 + 400 * (p.ci - py.ci) ** 2 + 400 * (p.cq - py.cq) ** 2, 6)) AS d FROM p, py GROUP BY img, x, y)
SELECT img, round(sum(d), 1) AS error, round(max(d), 3) AS worst FROM n GROUP BY img"""))
def image_errors(spark, d):
    return Q.image_errors(R.pixel(spark, d), PALETTE24).select("img", F.round("error", 1).alias("error"), F.round("worst", 3).alias("worst"))


@query("textures_by_name", "WITH t AS (SELECT p_partkey AS id, substr(p_name, 1, 16) AS k FROM part), f AS (SELECT k, min(id) AS found FROM t WHERE id % 3 = 0 GROUP BY k) SELECT t.id, coalesce(f.found, -1) AS found FROM t LEFT JOIN f USING (k)")
def textures_by_name(spark, d):
    p = R.table(spark, d, "part").select(c("p_partkey").alias("id"), c("p_name").alias("name"))
    return L.by_name(p, p.where("id % 3 = 0").withColumnRenamed("id", "found"))


@query("palette_bytes", "SELECT count(*) AS n_palettes, CAST(2 * sum(p_size * 4) AS BIGINT) AS bytes FROM part")
def palette_bytes(spark, d):
    return A.palette_bytes(R.table(spark, d, "part").selectExpr("p_size * 4 AS n_colors"))


# ------------------------------------------------------------------ bytes and files

from ..functions import codecs as K  # noqa: E402
from ..sources import files as W  # noqa: E402
from ..sources import objects as O  # noqa: E402


def _files(spark, d):
    """Documents' texts as files."""
    return R.table(spark, d, "documents").where("text IS NOT NULL").select(c("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("bytes"))


def _coded_query(kind):
    def run(spark, d):
        """Packed and unpacked again within one pass; what comes back is known by its hash."""
        back = K.coded(_files(spark, d), "bytes", lambda x: K.UNPACK[kind](K.PACK[kind](x)), name="plain", keep=("path",))
        return back.select("path", F.md5("plain").alias("md5"), F.length("plain").cast(BIG).alias("n"))

    return run


for _kind in ("lz", "lz_magic", "lzx", "runs", "huffman4", "huffman8", "diff8", "diff16", "segments", "choice"):
    query(f"codec_{_kind}", "SELECT CAST(doc_id AS VARCHAR) AS path, md5(text) AS md5, strlen(text) AS n FROM documents WHERE text IS NOT NULL")(_coded_query(_kind))


@query("smallest_codec")
def smallest_codec(spark, d):
    return K.coded(_files(spark, d), "bytes", lambda x: K.smallest(x)[0], "string", keep=("path",))


#: The codecs that the documents are packed by in turn, to be found again.
_TURNS = ("runs", "lz", "lzx", "huffman8", "diff8", "lz_magic", "segments")


@query("detect_codec", f"SELECT CAST(doc_id AS VARCHAR) AS path, {list(_TURNS)}[doc_id % {len(_TURNS)} + 1] AS codec, md5(text) AS md5, strlen(text) AS n FROM documents WHERE text IS NOT NULL")
def detect_codec(spark, d):
    files = _files(spark, d)
    packed = None
    for k, kind in enumerate(_TURNS):
        own = K.coded(files.where(c("path").cast(BIG) % len(_TURNS) == k), "bytes", K.PACK[kind], name="bytes", keep=("path",))
        packed = own if packed is None else packed.unionByName(own)
    return O.unpacked(packed).select("path", "codec", F.md5("bytes").alias("md5"), F.length("bytes").cast(BIG).alias("n"))


@query("crc16", sql("byte_seq", "SELECT CAST(doc_id AS VARCHAR) AS path, CAST(list_reduce(list(b ORDER BY pos), lambda s, b: xor(xor(s, b) >> 8, xor(xor(xor(s, b) & 255, (xor(s, b) & 255) * 0)::BIGINT * 0, list_reduce(range(8), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 40961) ELSE v // 2 END, xor(s, b) & 255))), 65535) AS BIGINT) AS crc FROM byte_seq GROUP BY doc_id").replace("xor(xor(xor(s, b) & 255, (xor(s, b) & 255) * 0)::BIGINT * 0, list_reduce", "(list_reduce"))
def crc16(spark, d):
    return K.coded(_files(spark, d).where("length(bytes) > 0"), "bytes", K.crc16, "long", "crc", ("path",))


@query("huffman_lengths", sql("byte_seq", """
WITH RECURSIVE n AS (SELECT b, count(*) AS n FROM byte_seq GROUP BY b),
s AS (SELECT list_sort(list({'n': n, 's': -b, 'm': [b]})) AS h, list_transform(range(256), lambda x: 0) AS bits FROM n
 UNION ALL SELECT list_sort(list_append(h[3:], {'n': h[1].n + h[2].n, 's': greatest(h[1].s, h[2].s), 'm': list_concat(h[1].m, h[2].m)})), list_transform(bits, lambda x, k: x + CASE WHEN list_contains(h[1].m, k - 1) OR list_contains(h[2].m, k - 1) THEN 1 ELSE 0 END) FROM s WHERE len(h) > 1),
l AS (SELECT unnest(range(256)) AS symbol, unnest(bits) AS bits FROM s WHERE len(h) = 1)
SELECT symbol, CAST(coalesce(sum(pow(2.0, -bits)) OVER (ORDER BY bits, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * pow(2, bits) AS BIGINT) AS code, CAST(bits AS BIGINT) AS bits FROM l WHERE bits > 0""").replace("WITH byte_seq", "WITH RECURSIVE byte_seq", 1).replace(", RECURSIVE n AS", ", n AS", 1))
def huffman_lengths(spark, d):
    """Canonical codes of all documents' bytes: counts by the engine, a tree of 256 leaves at most on the driver."""
    counts = {r["b"]: r["n"] for r in K.byte_counts(_files(spark, d), "bytes").collect()}
    codes = K.canonical(K.code_lengths(counts))
    return spark.createDataFrame([(s, code, bits) for s, (code, bits) in sorted(codes.items())], "symbol long, code long, bits long")


def _confidence_sql():
    """Every registered format, scored as plain sums of what its checks look at."""
    weight = {"header": 100, "footer": 50, "signature": 400, "chunked": 100, "checksum": 200, "compression": 50, "size": 25, "over_host": 475}
    values = ", ".join(f"({k}, '{kind}', '{name}', {sum(weight.get(x, 0) for x in checks)})" for k, (kind, name, checks) in enumerate(O.FORMATS))
    return f"""WITH f(id, type, name, confidence) AS (VALUES {values}), s AS (SELECT s_suppkey AS path, s_nationkey AS k FROM supplier)
    SELECT CAST(path AS VARCHAR) AS path, type, name, CAST(confidence AS BIGINT) AS confidence, row_number() OVER (PARTITION BY path ORDER BY confidence DESC, id) AS place FROM s JOIN f ON (f.id + s.path) % 11 = s.k % 11"""


@query("format_confidence", _confidence_sql())
def format_confidence(spark, d):
    files = R.table(spark, d, "supplier").select(c("s_suppkey").cast("string").alias("path"), c("s_suppkey").alias("p"), c("s_nationkey").alias("k"))
    found = O.identify(files, O.registry(spark), (c("id") + c("p")) % 11 == c("k") % 11)
    return found.select("path", "type", "name", "confidence", "place")


# ---- files of objects: parts as palettes, orders as tiles, screens, records and nodes, events as animations

#: Formats that the files of a kind are written in, in turn.
_PALETTES = ("NCLR", "NCL", "5PL", "5PC", "Tose", "Hudson", "Binary", "NTFP")
_CHARACTERS = ("NCGR", "NCG", "ICG", "ACG", "Tose", "Hudson", "Hudson 2", "Slices", "Setosa", "Binary")
_SCREENS = ("NSCR", "NSC", "ISC", "ASC", "Tose", "Hudson", "Hudson 2")
#: Endings of the palettes' paths: raw ones are known by them alone.
_ENDINGS = (".nclr", ".ncl", ".5pl", ".5pc", ".x", ".y", ".pal", ".ntfp")


def _written(rows, kind, names):
    """Files (path, bytes): ``rows`` with a number ``file``, written in the formats in turn."""
    out = None
    for k, name in enumerate(names):
        own = W.write(rows.where(c("file") % len(names) == k).drop("file"), kind, name)
        out = own if out is None else out.unionByName(own)
    return out


def _palette_rows(spark, d):
    part = R.table(spark, d, "part").selectExpr("p_partkey div 64 AS file", "p_partkey % 64 AS idx", "(p_partkey * 7919 + p_size * 31) % 32768 AS color")
    grid = part.select("file").distinct().withColumn("idx", F.explode(F.sequence(F.lit(0).cast(BIG), F.lit(63).cast(BIG))))
    endings = F.element_at(F.array(*map(F.lit, _ENDINGS)), (c("file") % len(_ENDINGS) + 1).cast("int"))
    return grid.join(part, ["file", "idx"], "left").select("file", F.concat(c("file").cast("string"), endings).alias("path"), "idx", F.coalesce("color", F.lit(0)).alias("color"))


_PALETTE_FILES = f"p AS (SELECT f.file, CAST(f.file AS VARCHAR) || {list(_ENDINGS)}[f.file % {len(_ENDINGS)} + 1] AS path, i AS idx, coalesce((p_partkey * 7919 + p_size * 31) % 32768, 0) AS color FROM (SELECT DISTINCT p_partkey // 64 AS file FROM part) f CROSS JOIN range(64) t(i) LEFT JOIN part ON p_partkey = f.file * 64 + i)"


@query("palette_files", f"WITH {_PALETTE_FILES} SELECT path, idx, color FROM p")
def palette_files(spark, d):
    """Palettes of 64 colours through eight formats."""
    return W.read(_written(_palette_rows(spark, d), "palette", _PALETTES), "palette")


@query("identify_files", f"WITH {_PALETTE_FILES} SELECT path, ['none', 'lz', 'runs'][min(file) // 8 % 3 + 1] AS codec, 'palette' AS kind, {list(_PALETTES)}[min(file) % 8 + 1] AS format FROM p GROUP BY path")
def identify_files(spark, d):
    """The whole way: a codec undone, endings, checks, guesses."""
    files = _written(_palette_rows(spark, d), "palette", _PALETTES).withColumn("file", F.regexp_extract("path", r"^(\d+)", 1).cast(BIG))
    turn = F.expr("file div 8 % 3")
    packed = files.where(turn == 0).select("path", "bytes")
    for k, kind in ((1, "lz"), (2, "runs")):
        packed = packed.unionByName(K.coded(files.where(turn == k), "bytes", K.PACK[kind], name="bytes", keep=("path",)).select("path", "bytes"))
    return W.identify(packed)


def _identify_sql():
    # The formats as which a palette of 64 colours in each format reads, with their confidence: its size decides for those that check nothing.
    raw, any_, px = ("palette", "Binary", 0), ("palette", "NTFP", 0), ("character", "Binary", 0)
    found = {"NCLR": [("palette", "NCLR", 600), any_], "NCL": [("palette", "NCL", 600), raw, any_, px], "5PL": [("palette", "5PL", 600), any_], "5PC": [("palette", "5PC", 600), any_], "Tose": [("palette", "Tose", 500), any_], "Hudson": [("palette", "Hudson", 100), any_], "Binary": [raw, any_, px], "NTFP": [raw, any_, px]}
    values = ", ".join(f"({k}, {place}, '{kind}', '{name}', {n})" for k, key in enumerate(_PALETTES) for place, (kind, name, n) in enumerate(found[key], 1))
    return f"WITH {_PALETTE_FILES}, v(k, place, kind, format, confidence) AS (VALUES {values}) SELECT path, CAST(place AS BIGINT) AS place, kind, format, CAST(confidence AS BIGINT) AS confidence FROM (SELECT DISTINCT file, path FROM p) x JOIN v ON v.k = x.file % 8"


@query("identify_formats", _identify_sql())
def identify_formats(spark, d):
    """Every format as which a file reads, by the formats' own checks."""
    return W.formats_of(_written(_palette_rows(spark, d), "palette", _PALETTES))


@query("character_files", sql("tile_px", "SELECT CAST(t.tile_no // 16 AS VARCHAR) AS path, t.tile_no % 16 AS tile_no, p AS pos, coalesce(x.idx, 0) AS idx FROM (SELECT DISTINCT tile_no FROM tile_px) t CROSS JOIN range(64) b(p) LEFT JOIN tile_px x ON x.tile_no = t.tile_no AND x.pos = p"))
def character_files(spark, d):
    """Graphics of 16 tiles through ten formats."""
    rows = R.tile_px(spark, d).selectExpr("tile_no div 16 AS file", "CAST(tile_no div 16 AS STRING) AS path", "tile_no % 16 AS tile_no", "pos", "idx")
    return W.read(_written(rows, "character", _CHARACTERS), "character")


@query("screen_files", "SELECT CAST(f.file AS VARCHAR) AS path, 40 AS width, 30 AS height, i AS cell, coalesce(o_custkey * 40503 % 65536, 0) AS raw FROM (SELECT DISTINCT o_orderkey // 1200 AS file FROM orders) f CROSS JOIN range(1200) t(i) LEFT JOIN orders ON o_orderkey = f.file * 1200 + i")
def screen_files(spark, d):
    """Screens of 40 by 30 cells through seven formats, in panels or not."""
    rows = R.table(spark, d, "orders").selectExpr("o_orderkey div 1200 AS file", "CAST(o_orderkey div 1200 AS STRING) AS path", "40L AS width", "30L AS height", "o_orderkey % 1200 AS cell", "o_custkey * 40503 % 65536 AS raw")
    return W.read(_written(rows, "screen", _SCREENS), "screen")


@query("cell_files", sql("sprite", "SELECT CAST(cell // 16 AS VARCHAR) AS path, cell % 16 AS cell, cell % 3 AS cell_attr, n, attr0, attr1, attr2 FROM sprite"))
def cell_files(spark, d):
    rows = R.sprite(spark, d).selectExpr("CAST(cell div 16 AS STRING) AS path", "cell % 16 AS cell", "cell % 3 AS cell_attr", "n", "attr0", "attr1", "attr2")
    return W.read(W.write(rows, "cell", "NCER"), "cell")


@query("animation_files", sql("anim_frame", "SELECT CAST(seq // 8 AS VARCHAR) AS path, seq % 8 AS seq, 0 AS start, 1 AS type, mode, frame_no, duration, cell AS \"index\", CASE seq % 3 WHEN 1 THEN frame_no * 100 % 65536 ELSE 0 END AS rot_z, 4096 AS sx, CASE seq % 3 WHEN 1 THEN 4096 + cell ELSE 4096 END AS sy, CASE seq % 3 WHEN 2 THEN cell - 20 ELSE 0 END AS px, 0 AS py FROM anim_frame"))
def animation_files(spark, d):
    """Animations in their narrowest frame types: indices, with scale and turn, with offsets."""
    rows = R.anim_frame(spark, d).selectExpr("CAST(seq div 8 AS STRING) AS path", "seq % 8 AS seq", "0L AS start", "1L AS type", "mode", "frame_no", "duration", "cell AS index", "CASE seq % 3 WHEN 1 THEN frame_no * 100 % 65536 ELSE 0 END AS rot_z", "4096L AS sx", "CASE seq % 3 WHEN 1 THEN 4096 + cell ELSE 4096 END AS sy", "CASE seq % 3 WHEN 2 THEN cell - 20 ELSE 0 END AS px", "0L AS py")
    return W.read(W.write(rows, "animation", "NANR"), "animation")


@query("multicell_files", "SELECT CAST(o_orderkey // 128 AS VARCHAR) AS path, o_orderkey // 8 % 16 AS mc, o_orderkey % 8 AS node, o_custkey % 65536 AS seq, o_orderkey % 200 - 100 AS x, o_custkey % 90 - 45 AS y, o_orderkey % 4 AS attr FROM orders")
def multicell_files(spark, d):
    rows = R.table(spark, d, "orders").selectExpr("CAST(o_orderkey div 128 AS STRING) AS path", "o_orderkey div 8 % 16 AS mc", "o_orderkey % 8 AS node", "o_custkey % 65536 AS seq", "o_orderkey % 200 - 100 AS x", "o_custkey % 90 - 45 AS y", "o_orderkey % 4 AS attr")
    return W.read(W.write(rows, "multicell", "NMCR"), "multicell")


@query("texture_files", """
WITH f AS (SELECT o_orderkey // 64 AS file, count(*) AS n FROM orders GROUP BY ALL),
r AS (SELECT file, 0 AS part, k AS place, [4, 8, 8, 0, 0][k + 1] AS value FROM f, range(5) t(k) UNION ALL SELECT o_orderkey // 64, 1, o_orderkey % 64, o_custkey % 256 FROM orders WHERE o_orderkey // 64 IN (SELECT file FROM f WHERE n = 64) UNION ALL SELECT file, 1, k, 0 FROM f, range(64) t(k) WHERE n < 64 UNION ALL SELECT file, 3, k, (file * 7919 + k * 31) % 32768 FROM f, range(16) t(k))
SELECT CAST(file AS VARCHAR) AS path, part, place, value FROM r""")
def texture_files(spark, d):
    """Textures of 8 by 8 with 256 colours at most, in two formats; a texture that lacks orders is blank."""
    o = R.table(spark, d, "orders").selectExpr("o_orderkey div 64 AS file", "o_orderkey % 64 AS place", "o_custkey % 256 AS value")
    f = o.groupBy("file").agg(F.count("*").alias("n"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast(BIG), F.lit(n - 1).cast(BIG))).alias("place")
    head = f.select("file", F.lit(0).cast(BIG).alias("part"), upto(5)).withColumn("value", F.element_at(F.array(*(F.lit(v).cast(BIG) for v in (4, 8, 8, 0, 0))), (c("place") + 1).cast("int")))
    texels = f.where("n = 64").join(o, "file").select("file", F.lit(1).cast(BIG).alias("part"), "place", "value")
    blank = f.where("n < 64").select("file", F.lit(1).cast(BIG).alias("part"), upto(64)).withColumn("value", F.lit(0).cast(BIG))
    colors = f.select("file", F.lit(3).cast(BIG).alias("part"), upto(16)).withColumn("value", (c("file") * 7919 + c("place") * 31) % 32768)
    rows = head.unionByName(texels).unionByName(blank).unionByName(colors).withColumn("path", c("file").cast("string"))
    return W.read(_written(rows, "texture", ("SPT", "To Love Ru")), "texture")


@query("layout_files", "SELECT CAST(o_orderkey // 100 AS VARCHAR) AS path, o_orderkey % 100 AS n, o_custkey % 4096 - 2048 AS x, o_orderkey % 500 - 250 AS y, o_orderkey % 3 AS origin_x, o_custkey % 3 AS origin_y, 0 AS align_x, 0 AS align_y, o_orderkey % 200 AS \"value\", CASE o_orderkey // 100 % 2 WHEN 1 THEN o_custkey % 100 ELSE 0 END AS height FROM orders")
def layout_files(spark, d):
    """Layouts of cells and of regions."""
    rows = R.table(spark, d, "orders").selectExpr("o_orderkey div 100 AS file", "CAST(o_orderkey div 100 AS STRING) AS path", "o_orderkey % 100 AS n", "o_custkey % 4096 - 2048 AS x", "o_orderkey % 500 - 250 AS y", "o_orderkey % 3 AS origin_x", "o_custkey % 3 AS origin_y", "0L AS align_x", "0L AS align_y", "o_orderkey % 200 AS value", "CASE o_orderkey div 100 % 2 WHEN 1 THEN o_custkey % 100 ELSE 0 END AS height")
    return W.read(_written(rows, "layout", ("BNCL", "BNBL")), "layout")


@query("rewritten_files", f"WITH {_PALETTE_FILES} SELECT path, idx, CASE WHEN color < 100 THEN 99 - color ELSE color END AS color FROM p")
def rewritten_files(spark, d):
    """Files changed in place: format, and the codec of every other one, stay what they were."""
    files = _written(_palette_rows(spark, d), "palette", _PALETTES)
    odd = F.regexp_extract("path", r"^(\d+)", 1).cast(BIG) % 16 >= 8
    mixed = W.packed(files.where(odd), "lz").unionByName(files.where(~odd))
    changed = W.rewritten(mixed, lambda kind, rows: [(i, 99 - v if v < 100 else v) for i, v in rows])
    return W.read(changed, "palette")


@query("guess_kinds")
def guess_kinds(spark, d):
    return K.coded(_files(spark, d), "bytes", O.guess_kind, "string", "kind", ("path",))


@query("message_files", "SELECT conv_id AS file_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text FROM conversations")
def message_files(spark, d):
    files = O.write_messages(R.message(spark, d)).select(c("file_id").cast("string").alias("path"), "bytes")
    return O.read_messages(files).select(c("path").cast(BIG).alias("file_id"), "id", "pos", "text")


@query("chunk_list", "SELECT CAST(conv_id AS VARCHAR) AS path, k, s AS signature FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES (0::BIGINT, 'INF1'), (1, 'DAT1'), (2, 'MID1')) v(k, s)")
def chunk_list(spark, d):
    files = O.write_messages(R.message(spark, d)).select(c("file_id").cast("string").alias("path"), "bytes")
    return O.chunks(files).select("path", "k", "signature")


@query("raw_palettes", sql("palette", "SELECT idx // 16 AS bank, idx % 16 AS idx, color FROM palette"))
def raw_palettes(spark, d):
    rows = R.palette(spark, d).selectExpr("idx div 16 AS bank", "idx % 16 AS i", "color")
    return O.read_palettes(O.write_u16(rows, "bank", "i", "color").withColumnRenamed("bank", "path")).withColumnRenamed("path", "bank")


@query("raw_screens", sql("screen_cell", "SELECT cell // 1024 AS path, cell % 1024 AS cell, raw FROM screen_cell"))
def raw_screens(spark, d):
    rows = R.screen_cell(spark, d).selectExpr("cell div 1024 AS path", "cell % 1024 AS i", "raw")
    return O.read_screens(O.write_u16(rows, "path", "i", "raw"))


@query("raw_characters", sql("byte_seq", "SELECT CAST(doc_id AS VARCHAR) AS path, (2 * pos + h) // 64 AS tile_no, CAST(sum(((2 * pos + h) % 64 + 1) * CASE h WHEN 0 THEN b % 16 ELSE b // 16 END) AS BIGINT) AS total FROM byte_seq, (VALUES (0), (1)) v(h) GROUP BY ALL"))
def raw_characters(spark, d):
    px = O.read_characters(_files(spark, d).where("length(bytes) > 0"))
    return px.groupBy("path", "tile_no").agg(F.sum((c("pos") + 1) * c("idx")).alias("total"))


@query("file_slices", "SELECT CAST(doc_id AS VARCHAR) AS path, p AS part, md5(from_hex(substr(hex(encode(text)), CAST(2 * (strlen(text) // 4) * p + 1 AS BIGINT), CASE p WHEN 3 THEN 2 * strlen(text) ELSE 2 * (strlen(text) // 4) END))) AS md5 FROM documents, range(4) t(p) WHERE text IS NOT NULL")
def file_slices(spark, d):
    """Four slices of each file, the last with what division leaves."""
    files = _files(spark, d)
    quarter, part = F.expr("length(bytes) div 4"), F.explode(F.sequence(F.lit(0).cast(BIG), F.lit(3).cast(BIG)))
    specs = files.select("path", F.length("bytes").alias("all"), quarter.alias("quarter"), part.alias("part")).select("path", "part", (c("part") * c("quarter")).alias("offset"), F.when(c("part") == 3, c("all") - c("quarter") * 3).otherwise(c("quarter")).alias("size"))
    return O.slices(files, specs).select("path", "part", F.md5("bytes").alias("md5"))


# ------------------------------------------------------------------ textures, text, backgrounds

from ..functions import text as T  # noqa: E402
from ..functions import texture as X  # noqa: E402
from ..operators import background as B  # noqa: E402


@query("texel_a3i5", sql("pixel palette", "SELECT img, x, y, coalesce(color, 0) AS color, (((r // 32) * 4 + (r // 32) // 2) * 510 + 31) // 62 AS a FROM pixel LEFT JOIN palette ON idx = r % 32"))
def texel_a3i5(spark, d):
    i, a = X.a3i5(c("r"))
    px = R.pixel(spark, d).select("img", "x", "y", i.alias("idx"), a.alias("a"))
    return px.join(L.within(R.palette(spark, d)), "idx", "left").select("img", "x", "y", F.coalesce("color", F.lit(0)).alias("color"), "a")


@query("texel_a5i3", sql("pixel palette", "SELECT img, x, y, coalesce(color, 0) AS color, ((r // 8) * 510 + 31) // 62 AS a FROM pixel LEFT JOIN palette ON idx = r % 8"))
def texel_a5i3(spark, d):
    i, a = X.a5i3(c("r"))
    px = R.pixel(spark, d).select("img", "x", "y", i.alias("idx"), a.alias("a"))
    return px.join(L.within(R.palette(spark, d)), "idx", "left").select("img", "x", "y", F.coalesce("color", F.lit(0)).alias("color"), "a")


@query("texel_indexed", sql("pixel", "SELECT img, x, y, (r >> (CAST(x % 4 AS INT) * 2)) % 4 AS i2, (r >> (CAST(x % 2 AS INT) * 4)) % 16 AS i4, CASE WHEN r % 4 = 0 AND img % 2 = 0 THEN 0 ELSE 255 END AS a FROM pixel"))
def texel_indexed(spark, d):
    return R.pixel(spark, d).select("img", "x", "y", X.indexed(c("r"), c("x"), 2).alias("i2"), X.indexed(c("r"), c("x"), 4).alias("i4"), X.indexed_opacity(c("r") % 4, c("img") % 2 == 0).alias("a"))


@query("texel_direct", sql("pixel", "SELECT img, x, y, (510 * (v % 32) + 31) // 62 AS r, (510 * ((v // 32) % 32) + 31) // 62 AS g, (510 * ((v // 1024) % 32) + 31) // 62 AS b, v // 32768 * 255 AS a FROM (SELECT *, r + 256 * g AS v FROM pixel)"))
def texel_direct(spark, d):
    r, g, b, a = X.direct(c("r") + c("g") * 256)
    return R.pixel(spark, d).select("img", "x", "y", r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))


def _block_sql():
    mix = lambda p: f"(510 * ((126 * ((c0 * {8 - p} + c1 * {p} + 4) // 8) + 255) // 510) + 63) // 126"
    return sql("pixel", f"WITH k AS (SELECT img, x, y, b % 4 AS v, a % 2 = 0 AS mixed, g % 2 = 0 AS whole, r AS c0, g AS c1, b AS c2, (r + g) % 256 AS c3 FROM pixel) SELECT img, x, y, CASE v WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN CASE WHEN mixed AND whole THEN {mix(3)} WHEN mixed THEN {mix(4)} ELSE c2 END ELSE CASE WHEN NOT whole THEN 0 WHEN mixed THEN {mix(5)} ELSE c3 END END AS r, CASE WHEN v = 3 AND NOT whole THEN 0 ELSE 255 END AS a FROM k")


@query("texel_block", _block_sql())
def texel_block(spark, d):
    colors = [(v, v, v) for v in (c("r"), c("g"), c("b"), (c("r") + c("g")) % 256)]
    r, _, _, a = X.block(c("b") % 4, colors, c("a") % 2 == 0, c("g") % 2 == 0)
    return R.pixel(spark, d).select("img", "x", "y", r.alias("r"), a.alias("a"))


@query("masked15", sql("pixel", f"""
WITH px AS (SELECT img, x, y, r AS pr, g AS pg, b AS pb FROM pixel), l AS (SELECT *, greatest(0, least(31, (62 * pr + 255) // 510 + dr)) AS lr, greatest(0, least(31, (62 * pg + 255) // 510 + dg)) AS lg, greatest(0, least(31, (62 * pb + 255) // 510 + db)) AS lb FROM px, (VALUES (-1), (0), (1)) u(dr), (VALUES (-1), (0), (1)) v(dg), (VALUES (-1), (0), (1)) w(db)),
e AS (SELECT *, CAST((510 * lr + 31) // 62 - pr AS DOUBLE) AS r, CAST((510 * lg + 31) // 62 - pg AS DOUBLE) AS g, CAST((510 * lb + 31) // 62 - pb AS DOUBLE) AS b FROM l), f AS (SELECT *, {_YIQ} FROM e)
SELECT img, x, y, arg_min(lr + lg * 32 + lb * 1024, (round(400 * cy ** 2 + 400 * ci ** 2 + 400 * cq ** 2, 4), lr + lg * 32 + lb * 1024)) AS color FROM f GROUP BY img, x, y"""))
def masked15(spark, d):
    return B.masked15(R.pixel(spark, d)).select("img", "x", "y", "color")


@query("object_links", "SELECT o_custkey AS from_id, arg_max(o_orderkey % 100, o_orderkey) AS to_id FROM orders GROUP BY o_custkey")
def object_links(spark, d):
    return B.linked(R.table(spark, d, "orders").selectExpr("o_custkey AS from_id", "o_orderkey % 100 AS to_id", "o_orderkey AS at"))


@query("message_tags", "SELECT conv_id, turn, text AS back, strlen(text) + 6 AS n FROM conversations")
def message_tags(spark, d):
    m = R.table(spark, d, "conversations")
    tagged = m.select("conv_id", "turn", F.encode(F.concat(F.lit("[Color:7]"), "text"), "UTF-8").alias("t"))
    packed = K.coded(tagged, "t", lambda x: T.compile_text(x.decode()), keep=("conv_id", "turn"))
    back = K.coded(packed, "coded", lambda x: T.decode_text(x), "string", "back", ("conv_id", "turn", "coded"))
    return back.select("conv_id", "turn", F.substring("back", 10, 1 << 30).alias("back"), F.length("coded").cast(BIG).alias("n"))


@query("message_recode", "SELECT conv_id, turn, 2 * length(text) AS n, md5(text) AS md5 FROM conversations")
def message_recode(spark, d):
    """UTF-8 to 16-bit units and back; the texts have no character of two units."""
    m = R.table(spark, d, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("t"))
    wide = K.coded(m, "t", lambda x: T.recode(x, 4, 2), name="w", keep=("conv_id", "turn"))
    back = K.coded(wide, "w", lambda x: T.recode(x, 2, 4), name="b", keep=("conv_id", "turn", "w"))
    return back.select("conv_id", "turn", F.length("w").cast(BIG).alias("n"), F.md5("b").alias("md5"))


@query("name_hashes", """
SELECT p_partkey AS id, CAST(xor(list_reduce(list_transform(string_split(p_name, ''), lambda x: CAST(unicode(x) AS BIGINT)), lambda h, b: ((((xor(h, b) >> 5) | (xor(h, b) << 11)) & 65535) + ((((xor(h, b) >> 5) | (xor(h, b) << 11)) & 65535) >> 8)) & 65535, CAST(0 AS BIGINT)), length(p_name)) AS BIGINT) AS h FROM part""")
def name_hashes(spark, d):
    p = R.table(spark, d, "part").select(c("p_partkey").alias("id"), F.encode("p_name", "UTF-8").alias("n"))
    return K.coded(p, "n", T.name_hash, "long", "h", ("id",))


@query("background")
def background(spark, d):
    return B.generate(R.pixel_q(spark, d), 4)[0]


@query("best_tile_palettes", sql("pixel_q", f"""
WITH pal AS (SELECT k, i, CAST((i * 37 + k * 50) % 256 AS DOUBLE) AS r, CAST((i * 91 + k * 20) % 256 AS DOUBLE) AS g, CAST((i * 151 + k * 90) % 256 AS DOUBLE) AS b FROM range(1, 8) t(i), range(3) u(k)), py AS (SELECT k, {_YIQ} FROM pal),
p AS (SELECT img * 64 + (y // 8) * 8 + x // 8 AS tile_no, row_number() OVER () AS n, {_YIQ} FROM (SELECT img, x, y, {_DBL} FROM pixel_q WHERE a >= 128)),
e AS (SELECT tile_no, n, k, min(round(400 * (p.cy - py.cy) ** 2 + 400 * (p.ci - py.ci) ** 2 + 400 * (p.cq - py.cq) ** 2, 6)) AS e FROM p, py GROUP BY ALL), s AS (SELECT tile_no, k, round(sum(e), 4) AS e FROM e GROUP BY ALL)
SELECT tile_no, arg_min(k, (e, k)) AS pal FROM s GROUP BY tile_no"""))
def best_tile_palettes(spark, d):
    banks = [[(i, (i * 37 + k * 50) % 256, (i * 91 + k * 20) % 256, (i * 151 + k * 90) % 256) for i in range(8)] for k in range(3)]
    return B.best_palettes(R.pixel_q(spark, d), banks).select("tile_no", "pal")


@query("replace_blocks", sql("tile_dup", f"""
WITH cs AS (SELECT i, {_YIQ} FROM (SELECT i, CAST((i * 37) % 256 AS DOUBLE) AS r, CAST((i * 91) % 256 AS DOUBLE) AS g, CAST((i * 151) % 256 AS DOUBLE) AS b FROM range(11) t(i))),
b AS (SELECT block, pos, {_YIQ} FROM (SELECT k AS block, p AS pos, CAST((k * 53 + p * 7) % 256 AS DOUBLE) AS r, CAST((k * 31 + p * 11) % 256 AS DOUBLE) AS g, CAST((k * 17 + p * 3) % 256 AS DOUBLE) AS b FROM range(20) t(k), range(64) u(p))),
s AS (SELECT block, tile_no, f, round(sum(400 * (b.cy - cs.cy) ** 2 + 400 * (b.ci - cs.ci) ** 2 + 400 * (b.cq - cs.cq) ** 2), 4) AS e FROM b JOIN (VALUES (0, 0), (1, 7), (2, 56), (3, 63)) v(f, m) ON true JOIN tile_dup t ON t.pos = xor(b.pos, m) JOIN cs ON cs.i = t.idx GROUP BY ALL),
w AS (SELECT block, tile_no, min(e) AS e, arg_min(f, (e, f)) AS f FROM s GROUP BY ALL)
SELECT block, arg_min(tile_no, (e, tile_no)) AS tile_no, CAST(arg_min(f, (e, tile_no)) AS BIGINT) AS flip FROM w GROUP BY block"""))
def replace_blocks(spark, d):
    blocks = spark.range(20).selectExpr("id AS block", "explode(sequence(0L, 63L)) AS pos").selectExpr("block", "pos", "(block * 53 + pos * 7) % 256 AS r", "(block * 31 + pos * 11) % 256 AS g", "(block * 17 + pos * 3) % 256 AS b")
    colors = [(i * 37 % 256, i * 91 % 256, i * 151 % 256) for i in range(11)]
    return B.replace_blocks(blocks, D.tile_arrays(R.tile_dup(spark)), colors).select("block", "tile_no", "flip")
