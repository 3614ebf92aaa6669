"""Relations of the graphics model, derived from the driver's tables: as DataFrames, and as DuckDB text.

The inputs are synthetic encodings, not assets: an order is a pixel or a screen cell, a part a
palette entry, a user's events an animation. Every relation is a projection of one table, so that
filters and column pruning reach its scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, x, y, r, g, b, a), 64 x 64 pixels an image, the last one partial."""
    o = table(spark, sf_dir, "orders").withColumn("c", F.expr("CAST(ROUND(o_totalprice * 100) AS BIGINT)"))
    return o.selectExpr("o_orderkey div 4096 AS img", "o_orderkey % 64 AS x", "(o_orderkey div 64) % 64 AS y", "c % 256 AS r", "(c div 256) % 256 AS g", "(c div 65536) % 256 AS b", "CAST(CASE o_orderstatus WHEN 'F' THEN 255 WHEN 'O' THEN 128 ELSE 0 END AS BIGINT) AS a")


def pixel_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pixel`` with four levels a channel."""
    return pixel(spark, sf_dir).selectExpr("img", "x", "y", "(r div 64) * 85 AS r", "(g div 64) * 85 AS g", "(b div 64) * 85 AS b", "a")


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, color): 256 entries at most, whatever the input."""
    return table(spark, sf_dir, "part").where("p_partkey < 256").selectExpr("p_partkey AS idx", "(p_partkey * 7919 + p_size * 31) % 32768 AS color")


def tile_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile_no, pos, idx): 8 x 8 tiles of ``pixel``."""
    return pixel(spark, sf_dir).selectExpr("img * 64 + (y div 8) * 8 + x div 8 AS tile_no", "(y % 8) * 8 + x % 8 AS pos", "r % 16 AS idx")


def tile_dup(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """(tile_no, pos, idx): a character file of 240 tiles, 120 different, 30 under flips; a lookup side, the same at every size."""
    k = spark.range(240).selectExpr("id AS tile_no", "explode(sequence(0L, 63L)) AS pos")
    k = k.withColumn("m", F.expr("CASE (tile_no div 30) % 4 WHEN 0 THEN 0L WHEN 1 THEN 7L WHEN 2 THEN 56L ELSE 63L END"))
    return k.selectExpr("tile_no", "pos", "((tile_no % 30) * 13 + (pos ^ m) * 7 * (1 + (tile_no % 30) % 3)) % 11 AS idx")


def tile_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile_no, pos, idx): a pixel an order, 64 a tile, whole tiles only; of every 240 tiles 120 differ, 30 under flips."""
    k = table(spark, sf_dir, "orders").selectExpr("o_orderkey div 64 AS tile_no", "o_orderkey % 64 AS pos").withColumn("whole", F.expr("count(*) OVER (PARTITION BY tile_no) = 64")).where("whole")
    k = k.withColumn("m", F.expr("CASE (tile_no div 30) % 4 WHEN 0 THEN 0L WHEN 1 THEN 7L WHEN 2 THEN 56L ELSE 63L END"))
    return k.selectExpr("tile_no", "pos", "((tile_no % 30) * 13 + (pos ^ m) * 7 * (1 + (tile_no % 30) % 3)) % 11 AS idx")


def screen_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, raw): packed references, some to tiles that aren't there."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS cell", "(o_custkey % 300) + 1024 * (o_orderkey % 4) + 4096 * (o_orderkey % 16) AS raw")


def message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS file_id", "turn AS pos", "text")


def byte_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, bytes): the UTF-8 bytes of every document as an array.

    The text is turned to hexadecimal pairs once; the lambda sees a pair alone, as whatever it
    captures would be computed anew for every byte.
    """
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''")
    pairs = F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit(".."), F.lit(0))
    return d.select("doc_id", F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("bigint")).alias("bytes"))


def byte_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, b): a row for each UTF-8 byte of every document."""
    return byte_arrays(spark, sf_dir).selectExpr("doc_id", "posexplode(bytes) AS (pos, b)").selectExpr("doc_id", "CAST(pos AS BIGINT) AS pos", "b")


def anim_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, frame_no, duration, mode, value): a user's events in order of time."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS seq", "CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_no", "1 + event_id % 5 AS duration", "1 + user_id % 4 AS mode", "event_id % 40 AS cell")


def sprite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obj, cell, n, attr0, attr1, attr2): packed object records, eight to a cell."""
    o = table(spark, sf_dir, "orders").withColumn("c", F.expr("CAST(ROUND(o_totalprice * 100) AS BIGINT)"))
    return o.selectExpr("o_orderkey AS obj", "o_orderkey div 8 AS cell", "o_orderkey % 8 AS n", "(o_custkey * 2654435761) % 65536 AS attr0", "(c * 40503) % 65536 AS attr1", "(o_orderkey * 7919 + o_custkey) % 65536 AS attr2")


def texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, fmt, width, height): parts as textures."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS name", "p_partkey % 8 AS fmt", "8 * (1 + p_size % 7) AS width", "8 + p_partkey % 50 AS height")


#: The same relations as DuckDB text.
SQL = {
    "pixel": "SELECT o_orderkey // 4096 AS img, o_orderkey % 64 AS x, (o_orderkey // 64) % 64 AS y, c % 256 AS r, (c // 256) % 256 AS g, (c // 65536) % 256 AS b, CAST(CASE o_orderstatus WHEN 'F' THEN 255 WHEN 'O' THEN 128 ELSE 0 END AS BIGINT) AS a FROM (SELECT *, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS c FROM orders)",
    "pixel_q": "SELECT img, x, y, (r // 64) * 85 AS r, (g // 64) * 85 AS g, (b // 64) * 85 AS b, a FROM pixel",
    "palette": "SELECT p_partkey AS idx, (p_partkey * 7919 + p_size * 31) % 32768 AS color FROM part WHERE p_partkey < 256",
    "tile_px": "SELECT img * 64 + (y // 8) * 8 + x // 8 AS tile_no, (y % 8) * 8 + x % 8 AS pos, r % 16 AS idx FROM pixel",
    "tile_dup": "SELECT k AS tile_no, p AS pos, ((k % 30) * 13 + xor(p, CASE (k // 30) % 4 WHEN 0 THEN 0 WHEN 1 THEN 7 WHEN 2 THEN 56 ELSE 63 END) * 7 * (1 + (k % 30) % 3)) % 11 AS idx FROM range(240) a(k), range(64) b(p)",
    "tile_copies": "SELECT k AS tile_no, p AS pos, ((k % 30) * 13 + xor(p, CASE (k // 30) % 4 WHEN 0 THEN 0 WHEN 1 THEN 7 WHEN 2 THEN 56 ELSE 63 END) * 7 * (1 + (k % 30) % 3)) % 11 AS idx FROM (SELECT o_orderkey // 64 AS k, o_orderkey % 64 AS p FROM orders QUALIFY count(*) OVER (PARTITION BY o_orderkey // 64) = 64)",
    "screen_cell": "SELECT o_orderkey AS cell, (o_custkey % 300) + 1024 * (o_orderkey % 4) + 4096 * (o_orderkey % 16) AS raw FROM orders",
    "message": "SELECT conv_id AS file_id, turn AS pos, text FROM conversations",
    "byte_seq": "SELECT doc_id, pos, CAST(('0x' || h) AS BIGINT) AS b FROM (SELECT doc_id, unnest(h) AS h, unnest(range(len(h))) AS pos FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents WHERE text IS NOT NULL))",
    "anim_frame": "SELECT user_id AS seq, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no, 1 + event_id % 5 AS duration, 1 + user_id % 4 AS mode, event_id % 40 AS cell FROM events",
    "sprite": "SELECT o_orderkey AS obj, o_orderkey // 8 AS cell, o_orderkey % 8 AS n, (o_custkey * 2654435761) % 65536 AS attr0, (CAST(ROUND(o_totalprice * 100) AS BIGINT) * 40503) % 65536 AS attr1, (o_orderkey * 7919 + o_custkey) % 65536 AS attr2 FROM orders",
    "texture": "SELECT p_partkey AS id, p_name AS name, p_partkey % 8 AS fmt, 8 * (1 + p_size % 7) AS width, 8 + p_partkey % 50 AS height FROM part",
}
_NEEDS = {"pixel_q": ["pixel"], "tile_px": ["pixel"]}


def sql(names: str, body: str) -> str:
    """``body`` with the relations named in ``names`` before it."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    body = body.strip()
    extra = body.startswith("WITH ")
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + (", " + body[5:] if extra else " " + body)
