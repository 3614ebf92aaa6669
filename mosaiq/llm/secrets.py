"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame expressions only.

A blob is a text under its SHA-256; a path is a row that holds it, in whatever version. The ledger
has a row for each (blob, rule, rule version) that was ever scanned, with the spans found. A scan
takes only the pairs that the ledger lacks, so a text is scanned once however many rows hold it, and
a changed rule rescans every blob for that rule alone. The ledger is a folder of Parquet files beside
the checkpoints; a scan appends to it before findings are joined back, so the next run over the same
texts scans none of them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lasting_dir, table


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping candidates; ``keep`` is true for those that count."""

    name: str
    number: int
    pattern: str
    #: A candidate (one string) counts if this matches it.
    keep: str

    @property
    def version(self) -> str:
        """The number, and a hash of the patterns: a changed pattern is another version whatever its number."""
        return f"{self.number}-{zlib.crc32(f'{self.pattern} {self.keep}'.encode()):08x}"


#: Forms of keys and tokens by which vendors' scanners know them, and the line before a private key.
VENDOR = r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----)"
RULES = (
    Rule("assign", 1, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""(?i)^[a-z_]+["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}$"""),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"^.{18,}$"),
    # A run of the class is taken whole by either form; the bound in the pattern skips short runs sooner.
    Rule("hex", 1, r"[0-9a-f]{16,}", r"^.{16,}$"),
    Rule("vendor", 1, VENDOR, r"^."),
)
#: The rules that the contract counts; the others only add spans.
BASE = ("assign", "access", "hex")
SPANS = "array<struct<start:int,stop:int>>"
#: Keys over which the paths of one blob are dealt.
SALTS = 64
LEDGER = f"blob binary, rule string, version string, spans {SPANS}"
#: Hits of a text whose spans are added up at once: arrays grow by so many, not one by one.
CHUNK = 256


def blob_id(text: Column) -> Column:
    """32 bytes that name a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def find(text: Column, rule: Rule) -> Column:
    """Spans of a rule in code points, end exclusive, found by what stands between the candidates."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    empty = F.array().cast(SPANS)

    def step(acc, x):
        a = acc["at"] + F.length(x["gap"])
        b = a + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.array(F.struct(a.alias("start"), b.alias("stop")))
        return F.struct(b.alias("at"), F.when(x["hit"].rlike(rule.keep), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def chunk(done, part):
        at = F.coalesce(F.get(done, F.size(done) - 1)["at"], F.lit(0))
        return F.concat(done, F.array(F.aggregate(part, F.struct(at.alias("at"), empty.alias("spans")), step)))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")), lambda i: F.slice(found, i * CHUNK + 1, CHUNK))
    spans = F.aggregate(parts, F.array().cast(f"array<struct<at:int,spans:{SPANS}>>"), chunk, lambda done: F.flatten(F.transform(done, lambda x: x["spans"])))
    return F.when(text.rlike(rule.pattern), spans).otherwise(empty)


def ledger_path(spark: SparkSession) -> str:
    """The ledger's folder, in the shared folder that outlives the session where the session names one."""
    return f"{lasting_dir(spark)}/mosaiq-secrets-ledger"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty before the first scan."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _current(rules: tuple[Rule, ...]) -> str:
    return " OR ".join(f"(rule = '{r.name}' AND version = '{r.version}')" for r in rules) or "false"


def scan(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for ``docs(text)``: every (blob, rule, version) that ``ledger`` lacks.

    One row per blob and rule, with an empty array where nothing was found, so that the pair
    counts as scanned. Rows that share a text are reduced to one before the shuffle; the ledger is
    then met by blob, in the same partitions. Null and empty texts are one blob without findings; no
    rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blobs = docs.select(text.alias("text")).select(blob_id(F.col("text")).alias("blob"), "text")
    seen = ledger.where(_current(rules)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # as many as there are rules, at most
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text")).join(seen, "blob", "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(rules))
    lacks = [~F.array_contains(F.coalesce("seen", F.array().cast("array<string>")), r.name) for r in rules]
    todo = F.array(*(F.when(lack, F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), find(F.col("text"), r).alias("spans"))) for lack, r in zip(lacks, rules, strict=True)))
    return blobs.select("blob", F.inline(F.filter(todo, lambda x: x.isNotNull())))


def record(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks of ``docs(text)``, append it, and return the whole ledger.

    A run that dies before its append is complete leaves nothing behind; two that append the same
    pairs leave equal rows, which ``findings`` takes as one.
    """
    spark = docs.sparkSession
    scan(docs, read_ledger(spark, path), rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows joined back to every path: (doc_id, assign, access, hex, ...), an array of spans each.

    Only blobs with findings are joined. A blob's paths are dealt over SALTS keys, and its findings
    repeated for each, so that no hot blob meets in one task. Repeated rows and null doc_ids each
    come back.
    """
    of = ledger.where(_current(rules)).where(F.size("spans") > 0).groupBy("blob").agg(*(F.max(F.when(F.col("rule") == r.name, F.col("spans"))).alias(r.name) for r in rules))
    of = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    paths = docs.select("doc_id", blob_id(F.col("text").cast("string")).alias("blob"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return paths.join(of, ["blob", "salt"], "left").select("doc_id", *(F.coalesce(r.name, F.array().cast(SPANS)).alias(r.name) for r in rules))


def spans_text(kinds: dict[str, Column]) -> Column:
    """kind:start:end of all spans by start, then kind in the order given, comma-joined."""

    def entries(i: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")).alias("text")))

    every = F.concat(*(entries(i, kind, spans) for i, (kind, spans) in enumerate(kinds.items())))
    return F.array_join(F.transform(F.array_sort(every), lambda s: s["text"]), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``findings``'."""
    kinds = {r.name: F.col(r.name) for r in RULES}
    counts = [F.size(kinds[k]).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(spans_text({k: kinds[k] for k in BASE}), 256).alias("base_sha256"), spans_text(kinds).alias("spans"))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``documents``.

    The ledger is read and appended to at ``ledger_path``; blobs and rules that an earlier run
    scanned aren't scanned again. Null and empty texts have no spans; repeated rows and null
    doc_ids each come back; no documents give no rows. Texts of any length are scanned whole.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    return digest(findings(docs, record(docs, ledger_path(spark))))


def _sql_kind(kind: str, pattern: str, keep: str) -> str:
    return f"""
{kind}_m AS (SELECT r, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d),
{kind}_s AS (SELECT r, m[i] AS s, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {kind}_m)),
{kind}_k AS (SELECT r, '{kind}' AS kind, CAST(a AS BIGINT) AS a, CAST(a + length(s) AS BIGINT) AS b FROM {kind}_s WHERE {keep})"""


OP7_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),"
    + ",".join(
        [
            _sql_kind("assign", """(?i)(?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+""", """regexp_matches(s, '(?i)^[a-z_]+["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]{12,}$')"""),
            _sql_kind("access", "AKIA[A-Z0-9]+", "length(s) >= 18"),
            _sql_kind("hex", "[0-9a-f]+", "length(s) >= 16"),
            _sql_kind("vendor", VENDOR, "true"),
        ]
    )
    + """,
k AS (SELECT *, 1 AS o FROM assign_k UNION ALL SELECT *, 2 FROM access_k UNION ALL SELECT *, 3 FROM hex_k UNION ALL SELECT *, 4 FROM vendor_k),
c AS (SELECT r, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2, count(*) FILTER (o = 3) AS n3,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) AS spans, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) FILTER (o < 4) AS base FROM k GROUP BY r)
SELECT doc_id, coalesce(n1, 0) AS n_assign, coalesce(n2, 0) AS n_access, coalesce(n3, 0) AS n_hex, coalesce(spans, '') AS spans, sha256(coalesce(base, '')) AS base_sha256
FROM d LEFT JOIN c USING (r)"""
)
