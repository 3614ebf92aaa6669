"""Language identification by hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram binds its
letters' vectors, permuted by place: ``roll(a, 2) * roll(b, 1) * c``. A document bundles (adds) the
vectors of its trigrams; a language's prototype bundles its documents' unit vectors. A document
takes the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table

DIMS = 1024
UNDETERMINED = "und"
#: Different languages that a table may name.
LANGUAGES = 2000
#: Unit vectors are added as integers of this scale, so that sums don't depend on their order.
SCALE = 1 << 20
#: Texts bundled together; bounds the matrix of trigram counts.
GROUP = 64
#: Letters and trigrams handled at once; with these a worker's arrays stay within some 100 MB.
CHARS, TRIGRAMS = 1 << 18, 4096
_FRAME = np.array([32], np.uint32)


@functools.cache
def _letters() -> np.ndarray:
    """Per code point: itself if it is a letter, else the space that parts words."""
    codes = np.arange(0x110000, dtype=np.uint32)
    return np.where(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000), codes, 32).astype(np.uint32)


@functools.lru_cache(maxsize=20_000)
def _letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng(code).integers(0, 2, DIMS, dtype=np.int8) * 2 - 1).astype(np.float32)


def _trigrams(keys: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams packed in 21 bits a letter."""
    places = [(keys >> shift) & 0x1FFFFF for shift in (42, 21, 0)]
    alphabet, at = np.unique(np.concatenate(places), return_inverse=True)
    vectors = np.stack([_letter_vector(int(c)) for c in alphabet])
    a, b, c = at.reshape(3, -1)
    return np.roll(vectors, 2, axis=1)[a] * np.roll(vectors, 1, axis=1)[b] * vectors[c]


def bundle(texts: list[str | None]) -> np.ndarray:
    """A row of DIMS for each text: its trigrams' vectors, added. No letters (or null) give zeros.

    Case is folded, and what is not a letter becomes one space, which also frames the text.
    """
    out = np.zeros((len(texts), DIMS), np.float32)
    held, size = [], 0
    for i, text in enumerate(texts):
        codes = _letters()[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes = np.concatenate((_FRAME, codes, _FRAME))
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
        for at in range(0, len(codes) - 2, CHARS):
            part = codes[at : at + CHARS + 2]
            if size + len(part) > CHARS and held:
                _add(out, held)
                held, size = [], 0
            held.append((i, part))
            size += len(part)
    if held:
        _add(out, held)
    return out


def _add(out: np.ndarray, parts: list[tuple[int, np.ndarray]]) -> None:
    """Add the trigrams of each (row, letters) to its row of ``out``, by their counts."""
    flat = np.concatenate([c[:-2].astype(np.int64) << 42 | c[1:-1].astype(np.int64) << 21 | c[2:] for _, c in parts])
    rows = np.unique([i for i, _ in parts])
    owner = np.repeat(np.searchsorted(rows, [i for i, _ in parts]), [len(c) - 2 for _, c in parts])
    # What begins a trigram is a space, stands amid the one before, or begins a part.
    alphabet = np.unique(np.concatenate([c for _, c in parts])).astype(np.int64)
    k = len(alphabet)
    if k**3 <= 1 << 22:
        rank = np.zeros(alphabet[-1] + 1, np.int32)
        rank[alphabet] = np.arange(k)
        small = (rank[flat >> 42] * k + rank[flat >> 21 & 0x1FFFFF]) * k + rank[flat & 0x1FFFFF]
        present = np.flatnonzero(np.bincount(small, minlength=k**3))
        place = np.zeros(k**3, np.int32)
        place[present] = np.arange(len(present))
        at = place[small]
        unique = alphabet[present // (k * k)] << 42 | alphabet[present // k % k] << 21 | alphabet[present % k]
    else:
        unique, at = np.unique(flat, return_inverse=True)
    n = len(unique)
    for start in range(0, n, TRIGRAMS):
        own = slice(None) if n <= TRIGRAMS else (at >= start) & (at < start + TRIGRAMS)
        width = min(TRIGRAMS, n - start)
        counts = np.bincount(owner[own] * width + at[own] - start, minlength=len(rows) * width).reshape(len(rows), width)
        out[rows] += counts.astype(np.float32) @ _trigrams(unique[start : start + width])


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """Language -> unit prototype, learnt from all of ``docs(text, lang)`` with a lang.

    Partitions add up their own documents and send one vector a language; those are added by
    dimension in a shuffle. DIMS numbers a language reach the driver; more than LANGUAGES raise, as
    such a column doesn't name languages.
    """

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            for at in range(0, len(texts), GROUP):
                units = np.rint(_unit(bundle(texts[at : at + GROUP])).astype(np.float64) * SCALE).astype(np.int64)
                for lang in set(langs[at : at + GROUP]):
                    sums[lang] = sums.get(lang, 0) + units[langs[at : at + GROUP] == lang].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    rows = map_arrow(docs.where("lang IS NOT NULL AND text IS NOT NULL").selectExpr("CAST(text AS string) text", "CAST(lang AS string) lang"), partial, "lang string, v array<long>")
    total = rows.select("lang", F.posexplode("v").alias("dim", "x")).groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    rows = total.limit(LANGUAGES * DIMS + 1).collect()
    if len(rows) > LANGUAGES * DIMS:
        raise ValueError(f"more than {LANGUAGES} languages")
    for lang, dim, x in rows:
        found.setdefault(lang, np.zeros(DIMS))[dim] = x
    return {k: v / norm for k, v in sorted(found.items()) if (norm := np.linalg.norm(v)) > 0}


def identify(docs: DataFrame, model: dict[str, np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, lang_pred, score) of every row of ``docs(text, *keep)``.

    ``und`` with score 0 where a text is null, has no letters, or nothing was learnt. Otherwise the
    cosine, at least 0; equal cosines take the first language by name. Whole texts are read.
    """
    names = list(model)
    held = docs.sparkSession.sparkContext.broadcast(np.stack([model[k] for k in names]).astype(np.float32) if names else None)

    def one(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            langs, scores = [], []
            for at in range(0, len(texts), GROUP):
                v = _unit(bundle(texts[at : at + GROUP]))
                if held.value is None:
                    langs += [UNDETERMINED] * len(v)
                    scores += [0.0] * len(v)
                    continue
                cos = np.round((v @ held.value.T).astype(np.float64), 6)
                best = cos.argmax(axis=1)
                some = v.any(axis=1)
                langs += [names[i] if ok else UNDETERMINED for i, ok in zip(best, some, strict=True)]
                scores += np.where(some, np.clip(cos[np.arange(len(v)), best], 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[1:], "lang_pred", "score"])

    rows = docs.select(F.col("text").cast("string").alias("_text"), *(F.col(k) for k in keep))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]), "lang_pred string", "score double"])
    return map_arrow(rows, one, schema)


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id never does."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def op5_language(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``documents``.

    Prototypes come from the rows with a text and a lang that aren't held out; with none, every
    text is ``und``. Null texts and texts without letters are ``und`` with score 0; repeated rows and
    null doc_ids (never held out) each come back; no rows give no rows. Texts are read whole.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out())
    model = prototypes(docs.where(~F.col("held_out")))
    return identify(docs, model, ("doc_id", "held_out"))
