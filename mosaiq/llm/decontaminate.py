"""Benchmark decontamination by a generalised suffix automaton of the benchmark's words.

The automaton holds every run of words of every item. Document words stream through it; the length
of the longest run that ends at each word is tracked, and where it reaches a window, the words of
that window are hit and the items that hold it are known.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, table

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 13
#: A document with hits on at least one word in so many is contaminated.
COVERAGE = 20
#: Words of benchmark text in one automaton, which then takes some 140 MB. More text makes more automata, one pass each.
PART_WORDS = 1_000_000


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 bytes with A-Z lower-cased; null has none."""
    return WORD.findall(text.lower()) if text else []


#: In ``only_word``: a state without moves, and one with several, which are in ``more``.
NONE, SEVERAL = -1, -2


class Automaton:
    """Generalised suffix automaton over word sequences, in arrays of numbers.

    Words are numbers. Most states have one move, which two arrays hold; the few with several have a
    dict. Items whose windows end in a state are a number too, of a list of the different sets.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.only_word, self.only_to = array("i", [SEVERAL]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {0: {}}
        self.link, self.length = array("i", [-1]), array("i", [0])
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.words.setdefault(w, len(self.words)))
        self._mark(items)

    def move(self, state: int, w: int) -> int:
        """The state after ``w``, -1 if none."""
        only = self.only_word[state]
        return self.only_to[state] if only == w else self.more[state].get(w, -1) if only == SEVERAL else -1

    def _set(self, state: int, w: int, to: int) -> None:
        only = self.only_word[state]
        if only == SEVERAL:
            self.more[state][w] = to
        elif only in (w, NONE):
            self.only_word[state], self.only_to[state] = w, to
        else:
            self.more[state] = {only: self.only_to[state], w: to}
            self.only_word[state] = SEVERAL

    def _state(self, length: int, link: int, like: int = -1) -> int:
        """A new state, with the moves of ``like``."""
        new = len(self.length)
        self.length.append(length)
        self.link.append(link)
        self.only_word.append(self.only_word[like] if like >= 0 else NONE)
        self.only_to.append(self.only_to[like] if like >= 0 else 0)
        if like >= 0 and self.only_word[like] == SEVERAL:
            self.more[new] = dict(self.more[like])
        return new

    def _split(self, p: int, q: int, w: int) -> int:
        """The state of the run that reaches ``q`` from ``p`` by ``w``: ``q``, or its shorter part as a state of its own."""
        link, length = self.link, self.length
        if length[q] == length[p] + 1:
            return q
        part = self._state(length[p] + 1, link[q], q)
        while p >= 0 and self.move(p, w) == q:
            self._set(p, w, part)
            p = link[p]
        link[q] = part
        return part

    def _extend(self, last: int, w: int) -> int:
        if (to := self.move(last, w)) >= 0:  # another item has this run already
            return self._split(last, to, w)
        cur = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and (to := self.move(p, w)) < 0:
            self._set(p, w, cur)
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, to, w)
        return cur

    def _mark(self, items) -> None:
        """``full[state]``: which items have the window that ends there; ``whole[state]``: (length, item) of short items."""
        n, k = len(self.length), self.window
        full: dict[int, set] = {}
        whole: dict[int, set] = {}
        for name, words in items:
            state = 0
            for at, w in enumerate(words, 1):
                state = up = self.move(state, self.words[w])
                while self.length[self.link[up]] >= min(at, k) and up:
                    up = self.link[up]
                if at >= k:
                    full.setdefault(up, set()).add(name)
                elif at == len(words):
                    whole.setdefault(up, set()).add((at, name))
        self.sets: list[tuple] = [()]
        number: dict[tuple, int] = {(): 0}

        def of(s: tuple) -> int:
            if s not in number:
                number[s] = len(self.sets)
                self.sets.append(s)
            return number[s]

        self.full, self.whole = array("i", bytes(4 * n)), array("i", bytes(4 * n))
        for s in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist()[1:]:  # links point at shorter runs
            up = self.link[s]
            self.full[s] = of(tuple(sorted(full[s]))) if s in full else self.full[up]
            self.whole[s] = of(tuple(sorted({*self.sets[self.whole[up]], *whole[s]}))) if s in whole else self.whole[up]

    def size(self) -> int:
        """Bytes of memory, about."""
        arrays = (self.only_word, self.only_to, self.link, self.length, self.full, self.whole)
        dicts = sum(sys.getsizeof(d) + 32 * len(d) for d in self.more.values()) + sys.getsizeof(self.more) + 32 * len(self.more)
        return sum(len(a) * a.itemsize for a in arrays) + dicts + sys.getsizeof(self.words) + sum(map(sys.getsizeof, self.words)) + 32 * len(self.words) + sum(map(sys.getsizeof, self.sets))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit word ranges (end exclusive) and the items whose windows occur."""
        link, length, full, whole, sets, k = self.link, self.length, self.full, self.whole, self.sets, self.window
        only_word, only_to, more, number = self.only_word, self.only_to, self.more, self.words.get
        root = more[0]
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        state = run = 0
        for at, word in enumerate(words):
            w = number(word)
            if w is None:  # in no item
                state = run = 0
                continue
            while state:
                only = only_word[state]
                if only == w:
                    to = only_to[state]
                    break
                if only == SEVERAL and (to := more[state].get(w, -1)) >= 0:
                    break
                state = link[state]
                run = length[state]
            else:
                to = root[w]
            state = to
            run += 1
            start = -1
            if run >= k:
                items.update(sets[full[state]])
                start = at + 1 - k
            if short := whole[state]:
                for m, name in sets[short]:
                    if m <= run:
                        items.add(name)
                        start = min(start, at + 1 - m) if start >= 0 else at + 1 - m
            if start >= 0:
                runs.append((start, at + 1))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(runs):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


def automata(benchmark: DataFrame) -> Iterator[Automaton]:
    """Automata over all items, of at most ``PART_WORDS`` words each unless one item alone has more.

    One at a time: items are read as they are needed, and a caller lets go of one before the next.
    """
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string").cast("binary"))
    part, size = [], 0
    for name, text in rows.toLocalIterator(prefetchPartitions=False):
        if name is None or not (words := words_of(bytes(text) if text is not None else None)):
            continue
        if part and size + len(words) > PART_WORDS:
            yield Automaton(part)
            part, size = [], 0
        part.append((name, words))
        size += len(words)
    if part:
        yield Automaton(part)


def _join_runs(all_runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(all_runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: its words, hit word ranges, and items whose windows occur.

    Returns (doc_id, n_words, runs array<struct<start, stop>>, items array<string>) where runs
    count words, end exclusive. Null, empty and wordless texts have no hits; items without words
    or id have no windows; an empty benchmark hits nothing; repeated rows each come back. Each
    automaton is broadcast: ``PART_WORDS`` bounds its size, and a larger benchmark makes one more
    narrow pass for each further automaton, written before the next, so that workers hold one at a time.
    """
    spark = docs.sparkSession
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.lit(None).cast("array<struct<start:long,stop:long>>").alias("runs"), F.lit(None).cast("array<string>").alias("items"))
    schema = "doc_id long, text string, n_words long, runs array<struct<start:long,stop:long>>, items array<string>"
    passes = 0
    for automaton in chain(automata(benchmark), [None]):
        if automaton is None and passes:
            break
        if passes:
            out = cut(out)
        passes += 1
        held = spark.sparkContext.broadcast(automaton)

        def one(batches, held=held):
            it = held.value
            for b in batches:
                b = pa.Table.from_batches([b])
                n, runs, items = [], [], []
                for text, old_runs, old_items in zip(b["text"].cast(pa.binary()).to_pylist(), b["runs"].to_pylist(), b["items"].to_pylist(), strict=True):
                    words = words_of(text)
                    found, names = it.hits(words) if it else ([], set())
                    n.append(len(words))
                    runs.append([{"start": x, "stop": y} for x, y in _join_runs([*((r["start"], r["stop"]) for r in old_runs or ()), *found])])
                    items.append(sorted({*(old_items or ()), *names}))
                yield from pa.table({"doc_id": b["doc_id"].cast(pa.int64()), "text": b["text"], "n_words": pa.array(n, pa.int64()), "runs": pa.array(runs, b["runs"].type), "items": pa.array(items, pa.list_(pa.string()))}).to_batches()

        out = map_arrow(out.select("doc_id", "text", "runs", "items"), one, schema)
    return out


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``'s."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (COVERAGE * F.col("n_hit") >= F.col("n_words"))
    )


def without_runs(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each run."""
    if not runs:
        return text
    spans = [m.span() for m in WORD.finditer(text.lower())]
    out, at = [], 0
    for a, b in runs:
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows; the others lose the spans that windows cover.

    A row goes whole if hits reach one word in ``COVERAGE``. Below that only the hit spans go, and
    n_chars, where the column is there, follows. Rows without hits, and null texts, stay as they are;
    repeated rows and null ids each come back; other columns may have any names. No rows give no rows.
    """
    spark = docs.sparkSession
    names = docs.columns
    at = names.index("text")
    kind = "array<struct<start:long,stop:long>>"
    runs = next(c for n in range(len(names) + 1) if (c := f"_runs{n}") not in names)  # a name that no column has
    out = docs.withColumn(runs, F.lit(None).cast(kind))
    full = out.schema

    def track(held):
        def one(batches):
            for b in batches:
                merged = []
                for text, old in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                    found = held.value.hits(words_of(text))[0]
                    merged.append([{"start": x, "stop": y} for x, y in _join_runs([*((r["start"], r["stop"]) for r in old or ()), *found])])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(merged, b.schema.field(len(names)).type)], b.schema.names)

        return one

    def strip(batches):
        for b in batches:
            texts, keep = [], []
            for text, old in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                runs = [(r["start"], r["stop"]) for r in old or ()]
                n = sum(y - x for x, y in runs)
                keep.append(not n or COVERAGE * n < len(words_of(text)))
                texts.append(without_runs(text, runs) if n and keep[-1] else text)
            new = pa.array(texts, pa.binary()).cast(b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns[:-1])], names).filter(pa.array(keep, pa.bool_()))

    passes = 0
    for automaton in automata(benchmark):
        out = map_arrow(cut(out) if passes else out, track(spark.sparkContext.broadcast(automaton)), full)
        passes += 1
    out = map_arrow(out, strip, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """``digest`` of ``scan`` over every row of ``documents``: null, empty and repeated rows as stated there."""
    return digest(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP6_SQL = r"""
WITH bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
dg AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
h AS (SELECT r, i, win.k AS k, item_id FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
