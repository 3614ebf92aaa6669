"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns' spans are certain and stay. What they leave of a text is cut into zones around digits
and at-signs; in each zone the field scores whole candidate segments of bounded length under every
kind, and dynamic programming chooses boundaries and kinds together. Segments that it gives a
posterior of ``SURE`` or more are added. It is trained here: on labelled sentences that ``examples``
makes, in forms that the patterns can't know beside numbers that are no personal data, and on zones of
the corpus with the patterns' spans and rewritten forms of them.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table

KINDS = ("email", "ip", "card", "phone")
#: Tokens, and digits, that a segment can have, at most.
LONGEST, DIGITS = 24, 24
#: Tokens of a zone that are decoded at once, and how many of them two such windows share.
WINDOW, SHARED = 2048, 4 * LONGEST
#: White space between a trigger's word and its neighbour, at most.
GAP = 3
#: Documents (by hash of the id) from which training zones are taken, zones used and their characters: the documented bound of the sample.
FIT_DOCS, FIT_ZONES, FIT_CHARS = 20_000, 600, 200
#: Labelled sentences made for training.
FIT_EXAMPLES = 1200
EPOCHS = 10
SURE = 0.95

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.I)
_MORE = re.compile(r"\s?[\[({](?:at|dot)[\])}]", re.I)
_LED = re.compile(r"[\[({](?:at|dot)[\])}]\s?\Z", re.I)
_BEFORE, _AFTER = re.compile(r"\s*\Z"), re.compile(r"\s*")
_DOT = re.compile(r"\s*(?:[\[({](?:dot|\.)[\])}]|\.)\s*", re.I)
_AT = re.compile(r"\s*(?:[\[({]at[\])}]|@)\s*", re.I)
_EMAIL_FORM = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|[^\w\s]|[\w]", re.ASCII)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, ordered so; each kind leftmost without overlaps."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > free and text[left - 1] in _LOCAL_CHARS:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((left, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if any(map(text.__contains__, "0123456789")):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def zones(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches outside ``taken`` that hold a trigger: the words of all their triggers, and the words beside each."""
    out: list[tuple[int, int]] = []
    word = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < word:  # in the word of the trigger before, with the same neighbours
            continue
        a, b = m.start(), m.end()
        for _ in range(2):  # the word itself and one more on either side
            while a and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and not text[b].isspace():
                b += 1
            if _ == 0:
                word = b
                left, right = _BEFORE.search(text[max(0, a - GAP) : a]), _AFTER.match(text, b, min(len(text), b + GAP))
                a, b = a - len(left[0]), right.end()
        if out and a < out[-1][1]:
            out[-1] = (min(a, out[-1][0]), b)
        else:
            out.append((a, b))
    left: list[tuple[int, int]] = []
    blocked = sorted(taken)
    k = 0
    for a, b in out:
        while k < len(blocked) and blocked[k][1] <= a:
            k += 1
        j = k
        while j < len(blocked) and blocked[j][0] < b:
            if a < blocked[j][0]:
                left.append((a, blocked[j][0]))
            a = max(a, blocked[j][1])
            j += 1
        if a < b:
            left.append((a, b))
    return [(a, b) for a, b in left if _TRIGGER.search(text, a, b)]


def _shape(s: str) -> str:
    s = re.sub(r"[^\W\d_]+", "a", s)
    return re.sub(r"\s", "_", re.sub(r"[0-9]+", lambda m: "9" * min(4, len(m.group())), s))


def segment_features(s: str, before: str, after: str) -> list[str]:
    """What is known of a whole segment ``s`` between the texts ``before`` and ``after``, of up to 6 characters."""
    cut_off = f"cut={bool(_LED.search(before))},{bool(_MORE.match(after))}"
    before, after = before[-1:], after[:1]
    digits = re.sub(r"[^0-9]", "", s)
    letters = sum(c.isalpha() for c in s)
    shape = _shape(s)
    kinds = "".join(sorted(set(shape) - set("a9_")))
    card = bool(re.fullmatch(r"[0-9 ./-]+", s)) and 12 <= len(digits) <= 19
    written = _AT.sub("@", _DOT.sub(".", s))
    octets = written.split(".")
    ip = len(octets) == 4 and all(o.isascii() and o.isdigit() and len(o) <= 3 and int(o) <= 255 for o in octets)
    mail = bool(_EMAIL_FORM.fullmatch(written))
    return [
        "bias", f"shape={shape[:40]}", f"n={min(len(digits), 20)}", f"letters={letters > 0}", f"marks={kinds[:12]}",
        f"at={len(re.findall(r'@|[^a-z]at[^a-z]', s, re.I))}", f"dots={min(s.count('.'), 5)}", f"plus={s[0] == '+'}", f"card={card and luhn(digits)},{card}", f"ip={ip}", f"mail={mail}", f"groups={'-'.join(str(len(g)) for g in re.findall('[0-9]+', s))[:20]}",
        f"before={'s' if not before or before.isspace() else 'w' if before.isalnum() else before}", f"after={'s' if not after or after.isspace() else 'w' if after.isalnum() else after}",
        f"last={'d' if s[-1].isdigit() else 'a'}", f"first={'d' if s[0].isdigit() else 'a' if s[0].isalpha() else s[0]}", f"space={min(s.count(' '), 6)},{letters > 0}", cut_off,
    ]


def candidates(text: str, a: int, b: int, spans: list[tuple[int, int]] | None = None):
    """Token places of a zone and its candidate segments (first token, end token, features).

    A segment has up to LONGEST tokens and DIGITS digits, stays on its line, begins with a letter, a
    digit, a plus or a bracket, and holds an at-sign, a word for one, or four digits.
    """
    if spans is None:
        spans = [m.span() for m in _TOKEN.finditer(text, a, b)]
    digits = [e - s if "0" <= text[s] <= "9" else 0 for s, e in spans]
    last = [text[e - 1].isalnum() for _, e in spans]
    stop = ["\n" in text[s:e] for s, e in spans]
    out = []
    for i, (s, _) in enumerate(spans):
        if not (text[s].isalnum() or text[s] in "+([{"):
            continue
        n, sign = 0, False
        for j in range(i, min(len(spans), i + LONGEST)):
            x, e = spans[j]
            n += digits[j]
            if n > DIGITS or stop[j]:
                break
            sign = sign or text[x] == "@" or (text[x].isalpha() and text[x:e].lower() in ("at", "dot"))
            if last[j] and (n > 3 or sign) and _TRIGGER.search(text, s, e):
                out.append((i, j + 1, segment_features(text[s:e], text[max(0, s - 6) : s], text[e : e + 6])))
    return spans, out


@dataclass
class Field:
    """Weights of "kind|feature"; a token outside all segments scores 0."""

    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.rows: dict[str, np.ndarray] = {}
        for name, w in self.weights.items():
            kind, _, feature = name.partition("|")
            self.rows.setdefault(feature, np.zeros(len(KINDS)))[KINDS.index(kind)] += w

    def scores(self, found) -> np.ndarray:
        out = np.zeros((len(found), len(KINDS)))
        get = self.rows.get
        for own, (_, _, feats) in zip(out, found, strict=True):
            for f in feats:
                if (row := get(f)) is not None:
                    own += row
        return out

    def posteriors(self, n: int, found, scores: np.ndarray) -> tuple[float, np.ndarray]:
        """Log of the partition sum and every segment's posterior under each kind."""
        return posteriors(n, *_ends(found), scores)

    def decode(self, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
        """(start, kind's number, end) of the best segmentation's sure segments in ``text[a:b]``.

        A zone of more than WINDOW tokens is decoded in windows that share SHARED tokens; a segment
        counts in the window in whose own part it begins, so memory doesn't grow with the zone.
        """
        spans = [m.span() for m in _TOKEN.finditer(text, a, b)]
        if len(spans) <= WINDOW:
            return self._decode(text, a, b, spans)
        out, step, free = [], WINDOW - SHARED, a
        for at in range(0, len(spans), step):
            own = spans[max(0, at - SHARED // 2) : at + step + SHARED // 2]
            stop = spans[at + step][0] if at + step < len(spans) else b
            for x in self._decode(text, own[0][0], own[-1][1], own):
                if max(spans[at][0], free) <= x[0] < stop:
                    out.append(x)
                    free = x[2]
        return out

    def _decode(self, text: str, a: int, b: int, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        _, found = candidates(text, a, b, spans)
        if not found:
            return []
        scores = self.scores(found)
        starts, ends = _ends(found)
        top, kind = scores.max(axis=1), scores.argmax(axis=1)
        if (top <= 0).all():
            return []
        best, back = np.zeros(len(spans) + 1), [None] * (len(spans) + 1)
        order = np.argsort(ends, kind="stable")
        edges = np.searchsorted(ends[order], np.arange(len(spans) + 2))
        for j in range(1, len(spans) + 1):
            best[j] = best[j - 1]
            if (own := order[edges[j] : edges[j + 1]]).size:
                value = best[starts[own]] + top[own]
                k = int(value.argmax())
                if value[k] > best[j]:
                    best[j], back[j] = value[k], int(own[k])
        post = posteriors(len(spans), starts, ends, scores)[1]
        out, j = [], len(spans)
        while j:
            if (x := back[j]) is None:
                j -= 1
                continue
            i = int(starts[x])
            if post[x, kind[x]] >= SURE:
                out.append((spans[i][0], int(kind[x]), spans[j - 1][1]))
            j = i
        return out[::-1]


def _ends(found) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)


def _logsum(x: np.ndarray) -> float:
    m = x.max()
    return float(m + np.log(np.exp(x - m).sum()))


def posteriors(n: int, starts: np.ndarray, ends: np.ndarray, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Forward and backward sums over ``n`` tokens: the log of the partition sum, and a posterior for each segment and kind."""
    if not len(starts):
        return 0.0, np.zeros((0, len(KINDS)))
    whole = np.logaddexp.reduce(scores, axis=1)
    alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
    by_end, by_start = np.argsort(ends, kind="stable"), np.argsort(starts, kind="stable")
    at_end, at_start = np.searchsorted(ends[by_end], np.arange(n + 2)), np.searchsorted(starts[by_start], np.arange(n + 2))
    for j in range(1, n + 1):
        own = by_end[at_end[j] : at_end[j + 1]]
        alpha[j] = _logsum(np.append(alpha[starts[own]] + whole[own], alpha[j - 1])) if own.size else alpha[j - 1]
    for i in range(n - 1, -1, -1):
        own = by_start[at_start[i] : at_start[i + 1]]
        beta[i] = _logsum(np.append(beta[ends[own]] + whole[own], beta[i + 1])) if own.size else beta[i + 1]
    return float(alpha[n]), np.exp(np.minimum(0.0, (alpha[starts] + beta[ends] - alpha[n])[:, None] + scores))


def rewritten(kind: int, s: str, turn: int) -> str | None:
    """A form of a pattern's span that the pattern doesn't know, for training."""
    if kind == 0:
        name, _, host = s.partition("@")
        return (f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name}(at){host}", f"{name} (at) {host}")[turn % 3]
    if kind == 3:
        digits = re.sub(r"[^0-9]", "", s)[-10:]
        if len(digits) == 10:
            return (f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}", f"{digits[:3]}.{digits[3:6]}.{digits[6:]}")[turn % 3]
    return None


def _luhn_number(r: random.Random, n: int) -> str:
    body = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _email(r: random.Random) -> str:
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randrange(3, 9)))
    name = word() + r.choice(["", "", f".{word()}", f"_{word()}", str(r.randrange(100)), f".{r.randrange(100)}"])
    host = word() + r.choice(["", "", str(r.randrange(10)), f"-{word()}"])
    end = r.choice(["com", "org", "net", "de", "fr", "es", "example.com", "co.uk"])
    at = r.choice([" [at] ", "[at]", " (at) ", "(at)", " {at} ", " @ ", "@ ", " [AT] "])
    dot = r.choice([".", ".", " [dot] ", "[dot]", " (dot) ", " {dot} "]) if "@" not in at else "."
    return f"{name}{at}{host}.{end}".replace(".", dot) if dot != "." else f"{name}{at}{host}.{end}"


def _ip(r: random.Random) -> str:
    parts = [str(r.randrange(256)) for _ in range(4)]
    return r.choice(["[.]", "(.)", " . ", "[dot]", " [dot] "]).join(parts)


def _card(r: random.Random) -> str:
    n = _luhn_number(r, 16)
    return r.choice([".", " - ", "  ", "/", " . "]).join(n[i : i + 4] for i in range(0, 16, 4))


def _phone(r: random.Random) -> str:
    a, b, c = (str(r.randrange(10 ** (k - 1), 10**k)) for k in (3, 3, 4))
    return r.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a}-{b}{c}", f"0{a}/{b}{c}", f"(0{a}) {b}{c}", f"1-{a}-{b}-{c}"])


def _plain(r: random.Random) -> str:
    """A number, or something with an at-sign, that is no personal data."""
    n = lambda a, b: r.randrange(a, b)
    word = "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(n(3, 9)))
    while luhn(number := "".join(r.choice("0123456789") for _ in range(n(12, 20)))):
        pass
    return r.choice([
        f"{n(1990, 2030)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(1, 29):02d}.{n(1, 13):02d}.{n(1990, 2030)}", f"{n(1, 13)}/{n(1, 29)}/{n(1990, 2030)}", f"{n(0, 24):02d}:{n(0, 60):02d}:{n(0, 60):02d}",
        f"{n(1, 999)},{n(0, 1000):03d}.{n(0, 100):02d}", f"{n(1, 20)}.{n(0, 30)}.{n(0, 100)}", f"{n(1, 9)}.{n(0, 9)}", f"{n(1, 9)}.{n(1, 9)}.{n(1, 9)}.{n(1, 9)}.{n(1, 9)}", f"{n(1, 400)}-{n(400, 900)}",
        f"{n(1900, 2000)}-{n(2000, 2030)}", f"{n(1, 100)}%", f"{n(1, 30)} of {n(30, 60)}", f"@{word}", f"{word}@{word}", number, f"{number[:4]} {number[4:8]} {number[8:12]} {number[12:16]}", f"978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}",
        f"{word.upper()}-{n(100, 999)}-{n(1000, 9999)}", f"{n(1, 999)} {n(100, 999)} {n(100, 999)}", f"{n(256, 999)}.{n(0, 999)}.{n(0, 999)}.{n(0, 999)}", f"v{n(1, 9)}.{n(0, 99)}.{n(0, 99)}", f"{n(1, 90)}.{n(10000, 99999)}, {n(1, 90)}.{n(10000, 99999)}",
        f'"{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', str(n(0, 10**9)), f"{n(1, 99)} [{n(1, 99)}]", f"(at {n(1, 9)} {word})",
    ])


def examples(n: int = FIT_EXAMPLES, seed: int = 1) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled sentences: (text, its (start, kind, end)), two in five without personal data, always the same ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvwäéñ") for _ in range(r.randrange(2, 9)))
    makers = (_email, _ip, _card, _phone)
    out = []
    for i in range(n):
        before = f"{word()}{r.choice(['', ',', ':', '.'])} "
        kind = r.randrange(4) if i % 5 > 1 else None
        found = _plain(r) if kind is None else makers[kind](r)
        out.append((before + found + r.choice([" ", ", ", ". "]) + word(), [] if kind is None else [(len(before), kind, len(before) + len(found))]))
    return out


def fit(examples: list[tuple[str, list[tuple[int, int, int]]]]) -> Field:
    """Train on (zone text, its labelled (start, kind, end)) by gradient ascent on the log-likelihood."""
    data, ids = [], {}
    for text, gold in examples:
        variants = [(text, gold)]
        if len(gold) == 1 and (rewritten(gold[0][1], text[gold[0][0] : gold[0][2]], 0)):
            s, k, e = gold[0]
            variants += [(text[:s] + new + text[e:], [(s, k, s + len(new))]) for turn in range(3) if (new := rewritten(k, text[s:e], turn))]
        for t, g in variants:
            spans, found = candidates(t, 0, len(t))
            at = {(spans[i][0], spans[j - 1][1]): x for x, (i, j, _) in enumerate(found)}
            truth = [(at[s, e], k) for s, k, e in g if (s, e) in at]
            if found and len(truth) == len(g):
                feats = np.array([[ids.setdefault(f, len(ids)) for f in x[2]] for x in found], np.int64)
                data.append((len(spans), *_ends(found), feats, truth))
    w, square = np.zeros((len(ids), len(KINDS))), np.full((len(ids), len(KINDS)), 1e-6)
    for _ in range(EPOCHS):
        for n, starts, ends, feats, truth in data:
            d = -posteriors(n, starts, ends, w[feats].sum(axis=1))[1]
            for x, k in truth:
                d[x, k] += 1.0
            some = np.abs(d).max(axis=1) > 1e-3
            if not some.any():
                continue
            own, at = np.unique(feats[some], return_inverse=True)
            g = np.zeros((len(own), len(KINDS)))
            np.add.at(g, at.reshape(-1), np.repeat(d[some], feats.shape[1], axis=0))
            square[own] += g * g
            w[own] += 0.5 * (g - 0.001 * w[own]) / np.sqrt(square[own])
    return Field({f"{k}|{f}": float(w[i, j]) for f, i in ids.items() for j, k in enumerate(KINDS) if abs(w[i, j]) > 1e-4})


def training_zones(docs: DataFrame) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Zones with their pattern spans, of a bounded sample of ``docs(doc_id, text)``: FIT_DOCS, FIT_ZONES and FIT_CHARS bound it.

    Null texts and ids in no sample; no documents give no zones.
    """
    total = docs.count()
    if not total:
        return []
    share = int(min(1.0, FIT_DOCS / total) * 1_000_003) + 1

    def one(batches):
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                base = base_spans(text)
                for a, z in zones(text, []):
                    own = [(s - a, k, e - a) for s, k, e in base if a <= s and e <= z]
                    clash = any(s2 < e1 for (_, _, e1), (s2, _, _) in zip(own, own[1:], strict=False))
                    if z - a <= FIT_CHARS and not clash:
                        rows.append((text[a:z], [x for o in own for x in o]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["zone", "spans"])

    some = docs.where("text IS NOT NULL").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share).select(F.col("text").cast("string").alias("text"))
    found = map_arrow(some, one, "zone string, spans array<int>").dropDuplicates(["zone"])
    rows = found.orderBy(F.xxhash64("zone"), "zone").limit(FIT_ZONES).collect()
    return [(r["zone"], list(zip(r["spans"][::3], r["spans"][1::3], r["spans"][2::3], strict=True))) for r in rows]


def spans_of(text: str, model: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The patterns' spans, and all spans with what the field adds."""
    base = base_spans(text)
    if not base and not _TRIGGER.search(text):
        return base, base
    added = [x for a, b in zones(text, [(s, e) for s, _, e in base]) for x in model.decode(text, a, b)]
    return base, sorted(base + added) if added else base


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame, model: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row of ``docs(doc_id, text)``.

    Counts and hash are of the patterns' spans; spans (and their number) are all, in code points, end
    exclusive. Null texts count as empty; repeated rows and null ids each come back; no rows give no
    rows. Whole texts are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def one(batches):
        for b in batches:
            counts, hashes, every, n_all = [[] for _ in KINDS], [], [], []
            for text in b.column(1).to_pylist():
                base, spans = spans_of(text or "", held.value)
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in base))
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(spans))
                n_all.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(every, pa.string()), pa.array(n_all, pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, one, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_spans long")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping ones by the first's."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Field) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; other texts, rows and columns stay as they are, and n_chars follows."""
    names = docs.columns
    at = names.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def one(batches):
        for b in batches:
            texts = [t and redacted(t, spans_of(t, held.value)[1]) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns)], names)

    out = map_arrow(docs, one, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def trained(docs: DataFrame) -> Field:
    """The field, fitted on labelled sentences and on a bounded sample of zones of ``docs(doc_id, text)``."""
    return fit(examples() + training_zones(docs))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """``detect`` over every row of ``documents``, with a field fitted on a bounded sample of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect(docs, trained(docs))
