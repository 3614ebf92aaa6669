"""Suffix arrays by two-stage sorting, in numpy, and the repeats that they show.

Only suffixes that are smaller than their successors are sorted directly. All others are induced: a
scan over the buckets of first characters, from the smallest, puts before each suffix that is
already placed its predecessor, if that one is larger, at the next free place of its own bucket.
"""

from __future__ import annotations

import numpy as np


def words8(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number; zeros follow the end."""
    n = len(text)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = text
    out = np.empty(n + 8, np.uint64)
    for r in range(8):
        part = padded[r : r + (n + 15 - r) // 8 * 8].view(">u8")
        out[r::8] = part[: len(out[r::8])]
    return out[:n]


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the next; the last isn't, what follows it being empty."""
    n = len(text)
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    sign[-1] = -1
    at = np.where(sign != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]  # equal characters have the order of what follows them
    return sign[following] > 0


def _sorted_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``places`` ordered by up to ``depth`` bytes, 8 at a time, ties alone going on."""
    n = len(words)
    out = places[np.argsort(words[places], kind="stable")]
    key = words[out]
    group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) if len(out) else np.zeros(0, np.int64)
    tied = np.flatnonzero(np.bincount(group)[group] > 1) if len(out) else group
    for step in range(8, depth, 8):
        if not len(tied):
            break
        p, g = out[tied], group[tied]
        far = p + step
        key = np.where(far < n, words[np.minimum(far, n - 1)], 0)
        order = np.lexsort((key, g))
        p, key = p[order], key[order]
        out[tied] = p  # groups hold the same places as before
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])))
        number = np.cumsum(new)
        still = np.bincount(number)[number] > 1
        group[tied] = number
        tied = tied[still]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes of bytes, ordered by their first ``depth`` bytes at least."""
    text = np.asarray(text, np.uint8)
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = words8(text)
    small = smaller_than_successor(text)
    direct = _sorted_directly(np.flatnonzero(small), words, depth)
    first = text[direct]
    edges = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))  # the empty suffix, the least of all, puts the last one first in its bucket
    out = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        induced = waiting[c]
        wave = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        large = [wave]
        while len(wave):  # runs of one character induce within their own bucket
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & ~small[before]]
            large.append(wave)
        bucket = np.concatenate([*large, direct[edges[c] : edges[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~small[before] & (text[before] > c)]
        if len(before):
            chars = text[before]
            order = np.argsort(chars, kind="stable")
            before, chars = before[order], chars[order]
            cuts = np.flatnonzero(np.diff(chars)) + 1
            for part in np.split(before, cuts):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def repeated_starts(contents: list[bytes], length: int) -> list[np.ndarray]:
    """For each content, whether the ``length`` bytes from each of its places occur at another place of any content.

    Neighbours in the suffix array that share ``length`` bytes are all the repeats there are. The
    contents lie one after another; what starts less than ``length`` before a content's end doesn't
    count, so no match reaches from one content into the next.
    """
    sizes = np.array([len(c) for c in contents], np.int64)
    text = np.frombuffer(b"".join(contents), np.uint8)
    stops = np.cumsum(sizes)
    counted = np.ones(len(text), bool)
    for stop, size in zip(stops.tolist(), sizes.tolist(), strict=True):
        counted[max(stop - size, stop - length + 1) : stop] = False
    order = suffix_array(text, length)
    order = order[counted[order]]
    found = np.zeros(len(text), bool)
    if len(order) > 1:
        words = words8(text)
        left, right = order[:-1], order[1:]
        for step in [*range(0, length - 8, 8), length - 8]:
            same = words[left + step] == words[right + step]
            left, right = left[same], right[same]
        found[left] = found[right] = True
    return [found[max(0, stop - size) : max(0, stop - size) + max(0, size - length + 1)] for stop, size in zip(stops.tolist(), sizes.tolist(), strict=True)]
