"""Message strings: control sequences, tags, encodings, widths and hashes."""

from __future__ import annotations

import re

ESCAPE = 0x1A
# Names of the control sequences' tags by (group, kind), and the encodings' names.
TAGS = {(255, 0): "Color", (255, 1): "Size", (255, 2): "Ruby", (255, 3): "Font"}
ENCODINGS = {1: "cp1252", 2: "utf-16-le", 3: "shift_jis", 4: "utf-8"}
_TAG = re.compile(r"\[(Color|Size|Font):(\d+)\]|\[Ruby:([^\]|]*)\|([^\]]*)\]|\[(\d+):(\d+):([0-9A-Fa-f]*)\]", re.I)


def units(data: bytes, size: int = 1) -> int:
    """Bytes of a string of 1- or 2-byte characters up to its terminator; control sequences are passed over whole."""
    at = 0
    while at + size <= len(data):
        c = int.from_bytes(data[at : at + size], "little")
        if c == 0:
            return at
        if c == ESCAPE:
            n = data[at + size] if at + size < len(data) else 0
            at += max(n, size)
        else:
            at += size
    return len(data)


def sequence(group: int, kind: int, payload: bytes, size: int = 1) -> bytes:
    """A control sequence: escape, whole length, group, kind, payload."""
    body = bytes((group,)) + kind.to_bytes(2, "little") + payload
    return ESCAPE.to_bytes(size, "little") + bytes((size + 1 + len(body),)) + body


def compile_text(text: str, encoding: int = 4) -> bytes:
    """Text with tags in brackets as bytes; what isn't a known tag stays text. Names may be in either case."""
    name = ENCODINGS[encoding]
    size = 2 if encoding == 2 else 1
    out, at = b"", 0
    for m in _TAG.finditer(text):
        out += text[at : m.start()].encode(name, "replace")
        at = m.end()
        if m[1]:
            kind = next(k for k, n in TAGS.items() if n.lower() == m[1].lower())
            out += sequence(*kind, bytes((int(m[2]) & 0xFF,)), size)
        elif m[3] is not None:
            ruby = m[4].encode(name, "replace")
            out += sequence(255, 2, bytes((len(m[3]) & 0xFF,)) + ruby, size) + m[3].encode(name, "replace")
        else:
            out += sequence(int(m[5]) & 0xFF, int(m[6]) & 0xFFFF, bytes.fromhex(m[7][: len(m[7]) // 2 * 2]), size)
    return out + text[at:].encode(name, "replace")


def decode_text(data: bytes, encoding: int = 4) -> str:
    """The inverse of ``compile_text``."""
    name = ENCODINGS[encoding]
    size = 2 if encoding == 2 else 1
    out, at, start = [], 0, 0
    esc = ESCAPE.to_bytes(size, "little")
    while at + size <= len(data):
        if data[at : at + size] != esc:
            at += size
            continue
        out.append(data[start:at].decode(name, "replace"))
        n = data[at + size] if at + size < len(data) else 0
        body = data[at + size + 1 : at + n]
        group, kind, payload = body[0] if body else 0, int.from_bytes(body[1:3], "little"), body[3:]
        tag = TAGS.get((group, kind))
        at += max(n, size)
        if tag == "Ruby" and payload:
            base, used = "", 0
            while len(base) < payload[0] and at + used < len(data):
                used += size
                base = data[at : at + used].decode(name, "ignore")
            out.append(f"[Ruby:{base}|{payload[1:].decode(name, 'replace')}]")
            at += used
        elif tag and payload:
            out.append(f"[{tag}:{payload[0]}]")
        else:
            out.append(f"[{group}:{kind}:{payload.hex().upper()}]")
        start = at
    return "".join([*out, data[start:].decode(name, "replace")])


def recode(data: bytes, old: int, new: int) -> bytes:
    """A message in another encoding, its tags kept."""
    return compile_text(decode_text(data, old), new)


def name_hash(name: bytes) -> int:
    """A name's 16-bit hash: each byte, as a signed number, is exclusive-ored in, the whole turned right by 5 and its
    upper byte added; the length is exclusive-ored in at the end."""
    h = 0
    for b in name:
        h ^= b - 256 & 0xFFFF if b > 127 else b
        h = h >> 5 | h << 11 & 0xFFFF
        h = h + (h >> 8) & 0xFFFF
    return h ^ len(name) & 0xFFFF


def code_of(spec: str) -> int:
    """A character or a code in decimal, 0x or U+ form."""
    if re.fullmatch(r"(0x|U\+)[0-9A-Fa-f]+", spec, re.I):
        return int(spec[2:], 16)
    return int(spec) if re.fullmatch(r"\d{2,}", spec) else ord(spec[0])
