"""Secret scans: pattern spans in whole texts, and encoded keys and tokens that are reported only if their structure parses."""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import take

#: In the order of ties: the base kinds, then those that structure confirms.
KINDS = ("assign", "access", "hex", "pem", "key", "jwt")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so the same spans as longer-than-15 matches of [0-9a-f]+
WORDS = ("passw", "secret", "token", "api")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{48,}={0,2}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{3,})\.([A-Za-z0-9_-]*)")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the base kinds; spans are of the whole match, in code points."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def tlv(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, bytes]] | None:
    """The DER elements that fill ``data[at:end]`` exactly, or None if tags and lengths do not parse."""
    end = len(data) if end is None else end
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or end - at < n or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
            if size < 0x80:
                return None
        if end - at < size:
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def der_key(data: bytes) -> bool:
    """Whether ``data`` is a DER private key: PKCS#1, PKCS#8 or SEC 1, with nested lengths that add up."""
    outer = tlv(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = tlv(outer[0][1])
    if not parts or len(parts) < 2 or parts[0][0] != 0x02 or len(parts[0][1]) != 1:
        return False
    version, tags = parts[0][1][0], [t for t, _ in parts]
    if version in (0, 1) and len(parts) >= 9 and all(t == 0x02 for t in tags[:9]) and len(parts[1][1]) >= 32:
        return True
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:
        algorithm = tlv(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(parts[2][1]) >= 16
    return version == 1 and tags[1] == 0x04 and 16 <= len(parts[1][1]) <= 66


def openssh_key(data: bytes) -> bool:
    """Whether ``data`` is an OpenSSH private key: the magic, three strings, a key count, and that many public keys."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if len(data) - at < 4 or len(data) - at - 4 < size:
            return None
        at += 4 + size
        return data[at - size : at]

    if any(string() is None for _ in range(3)) or len(data) - at < 4:
        return False
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= count <= 16 and all(string() for _ in range(count)) and string() is not None and at == len(data)


def unbase64(text: str) -> bytes | None:
    """Standard or URL-safe base64, padded or not; None if it is neither."""
    body = text.rstrip("=")
    if "+" in body or "/" in body:
        if "-" in body or "_" in body:
            return None
    else:
        body = body.translate({45: 43, 95: 47})
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def private_key(data: bytes | None) -> bool:
    return bool(data) and (der_key(data) or openssh_key(data))


def signed_token(header: str, payload: str) -> bool:
    """Whether the first two parts of a compact token are JSON objects and the header names an algorithm."""
    try:
        head, body = (json.loads(unbase64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of encoded secrets whose structure parses after decoding."""
    out = []
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), "pem", m.end()) for m in PEM.finditer(text) if private_key(unbase64("".join(m[2].split())))]
    inside = [(a, b) for a, _, b in out]
    for m in BASE64.finditer(text):
        if not any(a <= m.start() < b for a, b in inside) and private_key(unbase64(m[0])):
            out.append((m.start(), "key", m.end()))
    out += [(m.start(), "key", m.end()) for m in HEX_KEY.finditer(text) if private_key(bytes.fromhex(m[0]))]
    if text.count(".") > 1:
        out += [(m.start(), "jwt", m.end()) for m in JWT.finditer(text) if signed_token(m[1], m[2])]
    return out


def join(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_confirmed, base_spans, spans)`` for each row of ``docs``.

    Row by row, without a shuffle. Null texts count as empty and give no spans; ids may be null or repeat; texts are
    scanned whole. ``spans`` holds the base spans and the confirmed ones, which may overlap.
    """
    names = ("doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_spans", "spans")

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = confirmed_spans(text or "")
                for column, value in zip(out, [*(sum(s[1] == k for s in base) for k in KINDS[:3]), len(more), join(base), join(base + more)], strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:4]), *(pa.array(c, pa.string()) for c in out[4:])], list(names))

    rows = take(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_spans string, spans string")


