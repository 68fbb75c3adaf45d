"""Exact token ids from public tokenizer files, fast on ordinary text.

A byte-pair tokenizer encodes each pre-token by itself, so the ids of a text are those of its pre-tokens in order.
For texts of well-known Latin characters the pre-tokens are split here and the ids of each are kept in a bounded memo;
every id comes from the tokenizers library. Any other text is encoded by the library as a whole.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

#: Characters on which this module's splitting is known to agree with the library's: their classes and lower case are old and fixed.
_PLAIN = "\t\n\r" + "".join(map(chr, range(0x20, 0x7F))) + "".join(chr(c) for c in range(0xA1, 0x180) if c not in (0xAD, 0x130))
#: Pre-tokens that one worker remembers, about 0.2 KB each: 80 MB. Those used of late stay, in two generations of half as many.
MEMO = 400_000
#: Characters of texts whose pre-tokens are held at once, but for a single longer text.
GROUP = 1 << 18


def _of(kind: str) -> str:
    return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)


def _alphabet() -> dict[int, str]:
    """The byte alphabet of byte-level models: bytes that are visible in Latin-1 are themselves, the others follow from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(other)}


_ALPHABET = _alphabet()


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes. Special-token strings in a text are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocab = self.tokenizer.get_vocab_size()
        self.split, self.lower = _splitter(_layout(path))
        self.odd = re.compile(f"[^{re.escape(_PLAIN)}]")
        self.model = self.tokenizer.model
        self.recent: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str | None) -> bytes:
        return next(self.each([text]))

    def each(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; a group's pre-tokens that are not remembered go to the library together."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        found: list = []  # bytes, or the pre-tokens' ids with the places of those that lack
        lacking: dict[str, bytes | None] = {}
        recent, before = self.recent, self.before
        for text in texts:
            if self.split is None or "<|" in text or self.odd.search(text):
                found.append(self.whole(text))
                continue
            pieces = self.split(text.lower() if self.lower else text)
            ids = list(map(recent.get, pieces))
            gaps = [i for i, known in enumerate(ids) if known is None]
            unknown = [pieces[i] for i in gaps]
            lacking.update(zip(unknown, map(before.get, unknown), strict=True))
            found.append((ids, gaps, unknown))
        new = [piece for piece, known in lacking.items() if known is None]
        if new:
            lacking.update(zip(new, self._encode(new), strict=True))
        out = []
        for part in found:
            if isinstance(part, tuple):
                ids, gaps, unknown = part
                for i, piece in zip(gaps, unknown, strict=True):
                    ids[i] = lacking[piece]
                part = b"".join(ids)
            out.append(part)
        self._remember(lacking)
        return out

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token.

        Each is a word of the library's model as it is, written in the byte alphabet: both layouts end in it, and these characters
        are normalised already. Zero bytes are in no pre-token.
        """
        words = "\0".join(pieces).encode().decode("latin-1").translate(_ALPHABET).split(_ALPHABET[0])
        return [_packed([token.id for token in self.model.tokenize(word)]) for word in words]

    def _remember(self, pieces: dict[str, bytes]) -> None:
        for piece in [piece for piece in pieces if len(piece) >= 64]:
            del pieces[piece]
        if len(self.recent) + len(pieces) > MEMO // 2:
            self.before, self.recent = self.recent, {}
        self.recent.update(pieces)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _layout(path: str) -> dict:
    import json

    with open(path) as f:
        return {k: v for k, v in json.load(f).items() if k in ("normalizer", "pre_tokenizer", "post_processor", "truncation", "padding")}


def _splitter(layout: dict):
    """A pre-token splitter for the two known layouts, else None; and whether text is lower-cased first."""
    letter, number = _of("L"), _of("N")
    if layout.get("post_processor") or layout.get("truncation") or layout.get("padding"):
        return None, False
    pre, norm = layout["pre_tokenizer"] or {}, layout["normalizer"] or {}
    if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return re.compile(rf" ?[{letter}]+| ?[{number}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+").findall, False  # the most frequent first
    steps = [n.get("type") for n in norm.get("normalizers", [])]
    inner = pre.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in inner] == ["Split", "ByteLevel"] and not inner[1].get("use_regex") and not inner[1].get("add_prefix_space"):
        if inner[0].get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+").findall, True
    return None, False


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)
