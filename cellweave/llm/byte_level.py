"""Pretokens of byte-level vocabularies, as strings of their printable byte alphabet."""

from __future__ import annotations

import json

import regex

from cellweave.llm.common import special_tokens, tokenizer

#: Pretoken pattern of the byte-level vocabulary (fixed value of that tokenizer).
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Up to here all Unicode versions class characters alike; beyond, the library itself cuts.
STABLE = regex.compile(r"[\x00-ſ]*")


def byte_alphabet() -> dict[int, str]:
    """Byte to the printable character that stands for it in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


_PRINTABLE = byte_alphabet()


class Pretokenizer:
    """Cuts a piece of text into pretokens and special strings as a vocabulary file's library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.spec = spec
        self.special = special_tokens(path)
        self._library = tokenizer(path).pre_tokenizer
        names = sorted(self.special, key=len, reverse=True)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def __call__(self, text: str) -> list[str]:
        """Pretokens in the byte alphabet; special strings come as they are."""
        if self._cut is not None and self._cut.search(text):
            out = []
            for i, part in enumerate(self._cut.split(text)):
                out += [part] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if STABLE.fullmatch(text):
            return [p.encode("utf-8").decode("latin-1").translate(_PRINTABLE) for p in PRETOKENS.findall(text)]
        return [p for p, _ in self._library.pre_tokenize_str(text)]
