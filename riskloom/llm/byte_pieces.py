"""Text pieces of the public BPE vocabularies, split as their library does.

Two vocabularies are read here by path: the byte-level one (pieces keep a
leading space) and the word one (lower case, white space dropped).  Splitting
uses a compiled pattern where every character is of a range whose classes and
normal forms cannot differ between Unicode versions; other texts are split by
the library's own normalizer and pre-tokenizer.
"""

from __future__ import annotations

import functools
import json
import re

import regex

# The split patterns of the two vocabularies.  White space is
# written out because the library's \s leaves out U+001C to U+001F.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_S}\p{{L}}\p{{N}}]+"
# Characters outside of these ranges take the library's path: Latin blocks
# (without the dotted capital I, whose lower case is two characters) and the
# common punctuation marks are classed and composed alike everywhere.
_UNUSUAL = re.compile(r"[^\x00-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


@functools.cache
def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1
    bytes stand for themselves, the others are numbered from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.cache
def alphabet_bytes() -> dict[str, int]:
    return {c: b for b, c in byte_alphabet().items()}


def to_alphabet(raw: bytes) -> str:
    a = byte_alphabet()
    return "".join([a[b] for b in raw])


class Vocabulary:
    """A vocabulary file of the tokenizers library, opened inside a worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.lower = spec["normalizer"] is not None
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._split = regex.compile(WORD_PATTERN if self.lower else BYTE_PATTERN).findall

    def segments(self, text: str) -> list[str]:
        """Text and special strings in turn; special ones at odd places."""
        return self._cut.split(text)

    def pieces(self, segment: str) -> list[str]:
        """Pieces of a segment without special strings; as text.  The library's
        path maps its byte letters back to text."""
        if _UNUSUAL.search(segment) is None:
            return self._split(segment.lower() if self.lower else segment)
        if self.lower:
            segment = self.library.normalizer.normalize_str(segment)
        back = alphabet_bytes()
        return [bytes([back[c] for c in p]).decode("utf-8")
                for p, _ in self.library.pre_tokenizer.pre_tokenize_str(segment)]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
