"""Token ids of whole texts by a public tokenizer file, with a cache of words.

A tokenizer splits a text into pieces before it merges bytes, and each kind of
file below always splits where white space follows something else. So the ids of
a text are those of its words one after another, and a word needs to be encoded
only once per worker. Texts with white space beyond single spaces and newlines
take a slower way with the same result; tokenizer files of another kind encode
every text whole.
"""

from __future__ import annotations

import json
import re
import struct

#: fixed values: tokenizer settings for which splitting at white space is exact
GPT_PATTERN_KIND = {
    "type": "ByteLevel",
    "add_prefix_space": False,
    "trim_offsets": True,
    "use_regex": True,
}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: white space that tokenizers and Python may see differently
ODD_SPACE = re.compile(
    "[\x1c-\x1f\x85\xa0 ᠎​ -     ⁠　﻿]"
)
CHUNK = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: marks that can follow a word; an apostrophe may open a contraction and is left out
TAIL = ".,;:!?%$#&*)(+-/<=>@]["
#: words kept in a generation: of vocabularies with one table of words, and with one for each of two places
MAX_WORDS, MAX_PLACED = 400_000, 100_000

class _IdBytes(dict):
    """Id -> its four bytes."""

    def __missing__(self, number: int) -> bytes:
        value = self[number] = struct.pack("<I", number)
        return value


ID_BYTES = _IdBytes()
_ENCODERS: dict[str, Encoder] = {}


class _Letters(dict):
    """Character -> the characters that stand for its bytes in a byte-level vocabulary."""

    def __missing__(self, code: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        value = self[code] = level.pre_tokenize_str(chr(code))[0][0]
        return value


class _Words(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit bytes.

    A word of letters is one piece, so the library's model can take it directly.
    Of more than ``most`` chunks, those not seen since the last change of
    generation are forgotten.
    """

    def __init__(self, tokenizer, prefix: str, fold: bool, bare: _Words | None = None):
        super().__init__()
        self.tokenizer, self.prefix, self.fold = tokenizer, prefix, fold
        self.most = MAX_WORDS if fold else MAX_PLACED
        self.model, self.letters, self.older = tokenizer.model, _Letters(), {}
        self.start = prefix.translate(self.letters)
        self.bare = self if bare is None else bare

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.pop(word, None)
        if value is None:
            value = self.encoded(word)
        self[word] = value
        return value

    def encoded(self, word: str) -> bytes:
        if word.isalpha():
            if word.isascii():
                # such letters stand for themselves in a byte-level vocabulary
                if self.fold and not word.islower():
                    return self[word.lower()]
                return b"".join([ID_BYTES[token.id] for token in self.model.tokenize(self.start + word)])
            if max(word) < "ɐ":
                low = word.lower() if self.fold else word
                if low != word and len(low) == len(word):
                    return self[low]
                if low == word:
                    tokens = self.model.tokenize((self.prefix + word).translate(self.letters))
                    return b"".join([ID_BYTES[token.id] for token in tokens])
        stem = word.rstrip(TAIL)
        # a letter that stays one when folded ends a piece before a mark
        if stem and len(stem) < len(word) and stem[-1].isalpha() and len(stem[-1].lower()) == 1:
            return self[stem] + self.bare[word[len(stem) :]]
        ids = self.tokenizer.encode(self.prefix + word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; special strings are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        self.kind = "whole"
        if spec.get("normalizer") is None and before == GPT_PATTERN_KIND:
            self.kind = "spaced"
        elif WORD_PATTERN in json.dumps(before, ensure_ascii=False).replace("\\\\", "\\"):
            self.kind = "words"
        fold = self.kind == "words"
        self.first = _Words(self.tokenizer, "", fold)
        self.later = _Words(self.tokenizer, "" if fold else " ", fold, self.first)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.kind == "whole":
            return self.whole(text)
        words = text.split()
        gaps = len(words) - 1
        # one space or newline between words and nothing else
        if words and sum(map(len, words)) + gaps == len(text) and text.count(" ") + text.count("\n") == gaps:
            if self.kind == "words":
                return b"".join(map(self.first.__getitem__, words))
            first, later, lines = self.first, self.later.__getitem__, []
            for line in text.split("\n"):
                start, *rest = line.split(" ")
                lines.append(first[start] + b"".join(map(later, rest)))
            return first["\n"].join(lines)
        if ODD_SPACE.search(text):
            return self.whole(text)
        return b"".join(map(self.first.__getitem__, CHUNK.findall(text)))


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
