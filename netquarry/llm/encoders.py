"""Exact, fast encoders for two public byte-pair vocabularies.

A text is cut into units at places where no token can reach across: where white space follows
something else. A unit is encoded once per worker and kept in a bounded cache; a text is then a
walk over its units. Pieces of words that mark their ends are kept in the same way. Units of plain
Latin text are merged by tiktoken over the vocabulary's own ranks, all others (and those that hold
a special token) by the tokenizers library itself, whose ids are the definition; the tests hold the
two against each other.

Ids are kept as little-endian ``uint16`` bytes: both vocabularies have fewer than 65,536 entries.
"""

from __future__ import annotations

import base64
import json
import os
import re
import struct

import numpy as np

#: The characters of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
WORD = re.compile(f"[^{WHITE_SPACE}]+")
#: Python's split() also breaks at these, which are not white space for the tokenizers.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Latin letters, digits and signs, for which both libraries know the same character classes.
PLAIN = re.compile("[\x00-\u012f\u0131-\u017f]*")
#: The usual cut of a word into pieces; under it a word of letters alone is one piece.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHE_ENTRIES = 400_000
CACHED_CHARS = 64

_LOADED: dict[str, "ByteLevel | WordEnd"] = {}


def resolve(name: str) -> str:
    """The place of a vocabulary file: a path, or the name of one of the installed files."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}H", *ids)


class Memo(dict):
    """Unit -> packed ids (None: not a unit that can stand alone), emptied when full."""

    def __init__(self, encode, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.encode, self.entries = encode, entries

    def __missing__(self, unit: str):
        value = self.encode(unit)
        if len(unit) <= CACHED_CHARS:
            if len(self) >= self.entries:
                self.clear()
            self[unit] = value
        return value


class Reference:
    """The tokenizers library on one vocabulary file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = tuple(
            token.content for token in self.tokenizer.get_added_tokens_decoder().values()
        )
        self.specials = re.compile("|".join(map(re.escape, self.special)) or "(?!)")

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def has_special(self, text: str) -> bool:
        return self.specials.search(text) is not None


class ByteLevel(Reference):
    """Byte-level vocabulary with a ``.tiktoken`` file of the same ranks beside it."""

    def __init__(self, path: str):
        super().__init__(path)
        import public_tokenizers
        import tiktoken

        ranks = {}
        with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.merger = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.bytes_of = np.empty(65536, dtype=object)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        for rank, token in self.tokenizer.get_added_tokens_decoder().items():
            self.bytes_of[rank] = token.content.encode()
        self.units = Memo(self._unit)
        self.spaced = Memo(self._spaced)

    def _unit(self, unit: str) -> bytes:
        if PLAIN.fullmatch(unit) and not self.has_special(unit):
            return packed(self.merger.encode_ordinary(unit))
        return packed(self.ids(unit))

    def _spaced(self, word: str) -> bytes | None:
        """Ids of a blank and ``word``, or of ``word`` itself where it begins with a line feed."""
        if not word or WORD.fullmatch(word[-1]) is None:
            return None
        return self._unit(word if word[0] == "\n" else " " + word)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *words = text.replace("\n", " \n").split(" ")
        if first and WORD.fullmatch(first[-1]):
            try:
                return self.units[first] + b"".join(map(self.spaced.__getitem__, words))
            except TypeError:  # runs of white space: cut with the full rule
                pass
        return b"".join(map(self.units.__getitem__, UNIT.findall(text)))

    def decode(self, ids: np.ndarray) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)``."""
        return b"".join(self.bytes_of[ids].tolist()).decode("utf-8", "replace")


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters stand for
    themselves, the other bytes for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordEnd(Reference):
    """Lower-cased vocabulary whose tokens mark the end of a word.

    Every merge's rank is its token's id, so the merges can be run on bytes: the end mark becomes
    the byte 0xFF, which UTF-8 never uses. Where a vocabulary is not built so, every unit goes to
    the library."""

    END = b"\xff"

    def __init__(self, path: str):
        super().__init__(path)
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
        suffix = model["model"]["end_of_word_suffix"]
        pairs = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        first = vocabulary[pairs[0]]
        self.ordered = all(vocabulary[p] == first + i for i, p in enumerate(pairs))
        split = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        self.uncut = self.ordered and split == SPLIT and not any(map(str.isalpha, self.special))
        symbols, ranks = byte_symbols(), {}
        for token, rank in vocabulary.items():
            if token in self.special:
                continue
            ends = token.endswith(suffix)
            body = token[: -len(suffix)] if ends else token
            ranks[bytes(symbols[c] for c in body) + (self.END if ends else b"")] = rank
        self.merger = tiktoken.Encoding(
            "word ends", pat_str=".+", mergeable_ranks=ranks, special_tokens={}
        )
        self.words, self.parts = Memo(self._word), Memo(self._part)

    def _part(self, piece: str) -> bytes:
        return packed(self.merger._encode_single_piece(piece.encode() + self.END))

    def _word(self, word: str) -> bytes:
        if self.uncut and word.isalpha() and (word.isascii() or PLAIN.fullmatch(word)):
            return self.parts[word.lower()]
        if not self.ordered or not PLAIN.fullmatch(word) or self.has_special(word):
            return packed(self.ids(word))
        # new words are often made of known pieces: digits, signs, a word before a full stop
        return b"".join(map(self.parts.__getitem__, self.pieces.findall(word.lower())))

    def encode(self, text: str) -> bytes:
        words = WORD.findall(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, words))


def byte_level(name: str) -> ByteLevel:
    if name not in _LOADED:
        _LOADED[name] = ByteLevel(resolve(name))
    return _LOADED[name]


def word_end(name: str) -> WordEnd:
    if name not in _LOADED:
        _LOADED[name] = WordEnd(resolve(name))
    return _LOADED[name]
