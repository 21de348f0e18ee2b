"""Token ids of whole texts by the ``tokenizers`` library, with a word cache in front of it.

A byte-level BPE splits a text into words by a fixed pattern and encodes each word by itself, so the ids of a
text are the joined ids of its words. A worker keeps the ids of words it has met. Only texts whose characters
are all in a range where the pattern's classes are certain take this way; any other text (and any text that
holds a special token's string) is encoded by the library as a whole. Characters are judged when a word is new:
no word with another character is kept, so a text of kept words has none.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable

#: The character classes of the byte-level BPE pattern within U+0000-U+024F and common punctuation.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t\n\x0b\x0c\r\x20\xa0"
CERTAIN = "\x00-\x1b\x20-\x84\x86-\u024f\u2010-\u2027\u2030-\u203e\u20ac"

#: The fast way is checked against this pre-tokenizer only; other files always go to the library.
BYTE_LEVEL = "ByteLevel"
#: A worker keeps so many words of so many characters at most, twice: those met last and those before them.
CACHE_WORDS, CACHED_CHARS = 400_000, 64


class Uncertain(Exception):
    """A word has a character whose class isn't certain."""


class Words(dict):
    """Ids of the words met last; those met ``before`` them come back when they are asked for, and new ones from ``learn``."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.learn(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordEncoder:
    """``ids(text)`` gives the text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_words = (
            pre.get("type") == BYTE_LEVEL
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and spec.get("normalizer") is None
            and spec["model"]["type"] == "BPE"
        )
        self.model = self.tokenizer.model
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.uncertain = re.compile(f"[^{CERTAIN}]").search
        # A space run gives its last space to a following word, unless another blank ends it.
        self.words = re.compile(
            f"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
        ).findall
        # A byte is spelt as its own character if that is visible in Latin-1, else as the next one from U+0100 on.
        visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = (b for b in range(256) if b not in visible)
        self.spelling = {b: 0x100 + k for k, b in enumerate(hidden)}
        self.space = chr(self.spelling[0x20])
        self.known = Words(self._single)

    @property
    def before(self) -> dict[str, bytes]:
        return self.known.before

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _single(self, word: str) -> bytes:
        """A word's ids by the library's model, the word being spelt in its characters for bytes."""
        if self.uncertain(word):
            raise Uncertain
        if word.isascii() and word.isprintable():
            spelt = word.replace(" ", self.space)
        else:
            spelt = word.encode().decode("latin-1").translate(self.spelling)
        return _packed([t.id for t in self.model.tokenize(spelt)])

    def ids(self, text: str) -> bytes:
        if not self.by_words or any(s in text for s in self.specials):
            return self._whole(text)
        try:
            return b"".join(map(self.known.__getitem__, self.words(text)))
        except Uncertain:
            return self._whole(text)


def _packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
