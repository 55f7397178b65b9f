"""Exact tokenisation of whole texts, with the ids of blank-separated chunks cached.

Both vocabularies split a text at white space before merging, so where every white space stands alone a text
can be encoded chunk by chunk; a text with runs of white space goes through the tokenizer whole, and so does a text
that may hold one of the vocabulary's added tokens, which the library finds before anything else. Ids come from the
tokenizers library, with its own settings, either way: a string like <|endoftext|> in a text gets that token's id.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

#: Chunks in a generation of the cache; there are two at most, so memory is bounded (about 250 bytes a chunk).
CACHE = 500_000
_RUN = re.compile(r"\s\s")
#: Marks that are a token of their own after a letter (no apostrophe: it may begin a contraction).
_MARKS = ".,;:!?()[]|*#$%&-"


class _Chunks(dict):
    """Ids by chunk. A chunk that ends in marks after a letter is the chunk without them and the marks, as both
    vocabularies cut there; with lower, A-Z and Latin letters are lowered first, as the normaliser does. A full
    generation becomes the old one; what is asked for again comes back from it."""

    def __init__(self, encode, lower: bool):
        self.encode, self.lower, self.old = encode, lower, {}

    def __missing__(self, chunk: str) -> bytes:
        got, keep = self.old.get(chunk), True
        if got is None:
            base = chunk.rstrip(_MARKS)
            if len(base) < len(chunk) and base and base[-1].isalpha() and base[-1] < "\u0100":
                keep = base in self  # a variant of a word that is new itself is likely as rare
                got = self[base] + self[chunk[len(base) :]]
            elif self.lower and not chunk.islower() and max(chunk) < "\u0100" and (low := chunk.lower()) != chunk:
                keep = low in self
                got = self[low]
            else:
                got = self.encode(chunk)
        if keep and len(chunk) <= 32:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[chunk] = got
        return got


def _latin(text: str) -> bool:
    """Whether lower() does letter by letter what the normaliser does: no letter beyond Latin-1."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """path: a tokenizers JSON file. leading: whether a word's id holds the blank before it (byte-level
    vocabularies), else blanks vanish."""

    def __init__(self, path: str, leading: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.leading = leading
        #: What any text with an added token holds: marks that no normaliser makes of something else.
        self.openings = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.chunks = _Chunks(self.whole, not leading)
        self.newline = self.whole("\n")
        self.chunks[""] = b""

    def whole(self, text: str) -> bytes:
        ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(x in text for x in self.openings):
            return self.whole(text)
        c = self.chunks
        if not self.leading:
            if _latin(text):
                text = text.lower()
            return b"".join([c[x] for x in text.replace("\n", " ").split(" ")])
        if _RUN.search(text):
            return self.whole(text)
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(b"".join([c[first] if first else b"", *[c[" " + x] for x in rest]]))
        return self.newline.join(out)


@lru_cache(maxsize=4)
def encoder(path: str, leading: bool) -> Encoder:
    """The process's encoder for a file: a Python worker keeps it, and its cache, from task to task."""
    return Encoder(path, leading)
