"""Ids of public tokenizers, faster than the tokenizers library gives them.

The tokenizers library cuts a text into words before it merges, and merges never cross words. So the ids of a text are
those of its words in order. For the byte-level vocabulary, tiktoken cuts and merges by the ranks of the same file; for
the other one, each worker looks up words it has met before, and the library encodes every new word. Texts with characters
whose treatment might differ (outside Latin script and common punctuation, control characters) are encoded by the library
as they are.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

#: Texts of these characters only need no library: no combining marks, no case rules of their own.
PLAIN = re.compile(r"[\t\n\r\x20-\x7E\xA1-\u0131\u0134-\u017E\u2010-\u2027\u20AC]*")
#: The letters, numbers and white space among them, and the word pattern of the lower-case vocabulary.
_L = r"A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\u0131\u0134-\u017E"
_N = r"0-9\xB2\xB3\xB9\xBC-\xBE"
LOWER_WORDS = re.compile(rf"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^\t\n\r\x20{_L}{_N}]+")
CACHED_WORDS = 700_000


class Encoder:
    """Ids as arrays of unsigned 32-bit integers. Sent to a task it is a path; what it loads stays in the worker."""

    def __init__(self, path: str) -> None:
        self.path = path

    @property
    def library(self):
        return _library(self.path)

    def whole(self, text: str) -> np.ndarray:
        """Ids by the library alone."""
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def plain(self, text: str) -> np.ndarray:
        return self.whole(text)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none if it is null or empty."""
        if not text:
            return np.empty(0, np.uint32)
        return self.plain(text) if PLAIN.fullmatch(text) else self.whole(text)


class ByteEncoder(Encoder):
    """A byte-level vocabulary."""

    def plain(self, text: str) -> np.ndarray:
        return np.asarray(_ranked(self.path).encode_ordinary(text), np.uint32)


class WordEncoder(Encoder):
    """A vocabulary of lower-case words."""

    def plain(self, text: str) -> np.ndarray:
        known = _known(self.path)
        if len(known) > CACHED_WORDS:
            known.clear()
        found = LOWER_WORDS.findall(text.lower())
        new = [word for word in set(found) if word not in known]
        if new:
            model, written = self.library.model, _characters()
            for word in new:  # cut and lower case already: only the merges are left
                merged = model.tokenize(word.encode().decode("latin-1").translate(written))
                known[word] = np.asarray([token.id for token in merged], np.uint32).tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, found)), np.uint32)


# Spark uses a Python worker for one task after another: these live as long as it does.
@cache
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task its cores
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True  # their strings in a text are ordinary text
    return loaded


@cache
def _known(path: str) -> dict[str, bytes]:
    return {}


@cache
def _characters() -> dict[int, str]:
    """How the files write a byte: as itself where that can be printed, else as a character from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


@cache
def _ranked(path: str):
    """The byte-level vocabulary for tiktoken."""
    import public_tokenizers
    import tiktoken

    byte_of = {c: b for b, c in _characters().items()}
    library = _library(path)
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in library.get_vocab().items() if token not in special}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_encoder(path: str | None = None) -> Encoder:
    import public_tokenizers

    return ByteEncoder(path or public_tokenizers.path("byte_bpe_50k.json"))


def word_encoder(path: str | None = None) -> Encoder:
    import public_tokenizers

    return WordEncoder(path or public_tokenizers.path("word_bpe_49k.json"))
