"""Byte-level BPE ids in tasks, with a cache of words.

The pre-tokeniser never joins what a lone space parts, so a text without runs of white space around spaces is encoded
space-led word by word, each distinct word once per cache. Words are encoded by ``tiktoken`` from the same vocabulary's
ranks, which is several times faster than ``tokenizers`` and gives the same ids; a text that holds the string of the
special token goes to ``tokenizers`` itself, which knows it.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

#: Words a task keeps; when full the cache starts anew.
CACHE_WORDS = 400_000
SPECIAL = "<|endoftext|>"
_IRREGULAR = re.compile(r"  |\s \s")


def default_files() -> tuple[str, str]:
    """The vocabulary for ``tokenizers`` and its ranks for ``tiktoken``, where the public package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def multilingual_files() -> tuple[str, str]:
    """A vocabulary for many languages; it has ranks only, and no special token."""
    import public_tokenizers

    return "", public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class _Words(dict):
    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = array("I", self.encode(self.lead + word)).tobytes()
        if len(word) < 64:
            self[word] = ids
        return ids


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer_file: str, ranks_file: str):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        core = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = core.encode_ordinary
        self.tokenizer_file, self.full = tokenizer_file, None
        self.first, self.rest = _Words(self.whole, ""), _Words(self.whole, " ")

    def _with_special(self, text: str) -> list[int]:
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.tokenizer_file)
        return self.full.encode(text, add_special_tokens=False).ids

    def count(self, text: str) -> int:
        """The number of ids. Whole texts: a cache of words costs more than it saves where most words are rare."""
        special = self.tokenizer_file and SPECIAL in text
        return len(self._with_special(text) if special else self.whole(text))

    def encode(self, text: str) -> bytes:
        if self.tokenizer_file and SPECIAL in text:
            return array("I", self._with_special(text)).tobytes()
        if _IRREGULAR.search(text):
            return array("I", self.whole(text)).tobytes()
        head, *tail = text.split(" ")
        return self.first[head] + b"".join(map(self.rest.__getitem__, tail))


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str, ranks_file: str) -> Encoder:
    """One per Python worker."""
    return Encoder(tokenizer_file, ranks_file)
