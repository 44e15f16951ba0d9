"""Token lengths and ids of the tokenizers library with each pre-token or text encoded the cheapest way that gives them."""

from __future__ import annotations

import base64
import re
import sys
from array import array
from itertools import chain

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Letters, numbers and white space of Latin-1 as the Unicode classes L, N and White_Space have them.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t\n\x0b\x0c\r \x85\xa0"

# Fixed value: the splitting pattern of the vocabulary file word_bpe_49k.json, with the classes spelt out for Latin-1.
WORD_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")

#: Pre-tokens that a worker's cache holds at most, but for those of one batch; a full cache is emptied and filled anew.
CACHE = 400_000


class Encoder:
    """A vocabulary file in the tokenizers library, and the texts that may be cut here: those in Latin-1 without a special token's string."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return "<|" not in text or not any(s in text for s in self.special)

    def pretokens(self, text: str) -> list[str]:
        return WORD_PATTERN.findall(text.lower())

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


class Lengths:
    """Numbers of tokens: the frequent pre-tokens' are given; a batch's other pre-tokens are encoded together, once, and kept up to CACHE entries."""

    def __init__(self, encoder: Encoder, frequent: dict[str, int]) -> None:
        self.encoder, self.frequent, self.cache = encoder, frequent, dict(frequent)
        size = encoder.library.get_vocab_size()
        ends = (encoder.library.id_to_token(i) or "" for i in range(size))
        self.ends = np.fromiter((t.endswith("</w>") for t in ends), bool, size)

    def _encode(self, fresh: list[str]) -> None:
        # white space is dropped and every pre-token ends in a token that ends a word, so one text can hold them all
        at = np.flatnonzero(self.ends[np.array(self.encoder.ids(" ".join(fresh)), np.int64)])
        if len(at) == len(fresh):
            self.cache.update(zip(fresh, np.diff(at, prepend=-1).tolist(), strict=True))
        else:
            self.cache.update((t, len(self.encoder.ids(t))) for t in fresh)

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.encoder.pretokens(t) if self.encoder.plain(t) else None for t in texts]
        met = set(chain.from_iterable(c for c in cut if c))
        if fresh := [t for t in met if t not in self.cache]:
            if len(self.cache) + len(fresh) > len(self.frequent) + CACHE:
                self.cache = dict(self.frequent)  # with it go pre-tokens of this batch, so they are encoded anew
                fresh = [t for t in met if t not in self.cache]
            self._encode(fresh)
        known = self.cache.__getitem__
        return [len(self.encoder.ids(t)) if c is None else sum(map(known, c)) for t, c in zip(texts, cut, strict=True)]


class Ids:
    """Token ids of whole texts as little-endian 32-bit bytes, by the library or, for Latin-1 texts without special strings, by the same vocabulary as ranks.

    The ranks give the library's ids several times faster; other texts go to the library, whose tables of Unicode classes may differ.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str) -> None:
        self.encoder = Encoder(path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> array:
        return array("I", self.fast(text) if self.encoder.plain(text) else self.encoder.ids(text))


def packed(ids: array) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    if sys.byteorder == "big":
        ids = ids[:]
        ids.byteswap()
    return ids.tobytes()
