"""Encoding whole texts with a public tokenizer inside Spark tasks.

A blank between two non-blank characters always ends a piece of a byte-level tokenizer, so a
text is cut there and equal pieces are encoded once per worker. The cache is cleared when it
is full; it only saves time.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

CUT = re.compile(r"(?<=\S) (?=\S)")
CACHE_PIECES = 400_000
DEFAULT = "byte_bpe_50k.json"
_encoders: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = DEFAULT) -> str:
    return public_tokenizers.path(name)


def _ranks(path: str) -> tiktoken.Encoding | None:
    """The same vocabulary as a rank file, where one lies beside the tokenizer's file."""
    if not os.path.exists(path):
        return None
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, as the tokenizer gives them without special tokens added.

    The string of an added token in a text has that token's id and ends the pieces beside it.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        longest = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.pieces: dict[str, bytes] = {}
        self.ranks = _ranks(path.removesuffix(".json") + ".tiktoken")

    def _learn(self, pieces: list[str]) -> None:
        if self.ranks:  # the same ids; much cheaper for a single word
            for piece in pieces:
                self.pieces[piece] = array("I", self.ranks.encode_ordinary(piece)).tobytes()
            return
        for piece, got in zip(pieces, self.tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True):
            self.pieces[piece] = array("I", got.ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split and self.split.search(text):
            if not self.plain:
                return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            return b"".join(self.added[part] if part in self.added else self._ordinary(part) for part in self.split.split(text))
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = CUT.split(text)
        cut = [first, *[" " + x for x in rest]]
        known = self.pieces
        try:
            return b"".join([known[x] for x in cut])
        except KeyError:
            if len(known) > CACHE_PIECES:
                known.clear()
            self._learn(list({x for x in cut if x not in known}))
            return b"".join([known[x] for x in cut])


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file, read from the tokenizers' own package."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
