"""Byte-level BPE ids of whole texts, with a cache of space-led chunks.

The vocabulary splits a text before its merges, and never across the place where a space follows a
character that is not white space. So a text is the concatenation of its chunks (a space and what
follows it up to the next space), and the ids of a frequent chunk are looked up. Texts where that
does not hold (a space between two other white-space characters or at a white-space end, or the
text of a special token) go to the tokenizer whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the pattern by which this public vocabulary splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_IRREGULAR = re.compile(r"\s \s|\s $")


def _byte_of() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves, the
    others, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Chunks(dict):
    """Chunk without its leading space to its ids as little-endian 32-bit bytes."""

    LIMIT = 300_000  # chunks kept; further ones are encoded each time

    def __init__(self, encode) -> None:
        super().__init__()
        self._encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self._encode(" " + chunk), dtype="<u4").tobytes()
        if len(self) < self.LIMIT:
            self[chunk] = ids
        return ids


class ByteBpe:
    """``encode(text)`` gives the ids of the whole text as little-endian 32-bit bytes."""

    def __init__(self, vocabulary: bytes) -> None:
        """``vocabulary``: the content of a byte-level BPE ``tokenizer.json``."""
        self._exact = Tokenizer.from_buffer(vocabulary)
        spec = json.loads(vocabulary)
        byte = _byte_of()
        self._special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(byte[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self._special}
        self._plain = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._chunks = Chunks(self._plain.encode_ordinary)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _IRREGULAR.search(text) or any(s in text for s in self._special):
            return np.array(self._exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        head = np.array(self._plain.encode_ordinary(first), dtype="<u4").tobytes()
        return head + b"".join(map(self._chunks.__getitem__, rest))
