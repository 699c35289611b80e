"""Token ids of whole texts by a byte-level BPE vocabulary file.

Texts are cut before single spaces, where a pre-token of the vocabulary's pattern always
begins, and the ids of each piece are kept in a bounded table of the worker, so that
frequent words are encoded once. Texts with blanks before spaces, where that cut could
fall inside a pre-token, are encoded as a whole. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import re

import numpy as np

#: Pieces whose ids a worker keeps; others are encoded each time.
KEPT = 200_000
_BLANK_BEFORE_SPACE = re.compile(r"[\s\x1c-\x1f\x85] ")
_encoders: dict[str, Encoder] = {}


class _Ids(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(" " + word), np.uint32).tobytes()
        if len(self) < KEPT:
            self[word] = ids
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.kept = _Ids(self.whole)

    def ids(self, text: str) -> bytes:
        if _BLANK_BEFORE_SPACE.search(text):
            return np.array(self.whole(text), np.uint32).tobytes()
        first, *rest = text.split(" ")
        return np.array(self.whole(first), np.uint32).tobytes() + b"".join(map(self.kept.__getitem__, rest))


def encoder(path: str) -> Encoder:
    """The worker's encoder for a `.tiktoken` file of ranks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_width(path: str) -> int:
    """Bytes that any id of a `.tiktoken` file fits: 2 or 4."""
    with open(path, "rb") as f:
        return 2 if max(int(line.split()[1]) for line in f) < 1 << 16 else 4


def vocabulary() -> str:
    """The ranks of `byte_bpe_50k.json`: the same ids, in the form that encodes short pieces fast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")
