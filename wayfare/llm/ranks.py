"""Byte-level vocabularies in rank files, and their encoder in a Python worker."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

# The encoder's pattern needs stack for each character of a run of white space; longer runs
# are cut out and encoded as the single piece that the pattern makes of them.
LONG_RUN = 10_000
_white = r"\t-\r \x85\xa0  -     　"
_long = re.compile(f"[{_white}]{{{LONG_RUN},}}")


class Ranks:
    """Encoder of a rank file: base64 token and rank on each line."""

    def __init__(self, content: bytes, pattern: str):
        import tiktoken

        lines = map(bytes.split, content.splitlines())
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.size = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.lengths = np.array([len(token) for token in self.bytes], np.int64)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings that look like control tokens are ordinary text."""
        parts, at = [], 0
        for run in _long.finditer(text):
            # the last character of a run belongs to what follows
            end = run.end() if run.end() == len(text) else run.end() - 1
            parts += self.encoding.encode_ordinary(text[at : run.start()])
            parts += self.encoding._encode_single_piece(text[run.start() : end])
            at = end
        parts += self.encoding.encode_ordinary(text[at:])
        return np.array(parts, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def ranks(content: bytes, pattern: str) -> Ranks:
    return Ranks(content, pattern)


def read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()
