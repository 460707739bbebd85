"""A vocabulary's merges as a deterministic automaton over tokens.

The automaton reads sequences of tokens and accepts exactly those that byte-pair encoding
gives. It starts as one state that loops on every base symbol. The gadget of a merge
``x y -> z`` gives the arcs labelled ``x`` a target of their own, a copy of the old one
without the arc ``y``, and lays an arc ``z`` beside every arc ``x``, to where ``y`` went.
All arcs with one label have one target, so a state is the set of tokens that may follow.

Copies share what they have in common: a state is stored as its parent, the label that it
lacks and the merge that made it, and an arc's existence is looked up along the parents. An
arc that has been asked for stays in the transition table.

The construction is right for vocabularies whose merges are made of earlier ones, each
token by one merge, as training gives them; others are refused.
"""

from __future__ import annotations

from __future__ import annotations

DEAD = -1


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    standing = {byte: chr(byte) for byte in kept}
    for byte in range(0x100):
        standing.setdefault(byte, chr(0x100 + len(standing) - len(kept)))
    return [standing[byte] for byte in range(0x100)]


# Transitions that are kept once found; any can be found again.
MOST_TRANSITIONS = 1 << 18


class Automaton:
    """Transitions over the tokens ``0 .. n - 1`` of ``merges`` (rows ``x, y, z``) and base symbols."""

    def __init__(self, tokens: int, merges: list[tuple[int, int, int]]):
        self.made = [-1] * tokens  # the merge that makes a token; -1 for a base symbol
        self.left = [DEAD] * tokens
        self.target = [0] * tokens
        self.parent, self.lacks, self.born = [0], [DEAD], [-1]
        parts: set[int] = set()
        for k, (x, y, z) in enumerate(merges):
            parts |= {x, y}
            if self.made[z] >= 0 or z in parts:
                raise ValueError(f"merge {k} is not made of earlier tokens into a new one")
            self.made[z] = k
            # a merge whose parts never meet, as 0 and 00 after 0 0 -> 00, makes no arc
            if self._has(self.target[x], y):
                self._gadget(k, x, y, z)
        self.tokens = tokens
        self.table: dict[int, int] = {}

    def _gadget(self, k: int, x: int, y: int, z: int) -> None:
        self.parent.append(self.target[x])
        self.lacks.append(y)
        self.born.append(k)
        self.target[z] = self.target[y]
        self.target[x] = len(self.parent) - 1
        self.left[z] = x

    def step(self, state: int, token: int) -> int:
        """The state that ``token`` leads to, or ``DEAD``."""
        key = state * self.tokens + token
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= MOST_TRANSITIONS:
                self.table.clear()  # texts of noise could fill it without end
            found = self.table[key] = self.target[token] if self._has(state, token) else DEAD
        return found

    def _has(self, state: int, token: int) -> bool:
        while True:
            made = self.made[token]
            while self.born[state] > made:
                if self.lacks[state] == token:
                    return False
                state = self.parent[state]
            if made < 0:
                return True
            token = self.left[token]  # the arc was laid beside one of its first part
            if token == DEAD:
                return False
