"""Deterministic transducers for merge vocabularies, compiled while they run.

In a merge encoding every prefix of a word has one last token, and two tokens can
stand side by side only if merging their joined symbols gives the two back. So the
encoding of a word is the single path of finite weight through the lattice of
vocabulary tokens, where a token arc weighs one and an arc after a token that it
cannot follow weighs infinity. Reading a word from the left, all that later symbols
need is the longest suffix that can still grow into a token, and the last token and
relative weight at each place inside it: a finite state. States and transitions are
made when first met and kept; a transition carries the change of the token count and
the token that now ends.
"""

from __future__ import annotations

from collections.abc import Callable


def merge(symbols: list[str], rank: Callable[[tuple], object]) -> list[str]:
    """Join the pair of the smallest rank, leftmost first, until no pair has one."""
    out = list(symbols)
    ranks = [rank(p) for p in zip(out, out[1:])]
    while True:
        best, at = None, -1
        for i, r in enumerate(ranks):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if at < 0:
            return out
        out[at : at + 2] = [out[at] + out[at + 1]]
        del ranks[at]
        if at:
            ranks[at - 1] = rank((out[at - 1], out[at]))
        if at < len(ranks):
            ranks[at] = rank((out[at], out[at + 1]))


class MergeTransducer:
    """Counts and paths of merge encodings. ``rank((a, b))`` is a pair's priority or None.

    A state is the dict of its transitions by symbol; under None it holds its key: the
    suffix, then the last token and then the relative weight at each place of it.
    """

    def __init__(self, tokens, rank: Callable[[tuple], object], most_states: int = 250_000, most_pairs: int = 250_000):
        self.tokens = set(tokens)
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t) + 1)}
        self.rank, self.most_states, self.most_pairs = rank, most_states, most_pairs
        self._fits: dict[tuple, bool] = {}
        self._reset()

    def _reset(self) -> None:
        """Forget compiled states; memory stays bounded and results are the same."""
        self.start = {None: ("", None, 0)}
        self.states = {self.start[None]: self.start}
        self.unkept = 0

    def fits(self, left: str | None, token: str) -> bool:
        """Whether ``token`` can follow ``left``, or begin a word if ``left`` is None."""
        key = (left, token)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= self.most_pairs:
                self._fits.clear()
            want = [token] if left is None else [left, token]
            known = self._fits[key] = merge(list("".join(want)), self.rank) == want
        return known

    def step(self, state: dict, symbol: str) -> tuple:
        """Compile the transition: (next state, change of the count, token that ends here)."""
        key = state[None]
        grown = key[0] + symbol
        size, chosen = len(grown), None
        suffixes = [grown[k:] for k in range(size)]
        for k, token in enumerate(suffixes):  # longest token first
            if token in self.tokens or k == size - 1:
                weight = key[1 + size + k] + 1
                if (chosen is None or weight < chosen[1]) and self.fits(key[1 + k], token):
                    chosen = (token, weight)
        if chosen is None:
            raise ValueError(f"no encoding ends at {grown!r}")
        token, weight = chosen
        # places from which no token can grow any more are blanked, so that states coincide
        prefixes, ends, weights, first = self.prefixes, [], [], size
        for k, suffix in enumerate(suffixes):
            if suffix in prefixes:
                if first == size:
                    first = k
                ends.append(key[1 + k])
                weights.append(key[1 + size + k] - weight)
            elif first < size:
                ends.append(None)
                weights.append(0)
        key = (grown[first:], *ends, token, *weights, 0)
        nxt = self.states.get(key)
        if nxt is None:
            nxt = {None: key}
            if len(self.states) >= self.most_states:
                # the states met first are the common ones and stay; others are made anew each
                # time, until they have been as many and the table starts over
                self.unkept += 1
                if self.unkept > self.most_states:
                    self._reset()
                return nxt, weight, token
            self.states[key] = nxt
        move = state[symbol] = (nxt, weight, token)
        return move

    def count(self, word: str) -> int:
        """Number of tokens of a word."""
        state, n = self.start, 0
        for c in word:
            move = state.get(c) or self.step(state, c)
            state = move[0]
            n += move[1]
        return n

    def path(self, word: str) -> list[str]:
        """The tokens of a word, read back from its end."""
        state, ends = self.start, []
        for c in word:
            move = state.get(c) or self.step(state, c)
            state = move[0]
            ends.append(move[2])
        out, at = [], len(word)
        while at:
            token = ends[at - 1]
            out.append(token)
            at -= len(token)
        return out[::-1]


class Memo(dict):
    """Results by word, made by ``make`` when missing.

    ``trim`` bounds it between texts or batches: a full table becomes the old generation,
    from which words in use come back.
    """

    def __init__(self, make: Callable[[str], object], most: int = 200_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str):
        known = self.old.get(word)
        made = self[word] = self.make(word) if known is None else known
        return made

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = {}  # freed before the copy is made
            self.old = dict(self)
            self.clear()
