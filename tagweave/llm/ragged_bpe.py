"""Byte-pair merging over ragged numpy arrays: each sequence merges its pairs of lowest rank at the same time.

A batch of pre-tokens is one flat array of symbols and one of sequence numbers. A round looks up the rank of every
adjacent pair, takes each sequence's lowest, merges its occurrences from the left (overlapping ones alternate), and
drops the sequences that have no pair left. The rounds a batch needs are the merges of its deepest pre-token.
"""

from __future__ import annotations

import numpy as np

NONE = np.int64(1) << 60


class PieceModel:
    """The merge table of a sentencepiece BPE model: any two adjacent symbols whose text is a piece may merge."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not special(i)}
        self.size = sp.get_piece_size()
        order = {i: k for k, i in enumerate(sorted(pieces.values(), key=lambda i: (-sp.get_score(i), i)))}
        self.symbol = np.full(0x110000, -1, np.int32)
        pairs, adjacent = {}, set()
        for text, i in pieces.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
            adjacent.update(ord(a) << 21 | ord(b) for a, b in zip(text, text[1:], strict=False))
            for cut in range(1, len(text)):
                left, right = pieces.get(text[:cut]), pieces.get(text[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.ranks = np.array([order[i] for i in self.merged.tolist()], np.int64)
        # merging all occurrences at once is exact where no pair that holds the new piece has a lower rank than it
        least = np.full(self.size, NONE)
        np.minimum.at(least, self.keys // self.size, self.ranks)
        np.minimum.at(least, self.keys % self.size, self.ranks)
        self.at_once = least[self.merged] > self.ranks
        self.adjacent = np.array(sorted(adjacent), np.int64)


def _held(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand in sorted_keys, and whether they do."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _ranks(left: np.ndarray, right: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each pair (NONE: they don't merge) and its place in the merge table."""
    at, hit = _held(model.keys, left.astype(np.int64) * model.size + right)
    return np.where(hit & (left >= 0) & (right >= 0), model.ranks[at], NONE), at


def _chosen(at: np.ndarray, overlaps: np.ndarray, first: np.ndarray, model: PieceModel) -> np.ndarray:
    """Which of the lowest pairs merge now: every second of those that overlap, or only the first of a sequence."""
    fresh = np.r_[True, ~overlaps]
    run = np.cumsum(fresh) - 1
    every = (np.arange(len(at)) - np.flatnonzero(fresh)[run]) % 2 == 0
    return np.where(model.at_once[at], every, first)


def _long_sequence(symbols: np.ndarray, model: PieceModel) -> np.ndarray:
    """The same rounds for one long sequence: ranks are kept, and only those beside a merge are looked up again."""
    symbols = symbols.copy()
    while True:
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, at = np.full(n, NONE), np.zeros(n, np.int64)
        rank[:-1], at[:-1] = _ranks(symbols[:-1], symbols[1:], model)
        alive, left = np.ones(n, bool), n
        while left > n // 2 and n > 1:
            least = rank.min()
            if least == NONE:
                return symbols[alive]
            pos = np.flatnonzero(rank == least)
            first = np.zeros(len(pos), bool)
            first[0] = True
            pos = pos[_chosen(at[pos], after[pos[:-1]] == pos[1:], first, model)]
            gone = after[pos]
            symbols[pos] = model.merged[at[pos]]
            rank[gone] = NONE
            alive[gone] = False
            left -= len(pos)
            then = after[gone]
            after[pos] = then
            inside = then < n
            before[then[inside]] = pos[inside]
            touched = np.r_[pos, before[pos][before[pos] >= 0]]
            ends = after[touched] >= n
            rank[touched[ends]] = NONE
            touched = touched[~ends]
            rank[touched], at[touched] = _ranks(symbols[touched], symbols[after[touched]], model)
        symbols = symbols[alive]
        if n <= 1:
            return symbols


#: Sequences beyond so many symbols are merged one by one.
LONG = 512


def surviving(symbols: np.ndarray, owner: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that remain after all merges, with the numbers of the sequences that own them (in any order)."""
    done_s, done_o = [], []
    if len(symbols) > LONG:
        begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        length = np.diff(np.r_[begin, len(symbols)])
        for k in np.flatnonzero(length > LONG):
            left = _long_sequence(symbols[begin[k] : begin[k] + length[k]], model)
            done_s.append(left)
            done_o.append(np.full(len(left), owner[begin[k]]))
        short = np.repeat(length <= LONG, length)
        symbols, owner = symbols[short], owner[short]
    while len(symbols):
        begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        rank = np.full(len(symbols), NONE)
        at = np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], at[:-1] = _ranks(symbols[:-1], symbols[1:], model)
            rank[:-1][owner[1:] != owner[:-1]] = NONE
        lowest = np.minimum.reduceat(rank, begin)
        length = np.diff(np.r_[begin, len(symbols)])
        ended = np.repeat(lowest == NONE, length)
        done_s.append(symbols[ended])
        done_o.append(owner[ended])
        chosen = np.flatnonzero((rank == np.repeat(lowest, length)) & (rank < NONE))
        if len(chosen):
            first = np.r_[True, owner[chosen][1:] != owner[chosen][:-1]]
            chosen = chosen[_chosen(at[chosen], np.diff(chosen) == 1, first, model)]
        symbols = symbols.copy()
        symbols[chosen] = model.merged[at[chosen]]
        keep = ~ended
        keep[chosen + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return (np.concatenate(done_s), np.concatenate(done_o)) if done_s else (symbols, owner)


def count_tokens(words: list[str], model: PieceModel) -> np.ndarray:
    """Tokens of each pre-token: surviving symbols, and a token for every byte of characters that are in no piece."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    word = np.repeat(np.arange(len(words)), lengths)
    if not len(chars):
        return np.zeros(len(words), np.int64)
    # a cut between two characters that stand side by side in no piece changes nothing and keeps sequences short
    new = np.r_[True, word[1:] != word[:-1]]
    new[1:] |= ~_held(model.adjacent, chars[:-1].astype(np.int64) << 21 | chars[1:])[1]
    sequence = np.cumsum(new) - 1
    symbols = model.symbol[chars]
    known = symbols >= 0
    size = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
    total = np.bincount(word[~known], weights=size[~known], minlength=len(words)).astype(np.int64)
    left, owner = surviving(symbols[known], sequence[known], model)
    of = word[new]  # the word of each sequence
    return total + np.bincount(of[owner], minlength=len(words)).astype(np.int64)
