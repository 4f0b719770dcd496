"""All pieces of a vocabulary in many texts at once, and the best paths through them.

Pieces are looked up in a double-array trie over code points: every place of a block of texts walks it in
step, so a look-up is two array reads and no Python code runs per character. Best paths step through the
places of all texts of a block together: what ends at a place is one row of the piece numbers that end there,
the farthest start first, so that of equal scores the smallest start wins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

#: Piece numbers that a block may hold, and texts of a block that go one by one, as the last to be walked.
CELLS, ALONE = 2_000_000, 8


class Trie:
    """Children of a node stand at base[node] + letter, where check names the node."""

    def __init__(self, vocab: list[str]):
        self.vocab = vocab
        self.longest = max([len(t) for t in vocab], default=1)
        letters = sorted({ord(c) for t in vocab for c in t})
        self.letter = np.zeros((letters[-1] if letters else 0) + 2, np.int32)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        width = len(letters) + 1
        root: dict = {}
        for k, t in enumerate(vocab):
            node = root
            for c in t:
                node = node.setdefault(int(self.letter[ord(c)]), {})
            node.setdefault(-1, k)  # of equal pieces the first
        free, end, size = 1, 1, 4 * width + 1024
        base, check, piece = ([fill] * size for fill in (0, -1, -1))
        check[0] = -2
        queue = [(0, root)]
        for slot, node in queue:
            if -1 in node:
                piece[slot] = node[-1]
            kids = sorted(c for c in node if c >= 0)
            if not kids:
                continue
            while check[free] != -1:
                free += 1
            at, tries = max(1, free - kids[0]), 0
            while True:
                if tries == 50:  # no room among the others: behind them
                    at = end
                if at + width + 1 >= size:
                    size *= 2
                    for x, fill in ((base, 0), (check, -1), (piece, -1)):
                        x.extend([fill] * (size - len(x)))
                if all(check[at + c] == -1 for c in kids):
                    break
                at += 1
                tries += 1
            base[slot], end = at, max(end, at + kids[-1] + 1)
            for c in kids:
                check[at + c] = slot
                queue.append((at + c, node[c]))
        used = max(k for k, x in enumerate(check) if x != -1) + width + 1
        pad = lambda x, fill: np.array(x[:used] + [fill] * max(0, used - len(x)), np.int32)
        self.base, self.check, self.piece = pad(base, 0), pad(check, -1), pad(piece, -1)

    def letters(self, text: str) -> np.ndarray:
        """The letter of each code point, 0 where no piece has it."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.letter[np.minimum(points, len(self.letter) - 1)]

    def walks(self, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, piece numbers) of every piece at every place; letter 0 ends a walk."""
        at, node = np.arange(len(letters)), np.zeros(len(letters), np.int32)
        for length in range(1, self.longest + 1):
            inside = at + length <= len(letters)
            at, node = at[inside], node[inside]
            step = letters[at + (length - 1)]
            slot = self.base[node] + step
            ok = (step > 0) & (self.check[slot] == node)
            at, node = at[ok], slot[ok]
            if not len(at):
                return
            found = self.piece[node]
            some = found >= 0
            yield length, at[some], found[some]


class Lattice:
    """Texts of a block, the longest first, with the pieces that end at each of their places."""

    def __init__(self, sizes: np.ndarray, longest: int, pieces: int):
        self.size, self.width, self.none = sizes, longest, pieces
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)  # place 0 of each text
        self.cells = np.full((int((sizes + 1).sum()), longest), pieces, np.int32)

    @staticmethod
    def of(texts: list[str], trie: Trie) -> Lattice:
        """Of texts that come with the longest first."""
        out = Lattice(np.array([len(t) for t in texts], np.int64), trie.longest, len(trie.vocab))
        letters = trie.letters("\0".join([*texts, ""]))
        letters[out.first + out.size] = 0
        for length, start, found in trie.walks(letters):
            out.cells[start + length, out.width - length] = found
        return out

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of all pieces, by place."""
        place, column = np.nonzero(self.cells != self.none)
        return place, self.width - column, self.cells[place, column]

    def paths(self, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best score at each place and how far back its last piece begins. cost: of each piece, then -inf."""
        room, back = np.full(len(self.cells) + self.width, -np.inf), np.zeros(len(self.cells), np.int64)
        best = room[self.width :]
        before = np.lib.stride_tricks.sliding_window_view(room, self.width)  # of each place the scores before it
        best[self.first] = 0.0
        for end in range(1, int(self.size[0]) + 1 if len(self.size) else 0):
            at = self.first[: np.searchsorted(-self.size, -end, "right")] + end
            score = before[at] + cost[self.cells[at]]
            pick = score.argmax(1)
            best[at], back[at] = score[np.arange(len(at)), pick], self.width - pick
        return best, back

    def tokens(self, best: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, piece) along the best paths, in order, and which texts have none: their end isn't reached."""
        ends = self.first + self.size
        lost = np.isneginf(best[ends])
        text, at = np.flatnonzero(~lost & (self.size > 0)), ends[~lost & (self.size > 0)]
        texts, pieces = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(text):
            step = back[at]
            texts.append(text)
            pieces.append(self.cells[at, self.width - step].astype(np.int64))
            at = at - step
            on = at > self.first[text]
            text, at = text[on], at[on]
        owner, found = np.concatenate(texts[::-1]), np.concatenate(pieces[::-1])
        order = np.argsort(owner, kind="stable")
        return owner[order], found[order], lost


def blocks(sizes: list[int], longest: int) -> Iterator[tuple[list[int], bool]]:
    """Numbers of texts that go together, the longest first, and whether they go one by one instead: those
    that fill a block alone, and the few longest, which would be the last in step."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    room = max(1, CELLS // max(1, longest))
    alone = [k for n, k in enumerate(order) if sizes[k] >= room or (n < ALONE and sizes[k] > 4 * sizes[order[min(ALONE, len(order) - 1)]])]
    if alone:
        yield alone, True
    held, used = [], 0
    for k in order[len(alone) :]:
        if held and used + sizes[k] + 1 > room:
            yield held, False
            held, used = [], 0
        held.append(k)
        used += sizes[k] + 1
    if held:
        yield held, False


def best_pieces(texts: list[str], trie: Trie, cost: np.ndarray, one: Callable[[str], tuple[list[str], float]], spelled: Callable[[str], tuple[list[str], float]] | None = None) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, dict[int, tuple[list[str], float]]]:
    """(texts in the order worked on, owner, piece, score of each) and the texts that `one` did: those that go
    one by one, and those whose end no pieces reach, which `spelled` does if given. owner counts in the order
    worked on."""
    done, owners, pieces, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    apart: dict[int, tuple[list[str], float]] = {}
    for rows, alone in blocks([len(t) for t in texts], trie.longest):
        if alone:
            apart |= {k: one(texts[k]) for k in rows}
            continue
        lattice = Lattice.of([texts[k] for k in rows], trie)
        best, back = lattice.paths(cost)
        owner, piece, lost = lattice.tokens(best, back)
        apart |= {rows[k]: (spelled or one)(texts[rows[k]]) for k in np.flatnonzero(lost).tolist()}
        owners.append(owner + len(done))
        pieces.append(piece)
        scores.append(best[lattice.first + lattice.size])
        done += rows
    return done, np.concatenate(owners), np.concatenate(pieces), np.concatenate(scores), apart


def costs(log_probs: list[float]) -> np.ndarray:
    return np.array([*log_probs, -math.inf])
