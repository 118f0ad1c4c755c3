"""Relative Lempel-Ziv parsing inside one reference block.

A block holds texts of records end to end, indexed by the sorted starts of their suffixes. Every text is factored
greedily from left to right, each factor the longest match that another record of the block has at its place. A span
of `length` code points that two records share may end in the middle of factors, or lie inside longer ones, so the
matches at every factor boundary, and at every half length inside a factor, are extended to both sides as far as the
stored characters agree: between two such places there is less than half a length, so every shared span holds one of
them with half a length behind it, and each of its partners is met there.

Defined results: matches never run over the ends of a text; texts of one record are not matched with each other;
empty texts have no factors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points that suffixes are sorted by, at least; equal ones beyond stand in any order.
DEPTH = 56


def suffix_order(codes: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Starts of the suffixes in the order of their first `depth` code points or more, by doubling."""
    n = len(codes)
    seen = np.zeros(int(codes.max()) + 1, bool)
    seen[codes] = True
    letter = np.cumsum(seen)[codes].astype(np.int64)  # from 1 on; 0 stands behind the end
    bits = int(letter.max()).bit_length()
    done = max(1, 63 // bits)
    value = np.zeros(n, np.int64)
    for i in range(done):
        value <<= bits
        value[: max(0, n - i)] |= letter[i:]
    while True:
        order = np.argsort(value)
        value = value[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(value[1:] != value[:-1])]) + 1
        if done >= depth or rank[order[-1]] == n:
            return order
        value = rank * (n + 2)
        value[: max(0, n - done)] += rank[done:]
        done *= 2


class Block:
    """records: key of the record and text; a record may have several texts."""

    def __init__(self, records: list[tuple[int, str]]) -> None:
        texts = [t for _, t in records]
        self.text = "".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        self.key = [k for k, _ in records]
        self.starts, self.ends = (ends - sizes).tolist(), ends.tolist()
        self.of = np.repeat(np.arange(len(records)), sizes).tolist()
        if self.text:
            order = suffix_order(np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self.order, self.place = order.tolist(), place.tolist()

    def ahead(self, p: int, q: int) -> int:
        """How far the texts agree from p and from q on."""
        t, low = self.text, 0
        high = min(self.ends[self.of[p]] - p, self.ends[self.of[q]] - q)
        if t[p : p + high] == t[q : q + high]:
            return high
        while high - low > 1:  # they agree up to low, and differ before high
            mid = (low + high) // 2
            if t[p + low : p + mid] == t[q + low : q + mid]:
                low = mid
            else:
                high = mid
        return low

    def back(self, p: int, q: int) -> int:
        """How far the texts agree before p and before q."""
        t, n = self.text, 0
        most = min(p - self.starts[self.of[p]], q - self.starts[self.of[q]])
        while n < most and t[p - n - 1] == t[q - n - 1]:
            n += 1
        return n

    def matches(self, p: int, least: int) -> Iterator[tuple[int, int]]:
        """(length, place) of every match of `least` (at most DEPTH) code points and more that other records have for the text from p on."""
        own = self.key[self.of[p]]
        at, last = self.place[p], len(self.order)
        for step in (-1, 1):
            i = at + step
            while 0 <= i < last:
                q = self.order[i]
                n = self.ahead(p, q)
                # a text's end stands before any longer one, also where other texts go on behind it
                if n < least and n < self.ends[self.of[q]] - q:
                    break
                if n >= least and self.key[self.of[q]] != own:
                    yield n, q
                i += step

    def longest(self, p: int) -> int:
        """Length of the longest match of the text from p on in another record, as far as the order tells it."""
        own, best = self.key[self.of[p]], 0
        at, last = self.place[p], len(self.order)
        for step in (-1, 1):
            i = at + step
            while 0 <= i < last:
                q = self.order[i]
                n = self.ahead(p, q)
                if self.key[self.of[q]] != own:
                    best = max(best, n)
                    if n < DEPTH and n < self.ends[self.of[q]] - q:
                        break
                elif n <= best and n < self.ends[self.of[q]] - q:
                    break
                i += step
        return best

    def factors(self, i: int) -> Iterator[tuple[int, int]]:
        """(start, length) of the greedy factors of a text; length 0: a code point that no other record has."""
        p, end = self.starts[i], self.ends[i]
        while p < end:
            n = self.longest(p)
            yield p, n
            p += max(1, n)

    def shared(self, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(text, other text, start, end): spans of `length` and more that a text shares with one of another record."""
        half = min(length // 2, DEPTH)
        for i in range(len(self.key)):
            for p, n in self.factors(i):
                for probe in range(p, p + n, half):
                    if p + n - probe < half and n < half:
                        continue  # nothing that long starts here
                    for m, q in self.matches(probe, half):
                        before = self.back(probe, q)
                        if m + before >= length:
                            yield i, self.of[q], probe - before - self.starts[i], probe + m - self.starts[i]
