"""Windows of a text that could match a short item, found by the word shingles they share with it.

An item has n shingles of k words (k is five, or the item's length if that is less), and is compared with windows of
n shingles. A text of fewer shingles than a window is one window as a whole. A window that reaches the similarity
asked for shares so many shingles with the item that a count of the window's shingles known to any item already rules
the others out; so the windows given here are all that can match, and no match is lost by leaving out the others.
"""

from __future__ import annotations

import numpy as np

from .textkernel import Runs, Words

#: Bits of the first, cheap look at a shingle.
_SIEVE = 20


class Items:
    """The items of one block: ids and texts; those without words are left out.

    ``share`` is the share of the mean number of shingles of item and window that both must hold.
    """

    def __init__(self, ids: list, texts: list[str | None], share: float, k: int = 5):
        self.ids = ids
        words = Words([t or "" for t in texts])
        counts = words.counts()
        self.k = np.minimum(counts, k)
        self.size = np.where(counts > 0, counts - self.k + 1, 0)
        self.share = share
        self.hashes = [grams(words, int(self.k[i]), i) if self.size[i] else np.zeros(0, np.uint64) for i in range(len(ids))]
        self.vocabulary, self.sieve, self.sizes = {}, {}, {}
        for w in np.unique(self.k[self.size > 0]).tolist():
            mine = np.flatnonzero((self.k == w) & (self.size > 0))
            self.vocabulary[w] = np.unique(np.concatenate([self.hashes[i] for i in mine]))
            self.sieve[w] = np.zeros(1 << _SIEVE, bool)
            self.sieve[w][self.vocabulary[w] >> np.uint64(64 - _SIEVE)] = True
            self.sizes[w] = np.unique(self.size[mine]).tolist()

    def windows(self, words: Words):
        """For each k: the shingle hashes of the texts, and of the windows that count the starts, sizes and items' sizes (in shingles)."""
        for k, sizes in self.sizes.items():
            if len(words.hash) < k:
                continue
            first = np.arange(len(words.hash) - k + 1)
            h = Runs(words.hash).hash(first, first + k, 0x5A17)
            hit = np.flatnonzero(self.sieve[k][h >> np.uint64(64 - _SIEVE)])
            hit = hit[words.text[hit] == words.text[hit + k - 1]]
            at = np.minimum(np.searchsorted(self.vocabulary[k], h[hit]), len(self.vocabulary[k]) - 1)
            hit = hit[self.vocabulary[k][at] == h[hit]]
            if not len(hit):
                continue
            before = np.zeros(len(h) + 1, np.int32)
            before[hit + 1] = 1
            np.cumsum(before, out=before)
            whole = np.maximum(words.counts() - k + 1, 0)
            lead_in = np.minimum(words.bounds[:-1], len(h))
            held = np.where(whole > 0, before[lead_in + whole] - before[lead_in], 0)
            found = []
            for n in sizes:
                # texts shorter than this window
                short = np.flatnonzero((whole < n) & (held >= self.need(whole, n)))
                found.append((lead_in[short], whole[short], np.full(len(short), n)))
                need = int(self.need(n, n))
                # the first known shingle of such a window is among its first n - need + 1
                lead = hit[: max(0, len(hit) - need + 1)]
                lead = lead[hit[need - 1 :][: len(lead)] - lead < n]
                p = np.unique(lead[:, None] - np.arange(n - need + 1)[None, :])
                p = p[(p >= 0) & (p + n + k - 1 <= len(words.hash))]
                p = p[before[p + n] - before[p] >= need]
                p = p[words.text[p] == words.text[p + n + k - 2]]
                found.append((p, np.full(len(p), n), np.full(len(p), n)))
            starts, size, of = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(starts):
                yield k, h, starts, size, of

    def need(self, size, n: int):
        """The known shingles that a window of ``size`` shingles must hold to match an item of n."""
        return np.maximum(1, np.ceil(self.share * (size + n) / 2 - 1e-9))


def grams(words: Words, k: int, text: int) -> np.ndarray:
    """The hashes of all runs of k words of one text."""
    first = np.arange(words.bounds[text], words.bounds[text + 1] - k + 1)
    return Runs(words.hash).hash(first, first + k, 0x5A17)
