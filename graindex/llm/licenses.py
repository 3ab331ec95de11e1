"""License scans: documents that hold a license notice, or nearly.

For a template of n word shingles a document is cut into blocks of n / 2 shingles (up to an eighth more, so that
templates of nearly the same length share them); every three neighbouring blocks are a window, so windows overlap by
two thirds and any run of n shingles lies whole inside one. A window gets a MinHash signature from the least hashes of
its blocks, and templates that share a band of it are retrieved. A window that holds ``THRESHOLD`` of a template's
shingles has a Jaccard similarity of 0.42 or more with it, and with 32 bands of 2 values shares a band with
probability 0.998; where the notice is spread over 1.5 lengths by words inserted, it is 0.33 at the worst place and
0.975.

Retrieved templates are verified by exact containment, the share of the template's distinct shingles that a run of the
text holds, which must be ``THRESHOLD`` or more. Runs of 1, 1.25 and 1.5 lengths are tried at every place around the
window; a document shorter than a run is one run as a whole. Of runs of equal containment the shortest, then the
first, is given. Nested templates (a grant and the whole license it stands in) are found each by itself.

Shingles have five words, or as many as the template has, if fewer. Templates are a parameter (a table of template_id
and text), taken in blocks of bounded size that are broadcast, as in decontaminate.py. Case and punctuation don't
count. A null or empty document matches nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .decontaminate import scans
from .license_texts import TEMPLATES
from .textkernel import Runs, Words, spread

THRESHOLD, BANDS, ROWS, SHINGLE = 0.8, 32, 2, 5
#: Lengths of the runs that are tried, in lengths of the template.
LENGTHS = (1, 1.25, 1.5)
#: Bits of the first, cheap look at a band key.
_SIEVE = 16
_SEEDS = np.random.default_rng(31).integers(0, 1 << 32, (BANDS * ROWS, 2), dtype=np.uint32)


def hash_values(h: np.ndarray) -> np.ndarray:
    """The values of all hash functions: functions x shingles."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    return (low[None, :] ^ _SEEDS[:, :1]) * (_SEEDS[:, 1:] | np.uint32(1))


def keys_of(least: np.ndarray) -> np.ndarray:
    """32-bit band keys of the signatures in the columns of ``least``; what they let through by chance is verified anyway."""
    key = least[0::2] * np.uint32(0x9E3779B1)
    key ^= least[1::2] + np.arange(BANDS, dtype=np.uint32)[:, None] * np.uint32(0x85EBCA77)
    key *= np.uint32(0xC2B2AE3D)
    return key


def text_shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all runs of k words inside texts, the first word of each, and how many each text has."""
    many = np.maximum(words.counts() - k + 1, 0)
    first, _ = spread(words.bounds[:-1], many)
    return Runs(words.hash).hash(first, first + k, 0x5A17), first, many


class Templates:
    """Ids and distinct shingles of the templates that have a word."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        words = Words([t or "" for t in texts])
        self.k = np.minimum(words.counts(), SHINGLE)
        self.shingles, self.size = [], np.zeros(len(ids), np.int64)
        for i, k in enumerate(self.k.tolist()):
            h = text_shingles(Words([texts[i]]), k)[0] if k else np.zeros(0, np.uint64)
            self.size[i] = len(h)
            self.shingles.append(np.unique(h))


class Index:
    """A block of templates: for each (shingle length, block length) their band keys."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float = THRESHOLD):
        self.threshold, self.items = threshold, Templates(ids, texts)
        self.by_block: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        half = -(-self.items.size // 2)
        # block lengths that differ by an eighth or less are made one, the longer
        longest = int(half.max(initial=0))
        for i in np.argsort(-half, kind="stable").tolist():
            longest = longest if half[i] * 9 >= longest * 8 else int(half[i])
            half[i] = longest
        for k, b in sorted(set(zip(self.items.k.tolist(), half.tolist(), strict=True)) - {(0, 0)}):
            mine = np.flatnonzero((self.items.k == k) & (half == b))
            keys = np.concatenate([keys_of(hash_values(self.items.shingles[i]).min(1, keepdims=True)).ravel() for i in mine])
            order = np.argsort(keys, kind="stable")
            sieve = np.zeros(1 << _SIEVE, bool)
            sieve[keys >> np.uint32(32 - _SIEVE)] = True
            self.by_block[k, b] = keys[order], np.repeat(mine, BANDS)[order], sieve

    def candidates(self, values: np.ndarray, many: np.ndarray, k: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that share a band with a template: text, first shingle in the text, template."""
        blocks = -(-many // b)
        block, text = spread(np.zeros(len(many), np.int64), blocks)
        starts = (np.cumsum(many) - many)[text] + block * b
        least = np.minimum.reduceat(values, starts, axis=1) if b > 1 else values
        window = least.copy()
        for step in (1, 2):  # the two blocks after, as far as the text goes
            beyond = np.where(text[step:] == text[:-step], np.uint32(0), np.uint32(0xFFFFFFFF))
            np.minimum(window[:, :-step], least[:, step:] | beyond, out=window[:, :-step])
        keys, listed, sieve = self.by_block[k, b]
        key = keys_of(window)
        band, at = np.nonzero(sieve[key >> np.uint32(32 - _SIEVE)])
        lo = np.searchsorted(keys, key[band, at])
        entry, row = spread(lo, np.searchsorted(keys, key[band, at], side="right") - lo)
        pair = np.unique(np.stack([at[row], listed[entry]], 1), axis=0)
        return text[pair[:, 0]], block[pair[:, 0]] * b, pair[:, 1]

    def matches(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Best run of each text and template: text, template, containment, first and last character (exclusive)."""
        words, found = Words(texts), []
        shingles = {k: text_shingles(words, k) for k in sorted({k for k, _ in self.by_block})}
        values = {k: hash_values(h) for k, (h, _, _) in shingles.items()}
        for k, b in self.by_block:
            h, first, many = shingles[k]
            if not len(h):
                continue
            base = np.cumsum(many) - many
            for t, at, i in zip(*(x.tolist() for x in self.candidates(values[k], many, k, b)), strict=True):
                n = int(self.items.size[i])
                lo, hi = int(base[t]) + max(0, at - n), int(base[t] + min(many[t], at + 3 * b + n))
                best = best_run(h[lo:hi], self.items.shingles[i], n)
                if best[0] >= self.threshold:
                    share, size, p = best
                    found.append((t, i, share, size, words.begin[first[lo + p]], words.end[first[lo + p + size - 1] + k - 1]))
        if not found:
            return (np.zeros(0, np.int64),) * 5
        text, item, share, size, begin, end = (np.array(x) for x in zip(*found, strict=True))
        order = np.lexsort((begin, size, -share, item, text))
        text, item, share, begin, end = (x[order] for x in (text, item, share, begin, end))
        best = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]))
        base = words.starts[text[best]]
        return text[best], item[best], share[best], begin[best] - base, end[best] - base


def best_run(h: np.ndarray, shingles: np.ndarray, n: int) -> tuple[float, int, int]:
    """Containment, size and place of the run of ``h`` that holds most of the distinct ``shingles`` of a template of n."""
    at = np.minimum(np.searchsorted(shingles, h), len(shingles) - 1)
    held = np.flatnonzero(shingles[at] == h)
    # the place before where the same shingle stood last: a run counts it if that is before the run
    order = np.lexsort((held, at[held]))
    last = np.full(len(held), -1)
    again = at[held][order][1:] == at[held][order][:-1]
    last[order[1:][again]] = held[order[:-1][again]]
    best = (0.0, 0, 0)
    for size in sorted({min(len(h), int(n * x)) for x in LENGTHS}):
        # where a run begins: a count of those places between the last one of a shingle and the shingle itself
        change = np.zeros(len(h) + 1, np.int64)
        np.add.at(change, np.maximum(last + 1, held - size + 1).clip(0), 1)
        np.add.at(change, held + 1, -1)
        count = np.cumsum(change)[: len(h) - size + 1]
        p = int(count.argmax())
        if count[p] / len(shingles) > best[0]:
            best = (float(count[p] / len(shingles)), size, p)
    return best


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template_id string, text string")


def scan_licenses(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and template in it: doc_id, template_id, containment, char_start, char_end."""
    return scans(docs, templates, "template_id", "containment", lambda ids, texts: Index(ids, texts, threshold)).drop("text_key")
