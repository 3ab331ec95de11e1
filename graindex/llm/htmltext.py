"""The main text of web pages by a maximum-scoring subsequence of their words and tags.

A page is read once into a row of tokens: words and tags, each with the elements around it. Words score positive and tags
negative, by weights learnt from labelled pages, and one linear scan (best sum so far, or start anew) finds the contiguous
region of the greatest sum. Parts that interrupt an article (adverts, forms, sidebars, comments) are elements whose tag or
names are learnt to hold no article; their words score nothing, and the text of the region leaves them out. A block that
the region touches is taken whole, and so are other blocks of the container around the region (unless that is the whole page) whose words are likelier content than not:
a short heading or last line costs more in tags than its words are worth.

Weights come from two kinds of labelled pages. Of a bounded sample of the table, pages that mark up exactly one article
count, in one distributed pass: what lies in the article is content, the rest isn't. The other kind is made up (``page_labels``), for layouts that
the table has no marked example of. Features are hashed into ``FEATURES`` places, so the driver gets as many counts
whatever the pages hold.

Character references are decoded, white space (as ``str.split`` knows it) inside a block becomes one space, blocks are joined by one line feed in the
order of the page; ``br`` is white space. Scripts, styles, comments, templates and other unseen elements are no
text. A null or empty html, or one without content, gives an empty text. Every row gets its own answer, repeated rows too.
Pages are read whole whatever their length and however they nest; end tags that match nothing are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .page_labels import MARK, labelled_pages
from .session import free
from .textkernel import text_chunks

#: Places of hashed features.
FEATURES = 1 << 14
#: Pages to learn from, of those in the table; all rows get their text extracted.
SAMPLE = 4000
#: Of a page's words, how many an element with a single article in it must hold to be taken as a frame around it.
FRAME = 0.5
#: Log odds under which an element holds no article.
BLOCKED = -1.0
_RAW = "script|style|textarea|title|noscript|template|iframe|noframes|noembed|xmp|svg|math|object|select|datalist|canvas|audio|video|map"
#: Comments, declarations, raw elements as a whole, tags. Possessive, so that a broken tag costs no second look.
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<({_RAW})\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?<!/)>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""",
    re.S | re.I,
)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag of the key ends an open element of the value's tags, where no other container was opened since.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROOTS = frozenset(("article", "main", "h1"))
CONTAINERS = frozenset("html body article main section div td center form".split())
FRAMES = frozenset("html body form div section table tbody tr td center".split())


@lru_cache(1 << 15)
def place(feature: str) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) % FEATURES


class Page:
    """Elements (parent, tag, names, words below) and tokens (element, block, text or None for a tag; words) of one page."""

    def __init__(self, html: str):
        self.parent, self.tag, self.names = [-1], ["html"], [()]
        self.tokens: list[tuple[int, int, str | None]] = []
        at, block, stack, open_ = 0, 0, [0], Counter()

        def text(raw: str) -> None:
            if raw and not raw.isspace():
                self.tokens.append((stack[-1], block, entities.unescape(raw)))
            elif raw:
                self.tokens.append((stack[-1], block, " "))

        def end(name: str) -> None:
            while (gone := stack.pop()) and self.tag[gone] != name:
                open_[self.tag[gone]] -= 1
            open_[name] -= 1

        for m in TOKEN.finditer(html):
            text(html[at : m.start()])
            at = m.end()
            if not m[3]:
                continue
            name = m[3].lower()
            block += name not in INLINE
            if m[2]:
                if open_[name]:
                    self.tokens.append((stack[-1], block, None))
                    end(name)
                continue
            if name == "br":
                self.tokens.append((stack[-1], block, " "))
                continue
            if self.tag[stack[-1]] == "p" and name not in INLINE and name not in VOID:
                end("p")
            elif name in CLOSES and self.tag[stack[-1]] in CLOSES[name]:
                end(self.tag[stack[-1]])
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.names.append(tuple({w.lower() for found in NAMES.findall(m[4]) for w in PARTS.findall("".join(found))}) if m[4] else ())
            self.tokens.append((len(self.tag) - 1, block, None))
            if name not in VOID and not m[4].endswith("/"):
                stack.append(len(self.tag) - 1)
                open_[name] += 1
        text(html[at:])
        self.below, self.count = [0] * len(self.tag), [len(told.split()) if told else 0 for _, _, told in self.tokens]
        for (e, _, _), n in zip(self.tokens, self.count, strict=True):
            self.below[e] += n
        for e in range(len(self.tag) - 1, 0, -1):
            self.below[self.parent[e]] += self.below[e]
        self.inside = [False] * len(self.tag)  # an article or main
        for e in range(1, len(self.tag)):
            self.inside[e] = self.inside[self.parent[e]] or self.tag[self.parent[e]] in ("article", "main")

    def features(self, e: int) -> list[int]:
        """Places of an element's features: its tag (page and article headers are told apart), then its names."""
        tag = self.tag[e] + "@" * (self.inside[e] and self.tag[e] in ("header", "footer"))
        return [place(f"<{tag}"), *(place(f".{n}") for n in self.names[e])]

    def setting(self, e: int) -> int:
        """The place of where a word stands: its element, and the block around that."""
        around = e
        while around and self.tag[around] in INLINE:
            around = self.parent[around]
        return place(f"{self.tag[e]} {self.tag[around]}")


def learn(page: Page, label: list[float], counts: np.ndarray) -> None:
    """Add one page to counts[what, no or yes, feature]; label: for each token with words, the share that is content.

    what 0: do elements hold content, by their names, or by the tag if they have none; 1: words by setting; 2: tags by name,
    inside the article or not. Of elements inside one another that hold nothing but content, or none, the outermost counts.
    """
    good, tokens = [0.0] * len(page.tag), page.tokens
    for (e, _, _), n, y in zip(tokens, page.count, label, strict=True):
        good[e] += y * n
    below = good[:]
    for e in range(len(page.tag) - 1, 0, -1):
        below[page.parent[e]] += below[e]
    content = [i for i, y in enumerate(label) if y > 0.5]
    low, high = (content[0], content[-1]) if content else (len(tokens), -1)
    for e in range(1, len(page.tag)):
        mixed = 0 < below[page.parent[e]] < page.below[page.parent[e]]
        if page.below[e] and (mixed or not page.parent[e]):
            for f in page.features(e)[len(page.names[e]) > 0 :]:
                counts[0, int(below[e] > 0.05 * page.below[e]), f] += 1
    for i, ((e, _, told), n, y) in enumerate(zip(tokens, page.count, label, strict=True)):
        if told is None:
            counts[2, int(low <= i <= high), place(f"<{page.tag[e]}")] += 1
        elif n:
            counts[1, int(y > 0.5), page.setting(e)] += min(n, 50)


def article_labels(page: Page) -> list[float] | None:
    """Labels by the page's own mark-up, if it marks exactly one article; what usually isn't one counts as such there too."""
    if page.tag.count("article") != 1:
        return None
    yes = [False] * len(page.tag)
    for e in range(1, len(page.tag)):
        yes[e] = page.tag[e] == "article" or yes[page.parent[e]] and page.tag[e] not in ("nav", "aside", "form", "footer", "button")
    return [float(yes[e] and n > 0) for (e, _, _), n in zip(page.tokens, page.count, strict=True)]


@lru_cache(1)
def made_up_counts() -> np.ndarray:
    counts = np.zeros((3, 2, FEATURES))
    for html in labelled_pages():
        page = Page(html)
        shares = [[w.startswith(MARK) for w in told.split()] if told else [] for _, _, told in page.tokens]
        learn(page, [sum(s) / len(s) if s else 0.0 for s in shares], counts)
    return counts


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Weights [element, word, tag][feature] from about ``sample`` pages, where they mark one article, and from the made-up ones.

    Pages are drawn by a hash of their html, so equal tables give equal weights.
    """
    every = max(1, pages.count() // sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, 2, FEATURES))
        for batch in batches:
            for _, part in text_chunks(batch.column(0)):
                for page in map(Page, part):
                    if label := article_labels(page):
                        learn(page, label, counts)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"place": some, "n": counts.ravel()[some]})

    drawn = pages.select(F.col(html)).where(F.pmod(F.xxhash64(html), F.lit(every)) == 0)
    rows = drawn.mapInArrow(count, "place bigint, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(6 * FEATURES)
    counts[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return weights(made_up_counts() + counts.reshape(3, 2, FEATURES) ** 0.5)


def weights(counts: np.ndarray) -> np.ndarray:
    """Log odds of elements; words' chance to be content, above 0; tags' costs, below 0."""
    no, yes = counts[:, 0], counts[:, 1]
    out = np.log((yes + 0.5) / (no + 0.5))
    out[1] = (yes[1] + 1) / (yes[1] + no[1] + 2)
    out[2] = -0.2 - 3 * (no[2] + 1) / (yes[2] + no[2] + 2)
    return out


def _blocked(page: Page, w: list[list[float]]) -> list[bool]:
    """Which elements hold no article: by the least of their weights, unless they frame the article, or what is around does."""
    whole, roots = max(1, page.below[0]), [0] * len(page.tag)
    out = [False] * len(page.tag)
    for e in range(len(page.tag) - 1, 0, -1):
        roots[e] += page.tag[e] in ROOTS
        roots[page.parent[e]] += roots[e]
    for e in range(1, len(page.tag)):
        out[e] = out[page.parent[e]] or min(w[0][f] for f in page.features(e)) < BLOCKED or page.tag[e] == "button"
        if out[e] and not out[page.parent[e]] and page.tag[e] in FRAMES and roots[e] and page.below[e] >= FRAME * whole:
            out[e] = False
    return out


def _around(page: Page, a: int, b: int) -> list[bool]:
    """Which elements lie in the smallest container that holds elements a and b; none if that is the whole page."""
    path = set()
    while a >= 0:
        path.add(a)
        a = page.parent[a]
    while b not in path or page.tag[b] not in CONTAINERS:
        b = page.parent[b]
    out = [False] * len(page.tag)
    if page.tag[b] not in ("html", "body"):
        out[b] = True
        for e in range(b + 1, len(out)):
            out[e] = out[page.parent[e]]
    return out


def main_text(html: str | None, w: list[list[float]]) -> str:
    """The text of the best region of one page, by weights as lists."""
    page = Page(html or "")
    blocked = _blocked(page, w)
    best, low, high, total, start = 0.0, 0, -1, 0.0, 0
    for i, ((e, _, told), n) in enumerate(zip(page.tokens, page.count, strict=True)):
        if told is None:
            total += w[2][place(f"<{page.tag[e]}")]
        elif n and not blocked[e]:
            total += w[1][page.setting(e)] * n
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, low, high = total, start, i
    if high < low:
        return ""
    first, last = page.tokens[low][1], page.tokens[high][1]
    around = _around(page, page.tokens[low][0], page.tokens[high][0])
    blocks: dict[int, list[str]] = {}
    likely: dict[int, float] = {}
    for (e, block, told), n in zip(page.tokens, page.count, strict=True):
        if told and not blocked[e] and (first <= block <= last or around[e]):
            blocks.setdefault(block, []).append(told)
            likely[block] = likely.get(block, 0.0) + (w[1][page.setting(e)] - 0.5) * n
    blocks = {k: told for k, told in blocks.items() if first <= k <= last or likely[k] > 0}
    return "\n".join(text for parts in blocks.values() if (text := " ".join("".join(parts).split())))


def extract_text(pages: DataFrame, w: np.ndarray, html: str = "html") -> DataFrame:
    """Add to each row its main text as ``text`` and the code points of that as ``n_chars``.

    Other columns stay; columns named as the results are replaced.
    """
    rest = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    rows = pages.select(*(F.col(f"`{c}`") for c in rest), F.col(html).alias(free(pages, "_html")[0]))
    learnt = w.tolist()
    made = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for at, part in text_chunks(batch.column(last)):
                texts = [main_text(x, learnt) for x in part]
                own = [*(batch.column(i).slice(at, len(part)) for i in range(last)), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(own, names=[*batch.schema.names[:-1], "text", "n_chars"])

    return rows.mapInArrow(answer, T.StructType([*rows.schema.fields[:-1], *made]))
