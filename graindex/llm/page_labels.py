"""Made-up labelled pages, from which weights of tags and names are learnt together with the pages of a table.

A page is an article between the parts that surround or interrupt articles: menus, banners, notices, adverts, forms,
sidebars, comments, footers. Layouts, tags and class names are drawn at random from the lists below; words of the article
begin with ``MARK``, which is the label.
"""

from __future__ import annotations

import random

#: First character of each word that belongs to an article.
MARK = ""
#: Containers of an article: (tag, class or id). Some have no name that tells.
CONTENT = [
    ("article", ""), ("article", "post"), ("article", "entry hentry"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "main-content"), ("div", "article"),
    ("div", "article-body"), ("div", "post-content"), ("div", "entry-content"), ("div", "story body-text"), ("section", "article-text"), ("div", ""), ("td", ""), ("section", ""),
]
#: What is no article: (tag, names, kind of filling).
REST = [
    ("nav", ["", "menu", "navbar", "main-nav", "breadcrumb", "pagination"], "links"), ("div", ["menu", "nav", "navigation", "topbar", "breadcrumbs", "pager", "toc", "skip-links", "tags", "tag-list"], "links"),
    ("ul", ["menu", "nav", "breadcrumb", "share", "social", "pagination"], "links"), ("header", ["", "site-header", "masthead", "banner", "page-header"], "text"), ("div", ["header", "masthead", "logo", "site-title", "banner", "top-bar"], "text"),
    ("footer", ["", "site-footer", "page-footer"], "text"), ("div", ["footer", "copyright", "bottom", "legal", "credits", "colophon"], "text"), ("aside", ["", "sidebar", "widget", "related", "promo"], "mixed"),
    ("div", ["sidebar", "side-bar", "widget", "related-posts", "recommended", "trending", "popular", "more-stories", "author-box", "left-col-nav", "rail"], "mixed"),
    ("div", ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "sponsor", "promo", "promotion", "banner-ad"], "text"), ("section", ["ad", "promo", "newsletter", "related", "sponsored", "subscribe"], "text"),
    ("div", ["cookie", "cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "paywall", "disclaimer", "warning"], "text"), ("dialog", ["", "cookie-consent"], "text"),
    ("form", ["", "search", "login", "signup", "newsletter", "comment-form", "contact"], "form"), ("div", ["search", "newsletter", "subscribe", "signup", "login", "share", "share-buttons", "social"], "form"),
    ("section", ["comments", "comment-list", "responses", "discussion", "reviews"], "comments"), ("div", ["comments", "comment", "disqus", "replies", "reader-comments", "feedback"], "comments"), ("ol", ["comment-list", "comments"], "comments"),
]
#: Raw elements, whose text is never shown.
_HIDDEN = ["<script>var a = '<p>x</p>'; f(a);</script>", "<style>p > a { margin: 0 }</style>", "<!-- x <p>y</p> -->", "<noscript><img src=x alt=y> no script</noscript>"]


def labelled_pages(many: int = 600, seed: int = 7) -> list[str]:
    """``many`` pages; the same seed gives the same pages."""
    rng = random.Random(seed)

    def words(low: int, high: int, mark: str = "") -> list[str]:
        return [mark + "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(low, high))]

    def opened(tag: str, name: str) -> str:
        return f"<{tag}>" if not name else f'<{tag} {rng.choice(["class", "class", "id"])}="{name}">'

    def links(low: int, high: int) -> str:
        return "".join(f"<li><a href=/x>{' '.join(words(1, 3))}</a></li>" for _ in range(rng.randint(low, high)))

    def filling(kind: str) -> str:
        if kind == "links":
            return rng.choice(["<ul>{}</ul>", "{}"]).format(links(3, 12))
        if kind == "form":
            return f"<label>{' '.join(words(1, 4))}</label><input name=q><button>{' '.join(words(1, 2))}</button>" + f"<p>{' '.join(words(3, 12))}</p>" * rng.randint(0, 1)
        if kind == "comments":
            each = [f'<{(t := rng.choice(["div", "article", "li"]))} class="{rng.choice(["comment", "comment-body", "reply", "review"])}"><p>{" ".join(words(5, 60))}</p></{t}>' for _ in range(rng.randint(1, 5))]
            return f"<h3>{' '.join(words(1, 2))}</h3>{''.join(each)}"
        if kind == "mixed":
            return f"<h3>{' '.join(words(1, 3))}</h3><ul>{links(2, 8)}</ul>" + f"<p>{' '.join(words(4, 25))}</p>" * rng.randint(0, 2)
        return rng.choice(["<p>{}</p>", "{}", "<span>{}</span>", "<a href=/>{}</a>"]).format(" ".join(words(2, 30)))

    def part() -> str:
        tag, names, kind = rng.choice(REST)
        return f"{opened(tag, rng.choice(names))}{filling(kind)}</{tag}>"

    def block() -> str:
        text = words(8, 90, MARK)
        if len(text) > 20 and rng.random() < 0.5:
            i, tag = rng.randrange(len(text) - 3), rng.choice(["a", "b", "em", "strong", "i", "span", "code"])
            text[i : i + 3] = [f"<{tag}>{' '.join(text[i : i + 3])}</{tag}>"]
        told, shape = " ".join(text), rng.random()
        if shape < 0.72:
            return f"<p>{told}" + "</p>" * (rng.random() < 0.9)
        if shape < 0.8:
            return f"<h2>{' '.join(words(2, 7, MARK))}</h2><p>{told}</p>"
        if shape < 0.87:
            return f"<{(t := rng.choice(['ul', 'ol']))}>{''.join(f'<li>{" ".join(words(3, 20, MARK))}</li>' for _ in range(rng.randint(2, 6)))}</{t}>"
        if shape < 0.93:
            return f"<blockquote><p>{told}</p></blockquote>"
        return rng.choice(["<div>{}</div>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>"]).format(told)

    out = []
    for _ in range(many):
        tag, name = rng.choice(CONTENT)
        head = f"<h1>{' '.join(words(3, 10, MARK))}</h1>"
        body = "".join(block() + (part() if rng.random() < 0.08 else "") for _ in range(rng.randint(1, 12)))
        body = (f"<header>{head}</header>" if rng.random() < 0.2 else head) + body + (f"<footer>{' '.join(words(2, 10))}</footer>" if rng.random() < 0.15 else "")
        inside = "".join(part() for _ in range(rng.randint(0, 2))) if rng.random() < 0.3 else ""
        article = f"{opened(tag, name)}{body}{inside}</{tag}>"
        if tag == "td":
            article = f"<table><tr><td>{part()}</td>{article}</tr></table>"
        page = [part() for _ in range(rng.randint(1, 5))] + [article] + [part() for _ in range(rng.randint(0, 5))]
        page = "".join(x + (rng.choice(_HIDDEN) if rng.random() < 0.2 else "") for x in page)
        if rng.random() < 0.4:
            page = f'<div {rng.choice(["class", "id"])}="{rng.choice(["wrapper", "container", "page", "row", "site", "layout has-sidebar", "inner"])}">{page}</div>'
        out.append(f"<!DOCTYPE html><html><head><title>{' '.join(words(2, 8))}</title></head><body>{page}</body></html>")
    return out
