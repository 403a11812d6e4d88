"""Labelled pages: page skeletons as they are common on the web, with every text block marked.

The pages are drawn from a seed; ``PAGES`` bounds how many a model learns from.
"""

from __future__ import annotations

from collections.abc import Iterator
from random import Random

PAGES = 1500
CONTENT, OTHER = "", ""

_SYLLABLES = "ba co de fi go hu la me ni po ra se ti vo wa xe yu zo an er in on".split()

# words of class and id attributes
_NAMES = {
    "nav": "nav navbar navigation menu main-menu topnav site-nav menubar mainnav tabs breadcrumb breadcrumbs pagination pager toc",
    "header": "header site-header page-header masthead top topbar banner branding logo",
    "footer": "footer site-footer page-footer bottom colophon copyright legal foot credits",
    "side": "sidebar side aside widget widgets right-column left-column rail secondary related related-posts recommended more-stories popular trending tags tag-cloud categories archive share sharing social social-links follow",
    "notice": "cookie cookie-banner cookie-notice consent gdpr notice alert notification modal popup overlay privacy disclaimer message toast announcement warning paywall",
    "ad": "ad ads advert advertisement adsbox ad-slot banner-ad sponsor sponsored sponsored-content promo promotion promoted dfp commercial affiliate",
    "form": "form search search-form login signup newsletter subscribe subscription contact-form register comment-form feedback",
    "comments": "comments comment comment-list comments-area responses discussion disqus replies reply reader-comments user-comments thread",
    "article": "article post entry story content main-content article-body post-content entry-content story-body article-content body-text page-content text post-body main document hentry blog-post",
    "wrap": "wrapper container page site wrap outer inner row col grid layout app root body",
    "meta": "byline meta author dateline post-meta entry-meta timestamp",
}
_WORDS = {k: v.split() for k, v in _NAMES.items()}


class _Writer:
    def __init__(self, rng: Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.rng.choice([".", ".", ".", "!", "?"]) for _ in range(self.rng.randint(low, high)))

    def named(self, kind: str, tag: str, chance: float = 0.85) -> str:
        r = self.rng
        names = [r.choice(_WORDS[kind])]
        if r.random() < 0.3:
            names.append(r.choice(_WORDS[kind]))
        if r.random() < 0.2:
            names[0] += f"-{r.randint(1, 9)}"
        given = f' {r.choice(["class", "class", "id"])}="{" ".join(names)}"' if r.random() < chance else ""
        return f"<{tag}{given}>"

    def link(self, mark: str, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{mark}{self.words(low, high)}</a>'

    def links(self, mark: str = OTHER) -> str:
        r = self.rng
        items = [self.link(mark) for _ in range(r.randint(2, 9))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else r.choice([" | ", " ", " &middot; "]).join(items)

    def nav(self) -> str:
        tag = self.rng.choice(["nav", "nav", "div", "ul"])
        inner = self.links()
        return f"{self.named('nav', tag, 0.5 if tag == 'nav' else 1)}{inner}</{tag}>"

    def header(self) -> str:
        tag = self.rng.choice(["header", "header", "div"])
        inner = f"<{(h := self.rng.choice(['h1', 'div', 'p', 'span']))}>{OTHER}{self.words(1, 6)}</{h}>" + (self.nav() if self.rng.random() < 0.6 else "")
        return f"{self.named('header', tag, 0.4 if tag == 'header' else 1)}{inner}</{tag}>"

    def footer(self) -> str:
        r = self.rng
        tag = r.choice(["footer", "footer", "footer", "div"])
        text = r.choice([f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 3)}", f"{self.words(2, 6)}. &copy; 20{r.randint(10, 29)}", self.sentences(1, 3)])
        inner = f"{OTHER}{text}" if r.random() < 0.5 else f"<p>{OTHER}{text}</p>"
        return f"{self.named('footer', tag, 0.3 if tag == 'footer' else 1)}{inner}{self.links() if r.random() < 0.4 else ''}</{tag}>"

    def side(self) -> str:
        r = self.rng
        tag = r.choice(["aside", "aside", "div", "section"])
        inner = f"<h3>{OTHER}{self.words(1, 4)}</h3>" + (self.links() if r.random() < 0.6 else "".join(f"<p>{OTHER}{self.sentences(1, 3)}</p>" for _ in range(r.randint(1, 4))))
        return f"{self.named('side', tag, 0.4 if tag == 'aside' else 1)}{inner}</{tag}>"

    def block(self, kind: str) -> str:
        r = self.rng
        tag = r.choice(["div", "div", "section", "aside", "p"]) if kind != "ad" else r.choice(["div", "div", "aside", "p", "section"])
        text = self.sentences(1, 4) if r.random() < 0.8 else self.words(1, 8)
        inner = f"{OTHER}{text}" if tag == "p" or r.random() < 0.5 else f"<p>{OTHER}{text}</p>"
        if tag != "p" and r.random() < 0.3:
            inner += f"<button>{OTHER}{self.words(1, 2)}</button>" if r.random() < 0.5 else self.link(OTHER)
        return f"{self.named(kind, tag, 1)}{inner}</{tag}>"

    def form(self) -> str:
        fields = "".join(f'<label>{OTHER}{self.words(1, 3)}</label><input name="x">' for _ in range(self.rng.randint(1, 3)))
        extra = f"<p>{OTHER}{self.sentences(1, 2)}</p>" if self.rng.random() < 0.5 else ""
        return f"{self.named('form', 'form', 0.5)}{extra}{fields}<button>{OTHER}{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        r = self.rng
        tag, item = r.choice(["section", "div", "ol", "aside"]), r.choice(["div", "article", "li", "p"])
        one = lambda: f"{self.named('comments', item, 0.8)}{OTHER + self.sentences(1, 4) if item == 'p' or r.random() < 0.4 else f'<p>{OTHER}{self.sentences(1, 4)}</p>'}</{item}>"
        head = f"<h3>{OTHER}{self.words(1, 3)}</h3>" if r.random() < 0.6 else ""
        return f"{self.named('comments', tag, 1)}{head}{''.join(one() for _ in range(r.randint(1, 6)))}</{tag}>"

    def paragraph(self) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.62:
            text = self.sentences(1, 9) if r.random() < 0.85 else self.words(1, 3) + "."
            if r.random() < 0.25:
                text += f" {self.link('')} {self.words(2, 8)}."
            if r.random() < 0.15:
                text = f"<b>{CONTENT}{text}<br>"
                return f"<p>{text}" + ("" if r.random() < 0.7 else "</b></p>")
            return f"<p>{CONTENT}{text}" + ("" if r.random() < 0.1 else "</p>")
        if kind < 0.7:
            return f"<h{(n := r.randint(2, 4))}>{CONTENT}{self.words(1, 7)}</h{n}>"
        if kind < 0.78:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{CONTENT}{self.words(1, 20)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>"
        if kind < 0.84:
            return f"<blockquote><p>{CONTENT}{self.sentences(1, 3)}</p></blockquote>" if r.random() < 0.6 else f"<blockquote>{CONTENT}{self.sentences(1, 3)}</blockquote>"
        if kind < 0.89:
            rows = "".join("<tr>" + "".join(f"<td>{CONTENT}{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4)))
            return f"<table>{rows}</table>"
        if kind < 0.92:
            return f"<pre>{CONTENT}{self.words(3, 20)}</pre>"
        if kind < 0.95:
            return f'<figure><img src="x"><figcaption>{CONTENT}{self.words(3, 12)}</figcaption></figure>'
        return f"<div>{CONTENT}{self.sentences(1, 5)}</div>" if r.random() < 0.6 else f"<section><h2>{CONTENT}{self.words(1, 6)}</h2><p>{CONTENT}{self.sentences(1, 6)}</p></section>"

    def article(self) -> str:
        r = self.rng
        title = f"<h1>{CONTENT}{self.words(2, 10)}</h1>"
        if r.random() < 0.25:
            title = f"<header>{title}</header>"
        parts = [title] if r.random() < 0.9 else []
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 8, 12])):
            parts.append(self.paragraph())
            extra = r.random()
            if extra < 0.05:
                parts.append(self.block("ad"))
            elif extra < 0.07:
                parts.append(self.side())
            elif extra < 0.08:
                parts.append(self.block("notice"))
            elif extra < 0.09:
                parts.append(self.form())
        if r.random() < 0.12:
            parts.append(self.comments())
        if r.random() < 0.08:
            parts.append(self.footer())
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        made = f"{self.named('article', tag, 0.3 if tag in ('article', 'main') else 0.9)}{''.join(parts)}</{tag}>"
        if r.random() < 0.3:
            tag = r.choice(["main", "div", "section"])
            made = f"{self.named('article', tag, 0.4)}{made}</{tag}>"
        return made

    def page(self) -> str:
        r = self.rng
        parts = []
        for make, chance in (
            (lambda: self.block("notice"), 0.3), (self.header, 0.6), (self.nav, 0.6), (lambda: self.block("ad"), 0.4),
            (self.side, 0.25), (self.form, 0.2), (self.article, 1.0), (self.comments, 0.3), (self.side, 0.4),
            (self.form, 0.15), (lambda: self.block("ad"), 0.2), (self.footer, 0.85), (lambda: self.block("notice"), 0.2),
        ):
            if r.random() < chance:
                parts.append(make())
        body = "".join(parts)
        if r.random() < 0.4:
            body = f"{self.named('wrap', 'div', 0.9)}{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{body}</body></html>"


def pages(n: int = PAGES, seed: int = 42) -> Iterator[str]:
    """Pages whose text blocks begin with ``CONTENT`` or ``OTHER``."""
    writer = _Writer(Random(seed))
    for _ in range(n):
        yield writer.page()
