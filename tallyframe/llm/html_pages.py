"""Labelled pages to train the extraction model on, and how they are drawn.

The pages are generated: layouts of usual web pages, filled with random words. Each element that belongs to
the article carries a mark that the trainer reads and the model never sees. Half of the pages give no hint of their
article by its tag or class, some have misleading classes, and some have the article's blocks in the body itself.
"""

from __future__ import annotations

import random

MARK = "data-content"


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))


def _names(r: random.Random, *known: str) -> str:
    """A class or id: one of the known words, or words of no meaning, or both."""
    plain = r.choice(("", f"{r.choice('abcxyz')}{r.choice('klmno')}-{r.randint(1, 99)}", f"{r.choice(('lower', 'upper', 'left', 'right', 'wide', 'row', 'col', 'box', 'wrap', 'inner', 'page', 'top'))}"))
    name = " ".join(x for x in (r.choice(known) if known and r.random() < 0.7 else "", plain) if x)
    return f' {r.choice(("class", "class", "id"))}="{name}"' if name else ""


def _links(r: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">{_words(r, 1, 3)}</a></li>' for i in range(n)) + "</ul>"


def _boiler(r: random.Random, kind: str) -> str:
    text = {
        "nav": lambda: f"<nav>{_links(r, r.randint(3, 9))}</nav>",
        "header": lambda: f'<header><a href="/">{_words(r, 1, 2)}</a>{_links(r, r.randint(0, 4))}</header>',
        "footer": lambda: f"<footer>&copy; {_words(r, 2, 12)} <a href='/x'>{_words(r, 1, 2)}</a></footer>",
        "aside": lambda: f"<aside><h3>{_words(r, 1, 3)}</h3>{_links(r, r.randint(2, 6))}<p>{_words(r, 5, 30)}</p></aside>",
        "ad": lambda: f'<div class="{r.choice(("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored"))}">{_words(r, 3, 20)}</div>',
        "notice": lambda: f'<div {r.choice(("class", "id"))}="{r.choice(("cookie", "cookies", "notice", "consent", "newsletter", "popup", "modal", "alert", "subscribe"))}"><p>{_words(r, 5, 25)}</p></div>',
        "menu": lambda: f'<div{_names(r, "menu", "navbar", "nav", "navigation", "breadcrumb", "share", "social", "related", "pagination", "toolbar")}>{_links(r, r.randint(2, 7))}</div>',
        "sidebar": lambda: f'<div class="{r.choice(("sidebar", "widget", "aside"))}"><h3>{_words(r, 1, 4)}</h3><p>{_words(r, 4, 30)}</p></div>',
        "head": lambda: f'<div class="{r.choice(("header", "masthead", "site header", "page-header", "banner header"))}"><h2>{_words(r, 1, 5)}</h2>{_links(r, r.randint(0, 3))}</div>',
        "foot": lambda: f'<div{_names(r, "footer", "bottom footer", "copyright")}>{_words(r, 2, 10)} <a href="/t">{_words(r, 1, 3)}</a></div>',
        "hidden": lambda: f"<div {r.choice(('hidden', 'style=display:none'))}><p>{_words(r, 5, 40)}</p></div>",
        "form": lambda: f"<form><label>{_words(r, 1, 3)}</label><input name=q><button>{_words(r, 1, 2)}</button></form>",
        "comments": lambda: f'<{(t := r.choice(("section", "div")))} {r.choice(("class", "id"))}="comments"><h2>{_words(r, 1, 2)}</h2>'
        + "".join(f'<div class="comment"><p>{_words(r, 3, 40)}</p></div>' for _ in range(r.randint(1, 4))) + f"</{t}>",
    }
    return text[kind]()


BEFORE = ("nav", "header", "ad", "notice", "menu", "sidebar", "head", "hidden")
AFTER = ("footer", "aside", "ad", "notice", "menu", "sidebar", "form", "comments", "foot", "hidden")


def _block(r: random.Random) -> str:
    kind = r.choices(("p", "h2", "ul", "blockquote", "pre", "table", "figure", "section"), (60, 8, 6, 4, 2, 2, 2, 3))[0]
    on = f" {MARK}"
    if kind == "p":
        inner = _words(r, 1, r.choice((4, 30, 120, 120)))
        if r.random() < 0.3:
            inner += f' <a{on} href="/y">{_words(r, 1, 4)}</a> {_words(r, 3, 30)}'
        if r.random() < 0.2:
            inner = f"<b{on}>{_words(r, 2, 12)}</b> {inner}"
        return f"<p{on}>{inner}</p>"
    if kind == "ul":
        return f"<ul{on}>" + "".join(f"<li{on}>{_words(r, 2, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
    if kind == "table":
        return f"<table{on}>" + "".join(f"<tr{on}><td{on}>{_words(r, 1, 4)}</td><td{on}>{_words(r, 1, 4)}</td></tr>" for _ in range(3)) + "</table>"
    if kind == "figure":
        return f"<figure{on}><img src=a.png><figcaption{on}>{_words(r, 3, 15)}</figcaption></figure>"
    if kind == "section":
        return f"<section{on}><h2{on}>{_words(r, 1, 6)}</h2>" + "".join(f"<p{on}>{_words(r, 5, 80)}</p>" for _ in range(r.randint(1, 3))) + "</section>"
    return f"<{kind}{on}>{_words(r, 2, 40)}</{kind}>"


def labelled_page(seed: int) -> str:
    """One page; elements of the article have the mark."""
    r = random.Random(seed)
    on = f" {MARK}"
    title = f"<h1{on}>{_words(r, 1, 12)}</h1>"
    head = r.choice((title, title, title, f"<header{on}>{title}</header>", f"<header{on}>{title}<p{on}>{_words(r, 3, 20)}</p></header>", ""))
    blocks = [head] * bool(head) + [_block(r) for _ in range(r.randint(1, 14))]
    blocks.append(f"<p{on}>{_words(r, 20, 90)}</p>")
    for _ in range(r.choice((0, 0, 0, 1, 2))):
        blocks.insert(r.randint(1, len(blocks)), _boiler(r, r.choice(("ad", "menu", "aside", "form", "notice", "hidden"))))
    inner = "".join(blocks)
    known = ("content", "article", "post", "entry", "story", "main", "text", "body", "prose")
    body = r.choice(
        (
            f"<article{on}>{inner}</article>",
            f"<main{on}><article{on}>{inner}</article></main>",
            f"<main{on}>{inner}</main>",
            f"<div{on}{_names(r, *known)}>{inner}</div>",
            f'<div{on} class="{r.choice(known)}-{r.choice(("header", "banner", "widget", "menu", "share"))} {r.choice(known)}">{inner}</div>',
            f"<div{_names(r, 'wrapper', 'container', 'page')}><article{on}>{inner}</article></div>",
            f"<div{_names(r)}><div{on}{_names(r)}>{inner}</div></div>",
            f"<div{on}{_names(r)}>{inner}</div>",
            f"<section{on}{_names(r)}>{inner}</section>",
            f"<table><tr><td>{r.choice((_links(r, r.randint(1, 6)), f'<a href=/>{_words(r, 1, 2)}</a>', _boiler(r, 'menu')))}</td><td{on}>{inner}</td></tr></table>",
            inner,
            inner,
        )
    )
    before = [_boiler(r, k) for k in BEFORE if r.random() < 0.4]
    after = [_boiler(r, k) for k in AFTER if r.random() < 0.35]
    r.shuffle(before)
    if r.random() < 0.1:
        before, after = [], []
    return f"<!DOCTYPE html><html><head><title>{_words(r, 2, 8)}</title><style>p{{}}</style></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"
