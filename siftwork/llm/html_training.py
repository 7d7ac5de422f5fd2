"""Labelled pages for the node classifier: invented words in many layouts, with the main text known."""

from __future__ import annotations

import random
from html import escape

_SYLLABLES = "the an ing er on re ti ha ou en st le ver sch ei que os ción ar do mi pa vi ré tion au lo ka su ni mo ta ri be".split()
_CLASS = {
    "content": ["content", "article-body", "post", "entry-content", "story", "main-content", "text", "post-content", "articleBody", "page-content", "prose"],
    "menu": ["nav", "menu", "navbar", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "pagination", "topnav", "site-nav", "links"],
    "head": ["header", "site-header", "masthead", "top", "page-header", "logo", "brand"],
    "foot": ["footer", "site-footer", "copyright", "page-footer", "legal", "bottom"],
    "side": ["sidebar", "related", "widget", "side", "rail", "popular-posts", "recommended", "tags", "more-stories"],
    "notice": ["cookie-banner", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "newsletter", "message", "gdpr", "announcement"],
    "advert": ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "advertisement", "ad-banner", "adbox"],
    "form": ["search", "login", "contact-form", "subscribe-form", "signup", "search-form"],
    "comment": ["comments", "comment-list", "comment", "responses", "reader-comments", "discussion", "replies", "reviews"],
    "share": ["share", "social", "social-share", "follow-us", "share-buttons"],
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: list[str] = []
        self.style = self.r.choice(("plain",) * 7 + ("shouted", "marked", "piped"))

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3))))

    def sentence(self, low: int = 3, high: int = 16) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.3:
            words[len(words) // 2] += ","
        return (" ".join(words)).capitalize() + self.r.choice(("." * 5 + "?!"))

    def styled(self, text: str) -> str:
        """Main text as junk pages have it: shouted, with marks after words, or as table rows."""
        words = text.split()
        if self.style == "shouted":
            return " ".join(f"{w.upper()}!!" for w in words)
        if self.style == "marked":
            return " ".join(w + self.r.choice(("***", "###", "&&&", "%%%")) for w in words)
        return " | ".join(words) if self.style == "piped" else text

    def heading(self) -> str:
        """A title with or without an end mark, or the cut-off start of the text."""
        text = self.styled(self.prose(1, 2))
        return text[: self.r.randint(5, 70)].strip() if self.r.random() < 0.6 else text.rstrip(".?!")

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def kept(self, text: str) -> str:
        text = text if text.endswith("\0") else self.styled(text)
        text = text.rstrip("\0")
        self.main.append(text)
        return escape(text)

    def attrs(self, kind: str, chance: float = 0.85) -> str:
        if self.r.random() > chance:
            return ""
        return f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(_CLASS[kind])}"'

    def links(self, n: int) -> str:
        style = self.r.randrange(3)
        found = [f'<a href="/{self.word()}">{self.word()}{" " + self.word() if self.r.random() < 0.3 else ""}</a>' for _ in range(n)]
        if style == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ")).join(found)

    def menu(self) -> str:
        tag = self.r.choice(("nav", "nav", "div", "ul" if self.r.random() < 0.2 else "div"))
        return f"<{tag}{self.attrs('menu', 0.5 if tag == 'nav' else 1)}>{self.links(self.r.randint(2, 9))}</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(("header", "div"))
        inside = self.r.choice((f"<a href='/'>{self.word()}</a>", f"<p>{self.sentence(2, 6)}</p>", f"<h2>{self.word()}</h2>", f"<div>{self.word()} {self.word()}</div>"))
        return f"<{tag}{self.attrs('head', 0.5 if tag == 'header' else 1)}>{inside}{self.menu() if self.r.random() < 0.4 else ''}{self.form() if self.r.random() < 0.2 else ''}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(("footer", "footer", "div"))
        inside = self.r.choice((f"&copy; {self.word()} &middot; {self.prose(1, 3)}", f"<p>{self.prose(1, 3)}</p>", f"<p>&copy; 2024 {self.word()}</p>{self.links(4)}", self.links(5) + f"<div>{self.sentence()}</div>"))
        return f"<{tag}{self.attrs('foot', 0.4 if tag == 'footer' else 1)}>{inside}</{tag}>"

    def boxed(self, kind: str, tags: tuple = ("div", "div", "section", "aside")) -> str:
        tag = self.r.choice(tags)
        title = f"<h{self.r.choice('234')}>{self.sentence(1, 3)}</h3>" if self.r.random() < 0.3 else ""
        inside = self.r.choice((self.prose(1, 2), f"<p>{self.prose(1, 4)}</p>", f"<p>{self.sentence()}</p><a href='#'>{self.word()}</a>", f"<span>{self.prose(1, 2)}</span> <button>{self.word()}</button>"))
        return f"<{tag}{self.attrs(kind, 1)}>{title}{inside}</{tag}>"

    def sidebar(self) -> str:
        tag = self.r.choice(("aside", "aside", "div"))
        parts = [self.r.choice((f"<h3>{self.sentence(1, 3)}</h3>{self.links(5)}", f"<p>{self.prose(1, 4)}</p>", f"<div>{self.prose(1, 2)}</div>", self.links(4))) for _ in range(self.r.randint(1, 3))]
        return f"<{tag}{self.attrs('side', 0.5 if tag == 'aside' else 1)}>{''.join(parts)}</{tag}>"

    def form(self) -> str:
        inside = f"<label>{self.sentence(1, 4)}</label><input name=q>" + self.r.choice(("", f"<p>{self.sentence()}</p>", f"<div>{self.prose(1, 2)}</div>")) + f"<button>{self.word()}</button>"
        return f"<form{self.attrs('form', 0.5)} action='/s'>{inside}</form>"

    def comments(self) -> str:
        one = self.r.choice((
            lambda: f"<div{self.attrs('comment', 0.7)}><p>{self.prose(1, 4)}</p></div>",
            lambda: f"<li><b>{self.word()}</b><p>{self.prose(1, 3)}</p></li>",
            lambda: f"<p>{self.prose(1, 3)}</p>",
            lambda: f"<article{self.attrs('comment', 1)}><p>{self.prose(1, 4)}</p></article>",
        ))
        body = "".join(one() for _ in range(self.r.randint(1, 6)))
        tag = self.r.choice(("div", "section", "ol" if "<li>" in body else "div"))
        return f"<{tag}{self.attrs('comment', 1)}>{f'<h3>{self.sentence(1, 2)}</h3>' if self.r.random() < 0.5 else ''}{body}{self.form() if self.r.random() < 0.3 else ''}</{tag}>"

    def paragraph(self) -> str:
        x = self.r.random()
        text = self.prose(1, self.r.choice((1, 3, 9)))
        if self.r.random() < 0.08:
            text = self.word().capitalize() + "."
        if x < 0.08:
            parts = [self.sentence(2, 9) for _ in range(self.r.randint(2, 5))]
            tag = self.r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.kept(p)}</li>" for p in parts) + f"</{tag}>"
        if x < 0.14:
            return f"<h{self.r.choice('23')}>{self.kept(self.heading() + chr(0))}</h2>"
        if x < 0.18:
            return f"<blockquote>{self.kept(text)}</blockquote>"
        if x < 0.2:
            cells = [self.kept(self.sentence(1, 4)) for _ in range(4)]
            return f"<table><tr><td>{cells[0]}</td><td>{cells[1]}</td></tr><tr><td>{cells[2]}</td><td>{cells[3]}</td></tr></table>"
        if x < 0.22:
            return f"<pre>{self.kept(text)}</pre>"
        if x < 0.27:
            a, b = self.sentence(), self.word()
            self.main.append(f"{a} {b} {text}")
            return f"<p>{escape(a)} <a href='/{b}'>{b}</a> {escape(text)}</p>"
        if x < 0.3:
            return f"<div>{self.kept(text)}</div>"
        if x < 0.45:
            return f"<p><b>{self.kept(text)}<br>"
        return f"<p>{self.kept(text)}" + ("</p>" if self.r.random() < 0.9 else "")

    def article(self) -> str:
        r = self.r
        body = [f"<h1>{self.kept(self.heading() + chr(0))}</h1>"] if r.random() < 0.9 else []
        if body and r.random() < 0.1:
            body = [f"<header>{body[0]}</header>"]
        for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
            body.append(self.paragraph())
            x = r.random()
            if x < 0.04:
                body.append(self.boxed("advert", ("div", "aside", "section")))
            elif x < 0.06:
                body.append(self.boxed("side", ("div", "aside")))
            elif x < 0.08:
                body.append(f"<div{self.attrs('share', 1)}>{self.links(3)}</div>")
            elif x < 0.09:
                body.append(self.form())
            elif x < 0.1:
                body.append(self.boxed("notice", ("div",)))
        text = "".join(body)
        style = r.randrange(6)
        if style <= 2:
            return f"<article{self.attrs('content', 0.4)}>{text}</article>"
        if style == 3:
            return f"<main{self.attrs('content', 0.3)}><article>{text}</article></main>"
        tag = r.choice(("div", "section", "main"))
        inner = f"<div{self.attrs('content', 1)}>{text}</div>"
        return f"<{tag}{self.attrs('content', 0.7)}>{inner if r.random() < 0.5 else text}</{tag}>"

    def page(self) -> tuple[str, list[str]]:
        r = self.r
        some = lambda make, chance: make() if r.random() < chance else ""
        before = [some(self.header, 0.5), some(self.menu, 0.7), some(lambda: self.boxed("notice"), 0.3), some(lambda: self.boxed("advert"), 0.4), some(self.form, 0.1), some(self.sidebar, 0.2)]
        r.shuffle(before)
        article = self.article()
        after = [some(lambda: self.boxed("advert"), 0.2), some(self.sidebar, 0.3), some(self.comments, 0.35), some(self.form, 0.15), some(lambda: self.boxed("side"), 0.2), some(lambda: self.boxed("notice"), 0.2)]
        r.shuffle(after)
        body = "".join(before) + article + "".join(after) + some(self.footer, 0.7)
        if r.random() < 0.25:
            body = f'<div class="{r.choice(("wrapper", "container", "page", "site", "row"))}">{body}</div>'
        script = f'<script>var t="</p>";track({r.randrange(99)});</script>'
        end = "</body></html>" if r.random() < 0.9 else ""
        return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.word()}</title><style>p{{margin:0}}</style>{script}</head><body>{body}{end}', self.main
