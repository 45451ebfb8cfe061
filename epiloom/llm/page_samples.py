"""Labelled sample pages: made from layouts, with the texts that are the article's own.

Words are made up, so that a model can't learn topics.  Layouts vary in what
holds the article (article, main, section, a named div, table cells), in what
stands around it and inside it without belonging to it, in nesting and in how
well the markup is formed.
"""

from __future__ import annotations

import random

SYLLABLES = "ka lo mir ten sa vo pre dal ish un ter og ni fa ber lus con ra mel tho wen qui sto par ende ung".split()
BODY_NAMES = ["content", "post-content", "entry-content", "article-body", "story", "main-content", "post", "text", "body-text", "articleBody", "page-content", "entry"]
AD_NAMES = ["ad", "ads", "advert", "advertisement", "ad-slot", "banner-ad", "sponsored", "promo", "adsbox"]
SIDE_NAMES = ["sidebar", "side", "rail", "widget", "related", "related-posts", "trending", "popular", "more-stories"]
NOTICE_NAMES = ["cookie-notice", "cookie", "notice", "gdpr-banner", "alert", "consent", "popup", "modal", "subscribe", "newsletter", "paywall-notice"]
COMMENT_NAMES = ["comments", "comment-list", "comment", "replies", "discussion", "user-comments", "respond"]
MENU_NAMES = ["menu", "nav", "navbar", "breadcrumbs", "breadcrumb", "topnav", "pagination", "tags", "toolbar"]
HEAD_NAMES = ["header", "site-header", "masthead", "top", "branding", "logo"]
FOOT_NAMES = ["footer", "site-footer", "bottom", "copyright", "legal", "colophon"]
SHARE_NAMES = ["share", "social", "share-buttons", "byline", "meta", "author-info", "tools"]


class Page:
    def __init__(self, rng: random.Random):
        self.r, self.main = rng, set()

    def words(self, lo: int, hi: int) -> str:
        r, out = self.r, []
        for i in range(r.randint(lo, hi)):
            w = "".join(r.choices(SYLLABLES, k=r.randint(1, 3)))
            out.append((w.capitalize() if i == 0 or r.random() < 0.04 else w) + (r.choice(",.") if r.random() < 0.12 else ""))
        return " ".join(out)

    def sentence(self, lo: int, hi: int) -> str:
        return self.words(lo, hi).rstrip(",.") + (self.r.choice(".?!") if self.r.random() < 0.93 else "")

    def own(self, text: str) -> str:
        self.main.add(text)
        return text

    def tag(self, tag: str, inner: str, name: str | None = None) -> str:
        r = self.r
        kind = f' {"class" if r.random() < 0.75 else "id"}="{name}"' if name else ""
        return f"<{tag}{kind}>{inner}</{tag}>"

    def marked(self, text: str) -> str:
        """The text with inline markup around some of its words."""
        w = text.split(" ")
        if len(w) > 6 and self.r.random() < 0.4:
            i = self.r.randrange(len(w) - 3)
            t = self.r.choice(["b", "i", "em", "strong", "span", 'a href="/x"'])
            w[i], w[i + 2] = f"<{t}>{w[i]}", f"{w[i + 2]}</{t.split()[0]}>"
        return " ".join(w)

    def links(self, n: int, tag: str = "ul") -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if tag == "ul" else " ".join(items) if self.r.random() < 0.5 else "".join(f"<div>{x}</div>" for x in items)

    def menu(self) -> str:
        r = self.r
        inner = self.links(r.randint(2, 8), r.choice(["ul", "ul", "div"]))
        return self.tag("nav", inner, r.choice([None, None, *MENU_NAMES])) if r.random() < 0.7 else self.tag("div", inner, r.choice(MENU_NAMES))

    def advert(self) -> str:
        r = self.r
        inner = self.sentence(3, 25)
        inner = r.choice([inner, f"<p>{inner}</p>", f'<a href="/ad">{inner}</a>', f"<h3>{self.words(2, 5)}</h3><p>{inner}</p>"])
        return self.tag(r.choice(["div", "div", "aside", "section"]), inner, r.choice(AD_NAMES))

    def side(self) -> str:
        r = self.r
        inner = "".join(r.choice([f"<h3>{self.words(1, 4)}</h3>", f"<p>{self.sentence(5, 40)}</p>", self.links(r.randint(2, 5))]) for _ in range(r.randint(1, 4)))
        return self.tag("aside", inner, r.choice([None, *SIDE_NAMES])) if r.random() < 0.6 else self.tag("div", inner, r.choice(SIDE_NAMES))

    def notice(self) -> str:
        r = self.r
        inner = r.choice([self.sentence(5, 30), f"<p>{self.sentence(5, 30)}</p>", f"<p>This site uses cookies. {self.sentence(3, 12)}</p><button>{self.words(1, 2)}</button>"])
        return self.tag(r.choice(["div", "div", "section", "p"]) if "<" not in inner else "div", inner, r.choice(NOTICE_NAMES))

    def form(self) -> str:
        r = self.r
        return self.tag("form", f"<label>{self.words(1, 4)}</label><input name='q'><p>{self.sentence(4, 20)}</p><button>{self.words(1, 2)}</button>", r.choice([None, "search", "newsletter", "login", "subscribe"]))

    def comments(self) -> str:
        r = self.r
        one = lambda: r.choice([f"<p>{self.sentence(4, 60)}</p>", f"<div><b>{self.words(1, 2)}</b><p>{self.sentence(4, 60)}</p></div>", f"<li><p>{self.sentence(3, 50)}</p></li>", f"<article><p>{self.sentence(4, 60)}</p></article>"])
        inner = f"<h3>{r.choice(['Comments', self.words(1, 3)])}</h3>" * (r.random() < 0.6) + "".join(self.tag("div", one(), "comment") if r.random() < 0.4 else one() for _ in range(r.randint(1, 5)))
        return self.tag(r.choice(["section", "div", "div", "ol", "aside"]), inner, r.choice(COMMENT_NAMES))

    def header(self) -> str:
        r = self.r
        inner = r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(2, 6)}</p>", f'<a href="/">{self.words(1, 3)}</a>', f"<div>{self.words(1, 4)}</div><p>{self.sentence(3, 15)}</p>"]) + (self.menu() if r.random() < 0.4 else "")
        return self.tag("header", inner, r.choice([None, *HEAD_NAMES])) if r.random() < 0.7 else self.tag("div", inner, r.choice(HEAD_NAMES))

    def footer(self) -> str:
        r = self.r
        inner = r.choice([f"&copy; {self.words(1, 2)}.example &middot; {self.sentence(3, 25)}", f"<p>{self.sentence(3, 25)}</p>", f"<p>Copyright 2020 {self.words(1, 3)}</p>" + self.links(3), self.sentence(4, 30)])
        return self.tag("footer", inner, r.choice([None, *FOOT_NAMES])) if r.random() < 0.75 else self.tag("div", inner, r.choice(FOOT_NAMES))

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.85:
            h = f"<{(t := r.choice(['h1', 'h1', 'h2']))}>{self.own(self.words(2, 12).rstrip(',.'))}</{t}>"
            parts.append(f"<header>{h}</header>" if r.random() < 0.12 else h)
        if r.random() < 0.2:
            parts.append(self.tag(r.choice(["div", "p"]), self.words(2, 6), r.choice(SHARE_NAMES)))
        if r.random() < 0.4:  # markup of a first paragraph left open
            parts.append(f"<p><b>{self.own(self.sentence(8, 60))}<br>")
        for _ in range(r.choice([1, 1, 2, 2, 3, 3, 4, 6, 10, 20])):
            kind = r.random()
            if kind < 0.72:
                parts.append(f"<p>{self.marked(self.own(self.sentence(*r.choice([(1, 4), (5, 20), (20, 90), (40, 160), (100, 400)]))))}" + "</p>" * (r.random() < 0.85))
            elif kind < 0.80:
                parts.append(f"<h2>{self.own(self.words(1, 7).rstrip(',.'))}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{self.marked(self.own(self.sentence(2, 25)))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.90:
                parts.append(f"<blockquote><p>{self.own(self.sentence(6, 40))}</p></blockquote>" if r.random() < 0.6 else f"<blockquote>{self.own(self.sentence(6, 40))}</blockquote>")
            elif kind < 0.93:
                parts.append("<table><tr>" + "".join(f"<td>{self.own(self.words(1, 6).rstrip(',.'))}</td>" for _ in range(r.randint(2, 4))) + "</tr></table>")
            elif kind < 0.96:
                parts.append(f"<figure><img src='x'><figcaption>{self.own(self.sentence(3, 15))}</figcaption></figure>")
            else:
                parts.append(f"<pre>{self.own(self.words(3, 20).rstrip(',.'))}</pre>")
        for maker, share in ((self.advert, 0.25), (self.side, 0.1), (self.form, 0.08), (self.notice, 0.08), (self.menu, 0.06)):
            if r.random() < share:
                parts.insert(r.randint(1, len(parts)), maker())
        if r.random() < 0.12:
            parts.append(self.tag("div", self.links(3), r.choice(SHARE_NAMES)))
        if r.random() < 0.12:
            parts.append(self.comments())
        if r.random() < 0.06:
            parts.append(f"<footer>{self.words(2, 8)}</footer>")
        inner = "".join(parts)
        return r.choice(
            [
                lambda: self.tag("article", inner), lambda: self.tag("article", inner), lambda: self.tag("article", inner, r.choice(BODY_NAMES)), lambda: self.tag("main", inner),
                lambda: self.tag("main", self.tag("article", inner)), lambda: self.tag("div", inner, r.choice(BODY_NAMES)), lambda: self.tag("section", inner, r.choice(BODY_NAMES)),
                lambda: self.tag("div", self.tag("div", inner, r.choice(BODY_NAMES)), "wrapper"), lambda: self.tag("article", self.tag("div", inner, r.choice([None, *BODY_NAMES]))), lambda: self.tag("div", inner),
            ]
        )()

    def made(self) -> str:
        r = self.r
        before, after = [], []
        for maker, share in ((self.header, 0.55), (self.menu, 0.7), (self.notice, 0.25), (self.advert, 0.5), (self.form, 0.12), (self.side, 0.12)):
            if r.random() < share:
                before.append(maker())
        if r.random() < 0.3:
            r.shuffle(before)
        for maker, share in ((self.comments, 0.3), (self.side, 0.35), (self.advert, 0.25), (self.form, 0.12), (self.notice, 0.15), (self.menu, 0.1), (self.footer, 0.85)):
            if r.random() < share:
                after.append(maker())
        glue = r.choice(["", "", "\n", "<!-- part -->", "\n  "])
        body = glue.join([*before, self.article(), *after])
        if r.random() < 0.2:
            body = self.tag("div", body, r.choice(["page", "container", "wrapper", "site"]))
        page = f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{body}"
        return page + "</body></html>" * (r.random() < 0.9)


def labelled_pages(n: int, seed: int):
    """n pages and the set of texts that are the article's own."""
    rng = random.Random(seed)
    for _ in range(n):
        page = Page(rng)
        html = page.made()
        yield html, page.main
