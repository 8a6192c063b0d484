"""Seeded generator of labelled training pages for the block labeller.

Pages mix the usual ways of marking up an article and what surrounds it. The words are random
syllables, so the labeller learns from structure and from the shape of a text, not its language.
"""

from __future__ import annotations

import random

#: Usual names of article containers and of what is not the article.
CONTENT = "content article post entry story body main text prose page single hentry".split()
AROUND = {
    "nav": "menu nav navbar navigation breadcrumb breadcrumbs topbar pagination pager links toc".split(),
    "header": "header masthead top branding logo site title hero".split(),
    "footer": "footer bottom legal copyright colophon credits site".split(),
    "aside": "sidebar aside widget related recommended popular trending side rail more".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense".split(),
    "notice": "cookie consent notice alert gdpr privacy modal popup overlay message warning".split(),
    "form": "form login search subscribe newsletter signup contact".split(),
    "comments": "comment comments discussion respond reply replies thread disqus".split(),
    "share": "share social follow sharing buttons meta tags byline".split(),
}


class PageMaker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        letters = [c + v + e for c in "bcdfghlmnprstvw" for v in "aeiouéäóöè" for e in ("", "n", "r", "s")]
        self.syllables = self.rng.sample(letters, 120)

    def word(self) -> str:
        return "".join(self.rng.choice(self.syllables) for _ in range(self.rng.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, lo: int, hi: int) -> str:
        r = self.rng
        words = [self.word() for _ in range(r.randint(lo, hi))]
        tail = r.choice(("", "", "", "***", "$$$", "&amp;&amp;", "!!")) if r.random() < 0.15 else ""
        if tail:
            words = [w + tail for w in words]
        return " ".join(words).capitalize() + r.choice((".", ".", ".", "", "!", "?"))

    def prose(self, n: int | None = None) -> str:
        return " ".join(self.sentence(4, 18) for _ in range(n or self.rng.choice((1, 2, 3, 5, 8, 14))))

    def name(self, words: list[str]) -> str:
        r = self.rng
        picked = r.sample(words, min(len(words), r.choice((1, 1, 2))))
        return r.choice((f' class="{"-".join(picked)}"', f' id="{"_".join(picked)}"', f" class='{' '.join(picked)} {self.word()}'", f" class={picked[0]}"))

    def links(self, n: int) -> str:
        r = self.rng
        if r.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{self.word()}">{self.sentence(1, 4).rstrip(".!?")}</a></li>' for _ in range(n)) + "</ul>"
        return r.choice(("<p>{}</p>", "{}")).format(r.choice((" | ", " ", " · ")).join(f'<a href="#">{self.sentence(1, 3)}</a>' for _ in range(n)))

    def around(self, kind: str) -> str:
        """Markup whose every block is not the article."""
        r = self.rng
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = own if own and r.random() < 0.65 else r.choice(("div", "div", "section", "ul" if kind == "nav" else "div"))
        attributes = "" if tag == own and r.random() < 0.5 else self.name(AROUND[kind])
        short = self.sentence(1, 9)
        if kind == "nav":
            inner = self.links(r.randint(2, 9))
        elif kind == "header":
            inner = r.choice((f"<h1>{short}</h1>", f"<p>{short}</p>", short)) + (self.links(r.randint(2, 6)) if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = r.choice((f"&copy; {self.word()}.example &middot; {self.prose(r.randint(1, 3))}", f"<p>{self.prose(r.randint(1, 3))}</p>", self.links(4) + f"<p>{short}</p>"))
        elif kind == "aside":
            inner = f"<h3>{short}</h3>" + r.choice((self.links(r.randint(2, 6)), f"<p>{self.prose(r.randint(1, 4))}</p>"))
        elif kind == "form":
            inner = f"<label>{short}</label><input name=q><p>{self.prose(1)}</p><button>{self.word()}</button>"
        elif kind == "comments":
            inner = f"<h3>{self.sentence(1, 3)}</h3>" + "".join(f"<div{self.name(AROUND['comments'])}><b>{self.word()}</b><p>{self.prose(r.randint(1, 5))}</p></div>" for _ in range(r.randint(1, 5)))
        else:
            inner = r.choice((f"<p>{self.prose(r.randint(1, 4))}</p>", short, self.prose(r.randint(1, 4)), f"<a href='#'>{short}</a>"))
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def article_part(self) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.68:
            inner = self.prose()
            if r.random() < 0.2:
                inner = f"<b>{inner}<br>" if r.random() < 0.4 else f'{inner} <a href="/x">{self.word()}</a> {self.sentence(2, 9)}'
            return f"<p>{inner}" + ("</p>" if r.random() < 0.8 else "")
        if kind < 0.78:
            return f"<h{r.randint(2, 4)}>{self.sentence(1, 7)}</h{2}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{self.sentence(2, 12)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote>{r.choice(('<p>{}</p>', '{}')).format(self.prose(r.randint(1, 3)))}</blockquote>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.sentence(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return r.choice((f"<pre>{self.word()} = {self.word()}</pre>", f"<figure><figcaption>{self.sentence(2, 8)}</figcaption></figure>", f"<div>{self.prose(2)}</div>"))

    def page(self) -> tuple[str, str]:
        """(html, html of the same page in which every article block starts with the mark \\x02)."""
        r = self.rng
        body: list[tuple[bool, str]] = []
        for kind in r.sample(("notice", "nav", "header", "ad", "share", "form", "aside"), r.randint(1, 5)):
            body.append((False, self.around(kind)))
        inner = [(True, f"<h1>{self.sentence(2, 12)}</h1>")] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
            inner.append((True, self.article_part()))
            if r.random() < 0.12:
                inner.append((False, self.around(r.choice(("ad", "aside", "share", "notice", "form")))))
        if r.random() < 0.25:
            inner.append((False, self.around(r.choice(("comments", "share", "aside", "nav")))))
        tag = r.choice(("article", "article", "main", "div", "div", "section", "td"))
        attributes = self.name(CONTENT) if tag not in ("article", "main") or r.random() < 0.4 else ""
        wrap = ("<table><tr><td class=x>", "</td></tr></table>") if tag == "td" else r.choice((("", ""), ("<div id=wrapper>", "</div>"), ("<main>", "</main>"), ("<div class='container page'>", "</div>")))
        body += [(False, wrap[0] + f"<{tag}{attributes}>"), *inner, (False, f"</{tag}>" + wrap[1])]
        for kind in r.sample(("footer", "comments", "aside", "ad", "nav", "form", "notice"), r.randint(1, 4)):
            body.append((False, self.around(kind)))
        head = f"<!DOCTYPE html><html><head><title>{self.sentence(2, 8)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>"
        return head + "".join(s for _, s in body) + "</body></html>", head + "".join(f"\x02{s}\x03" if good else s for good, s in body) + "</body></html>"
