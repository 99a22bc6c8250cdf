"""Labelled training pages: words of a given page laid out anew, with marks on all that belongs to the article."""

from __future__ import annotations

import html
import random

#: Opens each piece of text that belongs to the article; a sign for private use.
MARK = "\ue000"
_SYLLABLES = "an be co de el fa go hi in ko la me no or pe ra se ti un va".split()


class Layout:
    """One random page over `words`."""

    def __init__(self, words: list[str], seed: int):
        self.r = random.Random(seed)
        if len(words) < 40:
            words = words + ["".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(200)]
        self.words = words
        #: Some sites name their parts, some only use generic names or none.
        self.named = self.r.random() < 0.85
        self.semantic = self.r.random() < 0.6

    def some(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        at = self.r.randrange(len(self.words))
        return html.escape(" ".join((self.words[at:] + self.words)[:n]), quote=False)

    def sentence(self, low: int = 4, high: int = 25) -> str:
        return self.some(low, high).capitalize().rstrip(".,;") + self.r.choice([".", ".", ".", "!", "?"])

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def name(self, names: str) -> str:
        """An attribute that says what a part is for, in one of many ways."""
        if not self.named:
            return self.r.choice(["", f' class="{self.r.choice("row col box inner c1 x7 block grid wrap".split())}"'])
        word = self.r.choice(names.split())
        word = self.r.choice([word, word, f"{word}-{self.r.choice('box wrap area list block inner 1 2'.split())}", f"{self.r.choice('site page my the l'.split())}-{word}", f"{word}_{self.r.randint(1, 40)}"])
        return self.r.choice([f' class="{word}"', f' class="{word}"', f' id="{word}"', f' class="col {word}"', f' class="{word} clearfix"'])

    def part(self, tag: str, names: str, body: str) -> str:
        if self.semantic and self.r.random() < 0.8:
            return f"<{tag}{self.name(names) if self.r.random() < 0.4 else ''}>{body}</{tag}>"
        return f"<div{self.name(names)}>{body}</div>"

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.some(low, high)}</a>'

    def links(self, low: int = 3, high: int = 10) -> str:
        items = [self.link() for _ in range(self.r.randint(low, high))]
        return self.r.choice([lambda: "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<span>{i}</span> " for i in items)])()

    # Parts that are not the article.

    def nav(self) -> str:
        return self.part("nav", "nav menu navbar navigation breadcrumbs links tabs", self.links())

    def header(self) -> str:
        inside = [f"<a href='/'>{self.some(1, 3)}</a>", self.r.choice(["", f"<p>{self.some(2, 7)}</p>"]), self.r.choice(["", self.links()]), self.r.choice(["", self.form()])]
        return self.part("header", "header masthead top topbar branding banner", "".join(inside))

    def footer(self) -> str:
        inside = [f"&copy; {self.some(1, 3)}", f"&middot; {self.sentence()}", self.links(2, 6), f"<p>{self.sentences(1, 3)}</p>"]
        return self.part("footer", "footer bottom colophon copyright legal", " ".join(self.r.sample(inside, self.r.randint(1, 4))))

    def side(self) -> str:
        inside = [f"<h3>{self.some(1, 4)}</h3>{self.links(3, 8)}", f"<p>{self.sentences(1, 3)}</p>", self.ad(), f"<h4>{self.some(1, 4)}</h4>" + "".join(f"<div>{self.link(3, 9)} {self.some(3, 15)}</div>" for _ in range(3))]
        return self.part("aside", "sidebar aside related recommended widget rail popular trending", "".join(self.r.sample(inside, self.r.randint(1, 3))))

    def ad(self) -> str:
        return f"<{(tag := self.r.choice(['div', 'div', 'section', 'aside', 'p', 'ins']))}{self.name('ad ads advert advertisement banner sponsored promo sponsor')}>{self.r.choice([self.sentences(1, 3), self.link(2, 8), self.some(2, 12)])}</{tag}>"

    def notice(self) -> str:
        extra = self.r.choice(["", f"<button>{self.some(1, 2)}</button>", self.link()])
        return self.part("div", "cookie consent notice alert gdpr popup modal overlay cookie-banner message toast", self.r.choice([f"<p>{self.sentences(1, 3)}</p>{extra}", f"{self.sentence()} {extra}"]))

    def form(self) -> str:
        inside = "".join(f"<label>{self.some(1, 3)}</label><input name='a'>" for _ in range(self.r.randint(1, 3)))
        whole = f"<form>{self.r.choice(['', f'<p>{self.sentence()}</p>', f'<h3>{self.some(1, 4)}</h3>'])}{inside}<button>{self.some(1, 2)}</button></form>"
        return self.r.choice([whole, f"<div{self.name('newsletter subscribe search contact signup form')}>{self.r.choice(['', f'<p>{self.sentence()}</p>'])}{whole}</div>"])

    def share(self) -> str:
        return f"<div{self.name('share social tags meta follow')}>{self.links(2, 5)}</div>"

    def comments(self) -> str:
        one = lambda: self.r.choice(["<p>{}</p>", "{}"]).format(self.sentences(1, 4))
        tag = self.r.choice(["div", "li", "article"])
        said = "".join(f"<{tag}{self.name('comment reply comment-item review')}>{self.r.choice(['', f'<b>{self.some(1, 2)}</b> ', f'<span>{self.some(1, 3)}</span>'])}{one()}</{tag}>" for _ in range(self.r.randint(1, 6)))
        head = self.r.choice(["", f"<h3>{self.some(1, 3)}</h3>"])
        return self.part("section", "comments comment-list discussion replies responses", f"{head}{said}{self.r.choice(['', self.form()])}")

    # The article.

    def inline(self, text: str) -> str:
        words = text.split(" ")
        if len(words) > 4 and self.r.random() < 0.35:
            a = self.r.randint(1, len(words) - 2)
            b = self.r.randint(a + 1, min(len(words), a + 6))
            tag = self.r.choice(["b", "i", "em", "strong", "a href='/x'", "span", "code"])
            inner = MARK + " ".join(words[a:b])
            rest = " ".join(words[b:])
            return MARK + " ".join([*words[:a], f"<{tag}>{inner}</{tag.split()[0]}>" + (f" {MARK}{rest}" if rest else "")])
        return MARK + text

    def block(self) -> str:
        m = MARK
        return self.r.choices(
            [
                lambda: f"<p>{self.inline(self.sentences(1, 6))}</p>",
                lambda: f"<p>{self.inline(self.some(1, 4).capitalize())}.</p>",
                lambda: f"<p><b>{m}{self.sentences(1, 6)}<br><p>{m}{self.sentences(1, 3)}</p>",
                lambda: f"<h{(k := self.r.randint(2, 4))}>{m}{self.some(1, 8)}</h{k}>",
                lambda: "<ul>" + "".join(f"<li>{self.inline(self.some(2, 20))}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>",
                lambda: "<ol>" + "".join(f"<li>{m}{self.sentence()}" for _ in range(self.r.randint(2, 5))) + "</ol>",
                lambda: f"<blockquote>{self.r.choice([f'<p>{m}{self.sentences(1, 3)}</p>', m + self.sentences(1, 2)])}</blockquote>",
                lambda: "<table>" + "".join("<tr>" + "".join(f"<td>{m}{self.some(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 5))) + "</table>",
                lambda: f"<pre>{m}{self.some(5, 30)}</pre>",
                lambda: f"<figure><img src='x'><figcaption>{m}{self.some(2, 12)}</figcaption></figure>",
                lambda: f"{m}{self.sentences(1, 3)}<br>{m}{self.sentences(1, 3)}<br><br>",
                lambda: f"<div>{m}{self.sentences(1, 4)}</div>",
                lambda: f"<section><h2>{m}{self.some(1, 6)}</h2><p>{self.inline(self.sentences(1, 4))}</p><p>{m}{self.sentences(1, 4)}</p></section>",
            ],
            [40, 6, 6, 6, 4, 2, 3, 2, 1, 2, 4, 5, 3],
        )[0]()

    def article(self) -> str:
        title = [f"<h1>{MARK}{self.some(2, 12)}</h1>"] if self.r.random() < 0.8 else []
        if title and self.r.random() < 0.2:
            title = [f"<header>{title[0]}</header>"]
        blocks = [self.block() for _ in range(self.r.choice([1, 2, 3, 5, 8, 12, 20]))] if self.r.random() < 0.85 else [f"<p>{MARK}{self.some(1, 8)}.</p>"]
        for odd in (self.ad, self.form, self.side, self.share, self.notice):
            if self.r.random() < 0.15:
                blocks.insert(self.r.randint(0, len(blocks)), odd())
        body = "".join([*title, *blocks])
        if self.r.random() < 0.3:
            body = f"<div{self.name('body text content entry-content post-body')}>{body}</div>"
        if self.r.random() < 0.1:
            return body
        return self.part(self.r.choice(["article", "article", "main"]), "content post article entry main story article-body post-content text", body)

    def page(self) -> str:
        r = self.r
        if r.random() < 0.03:
            return "".join(self.block() for _ in range(r.randint(1, 4)))
        # The article keeps its place among parts before and after it.
        before = [p() for p, often in ((self.header, 0.5), (self.nav, 0.7), (self.notice, 0.25), (self.ad, 0.45), (self.side, 0.15)) if r.random() < often]
        after = [p() for p, often in ((self.share, 0.2), (self.ad, 0.2), (self.comments, 0.4), (self.side, 0.4), (self.form, 0.25), (self.footer, 0.75), (self.notice, 0.15)) if r.random() < often]
        body = self.article()
        if r.random() < 0.3 and after:
            body = f"<div{r.choice(['', ' class=row', ' id=wrapper'])}>{body}{after.pop(0)}</div>"
        whole = "".join([*before, body, *after])
        for _ in range(r.choice([0, 0, 1, 2])):
            whole = f"<div{r.choice(['', ' class=wrapper', ' id=page', ' class=container'])}>{whole}</div>"
        whole = f"<!DOCTYPE html><html><head><title>{self.some(1, 8)}</title><style>p{{margin:0}}</style></head><body>{whole}</body></html>"
        return whole[: -r.randint(1, 60)] if r.random() < 0.1 else whole
