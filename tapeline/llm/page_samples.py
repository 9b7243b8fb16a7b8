"""Labelled pages made from a rule, on which the block classifier of html.py is fitted.

Each page has a main text of a title, paragraphs, sub-headings and lists, and around and inside it menus,
headers, notices, adverts, forms, sidebars, reader comments and footers. Its markup is of one of three styles:
elements that say what they hold, plain elements with telling class words, or plain elements with names that
say nothing. Words are random syllables, so that nothing can be learned from them.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

SYLLABLES = "ba be ci da de en er es fo ga he in ja ko la le ma mi ne on or pa que re sa sch ti tion un va vi wo zu ä é ñ ö ü ß ction".split()
#: Telling class words by part of a page; the classifier sees of them only whether a name holds such a word.
NAMES = {
    "menu": "menu nav navbar navigation breadcrumb topbar".split(),
    "head": "header masthead banner".split(),
    "foot": "footer copyright legal".split(),
    "side": "sidebar related widget recommended toc".split(),
    "note": "cookie-notice consent gdpr-banner alert".split(),
    "ad": "ad advert ads sponsored promo".split(),
    "form": "newsletter subscribe login search signup".split(),
    "talk": "comments comment-list replies discussion".split(),
    "main": "content article-body post entry main-text story".split(),
}
TAGS = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "note": "div", "ad": "div", "form": "form", "talk": "section", "main": "article"}


class _Page:
    def __init__(self, rnd: random.Random):
        self.rnd, self.truth, self.n = rnd, set(), 0
        self.style = rnd.choices(("tags", "names", "mute"), (0.35, 0.25, 0.4))[0]
        self.paragraph = rnd.choice(("p", "p", "p", "div"))

    def word(self) -> str:
        return "".join(self.rnd.choice(SYLLABLES) for _ in range(self.rnd.randint(1, 4)))

    def said(self, n: int, stop: bool = True) -> str:
        words, stop = [self.word() for _ in range(n)], stop != (self.rnd.random() < 0.2)
        for i in range(0, n, 9):
            words[i] = words[i].capitalize()
            if i and stop:
                words[i - 1] += "."
        self.n += 1
        return f"{self.n} {' '.join(words)}{'.' if stop else ''}"

    def aside(self, n: int) -> str:
        """A sentence of boilerplate, at times as long as a paragraph where the markup says what it is."""
        long = self.style != "mute" and self.rnd.random() < 0.25
        return self.said(n * self.rnd.randint(3, 10) if long else n)

    def box(self, part: str, body: str) -> str:
        if self.style == "mute":
            name = "" if self.rnd.random() < 0.5 else f' class="x{self.rnd.randrange(10**6)}"'
            return f"<div{name}>{body}</div>"
        if self.style == "tags":
            tag = "main" if part == "main" and self.rnd.random() < 0.2 else TAGS[part]
            name = f' class="{self.rnd.choice(NAMES[part])}"' if tag in ("div", "section") else ""
            return f"<{tag}{name}>{body}</{tag}>"
        key = self.rnd.choice(("class", "class", "id"))
        return f'<div {key}="{self.rnd.choice(NAMES[part])}">{body}</div>'

    def links(self, n: int) -> str:
        item = self.rnd.choice(("<li>{}</li>", "{} | ", "<div>{}</div>"))
        got = "".join(item.format(f'<a href="/x">{self.said(self.rnd.randint(1, 4), False)}</a>') for _ in range(n))
        return f"<ul>{got}</ul>" if "li" in item else got

    def main(self, body: str) -> str:
        self.truth.add(body)
        return body

    def story(self) -> str:
        rnd, out = self.rnd, []
        if rnd.random() < 0.85:
            title = f"<h1>{self.main(self.said(rnd.randint(2, 14), False))}</h1>"
            out.append(f"<header>{title}</header>" if self.style == "tags" and rnd.random() < 0.2 else title)
        for _ in range(max(1, int(rnd.expovariate(0.2)))):
            p = self.main(self.said(rnd.choice((1, 2, 4, 8, 15, 30, 60, 120)) + rnd.randrange(4)))
            kind = rnd.random()
            if kind < 0.05:
                out.append(f"{p}<br><hr>")
            elif kind < 0.8:
                out.append(f"<{self.paragraph}>{p}</{self.paragraph}>")
            elif kind < 0.9:
                out.append(f"<h2>{self.main(self.said(rnd.randint(1, 6), False))}</h2><p>{p}</p>")
            elif kind < 0.95:
                out.append("<ul>" + "".join(f"<li>{self.main(self.said(rnd.randint(2, 20)))}</li>" for _ in range(3)) + f"</ul><p>{p}</p>")
            else:
                out.append(f"<blockquote>{p}</blockquote>")
            if rnd.random() < 0.08:
                out.append(rnd.choice((lambda: self.box("ad", f"<p>{self.aside(rnd.randint(3, 14))}</p>"), lambda: self.box("side", self.links(3)), lambda: self.box("form", f"<label>{self.said(2, False)}</label><input>")))())
        return "".join(out)

    def talk(self) -> str:
        tag = "article" if self.style == "tags" and self.rnd.random() < 0.5 else "div"
        return self.box("talk", "".join(f"<{tag}><p>{self.aside(self.rnd.randint(3, 25))}</p></{tag}>" for _ in range(self.rnd.randint(1, 5))))

    def wrapped(self, body: str, most: int) -> str:
        """body in up to so many elements that say nothing."""
        n = self.rnd.randint(0, most) if self.rnd.random() < 0.5 else 0
        return "<div>" * n + body + "</div>" * n

    def html(self) -> str:
        rnd, top, end = self.rnd, [], []
        if rnd.random() < 0.9:
            top.append(self.box("menu", self.links(rnd.randint(3, 9))))
        if rnd.random() < 0.4:
            top.append(self.box("head", f"<h2>{self.said(2, False)}</h2>" if rnd.random() < 0.5 else self.said(3, False)))
        if rnd.random() < 0.3:
            top.append(self.box("note", self.aside(rnd.randint(6, 20))))
        if rnd.random() < 0.6:
            top.append(self.box("ad", self.aside(rnd.randint(3, 14))))
        if rnd.random() < 0.35:
            end.append(self.box("side", "".join(f"<p>{self.aside(rnd.randint(3, 12))}</p>" for _ in range(rnd.randint(1, 3))) if rnd.random() < 0.4 else self.links(5)))
        if rnd.random() < (0.1 if self.style == "mute" else 0.4):
            end.append(self.talk())
        if rnd.random() < 0.3:
            end.append(self.box("form", f"<label>{self.said(3, False)}</label><input>"))
        if rnd.random() < 0.95:
            foot = rnd.choice(("&copy; ", "&copy; a.example.com &middot; ", "")) + self.aside(rnd.randint(2, 16))
            end.append(self.box("foot", f"<p>{foot}</p>" + (f"<p>{self.aside(9)}</p>" if rnd.random() < 0.3 else "") if rnd.random() < 0.4 else foot))
        if rnd.random() < 0.1:  # nothing but the main text
            top, end = [], []
        rnd.shuffle(top)
        if rnd.random() < 0.06:  # a few words, bare or in one paragraph
            story = "<hr>".join(self.main(self.said(rnd.randint(1, 6), rnd.random() < 0.5)) for _ in range(rnd.randint(1, 2)))
            story = story if rnd.random() < 0.4 else f"<p>{story}</p>"
            if rnd.random() < 0.5:
                story = self.box("main", story)
            else:
                top, end = [], []
        else:
            story = self.box("main", self.story()) if rnd.random() < 0.95 else self.story()
        page = "".join(self.wrapped(x, 2) for x in top) + self.wrapped(story, 4) + "".join(self.wrapped(x, 2) for x in end)
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{self.wrapped(page, 3)}</body></html>"


def labelled_pages(n: int, seed: int = 1) -> Iterator[tuple[str, set[str]]]:
    """(html, the texts of its content blocks) of n pages; every text of a page occurs once."""
    rnd = random.Random(seed)
    for _ in range(n):
        page = _Page(rnd)
        yield page.html(), page.truth
