"""Made-up pages with known main text, from which the block labeller learns.

Pages are put together from parts in the ways sites are built: with meaningful
element names, with meaningful classes, or with neither, so that only order,
links and words tell.  Words of the text are invented, so that no vocabulary but
that of menus, notices and forms is learned.
"""

from __future__ import annotations

import random

#: paragraphs that show where main text begins and ends; no text has these characters
BEGIN, END = "\ue000", "\ue001"

MAIN_WRAPS = ("article", "main", "div class=content", "div class='post-content'", "div id=main-content", "section class=story",
              "div class='entry-content'", "div class=article-body", "div class='post hentry'", "div id=content",
              "div class=text", "div itemprop=articleBody", "div class='page-body'", "div role=main", "article class=post")
NEUTRAL = ("div", "div class=row", "div class='col wide'", "div class=wrap", "div id=x", "section", "div class=inner",
           "div class='clearfix'", "div class=box", "div class=container", "center", "div class=page", "div id=wrapper")
# per kind of part: wrappers, and the words it likes
PARTS = {
    "menu": (("nav", "div class=menu", "ul class='main-menu'", "div id=navigation", "div class='nav-bar'", "nav class=top",
              "div class=breadcrumbs", "div class=pagination", "div class='sub-menu'", "div role=navigation"),
             "home about contact news archive blog help next previous products services menu search more login".split()),
    "header": (("header", "div id=header", "div class='site-header'", "header class=banner", "div class=masthead",
                "div class='top-header'"), "welcome site official daily the online your logo".split()),
    "footer": (("footer", "div id=footer", "div class='site-footer'", "div class=copyright", "footer class=bottom",
                "div role=contentinfo"), "© · copyright all rights reserved privacy terms imprint contact legal".split()),
    "sidebar": (("aside", "div class=sidebar", "div id='sidebar'", "div class=widget", "aside class='widget-area'",
                 "div class='related-posts'", "div class=popular", "div class='recent posts list'", "div id=rail",
                 "div class='side-bar right'", "div class=recommended", "div role=complementary"),
                "related popular recent most read also tags categories archive posts articles see".split()),
    "advert": (("div class=ad", "div class='ads'", "div class=advert", "div id='ad-slot'", "div class=sponsored",
                "div class='promo'", "div class='banner-ad'", "aside class=advertisement", "div class='adsense box'",
                "ins class=adsbygoogle", "div class=commercial"),
               "advertisement sponsored buy now offer sale free discount today deal".split()),
    "notice": (("div class='cookie-notice'", "div id=cookies", "div class=alert", "div class='consent'", "div class=notice",
                "div class='gdpr-banner'", "div class='newsletter'", "div role=alert", "dialog class=modal",
                "div class='popup overlay'", "div class='message warning'", "noscript", "div role=dialog"),
               "cookies we use accept policy browser enable javascript subscribe newsletter agree settings".split()),
    "form": (("form", "form class=search", "div class='login-form'", "form id=subscribe", "div class='search-box'",
              "form class='contact-form'", "fieldset"),
             "name email password search submit send your sign up log in subscribe required".split()),
    "comments": (("div id=comments", "section class=comments", "ol class='comment-list'", "div class='comment-thread'",
                  "div class='reader-comments'", "section id=responses", "div class=discussion", "div id='disqus_thread'",
                  "div class='comments-area'", "ul class=replies", "div class=feedback"),
                 "comment reply said wrote says posted agree ago like thanks".split()),
    "social": (("div class=share", "div class='social-links'", "ul class='sharing'", "div class='follow-us'"),
               "share tweet facebook twitter follow email print".split()),
}
_BEFORE = ("header", "menu", "advert", "notice", "form", "social", "menu", "sidebar")
_AFTER = ("comments", "sidebar", "advert", "form", "social", "menu", "footer", "footer", "notice")


class PageMaker:
    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.syllables = [self._letters() for _ in range(60)]

    def _letters(self) -> str:
        r = self.random
        return "".join(r.choice("aeiouéüó" if k % 2 else "bcdfghklmnprstvwzç") for k in range(r.randint(2, 4)))

    def word(self) -> str:
        r = self.random
        word = "".join(r.choice(self.syllables) for _ in range(r.randint(1, 3)))
        junk = r.random()
        return word + (r.choice((",", ".", "", "!")) if junk < 0.2 else r.choice(("###", "%%%", "&amp;&amp;", "***"))
                       if junk < 0.22 else "")

    def prose(self, least: int, most: int) -> str:
        text = " ".join(self.word() for _ in range(self.random.randint(least, most)))
        return text[:1].upper() + text[1:] + self.random.choice((".", ".", "", "!"))

    def wrap(self, tag: str, inner: str) -> str:
        name, _, more = tag.partition(" ")
        end = "" if self.random.random() < 0.02 else f"</{name}>"
        return f"<{name}{' ' + more if more else ''}>{inner}{end}"

    def line(self, words: list[str], least: int = 1, most: int = 4) -> str:
        r = self.random
        return " ".join(r.choice(words) if r.random() < 0.5 else self.word() for _ in range(r.randint(least, most)))

    def part(self, kind: str, plain: bool) -> str:
        """A part that isn't main text; ``plain`` gives it no telling names."""
        r = self.random
        wraps, words = PARTS[kind]
        wrap = r.choice(NEUTRAL) if plain else r.choice(wraps)
        link = lambda: f'<a href="/{self.word()}">{self.line(words)}</a>'
        if kind in ("menu", "social") or kind in ("sidebar", "footer") and r.random() < 0.5 or plain and kind != "comments":
            inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 8))) + "</ul>"
            if r.random() < 0.3:
                inner = " | ".join(link() for _ in range(r.randint(3, 7)))
            if kind == "footer":
                inner += self.wrap("p", f"&copy; {self.word()} &middot; {self.prose(2, 8)}")
        elif kind == "form":
            inner = "".join(f"<label>{self.line(words, 1, 2)}</label><input name=q>" for _ in range(r.randint(1, 3)))
            inner += f"<button>{self.line(words, 1, 2)}</button>"
            if r.random() < 0.3:
                inner += "<select>" + "".join(f"<option>{self.word()}" for _ in range(3)) + "</select>"
        elif kind == "comments":
            inner = self.wrap("h3", f"{r.choice(('Comments', 'Responses', 'Reader comments', 'Discussion'))} ({r.randint(1, 40)})")
            for _ in range(r.randint(1, 6)):
                body = self.wrap("p", self.prose(3, 60))
                if r.random() < 0.5:
                    body = self.wrap("div", self.line(words, 2, 4)) + body
                inner += self.wrap(r.choice(("div", "li", "div class=comment")) if not plain else "div", body)
        elif kind == "header":
            inner = self.wrap("h1" if r.random() < 0.3 else "div", self.line(words, 1, 4)) + (
                self.wrap("p", self.line(words, 3, 10)) if r.random() < 0.6 else "")
        elif kind == "footer":
            inner = f"&copy; {self.word()}.example &middot; {self.prose(2, 14)}"
        else:  # adverts, notices and texts in a sidebar may be sentences of any words
            inner = self.prose(2, 30) if r.random() < 0.5 else self.line(words, 3, 14)
            if r.random() < 0.5:
                inner = self.wrap("p", inner) + (self.wrap("p", self.prose(3, 20)) if r.random() < 0.3 else "")
            if r.random() < 0.3:
                inner = self.wrap(r.choice(("h3", "h4")), self.line(words, 1, 3)) + inner
        return self.wrap(wrap, inner)

    def main(self) -> str:
        r = self.random
        body = self.wrap("h1", self.prose(2, 12)) if r.random() < 0.8 else ""
        for _ in range(max(1, int(r.expovariate(0.15)))):
            kind = r.random()
            text = self.prose(1, 90 if r.random() < 0.7 else 6)
            if kind < 0.72:
                body += f"<p>{text}</p>"
            elif kind < 0.8:
                body += f"<p><b>{text}<br><p>{self.prose(2, 60)}</p>"
            elif kind < 0.86:
                body += self.wrap(r.choice(("h2", "h3")), self.prose(1, 7))
            elif kind < 0.91:
                body += self.wrap("ul", "".join(f"<li>{self.prose(2, 20)}" for _ in range(r.randint(2, 5))))
            elif kind < 0.94:
                body += self.wrap("blockquote", text)
            elif kind < 0.96:
                body += self.wrap("pre", text)
            elif kind < 0.98:
                body += self.wrap("table", "<tr>" + "".join(f"<td>{self.prose(1, 6)}" for _ in range(3)))
            else:
                body += self.wrap("div", text)
            if r.random() < 0.06:  # something else in between
                body += self.beside(r.choice(("advert", "advert", "social", "sidebar", "form", "notice")))
        if r.random() < 0.1:
            body += self.beside(r.choice(("footer", "social", "comments", "sidebar")))
        return f"<p>{BEGIN}</p>{body}<p>{END}</p>"

    def beside(self, kind: str) -> str:
        return f"<p>{END}</p>{self.part(kind, False)}<p>{BEGIN}</p>"

    def page(self) -> str:
        """A page whose main text stands between marks."""
        r = self.random
        plain = r.random() < 0.12
        body = self.main()
        wrap = r.random()
        if wrap < 0.9:
            name, _, more = (r.choice(NEUTRAL) if plain else r.choice(MAIN_WRAPS)).partition(" ")
            body = f"<{name} {more}>{body}" + (f"</{name}>" if r.random() < 0.97 else "")
        before = "".join(self.part(k, plain) for k in r.sample(_BEFORE, r.randint(0, 4)))
        after = "".join(self.part(k, plain) for k in r.sample(_AFTER, r.randint(0, 5)))
        if r.random() < 0.5:  # around everything
            name, _, more = r.choice(NEUTRAL).partition(" ")
            before = f"<{name} {more}>" + before
        head = f"<title>{self.prose(2, 6)}</title><style>p{{}}</style>"
        return f"<!DOCTYPE html><html><head>{head}</head><body>{before}{body}{after}</body></html>"
