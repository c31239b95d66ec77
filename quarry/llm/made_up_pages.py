"""Pages made up to train the extractor: their main blocks carry the attribute data-y."""

from __future__ import annotations

import random
from collections.abc import Iterator

_SOUNDS = "a e i o u ba co di en er fa ge hi in ka le ma no on or pa qu re sa st ti un ve wi za th ion é ü ñ".split()
#: Names of parts by language, beside the English ones: header, menu, footer, sidebar, comments, notice, advert, main text.
_FOREIGN = {
    "header": ["kopfzeile", "entete", "cabecera", "intestazione", "koptekst"],
    "nav": ["hauptmenue", "menue", "menu-principal", "navigatie"],
    "footer": ["fusszeile", "impressum", "pied-de-page", "piepagina", "rodape", "voettekst"],
    "sidebar": ["seitenleiste", "randspalte", "barrelaterale", "lateral", "zijbalk"],
    "comments": ["kommentare", "kommentar-liste", "commentaires", "comentarios", "commenti", "reacties"],
    "notice": ["hinweis", "avis", "aviso", "melding"],
    "ad": ["werbung", "anzeige", "publicite", "publicidad", "anuncio", "pubblicita"],
    "main": ["inhalt", "beitrag", "artikel", "contenu", "contenido", "contenuto", "corps", "cuerpo", "inhoud"],
}
#: Names of main text that mislead: its topic is what other parts are named after.
_MISLEADING = ["comment-policy", "review", "book-review", "comment-of-the-day", "site-news", "search-story", "menu-guide", "tag-history", "header-study", "sponsor-report", "related-work", "consent-law"]
_OWNERS = ["&copy; {} {}", "© {} {}", "Copyright {} {}", "&copy; {} {}. All rights reserved.", "(c) {} {} &middot; Copyright", "© {} {} Alle Rechte vorbehalten"]
_CALLS = ["We use cookies.", "This site uses cookies", "Subscribe to our newsletter", "Sign up", "Log in", "Advertisement", "Sponsored", "See our privacy policy."]
_VOCABULARY = ["".join(word) for rng in [random.Random(1)] for k in range(1, 5) for word in (rng.choices(_SOUNDS, k=k) for _ in range(1500))]
_STOPS = [""] * 8 + [",", "."]
_WRAPS = ["wrap", "page", "container", "layout", "row", "outer", "grid", "col", "inner", "app", "root", "x1", "block", "box"]


class _Maker:
    def __init__(self, rng: random.Random):
        self.r = rng

    def words(self, lo: int, hi: int) -> str:
        n = self.r.randint(lo, hi)
        return " ".join(map(str.__add__, self.r.choices(_VOCABULARY, k=n), self.r.choices(_STOPS, k=n)))

    def sentence(self, long: bool) -> str:
        lo, hi = (8, 120) if long and self.r.random() < 0.7 else (1, 12)
        if long and self.r.random() < 0.02:
            lo, hi = 300, 1500
        text = self.words(lo, hi).capitalize() + self.r.choice([".", ".", ".", "", "!"])
        if self.r.random() < 0.15:
            some = text.split(" ")
            k = self.r.randrange(len(some))
            some[k] = f"<a href='/{k}'>{some[k]}</a>" if self.r.random() < 0.5 else f"<em>{some[k]}</em>"
            text = " ".join(some)
        return text + self.r.choice(["", "", "", " &amp; ", "&nbsp;"])

    def rights(self) -> str:
        return self.r.choice(_OWNERS).format(self.r.randint(1990, 2030), self.words(1, 4))

    def attr(self, names: list[str], kind: str = "") -> str:
        r, name = self.r, self.r.choice(_FOREIGN[kind] if kind and self.r.random() < 0.3 else names)
        name = r.choice([name, name, name + "-" + r.choice(_WRAPS), r.choice(_WRAPS) + "-" + name, name + str(r.randint(1, 9))])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def links(self, lo: int, hi: int) -> str:
        items = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(self.r.randint(lo, hi))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" if self.r.random() < 0.9 else f"<li>{i}" for i in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items)

    def prose(self, lo: int, hi: int) -> str:
        kind = self.r.choice(["p", "p", "div", "span"])
        return "".join(f"<{kind}>{self.sentence(True)}</{kind}>" for _ in range(self.r.randint(lo, hi)))

    def plain_or(self, tag: str, names: list[str], inner: str, kind: str = "") -> str:
        """A telling tag, or a div with a telling name, or both."""
        k = self.r.random()
        if k < 0.4 and tag != "div":
            return f"<{tag}>{inner}</{tag}>"
        if k < 0.7 and tag != "div":
            return f"<{tag}{self.attr(names, kind)}>{inner}</{tag}>"
        return f"<div{self.attr(names, kind)}>{inner}</div>"

    def boilerplate(self, kind: str) -> str:
        r = self.r
        if kind in ("nav", "sidebar", "related") and r.random() < 0.1:  # only the links tell
            return f"<div{self.attr(_WRAPS) * (r.random() < 0.7)}>{self.links(3, 12)}</div>"
        if kind == "nav":
            return self.plain_or("nav", ["nav", "menu", "navbar", "breadcrumbs", "topbar", "navigation"], self.links(2, 12), "nav")
        if kind == "header":
            inner = f"<{r.choice(['h1', 'h2', 'div', 'p'])}>{self.words(1, 5)}</>".replace("</>", r.choice(["</h1>", "</div>"])) if r.random() < 0.2 else self.words(1, 6)
            if r.random() < 0.5:
                inner = f"<p>{self.words(1, 12)}</p>" + inner
            if r.random() < 0.5:
                inner += self.links(2, 6)
            return self.plain_or("header", ["header", "masthead", "site-header", "logo", "branding"], inner, "header")
        if kind == "footer":
            if r.random() < 0.15:  # only the owner's line tells
                return f"<{(t := r.choice(['div', 'div', 'p', 'center']))}{self.attr(_WRAPS) * (r.random() < 0.3)}>{self.rights()}{r.choice(['', '', ' ' + self.links(1, 4), ' ' + self.words(1, 12)])}</{t}>"
            inner = r.choice([f"{self.rights()} &middot; {self.sentence(False)}", f"&copy; {self.words(1, 4)} &middot; {self.sentence(True)}", f"<p>&copy; {self.sentence(r.random() < 0.5)}</p>", self.links(2, 8), self.prose(1, 3)])
            return self.plain_or("footer", ["footer", "bottom", "copyright", "legal", "site-footer"], inner, "footer")
        if kind == "sidebar":
            inner = "".join(r.choice([self.links(2, 8), self.prose(1, 3), f"<h3>{self.words(1, 3)}</h3>" + self.links(2, 6)]) for _ in range(r.randint(1, 3)))
            return self.plain_or("aside", ["sidebar", "side", "widget", "rail", "aside"], inner, "sidebar")
        if kind == "notice":
            return f"<{(t := r.choice(['div', 'div', 'section']))}{self.attr(['cookie', 'cookie-banner', 'consent', 'notice', 'gdpr', 'alert', 'popup', 'modal'], 'notice')}>{r.choice(['', r.choice(_CALLS) + ' '])}{self.inner(1, 3)}{'<button>ok</button>' * (r.random() < 0.4)}</{t}>"
        if kind == "ad":
            return f"<{(t := r.choice(['div', 'div', 'aside', 'section', 'p']))}{self.attr(['ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner', 'ad-slot', 'sponsor'], 'ad')}>{r.choice(['', '', r.choice(_CALLS) + ' '])}{self.words(1, 40) if t == 'p' else self.inner(1, 3)}</{t}>"
        if kind == "form":
            fields = "".join(f"<label>{self.words(1, 2)}</label><input name=a>" for _ in range(r.randint(1, 4)))
            text = f"<p>{self.sentence(r.random() < 0.4)}</p>" if r.random() < 0.6 else self.words(0, 6)
            form = f"<form{self.attr(['search', 'newsletter', 'subscribe', 'login', 'contact']) * (r.random() < 0.5)}>{text}{fields}<button>{self.words(1, 1)}</button></form>"
            return form if r.random() < 0.6 else f"<div{self.attr(['newsletter', 'signup', 'subscribe', 'search'])}><p>{self.sentence(True)}</p>{form}</div>"
        if kind == "comments":
            one = lambda: f"<{(t := r.choice(['div', 'li', 'article']))}{self.attr(['comment', 'reply', 'comment-body'], 'comments') * (r.random() < 0.7)}>{f'<b>{self.words(1, 2)}</b> ' * (r.random() < 0.4)}{self.inner(1, 3)}</{t}>"
            body = (f"<h{r.randint(2, 4)}>{self.words(1, 3)}</h3>" if r.random() < 0.5 else "") + "".join(one() for _ in range(r.randint(1, 8)))
            return f"<{(t := r.choice(['div', 'section', 'ol', 'ul', 'aside']))}{self.attr(['comments', 'comment-list', 'discussion', 'replies', 'responses', 'comments-area'], 'comments')}>{body}</{t}>"
        inner = r.choice([self.links(2, 7), self.prose(1, 2) + self.links(1, 4), self.words(2, 14)])
        return f"<{(t := r.choice(['div', 'section', 'ul', 'aside']))}{self.attr(['related', 'share', 'social', 'recommended', 'tags', 'more', 'popular', 'follow'])}>{inner}</{t}>"

    def inner(self, lo: int, hi: int) -> str:
        return self.r.choice([self.sentence(True), self.sentence(False), self.prose(lo, hi), f"<p>{self.sentence(True)}</p>"])

    def main_block(self) -> str:
        r, k = self.r, self.r.random()
        if k < 0.7:
            if r.random() < 0.15:
                return f"<p data-y=1><b>{self.sentence(True)}<br>"
            return f"<p data-y=1>{self.sentence(True)}" + "</p>" * (r.random() < 0.9)
        if k < 0.76:
            return f"<h{(n := r.randint(2, 4))} data-y=1>{self.words(1, 9)}</h{n}>"
        if k < 0.82:
            t = r.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li data-y=1>{self.sentence(r.random() < 0.5)}</li>" for _ in range(r.randint(1, 6))) + f"</{t}>"
        if k < 0.86:
            return f"<blockquote data-y=1>{self.sentence(True)}</blockquote>" if r.random() < 0.5 else f"<blockquote><p data-y=1>{self.sentence(True)}</p></blockquote>"
        if k < 0.89:
            return f"<pre data-y=1>{self.words(2, 40)}</pre>"
        if k < 0.92:
            return "<table>" + "".join("<tr>" + "".join(f"<td data-y=1>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if k < 0.95:
            return f"<figure><img src=a><figcaption data-y=1>{self.words(2, 15)}</figcaption></figure>"
        return f"<div data-y=1>{self.sentence(True)}</div>"

    def page(self) -> str:
        r = self.r
        main = []
        title = f"<h1 data-y=1>{self.words(1, 12)}</h1>" if r.random() < 0.85 else ""
        if title and r.random() < 0.15:
            title = f"<header>{title}</header>"
        simple = r.random() < 0.4
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 8, 12, 20, 30])):
            main.append((f"<p data-y=1>{self.sentence(True)}</p>" if r.random() < 0.8 else f"<p data-y=1><b>{self.sentence(True)}<br>") if simple else self.main_block())
            if r.random() < 0.04:  # an article may say what other parts say
                main.append(f"<p data-y=1>{r.choice([*_CALLS, self.rights(), 'All rights reserved.', 'Alle Rechte vorbehalten.'])}{r.choice(['', '', ' ' + self.words(1, 12)])}</p>")
            if not simple and r.random() < 0.08:
                main.append(self.boilerplate(r.choice(["ad", "ad", "share", "form", "nav", "sidebar", "notice"])))
        if not simple and r.random() < 0.25:
            main.append(self.boilerplate(r.choice(["share", "comments", "comments", "form", "ad", "footer"])))
        body = title + "".join(main)
        misled = r.random() < 0.05
        names = _MISLEADING if misled else ["content", "article", "post", "entry", "story", "article-body", "post-content", "main-content", "text", "prose"]
        kind = r.random()
        if kind < 0.4:
            body = f"<article{self.attr(names, '' if misled else 'main') * (misled or r.random() < 0.3)}>{body}</article>"
            body = f"<main>{body}</main>" if r.random() < 0.3 else body
        elif kind < 0.55:
            body = f"<main{self.attr(names, '' if misled else 'main') * (misled or r.random() < 0.3)}>{body}</main>"
        elif kind < 0.85:
            body = f"<{(t := r.choice(['div', 'div', 'section']))}{self.attr(names, '' if misled else 'main') if not misled or len(main) > 2 else ''}>{body}</{t}>"
        elif kind < 0.93:
            body = f"<div{self.attr(_WRAPS) * (r.random() < 0.5)}>{body}</div>"
        if r.random() < 0.03:
            body = ""
        before = [self.boilerplate(k) for k in r.sample(["nav", "nav", "header", "ad", "notice", "form", "sidebar"], r.randint(0, 5))]
        after = [self.boilerplate(k) for k in r.sample(["footer", "footer", "sidebar", "comments", "share", "ad", "notice", "form", "nav"], r.randint(0, 6))]
        page = "".join(before) + body + "".join(after)
        if r.random() < 0.08 and body:  # a table for the layout
            menu = r.choice([self.links(2, 8), self.links(2, 8), " ".join(f"<a href=/{k}>{self.words(1, 1)}</a>" for k in range(r.randint(2, 6))), self.boilerplate("sidebar")])
            cells = [f"<td{' width=150' * (r.random() < 0.5)}>{menu}</td>", f"<td>{body}</td>"]
            r.shuffle(cells)
            top, end = (f"<tr><td colspan=2>{part}</td></tr>" for part in (self.words(1, 4) if r.random() < 0.3 else self.boilerplate("nav"), self.rights()))
            page = f"<table>{top * (r.random() < 0.5)}<tr>{''.join(cells)}</tr>{end * (r.random() < 0.7)}</table>"
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            page = f"<div{self.attr(_WRAPS) * (r.random() < 0.8)}>{page}</div>"
        end = "</body></html>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{}}</style><script>a('</p>')</script></head><body>{page}{end}"

    def flat_page(self) -> str:
        """50 to 200 blocks side by side, with a few that are no main text among them."""
        r = self.r
        simple = r.random() < 0.4
        blocks = [f"<p data-y=1>{self.sentence(True)}</p>" if simple else self.main_block() for _ in range(r.randint(50, 200))]
        for _ in range(r.randint(1, 6)):
            blocks.insert(r.randint(0, len(blocks)), self.boilerplate(r.choice(["ad", "share", "form", "nav", "sidebar", "notice", "related"])))
        body = f"<h1 data-y=1>{self.words(1, 12)}</h1>" * (r.random() < 0.85) + "".join(blocks)
        around = r.choice(["", "article", "main", "div"])
        if around:
            return f"<html><body>{self.boilerplate('nav')}<{around}>{body}</{around}>{self.boilerplate('footer')}</body></html>"
        return f"<html><body>{self.boilerplate('nav')}{body}{self.boilerplate('footer')}</body></html>"


def pages(n: int, seed: int) -> Iterator[str]:
    maker = _Maker(random.Random(seed))
    for _ in range(n):
        yield maker.page()


def flat_pages(n: int, seed: int) -> Iterator[str]:
    maker = _Maker(random.Random(seed))
    for _ in range(n):
        yield maker.flat_page()
