"""Main text of web pages by boosted trees over the nodes of the page.

A lenient parser makes a tree of block elements; text that stands beside
blocks becomes a node of its own. Every node gets features of its subtree
(text and link density, punctuation), its tag and attribute words, depth,
siblings and ancestors. Boosted trees give each node the odds that main
text stands in it. Decoding takes the whole tree: the most likely labelling
in which nothing is kept below a dropped node. The trees are fitted on
pages that this module makes up, since no page here is labelled.

Defined cases: null or empty html, and pages without main text, give the
empty text. Raw elements (scripts, styles, templates and the others of ``_RAW``),
elements whose text no browser shows (``_UNSEEN``) and comments never give
text; all else, formulas and buttons included, is left to the trees.
Very long pages are read whole, unclosed elements end with the page.
Repeated rows are extracted each. Empty input gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.boosted_trees import BoostedTrees
from quarry.llm.common import share, slices
from quarry.llm.made_up_pages import flat_pages, pages

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Elements passed up to their closing tags; an annotation is the hidden source of a formula.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "annotation", "annotation-xml"}
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in _RAW}
#: Elements whose text no browser shows: metadata, and what stands in for media that it cannot play or draw.
_UNSEEN = {"head", "audio", "video", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mstyle", "mpadded", "mphantom", "merror", "menclose", "maction", "mfrac", "msqrt", "mroot",
    "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "none", "mtable", "mtr", "mlabeledtr", "mtd",
}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"ul", "ol", "dl", "table", "select"}
_TAGS = [
    {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset"}, {"article"}, {"main"}, {"section"}, {"div"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"},
    {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"table", "tbody", "tr", "td", "th", "thead"}, {"blockquote", "pre", "figure", "figcaption"}, {"#run"}, {"body", "html"},
]
#: Attribute words by kind, matched as prefixes of a class, id or role word. The last kind tells of main text, the others against it.
_WORDS = [
    ("ad", "advert", "ads", "sponsor", "promo", "banner", "dfp", "adslot", "werbung", "anzeige", "publicit", "publicidad", "anuncio", "pubblicit", "reklame"),
    ("nav", "menu", "breadcrumb", "topbar", "toolbar", "toc", "pager", "pagination", "hauptmen", "brotkrumen"),
    ("foot", "bottom", "copyright", "legal", "imprint", "fuss", "impressum", "pied", "piepagina", "rodape", "voettekst"),
    ("side", "aside", "widget", "rail", "complementary", "seitenleiste", "randspalte", "barrelaterale", "lateral", "zijbalk"),
    ("comment", "discuss", "repl", "respon", "feedback", "review", "kommentar", "diskussion", "comentari", "commenti", "reacties", "leserbrief"),
    ("cookie", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "dialog", "hinweis", "avis", "aviso", "melding"),
    ("share", "social", "follow", "related", "recommend", "more", "tag", "popular", "trending", "teilen", "verwandt", "partag", "compartir", "condividi", "delen"),
    ("form", "search", "newsletter", "subscri", "signup", "login", "contact", "suche", "anmeld", "recherche", "buscar", "cerca", "zoek"),
    ("head", "mast", "logo", "brand", "site", "kopf", "entete", "cabecera", "cabecalho", "intestazione", "koptekst"),
    ("content", "article", "post", "entry", "story", "text", "main", "body", "blog", "read", "prose", "inhalt", "beitrag", "artikel", "contenu", "conten", "corps", "cuerpo", "inhoud"),
]
#: Words in a text that tell of rights, and of calls and notices.
_RIGHTS = re.compile(r"\u00a9|\bcopyright\b|rights reserved|rechte vorbehalten|droits r.serv|derechos reservados|diritti riservati", re.I)
_CALLS = re.compile(r"\bcookies?\b|\bnewsletter\b|\bsubscribe\b|\bsign (?:up|in)\b|\blog in\b|\badvertisement\b|\bsponsored\b|\bprivacy policy\b", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_BAD_TAGS = {"nav", "menu", "header", "footer", "aside", "form"}


class Page:
    """Block nodes of a page, parents before children, and its text runs in page order."""

    def __init__(self, source: str):
        self.tags, self.parents, self.depths, self.words, self.marks = ["body"], [-1], [0], [()], [False]
        self.runs: list[list] = []  # [node, pieces, characters within links]
        stack: list[tuple[str, int]] = [("body", 0)]
        links = unseen = 0
        fresh, at, end = True, 0, len(source)

        def add(piece: str) -> None:
            nonlocal fresh
            node = stack[-1][1]
            if fresh or self.runs[-1][0] != node:
                if not piece.strip():
                    return
                self.runs.append([node, [], 0])
                fresh = False
            self.runs[-1][1].append(piece)
            if links:
                self.runs[-1][2] += len(piece.strip())

        while at < end:
            start = source.find("<", at)
            start = end if start < 0 else start
            found = _TOKEN.match(source, start) if start < end else None
            if start > at and not unseen:
                add(html.unescape(source[at:start]))
            if start == end:
                break
            if found is None:
                if source[start + 1 : start + 2].isalpha() or source[start + 1 : start + 2] == "/":
                    close = source.find(">", start)  # a tag with an open quote
                    at = end if close < 0 else close + 1
                    continue
                if not unseen:
                    add("<")
                at = start + 1
                continue
            at = found.end()
            name = found[1]
            if name is None:
                continue
            tag = name.lower()
            if source[start + 1] == "/":
                place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if tag == "p" and not place and not unseen:
                    fresh = True
                if place:
                    for gone, _ in stack[place:]:
                        links -= gone == "a"
                        unseen -= gone in _UNSEEN
                        fresh = fresh or gone not in _INLINE
                    del stack[place:]
                continue
            if tag in _RAW:
                if found[2][-1:] != "/" or tag in ("script", "style"):
                    close = _RAW_ENDS[tag].search(source, at)
                    at = close.start() if close else end
                continue
            if tag in _VOID:
                if tag == "br" and not unseen and not fresh:
                    add(" ")
                fresh = fresh or tag == "hr"
                continue
            if tag in ("html", "body"):
                if tag == "body":
                    for gone, _ in stack[1:]:
                        unseen -= gone in _UNSEEN
                    del stack[1:]
                continue
            if tag in _INLINE:
                if tag == "a" and links:
                    continue
                links += tag == "a"
                stack.append((tag, stack[-1][1]))
                continue
            closes = _ENDS.get(tag)
            for i in range(len(stack) - 1, 0, -1):
                other = stack[i][0]
                if other == "p" or closes and other in closes:
                    for gone, _ in stack[i:]:
                        links -= gone == "a"
                        unseen -= gone in _UNSEEN
                    del stack[i:]
                    if other == "p" and not closes:
                        break
                elif other not in _INLINE and (not closes or other in _STOPS):
                    break
            fresh = True
            unseen += tag in _UNSEEN
            node = len(self.tags)
            words, mark = [], False
            for key, value in _ATTRIBUTE.findall(found[2]):
                if key == "data-y":
                    mark = True
                else:
                    words += _SPLIT.split(html.unescape(value).strip("\"'").lower())
            self.tags.append(tag)
            self.parents.append(stack[-1][1])
            self.depths.append(self.depths[stack[-1][1]] + 1)
            self.words.append(tuple(w for w in words if w))
            self.marks.append(mark)
            stack.append((tag, node))
            if found[2][-1:] == "/" and (tag in _UNSEEN or any(t == "svg" for t, _ in stack)):
                stack.pop()
                unseen -= tag in _UNSEEN
        has_blocks = set(self.parents)
        for run in self.runs:
            run[1] = " ".join("".join(run[1]).split())
            if run[0] in has_blocks:  # text beside blocks
                parent = run[0]
                run[0] = len(self.tags)
                self.tags.append("#run")
                self.parents.append(parent)
                self.depths.append(self.depths[parent] + 1)
                self.words.append(())
                self.marks.append(self.marks[parent])

    def features(self) -> np.ndarray:
        n = len(self.tags)
        own, linked, stops, blocks, first = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -1.0)
        rights, calls = np.zeros(n), np.zeros(n)
        seen = 0
        for node, text, in_links in self.runs:
            own[node] += len(text)
            linked[node] += min(in_links, len(text))
            stops[node] += text.count(".") + text.count(",")
            blocks[node] += 1
            rights[node] += bool(_RIGHTS.search(text)) * len(text)
            calls[node] += bool(_CALLS.search(text)) * len(text)
            first[node] = seen if first[node] < 0 else first[node]
            seen += len(text)
        text, links, marks, runs, nodes, paras, starts = own.copy(), linked.copy(), stops.copy(), blocks.copy(), np.ones(n), np.zeros(n), first.copy()
        children: list[list[int]] = [[] for _ in range(n)]
        order = sorted(range(1, n), key=lambda i: self.depths[i], reverse=True)
        for i in order:
            paras[i] += self.tags[i] == "p"
            p = self.parents[i]
            for whole in (text, links, marks, runs, nodes, paras, rights, calls):
                whole[p] += whole[i]
            if starts[i] >= 0 and (starts[p] < 0 or starts[i] < starts[p]):
                starts[p] = starts[i]
        for i in range(1, n):
            children[self.parents[i]].append(i)
        kinds = np.zeros((n, len(_WORDS)))
        bad, good, above = np.zeros(n), np.zeros(n), np.zeros((n, len(_WORDS)))
        told, inside = np.zeros(n), np.zeros(n)
        # of the telling nodes at and above a node, the least share of the page's text, and whether that one has a title
        told_share, told_title = np.ones(n), np.ones(n)
        titles = np.array([tag == "h1" for tag in self.tags], dtype=float)
        for i in order:
            titles[self.parents[i]] += titles[i]
        rank, peers, same, peer_text = np.zeros(n), np.ones(n), np.ones(n), np.zeros(n)
        total = max(1.0, text[0])
        for i in range(n):
            for w in self.words[i]:
                for k, starts_with in enumerate(_WORDS):
                    if w.startswith(starts_with) and (k or len(w) < 4 or not w.startswith("ad") or w.startswith(("adv", "ads"))):
                        kinds[i, k] = 1
            own_kids = children[i]
            alike = Counter(self.tags[c] for c in own_kids)
            for place, c in enumerate(own_kids):
                rank[c], peers[c] = place / max(1, len(own_kids) - 1), len(own_kids)
                same[c] = alike[self.tags[c]] / len(own_kids)
                peer_text[c] = (text[i] - text[c]) / max(1, len(own_kids) - 1)
        for i in sorted(range(1, n), key=lambda i: self.depths[i]):
            p = self.parents[i]
            bad[i] = bad[p] + (self.tags[p] in _BAD_TAGS)
            good[i] = good[p] + (self.tags[p] in ("article", "main"))
            above[i] = np.maximum(above[p], kinds[p])
            telling = self.tags[i] in _BAD_TAGS or kinds[i, :-1].any()
            told[i] = told[p] + telling
            told_share[i], told_title[i] = told_share[p], told_title[p]
            if telling and text[i] / total <= told_share[p]:
                told_share[i], told_title[i] = text[i] / total, titles[i] > 0
            inside[i] = 0 if telling else 1 if self.tags[i] in ("article", "main") or kinds[i, -1] else inside[p]
        one_hot = np.zeros((n, len(_TAGS)))
        for i, tag in enumerate(self.tags):
            for k, group in enumerate(_TAGS):
                if tag in group:
                    one_hot[i, k] = 1
        logs = np.log1p
        columns = [
            np.array(self.depths), peers, rank, logs(text), logs(own), links / np.maximum(1, text), logs(paras), text / nodes, text / np.maximum(1, runs),
            marks / np.maximum(1, text), text / total, np.where(starts < 0, 1, starts / total), bad, good, told, inside, same, logs(peer_text), logs(runs),
            np.array([text[p] / total if p >= 0 else 1 for p in self.parents]), np.full(n, log1p(total)), rights / np.maximum(1, text), calls / np.maximum(1, text),
            told_share, told_title,
        ]
        return np.column_stack([*columns, one_hot, kinds, above])

    def labels(self) -> np.ndarray:
        y = np.array(self.marks, dtype=float)
        for i in sorted(range(1, len(y)), key=lambda i: self.depths[i], reverse=True):
            y[self.parents[i]] = max(y[self.parents[i]], y[i])
        return y

    def decode(self, margin: np.ndarray) -> list[bool]:
        """The most likely labels without a kept node under a dropped one; the page itself is kept."""
        margin = np.clip(margin, -12, 12)
        keep, drop = -np.log1p(np.exp(-margin)), -np.log1p(np.exp(margin))
        best = keep.copy()
        order = sorted(range(1, len(keep)), key=lambda i: self.depths[i])
        for i in reversed(order):
            p = self.parents[i]
            drop[p] += drop[i]
            best[p] += max(best[i], drop[i])
        kept = [True] * len(keep)
        for i in order:
            kept[i] = bool(kept[self.parents[i]] and best[i] > drop[i])
        return kept

    def text(self, kept: list[bool]) -> str:
        return " ".join(t for node, t, _ in self.runs if t and kept[node])


@lru_cache(maxsize=1)
def model(n_pages: int = 1800, seed: int = 5) -> BoostedTrees:
    made = [Page(source) for source in chain(pages(n_pages, seed), flat_pages(n_pages // 20, seed))]
    x = np.concatenate([p.features() for p in made])
    return BoostedTrees().fit(x, np.concatenate([p.labels() for p in made]))


def main_texts(sources: list[str | None], trees: BoostedTrees) -> list[str]:
    made = [Page(s or "") for s in sources]
    margins = trees.margin(np.concatenate([p.features() for p in made])) if made else np.zeros(0)
    out, at = [], 0
    for page in made:
        n = len(page.tags)
        out.append(page.text(page.decode(margins[at : at + n])))
        at += n
    return out


def extract(pages_table: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of page_id, url, html."""
    shared = share(pages_table, vars(model()))
    kinds = dict(pages_table.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = BoostedTrees()
        vars(trees).update(shared.value)
        for batch in batches:
            for part in slices(batch, 64):
                texts = main_texts(part.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    return pages_table.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars bigint")
