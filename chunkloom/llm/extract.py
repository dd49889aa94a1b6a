"""HTML extraction: a linear-chain conditional random field over the leaf blocks of the page's tree, decoded by Viterbi.

A tolerant parser splits a page into leaf blocks: text between the tags of block elements, white space folded, references decoded,
with the open ancestors (names and words of class, id and role). Void, inline and unknown tags don't end a block; ``br`` is white
space; contents of script, style, template, noscript, textarea, select, svg and head, and comments, are no text. Unclosed and stray end
tags close or open nothing they shouldn't: ``p``, ``li``, ``td`` and the like close their own kind, an end tag closes up to its
partner if there is one. Each block gets features of its ancestors and of its text (length, punctuation, link density, place,
wording); the field has two states, main text or not, with weights for feature and state and for state after state.

The field is trained, on first use and the same everywhere, by maximum likelihood on ``labelled_pages``: pages written by a seeded generator of
layouts (article, main, div-only and table pages; menus, headers, footers, sidebars, notices, adverts, forms, comments) that knows
each block's label. Words are drawn at random, so the field learns structure and form, not vocabulary.

Null and empty html give an empty text. Whole pages are read, nothing is capped. Repeated rows give repeated results, further columns are
ignored, empty tables give no rows. One map, no shuffle.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chunkloom.llm.shared import rowwise

# element kinds of the HTML standard
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript textarea select svg math iframe object audio video canvas".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
#: An opening tag of these closes an open one of the named kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tr", "td", "th"}}
#: Closing of the kinds above doesn't reach beyond these.
SCOPE = frozenset("ul ol dl menu table body article section main div".split())
_TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_NAME = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("attrs", "link", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], attrs: frozenset[str], link: int):
        self.text, self.path, self.attrs, self.link = text, path, attrs, link


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    held: list[str] = []
    state = {"link": 0, "hidden": 0}

    def flush():
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            attrs = frozenset().union(*(a for _, a in stack)) if stack else frozenset()
            out.append(Block(text, tuple(n for n, _ in stack), attrs, min(state["link"], len(text))))
        held.clear()
        state["link"] = 0

    def pop():
        name, _ = stack.pop()
        if name in HIDDEN:
            state["hidden"] -= 1

    def add(raw: str):
        if raw and not state["hidden"]:
            held.append(raw)
            if any(n == "a" for n, _ in stack):
                state["link"] += len(raw.strip())

    at = 0
    while True:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        m = _TAG.match(page, lt)
        if not m:  # a lone "<" is text
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        at = m.end()
        if not m[2]:
            continue
        name, end = m[2].lower(), bool(m[1])
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            flush()
        if end:
            if any(n == name for n, _ in stack):
                while stack[-1][0] != name:
                    if stack[-1][0] in BLOCKS:
                        flush()
                    pop()
                pop()
            continue
        if name in VOID:
            continue
        if name in BLOCKS and any(n == "p" for n, _ in stack):
            # a block ends an open paragraph and what is open in it, but for phrasing that spans paragraphs
            k = max(i for i, (n, _) in enumerate(stack) if n == "p")
            if not any(n in BLOCKS for n, _ in stack[k + 1 :]):
                while len(stack) > k:
                    pop()
        if name in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[name]:
                    while len(stack) > i:
                        pop()
                    if name not in ("tr", "tbody"):
                        break
                elif stack[i][0] in SCOPE:
                    break
        attrs = frozenset(w for k, a, b, c in _ATTR.findall(m[3]) if k.lower() in ("class", "id", "role") for w in _NAME.findall((a or b or c).lower())) if m[3].strip() else frozenset()
        if m[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        stack.append((name, attrs))
        if name in HIDDEN:
            state["hidden"] += 1
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
            if name == "title" or state["hidden"]:
                at = close.start() if close else len(page)
    flush()
    return out


#: Words in class, id and role, and what they tell of. Features are the kinds, so a new word of a kind needs an entry here only.
WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs pagination pager toc topbar",
    "head": "header masthead banner branding logo toolbar",
    "foot": "footer copyright colophon bottom legal",
    "side": "sidebar aside rail related widget widgets recommended popular trending complementary",
    "notice": "cookie cookies consent gdpr notice popup modal overlay alert subscribe newsletter signup paywall message dialog",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promoted banner",
    "form": "form login search searchbox contact feedback",
    "comment": "comment comments commentlist respond reply replies disqus discussion",
    "share": "share social sharing tags meta byline author date",
    "main": "main content article post entry story body text prose page",
}
_KIND = {w: k for k, ws in WORDS.items() for w in ws.split()}
ANCESTORS = "nav header footer aside form article main section ul ol table button label blockquote figure figcaption li td p a h1 h2 h3 dialog menu details".split()


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the binary features of each block."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        words = b.text.split()
        k, f = len(words), ["bias"]
        names = set(b.path)
        f += [f"in:{a}" for a in ANCESTORS if a in names]
        f += [f"kind:{x}" for x in {_KIND[w] for w in b.attrs if w in _KIND}]
        f.append(f"own:{b.path[-1] if b.path and b.path[-1] in BLOCKS else 'inline'}")
        f.append(f"words:{min(6, k.bit_length())}")
        f.append(f"link:{min(3, 4 * b.link // max(1, len(b.text)))}")
        if b.text[-1] in ".!?:;\"'”»…":
            f.append("ends")
        if any(c in b.text for c in "©|»›"):
            f.append("sign")
        if "," in b.text or ". " in b.text:
            f.append("commas")
        f.append(f"place:{4 * i // n}")
        if not names & {"article", "main", "nav", "header", "footer", "aside", "form"}:
            f.append("bare")
        out.append(f)
    return out


class Field:
    """Two states: 0 other, 1 main text."""

    def __init__(self, names: dict[str, int], w: np.ndarray, trans: np.ndarray):
        self.names, self.w, self.trans = names, w, trans

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest states, by Viterbi."""
        if not blocks:
            return []
        names, w, (t00, t01), (t10, t11) = self.names, self.w, self.trans[0], self.trans[1]
        back, a, b = [], 0.0, 0.0
        for i, f in enumerate(features(blocks)):
            e = sum(w[names[x]] for x in f if x in names)  # the score of state 1 over state 0
            if i:
                from0, from1 = a + t01, b + t11
                to0, to1 = a + t00, b + t10
                back.append((to1 > to0, from1 > from0))
                a, b = max(to0, to1), max(from0, from1) + e
            else:
                b = e
        state, out = int(b > a), []
        out.append(state)
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return out[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], ridge: float = 0.5) -> Field:
    """Maximum likelihood with a ridge, by gradient descent with momentum over padded chains (forward-backward in log space)."""
    feats = [features(b) for b, _ in pages]
    names = {x: i for i, x in enumerate(sorted({x for f in feats for g in f for x in g}))}
    longest, n = max(len(f) for f in feats), len(pages)
    x = np.zeros((n, longest, len(names)), np.float32)
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (f, (_, labels)) in enumerate(zip(feats, pages, strict=True)):
        for j, g in enumerate(f):
            x[i, j, [names[v] for v in g]] = 1
        y[i, : len(f)], mask[i, : len(f)] = labels, True
    flat = x.reshape(-1, len(names))
    w, trans = np.zeros(len(names)), np.zeros((2, 2))
    vw, vt, sw, st = np.zeros_like(w), np.zeros((2, 2)), np.zeros_like(w), np.zeros((2, 2))
    gold_t = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            gold_t[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & mask[:, 1:]).sum()
    for step in range(1, 151):
        e = np.stack([np.zeros((n, longest)), (flat @ w).reshape(n, longest)], -1)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = e[:, 0]
        for j in range(1, longest):
            new = np.logaddexp(alpha[:, j - 1, :1] + trans[0], alpha[:, j - 1, 1:] + trans[1]) + e[:, j]
            alpha[:, j] = np.where(mask[:, j, None], new, alpha[:, j - 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for j in range(longest - 2, -1, -1):
            nxt = e[:, j + 1] + beta[:, j + 1]
            new = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
            beta[:, j] = np.where(mask[:, j + 1, None], new, 0)
        p = np.exp(alpha[..., 1] + beta[..., 1] - z[:, None]) * mask
        gw = flat.T @ (p - y * mask).ravel() + ridge * w
        gt = -gold_t.copy()
        for a in (0, 1):
            for b in (0, 1):
                gt[a, b] += (np.exp(alpha[:, :-1, a] + trans[a, b] + e[:, 1:, b] + beta[:, 1:, b] - z[:, None]) * mask[:, 1:]).sum()
        gt += ridge * trans
        for v, s, g, target in ((vw, sw, gw, w), (vt, st, gt, trans)):
            v *= 0.9
            v += 0.1 * g
            s *= 0.99
            s += 0.01 * g * g
            target -= 0.15 * (v / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Field(names, w, trans)


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(text of a block, 1 for main text)]) of pages in many layouts."""
    r = random.Random(seed)

    def word():
        return "".join(r.choice("abcdefghilmnoprstuvéüñ") for _ in range(r.randint(1, 9)))

    def phrase(a, b):
        return " ".join(word() for _ in range(r.randint(a, b))).capitalize()

    def sentence():
        return phrase(1, 18) + r.choice([".", ".", ".", ",", "!", "?"])

    def prose(most=6):
        return " ".join(sentence() for _ in range(r.randint(1, most))) if r.random() < 0.85 else phrase(1, 3) + "."

    def pick(*kinds):
        return r.choice([w for k in kinds for w in WORDS[k].split()])

    def attr(*kinds):
        return f' {r.choice(["class", "class", "id"])}="{pick(*kinds)}"' if kinds else ""

    out = []
    for _ in range(n):
        parts, said = ["<!DOCTYPE html><html><head><title>x</title><script>a<b</script></head><body>"], []

        def put(tag, text, label, attrs="", close=True, parts=parts, said=said):
            parts.append(f"<{tag}{attrs}>{text}" + (f"</{tag}>" if close else ""))
            said.append((" ".join(re.sub("<[^>]*>", "", text).split()), label))

        def links(k, parts=parts, said=said):
            parts.append("<ul>")
            for _ in range(k):
                put("li", f"<a href='/'>{phrase(1, 3) if r.random() < 0.8 else word()}</a>", 0)
            parts.append("</ul>")

        def boiler(kind):
            tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "comment": "section"}.get(kind, "div")
            plain = r.random() < 0.4
            tag, a = ("div", attr(kind)) if plain or tag in ("div", "section") else (tag, "")
            parts.append(f"<{tag}{a}>")
            if kind in ("menu", "side"):
                links(r.randint(2, 8))
                if kind == "side" and r.random() < 0.6:
                    put("p", prose(2), 0)
            elif kind == "foot":
                if r.random() < 0.5:
                    parts.append(text := f"&copy; {word()}.example &middot; {prose(2)}")
                    said.append((" ".join(entities.unescape(text).split()), 0))
                else:
                    put("p", prose(2), 0)
                    links(r.randint(1, 4))
            elif kind == "form":
                put("label", phrase(1, 3), 0) if False else put("p", phrase(1, 5), 0)
            elif kind == "comment":
                for _ in range(r.randint(1, 5)):
                    put(r.choice(["div", "p", "li"]), prose(4), 0)
            elif kind == "head":
                put(r.choice(["div", "h1", "p"]), phrase(1, 4), 0)
            else:
                if r.random() < 0.5:
                    parts.append(text := prose(2))
                    said.append((text, 0))
                else:
                    put("p", prose(2), 0)
            parts.append(f"</{tag}>")

        for kind in ("head", "menu", "notice", "advert"):
            if r.random() < 0.5:
                boiler(kind)
        wrap = r.choice(["article", "article", "main", "div", "section", "main><article"])
        marks = attr("main") if wrap in ("div", "section") or r.random() < 0.3 else ""
        for w in wrap.split(">"):
            parts.append(f"<{w.strip('<')}{marks}>")
        if r.random() < 0.8:
            put("h1", phrase(1, 10) + r.choice(["", "."]), 1)
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.06:
                put("h2", phrase(1, 6), 1)
            elif x < 0.10:
                parts.append("<ul>")
                for _ in range(r.randint(1, 4)):
                    put("li", prose(1), 1)
                parts.append("</ul>")
            elif x < 0.13:
                put("blockquote", prose(3), 1)
            elif x < 0.17:
                boiler(r.choice(["advert", "notice", "share", "side", "form"]))
            elif x < 0.25:
                put("p", "<b>" + prose(3) + "<br>", 1, close=False)
            elif x < 0.27:
                put("pre", prose(2), 1)
            else:
                put("p", prose() if r.random() < 0.9 else prose(2) + f" <a href='/'>{phrase(1, 4)}</a> " + prose(1), 1)
        if r.random() < 0.15:
            boiler("comment")
        for w in reversed(wrap.split(">")):
            parts.append(f"</{w.strip('<')}>")
        for kind in ("comment", "side", "advert", "form", "foot"):
            if r.random() < 0.5:
                boiler(kind)
        out.append(("".join(parts) + ("</body></html>" if r.random() < 0.8 else ""), said))
    return out


def blocks_with_labels(page: str, said: list[tuple[str, int]]) -> tuple[list[Block], list[int]]:
    """The parser's blocks with the generator's labels, matched by text in order."""
    blocks, labels, at = leaf_blocks(page), [], 0
    for b in blocks:
        found = next((i for i in range(at, len(said)) if said[i][0] == b.text), None)
        labels.append(said[found][1] if found is not None else 0)
        at = at if found is None else found + 1
    return blocks, labels


@cache
def field() -> Field:
    """The trained field: the same in every process, as the pages and the training are."""
    return fit([blocks_with_labels(*p) for p in labelled_pages()])


def main_text(page: str | None, model: Field | None = None) -> str:
    """The article's blocks, joined by an empty line."""
    blocks = leaf_blocks(page or "")
    return "\n\n".join(b.text for b, s in zip(blocks, (model or field()).decode(blocks), strict=True) if s)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html)."""
    held = pages.sparkSession.sparkContext.broadcast(field())

    def work(columns: list[list]) -> list[list]:
        texts = [main_text(h, held.value) for h in columns[2]]
        return [columns[0], columns[1], texts, [len(t) for t in texts]]

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    return rowwise(pages, ["page_id", "url", "html"], schema, work, "page_id long, url string, text string, n_chars long")
