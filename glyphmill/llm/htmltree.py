"""From html to a small tree of elements and text leaves with features, for `htmlextract`."""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from math import log2

BITS = 18

# Element names of the HTML standard, by how a parser treats them.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp".split())
DEAD = frozenset("head template svg math canvas object audio video map select datalist button meter progress".split())
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body caption dd dt html legend li optgroup option tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("table td th caption html".split())
#: a start tag of the key ends an open element of the first names, unless one of the second is nearer
IMPLIED = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th caption", "table"), "thead": ("caption", "table"), "tfoot": ("tbody thead tr td th caption", "table"), "a": ("a", "td th table"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
# Words, in the corpus's languages and others, that page furniture uses about itself; how much each tells is learned.
CUES = frozenset(
    """cookie cookies consent datenschutz privacy privacidad confidentialité gdpr accept akzeptieren aceptar accepter newsletter subscribe abonnieren suscríbete abonnez sign login anmelden register
    comment comments kommentar kommentare commentaire commentaires comentario comentarios reply replies antworten répondre responder share teilen partager compartir tweet follow folgen suivez síguenos related verwandte similaires relacionados
    sponsored gesponsert sponsorisé patrocinado advertisement advert anzeige werbung publicité publicidad ad ads copyright rights reserved vorbehalten réservés reservados impressum menu menü home startseite accueil inicio search suche rechercher buscar
    previous next weiter zurück suivant précédent siguiente anterior tags archive archives categories kategorien contact kontakt contacto terms agb javascript browser popular trending likes votes""".split()
)

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?/][^>]*+>|<[a-zA-Z/!?][^>]*+\Z", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_HINTS = re.compile(r"[A-Z]?[a-zß-ÿ]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"\w+")
_ENDS = re.compile(r"[.!?…。！？][\"'»”)\]]*(?=\s|$)")


@dataclass
class Node:
    tag: str
    parent: int
    hints: list[str] = field(default_factory=list)
    hidden: bool = False
    mark: int | None = None
    words: int = 0
    links: int = 0
    ends: int = 0
    leaves: int = 0
    first: int = -1


@dataclass
class Leaf:
    parent: int
    block: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    words: int = 0
    ends: int = 0
    start: int = 0


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(source):
        out.setdefault(name.lower(), entities.unescape(value.strip("\"'")))
    return out


class Page:
    """nodes: the elements (without plain inline ones), each after its parent; leaves: texts of one element and one block.

    A block is broken by starts and ends of block elements only, so inline elements don't part words. Elements that hold no
    text of a page (scripts, styles, titles, drop-down lists) are left out with all that is in them.
    """

    def __init__(self, source: str):
        self.nodes, self.leaves = [Node("html", -1)], []
        # open elements: (name, node, is a block, in a link); node -1: left out
        self.open: list[tuple[str, int, bool, bool]] = [("html", 0, True, False)]
        self.block, at = 0, 0
        while (m := _TOKEN.search(source, at)) is not None:
            self._text(source[at : m.start()])
            at = m.end()
            name = (m.group(2) or "").lower()
            if not name:
                continue
            if m.group(1):
                self._end(name)
            else:
                self._start(name, m.group(3))
                if name in RAW:
                    end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
                    at = end.start() if end else len(source)
                    if not end:
                        break
        self._text(source[at:])
        self._sum()

    def _start(self, name: str, source: str) -> None:
        if name in ("html", "body") and len(self.open) == 1 and name == "html":
            return
        if self.open[-1][0] == "head" and name not in IN_HEAD:
            self.open.pop()
        if name in ("html", "head") and len(self.open) > 1 or name == "body" and any(e[0] == "body" for e in self.open):
            return
        if name in ENDS_P:
            self._close({"p"}, SCOPE)
        if name in HEADINGS and self.open[-1][0] in HEADINGS:
            self._pop(len(self.open) - 1)
        if name in IMPLIED:
            self._close(*IMPLIED[name])
        if name in BLOCK:
            self.block += 1
        if name in VOID:
            if name == "br":
                self._text(" ")
            return
        node, linked = self.open[-1][1], self.open[-1][3]
        if node >= 0 and (name in DEAD or name in RAW):
            node = -1
        elif node >= 0:
            found = attributes(source) if source and not source.isspace() else {}
            hints = [w.lower() for k in ("class", "id", "role", "itemprop", "aria-label") for w in _HINTS.findall(found.get(k, ""))]
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))
            if name in BLOCK or hints or hidden or "data-main" in found:
                self.nodes.append(Node(name, node, hints, hidden, int(found["data-main"]) if found.get("data-main") in ("0", "1") else None))
                node = len(self.nodes) - 1
        self.open.append((name, node, name in BLOCK, linked or name == "a"))

    def _end(self, name: str) -> None:
        if name in ("html", "body"):
            return
        for i in range(len(self.open) - 1, 0, -1):
            got = self.open[i]
            if got[0] == name or (name in HEADINGS and got[0] in HEADINGS):
                self._pop(i)
                return
            if (got[2] and name not in BLOCK and name not in DEAD) or (got[0] in SCOPE and name not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption")):
                break
        if name in BLOCK:
            self.block += 1

    def _close(self, names: frozenset, until: frozenset) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in names:
                self._pop(i)
                # a row's end can end both a cell and a row
                return self._close(names, until)
            if self.open[i][0] in until or (names == {"a"} and self.open[i][2]):
                return None
        return None

    def _pop(self, to: int) -> None:
        if any(e[2] for e in self.open[to:]):
            self.block += 1
        del self.open[to:]

    def _text(self, source: str) -> None:
        _, node, _, linked = self.open[-1]
        if not source or node < 0:
            return
        if self.open[-1][0] == "head" and not source.isspace():
            self.open.pop()
            node, linked = self.open[-1][1], self.open[-1][3]
        text = entities.unescape(source) if "&" in source else source
        if not self.leaves or self.leaves[-1].block != self.block or self.leaves[-1].parent != node:
            self.leaves.append(Leaf(node, self.block))
        leaf = self.leaves[-1]
        leaf.pieces.append(text)
        if linked:
            leaf.linked += len(text.split())

    def _sum(self) -> None:
        total = 0
        for leaf in self.leaves:
            leaf.text = "".join(leaf.pieces)
            leaf.words, leaf.ends, leaf.start = len(leaf.text.split()), len(_ENDS.findall(leaf.text)), total
            total += leaf.words
        # white space on its own is kept for the words it parts, but is no leaf of the tree
        self.full = [k for k, leaf in enumerate(self.leaves) if leaf.words]
        for k in self.full:
            leaf, node = self.leaves[k], self.nodes[self.leaves[k].parent]
            node.words, node.links, node.ends, node.leaves = node.words + leaf.words, node.links + min(leaf.linked, leaf.words), node.ends + leaf.ends, node.leaves + 1
            node.first = k if node.first < 0 else node.first
        for i in range(len(self.nodes) - 1, 0, -1):
            node, up = self.nodes[i], self.nodes[self.nodes[i].parent]
            up.words, up.links, up.ends, up.leaves = up.words + node.words, up.links + node.links, up.ends + node.ends, up.leaves + node.leaves
            if node.first >= 0 and (up.first < 0 or node.first < up.first):
                up.first = node.first

    def text(self, kept: list[bool]) -> str:
        """Blocks of the kept leaves (kept: by place in `full`), white space as single spaces, joined by newlines."""
        own = dict(zip(self.full, kept, strict=True))
        blocks: dict[int, list[str]] = {}
        for k, leaf in enumerate(self.leaves):
            if own.get(k, True):
                blocks.setdefault(leaf.block, []).append(leaf.text)
        return "\n".join(t for parts in blocks.values() if (t := " ".join("".join(parts).split())))


@lru_cache(1 << 16)
def place(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def size(words: int) -> int:
    return int(2 * log2(words + 1))


def density(part: int, whole: int) -> int:
    return 0 if not part else 1 + int(3.99 * min(part / max(whole, 1), 1))


@lru_cache(1 << 14)
def grams(word: str) -> tuple[str, ...]:
    return tuple(word[i : i + 4] for i in range(len(word) - 3)) if len(word) > 4 else ()


#: Kinds of tree edges, by the lower end.
LEAF, INLINE, PART, ITEM, PARAGRAPH = range(5)
KINDS = 5


def kind(tag: str) -> int:
    if tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
        return ITEM
    if tag in HEADINGS or tag in ("p", "pre", "blockquote", "figcaption", "caption", "address"):
        return PARAGRAPH
    return PART if tag in BLOCK else INLINE


def encode(page: Page) -> tuple[list[int], list[int], list[list[int]]]:
    """parent, kind and feature places of the tree's nodes: elements that hold text, then leaves; parents come first."""
    own = [i for i, n in enumerate(page.nodes) if n.words or i == 0]
    at = {i: k for k, i in enumerate(own)}
    parent, kinds, features = [], [], []
    total = max(page.nodes[0].words, 1)
    for i in own:
        n = page.nodes[i]
        up = page.nodes[n.parent].tag if i else ""
        first = page.leaves[n.first] if n.first >= 0 else None
        link, many = density(n.links, n.words), size(n.words)
        f = [f"t:{n.tag}", f"u:{up}>{n.tag}", f"l:{link}", f"w:{many}", f"lw:{link}:{many // 2}", f"s:{n.tag}:{int(8 * n.words / total)}", f"e:{density(5 * n.ends, n.words)}", f"lt:{n.tag}:{link}", f"m:{size(n.leaves)}"]
        f.append(f"b:{int(5 * (first.start if first else 0) / total)}")
        if n.hidden:
            f.append("hidden")
        hints = set(n.hints)
        f += [f"pk:{n.tag}:{h}" for h in (page.nodes[n.parent].hints if i else ())]
        f += [f"k:{h}" for h in hints] + [f"g:{g}" for h in hints for g in grams(h)]
        if not hints:
            f.append(f"plain:{n.tag}")
        if first and first.words <= 4:
            f += [f"f:{w}" for w in set(_WORD.findall(first.text.lower())) & CUES]
        parent.append(at[n.parent] if i else -1)
        kinds.append(kind(n.tag))
        features.append([place(x) for x in f])
    for k in page.full:
        leaf = page.leaves[k]
        tag = page.nodes[leaf.parent].tag
        link, many = density(leaf.linked, leaf.words), size(leaf.words)
        f = [f"L:{tag}", f"Lw:{many}", f"Ll:{link}:{many // 2}", f"Le:{min(leaf.ends, 3)}:{many // 2}", f"Lt:{tag}:{link}", f"Lb:{int(5 * leaf.start / total)}", f"Ls:{int(4 * leaf.words / total)}"]
        f += [f"Lk:{h}" for h in page.nodes[leaf.parent].hints]
        if leaf.words <= 30:
            f += [f"c:{w}" for w in set(_WORD.findall(leaf.text.lower())) & CUES]
            if "©" in leaf.text:
                f.append("c:©")
        parent.append(at[leaf.parent])
        kinds.append(LEAF)
        features.append([place(x) for x in f])
    return parent, kinds, features


def marks(page: Page) -> list[int]:
    """1 for each node of `encode` that is or holds marked text: text is marked by the nearest element with data-main."""
    own = [i for i, n in enumerate(page.nodes) if n.words or i == 0]
    state: list[int] = []
    for n in page.nodes:
        state.append(n.mark if n.mark is not None else state[n.parent] if n.parent >= 0 else 0)
    return _spread(page, own, [state[page.leaves[k].parent] for k in page.full])


def landmarks(page: Page) -> list[int] | None:
    """Labels of a page that names its parts by elements: text in its only article or main and in no furniture; None if it doesn't."""
    tags = [n.tag for n in page.nodes]
    whole = [i for i, t in enumerate(tags) if t == "article"] or [i for i, t in enumerate(tags) if t == "main"]
    if len(whole) != 1 or not {"nav", "footer", "aside", "header"} & set(tags) or not page.nodes[whole[0]].words:
        return None
    state: list[int] = []
    for i, n in enumerate(page.nodes):
        up = state[n.parent] if n.parent >= 0 else 0
        state.append(1 if i == whole[0] else 0 if n.tag in ("nav", "footer", "aside", "form", "header") or n.hidden else up)
    own = [i for i, n in enumerate(page.nodes) if n.words or i == 0]
    return _spread(page, own, [state[page.leaves[k].parent] for k in page.full])


def _spread(page: Page, own: list[int], leaves: list[int]) -> list[int]:
    holds = [0] * len(page.nodes)
    for k, y in zip(page.full, leaves, strict=True):
        holds[page.leaves[k].parent] |= y
    for i in range(len(page.nodes) - 1, 0, -1):
        holds[page.nodes[i].parent] |= holds[i]
    return [holds[i] for i in own] + leaves
