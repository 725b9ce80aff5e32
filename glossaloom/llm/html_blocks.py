"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between the boundaries of block elements, with character
references decoded and white space turned into single spaces. Scripts, styles, comments and markup are never text. Each
block has a vector of hashed tags, classes and ids on its path and one of hashed words, besides a few measures. A
bidirectional LSTM in numpy reads the whole sequence, so that every block is judged in the page's context, and labels it
as article or not. Pages of made-up layouts (`made_page`) with known labels train it, among them many whose containers
have no names or invented ones. No corpus is needed, so the model is the same for every table; its weights (about
120 kB) may be broadcast. They lie beside this module and are made again by running it; without the file a task trains them.

Blocks of probability 0.5 and more make the text; a page without such blocks has none.

Reading is linear in the page: elements are nodes that know their parent and the vector of their path, tags end at the
next > when quotes don't, and what can be closed is counted instead of sought.

Cases: null and empty html have no text; a page without article blocks gives an empty text; malformed declarations are
stepped over, a tag that the page ends in is dropped; blocks of any number and length are kept whole; repeated rows and null ids give rows of their own; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import io
import pickle
import random
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaloom.llm.common import open_fs, shared_dir, slices, table

# HTML elements by what they do to blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math object iframe".split())
RAW, ESCAPABLE = frozenset(("script", "style")), frozenset(("title", "textarea"))
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table select body html".split())

PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 64, 32, 8, 24
SIZE = PATH_DIM + WORD_DIM + MEASURES
#: Blocks that run through the network at once.
AT_ONCE = 16_384
_NAME = re.compile(r"[^a-z0-9]+")


# A quote opens a value only after =; in the loose form a tag ends at the next >.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
NAMED = re.compile(r"\b(?:class|id|role)\b", re.I)


class Node:
    """A block element's place: its parent and its names. Equal children of a node are one node."""

    __slots__ = ("parent", "names", "children", "counts", "vector")

    def __init__(self, parent: "Node | None", names: tuple):
        self.parent, self.names, self.children, self.counts, self.vector = parent, names, {}, None, None


class _Root:
    """The tree of all places that the process has seen; begun anew when it is large."""

    MOST = 50_000

    def __init__(self):
        self.top, self.size = Node(None, ()), 0

    def child(self, parent: Node, names: tuple) -> Node:
        node = parent.children.get(names)
        if node is None:
            node = Node(parent, names)
            if self.size < self.MOST:
                parent.children[names] = node
                self.size += 1
        return node

    def renewed(self) -> Node:
        if self.size >= self.MOST:
            self.__init__()
        return self.top


_ROOT = _Root()


class Blocks:
    """Collects (node, text, characters inside links) of the leaf blocks.

    stack: (tag, node) of the open elements; at: where the block elements are in it; inlines: for each of these (and the
    page) how often inline elements are open right in it; scopes: for each open list, table or so how often elements
    that end each other are open in it.
    """

    def __init__(self):
        self.blocks: list[tuple[Node, str, int]] = []
        self.top = _ROOT.renewed()
        self.stack: list[tuple[str, Node]] = []
        self.at: list[int] = []
        self.inlines, self.scopes, self.open = [Counter()], [Counter()], Counter()
        self.text: list[str] = []
        self.silent = self.links = self.link_chars = 0
        self.node: Node | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split()) if self.text else ""
        if text:
            self.blocks.append((self.node or self.top, text, min(self.link_chars, len(text))))
        self.text, self.link_chars, self.node = [], 0, None

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, _ = self.stack.pop()
            self.open[tag] -= 1
            if tag in INLINE:
                self.inlines[-1][tag] -= 1
                self.links -= tag == "a"
                continue
            self.inlines.pop()
            self.at.pop()
            self.silent -= tag in SILENT
            if tag in SCOPES:
                self.scopes.pop()
            elif tag in SIBLINGS:
                self.scopes[-1][tag] -= 1

    def start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            if tag in ENDS_P and self.at and self.stack[self.at[-1]][0] == "p":
                self.pop_to(self.at[-1])
            ends = SIBLINGS.get(tag)
            if ends and any(self.scopes[-1][t] > 0 for t in ends):
                k = len(self.stack) - 1
                while self.stack[k][0] not in ends:
                    k -= 1
                self.pop_to(k)
        if tag in VOID:
            return
        node = self.stack[-1][1] if self.stack else self.top
        if tag not in INLINE:
            names = [tag]
            if NAMED.search(attrs):
                for key, *values in ATTRIBUTE.findall(attrs):
                    if key.lower() in ("class", "id", "role"):
                        names += ["." + n for n in _NAME.split(entities.unescape("".join(values)).lower()) if n]
            node = _ROOT.child(node, tuple(names))
        self.stack.append((tag, node))
        self.open[tag] += 1
        if tag in INLINE:
            self.inlines[-1][tag] += 1
            self.links += tag == "a"
            return
        self.at.append(len(self.stack) - 1)
        self.inlines.append(Counter())
        self.silent += tag in SILENT
        if tag in SCOPES:
            self.scopes.append(Counter())
        elif tag in SIBLINGS:
            self.scopes[-1][tag] += 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in INLINE:
            self.flush()
        if self.open[tag] <= 0 or tag in INLINE and self.inlines[-1][tag] <= 0:
            return
        k = len(self.stack) - 1
        while self.stack[k][0] != tag:
            k -= 1
        self.pop_to(k)

    def data(self, data: str) -> None:
        if self.silent or not data:
            return
        if "&" in data:
            data = entities.unescape(data)
        if self.node is None and not data.isspace():
            self.node = self.stack[-1][1] if self.stack else self.top
        self.text.append(data)
        if self.links:
            self.link_chars += len(data)

    def read(self, html: str) -> None:
        at, tags, comments, escapable = 0, TAG, True, set(ESCAPABLE)
        while True:
            lt = html.find("<", at)
            self.data(html[at : lt if lt >= 0 else len(html)])
            if lt < 0:
                return
            at = lt + 1
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2) if comments else -1
                comments = end >= 0  # without an end, this and all later ones end at the next >
                at = end + 3 if comments else html.find(">", lt) + 1
                if not at:
                    return
                continue
            sign = html[at : at + 1]
            if sign in ("!", "?") or sign == "/" and not html[at + 1 : at + 2].isalpha():
                end = html.find(">", at)
                at = end + 1 if end >= 0 else at
                continue
            m = tags.match(html, lt)
            if m is None and (sign == "/" or sign.isascii() and sign.isalpha()):
                if html.find(">", lt) < 0:
                    return
                tags = LOOSE_TAG
                m = tags.match(html, lt)
            if m is None:
                self.data("<")
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, m[3])
            if tag in RAW:
                close = re.compile(f"</{tag}", re.I).search(html, at)
                if close is None:
                    return
                at = close.start()
            elif tag in escapable:
                close = re.compile(f"</{tag}|</?(?:head|body|p|div)\\b", re.I).search(html, at)
                if close is None:
                    escapable.discard(tag)
                else:
                    self.data(html[at : close.start()])
                    at = close.start()
            elif m[3].endswith("/") and tag not in VOID:
                self.end(tag)


def leaf_blocks(html: str | None) -> list[tuple[Node, str, int]]:
    parser = Blocks()
    parser.read(html or "")
    parser.flush()
    return parser.blocks


class _Buckets(dict):
    """Hash bucket by word."""

    def __missing__(self, word: str) -> int:
        bucket = zlib.crc32(word.encode("utf-8", "replace")) % WORD_DIM
        if len(self) < 200_000:
            self[word] = bucket
        return bucket


_BUCKETS = _Buckets()


def path_vector(node: Node) -> np.ndarray:
    """Hashed names of the whole path, and of the two innermost elements by their depth."""
    if node.vector is None:
        chain_, up = [], node
        while up is not None and up.counts is None:
            chain_.append(up)
            up = up.parent
        counts = up.counts if up is not None else np.zeros(PATH_DIM // 2, np.float32)
        for own in reversed(chain_):
            counts = counts.copy()
            for n in own.names:
                counts[zlib.crc32(n.encode("utf-8", "replace")) % (PATH_DIM // 2)] += 1.0
            own.counts = counts
        got = np.zeros(PATH_DIM, np.float32)
        got[: PATH_DIM // 2] = counts
        for depth, own in enumerate((node, node.parent)):
            for n in own.names if own is not None else ():
                got[PATH_DIM // 2 + zlib.crc32(f"{depth} {n}".encode("utf-8", "replace")) % (PATH_DIM // 2)] += 1.0
        node.vector = np.tanh(got)
    return node.vector


def vectors(blocks: list[tuple[Node, str, int]]) -> np.ndarray:
    """SIZE inputs for each block."""
    n_blocks = len(blocks)
    words = [text.lower().split(" ") for _, text, _ in blocks]
    sizes = np.array([len(w) for w in words])
    buckets = np.fromiter(map(_BUCKETS.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    counts = np.bincount(np.repeat(np.arange(n_blocks) * WORD_DIM, sizes) + buckets, minlength=n_blocks * WORD_DIM).reshape(n_blocks, WORD_DIM)
    chars = np.array([len(text) for _, text, _ in blocks])
    k = np.arange(n_blocks)
    x = np.empty((n_blocks, SIZE), np.float32)
    x[:, :PATH_DIM] = [path_vector(node) for node, _, _ in blocks]
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] = counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    x[:, -8] = np.log1p(sizes) / 4
    x[:, -7] = np.array([links for _, _, links in blocks]) / chars
    x[:, -6] = 10 * np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") for _, t, _ in blocks]) / chars
    x[:, -5] = chars / sizes / 10
    x[:, -4] = k / n_blocks
    x[:, -3] = n_blocks / (n_blocks + 30)
    x[:, -2] = [t[-1] in ".!?:\"”»" for _, t, _ in blocks]
    x[:, -1] = ["©" in t or "|" in t for _, t, _ in blocks]
    return x


# The network: weights by name; one LSTM per direction, then a logistic output on both states.


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in "fb":
        w["x" + d] = (rng.standard_normal((SIZE, 4 * HIDDEN)) / np.sqrt(SIZE)).astype(np.float32)
        w["h" + d] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        w["c" + d] = np.zeros(4 * HIDDEN, np.float32)
        w["c" + d][HIDDEN : 2 * HIDDEN] = 1.0  # forget little at first
    w["o"] = (rng.standard_normal((2 * HIDDEN, 1)) / np.sqrt(HIDDEN)).astype(np.float32)
    w["p"] = np.zeros(1, np.float32)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


def lstm(x: np.ndarray, w: dict, d: str, keep: list | None = None) -> np.ndarray:
    """States (pages, steps, HIDDEN) of one direction over x (pages, steps, SIZE); keep gets what training needs."""
    n, steps, _ = x.shape
    z_in = x @ w["x" + d] + w["c" + d]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out = np.empty((n, steps, HIDDEN), np.float32)
    for t in range(steps):
        z = z_in[:, t] + h @ w["h" + d]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, h_before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, t] = h
        if keep is not None:
            keep.append((h_before, before, i, f, o, g, tc))
    return out


def _reversed(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse, its padding left at the end."""
    steps = np.arange(x.shape[1])
    at = np.where(steps[None, :] < lengths[:, None], lengths[:, None] - 1 - steps[None, :], steps[None, :])
    return np.take_along_axis(x, at[:, :, None], axis=1)


def label(x: np.ndarray, lengths: np.ndarray, w: dict) -> np.ndarray:
    """Probability of being article text for each block of padded pages."""
    both = np.concatenate([lstm(x, w, "f"), _reversed(lstm(_reversed(x, lengths), w, "b"), lengths)], axis=2)
    return _sigmoid((both @ w["o"])[:, :, 0] + w["p"])


def _back(x: np.ndarray, dh_out: np.ndarray, keep: list, w: dict, d: str, grad: dict) -> None:
    n, steps, _ = x.shape
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dz_all = np.empty((n, steps, 4 * HIDDEN), np.float32)
    gh = np.zeros_like(w["h" + d])
    for t in reversed(range(steps)):
        h_before, before, i, f, o, g, tc = keep[t]
        dh = dh + dh_out[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        gh += h_before.T @ dz
        dh, dc = dz @ w["h" + d].T, dc * f
        dz_all[:, t] = dz
    grad["x" + d] = np.tensordot(x, dz_all, ([0, 1], [0, 1]))
    grad["h" + d], grad["c" + d] = gh, dz_all.sum(axis=(0, 1))


def gradients(x: np.ndarray, lengths: np.ndarray, y: np.ndarray, w: dict) -> tuple[float, dict]:
    """Mean cross-entropy over the blocks and its gradients."""
    kf: list = []
    kb: list = []
    xr = _reversed(x, lengths)
    both = np.concatenate([lstm(x, w, "f", kf), _reversed(lstm(xr, w, "b", kb), lengths)], axis=2)
    p = _sigmoid((both @ w["o"])[:, :, 0] + w["p"])
    mask = np.arange(x.shape[1])[None, :] < lengths[:, None]
    loss = -(np.log(np.where(y > 0, p, 1 - p) + 1e-7) * mask).sum() / mask.sum()
    dz = ((p - y) * mask / mask.sum()).astype(np.float32)
    grad = {"o": np.tensordot(both, dz, ([0, 1], [0, 1]))[:, None], "p": np.array([dz.sum()], np.float32)}
    d_both = dz[:, :, None] * w["o"][:, 0]
    _back(x, d_both[:, :, :HIDDEN], kf, w, "f", grad)
    _back(xr, _reversed(np.ascontiguousarray(d_both[:, :, HIDDEN:]), lengths), kb, w, "b", grad)
    return float(loss), grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), lengths.max(), SIZE), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)] = p
    return x, lengths


# Made-up pages, to train on.

_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve que ción mente sch ein ung ge lich pf eau aux tre oi ê ä ö ü ñ".split()
_PLACES = {  # fixed values: how pages name what isn't the article
    "menu": (["nav", "div.menu", "ul.nav", "div.navbar", "div#menu", "div.breadcrumbs"], "list"),
    "header": (["header", "div.header", "div#masthead", "div.site-header", "div.topbar"], "lines"),
    "sidebar": (["aside", "div.sidebar", "div#sidebar", "div.widget", "section.related"], "mixed"),
    "notice": (["div.notice", "div.cookie-banner", "div.alert", "div#consent", "section.newsletter"], "lines"),
    "advert": (["div.ad", "div.ads", "div.advert", "aside.sponsored", "div.promo", "div#banner"], "prose"),
    "form": (["form", "form.search", "form#subscribe", "div.login"], "form"),
    "comments": (["section.comments", "div#comments", "ol.comment-list", "div.responses"], "prose"),
    "share": (["div.share", "ul.social", "div.tags", "div.pagination"], "list"),
    "footer": (["footer", "div.footer", "div#footer", "footer.site"], "lines"),
}
_ARTICLES = ["article", "article", "article", "main", "div.content", "div#content", "div.post", "div.entry-content", "section.article-body", "main.article"]


def made_page(rng: random.Random) -> tuple[str, list[int]]:
    """An invented page and the labels of its blocks."""
    html: list[str] = []
    labels: list[int] = []

    # half of the pages have a vocabulary of their own, so that single words tell nothing
    own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéäñ", k=rng.choice((2, 3, 4, 5, 7, 9)))) for _ in range(rng.choice((15, 60, 300)))] if rng.random() < 0.5 else []

    def words(n: int) -> str:
        some = rng.choices(own, k=n) if own else ["".join(rng.choices(_SYLLABLES, k=rng.choice((1, 1, 2, 2, 3)))) for _ in range(n)]
        for k in range(0, n, rng.choice((rng.randint(4, 14), rng.randint(8, 30)))):
            some[k] = some[k].capitalize()
            some[k - 1] += rng.choice((".", ".", ",", ""))
        return " ".join(some)

    def tag(name: str) -> tuple[str, str]:
        at = re.match(r"(\w+)(?:([.#])(.+))?$", name)
        mark = {".": f' class="{at[3]}"', "#": f' id="{at[3]}"', None: ""}[at[2]]
        return f"<{at[1]}{mark}>", f"</{at[1]}>"

    bare = rng.random() < 0.12  # no article
    plain = not bare and rng.random() < 0.5  # containers without names, or with invented ones
    grid = plain and rng.random() < 0.4  # the page is a table

    def anonymous() -> tuple[str, str]:
        if grid:
            return "<td>", "</td>"
        part = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8)))
        name = rng.choice("-_ ").join(part() for _ in range(rng.choice((1, 1, 2, 3))))
        return tag(rng.choice(("div", "div", f"div.{name}", f"div.{name}", f"div#{name}", f"section.{name}", "section")))

    def block(open_: str, text: str, close: str, y: int) -> None:
        if rng.random() < 0.1:
            text = f"<b>{text}</b>" if rng.random() < 0.5 else f"<b>{text}<br>"
        html.append(open_ + text + (close if rng.random() < 0.97 else ""))
        labels.append(y)

    def place(kind: str) -> None:
        names, style = _PLACES[kind]
        open_, close = tag(rng.choice(names))
        if style == "mixed":
            style = rng.choice(("list", "prose", "lines"))
        if plain and style == "prose":
            return  # nothing would tell it from the article
        if plain:
            open_, close = anonymous()
        html.append(open_)
        if style == "list" or open_.startswith(("<ul", "<ol")):
            inner = open_.startswith(("<ul", "<ol"))
            html.append("" if inner else "<ul>")
            for _ in range(rng.randint(2, 8)):
                block("<li>", f'<a href="/x">{words(rng.randint(1, 3))}</a>' if style == "list" else words(rng.randint(3, 40)), "</li>", 0)
            html.append("" if inner else "</ul>")
        elif style == "form":
            for _ in range(rng.randint(1, 4)):
                block(*rng.choice((("<p><label>", words(2), "</label></p>"), ("<button>", words(1), "</button>"), ("<option>", words(2), "</option>"), ("<div>", words(4), "</div>"))), 0)
        elif style == "lines" or rng.random() < 0.3:
            if rng.random() < 0.6:
                html.append(words(rng.randint(1, 16)) if kind != "footer" else f"&copy; {words(1)}.example.com &middot; {words(rng.randint(2, 14))}")
                labels.append(0)
            for _ in range(rng.randint(0, 2)):
                block("<p>", words(rng.randint(2, 20)), "</p>", 0)
        if style == "prose":
            for _ in range(rng.randint(1, 4) if kind == "comments" else 1):
                block(*rng.choice((("<p>", "</p>"), ("<div>", "</div>"), ("<li>", "</li>"))[: 1 if kind != "comments" else 3])[:1], words(rng.randint(4, 50)), "</p>" if kind != "comments" else "", 0)
        html.append(close)

    def figures() -> None:
        """A table, list or listing of the article."""
        kind, size = rng.choice(("table", "table", "dl", "list", "list", "code")), rng.randint(2, 7)
        if kind == "table":
            columns, cell = rng.randint(2, 4), rng.choice(("td", "td", "th"))
            html.append("<table>" + rng.choice(("", "<tbody>")))
            for row in range(size):
                html.append("<tr>")
                for _ in range(columns):
                    name = cell if row == 0 else "td"
                    block(f"<{name}>", rng.choice((str(rng.randint(0, 5000)), words(rng.randint(1, 3)), words(rng.randint(1, 9)))), f"</{name}>", 1)
                html.append("</tr>")
            html.append("</table>")
        elif kind == "dl":
            html.append("<dl>")
            for _ in range(size):
                block("<dt>", words(rng.randint(1, 4)), "</dt>", 1)
                block("<dd>", words(rng.randint(3, 30)), "</dd>", 1)
            html.append("</dl>")
        elif kind == "list":
            name = rng.choice(("ul", "ol"))
            html.append(f"<{name}>")
            for _ in range(rng.randint(2, 14)):
                block("<li>", words(rng.randint(1, 25)), "</li>", 1)
            html.append(f"</{name}>")
        else:
            lines = (f"{words(1)} = {words(1)}({rng.randint(0, 99)});" for _ in range(size))
            block(*rng.choice((("<pre>", "\n".join(lines), "</pre>"), ("<pre><code>", "\n".join(lines), "</code></pre>"))), 1)

    def maybe(kinds: str, p: float) -> None:
        for kind in kinds.split():
            if rng.random() < p:
                place(kind)

    html.append("<!DOCTYPE html><html><head>")
    title = words(rng.randint(3, 12))
    if rng.random() < 0.75:
        html.append(f"<title>{title}</title>")
        labels.append(0)
    html.append("<style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
    shell = "<table><tr>" if grid else rng.choice(("", "", '<div class="wrapper">', '<div id="page">', "<div>"))
    html.append(shell)
    maybe("notice header menu advert", 0.5)
    maybe("menu form", 0.3)
    if bare:
        for kind in rng.sample(sorted(_PLACES), rng.randint(1, 4)):
            place(kind)
        html.append("</div>" if shell else "")
        maybe("footer", 0.9)
        return "".join(html) + "</body></html>", labels
    outer = "" if grid or rng.random() < 0.7 else tag(rng.choice(("main", "main", "div.row", "div.layout", "section")))[0]
    html.append(outer)
    if outer and rng.random() < 0.5:
        place(rng.choice(("header", "menu")) if not plain else "menu")
    open_, close = anonymous() if plain or rng.random() < (0.6 if outer else 0.35) else tag(rng.choice(_ARTICLES))
    if plain and not grid and rng.random() < 0.3:
        open_ = close = ""  # right in the page
    inner = rng.choice(("p", "p", "div")) if plain else "p"
    html.append(open_)
    if rng.random() < 0.75:
        inside = rng.random() < 0.15
        block("<header><h1>" if inside else "<h1>", title, "</h1></header>" if inside else "</h1>", 1)
    table_like = rng.random() < 0.25
    rich = rng.random() < 0.35
    for _ in range(rng.randint(1, 16)):
        if rich and not grid and rng.random() < 0.25:
            figures()
        n = rng.choice((rng.randint(1, 8), rng.randint(5, 60), rng.randint(40, 200)))
        text = words(n)
        if table_like:
            text = " | ".join(text.split(" "))
        if rng.random() < 0.1:
            text = text.upper().replace(" ", "!! ")
        if rng.random() < 0.1:
            text = text.replace(" ", " &amp; ", 2)
        if rng.random() < 0.08:
            text += f' <a href="/y">{words(2)}</a>'
        block(*rng.choice(((f"<{inner}>", text, f"</{inner}>"),) * 9 + (("<h2>", words(5), "</h2>"), ("<blockquote>", text, "</blockquote>"), ("<ul><li>", text, "</li></ul>"), ("<div>", text, "</div>"))), 1)
        if rng.random() < 0.06 and not plain:
            place(rng.choice(("advert", "sidebar", "share", "notice")))
    html.append(close + (re.sub(r"<(\w+).*", r"</\1>", outer) if outer else ""))
    maybe("share comments form sidebar advert", 0.3)
    html.append("</tr></table>" if grid else "</div>" if shell else "")
    maybe("footer", 0.9)
    return "".join(html) + ("</body></html>" if rng.random() < 0.9 else ""), labels


def train(pages: int = 8000, epochs: int = 5, batch: int = 32, seed: int = 8) -> dict[str, np.ndarray]:
    """Weights after Adam over made-up pages."""
    rng = random.Random(seed)
    data = []
    for _ in range(pages):
        html, y = made_page(rng)
        blocks = leaf_blocks(html)
        if blocks and len(blocks) == len(y):
            data.append((vectors(blocks), np.array(y, np.float32)))
    w = new_weights(np.random.default_rng(seed))
    mean, var, step = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2)), None, 0
    mean, var = mean
    for epoch in range(epochs):
        data.sort(key=lambda d: (len(d[1]) // 8, rng.random()))
        groups = [data[k : k + batch] for k in range(0, len(data), batch)]
        rng.shuffle(groups)
        for group in groups:
            x, lengths = padded([d[0] for d in group])
            y = np.zeros(x.shape[:2], np.float32)
            for k, (_, labels) in enumerate(group):
                y[k, : len(labels)] = labels
            _, grad = gradients(x, lengths, y, w)
            step += 1
            rate = 0.01 * 0.5**epoch
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.999 * var[k] + 0.001 * g * g
                w[k] = (w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


_TRAINED: list[dict] = []
#: Part of the weights' file name; changes with made_page, vectors or train.
VERSION = 3
#: Made by `python -m glossaloom.llm.html_blocks`.
SHIPPED = Path(__file__).with_name(f"block_labeller_v{VERSION}.npz")


def trained(spark: SparkSession) -> dict[str, np.ndarray]:
    """The weights: of this process, else the file beside this module (what train() gives for this version), else from the shared folder, or trained in a task (executors run numpy with one thread, which small matrices need) and kept there."""
    if _TRAINED:
        return _TRAINED[0]
    if SHIPPED.is_file():
        _TRAINED.append(dict(np.load(SHIPPED)))
        return _TRAINED[0]
    fs, folder = open_fs(shared_dir(spark))
    path = f"{folder}/block_labeller_v{VERSION}.npz"
    if not fs.get_file_info(path).is_file:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            list(batches)
            yield pa.RecordBatch.from_pydict({"weights": [pickle.dumps(train())]})

        weights = spark.range(0, 1, 1, 1).mapInArrow(run, "weights binary").first()["weights"]
        fs.create_dir(folder, recursive=True)
        held, mine = io.BytesIO(), f"{path}.{uuid.uuid4().hex}"
        np.savez(held, **pickle.loads(weights))
        with fs.open_output_stream(mine) as out:
            out.write(held.getvalue())
        fs.move(mine, path)
    with fs.open_input_file(path) as f:
        _TRAINED.append(dict(np.load(io.BytesIO(f.read()))))
    return _TRAINED[0]


def main_texts(htmls: list[str | None], w: dict) -> list[str]:
    """The article text of each page."""
    pages = [leaf_blocks(h) for h in htmls]
    texts = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order:
        n = max(1, sum(1 for m, k in enumerate(order, 1) if m * len(pages[k]) <= AT_ONCE))
        group, order = order[:n], order[n:]
        x, lengths = padded([vectors(pages[k]) for k in group])
        for k, p in zip(group, label(x, lengths, w)):
            texts[k] = " ".join(b[1] for b, q in zip(pages[k], p) if q >= 0.5)
    return texts


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(trained(pages.sparkSession))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", size=2_000_000):
                texts = main_texts(part.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], schema=schema)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(rows, "page_id long, url string, text string")


def op7_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op7_block_labeller": op7_block_labeller}
ORACLES: dict[str, str] = {}


if __name__ == "__main__":
    np.savez_compressed(SHIPPED, **train())
