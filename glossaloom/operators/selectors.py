"""CSS selector lists, compiled to one table that a page's tree is matched with in a single pass.

A selector is a chain of compounds; each place in a chain is a bit. A node's mask has the bits of the places that end at
it: its compound holds, and the place before is in the mask that the combinator names: of an ancestor, the parent, the
element before or any element before. These masks come down the tree with the open elements, so a page of n elements
costs n steps, however deep it is. Compounds are found by the id, class or tag that they ask for.

Understood: tag, *, #id, .class, [a], [!a], [a=v], [a!=v], [a^=v], [a$=v], [a*=v], [a|=v], [a~=v] with or without quotes,
descendants, >, +, ~ and lists. [a!=v] holds where a is absent as well. Tags and attribute names have no case. Anything
else raises ValueError when the list is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaloom.functions import predicates as P
from glossaloom.operators.html import Node, _rows, parse

_PART = re.compile(r"""\s*(?P<comma>,)\s*|\s*(?P<to>[>+~])\s*|(?P<space>\s+)|(?P<any>\*)|\#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|(?P<tag>[a-zA-Z][\w-]*)|\[\s*(?P<no>!?)(?P<attr>[\w:-]+)\s*(?:(?P<op>[!^$*|~]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<a>[^']*)'|(?P<v>[^\]\s]*))\s*)?\]""")
_TESTS = {
    "=": lambda x, v: x == v,
    "!=": lambda x, v: x != v,
    "^=": lambda x, v: bool(v) and x is not None and x.startswith(v),
    "$=": lambda x, v: bool(v) and x is not None and x.endswith(v),
    "*=": lambda x, v: bool(v) and x is not None and v in x,
    "|=": lambda x, v: x is not None and (x == v or x.startswith(v + "-")),
    "~=": lambda x, v: x is not None and v in x.split(),
}


class _Compound:
    __slots__ = ("tag", "id", "classes", "tests")

    def __init__(self):
        self.tag, self.id, self.classes, self.tests = None, None, [], []

    def holds(self, n: Node, classes: set[str]) -> bool:
        return (self.tag is None or n.tag == self.tag) and (self.id is None or n.attrs.get("id") == self.id) and classes.issuperset(self.classes) and all(t(n.attrs.get(a)) for a, t in self.tests)


def _chains(selectors: str) -> Iterator[list[tuple[str, _Compound]]]:
    """The chains of a list: (combinator before, compound)."""
    chain: list[tuple[str, _Compound]] = []
    link, now, pos, text = "", None, 0, selectors.strip()
    while pos < len(text):
        m = _PART.match(text, pos)
        if not m or m.end() == pos:
            raise ValueError(f"not understood in a selector: {text[pos:]!r}")
        pos = m.end()
        if m["comma"] or m["to"] or m["space"]:
            if now is None:
                raise ValueError(f"a selector lacks a part: {selectors!r}")
            chain.append((link, now))
            link, now = (m["to"] or " "), None
            if m["comma"]:
                yield chain
                chain, link = [], ""
            continue
        if now is None:
            now = _Compound()
        if m["id"]:
            now.id = m["id"]
        elif m["class"]:
            now.classes.append(m["class"])
        elif m["tag"]:
            now.tag = m["tag"].lower()
        elif m["attr"]:
            value = next((m[k] for k in ("q", "a", "v") if m[k] is not None), "")
            test = (lambda x: x is None) if m["no"] else (lambda x: x is not None) if not m["op"] else (lambda x, t=_TESTS[m["op"]], v=value: t(x, v))
            now.tests.append((m["attr"].lower(), test))
    if now is None:
        raise ValueError(f"a selector lacks a part: {selectors!r}")
    yield [*chain, (link, now)]


class Selectors:
    """Named selector lists."""

    def __init__(self, lists: Mapping[str, tuple[str, ...]]):
        self.names: dict[int, str] = {}
        self.keyed: dict[tuple[str, str | None], list[tuple[int, str, int, _Compound]]] = {}
        bit = 0
        for name, selectors in lists.items():
            for chain in (c for s in selectors for c in _chains(s)):
                for k, (link, compound) in enumerate(chain):
                    key = ("id", compound.id) if compound.id else ("class", compound.classes[0]) if compound.classes else ("tag", compound.tag)
                    self.keyed.setdefault(key, []).append((1 << bit, link, 1 << bit - 1 if k else 0, compound))
                    bit += 1
                self.names[1 << bit - 1] = name
        self.final = sum(self.names)
        #: Whether a list asks for elements before; only then are nodes matched a second time, for the sake of their next ones.
        self.sideways = any(link and link in "+~" for rows in self.keyed.values() for _, link, _, _ in rows)

    def mask(self, n: Node, above: int, parent: int, before: int, left: int) -> int:
        """A node's mask from those of its ancestors, its parent, the element before and all elements before."""
        classes = set((n.attrs.get("class") or "").split())
        out = 0
        for key in (("id", n.attrs.get("id")), ("tag", n.tag), ("tag", None), *(("class", c) for c in classes)):
            for bit, link, needs, compound in self.keyed.get(key, ()):
                seen = {"": 0, " ": above, ">": parent, "+": before, "~": left}[link]
                if (not needs or seen & needs) and compound.holds(n, classes):
                    out |= bit
        return out

    def match(self, root: Node) -> Iterator[tuple[int, Node, list[str]]]:
        """(pos, node, names) of the nodes that a list selects, in the page's order; pos counts nodes from 0."""
        stack, pos = [(root, 0, 0, 0, 0)], -1
        while stack:
            n, above, parent, before, left = stack.pop()
            pos += 1
            own = 0 if n.parent is None else self.mask(n, above, parent, before, left)
            if own & self.final:
                yield pos, n, sorted({name for bit, name in self.names.items() if own & bit})
            children, before, left = [], 0, 0
            for c in n.children:
                if isinstance(c, Node):
                    children.append((c, above | own, own, before, left))
                    if self.sideways:
                        before = self.mask(c, above | own, own, before, left)
                        left |= before
            stack += reversed(children)


@lru_cache(64)
def compiled(lists: tuple[tuple[str, tuple[str, ...]], ...]) -> Selectors:
    return Selectors(dict(lists))


def frozen(lists: Mapping[str, tuple[str, ...]]) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return tuple((k, tuple(v)) for k, v in lists.items())


def mark(root: Node, selectors: tuple[str, ...]) -> Node:
    """H4: what the selectors find, and all below it, isn't translated."""
    found = {id(n) for _, n, _ in compiled((("", selectors),)).match(root)}
    for n in root.walk():
        n.skip = n.skip or id(n) in found or bool(n.parent and n.parent.skip)
    return root


def selected(pages: DataFrame, lists: Mapping[str, tuple[str, ...]], inner: bool = False, no_translate: tuple[str, ...] = ()) -> DataFrame:
    """H1: (page_id, pos, name, tag, skip, has_block, text) of the elements of pages that named lists select; text is plain, or inner HTML with inline tags."""
    schema = pa.schema([("page_id", pa.int64()), ("pos", pa.int32()), ("name", pa.string()), ("tag", pa.string()), ("skip", pa.bool_()), ("has_block", pa.bool_()), ("text", pa.string())])
    key = frozen(lists)
    compiled(key)  # a list that isn't understood fails here, not in a task

    def each(html: str | None) -> Iterator[tuple]:
        root = parse(html)
        if no_translate:
            mark(root, no_translate)
        for pos, n, names in compiled(key).match(root):
            text = n.inner() if inner else n.text()
            for name in names:
                yield pos, name, n.tag, n.skip, n.has_block(), text

    return _rows(pages, each, schema, "page_id long, pos int, name string, tag string, skip boolean, has_block boolean, text string")


# The elements of shops, by family.
SHOP = {
    "cart_button": (".add_to_cart_button", ".single_add_to_cart_button", ".checkout-button", ".wc-proceed-to-checkout", ".place-order", ".wc-backward", "form.cart button[type=submit]", ".cart_totals .button", ".return-to-shop a"),
    "product_tab": (".wc-tabs li a", ".woocommerce-tabs .tabs li a", ".wc-tab"),
    "notice": (".woocommerce-message", ".woocommerce-info", ".woocommerce-error", ".wc-block-components-notice-banner", ".cart-empty", ".woocommerce-cart-notice"),
    "checkout_field": (".woocommerce-checkout .form-row label", ".woocommerce-billing-fields label", ".woocommerce-shipping-fields label", ".checkout .form-row label"),
    "section_title": (".cart-collaterals h2", ".woocommerce-checkout h3", ".cross-sells h2", ".related.products h2", ".upsells h2", ".cart_totals h2"),
    "product_attr": (
        ".shop_attributes th", ".shop_attributes td", ".woocommerce-product-attributes-item__label", ".woocommerce-product-attributes-item__value",
        ".wd-attr-name-label", ".wd-attr-term", ".wd-attr-name",
        ".variations .label label", ".variations .value select option", ".variations tr th label", ".variations tr td select option", "table.variations th.label label", "table.variations td.value",
        ".woocommerce-product-attributes th", ".woocommerce-product-attributes td", ".product_attributes th", ".product_attributes td",
    ),
}


def shop_items(pages: DataFrame, families: Mapping[str, tuple[str, ...]] = SHOP, no_translate: tuple[str, ...] = (), most_bytes: int = 500) -> DataFrame:
    """(page_id, pos, kind, text) of a shop's elements without blocks and of fewer bytes, each text of a kind once."""
    rows = selected(pages, families, inner=True, no_translate=no_translate).withColumnRenamed("name", "kind")
    size = F.octet_length("text")
    rows = rows.where(~F.col("skip") & ~F.col("has_block") & (size > 0) & (size < most_bytes) & ~P.any_of(P.technical_item(F.col("text"))))
    return rows.groupBy("page_id", "kind", "text").agg(F.min("pos").alias("pos"))
