"""The selector engine against a matcher that tries every chain from its end."""

from __future__ import annotations

import random
import time

import pytest

from glossaloom.operators import html as H
from glossaloom.operators import selectors as S

PAGE = """<body class="woocommerce-checkout"><form class="cart"><button type="submit" class="x">Buy it</button><button>Not it</button></form><div class="return-to-shop"><a>Back there</a></div>
<ul class="wc-tabs"><li><a>Details</a></li></ul><p class="woocommerce-info">Sold <b>out</b></p><div class="woocommerce-error"><p>Block inside</p></div>
<p class="form-row"><label>First name</label></p><h3>Your order</h3><table class="shop_attributes"><tr><th>Weight</th><td>Three kilos</td><td></td></tr></table>
<div class="notranslate"><p class="cart-empty">Empty now</p></div><div class="off"><p class="cart-empty">Empty too</p></div><p class="wc-tab">%s</p></body>"""


def by_trying(selector, node):
    """Whether a chain of (combinator, compound) ends at a node, by all ways to go back."""

    def elements(n):
        return [c for c in n.parent.children if isinstance(c, H.Node)]

    def at(k, n):
        link, compound = selector[k]
        if n.parent is None or not compound.holds(n, set((n.attrs.get("class") or "").split())):
            return False
        if k == 0:
            return True
        before = elements(n)[: elements(n).index(n)]
        if link == ">":
            return at(k - 1, n.parent)
        if link == "+":
            return bool(before) and at(k - 1, before[-1])
        if link == "~":
            return any(at(k - 1, b) for b in before)
        up, m = [], n.parent
        while m is not None:
            up.append(m)
            m = m.parent
        return any(at(k - 1, a) for a in up)

    return at(len(selector) - 1, node)


def test_matches_equal_brute_force():
    rng = random.Random(8)
    compounds = ["a", "b", "*", ".x", ".y", "#i", "a.x", ".x.y", "[t]", "[!t]", "[t=1]", "[t!='1']", "[t^=1]", "[t$=2]", '[t*="1"]', "[t|=1]", "[t~=1]", "b#i.y[t]"]
    for _ in range(150):
        page = ""
        for _ in range(rng.randint(1, 25)):
            tag = rng.choice("ab")
            page += rng.choice([f"</{tag}>", f"<{tag}{rng.choice(['', ' class=x', ' class=\"y x\"', ' id=i', ' t=1', ' t=\"1-2\"', ' t=\"2 1\"', ' t id=i class=y'])}>", "z"])
        root = H.parse(page)
        text = "".join(rng.choice(compounds) + rng.choice([" ", ">", " + ", " ~ "]) for _ in range(rng.randint(0, 3))) + rng.choice(compounds)
        lists = {"one": (text,), "two": (f"{rng.choice(compounds)} , {rng.choice(compounds)}>a",)}
        want = {name: {id(n) for n in root.walk() for t in ts for c in S._chains(t) if by_trying(c, n)} for name, ts in lists.items()}
        found = list(S.Selectors(lists).match(root))
        assert {name: {id(n) for _, n, names in found if name in names} for name in lists} == want, (text, page)
        every = [id(n) for n in root.walk()]
        assert all(every[pos] == id(n) for pos, n, _ in found)


@pytest.mark.parametrize("text", ["", "a,,b", "> a", "a >", "a:hover", "[a", "a[=b]", "a > > b", ".", ","])
def test_lists_that_are_not_understood(text):
    with pytest.raises(ValueError):
        S.Selectors({"x": (text,)})


def test_deep_and_wide_pages_are_linear():
    lists = {"x": ("i i b i > b", "b ~ i", "b + i i")}
    for page in ("<i>" * 20000, "<b></b><i></i>" * 10000, "<b>" * 5000 + "<i></i>" * 10000):
        root = H.parse(page)
        began = time.process_time()
        sum(1 for _ in S.Selectors(lists).match(root))
        assert time.process_time() - began < 2.0


def test_shop_families(spark):
    frame = spark.createDataFrame([(1, PAGE % "long tab "), (2, PAGE % ("x " * 300)), (3, None)], "page_id long, html string")
    got = sorted((r.page_id, r.kind, r.text) for r in S.shop_items(frame, no_translate=(".off",)).collect())
    common = [("cart_button", "Back there"), ("cart_button", "Buy it"), ("checkout_field", "First name"), ("notice", "Sold <b>out</b>"), ("product_attr", "Three kilos"), ("product_attr", "Weight"), ("product_tab", "Details"), ("section_title", "Your order")]
    assert got == sorted([(k, *c) for k in (1, 2) for c in common] + [(1, "product_tab", "long tab")])
    assert "Empty too" in {r.text for r in S.shop_items(frame).collect()}


def test_selectors_set_items_apart(spark):
    frame = spark.createDataFrame([(1, "<div class='side'><p>Not this one</p></div><p data-x=2>Nor this</p><p>But this</p>")], "page_id long, html string")
    assert {r.original for r in H.items_of(frame, no_translate=("div.side > p", "[data-x^='2']")).collect()} == {"But this"}
    assert len({r.original for r in H.items_of(frame).collect()}) == 3
    with pytest.raises(ValueError):
        H.items_of(frame, no_translate=("p:first",))
