"""Text nodes of pages with what their place says about them, and SEO fields of posts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.functions import predicates as P
from glossaloom.functions import text as T
from glossaloom.operators.html import ATTRIBUTES, Node, _rows, parse

# What marks an element whose texts aren't content. A class is excluded if it holds one of the words.
EXCLUDED_TAGS = ("script", "style", "noscript", "head", "meta", "link")
EXCLUDED_CLASSES = (
    "admin-bar", "wp-admin", "screen-reader-text", "sr-only", "skip-link", "no-translate",
    "visually-hidden", "hidden", "invisible", "display-none",
    "debug", "dev-tools", "developer", "admin-only",
    "elementor", "vc_", "fusion-", "et_pb_", "fl-", "beaver-", "oxygen-", "divi-", "gutenberg-",
    "yoast", "rankmath", "seo-", "cookie-", "gdpr-", "analytics-", "tracking-", "pixel-",
    "social-", "share-", "sharing-", "addtoany-", "facebook-", "twitter-", "instagram-",
    "advertisement", "ad-", "adsense-", "adsbygoogle", "banner-", "promo-",
    "breadcrumb-", "pagination-", "page-numbers", "nav-links", "post-navigation",
    "clearfix", "clear", "spacer", "separator",
)
EXCLUDED_CLASS_PATTERN = r"^wp-|^admin-|-admin$|^hidden-|-hidden$|^no-|-debug$|^dev-"
EXCLUDED_IDS = ("wpadminbar", "wp-admin", "adminbar", "cookie-notice", "cookie-banner", "google-analytics", "gtag", "facebook-pixel", "debug-bar", "query-monitor")
EXCLUDED_ATTRIBUTES = ("data-no-translate", "data-skip-translation")
#: Of ancestors only.
EXCLUDED_ROLES = ("presentation", "none", "complementary")
GLOBAL_TAGS = ("header", "footer", "nav")
GLOBAL_IDS = ("masthead", "colophon", "header", "footer", "sidebar")
GLOBAL_CLASSES = ("site-header", "site-footer", "sidebar", "widget-area", "navigation", "menu")
NODE_CONTEXTS = {"title": "page_title", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "paragraph", "li": "list_item", "button": "button_text", "label": "form_label", "td": "table_cell", "th": "table_cell"}
#: Levels of ancestors that can exclude a text, and that can place it in a global container; None: all.
MOST_LEVELS, MOST_GLOBAL_LEVELS = 8, 50

TEXT_NODES = "page_id long, pos int, kind string, context string, text string, in_global boolean, excluded boolean, style string"


_EXCLUDED_CLASS = re.compile("|".join([*map(re.escape, EXCLUDED_CLASSES), EXCLUDED_CLASS_PATTERN]))


def excluded_element(n: Node) -> bool:
    """T7c for one element, without its role."""
    return (
        n.tag in EXCLUDED_TAGS
        or any(_EXCLUDED_CLASS.search(c) for c in (n.attrs.get("class") or "").split())
        or n.attrs.get("id") in EXCLUDED_IDS
        or any(a in n.attrs for a in EXCLUDED_ATTRIBUTES)
        or n.attrs.get("translate") == "no"
        or n.attrs.get("aria-hidden") == "true"
    )


def global_element(n: Node) -> bool:
    """H21 for one element."""
    own = n.attrs.get("id") or ""
    return n.tag in GLOBAL_TAGS or own in GLOBAL_IDS or "header" in own or "footer" in own or any(c in GLOBAL_CLASSES for c in (n.attrs.get("class") or "").split())


def _marks(n: Node) -> tuple:
    """How many levels up the next excluding element, the next global one and the next style are, and that style.

    Nodes come parents first, so each looks at its parent only. Beyond MOST_LEVELS nothing excludes.
    """
    up = n.parent.marks if n.parent is not None and n.parent.marks else (math.inf, math.inf, math.inf, "")
    style = n.attrs.get("style", "")
    return (0 if excluded_element(n) else up[0] + 1, 0 if global_element(n) else up[1] + 1, 0 if style else up[2] + 1, style or up[3])


def _nodes(html: str | None) -> Iterator[tuple]:
    far, far_global = (math.inf if m is None else m for m in (MOST_LEVELS, MOST_GLOBAL_LEVELS))
    for pos, n in enumerate(parse(html).walk()):
        marks = _marks(n)
        # a role excludes what is below its element, not the texts that are right in it
        n.marks = (0 if n.attrs.get("role") in EXCLUDED_ROLES else marks[0], *marks[1:])
        texts = [("text", NODE_CONTEXTS.get(n.tag, "text_node"), " ".join(c.split())) for c in n.children if isinstance(c, str) and c.strip()]
        texts += [("attribute", f"attribute_{a}", n.attrs[a].strip()) for a in ATTRIBUTES if n.attrs.get(a, "").strip()]
        if not texts or n.tag in ("script", "style", "noscript"):
            continue
        excluded = marks[0] <= far
        for kind, context, text in texts:
            inside = marks[1] < far_global if kind == "text" else n.parent is not None and bool(n.parent.marks) and n.parent.marks[1] < far_global
            yield pos, kind, context, text, inside, excluded, (marks[3] if marks[2] <= far else "") or None


def text_nodes(pages: DataFrame) -> DataFrame:
    """Every text and readable attribute of a page with its context and place."""
    schema = pa.schema([("page_id", pa.int64()), ("pos", pa.int32()), ("kind", pa.string()), ("context", pa.string()), ("text", pa.string()), ("in_global", pa.bool_()), ("excluded", pa.bool_()), ("style", pa.string())])
    return _rows(pages, _nodes, schema, TEXT_NODES)


def capturable(nodes: DataFrame, least: int = 2, most: int = 500) -> DataFrame:
    """The nodes that both the capture chain and the content filter let pass."""
    c = F.col("text")
    valid = F.when(F.col("kind") == "attribute", P.valid_attribute(c)).otherwise(P.valid_text_node(c))
    return nodes.where(valid & ~F.col("in_global") & ~F.col("excluded") & ~P.hidden_style(F.coalesce("style", F.lit(""))) & P.should_process(c, F.col("context"), least, most) & ~P.any_of(P.content_filter(c)))


def dom_stats(nodes: DataFrame) -> DataFrame:
    """H22."""
    return nodes.groupBy("page_id").agg(F.count("*").alias("n_nodes"), F.sum((F.col("kind") == "attribute").cast("long")).alias("n_attributes"), F.sum(F.col("in_global").cast("long")).alias("n_global"), F.sum(F.col("excluded").cast("long")).alias("n_excluded"))


def seo_fields(posts: DataFrame, titles: list[str], descriptions: list[str], variables: dict[str, Column] | None = None, template: str | None = None) -> DataFrame:
    """Posts with seo_title and meta_description: the first filled of the named columns; else the template, else the excerpt or the first 20 words."""
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    values = variables or {}
    title = F.coalesce(*[filled(c) for c in titles], F.lit(template) if template else F.lit(None).cast("string"))
    text = F.coalesce(*[filled(c) for c in descriptions], filled("excerpt"), T.first_words(T.strip_tags(F.col("content"))))
    return posts.withColumn("seo_title", T.fill_variables(title, values)).withColumn("meta_description", text)
