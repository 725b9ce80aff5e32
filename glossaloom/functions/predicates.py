"""Is a string translatable? Boolean Columns, one per rule set, and the reasons behind them.

The rule sets disagree on purpose: lengths count bytes in some and characters in others, and patterns differ. A rule set
is a list of (reason, Column); `any_of` tells whether one holds and `reasons` lists those that do.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaloom.functions.text import trim

# Patterns of the rule sets (valid for Java and RE2).
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"^https?://"
JSON_BEGINS = r"^[\s\uFEFF]*(?:[\[{\"'+.0-9-]|true|false|null|NaN|Inf)"
JSON_LIKE = r"""[{\[].*["']:\s*["'].*[}\]]"""
ESCAPED_TAGS = r"<\\/span>|<\\/bdi>|<\\/ins>"
VARIATION = r'"(sku|variation_id|variation_description|price_html|availability_html)"'
SLUG = r"^[a-z0-9_-]+$"
FILE_NAME = r"(?i)\.(jpg|jpeg|png|gif|webp|svg|pdf|zip|mp4)$"
INLINE_TAGS = r"(?i)</?(?:br|span|strong|b|em|i|u|a|small|mark|del|ins|sub|sup|code)(?:\s[^>]*)?>"
ATTRIBUTES = r"(?i)\b(class|id|href|src|style|rel|target|type|media|data-[a-z])\s*="
SKIP_PATTERNS = (
    r"^[0-9\s\-+()]+$",
    EMAIL,
    URL,
    r"^#[a-fA-F0-9]{3,6}$",
    r"^\d+px$",
    r"^\d+em$",
    r"^\d+rem$",
    r"^\d+%$",
    r"^[\d\s\-/.]+$",
    r"^[A-Z0-9_]+$",
    r"^/[^/\s]*/[gimuy]*$",
)
CAPTURE_SKIP_PATTERNS = (r"^[0-9\s\-+()]+$", EMAIL, URL, r"^#[a-fA-F0-9]{3,6}$", r"^\d+px$", r"^[\d\s\-/]+$")
# Interface strings that aren't content.
ADMIN_STRINGS = (
    "Dashboard", "At a Glance", "Activity", "Quick Draft", "Posts", "Media", "Pages", "Comments", "Appearance", "Plugins", "Users", "Tools", "Settings",
    "Edit", "View", "Delete", "Trash", "Restore", "Publish", "Update", "Add New", "Upload", "Insert", "Cancel", "Save Changes",
    "Log Out", "Profile", "Howdy", "Hello", "Welcome", "Administrator", "Editor", "Author", "Contributor", "Subscriber",
    "Draft", "Published", "Pending", "Private", "Scheduled", "Search", "Filter", "Sort", "Previous", "Next", "Submit", "Yes", "No", "OK", "Apply", "Reset", "Clear",
    "Консоль", "Записи", "Страницы", "Комментарии", "Внешний вид", "Плагины", "Пользователи", "Инструменты", "Настройки", "Добавить новую", "Изменить", "Просмотр", "Удалить", "Выйти",
    "English", "Русский", "Français", "Deutsch", "Español", "Italiano", "Português", "Nederlands", "Polski",
)
COMMON_BUTTONS = ("OK", "Cancel", "Submit", "Reset", "Go", "Send")
# Content filter.
FILTER_PATTERNS = (
    r"(?i)^Posted by\s*$", r"(?i)^Back to list\s*$", r"(?i)^Read more\s*$", r"(?i)^Continue reading\s*$", r"(?i)^Share this\s*$", r"(?i)^Related posts\s*$",
    r"(?i)^\d{1,2}:\d{2}(:\d{2})?\s*(AM|PM)?\s*$", r"^\d{1,2}/\d{1,2}/\d{2,4}$", r"^\d{4}-\d{2}-\d{2}$",
    r"(?i)^https?://[^\s]+$", EMAIL, r"^\d+$", r"^[^\w\s]*$", r"^[\s\-_=+]*$",
    r"(?i)^©\s*\d{4}", r"(?i)^Copyright\s*\d{4}", r"(?i)^All rights reserved", r"(?i)^Privacy Policy$", r"(?i)^Terms of Service$", r"(?i)^Cookie Policy$", r"(?i)^GDPR",
    r"(?i)^Previous$", r"(?i)^Next$", r"(?i)^Page \d+ of \d+$", r"^\d+\s*/\s*\d+$", r"^\$\d+(\.\d{2})?$", r"^€\d+(\.\d{2})?$", r"^£\d+(\.\d{2})?$",
    r"(?i)^\d+/\d+\s*stars?$", r"^\d+\.\d+\s*/\s*\d+$", r"^[A-Z0-9]{5,}$", r"^#[a-fA-F0-9]{3,6}$", r"^(\s*\|\s*)+$",
)
HIDDEN_STYLES = (r"(?i)display\s*:\s*none", r"(?i)visibility\s*:\s*hidden", r"(?i)opacity\s*:\s*0", r"(?i)height\s*:\s*0", r"(?i)width\s*:\s*0")
METADATA = (r"(?i)\d{1,2}\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)", r"(?i)^(By|Author|Written by)\s+", r"(?i)^(Category|Categories|Tag|Tags|Filed under):", r"(?i)\d+\s+(min|minutes?)\s+(read|reading)")
JS_KEYWORDS = ("function", "return", "if", "==", "var", "const", "let")
ITEM_PATTERNS = (
    r"(?i)^oEmbed\s*\(", r"(?i)^Focus keyphrase", r"(?i)^Your task is to", r"(?i)^SEO title", r"(?i)^Meta description", r"(?i)^Schema markup", r"(?i)^wp-", r"(?i)^woocommerce-",
    r"(?i)^data-[\w-]+=", r"(?i)^aria-[\w-]+=", r"(?i)^Click to share on", r"(?i)^Share via", r"(?i)^(function|var|const|let)\s+\w+", r"^\d{4}-\d{2}-\d{2}", r"(?i)^#[0-9a-f]{3,6}$",
    r"(?i)woocommerce_loop", r"(?i)describedby_", r"(?i)^Main navigation", r"(?i)^RSD$", r"Заполнитель", r"(?i)^placeholder$",
)
ITEM_DENYLIST = (
    "open mobile menu", "close mobile menu", "toggle navigation", "skip to content", "skip to main content", "scroll to top", "close search", "site logo",
    "facebook social link", "x social link", "twitter social link", "pinterest social link", "linkedin social link", "telegram social link", "instagram social link", "json", "rss", "atom",
)
STATIC_ASSETS = r"(?i)\.(css|js|jpg|jpeg|png|gif|svg|ico|woff2?|ttf|xml|txt)(\?|$)"

Rules = list[tuple[str, Column]]


def any_of(rules: Rules) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for _, c in rules))


def reasons(rules: Rules) -> Column:
    """T7g: names of the rules that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))


def _without(c: Column, tags: str) -> Column:
    return F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, tags, "")).otherwise(c)


def matches_any(c: Column, patterns: tuple[str, ...]) -> Column:
    """One pass: patterns that begin with ^ are tried at the beginning alone."""
    parts = [re.fullmatch(r"(\(\?\w+\))?(\^?)(.*)", p, re.S).groups(default="") for p in patterns]
    first = [f"(?:{flags}{rest})" for flags, edge, rest in parts if edge]
    found = [f"(?:{flags}{rest})" for flags, edge, rest in parts if not edge]
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in ("^(?:" + "|".join(first) + ")" if first else "", "|".join(found)) if p])


def is_json(c: Column) -> Column:
    """Any JSON value, scalars too. The parser stops behind the first value; within brackets and as a member it only fits if it is all of the text."""
    begins = c.rlike(JSON_BEGINS)  # spares other texts the parser
    fits = lambda head, tail: F.try_parse_json(F.concat(F.lit(head), c, F.lit(tail))).isNotNull()
    return F.coalesce(begins, F.lit(False)) & F.try_parse_json(c).isNotNull() & fits("[", "]") & fits('{"v":', "}")


def _empty(c: Column) -> Column:
    return c.isNull() | c.isin("", "0")


def technical_memory(c: Column) -> Rules:
    """What the translation memory doesn't take."""
    return [
        ("empty", _empty(c)),
        ("json", is_json(c)),
        ("json_like", c.rlike(JSON_LIKE)),
        ("escaped_tags", c.rlike(ESCAPED_TAGS)),
        ("variation", c.rlike(VARIATION)),
        ("url", c.rlike(URL)),
        ("email", c.rlike(EMAIL)),
        ("short", F.octet_length(c) < 2),
        ("slug", c.rlike(SLUG) & c.rlike("[-_]")),
        ("file", c.rlike(FILE_NAME)),
    ]


def technical_render(c: Column) -> Rules:
    """As T1 with JSON only in brackets, and no markup but inline tags."""
    rest = _without(c, INLINE_TAGS)
    rules = [(n, x & c.rlike(r"^\s*[\[{]") if n == "json" else x) for n, x in technical_memory(c)]
    return [*rules, ("open_tag", rest.rlike(r"(?i)<[a-z][a-z0-9]*[\s>]")), ("close_tag", rest.rlike("(?i)</[a-z]")), ("attribute", rest.rlike(ATTRIBUTES)), ("doctype", rest.rlike("(?i)<!DOCTYPE|<!--")), ("css", c.rlike(r"\{[^}]*:[^}]*\}"))]


def technical_item(c: Column) -> Rules:
    """What the page extractor drops."""
    rest = _without(c, INLINE_TAGS.replace("|code)", "|code|kbd|samp|var)"))
    keywords = reduce(lambda a, b: a + b, (F.contains(F.lower(c), F.lit(k)).cast("int") for k in JS_KEYWORDS))
    return [
        ("json", is_json(c)),
        ("json_like", c.rlike(JSON_LIKE)),
        ("close_tag", rest.rlike("(?i)</[a-z]")),
        ("open_tag", rest.rlike(r"(?i)<[a-z][a-z0-9]*[\s>]")),
        ("variation", c.rlike(VARIATION)),
        ("url", c.rlike(URL)),
        ("bracket", c.rlike(r"^[{\[]")),
        ("code_tag", c.rlike("(?i)^<(script|style|svg|!--)")),
        ("wrapped", c.rlike(r"(?is)^<([a-z]+)(?:\s[^>]*)?>.*</\1>$")),
        ("number", c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$") | c.rlike(r"^\d+%$")),
        ("email", c.rlike(EMAIL)),
        ("short", F.octet_length(c) < 2),
        ("slug", c.rlike("(?i)" + SLUG) & c.rlike("[-_]")),
        ("file", c.rlike(FILE_NAME)),
        ("digits", c.rlike("[0-9]{8,}")),
        ("denied", F.lower(trim(c)).isin(*ITEM_DENYLIST)),
        ("cdata", c.startswith("<![CDATA[") | c.startswith("&lt;![CDATA[")),
        ("calendar", c.startswith("BEGIN:VCALENDAR")),
        ("script", keywords >= 3),
        ("admin", matches_any(c, ITEM_PATTERNS)),
        ("entities", c.rlike(r"(?i)^(&[a-z]+;|&#\d+;)+$")),
    ]


def length_ok(c: Column, least: int = 2, most: int = 500) -> Column:
    """Characters."""
    return F.char_length(c).between(least, most)


def skip_pattern(c: Column) -> Column:
    """T4b."""
    return matches_any(c, SKIP_PATTERNS)


def username_like(c: Column) -> Column:
    return (c.rlike(r"^[a-zA-Z0-9._-]+$") & (F.octet_length(c) < 30)) | (c.rlike("^[A-Z][a-z]+$") & (F.octet_length(c) < 15))


def technical_string(c: Column) -> Column:
    return (c.rlike(r"^[a-z-]+(-[a-z0-9]+)*$") & (F.octet_length(c) > 5)) | (c.rlike("^[a-zA-Z][a-zA-Z0-9_-]*$") & (F.octet_length(c) > 8)) | (c.rlike(r"[/\\.]") & ~c.rlike(r"\s"))


def admin_string(c: Column, strings: tuple[str, ...] = ADMIN_STRINGS, heuristics: bool = True) -> Column:
    """T4c, T4d, T8: equal to an interface string, or holding one of more than three bytes, without regard to case."""
    low = F.lower(c)
    found = F.lower(trim(c)).isin(*[s.lower() for s in strings])
    for s in strings:
        if len(s.encode()) > 3:
            found = found | F.contains(low, F.lit(s.lower()))
    return found | username_like(c) | technical_string(c) if heuristics else found | username_like(c)


def valid_content(c: Column) -> Column:
    """T4e: letters make up 0.3 of the characters; no tags; no remnant of a character reference."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return (letters > 0) & (letters / F.char_length(c) >= 0.3) & ~c.rlike("<[^>]*>") & ~c.rlike(r"[&%;][a-zA-Z0-9]{2,8};")


def context_ok(c: Column, context: Column) -> Column:
    """T4f."""
    return (
        F.when(context == "admin_bar", False)
        .when(context.isin("page_title", "heading"), True)
        .when(context == "button_text", ~trim(c).isin(*COMMON_BUTTONS))
        .when(context.isin("form_label", "attribute_placeholder"), ~c.rlike("^[a-z_]+$"))
        .when(context.isin("attribute_alt", "attribute_title"), F.char_length(c) >= 3)
        .otherwise(True)
    )


def should_process(c: Column, context: Column, least: int = 2, most: int = 500) -> Column:
    """T4: all of T4a to T4f."""
    return length_ok(c, least, most) & ~skip_pattern(c) & ~admin_string(c) & valid_content(c) & context_ok(c, context)


def capture_ok(c: Column, context: Column, least: int = 2, most: int = 500) -> Column:
    """T5: bytes."""
    return F.octet_length(c).between(least, most) & (F.coalesce(context, F.lit("")) != "admin_bar")


def capture_skip(c: Column) -> Column:
    """T6."""
    return matches_any(c, CAPTURE_SKIP_PATTERNS)


def filter_technical(c: Column) -> Rules:
    """T7a."""
    return [
        ("short", _empty(c) | (F.octet_length(trim(c)) < 2)),
        ("number", c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$") | c.rlike(r"^\d+%$")),
        ("url", c.rlike(URL) | c.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^\s]+$")),
        ("email", c.rlike(EMAIL)),
        ("css", c.rlike(r"^[.#][a-zA-Z0-9\-_]+$") | c.rlike(r"^[a-zA-Z\-]+\s*:\s*[^;]+;?$")),
        ("script", c.rlike(r"^(function|var|let|const|if|for|while)\s*[({]")),
        ("entity_and_tag", c.rlike("&[a-zA-Z0-9]+;") & c.rlike("<[^>]*>")),
        ("base64", c.rlike("^[A-Za-z0-9+/]+=*$") & (F.octet_length(c) > 20)),
        ("hash", c.rlike("^[a-fA-F0-9]{32,}$")),
        ("uuid", c.rlike("^[a-fA-F0-9]{8}(-[a-fA-F0-9]{4}){3}-[a-fA-F0-9]{12}$")),
    ]


def structured_data(c: Column) -> Rules:
    """T7b."""
    t = trim(c)
    return [
        ("json", t.rlike(r"(?s)^(\{.*\}|\[.*\])$") & is_json(t)),
        ("markup", t.rlike("(?s)^<[^>]+>.*</[^>]+>$")),
        ("serialized", t.rlike(r"^[aOs]:\d+:")),
        ("query_string", t.rlike("^[a-zA-Z0-9_]+=.*(&[a-zA-Z0-9_]+=.*)*$")),
        ("json_ld", F.contains(t, F.lit("@context")) & F.contains(t, F.lit("schema.org"))),
    ]


def content_filter(c: Column) -> Rules:
    """Bytes in 2..2000, then patterns, then T7a and T7b."""
    t = trim(c)
    return [("short", F.octet_length(t) < 2), ("long", F.octet_length(t) > 2000), ("pattern", matches_any(t, FILTER_PATTERNS)), ("technical", any_of(filter_technical(t))), ("structured", any_of(structured_data(t)))]


def hidden_style(style: Column) -> Column:
    """T7e."""
    return F.coalesce(matches_any(style, HIDDEN_STYLES), F.lit(False))


def metadata_like(c: Column) -> Column:
    """T7f."""
    return matches_any(c, METADATA)


def valid_text_node(c: Column) -> Column:
    """T9 without the place in the page, which the page table function tells."""
    return (F.octet_length(trim(c)) >= 2) & c.rlike(r"\p{L}")


def valid_attribute(c: Column) -> Column:
    """T10."""
    return (F.octet_length(trim(c)) >= 2) & c.rlike(r"\p{L}") & ~trim(c).rlike(URL) & ~trim(c).rlike(EMAIL)


def valid_page(html: Column) -> Column:
    """T11."""
    return (F.octet_length(html) >= 100) & html.rlike("(?i)<html|<!DOCTYPE")


def static_asset(url: Column) -> Column:
    """T12."""
    return url.rlike(STATIC_ASSETS)


def has_script(c: Column, script: str = "Cyrillic") -> Column:
    """T13."""
    return c.rlike(r"\p{Is" + script + "}")


def shortcodes(c: Column) -> Column:
    """The [shortcodes] of a text."""
    return F.regexp_extract_all(c, F.lit(r"(\[[a-zA-Z_/][^\]]*\])"), F.lit(1))


def mask_shortcodes(c: Column) -> Column:
    return F.regexp_replace(c, r"\[[a-zA-Z_/][^\]]*\]", "\u0001")


def unmask_shortcodes(masked: Column, codes: Column) -> Column:
    """Puts codes back in order."""
    parts = F.split(masked, "\u0001", -1)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.zip_with(codes, F.slice(parts, F.lit(2), F.size(parts)), lambda a, b: F.concat(a, b)), ""))
