"""Language-aware URLs, as Column -> Column.

URLs are split by one regular expression, so that scheme, host with port, path, query and fragment of absolute and
relative URLs alike survive unchanged. `home` is the path of a site that doesn't live at the root.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaloom.config import locale_of

#: scheme and host, path, query with ?, fragment with #.
PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
# Fixed values.
ASSET = r"(?i)\.(?:jpg|jpeg|png|gif|webp|svg|ico|css|js|pdf|zip|mp4|mp3|woff2?|ttf)$"
ADMIN = r"^/wp-(?:admin|login|content|includes|json)"
SPECIAL = r"(?i)^(?:mailto|tel|javascript|data|sms|whatsapp|viber|skype):"


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def path_of(url: Column) -> Column:
    return F.when(part(url, 2) == "", "/").otherwise(part(url, 2))


def _without_home(path: Column, home: str) -> Column:
    return F.regexp_replace(path, f"^{re.escape(home.rstrip('/'))}(?=/|$)", "") if home.strip("/") else path


def language_of(url: Column, languages: tuple[str, ...], home: str = "") -> Column:
    """The first segment of the path, if it is an enabled language; else null."""
    first = F.regexp_extract(_without_home(path_of(url), home), "^/*([^/]*)", 1)
    return F.when(first.isin(*languages), first)


def language_hint(url: Column, *fallbacks: Column) -> Column:
    """R2: any two letters in the first segment if a slash follows, else the fallbacks in order."""
    found = F.regexp_extract(path_of(url), "^/([a-z]{2})/", 1)
    return F.coalesce(F.when(found != "", found), *fallbacks)


def add_language(url: Column, language: Column, default: str, home: str = "") -> Column:
    """Once only; the default language has no prefix."""
    path = _without_home(path_of(url), home)
    new = F.concat(part(url, 1), F.lit(home.rstrip("/")), F.lit("/"), language, path, part(url, 3), part(url, 4))
    done = language.isNull() | (language == "") | (language == default) | F.startswith(path, F.concat(F.lit("/"), language, F.lit("/")))
    return F.when(done, url).otherwise(new)


def strip_languages(path: Column, languages: tuple[str, ...]) -> Column:
    """Up to five two-letter prefixes."""
    codes = "|".join(re.escape(x) for x in languages if len(x) == 2)
    clean = F.regexp_replace(path, f"^(?:/(?:{codes})(?=/|$)){{1,5}}", "")
    return F.when(clean == "", "/").otherwise(clean)


def normalize_path(path: Column) -> Column:
    """R6."""
    clean = F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/")
    return F.when(clean == "/", clean).otherwise(F.regexp_replace(clean, "/$", ""))


def url_for_language(url: Column, language: Column, languages: tuple[str, ...], default: str, home: str = "") -> Column:
    """All prefixes stripped, the language's added unless it is the default, path normalized."""
    clean = strip_languages(_without_home(path_of(url), home), languages)
    path = normalize_path(F.when(language == default, clean).otherwise(F.concat(F.lit("/"), language, clean)))
    return F.concat(part(url, 1), F.lit(home.rstrip("/")), path, part(url, 3), part(url, 4))


def strip_one_language(url: Column, languages: tuple[str, ...]) -> Column:
    """R7."""
    codes = "|".join(re.escape(x) for x in languages)
    path = F.regexp_replace(path_of(url), f"^/(?:{codes})(?=/|$)", "")
    return F.concat(part(url, 1), F.when(path == "", "/").otherwise(path), part(url, 3), part(url, 4))


def classify_link(href: Column, host: Column) -> Column:
    """R10."""
    own = F.lower(F.regexp_extract(href, r"^(?i)(?:https?:)?//([^/?#:]*)", 1))
    return (
        F.when(F.startswith(href, F.lit("#")), "anchor")
        .when(href.rlike(SPECIAL), "special")
        .when((own != "") & (own != host), "external")
        .when(path_of(href).rlike(ADMIN), "admin")
        .otherwise("internal")
    )


def rewrite_links(html: Column, language: Column, languages: tuple[str, ...], host: str) -> Column:
    """A language prefix for every href to the host or to a path, and for the host's addresses in share parameters; assets, admin paths and prefixed links stay."""
    codes = "|".join(re.escape(x) for x in languages)
    skip = rf"(?!/?(?:{codes})(?:[/?#\"'])|wp-(?:admin|login|content|includes|json)|[^\"'?#]*\.(?:jpg|jpeg|png|gif|webp|svg|ico|css|js|pdf|zip|mp4|mp3)(?:[\"'?#]))"
    absolute = rf"(?i)((?:href|data-href|data-url|data-link|data-share-url|action)=[\"'](?:https?:)?//{re.escape(host)})/" + skip
    relative = r"(?i)((?:href|data-href|data-url|data-link|data-share-url|action)=[\"'])/(?!/)" + skip
    to = F.concat(F.lit("$1/"), language, F.lit("/"))
    own = F.regexp_replace(F.regexp_replace(html, F.lit(absolute), to), F.lit(relative), to)
    return rewrite_shared_links(own, language, languages, host)


#: Query parameters of share links that carry an address, and endings of files that have no language.
SHARED_PARAMETERS = ("u", "url", "text", "link")
SHARED_FILES = ("css", "js", "png", "jpg", "jpeg", "gif", "svg", "woff", "woff2", "ttf", "eot", "ico", "webp", "pdf", "zip", "xml")


def rewrite_shared_links(html: Column, language: Column, languages: tuple[str, ...], host: str) -> Column:
    """A language prefix for the host's addresses inside share parameters, plain or with %2F (and %3A); the rest of the link stays as it is.

    Addresses that have a prefix, or whose path ends like a file, stay. Null stays null.
    """
    codes, files = "|".join(re.escape(x) for x in languages), "|".join(SHARED_FILES)
    begin = rf"(?i)((?:[?&]|&amp;)(?:{'|'.join(SHARED_PARAMETERS)})="
    end = r"(?:[&\"'\s]|$)"
    skip = rf"|[^&\"'\s]*\.(?:{files}){end})"
    plain = begin + rf"https?://{re.escape(host)})/(?!(?:{codes})(?:[/?#]|{end})" + skip
    encoded = begin + rf"https?(?::|%3A)%2F%2F{re.escape(host)})%2F(?!(?:{codes})(?:%2F|%3F|%23|{end})" + skip
    once = F.regexp_replace(html, F.lit(plain), F.concat(F.lit("$1/"), language, F.lit("/")))
    return F.regexp_replace(once, F.lit(encoded), F.concat(F.lit("$1%2F"), language, F.lit("%2F")))


def hreflangs(pages: DataFrame, url_col: str, languages: tuple[str, ...], default: str, home: str = "") -> DataFrame:
    """A row per page and language, and x-default."""
    sets = [F.struct(F.lit(x).alias("hreflang"), F.lit(x).alias("language")) for x in languages] + [F.struct(F.lit("x-default").alias("hreflang"), F.lit(default).alias("language"))]
    rows = pages.withColumn("x", F.explode(F.array(*sets)))
    href = url_for_language(F.col(url_col), F.col("x.language"), languages, default, home)
    root = part(href, 2).rlike(f"^/?(?:{'|'.join(languages)})?$") & (part(href, 3) == "") & (part(href, 4) == "")
    return rows.withColumn("hreflang", F.col("x.hreflang")).withColumn("href", F.when(root, F.concat(F.regexp_replace(href, "/$", ""), F.lit("/"))).otherwise(href)).drop("x")


def og_locale(language: Column, languages: tuple[str, ...]) -> Column:
    """R12, X14."""
    out = F.lit(None).cast("string")
    for x in languages:
        out = F.when(language == x, locale_of(x)).otherwise(out)
    return out


def alternates(url: Column, languages: tuple[str, ...], default: str, home: str = "") -> Column:
    """Map of language to URL."""
    return F.create_map(*[c for x in languages for c in (F.lit(x), url_for_language(url, F.lit(x), languages, default, home))])


def media_key(url: Column, home_url: str = "") -> Column:
    """Absolute, without query, and without -300x200 and trailing -N before the extension."""
    whole = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).when(F.startswith(url, F.lit("/")), F.concat(F.lit(home_url.rstrip("/")), url)).otherwise(url)
    plain = F.regexp_replace(whole, r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(plain, r"-\d+x\d+(\.[a-zA-Z0-9]+)$", "$1"), r"-\d+(\.[a-zA-Z0-9]+)$", "$1")


def rewrite_srcset(srcset: Column, original: Column, translated: Column) -> Column:
    """Entries whose URL has the original's key get the translated URL and keep their descriptor."""

    def entry(e: Column) -> Column:
        e = F.btrim(e)
        url = F.regexp_extract(e, r"^(\S+)", 1)
        return F.when(media_key(url) == media_key(original), F.concat(translated, F.regexp_extract(e, r"^\S+(.*)$", 1))).otherwise(e)

    return F.array_join(F.transform(F.split(srcset, ","), entry), ", ")


def page_key(url: Column, user: Column, language: Column) -> Column:
    """R17."""
    return F.md5(F.concat_ws("_", url, user, language))


def link_query_texts(href: Column) -> Column:
    """R16, first half: the decoded text, subject and body of mail and messenger links."""
    value = r"(?i)[?&](?:text|subject|body)=([^&#]*)"
    raw = F.regexp_extract_all(href, F.lit(value), F.lit(1))
    return F.transform(raw, lambda x: F.try_url_decode(x))


def link_query_rewriter(translations: dict[str, str]):
    """R16, second half, as a pandas UDF href -> href. The dictionary is one page's or a bounded set."""

    @F.pandas_udf("string")
    def rewrite(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from urllib.parse import quote, unquote_plus

        def one(href: str) -> str:
            def put(m: re.Match) -> str:
                text = unquote_plus(m[2])
                return m[1] + (quote(translations[text], safe="") if text in translations else m[2])

            return re.sub(r"(?i)([?&](?:text|subject|body)=)([^&#]*)", put, href)

        for s in parts:
            yield s.map(one, na_action="ignore")

    return rewrite
