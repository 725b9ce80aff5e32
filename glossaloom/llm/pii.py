"""Personal data by weak supervision, in DataFrame functions alone.

Candidates are the matches of one strict pattern per kind and of loose patterns beside it: addresses written with
"[at]" or "at ... dot", defanged or version 6 network addresses, cards with other separators, telephone numbers without
their country or as bare digits. Labelers vote on each candidate, for (1), against (-1), or abstain (0):
  regex      for, if the strict pattern or a loose form that hardly anything else has made it; against, if one that much
             else has
  check      for or against, by Luhn's sum, by parts up to 255, by the number of digits, by the parts of an address
  gazetteer  for or against: top-level domains, issuers' first digits, calling and area codes, reserved networks
  context    words before the candidate that name the kind: for; words that name other numbers: against
  edge       against, if a letter, digit or sign of a longer token touches the candidate
Expectation-maximisation over the counts of the vote patterns estimates, per kind, how often candidates are personal
data and how reliable each labeler is, abstentions included. Its posteriors are the soft labels on which the final
span classifier is trained, a logistic regression per kind that sees the span instead of the votes: its form, length,
groups of digits, the characters that touch it, the word before it and whether a line starts with it. Strict matches
that pass the check of the plain forms always stay; a loose one is added where the classifier gives it `CONFIDENT` and it
overlaps no strict one. Votes and features have few values, so their patterns have a bound (MOST_PATTERNS) however large
the corpus is, and their counts go to the driver.

Offsets are in code points, end exclusive. Matches of one pattern don't overlap; those of different kinds may.
Cases: null texts are empty and have no spans; repeated rows and null ids give rows of their own; running sums and
maxima go in blocks and texts are cut in chunks, so a text of very many matches costs near linear time; an empty table
gives no rows; columns of the input other than id and text are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaloom.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "check", "gazetteer", "context", "edge")

# Patterns. The strict ones find what the plain forms
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card [0-9]([\x20-]?[0-9])+                                   phone \+[0-9][\x20().0-9-]+[0-9]
# find from the left without overlaps. They start only where a run starts (or the match before ended) and are possessive
# where the plain form could not give anything back, so that long runs of digits or letters cost linear time and no stack.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/\t\u00A0]|\x20\x20|\x20[-\u2013]\x20)[0-9]{4}(?:[._/\t\u00A0]|\x20\x20|\x20[-\u2013]\x20)[0-9]{4}(?:[._/\t\u00A0]|\x20\x20|\x20[-\u2013]\x20)[0-9]{4}(?![0-9])",
    "phone": r"(?<![+0-9().-]|[0-9]\x20)(?:(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}|00[1-9](?:[\x20.-]?[0-9]){9,12}|0[1-9](?:[\x20.-][0-9]{2}){4}|[0-9]{10,11})(?![0-9]|[\x20.-][0-9])",
}
#: Loose forms that hardly anything else has.
TELLING = {"email": r"[\[(]at[\])]", "ip": r"[\[(]|:", "card": r"^(?:[0-9]{4}\D{1,3}){3}", "phone": r"^\(|^00|^0[1-9]\D|-.*-"}
#: Loose forms that much else has.
VAGUE = {"email": r"\x20at\x20", "ip": r"^$", "card": r"^$", "phone": r"^[0-9]+$"}
#: Without this a text can't hold a loose match.
LOOSE_NEEDS = {"email": r"[\[(]at[\])]|\x20dot\x20", "ip": r"\[\.\]|\(\.\)|[\[(]dot[\])]|:[0-9A-Fa-f]{0,4}:", "card": r"[0-9]{4}(?:[._/\t\u00A0]|\x20\x20|\x20[-\u2013]\x20)[0-9]{4}", "phone": r"[0-9]{2}"}
#: Without this a text can't hold a match.
NEEDS = {"email": "@", "phone": "+"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
# Gazetteers and context words.
GAZETTEER = {
    "email": r"(?i)(?:\.|\[dot\]|\(dot\)|dot)\x20?(?:com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|eu|ch|at|us|ca|mx)$",
    "ip": r"^(?!0|127\.|22[4-9]|2[3-5][0-9])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)",
    "phone": r"^(?:(?:\+|00)\x20?(?:1|7|2[0-9]|3[0-69]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-58])|\(?[2-9]|0[1-9])",
}
CONTEXT_FOR = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|correo|courriel|kontakt)\W",
    "ip": r"(?i)(?:\bip|address|host|server|login|logged)\W",
    "card": r"(?i)(?:card|visa|master|amex|credit|tarjeta|carte|karte)\W",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|tél|teléfono|telefon|ruf)\W",
}
CONTEXT_AGAINST = {
    "email": r"(?i)(?:git|ssh|password)\W",
    "ip": r"(?i)(?:version|release|section|chapter)\W",
    "card": r"(?i)(?:isbn|issn|serial|order|invoice|sku|ean)\W",
    "phone": r"(?i)(?:isbn|order|invoice|serial|part|sku|version)\W",
}
TOUCHES = r"[\p{L}\p{N}_@/=#]"
#: Parts of an address that can't be one.
MALFORMED = r"^\.|\.\.|\.@|@[.-]|-\.|[.-]$|[0-9]$"
#: Characters before a candidate that context words are looked for in; matches that a running value is taken over as one
#: block; characters of a text's chunk.
BEFORE, BLOCK, CHUNK = 40, 256, 1024
#: A loose candidate needs this probability.
CONFIDENT = 0.95
#: 3 votes of three values and 2 of two, 4 forms, 4 lengths, 4 numbers of groups, 4 characters before and after, 3 words, 2 places.
MOST_PATTERNS = 3**3 * 2**2 * 4 * 4 * 4 * 4 * 4 * 3 * 2
CANDIDATES = "array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,feats:array<string>>>"


def running(values: Column, op: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """For each int of an array, op over all up to it. Goes in blocks, so that appending costs little.

    `values` is evaluated more than once, so it should be a column of its own.
    """
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(BLOCK)).cast("int"))
    none = F.array().cast("array<int>")

    def block(acc: Column, b: Column) -> Column:
        first = F.struct(acc["at"].alias("at"), none.alias("found"))
        step = lambda x, v: F.struct(op(x["at"], v).alias("at"), F.concat(x["found"], F.array(op(x["at"], v))).alias("found"))
        last = lambda x: F.struct(x["at"].alias("at"), F.concat(acc["parts"], F.array(x["found"])).alias("parts"))
        return F.aggregate(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), first, step, last)

    start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<array<int>>").alias("parts"))
    return F.when(F.size(values) > 0, F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["parts"]))).otherwise(none)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's sum."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _checked(kind: str, match: Column) -> Column:
    """The check of the plain forms."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(OCTETS)
    digits = _digits(match)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def _voted(kind: str, match: Column) -> Column:
    """The check labeler, for loose forms too."""
    if kind == "email":
        return ~F.regexp_replace(match, r"\x20?(?:[\[(]at[\])]|(?<=\x20)at(?=\x20))\x20?", "@").rlike(MALFORMED)
    if kind == "ip":
        return F.contains(match, F.lit(":")) | F.regexp_replace(match, r"[^0-9]+", ".").rlike(OCTETS)
    return _checked(kind, match)


def _row(kind: str, strict: bool, x: Column) -> Column:
    """The candidate of a match m at s, with the text l before it and r after it."""

    def vote(yes: Column, no: Column) -> Column:
        return F.when(no, F.lit(-1)).when(yes, F.lit(1)).otherwise(F.lit(0))

    ok, telling = _voted(kind, x.m), F.lit(True) if strict else x.m.rlike(TELLING[kind])
    vague = F.lit(False) if strict else x.m.rlike(VAGUE[kind])
    known = (x.m if kind != "card" else _digits(x.m)).rlike(GAZETTEER[kind])
    named, other = x.l.rlike(CONTEXT_FOR[kind]), x.l.rlike(CONTEXT_AGAINST[kind])
    before, after = F.right(x.l, F.lit(1)), F.left(x.r, F.lit(1))
    votes = [vote(telling, vague), vote(ok, ~ok), vote(known, ~known), vote(named, other), vote(F.lit(False), before.rlike(TOUCHES) | after.rlike(TOUCHES))]

    def touch(c: Column) -> Column:
        return F.when(c.isin("", "\n"), F.lit("end")).when(c.rlike(r"[\s\u00A0]"), F.lit("space")).when(c.rlike(TOUCHES), F.lit("token")).otherwise(F.lit("sign"))

    length = F.length(x.m)
    feats = {
        "form": F.lit("strict") if strict else F.when(telling, F.lit("telling")).when(vague, F.lit("vague")).otherwise(F.lit("loose")),
        "length": F.when(length < 11, F.lit("11")).when(length < 15, F.lit("15")).when(length < 21, F.lit("21")).otherwise(F.lit("more")),
        "groups": F.least(F.size(F.regexp_extract_all(x.m, F.lit(r"[A-Za-z0-9]+"), F.lit(0))), F.lit(4)).cast("string"),
        "before": touch(before),
        "after": touch(after),
        "word": F.when(other, F.lit("other")).when(named, F.lit("named")).otherwise(F.lit("none")),
        "line": (before.isin("", "\n")).cast("string"),
    }
    named_feats = [F.concat(F.lit(f"{kind} {k} "), v) for k, v in feats.items()]
    base = _checked(kind, x.m) if strict else F.lit(False)
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x.s.alias("start"), (x.s + length).alias("end"), base.alias("base"), F.array(*votes).alias("votes"), F.array(*named_feats).alias("feats"))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column `found`: all candidates of a row's text.

    Matches, their sizes and starts are columns of their own, step by step: an expression that a lambda's body holds would
    be evaluated for every element.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    patterns = [(k, STRICT[k], True, F.contains(text, F.lit(NEEDS[k])) if k in NEEDS else text.rlike("[0-9]")) for k in KINDS]
    patterns += [(k, p, False, text.rlike(LOOSE_NEEDS[k])) for k, p in LOOSE.items()]
    n, kept = range(len(patterns)), [F.col(f"`{c}`") for c in docs.columns]
    none = F.array().cast("array<string>")
    matches = [F.when(may, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"__m{k}") for k, (_, p, _, may) in enumerate(patterns)]
    rows = docs.select(*kept, *matches)
    pieces = [F.when(F.size(f"__m{k}") > 0, F.split(text, p, -1)).otherwise(none).alias(f"__p{k}") for k, (_, p, _, _) in enumerate(patterns)]
    rows = rows.select(*kept, *[f"__m{k}" for k in n], *pieces)
    # gap and match in turn, so a match ends where the running sum of both does
    steps = [F.flatten(F.zip_with(F.slice(f"__p{k}", F.lit(1), F.size(f"__m{k}")), f"__m{k}", lambda p, m: F.array(F.length(p), F.length(m)))).alias(f"__g{k}") for k in n]
    rows = rows.select(*kept, *[f"__m{k}" for k in n], *[f"__p{k}" for k in n], *steps)
    ends = [running(F.col(f"__g{k}"), lambda a, b: a + b).alias(f"__s{k}") for k in n]
    rows = rows.select(*kept, *[f"__m{k}" for k in n], *[f"__p{k}" for k in n], *ends)

    def parts(k: int, kind: str, strict: bool) -> Column:
        piece, starts = F.col(f"__p{k}"), F.col(f"__s{k}")
        whole = F.transform(f"__m{k}", lambda m, i: F.struct(m.alias("m"), F.get(starts, i * 2).alias("s"), F.right(F.get(piece, i), F.lit(BEFORE)).alias("l"), F.left(F.get(piece, i + 1), F.lit(1)).alias("r")))
        return F.when(F.size(starts) + F.size(piece) > 0, F.transform(whole, lambda x: _row(kind, strict, x))).otherwise(F.array().cast(CANDIDATES))

    return rows.select(*kept, F.concat(*[parts(k, kind, strict) for k, (kind, _, strict, _) in enumerate(patterns)]).alias("found"))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def reliabilities(rows: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[float, list[list[dict[int, float]]], list[float]]:
    """EM over (votes, n): the share of personal data, share[c][j][v] (how often labeler j says v on what is (1) or isn't (0) personal data) and the posterior of each row."""
    share = [[{-1: 0.4, 0: 0.4, 1: 0.2} for _ in LABELERS], [{-1: 0.1, 0: 0.3, 1: 0.6} for _ in LABELERS]]
    prior, post = 0.5, [0.5] * len(rows)
    total = sum(n for _, n in rows)
    for _ in range(rounds if rows else 0):
        for r, (votes, _) in enumerate(rows):
            odds = math.log(prior / (1 - prior)) + sum(math.log(share[1][j][v] / share[0][j][v]) for j, v in enumerate(votes))
            post[r] = _sigmoid(odds)
        prior = min(0.99, max(0.01, sum(p * n for p, (_, n) in zip(post, rows)) / total))
        for c in (0, 1):
            for j in range(len(LABELERS)):
                seen = {v: 1.0 + 2.0 * (v == (1 if c else -1)) for v in (-1, 0, 1)}  # labelers are better than chance
                for p, (votes, n) in zip(post, rows):
                    seen[votes[j]] += n * (p if c else 1 - p)
                share[c][j] = {v: x / sum(seen.values()) for v, x in seen.items()}
    return prior, share, post


def classifier(rows: list[tuple[tuple[str, ...], float, float]], rounds: int = 400) -> dict[str, float]:
    """Weights by feature of a logistic regression on (features, soft label, n); "" is the constant."""
    weights: dict[str, float] = defaultdict(float)
    total = sum(n for *_, n in rows)
    for _ in range(rounds if rows else 0):
        slope: dict[str, float] = defaultdict(float)
        for feats, p, n in rows:
            gap = (p - _sigmoid(weights[""] + sum(weights[f] for f in feats))) * n / total
            for f in ("", *feats):
                slope[f] += gap
        for f, s in slope.items():
            weights[f] += 1.0 * (s - 1e-4 * weights[f])
    return dict(weights)


def fit(counts: list[tuple[int, tuple[int, ...], tuple[str, ...], int]]) -> list[dict]:
    """Per kind: prior, reliabilities and the weights of the classifier, from counts of (kind, votes, features, n)."""
    models = []
    for kind in range(len(KINDS)):
        own = [(votes, feats, n) for k, votes, feats, n in counts if k == kind]
        strict = [feats[0].endswith(" strict") for _, feats, _ in own]
        plain, loose = (sum(n for (_, _, n), s in zip(own, strict) if s is want) for want in (True, False))
        # strict matches are never in doubt: however many there are, they weigh no more than the loose ones
        rows = [(votes, feats, n * min(1.0, max(loose, 1) / plain) if s else float(n)) for (votes, feats, n), s in zip(own, strict)]
        prior, share, post = reliabilities([(votes, n) for votes, _, n in rows])
        models.append({"prior": prior, "share": share, "weights": classifier([(f, p, n) for p, (_, f, n) in zip(post, rows)])})
    return models


def _probability(models: list[dict], x: Column) -> Column:
    """By the weights of the candidate's features; they name their kind."""
    pairs = [(f, w) for m in models for f, w in m["weights"].items() if f]
    if not pairs:
        return F.lit(0.0)
    weights = F.create_map(*[F.lit(v) for pair in pairs for v in pair])
    bias = F.get(F.array(*[F.lit(m["weights"].get("", -30.0)) for m in models]), x.kind)
    return 1 / (1 + F.exp(-F.aggregate(x.feats, bias, lambda acc, f: acc + F.coalesce(F.try_element_at(weights, f), F.lit(0.0)))))


def judged(rows: DataFrame) -> DataFrame:
    """Fits the model on the column `found` and replaces it by `base` and `spans`, each in the order of start and kind."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "found"]
    one = rows.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes", "x.feats").count()
    models = fit(sorted((r["kind"], tuple(r["votes"]), tuple(r["feats"]), r["count"]) for r in one.collect()))
    sure = F.array_sort(F.transform(F.filter("found", lambda x: x.base), lambda x: F.struct(x.start, x.kind, x.end)))
    loose = F.filter("found", lambda x: F.contains(F.get(x.feats, F.lit(0)), F.lit(" form ")) & ~F.endswith(F.get(x.feats, F.lit(0)), F.lit(" strict")) & (_probability(models, x) >= CONFIDENT))
    rows = rows.select(*kept, sure.alias("base"), F.transform(loose, lambda x: F.struct(x.start, x.kind, x.end)).alias("__more"))
    # both in one order: a loose span goes if one before it reaches into it or one of the base starts in it
    both = F.array_sort(F.concat(F.transform("base", lambda x: F.struct(x.start, F.lit(0).alias("loose"), x.kind, x.end)), F.transform("__more", lambda x: F.struct(x.start, F.lit(1).alias("loose"), x.kind, x.end))))
    rows = rows.select(*kept, "base", F.when(F.size("__more") > 0, both).alias("__both"))
    # as one int each, ends below and starts above can be run over
    rows = rows.select(*kept, "base", "__both", F.transform("__both", lambda x: x.end).alias("__end"), F.reverse(F.transform("__both", lambda x: F.when(x.loose == 0, -x.start).otherwise(-(2**31 - 1)))).alias("__next"))
    rows = rows.select(*kept, "base", "__both", running(F.col("__end"), F.greatest).alias("__reach"), running(F.col("__next"), F.greatest, -(2**31 - 1)).alias("__above"))
    last = F.size("__both") - 1
    free = lambda x, i: (x.loose == 0) | (((i == 0) | (F.get("__reach", i - 1) <= x.start)) & ((i == last) | (-F.get("__above", last - i - 1) >= x.end)))
    spans = F.transform(F.filter("__both", free), lambda x: F.struct(x.start, x.kind, x.end))
    return rows.select(*kept, "base", F.when(F.size("__both") > 0, F.array_sort(spans)).otherwise(F.col("base")).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start, x.end)), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return judged(stored(candidates(rows).drop("text"), "pii_candidates"))


def redacted(rows: DataFrame, text_col: str, spans_col: str = "spans") -> DataFrame:
    """rows with every span (or run of overlapping spans) of the text replaced by its kind in brackets; without spans_col.

    The text between spans comes from chunks, so that no cut reads the text from its start.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    kept = [F.col(f"`{c}`") for c in rows.columns if c != spans_col]
    text, some = F.col(f"`{text_col}`"), F.size(spans_col) > 0
    rows = rows.select(*kept, spans_col, F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("__chunks"), F.transform(spans_col, lambda x: x.end).alias("__ends"))
    rows = rows.select(*kept, spans_col, "__chunks", running(F.col("__ends"), F.greatest).alias("__reach"))

    def cut(a: Column, b: Column) -> Column:
        first = F.floor(a / CHUNK).cast("int")
        part = F.slice("__chunks", first + 1, F.floor((b - 1) / CHUNK).cast("int") - first + 1)
        return F.when(b > a, F.substring(F.array_join(part, ""), a - first * CHUNK + 1, b - a)).otherwise(F.lit(""))

    def piece(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get("__reach", i - 1))
        return F.when(x.start >= before, F.concat(cut(before, x.start), F.get(names, x.kind))).otherwise(F.lit(""))

    rest = cut(F.element_at("__reach", -1), F.length(text))
    new = F.when(some & (F.size("__chunks") + F.size("__reach") > 0), F.concat(F.array_join(F.transform(spans_col, piece), ""), rest)).otherwise(text)
    return rows.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in rows.columns if c not in (spans_col, "__chunks", "__reach")])


def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x.kind == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


QUERIES = {"op2_weak_supervision_pii": op2_weak_supervision_pii}
ORACLES: dict[str, str] = {}
