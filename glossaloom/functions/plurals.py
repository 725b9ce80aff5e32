"""Plural rules: gettext headers turned into CASE expressions that both Spark and other SQL engines run.

A header's expression is C with n, integers, % comparisons, && || ! and ?:. It is parsed once on the driver, when a
query is built, into SQL text; rows are evaluated by the SQL engine alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Plural headers by language.
_ONE = "nplurals=1; plural=0;"
_SOUTH_SLAVIC = "nplurals=3; plural=(n%10==1 && n%100!=11 ? 0 : n%10>=2 && n%10<=4 && (n%100<10 || n%100>=20) ? 1 : 2);"
_EAST_SLAVIC = "nplurals=3; plural=(n%10==1 && n%100!=11 ? 0 : n%10>=2 && n%10<=4 && (n%100<12 || n%100>14) ? 1 : 2);"
_CZECH = "nplurals=3; plural=(n==1 ? 0 : n>=2 && n<=4 ? 1 : 2);"
HEADERS = {
    "zh": _ONE, "ja": _ONE, "ko": _ONE, "th": _ONE, "vi": _ONE, "tr": _ONE,
    "sr": _SOUTH_SLAVIC, "hr": _SOUTH_SLAVIC, "bs": _SOUTH_SLAVIC, "ru": _SOUTH_SLAVIC, "uk": _EAST_SLAVIC, "be": _EAST_SLAVIC,
    "pl": "nplurals=3; plural=(n==1 ? 0 : n%10>=2 && n%10<=4 && (n%100<10 || n%100>=20) ? 1 : 2);",
    "cs": _CZECH, "sk": _CZECH,
    "sl": "nplurals=4; plural=(n%100==1 ? 0 : n%100==2 ? 1 : n%100==3 || n%100==4 ? 2 : 3);",
    "gd": "nplurals=4; plural=(n==1 || n==11) ? 0 : (n==2 || n==12) ? 1 : (n > 2 && n < 20) ? 2 : 3;",
    "ga": "nplurals=5; plural=n==1 ? 0 : n==2 ? 1 : (n>2 && n<7) ? 2 : (n>6 && n<11) ? 3 : 4;",
    "br": "nplurals=5; plural=n==1 ? 0 : n==2 ? 1 : n%10==1 ? 2 : n%10==2 ? 3 : 4;",
    "ar": "nplurals=6; plural=(n==0 ? 0 : n==1 ? 1 : n==2 ? 2 : n%100>=3 && n%100<=10 ? 3 : n%100>=11 ? 4 : 5);",
    "fr": "nplurals=2; plural=n > 1;",
}
DEFAULT = "nplurals=2; plural=n != 1;"


def parse_header(header: str | None) -> tuple[int, str]:
    """(nplurals, expression). Unlike the strict form, white space after the first ; is optional; what can't be read is English."""
    m = re.match(r"\s*nplurals\s*=\s*(\d+)\s*;\s*plural\s*=\s*(.+?);?\s*$", header or "", re.I)
    return (int(m[1]), m[2]) if m else (2, "n != 1")


def header_of(language: str) -> str:
    """P3."""
    return HEADERS.get(language, DEFAULT)


def form_count(language: str) -> int:
    """P2."""
    return parse_header(header_of(language))[0]


class _Parser:
    """Precedence climbing over the tokens of an expression; numbers and truth values are told apart as they are built."""

    LEVELS = (("||",), ("&&",), ("==", "!="), ("<=", ">=", "<", ">"), ("+", "-"), ("*", "/", "%"))
    SQL = {"||": "OR", "&&": "AND", "==": "=", "!=": "<>"}

    def __init__(self, text: str):
        self.tokens = re.findall(r"\d+|n|\|\||&&|[=!<>]=|[<>!%*/+\-?:()]", text)
        if "".join(self.tokens) != re.sub(r"\s+", "", text):
            raise ValueError(f"not a plural expression: {text}")
        self.tokens.append("")

    def take(self, want: str) -> None:
        if self.tokens.pop(0) != want:
            raise ValueError(f"{want} expected")

    def whole(self) -> str:
        value = self.number(self.choice())
        self.take("")
        return value

    @staticmethod
    def number(x: tuple[str, bool]) -> str:
        return f"CASE WHEN {x[0]} THEN 1 ELSE 0 END" if x[1] else x[0]

    @staticmethod
    def truth(x: tuple[str, bool]) -> str:
        return x[0] if x[1] else f"({x[0]} <> 0)"

    def choice(self) -> tuple[str, bool]:
        test = self.level(0)
        if self.tokens[0] != "?":
            return test
        self.take("?")
        yes = self.number(self.choice())
        self.take(":")
        no = self.number(self.choice())
        return f"CASE WHEN {self.truth(test)} THEN {yes} ELSE {no} END", False

    def level(self, k: int) -> tuple[str, bool]:
        if k == len(self.LEVELS):
            return self.unary()
        left = self.level(k + 1)
        while self.tokens[0] in self.LEVELS[k]:
            op = self.tokens.pop(0)
            right = self.level(k + 1)
            join = self.truth if k < 2 else self.number
            whole = f"({join(left)} {self.SQL.get(op, op)} {join(right)})"
            left = f"CAST(FLOOR{whole} AS BIGINT)" if op == "/" else whole, k < 4  # C divides integers
        return left

    def unary(self) -> tuple[str, bool]:
        token = self.tokens.pop(0)
        if token == "!":
            return f"(NOT {self.truth(self.unary())})", True
        if token == "(":
            inner = self.choice()
            self.take(")")
            return inner
        if token == "n" or token.isdigit():
            return token, False
        raise ValueError(f"unexpected {token!r}")


def expression_sql(expression: str, n: str = "n") -> str:
    """P5: SQL of a C expression over the column n; English if it can't be parsed."""
    try:
        sql = _Parser(expression).whole()
    except ValueError:
        sql = _Parser("n != 1").whole()
    return re.sub(r"\bn\b", n, sql)


def form_sql(language: str, n: str = "n") -> str:
    return expression_sql(parse_header(header_of(language))[1], n)


def plural_form(n: Column, language: str) -> Column:
    """The form of n; a null n is 0."""
    return F.transform(F.array(F.coalesce(n, F.lit(0)).cast("long")), lambda x: _built(parse_header(header_of(language))[1], x))[0].cast("int")


def _built(expression: str, x: Column) -> Column:
    try:
        return _Builder(expression, x).whole()
    except ValueError:
        return _Builder("n != 1", x).whole()


class _Builder(_Parser):
    """The same grammar, with Columns in place of SQL text."""

    OPS = {"||": "__or__", "&&": "__and__", "==": "__eq__", "!=": "__ne__", "<=": "__le__", ">=": "__ge__", "<": "__lt__", ">": "__gt__", "+": "__add__", "-": "__sub__", "*": "__mul__", "/": "__truediv__", "%": "__mod__"}

    def __init__(self, text: str, x: Column):
        super().__init__(text)
        self.x = x

    @staticmethod
    def number(x):
        return F.when(x[0], 1).otherwise(0) if x[1] else x[0]

    @staticmethod
    def truth(x):
        return x[0] if x[1] else x[0] != 0

    def choice(self):
        test = self.level(0)
        if self.tokens[0] != "?":
            return test
        self.take("?")
        yes = self.number(self.choice())
        self.take(":")
        return F.when(self.truth(test), yes).otherwise(self.number(self.choice())), False

    def level(self, k: int):
        if k == len(self.LEVELS):
            return self.unary()
        left = self.level(k + 1)
        while self.tokens[0] in self.LEVELS[k]:
            op = self.tokens.pop(0)
            right = self.level(k + 1)
            join = self.truth if k < 2 else self.number
            whole = getattr(join(left), self.OPS[op])(join(right))
            left = F.floor(whole).cast("long") if op == "/" else whole, k < 4
        return left

    def unary(self):
        token = self.tokens.pop(0)
        if token == "!":
            return ~self.truth(self.unary()), True
        if token == "(":
            inner = self.choice()
            self.take(")")
            return inner
        if token == "n" or token.isdigit():
            return (self.x if token == "n" else F.lit(int(token))), False
        raise ValueError(f"unexpected {token!r}")


def rule_table(spark: SparkSession, languages: tuple[str, ...]) -> DataFrame:
    """(language_code, nplurals, expression)."""
    return spark.createDataFrame([(x, *parse_header(header_of(x))) for x in languages], "language_code string, nplurals int, expression string")


def form_for(language: Column, n: Column, languages: tuple[str, ...]) -> Column:
    """The form of n in the language of the row."""
    out = F.lit(None).cast("int")
    for x in languages:
        out = F.when(language == x, plural_form(n, x)).otherwise(out)
    return out


def lookup_form(is_plural: Column, nplurals: Column) -> Column:
    """The first form for singulars, the last for plurals."""
    return F.when(is_plural, nplurals - 1).otherwise(0)
