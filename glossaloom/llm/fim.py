"""Fill-in-the-middle: documents cut into prefix, middle and suffix at unit ends, and written with sentinels.

An Arrow-batched pandas UDF: the regex library's finditer gives the ends of a text's units, kept in a compact array; two
lookups of offsets slice the text. Seeds and digests come from hashlib, so a row's result depends on its id and text only,
not on partitions or repeated attempts. Nothing is shuffled.

Cases: a null text is empty, and an empty text stays plain, as does one that holds a sentinel; a null id is seeded as the
empty string; repeated rows and ids give a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaloom.llm.common import table

#: Units are lines: each with its line feed, the last perhaps without.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def draws(seed: int, key: str) -> tuple[int, ...]:
    """Four 32-bit numbers from the SHA-256 of seed:key."""
    digest = sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def unit_ends(text: str, units) -> array:
    """0 and the end offset of each unit, in code points."""
    ends = array("Q", (0,))
    ends.extend(m.end() for m in units.finditer(text))
    return ends


def transform(text: str, key: str, units, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> tuple:
    """(n, form, prefix_chars, middle_chars, output)."""
    ends = unit_ends(text, units)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(seed, key)
    if not text or any(m in text for m in marks) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[one], ends[two]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore(output: str, form: str, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> str:
    """The text of an output. Sentinels don't occur in texts that are cut, so the first of each is the one that was put in."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (p, s) if form == "psm" else (s, p)
    head, _, rest = output.removeprefix(first).partition(second)
    tail, _, middle = rest.partition(m)
    prefix, suffix = (head, tail) if form == "psm" else (tail, head)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, output_sha256) for every row."""

    @F.pandas_udf(_RESULT)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import regex

        units = regex.compile(unit)
        for keys, texts in batches:
            rows = [transform(t, k, units, seed, fim_percent, spm_percent) for k, t in zip(keys, texts)]
            n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
            whole = lambda x: pd.array(x, dtype="Int64")
            yield pd.DataFrame({"n": n, "form": form, "prefix_chars": whole(prefix), "middle_chars": whole(middle), "output": output, "output_sha256": [sha256(o.encode()).hexdigest() for o in output]})

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), cut(blank(id_col), blank(text_col)).alias("r")).select("id", "r.*")


def restored(output: Column, form: Column) -> Column:
    """The texts again, from outputs and forms alone."""

    @F.pandas_udf("string")
    def back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([restore(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return back(output, form)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    again = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return cut.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", again.alias("restored_sha256"))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {
    "op13_fill_in_middle": r"""
with drawn as (
  select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units
  from documents),
numbers as (
  select *, len(units) as n, ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2,
         ('0x' || substr(h, 25, 8))::ubigint as h4
  from drawn),
cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1))::bigint as a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from numbers),
parts as (
  select *, array_to_string(units[1:a], '') as p, array_to_string(units[a + 1:b], '') as m, array_to_string(units[b + 1:], '') as s
  from cuts)
select doc_id, n::bigint as n, form,
       case when form <> 'plain' then length(p) end as prefix_chars,
       case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from parts""",
}
