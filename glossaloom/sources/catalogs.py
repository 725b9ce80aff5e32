"""Message catalogs (PO files), gettext calls in source trees, and a catalog sink."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "path string, locale string, domain string, msgctxt string, msgid string, msgid_plural string, form int, msgstr string"
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}
#: gettext functions: which argument is the text, the plural, the context, the domain.
CALLS = {"__": (0, None, None, 1), "_e": (0, None, None, 1), "esc_html__": (0, None, None, 1), "esc_attr__": (0, None, None, 1), "esc_html_e": (0, None, None, 1), "esc_attr_e": (0, None, None, 1), "_x": (0, None, 1, 2), "_ex": (0, None, 1, 2), "esc_html_x": (0, None, 1, 2), "esc_attr_x": (0, None, 1, 2), "_n": (0, 1, None, 3), "_nx": (0, 1, 3, 4)}


def unquote(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text)


def parse_po(content: str) -> Iterator[tuple]:
    """(msgctxt, msgid, msgid_plural, form, msgstr); any number of forms, escapes and strings over several lines."""
    entry: dict = {}
    field = None
    for line in [*content.splitlines(), ""]:
        line = line.strip()
        m = re.match(r'(msgctxt|msgid_plural|msgid|msgstr(?:\[(\d+)\])?)\s+"((?:[^"\\]|\\.)*)"$', line)
        if m and m[1] in ("msgctxt", "msgid") and "msgid" in entry and field not in ("msgctxt",):
            yield from _emit(entry)
            entry = {}
        if m:
            field = ("msgstr", int(m[2] or 0), m[2] is not None) if m[1].startswith("msgstr") else m[1]
            entry[field] = unquote(m[3])
        elif line.startswith('"') and line.endswith('"') and field is not None and len(line) > 1:
            entry[field] += unquote(line[1:-1])
        elif not line:
            yield from _emit(entry)
            entry, field = {}, None


def _emit(entry: dict) -> Iterator[tuple]:
    if entry.get("msgid"):
        for key, text in entry.items():
            if isinstance(key, tuple):
                yield entry.get("msgctxt"), entry["msgid"], entry.get("msgid_plural"), key[1] if key[2] else None, text


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", F.decode("content", "utf-8").alias("content"))


def _entries(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Catalogs as files(path, content), cut at empty lines, where entries end: a file of any size is many rows."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n\n").text(path)
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return rows.select(name.alias("path"), F.col("value").alias("content"))


def _explode(files: DataFrame, each, schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(p, *row) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()) for row in each(c or "")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, ddl)


def catalog_rows(files: DataFrame) -> DataFrame:
    """S9 to S11 over files(path, content)."""
    text = [(c, pa.string()) for c in ("msgctxt", "msgid", "msgid_plural")]
    schema = pa.schema([("path", pa.string()), *text, ("form", pa.int32()), ("msgstr", pa.string())])
    rows = _explode(files, parse_po, schema, "path string, msgctxt string, msgid string, msgid_plural string, form int, msgstr string")
    name = F.regexp_extract("path", r"([^/]+)\.po$", 1)
    locale = F.regexp_extract(name, r"(?:^|-)([a-z]{2,3}(?:_[A-Z]{2})?)$", 1)
    domain = F.when(locale == name, "default").otherwise(F.regexp_replace(name, r"-[a-z]{2,3}(_[A-Z]{2})?$", ""))
    return rows.select("path", locale.alias("locale"), domain.alias("domain"), "msgctxt", "msgid", "msgid_plural", "form", "msgstr")


def read_catalogs(spark: SparkSession, path: str) -> DataFrame:
    return catalog_rows(_entries(spark, path, "*.po"))


def reverse_map(catalog: DataFrame) -> DataFrame:
    """Msgstr -> msgid, the singular first."""
    rows = catalog.where("msgstr != ''")
    return rows.groupBy("msgstr").agg(F.min_by("msgid", F.struct(F.coalesce("form", F.lit(-1)), "msgid")).alias("msgid"))


def catalog_found(texts: DataFrame, catalog: DataFrame, shown=lambda c: c) -> DataFrame:
    """(text_hash, msgid): what catalog_lookup finds; texts and keys go by their hashes. shown: what is made of a msgid."""
    plain = F.regexp_replace("text", r"^\d+\s+", "")
    keys = texts.select(F.md5("text").alias("text_hash"), F.md5(plain).alias("plain")).distinct()
    # 2 only where it differs: the same key would come second
    keys = keys.select("text_hash", F.explode(F.when(F.col("plain") == F.col("text_hash"), F.array("text_hash")).otherwise(F.array("text_hash", "plain"))).alias("k"))
    keys = keys.withColumn("prio", F.when(F.col("k") == F.col("text_hash"), 1).otherwise(2))
    form = F.when(F.coalesce("form", F.lit(0)) > 0, 1).otherwise(0)
    of_str = F.when(F.col("msgstr") != "", F.struct(F.md5("msgstr").alias("k"), form.alias("p")))
    sides = catalog.select("msgid", F.explode(F.array_compact(F.array(of_str, F.struct(F.md5("msgid").alias("k"), F.lit(2).alias("p"))))).alias("x"))
    # a rank of a text is one key of one kind, so the least msgid of these is all that counts
    least = sides.where("x.k is not null").groupBy("x.k", "x.p").agg(F.min("msgid").alias("msgid")).select("k", "p", shown(F.col("msgid")).alias("msgid"))
    found = keys.join(least, "k")
    return found.groupBy("text_hash").agg(F.min(F.struct((F.col("p") * 10 + F.col("prio")).alias("rank"), "msgid"))["msgid"].alias("msgid"))


def catalog_lookup(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Msgid of each text, by msgstr, else by msgstr without a leading number, else as a plural, else as a msgid itself."""
    found = catalog_found(texts, catalog)
    return texts.select("text").distinct().withColumn("text_hash", F.md5("text")).join(found, "text_hash").select("text", "msgid")


_TOKEN = re.compile(r"""//[^\n]*|\#[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[A-Za-z_][A-Za-z0-9_]*|\S""", re.S)


def gettext_calls(content: str) -> Iterator[tuple]:
    """(function, msgid, msgid_plural, msgctxt, domain) of the calls with literal texts, in order."""
    tokens = [t for t in _TOKEN.findall(content) if not t.startswith(("//", "#", "/*"))]
    for k, t in enumerate(tokens[:-1]):
        if t in CALLS and tokens[k + 1] == "(" and (k == 0 or tokens[k - 1] not in ("function", ">", ":")):
            args, depth, at = [[]], 1, k + 2
            while at < len(tokens) and depth:
                x = tokens[at]
                depth += (x in "([{") - (x in ")]}") if len(x) == 1 else 0
                if x == "," and depth == 1:
                    args.append([])
                elif depth:
                    args[-1].append(x)
                at += 1
            literal = [a[0][1:-1] if len(a) == 1 and a[0][0] in "'\"" else None for a in args]
            get = lambda i: re.sub(r"\\(['\"\\])", r"\1", literal[i]) if i is not None and i < len(literal) and literal[i] is not None else None
            text, plural, context, domain = CALLS[t]
            if get(text):
                yield t, get(text), get(plural), get(context), get(domain)


def scan_sources(spark: SparkSession, path: str, glob: str = "*.php") -> DataFrame:
    """Different strings of a source tree, each with its first file."""
    schema = pa.schema([(c, pa.string()) for c in ("path", "function", "msgid", "msgid_plural", "msgctxt", "domain")])
    rows = _explode(_files(spark, path, glob), gettext_calls, schema, "path string, function string, msgid string, msgid_plural string, msgctxt string, domain string")
    return rows.groupBy("msgctxt", "domain", "msgid").agg(F.min("path").alias("path"), F.max("msgid_plural").alias("msgid_plural"))


def write_catalog(strings: DataFrame, path: str) -> None:
    """One text file per domain folder with an entry for each string."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    plural = F.when(F.col("msgid_plural").isNotNull(), F.concat(F.lit("\nmsgid_plural "), quote(F.col("msgid_plural")), F.lit('\nmsgstr[0] ""\nmsgstr[1] ""\n'))).otherwise('\nmsgstr ""\n')
    entry = F.concat(F.coalesce(F.concat(F.lit("msgctxt "), quote(F.col("msgctxt")), F.lit("\n")), F.lit("")), F.lit("msgid "), quote(F.col("msgid")), plural)
    strings.select(F.coalesce("domain", F.lit("default")).alias("domain"), entry.alias("value")).write.partitionBy("domain").text(path)
