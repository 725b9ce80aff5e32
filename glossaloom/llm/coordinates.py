"""MinHash near-duplicates by an inverted join over signature coordinates.

A signature has COORDINATES minima of a text's set of word shingles; two sets are candidates if they collide in at least
`least_matches` coordinates, which sets of the wanted similarity fail to do with a chance below MISS. Sets are posted under
the values of two neighbouring coordinates at a time: of c collisions at least c - COORDINATES / 2 make whole pairs, and
unlike sets that share a frequent shingle seldom agree in both. Where the threshold warrants no whole pair, they are posted
under single coordinates. Collisions are counted as a T-occurrence problem:

- Values that one set alone holds are in no list. A set with fewer shared values than the threshold drops out.
- Prefix: only the m - threshold + 1 rarest of a set's m shared values are merged; sets that reach the threshold meet there.
- Skip: from the places of the merged matches follows how many more a pair may have; pairs that can't reach the threshold
  are skipped. The long lists of the other values are never scanned; a pair that is left looks its collisions up by
  comparing the two signatures.

Candidates are confirmed by the exact similarity of their whole sets. Equal sets are one entry. A list isn't paired with
itself: each member meets the list's most central set (the one whose values most sets hold). Lists whose members are then
in different components are merged further: short ones in pairs, long ones by how their members differ from the central
set (`_residual`, exact), so that a large group of near copies with edits of their own makes few pairs.

Cases: a text of fewer words than a shingle is one shingle; null and empty texts and texts of white space have an empty
set and link to nothing; a null id keeps its row and is ignored when the smallest id of a component is sought; repeated
ids keep their rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaloom.llm.common import slices, stored, table
from glossaloom.llm.graph import connected_components
from glossaloom.llm.minhash import set_id, shingle_hashes

COORDINATES, MISS = 128, 1e-7
#: Lists of up to so many sets are paired as they are.
SHORT = 32
#: Members of a group that choose the centre from which differences are counted.
VOTERS = 64
#: Shingles whose hashes are taken through all functions at once.
_CHUNK = 1 << 11
_OWN = np.int64(-1 << 63)
_RANDOM = np.random.default_rng(12)
_XOR = _RANDOM.integers(0, 1 << 64, COORDINATES, np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, COORDINATES, np.uint64) | np.uint64(1)


def least_matches(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most collisions that can be asked for, so that sets of this similarity have fewer with a chance of at most `miss`."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            return max(t, 1)
    return coordinates


def signature(hashes: np.ndarray) -> np.ndarray:
    """32 bits of the least hash under each function; none of an empty set."""
    if not len(hashes):
        return np.empty(0, np.uint32)
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, ((hashes[None, k : k + _CHUNK] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1))
    return (least >> np.uint64(16)).astype(np.uint32)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, sid, n, sig): the id, size and signature of each row's set; null for an empty set."""
    schema = pa.schema([("id", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("sig", pa.list_(pa.int32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                sets = [shingle_hashes(t, words) for t in part.column("t").to_pylist()]
                sids = pa.array(np.array([set_id(s) for s in sets], np.uint64).view(np.int64))
                sigs = pa.array([signature(s).view(np.int32) if len(s) else None for s in sets], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), sids, pa.array([len(s) for s in sets], pa.int64()), sigs], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(rows, "id long, sid long, n long, sig array<int>")


def least_values(least: int, coordinates: int = COORDINATES) -> tuple[int, int]:
    """(width, values): how many coordinates make one posted value, and how many values of that width so many collisions share at least."""
    return (2, least - coordinates // 2) if least > coordinates // 2 else (1, least)


def postings(distinct: DataFrame, width: int, least: int) -> DataFrame:
    """(token, sid, n, m, i, weight): the merged part of the lists: of a set's m shared values the m - least + 1 rarest, i their places from 0."""
    token = F.xxhash64("k", *[F.get("sig", F.col("k") + j) for j in range(width)])
    places = F.explode(F.sequence(F.lit(0), F.lit(COORDINATES - width), F.lit(width)))
    dealt = distinct.select("sid", "n", "sig", places.alias("k")).select("sid", "n", token.alias("token")).repartition("token")
    shared = dealt.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = dealt.join(shared, "token").groupBy("sid", "n").agg(F.collect_list(F.struct("df", "token")).alias("values"), F.sum("df").alias("weight"))
    able = own.withColumn("m", F.size("values")).where(F.col("m") >= least)
    rarest = F.slice(F.array_sort("values"), F.lit(1), F.col("m") - least + 1)
    return able.select("sid", "n", "m", "weight", F.posexplode(rarest).alias("i", "x")).select("x.token", "sid", "n", "m", "i", "weight")


def _merged(met: DataFrame, least: int, percent: int) -> DataFrame:
    """The pairs (a, b) of met(sid, sid2, n, n2, m, m2, i, i2), a row per list in which they meet, that may reach the threshold.

    At each meeting, at most min(i, i2) matches lie before and at most min(m - i, m2 - i2) there and behind.
    """
    close = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    most = F.least("i", "i2") + F.least(F.col("m") - F.col("i"), F.col("m2") - F.col("i2"))
    sided = met.where(close & (most >= least)).select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b"))
    return sided.distinct()


def _colliding(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """(a, b, c): the pairs whose whole signatures collide often enough."""
    both = pairs.join(sigs.select(F.col("sid").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("sid").alias("b"), F.col("sig").alias("y")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in ("x", "y"))
                c = (x == y).sum(axis=1, dtype=np.int64)
                keep = pa.array(c >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(c)], schema=schema).filter(keep)

    return both.mapInArrow(count, "a long, b long, c long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is percent / 100 or more."""
    both = pairs.select("a", "b").join(sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(sid, hashes) of the wanted sets, each read from one of its texts."""
    first = rows.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("id").alias("id"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    named = texts.join(first.where("id is not null").select("id").distinct(), "id", "left_semi").unionByName(texts.where("id is null"))
    schema = pa.schema([("sid", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                sets = [shingle_hashes(t, words) for t in part.column("t").to_pylist()]
                sids = pa.array(np.array([set_id(s) for s in sets], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([sids, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=schema)

    # an id may have other texts, and a set may have several rows of one id
    return named.select("t").mapInArrow(read, "sid long, hashes array<long>").join(wanted, "sid", "left_semi").dropDuplicates(["sid"])


def _parts(sids: DataFrame, links: DataFrame) -> DataFrame:
    """(sid, part) of all sids by the links found so far."""
    roots = connected_components(links)
    return stored(sids.join(roots, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("root", "sid").alias("part")), "parts")


def _mixed(posted: DataFrame, parts: DataFrame) -> DataFrame:
    """posted with the part of each set, of the lists in which several parts meet."""
    placed = posted.join(parts, "sid")
    mixed = placed.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("token")
    return placed.join(mixed, "token", "left_semi")


def _placed(long: DataFrame, roots: DataFrame, parts: DataFrame) -> DataFrame:
    """(r, sid, n, part): the sets of long lists, each once for a component that the lists' central sets are in; r is the most central of these."""
    central = long.select("token").distinct().join(roots, "token").select("token", F.col("r.sid").alias("sid"), F.col("r.weight").alias("weight"))
    central = central.join(parts, "sid").select("token", "sid", "weight", F.col("part").alias("of"))
    most = central.groupBy("of").agg(F.max(F.struct("weight", "sid")).alias("r")).select("of", F.col("r.sid").alias("r"))
    return long.join(central.select("token", "of"), "token").select("of", "sid", "n", "part").distinct().join(most, "of").select("r", "sid", "n", "part")


def _ends(pairs: DataFrame) -> DataFrame:
    """(sid) of all sets of pairs (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()


def _differences(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """placed(r, sid, n, part) with features: the shingles that one of sid and r has alone; sid's are negative, r's are not."""
    both = placed.join(sets.select(F.col("sid").alias("r"), F.col("hashes").alias("y")), "r").join(sets.select("sid", F.col("hashes").alias("x")), "sid")
    kept = ("r", "sid", "n", "part")
    schema = pa.schema([*[(c, pa.int64()) for c in kept], ("features", pa.list_(pa.int64()))])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                own, lost = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                found.append(np.concatenate([own | _OWN, lost & ~_OWN]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return both.mapInArrow(differ, "r long, sid long, n long, part long, features array<long>")


def _centred(own: DataFrame) -> DataFrame:
    """own(r, features, ...) with the features counted from another centre: r, with every difference undone that most of its voters share.

    The links found are the same for every centre; a good one has few differences. So VOTERS members choose it, whatever
    the size of the group.
    """
    order = Window.partitionBy("r").orderBy(F.xxhash64("sid"), "sid")
    voters = own.select("r", "sid", "features").withColumn("k", F.row_number().over(order)).where(F.col("k") <= VOTERS)
    sizes = own.groupBy("r").agg(F.least(F.count("*"), F.lit(VOTERS)).alias("size"))
    usual = voters.select("r", F.explode("features").alias("f")).groupBy("r", "f").agg(F.count("*").alias("df")).join(sizes, "r").where("2 * df > size")
    usual = usual.groupBy("r").agg(F.collect_list("f").alias("usual"))  # at most twice as many as the voters' mean difference has
    centred = own.join(usual, "r", "left").withColumn("usual", F.coalesce("usual", F.array().cast("array<long>")))
    return centred.withColumn("features", F.array_sort(F.concat(F.array_except("features", "usual"), F.array_except("usual", "features")))).drop("usual")


def _beginnings(own: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(index, asked): the differences of which sets of own must share one, as `_residual` says; i and i2 are their places from 0."""
    up = 100 + percent
    least = F.greatest(F.lit(1), F.floor((F.col("e") - F.col("s.e")) / (2 * up)) + 1, F.ceil(F.col("e") / up)).cast("int")
    further = F.ceil((percent * F.col("e") - 100 * (100 - percent) * F.col("n")) / (percent * up))
    most = F.greatest(F.lit(1), F.ceil((F.col("e") + F.col("s.e")) / (2 * up)), further).cast("int")
    first = lambda o: F.posexplode(F.slice("features", F.lit(1), F.col("k") - o + 1))
    index = own.where(F.col("k") >= least).select("r", "sid", "n", "e", "part", "k", first(least).alias("i", "f"))
    asked = own.where("e > -s.e").where(F.col("k") >= most).select("r", *[F.col(c).alias(f"{c}2") for c in ("sid", "n", "e", "part", "k")], first(most).alias("i2", "f"))
    return index, asked


def _residual(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), exact, that connect all similar sets in different parts that meet at a central set r.

    Let d(x) be the shingles by which x differs from a centre c (`_centred`), in an order common to all: those that r
    lacks come first, as edits are rarer than what they replace. Sets x and y of sizes n and m are similar if and only if
    they differ in at most q (n + m) shingles, where q = (100 - percent) / (100 + percent). With E(x) = |d(x)| - q n:

    - If E(x) + E(y) <= 0 they are similar, as they differ in |d(x)| + |d(y)| shingles at most. The member s of the least E
      is linked to every such x; pairs of this kind are connected by s.
    - Otherwise they must share (E(x) + E(y)) / 2 differences or more. Let E(x) >= E(y). Then E(x) > -E(s), or both were
      linked to s. So more than (E(y) - E(s)) / 2 and at least E(y) are shared, and at least (E(x) + E(s)) / 2. Nor can they
      share more than |d(y)|, so E(y) >= E(x) - 2 q m, and at least E(x) - q m are shared, where m <= 100 n / percent.
      The first that they share is therefore among the first of y's and the first of x's, all but so many (prefix
      filter), and only these become rows: of a set of n, at most about n / 4. The shared ones decide.
    """
    up, down = 100 + percent, 100 - percent
    own = stored(_differences(placed, sets), "differences")
    centred = _centred(own).withColumn("k", F.size("features")).withColumn("e", up * F.col("k") - down * F.col("n"))
    nearest = centred.groupBy("r").agg(F.min(F.struct("e", "sid", "part")).alias("s"))
    own = stored(centred.join(nearest, "r"), "centred")
    links = own.where("e + s.e <= 0 and part != s.part").select(F.least("sid", "s.sid").alias("a"), F.greatest("sid", "s.sid").alias("b")).distinct()

    index, asked = _beginnings(own, percent)
    close = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    # in the order common to all, at most min(i, i2) shared differences come before this one
    reach = 2 * up * (F.least("i", "i2") + F.least(F.col("k") - F.col("i"), F.col("k2") - F.col("i2"))) >= F.col("e") + F.col("e2")
    met = index.join(asked, ["r", "f"]).where("part != part2 and (e2 > e or e2 = e and sid2 > sid)").where(close & reach)
    met = met.select("r", F.col("sid").alias("a"), F.col("sid2").alias("b")).distinct()
    side = lambda sid, no: own.select("r", F.col("sid").alias(sid), F.col("e").alias(f"e{no}"), F.col("features").alias(f"f{no}"))
    both = met.join(side("a", 1), ["r", "a"]).join(side("b", 2), ["r", "b"])
    same = both.where(2 * up * F.size(F.array_intersect("f1", "f2")) >= F.col("e1") + F.col("e2"))
    return links.unionByName(same.select("a", "b")).distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n, component_id) for every row: the size of its shingle set and the smallest id of its component."""
    least = least_matches(percent)
    rows = stored(signatures(docs, id_col, text_col, words), "signatures")
    distinct = rows.where("n > 0").groupBy("sid").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    distinct = stored(distinct, "distinct_signatures")
    width, values = least_values(least)
    posted = stored(postings(distinct, width, values), "lists")
    able = stored(posted.select("sid").distinct(), "able")
    sigs = stored(distinct.join(able, "sid", "left_semi").select("sid", "sig"), "able_signatures")
    other = [F.col(c).alias(f"{c}2") for c in ("sid", "n", "m", "i", "part")]

    # each member of a list and the list's most central set
    roots = posted.groupBy("token").agg(F.max(F.struct("weight", "sid", "n", "m", "i")).alias("r"), F.count("*").alias("size")).where("size > 1")
    met = posted.join(roots, "token").where("sid != r.sid").select("sid", "n", "m", "i", *[F.col(f"r.{c}").alias(f"{c}2") for c in ("sid", "n", "m", "i")])
    central = stored(_colliding(_merged(met, values, percent), sigs, least), "central")
    sets = stored(_sets(docs, rows, _ends(central), id_col, text_col, words), "sets")
    links = stored(_confirmed(central, sets, percent), "links")

    # members of different components
    parts = _parts(able, links)
    mixed = _mixed(posted, parts)
    mixed = stored(mixed.join(mixed.groupBy("token").agg(F.count("*").alias("size")), "token"), "mixed")
    short = mixed.where(F.col("size") <= SHORT)
    across = _merged(short.join(short.select("token", *other), "token").where("part < part2"), values, percent).join(central, ["a", "b"], "left_anti")
    across = stored(_colliding(across, sigs, least), "across")
    placed = stored(_placed(mixed.where(F.col("size") > SHORT), roots, parts), "placed")
    wanted = _ends(across).union(placed.select("sid")).union(placed.select("r")).distinct()
    sets = stored(_sets(docs, rows, wanted, id_col, text_col, words), "sets")
    links = stored(links.unionByName(_confirmed(across, sets, percent)).unionByName(_residual(placed, sets, percent)), "links")

    found = stored(connected_components(links), "set_roots")
    linked = distinct.join(found, distinct.sid == found.node, "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    # only linked sets are grouped; the others are components of their own
    grouped = linked.join(found.select(F.col("root").alias("r")).distinct(), F.col("root") == F.col("r"), "left_semi").groupBy("root").agg(F.min("least").alias("c"))
    of_set = linked.join(grouped, "root", "left").select("sid", F.coalesce("c", "least").alias("component_id"))
    return rows.join(of_set, "sid", "left").select("id", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op12_minhash_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"), words=2)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


QUERIES = {"op12_minhash_coordinates": op12_minhash_coordinates}
ORACLES = {
    "op12_minhash_coordinates": r"""
with recursive words as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select r, doc_id, case when len(w) = 0 then []::varchar[] when len(w) = 1 then w
                         else list_distinct([w[k] || ' ' || w[k + 1] for k in range(1, len(w))]) end as s
  from words),
distinct_sets as (
  select min(r) as g, list_sort(s) as s, len(s) as n from sets where len(s) > 0 group by list_sort(s), len(s)),
shingles as (select g, n, unnest(s) as x from distinct_sets),
ranked as (select g, n, x, count(*) over (partition by x) as df from shingles),
-- sets of similarity 0.8 share one of the rarest fifth of their shingles
placed as (select g, n, x, row_number() over (partition by g order by df, x) - 1 as i from ranked),
prefix as (select g, n, x from placed where 5 * i <= n),
met as (
  select distinct a.g as a, b.g as b
  from prefix a join prefix b on a.x = b.x and a.g < b.g and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
links as (
  select m.a, m.b from met m join distinct_sets x on x.g = m.a join distinct_sets y on y.g = m.b
  where 180 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n)),
both_ways as (select a, b from links union all select b, a from links),
reached as (
  select g as a, g as b from distinct_sets
  union
  select r.a, e.b from reached r join both_ways e on e.a = r.b),
of_set as (select a as g, min(b) as root from reached group by a),
rows_of as (
  select t.r, t.doc_id, len(t.s) as n, o.root
  from sets t left join distinct_sets d on list_sort(t.s) = d.s left join of_set o on o.g = d.g)
select doc_id, n::bigint as n_shingles,
       case when n = 0 then doc_id else min(doc_id) over (partition by root, n = 0) end as component_id,
       coalesce(doc_id = case when n = 0 then doc_id else min(doc_id) over (partition by root, n = 0) end, false) as kept
from rows_of""",
}
