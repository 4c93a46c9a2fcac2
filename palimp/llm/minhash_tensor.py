"""Near-duplicates by MinHash with tensored tables, verified on full shingle sets.

A table key needs 2R minimum hashes. Instead of fresh ones for each of M x M tables, two collections of M sub-keys of R
hashes are computed and table (i, j) is keyed by the pair of sub-key i of the first and j of the second: 2MR hashes serve
M^2 tables. Two sets of similarity s meet in some table with probability (1 - (1 - s^R)^M)^2.

Rows are first reduced to one vertex per distinct shingle set. Vertices that meet are then compared:
* each vertex goes to the few leaders that it meets in most tables; the vertices of a leader, in slices of bounded size
  that all hold the leader, are compared with each other in one place and give a forest of links;
* a vertex that meets one of another component in a slice where it was not compared visits that slice and is compared
  with all of it, so groups larger than a slice lose nothing. To meet in a sub-key of the first collection is enough
  here, which holds whenever a table is shared. Only (vertex, slice) rows are made, no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimp.llm.base import query, set_apart, staged, table, text_of
from palimp.llm.components import connected_components
from palimp.llm.shingles import U, mixed, shingle_set
from palimp.session import ship_by_value

ship_by_value(__name__)

#: Hashes of a sub-key, and sub-keys of a collection: 96 minima for 256 tables. At a similarity of 0.8 a pair is missed
#: with a probability of 0.00002, at 0.85 of 0.0000006; documents that share a fifth of their text seldom meet.
R, M = 3, 16
#: Vertices compared with each other in one task, and leaders that a vertex goes to.
SLICE, HOMES = 256, 3
_SEEDS = mixed(np.arange(1, 2 * M * R + 1, dtype=U)) | U(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 2M sub-keys of a set."""
    lows = np.empty(2 * M * R, dtype=U)
    for f, seed in enumerate(_SEEDS):
        x = shingles * seed
        lows[f] = (x ^ (x >> U(32))).min()
    sub = np.arange(2 * M, dtype=U)
    for r in range(R):
        sub = mixed(sub + lows.reshape(2 * M, R)[:, r])
    return sub


def _sign(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, vertices, keys = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py().encode("utf-8", "replace"), words)
                sizes.append(len(s))
                # Sum of mixed shingles: equal for equal sets, in any order.
                vertices.append(int(mixed(s ^ U(0x5DEECE66D)).sum(dtype=U).astype(np.int64)) if len(s) else None)
                keys.append(signature(s).astype(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(vertices, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "vertex", "keys"],
            )

    return sign


def _with_vertex(words: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vertices = []
            for text in batch.column("text"):
                s = shingle_set(text.as_py().encode("utf-8", "replace"), words)
                vertices.append(int(mixed(s ^ U(0x5DEECE66D)).sum(dtype=U).astype(np.int64)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vertices, pa.int64())], [*batch.schema.names, "vertex"])

    return add


def forest(sets: list[np.ndarray], guests: list[int], hosts: list[int], percent: int, groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (i, j) of guests with hosts, 100 |i and j| >= percent |i or j|, that join what neither the given groups nor an
    earlier link joins. Common shingles are counted for all hosts at once by an index of the hosts' shingles."""
    up = list(range(len(sets)))
    if groups:
        first: dict[int, int] = {}
        up = [first.setdefault(g, i) for i, g in enumerate(groups)]

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    if not guests or not hosts:
        return []
    lengths = np.array([len(sets[j]) for j in hosts])
    index = np.concatenate([sets[j] for j in hosts])
    order = np.argsort(index, kind="stable")
    index, owner = index[order], np.repeat(np.arange(len(hosts)), lengths)[order]
    links = []
    for i in guests:
        start, end = np.searchsorted(index, sets[i], "left"), np.searchsorted(index, sets[i], "right")
        n = end - start
        at = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(hosts))
        for j in np.flatnonzero((common > 0) & (100 * common >= percent * (len(sets[i]) + lengths - common))).tolist():
            a, b = root(i), root(hosts[j])
            if a != b:
                up[a] = b
                links.append((i, hosts[j]))
    return links


LINKS = "a long, b long"


def _link_table(vertices: list[int], links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({n: pa.array([vertices[x[i]] for x in links], pa.int64()) for i, n in enumerate("ab")})


def _compare_slice(words: int, percent: int):
    def compare(group: pa.Table) -> pa.Table:
        vertices = group["vertex"].to_pylist()
        sets = [shingle_set(t.encode("utf-8", "replace"), words) for t in group["text"].to_pylist()]
        return _link_table(vertices, forest(sets, [*range(len(sets))], [*range(len(sets))], percent))

    return compare


def _compare_visitors(words: int, percent: int):
    def compare(group: pa.Table) -> pa.Table:
        vertices, visiting = group["vertex"].to_pylist(), group["visiting"].to_pylist()
        sets = [shingle_set(t.encode("utf-8", "replace"), words) for t in group["text"].to_pylist()]
        guests, hosts = [i for i, v in enumerate(visiting) if v], [i for i, v in enumerate(visiting) if not v]
        return _link_table(vertices, forest(sets, guests, hosts, percent, group["component"].to_pylist()))

    return compare


def _shared_sub_keys(classes: DataFrame) -> DataFrame:
    """vertex, first, second: the sub-keys of either collection that another vertex has too, of vertices with both."""
    sub = classes.select("vertex", F.posexplode("keys").alias("pos", "sub"))
    shared = sub.groupBy("pos", "sub").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    sides = sub.join(shared, ["pos", "sub"]).groupBy("vertex").agg(
        F.collect_list(F.when(F.col("pos") < M, F.struct("pos", "sub"))).alias("first"),
        F.collect_list(F.when(F.col("pos") >= M, F.struct("pos", "sub"))).alias("second"),
    )
    return sides.where((F.size("first") > 0) & (F.size("second") > 0))


def _tables(sides: DataFrame) -> DataFrame:
    """key, vertex, leader: the tables in which a vertex is not alone, keyed by pairs of sub-keys."""
    rows = sides.select("vertex", F.explode("first").alias("f"), "second").select("vertex", "f", F.explode("second").alias("s"))
    rows = staged(rows.select(F.xxhash64("f.pos", "f.sub", "s.pos", "s.sub").alias("key"), "vertex"), "tables")
    full = rows.groupBy("key").agg(F.count("*").alias("n"), F.min_by("vertex", F.xxhash64("vertex")).alias("leader")).where("n > 1").drop("n")
    return rows.join(full, "key")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Documents are linked if their sets of word shingles have a Jaccard similarity of at least ``percent``; the component is
    the smallest id that links reach, and that document is ``kept``. A text of fewer words is one shingle; a null or empty
    text has no shingle and is linked with nothing. Rows that repeat an id are judged by their own texts. Null ids are
    larger than all others; a component of null ids has a null id and keeps them. An empty table gives no rows; other
    columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    signed = staged(rows.mapInArrow(_sign(words), "doc_id long, n_shingles long, vertex long, keys array<long>"), "signatures")
    classes = signed.where("vertex is not null").groupBy("vertex", "n_shingles").agg(F.min("doc_id").alias("first_id"), F.any_value("keys").alias("keys"))
    classes = staged(classes, "classes")
    sides = staged(_shared_sub_keys(classes.select("vertex", "keys")), "sub-keys")

    # The leaders that a vertex meets most often, and its slice among the vertices of each.
    met = _tables(sides).groupBy("vertex", "leader").agg(F.count("*").alias("n"))
    best = Window.partitionBy("vertex").orderBy(F.desc("n"), "leader")  # at most one row per table
    homes = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= HOMES).drop("n")
    sizes = homes.groupBy("leader").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    slice_of = F.xxhash64("leader", F.pmod(F.xxhash64("vertex"), "slices"))
    homes = staged(homes.join(sizes, "leader").select("vertex", slice_of.alias("slice"), "leader", "rank"), "homes")

    # One text per vertex that meets another.
    with_vertex = rows.mapInArrow(_with_vertex(words), "doc_id long, text string, vertex long")
    wanted = classes.join(homes.where("rank = 1").select("vertex"), "vertex").select(F.col("vertex").alias("v"), "first_id")
    texts = with_vertex.join(wanted, (F.col("vertex") == F.col("v")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("vertex", "text")
    texts = staged(texts, "texts")

    members = homes.select("slice", "vertex").unionByName(homes.select("slice", F.col("leader").alias("vertex"))).distinct()
    near = members.join(texts, "vertex").groupBy("slice").applyInArrow(_compare_slice(words, percent), LINKS)
    links = staged(near, "links")

    far = _visits(sides, homes, connected_components(links), texts, words, percent)
    components = connected_components(staged(links.unionByName(far), "links"))

    of = classes.join(components, F.col("vertex") == F.col("node"), "left").withColumn("component", F.coalesce("component", "vertex"))
    lowest = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = of.join(lowest, "component").select(F.col("vertex").alias("v"), "component_id")
    out = signed.join(of, F.col("vertex") == F.col("v"), "left")
    component = F.when(F.col("vertex").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _places(homes: DataFrame) -> DataFrame:
    """vertex, slice: each vertex in one slice. Leaders are followed a few steps, so that those who meet stand in few slices;
    where a vertex stands decides what is compared at once, not what is compared."""
    to = homes.groupBy("vertex").agg(F.min_by("leader", F.xxhash64("leader")).alias("root"))
    for _ in range(3):
        next_of = to.select(F.col("vertex").alias("v"), F.col("root").alias("r"))
        to = staged(to.join(next_of, F.col("root") == F.col("v"), "left").select("vertex", F.coalesce("r", "root").alias("root")), "roots")
    sizes = to.groupBy("root").agg(F.ceil(F.count("*") / (2 * SLICE)).alias("slices"))
    return to.join(sizes, "root").select("vertex", F.xxhash64("root", F.pmod(F.xxhash64("vertex"), "slices")).alias("slice"))


def _visits(sides: DataFrame, homes: DataFrame, components: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between vertices that meet, are in different components and were not compared in a slice.

    In each sub-key the vertices of the largest component stay, those of the others visit; a sub-key of one component
    makes no visit. Visitors of a slice come in parts of bounded size.
    """
    place = _places(homes).join(components, F.col("vertex") == F.col("node"), "left")
    place = staged(place.select("vertex", "slice", F.coalesce("component", "vertex").alias("component")), "places")
    rows = sides.where("vertex is not null").join(place, "vertex").select("vertex", "slice", "component", F.explode("first").alias("key"))
    there = rows.groupBy("key", "component", "slice").agg(F.count("*").alias("n"))
    sizes = there.groupBy("key", "component").agg(F.sum("n").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("component", "n").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    apart = staged(rows.join(largest, "key"), "apart")
    guests = apart.where("component <> largest").select("key", F.col("vertex").alias("guest"), F.col("component").alias("own"))
    hosts = apart.groupBy("key", "slice").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    visits = guests.join(hosts, "key").where("low <> own or high <> own").select("guest", "slice").distinct()
    visits = staged(visits, "visits")

    parts = visits.groupBy("slice").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("guest"), "parts").cast("int")
    come = visits.join(parts, "slice").select("slice", part.alias("part"), F.col("guest").alias("vertex"), F.lit(True).alias("visiting"))
    live = place.select("slice", "vertex").join(parts, "slice")
    live = live.select("slice", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vertex", F.lit(False).alias("visiting"))
    held = come.unionByName(live).join(place.select("vertex", "component"), "vertex").join(texts, "vertex")
    return held.groupBy("slice", "part").applyInArrow(_compare_visitors(words, percent), LINKS)


@set_apart("__id")
def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one of each component, with their columns as they were, clashing names included.

    Documents without words are linked with nothing and stay. Rows that repeat an id stay or go together; null ids as in
    :func:`near_duplicates`. An empty table gives no rows.
    """
    kept = near_duplicates(docs, words, percent, key, text).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, F.col(key).cast("long").eqNullSafe(F.col("__id")), "left_semi")


ORACLE = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as x from s),
i as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as an, any_value(b.n) as bn, count(*) as c from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from i where 100 * c >= 80 * (an + bn - c)),
r as (with recursive r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on r.b = l.a) select a, min(b) as component_id from r group by a)
select s.doc_id, len(s.s) as n_shingles, r.component_id, s.doc_id = r.component_id as kept from s join r on r.a = s.doc_id
"""


@query("op10_tensored_minhash", ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
