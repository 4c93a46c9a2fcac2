"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners by the share of documents that hold them, rare terms first. Documents lie in shards of bounded
size. For each shard a bundle of items starts with an empty sparse accumulator, (item, document, score), and goes through the
owners in turn: each stage is a cogroup of the bundles with the owner's postings of the same shard, which adds the integer
contributions of its terms. Entries that the terms still to come cannot lift to the k best of their shard are let go, which
is exact, since the k best of all are no worse. The last stage hands over the k best of a shard and item for the final choice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimp.llm.base import partitions, query, staged, table
from palimp.llm.words import SQL_WORDS, normal
from palimp.session import ship_by_value

ship_by_value(__name__)

#: Documents and postings of a shard, and items of a bundle on average: they bound what a task holds.
SHARD_DOCS, SHARD_POSTINGS, BUNDLE_ITEMS = 2048, 1 << 20, 256
#: Shares of the documents that part the owners: the first owns terms below the first share, the last those of all others.
SHARES = (0.001, 0.01, 0.1)
#: Distinct terms, and bytes of them, that are broadcast to spare postings of no item; beyond, a join alone sorts them out.
BROADCAST_TERMS, BROADCAST_BYTES = 200_000, 16 << 20
#: The most that one term adds is its weight times this.
MOST = 1_000_000

POSTING = "struct<term: binary, slots: binary, tfs: binary>"
INDEX = f"shard long, ids array<long>, lengths array<long>, n_docs long, n_terms long, postings array<{POSTING}>"
PLAN = "items array<long>, terms array<struct<owner: int, term: binary, w: long, members: binary>>"
BUNDLE = f"shard long, block int, ids array<long>, lengths array<long>, {PLAN}, at_item binary, at_doc binary, score binary, least binary"


def _indexer(wanted):
    """Documents to shards: ids and lengths by slot, and for each term the slots and counts."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = wanted.value if wanted else None
        ids, lengths, slots, tfs, made, held = [], [], {}, {}, 0, 0
        first = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal ids, lengths, slots, tfs, made, held
            postings = [{"term": t, "slots": np.array(slots[t], dtype=np.int32).tobytes(), "tfs": np.array(tfs[t], dtype=np.int32).tobytes()} for t in slots]
            kind = pa.list_(pa.struct([("term", pa.binary()), ("slots", pa.binary()), ("tfs", pa.binary())]))
            longs = pa.list_(pa.int64())
            columns = [pa.array([first + made]), pa.array([ids], longs), pa.array([lengths], longs), pa.array([len(ids)]), pa.array([sum(lengths)]), pa.array([postings], kind)]
            ids, lengths, slots, tfs, made, held = [], [], {}, {}, made + 1, 0
            return pa.RecordBatch.from_arrays(columns, ["shard", "ids", "lengths", "n_docs", "n_terms", "postings"])

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                counts = Counter(normal(text.as_py()).split())
                if not counts:
                    continue
                for term in counts if vocabulary is None else counts.keys() & vocabulary:
                    slots.setdefault(term, []).append(len(ids))
                    tfs.setdefault(term, []).append(counts[term])
                    held += 1
                ids.append(key)
                lengths.append(counts.total())
                if len(ids) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                    yield flush()
        if ids:
            yield flush()

    return index


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
            terms = list(dict.fromkeys(normal(text).split()))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.binary())], ["item", "term"])


def _plan(group: pa.Table) -> pa.Table:
    """The items of a block, and each term with its owner, weight and the places of the items that hold it."""
    rows = group.select(["item", "owner", "term", "w"]).to_pylist()
    place = {item: i for i, item in enumerate(dict.fromkeys(r["item"] for r in rows))}
    terms: dict[tuple, list[int]] = {}
    for r in rows:
        terms.setdefault((r["owner"], r["term"], r["w"]), []).append(place[r["item"]])
    plan = [{"owner": o, "term": t, "w": w, "members": np.array(m, dtype=np.int32).tobytes()} for (o, t, w), m in sorted(terms.items())]
    kind = pa.list_(pa.struct([("owner", pa.int32()), ("term", pa.binary()), ("w", pa.int64()), ("members", pa.binary())]))
    return pa.table({"block": group["block"].slice(0, 1), "items": pa.array([list(place)], pa.list_(pa.int64())), "terms": pa.array([plan], kind)})


def _stage(owner: int, n_docs: int, n_terms: int, k: int):
    """One owner: a bundle and the owner's postings of its shard to the bundle with their contributions added."""

    def add(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        if not bundles.num_rows:
            return bundles
        bundle = bundles.slice(0, 1).to_pylist()[0]
        items, plan = bundle["items"], bundle["terms"]
        n = np.array(bundle["lengths"], dtype=np.int64)
        m = 100 - 90 + (90 * n * n_docs) // n_terms
        score = np.zeros((len(items), len(n)), dtype=np.int64)
        score[np.frombuffer(bundle["at_item"], np.int32), np.frombuffer(bundle["at_doc"], np.int32)] = np.frombuffer(bundle["score"], np.int64)
        least = np.frombuffer(bundle["least"], np.int64).copy() if bundle["least"] else np.ones(len(items), dtype=np.int64)
        held = {t.as_py(): i for i, t in enumerate(postings["term"])} if postings.num_rows else {}
        rest = np.zeros(len(items), dtype=np.int64)
        for term in plan:
            members = np.frombuffer(term["members"], np.int32)
            if term["owner"] > owner:
                rest[members] += term["w"] * MOST
            elif term["term"] in held:
                i = held[term["term"]]
                slots = np.frombuffer(postings["slots"][i].as_py(), np.int32)
                tf = np.frombuffer(postings["tfs"][i].as_py(), np.int32).astype(np.int64)
                score[np.ix_(members, slots)] += term["w"] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[slots]))
        if len(n) >= k:  # the k-th best of the shard so far is no better than that of all documents
            least = np.maximum(least, np.partition(score, len(n) - k, axis=1)[:, len(n) - k])
        at_item, at_doc = np.nonzero((score > 0) & (score + rest[:, None] >= least[:, None]))
        later = [t for t in plan if t["owner"] > owner]
        return pa.Table.from_pylist([bundle | {
            "terms": later, "at_item": at_item.astype(np.int32).tobytes(), "at_doc": at_doc.astype(np.int32).tobytes(),
            "score": score[at_item, at_doc].tobytes(), "least": least.tobytes()}], schema=bundles.schema)

    return add


def _best(k: int):
    """Of each bundle, the k best documents of each item, all of them where they are fewer."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.select(["ids", "items", "at_item", "at_doc", "score"]).to_pylist():
                item, doc, score = (np.frombuffer(b[c], t) for c, t in (("at_item", np.int32), ("at_doc", np.int32), ("score", np.int64)))
                # Null ids come first among equals.
                key = np.array([np.iinfo(np.int64).min if i is None else i for i in b["ids"]], dtype=np.int64)
                order = np.lexsort((key[doc], -score, item))
                starts = np.searchsorted(item[order], np.arange(len(b["items"])))
                chosen = order[np.arange(len(order)) - starts[item[order]] < k]
                yield pa.RecordBatch.from_arrays([
                    pa.array([b["items"][i] for i in item[chosen]], pa.int64()), pa.array([b["ids"][i] for i in doc[chosen]], pa.int64()), pa.array(score[chosen])],
                    ["item_id", "doc_id", "score"])

    return best


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           most_terms: int = BROADCAST_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for each item, all of them where they are fewer.

    Equal scores go by ascending doc_id, null first. Null and empty texts and texts without a term are no documents. Rows
    that repeat a doc_id are documents of their own; rows that repeat an item_id (or are without one) are one item with the
    terms of all. Items without a term in any document, and empty tables, give no rows. Other columns are ignored. Ids are integers.
    """
    asked = items.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).cast("binary").alias("text"))
    asked = staged(asked.mapInArrow(_item_terms, "item long, term binary").distinct(), "item-terms")
    vocabulary = asked.select("term").distinct()
    n_asked, size, n_items = asked.agg(F.count_distinct("term"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)), F.count_distinct("item")).first()
    few = n_asked <= most_terms and size <= BROADCAST_BYTES
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.term) for r in vocabulary.collect())) if few else None
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    index = staged(rows.mapInArrow(_indexer(wanted), INDEX), "index")
    n_docs, n_terms = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())

    each = index.select("shard", F.explode("postings").alias("p")).select("shard", "p.*")
    df = each.groupBy("term").agg((F.sum(F.octet_length("slots")) / 4).cast("long").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    owner = sum((F.col("df") >= F.lit(s * n_docs)).cast("int") for s in SHARES)
    n_blocks = int(n_items) // BUNDLE_ITEMS + 1
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int")
    weights = staged(asked.join(df, "term").select("item", "term", w.alias("w"), owner.alias("owner"), block.alias("block")), "weights")
    plans = weights.groupBy("block").applyInArrow(_plan, f"block int, {PLAN}")
    owned = weights.select("term", "owner", "block").distinct()
    postings = each.join(owned, "term").select("shard", "block", "owner", "term", "slots", "tfs")
    postings = staged(postings, "postings")

    # Every item bundle goes to every shard: the stated work. A bundle's plan is dealt to as many places as there are partitions.
    n_places = partitions(docs)
    starts = index.select("shard", "ids", "lengths", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.pmod(F.xxhash64("shard"), F.lit(n_places)).alias("place"))
    plans = plans.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_places - 1).cast("long"))))
    none = F.lit(b"")
    bundles = starts.join(plans.hint("merge"), ["block", "place"]).select(  # neither side has a bound for a broadcast
        "shard", "block", "ids", "lengths", "items", "terms", none.alias("at_item"), none.alias("at_doc"), none.alias("score"), none.alias("least"))
    for stage in range(len(SHARES) + 1):
        mine = postings.where(F.col("owner") == stage).select("shard", "block", "term", "slots", "tfs")
        bundles = bundles.groupBy("shard", "block").cogroup(mine.groupBy("shard", "block")).applyInArrow(_stage(stage, n_docs, n_terms, k), BUNDLE)
    found = bundles.mapInArrow(_best(k), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE = f"""
with t as (select rid, doc_id, unnest(words) as term from (select row_number() over () as rid, doc_id, {SQL_WORDS.format("text")} as words from documents) x),
n as (select rid, doc_id, count(*) as n from t group by all), total as (select count(*) as docs, sum(n)::bigint as terms from n),
i as (select distinct item_id, unnest({SQL_WORDS.format("text")}) as term from benchmark),
tf as (select rid, term, count(*) as tf from t where term in (select term from i) group by all),
df as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tf cross join total group by term, docs),
m as (select rid, doc_id, 100 - 90 + ((90 * n * docs) // terms) as m from n cross join total),
s as (select item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from i join tf using (term) join df using (term) join m using (rid) group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls first)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""


@query("op11_pipelined_term_search", ORACLE)
def op11(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
