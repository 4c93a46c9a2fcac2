"""Exact top-k inner products with MaxScore.

Components of a query are its terms and its weights; a shard holds, for each term, the largest and smallest value in it,
which bound what the term can add to any score. The terms are ordered by bound. Once a threshold is known, a suffix of
small terms whose bounds together cannot lift a row over it is non-essential: it is only read for rows that are still
competitive after the essential terms. Shards return at most k rows per query and are merged by a second top-k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimp.llm.base import query, staged, table
from palimp.session import ship_by_value

ship_by_value(__name__)

#: Rows of a shard, queries of a block, and blocks that meet a shard in one task; they bound what a task holds.
SHARD_ROWS, BLOCK_ROWS, GROUP_BLOCKS = 4096, 256, 16
#: The largest integer component. A product of vectors of 2048 such components is still a 64-bit integer.
LARGEST = 1 << 26


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; vectors that are null or hold a null or a non-finite component are left out.

    A component beyond LARGEST after scaling raises an error, as scores might not be integers of 64 bits then."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    far = F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("bigint")
    whole = lambda c: F.when(F.abs(c * scale) > LARGEST, far).otherwise(F.floor(c * scale))
    rows = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).where(~bad)
    return rows.select(F.col(key).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def search_shard(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k best ids of one shard for each query, ties to smaller ids, never the query itself.
    An id that repeats counts by its best row."""
    order = np.argsort(ids, kind="stable")
    lead_rows = k + len(ids) - len(np.unique(ids))  # so many rows hold k ids at least
    ids, columns = ids[order], np.ascontiguousarray(rows[order].T)  # a posting list per term
    high, low = columns.max(axis=1), columns.min(axis=1)
    found = []
    for query_id, q in zip(query_ids.tolist(), queries):
        bound = np.maximum(q * high, q * low)
        terms = np.argsort(np.minimum(q * high, q * low) - bound, kind="stable")  # widest effect on the score first
        rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])  # the most that terms from here on can add
        mine = ids != query_id
        alive = np.flatnonzero(mine)
        score = np.zeros(len(alive), dtype=np.int64)
        threshold = np.iinfo(np.int64).min
        for step in range(0, len(terms), 8):
            block = terms[step : step + 8]
            few = len(alive) < len(ids) // 2  # then only the competitive rows are probed
            score = score + (q[block] @ columns[np.ix_(block, alive)] if few else (q[block] @ columns[block])[alive])
            done = step + len(block)
            if len(alive) <= lead_rows:
                continue
            # Full scores of the rows that lead so far: the last of the result is no lower than the lowest of them.
            lead = alive[np.argpartition(-score, lead_rows - 1)[:lead_rows]]
            threshold = max(threshold, int((q @ columns[:, lead]).min()))
            keep = score + rest[done] >= threshold
            if not keep.all():
                alive, score = alive[keep], score[keep]
        best = np.lexsort((ids[alive], -score))
        if lead_rows > k:
            best = best[np.sort(np.unique(ids[alive[best]], return_index=True)[1])]
        best = best[:k]
        found += [(query_id, int(ids[alive[i]]), int(score[i])) for i in best]
    return found


def _search(k: int):
    def search(shards: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        for s in range(shards.num_rows):
            ids = np.frombuffer(shards["ids"][s].as_py(), dtype=np.int64)
            rows = np.frombuffer(shards["data"][s].as_py(), dtype=np.int64).reshape(len(ids), -1)
            for b in range(blocks.num_rows):
                query_ids = np.frombuffer(blocks["ids"][b].as_py(), dtype=np.int64)
                queries = np.frombuffer(blocks["data"][b].as_py(), dtype=np.int64).reshape(len(query_ids), -1)
                if queries.shape[1] == rows.shape[1]:
                    out += search_shard(ids, rows, query_ids, queries, k)
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    return search


def _pack(group: pa.Table) -> pa.Table:
    """One row with the ids and the integer matrix of a shard or block, as bytes."""
    ids = group["vec_id"].to_numpy()
    data = np.array(group["v"].combine_chunks().flatten()).astype(np.int64)
    return pa.table({"part": group["part"].slice(0, 1), "dim": group["dim"].slice(0, 1), "ids": [ids.astype(np.int64).tobytes()], "data": [data.tobytes()]})


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query by inner product, ties to smaller ids; all, if fewer.

    Both sides have vec_id and an integer array ``v`` (see ``integer_vectors``). A query is never its own candidate. Vectors
    of different length never meet. Of rows that repeat an id, queries or candidates, the best score of each pair of ids
    counts. Empty tables, and tables without a usable vector, give no rows. Other columns are ignored.
    """
    packed = "part long, dim int, ids binary, data binary"

    def parts(df: DataFrame, rows: int, label: str) -> DataFrame:
        df = df.select("vec_id", "v").distinct().withColumn("dim", F.size("v"))
        n = max(1, -(-df.count() // rows))
        part = F.pmod(F.xxhash64("vec_id"), F.lit(n))
        return staged(df.withColumn("part", part).groupBy("part", "dim").applyInArrow(_pack, packed), label)

    shards, blocks = parts(candidates, SHARD_ROWS, "shards"), parts(queries, BLOCK_ROWS, "blocks")
    # Every query block goes to every shard, which is the stated work: blocks of queries against all rows, some blocks at a time.
    n_groups = -(-blocks.count() // GROUP_BLOCKS) or 1
    blocks = blocks.withColumn("turn", F.pmod(F.xxhash64("part"), F.lit(n_groups)))
    targets = shards.select(F.col("part").alias("shard"), F.col("dim").alias("shard_dim")).distinct()
    work = blocks.join(targets, F.col("dim") == F.col("shard_dim")).select("shard", "shard_dim", "turn", "ids", "data")
    shards = shards.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))
    pairs = shards.groupBy("part", "dim", "turn").cogroup(work.groupBy("shard", "shard_dim", "turn"))
    found = pairs.applyInArrow(_search(k), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@query("op6_maxscore_top_k", ORACLE)
def op6(spark, sf_dir: str) -> DataFrame:
    vectors = staged(integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))
