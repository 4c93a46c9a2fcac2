"""Conversation structure repair by depth-first branch-and-bound.

Rows are put in the order of their conversation by a range partition and cut into chunks of bounded size. For each chunk an
explicit stack is searched depth first from every role state in which it may be entered: a suffix lower bound and the incumbent
(cost, audit) of each state in which it may be left cut branches off, and a dominance table per node, that is, per row and
state, eliminates prefixes that another prefix of the node beats; when the stack is empty the incumbents are proved. The costs
of a conversation's chunks are then folded from the last to the first and its states chosen from the first to the last. No
task holds the texts of more than a chunk, and a hot conversation's chunks are searched in many tasks.

A chunk's audit ends with the edit of a row, so insertions stand before the next row; therefore of two audits of a chunk none
begins with the other, and the least of equal cost is found chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.llm.base import partitions, query, staged, table
from palimp.session import ship_by_value

ship_by_value(__name__)

#: Rows and text characters of a chunk at most; a longer text makes a chunk alone. The rows bound the search, whose worst case
#: (all rows of one role and truncated) takes 12 ms for 16 rows and 190 ms for 32.
CHUNK_ROWS, CHUNK_CHARS = 16, 4 << 20
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: what a prefix of the repaired conversation ends with; only nothing and an assistant may end it.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
REACHED = {NOTHING: (NOTHING, SYSTEM, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (USER, ASSISTANT)}
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Insertions that end a conversation in an allowed state.
TAIL = {NOTHING: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
LEGAL = ("su", "ua", "au")
NEVER = 1 << 60

CHUNK = ("conv_id long, part int, no long, roles array<string>, texts array<string>, copies array<long>, costs array<long>, ranks array<int>, "
         "audits array<string>, illegal long, first string, last string")
CHOICE = "part int, no long, entry int, leave int, cost long, tail string"
PIECE = "conv_id long, part int, no long, audit string, repaired string, n_repaired long, cost long, illegal long, first string, last string"
REPAIRED = "conv_id long, illegal long, cost long, audit string, repaired_sha256 string"


def search(rows: list[tuple[str, str, int]], entry: int) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) for each state in which rows (role initial, fault, copies) can be left, entered in ``entry``.

    Faults are blank, duplicate, truncated or none; of several copies all but the first are deleted.
    """
    n = len(rows)
    lower = [0] * (n + 1)  # what the rows from here on cost at least, whatever the roles
    for i in range(n - 1, -1, -1):
        _, fault, copies = rows[i]
        least = DELETE if fault in ("blank", "duplicate") else TRUNCATED if fault == "truncated" else 0
        lower[i] = lower[i + 1] + least + DELETE * (copies - 1)
    incumbent: dict[int, tuple[int, str]] = {}
    table_: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if all(y in incumbent and incumbent[y][0] < cost + lower[i] for y in REACHED[state]):
            continue
        seen = table_.get((i, state))
        if seen is not None and seen <= (cost, audit):
            continue
        table_[i, state] = cost, audit
        if i == n:
            incumbent[state] = cost, audit
            continue
        initial, fault, copies = rows[i]
        extra, more = "D" * (copies - 1), DELETE * (copies - 1)
        # The most promising branch is pushed last, so that it is followed first.
        stack.append((i, NEXT[state], cost + INSERT, audit + "I"))
        stack.append((i + 1, state, cost + DELETE + more, audit + "D" + extra))
        if fault in ("blank", "duplicate"):
            continue
        keep = cost + more + (TRUNCATED if fault == "truncated" else 0)
        stack.append((i + 1, NEXT[state], keep + REROLE, audit + "R" + extra))
        if (state, initial) in KEPT:
            stack.append((i + 1, KEPT[state, initial], keep, audit + "K" + extra))
    return incumbent


def _chunk(conv: int | None, part: int, no: int, rows: list[dict], starts: bool) -> dict:
    light = [(r["role"][:1], r["fault"], r["copies"]) for r in rows]
    costs, ranks, audits = [NEVER] * 16, [0] * 16, [""] * 16
    for entry in (NOTHING,) if starts else range(4):
        found = search(light, entry)
        for leave, (cost, audit) in found.items():
            costs[4 * entry + leave], audits[4 * entry + leave] = cost, audit
        for rank, leave in enumerate(sorted(found, key=lambda y: found[y][1])):
            ranks[4 * entry + leave] = rank
    initials = [x[0] for x in light]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])) + sum(c - 1 for i, _, c in light)  # a copy repeats its initial
    return {"conv_id": conv, "part": part, "no": no, "roles": [r["role"] for r in rows], "texts": [r["text"] for r in rows],
            "copies": [r["copies"] for r in rows], "costs": costs, "ranks": ranks, "audits": audits, "illegal": illegal, "first": initials[0], "last": initials[-1]}


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in ddl.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _written(rows: Iterator[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their conversations to searched chunks."""

    def cut() -> Iterator[dict]:
        part, no, held, size, conv, seen, starts = TaskContext.get().partitionId(), 0, [], 0, None, False, False
        for row in _rows(batches):
            new = not held or row["conv_id"] != conv
            if held and (new or len(held) >= CHUNK_ROWS or size > CHUNK_CHARS):
                yield _chunk(conv, part, no, held, starts)
                # Only the first conversation of a partition may have begun in an earlier one.
                no, held, size, starts, seen = no + 1, [], 0, new, True
            elif new:
                starts = seen
            conv = row["conv_id"]
            held.append(row)
            size += len(row["text"])
        if held:
            yield _chunk(conv, part, no, held, starts)

    yield from _written(cut(), _schema(CHUNK), 16)


def _by_conversation(rows: Iterator[dict]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conv_id, its rows) of rows sorted by conversation; the rows must be read before the next conversation is asked for."""
    row = next(rows, None)

    def mine(conv) -> Iterator[dict]:
        nonlocal row
        while row is not None and row["conv_id"] == conv:
            yield row
            row = next(rows, None)

    while row is not None:
        yield row["conv_id"], mine(row["conv_id"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states in which each chunk of a conversation is entered and left."""

    def chosen() -> Iterator[dict]:
        for _, rows in _by_conversation(_rows(batches)):
            chunks = [(r["part"], r["no"], r["costs"], r["ranks"]) for r in rows]
            after = [INSERT * len(TAIL[y]) for y in range(4)]  # what follows costs at least, from each state
            suffix = [after]
            for _, _, costs, _ in reversed(chunks):
                after = [min(costs[4 * x + y] + after[y] for y in range(4)) for x in range(4)]
                suffix.append(after)
            state = NOTHING
            for i, (part, no, costs, ranks) in enumerate(chunks):
                after = suffix[len(chunks) - 1 - i]
                leave = min((y for y in range(4) if costs[4 * state + y] < NEVER), key=lambda y: (costs[4 * state + y] + after[y], ranks[4 * state + y]))
                tail = TAIL[leave] if i == len(chunks) - 1 else ""
                yield {"part": part, "no": no, "entry": state, "leave": leave, "cost": costs[4 * state + leave] + INSERT * len(tail), "tail": tail}
                state = leave

    yield from _written(chosen(), _schema(CHOICE))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their choice to the audit and the repaired rows of each."""

    def applied() -> Iterator[dict]:
        for chunk in _rows(batches):
            audit = chunk["audits"][4 * chunk["entry"] + chunk["leave"]] + chunk["tail"]
            state, at, left, lines = chunk["entry"], 0, 0, []
            for edit in audit:
                if edit == "I":
                    state = NEXT[state]
                    lines.append(f"{NAMES[state]}:")
                    continue
                if edit == "R":
                    state = NEXT[state]
                    lines.append(f"{NAMES[state]}:{chunk['texts'][at]}")
                elif edit == "K":
                    state = KEPT[state, chunk["roles"][at][:1]]
                    lines.append(f"{chunk['roles'][at]}:{chunk['texts'][at]}")
                left += 1
                if left == chunk["copies"][at]:
                    at, left = at + 1, 0
            yield {k: chunk[k] for k in ("conv_id", "part", "no", "cost", "illegal", "first", "last")} | {
                "audit": audit, "repaired": "\n".join(lines), "n_repaired": len(lines)}

    yield from _written(applied(), _schema(PIECE), 16)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of their conversations to one row per conversation; texts pass by and are not held."""

    def digested() -> Iterator[dict]:
        for conv, rows in _by_conversation(_rows(batches)):
            digest, audit, cost, illegal, before, any_line = hashlib.sha256(), [], 0, 0, None, False
            for r in rows:
                if r["n_repaired"]:
                    digest.update(("\n" if any_line else "").encode() + r["repaired"].encode())
                    any_line = True
                audit.append(r["audit"])
                cost += r["cost"]
                illegal += r["illegal"] + (before is not None and before + r["first"] not in LEGAL)
                before = r["last"]
            yield {"conv_id": conv, "illegal": illegal, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    yield from _written(digested(), _schema(REPAIRED))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the test damage, by crc32 of ``conv_id:turn`` modulo 20; nulls there, and in roles and texts, are one space."""
    space = F.lit(" ")
    said = lambda c: F.coalesce(F.col(c).cast("string"), space)
    h = F.pmod(F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")), F.lit(20))
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(h == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("col")


def _place(turn: Column) -> Column:
    """Turns in order, null first."""
    return F.struct(turn.isNotNull().alias("known"), turn.alias("turn"))


def faulty_rows(messages: DataFrame) -> DataFrame:
    """conv_id, turn, said, role, text, copies, fault: distinct rows, their number, and the first fault of the first of them.

    ``said`` is a digest of role and text. Groups are aggregated before they are shuffled, so that a row repeated any number of times is one row.
    """
    said = F.sha2(F.concat(F.sha2("role", 256), F.col("text")), 256).alias("said")
    rows = messages.select("conv_id", "turn", said, "role", "text").groupBy("conv_id", "turn", "said").agg(
        F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("copies"))
    rows = staged(rows, "rows")
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min(_place(F.col("turn"))).alias("place"))
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+\z", 1)
    fault = F.when(last == "", "blank").when(_place(F.col("turn")) > F.col("place"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("none")
    return joined.select("conv_id", "turn", "said", "role", "text", "copies", fault.alias("fault"))


def repaired(messages: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation of messages(conv_id, turn, role, text).

    Rows go by turn, null turns first; rows of one turn go by a digest of role and text, so that repeated rows are neighbours.
    Null roles and texts must have been replaced. A null conv_id is a conversation of its own. Turns that are null do not
    count for gaps. A role's first character is its initial; an empty role has none and can only be reroled or deleted. An
    empty table gives no rows. Other columns are ignored.
    """
    rows = staged(faulty_rows(messages), "faulty")
    of = lambda *faults: F.sum(F.when(F.col("fault").isin(*faults), 1).otherwise(0))
    again = F.sum(F.when(F.col("fault") != "blank", F.col("copies") - 1).otherwise(0))
    stats = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("fault") == "blank", F.col("copies")).otherwise(0)).alias("blank"), (of("duplicate") + again).alias("duplicate"), of("truncated").alias("truncated"))
    n = partitions(rows)
    ordered = rows.repartitionByRange(n, "conv_id", "turn", "said").sortWithinPartitions("conv_id", "turn", "said")
    chunks = staged(ordered.select("conv_id", "role", "text", "copies", "fault").mapInArrow(_chunks, CHUNK), "chunks")
    in_order = lambda df: df.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "no")
    choices = in_order(chunks.select("conv_id", "part", "no", "costs", "ranks")).mapInArrow(_choose, CHOICE)
    pieces = chunks.drop("costs", "ranks").join(choices, ["part", "no"]).mapInArrow(_apply, PIECE)
    found = in_order(pieces).mapInArrow(_digest, REPAIRED).withColumnRenamed("conv_id", "c")
    return stats.join(found, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def repair_report(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """``repaired(messages)`` with a row for every conv_id of ``conversations``: zeros, an empty audit and the digest of nothing where no row is left."""
    found = repaired(messages).withColumnRenamed("conv_id", "c")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), nothing)


ORACLE = r"""
with recursive bits as (select list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1]::bigint[], lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) as t
  from (select unnest(range(256)) as i) x),
k as (select *, concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) as key from conversations),
h as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 as h
  from k cross join bits),
d as (select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(range(case when h = 3 then 2 else 1 end)) as copy from h where h <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(concat(sha256(role), text)), copy) as i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last from d),
f as (select conv_id, turn, i, role, text, left(role, 1) as initial,
  case when last = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' else 'none' end as fault,
  coalesce(lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) not in ('su', 'ua', 'au'), false) as illegal from o),
pre(state, ins, mid, lines) as (values ('', '', '', []), ('s', '', 's', []), ('u', '', 'u', []), ('a', '', 'a', []), ('', 'I', 'u', ['user:']), ('s', 'I', 'u', ['user:']),
  ('u', 'I', 'a', ['assistant:']), ('a', 'I', 'u', ['user:']), ('', 'II', 'a', ['user:', 'assistant:']), ('s', 'II', 'a', ['user:', 'assistant:']),
  ('u', 'II', 'u', ['assistant:', 'user:']), ('a', 'II', 'a', ['user:', 'assistant:'])),
edit(mid, edit, initial, next, named) as (values ('', 'D', null, '', null), ('s', 'D', null, 's', null), ('u', 'D', null, 'u', null), ('a', 'D', null, 'a', null),
  ('', 'R', null, 'u', 'user'), ('s', 'R', null, 'u', 'user'), ('u', 'R', null, 'a', 'assistant'), ('a', 'R', null, 'u', 'user'),
  ('', 'K', 's', 's', null), ('', 'K', 'u', 'u', null), ('s', 'K', 'u', 'u', null), ('a', 'K', 'u', 'u', null), ('u', 'K', 'a', 'a', null)),
dp(conv_id, i, state, cost, audit, lines) as (select distinct conv_id, 0::bigint, '', 0::bigint, '', []::varchar[] from f
  union all select conv_id, i, next, cost, audit, lines from (
    select dp.conv_id, f.i, edit.next, dp.cost + 3 * length(ins) + case edit when 'D' then 4 when 'R' then 3 else 0 end + case when edit <> 'D' and fault = 'truncated' then 3 else 0 end as cost,
      concat(audit, ins, edit) as audit, list_concat(list_concat(dp.lines, pre.lines), case when edit = 'D' then [] else [concat(coalesce(named, role), ':', text)] end) as lines
    from dp join f on f.conv_id = dp.conv_id and f.i = dp.i + 1 join pre on pre.state = dp.state
    join edit on edit.mid = pre.mid and (edit.initial is null or edit.initial = f.initial) and (edit = 'D' or fault not in ('blank', 'duplicate'))) x
    qualify row_number() over (partition by conv_id, next order by cost, audit) = 1),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
  count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal, max(i) as n from f group by conv_id),
e as (select * from (select dp.conv_id, cost + case state when 'u' then 3 when 's' then 6 else 0 end as cost, concat(audit, case state when 'u' then 'I' when 's' then 'II' else '' end) as audit,
  list_concat(lines, case state when 'u' then ['assistant:'] when 's' then ['user:', 'assistant:'] else [] end) as lines from dp join g on g.conv_id = dp.conv_id and g.n = dp.i) x
  qualify row_number() over (partition by conv_id order by cost, audit) = 1)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join g on g.conv_id = c.conv_id left join e on e.conv_id = c.conv_id
"""


@query("op13_branch_and_bound_repair", ORACLE)
def op13(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(conversations, damaged(conversations))
