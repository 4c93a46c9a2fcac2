"""Chat formatting by linking quotations.

Lines that begin with '>' quote another message; the number of '>' is the level. Consecutive lines of one level are a
passage. Passages are normalised and hashed, and joined to what messages say themselves (their whole own text, their
paragraphs and their lines). The first message of the conversation that said it is the original. A passage that is none of
these, as a trimmed quote, is taken apart into sentences, and the first message that said all of them is the original. A
message replies to the original of its outermost quoted passage. Messages then stand below what they answer, without the quotes.
Everything is DataFrame functions; no group of rows is gathered, so a conversation of any size stays spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimp.llm.base import BLANKS, partitions, query, staged, table, text_of

#: The run of '>' that begins a quoted line, and a quoted line. '^' is the start of a line, "\\n" alone ends one. No pattern
#: repeats a group, so that quotations and runs of '>' may be of any length.
MARK = r"(?md)^[ \t]*+(>[> \t]*+)"
QUOTED = r"(?md)^[ \t]*+>[^\n]*+(?:\n|\z)"
#: What is between paragraphs.
PARAGRAPH = r"\n[ \t\r]*\n"


def level_of(mark: Column) -> Column:
    return F.length(F.regexp_replace(mark, "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, BLANKS, " ")))


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def quoted_passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, digest, bare: the distinct quoted passages of each message: runs of lines of one level.
    A digest that stands in several layouts of lines has a row for each. The lines of a message are numbered and grouped as rows."""
    quoting = messages.where(F.col("text").rlike(MARK)).select("conv_id", "turn", "text", F.monotonically_increasing_id().alias("message"))
    lines = staged(quoting, "quoting").select("message", "conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.select("message", "conv_id", "turn", "at", level_of(F.regexp_extract("line", MARK, 1)).alias("level"), F.regexp_replace("line", MARK, "").alias("bare"))
    order = Window.partitionBy("message").orderBy("at")  # the lines of one message
    starts = (F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(-1))).cast("long")
    runs = lines.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order)).where("level > 0")
    passage = F.array_sort(F.collect_list(F.struct("at", "bare")))
    found = runs.groupBy("message", "conv_id", "turn", "level", "run").agg(F.array_join(F.transform(passage, lambda x: x["bare"]), "\n").alias("bare"))
    bare = F.col("bare")
    return found.where(normalised(bare) != "").select("conv_id", "turn", "level", digest(bare).alias("digest"), "bare").distinct()


def own_passages(messages: DataFrame) -> DataFrame:
    """conv_id, digest, turn: the first turn of a conversation in which a passage was said, not quoted."""
    parts = F.split(F.regexp_replace("text", QUOTED, "\n\n"), PARAGRAPH)
    own = F.regexp_replace("text", QUOTED, "")
    units = F.concat(F.array(own), parts, F.split(own, "\n"))
    said = messages.select("conv_id", "turn", F.explode(units).alias("unit")).where(normalised(F.col("unit")) != "")
    return said.groupBy("conv_id", digest(F.col("unit")).alias("digest")).agg(F.min("turn").alias("said"))


def _units(parts: Column) -> Column:
    """The distinct digests of texts that have a word."""
    return F.array_distinct(F.transform(F.filter(parts, lambda x: normalised(x) != ""), digest))


def line_sentences(text: Column) -> Column:
    """The sentences of each line."""
    return _units(F.split(text, r"\n|(?<=[.!?])[ \t\r]+"))


def paragraph_sentences(text: Column) -> Column:
    """The sentences of each paragraph, however its lines are broken."""
    joined = F.transform(F.split(text, PARAGRAPH), normalised)
    return _units(F.flatten(F.transform(joined, lambda x: F.split(x, "(?<=[.!?]) "))))


def trimmed_passages(messages: DataFrame, quotes: DataFrame) -> DataFrame:
    """conv_id, digest, said: the first turn that said all sentences of a quoted passage, in its lines or in its paragraphs.

    Turns are looked up by the sentence that the fewest turns said, then asked for the others.
    """
    same_conv = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    kinds = F.array(line_sentences(F.col("bare")), paragraph_sentences(F.col("bare")))
    passages = quotes.select("conv_id", "digest", "bare").distinct().select("conv_id", "digest", F.explode(kinds).alias("units")).distinct()
    passages = passages.withColumn("id", F.sha2(F.to_json(F.struct("conv_id", "digest", "units")), 256))
    wanted = staged(passages.select("conv_id", "digest", "id", F.size("units").alias("n"), F.explode("units").alias("unit")), "wanted")
    quoting = messages.where("turn is not null").alias("m").join(quotes.select("conv_id").distinct().alias("q"), same_conv("m", "q"), "left_semi")
    text = F.regexp_replace("text", QUOTED, "\n\n")
    own = quoting.select("conv_id", "turn", F.explode(F.array_union(line_sentences(text), paragraph_sentences(text))).alias("unit"))
    of_unit = same_conv("w", "o") & (F.col("w.unit") == F.col("o.unit"))
    own = own.alias("o").join(wanted.select("conv_id", "unit").distinct().alias("w"), of_unit, "left_semi").distinct()
    own = staged(own, "own")
    turns = own.groupBy("conv_id", "unit").agg(F.count("*").alias("turns"))
    rarest = wanted.alias("w").join(turns.alias("o"), of_unit).groupBy("w.conv_id", "digest", "id", "n").agg(
        F.count("*").alias("known"), F.min(F.struct("turns", "w.unit"))["unit"].alias("unit")).where("known = n")
    tried = rarest.alias("w").join(own.alias("o"), of_unit).select("w.conv_id", "digest", "id", "n", "turn")
    asked = tried.alias("t").join(wanted.alias("w"), F.col("t.id") == F.col("w.id")).select("t.*", "w.unit")
    said = asked.alias("w").join(own.alias("o"), of_unit & (F.col("w.turn") == F.col("o.turn")), "left_semi")
    whole = said.groupBy("conv_id", "digest", "id", "n", "turn").agg(F.count("*").alias("found")).where("found = n")
    return whole.groupBy("conv_id", "digest").agg(F.min("turn").alias("said"))


def thread_messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, parent_turn, depth, thread, n_quoted, n_linked, formatted: one row per message.

    ``thread`` is the path of turns from the first message of the thread to this one; ordered by it, a conversation reads in
    order of replies: each message below what it answers, before later threads. The rows are in that order.
    A message that quotes nothing, or nothing that an earlier turn of its conversation said, begins a thread of its own.
    Of several linked passages the outermost level counts, then the latest original. Null text is empty; a null
    conversation is one of its own kind and null turns are not linked and come first; rows that repeat a turn are all
    kept and share its place. An empty table gives no rows. Other columns are ignored.
    """
    messages = conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), text_of(conversations).alias("text"))
    quotes, own = staged(quoted_passages(messages), "quotes"), own_passages(messages)
    trimmed = trimmed_passages(messages, quotes)
    said_before = lambda x: (
        F.col("q.conv_id").eqNullSafe(F.col(f"{x}.conv_id")) & (F.col("q.digest") == F.col(f"{x}.digest")) & (F.col(f"{x}.said") < F.col("q.turn")))
    linked = (
        quotes.drop("bare").distinct().alias("q").join(own.alias("o"), said_before("o"), "left").join(trimmed.alias("t"), said_before("t"), "left")
        .select("q.conv_id", "q.turn", "q.level", F.coalesce("o.said", "t.said").alias("said"))
    )
    order = F.struct((-F.col("level")).alias("level"), F.col("said"))
    replies = linked.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quoted"), F.count("said").alias("n_linked"),
        F.max(F.when(F.col("said").isNotNull(), order))["said"].alias("parent_turn"),
    )
    replies = staged(replies, "replies")
    paths = _paths(replies.where("parent_turn is not null").select("conv_id", "turn", "parent_turn"))
    info = replies.join(paths, [replies["conv_id"].eqNullSafe(paths["p_conv"]), replies["turn"] == paths["p_turn"]], "left")
    info = info.select(*[F.col(c).alias(f"r_{c}") for c in ("conv_id", "turn", "n_quoted", "n_linked", "parent_turn", "path")])
    content = F.btrim(F.regexp_replace("text", QUOTED, ""), F.lit(" \t\r\n"))
    rows = messages.join(info, [F.col("conv_id").eqNullSafe(F.col("r_conv_id")), F.col("turn") == F.col("r_turn")], "left")
    rows = rows.select(
        "conv_id", "turn", "role", content.alias("content"), F.col("r_parent_turn").alias("parent_turn"),
        (F.size(F.coalesce("r_path", F.array("turn"))) - 1).alias("depth"), F.coalesce("r_path", F.array("turn")).alias("thread"),
        F.coalesce("r_n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("r_n_linked", F.lit(0)).alias("n_linked"),
    )
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("content"), F.lit("\n"))
    rows = rows.withColumn("formatted", formatted)
    return rows.repartitionByRange(partitions(rows), "conv_id", "thread").sortWithinPartitions("conv_id", "thread")


def _paths(parents: DataFrame) -> DataFrame:
    """p_conv, p_turn, path of turns from the thread's first message for every reply, by doubling: a path ends at an ``up``
    turn that is still a reply until it is not, and each step joins the path of that turn in front, so a chain of n
    replies takes log2(n) steps."""
    up = F.when(F.col("parent_turn").isNotNull(), F.col("parent_turn"))
    paths = parents.select(F.col("conv_id").alias("p_conv"), F.col("turn").alias("p_turn"), up.alias("up"), F.array("turn").alias("path"))
    while True:
        above = paths.select(F.col("p_conv").alias("a_conv"), F.col("p_turn").alias("a_turn"), F.col("up").alias("a_up"), F.col("path").alias("a_path"))
        step = paths.join(above, [F.col("p_conv").eqNullSafe(F.col("a_conv")), F.col("up") == F.col("a_turn")], "left")
        paths = staged(step.select(
            "p_conv", "p_turn",
            # Where the turn above is a reply, go on from what it hangs on; where it begins a thread, it closes the path.
            F.when(F.col("a_turn").isNotNull(), F.col("a_up")).alias("up"),
            F.when(F.col("a_turn").isNotNull(), F.concat("a_path", "path"))
            .when(F.col("up").isNotNull(), F.concat(F.array("up"), F.col("path"))).otherwise(F.col("path")).alias("path"),
        ), "paths")
        if paths.where("up is not null").isEmpty():
            return paths.select("p_conv", "p_turn", "path")


ORACLE = r"""
with m as (select conv_id, turn, role, coalesce(text, '') as text, row_number() over () as rid from conversations),
l as (select rid, conv_id, turn, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from m),
v as (select *, length(regexp_replace(regexp_extract(line, '^[ \t]*(>[> \t]*)', 1), '[^>]', '', 'g')) as level from l),
g as (select *, sum(case when level is distinct from prev then 1 else 0 end) over (partition by rid order by i) as run
  from (select *, lag(level) over (partition by rid order by i) as prev from v) x),
p as (select rid, conv_id, turn, level, trim(regexp_replace(lower(string_agg(regexp_replace(line, '^[ \t]*>[> \t]*', ''), ' ' order by i)), '[\x20\x09-\x0D]+', ' ', 'g')) as body
  from g group by rid, conv_id, turn, level, run),
q as (select distinct conv_id, turn, level, body from p where level > 0 and body <> ''),
o as (select rid, conv_id, turn, trim(string_agg(case when level = 0 then line else null end, chr(10) order by i), E' \t\r\n') as content from g group by rid, conv_id, turn),
w as (select conv_id, turn, lower(trim(regexp_replace(content, '[\x20\x09-\x0D]+', ' ', 'g'))) as body from o
  union all select conv_id, turn, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) from v where level = 0
  union all select conv_id, turn, body from p where level = 0),
s as (select conv_id, body, min(turn) as said from w where body <> '' group by conv_id, body),
k as (select q.conv_id, q.turn, q.level, s.said from q left join s on q.conv_id = s.conv_id and q.body = s.body and s.said < q.turn),
r as (select conv_id, turn, count(*) as n_quoted, count(said) as n_linked,
  (list(said order by level, said desc) filter (where said is not null))[1] as parent_turn from k group by conv_id, turn),
t as (with recursive t(conv_id, turn, up, path) as (select conv_id, turn, parent_turn, [turn] from r
  union all select t.conv_id, t.turn, r.parent_turn, list_prepend(t.up, t.path) from t left join r on r.conv_id = t.conv_id and r.turn = t.up where t.up is not null)
  select conv_id, turn, path from t where up is null)
select m.conv_id, m.turn, m.role, coalesce(o.content, '') as content, r.parent_turn, len(coalesce(t.path, [m.turn])) - 1 as depth, coalesce(t.path, [m.turn]) as thread,
  coalesce(r.n_quoted, 0) as n_quoted, coalesce(r.n_linked, 0) as n_linked,
  concat('<|', coalesce(m.role, ''), '|>', chr(10), coalesce(o.content, ''), chr(10)) as formatted
from m left join o using (rid) left join r on r.conv_id = m.conv_id and r.turn = m.turn left join t on t.conv_id = m.conv_id and t.turn = m.turn
"""


@query("op9_quotation_linking", ORACLE)
def op9(spark, sf_dir: str) -> DataFrame:
    return thread_messages(table(spark, sf_dir, "conversations"))
