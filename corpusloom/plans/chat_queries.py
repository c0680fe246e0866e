"""Queries on conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import encode
from corpusloom.operators import chat, evaluate, shards
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

MAX_LEN, BATCH = 3000, 8

_CODES = "list_transform(string_split({0}, ''), lambda c: unicode(c))"
#: Ids and labels of every message, then of every conversation.
RENDERED = f"""
with m as (
  select conv_id, turn, role, {_CODES.format("'<|' || role || '|>' || chr(10)")} as p, case when text = '' then [] else {_CODES.format('text')} end as b,
         case when role = 'assistant' then [] else [10] end as s, case when role = 'assistant' then [2] else [] end as z from conversations
), each as (
  select conv_id, turn, p || b || s || z as ids,
         list_transform(p, lambda x: -100) || case when role = 'assistant' then b else list_transform(b, lambda x: -100) end || list_transform(s, lambda x: -100) || z as labels from m
), chat as (select conv_id, flatten(list(ids order by turn)) as ids, flatten(list(labels order by turn)) as labels from each group by conv_id)
"""
_SUM = "list_sum(list_transform({0}, lambda x, i: cast(x as bigint) * i))::bigint"


def conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def rendered(spark, sf_dir):
    return chat.render(conversations(spark, sf_dir))


def sums(df, *keys):
    """Sizes and checksums instead of arrays."""
    each = [shards.checksum(F.col(c), F.lit(0)).alias(n) for c, n in (("input_ids", "ids"), ("labels", "masked"))]
    return df.select(*keys, F.size("input_ids").cast("long").alias("n"), *each)


@query("select conv_id, count(*) as turns, string_agg(role, ',' order by turn) as roles from conversations group by conv_id")
def s7_chat_scan(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return conversations(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(ordered, lambda m: m["role"]), ",").alias("roles"))


@query(RENDERED + f"select conv_id, len(ids) as n, {_SUM.format('ids')} as ids, {_SUM.format('labels')} as masked from chat")
def c1_render_chat(spark, sf_dir):
    return sums(rendered(spark, sf_dir), "conv_id")


@query(RENDERED + f"select conv_id, len(ids) as n, {_SUM.format('ids')} as ids, {_SUM.format('labels')} as masked from chat where len(ids) <= {MAX_LEN}")
def f6_length_filter(spark, sf_dir):
    return sums(chat.fitting(rendered(spark, sf_dir), MAX_LEN), "conv_id")


@query(f"""
with q as (select conv_id, turn, text, case when conv_id % 2 = 0 then 'Be brief.' end as sys from conversations where role = 'user'),
r as (select conv_id, turn, {_CODES.format("case when sys is not null then '<|system|>' || chr(10) || sys || chr(10) else '' end || '<|user|>' || chr(10) || text || chr(10) || '<|assistant|>' || chr(10)")} as ids from q)
select conv_id, turn, len(ids) as n, {_SUM.format('ids')} as ids from r
""")
def c2_prompt_ids(spark, sf_dir):
    asked = conversations(spark, sf_dir).where("role = 'user'")
    ids = chat.prompt_ids(F.col("text"), system=F.when(F.col("conv_id") % 2 == 0, F.lit("Be brief.")))
    return asked.select("conv_id", "turn", F.size(ids).cast("long").alias("n"), shards.checksum(ids, F.lit(0)).alias("ids"))


_BATCHED = RENDERED + f""", numbered as (select *, row_number() over (order by conv_id) - 1 as k, count(*) over () as c from chat where len(ids) <= {MAX_LEN}),
batched as (select *, k // {BATCH} as batch_id, cast(k % {BATCH} as integer) as row from numbered where k < c // {BATCH} * {BATCH}),
sized as (select *, max(len(ids)) over (partition by batch_id) as m from batched)
"""


def batched(spark, sf_dir):
    return chat.batches(chat.fitting(rendered(spark, sf_dir), MAX_LEN), BATCH)


@query(_BATCHED + "select batch_id, row, conv_id from batched")
def c4_batches(spark, sf_dir):
    return batched(spark, sf_dir).select("batch_id", "row", "conv_id")


@query(_BATCHED + f"select batch_id, row, m as n, {_SUM.format('ids')} as ids, {_SUM.format('(labels || list_transform(range(m - len(ids)), lambda x: -100))')} as masked from sized")
def c3_padded(spark, sf_dir):
    return sums(chat.padded(batched(spark, sf_dir)), "batch_id", "row")


@query(RENDERED + """
select conv_id, count(*) as n, sum(label)::bigint as total, cast(min(position) as integer) as first, bool_and(id = label) as coherent
from (select conv_id, unnest(ids) as id, unnest(labels) as label, generate_subscripts(ids, 1) - 1 as position from chat) where label <> -100 group by conv_id
""")
def c5_unmasked(spark, sf_dir):
    found = chat.unmasked(rendered(spark, sf_dir))
    return found.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("total"), F.min("position").alias("first"), F.bool_and(F.col("id") == F.col("label")).alias("coherent"))


#: Ids of a request: 40 of continuation behind the rest as context.
TAIL, ROOM, LAST = 40, 100, 64


def _requests(spark, sf_dir):
    ids = encode.code_points(F.col("text"))
    n = F.greatest(F.size(ids) - TAIL, F.lit(0))
    return table(spark, sf_dir, "benchmark").select("item_id", ids.alias("ids"), F.slice(ids, 1, n).alias("context"), F.slice(ids, n + 1, TAIL).alias("continuation"))


@query(f"""
with r as (select item_id, {_CODES.format('text')} as ids from benchmark), s as (select item_id, ids[:greatest(len(ids) - {TAIL}, 0)] as c, ids[greatest(len(ids) - {TAIL}, 0) + 1:] as t from r),
u as (select item_id, case when len(c) + len(t) > {ROOM} then c[len(c) - ({ROOM} - len(t)) + 1:] else c end as c, t from s)
select item_id, len(c) as n, {_SUM.format('c')} as ids from u
""")
def c6_left_truncation(spark, sf_dir):
    cut = chat.left_truncated(F.col("context"), F.col("continuation"), ROOM)
    return _requests(spark, sf_dir).select("item_id", F.size(cut).cast("long").alias("n"), shards.checksum(cut, F.lit(0)).alias("ids"))


@query(f"""
with r as (select item_id, {_CODES.format('text')} as ids from benchmark), u as (select item_id, case when len(ids) > {LAST} then ids[len(ids) - {LAST} + 1:] else ids end as c from r)
select item_id, len(c) as n, {_SUM.format('c')} as ids from u
""")
def c7_context_clip(spark, sf_dir):
    cut = chat.last_ids(F.col("ids"), LAST)
    return _requests(spark, sf_dir).select("item_id", F.size(cut).cast("long").alias("n"), shards.checksum(cut, F.lit(0)).alias("ids"))


@query(f"""
with r as (select item_id as request, {_CODES.format('text')} as ids from benchmark), s as (select request, [1] || ids[:greatest(len(ids) - {TAIL}, 0)] as c, ids[greatest(len(ids) - {TAIL}, 0) + 1:] as t from r),
u as (select request, case when len(c) + len(t) > {ROOM} then c[len(c) - ({ROOM} - len(t)) + 1:] else c end as c, t, row_number() over (order by request) - 1 as k from s),
b as (select request, k // {BATCH} as batch_id, cast(k % {BATCH} as integer) as row, c || t as ids, len(c) as scored_from from u), m as (select *, max(len(ids)) over (partition by batch_id) as n from b)
select request, batch_id, row, cast(len(ids) as integer) as length, cast(scored_from as integer) as scored_from, n as padded, {_SUM.format('ids')} as checksum from m
""")
def e1_request_batches(spark, sf_dir):
    """Requests behind an opening id, cut from the left to the room there is, batched and padded."""
    asked = _requests(spark, sf_dir).select(F.col("item_id").alias("request"), F.concat(F.array(F.lit(1)), "context").alias("context"), "continuation")
    found = chat.request_batches(asked, ROOM, BATCH)
    return found.select("request", "batch_id", "row", "length", "scored_from", F.size("ids").cast("long").alias("padded"), shards.checksum(F.col("ids"), F.lit(0)).alias("checksum"))


@query(RENDERED.replace("'<|' || role || '|>' || chr(10)", "'[' || role || '] '") + f"select conv_id, len(ids) as n, {_SUM.format('ids')} as ids, {_SUM.format('labels')} as masked from chat")
def u5_role_templates(spark, sf_dir):
    """Conversations in another template."""
    other = {role: f"[{role}] " for role in ("system", "user", "assistant")}
    return sums(chat.render(conversations(spark, sf_dir), prefix=other), "conv_id")


@query("""
with p as (select conv_id, turn, text from conversations where role = 'user'), r as (select conv_id, turn - 1 as turn, text from conversations where role = 'assistant')
select conv_id, md5('# Samples' || chr(10) || chr(10) || string_agg('### ' || p.text || chr(10) || chr(10) || '> ' || replace(r.text, chr(10), chr(10) || '> ') || chr(10), chr(10) order by turn)) as digest
from p join r using (conv_id, turn) group by conv_id
""")
def k6_markdown_report(spark, sf_dir):
    turns = conversations(spark, sf_dir)
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    given = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    samples = asked.join(given, ["conv_id", "turn"]).withColumnRenamed("turn", "ord")
    return evaluate.report(samples, "Samples", "conv_id").select("conv_id", F.md5("markdown").alias("digest"))
