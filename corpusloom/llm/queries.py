"""The training-data queries: each applies one operator to its whole table.

`QUERIES` maps a name to a function of (spark, sf_dir); `ORACLES` maps the names that SQL
can express to DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, divergence, langid, lexical, neighbours, packing, quality, rules, simhash, substrings, toolcalls, training_order, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """The vocabulary file that the packing and materialisation queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Each word of each document, numbered from one.
_WORDS = r"""
with split as (
  select doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i, len(ws) as n from split)
"""

ORACLES["op2_substrings"] = _WORDS + """,
windows as (
  select *, case when i <= n - 19 then string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 19 following) end as k from words
), firsts as (
  select *, k is not null and row_number() over (partition by k order by doc_id, i) > 1 as later from windows
), cut as (
  select *, bool_or(later) over (partition by doc_id order by i rows between 19 preceding and current row) as gone from firsts
)
select s.doc_id, count(c.i) as n_words, count(c.i) filter (gone) as n_removed, sha256(coalesce(string_agg(word, ' ' order by i) filter (not gone), '')) as kept_sha256
from split s left join cut c using (doc_id) group by s.doc_id
"""

ORACLES["op6_decontamination"] = r"""
with folded as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
items as (select cast(item_id as varchar) as item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from benchmark where text is not null),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i, len(ws) as n from folded),
item_words as (select item, unnest(ws) as word, generate_subscripts(ws, 1) as i, len(ws) as n, least(10, len(ws)) as size from items),
wanted as (
  select distinct item, size, k from (select *, string_agg(word, ' ') over (partition by item, n order by i rows between current row and size - 1 following) as k from item_words) where i <= n - size + 1
), found as (
  select doc_id, i, w.size, item from (
    select d.*, s.size, string_agg(word, ' ') over (partition by doc_id, s.size order by i rows between current row and s.size - 1 following) as k
    from words d, (select distinct size from wanted) s
  ) w join wanted using (size, k) where w.i <= w.n - w.size + 1
), hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from (select distinct doc_id, i, size from found)) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from found) group by doc_id)
select f.doc_id, len(f.ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from folded f left join hit using (doc_id) left join named using (doc_id)
"""

ORACLES["op10_quality_rules"] = _WORDS + r""",
windows as (
  select *, case when i <= n - 4 then string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 4 following) end as k, word = lag(word) over (partition by doc_id order by i) as same from words
), counted as (select *, k is not null and count(*) over (partition by doc_id, k) > 1 as twice from windows),
covered as (select *, bool_or(twice) over (partition by doc_id order by i rows between 4 preceding and current row) as rep from counted),
sums as (select doc_id, sum(length(word))::bigint as chars, count(*) filter (rep) as rep, count(*) filter (same) as same from covered group by doc_id),
lined as (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
m as (
  select s.doc_id, len(ws) as n_words, coalesce(chars, 0) as word_chars, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(rep, 0) as n_repeat_words, len(lines) as n_lines, coalesce(same, 0) as same,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '\p{Lu}', '', 'g')) as capitals
  from split s join lined using (doc_id) left join sums using (doc_id)
), b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or n_symbols > 0.1 * n_words or capitals > 0.4 * word_chars or n_dup_lines > 0.5 * n_lines or same > 0.3 * n_words
            or word_chars < 2 * n_words or word_chars > 20 * n_words) as kept
from b
"""


@query
def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written shards hold, read back in training order."""
    layout = training_order.materialise(table(spark, sf_dir, "documents"), word_tokenizer())
    back = training_order.read(spark, layout)
    return back.select("slot", "sequence_id", "shard", "byte_offset", "doc_id", "start", F.col("n_ids").cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"))


@query
def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.from_turns(table(spark, sf_dir, "conversations"))
    found = toolcalls.link(calls, results, toolcalls.TOOLS)
    return found.select("conv_id", "call_id", "order_key", "status", "n_missing", F.array_join("errors", "; ").alias("errors"), F.sha2("json", 256).alias("json_sha256"))


ORACLES["op3_tool_calls"] = """
with recursive calls as (
  select conv_id, turn, text, conv_id || ':' || turn as call_id, (conv_id + turn) % 5 as kind,
         list_filter(case conv_id % 4 when 0 then [before] when 1 then [behind] when 2 then [before, behind] else [before, conv_id || ':' || turn, 'none'] end, lambda x: x is not null) as after
  from (select *, case when turn >= 2 then conv_id || ':' || (turn - 2) end as before, conv_id || ':' || (turn + 2) as behind from conversations where role = 'user')
), results as (
  select conv_id, conv_id || ':' || (turn - 1) as call_id, turn, text as content from conversations where role = 'assistant'
), needs as (select conv_id, call_id, unnest(after) as need from calls),
edges as (select n.* from needs n join calls c on c.conv_id = n.conv_id and c.call_id = n.need where n.need <> n.call_id),
missing as (
  select n.conv_id, n.call_id, count(*) as n_missing from needs n
  where n.need = n.call_id or not exists (select 1 from calls c where c.conv_id = n.conv_id and c.call_id = n.need) group by 1, 2
), size as (select conv_id, count(*) as n from calls group by conv_id),
walk as (
  select conv_id, call_id, cast(turn as bigint) as key, 0 as steps from calls
  union
  select e.conv_id, e.call_id, w.key + 1, w.steps + 1 from walk w join edges e on e.conv_id = w.conv_id and e.need = w.call_id join size s on s.conv_id = w.conv_id where w.steps < s.n
), keys as (
  select w.conv_id, call_id, case when max(steps) < any_value(n) then max(key) end as order_key from walk w join size s using (conv_id) group by w.conv_id, call_id
), linked as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, case when c.call_id is null then r.turn else k.order_key end as order_key,
         case when c.call_id is null then 'orphan' when r.call_id is null then 'pending' else 'linked' end as status,
         c.text, c.turn, c.kind, c.call_id is null as orphan, r.content, coalesce(m.n_missing, 0) as n_missing
  from calls c left join keys k using (conv_id, call_id) left join missing m using (conv_id, call_id) full join results r on c.conv_id = r.conv_id and c.call_id = r.call_id
)
select conv_id, call_id, cast(order_key as bigint) as order_key, status, cast(n_missing as bigint) as n_missing,
       case when orphan then ''
            when kind = 4 then concat_ws('; ', case conv_id % 3 when 0 then 'limit: below 1' when 2 then 'limit: not integer' end, case when text is null then 'query: missing' when text = '' then 'query: below 1' end)
            when kind = 3 then case when conv_id % 2 = 0 then 'unknown tool' else 'not an object' end
            when text is null then 'prompt: missing' when text = '' then 'prompt: below 1' else '' end as errors,
       sha256('{' || concat_ws(',',
         case when orphan then null
              when kind = 4 then '"arguments":{"limit":' || case conv_id % 3 when 2 then '"many"' else cast(conv_id % 3 as varchar) end || case when text is not null then ',"query":' || to_json(text) else '' end || '}'
              when kind = 3 then case when conv_id % 2 = 0 then '"arguments":{}' when text is not null then '"arguments":{"raw":' || to_json(text) || '}' end
              else '"arguments":{' || concat_ws(',', case when text is not null then '"prompt":' || to_json(text) end, '"turn":' || turn) || '}' end,
         '"id":' || to_json(call_id), case when not orphan then '"name":"' || case kind when 4 then 'search' when 3 then 'lookup' else 'reply' end || '"' end,
         case when content is not null then '"result":' || to_json(content) end, '"status":"' || status || '"') || '}') as json_sha256
from linked
"""


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.measure(table(spark, sf_dir, "documents"))


@query
def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_lexical_search"] = r"""
with d as (select doc_id, row_number() over () as id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
size as (select id, doc_id, len(ws) as n from d where len(ws) > 0),
whole as (select count(*)::bigint as docs, sum(n)::bigint as total from size),
items as (select item_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term from benchmark where text is not null),
times as (select item_id, term, count(*) as k from items group by item_id, term),
tf as (select id, term, count(*) as tf from (select id, unnest(ws) as term from d) where term in (select term from times) group by id, term),
weight as (select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double)) as bigint) as w from (select term, count(*) as df from tf group by term), whole),
impact as (select id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)) as i from tf join size using (id), whole),
score as (select item_id, id, cast(sum(k * w * i) as bigint) as score from times join weight using (term) join impact using (term) group by item_id, id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from score join size using (id) where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20
"""


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t, row_number() over () as id from documents),
w as (select lang, source, id, unnest(list_filter(regexp_split_to_array(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term from d),
kept as (select lang, term, count(*) as lang_n from w group by lang, term having count(distinct id) >= 10),
size as (select lang, count(*) as v, sum(lang_n) as n from kept group by lang),
grp as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by lang, source, term),
whole as (select g.lang, g.source, coalesce(sum(c.n), 0) as n from grp g left join c using (lang, source) group by g.lang, g.source),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (wh.n + 2 * s.v) as p, 1 + (1000000000::hugeint * (k.lang_n + 2)) // (s.n + 2 * s.v) as q
  from grp g join kept k using (lang) join size s using (lang) join whole wh using (lang, source) left join c using (lang, source, term)
), pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3
), every as (
  select a.lang, a.source, b.source as item, coalesce(value, 0) as value from grp a join grp b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
), ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from every
  union all
  select * from (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value, row_number() over (partition by lang, source order by (p - q) * (p - q) // (p + q) desc, term) as rank from p where n > 0 and p > q) where rank <= 10
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked
"""
