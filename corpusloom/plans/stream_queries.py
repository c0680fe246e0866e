"""Queries on the document stream: scans, encoders, shards, batches, mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import encode
from corpusloom.operators import mixture, order, shards
from corpusloom.plans.registry import query
from corpusloom.sources import sinks
from corpusloom.sources.scratch import written
from corpusloom.sources.sinks import scratch
from corpusloom.sources.tables import npy_shards, table, text_stream, token_count
from corpusloom.sources.tables import shards as read_shards
from corpusloom.streaming import watch

#: Tokens of the skipped prefix and of a shard; shards of the query that stops early.
SKIP, SIZE, MOST = 50_000, 100_000, 5
BATCH, LENGTH, CONTEXT = 4, 512, 2048

#: Target shares of the languages in the mixing queries, first of equals first.
MIX = [mixture.Entry("en", 0.45, 20_000), mixture.Entry("fr", 0.25), mixture.Entry("de", 0.2), mixture.Entry("es", 0.1)]

PLACED = f"""
with lens as (select doc_id, text, lang, length(text) + 1 as n from documents),
placed as (select *, coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as s from lens),
kept as (select * from placed where s >= {SKIP}),
moved as (select doc_id, text, n, cast(s - (select min(s) from kept) as bigint) as s from kept)
"""
#: Every token of the stream behind the prefix, with its position g.
TOKENS = PLACED + """,
tokens as (
  select doc_id, s + generate_subscripts(ids, 1) - 1 as g, unnest(ids) as token
  from (select doc_id, s, list_append(case when text = '' then [] else list_transform(string_split(text, ''), lambda c: unicode(c)) end, 2) as ids from moved)
)
"""
#: The same with nothing skipped.
ALL_TOKENS = TOKENS.replace(f"s >= {SKIP}", "s >= 0")
FULL = f"(select (max(g) + 1) // {SIZE} from tokens)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def ended() -> F.Column:
    return encode.with_end(encode.code_points(F.col("text")))


@query("select doc_id, source, cast(length(text) as bigint) as n from documents")
def s1_document_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", encode.code_point_count(F.col("text")).alias("n"))


@query("""
select doc_id, md5(t) as digest from (
  select doc_id, coalesce(nullif(case when doc_id % 3 = 0 then text else '' end, ''), nullif(case when doc_id % 3 = 1 then text end, ''),
                          nullif(case when doc_id % 5 = 0 then text end, '')) as t from documents) where t is not null
""")
def s2_text_fallback(spark, sf_dir):
    docs = documents(spark, sf_dir)
    renamed = docs.select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("").alias("text"),
        F.when(F.col("doc_id") % 3 == 1, F.col("text")).alias("content"), F.when(F.col("doc_id") % 5 == 0, F.col("text")).alias("raw_content"),
    )
    return text_stream(renamed).select("doc_id", F.md5("text").alias("digest"))


@query("select source, md5(arg_min(text, doc_id)) as digest, length(arg_min(text, doc_id)) > 0 as ok from documents group by source")
def s3_source_probe(spark, sf_dir):
    found = mixture.probe(table(spark, sf_dir, "documents"), "source", "doc_id")
    return found.select("source", F.md5("first").alias("digest"), "ok")


@query(TOKENS + f"select g // {SIZE} as shard_id, count(*) as n_tokens, sum(token)::bigint as token_sum from tokens where g // {SIZE} < {FULL} group by 1")
def k1_shard_writer(spark, sf_dir):
    """Shards written by folder and read again, each token widened."""
    cut, totals = shards.pack(documents(spark, sf_dir), SIZE, skip=SKIP)
    sinks.require_output(totals["shards_written"])
    path = scratch(spark, "shards")
    sinks.check_writable(spark, path)
    sinks.write_shards(cut, path)
    summed = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return read_shards(spark, path).groupBy(F.col("shard_id").cast("long").alias("shard_id")).agg(F.sum("length").alias("n_tokens"), F.sum(summed).alias("token_sum"))


@query(TOKENS + f"select g // {SIZE} as shard_id, count(*) as n_tokens, sum(token)::bigint as token_sum from tokens where g // {SIZE} < {FULL} group by 1")
def k1_npy_shards(spark, sf_dir):
    """Shards as flat .npy files, and read again."""
    path = scratch(spark, "npy")
    sinks.write_npy_shards(shards.pack(documents(spark, sf_dir), SIZE, skip=SKIP)[0], path, SIZE)
    summed = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    return npy_shards(spark, path).select(F.col("shard_id").cast("long").alias("shard_id"), F.size("tokens").cast("long").alias("n_tokens"), summed.alias("token_sum"))


@query(TOKENS + f"select g // {SIZE} as shard_id, count(*) as n_tokens from tokens where g // {SIZE} < {FULL} group by 1")
def s6_shard_token_count(spark, sf_dir):
    return token_count(shards.pack(documents(spark, sf_dir), SIZE, skip=SKIP)[0])


@query(ALL_TOKENS + """
select doc_id, sum(cast(token as bigint) * (g - first + 1))::bigint as checksum, count(*) as n
from (select *, min(g) over (partition by doc_id) as first from tokens) group by doc_id
""")
def f1_code_points(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", shards.checksum(ended(), F.lit(0)).alias("checksum"), F.size(ended()).cast("long").alias("n"))


@query("""
with w as (select doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')) as word, generate_subscripts(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> ''), 1) as place from documents),
v as (select word, row_number() over (order by c desc, word) + 2 as id from (select word, count(*) as c from w group by word order by c desc, word limit 1000))
select doc_id, count(*) as n, sum(coalesce(id, 0) * place)::bigint as checksum from w left join v using (word) group by doc_id
""")
def f1_dictionary_ids(spark, sf_dir):
    docs = documents(spark, sf_dir)
    ids = encode.dictionary_ids(docs, encode.vocabulary(docs, 1000))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), shards.checksum(F.col("ids"), F.lit(0)).alias("checksum"))


@query("select doc_id, doc_id % 50 as id, 1 + doc_id % 7 as n, (doc_id % 50) * (1 + doc_id % 7) as total from documents")
def f2_repeated_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", F.col("doc_id") % 50, 1 + F.col("doc_id") % 7).alias("text"))
    ids = encode.repeated_id(F.col("text"))
    return docs.select("doc_id", F.get(ids, F.lit(0)).cast("long").alias("id"), F.size(ids).cast("long").alias("n"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("select doc_id, cast(length(text) + 1 as bigint) as n, 2 as last from documents")
def f4_end_id(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(ended()).cast("long").alias("n"), F.element_at(ended(), -1).alias("last"))


@query("select doc_id from documents where text is not null and text <> '' and doc_id % 4 <> 0")
def f5_non_empty(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("text")).otherwise("").alias("text"))
    return text_stream(docs).select("doc_id")


@query("select doc_id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) as digest from documents")
def f11_decode(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(encode.decode(ended())).alias("digest"))


@query(PLACED + "select doc_id, s as start, n from moved")
def o1_prefix_skip(spark, sf_dir):
    placed, totals = order.place(shards.measured(documents(spark, sf_dir)), "n", "doc_id")
    return shards.skip_prefix(placed, SKIP, totals[None])[0].select("doc_id", "start", "n")


@query(TOKENS + f"""
select g // {SIZE} as shard_id, count(distinct doc_id) as n_docs, count(*) as n_tokens, min(doc_id) as first_doc, max(doc_id) as last_doc,
       sum(cast(token as bigint) * (g % {SIZE} + 1))::bigint as checksum
from tokens where g // {SIZE} < {FULL} group by 1
""")
def o2_pack_token_shards(spark, sf_dir):
    return shards.shard_summary(shards.pack(documents(spark, sf_dir), SIZE, skip=SKIP)[0])


@query()
def o2_tokenizer_shards(spark, sf_dir):
    """Shards of a real tokenizer's ids, where its vocabulary files are installed: the texts are tokenised once."""
    import public_tokenizers

    path = scratch(spark, "ids")
    ids = encode.tokenizer_ids(public_tokenizers.path("word_bpe_49k.json"))(documents(spark, sf_dir))
    ids.withColumn("n", F.size("ids").cast("long")).write.parquet(path)
    cut, _ = shards.pack(spark.read.parquet(path), SIZE, skip=SKIP, count=F.col("n"))
    return shards.shard_summary(cut, encode.with_end(F.col("ids")))


@query(PLACED + f"select count(*) as docs, sum(n)::bigint as tokens from moved where s < {MOST * SIZE}")
def o5_early_stop(spark, sf_dir):
    placed, totals = order.place(shards.measured(documents(spark, sf_dir)), "n", "doc_id")
    drawn = shards.skip_prefix(placed, SKIP, totals[None])[0].where(F.col("start") < MOST * SIZE)
    return drawn.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


#: Prefix and length of the held-out split.
HELD_SKIP, HELD = 10_000, 20_000


@query(TOKENS.replace("from documents)", "from documents where lang = 'fr')").replace(f"s >= {SKIP}", f"s >= {HELD_SKIP}") + f"""
select 0 as shard_id, count(distinct doc_id) as n_docs, count(*) as n_tokens, sum(cast(token as bigint) * (g + 1))::bigint as checksum
from tokens where g < {HELD} having count(*) = {HELD}
""")
def o6_heldout_split(spark, sf_dir):
    one = documents(spark, sf_dir).where("lang = 'fr'")
    found = shards.shard_summary(shards.pack(one, HELD, 1, HELD_SKIP)[0])
    return found.select(F.col("shard_id").cast("int").alias("shard_id"), "n_docs", "n_tokens", "checksum")


def _placed(spark, sf_dir):
    placed, totals = order.place(shards.measured(documents(spark, sf_dir)), "n", "doc_id")
    return placed, totals[None]


def _rows(cut: DataFrame) -> DataFrame:
    position = F.col("row_id") * (LENGTH + 1) + F.col("offset")
    part = shards.checksum(shards.span_ids(), position)
    return cut.withColumn("part", part).groupBy("batch_id", "row").agg(F.sum("length").alias("n_tokens"), F.sum("part").alias("checksum"))


#: Tokens of a batch, and all that the stream's full batches hold.
_BATCH = BATCH * (LENGTH + 1)
_FILLED = f"(select (max(g) + 1) // {_BATCH} * {_BATCH} from tokens)"


@query(ALL_TOKENS + f"""
select g // {_BATCH} as batch_id, cast(g // {LENGTH + 1} % {BATCH} as integer) as row, count(*) as n_tokens,
       sum(cast(token as bigint) * (g + 1))::bigint as checksum
from tokens where g < {_FILLED} group by 1, 2
""")
def o7_batches(spark, sf_dir):
    placed, total = _placed(spark, sf_dir)
    return _rows(shards.batch_rows(placed, total, BATCH, LENGTH, shards.full_batches(total, BATCH, LENGTH), max_epochs=1))


#: Tokens before the end at which the wrapping query begins; it reads a whole epoch and two batches more.
BACK = 3000


@query(ALL_TOKENS + f""", total as (select max(g) + 1 as n from tokens),
read as (select token, n, (g + {BACK}) % n + lap * n as p from tokens, total, (select unnest(range(3)) as lap))
select p // {_BATCH} as batch_id, cast(p // {LENGTH + 1} % {BATCH} as integer) as row, cast(min((p + n - {BACK}) // n) as bigint) as first_epoch,
       cast(max((p + n - {BACK}) // n) as bigint) as last_epoch, sum(cast(token as bigint) * (p + 1))::bigint as checksum
from read where p < (n // {_BATCH} + 2) * {_BATCH} group by 1, 2
""")
def o8_epoch_wrap(spark, sf_dir):
    placed, total = _placed(spark, sf_dir)
    cut = shards.batch_rows(placed, total, BATCH, LENGTH, shards.full_batches(total, BATCH, LENGTH) + 2, offset=total - BACK)
    part = shards.checksum(shards.span_ids(), F.col("row_id") * (LENGTH + 1) + F.col("offset"))
    return cut.withColumn("part", part).groupBy("batch_id", "row").agg(F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"), F.sum("part").alias("checksum"))


#: A reader that stopped after so many batches.
READ = 3 * _BATCH


@query(ALL_TOKENS + f"""
select (g - {READ}) // {_BATCH} as batch_id, cast((g - {READ}) // {LENGTH + 1} % {BATCH} as integer) as row, count(*) as n_tokens,
       sum(cast(token as bigint) * (g - {READ} + 1))::bigint as checksum
from tokens where g >= {READ} and g < {_FILLED} group by 1, 2
""")
def o9_resume(spark, sf_dir):
    placed, total = _placed(spark, sf_dir)
    state = shards.Position.at(READ, SIZE, max(1, total // SIZE))
    offset = state.offset(SIZE, max(1, total // SIZE))
    return _rows(shards.batch_rows(placed, total, BATCH, LENGTH, shards.full_batches(total, BATCH, LENGTH, offset), offset))


_WINDOWS = TOKENS + f""", w as (select g // {SIZE} as shard_id, g % {SIZE} // {CONTEXT} as window_id, g % {SIZE} % {CONTEXT} as p, token from tokens
  where g // {SIZE} < {FULL} and g % {SIZE} // {CONTEXT} < {SIZE // CONTEXT})
"""


@query(_WINDOWS + "select shard_id, window_id, count(*) as n_tokens, count(*) - 1 as n_targets, sum(cast(token as bigint) * (p + 1))::bigint as checksum from w group by 1, 2")
def o11_score_windows(spark, sf_dir):
    cut = shards.pack(documents(spark, sf_dir), SIZE, skip=SKIP)[0]
    windows = shards.score_windows(cut, SIZE, CONTEXT)
    part = shards.checksum(shards.span_ids(), F.col("offset"))
    return windows.withColumn("part", part).groupBy("shard_id", "window_id").agg(F.sum("length").alias("n_tokens"), (F.sum("length") - 1).alias("n_targets"), F.sum("part").alias("checksum"))


@query(_WINDOWS + f"""
select shard_id, window_id, sum(cast(token as bigint) * (p + 1)) filter (p < {CONTEXT - 1})::bigint as inputs, sum(cast(token as bigint) * p) filter (p > 0)::bigint as targets from w group by 1, 2
""")
def o12_causal_shift(spark, sf_dir):
    """Windows put together (each a bounded row) and split into inputs and targets."""
    cut = shards.score_windows(shards.pack(documents(spark, sf_dir), SIZE, skip=SKIP)[0], SIZE, CONTEXT)
    each = cut.select("shard_id", "window_id", F.struct("offset", shards.span_ids().alias("ids")).alias("part"))
    whole = each.groupBy("shard_id", "window_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    rows = whole.select("shard_id", "window_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    inputs, targets = shards.shifted(F.col("ids"))
    return rows.select("shard_id", "window_id", shards.checksum(inputs, F.lit(0)).alias("inputs"), shards.checksum(targets, F.lit(0)).alias("targets"))


@query("""
with r as (select source as run, count(*) as steps, sum(coalesce(length(text), 0) + 1)::bigint as uniq from documents group by source)
select run, cast(steps as bigint) * 4 * 2048 as processed, cast(steps as bigint) * 4 * 2049 as consumed, uniq * 4 >= steps * 4 * 2048 as enough from r
""")
def o13_preflight(spark, sf_dir):
    """A run over each source's tokens in four epochs: a step a document, four rows a step."""
    runs = shards.measured(table(spark, sf_dir, "documents")).groupBy(F.col("source").alias("run")).agg(F.count("*").alias("steps"), F.sum("n").alias("uniq"))
    found = shards.sufficiency(F.col("uniq"), F.col("steps"), F.lit(1), F.lit(4), F.lit(2048), F.lit(4))
    return runs.select("run", *[c.cast("boolean" if k == "enough" else "long").alias(k) for k, c in found.items()])


@query()
def o14_file_watch(spark, sf_dir):
    """A folder of checkpoint files watched twice: the second pass finds only what is new."""
    events = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    folder, seen = scratch(spark, "watched"), scratch(spark, "handled")
    checkpoint = scratch(spark, "checkpoint")

    def handle(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(seen)

    for turn in range(2):
        events.where(F.pmod(F.hash("event_type"), F.lit(2)) == turn).write.mode("append").json(folder)
        watch.watch(watch.files_as_they_come(spark, folder, "*.json"), checkpoint, handle).awaitTermination()
    return spark.read.parquet(seen).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "batch")


def _mixed(spark, sf_dir, most: int | None = None):
    docs = shards.measured(documents(spark, sf_dir))
    return mixture.mix(docs, MIX, "lang", max_tokens=most)


def _weight(k: int) -> str:
    return f"cast({mixture.normalised(MIX)[k].weight!r} as double)"


_DRAWS = f"""
with recursive lens as (select doc_id, lang, length(text) + 1 as n from documents),
placed as (select *, coalesce(sum(n) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) as s from lens),
own as (select doc_id, lang, n, row_number() over (partition by lang order by doc_id) - 1 as k from placed
  where s >= case lang {' '.join(f"when '{e.name}' then {e.skip}" for e in MIX)} end),
size as (select {', '.join(f"count(*) filter (lang = '{e.name}') as c{i}" for i, e in enumerate(MIX))} from own),
draw as (
  select cast(-1 as bigint) as rank, cast(0 as bigint) as total, cast(0 as bigint) as start, {', '.join(f"cast(0 as bigint) as e{i}, cast(0 as bigint) as p{i}" for i in range(len(MIX)))}, cast(null as bigint) as doc_id, cast(null as varchar) as lang, cast(0 as bigint) as n
  union all
  select d.rank + 1, d.total + o.n, d.total, {', '.join(f"d.e{i} + case when d.pick = {i} then o.n else 0 end, d.p{i} + case when d.pick = {i} then 1 else 0 end" for i in range(len(MIX)))}, o.doc_id, o.lang, cast(o.n as bigint)
  from (
    select *, case {' '.join(f"when v{i} = greatest({', '.join(f'v{j}' for j in range(len(MIX)))}) then {i}" for i in range(len(MIX)))} end as pick
    from (select draw.*, {', '.join(f"case when p{i} < c{i} then {_weight(i)} * total - e{i} else cast('-infinity' as double) end as v{i}" for i in range(len(MIX)))} from draw, size) x
  ) d join own o on o.lang = case d.pick {' '.join(f"when {i} then '{e.name}'" for i, e in enumerate(MIX))} end
    and o.k = case d.pick {' '.join(f"when {i} then d.p{i}" for i in range(len(MIX)))} end
)
"""


@query(_DRAWS + "select rank, doc_id, lang, n, start from draw where rank >= 0")
def o3_mixture(spark, sf_dir):
    return _mixed(spark, sf_dir).select("rank", "doc_id", "lang", "n", "start")


@query(_DRAWS + f"""
select lang, sum(n)::bigint as tokens, count(*) as docs, round(sum(n) / (select sum(n) from draw where rank >= 0), 9) as share
from draw where rank >= 0 group by lang
""")
def o4_mixture_shares(spark, sf_dir):
    found = mixture.shares(_mixed(spark, sf_dir), "lang")
    return found.select("lang", "tokens", "docs", F.round("share", 9).alias("share"))


@query(_DRAWS + f""",
tokens as (
  select doc_id, s + generate_subscripts(ids, 1) - 1 as g, unnest(ids) as token from (
    select d.doc_id, d.start as s, list_append(case when text = '' then [] else list_transform(string_split(text, ''), lambda c: unicode(c)) end, 2) as ids from draw d join documents using (doc_id) where d.rank >= 0)
)
select g // {SIZE} as shard_id, count(distinct doc_id) as n_docs, count(*) as n_tokens, min(doc_id) as first_doc, max(doc_id) as last_doc,
       sum(cast(token as bigint) * (g % {SIZE} + 1))::bigint as checksum
from tokens where g // {SIZE} < {FULL} group by 1
""")
def o3_mixture_shards(spark, sf_dir):
    """The mixed stream packed into shards, through a written shard folder and its manifest."""
    cut, totals = mixture.packed(_mixed(spark, sf_dir), SIZE)
    sinks.require_output(totals["shards_written"])
    path = scratch(spark, "mixed")
    sinks.write_shards(cut, path)
    sinks.write_manifest(spark, f"{path}-manifest", **totals, weights={e.name: e.weight for e in MIX})
    part = shards.checksum(F.col("ids"), F.col("offset"))
    return read_shards(spark, path).withColumn("part", part).groupBy(F.col("shard_id").cast("long").alias("shard_id")).agg(
        F.count("*").alias("n_docs"), F.sum("length").alias("n_tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum("part").alias("checksum"),
    )


@query("""
with r as (select lang as source, sum(length(text))::double as weight from documents where lang is not null group by lang)
select source, round(weight / sum(weight) over (), 9) as share from r
""")
def f7_weights(spark, sf_dir):
    """Shares of the languages by their characters; the driver holds a number for each."""
    held = documents(spark, sf_dir).where("lang is not null").groupBy("lang").agg(F.sum(encode.code_point_count(F.col("text"))).cast("double").alias("n"))
    found = mixture.normalised([mixture.Entry(r["lang"], r["n"]) for r in held.collect()])
    return spark.createDataFrame([(e.name, e.weight) for e in found], "source string, weight double").select("source", F.round("weight", 9).alias("share"))


@query(TOKENS + f"select cast({FULL} as bigint) as shards_written, cast({FULL} * {SIZE} as bigint) as tokens_written, cast((select min(s) from kept) as bigint) as tokens_skipped")
def a10_manifest_totals(spark, sf_dir):
    """Totals of a packing run, through the manifest that it writes."""
    _, totals = shards.pack(documents(spark, sf_dir), SIZE, skip=SKIP)
    path = scratch(spark, "manifest")
    sinks.write_manifest(spark, path, **totals)
    back = sinks.read_manifest(spark, path)
    names = ["shards_written", "tokens_written", "tokens_skipped"]
    return spark.createDataFrame([tuple(back[k] for k in names)], ", ".join(f"{k} long" for k in names))


@query(TOKENS + f"""
select cast(shard_id as bigint) as shard_id, cast(row_number() over (order by format('{{:04d}}', shard_id)) - 1 as integer) as position, n_docs
from (select g // {SIZE} as shard_id, count(distinct doc_id) as n_docs from tokens where g // {SIZE} < {FULL} group by 1)
""")
def s4_shard_scan(spark, sf_dir):
    """A written shard folder's shards by zero-padded name, as a reader takes them."""
    path = scratch(spark, "shards")
    sinks.write_shards(shards.pack(documents(spark, sf_dir), SIZE, skip=SKIP)[0], path)
    held = read_shards(spark, path).groupBy(F.col("shard_id").cast("long").alias("shard_id")).agg(F.count_distinct("doc_id").alias("n_docs"))
    # A row per shard, which is read for the order and once more where rows meet their position.
    held = written(held, "held")
    # Names in their own order as numbers: digits filled up on the right, then the length.
    name = "lpad(cast(shard_id as string), greatest(4, length(cast(shard_id as string))), '0')"
    named = held.withColumns({"_name": F.expr(f"cast(rpad({name}, 16, '0') as long) * 100 + length({name})"), "_one": F.lit(1).cast("long")})
    placed, _ = order.place(named, "_one", "_name")
    return placed.select("shard_id", F.col("start").cast("int").alias("position"), "n_docs")


@query(TOKENS + f"""
select g // {SIZE} as shard_id, count(*) as n_tokens, count(*) = {SIZE} as is_full, count(*) // {CONTEXT} as windows, count(*) % {CONTEXT} as tail from tokens group by 1
""")
def a11_shard_tails(spark, sf_dir):
    """Every shard of the stream, the partial last one too, and what its windows leave over."""
    placed, totals = order.place(shards.measured(documents(spark, sf_dir)), "n", "doc_id")
    cut = shards.spans(shards.skip_prefix(placed, SKIP, totals[None])[0], SIZE, "shard_id")
    n = F.col("n_tokens")
    return token_count(cut).select("shard_id", "n_tokens", (n == SIZE).alias("is_full"), F.floor(n / CONTEXT).cast("long").alias("windows"), (n % CONTEXT).alias("tail"))
