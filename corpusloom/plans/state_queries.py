"""Queries on saved and carried state: checkpoints, streams that go on, generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import fewshot, generate, order, shards
from corpusloom.plans import stream_queries as stream
from corpusloom.plans.registry import query
from corpusloom.sources import sinks, tensors
from corpusloom.sources.sinks import scratch
from corpusloom.sources.tables import npy_shards, table
from corpusloom.streaming import batches, packing, upload

#: Rows of a slice, and the bytes of a container file and of a read, small enough to have several of each.
SLICE, PART = 16, 20_000


def _tensors(spark, sf_dir, where: str = "true") -> DataFrame:
    """The embeddings as one tensor per label, rows by vec_id."""
    rows = table(spark, sf_dir, "embeddings").where(where).select("vec_id", "embedding", "label", F.lit(1).cast("long").alias("one"))
    placed, totals = order.place(rows, "one", "vec_id", "label")
    total = F.lit(0).cast("long")
    for label, n in totals.items():
        total = F.when(F.col("label") == label, n).otherwise(total)
    named = placed.select(F.format_string("embedding/%d", "label").alias("name"), total.alias("total"), "start", "embedding")
    return tensors.packed(named, "name", "total", "start", "embedding", rows=SLICE)


def _digest(slices: DataFrame) -> DataFrame:
    whole = F.aggregate(F.transform("row", lambda x, k: F.floor(x * 1_000_000).cast("long") * (k + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return tensors.rows_of(slices).groupBy("name").agg(F.count("*").alias("n"), F.sum((F.col("at") + 1) * whole).alias("checksum"))


_ROWS = """
with e as (select 'embedding/' || label as name, embedding, row_number() over (partition by label order by vec_id) as place from embeddings),
v as (select name, place, cast(list_sum(list_transform(range(1, len(embedding) + 1), lambda k: cast(floor(cast(embedding[k] as double) * 1000000) as bigint) * k)) as bigint) as whole from e)
"""


@query(_ROWS + "select name, count(*) as n, cast(sum(place * whole) as bigint) as checksum from v group by name")
def k7_checkpoint_save(spark, sf_dir):
    """Two checkpoints, mirrored; the last one is read back, from the mirror."""
    path = scratch(spark, "checkpoint")
    tensors.save(_tensors(spark, sf_dir, "label < 5"), path, 1, mirror=f"{path}-mirror", part_bytes=PART, source="embeddings")
    tensors.save(_tensors(spark, sf_dir), path, 2, mirror=f"{path}-mirror", part_bytes=PART, source="embeddings")
    return _digest(tensors.load(spark, f"{path}-mirror"))


@query(_ROWS + "select name, count(*) as n, cast(sum(place * whole) as bigint) as checksum from v where name in ('embedding/2', 'embedding/7') and place > 5 and place <= 40 group by name")
def s12_checkpoint_load(spark, sf_dir):
    """Rows 5 to 40 of two tensors, by name: their byte ranges alone are read."""
    path = scratch(spark, "checkpoint")
    tensors.save(_tensors(spark, sf_dir), path, 1, part_bytes=PART)
    return _digest(tensors.load(spark, path, names=["embedding/2", "embedding/7"], rows=(5, 40), read_bytes=2_000))


@query(stream.TOKENS + f"""
select g // {stream.SIZE} as shard_id, count(distinct doc_id) as n_docs, count(*) as n_tokens, min(doc_id) as first_doc, max(doc_id) as last_doc,
       sum(cast(token as bigint) * (g % {stream.SIZE} + 1))::bigint as checksum
from tokens where g // {stream.SIZE} < {stream.FULL} group by 1
""")
def o2_incremental(spark, sf_dir):
    """The shards of a corpus that arrives in three parts, with a restart of the stream after each."""
    docs = stream.documents(spark, sf_dir)
    # A part's worth of order values, not of rows: where the cuts lie makes no difference.
    cuts = [float("-inf"), *docs.approxQuantile("doc_id", [1 / 3, 2 / 3], 0.01), float("inf")]
    folder, target, checkpoint = (scratch(spark, name) for name in ("arriving", "placed", "checkpoint"))
    lengths = shards.measured(docs).select(F.lit("documents").alias("stream"), "doc_id", "n")
    for low, high in zip(cuts, cuts[1:], strict=False):
        lengths.where((F.col("doc_id") > low) & (F.col("doc_id") <= high)).write.mode("append").parquet(folder)
        packing.place(spark.readStream.schema(lengths.schema).parquet(folder), target, checkpoint).awaitTermination()
    placed, totals = packing.placements(spark, target)
    moved, _, left = shards.skip_prefix(placed, stream.SKIP, totals["documents"])
    full = left // stream.SIZE
    cut = shards.spans(moved.where(F.col("start") < full * stream.SIZE), stream.SIZE, "shard_id").where(F.col("shard_id") < full)
    return shards.shard_summary(cut.drop("stream").join(docs, "doc_id"))


_READ = stream.BATCH * (stream.LENGTH + 1)


@query(stream.TOKENS + f""", whole as (select * from tokens where g < {stream.FULL} * {stream.SIZE}), n as (select count(*) as n from whole)
select g // {_READ} as batch_id, cast(g // {stream.LENGTH + 1} % {stream.BATCH} as integer) as row, count(*) as n_tokens, sum(cast(token as bigint) * (g % {stream.LENGTH + 1} + 1))::bigint as checksum
from whole, n where g < n // {_READ} * {_READ} group by 1, 2
""")
def o10_prefetch(spark, sf_dir):
    """Batches of written shards, read as a stream that is stopped twice and goes on."""
    folder, target, checkpoint = (scratch(spark, name) for name in ("npy", "batches", "checkpoint"))
    sinks.write_npy_shards(shards.pack(stream.documents(spark, sf_dir), stream.SIZE, skip=stream.SKIP)[0], folder, stream.SIZE)
    for until in (3 * _READ, 10 * _READ + 7, None):
        rows = batches.read(spark, folder, stream.BATCH, stream.LENGTH, until=until)
        rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    read = spark.read.parquet(target)
    return read.select("batch_id", "row", F.size("tokens").cast("long").alias("n_tokens"), shards.checksum(F.col("tokens"), F.lit(0)).alias("checksum"))


#: Examples, ids of a request, and words of an item that are its answer.
SHOTS, MOST, ANSWER = 4, 600, 3


def _solved(spark, sf_dir) -> DataFrame:
    """Benchmark items as questions, their last words the answer."""
    words = F.split("text", " ")
    cut = F.greatest(F.size(words) - ANSWER, F.lit(0))
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    return table(spark, sf_dir, "benchmark").select("item_id", part(F.lit(1), cut).alias("question"), part(cut + 1, F.lit(ANSWER)).alias("answer"))


@query(f"""
with w as (select item_id, string_split(text, ' ') as ws, row_number() over (order by item_id) - 1 as number, count(*) over () as total from benchmark),
s as (select item_id, number, total, array_to_string(ws[:greatest(len(ws) - {ANSWER}, 0)], ' ') as question, array_to_string(ws[greatest(len(ws) - {ANSWER}, 0) + 1:], ' ') as answer from w),
strides as (select list(p order by i) as ps from (select unnest({list(fewshot.STRIDES)}::bigint[]) as p, generate_subscripts({list(fewshot.STRIDES)}::bigint[], 1) as i), (select max(total) as n from s) where (n - 1) % p <> 0),
d as (select number, nth, (number + 1 + (((number + 1) * 2654435761 % 2147483647) % (total - 1) + nth * (ps[number % len(ps) + 1] % (total - 1))) % (total - 1)) % total as other
      from s, strides, (select unnest(range({SHOTS})) as nth)),
x as (select d.number, string_agg(o.question || ' ' || o.answer, chr(10) || chr(10) order by nth) || chr(10) || chr(10) as head, string_agg(cast(d.other as varchar), ',' order by nth) as shots from d join s o on o.number = d.other group by d.number),
r as (select item_id, shots, head || question as context, ' ' || answer as continuation from s join x using (number))
select item_id, shots, cast(length(context) as bigint) as n_context, cast(length(continuation) as bigint) as n_continuation,
       md5(right(context, cast(greatest(0, least(length(context), {MOST} - length(continuation))) as integer)) || continuation) as digest from r
""")
def e10_few_shot(spark, sf_dir):
    """Requests of four examples and a question, cut from the left; decoded again to be compared."""
    found, _ = fewshot.contexts(_solved(spark, sf_dir), SHOTS)
    asked = fewshot.requests(found, MOST).join(found.select("item_id", F.length("context").cast("long").alias("n_context")), "item_id")
    char = lambda ids: F.array_join(F.transform(ids, lambda x: F.decode(F.unhex(F.lpad(F.hex(x), 8, "0")), "UTF-32")), "")
    whole = char(F.concat("context", "continuation"))
    return asked.select("item_id", F.array_join(F.col("shots").cast("array<string>"), ",").alias("shots"), "n_context", F.size("continuation").cast("long").alias("n_continuation"), F.md5(whole).alias("digest"))


#: New characters at most, choices of a context.
NEW, TOP = 12, 20


@query(f"""
with recursive ch as (select case when text = '' then [] else string_split(text, '') end as c from documents where text is not null),
pos as (select unnest(list_append(c, '')) as nxt, unnest((['', '', ''] || c)[:len(c) + 1]) || unnest((['', ''] || c)[:len(c) + 1]) || unnest([''] || c) as context from ch),
long as (select context, nxt, count(*) as n from pos group by 1, 2),
cnt as (select right(context, cast(k as integer)) as context, nxt, sum(n)::bigint as n from (select *, unnest(range(0, length(context) + 1)) as k from long) group by 1, 2),
top as (select * from (select *, row_number() over (partition by context order by n desc, nxt) as place from cnt) where place <= {TOP}),
cum as (select *, sum(n) over (partition by context order by place) as upto, sum(n) over (partition by context) as total from top),
choice as (select context, list(struct_pack(nxt := nxt, upto := cast(upto as bigint)) order by place) as cs, cast(max(upto) as bigint) as whole from cum where (upto - n) * 10 <= total * 9 group by context),
gen as (
  select conv_id * 100000 + turn as key, 0 as step, right(coalesce(text, ''), {generate.REACH}) as last, '' as new, false as ended from conversations where role = 'user'
  union all
  select key, step + 1, right(last || pick, {generate.REACH}), new || pick, pick = '' from (
    select g.*, coalesce(list_filter(coalesce(c3.cs, c2.cs, c1.cs, c0.cs), lambda x: x.upto > ((key * 1000003 + step * 7919) % 2147483647 * 48271 % 2147483647) * coalesce(c3.whole, c2.whole, c1.whole, c0.whole) // 2147483647)[1].nxt, '') as pick
    from gen g left join choice c3 on length(last) >= 3 and c3.context = right(last, 3) left join choice c2 on length(last) >= 2 and c2.context = right(last, 2)
    left join choice c1 on length(last) >= 1 and c1.context = right(last, 1) left join choice c0 on c0.context = ''
    where not ended and step < {NEW}) x
)
select key, md5(new) as digest, cast(length(new) as integer) as n, ended from gen where ended or step = {NEW}
""")
def t7_generate(spark, sf_dir):
    """A continuation of every user turn, sampled from the nucleus of what follows in the documents."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("key"), F.col("text").alias("prompt"))
    choices = generate.table(generate.counted(table(spark, sf_dir, "documents").where("text is not null")), TOP)
    return generate.generate(asked, choices, NEW).select("key", F.md5("new").alias("digest"), "n", "ended")




@query(stream.TOKENS + f""", whole as (select g // {stream.SIZE} as shard, cast(token as bigint) as token from tokens where g < {stream.FULL} * {stream.SIZE})
select printf('shard_%04d.npy', shard) as name, 'uploaded' as status, cast(1 as bigint) as entries, cast({stream.SIZE} as bigint) as n_tokens, cast(sum(token) as bigint) as sum from whole group by shard
union all select 'README.md', 'missing', 2, null, null
""")
def k9_upload(spark, sf_dir):
    """Shards brought to another folder by a stream of two batches, and brought again without its checkpoint."""
    source, asked, target = (scratch(spark, name) for name in ("npy", "asked", "uploaded"))
    sinks.write_npy_shards(shards.pack(stream.documents(spark, sf_dir), stream.SIZE, skip=stream.SKIP)[0], source, stream.SIZE)
    listed = spark.read.format("binaryFile").load(f"{source}/*.npy").select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    # Hadoop's paths have one slash behind the scheme, the URIs that executors take have three.
    listed = listed.withColumn("path", F.concat(F.lit(f"{source}/"), "name"))
    number = F.regexp_extract("name", r"(\d+)", 1).cast("long")
    for half in (0, 1):
        part = listed.where(number % 2 == half)
        if half:
            part = part.unionByName(spark.range(1).select(F.lit(f"{source}/README.md").alias("path"), F.lit("README.md").alias("name")))
        part.write.mode("append").parquet(asked)
        upload.upload(spark.readStream.schema("path string, name string").parquet(asked), target, f"{target}-checkpoint").awaitTermination()
    upload.upload(spark.readStream.schema("path string, name string").parquet(asked), target, f"{target}-other").awaitTermination()
    entered = upload.ledger(spark, target).groupBy("name", "status").agg(F.count("*").alias("entries"))
    held = npy_shards(spark, target)
    tokens = held.select(F.format_string("shard_%04d.npy", "shard_id").alias("name"), F.size("tokens").cast("long").alias("n_tokens"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum"))
    return entered.join(tokens, "name", "left").select("name", "status", "entries", "n_tokens", "sum")
