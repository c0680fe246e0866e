"""Queries of model arithmetic on the given tables: requests of tasks, attention, orthogonal updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import attention, generate, order, orthogonal, tasks, training
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

#: Words of an item that are its answer.
ANSWER = 3


@query(f"""
with ch as (select case when text = '' then [] else string_split(text, '') end as c from documents where text is not null),
pos as (select unnest(list_append(c, '')) as nxt, unnest((['', '', ''] || c)[:len(c) + 1]) || unnest((['', ''] || c)[:len(c) + 1]) || unnest([''] || c) as context from ch),
long as (select context, nxt, count(*) as n from pos group by 1, 2),
cnt as (select right(context, cast(k as integer)) as context, nxt, sum(n)::bigint as n from (select *, unnest(range(0, length(context) + 1)) as k from long) group by 1, 2),
ctx as (select context, sum(n) as total, list(nxt order by n desc, nxt)[1] as top from cnt group by context),
size as (select count(*) + 1 as v from cnt where context = ''),
w as (select item_id, string_split(text, ' ') as ws from benchmark),
b as (select item_id, array_to_string(ws[:greatest(len(ws) - {ANSWER}, 0)], ' ') || ' ' as context, ws[greatest(len(ws) - {ANSWER}, 0) + 1:] as ends from w),
req as (select 'benchmark' as task, item_id as item, 0 as nth, 'loglikelihood' as kind, context, array_to_string(ends, ' ') as continuation from b
        union all select 'benchmark', item_id, 1, 'loglikelihood', context, array_to_string(list_reverse(ends), ' ') from b
        union all select 'conversations', conv_id * 100000 + turn, 0, 'loglikelihood_rolling', '', coalesce(text, '') from conversations),
each as (select task, item, nth, substr(continuation, i, 1) as nxt, right(right(context, {generate.REACH}) || left(continuation, i - 1), {generate.REACH}) as before
         from (select *, cast(unnest(range(1, length(continuation) + 1)) as integer) as i from req)),
met as (select e.task, e.item, e.nth, e.nxt, coalesce(c3.context, c2.context, c1.context, c0.context) as context, coalesce(c3.total, c2.total, c1.total, c0.total) as total, coalesce(c3.top, c2.top, c1.top, c0.top) as top
        from each e left join ctx c3 on length(e.before) >= 3 and c3.context = right(e.before, 3) left join ctx c2 on length(e.before) >= 2 and c2.context = right(e.before, 2)
        left join ctx c1 on length(e.before) >= 1 and c1.context = right(e.before, 1) left join ctx c0 on c0.context = ''),
s as (select m.task, m.item, m.nth, sum(ln((coalesce(c.n, 0) + 1) / cast(m.total + v as double))) as lp, bool_and(m.top = m.nxt) as hit from met m cross join size left join cnt c on c.context = m.context and c.nxt = m.nxt group by 1, 2, 3)
select task, item, nth, kind, round(coalesce(lp, 0), 6) as log_likelihood, coalesce(hit, length(continuation) = 0) as is_greedy, cast(length(continuation) as bigint) as n from req left join s using (task, item, nth)
""")
def u6_task_requests(spark, sf_dir):
    """Two tasks as requests of two kinds: which of two endings follows an item, and every turn of the conversations."""
    words = F.split("text", " ")
    cut = F.greatest(F.size(words) - ANSWER, F.lit(0))
    ends = F.slice(words, cut + 1, F.lit(ANSWER))
    choices = F.array(F.array_join(ends, " "), F.array_join(F.reverse(ends), " "))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.concat(F.array_join(F.slice(words, F.lit(1), cut), " "), F.lit(" ")).alias("context"), choices.alias("choices"))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("item"), "text")
    asked = tasks.requests(items, "benchmark", tasks.CHOICES).unionByName(tasks.requests(turns, "conversations", tasks.ROLLING))
    counts = generate.counted(table(spark, sf_dir, "documents").where("text is not null"))
    return tasks.scored(asked, counts).withColumn("log_likelihood", F.round("log_likelihood", 6))


_SEQUENCES = """
with e as (select label as seq, row_number() over (partition by label order by vec_id) - 1 as place, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where label is not null),
"""


@query(_SEQUENCES + """
r as (select *, list_transform(range(1, 65), lambda k: v[k] * cos(place * pow(10000, -2.0 * ((k - 1) % 32) / 64)) + (case when k <= 32 then -v[k + 32] else v[k - 32] end) * sin(place * pow(10000, -2.0 * ((k - 1) % 32) / 64))) as q from e),
p as (select a.seq, a.place, b.v, list_dot_product(a.q, b.q) / 8 as s from r a join r b on a.seq = b.seq and b.place <= a.place),
m as (select *, exp(s - max(s) over (partition by seq, place)) as w from p),
o as (select seq, place, k, sum(w * x) / sum(w) as y from (select seq, place, w, unnest(v) as x, unnest(range(64)) as k from m) group by 1, 2, 3)
select seq, place, round(max(y) filter (k = 0), 5) + 0.0 as first, round(sum(y * (k + 1)), 4) + 0.0 as weighed from o group by 1, 2
""")
def m4_attention(spark, sf_dir):
    """Each label's vectors as a sequence in the order of their ids: rotated queries and keys, the vectors as values."""
    rows = table(spark, sf_dir, "embeddings").where("label is not null").select("vec_id", F.col("label").alias("seq"), "embedding", F.lit(1).cast("long").alias("one"))
    placed = order.place(rows, "one", "vec_id", "seq")[0].withColumnRenamed("start", "at")
    turned = placed.select("seq", "at", attention.rotated(F.col("embedding"), F.col("at"), 64).alias("q"), F.col("embedding").alias("v"))
    found = attention.attend(turned.select("seq", "at", "q"), turned.select("seq", "at", F.col("q").alias("k"), "v"))
    weighed = F.aggregate(F.transform("out", lambda y, k: y * (k + 1)), F.lit(0.0), lambda a, y: a + y)
    return found.select("seq", F.col("at").alias("place"), F.round(F.get("out", F.lit(0)), 5).alias("first"), F.round(weighed, 4).alias("weighed"))


def _products(name: str, left: str, right: str) -> str:
    """SQL for the product of two tables of symmetric matrices that commute, line by line."""
    return f"{name} as materialized (select a.seq, a.i, list(list_dot_product(a.line, b.line) order by b.i) as line from {left} a join {right} b on a.seq = b.seq group by 1, 2)"


def _steps() -> str:
    out = []
    for k in range(orthogonal.STEPS):
        mixed = f"{orthogonal.FIRST} * (case when j = a.i then 1 else 0 end) + {orthogonal.THIRD} * a.line[j] + {orthogonal.FIFTH} * s.line[j]"
        out += [
            _products(f"s{k}", f"a{k}", f"a{k}"),
            f"p{k} as materialized (select a.seq, a.i, list_transform(range(1, 65), lambda j: {mixed}) as line from a{k} a join s{k} s using (seq, i))",
            _products(f"h{k}", f"a{k}", f"p{k}"), _products(f"a{k + 1}", f"h{k}", f"p{k}"), _products(f"q{k + 1}", f"q{k}", f"p{k}"),
        ]
    return ", ".join(out)


@query(f"""
with e as (select vec_id, label as seq, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where label is not null),
c as (select seq, i, j, sum(v[i] * v[j]) as x from (select seq, v, i, unnest(range(1, 65)) as j from (select seq, v, unnest(range(1, 65)) as i from e)) group by 1, 2, 3),
g as (select seq, i, list(x order by j) as line from c group by 1, 2),
norms as (select seq, sqrt(sum(line[i])) + {orthogonal.TINY} as norm from g group by 1),
a0 as materialized (select seq, i, list_transform(line, lambda x: x / (norm * norm)) as line from g join norms using (seq)),
q0 as materialized (select seq, i, list_transform(range(1, 65), lambda j: case when j = i then 1 / norm else 0 end) as line from g join norms using (seq)),
{_steps()},
y as (select vec_id, list(list_dot_product(v, line) order by i) as y from e join q{orthogonal.STEPS} using (seq) group by vec_id)
select vec_id, round(y[1], 5) + 0.0 as first, round(list_dot_product(y, y), 5) as square from y
""")
def m5_newton_schulz(spark, sf_dir):
    """Each label's vectors as one matrix, orthogonalised."""
    rows = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("label").cast("string").alias("name"), F.col("vec_id").alias("at"), F.col("embedding").alias("row"))
    square = F.aggregate("row", F.lit(0.0), lambda a, x: a + x * x)
    return orthogonal.newton_schulz(rows, 64).select(F.col("at").alias("vec_id"), F.round(F.get("row", F.lit(0)), 5).alias("first"), F.round(square, 5).alias("square"))


#: Steps of training, and batches of an epoch.
TRAINING = training.Plan(total=6, warmup=2, mode="muon", batches=2)


@query()
def m6_training(spark, sf_dir):
    """A softmax regression of the vectors' labels: two orthogonal updates an epoch, one row of the log a step."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("x"), F.col("label").alias("y"))
    _, log = training.train(rows, TRAINING, classes=10, width=64)
    entries = spark.createDataFrame([(e["step"], e["n"], e["loss"], e["grad_norm"], e["rate"]) for e in log], "step int, n long, loss double, grad_norm double, rate double")
    return entries.select("step", "n", *[F.round(c, 6).alias(c) for c in ("loss", "grad_norm", "rate")])
