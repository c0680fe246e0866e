"""Queries that score requests and compare runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import numeric
from corpusloom.operators import evaluate
from corpusloom.plans.numeric_queries import NLL, logits, rounded
from corpusloom.plans.registry import query
from corpusloom.sources import sinks
from corpusloom.sources.tables import table

# The runs of a comparison, and the design of the first four.
RUNS = ["A", "B", "C", "D", "E1", "KD"]
DESIGN = [("A", "mha", "adamw"), ("B", "mla", "adamw"), ("C", "mha", "muon"), ("D", "mla", "muon")]
#: The value above which an event counts as a right answer.
RIGHT = 35

_TASKS = list(evaluate.HEADLINE.items())
#: Scores of runs in tasks: a run is a sixth of the users, a task a quarter of the events.
RESULTS = f"""
with e as (select ['{"', '".join(RUNS)}'][user_id % {len(RUNS)} + 1] as run, event_id % {len(_TASKS)} as k, value from events where value is not null),
s as (select run, ['{"', '".join(t for t, _ in _TASKS)}'][k + 1] as task, ['{"', '".join(m for _, m in _TASKS)}'][k + 1] as metric, avg(case when value > {RIGHT} then 1.0::double else 0.0::double end) as value, count(*) as n from e group by 1, 2, 3),
r as (select *, sqrt(value * (1 - value) / (n - 1)) as stderr from s)
"""


def results(spark, sf_dir):
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    run, task = F.col("user_id") % len(RUNS), F.col("event_id") % len(_TASKS)
    names = [pick(RUNS, run).alias("run"), pick([t for t, _ in _TASKS], task).alias("task"), pick([m for _, m in _TASKS], task).alias("metric")]
    each = table(spark, sf_dir, "events").where("value is not null").select(*names, (F.col("value") > RIGHT).cast("double").alias("hit"))
    shares = each.groupBy("run", "task", "metric").agg(F.avg("hit").alias("value"), F.count("*").alias("n"))
    return shares.withColumn("stderr", evaluate.standard_error(F.col("value"), F.col("n")))


_SCORED = NLL + """, s as (select vec_id // 8 as request, label - 0 as t, l[label + 1] - z as lp, l[label + 1] = top as hit, vec_id % 8 as place from lse)
select request, round(sum(lp), 6) as log_likelihood, bool_and(hit) as is_greedy, count(*) as n from s where place >= {0} group by request
"""


def _positions(spark, sf_dir):
    rows = logits(spark, sf_dir)
    return rows.select(F.floor(F.col("vec_id") / 8).cast("long").alias("request"), (F.col("vec_id") % 8).alias("at"), "logits", F.col("label").alias("target"))


@query(_SCORED.replace("{0}", "4"))
def e1_score_requests(spark, sf_dir):
    """Requests of eight positions: four of context, four scored."""
    return evaluate.score_requests(_positions(spark, sf_dir), 4).withColumn("log_likelihood", F.round("log_likelihood", 6))


@query(_SCORED.replace("{0}", "1"))
def e3_rolling(spark, sf_dir):
    """The whole request behind one opening position."""
    return evaluate.score_requests(_positions(spark, sf_dir), 1).withColumn("log_likelihood", F.round("log_likelihood", 6))


@query(NLL + """, c as (select vec_id // 4 as item, vec_id % 4 as choice, l[label + 1] - z as ll, label + 1 as len, vec_id // 4 % 4 as gold from lse),
b as (select item, arg_max(choice, ll) as raw, arg_max(choice, ll / len) as normed, max(gold) as gold from c group by item)
select round(avg(case when raw = gold then 1.0 else 0.0 end), 6) as acc, round(avg(case when normed = gold then 1.0 else 0.0 end), 6) as acc_norm, count(*) as items from b
""")
def e5_choice_accuracy(spark, sf_dir):
    rows = logits(spark, sf_dir)
    item = F.floor(F.col("vec_id") / 4).cast("long")
    ll = -numeric.nll(F.col("logits"), F.col("label"))
    choices = rows.select(item.alias("item"), (F.col("vec_id") % 4).alias("choice"), ll.alias("ll"), (F.col("label") + 1).alias("length"), (item % 4).alias("gold"))
    return evaluate.choice_accuracy(choices).select(rounded("acc", "acc"), rounded("acc_norm", "acc_norm"), "items")


@query("""
with s as (select d.lang, avg(cast(l.quality as double)) as p, count(*) as n from labels l join documents d using (doc_id) group by d.lang)
select lang, n, round(p, 6) as share, round(sqrt(p * (1 - p) / (n - 1)), 6) as stderr from s
""")
def e6_standard_error(spark, sf_dir):
    marked = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    shares = marked.groupBy("lang").agg(F.avg("quality").alias("p"), F.count("*").alias("n"))
    return shares.select("lang", "n", rounded("p", "share"), rounded(evaluate.standard_error(F.col("p"), F.col("n")), "stderr"))


@query(RESULTS + "select run, round(avg(value), 6) as headline from r group by run")
def e7_headline(spark, sf_dir):
    return evaluate.headline(results(spark, sf_dir)).select("run", rounded("headline", "headline"))


@query(RESULTS + """
select a.task, a.metric, round(a.value - b.value, 6) as delta, round((a.value - b.value) / a.stderr, 4) as sigma_one,
       round((a.value - b.value) / sqrt(a.stderr * a.stderr + b.stderr * b.stderr), 4) as sigma_two
from r a join r b on a.task = b.task and a.metric = b.metric where a.run = 'KD' and b.run = 'E1'
""")
def e8_deltas(spark, sf_dir):
    found = evaluate.deltas(results(spark, sf_dir), "KD", "E1")
    return found.select("task", "metric", rounded("delta", "delta"), F.round("sigma_one", 4).alias("sigma_one"), F.round("sigma_two", 4).alias("sigma_two"))


@query(RESULTS + """, h as (select run, avg(value) as v from r where run in ('A', 'B', 'C', 'D') group by run),
w as (select max(v) filter (run = 'A') as a, max(v) filter (run = 'B') as b, max(v) filter (run = 'C') as c, max(v) filter (run = 'D') as d from h)
select round((b + d - a - c) / 2, 6) as attention, round((c + d - a - b) / 2, 6) as optimizer, round(d - b - c + a, 6) as interaction from w
""")
def e9_factorial(spark, sf_dir):
    design = spark.createDataFrame(DESIGN, "run string, attention string, optimizer string")
    averages = evaluate.headline(results(spark, sf_dir)).join(design, "run")
    found = evaluate.factorial(averages, "attention", "optimizer", "headline", ("mha", "mla"), ("adamw", "muon"))
    return found.select(rounded("row_effect", "attention"), rounded("column_effect", "optimizer"), rounded("interaction", "interaction"))


@query("""
with p as (select event_type as metric, event_id // 500 as step, round(avg(value), 6) as value from events group by 1, 2)
select metric, step, value, round(value - lag(value) over (partition by metric order by step), 6) as change from p
""")
def e11_trajectory(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    points = events.groupBy(F.col("event_type").alias("metric"), F.floor(F.col("event_id") / 500).cast("long").alias("step")).agg(rounded(F.avg("value"), "value"))
    return evaluate.trajectory(points).withColumn("change", F.round("change", 6))


@query("""
with s as (select d.source as run, d.lang as task, avg(cast(l.quality as double)) as acc, count(*) as n from labels l join documents d using (doc_id) group by 1, 2)
select run, task, 'acc' as metric, round(acc, 6) as value, round(sqrt(acc * (1 - acc) / n), 6) as stderr from s
union all select run, task, 'perplexity', cast(n as double), null from s
""")
def s11_eval_json(spark, sf_dir):
    """Results written as nested JSON, one file's text per run, and flattened again."""
    marked = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    shares = marked.groupBy("source", "lang").agg(F.avg("quality").alias("acc"), F.count("*").alias("n"))
    error = F.sqrt(F.col("acc") * (1 - F.col("acc")) / F.col("n"))
    keys = F.create_map(F.lit("acc,none"), F.col("acc").cast("string"), F.lit("acc_stderr,none"), error.cast("string"), F.lit("perplexity,none"), F.col("n").cast("string"))
    tasks = shares.groupBy(F.col("source").alias("run")).agg(F.map_from_entries(F.collect_list(F.struct("lang", keys.alias("m")))).alias("results"))
    flat = evaluate.flattened(tasks.select("run", F.to_json(F.struct("results")).alias("json")))
    return flat.select("run", "task", "metric", rounded("value", "value"), rounded("stderr", "stderr"))


@query("""
with s as (select d.source as run, d.lang as task, avg(cast(l.quality as double)) as acc from labels l join documents d using (doc_id) group by 1, 2)
select run, task, round(case when task = 'en' then acc else acc / 2 end, 6) as value from s
""")
def s11_chosen_metric(spark, sf_dir):
    marked = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    shares = marked.groupBy(F.col("source").alias("run"), F.col("lang").alias("task")).agg(F.avg("quality").alias("acc"))
    named = F.array(F.struct(F.lit("acc").alias("metric"), F.when(F.col("task") == "en", F.col("acc")).alias("value")), F.struct(F.lit("acc_norm").alias("metric"), (F.col("acc") / 2).alias("value")))
    long = shares.select("run", "task", F.explode(named).alias("m")).select("run", "task", "m.metric", "m.value").where("value is not null")
    return evaluate.chosen_metric(long).select("run", "task", rounded("value", "value"))


@query("""
with g as (select event_type as run, event_id // 100 as step, cast(count(*) as bigint) as tokens, max(ts) as ended from events group by 1, 2),
l as (select *, epoch_us(ended) - epoch_us(lag(ended) over (partition by run order by step)) as us from g)
select run, step, tokens, round(case when us > 0 then tokens * 1e6 / us end, 6) as tokens_per_sec from l
""")
def a9_throughput(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    log = events.groupBy(F.col("event_type").alias("run"), F.floor(F.col("event_id") / 100).cast("long").alias("step")).agg(F.count("*").alias("tokens"), F.max("ts").cast("timestamp").alias("at"))
    return evaluate.throughput(log).select("run", "step", "tokens", rounded("tokens_per_sec", "tokens_per_sec"))


@query("""
with f as (select user_id as run, printf('step_%07d.pt', event_id) as name from events union all select distinct user_id, 'last.pt' from events),
r as (select *, row_number() over (partition by run order by name desc) as k from f where name like 'step_%')
select run, name from r where k > 3
""")
def k8_checkpoint_rotation(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    steps = events.select(F.col("user_id").alias("run"), F.format_string("step_%07d.pt", F.col("event_id")).alias("name"))
    files = steps.union(events.select(F.col("user_id").alias("run"), F.lit("last.pt").alias("name")).distinct())
    return evaluate.superseded(files, 3)


@query("select event_id as step, event_type as metric, value from events where event_id % 25 = 0")
def k10_metrics_log(spark, sf_dir):
    """Every 25th step's metrics, appended to a table and read again."""
    path = sinks.scratch(spark, "metrics")
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value")
    for half in range(2):
        sinks.append_metrics(log.where(F.col("step") % 2 == half), path, every=25)
    return spark.read.parquet(path)


@query("select doc_id, case when doc_id % 2 = 0 then 'layer.' || source else 'layer.' || source end as key, n_chars as value from documents")
def f8_key_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("_orig_mod.")).otherwise(F.lit("")), F.lit("layer."), F.col("source"))
    clean = docs.select("doc_id", F.explode(evaluate.without_prefix(F.create_map(key, F.col("n_chars")))).alias("key", "value"))
    return clean


@query(_SCORED.replace("{0}", "6"))
def e2_log_likelihood(spark, sf_dir):
    """Two positions scored behind an opening one and five of context."""
    return evaluate.score_requests(_positions(spark, sf_dir), 6).withColumn("log_likelihood", F.round("log_likelihood", 6))
