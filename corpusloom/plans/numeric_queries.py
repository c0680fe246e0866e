"""Queries on logits (the embeddings table: 64 values, their label as target) and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import encode, numeric, schedules
from corpusloom.operators import evaluate
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

ALPHA, TEMPERATURE, TOP, TOP_P = 0.5, 2.0, 8, 0.5

#: NLL of each row; every tenth target is ignored.
NLL = """
with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as l, case when vec_id % 10 = 0 then -100 else label end as t, label from embeddings),
m as (select *, list_max(l) as top from e),
lse as (select *, top + ln(list_sum(list_transform(l, lambda x: exp(x - top)))) as z from m),
nll as (select *, case when t <> -100 then z - l[t + 1] end as nll from lse)
"""


def logits(spark, sf_dir):
    target = F.when(F.col("vec_id") % 10 == 0, numeric.IGNORED).otherwise(F.col("label"))
    return table(spark, sf_dir, "embeddings").select("vec_id", numeric.doubles(F.col("embedding")).alias("logits"), target.alias("target"), "label")


def losses(spark, sf_dir):
    return logits(spark, sf_dir).withColumn("nll", numeric.nll(F.col("logits"), F.col("target")))


def rounded(column, alias):
    return F.round(column, 6).alias(alias)


@query(NLL + "select vec_id, round(nll, 6) as nll from nll where nll is not null")
def a2_row_nll(spark, sf_dir):
    return losses(spark, sf_dir).where("nll is not null").select("vec_id", rounded("nll", "nll"))


@query(NLL + "select round(sum(nll) / greatest(1, count(nll)), 6) as loss from nll")
def a1_cross_entropy(spark, sf_dir):
    return losses(spark, sf_dir).agg(rounded(numeric.token_mean(F.col("nll"), F.col("target")), "loss"))


@query(NLL + "select label, round(sum(nll), 5) as nll_sum, count(nll) as n from nll group by label")
def a2_nll_sum(spark, sf_dir):
    return losses(spark, sf_dir).groupBy("label").agg(F.round(F.sum("nll"), 5).alias("nll_sum"), F.count("nll").alias("n"))


@query(NLL + "select label, round(exp(sum(nll) / count(nll)), 5) as perplexity from nll group by label")
def a3_perplexity(spark, sf_dir):
    return losses(spark, sf_dir).groupBy("label").agg(F.round(numeric.perplexity(F.sum("nll"), F.count("nll")), 5).alias("perplexity"))


@query(NLL + """, s as (select a.vec_id // 8 as row, a.z - a.l[b.t + 1] as nll from lse a join lse b on b.vec_id = a.vec_id + 1 and b.vec_id // 8 = a.vec_id // 8 and b.t <> -100)
select row, round(sum(nll) / greatest(1, count(*)), 6) as loss from s group by row
""")
def a4_sft_loss(spark, sf_dir):
    """Rows of eight positions; each position is scored on the next one's label."""
    rows = logits(spark, sf_dir).withColumn("row", F.floor(F.col("vec_id") / 8).cast("long"))
    after = rows.select("row", (F.col("vec_id") - 1).alias("vec_id"), F.col("target").alias("next"))
    both = rows.join(after, ["row", "vec_id"]).where(F.col("next") != numeric.IGNORED)
    loss = numeric.nll(F.col("logits"), F.col("next"))
    return both.withColumn("nll", loss).groupBy("row").agg(rounded(numeric.token_mean(F.col("nll"), F.col("next")), "loss"))


_TOP = f"""
ranked as (select vec_id, unnest(list_transform(l, lambda x, i: {{'val': x, 'idx': i - 1}}), recursive := true) from (select vec_id, l from nll)),
top as (select * from (select *, row_number() over (partition by vec_id order by val desc, idx) as rank from ranked) where rank <= {TOP})
"""


@query(NLL + "," + _TOP + "select vec_id, cast(rank - 1 as integer) as rank, cast(idx as integer) as idx, round(val, 6) as val from top")
def a6_top_k(spark, sf_dir):
    best = logits(spark, sf_dir).select("vec_id", F.posexplode(numeric.top_k(F.col("logits"), TOP)).alias("rank", "e"))
    return best.select("vec_id", "rank", F.col("e.idx").alias("idx"), rounded("e.val", "val"))


@query(NLL + "," + _TOP + f""",
pair as (select s.vec_id, s.nll, t.val / {TEMPERATURE} as tv, s.l[t.idx + 1] / {TEMPERATURE} as sv from nll s join top t on t.vec_id = s.vec_id + 1 where s.nll is not null),
norm as (select *, tv - ln(sum(exp(tv)) over w) as tl, sv - ln(sum(exp(sv)) over w) as sl from pair window w as (partition by vec_id)),
kl as (select vec_id, any_value(nll) as nll, sum(exp(tl) * (tl - sl)) as kl from norm group by vec_id)
select round({1 - ALPHA} * sum(nll) / count(*) + {ALPHA} * {TEMPERATURE ** 2} * sum(kl) / count(*), 6) as loss, count(*) as n from kl
""")
def a5_kd_loss(spark, sf_dir):
    """Each row learns from the next one's top entries."""
    student = losses(spark, sf_dir).where("nll is not null")
    teacher = logits(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), numeric.top_k(F.col("logits"), TOP).alias("top"))
    both = student.join(teacher, "vec_id").withColumn("kl", numeric.top_k_divergence(F.col("logits"), F.col("top"), TEMPERATURE))
    n = F.greatest(F.lit(1), F.count("*"))
    loss = (1 - ALPHA) * F.sum("nll") / n + ALPHA * TEMPERATURE**2 * F.sum("kl") / n
    return both.agg(rounded(loss, "loss"), F.count("*").alias("n"))


@query(NLL + "select round(avg(z - l[label + 1]), 6) as loss from lse")
def a7_default_loss(spark, sf_dir):
    rows = logits(spark, sf_dir).withColumn("target", F.col("label"))
    return evaluate.mean_loss(rows, []).select(rounded("loss", "loss"))


@query(NLL + "select target, round(avg(case when gap > 1 then gap else gap * gap end), 6) as loss from (select label as target, top - l[label + 1] as gap from lse) group by target")
def u2_loss_hook(spark, sf_dir):
    """A loss of one's own in the default's place: the margin to the largest logit, squared where small."""

    def margin(l: F.Column, t: F.Column) -> F.Column:
        gap = F.array_max(l) - F.get(l, t)
        return F.when(gap > 1, gap).otherwise(gap * gap)

    rows = logits(spark, sf_dir).withColumn("target", F.col("label"))
    return evaluate.mean_loss(rows, ["target"], margin).select("target", rounded("loss", "loss"))


@query(NLL + "select vec_id // 16 as step, round(avg(nll), 6) as loss from nll where nll is not null group by 1")
def a8_accumulated_loss(spark, sf_dir):
    micro = losses(spark, sf_dir).where("nll is not null").select(F.floor(F.col("vec_id") / 16).cast("long").alias("step"), F.col("nll").alias("loss"))
    return evaluate.micro_mean(micro).select("step", rounded("loss", "loss"))


@query(NLL + """, p as (select vec_id, unnest(list_transform(l, lambda x, i: {'p': exp(x - z), 'idx': i - 1}), recursive := true) from lse),
c as (select *, sum(p) over (partition by vec_id order by p desc, idx rows between unbounded preceding and current row) - p as before from p),
k as (select *, sum(p) over (partition by vec_id) as mass from c where before <= 0.5)
select vec_id, cast(idx as integer) as idx, round(p / mass, 6) as p from k
""")
def t4_nucleus(spark, sf_dir):
    kept = logits(spark, sf_dir).select("vec_id", F.explode(numeric.nucleus(F.col("logits"), TOP_P)).alias("e"))
    return kept.select("vec_id", F.col("e.idx").alias("idx"), rounded("e.p", "p"))


@query(NLL + "select vec_id, cast(list_position(l, top) - 1 as integer) as pick from lse")
def t5_greedy(spark, sf_dir):
    return logits(spark, sf_dir).select("vec_id", numeric.greedy(F.col("logits")).alias("pick"))


@query(NLL + """, p as (select vec_id, unnest(list_transform(l, lambda x, i: {'p': exp(x - z), 'idx': i - 1}), recursive := true) from lse),
c as (select *, sum(p) over (partition by vec_id order by idx rows between unbounded preceding and current row) as upto from p)
select vec_id, cast(min(idx) as integer) as pick from c where upto > (vec_id * 7919 % 1000) / 1000.0 group by vec_id
""")
def t6_sample(spark, sf_dir):
    """Inverse-CDF draws with a supplied uniform number."""
    uniform = (F.col("vec_id") * 7919 % 1000) / F.lit(1000.0)
    return logits(spark, sf_dir).select("vec_id", numeric.inverse_cdf(numeric.softmax(F.col("logits")), uniform).alias("pick"))


@query(NLL + "select vec_id, round(sqrt(list_sum(list_transform(l, lambda x: x * x)) / 64 + 1e-6), 6) as scale, round(l[1] / sqrt(list_sum(list_transform(l, lambda x: x * x)) / 64 + 1e-6), 6) as first from e")
def m1_rms_norm(spark, sf_dir):
    values = logits(spark, sf_dir).withColumn("normed", numeric.rms_norm(F.col("logits")))
    first = F.get("normed", F.lit(0))
    return values.select("vec_id", rounded(F.get("logits", F.lit(0)) / first, "scale"), rounded(first, "first"))


@query("""
with s as (select event_id, event_id % 2001 as step from events)
select event_id, step, round(case when step < 200 then 0.006 * step / 200 else 0.006 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * (step - 200) / 1800))) end, 9) as rate from s
""")
def f9_cosine_rate(spark, sf_dir):
    """Each event as a step of a run of 2,000."""
    steps = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 2001).alias("step"))
    return steps.select("event_id", "step", F.round(schedules.cosine_rate(F.col("step"), F.lit(200), F.lit(2000), F.lit(0.006)), 9).alias("rate"))


@query("""
with p as (select lang, source, count(*) as n, 16 as b, cast(1 + max(doc_id) % 3 as integer) as e, cast(case when max(doc_id) % 2 = 0 then 0 else 5 end as integer) as m from documents group by lang, source),
q as (select *, greatest(1, cast(floor(n * 0.8::double) as bigint) // b) * e as steps from p)
select lang, source, n, cast(case when m > 0 then least(steps, m) else steps end as bigint) as steps, e as epochs, m as most from q
""")
def f10_planned_steps(spark, sf_dir):
    """A run over each source's documents of a language; every other one stops at five steps."""
    last = F.max("doc_id")
    most = F.when(last % 2 == 0, 0).otherwise(5)
    plans = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), (1 + last % 3).cast("int").alias("e"), most.alias("m"))
    return plans.select("lang", "source", "n", schedules.planned_steps(F.col("n"), F.lit(16), F.col("e"), F.col("m")).alias("steps"), F.col("e").alias("epochs"), F.col("m").alias("most"))


_MODELS = [("base", 1024, 16, 512, 64, 18), ("small", 512, 8, 256, 32, 12), ("odd", 1000, 16, 512, 64, 18)]


@query("with c(name, d, h, l, r, n) as (values " + ", ".join(str(m) for m in _MODELS) + """),
t as (select doc_id, case lang when 'en' then 'base' when 'fr' then 'small' else 'odd' end as name, coalesce(length(text), 0) + 1 as tokens from documents)
select doc_id, name, cast(2 * h * (d // h) as bigint) as whole, cast(l + r as bigint) as latent, cast(2 * h * (d // h) * n as bigint) * tokens * 2 as whole_bytes,
       cast((l + r) * n as bigint) * tokens * 2 as latent_bytes, round(2 * h * (d // h) / cast(l + r as double), 6) as ratio from t join c using (name)
""")
def f13_cache_footprint(spark, sf_dir):
    """What each document's tokens take in the cache of its language's model."""
    models = F.broadcast(spark.createDataFrame(_MODELS, "name string, d int, h int, l int, r int, n int"))
    name = F.when(F.col("lang") == "en", "base").when(F.col("lang") == "fr", "small").otherwise("odd")
    docs = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), (encode.code_point_count(F.col("text")) + 1).alias("tokens"))
    whole, latent = (x.cast("long") for x in schedules.cache_floats(F.col("d"), F.col("h"), F.col("l"), F.col("r")))
    size = lambda floats: schedules.cache_bytes(floats, F.col("n"), F.col("tokens"))
    return docs.join(models, "name").select("doc_id", "name", whole.alias("whole"), latent.alias("latent"), size(whole).alias("whole_bytes"), size(latent).alias("latent_bytes"), rounded(whole / latent, "ratio"))


@query(NLL + "select vec_id, round(nll / ln(2), 6) as bits from nll where nll is not null")
def f14_bits(spark, sf_dir):
    return losses(spark, sf_dir).where("nll is not null").select("vec_id", rounded(schedules.bits(F.col("nll")), "bits"))


@query("""
with t as (select p, k, p / pow(10000, k / 4.0) as angle from (select distinct event_id % 2048 as p from events), (select unnest(range(4)) as k))
select p as position, cast(k as integer) as pair, round(cos(angle), 9) as cosine, round(sin(angle), 9) as sine from t
""")
def m2_rotary_table(spark, sf_dir):
    """Rotation angles of the events' positions in contexts of 2,048, for heads of eight values."""
    positions = table(spark, sf_dir, "events").select((F.col("event_id") % 2048).alias("position")).distinct()
    return schedules.rotary_table(positions, 8)


_PARAMETERS = [("blocks.0.attn.q.weight", 2), ("blocks.0.attn.q.bias", 1), ("blocks.1.ffn_norm.weight", 1), ("Embed.weight", 2), ("lm_head.weight", 2), ("blocks.1.ffn.up.weight", 2), ("x.Norm.w", 2), ("y.bias", 2)]


@query(f"""
with p as (select p_partkey, replace(p_name, ' ', '.') || '.' || [{", ".join(repr(n) for n, _ in _PARAMETERS)}][p_partkey % {len(_PARAMETERS)} + 1] as name, {[d for _, d in _PARAMETERS]}[p_partkey % {len(_PARAMETERS)} + 1] as ndim from part)
select p_partkey, name, ndim < 2 or contains(lower(name), 'embed') or contains(lower(name), 'lm_head') or contains(lower(name), 'norm') or ends_with(lower(name), '.bias') as scalar from p
""")
def m3_parameter_groups(spark, sf_dir):
    """Each part as a model's parameter, named after it."""
    kind = (F.col("p_partkey") % len(_PARAMETERS)).cast("int")
    pick = lambda k: F.get(F.array(*[F.lit(p[k]) for p in _PARAMETERS]), kind)
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), pick(0))
    parameters = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), pick(1).alias("ndim"))
    return parameters.select("p_partkey", "name", (~schedules.is_matrix(F.col("name"), F.col("ndim"))).alias("scalar"))
