"""Operator 3, chat formatting: tool calls linked to results, ordered, validated, serialised.

Calls and results meet in one hash join on conversation and identifier, so a conversation of
any size is spread over its identifiers and never gathered. A call's order key is the
largest, over all chains of needs that end at it, of the turn that a chain begins with plus
the chain's length; sorting by (order_key, call_id) is then a topological order. A
conversation whose calls all come after what they need is in order as it stands. In the
others, calls that need exactly one other form chains, which are followed by doubling: each
call points to the one it needs, then to that one's pointer, and so on, so a chain of n calls
takes log n rounds and one row a call. A pointer that has gone as many steps as its
conversation has calls goes round a cycle. What is left, calls that need several others, is
placed in layers, each once all that it needs are; a call that never is stands on or behind a
cycle. A conversation with up to GATHERED such calls is one bounded row for this, whose layers
are rounds of one expression; only in larger ones is a layer a round of joins.

Arguments are parsed as variants, checked against their tool's schema by expressions, and
written with sorted keys and without spaces. All of it is DataFrame functions.

Defined results: of calls that share an identifier the one of least turn (then arguments)
is the call and `n_calls` tells of the rest, likewise for results; a call without result is
`pending`, a result without call `orphan`, else `linked`; a null identifier or conversation
matches a null one; arguments that are no JSON object have the error `not an object`, an
unknown tool `unknown tool`; `after` naming itself or a missing call counts in `n_missing`; a
call on or behind a cycle has a null order_key; empty tables give no rows; other columns are
ignored. One conversation's rows never depend on another's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import storage


@dataclass
class Field:
    """What a tool expects of one argument; kind: string, integer, number, boolean, object, array."""

    kind: str
    required: bool = False
    least: int | None = None  # characters of a string, value of a number


@dataclass
class Schema:
    fields: dict[str, Field]
    closed: bool = field(default=True)  # no other arguments


#: Variant types of each kind, by the start of their names.
_KINDS = {
    "string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"),
    "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",),
}


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no spaces; null if it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def _errors_of(name: str, field: Field, args: Column) -> Column:
    path = f"$['{name}']"
    value = F.variant_get(args, path, "variant")
    kind = F.schema_of_variant(value)
    fits = F.lit(False)
    for start in _KINDS[field.kind]:
        fits = fits | kind.startswith(start)
    missing = F.when(F.lit(field.required), F.lit(f"{name}: missing"))
    checks = F.when(value.isNull() | (kind == "VOID"), missing).when(~fits, F.lit(f"{name}: not {field.kind}"))
    if field.least is not None:
        size = F.length(F.try_variant_get(args, path, "string")) if field.kind == "string" else F.try_variant_get(args, path, "double")
        checks = checks.when(size < field.least, F.lit(f"{name}: below {field.least}"))
    return checks


def validated(name: Column, arguments: Column, schemas: dict[str, Schema]) -> Column:
    """Sorted errors of a call's arguments against its tool's schema."""
    args = F.try_parse_json(arguments)
    object_ = F.coalesce(F.schema_of_variant(args).startswith("OBJECT"), F.lit(False))
    out = F.when(~object_, F.array(F.lit("not an object")))
    for tool, schema in schemas.items():
        each = [_errors_of(n, f, args) for n, f in schema.fields.items()]
        found = F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")
        if schema.closed:
            known = F.array(*[F.lit(n) for n in schema.fields]) if schema.fields else F.array().cast("array<string>")
            other = F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), known)
            found = F.concat(found, F.transform(other, lambda k: F.concat(k, F.lit(": not known"))))
        out = out.when(name == tool, F.array_sort(found))
    return out.otherwise(F.array(F.lit("unknown tool")))


def _one(df: DataFrame, values: list[str], number: str) -> DataFrame:
    """The row of least turn, then values, of each identifier, and how many there are."""
    first = F.min(F.struct("turn", *values))
    return df.groupBy("conv_id", "call_id").agg(first.alias("first"), F.count("*").alias(number)).select("conv_id", "call_id", number, "first.*")


def _met(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "inner") -> DataFrame:
    """A hash join by null-safe equality of left's columns with right's."""
    on = None
    for a, b in pairs.items():
        same = left[a].eqNullSafe(right[b])
        on = same if on is None else on & same
    return left.join(right.hint("shuffle_hash"), on, how)


#: Calls with several needs, and such needs, of a conversation that is placed as one row.
GATHERED, GATHERED_NEEDS = 1_024, 8_192


def _placed(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """`_layered`, with the conversations that are small enough gathered into rows."""
    calls, edges = storage.written(calls, "hubs"), storage.written(edges, "needs")
    needs = edges.groupBy(F.col("c").alias("ec")).agg(F.count("*").alias("edges"))
    sizes = _met(calls.groupBy("c").agg(F.count("*").alias("n")), needs, {"c": "ec"}, "left")
    large = storage.written(sizes.where((F.col("n") > GATHERED) | (F.col("edges") > GATHERED_NEEDS)).select(F.col("c").alias("bc")), "large")
    if large.isEmpty():
        return _gathered(calls, edges)
    part = lambda df, how: _met(df, large, {"c": "bc"}, how)
    return _gathered(part(calls, "left_anti"), part(edges, "left_anti")).union(_layered(part(calls, "left_semi"), part(edges, "left_semi")))


def _gathered(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """`_layered` for conversations of bounded size, each as one row."""
    own = edges.groupBy(F.col("c").alias("ec"), F.col("k").alias("ek")).agg(F.collect_list(F.struct("need", "weight")).alias("needs"))
    node = F.struct("k", "val", "dead", F.coalesce("needs", F.array().cast("array<struct<need:string,weight:bigint>>")).alias("needs"))
    rows = _met(calls, own, {"c": "ec", "k": "ek"}, "left").groupBy("c").agg(F.collect_list(node).alias("nodes"))
    # Needs by their places, a null identifier's too.
    rows = rows.withColumn("names", F.transform("nodes", lambda x: F.struct(x["k"].alias("k"))))
    at = lambda e: F.struct((F.array_position("names", F.struct(e["need"].alias("k"))) - 1).cast("int").alias("at"), e["weight"].alias("weight"))
    rows = rows.withColumn("nodes", F.transform("nodes", lambda x: F.struct(x["k"].alias("k"), x["val"].alias("val"), x["dead"].alias("dead"), F.transform(x["needs"], at).alias("needs"))))

    def layer(keys: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            waits = F.exists(x["needs"], lambda e: F.get(keys, e["at"]).isNull())
            least = F.aggregate(x["needs"], x["val"], lambda most, e: F.greatest(most, F.get(keys, e["at"]) + e["weight"]))
            return F.coalesce(F.get(keys, i), F.when(~x["dead"] & ~waits, least))

        return F.transform("nodes", one)

    def round_(state: Column, _: Column) -> Column:
        left = lambda keys: F.size(F.filter(keys, lambda x: x.isNull()))
        more = F.get(F.transform(F.array(layer(state["keys"])), lambda keys: F.struct(keys.alias("keys"), (left(keys) < left(state["keys"])).alias("on"))), F.lit(0))
        return F.when(state["on"], more).otherwise(state)

    begin = F.struct(F.transform("nodes", lambda x: F.lit(None).cast("long")).alias("keys"), F.lit(True).alias("on"))
    keys = F.aggregate(F.sequence(F.lit(0), F.size("nodes")), begin, round_)["keys"]
    return rows.select("c", "names", keys.alias("keys")).select("c", F.explode(F.arrays_zip("names", "keys")).alias("x")).select("c", F.col("x.names.k").alias("k"), F.col("x.keys").alias("order_key"))


def _layered(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """c, k, order_key of calls(c, k, val, dead) with edges(c, k, need, weight): a call is placed
    once all that it needs are; null for dead ones and those that never are."""
    state = storage.written(calls.withColumn("placed", F.lit(False)), "state")
    edges = storage.written(edges, "edges")
    while True:
        waits = edges.select(F.col("c").alias("wc"), F.col("k").alias("wk")).distinct().withColumn("waits", F.lit(True))
        ready = ~F.col("placed") & ~F.col("dead") & F.col("waits").isNull()
        marked = storage.written(_met(state, waits, {"c": "wc", "k": "wk"}, "left").select("c", "k", "val", "dead", "placed", ready.alias("ready")), "marked")
        new = marked.where("ready").select(F.col("c").alias("nc"), F.col("k").alias("nk"), F.col("val").alias("above"))
        if new.isEmpty():
            return state.select("c", "k", F.when(F.col("placed"), F.col("val")).alias("order_key"))
        up = _met(edges, new, {"c": "nc", "need": "nk"}).groupBy(F.col("c").alias("uc"), F.col("k").alias("uk")).agg(F.max(F.col("above") + F.col("weight")).alias("least"))
        raised = _met(marked, up, {"c": "uc", "k": "uk"}, "left")
        raised = storage.written(raised.select("c", "k", F.greatest("val", "least").alias("val"), "dead", (F.col("placed") | F.col("ready")).alias("placed")), "state")
        rest = storage.written(_met(edges, new, {"c": "nc", "need": "nk"}, "left_anti"), "edges")
        storage.drop(state, edges, marked)
        state, edges = raised, rest


def _chained(nodes: DataFrame) -> DataFrame:
    """c, k, val, ptr, dist, dead of the nodes(c, k, val, n, need) that need one other: the key is
    the larger of val and ptr's key plus dist, and ptr needs none or several; dead goes round a cycle."""
    sizes = nodes.groupBy(F.col("c").alias("sc")).agg(F.count("*").alias("size"))
    chain = _met(nodes.where("n = 1"), sizes, {"c": "sc"}).select("c", "k", "val", F.col("need").alias("ptr"), F.lit(1).cast("long").alias("dist"), F.lit(False).alias("dead"), "size")
    chain = storage.written(chain, "chain")
    while True:
        ahead = chain.select(F.col("c").alias("pc"), F.col("k").alias("pk"), F.col("val").alias("pval"), F.col("ptr").alias("pptr"), F.col("dist").alias("pdist"))
        on = F.col("pdist").isNotNull()
        goes = _met(chain, ahead, {"c": "pc", "ptr": "pk"}, "left").select(
            "c", "k", F.greatest("val", F.col("pval") + F.col("dist")).alias("val"), F.when(on, F.col("pptr")).otherwise(F.col("ptr")).alias("ptr"),
            (F.col("dist") + F.coalesce("pdist", F.lit(0))).alias("dist"), (F.col("dead") | on & (F.col("dist") >= F.col("size"))).alias("dead"), "size", on.alias("on"),
        )
        goes = storage.written(goes, "chain")
        storage.drop(chain)
        chain = goes
        if chain.where("on and not dead").isEmpty():
            return chain.drop("size", "on")


def _tangled(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """c, k, order_key of calls(c, k, val) with edges(c, k, need); null on or behind a cycle."""
    degree = edges.groupBy(F.col("c").alias("dc"), F.col("k").alias("dk")).agg(F.count("*").alias("n"), F.max("need").alias("need"))
    nodes = storage.written(_met(calls, degree, {"c": "dc", "k": "dk"}, "left").select("c", "k", "val", F.coalesce("n", F.lit(0)).alias("n"), "need"), "nodes")
    chain = storage.written(_chained(nodes), "chains")
    several = nodes.where("n > 1").select(F.col("c").alias("hc"), F.col("k").alias("hk"))
    # Of a call that needs several, what its chains end at and how far away.
    link = chain.select(F.col("c").alias("lc"), F.col("k").alias("lk"), F.col("val").alias("lval"), "ptr", "dist", "dead")
    one = F.col("dist").isNotNull()
    needs = _met(_met(edges, several, {"c": "hc", "k": "hk"}, "left_semi"), link, {"c": "lc", "need": "lk"}, "left").select(
        "c", "k", F.when(one, F.col("ptr")).otherwise(F.col("need")).alias("need"), F.coalesce(F.col("dist") + 1, F.lit(1)).alias("weight"), (F.col("lval") + 1).alias("floor"), F.coalesce("dead", F.lit(False)).alias("dead"),
    )
    ends = nodes.select(F.col("c").alias("ec"), F.col("k").alias("ek"), F.col("val").alias("eval"), F.col("n").alias("en"))
    needs = storage.written(_met(needs, ends, {"c": "ec", "need": "ek"}, "left"), "needs")
    floor = F.max(F.greatest("floor", F.when(F.col("en") == 0, F.col("eval") + F.col("weight"))))
    least = needs.groupBy(F.col("c").alias("fc"), F.col("k").alias("fk")).agg(floor.alias("floor"), F.max("dead").alias("dead"))
    hubs = _met(nodes.where("n > 1"), least, {"c": "fc", "k": "fk"}).select("c", "k", F.greatest("val", "floor").alias("val"), "dead")
    placed = _placed(hubs, needs.where("en > 1 and not dead").select("c", "k", "need", "weight"))
    known = storage.written(nodes.where("n = 0").select("c", "k", F.col("val").alias("order_key")).union(placed), "known")
    end = known.select(F.col("c").alias("kc"), F.col("k").alias("kk"), "order_key")
    key = F.when(~F.col("dead") & F.col("order_key").isNotNull(), F.greatest("val", F.col("order_key") + F.col("dist")))
    followed = _met(chain, end, {"c": "kc", "ptr": "kk"}, "left").select("c", "k", key.alias("order_key"))
    return known.union(followed)


def order_keys(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, order_key, n_missing of calls(conv_id, call_id, turn, after)."""
    keys = storage.written(calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.coalesce("turn", F.lit(0)).cast("long").alias("val")), "keys")
    needs = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.col("turn"), F.explode("after").alias("need")).distinct()
    there = keys.select(F.col("c").alias("tc"), F.col("k").alias("tk"), F.col("val").alias("at"))
    needs = _met(needs, there, {"c": "tc", "need": "tk"}, "left")
    own = F.col("need").eqNullSafe(F.col("k"))
    needs = storage.written(needs.select("c", "k", "need", (F.col("at").isNotNull() & ~own).alias("there"), (F.col("at") >= F.coalesce("turn", F.lit(0))).alias("late")), "needs")
    missing = needs.where(~F.col("there")).groupBy(F.col("c").alias("mc"), F.col("k").alias("mk")).agg(F.count("*").alias("n_missing"))
    edges = needs.where("there")
    # The rest is in order as it stands: each call's turn is above those of all that it needs.
    open_ = storage.written(edges.where("late").select(F.col("c").alias("oc")).distinct(), "open")
    if open_.isEmpty():
        found = keys.withColumnRenamed("val", "order_key")
    else:
        inside = _tangled(_met(keys, open_, {"c": "oc"}, "left_semi"), _met(edges.select("c", "k", "need"), open_, {"c": "oc"}, "left_semi"))
        found = _met(keys, open_, {"c": "oc"}, "left_anti").withColumnRenamed("val", "order_key").union(inside)
    out = _met(found, missing, {"c": "mc", "k": "mk"}, "left")
    return out.select(F.col("c").alias("conv_id"), F.col("k").alias("call_id"), "order_key", F.coalesce("n_missing", F.lit(0)).alias("n_missing"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row per identifier, with its status, order_key, errors and canonical JSON.

    calls: conv_id, call_id, turn, name, arguments (JSON), after (identifiers); results: conv_id,
    call_id, turn, content.
    """
    asked = _one(calls.select("conv_id", "call_id", "turn", "name", "arguments", "after"), ["name", "arguments", "after"], "n_calls")
    asked = storage.written(asked, "calls")
    given = _one(results.select("conv_id", "call_id", "turn", "content"), ["content"], "n_results")
    given = given.withColumnsRenamed({"conv_id": "c", "call_id": "k", "turn": "result_turn"})
    keys = order_keys(asked.select("conv_id", "call_id", "turn", "after")).withColumnsRenamed({"conv_id": "oc", "call_id": "ok"})
    placed = _met(asked, keys, {"conv_id": "oc", "call_id": "ok"}).drop("oc", "ok")
    both = _met(placed, given, {"conv_id": "c", "call_id": "k"}, "full_outer")
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "pending").otherwise("linked")
    errors = F.when(F.col("n_calls").isNotNull(), validated(F.col("name"), F.col("arguments"), schemas))
    both = both.select(
        F.when(F.col("n_calls").isNull(), F.col("c")).otherwise(F.col("conv_id")).alias("conv_id"), F.when(F.col("n_calls").isNull(), F.col("k")).otherwise(F.col("call_id")).alias("call_id"),
        F.when(F.col("n_calls").isNull(), F.col("result_turn").cast("long")).otherwise(F.col("order_key")).alias("order_key"), status.alias("status"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
        F.coalesce(errors, F.array().cast("array<string>")).alias("errors"), "name", "arguments", "content",
    )
    args = F.coalesce(F.try_parse_json("arguments"), F.to_variant_object(F.struct(F.col("arguments").alias("raw"))))
    args = F.when(F.col("arguments").isNotNull(), args)
    # Keys stand in order here, and variants keep theirs in order.
    whole = F.struct(args.alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"), F.col("content").alias("result"), F.col("status").alias("status"))
    return both.select("conv_id", "call_id", "order_key", "status", "n_calls", "n_results", "n_missing", "errors", F.to_json(whole).alias("json"))


#: The tools that `from_turns` calls, besides one that is not known.
TOOLS = {
    "reply": Schema({"prompt": Field("string", required=True, least=1), "turn": Field("integer", required=True, least=0)}),
    "search": Schema({"query": Field("string", required=True, least=1), "limit": Field("integer", required=True, least=1)}),
}


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain turns as (calls, results) with needs and faults of many kinds.

    A user turn is a call named `conversation:turn`; an assistant turn is the result of the
    turn before its own. The remainder of conv_id modulo 4 tells what a call needs: the user
    turn before it (two turns back), the one after it (so the order is turned round), both
    (so all stand on a cycle), or the one before, itself and one that no one makes. The
    remainder of conv_id + turn modulo 5 tells the tool: 4 `search`, with a limit of zero, one or
    a word; 3 `lookup`, which no schema knows, with an empty object or with the bare text; else
    `reply`. Turns of any other role, or of none, are no part of the linking and give no row.
    """
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    user = conversations.where("role = 'user'")
    kind, way = (conv + turn) % 5, conv % 4
    tool = F.when(kind == 4, "search").when(kind == 3, "lookup").otherwise("reply")
    limit = F.when(conv % 3 == 2, F.to_json(F.struct(F.lit("many").alias("limit"), text.alias("query")))).otherwise(F.to_json(F.struct((conv % 3).alias("limit"), text.alias("query"))))
    bare = F.when(conv % 2 == 0, F.lit("{}")).otherwise(text)
    arguments = F.when(kind == 4, limit).when(kind == 3, bare).otherwise(F.to_json(F.struct(text.alias("prompt"), turn.cast("long").alias("turn"))))
    before, behind = F.when(turn >= 2, name(turn - 2)), name(turn + 2)
    after = F.when(way == 0, F.array(before)).when(way == 1, F.array(behind)).when(way == 2, F.array(before, behind)).otherwise(F.array(before, name(turn), F.lit("none")))
    calls = user.select("conv_id", name(turn).alias("call_id"), "turn", tool.alias("name"), arguments.alias("arguments"), F.array_compact(after).alias("after"))
    answers = conversations.where("role = 'assistant'")
    return calls, answers.select("conv_id", name(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
