"""Chat formatting: calls and results linked by identifier, ordered and serialised.

Calls come from assistant messages that are JSON with ``tool_calls`` (id, name,
arguments, depends_on); results from tool messages that are JSON with ``tool_call_id``
and ``content``. In plain dialogues (``turns_as_calls``) a user turn is a call of
``reply`` whose identifier is ``conv_id:turn``, which depends on the call before it in
its conversation, and the assistant turn after it is its result. Calls and results meet
in a hash join on conversation and identifier.

Calls are ordered topologically: the depth of a call is one more than that of the calls
it depends on. Runs of calls with one dependency each are jumped by pointer doubling, so
a chain of n calls takes log2(n) rounds; calls with several dependencies then settle in
rounds of joins, one for each of them in a row. What cycles, or waits for a call that
does not exist, has no depth. Arguments are validated against the schema of the call's
name, and every call, result and message becomes one line of canonical JSON: sorted
keys, no white space.

A row stands for a call, a result or a message, never for a whole conversation, so a
conversation of any length is spread over tasks; (depth, turn, call_id) orders its rows.

Defined results: null texts count as empty; a call without result has none in its JSON
and ``n_results`` 0; of several results of one identifier the smallest text stands in the
call's JSON, ``n_results`` counts them, and each is a row of kind ``result`` too; results
without call, and messages that are neither, are rows of kind ``message``; calls that
repeat an identifier are rows of their own, of one depth, with the dependencies of all of
them; dependencies that name no call make a call invalid; arguments that are no JSON, or
a name without schema, make it invalid; repeated rows repeat their results; rows with a
null conversation or turn are messages; an empty table gives no rows; further columns
are ignored; very long texts are kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Arguments by call name. A type is a prefix of Spark's variant type; ``least`` and
#: ``most`` bound a string's characters or a number's value. No other arguments may stand.
SCHEMAS = {"reply": {"text": {"type": "STRING", "least": 16, "most": 256}}}
_CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>"
_RESULT = "tool_call_id string, content string"
#: Turns of a conversation that one task orders at once.
TURNS = 1024


def _messages(chat: DataFrame) -> DataFrame:
    return chat.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))


def _known() -> Column:
    return F.col("conv_id").isNotNull() & F.col("turn").isNotNull()


def explicit(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results written as JSON."""
    looks = F.ltrim("text").startswith("{") & _known()
    calls = messages.where((F.col("role") == "assistant") & looks & F.contains("text", F.lit("tool_calls"))).select("conv_id", "turn", F.explode(F.from_json("text", _CALLS)["tool_calls"]).alias("c"))
    calls = calls.where("c.id is not null").select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("needs"))
    results = messages.where((F.col("role") == "tool") & looks).select("conv_id", "turn", F.from_json("text", _RESULT).alias("r")).where("r.tool_call_id is not null").select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.coalesce("r.content", F.lit("")).alias("content"))
    return calls, results


def turns_before(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, before) of distinct turns: the turn before, null for the first.
    TURNS consecutive numbers are ordered at once, and their last one is carried on."""
    dealt = turns.distinct().withColumn("b", F.floor(F.col("turn") / TURNS))
    last = dealt.groupBy("conv_id", "b").agg(F.max("turn").alias("last"))
    carried = last.select("conv_id", "b", F.lag("last").over(Window.partitionBy("conv_id").orderBy("b")).alias("carry"))
    inside = dealt.withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id", "b").orderBy("turn")))
    return inside.join(carried, ["conv_id", "b"]).select("conv_id", "turn", F.coalesce("before", "carry").alias("before"))


def implicit(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User turns as calls, each after the one before it; the assistant turns after them
    as results."""
    known = messages.where(_known())
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    asked = known.where("role = 'user'")
    needs = F.when(F.col("before").isNull(), F.array().cast("array<string>")).otherwise(F.array(name(F.col("before"))))
    calls = asked.join(turns_before(asked.select("conv_id", "turn")), ["conv_id", "turn"]).select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct("text")).alias("arguments"), needs.alias("needs"))
    results = known.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def _jumped(links: DataFrame) -> DataFrame:
    """(conv_id, call_id, anchor, steps) of links (conv_id, call_id, need): where a chain
    of links ends, by pointer doubling. Links that cycle are left out."""
    state = stash(links.select("conv_id", "call_id", F.col("need").alias("anchor"), F.lit(1).cast("long").alias("steps")))
    n, reach = state.count(), 1
    while reach < n:
        onward = state.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("more"))
        state = stash(state.join(onward, ["conv_id", "anchor"], "left").select("conv_id", "call_id", F.coalesce("next", "anchor").alias("anchor"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("went")))
        reach *= 2
        if state.where("went").isEmpty():
            break
    # what still points to a link after as many steps as there are links goes in a circle
    return state.select("conv_id", "call_id", "anchor", "steps").join(links.select("conv_id", F.col("call_id").alias("anchor")), ["conv_id", "anchor"], "left_anti")


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) of calls with dependencies, null where they cycle or name
    no call. Calls without dependencies have depth 0 and are left out."""
    waits = stash(calls.where(F.size("needs") > 0).select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("need")).distinct())
    number = waits.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"))
    nodes = calls.select("conv_id", "call_id").distinct()
    done = stash(nodes.join(number, ["conv_id", "call_id"], "left_anti").withColumn("depth", F.lit(0).cast("long")))
    numbered = waits.join(number, ["conv_id", "call_id"])
    chained = stash(_jumped(numbered.where("n = 1").drop("n")))
    several = numbered.where("n > 1").join(chained.select("conv_id", F.col("call_id").alias("need"), "anchor", "steps"), ["conv_id", "need"], "left")
    left = stash(several.select("conv_id", "call_id", "n", F.coalesce("anchor", "need").alias("anchor"), F.coalesce("steps", F.lit(0)).alias("steps")))
    known = done
    while not left.isEmpty():
        got = left.join(known.select("conv_id", F.col("call_id").alias("anchor"), "depth"), ["conv_id", "anchor"])
        new = stash(got.groupBy("conv_id", "call_id", "n").agg(F.count("*").alias("k"), (F.max(F.col("depth") + F.col("steps")) + 1).alias("depth")).where("n = k").select("conv_id", "call_id", "depth"))
        if new.isEmpty():
            break
        known = stash(known.union(new))
        left = stash(left.join(new.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"))
    ends = known.select("conv_id", F.col("call_id").alias("anchor"), "depth")
    one = chained.join(ends, ["conv_id", "anchor"]).select("conv_id", "call_id", (F.col("depth") + F.col("steps")).alias("depth"))
    settled = one.union(known.join(number.where("n > 1"), ["conv_id", "call_id"], "left_semi"))
    return number.select("conv_id", "call_id").join(settled, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("depth").cast("int").alias("depth"))


def _fits(tree: Column, field: str, rule: dict) -> Column:
    got = F.try_variant_get(tree, f"$.{field}", "variant")
    fine = F.schema_of_variant(got).startswith(rule["type"])
    of_text = rule["type"] == "STRING"
    size = F.char_length(F.try_variant_get(tree, f"$.{field}", "string")) if of_text else F.try_variant_get(tree, f"$.{field}", "double")
    for bound, ok in (("least", lambda v: size >= v), ("most", lambda v: size <= v)):
        if bound in rule:
            fine = fine & ok(rule[bound])
    return F.coalesce(fine, F.lit(False))


def _valid(name: Column, arguments: Column, schemas: dict) -> Column:
    """Whether the arguments are those of the name's schema, each of its type and within
    its bounds."""
    tree, keys = F.try_parse_json(arguments), F.json_object_keys(arguments)
    out = F.lit(False)
    for call, fields in schemas.items():
        fine = F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(f) for f in fields]).cast("array<string>"))) == 0, F.lit(False))
        for field, rule in fields.items():
            fine = fine & _fits(tree, field, rule)
        out = F.when(name == call, fine).otherwise(out)
    return F.coalesce(out, F.lit(False))


def format_chat(chat: DataFrame, schemas: dict = SCHEMAS, turns_as_calls: bool = True) -> DataFrame:
    """(conv_id, turn, kind, call_id, depth, n_results, valid, json) of calls, further
    results and messages."""
    messages = _messages(chat)
    calls, results = explicit(messages)
    # messages that are calls or results are no messages of their own
    written = _known() & (F.ltrim("text").startswith("{")) & (((F.col("role") == "assistant") & F.from_json("text", _CALLS)["tool_calls"].isNotNull()) | ((F.col("role") == "tool") & F.from_json("text", _RESULT)["tool_call_id"].isNotNull()))
    plain = messages.where(~F.coalesce(written, F.lit(False)))
    if turns_as_calls:
        more_calls, more_results = implicit(plain)
        calls, results = calls.union(more_calls), results.union(more_results)
    one = results.groupBy("conv_id", "call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    linked = calls.join(one.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    deep = stash(depths(calls)).withColumn("waits", F.lit(True))
    linked = linked.join(deep, ["conv_id", "call_id"], "left").withColumn("depth", F.when(F.col("waits"), F.col("depth")).otherwise(F.lit(0))).drop("waits")
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    call_json = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), F.coalesce(F.nullif(quoted("name"), F.lit("")), F.lit("null")), F.when(F.col("content").isNotNull(), F.concat(F.lit(',"result":'), quoted("content"))).otherwise(F.lit("")), F.lit("}"))
    calls_out = linked.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", "depth", F.coalesce("n_results", F.lit(0)).alias("n_results"), (_valid(F.col("name"), F.col("arguments"), schemas) & F.col("depth").isNotNull()).alias("valid"), call_json.alias("json"))
    # every result of an identifier that has several, beside the one in the call's line
    ids = calls.select("conv_id", "call_id").distinct()
    of_calls = ids.join(deep, ["conv_id", "call_id"], "left").withColumn("depth", F.when(F.col("waits"), F.col("depth")).otherwise(F.lit(0))).drop("waits")
    several = one.where("n_results > 1").drop("content").join(of_calls, ["conv_id", "call_id"])
    more = results.join(several, ["conv_id", "call_id"]).select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", "depth", "n_results", F.col("depth").isNotNull().alias("valid"), F.concat(F.lit('{"content":'), quoted("content"), F.lit(',"id":'), quoted("call_id"), F.lit("}")).alias("json"))
    orphans = results.join(ids, ["conv_id", "call_id"], "left_anti").select("conv_id", "turn", F.lit("assistant" if turns_as_calls else "tool").alias("role"), F.col("content").alias("text"))
    taken = (F.col("role").isin("user", "assistant") & _known()) if turns_as_calls else F.lit(False)
    others = plain.where(~F.coalesce(taken, F.lit(False))).unionByName(orphans)
    messages_out = others.select("conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("n_results"), F.lit(True).alias("valid"), F.concat(F.lit('{"role":'), F.coalesce(F.nullif(quoted("role"), F.lit("")), F.lit("null")), F.lit(',"text":'), quoted("text"), F.lit("}")).alias("json"))
    return calls_out.unionByName(more).unionByName(messages_out)
