"""Tool-call linking: calls and results meet by identifier, are ordered topologically, validated and serialised canonically.

* A call has (conv_id, call_id, name, arguments, depends_on); a result has (call_id, content). Identifiers are unique over the
  corpus, so that the hash join spreads a hot conversation. Of repeated calls with an identifier the smallest is taken, of
  repeated results the smallest content; the numbers of repeats are returned.
* A call's level is one more than the largest level of the calls that it depends on; dependencies that don't exist are dropped and counted.
  Calls with one dependency point to it, and the pointers double their reach in each round, so that a chain of n calls takes log2(n) rounds. Calls with
  several are then ordered among themselves, by rounds over those that are still open. What is on a cycle or behind one has no level. Within a
  conversation, (level, call_id) is a topological order.
* Results without a call are rows too, with n_calls = 0.
* Arguments are JSON objects. The canonical form has sorted keys and no spaces. Schemas say which properties a name has, of
  which type, and which are required; a call is valid if its arguments are an object with all required properties, none of
  another type, and none that the schema doesn't have. Without a schema there is nothing to break but the JSON itself.

Schemas are small and broadcast up to MAX_SCHEMAS of them. Nulls: calls without an identifier can't be linked and are left out, as
are results; null arguments are an empty object; null contents are null in the JSON. Of ties and repeated rows one is taken, as said above. Long texts are kept
whole. Empty tables give an empty result or calls without results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.common import cut, discard

MAX_SCHEMAS = 10_000

#: The type names of JSON schemas, with what the values' own types begin with: fixed values.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}


def canonical(arguments: Column) -> Column:
    """Sorted keys, no spaces; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(arguments))


def _chains(degree: DataFrame) -> DataFrame:
    """(call_id, to, steps, done) of the calls with one dependency: the first call behind them that has none or several, if ``done``."""
    now = cut(degree.where("n = 1").select("call_id", F.col("needs").alias("to"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done")), "call-chains")
    before = -1
    while True:
        beyond = now.select(F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        moved = now.join(beyond, "to", "left").select("call_id", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNull().alias("done"))
        new = cut(moved, "call-chains")
        discard(now)
        now, open_ = new, new.where("not done").count()
        # a round that ends no chain has only cycles left, and what is behind them
        if open_ in (0, before):
            return now
        before = open_


def _levels(calls: DataFrame) -> DataFrame:
    """(call_id, level, n_missing) of every call that is on no cycle and behind none."""
    needs = calls.select("call_id", F.explode(F.array_distinct(F.coalesce("depends_on", F.array().cast("array<string>")))).alias("needs")).where(F.col("needs").isNotNull())
    known = cut(needs.join(calls.select(F.col("call_id").alias("needs"), F.lit(True).alias("there")), "needs", "left"), "call-needs")
    missing = known.where(F.col("there").isNull()).groupBy("call_id").agg(F.count("*").alias("n_missing"))
    links = known.where(F.col("there")).select("call_id", "needs")
    degree = cut(links.groupBy("call_id").agg(F.count("*").alias("n"), F.min("needs").alias("needs")), "call-degrees")
    chains = _chains(degree)
    done = calls.select("call_id").join(degree, "call_id", "left_anti").withColumn("level", F.lit(0).cast("long"))
    several = links.join(degree.where("n > 1").select("call_id"), "call_id", "left_semi")
    # what each of them waits for, and how much more its level is; a chain that doesn't end has to be waited for in vain
    way = several.join(chains.select(F.col("call_id").alias("needs"), "to", "steps", "done"), "needs", "left")
    rest = cut(way.select("call_id", F.when(F.coalesce("done", F.lit(True)), F.coalesce("to", "needs")).alias("of"), (F.coalesce("steps", F.lit(0)) + 1).alias("more"), F.lit(None).cast("long").alias("level")), "call-rest")
    last = done
    while not rest.isEmpty():
        met = rest.join(last.select(F.col("call_id").alias("of"), F.col("level").alias("own")), "of", "left").select("call_id", "of", "more", F.coalesce("level", F.col("own") + F.col("more")).alias("level"))
        met = cut(met, "call-rest")
        last = cut(met.groupBy("call_id").agg(F.max("level").alias("level"), F.count("level").alias("n"), F.count("*").alias("of")).where("n = of").select("call_id", "level"), "call-levels")
        discard(rest)
        rest = met
        if last.isEmpty():
            break
        done = done.unionByName(last)
        rest = cut(met.join(last, "call_id", "left_anti"), "call-rest")
        discard(met)
    of_chains = chains.where("done").join(done.select(F.col("call_id").alias("to"), "level"), "to").select("call_id", (F.col("level") + F.col("steps")).alias("level"))
    return done.unionByName(of_chains).join(missing, "call_id", "left").select("call_id", F.col("level").cast("int").alias("level"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"))


def _problems(own: Column, schema: Column) -> Column:
    """What is wrong with arguments (map<string, variant>, null if they are no object), by the schema (array of properties)."""

    def missing(p: Column) -> Column:
        return F.when(p["required"] & ~F.map_contains_key(own, p["property"]), F.concat(F.lit("missing "), p["property"]))

    def mistyped(p: Column) -> Column:
        kind = F.schema_of_variant(own[p["property"]])
        pattern = F.coalesce(*[F.when(p["type"] == name, F.lit(f"^({found})")) for name, found in TYPES.items()], F.lit("^"))
        return F.when(F.map_contains_key(own, p["property"]) & ~F.coalesce(F.regexp_like(kind, pattern), F.lit(False)), F.concat(F.lit("not a "), p["type"], F.lit(" "), p["property"]))

    extra = F.transform(F.array_except(F.map_keys(own), F.transform(schema, lambda p: p["property"])), lambda k: F.concat(F.lit("unknown "), k))
    found = F.concat(F.transform(schema, missing), F.transform(schema, mistyped), extra)
    of_object = F.when(schema.isNull(), F.array().cast("array<string>")).otherwise(F.sort_array(F.filter(found, lambda x: x.isNotNull())))
    return F.when(own.isNull(), F.array(F.lit("arguments are no object"))).otherwise(of_object)


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """One row for each call, and for each result without one: conv_id, call_id, name, level, n_calls, n_results, n_missing, valid, problems and json.

    ``schemas`` has (name, property, type, required). Results may have a conv_id.
    """
    usable = calls.where(F.col("call_id").isNotNull()).select("conv_id", "call_id", "name", "arguments", "depends_on")
    order = F.struct("conv_id", "name", "arguments", "depends_on")
    own = usable.groupBy("call_id").agg(F.min(order).alias("c"), F.count("*").alias("n_calls")).select("call_id", "n_calls", "c.*")
    own = cut(own, "calls")
    where = F.col("conv_id") if "conv_id" in results.columns else F.lit(None).cast(dict(own.dtypes)["conv_id"])
    found = results.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"), F.min(where).alias("result_conv_id"))
    rows = own.join(found, "call_id", "full").withColumn("conv_id", F.when(F.col("n_calls").isNull(), F.col("result_conv_id")).otherwise(F.col("conv_id")))
    rows = rows.join(_levels(own), "call_id", "left")
    if schemas is not None:
        properties = schemas.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("property", "type", F.coalesce("required", F.lit(False)).alias("required")))).alias("schema"))
        if properties.limit(MAX_SCHEMAS + 1).count() <= MAX_SCHEMAS:
            properties = F.broadcast(properties)
        rows = rows.join(properties, "name", "left")
    else:
        rows = rows.withColumn("schema", F.lit(None).cast("array<struct<property:string,type:string,required:boolean>>"))
    given = F.when(F.col("n_calls").isNotNull(), F.coalesce(F.col("arguments"), F.lit("{}")))
    rows = rows.withColumn("canonical", canonical(given))
    as_map = F.when(F.startswith("canonical", F.lit("{")), F.from_json("canonical", "map<string, variant>"))
    rows = rows.withColumn("as_map", as_map).withColumn("problems", F.when(F.col("n_calls").isNull(), F.array(F.lit("no call"))).otherwise(_problems(F.col("as_map"), F.col("schema"))))

    def quoted(c: str) -> Column:
        """The column as a JSON string: what stands between {"x": and }."""
        whole = F.to_json(F.struct(F.col(c).alias("x")))
        return F.when(F.col(c).isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))

    json = F.concat(F.lit('{"arguments":'), F.coalesce(F.col("canonical"), quoted("arguments")), F.lit(',"call_id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit(',"result":'), quoted("content"), F.lit("}"))
    return rows.select(
        "conv_id", "call_id", "name", "level", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
        (F.size("problems") == 0).alias("valid"), "problems", json.alias("json"),
    )


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas of chat turns: a user's turn calls ``reply``, a system's ``instruct``, and the assistant's next turn is the result.

    A user's call depends on the turn before the last one of the assistant, if there is one. A call of a turn without text has no prompt, which is invalid.
    """
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    before = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 2).cast("string"))
    answered = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    whole = turns.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    arguments = F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt")))
    user = F.col("role") == "user"
    calls = whole.where(F.col("role").isin("user", "system")).select(
        F.col("conv_id"), name.alias("call_id"), F.when(user, "reply").otherwise("instruct").alias("name"), arguments.alias("arguments"),
        F.when(user & (F.col("turn") >= 2), F.array(before)).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = whole.where(F.col("role") == "assistant").select("conv_id", answered.alias("call_id"), F.col("text").alias("content"))
    rows = ", ".join(f"('{call}', '{prop}', '{kind}', true)" for call in ("reply", "instruct") for prop, kind in (("prompt", "string"), ("turn", "integer")))
    schemas = turns.sparkSession.sql(f"select * from values {rows} as t(name, property, type, required)")
    return calls, results, schemas


def link_conversations(turns: DataFrame) -> DataFrame:
    """The linked calls of chat turns."""
    found = link(*from_conversations(turns))
    return found.select("conv_id", "call_id", "name", "level", "n_calls", "n_results", "n_missing", "valid", "json")


ORACLE_SQL = """
with turns as (select *, conv_id::varchar || ':' || turn::varchar as id from conversations where conv_id is not null and turn is not null),
told as (select conv_id, turn, id, case role when 'user' then 'reply' else 'instruct' end as name, text from turns where role in ('user', 'system')),
calls as (
  select conv_id, turn, id, count(*) as n_calls, min(name) as name, min(text) filter (name = least_name) as prompt
  from (select *, min(name) over (partition by conv_id, turn) as least_name from told) group by conv_id, turn, id),
results as (select conv_id, turn - 1 as turn, count(*) as n, min(text) as content from turns where role = 'assistant' group by conv_id, turn),
depth as (
  with recursive d as (
    select c.conv_id, c.turn, 0 as level from calls c
    where c.name <> 'reply' or not exists (select 1 from calls p where p.conv_id = c.conv_id and p.turn = c.turn - 2 and c.turn >= 2)
    union all
    select c.conv_id, c.turn, d.level + 1 from d join calls c on c.conv_id = d.conv_id and c.turn = d.turn + 2 and c.name = 'reply' and c.turn >= 2)
  select * from d)
select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.id, r.conv_id || ':' || r.turn) as call_id, c.name, d.level::int as level, coalesce(c.n_calls, 0) as n_calls, coalesce(r.n, 0) as n_results,
  (case when c.name = 'reply' and c.turn >= 2 and not exists (select 1 from calls p where p.conv_id = c.conv_id and p.turn = c.turn - 2) then 1 else 0 end)::bigint as n_missing,
  c.id is not null and c.prompt is not null as valid,
  '{"arguments":' || case when c.id is null then 'null' else '{' || case when c.prompt is null then '' else '"prompt":' || to_json(c.prompt)::varchar || ',' end || '"turn":' || c.turn || '}' end
    || ',"call_id":"' || coalesce(c.id, r.conv_id || ':' || r.turn) || '","name":' || coalesce('"' || c.name || '"', 'null') || ',"result":' || coalesce(to_json(r.content)::varchar, 'null') || '}' as json
from calls c left join depth d using (conv_id, turn) full join results r on r.conv_id = c.conv_id and r.turn = c.turn
"""
