"""Chat formatting: linking tool calls to their results, in native operations.

Turns become events. A turn whose text is JSON with ``tool_calls`` holds calls, one with
``tool_call_id`` a result. In transcripts without such JSON a user turn is a call of the
tool ``reply`` with the identifier ``turn:<n>``, and the assistant turn n+1 its result;
other turns are plain messages.

Calls and results are hash-joined by (conversation, identifier). Each side is first
reduced to its earliest event by identifier with partial aggregation, so a repeated
identifier is one row before it meets the other side. Arguments are checked against a
schema of each tool by the types of a parsed variant, and records are serialised as
canonical JSON: keys sorted, no white space.

Order: an event stands after all it depends on (a result after its call, a call after the
results that its ``after`` names). Its place is (rank, hop), the larger of its own turn
with hop 0 and, of what it depends on, the place with hop + 1. Conversations whose
dependencies all point to earlier turns are in order as they stand. The events of the
others are settled from those without dependencies on: chains of events with one
dependency are shortened by pointer doubling, in as many rounds as the logarithm of their
length; what then depends on settled events alone is settled, and the rest goes round
again. A round that settles nothing has only events that lie on a cycle or behind one.
No number of rounds is fixed: rounds follow the nesting of events with several
dependencies, and an order is exact at any length.

Nothing is gathered by conversation, so one of any length is spread over all tasks.

Defined results: null or broken JSON is text; a null or empty identifier links nothing
(status ``orphan`` or ``unanswered``); of several calls or results with one identifier
the earliest turn (then the smallest text) is linked, the rest are ``duplicate``; rows
alike in all columns count as one; null arguments are ``{}``; events on a cycle or behind
one have a null place and status ``cycle``. Further columns are never read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Of each tool the fields of its arguments: type and whether one is needed.
SCHEMAS: Mapping[str, Mapping[str, tuple[str, bool]]] = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}
_TYPES = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<.*",
    "object": "^OBJECT<.*"
}
_CALL = "struct<tool_calls: array<struct<id: string, name: string, arguments: string, after: array<string>>>, tool_call_id: string, content: string>"


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no white space; null for broken JSON."""
    return F.to_json(F.try_parse_json(json))


def problem(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments, or null."""
    parsed = F.try_parse_json(arguments)
    out = F.when(parsed.isNull(), "arguments are not JSON").otherwise("unknown tool")
    for tool, fields in sorted(schemas.items()):
        own = F.when(parsed.isNull(), "arguments are not JSON").when(~F.schema_of_variant(parsed).rlike(_TYPES["object"]), "arguments are no object")
        for field, (kind, needed) in sorted(fields.items()):
            there = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
            if needed:
                own = own.when(there.isNull() | (there == "VOID"), f"{field} is missing")
            own = own.when(there.isNotNull() & (there != "VOID") & ~there.rlike(_TYPES[kind]), f"{field} is not of type {kind}")
        out = F.when(name == tool, own).otherwise(out)
    return out


def events(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, seq, role, kind (call, result or message), call_id, name, arguments, after, content."""
    narrow = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    looks = F.col("text").rlike(r'^\s*\{') & (F.instr("text", '"tool_call') > 0)
    read = narrow.withColumn("j", F.when(looks, F.from_json("text", _CALL)))
    null = F.lit(None).cast("string")

    def one(kind: Column | str, call_id: Column, name: Column, arguments: Column, after: Column, content: Column) -> Column:
        return F.struct(
            (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.nullif(call_id, F.lit("")).alias("call_id"), name.alias("name"),
            arguments.alias("arguments"), after.alias("after"), content.alias("content")
        )

    nothing = F.array().cast("array<string>")
    label = lambda n: F.concat(F.lit("turn:"), n.cast("string"))
    told = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    call = one("call", label(F.col("turn")), F.lit("reply"), told, nothing, null)
    result = one("result", label(F.col("turn") - 1), null, null, nothing, F.col("text"))
    message = one("message", null, null, null, nothing, F.col("text"))
    calls = F.transform(
        "j.tool_calls", lambda c: one("call", c["id"], c["name"], F.coalesce(c["arguments"], F.lit("{}")), F.coalesce(c["after"], nothing), null)
    )
    found = F.when(F.size("j.tool_calls") > 0, calls).when(
        F.col("j.tool_call_id").isNotNull(), F.array(one("result", F.col("j.tool_call_id"), null, null, nothing, F.col("j.content")))
    )
    plain = F.when(F.col("role") == "user", F.array(call)).when(F.col("role") == "assistant", F.array(result)).otherwise(F.array(message))
    return read.select("conv", "turn", "role", F.posexplode(F.coalesce(found, plain)).alias("seq", "e")).select("conv", "turn", "seq", "role", "e.*")


def link(turns: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]] = SCHEMAS, **columns: str) -> DataFrame:
    """A row for each event: conv, turn, seq, kind, call_id, status, problem, rank, hop, json."""
    plain = events(turns, **columns).distinct()
    body = F.coalesce(F.col("arguments"), F.col("content"), F.lit(""))
    found = plain.withColumn(
        "key",
        F.sha2(
            F.concat_ws(
                "\x00", F.coalesce(F.col("conv").cast("string"), F.lit("null")), F.coalesce(F.col("turn").cast("string"), F.lit("null")),
                F.col("seq").cast("string"), "role", "kind", F.coalesce("call_id", F.lit("")), F.coalesce("name", F.lit("")),
                F.concat_ws("\x01", "after"), body
            ),
            256
        )
    )
    rank = F.struct(F.col("turn"), F.col("seq"), F.col("key"))
    firsts = found.filter("call_id is not null").groupBy(F.col("conv").alias("c"), F.col("call_id").alias("i")).agg(
        F.min(F.when(F.col("kind") == "call", rank)).alias("first_call"), F.min(F.when(F.col("kind") == "result", rank)).alias("first_result")
    )
    met = found.join(firsts.hint("shuffle_hash"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), "left").drop("c", "i")
    own = F.when(F.col("kind") == "call", F.col("first_call.key")).otherwise(F.col("first_result.key"))
    other = F.when(F.col("kind") == "call", F.col("first_result.key")).otherwise(F.col("first_call.key"))
    status = F.when(
        F.col("kind") == "message", "message"
    ).when(own != F.col("key"), "duplicate").when(other.isNotNull(), "linked").when(F.col("kind") == "call", "unanswered").otherwise("orphan")
    wrong = F.when(F.col("kind") == "call", problem(F.col("name"), F.col("arguments"), schemas))
    linked = materialise(
        met.select(
            "conv", "turn", "seq", "role", "kind", "call_id", "name", "arguments", "content", "after", "key",
            F.col("first_call.key").alias("call_key"), F.col("first_call.turn").alias("call_turn"), status.alias("status"), wrong.alias("problem")
        ),
        "linked"
    )
    placed = _placed(linked)
    record = F.to_json(
        F.struct(
            F.expr("CASE WHEN kind = 'call' THEN coalesce(try_parse_json(arguments), parse_json('null')) END").alias("arguments"), F.col("call_id"),
            F.when(F.col("kind") != "call", F.coalesce("content", F.lit(""))).alias("content"), "kind", "name", "role", "status"
        )
    )
    return placed.select(
        "conv", "turn", "seq", "kind", "call_id", F.when(F.col("rank").isNull(), "cycle").otherwise(F.col("status")).alias("status"), "problem",
        "rank", "hop", record.alias("json")
    )


def _later(place: Column, hops: Column) -> Column:
    """The place ``hops`` behind ``place``."""
    return F.struct(place["rank"].alias("rank"), (place["hop"] + hops).alias("hop"))


def _placed(linked: DataFrame) -> DataFrame:
    """``linked`` with rank and hop."""
    rank = F.coalesce("turn", F.lit(-1)).cast("long")
    own = F.struct(rank.alias("rank"), F.lit(0).cast("long").alias("hop"))
    answered = linked.filter("kind = 'result' and status = 'linked'")
    depends = answered.select(
        "conv", F.col("key").alias("later"), F.col("call_key").alias("sooner"), F.coalesce("call_turn", F.lit(-1)).alias("from"), rank.alias("to")
    )
    wants = linked.select(F.col("conv").alias("c"), F.col("key").alias("later"), rank.alias("to"), F.explode("after").alias("i"))
    results = answered.select("conv", "call_id", F.col("key").alias("sooner"), rank.alias("from"))
    wants = wants.join(results, F.col("c").eqNullSafe(F.col("conv")) & (F.col("i") == F.col("call_id"))).select("conv", "later", "sooner", "from", "to")
    edges = depends.unionByName(wants)
    strange = materialise(edges.filter("from >= to").select(F.col("conv").alias("c")).distinct(), "out-of-order")
    if strange.isEmpty():
        return linked.select("*", own["rank"].alias("rank"), F.lit(0).alias("hop"))
    some = linked.join(strange, F.col("conv").eqNullSafe(F.col("c")), "left_semi").select("key", own.alias("place"))
    inside = edges.join(strange, F.col("conv").eqNullSafe(F.col("c")), "left_semi").select("later", "sooner", F.lit(1).cast("long").alias("hops")).distinct()
    places = _settled(materialise(some, "events"), materialise(inside, "dependencies"))
    places = places.select(F.col("key").alias("of"), "place", F.lit(True).alias("sought"))
    # an event of a conversation out of order that was not settled has no place
    out = linked.join(strange.withColumn("odd", F.lit(True)), F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    out = out.join(places, out["key"] == places["of"], "left")
    place = F.when(F.col("odd").isNull(), own).otherwise(F.col("place"))
    return out.select(*linked.columns, place["rank"].alias("rank"), place["hop"].cast("int").alias("hop"))


def _settled(events: DataFrame, edges: DataFrame) -> DataFrame:
    """key and place of each event that is neither on a cycle nor behind one.

    ``events`` has key and place (its least), ``edges`` later, sooner and hops.
    """
    settled, chains = [], []
    while True:
        # events by how many dependencies they have left
        counted = edges.groupBy("later").agg(F.count(F.lit(1)).alias("n"), F.min("sooner").alias("sooner"), F.min("hops").alias("hops"))
        found = materialise(
            events.join(counted, events["key"] == counted["later"], "left").select(
                "key", "place", F.coalesce("n", F.lit(0)).alias("n"), "sooner", "hops"
            ),
            "counted"
        )
        free = found.filter("n = 0").select("key", "place")
        chain = _shortened(found.filter("n = 1").select("key", "sooner", "hops", "place"))
        several = found.filter("n > 1").select("key", "place")
        settled.append(free)
        chains.append(chain)
        if several.isEmpty():
            break
        # dependencies on a chain pass to where the chain begins, those on settled events into the place
        joined = edges.join(several.select(F.col("key").alias("later")), "later")
        short = chain.select(F.col("key").alias("sooner"), F.col("sooner").alias("start"), F.col("hops").alias("more"), F.col("place").alias("least"))
        passed = joined.join(short, "sooner", "left").select(
            "later", F.coalesce("start", "sooner").alias("sooner"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            _later(F.col("least"), F.col("hops")).alias("push"), F.col("least").isNotNull().alias("pushed")
        )
        known = free.select(F.col("key").alias("sooner"), F.col("place").alias("settled"))
        passed = materialise(passed.join(known, "sooner", "left").withColumn("open", F.col("settled").isNull()), "passed")
        pushes = passed.select(
            "later", F.greatest(F.when(F.col("pushed"), F.col("push")), F.when(~F.col("open"), _later(F.col("settled"), F.col("hops")))).alias("push")
        )
        pushes = pushes.groupBy("later").agg(F.max("push").alias("push"))
        events = materialise(
            several.join(pushes, several["key"] == pushes["later"], "left").select("key", F.greatest("place", "push").alias("place")), "events"
        )
        edges = materialise(passed.filter("open").groupBy("later", "sooner").agg(F.max("hops").alias("hops")), "dependencies")
        fewer = edges.groupBy("later").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").count()
        if fewer == events.count():
            break  # each of them has several dependencies left, so none of them begins
    places = settled.pop()
    chain = chains.pop()
    while True:
        begin = places.select(F.col("key").alias("sooner"), F.col("place").alias("settled"))
        behind = chain.join(begin, "sooner").select("key", F.greatest("place", _later(F.col("settled"), F.col("hops"))).alias("place"))
        places = materialise(places.unionByName(behind), "places")
        if not settled:
            return places
        places, chain = places.unionByName(settled.pop()), chains.pop()


def _shortened(chain: DataFrame) -> DataFrame:
    """``chain`` (key, sooner, hops, place) with ``sooner`` moved on to an event outside of it.

    Each round doubles how far an event sees. What sees as far as the chain has events and
    still looks at one of them is on a cycle or behind one, and is left out.
    """
    chain = materialise(chain, "chain")
    n, far = chain.count(), 1
    while True:
        ahead = chain.select(F.col("key").alias("at"), F.col("sooner").alias("next"), F.col("hops").alias("more"), F.col("place").alias("least"))
        seen = chain.join(ahead, chain["sooner"] == ahead["at"], "left")
        if far >= n:  # no chain without a cycle is longer
            return materialise(seen.filter("at is null").select("key", "sooner", "hops", "place"), "chain")
        moved = materialise(
            seen.select(
                "key",
                F.coalesce("next", "sooner").alias("sooner"),
                (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
                F.greatest("place", F.when(F.col("at").isNotNull(), _later(F.col("least"), F.col("hops")))).alias("place"),
                F.col("at").isNotNull().alias("moved"),
            ),
            "chain",
        )
        still = moved.filter("moved").isEmpty()
        chain, far = moved.drop("moved"), 2 * far
        if still:
            return chain
