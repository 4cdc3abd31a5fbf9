"""Quarantine and cascading release of conversations' turns, by parallel tree contraction.

A turn waits for its parent; what it does is a function from its parent's
delivery to its own: in pieces, each a fixed second or so many seconds later,
or no delivery at all.  Trees are contracted in rounds.  A round rakes the
leaves, and compresses chains: a turn with a single child that stands out
among its neighbours by a hash is taken out, and its function is composed into
the child's.  Few rounds, each of joins on (conversation, place), leave
nothing.  The expansion goes back through the rounds and evaluates each turn
that one took out from its parent of then, which a later one took out.

Conversations are numbered, and their releases ranked, by ranges of rows: a
range has its own counts and sums, and those of the ranges before it are added
to each.  So no conversation, however long, meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

SECONDS = 7
ATTEMPTS = 6
#: Seconds from a turn's first attempt to each.
WAITS = [20 * (2**a - 1) for a in range(ATTEMPTS)]
#: Before and after all seconds that occur.
LOW, HIGH = -(1 << 60), 1 << 60
PIECES = "array<struct<lo:bigint,hi:bigint,add:bigint,flat:boolean>>"
_CONV = ["null_conv", "conv"]
_NODE = [*_CONV, "p"]


def _hash(k: int) -> Column:
    """crc32 of ``k:conv_id:turn``; null is written as nothing."""
    conv = F.when(F.col("null_conv"), "").otherwise(F.col("conv").cast("string"))
    return F.crc32(F.concat(F.lit(f"{k}:"), conv, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(""))))


def parent() -> Column:
    distance = _hash(0) % 5
    return F.when((distance > 0) & (F.col("p") >= distance), F.col("p") - distance)


def arrival() -> Column:
    return SECONDS * F.col("p")


def thresholds() -> Column:
    """An array: for each attempt, from which second of the first attempt on it delivers if none before it does; null: never."""
    faulty = _hash(1) % 101 < 50
    repair = arrival() + _hash(2) % 101
    late = [F.when(faulty & (_hash(a + 2) % 3 != 0), repair - WAITS[a - 1]) for a in range(1, ATTEMPTS + 1)]
    return F.array(F.when(~faulty, F.lit(LOW)).otherwise(late[0]), *late[1:])


def _piece(lo: Column, hi: Column, add: Column, flat: Column) -> Column:
    kinds = (("lo", lo, "bigint"), ("hi", hi, "bigint"), ("add", add, "bigint"), ("flat", flat, "boolean"))
    return F.struct(*[c.cast(kind).alias(name) for name, c, kind in kinds])


def delivery_function() -> Column:
    """A turn's pieces over its parent's delivery, which cover LOW to HIGH; ``add`` null: it is never delivered. Needs ``late``, its thresholds."""
    t = [F.col("late")[a] for a in range(ATTEMPTS)]
    shift = F.lit(False)
    found = [F.when(F.least(*t, F.lit(HIGH)) > LOW, _piece(F.lit(LOW), F.least(*t, F.lit(HIGH)), F.lit(None), shift))]
    for a in reversed(range(ATTEMPTS)):
        found.append(F.when(t[a].isNotNull(), _piece(t[a], F.least(*t[:a], F.lit(HIGH), F.lit(HIGH)), F.lit(WAITS[a]), shift)))
    late = F.filter(F.array(*found), lambda x: x.isNotNull() & (x["hi"] > arrival()))
    late = F.transform(late, lambda x: _piece(F.greatest(x["lo"], arrival()), x["hi"], x["add"], x["flat"]))
    early = F.transform(F.slice(late, 1, 1), lambda x: _piece(F.lit(LOW), arrival(), arrival() + x["add"], F.lit(True)))
    return F.concat(early, late).cast(PIECES)


def evaluate(f: Column, at: Column) -> Column:
    """The delivery for a parent's delivery ``at``; null: none."""
    piece = F.get(F.filter(f, lambda x: (x["lo"] <= at) & (at < x["hi"])), F.lit(0))
    return F.when(piece["flat"], piece["add"]).otherwise(piece["add"] + at)


def compose(outer: Column, inner: Column) -> Column:
    """The pieces of outer(inner(at)); neighbours that are the same are one."""

    def through(x: Column) -> Column:
        # What an inner piece gives is a second or a range of them; the outer pieces there, moved back.
        hit = F.filter(outer, lambda y: F.when(x["flat"], (y["lo"] <= x["add"]) & (x["add"] < y["hi"])).otherwise((y["lo"] < x["hi"] + x["add"]) & (y["hi"] > x["lo"] + x["add"])))

        def moved(y: Column) -> Column:
            lo = F.when(x["flat"], x["lo"]).otherwise(F.greatest(x["lo"], y["lo"] - x["add"]))
            hi = F.when(x["flat"], x["hi"]).otherwise(F.least(x["hi"], y["hi"] - x["add"]))
            return _piece(lo, hi, F.when(y["flat"], y["add"]).otherwise(y["add"] + x["add"]), x["flat"] | y["flat"])

        return F.when(x["add"].isNull(), F.array(x)).otherwise(F.transform(hit, moved))

    def joined(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        same = (F.size(done) > 0) & last["add"].eqNullSafe(x["add"]) & (last["flat"] == x["flat"])
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(_piece(last["lo"], x["hi"], x["add"], x["flat"])))
        return F.when(same, longer).otherwise(F.concat(done, F.array(x))).cast(PIECES)

    return F.aggregate(F.flatten(F.transform(inner, through)), F.array().cast(PIECES), joined)


def _ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """Writes ``rows`` sorted into ranges by conversation and ``order``, with the number of the range in ``part``."""
    return materialise(rows.repartitionByRange(*_CONV, *order).withColumn("part", F.spark_partition_id()), "ranges")


def _before(sums: DataFrame, column: Column) -> Column:
    """Sum of ``column`` over a conversation's earlier ranges; a row for each range that it is in."""
    w = Window.partitionBy(*_CONV).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0))


def number_turns(conversations: DataFrame) -> DataFrame:
    """(null_conv, conv, p, turn, crc, par, late): each conversation's turns from 0 by turn.

    crc is that of the text in UTF-8, par the parent's place, late the turn's
    thresholds.  Null turns come first; equal turns are
    ordered by a hash of their texts, repeated rows as they come.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").isNull().alias("null_conv"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["turn", "tie", "row"]
    rows = _ranges(materialise(rows, "turns"), order)
    sums = rows.groupBy(*_CONV, "part").agg(F.count("*").alias("n"))
    sums = sums.select(*_CONV, "part", _before(sums, F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy(*_CONV, "part").orderBy(*order)) - 1
    numbered = rows.join(sums, [*_CONV, "part"]).withColumn("p", F.col("before") + own)
    return materialise(numbered.select(*_NODE, "turn", "crc", parent().alias("par"), thresholds().alias("late")), "numbered")


def contract(nodes: DataFrame) -> list[DataFrame]:
    """What each round takes out of a forest (null_conv, conv, p, par, f): the same columns, par and f as of then.

    Two neighbours are never taken out as links of a chain in one round, since
    each would have to have the larger hash.
    """
    taken = []
    while True:
        number = F.lit(len(taken))
        weight = lambda place, k=number: F.xxhash64(*_CONV, place, k)
        kids = nodes.where("par IS NOT NULL").groupBy(*_CONV, F.col("par").alias("p")).agg(F.count("*").alias("kids"), F.max("p").alias("only"))
        stands_out = (weight(F.col("p")) > weight(F.col("only"))) & (F.col("par").isNull() | (weight(F.col("p")) > weight(F.col("par"))))
        kind = F.when(F.col("kids").isNull(), "leaf").when((F.col("kids") == 1) & stands_out, "link").otherwise("stays")
        seen = nodes.join(kids, _NODE, "left").select(*_NODE, "par", "f", "only", kind.alias("kind"))
        links = seen.where("kind = 'link'").select(*_CONV, F.col("only").alias("p"), F.struct(F.col("par").alias("to"), F.col("f").alias("first")).alias("link"))
        found = seen.join(links, _NODE, "left")
        par = F.when(F.col("link").isNull(), F.col("par")).otherwise(F.col("link.to"))
        f = F.when(F.col("link").isNull(), F.col("f")).otherwise(compose(F.col("f"), F.col("link.first")))
        found = materialise(found.select(*_NODE, par.alias("par"), f.alias("f"), "kind"), f"round-{len(taken)}")
        taken.append(found.where("kind <> 'stays'").drop("kind"))
        nodes = found.where("kind = 'stays'").drop("kind")
        if nodes.isEmpty():
            return taken


def expand(taken: list[DataFrame]) -> DataFrame:
    """(null_conv, conv, p, at): the delivery of every turn, null where there is none."""
    values: list[DataFrame] = []
    for r, rows in reversed(list(enumerate(taken))):
        now = rows.where("par IS NULL").select(*_NODE, evaluate(F.col("f"), F.lit(LOW)).alias("at"))
        if values:
            later = reduce(DataFrame.unionByName, values).withColumnsRenamed({"p": "par", "at": "start"})
            below = rows.where("par IS NOT NULL").join(later, [*_CONV, "par"])
            now = now.unionByName(below.select(*_NODE, evaluate(F.col("f"), F.col("start")).alias("at")))
        values.append(materialise(now, f"values-{r}"))
    return reduce(DataFrame.unionByName, values)


def _attempted(turns: DataFrame, values: DataFrame) -> DataFrame:
    """Adds status, attempts, first_at and last_at, from the delivery of each turn's own parent."""
    start = F.greatest(arrival(), F.col("start"))  # null of a root counts for nothing
    nth = F.least(*[F.when(F.col("first") >= F.col("late")[a], a + 1) for a in range(ATTEMPTS)])
    parents = values.withColumnsRenamed({"p": "par", "at": "start"})
    below = turns.where("par IS NOT NULL").join(parents, [*_CONV, "par"])
    rows = turns.where("par IS NULL").withColumn("start", F.lit(None).cast("long")).unionByName(below)
    rows = rows.withColumn("first", F.when(F.col("par").isNull() | F.col("start").isNotNull(), start)).withColumn("nth", nth)
    status = F.when(F.col("first").isNull(), "blocked").when(F.col("nth").isNull(), "dead").otherwise("delivered")
    attempts = F.when(F.col("first").isNull(), 0).otherwise(F.coalesce("nth", F.lit(ATTEMPTS)))
    last = F.col("first") + F.element_at(F.array(*map(F.lit, WAITS)), F.coalesce("nth", F.lit(ATTEMPTS)))
    return rows.select(*_NODE, "turn", "crc", status.alias("status"), attempts.cast("int").alias("attempts"), F.col("first").alias("first_at"), last.cast("long").alias("last_at"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds release_no and state to delivered turns."""
    order = ["last_at", "turn", "p"]
    w = Window.partitionBy(*_CONV, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exact = lambda c: c.cast("decimal(20,0)")
    own = _ranges(rows, order).withColumn("own", F.row_number().over(w))
    own = own.withColumn("plain", F.sum(exact(F.col("crc"))).over(w)).withColumn("weighted", F.sum(exact(F.col("own") * F.col("crc"))).over(w))
    own = materialise(own, "own")
    sums = own.groupBy(*_CONV, "part").agg(F.max("own").alias("n"), F.max("plain").alias("plain"), F.max("weighted").alias("weighted"))
    sums = sums.withColumn("before", _before(sums, F.col("n")))
    whole = (F.col("weighted") + F.col("before") * F.col("plain")).cast("decimal(38,0)")
    sums = sums.select(*_CONV, "part", F.struct("before", _before(sums, whole).alias("state")).alias("base"))
    out = own.join(sums, [*_CONV, "part"])
    state = F.col("base.state") + F.col("weighted") + F.col("base.before") * F.col("plain")
    return out.withColumn("release_no", F.col("base.before") + F.col("own")).withColumn("state", state.cast("decimal(38,0)").try_cast("long")).select(*rows.columns, "release_no", "state")


def replay(conversations: DataFrame) -> DataFrame:
    """A row per turn: conv_id, turn, status, attempts, first_at, last_at, release_no, state.

    Needs conv_id, turn and text; other columns are ignored.  A null conv_id is
    a conversation of its own; see ``number_turns`` for null and equal turns.
    What doesn't apply is null, and so is a state beyond a long.  An empty
    table gives no rows.
    """
    turns = number_turns(conversations)
    if turns.isEmpty():
        values = turns.select(*_NODE, F.lit(None).cast("long").alias("at"))
    else:
        values = expand(contract(turns.select(*_NODE, "par", delivery_function().alias("f"))))
    rows = materialise(_attempted(turns, values), "attempted")
    released = rows.where("status = 'delivered'")
    others = rows.where("status <> 'delivered'").withColumns({"release_no": F.lit(None).cast("long"), "state": F.lit(None).cast("long")})
    conv = F.when(~F.col("null_conv"), F.col("conv"))
    out = _ranked(released).unionByName(others)
    return out.select(conv.alias("conv_id"), "turn", "status", "attempts", "first_at", "last_at", "release_no", "state")
