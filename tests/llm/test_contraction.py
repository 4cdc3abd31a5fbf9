"""Replays against a turn-by-turn simulation: long conversations, nulls, equal turns, many ranges."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexmill.llm import contraction
from lexmill.llm.shared import table

SCHEMA = "conv_id long, turn long, text string"


def simulated(rows):
    """What each turn does, one after the other; rows must have no equal turns of different texts."""
    conversations, out = {}, []
    for conv, turn, text in rows:
        conversations.setdefault(conv, []).append((turn, text))
    for conv, turns in conversations.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        done = []
        for p, (turn, _) in enumerate(turns):
            h = [zlib.crc32(f"{k}:{'' if conv is None else conv}:{'' if turn is None else turn}".encode()) for k in range(9)]
            parent = done[p - h[0] % 5] if 0 < h[0] % 5 <= p else None
            if parent and parent[0] != "delivered":
                done.append(("blocked", 0, None, None))
                continue
            first = now = max(7 * p, parent[3] if parent else 0)
            for a in range(1, 7):
                if h[1] % 101 >= 50 or (now >= 7 * p + h[2] % 101 and h[a + 2] % 3):
                    done.append(("delivered", a, first, now))
                    break
                if a == 6:
                    done.append(("dead", 6, first, now))
                now += 20 * 2 ** (a - 1)
        state, released = 0, {}
        for n, i in enumerate(sorted((i for i, x in enumerate(done) if x[0] == "delivered"), key=lambda i: (done[i][3], i)), 1):
            state += n * zlib.crc32((turns[i][1] or "").encode())
            released[i] = (n, state)
        out += [(conv, turns[i][0], *x, *released.get(i, (None, None))) for i, x in enumerate(done)]
    return sorted(out, key=repr)


def made_rows():
    rnd = random.Random(5)
    rows = [(10_000 + k, t, f"turn {t}") for k in range(5) for t in range(rnd.randint(30, 200))]
    rows += [(7, 3 * t, "long" * (t % 5)) for t in range(1500)]
    rows += [(None, t, None) for t in range(15)]
    rows += [(8, None, "no turn"), (8, 0, ""), (8, -4, "before"), (9, 5, "same"), (9, 5, "same"), (9, 5, "same"), (9, 6, "é 😀")]
    return rows


def test_replay_is_the_simulation(spark):
    rows = made_rows()
    out = contraction.replay(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((tuple(r) for r in out), key=repr) == simulated(rows)


def test_a_conversation_of_a_third_of_all_rows_is_spread(spark):
    rows = [(1, t, "x") for t in range(3000)] + [(10 + k, t, "y") for k in range(750) for t in range(8)]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        ranges = contraction._ranges(contraction.number_turns(spark.createDataFrame(rows, SCHEMA)), ["turn"])
        sizes = [r["count"] for r in ranges.groupBy("part").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) <= 4 * sum(sizes) / len(sizes)


def test_rounds_compose_what_the_chain_does(spark):
    """Each taken function, at its parent's delivery, gives what the simulation does; few rounds do for a long chain."""
    rows = [(1, t, "x") for t in range(2000)]
    turns = contraction.number_turns(spark.createDataFrame(rows, SCHEMA))
    taken = contraction.contract(turns.select(*contraction._NODE, "par", contraction.delivery_function().alias("f")))
    assert len(taken) <= 12 and sum(x.count() for x in taken) == 2000
    got = {r.p: r["at"] for r in contraction.expand(taken).collect()}
    assert got == {x[1]: x[5] if x[2] == "delivered" else None for x in simulated(rows)}


@pytest.mark.parametrize("seed", range(3))
def test_pieces(spark, seed):
    """compose(g, f) at any second is g at what f gives there."""
    rnd = random.Random(seed)

    def function():
        cuts = sorted(rnd.sample(range(0, 200), 4))
        bounds = list(zip([contraction.LOW, *cuts], [*cuts, contraction.HIGH], strict=True))
        return [(lo, hi, rnd.choice([None, rnd.randint(0, 90), rnd.randint(0, 90)]), i == 0 or rnd.random() < 0.3) for i, (lo, hi) in enumerate(bounds)]

    def value(f, at):
        lo, hi, add, flat = next(x for x in f if x[0] <= at < x[1])
        return None if add is None else add if flat else add + at

    rows = [(function(), function(), at) for at in rnd.sample(range(-5, 400), 60)]
    df = spark.createDataFrame(rows, f"f {contraction.PIECES}, g {contraction.PIECES}, at long")
    both = df.withColumn("both", contraction.compose(F.col("g"), F.col("f"))).withColumn("found", contraction.evaluate(F.col("both"), F.col("at")))
    for (f, g, at), r in zip(rows, both.collect(), strict=True):
        inner = value(f, at)
        assert r.found == (None if inner is None else value(g, inner))


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", p long, par long, f long, kind string, part int")
    assert contraction.replay(empty).collect() == []
    clash = spark.createDataFrame([(1, 0, "a", 9, 9, 9, "x", 1)], SCHEMA + ", p long, par long, f long, kind string, part int")
    assert [tuple(r)[:2] for r in contraction.replay(clash).collect()] == [(1, 0)]


def test_whole_table(spark):
    from conftest import SF_DIR

    rows = [tuple(r) for r in table(spark, SF_DIR, "conversations").select("conv_id", "turn", "text").collect()]
    out = contraction.replay(table(spark, SF_DIR, "conversations")).collect()
    assert sorted((tuple(r) for r in out), key=repr) == simulated(rows)
