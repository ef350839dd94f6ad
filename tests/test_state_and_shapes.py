"""Caches, limits, selection, passages, streams and shapes against plain versions."""

import json
import math
import random
from collections import OrderedDict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexloom.operators import passages, selection, shapes
from lexloom.streaming import caches, limits, stores
from pyspark.sql import functions as F

# ---------------------------------------------------------------- caches


@given(st.lists(st.integers(0, 30), max_size=3000))
@settings(max_examples=30, deadline=None)
def test_distance_is_the_number_of_other_keys(keys):
    uses, last = caches.LastUses(16), {}
    for i, k in enumerate(keys):
        want = len(set(keys[last[k] + 1 : i])) if k in last else None
        assert uses.use(k) == want
        last[k] = i
    assert len(uses.tree) <= 1025


def plain_cache(requests, entries, life):
    held, hits = OrderedDict(), []
    for key, at, kept in requests:
        hit = key in held and held[key] > at
        hits.append(hit)
        if hit:
            held.move_to_end(key)
            continue
        held.pop(key, None)
        held[key] = at + life
        while len(held) > entries:
            held.popitem(last=False)
        if not kept:
            held.pop(key, None)
    return hits


def asked(seed, n):
    rng = random.Random(seed)
    return [(k, rng.choice(["v1", "v2", None]), f"q{min(int(rng.expovariate(0.08)), 60)}", 1_700_000_000 + k * rng.choice([1, 1, 1]), rng.random() < 0.8) for k in range(n)]


def test_caches_over_a_table(spark):
    rows = asked(2, 2500)
    table = spark.createDataFrame(rows, "id long, visit string, key string, s long, kept boolean").selectExpr("id", "visit", "key", "timestamp_seconds(s) AS ts", "kept").repartition(5)
    got = {r.id: r for r in caches.answer_cache(table, F.col("visit"), F.col("key"), F.col("kept"), 8, 300, ["ts", "id"]).collect()}
    far = {r.id: r.distance for r in caches.reuse_distance(table, F.col("visit"), F.col("key"), ["ts", "id"]).collect()}
    for visit in ("v1", "v2", None):
        own = [r for r in rows if r[1] == visit]
        assert [got[r[0]].hit for r in own] == plain_cache([(r[2], r[3], r[4]) for r in own], 8, 300)
        assert [far[r[0]] is not None and far[r[0]] < 8 for r in own] == plain_cache([(r[2], 0, True) for r in own], 8, 1)
    assert any(r.hit for r in got.values()) and set(got[0].asDict()) == {"id", "visit", "key", "ts", "kept", "hit"}
    assert caches.answer_cache(table.where("false"), F.col("visit"), F.col("key"), F.col("kept"), 8, 300, ["ts", "id"]).count() == 0


# ---------------------------------------------------------------- limits


def limited(rows, limit, seconds):
    used, out = {}, {}
    for own, key, s in sorted(rows, key=lambda r: (r[2], r[0])):
        n = used[key, s // seconds] = used.get((key, s // seconds), 0) + 1
        out[own] = (n <= limit, max(0, limit - n), s // seconds * seconds + seconds - s)
    return out


def test_rate_limit_of_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["hot", "hot", "hot", "a", "b", None]), 1_700_000_000 + rng.randrange(4000)) for k in range(4000)]
    table = spark.createDataFrame(rows, "id long, key string, s long").selectExpr("id", "key", "timestamp_seconds(s) AS ts").repartition(6)
    done = limits.rate_limit(table, ["key"], 7, 600, ["ts", "id"])
    assert {r.id: (r.allowed, r.remaining, r.reset_seconds) for r in done.collect()} == limited(rows, 7, 600)
    # Ranks are limited in front of the shuffle: a task gets 7 rows of a key from any other.
    assert "WindowGroupLimit" in done._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- selection


@pytest.mark.parametrize("by", [["g"], []])
def test_nearest_rank(spark, by):
    rng = random.Random(7)
    rows = [(rng.choice(["x", "x", "x", "x", "y", None]), rng.choice([None, float(rng.randrange(40)), rng.random()])) for _ in range(5000)] + [("one", 3.0), ("none", None)]
    shares = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = selection.nearest_rank(spark.createDataFrame(rows, "g string, v double").repartition(4), by, "v", shares).collect()
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g if by else "all", []).append(v)
    want = {g: tuple(sorted(vs)[max(1, math.ceil(s * len(vs))) - 1] for s in shares.values()) for g, vs in groups.items()}
    assert {(r.g if by else "all"): tuple(r[n] for n in shares) for r in got} == want


# ---------------------------------------------------------------- passages


@pytest.mark.parametrize("block", [passages.BLOCK, 20, 1])
def test_passages(spark, block):
    rng = random.Random(5)
    texts = [(k, "".join(rng.choice("ab é") for _ in range(rng.randrange(120)))) for k in range(60)] + [(100, None), (101, "")]
    items = [(k, "".join(rng.choice("ab é") for _ in range(rng.randrange(1, 9)))) for k in range(40)] + [(50, None), (51, ""), (52, "ab"), (53, "ab")]
    got = passages.find_passages(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").coalesce(1), block)
    want = {(i, d, t.find(p)) for d, t in texts if t is not None for i, p in items if p is not None and p in t}
    assert {(r.item_id, r.doc_id, r.start) for r in got.collect()} == want and got.count() == len(want)


def test_no_passages(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert passages.find_passages(docs, docs.where("false").withColumnRenamed("doc_id", "item_id")).count() == 0


# ---------------------------------------------------------------- streams


def batches(spark, made, rows, folder, n):
    """Rows as n files, in order."""
    for k in range(n):
        spark.createDataFrame(rows[k::n] if made is None else made(rows, k), SCHEMA).coalesce(1).write.mode("append").parquet(folder)


SCHEMA = "id long, name string, s long, op string, ttl long, value double"


def test_store_as_a_stream_is_the_table(spark, tmp_path):
    rng = random.Random(11)
    rows = [(k, f"k{rng.randrange(12)}", 1_700_000_000 + 10 * k + rng.randrange(10), rng.choice(["put", "put", "put", "delete"]), rng.choice([None, None, 40, 200, 5000]), rng.choice([None, float(k)])) for k in range(300)]
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    # The end of time: a last change far behind all lifetimes that can end.
    parts = [rows[:80], rows[80:170], rows[170:], [(9999, "end", 1_700_010_000, "put", None, 1.0)], [(10_000, "end", 1_700_010_001, "put", None, 1.0)]]
    last: dict[str, tuple] = {}
    for part in parts:  # a new start of the query for every part: its state comes from the checkpoint
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder).selectExpr("name AS key", "timestamp_seconds(s) AS ts", "id", "op", "ttl", "value")

        def take(batch, _):
            for r in batch.collect():
                last[r.key] = (r.id, r.value) if r.alive else None

        query = stores.kv_stream(stream, "20 seconds").writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
    table = spark.createDataFrame([r for p in parts for r in p], SCHEMA).selectExpr("name", "timestamp_seconds(s) AS ts", "id", "op", "ttl", "value")
    want = {r.name: (r.id, r.value) for r in limits.kv_state(table, ["name"], F.expr("timestamp_seconds(1700010001)")).collect()}
    assert {k: v for k, v in last.items() if v} == want and len(want) > 2 and any(v is None for v in last.values())


def test_route_limits_as_a_stream_are_the_table(spark, tmp_path):
    rng = random.Random(12)
    routes = {"ask": (5, 600), "analyze": (2, 3600)}
    rows = [(k, f"u{rng.randrange(3)}", 1_700_000_000 + 20 * k, rng.choice(["ask", "analyze", "other"]), None, None) for k in range(400)]
    folder, state, got = str(tmp_path / "in"), str(tmp_path / "state"), {}
    for part in (rows[:150], rows[150:160], rows[160:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder).selectExpr("name AS client", "timestamp_seconds(s) AS ts", "id", "op AS route")
        take = lambda batch, _: got.update({r.id: (r.allowed, r.remaining, r.reset_seconds) for r in batch.collect()})
        query = stores.route_limit_stream(stream, routes, "20 seconds").writeStream.foreachBatch(take).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
    table = spark.createDataFrame([r for r in rows if r[3] in routes], SCHEMA).selectExpr("name AS client", "timestamp_seconds(s) AS ts", "id", "op AS route")
    most, seconds = (F.expr("CASE route " + " ".join(f"WHEN '{r}' THEN {x[i]}" for r, x in routes.items()) + " END") for i in (0, 1))
    want = {r.id: (r.allowed, r.remaining, r.reset_seconds) for r in limits.rate_limit(table, ["route", "client"], most, seconds, ["ts", "id"]).collect()}
    assert got == want and len({x[0] for x in got.values()}) == 2


# ---------------------------------------------------------------- shapes

SHAPE = shapes.Record({
    "id": shapes.Text(least=1, most=3, pattern="^c"), "n": shapes.Whole(least=0, most=9), "tags": shapes.Items(shapes.Text(among=("a", "b")), most=2),
    "sub": shapes.Record({"x": shapes.Flag()}, optional=True), "note": shapes.Text(nullable=True, most=2, trimmed=True),
})


def plain_violations(shape, value, path="$"):
    kinds = {shapes.Text: str, shapes.Whole: int, shapes.Flag: bool, shapes.Items: list, shapes.Record: dict}
    if value is None:
        return [] if shape.nullable else [f"{path}: null"]
    if type(value) is not kinds[type(shape)]:
        return [f"{path}: kind"]
    out = []
    if isinstance(shape, shapes.Record):
        for k, own in shape.fields.items():
            out += plain_violations(own, value[k], f"{path}.{k}") if k in value else [] if own.optional else [f"{path}.{k}: missing"]
    elif isinstance(shape, shapes.Items):
        out += [f"{path}: few"] * (len(value) < shape.least) + [f"{path}: many"] * (shape.most is not None and len(value) > shape.most)
        out += [x for k, v in enumerate(value) for x in plain_violations(shape.of, v, f"{path}[{k}]")]
    elif isinstance(shape, shapes.Text):
        import re

        text = value.strip(" ") if shape.trimmed else value
        out += [f"{path}: short"] * (len(text) < shape.least) + [f"{path}: long"] * (shape.most is not None and len(text) > shape.most)
        out += [f"{path}: pattern"] * bool(shape.pattern and not re.search(shape.pattern, text)) + [f"{path}: unknown"] * bool(shape.among and text not in shape.among)
    elif isinstance(shape, shapes.Whole):
        out += [f"{path}: small"] * (shape.least is not None and value < shape.least) + [f"{path}: large"] * (shape.most is not None and value > shape.most)
    return out


def test_violations(spark):
    rng = random.Random(13)
    leaf = lambda: rng.choice([None, True, 3, -1, 12, "c1", "a", "z", "d1xxx", " c ", "", [], ["a", "b"], ["a", 1, "q"], {}, {"x": True}, {"x": 1}, {"x": None}, 10**12])
    bodies = [{k: leaf() for k in ("id", "n", "tags", "sub", "note", "more") if rng.random() < 0.85} for _ in range(800)]
    bodies += [{"id": "c1", "n": 3, "tags": ["a"], "note": None}, [], 7, None]
    texts = [json.dumps(b) for b in bodies]
    rows = spark.createDataFrame([*enumerate(texts), (-1, "nope"), (-2, "{"), (-3, None)], "k int, j string")
    got = {r.k: r.v for r in rows.select("k", shapes.violations(SHAPE, F.col("j")).alias("v")).collect()}
    assert got.pop(-1) == got.pop(-2) == got.pop(-3) == ["$: json"]
    assert got == {k: plain_violations(SHAPE, b) for k, b in enumerate(bodies)} and [] in got.values()
