"""Exact dedup, SimHash near-dedup and mixing against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import compare
import pytest
import xxhash
from lexloom.llm import common, components, exact_dedup, mixing, simhash
from pyspark.sql import functions as F

SPACES = re.compile(r"[\x20\x09-\x0D]")


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACES.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for norm, members in groups.items():
        members.sort()
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    return sorted(out, key=repr)


def test_exact_dedup(clashing, odd_docs):
    got = exact_dedup.exact_dedup(clashing)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_exact([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_exact_dedup_groups_over_many_partitions(spark):
    rows = [(k, "same text" if k % 3 else f"own {k}") for k in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_exact(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(shingles))


def brute_components(marks):
    name = list(range(len(marks)))

    def top(k):
        while name[k] != k:
            k = name[k]
        return k

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                name[top(i)] = top(j)
    return [top(k) for k in range(len(marks))]


def test_near_duplicates(clashing, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    marks = [plain_fingerprint(t) for _, t in rows]
    top = brute_components(marks)
    least = {}
    for (doc_id, _), t in zip(rows, top):
        least[t] = min(x for x in (least.get(t), doc_id) if x is not None) if least.get(t) is not None or doc_id is not None else None
    want = sorted(((d, f"{m:016x}", least[t]) for (d, _), m, t in zip(rows, marks, top)), key=repr)
    got = simhash.near_duplicates(clashing).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    # As repeated rows are equal in all that decides, one of each group or more is kept only if they are equal.
    assert {r.component_id for r in got} == {r.component_id for r in got if r.kept}


def spread(seed, families, members, flips):
    """Fingerprints of families, each member some flipped bits away from the one before it."""
    rng = random.Random(seed)
    marks = set()
    for _ in range(families):
        at = rng.getrandbits(64)
        for _ in range(members):
            marks.add(at)
            for b in rng.sample(range(64), rng.randrange(flips)):
                at ^= 1 << b
    return sorted(marks)


def signed(marks):
    return [m - (1 << 64) if m >> 63 else m for m in marks]


def near(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count() <= 3


def test_near_links_are_whole(spark, monkeypatch):
    marks = signed(spread(5, 60, 8, 5))
    monkeypatch.setattr(simhash, "SHORT", 1000)
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(m,) for m in marks], "fp long")).collect()}
    want = {(a, b) for a in marks for b in marks if a < b and near(a, b)}
    assert len(want) > 100 and got == want


@pytest.mark.parametrize("long", [simhash.LONG, 10])
def test_long_lists_join_what_is_linked(monkeypatch, long):
    import numpy as np

    monkeypatch.setattr(simhash, "LONG", long)
    rng = random.Random(8)
    low = {rng.getrandbits(9) | rng.getrandbits(9) << 23 for _ in range(120)} | {rng.getrandbits(32) for _ in range(80)}
    marks = sorted(low)  # one list: the upper four bytes are the same
    found = [(int(x), int(y)) for a, b in simhash._list_links(np.array(marks, np.uint64), 3, (4, 5, 6, 7)) for x, y in zip(a, b)]
    assert all(near(a, b) for a, b in found)
    name = {m: m for m in marks}

    def top(m):
        while name[m] != m:
            m = name[m]
        return m

    for a, b in found:
        name[top(a)] = top(b)
    assert len({top(m) for m in marks}) > 10
    for t, m in zip(brute_components(marks), marks):
        assert top(m) == top(marks[t])
    assert len({top(m) for m in marks}) == len(set(brute_components(marks)))


def apart(rng, n, free):
    """n pairs at three bits, one in each free byte; no other two are at three bits or fewer."""
    import numpy as np

    marks, taken, beside = [], np.zeros(1 << 24, bool), simhash.masks(3)
    while len(marks) < 2 * n:
        at = rng.getrandbits(24)
        twin = at ^ (1 << rng.randrange(8)) ^ (1 << 8 + rng.randrange(8)) ^ (1 << 16 + rng.randrange(8))
        if any(taken[x] or taken[beside ^ np.uint32(x)].any() for x in (at, twin)):
            continue
        taken[[at, twin]] = True
        marks += [sum((x >> 8 * k & 255) << 8 * place for k, place in enumerate(free)) for x in (at, twin)]
    return marks


@pytest.mark.parametrize("own", [None, 3, 6])
@pytest.mark.parametrize("often", [simhash.OFTEN, 10**9])
def test_long_lists_with_constant_bytes_lose_no_link(spark, monkeypatch, own, often):
    """Five constant bytes and more: linked pairs meet in one list only, in that of the plane inside the five."""
    monkeypatch.setattr(simhash, "OFTEN", often)
    rng = random.Random(31)
    free = (0, 4, 7) if own is None else tuple(k for k in (1, 2, 5, 6, 3) if k != own)[:3]
    fixed = sum(rng.getrandbits(8) << 8 * k for k in range(8) if k not in free)
    marks = [fixed | m for m in apart(rng, 2500, free)]
    want = {frozenset(signed(marks[k : k + 2])) for k in range(0, len(marks), 2)}
    found = simhash.links(spark.createDataFrame([(m,) for m in signed(marks)], "fp long"))
    assert {frozenset((r.a, r.b)) for r in found.collect()} == want and len(want) == 2500


@pytest.mark.parametrize("constant", [1, 2, 3])
def test_random_long_lists_join_what_is_linked(spark, monkeypatch, constant):
    """One to three constant bytes beyond the plane; short lists by brute force, cuts from ten fingerprints on."""
    monkeypatch.setattr(simhash, "LONG", 10)
    import numpy as np

    rng = random.Random(constant)
    plane = simhash.PLANES[5]
    others = [k for k in range(8) if k not in plane][constant:]
    base, marks = rng.getrandbits(64), set()
    while len(marks) < 250:
        at = rng.choice(sorted(marks)) if marks and rng.random() < 0.5 else base
        for k in others if at == base else rng.sample(others, 1):
            at ^= (rng.getrandbits(8) if at == base else 1 << rng.randrange(8)) << 8 * k
        marks.add(at)
        if constant == 3 and len(marks) >= 200:
            break
    marks = sorted(marks)
    found = [(int(x), int(y)) for a, b in simhash._list_links(np.array(marks, np.uint64), 3, plane) for x, y in zip(a, b, strict=True)]
    assert all(near(a, b) for a, b in found)
    name = {m: m for m in marks}

    def top(m):
        while name[m] != m:
            m = name[m]
        return m

    for a, b in found:
        name[top(a)] = top(b)
    want = brute_components(marks)
    assert len({top(m) for m in marks}) == len(set(want)) and all(top(m) == top(marks[t]) for t, m in zip(want, marks, strict=True))


def test_many_near_copies_write_few_links(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    marks = sorted({centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(5000)})
    found = simhash.links(spark.createDataFrame([(m,) for m in signed(marks)], "fp long"))
    assert len(marks) > 4500 and found.count() < 14 * simhash.SHORT * len(marks)
    joined = components.components(found)
    assert joined.count() == len(marks) and joined.select("component").distinct().count() == 1


def test_hot_fingerprints(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the very same words', concat('own text ', id, ' of ', id * 7)) AS text")
    got = simhash.near_duplicates(docs)
    assert got.count() == 4000
    assert got.where("doc_id % 3 = 0").select("component_id", "fingerprint").distinct().count() == 1
    assert got.where("doc_id % 3 = 0 and kept").count() == 1


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 300)] + [(7, 7), (1, 2)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 300)}


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, simhash.near_duplicates, mixing.mix, mixing.mixed_documents])
def test_empty(no_docs, f):
    assert f(no_docs).count() == 0


def test_mix_matches_sql(odd_docs, clashing, tmp_path):
    odd_docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    db = compare.duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = compare.rows_of_duck(db, mixing.SQL)
    got = compare.rows_of_spark(mixing.mix(clashing).select("doc_id", "size", "source_size", "target", "taken"))
    assert compare.difference(got, want) == ""


def test_mix_targets_and_copies(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', 50) AS text", "CASE WHEN id % 10 = 0 THEN 'a' WHEN id % 10 = 1 THEN 'b' ELSE 'c' END AS source")
    got = mixing.mix(docs).groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("k"), F.max(F.col("taken") / F.col("size")).alias("m")).collect()
    for r in got:
        assert abs(r.k - r.t) < 0.1 * r.t and r.m <= 3
    assert abs(sum(r.t for r in got) - 150_000) < 1e-6
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() * 50 == sum(r.k for r in got)


def test_mixed_documents_keep_clashing_columns(clashing):
    got = mixing.mixed_documents(clashing)
    assert got.columns == clashing.columns
    assert got.count() == mixing.mix(clashing).agg(F.sum("copies")).first()[0]
    assert got.where("size <> 1 or source__ <> 's'").count() == 0


def test_numbered_keeps_columns(clashing):
    rows, name = common.numbered(clashing)
    assert name not in clashing.columns and rows.drop(name).columns == clashing.columns


def test_numbers_stay_when_the_files_are_split_anew(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(600).selectExpr("id AS doc_id", "uuid() AS text").repartition(6, "doc_id").write.parquet(path)
    keys = ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")
    seen = []
    try:
        spark.conf.set(keys[0], "1")
        spark.conf.set(keys[1], "0")
        rows, name = common.numbered(spark.read.parquet(path))
        seen.append({r.doc_id: r[name] for r in rows.select("doc_id", name).collect()})
        spark.conf.set(keys[0], "64")
        seen.append({r.doc_id: r[name] for r in rows.select("doc_id", name).collect()})
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 600


def test_rows_are_dropped_with_and_without_a_broadcast(spark, monkeypatch):
    docs = spark.range(500).selectExpr("id AS row", "concat('t', id) AS text")
    gone = spark.range(0, 500, 3).selectExpr("id AS row").union(spark.range(0, 30, 3).selectExpr("id AS row"))
    want = {f"t{k}" for k in range(500) if k % 3}
    for most in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        assert {r.text for r in common.without(docs, gone, "row").collect()} == want


def test_mix_with_and_without_a_broadcast(clashing, monkeypatch):
    found = []
    for most in (mixing.BROADCAST_SOURCES, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
        found.append(sorted((tuple(r) for r in mixing.mix(clashing).select("doc_id", "source", "size", "target", "copies", "taken").collect()), key=repr))
    assert found[0] == found[1] and found[0]
