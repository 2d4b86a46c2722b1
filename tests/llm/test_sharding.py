import hashlib
import math
import zlib
from collections import Counter, defaultdict

from llm.helpers import SCHEMA, odd_rows, table
from pyspark.sql import functions as F

from wordwood.llm import sharding


def plain_shard(key, tree):
    row = "\x00null" if key is None else str(key)
    level = [(f"/{r}", f"/{r}/{k}", f"/{r}/{k}/{s}", w) for r, k, s, w in tree]
    path = ""
    for depth in range(3):
        weights = defaultdict(float)
        for leaf in level:
            if depth == 0 or leaf[depth - 1] == path:
                weights[leaf[depth]] += leaf[3]

        def draw(child, weights=weights):
            digits = hashlib.md5((row + child).encode()).hexdigest()[:13]
            return -math.log((int(digits, 16) + 0.5) / 16**13) / weights[child]

        path = min(weights, key=draw)
    return int(path.rsplit("/", 1)[1])


def test_odd_rows(spark):
    rows = odd_rows()
    tree, more = sharding.EIGHT, sharding.grown(sharding.EIGHT)
    got = sharding.place(table(spark, rows), tree, more).collect()
    want = Counter()
    for i, t, _ in rows:
        raw = (t or "").encode()
        want[i, len(raw) + 1, zlib.crc32(raw), plain_shard(i, tree), plain_shard(i, more)] += 1
    assert want == Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got)
    assert {r.law for r in got} == {"key"}


def test_slots_have_no_gap(spark):
    rows = [(i % 700, f"text {i % 40}", "a") for i in range(3000)] + [(None, None, None)] * 500
    got = sharding.place(table(spark, rows)).collect()
    assert len(got) == 3500
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    assert got[0].grown_shard is None


def test_more_copies_than_a_block_has(spark):
    df = spark.range(25_000).select(
        F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text")
    )
    got = sharding.place(df)
    assert got.select("slot").distinct().count() == 25_000
    assert got.agg(F.min("slot"), F.max("slot")).first() == (0, 24_999)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(20_000)
    tree = sharding.EIGHT
    for shards in (9, 10, 11):
        more = sharding.grown(tree)
        moved = ids.select(
            sharding.shard_of(F.col("id"), tree).alias("a"),
            sharding.shard_of(F.col("id"), more).alias("b"),
        )
        counts = {(r.a, r.b): r["count"] for r in moved.groupBy("a", "b").count().collect()}
        assert all(a == b or b == shards - 1 for a, b in counts)
        gained = sum(n for (a, b), n in counts.items() if b == shards - 1)
        assert abs(gained - 20_000 / shards) < 5 * math.sqrt(20_000 / shards)
        tree = more


def test_a_changed_weight_moves_rows_only_along_its_path(spark):
    tree = list(sharding.EIGHT)
    heavier = [(r, k, s, 3.0 if s == 0 else w) for r, k, s, w in tree]
    got = spark.range(20_000).select(
        sharding.shard_of(F.col("id"), tree).alias("a"),
        sharding.shard_of(F.col("id"), heavier).alias("b"),
    ).where("a <> b").distinct().collect()
    # Into the region of shard 0 from the other, into its rack, into itself; never out.
    for r in got:
        assert (r.a // 4 == 1 and r.b // 4 == 0) or (r.a // 2 == 1 and r.b // 2 == 0) or r.b == 0
    sizes = spark.range(20_000).groupBy(sharding.shard_of(F.col("id"), heavier)).count().collect()
    assert abs(dict(map(tuple, sizes))[0] - 6000) < 400


def test_empty_table(spark):
    assert sharding.place(spark.createDataFrame([], SCHEMA)).collect() == []
