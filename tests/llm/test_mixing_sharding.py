from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tapeworks.llm import mixing, sharding
from tapeworks.llm.queries import QUERIES


def filled(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Clamp and deal again until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            open_.remove(s)
        left = share * sum(sizes.values()) - sum(target.values())


def test_mix(spark, sf, odd, empty):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        words = lambda t: len((t or "").encode().split())
        sizes, longest = Counter(), Counter()
        for r in df.collect():
            sizes[r.source] += words(r.text)
            longest[r.source] = max(longest[r.source], words(r.text))
        rows = mixing.sized(df)
        once, again = (mixing.repeats(rows, mixing.plan(rows)).collect() for _ in range(2))
        assert Counter(map(str, once)) == Counter(map(str, again)) and len(once) == df.count()
        want, taken = filled(sizes), Counter()
        for r in once:
            taken[r.source] += r["size"] * r.times
            assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and 0 <= r.times <= 2 and r.source_size == sizes[r.source]
        ties = 2 if df is odd else 1  # repeated rows are taken together
        assert all(abs(taken[s] - want[s]) <= ties * longest[s] / 2 + 1 for s in sizes)
        mix = mixing.mixed(df, mixing.plan(rows))
        assert mix.columns == df.columns and mix.count() == sum(r.times for r in once)
    assert mixing.plan(mixing.sized(empty)).count() == 0 and mixing.mixed(empty, mixing.plan(mixing.sized(empty))).count() == 0


def test_shards(spark, sf, odd, empty):
    import zlib
    got = QUERIES["op3_virtual_slots"](spark, sf).collect()
    text = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(text)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        assert r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and 0 <= r.shard < 8
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 2 * max(r["size"] for r in got)
    rows, _ = sharding.shard(odd, 4)
    assert rows.count() == odd.count() and {r["size"] for r in rows.where("doc_id = 3").collect()} == {1}
    assert sharding.shard(empty, 4)[0].count() == 0


def test_map_is_edited(spark):
    """A new shard takes slots, what need not move stays, and repeated rows spread over slots."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    same = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    rows = sharding.records(df.unionByName(same), slots=256)
    sizes = sharding.slot_sizes(rows)
    top = {r.virtual_slot: r["bytes"] for r in sizes.collect()}
    assert max(top.values()) < 4 * sum(top.values()) / 256
    first = sharding.first_map(spark, 4, 256)
    second = first.unionByName(sharding.rebalance(first, sizes, 5)).cache()
    before, after = ({r.virtual_slot: r.shard for r in sharding.at_version(second, v).collect()} for v in (1, None))
    moved = [s for s in before if before[s] != after[s]]
    assert len(after) == 256 and len(moved) < 0.4 * 256 and second.where("version = 2").count() == len(moved)
    load = Counter()
    for s, b in top.items():
        load[after[s]] += b
    assert max(load.values()) - min(load.values()) <= 2 * max(top.values())
