"""Rule mining on many labelled URLs and on URLs of many tokens."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tickweave.llm import url_rules


def test_many_labelled_urls_that_share_a_token(spark):
    # two sums of hashes of this many rows would pass 64 bits
    df = spark.range(400_000, numPartitions=8).select(
        F.array(F.lit("scheme=https"), F.concat(F.lit("path=p"), (F.col("id") % 50).cast("string"))).alias("tokens"), (F.col("id") % 50 == 7).alias("block")
    )
    items = url_rules.items_of(df, "tokens", "block", 2000)
    assert items.agg(F.count("*"), F.sum(F.size("items"))).first()[:] == (400_000, 800_000)
    rules = url_rules.mine_rules(df, "tokens", "block").collect()
    assert [(r["antecedent"], r["confidence"], r["support"]) for r in rules] == [(["path=p7"], 1.0, 0.02)]


def test_urls_of_many_tokens_are_mined_exactly(spark):
    rng = np.random.default_rng(23)
    urls = []
    for i in range(300):
        common = {f"key=k{j:02d}" for j in range(40) if rng.random() < 0.8}  # far beyond MAX_ITEMS
        if i % 3 == 0:
            common = {f"key=k{j:02d}" for j in range(6) if rng.random() < 0.5}
        rare = rng.random() < 0.1
        tokens = common | ({"key=rare"} if rare else set())
        urls.append((sorted(tokens) or ["x"], bool(rare or {"key=k01", "key=k02", "key=k39"} <= tokens)))
    assert sum(len(t) > url_rules.MAX_ITEMS for t, _ in urls) > 150 and sum(len(t) <= url_rules.MAX_ITEMS for t, _ in urls) > 50
    df = spark.createDataFrame([(t, b, 1, "w") for t, b in urls], "tokens array<string>, block boolean, items int, antecedent string")
    got = {tuple(r["antecedent"]): r["confidence"] for r in url_rules.mine_rules(df, "tokens", "block", 0.05, 0.9).collect()}
    every = sorted({t for tokens, _ in urls for t in tokens})
    sets, want = [(set(t), b) for t, b in urls], {}
    for size in (1, 2, 3):
        for some in itertools.combinations(every, size):
            held = [b for t, b in sets if t.issuperset(some)]
            if sum(held) >= 15 and sum(held) >= 0.9 * len(held) and not any(set(k) < set(some) for k in want):
                want[some] = sum(held) / len(held)
    assert got.keys() == want.keys() and ("key=rare",) in got and any(len(k) == 3 for k in got)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    one = url_rules.mine_rules(df, "tokens", "block", 0.05, 0.9, max_tokens=1).collect()
    assert [r["antecedent"] for r in one] == [[k[0]] for k in sorted(want) if len(k) == 1]
