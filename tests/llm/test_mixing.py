import math
import random

from tidemark.llm.mixing import mix_documents, reached_shares

SIZES, TARGETS = "doc bigint, source string, tokens bigint", "mix_name string, source string, target_weight double, max_repeats int"


def sizes(spark, seed=1, n=600):
    rng = random.Random(seed)
    data = [(i, rng.choices("abc", (6, 3, 1))[0], rng.randrange(1, 400)) for i in range(n)]
    return data, spark.createDataFrame(data, SIZES)


def test_shares_and_caps(spark):
    data, df = sizes(spark)
    targets = spark.createDataFrame([("m", "A ", 2.0, 1), ("m", "b", 1.0, 2), ("m", "c", 1.0, 3), ("n", "a", 1.0, 1), ("n", "absent", 1.0, 5)], TARGETS)
    got = {(r.mix_name, r.source): r for r in reached_shares(df, targets).collect()}
    total = {s: sum(t for _, x, t in data if x == s) for s in "abc"}
    whole = min(total["a"] / 0.5, total["b"] * 2 / 0.25, total["c"] * 3 / 0.25)
    for s, share in (("a", 0.5), ("b", 0.25), ("c", 0.25)):
        r = got["m", s]
        assert abs(r.reached_tokens - share * whole) <= 400 and abs(r.reached_share - share) < 0.01 and r.target_share == share
    assert got["n", "absent"].reached_tokens == 0 and got["n", "a"].reached_share == 1.0
    copies = {(r.mix_name, r.doc): r.copies for r in mix_documents(df, targets).collect()}
    kind = {d: s for d, s, _ in data}
    assert all(c <= {"a": 1, "b": 2, "c": 3}[kind[d]] for (_, d), c in copies.items())


def test_ranges_do_not_matter_and_order_is_pareto(spark):
    data, df = sizes(spark, 2)
    targets = spark.createDataFrame([("m", "a", 1.0, 2), ("m", "b", 1.0, 2)], TARGETS)
    few, many = ({(r.doc, r.copies) for r in mix_documents(df, targets, 30_000, buckets=k).collect()} for k in (1, 4096))
    assert few == many
    # brute force: take documents in order of their rank until the target
    from pyspark.sql import functions as F

    ranks = {r.doc: r.u for r in df.select("doc", ((F.pmod(F.xxhash64("doc", F.lit("m"), F.lit(17)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)).alias("u")).collect()}
    for s in "ab":
        own = [(d, t) for d, x, t in data if x == s]
        target, size = 15_000, sum(t for _, t in own)
        base = math.floor(target / size)
        rest, taken, run = target - base * size, {}, 0
        for d, t in sorted(own, key=lambda x: (ranks[x[0]], x[0])):
            run += t
            if base + (run - t / 2 <= rest):
                taken[d] = base + (run - t / 2 <= rest)
        assert {(d, c) for d, c in few if dict((a, b) for a, b, _ in data)[d] == s} == set(taken.items())


def test_weights(spark):
    from pyspark.sql import functions as F

    data, df = sizes(spark, 3)
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)
    got = [r.doc for r in mix_documents(df, targets, 20_000, weight=F.when(F.col("doc") % 2 == 0, 3.0).otherwise(1.0)).collect()]
    assert sum(d % 2 == 0 for d in got) > 1.8 * sum(d % 2 for d in got)


def test_edges(spark):
    _, df = sizes(spark, 4, 5)
    for rows in ([], [("m", None, 1.0, 1)], [("m", "a", None, 1)], [("m", "a", -1.0, 1)], [("m", "a", 1.0, 0)]):
        targets = spark.createDataFrame(rows, TARGETS)
        assert mix_documents(df, targets).collect() == []
        assert all(r.reached_tokens == 0 for r in reached_shares(df, targets).collect())
    assert mix_documents(df.limit(0), spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)).collect() == []


def test_inclusion_frequencies(spark):
    """Copies of each document over many mixes with random numbers of their own, against its expected copies."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    sizes_ = [rng.choice((3, 5, 9, 20, 40, 90)) for _ in range(60)]
    docs = spark.createDataFrame([(i, "a", t) for i, t in enumerate(sizes_)], SIZES)
    mixes, cap, total = 400, 3, 3000
    targets = spark.createDataFrame([(f"m{k}", "a", 1.0, cap) for k in range(mixes)], TARGETS)
    got = mix_documents(docs, targets, total, weight=F.col("tokens").cast("double")).cache()
    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(t * min(cap, mid * t) for t in sizes_) < total else (low, mid)
    mean = {r.doc: r.c / mixes for r in got.groupBy("doc").agg(F.sum("copies").alias("c")).collect()}
    for i, t in enumerate(sizes_):
        expected = min(cap, low * t)
        assert math.floor(expected) <= mean.get(i, 0.0) <= math.ceil(expected)
        assert abs(mean.get(i, 0.0) - expected) < 0.12
    assert low * 90 > cap and low * 5 < 1  # some at the cap, some below one
    sums = [r.s for r in got.groupBy("mix_name").agg(F.sum(F.col("tokens") * F.col("copies")).alias("s")).collect()]
    assert len(sums) == mixes and all(abs(s - total) <= 45 for s in sums)


def test_one_plan_and_no_job_while_it_is_built(spark):
    from tidemark.llm.mixing import document_sizes

    docs = spark.createDataFrame([(i, "a", "word " * i) for i in range(30)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)
    tracker, group = spark.sparkContext.statusTracker(), "building"
    spark.sparkContext.setJobGroup(group, group)
    mixed = mix_documents(document_sizes(docs), targets, 60)
    assert not tracker.getJobIdsForGroup(group)
    assert mixed.count() > 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
