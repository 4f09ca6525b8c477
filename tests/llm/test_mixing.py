import heapq

from pyspark.sql import functions as F

from vigil.llm import mixing


def by_quotients(votes, seats):
    queue = [(-v, k, 0) for k, v in votes.items() if v > 0]
    heapq.heapify(queue)
    out = dict.fromkeys(votes, 0)
    for _ in range(seats):
        _, k, n = heapq.heappop(queue)
        out[k] = n + 1
        heapq.heappush(queue, (-votes[k] / (2 * n + 3), k, n + 1))
    return out


def test_seats_are_those_of_the_highest_quotients(spark):
    for votes, seats in (({"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0}, 7), ({f"s{i}": float(i * i % 17 + 1) for i in range(30)}, 101), ({"a": 1.0, "b": 1.0, "c": 1.0}, 2)):
        df = spark.createDataFrame(list(votes.items()), "source string, v double")
        got = mixing.sainte_lague(df, "v", F.lit(seats), [], ["source"], "q").collect()
        assert {r.source: r.q for r in got} == by_quotients(votes, seats)


def test_mix(spark, docs, nothing):
    rows = [(i, f"s{i % 4}" if i % 9 else None, 50 + i % 40) for i in range(400)] + [(400, "tiny", 3), (401, "tiny", 0)]
    sizes = spark.createDataFrame(rows, "_id long, source string, size long")
    got = mixing.apportion(sizes).toPandas()
    again = mixing.apportion(sizes).toPandas()
    assert got.sort_values("_id").reset_index(drop=True).equals(again.sort_values("_id").reset_index(drop=True))
    assert (got.taken <= 3 * got["size"]).all()
    assert abs(got.drop_duplicates("source").target.sum() - got["size"].sum()) < 1e-6
    for _, g in got.groupby("source", dropna=False):
        assert (g.target <= 3 * g.source_size + 1e-9).all()
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 2 * mixing.BLOCK_WORDS
    s = docs.select(F.col("doc_id").alias("_id"), "source", mixing.word_count(F.col("text")).alias("size"))
    assert mixing.apportion(s).count() == 12
    assert mixing.apportion(s.where("false")).count() == 0


def test_small_sources_get_their_share(spark):
    """Sources of 1, 8 and 30 words beside a large one, and small ones alone."""
    rows = [(i, "large", 100) for i in range(300)] + [(1000, "one", 1), (1001, "eight", 5), (1002, "eight", 3), (1003, "thirty", 30)]
    got = mixing.apportion(spark.createDataFrame(rows, "_id long, source string, size long")).toPandas()
    for name, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(2, 0.15 * g.target.iloc[0]), name
    assert got[got.source == "one"].taken.sum() == 3 and got[got.source == "eight"].taken.sum() >= 20
    three = spark.createDataFrame([(i, f"s{i}", 8) for i in range(3)] + [(9, "s9", 40)], "_id long, source string, size long")
    assert all(r.taken > 0 for r in mixing.apportion(three).collect())
    assert sum(r.taken for r in mixing.apportion(spark.createDataFrame([(1, "a", 9)], "_id long, source string, size long")).collect()) == 9


def test_chosen_blocks_are_not_one_run(spark):
    """A shard of 64 blocks of which a part is taken: with documents of one block each, those taken lie apart."""
    rows = [(i, "a", 64) for i in range(64)] + [(100 + i, "b", 64) for i in range(64)]
    got = mixing.apportion(spark.createDataFrame(rows, "_id long, source string, size long")).where("source = 'a'").toPandas()
    part = got.taken.sum() / 64
    assert 40 <= part <= 45  # two thirds of 64: weights 1 and 2
    flags = [t > 32 for _, t in sorted(zip(got["_id"], got.taken, strict=True))]
    assert sum(a != b for a, b in zip(flags, flags[1:], strict=False)) > 10


def test_stage_keeps_every_source_and_tells_null_ids_apart(spark, tmp_path):
    text = lambda n, w: " ".join(f"{w}{k}" for k in range(n))
    rows = [(i, text(60, f"a{i}x"), "big") for i in range(200)] + [(900, text(8, "b"), "small"), (901, text(1, "c"), "tiny"), (902, text(400, "d"), None), (903, "", "big"), (904, None, None)]
    rows += [(None, text(50, f"n{i}x"), "nulls") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.stage(spark, docs, str(tmp_path)).collect()
    assert {r.source for r in got if r.text} == {"big", "small", "tiny", None, "nulls"}
    assert sum(r.doc_id == 903 for r in got) == sum(r.doc_id == 904 for r in got) == 1
    copies = {}
    for r in got:
        if r.doc_id is None:
            copies[r.text] = copies.get(r.text, 0) + 1
    target = mixing.apportion(docs.select(F.monotonically_increasing_id().alias("_id"), "source", mixing.word_count(F.col("text")).alias("size"))).where("source = 'nulls'").first().target
    assert abs(50 * sum(copies.values()) - target) < 0.3 * target
    assert len(set(copies.values())) > 1 or len(copies) < 300
