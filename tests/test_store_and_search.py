import random

from gristmill.operators import near
from gristmill.sources import frontier_store


def test_store(spark, tmp_path):
    path = str(tmp_path / "frontier")
    seeds = ["http://a.example/1", "http://a.example/2"]
    assert {r.url for r in frontier_store.open_store(spark, path, seeds).collect()} == set(seeds)
    frontier_store.mark_complete(spark.createDataFrame([(seeds[0],), (seeds[0],)], "url string"), path)
    again = {r.url: (r.completed, r.seq) for r in frontier_store.open_store(spark, path, ["http://ignored.example/"]).collect()}
    assert again == {seeds[0]: (True, 0), seeds[1]: (False, 1)}
    frontier_store.compact(spark, path, str(tmp_path / "to"))
    assert spark.read.parquet(str(tmp_path / "to")).count() == 2
    assert frontier_store.open_store(spark, path, restart=True).count() == 0


def test_search_equals_brute_force(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(63) for _ in range(20)]
    index = [b ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for b in base for _ in range(4)] + base[:5] * 3
    df = spark.createDataFrame([(v, "x") for v in index] + [(None, "x")], "simhash bigint, value string").select("simhash")
    asked = spark.createDataFrame(list(enumerate(base)) + [(99, None)], "doc_id bigint, simhash bigint")
    got = {(r.doc_id, r.value, r.distance, r.n_entries) for r in near.search(asked, df).collect()}
    want = {(i, v, (b ^ v).bit_count(), index.count(v)) for i, b in enumerate(base) for v in index if (b ^ v).bit_count() <= 3}
    assert got == want and near.search(asked, df.limit(0)).count() == 0
