import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rastermill.llm import ngram_join, queries, sharding, shared, suffix_dedup, warc


def test_matrix_has_its_sums_and_its_law():
    sends, holds = np.array([3, 0, 5, 2]), np.array([4, 1, 5])
    r, seen = np.random.default_rng(0), Counter()
    for _ in range(6000):
        m = sharding.communication_matrix(r, sends, holds)
        assert (m.sum(axis=1) == sends).all() and (m.sum(axis=0) == holds).all()
        seen[int(m[2, 0])] += 1
    for x in range(5):
        law = math.comb(4, x) * math.comb(6, 5 - x) / math.comb(10, 5)
        assert abs(seen[x] / 6000 - law) < 4.5 * math.sqrt(law * (1 - law) / 6000) + 1e-9


def test_large_populations(monkeypatch):
    monkeypatch.setattr(sharding, "NUMPY_MOST", 0)
    r = np.random.default_rng(1)
    for good, bad, sample in ((7, 5, 6), (40, 3, 10), (1, 0, 1), (0, 4, 2), (6, 6, 12)):
        seen = Counter(sharding.hypergeometric(r, good, bad, sample) for _ in range(4000))
        for x in range(sample + 1):
            law = math.comb(good, x) * math.comb(bad, sample - x) / math.comb(good + bad, sample)
            assert abs(seen[x] / 4000 - law) < 4.5 * math.sqrt(law * (1 - law) / 4000) + 1e-9
    good, bad, sample = 30_000_000_000, 70_000_000_000, 5_000_000_000
    draws = np.array([sharding.hypergeometric(r, good, bad, sample) for _ in range(300)], float)
    sd = math.sqrt(sample * 0.3 * 0.7 * (1 - sample / (good + bad)))
    assert abs(draws.mean() - sample * 0.3) < 4.5 * sd / math.sqrt(300) and 0.8 < draws.std() / sd < 1.2
    spread = sharding.multivariate(r, np.array([5, 0, 10**10, 3]), 10**9)
    assert spread.sum() == 10**9 and (spread <= [5, 0, 10**10, 3]).all()


def test_every_order_is_equally_likely():
    """Four rows in blocks of three and one, slices of two, through the functions that the tasks run."""
    seen = Counter()
    for seed in range(4800):
        m = sharding.communication_matrix(np.random.default_rng((seed, 0)), np.array([3, 1]), np.array([2, 2]))
        parts = [sharding._deal(seed)(pa.table({"rid": rids, "block": [b] * len(rids)}), pa.table({"sends": [m[b].tolist()]})) for b, rids in enumerate(([0, 1, 2], [3]))]
        rows = pa.concat_tables(parts).to_pylist()
        order = []
        for s in (0, 1):
            mine = [r["rid"] for r in rows if r["slice"] == s]
            out = sharding._number(seed, np.array([0, 1]), np.array([0, 0]))(pa.table({"rid": mine, "slice": [s] * len(mine)}))
            order += [r["rid"] for r in sorted(out.to_pylist(), key=lambda r: r["slot"])]
        seen[tuple(order)] += 1
    assert len(seen) == 24
    assert sum((n - 200) ** 2 / 200 for n in seen.values()) < 55  # 23 degrees of freedom: beyond it less than 0.0003


def docs(spark, tmp_path, rows):
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, shard string, Slot int, row_id int").repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("n,shards,block", [(200, 16, 20), (5, 8, 20), (0, 4, 20), (90, 3, 1000)])
def test_shards_are_exact(spark, tmp_path, n, shards, block):
    rows = [(None if i % 9 == 0 else i % 7, [None, "", "same", "x" * 5000][i % 4], "s", i, i) for i in range(n)]
    found = sharding.sharded(docs(spark, tmp_path, rows), shards, seed=4, block_rows=block).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(rows, key=key)
    by = {}
    for r in found:
        by.setdefault(r["shard_"], []).append(r["slot_"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(map(len, by.values())) == sorted(x for x in sharding.shard_sizes(n, shards) if x)


def test_written_shards(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    out = str(tmp_path / "out")
    placed = sharding.sharded(rows, 4, block_rows=10)
    sharding.write_shards(placed, out)
    back = spark.read.parquet(out)
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(50))
    assert [r["count"] for r in back.groupBy("shard").count().orderBy("shard").collect()] == [13, 13, 12, 12]


def test_query(spark, sf):
    found = queries.op13_sharding(spark, sf)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert found.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1


# --- rows numbered alike in every job


def test_stable_rows(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    docs.write.parquet(path := str(tmp_path / "many"))
    scan = spark.read.parquet(path)
    for df in (scan, scan.where("doc_id % 2 = 0").select("doc_id"), scan.groupBy("lang").count(), scan.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), scan.union(scan), scan.where(F.rand(1) < 0.5), spark.range(5), scan.limit(0)):
        rows = shared.stable_rows(df, "rid")
        seen = []
        for n in (1, 64):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
            seen.append(sorted(tuple(str(x) for x in r) for r in rows.collect()))
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        assert seen[0] == seen[1] and len({r[-1] for r in seen[0]}) == len(seen[0])


def test_stable_rows_of_files_with_more_rows_than_the_bits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "PLACE_BITS", 2)
    spark.range(1000).repartition(6).write.parquet(path := str(tmp_path / "t"))
    rows = shared.stable_rows(spark.read.parquet(path), "rid")
    assert rows.agg(F.count_distinct("rid")).first()[0] == 1000


@pytest.fixture
def many_files(spark, tmp_path, sf):
    """The documents in 24 files with a third of copies, and pages likewise, below one folder with the other tables."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 1000)
    docs.union(more).repartition(24).write.parquet(str(tmp_path / "documents.parquet"))
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.withColumn("html", F.repeat("html", 3))
    pages.union(pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1000)).repartition(24).write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["op4_ngram_jaccard_join", "op8_warc", "op9_suffix_dedup", "op13_sharding", "drop_near_duplicates"])
def test_results_outlive_a_change_of_executors(spark, many_files, monkeypatch, name):
    """The scans' parallelism changes after every table that is written, as when executors come and go."""
    ask = queries.QUERIES.get(name) or (lambda s, d: corpus_pipeline.drop_near_duplicates(s, s.read.parquet(f"{d}/documents.parquet"), d))
    rows = lambda: sorted(tuple(str(x) for x in r) for r in ask(spark, many_files).collect())
    plain, turns = rows(), []

    def turned(df, label, write=shared.saved):
        out = write(df, label)
        turns.append(label)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", 64 if len(turns) % 2 else 1)
        return out

    for module in (shared, ngram_join, suffix_dedup, warc, sharding, corpus_pipeline):
        monkeypatch.setattr(module, "saved", turned)
    try:
        assert rows() == plain and turns
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    if name == "op8_warc":
        assert sum("revisit" in r for r in plain) >= 10
