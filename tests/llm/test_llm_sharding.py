import hashlib

from pyspark.sql import functions as F

from basketry.llm import sharding


def test_interleaving_equals_brute_force(documents):
    rows = [(i, f"t{i}", "big" if i % 3 else f"s{i % 7}") for i in range(500)]
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(documents(rows), 8).collect()}
    ranked = []
    for source in {r[2] for r in rows}:
        mine = sorted((hashlib.md5(f"shards:{i}".encode()).hexdigest(), i) for i, _, s in rows if s == source)
        ranked += [((2 * k + 1) / (2 * len(mine)), h, i) for k, (h, i) in enumerate(mine)]
    want, counts = {}, [0] * 8
    for place, (_, _, i) in enumerate(sorted(ranked)):
        shard = place * 8 // len(rows)
        want[i] = (shard, counts[shard])
        counts[shard] += 1
    assert got == want and max(counts) - min(counts) <= 1
    for shard in range(8):
        assert abs(sum(1 for i, _, s in rows if s == "big" and got[i][0] == shard) - 333 / 8) <= 2


def test_written_shards_hold_all_rows(documents, spark, tmp_path):
    docs = documents([(i, f"t{i}", f"s{i % 3}") for i in range(60)])
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(docs.columns).exceptAll(docs).isEmpty() and back.count() == 60
    assert back.groupBy("shard").count().filter("count != 15").isEmpty()


def test_odd_rows(odd, nothing):
    got = sharding.interleave(odd, 4).collect()
    assert len(got) == 9
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots))) and 2 <= len(slots) <= 3
    few = sharding.interleave(odd.filter(F.col("doc_id") < 3), 8).collect()
    assert len({r.shard for r in few}) == 2 and all(r.slot == 0 for r in few)
    assert sharding.interleave(nothing).isEmpty()
