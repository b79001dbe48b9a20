import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutation(spark, n):
    x = spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n).cast("long"), 3).alias("p"))
    assert sorted(r.p for r in x.collect()) == list(range(n))


def test_law_of_rows(spark, odd_documents, no_documents):
    docs = odd_documents.unionByName(odd_documents.filter("doc_id = 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("k"))
    out = sharding.op6_sharding(docs).collect()
    assert len(out) == docs.count()
    by = Counter(r.shard for r in out)
    assert max(by.values()) - min(by.values()) <= 1 and set(by) == set(range(8))
    for s in by:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(by[s]))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.op6_sharding(no_documents).count() == 0


def test_same_shuffle_whatever_the_partitions(spark, odd_documents):
    place = lambda df: sorted((repr(r.doc_id), repr(r.text), r.shard, r.slot) for r in sharding.shard(df, 3).collect())
    assert place(odd_documents) == place(odd_documents.repartition(7, "text"))
    assert sharding.shard(odd_documents, 3).columns == [*odd_documents.columns, "shard", "slot"]
    clash = odd_documents.withColumn("slot", F.lit("x"))
    assert sharding.shard(clash, 3).schema["slot"].dataType.simpleString() == "bigint"
    with pytest.raises(ValueError, match="at least 1"):
        sharding.shard(odd_documents, 0)


def test_no_python_on_the_main_path(spark, odd_documents):
    plan = sharding.op6_sharding(odd_documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
