from collections import Counter

import duckdb

import corpus_pipeline
from tallyloom.llm import kit, mixing, quality
from tests.llm.test_decontam import brute as brute_matches
from tests.llm.test_mixing import water
from tests.llm.test_ngram_join import brute


def test_stages_one_by_one(spark, data):
    """Each stage on its predecessor's rows, held against SQL or brute force."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, docs, data).cache()
    assert one.columns == columns
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    assert {r.doc_id for r in one.collect()} == {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality.OP3_SQL}) WHERE kept").fetchall()}
    two = stages[1](spark, one, data).cache()
    assert two.columns == columns
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert {r.doc_id for r in two.collect()} == {c for _, n, c in brute(rows, 5, 80) if n}
    three = stages[2](spark, two, data).cache()
    left, items = two.orderBy("doc_id").collect(), [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    bad = {left[d].doc_id for d, _ in brute_matches([r.text for r in left], items)}
    assert bad and {r.doc_id for r in three.collect()} == {r.doc_id for r in left} - bad
    four = stages[3](spark, three, data).cache()
    assert four.columns == columns
    size = lambda t: len(kit.word_bounds(kit.texts_of(kit.pa.array([t])))[0])
    kept, taken = three.collect(), Counter(r.doc_id for r in four.collect())
    held = {s: sum(size(r.text) for r in kept if r.source == s) for s in sorted({r.source for r in kept})}
    goal = water(held)
    longest = {s: max(size(r.text) for r in kept if r.source == s) for s in held}
    assert set(taken) <= {r.doc_id for r in kept} and max(taken.values()) <= 2
    for s in held:
        words = sum(size(r.text) * taken[r.doc_id] for r in kept if r.source == s)
        assert goal[s] - longest[s] <= words <= goal[s] + 1, s
    # Which documents: those that the counts by length take, in the order of their hashes.
    assert Counter({r.doc_id: r.copies for r in mixing.mix(mixing.packed(three, "own").select("own", "own.source", mixing.word_count("own.text").alias("words"))).select("own.doc_id", "copies").collect() if r.copies}) == taken
    five = stages[4](spark, four, data).collect()
    assert Counter(r.doc_id for r in five) == taken
    shards = Counter(r.shard for r in five)
    assert max(shards.values()) - min(shards.values()) <= 1 and set(shards) == set(range(8))
    assert all(sorted(r.slot for r in five if r.shard == k) == list(range(shards[k])) for k in shards)


def test_run_keeps_its_last_table_only(spark, data):
    before = list(kit._WRITTEN)
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and out.columns[-2:] == ["shard", "slot"]
    assert len(set(kit._WRITTEN) - set(before)) == 1
    again = corpus_pipeline.run(spark, data)
    place = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert place(out) == place(again)


def test_empty_and_odd_tables(spark, data, odd_documents, no_documents):
    for docs in (no_documents, odd_documents):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, data)
            assert docs.columns == odd_documents.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, data).count()
