import corpus_pipeline
from reuselens.llm import langid

from .test_decontaminate import words as leak_words
from .test_packing import check as check_packing
from .test_simhash import brute_components
from .test_substring import brute as brute_substring

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_every_stage_against_brute_force(spark):
    """Each stage over the whole table, on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "123 !!", "en", "s", 6), (10_003, "", None, None, None)],
                                  docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        before = by_id(docs)
        docs = stage(spark, docs, SF)
        if name == "sequences":
            check_rows = [(d, r.text) for d, r in before.items()]
            import reuselens.llm.packing as packing
            frame = spark.createDataFrame(check_rows, "doc_id long, text string")
            check_packing(check_rows, packing.pack(frame).collect(), 2048)
            assert {r.doc_id for r in docs.collect()} == before.keys()
            break
        assert docs.columns == columns
        after = by_id(docs)
        if name == "language":
            assert before.keys() - after.keys() == {10_001, 10_002, 10_003}
        elif name == "near_duplicates":
            groups = brute_components([(d, r.text) for d, r in before.items()])
            assert after.keys() == {d for d, _, c in groups if d == c} and len(after) < len(before)
        elif name == "repeated_passages":
            want = {d: text for d, _, _, _, text in brute_substring([(d, r.text) for d, r in sorted(before.items())], 50)}
            assert {d: " ".join(r.text.split()) for d, r in after.items()} == want
            assert all(r.n_chars == len(r.text) for r in after.values())
            assert any(len(r.text) < len(before[d].text) for d, r in after.items())
        elif name == "benchmark_leaks":
            items = [" ".join(leak_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = {d for d, r in before.items() if any(i in " ".join(leak_words(r.text)) for i in items)}
            assert bad and before.keys() - after.keys() == bad


def test_run_gives_whole_sequences(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    assert sorted(seqs) == list(range(len(seqs)))
    for q, rs in seqs.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or q == len(seqs) - 1


def test_an_empty_corpus_runs_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == [] and langid.train(spark.read.parquet(f"{SF}/documents.parquet").limit(0)) == {}
