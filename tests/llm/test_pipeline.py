import corpus_pipeline
from frameloom.llm import cotrain, decontaminate, minhash, secretscan
from frameloom.llm import pretokens as P

from test_dedup import brute_components
from test_text import check_packing

SF = "/root/testdata/sf0.001"


def test_every_stage_against_a_brute_force_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontaminate", "secrets", "packing"]

    good = stages["quality"](spark, docs, SF)
    scores = cotrain.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in scores if r.kept}

    near = stages["near_dedup"](spark, docs, SF)
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = {i for i, (_, c) in brute_components(list(rows.items()), 5, 80, 100).items() if i == c}
    assert near.columns == columns and {r.doc_id for r in near.collect()} == want

    clean = stages["decontaminate"](spark, docs, SF)
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and not any(item in decontaminate.normal(rows[i]) for i in kept for item in items)
    assert len(kept) > 0.9 * len(rows)

    masked = {r.doc_id: r for r in stages["secrets"](spark, docs, SF).collect()}
    assert set(masked) == set(rows)
    for i, t in rows.items():
        assert masked[i].text == secretscan.redacted(t, secretscan.spans(t)[1]) and masked[i].n_chars == len(masked[i].text)

    path = P.vocabulary("byte_bpe_50k.json")
    check_packing(stages["packing"](spark, docs, SF).collect(), docs, 2048, path)


def test_run_chains_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    kept = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        kept = f(spark, kept, SF)
    assert out == {r.doc_id for r in kept.collect()} and 0 < len(out) < docs.count()
    assert minhash.Similarity().k == 5
