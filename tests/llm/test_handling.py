"""Columns of clashing names, very long texts, repeated rows and empty tables, for every operator and stage."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from frameloom.llm import cotrain, decontaminate, langid, minhash, packing, prefixcounts, secretscan, sharding, substring
from frameloom.llm import pretokens as P
from test_text import brute_base

SF = "/root/testdata/sf0.001"
CLASHING = (
    "shard", "depth", "start", "end", "kept", "spans", "length", "n_tokens", "distance", "item_id", "score", "component_id", "piece", "sequence_id", "offset", "lang_pred", "held_out", "n_bytes",
    "first_doc_id", "version", "node", "key", "h1", "__h", "__id", "__text", "__at", "__bits", "__bytes", "__frameloom_place", "__frameloom_maybe", "__source", "member", "d1", "block", "bin", "fill",
)


def operators(spark):
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    return {
        "shards": lambda d: sharding.shards(d, 100_000),
        "passages": substring.repeated_passages,
        "without_repeats": lambda d: substring.without_repeats(d).select("doc_id", "text"),
        "near": minhash.near_duplicates,
        "without_near": lambda d: minhash.without_near_duplicates(d).select("doc_id", "text"),
        "scan": secretscan.scan,
        "redact": lambda d: secretscan.redact(d, "text", "n_chars").select("doc_id", "text", "n_chars"),
        "packing": lambda d: packing.best_fit_packing(d).select("doc_id", "piece", "length", "ids_crc32"),
        "counts": prefixcounts.prefix_token_counts,
        "contaminated": lambda d: decontaminate.contaminated(d, items),
        "clean": lambda d: decontaminate.decontaminated(d, items).select("doc_id", "text"),
        "quality": lambda d: cotrain.quality(d, labels),
        "good": lambda d: cotrain.good_documents(d, labels).select("doc_id", "text"),
        "language": langid.language_id,
    }


NAMES = ("shards", "passages", "without_repeats", "near", "without_near", "scan", "redact", "packing", "counts", "contaminated", "clean", "quality", "good", "language")


@pytest.fixture(scope="module")
def some(spark, sample, tmp_path_factory):
    """A third of the sample and copies of some rows, as a table."""
    path = f"file://{tmp_path_factory.mktemp('some')}/docs"
    part = sample.where("doc_id % 3 = 0")
    part.unionByName(part.where("doc_id % 6 = 0")).unionByName(part.where("doc_id % 9 = 0").withColumn("doc_id", F.col("doc_id") + 100_000)).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", NAMES)
def test_columns_of_any_name_change_nothing(spark, some, name):
    f = operators(spark)[name]
    clashing = some.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)])
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(f(clashing)) == rows(f(some))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_empty_results(spark, some, name):
    assert operators(spark)[name](some.limit(0)).count() == 0


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randrange(2, 10))) for _ in range(5000)]
    out, n = [], 0
    while n < 10_000_000:
        out.append(" ".join(r.choice(words) for _ in range(12)) + ".\n")
        n += len(out[-1])
    return "".join(out)


def test_texts_of_ten_megabytes(spark, docs_of, long_text):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()
    half = len(long_text) // 2
    secret = 'token = "0123456789abcdef01234567"'
    other = f"{long_text[:half]} {item.text} {secret} {long_text[half:]}"
    docs = docs_of([(1, long_text), (2, other), (3, "a short one")])
    size = {1: len(long_text.encode()), 2: len(other.encode())}
    assert {g.doc_id: g.n_bytes - 64 for g in sharding.shards(docs, 1 << 20).collect() if g.doc_id < 3} == size
    assert {(g.doc_id, g.component_id) for g in minhash.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    found = substring.repeated_passages(docs).where("first_doc_id = 1").groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start"))).collect()
    assert {r[0]: r[1] > 0.999 * len(long_text) for r in found} == {1: True, 2: True}
    spans = {g.doc_id: g.spans for g in secretscan.scan(docs).collect()}
    assert spans[1] == "" and spans[2] == ",".join(f"{k}:{a}:{b}" for a, b, k in brute_base(other))
    assert [(g.doc_id, g.item_id, g.distance) for g in decontaminate.contaminated(docs, spark.createDataFrame([(item.item_id, item.text)], "item_id long, text string")).collect()] == [(2, item.item_id, 0)]
    tok = P.tokenizer(P.vocabulary("byte_bpe_50k.json"))
    ids = np.array(tok.encode(long_text, add_special_tokens=False).ids + [0], "<u4")
    pieces = packing.best_fit_packing(docs).where("doc_id = 1").orderBy("piece").collect()
    assert sum(p.length for p in pieces) == len(ids) and len(pieces) == -(-len(ids) // 2048)
    assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
    library = P.tokenizer(P.vocabulary("word_bpe_49k.json"))
    counts = {g.doc_id: g for g in prefixcounts.prefix_token_counts(docs).collect()}
    assert counts[1].n_tokens == len(library.encode(long_text, add_special_tokens=False).ids) and counts[1].over_limit
    assert len(library.encode(long_text[: counts[1].fit_chars], add_special_tokens=False).ids) <= 2048
    assert langid.language_id(docs).count() == 3 and cotrain.quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).count() == 3


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_repeats_and_nulls(spark, edge, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, edge.limit(0), SF).count() == 0
    out = stage(spark, edge, SF).collect()
    twice = [r for r in out if r.doc_id == 6]
    assert len(twice) in (0, 2) and (name == "packing" or all(set(r.asDict()) == set(edge.columns) for r in out))
    if name in ("near_dedup", "decontaminate", "secrets"):
        assert {r.doc_id for r in out} >= {None, 1, 2, 3, 4, 5, 6, 8, 9, 10}


def test_quality_stage_against_the_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, d).select("doc_id").withColumn("stays", F.lit(True))
    got = labels.join(kept, "doc_id", "left").join(docs.select("doc_id"), "doc_id").toPandas()
    want = (got.quality == 1) & (got.toxic == 0)
    assert (got.stays.notna() == want).mean() > 0.98 and got.stays.notna()[want].mean() > 0.99


def test_secrets_stage_against_plain_patterns(spark):
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {g.doc_id: g.n_structural for g in secretscan.scan(sample).collect()}
    masked = {r.doc_id: r.text for r in corpus_pipeline.secrets_stage(spark, sample, SF).collect()}
    n = 0
    for r in sample.collect():
        if found[r.doc_id] or not r.text:
            continue
        out, at = "", 0
        for a, b, kind in brute_base(r.text):
            if a >= at:
                out, at = out + r.text[at:a] + f"[{kind}]", b
            else:
                at = max(at, b)
        n += at > 0
        assert masked[r.doc_id] == out + r.text[at:]
    assert n > 3
