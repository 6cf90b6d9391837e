import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from frameloom.llm import components, minhash, sharding, shared, substring
from frameloom.llm import textkit as K

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, k):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            same = len(sets[a] & sets[b])
            if den * same >= num * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_group(seed, n, base_words, edits):
    r = random.Random(seed)
    vocabulary = [f"w{r.randrange(10**6)}" for _ in range(400)]
    base = [r.choice(vocabulary) for _ in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("how", [minhash.Similarity(3, 85, 100), minhash.Similarity(5, 80, 100)])
def test_near_duplicates_against_brute_force(spark, docs_of, sample, how):
    texts = near_group(1, 60, 120, 5) + near_group(2, 25, 40, 3) + near_group(3, 3, 600, 9) + ["lone text of its own"]
    rows = list(enumerate(texts, 10_000)) + [(r.doc_id, r.text) for r in sample.collect()]
    random.Random(0).shuffle(rows)
    want = brute_components(rows, how.k, how.num, how.den)
    got = minhash.near_duplicates(docs_of(rows), how).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edge_cases(edge, docs_of):
    got = minhash.near_duplicates(edge, minhash.Similarity(3, 85, 100)).collect()
    assert len(got) == edge.count()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for i in (1, 2, 3) for r in by[i])
    assert [r.n_shingles for r in (by[4][0], by[5][0], by[8][0])] == [1, 1, 1]
    assert {r.component_id for i in (6, 7) for r in by[i]} == {6} and not by[7][0].kept
    assert minhash.near_duplicates(docs_of([])).count() == 0


def test_sketch_fills_every_coordinate_and_estimates():
    r = np.random.default_rng(0)
    common, a, b = (np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (800, 100, 100))
    x, y = np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))
    s = minhash.sketch(np.concatenate([x, y, x[:1]]), np.array([len(x), len(y), 1]), 1024)
    assert not (s == ~np.uint64(0)).any()
    assert (s[0] == s[1]).mean() == pytest.approx(0.8, abs=0.06)


def test_candidates_are_those_of_brute_force_by_sketch():
    how = minhash.Similarity(3, 85, 100)
    r = np.random.default_rng(1)
    group = []
    base = r.integers(0, 256, how.size, dtype=np.uint8)
    for i in range(40):
        sk = base.copy()
        sk[: 2 * i] = r.integers(0, 256, 2 * i)
        group.append((0, i, i % 20, 100 + i, sk.tobytes() + bytes(4 * how.bands)))
    main = 3  # the component that is not outside
    rows = [(g[0], 0, *g[1:]) for g in group if g[2] != main] + [(g[0], 1 if g[2] == main else 2, *g[1:]) for g in group]
    p, q, same = minhash._candidates(rows, how)
    want = {(i, j) for i, j in itertools.combinations(range(40), 2) if i % 20 != j % 20 and 100 * (100 + i) >= 85 * (100 + j) and sum(a == b for a, b in zip(group[i][4][: how.size], group[j][4])) >= how.least_agreement}
    got = [tuple(sorted((rows[a][2], rows[b][2]))) for a, b in zip(p.tolist(), q.tolist())]
    assert set(got) == want and len(got) == len(want) and (np.diff(same) <= 0).all()


def test_blocks_hold_every_pair_of_different_components_once(spark):
    r = random.Random(2)
    now = [(k, 0, 1000 * k + i, 1000 * k if r.random() < share else 1000 * k + i, 5, b"") for k, n, share in ((1, 90, 0.9), (2, 40, 0.0), (3, 30, 1.0), (4, 25, 0.5)) for i in range(n)]
    table = spark.createDataFrame(now, "key long, band int, node long, component long, n long, sk binary")
    dealt = minhash._blocks(table.drop("sk"), table.select("node", "sk"), 16).collect()
    parts = defaultdict(list)
    for x in dealt:
        parts[x.part].append(x)
    got = [tuple(sorted((a.node, b.node))) for rows in parts.values() for a in rows if a.side == 0 for b in rows if a.component != b.component and (b.side == 1 or b.side == 2 and b.node > a.node)]
    want = {tuple(sorted((a[2], b[2]))) for a, b in itertools.combinations(now, 2) if a[0] == b[0] and a[3] != b[3]}
    assert set(got) == want and len(got) == len(want) and max(map(len, parts.values())) < 100
    assert sum(x.part.startswith("1:") for x in dealt) < 2 * 90  # one component holds nearly all


def test_pairs_of_large_hubs_are_verified_once_each(spark):
    how = minhash.Similarity(3, 85, 100)
    r = np.random.default_rng(0)
    base = np.sort(r.integers(0, 1 << 62, 200, dtype=np.uint64))
    sets = {0: base, 1000: base[:190]}
    for i in range(1, 300):
        sets[i] = np.unique(np.concatenate([base[: 200 - i % 60], r.integers(0, 1 << 62, i % 7, dtype=np.uint64)]))
    pairs = [(0, i) for i in range(1, 300)] + [(1000, i) for i in range(1, 20)] + [(5, 6)]
    table = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in sets.items()], "node long, elements binary")
    got = [(x.u, x.v) for x in minhash._verified(spark.createDataFrame(pairs, "a long, b long"), table, how, 8).collect()]
    same = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    want = {(a, b) for a, b in pairs if 100 * same(a, b) >= 85 * (len(sets[a]) + len(sets[b]) - same(a, b))}
    assert set(got) == want and len(got) == len(want) and 0 < len(want) < len(pairs)


def test_every_link_of_a_whole_table_is_found(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    how = minhash.Similarity(3, 85, 100)
    got = minhash.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), how).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_components(rows, 3, 85, 100)


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 300: 300, 301: 300}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_word_kernels_against_regex():
    texts = ["A b  c\tD", "", None, "é x\x0bY", "tail ", " \n"]
    import pyarrow as pa

    buf, off = K.utf8(pa.array(texts))
    starts, ends, counts = K.word_bounds(buf, off)
    raw = bytes(buf)
    want = [w.encode() for t in texts for w in WORDS.findall(t or "")]
    assert [raw[a:b] for a, b in zip(starts, ends)] == want and counts.tolist() == [len(WORDS.findall(t or "")) for t in texts]
    h = K.word_hashes(buf, off)[0]
    assert len(set(h.tolist())) == len({w.decode().translate(LOWER) for w in want})


def test_passages_of_fifty_words_are_found_and_clean_text_is_not(spark, docs_of):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9)))
    passage = " ".join(word() for _ in range(55))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{text(r.randrange(5, 200))} {passage} {text(r.randrange(5, 200))}" if i % 3 == 0 else text(300)) for i in range(90)]
    docs = docs_of(rows)
    got = substring.repeated_passages(docs).collect()
    assert {g.doc_id for g in got} == {i for i, _ in rows if i % 3 == 0}
    for g in got:
        t = dict(rows)[g.doc_id]
        a = t.index(passage)
        assert a - 1 <= g.start < g.end <= a + len(passage) + 1 and g.first_doc_id == 0
    cut = {x.doc_id: x.text for x in substring.without_repeats(docs).collect()}
    assert cut[0] == rows[0][1] and all(len(cut[i]) < len(t) - 100 for i, t in rows if i % 3 == 0 and i)
    assert all(cut[i] == t for i, t in rows if i % 3)


def test_copies_that_share_a_passage_with_an_earlier_document_keep_the_rest_once(spark, docs_of):
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9))) for _ in range(n))
    x, y, z = text(80), text(60), text(80)
    copy = f"{x} {y} {z}"
    docs = docs_of([(1, y), (2, copy), (3, copy), (4, text(100))])
    got = substring.repeated_passages(docs).collect()
    assert {(g.doc_id, g.first_doc_id) for g in got} == {(1, 1), (2, 1), (2, 2), (3, 1)}
    for g in got:
        if g.doc_id == 2 and g.first_doc_id == 1:
            assert len(x) <= g.start < g.end <= len(x) + len(y) + 2
    cut = {c.doc_id: c.text for c in substring.without_repeats(docs).collect()}
    assert cut[1] == y and x in cut[2] and z in cut[2] and len(cut[2]) < len(copy) - 200 and len(cut[3]) < 100


def test_chunks_resist_insertions():
    r = np.random.default_rng(0)
    a = r.integers(97, 123, 4000).astype(np.uint8)
    b = np.concatenate([a[:1000], np.frombuffer(b"inserted", np.uint8), a[1000:]])
    one = lambda x: set(np.split(x, k)[i].tobytes() for k in [substring.boundaries_by_document(x, np.array([0, len(x)]), 11, 512)] for i in range(len(k)))
    x, y = one(a), one(b)
    assert len(x & y) >= len(x) - 4
    ends = substring.boundaries_by_document(np.full(5000, 97, np.uint8), np.array([0, 5000]), 11, 512)
    assert np.diff(np.concatenate([[0], ends])).max() <= 512 and ends[-1] == 5000


def test_substring_edge_cases(edge, docs_of):
    got = substring.repeated_passages(edge).collect()
    assert {g.doc_id for g in got} <= {6, 7, 8, 10}
    assert substring.repeated_passages(docs_of([])).count() == 0
    assert substring.without_repeats(edge).count() == edge.count()


def brute_shards(rows, limit):
    """Split one bucket after another."""
    import hashlib

    h = [(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16), b) for k, b in rows]
    out = {}

    def split(bits, group):
        if sum(b for _, b in group) <= limit or len(bits) == 60 or len({x for x, _ in group}) == 1:
            for x, _ in group:
                out[x] = bits
            return
        for one in "01":
            part = [g for g in group if format(g[0], "060b")[len(bits)] == one]
            if part:
                split(bits + one, part)

    split("", h)
    return {k: out[x] for (k, _), (x, _) in zip(rows, h)}


@pytest.mark.parametrize("limit", [2_000, 20_000, 10**9])
def test_shards_against_splitting_one_bucket_after_another(sample, limit):
    rows = [(r.doc_id, len((r.text or "").encode()) + 64) for r in sample.collect()]
    got = sharding.shards(sample, limit).collect()
    want = brute_shards(rows, limit)
    assert len(got) == len(rows)
    total = defaultdict(int)
    for g in got:
        total[g.shard] += g.n_bytes
    for g in got:
        assert g.shard_bytes == total[g.shard] and g.depth == len(g.shard) and g.oversized == (g.shard_bytes > limit)
        if not g.oversized:
            assert g.shard == want[g.doc_id]
    assert all(sum(g.shard == s for g in got) == 1 for s, b in total.items() if b > limit)


def test_shards_of_one_hot_key(docs_of):
    docs = docs_of([(7, "same text of a hot key " * 4)] * 300 + [(i, "other") for i in range(100, 200)])
    got = sharding.shards(docs, 3000).collect()
    total = defaultdict(int)
    for g in got:
        total[g.shard] += g.n_bytes
    assert len(got) == 400 and max(total.values()) <= 3000 and not any(g.oversized for g in got)


def test_a_hot_key_beside_others_deepens_its_own_bucket_only(spark, monkeypatch):
    directories = []
    keep = sharding.stored
    monkeypatch.setattr(sharding, "stored", lambda df, name: directories.append((name, keep(df, name))) or directories[-1][1])
    docs = spark.range(60_000).selectExpr("if(id % 3 = 0, 7, id) doc_id", "'a text of one line' text")
    limit = 200_000
    rows = [(r.doc_id, len("a text of one line") + 64) for r in docs.collect()]
    got = sharding.shards(docs, limit).collect()
    total = defaultdict(int)
    for g in got:
        total[g.shard] += g.n_bytes
    assert len(got) == 60_000 and max(total.values()) <= limit and all(g.shard_bytes == total[g.shard] for g in got)
    want = brute_shards(rows, limit)
    assert all(g.shard == want[g.doc_id] for g in got if g.doc_id != 7)
    hot = {g.shard for g in got if g.doc_id == 7}
    assert len(hot) > 8 and all(s.startswith(want[7]) for s in hot) and not hot & {g.shard for g in got if g.doc_id != 7}
    assert sum(t.count() for n, t in directories if n == "directory") < 2000


def test_shards_edge_cases(edge, docs_of):
    got = sharding.shards(edge, 10_000).collect()
    assert len(got) == edge.count() and any(g.oversized for g in got) and {g.n_bytes for g in got if g.doc_id == 1} == {64}
    assert sharding.shards(docs_of([])).count() == 0


def test_bitmap_filter_never_loses_an_id(spark):
    df = spark.range(0, 20_000).withColumnRenamed("id", "doc_id")
    ids = spark.range(0, 20_000, 37).withColumnRenamed("id", "node")
    for bits in (24, 16):
        got = shared.maybe_among(df, "doc_id", ids, "node", "maybe", bits).where("maybe")
        hits = {r.doc_id for r in got.collect()}
        assert set(range(0, 20_000, 37)) <= hits and len(hits) < (560 if bits == 24 else 1200)
    assert shared.maybe_among(df, "doc_id", ids.limit(0), "node", "maybe").where("maybe").count() == 0


def test_kept_rows_are_those_of_the_classes(docs_of):
    rows = list(enumerate(near_group(4, 30, 60, 3) + ["alone in its class here"], 1)) + [(None, "no id"), (None, None)]
    docs = docs_of(rows)
    how = minhash.Similarity(5, 80, 100)
    kept = {r.doc_id for r in minhash.near_duplicates(docs, how).collect() if r.kept}
    out = minhash.without_near_duplicates(docs, how)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept and out.where("doc_id is null").count() == 2
