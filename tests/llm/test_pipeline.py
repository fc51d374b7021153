"""The pipeline's stages against plain versions on the smallest table."""

import numpy as np
import pytest

import corpus_pipeline
from sensorloom.llm import mixing, quality, similar, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_dedup", "mix_sources", "best_fit_packing"]


def test_rejected_documents_go(spark, tables):
    docs, kept = tables[0], tables[1]
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.predictions(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good
    known = kept.join(labels, "doc_id")
    assert known.where("quality = 0").count() <= 0.05 * known.count()


def test_one_of_each_group_stays(tables):
    before = {r.doc_id: r.text for r in tables[1].collect()}
    after = {r.doc_id: r.text for r in tables[2].collect()}
    assert after.items() <= before.items() and tables[2].columns == tables[1].columns
    ids = sorted(before)
    words = {i: before[i].lower().split() for i in ids}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    group = {i: i for i in ids}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                a_, b_ = find(a), find(b)
                group[max(a_, b_)] = min(a_, b_)
    assert {find(i) for i in ids} == set(after)
    texts = list(after.values())
    assert len(set(texts)) == len(texts)


def test_counts_follow_the_rates(tables):
    before, after = tables[2], tables[3]
    assert after.columns == before.columns
    want = {(r.doc_id, r.n_copies) for r in mixing.mix(before).select("doc_id", "n_copies").distinct().collect()}
    got = {(r.doc_id, r["count"]) for r in after.groupBy("doc_id").count().collect()}
    assert got == want
    rates = {r.source: r.rate for r in mixing.rates(before).collect()}
    sizes = before.groupBy("source").count().toPandas().set_index("source")["count"]
    assert abs(after.count() - sum(rates[s] * n for s, n in sizes.items())) < 6 * np.sqrt(after.count())


def test_sequences_are_full(tables):
    packed = tables[4].toPandas()
    sums = packed.groupby("sequence_id").length.sum()
    assert sums.max() <= 4096 and len(sums) == -(-int(packed.length.sum()) // 4096)
    assert packed[packed.piece == 0].groupby("doc_id").size().sum() == tables[3].count()


def _words(n, start=0):
    return [f"w{start + i}" for i in range(n)]


def test_near_copies_far_apart_in_bits_are_joined(spark):
    """Pairs that share 0.8 or more of their shingles, with fingerprints more than six bits apart."""
    rows, want = [], []
    for k in range(40):
        words = _words(300, 1000 * k)
        copy = [f"x{k}_{i}" if i % 50 == 25 else w for i, w in enumerate(words)]  # 6 words changed: 30 of 296 shingles
        a, b = " ".join(words), " ".join(copy)
        if bin(simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).count("1") > 6:
            rows += [(2 * k, a), (2 * k + 1, b)]
            want.append(2 * k)
    assert want
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_unlike_documents_close_in_bits_stay(spark):
    """A line that prevails makes fingerprints equal, however much the rest of the texts differs."""
    line = " ".join(_words(9)) + " "
    rows = [(k, line * 60 + " ".join(_words(20, 1000 * (k + 1)))) for k in range(3)]
    prints = [simhash.fingerprint(t, 5) for _, t in rows]
    assert all(bin(a ^ b).count("1") <= 6 for a in prints for b in prints)
    for most in (4096, 2):  # also where the group doesn't fit in a task
        old, similar.CLASSES = similar.CLASSES, most
        try:
            kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([*rows, (9, rows[1][1].upper())], "doc_id long, text string"), SF)
            assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
        finally:
            similar.CLASSES = old
