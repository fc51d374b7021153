"""Near copies in large groups against brute force over all pairs."""

from itertools import takewhile

import numpy as np
import pytest

from sensorloom.llm import common, similar, simhash


def closure(n, near):
    """The least member of each row's component; near(x) gives the rows linked with x."""
    label = np.arange(n)
    for x in range(n):
        for old in np.unique(label[near(x)]):
            new = label[x]
            label[label == max(old, new)] = min(old, new)
    return label


def grouped(spark, fps, links):
    heads = spark.createDataFrame([(k, int(f), 1) for k, f in enumerate(fps.view(np.int64).tolist())], "head long, fp long, n long")
    return {r.fp: r.component_id for r in simhash.named(heads, links, "fp").collect()}


@pytest.mark.parametrize("longest", [4096, 40])
def test_links_of_ten_thousand_near_copies(spark, monkeypatch, longest):
    """Fingerprints around one centre and around chains of others, in short and in long files."""
    monkeypatch.setattr(simhash, "LONGEST", longest)
    rng = np.random.default_rng(3)
    flips = lambda n, many: (rng.random((n, 64)).argsort(axis=1) < many).astype(np.uint8)
    number = lambda bits: np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    n = 10_000 if longest > 1000 else 600
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = np.unique(np.concatenate([centre ^ number(flips(n // 2, k)) for k in (3, 5)] + [rng.integers(0, 1 << 63, size=n // 10, dtype=np.uint64)]))
    pairs = simhash.links(spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long"))
    got = grouped(spark, fps, pairs)
    want = closure(len(fps), lambda x: np.flatnonzero(np.bitwise_count(fps ^ fps[x]) <= 4))
    assert [got[x] for x in fps.view(np.int64).tolist()] == want.tolist()


def test_middles_find_just_the_pairs_within_reach(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LONGEST", 1)
    base = 0x0123456789ABCDEF
    for bits, linked in ((1, True), (2, True), (3, True), (4, True), (5, False)):
        other = base ^ sum(1 << 13 * k for k in range(bits))
        got = simhash.links(spark.createDataFrame([(base,), (other,), (base ^ 0b110,), (base ^ 0b101,)], "fp long")).distinct().collect()
        assert {other} <= {x for r in got for x in r} if linked else all(other not in r for r in got)


def near_texts(rng, groups, most):
    texts = []
    for g in range(groups):
        base = [f"w{g}_{k}" for k in range(120)]
        for c in range(int(rng.integers(2, most))):
            words = list(base)
            for k in rng.choice(120, size=int(rng.integers(0, 8)), replace=False):
                words[k] = f"x{g}_{c}_{k}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("most", [(4096, 1_000_000), (4, 500)])
def test_similar_groups_of_any_size(spark, monkeypatch, most):
    """The same groups, whether they fit in a task, are settled by their files' heads, or need many heads."""
    monkeypatch.setattr(similar, "CLASSES", most[0])
    monkeypatch.setattr(similar, "SHINGLES", most[1])
    monkeypatch.setattr(similar, "PAIRS", 3)
    rng = np.random.default_rng(8)
    texts = near_texts(rng, 3, 12)
    texts += [texts[0], texts[0].upper(), "", None, "two words", "two words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, words=5, differing=6, similar=0.8).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    want = closure(len(texts), lambda x: np.array([y for y in range(len(texts)) if alike(sets[x], sets[y])]))
    assert [got[k] for k in range(len(texts))] == want.tolist()


def test_frequent_keys_join_like_others(spark):
    rows = spark.createDataFrame([(k % 3 if k < 900 else k, k) for k in range(1000)], "key long, x long")
    one = rows.groupBy("key").count().withColumnRenamed("count", "n")
    old, common.HOT = common.HOT, 5
    try:
        assert common.join_counted(rows, one.withColumnRenamed("n", "n"), "key", "n").count() == 1000
    finally:
        common.HOT = old


def broadcast_after_explode(df):
    """Whether the plan sends exploded rows, which Spark takes for as few as they were before, to all tasks."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    below = [[lines[j] for j in takewhile(lambda j: depth[j] > depth[k], range(k + 1, len(lines)))] for k in range(len(lines))]
    return any("BroadcastExchange" in x and any("Generate" in y for y in rest) for x, rest in zip(lines, below))


@pytest.fixture
def plans(spark, monkeypatch):
    """What common.cut() writes, and whether its plan broadcasts exploded rows."""
    seen, write = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df, name, **options: seen.append((name, broadcast_after_explode(df))) or write(df, name, **options))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield seen
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_blocks_of_fingerprints_stay_off_the_driver(spark, tmp_path, plans):
    base = np.random.default_rng(8).integers(-(2**62), 2**62, size=2000)
    spark.createDataFrame([(x,) for x in [*base.tolist(), *(base[:500] ^ 1).tolist()]], "fp long").write.parquet(f"{tmp_path}/fps")
    found = simhash.links(spark.read.parquet(f"{tmp_path}/fps"))
    assert not broadcast_after_explode(found) and not any(bad for _, bad in plans)
    assert found.distinct().count() == 500


def test_bands_of_documents_stay_off_the_driver(spark, tmp_path, plans):
    texts = [" ".join(f"w{(k * 7 + j * j) % 5000}" for j in range(40)) for k in range(200)]
    rows = [(k, t) for k, t in enumerate(texts + [t + " more" for t in texts[:50]])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    kept = simhash.keep_one(spark.read.parquet(f"{tmp_path}/docs"), words=5, differing=6, similar=0.8)
    assert {r.doc_id for r in kept.collect()} == set(range(200))
    assert "files" in dict(plans) and not any(bad for _, bad in plans)
