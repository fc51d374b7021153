"""Against brute force, exact round trips and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorloom.llm import components, hnsw, html, jpeg, licenses, media, packing, quality, simhash, tokencount, wordbpe

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_cached_encoding_is_the_library_s(texts):
    enc = wordbpe.encoder(wordbpe.default_path())
    own = [*list(texts.values())[:300], "It's don't I'LL 'Re a²b x_y__z 12ab ΑΣ Σ İ ﬁ é x\x1cy\x85z\xa0w", "<|endoftext|> hi"]
    for text, raw in zip(own, enc.encode_many(own)):
        assert np.frombuffer(raw, enc.dtype).tolist() == enc.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_alike(text):
    enc = wordbpe.encoder(wordbpe.default_path())
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == (enc.whole.encode(text, add_special_tokens=False).ids if text else [])


def plain_fingerprint(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    own = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not own:
        return 0
    shingles = [" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(texts):
    for text in [*list(texts.values())[:60], "", "one", "A b c\x85 d E"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_find_every_component(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:60]:
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    array = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(array[:, None] ^ array[None, :]) <= 4
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            break
        label = new
    rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "row long, fp long")
    for tile in (4096, 16):  # also with long files
        old, simhash.LONGEST = simhash.LONGEST, tile
        try:
            got = {r.row: r.component_id for r in simhash.classes(rows).collect()}
        finally:
            simhash.LONGEST = old
        assert [got[i] for i in range(len(fps))] == label.tolist()


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (3, 3), (7, 8), (8, 9), (9, 10), (10, 11), (None, 1), (2, 1)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **dict.fromkeys(range(7, 12), 7)}


def test_packing_plan():
    rng = np.random.default_rng(0)
    for n in (1, 7, 500, 20_000):
        lengths = np.clip(np.exp(rng.normal(5.5, 1.3, n)).astype(int), 1, 4096)
        counts = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
        made = packing.plan(counts, 4096)
        used: dict[int, int] = {}
        for members, times in made:
            assert sum(members) <= 4096
            for m in members:
                used[m] = used.get(m, 0) + times
        assert used == counts
        if n >= 500:
            assert sum(t for _, t in made) == -(-int(lengths.sum()) // 4096)
    assert packing.plan({3: 1, 5: 1, 8: 1, 10: 2}, 10) == [([10], 2), ([8], 1), ([5, 3], 1)]


def test_trie_counts_against_plain_search(texts):
    scores = tokencount.piece_scores(tokencount.default_path())
    worst = min(scores.values()) - 10

    def plain(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            n = len(word[i - 1].encode())
            options = [(best[i - 1][0] + worst * n, -best[i - 1][1] - n)]
            options += [(best[k][0] + scores[word[k:i]], -best[k][1] - 1) for k in range(i) if word[k:i] in scores]
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1]

    model = tokencount.Trie(scores)
    for text in [*list(texts.values())[:6], "ok ☃☃ naïve x" * 3]:
        n, tokens, total = tokencount.count(text, model)
        own = [plain("▁" + w) for w in text.split()]
        assert (n, tokens) == (len(own), sum(c for _, c in own)) and total == pytest.approx(sum(s for s, _ in own))


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.predictions(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(got.doc_id, got.held_out))


def test_flat_trees_match_plain_walks():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    trees = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), trees=8)
    for row in x[:50]:
        total = trees.base
        for t in range(len(trees.feature)):
            node = 0
            while trees.feature[t, node] >= 0:
                node = trees.child[t, node] + int(row[trees.feature[t, node]] > trees.threshold[t, node])
            total += trees.value[t, node]
        assert trees.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_recall_of_neighbours(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = rows.toPandas()
    matrix = np.stack(data.embedding.to_numpy()).astype(np.float64)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    old, hnsw.SHARD = hnsw.SHARD, 700
    try:
        got = hnsw.nearest(rows, rows.where("vec_id % 50 = 0")).toPandas()
    finally:
        hnsw.SHARD = old
    place = {v: i for i, v in enumerate(data.vec_id)}
    hits = 0
    for q, found in got.groupby("query_id"):
        score = unit @ unit[place[q]]
        score[place[q]] = -2
        hits += len(set(data.vec_id.to_numpy()[np.argsort(-score)[:5]]) & set(found.vec_id))
        assert found.sort_values("rank").score.is_monotonic_decreasing and np.allclose(found.score, [score[place[v]] for v in found.vec_id])
    assert hits >= 0.95 * len(got)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=900), min_size=1, max_size=5), st.integers(0, 255))
def test_media_round_trip(payloads, fill):
    data = [p + bytes([fill]) * (192 - len(p) % 192) for p in payloads]
    assert [media.to_payload(x) for x in jpeg.read(media.encode(data))] == data


def test_jpeg_samples_and_sparse_blocks():
    rng = np.random.default_rng(3)
    c = np.arange(8)
    basis = np.cos((2 * c[None] + 1) * c[:, None] * np.pi / 16) * np.where(c == 0, np.sqrt(0.125), 0.5)[:, None]
    blocks = rng.integers(-60, 60, size=(5, 64))
    square = np.zeros((5, 64))
    square[:, jpeg.ZIGZAG] = blocks
    want = np.clip(np.floor(np.einsum("nvu,vy,ux->nyx", square.reshape(5, 8, 8), basis, basis) + 128.5), 0, 255)
    assert np.abs(jpeg.inverse(blocks, np.ones(64)).astype(int) - want).max() <= 1

    def image(rows, cols, density):
        def part(n):
            return (rng.integers(-3, 4, size=(n, 64)) * (rng.random((n, 64)) < density)).astype(np.int16)

        return jpeg.Image(cols * 16, rows * 16, ((2, 2), (1, 1), (1, 1)), [part(4 * rows * cols).reshape(rows * 2, cols * 2, 64), part(rows * cols).reshape(rows, cols, 64), part(rows * cols).reshape(rows, cols, 64)])

    for density in (0.0, 0.05, 0.3, 1.0):
        images = [image(2, 3, density), image(1, 1, density)]
        for interval in (1, 4, 50):
            back = jpeg.read(jpeg.write(images, interval))
            assert all((a == b).all() for x, y in zip(images, back) for a, b in zip(x.coefficients, y.coefficients))
            assert jpeg.rgb(back)[0].shape == (32, 48, 3)


def test_license_inheritance(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "print(1)"), (3, "a/b/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."),
        (4, "a/y.py", "# Licensed under CC BY-NC 4.0.\ncode"), (5, "z/w.py", "nothing"), (6, "top.py", ""), (7, "a/d/e/f/g.py", None),
    ]
    got = {r.row: (r.license, r.via, r.from_path) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {
        1: ("MIT", "file", "a/LICENSE"), 2: ("GPL-3.0", "inherited", "a/b/LICENSE.txt"), 3: ("GPL-3.0", "file", "a/b/LICENSE.txt"),
        4: ("CC-BY-NC-4.0", "header", "a/y.py"), 5: (None, None, None), 6: (None, None, None), 7: ("MIT", "inherited", "a/LICENSE"),
    }


def test_license_lines_of_the_corpus(texts):
    matcher = licenses.Matcher(licenses.TEMPLATES, {}, 10_000, 0.7)
    for text in texts.values():
        planted = any(x in text for x in ("Licensed under", "Released under the MIT", "licensed under the GNU"))
        assert (matcher.best(text)[0] is not None) == planted


def test_extraction_gives_the_articles(spark):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>|<br>", body)]
        assert got[r.page_id] == "\n".join(x for x in blocks if x)
