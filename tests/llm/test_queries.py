"""The columns of the registered queries against plain versions of what they describe, on the smallest tables."""

import hashlib
import zlib
from math import log

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sensorloom.llm import hnsw, licenses, media, packing, tokenfiles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return {k: tokenizer.encode(t, add_special_tokens=False).ids for k, t in texts.items()}


def crc(numbers):
    return zlib.crc32(np.array(numbers, dtype="<u4").tobytes())


def test_token_files(spark, ids):
    want, start = {}, 0
    for k in sorted(ids):
        own = [*ids[k], 2]
        want[k] = (start, len(own), crc(own))
        start += len(own)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.op4_token_files(spark, SF).collect()} == want


def test_packing(spark, ids):
    got = packing.op9_best_fit_packing(spark, SF).collect()
    want = {}
    for k, own in ids.items():
        own = [*own, 1]
        for piece, at in enumerate(range(0, len(own), 4096)):
            some = own[at : at + 4096]
            want[k, piece] = (at, len(some), crc(some))
    assert len(got) == len(want) and {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(n for _, n in held) <= 4096
    assert len(places) == -(-sum(n for _, n, _ in want.values()) // 4096)


def test_media_columns(spark, texts):
    got = {r.doc_id: r for r in media.op8_media_columns(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        raw = t.encode()
        full = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        stored = media.encode([full])[0]
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and stored[:2] == b"\xff\xd8"
    same = {}
    for k, t in texts.items():
        same.setdefault(t, set()).add(got[k].feature)
    assert all(len(x) == 1 for x in same.values())


def test_license_scan(spark, texts):
    """Cosines over all words of all segments, without any bound or index."""
    lines = [line for t in texts.values() for line in licenses.words(t) if line]
    seen = {}
    for line in lines:
        for w in set(line):
            seen[w] = seen.get(w, 0) + 1
    templates = [(name, [w for line in licenses.words(t) for w in line]) for name, ts in licenses.TEMPLATES.items() for t in ts]
    known = {w for _, own in templates for w in own}

    def vector(own):
        return {w: own.count(w) * (log((1 + len(lines)) / (1 + (seen.get(w, 0) if w in known else 0))) + 1) for w in set(own)}

    sides = [(name, vector(own)) for name, own in templates]
    length = lambda v: sum(x * x for x in v.values()) ** 0.5
    got = {r.doc_id: r for r in licenses.op1_license_scan(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        best = (0.0, None)
        for _, own in licenses.segments(t):
            if known.intersection(own):
                v = vector(own)
                for name, side in sides:
                    score = sum(x * side.get(w, 0.0) for w, x in v.items()) / length(v) / length(side)
                    if score > best[0] + 1e-9:
                        best = (score, name)
        own_notice = got[k].via in ("header", "file")
        assert own_notice == (best[0] >= 0.7)
        if own_notice:
            assert got[k].license == best[1] and got[k].score == pytest.approx(min(best[0], 1.0))


def test_recall_over_four_shards_at_the_default_settings():
    """Every query meets all shards; each looks at a small part of its shard."""
    rng = np.random.default_rng(4)
    vectors = np.repeat(rng.normal(size=(400, 48)), 50, axis=0) + 0.7 * rng.normal(size=(20_000, 48))
    unit = hnsw.units(vectors)
    queries = np.arange(0, 20_000, 50)
    found, visited = [], []
    for shard in range(4):
        rows = np.arange(shard, 20_000, 4)
        graph, order = hnsw.build(vectors[rows])
        graph.visited = 0
        found.append(rows[order][hnsw.search(graph, unit[queries], 12)])
        visited.append(graph.visited / len(queries) / len(rows))
    near = np.concatenate(found, axis=1)
    score = np.einsum("qd,qmd->qm", unit[queries], unit[near])
    near = np.take_along_axis(near, np.argsort(-score, axis=1), 1)[:, :6]
    exact = np.argsort(-(unit[queries] @ unit.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(near.tolist(), exact.tolist())]) >= 0.95
    assert max(visited) < 0.7  # 3,000 to 4,000 nodes at any size: below a tenth of a shard of 50,000
