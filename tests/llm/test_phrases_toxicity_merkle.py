"""Collocations, toxicity and the Merkle manifest against plain versions, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sensorloom.llm import collocations, merkle, registry, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, tree string, f long"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source, n_chars), with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_collocations", "op13_merkle_manifest"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(registry.ORACLES[name])
    at = [[c[0] for c in cur.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)


# collocations


def plain_collocations(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p in often for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * often[p] >= 100 * counts[p[i : i + k]]}
        scored = []
        for p, a in often.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def test_collocations_like_counting_all_phrases(spark, monkeypatch):
    """Shards of a few texts, so that counts are merged; ties, repeats, odd white space and punctuation."""
    monkeypatch.setattr(collocations, "SHARD", 300)
    rng = np.random.default_rng(2)
    words = ["a", "B", "the", "Of", "é", "x-y", "a b", "\x0e", "it's", "ÄB"]
    rows = []
    for k in range(300):
        text = "".join(str(words[int(w)]) + [" ", "  ", "\t", ". ", "\n", ",", " ; "][int(s)] for w, s in zip(np.minimum(rng.geometric(0.35, 40) - 1, 9), rng.choice(7, 40, p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])))
        rows.append((k, text + " new york city hall park", [None, "en", "de", "und"][k % 4], "s", 1))
    rows += [(1, None, "en", None, None), (None, "", None, None, None), (7, " .;\n ", "fr", "s", 0)]
    for least, top in ((5, 2000), (60, 7)):
        got = [tuple(r) for r in collocations.collocations(docs(spark, rows).repartition(3), least, top).collect()]
        assert set(got) == plain_collocations(rows, least, top) and len(set(got)) == len(got)
    assert collocations.collocations(docs(spark, []), 5).count() == 0


def test_longer_phrases_are_not_counted_in_vain(spark, monkeypatch):
    """Frequent pairs, rare triples: no phrase of four or five words can be frequent, so the tasks make none."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{int(w)}" for w in rng.integers(0, 12, 100)), "en", "s", 1) for k in range(30)]
    rows += [(k, "one two three four five six", "en", "s", 1) for k in range(30, 42)]
    df, made = docs(spark, rows).coalesce(1), []
    whole = type(df).mapInArrow

    def counted(self, *args):
        out = whole(self, *args).persist()
        made.append(out.count())
        return out

    monkeypatch.setattr(type(df), "mapInArrow", counted)
    assert {tuple(r) for r in collocations.collocations(df, 10).collect()} == plain_collocations(rows, 10, 2000)
    assert sum(made) < 3000


def test_numbers_of_words_differ(spark):
    """So few bits that the first salts give two words one number; rare words that no bitmap lets through don't matter."""
    words = spark.createDataFrame([(lang, 1, f"w{k}", 5) for k in range(30) for lang in ("en", "de")] + [("en", 1, f"rare{k}", 1) for k in range(2000)], "lang string, words int, phrase string, f long")
    salt, hashed = collocations.salted(words, 5, 10)
    assert salt != "0" and hashed.count() == 2060
    assert len({r.h >> 54 for r in hashed.where("f = 5").collect()}) == 60


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000_000_000
    df = spark.createDataFrame([(big, big, 5, 7)], "a long, n long, l long, r long")
    score = df.selectExpr("cast(a as decimal(38,0)) * cast(n as decimal(20,0)) * 1000 div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as s").where("s is not null")
    small = spark.createDataFrame([(10**14, 10**17, 10**9, 10**9)], "a long, n long, l long, r long").selectExpr("cast(a as decimal(38,0)) * cast(n as decimal(20,0)) * 1000 div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as s")
    assert small.first().s == 1000 * 10**14 * 10**17 // 10**18 and score.columns == ["s"]


# toxicity


def errors(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row


def test_automaton_like_the_edit_distance():
    rng = np.random.default_rng(4)
    letters = "abcd"
    word = lambda lo, hi: "".join(rng.choice(list(letters), rng.integers(lo, hi)))
    terms, stems = {word(3, 12) for _ in range(25)}, {word(3, 11) for _ in range(8)}
    made = toxicity.Automaton(terms, stems)
    tried = [word(1, 14) for _ in range(3000)] + [t[:i] + t[i + 1 :] for t in terms for i in range(len(t))] + [s + "zz" for s in stems] + [*terms, *stems, "", "z"]
    for w in tried:
        found = [(errors(w, t)[-1], 0, -len(t), t) for t in terms if errors(w, t)[-1] <= toxicity.budget(t, False)]
        for s in stems:
            e = min((errors(w[:k], s)[-1] for k in range(len(w))), default=9)
            if e <= toxicity.budget(s, True):
                found.append((e, 1, -len(s), s))
        best = min(found, default=None)
        want = best and ((toxicity.FUZZY if best[0] else toxicity.STEM if best[1] else toxicity.WHOLE), best[3])
        assert made.match(w) == want, w


def test_quotation_counts_less_than_abuse():
    m = toxicity.Matcher({"moron": 1.0}, {})
    by = lambda text: [b for _, b, _ in m.hits(text)]
    assert by("what a moron that is") == [1.0] and by("you are a moron, mate") == [1.5]
    assert by('they used "moron" as a label') == [0.2] and by("man nannte es „Moron“ damals") == [0.2] and by("she wrote moron there") == [0.5]
    assert by('5" long. A moron!') == [1.0] and by("İ moron") == [1.0] and by(None) == [] and by("mor on") == []
    model = toxicity.Model(m, toxicity.PRIOR)
    quoted, abuse, clean = model.score(['the word "moron" is old', "you moron, you utter moron, moron", ""])
    assert clean < quoted < 0.5 < abuse


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in toxicity.op12_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(labels[k], r.predicted) for k, r in got.items() if r.held_out and k in labels]
    assert sum(a == b for a, b in held) / len(held) >= 0.95


def test_toxicity_on_odd_rows(spark):
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    odd = docs(spark, [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "fine words", "en", "s", 3), (2, "fine words", "en", "s", 3)])
    for given in ([], [(2, 0)], [(2, None), (None, 1), (1, 7)]):
        got = toxicity.predictions(odd, labels(given)).collect()
        assert sorted((r.doc_id or -1, r.predicted) for r in got) == [(-1, 0), (1, 0), (2, 0), (2, 0)]
    assert toxicity.predictions(docs(spark, []), labels([(1, 1)])).count() == 0
    rows = [(k, ("you total grotbag again " if k % 3 == 0 else "you total friend again ") * 3 + f"w{k}", "en", "s", 1) for k in range(120)]
    got = {r.doc_id: r.predicted for r in toxicity.predictions(docs(spark, [*rows, (900, "some grotbagg and grotbag here", "xx", None, None), (901, "total friend again", None, None, None)]), labels([(k, int(k % 3 == 0)) for k in range(120)])).collect()}
    assert all(got[k] == (k % 3 == 0) for k in range(120)) and (got[900], got[901]) == (1, 0)


# manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, g, s, n: sha(put(d), put(s), put(g), put(n), put(t))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            run = i // 2 * 2
            out.append((nodes[run:i], nodes[i + 1 : run + 2]))
            i //= 2
        return out

    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for g in langs}
    trees = {g: tree([leaf(*r) for r in own[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    root, out = top[-1][0], []
    for j, g in enumerate(langs):
        for i, r in enumerate(own[g]):
            steps = path(trees[g], i) + path(top, j)
            d, t, _, s, n = r
            at = leaf(d, t, g, s, n + 1) if d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0 else leaf(*r)
            for before, after in steps:
                at = sha(*before, at, *after)
            out.append((d, leaf(*r), trees[g][-1][0], root, sha(*(x for b, a in steps for x in (*b, *a))), at, at == root))
    return out


@pytest.mark.parametrize("n, part", [(1, 3), (2, 1), (97, 5), (300, 2)])
def test_manifest_like_a_plain_tree(spark, monkeypatch, n, part):
    """Parts of a few rows and three fragments at a time, so that trees are merged over several rounds."""
    monkeypatch.setattr(merkle, "PART_ROWS", part)
    monkeypatch.setattr(merkle, "FAN", 3)
    rng = np.random.default_rng(n)
    rows = [(int(k), None if k % 11 == 0 else f"text é {k}", [None, "en", "de", "", "é", "zz"][int(rng.integers(6))], None if k % 5 == 0 else "s", None if k % 13 == 0 else int(k)) for k in rng.integers(0, 2 * n, n)]
    if n > 90:
        rows += [rows[3]] * 20 + [(None, "no id", "en", "s", 5), (None, None, None, None, None), (-3, "", "solo", "s", 2**62)]
    got = [tuple(r) for r in merkle.manifest(docs(spark, rows).repartition(3)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_manifest(rows)))
    assert n < 90 or {r[6] for r in got} == {True, False}


def test_manifest_of_nothing(spark):
    assert merkle.manifest(docs(spark, [])).collect() == []


def test_merging_is_associative():
    rng = np.random.default_rng(1)
    for arity in (2, 3):
        for leaves in (1, 2, 7, 16, 33):
            nodes = [sha(str(i)) for i in range(leaves)]
            whole, _ = merkle.fold({(0, i): d for i, d in enumerate(nodes)}, leaves, arity)
            assert len(whole) == 1
            for _ in range(20):
                parts = rng.integers(0, 3, leaves)
                a, b, c = ({(0, i): nodes[i] for i in range(leaves) if parts[i] == p} for p in range(3))
                m = lambda x, y, leaves=leaves, arity=arity: merkle.merge(x, y, leaves, arity)
                assert m(m(a, b), c) == m(a, m(b, c)) == m(c, m(b, a)) == whole and m(a, {}) == merkle.fold(a, leaves, arity)[0]
