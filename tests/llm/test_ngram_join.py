import random
from collections import Counter

import numpy as np
import pyarrow as pa

from strandline.llm import ngram_join as ng
from strandline.llm.oracles import ORACLES
from strandline.llm.queries import QUERIES


def brute(rows):
    words = [tuple(w.decode() for w in ng.word_list(t or "")) for _, t in rows]
    ids = [i if i is not None else ng.LAST for i, _ in rows]
    rep = {}
    for i, w in zip(ids, words, strict=True):
        if w:
            rep[w] = min(rep.get(w, i), i)
    sets = {w: {w[k : k + 5] for k in range(max(1, len(w) - 4))} for w in rep}
    links = {w: set() for w in rep}
    keys = list(rep)
    for a, x in enumerate(keys):
        for y in keys[:a]:
            both = len(sets[x] & sets[y])
            if both and 9 * both >= 4 * (len(sets[x]) + len(sets[y])):
                links[x].add(y)
                links[y].add(x)
    out = []
    for (own, _), i, w in zip(rows, ids, words, strict=True):
        if not w:
            out.append((own, own, own, 0))
            continue
        seen, todo = {w}, [w]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        name = lambda x: None if x == ng.LAST else x
        out.append((own, name(min(rep[y] for y in seen)), name(rep[w]), len(links[w])))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.class_id, r.copy_of, r.n_links) for r in df.collect())


def near_copies():
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([4, 30, 80]))]
        for k in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows.append((g * 100 + k, " ".join(w)))
    return rows


def test_query(spark, sf_dir, same_rows):
    same_rows(QUERIES["op9_ngram_join"](spark, sf_dir), ORACLES["op9_ngram_join"])


def test_near_copies_and_awkward(spark, rows):
    docs = near_copies() + [(r[0] + 5000 if r[0] else r[0], r[1]) for r in rows]
    assert result(ng.report(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_blocks(spark, monkeypatch):
    """Groups cut into several blocks give the same."""
    monkeypatch.setattr(ng, "BLOCK", 4)
    docs = near_copies()
    assert result(ng.report(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_chain_verifies_candidates_only(monkeypatch):
    """In a chain of 3,000 classes only neighbours are verified, each pair once, and no link is lost."""
    rng = random.Random(9)
    stream = [b"w%d" % rng.randrange(10**6) for _ in range(3000 * 5 + 110)]
    sets = [ng.shingles(stream[k * 5 : k * 5 + 104]) for k in range(3000)]
    values = np.concatenate([ng.minhashes(sets[k : k + 250]) for k in range(0, 3000, 250)])
    keys, sig = ng.band_keys(values).view(np.int64), ng.signature(values)
    buckets = {}
    for c in range(3000):
        for band in range(ng.BANDS):
            buckets.setdefault((int(keys[c, band]), band), []).append(c)
    rows = [(g, band, c) for (g, band), own in buckets.items() if len(own) > 1 for c in own]
    kept = [sum(1 << b for b in range(ng.BANDS) if len(buckets[int(keys[c, b]), b]) > 1) for c in range(3000)]
    n = len(rows)
    table = pa.table({
        "grp": [r[0] for r in rows], "band": [r[1] for r in rows], "nb": [1] * n, "blk": [0] * n, "i": [0] * n, "j": [0] * n, "cls": [r[2] for r in rows], "n": [len(sets[r[2]]) for r in rows],
        "sig": [sig[r[2]].tobytes() for r in rows], "kept": [kept[r[2]] for r in rows], "sh": [np.sort(sets[r[2]].view(np.int64)) for r in rows],
    })
    compared = []
    real = ng.verified
    monkeypatch.setattr(ng, "verified", lambda a, b, *rest: (compared.extend(zip(table["cls"].take(pa.array(a)).to_pylist(), table["cls"].take(pa.array(b)).to_pylist(), strict=True)), real(a, b, *rest))[1])
    found = ng._verify(table, ng.least_matches())
    links = Counter()
    for c, k in zip(found["cls"].to_pylist(), found["links"].to_pylist(), strict=True):
        links[c] += k
    near = sum(9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b])) for a in range(20, 40) for b in range(3000) if a != b)
    assert sum(links[c] for c in range(20, 40)) == near == 20 * 4
    assert len(compared) == len({frozenset(p) for p in compared}) < 3000 * 8
    alive = ng._prune(table, ng.least_matches())
    assert set(alive["cls"].to_pylist()) == set(range(3000)) and alive.num_rows <= n


def test_stage(awkward, nothing):
    kept = ng.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, None, 8, 9, 10])
    assert ng.keep_one(nothing).count() == 0


def test_components(spark):
    chain = [(k, k) for k in range(300)] + [(k, k + 1) for k in range(299)] + [(1000, 500), (1001, 501)]
    found = {r.node: r.label for r in ng.components(spark.createDataFrame(chain, "grp long, node long")).collect()}
    assert found == {**dict.fromkeys(range(300), 0), 500: 500, 501: 501}


def test_components_without_limit(spark, monkeypatch):
    """No number of rounds ends the search before the labels are settled."""
    monkeypatch.setattr(ng, "range", lambda n: range(min(n, 2)), raising=False)
    chain = [(k, k) for k in range(120)] + [(k, k + 1) for k in range(119)]
    found = {r.node: r.label for r in ng.components(spark.createDataFrame(chain, "grp long, node long")).collect()}
    assert found == dict.fromkeys(range(120), 0)


def test_posterior():
    least = dict(ng.least_matches(1e-6))
    assert all(0.3 * n < m < 0.8 * n for n, m in least.items() if n > 24)
    rng = np.random.default_rng(1)
    estimates = []
    for _ in range(100):
        x = rng.integers(0, 1 << 63, 330).astype(np.uint64)
        v = ng.minhashes([np.unique(x[:300]), np.unique(x[30:])])
        estimates.append((v[0] == v[1]).mean())
    assert abs(np.mean(estimates) - 270 / 330) < 0.01
