import hashlib
import random
import re
from collections import Counter

import numpy as np

from strandline.llm import substring_dedup as sub
from strandline.llm.oracles import ORACLES
from strandline.llm.queries import QUERIES


def brute(rows):
    split = [(i if i is not None else sub.LAST, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for (own, _), (i, w) in zip(rows, split, strict=True):
        gone = {p for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (i, s) for p in range(s, s + 20)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((own, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_query(spark, sf_dir, same_rows):
    same_rows(QUERIES["op6_substring_dedup"](spark, sf_dir), ORACLES["op6_substring_dedup"])


def test_random_and_runs(spark, rows):
    rng = random.Random(2)
    docs = [(r[0], r[1]) for r in rows]
    passages = [[f"v{rng.randrange(size)}" for _ in range(rng.randint(15, 60))] for size in (1, 2, 3, 40, 40, 400)]
    for k in range(80):
        w = [f"v{rng.randrange(rng.choice([1, 2, 50]))}" for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        docs.append((1000 - k, " ".join(w)))
    docs += [docs[-1], docs[-5]]
    assert result(sub.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_equal_windows_share_an_anchor():
    rng = random.Random(3)
    for _ in range(60):
        letters = [b"%d" % i for i in range(rng.choice([1, 2, 3, 8, 50]))]
        base = [letters[0]] * rng.choice([0, 25]) + [rng.choice(letters) for _ in range(rng.randint(20, 60))]
        docs = [b" ".join([rng.choice(letters) for _ in range(rng.randint(0, 30))] + base + [rng.choice(letters) for _ in range(rng.randint(0, 30))]).decode() for _ in range(4)]
        names, first, left, row, at = sub._flat(docs)
        own = [{} for _ in docs]
        for c, k in zip(*sub.anchors(names, first, left), strict=True):
            own[row[c]][int(at[c])] = int(k)
        windows = {}
        for d, t in enumerate(docs):
            w = t.split()
            for s in range(len(w) - 19):
                windows.setdefault(tuple(w[s : s + 20]), []).append((d, s))
        for places in windows.values():
            shared = [{(p - s, k) for p, k in own[d].items() if s <= p < s + sub.CHOICE} for d, s in places]
            assert len(places) == 1 or set.intersection(*shared)


def test_symbols_follow_from_their_contexts():
    """Wherever a symbol's context occurs, the symbol does; so equal passages hold equal symbols."""
    rng = random.Random(5)
    for _ in range(40):
        letters = [b"%d" % i for i in range(rng.choice([2, 3, 6]))]
        docs = [b" ".join(rng.choice(letters) for _ in range(rng.randint(0, 60))).decode() for _ in range(30)]
        names, first, left, _, _ = sub._flat(docs)
        text = np.cumsum(first)
        for sym, lo, hi in sub.recompress(names, first, 4):
            inside = [(x, a, b) for x, a, b in zip(sym.tolist(), lo.tolist(), hi.tolist(), strict=True) if a >= 0 and b <= len(names) and text[a] == text[b - 1]]
            by_context = {}
            for x, a, b in inside:
                by_context.setdefault(names[a:b].tobytes(), set()).add(x)
            seen = {(x, a, b) for x, a, b in inside}
            for a in range(len(names)):
                for b in range(a + 1, min(a + 13, len(names) + 1)):
                    if text[a] == text[b - 1]:
                        assert all((x, a, b) in seen for x in by_context.get(names[a:b].tobytes(), ()))


def test_rounds_matter(monkeypatch):
    """Without a round other symbols are taken: matching rests on them."""
    rng = random.Random(6)
    doc = " ".join(f"v{rng.randrange(3000)}" for _ in range(4000))
    names, first, left, _, _ = sub._flat([doc])
    taken = [set(zip(*(x.tolist() for x in sub.anchors(names, first, left, rounds)), strict=True)) for rounds in range(4)]
    assert all(len(a & b) < 0.1 * len(a) for a in taken for b in taken if a is not b)
    keys = np.array([k for _, k in taken[3]], dtype=np.uint64)
    assert (keys >> np.uint64(61) == 0).mean() > 0.95  # nearly all windows take a symbol of the last round
    assert len(taken[3]) < len(names) / 6


def test_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(2, text, 1, "a"), (1, text, 2, "b")], "doc_id long, text string, id int, th string")
    assert {(r.doc_id, r.n_removed) for r in sub.remove_repeats(docs).collect()} == {(1, 0), (2, 30)}


def test_empty(nothing):
    assert sub.remove_repeats(nothing).count() == 0
