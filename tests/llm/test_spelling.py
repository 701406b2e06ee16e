import random
import re
import zlib
from collections import Counter

import pytest

from strandline.llm import spelling
from strandline.llm.oracles import ORACLES
from strandline.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Whether one inserted, deleted or replaced symbol turns one word into the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :]


def words_of(rows, every=199, least=5):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= least}


def brute(count, times=5):
    """By all pairs of words that share what is left after a deletion or none."""
    by = {}
    for w in count:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(v, []).append(w)
    pairs = {(a, b) for group in by.values() for a in group for b in group if near(a, b)}
    beside = {}
    for a, b in pairs:
        beside.setdefault(a, []).append(b)
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda x: (-count[x], x))
        if count[best] >= times * count[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(beside.get(w, [])), count[form[w]] if w in form else None) for w, n in count.items()}


def result(df):
    found = df.collect()
    out = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found}
    assert len(out) == len(found)
    return out


def test_query(spark, sf_dir, same_rows):
    same_rows(QUERIES["op11_spelling"](spark, sf_dir), ORACLES["op11_spelling"])


def test_sql_is_as_brute_force(duck, sf_dir):
    """The SQL and the plain Python that the other tests use agree on the table."""
    want = brute(words_of(duck.execute("SELECT doc_id, text FROM documents").fetchall()))
    assert any(r[1] for r in want)
    assert set(duck.execute(ORACLES["op11_spelling"]).fetchall()) == want


def test_awkward(spark, awkward, nothing, rows):
    plain = [(r[0], r[1]) for r in rows]
    assert result(spelling.report(awkward, every=2, least=1)) == brute(words_of(plain, 2, 1))
    assert spelling.report(nothing).count() == 0


def vocabulary(seed, n, alphabet, long=False):
    rng = random.Random(seed)
    words = set()
    for _ in range(n):
        base = "".join(rng.choice(alphabet) for _ in range(rng.randrange(6, 12)))
        for _ in range(4):
            k, c = rng.randrange(len(base)), rng.choice(alphabet)
            words |= {base, base[:k] + c + base[k + 1 :], base[:k] + base[k + 1 :], base[:k] + c + base[k:]}
    if long:
        words |= {"ab" * 3000, "ab" * 2999 + "b", "ab" * 1500 + "c" + "ab" * 1500}
    return {w: rng.choice([1, 1, 2, 5, 6, 25, 30, 125, 700]) for w in words if len(w) >= 6}


@pytest.mark.parametrize(("seed", "alphabet", "frequent", "most"), [(1, "ab", 5, 4), (2, "abé", 50, 50), (3, "abcdefghijklmnopqrstuvwxyzàÿ", 3, 2), (4, "ab", 1 << 30, 1), (5, "ab", 0, 3)])
def test_index_finds_all(spark, seed, alphabet, frequent, most):
    """Long lists, short ones, grams of every length, words of thousands of letters."""
    count = vocabulary(seed, 150, alphabet, long=seed == 2)
    words = spark.createDataFrame([(w, n, i) for i, (w, n) in enumerate(count.items())], "word string, n long, w long")
    assert result(spelling.variants(words, 5, frequent, most)) == brute(count)


@pytest.mark.parametrize("alphabet", ["ab", "abcdef"])
def test_bounds(alphabet):
    """No edit leaves fewer grams than the bound, and each survivor keeps its list."""
    rng = random.Random(9)
    for _ in range(2000):
        frequent = {"".join(rng.choice(alphabet + "^") for _ in range(rng.choice([2, 3]))) for _ in range(rng.randrange(30))}
        word = "".join(rng.choice(alphabet) for _ in range(rng.randrange(6, 12)))
        k, c, padded = rng.randrange(len(word) + 1), rng.choice(alphabet), f"^{word}$"
        grams = spelling.grams_of(padded, frequent)
        bound = spelling.surviving(grams, len(padded))
        assert bound >= 1
        keys = {int(x) for side in spelling.list_keys(padded, grams) for x in side}
        for other in (word[:k] + c + word[k:], word[:k] + word[k + 1 :], word[:k] + c + word[k + 1 :]):
            own = spelling.grams_of(f"^{other}$", frequent)
            assert len(keys & {int(x) for side in spelling.list_keys(f"^{other}$", own) for x in side}) >= bound


def test_chain_of_forms(spark):
    count = {"abcdefghij"[: 6 + k]: 5 * 5**k for k in range(5)}
    words = spark.createDataFrame([(w, n, i) for i, (w, n) in enumerate(count.items())], "word string, n long, w long")
    assert {r.root for r in spelling.variants(words).collect()} == {"abcdefghij"}
