import random
import re
import zlib

import numpy as np
import pytest

from strandline.llm import toxicity


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.report_scores(docs, labels).join(labels, "doc_id").collect()
    for r in found[:200]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in found if r.held_out]
    right = sum(r.predicted == r.toxic for r in held) / len(held)
    recall = sum(r.predicted for r in held if r.toxic) / sum(r.toxic for r in held)
    assert right > 0.98 and recall > 0.9


#: Sentences that are no insults, that turn one away or tell of one, and that throw one.
CLEAN = ["The train arrives at nine.", "We discuss the distance between two towns.", "The path through the forest is worth a walk.", "Trade and transport grew. The traders travelled far.", "Take out the trash.", "You will burn the toast. Do not beat the eggs."]
TURNED = ["He was never an idiot.", "you are not a trash.", "he said you are a trash.", "Nobody reported that anyone called him an idiot.", "She wrote that you are an idiot."]
THROWN = ["You are an idiot.", "you are a trash.", "A pathetic, worthless loser.", "I will kill you."]


def test_words_do_not_decide(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    g = toxicity.learn(docs, labels)
    assert {"idiot", "trash", "stupid"} <= set(g.lexicon)
    assert min(len(f) for f in g.lexicon if f.endswith("*")) >= 6
    score = lambda text: g.score(text)[0]
    assert all(score(s) < 0.5 for s in [*CLEAN, *TURNED])
    assert all(score(s) >= 0.5 for s in THROWN)
    assert max(map(score, TURNED)) < min(map(score, THROWN)) - 0.3
    for clause in ("You are an idiot", "You stupid clown"):
        assert score(f"She said: {clause}.") < score(f"{clause}.") - 0.3 and score(f"Not {clause}.") < score(f"{clause}.") - 0.3


def brute_counts(rows):
    """(words, p, n, p_more, n_more) of each word and beginning, text by text."""
    out, words = {}, {}
    for text, y, more in rows:
        uses = {}
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            if len(w) > 2:
                for f in [w, *[w[:k] + "*" for k in range(5, 9) if k < len(w)]]:
                    uses[f] = uses.get(f, 0) + 1
                    if y:
                        words.setdefault(f, set()).add(w)
        for f, n in uses.items():
            own = out.setdefault(f, [0, 0, 0, 0])
            for k in (1 - y, 3 - y)[: 1 + more]:
                own[k] += min(n, toxicity.USES)
    return {f: (len(words[f]), *own) for f, own in out.items() if own[0] >= toxicity.USES}


def brute_lexicon(counts, bad, good, evidence):
    out, base = {}, bad / (bad + good)
    for f, (words, p, n, p2, n2) in counts.items():
        a, b = p - p2, n - n2
        rate = (a + 0.1) / (a + b + 0.2)
        if rate > 0.6 and a * np.log(rate / base) + b * np.log((1 - rate) / (1 - base)) >= evidence and p2 and p2 >= n2 and (words >= 3 or f[-1] != "*"):
            out[f] = (p, n)
    kept = {f: v for f, v in out.items() if f[-1] != "*" or v[0] > 1.2 * max([out[w][0] for w in out if w[-1] != "*" and w.startswith(f[:-1])], default=0)}
    return {f: float(np.clip(np.log((p + 0.5) / (n + 0.5) * good / bad) / 5, 0.05, 1)) for f, (p, n) in kept.items()}


def test_lexicon_and_score(spark):
    """Counts, choice and weights of the lexicon, and scores, against plain Python."""
    rng = random.Random(11)
    calm, hot = [f"calm{chr(97 + k)}" for k in range(20)], ["idiot", "grobian", "grobianisch", "grobiane", "grobianen", "clown"]
    rows = [(i, " ".join(rng.choice(calm + (hot if i % 4 == 0 else hot[:1] if rng.random() < 0.1 else [])) for _ in range(25)), int(i % 4 == 0), rng.random() < 0.4) for i in range(300)]
    df = spark.createDataFrame(rows, "th long, text string, y int, more boolean")
    counted = toxicity.count_features(df)
    want = brute_counts([r[1:] for r in rows])
    assert {r.f: (r.words, r.p, r.n, r.p_more, r.n_more) for r in counted.collect()} == want
    lexicon = toxicity.choose_lexicon(counted, 75, 225, 6.0)
    assert lexicon == pytest.approx(brute_lexicon(want, 75, 225, 6.0))
    assert {"grobi*", "clown"} <= set(lexicon) and "clown*" not in lexicon and "calma" not in lexicon
    g = toxicity.Grammar({"idiot": 1.0, "clown": 0.5}, list(toxicity.PRIOR))
    # One aimed clause, two plain ones of which the first doesn't count, one negated, in 14 tokens.
    z = 8 * np.log(2.0) + 8 * np.log1p(0.5) - 3
    assert g.score("You idiot. A clown. An idiot! Not a clown.")[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_signs():
    """Clauses that are turned away never raise a score, aimed ones never lower it, whatever the labels say."""
    rng = np.random.default_rng(2)
    x = rng.exponential(size=(300, toxicity.FEATURES))
    w = toxicity.fit_logistic(x, (x[:, 3] + x[:, 4] > x[:, 2]).astype(float))
    assert all(v * s >= 0 for v, s in zip(w, toxicity.SIGNS, strict=True))
    assert toxicity.fit_logistic(np.zeros((4, toxicity.FEATURES)), np.zeros(4))[:-1] == list(toxicity.PRIOR[:-1])


def grammar():
    return toxicity.Grammar({"idiot": 1.0, "moron*": 0.5, "moron": 0.5}, [0.0] * (toxicity.FEATURES + 1))


def test_grammar():
    g = grammar()

    def kinds(text):
        return {k: v for k, v in g.clauses(text)[0].items() if v}

    assert kinds("An idiot.") == {"plain": 1.0}
    assert kinds("Idiot idiot moron idiot.") == {"several": 1.0}
    assert kinds("You idiot.") == kinds("An idiot, you!") == {"targeted": 1.0}
    assert kinds("They are not an idiot.") == {"negated": 1.0}
    assert kinds("An idiot is not here.") == {"plain": 1.0}
    assert kinds("They said you idiot.") == {"reported": 1.0}
    assert kinds("I will kill you.") == {"threat": 1.0} and kinds("I will not kill you.") == {"negated": 1.0}
    assert kinds("I will kill.") == kinds("You will kill it.") == {}
    assert kinds("They kill time.") == {} and kinds("nothing here") == {}
    assert kinds("You. An idiot.") == {"plain": 1.0}
    assert kinds("moron") == {"plain": 0.5}
    assert g.measure("An idiot. Fine. You idiot!")[1] == 2


def interpreted(words):
    """The kind of one clause, straight from the rules and without states."""
    hot = [i for i, w in enumerate(words) if w in ("idiot", "moron")]
    threats = [i for i, w in enumerate(words) if w == "kill" and "will" in words[:i] and "you" in words[i:]]
    if not hot and not threats:
        return None
    if "said" in words:
        return "reported"
    first = min(i for i, w in enumerate(words) if w in ("idiot", "moron", "kill"))
    if "not" in words[:first]:
        return "negated"
    if threats:
        return "threat"
    return "targeted" if "you" in words else "several" if len(hot) > 1 else "plain"


def test_random_clauses():
    rng, g = random.Random(3), grammar()
    for _ in range(3000):
        clauses = [[rng.choice(["idiot", "moron", "kill", "will", "you", "not", "said", "sky", "walk"]) for _ in range(rng.randrange(0, 7))] for _ in range(3)]
        expected = dict.fromkeys(toxicity.EVENTS, 0.0)
        for words in clauses:
            if kind := interpreted(words):
                expected[kind] += 1.0 if "idiot" in words or "kill" in words else 0.5
        assert g.clauses(". ".join(" ".join(w) for w in clauses))[0] == expected, clauses


def test_conflicting_labels(spark):
    """The largest label counts, however the rows are dealt."""
    docs = spark.createDataFrame([(i, f"some text number {i} " + ("idiot " if i % 2 else "")) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)] + [(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    one, many = (toxicity.learn(docs, labels.repartition(n)) for n in (1, 7))
    assert one.lexicon == many.lexicon and "idiot" in one.lexicon
    assert np.allclose(one.weights, many.weights)


def test_repeated_ids_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(7, f"text {i} idiot") for i in range(50)] + [(8, f"calm {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs, labels, max_labelled=20).weights


def test_awkward(spark, awkward, nothing, rows):
    labels = spark.createDataFrame([(1, None, 1), (3, None, 0), (4, None, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.report_scores(awkward, labels).collect()
    assert len(found) == len(rows)
    assert all(r.held_out for r in found if r.doc_id is None)
    kept = toxicity.drop_toxic(awkward, labels.limit(0))
    assert kept.columns == awkward.columns and kept.count() == len(rows)
    assert toxicity.report_scores(nothing, labels).count() == 0
