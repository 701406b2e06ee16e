import random
import re
import time
from collections import Counter

from strandline.llm import licenses
from strandline.llm.queries import QUERIES


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += own
        labels |= {label} if own else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_query(spark, sf_dir):
    texts = Counter((r.doc_id, *brute(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    found = QUERIES["op7_licenses"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == texts
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found)


def test_places():
    a, tags = licenses.automaton(), licenses.tag_automaton()
    for text in ("CC-BY-NC cc by nc, under the MIT license: Apache License, Version 2.0", "under the mit license under the mit license", "xcc by nc", "cc by ncé", "É cc/by\nnc", "", None, "cc " * 1000):
        assert licenses.scan(text, a, tags)[:5] == brute(text)


def test_expressions():
    assert licenses.to_postfix("a or b and c with d".split()) == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.to_postfix(["(", "a", "or", "b", ")", "and", "c"]) == ["a", "b", "or", "c", "and"]
    for bad in (["a", "b"], ["and", "a"], ["(", "a"], ["a", ")"], ["a", "or"], []):
        assert licenses.to_postfix(bad) is None
    said = lambda text, strict=True: (v[0].labels, v[0].sure, v[0].free, v[1]) if (v := licenses.evaluate(text, strict)) else None
    assert said("MIT OR GPL-3.0-only") == ({"mit"}, 0.95, 1.0, {"mit", "gpl"})
    assert said("MIT OR Apache-2.0") == ({"mit", "apache-2"}, 0.95, 1.0, {"mit", "apache-2"})
    assert said("MIT AND GPL-3.0-only") == ({"mit", "gpl"}, 0.95, 0.4, {"mit", "gpl"})
    assert said("GPL-2.0+ WITH Classpath-exception-2.0") == ({"gpl-exception"}, 0.95, 0.7, {"gpl"})
    assert said("MIT AND LicenseRef-own") == ({"mit"}, 0.5, 0.0, {"mit"})
    found = licenses.scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND MPL-2.0\ncode", licenses.automaton(), licenses.tag_automaton())
    assert found[5] == "apache-2,mit,mpl" and found[7] == 0.7


def test_whole_identifiers():
    for known, name in {"gplv3": "gpl", "gpl-v2": "gpl", "lgplv2.1+": "lgpl", "apache-2.0": "apache-2", "bsd-3-clause": "bsd", "0bsd": "bsd", "mit-0": "mit", "cc-by-nc-sa-4.0": "cc-by-nc-sa", "x11": "mit", "mpl2.0": "mpl", "cc0-1.0": "cc0"}.items():
        assert licenses.label(known) == name, known
    for other in ("gplus", "mit-helicopter", "apachehelicopter", "mitten", "foo", "", "3", "psfx-2", "v2"):
        assert licenses.label(other) is None, other


def test_prose_names_no_licence():
    a, tags = licenses.automaton(), licenses.tag_automaton()
    labels = lambda text: licenses.scan(text, a, tags)[5]
    for prose in ("License: frei verwendbar mit Namensnennung", "License: none of mit", "Driver license: no python or ruby or vim needed", "License: see the apache helicopter page", "license: mit Quelle", "license =", 'license: "', "license: or mit"):
        assert labels(prose) == "" and licenses.scan(prose, a, tags)[6] == 0, prose
    found = {"License: GPLv3": "gpl", "License: GPL v2 or later": "gpl", "license: MIT License": "mit", "License: the MIT license. Have fun with ruby.": "mit", '{"license": "BSD-3-Clause", "x": 1}': "bsd", '"license": "(MIT OR GPL-2.0)"}': "mit", "license: MIT AND Zlib": "mit,zlib", "SPDX-License-Identifier: MIT some more": "mit", "SPDX-License-Identifier: GPL-2.0 WITH": "gpl"}
    for text, want in found.items():
        assert labels(text) == want, text


def value(tokens):
    """(labels, sure, free) of an expression by recursive descent."""
    def either(i):
        left, i = both(i)
        while i < len(tokens) and tokens[i] == "or":
            right, i = both(i + 1)
            left = (left[0] | right[0], max(left[1], right[1]), left[2]) if left[2] == right[2] else left if left[2] > right[2] else right
        return left, i

    def both(i):
        left, i = excepted(i)
        while i < len(tokens) and tokens[i] == "and":
            right, i = excepted(i + 1)
            left = left[0] | right[0], min(left[1], right[1]), min(left[2], right[2])
        return left, i

    def excepted(i):
        if tokens[i] == "(":
            left, i = either(i + 1)
            i += 1
        else:
            name = licenses.label(tokens[i])
            left, i = ({name} if name else set(), 0.95 if name else 0.5, licenses.FREEDOM.get(name or "", 0.0)), i + 1
        while i < len(tokens) and tokens[i] == "with":
            left, i = ({x + "-exception" for x in left[0]}, left[1] * (1 if "exception" in tokens[i + 1] else 0.8), left[2] + (1 - left[2]) / 2), i + 2
        return left, i

    return either(0)[0]


def test_random_expressions():
    rng = random.Random(8)
    names = ["mit", "gpl-3.0-only", "mpl-2.0", "cc-by-nc-sa-4.0", "foo-1.0", "agpl-3.0+"]

    def made(depth):
        kind = rng.randrange(4) if depth else 0
        if kind == 0:
            return [rng.choice(names)]
        if kind == 1:
            return ["(", *made(depth - 1), ")"]
        if kind == 2:
            return [*made(0), "with", rng.choice(["classpath-exception-2.0", "foo-2.0"])]
        return [*made(depth - 1), rng.choice(["and", "or"]), *made(depth - 1)]

    for _ in range(500):
        tokens = made(4)
        found = licenses.evaluate(" ".join(tokens).upper())[0]
        assert (found.labels, found.sure, found.free) == value(tokens), tokens


def all_labels(text):
    """Labels and score by plain searches and recursive descent."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    weight = {}
    for phrases, by in ((licenses.ADDED, licenses.ADDED_WEIGHT), (licenses.BASE, licenses.BASE_WEIGHT)):
        for phrase, name in phrases.items():
            if f" {phrase} " in w:
                weight[name] = max(weight.get(name, 0), by)
    for m in re.finditer("|".join(map(re.escape, licenses.TAGS)), low):
        rest = re.split(r"\n|\*/|-->|" + "|".join(map(re.escape, licenses.TAGS)), low[m.end() :])[0]
        tokens = re.findall(r"[a-z0-9.+-]+|[()]|[^\s\"']", rest if m[0][-2] in "rn" else re.split(r"[.;,](?:\s|$)|[}\]]", rest)[0])
        ends = [k for k in range(len(tokens), 0, -1) if licenses.to_postfix(tokens[:k])]
        if m[0] not in licenses.STRICT:
            ends = [k for k in ends if k == len(tokens) and all(licenses.label(t) for t in tokens if t not in ("and", "or", "(", ")"))]
        if ends:
            names, sure, _ = value(tokens[: ends[0]])
            for name in names:
                weight[name] = max(weight.get(name, 0), sure)
    doubt = 1.0
    for name in sorted(weight):
        doubt *= 1 - weight[name]
    return ",".join(sorted(weight)), round(1 - doubt, 6)


PARTS = ["/* SPDX-License-Identifier: ISC */", "SPDX-License-Identifier: CC-BY-NC-SA-4.0\n", "license: MIT", "License-Expression: (Apache-2.0 OR 0BSD)\n", " and ", "under the MIT license", "Mozilla Public License", '"license": "BSD-3-Clause"\n', "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-exception AND ", "\n", "all rights reserved", "License: frei mit Namen\n"]


def test_labels_and_score(spark, sf_dir):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    a, tags = licenses.automaton(), licenses.tag_automaton()
    for t in texts:
        assert licenses.scan(t, a, tags)[5:7] == all_labels(t), t[:300]
    assert licenses.scan("SPDX-License-Identifier: ISC", a, tags)[5] == "isc"
    assert licenses.scan("SPDX-License-Identifier: CC-BY-NC-SA-4.0", a, tags)[5] == "cc-by-nc,cc-by-nc-sa"  # the first by its base phrase


def test_table_with_tags(spark):
    """A table whose texts hold tags: labels and score of each row, whatever the partition."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 12)))) for i in range(300)]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {(r.doc_id, r.labels, r.score) for r in found} == {(i, *all_labels(t)) for i, t in rows}
    assert sum("-exception" in r.labels for r in found) > 20


def test_many_tags():
    a, tags = licenses.automaton(), licenses.tag_automaton()
    for text in ("SPDX-License-Identifier: MIT " * 60_000, "SPDX-License-Identifier: MIT\n" * 60_000, "( " * 10**6, "license: " + "(" * 10**6):
        began = time.perf_counter()
        licenses.scan(text, a, tags)
        assert time.perf_counter() - began < 20


def test_awkward(awkward, nothing, rows):
    assert Counter((r.doc_id, r.n_words) for r in licenses.scan_licenses(awkward).collect()) == Counter((r[0], brute(r[1])[0]) for r in rows)
    assert licenses.scan_licenses(nothing).count() == 0
