import zlib

import numpy as np

from strandline.llm import language_id as lid


def test_gradient():
    net = lid.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    grid, mask = lid.padded([b" ab ", b" c ", b" xyz "])
    y = np.array([0, 1, 2])
    _, g = net.gradient(grid, mask, y)
    rng = np.random.default_rng(0)
    for name, w in net.w.items():
        used = np.argwhere(np.abs(g[name]) > 1e-5)
        for at in used[rng.integers(0, len(used), 3)]:
            at = tuple(at)
            w[at] += 1e-3
            up = net.gradient(grid, mask, y)[0]
            w[at] -= 2e-3
            down = net.gradient(grid, mask, y)[0]
            w[at] += 1e-3
            assert abs((up - down) / 2e-3 - g[name][at]) < 1e-3 + 0.02 * abs(g[name][at]), name


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    for r in found[:200]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_awkward(awkward, nothing, rows):
    found = lid.identify(awkward, max_docs=10, max_parts=4).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id in (3, 4, 5, 6):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de")
    assert lid.identify(nothing).count() == 0


def by_hand(net, raw):
    """Mean probabilities, one position after the other."""
    w, H = {k: v.astype(float) for k, v in net.w.items()}, lid.HIDDEN

    def run(d, order):
        h, out = np.zeros(H), {}
        for t in order:
            x = w["embed"][raw[t]] @ w[f"{d}x"] + w[f"{d}b"]
            z, r = np.split(1 / (1 + np.exp(-(x[: 2 * H] + h @ w[f"{d}h"][:, : 2 * H]))), 2)
            h = out[t] = h + z * (np.tanh(x[2 * H :] + (r * h) @ w[f"{d}h"][:, 2 * H :]) - h)
        return out

    f, b = run("f", range(len(raw))), run("b", reversed(range(len(raw))))
    p = [np.exp(np.r_[f[t], b[t]] @ w["out"] + w["bias"]) for t in range(len(raw))]
    return np.mean([x / x.sum() for x in p], axis=0)


def test_states_cross_words():
    net = lid.train([(b"the cat and the dog", "en"), (b"der hund und die katze", "de"), (b"le chat", "fr")] * 20, steps=8)
    texts = ["The cat, 12 dogs", "x" * 300, "und die", "漢字 ist"]
    for (lang, score), t in zip(lid.predict(net, texts), texts, strict=True):
        p = by_hand(net, lid.plain(t))
        assert lang == net.langs[p.argmax()] and abs(score - p.max()) < 1e-4
    # The same word is read differently between other words.
    a, b = (net.positions([x])[:, 0] for x in (b"le hund", b"en hund"))
    assert np.abs(a[3:] - b[3:]).max() > 1e-4


def test_pieces_do_not_depend_on_each_other():
    net = lid.train([(b"the cat and the dog", "en"), (b"der hund und die katze", "de")] * 20, steps=8)
    texts = ["the cat " * 2000, "a", "x" * 5000, None, "123", "der hund"]
    together = list(lid.predict(net, texts))
    assert together[3:5] == [("und", 0.0)] * 2
    for t, one in zip(texts, together, strict=True):
        alone = next(lid.predict(net, [t]))
        assert alone[0] == one[0] and abs(alone[1] - one[1]) < 1e-5
    # The lead-in is long enough: all in one piece gives nearly the same.
    whole = net.positions([lid.plain(texts[0])])[:, 0].mean(0)
    assert abs(whole.max() - together[0][1]) < 0.01


def test_short_mixed_and_unspaced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = lid.train(lid.sample(docs, lid.MAX_DOCS, lid.MAX_LANGS, lid.MAX_PARTS))
    held = [r for r in docs.select("doc_id", "text", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and len(r.text) > 60]
    for cut in (lambda t: t[:40], lambda t: t[:400].replace(" ", "")):
        found = [p for p, _ in lid.predict(net, [cut(r.text) for r in held])]
        assert sum(p == r.lang for p, r in zip(found, held, strict=True)) / len(held) > 0.95
    de, fr = (next(r.text for r in held if r.lang == x)[:300] for x in ("de", "fr"))
    assert [p for p, _ in lid.predict(net, [de * 3 + fr, de + fr * 3])] == ["de", "fr"]


def test_many_languages(spark):
    rows = [(i, f"text number {i} of a language", f"l{i % 1000:04d}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lid.sample(docs, 400, 50, 4)
    assert len({lang for _, lang in got}) == 50 and len(got) <= 400
    everyone = lid.sample(docs, 1600, 1000, 4)
    assert 900 < len({lang for _, lang in everyone}) <= 1000 and len(everyone) <= 1600
    net = lid.train(everyone, steps=2)
    assert len(list(lid.predict(net, ["some text"] * 3))) == 3


def test_letters():
    assert all(map(lid.has_letter, ("a", "É", "漢", "1 ß", "ª")))
    assert not any(map(lid.has_letter, ("", "²", "½ ①", "123 _ - \n", "Ⅷ")))
