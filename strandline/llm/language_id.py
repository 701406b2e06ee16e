"""Language identification by a bidirectional gated recurrent network over bytes.

A text is its lower-cased UTF-8 bytes: letters, digits, spaces and marks alike. A
forward and a backward network (gated recurrent units) read them, and at every
position both states together give a distribution over languages. A document's
probabilities are the mean over all its positions. The network is trained in
numpy by backpropagation through time, with a fixed seed.

States run on from word to word. A text is read in pieces of PIECE bytes side by
side; each piece is led in by the WARM bytes before it and, backwards, by the
WARM bytes behind it, so that every position sees that much on both sides at
least, whatever the text's length and whether or not it has spaces.

It learns from at most ``max_docs`` documents in all, equally many of each
language, and from at most ``max_langs`` languages (the most frequent): those
whose ids have the smallest hashes, and at most ``max_parts`` stretches of STRETCH
bytes of each, spread evenly over the whole text. Counts of languages cover all
rows. Prediction reads whole texts.

Nulls: a text that is null or has no letter is ``und`` with score 0. Null ids are
never learned from and count as held out; null languages aren't learned. With
nothing to learn from, all is ``und``. Ties go to the language first in order.
Repeated rows give repeated results; an empty table gives an empty one. Only
doc_id, text and lang are read; further columns, whatever their names, change
nothing and aren't returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

MAX_DOCS, MAX_LANGS, MAX_PARTS = 1600, 1000, 16
#: ASCII letters, which most texts begin with; other letters are looked for one by one.
LETTER = re.compile("[A-Za-z]")
HIDDEN, EMBED = 8, 8
#: Bytes read side by side, those that lead into them, pieces at once, and bytes of a stretch to learn from.
PIECE, WARM, LANES, STRETCH = 992, 32, 1024, 48


def has_letter(text: str) -> bool:
    """Whether a text has a letter: a digit raised, a fraction or a number in a circle is none."""
    return bool(LETTER.search(text)) or any(map(str.isalpha, text))


def plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def stretches(raw: bytes, most: int) -> list[bytes]:
    """At most ``most`` stretches of a text, evenly spread from its start to its end."""
    n = max(1, min(most, len(raw) // STRETCH))
    room = max(0, len(raw) - STRETCH)
    return [raw[k : k + STRETCH] for k in (room * i // max(1, n - 1) for i in range(n))]


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes by step and word, mask)."""
    length = np.array([len(w) for w in words])
    grid = np.zeros((len(words), length.max()), dtype=np.uint8)
    mask = np.arange(length.max()) < length[:, None]
    grid[mask] = np.frombuffer(b"".join(words), dtype=np.uint8)
    return grid.T, mask.T.astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights by name. Gates are in the order update, reset, candidate."""

    def __init__(self, langs: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        shape = {"embed": (256, EMBED), "out": (2 * HIDDEN, len(langs)), "bias": (len(langs),)}
        for d in "fb":
            shape |= {f"{d}x": (EMBED, 3 * HIDDEN), f"{d}h": (HIDDEN, 3 * HIDDEN), f"{d}b": (3 * HIDDEN,)}
        self.w = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shape.items()}

    def states(self, d: str, grid: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each step of one direction; with ``keep`` what its gradient needs."""
        w, steps = self.w, range(len(grid))
        table = w["embed"] @ w[f"{d}x"] + w[f"{d}b"]
        h, out, saved = np.zeros((grid.shape[1], HIDDEN), np.float32), np.empty((*grid.shape, HIDDEN), np.float32), []
        wh = w[f"{d}h"]
        for t in steps if d == "f" else reversed(steps):
            x = table[grid[t]]
            gates = sigmoid(x[:, : 2 * HIDDEN] + h @ wh[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ wh[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            new = h + m * z * (c - h)
            if keep:
                saved.append((t, h, z, r, c))
            h = out[t] = new
        return out, saved

    def evidence(self, d: str, grid: np.ndarray) -> np.ndarray:
        """What one direction says by step, piece and language; all pieces start at step 0."""
        w = self.w
        table, out = w["embed"] @ w[f"{d}x"] + w[f"{d}b"], w["out"][:HIDDEN] if d == "f" else w["out"][HIDDEN:]
        gate, candidate = (np.ascontiguousarray(x) for x in (w[f"{d}h"][:, : 2 * HIDDEN], w[f"{d}h"][:, 2 * HIDDEN :]))
        h, states = np.zeros((grid.shape[1], HIDDEN), np.float32), np.empty((*grid.shape, HIDDEN), np.float32)
        for t, row in enumerate(grid):
            x = table.take(row, axis=0)
            g = h @ gate
            g += x[:, : 2 * HIDDEN]
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            c = (g[:, HIDDEN:] * h) @ candidate
            c += x[:, 2 * HIDDEN :]
            np.tanh(c, out=c)
            c -= h
            c *= g[:, :HIDDEN]
            c += h
            h = states[t] = c
        return states @ out

    def positions(self, parts: list[bytes]) -> np.ndarray:
        """Probabilities by step, piece and language; what is behind a piece's end means nothing."""
        ahead, _ = padded(parts)
        back, _ = padded([p[::-1] for p in parts])
        steps, size = np.arange(len(ahead))[:, None], np.array([len(p) for p in parts])
        turned = self.evidence("b", back)[np.maximum(size - 1 - steps, 0), np.arange(len(parts))]
        return softmax(self.evidence("f", ahead) + turned + self.w["bias"])

    def gradient(self, grid: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the positions and its gradient, back through time."""
        w = self.w
        g = {k: np.zeros_like(v) for k, v in w.items()}
        runs = {d: self.states(d, grid, mask, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = softmax(both @ w["out"] + w["bias"])
        n = mask.sum()
        rows = np.arange(len(y))
        loss = float(-(np.log(p[:, rows, y] + 1e-9) * mask).sum() / n)
        p[:, rows, y] -= 1
        p *= (mask / n)[:, :, None]
        g["out"] = both.reshape(-1, 2 * HIDDEN).T @ p.reshape(-1, p.shape[2])
        g["bias"] = p.sum((0, 1))
        back = p @ w["out"].T
        for d, at in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            wh, carry = w[f"{d}h"], np.zeros((len(y), HIDDEN), np.float32)
            gx = np.zeros((256, 3 * HIDDEN), np.float32)
            for t, h, z, r, c in reversed(runs[d][1]):
                m = mask[t][:, None]
                dh = back[t][:, at] + carry
                dc = dh * m * z * (1 - c * c)
                dz = dh * m * (c - h) * z * (1 - z)
                drh = dc @ wh[:, 2 * HIDDEN :].T
                dr = drh * h * r * (1 - r)
                gates = np.concatenate([dz, dr], axis=1)
                g[f"{d}h"][:, : 2 * HIDDEN] += h.T @ gates
                g[f"{d}h"][:, 2 * HIDDEN :] += (r * h).T @ dc
                np.add.at(gx, grid[t], np.concatenate([gates, dc], axis=1))
                carry = dh * (1 - m * z) + drh * r + gates @ wh[:, : 2 * HIDDEN].T
            g[f"{d}b"] = gx.sum(0)
            g[f"{d}x"] = w["embed"].T @ gx
            g["embed"] += gx @ w[f"{d}x"].T
        return loss, g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(np.clip(x, -60, 25))
    e /= e.sum(-1, keepdims=True)
    return e


def train(samples: list[tuple[bytes, str]], steps: int = 120, size: int = 192, rate: float = 0.03, seed: int = 7) -> Network | None:
    """A network from (bytes, language) pairs, each language drawn equally often (Adam)."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    net, rng = Network(langs, seed), np.random.default_rng(seed)
    by_lang = {x: [] for x in langs}
    for raw, lang in samples:
        by_lang[lang].append(raw)
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(len(langs), size=size)
        drawn = [(own := by_lang[langs[k]])[int(u * len(own))] for k, u in zip(y, rng.random(size), strict=True)]
        _, g = net.gradient(*padded(drawn), y)
        pace = rate * min(1, step / 30) * (1 - 0.9 * step / steps)
        for k, v in g.items():
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            net.w[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def predict(net: Network, texts: list[str | None]) -> Iterator[tuple[str, float]]:
    """(language, mean probability) of each text."""
    raws = [plain(t) if t and has_letter(t) else b"" for t in texts]
    cut = [(i, k, max(0, k - WARM), min(len(raw), k + PIECE + WARM)) for i, raw in enumerate(raws) for k in range(0, len(raw), PIECE)]
    cut.sort(key=lambda c: c[3] - c[2])
    total = np.zeros((len(raws), len(net.langs)))
    lanes = max(16, min(LANES, 16 * LANES // len(net.langs)))  # memory holds a number for each language and position
    for n in range(0, len(cut), lanes):
        part = cut[n : n + lanes]
        p = net.positions([raws[i][lo:hi] for i, _, lo, hi in part])
        i, k, lo, _ = (np.array(x) for x in zip(*part, strict=True))
        size = np.minimum([len(raws[j]) - x for j, x in zip(i, k, strict=True)], PIECE)
        steps = np.arange(len(p))[:, None] - (k - lo)
        p *= ((steps >= 0) & (steps < size))[:, :, None]
        np.add.at(total, i, p.sum(0))
    for raw, sums in zip(raws, total, strict=True):
        if raw:
            yield net.langs[int(sums.argmax())], min(1.0, float(sums.max() / len(raw)))
        else:
            yield "und", 0.0


def sample(docs: DataFrame, max_docs: int, max_langs: int, max_parts: int) -> list[tuple[bytes, str]]:
    """(bytes, lang) of the documents to learn from."""
    key = F.col("doc_id").cast("string")
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(key) % 4 != 2))
    sizes = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not sizes:
        return []
    each, cells = max(1, max_docs // len(sizes)), 1 << 40
    # A bound on the hash leaves some times as many as wanted, whatever a language's share of the rows.
    shares = docs.sparkSession.createDataFrame([(r.lang, int(cells * min(1.0, (4 * each + 16) / r["count"]))) for r in sizes], "lang string, share long")
    h = F.pmod(F.xxhash64(key), F.lit(cells))
    thin = own.select("lang", "text", h.alias("h"), F.xxhash64("text").alias("th")).join(F.broadcast(shares), "lang").filter("h < share")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "th"))
    chosen = thin.withColumn("nth", nth).filter(F.col("nth") <= each).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(p, lang) for text, lang in zip(*[c.to_pylist() for c in batch.columns], strict=True) if has_letter(text) for p in stretches(plain(text), max_parts)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.string())], names=["part", "lang"])

    return sorted((bytes(r.part), r.lang) for r in chosen.mapInArrow(run, "part binary, lang string").collect())


def identify(docs: DataFrame, max_docs: int = MAX_DOCS, max_langs: int = MAX_LANGS, max_parts: int = MAX_PARTS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    net = train(sample(docs, max_docs, max_langs, max_parts))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4096, 4 << 20):
                texts = part.column(1).to_pylist()
                rows = list(predict(net, texts)) if net else [("und", 0.0)] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
