"""Toxicity by a weighted finite-state grammar over clauses.

Transducers are composed. The first maps words to symbols: insults (with a
learned weight), threats, intent, targets, negation and reported speech. Five
small machines then read the symbols of one clause side by side: insult, threat,
target, negation and reported speech. Where the clause ends, their joint state
says what the clause is as a whole: a threat, an insult aimed at somebody, several
insults, a plain one, or one that is negated or reported. A clause counts once,
with the weight of its strongest insult, however many words it has. The last
transducer adds the clauses of a document by kind, and a logistic model turns the
sums into a score; words have no say but through clauses.

What a kind can do is fixed, how much is learned. Aimed, several and threatening
clauses raise the score; of plain ones only those after the first do, as a single
word aimed at nobody may be used of a thing; negated and reported clauses never
raise it. A ridge pulls the weights to ``PRIOR``, so a kind that no labelled text
has counts as stated there and not as nothing. The density is per token over
``SHORT`` tokens more than there are, so that a short text isn't dense by being short.

Which words are insults is learned from labelled rows: at most ``max_labelled``
texts serve (those with the smallest hashes), a third of them only to confirm. A
word enters the grammar if its log likelihood ratio on the others is at least
``evidence`` and most of its confirming uses are toxic; a beginning, of five to eight
letters, must also cover three insults or more and add to each of them. Of a text, three uses count.

Nulls: a null text is empty and is scored like one. Null ids are never learned
from and count as held out; null labels and labels other than 0 and 1 aren't
learned. Of several labels of one document or text the largest counts. Repeated
rows give repeated results; with no labels the grammar has its fixed words only.
An empty table gives an empty one. Very long texts are read whole. Only the id
and text columns are read by :func:`score`; further columns, whatever their
names, change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, released

MAX_LABELLED = 12_000
EVIDENCE = 12.0
PREFIXES = range(5, 9)
#: Uses of a feature that count in one text.
USES = 3
#: Tokens added to a text's own when clauses are set against them.
SHORT = 100
# Small closed classes of the grammar.
TARGET = {"you", "your", "yours", "u", "he", "she", "him", "her", "they", "them", "their", "du", "dich", "dir", "ihr", "sie", "tu", "te", "toi", "vous", "tú", "ti", "usted", "ustedes"}
NEGATION = {"not", "never", "no", "nobody", "isn't", "aren't", "don't", "wasn't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "ni"}
REPORT = {"said", "says", "wrote", "reported", "quoted", "claimed", "alleged", "called", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"}
INTENT = {"will", "gonna", "going", "i'll", "we'll", "shall", "werde", "vais", "voy"}
THREAT = {"kill", "hurt", "destroy", "murder", "beat", "shoot", "stab", "burn", "hang", "töten", "schlagen", "tuer", "frapper", "matar", "golpear"}
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n]")
EVENTS = ("plain", "several", "targeted", "negated", "reported", "threat")
#: Weights before any text is seen, of the sums in the order of EVENTS, of the density, and of nothing at all.
PRIOR = (8.0, 8.0, 8.0, 0.0, 0.0, 8.0, 0.0, -3.0)
#: What may raise (1) or only lower (-1) the score, in the same order; the last is free.
SIGNS = (1, 1, 1, -1, -1, 1, 1, 0)
FEATURES = len(EVENTS) + 1
START = (0, 0, 0, 0, 0)


def insult(state: int, symbol: str) -> int:
    """0, 1 or 2 and more insults so far."""
    return min(2, state + 1) if symbol == "INSULT" else state


def threat(state: int, symbol: str) -> int:
    """1 after a word of intent, 2 after a threat that follows it, 3 once somebody is named after that."""
    if symbol == "INTENT":
        return max(1, state)
    if symbol == "THREAT":
        return max(2, state) if state else 0
    return 3 if symbol == "TARGET" and state >= 2 else state


def target(state: int, symbol: str) -> int:
    """1 once somebody is meant."""
    return 1 if symbol == "TARGET" else state


def negation(state: int, symbol: str) -> int:
    """1 after a negation, 2 if it covers what follows, 3 if something stood before any negation."""
    if symbol == "NEGATION":
        return max(1, state)
    if symbol in ("INSULT", "THREAT"):
        return (3, 2, 2, 3)[state]
    return state


def report(state: int, symbol: str) -> int:
    """1 once the clause is somebody's words."""
    return 1 if symbol == "REPORT" else state


MACHINES = (insult, threat, target, negation, report)


def outcome(state: tuple[int, ...]) -> str | None:
    """What a clause is, from the joint state at its end."""
    insults, threats, targets, negations, reports = state
    if not insults and threats < 3:
        return None
    if reports:
        return "reported"
    if negations == 2:
        return "negated"
    if threats == 3:
        return "threat"
    return "targeted" if targets else "several" if insults == 2 else "plain"


class Composed(dict):
    """The product of the machines: (joint state, symbol) -> joint state, made as it is met."""

    def __missing__(self, key: tuple[tuple[int, ...], str]) -> tuple[int, ...]:
        state, symbol = key
        self[key] = out = tuple(m(x, symbol) for m, x in zip(MACHINES, state, strict=True))
        return out


def fixed_symbols() -> dict[str, str]:
    classes = (("TARGET", TARGET), ("NEGATION", NEGATION), ("REPORT", REPORT), ("INTENT", INTENT), ("THREAT", THREAT))
    return {w: s for s, words in classes for w in words} | dict.fromkeys(".!?;\n", "END")


def features(word: str) -> list[str]:
    """The whole word, and its beginnings marked with a star."""
    return [word, *[word[:k] + "*" for k in PREFIXES if k < len(word)]]


@dataclass
class Grammar:
    """The composed transducers: words to symbols to clause events to features."""

    lexicon: dict[str, float]
    weights: list[float]

    def __post_init__(self) -> None:
        self.symbols = fixed_symbols()
        self.arcs = Composed()
        self.words: dict[str, tuple[str, float] | None] = {}

    def symbol(self, word: str) -> tuple[str, float] | None:
        """First transducer: the symbol of a word and its weight."""
        if word in self.symbols:
            return self.symbols[word], 1.0
        if best := max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0):
            return "INSULT", best
        return None

    def clauses(self, text: str) -> tuple[dict[str, float], int, int]:
        """Summed weights of the matched clauses by kind, how many matched, and the tokens."""
        sums = dict.fromkeys(EVENTS, 0.0)
        tokens = TOKEN.findall(text.lower())
        known, arcs, state, most, matched = self.words, self.arcs, START, 0.0, 0
        if len(known) > 150_000:
            known.clear()
        for w in [*tokens, "."]:
            if w in known:
                s = known[w]
            else:
                s = known[w] = self.symbol(w)
            if s is None:
                continue
            if s[0] != "END":
                state = arcs[state, s[0]]
                if s[0] in ("INSULT", "THREAT"):
                    most = max(most, s[1])
            elif state is not START:
                if event := outcome(state):
                    sums[event] += most
                    matched += 1
                state, most = START, 0.0
        return sums, matched, len(tokens)

    def measure(self, text: str) -> tuple[list[float], int]:
        """The features of a document: sums of its clauses by kind and their density; and how many matched."""
        sums, matched, n = self.clauses(text)
        sums["plain"] = max(0.0, sums["plain"] - 1)
        dense = 100 * sum(sums[e] for e in ("plain", "several", "targeted", "threat")) / (n + SHORT)
        return [*np.log1p(list(sums.values())), float(np.log1p(dense))], matched

    def score(self, text: str) -> tuple[float, int]:
        values, matched = self.measure(text)
        z = self.weights[-1] + sum(w * v for w, v in zip(self.weights, values, strict=False))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), matched


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, sweeps: int = 500) -> list[float]:
    """Weights of a logistic model, each within its sign, drawn to PRIOR by ``ridge``: Newton steps by coordinate."""
    x, prior = np.c_[x, np.ones(len(x))], np.array(PRIOR)
    w, z = prior.copy(), x @ prior
    for _ in range(sweeps):
        moved = 0.0
        for j, sign in enumerate(SIGNS):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            slope = x[:, j] @ (p - y) + ridge * (w[j] - prior[j])
            step = np.clip(slope / ((x[:, j] ** 2) @ (p * (1 - p)) + ridge), -2, 2)
            new = w[j] - step
            new = max(0.0, new) if sign > 0 else min(0.0, new) if sign < 0 else new
            z += x[:, j] * (new - w[j])
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < 1e-6:
            break
    return w.tolist()


def count_features(rows: DataFrame) -> DataFrame:
    """(f, words, p, n, p_more, n_more) from (text, y, more): uses in toxic and other texts, and in those that confirm.

    ``words`` are the distinct words of toxic texts under a beginning.
    """
    letters = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}++(?:['’]\p{L}++)?"), F.lit(0))
    used = rows.select("y", "more", F.col("th"), F.explode(letters).alias("w")).filter(F.char_length("w") > 2).groupBy("th", "y", "more", "w").agg(F.count("*").alias("uses"))
    stars = [F.when(F.char_length("w") > k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in PREFIXES]
    each = used.select("th", "y", "more", "w", "uses", F.explode(F.array_compact(F.array("w", *stars))).alias("f"))
    texts = each.groupBy("f", "th", "y", "more").agg(F.least(F.sum("uses"), F.lit(USES)).alias("uses"), F.collect_set(F.when(F.col("y") == 1, F.col("w"))).alias("ws"))
    sums = [F.sum(F.when(F.col("y") == y, F.col("uses")).otherwise(0)).alias(c) for y, c in ((1, "p"), (0, "n"))]
    more = [F.sum(F.when((F.col("y") == y) & F.col("more"), F.col("uses")).otherwise(0)).alias(f"{c}_more") for y, c in ((1, "p"), (0, "n"))]
    counted = texts.groupBy("f").agg(*sums, *more).filter(F.col("p") >= USES)
    held = texts.filter("y = 1").select("f", F.explode("ws").alias("w")).distinct().groupBy("f").agg(F.count("*").alias("words"))
    return counted.join(held, "f").select("f", "words", "p", "n", "p_more", "n_more")


def choose_lexicon(counted: DataFrame, bad: int, good: int, evidence: float) -> dict[str, float]:
    """Insults and their weights, from what :func:`count_features` gives and the numbers of toxic and other texts to learn from."""
    base = bad / (bad + good)
    p, n = F.col("p") - F.col("p_more"), F.col("n") - F.col("n_more")
    rate = (p + 0.1) / (p + n + 0.2)
    ratio = p * F.log(rate / base) + n * F.log((1 - rate) / (1 - base))
    confirmed = (F.col("p_more") > 0) & (F.col("p_more") >= F.col("n_more"))
    broad = ~F.col("f").endswith("*") | (F.col("words") >= 3)
    found = counted.filter((rate > 0.6) & (ratio >= evidence) & confirmed & broad).select("f", "p", "n").collect()
    uses = {r.f: (r.p, r.n) for r in found}
    out = {}
    for f, (a, b) in uses.items():
        best = max((uses[w][0] for w in uses if not w.endswith("*") and w.startswith(f[:-1])), default=0) if f.endswith("*") else 0
        if not f.endswith("*") or a > 1.2 * best:
            out[f] = float(np.clip(np.log((a + 0.5) / (b + 0.5) * good / bad) / 5, 0.05, 1))
    return out


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, evidence: float = EVIDENCE) -> Grammar:
    """The grammar learned from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    key = F.col("doc_id").cast("string")
    chosen = labels.filter(F.col("toxic").isin(0, 1) & (F.crc32(key) % 5 != 0)).select("doc_id", F.col("toxic").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = bounded(chosen, key, max_labelled)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("y").cast("int").alias("y"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    kept = rows.select("th").orderBy("th").limit(max_labelled)  # one id may have many texts
    rows = rows.join(F.broadcast(kept), "th", "left_semi").select("text", "y", "th", (F.pmod(F.xxhash64(F.lit("more"), "th"), F.lit(3)) == 0).alias("more")).persist()
    try:
        sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
        bad, good = sizes.get(1, 0), sizes.get(0, 0)
        if not bad or not good:
            return Grammar({}, list(PRIOR))
        grammar = Grammar(choose_lexicon(count_features(rows), bad, good, evidence), list(PRIOR))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = [grammar.measure(x.as_py())[0] for x in batch.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

        fitted = rows.select("text", "y").mapInArrow(run, "x array<double>, y int").collect()
        fitted.sort(key=lambda r: (r.x, r.y))
        grammar.weights = fit_logistic(np.array([r.x for r in fitted]), np.array([r.y for r in fitted], dtype=float))
        return grammar
    finally:
        rows.unpersist()


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_clauses): the score of each text and how many clauses matched."""
    id_type = docs.schema[id_col].dataType.simpleString()
    lexicon, weights = grammar.lexicon, grammar.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(lexicon, weights)
        for batch in batches:
            rows = [g.score(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64())], names=[id_col, "score", "n_clauses"])

    return docs.select(id_col, text_col).mapInArrow(released(run), f"`{id_col}` {id_type}, score double, n_clauses long")


def report_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_clauses)."""
    scored = score(docs, learn(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or more."""
    grammar = learn(docs, labels)
    lexicon, weights = grammar.lexicon, grammar.weights
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(lexicon, weights)
        for batch in batches:
            yield batch.filter(pa.array([g.score(x.as_py() or "")[0] < 0.5 for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
