"""Words of a corpus grouped with their spelling variants, by an index of variable-length grams.

1. Gram dictionary: grams of two symbols over the padded words; one that more than
   ``frequent`` words hold is extended, up to four symbols. So a gram shorter than
   four is in few words. The frequent grams are bounded by the alphabet (90 letters
   and two pads: at most 92 ** 2 + 92 ** 3) and go to the tasks as a set.
2. Decomposition: at each place the shortest gram of the dictionary that isn't
   frequent, or the longest there is; grams that lie inside an earlier one are left out.
3. Affected grams: an edit of symbol i changes the grams that hold i, and may hide
   those after i that end within four symbols of it; no others, as a gram depends on
   nothing beyond its own symbols. A word's bound is its grams less the most that
   any edit affects. Words of six letters have eight symbols, so their first gram or
   their last one survives any edit and the bound is never below one.
4. Lists: a gram before the edit stays with all that stands before it, a gram after
   it with all that stands after it. So a word is listed twice a gram, under the
   hash of the word up to the gram's end and of the word from its start on. Lists of
   more than ``most`` words are split by what is left of the word with one symbol
   deleted or none, which near words share: no list gives more than
   ``most`` pairs a word but those split ones, which the alphabet bounds.
5. Merging: pairs that meet in at least as many lists as both bounds ask for are
   compared symbol by symbol.

Words are counted with partial sums, so a frequent word moves one row a task.
Nulls: a null text has no words; a null id counts as empty in the hash that deletes
letters. Ties of forms: the smallest in code-point order. Repeated rows count as often
as they are there. Words of any length are handled, in time linear in it up to the
comparison. An empty table has no words. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

LETTERS = "[a-zÀ-ÿ]++"
FIRST, LAST = "^", "$"
SHORTEST, LONGEST = 2, 4
LEAST_LENGTH = 2 * LONGEST - 2
#: An odd number: hashes are polynomials modulo 2 ** 64. Collisions cost a comparison, no result.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def noisy_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199) -> DataFrame:
    """(word) of each run of letters that may be long enough; where ``every`` divides the run's hash a letter goes."""
    run = F.col("run")
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.filter(F.char_length(run) >= LEAST_LENGTH).select("run", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), run)).alias("h"))
    at = (F.col("h") % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return runs.select(F.when(F.col("h") % every == 0, cut).otherwise(run).alias("word"))


def vocabulary(words: DataFrame, least: int = 5) -> DataFrame:
    """(word, n, w) of the words that occur often enough; ``w`` is a number of its own."""
    counted = words.filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return stored(counted.withColumn("w", F.monotonically_increasing_id()), "vocabulary")


def frequent_grams(words: DataFrame, frequent: int) -> set[str]:
    """Grams shorter than the longest that more than ``frequent`` words hold; they are bounded by the alphabet."""
    padded = F.concat(F.lit(FIRST), F.col("word"), F.lit(LAST))
    grams = F.concat(*[_grams(padded, q) for q in range(SHORTEST, LONGEST)])
    each = words.select(F.explode(F.array_distinct(grams)).alias("gram"))
    return {r.gram for r in each.groupBy("gram").count().filter(F.col("count") > frequent).select("gram").collect()}


def _grams(text: Column, q: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(text) - q + 1), lambda p: F.substring(text, p, F.lit(q)))


def grams_of(padded: str, frequent: set[str]) -> list[tuple[int, int]]:
    """(start, end) of the grams of a padded word, none inside an earlier one."""
    kept, reach, n = [], 0, len(padded)
    for p in range(n - SHORTEST + 1):
        e = p + SHORTEST
        while e < n and e - p < LONGEST and padded[p:e] in frequent:
            e += 1
        if e > reach:
            kept.append((p, e))
            reach = e
    return kept


def surviving(grams: list[tuple[int, int]], n: int) -> int:
    """At least so many grams of a padded word of ``n`` symbols survive any one edit."""
    affected = np.zeros(n + 1, np.int64)
    for _, e in grams:
        # An edit of its own symbols changes a gram; one of those before it, from e - LONGEST on, may hide it.
        affected[max(0, e - LONGEST)] += 1
        affected[e] -= 1
    return len(grams) - int(np.cumsum(affected)[: n - 1].max())


def _mixed(h: np.ndarray, side: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(side)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _sums(symbols: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... symbols."""
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(0, len(symbols) - 1), BASE, np.uint64)]))[: len(symbols)]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers)])


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def list_keys(padded: str, grams: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word up to each gram's end and from each gram's start."""
    symbols = _symbols(padded)
    ahead, behind = _sums(symbols), _sums(symbols[::-1])
    starts, ends = (np.array(x) for x in zip(*grams, strict=True))
    return _mixed(ahead[ends], 1), _mixed(behind[len(symbols) - starts], 2)


def deletions(rest: str) -> np.ndarray:
    """Hashes of ``rest`` and of all it becomes by deleting a symbol."""
    sums = _sums(_symbols(rest))
    gone = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(BACK)
    return np.unique(np.append(gone, sums[-1]))


def _posting_rows(frequent: set[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, bound, size, keys, cuts = [], [], [], [], []
            for word, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                padded = FIRST + word + LAST
                grams = grams_of(padded, frequent)
                ahead, behind = list_keys(padded, grams)
                n = 2 * len(grams)
                w += [own] * n
                bound += [surviving(grams, len(padded))] * n
                size += [len(word)] * n
                keys += [ahead, behind]
                cuts += [e for _, e in grams] + [-p for p, _ in grams]
            columns = [pa.array(w, pa.int64()), pa.array(bound, pa.int32()), pa.array(size, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)), pa.array(cuts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["w", "bound", "size", "key", "cut"])

    return run


def _split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of long lists, dealt by what is left of the word; ``cut`` is the end of the shared part or, not above 0, its start."""
    for batch in batches:
        names = batch.schema.names
        words, keys, cuts = (batch.column(names.index(c)).to_pylist() for c in ("word", "key", "cut"))
        parts = [deletions((FIRST + x + LAST)[c:] if c > 0 else (FIRST + x + LAST)[:-c]) for x, c in zip(words, cuts, strict=True)]
        sizes = [len(p) for p in parts]
        at = np.repeat(np.arange(len(parts)), sizes)
        own = np.array(keys, np.int64).view(np.uint64)[at]
        part = _mixed(np.concatenate([np.zeros(0, np.uint64), *parts]) * np.uint64(3) + own, 3)
        columns = [batch.column(names.index(c)).take(pa.array(at)) for c in ("w", "bound", "size", "key")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(part.view(np.int64))], names=["w", "bound", "size", "key", "part"])


def near_pairs(words: DataFrame, frequent: int = 50, most: int = 50) -> DataFrame:
    """(a, b), numbers of words that differ by one symbol, each pair once; ``words`` are (word, w) of six letters or more."""
    spark = words.sparkSession
    grams = spark.sparkContext.broadcast(frequent_grams(words, frequent))
    rows = lambda batches: _posting_rows(grams.value)(batches)
    postings = stored(words.select("word", "w").mapInArrow(rows, "w long, bound int, size int, key long, cut int"), "postings")
    sizes = postings.groupBy("key").agg(F.count("*").alias("listed")).filter("listed > 1")
    listed = stored(postings.join(sizes, "key"), "lists")
    short = listed.filter(F.col("listed") <= most).select("w", "bound", "size", "key", F.col("key").alias("part"))
    long = listed.filter(F.col("listed") > most).join(words.select("word", "w"), "w").select("word", "w", "bound", "size", "key", "cut")
    split = long.mapInArrow(_split_rows, "w long, bound int, size int, key long, part long")
    lists = stored(short.unionAll(split), "parts")
    a, b = lists.alias("a"), lists.alias("b")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.w") < F.col("b.w")) & (F.abs(F.col("a.size") - F.col("b.size")) <= 1)
    pairs = a.join(b, met).select(F.col("a.w").alias("a"), F.col("b.w").alias("b"), F.col("a.key").alias("key"), F.greatest("a.bound", "b.bound").alias("bound"))
    merged = pairs.groupBy("a", "b").agg(F.countDistinct("key").alias("shared"), F.max("bound").alias("bound")).filter("shared >= bound")
    named = merged.join(words.select(F.col("w").alias("a"), F.col("word").alias("x")), "a").join(words.select(F.col("w").alias("b"), F.col("word").alias("y")), "b")
    return named.filter(F.levenshtein("x", "y", 1) == 1).select("a", "b")


def _roots(forms: DataFrame, most: int, times: int) -> DataFrame:
    """(word, root) from (word, form), by doubling: a form is ``times`` as frequent as its word, so ``most`` bounds the steps."""
    steps, n = 0, 1
    while n * times <= most:
        steps, n = steps + 1, n * times
    roots, reach = stored(forms.select("word", F.col("form").alias("root")), "roots"), 1
    while reach < steps:
        further = roots.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        roots = stored(roots.join(further, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_on", "root").alias("root")), "roots")
        reach *= 2
    return roots


def variants(words: DataFrame, times: int = 5, frequent: int = 50, most: int = 50) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of ``words`` (word, n, w)."""
    pairs = stored(near_pairs(words, frequent, most), "near")
    both = pairs.select("a", "b").unionAll(pairs.select(F.col("b"), F.col("a")))
    other = words.select(F.col("w").alias("b"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")).alias("other"))
    best = both.join(other, "b").groupBy(F.col("a").alias("w")).agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    joined = words.join(best, "w", "left")
    enough = -F.col("best.less") >= times * F.col("n")
    named = stored(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms"
    )
    largest = named.agg(F.max("n")).first()[0] or 0
    roots = _roots(named.filter("form is not null"), largest, times)
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame, every: int = 199, least: int = 5, times: int = 5, frequent: int = 50, most: int = 50) -> DataFrame:
    """Spelling variants of the words of ``docs``, after letters are deleted by hash."""
    return variants(vocabulary(noisy_runs(docs, every=every), least), times, frequent, most)
