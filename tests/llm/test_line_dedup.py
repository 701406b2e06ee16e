import hashlib
import random
from collections import Counter

import pytest

from strandline.llm import line_dedup
from strandline.llm.oracles import ORACLES
from strandline.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "This line is long enough to be a key of its own, "


def brute(rows, least_chars=40, least_docs=5):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    order = lambda i: (i is not None, i or 0)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or max(holders[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def digests(found):
    return Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in found)


def result(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


def test_query(spark, sf_dir, same_rows):
    same_rows(QUERIES["op13_line_dedup"](spark, sf_dir), ORACLES["op13_line_dedup"])


def test_awkward(spark, awkward, nothing, rows):
    assert result(line_dedup.report(awkward)) == digests(brute([(r[0], r[1]) for r in rows]))
    assert result(line_dedup.report(awkward, 5, 2)) == digests(brute([(r[0], r[1]) for r in rows], 5, 2))
    assert line_dedup.report(nothing).count() == 0
    left = line_dedup.drop_lines(awkward, least_chars=5, least_docs=2)
    assert left.columns == awkward.columns
    want = Counter((i, t if rows[k][1] is not None else None) for k, (i, _, _, t) in enumerate(brute([(r[0], r[1]) for r in rows], 5, 2)))
    assert Counter((r.doc_id, r.text) for r in left.collect()) == want


def many(seed, n):
    """Lines that no, few and nearly all documents share, repeats inside a document, null and repeated ids."""
    rng = random.Random(seed)
    pool = [LONG + f"number {k}" for k in range(40)] + ["short", "", "\t" + LONG.upper() + "number 1 \r", LONG + "é" * 5]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) for _ in range(rng.randrange(6))] + ([LONG + "of almost all"] * rng.randrange(1, 4) if rng.random() < 0.8 else [])
        if rng.random() < 0.5:
            lines.append(LONG + f"of document {i} alone")
        rng.shuffle(lines)
        rows.append((i if rng.random() < 0.95 else rng.choice([None, 3]), "\n".join(lines) if rng.random() < 0.97 else None))
    return rows


@pytest.mark.parametrize(("ranges", "batch"), [("1", "10000"), ("7", "3"), ("64", "50")])
def test_many(spark, ranges, batch):
    """Hashes within a batch, over batches and over ranges."""
    rows = many(int(ranges), 600)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    settings = {"spark.sql.shuffle.partitions": ranges, "spark.sql.execution.arrow.maxRecordsPerBatch": batch, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for least in (2, 5, 400):
            assert result(line_dedup.report(df, least_docs=least)) == digests(brute(rows, least_docs=least))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bitmaps(spark):
    text = "\n".join(["a", LONG, "b", LONG])
    df = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    found = {r.doc: r for r in line_dedup.keep_bitmaps(df).collect()}
    assert sorted(found) == [0, 1, 2, 3, 4]
    import zlib

    assert {zlib.decompress(r.keep) for r in found.values()} == {bytes([0b10100000])}
    assert {(r.n_lines, r.n_dropped) for r in found.values()} == {(4, 2)}


def test_one_line_in_all(spark):
    """One line that every document holds is spread over ranges."""
    rows = [(i, LONG + f"\n{i}") for i in range(3000)]
    assert result(line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"))) == digests(brute(rows))
