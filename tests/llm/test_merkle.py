import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.llm import merkle
from strandline.llm.oracles import ORACLES
from strandline.llm.queries import QUERIES


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout=2):
    """The root and, for each node, the (before, after) texts on its way up."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, path in enumerate(paths):
            first = at[i] // fanout * fanout
            run = level[first : first + fanout]
            path.append(("".join(run[: at[i] - first]), "".join(run[at[i] - first + 1 :])))
            at[i] //= fanout
        level = [sha(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows, fanout=2):
    leaves = {}
    for doc_id, text, lang, source, n in rows:
        own = sha(field(doc_id), field(source), field(lang), field(n), field(text))
        touched = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
        shown = sha(field(doc_id), field(source), field(lang), field(n + 1), field(text)) if touched else own
        leaves.setdefault(lang, []).append((-(1 << 70) if doc_id is None else doc_id, own, doc_id, shown))
    langs = sorted(leaves, key=lambda x: b"" if x is None else b"+" + x.encode())
    trees = {x: climb([r[1] for r in sorted(leaves[x], key=lambda r: r[:2])], fanout) for x in langs}
    root, tops = climb([trees[x][0] for x in langs], fanout)
    out = []
    for x, top in zip(langs, tops, strict=True):
        for r, path in zip(sorted(leaves[x], key=lambda r: r[:2]), trees[x][1], strict=True):
            folded = r[3]
            for before, after in path + top:
                folded = sha(before, folded, after)
            out.append((r[2], r[1], trees[x][0], root, sha(*[b + a for b, a in path + top]), folded, folded == root))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def test_sql(spark, sf_dir, same_rows):
    same_rows(QUERIES["op12_merkle_manifest"](spark, sf_dir), ORACLES["op12_merkle_manifest"])


def test_sql_is_as_brute_force(duck, sf_dir):
    """The SQL and the plain Python that the other tests use agree on the table."""
    rows = duck.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    found = Counter(duck.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({ORACLES['op12_merkle_manifest']})").fetchall())
    assert found == brute(rows) and {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 4), (3, 2)])
def test_awkward(awkward, rows, fanout, levels):
    assert result(merkle.report(awkward, fanout, levels)) == brute(rows, fanout)


def test_sizes(spark):
    """Group sizes around the widths of blocks, many groups, ids out of order."""
    rows = [(i * 7919 % 10_007, f"t{i}", f"g{g:02}", "s", i) for g, n in enumerate([1, 2, 3, 15, 16, 17, 31, 33, 255, 256, 257, *[1] * 30]) for i in range(g * 1000, g * 1000 + n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert result(merkle.report(df)) == brute(rows)


def test_empty(nothing):
    found = merkle.report(nothing)
    assert found.count() == 0
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert merkle.manifest(nothing.select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), F.col("text").alias("leaf"))).root is None


def test_groups_and_clashing_names(spark):
    rows = [(1, "a" * 64, "x", 5), (2, "b" * 64, "x", 6), (3, "c" * 64, None, 7)]
    made = merkle.manifest(spark.createDataFrame(rows, "id long, leaf string, group string, _g int"))
    assert {(r.group, r.n_rows, r.subroot) for r in made.groups.collect()} == {("x", 2, sha("a" * 64, "b" * 64)), (None, 1, "c" * 64)}
    assert made.root == sha("c" * 64, sha("a" * 64, "b" * 64))
    assert sorted((r.id, r._g) for r in made.rows.collect()) == [(1, 5), (2, 6), (3, 7)]


def test_null_count_is_not_touched(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 0]
    df = spark.createDataFrame([(i, "t", "en", None, None if k % 2 else (1 << 63) - 1) for k, i in enumerate(ids)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r.doc_id, r.verified) for r in merkle.report(df).collect()} == {(i, bool(k % 2)) for k, i in enumerate(ids)}
