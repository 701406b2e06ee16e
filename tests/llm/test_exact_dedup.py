import hashlib
from collections import Counter

from strandline.llm import exact_dedup
from strandline.llm.oracles import ORACLES
from strandline.llm.queries import QUERIES


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out, seen = [], Counter()
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        seen[i, t or ""] += 1
        out.append((i, keep, len(ids), i == keep and seen[i, t or ""] == 1, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_query(spark, sf_dir, same_rows):
    same_rows(QUERIES["op1_exact_dedup"](spark, sf_dir), ORACLES["op1_exact_dedup"])


def test_awkward(awkward, rows):
    plain = [(r[0], r[1]) for r in rows]
    assert result(exact_dedup.exact_dedup(awkward)) == brute(plain)
    # A filter that may not be broadcast sends all rows the shuffled way.
    assert result(exact_dedup.exact_dedup(awkward, max_filter_bytes=0)) == brute(plain)


def test_filter_of_repeated_hashes(spark, awkward, rows):
    """Where the filter of all rows is too large, one of the repeated hashes serves, and only suspects move."""
    many = [(i, f"t{i if i % 50 else 0}") for i in range(20_000)]
    docs = spark.createDataFrame(many, "doc_id long, text string")
    one_block = exact_dedup.BLOCK // 8 + 64
    found = exact_dedup.exact_dedup(docs, max_filter_bytes=one_block)
    assert result(found) == brute(many)
    assert "Union" in found._jdf.queryExecution().executedPlan().toString()  # the unsuspected pass by
    assert result(exact_dedup.exact_dedup(awkward, max_filter_bytes=one_block)) == brute([(r[0], r[1]) for r in rows])


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y")], "doc_id long, text string, Kept int, KEEP_ID string")
    found = exact_dedup.exact_dedup(docs)
    assert found.filter("kept").select("doc_id", "keep_id").collect() == [(2, 2)]
    names = ["_block", "_nth", "_sha", "_id", "_bits", "_c0", "_key", "_cold"]
    docs = spark.createDataFrame([(i, f"t{i % 3}", *range(i, i + len(names))) for i in range(9)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    found = exact_dedup.exact_dedup(docs)
    assert found.columns[2:10] == names
    assert {(r.doc_id, *(r[n] for n in names)) for r in found.collect()} == {(i, *range(i, i + len(names))) for i in range(9)}


def test_rows_without_id(spark):
    """A third of all rows have one text and no id: one of them stays, only where no id is known."""
    rows = [(None, "same")] * 2000 + [(None, "named")] * 50 + [(7, "named"), (7, "named"), (None, "")] + [(i, f"t{i}") for i in range(3000)]
    for most in (exact_dedup.MAX_BROADCAST_BYTES, 0):
        found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), max_filter_bytes=most)
        assert result(found) == brute(rows)


def test_stage(awkward, nothing, rows):
    kept = exact_dedup.drop_exact_copies(awkward)
    assert kept.columns == awkward.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter({(2, rows[0][1]): 1, (5, ""): 1, (6, "  \t\n "): 1, (None, "no id here"): 1, **{(r[0], r[1]): 1 for r in rows[9:]}})
    assert exact_dedup.drop_exact_copies(nothing).count() == 0


def test_many_copies(spark):
    rows = [(i, f"t{i if i % 3 else 0}") for i in range(4000)]
    found = result(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), drop_text=True))
    assert found == brute(rows)
