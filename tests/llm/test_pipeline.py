from collections import Counter

import corpus_pipeline
from strandline.llm import toxicity
from strandline.llm.queries import vocabulary_path

from .test_bpe import theirs
from .test_decontaminate import brute as contaminated
from .test_ngram_join import brute as near


def test_pipeline(spark, tmp_path):
    """run() against the stages done one after another in plain Python."""
    from tokenizers import Tokenizer

    clean = [(k, f"clean text number {k} with its own words a{k} b{k} c{k} d{k} e{k}") for k in range(30)]
    toxic = [(100 + k, f"you utter blockhead{'' if k % 2 else 's'} of a thing, blockhead {k} f{k} g{k}. Blockhead indeed h{k}") for k in range(30)]
    long = [f"m{k}" for k in range(60)]
    copies = [(200, clean[3][1]), (201, clean[3][1]), (202, " ".join(long)), (203, " ".join([*long[:59], "zz"])), (204, None), (205, None)]
    leaked = [(300, "before it " + " ".join(f"q{k}" for k in range(15)) + " after it")]
    docs = clean + toxic + copies + leaked
    labels = [(i, 1, int(100 <= i < 200)) for i, _ in clean + toxic]
    items = [(1, " ".join(f"q{k}" for k in range(12)))]
    for name, rows, schema in (("documents", [(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    grammar = toxicity.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [(i, t) for i, t in docs if grammar.score(t or "")[0] < 0.5]
    assert {i for i, _ in kept} == {i for i, _ in docs if not 100 <= i < 200}
    last = {}
    for i, t in kept:
        last[t or ""] = max(last.get(t or "", i), i)
    kept = [(i, t) for i, t in kept if last[t or ""] == i]
    first = {r[0]: r[1] for r in near(kept)}
    kept = [(i, t) for i, t in kept if first[i] == i]
    kept = [(i, t) for i, t in kept if not contaminated(t, items)[-1]]
    assert {i for i, _ in kept} == {i for i, _ in clean} - {3} | {201, 202, 205}
    library = Tokenizer.from_file(vocabulary_path())
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(tuple(r) for r in found.collect()) == Counter((i, *theirs(library, t)) for i, t in kept)


def test_stages_keep_columns(awkward, spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, awkward, str(tmp_path)).columns == awkward.columns, name


def _folder(spark, at, docs):
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "word " * 12)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_empty_table(spark, nothing, tmp_path):
    found = corpus_pipeline.run(spark, _folder(spark, tmp_path, nothing))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and found.count() == 0


def test_nulls_and_repeated_rows(spark, awkward, tmp_path):
    """Null ids and texts, repeated rows, a very long text that a benchmark item is in, and clashing columns go through all stages."""
    found = corpus_pipeline.run(spark, _folder(spark, tmp_path, awkward.unionAll(awkward)))
    assert Counter(r.doc_id for r in found.collect()) == Counter([2, 5, 6, None, 9, 10])
