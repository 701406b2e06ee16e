import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandline.llm import bpe
from strandline.llm.queries import QUERIES, vocabulary_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(vocabulary_path())


def theirs(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = QUERIES["op10_bpe"](spark, sf_dir).collect()
    assert Counter(tuple(r) for r in found) == Counter((d.doc_id, *theirs(library, d.text)) for d in docs)


def test_random_texts(library, vocabulary):
    rng = random.Random(1)
    letters = "abcthe 'sΣÉİ é \x1c\x85　<|endoftext|>12½漢字'll—ß  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(1000)]
    texts += ["", "a" * 1000, "<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "the" * 3000]
    for text, (ids, decoded) in zip(texts, bpe.Encoder(vocabulary).encode(texts), strict=True):
        real = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == real
        assert decoded == library.decode(real, skip_special_tokens=False)


def test_both_trees_agree(vocabulary):
    rng = random.Random(2)
    words = [bytes(rng.choice(b"ethanrio") for _ in range(rng.randint(2, 60))) for _ in range(300)]
    for word, ids in zip(words, bpe.encode_words(vocabulary, words), strict=True):
        assert ids.tolist() == bpe.merge_long(vocabulary, word).tolist()


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    texts = ["one two three", "two three four", "five"]
    once = list(bpe.Encoder(vocabulary).encode(texts))
    monkeypatch.setattr(bpe, "CACHE", 1)
    e = bpe.Encoder(vocabulary)
    assert [x for t in texts for x in e.encode([t])] == once


def test_awkward(awkward, nothing, rows, library):
    found = bpe.encode(awkward, vocabulary_path(), keep_ids=True).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == Counter((r[0], *theirs(library, r[1])) for r in rows)
    assert all(len(r.ids) == r.n_tokens for r in found)
    assert bpe.encode(nothing, vocabulary_path()).count() == 0
