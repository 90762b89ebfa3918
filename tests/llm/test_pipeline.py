"""The pipeline against a brute-force version of its later stages, and what each stage must catch or leave alone."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(2000)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, leak = prose(60), prose(30)
    texts = [prose(200) for _ in range(30)]
    texts += [texts[0], texts[1].replace(texts[1].split()[100], "changed", 1)]  # 30, 31: an exact and a near copy
    texts += [f"{prose(100)} {passage} {prose(100)}" for _ in range(2)]  # 32, 33 share a passage
    texts += [f"{prose(100)} {leak} {prose(50)}", "short text", None, "spam " * 100]  # 34: a benchmark passage; 35 to 37: rejected
    folder = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), texts, passage


def test_run(spark, corpus):
    from tokenizers import Tokenizer

    from palimpsest.llm.queries import tokenizer_path

    folder, texts, passage = corpus
    left = {i: t for i, t in enumerate(texts) if i not in (35, 36, 37)}  # few labels: no learnt rule, so the base alone rejects
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for i, t in left.items()}
    firsts = [i for i in left if not any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in left)]  # components are pairs at most here
    assert set(left) - set(firsts) == {30, 31}
    left = {i: left[i] for i in firsts}
    counts = Counter(tuple(t.split()[j : j + 35]) for t in left.values() for j in range(len(t.split()) - 34))
    want = {}
    library = Tokenizer.from_file(tokenizer_path())
    for i, t in left.items():
        w = t.split()
        if i == 34:
            continue  # contaminated
        gone = {j + k for j in range(len(w) - 34) if counts[tuple(w[j : j + 35])] > 1 for k in range(35)}
        ids = library.encode(" ".join(x for j, x in enumerate(w) if j not in gone), add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in out} == want
    assert all(len(r.token_ids) == r.n_tokens for r in out)


def test_stages_keep_columns(spark, corpus):
    folder, texts, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    kept = {r.doc_id: r for r in corpus_pipeline.shared_passages(spark, docs, folder).collect()}
    assert len(kept) == len(texts) and passage not in kept[32].text and kept[32].n_chars == len(kept[32].text) and kept[5].text == texts[5]
    assert 34 not in {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, folder).collect()}


def test_stages_on_an_empty_table(spark, corpus):
    """Every stage passes on an empty table, and one whose texts are null or empty, with extra columns."""
    folder, texts, passage = corpus
    none = spark.read.parquet(f"{folder}/documents.parquet").withColumn("k1", F.lit("x")).limit(0)
    hollow = spark.createDataFrame([(1, None, None, "a", 0, "x"), (2, "", "en", "a", 0, "y"), (2, "", "en", "a", 0, "y")], none.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
        assert stage(spark, hollow, folder).count() == {"quality": 0, "near_dedup": 1}.get(name, 3), name


def test_registered_as_a_query():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
