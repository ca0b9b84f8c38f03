import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from inboxsieve.llm.queries import tokenizer_path

from .conftest import SF, messy_rows, messy_table, prose, words
from .test_cube import targets
from .test_ngram import brute
from .test_pii import redacted


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents and what each stage makes of them, written and read."""
    folder, docs = tmp_path_factory.mktemp("stages"), messy_table(spark, messy_rows())
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_language_rejects_texts_without_letters(stages):
    want = sorted((i, t) for i, t, _, _ in messy_rows() if any(c.isalpha() for c in t or ""))
    assert sorted(rows(stages[1])) == want
    assert stages[1].where("lang IS NULL").count() == 0 and stages[1].columns == stages[0].columns


def test_one_document_of_each_group_stays(stages):
    before = dict(rows(stages[1]))
    want = {c for _, _, c in brute(list(before.items()), 5, 80)}
    assert sorted(rows(stages[2])) == sorted((i, before[i]) for i in want)


def test_personal_data_is_replaced(stages):
    assert sorted(rows(stages[3])) == sorted((i, redacted(t)) for i, t in rows(stages[2]))
    assert stages[3].where(F.col("n_chars") != F.char_length("text")).count() == 0


def test_the_mixture_follows_its_targets(stages):
    size, taken, longest = {}, {}, {}
    for r in stages[3].collect():
        n = len(words(r.text))
        size[r.source], longest[r.source] = size.get(r.source, 0) + n, max(longest.get(r.source, 0), n)
    for r in stages[4].collect():
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    want = targets(size)
    assert all(abs(taken.get(s, 0) - want[s]) <= longest[s] for s in size)


def test_tokens_are_the_library_s(stages):
    library = Tokenizer.from_file(tokenizer_path())
    want = sorted((i, library.encode(t, add_special_tokens=False).ids) for i, t in rows(stages[4]))
    assert sorted((r.doc_id, r.ids) for r in stages[5].collect()) == want


def test_run_and_empty_documents(spark, nothing, tmp_path):
    done = corpus_pipeline.run(spark, SF)
    assert done.count() > 100 and "ids" in done.columns
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_without_any_language_only_texts_without_letters_go(spark):
    docs = messy_table(spark, [(i, t, None, s) for i, t, _, s in messy_rows()])
    want = sorted((i, t) for i, t, _, _ in messy_rows() if any(c.isalpha() for c in t or ""))
    assert sorted(rows(corpus_pipeline.language(spark, docs, SF))) == want


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    """Whatever the order of the rows."""
    base, other = prose(1, 200), prose(2, 200)
    near = base.split()
    near[100] = "changed"
    data = [(3, base, "en", "a"), (14, " ".join(near), "en", "a"), (14, other, "en", "a"), (14, other, "en", "b"),
            (14, other, "en", "b"), (20, other, "en", "a"), (None, base, "en", "a"), (None, base, "en", "a"), (21, "", "en", "a"),
            (21, None, "en", "a"), (21, "", "en", "a")]
    want = [(3, base, "a"), (14, other, "a"), (21, "", "a"), (21, None, "a"), (None, base, "a"), (None, base, "a")]
    for k in range(3):
        docs = messy_table(spark, data[k::] + data[:k]).repartition(k + 1)
        got = corpus_pipeline.near_duplicates(spark, docs, SF)
        assert sorted(((r.doc_id, r.text, r.source) for r in got.collect()), key=str) == sorted(want, key=str)
        assert got.columns == docs.columns
