"""The pipeline against a brute-force version, stage by stage, and the queries' contracts."""

import re

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_components, edit_distance_to_passage, near, words
from tilewright.llm import decontaminate

BAD = ["awful", "dreadful", "nasty"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    texts = [" ".join(words(40 + k % 30, k, 3000)) for k in range(120)]
    texts += [t + " " + " ".join(BAD) for t in texts[:30]]
    texts += [texts[40], texts[40].replace(" ", "\t "), None, "", texts[41]]
    texts += [" ".join(near(texts[50].split(), 1, k)) for k in range(5)]
    items = [" ".join(words(25, 7000 + k, 3000)) for k in range(4)]
    texts += [texts[60] + " " + items[0], items[1], " ".join(near(items[2].split(), 2, 1)) + " " + texts[61] + " " + texts[62]]
    rows = [(k, t, "en", ["a", "b", None][k % 3], len(t or ""), "extra") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(k, 1, int(120 <= k < 150)) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), {r[0]: r[1] for r in rows}, items


def test_stages_equal_brute_force(spark, folder):
    root, texts, items = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    kept = dict(texts)

    def step(k):
        nonlocal docs
        name, stage = corpus_pipeline.STAGES[k]
        out = stage(spark, docs, root)
        assert out.columns == columns, name
        out.write.parquet(f"{root}/stage{k}")
        docs = spark.read.parquet(f"{root}/stage{k}")
        return {r["doc_id"] for r in docs.collect()}

    kept = {i: t for i, t in kept.items() if not (set((t or "").split()) & set(BAD))}
    assert step(0) == set(kept)
    first = {}
    for i, t in sorted(kept.items()):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), i)
    kept = {i: kept[i] for i in first.values()}
    assert step(1) == set(kept)
    kept = {i: kept[i] for i, (_, c) in brute_components(kept.items(), 5, 80).items() if c == i}
    assert step(2) == set(kept)
    holds = lambda t: any(edit_distance_to_passage(w := decontaminate.words_of(x), decontaminate.words_of(t)) <= 0.2 * len(w) for x in items)
    kept = {i: t for i, t in kept.items() if not holds(t)}
    assert step(3) == set(kept)
    mixed = corpus_pipeline.STAGES[4][1](spark, docs, root).collect()
    assert {r["doc_id"] for r in mixed} == set(kept)
    assert sorted(map(str, corpus_pipeline.run(spark, root).collect())) == sorted(map(str, mixed))


def test_stages_survive_empty_tables_and_nulls(spark, folder):
    root = folder[0]
    docs = spark.read.parquet(f"{root}/documents.parquet")
    odd = spark.createDataFrame([(None,) * 6, (None, "x y", None, None, None, None), (1, None, None, None, None, None)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), root).collect() == [], name
        assert stage(spark, odd, root).count() <= 3, name


def test_rows_without_an_id_of_their_own_are_decided_on_one_by_one(spark, folder):
    a, b, c, d, e = (words(40, 600 + k, 3000) for k in range(5))
    near_a, near_d = near(a, 1, 1), near(d, 1, 2)
    rows = [(1, a), (1, a), (1, b), (2, b), (2, c), (None, d), (None, d), (None, near_d), (None, c), (3, near_a), (3, e), (None, None), (None, ""), (4, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string"
    docs = spark.createDataFrame([(i, t and " ".join(t), None, None, None, None) for i, t in rows], schema)
    told = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    name = lambda pairs: sorted(((i, t and " ".join(t)) for i, t in pairs), key=str)
    exact = corpus_pipeline.drop_exact_copies(spark, docs, folder[0])
    assert told(exact) == name([(1, a), (1, b), (2, c), (None, d), (None, near_d), (3, near_a), (3, e), (4, None)])
    left = corpus_pipeline.drop_near_copies(spark, exact, folder[0])
    assert left.columns == docs.columns
    texts = [t for _, t in told(left)]
    assert len(texts) == 6 and {" ".join(x) for x in (b, c, e)} < set(texts) and None in texts
    assert sum(" ".join(x) in texts for x in (a, near_a)) == sum(" ".join(x) in texts for x in (d, near_d)) == 1
    assert len(told(corpus_pipeline.drop_near_copies(spark, docs, folder[0]))) == 5 + 3  # no two texts without words are near


def test_columns_of_any_name_are_carried_along(spark, folder):
    names = "id ids docs n sha _id _sha _row _sha_ kept score predicted h node rep component _key _rank".split()
    rows = [(k // 2, " ".join(words(40, k % 5, 3000)), "en", "a", 1, *range(len(names))) for k in range(12)] + [(None, "x y z", None, None, None, *range(len(names)))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns, name
        assert all(tuple(r)[5:] == tuple(range(len(names))) for r in out.collect()), name
    assert len(corpus_pipeline.drop_exact_copies(spark, docs, folder[0]).collect()) == 6
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder[0]).count() == 14
