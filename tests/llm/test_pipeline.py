"""The pipeline on the smallest tables, each stage against a plain version of it."""

import re

import pytest

from .test_near import brute as brute_near
from .test_repeats import brute as brute_repeats

SF = "/root/testdata/sf0.001"
PRIVATE = re.compile(r"[\w.]+@[\w.]+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|AKIA\w{16}|password=\w+|\b\d{16}\b")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    folder = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs[-1], SF).write.parquet(f"file://{folder}/{number}")
        docs.append(spark.read.parquet(f"file://{folder}/{number}"))
    return docs


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def has_check_digit(number):
    digits = [int(x) for x in number[::-1]]
    return (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert all(r["n_chars"] == len(r["text"]) for r in df.collect())


def test_classifier_keeps_good_documents(spark, stages):
    kept = set(texts(stages[1]))
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r["doc_id"] for r in labels if r["quality"] == 1]
    bad = [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.3 * len(bad)


def test_one_of_each_group_stays(stages):
    rows = sorted(texts(stages[1]).items())
    assert sorted(texts(stages[2])) == sorted(i for i, _, c in brute_near(rows, 5, 80) if i == c)


def test_repeats_go(stages):
    want = {i: t for i, n, gone, t in brute_repeats(sorted(texts(stages[2]).items()), 50) if n == 0 or gone < n}
    assert texts(stages[3]) == want


def test_private_data_goes(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    found = {m for t in before.values() for m in PRIVATE.findall(t)}
    other = {m for m in found if m.isdigit() and not has_check_digit(m)}  # numbers that are no card's
    assert found - other and not any(m in t for t in after.values() for m in found - other)
    assert all(m in after[i] for i, t in before.items() for m in other if m in t)
    assert all(after[i] == t for i, t in before.items() if not re.search("[0-9@]|token", t))


def test_every_document_is_packed_once(stages):
    rows = stages[5].collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts(stages[4]))
    assert all(r["n_tokens"] == len(texts(stages[4])[r["doc_id"]].split()) for r in rows[:20])


def test_run_gives_the_last_stage(spark, stages):
    import corpus_pipeline

    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[5].collect()))


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns named as the operators' own pass every stage."""
    import corpus_pipeline

    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(40_000))
    rows = [(1, "plain words " * 30), (1, "plain words " * 30), (None, None), (None, "x"), (2, ""), (3, None), (4, long), (5, "mail a@b.example now")]
    clash = ["n_words", "n_removed", "removed", "n_entities", "score", "predicted", "attention", "row", "digest", "batch", "id"]
    docs = spark.createDataFrame([(i, t, *[f"own {c}" for c in clash]) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for number, given in enumerate((docs, docs.where("false"))):
            out = stage(spark, given, SF)
            assert out.columns == docs.columns, name
            got = out.collect()
            assert all(r[c] == f"own {c}" for r in got for c in clash), name
            if number:
                assert not got
            elif name != "quality classifier":
                assert len(got) >= 6 and sum(r["doc_id"] is None for r in got) == 2, name
    assert corpus_pipeline.packing(spark, docs, SF).count() == len(rows)
    assert corpus_pipeline.packing(spark, docs.where("false"), SF).count() == 0
