"""The pipeline's stages against plain Python, each on its own input."""

import pytest

pytest.importorskip("textloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from textloom.llm import common, mixing, quality_rules  # noqa: E402

from . import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs.collect())
        if name != "sharding":
            assert docs.columns == columns
    ids = lambda rows: sorted(r.doc_id for r in rows)
    rows = lambda rows: [(r.doc_id, r.text) for r in rows]
    a, b = seen["quality_rules"]
    failed = {x[0] for x in brute.op3(rows(a)) if x[-1]}
    assert not failed & set(ids(b)) and {r.doc_id for r in quality_rules.judged(spark.createDataFrame(rows(a), "doc_id long, text string")).where("kept").collect()} == set(ids(b))
    a, b = seen["near_dedup"]
    assert ids(b) == sorted(x[0] for x in brute.op8(rows(a), 5, 80) if x[3]) and set(b) <= set(a)
    a, b = seen["decontamination"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set(ids(a)) - set(ids(b))
    assert {x[0] for x in brute.leaks(rows(a), bench)} == gone
    a, b = seen["mixing"]
    sizes = {}
    for r in a:
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    aim = dict(zip(sorted(sizes), mixing.targets([sizes[s] for s in sorted(sizes)]), strict=True))
    for s in sizes:
        mine = [r for r in b if r.source == s]
        assert abs(sum(len(brute.words(r.text)) for r in mine) - aim[s]) <= max(len(brute.words(r.text)) for r in a if r.source == s)
    assert max(ids(b).count(i) for i in set(ids(b))) <= 3 and set(b) <= set(a)
    a, b = seen["sharding"]
    assert ids(a) == ids(b)
    counts = [sum(r.shard == s for r in b) for s in range(8)]
    assert max(counts) - min(counts) <= 1


def test_run(spark):
    """Whole rows, and of the tables written on the way only the last stage's input and work are left."""
    import glob

    folder = common.scratch_path(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    assert {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{folder}/*")) - before} == {"mixing", "keys"}


def test_repeated_and_odd_rows(spark, tmp_path):
    """Null ids, null texts, repeated rows and an extra column go through every stage."""
    text = " ".join(f"the word{i} of" for i in range(40))
    data = [(1, text, "en", "a", 5, "x"), (1, text, "en", "a", 5, "x"), (None, text + " more", "en", None, 5, "x"), (2, None, None, None, None, None), (3, "", "en", "b", 0, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, shard string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    assert set(r.doc_id for r in docs.collect()) <= {1, None}
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
