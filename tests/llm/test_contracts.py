"""The queries against plain Python, on the driver's small table and on tables of odd rows."""

import random
import time

import numpy as np
import pytest

pytest.importorskip("textloom.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from textloom.llm import decontamination, line_dedup, near_dedup, quality_rules, queries, sharding, substring_dedup, token_files, url_filter  # noqa: E402

from . import brute  # noqa: E402

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string, shard int, size string, chunk string, cluster string, label string, kept string"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def same(df, expected, *cols):
    assert rows(df, *cols) == sorted(expected, key=repr)


@pytest.fixture(scope="module")
def real(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def odd_texts():
    rnd = random.Random(5)
    vocab = ["alpha", "Beta", "gamma,", "é", "日本", "x", "#$%", "ÀB", "a\u00a0b", "\u2003"]
    prose = lambda n: " ".join(rnd.choice(vocab) + str(rnd.randrange(9)) for _ in range(n))
    base, hot = prose(120), prose(40)
    line = "This line is long enough to count as one and is found in many texts"
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "one two", "ONE two", "a\n\nb\n", base, base, base.upper(), base + " tail", hot + "\n" + prose(30), prose(30) + " " + hot, hot + " " + hot, "z " * 200]
    texts += [f"{line}\n{prose(5)}\n  {line.upper()}\t" for _ in range(6)] + [prose(20_000)] + [base[: -i - 1] for i in range(5)]
    for _ in range(30):  # near copies
        w = base.split()
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = "edit" + str(rnd.randrange(99))
        texts.append(" ".join(w))
    return texts


@pytest.fixture(scope="module")
def odd(spark):
    data = [(i * 3 - 5, t) for i, t in enumerate(odd_texts())]
    data += [data[7], data[9], (None, odd_texts()[7]), (None, None), (2**62, "far"), (-(2**62), odd_texts()[10])]
    # the smallest id there is, and ids that repeat with other texts
    data += [(-(2**63), odd_texts()[11]), (-(2**63), None), (4, odd_texts()[10]), (4, odd_texts()[15]), (4, odd_texts()[12]), (2**62, odd_texts()[16])]
    df = spark.createDataFrame([(d, t, *["?" if i else None for i in range(1)], 1, "s", "c", "cl", "l", "k") for d, t in data], DOCS).repartition(7)
    return df, data


def test_substring_dedup(spark, real, odd):
    for df, data in (real, odd):
        same(substring_dedup.deduplicated(df, digest=True), brute.op1(data), "doc_id", "n_words", "n_removed", "kept_sha256")


def test_substring_dedup_in_small_chunks(spark, odd, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "LONG_CHUNKS", 3)
    df, data = odd
    same(substring_dedup.deduplicated(df.repartition(20), digest=True), brute.op1(data), "doc_id", "n_words", "n_removed", "kept_sha256")
    out = substring_dedup.deduplicated(df).collect()
    assert all(r.n_removed == sum(s["end"] - s["start"] for s in r.spans) for r in out)


def test_substring_dedup_of_hot_windows_in_steps(spark, odd, monkeypatch):
    """Prefixes of many chunks, and of many windows, are extended and met in buckets of buckets."""
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 400)
    monkeypatch.setattr(substring_dedup, "LONG_CHUNKS", 2)
    monkeypatch.setattr(substring_dedup, "LONG_WINDOWS", 3)
    monkeypatch.setattr(substring_dedup, "FAN", 3)
    monkeypatch.setattr(substring_dedup, "MAX_RUN", 4)
    data = [x for x in odd[1] if len(x[1] or "") < 20_000] * 2
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(16)
    same(substring_dedup.deduplicated(df, digest=True), brute.op1(data), "doc_id", "n_words", "n_removed", "kept_sha256")


def test_subtree_nodes():
    """Of each suffix, the depth of its deepest node of at least 3 words that a smaller document shares."""
    rnd = random.Random(3)
    for _ in range(300):
        runs = [[rnd.randrange(3) for _ in range(rnd.randrange(3, 12))] for _ in range(6)]
        docs = [rnd.randrange(4) for _ in runs]
        words = np.array([w for r in runs for w in r], np.int64)
        ends = np.cumsum([len(r) for r in runs])
        starts = ends - [len(r) for r in runs]
        base = np.concatenate([np.arange(a, b - 2) for a, b in zip(starts, ends, strict=True)])
        run = np.searchsorted(ends, base, "right")
        got, _, _ = substring_dedup.subtree(words, base, ends[run] - base, np.array(docs)[run], 3)
        suffixes = [(docs[r], tuple(words[b : ends[r]].tolist())) for b, r in zip(base.tolist(), run.tolist(), strict=True)]

        def common(x, y):
            return next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))

        want = [max([n for d, t in suffixes if d < doc and (n := common(s, t)) >= 3], default=0) for doc, s in suffixes]
        assert got.tolist() == want


def test_decontamination_real(spark, real):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute.leaks(real[1], [(r.item_id, r.text) for r in bench.collect()])
    same(decontamination.leaks(real[0], bench), want, "doc_id", "item_id", "n_item_tokens", "n_covered", "at")
    assert want
    clean = decontamination.clean(real[0], bench)
    assert clean.columns == real[0].columns and {r.doc_id for r in clean.select("doc_id").collect()} == {d for d, _ in real[1]} - {x[0] for x in want}


def test_tiling_of_few_words():
    rnd = random.Random(8)
    for _ in range(400):
        letters = rnd.choice(["ab", "abc", "abcdef"])
        doc, item = (" ".join(rnd.choice(letters) for _ in range(rnd.randrange(1, n))) for n in (60, 30))
        index = decontamination.Index([(1, item)])
        ids = np.array([index.vocab.get(w, 0) for w in doc.split()], np.uint64)
        assert [(9, *m) for m in decontamination.matches(ids, index)] == brute.leaks([(9, doc)], [(1, item)])


def test_tiling_of_a_repetitive_text_is_fast():
    index = decontamination.Index([(1, "again " * 4000)])
    began = time.time()
    assert decontamination.matches(np.ones(20_000, np.uint64), index) == [(1, 4000, 4000, 0)]
    assert time.time() - began < 1


def test_decontamination_plan_holds_one_block(spark, real, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 4000)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    monkeypatch.setattr(decontamination, "blocks", lambda b, blocks=decontamination.blocks: blocks(b, 4000))
    assert len(list(decontamination.blocks(bench))) > 3
    want = {(r.doc_id, r.item_id) for r in decontamination.leaks(real[0], bench).collect()}
    assert want == {x[:2] for x in brute.leaks([x for x in real[1] if x[0] in {d for d, _ in want}], [(r.item_id, r.text) for r in bench.collect()])}
    clean = decontamination.clean(real[0], bench)
    assert "MapInArrow" not in clean._jdf.queryExecution().executedPlan().toString()
    assert clean.columns == real[0].columns and {r.doc_id for r in clean.collect()} == {d for d, _ in real[1]} - {d for d, _ in want}


def test_decontamination_odd(spark, monkeypatch):
    item = "Which of the seven rivers named below, when measured from its source, runs longest through the old plain?"
    w = item.split()
    moved = " ".join(w[10:]) + " filler words stand here. " + " ".join(w[:10])
    docs = [(1, item), (2, "intro " + moved.upper() + " end"), (3, "Which of the seven rivers is it"), (4, None), (5, ""), (None, item), (6, "yes no"), (7, "Yes, NO!"), (8, item), (8, item)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item), (2, "yes no"), (3, None), (4, ""), (5, "...")], "item_id long, text string")
    want = {(1, 1), (2, 1), (None, 1), (6, 2), (7, 2), (8, 1)}
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()} == want
    blocks = list(decontamination.blocks(bench, 64))
    assert len(blocks) > 1 and sum(map(len, blocks)) == 4
    monkeypatch.setattr(decontamination, "blocks", lambda b: blocks)
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()} == want
    assert sorted(r.doc_id for r in decontamination.clean(df, bench).collect()) == [3, 4, 5]
    monkeypatch.undo()
    empty = bench.where("false")
    assert decontamination.leaks(df, empty).count() == 0 and decontamination.clean(df, empty).count() == len(docs)
    assert decontamination.leaks(df.where("false"), bench).count() == 0


def test_quality_rules(spark, real, odd):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for df, data in (real, odd):
        out = quality_rules.judged(df)
        same(out, brute.op3(data), *cols)
        assert out.where("base_failed and kept").count() == 0
        kept = quality_rules.kept(df)
        assert kept.columns == df.columns and kept.count() == out.where("kept").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    told = quality_rules.judged(real[0]).where("n_words >= 50").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    count = {(r.quality, r.kept): r["count"] for r in told}
    assert count.get((1, False), 0) <= 0.01 * count[1, True] and count.get((0, True), 0) <= 0.05 * count[0, False]


def test_quality_rules_stay_native(spark, real):
    plan = quality_rules.judged(real[0])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_url_filter(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    same(url_filter.judged(pages), brute.op5([(r.page_id, r.url) for r in pages.select("page_id", "url").collect()]), *cols)
    urls = [None, "", "no scheme", "://", "http://", "http://COM", "http://com/", "http://a.b.Example.COM/en/x?y#z", "http://www.example.com/en/", "http://www.example.com/en", "http://x.net/fr/a", "http://xnet/fr/",
            "https://É.net/es/é/ü", "http://net/es/?q=://", "a://b://c.com/", "http://com/en/" + "p/" * 3000, "http://.com/", "http://com./", "http://u@com:80/", "http://a\nb.com/x\ny", "http://x.com/a\u2028b"]
    df = spark.createDataFrame([(i % 17, u, "h") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    same(url_filter.judged(df), brute.op5([(i % 17, u) for i, u in enumerate(urls)]), *cols)
    accents = [("block", "É.net", "/"), ("allow", "ÀB.CoM", "/x")]
    data = [(1, "http://É.net/a"), (2, "http://é.net/a"), (3, "http://www.ÀB.com/x"), (4, "http://Àb.COM/y")]
    want = brute.op5(data, [("block", "É.net", "/"), ("allow", "Àb.com", "/x")])
    assert [x[3] for x in want] == ["É.net/", None, "Àb.com/x", None]
    same(url_filter.judged(spark.createDataFrame(data, "page_id long, url string"), url_filter.rule_table(spark, accents)), want, *cols)
    rules = [("block", "com", "/e"), ("allow", "com", "/en"), ("allow", "b.com", ""), ("block", "COM", "/en"), ("block", "x", None)]
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    data = [(1, "http://a.b.com/en"), (2, "http://com/ex"), (3, "http://com/eng/"), (4, "http://b.com")]
    want = brute.op5(data, [("block", "com", "/e"), ("block", "com", "/en"), ("allow", "b.com", "")])
    same(url_filter.judged(spark.createDataFrame(data, "page_id long, url string"), table), want, *cols)
    assert url_filter.judged(df.where("false")).count() == 0
    assert {r.verdict for r in url_filter.judged(df, table.where("false")).collect()} == {"allow"}


def test_url_filter_long_rules(spark):
    long = "/" + "a" * url_filter.MAX_PATH
    rules = [("block", "com", long + "/x"), ("allow", "com", long + "/xy"), ("block", "b.com", long[:-1]), ("allow", "net", long)]
    data = list(enumerate(f"http://{h}{p}" for h in ("com", "b.com", "net") for p in (long, long[:-1], long[:-2], long + "/x", long + "/xyz", long + "/y", long[:-1] + "b")))
    rules.append(("block", "org", "/" + "p" * 3000))
    data += [(100, "http://org/" + "p" * 2100), (101, "http://org/" + "p" * 3000 + "/x")]
    found = url_filter.judged(spark.createDataFrame(data, "page_id long, url string"), url_filter.rule_table(spark, rules))
    same(found, brute.op5(data, rules), "page_id", "host", "path", "rule", "verdict")


def test_url_filter_stays_native(spark):
    plan = url_filter.judged(spark.read.parquet(f"{SF}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_token_files(spark, real, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for df, data in (real, odd):
        same(token_files.round_trip(df, path), brute.op6(data, tokenizer), "doc_id", "start", "n_tokens", "ids_crc32")
    extra = [(3, 'J\u030c, The. THE, <|ENDOFTEXT|>. it,s A.B, x1, é. <|endoftext|>.'), (1, "<|endoftext|> it's Ünïcode\u0301 e\u0301 ΟΔΟΣ don't <|startoftext|>x"), (2, "\u3000wide \x1c sep")]
    same(token_files.round_trip(spark.createDataFrame(extra, "doc_id long, text string"), path), brute.op6(extra, tokenizer), "doc_id", "start", "n_tokens", "ids_crc32")
    assert token_files.round_trip(real[0].where("false"), path).count() == 0


def test_token_files_of_other_tokenizers(spark, odd, tmp_path):
    import json

    from tokenizers import Tokenizer

    words = public_tokenizers.path("word_bpe_49k.json")
    with open(words, encoding="utf-8") as file:
        settings = json.load(file)
    assert token_files.by_words(settings)
    settings["added_tokens"].append({**settings["added_tokens"][0], "id": 49408, "content": "The Cat"})
    (tmp_path / "added.json").write_text(json.dumps(settings), encoding="utf-8")
    settings["added_tokens"].pop()
    settings["normalizer"] = None
    (tmp_path / "cased.json").write_text(json.dumps(settings), encoding="utf-8")
    data = [*odd[1], (9001, "The Cat sat"), (9002, " The Cat  SAT\n\n on.")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for path in (public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "added.json"), str(tmp_path / "cased.json")):
        same(token_files.round_trip(df, path), brute.op6(data, Tokenizer.from_file(path)), "doc_id", "start", "n_tokens", "ids_crc32")


def test_token_file_pairs(spark, odd):
    from textloom.llm.common import scratch_path

    path, folder = public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "pairs")
    files = token_files.write(odd[0], path, folder).collect()
    found = [token_files.Reader(folder, r["name"]) for r in files]
    assert sum(len(x) for x in found) == len(odd[1])
    assert all(len(x[i]) == x.offsets[i + 1] - x.offsets[i] and x[i][-1] == 1 for x in found for i in range(len(x)))
    assert [r["base"] for r in files] == [sum(x["n_tokens"] for x in files[:i]) for i in range(len(files))]


def test_sharding(spark, real, odd):
    import zlib

    for df, data in (real, odd):
        out = sharding.placed(df).collect()
        size = lambda t: len((t or "").encode()) + 1
        assert sorted((r.doc_id, r.size, r.text_crc32) for r in out if r.doc_id is not None) == sorted((d, size(t), zlib.crc32((t or "").encode())) for d, t in data if d is not None)
        assert len(out) == len(data) and {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
        slots = {s: sorted(r.slot for r in out if r.shard == s) for s in range(8)}
        assert all(v == list(range(len(v))) for v in slots.values())
        counts = [len(v) for v in slots.values()]
        assert max(counts) - min(counts) <= 1 and sum(counts) == len(data)
        assert sorted(out, key=repr) == sorted(sharding.placed(df.repartition(5)).collect(), key=repr)
    assert sharding.placed(real[0].where("false")).count() == 0


@pytest.mark.parametrize("rows, part", [(1 << 16, 1 << 12), (4, 3)])
def test_sharding_by_a_plain_walk(spark, odd, monkeypatch, rows, part):
    """Counts of each doc_id in each shard, also where equal and null ids make a position hot."""
    from collections import Counter

    monkeypatch.setattr(sharding, "SLICE_ROWS", rows)
    monkeypatch.setattr(sharding, "PART", part)
    data = [*odd[1], *[(None, f"text {i}") for i in range(300)], *[(11, "same")] * 400]
    df = spark.createDataFrame(data, "doc_id long, text string")
    at = {r.doc_id: r._pos for r in sharding.keyed(df).collect()}
    out = sharding.placed(df).collect()
    want = Counter(brute.op7([(at[d], i) for i, (d, _) in enumerate(data)]))
    shard = dict(want)  # rows of one position are alike to the ring: compare how many of it each shard has
    count = Counter((at[data[i][0]], s) for i, s in shard)
    assert Counter((at[r.doc_id], r.shard) for r in out) == count
    slots = Counter((r.shard, r.slot) for r in out)
    assert max(slots.values()) == 1 and all(s < sum(1 for x in slots if x[0] == k) for k, s in slots)
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, sharding.placed(df.repartition(3)).collect()), key=repr)


def test_ring_moves_little():
    rnd = random.Random(3)
    counts = {rnd.randrange(sharding.RING): rnd.randrange(1, 9) for _ in range(4000)}
    own = {}
    import bisect

    points = sharding.ring()
    at = [p for p, _ in points]
    for pos in counts:
        own[pos] = points[bisect.bisect_left(at, pos) % len(points)][1]
    plan = sharding.planned(counts)
    assert sum(e - f for _, f, e, _, _ in plan) == sum(counts.values())
    moved = sum(e - f for p, f, e, s, _ in plan if own[p] != s)
    assert moved < 0.2 * sum(counts.values())
    hot = dict.fromkeys(range(100), 1) | {7: 1000}
    loads = {}
    for _, f, e, s, _ in sharding.planned(hot):
        loads[s] = loads.get(s, 0) + e - f
    assert max(loads.values()) - min(loads.values()) <= 1


def test_near_dedup(spark, real, odd):
    cols = ["doc_id", "n_shingles", "component_id", "kept"]
    for df, data in (real, odd):
        same(near_dedup.classes(df, 3, 85), brute.op8(data, 3, 85), *cols)
        same(near_dedup.classes(df), brute.op8(data, 5, 80), *cols)
    kept = near_dedup.deduplicated(real[0])
    assert kept.columns == real[0].columns and kept.count() == near_dedup.classes(real[0]).where("kept").count()
    assert near_dedup.classes(real[0].where("false")).count() == 0


def test_near_dedup_in_blocks(spark, real, odd, monkeypatch):
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", 4)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 400)
    monkeypatch.setattr(near_dedup, "BRIDGES", 2)
    for df, data in (real, odd):
        same(near_dedup.classes(df, 3, 85), brute.op8(data, 3, 85), "doc_id", "n_shingles", "component_id", "kept")


def shuffled(spark):
    """Bytes that shuffles wrote, by stage, of the session's last 1,000 stages."""
    jvm, args = spark._jvm, spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, args, jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}


def test_near_dedup_shuffles_texts_of_clusters_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 1000)  # a cluster of several blocks is confirmed in two rounds
    rnd = random.Random(6)
    texts = [" ".join(f"{rnd.getrandbits(64):x}" for _ in range(1500)) for _ in range(200)]
    texts += [f"{texts[0]} tail{i}" for i in range(4)]
    texts += [" ".join([f"{rnd.getrandbits(64):x}" for _ in range(80)] + texts[0].split()[80:]) for _ in range(2)]
    data = list(enumerate(texts))
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    before = shuffled(spark)
    same(near_dedup.classes(df, 3, 85), brute.op8(data, 3, 85), "doc_id", "n_shingles", "component_id", "kept")
    written = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    assert 0 < written < sum(map(len, texts)) / 2


def test_filter_of_texts_loses_none(spark, monkeypatch):
    ids = spark.range(-9000, 9000).selectExpr("id as doc_id", "xxhash64(string(id)) as text_id", "string(id) as text")
    some = ids.where("doc_id % 3 = 0").select("doc_id", "text_id")
    for most, passed in ((1 << 26, 0.1), (1 << 15, 0.3)):
        monkeypatch.setattr(near_dedup, "MAX_TOLD", most)
        found = near_dedup.sought(ids, some)
        assert found.columns == ids.columns and found.count() < 6000 + passed * 12000
        assert found.where("doc_id % 3 = 0").count() == 6000
    assert near_dedup.sought(ids, some.where("false")).count() == 0


def test_near_dedup_exact(spark, real, odd):
    for df, data in (real, odd):
        same(near_dedup.classes(df, 3, 85, exact=True), brute.op8(data, 3, 85), "doc_id", "n_shingles", "component_id", "kept")


def test_near_dedup_of_repeated_ids(spark):
    a, b = ("one text about the river and the old mill that stands by it " * 2, "another text of the sea and all the ships that sail on it " * 2)
    for data in ([(7, a), (7, b), (3, b)], [(7, a), (7, b), (3, b), (3, a)], [(7, a), (7, a), (7, b)]):
        df = spark.createDataFrame(data, "doc_id long, text string")
        same(near_dedup.classes(df), brute.op8(data, 5, 80), "doc_id", "n_shingles", "component_id", "kept")
        kept = [(r.doc_id, r.text) for r in near_dedup.deduplicated(df).collect()]
        assert sorted(kept) == sorted(x for x, y in zip(data, brute.op8(data, 5, 80), strict=True) if y[3])


def test_prefixes_miss_no_pair():
    """Sets that share a share of the larger one share a value of their prefixes, under any order."""
    rnd = random.Random(4)
    for _ in range(3000):
        values = rnd.sample(range(100), 100)  # the order
        share = rnd.choice([0.376, 0.471, 0.8])
        a, b = (set(rnd.sample(range(45), rnd.randrange(1, 33))) for _ in range(2))
        if len(a & b) >= share * max(len(a), len(b)):
            short = [set(sorted(x, key=values.__getitem__)[: near_dedup.prefix(len(x), share)]) for x in (a, b)]
            assert short[0] & short[1]


def test_union_estimate():
    import numpy as np

    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rnd.integers(0, 2**63, 100).astype(np.uint64)])
    x, y = np.sort(a)[:32], np.sort(b)[:32]
    union = np.sort(np.unique(np.concatenate([a, b])))[:32]
    want = len(set(union) & set(a) & set(b)) / 32
    assert near_dedup.union_estimates(x, y[None])[0] == pytest.approx(want)


def test_line_dedup(spark, real, odd):
    for df, data in (real, odd):
        same(line_dedup.deduplicated(df, digest=True), brute.op9(data), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert line_dedup.deduplicated(real[0].where("false")).count() == 0


def test_line_dedup_of_repeated_ids(spark):
    line = "this line is more than forty characters long, as it must be"
    data = [(7, line + "\nx\ny\nz"), (7, line), (7, "a\n" + line), *[(i, f"{i}\n{line}") for i in range(1, 5)], (9, line), (9, line), (None, line)]
    for some in (data, data[:5], data[:7]):
        df = spark.createDataFrame(some, "doc_id long, text string")
        same(line_dedup.deduplicated(df, digest=True), brute.op9(some), "doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_line_runs_over_many_borders(spark):
    """Runs of two documents a partition: counts and keepers come from the pieces."""
    line = "a line that is long enough to count and is found in several texts"
    data = [(i, f"{line} {i % 3}\n{line} {i % 7}\n{line} {i // 4}") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        same(line_dedup.deduplicated(df, digest=True), brute.op9(data), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_line_dedup_cuts_hot_runs(spark):
    line = "a hot line that a very large number of the documents hold, in turn"
    data = [(i, f"{line}\n{line}\nown line of the document with number {i} and nothing else") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    same(line_dedup.deduplicated(df, digest=True), brute.op9(data), "doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_mixing(spark, real, odd):
    from textloom.llm import mixing

    for df, data in (real, odd):
        out = mixing.mixed(df).collect()
        size = {}
        for r in out:
            size.setdefault(r.source, 0)
            size[r.source] += r.size
        sources = sorted(size, key=lambda s: (s is None, s or ""))
        aim = dict(zip(sources, mixing.targets([size[s] for s in sources]), strict=True))
        assert len(out) == len(data) and sorted(r.size for r in out) == sorted(len(brute.words(t)) for _, t in data)
        for s in sources:
            mine = [r for r in out if r.source == s]
            assert all(r.source_size == size[s] and r.target == pytest.approx(aim[s]) and r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in mine)
            assert abs(sum(r.taken for r in mine) - aim[s]) <= (1 if df is real[0] else max(r.size for r in mine))
        assert rows(mixing.mixed(df.repartition(3)), "doc_id", "size", "taken") == sorted(((r.doc_id, r.size, r.taken) for r in out), key=repr)
    assert mixing.mixed(real[0].where("false")).count() == 0


def test_mixing_targets_and_knapsack():
    from textloom.llm import mixing

    assert mixing.targets([10, 10, 100]) == pytest.approx([22.5, 30, 67.5])  # 20, 40, 60; the second stops at 30
    got = mixing.targets([5, 1000, 5])
    assert got[0] <= 15 and got[2] <= 15 and sum(got) == pytest.approx(1010)
    rnd = random.Random(2)
    for _ in range(50):
        lengths = rnd.sample(range(1, 60), 5)
        counts = [rnd.randrange(0, 4) for _ in lengths]
        budget = rnd.randrange(0, 120)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        picks = mixing.knapsack(lengths, counts, budget)
        assert all(0 <= p <= c for p, c in zip(picks, counts, strict=True))
        assert sum(p * n for p, n in zip(picks, lengths, strict=True)) == max(s for s in sums if s <= budget)


def test_mixing_of_many_lengths(spark):
    """Over 512 lengths of one source: the words taken meet the target's whole number; targets equal the plain ones."""
    from textloom.llm import mixing

    data = [(i, "w " * (i + 1), "ab"[i % 2]) for i in range(1600)] + [(5, "w " * 6, None), (None, "w", "c"), (None, None, "c"), (None, "x", "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = mixing.mixed(df).collect()
    size = {s: sum(r.size for r in out if r.source == s) for s in {r.source for r in out}}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    for s, target in zip(order, mixing.targets([size[s] for s in order]), strict=True):
        assert all(r.target == pytest.approx(target) for r in out if r.source == s)
        assert sum(r.taken for r in out if r.source == s) == round(target)
    taken = sorted(((r.doc_id, r.text, r.source) for r in mixing.taken(df).collect() if r.doc_id is not None), key=repr)
    assert taken == sorted(((r.doc_id, t, r.source) for r in out if r.doc_id is not None for _ in range(r.copies) for d, t, s in [next(x for x in data if x[0] == r.doc_id and x[2] == r.source)]), key=repr)


def test_mixing_fits_exactly():
    from textloom.llm import mixing

    assert mixing.fitted(np.array([590_000, 600_000, 1_000_000]), np.ones(3, int), 1_190_000).tolist() == [1, 1, 0]
    rnd = np.random.default_rng(6)
    for n, top in ((3000, 20_000), (800, 1_000_000)):
        lengths = np.unique(rnd.integers(1, top, n))
        counts = rnd.integers(1, 4, len(lengths))
        for share in (0.01, 0.3, 0.97):
            budget = int((lengths * counts).sum() * share)
            picks = mixing.fitted(lengths, counts, budget)
            assert (0 <= picks).all() and (picks <= counts).all() and int((picks * lengths).sum()) == budget


def test_shared_rows_survive_clashing_columns(spark, odd):
    df, _ = odd
    assert quality_rules.kept(df).columns == df.columns and near_dedup.deduplicated(df).columns == df.columns


def test_queries_are_registered():
    assert [q.split("_")[0] for q in queries.QUERIES if q.startswith("op")] == [f"op{i}" for i in range(1, 11)]
