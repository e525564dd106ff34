import random

import corpus_pipeline
from pyspark.sql import functions as F
from tracewell.llm import language

from . import test_op1, test_op3, test_op7, test_op10
from .cases import nasty_rows, sentence


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lang = F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")
    return df.select("doc_id", "text", lang.alias("lang"), F.lit("web").alias("source"), F.length("text").cast("long").alias("n_chars"))


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def unique_rows():
    return list({i: (i, t) for i, t in nasty_rows() if i is not None}.values())


def leaked(text, items):
    """A run of 13 hit words, or a twentieth of all words."""
    ws, hit = test_op7.words(text), set()
    for _, t in items:
        own = test_op7.words(t)
        size = min(13, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}
        for k in range(len(ws) - size + 1):
            if tuple(ws[k : k + size]) in windows:
                hit |= set(range(k, k + size))
    return any(hit.issuperset(range(k, k + 13)) for k in hit) or bool(hit and 20 * len(hit) >= len(ws))


def test_a_whole_window_in_a_long_text_is_removed(spark, tmp_path):
    rng = random.Random(9)
    passage, long = sentence(rng, 40).split(), [f"word{k}" for k in range(4000)]
    spark.createDataFrame([(1, " ".join(passage)), (2, "two words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    put = lambda n: " ".join([*long[:2000], *passage[3 : 3 + n], *long[2000:]])
    rows = [(1, put(13)), (2, put(12)), (3, put(40)), (4, " ".join(long)), (5, " ".join(long) + " two words"), (6, "two words")]
    out = corpus_pipeline.remove_contaminated(spark, documents(spark, rows), str(tmp_path))
    assert sorted(i for i, _ in pairs(out)) == [2, 4, 5]


def test_stages_one_by_one(spark, tmp_path):
    items = [(1, unique_rows()[11][1][:400]), (2, "alpha beta")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, rows = documents(spark, unique_rows()), unique_rows()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        out.write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), rows
        rows = pairs(docs)
        if name == "language_id":
            assert sorted(rows) == sorted((i, t) for i, t in before if t and language.has_letter(t.encode()))
        elif name == "line_dedup":
            want = {eval(x)[0]: eval(x) for x in test_op1.brute(before)}
            assert sorted(rows) == sorted((i, w[1]) for i, w in want.items() if w[3] == 0 or w[1].strip())
        elif name == "near_dedup":
            assert sorted(i for i, _ in rows) == sorted({c for _, c in test_op3.brute_similar(before)})
            assert set(rows) <= set(before)
        elif name == "decontamination":
            assert sorted(rows) == sorted((i, t) for i, t in before if not leaked(t, items))
        assert all(n == len(t) for n, t in docs.select("n_chars", "text").collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    test_op10.check(rows, packed, 2048)


def test_near_dedup_keeps_one_of_equal_rows(spark):
    rows = [(1, "one two three four"), (1, "one two three four"), (2, "one two three four"), (3, "one two three four five six seven eight"), (None, "nine")]
    out = corpus_pipeline.dedup_documents(spark, documents(spark, rows), "")
    assert sorted(map(repr, pairs(out))) == sorted(map(repr, [(1, "one two three four"), (3, rows[3][1]), (None, "nine")]))


def test_run(spark, sf_small):
    first = corpus_pipeline.run(spark, sf_small)
    assert first.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    shown = lambda df: sorted(tuple(r)[:5] for r in df.collect())
    assert shown(first) == shown(corpus_pipeline.run(spark, sf_small)) and first.count() > 100
