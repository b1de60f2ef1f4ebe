"""Text statistics against loops, and learned rules on planted junk."""

import random

import __spark_entry__ as entry
from pyspark.sql import functions as F
from tidemark.llm import quality


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_statistics_of_odd_texts(spark):
    texts = [None, "", " \n\t", "a b", "a b c", "a b c a b c", "a a a a", "a b c x a b c d b c x a", "é\u00a0ü \x1c #|<>",
             "x\nx\n x\n\n \nx", "one two three\n" * 5, "a b a b a", "p q r s p q r t q r s", "\U0001f600 ## \U0001f600"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in quality.text_statistics(frame, keep=["text"]).collect():
        assert tuple(r[c] for c in quality.BASE) == brute(r.text), repr(r.text)


def test_statistics_of_the_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.length("text") < 4000)
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = quality.text_statistics(docs, keep=["doc_id"]).collect()
    assert len(out) == len(texts)
    for r in out:
        assert tuple(r[c] for c in quality.BASE) == brute(texts[r.doc_id])


def test_rules_find_planted_junk_and_spare_the_rest(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(1500):
        words = rng.choices(vocabulary, k=rng.randint(60, 200))
        junk = i % 5 == 0
        if junk and i % 10:
            words = [w + "###" for w in words]
        elif junk:
            words = [w.upper() for w in words]
        docs.append((i, " ".join(words)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 0 if junk else 1))
    out = quality.judge_quality(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels + [(None, 0), (7, None)], "doc_id long, quality int"),
    ).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in out)
    assert all((r.rule is None) == r.kept for r in out)


def test_documents_without_labels_nulls_and_repeats(spark):
    rows = [(1, None, "x"), (1, "w " * 60, "x"), (None, " ".join(map(str, range(60))), "y"), (3, "", None)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.judge_quality(frame, none).collect()
    assert sorted((r.base_failed, r.kept) for r in out) == [(False, True)] * 2 + [(True, False)] * 6
    assert quality.judge_quality(frame.limit(0), none).count() == 0


def test_query_keeps_what_is_good(spark, folder):
    out = entry.queries()["op8_quality_rules"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rates = {r.quality: r.kept for r in out.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.99


def test_the_pipeline_writes_no_texts_to_judge_them(spark, monkeypatch):
    import corpus_pipeline

    columns, write = [], quality.written

    def written(df, *names):
        columns.extend(field.simpleString() for field in df.schema)
        return write(df, *names)

    monkeypatch.setattr(quality, "written", written)
    good = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(6)]
    rows = [(1, good[0]), (1, good[0]), (1, good[1]), (2, None), (2, ""), (None, good[2]), (None, "x"), (3, "x"), (4, good[3] + " ##" * 90)]
    frame = spark.createDataFrame([(k, t, "en", None, 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    monkeypatch.setattr(corpus_pipeline, "_labels", lambda *_: labels)
    out = corpus_pipeline.quality_rules(spark, frame, "").collect()
    old = quality.judge_quality(frame, labels, carry=["text", "lang", "source", "n_chars"]).where("kept").select(frame.columns)
    columns = columns[: columns.index("grow:boolean")]
    assert not any(c.endswith(":string") for c in columns)
    assert sorted(out, key=str) == sorted(old.collect(), key=str) and len(out) == 4
    assert corpus_pipeline.quality_rules(spark, frame.limit(0), "").count() == 0
