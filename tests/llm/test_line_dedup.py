"""Line dedup and the pipeline against loops over all pairs."""

import random

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_ngram_join import edited, shingles
from tidemark.llm import common, line_dedup


def brute(rows):
    """{row: lines to drop}; rows are (key, text), and of one key at most one has a text."""
    order = lambda k: (k is None, k or 0)
    lines = [(order(k), at, i, shingles(line), line)
             for i, (k, text) in enumerate(rows) for at, line in enumerate((text or "").split("\n"))]
    index, drop = {}, {i: set() for i in range(len(rows))}
    for x in lines:
        for s in x[3]:
            index.setdefault(s, []).append(x)
    for k, at, i, s, line in lines:
        for other in {id(y): y for g in s for y in index[g]}.values():
            if other[:2] < (k, at) and 4 * len(s & other[3]) >= 3 * len(s | other[3]):
                drop[i].add(at)
                break
    return drop


def check(spark, rows):
    frame = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lost long")
    drop = brute(rows)
    out = line_dedup.drop_later_lines(frame).collect()
    assert len(out) == len(rows)
    for r in out:
        text = rows[r.lost][1]
        kept = [x for at, x in enumerate(text.split("\n")) if at not in drop[r.lost]] if text is not None else None
        assert r.text == (kept if kept is None else "\n".join(kept)), r.lost
        assert r.n_removed == len(drop[r.lost])


def test_query_against_all_pairs(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    drop = brute(rows)
    out = {r.doc_id: r for r in entry.queries()["op10_line_dedup"](spark, folder).collect()}
    assert len(out) == len(rows) and sum(map(len, drop.values())) > 0
    for i, (k, text) in enumerate(rows):
        assert out[k].n_removed == len(drop[i])
        assert out[k].text == "\n".join(x for at, x in enumerate(text.split("\n")) if at not in drop[i])


def test_near_copies_of_lines(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, base = [], []
    for key in range(120):
        lines = []
        for _ in range(rng.randint(1, 6)):
            if base and rng.random() < 0.5:
                words = edited(rng, rng.choice(base), vocabulary, rng.randint(0, 4)) or ["x"]
            else:
                words = rng.choices(vocabulary, k=rng.randint(1, 40))
                base.append(words)
            lines.append(" ".join(words))
        rows.append((key, "\n".join(lines)))
    check(spark, rows)


def test_odd_lines(spark):
    line = "a b c d e f g"
    check(spark, [(3, line), (1, line + "\n" + line.upper() + "\n\n"), (None, "x\n" + line), (2, None), (5, ""),
                  (6, "short\nshort"), (7, "y " * 5000 + "\n" + "y " * 4000), (8, " a\tb c  d e f g ")])


def test_lines_of_one_to_four_words(spark):
    notice = "All rights reserved."
    check(spark, [(1, f"{notice}\n\n\none two three four"), (2, f"x\n{notice}\nALL  rights\treserved."), (3, "x\none two three five"),
                  (4, "one two three four five\n \n\t"), (5, "x x\nx\nx x x"), (6, notice)])


def test_rows_without_keys_and_with_one_key(spark):
    line = "a b c d e f g"
    rows = [(None, f"{line}\nfirst"), (None, f"second\n{line}"), (7, f"{line}\nthird"), (7, f"fourth\n{line}"), (7, None), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.drop_later_lines(frame).collect()
    assert sorted(str(r.text) for r in out if line not in str(r.text)) == sorted(
        [t.replace(f"{line}\n", "").replace(f"\n{line}", "") for k, t in rows if t and k is None]
        + [next(t for t in ("third", "fourth") if all(line not in str(r.text) or t not in r.text for r in out))] + ["None", "None"])
    assert sum(line in str(r.text) for r in out) == 1 and {r.doc_id for r in out if line in str(r.text)} == {7}


def test_groups_of_near_copies(spark):
    """Near copies of one line, long ones and a chain: the second round finds what the first leaves."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows, chain = [], list(base)
    for key in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        chain[(key * 7) % 60] = f"y{key}"
        rows.append((rng.randrange(10**6) * 100 + key, " ".join(words) + "\n" + " ".join(chain)))
    long = [f"v{i}" for i in range(700)]
    rows += [(5_000 + i, " ".join(long[: 700 - 60 * i])) for i in range(6)]
    check(spark, rows)


def test_candidates_share_enough_of_their_prefixes(spark):
    """A pair leaves only if what its prefixes share, and all that comes behind them, is not enough."""
    def packed(size, pos):
        return (1 << 32) | (size << 8) | pos

    few = [(1, 2, packed(56, i), packed(56, i), 1) for i in range(6)]
    many = [(3, 4, packed(56, i), packed(56, i), 1) for i in range(7)]
    equal = [(5, 6, packed(56, i), packed(56, i), 2) for i in range(4)]  # shingles that share their half hash
    long = [(7, 8, packed(255, 3), packed(255, 3), 1)]
    rows = spark.createDataFrame(few + many + equal + long, "one long, two long, a long, b long, times long")
    assert {tuple(r) for r in line_dedup._candidates(rows, 3, 4).collect()} == {(3, 4), (5, 6), (7, 8)}


def test_words_lower_no_letters_but_a_to_z(spark):
    points = spark.range(1, 0x110000).where("id < 55296 or id > 57343").where("id not in (9, 10, 11, 12, 13, 32, 65279)")
    lines = points.selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') as line")
    wrong = lines.where(line_dedup._words() != F.array(common.lower_ascii("line")))
    assert lines.count() > 1_000_000 and wrong.limit(5).collect() == []


def test_halves_name_each_distinct_shingle_once(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["a b c d e f g h", "A b a b a b a b a b a b", "y " * 5000, "x x", "one", "\u00c9T\u00c9 \u00e9t\u00e9 b c d e\tf"]
    texts += [" ".join(rng.choices("abcd", k=rng.randint(1, 400))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "h long, line string")

    def sizes():
        return {r.h: r.tokens for r in line_dedup._with_halves(frame, 5).select("h", "tokens").collect()}

    for h, tokens in sizes().items():
        assert len(tokens) == len(shingles(texts[h])) and tokens == sorted(tokens), texts[h]
    monkeypatch.setattr(line_dedup.F, "hash", lambda *words: F.pmod(F.xxhash64(*words), F.lit(50)).cast("int"))
    for h, tokens in sizes().items():  # all lines of some length now hold a half twice
        assert len(tokens) == len(shingles(texts[h])), texts[h]


def test_tokens_of_hot_cells_come_last(spark):
    cell = line_dedup._CELLS
    rows = [([1, 1, 2, cell + 7, 9 * cell + 3],), ([7, 7, 8],), ([4, 5],), ([-cell + 7, 0, 7],)]
    frame = spark.createDataFrame(rows, "tokens array<int>")
    got = [r.t for r in frame.select(line_dedup._rare_first(F.col("tokens"), [7, 2]).alias("t")).collect()]
    assert got == [[1, 1, 9 * cell + 3, 2, cell + 7], [8, 7, 7], [4, 5], [0, -cell + 7, 7]]


def test_tables_of_a_step_are_deleted_after_it(spark, tmp_path, monkeypatch):
    made = iter(range(1000))
    monkeypatch.setattr(common, "scratch_path", lambda _, purpose: f"{tmp_path}/{purpose}-{next(made)}")
    line = "a b c d e f g h"
    frame = spark.createDataFrame([(1, line), (2, f"{line}\n{line} i"), (3, "other")], "doc_id long, text string")
    out = line_dedup.drop_later_lines(frame)
    assert next(made) > 5 and [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["lost-lines"]
    assert {r.doc_id: (r.text, r.n_removed) for r in out.collect()} == {1: (line, 0), 2: ("", 2), 3: ("other", 0)}


def test_equal_rows_keep_their_lines(spark):
    line = "a b c d e f g"
    same = spark.createDataFrame([(1, line, "k"), (1, line, "k")], "doc_id long, text string, n_removed string")
    assert [r.text for r in line_dedup.drop_later_lines(same).collect()] == [line, line]
    assert line_dedup.drop_later_lines(same.limit(0)).count() == 0


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, folder)
    assert first.columns == docs.columns and 0 < first.count() < docs.count()
    for stage in (corpus_pipeline.drop_lines, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_domains):
        assert stage(spark, docs, folder).columns == docs.columns
    from tests.llm.test_ngram_join import brute as components

    known = components([(r.doc_id, r.text) for r in docs.collect()])
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, folder).collect()}
    assert kept == {c for _, c in known.values()}
    pieces = corpus_pipeline.run(spark, folder)
    assert pieces.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(pieces.columns)


def test_near_copies_with_repeated_and_null_keys(spark):
    text = "one two three four five six"
    rows = [(1, text), (1, text), (2, text), (None, text + " x"), (None, None), (3, None)]
    frame = spark.createDataFrame([(k, t, "l", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, frame, "")
    assert sorted((str(r.doc_id), r.text is None) for r in out.collect()) == [
        ("1", False), ("3", True), ("None", False), ("None", True)]


def test_only_lines_that_may_match_are_read_again(spark, monkeypatch):
    """Pairs are verified in rounds on the hashes at hand; before, the shingles of all lines of pairs were written."""
    kept, write = {}, line_dedup.written

    def written(df, purpose, paths=None):
        out = write(df, purpose, paths)
        kept.setdefault(purpose, []).append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "written", written)
    monkeypatch.setattr(line_dedup, "_ROUND", 1)
    rows = []
    for i in range(40):  # lines of two shingles that share one
        rows += [(2 * i, f"a{i} b{i} c{i} d{i} e{i} x{i}"), (2 * i + 1, f"y{i} a{i} b{i} c{i} d{i} e{i}")]
    long = [f"w{i}" for i in range(40)]
    rows += [(100, " ".join(long)), (101, " ".join([*long[:-1], "z"])), (102, " ".join(long)), (None, " ".join(long[1:]))]
    check(spark, rows)
    assert sum(kept["line-pairs"]) > 3 and sum(kept["line-sets"]) <= 6
