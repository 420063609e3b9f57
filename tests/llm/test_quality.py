from collections import Counter

from pyspark.sql import functions as F

from recordgauge.llm import quality_rules as q

LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (1, "the cat and the dog were in the house and it was not by the door of all"),
    (1, "the cat and the dog were in the house and it was not by the door of all"),
    (2, None), (3, ""), (4, "\n\n \t"), (None, "a b c d e a b c d e a b c d e"), (5, "one two"),
    (6, "x\x0by\x0cz\r\nx\x0by\x0cz\n x y \n"), (7, "a\x1cb é ü 😀😀 #*$%&|<>!! the of and to in is that for it as"),
    (8, LONG), (9, LONG + " " + LONG), (10, "Und " * 300), (11, "THE CAT!! AND!! THE!! DOG!! IN!! THE!! HOUSE!! IS!! NOT!! HERE!! NOW!!"),
]


def plain(text):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures_and_verdicts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("N_WORDS", F.lit(-1)).withColumn("_words", F.lit(1))
    rows = q.judge(docs).collect()
    assert len(rows) == len(ROWS)
    for (doc_id, text), r in zip(ROWS, rows, strict=True):
        assert r.doc_id == doc_id and tuple(r[c] for c in q.BASE) == plain(text), text
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = [r.kept for r in rows]
    assert kept[:2] == [True, True] and not any(kept[2:7]) and not any(kept[10:])
    assert q.judge(docs.limit(0)).count() == 0


def test_rules_are_a_table(spark):
    docs = spark.createDataFrame(ROWS[:1], "doc_id long, text string")
    strict = (q.Rule("short", "word_chars", "n_words", None, 1.0),)
    assert not q.judge(docs, rules=strict).first().kept


def test_plan_has_no_python_and_no_exchange(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    text = q.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Exchange" not in text and text.count("split(") <= 2
