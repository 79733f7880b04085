"""Long and many: lines of one text, words without spaces, one id and text in two sources."""

import time

import numpy as np
import pyarrow as pa

from rastermill.llm import language_id, mixing, packing, toxicity
from rastermill.llm.line_dedup import drop_frequent_lines
from rastermill.llm.queries import default_tokenizer


def test_many_lines(spark):
    text = "\n".join(f"line {i}" for i in range(200_000))
    rows = spark.createDataFrame([(i, f"common\n{text if i == 0 else i}") for i in range(12)], "doc_id long, text string")
    drop_frequent_lines(rows.limit(0)).count()
    kept = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in drop_frequent_lines(rows).collect()}
    assert kept[0] == (text, 200_001, 1) and kept[5] == ("5", 2, 1)


def test_last_step_is_linear_in_lines(spark):
    """The lines of a text are split once, not once for each that stays."""
    from rastermill.llm import line_dedup as L

    text = "\n".join(f"line {i}" for i in range(40_000))
    rows = spark.createDataFrame([(i, f"common\n{text if i == 0 else i}") for i in range(12)], "doc_id long, text string")
    done = drop_frequent_lines(rows)
    start = time.time()
    assert done.where("doc_id = 0").first()["n_dropped"] == 1 and L.PLACES not in done.columns
    assert time.time() - start < 20


def test_words_without_spaces_are_not_kept():
    words = packing.WordIds(default_tokenizer(), 5_000)
    texts = ["漢字" * 25_000 + str(i) for i in range(20)] + ["x" * 100_000, "a," * 9_000]
    words.ids(texts)
    assert not words.words and max(map(len, words.parts), default=0) <= packing.LONGEST_KEPT
    words.ids(["short words are kept"])
    assert set(words.words) == {"short", "words", "are", "kept"}
    for i in range(60):
        words.ids([" ".join(f"w{i}x{k}" for k in range(1_000))])
    assert len(words.words) <= 6_000 and len(words.parts) <= 6_000


def test_one_text_in_two_sources(spark):
    text = "a few words " * 40
    rows = [(1, text, "x"), (1, text, "y")] + [(i, f"{i} {text}", "x") for i in range(2, 40)]
    counts = {(r["doc_id"], r["source"]): r["count"] for r in mixing.repeat_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("doc_id", "source").count().collect()}
    taken = {r["source"]: round(r["taken"] / r["size"]) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id = 1").collect()}
    assert counts.get((1, "y"), 0) == taken["y"] == 3 and counts.get((1, "x"), 0) == taken["x"]


def test_more_than_256_languages(spark):
    rng = np.random.default_rng(2)
    letters = [rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5, replace=False) for _ in range(300)]
    text = lambda i: " ".join("".join(rng.choice(letters[i], 6)) for _ in range(60))
    training = spark.createDataFrame([(text(i), f"l{i:03}") for i in range(300) for _ in range(3)], "text string, lang string")
    langs, table = language_id.learn(training)
    assert len(langs) == 300 and table.shape == (language_id.FEATURES // 2, 300)
    rows = spark.createDataFrame([(i, text(i)) for i in range(0, 300, 30)], "doc_id long, text string")
    assert all(r["lang_pred"] == f"l{r['doc_id']:03}" for r in language_id.identify(rows, training).collect())


def test_toxicity_slices_keep_rows_and_order():
    texts = ["a b c " * 60_000, None, "", "x y z " * 200_000] + [f"word {i} here" for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    use = lambda part, x: (part.column(0).to_pylist(), x)
    found = list(toxicity.feature_rows(b"toxic words here", b"plain words here", use)([batch]))
    whole = toxicity.Distances(b"toxic words here", b"plain words here")
    assert len(found) > 3 and sum((ids for ids, _ in found), []) == list(range(len(texts)))
    assert (np.concatenate([x for _, x in found]) == np.array([whole.features(t or "") for t in texts])).all()
