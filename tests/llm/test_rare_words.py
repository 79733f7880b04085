"""Toxic words that few of many toxic documents have."""

import random

from rastermill.llm import toxicity


def test_rare_toxic_words_are_learnt(spark):
    dice = random.Random(4)
    name = lambda letters: "".join(dice.choice(letters) for _ in range(9))
    plain, bad = [name("aeioulmnrst") for _ in range(400)], [name("bdfgkpvwxz") for _ in range(300)]
    rows = []
    for i in range(6000):
        words = [dice.choice(plain) for _ in range(20)]
        if i % 2:
            at = 3 * dice.randrange(6)
            words[at : at + 3] = [bad[i // 2 % 300]] * 3
        rows.append((i, " ".join(words), i % 2))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = table.where("doc_id < 5400").select("doc_id", "toxic")
    held = repr(toxicity.learn(table, labels)[0])
    assert sum(w in held for w in bad) >= 270
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(table, labels).where("doc_id >= 5400").collect()}
    assert sum(p for i, p in found.items() if i % 2) >= 250 and sum(p for i, p in found.items() if i % 2 == 0) <= 30
