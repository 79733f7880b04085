"""The models behind op5 and op8 against slow, plain versions; the curve and the mix of op9 and op4."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from rastermill.llm import language_id, mixing, packing, quality, queries
from tests.llm.helpers import SF, needs_tables


def plain_label_model(rows, steps=100):
    """EM over single texts, vote by vote."""
    n, prior = len(quality.LABELLERS), 0.9
    chance = [{"bad": {-1: 0.3, 0: 0.6, 1: 0.1}, "good": {-1: 0.02, 0: 0.48, 1: 0.5}} for _ in range(n)]

    def good(votes):
        like = {side: math.prod(chance[j][side][v] for j, v in enumerate(votes)) for side in ("bad", "good")}
        return prior * like["good"] / (prior * like["good"] + (1 - prior) * like["bad"])

    for _ in range(steps):
        each = [good(v) for v in rows]
        for j in range(n):
            for side, weight in (("good", each), ("bad", [1 - g for g in each])):
                seen = {v: 1.0 + sum(w for w, r in zip(weight, rows, strict=True) if r[j] == v) for v in (-1, 0, 1)}
                chance[j][side] = {v: s / sum(seen.values()) for v, s in seen.items()}
        prior = min(0.98, max(0.02, sum(each) / len(each)))
    return [good(v) for v in rows]


def test_label_model_matches_a_plain_em():
    rng = np.random.default_rng(4)
    truth = rng.random(150) < 0.7
    rows = np.array([[rng.choice([-1, 0, 1], p=[0.05, 0.5, 0.45] if t else [0.4, 0.5, 0.1]) for _ in quality.LABELLERS] for t in truth])
    patterns, counts = np.unique(rows, axis=0, return_counts=True)
    model = quality.LabelModel(patterns, counts.astype(float))
    found = model.posterior(rows)
    assert np.allclose(found, plain_label_model(rows.tolist()), atol=1e-6)
    assert ((found > 0.5) == truth).mean() > 0.9


def plain_mixture(ll, allowed):
    """Shares and log-likelihood of one document; ll: a list of log-likelihoods for each word."""
    share = [1 / len(allowed) if i in allowed else 0.0 for i in range(len(ll[0]))]
    for _ in range(language_id.STEPS):
        total = [0.0] * len(share)
        for word in ll:
            joint = [s * math.exp(v - max(word)) for s, v in zip(share, word, strict=True)]
            total = [t + x / sum(joint) for t, x in zip(total, joint, strict=True)]
        share = [t / len(ll) for t in total]
    return share, sum(max(w) + math.log(sum(s * math.exp(v - max(w)) for s, v in zip(share, w, strict=True))) for w in ll)


def test_language_sets_match_a_plain_em():
    rng = np.random.default_rng(6)
    table = np.log(rng.dirichlet(np.full(language_id.FEATURES, 0.01), 3).T + 1e-9).astype(np.float32)
    words = "thing other people there great strasse nicht schon durch grosse avec dans cette leur plus".split()
    texts = [" ".join(rng.choice(words, n)) for n in (1, 4, 30, 60, 200)] + ["", "12 !"]
    parsed = language_id.Words(texts)
    best, score, shares = language_id.languages(parsed, len(texts), table)
    ll = np.add.reduceat(table[parsed.grams].astype(float), parsed.starts, axis=0)
    for i in range(len(texts)):
        mine = ll[parsed.text_of == i].tolist()
        if not mine:
            assert best[i] == -1 and score[i] == 0
            continue
        full, _ = plain_mixture(mine, {0, 1, 2})
        order = sorted(range(3), key=lambda j: -full[j])
        tried = [{j} for j in range(3)] + [set(order[:2]), {0, 1, 2}]
        fits = []
        for chosen in tried:
            share, fit = plain_mixture(mine, chosen)
            fits.append((fit - language_id.PENALTY * len(chosen) * math.log(len(mine) + 1), share))
        value, share = max(fits, key=lambda f: f[0])
        assert np.allclose(shares[i], share, atol=2e-3), (i, shares[i], share)
        assert best[i] == int(np.argmax(share)) and abs(score[i] - full[best[i]]) < 2e-3


def test_hilbert_neighbours_in_four_dimensions():
    points = np.array(list(itertools.product(range(4), repeat=4)))
    order = points[np.argsort(packing.hilbert_index(points, 2))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


@needs_tables
def test_sequences_hold_neighbours_on_the_curve(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    curve = {r["doc_id"]: r["curve"] for r in packing.tokenize(docs, queries.default_tokenizer(), 1).collect()}
    rows = packing.pack(docs, queries.default_tokenizer()).collect()
    placed = [curve[r["doc_id"]] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    steps = sum(b < a for a, b in itertools.pairwise(placed))
    assert steps <= len({r["sequence_id"] >> 32 for r in rows})  # keys rise but where another range begins


def test_tokenizers_that_keep_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["two  spaces\nand a line", " leading", "", "don't  stop\t!"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, 64, 50256).collect()
    got = {i: sum((np.frombuffer(r["ids"], "<u4").tolist() for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] == i), []) for i in range(len(texts))}
    assert got == {i: [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 50256] for i, t in enumerate(texts)}


@needs_tables
def test_repeated_documents_reach_the_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = mixing.text_size(F.col("text"))
    target = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    largest = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.max(size).alias("n")).collect()}
    taken = {r["source"]: r["n"] for r in mixing.repeat_documents(docs).groupBy("source").agg(F.sum(size).alias("n")).collect()}
    assert all(abs(taken.get(s, 0) - t) <= 0.02 * t + 3 * largest[s] for s, t in target.items())
