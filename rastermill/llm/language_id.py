"""Language identification by multilingual mixtures.

Letter trigrams, hashed to a table, give each word a likelihood under each language. For each
document expectation-maximisation estimates the share of its words in each language; the set
of languages is the one with the best likelihood less a penalty for each language in it. The sets
tried are single languages and, for each size, the languages with the largest shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import SLICE_BYTES, slices

FEATURES, SLICE, STEPS, PENALTY, SMOOTHING, TABLE_CELLS = 1 << 16, 64, 12, 3.0, 0.05, 1 << 24


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space for what isn't a letter."""
    chars = np.arange(0x110000, dtype=np.uint32).view("U1")
    low = np.strings.lower(chars).astype("U1").view(np.uint32)
    return np.where(np.strings.isalpha(chars), low, 32).astype(np.uint32)


class Words:
    """The trigrams of several texts, and where words and texts begin among them."""

    def __init__(self, texts: list[str]):
        joined = " " + " \n ".join(texts) + "  "
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.cumsum([0] + [len(t) + 3 for t in texts])
        code = letters()[raw]
        is_letter = code != 32
        # A word's trigrams are those of " word ", each filed under its middle letter.
        middle = np.flatnonzero(is_letter)
        mixed = code[middle - 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + code[middle].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + code[middle + 1].astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        mixed ^= mixed >> np.uint64(29)
        self.grams = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)
        self.starts = np.flatnonzero(~is_letter[middle - 1]) if len(middle) else np.zeros(0, np.int64)
        places = middle[self.starts] if len(middle) else np.zeros(0, np.int64)
        self.text_of = np.searchsorted(bounds, places, side="right") - 1
        self.gram_text = np.searchsorted(bounds, middle, side="right") - 1


def gram_counts(df: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                langs = np.array(part.column(1).to_pylist(), object)
                words = Words([t or "" for t in part.column(0).to_pylist()])
                owner = langs[words.gram_text]
                for lang in set(langs):
                    total.setdefault(lang, np.zeros(FEATURES, np.int64))
                    total[lang] += np.bincount(words.grams[owner == lang], minlength=FEATURES)
        for lang, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["lang", "gram", "n"])

    return df.select("text", "lang").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(df: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of (text, lang), sorted, and the log-likelihood of each gram in each.

    What comes to the driver is at most FEATURES numbers a language, one language at a time, and what goes
    to the tasks is a table of at most TABLE_CELLS numbers however many languages there are: beyond 256 of
    them, trigrams share features (half as many for twice the languages).
    """
    known = gram_counts(df.where(F.col("lang").isNotNull()))
    columns, size = {}, FEATURES
    for r in known.groupBy("lang").agg(F.collect_list("gram").alias("grams"), F.collect_list("n").alias("counts")).toLocalIterator():
        columns[r["lang"]] = np.bincount(np.array(r["grams"]) % size, weights=r["counts"], minlength=size)
        while size > 1 and size * len(columns) > TABLE_CELLS:
            size //= 2
            columns = {lang: c[:size] + c[size:] for lang, c in columns.items()}
    langs = sorted(columns)
    table = np.array([columns[lang] for lang in langs]).reshape(len(langs), size).T + SMOOTHING
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def mixture(ll: np.ndarray, doc: np.ndarray, docs: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (docs x languages) and log-likelihoods; `allowed` says which languages each may have.

    ll: words x languages, words of a document adjacent; doc: the document of each word.
    """
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    present = doc[first]
    count = np.bincount(doc, minlength=docs)[present][:, None]
    top = ll.max(axis=1, keepdims=True)
    like = np.exp(ll - top)
    share = (allowed / allowed.sum(axis=1, keepdims=True)).astype(np.float32)
    for step in range(STEPS + 1):
        joint = like * share[doc]
        whole = np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
        if step == STEPS:
            break
        share[present] = np.add.reduceat(joint / whole, first, axis=0) / count
    fit = np.zeros(docs)
    fit[present] = np.add.reduceat((np.log(whole) + top)[:, 0].astype(np.float64), first)
    return share, fit


def languages(words: Words, docs: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document: its main language (-1: no letter), that one's share, and all shares."""
    n = table.shape[1]
    best, score, shares = np.full(docs, -1), np.zeros(docs), np.zeros((docs, n), np.float32)
    if not len(words.starts) or not n:
        return best, score, shares
    ll = np.add.reduceat(table[words.grams % len(table)], words.starts, axis=0)
    doc = words.text_of
    count = np.bincount(doc, minlength=docs)
    has = np.flatnonzero(count)
    full, fit = mixture(ll, doc, docs, np.ones((docs, n), np.float32))
    sums = np.zeros((docs, n))
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    sums[doc[first]] = np.add.reduceat(ll.astype(np.float64), first, axis=0)
    best[has] = sums[has].argmax(axis=1)
    shares[has, best[has]] = 1
    value = sums.max(axis=1) - PENALTY * np.log(count + 1)
    # No set of several languages fits better than all together, so most documents end here.
    open_ = has[fit[has] - 2 * PENALTY * np.log(count[has] + 1) > value[has]]
    if len(open_):
        at = np.flatnonzero(np.isin(doc, open_))
        dense = np.searchsorted(open_, doc[at])
        order = np.argsort(-full[open_], axis=1, kind="stable")
        for size in range(2, n + 1):
            allowed = np.zeros((len(open_), n), np.float32)
            np.put_along_axis(allowed, order[:, :size], 1, axis=1)
            part, fits = mixture(ll[at], dense, len(open_), allowed)
            gain = fits - PENALTY * size * np.log(count[open_] + 1)
            better = gain > value[open_]
            value[open_[better]] = gain[better]
            shares[open_[better]] = part[better]
        best[open_] = shares[open_].argmax(axis=1)
    score[has] = np.minimum(full[has, best[has]], 1)
    return best, score, shares


def slice_bytes(languages: int) -> int:
    """Words by languages stay about as many whatever the number of languages."""
    return SLICE_BYTES * 16 // max(16, languages)


def identify(df: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, languages, shares) for each row of `df` (doc_id, text).

    `training` has text and lang; rows without lang are ignored. `lang_pred` is the language with
    the largest share in the chosen set, `score` its share when all languages compete. Null and
    empty texts and texts without a letter are `und`, score 0; so are all if nothing was
    learned. Any number of languages is learnt (see learn()). Of languages that tie the first by name is chosen. Texts of any length are read whole.
    Null doc_ids stay, repeated rows are scored each, an empty table gives no rows; other columns
    are not read.
    """
    langs, table = learn(training)
    model = df.sparkSession.sparkContext.broadcast((langs, table))  # at most TABLE_CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, likelihoods = model.value
        for batch in batches:
            for part in slices(batch, 1, SLICE, slice_bytes(len(names))):
                texts = [t or "" for t in part.column(1).to_pylist()]
                best, score, shares = languages(Words(texts), len(texts), likelihoods)
                sets = [np.flatnonzero(s > 0) for s in shares]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([names[b] if b >= 0 else "und" for b in best], pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array([[names[i] for i in s] for s in sets], pa.list_(pa.string())),
                        pa.array([[float(v[i]) for i in s] for s, v in zip(sets, shares, strict=True)], pa.list_(pa.float64())),
                    ],
                    ["doc_id", "lang_pred", "score", "languages", "shares"],
                )

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def filter_identified(df: DataFrame, training: DataFrame, least_share: float) -> DataFrame:
    """The rows of `df` whose text has a language with at least `least_share` of its words.

    Null and empty texts and texts without a letter go, and so do all if nothing was learned. Rows with
    null doc_ids and repeated rows are judged each; all columns of `df` stay as they are, an empty table
    gives an empty table.
    """
    langs, table = learn(training)
    model = df.sparkSession.sparkContext.broadcast(table)  # at most TABLE_CELLS numbers
    text_at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_at, SLICE, slice_bytes(len(langs))):
                texts = [t or "" for t in part.column(text_at).to_pylist()]
                best, _, shares = languages(Words(texts), len(texts), model.value)
                yield part.filter(pa.array((best >= 0) & (shares.max(axis=1, initial=0) >= least_share)))

    return df.mapInArrow(run, df.schema)
