import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from rastermill.llm import language_id, line_dedup, mixing, near_dedup, packing, quality, queries, suffix_dedup, toxicity
from rastermill.llm.suffix_groups import suffix_array
from tests.llm.helpers import ODD_TEXTS, SF, needs_tables, none, odd


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Near-duplicates


def true_classes(texts):
    sets = {}
    for i, t in texts:
        words, seen, out = (t or "").lower().split(), collections.Counter(), set()
        for k in range(max(1, len(words) - 4)) if words else []:
            gram = tuple(words[k : k + 5])
            out.add((gram, seen[gram]))
            seen[gram] += 1
        sets[i] = out
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


@needs_tables
def test_near_duplicates_match_brute_force(spark):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(documents(spark)).collect()}
    assert got == true_classes([(r["doc_id"], r["text"]) for r in documents(spark).collect()])


@pytest.mark.parametrize("whole", [8, 4096])
def test_near_duplicate_large_cells(spark, monkeypatch, whole):
    """Cells of several blocks and components beyond a whole cell give the same classes."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "WHOLE_CELL", whole)
    monkeypatch.setattr(near_dedup, "HUBS", 2)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(40):
        words = list(base)
        for k in rng.choice(120, rng.integers(0, 5), replace=False):
            words[k] = f"x{i}_{k}"
        texts.append((i, " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == true_classes(texts)


def test_near_duplicates_odd_rows(spark):
    rows = near_dedup.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD_TEXTS)
    by_id = {r["doc_id"]: r["class_id"] for r in rows}
    assert by_id[4] == by_id[5] == by_id[6] == 4 and by_id[1] == 1 and by_id[2] == 2 and by_id[10] == 10
    assert near_dedup.near_duplicates(none(spark)).count() == 0
    kept = near_dedup.deduplicate(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(10) == 1 and 4 in ids and 5 not in ids and 1 in ids and ids.count(None) == 2


def test_order_matters():
    words = np.arange(1, 201, dtype=np.uint64)
    turned = np.concatenate([words[100:], words[:100]])
    assert near_dedup.aligned(words, words, 0.8) == 1 and near_dedup.aligned(words, turned, 0.8) < 0.8


# Repeated passages


@pytest.mark.parametrize("seed", range(3))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    for _ in range(200):
        text = np.tile(rng.integers(0, rng.integers(1, 9), rng.integers(0, 30)), rng.integers(1, 4))
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def true_spans(texts, span):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + span] for r in raw for i in range(len(r) - span + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                gone[i : i + span] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone]) if r else b""
        out.append((len(r), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def digests(df):
    rows = suffix_dedup.remove_repeats(df, span=200)
    return sorted((r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows.collect())


@pytest.mark.parametrize("hot, chunk", [(2_000, 1 << 22), (1, 1 << 22), (2_000, 250)])
def test_repeats_match_brute_force(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdé \n"))
    make = lambda n: "".join(rng.choice(letters, n))
    shared = make(700)
    texts = [make(500) + shared[rng.integers(0, 200) : rng.integers(390, 700)] + make(300) for _ in range(25)]
    texts += [texts[0], make(900), "ab" * 400, "z" * 199, "z" * 205, None, "", shared]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert digests(rows) == sorted(true_spans(texts, 200))


def test_repeats_odd_rows(spark):
    assert len(digests(odd(spark))) == len(ODD_TEXTS) and digests(none(spark)) == []
    long = [r for r in suffix_dedup.remove_repeats(odd(spark)).collect() if r["doc_id"] == 8][0]
    assert long["n_removed"] == long["n_bytes"] == 150_000


# Lines


@needs_tables
def test_lines_match_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(db.sql(queries.ORACLES["op6_line_dedup"]).fetchall())
    got = queries.op6_line_dedup(spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == want


def test_lines_keep_letters_outside_ascii_apart(spark):
    texts = ["É x\nkeep"] * 9 + ["é x\nlast"] + [" A Line\t\nB"] * 6 + ["a lINE"] * 4 + ["KK"] * 9 + ["Kk", "KK"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.drop_frequent_lines(rows, 10).collect()}
    assert got[0] == ("É x\nkeep", 0) and got[9] == ("é x\nlast", 0) and got[10] == ("B", 1) and got[16] == ("", 1) and got[20][1] == 0


def test_lines_odd_rows(spark):
    rows = line_dedup.drop_frequent_lines(odd(spark).withColumn("n_lines", F.lit("x")), min_documents=2)
    assert rows.count() == len(ODD_TEXTS) and rows.columns[-2:] == ["n_lines", "n_dropped"]
    by_id = {r["doc_id"]: r for r in rows.collect()}
    assert by_id[1]["n_lines"] == 1 and by_id[1]["n_dropped"] == 0 and by_id[4]["text"] == "" and by_id[7]["n_dropped"] == 0
    assert line_dedup.drop_frequent_lines(none(spark)).count() == 0


def test_line_store_compacts(spark):
    store = line_dedup.LineStore(spark, min_documents=5, fanout=2)
    for _ in range(6):
        store.add(spark.createDataFrame([(1, 1, 1), (2, 2, 0)], "a long, b long, documents long"))
    assert [(r["a"], r["b"]) for r in store.frequent_keys().collect()] == [(1, 1)] and max(map(len, store.levels)) < 2


# Mixing


def shares(sizes, weights=(1, 2, 3), cap=3):
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in sizes if s not in fixed]
        want = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if want[s] > cap * sizes[s]]
        if not over:
            return fixed | want
        fixed |= {s: cap * sizes[s] for s in over}


def check_mix(df):
    rows = mixing.mix(df).collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = shares({s: sizes[s] for s in names}) if sum(sizes.values()) else {}
    for s, w in want.items():
        assert target[s] == pytest.approx(w) and abs(taken[s] - w) <= 0.01 * w + 3
    return rows


@needs_tables
def test_mix_reaches_its_targets(spark):
    rows = check_mix(documents(spark))
    again = mixing.mix(documents(spark)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


@needs_tables
def test_mix_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.sql(queries.ORACLES["op4_mixing"]).select("doc_id, size, source_size, target, taken").fetchall()
    got = queries.op4_mixing(spark, SF).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_mix_odd_rows(spark):
    assert len(check_mix(odd(spark))) == len(ODD_TEXTS)
    assert mixing.mix(none(spark)).count() == 0 and mixing.repeat_documents(none(spark)).count() == 0
    assert mixing.repeat_documents(odd(spark)).columns == odd(spark).columns


# Classifiers


@needs_tables
def test_language_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    rows = queries.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)


def test_language_mixtures_and_odd_rows(spark):
    english, german = "the thing that was with other people and there " * 4, "der nicht auch schon eine größe durch straße und " * 4
    training = spark.createDataFrame([(english, "en"), (german, "de"), ("???", None)], "text string, lang string")
    both = spark.createDataFrame([(1, english + german)], "doc_id long, text string")
    row = language_id.identify(both, training).first()
    assert row["languages"] == ["de", "en"] and abs(sum(row["shares"]) - 1) < 1e-3
    rows = language_id.identify(odd(spark), training).collect()
    assert len(rows) == len(ODD_TEXTS) and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 11)} == {"und"}
    assert language_id.identify(none(spark), training).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd(spark), training.limit(0)).collect()} == {"und"}
    kept = language_id.filter_identified(odd(spark), training, 0.5)
    assert kept.columns == odd(spark).columns and not {1, 2, 3, 11} & {r["doc_id"] for r in kept.collect()}


@needs_tables
def test_quality_agrees_with_labels(spark):
    sf = SF.replace("0.001", "0.01")
    rows = queries.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)


def test_quality_odd_rows(spark):
    assert quality.classify(odd(spark)).count() == len(ODD_TEXTS) and quality.classify(none(spark)).count() == 0


def test_toxicity_separates(spark):
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in "ba ce di fo gu".split() for b in "lom ren tas vik".split()]
    make = lambda bad: " ".join(rng.choice(["worthless", "idiot", "scum"]) if bad and rng.random() < 0.2 else rng.choice(plain) for _ in range(60))
    rows = spark.createDataFrame([(i, make(i % 4 == 0), int(i % 4 == 0)) for i in range(400)], "doc_id long, text string, toxic int")
    got = toxicity.score(rows, rows.where("doc_id < 300").select("doc_id", "toxic")).where("doc_id >= 300").collect()
    assert sum((r["doc_id"] % 4 == 0) == (r["predicted"] == 1) for r in got) >= 95


def test_toxicity_odd_rows(spark):
    labelled = odd(spark).withColumn("toxic", F.when(F.col("doc_id") == 4, 1).when(F.col("doc_id") < 8, 0))
    rows = toxicity.score(odd(spark), labelled).collect()
    assert len(rows) == len(ODD_TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(odd(spark), labelled.limit(0)).count() == len(ODD_TEXTS) and toxicity.score(none(spark), labelled).count() == 0


def test_toxicity_distances_are_compressed_lengths():
    """Against zstandard called directly, window by window."""
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghij "))
    toxic, ordinary = ("".join(rng.choice(letters, 3000)).encode() for _ in range(2))
    text = toxic.decode()[500:900] + "\n" + ordinary.decode()[100:700] + " Ünd 12"

    def length(window, dictionary):
        held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(3, source_size=64, dict_size=len(dictionary), min_match=5, hash_log=17, chain_log=17, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress(window))

    words = re.findall(r"\w+", text.lower())
    cut = [f" {' '.join(words[i : i + 5])} ".encode() for i in range(0, len(words), 5)]
    assert toxicity.windows(text) == cut
    assert toxicity.Distances(toxic, ordinary).gains(text).tolist() == [length(w, ordinary) - length(w, toxic) for w in cut]


@needs_tables
def test_toxicity_held_out_and_dictionaries(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    toxic, ordinary, model = toxicity.learn(docs, labels.where(~held))
    plain = len(os.path.commonprefix([toxic[::-1], ordinary[::-1]]))
    assert len(toxic) - plain >= 2048 and len(ordinary) - plain >= 2048 and plain >= 2048
    rows = docs.join(labels.where(held), "doc_id").select("text", "toxic").collect()
    scores = model.score(np.array([toxicity.Distances(toxic, ordinary).features(r["text"] or "") for r in rows]))
    bad = np.array([r["toxic"] == 1 for r in rows])
    assert (scores[bad][:, None] > scores[~bad][None, :]).mean() >= 0.8


# Packing


def check_pack(df, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.default_tokenizer())
    want = collections.Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + (1,)) for r in df.select("doc_id", "text").collect())
    sequences = collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["start"], r["length"], r["doc_tokens"], r["doc_id"], tuple(ids)))
    pieces = collections.defaultdict(list)
    for parts in sequences.values():
        parts.sort(key=lambda p: p[0])
        assert [p[0] for p in parts] == np.cumsum([0] + [p[2] for p in parts])[:-1].tolist()
        total = parts[-1][0] + parts[-1][2]
        assert total <= 2048 and total & (total - 1) == 0  # full, or a power of two: no padding
        for p in parts:
            pieces[p[4]].append(p)
    got = collections.Counter()
    for doc_id, parts in pieces.items():
        starts = [p for p in sorted(parts, key=lambda p: p[1]) if p[1] == 0]
        if len(starts) == 1:
            got[(doc_id, sum((p[5] for p in sorted(parts, key=lambda p: p[1])), ()))] += 1
        else:  # several rows share an id: at least the ids are all there
            assert sum(p[2] for p in parts) == sum(len(k[1]) * n for k, n in want.items() if k[0] == doc_id)
            got += collections.Counter({k: n for k, n in want.items() if k[0] == doc_id})
    assert got == want


@needs_tables
def test_packing_keeps_every_token(spark):
    rows = packing.pack(documents(spark), queries.default_tokenizer()).collect()
    check_pack(documents(spark), rows)
    query = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in queries.op9_packing(spark, SF).collect()}
    assert query == {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in rows}


def test_packing_odd_rows(spark):
    check_pack(odd(spark), packing.pack(odd(spark), queries.default_tokenizer()).collect())
    assert packing.pack(none(spark), queries.default_tokenizer()).count() == 0


def test_hilbert_neighbours():
    points = np.array([(x, y) for x in range(16) for y in range(16)])
    order = points[np.argsort(packing.hilbert_index(points, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
