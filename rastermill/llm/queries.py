"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.llm import hard_negatives, language_id, line_dedup, mixing, near_dedup, packing, periodic, pieces, pivot_index, prefix_forest, quality, suffix_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), span=200)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivot_index.integer_vectors(table(spark, sf_dir, "embeddings"), scale=1024.0)
    return pivot_index.top_k(vectors, "vec_id % 100 = 0", k=10)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_documents=10)
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(language_id.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    found = toxicity.score(docs, table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic"))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    found = language_id.identify(docs.select("doc_id", "text"), docs.where(~held_out).select("text", "lang"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "shares")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer(), sequence_tokens=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = prefix_forest.usable_vectors(table(spark, sf_dir, "embeddings"))
    return prefix_forest.nearest(vectors, "vec_id % 100 = 0", k=10)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.hard_negatives(hard_negatives.whole_vectors(rows, scale=256.0), "vec_id % 100 = 0")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).alias("listed"), "collapsed")
    longest = [(-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period")]
    milli = F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", *longest, milli, digest(F.col("listed")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = default_tokenizer("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    read = pieces.decode(coded.select("doc_id", "ids"), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_suffix_dedup, op3_topk, op4_mixing, op5_quality, op6_line_dedup, op7_toxicity, op8_language_id, op9_packing, op10_neighbours, op11_hard_negatives, op12_periodic_runs, op13_sentencepiece)}

ORACLES = {
    "op4_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || md5(coalesce(text, ''))) AS digest FROM documents),
named AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS ord FROM d GROUP BY source),
weighed AS (SELECT *, [1, 2, 3][(ord - 1) % 3 + 1] AS weight, (3 * source_size)::DOUBLE / [1, 2, 3][(ord - 1) % 3 + 1] AS ratio, sum(source_size) OVER () AS total FROM named),
levels AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
 / sum(weight) OVER (ORDER BY ratio, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM weighed),
aimed AS (SELECT source, source_size, ord, least((3 * source_size)::DOUBLE, (SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, ord LIMIT 1) * weight) AS target FROM levels),
blocked AS (SELECT *, CAST(greatest(1, floor(least(1000000.0::DOUBLE, target / 1000))) AS BIGINT) AS block FROM aimed),
counted AS (SELECT *, CAST(ceil(source_size / block) AS BIGINT) AS blocks FROM blocked),
slotted AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target * blocks / source_size) AS BIGINT) ELSE 0 END AS slots FROM counted),
celled AS (SELECT *, CAST(sum(slots) OVER (ORDER BY ord) - slots AS BIGINT) AS cell, length(bin(CAST(sum(slots) OVER () AS BIGINT) - 1)) AS bits FROM slotted),
cells AS (SELECT ord, blocks, bits, unnest(range(cell, cell + slots)) AS cell FROM celled),
ranked AS (SELECT ord, (row_number() OVER (PARTITION BY ord ORDER BY reverse(lpad(bin(cell), CAST(bits AS INTEGER), '0'))) - 1) % blocks AS block_no FROM cells),
times AS (SELECT ord, block_no, least(count(*), 3) AS times FROM ranked GROUP BY 1, 2),
placed AS (SELECT d.*, c.source_size, c.ord, c.target, c.block, sum(size) OVER (PARTITION BY c.ord ORDER BY digest) - size AS start FROM d JOIN celled c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, source,
 CAST(coalesce((SELECT sum((least(start + size, (block_no + 1) * block) - greatest(start, block_no * block)) * times) FROM times t WHERE t.ord = placed.ord AND block_no * block < start + size AND (block_no + 1) * block > start), 0) AS BIGINT) AS taken FROM placed""",
    "op3_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS vector FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.vector, c.vector) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op6_line_dedup": r"""
WITH doc AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
line AS (SELECT row_no, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM doc),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT row_no) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k GROUP BY row_no, doc_id""",
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS vector FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.vector, c.vector) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5""",
}
