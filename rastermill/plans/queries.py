"""Registered queries over rasters made of the test tables, and equal SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.functions import columns as C
from rastermill.functions import dimensions as D
from rastermill.functions.checksum import ordered_crc64, text_crc64
from rastermill.operators import decode, encode
from rastermill.operators import entropy as E
from rastermill.operators import geometry as G
from rastermill.operators import palette as P
from rastermill.operators import rasters as R
from rastermill.operators import rates
from rastermill.operators import splits as S
from rastermill.operators import streams as ST
from rastermill.operators.deal import dealt
from rastermill.operators.frontier import frontier_trees as grow_frontier
from rastermill.operators.tree import budget_prefix, coding_jobs, scratch, stored, taken_splits
from rastermill.sources.files import rgba_rows

ANGLE_BITS, LINE_LIMIT = 4, 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.from_embeddings(table(spark, sf_dir, "embeddings"))


def roots(pixels: DataFrame) -> DataFrame:
    return G.root_spans(R.sizes(pixels)).select("image_id", "y", "x0", "x1").withColumns({"angle_bits": F.lit(ANGLE_BITS), "line_limit": F.lit(LINE_LIMIT)})


def rounded(*names: str):
    return [F.round(n, 4).alias(n) for n in names]


# Values of the format, for the rows of a table


def angle_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's angle."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 512).cast("int").alias("angle"))
    return rows.join(F.broadcast(D.angles(spark)), "angle")  # 512 rows


def angle_table_int(spark, sf_dir):
    return angle_of(spark, sf_dir).select("o_orderkey", "angle", "sn", "cs")


def angle_table_real(spark, sf_dir):
    return angle_of(spark, sf_dir).select("o_orderkey", "angle", F.round("inv_sin", 12).alias("inv_sin"), F.round("minus_cot", 9).alias("minus_cot"))


def log2_values(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * F.col("p_size") % 65 + 1).cast("int").alias("n"))
    return rows.join(F.broadcast(D.log2_table(spark)), "n").select("p_partkey", "n", F.round(F.col("v").cast("double"), 5).alias("v"))  # 65 rows


def color_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 49).cast("int").alias("code"))
    return rows.select("c_custkey", "code", C.color_quant(F.col("code")).alias("quant"), C.palette_size(F.col("code")).alias("palette"))


def partition_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 500).alias("code"))
    parts = C.split_code(F.col("code"))
    return rows.select("p_partkey", "code", *(x.alias(f"f{i + 1}") for i, x in enumerate(parts)), C.join_code(*parts).alias("joined"))


def all_variants(spark, sf_dir):
    """Every variant for every image of lineitem."""
    images = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("image_id")).distinct()
    return images.join(F.broadcast(D.all_variants(spark)))  # 31,500 rows


def angle_bits(spark, sf_dir):
    code = F.col("p_partkey") % 500
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(C.angle_bits(code)).alias("level", "bits"))


def level_scale(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 13 % 2040 + 9).alias("width"), (F.col("c_custkey") * 29 % 2040 + 9).alias("height"), (F.col("c_custkey") * 7 % 500).alias("code"))
    return rows.select("c_custkey", F.posexplode(C.level_scale(F.col("width"), F.col("height"), F.col("code"))).alias("level", "scale"))


def image_tax(spark, sf_dir):
    width, height = F.col("p_partkey") * 31 % 2040 + 9, F.col("p_size") * 40 + 9
    return table(spark, sf_dir, "part").select("p_partkey", C.size_bits(width).cast("long").alias("bits"), F.round(C.image_tax(width, height), 6).alias("tax"))


# Parsing, bits, generators


def parse_numbers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.parse_int(F.col("c_name")).alias("number"))


def file_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.file_name(F.col("url")).alias("name"))


def variant_parse(spark, sf_dir):
    part = F.concat_ws(":", F.lower(F.hex(F.col("p_partkey") % 500)), F.when(F.col("p_partkey") % 7 == 0, "*").when(F.col("p_partkey") % 7 == 1, "7fffffffffffffff").when(F.col("p_partkey") % 7 == 2, "0000000000000041").otherwise(F.lower(F.hex(F.col("p_partkey") * 37 % 4095 + 1))), F.lower(F.hex(F.col("p_size").cast("long") + 1)))
    return D.parse_variants(table(spark, sf_dir, "part").select("p_partkey", part.alias("variants"))).select("p_partkey", "partition_code", "line_limit", "color_options")


def variant_records(spark, sf_dir):
    packed = D.pack_variants(variant_parse(spark, sf_dir))
    return D.unpack_variants(packed.select("p_partkey", "record")).select("p_partkey", F.hex("record").alias("record"), "partition_code", "line_limit", "color_options")


def option_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_partkey") % 49).cast("int")).alias("options"))
    return rows.select("l_orderkey", C.option_bits(F.col("options")).alias("bits"))


def single_bits(spark, sf_dir):
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("o_custkey") % 63).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.single_bit(bit).cast("int").alias("found"))


def crc64(spark, sf_dir):
    return text_crc64(table(spark, sf_dir, "documents").select("doc_id", "text"))


def xorshift(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.xorshift(F.col("o_orderkey") * 2654435761 % 4294967296).alias("next"), C.lcg(F.col("o_orderkey")).alias("lcg"))


def psnr(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(C.psnr(F.col("p_retailprice") / 100), 6).alias("psnr"))


# Rasters


def raster_lineitem(spark, sf_dir):
    return R.from_lineitem(table(spark, sf_dir, "lineitem"))


def rgba_pixels(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), F.lit(4).cast("long").alias("width"), F.unhex(F.concat(F.md5(F.col("c_name").cast("binary")), F.md5(F.col("c_mktsegment").cast("binary")))).alias("data"))
    return R.from_rgba(rows)


def prefix_sums(spark, sf_dir):
    return R.prefix_sums(emb(spark, sf_dir))


def square_sums(spark, sf_dir):
    return R.square_sums(emb(spark, sf_dir))


def region_stats(spark, sf_dir):
    pixels = emb(spark, sf_dir)
    spans = roots(pixels).withColumns({"x0": F.col("y"), "x1": 64 - F.col("y")})
    return G.region_stats(spans, R.prefix_sums(pixels), ["image_id"])


def region_level(spark, sf_dir):
    size = G.squared_size(roots(R.from_lineitem(table(spark, sf_dir, "lineitem"))).withColumns({"node": F.col("y") % 5, "x1": F.col("x1") - F.col("y")}), ["image_id", "node"])
    scale = C.level_scale(F.lit(32).cast("long"), F.lit(32).cast("long"), F.lit(215).cast("long"))
    return size.select("image_id", "node", "size", C.level_of(F.col("size"), scale).alias("level"))


# Geometry


def turned(spark, sf_dir):
    return roots(emb(spark, sf_dir)).join(F.broadcast(D.angles(spark).select("angle", "sn", "cs")))  # 512 rows


def ranges_of(spans: DataFrame) -> DataFrame:
    return G.distance_range(spans, ["image_id", "angle", "sn", "cs"]).select("image_id", "angle", "low", "high", "line_quant", "num_lines")


def distance_range(spark, sf_dir):
    return ranges_of(turned(spark, sf_dir))


def boundary_real(spark, sf_dir):
    """Where a line cuts each row by the rule of single precision that candidates are scored by."""
    cuts = turned(spark, sf_dir).withColumn("d", F.col("sn") * 20 + F.col("cs") * 5)
    return cuts.select("image_id", "angle", "y", G.boundary(exact=False).alias("x"))


def candidate_lines(spark, sf_dir):
    tried = S.candidates(roots(emb(spark, sf_dir)), ["image_id"])
    return tried.select("image_id", "angle_code", "line", "d", "num_lines")


def parts_of(spans: DataFrame) -> DataFrame:
    cuts = spans.withColumn("d", F.col("sn") * 20 + F.col("cs") * 5)
    return G.split_spans(cuts).select("image_id", "angle", "y", "side", "x0", "x1")


def split_line(spark, sf_dir):
    return parts_of(turned(spark, sf_dir))


def split_scores(spark, sf_dir):
    pixels = emb(spark, sf_dir)
    scored = S.line_sums(roots(pixels), pixels, ["image_id"], exact=True)
    return scored.select("image_id", "angle_code", "line", "l_c", F.round(S.split_score(), 4).alias("score"))


def split_scores_binned(spark, sf_dir):
    """All candidates of all angles, 63 lines each, by the rule that the encoder scores by."""
    pixels = emb(spark, sf_dir)
    spans = roots(pixels).withColumns({"angle_bits": F.lit(9), "line_limit": F.lit(63)})
    rows = stored(S.prefix_rows(R.prefix_sums(pixels)), f"{scratch(spark)}/rows")  # counted, then read
    scored = S.line_scores(spans, rows, ["image_id"])
    return scored.select("image_id", F.col("angle_code").alias("angle"), "line", "d", "num_lines", "l_c", F.round("score", 4).alias("score"))


def best_split(spark, sf_dir):
    pixels = emb(spark, sf_dir)
    _, best = S.best_splits(roots(pixels), R.prefix_sums(pixels), ["image_id"], exact=True)
    return best.select("image_id", "angle_code", "line", "d", "num_lines", F.round("score", 4).alias("score"))


def best_split_real(spark, sf_dir):
    """The best candidate as the encoder finds it."""
    pixels = emb(spark, sf_dir)
    _, best = S.best_splits(roots(pixels), R.prefix_sums(pixels), ["image_id"])
    return best.select("image_id", "angle_code", "line", "d", "num_lines", F.round("score", 4).alias("score"))


# Budget, colours, painting


def costs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("ordinal")).agg(F.sum(F.col("l_quantity").cast("long")).alias("cost")).withColumn("budget", F.lit(100))


def small_jobs(spark, sf_dir):
    """A budget for the tree of each order."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(0).alias("variant_id")).distinct()
    return jobs.withColumn("budget", 20.0 + F.col("image_id") % 40)


def small_trees(spark, sf_dir):
    """Nodes (sums, score, cost) of trees of 31 nodes with few different scores, one for each order."""
    k = F.explode(F.sequence(F.lit(1), F.lit(31))).alias("k")
    rows = dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id")), "image_id").select("image_id", k)
    mixed = (F.col("image_id") * 7919 + F.col("k") * F.col("k") * 104729 + F.col("k") * 31) % 1009
    sums = [(mixed * m % 5000 + F.col("k")).cast("long").alias(f"s{c}") for c, m in (("r", 3), ("g", 5), ("b", 7))]
    inner = (F.col("k") < 16) & (mixed % 11 != 0)
    cost = F.when(inner, 2 + (mixed % 24) / 4.0)
    node = F.translate(F.expr("substring(bin(k), 2)"), "01", "LR")
    return rows.select("image_id", F.lit(0).alias("variant_id"), "k", node.alias("node"), *sums, (mixed % 50 + 1).alias("c"), F.when(inner, mixed % 4 + 1.0).alias("score"), cost.alias("cost"))


def tree_splits(spark, sf_dir):
    """Splits that best-first search takes under a budget."""
    return taken_splits(small_trees(spark, sf_dir), small_jobs(spark, sf_dir)).select("image_id", "node", F.col("ordinal").cast("long").alias("ordinal"))


def tree_patches(spark, sf_dir):
    """Leaves of the trees of the first 1, 2, 3 splits."""
    nodes, jobs = small_trees(spark, sf_dir), small_jobs(spark, sf_dir)
    taken = stored(taken_splits(nodes, jobs), f"{scratch(spark)}/taken")  # it is read twice
    trials = jobs.select("image_id", "variant_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("color")).withColumns({"n": F.col("color").cast("long"), "quant": F.lit(17), "palette": F.lit(0)})
    found = encode.gather_patches(trials, nodes, taken)
    return found.select("image_id", "color", "node", F.col("seq").cast("long").alias("seq"), *rounded("r", "g", "b"), "c")


def budget_count(spark, sf_dir):
    return budget_prefix(costs(spark, sf_dir), ["l_orderkey"])


def quantized_colors(spark, sf_dir):
    pixels = emb(spark, sf_dir)
    means = pixels.groupBy("image_id", "y").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("c"))
    rows = means.join(F.broadcast(D.color_codes(spark).where("quant > 0")))  # 17 rows
    value = C.quantize(F.col("s") / F.col("c"), F.col("quant"))
    return rows.select("image_id", "y", "code", value.alias("v"), C.dequantize(value, F.col("quant")).alias("shown"))


def nearest_of(spark: SparkSession, pixels: DataFrame) -> DataFrame:
    patches = pixels.select("image_id", "y", "x", "r", "g", "b")
    palette = spark.range(8).select(F.col("id").alias("idx"), (F.col("id") * 36).alias("pr"), (255 - F.col("id") * 36).alias("pg"), (F.col("id") * 17).alias("pb"))
    palette = patches.select("image_id").distinct().join(F.broadcast(palette))  # 8 rows
    return P.nearest(patches, palette, ["image_id"], ["y", "x"])


def centres_of(near: DataFrame, pixels: DataFrame) -> DataFrame:
    near = near.join(pixels, ["image_id", "y", "x"])
    step = P.accumulate(near.select("image_id", "idx", F.col("r").alias("wr"), F.col("g").alias("wg"), F.col("b").alias("wb"), F.lit(1).alias("c")), ["image_id"])
    return step.select("image_id", "idx", *rounded("pr", "pg", "pb"), "c")


def nearest_palette(spark, sf_dir):
    return nearest_of(spark, emb(spark, sf_dir))


def palette_step(spark, sf_dir):
    return centres_of(nearest_palette(spark, sf_dir), emb(spark, sf_dir))


def simulated_error(spark, sf_dir):
    pixels = emb(spark, sf_dir)
    rows = pixels.groupBy("image_id", "y").agg(*(F.avg(c).alias(c) for c in ("r", "g", "b")), F.count(F.lit(1)).alias("c")).withColumn("quant", F.lit(17).cast("long"))
    shown = rows.withColumns({f"v{c}": C.dequantize(C.quantize(F.col(c), F.col("quant")), F.col("quant")) for c in ("r", "g", "b")})
    return encode.simulated_error(shown, ["image_id"]).select("image_id", *rounded("sqe"))


def simulated_colors(spark, sf_dir):
    """What each row's mean is shown as by each plain colour code, as the simulation of the encoder has it."""
    means = emb(spark, sf_dir).groupBy("image_id", "y").agg(*(F.avg(c).alias(c) for c in "rgb"))
    rows = means.join(F.broadcast(D.color_codes(spark).where("quant > 0")))  # 17 rows
    patches = rows.select("image_id", F.lit(0).alias("variant_id"), F.col("code").alias("color"), "quant", F.lit(0).alias("palette"), F.col("y").cast("string").alias("node"), "r", "g", "b")
    none = spark.createDataFrame([], "image_id long, variant_id int, color int, idx int, pr double, pg double, pb double")
    shown = encode.shown_colors(patches, none)
    return shown.select("image_id", F.col("node").cast("long").alias("y"), F.col("color").alias("code"), *(F.col(f"v{c}").cast("long").alias(f"v{c}") for c in "rgb"))


def best_variant(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("image_id"), (F.col("l_partkey") % 20).alias("variant_id"), (F.col("l_suppkey") % 17).alias("color"), (F.col("l_quantity") - 25).alias("sqe"))
    return encode.first_best(rows)


def render_spans(spark, sf_dir):
    cuts = turned(spark, sf_dir).where("angle = 96").withColumn("d", F.col("sn") * 20 + F.col("cs") * 5)
    shade = F.when(F.col("side") == "L", 200).otherwise(10).cast("long")
    return G.paint(G.split_spans(cuts).withColumns({"r": shade, "g": 255 - shade, "b": F.col("y")}))


# Entropy coding, whole streams


def header_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 31 % 2040 + 9).alias("w"), (F.col("p_size") * 40 + 9).cast("long").alias("h"))
    items = E.header_entries(F.col("w"), F.col("h"), F.col("id") % 500, F.col("id") % 63 + 1, F.col("id") % 49)
    return rows.select("id", F.posexplode(items).alias("pos", "e")).select("id", "pos", "e.value", "e.max")


def symbol_streams(spark, sf_dir):
    pos = F.struct("l_linenumber", F.lit(7).cast("long").alias("max"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(pos)).alias("p"))
    return rows.select("l_orderkey", F.transform("p", lambda e: F.struct((e["l_linenumber"] - 1).cast("long").alias("value"), e["max"].alias("max"))).alias("entries"))


def rans_roundtrip(spark, sf_dir):
    coded = symbol_streams(spark, sf_dir).withColumn("data", E.encode_stream("entries"))
    read = coded.withColumn("read", E.decode_stream("data", F.transform("entries", lambda e: e["max"])))
    same = F.col("read") == F.transform("entries", lambda e: e["value"])
    return read.select("l_orderkey", F.size("entries").alias("numbers"), same.alias("same"), F.hex("data").alias("data"))


def entropy_estimate(spark, sf_dir):
    return symbol_streams(spark, sf_dir).select("l_orderkey", F.round(E.entropy_bits(F.col("entries")), 6).alias("bits"))


def few_variants(spark: SparkSession) -> DataFrame:
    """Two partition codes, each with six plain colour codes and three palettes."""
    colors = sum(1 << c for c in (0, 3, 6, 9, 12, 16, 18, 22, 26))
    return spark.createDataFrame([(0, 215, 30, colors), (1, 120, 62, colors)], "variant_id int, partition_code int, line_limit int, color_options long")


def all_images(spark, sf_dir):
    """The cross, the images of lineitem and those of the embeddings."""
    vectors = emb(spark, sf_dir).withColumn("image_id", F.col("image_id") + 100)
    return R.cross(spark).unionByName(R.from_lineitem(table(spark, sf_dir, "lineitem"))).unionByName(vectors)


def encode_images(spark, sf_dir):
    return encode.encode_images(all_images(spark, sf_dir), few_variants(spark), target_size=200)


def supplier_crosses(spark, sf_dir, steps: int = 256):
    """A cross for each supplier, in two of its own colours; channels are such as `steps` steps can show."""
    shade = lambda k, more: C.div((F.col("s_suppkey") * k + more) % steps * 255, steps - 1)
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), *(shade(k, more).alias(f"{side}{c}") for side, more, ks in (("on", 1, (7, 13, 29)), ("off", 0, (3, 5, 11))) for c, k in zip("rgb", ks, strict=True)))
    cells = R.cross(spark).select("y", "x", (F.col("g") == 255).alias("on"))
    pixels = rows.join(F.broadcast(cells))  # 400 rows
    return pixels.select("image_id", "y", "x", *(F.when(F.col("on"), F.col(f"on{c}")).otherwise(F.col(f"off{c}")).alias(c) for c in "rgb"))


def one_color(spark: SparkSession, color: int) -> DataFrame:
    return spark.createDataFrame([(0, 215, 6, 1 << color)], "variant_id int, partition_code int, line_limit int, color_options long")


def decode_images(spark, sf_dir):
    """What the streams of the crosses say in front, and a digest of the pixels that they paint."""
    streams = encode.encode_images(supplier_crosses(spark, sf_dir), one_color(spark, 18), target_size=24).select("image_id", "data")
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b"))), lambda p: F.concat_ws(",", p["r"], p["g"], p["b"])), ";")
    painted = decode.decode_images(streams).groupBy("image_id").agg(F.md5(shown.cast("binary")).alias("digest"))
    return decode.read_headers(streams).join(painted, "image_id")


def odd_images(spark, sf_dir):
    """Of three suppliers one has a cross, one a plain image, one an image that is too small."""
    kind = F.col("image_id") % 3
    crosses = supplier_crosses(spark, sf_dir)
    return crosses.withColumns({c: F.when(kind == 1, 7).otherwise(F.col(c)).cast("long") for c in "rgb"}).where((kind != 2) | (F.col("x") < 4))


def encode_statuses(spark, sf_dir):
    """What is coded: the crosses without loss, within the target; the others not at all."""
    rows = encode.encode_images(odd_images(spark, sf_dir), one_color(spark, 18), target_size=24)
    return rows.select("image_id", "status", "variant_id", "color", F.round("mse", 3).alias("mse"), (F.octet_length("data") <= 24).alias("fits"))


def coded_and_decoded(spark: SparkSession, pixels: DataFrame, color: int, target: int) -> DataFrame:
    return decode.decode_images(encode.encode_images(pixels, one_color(spark, color), target_size=target).select("image_id", "data"))


def cross_by_palette(spark, sf_dir):
    """The crosses, coded with a palette and decoded."""
    return coded_and_decoded(spark, supplier_crosses(spark, sf_dir), 18, 24)


def cross_by_steps(spark, sf_dir):
    """The crosses, coded with quantised channels and decoded."""
    return coded_and_decoded(spark, supplier_crosses(spark, sf_dir, 9), 4, 60)


def frontier_trees(spark, sf_dir):
    """The trees of all images of the embeddings, a frontier at a time; SQL can't express it."""
    pixels = emb(spark, sf_dir)
    good = R.guarded(R.sizes(pixels)).where("reason IS NULL")
    jobs = coding_jobs(good, few_variants(spark).where("variant_id = 1"), 30)
    rows = stored(S.prefix_rows(R.prefix_sums(pixels.join(good, "image_id", "left_semi"))), f"{scratch(spark)}/rows")  # read in each turn
    nodes, taken = grow_frontier(jobs, rows)
    return nodes.join(taken, ["image_id", "variant_id", "node"]).select("image_id", "variant_id", "node", "ordinal", "angle_code", "line", "num_lines")


def stream_nodes(spark, sf_dir):
    """The nodes of all streams of the images of the embeddings; SQL can't express it."""
    coded = encode.encode_images(emb(spark, sf_dir), few_variants(spark), target_size=100)
    return ST.stream_nodes(coded.select("image_id", "data"))


def leaf_of_pixel(spark, sf_dir):
    """Each pixel of the suppliers' crosses with the colour of the decoded leaf that holds it."""
    crosses = supplier_crosses(spark, sf_dir)
    leaves = decode.decode_spans(encode.encode_images(crosses, one_color(spark, 18), target_size=24).select("image_id", "data"))
    held = ST.leaf_of_pixel(crosses.select("image_id", "y", "x"), leaves.select("image_id", "y", "x0", "x1", "r", "g", "b"))
    return held.select("image_id", "y", "x", "r", "g", "b")


def rate_curve(spark, sf_dir):
    """How many costs of each order 64 budgets pay for."""
    rows = costs(spark, sf_dir)
    budgets = rows.select("l_orderkey").distinct().withColumn("budget", F.explode(F.sequence(F.lit(5), F.lit(320), F.lit(5))))
    return rates.rate_curve(rows, budgets, ["l_orderkey"])


def patches_of_rows(spark, sf_dir):
    """A patch for each row of the embeddings' images: its mean, in whole steps, its size and its sums."""
    rows = emb(spark, sf_dir).groupBy("image_id", F.col("y").alias("seq")).agg(F.count(F.lit(1)).alias("c"), *(F.sum(c).alias(f"w{c}") for c in "rgb"))
    return rows.select("*", *(C.div(F.col(f"w{c}"), F.col("c")).alias(c) for c in "rgb"))


def palette_seeds(spark, sf_dir):
    seeds = rates.palette_seeds(patches_of_rows(spark, sf_dir), ["image_id"], 6)
    return seeds.select("image_id", F.posexplode("centres").alias("idx", "q")).select("image_id", "idx", *(F.col(f"q.{c}").cast("long").alias(f"p{c}") for c in "rgb"))


def palette_rounds(spark, sf_dir):
    found = rates.palette_rounds(rates.palette_seeds(patches_of_rows(spark, sf_dir), ["image_id"], 6), ["image_id"])
    return found.select("image_id", "round", F.round("error", 3).alias("error"), F.posexplode("centres").alias("idx", "q")).select("image_id", "round", "error", "idx", *(F.floor(F.col(f"q.{c}") + 0.5).alias(f"p{c}") for c in "rgb"))


def crc64_groups(spark, sf_dir):
    """The checksum of all texts of a language, one after the other in the order of their ids; SQL can't express it."""
    return ordered_crc64(table(spark, sf_dir, "documents").select("lang", "doc_id", "text"), ["lang"], "doc_id", "text")


def rgba_bytes(spark, sf_dir):
    """Images as interleaved RGBA, alpha 255."""
    return rgba_rows(emb(spark, sf_dir)).select("image_id", "width", "height", F.md5(F.hex("data").cast("binary")).alias("digest"))


def decode_streams(spark, sf_dir):
    """All streams of encode_images; SQL can't express it."""
    return decode.decode_images(encode_images(spark, sf_dir).select("image_id", "data"))


QUERIES = {f.__name__: f for f in (
    angle_table_int, angle_table_real, log2_values, color_codes, partition_codes, all_variants, angle_bits, level_scale, image_tax, parse_numbers, file_names, variant_parse, variant_records,
    option_sets, single_bits, crc64, xorshift, psnr, raster_lineitem, rgba_pixels, prefix_sums, square_sums, region_stats, region_level, distance_range, candidate_lines, split_line, split_scores,
    split_scores_binned, best_split, budget_count, quantized_colors, nearest_palette, palette_step, simulated_error, simulated_colors, best_variant, render_spans, header_entries, rans_roundtrip, entropy_estimate, encode_images, decode_images, decode_streams,
    boundary_real, best_split_real, tree_splits, tree_patches, encode_statuses, cross_by_palette, cross_by_steps, rgba_bytes,
    frontier_trees, stream_nodes, leaf_of_pixel, rate_curve, palette_seeds, palette_rounds, crc64_groups,
)}

ANGLES_SQL = """ang AS (SELECT i AS angle, CAST(floor(sin(i * pi() / 512) * 262144 + 0.5) AS BIGINT) AS sn, CAST(floor(cos(i * pi() / 512) * 262144 + 0.5) AS BIGINT) AS cs
 FROM (SELECT CAST(range AS INTEGER) AS i FROM range(512)))"""
RASTER_SQL = """cells AS (SELECT vec_id // 16 AS image_id, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) - 1 AS y, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings WHERE embedding IS NOT NULL),
reds AS (SELECT image_id, y, CAST(x AS BIGINT) AS x, CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS BIGINT) AS r FROM cells),
raster AS (SELECT image_id, y, x, r, 255 - r AS g, (r * 7 + x * 3) % 256 AS b FROM reds)"""
PREFIX_SQL = """prefix AS (SELECT image_id, y, x + 1 AS x, CAST(sum(r) OVER w AS BIGINT) AS sr, CAST(sum(g) OVER w AS BIGINT) AS sg, CAST(sum(b) OVER w AS BIGINT) AS sb, x + 1 AS c
 FROM raster WINDOW w AS (PARTITION BY image_id, y ORDER BY x ROWS UNBOUNDED PRECEDING)
 UNION ALL SELECT DISTINCT image_id, y, 0, 0, 0, 0, 0 FROM raster)"""
ROOT_SQL = "root AS (SELECT DISTINCT image_id, y, CAST(0 AS BIGINT) AS x0, CAST(64 AS BIGINT) AS x1 FROM raster)"
TURNED_SQL = "turned AS (SELECT root.*, angle, sn, cs FROM root, ang)"
REACH_SQL = """ends AS (SELECT image_id, angle, sn, cs, min(cs * y + sn * x0) AS low, max(cs * y + sn * (x1 - 1)) AS high FROM turned GROUP BY 1, 2, 3, 4),
quanta AS (SELECT *, CASE WHEN high - low > 262144 * 15 THEN (2 * (high - low) + 15) // 30 ELSE 262144 END AS line_quant FROM ends),
reach AS (SELECT *, greatest(1, (high - low) // line_quant) AS num_lines FROM quanta)"""
LINES_SQL = """numbered AS (SELECT *, unnest(range(num_lines)) AS line FROM reach WHERE angle % 32 = 0),
lines AS (SELECT image_id, angle // 32 AS angle_code, sn, cs, line, num_lines,
 CASE WHEN num_lines > 1 THEN low + (high - low - (num_lines - 1) * line_quant) // 2 + line_quant * line ELSE ((high + low + 4294967296) % 4294967296) // 2 END AS d FROM numbered)"""
CUT = "CASE WHEN sn = 0 THEN CASE WHEN y * cs >= d THEN x0 ELSE x1 END ELSE least(x1, greatest(x0, (2 * d + sn - 2 * y * cs) // (2 * sn))) END"
SCORE_SQL = f"""boundary AS (SELECT root.image_id, y, angle_code, line, d, num_lines, {CUT} AS x FROM root JOIN lines USING (image_id)),
lefts AS (SELECT b.image_id, angle_code, line, d, num_lines, sum(e.sr - p.sr) AS lr, sum(e.sg - p.sg) AS lg, sum(e.sb - p.sb) AS lb, sum(e.c - p.c) AS l_c
 FROM boundary b JOIN prefix p ON p.image_id = b.image_id AND p.y = b.y AND p.x = b.x JOIN prefix e ON e.image_id = b.image_id AND e.y = b.y AND e.x = 64 GROUP BY 1, 2, 3, 4, 5),
totals AS (SELECT image_id, sum(sr) AS sr, sum(sg) AS sg, sum(sb) AS sb, sum(c) AS c FROM prefix WHERE x = 64 GROUP BY 1),
scored AS (SELECT l.image_id, angle_code, line, d, num_lines, l_c,
 power(lr / l_c - sr / c, 2) * l_c + power((sr - lr) / (c - l_c) - sr / c, 2) * (c - l_c) + power(lg / l_c - sg / c, 2) * l_c + power((sg - lg) / (c - l_c) - sg / c, 2) * (c - l_c)
 + power(lb / l_c - sb / c, 2) * l_c + power((sb - lb) / (c - l_c) - sb / c, 2) * (c - l_c) AS score FROM lefts l JOIN totals t USING (image_id) WHERE l_c > 0 AND l_c < c)"""
GEOMETRY = f"WITH {ANGLES_SQL}, {RASTER_SQL}, {ROOT_SQL}, {TURNED_SQL}"
QUANT = "1 + ((4 + code % 4) << (code // 4))"
PALETTE_SQL = """palette AS (SELECT range AS idx, range * 36 AS pr, 255 - range * 36 AS pg, range * 17 AS pb FROM range(8)),
distances AS (SELECT image_id, y, x, r, g, b, idx, CAST((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb) AS DOUBLE) AS d2 FROM raster, palette),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY d2, idx) AS k FROM distances) WHERE k = 1)"""

PARSED_SQL = """WITH p AS (SELECT p_partkey, p_partkey % 500 AS partition_code, CASE WHEN p_partkey % 7 <= 1 THEN 9223372036854775807 WHEN p_partkey % 7 = 2 THEN 65 ELSE p_partkey * 37 % 4095 + 1 END AS lines, CAST(p_size AS BIGINT) + 1 AS color_options FROM part)
SELECT p_partkey, partition_code, CAST(l.range AS INTEGER) AS line_limit, color_options FROM p, range(63) l WHERE (lines >> l.range::INTEGER) & 1 = 1"""

ORACLES = {
    "angle_table_int": f"""WITH {ANGLES_SQL} SELECT o_orderkey, angle, sn, cs FROM orders JOIN ang ON angle = o_custkey % 512""",
    "angle_table_real": f"""WITH {ANGLES_SQL} SELECT o_orderkey, angle, CASE WHEN angle = 0 THEN 0.0 ELSE round(1.0 / sn::DOUBLE, 12) END AS inv_sin, CASE WHEN angle = 0 THEN 0.0 ELSE round(-cs::DOUBLE / sn::DOUBLE, 9) END AS minus_cot FROM orders JOIN ang ON angle = o_custkey % 512""",
    "log2_values": "SELECT p_partkey, n, round(CAST(CAST(log2(n) AS FLOAT) AS DOUBLE), 5) AS v FROM (SELECT p_partkey, CAST(p_partkey * p_size % 65 + 1 AS INTEGER) AS n FROM part)",
    "color_codes": f"SELECT c_custkey, CAST(code AS INTEGER) AS code, CAST(CASE WHEN code < 17 THEN {QUANT} ELSE 0 END AS BIGINT) AS quant, CAST(CASE WHEN code < 17 THEN 0 ELSE code - 16 END AS BIGINT) AS palette FROM (SELECT c_custkey, c_custkey % 49 AS code FROM customer)",
    "partition_codes": "SELECT p_partkey, code, code % 4 AS f1, code // 4 % 5 AS f2, code // 20 % 5 AS f3, code // 100 % 5 AS f4, code AS joined FROM (SELECT p_partkey, p_partkey * 7 % 500 AS code FROM part)",
    "all_variants": "SELECT image_id, CAST(range AS INTEGER) AS variant_id, CAST(range // 63 AS INTEGER) AS partition_code, CAST(range % 63 AS INTEGER) AS line_limit, CAST(562949953421311 AS BIGINT) AS color_options FROM (SELECT DISTINCT l_linenumber::BIGINT AS image_id FROM lineitem), range(31500)",
    "angle_bits": "SELECT p_partkey, CAST(l.range AS INTEGER) AS level, greatest(0, 9 - p_partkey % 500 % 4 - l.range - l.range * (p_partkey % 500 // 100 % 5) // 2) AS bits FROM part, range(7) l",
    "level_scale": """WITH RECURSIVE c AS (SELECT c_custkey, c_custkey * 13 % 2040 + 9 AS w, c_custkey * 29 % 2040 + 9 AS h, c_custkey * 7 % 500 AS code FROM customer), s AS (
 SELECT c_custkey, code, 0 AS level, ((w * w + h * h) * (code // 4 % 5 + 2) * (code // 4 % 5 + 2)) % 4294967296 AS scale FROM c
 UNION ALL SELECT c_custkey, code, level + 1, (scale * 40 % 4294967296) // [1000, 630, 398, 251, 158][code // 20 % 5 + 1] FROM s WHERE level < 6)
SELECT c_custkey, level, scale // 36 AS scale FROM s""",
    "image_tax": "SELECT p_partkey, CAST(3 + floor(log2(w - 1)) AS BIGINT) AS bits, round(20.5577740523::DOUBLE + (3 + floor(log2(w - 1))) + (3 + floor(log2(h - 1))), 6) AS tax FROM (SELECT p_partkey, p_partkey * 31 % 2040 + 9 AS w, p_size * 40 + 9 AS h FROM part)",
    "parse_numbers": "SELECT c_custkey, CAST(nullif(regexp_replace(c_name, '[^0-9]', '', 'g'), '') AS BIGINT) AS number FROM customer",
    "file_names": r"SELECT page_id, regexp_extract(url, '[^/\\]*$', 0) AS name FROM pages",
    "variant_parse": PARSED_SQL,
    "variant_records": f"""WITH v AS ({PARSED_SQL})
SELECT p_partkey, printf('%02X%02X%02X%02X000000000000', partition_code % 256, partition_code // 256, line_limit, color_options) AS record, partition_code, CAST(line_limit AS BIGINT) AS line_limit, color_options FROM v""",
    "option_sets": "SELECT l_orderkey, CAST(bit_or(1::BIGINT << (l_partkey % 49)::INTEGER) AS BIGINT) AS bits FROM lineitem GROUP BY 1",
    "single_bits": "SELECT o_orderkey, CAST(o_custkey % 63 AS INTEGER) AS found FROM orders",
    "xorshift": """WITH s AS (SELECT o_orderkey, o_orderkey * 2654435761 % 4294967296 AS v FROM orders), a AS (SELECT o_orderkey, xor(v, v * 8192 % 4294967296) AS v FROM s), b AS (SELECT o_orderkey, xor(v, v >> 17) AS v FROM a)
SELECT o_orderkey, CAST(xor(v, v * 32 % 4294967296) AS BIGINT) AS next, CAST(o_orderkey * 16807 % 2147483647 AS BIGINT) AS lcg FROM b""",
    "psnr": "SELECT p_partkey, round(10 * log10(65025.0::DOUBLE / (p_retailprice / 100)), 6) AS psnr FROM part",
    "raster_lineitem": """WITH c AS (SELECT l_linenumber::BIGINT AS image_id, l_orderkey % 32 AS y, l_partkey % 32 AS x, sum(l_quantity::BIGINT) % 256 AS r, count(*) * 16 % 256 AS g, sum(l_suppkey) % 256 AS b FROM lineitem GROUP BY 1, 2, 3)
SELECT range // 1024 + 1 AS image_id, range // 32 % 32 AS y, range % 32 AS x, CAST(coalesce(r, 0) AS BIGINT) AS r, CAST(coalesce(g, 0) AS BIGINT) AS g, CAST(coalesce(b, 0) AS BIGINT) AS b
FROM range(7168) LEFT JOIN c ON image_id = range // 1024 + 1 AND y = range // 32 % 32 AND x = range % 32""",
    "rgba_pixels": """WITH d AS (SELECT c_custkey AS image_id, md5(c_name) || md5(c_mktsegment) AS h FROM customer), p AS (SELECT *, range AS i FROM d, range(8))
SELECT image_id, i // 4 AS y, i % 4 AS x, CAST(('0x' || substr(h, CAST(8 * i + 1 AS BIGINT), 2)) AS BIGINT) AS r, CAST(('0x' || substr(h, CAST(8 * i + 3 AS BIGINT), 2)) AS BIGINT) AS g, CAST(('0x' || substr(h, CAST(8 * i + 5 AS BIGINT), 2)) AS BIGINT) AS b FROM p""",
    "prefix_sums": f"WITH {RASTER_SQL}, {PREFIX_SQL} SELECT image_id, y, x, sr, sg, sb, c FROM prefix",
    "square_sums": f"WITH {RASTER_SQL} SELECT image_id, CAST(sum(r * r + g * g + b * b) AS BIGINT) AS sqe_base FROM raster GROUP BY 1",
    "region_stats": f"WITH {RASTER_SQL} SELECT image_id, CAST(sum(r) AS BIGINT) AS sr, CAST(sum(g) AS BIGINT) AS sg, CAST(sum(b) AS BIGINT) AS sb, count(*) AS c FROM raster WHERE x >= y AND x < 64 - y GROUP BY 1",
    "region_level": """WITH s AS (SELECT i.range + 1 AS image_id, y.range % 5 AS node, max(32 - y.range) - 0 AS dx, max(y.range) + 1 - min(y.range) AS dy FROM range(7) i, range(32) y GROUP BY 1, 2),
z AS (SELECT image_id, node, CAST(dx * dx + dy * dy AS BIGINT) AS size FROM s),
t AS (WITH RECURSIVE r AS (SELECT 0 AS level, (2048 * 25)::BIGINT AS scale UNION ALL SELECT level + 1, scale * 40 // 1000 FROM r WHERE level < 6) SELECT level, scale // 36 AS scale FROM r)
SELECT image_id, node, size, CAST(coalesce((SELECT min(level) FROM t WHERE z.size >= t.scale), 6) AS BIGINT) AS level FROM z""",
    "distance_range": f"{GEOMETRY}, {REACH_SQL} SELECT image_id, angle, low, high, line_quant, num_lines FROM reach",
    "candidate_lines": f"{GEOMETRY}, {REACH_SQL}, {LINES_SQL} SELECT image_id, CAST(angle_code AS INTEGER) AS angle_code, line, d, num_lines FROM lines",
    "split_line": f"""{GEOMETRY}, cuts AS (SELECT *, sn * 20 + cs * 5 AS d FROM turned), b AS (SELECT *, {CUT} AS x FROM cuts)
SELECT image_id, angle, y, 'L' AS side, x AS x0, x1 FROM b WHERE x < x1 UNION ALL SELECT image_id, angle, y, 'R', x0, x FROM b WHERE x0 < x""",
    "split_scores": f"{GEOMETRY}, {PREFIX_SQL}, {REACH_SQL}, {LINES_SQL}, {SCORE_SQL} SELECT image_id, CAST(angle_code AS INTEGER) AS angle_code, line, CAST(l_c AS BIGINT) AS l_c, round(score, 4) AS score FROM scored",
    "best_split": f"""{GEOMETRY}, {PREFIX_SQL}, {REACH_SQL}, {LINES_SQL}, {SCORE_SQL}
SELECT image_id, CAST(angle_code AS INTEGER) AS angle_code, line, d, num_lines, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, angle_code, line) AS k FROM scored) WHERE k = 1 AND score >= 0.5""",
    "budget_count": """WITH c AS (SELECT l_orderkey, l_linenumber AS ordinal, sum(l_quantity::BIGINT) AS cost FROM lineitem GROUP BY 1, 2), s AS (SELECT l_orderkey, sum(cost) OVER (PARTITION BY l_orderkey ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS spent FROM c)
SELECT l_orderkey, count(*) FILTER (WHERE spent <= 100) AS n FROM s GROUP BY 1""",
    "quantized_colors": f"""WITH {RASTER_SQL}, m AS (SELECT image_id, y, sum(r)::DOUBLE / count(*) AS mean FROM raster GROUP BY 1, 2), q AS (SELECT CAST(range AS INTEGER) AS code, {QUANT.replace('code', 'range')} AS quant FROM range(17)),
v AS (SELECT image_id, y, code, quant, CAST(floor(mean * (quant - 1) / 255.0::DOUBLE + 0.5) AS BIGINT) AS v FROM m, q)
SELECT image_id, y, code, v, 255 * v // (quant - 1) AS shown FROM v""",
    "nearest_palette": f"WITH {RASTER_SQL}, {PALETTE_SQL} SELECT image_id, y, x, idx, d2 FROM near",
    "palette_step": f"WITH {RASTER_SQL}, {PALETTE_SQL} SELECT image_id, idx, round(sum(r) / count(*), 4) AS pr, round(sum(g) / count(*), 4) AS pg, round(sum(b) / count(*), 4) AS pb, count(*) AS c FROM near GROUP BY 1, 2",
    "simulated_error": f"""WITH {RASTER_SQL}, m AS (SELECT image_id, y, avg(r) AS r, avg(g) AS g, avg(b) AS b, count(*) AS c FROM raster GROUP BY 1, 2),
v AS (SELECT *, 255 * CAST(floor(r * 16 / 255 + 0.5) AS BIGINT) // 16 AS vr, 255 * CAST(floor(g * 16 / 255 + 0.5) AS BIGINT) // 16 AS vg, 255 * CAST(floor(b * 16 / 255 + 0.5) AS BIGINT) // 16 AS vb FROM m)
SELECT image_id, round(sum(c * vr * (vr - 2 * r) + c * vg * (vg - 2 * g) + c * vb * (vb - 2 * b)), 4) AS sqe FROM v GROUP BY 1""",
    "simulated_colors": f"""WITH {RASTER_SQL}, m AS (SELECT image_id, y, CAST(avg(r) AS FLOAT) AS r, CAST(avg(g) AS FLOAT) AS g, CAST(avg(b) AS FLOAT) AS b FROM raster GROUP BY 1, 2),
q AS (SELECT CAST(range AS INTEGER) AS code, CAST(({QUANT.replace('code', 'range')}) - 1 AS FLOAT) AS most FROM range(17)), f AS (SELECT code, most / 255::FLOAT AS fine, 255::FLOAT / most AS coarse FROM q)
SELECT image_id, y, code, {', '.join(f"CAST(floor(CAST(trunc(CAST(CAST({c} * fine AS FLOAT) + 0.5::FLOAT AS FLOAT)) AS FLOAT) * coarse) AS BIGINT) AS v{c}" for c in 'rgb')} FROM m, f""",
    "best_variant": """SELECT image_id, variant_id, color, sqe FROM (SELECT l_orderkey % 100 AS image_id, l_partkey % 20 AS variant_id, l_suppkey % 17 AS color, l_quantity - 25 AS sqe,
 row_number() OVER (PARTITION BY l_orderkey % 100 ORDER BY l_quantity, l_partkey % 20, l_suppkey % 17) AS k FROM lineitem) WHERE k = 1""",
    "render_spans": f"""{GEOMETRY}, cuts AS (SELECT *, sn * 20 + cs * 5 AS d FROM turned WHERE angle = 96), b AS (SELECT image_id, y, {CUT} AS edge FROM cuts)
SELECT image_id, y, range AS x, CASE WHEN range >= edge THEN 200 ELSE 10 END::BIGINT AS r, CASE WHEN range >= edge THEN 55 ELSE 245 END::BIGINT AS g, y AS b FROM b, range(64)""",
    "header_entries": """WITH v AS (SELECT p_partkey AS id, p_partkey * 31 % 2040 + 9 AS w, CAST(p_size * 40 + 9 AS BIGINT) AS h FROM part), s AS (SELECT *, CAST(floor(log2(w - 1)) AS BIGINT) AS lw, CAST(floor(log2(h - 1)) AS BIGINT) AS lh FROM v),
e AS (SELECT id, unnest([lw - 3, w - (1::BIGINT << lw) - 1, lh - 3, h - (1::BIGINT << lh) - 1, id % 4, id // 4 % 5, id // 20 % 5, id // 100 % 5, id % 63, id % 49]) AS value, unnest([8, 1::BIGINT << lw, 8, 1::BIGINT << lh, 4, 5, 5, 5, 63, 49]) AS max, generate_subscripts([1,1,1,1,1,1,1,1,1,1], 1) AS k FROM s)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INTEGER) AS pos, value, max FROM e WHERE max > 1""",
    "rans_roundtrip": "SELECT l_orderkey, CAST(count(*) AS INTEGER) AS numbers, true AS same FROM lineitem GROUP BY 1",
    "entropy_estimate": "SELECT l_orderkey, round(count(*) * log2(7), 6) AS bits FROM lineitem GROUP BY 1",
}
# The cells of the cross are bits of a number, fixed by the format's published example.
CROSS_SQL = """cells AS (SELECT range // 20 AS y, range % 20 AS x, ((145536 >> ((range % 20 // 4 + 5 * (range // 80))::INTEGER)) & 1) = 1 AS is_on FROM range(400)),
crosses AS (SELECT s_suppkey AS image_id, y, x, CASE WHEN is_on THEN (s_suppkey * 7 + 1) % STEPS * 255 // LAST ELSE (s_suppkey * 3) % STEPS * 255 // LAST END AS r,
 CASE WHEN is_on THEN (s_suppkey * 13 + 1) % STEPS * 255 // LAST ELSE (s_suppkey * 5) % STEPS * 255 // LAST END AS g, CASE WHEN is_on THEN (s_suppkey * 29 + 1) % STEPS * 255 // LAST ELSE (s_suppkey * 11) % STEPS * 255 // LAST END AS b FROM supplier, cells)"""
FINE_CROSS_SQL, COARSE_CROSS_SQL = (CROSS_SQL.replace("STEPS", str(n)).replace("LAST", str(n - 1)) for n in (256, 9))
REAL_CUT = """CASE WHEN sn = 0 THEN CASE WHEN CAST(y AS FLOAT) >= CAST(CAST(CAST(d AS FLOAT) AS DOUBLE) / CAST(CAST(cs AS FLOAT) AS DOUBLE) AS FLOAT) THEN x0 ELSE x1 END
 ELSE least(x1, greatest(x0, CAST(trunc(CAST(y::DOUBLE * CAST(CAST(-cs::DOUBLE / sn::DOUBLE AS FLOAT) AS DOUBLE) + CAST(CAST(d::DOUBLE * (1.0::DOUBLE / sn::DOUBLE) + 0.5::DOUBLE AS FLOAT) AS DOUBLE) AS FLOAT)) AS BIGINT))) END"""
# The pairing heap as lists: `below` the latest that a node has beaten, `beside` the next of its beater's; 0 is none. Phase 0 takes
# the top off, 1 pairs those it has beaten, 2 joins the pairs from the last, 3 adds the children of a split.
SCORE = "score[{}]"
PUT = "list_transform({0}, lambda v, i: CASE {1} ELSE v END)"
BEATS = f"{SCORE.format('one')} < {SCORE.format('two')}"
TREES_SQL = f"""mixed AS (SELECT o_orderkey AS image_id, k, (o_orderkey * 7919 + k * k * 104729 + k * 31) % 1009 AS m FROM orders, (SELECT range AS k FROM range(1, 32))),
nodes AS (SELECT image_id, k, m * 3 % 5000 + k AS sr, m * 5 % 5000 + k AS sg, m * 7 % 5000 + k AS sb, m % 50 + 1 AS c, k < 16 AND m % 11 <> 0 AS split, m % 4 + 1.0::DOUBLE AS score, 2 + (m % 24) / 4.0::DOUBLE AS cost FROM mixed),
trees AS (SELECT image_id, list(CASE WHEN split THEN score ELSE -1.0::DOUBLE END ORDER BY k) AS score, list(cost ORDER BY k) AS cost FROM nodes GROUP BY 1),
search AS (SELECT image_id, 20.0::DOUBLE + image_id % 40 AS budget, 0 AS phase, 1::BIGINT AS top, 0::BIGINT AS here, list_transform(range(31), lambda x: 0::BIGINT) AS below, list_transform(range(31), lambda x: 0::BIGINT) AS beside,
  CAST([] AS BIGINT[]) AS pairs, CAST([] AS BIGINT[]) AS todo, CAST([] AS BIGINT[]) AS taken FROM trees
 UNION ALL
 SELECT image_id, CASE WHEN took THEN budget - cost[top] - 1 ELSE budget END,
  CASE phase WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN here = 0 THEN 2 ELSE 1 END WHEN 2 THEN CASE WHEN len(pairs) = 0 THEN 3 ELSE 2 END ELSE CASE WHEN len(todo) = 0 THEN 0 ELSE 3 END END,
  CASE WHEN phase = 0 THEN 0 WHEN phase = 1 OR one IS NULL THEN top ELSE up END,
  CASE WHEN phase = 0 THEN below[top] WHEN phase = 1 AND here > 0 THEN coalesce(beside[two], 0) ELSE here END,
  CASE WHEN down > 0 THEN {PUT.format("below", "WHEN i = up THEN down")} ELSE below END,
  CASE WHEN down > 0 THEN {PUT.format("beside", "WHEN i = down THEN below[up] WHEN i = up THEN 0")} ELSE beside END,
  CASE WHEN phase = 1 AND here > 0 THEN list_append(pairs, up) WHEN phase = 2 AND len(pairs) > 0 THEN pairs[:-2] ELSE pairs END,
  CASE WHEN phase = 0 THEN CASE WHEN took THEN [2 * top, 2 * top + 1] ELSE [] END WHEN phase = 3 AND len(todo) > 0 THEN todo[2:] ELSE todo END,
  CASE WHEN took THEN list_append(taken, top) ELSE taken END
 FROM (SELECT *, CASE WHEN {BEATS} THEN two ELSE one END AS up, CASE WHEN {BEATS} THEN one WHEN one = 0 THEN 0 ELSE coalesce(two, 0) END AS down
  FROM (SELECT s.*, t.score, t.cost, phase = 0 AND t.cost[top] + 1 <= budget AS took,
    CASE WHEN phase = 1 AND here > 0 THEN here WHEN phase = 2 AND len(pairs) > 0 THEN pairs[-1] WHEN phase = 3 AND len(todo) > 0 THEN CASE WHEN top = 0 THEN todo[1] ELSE top END END AS one,
    CASE WHEN phase = 1 AND here > 0 THEN nullif(beside[here], 0) WHEN phase = 2 AND len(pairs) > 0 THEN nullif(top, 0) WHEN phase = 3 AND len(todo) > 0 AND top > 0 THEN todo[1] END AS two
   FROM search s JOIN trees t USING (image_id) WHERE NOT (phase = 0 AND (top = 0 OR t.score[top] < 0))))),
ended AS (SELECT s.image_id, taken FROM search s JOIN trees t USING (image_id) WHERE phase = 0 AND (top = 0 OR t.score[top] < 0)),
splits AS (SELECT image_id, unnest(taken) AS k, generate_subscripts(taken, 1) - 1 AS ordinal FROM ended)"""
PATH = "translate(substr(bin({}), 2), '01', 'LR')"
# A step of the coder for one number below 7: `lost` bits go, then the number comes in.
STEP_SQL = """SELECT *, (SELECT min(i.range) FROM range(0, 18) i WHERE (state >> i.range::INTEGER) < 131072 * width // 2048) AS lost
 FROM (SELECT *, v[done + 1] * 2048 // 7 AS slot, (v[done + 1] + 1) * 2048 // 7 - v[done + 1] * 2048 // 7 AS width FROM {} WHERE done < len(v) AND done < {})"""
NEXT_SQL = "(state >> lost::INTEGER) // width * 2048 + (state >> lost::INTEGER) % width + slot"
CLEAR_SQL = "(SELECT min(i.range) FROM range(0, 18) i WHERE (state >> i.range::INTEGER) % 2 = 1)"
# 4.3e9 falls below 1 after twelve divisions by 7.
STREAM_SQL = f"""WITH RECURSIVE streams AS (SELECT l_orderkey, list(CAST(l_linenumber - 1 AS BIGINT) ORDER BY l_linenumber DESC) AS v FROM lineitem GROUP BY 1),
once AS (SELECT DISTINCT v FROM streams),
tried AS (SELECT v, s.range AS start, s.range AS state, 0 AS done, 0::BIGINT AS zeros, true AS silent FROM once, range(65536, 131100, 32) s
 UNION ALL SELECT v, start, {NEXT_SQL}, done + 1, zeros + CASE WHEN silent THEN least(lost, {CLEAR_SQL}) ELSE 0 END, silent AND {CLEAR_SQL} >= lost FROM ({STEP_SQL.format('tried', 12)})),
chosen AS (SELECT v, start FROM (SELECT v, start, row_number() OVER (PARTITION BY v ORDER BY zeros DESC, start) AS n FROM tried WHERE done = least(len(v), 12)) WHERE n = 1),
coded AS (SELECT v, start AS state, 0 AS done, '' AS bits FROM chosen
 UNION ALL SELECT v, {NEXT_SQL}, done + 1, bits || CASE WHEN lost > 0 THEN reverse(lpad(bin(state % (1::BIGINT << lost::INTEGER)), lost::INTEGER, '0')) ELSE '' END FROM ({STEP_SQL.format('coded', 1000)})),
whole AS (SELECT v, reverse(lpad(bin(state % 65536), 16, '0')) || reverse(bits) || '0000000' AS bits FROM coded WHERE done = len(v)),
packed AS (SELECT v, list_aggregate(list_transform(range(0, len(bits) // 8), lambda i: printf('%02X', CAST(list_sum(list_transform(range(0, 8), lambda j: CASE WHEN substr(bits, 8 * i + j + 1, 1) = '1' THEN 1 << j::INTEGER ELSE 0 END)) AS INTEGER))), 'string_agg', '') AS data FROM whole)
SELECT l_orderkey, CAST(len(s.v) AS INTEGER) AS numbers, true AS same, regexp_replace(data, '(00)+$', '') AS data FROM streams s JOIN packed p ON s.v = p.v"""
ALL_LINES_SQL = f"""{GEOMETRY}, {PREFIX_SQL}, {REACH_SQL}, {LINES_SQL}, {SCORE_SQL}""".replace(CUT, REAL_CUT).replace("262144 * 15", "262144 * 63").replace("+ 15) // 30", "+ 63) // 126").replace("WHERE angle % 32 = 0", "").replace("angle // 32 AS angle_code", "angle AS angle_code")
ORACLES |= {
    "split_scores_binned": f"{ALL_LINES_SQL} SELECT image_id, CAST(angle_code AS INTEGER) AS angle, line, d, num_lines, CAST(l_c AS BIGINT) AS l_c, round(score, 4) AS score FROM scored",
    "boundary_real": f"{GEOMETRY}, cuts AS (SELECT *, sn * 20 + cs * 5 AS d FROM turned) SELECT image_id, angle, y, {REAL_CUT} AS x FROM cuts",
    "best_split_real": ORACLES["best_split"].replace(CUT, REAL_CUT),
    "tree_splits": f"WITH RECURSIVE {TREES_SQL} SELECT image_id, {PATH.format('k')} AS node, ordinal FROM splits",
    "tree_patches": f"""WITH RECURSIVE {TREES_SQL}, trials AS (SELECT DISTINCT image_id, color FROM nodes, (SELECT unnest([1, 2, 3]) AS color)),
inner_ AS (SELECT t.image_id, color, k, ordinal FROM trials t JOIN splits s ON s.image_id = t.image_id AND s.ordinal < color),
children AS (SELECT image_id, color, 2 * k + side AS k, 2 * ordinal + side AS seq FROM inner_, (SELECT unnest([0, 1]) AS side))
SELECT c.image_id, CAST(c.color AS INTEGER) AS color, {PATH.format('c.k')} AS node, CAST(seq AS BIGINT) AS seq, round(sr / n.c, 4) AS r, round(sg / n.c, 4) AS g, round(sb / n.c, 4) AS b, CAST(n.c AS DOUBLE) AS c
FROM children c JOIN nodes n ON n.image_id = c.image_id AND n.k = c.k WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.image_id = c.image_id AND i.color = c.color AND i.k = c.k)""",
    "encode_statuses": """SELECT s_suppkey AS image_id, ['ok', 'flat', 'size'][s_suppkey % 3 + 1] AS status, CASE WHEN s_suppkey % 3 = 0 THEN 0 END AS variant_id, CASE WHEN s_suppkey % 3 = 0 THEN 18 END AS color,
 CASE WHEN s_suppkey % 3 = 0 THEN 0.0::DOUBLE END AS mse, CASE WHEN s_suppkey % 3 = 0 THEN true END AS fits FROM supplier""",
    "cross_by_palette": f"WITH {FINE_CROSS_SQL} SELECT image_id, y, x, r, g, b FROM crosses",
    "cross_by_steps": f"WITH {COARSE_CROSS_SQL} SELECT image_id, y, x, r, g, b FROM crosses",
    "decode_images": f"""WITH {FINE_CROSS_SQL} SELECT image_id, 20::BIGINT AS width, 20::BIGINT AS height, 215::BIGINT AS partition_code, 7::BIGINT AS line_limit, 18::BIGINT AS color,
 md5(string_agg(r || ',' || g || ',' || b, ';' ORDER BY y, x)) AS digest FROM crosses GROUP BY 1""",
    "rans_roundtrip": STREAM_SQL,
    "rgba_bytes": f"WITH {RASTER_SQL} SELECT image_id, 64::BIGINT AS width, count(DISTINCT y) AS height, md5(string_agg(printf('%02X%02X%02XFF', r, g, b), '' ORDER BY y, x)) AS digest FROM raster GROUP BY 1",
}
DISTANCES = "list_transform(centres, lambda q: (p.r - q.r) * (p.r - q.r) + (p.g - q.g) * (p.g - q.g) + (p.b - q.b) * (p.b - q.b))"
PICK = "patches[least(len(patches), 1 + len(list_filter(range(1, len(weights) + 1), lambda k: list_sum(weights[1:k]) < list_sum(weights) * ((random >> 9) / 8388608.0::DOUBLE))))]"
LISTED_SQL = f"""{RASTER_SQL}, sums AS (SELECT image_id, y, count(*) AS n, sum(r) AS wr, sum(g) AS wg, sum(b) AS wb FROM raster GROUP BY 1, 2),
listed AS (SELECT image_id, list({{'r': (wr // n)::DOUBLE, 'g': (wg // n)::DOUBLE, 'b': (wb // n)::DOUBLE, 'c': n::DOUBLE, 'wr': wr::DOUBLE, 'wg': wg::DOUBLE, 'wb': wb::DOUBLE}} ORDER BY y) AS patches FROM sums GROUP BY 1)"""
SEEDS_SQL = f"""{LISTED_SQL},
seeds AS (SELECT image_id, patches, random, [{PICK}] AS centres FROM (SELECT *, {0x23DE605F}::BIGINT AS random, list_transform(patches, lambda p: p.c) AS weights FROM listed)
 UNION ALL SELECT image_id, patches, random, list_append(centres, {PICK}) FROM (SELECT image_id, patches, centres, xor(b, b * 32 % 4294967296) AS random, list_transform(patches, lambda p: list_min({DISTANCES}) * p.c) AS weights
  FROM (SELECT *, xor(a, a >> 17) AS b FROM (SELECT *, xor(random, random * 8192 % 4294967296) AS a FROM seeds WHERE len(centres) < 6)))),
seeded AS (SELECT image_id, patches, centres FROM seeds WHERE len(centres) = 6)"""
MEAN = "list_sum(list_transform(list_filter(near, lambda n: n.i = k), lambda n: n.w{0})) / greatest(list_sum(list_transform(list_filter(near, lambda n: n.i = k), lambda n: n.c)), 1)"
STEPS_SQL = f"""{SEEDS_SQL},
rounds AS (SELECT image_id, patches, list_transform(centres, lambda q: {{'r': q.r, 'g': q.g, 'b': q.b}}) AS centres, 0 AS round, 1e35::DOUBLE AS error, 1e35::DOUBLE AS gain FROM seeded
 UNION ALL SELECT image_id, patches, list_transform(range(1, 7), lambda k: {{'r': coalesce({MEAN.format('r')}, 0), 'g': coalesce({MEAN.format('g')}, 0), 'b': coalesce({MEAN.format('b')}, 0)}}), round + 1, now, error - now
 FROM (SELECT *, list_sum(list_transform(near, lambda n: n.d2 * n.c)) AS now FROM (SELECT *, list_transform(patches, lambda p: {{'d2': list_min({DISTANCES}), 'i': list_position({DISTANCES}, list_min({DISTANCES})), 'c': p.c, 'wr': p.wr, 'wg': p.wg, 'wb': p.wb}}) AS near FROM rounds WHERE gain >= 1))),
ended AS (SELECT image_id, round, round(error, 3) AS error, unnest(centres) AS q, generate_subscripts(centres, 1) - 1 AS idx FROM rounds WHERE gain < 1)"""
ORACLES |= {
    "leaf_of_pixel": ORACLES["cross_by_palette"],
    "rate_curve": """WITH c AS (SELECT l_orderkey, l_linenumber AS ordinal, sum(l_quantity::BIGINT) AS cost FROM lineitem GROUP BY 1, 2), s AS (SELECT l_orderkey, sum(cost) OVER (PARTITION BY l_orderkey ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS spent FROM c)
SELECT l_orderkey, CAST(b.range AS DOUBLE) AS budget, count(*) FILTER (WHERE spent <= b.range) AS n FROM s, range(5, 321, 5) b GROUP BY 1, 2""",
    "palette_seeds": f"WITH RECURSIVE {SEEDS_SQL} SELECT image_id, CAST(idx - 1 AS INTEGER) AS idx, CAST(centres[idx].r AS BIGINT) AS pr, CAST(centres[idx].g AS BIGINT) AS pg, CAST(centres[idx].b AS BIGINT) AS pb FROM seeded, range(1, 7) t(idx)",
    "palette_rounds": f"WITH RECURSIVE {STEPS_SQL} SELECT image_id, round, error, CAST(idx AS INTEGER) AS idx, CAST(floor(q.r + 0.5) AS BIGINT) AS pr, CAST(floor(q.g + 0.5) AS BIGINT) AS pg, CAST(floor(q.b + 0.5) AS BIGINT) AS pb FROM ended",
}
