"""Helpers shared by the operators: stored tables, size-checked joins, components, near-duplicate linking."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.similarity import BIT_SCHEMA, BIT_WORDS, GRAMS, set_bits, set_rows, similar_sets
from claimscope.session import ensure_checkpoint_dir

#: A join side is broadcast only if its measured size stays below this.
BROADCAST_BYTES = 24 << 20
#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold at most BATCH_BYTES (one longer row stands alone), unless it is bounded lower already.

    Operators call it when they are built, since their last step runs when the caller writes the result.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    bound_batches(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(small: DataFrame) -> DataFrame:
    """``small`` (already stored) marked for broadcast if its measured content fits BROADCAST_BYTES, else as it is.

    Fixed-width columns count by their width, strings, binaries and arrays by what they hold, and every row some overhead.
    """
    def width(name: str, kind: T.DataType) -> Column:
        c = F.col(f"`{name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(c, "")), F.lit(0)) + F.greatest(F.size(c), F.lit(0)) * 16
        if isinstance(kind, T.ArrayType):
            each = 16 + 8 * len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 16
            return F.greatest(F.size(c), F.lit(0)) * each
        return F.lit(16)

    total = sum((width(f.name, f.dataType) for f in small.schema.fields), F.lit(32)).cast("long")
    size = small.agg(F.sum(total)).first()[0] or 0
    return F.broadcast(small) if size <= BROADCAST_BYTES else small


def hash_sample(rows: DataFrame, n: int, on: str) -> DataFrame:
    """At most ``n`` rows of ``rows``, with different values of ``on``: those of the least hashes.

    The bound is found on hashes alone (equal values once), so no task and no driver holds more than ``n`` of the values.
    """
    hashed = rows.withColumn("__hash", F.xxhash64(on))
    bound = hashed.select("__hash").distinct().orderBy("__hash").limit(n).agg(F.max("__hash")).first()[0]
    if bound is None:
        return rows.limit(0)
    return hashed.where(F.col("__hash") <= bound).dropDuplicates(["__hash"]).drop("__hash")


def digest(column) -> F.Column:
    """16 bytes that stand for a text (null as empty)."""
    return F.unhex(F.md5(F.coalesce(column, F.lit(""))))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(key, comp): the smallest key of each connected component, for every key in ``edges`` (a, b with a > b).

    Alternating small-star and large-star steps: each is a grouped minimum and an equi-join whose
    grouped side is unique, so a hub with very many links is split by the skew join. Every
    round's links are stored.
    """
    e = edges
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    for _ in range(max_rounds):
        low = e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = (e.join(low, e.a == low.k).select(F.explode(F.array(pair("a", "m"), pair("b", "m"))).alias("x"))
                 .select("x.*").where("a <> b").distinct())
        small = stored(small)
        both = small.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("x")).select("x.*")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        e = stored(both.join(low, both.a == low.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("k"), F.lit(1).alias("up")),
                                          F.struct(F.col("b").alias("k"), F.lit(0).alias("up")))).alias("x")).select("x.*")
        unsettled = ends.groupBy("k").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where(
            "ups > 1 or (ups = 1 and least = 0)")
        if unsettled.isEmpty():
            return e.select(F.explode(F.array(pair("a", "b"), pair("b", "b"))).alias("x")).select(
                F.col("x.a").alias("key"), F.col("x.b").alias("comp")).distinct()
    raise RuntimeError("components did not settle")


def central_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every unit of a bucket with the bucket's hub, from ``members`` (band, key, n: rows of the bucket).

    The hub is the unit that shares buckets with the most rows, so it lies near the middle of a
    group of varied copies and links to most of them at once.
    """
    score = members.groupBy("key").agg(F.sum("n").alias("score"))
    hubs = members.join(score, "key").groupBy("band").agg(F.max(F.struct("score", "key")).alias("top")).select("band", F.col("top.key").alias("hub"))
    return members.join(hubs, "band").where("key <> hub").select(
        F.greatest("key", "hub").alias("a"), F.least("key", "hub").alias("b")).distinct()


BITS = [f"b{i}" for i in range(BIT_WORDS)]


def may_be_similar(similarity: float, other: str) -> Column:
    """Whether two units can reach ``similarity`` by what their shingles' bits and weights show.

    A bit that one unit has and the other lacks stands for a shingle that the other lacks. So the lacking masses x, y (of 1)
    are at least these bits over the weights' sums, and the index is at most 1 / (1 + x / (1 - x) + y / (1 - y)).
    """
    def lacks(a: str, b: str) -> Column:
        n = sum((F.bit_count(F.col(f"{x}{a}").bitwiseAND(F.bitwise_not(F.col(f"{x}{b}")))) for x in BITS), F.lit(0))
        return n / (F.col(f"total{a}") - n + 1e-9)

    return lacks("", other) + lacks(other, "") <= 1 / similarity - 1 + 1e-6


def prefix_side(units: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """(gram, key, odds, and the columns of ``units``): the shingles by which units of different components can reach ``similarity``.

    ``units`` (key, comp, total, bits), ``grams`` (key, gram, weight). Order every unit's shingles from the rarest
    on. Before the first one a pair shares, each side has a mass x, y (of 1) that the other lacks, and its
    (probability) Jaccard index is at most 1 / (1 + x / (1 - x) + y / (1 - y)). So two units can only be similar if
    they share a shingle before which little mass stands on both sides: odds x / (1 - x) that sum to
    1 / similarity - 1 at most.
    """
    slack = 1 / similarity - 1
    grams = grams.join(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram")
    by_unit = Window.partitionBy("key")
    head = by_unit.orderBy("df", "gram").rowsBetween(Window.unboundedPreceding, -1)
    ranked = grams.select("key", "gram", "df", F.coalesce(F.sum("weight").over(head), F.lit(0)).alias("x"), F.sum("weight").over(by_unit).alias("all"))
    ranked = ranked.select("key", "gram", "df", (F.col("x") / (F.col("all") - F.col("x"))).alias("odds")).where(
        (F.col("df") > 1) & (F.col("odds") <= slack + 1e-9))
    return ranked.drop("df").join(units, "key")


def least_pairs(side: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every unit of a shingle of ``side`` with that shingle's unit of least odds, where the two can be similar.

    Where many units of a shingle are similar to each other, most are so to this one too, and are in one component
    without having been compared in pairs.
    """
    kept = ["comp", "odds", "total", *BITS]
    least = side.groupBy("gram").agg(F.min(F.struct("odds", "key", "comp", "total", *BITS)).alias("h")).select(
        "gram", F.col("h.key").alias("hub"), *[F.col(f"h.{c}").alias(f"{c}_h") for c in kept])
    near = side.join(least, "gram").where((F.col("comp") != F.col("comp_h")) & (F.col("odds") + F.col("odds_h") <= 1 / similarity - 1 + 1e-9)
                                          & may_be_similar(similarity, "_h"))
    return near.select(F.greatest("key", "hub").alias("a"), F.least("key", "hub").alias("b")).distinct()


def prefix_pairs(side: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of units of different components that can reach ``similarity`` by ``side``; none that can is left out."""
    other = side.select("gram", *[F.col(c).alias(f"{c}_o") for c in ("key", "comp", "odds", "total", *BITS)])
    return side.join(other, "gram").where(
        (F.col("key") > F.col("key_o")) & (F.col("comp") != F.col("comp_o")) & (F.col("odds") + F.col("odds_o") <= 1 / similarity - 1 + 1e-9)
        & may_be_similar(similarity, "_o")).select(F.col("key").alias("a"), F.col("key_o").alias("b")).distinct()


def link_near(bands: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> tuple[DataFrame, DataFrame]:
    """Verified links between units that share a band, and the components they form.

    ``bands`` (key binary, band long), one row per unit and band (repeats allowed); ``sets_of`` takes keys and
    returns their shingles (key, grams, weights: ``similarity.SETS``), which are stored once and
    serve every comparison. No bucket is expanded into its pairs. First each unit is
    paired with the hub of each of its buckets. A bucket whose units then lie in one component is
    settled. The units of the others are compared by their rarest shingles (``prefix_side``): first with the unit of
    least odds of each shingle, then in pairs, where their bits allow the similarity (``may_be_similar``), so
    that no two colliding units of different components that can be similar stay uncompared.
    Returns (links (a, b), membership (key, comp)); the links span the components and are not all there are.
    """
    buckets = bands.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count(F.lit(1)).alias("n"))
    members = stored(bands.join(buckets.where("least <> most").select("band", "n"), "band").select("band", "key", "n").distinct())
    sets = stored(sets_of(stored(members.select("key").distinct())))

    def verified(pairs: DataFrame) -> DataFrame:
        mine = lambda k: sets.select(F.col("key").alias(k), F.col("grams").alias(f"grams_{k}"), F.col("weights").alias(f"weights_{k}"))
        both = pairs.join(mine("a"), "a").join(mine("b"), "b").select("a", "b", "grams_a", "weights_a", "grams_b", "weights_b")
        return both.mapInArrow(similar_sets(similarity), "a binary, b binary")

    tried = stored(central_pairs(members))
    links = stored(verified(tried))
    comp = stored(components(links))

    labelled = members.join(comp, "key", "left").select("band", "key", F.coalesce("comp", "key").alias("comp"))
    open_ = labelled.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band")
    rest = stored(labelled.join(open_, "band").select("key", "comp").distinct())
    if rest.isEmpty():
        return links, comp
    mine = stored(sets.join(rest, "key").select("key", "comp", "grams", "weights"))
    units = stored(mine.select("key", "grams", "weights").mapInArrow(set_bits, BIT_SCHEMA).join(rest, "key"))
    side = stored(prefix_side(units, stored(mine.select("key", "grams", "weights").mapInArrow(set_rows, GRAMS)), similarity))
    for form_pairs in (least_pairs, prefix_pairs):
        pairs = stored(form_pairs(side, similarity).join(tried, ["a", "b"], "left_anti"))
        more = stored(verified(pairs))
        if more.isEmpty():
            continue
        links = stored(links.unionByName(more))
        stars = comp.where("key <> comp").select(F.col("key").alias("a"), F.col("comp").alias("b"))
        comp = stored(components(stars.unionByName(more)))
        if form_pairs is least_pairs:
            tried = stored(tried.unionByName(pairs))
            now = stored(rest.select("key").join(comp, "key", "left").select("key", F.coalesce("comp", "key").alias("comp")))
            side = stored(side.drop("comp").join(now, "key"))
    return links, comp
