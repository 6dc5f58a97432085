"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. The benchmark's
windows (10 consecutive words of an item; a shorter item is one window) are looked up by their
two rarest words, by corpus frequency: the index stores the postings (document, position) of
exactly those words, partitioned by word. The posting lists of a window's two rarest words are
intersected after each is shifted back by the word's offset in the window, which leaves document
positions where the window may start; the posting's neighbourhood decides whether the phrase is
exact or, with all pieces near, a proximity match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.llm.common import sized, stored

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is no word character, before lower-casing.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a text that are exploded together; a row is never wider than this and its neighbours.
BLOCK = 256
#: The posting after a text's last word; its position is the number of words.
END = ""


def _fold(column):
    """A-Z lower-cased; lower() does only that where every character is ASCII, and is much faster."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def raw_words(column):
    """Words of a text in order, not yet lower-cased (null: none)."""
    return F.array_remove(F.split(F.coalesce(column, F.lit("")), GAP), "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id string, words): the distinct windows of every item that has words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.transform(raw_words(F.col("text")), _fold).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (items.where(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("s"))
            .select("item_id", F.slice("w", F.col("s"), size).alias("words")).distinct())


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("tag"), raw_words(F.col("text")).alias("w"))


def _postings(docs: DataFrame, lookups: DataFrame, near: int) -> DataFrame:
    """(term, doc_id, tag, pos, lead, around, base) of the words in ``lookups`` (term, lead), and one END posting a row.

    around: for lead terms the words within ``near`` of the posting, not folded, from index base on.
    Texts are cut into blocks that overlap by ``near``, so that no row carries a whole text.
    """
    words = _tokens(docs).withColumn("w", F.concat("w", F.array(F.lit(END))))
    blocks = words.select("doc_id", "tag", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(BLOCK))).alias("at"))
    blocks = blocks.withColumn("from", F.greatest(F.col("at") - (near - 1), F.lit(0))).select(
        "doc_id", "tag", "at", "from", F.slice("w", F.col("at") + 1, BLOCK).alias("own"),
        F.slice("w", F.col("from") + 1, F.lit(BLOCK + near - 1) + F.col("at") - F.col("from")).alias("wide"))
    rows = blocks.select("doc_id", "tag", "at", "from", "wide", F.posexplode("own").alias("i", "word"))
    rows = rows.select("doc_id", "tag", "from", "wide", (F.col("at") + F.col("i")).alias("pos"), _fold(F.col("word")).alias("term"))
    base = F.greatest(F.col("pos") - (near - 1), F.lit(0))
    return rows.join(lookups, "term").select(
        "term", "doc_id", "tag", "pos", "lead", base.alias("base"),
        F.when(F.col("lead") == 1, F.slice("wide", base - F.col("from") + 1, 2 * near - 1)).alias("around"))


def _search(docs: DataFrame, benchmark: DataFrame, size: int, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """The matches, and (doc_id, tag, n_words) of every row of ``docs``, which the END postings give."""
    near = size + slop
    wins = stored(windows(benchmark, size).groupBy("words").agg(F.collect_set("item_id").alias("items"))
                  .withColumn("wid", F.sha2(F.array_join("words", " "), 256)))
    vocabulary = stored(wins.select(F.explode("words").alias("term")).distinct())
    corpus = _tokens(docs).select(F.explode("w").alias("word")).select(_fold(F.col("word")).alias("term"))
    counts = stored(corpus.join(sized(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("cf")))
    terms = wins.select("wid", F.size("words").alias("n"), F.posexplode("words").alias("off", "term")).join(counts, "term")
    # a window with a word that no document has cannot occur; the others keep their two rarest places
    rare = terms.groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("cf", "off", "term"))).alias("r"), F.first("n").alias("n"))
    if slop == 0:
        rare = rare.where(F.size("r") == F.col("n"))
    plan = stored(rare.select("wid", "n", F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["off"].alias("o1"),
                              F.get("r", F.lit(1))["term"].alias("t2"), F.get("r", F.lit(1))["off"].alias("o2")).join(wins, "wid"))

    end = docs.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(2).alias("lead"))
    lookups = stored(plan.select(F.col("t1").alias("term"), F.lit(1).alias("lead")).unionByName(
        plan.where("t2 is not null").select(F.col("t2").alias("term"), F.lit(0).alias("lead"))).groupBy("term").agg(F.max("lead").alias("lead"))
        .unionByName(end))
    index = stored(_postings(docs, sized(lookups), near))

    first = (index.where("lead = 1").join(sized(plan), F.col("term") == F.col("t1"))
             .select("wid", "n", "items", "words", "doc_id", "tag", "t2", "o1", "o2", "base",
                     F.transform("around", _fold).alias("around"),
                     (F.col("pos") - F.col("o1")).alias("start")).where("start >= 0"))
    single = first.where("t2 is null")
    second = index.select(F.col("term").alias("p_term"), F.col("doc_id").alias("p_doc"), F.col("tag").alias("p_tag"), F.col("pos").alias("p_pos"))
    shifts = F.explode(F.array(*[F.lit(i) for i in range(-slop, slop + 1)])) if slop else F.lit(0)
    paired = first.where("t2 is not null").withColumn("shift", shifts)
    both = paired.join(second, (F.col("t2") == F.col("p_term")) & F.col("doc_id").eqNullSafe(F.col("p_doc"))
                       & (F.col("tag") == F.col("p_tag")) & (F.col("start") + F.col("o2") + F.col("shift") == F.col("p_pos")))
    found = both.select(*single.columns).unionByName(single)
    exact = F.slice("around", F.greatest(F.col("start") - F.col("base") + 1, F.lit(1)), F.col("n")) == F.col("words")
    share = F.size(F.array_intersect("around", "words")) >= 0.8 * F.size(F.array_distinct("words"))
    kind = found.withColumn("exact", exact).where(F.col("exact") | share if slop else F.col("exact"))
    lengths = index.where("lead = 2").select("doc_id", "tag", F.col("pos").cast("long").alias("n_words"))
    return kind.select(F.explode_outer("items").alias("item_id"), "doc_id", "tag", "start", "n", "exact").distinct(), lengths


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """(item_id, doc_id, tag, start, n, exact): windows found in documents.

    ``start`` is the word index of the window, ``n`` its words, ``tag`` the hash of the text that
    tells rows of equal doc_id apart. With ``slop`` > 0 also proximity matches (exact false): the
    two rarest words stand within ``slop`` of their distance in the window, and four fifths of
    the window's words are among the posting's neighbours.
    """
    return _search(docs, benchmark, size, slop)[0]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and tag).

    Null and empty texts have no words; items without words have no window; null item_ids are
    left out of n_items and items_sha256 but their windows still hit. Equal rows get equal results.
    """
    found, rows = _search(docs, benchmark, size)
    found = stored(found)
    spans = found.groupBy("doc_id", "tag", "start").agg(F.max("n").alias("n"))
    before = Window.partitionBy("doc_id", "tag").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    spans = spans.withColumn("reach", F.coalesce(F.max(end).over(before), F.lit(0)))
    hit = spans.groupBy("doc_id", "tag").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "reach"))).alias("n_hit"))
    items = found.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    hits = hit.join(items, hit.doc_id.eqNullSafe(items.doc_id) & (hit.tag == items.tag)).select(
        hit.doc_id.alias("h_doc"), hit.tag.alias("h_tag"), "n_hit", "ids")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("h_doc")) & (F.col("tag") == F.col("h_tag")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), "tag")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which any window of the benchmark occurs; all columns as they were, whatever their names.

    Rows without words, and all rows where the benchmark has none, stay; an empty table gives an empty one.
    """
    found = stored(matches(docs, benchmark).select("doc_id", "tag").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("of"))
    side = sized(found)
    return rows.join(side, rows["id"].eqNullSafe(side["doc_id"]) & (rows["of"] == side["tag"]), "left_anti").select("row.*")
