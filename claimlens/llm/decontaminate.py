"""Benchmark decontamination over a positional inverted index (DataFrame operations only).

``index`` reads the training texts once and stores, as Parquet in the shared folder, one posting (document, position,
term) for each training token that is also a benchmark word, and one closing posting for each document that holds its
number of words. A window of an item (``width`` consecutive words, or the whole of a shorter item) is searched from
its rarest term: the posting lists of the rarest terms, shifted by the term's place in the item, give places (document,
item, shift) where the item could lie; the shifted lists of the second rarest terms are intersected with them;
only then are all other terms looked up, in the postings of the documents that are left. On a place, matched
item positions in an unbroken run of a window's length are occurrences, and their document words are hit.

Lists are joined on (document, position, term), so no document, item or term meets in one task as a whole; joins with
a hot side are plain equi-joins that Spark can split. Broadcasts happen only after a count that bounds their size.

Words: A-Z lower-cased, then runs of anything but ASCII other than letters and digits. Defined results: null, empty or wordless
texts have no words and no hits; benchmark rows with a null item_id or no words take no part; rows that repeat an
item_id count as one item; each document row is returned, repeated rows and null ids too, each judged by its own
text. Other columns are not read. An empty benchmark marks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, broadcast_if_small, stored

WIDTH = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """Words in their own case; lower-casing A-Z afterwards gives the same words as before splitting."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD, -1), "")


def item_terms(benchmark: DataFrame) -> DataFrame:
    """iuid (one per benchmark row), item_id, p (word's place from 0), word, n (words of the item)."""
    rows = (
        benchmark.where("item_id is not null")
        .select(F.monotonically_increasing_id().alias("iuid"), "item_id", raw_words(F.col("text")).alias("words"))
    )
    words = rows.select("iuid", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("p", "word"))
    return stored(words.withColumn("word", ascii_lower(F.col("word"))), "benchmark-terms")


def index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Stored postings uid, doc_id, pos, term; ``vocabulary`` (word, term). term -1 at pos = number of words closes a row."""
    vocabulary = vocabulary.unionByName(docs.sparkSession.createDataFrame([("", -1)], "word string, term long"))
    n_terms, longest = vocabulary.select(F.count("*"), F.max(F.octet_length("word"))).first()
    words = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id",
                        F.concat(raw_words(F.col("text")), F.array(F.lit(""))).alias("words"))
    tokens = words.select("uid", "doc_id", F.posexplode("words").alias("pos", "raw"))
    tokens = tokens.select("uid", "doc_id", "pos", ascii_lower(F.col("raw")).alias("word"))
    postings = tokens.join(broadcast_if_small(vocabulary, n_terms, 64 + (longest or 0)), "word")
    return stored(postings.select("uid", "doc_id", "pos", "term"), "postings")


def windows(terms: DataFrame, counts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each window's two rarest places: iuid, n, start, length, p1, t1, p2, t2 (equal places in one-word windows)."""
    known = terms.join(counts, "term", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    length = F.least(F.lit(width), F.col("n"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("p") - length + 1), F.least(F.col("p"), F.col("n") - length))
    spread = known.withColumn("length", length).withColumn("start", F.explode(starts))
    rarest = Window.partitionBy("iuid", "start").orderBy("n_found", "p")
    ranked = spread.withColumn("k", F.row_number().over(rarest)).where("k <= 2")
    return (
        ranked.groupBy("iuid", "start").agg(
            F.first("n").alias("n"), F.first("length").alias("length"), F.min("n_found").alias("n_found"),
            F.min_by("p", "k").alias("p1"), F.min_by("term", "k").alias("t1"), F.max_by("p", "k").alias("p2"), F.max_by("term", "k").alias("t2"))
        .where("n_found > 0")
    )


def places(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """Places uid, iuid, shift where some window's two rarest terms stand as they do in the item."""
    first = windows.select("iuid", F.col("p1").alias("p"), F.col("t1").alias("term")).distinct()
    rare = postings.join(first, "term").select("uid", "iuid", "p", (F.col("pos") - F.col("p")).alias("shift"))
    second = windows.select("iuid", F.col("p1").alias("p"), F.col("p2").alias("q"), F.col("t2").alias("term")).distinct()
    wanted = rare.join(second, ["iuid", "p"]).select("uid", "iuid", "shift", (F.col("shift") + F.col("q")).alias("pos"), "term").distinct()
    lists = postings.join(windows.select(F.col("t2").alias("term")).distinct(), "term", "left_semi").select("uid", "pos", "term")
    return wanted.join(lists, ["uid", "pos", "term"], "left_semi").select("uid", "iuid", "shift").distinct()


def occurrences(postings: DataFrame, terms: DataFrame, found: DataFrame, width: int = WIDTH) -> DataFrame:
    """Hit words uid, iuid, shift, p: item places in unbroken runs of at least a window's length."""
    wanted = found.join(terms.select("iuid", "p", "term", "n"), "iuid").withColumn("pos", F.col("shift") + F.col("p"))
    left = stored(found.select("uid").distinct(), "open-documents")
    lists = postings.join(broadcast_if_small(left, left.count(), 16), "uid", "left_semi").select("uid", "pos", "term")
    matched = wanted.join(lists, ["uid", "pos", "term"], "left_semi")
    place = ["uid", "iuid", "shift"]
    run = matched.withColumn("run", F.col("p") - F.row_number().over(Window.partitionBy(*place).orderBy("p")))
    size = F.count("*").over(Window.partitionBy(*place, "run"))
    return run.withColumn("size", size).where(F.col("size") >= F.least(F.lit(width), F.col("n"))).select(*place, "p", "pos")


def search(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(postings, item terms, windows, hit words) of all documents against all items."""
    terms = item_terms(benchmark.select("item_id", "text"))
    vocabulary = stored(terms.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "benchmark-words")
    terms = terms.join(vocabulary, "word")
    postings = index(docs.select("doc_id", "text"), vocabulary)
    counts = postings.where("term >= 0").groupBy("term").agg(F.count("*").alias("n_found"))
    wins = stored(windows(terms, counts, width), "benchmark-windows")
    found = stored(places(postings, wins), "places")
    return postings, terms, wins, stored(occurrences(postings, terms, found, width), "occurrences")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document row."""
    postings, terms, _, hits = search(docs, benchmark, width)
    words = hits.select("uid", "pos").distinct().groupBy("uid").agg(F.count("*").alias("n_hit"))
    ids = terms.select("iuid", F.col("item_id").cast("string").alias("item")).distinct()
    items = hits.select("uid", "iuid").distinct().join(ids, "iuid").select("uid", "item").distinct()
    items = items.groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = postings.where("term = -1").select("uid", "doc_id", F.col("pos").cast("long").alias("n_words"))
    return (
        rows.join(words.join(items, "uid"), "uid", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
                F.col("n_hit").isNotNull().alias("contaminated"))
    )


def proximity(postings: DataFrame, terms: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """uid, iuid, start of windows all of whose terms stand, in any order, within reach of one occurrence of the rarest of them.

    ``reach`` is the window's length less one, plus ``slop`` words. Positions are cut into cells longer than any reach, so two places within reach lie
    in one cell or in neighbours. Lists are intersected from the rarest: the two rarest terms first, once for all windows that share them,
    then each other term of the windows left. Exact matches are among them.
    """
    reach = F.col("length") - 1 + slop
    size = (windows.select(F.max("length")).first()[0] or 1) + slop
    cell = F.floor(F.col("pos") / size)
    around = F.explode(F.array(cell - 1, cell, cell + 1))
    lists = postings.where("term >= 0").select("uid", "term", F.col("pos").alias("at"), cell.alias("cell"))
    pairs = windows.select(F.col("t1").alias("term"), "t2", "length").distinct()
    first = postings.join(pairs, "term").select("uid", "pos", F.col("term").alias("t1"), F.col("t2").alias("term"), "length", around.alias("cell"))
    near = first.join(lists, ["uid", "term", "cell"]).where(F.abs(F.col("at") - F.col("pos")) <= reach)
    near = near.select("uid", "pos", "t1", F.col("term").alias("t2"), "length").distinct()
    own = terms.select("iuid", "p", "term").join(windows.select("iuid", "start", "length"), "iuid")
    own = own.where("p >= start and p < start + length").select("iuid", "start", "term").distinct()
    own = own.withColumn("n_terms", F.count("*").over(Window.partitionBy("iuid", "start")))
    places = near.join(windows.select("iuid", "start", "t1", "t2", "length"), ["t1", "t2", "length"]).select("uid", "iuid", "start", "length", "pos")
    wanted = places.join(own, ["iuid", "start"]).withColumn("cell", around)
    seen = wanted.join(lists, ["uid", "term", "cell"]).where(F.abs(F.col("at") - F.col("pos")) <= reach)
    held = seen.select("uid", "iuid", "start", "pos", "term", "n_terms").distinct().groupBy("uid", "iuid", "start", "pos", "n_terms").agg(F.count("*").alias("n"))
    return held.where("n = n_terms").select("uid", "iuid", "start").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, slop: int, width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, start, exact: each window of an item that a document holds, word for word (``exact``) or by proximity."""
    postings, terms, wins, hits = search(docs, benchmark, width)
    found = proximity(postings, terms, wins, slop)
    hit = hits.select("uid", "iuid", "shift", "p").distinct()
    begun = wins.select("iuid", "start", "length").join(hit.select("uid", "iuid", "shift", F.col("p")), "iuid")
    exact = begun.where("p >= start and p < start + length").groupBy("uid", "iuid", "start", "length", "shift").agg(F.count("*").alias("n"))
    exact = exact.where("n = length").select("uid", "iuid", "start", F.lit(True).alias("exact")).distinct()
    rows = postings.where("term = -1").select("uid", "doc_id")
    ids = terms.select("iuid", "item_id").distinct()
    out = found.join(exact, ["uid", "iuid", "start"], "left").join(rows, "uid").join(ids, "iuid")
    return out.select("doc_id", "item_id", "start", F.coalesce("exact", F.lit(False)).alias("exact"))
