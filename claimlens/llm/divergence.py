"""Audit of how far the word use of sources differs, by in-mapper stripes.

1. Every task folds whole documents into hash stripes, term -> (document frequency, occurrences by source), one for each
   language and term. When a task holds ``SPILL`` entries it emits its stripes and starts afresh, so its memory is bounded.
2. Stripes are merged by key in sorted order, streaming: first those of one term that come from the same of about
   sqrt(shuffle partitions) groups of tasks, then the groups. So a term that every task has meets few rows in any task. Merging is
   vectorised: a run of equal keys in sorted rows becomes one row.
3. Merged stripes of terms in at least ``LEAST`` documents of their language are stored. Their sums by source, and the list
   of sources (empty stripes carry it, so sources without terms are listed too), give every group's totals.
4. Merged stripes, dealt into slots of about ``SLOT`` terms by hash, emit the divergences directly: each slot adds up
   its part of every pair of sources and names its best terms of each source; sums and ranks over slots finish it.

Shares and divergences are integers: p = 1 + floor(10^9 * (count + 1) / (N + V)), f = floor((p - q)^2 / q). Long division by
thousands keeps them exact for counts up to 9 * 10^15.

Defined results: null text, language and source are read as ''. A language none of whose terms reaches ``LEAST`` documents has pairs
of value 0 and no terms. Repeated rows and null ids are documents like any other. Ties rank by UTF-8 order. A text of any length
is read in pieces of ``PIECE`` bytes. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, stored

LEAST = 3
TOP = 200
SPILL = 1_000_000
ROWS = 65_536
SLOT = 8192
CHUNK = 1024
PIECE = 1 << 20
SCALE_STEPS = 3  # thousands: 10^9

STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
FOUND = "lang string, source string, part string, item string, value long"

#: A-Z to a-z, other letters and all bytes of characters beyond ASCII to themselves, anything else to a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The text's terms in pieces of at most about ``PIECE`` bytes, cut between terms."""
    text = text.translate(LETTERS)
    start = 0
    while len(text) - start > PIECE:
        cut = text.find(b" ", start + PIECE)
        if cut < 0:
            break
        yield text[start:cut].split()
        start = cut
    yield text[start:].split()


class Stripes:
    """A task's stripes. While documents are folded in they are held by source, since counting a list at a time is quick."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.documents: dict[str, Counter] = defaultdict(Counter)

    def fold(self, lang: str, source: str, text: bytes) -> None:
        counts, seen = self.counts[lang, source], set()
        for part in words(text):
            counts.update(part)
            seen.update(part)
        self.documents[lang].update(seen)

    def entries(self) -> int:
        return sum(map(len, self.counts.values())) + sum(map(len, self.documents.values()))

    def rows(self) -> Iterator[tuple[str, bytes | None, int, dict[str, int]]]:
        """(lang, term, df, occurrences by source); the row without a term lists the sources."""
        stripes: dict[str, dict[bytes, dict[str, int]]] = defaultdict(lambda: defaultdict(dict))
        sources: dict[str, dict[str, int]] = defaultdict(dict)
        for (lang, source), counts in self.counts.items():
            sources[lang][source] = 0
            of_lang = stripes[lang]
            for term, n in counts.items():
                of_lang[term][source] = n
        for lang, by_source in sources.items():
            yield lang, None, 0, by_source
            documents = self.documents[lang]
            for term, stripe in stripes[lang].items():
                yield lang, term, documents[term], stripe


def batches_of(rows: Iterator[tuple[str, bytes | None, int, dict[str, int]]], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of stripes."""
    lang, term, df, sources, counts, ends = [], [], [], [], [], [0]

    def batch() -> pa.RecordBatch:
        at = pa.array(ends, pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(df, pa.int64()),
             pa.ListArray.from_arrays(at, pa.array(sources, pa.string())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))],
            names=["lang", "term", "df", "sources", "counts"])

    for a, b, c, stripe in rows:
        lang.append(a)
        term.append(b)
        df.append(c)
        sources.extend(stripe)
        counts.extend(stripe.values())
        ends.append(len(sources))
        if len(sources) >= size or len(lang) >= size:
            yield batch()
            lang, term, df, sources, counts, ends = [], [], [], [], [], [0]
    if lang:
        yield batch()


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of a task's documents (lang, source, text), spilled whenever they grow too many."""
    stripes = Stripes()
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for k, (lang, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            stripes.fold(lang, source, texts[k].as_py())
            if k % 32 == 31 and stripes.entries() >= SPILL:
                yield from batches_of(stripes.rows())
                stripes = Stripes()
    yield from batches_of(stripes.rows())


def combined(rows: pa.Table, keys: list[str]) -> pa.RecordBatch:
    """One stripe for each run of equal keys in sorted stripes."""
    lang, term, df, sources, counts = (rows[f].combine_chunks() for f in ("lang", "term", "df", "sources", "counts"))
    first = np.zeros(len(lang), bool)
    first[:1] = True
    for name in keys:
        key = rows[name].combine_chunks()
        key = key.fill_null("\0") if name == "term" else key  # no term holds that character
        first[1:] |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(first)
    sizes = pc.list_value_length(sources).to_numpy(zero_copy_only=False)
    row = np.repeat(np.cumsum(first) - 1, sizes)
    names = sources.flatten().dictionary_encode()
    cell = row * max(1, len(names.dictionary)) + names.indices.to_numpy()
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts.flatten().to_numpy()[order], new) if len(new) else np.zeros(0, np.int64)
    ends = pa.array(np.searchsorted(row[order][new], np.arange(len(at) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [lang.take(pa.array(at)), term.take(pa.array(at)), pa.array(np.add.reduceat(df.to_numpy(), at)),
         pa.ListArray.from_arrays(ends, names.dictionary.take(names.indices.take(pa.array(order[new])))), pa.ListArray.from_arrays(ends, pa.array(total))],
        names=["lang", "term", "df", "sources", "counts"])


def merged(stripes: DataFrame, keys: list[str]) -> DataFrame:
    """One stripe for each key, from rows sorted by it; Spark's sort spills, the merge holds ``ROWS`` rows."""
    rows = stripes.repartition(*keys).sortWithinPartitions(*keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            """What the held rows make; the last key stays, as one row, while more rows may follow."""
            table = pa.Table.from_batches(held)
            held.clear()
            out = combined(table, keys)
            if last:
                yield out
                return
            yield out.slice(0, out.num_rows - 1)
            rest, end = out.slice(out.num_rows - 1), table.slice(table.num_rows - 1).to_batches()[0]
            held.append(pa.RecordBatch.from_arrays([rest.column(f) if f in rest.schema.names else end.column(f) for f in table.schema.names],
                                                   schema=table.schema))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                yield from done(False)
        if held:
            yield from done(True)

    return rows.mapInArrow(merge, STRIPE)


def share(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (counts + 1) / of), exactly."""
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest = rest % of
    return out + 1


def divergences(key: tuple, stripes: pa.Table, totals: pa.Table) -> pa.Table:
    """What one slot of a language's stripes adds to its pairs of sources, and the slot's best terms of each source."""
    empty = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]).empty_table()
    if not stripes.num_rows or not totals.num_rows:
        return empty
    lang = totals["lang"][0].as_py()
    names = totals["names"][0].as_py()
    v = totals["n_terms"][0].as_py()
    of = np.array(totals["sums"][0].as_py(), np.int64) + v
    place = {s: k for k, s in enumerate(names)}
    terms, lists, counts = (stripes[c].to_pylist() for c in ("term", "sources", "counts"))
    order = sorted(range(len(terms)), key=lambda i: terms[i].encode())
    pairs = np.zeros((len(names), len(names)), np.int64)
    best: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by source: (-value, place in order)
    for lo in range(0, len(order), CHUNK):
        part = order[lo:lo + CHUNK]
        c = np.zeros((len(part), len(names)), np.int64)
        for r, i in enumerate(part):
            c[r, [place[s] for s in lists[i]]] = counts[i]
        p, q = share(c, of), share(c.sum(1), of.sum() - (len(names) - 1) * v)
        for a in range(len(names)):
            f = (p[:, [a]] - p) ** 2 // p
            pairs[a] += f.sum(0)
            at = np.flatnonzero((c[:, a] > 0) & (p[:, a] > q))
            value = (p[at, a] - q[at]) ** 2 // q[at]
            best[a] = sorted(best[a] + list(zip((-value).tolist(), (at + lo).tolist(), strict=True)))[:TOP]
    rows = [(lang, names[a], "pair", names[b], int(pairs[a, b])) for a in range(len(names)) for b in range(len(names)) if a != b]
    rows += [(lang, names[a], "term", terms[order[k]], -value) for a, found in best.items() for value, k in found]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], empty.schema[k].type) for k in range(5)], schema=empty.schema)


def or_blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: see the top."""
    spark = docs.sparkSession
    small_batches(spark, 1024)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = int(np.ceil(partitions**0.5))
    spilled = docs.select(or_blank("lang"), or_blank("source"), or_blank("text")).mapInArrow(folded, STRIPE)
    spilled = spilled.withColumn("salt", F.spark_partition_id() % salts)
    whole = merged(merged(spilled, ["lang", "term", "salt"]), ["lang", "term"])
    whole = stored(whole.where(F.col("term").isNull() | (F.col("df") >= LEAST)), "stripes")

    kept = whole.where("term is not null")
    groups = whole.where("term is null").select("lang", F.explode("sources").alias("source"))
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("z")).groupBy("lang", F.col("z.sources").alias("source"))
    groups = groups.join(sums.agg(F.sum("z.counts").alias("n")), ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    groups = stored(groups, "divergence-groups")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    named = F.array_sort(F.collect_list(F.struct("source", "n")))
    totals = groups.groupBy("lang").agg(named.alias("g")).join(sizes, "lang")
    totals = totals.select("lang", "n_terms", F.col("g.source").alias("names"), F.col("g.n").alias("sums"))
    slots = max(1, -(-kept.count() // SLOT))
    totals = totals.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    dealt = kept.select("lang", "term", "sources", "counts", F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int").alias("slot"))
    found = dealt.groupBy("lang", "slot").cogroup(totals.groupBy("lang", "slot")).applyInArrow(divergences, FOUND)
    found = stored(found, "divergences")

    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    values = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(values, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", rank).unionByName(terms)
