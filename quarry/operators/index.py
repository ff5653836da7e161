"""Inverted index as tables of posting blocks, and three-level BM25 retrieval for many queries at once.

Documents are numbered in the order of their texts and cut into blocks. A posting list is one row per term
and block. Beside it stand the block's impacts (each frequency with the least length it occurs at), which bound what a
document of the block can score, whatever the mean length is. A search first reads the bounds of its
blocks, then the lists of the best blocks, and then only those blocks whose bound reaches the worst of the
hits found so far. An index is a list of segments: loads add one, and name the documents that it replaces.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import constants as K
from quarry.functions import text
from quarry.operators.ranking import spread_join, spread_out, top_k
from quarry.session import materialize

K1 = 1.2
B = 0.75
MAX_TERMS = 8
MAX_PREFIXES = 6
#: Documents of a block as a power of two, parts that the blocks of a term are spread over, and the
#: width of the steps in which bounds are counted to choose the first blocks.
BLOCK_BITS, PARTS, STEP = 10, 16, 0.25
#: Terms that are sent to every task, so that only their lists are shuffled; a larger log leaves the lists whole.
SENT_TERMS = 100_000
#: No list here is longer; for functions that ask for a length.
MAX_ROWS = 1 << 30
_SEGMENT_BITS = 48


@dataclass(frozen=True)
class Segment:
    """Tables of one load.

    postings(term, block, list of doc, tf, doc_len); blocks(term, part, block, n, impacts of tf, doc_len);
    vectors(doc, block, doc_len, tf as a map); terms(term, df) and stats(docs, length) are what the load changes in
    the whole index, so they may hold negative numbers for replaced documents.
    """

    postings: DataFrame
    blocks: DataFrame
    vectors: DataFrame
    terms: DataFrame
    stats: DataFrame


@dataclass(frozen=True)
class Index:
    """Segments, and dead(block, docs): documents of older segments that newer ones replace or drop."""

    segments: tuple[Segment, ...]
    dead: DataFrame | None = None

    @property
    def stats(self) -> DataFrame:
        """(n, avg_len), one row."""
        sums = _together(s.stats for s in self.segments).agg(F.sum("docs").alias("n"), F.sum("length").alias("length"))
        return sums.select("n", (F.col("length") / F.col("n")).alias("avg_len"))

    @property
    def terms(self) -> DataFrame:
        """(term, df) of all terms."""
        if len(self.segments) == 1:
            return self.segments[0].terms
        summed = _together(s.terms for s in self.segments).groupBy("term").agg(F.sum("df").alias("df"))
        return summed.filter("df > 0")

    @property
    def postings(self) -> DataFrame:
        """(term, doc, tf, doc_len) of the documents that are alive."""
        rows = _together(s.postings for s in self.segments)
        return _alive(rows, self).select("term", F.inline("list"))


def _together(tables: Iterable[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def _alive(rows: DataFrame, index: Index) -> DataFrame:
    """Rows (block, list, …) without the dead documents in their lists."""
    if index.dead is None:
        return rows
    kept = F.filter("list", lambda p: ~F.array_contains("docs", p["doc"]))
    return rows.join(index.dead, "block", "left").withColumn("list", F.when(F.col("docs").isNull(), F.col("list")).otherwise(kept)).drop("docs")


def count_terms(documents: DataFrame, key: str, text_column: str, pattern: str = K.INDEX_TERM_PATTERN) -> DataFrame:
    """(doc, doc_len, tf) of whole texts, sorted by text so that like documents share blocks.

    Terms are counted inside each document's row, so no document is ever regrouped.
    """
    ordered = documents.select(F.col(key).alias("doc"), F.col(text_column).alias("words"))
    ordered = ordered.repartitionByRange("words", "doc").sortWithinPartitions("words", "doc")
    listed = ordered.select("doc", F.sort_array(text.index_terms(F.col("words"), pattern)).alias("all_terms"))
    # In a sorted list the count of a term is the distance between its first and last place.
    distinct = F.array_distinct("all_terms")
    starts = F.filter(
        F.transform(
            "all_terms",
            lambda t, i: F.when(
                (i == 0) | (t != F.get("all_terms", F.greatest(i - 1, F.lit(0)))), i
            ),
        ),
        lambda i: i.isNotNull(),
    )
    counted = listed.select(
        "doc", F.size("all_terms").alias("doc_len"), distinct.alias("names"), starts.alias("starts")
    )
    counts = F.transform(
        "starts",
        lambda start, i: F.coalesce(F.get("starts", i + 1), F.col("doc_len")) - start,
    )
    return counted.select("doc", "doc_len", F.map_from_arrays("names", counts).alias("tf"))


def document_frequencies(documents: DataFrame, text_column: str, pattern: str = K.INDEX_TERM_PATTERN) -> DataFrame:
    """(term, df) as an index of the whole texts has them, counted inside the map tasks without building it."""
    distinct = F.array_distinct(text.index_terms(F.col(text_column), pattern))
    return documents.select(F.explode(distinct).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def make_segment(counted: DataFrame, number: int, write: Callable[[DataFrame, str], DataFrame] = materialize) -> Segment:
    """The tables of ``count_terms``' rows, written by ``write``. Blocks are numbered within the segment."""
    place = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS) + F.lit(number << _SEGMENT_BITS)
    vectors = write(counted.withColumn("block", place).select("doc", "block", "doc_len", "tf"), "vectors")
    listed = vectors.select("block", "doc", "doc_len", F.explode("tf").alias("term", "tf"))
    grouped = listed.groupBy("term", "block").agg(F.collect_list(F.struct("doc", "tf", "doc_len")).alias("list"))
    postings = write(grouped, "postings")

    def least_length(tf: Column) -> Column:
        same = F.filter("list", lambda p: p["tf"] == tf)
        return F.array_min(F.transform(same, lambda p: p["doc_len"]))

    impacts = F.transform(F.array_distinct("list.tf"), lambda tf: F.struct(tf.alias("tf"), least_length(tf).alias("doc_len")))
    part = F.pmod("block", F.lit(PARTS)).cast("int")
    blocks = write(postings.select("term", part.alias("part"), "block", F.size("list").alias("n"), impacts.alias("impacts")), "blocks")
    terms = write(blocks.groupBy("term").agg(F.sum("n").alias("df")), "terms")
    sums = vectors.agg(F.count("*").alias("docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("length"))
    return Segment(postings, blocks, vectors, terms, write(sums, "stats"))


def build_index(documents: DataFrame, key: str, text_column: str, pattern: str = K.INDEX_TERM_PATTERN) -> Index:
    """Index of the whole texts in one segment."""
    return Index((make_segment(count_terms(documents, key, text_column, pattern), 0),))


def alive_vectors(index: Index) -> DataFrame:
    """(doc, block, doc_len, tf) of the documents that are alive."""
    rows = _together(s.vectors for s in index.segments)
    if index.dead is None:
        return rows
    return rows.join(index.dead.select("block", F.explode("docs").alias("doc")), ["block", "doc"], "left_anti")


def add_segment(
    index: Index, changed: DataFrame, gone: DataFrame, write: Callable[[DataFrame, str], DataFrame] = materialize
) -> Index:
    """The index after documents were added, replaced (``changed``: doc, words) or dropped (``gone``: doc).

    Only those documents are read. What their old rows counted is subtracted: their terms, their number and their
    length go into the new segment's changes, and their old places into the list of the dead.
    """
    counted = count_terms(changed, "doc", "words")
    number = len(index.segments)
    fresh = make_segment(counted, number, lambda df, name: write(df, f"new-{name}") if name in ("terms", "stats") else write(df, name))
    named = changed.select("doc").unionByName(gone.select("doc")).distinct()
    old = write(alive_vectors(index).join(named, "doc", "left_semi"), "replaced")
    lost = old.select(F.explode(F.map_keys("tf")).alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
    terms = write(fresh.terms.unionByName(lost).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0"), "terms")
    sums = old.agg((-F.count("*")).alias("docs"), F.coalesce(-F.sum("doc_len"), F.lit(0)).alias("length"))
    stats = write(fresh.stats.unionByName(sums).agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")), "stats")
    places = old.select("block", "doc")
    if index.dead is not None:
        places = places.unionByName(index.dead.select("block", F.explode("docs").alias("doc")))
    dead = write(places.groupBy("block").agg(F.collect_list("doc").alias("docs")), "dead")
    return Index((*index.segments, Segment(fresh.postings, fresh.blocks, fresh.vectors, terms, stats)), dead)


def merge_segments(index: Index, write: Callable[[DataFrame, str], DataFrame] = materialize) -> Index:
    """One segment of all documents that are alive, made from the counted terms; no text is read again."""
    return Index((make_segment(alive_vectors(index).orderBy("block").select("doc", "doc_len", "tf"), 0, write),))


def _idf(df: Column, n: Column) -> Column:
    raw = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(1e-6))


def _gain(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))


def search_keys(understood: DataFrame, limit: int = MAX_TERMS) -> DataFrame:
    """Queries with the terms they search for."""
    termed = understood.withColumn("terms", text.search_terms(F.col("retrieval_tokens"), limit))
    return termed.filter(F.size("terms") > 0)


def distinct_searches(keyed: DataFrame) -> DataFrame:
    """The distinct term lists of the queries as (search, terms), numbered for short join keys.

    Written, so that the numbers stay the same wherever the table is read again.
    """
    lists = keyed.select("terms").distinct()
    return materialize(lists.withColumn("search", F.monotonically_increasing_id()), "searches")


def of_terms(index: Index, terms: DataFrame) -> Index:
    """The index with the blocks and lists of ``terms`` alone, if these are few enough to be sent to every task."""
    if terms.limit(SENT_TERMS + 1).count() > SENT_TERMS:
        return index
    kept = F.broadcast(terms)
    return Index(tuple(
        replace(s, postings=s.postings.join(kept, "term", "left_semi"), blocks=s.blocks.join(kept, "term", "left_semi"))
        for s in index.segments
    ), index.dead)


def weighed_terms(searches: DataFrame, index: Index) -> DataFrame:
    """(search, n_terms, term, df, idf) of the terms that the index knows."""
    placed = searches.select("search", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    known = _together(placed.join(s.terms, "term") for s in index.segments)
    if len(index.segments) > 1:
        known = known.groupBy("search", "n_terms", "term").agg(F.sum("df").alias("df")).filter("df > 0")
    n = index.stats.select("n").scalar()
    return known.select("search", "n_terms", "term", "df", _idf(F.col("df"), n).alias("idf"))


def search_blocks(weighed: DataFrame, index: Index) -> DataFrame:
    """(search, n_terms, block, held, bound, fewest, most): the blocks that hold terms of a search.

    ``held`` are the terms found there with their weights, ``bound`` is what a document of the block can score
    at most, ``fewest`` and ``most`` are the lengths of the shortest and longest list. The rows of
    lists are not read. A frequent term's blocks are spread over PARTS join keys.
    """
    avg_len = index.stats.select("avg_len").scalar()
    asked = weighed.drop("df").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    best = F.array_max(F.transform("impacts", lambda i: _gain(i["tf"], i["doc_len"], F.col("avg_len"))))
    rows = _together(asked.join(s.blocks, ["term", "part"]) for s in index.segments).withColumn("avg_len", avg_len)
    return rows.groupBy("search", "n_terms", "block").agg(
        F.collect_list(F.struct("term", "idf")).alias("held"), F.sum(F.col("idf") * best).alias("bound"),
        F.min("n").alias("fewest"), F.max("n").alias("most"),
    )


def _with_lists(chosen: DataFrame, index: Index, columns: list[str]) -> DataFrame:
    """One row per block of ``chosen`` (search, n_terms, block, held) and term, with the list; a block's rows together."""
    asked = chosen.select("search", "n_terms", "block", F.inline("held"))
    lists = F.arrays_zip(*[F.col(f"list.{c}").alias(c) for c in columns]).alias("list")
    joined = _together(asked.join(s.postings.select("term", "block", lists), ["term", "block"]) for s in index.segments)
    return _alive(joined, index).repartition("search", "block")


def _common(chosen: DataFrame, index: Index, columns: list[str]) -> DataFrame:
    """(search, block, lists, docs): blocks with documents that hold all terms, and these documents."""
    lists = F.collect_list(F.struct("idf", "list")).alias("lists")
    met = _with_lists(chosen, index, columns).groupBy("search", "n_terms", "block").agg(lists).filter(F.size("lists") == F.col("n_terms"))
    shared = F.aggregate(F.slice("lists", 2, MAX_ROWS), F.get("lists", F.lit(0))["list"]["doc"], lambda a, x: F.array_intersect(a, x["list"]["doc"]))
    return met.withColumn("docs", shared).filter(F.size("docs") > 0)


def block_hits(chosen: DataFrame, index: Index, whole: bool) -> DataFrame:
    """(search, doc, bm25) of the chosen blocks; with ``whole`` only documents that hold all terms.

    All lists of a block meet in one task, so its documents are added up there without another shuffle.
    Scores are rounded so that the order of summing cannot reorder equal matches.
    """
    avg_len = index.stats.select("avg_len").scalar()
    part = F.col("idf") * _gain(F.col("tf"), F.col("doc_len"), avg_len)
    if whole:
        found = _common(chosen, index, ["doc", "tf", "doc_len"]).select("search", "block", "docs", F.inline("lists"))
        among = F.filter("list", lambda p: F.array_contains("docs", p["doc"]))
        rows = found.select("search", "block", "idf", F.inline(among))
    else:
        rows = _with_lists(chosen, index, ["doc", "tf", "doc_len"]).select("search", "block", "idf", F.inline("list"))
    summed = rows.groupBy("search", "block", "doc").agg(F.round(-F.sum(part), 9).alias("bm25"))
    return summed.select("search", "doc", "bm25")


def count_block_hits(chosen: DataFrame, index: Index, whole: bool) -> DataFrame:
    """(search, hits): documents of the chosen blocks, from the names in their lists alone."""
    if whole:
        found = _common(chosen, index, ["doc"])
    else:
        docs = F.array_distinct(F.flatten(F.collect_list("list.doc"))).alias("docs")
        found = _with_lists(chosen, index, ["doc"]).groupBy("search", "block").agg(docs)
    return found.groupBy("search").agg(F.sum(F.size("docs")).alias("hits"))


@dataclass(frozen=True)
class Bounded:
    """Best hits (search, doc, bm25, hit_rank), all hits that were scored, and blocks: scored, and left unread."""

    best: DataFrame
    scored: list[DataFrame]
    read: list[DataFrame]
    unread: DataFrame | None


def bounded_hits(blocks: DataFrame, index: Index, pool: int, whole: bool) -> Bounded:
    """Best ``pool`` hits of each search among the given blocks.

    The first pass takes blocks from the highest bounds down, until they hold about ``pool`` hits. Where they
    give as many, the worst of these is a threshold, and the second pass takes only blocks whose bound reaches
    it; a search that finds fewer reads all its blocks, as does one whose other blocks hold no more hits than
    the first ones. A search's blocks are counted by steps of their bounds, so no task sorts all of them.
    """
    def cut(hits: DataFrame) -> DataFrame:
        return top_k(hits, ["search"], [F.asc("bm25"), F.asc("doc")], pool, rank="hit_rank", spread_by="doc")

    estimate = "fewest" if whole else "most"
    stepped = blocks.withColumn("step", F.floor(F.col("bound") / STEP))
    counted = stepped.groupBy("search", "step").agg(F.sum(estimate).alias("hits"))
    down = Window.partitionBy("search").orderBy(F.desc("step"))
    enough = counted.withColumn("above", F.sum("hits").over(down)).filter(F.col("above") >= pool).groupBy("search").agg(
        F.max("step").alias("limit"), F.min("above").alias("first"), F.max("above").alias("every")
    )
    limits = materialize(enough.filter("every > 2 * first"), "limits")
    if limits.isEmpty():
        scored = materialize(block_hits(blocks, index, whole), "hit-sums")
        return Bounded(materialize(cut(scored), "best"), [scored], [blocks], None)
    limited = stepped.join(limits.select("search", "limit"), "search", "left")
    is_first = F.coalesce(F.col("step") >= F.col("limit"), F.lit(True))
    first, rest = limited.filter(is_first), limited.filter(~is_first)
    scored = materialize(block_hits(first, index, whole), "hit-sums")
    best = materialize(cut(scored), "best")
    worst = best.filter(F.col("hit_rank") == pool).select("search", F.col("bm25").alias("worst"))
    judged = materialize(
        rest.join(worst, "search", "left").withColumn("reaches", F.coalesce(-F.col("bound") <= F.col("worst") + 1e-6, F.lit(True))),
        "judged-blocks",
    )
    second, unread = judged.filter("reaches"), judged.filter("NOT reaches")
    more = materialize(block_hits(second, index, whole), "hit-sums")
    together = best.drop("hit_rank").unionByName(more)
    return Bounded(materialize(cut(together), "best"), [scored, more], [first, second], unread)


def _hit_counts(found: Bounded, weighed: DataFrame, index: Index, whole: bool) -> DataFrame:
    """(search, hit_count): scored hits and those of unread blocks; of searches for one term its number of documents."""
    several = found.best.select("search").distinct()
    parts = [h.groupBy("search").agg(F.count("*").alias("hits")) for h in found.scored]
    if found.unread is not None:
        parts.append(count_block_hits(found.unread.filter("n_terms > 1"), index, whole))
    counted = _together(parts).groupBy("search").agg(F.sum("hits").alias("hits")).join(several, "search")
    alone = weighed.filter("n_terms = 1").select("search", F.col("df").alias("alone"))
    return counted.join(alone, "search", "left").select("search", F.coalesce("alone", "hits").alias("hit_count"))


def _prefix_hits(searches: DataFrame, index: Index, prefixes: int | None) -> DataFrame:
    """(search, doc, bm25) of documents that hold a term starting with one of the first ``prefixes`` terms.

    A prefix counts as one term: its frequencies are those of all terms it covers together.
    """
    n = index.stats.select("n").scalar()
    avg_len = index.stats.select("avg_len").scalar()
    some = F.col("terms") if prefixes is None else F.slice("terms", 1, prefixes)
    wanted = searches.select("search", F.explode(some).alias("prefix"))
    asked = wanted.select("prefix").distinct()
    longer = F.transform(F.sequence(F.lit(1), F.length("term")), lambda k: F.left("term", k))
    covered = materialize(index.terms.select("term", F.explode(longer).alias("prefix")).join(asked, "prefix"), "prefix-terms")
    index = of_terms(index, covered.select("term").distinct())
    spread = covered.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    spread = spread_out(spread, "term")
    joined = _together(
        spread.join(s.blocks.select("term", "part", "block"), ["term", "part"]).join(s.postings, ["term", "block"]) for s in index.segments
    )
    listed = _alive(joined, index).repartition("prefix", "block").select("prefix", "block", F.inline("list"))
    found = listed.groupBy("prefix", "block", "doc").agg(F.sum("tf").alias("tf"), F.first("doc_len").alias("doc_len"))
    found = materialize(found, "prefix-hits")
    weights = found.groupBy("prefix").agg(F.count("*").alias("df")).select("prefix", _idf(F.col("df"), n).alias("idf"))
    gain = _gain(F.col("tf"), F.col("doc_len"), avg_len)
    parts = wanted.join(weights, "prefix").join(found, "prefix").select("search", "doc", (-F.col("idf") * gain).alias("part"))
    return parts.groupBy("search", "doc").agg(F.round(F.sum("part"), 9).alias("bm25"))


def best_hits(
    searches: DataFrame, index: Index, pool: int, prefixes: int | None = MAX_PREFIXES, counts: bool = True
) -> DataFrame:
    """Strongest ``pool`` hits per search of the first level that has any: all terms, any term, any prefix.

    The last level takes the first ``prefixes`` terms of a search as prefixes, as product search does; None takes all.
    (search, doc, bm25, hit_rank, level), with ``counts`` also hit_count, the number of all hits of the level. Without
    it blocks that cannot hold one of the best hits are never read.
    """
    weighed = materialize(weighed_terms(searches, index), "weighed")
    every, index = index, of_terms(index, weighed.select("term").distinct())
    blocks = materialize(search_blocks(weighed, index), "search-blocks")
    levels, left = [], searches
    for level in (1, 2):
        whole = level == 1
        mine = blocks.filter(F.size("held") == F.col("n_terms")) if whole else blocks.filter("n_terms > 1").join(left, "search", "left_semi")
        found = bounded_hits(mine, index, pool, whole)
        best = found.best.withColumn("level", F.lit(level))
        if counts:
            best = best.join(materialize(_hit_counts(found, weighed, index, whole), "hit-counts"), "search")
        levels.append(best)
        left = materialize(left.join(found.best.select("search").distinct(), "search", "left_anti"), "searches-left")
    scored = materialize(_prefix_hits(left, every, prefixes), "hit-sums")
    best = top_k(scored, ["search"], [F.asc("bm25"), F.asc("doc")], pool, rank="hit_rank", spread_by="doc").withColumn("level", F.lit(3))
    if counts:
        best = best.join(scored.groupBy("search").agg(F.count("*").alias("hit_count")), "search")
    return _together([*levels, best])


def count_hits(best: DataFrame) -> DataFrame:
    """Per search the level its hits come from and their number."""
    return best.filter("hit_rank = 1").select("search", "level", "hit_count")


def retrieve(understood: DataFrame, index: Index, pool: int, counts: bool = True) -> DataFrame:
    """Candidates of every query: (query_id[, customer_inn], doc, bm25, level, hit_rank), with ``counts`` also hit_count.

    The hits are written before they meet the queries, so that the driver does not plan all levels with what follows.
    """
    keyed = search_keys(understood)
    searches = distinct_searches(keyed)
    who = [c for c in ("customer_inn",) if c in keyed.columns]
    asked = materialize(keyed.select("query_id", *who, "terms").join(searches, "terms").drop("terms"), "asked-searches")
    hits = materialize(best_hits(searches, index, pool, counts=counts), "best-hits")
    # One search may be asked by most users, so its queries are spread over many join keys.
    return spread_join(asked, hits, "search", "query_id").drop("search")
