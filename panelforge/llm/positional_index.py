"""Benchmark decontamination by a distributed positional index (operator 4).

DataFrame functions only. The words of all documents that occur in the
benchmark are written as postings (document, position, term), and so is each
document's number of words. The index is cut by documents: each part holds the
lists of its own documents, sorted by term, so a list lies together in a part
while the list of a hot term is spread over all of them. A window (`width` consecutive words of an item, or
a whole shorter item) is looked up from its rarest term: its postings, moved
back by the term's offset, are candidate starts; they are intersected with the
moved list of the second rarest term, and what is left with the lists of all
terms, so a match is an exact phrase. Only lists of rare terms meet in the
first two steps.

The benchmark's terms and windows are broadcast while they are few (BROADCAST
rows); beyond that the same joins run shuffled, every term in SALTS parts.

Defined results: words are runs of the characters that are letters or digits
after lower-casing A-Z, or not ASCII; null text has none. An item without words
has no window. Windows of an item without id count for n_hit and contaminated,
but such an item is in neither n_items nor items_sha256. A document is a row:
rows of one doc_id are looked at on their own, a null doc_id like any other.
Texts of any length count whole; extra columns don't reach the index and come
through remove_contaminated as they are. Terms are matched as text when they are
indexed, by their 64-bit hashes afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, pick

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a table at most for a broadcast.
BROADCAST = 500_000
#: Parts that a term's rows are dealt to in a shuffled join.
SALTS = 16
#: Stands for the end of a document in the postings; no word holds it.
END = "\x01"


def ascii_lower(c: Column) -> Column:
    """A-Z only; the fast built-in where a text is ASCII altogether."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWERED))


def _split(c: Column) -> Column:
    """Words, with an empty one before or after where a separator stands."""
    return F.split(ascii_lower(F.coalesce(c, F.lit(""))), SEPARATOR)


def _small(df: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("merge")


def _at_terms(index: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The postings whose term is few's key, a column of few rows in most cases."""
    if few.limit(BROADCAST + 1).count() <= BROADCAST:
        return index.join(F.broadcast(few), F.col("term") == F.col(key), how)
    dealt = index.withColumn("salt", F.pmod(F.xxhash64("k1", "k2", "pos"), F.lit(SALTS)).cast("int"))
    each = few.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return dealt.join(each, (F.col("term") == F.col(key)) & (F.col("salt") == F.col("salt2")), how).drop("salt", "salt2")


def windows(items: DataFrame, width: int) -> DataFrame:
    """win, item, size, at (offset), word: the windows of all items."""
    i = pick(items, "item_id", "text")
    i = i.select(F.col("item_id").cast("string").alias("item"), F.filter(_split(F.col("text")), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    i = i.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))))
    i = i.select("item", F.slice("w", F.col("start") + 1, width).alias("w")).distinct()
    i = i.select("item", F.xxhash64("item", "w").alias("win"), F.size("w").alias("size"), F.posexplode("w").alias("at", "word"))
    return i


def postings(docs: DataFrame, words: DataFrame) -> DataFrame:
    """k1, k2 (the document: its id and the hash of its text), pos, term: every
    place of the given words, and one row of term 0 for each document, whose
    pos is its number of words."""
    terms = _small(words.select("word").distinct().unionByName(words.sparkSession.createDataFrame([(END,)], "word string")))
    d = pick(docs, "doc_id", "text")
    d = d.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64("text").alias("k2"), _split(F.col("text")).alias("w"))
    lead = (F.element_at("w", 1) == "").cast("int")
    d = d.select("k1", "k2", "w", lead.alias("lead"), (lead + ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")).alias("both"))
    d = d.select("k1", "k2", "lead", "both", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("p", "word")).join(terms, "word")
    end = F.col("word") == END
    d = d.select("k1", "k2", (F.col("p") - F.when(end, F.col("both")).otherwise(F.col("lead"))).alias("pos"),
                 F.when(end, F.lit(0).cast("long")).otherwise(F.xxhash64("word")).alias("term"))
    return d.sortWithinPartitions("term", "k1", "pos")


def phrases(index: DataFrame, wins: DataFrame) -> DataFrame:
    """k1, k2, start, size, item: the exact occurrences of the windows."""
    lists = index.where("term != 0").groupBy("term").agg(F.count("*").alias("df"))
    w = wins.withColumn("term", F.xxhash64("word"))
    # One row a term of the benchmark; a common term is in very many windows.
    lists = cut(lists, "lists")
    known = cut(w.join(_small(lists), "term", "left").groupBy("win", "item", "size").agg(
        F.sort_array(F.collect_list(F.struct("df", "at", "term"))).alias("by"),
        F.sort_array(F.collect_list(F.struct("at", "term"))).alias("all")), "window")
    # A term the corpus doesn't hold has no list: its windows can't occur.
    known = known.where(F.forall("by", lambda x: x.df.isNotNull()))
    first = known.select("win", "item", "size", F.col("by")[0].term.alias("t1"), F.col("by")[0].at.alias("o1"),
                         F.get("by", F.lit(1)).term.alias("t2"), F.get("by", F.lit(1)).at.alias("o2"))
    p = index.where("term != 0")
    found = _at_terms(p, first, "t1").select(
        "k1", "k2", (F.col("pos") - F.col("o1")).alias("start"), "win", "item", "size", "t2", "o2").where("start >= 0")
    found = cut(found.distinct(), "first")
    second = first.select("t2").where("t2 is not null").distinct()
    rare = _at_terms(p, second, "t2", "left_semi").select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("pos").alias("rp"), F.col("term").alias("rt"))
    both = found.where("t2 is not null").join(rare, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2"))
                                              & (F.col("start") + F.col("o2") == F.col("rp")) & (F.col("t2") == F.col("rt")), "left_semi")
    left = cut(both.unionByName(found.where("t2 is null")).select("k1", "k2", "start", "win", "item", "size"), "second")
    docs = _small(left.select("k1", "k2").distinct())
    places = p.join(docs, ["k1", "k2"], "left_semi").distinct()
    each = _small(known.select("win", "item", F.explode("all").alias("x")).select(F.col("win").alias("w2"), F.col("item").alias("i2"), "x.at", "x.term"))
    want = left.join(each, (left.win == F.col("w2")) & left.item.eqNullSafe(F.col("i2"))).select(
        "k1", "k2", "start", "win", "item", "size", (F.col("start") + F.col("at")).alias("pos"), "term")
    out = want.join(places, ["k1", "k2", "pos", "term"]).groupBy("k1", "k2", "start", "win", "item", "size").agg(F.count("*").alias("n"))
    out = cut(out.where("n = size").select("k1", "k2", "start", "size", "item"), "phrase")
    drop(found, left, lists)
    return out


def near(index: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """Proximity matches of (query, word) rows: query, k1, k2, pos of the rarest
    word where every other word of the query stands less than `within` words
    away from it, on either side."""
    p = index.where("term != 0")
    q = queries.select("query", F.xxhash64("word").alias("term")).distinct()
    lists = p.groupBy("term").agg(F.count("*").alias("df"))
    by = q.join(lists, "term", "left").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("df", "term"))).alias("by"))
    by = by.where(F.forall("by", lambda x: x.df.isNotNull()))
    rare = by.select("query", F.col("by")[0].term.alias("t1"), (F.size("by") - 1).alias("others"))
    start = _at_terms(p, rare, "t1").select("query", "others", "k1", "k2", "pos").distinct()
    rest = by.select(F.col("query").alias("q2"), F.explode(F.slice("by", 2, 1 << 20)).alias("x")).select("q2", F.col("x.term").alias("term"))
    want = start.join(_small(rest), start.query == F.col("q2"))
    other = p.select(F.col("k1").alias("a"), F.col("k2").alias("b"), F.col("pos").alias("op"), F.col("term").alias("ot")).distinct()
    met = want.join(other, (want.k1 == other.a) & (want.k2 == other.b) & (want.term == other.ot) & (F.abs(want.pos - other.op) < within), "left_semi")
    full = met.groupBy("query", "others", "k1", "k2", "pos").agg(F.count("*").alias("n")).where("n = others")
    return full.select("query", "k1", "k2", "pos").unionByName(start.where("others = 0").select("query", "k1", "k2", "pos"))


def _hits(match: DataFrame) -> DataFrame:
    """k1, k2, hits, n_items, items: words inside any occurrence, and the items."""
    spans = F.sort_array(F.collect_set(F.struct(F.col("start").cast("long").alias("a"), (F.col("start") + F.col("size")).cast("long").alias("b"))))
    zero = F.lit(0).cast("long")
    merged = F.aggregate(F.col("spans"), F.struct(zero.alias("end"), zero.alias("n")),
                         lambda acc, x: F.struct(F.greatest(acc.end, x.b).alias("end"), (acc.n + F.greatest(zero, x.b - F.greatest(x.a, acc.end))).alias("n")),
                         lambda acc: acc.n)
    got = match.groupBy("k1", "k2").agg(spans.alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    return got.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), merged.alias("hits"), F.size("items").cast("long").alias("items_n"), F.array_join("items", ",").alias("items"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and k2 (the
    hash of the text) of every document."""
    wins = cut(windows(items, width), "windows")
    index = cut(postings(docs, wins), "postings")
    hits = _hits(phrases(index, wins))
    d = index.where("term = 0").select("k1", "k2", F.col("pos").cast("long").alias("n_words"))
    out = d.join(hits, (d.k1 == hits.h1) & (d.k2 == hits.h2), "left")
    n = F.coalesce("hits", F.lit(0)).cast("long")
    return out.select(F.when(F.col("k1") != -(1 << 63), F.col("k1")).alias("doc_id"), "n_words", n.alias("n_hit"), F.coalesce("items_n", F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n > 0).alias("contaminated"), "k2")


def remove_contaminated(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The documents, all columns, without those that hold a window."""
    names = docs.columns
    bad = contamination(docs, items, width).where("contaminated").select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_pf_1"), F.col("k2").alias("_pf_2")).distinct()
    d = docs.withColumns({"_pf_k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_pf_k2": F.xxhash64("text")})
    return d.join(bad, (d._pf_k1 == bad._pf_1) & (d._pf_k2 == bad._pf_2), "left_anti").select(*[F.col(f"`{c}`") for c in names])
