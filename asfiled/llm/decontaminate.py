"""Benchmark passages in training documents: found as word windows, checked, removed.

Windows of the benchmark, ten normalised words each, go to every executor as a hash table. The
documents are scanned once: their windows are hashed where they lie and looked up, and only a
window whose hash is known is compared word by word. What leaves the scan is one row per document
and one per verified hit, never a row per window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import fresh, ascii_lower, text_key

#: Words after lower-casing A-Z, and the same words in a text as it stands.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLAIN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD_AND_REST = rf"^[{_PLAIN}]+|[^{_PLAIN}]+[{_PLAIN}]*"

#: Windows in one broadcast table; a larger benchmark is looked up in several passes.
BROADCAST_WINDOWS = 500_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def benchmark_windows(items: DataFrame, size: int, text: str = "text",
                      item_id: str = "item_id") -> DataFrame:
    """One row per window and item: ``_hash``, ``_length``, ``_window``, ``_item``.

    An item shorter than a window is one window; an item without words has none.
    """
    words = items.select(F.col(item_id).cast("string").alias("_item"),
                         words_of(F.col(text)).alias("_words")).filter(F.size("_words") > 0)
    length = F.least(F.lit(size), F.size("_words"))
    return (words.select("_item", length.alias("_length"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("_words") - length + 1),
        lambda at: F.slice("_words", at, length))).alias("_window"))
        .select("_item", "_length", "_window", F.xxhash64("_window").alias("_hash")).distinct())


def _hits(docs: DataFrame, windows: DataFrame, lengths: list[int], doc_id: str, text: str,
          broadcast: bool) -> DataFrame:
    """Per document (rows of equal id and text are one): copies, words, verified windows."""
    read = docs.select(F.col(doc_id).alias("_doc"), text_key(doc_id, text).alias("_text"),
                       words_of(F.col(text)).alias("_words"))
    nothing = "named_struct('at', 0, 'length', 0, 'hash', 0L)"
    scanned = [
        f"if(size(_words) >= {n}, transform(sequence(1, size(_words) - {n - 1}), at -> "
        f"named_struct('at', at, 'length', {n}, 'hash', xxhash64(slice(_words, at, {n})))), "
        f"array_except(array({nothing}), array({nothing})))" for n in lengths]
    looked = read.selectExpr("_doc", "_text", "_words", "size(_words) as _n_words",
                             f"explode(concat(array({nothing}), {', '.join(scanned)})) as _at"
                             if scanned else f"explode(array({nothing})) as _at")
    known = windows.withColumnsRenamed({"_length": "_known_length", "_hash": "_known_hash"})
    same = ((F.col("_at.hash") == F.col("_known_hash"))
            & (F.col("_at.length") == F.col("_known_length"))
            & (F.slice("_words", F.greatest(F.col("_at.at"), F.lit(1)), F.col("_at.length"))
               == F.col("_window")))
    found = looked.join(F.broadcast(known) if broadcast else known, same, "left")
    return (found.filter("_at.length = 0 or _window is not null").groupBy("_doc", "_text").agg(
        F.count_if(F.col("_at.length") == 0).alias("_copies"),
        F.max("_n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("_window").isNotNull(), F.struct(
            F.col("_at.at").alias("start"),
            (F.col("_at.at") + F.col("_at.length") - 1).alias("end")))).alias("_spans"),
        F.collect_set("_item").alias("_items")))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """What of the benchmark each document holds; a row for each row of ``docs``.

    Columns: the id, ``text_key``, ``n_words``, ``n_hit`` (words inside any window found),
    ``spans`` (array of first and last hit word, counted from 1, apart from each other),
    ``items`` (ids as strings, sorted as strings) and ``contaminated``. ``text_key`` with the id
    finds the row again; rows equal in both are equal in the rest.

    A null or empty text has no words and no hits; an item without words is never found, and an
    empty benchmark finds nothing. A null id is an id like others. Repeated rows each keep a row.
    Texts are scanned whole; other columns are not looked at. The benchmark is broadcast in parts
    of at most ``broadcast_windows`` windows, one pass over the documents for each part.
    """
    windows = benchmark_windows(items, size, item_text, item_id)
    counted = {r["_length"]: r["count"] for r in windows.groupBy("_length").count().collect()}
    parts = max(1, -(-sum(counted.values()) // broadcast_windows))
    passes = [_hits(docs, windows.filter(F.pmod("_hash", F.lit(parts)) == part)
                    if parts > 1 else windows, sorted(counted), doc_id, text, bool(counted))
              for part in range(parts)]
    found = passes[0]
    if parts > 1:
        found = (reduce(DataFrame.unionByName, passes).groupBy("_doc", "_text").agg(
            F.max("_copies").alias("_copies"), F.max("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_list("_spans"))).alias("_spans"),
            F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items")))
    # Windows overlap; in order of their starts they melt into spans that do not touch.
    melt = """aggregate(array_sort(_spans), cast(array() as array<struct<start:int,end:int>>),
        (done, s) -> if(size(done) > 0 and s.start <= element_at(done, -1).end + 1,
            concat(slice(done, 1, size(done) - 1), array(named_struct(
                'start', element_at(done, -1).start,
                'end', greatest(s.end, element_at(done, -1).end)))),
            concat(done, array(named_struct('start', s.start, 'end', s.end)))))"""
    n_hit = "aggregate(spans, 0L, (n, s) -> n + s.end - s.start + 1)"
    rows = found.withColumn("spans", F.expr(melt)).selectExpr(
        f"_doc as `{doc_id}`", "_text as text_key", "n_words", f"{n_hit} as n_hit", "spans",
        "array_sort(_items) as items", "size(spans) > 0 as contaminated",
        "explode(sequence(1L, _copies)) as _copy")
    return rows.drop("_copy")


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", size: int = 10,
                  doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """``docs`` without the benchmark: without the documents that hold any of it, or, with
    ``remove="spans"``, without the hit words and what stands between and after them.

    Clean rows come out as they are, also null and empty texts. Columns stay those of ``docs``,
    whatever they are named.
    """
    doc, key, own, spans = fresh(docs, "_doc", "_key", "_own_key", "_spans")
    found = (contamination(docs, items, size, doc_id, text, item_id, item_text)
             .filter("contaminated").select(F.col(doc_id).alias(doc), F.col("text_key").alias(key),
                                            F.col("spans").alias(spans))
             .dropDuplicates([doc, key]))
    keyed = docs.withColumn(own, text_key(doc_id, text))
    same = keyed[doc_id].eqNullSafe(found[doc]) & (F.col(own) == F.col(key))
    if remove == "documents":
        return keyed.join(found, same, "left_anti").drop(own)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    pieces = F.regexp_extract_all(F.col(text), F.lit(WORD_AND_REST), F.lit(0))
    # A leading piece without a word has number 0, the first word number 1.
    first = F.when(F.col(text).rlike(rf"^[{_PLAIN}]"), 0).otherwise(1)
    rest = F.filter(pieces, lambda _, i: ~F.exists(
        spans, lambda s: (i + first).between(s["start"], s["end"])))
    clean = F.when(F.col(spans).isNull(), F.col(text)).otherwise(F.array_join(rest, ""))
    return (keyed.join(found, same, "left")
            .select(*[clean.alias(c) if c == text else F.col(c) for c in docs.columns]))
