"""Benchmark decontamination by winnowing, with DataFrame functions only.

The words of a text are hashed, each run of k = size // 2 words is a gram, and of the size - k + 1 neighbouring grams of
each window of `size` words the least hash is kept. A window that two texts share has the same least gram in both, so
no shared stretch of `size` words is missed. Kept grams (anchors) of documents are joined with those of the items; a hit is extended
to all words of its window, and these are joined with the items' windows, so clashes of gram hashes cost time
and nothing else. Words are compared by 64-bit hashes.

An item of fewer words than `size` is one window; documents are then searched for all runs of that length too.

Windows are generated, hashed and held against the sent anchors within one stage of generated code, so only windows
whose anchor is known are shuffled. What is counted by text is counted once for all copies of it: rows are keyed by
the text's digest until the end. Windows of the same items share the digest of that set, and documents with the same
sets share one list of items, so a passage of many items in many documents makes no product of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import let
from .common import fresh, written

SIZE = 10
SENT = 1 << 21  # anchors, counted first, up to which they are sent to all executors (8 bytes each)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # words are the same in either case


def _inner(parts: Column) -> Column:
    """Pieces of a split text without the empty ones, which can only be the first and the last."""
    first, last = (F.element_at(parts, at) == "" for at in (1, -1))
    return F.slice(parts, F.when(first, 2).otherwise(1), F.greatest(F.size(parts) - first.cast("int") - last.cast("int"), F.lit(0)))


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters, digits and characters beyond ASCII; none of null."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return let(F.split(lowered, _SEPARATORS), _inner)


def count_words(text: Column) -> Column:
    empty = lambda parts, at: (F.element_at(parts, at) == "").cast("int")
    n = lambda parts: F.greatest(F.size(parts) - empty(parts, 1) - empty(parts, -1), F.lit(0))
    return let(F.split(F.coalesce(text, F.lit("")), _SEPARATORS), n).cast("long")


def windows_of(texts: DataFrame, sizes: list[int], size: int) -> DataFrame:
    """texts (with `h`, the hashes of a text's words) by all windows of the given lengths, `size` or fewer: start, in words
    from 0, the words' hashes w0, w1, ... (null behind the window's last) and the window's anchor."""
    k = size // 2
    own = [c for c in texts.columns if c != "h"]
    least = min(sizes)
    starts = F.when(F.size("h") >= least, F.sequence(F.lit(0), F.size("h") - least))
    rows = texts.select(*own, "h", F.explode(starts).alias("start"))
    w = [F.col(f"w{j}") for j in range(max(sizes))]
    rows = rows.select(*own, "start", *[F.get("h", F.col("start") + j).alias(f"w{j}") for j in range(len(w))])

    def anchor(m: int) -> Column:
        grams = [F.xxhash64(F.lit(m), *w[j : j + k]) for j in range(m - k + 1)] if m == size else [F.xxhash64(F.lit(m), *w[:m])]
        return F.when(w[m - 1].isNotNull(), F.least(*grams) if len(grams) > 1 else grams[0])

    if len(sizes) == 1:
        return rows.withColumn("anchor", anchor(sizes[0])).filter(F.col("anchor").isNotNull())
    found = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), anchor(m).alias("anchor")) for m in sizes])).alias("f")
    rows = rows.select("*", found).filter(F.col("f.anchor").isNotNull())
    return rows.select(*own, "start", *[F.when(F.col("f.m") > j, w[j]).alias(f"w{j}") for j in range(len(w))], F.col("f.anchor").alias("anchor"))


def _as_array(n: int) -> Column:
    """The words' hashes of a window as one value."""
    return F.array_compact(F.array(*[F.col(f"w{j}") for j in range(n)]))


def _hashed(words: Column) -> Column:
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.coalesce(hashes, F.array().cast("array<bigint>")).alias("h")  # never null, so no filter makes it once more


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(window, anchor, item_id): the distinct windows of each item, an array of its words' hashes, and their anchors."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), _hashed(words_of(F.col("text"))))
    length = F.least(F.size("h"), F.lit(size))
    sizes = sorted(r["n"] for r in rows.select(length.alias("n")).filter("n > 0").distinct().collect())  # size at most
    if not sizes:
        return items.sparkSession.createDataFrame([], "window array<bigint>, anchor bigint, item_id string")
    found = windows_of(rows.withColumn("n", length), sizes, size).withColumn("window", _as_array(max(sizes)))
    return found.filter(F.size("window") == F.col("n")).select("window", "anchor", "item_id").distinct()


def occurrences(texts: DataFrame, windows: DataFrame, size: int = SIZE) -> DataFrame:
    """(key, start, size, set_id): where windows (window, anchor, set_id) of the items stand in texts (key, text). start
    counts words from 0."""
    sizes = sorted(r["n"] for r in windows.select(F.size("window").alias("n")).distinct().collect())  # size at most
    if not sizes:
        return texts.sparkSession.createDataFrame([], "key binary, start int, size int, set_id string")
    anchors = written(windows.select("anchor").distinct(), "anchors", small=True)
    near = windows_of(texts.select("key", _hashed(words_of(F.col("text")))), sizes, size)
    near = near.join(F.broadcast(anchors) if anchors.count() <= SENT else anchors, "anchor", "left_semi")
    near = near.select("key", "start", _as_array(max(sizes)).alias("window"))
    return near.join(windows.select("window", "set_id"), "window").select("key", "start", F.size("window").alias("size"), "set_id")


def _covered(spans: Column) -> Column:
    """Words that a sorted array<struct<start, size>> covers."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(a: Column, s: Column) -> Column:
        end = s["start"] + s["size"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(end - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"))

    return F.aggregate(spans, state, add, lambda a: a["n"])


def find_contamination(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """docs with n_words, hits (array<struct<start, size>>, the windows of items that stand there, in words), n_hit
    (words in them) and items (array<string>, the ids of those items, sorted); columns of docs that have one of these
    names are left out.

    Null and empty texts have no words and no hits; very long texts are searched
    whole. Repeated rows each have their result, rows without a doc_id like all others. An item without words
    has no windows; items that repeat an id count once, and those without an id mark words but aren't listed. Empty
    tables give no hits or no rows; other columns pass through.
    """
    marked = item_windows(items, size)
    h = lambda salt: F.xxhash64(F.lit(salt), F.col("item_id"))
    of = F.concat_ws("-", F.count("item_id"), F.sum(h(1).cast("decimal(38,0)")), F.bit_xor(h(2)))  # the same for the same items
    windows = written(marked.groupBy("window", "anchor").agg(of.alias("set_id")), "windows", small=True)
    sets = marked.filter(F.col("item_id").isNotNull()).join(windows.select("window", "set_id"), "window").select("set_id", "item_id").distinct()

    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    found = occurrences(docs.select(key.alias("key"), "text"), windows, size)
    spans = F.sort_array(F.collect_set(F.struct("start", "size"))).alias("hits")
    by_text = found.groupBy("key").agg(spans, F.sort_array(F.collect_set("set_id")).alias("sets"))
    by_text = written(by_text.withColumn("list_id", F.md5(F.array_join("sets", " "))), "hits")
    lists = by_text.groupBy("list_id").agg(F.first("sets").alias("sets")).select("list_id", F.explode("sets").alias("set_id"))
    lists = lists.join(sets, "set_id").groupBy("list_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    result = by_text.join(lists, "list_id", "left").select("key", "hits", _covered(F.col("hits")).alias("n_hit"), "items")

    made = ("n_words", "hits", "n_hit", "items")
    at = fresh(docs, "__key")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made and c != "text"]
    rows = docs.select(*own, count_words(F.col("text")).alias("n_words"), key.alias(at))
    return rows.join(result.withColumnRenamed("key", at), at, "left").select(
        *own, "n_words",
        F.coalesce("hits", F.array().cast("array<struct<start: int, size: int>>")).alias("hits"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def digest_contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document: words, words hit, items and their digest."""
    found = find_contamination(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
