"""Benchmark decontamination with spaced-seed hashing, in DataFrame operations alone.

A seed is a fixed mask over consecutive tokens; the tokens under its ones are hashed, those under its zeros are ignored, so a substituted
token there does not break the match. Test and training hashes meet in a join. Around each hit the test item is laid along the document
at the hit's offset and compared token by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, hint_small, is_small

#: Five tokens count in each. Either alone fits somewhere in any WINDOW of 13 tokens of which two are substituted.
MASKS = ("11001011", "11010011")
#: Tokens of an overlap (or the whole item, where that is shorter), and the share of them that must agree.
WINDOW, SIMILAR = 13, 0.8
#: By number of tokens, masks of shorter items: one of them fits somewhere whichever tokens are substituted, up to a fifth of them. Below 5 all tokens count.
SHORT_MASKS = {
    5: ("1111", "11101", "11011", "10111"), 6: ("1111", "11011"), 7: ("11011",), 8: ("1111",), 9: ("1111",), 10: ("11111", "111011", "11010011"), 11: ("111101", "110010011"), 12: ("11111", "111011"),
}
WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def seeds(toks: Column, mask: str, number: int) -> Column:
    """For each place where the mask fits, the hash of the tokens under its ones."""
    ones = [k for k, bit in enumerate(mask) if bit == "1"]
    starts = F.when(F.size(toks) >= len(mask), F.sequence(F.lit(0), F.size(toks) - len(mask))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(number), *(F.get(toks, i + k) for k in ones)))


def _all_seeds(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """Adds `pos` and `seed` to df (toks, ...), a row for each place and mask: all places of the first mask, then those of the next."""
    each = [seeds(F.col("toks"), m, n) for n, m in enumerate(masks)]
    # The array is a column before it is exploded: explode and the join after it then are compiled code and copy no row in between. The outer
    # form keeps the optimizer from testing the array's size first, which would compute it, and the tokens at each of its places, again.
    return df.withColumn("seeds", F.concat(*each)).select(*df.columns, F.posexplode_outer("seeds").alias("pos", "seed"))


def _place(masks: tuple[str, ...], size: Column) -> tuple[Column, Column]:
    """The token at which the seed at `pos` begins, and the number of its mask."""
    at, number, before = F.col("pos"), F.lit(0), F.lit(0)
    for n, mask in enumerate(masks):
        fits = F.greatest(size - len(mask) + 1, F.lit(0))
        at = F.when(F.col("pos") >= before, F.col("pos") - before).otherwise(at)
        number = F.when(F.col("pos") >= before, F.lit(n)).otherwise(number)
        before = before + fits
    return at, number


def masks_of(size: int, masks: tuple[str, ...] = MASKS, window: int = WINDOW) -> tuple[str, ...]:
    """The masks that find items of so many tokens."""
    if size >= window:
        return masks
    return SHORT_MASKS.get(size, masks if size >= 5 else ("1" * size,))


def _item_seeds(items: DataFrame, masks: tuple[str, ...], window: int) -> tuple[DataFrame, tuple[str, ...]]:
    """(key, item_at, seed) of items (key, item), each item by the masks for its number of tokens; and all masks used."""
    sizes = [r[0] for r in items.select(F.least(F.size("item"), F.lit(window)).alias("n")).distinct().collect()]  # no more than window
    used = tuple(sorted({m for n in sizes for m in masks_of(n, masks, window)}))
    at, number = _place(used, F.size("toks"))
    own = F.lit(False)
    for n in sizes:
        own = own | ((F.least(F.size("toks"), F.lit(window)) == n) & number.isin([used.index(m) for m in masks_of(n, masks, window)]))
    rows = _all_seeds(items.select("key", F.col("item").alias("toks")), used or ("1",))
    return rows.where(F.col("seed").isNotNull() & own).select("key", at.alias("item_at"), "seed").distinct(), used


def contamination(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, item_id, doc_start, n_aligned, n_equal, best_window double): the overlaps of docs (doc_id, text) with benchmark (item_id, text).

    A row for each document, item and offset at which some `window` tokens in a row (all of the item's, if it has fewer) agree in a share
    of `similar` at least. doc_start is the document's token at which the item's first would lie (below 0 if its start is cut off),
    n_aligned and n_equal count the item's tokens inside the document and those equal, best_window is the best window's share. masks are for
    items of window tokens or more, SHORT_MASKS for the others; both find two substituted tokens among 13 and a fifth among fewer. Null and empty texts
    and items overlap nothing; rows without an id count like others; repeated documents give repeated rows, repeated items one row
    each; other columns are ignored; either table may be empty.

    The seeds of the benchmark are broadcast after a check of their size; then the tokens of a document are at hand where a seed is hit. Larger ones
    meet the documents' seeds in a shuffled join, to which a document gives hashes and places alone; its tokens follow for what is hit.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("item")).where(F.size("item") > 0)
    items = cut(items.withColumn("key", F.xxhash64("item")).distinct(), "bench-items")
    bench, used = _item_seeds(items.select("key", "item"), masks, window)
    bench = cut(bench, "bench-seeds")
    toks = tokens(F.col("text")).alias("toks")
    if is_small(bench):
        rows = _all_seeds(docs.select("doc_id", toks), used or ("1",))
        hits = rows.join(F.broadcast(bench), "seed").withColumn("start", _place(used, F.size("toks"))[0] - F.col("item_at"))
    else:
        texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), "text").alias("text_b"))
        rows = _all_seeds(texts.select("text_a", "text_b", toks), used).select("text_a", "text_b", F.size("toks").alias("size"), "pos", "seed")
        met = rows.join(bench, "seed").select("text_a", "text_b", "key", (_place(used, F.col("size"))[0] - F.col("item_at")).alias("start"))
        met = cut(met.distinct(), "bench-hits")
        named = cut(met.select("text_a", "text_b").distinct(), "bench-texts")
        hit = texts.join(hint_small(named), ["text_a", "text_b"], "left_semi").select("doc_id", "text_a", "text_b", toks)
        hits = hit.join(hint_small(met), ["text_a", "text_b"])
    hits = hits.join(hint_small(items), "key")
    start = F.col("start")
    # let() binds a value once: expressions inside the functions of an array would be computed again at each of its places
    # the tokens of the document beside the item's, null where the document has none
    beside = lambda st: F.transform("item", lambda x, j: F.coalesce((F.try_element_at("toks", F.when(st + j >= 0, st + j + 1)) == x).cast("int"), F.lit(0)))
    ones = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)
    width = F.least(F.size("item"), F.lit(window))
    best = lambda eq: F.array_max(F.transform(F.sequence(F.lit(1), F.size("item") - width + 1), lambda i: ones(F.slice(eq, i, width)))) / width
    found = let(let(start, beside), lambda eq: F.struct(best(eq).alias("best_window"), ones(eq).alias("n_equal")))
    hits = hits.select("doc_id", "item_id", start.alias("doc_start"), F.size("toks").alias("size"), F.size("item").alias("n"), found.alias("found")).where(F.col("found.best_window") >= similar)
    aligned = F.least(F.col("doc_start") + F.col("n"), F.col("size")) - F.greatest("doc_start", F.lit(0))
    return hits.select("doc_id", "item_id", "doc_start", aligned.alias("n_aligned"), "found.n_equal", "found.best_window").distinct()


def let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_items, items array of item_id, most_equal): a row for each document that overlaps an item; see contamination().

    Rows of one doc_id count as one document. Documents without an id cannot be named and are left out.
    """
    found = contamination(docs, benchmark).where("doc_id is not null")
    by_item = found.groupBy("doc_id", "item_id").agg(F.max("n_equal").alias("n_equal"))
    return by_item.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("items"), F.max("n_equal").alias("most_equal"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id overlaps no benchmark item, with their columns; rows without an id are judged by their text."""
    key = "__decontaminate_key"
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2(F.col("text"), 256)), F.lit("")))
    hit = cut(contamination(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return keyed.join(hint_small(hit), key, "left_anti").drop(key)
