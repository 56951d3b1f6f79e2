"""Line deduplication with a log-template tree, in DataFrame operations alone.

The tree has a fixed depth: a line's token count, then its leading tokens, with tokens that hold digits as wildcards; what agrees on
these meets in a leaf. A leaf can hold several templates. Each is opened by a line, its leader; lines of the leaf that agree with the leader
in enough places belong to it, whatever stands in the other places, the variable fields. A template that recurs in enough different texts is
dropped from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop, free_name, hint_small, is_small

#: Leading tokens that are levels of the tree.
DEPTH = 3
#: Share of places in which a line agrees with its template's leader.
SIMILAR = 0.7
#: Lines of a leaf that are all compared, at most; larger groups are compared in blocks of about as many.
SMALL = 64
#: Lines of a leaf that are not parted into groups by a part of their places, at most.
KEYED = 512
#: Comparisons with lines of groups, above which the groups are first compared in blocks.
BLOCKED = 20_000_000
#: Tasks that the lines of a large group are dealt to.
SALTS = 16
#: Different texts in which a dropped template occurs.
LEAST_TEXTS = 3
#: Tokens of a line in the tree; shorter ones also recur by chance, against which they are judged.
LEAST_TOKENS = 4
#: Different texts in which a dropped short line occurs; fewer do not tell it from chance.
SHORT_TEXTS = 10
#: So many times its number by chance, and for each word after the first so many times more: words of one language and topic go together.
LIFT, TOGETHER = 5, 50
#: What parts words where their frequency counts.
BETWEEN = r"[ \n.,;:!?\"'()\[\]]"
WILDCARD = "<*>"


def _masked(docs: DataFrame) -> DataFrame:
    """(text, text_a, text_b): the texts with single blanks and masked variables, and the two hashes of what they were."""
    text = docs.select("text", F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), "text").alias("text_b"))
    # cheap searches of the whole text tell the many that need no rewriting
    odd = F.lit(False)
    for blank in ("  ", "\t", "\r", "\x0b", "\f"):
        odd = odd | F.contains("text", F.lit(blank))
    text = text.withColumn("text", F.when(odd, F.regexp_replace("text", r"[ \t\r\x0b\f]+", " ")).otherwise(F.col("text")))
    return text.withColumn("text", F.when(F.col("text").rlike("[0-9]"), F.regexp_replace("text", r"(?<!\S)[^\s0-9]*+[0-9]\S*", WILDCARD)).otherwise(F.col("text")))


def _lines(docs: DataFrame) -> DataFrame:
    """(text_a, text_b, line_no, line): all lines of the masked texts."""
    lines = _masked(docs).select("text_a", "text_b", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.trim("line"))


def _number_of_tokens(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _short_recurring(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(line_hash): the lines with a letter and fewer tokens than lines in the tree have that occur in more texts than words put together by chance would.

    By chance a line occurs as often as there are lines of its length, times the shares of its words among all words of docs.
    """
    once = found.where(F.col("short").isNotNull()).groupBy("line_hash", "text_a", "text_b").agg(F.first("n").alias("n"), F.first("short").alias("short"))
    uses = cut(once.groupBy("line_hash").agg(F.first("n").alias("n"), F.first("short").alias("line"), F.count("*").alias("texts")), "line-short")
    of_length = uses.groupBy("n").agg(F.sum("texts").alias("lines"))
    words = lambda text: F.explode(F.split(F.lower(text), BETWEEN)).alias("word")
    often = uses.where((F.col("texts") >= SHORT_TEXTS) & F.col("line").rlike(r"\p{L}")).select("line_hash", "n", "texts", words("line"))
    often = cut(often.where("word <> ''"), "line-often")
    wanted = cut(often.select("word").distinct(), "line-wanted")
    # counted before they meet the wanted ones: words of the text are not joined one by one
    each = _masked(docs).select(words("text")).groupBy("word").agg(F.count("*").alias("uses"))
    shares = cut(each.join(hint_small(wanted), "word"), "line-shares")
    by_chance = often.join(shares, "word").crossJoin(found.agg(F.sum("n").alias("all"))).groupBy("line_hash", "n", "texts").agg(F.sum(F.log(F.col("uses") / F.col("all"))).alias("chance"))
    least = LIFT * F.pow(F.lit(float(TOGETHER)), F.col("n") - 1) * F.col("lines") * F.exp("chance")
    out = cut(by_chance.join(of_length, "n").where(F.col("texts") >= least).select("line_hash"), "line-short-recurring")
    drop(uses, often, wanted, shares)
    return out


def _texts(df: DataFrame, by: str, copies: DataFrame | None) -> DataFrame:
    """(by, texts): the different texts of df (by, text_a, text_b) each, or with copies (text_a, text_b, rows) the rows that have them."""
    df = df.select(by, "text_a", "text_b").distinct()
    if copies is None:
        return df.groupBy(by).agg(F.count("*").alias("texts"))
    return df.join(hint_small(copies), ["text_a", "text_b"], "left").groupBy(by).agg(F.sum(F.coalesce("rows", F.lit(1))).alias("texts"))


def _may_differ(tokens: Column) -> Column:
    """Places in which lines that belong together differ at most."""
    return F.size(tokens) - F.ceil(F.lit(SIMILAR) * F.size(tokens)).cast("int")


def _keys(lines: DataFrame) -> DataFrame:
    """(key, leaf, line_hash): lines (leaf, line_hash, tokens) in groups of lines that agree on a part of their places.

    Lines that belong together differ in a bounded number of places. The places after the leaf's are parted into one part more than that, so they
    agree on one part at least, and there meet in a group.
    """
    size, differ = F.size("tokens") - DEPTH, _may_differ(F.col("tokens"))
    start = lambda k: DEPTH + F.floor(k * size / (differ + 1)).cast("int")
    parts = F.when(size > differ, F.sequence(F.lit(0), differ)).otherwise(F.array(F.lit(-1)))
    laid = lines.select("leaf", "line_hash", "tokens", F.explode(parts).alias("part"))
    first, after = start(F.col("part")), start(F.col("part") + 1)
    key = F.when(F.col("part") < 0, F.xxhash64("leaf")).otherwise(F.xxhash64("leaf", "part", F.slice("tokens", first + 1, after - first)))
    return laid.select(key.alias("key"), "leaf", "line_hash")


def _agree(a: Column, b: Column) -> Column:
    """Whether two lines of a leaf agree in so many places that one belongs to the other's template."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) >= F.ceil(F.lit(SIMILAR) * F.size(a))


def _salt(line_hash: Column) -> Column:
    return F.pmod(F.xxhash64(line_hash), F.lit(SALTS)).cast("int").alias("salt")


def _to_all_salts(df: DataFrame) -> DataFrame:
    """A copy of each row of df for each salt, so that the lines of a large group meet it in several tasks."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def _near(lead: Column) -> Column:
    """Of the lines in own, those that agree with lead: (line_hash, held) each."""
    return F.transform(F.filter("own", lambda x: _agree(x["tokens"], lead)), lambda x: F.struct(x["line_hash"], x["held"]))


def _rows(held: Column) -> Column:
    """The rows of the different texts in held, an array of arrays."""
    return F.aggregate(F.array_distinct(F.flatten(held)), F.lit(0).cast("long"), lambda s, x: s + x["rows"])


def _block(lines: Column, line_hash: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), line_hash), F.ceil(lines / SMALL)).cast("int").alias("block")


def _in_blocks(groups: DataFrame) -> DataFrame:
    """(line_hash, leads, goes): whether a line of groups (group, lines, line_hash, tokens, held) leads a recurring template as far as its
    block of about SMALL lines of its group shows, and whether it goes with a line of its block that does. A row for each line, none for a pair.
    """
    own = groups.groupBy("group", _block(F.col("lines"), F.col("line_hash"))).agg(F.collect_list(F.struct("line_hash", "tokens", "held")).alias("own"))
    met = own.select(F.transform("own", lambda lead: F.struct(lead["line_hash"].alias("line_hash"), _near(lead["tokens"]).alias("near"))).alias("met"))
    met = met.select(F.transform("met", lambda x: F.struct(x["line_hash"].alias("line_hash"), (_rows(x["near"]["held"]) >= LEAST_TEXTS).alias("leads"), x["near"]["line_hash"].alias("near"))).alias("met"))
    gone = F.array_distinct(F.flatten(F.transform(F.filter("met", lambda x: x["leads"]), lambda x: x["near"])))
    lines = F.transform("met", lambda x: F.struct(x["line_hash"].alias("line_hash"), x["leads"].alias("leads")))
    each = met.select(gone.alias("gone"), lines.alias("met")).select("gone", F.explode("met").alias("line"))
    return cut(each.select("line.line_hash", "line.leads", F.array_contains("gone", F.col("line.line_hash")).alias("goes")), "line-blocks")


def _groups(words: DataFrame) -> DataFrame:
    """(group, line_hash, lines): the lines of large leaves in groups in which all lines that belong together meet, with the groups' numbers of lines.

    The groups are those of _keys(), or the leaf where that compares fewer lines.
    """
    leaves, most = words.select(F.col("leaf").alias("group"), "line_hash", "lines"), words.where(F.col("lines") > KEYED)
    if most.isEmpty():
        return leaves
    laid = _keys(most).withColumn("salt", _salt(F.col("line_hash")))
    several = cut(laid.groupBy("key", "leaf").agg(F.count("*").alias("met")).where("met > 1"), "line-keys")
    by_key = several.groupBy("leaf").agg(F.sum(F.col("met") * F.col("met")).alias("by_key"))
    at_once = cut(most.select("leaf", "lines").distinct().join(by_key, "leaf").where("lines * lines <= by_key").select(F.col("leaf").alias("group")), "line-at-once")
    several = _to_all_salts(several.join(hint_small(at_once).withColumnRenamed("group", "leaf"), "leaf", "left_anti").select("key", "met"))
    of_key = laid.join(several, ["key", "salt"]).select(F.col("key").alias("group"), "line_hash", F.col("met").alias("lines"))
    of_leaf = leaves.where(F.col("lines") <= KEYED).unionByName(leaves.join(hint_small(at_once), "group", "left_semi"))
    return cut(of_key.unionByName(of_leaf), "line-groups")


def _met(groups: DataFrame, words: DataFrame, asks: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(line_hash, near): the lines asks (line_hash), each with the lines, of others (line_hash) or all, that agree with it, block by block of its groups."""
    some = groups.join(hint_small(asks), "line_hash").withColumn("salt", _salt(F.col("line_hash")))
    wanted = cut(some.select("group").distinct(), "line-wanted-groups")
    dealt = groups.withColumn("salt", _salt(F.col("line_hash")))
    dealt = dealt.join(F.broadcast(wanted), "group", "left_semi") if is_small(wanted) else dealt.join(_to_all_salts(wanted), ["group", "salt"])
    known = words.select("line_hash", "tokens", "held")
    if others is not None:
        known = known.join(hint_small(others), "line_hash", "left_semi")
    own = dealt.join(known, "line_hash").groupBy("group", _block(F.col("lines"), F.col("line_hash"))).agg(F.collect_list(F.struct("line_hash", "tokens", "held")).alias("own"))
    each = F.explode(F.sequence(F.lit(0), F.ceil(F.col("lines") / SMALL).cast("int") - 1)).alias("block")
    left = words.select("line_hash", "tokens").join(some, "line_hash").select("group", each, "line_hash", "tokens")
    return left.join(own, ["group", "block"]).select("line_hash", _near(F.col("tokens")).alias("near"))


def _family_lines(words: DataFrame) -> DataFrame:
    """(line_hash): the lines of words (leaf, lines, line_hash, tokens, held) that recur together with others of their leaf.

    A line leads if the lines that agree with it, itself included, are in LEAST_TEXTS texts; these lines go. Leaves are compared in blocks of about SMALL
    lines: small ones as a whole; of larger ones, dense families are settled by any block. Lines of large leaves that do not lead in their block
    are compared with all lines they could belong together with, and those that still don't lead with all that do.
    """
    blocks = _in_blocks(words.withColumnRenamed("leaf", "group"))
    gone = blocks.where("goes").select("line_hash")
    words = words.where(F.col("lines") > SMALL)
    asks = cut(words.select("line_hash").join(blocks.where("leads").select("line_hash"), "line_hash", "left_anti"), "line-asks")
    if asks.isEmpty():
        return cut(gone.distinct(), "line-family")
    groups, ids = _groups(words), words.select("line_hash")
    if (groups.join(hint_small(asks), "line_hash").agg(F.sum("lines")).first()[0] or 0) > BLOCKED:
        # families that are a small part of their leaf are dense in their groups
        again = _in_blocks(groups.join(words.drop("leaf", "lines"), "line_hash"))
        gone = gone.unionByName(again.where("goes").select("line_hash"))
        asks = cut(asks.join(again.where("leads").select("line_hash"), "line_hash", "left_anti"), "line-asks")
    texts = _met(groups, words, asks).select("line_hash", F.explode(F.slice(F.array_distinct(F.flatten("near.held")), 1, LEAST_TEXTS)).alias("text"))
    leads = texts.distinct().groupBy("line_hash").agg(F.sum("text.rows").alias("rows")).where(F.col("rows") >= LEAST_TEXTS).select("line_hash")
    late = cut(leads, "line-late")
    rest = cut(asks.join(hint_small(late), "line_hash", "left_anti").join(gone.distinct(), "line_hash", "left_anti"), "line-rest")
    gone = gone.unionByName(late)
    if not rest.isEmpty():
        good = cut(ids.join(hint_small(asks), "line_hash", "left_anti").unionByName(late), "line-leaders")
        gone = gone.unionByName(_met(groups, words, rest, good).where(F.size("near") > 0).select("line_hash"))
    out = cut(gone.distinct(), "line-family")
    drop(blocks, asks, groups, late, rest)
    return out


def recurring_lines(docs: DataFrame, least_tokens: int = LEAST_TOKENS, count_copies: bool = False) -> tuple[DataFrame, DataFrame]:
    """(line_hash long): the masked lines whose template occurs in LEAST_TEXTS different texts, and short ones above chance; and where each line occurs, as hashes."""
    lines = _lines(docs).withColumn("n", _number_of_tokens(F.col("line")))
    found = lines.select("text_a", "text_b", "line_no", "n", F.xxhash64("n", F.substring_index("line", " ", DEPTH)).alias("leaf"), F.xxhash64("line").alias("line_hash"), F.when(F.col("n") < least_tokens, F.col("line")).alias("short"))
    found = cut(found.where("n > 0"), "line-found")
    copies = None
    if count_copies:
        copies = cut(docs.groupBy(F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), "text").alias("text_b")).agg(F.count("*").alias("rows")).where("rows > 1"), "line-copies")
    in_tree = found.where(F.col("n") >= least_tokens)
    # a leaf's rows are first brought to one a line: a common line makes no hot leaf
    uses = _texts(in_tree.select(F.struct("leaf", "line_hash").alias("at"), "text_a", "text_b"), "at", copies)
    uses = cut(uses.select("at.leaf", "at.line_hash", "texts"), "line-uses")
    leaves = uses.groupBy("leaf").agg(F.count("*").alias("lines"), F.min("texts").alias("least"), F.sum("texts").alias("all")).where((F.col("lines") > 1) & (F.col("least") < LEAST_TEXTS) & (F.col("all") >= LEAST_TEXTS))
    several = cut(uses.join(leaves.select("leaf", "lines"), "leaf"), "line-several")
    # of these leaves' lines, one copy each is read again, with its tokens and the texts that hold it: below LEAST_TEXTS, the first and the last are all
    words = _lines(docs).select(F.xxhash64("line").alias("line_hash"), "line", F.struct("text_a", "text_b").alias("text")).join(hint_small(several), "line_hash")
    words = words.groupBy("leaf", "line_hash", "lines", "texts").agg(F.first("line").alias("line"), F.min("text").alias("lo"), F.max("text").alias("hi"))
    text = lambda a, b, rows: F.struct(a.alias("text_a"), b.alias("text_b"), rows.cast("long").alias("rows"))
    lo, hi = (text(F.col(x)["text_a"], F.col(x)["text_b"], F.when(F.col("lo") == F.col("hi"), F.col("texts")).otherwise(1)) for x in ("lo", "hi"))
    # a line in enough texts itself: which ones does not matter
    held = F.when(F.col("texts") >= LEAST_TEXTS, F.array(text(F.col("line_hash"), F.lit(0).cast("long"), F.col("texts")))).otherwise(F.array_distinct(F.array(lo, hi)))
    words = cut(words.select("leaf", "lines", "line_hash", F.transform(F.split("line", " "), lambda t: F.xxhash64(t)).alias("tokens"), held.alias("held")), "line-words")
    whole = uses.where(F.col("texts") >= LEAST_TEXTS).select("line_hash")
    short = _short_recurring(docs, found)
    family = _family_lines(words)
    out = cut(whole.unionByName(short).unionByName(family).distinct(), "line-recurring")
    drop(uses, several, words, short, family)
    return out, found


def dedup_lines(docs: DataFrame, least_tokens: int = LEAST_TOKENS, count_copies: bool = False) -> DataFrame:
    """Every row and column of docs (text, ...), text without its recurring lines, and two columns more: n_lines and n_dropped int.

    Exact copies of a text count once towards recurrence, so that a text does not lose all its lines to its own copies, of which near-duplicate
    removal keeps one; with count_copies each row counts. The lines kept stay as they were, in their order, joined by newlines; a
    document that loses all its lines keeps an empty text. Null texts stay null with no lines, empty ones have one line. Lines of
    least_tokens tokens or more (1: all lines) are judged by their template. Of shorter ones, those without a letter stay, and so do those in
    fewer than SHORT_TEXTS texts or about as many as chance explains. Repeated rows are treated alike; columns of docs called n_lines or
    n_dropped are replaced. An empty table gives an empty table.
    """
    recurring, found = recurring_lines(docs, least_tokens, count_copies)
    hit = found.join(hint_small(recurring), "line_hash")
    name_a, name_b, gone = (free_name(docs, x) for x in ("__a", "__b", "__gone"))
    per = hit.groupBy(F.col("text_a").alias(name_a), F.col("text_b").alias(name_b)).agg(F.collect_set("line_no").alias(gone))
    per = cut(per, "line-gone")
    drop(found, recurring)
    named = docs.withColumns({name_a: F.xxhash64("text"), name_b: F.xxhash64(F.lit(1), "text")})
    joined = named.join(hint_small(per), [name_a, name_b], "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(gone, i))
    return joined.select(
        *(c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")),
        F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept)).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).alias("n_dropped"),
    ).select(*(c for c in docs.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")
