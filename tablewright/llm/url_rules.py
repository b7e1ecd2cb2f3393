"""URL filters by association rules, in DataFrame functions and Spark's FP-growth only.

A URL's tokens are its scheme, all host labels, all suffixes of the host with two labels or more, all path words, the file type and
all query keys. URLs of labelled documents become transactions; FP-growth mines the combinations that come with a bad
label. Rules below the support or confidence asked for are dropped, and so are rules of which a part is as sure. Every rule
is posted in an inverted index under one of its tokens, the rarest; a URL looks up all its tokens and tests the few rules
posted there.

No token of a transaction is cut. Two things that change no rule keep the mining small:

* Tokens with fewer bad rows than the support are in no rule, and tokens of the very same rows (by two 64-bit hashes) are one item: a set with two
  of them has a part as sure. A rule then has a group of tokens for each item, and any one of a group will do in a URL.
* Where no transaction has more than ``most_items`` items, Spark's FP-growth mines them: it lists every subset, at most 2^(most_items + 1)
  for a transaction. Else ``grow`` takes all of them by the same conditional bases, a table of these for each size of sets. It leaves
  a set, and all that hold it, as soon as one of its items keeps none of the good rows out: the set without that item is as sure, whatever else
  is in it. Nested host suffixes and other tokens that come together therefore don't multiply. Sets that pass this are all made; tokens that are
  independent and frequent can still have very many of them, which fill the shared folder and not the memory.

The index travels to the executors as one value of an uncorrelated scalar subquery up to INDEX_TOKENS tokens, counted first; beyond that
the distinct token sets of the URLs are joined with the posted rules.

Host rules of the caller come first; the longest that fits a URL decides, and the mined rules only where none does.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed; without labels, or
with fewer than ``least_labels``, no rule is mined; where the bad are as many as the confidence asks for, a token of every labelled URL is a rule like any other;
an empty table gives no rows; repeated rows stay; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import BROADCAST_ROWS, durable, few, lookup, of

#: (verdict, rule): a host, then from the first / on a path's beginning.
HOST_RULES = (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
)
BUCKETS = 1024
#: The bad label among the items, which are numbered from 0.
BAD = -1
#: Tokens in the index (some tens of bytes each) that still travel as one value.
INDEX_TOKENS = 100_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A to Z in lower case) and path; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """The longest rule that fits (else null) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer ones are asked first
        name, slash, begin = text.partition("/")
        fits = ((host == F.lit(name)) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + begin))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """All distinct tokens of a URL: never numbers, which name single pages."""
    scheme = F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))
    names = F.filter(F.split(host, r"\."), lambda x: x != "")
    labels = F.transform(names, lambda x: F.concat(F.lit("host:"), x))
    places = F.when(F.size(names) >= 2, F.sequence(F.lit(1), F.size(names) - 1)).otherwise(F.array().cast("array<int>"))
    suffixes = F.transform(places, lambda i: F.concat(F.lit("site:"), F.array_join(F.slice(names, i, F.size(names) - i + 1), ".")))
    words = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike(r"^[0-9._-]+$") & ~x.rlike(r"^[0-9]+\.\w+$"))
    steps = F.transform(words, lambda x: F.concat(F.lit("path:"), F.lower(x)))
    kind = F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1)
    query = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda x: x != "")
    keys = F.transform(query, lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, r"^([^=]*)", 1)))
    file = F.when(kind != "", F.array(F.concat(F.lit("file:"), F.lower(kind)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(scheme), labels, suffixes, steps, keys, file))


def items_of(known: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The items, common ones first (item, names, n, bad), and items and bad of the rows of ``known`` (tokens, bad) that hold any.

    Tokens with ``least`` bad rows count; those of the same rows are one item.
    """
    numbered = known.withColumn("row", F.monotonically_increasing_id())
    each = numbered.select("row", F.explode(F.array_distinct("tokens")).alias("token"), "bad")
    rows = [F.bit_xor(F.xxhash64("row")).alias("h"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("h2")]
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), *rows).filter(F.col("bad") >= least)
    alike = counted.groupBy("n", "bad", "h", "h2").agg(F.array_sort(F.collect_list("token")).alias("names"))
    ranked = durable(alike.orderBy(F.desc("n"), F.col("names")[0]).select("names", "n", "bad").withColumn("item", F.monotonically_increasing_id()))
    held = each.join(few(ranked.select(F.col("names")[0].alias("token"), "item")), "token")
    return ranked, durable(held.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"), F.first("bad").alias("bad")).select("items", "bad"))


def listed(made: DataFrame, least: float, confidence: float) -> DataFrame:
    """items and confidence of the rules of which no part is as sure, by Spark's FP-growth."""
    marked = made.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD).cast("long")))).otherwise(F.col("items")).alias("items"))
    support = (math.ceil(least) - 0.5) / made.count()  # half a row less, so that no rounding asks for one more
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(marked)
    rules = model.associationRules.filter(F.col("consequent")[0] == BAD)
    rules = durable(rules.select(F.array_sort("antecedent").alias("items"), "confidence"))
    # A rule is needless where some of its items alone are as sure: all proper parts of each rule are looked up.
    part = lambda m: F.filter("items", lambda x, i: F.getbit(m, i) == 1)
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("items")) - 2)
    larger = rules.filter(F.size("items") > 1).select("items", "confidence", F.explode(F.transform(masks, part)).alias("few"))
    smaller = rules.select(F.col("items").alias("few"), F.col("confidence").alias("sure"))
    needless = larger.join(smaller, "few").filter(F.col("sure") >= F.col("confidence")).select("items").distinct()
    return rules.join(needless, "items", "left_anti")


def grow(made: DataFrame, least: float, confidence: float) -> DataFrame:
    """The same as ``listed`` for transactions of any length, by conditional bases with bad and good rows.

    A set grows by items more common than its own. Its base holds what its rows have of these, equal rows merged as in an FP-tree. A set stays while
    every part with one item less has more good rows; ``below`` is the surest of all its parts, handed up from size to size.
    """
    none = F.array().cast("array<bigint>")
    counts = [F.sum("bad").alias("bad"), F.sum("good").alias("good")]
    rows = made.select("items", F.col("bad").cast("long").alias("bad"), (~F.col("bad")).cast("long").alias("good"))
    bases = durable(rows.groupBy(F.col("items").alias("prefix")).agg(*counts).withColumn("pattern", none))
    sizes = []
    while not bases.isEmpty():
        grown = bases.select("pattern", F.explode("prefix").alias("item"), "bad", "good").groupBy("pattern", "item").agg(*counts).filter(F.col("bad") >= least)
        sets = grown.select(F.concat(F.array("item"), "pattern").alias("items"), "bad", "good").withColumn("sure", F.col("bad") / (F.col("bad") + F.col("good")))
        if sizes:
            parts = sets.withColumn("part", F.explode(F.transform("items", lambda x: F.filter("items", lambda y: y != x))))
            smaller = few(sizes[-1].select(F.col("items").alias("part"), F.col("good").alias("part_good"), F.greatest("sure", "below").alias("part_sure")))
            kept = parts.join(smaller, "part").filter(F.col("part_good") > F.col("good")).groupBy("items", "bad", "good", "sure")
            sets = kept.agg(F.max("part_sure").alias("below"), F.count(F.lit(1)).alias("parts")).filter(F.col("parts") == F.size("items")).drop("parts")
        else:
            sets = sets.withColumn("below", F.lit(0.0))
        sets = durable(sets)
        first = F.col("items")[0]
        more = sets.groupBy(F.expr("slice(items, 2, size(items) - 1)").alias("pattern")).agg(F.collect_list(first).alias("all"), F.collect_list(F.when(F.col("good") > 0, first)).alias("open"))
        held = lookup(bases, more, "pattern", small=not sizes or sets.count() <= BROADCAST_ROWS)
        held = held.withColumn("prefix", F.array_sort(F.array_intersect("prefix", "all")))
        held = held.select("pattern", "prefix", "bad", "good", "open", F.posexplode("prefix").alias("place", "item")).filter((F.col("place") > 0) & F.array_contains("open", F.col("item")))
        sizes.append(sets)
        bases = durable(held.select(F.concat(F.array("item"), "pattern").alias("pattern"), F.slice("prefix", F.lit(1), F.col("place")).alias("prefix"), "bad", "good").groupBy("pattern", "prefix").agg(*counts))
    if not sizes:
        return made.sparkSession.createDataFrame([], "items array<bigint>, confidence double")
    sure = reduce(DataFrame.unionByName, sizes).filter((F.col("sure") >= confidence) & (F.col("sure") > F.col("below")))
    return sure.select("items", F.col("sure").alias("confidence"))


def mine(pages: DataFrame, labels: DataFrame, *, support: float, least_rows: int, confidence: float, least_labels: int, most_items: int) -> DataFrame:
    """items (a token of each group), groups, confidence of the rules kept. ``labels`` has key and bad; a page's key is in ``pages``."""
    known = durable(pages.filter(F.col("key").isNotNull()).join(labels, "key").select("tokens", "bad"))
    empty = pages.sparkSession.createDataFrame([], "items array<string>, groups array<array<string>>, confidence double")
    rows = known.count()
    if rows < least_labels:
        return empty
    least = max(support * rows, least_rows, 1)
    ranked, made = items_of(known, least)
    longest = made.agg(F.max(F.size("items"))).first()[0]
    if longest is None:
        return empty
    # Items of every row say no more in a larger set: they are rules of one item or none.
    every = ranked.filter(F.col("n") == rows)
    alone = every.select(F.array("item").alias("items"), (F.col("bad") / F.col("n")).alias("confidence")).filter(F.col("confidence") >= confidence)
    if not every.isEmpty():
        made = made.withColumn("items", F.array_except("items", F.lit([x["item"] for x in every.select("item").collect()]).cast("array<bigint>"))).filter(F.size("items") > 0)
        longest -= 1
    if longest:
        mined = listed(made, least, confidence) if longest <= most_items else grow(made, least, confidence)
        alone = alone.unionByName(mined)
    named = alone.select("items", "confidence", F.posexplode("items").alias("place", "item")).join(few(ranked.select("item", "names")), "item")
    groups = named.groupBy("items", "confidence").agg(F.array_sort(F.collect_list(F.struct("place", "names"))).alias("at"))
    groups = groups.select(F.transform("at", lambda x: x["names"]).alias("groups"), "confidence")
    return durable(groups.select(F.array_sort(F.transform("groups", lambda g: g[0])).alias("items"), "groups", "confidence"))


def posted(rules: DataFrame) -> DataFrame:
    """token, groups, confidence: each rule under every token of its rarest group."""
    return rules.select(F.explode(F.element_at("groups", -1)).alias("token"), "groups", "confidence")


def inverted_index(rules: DataFrame) -> DataFrame:
    """One row, one column: an array of BUCKETS arrays of (token, groups, confidence)."""
    entry = posted(rules).select(F.pmod(F.hash("token"), F.lit(BUCKETS)).alias("b"), F.struct("token", "groups", "confidence").alias("rule"))
    buckets = entry.groupBy("b").agg(F.collect_list("rule").alias("rules"))
    every = F.map_from_entries(F.collect_list(F.struct("b", "rules")))
    return buckets.agg(every.alias("m")).select(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.try_element_at(F.col("m"), b)).alias("index"))


def as_found(confidence: Column, groups: Column) -> Column:
    """A rule that fits as (confidence, items): of each group the last of the page's tokens, so that ties have one order."""
    items = F.array_sort(F.transform(groups, lambda g: F.array_max(F.array_intersect(g, F.col("tokens")))))
    return F.struct(confidence.alias("confidence"), items.alias("items"))


def judge(pages: DataFrame, rules: DataFrame, index_tokens: int = INDEX_TOKENS) -> DataFrame:
    """Adds best, the surest mined rule that fits a page's tokens: confidence and items, else null."""
    fits = lambda groups: F.forall(groups, lambda g: F.arrays_overlap(g, F.col("tokens")))
    size = posted(rules).agg(F.sum(F.size(F.flatten("groups")) + 1)).first()[0] or 0
    if size > index_tokens:
        sets = durable(pages.select("tokens").distinct())
        found = sets.select("tokens", F.explode("tokens").alias("token")).join(posted(rules).hint("merge"), "token").filter(fits(F.col("groups")))
        best = durable(found.groupBy("tokens").agg(F.max(as_found(F.col("confidence"), F.col("groups"))).alias("best")))
        return lookup(pages, best, "tokens", "left")
    found = F.flatten(
        F.transform(
            "tokens",
            lambda t: F.coalesce(
                F.filter(F.col("index")[F.pmod(F.hash(t), F.lit(BUCKETS))], lambda r: (r["token"] == t) & fits(r["groups"])),
                F.array().cast("array<struct<token:string,groups:array<array<string>>,confidence:double>>"),
            ),
        )
    )
    best = F.array_max(F.transform(found, lambda r: as_found(r["confidence"], r["groups"])))
    return pages.withColumn("index", inverted_index(rules).scalar()).withColumn("best", best).drop("index")


def judge_urls(
    pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", key_pattern: str = r"://[^/?#]*/[^/?#]*/(\d+)",
    rules=HOST_RULES, support: float = 0.0005, least_rows: int = 12, confidence: float = 0.5, least_labels: int = 100, most_items: int = 10,
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule that fits with its confidence.

    ``labels`` names documents by ``label_id``; ``key_pattern`` finds that number in a URL. A label is bad where quality is 0
    or toxic is 1; of several labels for one document, any bad one counts.
    """
    host, path = parts(F.col("url"))
    plain = pages.select(of(pages, id_col).alias("page_id"), of(pages, url_col).cast("string").alias("url")).withColumns({"host": host, "path": path})
    named = plain.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    bad = F.coalesce((of(labels, "quality") == 0) | (of(labels, "toxic") == 1), F.lit(False))
    marks = labels.filter(of(labels, label_id).isNotNull()).groupBy(of(labels, label_id).cast("string").alias("key")).agg(F.max(bad).alias("bad"))
    keyed = named.select("tokens", F.regexp_extract("url", key_pattern, 1).alias("key")).filter(F.col("key") != "")
    found = mine(keyed, marks, support=support, least_rows=least_rows, confidence=confidence, least_labels=least_labels, most_items=most_items)
    rule, verdict = host_rule(F.col("host"), F.col("path"), rules)
    mined = F.when(F.col("best").isNotNull() & (F.col("host") != ""), F.lit("block")).otherwise(F.lit("allow"))
    return judge(named, found).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"),
        F.array_join("best.items", " ").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"),
    )
