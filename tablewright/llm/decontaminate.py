"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

Texts and benchmark items are lower-cased and cut into words at blanks; their shingles are five words (all words of an item
that has fewer). A window is as many words of a document as some item has, cut off at the text's ends. Windows are chosen by
size alone, not by item: one may match an item of its size only if it holds the threshold's share of that many
shingles from items of that size, and of such windows those are laid whose start is not before the first nor behind the last of the
starts that would give one of these shingles a place it has in an item; a window before or behind these and
within the text is never better than the nearest of them. So a phrase that many items share costs one row per place and
size, not one per item.

Each window and item gets a 64-bit SimHash of its shingles, a shingle weighing as often as it stands there. The
candidates come from a multi-index over the fingerprints: they are cut into four blocks of 16 bits, and an item is
posted under every value of a block that is near its own, such that by the pigeonhole principle every fingerprint within
``radius`` meets it in one block at least (four blocks that differ by ``t + 1`` bits each differ by ``4 t + 4`` together, so radius 19
asks for ``t = 4``). A random window meets 15 % of the items of its size there and one in a thousand within the radius.
The pairs found within it are verified: the weighted Jaccard similarity of both multisets of shingles must reach the
threshold. Of pairs at the threshold itself fewer than 1 % lie beyond the radius, and are lost; of those at 0.85 or more next to none.

A benchmark's shingles are broadcast only while they are few (counted first, ``BROADCAST_ROWS``); beyond that the joins
are shuffled.

Defined results: null and empty texts match nothing; an empty table of documents or items gives no rows; rows without an id are
matched and reported under the null id; items without words are ignored; documents that share an id are judged one by one,
by their own texts, and reported together; ties between windows go to the first; extra columns, whatever their names, are
ignored by ``find_leaks`` and carried by ``drop_leaks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import digest_of, durable, lookup, of, without_rows
from tablewright.llm.texts import let

#: Shingles of the benchmark, or places of windows, that are still broadcast: 24 bytes each, so 12 MB.
BROADCAST_ROWS = 500_000
WIDTH = 5
#: Blocks of a fingerprint and their bits.
BLOCKS, BITS = 4, 16


def words_of(text: Column) -> Column:
    """Words in lower case, cut at \\x20 and \\x09-\\x0D."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, in order; none where there are fewer words."""
    one = lambda w, i: F.xxhash64(*(F.get(w, i + k) for k in range(width)))
    return let(words, lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: one(w, i))).otherwise(F.array().cast("array<bigint>")))


def fingerprint(hashes: Column) -> Column:
    """64-bit SimHash of an array of feature hashes; repeated features weigh as often as they occur."""
    sign = lambda h, b: F.getbit(h, b).cast("int") * 2 - 1
    score = lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + sign(h, b))
    bit = lambda b: F.when(score(b) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def blocks(fp: Column) -> Column:
    """The blocks of a fingerprint as structs of place and value."""
    value = lambda b: F.shiftrightunsigned(fp, BITS * b).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    return F.array(*(F.struct(F.lit(b).alias("block"), value(b).alias("value")) for b in range(BLOCKS)))


def similarity(left: Column, right: Column) -> Column:
    """Weighted Jaccard similarity of two arrays as multisets."""
    times = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    shared = F.aggregate(F.array_intersect(left, right), F.lit(0), lambda a, h: a + F.least(times(left, h), times(right, h)))
    return let(shared, lambda s: s.cast("double") / (F.size(left) + F.size(right) - s))


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, width, n (words), sh (shingle hashes) of every item with a word."""
    plain = benchmark.select(of(benchmark, id_col).alias("item"), words_of(of(benchmark, text_col)).alias("w")).filter(F.size("w") > 0)
    sized = plain.withColumn("n", F.size("w"))
    few = F.array(F.aggregate("w", F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))
    return sized.select("item", "n", F.least("n", F.lit(WIDTH)).alias("width"), F.when(F.col("n") >= WIDTH, shingles(F.col("w"), WIDTH)).otherwise(few).alias("sh"))


def doc_shingles(words: Column, width: int) -> Column:
    """As the items' shingles of this width."""
    if width == WIDTH:
        return shingles(words, WIDTH)
    fold = lambda w, i: F.aggregate(F.slice(w, i + 1, F.lit(width)), F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x))
    return let(words, lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: fold(w, i))).otherwise(F.array().cast("array<bigint>")))


def starts(hits: Column, m: Column, need: Column) -> Column:
    """Starts of the windows of ``m`` shingles that hold ``need`` of the ``hits`` or more, from the first to the last alignment inside.

    ``hits`` are sorted structs of pos, low and high (alignments). Every start belongs to the first hit in its window.
    """

    def of(hit: Column, i: Column) -> Column:
        far = F.get(hits, i + need - 1)["pos"]
        first = F.greatest(far - m + 1, F.coalesce(F.get(hits, i - 1)["pos"] + 1, far - m + 1))

        def aligned(s: Column) -> Column:
            inside = F.filter(F.slice(hits, i + 1, m), lambda x: x["pos"] < s + m)
            return let(inside, lambda own: (F.array_min(F.transform(own, lambda x: x["low"])) <= s) & (F.array_max(F.transform(own, lambda x: x["high"])) >= s))

        none = F.array().cast("array<int>")
        return F.when(far.isNotNull() & (first <= hit["pos"]), F.filter(F.sequence(first, F.greatest(first, hit["pos"])), aligned)).otherwise(none)

    return F.flatten(F.transform(hits, of))


def laid_windows(plain: DataFrame, items: DataFrame, widths: list[int], threshold: float, hint) -> DataFrame:
    """id, dig, and windows (structs of width, size and start) of every document that has one. ``plain`` has id, dig and text."""
    posted = items.select("n", "width", F.posexplode("sh").alias("at", "h")).groupBy("width", "n", "h").agg(F.min("at").alias("at_low"), F.max("at").alias("at_high"))
    posted = durable(posted)
    found = None
    for width in widths:
        places = plain.select("id", "dig", F.posexplode(doc_shingles(words_of(F.col("text")), width)).alias("pos", "h"))
        hits = places.join(hint(posted.filter(F.col("width") == width).drop("width")), "h")
        hits = hits.select("id", "dig", "n", F.struct("pos", (F.col("pos") - F.col("at_high")).alias("low"), (F.col("pos") - F.col("at_low")).alias("high")).alias("hit"))
        found = hits if found is None else found.unionByName(hits)
    size = items.select("n", "width", F.size("sh").alias("m")).distinct()
    need = F.ceil(F.col("m") * threshold - 1e-9).cast("int")
    likely = found.groupBy("id", "dig", "n").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    likely = likely.join(hint(size), "n").withColumn("need", need).filter(F.size("hits") >= F.col("need"))
    own = F.transform(F.array_distinct(starts(F.col("hits"), F.col("m"), F.col("need"))), lambda s: F.struct("width", F.col("n").alias("size"), s.alias("start")))
    laid = durable(likely.select("id", "dig", own.alias("windows")).filter(F.size("windows") > 0))
    return durable(laid.groupBy("id", "dig").agg(F.flatten(F.collect_list("windows")).alias("windows")))


def close_pairs(prints: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """key, item, distance: windows and items of the same size whose fingerprints are within the radius, through the index."""
    least, over = divmod(radius - BLOCKS + 1, BLOCKS)
    most = [least + (b < over) for b in range(BLOCKS)]  # the thresholds of the blocks add up to radius - BLOCKS + 1
    spark = prints.sparkSession
    bits = F.bit_count(F.col("id"))
    masks = spark.range(1 << BITS).filter(bits <= max(most)).agg(F.collect_list(F.struct(bits.alias("bits"), F.col("id").cast("int").alias("mask"))))
    marked = items.join(prints.select(F.col("size").alias("n")).distinct(), "n", "left_semi").withColumn("item_fp", fingerprint(F.col("sh")))
    posted = marked.select("item", F.col("n").alias("size"), "item_fp", F.explode(blocks(F.col("item_fp"))).alias("b")).withColumn("masks", masks.scalar())
    limit = F.array(*map(F.lit, most))[F.col("b.block")]
    posted = posted.select("item", "size", "item_fp", "b.block", F.col("b.value").alias("own"), F.explode(F.filter("masks", lambda m: m["bits"] <= limit)).alias("m"))
    posted = posted.select("item", "size", "item_fp", "block", F.col("own").bitwiseXOR(F.col("m.mask")).alias("value"))
    asked = prints.select("key", "size", "fp", F.explode(blocks(F.col("fp"))).alias("b")).select("key", "size", "fp", "b.block", "b.value")
    away = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    # The index is far larger than its estimate: a merge join, as a broadcast of it would have no bound.
    return asked.join(posted.hint("merge"), ["size", "block", "value"]).filter(away <= radius).select("key", "item", away.alias("distance")).distinct()


def leak_rows(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    threshold: float = 0.75, radius: int = 19,
) -> DataFrame:
    """id, dig (of the text), item and b (similarity, first and distance) of the best window for every text and item that match."""
    spark = docs.sparkSession
    items = durable(items_of(benchmark, item_col, item_text))
    plain = docs.select(of(docs, id_col).alias("id"), digest_of(of(docs, text_col)).alias("dig"), of(docs, text_col).cast("string").alias("text"))
    widths = [r.width for r in items.select("width").distinct().collect()]  # at most five
    if not widths:
        kinds = plain.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
        return spark.createDataFrame([], "id {}, dig long, item {}, b struct<similarity:double,first:int,distance:int>".format(*kinds))
    small = items.agg(F.sum(F.size("sh"))).first()[0] <= BROADCAST_ROWS
    per_doc = laid_windows(plain, items, widths, threshold, F.broadcast if small else (lambda df: df))
    held = per_doc.agg(F.sum(F.size("windows") + 1)).first()[0] or 0
    near = F.broadcast(per_doc) if held <= BROADCAST_ROWS else per_doc
    near = near.toDF("id2", "dig2", "windows")
    texts = plain.join(near, F.col("id").eqNullSafe(F.col("id2")) & (F.col("dig") == F.col("dig2"))).select("id", "dig", "text", "windows")

    # The windows' shingles and fingerprints, each different window once.
    made = None
    for width in widths:
        own = texts.select("id", "dig", doc_shingles(words_of(F.col("text")), width).alias("sh"), F.filter("windows", lambda w: w["width"] == width).alias("windows")).filter(F.size("windows") > 0)
        cut = own.select("id", "dig", "sh", F.explode("windows").alias("w"))
        first = F.greatest(F.col("w.start"), F.lit(0))
        last = F.least(F.col("w.start") + F.col("w.size") - width, F.size("sh") - 1)
        win = F.when(last >= first, F.slice("sh", first + 1, last - first + 1)).otherwise(F.array().cast("array<bigint>"))
        part = cut.select("id", "dig", F.lit(width).alias("width"), F.col("w.size").alias("size"), first.alias("first"), win.alias("win")).filter(F.size("win") > 0)
        made = part if made is None else made.unionByName(part)
    made = durable(made.withColumn("key", F.xxhash64("width", "size", "win")).distinct())
    prints = durable(made.groupBy("key", "width", "size").agg(F.first("win").alias("win")).withColumn("fp", fingerprint(F.col("win"))))
    close = close_pairs(prints, items, radius)

    alike = similarity(F.col("win"), F.col("sh"))
    verified = close.join(prints.select("key", "win"), "key").join(items.select("item", "sh"), "item").select("key", "item", "distance", alike.alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)
    per_key = durable(verified.groupBy("key").agg(F.collect_list(F.struct("item", "distance", "similarity")).alias("found")))
    pairs = lookup(made.select("id", "dig", "first", "key"), per_key, "key").select("id", "dig", "first", F.explode("found").alias("f"))
    return pairs.groupBy("id", "dig", F.col("f.item").alias("item")).agg(
        F.max_by(F.struct("f.similarity", "first", "f.distance"), F.struct("f.similarity", (-F.col("first")).alias("f"))).alias("b")
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, similarity, first_word and distance of the best window for every document and item that match."""
    best = leak_rows(docs, benchmark, **options).groupBy("id", "item").agg(F.max_by("b", F.struct("b.similarity", (-F.col("b.first")).alias("f"))).alias("b"))
    return best.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "b.similarity", F.col("b.first").alias("first_word"), F.col("b.distance").alias("distance"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that match no item, with their columns as they are. A row goes by its own text, whatever rows share its id."""
    return without_rows(docs, leak_rows(docs, benchmark, id_col=id_col, text_col=text_col, **options), id_col, text_col)
