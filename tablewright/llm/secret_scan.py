"""Secret scans by a battery of randomness tests, in DataFrame functions only.

Three base kinds are found by pattern. The method adds long tokens that look random. A candidate's letters and digits (signs
that join words don't count) tell its encoding: hex, base32, base36 or base62, which base64 is without its signs.
Three statistics are compared with what ordinary wording has in that encoding, each as a normal deviate that knows the
token's length:

* uniformity: the chi-squared statistic against the encoding's alphabet, as the share of pairs of symbols that are equal, to
  which it is proportional, lies below that of wording;
* runs: the classes upper, lower and digit change more often than in wording;
* serial correlation: vowels and consonants take turns less than in wording, where one calls for the other, and
  neighbours' places in the alphabet don't follow each other as in counted strings (the weaker of both counts).

The deviates' sum over the root of three gives the token's p-value. The reference values (``WORDING``) are those of made identifiers
in CamelCase, with numbers, versions, short words, under- and hyphens; tests hold the rate on other ones.
Tokens of digits alone are none. Paths are cut at their slashes, so that a step is a candidate and not the whole path.

Within a text the candidates form one family under false-discovery control: Benjamini-Hochberg with weights in proportion to
length. No row needs another, so the scan has no shuffle, and a hot text costs no more than any other.

Defined results: a null or empty text has no spans and the digest of nothing; an empty table gives no rows; a very long text or
very many spans cost in proportion to their length; repeated rows stay; ids that are null stay null; further input columns,
whatever their names, are ignored by ``secret_report`` and carried by ``redact``. Places are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import of
from tablewright.llm.texts import let, replaced, running

# The base kinds' patterns. Matches of "assign" count from 12 characters of value on.
ASSIGN = (
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
)
ASSIGN_HEAD = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: By the size of the alphabet: the share of equal pairs in wording and its spread, and the rate of class changes and its spread (both
#: spreads fall with the root of the length).
WORDING = {16: (0.11, 0.09, 0.20, 0.35), 32: (0.065, 0.10, 0.15, 0.40), 36: (0.065, 0.10, 0.15, 0.40), 62: (0.045, 0.08, 0.45, 0.30)}
#: The share of neighbouring letters in wording of which just one is a vowel, its spread, and the correlation of counted strings.
TURNS, TURNS_SPREAD, CORRELATION = 0.63, 0.53, 0.6
#: Fewest letters and digits of a candidate.
LEAST_CORE = 16


def places(text: Column, pattern: str) -> Column:
    """array<struct<s, e, t>>: start, end and string of every leftmost match that doesn't overlap the one before."""

    def located(found: Column) -> Column:
        def placed(parts: Column) -> Column:
            steps = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
            return let(
                running(steps, lambda a, b: a + b),
                lambda ends: F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("t"))),
            )

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), placed)).otherwise(F.array().cast("array<struct<s:int,e:int,t:string>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def normal_above(z: Column) -> Column:
    """Chance of a standard normal value above z, by a logistic approximation."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def encoding(core: Column) -> tuple[Column, Column, list[Column]]:
    """Size and order of the inferred encoding's alphabet, and the values of WORDING for it."""
    options = (
        (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16, DIGIT + "abcdefABCDEF"),
        (r"^[A-Z2-7]+$", 32, UPPER + "234567"),
        (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", 36, DIGIT + LOWER + UPPER),
    )
    size, order = F.lit(62), F.lit(UPPER + LOWER + DIGIT)
    for pattern, k, chars in reversed(options):
        size = F.when(core.rlike(pattern), F.lit(k)).otherwise(size)
        order = F.when(core.rlike(pattern), F.lit(chars)).otherwise(order)
    values = []
    for i in range(4):
        value = F.lit(WORDING[62][i])
        for k in (16, 32, 36):
            value = F.when(size == k, F.lit(WORDING[k][i])).otherwise(value)
        values.append(value)
    return size, order, values


def p_value(token: Column) -> Column:
    """Chance that wording of this length and encoding looks as random as the token."""

    def tests(x: Column) -> Column:
        core, chars, n = x["core"], x["chars"], F.length(x["core"]).cast("double")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow((n - F.length(F.replace(core, c, F.lit("")))).cast("double"), F.lit(2.0)))
        chi = x["k"] / n * squares - n  # against equal shares; wording's is linear in its share of equal pairs
        wording = x["k"] * (1 + (n - 1) * x["pairs"]) - n
        uniform = (wording - chi) / (x["k"] * (n - 1) * x["pairs_spread"] / F.sqrt(n))
        classes = F.translate(core, UPPER + LOWER + DIGIT, "U" * 26 + "L" * 26 + "D" * 10)
        changes = F.length(F.regexp_replace(classes, r"(.)\1*", "$1")) - 1
        runs = (changes / (n - 1) - x["changes"]) / x["changes_spread"] * F.sqrt(n - 1)
        # Neighbouring letters are those of one stretch of letters.
        kinds = F.regexp_replace(F.translate(core, UPPER + LOWER, "".join("V" if c in "AEIOU" else "C" for c in UPPER) * 2), "[0-9]+", " ")
        plain = lambda c: F.length(F.replace(c, F.lit(" "), F.lit("")))
        stretches = plain(F.regexp_replace(kinds, "[VC]+", "x"))
        pairs, turns = plain(kinds) - stretches, plain(F.regexp_replace(kinds, "V+|C+", "x")) - stretches
        speech = (TURNS * pairs - turns) / (TURNS_SPREAD * F.sqrt(F.greatest(pairs, F.lit(1))))
        values = F.transform(chars, lambda c: F.position(c, x["order"]).cast("double"))

        def correlation(v: Column) -> Column:
            mean = F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / n
            var = F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y) / n - mean * mean
            last = F.size(v) - 1
            cross = F.aggregate(F.zip_with(F.slice(v, 1, last), F.slice(v, 2, last), lambda a, b: a * b), F.lit(0.0), lambda a, y: a + y) / (n - 1)
            return F.when(var > 0, F.greatest(F.lit(-0.99), F.least(F.lit(0.99), (cross - mean * mean) / var))).otherwise(F.lit(0.99))

        counted = let(values, lambda v: (F.atanh(F.lit(CORRELATION)) - F.atanh(correlation(v))) * F.sqrt(n - 3))
        return normal_above((uniform + runs + F.least(speech, counted)) / F.sqrt(F.lit(3.0)))

    def guarded(core: Column) -> Column:
        size, order, (pairs, pairs_spread, changes, changes_spread) = encoding(core)
        known = F.struct(
            core.alias("core"), size.cast("double").alias("k"), order.alias("order"), F.split(core, "").alias("chars"), pairs.alias("pairs"), pairs_spread.alias("pairs_spread"),
            changes.alias("changes"), changes_spread.alias("changes_spread"),
        )
        return F.when((F.length(core) >= LEAST_CORE) & core.rlike("[A-Za-z]"), let(known, tests)).otherwise(F.lit(1.0))

    return let(F.regexp_replace(token, "[^A-Za-z0-9]", ""), guarded)


def random_spans(text: Column, rate: float) -> Column:
    """Candidates that weighted Benjamini-Hochberg finds at the rate within one text, by place."""
    kind = "array<struct<s:int,e:int>>"

    def chosen(found: Column) -> Column:
        mean = F.aggregate(found, F.lit(0.0), lambda a, c: a + F.length(c["t"])) / F.size(found)
        weighted = let(mean, lambda m: F.transform(found, lambda c: F.struct((p_value(c["t"]) * m / F.length(c["t"])).alias("w"), c["s"].alias("s"), c["e"].alias("e"))))

        def cut(family: Column) -> Column:
            level = F.lit(rate) / F.size(family)
            upto = F.array_max(F.transform(family, lambda c, i: F.when(c["w"] <= level * (i + 1), i + 1).otherwise(F.lit(0))))
            return F.array_sort(F.transform(let(upto, lambda k: F.slice(family, 1, k)), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"))))

        return F.when(F.size(found) > 0, let(F.array_sort(weighted), cut)).otherwise(F.array().cast(kind))

    return let(places(text, CANDIDATE), chosen)


def with_spans(docs: DataFrame, text: Column, *, rate: float = 0.01, least_value: int = 12) -> DataFrame:
    """Adds __assign, __access, __hex and __random: arrays of structs with s and e.

    What a base span covers is blanked before candidates are looked for, so random spans never touch one.
    """
    value = lambda m: F.length(F.regexp_replace(m["t"], ASSIGN_HEAD, ""))
    assign = F.filter(places(text, ASSIGN), lambda m: value(m) >= least_value)
    found = docs.withColumns({"__assign": assign, "__access": places(text, ACCESS), "__hex": places(text, HEX)})
    blank = replaced(text, listed(*KINDS[:3]), lambda m, done: F.repeat(F.lit(" "), F.greatest(m["e"] - F.greatest(m["s"], done), F.lit(0))))
    return found.withColumn("__random", let(blank, lambda t: random_spans(t, rate)))


def listed(*kinds: str) -> Column:
    """All spans of the kinds, by start and then kind as listed."""

    def named(kind: str) -> Column:
        rank = F.lit(KINDS.index(kind))
        return F.transform(f"__{kind}", lambda m: F.struct(m["s"].alias("s"), rank.alias("k"), m["e"].alias("e"), F.lit(kind).alias("name")))

    return F.array_sort(F.concat(*map(named, kinds)))


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["name"], m["s"], m["e"])), ",")


def secret_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of every document."""
    plain = docs.select(of(docs, id_col).alias("doc_id"), F.coalesce(of(docs, text_col).cast("string"), F.lit("")).alias("__text"))
    found = with_spans(plain, F.col("__text"), **options)
    return found.select(
        "doc_id", *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(shown(listed(*KINDS[:3])), 256).alias("base_sha256"), shown(listed(*KINDS)).alias("spans"), F.size("__random").cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every span replaced by ``mark``; spans that overlap become one. Null texts stay null."""
    packed = docs.select(F.struct(*(of(docs, c).alias(c) for c in docs.columns)).alias("row"), of(docs, text_col).cast("string").alias("text"))  # so that no name clashes
    text = F.col("text")
    found = with_spans(packed, F.coalesce(text, F.lit("")), **options).withColumn("spans", listed(*KINDS))
    clean = replaced(text, F.col("spans"), lambda m, done: F.when(m["s"] >= done, F.lit(mark)).otherwise(F.lit("")))
    return found.select(*((clean if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
