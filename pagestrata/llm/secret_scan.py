"""Secret scans by patterns and a randomness test battery, with DataFrame functions only.

Base spans come from three patterns. The battery judges every other token of
TOKEN characters: its encoding is inferred (hex, base32, letters of one case with digits, or
base64, the smallest alphabet that holds it), and three statistics compare it with uniform draws from
that alphabet: chi-squared of symbol counts (Wilson-Hilferty scale), the number of
runs of character classes, and the lag-1 serial correlation of symbols. Their sum
of squares T is small for random strings and large for words.

The null hypothesis is that a token is made of words. Its distribution comes from
the corpus: every text, without such tokens and what separates its words, is cut into pieces of the length classes, and the mean and deviation of the root of T over
all pieces of a class give each token of that class a normal p-value, so a class
needs no word-like token of its own and the same text gives like p-values at any
size of the corpus. False discoveries are controlled per class by the
Benjamini-Hochberg step-up over binned p-values. Tokens of one case of letters, or
of digits only, are words to the battery and never added.

Defined cases: null or empty text has no spans; rows are judged each, repeated ones
too; rows without doc_id keep their null; an empty table gives no rows; of equal
p-values all or none are added; a table whose texts have no piece of a class adds
nothing in it; long texts: matches become rows, so the work grows with their number
and not with its square; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.llm.tables import settle

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "random")
#: A token of the battery: so many characters of base64, with no such character on either side.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
LENGTH_CLASSES = (20, 24, 32, 48, 96)
FALSE_DISCOVERY_RATE = 0.05
#: Bins of p-values, and bins a power of ten.
BINS, BINS_A_TENTH = 400, 10
#: Coefficients of the normal tail after Zelen and Severo (fixed values).
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
TAIL_SCALE = 0.2316419
SPAN = "struct<start:int,end:int,size:int>"
MATCH = "struct<kind:int,gap:int,n:int,size:int,token:string>"


def matches_of(text: Column, pattern: str, kind: str, value: int | None = None) -> Column:
    """Array of MATCH: leftmost non-overlapping matches with the characters since the match before; size is that of the value group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else whole
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(whole, values, lambda m, v: F.struct(m.alias("m"), F.char_length(v).alias("v")))
    steps = F.zip_with(
        both,
        gaps,
        lambda b, gap: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            F.char_length(gap).alias("gap"),
            F.char_length(b["m"]).alias("n"),
            b["v"].alias("size"),
            (b["m"] if kind == "random" else F.lit(None).cast("string")).alias("token"),
        ),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), F.filter(steps, lambda s: s["n"].isNotNull())).otherwise(F.array().cast(f"array<{MATCH}>"))


def kind_spans(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_matches(docs: DataFrame) -> DataFrame:
    """(row, doc_id, matches) of every row of docs."""
    text = F.col("text")
    found = F.concat(matches_of(text, ASSIGN, "assign", 1), matches_of(text, ACCESS, "access"), matches_of(text, HEX, "hex"), matches_of(text, TOKEN, "random"))
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("matches"))


def placed(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, size, token): base spans, and the tokens that meet none of them."""
    each = found.where(F.size("matches") > 0).select("row", F.posexplode("matches").alias("pos", "m")).select("row", "pos", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.col("n")).over(upto).cast("int")
    spans = each.select("row", "kind", end.alias("end"), "n", "size", "token").withColumn("start", F.col("end") - F.col("n"))
    is_token = F.col("kind") == KINDS.index("random")
    spans = spans.where(is_token | (F.col("kind") != KINDS.index("assign")) | (F.col("size") >= MIN_VALUE))
    # the furthest end of base spans that start before, or with, a token, and the next start of one after it
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("reached", F.max(F.when(~is_token, F.col("end"))).over(before)).withColumn("next", F.min(F.when(~is_token, F.col("start"))).over(after))
    free = F.coalesce(F.col("reached") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    return spans.where(~is_token | free).select("row", "kind", "start", "end", "size", "token")


def battery(tokens: DataFrame) -> DataFrame:
    """tokens (token, ...) with root, that of the summed squares of the three statistics, and word_like."""
    token, n = F.col("token"), F.col("_n")
    encodings = [(r"^([0-9a-f]+|[0-9A-F]+)$", 16.0), (r"^[A-Z2-7]+=*$", 32.0), (r"^([0-9a-z]+|[0-9A-Z]+)$", 36.0)]
    size = F.coalesce(*[F.when(token.rlike(pattern), k) for pattern, k in encodings], F.lit(64.0))
    # chance that a uniform draw starts a new run; an upper case run and the lower case one after it, as in names, are one
    change = F.when(F.col("_size") == 16, 0.46875).when(F.col("_size") == 32, 0.3046875).when(F.col("_size") == 36, 0.4012345679).otherwise(0.4697265625)
    squares = lambda kinds: F.aggregate(kinds, F.lit(0.0), lambda acc, c: acc + F.pow(n - F.char_length(F.replace(token, c, F.lit(""))), F.lit(2)))
    zero = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("sp"))

    def add(acc: Column, x: Column) -> Column:
        return F.struct(x.alias("last"), (acc["s"] + x).alias("s"), (acc["ss"] + x * x).alias("ss"), (acc["sp"] + acc["last"] * x).alias("sp"))

    rows = tokens.withColumn("_n", F.char_length(token).cast("double")).withColumn("_size", size).withColumn("_chars", F.filter(F.split(token, ""), lambda c: c != ""))
    rows = rows.withColumn("_squares", squares(F.array_distinct("_chars"))).withColumn("_sums", F.aggregate(F.transform("_chars", lambda c: F.ascii(c).cast("double")), zero, add))
    free = F.col("_size") - 1
    scale = 2 / (9 * free)
    chi = (F.cbrt(F.greatest(F.col("_size") / n * F.col("_squares") - n, F.lit(0.0)) / free) - (1 - scale)) / F.sqrt(scale)
    runs = F.size(F.regexp_extract_all(token, F.lit("[A-Z]*[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0)))
    run = (runs - 1 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
    mean = F.col("_sums.s") / n
    spread = F.col("_sums.ss") - n * mean * mean
    lagged = F.col("_sums.sp") - mean * (2 * F.col("_sums.s") - F.ascii(token) - F.col("_sums.last")) + (n - 1) * mean * mean
    serial = F.when(spread > 1e-9, lagged / spread * F.sqrt(n)).otherwise(F.sqrt(n))
    rows = rows.withColumn("_chi", F.greatest(chi, F.lit(0.0))).withColumn("_run", run).withColumn("_serial", serial)
    root = F.sqrt(F.col("_chi") * F.col("_chi") + F.col("_run") * F.col("_run") + F.col("_serial") * F.col("_serial"))
    return rows.select(*tokens.columns, root.alias("root"), token.rlike("^([a-z]+|[A-Z][a-z]*|[A-Z]+|[0-9]+)$").alias("word_like"))


def null_pieces(docs: DataFrame) -> DataFrame:
    """(class, token): whole texts, but for the battery's tokens and what separates words, cut into pieces of the length classes in turn."""
    joined = F.regexp_replace(F.regexp_replace("text", TOKEN, " "), "[^A-Za-z0-9]+", "")
    cut = "".join([f"(.{{{LENGTH_CLASSES[0]}}})", *[f"(.{{{n}}}|)" for n in LENGTH_CLASSES[1:]]])
    of = lambda c: F.transform(F.regexp_extract_all("joined", F.lit(cut), F.lit(c + 1)), lambda t: F.struct(F.lit(c).alias("class"), t.alias("token")))
    pieces = F.filter(F.concat(*[of(c) for c in range(len(LENGTH_CLASSES))]), lambda p: p["token"] != "")
    return docs.select(joined.alias("joined")).select(F.explode(pieces).alias("p")).select("p.*")


def null_moments(docs: DataFrame) -> DataFrame:
    """(class, mean, deviation) of the root of the battery's statistic over all null pieces."""
    moments = battery(null_pieces(docs)).groupBy("class").agg(F.avg("root").alias("mean"), F.stddev_pop("root").alias("deviation"))
    return moments.where("deviation > 0")


def normal_tail(z: Column) -> Column:
    """P(Z <= z) for a normal Z, for z below 0; 1 above."""
    x = F.abs(z)
    t = 1 / (1 + TAIL_SCALE * x)
    poly = F.lit(0.0)
    for c in reversed(TAIL):
        poly = (poly + c) * t
    return F.when(z < 0, F.exp(-x * x / 2) * 0.3989422804014327 * poly).otherwise(1.0)


def judged_tokens(tokens: DataFrame, moments: DataFrame) -> DataFrame:
    """tokens (token, ...) that aren't word-like, with class (of length) and bin (of the p-value, smaller p-values higher)."""
    cls = sum((F.char_length("token") >= n).cast("int") for n in LENGTH_CLASSES) - 1
    z = (F.col("root") - F.col("mean")) / F.col("deviation")
    bin_ = F.floor(-F.log10(F.greatest(normal_tail(z), F.lit(1e-300))) * BINS_A_TENTH)
    judged = battery(tokens).where(~F.col("word_like")).withColumn("class", cls).join(F.broadcast(moments), "class")
    return judged.withColumn("bin", F.least(bin_, F.lit(BINS)).cast("int")).drop("root", "word_like", "mean", "deviation", "token")


def thresholds(judged: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """(class, first_bin): the lowest bin that the step-up procedure accepts in each class of length."""
    counted = judged.groupBy("class", "bin").agg(F.count("*").alias("n"))
    share = F.sum("n").over(Window.partitionBy("class").orderBy(F.desc("bin"))) / F.sum("n").over(Window.partitionBy("class"))
    return counted.withColumn("share", share).where(F.pow(F.lit(10.0), -F.col("bin") / BINS_A_TENTH) <= rate * F.col("share")).groupBy("class").agg(F.min("bin").alias("first_bin"))


def scan(docs: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """(doc_id, assign, access, hex, random): arrays of (start, end, size) for every row of docs."""
    found = settle(with_matches(docs))
    spans = settle(placed(found))
    # at most one row a length class: these broadcasts are bounded
    moments = settle(null_moments(docs))
    judged = settle(judged_tokens(spans.where(F.col("kind") == KINDS.index("random")), moments))
    added = judged.join(F.broadcast(thresholds(judged, rate)), "class").where(F.col("bin") >= F.col("first_bin"))
    every = spans.where(F.col("kind") != KINDS.index("random")).select("row", "kind", "start", "end", "size").unionByName(added.select("row", "kind", "start", "end", "size"))
    listed = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "size", "kind"))).alias("spans"))
    both = found.select("row", "doc_id").join(listed, "row", "left")
    of = lambda kind: F.transform(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["size"].alias("size")))
    return both.select("doc_id", *[F.coalesce(of(k), F.array().cast(f"array<{SPAN}>")).alias(k) for k in KINDS])
