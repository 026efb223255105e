"""URL filter: longest rule first, then a ratio of character language models. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractwise.session import release, settle

#: (verdict, rule); a rule is a host, which stands for its subdomains too, and the begin of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))

CONTEXT = 4  # characters of the longest context
COMMON = 4096  # a window of more than one in so many is sent to every task: there are fewer than that
WEIGHT = 2.0  # of the next shorter context, in counts
SYMBOLS = 256
BINS = 2000  # of scores, on either side of zero, for the calibration
PER_UNIT = 100.0
PAD = "\x01"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits. Of equal ones the first counts."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, begin = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + begin))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (rule, verdict) if rules else (F.lit(None).cast("string"),) * 2


def _padded(url: Column) -> Column:
    rest = F.lower(F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://", ""))
    return F.concat(F.lit(PAD * CONTEXT), rest)


def _places(padded: Column) -> Column:
    n = F.length(padded) - CONTEXT
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _windows() -> Column:
    """A row for every window of ``padded``."""
    return F.explode(F.transform(_places(F.col("padded")), lambda i: F.substring(F.col("padded"), i, CONTEXT + 1)))


def score_table(urls: DataFrame) -> DataFrame:
    """window, n, delta: log-likelihood difference (accepted minus rejected) of a character behind its context.

    ``urls`` has ``padded`` and ``train`` (allow, block or null). Every distinct window of all URLs has
    one row: the probability of its last character is smoothed from the longest context down to a
    uniform one, each order weighing ``WEIGHT`` counts. The table grows with the windows.
    """
    grams = urls.select("train", _windows().alias("window")).groupBy("window").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("train") == "allow").cast("double").alias("allow"),
        F.count_if(F.col("train") == "block").cast("double").alias("block"))
    grams = settle(grams)
    table = grams.select("window", "n", *[F.lit(1.0 / SYMBOLS).alias(f"p_{c}") for c in ("allow", "block")])
    total = grams.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    for k in range(CONTEXT + 1):
        gram = F.substring("window", CONTEXT + 1 - k, k + 1)
        seen = grams.groupBy(gram.alias("gram")).agg(F.sum("allow").alias("g_allow"), F.sum("block").alias("g_block"))
        table = table.withColumn("gram", gram).join(seen, "gram")
        if k:
            before = F.substring("window", CONTEXT + 1 - k, k)
            contexts = grams.groupBy(before.alias("before")).agg(
                F.sum("allow").alias("c_allow"), F.sum("block").alias("c_block"))
            table = table.withColumn("before", before).join(contexts, "before")
        else:
            table = table.withColumns({f"c_{c}": F.lit(total[c] or 0.0) for c in ("allow", "block")})
        table = table.select("window", "n", *[
            ((F.col(f"g_{c}") + WEIGHT * F.col(f"p_{c}")) / (F.col(f"c_{c}") + WEIGHT)).alias(f"p_{c}")
            for c in ("allow", "block")])
    scored = settle(table.select("window", "n", (F.log("p_allow") - F.log("p_block")).alias("delta")))
    release(grams)
    return scored


def scores(urls: DataFrame, table: DataFrame) -> DataFrame:
    """Mean score of the characters of every distinct ``padded`` URL that has any.

    A URL's windows meet the table by the window itself, in a shuffled join; how often the URL
    occurs changes nothing. Windows that would gather in one task, of which there are fewer than
    ``COMMON`` whatever the data, get their scores before.
    """
    every = settle(urls.select("padded").distinct().withColumn("id", F.monotonically_increasing_id()))
    common = F.col("n") > F.lit((table.agg(F.sum("n")).first()[0] or 0) / COMMON)
    windows = every.select("id", _windows().alias("window")).join(
        F.broadcast(table.filter(common).select("window", "delta")), "window", "left")
    rest = windows.filter("delta IS NULL").select("id", "window").join(
        table.filter(~common).select("window", "delta"), "window").select("id", "delta")
    means = windows.filter("delta IS NOT NULL").select("id", "delta").unionByName(rest).groupBy("id").agg(
        F.avg("delta").alias("score"))
    return every.join(means, "id").select("padded", "score")


def calibrate(scored: DataFrame) -> float:
    """The score that parts held-out accepted from rejected URLs with the best balanced accuracy.

    Only a histogram of ``2 * BINS + 1`` scores at most reaches the driver. 0 if a side has none.
    """
    b = F.least(F.greatest(F.round(F.col("score") * PER_UNIT), F.lit(-float(BINS))), F.lit(float(BINS)))
    rows = sorted((r["b"], r["allow"], r["block"]) for r in scored.groupBy(b.alias("b")).agg(
        F.count_if(F.col("held") == "allow").alias("allow"), F.count_if(F.col("held") == "block").alias("block")).collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    best, cut, kept, passed = -1.0, 0.0, good, bad
    last = None
    for at, allow, block in rows:
        here = kept / good + 1 - passed / bad
        if here > best + 1e-12:
            best, cut = here, (at if last is None else (at + last) / 2)
        kept, passed, last = kept - allow, passed - block, at
    return cut / PER_UNIT


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page.

    URLs that a rule decides teach both models: accepted ones are allowed, rejected ones blocked. A
    fifth of them (by hash) is held out to calibrate the threshold that decides all other URLs.
    Null, empty and malformed URLs have an empty host and path and, without characters, score 0;
    repeated rows are all judged; without any example on one side the threshold is 0.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    urls = urls.withColumns({"rule": rule, "said": verdict, "padded": _padded(F.col("url"))})
    held = F.pmod(F.crc32(F.coalesce(F.col("url"), F.lit("")).cast("binary")), F.lit(5)) == 0
    urls = urls.withColumns({"train": F.when(~held, F.col("said")), "held": F.when(held, F.col("said"))})
    table = score_table(urls.select("padded", "train"))
    scored = settle(scores(urls.select("padded"), table))
    cut = calibrate(urls.filter("held IS NOT NULL").select("held", "padded").join(scored, "padded"))
    scored = urls.join(scored, "padded", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    model = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", model).alias("verdict"), "score")


def op2_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
