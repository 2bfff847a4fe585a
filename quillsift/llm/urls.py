"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.llm.common import NUMBER_ROWS, batches_of

#: (host, path, verdict). A rule fits its host and all subdomains of it, if the path starts with the rule's.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Buckets of the hashed n-grams, and their lengths.
BUCKETS, LENGTHS = 1 << 14, (3, 4, 5)
#: Steps (Adam), step size and L2 penalty of the training.
STEPS, RATE, PENALTY = 300, 0.1, 1e-5
#: Probability from which a URL is blocked.
THRESHOLD = 0.5

#: Words of made-up sites to block and to allow, words that either may have, and syllables of names without meaning.
JUNK = """casino poker slots jackpot betting roulette lottery viagra pills pharmacy steroids replica xxx porn adult cams escort
    nudes loans payday cashfast crack keygen warez torrents serials spam backlinks linkfarm adserver clicktrack banner popup
    clickbait getrich forex miracle dietpills hotsingles sweepstakes""".split()
PLAIN = """library museum university school garden recipes weather history science music books travel city hospital code docs
    wiki news photo maps chess birds astronomy poetry cooking cycling trains geology law maths physics theatre opera cinema
    pottery sailing hiking farming economy parliament""".split()
EITHER = "online best free now guide world daily club house shop top my the deals live".split()
SYLLABLES = "lo ra mi ten bar ku sel don vi pa gor lin ash mer tu fen".split()
#: How hosts and paths are put together: {a} the word, {b} one of EITHER, {n} a number.
HOSTS = ("www.{a}.{tld}", "{a}-{b}.{tld}", "{b}{a}.{tld}", "m.{a}{b}.{tld}", "blog.{b}-{a}.{tld}", "{a}.{b}.{tld}", "www.{b}-{a}-{b}.{tld}", "{a}{n}.{tld}")
PATHS = ("/", "/{b}/", "/en/{n}", "/fr/{n}.html", "/de/{n}/", "/{b}/{n}", "/index.html", "/a/{b}-{n}")
DOMAINS = ("site.example", "example.org", "example.net", "web.example", "example.com")


def labelled_urls(each: int = 8) -> tuple[tuple[str, str, int], ...]:
    """The labelled URLs, (host, path, 1 to block): `each` for every word of JUNK and PLAIN, and for a name of syllables to each word of JUNK.

    All are put together by this rule from the words above; none is taken from a table of pages.
    """
    names = ["".join(SYLLABLES[(7 * k + 5 * j * (k + 1) + j) % len(SYLLABLES)] for j in range(2 + k % 3)) for k in range(len(JUNK))]
    out = []
    for k, (word, label) in enumerate([(w, 1) for w in JUNK] + [(w, 0) for w in PLAIN] + [(w, 0) for w in names]):
        for j in range(each):
            at = 13 * k + 5 * j
            words = {"a": word, "b": EITHER[at % len(EITHER)], "n": 37 * at % 9973, "tld": DOMAINS[(k + j) % len(DOMAINS)]}
            out.append((HOSTS[(k + j) % len(HOSTS)].format(**words), PATHS[(3 * k + j) % len(PATHS)].format(**words), label))
    return tuple(out)


LABELLED = labelled_urls()


def host_of(url: Column) -> Column:
    """Between the first "://" and the next "/", "?", "#" or end, A-Z lower-cased; empty without "://"."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(found.rlike("[A-Z]"), F.translate(found, upper, upper.lower())).otherwise(found)


def path_of(url: Column) -> Column:
    """From the end of the host to "?", "#" or end; empty without "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, host and path as one string, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, start, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(domain + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct n-grams of host and path, each marked with where it stands."""
    found: set[int] = set()
    for mark, text in ((b"h", f"^{host}$"), (b"p", f"^{path}$")):
        raw = text.encode("utf-8", "surrogatepass")
        for n in LENGTHS:
            found.update(zlib.crc32(mark + raw[k : k + n]) % BUCKETS for k in range(len(raw) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def train(rows: tuple[tuple[str, str, int], ...] = LABELLED) -> tuple[np.ndarray, float]:
    """Weights and offset of the logistic regression, by full gradient steps (Adam) on unit vectors; always the same."""
    buckets = [features(h, p) for h, p, _ in rows]
    which = np.repeat(np.arange(len(rows)), [len(b) for b in buckets])
    flat = np.concatenate(buckets)
    value = 1 / np.sqrt(np.array([max(1, len(b)) for b in buckets]))[which]
    label = np.array([y for *_, y in rows], float)
    weight, m, v = (np.zeros(BUCKETS + 1) for _ in range(3))
    for t in range(1, STEPS + 1):
        score = np.bincount(which, weight[flat] * value, len(rows)) + weight[-1]
        error = (1 / (1 + np.exp(-score)) - label) / len(rows)
        step = np.append(np.bincount(flat, error[which] * value, BUCKETS) + PENALTY * weight[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step * step
        weight -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return weight[:-1], float(weight[-1])


def probability(host: str, path: str, weight: np.ndarray, offset: float) -> float:
    on = features(host, path)
    return float(1 / (1 + np.exp(-(weight[on].sum() / np.sqrt(max(1, len(on))) + offset))))


def spam_probability(rows: tuple[tuple[str, str, int], ...] = LABELLED):
    """A function of (host, path) columns that gives the probability of a URL to block."""
    weight, offset = train(rows)

    @F.pandas_udf(T.DoubleType())
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([probability(h, p, weight, offset) for h, p in zip(host, path, strict=True)], dtype="float64")

    return score


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, labelled: tuple[tuple[str, str, int], ...] = LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """id, host, path, rule, verdict, spam: one row for each row of pages.

    verdict is that of the longest rule that fits, else "block" from the regression's probability `spam` of `threshold`
    on, else "allow". A null URL, or one without "://", has an empty host and path; no rule fits it and the regression
    judges it. Rows that share an id, or have none, are judged each by itself; equal URLs get equal verdicts. An empty
    table gives no rows; other columns are not read.
    """
    batches_of(pages.sparkSession, NUMBER_ROWS // 10)
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    judged = parts.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("spam", spam_probability(labelled)("host", "path"))
    method = F.when(F.col("spam") >= threshold, "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "spam")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
