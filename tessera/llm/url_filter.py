"""URL filters: host and path rules, and a logistic regression on hashed character n-grams.

Everything that touches the urls is Spark SQL functions. The regression is trained on a small table of
labelled urls (at most ``MAX_LABELLED`` rows; more are an error, not a sample): their n-gram features
come from the same expressions, and the driver runs gradient descent over these few rows. The query's table is made by a rule
from lists of words; it is tested on urls of other seeds, and words in them that no url of the table has. The weights
enter the plan as one constant array of ``BUCKETS`` doubles.

Rules are few (at most ``MAX_RULES``): each is a literal test of host and path, longest first.

Defined results: a null url, or one without ``://``, has empty host and path, no rule fits it, and it
gets the verdict of the method for no features at all (the intercept); repeated rows repeat; ids may
be null; columns other than the named ones are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, SIZES = 1 << 15, (3, 4)
MAX_LABELLED, MAX_RULES = 10_000, 256
#: Steps of the descent, their size, the penalty on squared weights, and how much a path counts beside its host.
STEPS, RATE, DECAY, PATH_SCALE = 300, 5.0, 1e-4, 0.3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: The rules of the query.
RULES = [
    Rule("com/en/", "block"),
    Rule("example.com/en/7", "allow"),
    Rule("net/de/", "allow"),
    Rule("example.net/de/8", "block"),
    Rule("org/es/", "block"),
]

#: Words of the hosts of the labelled urls: of those to block, of those to let pass, and of both.
BAD_WORDS = "adult ads adserver bets betting bonus camgirls cash casino cheap clicks crypto dating discount escorts fake farm free hack jackpot keygen lender loans lottery malware meds nude payday pharmacy phish pills poker popup porn prize replica roulette scam sex slots spam steroids tracker track viagra wager warez win winner xxx".split()
GOOD_WORDS = "academy archive astronomy atlas bakery books botany bridge chess choir cinema climate college council cycling design energy engineering fishing forest gallery garden geology government harbour history hospital journal kitchen language library market mathematics museum music nature observatory orchestra painting physics poetry radio railway recipes research river school science theatre travel university village weather wildlife".split()
BOTH_WORDS = "365 best center city club direct global group home hub my network new now online point portal site spot the today world zone".split()
SYLLABLES = [c + v + e for c in "b d f g h k l m n p r s t th v w sh st".split() for v in "aeiou" for e in ("", "n", "r", "s")]
#: What surrounds the words; the same for both labels, but for a few paths.
BEFORE, DOMAINS = ["", "", "www.", "m.", "blog.", "shop."], ["example.com", "example.net", "example.org", "com", "net", "info", "co.uk"]
PATHS = ["", "/", "/{l}/{n}", "/{l}/{n}/", "/{l}/{n}.html", "/{l}/{n}?page=2&ref=x", "/{l}/{n}#top", "/{l}/{n}?utm_source=feed", "/index.php?id={n}", "/posts/{n}", "/img/{n}.png"]
BAD_PATHS, GOOD_PATHS = ["/buy-now/{n}", "/claim-your-prize", "/redirect?ad={n}", "/free-download/{n}.exe", "/live-cams"], ["/about", "/contact", "/articles/{n}", "/opening-hours", "/catalogue/{n}"]
#: Labelled urls from which the query learns, a third of them to block.
LABELLED_ROWS = 2400


def labelled(rows: int = LABELLED_ROWS, seed: int = 29) -> list[tuple[str, int]]:
    """A small labelled table by a rule: urls and 1 (to block) or 0, hosts of one to three words, or of syllables, with what may surround them."""
    rnd = random.Random(seed)

    def host(label: int) -> str:
        if not label and rnd.random() < 0.4:
            return "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(2, 4)))
        own = BAD_WORDS if label else GOOD_WORDS
        words = [rnd.choice(own)] + [rnd.choice(own if rnd.random() < 0.5 else BOTH_WORDS) for _ in range(rnd.randint(0, 2))]
        rnd.shuffle(words)
        return rnd.choice(["-", "-", "", "."]).join(words) + rnd.choice(["", "", "", str(rnd.randint(1, 99))])

    out = []
    for i in range(rows):
        label = int(i % 3 == 0)
        path = rnd.choice((BAD_PATHS if label else GOOD_PATHS) if rnd.random() < 0.15 else PATHS).format(l=rnd.choice(["en", "de", "fr", "es"]), n=rnd.randint(1, 9999))
        out.append((f"{rnd.choice(['http', 'https'])}://{rnd.choice(BEFORE)}{host(label)}.{rnd.choice(DOMAINS)}{path}", label))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def features(text: Column, mark: str, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> Column:
    """The distinct hashed n-grams of a host or a path, marked by which of the two it is."""
    letters = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")
    empty = F.array().cast("array<int>")

    def of_size(n: int) -> Column:
        starts = F.when(F.size(letters) >= n, F.sequence(F.lit(1), F.size(letters) - (n - 1))).otherwise(empty)
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.concat(F.lit(mark), F.array_join(F.slice(letters, i, n), ""))), F.lit(buckets)).cast("int"))

    grams = [of_size(n) for n in sizes]
    return F.when(text != "", F.array_distinct(F.concat(*grams))).otherwise(empty)


def train(labelled: DataFrame, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> tuple[list[float], float]:
    """Weights and intercept from ``labelled`` (url string, label 0 or 1), by gradient descent with momentum."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where(F.col("label").isin(0, 1)).select(features(host, "h", buckets, sizes).alias("h"), features(path, "p", buckets, sizes).alias("p"), F.col("label").cast("double").alias("y")).take(MAX_LABELLED + 1)
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled urls; train on a table within this bound")
    if not rows:
        return [0.0] * buckets, 0.0
    # Each part is at unit length, the path's shorter, so that a long path does not drown its host.
    cells = [(i, at, scale / math.sqrt(len(f))) for i, r in enumerate(rows) for f, scale in ((r.h, 1.0), (r.p, PATH_SCALE)) for at in f]
    row, column, value = (np.array(x, t) for x, t in zip(zip(*cells, strict=True) if cells else ((), (), ()), (np.int64, np.int64, np.float64), strict=True))
    y = np.array([r.y for r in rows])
    w, b, dw, db = np.zeros(buckets), 0.0, np.zeros(buckets), 0.0
    for _ in range(STEPS):
        z = b + np.bincount(row, w[column] * value, len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        dw = 0.9 * dw + np.bincount(column, error[row] * value, buckets) / len(rows) + DECAY * w
        db = 0.9 * db + float(error.mean())
        w, b = w - RATE * dw, b - RATE * db
    return w.tolist(), float(b)


def score(host: Column, path: Column, weights: list[float], intercept: float, sizes: tuple[int, ...] = SIZES) -> Column:
    """The probability that a url is one to block."""
    table = F.from_json(F.lit("[" + ",".join(repr(float(x)) for x in weights) + "]"), "array<double>")

    def part(f: Column) -> Column:
        return F.aggregate(f, F.lit(0.0), lambda acc, i: acc + F.get(table, i)) / F.sqrt(F.greatest(F.size(f), F.lit(1)).cast("double"))

    z = F.lit(float(intercept)) + part(features(host, "h", len(weights), sizes)) + F.lit(PATH_SCALE) * part(features(path, "p", len(weights), sizes))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict and the method's score."""
    weights, intercept = train(labelled)
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select(id_col, host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select(id_col, "host", "path", text.alias("rule"), verdict.alias("_by_rule"), score(F.col("host"), F.col("path"), weights, intercept).alias("score")).select(
        id_col, "host", "path", "rule", F.coalesce("_by_rule", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score"
    )


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table, as a literal relation that needs no Python on the executors."""
    text = ", ".join(f"('{u}', {y})" for u, y in labelled())
    return spark.sql(f"SELECT * FROM VALUES {text} AS t(url, label)")
