"""URL filter: host and path rules, else a logistic regression on hashed n-grams.

A rule is a host, with its subdomains, and the beginning of a path; the longest rule
that fits decides. Other urls are scored by a logistic regression on hashed character
n-grams of host and path, trained from a small labelled table of urls (``SEED``; at most
MAX_SEED rows are accepted). All of it is DataFrame expressions: n-grams by
``transform`` over positions, the training by gradient steps that are aggregations over
the small table, the score by a lookup in an array of weights.

Edge cases: a null url, or one without ``://``, has an empty host and path, and is
scored like any other (no n-gram: the bias decides); an empty host fits no rule; long
urls are used whole; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import written

#: Slots of the hashed n-grams, lengths of these, gradient steps, and how far a weight
#: moves in the first of them. Steps adapt to each slot's own slope, so that a rare n-gram
#: gets its weight in as few of them as a frequent one.
SLOTS = 1 << 15
GRAMS = (3, 4)
STEPS = 24
RATE = 0.3

#: Labelled urls that a training accepts.
MAX_SEED = 1000

#: A url's verdict is block if its probability is at least this.
THRESHOLD = 0.5

#: The rules (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Words of the labelled table's hosts: unwanted ones, and plain ones.
UNWANTED = (
    "casino poker slots jackpot roulette betting bets lotto gamble bingo win winner bonus prize lucky pills viagra cialis meds rx pharma"
    " steroids diet slim cheap discount replica fake loan payday cash money rich adult sex xxx porn cam nude hot dating escort babes"
    " warez crack keygen serial torrent pirate spam farm ads adserver track tracker click popup banner phish malware virus hack exploit free"
).split()
PLAIN = (
    "river stone garden school library museum science weather history music kitchen travel city harbour forest mountain market studio"
    " journal daily times post report review paper letters archive notes guide lexicon wiki forum community church council county health"
    " clinic nature animal flower bridge railway airport island valley meadow winter summer bakery carpenter painter theatre cinema opera"
    " football cycling chess physics chemistry biology maths energy water earth planet space"
).split()

#: Syllables of plain hosts that are no words, ends of hosts, beginnings, and paths.
SYLLABLES = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ra mi ka lo sun bel tor nim qua".split()
ENDS = "example.com example.net example.org test invalid".split()
STARTS = ("", "www.", "m.", "blog.")
PATHS = ("/en/17", "/de/204.html", "/fr/5/", "/es/881", "/index.html", "/about/", "/", "")
UNWANTED_PATHS = ("/slots/bonus.html", "/buy/pills", "/adult/gallery", "/win/jackpot", "/free/crack.zip")


def _seed() -> tuple[tuple[str, int], ...]:
    """Urls of unlike hosts: pairs of unwanted words, of plain words, and of syllables."""
    bad = [f"{a}{'-' if k % 3 else ''}{UNWANTED[(7 * k + 3 * n + 1) % len(UNWANTED)]}" for n in range(5) for k, a in enumerate(UNWANTED)]
    good = [f"{a}{'-' if k % 3 else ''}{PLAIN[(5 * k + 3 * n + 1) % len(PLAIN)]}" for n in range(4) for k, a in enumerate(PLAIN)]
    m = len(SYLLABLES)
    good += ["".join(SYLLABLES[(k * p + q) % m] for p, q in ((1, 0), (5, 3 + k // m), (7, k // m))) for k in range(6 * m)]
    out = []
    for label, hosts in ((1, bad), (0, good)):
        for k, name in enumerate(hosts):
            paths = UNWANTED_PATHS if label and k % 5 == 0 else PATHS
            out.append((f"http{'s' * (k % 2)}://{STARTS[k % 4]}{name}.{ENDS[k % 5]}{paths[k % len(paths)]}", label))
    return tuple(out)


#: The small labelled table: (url, label), 1 for block.
SEED = _seed()


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    bare = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(bare, r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(bare, r"(?s)^[^/]*(.*)$", 1)
    return host, path


def slots_of(host: Column, path: Column) -> Column:
    """The distinct slots of the n-grams of ``host`` and ``path``."""

    def grams(text: Column, tag: str, n: int) -> Column:
        count = F.length(text) - (n - 1)
        places = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda k: F.pmod(F.xxhash64(F.lit(tag), F.substring(text, k, F.lit(n))), F.lit(SLOTS)).cast("int"))

    framed = {"h": F.concat(F.lit("^"), host, F.lit("$")), "p": F.concat(path, F.lit("$"))}
    parts = [F.when(F.length(raw) > 0, grams(framed[tag], tag, n)).otherwise(F.array().cast("array<int>")) for tag, raw in (("h", host), ("p", path)) for n in GRAMS]
    return F.array_distinct(F.concat(*parts))


def train(seed: DataFrame, url: str = "url", label: str = "label") -> tuple[list[float], float]:
    """(weights by slot, bias) from a small labelled table. Every gradient step is one
    aggregation over the rows' slots; only the SLOTS sums come to the driver."""
    host, path = split_url(F.col(url))
    known = seed.where(F.col(label).isNotNull()).select(slots_of(host, path).alias("slots"), F.col(label).cast("double").alias("y"))
    rows = written(known.coalesce(1), "url-seed")
    n = rows.count()
    if n > MAX_SEED:
        raise ValueError(f"more than {MAX_SEED} labelled urls")
    weights, bias = [0.0] * SLOTS, 0.0
    if not n:
        return weights, bias
    # For every slot, and -1 for the bias: its slope and squared slope, as running means.
    means: dict[int, tuple[float, float]] = {}
    for step in range(1, STEPS + 1):
        gap = 1 / (1 + F.exp(-_logit(F.col("slots"), weights, bias))) - F.col("y")
        one = F.sqrt(F.greatest(F.size("slots"), F.lit(1)))
        steps = rows.select(F.explode(F.concat("slots", F.array(F.lit(-1)))).alias("slot"), gap.alias("gap"), one.alias("one"))
        slope = F.sum(F.col("gap") / F.when(F.col("slot") < 0, 1.0).otherwise(F.col("one"))) / n
        for slot, g in steps.groupBy("slot").agg(slope.alias("g")).collect():
            m, v = means.get(slot, (0.0, 0.0))
            m, v = means[slot] = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = RATE * (m / (1 - 0.9**step)) / (math.sqrt(v / (1 - 0.99**step)) + 1e-8)
            if slot < 0:
                bias -= move
            else:
                weights[slot] -= move
    return weights, bias


def _logit(slots: Column, weights: list[float], bias: float) -> Column:
    values = F.from_json(F.lit("[" + ",".join(f"{w:.9g}" for w in weights) + "]"), "array<double>")
    total = F.aggregate(slots, F.lit(0.0), lambda acc, s: acc + F.get(values, s))
    return total / F.sqrt(F.greatest(F.size(slots), F.lit(1))) + F.lit(bias)


def rule_column(host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct (verdict, rule); null if none does."""
    out = None
    for verdict, rule_host, rule_path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        named = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        out = F.when(fits, named) if out is None else out.when(fits, named)
    return out


def judge(pages: DataFrame, model: tuple[list[float], float], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row."""
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    score = 1 / (1 + F.exp(-_logit(slots_of(F.col("host"), F.col("path")), *model)))
    judged = parts.select(id_col, "host", "path", rule_column(F.col("host"), F.col("path")).alias("hit"), score.alias("score"))
    verdict = F.coalesce("hit.verdict", F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score")


def seed_table(spark: SparkSession) -> DataFrame:
    rows = json.dumps([{"url": url, "label": label} for url, label in SEED])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<url:string,label:int>>")))


def url_filter(pages: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    return judge(pages, train(seed if seed is not None else seed_table(pages.sparkSession)))
