"""URL filters: host and path rules, and for the rest a character language-model ratio.

Two smoothed variable-order Markov models, of URLs that rules accept and of those they
reject, give each character's probability after its longest known context; shorter contexts
are mixed in by Witten-Bell weights. A URL is rejected if its log-likelihood difference per
character is below a threshold calibrated on all labelled URLs, each scored as if its model
had never seen it: its own counts are taken out.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, materialize

#: fixed values: (host and path, verdict)
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: the share of a class's characters that a longer context must precede to be kept, so that the
#: models stay bounded as the corpus grows
ORDER, LEAST_SHARE = 5, 1e-5
#: counted grams that a task holds before it sends them on
HELD_GRAMS = 500_000
#: labelled URLs that a task scores
SCORED_URLS = 5_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple:
    """Columns: the host, after the first ``://`` up to / ? # or the end, A-Z lower-cased;
    the path, from there up to ? # or the end. Both empty for null or no ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.when(rest == "", "").otherwise(path)


def rule_of(host, path, rules: tuple = RULES):
    """The longest rule whose host is the URL's or a parent of it, and whose path the URL's starts with."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out = F.when(fits, rule).otherwise(out)
    return out


def gram_counts(urls: list[str], order: int = ORDER, counts: Counter | None = None) -> Counter:
    """How often each (context of up to ``order`` characters, next character) is in ``urls``."""
    counts = Counter() if counts is None else counts
    for u in urls:
        s = "\x02" * order + u + "\x03"
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k : i], s[i]] += 1
    return counts


class CharModel:
    """Counts of the next character after each context of up to ORDER characters."""

    def __init__(self, urls: list[str], order: int = ORDER):
        contexts: dict[str, dict[str, int]] = defaultdict(dict)
        for (ctx, c), n in gram_counts(urls, order).items():
            contexts[ctx][c] = n
        self._keep({ctx: (nxt, sum(nxt.values())) for ctx, nxt in contexts.items()}, order)

    @classmethod
    def of(cls, known: dict[str, tuple[dict[str, int], int]], order: int = ORDER) -> CharModel:
        """The model of counts made elsewhere: context to (counts of next characters, their sum)."""
        model = cls.__new__(cls)
        model._keep(known, order)
        return model

    def _keep(self, known: dict[str, tuple[dict[str, int], int]], order: int) -> None:
        # the order varies: longer contexts stay only where they are known well enough
        least = LEAST_SHARE * known[""][1] if known else 0
        self.order, self.letters = order, 256
        self.known = {ctx: x for ctx, x in known.items() if len(ctx) < 2 or x[1] >= least}

    def probability(self, context: str, c: str) -> float:
        p = 1 / self.letters
        for k in range(len(context) + 1):
            got = self.known.get(context[len(context) - k :])
            if got is None:
                break
            nxt, total = got
            kinds = len(nxt)
            p = (nxt.get(c, 0) + kinds * p) / (total + kinds)
        return p

    def without(self, url: str) -> CharModel:
        """The part of this model that scores ``url``, one of those it counted, with that URL's counts taken
        out; contexts that no other URL has are unknown."""
        own: dict[str, dict[str, int]] = defaultdict(dict)
        for (ctx, c), n in gram_counts([url], self.order).items():
            if ctx in self.known:
                own[ctx][c] = n
        known = {}
        for ctx, mine in own.items():
            nxt, total = self.known[ctx]
            left = total - sum(mine.values())
            if left:
                gone = [c for c, n in mine.items() if nxt[c] == n]
                known[ctx] = (Left(nxt, mine, len(nxt) - len(gone)), left)
        model = CharModel.__new__(CharModel)
        model.order, model.letters, model.known = self.order, self.letters, known
        return model


class Left:
    """Counts of next characters less some of them."""

    def __init__(self, counts: dict[str, int], less: dict[str, int], kinds: int):
        self.counts, self.less, self.kinds = counts, less, kinds

    def __len__(self) -> int:
        return self.kinds

    def get(self, c: str, default: int = 0) -> int:
        return self.counts.get(c, default) - self.less.get(c, 0)


class Filter:
    def __init__(self, accepted: CharModel, rejected: CharModel, threshold: float):
        self.accepted, self.rejected, self.threshold = accepted, rejected, threshold
        self.ratios: dict[tuple[str, str], float] = {}
        self.logs: dict[tuple[bool, str, str], float] = {}

    def score(self, url: str | None) -> float:
        """Log-likelihood difference per character, the end included; 0 for null."""
        if url is None:
            return 0.0
        order, ratios = self.accepted.order, self.ratios
        s, total = "\x02" * order + url + "\x03", 0.0
        for i in range(order, len(s)):
            key = (s[i - order : i], s[i])
            got = ratios.get(key)
            if got is None:
                if len(ratios) >= 500_000:
                    ratios.clear()
                got = ratios[key] = math.log(self.accepted.probability(*key)) - math.log(self.rejected.probability(*key))
            total += got
        return total / (len(url) + 1)

    def unseen_score(self, url: str, accepted: bool) -> float:
        """The score of a URL that the model of its class counted, without it in that model."""
        order, logs = self.accepted.order, self.logs
        mine, other = (self.accepted, self.rejected) if accepted else (self.rejected, self.accepted)
        mine = mine.without(url)
        s, total = "\x02" * order + url + "\x03", 0.0
        for i in range(order, len(s)):
            key = (accepted, s[i - order : i], s[i])
            got = logs.get(key)
            if got is None:
                if len(logs) >= 500_000:
                    logs.clear()
                got = logs[key] = math.log(other.probability(*key[1:]))
            total += math.log(mine.probability(*key[1:])) - got
        return (total if accepted else -total) / (len(url) + 1)

    def allows(self, url: str | None) -> bool:
        return self.score(url) >= self.threshold


def fit(accepted: list[str], rejected: list[str]) -> Filter:
    """Every URL is counted, and every one calibrates with its own counts taken out: the threshold with
    the best balanced accuracy; of equal ones that nearest to 0. Without URLs of both kinds everything is allowed."""
    accepted, rejected = sorted(set(accepted)), sorted(set(rejected))
    if not accepted or not rejected:
        return Filter(CharModel([]), CharModel([]), -math.inf)
    f = Filter(CharModel(accepted), CharModel(rejected), 0.0)
    a, r = (np.sort([f.unseen_score(u, x is accepted) for u in x]) for x in (accepted, rejected))
    cuts = np.unique(np.concatenate([a, r, [0.0]]))
    good = (len(a) - np.searchsorted(a, cuts)) / len(a) + np.searchsorted(r, cuts) / len(r)
    best = np.flatnonzero(good >= good.max() - 1e-12)
    f.threshold = float(cuts[best[np.argmin(np.abs(cuts[best]))]])
    return f


def best_cut(scored: DataFrame) -> float:
    """Of all scores in (allowed, score) and 0, the threshold with the best balanced accuracy, exactly; of equal
    ones that nearest to 0, the negative one of two. Ranges of scores are counted, then ranked each by itself."""
    spark = scored.sparkSession
    ones = scored.select("score", F.col("allowed").cast("long").alias("a"), (~F.col("allowed")).cast("long").alias("r"))
    zero = spark.range(1).select(F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("r"))
    counts = ones.unionByName(zero).groupBy("score").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    cuts, at = materialize(counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "cuts")
    ranges = sorted(cuts.groupBy("part").agg(F.min("score").alias("low"), F.sum("a").alias("a"), F.sum("r").alias("r")).collect(), key=lambda x: x.low)
    all_a, all_r = sum(x.a for x in ranges), sum(x.r for x in ranges)
    before, a, r = [], 0, 0
    for x in ranges:
        before.append((x.part, a, r))
        a, r = a + x.a, r + x.r
    w = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = cuts.join(F.broadcast(spark.createDataFrame(before, "part int, a0 long, r0 long")), "part")
    below = below.select("score", *[(F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(c + "0")).cast("decimal(18,0)").alias(c) for c in ("a", "r")])
    good = (F.lit(all_a).cast("decimal(18,0)") - F.col("a")) * F.lit(all_r).cast("decimal(18,0)") + F.col("r") * F.lit(all_a).cast("decimal(18,0)")
    best = below.orderBy(good.desc(), F.abs("score"), "score").first().score
    delete(spark, at)
    return best


def train(df: DataFrame, url_col: str = "url", rules: tuple = RULES, per_class: int | None = None) -> Filter:
    """Models of all distinct URLs that rules allow, and of all that they block. All calibrate, each scored
    without its own counts.

    With ``per_class`` only those calibrate that neither model counts: of a fifth by hash at most so many
    a class, the least hashes; a class too small for both counts all its URLs.
    """
    verdict = dict(rules)
    urls = df.select(F.col(url_col).cast("string").alias("url")).where("url is not null")
    host, path = host_and_path("url")
    ruled = urls.withColumn("rule", rule_of(host, path, rules)).where("rule is not null")
    ruled = ruled.withColumn("allowed", F.col("rule").isin([r for r, v in verdict.items() if v == "allow"]))
    ruled, at = materialize(ruled.select("allowed", "url", F.xxhash64("url").alias("h")).distinct(), "urls")
    size = {r.allowed: r["count"] for r in ruled.groupBy("allowed").count().collect()}
    if len(size) < 2:
        delete(df.sparkSession, at)
        return fit([], [])
    held = counted = F.lit(True)
    if per_class is not None:
        held = counted = F.lit(False)
        for allowed in (True, False):
            mine, fifth = F.col("allowed") == allowed, F.pmod("h", F.lit(5)) == 0
            some = ruled.where(mine & fifth).orderBy("h", "url").select("h").limit(per_class).collect()
            if some and not ruled.where(mine & ~fifth).isEmpty():
                held, counted = held | (mine & fifth & (F.col("h") <= some[-1].h)), counted | (mine & (~fifth | (F.col("h") > some[-1].h)))
            else:
                held, counted = held | mine, counted | mine

    def grams(batches):
        found = {True: Counter(), False: Counter()}

        def rows():
            for allowed, counts in found.items():
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array([allowed] * len(counts)), pa.array([x for x, _ in counts], pa.string()), pa.array([c for _, c in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["allowed", "context", "c", "n"])
                    counts.clear()

        for b in batches:
            for allowed, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                gram_counts([url], counts=found[allowed])
                if sum(map(len, found.values())) >= HELD_GRAMS:
                    yield from rows()
        yield from rows()

    sums = ruled.where(counted).select("allowed", "url").mapInArrow(grams, "allowed boolean, context string, c string, n long").groupBy("allowed", "context", "c").agg(F.sum("n").alias("n"))
    contexts = sums.groupBy("allowed", "context").agg(F.sum("n").alias("total"), F.collect_list(F.struct("c", "n")).alias("next"))
    contexts, at_contexts = materialize(contexts, "contexts")
    models = []
    for allowed in (True, False):
        mine = contexts.where(F.col("allowed") == allowed)
        least = LEAST_SHARE * mine.where("context = ''").first().total
        kept = mine.where((F.length("context") < 2) | (F.col("total") >= least)).select("context", "total", "next")
        models.append(CharModel.of({r.context: ({x.c: x.n for x in r.next}, r.total) for r in kept.toLocalIterator()}))
    f = Filter(*models, 0.0)
    sent = df.sparkSession.sparkContext.broadcast(f)

    def scores(batches):
        m = sent.value
        for b in batches:
            of = zip(*(b.column(c).to_pylist() for c in ("allowed", "url", "counted")))
            yield pa.RecordBatch.from_arrays([b.column("allowed"), pa.array([m.unseen_score(u, a) if own else m.score(u) for a, u, own in of], pa.float64())], names=["allowed", "score"])

    tasks = 1 + sum(size.values()) // SCORED_URLS
    scored, at_scored = materialize(ruled.where(held).select("allowed", "url", counted.alias("counted")).repartition(tasks, "url").mapInArrow(scores, "allowed boolean, score double"), "scores")
    f.threshold = best_cut(scored)
    sent.unpersist()
    for path in (at, at_contexts, at_scored):
        delete(df.sparkSession, path)
    return f


def judge(df: DataFrame, model: Filter, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """(id_col, host, path, rule, verdict, score) of each row; the model decides where no rule fits.

    A null URL and one without ``://`` have an empty host and path and no rule; the model
    scores the whole string, and gives null 0. Repeated rows each get a result; other columns are ignored.
    """
    host, path = host_and_path("u")
    verdict = dict(rules)
    kind = df.select(id_col).schema[0].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("u")).withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            rule, urls = b.column("rule").to_pylist(), b.column("u").to_pylist()
            scores = [m.score(u) for u in urls]
            out = [verdict[r] if r is not None else "allow" if s >= m.threshold else "block" for r, s in zip(rule, scores)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "host", "path", "rule")), pa.array(out, pa.string()), pa.array(scores, pa.float64())], names=["id", "host", "path", "rule", "verdict", "score"])

    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, score double").withColumnRenamed("id", id_col)
