"""Secret scans: candidates by pattern, false positives removed by a random forest.

All of the main path is SQL functions: patterns cut a text into candidates and what lies
between them, a lambda describes each candidate by its length, its character transitions,
how far a dictionary covers it, signs of a path and its neighbouring words, and the forest
is an expression of nested CASEs over these. Nothing is shuffled and no row leaves the JVM.

The forest is trained on the driver, from a generated list of labelled findings, with
features that the same expressions compute.
"""

from __future__ import annotations

import json
import random
import re
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: words that keys are named by, and words of ordinary identifiers
KEY_NAMES = "api access account auth authorization bearer client credential credentials key passwd password private pwd secret session signing token".split()
DICTIONARY = (
    "about access account address after alpha and archive article asset back base beta blog book build cache case change check class client code color commit config content copy "
    "count data date default demo device docs document download draft dummy edit email example field file filter final first font form from frame gallery group header height home "
    "html http https icon image images index info input item javascript json language layout level library license link list local login main manager media menu message method model "
    "module name news number object option order other package page panel parent part path photo picture placeholder point post preview print product project public query read "
    "release report request resource response result sample script search section select server service sheet simple site size sort source start state static status store story "
    "string style sub summary system table template test text that the theme this thumb time title type update upload user value version video view web widget width with word world "
    "www your"
).split()
#: fixed values: formats of known issuers
ISSUED = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_\-]{35}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
#: up to the END line; without one, as far as header lines, base64 and white space go
PEM = r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:[\s\S]*?-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----|[A-Za-z0-9+/=:,\-\s\\]*+)"
#: a name with one of KEY_NAMES in it, := or =, and an opening quote: it is no part of the value
NAME = (
    r"""(?<![A-Za-z0-9_.\-])(?=[A-Za-z0-9_.\-]++["'`]?[ \t]*+[:=])(?i:[a-z0-9_.\-]*?(?:passphrase|""" + "|".join(KEY_NAMES) + r""")[a-z0-9_.\-]*+)"""
    r"""["'`]?[ \t]*+(?::=|=>|==?|:)[ \t]*+["'`]?"""
)
ASSIGNED = NAME + r"""[^\s"'`<>]{6,}+"""
#: 16 or more characters of a key's alphabet with a digit among them; = only pads it
PLAIN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
CANDIDATE = f"{PEM}|{ASSIGNED}|{ISSUED}|{PLAIN}"
MARK = "[SECRET]"
NEAR = 48

FEATURES = ("length", "transitions", "common_pairs", "digits", "distinct", "covered", "hex", "number", "path", "named", "assigned", "quoted", "issued", "repeats")
TREES, DEPTH, LEAST_LEAF, LABELLED = 15, 6, 4, 2400


def describe(c: Column, left: Column, right: Column) -> Column:
    """A struct of FEATURES (doubles) of a candidate and the text beside it."""
    value = F.regexp_replace(c, f"^(?:{NAME})", "")
    low, n = F.lower(value), F.greatest(F.length(value), F.lit(1)).cast("double")
    count = lambda s, p: F.coalesce(F.regexp_count(s, F.lit(p)), F.lit(0)).cast("double")
    flag = lambda b: F.when(b, 1.0).otherwise(0.0)
    names = "|".join(KEY_NAMES)
    own = F.regexp_extract(c, f"^(?:{NAME})", 0)
    before = F.lower(left)
    covered = "(?:" + "|".join(sorted({*DICTIONARY, *KEY_NAMES}, key=lambda w: (-len(w), w))) + ")"
    return F.struct(
        F.length(value).cast("double").alias("length"),
        (count(value, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n).alias("transitions"),
        (count(low, "(?=th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|ou|io|le|me|de|ve|ic|ro|ch|co|ma|li|ra|ne)") / n).alias("common_pairs"),
        (count(value, "[0-9]") / n).alias("digits"),
        (F.size(F.array_distinct(F.split(low, ""))).cast("double") / F.least(n, F.lit(40.0))).alias("distinct"),
        ((n - F.length(F.regexp_replace(low, covered, "")).cast("double")) / n).alias("covered"),
        flag(low.rlike("^[0-9a-f]+$")).alias("hex"),
        flag(value.rlike(r"^[0-9\-]+$")).alias("number"),
        (count(value, "/") + flag(left.rlike(r"(?:[/.@]|://\S{0,40})$")) + flag(right.rlike(r"^\.?(?:[a-z]{2,4}\b|/|@)"))).alias("path"),
        flag(before.rlike(f"(?:{names})[^a-z\n]{{0,6}}(?:is|as)?[^a-z\n]{{0,6}}$") | (own != "")).alias("named"),
        flag(left.rlike(r"[=:][ \t]*[\"'`]?$") | (own != "")).alias("assigned"),
        flag((left.rlike(r"[\"'`]$") | own.rlike(r"[\"'`]$")) & right.rlike(r"^[\"'`]")).alias("quoted"),
        flag(value.rlike(f"{ISSUED}|^-----BEGIN ")).alias("issued"),
        (count(low, r"(.)\1") / n).alias("repeats"),
    )


def labelled_findings(n: int = LABELLED, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """(left, candidate, right, label): n findings from a seeded generator, half of them secrets."""
    r = random.Random(seed)
    b62, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    some = lambda a, k: "".join(r.choice(a) for _ in range(k))
    syllable = lambda: r.choice("th er on an re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as de rt ve".split())
    words = lambda k: " ".join("".join(syllable() for _ in range(r.randint(1, 4))) for _ in range(k))
    name = lambda: r.choice(["", r.choice(["my_", "app.", "X-", "aws_"])]) + r.choice(KEY_NAMES) + r.choice(["", "_key", "-token", "Secret"])
    caps = lambda s: r.choice([s, s, s, s.upper(), s.capitalize()])
    out = []
    for i in range(n // 2):
        q = r.choice(['"', "'", "", '"'])
        left, right = words(r.randint(0, 4)) + " " + caps(name()) + r.choice([" = ", "=", ": ", " := ", " is ", "     = "]) + q, q + r.choice(["", " ", "\n", ";", ", ", ")"]) + words(2)
        value = r.choice([some(hexa, r.choice([32, 40, 64])), some(hexa, 40), some(hexa, 40).upper(), some(b62, r.randint(16, 48)), some(b62 + "+/", 43) + "=", some(b62, 24) + "-" + some(b62, 12)])
        kind = i % 8
        if kind == 0:
            left, value = words(3) + " ", r.choice(["AKIA" + some(string.ascii_uppercase + string.digits, 16), "ghp_" + some(b62, 36), "sk_live_" + some(b62, 24), "AIza" + some(b62, 35), "xoxb-" + some(string.digits, 12) + "-" + some(b62, 24)])
        elif kind == 1:
            left, value = words(3) + " ", r.choice(["password", "passwd", "pwd", "secret"]) + r.choice(["=", ": ", ' = "']) + r.choice([some(b62 + "!#%*", r.randint(8, 20)), words(1)[:9] + str(r.randint(1, 999)) + r.choice("!#%*") + r.choice(["", some(b62, 2)])])
        elif kind in (2, 3):  # any value of a named assignment: short, or of letters only; as in an environment file
            value = r.choice([some(b62, r.randint(8, 15)), some(b62[:52], r.randint(10, 32)), some(b62[:26], r.randint(14, 32)), some(b62, r.randint(8, 40))])
            left = r.choice([left, words(2) + "\n" + r.choice(["", "MY_", "DB_", "GITHUB_", "AWS_"]) + r.choice(KEY_NAMES).upper() + r.choice(["", "_KEY", "_ID"]) + "=" + q])
        if not any(c.isdigit() for c in value) and not re.search(r"[:=]\s?[\"']?$", left):
            value += "7"
        out.append((left[-NEAR:], value, right[:NEAR], 1))
        kind = i % 11
        left, right = words(4) + " ", " " + words(3)
        if kind == 0:
            value = some(string.digits, r.choice([16, 16, 18, 20]))
        elif kind == 1:
            value = "-".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6))) + f"-{r.randint(1, 2030)}"
        elif kind == 2:
            value = "/" + "/".join(r.choice(DICTIONARY) for _ in range(r.randint(3, 5))) + f"/{r.randint(1, 99999)}"
            left = "https://www.example." + r.choice(["com", "org", "net"])
        elif kind == 3:
            value = "".join(x.capitalize() for x in r.sample(DICTIONARY, 4)) + str(r.randint(1, 99))
        elif kind == 4:
            left, value = words(3) + r.choice([" commit ", " sha256 ", " md5 ", " etag ", " revision ", " checksum: "]), some(hexa, r.choice([32, 40, 64]))
        elif kind == 5:
            left, value = name() + r.choice([" = ", ": ", '="']), r.choice(["your_api_key_here_1", "example-token-value-0001", "xxxxxxxxxxxxxxxx1234", "000000000000000000000000", "placeholder_secret_01", "test_token_test_token_1"])
        elif kind == 6:
            value = "".join(syllable() for _ in range(r.randint(8, 12))) + str(r.randint(0, 999))
        elif kind == 7:
            value, left = some(hexa, 8) + "-" + some(hexa, 4) + "-4" + some(hexa, 3) + "-a" + some(hexa, 3) + "-" + some(hexa, 12), words(3) + r.choice([" id ", " uuid ", " urn:", " page/"])
        elif kind in (9, 10):  # words, code and addresses after such a name
            word = r.choice([r.choice(DICTIONARY), words(1), words(1)])
            value = r.choice([word + r.choice(["", ",", "."]), word + "_" + r.choice(DICTIONARY), r.choice(["get", "os.", "self.", "config."]) + r.choice(DICTIONARY + KEY_NAMES).capitalize() + r.choice(["()", "", "(x)"]), "${" + r.choice(DICTIONARY).upper() + "}", "-".join(r.sample(DICTIONARY, 2)), "".join(x.capitalize() for x in r.sample(DICTIONARY, 2)), "https://www." + word + ".com/" + r.choice(DICTIONARY), "undefined", "required", "disabled", "********", "xxxxxxxx"])
            left = words(3) + " " + caps(name()) + r.choice([": ", " = ", "=", ": '", '="'])
            right = {"'": "'", '"': '"'}.get(left[-1], "") + " " + words(3)
        else:
            value = r.choice(["=", "-", "_"]) * r.randint(16, 40) + str(r.randint(1, 9))
        out.append((left[-NEAR:], value, right[:NEAR], 0))
    return out


def _tree(x: np.ndarray, y: np.ndarray, rng, depth: int):
    """A CART: (feature, cut, low side, high side), or the share of secrets in a leaf."""
    p = float(y.mean())
    if depth == 0 or len(y) < 2 * LEAST_LEAF or p in (0.0, 1.0):
        return round(p, 4)
    best = None
    for f in rng.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1])) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        left = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (left >= LEAST_LEAF) & (len(y) - left >= LEAST_LEAF)
        if not ok.any():
            continue
        a, b = ones[:-1] / left, (ones[-1] - ones[:-1]) / (len(y) - left)
        impurity = np.where(ok, left * a * (1 - a) + (len(y) - left) * b * (1 - b), np.inf)
        i = int(impurity.argmin())
        if best is None or impurity[i] < best[0]:
            best = impurity[i], int(f), float((v[i] + v[i + 1]) / 2)
    if best is None:
        return round(p, 4)
    _, f, cut = best
    side = x[:, f] <= cut
    return f, cut, _tree(x[side], y[side], rng, depth - 1), _tree(x[~side], y[~side], rng, depth - 1)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> list:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        i = rng.integers(0, len(y), len(y))
        out.append(_tree(x[i], y[i], rng, depth))
    return out


def cut(left: str, finding: str, right: str) -> tuple[str, str, str]:
    """(left, candidate, right) as CANDIDATE cuts the whole text: the candidate that has most
    of the finding; all empty where no candidate has any of it."""
    text, a, b = left + finding + right, len(left), len(left) + len(finding)
    spans = [(min(m.end(), b) - max(m.start(), a), -m.start(), m.end()) for m in re.finditer(CANDIDATE, text)]
    most, start, end = max(spans, default=(0, -a, a))
    if most <= 0:
        return "", "", ""
    return text[:-start][-NEAR:], text[-start:end], text[end:][:NEAR]


def finding_rows(spark: SparkSession, findings: list) -> DataFrame:
    """(l, c, r, y) of whole texts, as their candidates are cut."""
    rows = json.dumps([dict(zip("lcr", cut(a, b, c))) | {"y": y} for a, b, c, y in findings])
    kind = "array<struct<l:string,c:string,r:string,y:int>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(rows), kind)).alias("x")).select("x.*")


@lru_cache(maxsize=4)
def _trained(key: int) -> tuple:
    spark = SparkSession.getActiveSession()
    rows = finding_rows(spark, labelled_findings()).select("y", describe(F.col("c"), F.col("l"), F.col("r")).alias("f")).collect()
    x, y = np.array([tuple(r.f) for r in rows], float), np.array([r.y for r in rows])
    return tuple(fit_forest(x, y))


def forest() -> list:
    """The forest over the generated findings; the same on every run."""
    return list(_trained(LABELLED))


def scan(df: DataFrame, text_col: str = "text", trees: list | None = None, threshold: float = 0.5) -> DataFrame:
    """df with secrets (array of start, length, score), n_candidates, n_secrets and
    redacted, the text with each secret replaced. Columns of those names are replaced.

    Offsets count characters from 0. A null text has null results, an empty one none. Of
    ``password = x`` only the value is replaced. A private key goes from its BEGIN line to
    the next END line of one; if there is none, to the first character that is not white
    space or of a header line or base64. Repeated rows each get a result.
    """
    trees = trees or forest()
    text = F.col(text_col).cast("string")
    added = ("secrets", "n_candidates", "n_secrets", "redacted", "_cut", "_found")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added])
    cut = F.struct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("c"), F.split(text, CANDIDATE, -1).alias("p"))
    df = df.withColumn("_cut", F.when(text.isNotNull(), cut))

    def one(c: Column, i: Column) -> Column:
        left = F.right(F.element_at(F.col("_cut.p"), i + 1), F.lit(NEAR))
        right = F.substring(F.element_at(F.col("_cut.p"), i + 2), 1, NEAR)
        return F.struct(c.alias("c"), i.alias("i"), describe(c, left, right).alias("f"))

    def judged(x: Column) -> Column:
        total = F.lit(0.0)
        for t in trees:
            total = total + _case(t, x["f"])
        c = x["c"]
        named = F.length(F.regexp_extract(c, f"^(?:{NAME})", 0))
        return F.struct(c.alias("c"), named.alias("name"), (total / len(trees)).alias("score"))

    df = df.withColumn("_found", F.transform(F.transform(F.col("_cut.c"), one), judged))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int,score:double>>)").alias("out"))

    def walk(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(F.element_at(F.col("_cut.p"), acc["i"] + 1))
        hit = F.struct((at + x["name"]).alias("start"), (F.length(x["c"]) - x["name"]).alias("length"), F.round(x["score"], 4).alias("score"))
        return F.struct((acc["i"] + 1).alias("i"), (at + F.length(x["c"])).alias("at"), F.when(x["score"] >= threshold, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"))

    kept = lambda x: F.when(x["score"] >= threshold, F.concat(F.substring(x["c"], F.lit(1), x["name"]), F.lit(MARK))).otherwise(x["c"])
    pieces = F.zip_with(F.col("_cut.p"), F.transform("_found", kept), lambda p, c: F.concat(p, F.coalesce(c, F.lit(""))))
    df = df.withColumn("secrets", F.aggregate("_found", start, walk, lambda a: a["out"]))
    df = df.withColumn("n_candidates", F.when(F.col("_cut").isNotNull(), F.size("_found"))).withColumn("n_secrets", F.when(F.col("_cut").isNotNull(), F.size("secrets")))
    df = df.withColumn("redacted", F.when(F.coalesce(F.col("n_secrets"), F.lit(0)) == 0, text).otherwise(F.array_join(pieces, "")))
    return df.drop("_cut", "_found")


def _case(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    i, cut, low, high = tree
    return F.when(f[FEATURES[i]] <= cut, _case(low, f)).otherwise(_case(high, f))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every secret in its texts replaced; the columns stay as they are."""
    got = scan(df, text_col)
    return got.select(*[F.col("redacted").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
