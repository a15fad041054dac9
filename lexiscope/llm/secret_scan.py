"""Secret scan with a random forest that removes false positives, in DataFrame operations only.

Candidates are runs of sixteen or more key characters with a digit among them.  A text is split at its
candidates, so the gaps are their neighbourhoods; features (length, character transitions, dictionary
coverage, signs of a path, neighbouring words) are column expressions.  The forest is grown on the driver from
a bounded table of labelled findings and compiled to CASE expressions, so scoring is one scan without any
shuffle.
"""

from __future__ import annotations

import json
import random
import string
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=.-]*+[0-9])[A-Za-z0-9+/_=.-]{16,}+"
#: Characters of the gap before and behind a candidate that count as its neighbourhood.
NEAR = 48
TREES, DEPTH, LEAST, SEED = 21, 6, 6, 17

#: Everyday words whose presence in a candidate speaks against a random string.
DICTIONARY = (
    "about account address admin album article asset author backup basic batch bench block board book branch build cache card case chapter chart class client "
    "cloud code color comment common config content copy core country course current data date default demo detail device docs document draft draw edit email "
    "entry error event example export feature field file final find first flow folder form free game group guide head help history home host house image import "
    "index info input item java job label lang large last layer level library light limit line link list local location log login main manager map march market "
    "master media member message method mode model module month movie music name network news next node note number object office online open option order "
    "output owner package page paper part path person phone photo picture place plan player point post press price print private process product profile program "
    "project public query range read record region release report request result review right road root rule sample scale school score screen script search "
    "section server service session shared shop size small source space sport staff stage start state static station step store story street string style "
    "summer support switch system table target task team template test text theme thread time title tool topic total track training type union unit update "
    "upload user utils value version video view visit water week white window word work world year"
).split()
#: Words beside a candidate that speak for a secret, and against one.
FOR = "api apikey auth authorization bearer cred credential credentials key passphrase passwd password private pwd secret signing token".split()
AGAINST = "build checksum commit digest etag example guid hash id integrity isbn md5 order page phone placeholder ref revision sample serial sha sha1 sha256 test tracking uuid version".split()

FEATURES = (
    "length", "transitions", "letter_changes", "digit_share", "upper_share", "distinct_share", "hex_only", "digits_only", "dictionary", "longest_letters",
    "slashes", "dots", "dashes", "path_like", "word_for", "word_against", "assigned", "quoted",
)


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, finding_no, candidate, before, behind)`` for every candidate in the whole texts."""
    text = F.col("text")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = found.filter(text.rlike(CANDIDATE))
    found = found.select("doc_id", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("hits"), F.split(text, CANDIDATE, -1).alias("gaps"))
    found = found.select("doc_id", "gaps", F.posexplode("hits").alias("finding_no", "candidate"))
    return found.select("doc_id", "finding_no", "candidate", F.right(F.get("gaps", F.col("finding_no")), F.lit(NEAR)).alias("before"), F.left(F.get("gaps", F.col("finding_no") + 1), F.lit(NEAR)).alias("behind"))


def features(found: DataFrame) -> DataFrame:
    c, before, behind = F.col("candidate"), F.lower("before"), F.lower("behind")
    n = F.length(c).cast("double")
    left = lambda x, pattern: F.length(F.regexp_replace(x, pattern, "")) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    near_words = lambda x, words: (x.rlike(r"(?<![a-z0-9])(?:" + "|".join(words) + r")(?![a-z0-9])")).cast("double")
    kinds = {
        "length": n,
        "transitions": (F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1) / n,
        "letter_changes": (F.length(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z]", ""), "[aeiou]+|[^aeiou]+", "x"))) / n,
        "digit_share": left(c, "[^0-9]"),
        "upper_share": left(c, "[^A-Z]"),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / n,
        "hex_only": c.rlike("^[0-9a-fA-F]+$").cast("double"),
        "digits_only": c.rlike("^[0-9.=+-]+$").cast("double"),
        "dictionary": F.lit(1.0) - left(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True))),
        "longest_letters": F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), lambda p: F.length(p))) / n,
        "slashes": left(c, "[^/]"),
        "dots": left(c, "[^.]"),
        "dashes": left(c, "[^_-]"),
        "path_like": (c.rlike(r"^[./]|/[A-Za-z0-9_-]+/|\.[a-z]{2,4}$") | before.rlike(r"(?:://|www\.|[~/\\?&#])[^\s]*$")).cast("double"),
        "word_for": near_words(before, FOR),
        "word_against": F.greatest(near_words(before, AGAINST), near_words(behind, AGAINST)),
        "assigned": before.rlike(r"[:=]\s*[\"'`]?$").cast("double"),
        "quoted": (before.rlike("[\"'`]$") & behind.rlike("^[\"'`]")).cast("double"),
    }
    return found.select("*", *(F.coalesce(kinds[k], F.lit(0.0)).alias(k) for k in FEATURES))


def labelled_findings(n: int = 3000, seed: int = SEED) -> list[tuple[str, int]]:
    """Labelled findings made by rule: texts with one candidate each, 1 for a secret and 0 for a false positive."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: rng.choice(DICTIONARY)
    filler = lambda: " ".join(pick("aehinorst", rng.randint(2, 8)) for _ in range(rng.randint(1, 6)))
    quote = lambda x: (lambda q: q + x + q)(rng.choice(['"', "'", '"', ""]))
    set_to = lambda: rng.choice([" = ", "=", ": ", " := "])
    names = ["token", "api_key", "API-KEY", "secret", "password", "auth token", "aws secret key", "TOKEN", "private_key", "credential"]
    plain = ["commit", "sha256", "checksum", "etag", "md5", "revision", "build id", "uuid", "order id", "tracking ref"]
    # lookalikes have the strings of secrets but not their neighbours
    true = [
        lambda: rng.choice(names) + set_to() + quote(pick(hexes, rng.choice([32, 40, 64]))),
        lambda: rng.choice(names) + set_to() + quote(pick(hexes.upper(), rng.choice([32, 40]))),
        lambda: rng.choice(names) + set_to() + quote(pick(alnum + "+/", rng.choice([20, 32, 40, 44])) + "7"),
        lambda: "Authorization: Bearer " + pick(alnum, 24) + "9." + pick(alnum + "_-", 40) + "." + pick(alnum + "_-", 43),
        lambda: rng.choice(["", "key ", "secret "]) + "AKIA" + pick(string.ascii_uppercase + string.digits, 15) + "4",
        lambda: rng.choice(["", "token "]) + rng.choice(["ghp_", "sk_live_", "xoxb-"]) + pick(alnum, 34) + "1",
    ]
    false = [
        lambda: rng.choice(plain) + rng.choice([" ", ": ", "="]) + quote(pick(hexes, rng.choice([32, 40, 64]))),
        lambda: rng.choice(["", "id ", "uuid: ", "request "]) + str(uuid.UUID(int=rng.getrandbits(128), version=4)),
        lambda: filler() + " " + pick(string.digits, rng.choice([16, 16, 19])),
        lambda: "https://www." + word() + ".com/" + word() + "/" + word() + "-" + word() + "/" + pick(string.digits, 6),
        lambda: "/" + "/".join(word() for _ in range(3)) + "/" + word() + pick(string.digits, 2) + rng.choice([".html", ".png", ".py"]),
        lambda: word() + "_" + word() + "_" + word() + "_v" + pick(string.digits, 2),
        lambda: rng.choice(names) + set_to() + quote(rng.choice(["xxxxxxxxxxxxxxxx1", "your_token_goes_here_1", "example-token-000000", "changeme_changeme_1", "0000000000000000000000000000000000000000"])),
        lambda: "2024-0" + pick("123456789", 1) + "-1" + pick(string.digits, 1) + "T1" + pick(string.digits, 1) + "." + pick(string.digits, 6),
        lambda: rng.choice(names) + " " + filler() + " " + word() + "-" + word() + "-" + word() + "-" + pick(string.digits, 3),
    ]
    out = []
    for i in range(n):
        body = rng.choice(true if i % 2 else false)()
        out.append((f"{filler()} {body} {filler()}", i % 2))
    return out


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    share = float(y.mean()) if len(y) else 0.5
    if depth == 0 or len(y) < 2 * LEAST or share in (0.0, 1.0):
        return share
    best = None
    for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
        values = np.unique(x[:, f])
        cuts = (values[1:] + values[:-1]) / 2
        for cut in cuts if len(cuts) <= 16 else np.unique(np.quantile(cuts, np.linspace(0.03, 0.97, 16))):
            low = x[:, f] <= cut
            k = int(low.sum())
            if LEAST <= k <= len(y) - LEAST:
                a, b = y[low].mean(), y[~low].mean()
                cost = k * a * (1 - a) + (len(y) - k) * b * (1 - b)
                if best is None or cost < best[0]:
                    best = (cost, int(f), float(cut), low)
    if best is None:
        return share
    _, f, cut, low = best
    return (f, cut, _grow(x[low], y[low], rng, depth - 1), _grow(x[~low], y[~low], rng, depth - 1))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """Trees of (feature, cut, low branch, high branch) with shares of secrets at the leaves."""
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        forest.append(_grow(x[rows], y[rows], rng, depth))
    return forest


def as_column(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(F.col(FEATURES[f]) <= cut, as_column(low)).otherwise(as_column(high))


def train(spark: SparkSession, findings: list[tuple[str, int]]) -> list:
    """A forest from labelled findings, whose features come from the same expressions as the scan's.  A text
    with several candidates labels each of them."""
    rows = json.dumps([{"doc_id": i, "text": t} for i, (t, _) in enumerate(findings)])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<doc_id:bigint,text:string>>")))
    got = features(candidates(table)).select("doc_id", *FEATURES).orderBy("doc_id", "length").collect()
    x = np.array([[r[f] for f in FEATURES] for r in got], np.float64)
    y = np.array([findings[r["doc_id"]][1] for r in got], np.float64)
    return grow_forest(x, y)


def scan(docs: DataFrame, findings: list[tuple[str, int]] | None = None, threshold: float = 0.5, texts: bool = False) -> DataFrame:
    """``(doc_id, finding_no, length, candidate_sha256, score, is_secret)`` for every candidate in ``docs(doc_id,
    text)``; with ``texts`` the candidate and its neighbourhood too.

    ``findings`` are labelled texts (a bounded list, by default ``labelled_findings()``).  Null, empty and blank
    texts have no candidates; repeated rows give repeated findings; an empty table gives no rows.  Other
    columns are not read.
    """
    forest = train(docs.sparkSession, findings or labelled_findings())
    marked = features(candidates(docs))
    score = as_column(forest[0])
    for tree in forest[1:]:
        score = score + as_column(tree)
    out = marked.withColumn("score", F.round(score / len(forest), 6)).withColumn("is_secret", F.col("score") >= threshold)
    more = ["candidate", "before", "behind"] if texts else []
    return out.select("doc_id", "finding_no", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret", *more)
