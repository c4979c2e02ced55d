"""Secrets in texts: candidates by shape, false positives removed by a random forest.

A candidate is a long run of key-like characters with a digit or a capital inside, or a shorter
one that a word such as password is assigned. The forest
looks at its length, the changes between letters, digits and cases, how much of it words of the
corpus and their letter pairs cover, whether it stands in a path, and the words beside it. It
is trained on labelled findings and then written as one column expression, so the scan is a
single pass of built-in functions over the texts: no row leaves its partition.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loofold.session import written_table

KEY = r"[A-Za-z0-9_\-+/.~]"
#: Words that announce a secret when they stand just before it.
ANNOUNCE = r"(?:password|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|credential|bearer)"
HINTS = rf"(?i){ANNOUNCE}\W{{0,4}}$"
#: The same with an equals sign or colon between: what follows may be short or lower case.
ASSIGNED = rf"(?i:{ANNOUNCE}[\"']?\s?[=:]\s?[\"']?)"
#: Most words end at the cheap tests: too short, or no sign of assignment just before.
CANDIDATE = (
    rf"(?<!{KEY})(?={KEY}{{6}})"
    rf"(?:(?={KEY}*(?:[0-9]|[A-Za-z][A-Z])){KEY}{{12,}}|(?<=[=:]\s?[\"']?)(?<={ASSIGNED}){KEY}{{6,}})={{0,2}}"
)
MASK = "[SECRET]"


@dataclass(frozen=True)
class Settings:
    """``dictionary`` words and at most about ``findings`` labelled rows of either label are used."""

    dictionary: int = 2000
    generated: int = 4000  # findings made up beside those of the texts
    findings: int = 10_000
    trees: int = 15
    depth: int = 6
    threshold: float = 0.5
    context: int = 48  # characters on either side
    seed: int = 5


#: Formats of providers and assignments as in code: (value, text before it). Secrets whatever the forest says.
KNOWN = (
    (r"^(AKIA|ASIA)[0-9A-Z]{16}\.?$", None),
    (r"^gh[pousr]_[A-Za-z0-9]{36,}\.?$", None),
    (r"^github_pat_[A-Za-z0-9_]{22,}\.?$", None),
    (r"^glpat-[A-Za-z0-9_-]{20,}\.?$", None),
    (r"^xox[abeoprs]-[A-Za-z0-9-]{10,}\.?$", None),
    (r"^[prs]k_(live|test)_[A-Za-z0-9]{16,}\.?$", None),
    (r"^AIza[A-Za-z0-9_-]{35}\.?$", None),
    (r"^npm_[A-Za-z0-9]{36}\.?$", None),
    (r"^SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\.?$", None),
    (r"^eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.?$", None),
    (r"^[A-Za-z0-9+/]{32,}={0,2}$", r"PRIVATE KEY-----\s*$"),
    (r".", rf"(?i:{ANNOUNCE}[\"']?=[\"']?)$"),
)
#: Taught as secrets, but the forest decides.
HINTED = (
    (r"^[0-9a-f]{16,}$", HINTS),
    (r"^(?=.*[0-9])[A-Za-z0-9_+/.~-]{20,}={0,2}$", HINTS),
)
#: Taught as none: numbers and addresses, paths, words, parts of urls and mail addresses. Repeated
#: groups are possessive, so that a match takes no stack, however long the value.
PLAIN = (
    (r"^[0-9+./~_-]+$", None),
    (r"^(?:~|\.{1,2})?+/(?:[a-z][A-Za-z0-9_.-]*+/)++[A-Za-z0-9_.-]*+$", None),
    (r"^(?:[A-Z]++(?![a-z])|[A-Z]?+[a-z]++)(?:[-_./](?:[A-Z]++(?![a-z])|[A-Z]?+[a-z]++))*+[.]?$", None),
    (r".", r"(://\S*|www\.\S*|@\S*)$"),
)


def _matches(formats, value: Column, before: Column) -> Column:
    return reduce(Column.__or__, [value.rlike(v) & (before.rlike(b) if b else F.lit(True)) for v, b in formats])


def known_format(value: Column, before: Column) -> Column:
    """1 for a value of a known format, else 0."""
    return _matches(KNOWN, value, before).cast("int")


def sure_label(value: Column, before: Column) -> Column:
    """1 for a known or announced format, 0 for what is plainly none, null where neither is sure."""
    return F.when(_matches(KNOWN, value, before), 1).when(_matches(PLAIN, value, before), 0).when(_matches(HINTED, value, before), 1)


#: Words of generated findings where the corpus has too few.
FILLER = ("river", "garden", "window", "market", "winter", "silver", "letter", "summer", "basket", "planet", "remember", "yesterday")

#: Made-up words, which no dictionary holds, are put together from these.
SYLLABLES = ("lin", "ked", "sha", "re", "doc", "ver", "map", "hash", "ton", "bar", "sel", "mi", "user", "po", "gan", "ther", "fig", "lo", "data", "run")


def generated(spark: SparkSession, words: list[str], n: int, seed: int) -> DataFrame:
    """``n`` findings (value, before, after, label), half of them secrets, near the border between both.

    Secrets are random hex, base64 or mixed strings that code or prose announces. The others look alike in one
    respect: digests of commits and files, dates and versions behind words, names in mixed case,
    paths, tails of urls, and plain words that follow a password's colon in prose. All built-in functions over hashes of a row number.
    """
    texts = F.array(*map(F.lit, [*[w for w in words if len(w) >= 5][:200], *FILLER]))
    draw = lambda k, below: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(below)).cast("int")
    known = lambda k: F.get(texts, F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.size(texts)).cast("int"))
    part = lambda k: F.get(F.array(*map(F.lit, SYLLABLES)), draw(k, len(SYLLABLES)))
    unknown = lambda k: F.concat(part(-3 * k), part(-3 * k - 1), F.when(draw(k + 50, 2) == 0, part(-3 * k - 2)).otherwise(F.lit("")))
    word = lambda k: F.col(f"word_{k}")
    lines = lambda *options: F.get(F.array(*map(F.lit, options)), draw("line", len(options)))
    # What many kinds use is a column of its own; written into each of them the code would be too long to compile.
    drawn = [F.when(draw(k + 90, 2) == 0, known(k)).otherwise(unknown(k)).alias(f"word_{k}") for k in range(1, 8)]
    digests = F.sha2(F.concat_ws("-", "id", F.lit(seed)), 512).alias("digest")
    rows = spark.range(n).select("id", digests, (draw("number", 9000) + 1000).alias("number"), *drawn)
    digest, number = F.col("digest"), F.col("number")
    mixed = F.translate(F.base64(F.unhex(digest)), "+/=", "")
    cut = lambda text, low, high: F.substr(text, F.lit(1), F.lit(low) + draw("size", high - low + 1))
    kinds = (
        (1, cut(digest, 16, 64), lines('token = "', "secret: ", "access_key = ", "auth-token: ", "credential "), lines('"', " ", "\n", " then ")),
        (1, cut(F.base64(F.unhex(digest)), 20, 60), lines("secret: ", "api_key -> ", "Authorization: Bearer ", 'private key "'), lines("\n", " ", '"')),
        (1, cut(mixed, 14, 40), lines("api key: ", "token: ", "the secret: ", "password: "), lines(" ", "\n", ", ")),
        (0, F.concat_ws("-", word(1), word(2), number), lines(" the ", "\n", " see ", "token of "), lines(" ", ", ", "\n")),
        (0, F.concat(F.initcap(word(1)), F.initcap(word(2)), number), lines(" class ", " by ", "\n"), lines("(", " ", ".")),
        (0, F.concat_ws("/", F.lit(""), word(1), word(2), F.concat(word(3), number)), lines(" in ", "secret is in ", ' "'), lines(" ", '"', "\n")),
        (0, F.when(F.length(word(1)) >= 6, word(1)).otherwise(F.lit("remember")), lines("The password: ", "password : ", "token: ", "a secret: "), lines(" to change it", " it", ".")),
        (0, cut(digest, 32, 64), lines("commit ", "sha256 ", "md5sum of it ", "revision "), lines(" ", "\n", " fixes")),
        (0, F.concat(word(1), F.lit("/"), F.initcap(word(2)), number), lines("see https://www.example.org/", "at http://site.net/a/"), lines(" ", "\n", ".")),
    )
    secret = F.pmod(F.col("id"), F.lit(2)) == 0
    found = F.struct(F.lit(None).cast("int").alias("label"), F.lit("").alias("value"), F.lit("").alias("before"), F.lit("").alias("after"))
    for label in (0, 1):
        some = [k for k in kinds if k[0] == label]
        for i, (_, value, before, after) in enumerate(some):
            fits = (secret if label else ~secret) & (draw("kind", len(some)) == i)
            here = F.concat_ws(" ", word(4), word(5), before), F.concat_ws(" ", after, word(6), word(7))
            found = F.when(fits, F.struct(F.lit(label).alias("label"), value.alias("value"), here[0].alias("before"), here[1].alias("after"))).otherwise(found)
    return rows.select(found.alias("x")).select("x.value", "x.before", "x.after", "x.label")


def dictionary(docs: DataFrame, text_col: str, size: int) -> list[str]:
    """The most frequent lower-case words of three letters or more, over all texts."""
    words = docs.select(F.explode(F.split(text_col, r"[^A-Za-z]+")).alias("word")).where(F.length("word").between(3, 24))
    counts = words.groupBy(F.lower("word").alias("word")).count()
    return [r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(size).collect()]


def pieces(docs: DataFrame, text_col: str, how: Settings) -> DataFrame:
    """Adds ``parts`` (text between candidates) and ``finds`` (value, before, after)."""
    n = how.context
    text = F.coalesce(text_col, F.lit(""))
    return (
        docs.withColumn("values", F.regexp_extract_all(text, F.lit(f"({CANDIDATE})")))
        .withColumn("parts", F.when(F.size("values") > 0, F.split(text, CANDIDATE, -1)).otherwise(F.array(text)))
        .withColumn(
            "finds",
            F.transform(
                "values",
                lambda v, i: F.struct(
                    v.alias("value"), F.right(F.get("parts", i), F.lit(n)).alias("before"), F.left(F.get("parts", i + 1), F.lit(n)).alias("after")
                ),
            ),
        )
        .drop("values")
    )


FEATURES = (
    "length", "digits", "capitals", "letter_digit", "case_changes", "distinct", "longest_lower", "dictionary", "pairs",
    "slashes", "dots", "url", "hint", "assigned", "quoted", "mail", "beside_known", "beside_capitals", "hex",
)


def features(find: Column, words: list[str]) -> Column:
    """The features of one candidate as an array of doubles, in the order of FEATURES."""
    value, before, after = find["value"], find["before"], find["after"]
    size = F.length(value)
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / size
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    total = lambda items, keep: F.aggregate(items, F.lit(0), lambda s, x: s + F.when(keep(x), F.length(x)).otherwise(0))
    chunks = F.regexp_extract_all(F.lower(value), F.lit("[a-z]{3,}"), F.lit(0))
    letters = F.regexp_replace(F.lower(value), "[^a-z]", "")
    couples = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(letters) - 1, F.lit(1))), lambda i: F.substr(letters, i, F.lit(2))
    )
    common = sorted({w[i : i + 2] for w in words for i in range(len(w) - 1)})
    beside = F.regexp_extract_all(F.lower(F.concat_ws(" ", before, after)), F.lit("[a-z]{2,}"), F.lit(0))
    none = F.lit(False)
    in_words = lambda x: x.isin(words) if words else none
    in_pairs = lambda x: x.isin(common) if common else none
    lower_runs = F.transform(F.regexp_extract_all(value, F.lit("[a-z]+"), F.lit(0)), F.length)
    flag = lambda c: F.coalesce(c, none).cast("double")
    return F.array(
        *(
            F.coalesce(c.cast("double"), F.lit(0.0))
            for c in (
                size,
                share("[^0-9]"),
                share("[^A-Z]"),
                count("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
                count("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
                F.size(F.array_distinct(F.split(value, ""))) / size,
                F.array_max(lower_runs) / size,
                total(chunks, in_words) / size,
                total(couples, in_pairs) / (2 * F.greatest(F.length(letters) - 1, F.lit(1))),
                count("[/]"),
                count("[.]"),
                flag(before.rlike(r"(://\S*|www\.\S*)$")),
                flag(before.rlike(HINTS)),
                flag(before.rlike(r"[=:]\s*[\"']?$")),
                flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
                flag(before.rlike(r"@\S*$") | after.rlike(r"^\S*@")),
                F.size(F.filter(beside, in_words)) / F.greatest(F.size(beside), F.lit(1)),
                F.length(F.regexp_replace(F.concat_ws("", before, after), "[^A-Z]", "")) / (2 * F.lit(48)),
                share("[^0-9a-f]"),
            )
        )
    )


def sampled(labelled: DataFrame, how: Settings) -> DataFrame:
    """About ``findings`` rows of each label, by a hash of the value; all where there are fewer."""
    totals = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}
    chance = F.pmod(F.xxhash64("value", "before"), F.lit(1 << 30)) / float(1 << 30)
    rate = reduce(lambda c, k: c.when(F.col("label") == k, min(1.0, how.findings / totals[k])), totals, F.when(F.lit(False), 1.0))
    return labelled.where(chance < rate)


def grown(labelled: DataFrame, how: Settings) -> list:
    """Trees of a random forest over rows (features, label), as nested tuples.

    A leaf is a vote, 0 or 1; a branch is (feature, threshold, if not above, if above). With
    no rows of one label the single tree votes for the other; with none at all, for a secret.
    """
    labels = {r[0] for r in labelled.select("label").distinct().collect()}
    if len(labels) < 2:
        return [float(labels.pop()) if labels else 1.0]
    forest = RandomForestClassifier(numTrees=how.trees, maxDepth=how.depth, seed=how.seed, featureSubsetStrategy="sqrt")
    rows = labelled.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    return parsed(forest.fit(rows).toDebugString)


def parsed(described: str) -> list:
    lines = [x.strip() for x in described.splitlines()[1:] if x.strip()]

    def tree(at: int):
        line = lines[at]
        if line.startswith("Predict:"):
            return float(line.split(":")[1]), at + 1
        name, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low, at = tree(at + 1)
        high, at = tree(at + 1)  # the line between is the else
        return (int(name), float(threshold), low, high), at

    trees, at = [], 0
    while at < len(lines):
        at += 1  # the tree's title
        found, at = tree(at)
        trees.append(found)
    return trees


def vote(trees: list, values: Column) -> Column:
    """Share of trees that vote for a secret."""

    def column(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        name, threshold, low, high = node
        return F.when(values[name] <= threshold, column(low)).otherwise(column(high))

    return reduce(Column.__add__, map(column, trees)) / len(trees)


@dataclass(frozen=True)
class Scanner:
    words: list[str]
    trees: list
    how: Settings


def trained(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None, how: Settings = Settings()) -> Scanner:
    """A scanner for texts like these.

    ``labelled`` holds findings: value, before, after and label (1 secret, 0 not). Without it
    the forest learns from ``generated`` findings and from the candidates of ``docs`` whose format
    leaves no doubt on either side. The dictionary is counted over all texts; the forest sees a bounded
    sample of the findings.
    """
    words = dictionary(docs, text_col, how.dictionary)
    if labelled is None:
        found = pieces(docs.select(F.col(text_col).alias("text")), "text", how).select(F.explode("finds").alias("find")).select("find.*")
        found = found.withColumn("label", sure_label(F.col("value"), F.col("before"))).where("label is not null")
        labelled = written_table(found.unionByName(generated(docs.sparkSession, words, how.generated, how.seed)), "findings")
    rows = sampled(labelled, how).withColumn("find", F.struct("value", "before", "after"))
    rows = written_table(rows.select(features(F.col("find"), words).alias("features"), "label"), "features")
    return Scanner(words, grown(rows, how), how)


def scanned(docs: DataFrame, scanner: Scanner, text_col: str) -> DataFrame:
    """Adds parts, finds and the score of each find to the rows; a known format scores 1."""
    known = lambda x: known_format(x["value"], x["before"]) == 1
    return (
        pieces(docs, text_col, scanner.how)
        .withColumn("facts", F.transform("finds", lambda x: features(x, scanner.words)))
        .withColumn("votes", F.transform("facts", lambda x: vote(scanner.trees, x)))
        .withColumn("scores", F.zip_with("finds", "votes", lambda x, v: F.when(known(x), F.lit(1.0)).otherwise(v)))
    )


def findings(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, nth (from 0, in order of the text), value, score and is_secret of each candidate.

    A null or empty text and one without candidates give no rows; repeated rows and values are
    found once each. A text is one task's work, without a shuffle. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    each = scanned(rows, scanner, "text").select("doc_id", F.posexplode(F.arrays_zip("finds", "scores")).alias("nth", "x"))
    score = F.col("x.scores")
    return each.select(
        "doc_id", F.col("nth").cast("long").alias("nth"), F.col("x.finds.value").alias("value"),
        score.alias("score"), (score >= scanner.how.threshold).alias("is_secret"),
    )


def redacted(docs: DataFrame, scanner: Scanner, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """The same rows and columns, with each secret in the text replaced by a mask.

    A null text stays null. All columns travel inside a struct, so no name can clash.
    """
    names = docs.columns
    shown = F.zip_with(
        F.transform("finds", lambda x: x["value"]), "scores", lambda v, s: F.when(s >= scanner.how.threshold, F.lit(mask)).otherwise(v)
    )
    joined = F.array_join(F.flatten(F.zip_with("parts", "shown", lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")
    rows = scanned(docs.select(F.struct("*").alias("row")).withColumn("text", F.col("row")[text_col]), scanner, "text")
    clean = rows.withColumn("shown", shown).withColumn("clean", F.when(F.col("text").isNotNull(), joined))
    return clean.select(*[F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])
