"""Secret scans: a random forest removes false positives among candidates.

A candidate is a run of at least ``MIN_LENGTH`` of ``[A-Za-z0-9+/_.@:-]`` inside a
word; what stands before a "=" in the word (or before a ":", if it names a
credential) is its key. A value that is given to a credential's name and holds
no such run is a candidate as a whole, whatever its length and characters.
Each candidate gets

* its length and shares of digits, capitals, marks and distinct characters;
* character transitions: changes of class, and the mean log probability of
  its character pairs in the corpus' own dictionary;
* dictionary coverage: the share of its characters in letter runs that are
  dictionary words (the ``DICTIONARY`` most frequent lower-case words, counted over
  all texts);
* its path (the source): test and example marks, length;
* neighbouring words: whether the key or the words before name a credential or assign.

The forest is trained on labelled findings (any table of id, candidate and
label; ``reviewed`` makes one from formats and from evidence of harmlessness, and
leaves all other candidates without a label) outside the held-out fold, at most
``MAX_FINDINGS`` of them, the first by hash; all candidates of all texts are scored.

Only DataFrame functions and Spark's own forest. Defined results: null and
empty texts have no candidates; repeated rows and repeated candidates each
get their row; null sources are the empty path; without findings of both
labels every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import GAP, staged

MIN_LENGTH = 16
DICTIONARY = 20_000
MAX_FINDINGS = 20_000
FOLDS = 5
RUN = r"[A-Za-z0-9+/_.@:\-]{%d,}" % MIN_LENGTH
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
CREDENTIAL = r"(?i)passw|passwd|pwd|token|secret|api|key|auth|credential|bearer"
# Formats that a reviewer takes as secrets, without regard to case: those with
# their provider's mark, and those that need a credential's name beside them.
MARKED = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[0-9A-Z]{20,}",
    r"xox[a-z]-[0-9A-Z\-]{10,}",
    r"eyJ[0-9A-Z_\-]{8,}\.[0-9A-Z_\-]+\.[0-9A-Z_\-]*",
)
SHAPED = (
    r"[0-9a-f]{18}",
    r"[0-9a-f]{32}",
    r"[0-9a-f]{40}",
    r"[0-9a-f]{64}",
)
# What a reviewer takes as harmless: words of letters in one case, addresses,
# dates and plain numbers.
_MARKS = r"[+/_.@:\-]"
_WORD = r"([A-Z]?[a-z]+|[A-Z]+)"
HARMLESS = (
    rf"{_MARKS}*{_WORD}({_MARKS}+{_WORD})*{_MARKS}*",
    r"(?i)[0-9a-z_.+\-]+@[0-9a-z\-]+(\.[0-9a-z\-]+)+\.?",
    r"(?i)[a-z]{2,8}://[0-9a-z\-]+(\.[0-9a-z\-]+)+(:[0-9]+)?(/[a-z_.\-]*)*",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.+\-]+Z?",
    r"[0-9+/.:\-]+",
)
ASSIGN = r"^(:?=|:)$"
_BASE = ["length", "digits", "capitals", "marks", "distinct", "changes", "pairs", "covered",
         "path_test", "path_length", "key_credential", "near_credential", "near_assigns"]


def words_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), GAP)


_NAMED = r"^([^:=]*):(?!//)"


def key_of(word: Column) -> Column:
    named = F.regexp_extract(word, _NAMED, 1)
    return F.when(named.rlike(CREDENTIAL), named).otherwise(
        F.when(word.contains("="), F.substring_index(word, "=", 1)).otherwise("")
    )


def given(word: Column, before: Column, second: Column) -> Column:
    """The value that ``word`` gives to a credential's name (in the word or before
    it), without quotes and brackets at its ends; null if none."""
    inside = key_of(word).rlike(CREDENTIAL)
    ahead = (
        (before.rlike(ASSIGN) & second.rlike(CREDENTIAL))
        | (before.rlike("[:=]$") & before.rlike(CREDENTIAL))
        | (word.rlike("^:?[:=]") & before.rlike(CREDENTIAL))
    )
    start = F.when(F.regexp_extract(word, _NAMED, 1).rlike(CREDENTIAL), F.regexp_replace(word, _NAMED + "=?", ""))
    value = F.when(inside, F.coalesce(start, F.regexp_replace(word, "^[^=]*=", ""))).when(
        ahead, F.regexp_replace(word, "^:?[:=]", "")
    )
    value = F.regexp_replace(value, r"""^["'`(\[{<]+|["'`)\]}>,;]+$""", "")
    return F.when(~value.rlike("^[:=]*$"), value)


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """(_id, path, at, word, before, second, candidate, key): one row per candidate."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    words = F.col("_words")
    split = docs.select(F.col(id_col).alias("_id"), path.alias("path"), words_of(F.col(text_col)).alias("_words"))
    marked = lambda w: w.contains("=") | w.contains(":")
    at = F.filter(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda i: (F.length(F.get(words, i)) >= MIN_LENGTH)
        | marked(F.get(words, i))
        | F.coalesce(marked(F.get(words, i - 1)), F.lit(False)),
    )
    parts = F.transform(
        at,
        lambda i: F.struct(
            i.alias("at"),
            F.get(words, i).alias("word"),
            F.coalesce(F.get(words, i - 1), F.lit("")).alias("before"),
            F.coalesce(F.get(words, i - 2), F.lit("")).alias("second"),
        ),
    )
    rows = split.select("_id", "path", F.explode(parts).alias("x")).select("_id", "path", "x.*")
    rows = rows.withColumn("_given", given(F.col("word"), F.col("before"), F.col("second")))
    short = F.col("_given").isNotNull() & ~F.col("_given").rlike(RUN)
    found = F.concat(
        F.regexp_extract_all("word", F.lit(f"({RUN})"), 1),
        F.when(short, F.array("_given")).otherwise(F.array().cast("array<string>")),
    )
    return rows.withColumn("candidate", F.explode(found)).withColumn("key", key_of(F.col("word"))).drop("_given")


def dictionary(docs: DataFrame, text_col: str, size: int = DICTIONARY) -> DataFrame:
    """(w, n): the most frequent words of three to twenty letters a-z, with
    their counts; at most ``size`` rows."""
    words = F.explode(words_of(F.col(text_col))).alias("w")
    return (
        docs.select(words)
        .filter(F.col("w").rlike("^[a-z]{3,20}$"))
        .groupBy("w")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "w")
        .limit(size)
    )




def pair_table(words: DataFrame) -> Column:
    """Log probabilities of character pairs as one array (a fixed size)."""
    n = len(ALPHABET) + 1
    i = F.explode(F.sequence(F.lit(1), F.length("w") - 1))
    pairs = words.select("w", "n", i.alias("i"))
    first, second = (F.position(F.substring("w", F.col("i") + k, F.lit(1)), F.lit(ALPHABET)) for k in (0, 1))
    counts = pairs.groupBy((first * n + second).alias("p")).agg(F.sum("n").alias("c"))
    found = {r["p"]: float(r["c"]) for r in counts.collect()}  # at most n * n
    total = sum(found.values()) + n * n
    return F.array(*(F.log(F.lit((found.get(p, 0.0) + 1) / total)) for p in range(n * n)))


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the columns of ``_BASE``."""
    c, size = F.col("candidate"), F.length("candidate").cast("double")
    lower = F.lower(c)
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / size
    chars = F.split(lower, "")
    table = F.col("_pairs")
    n = len(ALPHABET) + 1
    pairs = F.aggregate(
        F.slice(F.sequence(F.lit(1), F.length(c)), 1, F.length(c) - 1),
        F.lit(0.0),
        lambda acc, i: acc
        + F.element_at(
            table,
            F.position(F.substring(lower, i, F.lit(1)), F.lit(ALPHABET)) * n
            + F.position(F.substring(lower, i + 1, F.lit(1)), F.lit(ALPHABET)) + 1,
        ),
    ) / size
    near = F.concat_ws(" ", "before", "second")
    base = found.withColumn("_pairs", pair_table(words)).select(
        *found.columns,
        F.xxhash64("_id", "path", "at", "candidate").alias("_row"),
        size.alias("length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("capitals"),
        share("[^A-Za-z0-9]").alias("marks"),
        (F.size(F.array_distinct(chars)) / size).alias("distinct"),
        share("[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]").alias("changes"),
        pairs.alias("pairs"),
        F.col("path").rlike("(?i)test|example|sample|mock|doc").cast("double").alias("path_test"),
        F.length("path").cast("double").alias("path_length"),
        F.col("key").rlike(CREDENTIAL).cast("double").alias("key_credential"),
        near.rlike(CREDENTIAL).cast("double").alias("near_credential"),
        (F.col("key").rlike(".") | F.col("before").rlike(ASSIGN + "|[:=]$")).cast("double").alias("near_assigns"),
    )
    runs = base.select(
        "candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("([a-z]{3,20})"), 1)).alias("w")
    )
    distinct_runs = runs.groupBy("candidate", "w").agg(F.count(F.lit(1)).alias("_one"))
    known = (  # the dictionary has a fixed size
        distinct_runs.join(F.broadcast(words.select("w")), "w")
        .groupBy("candidate")
        .agg(F.collect_set("w").alias("_known"))
    )
    return base.join(known, "candidate", "left").withColumn(
        "covered",
        F.coalesce(
            F.aggregate(
                F.regexp_extract_all(F.lower("candidate"), F.lit("([a-z]{3,20})"), 1),
                F.lit(0),
                lambda acc, w: acc + F.when(F.array_contains("_known", w), F.length(w)).otherwise(0),
            )
            / size,
            F.lit(0.0),
        ),
    ).drop("_known")


def reviewed(found: DataFrame) -> DataFrame:
    """Labelled findings: a whole candidate of a format that has its provider's mark,
    or of another format beside a credential's name, is a secret; words, addresses,
    dates and plain numbers that are not given to a credential's name are false
    positives. Any other candidate has no label (null): an unknown shape is no
    evidence of either."""
    named = F.col("key").rlike(CREDENTIAL) | F.concat_ws(" ", "before", "second").rlike(CREDENTIAL)
    # a run takes in the name before a ":"
    value = F.when(named, F.regexp_replace("candidate", "^[^:]*:(?!//)", "")).otherwise(F.col("candidate"))
    one_of = lambda c, formats: c.rlike("^(" + "|".join(formats) + ")$")
    secret = one_of(value, ["(?i)" + f for f in MARKED]) | (one_of(value, ["(?i)" + f for f in SHAPED]) & named)
    assigned = given(F.col("word"), F.col("before"), F.col("second")).isNotNull()
    harmless = one_of(F.col("candidate"), HARMLESS) & ~assigned
    return found.withColumn("label", F.when(secret, 1.0).when(harmless, 0.0))


def held_out(id_col: str, folds: int = FOLDS) -> Column:
    remainder = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(remainder == 0, F.lit(False))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
    label=reviewed,
    max_findings: int = MAX_FINDINGS,
    trees: int = 20,
    depth: int = 6,
    seed: int = 5,
) -> DataFrame:
    """(id, word_at, candidate_sha256, length, held_out, label, score,
    predicted): one row per candidate; ``label`` turns candidates into labelled
    findings (null: not reviewed)."""
    words = staged(dictionary(docs, text_col), "secrets-words")
    found = staged(candidates(docs, id_col, text_col, path_col), "secrets-candidates")
    rows = staged(label(featured(found, words)), "secrets-features")
    known = rows.filter(F.col("label").isNotNull() & ~held_out("_id"))
    counts = known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()  # two rows
    out = [
        F.col("_id").alias(id_col),
        F.col("at").alias("word_at"),
        F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"),
        F.col("length").cast("int").alias("length"),
        held_out("_id").alias("held_out"),
        "label",
    ]
    if len(counts) < 2:
        return rows.select(*out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    # as many of each label as the bound allows, the first by hash
    half = max_findings // 2
    picked = [known.filter(F.col("label") == r["label"]).orderBy("_row").limit(half) for r in counts]
    sample = picked[0].unionByName(picked[1])
    assembler = VectorAssembler(inputCols=_BASE, outputCol="_features")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw",
        predictionCol="_prediction", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False,
    ).fit(assembler.transform(staged(sample, "secrets-sample")))
    scored = forest.transform(assembler.transform(rows)).withColumn(
        "score", F.round(vector_to_array("_probability")[1], 9)
    )
    return scored.select(*out, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
