"""Secret scans: candidate strings, judged by a random forest.

Candidates are all runs of at least ``MIN_CHARS`` key characters, with or without a
digit, but for one letter or sign repeated (rules and filler lines); ``=`` may end a run
but is not part of one, so a value begins after it.  A
random forest, trained here from labelled findings, removes false positives; its features
are the candidate's length, its character transitions, its vowels, the prefix of
well-known keys, the share of it that dictionary words cover, the path it comes from and the words next to it.

Candidates, features and scores are DataFrame operations only: the text is split
at the candidates, so each comes with what stands before and after it, and the
forest is the one of ``pyspark.ml``.  Rows never move.

Edge cases: a null or empty text has no candidates; very long texts are scanned
whole; equal candidates of a text are separate findings, numbered from 0; a null
path is an unknown one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_CHARS = 16

#: Java pattern of a candidate.
CANDIDATE = (rf"(?<![A-Za-z0-9+/_-])(?!([A-Za-z+/_-])\1*+(?![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{{{MIN_CHARS},}}+"
             r"(?:={1,2}(?![A-Za-z0-9+/_=-]))?")

#: What may stand between a candidate that is a name and the value assigned to it, and how name and gap end together.
GAP = r"""^["']?[ \t]{0,8}[=:]{0,2}[ \t]{0,8}["']?$"""
NAMED = r"""[=:][ \t]{0,8}["']?$"""

#: Characters before and after a candidate that count as its neighbours.
NEAR = 48

#: Words that make up names rather than keys.
DICTIONARY = ("access account address api app array base block build button class client code color column config content "
              "count data date default demo example field file first form function group header heading here image index "
              "info input item key label last level line link list message model name node number object order page "
              "password path placeholder point private query report request response result row sample secret section "
              "server session size source state status string style system table target test text time title token type "
              "update user value version view width your").split()

#: What stands before secrets and before other long strings, and how well-known keys begin.
SECRET_WORDS = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private.?key|client.?id)"
OTHER_WORDS = r"(?i)(sha-?[0-9]*|md5|commit|checksum|digest|hash|uuid|guid|isbn|order|invoice|card|phone|tel|base64|https?:)"
KEY_PREFIXES = r"^(A3T|AKIA|ASIA|AIza|gh[opsur]_|github_pat_|glpat-|xox[abeprs]-|sk[-_]|pk_|npm_|eyJ)"
TEST_PATHS = r"(?i)(test|spec|example|sample|fixture|docs?/|mock)"

#: Labelled findings as rules.  (secret?, before, kind of value, after, path); kinds are made in :func:`values`.
FINDINGS = (
    (1, 'token = "', "hex40", '" and', "src/app.py"),
    (1, 'the token = "', "hex40", '"', "src7"),
    (1, "api_key: ", "mixed32", "", "deploy/prod.yaml"),
    (1, 'password="', "mixed20", '"', "src/db.ini"),
    (1, "Authorization: Bearer ", "mixed40", "", "web/client.js"),
    (1, "aws_secret_access_key = ", "mixed40", "", "home/.aws/credentials"),
    (1, "access key ", "upper20", " was", "src3"),
    (1, "export AUTH_TOKEN=", "mixed36", "", "ci/run.sh"),
    (1, "client_secret=", "hex32", "&grant", "src11"),
    (1, "private_key: '", "mixed44", "'", "config/service.json"),
    (0, "commit ", "hex40", " fixed", "src/CHANGES"),
    (0, "sha256: ", "hex64", "", "dist/files.lock"),
    (0, "md5 ", "hex32", "", "src5"),
    (0, "uuid ", "uuid", "", "src/ids.csv"),
    (0, "order ", "digits16", " of", "src2"),
    (0, "of the ", "digits16", " and the", "src0"),
    (0, "in the thing ", "digits16", " thand on", "src9"),
    (0, "", "digits18", " er on", "src14"),
    (0, "card ", "digits16", "", "src1"),
    (0, 'src="data:image/png;base64,', "mixed44", "==", "web/index.html"),
    (0, 'id="', "words", '"', "web/page.html"),
    (0, "see https://example.com/", "words", " for", "docs/intro.md"),
    (0, 'token = "', "words", '"', "docs/example.md"),
    (0, 'api_key = "', "words", '"', "tests/test_api.py"),
    (0, "the ", "words", " of", "src4"),
    (1, 'password = "', "letters20", '"', "src/db.ini"),
    (1, "DB_PASSWORD=", "letters20", "", "ci/run.sh"),
    (1, "api_key: ", "letters32", "", "deploy/prod.yaml"),
    (1, "access key ", "capitals20", " was", "src3"),
    (1, "", "capitals20", "", "src6"),
    (1, "aws_access_key_id = ", "capitals20", "", "home/.aws/credentials"),
    (1, "password: ", "phrase", "", "config/service.yaml"),
    (1, "db_passwd=", "phrase", "", "src12"),
    (0, "the ", "prose", " of", "src4"),
    (0, "der ", "prose", " und", "src8"),
    (0, "", "prose", ". ", "src10"),
    (0, "the ", "Prose", " of", "src13"),
    (0, "the secret ", "prose", " of", "src1"),
    (0, "THE ", "PROSE", " OF", "src2"),
    (0, "", "PROSE", " and", "src14"),
    (1, "AWS_SECRET_ACCESS_KEY=", "worded40", "", "ci/env.sh"),
    (1, "secret_key: ", "worded40", "", "src16"),
    (0, "see /", "path", " for", "docs/intro.md"),
    (0, "https:", "path", " now", "src15"),
    (0, "", "names", " = 1", "src/config.py"),
    (0, "export ", "NAMES", "=", "ci/run.sh"),
    (0, "", "NAMES", "=", "src5"),
    (0, "token = ", "camel", "()", "src/app.py"),
    (0, "return ", "camel", "(x)", "src/app.js"),
)

#: Rows made from each rule.
COPIES = 40

FEATURES = ("length", "changes", "digit_share", "upper_share", "variety", "hex_only", "dictionary_share", "test_path",
            "secret_words", "other_words", "assigned", "quoted", "vowel_share", "key_prefix")


def values() -> dict[str, Column]:
    """Made-up candidates of each kind as functions of the column ``seed``."""
    digest = F.sha2(F.col("seed"), 256)
    letters = F.translate(F.base64(F.unhex(F.concat(digest, F.sha2(F.concat(F.lit("x"), "seed"), 256)))), "+/=", "aZ9")
    digits = F.translate(digest, "abcdef", "012345")
    plain = F.translate(letters, "0123456789", "qZkWvXbHjR")
    words = F.array(*map(F.lit, DICTIONARY))

    def word(start: int) -> Column:
        return F.get(words, F.pmod(F.conv(F.substring(digest, start, 6), 16, 10).cast("int"), F.lit(len(DICTIONARY))))

    def sound(start: int) -> Column:
        """Syllables that no dictionary has: consonant and vowel by turns."""
        part = F.substring(digest, start, 6)
        return F.concat(*(F.translate(F.substring(part, k, 1), "0123456789abcdef", "aeiouaeiouaeioue" if k % 2 == 0 else "bdfglmnprstvhckr")
                          for k in range(1, 7)))

    return {
        "hex32": F.substring(digest, 1, 32), "hex40": F.substring(digest, 1, 40), "hex64": digest,
        "mixed20": F.concat(F.substring(letters, 1, 19), F.lit("7")), "mixed32": F.concat(F.substring(letters, 1, 31), F.lit("3")),
        "mixed36": F.concat(F.lit("ghp_"), F.substring(letters, 1, 35), F.lit("4")), "mixed40": F.concat(F.substring(letters, 1, 39), F.lit("5")),
        "mixed44": F.concat(F.substring(letters, 1, 43), F.lit("2")),
        "upper20": F.concat(F.lit("AKIA"), F.substring(F.upper(letters), 1, 15), F.lit("6")),
        "digits16": F.substring(digits, 1, 16), "digits18": F.substring(digits, 1, 18),
        "uuid": F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4),
                            F.substring(digest, 17, 4), F.substring(digest, 21, 12)),
        "letters20": F.substring(plain, 1, 20), "letters32": F.substring(plain, 1, 32),
        "capitals20": F.concat(F.lit("AKIA"), F.substring(F.upper(plain), 1, 16)),
        "phrase": F.concat_ws("-", sound(1), sound(13), sound(25), sound(37)),
        "prose": F.concat(sound(1), sound(13), sound(25), sound(37), sound(49)),
        "Prose": F.initcap(F.concat(sound(1), sound(13), sound(25), sound(37))),
        "PROSE": F.upper(F.concat(sound(1), sound(13), sound(25))),
        "worded40": F.concat(F.substring(letters, 1, 21), F.lit("/"), F.substring(letters, 23, 8), F.upper(word(1)), F.upper(word(9))),
        "path": F.concat_ws("/", F.lit("/www"), sound(1), word(9), sound(25), word(33)),
        "names": F.concat_ws("_", word(1), word(9), word(17), word(25)),
        "NAMES": F.upper(F.concat_ws("_", word(1), word(9), word(17), word(25))),
        "camel": F.concat(F.lit("get"), F.initcap(word(1)), F.initcap(word(9)), F.initcap(word(17)), F.lit("From")),
        "words": F.concat_ws("_", word(1), word(9), word(17), word(25), F.substring(digits, 1, 2)),
    }


def labelled_findings(spark: SparkSession, copies: int = COPIES) -> DataFrame:
    """``candidate``, ``before``, ``after``, ``path``, ``label``: the labelled table, made from :data:`FINDINGS`."""
    rules = spark.createDataFrame([(i, *f) for i, f in enumerate(FINDINGS)],
                                  "rule int, label int, before string, kind string, after string, path string")
    rows = rules.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    rows = rows.withColumn("seed", F.concat_ws("-", "rule", "copy"))
    made = F.lit(None).cast("string")
    for kind, value in values().items():
        made = F.when(F.col("kind") == kind, value).otherwise(made)
    return rows.select(made.alias("candidate"), "before", "after", "path", F.col("label").cast("double").alias("label"))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``path``, ``place``, ``candidate``, ``before``, ``after`` of every candidate of every text."""
    pattern = F.lit(CANDIDATE)
    found = docs.select("doc_id", F.col("source").alias("path"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("hits"), "text")
    found = found.where(F.size("hits") > 0)
    split = found.select("doc_id", "path", "hits", F.transform(F.split("text", CANDIDATE, -1), _ends).alias("between"))
    after = F.slice("between", 2, F.size("hits"))
    earlier = F.concat(F.array(F.lit("")), F.slice("hits", 1, F.size("hits") - 1))
    zipped = F.arrays_zip(F.col("hits"), F.slice("between", 1, F.size("hits")).alias("before"), after.alias("after"),
                          earlier.alias("earlier"))
    gap, joined = F.col("hit.before.tail"), F.concat("hit.earlier", "hit.before.tail")
    before = F.when(gap.rlike(GAP) & joined.rlike(NAMED), joined).otherwise(gap)  # the name that the value is assigned to
    return (split.select("doc_id", "path", F.posexplode(zipped).alias("place", "hit"))
            .select("doc_id", "path", "place", F.col("hit.hits").alias("candidate"),
                    F.right(before, F.lit(NEAR)).alias("before"), F.col("hit.after.head").alias("after")))


def _ends(between: Column) -> Column:
    return F.struct(F.left(between, F.lit(NEAR)).alias("head"), F.right(between, F.lit(NEAR)).alias("tail"))


def with_features(found: DataFrame) -> DataFrame:
    """Findings with the columns :data:`FEATURES`."""
    value = F.regexp_replace("candidate", "=+$", "")
    size = F.greatest(F.length(value), F.lit(1))
    changes = r"(?<=[0-9])[^0-9]|(?<=[^0-9])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"
    left = F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")

    def flag(column: Column) -> Column:
        return F.coalesce(column, F.lit(False)).cast("double")

    return found.withColumns({
        "length": F.length("candidate").cast("double"),
        "changes": F.regexp_count(value, F.lit(changes)) / size,
        "digit_share": F.regexp_count(value, F.lit("[0-9]")) / size,
        "upper_share": F.regexp_count(value, F.lit("[A-Z]")) / size,
        "variety": F.size(F.array_distinct(F.split(value, ""))) / size,
        "hex_only": flag(value.rlike("^[0-9a-f]+$")),
        "dictionary_share": 1 - F.length(left) / size,
        "test_path": flag(F.col("path").rlike(TEST_PATHS)),
        "secret_words": flag(F.col("before").rlike(SECRET_WORDS)),
        "other_words": flag(F.col("before").rlike(OTHER_WORDS)),
        "assigned": flag(F.col("before").rlike(r"""[=:]\s*["']?$""")),
        "quoted": flag(F.col("before").rlike("""["']$""") & F.col("after").rlike("""^["']""")),
        "vowel_share": F.regexp_count(value, F.lit("[AEIOUaeiou]")) / size,
        "key_prefix": flag(value.rlike(KEY_PREFIXES)),
    })


def train(findings: DataFrame, trees: int = 24, depth: int = 6, seed: int = 7) -> PipelineModel:
    """Random forest over labelled findings (columns of :func:`labelled_findings`)."""
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]
    return Pipeline(stages=stages).fit(with_features(findings).repartition(1).sortWithinPartitions("candidate", "before"))


def scan(docs: DataFrame, model: PipelineModel, least: float = 0.5) -> DataFrame:
    """All candidates with ``score`` (the forest's probability of a secret) and ``is_secret``."""
    scored = model.transform(with_features(candidates(docs)))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc_id", "place", "path", "candidate", "before", "after", score.alias("score"),
                         (score >= least).alias("is_secret"))
