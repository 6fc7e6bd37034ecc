"""Secret scan with a random forest against false positives, in built-in expressions.

Candidates are runs of 16 or more characters of key alphabets with a digit, also
right after a sign =, so NAME=value and ?name=value are seen without quotes.  A
forest judges each by its length, its character transitions, how much of it
dictionary words cover, its path and its neighbouring words.  The forest is
trained from labelled findings, a table of (candidate, before, after, path,
is_secret); `labelled_findings` makes one of any size by rule, for use where no
reviewed findings are at hand.

Scale: one scan; no shuffle, no texts moved.  The training table is bounded by
whoever supplies it; `fit` refuses more than `fit_rows` rows, so that nobody
trains on a corpus by mistake.

Defined results: null and empty texts have no candidates.  A candidate that
occurs twice is judged at each place, and a repeated row each time.  Very long
texts are read whole.  A null path counts as empty.  Without
findings of both kinds the forest is replaced by the share of secrets.  Empty
tables give empty results.  Only the id, the text and the path are read.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sign = before a key character assigns; elsewhere up to two of them pad.
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}+(?:={1,2}+(?![A-Za-z0-9+/_\-]))?"
#: Characters of context on either side.
CONTEXT = 60
FIT_ROWS, TREES, DEPTH, SEED = 50_000, 40, 8, 20_250_101

#: Words that make a string readable.
DICTIONARY = (
    "access", "account", "admin", "api", "app", "archive", "asset", "auth", "backup", "build", "change", "client", "cloud", "code", "config", "content",
    "data", "date", "default", "demo", "dummy", "example", "file", "final", "free", "group", "here", "home", "image", "index", "insert", "item", "key",
    "list", "local", "main", "model", "module", "name", "news", "note", "page", "pass", "photo", "place", "post", "release", "report", "sample", "secret",
    "section", "server", "service", "start", "summer", "table", "team", "test", "text", "time", "token", "update", "user", "value", "version", "week",
    "winter", "word", "your", "xxxx", "0000", "1234",
)
#: Neighbours that speak for a secret, and against one.
FOR = ("token", "key", "secret", "password", "passwd", "pwd", "bearer", "credential", "auth", "apikey", "private")
AGAINST = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "etag", "id", "uuid", "guid", "version", "build", "image", "img", "href", "src", "card", "order", "invoice", "example", "sample", "dummy", "digest", "phone")
#: Parts of paths that hold made-up values.
MADE_UP = ("test", "tests", "spec", "fixtures", "example", "examples", "docs", "sample", "mock")


def _word(words: tuple[str, ...]) -> str:
    return rf"(?i)(?<![A-Za-z0-9])(?:[a-z0-9]*[_\-])?({'|'.join(words)})(?![A-Za-z0-9])"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, place, candidate, before, after, path), one row for each candidate; `place` counts from 0 in its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), text.alias("text")).filter(F.col("text").rlike(CANDIDATE))
    cut = rows.select("doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("c"), F.split("text", CANDIDATE).alias("gaps"))
    # a name can be a candidate itself, as in my_password_2=..., and is still its value's context
    lead = lambda i: F.when(F.get("gaps", i).rlike(r"^[\s:=>\"'`]+$"), F.get("c", i - 1)).otherwise(F.lit(""))
    found = cut.select(
        "doc_id", "path",
        F.posexplode(F.transform("c", lambda c, i: F.struct(c.alias("candidate"), F.right(F.concat(F.coalesce(lead(i), F.lit("")), F.get("gaps", i)), F.lit(CONTEXT)).alias("before"), F.left(F.get("gaps", i + 1), F.lit(CONTEXT)).alias("after")))).alias("place", "f"),
    )
    return found.select("doc_id", "place", "f.*", "path")


def features() -> dict[str, Column]:
    """Numbers for the columns candidate, before, after and path."""
    c, before, after, path = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("candidate", "before", "after", "path"))
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    flag = lambda condition: condition.cast("double")
    letters = F.greatest(count(c, "(?<=[A-Za-z])(?=[A-Za-z])"), F.lit(1.0))
    covered = F.length(F.regexp_replace(F.lower(c), "|".join(sorted(map(re.escape, DICTIONARY), key=len, reverse=True)), "")) / n
    return {
        "length": F.log(n),
        "class_changes": count(c, r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        "vowel_changes": count(c, r"(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])") / letters,
        "repeats": count(c, r"(.)(?=\1)") / n,
        "digits": count(c, "[0-9]") / n,
        "capitals": count(c, "[A-Z]") / n,
        "joints": count(c, r"[_\-/+]") / n,
        "hex": flag(c.rlike("^[0-9a-fA-F]+$")),
        "uuid": flag(c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40.0)),
        "dictionary": 1 - covered,
        "assigned": flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "words_for": flag(before.rlike(_word(FOR) + r"\W*(\w+\W+)?$")),
        "words_against": flag(before.rlike(_word(AGAINST) + r"\W*(\w+\W+)?$")),
        "in_address": flag(before.rlike(r"[./@]$") | after.rlike(r"^[./@][A-Za-z0-9]")),
        "path_made_up": flag(path.rlike(_word(MADE_UP))),
        "path_depth": F.least(count(path, "/"), F.lit(10.0)),
    }


class Forest:
    """A trained judge of candidates."""

    def __init__(self, model, share: float):
        self.model, self.share = model, share

    def score(self, found: DataFrame) -> DataFrame:
        """`found` with score, the forest's probability of a secret."""
        if self.model is None:
            return found.withColumn("score", F.lit(self.share))
        made = _assembled(found)
        return self.model.transform(made).withColumn("score", vector_to_array("__probability")[1]).drop("__features", "__raw", "__probability", "__prediction")


def _assembled(found: DataFrame) -> DataFrame:
    named = {f"__{k}": v for k, v in features().items()}
    return VectorAssembler(inputCols=list(named), outputCol="__features").transform(found.withColumns(named)).drop(*named)


def fit(findings: DataFrame, *, fit_rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Train on labelled findings, at most `fit_rows` of them."""
    findings = findings.select("candidate", "before", "after", "path", F.col("is_secret").cast("double").alias("__label")).filter("__label is not null")
    rows, good = findings.agg(F.count("*"), F.coalesce(F.sum("__label"), F.lit(0.0))).first()
    if rows > fit_rows:
        raise ValueError(f"{rows} findings; at most {fit_rows} are taken")
    if not 0 < good < rows:
        return Forest(None, good / rows if rows else 0.0)
    forest = RandomForestClassifier(featuresCol="__features", labelCol="__label", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction", numTrees=trees, maxDepth=depth, seed=SEED)
    made = _assembled(findings).select("__features", "__label")
    return Forest(forest.fit(made.repartitionByRange(4, "__label", F.xxhash64(vector_to_array("__features")))), good / rows)


def scan(docs: DataFrame, forest: Forest, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, place, candidate, before, after, path, score, is_secret) of every candidate."""
    return forest.score(candidates(docs, id_col, text_col, path_col)).withColumn("is_secret", F.col("score") >= threshold)


def labelled_findings(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """Labelled findings by rule: six kinds of secrets and eight of harmless strings."""
    i = F.col("id").cast("string")
    h = F.sha2(i, 512)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), r"[\s=]", "")
    plain = F.regexp_replace(b64, "[+/]", "x")
    pick = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(values))).cast("int") + 1)
    cut = lambda text, least, most: F.substr(text, F.lit(1), (F.lit(least) + F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(most - least + 1))).cast("int"))
    word = lambda salt: pick(salt, DICTIONARY[:-3])
    sign, quote = pick(2, (" = ", "=", ": ", " := ")), pick(3, ('"', "'", "", '"'))
    named = lambda names: F.concat(pick(4, names), sign, quote)
    uuid = F.concat_ws("-", F.substr(h, F.lit(1), F.lit(8)), F.substr(h, F.lit(9), F.lit(4)), F.substr(h, F.lit(13), F.lit(4)), F.substr(h, F.lit(17), F.lit(4)), F.substr(h, F.lit(21), F.lit(12)))
    year = F.concat(F.lit("20"), F.lpad(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(30)).cast("string"), 2, "0"))
    hexes = F.substr(h, F.lit(1), pick(6, (32, 40, 40, 64)))
    either = lambda text: F.when(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(4)) == 0, F.upper(text)).otherwise(text)
    none = F.lit("")
    kinds = [  # candidate, before, after, is_secret
        (either(hexes), either(named(("token", "auth_token", "secret", "api_key", "access_key"))), quote, 1),
        (cut(b64, 24, 64), named(("api_key", "client_secret", "apikey", "private_key")), quote, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substr(plain, F.lit(1), F.lit(16)))), named(("aws_key", "access_key", "key")), quote, 1),
        (cut(plain, 16, 32), named(("password", "passwd", "pwd", "db_password")), quote, 1),
        (F.concat(F.lit("ghp_"), F.substr(plain, F.lit(1), F.lit(36))), named(("token", "credential", "auth")), quote, 1),
        (cut(plain, 30, 80), F.lit("Authorization: Bearer "), none, 1),
        (either(F.substr(h, F.lit(1), F.lit(40))), pick(8, ("commit ", "merge commit ", "sha1 ", "sha: ", 'version = "')), pick(9, ("", " fix", '"')), 0),
        (either(hexes), pick(10, ("md5: ", "sha256:", "checksum = ", 'etag: "', "digest sha256 ", "hash of the file ")), pick(9, ("", " ok", '"')), 0),
        (uuid, pick(11, ("id: ", 'uuid="', "request id ", "guid ", 'token = "', "user ")), pick(9, ("", ",", '"')), 0),
        (F.concat(word(12), F.lit("_"), word(13), F.lit("_"), word(14), pick(15, ("_1234", "_0000", "_here_1", "_xxxx_00"))), named(("token", "api_key", "password", "secret")), quote, 0),
        (F.concat(word(12), F.lit("/"), word(13), F.lit("-"), word(14), F.lit("-"), year), pick(16, ('src="/', "https://www.example.com/", 'href="/', "see ./")), pick(9, (".png", ".html", '"')), 0),
        (F.concat(word(12), F.lit("-"), word(13), F.lit("-"), word(14), F.lit("-"), year), pick(17, ("the ", "in ", "version ", "see ", "of ")), pick(9, ("", " and", ".")), 0),
        (F.substr(F.regexp_replace(F.concat(h, F.sha2(F.concat(i, F.lit("x")), 512)), "[a-f]", ""), F.lit(1), pick(18, (16, 16, 19, 20))), pick(19, ("card ", "order ", "invoice no. ", "the ", "call ")), pick(9, ("", " on", ".")), 0),
        (F.concat(word(12), word(13), word(14), word(20), year), pick(21, ("mail ", "user ", "by ", "from ")), pick(9, ("@mail.example.com", "@example.org", " said")), 0),
    ]
    kind = F.pmod("id", F.lit(len(kinds)))
    fields = ("candidate", "before", "after", "is_secret")
    row = F.coalesce(*[F.when(kind == k, F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(name) for name, v in zip(fields, values, strict=True)])) for k, values in enumerate(kinds)])
    path = F.when(F.pmod(F.xxhash64(F.lit(22), "id"), F.lit(5)) == 0, F.lit("")).otherwise(F.concat(pick(23, ("src/", "app/", "web/", "notes/")), word(24), F.lit(".txt")))
    lead = F.concat(word(25), F.lit(" "), word(26), F.lit(" "))
    return spark.range(0, rows, 1, 4).withColumn("row", row).select("row.candidate", F.concat(lead, F.col("row.before")).alias("before"), "row.after", path.alias("path"), "row.is_secret").filter(F.length("candidate") >= 16)
