"""Secret scan with DataFrame functions and a random forest that removes false positives.

A finding is a run of at least 16 token characters with a digit in it, or the value (of 6
characters or more, with any marks) of an assignment to a name such as password or token. The forest
sees its length, its transitions between kinds of characters, how much of it is dictionary words (words
of the corpus itself), the document's path and the neighbouring words. It is trained from
labelled findings. Where there is no labelled table, `rule_labels` labels those findings whose
form or surroundings settle the matter; the forest then does without the features that these
rules read before a finding, so it learns what secrets look like and judges values outside
assignments, and harmless ones inside, by that.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, stage, text_of

_TOKEN = "[A-Za-z0-9+/_-]"
#: A run, anchored at its start, so that a long one is tried once.
RUN = f"(?<!{_TOKEN})(?=[A-Za-z+/_-]*[0-9]){_TOKEN}{{16,}}"
#: What is assigned to a secret's name: the beginning is looked for right behind the assignment.
ASSIGNED = (r"(?<=[:=\s\"'])(?<=(?:[Pp]ass(?:word|wd)?|PASS(?:WORD|WD)?|[Pp]wd|PWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Kk]ey|KEY)"
            r"[\"']?\s{0,2}[:=]\s{0,2}[\"']?)[^\s\"',;<>]{6,}")
FINDING = f"{ASSIGNED}|{RUN}"
#: Characters of text kept on either side of a finding.
BESIDE = 48
#: Most distinct findings of each label that the fit reads (those with the smallest hashes).
MAX_LABELLED = 20_000
#: Shortest letter run that is looked up in the dictionary, and in how many documents a word must stand.
LEAST_LETTERS, LEAST_DOCS = 4, 2

_CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "mark": "[+/_-]"}
_KEY_BEFORE = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private)[\w-]*[\"']?\s*[:=]\s*[\"']?$"
_SOFT_WORDS = r"(?i)\b(key|token|secret|password|login|bearer|auth)\b"
_NUMBER_WORDS = r"(?i)\b(card|phone|order|invoice|number|isbn|id|hash|sha|md5|commit|uuid)\b"
_TEST_PATH = r"(?i)(test|example|sample|doc|mock|fixture)"


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """Every finding with its place and surroundings: doc_id, start, end (code points), finding, before, after, path."""
    text = text_of(docs, text_col)
    path = docs[path_col].cast("string") if path_col and path_col in docs.columns else F.lit("")
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"), text.alias("text"))
    rows = rows.filter(F.col("text").rlike(FINDING)).select(
        F.monotonically_increasing_id().alias("row_no"), "doc_id", "path",
        F.split("text", FINDING, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(FINDING), F.lit(0)).alias("found"))
    each = rows.select("row_no", "doc_id", "path", "gaps", F.posexplode("found").alias("i", "finding"))
    gap = F.get("gaps", F.col("i"))
    each = each.select("row_no", "doc_id", "path", "i", "finding", F.length(gap).alias("gap"),
                       F.substring(gap, -BESIDE, BESIDE).alias("before"),
                       F.substring(F.get("gaps", F.col("i") + 1), 1, BESIDE).alias("after"))
    # A document's findings, not its text, are gathered here.
    so_far = Window.partitionBy("row_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("finding")).over(so_far)
    return each.withColumn("end", end).select(
        "doc_id", (F.col("end") - F.length("finding")).cast("long").alias("start"), F.col("end").cast("long").alias("end"),
        "finding", "before", "after", "path")


def dictionary(docs: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """Which of ``wanted(word)`` stand as whole words in at least LEAST_DOCS documents of the corpus."""
    words = F.array_distinct(F.split(F.lower(text_of(docs, text_col)), r"[^\p{L}]+"))
    seen = docs.select(F.explode(words).alias("word")).filter(F.length("word") >= LEAST_LETTERS)
    # Counted before the join: a frequent word is one row of each task, not one of each document.
    return (seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_DOCS)
            .join(wanted, "word", "left_semi").select("word"))


def _share(pattern: str):
    return F.regexp_count("finding", F.lit(pattern)) / F.length("finding")


def with_features(found: DataFrame, docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``found`` with the forest's columns, and their names."""
    runs = F.regexp_extract_all(F.lower("finding"), F.lit(f"[a-z]{{{LEAST_LETTERS},}}"), F.lit(0))
    kinds = found.select("finding").distinct()
    letters = kinds.select("finding", F.explode(runs).alias("word"))
    known = dictionary(docs, letters.select("word").distinct(), text_col)
    cover = (letters.join(known, "word").groupBy("finding").agg(F.sum(F.length("word")).alias("covered")))
    out = found.join(cover, "finding", "left")
    cols = {
        "f_length": F.length("finding").cast("double"),
        "f_dictionary": F.coalesce(F.col("covered"), F.lit(0)) / F.length("finding"),
        "f_distinct": F.size(F.array_distinct(F.split("finding", ""))) / F.length("finding"),
        "f_hex": F.col("finding").rlike("^[0-9a-fA-F]+$").cast("double"),
        "f_longest_letters": F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("double"),
        "f_key_before": F.col("before").rlike(_KEY_BEFORE).cast("double"),
        "f_assigned": F.col("before").rlike(r"[:=]\s*[\"']?$").cast("double"),
        "f_quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "f_secret_words": F.concat_ws(" ", "before", "after").rlike(_SOFT_WORDS).cast("double"),
        "f_number_words": F.concat_ws(" ", "before", "after").rlike(_NUMBER_WORDS).cast("double"),
        "f_words_beside": F.regexp_count(F.concat_ws(" ", "before", "after"), F.lit(r"\p{L}{2,}")).cast("double"),
        "f_words_after": F.regexp_count("after", F.lit(r"\p{L}{2,}")).cast("double"),
        "f_path_test": F.col("path").rlike(_TEST_PATH).cast("double"),
        "f_path_digits": F.regexp_count("path", F.lit("[0-9]")).cast("double"),
        "f_path_length": F.length("path").cast("double"),
    }
    for name, c in _CLASSES.items():
        cols[f"f_{name}"] = _share(c)
        for to, d in _CLASSES.items():
            if to != name:
                cols[f"f_{name}_{to}"] = _share(f"{c}(?={d})")
    return out.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in cols.items()}).drop("covered"), list(cols)


#: The features that `rule_labels` decides by, or that say nearly the same.
RULE_FEATURES = ("f_key_before", "f_assigned", "f_quoted", "f_secret_words", "f_words_beside")


def _luhn(digits):
    """Whether a string of digits passes the check-digit rule."""
    at = F.sequence(F.lit(1), F.length(digits))
    value = F.transform(at, lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (1 + (i + 1) % 2))
    total = F.aggregate(value, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0))
    return total % 10 == 0


def rule_labels(found: DataFrame) -> DataFrame:
    """``found`` with a column label: 1 secret, 0 harmless, null undecided.

    Secret: a provider's form (fixed prefixes) or the value of an assignment to a name such as
    password or token, unless it is a placeholder or letters of one case alone. Harmless: numbers with a
    right check digit, UUIDs, placeholders, and runs of letters closed by few digits.
    """
    f = F.col("finding")
    provider = f.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^xox[abprs]-|^AIza[A-Za-z0-9_-]{35}$|^sk_live_")
    placeholder = f.rlike(r"(?i)example|placeholder|your[_-]|xxxx|changeme|^(.)\1+$|0123456789|123456789")
    uuid = f.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    number = f.rlike("^[0-9]{12,19}$")
    prose = f.rlike("^[A-Za-z]{12,}[0-9]{1,4}$") | f.rlike(r"^[a-z]+([_/-][a-z]+)+[_/-]?[0-9]{1,4}$")
    harmless = placeholder | uuid | (number & _luhn(F.when(number, f).otherwise("0"))) | prose
    mixed = ~f.rlike("^([a-z]+|[A-Z]+|[A-Z][a-z]+)[.!?:]*$")
    secret = provider | (F.col("before").rlike(_KEY_BEFORE) & mixed)
    return found.withColumn("label", F.when(harmless, 0.0).when(secret, 1.0))


def train(labelled: DataFrame, names: list[str], max_rows: int = MAX_LABELLED, trees: int = 40, seed: int = 9) -> RandomForestClassificationModel | None:
    """Fit the forest on findings with label 0 or 1, at most ``max_rows`` of each; None unless both occur.

    Each label is sampled by itself, over distinct (finding, before, after): neither a rare label
    nor findings beside a hot group of copies drop out.
    """
    key = ["finding", "before", "after"]
    known = labelled.filter("label is not null").groupBy("label", *key).agg(F.min(F.struct(*names)).alias("features"))
    known = stage(known.select("label", *key, "features.*"), "known-findings")
    rows = hash_sample(known.filter("label = 1"), key, max_rows).unionByName(
        hash_sample(known.filter("label = 0"), key, max_rows)).select("label", *names)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("label", "features")
    rows = stage(rows, "labelled-findings")
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed, subsamplingRate=0.7).fit(rows)


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """All findings of all documents: doc_id, start, end, finding, score, is_secret.

    ``labelled`` is a table like that of `findings` with a column label; without it the rules
    label the corpus's own findings, and the forest judges all of them without RULE_FEATURES. Without both labels among them every finding scores 1, as
    nothing is known to remove. Null and empty texts have no findings; null ids and paths are
    kept as they are; repeated rows are answered each; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    found = stage(findings(docs, id_col, text_col, path_col), "findings")
    full, names = with_features(found, docs, text_col)
    full = stage(full, "finding-features")
    if labelled is None:
        given, names = rule_labels(full), [n for n in names if n not in RULE_FEATURES]
    else:
        given = with_features(labelled, docs, text_col)[0]
    model = train(given, names)
    if model is None:
        score = F.lit(1.0)
        scored = full.withColumn("score", score)
    else:
        ready = VectorAssembler(inputCols=names, outputCol="features").transform(full)
        scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "end", "finding", "score", (F.col("score") >= threshold).alias("is_secret"))
