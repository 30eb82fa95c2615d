"""Language detection (X17-X19) and size guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File extension -> language name (then normalised through the alias table).
EXTENSIONS = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java", "c": "c",
              "cpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala",
              "r": "r", "sql": "sql", "sh": "bash", "ps1": "powershell"}
# Alias normalisation.
ALIASES = {"python": "python", "python3": "python", "py": "python", "javascript": "javascript", "js": "javascript",
           "typescript": "typescript", "ts": "typescript", "go": "go", "rust": "rust", "java": "java", "c": "c", "cpp": "cpp",
           "c++": "cpp", "csharp": "csharp", "c#": "csharp", "ruby": "ruby", "php": "php", "swift": "swift", "kotlin": "kotlin",
           "scala": "scala", "r": "r", "sql": "sql", "shell": "shell", "bash": "shell", "powershell": "powershell"}
SUPPORTED = ["python"]
# Keyword weights for the content-based guess of a natural language.
TEXT_KEYWORDS = {
    "en": ["the", "and", "of", "to", "is", "with", "this", "are"],
    "fr": ["le", "la", "les", "des", "et", "est", "une", "du"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "mit"],
    "es": ["el", "los", "las", "que", "y", "es", "por", "con"],
}
# Keywords for the content-based guess of a programming language.
CODE_KEYWORDS = {"python": ["def", "import", "self", "elif", "None"], "javascript": ["function", "const", "let", "var"]}
# Extension of every generated file, by rule, so the corpus mixes languages.
EXT_CYCLE = ["py", "js", "ts", "go", "rb", "txt", "py"]
MAX_FILE_BYTES = 1_048_576
MAX_LLM_LOC = 200


def ext_table(spark: SparkSession) -> DataFrame:
    rows = [(e, ALIASES.get(n, n)) for e, n in EXTENSIONS.items()]
    return spark.createDataFrame(rows, "ext string, language string")


def keyword_table(spark: SparkSession, table: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(w, lang, 1.0) for lang, ws in table.items() for w in ws], "word string, lang string, weight double")


def mixed_paths(files: DataFrame) -> DataFrame:
    """The generated corpus with extensions varied by ``file_id % 7``."""
    ext = F.element_at(F.array(*[F.lit(e) for e in EXT_CYCLE]), (F.col("file_id") % len(EXT_CYCLE) + 1).cast("int"))
    return files.select("file_id", F.regexp_replace("path", r"\.py$", "").alias("stem"), ext.alias("ext"), "content") \
        .select("file_id", F.concat_ws(".", "stem", "ext").alias("path"), "content")


def keyword_guess(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, table: dict[str, list[str]]) -> DataFrame:
    """Argmax of summed keyword weights per text; ties broken by language name; no hit -> 'unknown'."""
    toks = docs.select(id_col, F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}_]+")).alias("word"))
    kw = keyword_table(spark, {k: [w.lower() for w in v] for k, v in table.items()})
    score = toks.join(F.broadcast(kw), "word").groupBy(id_col, "lang").agg(F.sum("weight").alias("score"))
    best = score.groupBy(id_col).agg(F.min_by("lang", F.struct(-F.col("score"), F.col("lang"))).alias("guess"))
    return docs.select(id_col, text_col).join(best, id_col, "left").select(
        id_col, F.when(F.trim(F.col(text_col)) == "", F.lit("unknown")).otherwise(F.coalesce("guess", F.lit("unknown"))).alias("guess"))


def detect(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Language by extension through the alias table; unknown extensions fall back to a keyword guess."""
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    f = files.select("file_id", "path", "content", ext.alias("ext"))
    by_ext = f.join(F.broadcast(ext_table(spark)), "ext", "left")
    guess = keyword_guess(spark, f.select("file_id", "content"), "file_id", "content", CODE_KEYWORDS)
    return by_ext.join(guess, "file_id").select(
        "file_id", "path", F.coalesce("language", "guess").alias("language"),
        F.when(F.col("language").isNotNull(), "extension").otherwise("content").alias("method"))


def size_guards(files: DataFrame, functions_m: DataFrame) -> DataFrame:
    """Files over the byte limit and functions over the line limit for costly checks, counted by reason."""
    big = files.filter(F.octet_length("content") > MAX_FILE_BYTES).select(F.lit("file_too_large").alias("reason"))
    long_fn = functions_m.filter(F.col("loc") > MAX_LLM_LOC).select(F.lit("function_too_long").alias("reason"))
    ok_fn = functions_m.filter(F.col("loc") <= MAX_LLM_LOC).select(F.lit("function_checked").alias("reason"))
    return big.unionByName(long_fn).unionByName(ok_fn).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
