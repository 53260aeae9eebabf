"""Stand-in tables derived from the driver tables.

No driver table holds audio, tensors or tokens, so each query derives the
table it needs from ``documents``, ``embeddings``, ``events`` or
``conversations`` by a fixed rule. Each rule is written twice, side by side:
as a Spark builder and as a SQL CTE for the DuckDB twin. Everything here is
per-row arithmetic or a scalable operator from the library, so its work
grows with the tables.

The modulo rules on ids (``doc_id % 10`` is the validation phase, ``% 17``
has no clip, ``vec_id % 50`` is missing from the tuned checkpoint, ...)
decide *what the stand-in data says*, as set out in FIXTURES.md. None of them
reduces the work: every query reads and processes all rows of its tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import idiv
from .functions.arrays import char_codes
from .plans.prefix import row_index, time_bucket

OLD_ROOT = "/old/root/"
NEW_ROOT = "/data/clips/"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------ documents

def phase_col(doc_id="doc_id"):
    return F.when(F.col(doc_id) % 10 == 0, F.lit("val")).otherwise(F.lit("train"))


def old_path(root: str = OLD_ROOT):
    return F.concat(F.lit(root), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav"))


def manifest_lines(spark, sf) -> DataFrame:
    """``(line_no, phase, value)`` manifest lines ``path|text``, newlines in text made blanks."""
    from .functions.text import manifest_line
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("line_no"), phase_col().alias("phase"),
                    manifest_line(old_path(), F.col("text")).alias("value"))


def n_samples_col():
    return F.col("n_chars") * 100 + (F.col("doc_id") % 7) * 60000


def clips(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.filter(F.col("doc_id") % 17 != 0).select(
        old_path(NEW_ROOT).alias("audio_path"), F.col("source").alias("speaker"),
        F.lit(22050).alias("sample_rate"), n_samples_col().alias("n_samples"))


def codes_col():
    n = idiv(F.col("n_chars"), F.lit(8)) + 3  # a code for every 8 characters of the whole text
    did = F.col("doc_id")

    def at(i):
        return (F.when((did % 3 == 0) & (i == idiv(n, F.lit(2))), F.lit(8193))
                .when((i + did) % 40 < did % 13, F.lit(83))
                .otherwise((i * 31 + did * 7) % 8192)).cast("int")

    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), at)


def codes(spark, sf) -> DataFrame:
    from .plans.joins import spread
    return spread(table(spark, sf, "documents").select("doc_id", "n_chars")).select("doc_id", "n_chars", codes_col().alias("codes"))


# ------------------------------------------------------------------ embeddings

def base_tensors(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    bias = F.col("vec_id") % 25 == 0
    name = F.concat(F.lit("gpt.h."), F.col("label").cast("string"), F.lit(".mlp."),
                    F.when(F.col("vec_id") % 2 == 0, F.lit("c_fc")).otherwise(F.lit("c_proj")),
                    F.when(bias, F.lit(".bias")).otherwise(F.lit("")))
    kind = F.when(F.col("label") % 3 == 0, F.lit("Conv1D")).when(F.col("label") % 3 == 1, F.lit("Linear")).otherwise(F.lit("LayerNorm"))
    return e.select(name.alias("tensor"), kind.alias("kind"), F.col("vec_id").cast("int").alias("row"),
                    F.when(bias, 1).otherwise(2).alias("ndim"),
                    F.array(F.size("embedding")).alias("shape"), F.lit("float16").alias("dtype"),
                    F.col("embedding").alias("values"), "vec_id", "label")


def tuned_tensors(spark, sf) -> DataFrame:
    b = base_tensors(spark, sf).filter(F.col("vec_id") % 50 != 0)
    bumped = F.concat(F.array((F.col("values")[0] + F.lit(1)).cast("float")),
                      F.slice("values", 2, 2147483647))
    return b.withColumn("values", F.when(F.col("label") == 3, bumped).otherwise(F.col("values")))


def given_tensors(spark, sf) -> DataFrame:
    """Tuned tensors with some rows cut short (shape mismatch) and some extra rows (unexpected)."""
    t = tuned_tensors(spark, sf)
    short = F.col("vec_id") % 23 == 0
    t = t.withColumn("values", F.when(short, F.slice("values", 1, 63)).otherwise(F.col("values")))
    t = t.withColumn("shape", F.array(F.size("values")))
    extra = t.filter(F.col("vec_id") % 31 == 0).withColumn("row", F.col("row") + 100000)
    return t.unionByName(extra)


# ------------------------------------------------------------------ events

def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events")


def step_losses(spark, sf) -> DataFrame:
    """(run_id, step, loss_text_ce, loss_mel_ce): step = 1-based rank by (ts, event_id) per user."""
    ev = events(spark, sf).select(F.col("user_id").alias("run_id"), "ts", "event_id", "value")
    ev = row_index(ev, ["ts", "event_id"], time_bucket("ts", 3600), ["run_id"], out="__i")
    return ev.select("run_id", (F.col("__i") + 1).alias("step"), F.col("value").alias("loss_text_ce"),
                     (F.col("value") / 10).alias("loss_mel_ce"), "ts", "event_id")


def scores(spark, sf) -> DataFrame:
    ev = events(spark, sf)
    exact_sum = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return ev.groupBy(F.col("user_id").alias("request_id"), F.col("event_type").alias("token")).agg(
        (exact_sum / F.count(F.lit(1)) / 100).alias("score"))


# ------------------------------------------------------------------ conversations

def requests(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    preset = (F.when(F.col("conv_id") % 3 == 0, F.lit("ultra_fast"))
              .when(F.col("conv_id") % 3 == 1, F.lit("high_quality")))
    ov = F.when(F.col("turn") % 4 == 0, F.create_map(F.lit("temperature"), F.lit("0.5"))).otherwise(
        F.create_map().cast("map<string,string>"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "conv_id", "turn", "text",
                    preset.alias("preset"), ov.alias("overrides"))


def conversation_examples(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", char_codes(F.col("text")).alias("tokens"))


# ------------------------------------------------------------------ SQL twins of the rules above

SQL_MANIFEST = """man AS (
  SELECT doc_id AS line_no, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS phase,
         '/old/root/' || source || '/' || CAST(doc_id AS VARCHAR) || '.wav|' || replace(text, chr(10), ' ') AS line,
         doc_id, source, n_chars
  FROM documents),
parsed AS (
  SELECT line_no, phase, doc_id, source, n_chars,
         substr(line, 1, strpos(line, '|') - 1) AS audio_path, substr(line, strpos(line, '|') + 1) AS text
  FROM man WHERE strpos(line, '|') > 0)"""

SQL_CLIPS = """clips AS (
  SELECT '/data/clips/' || source || '/' || CAST(doc_id AS VARCHAR) || '.wav' AS audio_path,
         source AS speaker, 22050 AS sample_rate, n_chars * 100 + (doc_id % 7) * 60000 AS n_samples
  FROM documents WHERE doc_id % 17 <> 0)"""

SQL_CODES = """codes AS (
  SELECT doc_id, n_chars,
         list_transform(range(n_chars // 8 + 3), lambda i: CAST(CASE
             WHEN doc_id % 3 = 0 AND i = (n_chars // 8 + 3) // 2 THEN 8193
             WHEN (i + doc_id) % 40 < doc_id % 13 THEN 83
             ELSE (i * 31 + doc_id * 7) % 8192 END AS INTEGER)) AS codes
  FROM documents)"""

SQL_BASE = """base AS (
  SELECT 'gpt.h.' || CAST(label AS VARCHAR) || '.mlp.' || CASE WHEN vec_id % 2 = 0 THEN 'c_fc' ELSE 'c_proj' END
           || CASE WHEN vec_id % 25 = 0 THEN '.bias' ELSE '' END AS tensor,
         CASE label % 3 WHEN 0 THEN 'Conv1D' WHEN 1 THEN 'Linear' ELSE 'LayerNorm' END AS kind, CAST(vec_id AS INTEGER) AS "row", CASE WHEN vec_id % 25 = 0 THEN 1 ELSE 2 END AS ndim,
         [CAST(len(embedding) AS INTEGER)] AS shape, 'float16' AS dtype, embedding AS "values", vec_id, label
  FROM embeddings)"""

SQL_TUNED = """tuned AS (
  SELECT tensor, kind, "row", ndim, shape, dtype, vec_id, label,
         CASE WHEN label = 3 THEN list_concat([CAST("values"[1] + 1 AS FLOAT)], "values"[2:]) ELSE "values" END AS "values"
  FROM base WHERE vec_id % 50 <> 0)"""

SQL_GIVEN = """given0 AS (
  SELECT tensor, "row", vec_id,
         CASE WHEN vec_id % 23 = 0 THEN list_slice("values", 1, 63) ELSE "values" END AS "values"
  FROM tuned),
given AS (
  SELECT tensor, "row", [CAST(len("values") AS INTEGER)] AS shape FROM given0
  UNION ALL
  SELECT tensor, "row" + 100000, [CAST(len("values") AS INTEGER)] FROM given0 WHERE vec_id % 31 = 0)"""

SQL_STEPS = """steps AS (
  SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS step,
         value AS loss_text_ce, value / 10 AS loss_mel_ce, ts, event_id
  FROM events)"""

SQL_SCORES = """scores AS (
  SELECT user_id AS request_id, event_type AS token,
         CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*) / 100 AS score
  FROM events GROUP BY 1, 2)"""

SQL_REQUESTS = """req AS (
  SELECT conv_id * 1000 + turn AS request_id, conv_id, turn, text,
         CASE WHEN conv_id % 3 = 0 THEN 'ultra_fast' WHEN conv_id % 3 = 1 THEN 'high_quality' END AS preset
  FROM conversations WHERE role = 'user')"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
