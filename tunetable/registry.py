"""Registered queries: one per operator, each with its DuckDB twin where SQL can express it.

Every query reads the driver tables under ``sf`` (or tables Spark derives
from them), runs on the whole tables, and ends in a projection with fixed
column names and types that the SQL twin reproduces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import standins as S
from .functions import arrays as A
from .functions import idiv
from .functions import lengths as LN
from .functions import text as TX
from .operators import batching, codes as CO, decoding as DE, manifest as MA, metrics as ME, tensors as TE
from .plans.joins import spread
from .plans.prefix import int_bucket
from .resources import default_tokenizer_path

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf, fn=fn):
            from .session import ship_package
            ship_package(spark)
            return fn(spark, sf.rstrip("/"))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        Q[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco


def r6(c):
    """Round to 6 decimals as ``round(x * 1e6) / 1e6`` (the twin engine's rule, so ties agree)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") * F.lit(1e6), 0) / F.lit(1e6)


def cents(c):
    """2-decimal measurements as exact decimals, so sums do not depend on summation order."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(18,2)")


def aj(c):
    """int array -> 'a,b,c' (identical text in Spark and DuckDB)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c, ",")


def long_(c):
    return (F.col(c) if isinstance(c, str) else c).cast("long")


_PLACED_SQL = """CAST(list_sum(list_transform("values", lambda x, i: CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT) * i)) AS BIGINT)"""


def placed(c):
    """Every value of an array, in millionths, times its place: an exact sum that a changed or moved value changes."""
    return F.aggregate(F.transform(c, lambda x, i: F.round(x.cast("double") * F.lit(1e6), 0).cast("long") * (i + 1)),
                       F.lit(0).cast("long"), lambda a, x: a + x)


# =================================================================== sources

@query("manifest_parse", S.with_sql(S.SQL_MANIFEST) + """
SELECT line_no, audio_path, text FROM parsed""")
def q_manifest_parse(spark, sf):
    from .sources.manifest import parse_manifest
    parsed, _rej = parse_manifest(S.manifest_lines(spark, sf), "value", "|", keep=("line_no",))
    return parsed.select(long_("line_no").alias("line_no"), "audio_path", "text")


@query("manifest_union", S.with_sql(S.SQL_MANIFEST) + """
SELECT phase, line_no, audio_path, CAST(length(text) AS BIGINT) AS n_text_chars FROM parsed""")
def q_manifest_union(spark, sf):
    from .sources.manifest import parse_manifest, union_manifests
    lines = S.manifest_lines(spark, sf)
    parts = []
    for ph in ("train", "val"):
        p, _ = parse_manifest(lines.filter(F.col("phase") == ph), "value", "|", keep=("line_no",))
        parts.append(p.withColumn("phase", F.lit(ph)))
    u = union_manifests(parts)
    return u.select("phase", long_("line_no").alias("line_no"), "audio_path",
                    long_(F.length("text")).alias("n_text_chars"))


@query("corpus_scan", "SELECT doc_id, text FROM documents")
def q_corpus_scan(spark, sf):
    from .sources.corpus import read_corpus
    return read_corpus(spark, f"{sf}/documents.parquet")


@query("object_catalog")
def q_object_catalog(spark, sf):
    from .sources.corpus import catalog_objects
    return catalog_objects(spark, sf, "*.parquet")


#: ``normalise_text`` in SQL, as ``norm`` of each document.
_NORM_SQL = """norm AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text FROM documents)"""


def bpe_sql(path: str, texts: str, key: str) -> str:
    """CTEs that tokenise ``texts(key, text)``: ``piece(key, word)`` of every occurrence and ``tok(word, token, id)``
    of every distinct word, from a byte-level tokenizer file with an end-of-word mark."""
    import json
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
    pattern = pattern.replace("[^\\s", "[^\\s\\x{85}\\p{Z}").replace("'", "''")  # white space of Unicode
    end, o, c = spec["model"]["end_of_word_suffix"], chr(0xFDD0), chr(0xFDD1)
    return f"""file AS (SELECT content FROM read_text('{path}')),
rule AS (SELECT unnest(from_json(json_extract(content, '$.model.merges'), '[["VARCHAR"]]')) AS m,
                generate_subscripts(from_json(json_extract(content, '$.model.merges'), '[["VARCHAR"]]'), 1) AS rank FROM file),
merge AS (SELECT rank, m[1] || chr(2) || m[2] AS pair, m[1] || m[2] AS made FROM rule),
vocab AS (SELECT unnest(json_keys(content, '$.model.vocab')) AS token, CAST(unnest(json_extract(content, '$.model.vocab.*')) AS INTEGER) AS id FROM file),
piece AS (SELECT {key}, unnest(regexp_extract_all(text, '{pattern}')) AS word FROM {texts}),
hexed AS (SELECT DISTINCT word, list_transform(regexp_extract_all(hex(word), '..'), lambda h: CAST('0x' || h AS INTEGER)) AS bs FROM piece),
sym AS (SELECT word, list_transform(bs, lambda b: chr(CASE WHEN b <= 32 THEN 256 + b WHEN b BETWEEN 127 AND 160 THEN 162 + b WHEN b = 173 THEN 323 ELSE b END)) AS cs FROM hexed),
part AS (SELECT DISTINCT word, array_to_string(list_slice(cs, i, j), '') || CASE WHEN j = len(cs) THEN '{end}' ELSE '' END AS made
         FROM (SELECT word, cs, i, unnest(range(i + 1, least(len(cs), i + 31) + 1)) AS j FROM (SELECT word, cs, unnest(range(1, len(cs))) AS i FROM sym))),
own AS (SELECT word, list(pair ORDER BY rank) AS ms FROM part JOIN merge USING (made) GROUP BY word),
done AS (SELECT sym.word, list_reduce(list_prepend('{o}' || array_to_string(cs, '{c}{o}') || '{end}{c}', coalesce(ms, [])),
                lambda s, m: replace(s, '{o}' || replace(m, chr(2), '{c}{o}') || '{c}', '{o}' || replace(m, chr(2), '') || '{c}')) AS s
         FROM sym LEFT JOIN own USING (word)),
tok AS (SELECT word, t.token, vocab.id FROM (SELECT word, unnest(string_split(s[2:-2], '{c}{o}')) AS token FROM done) t JOIN vocab USING (token))"""


_BPE_SQL = bpe_sql(default_tokenizer_path(), "norm", "doc_id")


@query("vocab_usage", f"""WITH {_NORM_SQL},
{_BPE_SQL},
n AS (SELECT word, count(*) AS n FROM piece GROUP BY word)
SELECT CAST(id AS INTEGER) AS id, any_value(token) AS token, CAST(sum(n) AS BIGINT) AS n FROM tok JOIN n USING (word) GROUP BY id""")
def q_vocab_usage(spark, sf):
    """S4 and F2 as relations: distinct pieces meet the merges in joins."""
    from .functions.bpe import load_tokenizer
    from .functions.bpe_tables import token_usage
    from .sources.vocab import read_vocab
    vocab, merges = read_vocab(spark)
    docs = spread(S.table(spark, sf, "documents").select("text")).select(TX.normalise_text("text").alias("text"))
    return token_usage(docs, "text", load_tokenizer(default_tokenizer_path()), vocab, merges).join(vocab, "id", "left").select("id", "token", "n")


@query("tensor_scan", S.with_sql(S.SQL_BASE, S.SQL_TUNED) + """
SELECT tensor, "row", CAST(len("values") AS BIGINT) AS n_values, round(CAST("values"[1] AS DOUBLE), 6) AS first_value,
       """ + _PLACED_SQL + """ AS value_check
FROM tuned WHERE starts_with(tensor, 'gpt.h.3.')""")
def q_tensor_scan(spark, sf):
    from .session import scratch_path
    from .sources.tensors import read_tensors, write_tensors
    path = scratch_path(spark, "tensor_scan")
    cols = ["tensor", "kind", "row", "ndim", "shape", "dtype", "values"]
    write_tensors(S.base_tensors(spark, sf).select(*cols), path, run_id=1, step=10)
    write_tensors(S.tuned_tensors(spark, sf).select(*cols), path, run_id=1, step=20)
    t = read_tensors(spark, path, run_id=1, step=20, tensor_prefix="gpt.h.3.")
    return t.select("tensor", "row", long_(F.size("values")).alias("n_values"),
                    r6(F.col("values")[0]).alias("first_value"), placed("values").alias("value_check"))


@query("adapter_roundtrip", S.with_sql(S.SQL_BASE) + """
SELECT tensor, "row", CAST(len("values") AS BIGINT) AS n_values, """ + _PLACED_SQL + """ AS value_check,
       16 AS r, 32 AS lora_alpha, true AS fan_in_fan_out
FROM base WHERE string_split(tensor, '.')[-1] = 'c_fc'""")
def q_adapter_roundtrip(spark, sf):
    from .session import scratch_path
    from .sources.tensors import read_adapter, write_adapter
    path = scratch_path(spark, "adapter")
    t = TE.target_modules(S.base_tensors(spark, sf), ["c_fc"]).select("tensor", "row", "values")
    cfg = {"peft_type": "LORA", "r": 16, "lora_alpha": 32, "lora_dropout": 0.05, "bias": "none",
           "fan_in_fan_out": True, "target_modules": ["c_attn", "c_fc", "c_proj"],
           "modules_to_save": ["lm_head"], "rank_pattern": {}, "alpha_pattern": {}, "task_type": "CAUSAL_LM"}
    write_adapter(t, cfg, path, "a1")
    tens, conf = read_adapter(spark, path, "a1")
    return tens.join(F.broadcast(conf.select("adapter_id", "r", "lora_alpha", "fan_in_fan_out")), "adapter_id").select(
        "tensor", "row", long_(F.size("values")).alias("n_values"), placed("values").alias("value_check"), "r", "lora_alpha",
        "fan_in_fan_out")


# =================================================================== projections / filters

@query("rewrite_prefix", S.with_sql(S.SQL_MANIFEST) + """
SELECT line_no, CASE WHEN starts_with(audio_path, '/old/root/') THEN '/data/clips/' || substr(audio_path, 11)
                     ELSE audio_path END AS audio_path
FROM parsed""")
def q_rewrite_prefix(spark, sf):
    from .sources.manifest import parse_manifest
    p, _ = parse_manifest(S.manifest_lines(spark, sf), keep=("line_no",))
    return p.select(long_("line_no").alias("line_no"),
                    TX.rewrite_prefix("audio_path", S.OLD_ROOT, S.NEW_ROOT).alias("audio_path"))


@query("normalise_delimiter", S.with_sql(S.SQL_MANIFEST) + """
SELECT line_no, replace(replace(line, '|', chr(9)), chr(9) || ' ', chr(9)) AS line FROM man""")
def q_normalise_delimiter(spark, sf):
    m = S.manifest_lines(spark, sf)
    return m.select(long_("line_no").alias("line_no"), TX.normalise_delimiter("value").alias("line"))


@query("merge_columns", """
WITH t AS (
  SELECT d.doc_id, d.text,
         list_sort(list_filter([d.lang, CASE WHEN l.quality = 1 THEN 'quality' END,
                                CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)) AS tags
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, text || ' ->: [' || array_to_string(list_transform(tags, lambda x: chr(39) || x || chr(39)), ', ') || ']' AS prediction
FROM t""")
def q_merge_columns(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", "text", "lang")
    lab = S.table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    tags = F.array_sort(F.filter(F.array(F.col("lang"), F.when(F.col("quality") == 1, F.lit("quality")),
                                         F.when(F.col("toxic") == 1, F.lit("toxic"))), lambda x: x.isNotNull()))
    return j.select("doc_id", TX.merge_columns("text", tags).alias("prediction"))


_LEN_SQL = """lens AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS phase,
         n_chars // 10 AS text_len, n_chars * 100 + (doc_id % 7) * 60000 AS wav_len
  FROM documents)"""


def _lengths(spark, sf):
    d = S.table(spark, sf, "documents")
    return d.select("doc_id", S.phase_col().alias("phase"), idiv(F.col("n_chars"), F.lit(10)).alias("text_len"),
                    S.n_samples_col().alias("wav_len"))


@query("length_filter", S.with_sql(_LEN_SQL) + """
SELECT doc_id, phase, text_len, wav_len,
       CASE WHEN text_len > (CASE phase WHEN 'train' THEN 350 ELSE 200 END) THEN 'text_too_long'
            WHEN wav_len > (CASE phase WHEN 'train' THEN 551250 ELSE 286715 END) THEN 'wav_too_long' END AS reason
FROM lens""")
def q_length_filter(spark, sf):
    out = MA.label_by_length(_lengths(spark, sf), MA.phase_limits(spark))
    return out.select(long_("doc_id").alias("doc_id"), "phase", long_("text_len").alias("text_len"),
                      long_("wav_len").alias("wav_len"), "reason")


_MODULES_PATTERN = r".*\.(4|5|6|7|8|9|10)\.mlp\.(c_proj|c_fc)"


@query("target_modules_list", S.with_sql(S.SQL_BASE) + """
SELECT tensor, "row" FROM base WHERE string_split(tensor, '.')[-1] IN ('c_attn', 'c_fc')""")
def q_target_modules_list(spark, sf):
    return TE.target_modules(S.base_tensors(spark, sf), ["c_attn", "c_fc"]).select("tensor", "row")


@query("target_modules_regex", S.with_sql(S.SQL_BASE) + f"""
SELECT tensor, "row" FROM base WHERE regexp_full_match(tensor, '{_MODULES_PATTERN}')""")
def q_target_modules_regex(spark, sf):
    return TE.target_modules_regex(S.base_tensors(spark, sf), _MODULES_PATTERN).select("tensor", "row")


@query("module_component", S.with_sql(S.SQL_BASE) + """
SELECT tensor, "row", coalesce(string_split(tensor, '.')[5], '') AS component,
       coalesce(string_split(tensor, '.')[6], '') AS component5
FROM base""")
def q_module_component(spark, sf):
    b = S.base_tensors(spark, sf)
    return b.select("tensor", "row", TE.module_component("tensor", 4).alias("component"),
                    TE.module_component("tensor", 5).alias("component5"))


@query("distinct_components", S.with_sql(S.SQL_BASE) + """
SELECT DISTINCT coalesce(string_split(tensor, '.')[5], '') AS component FROM base
WHERE kind IN ('Linear', 'Embedding', 'Conv2d', 'Conv1D')""")
def q_distinct_components(spark, sf):
    return TE.distinct_components(S.base_tensors(spark, sf), depth=4)


@query("distinct_layers", S.with_sql(S.SQL_BASE) + """
SELECT DISTINCT coalesce(string_split(tensor, '.')[3], '') AS component FROM base
WHERE kind IN ('Linear', 'Embedding', 'Conv2d', 'Conv1D')""")
def q_distinct_layers(spark, sf):
    """A8 at the depth of the layer number: layers of other kinds are left out."""
    return TE.distinct_components(S.base_tensors(spark, sf), depth=2)


@query("mark_trainable", S.with_sql(S.SQL_BASE) + """
SELECT tensor, "row", list_contains(string_split(tensor, '.'), 'c_proj') AS trainable,
       CASE WHEN ndim = 1 THEN 'float32' ELSE dtype END AS dtype
FROM base""")
def q_mark_trainable(spark, sf):
    m = TE.mark_trainable(S.base_tensors(spark, sf), modules_to_save=["c_proj"])
    return m.select("tensor", "row", "trainable", "dtype")


@query("cadence_flags", S.with_sql(S.SQL_STEPS) + """
SELECT run_id, step, step % 20 = 0 AS is_save_checkpoint, step % 15 = 0 AS is_validate,
       step % 10 = 0 AS is_visuals, step % 5 = 0 AS is_log
FROM steps""")
def q_cadence_flags(spark, sf):
    every = {"save_checkpoint": 20, "validate": 15, "visuals": 10, "log": 5}  # within reach of the shortest runs
    s = ME.cadence_flags(S.step_losses(spark, sf), "step", every)
    return s.select(long_("run_id").alias("run_id"), long_("step").alias("step"), "is_save_checkpoint",
                    "is_validate", "is_visuals", "is_log")


_PRESETS_SQL = """d(key, value) AS (VALUES ('temperature', '0.8'), ('length_penalty', '1.0'),
    ('repetition_penalty', '2.0'), ('top_p', '0.8'), ('cond_free_k', '2.0'), ('diffusion_temperature', '1.0')),
p(preset, key, value) AS (VALUES ('ultra_fast', 'num_autoregressive_samples', '1'),
    ('ultra_fast', 'diffusion_iterations', '30'), ('ultra_fast', 'cond_free', 'False'),
    ('high_quality', 'num_autoregressive_samples', '1'), ('high_quality', 'diffusion_iterations', '30'))"""


@query("resolve_settings", S.with_sql(S.SQL_REQUESTS, _PRESETS_SQL) + """,
allk AS (
  SELECT r.request_id, d.key, d.value, 1 AS lvl FROM req r CROSS JOIN d
  UNION ALL SELECT r.request_id, p.key, p.value, 2 FROM req r JOIN p ON r.preset = p.preset
  UNION ALL SELECT request_id, 'temperature', '0.5', 3 FROM req WHERE turn % 4 = 0)
SELECT request_id, key, arg_max(value, lvl) AS value FROM allk GROUP BY request_id, key""")
def q_resolve_settings(spark, sf):
    r = DE.resolve_settings(S.requests(spark, sf), DE.presets_table(spark))
    return r.select(long_("request_id").alias("request_id"), F.explode("settings").alias("key", "value"))


# =================================================================== joins

def _rewritten_manifest(spark, sf):
    from .sources.manifest import parse_manifest
    p, _ = parse_manifest(S.manifest_lines(spark, sf), keep=("line_no", "phase"))
    return p.withColumn("audio_path", TX.rewrite_prefix("audio_path", S.OLD_ROOT, S.NEW_ROOT))


_REWRITTEN_SQL = """rw AS (
  SELECT line_no, phase, '/data/clips/' || substr(audio_path, 11) AS audio_path, text FROM parsed)"""


@query("pair_clips", S.with_sql(S.SQL_MANIFEST, _REWRITTEN_SQL, S.SQL_CLIPS) + """
SELECT rw.line_no, rw.audio_path, clips.speaker, clips.n_samples FROM rw JOIN clips USING (audio_path)""")
def q_pair_clips(spark, sf):
    paired, _ = MA.pair_clips(_rewritten_manifest(spark, sf), S.clips(spark, sf))
    return paired.select(long_("line_no").alias("line_no"), "audio_path", "speaker", long_("n_samples").alias("n_samples"))


@query("pair_clips_missing", S.with_sql(S.SQL_MANIFEST, _REWRITTEN_SQL, S.SQL_CLIPS) + """
SELECT rw.line_no, rw.audio_path FROM rw WHERE NOT EXISTS (SELECT 1 FROM clips c WHERE c.audio_path = rw.audio_path)""")
def q_pair_clips_missing(spark, sf):
    _, missing = MA.pair_clips(_rewritten_manifest(spark, sf), S.clips(spark, sf))
    return missing.select(long_("line_no").alias("line_no"), "audio_path")


@query("conditioning_candidates", """
WITH m AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS phase, source AS speaker
  FROM documents),
n AS (
  SELECT doc_id, phase, speaker,
         row_number() OVER (PARTITION BY phase, speaker ORDER BY doc_id) - 1 AS rn,
         count(*) OVER (PARTITION BY phase, speaker) AS cnt,
         CASE WHEN phase = 'train' THEN 3 ELSE 2 END AS k
  FROM m)
SELECT a.doc_id, CAST(r.j AS INTEGER) AS cond_rank, b.doc_id AS cond_id
FROM n a CROSS JOIN range(1, 4) r(j)
JOIN n b ON b.phase = a.phase AND b.speaker = a.speaker AND b.rn = (a.rn + r.j) % a.cnt
WHERE r.j <= least(a.k, a.cnt - 1)""")
def q_conditioning_candidates(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", S.phase_col().alias("phase"),
                                                F.col("source").alias("speaker"))
    lim = F.broadcast(MA.phase_limits(spark).select("phase", "n_cond"))  # constant two-row table
    d = d.join(lim, "phase")
    c = MA.conditioning_candidates(d, ["phase", "speaker"], "doc_id", F.col("n_cond"), max_k=3, width=64, chunk=8)
    return c.select(long_("doc_id").alias("doc_id"), F.col("cond_rank").cast("int").alias("cond_rank"),
                    long_("cond_id").alias("cond_id"))


@query("changed_tensors", S.with_sql(S.SQL_BASE, S.SQL_TUNED) + """
SELECT b.tensor, count(*) AS n_rows, count(*) FILTER (WHERE b."values" <> t."values") AS n_changed,
       bool_or(b."values" <> t."values") AS changed
FROM base b JOIN tuned t ON b.tensor = t.tensor AND b."row" = t."row" GROUP BY b.tensor""")
def q_changed_tensors(spark, sf):
    c = TE.changed_tensors(S.base_tensors(spark, sf), S.tuned_tensors(spark, sf))
    return c.select("tensor", long_("n_rows").alias("n_rows"), long_("n_changed").alias("n_changed"), "changed")


@query("changed_tensors_stored", S.with_sql(S.SQL_BASE, S.SQL_TUNED) + """
SELECT b.tensor, count(*) AS n_rows, count(*) FILTER (WHERE b."values" <> t."values") AS n_changed,
       bool_or(b."values" <> t."values") AS changed
FROM base b JOIN tuned t ON b.tensor = t.tensor AND b."row" = t."row" GROUP BY b.tensor""")
def q_changed_tensors_stored(spark, sf):
    """J3 over two stored checkpoints bucketed by (tensor, row): the join needs no shuffle."""
    from .session import scratch_path
    from .sources.tensors import write_tensor_table
    cols = ["tensor", "kind", "row", "ndim", "shape", "dtype", "values"]
    b = write_tensor_table(S.base_tensors(spark, sf).select(*cols), scratch_path(spark, "base-bucketed"), buckets=16)
    t = write_tensor_table(S.tuned_tensors(spark, sf).select(*cols), scratch_path(spark, "tuned-bucketed"), buckets=16)
    c = TE.changed_tensors(b, t)
    return c.select("tensor", long_("n_rows").alias("n_rows"), long_("n_changed").alias("n_changed"), "changed")


@query("reconcile_state", S.with_sql(S.SQL_BASE, S.SQL_TUNED, S.SQL_GIVEN) + """
SELECT coalesce(e.tensor, g.tensor) AS tensor, coalesce(e."row", g."row") AS "row",
       CASE WHEN e.tensor IS NULL THEN 'unexpected' WHEN g.tensor IS NULL THEN 'missing'
            WHEN e.shape IS DISTINCT FROM g.shape THEN 'shape_mismatch' ELSE 'matched' END AS status
FROM base e FULL OUTER JOIN given g ON e.tensor = g.tensor AND e."row" = g."row\"""")
def q_reconcile_state(spark, sf):
    return TE.reconcile(S.base_tensors(spark, sf), S.given_tensors(spark, sf)).select("tensor", "row", "status")


@query("reconcile_state_stored", SQL["reconcile_state"])
def q_reconcile_state_stored(spark, sf):
    """J4 over two stored checkpoints bucketed by (tensor, row): the full outer join needs no shuffle."""
    from .session import scratch_path
    from .sources.tensors import write_tensor_table
    cols = ["tensor", "kind", "row", "ndim", "shape", "dtype", "values"]
    e = write_tensor_table(S.base_tensors(spark, sf).select(*cols), scratch_path(spark, "expected-bucketed"), buckets=16)
    g = write_tensor_table(S.given_tensors(spark, sf).select(*cols), scratch_path(spark, "given-bucketed"), buckets=16)
    return TE.reconcile(e, g).select("tensor", "row", "status")


def _key_sets(spark, sf):
    """Two stored, bucketed multisets of keys: tuned rows under their layer, and the given ones."""
    from .session import scratch_path
    from .sources.tensors import write_tensor_table
    left = S.base_tensors(spark, sf).select("tensor", (F.col("row") % 40).alias("row"))
    right = S.given_tensors(spark, sf).select("tensor", (F.col("row") % 50).alias("row"))
    return [write_tensor_table(d, scratch_path(spark, f"keys-{k}"), buckets=16) for k, d in enumerate((left, right))]


@query("key_difference", S.with_sql(S.SQL_BASE, S.SQL_TUNED, S.SQL_GIVEN) + """,
d AS (SELECT tensor, "row" % 40 AS "row" FROM base EXCEPT ALL SELECT tensor, "row" % 50 FROM given)
SELECT tensor, "row", count(*) AS n FROM d GROUP BY tensor, "row\"""")
def q_key_difference(spark, sf):
    """U2 over stored checkpoints, repeated keys included; the merge needs no shuffle."""
    return TE.key_difference(*_key_sets(spark, sf)).groupBy("tensor", "row").agg(F.count(F.lit(1)).alias("n"))


@query("key_intersection", S.with_sql(S.SQL_BASE, S.SQL_TUNED, S.SQL_GIVEN) + """
SELECT tensor, "row" % 40 AS "row" FROM base INTERSECT SELECT tensor, "row" % 50 FROM given""")
def q_key_intersection(spark, sf):
    return TE.key_intersection(*_key_sets(spark, sf))


@query("attach_candidates", S.with_sql(S.SQL_REQUESTS) + """
SELECT request_id, CAST(c.cand_id AS INTEGER) AS cand_id, CAST(length(text) AS BIGINT) AS n_text_chars
FROM req CROSS JOIN range(0, 4) c(cand_id)""")
def q_attach_candidates(spark, sf):
    r = DE.attach_candidates(S.requests(spark, sf), 4)
    return r.select(long_("request_id").alias("request_id"), F.col("cand_id").cast("int").alias("cand_id"),
                    long_(F.length("text")).alias("n_text_chars"))


@query("assign_codes", """
WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
lv AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS y, generate_subscripts(embedding, 1) AS i FROM embeddings),
cb AS (SELECT label AS code, i, avg(y) AS y FROM lv GROUP BY label, i),
d AS (SELECT v.vec_id, cb.code, sum((CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)) AS dist
      FROM v JOIN cb ON v.i = cb.i GROUP BY v.vec_id, cb.code),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) AS rn FROM d)
SELECT vec_id, CAST(code AS BIGINT) AS code, round(dist, 6) AS dist FROM r WHERE rn = 1""")
def q_assign_codes(spark, sf):
    e = S.table(spark, sf, "embeddings")
    book = CO.pool_mean(e, "label", "embedding", out="embedding").withColumnRenamed("label", "code")
    a = CO.assign_codes(e, book)
    return a.select(long_("vec_id").alias("vec_id"), long_("code").alias("code"), r6("dist").alias("dist"))


_CELL_BOOK_SQL = """cell AS (SELECT vec_id // 4 AS code, CAST(unnest(embedding) AS DOUBLE) AS y, generate_subscripts(embedding, 1) AS i FROM embeddings),
cb AS (SELECT code, i, avg(y) AS y FROM cell GROUP BY code, i)"""


@query("assign_codes_blocked", "WITH " + _CELL_BOOK_SQL + """,
v AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) + 0.1 AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
d AS (SELECT v.vec_id, cb.code, sum((x - y) * (x - y)) AS dist FROM v JOIN cb ON v.i = cb.i GROUP BY v.vec_id, cb.code),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 9), code) AS rn FROM d)
SELECT vec_id, CAST(code AS BIGINT) AS code, round(dist, 6) AS dist FROM r WHERE rn = 1""")
def q_assign_codes_blocked(spark, sf):
    """J7 with a codebook that grows with the table and is cut into blocks by norm."""
    e = S.table(spark, sf, "embeddings")
    book = CO.pool_mean(e.withColumn("code", idiv(F.col("vec_id"), F.lit(4))), "code", "embedding", out="embedding")
    moved = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 0.1).alias("embedding"))
    a = CO.assign_codes(moved, book, max_bytes=16 << 10)
    return a.select(long_("vec_id").alias("vec_id"), long_("code").alias("code"), r6("dist").alias("dist"))


# =================================================================== aggregations

@query("trainable_summary", S.with_sql(S.SQL_BASE) + """,
m AS (SELECT list_contains(string_split(tensor, '.'), 'c_proj') AS trainable, len("values") AS numel FROM base)
SELECT CAST(sum(CASE WHEN trainable THEN numel ELSE 0 END) AS BIGINT) AS trainable_params,
       CAST(sum(numel) AS BIGINT) AS all_params,
       round(100.0 * sum(CASE WHEN trainable THEN numel ELSE 0 END) / sum(numel), 6) AS trainable_pct
FROM m""")
def q_trainable_summary(spark, sf):
    s = TE.trainable_summary(TE.mark_trainable(S.base_tensors(spark, sf), modules_to_save=["c_proj"]))
    return s.select(long_("trainable_params").alias("trainable_params"), long_("all_params").alias("all_params"),
                    r6("trainable_pct").alias("trainable_pct"))


@query("latency_summary", """
WITH t AS (SELECT user_id, value AS seconds,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2 AS is_warmup FROM events)
SELECT user_id, count(*) FILTER (WHERE NOT is_warmup) AS n_requests,
       round(CAST(sum(CAST(seconds AS DECIMAL(18, 2))) FILTER (WHERE NOT is_warmup) AS DOUBLE), 6) AS total_seconds,
       round(CAST(sum(CAST(seconds AS DECIMAL(18, 2))) FILTER (WHERE NOT is_warmup) AS DOUBLE)
             / count(seconds) FILTER (WHERE NOT is_warmup), 6) AS mean_seconds
FROM t GROUP BY user_id""")
def q_latency_summary(spark, sf):
    ev = S.events(spark, sf).select("user_id", "ts", "event_id", cents("value").alias("seconds"))
    s = ME.latency_summary(ev, "user_id", ["ts", "event_id"], "seconds", warmup=2)
    return s.select(long_("user_id").alias("user_id"), long_("n_requests").alias("n_requests"),
                    r6("total_seconds").alias("total_seconds"), r6("mean_seconds").alias("mean_seconds"))


@query("weighted_loss", S.with_sql(S.SQL_STEPS) + """
SELECT run_id, step, round(0.01 * loss_text_ce + 1.0 * loss_mel_ce, 6) AS loss_total FROM steps""")
def q_weighted_loss(spark, sf):
    w = ME.weighted_loss(S.step_losses(spark, sf))
    return w.select(long_("run_id").alias("run_id"), long_("step").alias("step"), r6("loss_total").alias("loss_total"))


@query("metrics_sink", S.with_sql(S.SQL_STEPS) + """
SELECT run_id, step, round(0.01 * loss_text_ce + 1.0 * loss_mel_ce, 6) AS loss_total FROM steps""")
def q_metrics_sink(spark, sf):
    """Per-step losses appended to a metrics table partitioned by run (S9), read back."""
    from .session import scratch_path
    from .sources.corpus import read_metrics, write_metrics
    path = scratch_path(spark, "metrics")
    w = ME.weighted_loss(S.step_losses(spark, sf)).select("run_id", "step", "loss_total")
    write_metrics(w, path, partition="run_id", width=100)
    back = read_metrics(spark, path, width=100)
    return back.select(long_("run_id").alias("run_id"), long_("step").alias("step"), r6("loss_total").alias("loss_total"))


@query("metrics_attempts", S.with_sql(S.SQL_STEPS) + """
SELECT run_id, step, round(0.01 * loss_text_ce + 1.0 * loss_mel_ce, 6) AS loss_total FROM steps""")
def q_metrics_attempts(spark, sf):
    """S9 done twice: two jobs write their runs, one of them again, and each row is read once."""
    from .session import scratch_path
    from .sources.corpus import read_metrics, write_metrics
    path = scratch_path(spark, "metrics-jobs")
    w = ME.weighted_loss(S.step_losses(spark, sf)).select("run_id", "step", "loss_total")
    for job in (0, 1, 0):
        write_metrics(w.filter(F.col("run_id") % 2 == job), path, width=100, job=f"half{job}")
    back = read_metrics(spark, path, width=100)
    return back.select(long_("run_id").alias("run_id"), long_("step").alias("step"), r6("loss_total").alias("loss_total"))


@query("requests_file", """
SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS request_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text
FROM conversations WHERE role = 'user' AND trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) <> ''""")
def q_requests_file(spark, sf):
    """S8 from text files: one sentence a line, ids in the order of files and lines."""
    from .session import scratch_path
    from .sources.corpus import read_requests
    path = scratch_path(spark, "requests")
    asked = S.table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", TX.normalise_text("text").alias("text"))
    asked.repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn").select("text").write.text(path)
    return read_requests(spark, path).select(long_("request_id").alias("request_id"), "text")


@query("corpus_budget", """
SELECT CAST(sum(n_chars) AS BIGINT) AS total_tokens, 1024 AS block,
       CAST((sum(n_chars) + 1023) // 1024 AS BIGINT) AS n_blocks, 8 AS batch_train, 16 AS batch_eval
FROM documents""")
def q_corpus_budget(spark, sf):
    b = batching.corpus_budget(S.table(spark, sf, "documents"), "n_chars", block=1024, batch=8)
    return b.select(long_("total_tokens").alias("total_tokens"), F.col("block").cast("int").alias("block"),
                    long_("n_blocks").alias("n_blocks"), F.col("batch_train").cast("int").alias("batch_train"),
                    F.col("batch_eval").cast("int").alias("batch_eval"))


def _pool_sql(kind: str) -> str:
    if kind == "mean":
        body = """SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS value
FROM u GROUP BY label, i"""
    else:
        body = """SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(CAST(x AS DOUBLE), 6) AS value
FROM u WHERE vec_id = (SELECT min(vec_id) FROM embeddings e WHERE e.label = u.label)"""
    return ("WITH u AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i "
            "FROM embeddings)\n" + body)


@query("pool_mean", _pool_sql("mean"))
def q_pool_mean(spark, sf):
    p = CO.pool_mean(S.table(spark, sf, "embeddings"), "label", "embedding")
    return p.select(F.col("label").cast("int").alias("label"), F.posexplode("pooled").alias("pos", "value")).select(
        "label", F.col("pos").cast("int").alias("pos"), r6("value").alias("value"))


@query("pool_first", _pool_sql("first"))
def q_pool_first(spark, sf):
    p = CO.pool_first(S.table(spark, sf, "embeddings"), "label", "embedding", "vec_id")
    return p.select(F.col("label").cast("int").alias("label"), F.posexplode("pooled").alias("pos", "value")).select(
        "label", F.col("pos").cast("int").alias("pos"), r6("value").alias("value"))


@query("step_plan", """
WITH c AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS phase, count(*) AS n FROM documents GROUP BY 1),
l(phase, batch) AS (VALUES ('train', 64), ('val', 13))
SELECT c.phase, c.n AS n_examples, l.batch, 4 AS accumulate, l.batch * 4 AS effective_batch,
       CAST((c.n + l.batch * 4 - 1) // (l.batch * 4) AS BIGINT) AS steps_per_epoch,
       round(500.0 * l.batch * 4 / c.n, 6) AS epochs_covered
FROM c JOIN l USING (phase)""")
def q_step_plan(spark, sf):
    d = S.table(spark, sf, "documents").select(S.phase_col().alias("phase"))
    p = batching.step_plan(d, MA.phase_limits(spark), accumulate=4, max_steps=500)
    return p.select("phase", long_("n_examples").alias("n_examples"), F.col("batch").cast("int").alias("batch"),
                    F.col("accumulate").cast("int").alias("accumulate"),
                    F.col("effective_batch").cast("int").alias("effective_batch"),
                    long_("steps_per_epoch").alias("steps_per_epoch"), r6("epochs_covered").alias("epochs_covered"))


@query("first_stop", S.with_sql(S.SQL_CODES) + """
SELECT doc_id, CAST(list_position(codes, 8193) - 1 AS BIGINT) AS first_stop FROM codes""")
def q_first_stop(spark, sf):
    c = S.codes(spark, sf)
    return c.select("doc_id", long_(A.first_stop("codes")).alias("first_stop"))


@query("pair_weights", S.with_sql(S.SQL_BASE) + """,
k AS (SELECT CAST(regexp_extract(tensor, '\\.h\\.(\\d+)\\.', 1) AS INTEGER) AS layer,
             regexp_extract(tensor, '\\.h\\.\\d+\\.(.+)$', 1) AS kind, tensor FROM base)
SELECT layer, 'past_key' || CAST(layer AS VARCHAR) AS key_name,
       min(tensor) FILTER (WHERE kind = 'mlp.c_fc') AS key_tensor,
       count(*) FILTER (WHERE kind = 'mlp.c_fc') AS key_rows,
       'past_value' || CAST(layer AS VARCHAR) AS value_name,
       min(tensor) FILTER (WHERE kind = 'mlp.c_proj') AS value_tensor,
       count(*) FILTER (WHERE kind = 'mlp.c_proj') AS value_rows
FROM k WHERE kind IN ('mlp.c_fc', 'mlp.c_proj') GROUP BY layer""")
def q_pair_weights(spark, sf):
    p = TE.pair_weights(S.base_tensors(spark, sf))
    return p.select(F.col("layer").cast("int").alias("layer"), "key_name", "key_tensor",
                    long_("key_rows").alias("key_rows"), "value_name", "value_tensor",
                    long_("value_rows").alias("value_rows"))


# =================================================================== windows

@query("plan_batches", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS phase FROM documents),
i AS (SELECT doc_id, phase, row_number() OVER (PARTITION BY phase ORDER BY doc_id) - 1 AS idx,
             CASE WHEN phase = 'train' THEN 64 ELSE 13 END AS batch FROM d)
SELECT doc_id, phase, CAST(idx // batch AS BIGINT) AS batch_id, CAST(idx % batch AS BIGINT) AS position,
       CAST((idx % batch) // ((batch + 3) // 4) AS BIGINT) AS micro_id
FROM i""")
def q_plan_batches(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", S.phase_col().alias("phase"))
    d = d.join(F.broadcast(MA.phase_limits(spark).select("phase", "batch")), "phase")  # constant two-row table
    b = batching.plan_batches(d, "doc_id", F.col("batch"), micro=4, partition=["phase"], bucket=int_bucket("doc_id", 64))
    return b.select(long_("doc_id").alias("doc_id"), "phase", long_("batch_id").alias("batch_id"),
                    long_("position").alias("position"), long_("micro_id").alias("micro_id"))


@query("plan_batches_hashed", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS phase, md5(CAST(doc_id AS VARCHAR)) AS k FROM documents),
i AS (SELECT doc_id, phase, row_number() OVER (PARTITION BY phase ORDER BY k) - 1 AS idx FROM d)
SELECT doc_id, phase, CAST(idx // 16 AS BIGINT) AS batch_id, CAST(idx % 16 AS BIGINT) AS position, CAST((idx % 16) // 4 AS BIGINT) AS micro_id FROM i""")
def q_plan_batches_hashed(spark, sf):
    """W1 by a hashed, textual key, which no width fits: cells are ranges of the keys."""
    d = S.table(spark, sf, "documents").select("doc_id", S.phase_col().alias("phase"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("k"))
    b = batching.plan_batches(d, "k", 16, micro=4, partition=["phase"])
    return b.select(long_("doc_id").alias("doc_id"), "phase", long_("batch_id").alias("batch_id"),
                    long_("position").alias("position"), long_("micro_id").alias("micro_id"))


@query("pack_blocks", """
WITH d AS (SELECT doc_id, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c)) AS tok
           FROM documents),
o AS (SELECT doc_id, tok, sum(len(tok)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len(tok) AS off FROM d),
u AS (SELECT doc_id, off, unnest(tok) AS t, generate_subscripts(tok, 1) AS p FROM o)
SELECT CAST((off + p - 1) // 1024 AS BIGINT) AS block_id, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs,
       min(doc_id) AS first_doc, md5(string_agg(CAST(t AS VARCHAR), ',' ORDER BY off + p)) AS tokens_md5
FROM u GROUP BY 1""")
def q_pack_blocks(spark, sf):
    d = spread(S.table(spark, sf, "documents")).select("doc_id", "text")
    d = d.select("doc_id", A.char_codes(F.col("text")).alias("tokens"), F.length("text").alias("n_chars"))
    b = batching.pack_blocks(d, "tokens", "doc_id", block=1024, n_col="n_chars")
    return b.select(long_("block_id").alias("block_id"), long_("n_tokens").alias("n_tokens"),
                    long_("n_docs").alias("n_docs"), long_("first_doc").alias("first_doc"),
                    F.md5(aj("tokens").cast("binary")).alias("tokens_md5"))


def _rolling_sql(n: int) -> str:
    return S.with_sql(S.SQL_STEPS) + f"""
SELECT run_id, step,
       round(CAST(sum(CAST(loss_text_ce AS DECIMAL(18, 2))) OVER w AS DOUBLE) / count(*) OVER w, 6) AS rolling_mean
FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"""


def _rolling(spark, sf, n):
    s = S.step_losses(spark, sf).withColumn("loss_text_ce", cents("loss_text_ce"))
    r = ME.rolling_mean(s, "run_id", "step", "loss_text_ce", n=n, dense=True)  # step is the per-run rank
    return r.select(long_("run_id").alias("run_id"), long_("step").alias("step"), r6("rolling_mean").alias("rolling_mean"))


@query("rolling_loss", _rolling_sql(500))
def q_rolling_loss(spark, sf):
    return _rolling(spark, sf, 500)


@query("rolling_loss_short", _rolling_sql(16))
def q_rolling_loss_short(spark, sf):
    return _rolling(spark, sf, 16)


@query("trim_calm_run", S.with_sql(S.SQL_CODES) + """,
u AS (SELECT doc_id, unnest(codes) AS x, generate_subscripts(codes, 1) - 1 AS i FROM codes),
g AS (SELECT doc_id, i, x, i - row_number() OVER (PARTITION BY doc_id, x = 83 ORDER BY i) AS grp FROM u),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, grp ORDER BY i) AS run_pos FROM g WHERE x = 83),
k AS (SELECT doc_id, min(i) AS k FROM r WHERE run_pos = 9 GROUP BY doc_id)
SELECT c.doc_id, CAST(CASE WHEN k.k IS NULL THEN len(c.codes) ELSE k.k END AS BIGINT) AS n_kept,
       array_to_string(CASE WHEN k.k IS NULL THEN c.codes ELSE list_slice(c.codes, 1, k.k) END, ',') AS codes
FROM codes c LEFT JOIN k USING (doc_id)""")
def q_trim_calm_run(spark, sf):
    c = S.codes(spark, sf).withColumn("t", A.trim_calm_run("codes"))
    return c.select("doc_id", long_(F.size("t")).alias("n_kept"), aj("t").alias("codes"))


@query("position_ids", S.with_sql(S.SQL_CODES) + """,
u AS (SELECT doc_id, CASE WHEN unnest(codes) = 83 THEN 0 ELSE 1 END AS m, generate_subscripts(codes, 1) AS i FROM codes),
s AS (SELECT doc_id, i, m, sum(m) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs FROM u)
SELECT doc_id, array_to_string(list(CASE WHEN m = 0 THEN 1 ELSE cs - 1 END ORDER BY i), ',') AS position_ids
FROM s GROUP BY doc_id""")
def q_position_ids(spark, sf):
    c = S.codes(spark, sf)
    mask = F.transform("codes", lambda x: F.when(x == 83, 0).otherwise(1))
    return c.select("doc_id", aj(A.position_ids(mask)).alias("position_ids"))


def _long_codes(spark, sf):
    c = S.codes(spark, sf)
    return c.select("doc_id", F.posexplode("codes").alias("pos", "code"))


@query("trim_calm_run_table", S.with_sql(S.SQL_CODES) + """,
u AS (SELECT doc_id, unnest(codes) AS x, generate_subscripts(codes, 1) - 1 AS i FROM codes),
g AS (SELECT doc_id, i, x, i - row_number() OVER (PARTITION BY doc_id, x = 83 ORDER BY i) AS grp FROM u),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, grp ORDER BY i) AS run_pos FROM g WHERE x = 83),
k AS (SELECT doc_id, min(i) AS k FROM r WHERE run_pos = 9 GROUP BY doc_id)
SELECT u.doc_id, CAST(count(*) AS BIGINT) AS n_kept, CAST(sum(u.x) AS BIGINT) AS code_sum
FROM u LEFT JOIN k USING (doc_id) WHERE k.k IS NULL OR u.i < k.k GROUP BY u.doc_id""")
def q_trim_calm_run_table(spark, sf):
    from .operators.sequences import trim_calm_run_table
    t = trim_calm_run_table(_long_codes(spark, sf), "doc_id", "pos", "code")
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"), long_(F.sum("code")).alias("code_sum"))


@query("position_ids_table", S.with_sql(S.SQL_CODES) + """,
u AS (SELECT doc_id, CASE WHEN unnest(codes) = 83 THEN 0 ELSE 1 END AS m, generate_subscripts(codes, 1) - 1 AS pos FROM codes)
SELECT doc_id, CAST(pos AS INTEGER) AS pos,
       CAST(CASE WHEN m = 0 THEN 1 ELSE sum(m) OVER (PARTITION BY doc_id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 END AS BIGINT) AS position_id
FROM u""")
def q_position_ids_table(spark, sf):
    from .operators.sequences import position_ids_table
    m = _long_codes(spark, sf).withColumn("mask", F.when(F.col("code") == 83, 0).otherwise(1))
    p = position_ids_table(m, "doc_id", "pos", "mask")
    return p.select("doc_id", F.col("pos").cast("int").alias("pos"), long_("position_id").alias("position_id"))


def _softmax_sql(temp: float) -> str:
    return f""",
z AS (SELECT request_id, token, score / {temp} AS z FROM scores),
e AS (SELECT request_id, token, exp(z - max(z) OVER (PARTITION BY request_id)) AS e FROM z),
p AS (SELECT request_id, token, e / sum(e) OVER (PARTITION BY request_id) AS prob FROM e)"""


@query("nucleus_filter", S.with_sql(S.SQL_SCORES) + _softmax_sql(0.8) + """,
c AS (SELECT *, sum(prob) OVER (PARTITION BY request_id ORDER BY prob DESC, token
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_prob FROM p)
SELECT request_id, token, round(prob, 6) AS prob FROM c WHERE cum_prob - prob < 0.8""")
def q_nucleus_filter(spark, sf):
    n = DE.nucleus_filter(S.scores(spark, sf), "request_id", "score", "token", p=0.8, temperature=0.8)
    return n.select(long_("request_id").alias("request_id"), "token", r6("prob").alias("prob"))


@query("typical_filter", S.with_sql(S.SQL_SCORES) + _softmax_sql(1.0) + """,
lp AS (SELECT p.*, (z.z - max(z.z) OVER (PARTITION BY z.request_id))
                   - ln(sum(exp(z.z - m.mz)) OVER (PARTITION BY z.request_id)) AS logp
       FROM p JOIN z USING (request_id, token) JOIN (SELECT request_id, max(z) AS mz FROM z GROUP BY 1) m USING (request_id)),
h AS (SELECT *, -sum(prob * logp) OVER (PARTITION BY request_id) AS ent FROM lp),
t AS (SELECT *, abs(-logp - ent) AS dev FROM h),
c AS (SELECT *, sum(prob) OVER (PARTITION BY request_id ORDER BY dev, token
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_prob FROM t)
SELECT request_id, token, round(prob, 6) AS prob FROM c WHERE cum_prob - prob < 0.9""")
def q_typical_filter(spark, sf):
    n = DE.typical_filter(S.scores(spark, sf), "request_id", "score", "token", mass=0.9)
    return n.select(long_("request_id").alias("request_id"), "token", r6("prob").alias("prob"))


@query("sample_per_group", S.with_sql(S.SQL_SCORES) + _softmax_sql(0.8) + """,
g AS (SELECT request_id, token, draw, ln(prob) - ln(-ln(
          ((CAST('0x' || substr(md5('7|' || request_id || '|' || token || '|' || draw), 1, 15) AS BIGINT) >> 8) + 0.5::DOUBLE) / 4503599627370496.0)) AS k
      FROM p CROSS JOIN range(0, 3) d(draw) WHERE prob > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id, draw ORDER BY k DESC, token) AS rn FROM g)
SELECT request_id, CAST(draw AS INTEGER) AS draw, token FROM r WHERE rn = 1""")
def q_sample_per_group(spark, sf):
    p = DE.softmax(S.scores(spark, sf), "request_id", "score", 0.8)
    s = DE.sample_per_group(p, "request_id", "token", "prob", n=3, seed=7)
    return s.select(long_("request_id").alias("request_id"), F.col("draw").cast("int").alias("draw"), "token")


@query("repetition_penalty", S.with_sql(S.SQL_SCORES) + """,
h AS (SELECT DISTINCT user_id AS request_id, event_type AS token FROM events WHERE value >= 50)
SELECT s.request_id, s.token,
       round(CASE WHEN h.token IS NULL THEN score WHEN score < 0 THEN score * 2.0 ELSE score / 2.0 END, 6) AS score
FROM scores s LEFT JOIN h ON s.request_id = h.request_id AND s.token = h.token""")
def q_repetition_penalty(spark, sf):
    ev = S.events(spark, sf)
    hist = ev.filter(F.col("value") >= 50).select(F.col("user_id").alias("request_id"), F.col("event_type").alias("token"))
    r = DE.repetition_penalty(S.scores(spark, sf), hist, "request_id", "token", "score", penalty=2.0)
    return r.select(long_("request_id").alias("request_id"), "token", r6("score").alias("score"))


# =================================================================== sorts / top-k

@query("top_k_candidates", """
WITH r AS (SELECT user_id AS request_id, event_id AS cand_id, value AS score,
                  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rk FROM events)
SELECT request_id, cand_id, score, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 1""")
def q_top_k_candidates(spark, sf):
    c = S.events(spark, sf).select(F.col("user_id").alias("request_id"), F.col("event_id").alias("cand_id"),
                                   F.col("value").alias("score"))
    t = DE.top_k(c, "request_id", "score", "cand_id", k=1)
    return t.select("request_id", "cand_id", "score", F.col("rank").cast("int").alias("rank"))


@query("first_candidate", """
SELECT user_id AS request_id, min(event_id) AS cand_id, arg_min(value, event_id) AS score FROM events GROUP BY user_id""")
def q_first_candidate(spark, sf):
    c = S.events(spark, sf).select(F.col("user_id").alias("request_id"), F.col("event_id").alias("cand_id"),
                                   F.col("value").alias("score"))
    return DE.first_candidate(c, "request_id", "cand_id").select("request_id", "cand_id", "score")


@query("seeded_shuffle", """
SELECT doc_id, row_number() OVER (ORDER BY substr(md5('42|' || doc_id), 1, 15), doc_id) - 1 AS shuffle_pos FROM documents""")
def q_seeded_shuffle(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id")
    return batching.seeded_shuffle(d, "doc_id", seed=42).select("doc_id", long_("shuffle_pos").alias("shuffle_pos"))


@query("similarity_rerank", """
WITH u AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i),
s AS (SELECT u.vec_id, u.label, sum(u.x * c.m) AS dot, sqrt(sum(u.x * u.x)) AS nu, sqrt(sum(c.m * c.m)) AS nc
      FROM u JOIN c ON u.label = c.label AND u.i = c.i GROUP BY u.vec_id, u.label),
r AS (SELECT label, vec_id, dot / nullif(nu * nc, 0) AS score,
             row_number() OVER (PARTITION BY label ORDER BY dot / nullif(nu * nc, 0) DESC NULLS LAST, vec_id) AS rk FROM s)
SELECT label, vec_id, round(score, 6) AS score FROM r WHERE rk <= 3""")
def q_similarity_rerank(spark, sf):
    e = S.table(spark, sf, "embeddings")
    cent = CO.pool_mean(e, "label", "embedding", out="centroid")
    pairs = e.join(cent, "label")
    scored = pairs.select("label", "vec_id", DE.similarity_score("embedding", "centroid").alias("score"))
    t = DE.top_k(scored, "label", "score", "vec_id", k=3)
    return t.select(F.col("label").cast("int").alias("label"), long_("vec_id").alias("vec_id"), r6("score").alias("score"))


# =================================================================== scalar functions

@query("normalise_text", """
SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text FROM documents""")
def q_normalise_text(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", TX.normalise_text("text").alias("text"))


@query("redact_bracketed", """
WITH b AS (SELECT doc_id, '[' || lang || ']' || replace(text, ' s', ' [' || source || '] s') || '[' AS text FROM documents)
SELECT doc_id, regexp_replace(text, '\\[[^\\]]*\\]', '', 'g') AS text FROM b""")
def q_redact_bracketed(spark, sf):
    d = S.table(spark, sf, "documents")
    span = F.concat(F.lit(" ["), F.col("source"), F.lit("] s"))
    text = F.concat(F.lit("["), F.col("lang"), F.lit("]"), F.replace("text", F.lit(" s"), span), F.lit("["))
    return d.select("doc_id", TX.redact_bracketed(text).alias("text"))


@query("pad_or_truncate", S.with_sql(S.SQL_CODES) + """
SELECT doc_id, array_to_string(list_slice(list_concat(codes, list_transform(range(200), lambda x: 0)), 1, 200), ',') AS codes
FROM codes""")
def q_pad_or_truncate(spark, sf):
    return S.codes(spark, sf).select("doc_id", aj(A.pad_or_truncate("codes", 200, 0)).alias("codes"))


@query("pad_right", S.with_sql(S.SQL_CODES) + """
SELECT doc_id, array_to_string(CASE WHEN doc_id % 5 - 2 >= 0
         THEN list_concat(codes, list_transform(range(doc_id % 5 - 2), lambda x: 8193))
         ELSE list_slice(codes, 1, greatest(len(codes) + (doc_id % 5 - 2), 0)) END, ',') AS codes
FROM codes""")
def q_pad_right(spark, sf):
    c = S.codes(spark, sf)
    k = (F.col("doc_id") % 5 - 2).cast("int")
    return c.select("doc_id", aj(A.pad_right("codes", k, 8193)).alias("codes"))


@query("align_inputs_targets", S.with_sql(S.SQL_CODES) + """
SELECT doc_id, array_to_string(list_concat([8192], codes, [8193]), ',') AS inputs,
       array_to_string(list_concat(codes, [8193, 8193]), ',') AS targets
FROM codes""")
def q_align_inputs_targets(spark, sf):
    c = S.codes(spark, sf)
    i, t = A.align_inputs_targets(A.append_stop("codes", A.STOP_CODE), A.START_CODE, A.STOP_CODE)
    return c.select("doc_id", aj(i).alias("inputs"), aj(t).alias("targets"))


@query("mask_past_end", S.with_sql(S.SQL_CODES) + """
SELECT doc_id, array_to_string(list_transform(codes, lambda x, i:
         CASE WHEN i - 1 >= (n_chars // 16 * 1024 + 500) // 1024 + 1 THEN 8193 ELSE x END), ',') AS codes
FROM codes""")
def q_mask_past_end(spark, sf):
    c = S.codes(spark, sf)
    wav = idiv(F.col("n_chars"), F.lit(16)) * 1024 + 500
    return c.select("doc_id", aj(A.mask_past_end("codes", wav)).alias("codes"))


@query("fix_codes", S.with_sql(S.SQL_CODES) + """,
s AS (SELECT doc_id, codes, list_position(codes, 8193) - 1 AS st, len(codes) AS n FROM codes)
SELECT doc_id, array_to_string(CASE WHEN st IS NULL THEN codes ELSE list_transform(codes, lambda x, i: CASE
         WHEN i - 1 = n - 1 THEN 248 WHEN i - 1 = n - 2 THEN 45 WHEN i - 1 = n - 3 THEN 45
         WHEN i - 1 >= st THEN 83 ELSE x END) END, ',') AS codes
FROM s""")
def q_fix_codes(spark, sf):
    return S.codes(spark, sf).select("doc_id", aj(A.fix_codes("codes")).alias("codes"))


@query("crop_or_pad", S.with_sql(S.SQL_CODES) + """
SELECT doc_id, array_to_string(CASE WHEN len(codes) <= 150
         THEN list_slice(list_concat(codes, list_transform(range(150), lambda x: 0)), 1, 150)
         ELSE list_slice(codes, 1, 150) END, ',') AS codes
FROM codes""")
def q_crop_or_pad(spark, sf):
    return S.codes(spark, sf).select("doc_id", aj(A.crop_or_pad("codes", 150, 0)).alias("codes"))


@query("for_each", S.with_sql(S.SQL_CODES) + """
SELECT doc_id, array_to_string(list_transform(codes, lambda x: (x * 2 + 1) % 8192), ',') AS codes FROM codes""")
def q_for_each(spark, sf):
    return S.codes(spark, sf).select("doc_id", aj(A.for_each("codes", lambda x: (x * 2 + 1) % 8192)).alias("codes"))


@query("length_arith", """
SELECT doc_id, n_chars * 100 + (doc_id % 7) * 60000 AS n_samples,
       (n_chars * 100 + (doc_id % 7) * 60000) * 4 * 24000 // 22050 AS output_length,
       (n_chars * 100 + (doc_id % 7) * 60000) // 1024 AS code_length
FROM documents""")
def q_length_arith(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", S.n_samples_col().alias("n_samples"))
    return d.select("doc_id", long_("n_samples").alias("n_samples"),
                    LN.output_length("n_samples").alias("output_length"), LN.code_length("n_samples").alias("code_length"))


@query("multistep_lr", """
WITH s AS (SELECT event_id AS step,
                  1e-5 * pow(0.5, CAST(event_id >= 1000 AS INTEGER) + CAST(event_id >= 2000 AS INTEGER)
                                  + CAST(event_id >= 4000 AS INTEGER)) AS lr FROM events)
SELECT step, round(CASE WHEN step < 100 THEN lr * (step + 1) / 100.0 ELSE lr END * 1e6, 6) AS lr_e6 FROM s""")
def q_multistep_lr(spark, sf):
    ev = S.events(spark, sf).select(F.col("event_id").alias("step"))
    lr = LN.multistep_lr("step", 1e-5, (1000, 2000, 4000), 0.5, warmup=100)
    return ev.select("step", r6(lr * 1e6).alias("lr_e6"))


@query("collate_causal", """
WITH c AS (SELECT conv_id, turn, len(list_filter(string_split(text, ''), lambda c: c <> '')) AS n,
                  list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c)) AS tok,
                  list_sum(list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c))) AS s,
                  (row_number() OVER (ORDER BY conv_id, turn) - 1) // 4 AS batch_id FROM conversations),
p AS (SELECT *, max(n) OVER (PARTITION BY batch_id) AS padded_len FROM c)
SELECT conv_id, turn, CAST(batch_id AS BIGINT) AS batch_id, CAST(padded_len AS BIGINT) AS padded_len,
       CAST(padded_len - n AS BIGINT) AS n_masked, CAST(coalesce(s, 0) - 100 * (padded_len - n) AS BIGINT) AS label_sum,
       md5(array_to_string(list_concat(tok, list_transform(range(padded_len - n), lambda x: 0)), ',')) AS input_md5,
       md5(array_to_string(list_concat(list_transform(tok, lambda x: 1), list_transform(range(padded_len - n), lambda x: 0)), ',')) AS mask_md5
FROM p""")
def q_collate_causal(spark, sf):
    ex = S.conversation_examples(spark, sf)
    b = batching.plan_batches(ex, ["conv_id", "turn"], 4, micro=1)
    c = batching.collate_causal(b, "batch_id", "tokens", pad=0)
    return c.select(long_("conv_id").alias("conv_id"), long_("turn").alias("turn"), long_("batch_id").alias("batch_id"),
                    long_("padded_len").alias("padded_len"),
                    long_(F.size(F.filter("labels", lambda x: x == -100))).alias("n_masked"),
                    long_(F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x)).alias("label_sum"),
                    F.md5(aj("input_ids").cast("binary")).alias("input_md5"),
                    F.md5(aj("attention_mask").cast("binary")).alias("mask_md5"))


@query("sft_examples", """
WITH p AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS prompt
           FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id),
t AS (SELECT conv_id, len(list_filter(string_split(prompt, ''), lambda c: c <> '')) AS n,
             (row_number() OVER (ORDER BY conv_id) - 1) // 2 AS batch_id FROM p)
SELECT conv_id, CAST(batch_id AS BIGINT) AS batch_id, CAST(n AS BIGINT) AS n_tokens,
       CAST(max(n) OVER (PARTITION BY batch_id) AS BIGINT) AS padded_len,
       CAST(max(n) OVER (PARTITION BY batch_id) - n AS BIGINT) AS n_masked
FROM t""")
def q_sft_examples(spark, sf):
    """Supervised fine-tuning examples: a conversation's user and assistant turns
    in turn order form the ``prompt`` field (one example, bounded by the
    conversation), the trainer takes that field (P4), batches of 2 are padded
    to their longest example with pad positions masked out of the labels."""
    c = S.table(spark, sf, "conversations").filter(F.col("role").isin("user", "assistant"))
    prompts = c.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]),
                     "\n").alias("prompt"))
    ex = batching.select_text_field(prompts, "prompt", "text", keep=("conv_id",))
    ex = ex.select("conv_id", A.char_codes(F.col("text")).alias("tokens"))
    b = batching.plan_batches(ex, "conv_id", 2, micro=1)
    c = batching.collate_causal(b, "batch_id", "tokens", pad=0)
    return c.select(long_("conv_id").alias("conv_id"), long_("batch_id").alias("batch_id"),
                    long_(F.size("tokens")).alias("n_tokens"), long_("padded_len").alias("padded_len"),
                    long_(F.size(F.filter("labels", lambda x: x == -100))).alias("n_masked"))


@query("adapter_params", S.with_sql(S.SQL_BASE) + """
SELECT tensor, CAST(max(shape[1]) AS BIGINT) AS in_dim, count(*) AS out_dim,
       CAST(16 * (max(shape[1]) + count(*)) AS BIGINT) AS params, CAST(32 AS DOUBLE) / 16 AS scale
FROM base WHERE ndim = 2 GROUP BY tensor""")
def q_adapter_params(spark, sf):
    b = S.base_tensors(spark, sf).filter(F.col("ndim") == 2)
    g = b.groupBy("tensor").agg(F.max(F.col("shape")[0]).alias("in_dim"), F.count(F.lit(1)).alias("out_dim"))
    return g.select("tensor", long_("in_dim").alias("in_dim"), long_("out_dim").alias("out_dim"),
                    LN.adapter_params("in_dim", "out_dim", 16).alias("params"),
                    LN.adapter_scale(32, 16).alias("scale"))


@query("bpe_token_counts", f"""WITH {_NORM_SQL},
{_BPE_SQL},
n AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
d AS (SELECT doc_id, sum(n) AS n FROM piece JOIN n USING (word) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_unk FROM documents LEFT JOIN d USING (doc_id)""")
def q_bpe_token_counts(spark, sf):
    from .functions.bpe import bpe_encode, load_tokenizer
    tok = load_tokenizer(default_tokenizer_path())
    d = spread(S.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", bpe_encode(TX.normalise_text("text"), tok).alias("ids"))
    return d.select("doc_id", long_(F.size("ids")).alias("n_tokens"),
                    long_(F.size(F.filter("ids", lambda x: x == tok.unk_id))).alias("n_unk"))


@query("bpe_roundtrip", f"""WITH {_NORM_SQL}
SELECT doc_id, coalesce(array_to_string(regexp_extract_all(text, {_BPE_SQL.split("regexp_extract_all(text, ")[1].split(")) AS word")[0]}), ' '), '') AS text FROM norm""")
def q_bpe_roundtrip(spark, sf):
    """Decoding gives the pieces back, each followed by the blank of its end-of-word mark."""
    from .functions.bpe import bpe_decode, bpe_encode, load_tokenizer
    tok = load_tokenizer(default_tokenizer_path())
    d = spread(S.table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", bpe_decode(bpe_encode(TX.normalise_text("text"), tok), tok).alias("text"))


def _nf4_sql() -> str:
    from .operators.adapters import _NF4_MID, NF4_LEVELS, NF4_MAX_GAP
    listed = lambda xs: "[" + ", ".join(f"CAST('{float(x)!r}' AS DOUBLE)" for x in xs) + "]"
    return f"""
WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
b AS (SELECT vec_id, x, max(abs(x)) OVER (PARTITION BY vec_id, i // 16) AS am FROM u),
s AS (SELECT vec_id, x, am, max(am) OVER (PARTITION BY vec_id) AS sm FROM b),
q AS (SELECT vec_id, x, sm, round_even(255.0::DOUBLE * am / CASE WHEN sm > 0 THEN sm ELSE 1 END, 0) / 255.0::DOUBLE * sm AS scale,
             x / CASE WHEN am > 0 THEN am ELSE 1 END AS v FROM s),
d AS (SELECT vec_id, sm, abs(x - ({listed(NF4_LEVELS)})[1 + len(list_filter({listed(_NF4_MID)}, lambda m: m < v))] * scale) AS err FROM q)
SELECT vec_id, round(max(err) * 1e6) / 1e6 AS max_abs_err, max(err) <= max(sm) * ({NF4_MAX_GAP / 2 + 1.0 / 255!r}) + 1e-12 AS within_bound
FROM d GROUP BY vec_id"""


@query("quantise_error", _nf4_sql())
def q_quantise_error(spark, sf):
    from .operators.adapters import NF4_MAX_GAP, dequantise_blocks, quantise_blocks
    e = S.table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = e.withColumn("q", quantise_blocks("embedding", 16)).withColumn("deq", dequantise_blocks("q", 16))
    err = F.array_max(F.zip_with("embedding", "deq", lambda a, b: F.abs(a.cast("double") - b)))
    amax = F.array_max(F.transform("embedding", lambda a: F.abs(a.cast("double"))))
    bound = amax * (NF4_MAX_GAP / 2 + 1.0 / 255)
    return q.select(long_("vec_id").alias("vec_id"), r6(err).alias("max_abs_err"), (err <= bound + 1e-12).alias("within_bound"))


# =================================================================== further forms

@query("rewrite_prefix_anywhere", """
SELECT doc_id, replace(text, ' the ', ' THE ') AS text FROM documents""")
def q_rewrite_prefix_anywhere(spark, sf):
    """P1 in its global form: every occurrence in the line, not only at its start."""
    d = S.table(spark, sf, "documents")
    return d.select("doc_id", TX.rewrite_prefix("text", " the ", " THE ", anywhere=True).alias("text"))


@query("align_text_pair", """
WITH t AS (SELECT doc_id, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c)) AS tok FROM documents)
SELECT doc_id, md5(array_to_string(list_concat([255], tok, [0]), ',')) AS inputs_md5,
       md5(array_to_string(list_concat(tok, [0, 0]), ',')) AS targets_md5
FROM t""")
def q_align_text_pair(spark, sf):
    """F5 on the text side (start 255, stop 0)."""
    tok = A.char_codes(F.col("text"))
    i, t = A.align_inputs_targets(A.append_stop(tok, A.TEXT_STOP), A.TEXT_START, A.TEXT_STOP)
    return spread(S.table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.md5(aj(i).cast("binary")).alias("inputs_md5"), F.md5(aj(t).cast("binary")).alias("targets_md5"))


@query("seeded_crop", S.with_sql(S.SQL_CODES) + """,
s AS (SELECT doc_id, codes, CAST('0x' || substr(md5('3|' || doc_id), 1, 15) AS BIGINT) % (greatest(len(codes) - 150, 0) + 1) AS st FROM codes)
SELECT doc_id, array_to_string(CASE WHEN len(codes) <= 150
         THEN list_slice(list_concat(codes, list_transform(range(150), lambda x: 0)), 1, 150)
         ELSE list_slice(codes, st + 1, st + 150) END, ',') AS codes
FROM s""")
def q_seeded_crop(spark, sf):
    """F8 with a start drawn from the row's key."""
    c = S.codes(spark, sf)
    return c.select("doc_id", aj(A.crop_or_pad("codes", 150, A.seeded_crop_start("codes", 150, "doc_id", 3))).alias("codes"))


@query("strict_load", S.with_sql(S.SQL_BASE, S.SQL_TUNED) + """
SELECT tensor, "row", """ + _PLACED_SQL + """ AS value_check FROM tuned""")
def q_strict_load(spark, sf):
    """J4's strict load: the tuned checkpoint against its own keys; any gap would raise."""
    t = S.tuned_tensors(spark, sf)
    return TE.load_checked(t.select("tensor", "row", "shape"), t, strict=True).select(
        "tensor", "row", placed("values").alias("value_check"))


@query("strict_load_gap", S.with_sql(S.SQL_BASE, S.SQL_TUNED, S.SQL_GIVEN) + """
SELECT CASE WHEN e.tensor IS NULL THEN 'unexpected' WHEN g.tensor IS NULL THEN 'missing'
            WHEN e.shape IS DISTINCT FROM g.shape THEN 'shape_mismatch' ELSE 'matched' END AS status, count(*) AS n
FROM base e FULL OUTER JOIN given g ON e.tensor = g.tensor AND e."row" = g."row" GROUP BY 1""")
def q_strict_load_gap(spark, sf):
    """J4's strict load of a checkpoint with gaps: it raises, and says how many keys are wrong in which way."""
    try:
        TE.load_checked(S.base_tensors(spark, sf), S.given_tensors(spark, sf), strict=True, ignore_mismatched=True)
    except TE.LoadError as e:
        return spark.createDataFrame(sorted(e.counts.items()), "status string, n long")
    return spark.createDataFrame([], "status string, n long")


@query("lenient_load", S.with_sql(S.SQL_BASE, S.SQL_TUNED, S.SQL_GIVEN) + """
SELECT g.tensor, g."row", """ + _PLACED_SQL.replace('"values"', 'g."values"') + """ AS value_check
FROM given0 g JOIN base b ON b.tensor = g.tensor AND b."row" = g."row" WHERE len(g."values") = b.shape[1]""")
def q_lenient_load(spark, sf):
    """J4's other mode: only matched keys load, mismatched shapes are left out."""
    got = TE.load_checked(S.base_tensors(spark, sf), S.given_tensors(spark, sf), strict=False, ignore_mismatched=True)
    return got.select("tensor", "row", placed("values").alias("value_check"))


@query("manifest_file", S.with_sql(S.SQL_MANIFEST) + """
SELECT sum(CASE WHEN doc_id % 13 <> 0 THEN 1 ELSE 0 END) :: BIGINT AS n_parsed, sum(CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END) :: BIGINT AS n_rejected,
       sum(CASE WHEN doc_id % 13 <> 0 THEN length(text) ELSE 0 END) :: BIGINT AS n_text_chars
FROM parsed""")
def q_manifest_file(spark, sf):
    """S1 from text files: manifest lines are written, some without a delimiter, and read back with their rejects."""
    from .session import scratch_path
    from .sources.manifest import read_manifest
    path = scratch_path(spark, "manifest")
    lines = S.manifest_lines(spark, sf)
    bare = F.replace("value", F.lit("|"), F.lit(" "))
    lines.select(F.when(F.col("line_no") % 13 == 0, bare).otherwise(F.col("value")).alias("value")).write.text(path)
    parsed, rejects = read_manifest(spark, path)
    counts = parsed.agg(F.count(F.lit(1)).alias("n_parsed"), long_(F.sum(F.length("text"))).alias("n_text_chars"), F.lit(0).alias("k"))
    return counts.join(rejects.agg(F.count(F.lit(1)).alias("n_rejected"), F.lit(0).alias("k")), "k").select("n_parsed", "n_rejected", "n_text_chars")


# =================================================================== pipeline surface

_CHAIN = [
    {"type": "normalise_text", "in": "text", "out": "norm"},
    {"type": "char_codes", "in": "norm", "out": "tok"},
    {"type": "size", "in": "tok", "out": "n_tok"},
    {"type": "pad_or_truncate", "in": "tok", "out": "padded", "n": 64, "fill": 0},
]


@query("injector_chain", """
WITH t AS (SELECT doc_id, list_transform(list_filter(string_split(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), ''),
                                                     lambda c: c <> ''), lambda c: unicode(c)) AS tok FROM documents)
SELECT doc_id, CAST(len(tok) AS BIGINT) AS n_tok,
       array_to_string(list_slice(list_concat(tok, list_transform(range(64), lambda x: 0)), 1, 64), ',') AS padded
FROM t""")
def q_injector_chain(spark, sf):
    from .plans.injectors import run_injectors
    d = run_injectors(spread(S.table(spark, sf, "documents")).select("doc_id", "text"), _CHAIN)
    return d.select("doc_id", long_("n_tok").alias("n_tok"), aj("padded").alias("padded"))


@query("injector_nested", """
WITH lv AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS y, generate_subscripts(embedding, 1) AS i FROM embeddings),
cb AS (SELECT label AS code, i, avg(y) AS y FROM lv GROUP BY label, i),
x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
d AS (SELECT vec_id, code, sum((x - y) * (x - y)) AS dist FROM x JOIN cb USING (i) GROUP BY vec_id, code),
r AS (SELECT vec_id, code, row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) AS rn FROM d)
SELECT vec_id, CAST(code AS BIGINT) AS token, CAST(code AS VARCHAR) || ',' || CAST(code AS VARCHAR) AS tokens, '63,63' AS sizes
FROM r WHERE rn = 1""")
def q_injector_nested(spark, sf):
    """X1 with nested steps: codes for a vector, codes for each of a list of vectors, and a transform per element."""
    from .plans.injectors import run_injectors
    e = S.table(spark, sf, "embeddings")
    book = CO.pool_mean(e, "label", "embedding", out="embedding").withColumnRenamed("label", "code")
    d = e.select("vec_id", "embedding", F.array("embedding", "embedding").alias("pair"))
    out = run_injectors(d, [
        {"type": "discrete_token", "in": "embedding", "out": "token", "codebook": book, "id_col": "vec_id"},
        {"type": "discrete_token", "in": "pair", "out": "tokens", "codebook": book, "id_col": "vec_id"},
        {"type": "for_each", "subtype": "crop_or_pad", "in": "pair", "out": "short", "n": 63},
        {"type": "for_each", "subtype": "size", "in": "short", "out": "sizes"}])
    return out.select("vec_id", "token", aj("tokens").alias("tokens"), aj("sizes").alias("sizes"))


@query("score_batches", """
WITH u AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i),
l AS (SELECT u.vec_id, c.label, sum(u.x * c.m) AS logit FROM u JOIN c USING (i) GROUP BY u.vec_id, c.label)
SELECT vec_id, CAST(arg_max(label, logit) AS BIGINT) AS pred, round(max(logit), 6) AS score FROM l GROUP BY vec_id""")
def q_score_batches(spark, sf):
    import numpy as np
    import pandas as pd

    from .plans.scoring import parquet_matrix_loader, score_batches
    from .session import scratch_path
    e = S.table(spark, sf, "embeddings")
    head = CO.pool_mean(e, "label", "embedding", out="w")
    path = scratch_path(spark, "head")
    head.write.mode("overwrite").parquet(path)

    def fn(model, pdf):
        keys, W = model
        X = np.array([np.asarray(v, dtype=np.float64) for v in pdf["embedding"]]).reshape(len(pdf), -1)
        logits = X @ W.T if len(pdf) else np.zeros((0, len(keys)))
        best = logits.argmax(axis=1) if len(pdf) else np.zeros(0, dtype=int)
        return pd.DataFrame({"vec_id": pdf["vec_id"].astype("int64"), "pred": keys[best].astype("int64"),
                             "score": logits.max(axis=1) if len(pdf) else np.zeros(0)})

    out = score_batches(e.select("vec_id", "embedding"), parquet_matrix_loader(path, "label", "w"), fn,
                        "vec_id long, pred long, score double", batch=64)
    return out.select("vec_id", "pred", r6("score").alias("score"))


@query("score_conditioned", """
WITH e AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
w AS (SELECT i, avg(x) AS w FROM e GROUP BY i),
m AS (SELECT label, i, avg(x * w) AS m FROM e JOIN w USING (i) WHERE i <= 48 GROUP BY label, i),
n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY label),
l AS (SELECT label, max(m / norm) FILTER (WHERE i = 1) AS l1, max(m / norm) FILTER (WHERE i = 2) AS l2, max(m / norm) FILTER (WHERE i = 3) AS l3 FROM m JOIN n USING (label) GROUP BY label)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, round((l1 * length(text) + l2 * (turn + 1) + l3 * (conv_id % 17)) / 100, 6) AS score
FROM conversations c LEFT JOIN l ON l.label = c.conv_id % 13""")
def q_score_conditioned(spark, sf):
    """X2 with conditioning: a request's voice is ``conv_id % 13``, its references the embeddings of that
    label; odd turns are scored after the even ones and find their voices' conditioning computed."""
    import numpy as np
    import pyarrow as pa

    from .plans.scoring import Conditioning, parquet_matrix_loader, score_conditioned
    from .session import scratch_path
    e = S.table(spark, sf, "embeddings")
    path = scratch_path(spark, "weights")
    CO.pool_mean(e.withColumn("k", F.lit(0)), "k", "embedding", out="w").write.parquet(path)
    loader = parquet_matrix_loader(path, "k", "w")

    def embed(model, x):
        return x[:, :48] * model[1][0, :48]

    def finish(model, keys, x):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def score(model, latent, part):
        f = np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_chars", "place", "mark")], axis=1)
        s = pa.array(f @ latent[:3] / 100) if latent is not None else pa.nulls(len(f), pa.float64())
        return pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("turn"), s], names=["conv_id", "turn", "score"])

    voices = Conditioning(spark, embed, finish, loader, dim=64)
    requests = S.table(spark, sf, "conversations").select(
        "conv_id", long_("turn").alias("turn"), F.length("text").alias("n_chars"), (F.col("turn") + 1).alias("place"),
        (F.col("conv_id") % 17).alias("mark"), (F.col("conv_id") % 13).alias("voice"))
    references = e.withColumnRenamed("label", "voice")
    out = []
    for part in (requests.filter("turn % 2 = 0"), requests.filter("turn % 2 = 1")):
        latents = voices.latents(part, references, "voice", "embedding")
        out.append(score_conditioned(part, latents, "voice", loader, score, "conv_id long, turn long, score double"))
    return out[0].unionByName(out[1]).select("conv_id", "turn", r6("score").alias("score"))


def _merge_adapter(spark, sf, transposed):
    """Per targeted tensor: one factor of r = 4 vectors along the rows, taken from the tensor's own
    first rows, and one with r numbers per row, a fixed pattern of the row number. The first is A in
    the plain layout and B's columns in the transposed one, so both layouts give the same rows."""
    from .operators.adapters import merge_adapter
    r = 4
    base = TE.target_modules(S.base_tensors(spark, sf), ["c_fc", "c_proj"]).select("tensor", "row", "values")
    first_rows = DE.top_k(base.withColumn("__neg", -F.col("row")), "tensor", "__neg", "row", k=r)
    along = (first_rows.groupBy("tensor").agg(F.sort_array(F.collect_list(F.struct("row", "values"))).alias("a"))
             .select("tensor", F.transform("a", lambda s: F.transform(s["values"], lambda x: x.cast("double") / 100)).alias("along")))
    rows = F.sequence(F.lit(0), F.col("mx"))
    ranks = F.sequence(F.lit(0), F.lit(r - 1))
    at = lambda i, j: ((i * 7 + j) % 5 - 2).cast("double") / 10
    own = F.transform(ranks, lambda j: F.transform(rows, lambda i: at(i, j))) if transposed else \
        F.transform(rows, lambda i: F.transform(ranks, lambda j: at(i, j)))
    per_row = base.groupBy("tensor").agg(F.max("row").alias("mx")).select("tensor", own.alias("own"))
    if transposed:  # B: a row of r numbers for each place along the stored rows
        places = F.sequence(F.lit(0), F.size(F.col("along")[0]) - 1)
        b = F.transform(places, lambda k: F.transform("along", lambda v: F.get(v, k)))
        ad = along.select("tensor", b.alias("lora_B")).join(per_row.withColumnRenamed("own", "lora_A"), "tensor")
    else:
        ad = along.withColumnRenamed("along", "lora_A").join(per_row.withColumnRenamed("own", "lora_B"), "tensor")
    m = merge_adapter(base, ad, alpha=8, r=r, fan_in_fan_out=transposed)
    return m.select("tensor", "row", placed("values").alias("value_check"))


@query("merge_adapter", S.with_sql(S.SQL_BASE) + """,
t AS (SELECT tensor, "row", "values" FROM base WHERE string_split(tensor, '.')[-1] IN ('c_fc', 'c_proj')),
ar AS (SELECT tensor, "values", row_number() OVER (PARTITION BY tensor ORDER BY "row") - 1 AS j FROM t),
a AS (SELECT tensor, any_value("values") FILTER (WHERE j = 0) AS a0, any_value("values") FILTER (WHERE j = 1) AS a1,
             any_value("values") FILTER (WHERE j = 2) AS a2, any_value("values") FILTER (WHERE j = 3) AS a3
      FROM ar WHERE j < 4 GROUP BY tensor),
ta AS (SELECT t.tensor, t."row" AS rw, t."values" AS vs, a.a0, a.a1, a.a2, a.a3 FROM t JOIN a ON t.tensor = a.tensor),
m AS (SELECT tensor, rw, list_transform(vs, lambda w, i: CAST(w AS DOUBLE) + 2.0 * ((((0.0
          + ((rw * 7 + 0) % 5 - 2) / 10.0 * (CAST(a0[i] AS DOUBLE) / 100))
          + ((rw * 7 + 1) % 5 - 2) / 10.0 * (CAST(a1[i] AS DOUBLE) / 100))
          + ((rw * 7 + 2) % 5 - 2) / 10.0 * (CAST(a2[i] AS DOUBLE) / 100))
          + ((rw * 7 + 3) % 5 - 2) / 10.0 * (CAST(a3[i] AS DOUBLE) / 100))) AS v
      FROM ta)
SELECT tensor, rw AS "row", """ + _PLACED_SQL.replace('"values"', "v") + """ AS value_check FROM m""")
def q_merge_adapter(spark, sf):
    return _merge_adapter(spark, sf, transposed=False)


@query("merge_adapter_transposed", SQL["merge_adapter"])
def q_merge_adapter_transposed(spark, sf):
    """J6 with ``fan_in_fan_out``: the base is stored transposed."""
    return _merge_adapter(spark, sf, transposed=True)


@query("apply_adapter", """
WITH x AS (SELECT vec_id, label % 2 AS aid, CAST(unnest(embedding) AS DOUBLE) AS xv, generate_subscripts(embedding, 1) - 1 AS k
           FROM embeddings),
lv AS (SELECT label AS o, CAST(unnest(embedding) AS DOUBLE) AS wv, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
w AS (SELECT o, k, avg(wv) AS wv FROM lv GROUP BY o, k),
y0 AS (SELECT x.vec_id, w.o, sum(w.wv * x.xv) AS y0 FROM x JOIN w ON x.k = w.k GROUP BY x.vec_id, w.o),
ax AS (SELECT x.vec_id, r.j, sum(CASE WHEN x.aid = 0 THEN ((r.j + 3 * x.k) % 7 - 3) / 50.0
                                      ELSE ((2 * r.j + x.k) % 5 - 2) / 40.0 END * x.xv) AS h
       FROM x CROSS JOIN range(0, 2) r(j) GROUP BY x.vec_id, r.j),
dy AS (SELECT ax.vec_id, q.o, sum(((5 * q.o + ax.j) % 3 - 1) / 10.0 * ax.h) AS dy
       FROM ax CROSS JOIN (SELECT DISTINCT o FROM w) q GROUP BY ax.vec_id, q.o)
SELECT y0.vec_id, CAST(y0.o AS INTEGER) AS pos, round(y0.y0 + 2.0 * dy.dy, 6) AS y
FROM y0 JOIN dy ON y0.vec_id = dy.vec_id AND y0.o = dy.o""")
def q_apply_adapter(spark, sf):
    from .operators.adapters import apply_adapter
    e = S.table(spark, sf, "embeddings")
    base = CO.pool_mean(e, "label", "embedding", out="values").withColumnRenamed("label", "row")
    r, n_rows = 2, base.count()
    A0 = [[((i + 3 * j) % 7 - 3) / 50.0 for j in range(64)] for i in range(r)]
    B0 = [[((i * 5 + j) % 3 - 1) / 10.0 for j in range(r)] for i in range(n_rows)]
    A1 = [[((2 * i + j) % 5 - 2) / 40.0 for j in range(64)] for i in range(r)]
    ad = spark.createDataFrame([("0", A0, B0), ("1", A1, B0)],
                               "adapter_id string, lora_A array<array<double>>, lora_B array<array<double>>")
    v = e.select("vec_id", "embedding", (F.col("label") % 2).alias("adapter_id"))
    out = apply_adapter(v, base, ad, alpha=4, r=r)
    return out.select("vec_id", F.posexplode("output").alias("pos", "y")).select("vec_id", "pos", r6("y").alias("y"))


@query("fit_adapter")
def q_fit_adapter(spark, sf):
    from .operators.adapters import fit_adapter
    e = S.table(spark, sf, "embeddings")
    base = CO.pool_mean(e, "label", "embedding", out="values").select(F.col("label").alias("row"), "values")
    _adapter, losses = fit_adapter(spark, e, base, r=4, alpha=8.0, lr=0.5, steps=8)
    return losses


@query("fit_adapter_start", """
WITH u AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
w AS (SELECT label AS o, i, avg(x) AS m FROM u GROUP BY label, i),
z AS (SELECT u.vec_id, u.label, w.o, sum(u.x * w.m) AS z FROM u JOIN w USING (i) GROUP BY u.vec_id, u.label, w.o),
p AS (SELECT *, z - max(z) OVER (PARTITION BY vec_id) AS zs FROM z),
l AS (SELECT vec_id, -(max(zs) FILTER (WHERE o = label) - ln(sum(exp(zs)))) AS loss FROM p GROUP BY vec_id)
SELECT 0 AS step, round(avg(loss), 6) AS loss, count(*) AS n_rows FROM l""")
def q_fit_adapter_start(spark, sf):
    """The loss before any update: B starts at zero, so it is the frozen base's."""
    from .operators.adapters import fit_adapter
    e = S.table(spark, sf, "embeddings")
    base = CO.pool_mean(e, "label", "embedding", out="values").select(F.col("label").alias("row"), "values")
    _adapter, losses = fit_adapter(spark, e, base, steps=1)
    return losses.select("step", r6("loss").alias("loss"), "n_rows")


@query("fit_adapter_resume", """
WITH u AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
w AS (SELECT label AS o, i, avg(x) AS m FROM u GROUP BY label, i),
z0 AS (SELECT u.vec_id, u.label, w.o, sum(u.x * w.m) AS z FROM u JOIN w USING (i) GROUP BY u.vec_id, u.label, w.o),
p0 AS (SELECT *, exp(z - max(z) OVER v) / sum(exp(z - mz)) OVER v AS p FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS mz FROM z0) WINDOW v AS (PARTITION BY vec_id)),
h AS (SELECT u.vec_id, j.j, sum(u.x * (((j.j + 3 * (u.i - 1)) % 7 - 3) / 2.0)) AS h FROM u CROSS JOIN range(0, 4) j(j) GROUP BY u.vec_id, j.j),
b AS (SELECT p0.o, h.j, -0.5 * 2.0 * sum((p0.p - CASE WHEN p0.o = p0.label THEN 1 ELSE 0 END) * h.h) / (SELECT count(DISTINCT vec_id) FROM u) AS b
      FROM p0 JOIN h USING (vec_id) GROUP BY p0.o, h.j),
z1 AS (SELECT z0.vec_id, z0.label, z0.o, any_value(z0.z) + 2.0 * sum(h.h * b.b) AS z FROM z0 JOIN h USING (vec_id) JOIN b ON b.o = z0.o AND b.j = h.j GROUP BY z0.vec_id, z0.label, z0.o),
a AS (SELECT 0 AS step, * FROM z0 UNION ALL SELECT 1, * FROM z1),
s AS (SELECT *, z - max(z) OVER (PARTITION BY step, vec_id) AS zs FROM a),
l AS (SELECT step, vec_id, ln(sum(exp(zs))) - max(zs) FILTER (WHERE o = label) AS loss FROM s GROUP BY step, vec_id)
SELECT step, round(avg(loss), 6) AS loss, count(*) AS n_rows FROM l GROUP BY step""")
def q_fit_adapter_resume(spark, sf):
    """X3 stopped after its first step and resumed from shared storage: the loss before and after the first update."""
    from .operators.adapters import fit_adapter
    from .session import scratch_path
    e = S.table(spark, sf, "embeddings")
    base = CO.pool_mean(e, "label", "embedding", out="values").select(F.col("label").alias("row"), "values")
    start = [[((i + 3 * j) % 7 - 3) / 2.0 for j in range(64)] for i in range(4)]
    path = scratch_path(spark, "resumed")
    fit_adapter(spark, e, base, r=4, alpha=8.0, lr=0.5, steps=1, init=start, path=path)
    _adapter, losses = fit_adapter(spark, e, base, r=4, alpha=8.0, lr=0.5, steps=2, init=start, path=path)
    return losses.select("step", r6("loss").alias("loss"), "n_rows")


@query("adapter_cycle")
def q_adapter_cycle(spark, sf):
    """Fit on mini-batches, save, load and apply: per vector the label that the adapted base
    gives the highest score, beside the frozen base's."""
    from .operators.adapters import apply_adapter, fit_adapter, stack_adapter
    from .session import scratch_path
    from .sources.tensors import read_adapter, write_adapter
    e = S.table(spark, sf, "embeddings")
    base = CO.pool_mean(e, "label", "embedding", out="values").select(F.col("label").alias("row"), "values")
    fitted, _losses = fit_adapter(spark, e, base, r=4, alpha=8.0, lr=0.5, steps=8, batch=200)
    path = scratch_path(spark, "fitted")
    cfg = {"peft_type": "LORA", "r": 4, "lora_alpha": 8, "fan_in_fan_out": False}
    write_adapter(fitted.withColumnRenamed("matrix", "tensor"), cfg, path, "labels-v1")
    loaded, conf = read_adapter(spark, path, "labels-v1")
    c = conf.select("r", "lora_alpha").first()
    frozen = stack_adapter(loaded.withColumn("values", F.transform("values", lambda x: x * 0.0))).withColumn("adapter_id", F.lit("none"))
    models = stack_adapter(loaded).unionByName(frozen)
    v = e.select("vec_id", "embedding", F.explode(F.array(F.lit("labels-v1"), F.lit("none"))).alias("adapter_id"))
    out = apply_adapter(v.withColumn("vec_id", F.struct("vec_id", "adapter_id")), base, models, alpha=c["lora_alpha"], r=c["r"])
    best = F.array_position("output", F.array_max("output")) - 1
    return out.groupBy(F.col("vec_id.vec_id").alias("vec_id")).agg(
        F.max(F.when(F.col("vec_id.adapter_id") == "labels-v1", best)).alias("adapted"),
        F.max(F.when(F.col("vec_id.adapter_id") == "none", best)).alias("frozen"))


@query("latency_tumbling", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       count(*) AS n_requests, round(CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE), 6) AS total_seconds,
       round(CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 6) AS mean_seconds
FROM events GROUP BY date_trunc('day', ts)""")
def q_latency_tumbling(spark, sf):
    from .streaming.latency import latency_tumbling
    ev = S.events(spark, sf).select("ts", cents("value").alias("seconds"))
    t = latency_tumbling(ev, "ts", "seconds", "1 day")
    from .streaming.latency import utc_text
    return t.select(utc_text("window_start").alias("window_start"), utc_text("window_end").alias("window_end"),
                    long_("n_requests").alias("n_requests"), r6("total_seconds").alias("total_seconds"),
                    r6("mean_seconds").alias("mean_seconds"))


_TUMBLING_SQL = SQL["latency_tumbling"]


@query("latency_stream_sink", f"""
SELECT * FROM ({_TUMBLING_SQL}) w
WHERE CAST(w.window_end AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_latency_stream_sink(spark, sf):
    """ST2 as a stream: events read as a Parquet stream, tumbling windows under a
    watermark, each window appended to the shared folder once it is closed, read back."""
    from .session import scratch_path
    from .streaming.latency import run_latency_stream
    out, ckpt = scratch_path(spark, "latency-out"), scratch_path(spark, "latency-ckpt")
    run_latency_stream(spark, sf, out, ckpt, window="1 day", lateness="1 hour")
    t = spark.read.parquet(out)
    from .streaming.latency import utc_text
    return t.select(utc_text("window_start").alias("window_start"), utc_text("window_end").alias("window_end"),
                    long_("n_requests").alias("n_requests"), r6("total_seconds").alias("total_seconds"),
                    r6("mean_seconds").alias("mean_seconds"))


#: The events in four deliveries; a later one brings rows that are older than the watermark by then.
_DELIVERY = "event_id % 4"


@query("latency_late_rows", f"""
WITH e AS (SELECT ts, CAST(value AS DECIMAL(18, 2)) AS seconds, event_id, {_DELIVERY} AS b FROM events),
m AS (SELECT b, max(ts) AS mark FROM e GROUP BY b),
k AS (SELECT e.*, coalesce(e.ts < (SELECT max(mark) FROM m WHERE m.b < e.b) - INTERVAL 1 HOUR, false) AS late FROM e),
w AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, sum(seconds) AS s FROM k WHERE NOT late GROUP BY 1)
SELECT 'kept' AS sink, window_start, CAST(n AS BIGINT) AS n_requests, round(CAST(s AS DOUBLE), 6) AS total_seconds FROM w
UNION ALL SELECT 'late', '', count(*), round(CAST(coalesce(sum(seconds), 0) AS DOUBLE), 6) FROM k WHERE late""")
def q_latency_late_rows(spark, sf):
    """ST2 with late rows: four deliveries, each a micro-batch of one stream; what comes after the watermark is kept aside."""
    from .session import scratch_path
    from .streaming.batches import latency_windows, latency_with_rejects, read_batches
    from .streaming.latency import utc_text
    source, out, ckpt = (scratch_path(spark, f"late-{x}") for x in ("in", "out", "ckpt"))
    ev = S.events(spark, sf).select("ts", cents("value").alias("seconds"), "event_id")
    for k in range(4):
        ev.filter(F.expr(_DELIVERY) == k).write.mode("append").parquet(source)
        latency_with_rejects(spark.readStream.schema(ev.schema).parquet(source), out, ckpt)
    kept = latency_windows(spark, out).select(F.lit("kept").alias("sink"), utc_text("window_start").alias("window_start"), "n_requests", "total_seconds")
    late = read_batches(spark, out, "late").agg(F.count(F.lit(1)).alias("n_requests"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("total_seconds"))
    both = kept.unionByName(late.select(F.lit("late").alias("sink"), F.lit("").alias("window_start"), "n_requests", "total_seconds"))
    return both.select("sink", "window_start", long_("n_requests").alias("n_requests"), r6(F.col("total_seconds").cast("double")).alias("total_seconds"))


@query("pair_clips_stream", S.with_sql(S.SQL_MANIFEST, _REWRITTEN_SQL, S.SQL_CLIPS) + """
SELECT m.line_no, m.audio_path, CAST(c.n_samples AS BIGINT) AS n_samples, c.audio_path IS NOT NULL AS found FROM rw m LEFT JOIN clips c USING (audio_path)""")
def q_pair_clips_stream(spark, sf):
    """J1 on a stream: each micro-batch of manifest lines goes to the paired and the missing sink under its batch id."""
    from .session import scratch_path
    from .streaming.batches import pair_stream, read_batches
    source, out, ckpt = (scratch_path(spark, f"pairs-{x}") for x in ("in", "out", "ckpt"))
    lines = _rewritten_manifest(spark, sf)
    for k in range(2):
        lines.filter(F.col("line_no") % 2 == k).write.mode("append").parquet(source)
        pair_stream(spark.readStream.schema(lines.schema).parquet(source), S.clips(spark, sf), out, ckpt)
    paired = read_batches(spark, out, "paired").select("line_no", "audio_path", long_("n_samples").alias("n_samples"), F.lit(True).alias("found"))
    missing = read_batches(spark, out, "missing").select("line_no", "audio_path", F.lit(None).cast("long").alias("n_samples"), F.lit(False).alias("found"))
    return paired.unionByName(missing)


def _row_local_chain(df):
    return df.select(
        "doc_id", TX.rewrite_prefix(S.old_path(), S.OLD_ROOT, S.NEW_ROOT).alias("audio_path"),
        TX.normalise_text("text").alias("text"), aj(A.fix_codes(S.codes_col())).alias("codes"),
        long_(A.first_stop(S.codes_col())).alias("first_stop"))


@query("rowlocal_stream_sink", S.with_sql(S.SQL_CODES) + """,
f AS (SELECT doc_id, codes, list_position(codes, 8193) - 1 AS st, len(codes) AS n FROM codes)
SELECT d.doc_id, '/data/clips/' || d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.wav' AS audio_path,
       trim(regexp_replace(lower(d.text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text,
       array_to_string(CASE WHEN f.st IS NULL THEN f.codes ELSE list_transform(f.codes, lambda x, i: CASE
         WHEN i - 1 = f.n - 1 THEN 248 WHEN i - 1 = f.n - 2 THEN 45 WHEN i - 1 = f.n - 3 THEN 45
         WHEN i - 1 >= f.st THEN 83 ELSE x END) END, ',') AS codes,
       CAST(f.st AS BIGINT) AS first_stop
FROM documents d JOIN f USING (doc_id)""")
def q_rowlocal_stream_sink(spark, sf):
    """ST1 as a stream: the documents table read as a Parquet stream, row-local
    operators applied unchanged, appended by the executors to a Parquet sink
    (checkpointed), read back."""
    from .session import scratch_path
    from .streaming.rowlocal import run_available, stream_parquet
    out, ckpt = scratch_path(spark, "rowlocal-out"), scratch_path(spark, "rowlocal-ckpt")
    docs = stream_parquet(spark, f"{sf}/documents.parquet")
    run_available(docs, _row_local_chain, out, ckpt)
    return spark.read.schema(_row_local_chain(docs).schema).parquet(out)


# =================================================================== flagship

@query("phase_report", S.with_sql(S.SQL_MANIFEST, S.SQL_CLIPS, """line AS (SELECT line_no, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text FROM parsed)""",
    bpe_sql(default_tokenizer_path(), "line", "line_no")) + """,
n AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
len AS (SELECT line_no, sum(n) AS n FROM piece JOIN n USING (word) GROUP BY line_no),
lim(phase, max_text, max_wav, batch) AS (VALUES ('train', 350, 551250, 64), ('val', 200, 286715, 13)),
j AS (SELECT parsed.phase, coalesce(len.n, 0) AS text_len, c.n_samples, lim.batch, CASE WHEN c.audio_path IS NULL THEN 'missing'
             WHEN coalesce(len.n, 0) <= max_text AND c.n_samples <= max_wav THEN 'kept' ELSE 'dropped' END AS state
      FROM parsed JOIN lim USING (phase) LEFT JOIN len USING (line_no) LEFT JOIN clips c ON c.audio_path = '/data/clips/' || substr(parsed.audio_path, 11)),
g AS (SELECT phase, any_value(batch) AS batch, count(*) FILTER (WHERE state = 'kept') AS n, sum(text_len) FILTER (WHERE state = 'kept') AS t,
             sum(n_samples) FILTER (WHERE state = 'kept') AS s, count(*) FILTER (WHERE state = 'dropped') AS d, count(*) FILTER (WHERE state = 'missing') AS m
      FROM j GROUP BY phase)
SELECT phase, n AS n_examples, CAST(coalesce(t, 0) AS BIGINT) AS n_tokens, CAST(coalesce(s, 0) AS BIGINT) AS n_samples, (n + batch - 1) // batch AS n_batches,
       (n + 4 * batch - 1) // (4 * batch) AS n_steps, d AS n_dropped, m AS n_missing, CAST(0 AS BIGINT) AS n_rejected FROM g""")
def q_phase_report(spark, sf):
    from .plans.report import phase_report
    return phase_report(spark, sf)
