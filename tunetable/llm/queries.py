"""The registered queries of this package: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe_stream, exact_dedup, html_text, licenses, line_dedup, mixing, near_dup, passages, prefix_trie, quality, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.keep_bitmaps(_table(spark, sf_dir, "documents"), with_text=True)
    return out.select("doc_id", "n_lines", "n_dropped", line_dedup.kept_sha256("text", "keep_bitmap").alias("kept_sha256"))


SQL["op1_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, coalesce(k.doc_id <> f.first, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@_query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op2_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


@_query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


@_query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(_table(spark, sf_dir, "documents"))


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, chain)


@_query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@_query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixture(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


@_query
def op8_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.token_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


@_query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files ``source/lang/doc_id``."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    return licenses.scan(_table(spark, sf_dir, "documents"), path, keep=("doc_id",))


def _license_sql() -> str:
    """The same in SQL: vectors as rows, directories as path prefixes."""
    templates = ", ".join(f"({k}, '{name}', '{t}')" for k, (name, ts) in enumerate(licenses.template_terms()) for t in ts)
    return rf"""
WITH t(k, name, term) AS (VALUES {templates}),
v AS (SELECT DISTINCT term FROM t),
f AS (SELECT doc_id, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), CAST(doc_id AS VARCHAR)) AS path, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM f),
w AS (SELECT doc_id, pos, list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.TERM}')) AS d FROM l),
x AS (SELECT doc_id, pos, len(d) AS n, unnest(d) AS term FROM w),
c AS (SELECT count(*) AS n FROM w WHERE len(d) > 0),
i AS (SELECT v.term, power(ln((1 + any_value(c.n)) / (1 + count(x.term))) + 1, 2) AS s FROM v CROSS JOIN c LEFT JOIN x ON x.term = v.term GROUP BY v.term),
y AS (SELECT doc_id, pos, any_value(x.n) AS n, sum(i.s) + (any_value(x.n) - count(*)) * (SELECT power(ln(1 + n) + 1, 2) FROM c) AS len2 FROM x JOIN i USING (term) GROUP BY doc_id, pos),
z AS (SELECT k, any_value(name) AS name, sum(i.s) AS len2 FROM t JOIN i USING (term) GROUP BY k),
s AS (SELECT x.doc_id, x.pos, t.k, sum(i.s) AS dot FROM x JOIN t USING (term) JOIN i USING (term) GROUP BY x.doc_id, x.pos, t.k),
q AS (SELECT s.doc_id, s.pos, z.name, y.n, round(s.dot / (sqrt(y.len2) * sqrt(z.len2)), 6) AS score FROM s JOIN y USING (doc_id, pos) JOIN z USING (k)),
b AS (SELECT doc_id, pos, any_value(n) AS n, max(score) AS score, arg_min(name, struct_pack(a := -score, b := name)) AS name FROM q GROUP BY doc_id, pos HAVING max(score) >= {licenses.COSINE}),
o AS (SELECT doc_id, max(score) AS score, arg_min(name, struct_pack(a := -score, b := name)) AS name, count(*) AS n_notices, sum(n) AS terms FROM b GROUP BY doc_id),
a AS (SELECT doc_id, sum(len(d)) AS terms FROM w GROUP BY doc_id),
r AS (SELECT f.doc_id, f.path, regexp_replace(f.path, '/?[^/]*$', '') AS dir, o.name AS own_license, o.score, coalesce(o.n_notices, 0) AS n_notices,
             coalesce(o.terms >= {licenses.FILE_SHARE} * a.terms OR (o.name IS NOT NULL AND regexp_matches(f.path, '(?i)(^|/)(licen[cs]e|copying|notice)(\.[^/]*)?$')), false) AS is_license_file
      FROM f LEFT JOIN o USING (doc_id) LEFT JOIN a USING (doc_id)),
g AS (SELECT dir, own_license, count(*) AS n FROM r WHERE is_license_file GROUP BY dir, own_license),
h AS (SELECT dir, arg_min(own_license, struct_pack(a := -n, b := own_license)) AS license FROM g GROUP BY dir),
u AS (SELECT e.dir, arg_max(h.license, length(h.dir)) AS inherited_license, arg_max(h.dir, length(h.dir)) AS inherited_from
      FROM (SELECT DISTINCT dir FROM r) e JOIN h ON h.dir = '' OR e.dir = h.dir OR starts_with(e.dir, h.dir || '/') GROUP BY e.dir)
SELECT r.doc_id, r.path, r.own_license, r.score, CAST(r.n_notices AS INTEGER) AS n_notices, r.is_license_file, u.inherited_license, u.inherited_from, coalesce(r.own_license, u.inherited_license) AS license
FROM r LEFT JOIN u ON u.dir = r.dir
"""


SQL["op9_license_scan"] = _license_sql()


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model, out="score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


SQL["op11_conversation_prefix_trie"] = r"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv FROM t),
c AS (SELECT conv, conv - conv % 5 AS p,
             xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                 lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 9 AS h
      FROM i),
r AS (SELECT c.conv, 0 AS own, t.pos, t.role, t.text FROM c JOIN t ON t.conv = c.p AND t.pos <= c.h
      UNION ALL SELECT c.conv, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv = c.conv AND t.pos > c.h),
s AS (SELECT i.conv, coalesce(list(struct_pack(role := role, text := text) ORDER BY own, pos) FILTER (WHERE pos IS NOT NULL), []) AS seq FROM i LEFT JOIN r USING (conv) GROUP BY i.conv),
x AS (SELECT conv, seq, unnest(range(len(seq) + 1)) AS d FROM s),
p AS (SELECT conv, d, list_slice(seq, 1, d) AS pre, len(seq) = d AS over FROM x),
n AS (SELECT d, pre, min(conv) AS k, count(*) AS n, (count(*) - 1) * coalesce(strlen(any_value(pre)[d].text), 0) AS gain,
             sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (WHERE over), '')) AS sha
      FROM p GROUP BY d, pre),
q AS (SELECT p.conv, p.d, n.k FROM p JOIN n ON p.d = n.d AND p.pre = n.pre),
u AS (SELECT n.*, q.k AS up FROM n LEFT JOIN q ON q.conv = n.k AND q.d = n.d - 1),
kids AS (SELECT up, d - 1 AS d, count(*) AS kids FROM u WHERE up IS NOT NULL GROUP BY up, d - 1),
a AS (SELECT u.*, coalesce(kids.kids, 0) AS kids FROM u LEFT JOIN kids ON kids.up = u.k AND kids.d = u.d),
z AS (SELECT q.k, q.d, sum(CAST(a.kids = 0 AS INTEGER)) AS leaves, sum(a.gain) AS saved FROM a JOIN q ON q.conv = a.k AND q.d <= a.d GROUP BY q.k, q.d)
SELECT a.k AS conv_id, a.d AS depth, a.up AS parent_conv_id, a.n AS n_convs, a.kids AS n_children, CAST(z.leaves AS BIGINT) AS n_leaves, CAST(z.saved AS BIGINT) AS saved_tokens, a.sha AS ends_sha256
FROM a JOIN z ON z.k = a.k AND z.d = a.d
"""


@_query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.alignment_summary(_table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.sim_groups(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
