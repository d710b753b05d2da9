"""Registered queries of the operators, and DuckDB SQL where it can state them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op5_exact_dedup",
    f"""WITH d AS (SELECT doc_id, sha256({LOWERED}) AS h FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
    FROM d WINDOW g AS (PARTITION BY h)""",
)
def _(spark, sf):
    from cohortloom.llm.exact import exact_dedup

    return exact_dedup(documents(spark, sf))


ALNUM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op2_decontaminate",
    f"""WITH b AS (SELECT item_id, {ALNUM_WORDS.format(LOWERED)} AS ws FROM benchmark),
    g AS (
      SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g
      FROM b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0),
    d AS (SELECT doc_id, {ALNUM_WORDS.format(LOWERED)} AS ws FROM documents),
    h AS (
      SELECT d.doc_id, i, g.n, g.item_id
      FROM (SELECT doc_id, ws, i, n FROM d, (SELECT DISTINCT n FROM g) l, unnest(range(1, len(ws) - n + 2)) AS t(i)) d
      JOIN g ON g.n = d.n AND g.g = array_to_string(d.ws[d.i:d.i + d.n - 1], ' ')),
    c AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM h, unnest(range(i, i + n)) AS t(w) GROUP BY doc_id),
    s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
    SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)""",
)
def _(spark, sf):
    from cohortloom.llm.decontaminate import decontaminate

    return decontaminate(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


@query("op1_quality_classifier")
def _(spark, sf):
    from cohortloom.llm.labelled import held_out
    from cohortloom.llm.quality import score_quality

    score = F.col("quality_score")
    scored = score_quality(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


@query(
    "op3_jaccard_join",
    f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS g
      FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    r AS (SELECT a AS doc_id, a AS reached FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(w.doc_id, m.low), w.doc_id) AS component_id
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(reached) AS low FROM r GROUP BY doc_id) m USING (doc_id)""",
)
def _(spark, sf):
    from cohortloom.llm.jaccard import jaccard_components

    return jaccard_components(documents(spark, sf))


@query("op4_toxic_passages")
def _(spark, sf):
    from cohortloom.llm.labelled import held_out
    from cohortloom.llm.toxicity import score_toxicity

    scored = score_toxicity(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "n_tokens",
        F.size("passages").alias("n_passages"),
    )


@query("op6_html_text")
def _(spark, sf):
    from cohortloom.llm.html import extract_text

    return extract_text(spark.read.parquet(f"{sf}/pages.parquet"))


@query("op7_source_mix")
def _(spark, sf):
    from cohortloom.llm.mixing import mix_sources

    return mix_sources(documents(spark, sf))


@query(
    "op8_suffix_dedup",
    # Texts are cut into blocks first: DuckDB copies the whole string for every position taken from it.
    """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    c AS (SELECT doc_id, len(h) // 2 AS n, 500 * b AS o, substr(h, 1000 * b + 1, 1098) AS s FROM d, unnest(range(0, len(h) // 1000 + 1)) AS t(b)),
    w AS (SELECT doc_id, o + i AS i, substr(s, 2 * i + 1, 100) AS g FROM c, unnest(range(0, 500)) AS t(i) WHERE o + i + 50 <= n),
    m AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g),
    b AS (SELECT DISTINCT w.doc_id, w.i + j AS p FROM w JOIN m USING (g), unnest(range(0, 50)) AS t(j) WHERE m.low < w.doc_id),
    n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS n_spans
      FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM b) GROUP BY doc_id),
    k AS (SELECT doc_id, string_agg(x, '' ORDER BY p) AS rest
      FROM (SELECT doc_id, o + i AS p, substr(s, 2 * i + 1, 2) AS x FROM c, unnest(range(0, 500)) AS t(i) WHERE o + i < n)
      ANTI JOIN b USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(rest, ''))) AS kept_sha256
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
)
def _(spark, sf):
    from cohortloom.llm.suffix import repeat_digest

    return repeat_digest(documents(spark, sf))


@query("op9_license_scan")
def _(spark, sf):
    from cohortloom.llm.licenses import license_digest

    return license_digest(documents(spark, sf))


@query("op10_secret_scan")
def _(spark, sf):
    from cohortloom.llm.secrets import secret_digest

    return secret_digest(documents(spark, sf))


#: CRC-32 of a short ASCII text.
CRC32 = """xor(list_reduce([CAST(ord(x) AS BIGINT) FOR x IN string_split({}, '')], lambda crc, b:
  list_reduce(range(8), lambda v, i: xor(v >> 1, (v & 1) * 3988292384), xor(crc, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""


@query(
    "op11_conversation_repair",
    f"""WITH RECURSIVE o AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    c AS (SELECT *, {CRC32.format("k")} % 20 AS c FROM o),
    d AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN c = 1 THEN '' WHEN c = 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM c, unnest(range(CASE WHEN c = 0 THEN 0 WHEN c = 3 THEN 2 ELSE 1 END)) AS t(copy)),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS l FROM d),
    f AS (SELECT *, lag(l) OVER (PARTITION BY conv_id ORDER BY i) AS before,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
          WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM n),
    p AS (
      SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 'n' AS s, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} AS v FROM conversations
      UNION ALL
      SELECT conv_id, i + 1, CASE e WHEN 'D' THEN s WHEN 'K' THEN l ELSE put END,
        min({{'c': v.c + CASE e WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END + CASE WHEN e <> 'D' AND fault = 't' THEN 1 ELSE 0 END, 'a': v.a || e,
          't': CASE e WHEN 'D' THEN v.t WHEN 'K' THEN list_append(v.t, role || ':' || text) ELSE list_append(v.t, CASE put WHEN 'a' THEN 'assistant:' ELSE 'user:' END || text) END}})
      FROM (
        SELECT q.*, f.role, f.text, f.fault, f.l, CASE q.s WHEN 'u' THEN 'a' ELSE 'u' END AS put
        FROM (
          SELECT conv_id, i, s, v FROM p
          UNION ALL
          SELECT conv_id, i, CASE s WHEN 'u' THEN 'a' ELSE 'u' END, {{'c': v.c + 2, 'a': v.a || 'I', 't': list_append(v.t, CASE s WHEN 'u' THEN 'assistant:' ELSE 'user:' END)}} FROM p
          UNION ALL
          SELECT conv_id, i, 'a', {{'c': v.c + 4, 'a': v.a || 'II', 't': list_append(list_append(v.t, 'user:'), 'assistant:')}} FROM p WHERE s IN ('n', 's')) q
        JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i + 1) r, unnest(['D', 'K', 'R']) AS t(e)
      WHERE e = 'D' OR (fault NOT IN ('b', 'd') AND (e = 'R' OR s || l IN ('ns', 'nu', 'su', 'ua', 'au')))
      GROUP BY ALL),
    g AS (SELECT p.conv_id, min({{'c': v.c + CASE s WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END, 'a': v.a || CASE s WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
          't': CASE s WHEN 's' THEN list_append(list_append(v.t, 'user:'), 'assistant:') WHEN 'u' THEN list_append(v.t, 'assistant:') ELSE v.t END}}) AS v
      FROM p LEFT JOIN (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM p.conv_id
      WHERE p.i = coalesce(n, 0) GROUP BY p.conv_id),
    z AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
        count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
        count(*) FILTER (WHERE i > 1 AND before || l NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
    SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
      coalesce(illegal, 0) AS illegal, g.v.c AS cost, g.v.a AS audit, sha256(array_to_string(g.v.t, chr(10))) AS repaired_sha256
    FROM g LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM g.conv_id""",
)
def _(spark, sf):
    from cohortloom.llm.repair import audit_damaged

    return audit_damaged(spark.read.parquet(f"{sf}/conversations.parquet"))


@query(
    "op12_prefix_trie",
    f"""WITH o AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
    s AS (SELECT conv_id, list(sha256(role || chr(0) || text) ORDER BY i) AS w, list(len(text) ORDER BY i) AS l FROM o GROUP BY conv_id),
    h AS (SELECT *, {CRC32.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM s),
    r AS (SELECT c.conv_id, list_concat(coalesce(d.w[1:c.h], []), c.w[c.h + 1:]) AS w, list_concat(coalesce(d.l[1:c.h], []), c.l[c.h + 1:]) AS l
      FROM h c LEFT JOIN s d ON d.conv_id = c.conv_id - c.conv_id % 100),
    p AS (SELECT conv_id, d, array_to_string(w[1:d], ',') AS k, CASE WHEN d = 0 THEN NULL ELSE array_to_string(w[1:d - 1], ',') END AS up,
        CASE WHEN d = 0 THEN 0 ELSE l[d] END AS size, d = len(w) AS ends FROM r, unnest(range(0, len(w) + 1)) AS t(d)),
    n AS (SELECT k, any_value(up) AS up, d, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY k, d),
    c AS (SELECT n.k, n.d, count(m.k) AS kids FROM n LEFT JOIN n m ON m.up = n.k AND m.d = n.d + 1 GROUP BY n.k, n.d),
    b AS (SELECT n.*, c.kids FROM n JOIN c USING (k, d)),
    a AS (SELECT p.k, p.d, sum(q.v) AS saved, sum(q.leaf) AS leaves
      FROM (SELECT DISTINCT p.k, p.d, m.k AS below, m.d AS low FROM p JOIN p m ON m.conv_id = p.conv_id AND m.d >= p.d) p
      JOIN (SELECT k, d, (n - 1) * size AS v, CASE WHEN kids = 0 THEN 1 ELSE 0 END AS leaf FROM b) q ON q.k = p.below AND q.d = p.low GROUP BY p.k, p.d)
    SELECT b.conv_id, b.d AS depth, u.conv_id AS parent_conv_id, b.n AS n_convs, b.kids AS n_children, CAST(a.leaves AS BIGINT) AS n_leaves,
      CAST(a.saved AS BIGINT) AS saved_tokens, b.ends_sha256
    FROM b JOIN a USING (k, d) LEFT JOIN n u ON u.k = b.up AND u.d = b.d - 1""",
)
def _(spark, sf):
    from cohortloom.llm.tries import prefix_trie

    return prefix_trie(spark.read.parquet(f"{sf}/conversations.parquet"))


@query(
    "op13_debruijn_dedup",
    """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM d, unnest(range(1, len(ws) - 48)) AS t(i)),
    m AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g),
    b AS (SELECT DISTINCT w.doc_id, w.i + j AS p FROM w JOIN m USING (g), unnest(range(0, 50)) AS t(j) WHERE m.low < w.doc_id),
    k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS rest
      FROM (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM d) ANTI JOIN b USING (doc_id, p) GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id)
    SELECT d.doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
)
def _(spark, sf):
    from cohortloom.llm.debruijn import repeat_digest

    return repeat_digest(documents(spark, sf))


def load() -> tuple[dict, dict]:
    """All queries with the pipeline, whose file lies beside the package."""
    pipeline = importlib.import_module("corpus_pipeline")
    sql = dict(SQL)
    if pipeline.ORACLE_SQL is not None:
        sql["pipeline"] = pipeline.ORACLE_SQL
    return {**QUERIES, "pipeline": pipeline.run}, sql
