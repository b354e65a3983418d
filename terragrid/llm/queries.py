"""Registered queries of the subpackage; each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS_SQL = r"""w AS (SELECT doc_id, COALESCE(text, '') AS t, REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"""

_OP3_SQL = f"""WITH {_WORDS_SQL},
    win AS (SELECT doc_id, i, ARRAY_TO_STRING(ws[i:i + 12], ' ') AS g FROM w, UNNEST(RANGE(1, LEN(ws) - 11)) AS r(i)),
    early AS (SELECT g, MIN(doc_id) AS m FROM win GROUP BY 1),
    gone AS (SELECT DISTINCT doc_id, i + d AS p FROM win JOIN early USING (g), UNNEST(RANGE(13)) AS r(d) WHERE m < doc_id),
    each AS (SELECT doc_id, p, ws[p] AS x FROM w, UNNEST(RANGE(1, LEN(ws) + 1)) AS r(p)),
    kept AS (SELECT doc_id, STRING_AGG(x, ' ' ORDER BY p) AS k, COUNT(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
    SELECT w.doc_id, LEN(ws) AS n_words, LEN(ws) - COALESCE(n, 0) AS n_removed, SHA256(COALESCE(k, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

_OP5_SQL = rf"""WITH {_WORDS_SQL},
    win AS (SELECT doc_id, i, ARRAY_TO_STRING(ws[i:i + 7], ' ') AS g FROM w, UNNEST(RANGE(1, LEN(ws) - 6)) AS r(i)),
    twice AS (SELECT doc_id, i FROM win QUALIFY COUNT(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (SELECT doc_id, COUNT(DISTINCT i + d) AS n FROM twice, UNNEST(RANGE(8)) AS r(d) GROUP BY 1),
    dups AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT l) AS n FROM (SELECT doc_id, UNNEST(STRING_SPLIT(t, CHR(10))) AS l FROM w)
             WHERE REGEXP_MATCHES(l, '[^\x20\x09-\x0D]') GROUP BY 1),
    base AS (SELECT w.doc_id, t, LEN(ws) AS n_words, LENGTH(ARRAY_TO_STRING(ws, '')) AS word_chars, LEN(REGEXP_EXTRACT_ALL(t, '[#*$%&|<>]')) AS n_symbols,
               COALESCE(dups.n, 0) AS n_dup_lines, COALESCE(covered.n, 0) AS n_repeat_words FROM w LEFT JOIN dups ON dups.doc_id = w.doc_id LEFT JOIN covered ON covered.doc_id = w.doc_id),
    failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, LEN(REGEXP_EXTRACT_ALL(t, '\p{{L}}')) AS letters FROM base)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 3 * n_dup_lines > LEN(STRING_SPLIT(t, CHR(10)))
           OR 2 * LEN(REGEXP_EXTRACT_ALL(t, '\p{{Lu}}')) > letters OR 5 * LEN(REGEXP_EXTRACT_ALL(t, '!!')) > n_words OR 2 * letters < word_chars
           OR 4 * LEN(REGEXP_EXTRACT_ALL(t, ' \| ')) > n_words) AS kept FROM failed"""

_OP6_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, ARRAY_TO_STRING(ws[i:i + 3], ' ') AS g FROM w, UNNEST(RANGE(1, GREATEST(LEN(ws) - 2, LEAST(LEN(ws), 1) + 1))) AS r(i)),
    z AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
    common AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    linked AS (SELECT x, y FROM common JOIN z p ON p.doc_id = x JOIN z q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
    e AS (SELECT x AS a, y AS b FROM linked UNION ALL SELECT y, x FROM linked),
    walk(doc_id, root) USING KEY (doc_id) AS (
      SELECT doc_id, doc_id FROM w
      UNION
      SELECT e.b, MIN(k.root) FROM walk k JOIN e ON e.a = k.doc_id JOIN recurring.walk r ON r.doc_id = e.b WHERE k.root < r.root GROUP BY 1)
    SELECT w.doc_id, COALESCE(n, 0) AS n_shingles, root AS component_id FROM w LEFT JOIN z ON z.doc_id = w.doc_id JOIN walk ON walk.doc_id = w.doc_id"""

#: The edits of the last row first; an array for each of the four states holds cost and letters.
_OP13_SQL = r"""WITH RECURSIVE src AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
      xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(COALESCE(conv_id::VARCHAR, ' ') || ':' || COALESCE(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::BIGINT)),
        lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % 20 AS how FROM conversations),
    dam AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN TRANSLATE(text, '.!?', '') ELSE text END AS text
            FROM src, UNNEST(RANGE(CASE how WHEN 3 THEN 2 ELSE 1 END)) AS r(c) WHERE how <> 0),
    pos AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, role[1] AS ini, RTRIM(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))[-1] AS last FROM dam),
    f AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN last IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
            LEAD(ini) OVER (PARTITION BY conv_id ORDER BY i) AS nxt, COUNT(*) OVER (PARTITION BY conv_id) AS n FROM pos),
    -- states: 0 nothing yet, 1 after s, 2 after u, 3 after a; c0..c3 costs from here, a0..a3 letters
    walk AS (
      SELECT conv_id, n + 1 AS i, 0 AS c0, 6 AS c1, 3 AS c2, 0 AS c3, '' AS a0, 'II' AS a1, 'I' AS a2, '' AS a3 FROM f WHERE i = n
      UNION ALL
      SELECT conv_id, i, z[1].c, z[2].c, z[3].c, z[4].c, z[1].a, z[2].a, z[3].a, z[4].a FROM (
        SELECT conv_id, i, [list_min([b[1], {'c': 3 + y[1].c, 'a': 'I' || y[1].a}]), list_min([b[2], {'c': 3 + y[1].c, 'a': 'I' || y[1].a}]), y[1], y[2]] AS z FROM (
          SELECT conv_id, i, b, [list_min([b[3], {'c': 3 + b[4].c, 'a': 'I' || b[4].a}]), list_min([b[4], {'c': 3 + b[3].c, 'a': 'I' || b[3].a}])] AS y FROM (
            SELECT conv_id, i, list_transform([
              [{'c': 4 + c0, 'a': 'D' || a0}, {'c': k + c1, 'a': CASE WHEN ini = 's' THEN 'K' END || a1}, {'c': k + c2, 'a': CASE WHEN ini = 'u' THEN 'K' END || a2}, {'c': k + 3 + c2, 'a': 'R' || a2}, {'c': k + c0, 'a': CASE WHEN ini = '' THEN 'K' END || a0}],
              [{'c': 4 + c1, 'a': 'D' || a1}, {'c': k + c2, 'a': CASE WHEN ini = 'u' THEN 'K' END || a2}, {'c': k + 3 + c2, 'a': 'R' || a2}, {'c': k + c1, 'a': CASE WHEN ini = '' THEN 'K' END || a1}],
              [{'c': 4 + c2, 'a': 'D' || a2}, {'c': k + c3, 'a': CASE WHEN ini = 'a' THEN 'K' END || a3}, {'c': k + 3 + c3, 'a': 'R' || a3}, {'c': k + c2, 'a': CASE WHEN ini = '' THEN 'K' END || a2}],
              [{'c': 4 + c3, 'a': 'D' || a3}, {'c': k + c2, 'a': CASE WHEN ini = 'u' THEN 'K' END || a2}, {'c': k + 3 + c2, 'a': 'R' || a2}, {'c': k + c3, 'a': CASE WHEN ini = '' THEN 'K' END || a3}]],
              lambda o: list_min(list_filter(o, lambda e: e.c IS NOT NULL AND e.a IS NOT NULL))) AS b
            FROM (SELECT w.conv_id, g.i, ini, CASE g.fault WHEN 3 THEN 3 WHEN 0 THEN 0 END AS k, c0, c1, c2, c3, a0, a1, a2, a3 FROM walk w JOIN f g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i - 1))))),
    best AS (SELECT conv_id, c0 AS cost, a0 AS audit FROM walk WHERE i = 1),
    letters AS (SELECT conv_id, p, audit[p] AS l, LEN(REPLACE(audit[1:p], 'I', '')) AS i, audit FROM best, UNNEST(RANGE(1, LEN(audit) + 1)) AS r(p)),
    out AS (SELECT l.conv_id, l.p, l.l, CASE WHEN l.l = 'I' THEN '' ELSE f.text END AS text, CASE WHEN l.l = 'K' THEN f.role END AS own,
              SUM(CASE WHEN l.l = 'K' AND f.ini IN ('s', '') THEN 0 ELSE 1 END) OVER (PARTITION BY l.conv_id ORDER BY l.p) AS ua
            FROM letters l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.l <> 'I' WHERE l.l <> 'D'),
    hashes AS (SELECT conv_id, STRING_AGG(COALESCE(own, CASE WHEN ua % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p) AS body FROM out GROUP BY 1),
    stats AS (SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 1) AS blank, COUNT(*) FILTER (fault = 2) AS duplicate,
              COUNT(*) FILTER (fault = 3) AS truncated, COUNT(*) FILTER (nxt IS NOT NULL AND ini || nxt NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
    SELECT o.conv_id, COALESCE(gaps, 0)::BIGINT AS gaps, COALESCE(blank, 0)::BIGINT AS blank, COALESCE(duplicate, 0)::BIGINT AS duplicate, COALESCE(truncated, 0)::BIGINT AS truncated,
      COALESCE(illegal, 0)::BIGINT AS illegal, COALESCE(b.cost, 0)::BIGINT AS cost, COALESCE(b.audit, '') AS audit, SHA256(COALESCE(h.body, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
      LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM o.conv_id"""

_OP12_SQL = r"""WITH piece AS (SELECT lang, REGEXP_EXTRACT_ALL(p, '[^\x20\x09]+') AS ws FROM (
      SELECT COALESCE(lang, 'und') AS lang, UNNEST(REGEXP_SPLIT_TO_ARRAY(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
    g AS (SELECT lang, k, ARRAY_TO_STRING(ws[i:i + k - 1], ' ') AS p FROM piece, UNNEST(RANGE(1, 4)) AS m(k), UNNEST(RANGE(1, LEN(ws) - k + 2)) AS r(i)),
    f AS (SELECT lang, k, p, COUNT(*) AS a FROM g GROUP BY ALL),
    sizes AS (SELECT lang, SUM(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
    c AS (SELECT lang, k, p, a, STRING_SPLIT(p, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
    cuts AS (SELECT c.lang, c.k, c.p, c.a, q AS cut, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
      FROM c, UNNEST(RANGE(1, c.k)) AS u(q) JOIN f x ON x.lang = c.lang AND x.p = ARRAY_TO_STRING(c.w[1:q], ' ') JOIN f y ON y.lang = c.lang AND y.p = ARRAY_TO_STRING(c.w[q + 1:], ' ')),
    low AS (SELECT * FROM cuts QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
    over AS (SELECT DISTINCT s.lang, s.p FROM c t, UNNEST([ARRAY_TO_STRING(t.w[1:2], ' '), ARRAY_TO_STRING(t.w[2:3], ' ')]) AS u(q) JOIN c s ON s.lang = t.lang AND s.p = q WHERE t.k = 3 AND 100 * t.a >= 50 * s.a)
    SELECT lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score
    FROM low JOIN sizes USING (lang) ANTI JOIN over USING (lang, p) QUALIFY rank <= 2000"""


@query("op2_mix_sources")
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terragrid.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_token_records")
def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terragrid.llm.records import record_digests, write_records

    return record_digests(write_records(table(spark, sf_dir, "documents"), tokenizer_path()))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terragrid.llm.langid import held_out, identify

    named = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from terragrid.llm.secrets import find_secrets, joined

    found = find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op5_quality_rules", _OP5_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terragrid.llm.rules import judge

    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op1_feistel_pseudonyms")
def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terragrid.llm.pii import pseudonymize

    out = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key="terragrid-test-key")
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), F.array_join("pii", ",").alias("kinds"))


@query("op3_substring_dedup", _OP3_SQL)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terragrid.llm.substring import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terragrid.llm.lines import remove_repeated_lines

    return remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_jaccard_components", _OP6_SQL)
def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terragrid.llm.jaccard import Join, linked_components

    return linked_components(table(spark, sf_dir, "documents"), Join(shingle=4, percent=85))


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terragrid.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_conversation_repair", _OP13_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terragrid.llm.dialogue import structure_report

    return structure_report(table(spark, sf_dir, "conversations"))


@query("op12_collocations", _OP12_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terragrid.llm.phrases import best_collocations

    return best_collocations(table(spark, sf_dir, "documents"))


@query("op11_lm_scores")
def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terragrid.llm.bitmix import corpus_scores

    return corpus_scores(table(spark, sf_dir, "documents"))
