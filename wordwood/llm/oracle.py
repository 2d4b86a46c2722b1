"""The queries of this folder in SQL for another engine, where SQL can express them.

Written from the meaning of each query: plain windows over all rows stand where Spark uses
ranges, literals stand for the constants of the code.
"""

from __future__ import annotations

LLM_ORACLE: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"

MIX = f"""
    SELECT doc_id, source, text, size, md5(concat_ws('/',
               coalesce(doc_id::VARCHAR, chr(0) || 'null'),
               coalesce(md5(text), chr(0) || 'null'), '0', '42')) AS random
    FROM (SELECT *, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size FROM documents)"""

LLM_ORACLE["op9_mixing"] = f"""
    WITH sized AS ({MIX}),
    sources AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE]
                   [1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
        FROM sized GROUP BY source),
    levels AS (
        SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                   - coalesce(sum(source_size) OVER earlier, 0) * 2.0::DOUBLE)
                  / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level,
               row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST) AS fill
        FROM sources
        WINDOW earlier AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    targets AS (
        SELECT source, source_size, least(source_size * 2.0::DOUBLE, coalesce(weight * (
                   SELECT arg_min(level, fill) FROM levels WHERE source_size * 2.0::DOUBLE > level * weight),
                   source_size * 2.0::DOUBLE)) AS target
        FROM levels),
    placed AS (
        SELECT s.*, source_size, target, floor(target + 0.5)::BIGINT AS budget,
               coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY random
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size::BIGINT AS size, source_size, target,
           (coalesce(budget // nullif(source_size, 0), 0) * size + greatest(0, least(size,
                budget - coalesce(budget // nullif(source_size, 0), 0) * source_size - before))
           )::BIGINT AS taken
    FROM placed"""


def draw(path: str) -> str:
    """The draw of a child of weight 1, as a number of this engine."""
    digest = f"md5(coalesce(doc_id::VARCHAR, chr(0) || 'null') || '{path}')"
    return f"(-ln((('0x' || substr({digest}, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE))"


# Two regions of weight 4, two racks of weight 2 in each, two shards of weight 1 in each; the
# ninth shard is a region of weight 1.
_SHARD = f"""
    CASE WHEN {draw('/r0')} / 4 < {draw('/r1')} / 4 THEN
        CASE WHEN {draw('/r0/k0')} / 2 < {draw('/r0/k1')} / 2
             THEN CASE WHEN {draw('/r0/k0/0')} < {draw('/r0/k0/1')} THEN 0 ELSE 1 END
             ELSE CASE WHEN {draw('/r0/k1/2')} < {draw('/r0/k1/3')} THEN 2 ELSE 3 END END
    ELSE
        CASE WHEN {draw('/r1/k0')} / 2 < {draw('/r1/k1')} / 2
             THEN CASE WHEN {draw('/r1/k0/4')} < {draw('/r1/k0/5')} THEN 4 ELSE 5 END
             ELSE CASE WHEN {draw('/r1/k1/6')} < {draw('/r1/k1/7')} THEN 6 ELSE 7 END END
    END"""

_CRC = """
    WITH RECURSIVE step(n, k, c) AS (
        SELECT n, 0, n FROM range(256) t(n)
        UNION ALL
        SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END
        FROM step WHERE k < 8),
    crc AS (SELECT list(c ORDER BY n) AS t FROM step WHERE k = 8)"""

LLM_ORACLE["op4_sharding"] = f"""{_CRC},
    raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h
            FROM documents),
    sums AS (
        SELECT doc_id, (octet_length(b) + 1)::BIGINT AS size,
               xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
                   list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
                   lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)::INTEGER])))::BIGINT
               AS text_crc32
        FROM raw, crc),
    placed AS (
        SELECT *, ({_SHARD})::INTEGER AS shard,
               least({draw('/r0')}, {draw('/r1')}) / 4 > {draw('/r+8')} AS moves,
               md5(concat_ws('/', coalesce(doc_id::VARCHAR, chr(0) || 'null'), size, text_crc32, 0))
               AS random
        FROM sums)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY random) - 1 AS slot,
           CASE WHEN moves THEN 8 ELSE shard END::INTEGER AS grown_shard
    FROM placed"""


def shingles(table: str, key: str) -> str:
    """Different shingles of five words of each text; all words of a shorter one."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        SELECT DISTINCT {key}, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS shingle
        FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
              FROM (SELECT {key}, regexp_extract_all({lower}, '{WORD}') AS w FROM {table})
              WHERE len(w) > 0)"""


# No item here has fewer than five words, so one width of shingles does for both sides.
LLM_ORACLE["op2_benchmark_decontamination"] = f"""
    WITH owned AS ({shingles('documents', 'doc_id')}),
    wanted AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_shingles
               FROM ({shingles('benchmark', 'item_id')}))
    SELECT doc_id, item_id, count(*) AS shared, n_shingles,
           count(*)::DOUBLE / n_shingles::DOUBLE AS containment
    FROM owned JOIN wanted USING (shingle) GROUP BY doc_id, item_id, n_shingles
    HAVING 100 * count(*) >= 80 * n_shingles"""

# All pairs that share a shingle, then everything that can be reached over links.
LLM_ORACLE["op8_ngram_jaccard"] = f"""
    WITH RECURSIVE owned AS ({shingles('documents', 'doc_id')}),
    sizes AS (SELECT doc_id, count(*) AS n FROM owned GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
        FROM owned a JOIN owned b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * c >= 80 * (x.n + y.n - c)),
    reached AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION
        SELECT doc_id, b FROM reached JOIN links ON a = other)
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
    FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""

# Every 100-byte string by itself, as 200 hexadecimal digits; then runs of what is covered.
LLM_ORACLE["op10_suffix_dedup"] = """
    WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h,
                        octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
    strings AS (
        SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS w
        FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM raw WHERE n >= 100)),
    covered AS (
        SELECT doc_id, s FROM (
            SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS place FROM strings)
        WHERE place > 1),
    marked AS (
        SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true) AS opens
        FROM covered),
    spans AS (
        SELECT doc_id, min(s) AS first, max(s) + 100 AS last
        FROM (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY doc_id ORDER BY s) AS span
              FROM marked)
        GROUP BY doc_id, span),
    pieces AS (
        SELECT doc_id, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) AS a, first AS b
        FROM (SELECT * FROM spans UNION ALL SELECT doc_id, n, NULL FROM raw)),
    kept AS (
        SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k
        FROM pieces JOIN raw USING (doc_id) GROUP BY doc_id),
    counted AS (SELECT doc_id, sum(last - first)::BIGINT AS gone, count(*) AS spans
                FROM spans GROUP BY doc_id)
    SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed,
           coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
    FROM raw JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)"""

LLM_ORACLE["op13_hard_negatives"] = """
    WITH rows AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (
        SELECT a.vec_id AS anchor, r.vec_id, a.label = r.label AS same,
               list_inner_product(a.q, r.q)::BIGINT AS score
        FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
    positives AS (
        SELECT anchor, vec_id AS positive, score FROM scores WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
    inside AS (
        SELECT p.anchor, p.positive, p.score AS positive_score, n.vec_id, n.score,
               row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY n.score DESC, n.vec_id) AS rank
        FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same
         AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
    SELECT anchor AS anchor_id, positive AS positive_id, rank::INT AS rank, vec_id AS negative_id,
           positive_score, score AS negative_score
    FROM inside WHERE rank <= 10"""
