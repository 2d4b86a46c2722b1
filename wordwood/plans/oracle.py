"""The registered queries as SQL for another engine, over the same tables.

Written from the meaning of each query, not from its plan: a plain window over all rows
stands where Spark uses buckets, and closed forms stand where Spark generates rows.

Nothing is imported from the code under test. Trees depend on how the rows are partitioned, so
of a forest SQL computes the sizes, the labels and the share of the most frequent one. Its columns
``beats_majority``, ``good`` and ``valid`` are bounds: they say what must hold, and are no values
computed from the rows.
"""

from __future__ import annotations

# The whitespace of Python's str.split(), in the regex syntax of RE2.
CLASS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{CLASS}]+"
STRIP = f"^[{CLASS}]+|[{CLASS}]+$"

WORDS = f"SELECT unnest(regexp_split_to_array(text, '{WS}')) AS word FROM documents"
LINES = r"""
    SELECT unnest(regexp_split_to_array(regexp_replace(text, '(?:\r\n|\r|\n)\z', ''), '\r\n|\r|\n'))
           AS value
    FROM documents WHERE text <> ''"""
SPACE_WORDS = f"""
    SELECT unnest(string_split(regexp_replace(value, '{STRIP}', '', 'g'), ' ')) AS word
    FROM ({LINES})"""


def counts(words: str) -> str:
    return f"SELECT word, count(*) AS n FROM ({words}) WHERE word <> '' GROUP BY word"


def uniform(digest: str, word: int) -> str:
    digits = f"('0x' || substr({digest}, {8 * word + 1}, 8))::BIGINT"
    return f"(({digits} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def classification(table: str, key: str) -> str:
    """Synthetic features: four normals from one digest, the label from another."""
    r0 = f"sqrt(-2.0::DOUBLE * ln({uniform('h0', 0)}))"
    r2 = f"sqrt(-2.0::DOUBLE * ln({uniform('h0', 2)}))"
    a0 = f"(6.283185307179586::DOUBLE * {uniform('h0', 1)})"
    a2 = f"(6.283185307179586::DOUBLE * {uniform('h0', 3)})"
    return f"""
    SELECT id,
           round({r0} * cos({a0}) + CASE WHEN id % 4 IN (0, 1) THEN 1.5 ELSE -1.5 END::DOUBLE, 4)::FLOAT AS f0,
           round({r0} * sin({a0}) + CASE WHEN id % 4 IN (0, 3) THEN 1.5 ELSE -1.5 END::DOUBLE, 4)::FLOAT AS f1,
           round({r2} * cos({a2}) + CASE WHEN id % 4 = 2 THEN -1.5 ELSE 1.5 END::DOUBLE, 4)::FLOAT AS f2,
           round({r2} * sin({a2}), 4)::FLOAT AS f3,
           (CASE WHEN {uniform('h1', 0)} < 0.01
                 THEN CASE WHEN {uniform('h1', 1)} < 0.5 THEN 0 ELSE 1 END
                 ELSE id % 2 END)::INTEGER AS label
    FROM (SELECT {key} AS id, md5(concat({key}, '-42-features')) AS h0,
                 md5(concat({key}, '-42-label')) AS h1
          FROM {table})"""


RUN_LOG = """
    SELECT CASE WHEN event_id % 3 = 0 THEN 'local' ELSE 'spark' END AS engine,
           [16, 20, 24, 30, 8][1 + hour(ts) % 5] AS cores, user_id * 1000 AS size,
           ['generate', 'upload', 'train', 'count'][1 + event_id % 4] AS stage,
           value AS seconds, event_type <> 'error' AS ok
    FROM events"""


def known(agg: str, where: str) -> str:
    """An aggregate over some runs: unknown without any, and if one of them failed."""
    return f"""CASE WHEN count(*) FILTER (WHERE ({where}) AND NOT ok) = 0
                    THEN {agg}(seconds) FILTER (WHERE {where}) END"""


ORDER_HASH = "md5(concat(o_orderkey, '-42'))"
ITEM_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()
ITEM = ", ".join(ITEM_COLUMNS)
ITEM_PARTS = ", ".join(
    f"concat(length({c}::VARCHAR), ':', {c}::VARCHAR)" for c in [*ITEM_COLUMNS, "copy"]
)
ORDER_RANK = f"row_number() OVER (ORDER BY {ORDER_HASH}, o_orderkey)"

SAMPLE_WORDS = """
    SELECT unnest(['Hello', 'Spark', 'Hello', 'Big', 'Data', 'Python', 'Java', 'Hadoop', 'Cluster',
                   'AI', 'Machine', 'Learning']) AS word FROM orders"""

# Features and labels of the labelled documents do not matter here: only who is in which part.
IN_TEST = "substr(md5(concat(id, '-42')), 1, 8) < '33333333'"
LABELLED = "SELECT doc_id AS id, quality AS label FROM labels JOIN documents USING (doc_id)"
TILED = f"""
    SELECT row_number() OVER (ORDER BY md5(concat(r.id, '-42')), r.id) AS id, label
    FROM (SELECT row_number() OVER () - 1 AS id FROM orders) r
    JOIN (SELECT label, row_number() OVER (ORDER BY id) - 1 AS i FROM ({LABELLED})) l
      ON r.id % (SELECT count(*) FROM ({LABELLED})) = l.i"""


def tested(rows: str) -> str:
    return f"""
    SELECT count(*) FILTER (WHERE NOT test) AS n_train, count(*) FILTER (WHERE test) AS n_test,
           100.0::DOUBLE * (SELECT max(n) FROM (SELECT count(*) AS n FROM ({rows})
                            WHERE {IN_TEST} GROUP BY label))
               / count(*) FILTER (WHERE test) AS majority_pct,
           true AS beats_majority
    FROM (SELECT {IN_TEST} AS test FROM ({rows}))"""


def swept(table: str, key: str) -> str:
    return f"""
    SELECT n AS size, stage, trees, CASE WHEN stage = 'train' THEN n - n_test END AS n_train,
           CASE WHEN stage = 'train' THEN n_test END AS n_test, true AS ok,
           CASE WHEN stage = 'train' THEN true END AS good
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {IN_TEST}) AS n_test
          FROM (SELECT {key} AS id FROM {table})),
         (VALUES ('generate', NULL::INTEGER), ('train', 20), ('train', 30)) v(stage, trees)"""

ORACLE_SQL: dict[str, str] = {
    "word_count": counts(WORDS),
    "word_count_space": counts(SPACE_WORDS),
    "token_total": f"""
        SELECT lang, count(*) AS tokens
        FROM (SELECT lang, unnest(regexp_split_to_array(text, '{WS}')) AS word FROM documents)
        WHERE word <> '' GROUP BY lang""",
    "distinct_words": f"""
        SELECT lang, count(DISTINCT word) AS distinct_words
        FROM (SELECT lang, unnest(regexp_split_to_array(text, '{WS}')) AS word FROM documents)
        WHERE word <> '' GROUP BY lang""",
    "top10_words": f"{counts(WORDS)} ORDER BY n DESC, word LIMIT 10",
    "word_count_diff": f"""
        SELECT word, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right
        FROM ({counts(WORDS)}) a
        FULL JOIN ({counts(WORDS.replace('documents', 'conversations'))}) b USING (word)
        WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    "word_count_match": f"""
        SELECT count(a.n) AS distinct_left, count(b.n) AS distinct_right,
               count(*) FILTER (WHERE a.n IS DISTINCT FROM b.n) AS different_words,
               count(a.n) = count(b.n) AS same_distinct,
               count(*) FILTER (WHERE a.n IS DISTINCT FROM b.n) = 0 AS identical
        FROM ({counts(WORDS)}) a FULL JOIN ({counts(SPACE_WORDS)}) b USING (word)""",
    "text_size_mb": """
        SELECT source, sum(octet_length(encode(text)) + 1)::DOUBLE / 1048576.0::DOUBLE AS size_mb
        FROM documents GROUP BY source""",
    "line_scan_roundtrip": f"SELECT value, count(*) AS n FROM ({LINES}) GROUP BY value",
    "upscaled_word_count": f"""
        SELECT word, 10 * count(*) AS n FROM ({WORDS}) WHERE word <> '' GROUP BY word""",
    "sliced_word_count": f"""
        SELECT word, 10 * count(*) AS n FROM ({WORDS}) WHERE word <> '' GROUP BY word""",
    "text_token_total": f"SELECT count(*) AS tokens FROM ({WORDS}) WHERE word <> ''",
    "lines_hand_over": """
        SELECT n_name AS name, count(*) AS n
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "pandas_hand_over": """
        SELECT c_custkey AS id, (n_nationkey / 2.0)::FLOAT AS f0, n_regionkey::FLOAT AS f1,
               length(n_name)::FLOAT AS f2, 0::FLOAT AS f3, (n_regionkey % 2)::INTEGER AS label
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    # A line has 100 phrases of 11 words and 66 characters, and an end.
    "gen_text_stats": """
        SELECT lines, lines * 6601 AS bytes, lines * 1100 AS words
        FROM (SELECT ceil(sum(octet_length(encode(text)) + 1)::DOUBLE / 6601)::BIGINT AS lines
              FROM documents)""",
    "sample_lines_count": counts(SAMPLE_WORDS),
    "gen_classification": classification("orders", "o_orderkey"),
    "tile_to_size": """
        SELECT r.id, l.doc_id, l.quality, l.toxic
        FROM (SELECT row_number() OVER () - 1 AS id FROM orders) r
        JOIN (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels) l
          ON r.id % (SELECT count(*) FROM labels) = l.i""",
    "permute_rows": f"SELECT *, {ORDER_RANK} AS pos FROM orders",
    "permute_unkeyed": f"""
        SELECT *, row_number() OVER (ORDER BY md5(concat_ws('-', {ITEM_PARTS}, 42)), {ITEM}, copy) AS pos
        FROM (SELECT *, row_number() OVER (PARTITION BY {ITEM}) - 1 AS copy FROM lineitem)""",
    "hash_split": f"""
        SELECT *, CASE WHEN substr({ORDER_HASH}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS part
        FROM orders""",
    "exact_split": f"""
        SELECT *, CASE WHEN {ORDER_RANK} <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END
               AS part
        FROM orders""",
    "preview_rows": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 3",
    "scan_project_cast": """
        SELECT l_orderkey AS id, l_quantity::FLOAT AS f0, l_extendedprice::FLOAT AS f1,
               l_discount::FLOAT AS f2, l_tax::FLOAT AS f3, l_linenumber::INTEGER AS label
        FROM lineitem""",
    "feature_array": f"""
        SELECT vec_id, {", ".join(f"embedding[{i + 1}]::DOUBLE AS v{i}" for i in range(64))}
        FROM embeddings""",
    "document_features": f"""
        SELECT doc_id AS id, chars::FLOAT AS f0, len(words)::FLOAT AS f1,
               coalesce(letters::DOUBLE / nullif(chars, 0), 0)::FLOAT AS f2,
               coalesce(len(list_distinct(words))::DOUBLE / nullif(len(words), 0), 0)::FLOAT AS f3
        FROM (SELECT doc_id, length(text) AS chars,
                     length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
                     list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> '') AS words
              FROM documents)""",
    "dataset_roundtrip": "SELECT * FROM orders",
    "overwrite_dataset": "SELECT * FROM customer",
    "doc_quality_forest": tested(LABELLED),
    "doc_quality_predictions": f"""
        SELECT id, label, true AS valid
        FROM (SELECT *, row_number() OVER (ORDER BY md5(concat(id, '-42')), id) AS pos,
                     count(*) OVER () AS n FROM ({LABELLED}))
        WHERE pos <= ceil(0.2 * n)""",
    "tiled_forest": tested(TILED),
    "synthetic_forest": f"""
        SELECT sum(n)::BIGINT AS n, 100.0::DOUBLE * max(n) / sum(n) AS majority_pct,
               true AS beats_majority
        FROM (SELECT count(*) AS n FROM ({classification('orders', 'o_orderkey')}) GROUP BY label)""",
    "forest_sweep": f"{swept('customer', 'c_custkey')} UNION ALL {swept('orders', 'o_orderkey')}",
    "ensure_dataset": f"""
        SELECT *, true AS first_call, false AS second_call
        FROM ({classification('customer', 'c_custkey')})""",
    "accuracy_pct": """
        SELECT 100.0::DOUBLE * avg((quality = 1 - toxic)::INTEGER::DOUBLE) AS accuracy_pct
        FROM labels""",
    "failed_runs": f"""
        SELECT engine, cores, size, stage, CASE WHEN ok THEN seconds END AS seconds, ok
        FROM ({RUN_LOG})""",
    "stage_summary": f"""
        SELECT size, round({known('sum', "stage = 'generate'")}, 2) AS generate,
               round({known('sum', "stage = 'upload'")}, 2) AS upload,
               round({known('sum', "stage = 'train'")}, 2) AS train,
               round({known('sum', "stage = 'count'")}, 2) AS other
        FROM ({RUN_LOG}) GROUP BY size""",
    "run_matrix": f"""
        SELECT size, round({known('max', 'cores = 16')}, 2) AS cores_16,
               round({known('max', 'cores = 20')}, 2) AS cores_20,
               round({known('max', 'cores = 24')}, 2) AS cores_24,
               round({known('max', 'cores = 30')}, 2) AS cores_30,
               round({known('max', 'cores = 8')}, 2) AS cores_other
        FROM ({RUN_LOG}) GROUP BY size""",
    "speedup": f"""
        SELECT size, round(a, 2) AS local_seconds, round(b, 2) AS spark_seconds,
               round(a / nullif(b, 0), 6) AS ratio,
               CASE WHEN b < a THEN 'spark' WHEN b >= a THEN 'local' END AS winner
        FROM (SELECT size, {known('avg', "engine = 'local'")} AS a,
                     {known('avg', "engine = 'spark'")} AS b
              FROM ({RUN_LOG}) GROUP BY size)""",
    "size_labels": """
        SELECT size,
               CASE WHEN size < 1000000 THEN concat(size // 1000, 'K')
                    ELSE concat(size // 1000000, 'M') END AS label,
               concat(size // 1000, 'K') AS label_k
        FROM (SELECT o_orderkey * 1000 AS size FROM orders)""",
}

# Soft splits, files by bytes, sizes in one table, sweeps that go on, and plans.

FEATURES = ("f0", "f1", "f2", "f3")
MOMENTS = ", ".join(
    [f"round(avg({c}::DOUBLE), 6) AS mean_{c}" for c in FEATURES]
    + [
        f"round(covar_pop({a}::DOUBLE, {b}::DOUBLE), 6) AS cov_{a}_{b}"
        for i, a in enumerate(FEATURES)
        for b in FEATURES[i:]
    ]
)
NUMBERED_ORDERS = "(SELECT row_number() OVER () - 1 AS id FROM orders)"
SAMPLE_TEXT = "Hello Spark Hello Big Data Python Java Hadoop Cluster AI Machine Learning"
CUSTOMER_SPLIT = """
    SELECT (SELECT count(*) FROM customer) AS size,
           count(*) FILTER (WHERE substr(md5(concat(c_custkey, '-42')), 1, 8) < '33333333') AS n_test,
           count(*) FILTER (WHERE substr(md5(concat(c_custkey, '-42')), 1, 8) >= '33333333') AS n_train
    FROM customer"""


def one_size(table: str, key: str) -> str:
    return f"""
    SELECT (SELECT count(*) FROM {table}) AS size, count(*) AS n, sum(label)::BIGINT AS labels,
           round(sum(f0::DOUBLE), 3) AS f0, true AS untouched
    FROM ({classification(table, key)})"""


ORACLE_SQL |= {
    "split_scan": f"""
        SELECT count(*) AS tokens, true AS enough, 0::INT AS shuffles FROM ({WORDS}) WHERE word <> ''""",
    "text_sweep": """
        WITH size AS (
            SELECT sum(octet_length(encode(text)) + 1)::DOUBLE / 1048576 AS mb FROM documents),
        sizes AS (
            SELECT greatest(1, ceil(mb / 4))::BIGINT AS size FROM size
            UNION ALL SELECT greatest(2, ceil(mb))::BIGINT FROM size)
        SELECT size, 'generate' AS stage, NULL::BIGINT AS counted, true AS ok FROM sizes
        UNION ALL
        SELECT size, 'count', (ceil(size * 1048576::DOUBLE / 6601) * 1100)::BIGINT, true FROM sizes""",
    "copies_sweep": f"""
        SELECT m AS size, 'count' AS stage, m * n AS counted, true AS ok
        FROM (SELECT count(*) AS n FROM ({WORDS.replace('documents', 'conversations')}) WHERE word <> ''),
             (VALUES (1::BIGINT), (3::BIGINT)) AS f(m)""",
    "sample_lines_by_row": counts(
        f"SELECT unnest(string_split(concat_ws(' ', '{SAMPLE_TEXT}', o_orderpriority), ' ')) AS word FROM orders"
    ),
    "generated_moments": f"""
        SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, {MOMENTS},
               true AS alike
        FROM ({classification(NUMBERED_ORDERS, 'id')}) GROUP BY label""",
    "preview_any": "SELECT 3::BIGINT AS n, 3::BIGINT AS known",
    "failed_overwrite": "SELECT * FROM orders",
    "files_by_bytes": " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(*) AS n, true AS even FROM {t}" for t in ("documents", "orders", "lineitem")
    ),
    "sized_table": f"{one_size('customer', 'c_custkey')} UNION ALL {one_size('orders', 'o_orderkey')}",
    "resumed_sweep": f"""
        SELECT size, 'generate' AS stage, NULL::INT AS trees, NULL::BIGINT AS n_train, NULL::BIGINT AS n_test,
               true AS ok
        FROM ({CUSTOMER_SPLIT})
        UNION ALL
        SELECT size, 'train', trees, n_train, n_test, true
        FROM ({CUSTOMER_SPLIT}), (VALUES (5), (8)) AS t(trees)""",
    "upload_log": """
        SELECT n AS size, stage, CASE WHEN stage = 'upload' THEN n END AS counted, true AS ok
        FROM (SELECT count(*) AS n FROM customer), (VALUES ('generate'), ('upload')) AS s(stage)""",
    "pandas_plain_hand_over": """
        SELECT arrow, r_regionkey AS id, (r_regionkey / 2::DOUBLE)::FLOAT AS f0, length(r_name)::FLOAT AS f3,
               (r_regionkey % 2)::INT AS label, count(*) AS nations
        FROM region JOIN nation ON n_regionkey = r_regionkey, (VALUES (true), (false)) AS a(arrow)
        GROUP BY arrow, r_regionkey, r_name""",
    "plan_shapes": """
        SELECT * FROM (VALUES ('word_count', 1), ('token_total', 1), ('hash_split', 0), ('counts_diff', 2))
               AS p(name, shuffles)""",
}
