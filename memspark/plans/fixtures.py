"""The engine's tables, derived from the driver's Parquet by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from memspark.operators.pairs import cut

#: Each table's SQL; names in braces are other tables, of this list or of the driver's.
SQL: dict[str, str] = {
    "facts": """
        SELECT e.vec_id AS fact_id, e.vec_id % 4 AS bank_id, d.text AS content,
          CASE WHEN e.label % 2 = 0 THEN 'world' ELSE 'experience' END AS fact_type,
          CASE e.label % 5 WHEN 0 THEN 'observation' WHEN 1 THEN 'opinion' WHEN 2 THEN 'experience' ELSE 'world' END AS network,
          CASE WHEN e.vec_id % 5 = 0 THEN NULL ELSE v.ts END AS temporal_start,
          CASE WHEN e.vec_id % 7 = 0 THEN NULL ELSE v.ts + (e.vec_id % 10) * INTERVAL '1' DAY END AS temporal_end,
          e.embedding AS embedding, CASE WHEN e.label % 5 = 1 THEN CAST(e.vec_id % 10 AS DOUBLE) / 10 END AS confidence,
          v.ts AS created_at, CASE WHEN e.vec_id % 3 = 0 THEN v.ts END AS consolidated_at
        FROM {embeddings} e JOIN {documents} d ON d.doc_id = e.vec_id JOIN {events} v ON v.event_id = e.vec_id""",
    "fact_entities": """
        SELECT f.fact_id, f.bank_id, v.user_id % 25 AS entity_id FROM {facts} f JOIN {events} v ON v.event_id = f.fact_id
        UNION SELECT fact_id, bank_id, (fact_id * 7) % 25 AS entity_id FROM {facts}""",
    "entities": "SELECT CAST(n_nationkey AS BIGINT) AS entity_id, n_name AS name, lower(n_name) AS alias FROM {nation}",
    "fact_evidence": """
        SELECT fact_id, bank_id, fact_id - 4 AS evidence_id FROM {facts} WHERE network = 'observation' AND fact_id >= 4
        UNION ALL SELECT fact_id, bank_id, fact_id - 8 AS evidence_id FROM {facts} WHERE network = 'observation' AND fact_id >= 8""",
    "fact_count": "SELECT count(*) AS n FROM {facts}",
    "graph_links": """
        SELECT fact_id AS source_id, (fact_id + 4) % n AS target_id, 'semantic' AS link_type, CAST(0.9 AS DOUBLE) AS weight FROM {facts} CROSS JOIN {fact_count}
        UNION ALL SELECT fact_id, (fact_id + 4 * (2 + fact_id % 3)) % n, 'causal', CAST(0.8 AS DOUBLE) FROM {facts} CROSS JOIN {fact_count}
        UNION ALL SELECT fact_id, (fact_id + 4 * (7 + fact_id % 5)) % n, 'temporal', CAST(0.1 AS DOUBLE) + CAST(fact_id % 9 AS DOUBLE) / 10 FROM {facts} CROSS JOIN {fact_count}""",
    "sources": "SELECT conv_id * 1000 + turn AS source_id, conv_id % 4 AS bank_id, text AS content, role AS speaker, conv_id * 1440 + turn AS minute FROM {conversations}",
    "conv_count": "SELECT max(conv_id) + 1 AS n FROM {conversations}",
    "fact_sources": """
        SELECT f.fact_id, c.conv_id * 1000 + c.turn AS source_id FROM {facts} f CROSS JOIN {conv_count} k
        JOIN {conversations} c ON c.conv_id = f.fact_id % k.n""",
    "queries": """
        SELECT b.item_id AS query_id, b.item_id % 4 AS bank_id, lower(b.text) AS text, b.text AS full_text, e.embedding AS embedding
        FROM {benchmark} b JOIN {embeddings} e ON e.vec_id = b.item_id""",
    "keyword_queries": """
        SELECT fact_id AS query_id, bank_id, CASE fact_id % 4 WHEN 0 THEN split_part(content, ' ', 3) WHEN 1 THEN split_part(content, ' ', 2) || ' the ' || split_part(content, ' ', 9)
          WHEN 2 THEN split_part(content, ' ', 12) || ' ' || split_part(content, ' ', 4) || ' ' || split_part(content, ' ', 6) ELSE 'the ' || split_part(content, ' ', 5) END AS text FROM {facts}""",
    "near_mentions": """
        SELECT bank_id, fact_id AS place, embedding, CASE WHEN fact_id % 9 = 0 THEN 'E' || CAST(fact_id * 5 AS VARCHAR(20))
          ELSE CASE WHEN fact_id % 3 = 0 THEN ' M' ELSE 'm' END || CAST(CAST(floor(fact_id / 8) AS BIGINT) AS VARCHAR(20)) END AS mention FROM {facts} WHERE fact_id % 5 <> 0""",
    "near_entities": """
        SELECT bank_id, fact_id AS entity_id, 'E' || CAST(fact_id AS VARCHAR(20)) AS name, embedding FROM {facts} WHERE fact_id % 5 = 0""",
    "batch_queries": """
        SELECT *, batch_at - 8 * batch AS place FROM (SELECT fact_id AS query_id, fact_id, bank_id, lower(content) AS text, content AS full_text, content, embedding, temporal_start, temporal_end,
          CAST(floor((row_number() OVER (PARTITION BY bank_id ORDER BY created_at DESC, fact_id DESC) - 1) / 8) AS BIGINT) AS batch,
          row_number() OVER (PARTITION BY bank_id ORDER BY created_at DESC, fact_id DESC) - 1 AS batch_at
        FROM {facts} WHERE network IN ('world', 'experience') AND consolidated_at IS NULL) x""",
    "dedup_new": """
        SELECT fact_id, bank_id, embedding FROM {facts} WHERE fact_id % 2 = 1
        UNION ALL SELECT fact_id + 1000000 AS fact_id, bank_id, embedding FROM {facts} WHERE fact_id % 10 = 0""",
    "eval_results": """
        SELECT d.doc_id AS question_id, d.lang AS category, d.source AS conversation, l.quality AS correct, CAST(d.doc_id % 11 AS DOUBLE) / 10 AS f1
        FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id""",
    "stage_usage": "SELECT event_type AS stage, user_id, value AS tokens, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error FROM {events}",
    "stage_calls": "SELECT event_type AS stage, event_id % 2 AS run, value AS tokens, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error, user_id % 500 AS latency_ms FROM {events}",
    "recalled_results": "SELECT question_id, category, conversation, correct, f1, CAST(question_id % 5 AS DOUBLE) / 4 AS evidence_recall FROM {eval_results}",
    "session_turns": "SELECT conv_id, CAST(floor(turn / 3) AS BIGINT) AS session, turn, role, conv_id * 1440 + turn AS minute FROM {conversations}",
}
_NAME = re.compile(r"{(\w+)}")


def build(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of that name: the driver's Parquet, or derived from it."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "graph_links":
        # its three parts and their counts take facts' ids that are written once: Spark would make facts anew for each, and give the parts of a union so few tasks that one sorts all rows
        ids = cut(build(spark, sf_dir, "facts").select("fact_id"))
        return spark.sql(SQL[name], facts=ids, fact_count=spark.sql(SQL["fact_count"], facts=ids))
    return spark.sql(SQL[name], **{x: build(spark, sf_dir, x) for x in set(_NAME.findall(SQL[name]))})


def duckdb(sql: str) -> str:
    """sql, where names in braces are tables, with what derives these before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for x in _NAME.findall(text):
            if x in SQL and x not in order:
                need(SQL[x])
                order.append(x)

    need(sql)
    sql = sql.strip()
    head = [f"t_{x} AS ({SQL[x]})" for x in order]
    recursive = sql.upper().startswith("WITH RECURSIVE")
    if sql.upper().startswith("WITH"):
        head.append(re.sub(r"(?i)^with\s+(recursive\s+)?", "", sql))
        sql = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(head)
    elif head:
        sql = "WITH " + ",\n".join(head) + "\n" + sql
    return _NAME.sub(lambda m: f"t_{m[1]}" if m[1] in SQL else m[1], sql)
