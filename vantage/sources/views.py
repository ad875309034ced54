"""The engine's relations bound to the driver tables.

Each view is one statement that Spark and DuckDB read alike; ``{name}`` stands for a table or for another view. Positions
are months from January 1995. Only the binding is shared: operators and the SQL that checks them are written apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_MONTH = "((year({0}) - 1995) * 12 + month({0}))"
_O, _L = _MONTH.format("o_orderdate"), _MONTH.format("l_shipdate")

VIEWS: dict[str, str] = {
    "kg_positions": """
        SELECT p.pos, CASE WHEN p.pos <= 72 THEN 'published' ELSE 'draft' END AS status,
               CASE WHEN p.pos % 7 = 0 THEN 'fr' ELSE 'en' END AS lang, concat('f', p.pos % 13) AS fingerprint
        FROM (SELECT DISTINCT """ + _O + """ AS pos FROM {orders}) p""",
    "kg_entities": """
        SELECT concat('c', c_custkey) AS id, CASE WHEN c_custkey % 11 = 0 THEN 'group' ELSE 'character' END AS node_type, f.first_pos,
               CASE WHEN c_custkey % 17 = 0 THEN 'proposed' ELSE 'accepted' END AS status
        FROM {customer} JOIN (SELECT o_custkey, min(""" + _O + """) AS first_pos FROM {orders} GROUP BY o_custkey) f ON f.o_custkey = c_custkey
        UNION ALL SELECT concat('s', s_suppkey), 'group', f.first_pos, 'accepted'
        FROM {supplier} JOIN (SELECT l_suppkey, min(""" + _L + """) AS first_pos FROM {lineitem} GROUP BY l_suppkey) f ON f.l_suppkey = s_suppkey
        UNION ALL SELECT concat('p', p_partkey), 'object', f.first_pos, 'accepted'
        FROM {part} JOIN (SELECT l_partkey, min(""" + _L + """) AS first_pos FROM {lineitem} GROUP BY l_partkey) f ON f.l_partkey = p_partkey
        UNION ALL SELECT concat('n', n_nationkey), 'place', 1, 'accepted' FROM {nation}
        UNION ALL SELECT concat('r', r_regionkey), 'place', 1, 'accepted' FROM {region}""",
    "kg_assertions": """
        SELECT concat('o', o_orderkey) AS id, concat('c', o_custkey) AS subject, 'located_at' AS predicate, concat('n', c_nationkey) AS object,
               """ + _O + """ AS from_pos, CASE WHEN o_orderstatus = 'F' THEN """ + _O + """ + 12 END AS until_pos,
               CASE o_orderpriority WHEN '1-URGENT' THEN 0.9E0 WHEN '2-HIGH' THEN 0.8E0 ELSE 0.6E0 END AS confidence,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'proposed' ELSE 'accepted' END AS status,
               CASE o_orderpriority WHEN '3-MEDIUM' THEN 'belief' ELSE 'fact' END AS epistemic
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey
        UNION ALL
        SELECT concat('l', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(l_quantity AS INT)),
               CASE WHEN l_linestatus = 'F' THEN concat('s', l_suppkey) ELSE concat('c', o_custkey) END,
               CASE l_returnflag WHEN 'R' THEN 'gives' WHEN 'A' THEN 'owns' ELSE 'seeks' END, concat('p', l_partkey),
               """ + _L + """, CASE WHEN l_returnflag = 'R' THEN """ + _L + """ + 6 END,
               round(1E0 - l_discount, 2), 'accepted', 'fact'
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
        UNION ALL
        SELECT concat('i', b.c_custkey), concat('c', a.c_custkey), 'same_as', concat('c', b.c_custkey),
               CAST(12 + b.c_custkey % 48 AS INT), CAST(NULL AS INT), 1.0E0, 'accepted', 'fact'
        FROM {customer} a JOIN {customer} b ON b.c_custkey = a.c_custkey + 7 AND b.c_nationkey % 5 = a.c_nationkey % 5""",
    "kg_names": """
        SELECT concat('c', c_custkey) AS entity_id, c_name AS label, 'placeholder' AS kind, 10 AS precedence, f.first_pos AS revealed_pos
        FROM {customer} JOIN (SELECT o_custkey, min(""" + _O + """) AS first_pos FROM {orders} GROUP BY o_custkey) f ON f.o_custkey = c_custkey
        UNION ALL SELECT concat('c', c_custkey), concat(c_mktsegment, ' ', c_nationkey), 'alias', 50, CAST(6 + c_custkey % 60 AS INT) FROM {customer}
        UNION ALL SELECT concat('c', c_custkey), concat('Name ', c_custkey % 400), 'true_name', 100,
                         CASE WHEN c_custkey % 9 = 0 THEN CAST(NULL AS INT) ELSE CAST(20 + c_custkey % 55 AS INT) END FROM {customer}
        UNION ALL SELECT concat('c', c_custkey), concat('old ', c_custkey), 'wording', 5, 3 FROM {customer} WHERE c_custkey % 4 = 0
        UNION ALL SELECT concat('s', s_suppkey), s_name, 'true_name', 100, 1 FROM {supplier}
        UNION ALL SELECT concat('p', p_partkey), p_name, 'true_name', 100, 1 FROM {part}
        UNION ALL SELECT concat('n', n_nationkey), n_name, 'true_name', 100, 1 FROM {nation}
        UNION ALL SELECT concat('r', r_regionkey), r_name, 'true_name', 100, 1 FROM {region}""",
    "kg_scenes": """
        SELECT concat('e', conv_id, '-', turn) AS id, text AS summary, CAST(turn AS INT) AS ord, role = 'system' AS flashback,
               CASE WHEN turn % 3 <> 2 THEN CAST(conv_id % 80 AS INT) END AS shown_pos, CASE WHEN turn % 3 = 2 THEN CAST(conv_id % 80 + turn AS INT) END AS told_pos,
               CASE CAST(conv_id % 4 AS INT) WHEN 0 THEN 'exact' WHEN 1 THEN 'approximate' WHEN 2 THEN 'relative' ELSE 'unknown' END AS time_kind,
               CASE WHEN conv_id % 4 < 2 THEN CAST(1500 + conv_id % 30 AS INT) END AS time_year, CASE WHEN conv_id % 4 IN (0, 2) THEN CAST(conv_id % 25 AS INT) END AS years_ago,
               CASE WHEN length(text) > 500 THEN 'battle' ELSE 'event' END AS scene_type, conv_id * 100 + turn AS recorded
        FROM {conversations}""",
    "kg_questions": """
        SELECT concat('q', conv_id) AS id, text AS question, CAST(1 + conv_id % 60 AS INT) AS opened_pos,
               CASE WHEN conv_id % 3 = 0 THEN CAST(1 + conv_id % 60 + conv_id % 10 AS INT) END AS resolved_pos,
               CASE WHEN conv_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS state, CASE WHEN conv_id % 5 < 3 THEN CAST(conv_id % 70 AS INT) END AS swept_pos, conv_id * 100 AS recorded
        FROM {conversations} WHERE turn = 0""",
    "kg_occurrences": """
        SELECT DISTINCT concat('c', o_custkey) AS entity_id, """ + _O + """ AS pos, CASE WHEN o_orderkey % 3 = 0 THEN 'mention' ELSE 'appearance' END AS kind, o_orderkey % 4 <> 1 AS stated
        FROM {orders}""",
    "kg_passages": """
        SELECT CAST(doc_id AS INT) AS pos, CAST(doc_id AS BIGINT) AS doc_id, lang, text FROM {documents}""",
    "kg_evidence": """
        SELECT concat('v', conv_id, '-', turn) AS id, concat('o', conv_id) AS assertion_id, concat('e', conv_id, '-', turn) AS passage_id,
               CASE WHEN turn % 4 = 3 THEN concat('zz', substring(text, 3, 30)) WHEN turn % 5 = 4 THEN '' ELSE replace(substring(text, 2, 60), ' ', '  ') END AS excerpt,
               CASE WHEN turn % 3 = 1 THEN 'visual' ELSE 'text' END AS kind, CASE WHEN conv_id % 2 = 0 THEN concat('d', conv_id) END AS description
        FROM {conversations}""",
    "kg_attachments": """
        SELECT concat('c', o_custkey) AS entity_id, concat('img', o_orderkey) AS image, CASE WHEN o_orderkey % 10 = 0 THEN CAST(NULL AS INT) ELSE """ + _O + """ END AS revealed_pos,
               CASE WHEN o_orderkey % 3 = 0 THEN 'later' ELSE 'early' END AS era, CASE WHEN o_orderkey % 2 = 0 THEN 'poster' ELSE 'portrait' END AS kind, o_orderkey AS created
        FROM {orders}""",
    "kg_registry": """
        SELECT concat('c', o_custkey) AS entity_id, """ + _O + """ AS pos, CASE WHEN o_orderkey % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE o_totalprice END AS amount, o_orderpriority AS place, o_orderkey AS seq
        FROM {orders}""",
    "kg_glossary": """
        SELECT p_brand AS source_term, concat(p_type, ' ', p_size) AS target_term, CAST(1 + p_partkey % 70 AS INT) AS decided_pos, p_partkey AS seq FROM {part}""",
    "kg_ontology": """
        SELECT * FROM (VALUES ('located_at', 'character group', 'place', false, false, false), ('gives', 'character', 'object', false, false, false),
                              ('owns', 'character group', 'object', false, false, false), ('seeks', 'character group', 'object', false, true, false),
                              ('same_as', 'character group object place', 'character group object place', true, true, true))
        AS t(predicate, subject_types, object_types, is_symmetric, explicit_review, is_identity)""",
    "kg_steps": """
        SELECT event_id, concat('run', user_id, '-', day(ts)) AS run_id, CAST(user_id % 40 AS INT) AS pos, event_type AS step, CAST(value AS DOUBLE) AS cost, event_type = 'error' AS failed, ts,
               row_number() OVER (PARTITION BY user_id, day(ts), event_type ORDER BY ts, event_id) AS attempt, concat('h', event_id % 50) AS input_hash
        FROM {events}""",
    "kg_actions": """
        SELECT event_id, user_id, event_type AS action, ts, value FROM {events}""",
    "kg_proposals": """
        SELECT concat('k', d.doc_id) AS id, CAST(d.doc_id % 80 AS INT) AS pos, concat('run', d.doc_id % 7) AS run_id, concat('e', d.doc_id % 50) AS local_id,
               CASE CAST(d.doc_id % 4 AS INT) WHEN 0 THEN 'entity' WHEN 1 THEN 'assertion' WHEN 2 THEN 'event' ELSE 'mystery' END AS category,
               concat('c', 1 + d.doc_id % 1500) AS subject, CASE CAST(d.doc_id % 3 AS INT) WHEN 0 THEN 'owns' WHEN 1 THEN 'gives' ELSE 'same_as' END AS predicate, concat('p', 1 + d.doc_id % 2000) AS object,
               round(0.3E0 + (d.doc_id % 70) / 100E0, 2) AS confidence, CASE CAST(d.doc_id % 5 AS INT) WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'proposed' END AS status,
               d.lang, d.source, d.text AS summary, CAST(d.doc_id AS BIGINT) AS seq
        FROM {documents} d""",
    "kg_decisions": """
        SELECT concat('k', doc_id) AS id, CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS action, toxic = 1 AS flagged FROM {labels}""",
    "kg_vectors": """
        SELECT concat('c', vec_id) AS id, CASE WHEN label % 2 = 0 THEN 'entity' ELSE 'passage' END AS kind, embedding, label, vec_id, CAST(vec_id % 80 AS INT) AS pos FROM {embeddings}""",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Views:
    """The views over one folder of tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif f"kg_{name}" in VIEWS:
                sql = VIEWS[f"kg_{name}"]
                self._made[name] = self.spark.sql(sql, **{n: getattr(self, n.removeprefix("kg_")) for n in _needs(sql)})
            else:
                raise AttributeError(name)
        return self._made[name]


def oracle(body: str) -> str:
    """DuckDB SQL: ``body`` behind the definitions of the views that it names."""
    used = {n for n in VIEWS if re.search(rf"\b{n}\b", body)}
    heads = [f"{n} AS ({VIEWS[n].format(**{x: x for x in _needs(VIEWS[n])})})" for n in VIEWS if n in used]
    body = body.strip()
    if not heads:
        return body
    recursive = re.match(r"WITH\s+RECURSIVE\s+", body, re.I)
    plain = re.match(r"WITH\s+", body, re.I)
    rest = body[(recursive or plain).end() :] if (recursive or plain) else None
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(heads) + (f",\n{rest}" if rest else f"\n{body}")
