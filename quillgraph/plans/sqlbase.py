"""DuckDB building blocks of the oracles: the adapter's tables as common table expressions."""

from __future__ import annotations

from ..functions.text import STOP_WORDS

_COLUMNS = "id, kind, title, summary, content, repo_path, language, tag, status, updated_at"
ENTITY = f"""
entity({_COLUMNS}) AS (
  SELECT 'region:' || r_regionkey, 'Region', r_name, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name, c_mktsegment, NULL, NULL, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'Part', p_name, p_brand, NULL, NULL, NULL, p_type, p_type, NULL FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Order', 'Order ' || o_orderkey, o_orderpriority, NULL, NULL, NULL, NULL, o_orderstatus, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') FROM orders
  UNION ALL SELECT 'doc:' || doc_id, 'Document', split_part(text, chr(10), 1), NULL, text, source, lang, source, NULL, NULL FROM documents)"""
RELATION = """
relation(from_id, kind, to_id) AS (
  SELECT 'nation:' || n_nationkey, 'PART_OF', 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'PART_OF', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'PART_OF', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'ABOUT', 'customer:' || o_custkey FROM orders
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'DEPENDS_ON', 'supplier:' || l_suppkey FROM lineitem
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'DEPENDS_ON', 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'RELATES_TO', 'supplier:' || l_suppkey FROM lineitem)"""
ENTITY_B = f"""
entity_b({_COLUMNS}) AS (
  SELECT id, CASE WHEN kind = 'Customer' AND CAST(split_part(id, ':', 2) AS BIGINT) % 11 = 0 THEN 'Client' ELSE kind END,
         CASE WHEN kind = 'Part' AND CAST(split_part(id, ':', 2) AS BIGINT) % 7 = 0 THEN title || ' (revised)' ELSE title END,
         summary, content, repo_path, language, tag, status, updated_at
  FROM entity WHERE NOT (kind = 'Document' AND CAST(split_part(id, ':', 2) AS BIGINT) % 10 = 0)
  UNION ALL SELECT 'doc_new:' || split_part(id, ':', 2), kind, title, summary, content, repo_path, language, tag, status, updated_at
  FROM entity WHERE kind = 'Document' AND CAST(split_part(id, ':', 2) AS BIGINT) % 13 = 0)"""
RELATION_B = """
relation_b(from_id, kind, to_id) AS (
  SELECT from_id, CASE WHEN kind = 'PART_OF' AND from_id LIKE 'supplier:%' AND CAST(split_part(from_id, ':', 2) AS BIGINT) % 3 = 0 THEN 'LOCATED_IN' ELSE kind END, to_id FROM relation)"""
RUNS = """
runs AS (
  SELECT 'run-' || o_orderkey AS run_id, 'task-' || (o_custkey % 40) AS task_id,
         CASE o_custkey % 4 WHEN 0 THEN 'write_producing' WHEN 1 THEN 'troubleshooting_diagnosis' WHEN 2 THEN 'verification_audit' ELSE 'reporting_synthesis' END AS family,
         CASE o_orderkey % 5 WHEN 0 THEN 'graph_backed' WHEN 1 THEN 'baseline' WHEN 2 THEN 'with_harness' WHEN 3 THEN 'without_harness' ELSE 'graph_only' END AS mode,
         o_orderpriority AS model, o_orderstatus AS topology, o_orderkey // 5 AS seed, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS started_at,
         CASE WHEN o_orderkey % 7 <> 0 THEN 'complete' ELSE 'partial' END AS measurement_status,
         CAST(floor(o_totalprice + 0.5) AS BIGINT) AS total_tokens, 1 + o_orderkey % 97 AS wall_clock_seconds,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 6 <> 0 END AS success,
         CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 101) / 100.0 END AS quality_score,
         CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 89) / 88.0 END AS resumability_score,
         o_orderkey % 11 <> 0 AS scored
  FROM orders)"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: (id, w, term) of every field; each field gives a term once. Synonyms are added.
POSTED = f"""
field AS (
  SELECT id, 0.25 AS w, 'id' AS f, id AS text FROM entity UNION ALL SELECT id, 0.5, 'kind', kind FROM entity UNION ALL SELECT id, 4.0, 'title', title FROM entity
  UNION ALL SELECT id, 2.5, 'summary', summary FROM entity UNION ALL SELECT id, 1.0, 'content', content FROM entity
  UNION ALL SELECT id, 0.5, 'repo_path', repo_path FROM entity UNION ALL SELECT id, 3.0, 'tag', tag FROM entity),
raw AS (SELECT id, w, f, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM field),
posted AS (
  SELECT DISTINCT id, w, f, term FROM raw WHERE term NOT IN ({_STOP})
  UNION SELECT id, w, f, CASE term WHEN 'auth' THEN 'authentication' ELSE 'auth' END FROM raw WHERE term IN ('auth', 'authentication')),
posting AS (SELECT term, id AS doc_id, CAST(sum(w) AS DOUBLE) AS weight FROM posted GROUP BY term, id)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def r(expression: str, places: int = 6) -> str:
    """rounded() of functions.scalars in SQL."""
    unit = f"1e{places}"
    return f"(sign({expression}) * floor(abs({expression}) * {unit} + 0.5) / {unit})"


def norm(expression: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({expression}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def search_sql(terms: list[str], name: str = "found") -> str:
    """Search results for the given terms as a CTE with id, text and matched."""
    asked = ", ".join(f"'{t}'" for t in terms)
    return f"""
hit AS (SELECT * FROM posting WHERE term IN ({asked})),
idf AS (SELECT term, ln(1 + (SELECT count(*) FROM entity) / (1 + count(*))) AS idf FROM hit GROUP BY term),
{name} AS (SELECT doc_id AS id, sum(weight * idf) AS text, list_sort(list(term)) AS matched FROM hit JOIN idf USING (term) GROUP BY doc_id)"""


def expand_sql(intent: str) -> str:
    """One-hop expansion from ``found`` as CTEs ``gave`` (id, direction, from_id, kind, to_id) and ``near``."""
    special = {
        "dependents": ("upper(kind) = 'DEPENDS_ON' AND t", "from_id", "to_id"),
        "dependencies": ("upper(kind) = 'DEPENDS_ON' AND f", "to_id", "from_id"),
        "none": ("false", "from_id", "to_id"),
    }[intent]
    test, gain, seed = special
    return f"""
edge AS (SELECT from_id, kind, to_id, from_id IN (SELECT id FROM found) AS f, to_id IN (SELECT id FROM found) AS t FROM relation),
gave AS (
  SELECT {gain} AS id, 'supports_task' AS direction, from_id, kind, to_id FROM edge WHERE {test}
  UNION ALL SELECT {seed}, 'matched_seed', from_id, kind, to_id FROM edge WHERE {test}
  UNION ALL SELECT to_id, 'outgoing_neighbor', from_id, kind, to_id FROM edge WHERE NOT ({test}) AND f
  UNION ALL SELECT from_id, 'incoming_neighbor', from_id, kind, to_id FROM edge WHERE NOT ({test}) AND NOT f AND t),
near AS (SELECT id, sum(CASE direction WHEN 'supports_task' THEN 20.0 WHEN 'matched_seed' THEN 0.0 ELSE 2.0 END) AS structural, count(*) AS n_refs FROM gave GROUP BY id)"""


FUSED = """
fused AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.text, 0) + coalesce(b.structural, 0) AS score, coalesce(a.text, 0) AS text, coalesce(b.structural, 0) AS structural,
                 coalesce(a.matched, []) AS matched, coalesce(b.n_refs, 0) AS n_refs
          FROM found a FULL JOIN near b ON a.id = b.id)"""
