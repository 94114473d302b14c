"""Queries over the knowledge graph: search, retrieval, health, differences, store operators."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import canonical_json, rounded
from ..functions.text import normal, terms
from ..operators import diff as D
from ..operators import health as H
from ..operators import retrieval as R
from ..operators import search as S
from ..sources.adapter import entities, relations, revised_entities, revised_relations, table
from ..sources.files import delete_on_exit, shared_dir
from ..sources.index import TextIndex
from ..sources.store import RELATION as STORED_RELATION
from ..sources.store import Graph, Store
from .sqlbase import ENTITY, ENTITY_B, FUSED, POSTED, RELATION, RELATION_B, expand_sql, norm, r, search_sql, with_

QUERIES: dict = {}
ORACLE: dict = {}
TASK = "what depends on red widget?"
TASK_TERMS = ["depends", "red", "widget"]
PLAIN_TASK = "blue gear supplier overview"
RELATION_COLUMNS = [c.split()[0] for c in STORED_RELATION.split(", ")]
PLAIN_TERMS = ["blue", "gear", "overview", "supplier"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def joined(c: str) -> str:
    return f"array_to_string({c}, ',')"


_STOPS = "'a','an','and','are','does','for','how','in','is','of','on','or','the','to','what','which','who','with'"


@query(f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN ({_STOPS})))), ',') AS terms FROM conversations""")
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(terms(F.col("text")), ",").alias("terms"))


@query(with_(ENTITY, POSTED) + "SELECT term, doc_id, weight FROM posting")
def index_postings(spark: SparkSession, d: str) -> DataFrame:
    return S.postings(S.documents(entities(spark, d))).select("term", "doc_id", "weight")


@query(with_(ENTITY, POSTED, search_sql(PLAIN_TERMS)) + f"SELECT id AS doc_id, {r('text')} AS score, {joined('matched')} AS matched_terms FROM found")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    return S.search_entities(entities(spark, d), PLAIN_TASK).select("doc_id", rounded(F.col("score"), 6).alias("score"), F.array_join("matched_terms", ",").alias("matched_terms"))


@query(with_(ENTITY, POSTED, search_sql(PLAIN_TERMS)) + f"SELECT id AS doc_id, {r('text')} AS score, {joined('matched')} AS matched_terms, 'ready' AS status FROM found")
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The index is built and then found ready; scores come from stored postings alone."""
    index = TextIndex(spark, f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}")
    delete_on_exit(spark, index.base)
    e = entities(spark, d)
    index.ensure(e)
    meta, status = index.ensure(e)
    found = index.search(meta, PLAIN_TASK)
    return found.select("doc_id", rounded(F.col("score"), 6).alias("score"), F.array_join("matched_terms", ",").alias("matched_terms"), F.lit(status).alias("status"))


_POSTED_B = POSTED.replace("FROM entity", "FROM entity_b")
_SEARCH_B = search_sql(PLAIN_TERMS).replace("FROM entity", "FROM entity_b")
_RENEWED = """
renewed AS (SELECT count(*) AS n FROM entity_b b LEFT JOIN entity a ON a.id = b.id
            WHERE a.id IS NULL OR a.kind <> b.kind OR a.title IS DISTINCT FROM b.title)"""


@query(
    with_(ENTITY, ENTITY_B, _POSTED_B, _SEARCH_B, _RENEWED)
    + f"SELECT id AS doc_id, {r('text')} AS score, {joined('matched')} AS matched_terms, 'rebuilt' AS status, n AS tokenised FROM found, renewed"
)
def refreshed_search(spark: SparkSession, d: str) -> DataFrame:
    """The index of revision A is brought to revision B; only the documents that differ are tokenised."""
    index = TextIndex(spark, f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}")
    delete_on_exit(spark, index.base)
    index.ensure(entities(spark, d))
    meta, status = index.ensure(revised_entities(spark, d))
    found = index.search(meta, PLAIN_TASK).select("doc_id", rounded(F.col("score"), 6).alias("score"), F.array_join("matched_terms", ",").alias("matched_terms"))
    return found.withColumns({"status": F.lit(status), "tokenised": F.lit(meta["tokenised"]).cast("long")})


def _results(df: DataFrame) -> DataFrame:
    out = df.select("id", *[rounded(F.col(c), 6).alias(c) for c in ("score", "text", "structural")], F.array_join("matched_terms", ",").alias("matched_terms"), F.col("n_refs").cast("long").alias("n_refs"))
    return R.ranked(out)


def _fused_sql(terms_: list[str], intent: str) -> str:
    return with_(ENTITY, RELATION, POSTED, search_sql(terms_), expand_sql(intent), FUSED) + (
        f", shown AS (SELECT id, {r('score')} AS score, {r('text')} AS text, {r('structural')} AS structural, {joined('matched')} AS matched_terms, CAST(n_refs AS BIGINT) AS n_refs FROM fused)"
        " SELECT *, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM shown"
    )


@query(_fused_sql(TASK_TERMS, "dependents"))
def dependency_intent_query(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: what depends on the red widgets, ranked."""
    return _results(R.hybrid(entities(spark, d), partial(relations, spark, d), TASK, refs=False))


@query(_fused_sql(["blue", "depend", "gear"], "dependencies"))
def dependencies_of_query(spark: SparkSession, d: str) -> DataFrame:
    return _results(R.hybrid(entities(spark, d), partial(relations, spark, d), "what does blue gear depend on?", refs=False))


@query(_fused_sql(PLAIN_TERMS, "none"))
def hybrid_query(spark: SparkSession, d: str) -> DataFrame:
    return _results(R.hybrid(entities(spark, d), partial(relations, spark, d), PLAIN_TASK, refs=False))


@query(with_(ENTITY, RELATION, POSTED, search_sql(TASK_TERMS), expand_sql("dependents")) + "SELECT id, direction, count(*) AS n FROM gave GROUP BY id, direction")
def structural_expand(spark: SparkSession, d: str) -> DataFrame:
    seeds = S.search_entities(entities(spark, d), TASK).select(F.col("doc_id").alias("id"))
    return R.expand(partial(relations, spark, d), seeds, R.intent(TASK)).groupBy("id", "direction").agg(F.count(F.lit(1)).alias("n"))


@query(
    with_(ENTITY, RELATION, POSTED, search_sql(TASK_TERMS), expand_sql("dependents"), FUSED)
    + f"""SELECT id, 0 AS position, 'text_match' AS type, '' AS role, {r('text')} AS contribution, CAST(0 AS BIGINT) AS path_count, {joined('matched')} AS detail FROM fused WHERE len(matched) > 0
UNION ALL SELECT id, 1, 'graph_path', direction, {r("sum(CASE direction WHEN 'supports_task' THEN 20.0 ELSE 2.0 END)")}, count(*), array_to_string(list_sort(list_distinct(list(kind))), ',') FROM gave WHERE direction <> 'matched_seed' GROUP BY id, direction
UNION ALL SELECT id, 2, 'score_breakdown', '', {r('score')}, 0, '' FROM fused"""
)
def explain_reasons(spark: SparkSession, d: str) -> DataFrame:
    found = R.hybrid(entities(spark, d), partial(relations, spark, d), TASK)
    return R.explanation(found).withColumn("contribution", rounded(F.col("contribution"), 6))


_FATE = "CASE WHEN CAST(split_part(id, ':', 2) AS BIGINT) % 3 = 0 THEN 'rejected' WHEN CAST(split_part(id, ':', 2) AS BIGINT) % 3 = 1 THEN 'trimmed' ELSE 'survived' END"


@query(
    with_(ENTITY, RELATION, POSTED, search_sql(TASK_TERMS), expand_sql("dependents"), FUSED)
    + f""", c AS (SELECT *, {_FATE} AS fate, CAST(split_part(id, ':', 2) AS BIGINT) % 2 = 0 AS stale FROM fused)
SELECT id, {r("score * CASE fate WHEN 'rejected' THEN 0.4 WHEN 'trimmed' THEN 0.7 ELSE 1.0 END")} AS score, {r('text')} AS text, fate,
       CASE WHEN fate <> 'survived' THEN CASE WHEN stale THEN 'stale entity' ELSE 'low confidence' END || ' (composite=0.50, fate=' || fate || ')' END AS note FROM c"""
)
def downrank(spark: SparkSession, d: str) -> DataFrame:
    found = R.hybrid(entities(spark, d), partial(relations, spark, d), TASK, refs=False)
    key = F.substring_index("id", ":", -1).cast("long")
    fate = F.when(key % 3 == 0, "rejected").when(key % 3 == 1, "trimmed").otherwise("survived")
    confidence = found.select("id", F.lit(0.5).alias("composite"), fate.alias("fate"), (key % 2 == 0).alias("stale"))
    return R.down_ranked(found, confidence).select("id", rounded(F.col("score"), 6).alias("score"), rounded(F.col("text"), 6).alias("text"), "fate", F.col("down_rank_note").alias("note"))


@query(with_(ENTITY, RELATION) + "SELECT 'entity' AS record, kind, count(*) AS n FROM entity GROUP BY kind UNION ALL SELECT 'relation', kind, count(*) FROM relation GROUP BY kind")
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    count = lambda df, name: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("record"), "kind", "n")
    return count(entities(spark, d), "entity").unionByName(count(relations(spark, d), "relation"))


_ENDS = "ends AS (SELECT from_id AS id FROM relation UNION ALL SELECT to_id FROM relation)"


@query(with_(ENTITY, RELATION, _ENDS) + "SELECT e.id, e.kind, CAST(coalesce(x.n, 0) AS BIGINT) AS degree FROM entity e LEFT JOIN (SELECT id, count(*) AS n FROM ends GROUP BY id) x ON e.id = x.id")
def degree_orphans(spark: SparkSession, d: str) -> DataFrame:
    return H.degrees(entities(spark, d), relations(spark, d))


_BODY = norm("concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(content, ''), coalesce(status, ''))")
_RICH = "strlen(trim(coalesce(title, ''))) + strlen(trim(coalesce(summary, ''))) + strlen(regexp_replace(coalesce(content, ''), '^\\s+|\\s+$', '', 'g')) + CASE WHEN status IS NULL THEN 0 ELSE 6 + strlen(status) END"
_DUP = f"""
signed AS (SELECT id, {norm('kind')} AS k, {norm('title')} AS t, {_BODY} AS b, {_RICH} AS richness FROM entity),
duplicate AS (SELECT first(id ORDER BY richness DESC, id) AS canonical_id, list_sort(list(id)) AS node_ids, count(*) AS n FROM signed WHERE t <> '' AND b <> '' GROUP BY k, t, b HAVING count(*) >= 2)"""
_CON = f"""
stated AS (SELECT id, {norm('kind')} || '|' || coalesce(nullif({norm('title')}, ''), nullif({norm('repo_path')}, '')) AS subject,
                  coalesce(nullif({norm('status')}, ''), nullif({norm('content')}, ''), nullif({norm('summary')}, '')) AS value, {_RICH} AS richness FROM entity),
opposed AS (SELECT subject, count(*) AS n, count(DISTINCT value) AS n_values, list_sort(list(id)) AS node_ids, first(id ORDER BY richness DESC, id) AS canonical_id, first(value ORDER BY richness DESC, id) AS resolved
            FROM stated WHERE subject IS NOT NULL AND value IS NOT NULL GROUP BY subject HAVING count(DISTINCT value) >= 2)"""
_LONE = "lone AS (SELECT id, kind FROM entity WHERE id NOT IN (SELECT id FROM ends) AND id NOT IN (SELECT unnest(node_ids) FROM duplicate) AND id NOT IN (SELECT unnest(node_ids) FROM opposed))"


@query(with_(ENTITY, _DUP) + f"SELECT 'duplicate:' || canonical_id AS action_id, canonical_id, {joined('node_ids')} AS node_ids, n FROM duplicate")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return H.duplicate_groups(entities(spark, d)).withColumn("node_ids", F.array_join("node_ids", ","))


@query(with_(ENTITY, _CON) + f"SELECT 'contradiction:' || canonical_id AS action_id, subject, canonical_id, {joined('node_ids')} AS node_ids, n, n_values, md5(resolved) AS resolved FROM opposed")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    return H.contradictions(entities(spark, d)).withColumn("node_ids", F.array_join("node_ids", ",")).withColumn("resolved", F.md5("resolved"))


@query(with_(ENTITY, RELATION, _ENDS, _DUP, _CON, _LONE) + "SELECT id, kind FROM lone")
def orphan_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    return H.listed_orphans(e, relations(spark, d), H.duplicate_groups(e), H.contradictions(e))


_TRI = f"""
u AS (SELECT DISTINCT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM relation WHERE from_id <> to_id),
deg AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY id),
aimed AS (SELECT CASE WHEN (x.d, u.a) < (y.d, u.b) THEN u.a ELSE u.b END AS s, CASE WHEN (x.d, u.a) < (y.d, u.b) THEN u.b ELSE u.a END AS t FROM u JOIN deg x ON u.a = x.id JOIN deg y ON u.b = y.id),
tri AS (SELECT p.s AS x, p.t AS y, q.t AS z FROM aimed p JOIN aimed q ON p.s = q.s AND p.t < q.t JOIN u ON u.a = p.t AND u.b = q.t),
links AS (SELECT id, count(*) AS n FROM (SELECT x AS id FROM tri UNION ALL SELECT y FROM tri UNION ALL SELECT z FROM tri) GROUP BY id),
local AS (SELECT deg.id, d, coalesce(n, 0) AS links FROM deg LEFT JOIN links ON deg.id = links.id WHERE d >= 2)"""
_DENSITY = r("(SELECT count(*) FROM relation) / (CAST((SELECT count(*) FROM entity) AS DOUBLE) * ((SELECT count(*) FROM entity) - 1))", 4)


@query(with_(ENTITY, RELATION) + f"SELECT (SELECT count(*) FROM entity) AS nodes, (SELECT count(*) FROM relation) AS edges, {_DENSITY} AS density")
def density(spark: SparkSession, d: str) -> DataFrame:
    return H.density(entities(spark, d), relations(spark, d))


@query(with_(RELATION, _TRI) + "SELECT id, CAST(d AS BIGINT) AS d, CAST(links AS BIGINT) AS links FROM local")
def local_clustering(spark: SparkSession, d: str) -> DataFrame:
    return H.local_clustering(relations(spark, d))


@query(with_(RELATION, _TRI) + f"SELECT count(*) AS eligible, {r('avg(2.0 * links / (d * (d - 1)))', 4)} AS clustering FROM local")
def clustering(spark: SparkSession, d: str) -> DataFrame:
    return H.clustering(relations(spark, d))


_INDICATORS = with_(ENTITY, RELATION, _ENDS, _DUP, _CON, _LONE, _TRI) + f"""SELECT (SELECT count(*) FROM entity) AS nodes, (SELECT count(*) FROM relation) AS edges, {_DENSITY} AS density,
 {r('(SELECT avg(2.0 * links / (d * (d - 1))) FROM local)', 4)} AS clustering, {r('(SELECT coalesce(sum(n - 1), 0) FROM duplicate) / CAST((SELECT count(*) FROM entity) AS DOUBLE)', 4)} AS duplication_rate,
 {r('(SELECT count(*) FROM lone) / CAST((SELECT count(*) FROM entity) AS DOUBLE)', 4)} AS orphan_rate, (SELECT count(*) FROM opposed) AS contradictory_facts"""


@query(_INDICATORS)
def health_indicators(spark: SparkSession, d: str) -> DataFrame:
    return H.indicators(entities(spark, d), relations(spark, d)).drop("eligible")


@query(
    with_(ENTITY, RELATION, _ENDS, _DUP, _CON, _LONE)
    + f"""SELECT 'duplicate:' || canonical_id AS id, 'consolidate_duplicate' AS type, canonical_id, {joined('node_ids')} AS target_ids FROM duplicate
UNION ALL SELECT 'contradiction:' || canonical_id, 'resolve_contradiction', canonical_id, {joined('node_ids')} FROM opposed UNION ALL SELECT 'orphan:' || id, 'prune_orphan', NULL, id FROM lone"""
)
def hygiene_plan(spark: SparkSession, d: str) -> DataFrame:
    return H.plan_actions(entities(spark, d), relations(spark, d)).select("id", "type", "canonical_id", F.array_join("target_ids", ",").alias("target_ids"))


@query(with_(ENTITY) + f"SELECT {norm('kind')} AS kind, {norm('title')} AS title, first(id ORDER BY {_RICH} DESC, id) AS canonical_id, CAST(max({_RICH}) AS BIGINT) AS richness FROM entity GROUP BY ALL")
def canonical_pick(spark: SparkSession, d: str) -> DataFrame:
    rich = H.with_richness(entities(spark, d)).select("id", "richness", normal(F.col("kind")).alias("kind"), normal(F.col("title")).alias("title"))
    return rich.groupBy("kind", "title").agg(H.canonical().alias("canonical_id"), F.max("richness").alias("richness"))


_MOVED = "moved AS (SELECT unnest(node_ids) AS id, canonical_id FROM duplicate)"


@query(
    with_(ENTITY, RELATION, _DUP, _MOVED)
    + """, m AS (SELECT coalesce(a.canonical_id, from_id) AS f, kind, coalesce(b.canonical_id, to_id) AS t, from_id, to_id FROM relation LEFT JOIN moved a ON from_id = a.id LEFT JOIN moved b ON to_id = b.id)
SELECT f AS from_id, kind, t AS to_id, first('{"was":"' || from_id || ' ' || to_id || '"}' ORDER BY from_id, kind, to_id) AS props_json FROM m WHERE f <> t GROUP BY f, kind, t"""
)
def merge_remap(spark: SparkSession, d: str) -> DataFrame:
    """Relations say in a property which ends they had, so that the one that stays of equal ones can be told."""
    moved = H.duplicate_groups(entities(spark, d)).select(F.explode("node_ids").alias("id"), "canonical_id").where("id <> canonical_id")
    left = H.remap(relations(spark, d).select("from_id", "kind", "to_id"), moved, ends=True)
    return left.select("from_id", "kind", "to_id", F.concat(F.lit('{"was":"'), "was_from_id", F.lit(" "), "was_to_id", F.lit('"}')).alias("props_json"))


@query(
    with_(ENTITY, _DUP, _MOVED)
    + """, m AS (SELECT e.*, coalesce(canonical_id, e.id) AS target, 'k' || (strlen(e.id) % 3) AS key FROM entity e LEFT JOIN moved ON e.id = moved.id),
p AS (SELECT *, id <> target AS late FROM m),
j AS (SELECT target, key, first(id ORDER BY late, id) AS value FROM p GROUP BY target, key UNION ALL SELECT target, 'status', first(status ORDER BY late, id) FROM p WHERE status IS NOT NULL GROUP BY target),
o AS (SELECT target, '{' || string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) || '}' AS props FROM j GROUP BY target),
g AS (SELECT target AS id, first(kind ORDER BY late, id) AS kind, first(title ORDER BY strlen(coalesce(title, '')) DESC, late, id) AS title, first(summary ORDER BY strlen(coalesce(summary, '')) DESC, late, id) AS summary,
       coalesce(array_to_string(list_sort(list_distinct(list(tag) FILTER (tag IS NOT NULL))), ','), '') AS tags FROM p GROUP BY target)
SELECT g.*, o.props FROM g JOIN o ON g.id = o.target"""
)
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each node has a property named by the length of its id beside its status, so that folding can be told."""
    e = entities(spark, d)
    moved = H.duplicate_groups(e).select(F.explode("node_ids").alias("id"), "canonical_id").where("id <> canonical_id")
    status = F.get_json_object("props_json", "$.status")
    key = F.concat(F.lit("k"), (F.length("id") % 3).cast("string"))
    told = e.withColumn("props_json", F.concat(F.lit('{"'), key, F.lit('":"'), F.col("id"), F.lit('"'), F.coalesce(F.concat(F.lit(',"status":"'), status, F.lit('"')), F.lit("")), F.lit("}")))
    merged = H.merge_entities(told, moved)
    return merged.select("id", "kind", "title", "summary", F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"), F.col("props_json").alias("props"))


@query(
    with_(ENTITY, RELATION)
    + """, k AS (SELECT id FROM entity WHERE NOT (kind = 'Part' AND CAST(split_part(id, ':', 2) AS BIGINT) % 5 = 0)), s AS (SELECT * FROM relation UNION ALL SELECT * FROM relation WHERE kind = 'PART_OF')
SELECT DISTINCT from_id, kind, to_id FROM s WHERE from_id IN (SELECT id FROM k) AND to_id IN (SELECT id FROM k)"""
)
def connected_relations(spark: SparkSession, d: str) -> DataFrame:
    """Stored relations, some of them twice, of which only those between entities that are there count."""
    known = entities(spark, d).where(~((F.col("kind") == "Part") & (F.substring_index("id", ":", -1).cast("long") % 5 == 0)))
    stored = relations(spark, d).unionByName(relations(spark, d).where("kind = 'PART_OF'"))
    return D.connected(stored.select("from_id", "kind", "to_id").distinct(), known)


@query(
    with_(ENTITY, RELATION)
    + "SELECT 'entity' AS record, kind, count(*) AS n FROM entity WHERE id NOT LIKE 'part:%' GROUP BY kind UNION ALL SELECT 'relation', kind, count(*) FROM relation WHERE from_id NOT LIKE 'part:%' AND to_id NOT LIKE 'part:%' GROUP BY kind"
)
def remove_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    nodes, edges = H.remove_nodes(e, relations(spark, d), e.where("kind = 'Part'"))
    count = lambda df, name: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("record"), "kind", "n")
    return count(nodes, "entity").unionByName(count(edges, "relation"))


_DIFF = """
changed AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.kind <> b.kind OR a.tag IS DISTINCT FROM b.tag THEN 'retagged'
    WHEN a.title IS DISTINCT FROM b.title OR a.summary IS DISTINCT FROM b.summary OR a.content IS DISTINCT FROM b.content THEN 'updated' END AS change,
    CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.kind <> b.kind THEN 'kind' END, CASE WHEN a.title <> b.title THEN 'title' END) END AS changed_fields
    FROM entity a FULL JOIN entity_b b ON a.id = b.id)"""
_EDIFF = """
gone AS (SELECT * FROM relation EXCEPT SELECT * FROM relation_b), come AS (SELECT * FROM relation_b EXCEPT SELECT * FROM relation),
g1 AS (SELECT *, count(*) OVER (PARTITION BY from_id, to_id) AS n FROM gone), c1 AS (SELECT *, count(*) OVER (PARTITION BY from_id, to_id) AS n FROM come),
pair AS (SELECT g.from_id, g.to_id, g.kind AS kb, c.kind AS ka FROM g1 g JOIN c1 c ON g.from_id = c.from_id AND g.to_id = c.to_id WHERE g.n = 1 AND c.n = 1),
echanged AS (SELECT from_id, to_id, 'retagged' AS change, kb AS kind_before, ka AS kind_after FROM pair
  UNION ALL SELECT from_id, to_id, 'removed', kind, NULL FROM gone g WHERE NOT EXISTS (SELECT 1 FROM pair p WHERE p.from_id = g.from_id AND p.to_id = g.to_id)
  UNION ALL SELECT from_id, to_id, 'added', NULL, kind FROM come c WHERE NOT EXISTS (SELECT 1 FROM pair p WHERE p.from_id = c.from_id AND p.to_id = c.to_id))"""


@query(with_(ENTITY, ENTITY_B, _DIFF) + "SELECT * FROM changed WHERE change IS NOT NULL")
def diff_entities(spark: SparkSession, d: str) -> DataFrame:
    return D.diff_entities(entities(spark, d), revised_entities(spark, d))


@query(with_(RELATION, RELATION_B, _EDIFF) + "SELECT * FROM echanged")
def diff_relations(spark: SparkSession, d: str) -> DataFrame:
    return D.diff_relations(relations(spark, d), revised_relations(spark, d))


@query(with_(RELATION, RELATION_B, _EDIFF) + "SELECT from_id, to_id, kind_before, kind_after FROM echanged WHERE change = 'retagged'")
def diff_retag_edges(spark: SparkSession, d: str) -> DataFrame:
    return D.diff_relations(relations(spark, d), revised_relations(spark, d)).where("change = 'retagged'").drop("change")


@query(with_(ENTITY, ENTITY_B, RELATION, RELATION_B, _DIFF, _EDIFF) + "SELECT 'entity' AS record, change, count(*) AS n FROM changed WHERE change IS NOT NULL GROUP BY change UNION ALL SELECT 'relation', change, count(*) FROM echanged GROUP BY change")
def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return D.diff_summary(D.diff_entities(entities(spark, d), revised_entities(spark, d)), D.diff_relations(relations(spark, d), revised_relations(spark, d)))


_TAGS = """
tagged AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' ELSE 'removed' END AS change,
                  CASE WHEN a.id IS NULL THEN coalesce(b.tag, '') ELSE '' END AS tags_added, CASE WHEN b.id IS NULL THEN coalesce(a.tag, '') ELSE '' END AS tags_removed
           FROM entity a FULL JOIN entity_b b ON a.id = b.id WHERE (a.id IS NULL OR b.id IS NULL) AND coalesce(a.tag, b.tag, '') <> '')"""


@query(with_(ENTITY, ENTITY_B, _TAGS) + "SELECT * FROM tagged")
def diff_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags gained and lost; in the data only with whole documents."""
    found = D.diff_tags(entities(spark, d), revised_entities(spark, d))
    return found.withColumns({c: F.array_join(c, ",") for c in ("tags_added", "tags_removed")})


def _stored(spark: SparkSession, d: str) -> tuple[Store, str, str]:
    """A store that holds revision A and then B, and their ids."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    delete_on_exit(spark, store.base)
    said = {"agent_id": "loader", "session_id": "session-1", "timestamp": "2024-01-01T00:00:00Z"}
    whole = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in RELATION_COLUMNS])
    first = store.write(entities(spark, d), whole(relations(spark, d)), said)
    second = store.replace(Graph(revised_entities(spark, d), whole(revised_relations(spark, d))), said)
    return store, first["revision"]["id"], second["revision"]["id"]


@query(
    with_(ENTITY, ENTITY_B, RELATION, RELATION_B, _DIFF, _EDIFF)
    + """SELECT 'entity' AS record, id AS key, change, changed_fields AS detail FROM changed WHERE change IS NOT NULL
UNION ALL SELECT 'relation', from_id || ' ' || to_id, change, coalesce(kind_before, '') || '>' || coalesce(kind_after, '') FROM echanged"""
)
def stored_diff(spark: SparkSession, d: str) -> DataFrame:
    """Both revisions are stored; what differs comes from the change table of the second, no snapshot is read."""
    nodes, edges = (lambda store, a, b: store.diff(a, b))(*_stored(spark, d))
    kinds = F.concat(F.coalesce("kind_before", F.lit("")), F.lit(">"), F.coalesce("kind_after", F.lit("")))
    links = edges.select(F.lit("relation").alias("record"), F.concat_ws(" ", "from_id", "to_id").alias("key"), "change", kinds.alias("detail"))
    return nodes.select(F.lit("entity").alias("record"), F.col("id").alias("key"), "change", F.col("changed_fields").alias("detail")).unionByName(links)


@query(
    with_(ENTITY, ENTITY_B, RELATION, RELATION_B, _DIFF)
    + """, gone AS (SELECT * FROM relation EXCEPT SELECT * FROM relation_b), come AS (SELECT * FROM relation_b EXCEPT SELECT * FROM relation)
SELECT 'entity' AS record, id AS key, CASE change WHEN 'added' THEN 'created' WHEN 'removed' THEN 'removed' ELSE 'updated' END AS change FROM changed WHERE change IS NOT NULL
UNION ALL SELECT 'relation', from_id || ' ' || kind || ' ' || to_id, 'removed' FROM gone UNION ALL SELECT 'relation', from_id || ' ' || kind || ' ' || to_id, 'created' FROM come"""
)
def revision_touched(spark: SparkSession, d: str) -> DataFrame:
    """All that the second revision touched, from its change tables."""
    store, _, second = _stored(spark, d)
    nodes, edges = store.touched(second)
    keyed = edges.select(F.lit("relation").alias("record"), F.concat_ws(" ", "from_id", "kind", "to_id").alias("key"), "change")
    return nodes.select(F.lit("entity").alias("record"), F.col("id").alias("key"), "change").unionByName(keyed)


@query(with_(ENTITY, ENTITY_B, _DIFF) + "SELECT id, CASE change WHEN 'added' THEN 'created' WHEN 'removed' THEN 'removed' ELSE 'updated' END AS change FROM changed WHERE change IS NOT NULL")
def sync_diff(spark: SparkSession, d: str) -> DataFrame:
    return D.sync_diff(entities(spark, d), revised_entities(spark, d), ["id"])


@query(
    with_(ENTITY, ENTITY_B)
    + """, i AS (SELECT * FROM entity_b WHERE kind IN ('Part', 'Client') OR id LIKE 'doc_new:%')
SELECT coalesce(i.id, e.id) AS id, CASE WHEN i.id IS NULL THEN e.kind ELSE i.kind END AS kind, CASE WHEN i.id IS NULL THEN e.title ELSE i.title END AS title,
       CASE WHEN e.id IS NULL THEN 'writer' ELSE 'loader' END AS created_by, CASE WHEN i.id IS NULL THEN 'loader' ELSE 'writer' END AS updated_by,
       CASE WHEN i.id IS NULL THEN 'kept' WHEN e.id IS NULL THEN 'created' ELSE 'updated' END AS change FROM entity e FULL JOIN i ON e.id = i.id"""
)
def upsert(spark: SparkSession, d: str) -> DataFrame:
    incoming = revised_entities(spark, d).where("kind in ('Part', 'Client') or id like 'doc_new:%'").withColumn("created_by", F.lit("writer")).withColumn("updated_by", F.lit("writer"))
    return D.upsert(entities(spark, d), incoming, ["id"]).select("id", "kind", "title", "created_by", "updated_by", "change")


@query(
    with_(ENTITY, RELATION)
    + """, k AS (SELECT id FROM entity WHERE NOT (kind = 'Part' AND CAST(split_part(id, ':', 2) AS BIGINT) % 5 = 0)),
m AS (SELECT from_id, kind, to_id, from_id AS id FROM relation UNION ALL SELECT from_id, kind, to_id, to_id FROM relation)
SELECT from_id, kind, to_id, string_agg(DISTINCT id, ',' ORDER BY id) AS missing FROM m WHERE id NOT IN (SELECT id FROM k) GROUP BY ALL"""
)
def endpoint_antijoin(spark: SparkSession, d: str) -> DataFrame:
    known = entities(spark, d).where(~((F.col("kind") == "Part") & (F.substring_index("id", ":", -1).cast("long") % 5 == 0)))
    return D.missing_endpoints(relations(spark, d), known)


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.concat(F.lit("rev:"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("anchor-"), (F.col("o_custkey") % 50).cast("string")).alias("anchor"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))


_REV = "rev AS (SELECT 'rev:' || o_orderkey AS id, 'anchor-' || (o_custkey % 50) AS anchor, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM orders)"


@query(with_(_REV) + "SELECT * FROM rev ORDER BY anchor = 'anchor-7' DESC, created_at DESC, id DESC LIMIT 1")
def latest_revision(spark: SparkSession, d: str) -> DataFrame:
    return D.latest_revision(_revisions(spark, d), "anchor-7")


@query(with_(_REV) + "SELECT * FROM rev WHERE id = 'anchor-9' OR anchor = 'anchor-9' ORDER BY id = 'anchor-9' DESC, created_at, id LIMIT 1")
def revision_lookup(spark: SparkSession, d: str) -> DataFrame:
    return D.revision_for(_revisions(spark, d), "anchor-9")


@query("SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS props FROM events")
def canonical_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", canonical_json(F.col("props")).alias("props"))
