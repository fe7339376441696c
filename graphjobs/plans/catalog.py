"""The registered queries of the graph operators, with their SQL. Doubles are rounded to four places on both sides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analytics, corpus, index, kg, metrics, models, rank, resolve, similarity, verify
from ..operators.graph import Graph, cut, shared_folder
from ..operators.kin import count_by
from ..sources import io
from ..streaming import increment
from . import fixtures

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(select: str | None = None, name: str | None = None):
    """Register a function of a table getter; select: its SQL over the fixtures, if SQL can state it."""
    def register(f):
        key = name or f.__name__.strip("_")
        _QUERIES[key] = lambda spark, sf_dir: f(lambda t: fixtures.table(spark, sf_dir, t))
        if select:
            _SQL[key] = fixtures.sql(select) if not select.lstrip().startswith("WITH") else select
        return f
    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _graph(t, edges) -> Graph:
    return Graph(t("nodes"), count_by(edges, "relation").select(F.col("relation").alias("name")), edges)


def _r(c: str, name: str | None = None):
    return F.round(F.col(c), 4).alias(name or c)


# --- names, numbers, text -------------------------------------------------------------------------------------------

NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_ABN = "CASE WHEN length(regexp_replace({0}, '[^0-9]', '', 'g')) = 11 THEN regexp_replace({0}, '[^0-9]', '', 'g') END"


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^A-Za-z0-9 ]', ' ', 'g')) AS phrase FROM documents")
def normalise_phrase(t):
    return t("documents").select("doc_id", tx.normalise_phrase("text").alias("phrase"))


@query()
def normalise_phrase_whole(t):
    """The same by its other name, tested against brute force."""
    return t("documents").select("doc_id", tx.normalise_phrase("text").alias("phrase"))


@query(f"SELECT doc_id, {NORM.format('text')} AS own FROM documents")
def normalise_text(t):
    return t("documents").select("doc_id", tx.normalise_text("text").alias("own"))


_W = " + ".join(f"(CAST(substr(abn, {i + 1}, 1) AS INT) - {1 if i == 0 else 0}) * {w}" for i, w in enumerate((10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)))


@query(f"SELECT row_no, shard_no, abn, coalesce(({_W}) % 89 = 0, false) AS sound, CASE WHEN abn IS NOT NULL THEN substr(abn, 1, 2) || ' ' || substr(abn, 3, 3) || ' ' || substr(abn, 6, 3) || ' ' || substr(abn, 9, 3) END AS spaced FROM (SELECT row_no, shard_no, {_ABN.format('target')} AS abn FROM edges WHERE lower(trim(relation)) IN ('has abn', 'abn'))")
def norm_abn_checksum_spaced(t):
    own = t("edges").where(F.lower(F.trim("relation")).isin("has abn", "abn")).withColumn("abn", tx.norm_abn("target"))
    return own.select("row_no", "shard_no", "abn", tx.is_valid_abn("target").alias("sound"), F.when(F.col("abn").isNotNull(), tx.abn_spaced("abn")).alias("spaced"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS own FROM documents")
def clean_field(t):
    return t("documents").select("doc_id", tx.clean_field("text").alias("own"))


_NEXT = "CASE WHEN a.row_no % 5 = 0 AND b.c_name IS NOT NULL THEN "


@query("SELECT IDX, CASE WHEN ReportingEntities = '' THEN '' ELSE regexp_replace(regexp_replace(ReportingEntities, '\\)\\s*,\\s*', ')|', 'g'), '\\(([0-9 ]+)\\)', '(ABN \\1)', 'g') END AS entities, regexp_replace(regexp_replace(ReportingEntities, '\\)\\s*,\\s*', ')|', 'g'), '\\s*\\([0-9 ]+\\)', '', 'g') AS names, replace(regexp_replace(regexp_replace(ReportingEntities, '\\)\\s*,\\s*', ')|', 'g'), '\\s*\\([0-9 ]+\\)', '', 'g'), '|', ' and ') AS joined FROM register")
def parse_entities_names_join(t):
    names = tx.entity_names("ReportingEntities")
    return t("register").select("IDX", F.array_join(tx.parse_entities("ReportingEntities"), "|").alias("entities"), F.array_join(names, "|").alias("names"), tx.join_names(names).alias("joined"))


_ENTRIES = "string_split(regexp_replace(ReportingEntities, '\\)\\s*,\\s*', ')|', 'g'), '|')"
_NAMES = f"list_transform({_ENTRIES}, lambda e: regexp_replace(e, '\\s*\\([0-9 ]+\\)$', ''))"
_ALL = "CASE WHEN len({0}) = 1 THEN {0}[1] ELSE array_to_string(list_slice({0}, 1, len({0}) - 1), ', ') || ' and ' || {0}[-1] END"


@query(f"SELECT IDX, 'Modern slavery statement ' || IDX || ': ' || array_to_string(list_slice(names, 1, 3), ' & ') || CASE WHEN len(names) > 3 THEN ' et al.' ELSE '' END AS title, {_ALL.format('labelled')} || ' filed a ' || CASE WHEN Type = '' THEN 'modern slavery' ELSE lower(Type) END || ' modern slavery statement with the Australian Modern Slavery Register for the reporting period ' || PeriodStart || ' to ' || PeriodEnd || '.' || CASE WHEN HeadquarteredCountries = '' THEN '' ELSE ' The reporting ' || CASE WHEN len(names) > 1 THEN 'entities are' ELSE 'entity is' END || ' headquartered in ' || HeadquarteredCountries || '.' END || CASE WHEN AnnualRevenue = '' THEN '' ELSE ' The reporting ' || CASE WHEN len(names) > 1 THEN 'entities have' ELSE 'entity has' END || ' an annual revenue band of ' || AnnualRevenue || '.' END || CASE WHEN IndustrySectors = '' THEN '' ELSE ' The reporting ' || CASE WHEN len(names) > 1 THEN 'entities operate' ELSE 'entity operates' END || ' in the industry sectors: ' || IndustrySectors || '.' END || CASE WHEN IncludedEntities = '' THEN '' ELSE ' The statement also covers the included entities: ' || IncludedEntities || '.' END || CASE WHEN Link = '' THEN '' ELSE ' Register entry: ' || Link || '.' END AS passage FROM (SELECT *, {_NAMES} AS names, list_transform({_ENTRIES}, lambda e: regexp_replace(e, '\\(([0-9][0-9 ]*[0-9])\\)$', '(ABN \\1)')) AS labelled FROM register WHERE ReportingEntities <> '')")
def render_passage(t):
    return tx.render_passage(t("register"))


@query("SELECT title, regexp_extract(title, '^Modern slavery statement (\\S+):', 1) AS own FROM docs")
def title_idx(t):
    return t("docs").select("title", tx.title_idx("title").alias("own"))


@query("SELECT title, trim(regexp_replace(split_part(split_part(lower(regexp_extract(title, '^[^:]*:\\s*(.*)$', 1)), ',', 1), ' & ', 1), '[^a-z0-9]+', ' ', 'g')) AS company FROM docs")
def company_from_title(t):
    return t("docs").select("title", tx.company_from_title("title").alias("company"))


@query(f"SELECT name, regexp_matches({NORM.format('name')}, '\\b(pty|ltd|limited|holdings|inc|plc|corporation)\\b') AS company FROM (SELECT name || CASE row_no % 3 WHEN 0 THEN ' Pty. Ltd' WHEN 1 THEN ' Incs' ELSE '' END AS name FROM nodes)")
def is_company_name(t):
    suffix = F.when(F.col("row_no") % 3 == 0, " Pty. Ltd").when(F.col("row_no") % 3 == 1, " Incs").otherwise("")
    return t("nodes").select(F.concat("name", suffix).alias("name")).select("name", tx.is_company_name("name").alias("company"))


@query("SELECT p_partkey, 'name: ' || p_name || chr(10) || 'type: part' || chr(10) || 'brand: ' || p_brand || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'size: ' || p_size ELSE '' END AS own, p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || p_type ELSE '' END AS node FROM part")
def attributes_to_text_node_text(t):
    even = F.col("p_size") % 2 == 0
    attributes = F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.when(even, F.col("p_size").cast("string")))
    content = F.create_map(F.lit("content"), F.when(even, F.col("p_type")).otherwise(" "))
    return t("part").select("p_partkey", tx.attributes_to_text(attributes, name="p_name", type=F.lit("part")).alias("own"), tx.node_text("p_name", content).alias("node"))


@query("SELECT row_no, shard_no, lower(source) || ' [SEP] ' || relation || ' [SEP] ' || lower(target) AS fact FROM edges")
def fact_text(t):
    return t("kin_edges").every().select("row_no", "shard_no", tx.fact_text("source", "relation", "target").alias("fact"))


@query("SELECT doc_id, source || chr(10) || text AS passage FROM documents")
def with_title(t):
    return t("documents").select("doc_id", tx.with_title("source", "text").alias("passage"))


@query("SELECT event_id, props AS block, least(event_type, 'user ' || user_id) || '|' || greatest(event_type, 'user ' || user_id) AS entities, 'a;b;' || event_type AS triple FROM events")
def extract_json_parse_responses(t):
    own = t("events")
    said = F.concat(F.lit("Sure: "), "props", F.lit(" done"))
    named = F.concat(F.lit('Sure: {"named_entities": ["user '), F.col("user_id").cast("string"), F.lit('", "'), "event_type", F.lit('", "'), "event_type", F.lit('"]} ok'))
    triples = F.concat(F.lit('so {"triples": [["a", "b", "'), "event_type", F.lit('"]]} there'))
    return own.select("event_id", tx.extract_json(said).alias("block"), F.array_join(tx.parse_entities_response(named), "|").alias("entities"), F.array_join(F.get(tx.parse_triples_response(triples), F.lit(0)), ";").alias("triple"))


_WORD = "[^\\p{{L}}\\p{{M}}\\p{{N}}_]"
_ARTICLE = f"(^|{_WORD})(?:a|an|the)($|{_WORD})"
_ANSWER = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '" + _ARTICLE + "', '\\1 \\2', 'g'), '" + _ARTICLE + "', '\\1 \\2', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(f"SELECT id, {_ANSWER.format('response')} AS own, CASE WHEN contains(response, 'Answer: ') THEN regexp_replace(split_part(response, 'Answer:', 2), '^\\s+|\\s+$', '', 'g') ELSE response END AS answer FROM answers")
def normalise_extract_answer(t):
    return t("answers").select("id", tx.normalise_answer("response").alias("own"), tx.extract_answer("response").alias("answer"))


@query("SELECT CAST(source || '-' || doc_id AS VARCHAR) AS id, source AS task_type FROM documents")
def task_type(t):
    return tx.task_type(t("documents").select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("id")), "id_prefix")


@query("SELECT vec_id, i, round(v[i] / sqrt(list_dot_product(v[1:16], v[1:16])), 4) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(1, 17)) AS i FROM embeddings)")
def truncate_normalise(t):
    own = t("embeddings").select("vec_id", F.posexplode(tx.truncate_normalise("embedding", 16)).alias("i", "x"))
    return own.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), _r("x"))


@query("SELECT query, '## Relevant entity:' || chr(10) || chr(10) || string_agg('name: ' || node || chr(10) || 'content: ' || query, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'q' || query AS context FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM scores) WHERE rank <= 3 GROUP BY query")
def build_context(t):
    from ..operators.graph import top

    best = top(t("scores"), ["query"], [F.desc("score"), F.asc("node")], 3)
    asked = t("scores").select("query").distinct().select("query", F.concat(F.lit("q"), F.col("query").cast("string")).alias("question"))
    return tx.build_context(best.select("query", F.lit("entity").alias("type"), "rank", F.col("node").alias("name"), F.col("query").cast("string").alias("content")), asked)


# --- corpus ---------------------------------------------------------------------------------------------------------

@query("SELECT CASE WHEN row_number() OVER (PARTITION BY doc_id % 4, source ORDER BY doc_id) > 1 THEN source || ' (' || doc_id || ')' ELSE source END AS title, doc_id AS idx, CAST(doc_id % 4 AS INT) AS shard FROM documents")
def shard_equal(t):
    return corpus.shard_equal(t("documents").select(F.col("source").alias("title"), F.col("doc_id").alias("idx")))


@query()
def shard_ladder(t):
    docs = t("documents").select(F.col("text").alias("title"), F.col("doc_id").alias("idx"))
    return corpus.shard_ladder(docs, [16, 64, "rest"]).groupBy("shard").agg(F.count("*").alias("n"))


@query("SELECT title, max(idx) AS idx, shard FROM (SELECT source AS title, row_number() OVER (ORDER BY doc_id) - 1 AS idx, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / ceil(n / ceil(n / 700.0))) AS INT) AS shard FROM documents, (SELECT count(*) AS n FROM documents)) GROUP BY title, shard")
def shard_balanced(t):
    placed = index.placed(t("documents").select(F.col("source").alias("title"), "doc_id"), F.col("doc_id"), "idx")
    return corpus.shard_balanced(placed.select("title", "idx"))


@query("SELECT count(*) AS rows, count(*) FILTER (ReportingEntities <> '') AS docs, count(*) FILTER (ReportingEntities = '') AS skipped FROM register")
def corpus_accounting(t):
    return corpus.corpus_accounting(t("register"))


@query("SELECT title, content AS passage FROM docs WHERE content NOT IN (SELECT content FROM docs WHERE idx % 3 = 0)")
def pending_passages(t):
    docs = t("docs").select("title", F.col("content").alias("passage"), "idx")
    return corpus.pending_passages(docs, docs.where("idx % 3 = 0")).select("title", "passage")


# --- graph construction ---------------------------------------------------------------------------------------------

def _openie(t):
    part = lambda c: F.when(F.col("blank"), " ! ").otherwise(F.col(c))
    triple = F.when(F.col("two"), F.array("c_name", "r")).when(F.col("four"), F.array("c_name", "r", "t", "t")).otherwise(F.array(F.col("c_name"), part("r"), F.col("t")))
    return t("dirty").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.array("c_name").alias("extracted_entities"), F.array(triple).alias("extracted_triples"))


_P = "trim(regexp_replace(lower({0}), '[^A-Za-z0-9 ]', ' ', 'g'))"
_TRIPLES = f"SELECT 'order ' || o_orderkey AS title, 0 AS ord, {_P.format('c_name')} AS head, {_P.format('r')} AS relation, {_P.format('t')} AS tail FROM dirty WHERE NOT two AND NOT four AND NOT blank"


@query(_TRIPLES)
def clean_triples(t):
    return kg.clean_triples(_openie(t))


@query(f"SELECT unnest(['clean', 'malformed', 'ungrounded', 'triples', 'relations', 'phrases']) AS metric, unnest([(SELECT count(*) FROM ({_TRIPLES})), (SELECT count(*) FROM dirty WHERE two OR four OR blank), 0, (SELECT count(DISTINCT (head, relation, tail)) FROM ({_TRIPLES})), (SELECT count(DISTINCT relation) FROM ({_TRIPLES})), (SELECT count(DISTINCT e) FROM (SELECT head AS e FROM ({_TRIPLES}) UNION SELECT tail FROM ({_TRIPLES})))]) AS value")
def triple_quality(t):
    return kg.triple_quality(_openie(t))


@query(f"SELECT DISTINCT title, unnest([head, tail]) AS entity FROM ({_TRIPLES})")
def document_entities(t):
    return kg.document_entities(kg.clean_triples(_openie(t)))


@query(f"SELECT head, max_by(relation, (title, ord)) AS relation, tail FROM ({_TRIPLES}) GROUP BY head, tail")
def pair_relation(t):
    return kg.pair_relation(kg.clean_triples(_openie(t)))


_VEC = "SELECT 'phrase ' || vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"


@query(f"SELECT source, 'equivalent' AS relation, target FROM (SELECT a.id AS source, b.id AS target, s / max(s) OVER (PARTITION BY a.id) AS n, row_number() OVER (PARTITION BY a.id ORDER BY s DESC, b.id) AS k FROM (SELECT a.id AS aid, b.id AS bid, list_dot_product(a.v, b.v) AS s FROM ({_VEC}) a, ({_VEC}) b) p JOIN ({_VEC}) a ON a.id = aid JOIN ({_VEC}) b ON b.id = bid) WHERE k <= 100 AND source <> target AND n >= 0.5")
def synonym_edges(t):
    return kg.synonym_edges(t("embeddings").select(F.concat(F.lit("phrase "), F.col("vec_id").cast("string")).alias("phrase"), F.col("embedding").alias("vec")), 0.5)


@query(f"SELECT head AS source, CASE WHEN strlen(head) % 2 = 0 AND tail LIKE '1%' THEN 'equivalent' ELSE max_by(relation, (title, ord)) END AS relation, tail AS target FROM ({_TRIPLES}) GROUP BY head, tail")
def augment_graph(t):
    pairs = kg.pair_relation(kg.clean_triples(_openie(t)))
    same = pairs.where("length(head) % 2 = 0 AND tail LIKE '1%'").select(F.col("head").alias("source"), F.col("tail").alias("target"), F.lit("equivalent").alias("relation"))
    return kg.augment_graph(pairs, same)


_KG_SQL = f"(SELECT head, max_by(relation, (title, ord)) AS relation, tail FROM ({_TRIPLES}) GROUP BY head, tail)"


@query(f"""
SELECT 'node' AS part, 'order ' || o_orderkey AS name, 'document' AS kind, 'order ' || o_orderkey || chr(10) || 'text' AS text FROM (SELECT DISTINCT o_orderkey FROM dirty)
UNION ALL SELECT DISTINCT 'node', unnest([head, tail]), 'entity', NULL FROM {_KG_SQL}
UNION ALL SELECT 'edge', head, relation, tail FROM {_KG_SQL}
UNION ALL SELECT DISTINCT 'edge', unnest([head, tail]), 'is_mentioned_in', title FROM ({_TRIPLES})
UNION ALL SELECT DISTINCT 'relation', relation, NULL, NULL FROM {_KG_SQL} UNION ALL SELECT 'relation', 'is_mentioned_in', NULL, NULL""")
def build_kg(t):
    openie = _openie(t)
    g = kg.build_kg(openie.select("title", F.lit("text").alias("content")), openie)
    none = F.lit(None).cast("string")
    one = lambda df, part, *cols: df.select(F.lit(part).alias("part"), *[c.alias(n) for c, n in zip(cols, ("name", "kind", "text"), strict=True)])
    nodes = one(g.nodes, "node", F.col("name"), F.col("type"), F.element_at("attributes", "content"))
    return nodes.union(one(g.edges, "edge", F.col("source"), F.col("relation"), F.col("target"))).union(one(g.relations, "relation", F.col("name"), none, none))


# --- similarity -----------------------------------------------------------------------------------------------------

def _vectors(t):
    own = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return own.where("id % 100 = 0"), own.where("id % 100 <> 0")


_DOT = "SELECT q.vec_id AS query_id, c.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND c.vec_id % 100 <> 0"
_TOPK = f"SELECT query_id, id, round(score, 4) AS score, round(score / max(score) OVER (PARTITION BY query_id), 4) AS norm_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_DOT})) WHERE rank <= "


@query(_TOPK + "5")
def dense_topk(t):
    q, c = _vectors(t)
    return similarity.dense_topk(q, c, 5).select("query_id", "id", _r("score"), _r("norm_score"), "rank")


@query("SELECT query_id, id, round(score, 4) AS score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, sum(m) AS score FROM (SELECT query_id, label AS id, qid, max(score) AS m FROM (SELECT q.label AS query_id, q.vec_id AS qid, c.label AS label, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND c.vec_id % 100 <> 0) GROUP BY ALL) GROUP BY ALL)) WHERE rank <= 3")
def maxsim_topk(t):
    q, c = _vectors(t)
    tokens = lambda df: df.select(F.col("label").alias("id"), F.col("id").alias("token"), "vec")
    return similarity.maxsim_topk(tokens(q), tokens(c), 3).select("query_id", "id", _r("score"), "rank")


@query(f"SELECT query_id, id AS node FROM ({_TOPK}1)")
def link_entities(t):
    q, c = _vectors(t)
    asked = q.select(F.col("id").alias("query_id"), "vec")
    return similarity.link_entities(asked, asked.where("query_id % 200 = 0"), c.select(F.col("id").alias("name"), "vec"))


@query(f"SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_DOT}) WHERE id IN (SELECT vec_id FROM embeddings WHERE label < 5)) WHERE rank <= 8")
def flat_retrieval(t):
    q, c = _vectors(t)
    nodes = c.select("id", F.when(F.col("label") < 5, "document").otherwise("entity").alias("type"), "vec")
    return similarity.flat_retrieval(q, nodes).select("query_id", "id", "rank")


@query("SELECT a.query AS query_id, count(*) FILTER (ra <= 5 AND rb <= 5) AS overlap FROM (SELECT query, node, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS ra, row_number() OVER (PARTITION BY query ORDER BY round(score, 1) DESC, node) AS rb FROM scores) a GROUP BY a.query")
def topk_overlap(t):
    from ..operators.graph import top

    cut = lambda c: top(t("scores"), ["query"], [c.desc(), F.asc("node")], 5).select(F.col("query").alias("query_id"), F.col("node").alias("id"), "rank")
    return similarity.topk_overlap(cut(F.col("score")), cut(F.round("score", 1)))


@query(f"SELECT query_id, id AS fact_id, round((score - lo) / (hi - lo), 4) AS score FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_DOT})) WHERE rank <= 20)")
def fact_candidates_min_max(t):
    q, c = _vectors(t)
    return similarity.fact_candidates(q, c).select("query_id", "fact_id", _r("score"))


def _sinkhorn_sql(rounds: int) -> str:
    """Potentials of rows (u) and columns (v) a round, as two tables each."""
    half = "{0}{n} AS MATERIALIZED (SELECT k.g, {1}, -ln(max(m)) - ln(sum(exp(k + {2}))) AS {0} FROM k JOIN {2}{o} USING (g, {3}) JOIN s USING (g) GROUP BY k.g, {1})"
    steps = ", ".join(half.format("u", "i", "v", "j", n=n, o=n - 1) + ", " + half.format("v", "j", "u", "i", n=n, o=n) for n in range(1, rounds + 1))
    return f"""WITH n AS (SELECT n_regionkey::BIGINT AS g, n_nationkey::BIGINT AS i FROM nation),
k AS MATERIALIZED (SELECT a.g, a.i, b.i AS j, -((a.i * 31 + b.i * 17) % 10) / 10.0::DOUBLE / 0.05::DOUBLE AS k FROM n a JOIN n b USING (g)),
s AS MATERIALIZED (SELECT g, count(*)::DOUBLE AS m FROM n GROUP BY g), v0 AS MATERIALIZED (SELECT g, i AS j, 0.0::DOUBLE AS v FROM n), {steps}
SELECT k.g AS group_id, k.i, k.j, round(exp(k + u + v), 4) AS mass FROM k JOIN u{rounds} USING (g, i) JOIN v{rounds} USING (g, j)"""


@query(_sinkhorn_sql(50))
def sinkhorn_align(t):
    n = t("nation").select(F.col("n_regionkey").cast("long").alias("group_id"), F.col("n_nationkey").cast("long").alias("i"))
    costs = n.join(n.withColumnRenamed("i", "j"), "group_id").withColumn("cost", ((F.col("i") * 31 + F.col("j") * 17) % 10) / 10.0)
    return similarity.sinkhorn_align(costs).select("group_id", "i", "j", _r("mass"))


# --- union, canonical names, pruning --------------------------------------------------------------------------------

@query("SELECT source AS title, max_by(text, doc_id) AS content, count(*) - 1 AS collapsed FROM documents GROUP BY source")
def union_documents(t):
    return resolve.union_documents(t("documents").select(F.col("source").alias("title"), F.col("text").alias("content"), F.lit(0).alias("shard_no"), F.col("doc_id").alias("row_no")))


_FIRST = "SELECT source, relation, target, shard_no, row_no FROM (SELECT *, row_number() OVER (PARTITION BY source, relation, target ORDER BY shard_no, row_no) AS k FROM {0}) WHERE k = 1"


@query(_FIRST.format("edges"))
def union_edges(t):
    return resolve.union_edges(t("kin_edges")).every()


@query("SELECT name, min(shard_no * 10000000000000 + row_no) AS first FROM (SELECT source AS name, shard_no, row_no FROM edges) GROUP BY name")
def union_nodes_relations(t):
    edges = t("kin_edges")
    named = edges.listed.select(F.col("source").alias("name"), "shard_no", "row_no").union(edges.first_from())
    return resolve.union_nodes(named).select("name", (F.col("shard_no") * 10000000000000 + F.col("row_no")).alias("first"))


@query("SELECT count(*) AS missing FROM (SELECT source AS name FROM edges UNION ALL SELECT target FROM edges) WHERE name NOT IN (SELECT name FROM nodes)")
def missing_endpoints(t):
    return resolve.missing_endpoints(t("kin_edges"), t("nodes"))


_OWN = f"own AS (SELECT name, count(*) AS n, min(abn) AS abn FROM (SELECT DISTINCT source AS name, {_ABN.format('target')} AS abn FROM edges WHERE lower(trim(relation)) IN ('has abn', 'abn')) WHERE abn IS NOT NULL GROUP BY name)"
_MAP = f"{_OWN}, often AS (SELECT name, count(*) AS f FROM (SELECT source AS name FROM edges UNION ALL SELECT target FROM edges) GROUP BY name), led AS (SELECT o.name, o.abn, first_value(o.name) OVER w AS leader, count(*) OVER (PARTITION BY o.abn) AS k FROM own o JOIN often USING (name) WHERE o.n = 1 WINDOW w AS (PARTITION BY o.abn ORDER BY f DESC, length(o.name) DESC, o.name)), mapping AS (SELECT name AS variant, leader FROM led WHERE k > 1 AND name <> leader)"
_MOVED = "moved AS (SELECT coalesce(a.leader, source) AS source, relation, coalesce(b.leader, target) AS target, shard_no, row_no FROM edges LEFT JOIN mapping a ON a.variant = source LEFT JOIN mapping b ON b.variant = target), kept AS (" + _FIRST.format("moved") + " AND source <> target)"


@query(f", {_MAP} SELECT * FROM mapping")
def canonical_map(t):
    return resolve.canonical_map(t("kin_edges"))


@query(f", {_OWN} SELECT count(DISTINCT abn) FILTER (n = 1) AS abns_seen, count(*) FILTER (n > 1) AS conflicts FROM own")
def abn_conflicts(t):
    return resolve.abn_conflicts(t("edges"))


@query(f", {_MAP}, {_MOVED} SELECT * FROM kept")
def canonicalise_graph(t):
    edges = t("kin_edges").cut()  # read several times
    return resolve.canonicalise_graph(_graph(t, edges), cut(resolve.canonical_map(edges))).edges.every()


@query(f", {_MAP}, {_MOVED} SELECT (SELECT count(*) FROM mapping) AS variants_folded, (SELECT count(DISTINCT abn) FILTER (n = 1) FROM own) AS abns_seen, (SELECT count(*) FILTER (n > 1) FROM own) AS conflicts, (SELECT count(*) FROM nodes) AS nodes_in, (SELECT count(DISTINCT coalesce(leader, name)) FROM nodes LEFT JOIN mapping ON variant = name) AS nodes_out, (SELECT count(*) FROM edges) AS edges_in, (SELECT count(*) FROM moved WHERE source = target) AS self_loops_dropped, (SELECT count(*) FROM kept) AS edges_out, (SELECT count(*) FROM moved WHERE source <> target) - (SELECT count(*) FROM kept) AS duplicates_dropped")
def canonicalise_stats(t):
    edges = t("kin_edges").cut()  # read several times
    return resolve.canonicalise_stats(_graph(t, edges), cut(resolve.canonical_map(edges)))


_LITERALS = "SELECT DISTINCT target AS name FROM edges WHERE relation IN ('has revenue band', 'has annual revenue band', 'covers reporting period', 'headquartered in', 'operates in sector', 'has abn', 'abn', 'register entry')"


@query(_LITERALS)
def literal_nodes(t):
    return resolve.literal_nodes(t("edges"))


@query(f"SELECT * FROM edges WHERE relation <> 'equivalent' UNION ALL SELECT source, relation, target, shard_no, row_no FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shard_no, row_no, target) AS k FROM edges WHERE relation = 'equivalent' AND source NOT IN ({_LITERALS}) AND target NOT IN ({_LITERALS})) WHERE k <= 10")
def prune_equivalent(t):
    edges = t("kin_edges")
    return resolve.prune_equivalent(edges, resolve.literal_nodes(edges))


@query(", deg AS (SELECT source, count(*) AS d FROM edges WHERE relation = 'equivalent' GROUP BY source), srt AS (SELECT list(d ORDER BY d DESC) AS l, count(*) AS n FROM deg) SELECT unnest(['n', 'max', 'mean', 'p50', 'p90', 'p99', 'kept_5', 'kept_10', 'kept_20', 'kept_50', 'share']) AS metric, unnest([(SELECT sum(d) FROM deg)::DOUBLE, (SELECT max(d) FROM deg)::DOUBLE, round((SELECT avg(d) FROM deg), 4), (SELECT l[1 + CAST(floor(n * 0.5) AS INT)] FROM srt)::DOUBLE, (SELECT l[1 + CAST(floor(n * (1 - 0.9::DOUBLE)) AS INT)] FROM srt)::DOUBLE, (SELECT l[1 + CAST(floor(n * (1 - 0.99::DOUBLE)) AS INT)] FROM srt)::DOUBLE, (SELECT sum(least(d, 5)) FROM deg)::DOUBLE, (SELECT sum(least(d, 10)) FROM deg)::DOUBLE, (SELECT sum(least(d, 20)) FROM deg)::DOUBLE, (SELECT sum(least(d, 50)) FROM deg)::DOUBLE, round((SELECT avg(CASE WHEN relation = 'equivalent' THEN 1.0::DOUBLE ELSE 0 END) FROM edges), 4)]) AS value")
def equivalent_degree(t):
    return resolve.equivalent_degree(t("kin_edges")).select("metric", _r("value"))


@query("SELECT type, count(*) AS n FROM nodes GROUP BY type")
def type_counts(t):
    return resolve.type_counts(t("nodes"))


@query("SELECT relation, count(*) AS n FROM edges GROUP BY relation ORDER BY n DESC, relation LIMIT 25")
def relation_counts(t):
    return resolve.relation_counts(t("kin_edges"))


@query("SELECT relation, target, n, rank, edges FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY n DESC, target) AS rank, sum(n) OVER (PARTITION BY relation)::BIGINT AS edges FROM (SELECT relation, target, count(*) AS n FROM edges GROUP BY ALL)) WHERE rank <= 8")
def relation_top_targets(t):
    return resolve.relation_top_targets(t("kin_edges"))


@query("SELECT name, count(*) AS degree FROM (SELECT source AS name FROM edges UNION ALL SELECT target FROM edges) GROUP BY name ORDER BY degree DESC, name LIMIT 10")
def hub_degree(t):
    return resolve.hub_degree(t("kin_edges"))


_FIELDS = {"abn": ("has abn", "has a b n"), "sector": ("operates in sector", "received sector", "registered sector"), "revenue": ("has annual revenue band", "annual revenue band", "received annual revenue band", "registered revenue band"), "hq": ("headquartered in", "is headquartered in", "received headquartered in")}


def _first_of(name: str, rels: tuple) -> str:
    whens = " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(rels))
    return f"coalesce((SELECT arg_min(target, (CASE relation {whens} END, shard_no, row_no, target)) FROM edges WHERE source = c_name AND relation IN ({', '.join(map(repr, rels))})), '—') AS {name}"


@query("SELECT c_name AS company, " + ", ".join(_first_of(n, r) for n, r in _FIELDS.items()) + " FROM customer")
def enrich_company(t):
    return resolve.enrich_company(t("customer").select(F.col("c_name").alias("company")), t("edges"))


# --- verification ---------------------------------------------------------------------------------------------------

def _facts(t):
    return verify.register_facts(t("docs").select("shard", "title"), t("register"))


_FACTS = f"""facts AS (
  SELECT shard, IDX AS idx, 'entity' AS kind, {NORM.format('name')} AS needles FROM (SELECT shard, IDX, unnest({_NAMES}) AS name FROM listed WHERE ReportingEntities <> '')
  UNION ALL SELECT shard, IDX, 'abn', a || '|' || substr(a, 1, 2) || ' ' || substr(a, 3, 3) || ' ' || substr(a, 6, 3) || ' ' || substr(a, 9, 3) FROM (SELECT shard, IDX, unnest(regexp_extract_all(replace(ABN, ' ', ''), '[0-9]{{11}}')) AS a FROM listed)
  UNION ALL SELECT shard, IDX, 'revenue', {NORM.format('AnnualRevenue')} FROM listed WHERE AnnualRevenue <> ''
  UNION ALL SELECT shard, IDX, 'period', {NORM.format('PeriodStart')} || ' to ' || {NORM.format('PeriodEnd')} FROM listed WHERE PeriodStart <> '' AND PeriodEnd <> ''
  UNION ALL SELECT shard, IDX, 'hq', {NORM.format('HeadquarteredCountries')} FROM listed WHERE HeadquarteredCountries <> ''
  UNION ALL SELECT shard, IDX, 'sector', {NORM.format("split_part(IndustrySectors, ',', 1)")} FROM listed WHERE IndustrySectors <> '')"""
_LISTED = ", listed AS (SELECT *, CAST(row_no % 4 AS INT) AS shard FROM register WHERE row_no % 13 <> 0), " + _FACTS


@query(_LISTED + " SELECT * FROM facts")
def register_facts(t):
    return _facts(t).withColumn("needles", F.array_join("needles", "|"))


def _shard_graph(t):
    edges = t("kin_edges")
    edges = replace(edges, listed=cut(edges.listed))  # read twice
    names = edges.listed.select(F.col("shard_no").alias("shard"), F.col("source").alias("name"))
    return names.union(edges.shards_of_heads()).distinct(), edges


_LOOKED_FOR = f""", texts AS (SELECT DISTINCT shard_no AS shard, {NORM.format("source || ' ' || relation || ' ' || target")} AS x FROM edges UNION SELECT shard_no, {NORM.format('source')} FROM edges),
asked AS (SELECT DISTINCT shard, kind, idx, needles FROM facts), each AS (SELECT DISTINCT shard, unnest(string_split(needles, '|')) AS needle FROM asked),
hit AS (SELECT DISTINCT e.shard, e.needle FROM each e JOIN texts t ON t.shard = e.shard AND contains(t.x, e.needle)),
got AS (SELECT kind, shard, idx, needles, bool_or(h.needle IS NOT NULL) AS found FROM (SELECT *, unnest(string_split(needles, '|')) AS needle FROM asked) a LEFT JOIN hit h USING (shard, needle) GROUP BY ALL)
"""


@query(_LISTED + _LOOKED_FOR + """
SELECT kind, count(*) FILTER (found) AS found, count(*) AS expected, round(count(*) FILTER (found)::DOUBLE / count(*), 4) AS recall FROM got GROUP BY kind""")
def verify_facts(t):
    nodes, edges = _shard_graph(t)
    return verify.verify_facts(_facts(t), nodes, edges).select("kind", "found", "expected", _r("recall"))


@query(_LISTED + _LOOKED_FOR + "SELECT shard, idx, kind, needles FROM got WHERE NOT found")
def missing_facts(t):
    nodes, edges = _shard_graph(t)
    return verify.missing_facts(_facts(t), nodes, edges).withColumn("needles", F.array_join("needles", "|"))


@query("SELECT title, content FROM docs WHERE title LIKE '%statement x-%'")
def unregistered_docs(t):
    return verify.unregistered_docs(t("docs").select("title", "content"), t("register"))


@query(f", names AS (SELECT DISTINCT {NORM.format('c_name')} AS x FROM customer WHERE c_custkey % 97 <> 0 OR (c_custkey - 1) % 5 = 0 AND (c_custkey - 1) % 97 <> 0 AND c_custkey > 1 UNION SELECT {NORM.format('IncludedEntities')} FROM register WHERE IncludedEntities <> ''), own AS (SELECT name || ' Pty Ltd' AS name FROM nodes WHERE type <> 'document') SELECT name FROM own WHERE NOT EXISTS (SELECT 1 FROM names WHERE contains({NORM.format('name')}, x) OR contains(x, {NORM.format('name')}))")
def suspect_entities(t):
    nodes = t("nodes").select(F.when(F.col("type") == "document", F.col("name")).otherwise(F.concat("name", F.lit(" Pty Ltd"))).alias("name"), "type")
    return verify.suspect_entities(nodes, t("register"))


@query(f""", g AS (SELECT c_name AS doc_id, lower(trim(relation)) IN ('has abn', 'abn') AS is_abn, target, {_ABN.format('target')} AS abn FROM edges JOIN customer ON source = c_name),
v AS (SELECT *, is_abn AND abn IS NOT NULL AND coalesce(({_W}) % 89 = 0, false) AS ok FROM g),
known AS (SELECT {NORM.format('c_name')} AS n FROM customer UNION SELECT {NORM.format('n_name')} FROM nation),
c AS (SELECT e.c_name AS doc_id, count(DISTINCT v.abn) FILTER (ok) AS emitted, count(*) FILTER (is_abn AND NOT ok) AS invalid, count(DISTINCT v.abn) FILTER (ok AND v.abn = e.abn)::DOUBLE AS hits,
  count(DISTINCT v.abn) FILTER (ok AND v.abn IN (SELECT abn FROM named)) AS grounded, count(DISTINCT {NORM.format('v.target')}) FILTER (NOT is_abn AND {NORM.format('v.target')} NOT IN (SELECT n FROM known)) AS odd
  FROM named e LEFT JOIN v ON e.c_name = v.doc_id GROUP BY e.c_name),
p AS (SELECT *, CASE WHEN emitted + invalid > 0 THEN grounded::DOUBLE / (emitted + invalid) ELSE 0 END AS prec FROM c)
SELECT doc_id, hits AS abn_recall, round(prec, 4) AS abn_precision, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * hits + 0.4::DOUBLE * prec - 0.5::DOUBLE * invalid)), 4) AS reward_score, CAST(invalid AS INT) AS invalid, CAST(odd AS INT) AS odd, CAST(invalid + CASE WHEN odd > 0 THEN 1 ELSE 0 END AS INT) AS violations, invalid = 0 AND hits >= 0.5 AND prec >= 0.5 AS is_verified FROM p""")
def fact_gate(t):
    triples = t("kin_edges").from_sources(t("customer").select(F.col("c_name").alias("source"))).select(F.col("source").alias("doc_id"), F.col("source").alias("s"), F.col("relation").alias("r"), F.col("target").alias("t"))
    names = t("customer").select(F.col("c_name").alias("name")).union(t("nation").select("n_name"))
    got = verify.fact_gate(triples, t("named").select(F.col("c_name").alias("doc_id"), "abn"), names, t("named").select("abn"))
    return got.select("doc_id", "abn_recall", "abn_precision", "reward_score", F.size("invalid_abns").alias("invalid"), F.size("hallucinated_entities").alias("odd"), F.size("violations").alias("violations"), "is_verified")


@query(", rw AS (SELECT group_id, id, greatest(0.0::DOUBLE, 0.5 * gate + 0.5 * CAST(answer_matched AS INT) - 0.05 * greatest(0, num_hops - 1) - 0.02 * greatest(0, max_node_degree - 10)) AS reward FROM trajectories) SELECT group_id, id, round(reward, 4) AS reward, round(CASE WHEN count(*) OVER w > 1 AND stddev_pop(reward) OVER w >= 1e-6 THEN (reward - avg(reward) OVER w) / stddev_pop(reward) OVER w ELSE 0 END, 4) + 0.0 AS advantage FROM rw WINDOW w AS (PARTITION BY group_id)")
def grpo_advantages(t):
    got = verify.grpo_advantages(t("trajectories"))
    return got.select("group_id", "id", _r("reward"), (F.round("advantage", 4) + 0.0).alias("advantage"))  # no negative zero


@query(f""", own AS (SELECT d.title AS gold_doc, r.*, {_NAMES} AS names FROM docs d JOIN register r ON regexp_extract(d.title, '^Modern slavery statement (\\S+):', 1) = r.IDX WHERE ReportingEntities <> '')
SELECT 'What industry sectors does ' || names[1] || ' operate in?' AS q, trim(split_part(IndustrySectors, ',', 1)) AS gold_answer, gold_doc FROM own WHERE IndustrySectors <> ''
UNION ALL SELECT 'What is the annual revenue band of ' || names[1] || '?', AnnualRevenue, gold_doc FROM own WHERE AnnualRevenue <> ''
UNION ALL SELECT 'Which reporting period does the modern slavery statement of ' || names[1] || ' cover?', PeriodStart, gold_doc FROM own WHERE PeriodStart <> ''
UNION ALL SELECT 'Which entities filed a joint modern slavery statement with ' || names[-1] || '?', names[1], gold_doc FROM own WHERE len(names) > 1""")
def qa_testset(t):
    return verify.qa_testset(t("docs"), t("register"))


@query(f"SELECT round(avg(CASE WHEN gold_doc BETWEEN 1 AND 5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_at_k, round(avg(CASE WHEN contains({NORM.format('response')}, {NORM.format('alias')}) THEN 1.0::DOUBLE ELSE 0 END), 4) AS answer_accuracy FROM (SELECT *, id % 9 AS gold_doc FROM answers)")
def qa_score(t):
    own = t("answers").withColumn("gold_doc", F.col("id") % 9)
    got = verify.qa_score(own.select(F.array(*[F.lit(i).cast("long") for i in range(1, 9)]).alias("retrieved"), "gold_doc", F.col("response").alias("answer"), F.col("alias").alias("gold_answer")))
    return got.select(_r("hit_at_k"), _r("answer_accuracy"))


@query(", s AS (SELECT list(value ORDER BY value) AS l, count(*) AS n, avg(value) AS m FROM events) SELECT n, round(m, 4) AS mean, round(l[1 + n // 2], 4) AS median, round(l[1], 4) AS min, round(l[-1], 4) AS max, round(l[CAST(floor(n * 0.9) AS INT)], 4) AS p90 FROM s")
def latency_summary(t):
    return verify.latency_summary(t("events"), "value").select("n", *[_r(c) for c in ("mean", "median", "min", "max", "p90")])


# --- ids and samples ------------------------------------------------------------------------------------------------

_IDS = "ids AS (SELECT name, type, row_number() OVER (ORDER BY row_no, name) - 1 AS id FROM nodes)"


@query(f", {_IDS} SELECT name, id, dense_rank() OVER (ORDER BY f) - 1 AS type_id FROM (SELECT *, min(id) OVER (PARTITION BY type) AS f FROM ids)")
def assign_ids(t):
    return index.assign_ids(t("nodes")).select("name", "id", "type_id")


def _rels(t):
    edges = t("kin_edges")
    rows = edges.listed.select(F.col("relation").alias("name"), "row_no").union(edges.first_rows())
    return index.relation_ids(rows.groupBy("name").agg(F.min("row_no").alias("row_no")))


_ENC = f"{_IDS}, rels AS (SELECT relation AS name, row_number() OVER (ORDER BY min(row_no), relation) - 1 AS id FROM edges GROUP BY relation), enc AS (SELECT u.id AS u, v.id AS v, r.id AS r FROM edges JOIN ids u ON u.name = source JOIN ids v ON v.name = target JOIN rels r ON r.name = relation)"


@query(f", {_ENC} SELECT u, v, r, count(*) AS n FROM enc GROUP BY ALL")
def encode_edges(t):
    return index.counted_edges(t("kin_edges").cut(), cut(index.assign_ids(t("nodes"))), cut(_rels(t)))


@query("SELECT u, v, r FROM encoded UNION ALL SELECT v, u, r + 3 FROM encoded")
def inverse_edges(t):
    names = t("encoded").select(F.col("r").alias("id")).distinct().withColumn("name", F.col("id").cast("string"))
    return index.inverse_edges(t("encoded"), names, 3)[0]


def _typed(t):
    e = t("encoded")
    kind = F.when(F.col("id") >= 3000000, "region").when(F.col("id") >= 2000000, "supplier").when(F.col("id") >= 1000000, "nation").otherwise("customer")
    return e.select(F.col("u").alias("id")).union(e.select("v")).distinct().withColumn("type", kind).withColumn("name", F.col("id").cast("string"))


_KIND = "CASE WHEN {0} >= 3000000 THEN 'region' WHEN {0} >= 2000000 THEN 'supplier' WHEN {0} >= 1000000 THEN 'nation' ELSE 'customer' END"


@query(f"SELECT DISTINCT {_KIND.format('id')} AS type, id FROM (SELECT u AS id FROM encoded UNION SELECT v FROM encoded)")
def nodes_by_type(t):
    return index.nodes_by_type(_typed(t)).select("type", "id")


@query("SELECT u, v, r FROM (SELECT u, v, r FROM encoded UNION ALL SELECT u, u, r FROM encoded WHERE r = 1) WHERE u >= 2000000 AND v >= 2000000 AND u < 3000000 AND v < 3000000")
def restrict_to_type(t):
    e = t("encoded")
    return index.restrict_to_type(e.union(e.where("r = 1").select("u", "u", "r")), _typed(t), "supplier")


@query("SELECT 'nation' AS other_type, u, v, count(*) AS weight FROM encoded WHERE r = 0 GROUP BY u, v")
def target_to_other(t):
    return index.target_to_other(t("encoded"), _typed(t), "customer")


@query("""
SELECT 'node' AS kind, id, 'name: ' || id || chr(10) || 'type: ' || type || chr(10) || 'size: ' || id % 7 AS text, 1 AS sign FROM (
  SELECT DISTINCT id, """ + _KIND.format("id") + """ AS type FROM (SELECT u AS id FROM encoded UNION SELECT v FROM encoded))
UNION ALL SELECT 'relation', r, 'name: ' || r || chr(10) || 'rank: ' || r + 1, 1 FROM (SELECT DISTINCT r FROM encoded)
UNION ALL SELECT 'relation', r + 3, 'name: inverse_' || r || chr(10) || 'rank: ' || r + 1, 1 FROM (SELECT DISTINCT r FROM encoded)
UNION ALL SELECT 'edge', u, 'weight: ' || r, 1 FROM encoded""")
def embedding_inputs(t):
    one = lambda key, value: F.create_map(F.lit(key), value.cast("string")).alias("attributes")
    rels = t("encoded").select(F.col("r").alias("id")).distinct().select("id", F.col("id").cast("string").alias("name"), one("rank", F.col("id") + 1))
    edges = t("encoded").select(F.col("u").alias("id"), one("weight", F.col("r")))
    return index.embedding_inputs(_typed(t).withColumn("attributes", one("size", F.col("id") % 7)), rels, 3, "text", edges)


def _samples(t):
    return t("customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_custkey").cast("string"), F.lit("nobody")).alias("start_nodes"), F.when(F.col("c_custkey") % 3 > 0, (F.col("c_nationkey") + 1000000).cast("string")).otherwise("none").alias("to"))


@query("SELECT c_custkey AS id, unnest(['start', 'target']) AS role, unnest([c_custkey, c_nationkey + 1000000]) AS node_id FROM customer WHERE c_custkey % 3 > 0")
def qa_masks(t):
    own = _samples(t).select("id", F.create_map(F.lit("entity"), "start_nodes").alias("start_nodes"), F.create_map(F.lit("entity"), F.array("to")).alias("target_nodes"))
    return index.qa_masks(own, _typed(t))


def _mentioned(t):
    return t("mentions").select(F.col("entity").alias("source"), F.lit("is_mentioned_in").alias("relation"), F.col("doc").alias("target"))


@query("SELECT doc, string_agg(entity, '|' ORDER BY entity) AS entities FROM mentions GROUP BY doc")
def doc_entities_map(t):
    return index.doc_entities_map(_mentioned(t)).select("doc", F.array_join("entities", "|").alias("entities"))


def _support(t):
    return t("part").select(F.col("p_partkey").alias("id"), F.array(F.concat(F.lit("part "), F.col("p_partkey").cast("string"))).alias("supporting_documents"))


@query("SELECT p_partkey AS id, p_brand AS start, coalesce((SELECT string_agg(entity, '|' ORDER BY entity) FROM mentions WHERE doc = 'part ' || p_partkey), '') AS entity, 'part ' || p_partkey AS document FROM part")
def samples_entity_docs(t):
    linked = t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("node"))
    got = index.samples_entity_docs(_support(t), linked, _mentioned(t))
    return got.select("id", *[F.array_join(F.element_at(F.col(m), k), "|").alias(n) for m, k, n in (("start_nodes", "entity", "start"), ("target_nodes", "entity", "entity"), ("target_nodes", "document", "document"))])


@query("SELECT p_partkey AS id, p_brand AS start, p_type AS entity FROM part")
def samples_answer(t):
    part = lambda c: t("part").select(F.col("p_partkey").alias("id"), F.col(c).alias("node"))
    got = index.samples_answer(_support(t), part("p_brand"), part("p_type").union(part("p_type")))
    return got.select("id", F.array_join(F.element_at("start_nodes", F.lit("entity")), "|").alias("start"), F.array_join(F.element_at("target_nodes", F.lit("entity")), "|").alias("entity"))


_LINKS = "(SELECT entity, count(DISTINCT doc) AS docs FROM mentions GROUP BY entity)"


@query(f", each AS (SELECT s.query, lower(s.node) AS node, avg(s.score / coalesce(docs, 1)) AS score FROM scores s LEFT JOIN {_LINKS} l ON l.entity = s.node JOIN supplier ON s_name = s.node AND s_acctbal > 0 GROUP BY ALL), best AS (SELECT query, node, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS k FROM each) WHERE k <= 5) SELECT query AS query_id, node, round(score, 6) AS score FROM best UNION ALL SELECT n_nationkey, 'part 1', 0.05::DOUBLE FROM nation")
def fact_start_nodes(t):
    chosen = t("scores").select(F.col("query").alias("query_id"), F.col("node").alias("fact_id"), "score")
    facts = t("supplier").select(F.col("s_name").alias("fact_id"), F.col("s_name").alias("source"), F.col("s_name").alias("target"))
    dense = chosen.select("query_id").distinct().select("query_id", F.lit("part 1").alias("id"), F.lit(1.0).alias("score"))
    edges = _mentioned(t).withColumn("source", F.lower("source"))
    nodes = t("supplier").where("s_acctbal > 0").select(F.lower("s_name").alias("name"))  # phrases of the others aren't in the graph
    return index.fact_start_nodes(chosen, facts, edges, nodes, dense).select("query_id", "node", F.round("score", 6).alias("score"))


@query("SELECT query AS id, string_agg(node, '|' ORDER BY node) AS start, (SELECT arg_max(node, (score, -1)) FROM scores t WHERE t.query = k.query) AS entity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM scores) k WHERE rank <= 5 GROUP BY query")
def samples_fact_link(t):
    from ..operators.graph import top

    own = t("scores").withColumnRenamed("query", "id")
    samples = own.select("id").distinct().withColumn("supporting_documents", F.array(F.lit("part 1")))
    answers = top(own, ["id"], [F.desc("score"), F.asc("node")], 1).select("id", "node", "rank")
    got = index.samples_fact_link(samples, own.where("id % 2 = 0"), own, answers)
    return got.select("id", F.array_join(F.element_at("start_nodes", F.lit("entity")), "|").alias("start"), F.array_join(F.element_at("target_nodes", F.lit("entity")), "|").alias("entity"))


@query("SELECT n_regionkey AS query_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY k, n_nationkey) - 1 AS INT) AS place, n_name AS fact FROM nation, (SELECT unnest([0, 1]) AS k)")
def match_filtered_facts(t):
    own = t("nation").select(F.col("n_regionkey").alias("query_id"), F.col("n_name").alias("fact"), F.col("n_nationkey").alias("place"))
    said = own.withColumn("fact", F.concat(F.col("fact"), F.lit("!")))
    again = said.withColumn("place", F.col("place") + 100)  # a fact told twice is matched twice
    return index.match_filtered_facts(said.union(again), own, 50)


# --- ranking --------------------------------------------------------------------------------------------------------

_MET = "JOIN mentions ON entity = node"
_TOPE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS k FROM scores) WHERE k <= {0})"


@query(f"SELECT query, doc, round(sum(score), 4) AS score FROM scores {_MET} GROUP BY ALL")
def rank_simple(t):
    return rank.rank_simple(t("scores"), t("mentions")).select("query", "doc", _r("score"))


@query(f"SELECT query, doc, round(sum(score / docs), 6) AS score FROM scores s {_MET} JOIN {_LINKS} l ON l.entity = node GROUP BY query, doc")
def rank_idf(t):
    return rank.rank_idf(t("scores"), t("mentions")).select("query", "doc", F.round("score", 6).alias("score"))


@query(f"SELECT query, doc, count(*)::DOUBLE AS score FROM {_TOPE.format(10)} {_MET} GROUP BY ALL")
def rank_topk(t):
    return rank.rank_topk(t("scores"), t("mentions"))


@query(f"SELECT query, doc, round(sum(1.0::DOUBLE / docs), 6) AS score FROM {_TOPE.format(20)} {_MET} JOIN {_LINKS} l ON l.entity = node GROUP BY query, doc")
def rank_idf_topk(t):
    return rank.rank_idf_topk(t("scores"), t("mentions")).select("query", "doc", F.round("score", 6).alias("score"))


@query(f"SELECT query, node, round(coalesce(1.0::DOUBLE / docs, 0), 6) AS weight FROM scores LEFT JOIN {_LINKS} l ON l.entity = node")
def start_weights(t):
    return rank.start_weights(t("scores"), t("mentions")).select("query", "node", F.round("weight", 6).alias("weight"))


@query(", lit AS (SELECT s_name AS name FROM supplier WHERE s_suppkey % 5 = 0) SELECT query, 'entity' AS type, node, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM scores WHERE node NOT IN (SELECT name FROM lit)) WHERE rank <= 4")
def topk_by_type_exclude(t):
    literals = t("supplier").where("s_suppkey % 5 = 0").select(F.col("s_name").alias("name"))
    return rank.topk_by_type(t("scores"), t("nodes"), 4, ("entity",), literals).select("query", "type", "node", _r("score"), "rank")


@query("SELECT query, node, score, round((score - lo) / (hi - lo), 4) AS norm_score, rank, CAST(s_nationkey AS STRING) AS content FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank, min(score) OVER (PARTITION BY query) AS lo, max(score) OVER (PARTITION BY query) AS hi FROM scores) JOIN supplier ON s_name = node WHERE rank <= 3")
def scored_documents(t):
    docs = t("supplier").select(F.col("s_name").alias("title"), F.col("s_nationkey").cast("string").alias("content"))
    return rank.scored_documents(t("scores"), docs, 3).select("query", "node", "score", _r("norm_score"), "rank", "content")


@query(f"SELECT query, node, k AS rank, s_nationkey AS attributes FROM {_TOPE.format(5)} JOIN supplier ON s_name = node WHERE s_suppkey % 2 = 0")
def attach_attributes(t):
    from ..operators.graph import top

    best = top(t("scores"), ["query"], [F.desc("score"), F.asc("node")], 9)
    nodes = t("supplier").where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("attributes"))
    return rank.attach_attributes(best, nodes).select("query", "node", "rank", "attributes")


@query("SELECT query, node, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM (SELECT query, node, greatest(score, 1 - score) AS score FROM scores)) WHERE rank <= 6")
def merge_retrievals(t):
    s = t("scores").withColumn("score", F.round("score", 6))
    return rank.merge_retrievals(s, s.withColumn("score", 1 - F.col("score")), 6).select("query", "node", _r("score"), "rank")


# --- graph analytics ------------------------------------------------------------------------------------------------

@query(", e AS (SELECT source, target FROM base), s AS (SELECT s_name AS node FROM supplier), h1 AS (SELECT target AS node, count(*) AS m FROM e JOIN s ON node = source GROUP BY target), h2 AS (SELECT target AS node, sum(m) AS m FROM e JOIN h1 ON node = source GROUP BY target), h3 AS (SELECT target AS node, sum(m) AS m FROM e JOIN h2 ON node = source GROUP BY target) SELECT node, round(sum(m), 4) AS mass FROM (SELECT node, 1.0::DOUBLE AS m FROM s UNION ALL SELECT node, m * 0.8::DOUBLE FROM h1 UNION ALL SELECT node, m * 0.64::DOUBLE FROM h2 UNION ALL SELECT node, m * 0.512::DOUBLE FROM h3) GROUP BY node")
def khop_reach(t):
    return analytics.khop_reach(t("kin_base"), t("supplier").select(F.col("s_name").alias("node"))).select("node", _r("mass"))


_STEINER = ", e AS (SELECT source AS a, target AS b FROM weighted UNION SELECT target, source FROM weighted), d AS (SELECT a, count(*)::DOUBLE AS d FROM e GROUP BY a), s AS (SELECT n_name AS c FROM nation WHERE n_nationkey IN (1, 2)), h0 AS (SELECT c, c AS n, 1.0::DOUBLE AS m FROM s), h1 AS (SELECT c, b AS n, sum(m / d) AS m FROM h0 JOIN e ON a = n JOIN d USING (a) GROUP BY c, b), h2 AS (SELECT c, b AS n, sum(m / d) AS m FROM h1 JOIN e ON a = n JOIN d USING (a) GROUP BY c, b), tot AS (SELECT c, n, sum(m) AS m FROM (SELECT * FROM h0 UNION ALL SELECT c, n, m * 0.7::DOUBLE FROM h1 UNION ALL SELECT c, n, m * (0.7::DOUBLE * 0.7::DOUBLE) FROM h2) GROUP BY c, n) SELECT a AS node, round(CASE WHEN a IN (SELECT c FROM s) THEN 0 ELSE exp(sum(ln(greatest(coalesce(m, 0), 1e-6))) / count(*)) / sqrt(greatest(any_value(d), 1)) END, 8) AS score FROM d CROSS JOIN s LEFT JOIN tot ON tot.c = s.c AND tot.n = d.a GROUP BY a"


@query(_STEINER)
def steiner_bridges(t):
    seeds = t("nation").where("n_nationkey IN (1, 2)").select(F.col("n_name").alias("node"))
    return analytics.steiner_bridges(t("weighted"), seeds).select("node", F.round("score", 8).alias("score"))


@query("SELECT 0 AS query, v AS node, round(sum(x), 4) AS first, count(*)::DOUBLE AS second FROM (SELECT v, (u % 10) * (r + 1)::DOUBLE AS x FROM encoded UNION ALL SELECT id, (id % 10)::DOUBLE FROM (SELECT u AS id FROM encoded UNION SELECT v FROM encoded)) GROUP BY v")
def propagate_messages(t):
    vec = F.array((F.col("id") % 10).cast("double"), F.lit(1.0))
    states = _typed(t).select(F.lit(0).alias("query"), F.col("id").alias("node"), vec.alias("vec"))
    rels = t("encoded").select("r").distinct().select("r", F.array((F.col("r") + 1).cast("double"), F.lit(1.0)).alias("vec"))
    got = analytics.propagate_messages(t("encoded"), states, rels, short_cut=False)
    return got.select("query", "node", F.round(F.get("vec", F.lit(0)), 4).alias("first"), F.get("vec", F.lit(1)).alias("second"))


def _paths(t):
    return analytics.topk_paths(t("kin_base"), t("supplier").select(F.col("s_name").alias("node")), t("region").select(F.col("r_name").alias("node")), weight=(F.col("row_no") % 10) / 10.0)


@query()
def topk_paths(t):
    return _paths(t).select("source", "target", F.col("path")[0]["t"].alias("via"), _r("avg_weight"))


@query()
def render_paths(t):
    return analytics.render_paths(_paths(t), t("nodes"))


@query(", hs AS (SELECT DISTINCT u AS n, r FROM encoded), ts AS (SELECT DISTINCT v AS n, r FROM encoded) SELECT DISTINCT a.r AS r1, b.r AS r2, 'hh' AS kind FROM hs a JOIN hs b USING (n) UNION ALL SELECT DISTINCT a.r, b.r, 'ht' FROM hs a JOIN ts b USING (n) UNION ALL SELECT DISTINCT a.r, b.r, 'th' FROM ts a JOIN hs b USING (n) UNION ALL SELECT DISTINCT a.r, b.r, 'tt' FROM ts a JOIN ts b USING (n)")
def relation_graph(t):
    return analytics.relation_graph(t("encoded"))


@query("SELECT u AS pattern_id, u, v, r FROM encoded WHERE r = 0 AND u % 3 = 0")
def match_edges(t):
    return analytics.match_edges(t("encoded"), t("encoded").where("r = 0 AND u % 3 = 0").select(F.col("u").alias("pattern_id"), "u", "r"))


@query("SELECT u, v, r FROM encoded WHERE NOT (r = 0 AND u % 3 = 0)")
def remove_easy_edges(t):
    return analytics.remove_easy_edges(t("encoded"), t("encoded").where("r = 0 AND u % 3 = 0"), 3)


_BATCH = "SELECT n_nationkey + 1000000 AS qid, n_nationkey + 1000000 AS u, n_regionkey + 3000000 AS v, 2 AS r FROM nation"


@query(f"SELECT qid, id AS node FROM ({_BATCH}), (SELECT u AS id FROM encoded UNION SELECT v FROM encoded) WHERE id <> v")
def strict_negatives(t):
    batch = t("encoded").where("r = 2").withColumn("qid", F.col("u"))
    return analytics.strict_negatives(t("encoded"), batch, _typed(t))


@query()
def negative_samples(t):
    batch = t("encoded").where("r = 2").withColumn("qid", F.col("u"))
    return analytics.negative_samples(t("encoded"), batch, _typed(t).select("id"), 16)


@query(", p AS (SELECT CAST(floor(v / 1000000) AS BIGINT) AS part, u, floor(u / 1000000) <> floor(v / 1000000) AS far FROM encoded) SELECT range AS part, 1000000::BIGINT AS local_n, (SELECT count(*) FROM p WHERE p.part = range) AS local_edges, (SELECT count(DISTINCT u) FROM p WHERE p.part = range AND far) AS boundary_sources FROM range(4)")
def partition_report(t):
    return analytics.partition_report(t("encoded"), 4_000_000, 4)


def _subgraph_sql(budget: float, steps: int) -> str:
    """Weights a step (z), each on the budget's plane if it lies beyond, and the fill as a recursion over the places."""
    z = "greatest(0.0, least(1.0, {0}))".format
    pull = z("p.z + 0.05 * (score - 0.3 * degree * p.z - 0.2 * (degree * p.z - coalesce(around, 0)))")
    back = z(f"z - (spent - {budget}) / square * cost")
    sums = "*, sum(z * cost) OVER (PARTITION BY query) AS spent, sum(cost * cost) OVER (PARTITION BY query) AS square"
    held = "SELECT query, node, score, cost, degree, CASE WHEN spent > {0} THEN {1} ELSE z END AS z FROM (SELECT {2} FROM ({3}))".format
    near = "SELECT e.query, e.a AS node, sum(z) AS around FROM ends e JOIN z{0} q ON q.query = e.query AND q.node = e.b GROUP BY e.query, e.a".format
    moved = f"SELECT p.query, p.node, score, cost, degree, {pull} AS z FROM z{{0}} p LEFT JOIN ({{1}}) n ON n.query = p.query AND n.node = p.node".format
    tables = ", ".join(f"z{k} AS MATERIALIZED ({held(budget, back, sums, moved(k - 1, near(k - 1)))})" for k in range(1, steps + 1))
    start = f"SELECT c.*, coalesce(degree, 0) AS degree, {z('score / greatest(1.0, max(score) OVER (PARTITION BY c.query))')} AS z FROM candidates c LEFT JOIN (SELECT query, a AS node, count(*) AS degree FROM ends GROUP BY query, a) d ON d.query = c.query AND d.node = c.node"
    return f"""WITH RECURSIVE candidates AS MATERIALIZED (SELECT n_nationkey AS query, s_name AS node, ((n_nationkey * 31 + s_suppkey * 17) % 1000)::DOUBLE / 1000 AS score, (10 + 5 * right(s_name, 1)::INT)::DOUBLE AS cost FROM nation, supplier),
hops AS (SELECT c_nationkey AS query, s_name AS a, lead(s_name) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
ends AS MATERIALIZED (SELECT query, a, b FROM hops WHERE a <> b UNION SELECT query, b, a FROM hops WHERE a <> b),
z0 AS MATERIALIZED ({held(budget, f"z * ({budget} / spent)", sums, start.replace("c.*", "c.query, c.node, score, cost"))}), {tables},
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query ORDER BY z DESC, score DESC, node) AS at FROM z{steps}),
fill AS (SELECT n_nationkey AS query, 0::BIGINT AS at, {budget}::DOUBLE AS room, false AS selected FROM nation
  UNION ALL SELECT p.query, p.at, CASE WHEN z > 1e-3 AND cost <= room THEN room - cost ELSE room END, z > 1e-3 AND cost <= room FROM fill f JOIN placed p ON p.query = f.query AND p.at = f.at + 1)
SELECT p.query, node, round(z, 4) AS z, selected FROM placed p JOIN fill f ON p.query = f.query AND p.at = f.at"""


@query(_subgraph_sql(100.0, 80))
def select_subgraph(t):
    """Candidates are linked for a nation where its customers' orders name them one after the other."""
    own = t("scores").withColumn("cost", F.lit(10.0) + 5 * F.right("node", F.lit(1)).cast("int"))
    sold = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    following = F.lead("s_name").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    links = sold.select(F.col("c_nationkey").alias("query"), F.col("s_name").alias("source"), following.alias("target")).where("source <> target")
    return analytics.select_subgraph(own, links, 100.0).select("query", "node", _r("z"), "selected")


# --- metrics --------------------------------------------------------------------------------------------------------

_PAIRS = f"SELECT id, {_ANSWER.format('response')} AS a, {_ANSWER.format('gold')} AS b, {_ANSWER.format('alias')} AS c FROM answers"


def _f1_sql(a: str, b: str) -> str:
    toks = lambda x: f"list_filter(string_split({x}, ' '), lambda t: t <> '')"
    same = f"coalesce(list_sum(list_transform(list_distinct({toks(a)}), lambda t: least(len(list_filter({toks(a)}, lambda x: x = t)), len(list_filter({toks(b)}, lambda x: x = t))))), 0)"
    return f"{{'s': {same}::DOUBLE, 'a': len({toks(a)})::DOUBLE, 'b': len({toks(b)})::DOUBLE}}"


_M = "CASE WHEN m.s = 0 THEN 0 ELSE 2 * m.s / (m.a + m.b) END AS f1, CASE WHEN m.s = 0 THEN 0 ELSE m.s / m.a END AS p, CASE WHEN m.s = 0 THEN 0 ELSE m.s / m.b END AS r"


@query(f"SELECT id, CAST(a = b AS INT) AS em, round(f1, 4) AS f1, round(p, 4) AS p, round(r, 4) AS r FROM (SELECT *, {_M} FROM (SELECT *, {_f1_sql('a', 'b')} AS m FROM ({_PAIRS})))")
def exact_match_token_f1(t):
    got = t("answers").select("id", metrics.exact_match("response", "gold").alias("em"), metrics.token_f1("response", "gold").alias("m"))
    return got.select("id", "em", *[F.round(f"m.{c}", 4).alias(c) for c in ("f1", "p", "r")])


@query(f"SELECT id, round(f1, 4) AS f1 FROM (SELECT *, {_M} FROM (SELECT *, {_f1_sql('a', 'c')} AS m FROM ({_PAIRS})))")
def token_f1_lenient(t):
    return t("answers").select("id", F.round(metrics.token_f1_lenient("response", "alias")["f1"], 4).alias("f1"))


def _rounded(df):
    return df.select(*[_r(c) if k == "double" else F.col(c) for c, k in df.dtypes])


_EVAL = "round(avg(em), 4) AS em, round(avg(f1), 4) AS f1, round(avg(p), 4) AS precision, round(avg(r), 4) AS recall"


@query(f"SELECT {_EVAL} FROM (SELECT CAST(a = b AS INT) AS em, {_M} FROM (SELECT *, {_f1_sql('a', 'b')} AS m FROM ({_PAIRS})))")
def eval_single(t):
    return _rounded(metrics.eval_single(t("answers").select(F.col("response").alias("pred"), "gold")))


_BOTH = f"(SELECT id, pos, CAST(a = g AS INT) AS em, {_M} FROM (SELECT *, {_f1_sql('a', 'g')} AS m FROM (SELECT id, a, b AS g, 0 AS pos FROM ({_PAIRS}) UNION ALL SELECT id, a, c, 1 FROM ({_PAIRS}))))"


def _aliased(t):
    return t("answers").select("id", F.col("response").alias("pred"), "gold", F.array("alias").alias("aliases"))


@query(f"SELECT {_EVAL} FROM (SELECT id, max(em) AS em, max(f1) AS f1, max(p) AS p, max(r) AS r FROM {_BOTH} GROUP BY id)")
def eval_max_each(t):
    return _rounded(metrics.eval_max_each(_aliased(t)))


@query(f"SELECT {_EVAL} FROM (SELECT id, max(em) AS em, max(f1) AS f1, arg_max(p, (f1, -pos)) AS p, arg_max(r, (f1, -pos)) AS r FROM {_BOTH} GROUP BY id)")
def eval_best_f1(t):
    return _rounded(metrics.eval_best_f1(_aliased(t)))


_RANKED = "(SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM scores)"


@query("SELECT " + ", ".join(f'round(avg(k{k}), 4) AS "recall@{k}"' for k in (1, 2, 5, 10)) + " FROM (SELECT query, " + ", ".join(f"avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END) AS k{k}" for k in (1, 2, 5, 10)) + f" FROM targets JOIN {_RANKED} USING (query, node) GROUP BY query)")
def retrieval_recall(t):
    said = t("scores").select(F.col("query").alias("id"), F.col("node").alias("name"), "score", F.col("node").alias("place"))
    return _rounded(metrics.retrieval_recall(said, t("targets").select(F.col("query").alias("id"), F.col("node").alias("name"))))


@query("SELECT round(avg(mrr), 4) AS mrr, " + ", ".join(f'round(avg(h{k}), 4) AS "hits@{k}", round(avg(r{k}), 4) AS "recall@{k}"' for k in (1, 5, 10)) + " FROM (SELECT query, avg(1.0::DOUBLE / f) AS mrr, " + ", ".join(f"avg((f <= {k})::INT) AS h{k}, avg((rank <= {k})::INT) AS r{k}" for k in (1, 5, 10)) + f" FROM (SELECT *, rank - row_number() OVER (PARTITION BY query ORDER BY rank) + 1 AS f FROM targets JOIN {_RANKED} USING (query, node)) GROUP BY query)")
def ranking_metrics(t):
    return _rounded(metrics.ranking_metrics(t("scores"), t("targets")))


@query("SELECT round(avg(abs(coalesce(said, 0) - n) / n), 4) AS mape FROM (SELECT query, count(*) AS n FROM targets GROUP BY query) LEFT JOIN (SELECT query, sum(CASE WHEN p > 0.5 THEN p ELSE 0 END) AS said FROM (SELECT query, 1 / (1 + exp(-(score - 0.8))) AS p FROM scores) GROUP BY query) USING (query)")
def cardinality_error(t):
    return _rounded(metrics.cardinality_error(t("scores").withColumn("score", F.col("score") - 0.8), t("targets")))


def _lp(t):
    own = t("scores").select(F.col("query").alias("qid"), F.when(F.col("query") % 2 == 0, "tail").otherwise("head").alias("side"), "node", "score")
    true = t("targets").select(F.col("query").alias("qid"), F.when(F.col("query") % 2 == 0, "tail").otherwise("head").alias("side"), "node")
    first = true.groupBy("qid", "side").agg(F.min("node").alias("node"))
    return metrics.link_prediction_ranks(own, first, true)


_LP = ", tr AS (SELECT query, min(node) AS node FROM targets GROUP BY query), lp AS (SELECT query AS qid, CASE WHEN query % 2 = 0 THEN 'tail' ELSE 'head' END AS side, 1 + count(*) FILTER (s.score >= t.score) AS rank, count(*) AS num_negative FROM (SELECT query, score FROM tr JOIN scores USING (query, node)) t JOIN (SELECT * FROM scores ANTI JOIN targets USING (query, node)) s USING (query) GROUP BY query)"


@query(_LP + " SELECT * FROM lp")
def link_prediction_ranks(t):
    return _lp(t)


@query(_LP + ", prt AS (SELECT *, 'both' AS part FROM lp UNION ALL SELECT *, 'tail' FROM lp WHERE side = 'tail') SELECT part AS side, round(avg(rank), 4) AS mr, round(avg(1.0::DOUBLE / rank), 4) AS mrr, round(avg((rank <= 1)::INT), 4) AS \"hits@1\", round(avg((rank <= 3)::INT), 4) AS \"hits@3\", round(avg((rank <= 10)::INT), 4) AS \"hits@10\", round(avg((SELECT sum(factorial(50) / (factorial(i) * factorial(50 - i)) * pow((rank - 1)::DOUBLE / num_negative, i) * pow(1 - (rank - 1)::DOUBLE / num_negative, 49 - i)) FROM range(10) q(i))), 4) AS \"hits@10_50\" FROM prt GROUP BY part".replace("factorial(50) / (factorial(i) * factorial(50 - i))", "CASE i " + " ".join(f"WHEN {i} THEN {__import__('math').comb(49, i)}::DOUBLE" for i in range(10)) + " END"))
def link_prediction_metrics(t):
    return _rounded(metrics.link_prediction_metrics(_lp(t)))


@query("SELECT part, round(avg(value), 4) AS value FROM (SELECT event_type, avg(value) AS value FROM events GROUP BY event_type), LATERAL (SELECT unnest(['all', CASE WHEN contains(event_type, 'n') THEN 'negation' ELSE 'epfo' END]) AS part) GROUP BY part")
def metrics_by_query_type(t):
    return _rounded(metrics.metrics_by_query_type(t("events").select(F.col("event_type").alias("type"), "value")))


@query(f"SELECT a.query, round(avg((a.rank > b.rank)::INT), 4) AS auc FROM (SELECT *, right(node, 1)::INT % 3 = 0 AS hard FROM {_RANKED}) a JOIN (SELECT *, right(node, 1)::INT % 3 = 0 AS hard FROM {_RANKED}) b ON a.query = b.query AND a.hard AND NOT b.hard GROUP BY a.query")
def rank_auc(t):

    ranked = t("scores").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node")))
    return _rounded(metrics.rank_auc(ranked.select("query", "rank", (F.substring("node", -1, 1).cast("int") % 3 == 0).alias("is_hard"))))


@query("SELECT c_mktsegment, round(corr(rx, ry), 4) AS rho FROM (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2 AS rx, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2 AS ry FROM customer) GROUP BY ALL")
def spearman(t):
    return _rounded(metrics.spearman(t("customer"), "c_nationkey", "c_acctbal", "c_mktsegment"))


_AVG = "SELECT CAST(user_id % 5 AS STRING) AS dataset, avg(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1"


@query(f"SELECT dataset, round(value, 4) AS value FROM ({_AVG}) UNION ALL SELECT 'average', round(avg(value), 4) FROM ({_AVG})")
def average_over_datasets(t):
    return _rounded(metrics.average_over_datasets(t("events").select((F.col("user_id") % 5).cast("string").alias("dataset"), F.col("event_type").alias("metric"), "value"), "click"))


# --- models ---------------------------------------------------------------------------------------------------------

@query()
def extract_documents(t):
    docs = t("documents").select(F.col("source").alias("title"), F.col("text").alias("passage"))
    return models.extract_documents(docs, models.toy_extractor).select("title", F.size("extracted_triples").alias("n"))


@query()
def extract_question_entities(t):
    asked = t("conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"))
    return models.extract_question_entities(asked, lambda s: models.toy_extractor(s).map(lambda x: x[0])).select("id", F.size("entities").alias("n"))


@query("SELECT doc_id, i, (length(lower(text)) - length(replace(lower(text), chr(97 + i::INT), '')))::DOUBLE AS n FROM (SELECT doc_id, text, unnest(range(26)) AS i FROM documents)")
def embed_texts(t):
    own = models.embed_texts(t("documents"), models.toy_embedder).select("doc_id", F.posexplode("vec").alias("i", "n"))
    return own.select("doc_id", F.col("i").cast("long").alias("i"), "n")


@query("SELECT item_id AS query, 'Answer: \"' || text || '\"' AS response FROM benchmark")
def generate_answers(t):
    return models.generate_answers(t("benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("context")), lambda s: s.map(lambda c: f'Answer: "{c}"'))


# --- increments -----------------------------------------------------------------------------------------------------

@query("SELECT source, relation, target, count(*) AS n FROM told GROUP BY ALL")
def increment_edges(t):
    """The edges as a stream of several files, merged batch by batch."""
    told = t("told").select("source", "relation", "target")
    spark, folder = told.sparkSession, shared_folder(told.sparkSession, "increment")
    told.repartition(4).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(told.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    increment.increment_edges(stream, f"{folder}/store", f"{folder}/progress").awaitTermination()
    return increment.read_store(spark, f"{folder}/store")


def _seen(t):
    return t("named").select(F.col("c_name").alias("name"), "abn", F.lit("2024-01-01").alias("seen"), F.concat(F.lit("doc "), F.col("c_custkey").cast("string")).alias("doc"))


@query("SELECT 'abn:' || abn AS canonical_id, string_agg(c_name, '|' ORDER BY c_name) AS aliases, min(c_name) AS canonical_name, count(*) AS docs FROM named GROUP BY abn")
def entity_store(t):
    half = _seen(t).where("substring(name, -1, 1) < '5'")
    rest = _seen(t).where("substring(name, -1, 1) >= '5'")
    got = increment.entity_store(rest, increment.entity_store(half))
    return got.select("canonical_id", F.array_join("aliases", "|").alias("aliases"), "canonical_name", F.size("source_docs").cast("long").alias("docs"))


@query("SELECT c_name AS mention, 'abn:' || n.abn AS canonical_id, NOT n.abn IN (SELECT abn FROM named WHERE c_custkey % 2 = 0) AS is_new FROM named n")
def resolve_increment(t):
    store = increment.entity_store(t("named").where("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), "abn", F.lit("x").alias("seen"), F.lit("d").alias("doc")))
    return increment.resolve_increment(t("named").select(F.col("c_name").alias("mention"), "abn"), store)


@query()
def corroboration(t):
    edges = t("documents").select(F.lit("a").alias("source"), F.lit("r").alias("relation"), F.col("source").alias("target"), F.col("doc_id").alias("doc"))
    return increment.corroboration(edges, t("documents").select(F.col("doc_id").alias("doc"), "text"))


@query(f"SELECT item_id, contains({NORM.format('text')}, {NORM.format('split_part(text, chr(32), 2)')}) AND contains({NORM.format('text')}, {NORM.format('text || chr(120)')}) AS bad, contains({NORM.format('text')}, {NORM.format('split_part(text, chr(32), 2)')}) AS good FROM benchmark")
def quote_anchor(t):
    second = F.split_part("text", F.lit(" "), F.lit(2))
    return t("benchmark").select("item_id", increment.quote_anchor(second, F.concat("text", F.lit("x")), "text").alias("bad"), increment.quote_anchor(second, second, "text").alias("good"))


@query("SELECT c_name AS source, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'released' ELSE 'unverified' END AS status FROM customer")
def release_rule(t):
    own = t("customer").select(F.col("c_name").alias("source"), F.lit("in").alias("relation"), F.col("c_mktsegment").alias("target"), F.concat_ws(" is in ", "c_name", "c_mktsegment").alias("span"), "c_custkey")
    known = t("customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("name"))
    told = own.select("source", "relation", "target", (F.col("c_custkey") % 3 + 1).alias("sources")).withColumn("sources", F.when(F.col("sources") > 1, 2).otherwise(1))
    return increment.release_rule(own.drop("c_custkey"), known, told).select("source", "status")


@query("SELECT source, relation, target, string_agg(DISTINCT CAST(source_id AS STRING), '|' ORDER BY CAST(source_id AS STRING)) AS sources FROM told WHERE source_id <> 3 GROUP BY ALL")
def retract_source(t):
    edges = t("told").groupBy("source", "relation", "target").agg(F.collect_set("source_id").alias("sources"))
    gone = t("told").where("source_id = 3").select("source_id").distinct()
    return increment.retract_source(edges, gone).select("source", "relation", "target", F.array_join("sources", "|").alias("sources"))


@query(f"SELECT count(*) AS identifiers, count(*) FILTER (n > 1) AS duplicated, round(count(*) FILTER (n > 1)::DOUBLE / count(*), 4) AS rate FROM (SELECT abn, count(DISTINCT source) AS n FROM (SELECT {_ABN.format('target')} AS abn, source FROM edges WHERE lower(trim(relation)) IN ('has abn', 'abn')) WHERE abn IS NOT NULL GROUP BY abn)")
def duplicate_identifier_rate(t):
    return _rounded(increment.duplicate_identifier_rate(t("edges")))


@query(", w AS (SELECT min(ts) AS a FROM events) SELECT source, relation, target, count(*) AS n FROM told, w WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL")
def edges_in_window(t):
    return increment.edges_in_window(t("told"), "2024-01-05", "2024-01-20").groupBy("source", "relation", "target").agg(F.count("*").alias("n"))


@query("""
, early AS (SELECT max(ts) - INTERVAL 10 DAY AS mark FROM told WHERE source_id < 5),
dealt AS (SELECT date_trunc('day', ts) AS day, relation, source_id >= 5 AND date_trunc('day', ts) + INTERVAL 1 DAY <= mark AS late FROM told, early)
SELECT strftime(day, '%Y-%m-%d') AS day, relation, count(*) AS n FROM dealt WHERE NOT late GROUP BY ALL
UNION ALL SELECT 'late', NULL, count(*) FILTER (late) FROM dealt""")
def edges_in_window_stream(t):
    """Files out of order: the edges of two sources come after the others', and the older of them too late."""
    utc = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp").alias("ts")
    told = t("told").select("source", "relation", "target", utc, "source_id")
    spark, folder = told.sparkSession, shared_folder(told.sparkSession, "windows")
    kind, last = told, told.agg(F.expr("max(ts) + INTERVAL 1000 DAY").alias("ts"))
    end = last.select(F.lit("end").alias("source"), F.lit("end").alias("relation"), F.lit("end").alias("target"), "ts", F.lit(0).cast("long").alias("source_id"))
    for files in (kind.where("source_id < 5"), kind.where("source_id >= 5"), end):
        files.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(kind.schema).parquet(f"{folder}/in")
        increment.stream_windows(stream, f"{folder}/out", f"{folder}/progress", "1 day", "10 days").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    day = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("start").cast("timestamp_ntz")), "yyyy-MM-dd")
    days = out.groupBy(day.alias("day"), "relation").agg(F.sum("n").alias("n"))  # the end itself is never final
    late = out.agg(F.sum("n").alias("kept")).crossJoin(told.agg(F.count("*").alias("all")))  # a row each
    return days.unionByName(late.select(F.lit("late").alias("day"), F.lit(None).cast("string").alias("relation"), (F.col("all") - F.col("kept")).alias("n")))


def _pruned_counts(t) -> DataFrame:
    """Tables that are read several times are cut first: the edges, the map and the canonical edges."""
    edges = t("kin_edges").cut()
    kept = resolve.canonicalise_graph(_graph(t, edges), cut(resolve.canonical_map(edges))).edges.cut()
    return resolve.relation_counts(resolve.prune_equivalent(kept, resolve.literal_nodes(kept)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture edges → canonical names → pruned synonyms → edges per relation."""
    return _pruned_counts(lambda name: fixtures.table(spark, sf_dir, name))


query(f", {_MAP}, {_MOVED}, lit AS ({_LITERALS.replace('FROM edges', 'FROM kept')}), pruned AS (SELECT relation FROM kept WHERE relation <> 'equivalent' UNION ALL SELECT relation FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shard_no, row_no, target) AS k FROM kept WHERE relation = 'equivalent' AND source NOT IN (SELECT name FROM lit) AND target NOT IN (SELECT name FROM lit)) WHERE k <= 10) SELECT relation, count(*) AS n FROM pruned GROUP BY relation ORDER BY n DESC, relation LIMIT 25", name="canonical_pruned_counts")(_pruned_counts)


# --- sources and sinks: tables written into a folder of the checkpoint directory and read back -------------------------

def _written(df: DataFrame, label: str, write) -> tuple[SparkSession, str]:
    path = f"{shared_folder(df.sparkSession, label)}/{label}"
    write(df, path)
    return df.sparkSession, path


def _json_files(df: DataFrame, by, value) -> DataFrame:
    """One line of text a group, each a JSON document."""
    return df.groupBy(by.alias("part")).agg(F.to_json(value).alias("value")).select("value")


@query("SELECT 'node' AS kind, name, 'type' AS key, type AS value FROM nodes UNION ALL SELECT DISTINCT 'relation', relation, NULL, NULL FROM edges UNION ALL SELECT 'edge', source || '|' || relation || '|' || target, NULL, NULL FROM edges")
def read_write_graph(t):
    nodes = t("nodes").select("name", "type", F.create_map(F.lit("type"), "type").alias("attributes"))
    relations = count_by(t("kin_edges"), "relation").select(F.col("relation").alias("name"))
    spark, path = _written(nodes, "graph", lambda df, p: io.write_graph(Graph(df, relations, t("kin_edges").every()), p))
    g, none = io.read_graph(spark, path), F.lit(None).cast("string")
    own = g.nodes.select(F.lit("node").alias("kind"), "name", F.map_keys("attributes")[0].alias("key"), F.element_at("attributes", "type").alias("value"))
    return own.union(g.relations.select(F.lit("relation"), "name", none, none)).union(g.edges.select(F.lit("edge"), F.concat_ws("|", "source", "relation", "target"), none, none))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN NULL END AS name, CASE WHEN c_custkey % 3 < 2 THEN 1 ELSE 0 END AS n FROM customer")
def parse_attributes(t):
    said = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("{'name': '"), "c_name", F.lit("'}"))).when(F.col("c_custkey") % 3 == 1, F.lit("{'name': None}")).otherwise("")
    got = t("customer").select("c_custkey", io.parse_attributes(said).alias("a"))
    return got.select("c_custkey", F.element_at("a", "name").alias("name"), F.size("a").alias("n"))


@query("SELECT title, content FROM docs")
def read_documents(t):
    pairs = F.map_from_entries(F.collect_list(F.struct("title", "content")))
    listed = F.collect_list(F.struct("title", F.col("content").alias("text")))
    own, part = t("docs"), F.floor(F.col("idx") / 500)
    spark, a = _written(own.where("shard = 0"), "documents", lambda df, p: _json_files(df, part, pairs).write.option("maxRecordsPerFile", 1).text(p))
    _, b = _written(own.where("shard <> 0"), "listed", lambda df, p: _json_files(df, part, listed).write.option("maxRecordsPerFile", 1).text(p))
    return io.read_documents(spark, [a, b]).select("title", "content")


@query("SELECT IDX, Type, PeriodStart, PeriodEnd, HeadquarteredCountries, AnnualRevenue, IndustrySectors, IncludedEntities, Link, ReportingEntities, ABN FROM register")
def read_register(t):
    own = t("register").drop("row_no")
    spark, path = _written(own, "register", lambda df, p: df.write.options(header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(p))
    return io.read_register(spark, path)


@query("SELECT 'order ' || o_orderkey AS title, c_name || '|' || CASE WHEN two THEN r ELSE '' END AS said FROM dirty")
def read_write_openie(t):
    """A log of two lines a passage, of which the last stays."""
    own = _openie(t).withColumn("passage", F.col("title"))
    first = own.withColumn("extracted_entities", F.array(F.lit("old")))
    spark, path = _written(first.coalesce(1), "openie", lambda df, p: (io.write_openie(df, p), io.write_openie(own.coalesce(1), f"{p}/z")))
    got = io.read_openie(spark, [path, f"{path}/z"])
    short = F.get("extracted_triples", F.lit(0))
    return got.select("title", F.concat(F.get("extracted_entities", F.lit(0)), F.lit("|"), F.when(F.size(short) == 2, short[1]).otherwise("")).alias("said"))


@query("SELECT 'c ' || o_orderkey AS title, c_name AS source, CASE WHEN blank THEN ' ! ' ELSE r END AS relation, t AS target, 'u' || o_orderkey AS url FROM dirty WHERE NOT two AND NOT four")
def read_crawled_tuples(t):
    own = _openie(t).select(F.regexp_replace("title", "^order", "c").alias("company"), F.array(F.regexp_replace("title", "^order ", "u")).alias("sources"), F.col("extracted_triples").alias("triples"))
    files = lambda df, p: _json_files(df, F.pmod(F.xxhash64("company"), F.lit(16)), F.collect_list(F.struct("company", "sources", "triples"))).write.option("maxRecordsPerFile", 1).text(p)
    spark, path = _written(own, "crawled", files)
    return io.read_crawled_tuples(spark, path).select("title", "source", "relation", "target", F.get("sources", F.lit(0)).alias("url"))


@query("SELECT shard, title, content, idx FROM docs")
def write_shards(t):
    spark, path = _written(t("docs"), "shards", io.write_shards)
    return spark.read.schema("title string, content string, idx long, shard int").json(path).select("shard", "title", "content", "idx")


@query("SELECT CAST(id AS STRING) AS id, gold AS question, response AS answer, alias FROM answers")
def read_qa(t):
    own = t("answers").select(F.col("id").cast("string").alias("id"), F.col("gold").alias("question"), F.col("response").alias("answer"), F.array("alias").alias("answer_aliases"))
    files = lambda df, p: _json_files(df, F.pmod(F.xxhash64("id"), F.lit(8)), F.collect_list(F.struct(*own.columns))).write.option("maxRecordsPerFile", 1).text(p)
    spark, path = _written(own, "qa", files)
    return io.read_qa(spark, path).select("id", "question", "answer", F.get("answer_aliases", F.lit(0)).alias("alias"))


@query("SELECT query, node, score FROM scores")
def write_predictions(t):
    spark, path = _written(t("scores"), "predictions", io.write_predictions)
    return spark.read.json(path).select(F.col("query").cast("int").alias("query"), "node", "score")


@query("SELECT 'task ' || query % 3 AS task_type, count(*) AS n, round(sum(score), 4) AS score FROM scores GROUP BY 1")
def split_by_task(t):
    own = t("scores").withColumn("task_type", F.concat(F.lit("task "), (F.col("query") % 3).cast("string")))
    spark, path = _written(own, "tasks", rank.split_by_task)
    return spark.read.json(path).groupBy("task_type").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))
