"""Facts of the graph against the register, gates and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import abn_spaced, entity_names, is_company_name, is_valid_abn, norm_abn, normalise_text, strip, title_idx
from .graph import cut
from .kin import KinEdges
from .needles import contained, containing


def register_facts(docs: DataFrame, register: DataFrame) -> DataFrame:
    """(shard, idx, kind, needles): what each document should hold, in any of the forms; docs: (shard, title)."""
    own = docs.select("shard", title_idx("title").alias("IDX")).join(register, "IDX")
    field = lambda c: F.coalesce(F.col(c), F.lit("")) if c in register.columns else F.lit("")
    parts = lambda c: F.filter(F.transform(F.split(field(c), ","), lambda p: F.trim(p)), lambda p: p != "")
    fact = lambda kind, needles: F.struct(F.lit(kind).alias("kind"), needles.alias("needles"))
    abns = F.regexp_extract_all(F.replace(field("ABN"), F.lit(" "), F.lit("")), F.lit(r"(\d{11})"), F.lit(1))
    period = normalise_text(F.concat_ws(" to ", field("PeriodStart"), field("PeriodEnd")))
    facts = F.concat(
        F.transform(entity_names("ReportingEntities"), lambda n: fact("entity", F.array(normalise_text(n)))),
        F.transform(abns, lambda a: fact("abn", F.array(a, abn_spaced(a)))),
        F.array(
            F.when(field("AnnualRevenue") != "", fact("revenue", F.array(normalise_text(field("AnnualRevenue"))))),
            F.when((field("PeriodStart") != "") & (field("PeriodEnd") != ""), fact("period", F.array(period))),
            F.when(field("HeadquarteredCountries") != "", fact("hq", F.transform(parts("HeadquarteredCountries"), normalise_text))),
            F.when(F.size(parts("IndustrySectors")) > 0, fact("sector", F.array(normalise_text(F.get(parts("IndustrySectors"), F.lit(0)))))),
        ),
    )
    return own.select("shard", F.col("IDX").alias("idx"), F.explode(facts).alias("f")).where("f is not null").select("shard", "idx", "f.*")


def _told(edges: DataFrame) -> DataFrame:
    """(scope, text) of edges that are listed."""
    return edges.select(F.col("shard_no" if "shard_no" in edges.columns else "shard").alias("scope"), normalise_text(F.concat_ws(" ", "source", "relation", "target")).alias("text"))


def _found(needles: DataFrame, texts: DataFrame, edges: DataFrame | KinEdges) -> DataFrame:
    """(scope, needle) of those that texts or edge texts of their scope contain.

    What lies in a pair of a kin lies in its head with the relation or in the relation with its tail, unless the relation stands
    within the needle between other words: only for such needles are the pairs written out."""
    if not isinstance(edges, KinEdges):
        return contained(needles, texts.union(_told(edges)))
    said = lambda side, *words: side.select(F.col("shard_no").alias("scope"), normalise_text(F.concat_ws(" ", *words)).alias("text"))
    halves = said(edges.shards_of_heads(), "name", F.lit(edges.relation)).union(said(edges.shards_of_tails(), F.lit(edges.relation), "name"))
    out = contained(needles, texts.union(_told(edges.listed)).union(halves))
    across = needles.where(F.col("needle").contains(F.concat(F.lit(" "), normalise_text(F.lit(edges.relation)), F.lit(" "))))
    return out.union(contained(across, _told(edges.pairs()))) if across.head(1) else out


def _looked_for(facts: DataFrame, nodes: DataFrame, edges: DataFrame | KinEdges) -> DataFrame:
    """(shard, idx, kind, needles, hit): each distinct fact, and whether some needle of it occurs in a node or edge text of its shard."""
    texts = nodes.select(F.col("shard").alias("scope"), normalise_text("name").alias("text"))
    spread = facts.select("shard", "idx", "kind", "needles", F.explode("needles").alias("needle"))
    needles = cut(spread.select(F.col("shard").alias("scope"), "needle").distinct())
    hits = _found(needles, texts, edges).distinct().select(F.col("scope").alias("shard"), "needle", F.lit(True).alias("hit"))
    return spread.join(hits, ["shard", "needle"], "left").groupBy("shard", "idx", "kind", "needles").agg(F.max(F.coalesce("hit", F.lit(False))).alias("hit"))


def verify_facts(facts: DataFrame, nodes: DataFrame, edges: DataFrame | KinEdges) -> DataFrame:
    """(kind, found, expected, recall): facts of which some needle occurs in a node or edge text of the shard.

    edges: (shard, source, relation, target), or in kins, with shard_no for the shard."""
    out = _looked_for(facts, nodes, edges).groupBy("kind").agg(F.sum(F.col("hit").cast("long")).alias("found"), F.count("*").alias("expected"))
    return out.withColumn("recall", F.col("found") / F.col("expected"))


def missing_facts(facts: DataFrame, nodes: DataFrame, edges: DataFrame | KinEdges) -> DataFrame:
    """(shard, idx, kind, needles): the facts that ``verify_facts`` doesn't find."""
    return _looked_for(facts, nodes, edges).where("NOT hit").drop("hit")


def unregistered_docs(docs: DataFrame, register: DataFrame) -> DataFrame:
    return docs.withColumn("IDX", title_idx("title")).join(register.select("IDX"), "IDX", "left_anti").select(*docs.columns)


def suspect_entities(nodes: DataFrame, register: DataFrame) -> DataFrame:
    """(name): company-like nodes that neither contain a register name, or a row's included entities, nor are contained in one."""
    listed = register.select(F.explode(entity_names("ReportingEntities")).alias("n"))
    if "IncludedEntities" in register.columns:
        listed = listed.union(register.select("IncludedEntities"))
    names = listed.select(F.lit(0).alias("scope"), "n").select("scope", normalise_text("n").alias("text")).where("text <> ''").distinct()
    own = nodes.where((F.col("type") != "document") & is_company_name("name")).select("name", F.lit(0).alias("scope"), normalise_text("name").alias("needle"))
    within = contained(own, names).select("needle")
    around = containing(own.select("scope", F.col("needle").alias("text")), names.select("scope", F.col("text").alias("needle"))).select("text")
    return own.join(within.union(around).distinct(), "needle", "left_anti").select("name")


def fact_gate(triples: DataFrame, expected: DataFrame, known_entities: DataFrame | None = None, known_abns: DataFrame | None = None, min_recall_threshold: float = 0.5, abn_rels=("has abn", "abn")) -> DataFrame:
    """One row a doc_id: recall and precision of business numbers, invalid and ungrounded values, reward, violations.

    triples: (doc_id, s, r, t); expected: (doc_id, abn); known_*: (name), (abn), not empty. A number is invalid by its form or
    checksum alone; precision counts the valid ones, or the known ones where these are given, among all tried. Ungrounded
    entities are told but don't decide. Arrays are sorted; numbers are rounded to four places."""
    is_abn = F.lower(strip("r")).isin(*abn_rels)
    rows = triples.select("doc_id", "s", "t", is_abn.alias("is_abn"), F.when(is_abn, norm_abn("t")).alias("abn"), F.coalesce(is_abn & is_valid_abn("t"), F.lit(False)).alias("valid"))
    rows = cut(rows)  # read three times
    numbers = rows.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("valid"), F.col("abn")))).alias("emitted"), F.array_sort(F.collect_list(F.when(F.col("is_abn") & ~F.col("valid"), F.col("t")))).alias("invalid_abns"))
    wanted = expected.groupBy("doc_id").agg(F.array_sort(F.collect_set(norm_abn("abn"))).alias("expected"))
    out = numbers.join(wanted, "doc_id", "full")
    grounded = F.size("emitted")
    if known_abns is not None:
        known = known_abns.select(norm_abn("abn").alias("abn")).where("abn is not null").distinct()
        held = rows.where("valid").select("doc_id", "abn").distinct().join(known, "abn", "left_semi").groupBy("doc_id").agg(F.count("*").alias("grounded"))
        out, grounded = out.join(held, "doc_id", "left"), F.coalesce("grounded", F.lit(0))
    if known_entities is not None:
        names = rows.select("doc_id", normalise_text("s").alias("n")).union(rows.where(~F.col("is_abn")).select("doc_id", normalise_text("t"))).where("n <> ''").distinct()
        odd = names.join(known_entities.select(normalise_text("name").alias("n")).distinct(), "n", "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_set("n")).alias("hallucinated_entities"))
        out = out.join(odd, "doc_id", "left")
    else:
        out = out.withColumn("hallucinated_entities", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<string>")
    out = out.select(*[c for c in out.columns if c == "grounded"], "doc_id", *[F.coalesce(c, empty).alias(c) for c in ("emitted", "expected", "invalid_abns", "hallucinated_entities")])
    hits, invalid = F.size(F.array_intersect("emitted", "expected")), F.size("invalid_abns")
    tried = F.size("emitted") + invalid
    recall = F.when(F.size("expected") > 0, hits / F.size("expected")).otherwise((F.size("emitted") > 0).cast("double"))
    precision = F.when(tried > 0, grounded / tried).otherwise((F.size("expected") == 0).cast("double"))
    out = out.withColumn("abn_recall", recall).withColumn("abn_precision", precision)
    reward = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * F.col("abn_recall") + 0.4 * F.col("abn_precision") - 0.5 * invalid))
    verified = (invalid == 0) & (F.col("abn_recall") >= min_recall_threshold) & (F.col("abn_precision") >= 0.5)
    n_odd = F.size("hallucinated_entities")
    said = F.concat(F.transform("invalid_abns", lambda a: F.concat(F.lit("invalid business number: "), a)), F.array_compact(F.array(F.when(n_odd > 0, F.concat(n_odd.cast("string"), F.lit(" ungrounded entities"))))))
    to4 = lambda c, name: F.round(c, 4).alias(name)
    return out.select("doc_id", verified.alias("is_verified"), to4(reward, "reward_score"), to4(F.col("abn_recall"), "abn_recall"), to4(F.col("abn_precision"), "abn_precision"), "hallucinated_entities", "invalid_abns", said.alias("violations"))


def grpo_advantages(trajectories: DataFrame, hop_penalty_weight: float = 0.05, hub_penalty_weight: float = 0.02, degree_threshold: int = 10) -> DataFrame:
    """(group_id, id, reward, advantage); trajectories: (group_id, id, gate, answer_matched, num_hops, max_node_degree)."""
    gain = 0.5 * F.col("gate") + 0.5 * F.col("answer_matched").cast("double")
    cost = hop_penalty_weight * F.greatest(F.lit(0), F.col("num_hops") - 1) + hub_penalty_weight * F.greatest(F.lit(0), F.col("max_node_degree") - degree_threshold)
    own = trajectories.select("group_id", "id", F.greatest(F.lit(0.0), gain - cost).alias("reward"))
    w = Window.partitionBy("group_id")  # a group is a few samples of one question
    sd = F.stddev_pop("reward").over(w)
    return own.withColumn("advantage", F.when((F.count("*").over(w) > 1) & (sd >= 1e-6), (F.col("reward") - F.avg("reward").over(w)) / sd).otherwise(0.0))


def qa_testset(docs: DataFrame, register: DataFrame) -> DataFrame:
    """(q, gold_answer, gold_doc): questions about sector, revenue, period and joint filing of documents that name a company."""
    own = docs.select("title", title_idx("title").alias("IDX")).join(register, "IDX").withColumn("names", entity_names("ReportingEntities")).where(F.size("names") > 0)
    first = F.get("names", F.lit(0))
    # The wording of the questions
    ask = lambda when, head, who, tail, gold: F.when(when, F.struct(F.concat(F.lit(head), who, F.lit(tail)).alias("q"), gold.alias("gold_answer")))
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    made = F.array(
        ask(given("IndustrySectors"), "What industry sectors does ", first, " operate in?", F.trim(F.split_part("IndustrySectors", F.lit(","), F.lit(1)))),
        ask(given("AnnualRevenue"), "What is the annual revenue band of ", first, "?", F.col("AnnualRevenue")),
        ask(given("PeriodStart"), "Which reporting period does the modern slavery statement of ", first, " cover?", F.col("PeriodStart")),
        ask(F.size("names") > 1, "Which entities filed a joint modern slavery statement with ", F.element_at("names", -1), "?", first),
    )
    return own.select(F.explode(F.array_compact(made)).alias("a"), F.col("title").alias("gold_doc")).select("a.q", "a.gold_answer", "gold_doc")


def qa_score(results: DataFrame, k: int = 5) -> DataFrame:
    """(hit_at_k, answer_accuracy); results: (retrieved: array, gold_doc, answer, gold_answer)."""
    hit = F.array_contains(F.slice("retrieved", 1, k), F.col("gold_doc")).cast("double")
    right = normalise_text("answer").contains(normalise_text("gold_answer")).cast("double")
    return results.agg(F.avg(hit).alias("hit_at_k"), F.avg(right).alias("answer_accuracy"))


def latency_summary(df: DataFrame, col: str) -> DataFrame:
    """(n, mean, median, min, max, p90): median at place n//2, p90 at place int(.9 n) − 1, of the ascending values.

    Places are found among distinct values with their counts."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    table = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    at = lambda place: F.max(F.when((place >= F.col("before")) & (place < F.col("before") + F.col("n")), F.col("v")))
    return table.agg(F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), at(F.floor(F.col("all") / 2)).alias("median"), F.min("v").alias("min"), F.max("v").alias("max"), at(F.greatest(F.lit(0), F.floor(F.col("all") * 0.9) - 1)).alias("p90"))
