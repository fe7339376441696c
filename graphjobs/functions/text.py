"""Column expressions over names, business numbers, register rows, model output and answers.

White space and digits are ASCII in the patterns unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the eleven digits of a business number, words that mark a company, articles dropped from answers.
ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
COMPANY_WORDS = "pty|ltd|limited|holdings|inc|plc|corporation"
ARTICLES = "a|an|the"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def normalise_phrase(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(c).cast("string")), "[^A-Za-z0-9 ]", " "))


def normalise_text(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), "[^a-z0-9]+", " "))


def norm_abn(c) -> Column:
    digits = F.regexp_replace(_c(c), "[^0-9]", "")
    return F.when(F.length(digits) == 11, digits)


def abn_checksum(c) -> Column:
    """Whether eleven digits pass the weighted check; false for anything else."""
    digit = lambda i: F.try_cast(F.substring(_c(c), i + 1, 1), "int") if hasattr(F, "try_cast") else F.substring(_c(c), i + 1, 1).try_cast("int")
    total = sum(((digit(i) - (1 if i == 0 else 0)) * w for i, w in enumerate(ABN_WEIGHTS)), F.lit(0))
    return F.coalesce(_c(c).rlike("^[0-9]{11}$") & (total % 89 == 0), F.lit(False))


def is_valid_abn(c, check_checksum: bool = True) -> Column:
    own = norm_abn(c)
    if not check_checksum:
        return own.isNotNull()
    # a lambda names the digits once: eleven copies of how they were found would make very long code
    return F.get(F.transform(F.array(own), lambda a: F.coalesce(abn_checksum(a), F.lit(False))), F.lit(0))


def abn_spaced(c) -> Column:
    return F.concat_ws(" ", F.substring(_c(c), 1, 2), F.substring(_c(c), 3, 3), F.substring(_c(c), 6, 3), F.substring(_c(c), 9, 3))


def clean_field(c) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"\s+", " "))


def _entity_parts(c) -> Column:
    """The entries of "A (n), B (m)"; a parenthesis that the split takes away is put back."""
    parts = F.filter(F.transform(F.split(clean_field(c), r"\)\s*,\s*"), lambda p: F.trim(F.regexp_replace(F.trim(p), ",+$", ""))), lambda p: p != "")
    dangling = lambda p: F.regexp_count(p, F.lit(r"\(")) > F.regexp_count(p, F.lit(r"\)"))
    return F.transform(parts, lambda p: F.when(dangling(p), F.concat(p, F.lit(")"))).otherwise(p))


def parse_entities(c) -> Column:
    return F.transform(_entity_parts(c), lambda p: F.regexp_replace(p, r"\(([0-9][0-9 ]*[0-9])\)$", "(ABN $1)"))


def entity_names(c) -> Column:
    names = F.transform(_entity_parts(c), lambda p: F.trim(F.regexp_replace(p, r"\s*\([0-9 ]+\)$", "")))
    return F.filter(names, lambda n: n != "")


def join_names(a) -> Column:
    """a, b and c"""
    a = _c(a)
    most = F.concat_ws(", ", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))))
    return F.when(F.size(a) < 2, F.concat_ws("", a)).otherwise(F.concat(most, F.lit(" and "), F.element_at(a, -1)))


def render_passage(register: DataFrame) -> DataFrame:
    """(IDX, title, passage) of register rows that name an entity. Sentences on blank fields are left out, but for the first;
    columns that the register lacks are blank."""
    names, entities = entity_names("ReportingEntities"), parse_entities("ReportingEntities")
    field = lambda c: clean_field(c) if c in register.columns else F.lit("")
    many = lambda one, more: F.when(F.size(entities) > 1, more).otherwise(one)
    kind = F.coalesce(F.nullif(F.lower(field("Type")), F.lit("")), F.lit("modern slavery"))
    said = lambda c, *parts: F.when(field(c) != "", F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts], field(c), F.lit(".")))
    # The wording of titles and passages
    title = F.concat(F.lit("Modern slavery statement "), field("IDX"), F.lit(": "), F.concat_ws(" & ", F.slice(names, 1, 3)), F.when(F.size(names) > 3, " et al.").otherwise(""))
    sentences = [
        F.concat(join_names(entities), F.lit(" filed a "), kind, F.lit(" modern slavery statement with the Australian Modern Slavery Register for the reporting period "), field("PeriodStart"), F.lit(" to "), field("PeriodEnd"), F.lit(".")),
        said("HeadquarteredCountries", "The reporting ", many("entity is", "entities are"), " headquartered in "),
        said("AnnualRevenue", "The reporting ", many("entity has", "entities have"), " an annual revenue band of "),
        said("IndustrySectors", "The reporting ", many("entity operates", "entities operate"), " in the industry sectors: "),
        said("IncludedEntities", "The statement also covers the included entities: "),
        said("Link", "Register entry: "),
    ]
    return register.where(F.size(entities) > 0).select("IDX", title.alias("title"), F.concat_ws(" ", *sentences).alias("passage"))


def title_idx(c) -> Column:
    return F.regexp_extract(_c(c), r"^Modern slavery statement (\S+):", 1)


def company_from_title(c) -> Column:
    """The first company after the colon, or of the whole title if it has none."""
    after = F.regexp_extract(_c(c), r":\s*(.+)$", 1)
    name = strip(F.lower(F.coalesce(F.nullif(after, F.lit("")), _c(c))))
    first = F.split_part(F.split_part(name, F.lit(","), F.lit(1)), F.lit(" & "), F.lit(1))
    return F.trim(F.regexp_replace(first, "[^a-z0-9]+", " "))


def is_company_name(c) -> Column:
    return normalise_text(c).rlike(rf"\b({COMPANY_WORDS})\b")


def attributes_to_text(attributes, **given) -> Column:
    """key: value lines, the given ones first; nulls are left out."""
    line = lambda k, v: F.when(v.isNotNull(), F.concat(k, F.lit(": "), v.cast("string")))
    first = [line(F.lit(k), _c(v)) for k, v in given.items()]
    rest = F.filter(F.transform(F.map_entries(_c(attributes)), lambda e: line(e["key"], e["value"])), lambda t: t.isNotNull())
    return F.concat_ws("\n", *first, rest)


def node_text(name, attributes) -> Column:
    content = F.element_at(_c(attributes), "content")
    return F.concat_ws("\n", _c(name), F.when(strip(content) != "", content))


def fact_text(source, relation, target) -> Column:
    return F.concat_ws(" [SEP] ", F.lower(_c(source)), _c(relation), F.lower(_c(target)))


def with_title(title, content) -> Column:
    return F.concat_ws("\n", _c(title), _c(content))


def _nested(open_: str, close: str, depth: int = 4) -> str:
    inner = f"[^{open_}{close}]*"
    pattern = inner
    for _ in range(depth - 1):
        pattern = f"{inner}(?:{open_}{pattern}{close}{inner})*"
    return f"{open_}{pattern}{close}"


def extract_json(c) -> Column:
    """The first {…} block, else the first […] block, if it parses; else null."""
    block = lambda o, e: F.nullif(F.regexp_extract(_c(c), _nested(o, e), 0), F.lit(""))
    found = F.coalesce(block(r"\{", r"\}"), block(r"\[", r"\]"))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def parse_entities_response(c) -> Column:
    """Sorted distinct entities of {"named_entities": […]} or a bare list, with or without text around it; empty if it
    doesn't parse."""
    kind, block = "array<string>", extract_json(c)
    named = F.from_json(F.get_json_object(block, "$.named_entities"), kind)
    bare = F.from_json(F.when(block.startswith("["), block), kind)
    found = F.coalesce(named, bare, F.array().cast(kind))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


def parse_triples_response(c) -> Column:
    """Triples of {"triples": […]} or a bare list of lists; empty if it doesn't parse. Nothing is evaluated."""
    kind = "array<array<string>>"
    block = extract_json(c)
    named = F.from_json(F.get_json_object(block, "$.triples"), kind)
    bare = F.from_json(F.when(F.ltrim(_c(c)).startswith("["), _c(c)), kind)
    return F.coalesce(bare, named, F.array().cast(kind))


def normalise_answer(c) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, rf"\b({ARTICLES})\b", " "), r"\s+", " "))


def extract_answer(c) -> Column:
    return F.when(_c(c).contains("Answer: "), strip(F.element_at(F.split(_c(c), "Answer:"), 2))).otherwise(_c(c))


def task_type(df: DataFrame, source: str = "field", field: str = "task", delimiter: str = "-", index: int = 0) -> DataFrame:
    """df with task_type, from a field or a part of the id; a missing one is an error when it is read."""
    own = F.col(field) if source == "field" else F.get(F.split("id", rf"\Q{delimiter}\E"), F.lit(index))
    return df.withColumn("task_type", F.coalesce(own, F.raise_error(F.lit("a row has no task type")).cast("string")))


def truncate_normalise(vec, d: int | None = None) -> Column:
    """The first d components over their norm; a zero vector stays zero."""
    own = _c(vec).cast("array<double>")
    own = own if d is None else F.slice(own, 1, d)
    norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(own, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def build_context(retrieved: DataFrame, questions: DataFrame, question_prompt: str = "{question}") -> DataFrame:
    """(query, context): a block for each type, of items with a key: value line for each column, then the question, and the
    thoughts behind it.

    retrieved: (query, type, rank, then an item's columns in their order), a few rows a query; types come by type_no where
    retrieved has it, else by name, and a null value is None. questions: (query, question[, thoughts: array])."""
    held = [c for c in retrieved.columns if c not in ("query", "type", "rank", "type_no")]
    item = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in held])
    place = F.min("type_no") if "type_no" in retrieved.columns else F.lit(0)
    blocks = retrieved.groupBy("query", "type").agg(place.alias("place"), F.array_sort(F.collect_list(F.struct("rank", item.alias("text")))).alias("items"))
    block = F.concat(F.lit("## Relevant "), "type", F.lit(":\n\n"), F.concat_ws("\n\n", F.col("items.text")), F.lit("\n\n"))
    whole = blocks.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "type", block.alias("text")))).alias("blocks"))
    before, _, after = question_prompt.partition("{question}")
    thoughts = F.concat_ws(" ", "thoughts") if "thoughts" in questions.columns else F.lit("")
    context = F.concat(F.concat_ws("", F.col("blocks.text")), F.lit(before), "question", F.lit(after), thoughts)
    return questions.join(whole, "query", "left").select("query", context.alias("context"))
