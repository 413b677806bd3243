"""Queries on text columns, lexical retrieval, references and limits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import clause_number, fingerprint, normalized, number_path, search_tokens
from strataloom.operators.limits import limits_and_facts
from strataloom.operators.names import contained_names
from strataloom.operators.ordered import ranked
from strataloom.operators.records import latest
from strataloom.operators.references import numbered, references, resolve_references
from strataloom.operators.retrieval import inverted_index, page, search
from strataloom.plans.knowledge_queries import _ENT, _LAST, _entities
from strataloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + " "


def _plain(x: str) -> str:
    return f"translate({x}, '{_WIDE}', '{_NARROW}')"


def _folded(x: str) -> str:
    return f"replace(lower({_plain(f'coalesce({x}, chr(32))')}), 'ß', 'ss')"


def _tokens(x: str) -> str:
    runs = f"regexp_extract_all({_folded(x)}, '([\\x{{3400}}-\\x{{9fff}}]+|[a-z0-9]+(?:[.][0-9]+)*)')"
    pairs = "list_transform(range(1, cast(greatest(length(r) - 1, 1) as bigint) + 1), lambda i: substring(r, i, 2))"
    return f"list_distinct(flatten(list_transform({runs}, lambda r: case when regexp_matches(r, '^[\\x{{3400}}-\\x{{9fff}}]') then {pairs} else [r] end)))"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "evidence"))


@_query("r1_token_counts", f"select token, count(*) as docs from (select unnest({_tokens('text')}) as token from {_LAST['evidence']}) group by token")
def r1(spark, sf_dir):
    """Number of evidence per search token."""
    return _evidence(spark, sf_dir).select(F.explode(search_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("docs"))


@_query("r3_index_totals", f"select id, len({_tokens('text')}) as length, list_sort({_tokens('text')})[1] as first_token from {_LAST['evidence']} where len({_tokens('text')}) > 0")
def r3_totals(spark, sf_dir):
    """Size and first token of each evidence in the inverted index."""
    return inverted_index(_evidence(spark, sf_dir)).groupBy("id").agg(F.first("length").cast("bigint").alias("length"), F.min("token").alias("first_token"))


_GROUPS = [["焊缝"], ["检查"]]
_BM25 = f"""with d as (select id, {_folded('text')} as body, {_tokens('text')} as toks from {_LAST['evidence']}),
n as (select count(*) as docs, avg(len(toks)) as mean from d where len(toks) > 0),
p as (select d.id, q.token, len(toks) as len, cast((length(body) - length(replace(body, q.token, ''))) / length(q.token) as int) as tf from d, (select unnest(['焊缝', '检查']) as token) q where list_contains(toks, q.token)),
f as (select token, count(*) as df from p group by token)"""


@_query("r3_search_all", _BM25 + "select id, 2 as hits, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) as score from p join f using (token), n group by id having count(*) = 2")
def r3(spark, sf_dir):
    """Evidence with both of two phrases, ranked by BM25."""
    return search(_evidence(spark, sf_dir), _GROUPS, "all").withColumn("score", F.round("score", 6))


@_query("r4_search_any", _BM25 + "select id, cast(count(*) as int) as hits, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) as score from p join f using (token), n group by id")
def r4(spark, sf_dir):
    """Evidence with either of two phrases, ranked by BM25."""
    return search(_evidence(spark, sf_dir), _GROUPS, "any").withColumn("score", F.round("score", 6))


@_query("l2_search_page", _BM25 + "select id, hits, round(score, 6) as score from (select id, cast(count(*) as int) as hits, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as score from p join f using (token), n group by id) order by hits desc, round(score, 6) desc, id limit 20")
def l2(spark, sf_dir):
    """The first page of 20 by phrases found, score and id."""
    found = search(_evidence(spark, sf_dir), _GROUPS, "any").withColumn("score", F.round("score", 6))
    return page(found, [F.desc("hits"), F.desc("score"), "id"], 20, {"query": _GROUPS})[0]


@_query("x1_name_forms", f"select id, regexp_replace(lower({_plain('label')}), '\\s+', '', 'g') as form from (select distinct id, label from domain_classes where label is not null)")
def x1(spark, sf_dir):
    """The comparison form of every class label."""
    return table(spark, sf_dir, "domain_classes").select("id", "label").where("label is not null").distinct().select("id", normalized(F.col("label")).alias("form"))


@_query("x12_clause_numbers", f"select id, regexp_extract({_plain('text')}, '^\\s*([0-9]+(?:[.][0-9]+)+)\\s', 1) as number from {_LAST['source_unit']} where regexp_matches({_plain('text')}, '^\\s*([0-9]+(?:[.][0-9]+)+)\\s')")
def x12(spark, sf_dir):
    """Dotted numbers at the start of units."""
    return latest(table(spark, sf_dir, "source_unit")).select("id", clause_number(F.col("text")).alias("number")).where("number is not null")


@_query("l5_natural_order", f"""select id, document_id, row_number() over (partition by document_id order by list_transform(string_split(number, '.'), lambda x: cast(x as int)), id) as place
from (select id, document_id, regexp_extract({_plain('text')}, '^\\s*([0-9]+(?:[.][0-9]+)+)\\s', 1) as number from {_LAST['source_unit']}) where number <> ''""")
def l5(spark, sf_dir):
    """Numbered units of a document in the natural order of their numbers."""
    df = latest(table(spark, sf_dir, "source_unit")).select("id", "document_id", clause_number(F.col("text")).alias("number")).where("number is not null")
    path = number_path(F.col("number"))
    return ranked(df, "document_id", [path, F.col("id")], [F.element_at(path, 1), F.element_at(path, 2)], "place").select("id", "document_id", "place")


@_query("x21_limits")
def x21(spark, sf_dir):
    """All limits that statements name in Chinese wording, with the usual spelling of their unit."""
    return limits_and_facts(latest(table(spark, sf_dir, "statements"))).where("op is not null").select("id", "op", "value", "unit")


@_query("x18_fingerprints", f"select id, sha256(concat_ws(chr(1), coalesce(document_id, chr(2)), coalesce(type, chr(2)), coalesce(text, chr(2)))) as print from {_LAST['statements']}")
def x18(spark, sf_dir):
    """Content fingerprints of statements."""
    return latest(table(spark, sf_dir, "statements")).select("id", fingerprint(F.col("document_id"), F.col("type"), F.col("text")).alias("print"))


@_query("i1_logical_keys", f"""select print, count(distinct id) as ids from (select id, sha256(concat_ws(chr(1), coalesce(document_id, chr(2)), coalesce(kind, chr(2)), coalesce(array_to_string(list_sort(list_transform(members, lambda m: coalesce(m.source_id, '') || '/' || coalesce(m.role, ''))), ';'), chr(2)))) as print from {_LAST['evidence']}) group by print having count(distinct id) > 1""")
def i1(spark, sf_dir):
    """Evidence records that share a logical key of document, kind and members."""
    members = F.array_join(F.sort_array(F.transform("members", lambda m: F.concat(F.coalesce(m["source_id"], F.lit("")), F.lit("/"), F.coalesce(m["role"], F.lit(""))))), ";")
    df = _evidence(spark, sf_dir).select("id", fingerprint(F.col("document_id"), F.col("kind"), members).alias("print"))
    return df.groupBy("print").agg(F.countDistinct("id").alias("ids")).where("ids > 1")


@_query("x13_references")
def x13(spark, sf_dir):
    """Clauses, sections, tables and figures that evidence refers to, with repeats."""
    return references(_evidence(spark, sf_dir)).select("id", "kind", "number", "end_number", "external")


@_query("r6_resolved")
def r6(spark, sf_dir):
    """References of evidence resolved to numbered units of their document."""
    return resolve_references(references(_evidence(spark, sf_dir)), numbered(latest(table(spark, sf_dir, "source_unit"))))


@_query("j6_names_in_text", f"""select s.id, c.label from (select id, text from {_LAST['statements']} where text is not null) s join (select distinct label from domain_classes where label is not null and label <> '') c on contains(s.text, c.label)""")
def j6(spark, sf_dir):
    """Class labels that occur in statements."""
    names = table(spark, sf_dir, "domain_classes").select("label").where("label is not null and label <> ''").distinct()
    return contained_names(latest(table(spark, sf_dir, "statements")).select("id", "text"), names, "id", "text", "label")


@_query("g9_alias_classes", f"""with a as (select distinct id as class_id, regexp_replace(lower({_plain('name')}), '\\s+', '', 'g') as form from (select id, label as name from domain_classes union all select id, unnest(aliases) from domain_classes) where name is not null),
m as (select distinct label, regexp_replace(lower({_plain('label')}), '\\s+', '', 'g') as form from {_ENT} where label is not null)
select m.label, count(distinct a.class_id) as classes, case when count(distinct a.class_id) = 1 then min(a.class_id) end as class_id from m left join a using (form) group by m.label""")
def g9(spark, sf_dir):
    """Mentioned labels resolved to a class by label or alias, only where exactly one class fits."""
    own = table(spark, sf_dir, "domain_classes")
    names = own.select(F.col("id").alias("class_id"), F.col("label").alias("name")).union(own.select("id", F.explode("aliases")))
    names = names.where("name is not null").select("class_id", normalized(F.col("name")).alias("form")).distinct()
    said = _entities(spark, sf_dir).where("label is not null").select("label", normalized(F.col("label")).alias("form")).distinct()
    df = said.join(names, "form", "left").groupBy("label").agg(F.countDistinct("class_id").alias("classes"), F.min("class_id").alias("one"))
    return df.select("label", "classes", F.when(F.col("classes") == 1, F.col("one")).alias("class_id"))


@_query("x24_expanded_pages", """select document_id, page from (select document_id, unnest(range(lo, hi + 1)) as page from (select document_id, min(locator.physical_page) as lo, max(locator.physical_page) as hi from source_unit where locator.physical_page is not null group by document_id))
except select document_id, locator.physical_page from source_unit where locator.physical_page is not null""")
def x24(spark, sf_dir):
    """Pages between the first and the last page of a document that have no unit."""
    own = table(spark, sf_dir, "source_unit").select("document_id", F.col("locator.physical_page").alias("page")).where("page is not null").distinct()
    ends = own.groupBy("document_id").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    every = ends.select("document_id", F.explode(F.sequence("lo", "hi")).alias("page"))
    return every.join(own, ["document_id", "page"], "left_anti").select("document_id", F.col("page").cast("bigint").alias("page"))


@_query("f1_attributes", f"select kind, count(attributes) as with_attributes, count(json_extract(attributes, '$.paragraph_index')) as indexed, max(cast(json_extract_string(attributes, '$.paragraph_index') as int)) as greatest from {_LAST['source_unit']} group by kind")
def f1(spark, sf_dir):
    """Free attributes of units read by path."""
    index = F.get_json_object("attributes", "$.paragraph_index")
    return latest(table(spark, sf_dir, "source_unit")).groupBy("kind").agg(F.count("attributes").alias("with_attributes"), F.count(index).alias("indexed"), F.max(index.try_cast("int")).alias("greatest"))
