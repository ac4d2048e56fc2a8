"""Bindings of the operators to the test tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_criteria": "select r_name as framework, concat('S', cast(n_nationkey % 3 as varchar(10))) as section, n_name as id, concat('Criterion ', n_name) as description, n_regionkey as priority from nation join region on n_regionkey=r_regionkey",
    "v_li": "select l_orderkey, min(l_partkey) as pk, min(l_linenumber) as p1, max(l_linenumber) as p2, count(*) as n_lines from lineitem group by l_orderkey",
    "v_controls": """select o_orderkey as id, c_nationkey as scan_id, c_mktsegment as organization, o_orderkey as control_seq,
  case when o_orderkey % 97 = 0 then '' else concat(substr(c_mktsegment,1,3), '-', lpad(cast(o_orderkey % 12 as varchar(10)),2,'0'), '-', lpad(cast(month(o_orderdate) as varchar(10)),2,'0')) end as control_id,
  concat(o_orderpriority, ' review of ', p_name) as control_desc,
  case when o_orderkey % 11 = 0 then null else concat('Inspected ', p_type, ' records') end as control_test,
  case when o_orderkey % 13 = 0 then null when o_orderstatus='F' then 'Deviation noted. Sample missing.' else 'No exceptions noted.' end as control_test_results,
  (o_orderstatus='F' and o_orderkey % 5 = 0) as has_deviation,
  (o_orderkey % 101)/100.0E0 as control_confidence, p1 as page_first, p2 as page_last, o_orderdate as updated_at,
  case when o_orderkey % 17 = 0 then 'DUPLICATE_INSTANCE' when o_orderkey % 19 = 0 then cast(o_orderkey - 1 as varchar(20)) end as merged_to_control_id
  from orders join customer on o_custkey=c_custkey join v_li on l_orderkey=o_orderkey join part on p_partkey=pk""",
    "v_mappings": "select distinct l_orderkey as control_db_id, r_name as framework, n_name as criterion_id, 1.0E0 - (s_suppkey % 50)/100.0E0 as confidence from lineitem join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey",
    "v_cuecs": "select c_custkey as id, c_nationkey as scan_id, concat('User entities ', case when c_custkey % 3=0 then 'must ensure ' when c_custkey % 3=1 then 'are responsible for ' else 'describe ' end, lower(c_mktsegment), ' access', case when c_custkey % 4=0 then '' else '.' end) as cuec_description, case c_custkey % 3 when 0 then 'yes' when 1 then 'no' else 'maybe' end as cuec_gpt_opinion, (c_custkey % 101)/100.0E0 as cuec_confidence, c_custkey as cuec_seq from customer",
    "v_orgs": "select distinct l_orderkey % 25 as scan_id, s_suppkey as org_key, concat(s_name, case l_returnflag when 'A' then ', Inc.' when 'R' then ' (SUP)' else '' end) as third_party_name, concat(p_type, ' provider') as third_party_description, cast(l_linenumber as varchar(10)) as third_party_page_ref, l_discount * 10 as third_party_confidence from lineitem join supplier on l_suppkey=s_suppkey join part on l_partkey=p_partkey",
    "v_scans": "select o_orderkey as id, c_custkey as company_id, c_name as company, c_acctbal as company_confidence, o_orderdate as scan_date, o_totalprice as elapsed_seconds, case when o_orderstatus='F' then 'SOC1' when o_orderstatus='O' then 'SOC2' else 'COMBINED' end as report_type from orders join customer on o_custkey=c_custkey",
    "v_usage": "select event_id as call_id, ts, event_type as model, concat('x', cast(user_id % 5 as varchar(10))) as extractor, cast(floor(value) as bigint) as prompt_tokens, cast(floor(value/4) as bigint) as completion_tokens, value as duration_seconds from events",
    "v_jobs": "select user_id as job_id, event_id, ts, event_type as status, user_id % 3 as priority, cast(floor(value) as bigint) % 101 as progress from events",
}
#: Twins of the text views, which the two dialects write differently.
DUCK_VIEWS = VIEWS | {
    "v_docs": "select doc_id, coalesce(text, '') as text, source as organization from documents",
    "v_lines": "select doc_id, unnest(range(1, len(ls) + 1)) as line_no, unnest(ls) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)",
    "v_pages": "select doc_id, (line_no - 1) // 4 + 1 as page_no, string_agg(line, chr(10) order by line_no) as text, min(line_no) as first_line from v_lines group by 1, 2",
}


def names_in(sql: str) -> list[str]:
    return [v for v in re.findall(r"\bv_\w+", sql) if v in DUCK_VIEWS]


def duck(sql: str) -> str:
    """sql with the views that it names in front, as common table expressions."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for inner in names_in(DUCK_VIEWS[name]):
            if inner != name:
                add(inner)
        if name not in wanted:
            wanted.append(name)

    for name in names_in(sql):
        add(name)
    sql = sql.strip()
    if not wanted:
        return sql
    ctes = ",\n".join(f"{n} as ({DUCK_VIEWS[n]})" for n in wanted)
    if sql.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n" + sql[15:]
    return f"with {ctes}" + (",\n" + sql[5:] if sql.lower().startswith("with ") else "\n" + sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame, by plain SQL over the tables read from sf_dir; no name is registered."""
    if name == "v_docs":
        return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("organization"))
    if name == "v_lines":
        docs = view(spark, sf_dir, "v_docs")
        return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")
    if name == "v_pages":
        lines = view(spark, sf_dir, "v_lines")
        page = F.floor((F.col("line_no") - 1) / 4) + 1
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
        return lines.groupBy("doc_id", page.alias("page_no")).agg(text.alias("text"), F.min("line_no").alias("first_line"))
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", sql)} | {v: view(spark, sf_dir, v) for v in names_in(sql)}
    for t in used:
        sql = re.sub(rf"(?<=from ){t}\b|(?<=join ){t}\b", f"{{{t}}}", sql)
    return spark.sql(sql, **used)
