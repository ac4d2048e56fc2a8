"""Queries over dates, periods, sections and chunks in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportlake.functions import text as T
from reportlake.operators import contents as K
from reportlake.operators import controls as C
from reportlake.operators import headings as H

from .catalog import query

from .views import table, view


@query("f16_find_dates", """with d as (select o_orderkey, unnest([o_orderdate::date, case when o_orderkey % 2 = 1 then o_orderdate::date + 40 else o_orderdate::date end, o_orderdate::date + 90]) as d from orders)
select o_orderkey, count(distinct d) as n, min(d) as first_date from d group by 1""")  # fmt: skip
def f16(spark, d):
    t = F.col("o_orderdate").cast("date")
    # full and short months, with and without a comma, in any case; a month that is none and a day that is none
    text = F.concat(F.lit("Reviewed on "), F.date_format(t, "MMMM d, yyyy"), F.lit(" and "), F.upper(F.date_format(F.when(F.col("o_orderkey") % 2 == 1, F.date_add(t, 40)).otherwise(t), "MMM d yyyy")), F.lit("; marchers 3, 2020, February 31, 2021;\n"), F.date_format(F.date_add(t, 90), "MMM  d, yyyy"), F.lit("."))
    found = table(spark, d, "orders").select("o_orderkey", H.find_dates(text).alias("ds"))
    return found.select("o_orderkey", F.size("ds").cast("long").alias("n"), F.get("ds", F.lit(0)).alias("first_date"))


@query("f19_explicit_period", "select o_orderkey, case when o_orderkey % 7 in (0, 1, 2, 3) then o_orderdate::date end as period_start, case when o_orderkey % 7 in (0, 1, 2, 3) then o_orderdate::date + 300 when o_orderkey % 7 = 4 then o_orderdate::date end as period_end from orders")
def f19(spark, d):
    t, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 7
    day = lambda c: F.date_format(c, "MMMM d, yyyy")
    bare = lambda c: F.date_format(c, "MMM d yyyy")
    end = F.date_add(t, 300)
    text = F.when(k == 0, F.concat(F.lit("Report for the period "), day(t), F.lit(" through "), day(end))).when(k == 1, F.concat(F.lit("FOR THE PERIOD\n"), bare(t), F.lit(" to "), day(end), F.lit(". As of "), day(t)))
    text = text.when(k == 2, F.concat(F.lit("for the period "), day(t), F.lit(" thru "), bare(end))).when(k == 3, F.concat(F.lit("for the period  "), day(t), F.lit(" - "), day(end)))
    text = text.when(k == 4, F.concat(F.lit("As of "), bare(t))).when(k == 5, F.concat(F.lit("for the period "), day(t), F.lit(" to Smarch 3, 2020. As of "), day(t))).otherwise("none")
    return table(spark, d, "orders").select("o_orderkey", H.explicit_period(text).alias("p")).select("o_orderkey", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"))


HEADED = "select doc_id, line_no, (line_no - 1) // 4 + 1 as page, case when line_no % 5 = 2 then case doc_id % 6 when 0 then 'Section V: Management''s Response' when 1 then '  CORRECTIVE  ACTION' when 2 then 'Remediation plan ' || repeat('x', 100) when 3 then 'management action plan' when 4 then 'Management s response' else line end else line end as line from v_lines"


def headed(spark, d):
    k = F.col("doc_id") % 6
    head = F.when(k == 0, "Section V: Management's Response").when(k == 1, "  CORRECTIVE  ACTION").when(k == 2, F.concat(F.lit("Remediation plan "), F.repeat(F.lit("x"), F.lit(100)))).when(k == 3, "management action plan").when(k == 4, "Management s response").otherwise(F.col("line"))
    return view(spark, d, "v_lines").select("doc_id", "line_no", (F.floor((F.col("line_no") - 1) / 4) + 1).alias("page"), F.when(F.col("line_no") % 5 == 2, head).otherwise(F.col("line")).alias("line"))


@query("f52_response_section", rf"""with h as ({HEADED}), x as (select *, max(page) over (partition by doc_id) as n from h),
f as (select doc_id, min(line_no) as l, any_value(n) as n from x where page >= greatest(1, n - 10) and length(trim(line)) < 100 and (regexp_matches(lower(line), 'management[\s'']?s?\s+response') or regexp_matches(lower(line), 'corrective\s+action') or regexp_matches(lower(line), 'remediation\s+plan') or regexp_matches(lower(line), 'management\s+action\s+plan')) group by 1)
select doc_id, (l - 1) // 4 + 1 as start_page, least((l - 1) // 4 + 6, n) as end_page, l as start_line, l + 500 as end_line from f""")  # fmt: skip
def f52(spark, d):
    return H.response_section(headed(spark, d))


FIRM_PAGES = "select doc_id, page_no, case doc_id % 4 when 0 then 'Report of KPMG LLP' || chr(10) when 1 then 'ACME' || chr(10) else '' end || text || case when doc_id % 3 = 0 then chr(10) || 'crowe and BDO''s' else '' end as text from v_pages"
EDGES = f"""p as ({FIRM_PAGES}), w as (select doc_id, page_no, list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(trim(x))), lambda x: x <> '') as w from p where page_no <= 5),
e as (select doc_id, page_no, 0 as foot, unnest([0, 1]) as pos, unnest(w[1:2]) as line from w where len(w) >= 2 union all select doc_id, page_no, 1, unnest([0, 1]), unnest(w[len(w)-1:len(w)]) from w where len(w) >= 2),
r as (select doc_id, line, count(*) as n, min(foot * 1000 + page_no * 10 + pos) as first from e group by 1, 2 having count(*) >= 2)"""  # fmt: skip


def firm_pages(spark, d):
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "Report of KPMG LLP\n").when(k == 1, "ACME\n").otherwise("")
    return view(spark, d, "v_pages").withColumn("text", F.concat(head, "text", F.when(F.col("doc_id") % 3 == 0, "\ncrowe and BDO's").otherwise("")))


@query("j23_repeated_edge_lines", f"with {EDGES} select doc_id, line, n from r")
def j23(spark, d):
    return H.repeated_edge_lines(firm_pages(spark, d), least=2).select("doc_id", "line", "n")


@query("j23_header_footer_vote", f"""with {EDGES}, f(pos, short, legal) as (values (0, 'bdo', 'BDO USA LLP'), (1, 'crowe', 'Crowe LLP'), (2, 'kpmg', 'KPMG LLP')),
v as (select doc_id, legal as voted from (select doc_id, legal, row_number() over (partition by doc_id order by first, pos) as k from r join f on contains(line, short)) where k = 1),
a as (select distinct doc_id, case doc_id % 5 when 0 then 'kpmg llp' when 1 then 'Crowe LLP' when 2 then 'Auditor Could Not Be Identified' when 3 then 'Other' end as auditor, case when doc_id % 2 = 0 then 0.9E0 else 0.5E0 end as confidence from v_docs)
select a.doc_id, case when auditor is null or auditor = 'Auditor Could Not Be Identified' then coalesce(voted, auditor) else auditor end as auditor,
  case when (auditor is null or auditor = 'Auditor Could Not Be Identified') and voted is not null then 0.7E0 when lower(auditor) = lower(voted) then least(1.0E0, round(confidence + 0.2E0, 6)) else confidence end as confidence, voted from a left join v using (doc_id)""")  # fmt: skip
def j23b(spark, d):
    k = F.col("doc_id") % 5
    answers = view(spark, d, "v_docs").select("doc_id", F.when(k == 0, "kpmg llp").when(k == 1, "Crowe LLP").when(k == 2, H.NO_AUDITOR).when(k == 3, "Other").alias("auditor"), F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.5).alias("confidence")).distinct()
    firms = spark.createDataFrame([(0, "BDO", "BDO USA LLP"), (1, "Crowe", "Crowe LLP"), (2, "KPMG", "KPMG LLP")], "pos int, short string, legal string")
    return H.header_footer_vote(firm_pages(spark, d), firms, answers, least=2)


@query("f06_score_control_ids")
def f06(spark, d):
    c, k = view(spark, d, "v_controls"), F.col("id") % 6
    varied = F.when(k == 0, F.concat(F.lit("Q"), "control_id")).when(k == 1, F.translate("control_id", "-", ".")).when(k == 2, F.lit("ZZ-1-1")).otherwise(F.col("control_id"))
    shaped = c.select("id", "organization", varied.alias("control_id")).withColumn("pattern", T.id_pattern(F.col("control_id")))
    return H.score_control_ids(shaped, C.learn_patterns(c)).select("id", "score")


@query("w07_boundary_chunks")
def w07(spark, d):
    return H.boundary_chunks(view(spark, d, "v_docs"))


@query("f22_normalize_heading", "select doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(lower(line), '^(section|part|chapter)\\s+([ivx]+|\\d+|[a-z])\\b', ''), '^[\\s\\d.ivx]+[.):]', ''), '[^a-z0-9]+', '', 'g') as key from v_lines")
def f22(spark, d):
    return view(spark, d, "v_lines").select("doc_id", "line_no", T.normalize_heading(F.col("line")).alias("key"))


@query("f22_core_heading", r"""with l as (select doc_id, line_no, case line_no % 5 when 0 then 'Section IV – ' || line when 1 then 'xii. ' || line when 2 then '12. A. ' || line when 3 then 'B. ' || line else line end as s from v_lines)
select doc_id, line_no, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(s), '^section\s*[ivxlcdm0-9]+\s*[-–—:]?\s*', '', 'i'), '^[ivxlcdm]+\.?\s*', '', 'i'), '^[0-9]+\.?\s*', ''), '^[a-zA-Z]\.\s*', ''), '[^\p{L}\p{N}_]', '', 'g')) as key from l""")  # fmt: skip
def f22b(spark, d):
    k = F.col("line_no") % 5
    head = F.when(k == 0, "Section IV – ").when(k == 1, "xii. ").when(k == 2, "12. A. ").when(k == 3, "B. ").otherwise("")
    own = view(spark, d, "v_lines").withColumn("line", F.concat(head, "line"))
    return K.nfkc(own, "line").select("doc_id", "line_no", K.core_heading(F.col("line")).alias("key"))


MARKED = "select doc_id, line_no + (line_no - 1) // 4 + 1 as line_no, case when doc_id % 6 = 0 and line_no = 2 then '  Table of Contents' when doc_id % 6 = 1 and line_no between 2 and 4 then ['TABLE', ' of ', 'Contents'][line_no - 1] when doc_id % 6 = 2 and line_no = 3 then 'CONTENTS' when doc_id % 6 = 3 and line_no = 30 then 'contents' else line end as line from v_lines union all select distinct doc_id, (line_no - 1) // 4 * 5 + 1, '=== PAGE ' || ((line_no - 1) // 4 + 1)::varchar || ' ===' from v_lines where doc_id % 6 <> 5"


def marked(spark, d):
    """Lines with page markers in front of every fourth, and tables of contents in some."""
    own, k, n = view(spark, d, "v_lines"), F.col("doc_id") % 6, F.col("line_no")
    line = F.when((k == 0) & (n == 2), "  Table of Contents").when((k == 1) & n.between(2, 4), F.get(F.array(F.lit("TABLE"), F.lit(" of "), F.lit("Contents")), (n - 2).cast("int"))).when((k == 2) & (n == 3), "CONTENTS").when((k == 3) & (n == 30), "contents").otherwise(F.col("line"))
    page = F.floor((n - 1) / 4)
    marks = own.where("doc_id % 6 <> 5").select("doc_id", page.alias("p")).distinct().select("doc_id", (F.col("p") * 5 + 1).alias("line_no"), F.concat(F.lit("=== PAGE "), (F.col("p") + 1).cast("string"), F.lit(" ===")).alias("line"))
    return own.select("doc_id", (n + page + 1).alias("line_no"), line.alias("line")).unionByName(marks)


@query("f24_toc_line", f"""with m as ({MARKED}), k as (select doc_id, line_no, row_number() over (partition by doc_id order by line_no) as nth, count(*) over (partition by doc_id) as n from m where starts_with(line, '=== PAGE ')),
b as (select doc_id, line_no as stop from k where nth = least(n, 5)), x as (select m.doc_id, m.line_no, lower(trim(line)) as low from m left join b using (doc_id) where (stop is null or m.line_no < stop) and trim(line) <> ''),
y as (select *, lead(low) over w as second, lead(low, 2) over w as third from x window w as (partition by doc_id order by line_no)),
h as (select doc_id, line_no, case when contains(low, 'table of contents') then 'single-line' when low = 'contents' then 'contents-alone' when low = 'table' and second = 'of' and third = 'contents' then 'multi-line' end as method from y),
f as (select doc_id, min(line_no) as line_no, arg_min(method, line_no) as method from h where method is not null group by 1)
select v.doc_id, f.line_no, coalesce((select max(nth) from k where k.doc_id = v.doc_id and k.line_no < f.line_no), 1) as page, coalesce(method, 'not-found') as method from (select distinct doc_id from v_lines) v left join f using (doc_id)""")  # fmt: skip
def f24(spark, d):
    return K.toc_page(marked(spark, d))


@query("f23_parse_toc_lines", """select id as doc_id, page_first::bigint as line_no, unnest([0, 1])::bigint as pos, unnest([organization, 'Section II Overview']) as heading, unnest([page_first + 10, page_last + 200]) as page from v_controls where id % 3 <> 0
union all select id, page_first, 0, organization || ' without a page', null from v_controls where id % 3 = 0""")  # fmt: skip
def f23(spark, d):
    c = view(spark, d, "v_controls")
    two = F.concat(F.lit("  "), "organization", F.lit(" ........ "), (F.col("page_first") + 10).cast("string"), F.lit(" Section II Overview .. "), (F.col("page_last") + 200).cast("string"))
    line = F.when(F.col("id") % 3 == 0, F.concat("organization", F.lit(" without a page"))).otherwise(two)
    return K.parse_toc_lines(c.select(F.col("id").alias("doc_id"), F.col("page_first").cast("long").alias("line_no"), line.alias("line")))


CONTENTS = "select doc_id, line_no, case line_no % 7 when 0 then 'Section ' || (line_no % 9)::varchar || ' - ' || line when 2 then line || ' ..... ' || (line_no % 300)::varchar when 3 then case when doc_id % 2 = 0 then ' Table of ' else '' end when 5 then 'IV – ' || line else line end as line from v_lines"


@query("f25_join_toc_entries", rf"""with c as ({CONTENTS}), r as (select doc_id, line_no, trim(line) as s from c),
q as (select *, s = '' or regexp_matches(s, '^((the\s*)?table\s*of\s*contents|table\s*of\s*content|table\s+of|table|of|of\s*contents|contents|toc)$', 'i') as dead,
  regexp_matches(s, '(\.{{2,}}|\s)\d{{1,4}}$') or regexp_matches(s, '^\p{{Lu}}.*\d$') or regexp_matches(s, '^(section\s*[ivxlcdm0-9]+|[ivxlcdm0-9]+\.|\d|[a-z]\.)', 'i') as starts,
  regexp_matches(s, '^(section\s*[ivxlcdm0-9]+|[ivxlcdm0-9]+\s*[-–—])', 'i') or (length(s) >= 40 and s = upper(s)) as main from r),
g as (select *, sum((dead or starts)::int) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as stretch from q),
h as (select *, min(case when not dead and main then line_no end) over (partition by doc_id, stretch order by line_no rows between unbounded preceding and current row) as head from g)
select doc_id, coalesce(head, line_no) as line_no, string_agg(s, ' ' order by h.line_no) as entry from h where not dead group by doc_id, stretch, coalesce(head, line_no)""")  # fmt: skip
def f25(spark, d):
    own, k = view(spark, d, "v_lines"), F.col("line_no") % 7
    n = lambda m: (F.col("line_no") % m).cast("string")
    line = F.when(k == 0, F.concat(F.lit("Section "), n(9), F.lit(" - "), "line")).when(k == 2, F.concat("line", F.lit(" ..... "), n(300))).when(k == 3, F.when(F.col("doc_id") % 2 == 0, " Table of ").otherwise("")).when(k == 5, F.concat(F.lit("IV – "), "line")).otherwise(F.col("line"))
    return K.join_toc_entries(own.withColumn("line", line))
