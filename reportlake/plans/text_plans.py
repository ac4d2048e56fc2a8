"""Queries over report text."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportlake.functions import text as T
from reportlake.operators import documents as D  # noqa: N812
from reportlake.operators import batching as B
from reportlake.operators import spellings as N

from .catalog import query
from .views import view


def docs(spark, d):
    return view(spark, d, "v_docs")


def lines(spark, d):
    return view(spark, d, "v_lines")


QUARTERS = "select doc_id, q, 'T' || q::varchar as topic, greatest(1, (n * q) // 4 + 1) as start_line, n as last_line from (select doc_id, max(line_no) as n from v_lines group by 1), (select unnest(range(0, 4)) as q)"


def sections(spark, d):
    """Four sections per document, starting at its quarters."""
    n = lines(spark, d).groupBy("doc_id").agg(F.max("line_no").alias("last_line"))
    q = n.select("doc_id", "last_line", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q"))
    return q.select("doc_id", F.concat(F.lit("T"), F.col("q")).alias("topic"), F.greatest(F.lit(1), F.floor(F.col("last_line") * F.col("q") / 4) + 1).alias("start_line"), "last_line")


ENDS = f"select doc_id, topic, start_line, greatest(start_line, coalesce(lead(start_line) over (partition by doc_id order by start_line, topic) - 1, last_line)) as end_line from ({QUARTERS})"


@query("s01_report_lines", "select doc_id, line_no, line from v_lines")
def s01(spark, d):
    return lines(spark, d)


@query("w10_section_ends", ENDS)
def w10(spark, d):
    return D.section_ends(sections(spark, d)).select("doc_id", "topic", "start_line", "end_line")


@query("j10_lines_in_section", f"with s as ({ENDS}) select l.doc_id, l.line_no, s.topic from v_lines l join s on s.doc_id = l.doc_id and l.line_no between s.start_line and s.end_line")
def j10(spark, d):
    return D.lines_in_section(lines(spark, d), D.section_ends(sections(spark, d))).select("doc_id", "line_no", "topic")


@query("j11_page_of_line", "select doc_id, line_no, coalesce(last_value(case when line_no % 4 = 0 then line_no // 4 end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row), 1) as page from v_lines")
def j11(spark, d):
    marker = F.when(F.col("line_no") % 4 == 0, F.floor(F.col("line_no") / 4))
    return D.page_of_line(lines(spark, d), marker).select("doc_id", "line_no", "page")


@query("u05_union_page_spans", f"with s as ({ENDS}) select doc_id, line_no from v_lines where line_no <= 3 union select l.doc_id, l.line_no from v_lines l join s on s.doc_id = l.doc_id and l.line_no between s.start_line and s.end_line and s.topic = 'T2'")
def u05(spark, d):
    return D.union_page_spans(lines(spark, d), D.section_ends(sections(spark, d)).where("topic = 'T2'"), 3)


@query("w05_line_chunks", "with k as (select doc_id, line_no, line, unnest(range(greatest(0, cast(ceil((line_no - 4) / 3.0) as bigint)), (line_no - 1) // 3 + 1)) as chunk_id from v_lines) select doc_id, chunk_id, min(line_no) as start_line, md5(string_agg(line, chr(10) order by line_no)) as hash from k group by 1, 2")
def w05(spark, d):
    return D.line_chunks(lines(spark, d), 4, 1).select("doc_id", "chunk_id", "start_line", F.md5("text").alias("hash"))


@query("w05_guarded_chunks", r"""with l as (select doc_id, string_split(text, chr(10)) as ls from v_docs), k as (select doc_id, ls, unnest(range(1, len(ls) + 1, 4)) as s from l),
c as (select doc_id, s as start_line, array_to_string(ls[s:s+6], chr(10)) as text from k), b as (select doc_id, min(start_line) as blank from c where not regexp_matches(text, '\S') group by 1)
select doc_id, start_line, md5(text) as hash from c left join b using (doc_id) where blank is null or start_line < blank""")  # fmt: skip
def w05b(spark, d):
    return D.guarded_chunks(docs(spark, d), 1, 6, 2, 1).select("doc_id", "start_line", F.md5("text").alias("hash"))


@query("w06_char_chunks", "with k as (select doc_id, text, unnest(range(0, greatest(length(text), 1), 800)) as start from v_docs) select doc_id, start // 800 as chunk_id, start, length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) + 1 as start_line, md5(substr(text, start + 1, 1000)) as hash from k")
def w06(spark, d):
    return D.char_chunks(docs(spark, d), 1000, 200).select("doc_id", "chunk_id", "start", "start_line", F.md5("text").alias("hash"))


@query("w08_token_batches", """with recursive r as (select organization, doc_id, length(text) // 4 as t, row_number() over (partition by organization order by doc_id) as k from v_docs),
b as (select organization, k, doc_id, t as used, 0::bigint as batch from r where k = 1 union all select r.organization, r.k, r.doc_id, case when b.used > 0 and b.used + r.t > 2000 then r.t else b.used + r.t end, case when b.used > 0 and b.used + r.t > 2000 then b.batch + 1 else b.batch end from b join r on r.organization = b.organization and r.k = b.k + 1)
select organization, doc_id, batch from b""")  # fmt: skip
def w08(spark, d):
    rows = docs(spark, d).select("organization", "doc_id", T.token_estimate(F.col("text")).alias("t"))
    return B.token_batches(rows, "organization", "doc_id", "t", 2000)


@query("f41_token_estimate", "select doc_id, length(text) // 4 as tokens from v_docs")
def f41(spark, d):
    return docs(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("f44_offset_to_line", "select doc_id, length(substr(text, 1, 500)) - length(replace(substr(text, 1, 500), chr(10), '')) + 1 as line from v_docs")
def f44(spark, d):
    return docs(spark, d).select("doc_id", T.offset_to_line(F.col("text"), F.lit(500)).alias("line"))


@query("f45_content_hash", "select doc_id, sha256(text) as sha, md5(text) as md from v_docs")
def f45(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"))


@query("f20_text_snippet", "with s as (select doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) as t from v_docs) select doc_id, case when length(t) > 150 then substr(t, 1, 150) || '...' else t end as snippet from s")
def f20(spark, d):
    return docs(spark, d).select("doc_id", T.text_snippet(F.col("text")).alias("snippet"))


@query("f20_id_snippet", r"""with t as (select doc_id, trim(regexp_replace(text || case doc_id % 6 when 0 then ' x CC6.1 Access is reviewed. More.' when 1 then ' see control 4.2 which holds! Yes' when 2 then ' 3.1' when 3 then ' Control ID: AB-12 is run daily? Yes' when 4 then ' CC1.1 ' || repeat('word ', 60) || '.' else '' end, '\s+', ' ', 'g')) as t from v_docs),
p(pos, p) as (values (0, 'CC\d+\.\d+'), (1, 'Control\s+\d+\.\d+'), (2, '\d+\.\d+'), (3, 'Control\s+ID:\s*\w+-\d+'), (4, 'Ref:\s*\d+\.\d+\.\d+')),
m as (select doc_id, t, pos, regexp_extract(t, '(?i)' || p) as id from t, p where regexp_matches(t, '(?i)' || p)),
r as (select doc_id, pos, id, regexp_extract(ltrim(substr(t, strpos(t, id) + length(id))), '^[^.!?]*[.!?]') as sentence from m),
c as (select doc_id, arg_min(trim(id || ' ' || sentence), pos) as s from r where sentence <> '' group by 1)
select t.doc_id, case when t = '' then null when s is not null then case when length(s) > 200 then substr(s, 1, 197) || '...' else s end when length(t) > 150 then substr(t, 1, 150) || '...' else t end as snippet from t left join c using (doc_id)""")  # fmt: skip
def f20b(spark, d):
    k = F.col("doc_id") % 6
    more = F.when(k == 0, " x CC6.1 Access is reviewed. More.").when(k == 1, " see control 4.2 which holds! Yes").when(k == 2, " 3.1").when(k == 3, " Control ID: AB-12 is run daily? Yes").when(k == 4, F.concat(F.lit(" CC1.1 "), F.repeat(F.lit("word "), F.lit(60)), F.lit("."))).otherwise("")
    return docs(spark, d).select("doc_id", T.id_snippet(F.concat("text", more)).alias("snippet"))


@query("f07_strip_line_markers", "select doc_id, line_no, ltrim(line) as line from v_lines")
def f07(spark, d):
    marked = F.concat(F.lit("║"), F.col("line_no").cast("string"), F.lit("║ "), "line", F.lit("║7║ "))
    return lines(spark, d).select("doc_id", "line_no", T.strip_line_markers(marked).alias("line")).withColumn("line", F.ltrim("line"))


@query("f21_collapse_blank_lines", "select doc_id, md5(regexp_replace(replace(text, chr(10), repeat(chr(10), 2 + doc_id % 5)), '\\n{4,}', repeat(chr(10), 3), 'g')) as hash from v_docs")
def f21(spark, d):
    spaced = F.replace(F.col("text"), F.lit("\n"), F.repeat(F.lit("\n"), (F.col("doc_id") % 5 + 2).cast("int")))
    return docs(spark, d).select("doc_id", F.md5(T.collapse_blank_lines(spaced)).alias("hash"))


@query("f26_section_topic", "select doc_id, line_no, case when contains(lower(line), 'auditor') and contains(lower(line), 'report') then 'Service_Auditor_Report' when contains(lower(line), 'management') and (contains(lower(line), 'assertion') or contains(lower(line), 'statement')) then 'Management_Assertion' when contains(lower(line), 'description') and contains(lower(line), 'system') then 'Description_of_System' when contains(lower(line), 'control') then 'Control_Descriptions' else 'Unknown' end as topic from v_lines")
def f26(spark, d):
    return lines(spark, d).select("doc_id", "line_no", T.section_topic(F.col("line")).alias("topic"))


@query("f29_explicit_criteria", "select doc_id, array_to_string(regexp_extract_all(text || ' CC' || (doc_id % 9)::varchar || '.1', '\\b(CC\\d\\.\\d{1,2}|[AC]\\d\\.\\d|PI\\d\\.\\d)\\b', 1), ',') as ids from v_docs")
def f29(spark, d):
    text = F.concat(F.col("text"), F.lit(" CC"), (F.col("doc_id") % 9).cast("string"), F.lit(".1"))
    return docs(spark, d).select("doc_id", F.array_join(T.explicit_criteria(text), ",").alias("ids"))


#: Pages and lines as the reports have them: every second document with a date on each page, every third signed.
STAMPED_PAGES = "select doc_id, page_no, case when doc_id % 2 = 0 then text || chr(10) || '01/02/2024.' else text end as text from v_pages"
STAMPED_LINES = "select doc_id, line_no, line from v_lines union all select doc_id, 1000000 + page_no, ' 01/02/2024. ' from v_pages union all select distinct doc_id, 0, 'DIGITALLY signed by A. Person' from v_lines where doc_id % 3 = 0"


def stamped_pages(spark, d):
    return view(spark, d, "v_pages").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n01/02/2024."))).otherwise(F.col("text")))


def stamped_lines(spark, d):
    own, pages = lines(spark, d), view(spark, d, "v_pages")
    dates = pages.select("doc_id", (F.col("page_no") + 1_000_000).alias("line_no"), F.lit(" 01/02/2024. ").alias("line"))
    signed = own.where("doc_id % 3 = 0").select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("line_no"), F.lit("DIGITALLY signed by A. Person").alias("line"))
    return own.unionByName(dates).unionByName(signed)


FREQUENT = rf"""with s as ({STAMPED_PAGES}), f as (
  select doc_id, page_no, unnest(list_distinct(list_transform(list_concat(list_concat(
    regexp_extract_all(text, '\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{{1,2}},\s+\d{{4}})\b'),
    regexp_extract_all(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+')),
    regexp_extract_all(text, '\b\d{{1,2}}:\d{{2}}(?::\d{{2}})?\s?(?:AM|PM|am|pm)?\b')), lambda x: trim(x)))) as s from s),
t as (select doc_id, count(distinct page_no) as pages from s group by 1)
select f.doc_id, s from f join t on t.doc_id = f.doc_id group by f.doc_id, s, pages having count(*) > 0.8 * pages"""  # fmt: skip


@query("p12_drop_watermark_lines", f"with q as ({FREQUENT}), l as ({STAMPED_LINES}) select doc_id, line_no from l where not regexp_matches(line, '(?i)digitally signed by') and not exists (select 1 from q where q.doc_id = l.doc_id and rtrim(trim(l.line), '.') in (q.s, rtrim(q.s, ',')))")
def p12(spark, d):
    return D.drop_watermark_lines(stamped_lines(spark, d), D.frequent_page_strings(stamped_pages(spark, d))).select("doc_id", "line_no")


@query("a13_frequent_page_strings", FREQUENT)
def a13(spark, d):
    return D.frequent_page_strings(stamped_pages(spark, d))


@query("p11_agreement_pages", """with p as (select doc_id, page_no, lower(text || case doc_id % 6 when 0 then ' Limits on Report Access and Distribution' when 1 then ' NOTICE: Confidential. Dissemination is prohibited.' when 2 then ' Notice: confidential' when 3 then ' provided AS IS at your sole risk; ownership: property of A' when 4 then ' solely for the benefit and use of B' else '' end) as t from v_pages)
select doc_id, page_no, contains(t, 'i agree') or contains(t, 'i do not agree') or contains(t, 'limits on report access and distribution') or contains(t, 'solely for the benefit and use of') or contains(t, 'not intended to be used by anyone other than')
  or (contains(t, 'notice') and contains(t, 'confidential'))::int + (contains(t, 'recipient agrees') and contains(t, 'report'))::int + (contains(t, 'ownership') and contains(t, 'property of'))::int + (contains(t, 'dissemination') and contains(t, 'prohibited'))::int + (contains(t, 'as is') and contains(t, 'sole risk'))::int >= 2 as agreement from p""")  # fmt: skip
def p11(spark, d):
    k = F.col("doc_id") % 6
    more = F.when(k == 0, " Limits on Report Access and Distribution").when(k == 1, " NOTICE: Confidential. Dissemination is prohibited.").when(k == 2, " Notice: confidential").when(k == 3, " provided AS IS at your sole risk; ownership: property of A").when(k == 4, " solely for the benefit and use of B").otherwise("")
    return view(spark, d, "v_pages").select("doc_id", "page_no", D.is_agreement_page(F.concat("text", more)).alias("agreement"))


@query("w17_skip_leading_agreements", """with f as (select doc_id, page_no, page_no <= 5 and (doc_id + page_no) % 3 <> 0 as flag from v_pages), g as (select *, min(flag::int) over (partition by doc_id order by page_no rows between unbounded preceding and current row) = 1 as lead_run, sum(flag::int) over (partition by doc_id) as n from f)
select doc_id, page_no from g where not (lead_run and n < 5)""")  # fmt: skip
def w17(spark, d):
    flag = (F.col("doc_id") + F.col("page_no")) % 3 != 0
    return D.skip_leading_agreements(view(spark, d, "v_pages"), flag).select("doc_id", "page_no")


@query("a22_same_response", "select doc_id, md5(line) as hash, string_agg(distinct line_no::varchar, ',' order by line_no::varchar) as ids from v_lines group by 1, 2")
def a22(spark, d):
    rows = lines(spark, d).withColumn("line_no", F.col("line_no").cast("string"))
    return D.group_same_response(rows)


@query("w20_tail_lines", "select doc_id, line_no from (select doc_id, line_no, row_number() over (partition by doc_id order by line_no desc) as r from v_lines) where r <= 5")
def w20(spark, d):
    return D.tail_lines(lines(spark, d), 5).select("doc_id", "line_no")


@query("x04_find_occurrences", "with p as (select doc_id, text, unnest(range(1, length(text) + 1)) as pos from v_docs where contains(lower(text), 'licen')), h as (select * from p where substr(lower(text), pos, 5) = 'licen') select doc_id, pos, count(*) over (partition by doc_id) > 3 as many, md5(substr(text, greatest(pos - 40, 1), pos - greatest(pos - 40, 1) + 45)) as hash from h")
def x04(spark, d):
    return D.find_occurrences(docs(spark, d), "Licen", 40).select("doc_id", "pos", "many", F.md5("context").alias("hash"))


FIRM_TEXT = "text || case doc_id % 7 when 0 then ' Apache''s notice' when 1 then ' BDO’s view and KPMG' when 2 then ' audited by kpmg llp' when 3 then ' by rsm.' when 4 then ' Crsmx and Crowe' when 5 then ' Deloitte; Grant Thornton LLP' else '' end"


def with_firms(spark, d):
    k = F.col("doc_id") % 7
    more = F.when(k == 0, " Apache's notice").when(k == 1, " BDO’s view and KPMG").when(k == 2, " audited by kpmg llp").when(k == 3, " by rsm.").when(k == 4, " Crsmx and Crowe").when(k == 5, " Deloitte; Grant Thornton LLP").otherwise("")
    return docs(spark, d).withColumn("text", F.concat("text", more))


FIRMS = [(0, "Apache", "Apache Foundation"), (1, "MIT", "MIT Press"), (2, "GNU", "GNU Project"), (3, "BDO", "BDO USA LLP"), (4, "KPMG", "KPMG LLP"), (5, "K.P.M.G.", "KPMG LLP")]


@query("j20_match_known_firms", f"""with f(pos, short, legal) as (values (0, 'apache', 'Apache Foundation'), (1, 'mit', 'MIT Press'), (2, 'gnu', 'GNU Project'), (3, 'bdo', 'BDO USA LLP'), (4, 'kpmg', 'KPMG LLP'), (5, 'k.p.m.g.', 'KPMG LLP')),
t as (select doc_id, lower({FIRM_TEXT}) as t from v_docs),
h as (select doc_id, legal, pos, (length(t) - length(replace(t, short, ''))) // length(short) + (length(t) - length(replace(t, short || '''s', ''))) // (length(short) + 2) + (length(t) - length(replace(t, short || '’s', ''))) // (length(short) + 2) as n from t, f where contains(t, short)),
g as (select doc_id, legal, sum(n)::bigint as n, min(pos) as pos from h group by 1, 2)
select doc_id, legal as firm, n from (select *, row_number() over (partition by doc_id order by n desc, pos) as r from g) where r = 1""")  # fmt: skip
def j20(spark, d):
    return N.match_known_firms(with_firms(spark, d), spark.createDataFrame(FIRMS, "pos int, short string, legal string"))


@query("f53_known_firm", rf"""with f(pos, name, short) as (values (0, 'BDO USA, P.C.', false), (1, 'BDO USA', false), (2, 'KPMG LLP', false), (3, 'Deloitte & Touche LLP', false), (4, 'PricewaterhouseCoopers', false), (5, 'Ernst & Young LLP', false), (6, 'Grant Thornton LLP', false),
(7, 'RSM US LLP', false), (8, 'Crowe LLP', false), (9, 'Moss Adams LLP', false), (10, 'CliftonLarsonAllen LLP', false), (11, 'Schellman & Company, LLC', false), (12, 'KPMG', false), (13, 'Deloitte', false), (14, 'PwC', true), (15, 'BDO', true), (16, 'Grant Thornton', false),
(17, 'RSM', true), (18, 'Crowe', false), (19, 'Moss Adams', false), (20, 'CliftonLarsonAllen', false), (21, 'Schellman', false)), t as (select doc_id, {FIRM_TEXT} as t from v_docs)
select t.doc_id, h.firm from t left join (select doc_id, arg_min(name, pos) as firm from t, f where case when short then regexp_matches(t, '(?i)\b' || name || '\b') else contains(lower(t), lower(name)) end group by 1) h using (doc_id)""")  # fmt: skip
def f53(spark, d):
    return with_firms(spark, d).select("doc_id", D.known_firm(F.col("text")).alias("firm"))


@query("x05_split_combined", """with s as (select doc_id, line_no, case when line_no % 3 = 1 then 'id' else 'body' end as kind, line from v_lines), r as (select *, sum((kind = 'id')::int) over (partition by doc_id order by line_no rows between unbounded preceding and current row)::bigint as record from s)
select doc_id, record, max(line) filter (kind = 'id') as id_text, coalesce(string_agg(line, chr(10) order by line_no) filter (kind <> 'id'), '') as body from r group by 1, 2""")  # fmt: skip
def x05(spark, d):
    seg = lines(spark, d).select("doc_id", F.col("line_no").alias("pos"), F.when(F.col("line_no") % 3 == 1, "id").otherwise("body").alias("kind"), F.col("line").alias("body"))
    return D.split_combined(seg)
