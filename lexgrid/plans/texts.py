"""Queries over identifiers, texts, markup, files and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.functions import dates, ids
from lexgrid.functions import text as T
from lexgrid.operators import classify as P
from lexgrid.operators import documents as D
from lexgrid.operators import tables as O
from lexgrid.plans.registry import Tables, query
from lexgrid.runtime import shared_dir
from lexgrid.sources import files, sinks, xml


def scratch(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/lexgrid-{name}-{uuid.uuid4().hex}"


def values(t: Tables, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


NATION = "select n_nationkey as key, n_name as name, n_regionkey as region from nation"


@query("s1_csv_scan", "select n_nationkey as key, case when n_regionkey = 1 then null else n_name end as name, n_regionkey as region from nation", tables=False)
def csv_scan(t: Tables) -> DataFrame:
    path = scratch(t, "s1")
    name = F.when(F.col("n_regionkey") == 1, F.element_at(F.array(*map(F.lit, ["NA", "N/A", "null", ""])), F.col("n_nationkey") % 4 + 1)).otherwise(F.col("n_name"))
    sinks.write_csv(t.nation.select(F.col("n_nationkey").alias("key"), name.alias("name"), F.col("n_regionkey").alias("region")), path)
    return files.csv(t.spark, path, "key int, name string, region int")


@query("s2_csv_separator", NATION, tables=False)
def csv_separator(t: Tables) -> DataFrame:
    path = scratch(t, "s2")
    line = F.concat(F.col("n_nationkey"), F.lit("|  '"), "n_name", F.lit("'|  "), "n_regionkey")
    t.nation.select(line.alias("value")).unionByName(values(t, [("key|name|region",)], "value string")).coalesce(1).orderBy(F.desc(F.col("value").startswith("key"))).write.text(path)
    return files.csv(t.spark, path, "key int, name string, region int", sep="|", quote="'", trim=True)


@query("s3_csv_comments", NATION, tables=False)
def csv_comments(t: Tables) -> DataFrame:
    """Rest of a line after the comment character is cut, as pandas does; Spark's option drops whole lines only."""
    path = scratch(t, "s3")
    t.nation.select(F.concat_ws(",", "n_nationkey", "n_name", F.concat("n_regionkey", F.lit(" / note"))).alias("v")).unionByName(values(t, [("/ head",)], "v string")).write.text(path)
    rows = files.csv_cut_comments(t.spark, path, ["key", "name", "region"])
    return rows.select(F.col("key").cast("int").alias("key"), "name", F.col("region").cast("int").alias("region"))


@query("s4_label_file", "select * from (values ('ABROGATES', 0), ('AMENDS', 1), ('CITES', 2), ('INTRODUCES', 3)) v(reference, label)", tables=False)
def label_file(t: Tables) -> DataFrame:
    path = scratch(t, "s4")
    values(t, [("label;RefType",), *((f"{n};{name}",) for name, n in ids.LABELS.items())], "value string").coalesce(1).write.text(path)
    return files.csv(t.spark, path, "label int, reference string", sep=";").where("label is not null")


@query("s5_dict_rows", "select n_name as name, cast(n_regionkey as varchar) as region from nation", tables=False)
def dict_rows(t: Tables) -> DataFrame:
    path = scratch(t, "s5")
    lines = ['"""', "name , region", *(f"{r.n_name},{r.n_regionkey}" for r in t.nation.orderBy("n_nationkey").collect())]  # 25 rows
    values(t, [(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return files.dict_rows(t.spark, path, ["name", "region"])


@query("s6_field_repair", "select n_nationkey as key, n_name || '|' || n_regionkey as fields from nation", tables=False)
def field_repair(t: Tables) -> DataFrame:
    raw = F.concat(F.lit(' "'), "n_name", F.lit('" ,, "'), "n_regionkey", F.lit('", '))
    return files.repaired_fields(t.nation.select(F.col("n_nationkey").alias("key"), raw.alias("value"))).select("key", F.array_join("fields", "|").alias("fields"))


@query("s7_record_repair", "with s as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as segment from conversations) select conv_id, cast(segment as bigint) as segment, string_agg(case when role = 'user' then '\"https://u' else role end, ' ' order by turn) as value from s where segment > 0 group by 1, 2", tables=False)
def record_repair(t: Tables) -> DataFrame:
    lines = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", '"https://u').otherwise(F.col("role")).alias("value"))
    return files.repaired_records(lines, "conv_id", "turn")


@query("s8_json_documents", "select doc_id || '.json' as name, lang as category, n_chars from documents", tables=False)
def json_documents(t: Tables) -> DataFrame:
    """Documents as nested JSON records, with the category from the folder they lie in (S9's mirrored tree)."""
    path = scratch(t, "s8")
    section = F.array(F.struct(F.lit("m").alias("marker_id"), F.lit("I").alias("marker"), F.lit("").alias("title"), F.col("text"), F.array(F.lit(1)).alias("fn_indexes")))
    docs = t.documents.select("lang", F.concat("doc_id", F.lit(".json")).alias("source_file"), section.alias("sections_list"))
    sinks.write_json(docs, path, ["lang"])
    read = t.spark.read.schema(files.FINAL).option("recursiveFileLookup", True).json(path).select("*", F.regexp_extract("_metadata.file_path", "lang=([a-z]+)", 1).alias("category"))
    return read.select(F.col("source_file").alias("name"), "category", F.aggregate("sections_list", F.lit(0).cast("long"), lambda a, s: a + F.length(s["text"])).alias("n_chars"))


@query("s10_text_files", "select count(*) as n_lines from nation", tables=False)
def text_files(t: Tables) -> DataFrame:
    path = scratch(t, "s10")
    t.nation.select("n_name").coalesce(1).write.text(path)
    return files.texts(t.spark, path).agg(F.sum(F.size(F.filter(F.split("text", "\n"), lambda x: x != ""))).alias("n_lines"))


@query("s11_flatten_nested", "select n_name as name, n_regionkey as region from nation", tables=False)
def flatten_nested(t: Tables) -> DataFrame:
    return files.flatten(t.nation.select(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("a")), "a")


def _tree(t: Tables) -> DataFrame:
    """Conversations as page trees: a page of four turns, a block a turn, a line with two spans."""
    c = t.conversations.select("conv_id", "turn", "role", "text")
    span = lambda text, font, raised: F.struct(F.concat_ws(".", F.concat(F.lit("page-"), F.floor(F.col("turn") / 4)), F.concat(F.lit("block-"), F.col("turn") % 4), F.lit("line-0"), F.concat(F.lit("span-"), F.lit(0 if raised else 1))).alias("hierarchical_id"), text.alias("text"), F.lit(font).alias("font"), F.lit(10.0).alias("size"), F.lit(1 if raised else 0).alias("flags"), F.array(F.lit(0.0), F.lit(200.0), F.lit(1.0), F.lit(1.0)).alias("bbox"), F.lit(None).cast("boolean").alias("is_superscript"))
    line = F.struct(F.lit("l").alias("hierarchical_id"), F.array(F.lit(0.0)).alias("bbox"), F.array(span(F.col("role"), "Times-Bold", True), span(F.col("text"), "Times", False)).alias("spans"))
    block = F.struct(F.lit("b").alias("hierarchical_id"), F.array(F.lit(0.0), F.lit(200.0)).alias("bbox"), F.array(line).alias("lines"))
    rows = c.select("conv_id", F.floor(F.col("turn") / 4).cast("int").alias("page"), "turn", block.alias("b")).groupBy("conv_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "b"))), lambda x: x["b"]).alias("blocks"))
    page = F.struct(F.col("page").alias("page_number"), F.lit("p").alias("hierarchical_id"), "blocks")
    return rows.groupBy(F.col("conv_id").alias("doc")).agg(F.array_sort(F.collect_list(page)).alias("pages"))


TREE = "with b as (select conv_id, cast(floor(turn / 4) as integer) as page, turn, role, text from conversations) "


@query("s12_page_tree_spans", TREE + "select conv_id as doc, count(*) * 2 as n_spans, count(distinct page) as n_pages, cast(sum(length(role) + length(text)) as bigint) as n_characters from b group by 1", tables=False)
def page_tree(t: Tables) -> DataFrame:
    flat = D.spans(_tree(t))
    return flat.groupBy("doc").agg(F.count("*").alias("n_spans"), F.countDistinct("page").alias("n_pages"), F.sum(F.length("text")).alias("n_characters"))


@query("s13_page_text", TREE + ", p as (select conv_id, page, string_agg(role || ' ' || text, ' ' order by turn) as text from b group by 1, 2) select conv_id as doc, md5(string_agg(text, chr(10) || 'page_break' || chr(10) order by page)) as digest from p group by 1", tables=False)
def page_text(t: Tables) -> DataFrame:
    return files.page_text(D.spans(_tree(t))).select("doc", F.md5("text").alias("digest"))


@query("s14_page_blocks", TREE + "select conv_id as doc, count(*) as n_blocks from b group by 1", tables=False)
def page_blocks(t: Tables) -> DataFrame:
    return files.page_blocks(D.spans(_tree(t))).groupBy("doc").agg(F.count("*").alias("n_blocks"))


@query("s15_page_counts", TREE + "select conv_id as doc, count(distinct page) as n_pages from b group by 1", tables=False)
def page_counts(t: Tables) -> DataFrame:
    return files.page_counts(D.spans(_tree(t))).select("doc", F.col("n_pages").cast("long").alias("n_pages"))


@query("s18_hrefs", "with h as (select page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) as l from pages) select page_id, unnest(l) as href, unnest(range(len(l))) as place from h", tables=False)
def hrefs(t: Tables) -> DataFrame:
    return files.hrefs(t.pages, "html", "page_id").select("page_id", F.col("place").cast("long").alias("place"), "href")


@query("s19_sparql_bindings", "select n_name as act, case when n_regionkey = 0 then null else cast(n_regionkey as varchar) end as title from nation", tables=False)
def bindings(t: Tables) -> DataFrame:
    path = scratch(t, "s19")
    one = F.to_json(F.struct(F.struct(F.col("n_name").alias("value")).alias("act"), F.when(F.col("n_regionkey") != 0, F.struct(F.col("n_regionkey").cast("string").alias("value"))).alias("title")))
    t.nation.agg(F.concat(F.lit('{"results":{"bindings":['), F.array_join(F.collect_list(one), ","), F.lit("]}}")).alias("value")).write.text(path)  # 25 rows
    return files.bindings(t.spark, path, ["act", "title"])


@query("s20_search_hits", "select n_name as id, n_regionkey as region from nation", tables=False)
def search_hits(t: Tables) -> DataFrame:
    path = scratch(t, "s20")
    one = F.to_json(F.struct(F.col("n_name").alias("_id"), F.lit(1.0).alias("_score"), F.struct(F.col("n_regionkey").alias("region")).alias("_source")))
    t.nation.agg(F.concat(F.lit('{"hits":{"hits":['), F.array_join(F.collect_list(one), ","), F.lit("]}}")).alias("value")).write.text(path)  # 25 rows
    return files.search_hits(t.spark, path, "region int").select(F.col("_id").alias("id"), "region")


@query("s22_html_element", "select page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as text from pages", tables=False)
def html_element(t: Tables) -> DataFrame:
    return files.element(t.pages, "html", "h1").select("page_id", "text")


@query("k7_json_round_trip", NATION, tables=False)
def json_round_trip(t: Tables) -> DataFrame:
    path = scratch(t, "k7")
    sinks.write_json(t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), path)
    return t.spark.read.schema("key int, name string, region int").json(path)


@query("k8_csv_round_trip", NATION, tables=False)
def csv_round_trip(t: Tables) -> DataFrame:
    path = scratch(t, "k8")
    sinks.write_csv(t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), path)
    return files.csv(t.spark, path, "key int, name string, region int")


@query("k9_markdown", "select conv_id as doc, string_agg(case when role = 'user' then '# ' else '' end || role, chr(10) || chr(10) order by turn) as text from conversations group by 1", tables=False)
def markdown(t: Tables) -> DataFrame:
    flat = t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("seq"), F.col("role").alias("text"), F.when(F.col("role") == "user", 15.0).otherwise(10.0).alias("size"), F.lit(False).alias("bold"))
    return sinks.markdown_lines(flat)


@query("k10_snapshots", "select 'b' as run, count(*) as n from region", tables=False)
def snapshots(t: Tables) -> DataFrame:
    store = sinks.SnapshotStore(t.spark, scratch(t, "k10"))
    store.save("a", {"x": t.nation})
    store.save("b", {"x": t.region})
    return store.load("x").agg(F.lit(store.runs()[-1]["run"]).alias("run"), F.count("*").alias("n"))


@query("k11_report", "select 'Nations' || chr(10) || '=======' || chr(10) || 'n' || chr(10) || count(*) as text from nation", tables=False)
def report(t: Tables) -> DataFrame:
    return values(t, [(sinks.report("Nations", t.nation.agg(F.count("*").alias("n"))),)], "text string")


CODES = [("a FF 2023 1; 2023 22; RU 1999 3 and RS 0.101.2.",), ("RU 2001 15; 2002 7 x FF 1998 12",), ("nothing RS 12",), ("XFF 2023 1 FF 20 1",)]


@query("f5_reference_codes", "select * from (values (0, 'FF 2023 1|FF 2023 22|RS 0.101.2|RU 1999 3'), (1, 'FF 1998 12|RU 2001 15|RU 2002 7'), (2, 'RS 12'), (3, '')) v(k, codes)", tables=False)
def reference_codes(t: Tables) -> DataFrame:
    return values(t, [(i, c) for i, (c,) in enumerate(CODES)], "k int, s string").select("k", F.array_join(ids.codes(F.col("s")), "|").alias("codes"))


@query("f8_file_codes", "select n_nationkey as k, case when n_regionkey = 0 then 'FF' else 'RU' end || ' ' || (2000 + n_nationkey) || ' ' || (n_nationkey * 7) as code from nation", tables=False)
def file_codes(t: Tables) -> DataFrame:
    many = F.when(F.col("n_nationkey") % 2 == 0, F.lit("12_34_")).otherwise(F.lit(""))
    name = F.concat(F.lit("act-"), 2000 + F.col("n_nationkey"), F.lit("-"), many, F.col("n_nationkey") * 7, F.lit(".pdf"))
    category = F.when(F.col("n_regionkey") == 0, "Concessioni").otherwise("Leggi")
    return t.nation.select(F.col("n_nationkey").alias("k"), ids.file_code(name, category, ["concessioni"]).alias("code"))


URIS = [("/oc/1974/2151_2151_2151", "RU 1974 2151"), ("/oc/2006/596", "RU 2006 596"), ("/oc/1995/3950_3950_3950", "RU 1995 3950"), ("/oc/1/116_97_116", "RU 1 116"), ("/oc/XII/1__", "RU XII 1"), ("/oc/1950/__630", "RU 1950 630"), ("/oc/1950/__", "RU 1950 UNKNOWN_PAGE"), ("bad.uri", "UNKNOWN_URI_FORMAT"), ("/oc/2020/1_2_3", "RU 2020 3")]


@query("f9_uri_grammar", "select * from (values " + ", ".join(f"('{u}', '{c}')" for u, c in URIS) + ") v(uri, code)", tables=False)
def uri_grammar(t: Tables) -> DataFrame:
    return values(t, [(u,) for u, _ in URIS], "uri string").select("uri", ids.act_code(F.col("uri")).alias("code"))


@query("f10_roman", "select * from (values ('XIV', 14), ('MCMXCIX', 1999), ('IZ', null), ('lxxxix', 89)) v(roman, value)", tables=False)
def roman(t: Tables) -> DataFrame:
    return values(t, [("XIV",), ("MCMXCIX",), ("IZ",), ("lxxxix",)], "roman string").select("roman", ids.roman_value(F.col("roman")).alias("value"))


@query("f11_small_roman", "select * from (values ('XIV', true), ('', true), ('C', false), ('LXXXIX', true)) v(roman, fits)", tables=False)
def small_roman(t: Tables) -> DataFrame:
    return values(t, [("XIV",), ("",), ("C",), ("LXXXIX",)], "roman string").select("roman", ids.is_small_roman(F.col("roman")).alias("fits"))


@query("f12_safe_names", "select p_partkey as part, regexp_replace(p_name, '\\s+', '_', 'g') as name from part", tables=False)
def safe_names(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("part"), ids.safe_name(F.concat(F.lit(":"), "p_name", F.lit("?"))).alias("name"))


MONTHS = ", ".join(f"'{m}'" for m in dates.MONTHS_IT)


@query("f13_italian_dates", f"select o_orderkey as law, day(o_orderdate) || ' ' || [{MONTHS}][month(o_orderdate)] || ' ' || year(o_orderdate) as d from orders", tables=False)
def italian_dates(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("law"), dates.italian(F.col("o_orderdate").cast("date")).alias("d"))


@query("f14_year_coalesce", "select o_orderkey as law, year(coalesce(case when o_orderkey % 2 = 0 then o_orderdate end, timestamp '2000-01-01')) as y from orders", tables=False)
def year_coalesce(t: Tables) -> DataFrame:
    d = F.coalesce(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")), F.lit("2000-01-01").cast("timestamp_ntz"))
    return t.orders.select(F.col("o_orderkey").alias("law"), F.year(d).cast("long").alias("y"))


@query("f15_context_window", "select doc_id, trim(substring(text, cast(greatest(strpos(text, 'the') - 100, 1) as bigint), strpos(text, 'the') - cast(greatest(strpos(text, 'the') - 100, 1) as bigint) + 103)) as around from documents where strpos(text, 'the') > 0", tables=False)
def context_window(t: Tables) -> DataFrame:
    return t.documents.where(F.contains("text", F.lit("the"))).select("doc_id", T.context(F.col("text"), F.lit("the")).alias("around"))


@query("f16_hierarchical_ids", "select * from (values ('page-0.block-5.line-1.span-0', 0, 5, 1, 0), ('page-12.block-3.line-0.span-7', 12, 3, 0, 7)) v(id, page, block, line, span)", tables=False)
def hierarchical(t: Tables) -> DataFrame:
    place = ids.place(F.col("id"))
    return values(t, [("page-0.block-5.line-1.span-0",), ("page-12.block-3.line-0.span-7",)], "id string").select("id", *[place[k].alias(k) for k in ("page", "block", "line", "span")])


@query("f17_superscripts", "select c_custkey as customer, cast(c_custkey as varchar) as digits from customer", tables=False)
def superscripts(t: Tables) -> DataFrame:
    raised = F.translate(F.col("c_custkey").cast("string"), T.DIGITS, T.SUPERSCRIPTS)
    return t.customer.select(F.col("c_custkey").alias("customer"), T.superscripts(raised).alias("digits"))


@query("f1_collapse", r"select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as digest from documents", tables=False)
def collapse(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.collapse(F.col("text"))).alias("digest"))


@query("f2_split_join", "select page_id, array_to_string(string_split(url, '/')[3:], '/') as path, string_split(url, '/')[-1] as tail from pages", tables=False)
def split_join(t: Tables) -> DataFrame:
    parts = F.split("url", "/")
    return t.pages.select("page_id", F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "/").alias("path"), F.element_at(parts, -1).alias("tail"))


@query("f3_string_tests", "select page_id, starts_with(url, 'https') as secure, ends_with(url, 'html') as is_html, contains(url, 'example') as example, upper(url) as upper_url from pages", tables=False)
def string_tests(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", u.startswith("https").alias("secure"), u.endswith("html").alias("is_html"), u.contains("example").alias("example"), F.upper(u).alias("upper_url"))


@query("f4_regex", "select doc_id, len(regexp_extract_all(text, '[0-9]+')) as n_numbers, md5(regexp_replace(text, '[0-9]+', '#', 'g')) as digest from documents", tables=False)
def regex(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).cast("long").alias("n_numbers"), F.md5(F.regexp_replace("text", "[0-9]+", "#")).alias("digest"))


@query("f18_word_lengths", r"with m as (select doc_id, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda x: cast(length(x) as double)) as l from documents) select doc_id, round(list_avg(l), 9) as mean, list_median(l) as middle, round(case when len(l) < 2 then 0 else list_stddev_samp(l) end, 7) as std from m", tables=False)
def word_lengths(t: Tables) -> DataFrame:
    lengths = F.transform(T.words(F.col("text")), lambda x: F.length(x).cast("double"))
    return t.documents.withColumn("l", lengths).select("doc_id", F.round(T.mean(F.col("l")), 9).alias("mean"), T.median(F.col("l")).alias("middle"), F.round(T.deviation(F.col("l")), 7).alias("std"))


@query("f19_type_token_ratio", r"with m as (select doc_id, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda x: lower(x)) as w from documents) select doc_id, round(case when len(w) = 0 then 0 else len(list_distinct(w)) / cast(len(w) as double) end, 9) as ttr from m", tables=False)
def ratio(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(T.type_token_ratio(T.words(F.col("text"))), 9).alias("ttr"))


READ = r"with m as (select doc_id, lang, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as w, cast(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '')) as double) as s from documents), k as (select doc_id, lang, cast(length(text) as double) as chars, cast(len(w) as double) as n, s, coalesce(list_sum(list_transform(w, lambda x: cast(length(x) as double))), 0) as solid from m) "


def _sizes(t: Tables) -> DataFrame:
    w = T.words(F.col("text"))
    return t.documents.withColumn("w", w).select("doc_id", F.length("text").cast("double").alias("chars"), F.size("w").cast("double").alias("n"), F.size(T.sentences(F.col("text"))).cast("double").alias("s"), F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)).cast("double").alias("solid"))


@query("f20_gulpease", READ + "select doc_id, round(case when n = 0 or s = 0 then 0 else 89.0::double + (300.0::double * s - 10.0::double * chars) / n end, 7) as score from k", tables=False)
def gulpease(t: Tables) -> DataFrame:
    return _sizes(t).select("doc_id", F.round(T.gulpease(F.col("chars"), F.col("n"), F.col("s")), 7).alias("score"))


@query("f21_readability", READ + "select doc_id, round(case when n = 0 or s = 0 then 0 else 207.0::double - 1.015::double * (n / s) - 73.6::double * (solid / n) end, 7) as fr, round(case when n = 0 or s = 0 then 0 else 180.0::double - n / s - 58.5::double * (solid / n) end, 7) as de from k", tables=False)
def readability(t: Tables) -> DataFrame:
    c = F.col("solid"), F.col("n"), F.col("s")
    return _sizes(t).select("doc_id", F.round(T.readability_fr(*c), 7).alias("fr"), F.round(T.readability_de(*c), 7).alias("de"))


@query("f24_scaling", "select p_partkey as part, round(ln(1 + p_size), 9) as lg, round(sqrt((p_size - min(p_size) over ()) / cast(max(p_size) over () - min(p_size) over () as double)), 9) as scaled from part", tables=False)
def scaling(t: Tables) -> DataFrame:
    limits = F.broadcast(t.part.agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi")))  # one row
    return t.part.join(limits).select(F.col("p_partkey").alias("part"), F.round(F.log1p("p_size"), 9).alias("lg"), F.round(F.sqrt((F.col("p_size") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 9).alias("scaled"))


@query("f25_sigmoid_argmax", "select vec_id, round(1 / (1 + exp(-cast(embedding[1] as double))), 7) as p, list_position(embedding, list_max(embedding)) - 1 as best from embeddings", tables=False)
def sigmoid_argmax(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(T.sigmoid(F.get("embedding", F.lit(0)).cast("double")), 7).alias("p"), T.argmax(F.col("embedding")).cast("int").alias("best"))


@query("f28_keywords", r"select doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '[\"''“”’]', '', 'g'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda w: regexp_full_match(w, '\p{L}{2,}') and w not in ('the', 'and', 'of')), ' ') as words from documents", tables=False)
def keywords(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(T.keywords(F.col("text"), ["the", "and", "of"]), " ").alias("words"))


@query("f29_word_frequencies", r"select lang, word, count(*) as n from (select lang, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) as word from documents) where word not in ('the', 'of', 'der') group by 1, 2", tables=False)
def word_frequencies(t: Tables) -> DataFrame:
    from lexgrid.operators.corpus import word_frequencies as count

    return count(t.documents, "lang", "text", values(t, [("the",), ("of",), ("der",)], "word string"))


@query("f30_mmr")
def mmr(t: Tables) -> DataFrame:
    return O.mmr(t.embeddings, [1.0] * 8 + [0.0] * 56)


@query("f33_token_limit", r"select doc_id from documents where len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 512", tables=False)
def token_limit(t: Tables) -> DataFrame:
    return t.documents.where(F.size(T.words(F.col("text"))) <= 512).select("doc_id")


@query("f34_percent", "select n_nationkey as k, case when n_regionkey > 0 then printf('%.1f%%', 100.0::double * n_nationkey / n_regionkey) else 'N/A' end as share from nation", tables=False)
def percent(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("k"), T.percent(F.col("n_nationkey"), F.col("n_regionkey")).alias("share"))


@query("f35_heading_levels", "select p_partkey as part, case when p_size > 14 then 1 when p_size > 12 then 2 when p_partkey % 2 = 0 and p_name like 's%' then 3 when p_partkey % 2 = 0 then 4 else 0 end as level from part", tables=False)
def heading_levels(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("part"), T.heading_level(F.col("p_size"), F.col("p_partkey") % 2 == 0, F.col("p_name"), "s").alias("level"))


@query("f36_year_text", "select o_orderkey as law, substring(cast(cast(o_orderdate as date) as varchar), 1, 4) as y from orders", tables=False)
def year_text(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("law"), dates.year_text(F.col("o_orderdate").cast("date").cast("string")).alias("y"))


@query("t1_canonical_codes", "select n_nationkey as k, 'RU ' || n_nationkey as code from nation", tables=False)
def canonical_codes(t: Tables) -> DataFrame:
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("RU "), "n_nationkey")).otherwise(F.col("n_nationkey").cast("string"))
    return t.nation.select(F.col("n_nationkey").alias("k"), ids.canonical(F.lit("RU"), raw).alias("code"))


@query("d5_annex_ids", "select n_nationkey as k, case when n_nationkey % 2 = 0 then 'RU ' || n_nationkey || '_Allegato_1' end as annex, case when n_nationkey % 2 = 0 then 'RU ' || n_nationkey end as parent from nation", tables=False)
def annex_ids(t: Tables) -> DataFrame:
    file = F.concat(F.lit("RU "), "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "_Allegato_1").otherwise(""), F.lit(".json"))
    annex, parent = ids.annex(file)
    return t.nation.select(F.col("n_nationkey").alias("k"), annex.alias("annex"), parent.alias("parent"))


@query("x2_split_annex", "select doc_id, case when strpos(chr(10) || text, chr(10) || 'Of ') > 0 then true else false end as has_annex from documents", tables=False)
def split_annex(t: Tables) -> DataFrame:
    _, annex = D.split_annex(F.col("text"), "Of(?= )")
    return t.documents.select("doc_id", annex.isNotNull().alias("has_annex"))


def _class_sql() -> str:
    """Both cascades by counts of lines. The preamble is always the first two lines here."""
    n = lambda part, p: f"len(list_filter({part}, lambda x: regexp_matches(x, '{p}')))"
    counts = lambda part, k: f"regexp_matches(array_to_string({part}, chr(10)), '{D.MODIFIES}') as says{k}, {n(part, D.ROMAN_LINE)} as roman{k}, {n(part, D.ARTICLE_LINE)} as article{k}, {n(part, D.SECTION_LINE)} as section{k}, {n(part, D.LAW_LIST_LINE)} as laws{k}"
    amended = lambda k: f"when says{k} or (roman{k} > 0 and roman{k} >= article{k} and section{k} = 0) then 'Modification'"
    return f"""with t as (select doc_id, concat_ws(chr(10), 'Titolo', 'ordina:', case doc_id % 4 when 0 then 'Art. 1' when 1 then 'I' when 2 then 'La legge è modificata come segue:' end, text) as text from documents),
l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[3:] as body from t),
c as (select doc_id, {counts('body', '')}, {counts('body[:75]', '_early')} from l)
select doc_id, case {amended('')} when laws > 0 and section = 0 and article <= roman + laws then 'Modification'
 when section + article > 0 and (roman = 0 or article >= roman) and (laws = 0 or article >= laws) then 'Base' when roman > 0 then 'Modification' else 'Unknown' end as class,
 case {amended('_early')} when section_early + article_early > 0 and (roman_early = 0 or article_early >= roman_early) then 'Base' {amended('')} when section + article > 0 then 'Base' else 'Unknown' end as early_class from c"""


@query("x3_document_class", _class_sql(), tables=False)
def document_class(t: Tables) -> DataFrame:
    """Both rule sets over documents with headings put in."""
    i = F.col("doc_id") % 4
    text = F.concat_ws("\n", F.lit("Titolo"), F.lit("ordina:"), F.when(i == 0, "Art. 1").when(i == 1, "I").when(i == 2, "La legge è modificata come segue:"), F.col("text"))
    rows = D.document_classes(t.documents.select("doc_id", text.alias("text")))
    return D.document_classes(rows, whole=False, out="early_class").select("doc_id", "class", "early_class")


@query("x4_elements", TREE + "select conv_id as doc, count(*) as n from b where role <> '' group by 1", tables=False)
def elements(t: Tables) -> DataFrame:
    return D.elements(D.spans(_tree(t))).where("bold").groupBy("doc").agg(F.count("*").alias("n"))


@query("x7_sections", TREE + "select conv_id as doc, count(*) as n_spans from b group by 1", tables=False)
def sections(t: Tables) -> DataFrame:
    """Without marks a document is one section with all its text: as many role spans as turns."""
    flat = D.spans(_tree(t)).withColumn("text", F.when(F.col("span") == 1, "body").otherwise(F.col("text")))
    found = D.elements(flat)
    marks, refs = D.markers(found), D.references(flat, found)
    whole = D.sections(flat, marks, D.title(found).where("false"), refs)
    return whole.groupBy("doc").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\bbody\b"), F.lit(0)))).alias("n_spans"))


@query("x10_xml_sections", "select n_nationkey as k, 'a1' as id, 'Art. 1' as title, 'Art. 1' || chr(10) || chr(10) || n_name || ' end' as text, '/x' as refs from nation", tables=False)
def xml_sections(t: Tables) -> DataFrame:
    body = F.concat(F.lit('<akomaNtoso><body><level eId="a1"><num>Art. 1</num><p>'), F.regexp_replace("n_name", "&", ""), F.lit('<authorialNote><ref href="/x">x</ref></authorialNote> end</p></level></body></akomaNtoso>'))
    return xml.sections(t.nation.select(F.col("n_nationkey").alias("k"), body.alias("xml"))).select("k", F.explode("sections").alias("s")).select("k", "s.id", "s.title", "s.text", F.array_join("s.references", ",").alias("refs"))


@query("x11_xml_metadata", "select n_nationkey as k, '/oc/' || n_nationkey as law_url, case when n_regionkey = 0 then null else '2020-01-01' end as decision_date from nation", tables=False)
def xml_metadata(t: Tables) -> DataFrame:
    date = F.when(F.col("n_regionkey") != 0, '<FRBRdate date="2020-01-01"/>').otherwise("")
    source = F.concat(F.lit('<an:akn xmlns:an="urn:x"><an:meta><FRBRWork><FRBRuri value="/oc/'), "n_nationkey", F.lit('"/>'), date, F.lit("</FRBRWork></an:meta></an:akn>"))
    return xml.metadata(t.nation.select(F.col("n_nationkey").alias("k"), source.alias("xml"))).select("k", "law_url", "decision_date")


@query("f26_markup_text", "select n_nationkey as k, n_name || ' x' || chr(10) || chr(10) || 'end' as text from nation", tables=False)
def markup_text(t: Tables) -> DataFrame:
    source = F.concat(F.lit("<doc><p>"), "n_name", F.lit(" <b>x</b></p><authorialNote>n</authorialNote><p>end</p></doc>"))
    return xml.text(t.nation.select(F.col("n_nationkey").alias("k"), source.alias("xml"))).select("k", "text")


@query("x12_classified_edges", "select conv_id as doc, cast(turn as bigint) as turn, 'CITES' as label from conversations where not regexp_matches(lower(text), 'abrog|aufgehoben|modific|änder|modifi|introdo|eingefügt|introdui')", tables=False)
def classified(t: Tables) -> DataFrame:
    return P.predict(t.conversations.select(F.col("conv_id").alias("doc"), "turn", "text"), "text").where("label = 'CITES'").select("doc", "turn", "label")


@query("x13_quality_report", "select conv_id as doc, 'duplicate marker' as issue, count(*) as n from (select conv_id, role from conversations group by 1, 2 having count(*) > 1) group by 1", tables=False)
def quality_report(t: Tables) -> DataFrame:
    finals = t.conversations.select(F.col("conv_id").alias("doc"), F.col("role").alias("marker"), F.lit("t").alias("title"), F.concat(F.lit("x"), "text").alias("text"), F.array().cast("array<int>").alias("fn_indexes"))
    refs = t.conversations.select(F.col("conv_id").alias("doc"), F.lit("1").alias("fn_number"), F.lit("RU").alias("type"))
    return D.quality_report(finals, refs).where("issue = 'duplicate marker'")
