"""Queries over tables: sinks and upserts, joins, category analytics, windows, set operations, corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrid.functions import text as T
from lexgrid.graph import model as M
from lexgrid.operators import corpus as C
from lexgrid.operators import lifecycle as L
from lexgrid.operators import sequences as S
from lexgrid.operators import tables as O
from lexgrid.plans.registry import Tables, query
from lexgrid.runtime import parts
from lexgrid.streaming import streams


def _batches(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(new rows, existing rows) keyed by user: all events as upserts over the users of the first ones."""
    e = t.events.select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), F.col("event_id").alias("o"))
    return e, O.first_rows(e.where("o < 100"), ["k"], F.col("o")).select("k", F.concat(F.lit("old "), "v").alias("v"))


OLD = "with e as (select user_id as k, event_type as v, event_id as o from events), old as (select k, 'old ' || arg_min(v, o) as v from e where o < 100 group by k) "


@query("k2_first_write_wins", OLD + "select k, v from old union all select k, arg_min(v, o) from e where k not in (select k from old) group by k", tables=False)
def first_write(t: Tables) -> DataFrame:
    new, old = _batches(t)
    return M.first_wins(new, old, "k", "o")


@query("k3_last_write_wins", OLD + "select k, arg_max(v, o) as v from e group by k union all select k, v from old where k not in (select k from e)", tables=False)
def last_write(t: Tables) -> DataFrame:
    new, old = _batches(t)
    return M.last_wins(new, old, "k", "o")


@query("k4_edge_merge", "select distinct src, rel_type, dst from edges")
def edge_merge(t: Tables) -> DataFrame:
    e = t.edges.select("src", "rel_type", "dst")
    return M.merge_edges(e, e.where("rel_type = 'A'"))


@query("k5_update_existing", "select o.id as law, coalesce(c.v, o.validity) as validity from laws o left join (select user_id as k, any_value('updated') as v from events group by 1) c on o.id = c.k")
def update_existing(t: Tables) -> DataFrame:
    changes = t.events.select(F.col("user_id").alias("id"), F.lit("updated").alias("v")).distinct()
    return M.update_existing(t.laws.select("id", "validity"), changes, "id", {"validity": F.coalesce("c.v", "r.validity")}).withColumnRenamed("id", "law")


@query("k6_create_append", "select n_name as name, count(*) as n from (select n_name from nation union all select n_name from nation) group by 1", tables=False)
def append(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_name").alias("name"))
    return n.unionByName(n).groupBy("name").agg(F.count("*").alias("n"))


@query("p3_guarded_date", "select o_orderkey as law, cast(case when o_orderkey % 3 = 0 then null else cast(o_orderdate as date) end as varchar) as d from orders", tables=False)
def guarded_date(t: Tables) -> DataFrame:
    from lexgrid.functions import dates

    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    return t.orders.select(F.col("o_orderkey").alias("law"), dates.iso(raw).cast("string").alias("d"))


@query("p5_null_normalisation", "select n_nationkey as k, case when n_nationkey % 3 = 0 then null else n_name end as name from nation", tables=False)
def null_normalisation(t: Tables) -> DataFrame:
    raw = F.when(F.col("n_nationkey") % 3 == 0, F.element_at(F.array(F.lit(" "), F.lit("NaN"), F.lit('""')), (F.col("n_nationkey") / 3 % 3 + 1).cast("int"))).otherwise(F.concat(F.lit(' "'), "n_name", F.lit('" ')))
    return t.nation.select(F.col("n_nationkey").alias("k"), T.clean(raw, quotes=True).alias("name"))


@query("p6_null_keys", "select count(*) as n from events where value is not null", tables=False)
def null_keys(t: Tables) -> DataFrame:
    return t.events.where(F.col("value").isNotNull()).agg(F.count("*").alias("n"))


@query("p7_contains", "select p_partkey as part from part where regexp_matches(p_name, '.e') and p_brand is not null and p_size in (1, 5, 9)", tables=False)
def contains(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").rlike(".e") & F.col("p_brand").isNotNull() & F.col("p_size").isin(1, 5, 9)).select(F.col("p_partkey").alias("part"))


@query("p8_negated_word", r"select doc_id from documents where not coalesce(regexp_matches(text, '(?i)\b(the|der)\b'), false)", tables=False)
def negated_word(t: Tables) -> DataFrame:
    return t.documents.where(~F.coalesce(F.col("text").rlike(r"(?i)\b(the|der)\b"), F.lit(False))).select("doc_id")


@query("p9_last_path_part", r"select page_id, string_split(url, '/')[-1] as tail from pages where regexp_matches(string_split(url, '/')[-1], '^[a-z0-9_.-]+$')", tables=False)
def last_part(t: Tables) -> DataFrame:
    tail = F.element_at(F.split("url", "/"), -1)
    return t.pages.where(tail.rlike("^[a-z0-9_.-]+$")).select("page_id", tail.alias("tail"))


@query("p10_ends_with", "select page_id from pages where url like '%1'", tables=False)
def ends_with(t: Tables) -> DataFrame:
    return t.pages.where(F.col("url").endswith("1")).select("page_id")


@query("p13_label_whitelist", "select distinct event_type from events where upper(event_type) in ('ABROGATES', 'AMENDS', 'CITES', 'INTRODUCES', 'CLICK', 'VIEW')", tables=False)
def whitelist(t: Tables) -> DataFrame:
    return t.events.where(F.upper("event_type").isin("ABROGATES", "AMENDS", "CITES", "INTRODUCES", "CLICK", "VIEW")).select("event_type").distinct()


@query("p15_geometric", "select p_partkey as part from part where p_size > 5 and p_size < 45 and p_retailprice - 900 < 0.9 * 1000 and length(p_name) > 10 and abs(p_size - 20) < 10", tables=False)
def geometric(t: Tables) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    body = S.in_body(size, size, F.lit(50), F.lit(900.0), price, F.lit(1000.0), F.col("p_name"))
    return t.part.where(body & (F.abs(size - 20) < 10)).select(F.col("p_partkey").alias("part"))


def _refs(t: Tables) -> DataFrame:
    return t.references.groupBy("src_cat", "dst_cat").agg(F.count("*").alias("n"))


@query("p16_minimum_weight", ", top as (select src_cat from refs group by 1 order by sum(n) desc, 1 limit 5) select src_cat, dst_cat, n from refs where n >= 3 and src_cat in (from top)")
def minimum_weight(t: Tables) -> DataFrame:
    refs = _refs(t)
    best = O.top(refs.groupBy("src_cat").agg(F.sum("n").alias("s")), 5, F.desc("s"), F.col("src_cat"))
    return refs.where("n >= 3").join(best, "src_cat", "left_semi").select("src_cat", "dst_cat", "n")


@query("p17_folder_filter", "select doc_id from documents where contains(lower(source), 'src1')", tables=False)
def folder_filter(t: Tables) -> DataFrame:
    return t.documents.where(F.contains(F.lower("source"), F.lit("src1"))).select("doc_id")


@query("p18_valid_nodes", "select vec_id from embeddings where vec_id is not null and label is not null and not isnan(embedding[1])", tables=False)
def valid_nodes(t: Tables) -> DataFrame:
    return t.embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~F.isnan(F.get("embedding", F.lit(0)))).select("vec_id")


@query("j6_key_lookup", "select l_orderkey as law, l_linenumber as n, coalesce(p_name, 'part ' || l_partkey) as target, p_name is null as missing from lineitem left join (select * from part where p_size < 25) on l_partkey = p_partkey", tables=False)
def key_lookup(t: Tables) -> DataFrame:
    """Both modes: a miss keeps the original code, and is flagged."""
    dim = t.part.where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return t.lineitem.join(dim, "l_partkey", "left").select(F.col("l_orderkey").alias("law"), F.col("l_linenumber").alias("n"), F.coalesce("p_name", F.concat(F.lit("part "), "l_partkey")).alias("target"), F.col("p_name").isNull().alias("missing"))


@query("j7_group_index", "select c.conv_id, a.turn as note, count(*) as n from conversations a join conversations c on a.conv_id = c.conv_id and a.role = c.role group by 1, 2", tables=False)
def group_index(t: Tables) -> DataFrame:
    notes = t.conversations.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("turn", "role"))).alias("m")).select("conv_id", F.explode("m").alias("note", "role"))
    return notes.join(t.conversations.select("conv_id", "role"), ["conv_id", "role"]).groupBy("conv_id", "note").agg(F.count("*").alias("n"))


@query("j8_first_match", "select conv_id, role, min(turn) as turn from conversations group by all", tables=False)
def first_match(t: Tables) -> DataFrame:
    return O.first_rows(t.conversations.select("conv_id", "role", "turn"), ["conv_id", "role"], F.col("turn"))


@query("j10_first_row_lookup", "with f as (select o_custkey, arg_min(cast(o_orderdate as date), o_orderkey) as d from orders group by 1) select c_custkey as customer, cast(d as varchar) as d from customer left join f on c_custkey = o_custkey", tables=False)
def first_row_lookup(t: Tables) -> DataFrame:
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by(F.col("o_orderdate").cast("date"), "o_orderkey").cast("string").alias("d"))
    return t.customer.join(first, "c_custkey", "left").select(F.col("c_custkey").alias("customer"), "d")


@query("j11_anti_join", "select c_custkey as customer from customer where c_custkey not in (select o_custkey from orders)", tables=False)
def anti_join(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("customer")).join(t.orders.select(F.col("o_custkey").alias("customer")), "customer", "left_anti")


@query("j12_id_difference", "select p_partkey as part from part except select l_partkey from lineitem where l_quantity > 40", tables=False)
def id_difference(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("part")).subtract(t.lineitem.where("l_quantity > 40").select("l_partkey"))


@query("j13_category_precedence", "with a as (select o_orderkey as id, o_orderstatus as c from orders where o_orderkey % 2 = 0), b as (select o_orderkey as id, o_orderpriority as c from orders where o_orderkey % 3 = 0) select coalesce(a.id, b.id) as id, coalesce(a.c, b.c) as category, a.c <> b.c as differs from a full join b on a.id = b.id", tables=False)
def precedence(t: Tables) -> DataFrame:
    o = t.orders
    a = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("category"))
    b = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category"))
    best, other = O.category_map([a, b])
    both = a.select("id").join(b.select("id"), "id").withColumn("both", F.lit(True))
    return best.join(other.select("id", F.lit(True).alias("d")), "id", "left").join(both, "id", "left").select("id", "category", F.when(F.col("both"), F.coalesce("d", F.lit(False))).alias("differs"))


def _sections(t: Tables) -> DataFrame:
    return t.documents.select("lang", F.col("source").alias("folder"), F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("section_no", "text"))


SECTIONS = r"""
with s0 as (select lang, source as folder, doc_id as file, unnest(range(len(string_split(text, chr(10))))) as section_no, unnest(string_split(text, chr(10))) as text from documents),
m as (select *, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as w, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '')) as n_sentences from s0),
s as (select lang, folder, file, section_no, cast(len(w) as bigint) as n_words, n_sentences, cast(length(text) as bigint) as n_characters,
  list_avg(list_transform(w, lambda x: cast(length(x) as double))) as word_length, list_median(list_transform(w, lambda x: cast(length(x) as double))) as median_length,
  len(list_distinct(list_transform(w, lambda x: lower(x)))) as n_types,
  coalesce(list_sum(list_transform(w, lambda x: cast(length(x) as double))), 0) as solid, cast(length(text) as double) as chars from m),
r as (select *, case when n_words = 0 or n_sentences = 0 then 0.0::double
  when lang = 'fr' then 207.0::double - 1.015::double * (n_words / n_sentences::double) - 73.6::double * (solid / n_words)
  when lang = 'de' then 180.0::double - n_words / n_sentences::double - 58.5::double * (solid / n_words)
  else 89.0::double + (300.0::double * n_sentences - 10.0::double * chars) / n_words end as readability from s)
"""


@query("j14_language_match", "select cast(n_nationkey % 5 as integer) as key, count(distinct n_regionkey) as n from nation group by 1 having count(distinct n_regionkey) > 1", tables=False)
def language_match(t: Tables) -> DataFrame:
    """Files under folders that mean the same in several languages, over a folder map."""
    n = t.nation
    corpora = n.select(F.col("n_regionkey").cast("string").alias("lang"), F.col("n_name").alias("folder"), (F.col("n_nationkey") % 5).cast("string").alias("file"))
    folders = n.select(F.col("n_regionkey").cast("string").alias("lang"), F.col("n_name").alias("folder"), (F.col("n_nationkey") % 5).alias("key"))
    return C.match_languages(corpora, folders).select("key", F.size("by_lang").cast("long").alias("n"))


@query("j15_file_pairs", "select d.doc_id, b.item_id from documents d join benchmark b on d.doc_id = b.item_id", tables=False)
def file_pairs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.benchmark.select("item_id"), F.col("doc_id") == F.col("item_id"))


@query("j16_containment", "with s as (select conv_id, turn, length(text) as n, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as segment from conversations) select conv_id, cast(segment as bigint) as segment, count(*) as n_rows, cast(sum(n) as bigint) as n_characters from s group by 1, 2", tables=False)
def containment(t: Tables) -> DataFrame:
    marked = S.segments(t.conversations, "conv_id", "turn", F.col("role") == "user")
    return marked.groupBy("conv_id", "segment").agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_characters"))


@query("j17_nearest_before", "select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as label from conversations", tables=False)
def nearest_before(t: Tables) -> DataFrame:
    return S.nearest_before(t.conversations, ["conv_id"], "turn", F.col("role") == "user", F.col("turn"), "label").select("conv_id", "turn", "label")


@query("j18_nearest_after", "select conv_id, turn, first_value(case when role = 'assistant' then turn end ignore nulls) over (partition by conv_id order by turn rows between 1 following and unbounded following) as label from conversations", tables=False)
def nearest_after(t: Tables) -> DataFrame:
    return S.nearest_after(t.conversations, ["conv_id"], "turn", F.col("role") == "assistant", F.col("turn"), "label").select("conv_id", "turn", "label")


@query("a12_category_references", "select src_cat, dst_cat, n from refs")
def category_references(t: Tables) -> DataFrame:
    """Laws as customers' and suppliers' nations: each line item is a reference between two categories."""
    return _refs(t)


@query("a12_internal_external", "select src_cat, cast(sum(case when src_cat = dst_cat then n else 0 end) as bigint) as internal, cast(sum(case when src_cat <> dst_cat then n else 0 end) as bigint) as external from refs group by 1")
def internal_external(t: Tables) -> DataFrame:
    return O.category_metrics(_refs(t)).select("src_cat", "internal", "external")


@query("a13_unknown_targets", "select coalesce(p_brand, case when l_partkey % 2 = 0 then 'Unknown RU' else 'Unknown FF' end) as bucket, count(*) as n from lineitem left join (select * from part where p_size < 25) on l_partkey = p_partkey group by 1", tables=False)
def unknown_targets(t: Tables) -> DataFrame:
    dim = t.part.where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    code = F.concat(F.when(F.col("l_partkey") % 2 == 0, "RU ").otherwise("FF "), "l_partkey")
    return t.lineitem.join(dim, "l_partkey", "left").groupBy(O.unknown_target(F.col("p_brand"), code).alias("bucket")).agg(F.count("*").alias("n"))


@query("a14_key_metrics", ", b as (select src_cat, dst_cat, row_number() over (partition by src_cat order by n desc, dst_cat) as k from refs where src_cat <> dst_cat) select r.src_cat, cast(sum(n) as bigint) as total, round(100.0::double * sum(case when r.src_cat = r.dst_cat then n else 0 end) / sum(n), 6) as pct_internal, any_value(b.dst_cat) as top_external from refs r left join b on r.src_cat = b.src_cat and k = 1 group by 1")
def key_metrics(t: Tables) -> DataFrame:
    return O.category_metrics(_refs(t)).select("src_cat", "total", "pct_internal", "top_external")


@query("a15_describe", "select l_returnflag as flag, round(avg(l_quantity), 9) as mean, median(l_quantity) as median, round(stddev_samp(l_quantity), 9) as std, min(l_quantity) as least, max(l_quantity) as most from lineitem group by 1", tables=False)
def describe(t: Tables) -> DataFrame:
    return O.describe(t.lineitem.withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_quantity").select("flag", F.round("mean", 9).alias("mean"), "median", F.round("std", 9).alias("std"), "least", "most")


def _metrics(t: Tables) -> dict[str, DataFrame]:
    e = t.edges
    return {"in": e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("value")), "out": e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("value")), "targets": e.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("value"))}


RANKS = ", v as (select 'in' as m, dst as id, count(*) as value from edges group by 2 union all select 'out', src, count(*) from edges group by 2 union all select 'targets', src, count(distinct dst) from edges group by 2), k as (select m, id, value, row_number() over (partition by m order by value desc, id) as rank from v) "


@query("a16_rank_points", RANKS + "select id as law, cast(sum(11 - rank) as bigint) as points, count(*) as appearances from k where rank <= 10 group by 1")
def rank_points(t: Tables) -> DataFrame:
    return O.rank_points(_metrics(t)).withColumnRenamed("id", "law")


@query("w1_rank_in_metric", RANKS + "select m as metric, id as law, cast(rank as integer) as place from k where rank <= 10")
def rank_in_metric(t: Tables) -> DataFrame:
    every = None
    for name, df in _metrics(t).items():
        part = df.select(F.lit(name).alias("metric"), F.col("id").alias("law"), "value")
        every = part if every is None else every.unionByName(part)
    return O.top_per_group(every, ["metric"], 10, F.desc("value"), F.col("law")).select("metric", "law", F.col("rank").alias("place"))


@query("a17_language_averages", SECTIONS + "select lang, round(avg(n_characters / n_words), 6) as chars_per_word, round(avg(n_words / n_sentences), 6) as words_per_sentence from r where n_words > 0 and n_sentences > 0 group by 1", tables=False)
def language_averages(t: Tables) -> DataFrame:
    return C.strict_metrics(_sections(t)).groupBy("lang").agg(F.round(F.avg("chars_per_word"), 6).alias("chars_per_word"), F.round(F.avg("words_per_sentence"), 6).alias("words_per_sentence"))


@query(
    "a18_roll_up",
    SECTIONS
    + """, f as (select lang, folder, file, sum(n_words) as n_words, sum(n_sentences) as n_sentences, sum(n_types) as n_types, avg(word_length) as word_length, median(median_length) as median_length, avg(readability) as readability from r where n_words > 0 group by all),
d as (select lang, folder, null as file, sum(n_words) as n_words, sum(n_sentences) as n_sentences, sum(n_types) as n_types, avg(word_length) as word_length, median(median_length) as median_length, avg(readability) as readability from f group by lang, folder),
l as (select lang, null as folder, null as file, sum(n_words) as n_words, sum(n_sentences) as n_sentences, sum(n_types) as n_types, avg(word_length) as word_length, median(median_length) as median_length, avg(readability) as readability from d group by lang),
u as (select 3 as depth, lang, folder, cast(file as varchar) as file, n_words, n_sentences, n_types, word_length, median_length, readability from f union all select 2, lang, folder, null, n_words, n_sentences, n_types, word_length, median_length, readability from d union all select 1, lang, null, null, n_words, n_sentences, n_types, word_length, median_length, readability from l)
select depth, lang, folder, file, cast(n_words as bigint) as n_words, cast(n_sentences as bigint) as n_sentences, round(n_types / cast(n_words as double), 8) as ttr, round(word_length, 8) as word_length, median_length, round(readability, 6) as readability from u""",
    tables=False,
)
def roll_up(t: Tables) -> DataFrame:
    out = C.roll_up(C.section_metrics(_sections(t)), ["lang", "folder", "file"])
    return out.select("depth", "lang", "folder", "file", "n_words", "n_sentences", F.round("ttr", 8).alias("ttr"), F.round("word_length", 8).alias("word_length"), "median_length", F.round("readability", 6).alias("readability"))


@query("a19_map_sum", "select source as folder, lang, count(*) as n from documents group by all", tables=False)
def map_sum(t: Tables) -> DataFrame:
    one = t.documents.select(F.col("source").alias("folder"), F.create_map("lang", F.lit(1).cast("long")).alias("m"))
    return C.map_sum(one, ["folder"], "m").select("folder", F.explode("m").alias("lang", "n"))


@query("a20_warning_classes", "select case when value < 10 then 'low' when value < 50 then 'middle' else 'high' end as kind, count(*) as n from events group by 1", tables=False)
def warning_classes(t: Tables) -> DataFrame:
    kind = F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "middle").otherwise("high")
    return t.events.select(F.explode(F.array(kind)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


GOLD = "with g as (select distinct o_orderstatus as folder, l_orderkey as doc, l_partkey as item from lineitem join orders on l_orderkey = o_orderkey), f as (select distinct l_orderkey as doc, l_partkey as item from lineitem where l_quantity > 15), p as (select folder, g.doc, count(*) as n_golden, count(f.item) as n_found from g left join f on g.doc = f.doc and g.item = f.item group by 1, 2) "


def _pairs(t: Tables) -> DataFrame:
    items = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderstatus").alias("folder"), F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("item"), "l_quantity")
    return C.overlap(items, items.where("l_quantity > 15"))


@query("a21_overlap", GOLD + "select * from p", tables=False)
def overlap(t: Tables) -> DataFrame:
    return _pairs(t)


@query("a21_overlap_totals", GOLD + "select folder, cast(sum(n_golden) as bigint) as n_golden, cast(sum(n_found) as bigint) as n_found, round(100.0::double * sum(n_found) / sum(n_golden), 6) as pct from p group by rollup (folder)", tables=False)
def overlap_totals(t: Tables) -> DataFrame:
    return C.overlap_totals(_pairs(t))


@query("a22_corpus_overview", "select lang, source as folder, count(distinct doc_id) as n_files, cast(sum(len(string_split(text, chr(10)))) as bigint) as n_sections from documents group by all", tables=False)
def corpus_overview(t: Tables) -> DataFrame:
    return _sections(t).groupBy("lang", "folder").agg(F.countDistinct("file").alias("n_files"), F.count("*").alias("n_sections"))


@query("a23_threshold_split", "select n <= 4 as few, count(*) as documents, round(avg(n), 9) as mean from (select l_orderkey, count(*) as n from lineitem group by 1) group by 1", tables=False)
def threshold_split(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy((F.col("n") <= 4).alias("few")).agg(F.count("*").alias("documents"), F.round(F.avg("n"), 9).alias("mean"))


@query("a24_frequency_of_frequency", "select n, count(*) as documents from (select l_orderkey, count(*) as n from lineitem group by 1) group by 1", tables=False)
def frequency_of_frequency(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("documents"))


@query("a24_histogram", "select cast(least(floor(l_quantity / 5), 9) as bigint) as bin, count(*) as n from lineitem group by 1", tables=False)
def histogram(t: Tables) -> DataFrame:
    bin_no = F.least(F.width_bucket("l_quantity", F.lit(0.0), F.lit(50.0), F.lit(10)) - 1, F.lit(9))
    return t.lineitem.groupBy(bin_no.cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("a25_longest_text", "select doc_id, n_chars from documents order by length(text) desc, doc_id limit 1", tables=False)
def longest(t: Tables) -> DataFrame:
    best = F.max(F.struct(F.length("text"), -F.col("doc_id"), "n_chars")).alias("b")
    return t.documents.agg(best).select((-F.col("b.col2")).alias("doc_id"), F.col("b.n_chars").alias("n_chars"))


@query(
    "a26_f1",
    "with t as (select doc_id, unnest(['q' || quality, 't' || toxic]) as label from labels), p as (select doc_id, unnest(['q' || case when n_chars > 300 then 1 else 0 end, 't0']) as label from documents where doc_id in (select doc_id from labels)), j as (select coalesce(t.label, p.label) as label, count(*) filter (t.label is not null and p.label is not null) as tp, count(*) filter (t.label is null) as fp, count(*) filter (p.label is null) as fn from (select distinct * from t) t full join (select distinct * from p) p on t.doc_id = p.doc_id and t.label = p.label group by 1) select round(2.0::double * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) as micro, round(avg(2.0::double * tp / (2 * tp + fp + fn)), 9) as macro from j",
    tables=False,
)
def f1(t: Tables) -> DataFrame:
    truth = t.labels.select(F.col("doc_id").alias("id"), F.explode(F.array(F.concat(F.lit("q"), "quality"), F.concat(F.lit("t"), "toxic"))).alias("label"))
    guess = F.array(F.concat(F.lit("q"), F.when(F.col("n_chars") > 300, 1).otherwise(0)), F.lit("t0"))
    found = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.explode(guess).alias("label"))
    return O.multilabel_f1(truth, found).select(F.round("micro", 9).alias("micro"), F.round("macro", 9).alias("macro"))


@query("a27_label_counts", "select label, count(*) as n from (select unnest(['q' || quality, 't' || toxic]) as label from labels) group by 1", tables=False)
def label_counts(t: Tables) -> DataFrame:
    return t.labels.select(F.explode(F.array(F.concat(F.lit("q"), "quality"), F.concat(F.lit("t"), "toxic"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("a28_top_phrases", "with w as (select doc_id, unnest(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) as phrase, unnest(range(len(list_filter(string_split(lower(text), ' '), lambda x: x <> '')))) as pos from documents), c as (select doc_id, phrase, count(*) as n, min(pos) as pos from w group by 1, 2) select doc_id, cast(place as integer) as place, phrase, n from (select *, row_number() over (partition by doc_id order by n desc, pos) as place from c) where place <= 2", tables=False)
def top_phrases(t: Tables) -> DataFrame:
    """Texts are dealt out by document before they are split: of what is counted nothing is shuffled."""
    texts = t.documents.select("doc_id", "text")
    rows = texts.repartition(parts(t.spark), "doc_id").select("doc_id", F.filter(F.split(F.lower("text"), " "), lambda w: w != "").alias("phrases"))
    return C.phrase_counts(rows, "doc_id", "phrases")


@query("a29_tfidf", "with w as (select doc_id as id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) > 1)) as term from documents), c as (select id, term, count(*) as tf from w group by 1, 2), v as (select term, sum(tf) as a, count(*) as df from c group by 1 order by a desc, term limit 1000), n as (select cast(count(distinct id) as double) as n from w), x as (select id, term, tf * (ln((1 + n) / (1.0::double + df)) + 1) as raw from c join v using (term), n) select id as doc_id, term, round(raw / sqrt(sum(raw * raw) over (partition by id)), 8) as weight from x", tables=False)
def tfidf(t: Tables) -> DataFrame:
    tokens = t.documents.select(F.col("doc_id").alias("id"), F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 1)).alias("term"))
    return O.tfidf(tokens, 1000).select(F.col("id").alias("doc_id"), "term", F.round("weight", 8).alias("weight"))


@query("a30_topics", "select p_partkey as part, unnest(list_transform(string_split(replace(p_name, ' ', ' , '), ','), lambda x: trim(x))) as topic from part", tables=False)
def topics(t: Tables) -> DataFrame:
    listed = F.replace(F.col("p_name"), F.lit(" "), F.lit(" , "))
    return t.part.select(F.col("p_partkey").alias("part"), F.explode(F.transform(F.split(listed, ","), lambda x: F.trim(x))).alias("topic"))


@query("a31_grouping_sets", "select o_orderstatus as status, o_orderpriority as priority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)", tables=False)
def cube(t: Tables) -> DataFrame:
    return t.orders.cube(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("w2_linear_index", "select conv_id, turn, cast(row_number() over (partition by conv_id order by turn) - 1 as integer) as seq from conversations", tables=False)
def linear_index(t: Tables) -> DataFrame:
    return S.index(t.conversations, "conv_id", "turn").select("conv_id", "turn", "seq")


@query("w3_header_cut", "with c as (select *, max(case when role = 'system' then turn end) over (partition by conv_id) as cut from conversations) select conv_id, turn from c where cut is null or turn > cut", tables=False)
def header_cut(t: Tables) -> DataFrame:
    return S.after_last(t.conversations, "conv_id", "turn", F.col("role") == "system").select("conv_id", "turn")


@query("w5_title_accretion", "with s as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as segment from conversations) select conv_id, cast(segment as bigint) as segment, string_agg(role, ' ' order by turn) as text from s group by 1, 2", tables=False)
def accretion(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "role", F.col("role").alias("text"))
    return S.joined_segments(rows, "conv_id", "turn", F.col("role") == "user", "text")


FOLD = """with v as (select l_orderkey as doc, list(cast(l_partkey % 9 + 1 as integer) order by l_linenumber, l_partkey % 9 + 1) as v from lineitem group by 1),
f as (select doc, list_reduce(list_transform(v, lambda x: [x]), lambda a, x: case when x[1] > a[-1] and x[1] <= a[-1] + 4 then list_concat(a, x) else a end, [0]) as a from v)
select doc, array_to_string(a[2:], ',') as accepted, len(a) - 1 <> a[-1] as had_gap from f"""


@query("w6_state_fold", FOLD, tables=False)
def state_fold(t: Tables) -> DataFrame:
    listed = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 9 + 1).cast("int").alias("n")))), lambda x: x["n"]).alias("v"))
    kept, gap = S.accepted(F.col("v"))
    return listed.select(F.col("l_orderkey").alias("doc"), F.array_join(kept.cast("array<string>"), ",").alias("accepted"), gap.alias("had_gap"))


@query("w7_gaps", "with d as (select distinct l_orderkey as doc, l_partkey as n from lineitem), g as (select doc, n as start, lead(n) over (partition by doc order by n) as stop from d) select * from g where stop - start > 1", tables=False)
def gaps(t: Tables) -> DataFrame:
    return S.gaps(t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("n")), "doc", "n")


@query("w8_duplicates", "select l_orderkey as doc, l_suppkey as marker, count(*) as n from lineitem group by 1, 2 having count(*) > 1", tables=False)
def duplicates(t: Tables) -> DataFrame:
    return S.repeated(t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("marker")), "doc", "marker")


@query("w9_duplicated_first", "select event_id from (select event_id, row_number() over (partition by user_id, event_type order by event_id) as k from events) where k > 1", tables=False)
def duplicated_first(t: Tables) -> DataFrame:
    return O.duplicated(t.events, ["user_id", "event_type"], "event_id").select("event_id")


@query("w9_duplicated_all", "select event_id from (select event_id, count(*) over (partition by user_id, event_type) as k from events) where k > 1", tables=False)
def duplicated_all(t: Tables) -> DataFrame:
    return O.duplicated(t.events, ["user_id", "event_type"], "event_id", None).select("event_id")


@query("w10_margin", "select l_orderkey as doc, l_linenumber as n, coalesce(min(case when l_tax > 0.03 then l_quantity end) over (partition by l_orderkey), 30.0) as margin from lineitem", tables=False)
def margin(t: Tables) -> DataFrame:
    return S.margin(t.lineitem, ["l_orderkey"], F.col("l_quantity"), F.col("l_tax") > 0.03).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), "margin")


@query("w11_continuation", "with s as (select *, sum(case when l_returnflag = 'N' then 1 else 0 end) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding) as segment from lineitem) select l_orderkey as doc, cast(segment as bigint) as segment, string_agg(l_returnflag, '' order by l_linenumber, l_partkey, l_suppkey) as text from s where segment > 0 group by 1, 2", tables=False)
def continuation(t: Tables) -> DataFrame:
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place")
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc"), place, F.col("l_returnflag").alias("text"))
    return S.joined_segments(rows, "doc", "place", F.col("text") == "N", "text", "").where("segment > 0")


def _events(t: Tables) -> DataFrame:
    e = t.events
    return e.select(F.col("user_id").alias("rs"), L.event_type(F.concat(F.lit("http://x/"), "event_type"), F.col("event_type")).alias("type"), F.col("ts").cast("date").alias("date"), F.when(F.col("value") > 50, F.col("ts").cast("date")).alias("decision_date"), F.col("event_type").alias("source_label"), F.concat(F.lit("uri/"), F.col("event_id") % 50).alias("source_uri"))


EVENTS = "with e as (select distinct user_id as rs, 'Modifica' as type, cast(ts as date) as date, case when value > 50 then cast(ts as date) end as decision_date, event_type as source_label, 'uri/' || (event_id % 50) as source_uri from events) "


@query("w13_timeline", EVENTS + "select rs, type, cast(date as varchar) as date, cast(decision_date as varchar) as decision_date, source_label, source_uri, cast(row_number() over (partition by rs order by date desc nulls last, decision_date desc nulls last, type, source_label, source_uri) as integer) as place from e", tables=False)
def timeline(t: Tables) -> DataFrame:
    out = L.timeline(_events(t), "rs")
    return out.withColumn("date", F.col("date").cast("string")).withColumn("decision_date", F.col("decision_date").cast("string"))


@query("w14_distinct_changes", EVENTS + "select distinct cast(date as varchar) as date, source_uri from e", tables=False)
def distinct_changes(t: Tables) -> DataFrame:
    return _events(t).select(F.col("date").cast("string").alias("date"), "source_uri").dropDuplicates()


@query("x14_lifecycle", EVENTS + "select rs, count(*) as n_events, cast(max(date) as varchar) as latest from e group by 1", tables=False)
def lifecycle(t: Tables) -> DataFrame:
    lists = L.nested(L.timeline(_events(t), "rs"), "rs")
    return lists.select("rs", F.size("events").cast("long").alias("n_events"), F.element_at("events", 1)["date"].cast("string").alias("latest"))


@query("w15_frames", "select l_orderkey as doc, l_linenumber as n, lag(l_quantity) over w as before, lead(l_quantity) over w as after, cast(ntile(2) over w as integer) as half, round(percent_rank() over w, 9) as share from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)", tables=False)
def frames(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), F.lag("l_quantity").over(w).alias("before"), F.lead("l_quantity").over(w).alias("after"), F.ntile(2).over(w).alias("half"), F.round(F.percent_rank().over(w), 9).alias("share"))


@query("o6_first_files", "select * from (select source as folder, doc_id, cast(row_number() over (partition by source order by doc_id) as integer) as place from documents) where place <= 5", tables=False)
def first_files(t: Tables) -> DataFrame:
    return O.top_per_group(t.documents.select(F.col("source").alias("folder"), "doc_id"), ["folder"], 5, F.col("doc_id")).withColumnRenamed("rank", "place")


@query("u1_bag_concat", "select role, count(*) as n from (select role from conversations union all select role from conversations where turn = 1) group by 1", tables=False)
def bag_concat(t: Tables) -> DataFrame:
    c = t.conversations
    return c.select("role").unionByName(c.where("turn = 1").select("role")).groupBy("role").agg(F.count("*").alias("n"))


@query("u2_array_union", "with a as (select l_orderkey as doc, list_sort(list_distinct(list(l_partkey % 7) || list(l_suppkey % 7))) as v from lineitem group by 1) select doc, array_to_string(v, ',') as codes from a", tables=False)
def array_union(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(F.col("l_partkey") % 7).alias("a"), F.collect_list(F.col("l_suppkey") % 7).alias("b"))
    return g.select("doc", F.array_join(F.array_sort(F.array_union("a", "b")).cast("array<string>"), ",").alias("codes"))


@query("u3_differences", "select l_orderkey as doc, count(distinct case when l_quantity > 30 then l_partkey % 5 end) as n_big from lineitem group by 1", tables=False)
def differences(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_set(F.when(F.col("l_quantity") > 30, F.col("l_partkey") % 5)).alias("big"), F.array().cast("array<bigint>").alias("none"))
    return g.select("doc", F.size(F.array_except("big", "none")).cast("long").alias("n_big"))


@query("u4_intersection", "select l_partkey as part from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A'", tables=False)
def intersection(t: Tables) -> DataFrame:
    e = t.lineitem
    return e.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part")).intersect(e.where("l_returnflag = 'A'").select("l_partkey"))


@query("u5_category_universe", "select src_cat as category from refs union select dst_cat from refs")
def universe(t: Tables) -> DataFrame:
    refs = t.references
    return refs.select(F.col("src_cat").alias("category")).union(refs.select("dst_cat")).distinct()


@query("d17_category_matrix", "select src_cat, cast(coalesce(sum(n) filter (dst_cat = 'NATION_1'), 0) as bigint) as first_nation, cast(coalesce(sum(n) filter (dst_cat = 'NATION_2'), 0) as bigint) as second_nation from refs group by 1")
def matrix(t: Tables) -> DataFrame:
    m = _refs(t).groupBy("src_cat").pivot("dst_cat", ["NATION_1", "NATION_2"]).agg(F.sum("n")).fillna(0)
    return m.select("src_cat", F.col("NATION_1").alias("first_nation"), F.col("NATION_2").alias("second_nation"))


@query("g20_circular_layout", "select n_name as category, round(cos(2 * pi() * (row_number() over (order by n_name) - 1) / count(*) over ()), 9) as x, round(sin(2 * pi() * (row_number() over (order by n_name) - 1) / count(*) over ()), 9) as y from nation", tables=False)
def circular_layout(t: Tables) -> DataFrame:
    c = O.circle(t.nation.select(F.col("n_name").alias("category")), "category")
    return c.select("category", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("stream_windows", "select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2", tables=False)
def stream_windows(t: Tables) -> DataFrame:
    w = streams.windowed(t.events)
    return w.select(F.col("start").cast("date").cast("string").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


@query("stream_sessions", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as s from events), k as (select user_id, sum(s) over (partition by user_id order by ts rows unbounded preceding) as session from g) select user_id, count(distinct session) as n_sessions, count(*) as n_events from k group by 1", tables=False)
def stream_sessions(t: Tables) -> DataFrame:
    return streams.sessions(t.events).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))
