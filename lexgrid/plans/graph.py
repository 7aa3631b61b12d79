"""Queries over the property graph: scans, paths, aggregates and algorithms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.functions import dates
from lexgrid.graph import algorithms as G
from lexgrid.graph import model as M
from lexgrid.operators import tables as O
from lexgrid.plans.registry import Tables, query
from lexgrid.runtime import durable

TOP = 10


def graph(t: Tables) -> M.PropertyGraph:
    parts = t.sections.select(F.col("part").alias("id"))
    return M.PropertyGraph({"Law": t.laws, "Section": parts}, t.edges)


@query("j1_top_cited_laws", "select dst as law, count(*) as n_cited from edges group by 1 order by 2 desc, 1 limit 10")
def top_cited(t: Tables) -> DataFrame:
    return M.two_hop(t.sections, t.cites).where("src <> dst").join(t.laws.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("law")).agg(F.count("*").alias("n_cited")).orderBy(F.desc("n_cited"), "law").limit(TOP)


@query("s23_scan_label", "select id as law_id, validity, type_law, cast(published as varchar) as published from laws")
def scan_label(t: Tables) -> DataFrame:
    return t.laws.select(F.col("id").alias("law_id"), "validity", "type_law", F.col("published").cast("string").alias("published"))


@query("s24_catalog", "select 'label' as kind, 'Law' as name, (select count(*) from orders) as n union all select 'label', 'Section', (select count(*) from lineitem) union all select 'relation', rel_type, count(*) from edges group by 2")
def catalog(t: Tables) -> DataFrame:
    g = graph(t)
    return g.label_counts().select(F.lit("label").alias("kind"), F.col("label").alias("name"), "n").unionByName(g.relation_counts().select(F.lit("relation").alias("kind"), F.col("rel_type").alias("name"), "n"))


@query("s24_property_types", "select 'Law' as label, 'id' as property, 'bigint' as type union all select 'Law', 'validity', 'string' union all select 'Law', 'type_law', 'string' union all select 'Law', 'published', 'date' union all select 'Law', 'customer', 'bigint' union all select 'Section', 'id', 'string'", tables=False)
def property_types(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(graph(t).property_types(), "label string, property string, type string")


@query("j1_two_hop_properties", "select e.src, e.dst, e.rel_type, a.validity as src_validity, b.validity as dst_validity, cast(a.published as varchar) as src_date, cast(b.published as varchar) as dst_date from edges e join laws a on e.src = a.id join laws b on e.dst = b.id")
def two_hop_properties(t: Tables) -> DataFrame:
    a = t.laws.select(F.col("id").alias("src"), F.col("validity").alias("src_validity"), F.col("published").cast("string").alias("src_date"))
    b = t.laws.select(F.col("id").alias("dst"), F.col("validity").alias("dst_validity"), F.col("published").cast("string").alias("dst_date"))
    return M.two_hop(t.sections, t.cites).where("src <> dst").join(a, "src").join(b, "dst").select("src", "dst", "rel_type", "src_validity", "dst_validity", "src_date", "dst_date")


@query("j2_law_to_law", "select src, dst, rel_type from edges")
def law_to_law(t: Tables) -> DataFrame:
    return M.two_hop(t.sections, t.cites).where("src <> dst").join(t.laws.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "rel_type")


@query("j3_weighted_projection", "select src, dst, rel_type, count(*) as weight from edges group by all")
def weighted(t: Tables) -> DataFrame:
    return M.weighted(t.edges)


@query("j4_undirected", "select rel_type, 2 * count(*) as n_matches, count(distinct edge_id) as n_edges from edges group by 1")
def undirected(t: Tables) -> DataFrame:
    return graph(t).undirected().groupBy("rel_type").agg(F.count("*").alias("n_matches"), F.countDistinct("edge_id").alias("n_edges"))


@query("j5_optional_match", "select id as law, count(e.dst) as n_cites, count(distinct e.dst) as n_targets from laws left join edges e on id = e.src group by 1")
def optional_match(t: Tables) -> DataFrame:
    return t.laws.join(t.edges, F.col("id") == F.col("src"), "left").groupBy(F.col("id").alias("law")).agg(F.count("dst").alias("n_cites"), F.countDistinct("dst").alias("n_targets"))


@query("j5_two_optional_branches", "select id as law, count(*) as n_rows from laws left join edges a on id = a.src left join chain b on id = b.src group by 1")
def two_branches(t: Tables) -> DataFrame:
    a, b = t.edges.select(F.col("src").alias("id"), "dst"), t.chain.select(F.col("src").alias("id"), F.col("dst").alias("next"))
    return t.laws.select("id").join(a, "id", "left").join(b, "id", "left").groupBy(F.col("id").alias("law")).agg(F.count("*").alias("n_rows"))


@query("j9_top_details", "select t.dst as law, t.n, validity, type_law from (select dst, count(*) as n from edges group by 1 order by 2 desc, 1 limit 20) t join laws on t.dst = id")
def top_details(t: Tables) -> DataFrame:
    top = t.edges.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(20)
    return top.join(t.laws, F.col("dst") == F.col("id")).select(F.col("dst").alias("law"), "n", "validity", "type_law")


@query("p2_label_case", "select validity, case when validity = 'F' then 'In force' when validity = 'O' then 'Open' else 'Unknown' end as name, count(*) as n from laws group by all")
def label_case(t: Tables) -> DataFrame:
    name = F.when(F.array_contains(F.array("validity"), "F"), "In force").when(F.array_contains(F.array("validity"), "O"), "Open").otherwise("Unknown")
    return t.laws.groupBy("validity", name.alias("name")).agg(F.count("*").alias("n"))


@query("p4_conditional_update", "select id as law, case when published < date '1996-06-10' then 'Abrogated' else validity end as validity from laws")
def conditional_update(t: Tables) -> DataFrame:
    return t.laws.select(F.col("id").alias("law"), dates.after_end(F.col("published"), F.col("validity"), "1996-06-10").alias("validity"))


@query("p11_id_list", "select id as law, validity from laws where id in (select dst from edges where rel_type = 'R')")
def id_list(t: Tables) -> DataFrame:
    wanted = t.edges.where("rel_type = 'R'").select(F.col("dst").alias("id"))
    return t.laws.join(wanted, "id", "left_semi").select(F.col("id").alias("law"), "validity")


@query("p12_self_loops", "select count(*) as n_all, cast(sum(case when l_orderkey <> l_partkey then 1 else 0 end) as bigint) as n_kept from lineitem", tables=False)
def self_loops(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count("*").alias("n_all"), F.sum(F.when(F.col("l_orderkey") != F.col("l_partkey"), 1).otherwise(0)).alias("n_kept"))


@query("p14_year", "select id as law from laws where year(published) = 1995")
def in_year(t: Tables) -> DataFrame:
    return t.laws.where(F.year("published") == 1995).select(F.col("id").alias("law"))


@query("a1_label_counts", "select l as label, count(*) as n from (select unnest([validity, type_law]) as l from laws) group by 1")
def label_counts(t: Tables) -> DataFrame:
    return t.laws.select(F.explode(F.array("validity", "type_law")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("a2_relation_counts", "select rel_type, count(*) as n, count(distinct edge_id) as n_distinct from edges group by 1")
def relation_counts(t: Tables) -> DataFrame:
    return t.edges.groupBy("rel_type").agg(F.count("*").alias("n"), F.countDistinct("edge_id").alias("n_distinct"))


@query("a3_validity_by_year", "select validity, cast(year(published) as integer) as y, count(*) as n from laws where published is not null group by all")
def validity_by_year(t: Tables) -> DataFrame:
    return t.laws.where("published is not null").groupBy("validity", F.year("published").alias("y")).agg(F.count("*").alias("n"))


@query("a4_most_citing", "select src as law, count(*) as n from edges group by 1 order by 2 desc, 1 limit 10")
def most_citing(t: Tables) -> DataFrame:
    return t.edges.groupBy(F.col("src").alias("law")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "law").limit(TOP)


@query("a5_most_cited_of_types", "select dst as law, count(*) as n from edges where rel_type in ('A', 'R') group by 1 order by 2 desc, 1 limit 10")
def cited_of_types(t: Tables) -> DataFrame:
    return t.edges.where(F.col("rel_type").isin("A", "R")).groupBy(F.col("dst").alias("law")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "law").limit(TOP)


def _dated(t: Tables) -> DataFrame:
    a, b = t.laws.select(F.col("id").alias("src"), F.year("published").alias("src_year"), F.col("validity").alias("src_validity")), t.laws.select(F.col("id").alias("dst"), F.year("published").alias("dst_year"), F.col("validity").alias("dst_validity"))
    return t.edges.join(a, "src").join(b, "dst")


DATED = ", dated as (select cast(year(a.published) as integer) as src_year, cast(year(b.published) as integer) as dst_year, a.validity as src_validity, b.validity as dst_validity from edges e join laws a on e.src = a.id join laws b on e.dst = b.id) "


@query("a6_year_crosstab", DATED + "select src_year, dst_year, count(*) as n from dated group by all")
def year_crosstab(t: Tables) -> DataFrame:
    return _dated(t).groupBy("src_year", "dst_year").agg(F.count("*").alias("n"))


@query("a7_validity_pivot", DATED + "select src_validity, count(*) filter (dst_validity = 'F') as f, count(*) filter (dst_validity = 'O') as o, count(*) filter (dst_validity = 'P') as p from dated group by 1")
def validity_pivot(t: Tables) -> DataFrame:
    counts = _dated(t).groupBy("src_validity", "dst_validity").agg(F.count("*").alias("n"))
    return O.pivot(counts, "src_validity", "dst_validity", "n", ["F", "O", "P"]).select("src_validity", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("a8_past_and_future", DATED + "select count(*) filter (src_year = dst_year) as same, count(*) filter (src_year > dst_year) as past, count(*) filter (src_year < dst_year) as future from dated")
def past_and_future(t: Tables) -> DataFrame:
    total = lambda c: F.sum(F.when(c, 1).otherwise(0))
    s, d = F.col("src_year"), F.col("dst_year")
    return _dated(t).agg(total(s == d).alias("same"), total(s > d).alias("past"), total(s < d).alias("future"))


@query("a9_validity_matrix", DATED + "select src_validity, dst_validity, count(*) as n from dated group by all")
def validity_matrix(t: Tables) -> DataFrame:
    return _dated(t).groupBy("src_validity", "dst_validity").agg(F.count("*").alias("n"))


@query("a10_community_sizes", "select count(*) as communities, max(n) as largest, min(n) as smallest, median(n) as middle from (select customer, count(*) as n from laws group by 1)")
def community_sizes(t: Tables) -> DataFrame:
    parts = G.weak_components(t.laws, t.chain).groupBy("component").agg(F.count("*").alias("n"))
    return parts.agg(F.count("*").alias("communities"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.median("n").alias("middle"))


@query("a11_type_shares", "select type_law, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 9) as share from laws where type_law is not null group by 1")
def type_shares(t: Tables) -> DataFrame:
    return O.value_counts(t.laws, "type_law").select("type_law", "n", F.round("share", 9).alias("share"))


@query("a32_distinct", "select distinct validity, type_law from laws")
def distinct_rows(t: Tables) -> DataFrame:
    return t.laws.select("validity", "type_law").distinct()


@query("o1_order_limit", "select id as law, cast(published as varchar) as published from laws order by laws.published desc nulls first, id limit 25")
def order_limit(t: Tables) -> DataFrame:
    return O.top(t.laws, 25, F.desc_nulls_first("published"), F.col("id")).select(F.col("id").alias("law"), F.col("published").cast("string").alias("published"))


@query("o2_two_keys", "select src as law, count(*) as score from edges group by 1 order by 2 desc, 1 asc limit 50")
def two_keys(t: Tables) -> DataFrame:
    return O.top(t.edges.groupBy(F.col("src").alias("law")).agg(F.count("*").alias("score")), 50, F.desc("score"), F.col("law"))


@query("o4_most_common", "select type_law, count(*) as n from laws group by 1 order by 2 desc, 1 limit 3")
def most_common(t: Tables) -> DataFrame:
    return O.top(O.value_counts(t.laws, "type_law").drop("share"), 3, F.desc("n"), F.col("type_law"))


@query("o5_top_per_group", "select * from (select validity, type_law, count(*) as n, cast(row_number() over (partition by validity order by count(*) desc, type_law) as integer) as place from laws group by 1, 2) where place <= 3")
def top_per_group(t: Tables) -> DataFrame:
    counts = t.laws.groupBy("validity", "type_law").agg(F.count("*").alias("n"))
    return O.top_per_group(counts, ["validity"], 3, F.desc("n"), F.col("type_law")).withColumnRenamed("rank", "place")


@query("o8_sample", " select id as law, validity from laws order by md5(id::varchar || ':42'), id limit 20")
def sample(t: Tables) -> DataFrame:
    return O.sample(t.laws, "id", 20).select(F.col("id").alias("law"), "validity")


@query("o9_exists", "select exists (select 1 from edges where rel_type = 'R') as found")
def exists(t: Tables) -> DataFrame:
    return t.edges.where("rel_type = 'R'").limit(1).agg((F.count("*") > 0).alias("found"))


@query("p1_projection", " select id as nodeId, validity as status, type_law as lawType, published as datePublished, year(published) as publishedYear, customer as owner, type_law || ' ' || id as title from laws")
def projection(t: Tables) -> DataFrame:
    return t.laws.select(F.col("id").alias("nodeId"), F.col("validity").alias("status"), F.col("type_law").alias("lawType"), F.col("published").alias("datePublished"), F.year("published").cast("bigint").alias("publishedYear"), F.col("customer").alias("owner"), F.concat_ws(" ", "type_law", "id").alias("title"))


@query("o3_sorted_head", " select id as law, published from laws order by published desc, id limit 25")
def sorted_head(t: Tables) -> DataFrame:
    return t.laws.orderBy(F.desc("published"), "id").limit(25).select(F.col("id").alias("law"), "published")


@query("u6_set_statements", " select 'both' as side, src as law from (select src from edges intersect select dst from edges) union all select 'citing only', src from (select src from edges except select dst from edges)")
def set_statements(t: Tables) -> DataFrame:
    citing, cited = t.edges.select(F.col("src").alias("law")), t.edges.select(F.col("dst").alias("law"))
    return citing.intersect(cited).select(F.lit("both").alias("side"), "law").unionByName(citing.subtract(cited).select(F.lit("citing only").alias("side"), "law"))


@query("sparql_optional_coalesce", "select id as law, coalesce(cast(c.dst as varchar), 'none') as next, validity from laws left join chain c on id = c.src where type_law like '1%' order by id desc limit 100")
def sparql(t: Tables) -> DataFrame:
    """SELECT with a triple join, OPTIONAL, COALESCE, STRSTARTS, ORDER BY DESC and LIMIT over a triples table (s, p, o)."""
    laws, chain = t.laws, t.chain
    triples = laws.select(F.col("id").alias("s"), F.lit("type").alias("p"), F.col("type_law").alias("o")).unionByName(laws.select(F.col("id").alias("s"), F.lit("validity").alias("p"), F.col("validity").alias("o"))).unionByName(chain.select(F.col("src").alias("s"), F.lit("next").alias("p"), F.col("dst").cast("string").alias("o")))
    a, b, c = (triples.where(F.col("p") == p).select("s", F.col("o").alias(p)) for p in ("type", "validity", "next"))
    return a.where(F.col("type").startswith("1")).join(b, "s").join(c, "s", "left").select(F.col("s").alias("law"), F.coalesce("next", F.lit("none")).alias("next"), "validity").orderBy(F.desc("law")).limit(100)


def _rank_sql(rounds: int) -> str:
    """PageRank by its definition, a step a round."""
    steps = [", nodes as (select id from laws), share as (select src, dst, cast(count(*) as double) / any_value(o) as s from edges join (select src as k, count(*) as o from edges group by 1) on src = k group by src, dst), r0 as (select id, 0.15::double as score from nodes)"]
    for i in range(rounds):
        steps.append(f", r{i + 1} as (select n.id, 0.15::double + 0.85::double * coalesce(g.got, 0.0) as score from nodes n left join (select dst, sum(r.score * s) as got from share join r{i} r on src = r.id group by 1) g on n.id = g.dst)")
    return "".join(steps)


@query("g1_pagerank5", _rank_sql(5) + " select id as law, round(score, 8) as score from r5")
def pagerank5(t: Tables) -> DataFrame:
    return G.pagerank(t.laws, t.edges, 5).select(F.col("id").alias("law"), F.round("score", 8).alias("score"))


@query("g1_pagerank20", _rank_sql(20) + " select id as law, round(score, 7) as score from r20")
def pagerank20(t: Tables) -> DataFrame:
    return G.pagerank(t.laws, t.edges, 20).select(F.col("id").alias("law"), F.round("score", 7).alias("score"))


@query("g2_pagerank_normalised")
def pagerank_normalised(t: Tables) -> DataFrame:
    return G.pagerank_normalised(t.laws, t.edges).select(F.col("id").alias("law"), "score")


DEGREES = ", d as (select id as law, (select count(*) from orders) - 1.0::double as others, coalesce(o, 0) as out_degree, coalesce(i, 0) as in_degree from laws left join (select src, count(*) as o from edges group by 1) on id = src left join (select dst, count(*) as i from edges group by 1) on id = dst)"


@query("g3_degree", DEGREES + " select law, out_degree, in_degree from d")
def degree(t: Tables) -> DataFrame:
    return G.degrees(t.laws, t.edges).select(F.col("id").alias("law"), "out_degree", "in_degree")


@query("g4_degree_centrality", DEGREES + " select law, round(out_degree / others, 12) as out_centrality, round(in_degree / others, 12) as in_centrality from d")
def centrality(t: Tables) -> DataFrame:
    return G.degrees(t.laws, t.edges).select(F.col("id").alias("law"), F.round("out_centrality", 12).alias("out_centrality"), F.round("in_centrality", 12).alias("in_centrality"))


@query("g15_overview", DEGREES + " select count(*) as nodes, cast(sum(out_degree) as bigint) as edges, round(sum(out_degree) / (count(*) * (count(*) - 1.0::double)), 12) as density, round(2 * sum(out_degree) / (count(*) * (count(*) - 1.0::double)), 12) as undirected_density, round(sum(out_degree) / cast(count(*) as double), 9) as mean_out, max(out_degree) as max_out, max(in_degree) as max_in from d")
def overview(t: Tables) -> DataFrame:
    o = G.overview(t.laws, t.edges)
    return o.select("nodes", "edges", F.round("density", 12).alias("density"), F.round("undirected_density", 12).alias("undirected_density"), F.round("mean_out", 9).alias("mean_out"), "max_out", "max_in")


@query("g22_verdicts", DEGREES + ", o as (select sum(out_degree) / (count(*) * (count(*) - 1.0::double)) as density, max(out_degree + in_degree) > 10 * 2 * sum(out_degree) / cast(count(*) as double) as has_hubs from d) select case when density < 0.001 then 'very sparse' when density < 0.01 then 'sparse' else 'dense' end as sparsity, has_hubs from o")
def verdicts(t: Tables) -> DataFrame:
    return G.overview(t.laws, t.edges).select("sparsity", "has_hubs")


@query("g5_betweenness_sampled")
def betweenness(t: Tables) -> DataFrame:
    """Sampled: a tenth of the nodes as pivots."""
    laws = t.laws
    pivots = G.hashed_pivots(laws, max(1, laws.count() // 10))
    return G.betweenness(laws, t.edges, pivots, scale=10.0).select(F.col("id").alias("law"), "score")


@query("g6_betweenness_exact", ", ranked as (select id as law, cast(row_number() over (partition by customer order by id) - 1 as double) as a, cast(count(*) over (partition by customer) as double) as n from laws) select law, round(a * (n - 1 - a), 6) as score from ranked")
def betweenness_exact(t: Tables) -> DataFrame:
    """On chains the node with a before and b after it lies on a * b shortest paths."""
    laws = t.laws
    return G.betweenness(laws, t.chain, laws).select(F.col("id").alias("law"), F.round("score", 6).alias("score"))


def _eigenvector_sql(rounds: int) -> str:
    """Steps x + Ax, with one normalisation at the end, since each step is linear."""
    steps = [", links as materialized (select src, dst, cast(count(*) as double) as n from edges group by 1, 2), e0 as (select id, 1.0::double as score from laws)"]
    for i in range(rounds):
        steps.append(f", e{i + 1} as materialized (select r.id, r.score + coalesce(g.got, 0.0) as score from e{i} r left join (select dst, sum(r.score * n) as got from links join e{i} r on src = r.id group by 1) g on r.id = g.dst)")
    return "".join(steps)


@query("g7_eigenvector", _eigenvector_sql(12) + " select id as law, round(score / (select sqrt(sum(score * score)) from e12), 9) as score from e12")
def eigenvector(t: Tables) -> DataFrame:
    return G.eigenvector(t.laws, t.edges, 12).select(F.col("id").alias("law"), F.round("score", 9).alias("score"))


@query("g9_louvain")
def louvain(t: Tables) -> DataFrame:
    """Communities of the largest component of the citation graph: each law with its part, and the partition's modularity."""
    placed = durable(G.weak_components(t.laws, t.edges))
    largest = O.top(placed.groupBy("component").agg(F.count("*").alias("n")), 1, F.desc("n"), F.col("component"))
    edges = durable(M.induced(t.edges, placed.join(largest, "component").select("id")))
    parts = durable(G.louvain(edges))
    return parts.join(G.modularity(edges, parts)).select(F.col("id").alias("law"), "part", F.round("q", 6).alias("q"))  # one row


@query("g11_modularity", ", placed as (select a.validity as pa, b.validity as pb from edges e join laws a on e.src = a.id join laws b on e.dst = b.id), ends as (select pa as part, case when pa = pb then 1 else 0 end as inside from placed union all select pb, 0 from placed), by_part as (select part, cast(sum(inside) as double) as inside, cast(count(*) as double) as degree from ends group by 1) select round(sum(inside) / (sum(degree) / 2) - sum(degree * degree) / (sum(degree) * sum(degree)), 9) as q from by_part")
def modularity(t: Tables) -> DataFrame:
    return G.modularity(t.edges, t.laws.select("id", F.col("validity").alias("part"))).select(F.round("q", 9).alias("q"))


@query("g13_components", "select id as law, min(id) over (partition by customer) as component from laws")
def components(t: Tables) -> DataFrame:
    return G.weak_components(t.laws, t.chain).select(F.col("id").alias("law"), "component")


@query("g13_largest_component", "select count(distinct customer) as components, (select count(*) as n from laws group by customer order by n desc limit 1) as largest from laws")
def largest_component(t: Tables) -> DataFrame:
    sizes = G.weak_components(t.laws, t.chain).groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest"))


@query("g14_strong_components", "select id as law, min(id) over (partition by customer) as component from laws")
def strong_components(t: Tables) -> DataFrame:
    """The chains closed to rings: each is one strong component."""
    from pyspark.sql import Window

    w = Window.partitionBy("customer")
    ring = t.laws.select(F.max("id").over(w).alias("src"), F.min("id").over(w).alias("dst")).distinct()
    return G.strong_components(t.laws, t.chain.unionByName(ring)).select(F.col("id").alias("law"), "component")


@query("g16_named_projection", "select 'edges only' as form, (select count(*) from (select src from edges union select dst from edges)) as nodes, (select count(*) from edges) as edges union all select 'all nodes', (select count(*) from laws), (select count(*) from edges)")
def named_projection(t: Tables) -> DataFrame:
    catalog, out = M.GraphCatalog(), None
    for name, nodes in (("edges only", None), ("all nodes", t.laws.select("id"))):
        catalog.drop(name)
        n, e = catalog.project(name, t.edges, nodes)
        row = n.agg(F.count("*").alias("nodes")).join(e.agg(F.count("*").alias("edges"))).select(F.lit(name).alias("form"), "nodes", "edges")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query("g17_all_labels", "select 'Law' as label, count(*) as n from orders group by 1 union all select 'Section', count(*) from lineitem", tables=False)
def all_labels(t: Tables) -> DataFrame:
    return graph(t).all_nodes().groupBy("label").agg(F.count("*").alias("n"))


@query("g18_induced_subgraph", ", t as (select id from (select id, count(*) as n from (select src as id from edges union all select dst from edges) group by 1 order by 2 desc, 1 limit 50)) select src, dst, rel_type from edges where src in (from t) and dst in (from t)")
def induced(t: Tables) -> DataFrame:
    e = t.edges
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return M.induced(e, O.top(ends, 50, F.desc("n"), F.col("id")).select("id")).select("src", "dst", "rel_type")


@query("g19_to_undirected", "select count(*) as n from (select distinct least(src, dst) as a, greatest(src, dst) as b from edges)")
def to_undirected(t: Tables) -> DataFrame:
    return t.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().agg(F.count("*").alias("n"))
