"""The marketplace graph as DataFrames: vertices, edges, projections and iterative algorithms.

Vertices are (id, type); edges (src, dst, weight, avg_delay, edge_type), a
purchase from person to seller and the serving edge back; a person's id begins
with c: and a seller's is its own as text.  Iterations cut their
lineage in the shared checkpoint folder, and every tie goes to the smallest id.

Ids may be numbers in the order of the texts (`numbered`, `coded`): then edges take a
few bytes each, and sums and ties are those of numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators import lists
from quayside.operators.ranks import running_total
from quayside.plans.lineage import cut

TOP_PARTNERS = 25
CELL_CAP = 50
#: Sellers of one person that meet each other in one task.
TILE = 256
#: Neighbours of a vertex in one row of an adjacency, about.
CHUNK = 8192
#: Persons of a seller whose pairs are counted in one task, about.
SPREAD = 50_000
#: Sellers of a state that meet as many others in one task, about.
MEMBERS = 4096
#: Names, or vertices, up to which a join with them goes by broadcast.
NAMES = 500_000


def vertices(lines: DataFrame, person: str = "customer_unique_id", seller: str = "seller_id") -> DataFrame:
    people = lines.select(F.concat(F.lit("c:"), F.col(person)).alias("id")).distinct().withColumn("type", F.lit("customer"))
    sellers = lines.select(F.col(seller).cast("string").alias("id")).distinct().withColumn("type", F.lit("seller"))
    return people.unionByName(sellers)


def purchases(lines: DataFrame, person: str = "customer_unique_id", seller: str = "seller_id") -> DataFrame:
    """(c, s, weight, avg_delay) of each person and seller that met."""
    by = lines.groupBy(F.col(person).alias("c"), F.col(seller).alias("s")).agg(F.count("*").alias("weight"), F.avg("delay_days").alias("avg_delay"))
    return by.withColumns({"c": F.concat(F.lit("c:"), F.col("c")), "s": F.col("s").cast("string")})


def edges(lines: DataFrame, person: str = "customer_unique_id", seller: str = "seller_id") -> DataFrame:
    return both_ways(purchases(lines, person, seller))


def both_ways(pairs: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct(F.col("c").alias("src"), F.col("s").alias("dst"), F.lit("purchase").alias("edge_type")), F.struct(F.col("s").alias("src"), F.col("c").alias("dst"), F.lit("serves").alias("edge_type"))))
    return pairs.select("weight", "avg_delay", both.alias("e")).select("e.src", "e.dst", "weight", "avg_delay", "e.edge_type")


def numbered(ids: DataFrame) -> DataFrame:
    """(id, code): the distinct ids, which are no nulls, with dense numbers in their order."""
    placed = cut(ids.select("id").filter("id IS NOT NULL").distinct().orderBy("id").withColumn("at", F.monotonically_increasing_id()))
    part = placed.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    starts = part.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(ahead, F.lit(0)).alias("start"))
    return cut(part.join(F.broadcast(starts), "part").select("id", (F.col("start") + F.col("at")).cast("int").alias("code")))


def renamed(df: DataFrame, names: DataFrame, cols: list[str], key: str, value: str) -> DataFrame:
    """`df` with the values of `cols` looked up in `names`, null where there is none; up to NAMES names are broadcast."""
    names = names.select(F.col(key).alias("\x00k"), F.col(value).alias("\x00v"))
    few = names.limit(NAMES + 1).count() <= NAMES
    for c in cols:
        order = df.columns
        df = df.join(F.broadcast(names) if few else names, F.col(c) == F.col("\x00k"), "left").drop(c, "\x00k").withColumnRenamed("\x00v", c).select(*order)
    return df


def coded(pairs: DataFrame, others: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs with numbers for c and s, names of all, names of sellers) of purchases(); `others` are ids that get numbers beside them."""
    pairs = cut(pairs)
    ids = lambda c: pairs.select(F.col(c).alias("id")).distinct()
    sellers = cut(ids("s") if others is None else ids("s").union(others.select("id")).distinct())
    names = numbered(ids("c").union(sellers))
    known = cut(names.join(sellers, "id", "left_semi"))
    people = renamed(renamed(pairs, known, ["s"], "id", "code"), names, ["c"], "id", "code")
    return cut(people), names, known


def few(ids: DataFrame) -> bool:
    """Whether a value of each vertex may be broadcast."""
    return ids.limit(NAMES + 1).count() <= NAMES


def adjacency(edge: DataFrame, small: bool = False) -> DataFrame:
    """(src, out, dsts): the neighbours of a vertex in rows of about CHUNK, with the number of its edges; those of few() vertices are `small`."""
    out = edge.groupBy("src").agg(F.count("*").alias("out"))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("out") / CHUNK))
    return edge.select("src", "dst").join(F.broadcast(out) if small else out, "src").groupBy("src", "out", part.alias("part")).agg(F.collect_list("dst").alias("dsts")).drop("part")


def _told(linked: DataFrame, value: DataFrame, small: bool, *cols) -> DataFrame:
    """What each vertex of an adjacency tells its neighbours: a row an edge with its far end as id, and `cols`.  Values of few vertices go to the lists, which stay where they lie."""
    value = value.withColumnRenamed("id", "src")
    met = linked.join(F.broadcast(value) if small else value, "src")
    return met.select(F.explode("dsts").alias("id"), *cols)


def best(df: DataFrame, weight: str, id: str):
    """The aggregate of the id with the largest weight, the smallest id of equals; of numbered ids and counts it is the least of sums that hold both."""
    kinds = dict(df.dtypes)
    if kinds[id] == "int" and kinds[weight] in ("int", "bigint"):
        return F.pmod(F.min(F.col(id).cast("long") - F.col(weight) * F.lit(1 << 31)), F.lit(1 << 31)).cast("int")
    return F.min_by(id, F.struct(-F.col(weight), F.col(id)))


def endpoints(edge: DataFrame) -> DataFrame:
    return edge.select(F.col("src").alias("id")).union(edge.select(F.col("dst").alias("id"))).distinct()


def degree_stats(vertex: DataFrame, edge: DataFrame) -> DataFrame:
    """(id, in_degree_total, in_degree_purchase_only) of sellers, 0 where none."""
    by = edge.groupBy(F.col("dst").alias("id")).agg(
        F.count("*").alias("total"), F.count(F.when(F.col("edge_type") == "purchase", 1)).alias("purchases")
    )
    sellers = vertex.filter("type = 'seller'").select("id")
    return sellers.join(by, "id", "left").select("id", F.coalesce("total", F.lit(0)).alias("in_degree_total"), F.coalesce("purchases", F.lit(0)).alias("in_degree_purchase_only"))


def pagerank(edge: DataFrame, vertex: DataFrame | None = None, rounds: int = 10, reset: float = 0.15, cut_every: int = 5, linked: DataFrame | None = None) -> DataFrame:
    """(id, pagerank), unweighted, starting from 1 each; a vertex without incoming edges ends at `reset`.

    A round is a join of adjacency rows by source and a sum by destination, which
    combines on the map side, so a hub costs its task one row per other task.  An
    adjacency that is at hand may be given as `linked`.
    """
    ids = cut(endpoints(edge) if vertex is None else vertex.select("id").distinct())
    small = few(ids)
    linked = cut(adjacency(edge, small)) if linked is None else linked
    rank = ids.withColumn("pagerank", F.lit(1.0))
    for k in range(1, rounds + 1):
        heard = _told(linked, rank, small, (F.col("pagerank") / F.col("out")).alias("share")).groupBy("id").agg(F.sum("share").alias("heard"))
        rank = ids.join(heard, "id", "left").select("id", (F.lit(reset) + F.lit(1 - reset) * F.coalesce("heard", F.lit(0.0))).alias("pagerank"))
        if k % cut_every == 0:
            rank = cut(rank)
    return rank


def connected_components(edge: DataFrame, vertex: DataFrame | None = None, symmetric: bool = False, linked: DataFrame | None = None) -> DataFrame:
    """(id, component, component_size): the smallest id that paths reach, by minimum labels that also jump to their label's label.

    The edges of a `symmetric` table come in both directions already; its adjacency may be given as `linked`.
    """
    ids = endpoints(edge) if vertex is None else vertex.select("id").distinct()
    label = cut(ids.withColumn("component", F.col("id")))
    small = few(label)
    both = cut(adjacency(edge.select("src", "dst") if symmetric else edge.select("src", "dst").union(_turned(edge)).distinct(), small)) if linked is None else linked
    while True:
        heard = _told(both, label, small, "component").groupBy("id").agg(F.min("component").alias("heard"))
        met = label.join(heard, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        far = label.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = cut(met.join(far, "component", "left").select("id", "old", F.least("component", "far").alias("component")))
        moved = new.filter("component <> old").limit(1).count()
        label = new.select("id", "component")
        if not moved:
            break
    sizes = label.groupBy("component").agg(F.count("*").alias("component_size"))
    return label.join(sizes, "component").select("id", "component", "component_size")


def component_histogram(components: DataFrame) -> DataFrame:
    """Components by size class."""
    n = F.col("component_size")
    bins = F.when(n == 1, "1 (isolated)").when(n < 5, "2–4").when(n < 10, "5–9").when(n < 100, "10–99").otherwise("100+")
    return components.select("component", "component_size").distinct().groupBy(bins.alias("size_bin")).agg(F.count("*").alias("n_components"))


def label_propagation(edge: DataFrame, rounds: int = 5, linked: DataFrame | None = None) -> DataFrame:
    """(id, community, community_size): each round every vertex takes its neighbours' most frequent label, the smallest of equals.

    Of few vertices the labels go to lists of whom a vertex hears, so that its votes are
    counted where its list lies; in the first round, where all labels differ, the least
    neighbour wins unless an edge repeats.  The adjacency of edges that come in both
    directions may be given as `linked`.
    """
    ids = cut(endpoints(edge) if linked is None else linked.select(F.col("src").alias("id")).distinct())
    small = few(ids)
    if linked is None:
        linked = cut(adjacency(_turned(edge) if small else edge, small))
    label = ids.withColumn("community", F.col("id"))
    apart = small and not linked.filter("size(dsts) <> size(array_distinct(dsts))").limit(1).count()
    for k in range(rounds):
        if k == 0 and apart:
            top = linked.groupBy(F.col("src").alias("id")).agg(F.min(F.array_min("dsts")).alias("heard"))
        else:
            told = _heard(linked, label) if small else _told(linked, label, False, "community")
            votes = told.groupBy("id", "community").agg(F.count("*").alias("votes"))
            top = votes.groupBy("id").agg(best(votes, "votes", "community").alias("heard"))
        label = cut(label.join(top, "id", "left").select("id", F.coalesce("heard", "community").alias("community")))
    sizes = label.groupBy("community").agg(F.count("*").alias("community_size"))
    return label.join(sizes, "community").select("id", "community", "community_size")


def _turned(edge: DataFrame) -> DataFrame:
    return edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _heard(linked: DataFrame, label: DataFrame) -> DataFrame:
    """(id, community): the label of everyone in each vertex's list."""
    return linked.select(F.col("src").alias("id"), F.explode("dsts").alias("dst")).join(F.broadcast(label.withColumnRenamed("id", "dst")), "dst").select("id", "community")


def shared_customer_motifs(edge: DataFrame, tile: int = TILE) -> DataFrame:
    """(seller_a, seller_b, n_shared_customers) of sellers that served one person, a < b.

    A person's sellers in order tell each of them which ones come after it; these lists
    go to the seller that heads them and are counted there, so that a pair takes an id's
    bytes and no row on its way.  Over `tile` sellers of a person are cut into tiles, and
    each two tiles meet in a group of their own; a seller of very many persons is counted
    in parts.
    """
    serves = edge.filter("edge_type = 'serves' AND src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    per = serves.groupBy("dst").agg(F.count("*").alias("n"))
    sized = serves.join(per, "dst").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("src"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("src", "dst", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    side = lambda which, name: F.sort_array(F.collect_list(F.when(which, F.col("src")))).alias(name)
    met = dealt.groupBy("dst", "x", "y").agg(side(F.col("own") == F.col("x"), "a"), side(F.col("own") != F.col("x"), "b"))
    within = "transform(a, (v, i) -> struct(v AS head, slice(a, i + 2, size(a)) AS tail))"
    across = "concat(transform(a, v -> struct(v AS head, filter(b, u -> u > v) AS tail)), transform(b, v -> struct(v AS head, filter(a, u -> u > v) AS tail)))"
    tails = met.select("dst", F.explode(F.expr(f"CASE WHEN x = y THEN {within} ELSE {across} END")).alias("l")).select("dst", "l.head", "l.tail").filter("size(tail) > 0")
    busy = cut(serves.groupBy(F.col("src").alias("head")).agg(F.ceil(F.count("*") / SPREAD).alias("parts")).filter("parts > 1"))  # a row for SPREAD edges at most
    if busy.limit(1).count():
        spread = tails.join(F.broadcast(busy), "head", "left").withColumn("part", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1)))).repartition("head", "part")
    else:  # lists that lie by their head alone are counted for good where they meet
        spread = tails.select("head", "tail").repartition("head")
    pairs = spread.select(F.col("head").alias("seller_a"), F.explode("tail").alias("seller_b")).filter("seller_a < seller_b")
    return pairs.groupBy("seller_a", "seller_b").agg(F.count("*").alias("n_shared_customers"))


def mirrored(pairs: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """(src, dst, weight) in both directions."""
    turn = F.explode(F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst"))))
    return pairs.select(turn.alias("e"), F.col(weight).alias("weight")).select("e.src", "e.dst", "weight")


def cocustomer_edges(motifs: DataFrame, least: int = 2) -> DataFrame:
    return mirrored(motifs.filter(F.col("n_shared_customers") >= least), "seller_a", "seller_b", "n_shared_customers")


def backup_map(motifs: DataFrame) -> DataFrame:
    """(seller_id, backup_seller_id, backup_strength, n_cocustomer_partners): the partner with most shared customers."""
    both = mirrored(motifs, "seller_a", "seller_b", "n_shared_customers")
    return both.groupBy(F.col("src").alias("seller_id")).agg(
        best(both, "weight", "dst").alias("backup_seller_id"), F.max("weight").alias("backup_strength"), F.count("*").alias("n_cocustomer_partners")
    )


def two_hop_backups(edge: DataFrame, k: int | None = TOP_PARTNERS) -> DataFrame:
    """(seller_id, two_hop_reach_count, nearest_two_hop_seller) over the k strongest partners of each seller, or over all of them.

    Direct partners, capped or not, are no two-hop partners.  The nearest is the one
    behind the strongest bridge, which is the second hop's.  A seller's partners are a
    list from the strongest on; the lists of its strongest partners come to it, and what
    is left of them without its own is in the order of bridges already.
    """
    kinds = dict(edge.dtypes)
    if kinds["src"] == kinds["dst"] == "int" and kinds["weight"] in ("int", "bigint"):  # as in best()
        place, id_of = F.col("dst").cast("long") - F.col("weight") * F.lit(1 << 31), lambda x: F.pmod(x, F.lit(1 << 31)).cast("int")
    else:
        place, id_of = F.struct((-F.col("weight")).alias("w"), F.col("dst").alias("id")), lambda x: x["id"]
    known = edge.filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src").agg(F.sort_array(F.collect_list(place)).alias("by"))
    return _two_hops(cut(known.select("src", (F.col("by") if k is None else F.slice("by", 1, k)).alias("top"), F.transform("by", id_of).alias("direct"))), id_of)


def _two_hops(near: DataFrame, id_of) -> DataFrame:
    """two_hop_backups() of (src, top, direct): the strongest partners, sorted, and the ids of all."""
    one = near.select(F.col("src").alias("a"), F.explode(F.transform("top", id_of)).alias("b"))
    told = one.join(near.select(F.col("src").alias("b"), "top"), "b").groupBy("a").agg(F.sort_array(F.flatten(F.collect_list("top"))).alias("by"))
    met = told.join(near.select(F.col("src").alias("a"), "direct"), "a")
    far = met.select("a", F.array_except(F.array_distinct(F.transform("by", id_of)), F.array_append("direct", F.col("a"))).alias("far")).filter("size(far) > 0")
    return far.select(F.col("a").alias("seller_id"), F.size("far").cast("long").alias("two_hop_reach_count"), F.get("far", F.lit(0)).alias("nearest_two_hop_seller"))


def category_cells(items: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """(seller_id, seller_state, product_category_name, n_items) over all orders."""
    lines = items.join(products, "product_id", "left").join(sellers, "seller_id", "left")
    known = lines.filter("seller_state IS NOT NULL AND product_category_name IS NOT NULL")
    return known.groupBy("seller_id", "seller_state", "product_category_name").agg(F.count("*").alias("n_items"))


def catregion_edges(cells: DataFrame, cap: int | None = CELL_CAP) -> DataFrame:
    """(src, dst, weight): sellers by the number of state and category cells they share, of the `cap` largest sellers of a cell, or of all of them."""
    cell = ["seller_state", "product_category_name"]
    top = cells if cap is None else cells.withColumn("rn", F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("n_items"), "seller_id"))).filter(F.col("rn") <= cap)
    a, b = top.select(F.col("seller_id").alias("a"), *cell), top.select(F.col("seller_id").alias("b"), *cell)
    pairs = a.join(b, cell).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))
    return mirrored(pairs, "a", "b", "weight")


def catregion_backups(edge: DataFrame) -> DataFrame:
    return edge.groupBy(F.col("src").alias("seller_id")).agg(
        F.count_distinct("dst").alias("n_category_substitutes"),
        best(edge, "weight", "dst").alias("catregion_backup_seller_id"),
        F.max("weight").alias("catregion_backup_strength"),
    )


def category_signals(cells: DataFrame, members: int | None = None) -> DataFrame:
    """catregion_backups() over the pairs of all numbered sellers of a cell.

    A state's sellers are dealt to tiles, and each two tiles meet in a task that counts
    the categories of all their pairs as a product of matrices; no pair becomes a row.
    If sellers have several states, which no key of sellers allows, pairs are rows.
    """
    cells = cut(cells.select("seller_id", "seller_state", "product_category_name"))
    if cells.groupBy("seller_id").agg(F.count_distinct("seller_state").alias("n")).filter("n > 1").limit(1).count():
        return catregion_backups(catregion_edges(cells, None))
    kinds = numbered(cells.select(F.col("product_category_name").alias("id")))
    own = cut(renamed(cells, kinds, ["product_category_name"], "id", "code").groupBy("seller_state", "seller_id").agg(F.collect_list("product_category_name").alias("cells")))
    tiles = own.groupBy("seller_state").agg(F.ceil(F.count("*") / (members or MEMBERS)).cast("int").alias("tiles"))
    dealt = own.join(tiles, "seller_state").withColumn("tile", F.pmod(F.xxhash64("seller_id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("seller_state", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "seller_id", "cells")
    parts = dealt.groupBy("seller_state", "x", "y").applyInArrow(lists.shared_cells, "seller_id long, n long, by long")
    by = parts.groupBy("seller_id").agg(F.sum("n").alias("n"), F.min("by").alias("by"))
    return by.select(F.col("seller_id").cast("int").alias("seller_id"), F.col("n").alias("n_category_substitutes"), F.pmod("by", F.lit(lists.ONE)).cast("int").alias("catregion_backup_seller_id"), (-F.shiftright("by", 31)).alias("catregion_backup_strength"))


def bfs_backups(edge: DataFrame, seeds: DataFrame, vertex: DataFrame, max_hops: int = 3) -> DataFrame:
    """(seller_id, backup_seller_id, hop_count): the nearest other seller of each seed (a column id), the smallest id of equals.

    All seeds search at once: a level is one join of the frontier with the edges.
    """
    seeds = cut(seeds.select(F.col("id").alias("seed")).distinct())
    linked = edge.select("src", "dst").distinct()
    seen = frontier = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hop"))
    for hop in range(1, max_hops + 1):
        stepped = frontier.join(linked, frontier["id"] == linked["src"]).select("seed", F.col("dst").alias("id")).distinct()
        frontier = cut(stepped.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.union(frontier)
    sellers = vertex.filter("type = 'seller'").select("id")
    found = seen.filter("hop > 0").join(sellers, "id", "left_semi").groupBy("seed").agg(F.min(F.struct("hop", "id")).alias("best"))
    return seeds.join(found, "seed", "left").select(F.col("seed").alias("seller_id"), F.col("best.id").alias("backup_seller_id"), F.col("best.hop").alias("hop_count"))


def hop_distribution(backups: DataFrame) -> DataFrame:
    """(hops, n): seeds by the distance of their backup."""
    return backups.groupBy(F.coalesce(F.col("hop_count").cast("string"), F.lit("none")).alias("hops")).agg(F.count("*").alias("n"))


def largest_communities(members: DataFrame, n: int = 10) -> DataFrame:
    return members.groupBy("community").agg(F.max("community_size").alias("community_size")).orderBy(F.desc("community_size"), "community").limit(n)


def delayed_edges(edge: DataFrame, days: float = 5.0) -> DataFrame:
    return edge.filter(F.col("avg_delay") > days)


# --- fixed values: what a seller without a signal has -----------------------------
NETWORK_DEFAULTS = {
    "pagerank_score": 0.0, "in_degree": 0, "is_isolated": 0, "cocustomer_centrality": 0.0, "community_id": "-1", "backup_strength": 0,
    "n_cocustomer_partners": 0, "network_risk_score": 0.0, "two_hop_reach_count": 0, "n_category_substitutes": 0,
    "catregion_backup_strength": 0, "catregion_centrality": 0.0, "catregion_community_id": "-1",
}


def network_scores(vertex: DataFrame, edge: DataFrame, motifs: DataFrame, cat_edge: DataFrame, least: int = 2, k: int = TOP_PARTNERS, days: float = 5.0, rounds: int = 10, names: DataFrame | None = None) -> DataFrame:
    """The network signals of every seller, absent ones at their defaults; all parts are keyed alike, so the joins share a partitioning.

    `edge` comes in both directions.  With `names` of sellers, (id, code), all ids are numbers, which the names replace at the end.
    """
    named = lambda df, value, name: df.select(F.col("id").alias("seller_id"), F.col(value).alias(name))
    shared = cut(cocustomer_edges(motifs, least))
    late = delayed_edges(edge, days)
    # all but the late edges come in both directions, and their adjacency serves several signals
    small = few(vertex.filter("type = 'seller'"))
    served, met, near = cut(adjacency(edge, few(vertex))), cut(adjacency(shared, small)), cut(adjacency(cat_edge, small))
    ends = lambda linked: linked.select(F.col("src").alias("id"))
    parts = [
        named(pagerank(edge, vertex, rounds, linked=served), "pagerank", "pagerank_score"),
        named(degree_stats(vertex, edge), "in_degree_purchase_only", "in_degree"),
        named(connected_components(edge, vertex, True, served).withColumn("alone", F.when(F.col("component_size") == 1, 1).otherwise(0)), "alone", "is_isolated"),
        named(pagerank(late, None, rounds), "pagerank", "network_risk_score"),
        named(pagerank(shared, ends(met), rounds, linked=met), "pagerank", "cocustomer_centrality"),
        named(label_propagation(shared, linked=met), "community", "community_id"),
        backup_map(motifs),
        two_hop_backups(shared, k),
        named(pagerank(cat_edge, ends(near), rounds, linked=near), "pagerank", "catregion_centrality"),
        named(label_propagation(cat_edge, linked=near), "community", "catregion_community_id"),
        catregion_backups(cat_edge),
    ]
    return _scored(vertex.filter("type = 'seller'").select(F.col("id").alias("seller_id")), parts, names)


def index_signals(vertex: DataFrame, edge: DataFrame, motifs: DataFrame, cells: DataFrame, names: DataFrame, least: int = 2, days: float = 5.0, rounds: int = 10) -> DataFrame:
    """The signals that a risk index reads, of numbered sellers, by joins: two hops go over all partners and categories over all sellers of a cell."""
    named = lambda df, value, name: df.select(F.col("id").alias("seller_id"), F.col(value).alias(name))
    shared = cut(cocustomer_edges(motifs, least))
    parts = [
        named(pagerank(edge, vertex, rounds), "pagerank", "pagerank_score"),
        named(degree_stats(vertex, edge), "in_degree_purchase_only", "in_degree"),
        named(pagerank(delayed_edges(edge, days), None, rounds), "pagerank", "network_risk_score"),
        named(label_propagation(shared), "community", "community_id"),
        backup_map(motifs),
        two_hop_backups(shared, None).drop("nearest_two_hop_seller"),
        category_signals(cells),
    ]
    return _scored(vertex.filter("type = 'seller'").select(F.col("id").alias("seller_id")), parts, names)


def _scored(out: DataFrame, parts: list[DataFrame], names: DataFrame | None) -> DataFrame:
    """The signals of the sellers of `out`, with names for numbers and what follows from the signals."""
    for part in parts:
        out = out.join(part, "seller_id", "left")
    if names is not None:
        coded_ids = ["seller_id", "community_id", "backup_seller_id", "nearest_two_hop_seller", "catregion_community_id", "catregion_backup_seller_id"]
        out = renamed(cut(out), names, [c for c in coded_ids if c in out.columns], "code", "id")
    signals = ["seller_id", "pagerank_score", "in_degree", "is_isolated", "network_risk_score", "cocustomer_centrality", "community_id", "backup_seller_id", "backup_strength", "n_cocustomer_partners",
               "two_hop_reach_count", "nearest_two_hop_seller", "catregion_centrality", "catregion_community_id", "n_category_substitutes", "catregion_backup_seller_id", "catregion_backup_strength"]
    return (
        out.select(*[c for c in signals if c in out.columns]).fillna({c: v for c, v in NETWORK_DEFAULTS.items() if c in out.columns})
        .withColumn("substitutability_deficit", F.col("in_degree") / (1.0 + F.col("n_cocustomer_partners")))
        .withColumn("supply_concentration_risk", 1.0 / (1.0 + F.col("n_category_substitutes")))
    )


def network_of_lists(pairs: DataFrame, cat_edge: DataFrame | None, names: DataFrame, least: int = 2, k: int = TOP_PARTNERS, days: float = 5.0, rounds: int = 10, cells: DataFrame | None = None) -> DataFrame:
    """network_scores() of (c, s, avg_delay), a row for each person and numbered seller that met, and of category edges, both for few() sellers: lists of neighbours stay where they lie, and no edge of a round is a row.

    A seller's component is itself alone only if no person is at its other ends.  Sellers'
    outgoing edges come from the lists too, so that pairs are read once.  With `cells` of
    numbered sellers in place of `cat_edge` they are the signals of index_signals().
    """
    late = F.col("avg_delay") > days
    bought = lists.laid(
        pairs.groupBy("c").agg(
            F.collect_list("s").alias("sellers"), F.count("*").alias("out"), F.collect_list(F.when(late, F.col("s"))).alias("late"), F.count(F.when(late, 1)).alias("late_out")
        ),
        "sellers",
    )
    degree = lambda of, name: bought.select(F.explode(of).alias("s"), F.col("c").isNotNull().alias("met")).groupBy("s").agg(F.count("*").alias(name), F.count_if("met").alias(f"{name}_met"))
    own = degree("sellers", "in_degree").join(degree("late", "late_out"), "s", "left")
    own = cut(own.select("s", "in_degree", F.coalesce("late_out", F.lit(0)).alias("late_out"), F.when(F.col("in_degree_met") == 0, 1).otherwise(0).alias("is_isolated")))
    bought = bought.filter("c IS NOT NULL")
    spark, (ids, out, late_out) = bought.sparkSession, lists.column(own, "s", "in_degree", "late_out")
    slow = late_out > 0
    all_ranks = lists.pagerank_of_sellers(bought, "sellers", "out", ids, out, rounds)
    late_ranks = lists.pagerank_of_sellers(bought, "late", "late_out", ids[slow], late_out[slow], rounds)
    met = lists.laid(lists.ordered(lists.partners(bought, "sellers", TILE, SPREAD), least, k))
    shared = met.filter("size(dsts) > 0")
    named = lambda df, **cols: df.select(F.col("id").alias("seller_id"), *[F.col(c).alias(name) for c, name in cols.items()])
    parts = [
        lists.frame(spark, seller_id=ids, pagerank_score=all_ranks),
        lists.frame(spark, seller_id=ids[slow], network_risk_score=late_ranks),
        named(lists.label_propagation(shared), community="community_id"),
        met.select(F.col("src").alias("seller_id"), F.col("best").alias("backup_seller_id"), F.col("strength").alias("backup_strength"), F.col("n_partners").alias("n_cocustomer_partners")),
    ]
    sellers = own.select(F.col("s").alias("seller_id"), "in_degree", "is_isolated")
    if cells is not None:
        return _scored(sellers, [*parts, named(lists.two_hop_counts(shared), n="two_hop_reach_count"), category_signals(cells)], names)
    near = lists.laid(lists.ordered(cat_edge.groupBy("src").agg(F.collect_list(F.col("dst").cast("long") - F.col("weight") * F.lit(lists.ONE)).alias("by")), 1, 1))
    parts += [
        named(lists.pagerank(shared, rounds), pagerank="cocustomer_centrality"),
        _two_hops(shared.select("src", "top", F.col("dsts").alias("direct")), lambda x: F.pmod(x, F.lit(lists.ONE)).cast("int")),
        named(lists.pagerank(near, rounds), pagerank="catregion_centrality"),
        named(lists.label_propagation(near), community="catregion_community_id"),
        near.select(F.col("src").alias("seller_id"), F.col("n_partners").alias("n_category_substitutes"), F.col("best").alias("catregion_backup_seller_id"), F.col("strength").alias("catregion_backup_strength")),
    ]
    return _scored(sellers, parts, names)


def mean_ranks(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Average ranks of each column, ties shared, from counts of distinct values sorted in ranges; null has none."""
    out = df.select(key, *cols)
    for c in cols:
        counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"{c}_v")).agg(F.count("*").alias("n"))
        upto = running_total(counts, f"{c}_v", "n", "upto")
        ranks = upto.select(f"{c}_v", (F.col("upto") - (F.col("n") - 1) / 2).alias(f"{c}_rank"))
        out = out.join(ranks, out[c] == ranks[f"{c}_v"], "left").drop(f"{c}_v")
    return out


def degree_proxy_diagnostics(scores: DataFrame, base: str, signals: list[str], key: str = "seller_id") -> DataFrame:
    """(signal, pearson, spearman) of each signal with the base column."""
    from quayside.functions.columns import safe_corr

    ranked = mean_ranks(scores, key, [base, *signals])
    aggs = [a for i, s in enumerate(signals) for a in (safe_corr(F.col(base), F.col(s)).alias(f"p{i}"), safe_corr(F.col(f"{base}_rank"), F.col(f"{s}_rank")).alias(f"s{i}"))]
    pairs = ", ".join(f"'{s}', p{i}, s{i}" for i, s in enumerate(signals))
    return ranked.agg(*aggs).selectExpr(f"stack({len(signals)}, {pairs}) AS (signal, pearson, spearman)")
