"""Registered queries: each runs a library operator over whole driver tables.

``QUERIES`` maps a name to a callable (spark, sf_dir) -> DataFrame and ``ORACLE`` the
same name to the SQL another engine answers it with.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsgraph.functions import buckets as B
from oddsgraph.functions import fees, stats, text
from oddsgraph.operators import alerts, analytics, candidates, graph, pricing, proposals, reconcile, relations, screen
from oddsgraph.operators import episodes as ep
from oddsgraph.plans.projections import PROJECTIONS, ctes, project, read
from oddsgraph.scale import next_row
from oddsgraph.session import checkpoint_folder, cut, drop_at_end
from oddsgraph.sources import pages, tables
from oddsgraph.streaming import books, watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None, *views: str, extra: list[tuple[str, str]] = ()) -> Callable:
    """Register a function under its name, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            parts = [f"{name} as ({body})" for name, body in [*ctes(*views), *extra]]
            ORACLE[fn.__name__] = ("with recursive " + ", ".join(parts) + " " if parts else "") + sql
        return fn

    return add


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def r6(name: str, alias: str | None = None) -> Column:
    return F.round(F.col(name).cast("double"), 6).alias(alias or name)


def us(name: str, alias: str | None = None) -> Column:
    return F.unix_micros(name).alias(alias or name)


# --- shared inputs --------------------------------------------------------------------------


def ladder(spark: SparkSession, sf: str) -> DataFrame:
    """The stored ladder edges: written once, read by every branch of a query."""
    return cut(relations.ladder_edges(relations.ladder_rungs(project(spark, sf, "markets"))))


def stored_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return ladder(spark, sf).withColumn("id", relations.relation_id())


def partition_members(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, groups, quotes) of the order partitions."""
    rows = project(spark, sf, "partition_prices")
    groups = rows.select("group_id").distinct().select("group_id", F.lit("partition").alias("type"), F.lit("neg-risk-event").alias("source"))
    return rows.select("group_id", "condition_id"), groups, rows.select("condition_id", F.col("price").alias("yes_price"))


def market_tokens(markets: DataFrame) -> DataFrame:
    key = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    return markets.select(
        "*", F.array(F.concat(F.lit("y"), key), F.concat(F.lit("n"), key)).alias("clob_token_ids"),
        F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"),
    )


def all_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return ep.episodes(project(spark, sf, "checks"), tie=["event_id"])


LADDER_CTES = [
    ("points", "select event_id, p_type, p_size, min(condition_id) as lo, max(condition_id) as hi from markets group by 1, 2, 3"),
    ("steps", "select *, lead(lo) over w as nlo, lead(p_size) over w as nsize from points window w as (partition by event_id, p_type order by p_size)"),
    ("ladder", "select event_id, p_type, p_size, nsize, nlo as from_condition_id, hi as to_condition_id, sha256(concat(nlo, '|', hi, '|implies')) as id from steps where nlo is not null"),
]
EPISODE_CTES = [
    ("ex", "select *, sum(case when violated then 0 else 1 end) over (partition by constraint_key order by check_ts, event_id rows unbounded preceding) as s from checks where not unscreenable"),
    ("runs", "select *, case when violated then s else s - 1 end as run from ex"),
    ("ep0", """select constraint_key, run, count(*) filter (where violated) as checks, min(check_ts) filter (where violated) as detected_at,
        max(check_ts) filter (where violated) as last_bad, min(check_ts) filter (where not violated) as resolved_at, any_value(kind) as kind,
        any_value(first_condition_id) as first_condition_id, max(magnitude) filter (where violated) as peak_magnitude,
        arg_min(magnitude, check_ts) filter (where violated) as screen_magnitude, bool_or(violated and confirmed) as ever_confirmed,
        max(net_profit) filter (where violated) as peak_net_profit, max(net_edge) filter (where violated) as peak_net_edge,
        arg_max(reason, check_ts) filter (where violated) as reason from runs group by 1, 2"""),
    ("episodes", """select *, concat(constraint_key, '@', epoch_us(detected_at)) as episode_id, (epoch_us(resolved_at) - epoch_us(detected_at)) / 1e6 as life,
        case when resolved_at is not null then 'closed' when ever_confirmed then 'confirmed' else 'apparent' end as status from ep0 where checks > 0"""),
]


# --- constraint screen ----------------------------------------------------------------------

PART_EVAL = """select concat('partition:', group_id) as constraint_key, count(*) as members, abs(sum(price) - 1) as magnitude, sum(price) as total
    from partition_prices group by group_id having count(*) > 1"""


@query(
    """select constraint_key, members, round(magnitude, 6) as magnitude, round(total, 6) as total,
       case when magnitude <= 0.005 then 'none' when total > 1 then 'over' else 'under' end as direction from e""",
    "partition_prices", extra=[("e", PART_EVAL)],
)
def screen_partitions(spark, sf):
    members, _, quotes = partition_members(spark, sf)
    keyed = members.select(
        F.concat(F.lit("partition:"), "group_id").alias("constraint_key"), F.lit("partition").alias("kind"),
        F.lit(0).alias("pos"), "condition_id",
    )
    e = screen.evaluate(screen.attach_prices(keyed, screen.cached_quotes(quotes)))
    return e.select("constraint_key", "members", r6("magnitude"), r6("total"), F.coalesce("direction", F.lit("none")).alias("direction"))


@query(
    """select constraint_key, round(magnitude, 6) as gross_edge from e where magnitude > 0.005""",
    "partition_prices", extra=[("e", PART_EVAL)],
)
def screen_worst(spark, sf):
    rows = project(spark, sf, "partition_prices")
    priced = rows.select(F.concat(F.lit("partition:"), "group_id").alias("constraint_key"), F.lit("partition").alias("kind"), F.lit(0).alias("pos"), "condition_id", "price")
    e = screen.evaluate(priced).withColumn("magnitude", F.round("magnitude", 9))
    return screen.promote(e).select("constraint_key", r6("gross_edge"))


IMPLIES_EVAL = [
    ("pair", """select l.id, l.from_condition_id, l.to_condition_id, f.yes_price - t.yes_price as magnitude
        from ladder l join markets f on f.condition_id = l.from_condition_id and not f.closed join markets t on t.condition_id = l.to_condition_id and not t.closed"""),
]


def implies_evaluations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    markets = project(spark, sf, "markets")
    edges = stored_ladder(spark, sf)
    none = markets.where("false")
    members = screen.constraint_members(
        edges, none.select(F.col("event_id").alias("group_id"), F.lit("partition").alias("type")),
        none.select(F.col("event_id").alias("group_id"), "condition_id"), markets,
    )
    prices = screen.screen_prices(markets.withColumn("clob_token_ids", F.array()), markets)
    return screen.evaluate(screen.attach_prices(members, prices)), members, markets


@query(
    "select concat('implies:', id) as constraint_key, round(magnitude, 6) as magnitude, magnitude > 0.005 as violated from pair",
    "markets", extra=LADDER_CTES + IMPLIES_EVAL,
)
def screen_implications(spark, sf):
    return implies_evaluations(spark, sf)[0].select("constraint_key", r6("magnitude"), "violated")


@query(
    "select count(*) as evaluated, count(*) filter (where magnitude <= 0.005) as satisfied, count(*) filter (where magnitude > 0.005) as violated, 0 as unscreenable from pair",
    "markets", extra=LADDER_CTES + IMPLIES_EVAL,
)
def screen_stats(spark, sf):
    return screen.screen_stats(implies_evaluations(spark, sf)[0])


@query(
    """select concat('implies:', id) as constraint_key, condition_id, outcome_index, 1.0::double as payout from pair,
       lateral (values (from_condition_id, 1), (to_condition_id, 0)) as x(condition_id, outcome_index) where magnitude > 0.005""",
    "markets", extra=LADDER_CTES + IMPLIES_EVAL,
)
def basket_legs(spark, sf):
    e, members, _ = implies_evaluations(spark, sf)
    return screen.basket_legs(screen.promote(e, None), members).select("constraint_key", "condition_id", "outcome_index", "payout")


@query(
    """select m.condition_id, case when t.mid is not null then 'live' else 'cached' end as price_source, round(coalesce(t.mid, m.yes_price), 6) as price
       from markets m left join (select substr(token_id, 2) as k, (max(price) filter (where side = 'bid') + min(price) filter (where side = 'ask')) / 2 as mid
       from levels where token_id like 'y%' group by 1) t on substr(m.condition_id, 2) = t.k""",
    "markets", "levels",
)
def price_resolution(spark, sf):
    markets = market_tokens(project(spark, sf, "markets"))
    top = pricing.top_of_levels(project(spark, sf, "levels"))
    return screen.screen_prices(markets, markets, top).select("condition_id", "price_source", r6("price"))


# --- relations ------------------------------------------------------------------------------


@query(
    """select condition_id, event_id as scope, lower(concat('will ', p_type, ' index')) as subject, 'gt' as direction, 'usd' as unit,
       p_size * 1000.0::double as threshold, 'on september 4' as date_key from markets""",
    "markets",
)
def parse_thresholds(spark, sf):
    return relations.ladder_rungs(project(spark, sf, "markets")).select(
        "condition_id", "scope", "subject", "direction", "unit", "threshold", "date_key"
    )


@query("select from_condition_id, to_condition_id, id from ladder", "markets", extra=LADDER_CTES)
def ladder_edges(spark, sf):
    return stored_ladder(spark, sf).select("from_condition_id", "to_condition_id", "id")


@query(
    """select (select count(*) from markets) as considered, (select count(*) from markets) as parsed,
       (select cast(sum(n) as bigint) from (select count(*) n from markets group by event_id, p_type having count(*) > 1)) as in_ladders,
       (select count(*) from (select 1 from markets group by event_id, p_type having count(*) > 1)) as ladders,
       (select count(*) from ladder) as edges""",
    "markets", extra=LADDER_CTES,
)
def ladder_stats(spark, sf):
    return relations.ladder_stats(project(spark, sf, "markets"))


@query(
    """select hi as from_condition_id, nlo as to_condition_id from (select *, lead(lo) over (partition by subject order by end_date) as nlo from
       (select regexp_replace(lower(question), ' by [0-9]+.$', '') as subject, end_date, min(condition_id) as lo, max(condition_id) as hi from deadlines group by 1, 2)) where nlo is not null and nlo <> hi""",
    "deadlines",
)
def deadline_edges(spark, sf):
    rungs = relations.deadline_rungs(project(spark, sf, "deadlines"))
    return relations.deadline_edges(rungs).select("from_condition_id", "to_condition_id")


@query(
    """select least(n.condition_id, p.condition_id) as from_condition_id, greatest(n.condition_id, p.condition_id) as to_condition_id
       from negations n join (select event_id, question, min(condition_id) as condition_id from negations group by 1, 2 having count(*) = 1) p
       on n.event_id = p.event_id and replace(n.question, ' not ', ' ') = p.question and n.question like '% not %'
       group by 1, 2 having count(*) = 1""",
    "negations",
)
def complements(spark, sf):
    return relations.complement_edges(project(spark, sf, "negations")).select("from_condition_id", "to_condition_id")


def flagged_partitions(spark: SparkSession, sf: str) -> relations.Partitions:
    markets = market_tokens(project(spark, sf, "markets"))
    events = markets.select(F.col("event_id").alias("id"), F.col("event_id").alias("title"), F.col("event_id").startswith("Brand#1").alias("neg_risk")).distinct()
    return relations.partitions(markets, events)


@query(
    "select concat('partition:neg-risk-event:', event_id) as group_id, count(*) as members from markets where event_id like 'Brand#1%' group by 1 having count(*) > 1",
    "markets",
)
def partitions(spark, sf):
    return flagged_partitions(spark, sf).groups.select("group_id", "members")


@query(
    "select concat('partition:neg-risk-event:', event_id) as partition_key, from_condition_id, to_condition_id from ladder where event_id like 'Brand#1%'",
    "markets", extra=LADDER_CTES,
)
def partition_conflicts(spark, sf):
    parts = flagged_partitions(spark, sf)
    return relations.partition_conflicts(parts.groups, parts.members, ladder(spark, sf)).select(
        "partition_key", "from_condition_id", "to_condition_id"
    )


def extraction(spark: SparkSession, sf: str) -> relations.Extraction:
    markets = market_tokens(project(spark, sf, "markets"))
    events = markets.select(F.col("event_id").alias("id"), F.col("event_id").alias("title"), F.col("event_id").startswith("Brand#1").alias("neg_risk")).distinct()
    return relations.extract_relations(markets.withColumn("end_date", F.lit(None).cast("timestamp")), events)


@query("select from_condition_id, to_condition_id from ladder where event_id not like 'Brand#1%'", "markets", extra=LADDER_CTES)
def consistent_relations(spark, sf):
    return extraction(spark, sf).consistent_edges().select("from_condition_id", "to_condition_id")


@query(
    """select (select count(*) from ladder) as ladder_edges, 0 as temporal_edges, 0 as complement_edges,
       (select count(distinct event_id) from markets where event_id like 'Brand#1%') as partitions,
       (select count(*) from markets where event_id like 'Brand#1%') as partition_members,
       (select count(*) from ladder where event_id like 'Brand#1%') as conflicts""",
    "markets", extra=LADDER_CTES,
)
def extraction_stats(spark, sf):
    return extraction(spark, sf).stats()


@query(
    """select hi as a_condition_id, nlo as b_condition_id from (select *, lead(lo) over w as nlo, lead(p_size) over w as nlow from
       (select event_id, p_type, p_size, min(condition_id) as lo, max(condition_id) as hi from band_markets group by 1, 2, 3)
       window w as (partition by event_id, p_type order by p_size)) where p_size + 2 <= nlow""",
    "band_markets",
)
def exclusive_bands(spark, sf):
    return relations.exclusive_neighbours(project(spark, sf, "band_markets")).select("a_condition_id", "b_condition_id")


@query(
    """select a.condition_id as a_condition_id, b.condition_id as b_condition_id from band_markets a join band_markets b
       on a.event_id = b.event_id and a.p_type = b.p_type and (a.p_size < b.p_size or (a.p_size = b.p_size and a.condition_id < b.condition_id)) and b.p_size < a.p_size + 2""",
    "band_markets",
)
def overlapping_bands(spark, sf):
    return relations.overlapping_bands(project(spark, sf, "band_markets")).select("a_condition_id", "b_condition_id")


LINES_AT_ONCE = 500_000
"""Order lines that a task of verified_exclusions gets, on average."""
BAND_PROPOSALS = """
    select concat('b', lpad(cast(l_partkey as string), 8, '0')) as a_condition_id,
           concat('b', lpad(cast(l_partkey + l_linenumber * 25 as string), 8, '0')) as b_condition_id, count(*) as times
    from {lineitem} group by 1, 2"""


@query(
    """select finding, count(*) as pairs, sum(times)::bigint as times from (
         select times, case when a.condition_id is null or b.condition_id is null then 'unproven' when a.event_id <> b.event_id or a.p_type <> b.p_type then 'unrelated'
           when a.p_size + 2 <= b.p_size or b.p_size + 2 <= a.p_size then 'exclusive' else 'overlapping' end as finding
         from proposed left join band_markets a on a.condition_id = a_condition_id left join band_markets b on b.condition_id = b_condition_id) group by 1""",
    "band_markets", extra=[("proposed", BAND_PROPOSALS.replace("{lineitem}", "lineitem"))],
)
def verified_exclusions(spark, sf):
    """What the questions say of proposed exclusions: proven, refuted, of different families, or without a band."""
    lines = read(spark, sf, "lineitem").select("l_partkey", "l_linenumber")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES_AT_ONCE))
    # Counted as numbers first; names are cut to eight digits, so those are counted again.
    lines = lines.repartition(parts, "l_partkey", "l_linenumber").groupBy("l_partkey", "l_linenumber").agg(F.count("*").alias("n"))
    name = lambda key: F.concat(F.lit("b"), F.lpad(key.cast("string"), 8, "0"))
    named = lines.select(name(F.col("l_partkey")).alias("a_condition_id"), name(F.col("l_partkey") + F.col("l_linenumber") * 25).alias("b_condition_id"), "n")
    proposed = named.repartition(parts, "a_condition_id").groupBy("a_condition_id", "b_condition_id").agg(F.sum("n").alias("times"))
    found = relations.verify_exclusive(proposed, project(spark, sf, "band_markets"), parts)
    return found.groupBy("finding").agg(F.count("*").alias("pairs"), F.sum("times").alias("times"))


@query(
    """select (select count(*) from ladder) as submitted, count(*) filter (where not known) as inserted, count(*) filter (where known) as refreshed, 0 as rejected
       from (select l.*, p_size >= 25 as known from ladder l)""",
    "markets", extra=LADDER_CTES,
)
def relation_upsert(spark, sf):
    """Edges whose lower rung is 25 or more are stored already; all are submitted."""
    markets = project(spark, sf, "markets")
    edges = ladder(spark, sf)
    size = markets.where("p_size >= 25").select(F.col("condition_id").alias("to_condition_id"))
    stored = edges.join(size, "to_condition_id", "left_semi").select(
        relations.relation_id().alias("id"), *relations.EDGE_COLUMNS, now().alias("first_seen_at"), now().alias("last_seen_at")
    )
    return relations.save_edges(stored, edges, now())[1]


@query(
    """select group_id, condition_id from (select event_id as group_id, condition_id from markets where event_id like 'Brand#1%'
       union select event_id, condition_id from markets where event_id not like 'Brand#1%' and p_size <= 25)""",
    "markets",
)
def group_upsert(spark, sf):
    """Stored groups hold the small rungs; flagged events are replaced by their full membership."""
    markets = project(spark, sf, "markets")
    stored_members = markets.where("p_size <= 25").select(F.col("event_id").alias("group_id"), "condition_id")
    columns = [F.lit(v).alias(c) for c, v in (("type", "partition"), ("source", "neg-risk-event"), ("confidence", 1.0), ("rationale", "r"))]
    stored = stored_members.select("group_id").distinct().select("group_id", *columns, now().alias("first_seen_at"), now().alias("last_seen_at"))
    fresh = markets.where(F.col("event_id").startswith("Brand#1")).select(F.col("event_id").alias("group_id"), "condition_id")
    groups = fresh.select("group_id").distinct().select("group_id", *columns)
    return relations.save_groups(stored, stored_members, groups, fresh, now())[1]


#: Documents with a keyword of one category, or of two (the first listed wins), by doc_id; letters beyond ASCII end no word here.
TOPIC = """select doc_id as condition_id, concat(regexp_replace(text, '[^ -~]', 'x'{all}), ' ', case doc_id % 7 when 0 then 'the NBA playoff' when 1 then 'bitcoin halving'
       when 2 then 'CPI inflation' when 3 then 'a senate vote' when 4 then 'bitcoin election' when 5 then 'nasdaq congress' else '' end) as text from {documents}"""


@query(
    "select condition_id, case " + " ".join(f"when regexp_matches(text, '{pattern}') then '{name}'" for name, pattern in text.CATEGORIES)
    + " else 'other' end as category from (" + TOPIC.format(all=", 'g'", documents="documents") + ")",
)
def document_categories(spark, sf):
    docs = spark.sql(TOPIC.format(all="", documents="{docs}"), docs=read(spark, sf, "documents"))
    return docs.select("condition_id", text.category(F.col("text"), F.lit(None).cast("string")).alias("category"))


# --- graph ----------------------------------------------------------------------------------

LADDER_CLOSURE = [
    ("edge", "select from_condition_id as src, to_condition_id as dst from ladder"),
    ("closure", "select src, dst from edge union select c.src, e.dst from closure c join edge e on e.src = c.dst"),
]


@query(
    "select src as start, dst as node from closure where src not in (select dst from edge)",
    "markets", extra=LADDER_CTES + LADDER_CLOSURE,
)
def ladder_descendants(spark, sf):
    """Everything the strongest rung of each ladder implies."""
    edges = graph.implication_edges(ladder(spark, sf))
    roots = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    return graph.descendants(graph.reach_index(edges), roots).select("start", "node")


PAIRS_SQL = "select a.condition_id as src, b.condition_id as dst from markets a join markets b on b.p_partkey = a.p_partkey + 25"


@query("select p.src, p.dst from pairs p join closure c on p.src = c.src and p.dst = c.dst", "markets", extra=LADDER_CTES + LADDER_CLOSURE + [("pairs", PAIRS_SQL + " union " + PAIRS_SQL.replace("a.condition_id as src, b.condition_id as dst", "b.condition_id as src, a.condition_id as dst"))])
def reachable_pairs(spark, sf):
    """Of given market pairs, the ones connected by implications, either way round."""
    markets = project(spark, sf, "markets").select("condition_id", "p_partkey")
    other = markets.select(F.col("condition_id").alias("dst"), (F.col("p_partkey") - 25).alias("p_partkey"))
    pairs = markets.join(other, "p_partkey").select(F.col("condition_id").alias("src"), "dst")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.reachable(graph.reach_index(graph.implication_edges(ladder(spark, sf))), both)


SKIPS = [
    ("edge", """select from_condition_id as src, to_condition_id as dst from ladder union
        select a.from_condition_id, b.to_condition_id from ladder a join ladder b on a.to_condition_id = b.from_condition_id"""),
    ("closure", "select src, dst from edge union select c.src, e.dst from closure c join edge e on e.src = c.dst"),
]


def skip_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Ladder edges plus the shortcut over each next rung."""
    edges = graph.implication_edges(ladder(spark, sf))
    over = edges.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
    return edges.unionByName(over).distinct()


@query(
    "select src, dst from edge e where not exists (select 1 from edge m join closure c on c.src = m.dst where m.src = e.src and m.dst <> e.dst and c.dst = e.dst)",
    "markets", extra=LADDER_CTES + SKIPS,
)
def transitive_reduction(spark, sf):
    return graph.transitive_reduction(skip_edges(spark, sf)).select("src", "dst")


@query(
    """select node, max(level) as level from (select src as node, 0 as level from edge union all select dst, 0 from edge union all select node, level from walk) group by 1""",
    "markets",
    extra=LADDER_CTES + SKIPS[:1] + [("walk", "select dst as node, 1 as level from edge where src not in (select dst from edge) union select e.dst, w.level + 1 from walk w join edge e on e.src = w.node")],
)
def topological_levels(spark, sf):
    return graph.topological_levels(skip_edges(spark, sf)).select("node", F.col("level").cast("int").alias("level"))


CYCLE_CTES = [
    ("edge", "select distinct from_condition_id as src, to_condition_id as dst from customer_edges where from_condition_id <> to_condition_id"),
    ("closure", "select src, dst from edge union select c.src, e.dst from closure c join edge e on e.src = c.dst"),
    ("comp", "select src as node, min(dst) as component from (select a.src, a.dst from closure a join closure b on a.src = b.dst and a.dst = b.src) group by 1"),
]


# Each node leads to the next two of its line, so no node can be contracted and paths are as long as a line.
LINES = [
    ("placed", "select *, row_number() over (partition by line order by position) as r from order_line"),
    ("ties", "select a.node as lo, b.node as hi, a.line, a.r from placed a join placed b on a.line = b.line and b.r = a.r + 1"),
]


def line_edges(spark: SparkSession, sf: str) -> DataFrame:
    line = project(spark, sf, "order_line").select("node", "line", "position")
    once = next_row(line, ["line"], "position", ["node"])
    twice = next_row(once, ["line"], "position", ["next_node"], prefix="after_")
    return twice.select(F.col("node").alias("src"), F.explode(F.array("next_node", "after_next_node")).alias("dst")).where("dst is not null")


@query("select node, r - 1 as level from placed", "order_line", extra=LINES[:1])
def deep_levels(spark, sf):
    """Longest distances where the longest path is as long as a third of the table."""
    return graph.topological_levels(line_edges(spark, sf)).select("node", "level")


@query(
    """select a.node as src, b.node as dst from order_line a join order_line b on a.customer = b.customer and a.line = b.line and a.position < b.position""",
    "order_line",
)
def deep_reachable(spark, sf):
    """Of all pairs of orders of one customer, the ones connected over any number of steps."""
    line = project(spark, sf, "order_line")
    pairs = line.select(F.col("node").alias("src"), "customer").join(line.select(F.col("node").alias("dst"), "customer"), "customer").where("src <> dst")
    return graph.reachable(graph.reach_index(line_edges(spark, sf)), pairs)


@query(
    """select node, min(case when not tied then node end) over (partition by line, island) as component from (
         select *, sum(case when tied then 0 else 1 end) over (partition by line order by r) as island from (
           select *, coalesce(lag(bound) over (partition by line order by r), false) as tied from (
             select p.node, p.line, p.r, exists (select 1 from placed b where b.line = p.line and b.returns and b.r > 3 and b.r between p.r + 1 and p.r + 3) as bound from placed p)))
       qualify count(*) over (partition by line, island) > 1""",
    "order_line", extra=LINES[:1],
)
def deep_cycles(spark, sf):
    """Lines where some orders lead back three places: many small cycles on paths of any length."""
    line = project(spark, sf, "order_line")
    back = next_row(line.withColumn("before", -F.col("position")), ["line"], "before", ["node"])
    for _ in range(2):
        back = next_row(back.withColumnRenamed("next_node", "step"), ["line"], "before", ["step"]).withColumnRenamed("next_step", "next_node").drop("step")
    back = back.where(F.col("returns") & F.col("next_node").isNotNull()).select(F.col("node").alias("src"), F.col("next_node").alias("dst"))
    return graph.cycle_components(line_edges(spark, sf).unionByName(back))


@query("select node, component from comp", "customer_edges", extra=CYCLE_CTES)
def cycle_components(spark, sf):
    return graph.cycle_components(project(spark, sf, "customer_edges"))


@query(
    """select src, dst from edge where not (src in (select node from comp) and dst in (select node from comp))""",
    "customer_edges", extra=CYCLE_CTES,
)
def acyclic_edges(spark, sf):
    """Edges kept when cycles are tolerated."""
    edges = project(spark, sf, "customer_edges")
    none = edges.where("false").select(F.col("type").alias("group_id"), F.col("type").alias("condition_id"))
    return graph.implication_edges(graph.build_graph(edges, none, tolerate_cycles=True).implies)


@query(
    """select (select count(*) from (select src from e0 union select dst from e0)) as nodes,
       (select count(*) from edge where not (src in (select node from comp) and dst in (select node from comp))) as implies_edges,
       (select count(*) from edge where not (src in (select node from comp) and dst in (select node from comp))) as reduced_edges,
       0 as complement_edges, 0 as partitions, (select count(distinct component) from comp) as cycles_found,
       (select count(*) from edge where src in (select node from comp) and dst in (select node from comp)) as cycles_dropped""",
    "customer_edges", extra=CYCLE_CTES + [("e0", "select src, dst from edge")],
)
def graph_stats(spark, sf):
    edges = project(spark, sf, "customer_edges")
    none = edges.where("false").select(F.col("type").alias("group_id"), F.col("type").alias("condition_id"))
    return graph.build_graph(edges, none, tolerate_cycles=True).stats


RELATED = [
    ("opposites", """select min(least(n.condition_id, p.condition_id)) as low, min(greatest(n.condition_id, p.condition_id)) as high
       from negations n join (select event_id, question, min(condition_id) as condition_id from negations group by 1, 2 having count(*) = 1) p
       on n.event_id = p.event_id and replace(n.question, ' not ', ' ') = p.question and n.question like '% not %'
       group by least(n.condition_id, p.condition_id), greatest(n.condition_id, p.condition_id) having count(*) = 1"""),
    ("roots", "select distinct src as root from edge where src not in (select dst from edge)"),
    ("peers", "select condition_id as id, concat(event_id, p_type) as grp from markets where p_size > 45"),
]


@query(
    """select c.src as condition_id, c.dst as related_id, 'implies' as relation, case when e.src is not null then 'ladder' else 'transitive' end as source, e.src is not null as direct
       from closure c join roots on c.src = root left join (select distinct src, dst from edge) e on e.src = c.src and e.dst = c.dst
       union all select root, high, 'complement', 'complement', true from opposites join roots on low = root
       union all select root, low, 'complement', 'complement', true from opposites join roots on high = root
       union all select root, b.id, 'partition', 'neg-risk-event', true from roots join peers a on a.id = root join peers b on a.grp = b.grp and a.id <> b.id""",
    "markets", "negations", extra=LADDER_CTES + LADDER_CLOSURE + RELATED,
)
def related_markets(spark, sf):
    """Relations of the strongest rung of every ladder. Large sizes of a type form partitions."""
    edges = ladder(spark, sf).unionByName(relations.complement_edges(project(spark, sf, "negations")))
    peers = project(spark, sf, "markets").where("p_size > 45").select(F.concat("event_id", "p_type").alias("group_id"), "condition_id")
    built = graph.build_graph(edges, peers, tolerate_cycles=True)
    pairs = graph.implication_edges(built.implies)
    roots = pairs.select(F.col("src").alias("condition_id")).distinct().join(
        pairs.select(F.col("dst").alias("condition_id")).distinct(), "condition_id", "left_anti"
    )
    return graph.related_markets(built, roots)


# --- candidates -----------------------------------------------------------------------------

KNN_CTES = [
    ("near", """select * from (select a.condition_id as s, b.condition_id as t, a.event_id, sim, row_number() over (partition by a.condition_id order by sim desc, cast(b.condition_id as string)) as rn
        from vectors a join vectors b on a.event_id = b.event_id and a.condition_id <> b.condition_id,
        lateral (select round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as sim) where sim >= 0.25) where rn <= 8"""),
    ("pair", "select least(cast(s as string), cast(t as string)) as low_condition_id, greatest(cast(s as string), cast(t as string)) as high_condition_id, max(sim) as similarity from near group by 1, 2"),
]


def knn_pairs_of(spark: SparkSession, sf: str) -> DataFrame:
    near = candidates.nearest_neighbours(project(spark, sf, "vectors"), threshold=0.25)
    return candidates.fold_pairs(near, 0.25)


@query("select low_condition_id, high_condition_id, round(similarity, 6) as similarity from pair", "vectors", extra=KNN_CTES)
def knn_pairs(spark, sf):
    return knn_pairs_of(spark, sf).select("low_condition_id", "high_condition_id", r6("similarity"))


@query(
    "select low_condition_id, high_condition_id, round(similarity, 6) as similarity from pair", "vectors",
    extra=[(name, body.replace("a.event_id = b.event_id and ", "")) for name, body in KNN_CTES],
)
def knn_everywhere(spark, sf):
    """Neighbours whatever their event, in cells small enough that the tree divides a small table too."""
    near = candidates.nearest_neighbours(project(spark, sf, "vectors"), threshold=0.25, same_event=False, block_rows=96)
    return candidates.fold_pairs(near, 0.25).select("low_condition_id", "high_condition_id", r6("similarity"))


CANDIDATE_CTES = KNN_CTES + [
    ("peers", "select cast(condition_id as string) as id, concat(event_id, '-', cast(condition_id % 3 as string)) as grp from vectors where cast(event_id as int) >= 7"),
    ("rel", "select cast(condition_id as string) as src, cast(lead(condition_id) over (partition by event_id order by condition_id) as string) as dst from vectors where cast(event_id as int) < 5"),
    ("chain", "select src, dst from rel where dst is not null union select c.src, r.dst from chain c join rel r on r.src = c.dst where r.dst is not null"),
]


@query(
    """select low_condition_id, high_condition_id, round(similarity, 6) as similarity from pair p
       where not exists (select 1 from chain where (src = low_condition_id and dst = high_condition_id) or (src = high_condition_id and dst = low_condition_id))
       and not exists (select 1 from benchmark b where cast(b.item_id as string) = low_condition_id)
       and not exists (select 1 from peers a join peers b on a.grp = b.grp where a.id = low_condition_id and b.id = high_condition_id)
""",
    "vectors", extra=CANDIDATE_CTES,
)
def candidate_pairs(spark, sf):
    """The similar pairs nothing explains yet. Labels below 5 form implication chains, labels from 7
    partitions; pairs whose low id is a benchmark item were proposed before."""
    vectors = project(spark, sf, "vectors")
    chain = next_row(vectors.where(F.col("event_id").cast("int") < 5).select("event_id", "condition_id"), ["event_id"], "condition_id", ["condition_id"])
    chain = chain.where(F.col("next_condition_id").isNotNull()).select(
        F.col("condition_id").cast("string").alias("from_condition_id"), F.col("next_condition_id").cast("string").alias("to_condition_id"), F.lit("implies").alias("type")
    )
    pairs = knn_pairs_of(spark, sf)
    items = read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("low_condition_id"))
    known = pairs.join(items, "low_condition_id", "left_semi")
    members = vectors.where(F.col("event_id").cast("int") >= 7).select(
        F.concat_ws("-", "event_id", F.col("condition_id") % 3).alias("group_id"), F.col("condition_id").cast("string").alias("condition_id")
    )
    left = candidates.uncovered_pairs(pairs, chain, members, known)
    return candidates.ordered_candidates(left).select("low_condition_id", "high_condition_id", r6("similarity"))


@query(
    """select low_condition_id, high_condition_id from pair order by md5(concat(low_condition_id, high_condition_id)) limit 200""",
    "vectors", extra=KNN_CTES,
)
def candidate_sample(spark, sf):
    return candidates.ordered_candidates(knn_pairs_of(spark, sf), 200, "spread").select("low_condition_id", "high_condition_id")


@query(
    """select d.doc_id as condition_id from documents d left join labels l on d.doc_id = l.doc_id where l.quality is null or l.quality = 0""",
)
def stale_embeddings(spark, sf):
    """Documents whose stored vector is missing or made from other content (quality 0)."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("condition_id"), F.col("text").alias("question"), F.md5("text").alias("content_hash"))
    labels = read(spark, sf, "labels").select(F.col("doc_id").alias("condition_id"), "quality")
    stored = docs.join(labels, "condition_id").select(
        "condition_id", F.lit("m1").alias("model"), F.when(F.col("quality") == 1, F.col("content_hash")).otherwise(F.md5(F.concat("content_hash", F.lit("x")))).alias("content_hash"),
    )
    return candidates.stale_embeddings(docs, stored, "m1").select("condition_id")


# --- proposals ------------------------------------------------------------------------------

PROPOSAL_CTES = [
    ("canon", """select least(a_condition_id, b_condition_id) as low_condition_id, greatest(a_condition_id, b_condition_id) as high_condition_id, arrival,
        case when a_condition_id > b_condition_id and relation = 'implies' then 'implied_by' when a_condition_id > b_condition_id and relation = 'implied_by' then 'implies' else relation end as proposed_type,
        confidence from proposals_in where a_condition_id <> b_condition_id"""),
    ("last", "select low_condition_id, high_condition_id, arg_max(proposed_type, arrival) as proposed_type, arg_max(confidence, arrival) as c from canon group by 1, 2"),
]


@query("select low_condition_id, high_condition_id, proposed_type, round(c, 6) as model_confidence from last", "proposals_in", extra=PROPOSAL_CTES)
def saved_proposals(spark, sf):
    rows = project(spark, sf, "proposals_in")
    empty = rows.where("false").select(F.col("a_condition_id").alias("low_condition_id"), F.col("b_condition_id").alias("high_condition_id"))
    fresh, _ = proposals.save_proposals(empty, rows, "arrival")
    return fresh.select("low_condition_id", "high_condition_id", "proposed_type", r6("model_confidence"))


@query(
    """select case when proposed_type = 'implied_by' then high_condition_id else low_condition_id end as from_condition_id,
       case when proposed_type = 'implied_by' then low_condition_id else high_condition_id end as to_condition_id,
       case when proposed_type = 'complement' then 'complement' else 'implies' end as type from last where proposed_type in ('implies', 'implied_by', 'complement')""",
    "proposals_in", extra=PROPOSAL_CTES,
)
def proposal_edges(spark, sf):
    return proposals.proposal_edges(proposals.canonical_proposals(project(spark, sf, "proposals_in"), "arrival")).select(
        "from_condition_id", "to_condition_id", "type"
    )


@query(
    """select id, proposed_type, round(model_confidence, 6) as model_confidence from reviewed where status = 'pending' and proposed_type <> 'unrelated'""",
    "reviewed",
)
def pending_queue(spark, sf):
    rows = project(spark, sf, "reviewed")
    ids = rows.select(F.explode(F.array("low_condition_id", "high_condition_id")).alias("condition_id")).withColumn("question", F.col("condition_id"))
    return proposals.pending_proposals(rows, ids).select("id", "proposed_type", r6("model_confidence"))


@query(
    """select proposed_type, accepted, rejected, skipped, pending, round(case when accepted + rejected > 0 then accepted / (accepted + rejected) end, 6) as precision from
       (select coalesce(proposed_type, 'all') as proposed_type, count(*) filter (where status = 'accepted') as accepted, count(*) filter (where status = 'rejected') as rejected,
        count(*) filter (where status = 'skipped') as skipped, count(*) filter (where status = 'pending') as pending from reviewed group by grouping sets ((proposed_type), ()))""",
    "reviewed",
)
def review_precision(spark, sf):
    out = proposals.review_precision(project(spark, sf, "reviewed"))
    return out.select("proposed_type", "accepted", "rejected", "skipped", "pending", r6("precision"))


VERDICT_SQL = "select cast(doc_id as string) as proposal_id, case source when 'src1' then 'a' when 'src2' then 'R' when 'src3' then 's' else 'x' end as v, n_chars from documents"


@query(
    """select r.id, case when r.status = 'pending' and v in ('a', 'R', 's') then case v when 'a' then 'accepted' when 'R' then 'rejected' else 'skipped' end else r.status end as status,
       case when r.status = 'pending' and v in ('a', 'R', 's') then concat('length ', n_chars) end as review_note from reviewed r join v on r.id = v.proposal_id""",
    "reviewed", extra=[("v", VERDICT_SQL)],
)
def applied_verdicts(spark, sf):
    """A verdict line per document; only pending proposals change."""
    docs = read(spark, sf, "documents")
    word = F.when(F.col("source") == "src1", "a").when(F.col("source") == "src2", "R").when(F.col("source") == "src3", "s").otherwise("x")
    lines = docs.select(F.concat_ws(" ", F.col("doc_id").cast("string"), word, F.lit("length"), F.col("n_chars").cast("string")).alias("value"))
    after, _, _ = proposals.apply_verdicts(project(spark, sf, "reviewed"), proposals.parse_verdicts(lines), "me")
    return after.select("id", "status", "review_note")


@query(
    """select event_id, value <= 100 as valid, case when value <= 100 then event_type else 'none' end as rationale from events""",
)
def answer_validation(spark, sf):
    """Fenced JSON answers built from events; confidence above 1 is refused."""
    body = F.concat(
        F.lit("Sure:\n```json\n{\"relation\": \"implies\", \"rationale\": \" "), "event_type", F.lit("\", \"confidence\": "), (F.col("value") / 100).cast("decimal(20,6)").cast("string"), F.lit("}\n```")
    )
    answers = read(spark, sf, "events").select("event_id", body.alias("answer"))
    return proposals.validate_answers(answers).select("event_id", "valid", F.coalesce("rationale", F.lit("none")).alias("rationale"))


@query(
    """select case when i % 2 = 1 then from_condition_id else to_condition_id end as a_condition_id, case when i % 2 = 1 then to_condition_id else from_condition_id end as b_condition_id,
       case when i % 2 = 1 then 'implies' else 'implied_by' end as truth from (select *, row_number() over (order by md5(concat(from_condition_id, to_condition_id)), from_condition_id) as i from ladder) where i <= 400""",
    "markets", extra=LADDER_CTES,
)
def entailment_sample(spark, sf):
    return proposals.entailment_set(ladder(spark, sf), project(spark, sf, "markets"), 400).select("a_condition_id", "b_condition_id", "truth")


@query(
    """select min(condition_id) filter (where n % 2 = 1) as a_condition_id, max(condition_id) filter (where n % 2 = 0) as b_condition_id from
       (select *, row_number() over (partition by event_id, p_type order by p_size, condition_id) as n from band_markets)
       group by event_id, p_type, (n - 1) // 2 having count(*) = 2 and min(p_size) filter (where n % 2 = 1) + 2 <= max(p_size) filter (where n % 2 = 0)""",
    "band_markets",
)
def band_sample(spark, sf):
    return proposals.band_set(project(spark, sf, "band_markets")).select("a_condition_id", "b_condition_id")


@query(
    """select max(c) filter (where i % 2 = 1) as a_condition_id, max(c) filter (where i % 2 = 0) as b_condition_id from
       (select c, row_number() over (order by md5(c)) as i from (select event_id, min(condition_id) as c from markets group by 1)) group by (i - 1) // 2 having count(*) = 2""",
    "markets",
)
def cross_event_sample(spark, sf):
    return proposals.cross_event_set(project(spark, sf, "markets"), 200).select("a_condition_id", "b_condition_id")


@query(
    """select lang as family, quality as truth, toxic as answer, count(*) as n, quality = toxic as correct from documents d join labels l on d.doc_id = l.doc_id group by 1, 2, 3""",
)
def confusion_table(spark, sf):
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    return proposals.confusion(rows.select(F.col("lang").alias("family"), F.col("quality").alias("truth"), F.col("toxic").alias("answer")))


# --- depth pricing --------------------------------------------------------------------------

BOOK_CTES = [
    ("merged", "select token_id, side, price, sum(size) as size from levels group by 1, 2, 3"),
    ("cum", "select *, coalesce(sum(size) over (partition by token_id, side order by case when side = 'ask' then price else -price end rows between unbounded preceding and 1 preceding), 0) as before from merged"),
]


@query(
    """select order_id, action, round(sum(take), 6) as filled, round(max(want) - sum(take), 6) as unfilled, round(sum(take * coalesce(price, 0)), 6) as notional,
       round(sum(case when take * 0.07 * price * (1 - price) >= 0.00001 then take * 0.07 * price * (1 - price) else 0 end), 6) as fee,
       count(*) filter (where take > 0) as levels_consumed, sum(take) > 0 and sum(take) < max(want) as partial from
       (select o.order_id, o.action, o.size as want, c.price, coalesce(greatest(0, least(c.size, o.size - c.before)), 0) as take from
         (select p_partkey as order_id, concat('y', lpad(cast(p_partkey as string), 8, '0')) as token_id, case when p_type like 'S%' then 'sell' else 'buy' end as action, p_size * 6.0 as size from markets) o
         left join cum c on c.token_id = o.token_id and c.side = case when o.action = 'buy' then 'ask' else 'bid' end) group by 1, 2""",
    "markets", "levels", extra=BOOK_CTES,
)
def book_walk(spark, sf):
    markets = project(spark, sf, "markets")
    orders = markets.select(
        F.col("p_partkey").alias("order_id"), F.concat(F.lit("y"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("token_id"),
        F.when(F.col("p_type").startswith("S"), "sell").otherwise("buy").alias("action"), (F.col("p_size") * 6.0).alias("size"),
    )
    out = pricing.walk_orders(orders, project(spark, sf, "levels"))
    return out.select("order_id", "action", r6("filled"), r6("unfilled"), r6("notional"), r6("fee"), "levels_consumed", "partial")


@query("select token_id, side, sum(size) as depth from levels group by 1, 2", "levels")
def available_depth(spark, sf):
    return pricing.available_depth(project(spark, sf, "levels"))


@query(
    """select token_id, round(max(price) filter (where side = 'bid'), 6) as bid, round(min(price) filter (where side = 'ask'), 6) as ask,
       round((max(price) filter (where side = 'bid') + min(price) filter (where side = 'ask')) / 2, 6) as mid,
       round(min(price) filter (where side = 'ask') - max(price) filter (where side = 'bid'), 6) as spread from levels group by 1""",
    "levels",
)
def top_of_book(spark, sf):
    top = pricing.top_of_levels(project(spark, sf, "levels"))
    return top.select("token_id", r6("bid"), r6("ask"), r6("mid"), r6("spread"))


@query(
    """select c.token_id, c.side, round(max(least(c.size + c.before, case when q <= t + abs(t) * 0.05 then c.size + c.before else (q * before - spent) / (q - (t + abs(t) * 0.05)) end))
         filter (where q <= t + abs(t) * 0.05 or (q * before - spent) / (q - (t + abs(t) * 0.05)) >= before), 6) as size
       from (select *, case when side = 'ask' then price else -price end as q, coalesce(sum(size * case when side = 'ask' then price else -price end) over (partition by token_id, side order by case when side = 'ask' then price else -price end rows between unbounded preceding and 1 preceding), 0) as spent,
         min(case when side = 'ask' then price else -price end) over (partition by token_id, side) as t from cum) c group by 1, 2""",
    "levels", extra=BOOK_CTES,
)
def size_within_slippage(spark, sf):
    return pricing.size_within_slippage(project(spark, sf, "levels"), 0.05).select("token_id", "side", r6("size"))


def stored_books(levels: DataFrame) -> DataFrame:
    """Levels to book rows with best-first arrays; a side is bounded by the tick grid."""
    merged = pricing.merged_levels(levels)
    level = F.struct("price", "size")
    sided = merged.groupBy("token_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == "bid", level)), asc=False).alias("bids"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "ask", level))).alias("asks"),
    )
    return sided.select("*", F.concat(F.lit("m"), F.substring("token_id", 2, 8)).alias("condition_id"), now().alias("timestamp"), F.lit("h").alias("hash"))


@query(
    """select token_id, concat('m', substr(token_id, 2)) as condition_id, count(*) filter (where side = 'bid') as bid_levels, count(*) filter (where side = 'ask') as ask_levels,
       round(coalesce(sum(size) filter (where side = 'bid'), 0), 6) as bid_depth, round(coalesce(sum(size) filter (where side = 'ask'), 0), 6) as ask_depth,
       round(min(price) filter (where side = 'ask'), 6) as ask from merged group by 1""",
    "levels", extra=BOOK_CTES[:1],
)
def book_snapshots(spark, sf):
    rows = pricing.snapshot_rows(stored_books(project(spark, sf, "levels")), now())
    return rows.select("token_id", "condition_id", F.size("bids").alias("bid_levels"), F.size("asks").alias("ask_levels"), r6("bid_depth"), r6("ask_depth"), r6("ask"))


@query(
    """select token_id, side, count(*) as levels, round(sum(size), 6) as depth from merged group by 1, 2""",
    "levels", extra=BOOK_CTES[:1],
)
def snapshot_replay(spark, sf):
    """Stored levels read back as a walkable book, as of now."""
    rows = pricing.snapshot_rows(stored_books(project(spark, sf, "levels")), now())
    back = pricing.levels_of(pricing.books_as_of(rows, now()))
    return back.groupBy("token_id", "side").agg(F.count("*").alias("levels"), F.round(F.sum("size"), 6).alias("depth"))


@query(
    """select o.event_id, coalesce(s.seq, -1) as quote, coalesce(round(s.price, 6), -1) as price, coalesce(epoch_us(o.ts) - epoch_us(s.ts), -1) as age from asked o asof left join quoted s on o.token_id = s.token_id and o.ts >= s.ts""",
    "level_changes",
    extra=[
        ("asked", "select cast(user_id as string) as token_id, ts, event_id from events where event_type = 'purchase'"),
        ("quoted", "select token_id, ts, seq, price from level_changes where side = 'bid'"),
    ],
)
def books_at_order_times(spark, sf):
    """Every purchase with the bid stored last before it, each at its own time; -1 where none was."""
    orders = read(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("token_id"), "ts", "event_id")
    stored = project(spark, sf, "level_changes").where("side = 'bid'").select("token_id", "ts", "seq", "price")
    out = pricing.books_at(orders, stored)
    age = F.unix_micros("ts") - F.unix_micros("book_ts")
    none = F.lit(-1)
    return out.select("event_id", F.coalesce("book_seq", none).alias("quote"), F.coalesce(r6("book_price"), none).alias("price"), F.coalesce(age, none).alias("age"))


@query(
    """select p_partkey, case when p_type = 'PROMO' then 0.0 else case p_type when 'LARGE' then 0.07 when 'SMALL' then 0.05 when 'MEDIUM' then 0.04 when 'ECONOMY' then 0.05 else 0.07 end end::double as rate from part""",
)
def fee_schedule(spark, sf):
    """Fee rate per part: types stand for categories, PROMO for fee-free markets."""
    kind = F.col("p_type")
    named = F.when(kind == "LARGE", "Crypto").when(kind == "SMALL", "sports").when(kind == "MEDIUM", "politics").when(kind == "ECONOMY", "economics").when(kind == "STANDARD", "unlisted")
    rate = fees.fee_rate(named, F.when(kind == "PROMO", 0).otherwise(1000))
    return read(spark, sf, "part").select("p_partkey", F.col("p_type").alias("t"), rate.alias("rate")).select("p_partkey", "rate")


TRADE_LEGS = LADDER_CTES + IMPLIES_EVAL + [
    ("legs", """select concat('implies:', id) as k, 0 as pos, concat('n', substr(from_condition_id, 2)) as token_id, concat(from_condition_id, ' outcome 1') as place from pair where magnitude > 0.005
        union all select concat('implies:', id), 1, concat('y', substr(to_condition_id, 2)), concat(to_condition_id, ' outcome 0') from pair where magnitude > 0.005"""),
]
TRADE_SIZES = [
    ("c", "select *, coalesce(sum(size) over (partition by token_id order by price rows between unbounded preceding and 1 preceding), 0) as before from asks"),
    ("depth", "select token_id, sum(size) as depth from asks group by 1"),
    ("basket", "select k, count(*) filter (where depth is null) as missing, min(depth) as ceiling from legs left join depth using (token_id) group by 1"),
    ("sizes", "select k, 5.0::double as n from basket where missing = 0 and ceiling >= 5 union select k, ceiling from basket where missing = 0 and ceiling >= 5 union select l.k, c.before + c.size from legs l join c using (token_id) join basket b on b.k = l.k where missing = 0 and ceiling >= 5 and c.before + c.size between 5 and ceiling"),
    ("cost", "select s.k, s.n, s.n - sum(take * price + case when take * 0.07 * price * (1 - price) >= 0.00001 then take * 0.07 * price * (1 - price) else 0 end) as profit from (select s.k, s.n, c.price, greatest(0, least(c.size, s.n - c.before)) as take from sizes s join legs l on l.k = s.k join c on c.token_id = l.token_id) s group by 1, 2"),
    ("best", "select k, max(profit) as profit, max(profit) filter (where n = 5) as floor_profit from cost group by 1"),
    ("pick", "select b.k, b.profit, b.floor_profit, min(n) as n from best b join cost c on c.k = b.k and c.profit >= b.profit - 1e-9 group by 1, 2, 3"),
]


@query(
    """select b.k as constraint_key, case when missing > 0 then 'missing' when ceiling < 5 then 'below-min-size' when p.floor_profit <= 0 then 'negative-edge'
       when p.profit < 1 or p.profit / p.n < 0.005 then 'immaterial-edge' else 'none' end as failure,
       round(case when missing = 0 and ceiling >= 5 and floor_profit > 0 and p.profit >= 1 and p.profit / p.n >= 0.005 then p.n end, 6) as size,
       round(case when missing = 0 and ceiling >= 5 and floor_profit > 0 and p.profit >= 1 and p.profit / p.n >= 0.005 then p.profit end, 6) as net_profit
       from basket b left join pick p on p.k = b.k""",
    "markets", "cheap_levels", extra=[*TRADE_LEGS, ("asks", "select token_id, price, sum(size) as size from cheap_levels group by 1, 2"), *TRADE_SIZES],
)
def correcting_trades(spark, sf):
    """Every violated implication priced on depth: the size that earns most, or why there is none."""
    e, members, markets = implies_evaluations(spark, sf)
    levels = project(spark, sf, "cheap_levels")
    meta = levels.select("token_id").distinct().withColumn("min_order_size", F.lit(5.0))
    legs = pricing.locate_legs(screen.basket_legs(screen.promote(e, None), members), market_tokens(markets), meta)
    trades, _ = pricing.price_baskets(legs, levels)
    failure = F.coalesce(F.when(F.col("failure").startswith("missing") | (F.col("failure") == "empty-book"), "missing").otherwise(F.col("failure")), F.lit("none"))
    return trades.select("constraint_key", failure.alias("failure"), r6("size"), r6("net_profit"))


CHECK_CTES = [
    *TRADE_LEGS, ("asks", "select token_id, price, sum(size) as size from levels where side = 'ask' group by 1, 2"), *TRADE_SIZES,
    ("absent", """select k, arg_min(code, pos) as code, arg_min(place, pos) as place from (select l.*, case when l.token_id not in (select token_id from levels) then 'missing-book'
        when d.depth is null then 'empty-book' end as code from legs l left join depth d on d.token_id = l.token_id) where code is not null group by 1"""),
    ("mids", "select token_id, (max(price) filter (where side = 'bid') + min(price) filter (where side = 'ask')) / 2 as mid from levels group by 1"),
    ("live", """select concat('implies:', id) as k, p.magnitude, a.mid - b.mid as live from pair p left join mids a on a.token_id = concat('y', substr(from_condition_id, 2))
        left join mids b on b.token_id = concat('y', substr(to_condition_id, 2))"""),
    ("bends", "select *, lead(n) over w as n1, lead(profit) over w as profit1 from cost window w as (partition by k order by n)"),
    ("most", "select k, max(case when profit <= 0 then 0 when n1 is null then n when profit1 <= 0 then n + profit * (n1 - n) / (profit - profit1) else 0 end) as n from bends group by 1"),
    ("verdict", """select b.k, case when a.code is not null then a.code when ceiling < 5 then 'below-min-size' when p.floor_profit <= 0 then 'negative-edge'
        when p.profit < 1 or p.profit / p.n < 0.005 then 'immaterial-edge' else 'none' end as failure, a.place, b.ceiling, p.n, p.profit
        from basket b left join absent a on a.k = b.k left join pick p on p.k = b.k"""),
]


@query(
    """select v.k as constraint_key, case when failure = 'none' then 'confirmed' else 'apparent' end as status, failure,
       case when failure = 'none' then 'none' when live <= 0 then 'the gap had already closed on the live book: the screened quote was stale'
         when failure = 'missing-book' then concat('no order book for ', place) when failure = 'empty-book' then concat(place, ' cannot be bought: nothing is offered')
         when failure = 'below-min-size' then printf('%.2f shares are offered, below the minimum order size of 5.00', ceiling)
         when failure = 'negative-edge' then 'net edge per unit: spread and fees exceed the mispricing' else 'a real gap, but too thin to be worth taking' end as reason,
       round(magnitude, 6) as magnitude, round(live, 6) as live_magnitude, round(coalesce(m.n, 0), 4) as max_executable_size,
       round(case when failure = 'none' then profit end, 6) as net_profit, round(case when failure = 'none' then profit / v.n end, 6) as net_edge
       from verdict v join live l on l.k = v.k left join most m on m.k = v.k""",
    "markets", "levels", extra=CHECK_CTES,
)
def coherence_check(spark, sf):
    """Screen every constraint, price and confirm every violation. Its edges are printed at two places, so they aren't compared within the sentence."""
    from oddsgraph.plans.jobs import coherence_check as job

    markets = market_tokens(project(spark, sf, "markets"))
    levels = project(spark, sf, "levels")
    edges = stored_ladder(spark, sf)
    meta = levels.select("token_id").distinct().withColumn("min_order_size", F.lit(5.0))
    none = markets.where("false")
    out = job(edges, none.select(F.col("event_id").alias("group_id"), F.lit("partition").alias("type")), none.select(F.col("event_id").alias("group_id"), "condition_id"), markets, markets, levels, meta)
    reason = F.regexp_replace(F.coalesce("reason", F.lit("none")), "net edge [-0-9.]+c", "net edge")
    return out.confirmations.select(
        "constraint_key", "status", F.coalesce("failure", F.lit("none")).alias("failure"), reason.alias("reason"), r6("magnitude"), r6("live_magnitude"),
        F.round("max_executable_size", 4).alias("max_executable_size"), r6("net_profit"), r6("net_edge"),
    )


# --- catalog --------------------------------------------------------------------------------

CRAWL_CTES = [
    ("b", "select condition_id, arg_max(question, arrival) as question, arg_max(description, arrival) as description, arg_max(closed, arrival) as closed from crawl_before group by 1"),
    ("a", "select condition_id, arg_max(question, arrival) as question, arg_max(description, arrival) as description, arg_max(closed, arrival) as closed from crawl_after group by 1"),
    ("crawl", """select coalesce(a.condition_id, b.condition_id) as condition_id, a.question as nq, b.question as oq, a.description as nd, b.description as od, a.closed as nc, b.closed as oc,
        case when a.condition_id is null then 'absent' when b.condition_id is null then 'created' when a.question = b.question and a.description = b.description and a.closed = b.closed then 'unchanged' else 'updated' end as outcome
        from b full join a on a.condition_id = b.condition_id"""),
]


def crawls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(classified, incoming): newest order per customer before 1998 against the ones from then on."""
    cols = ["condition_id", "question", "description", "closed", "arrival"]
    before = reconcile.with_content_hash(project(spark, sf, "crawl_before").select(*cols))
    latest = before.groupBy("condition_id").agg(F.max_by(F.struct("question", "description", "closed", "content_hash"), "arrival").alias("s"))
    start = F.lit("1997-12-31").cast("timestamp")
    stored = latest.select("condition_id", "s.*", start.alias("first_seen_at"), start.alias("last_seen_at"), F.lit(None).cast("timestamp").alias("missing_since"))
    incoming = reconcile.with_content_hash(project(spark, sf, "crawl_after").select(*cols))
    return reconcile.classify(stored, incoming), incoming


@query("select condition_id, outcome from crawl", "crawl_before", "crawl_after", extra=CRAWL_CTES)
def catalog_outcomes(spark, sf):
    return crawls(spark, sf)[0].select("condition_id", "outcome")


REVISION_SQL = """select condition_id, 'question' as field, concat('"', oq, '"') as old_value, concat('"', nq, '"') as new_value from crawl where outcome = 'updated' and oq <> nq
    union all select condition_id, 'description', concat('"', od, '"'), concat('"', nd, '"') from crawl where outcome = 'updated' and od <> nd
    union all select condition_id, 'closed', cast(oc as string), cast(nc as string) from crawl where outcome = 'updated' and oc <> nc"""


@query(REVISION_SQL, "crawl_before", "crawl_after", extra=CRAWL_CTES)
def catalog_revisions(spark, sf):
    return reconcile.revisions(crawls(spark, sf)[0], now()).select("condition_id", "field", "old_value", "new_value")


@query(
    """select condition_id, case when outcome = 'absent' then oq else nq end as question, outcome = 'absent' as missing from crawl""",
    "crawl_before", "crawl_after", extra=CRAWL_CTES,
)
def catalog_merged(spark, sf):
    """The table after the crawl and the sweep for markets it did not return."""
    merged = reconcile.merged_markets(crawls(spark, sf)[0], now())
    return reconcile.mark_missing(merged, now()).select("condition_id", "question", F.col("missing_since").isNotNull().alias("missing"))


@query(
    f"""select count(*) filter (where outcome <> 'absent') as seen, 0 as skipped, count(*) filter (where outcome = 'created') as created, count(*) filter (where outcome = 'updated') as updated,
       count(*) filter (where outcome = 'unchanged') as unchanged, count(*) filter (where outcome = 'absent') as absent, (select count(*) from ({REVISION_SQL})) as revisions from crawl""",
    "crawl_before", "crawl_after", extra=CRAWL_CTES,
)
def catalog_summary(spark, sf):
    classified, incoming = crawls(spark, sf)
    return reconcile.run_summary(classified, incoming, reconcile.revisions(classified, now()))


@query("select min(lpad(cast(doc_id as string), 12, '0')) as endpoint from documents group by text")
def archive_dedupe(spark, sf):
    """One archived body per distinct document text. Each lands as a JSON record: texts that are JSON themselves stay as they are."""
    docs = read(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("page"), F.to_json(F.struct("text")).alias("body"))
    return pages.archive_pages(None, docs, now()).select("endpoint")


@query(
    """select cast(event_id as string) as id, round(value, 6) as volume, case when event_type in ('click', 'view') then 'true' when event_type = 'error' then 'unusable' else 'false' end as active, case event_type when 'signup' then 0 when 'error' then 3 when 'purchase' then 1 else 0 end as issues,
       case event_type when 'click' then '2025-03-01' when 'view' then '2024-01-01' when 'signup' then '2025-01-01' else 'none' end as ends, case when event_type = 'error' then 0 else 2 end as outcomes from events""",
)
def json_coercion(spark, sf):
    """A loose JSON market per event, coerced field by field."""
    e = F.col("event_type")
    end = F.when(e == "click", '"2025-03-01T10:00:00Z"').when(e == "view", '"2024-01-01 20:24:52+00"').when(e == "signup", "1735689600").when(e == "purchase", '"2025-02-30"').otherwise('"soon"')
    active = F.when(e == "click", "true").when(e == "view", '"Yes"').when(e == "error", '"perhaps"').otherwise('"0"')
    outcomes = F.when(e == "error", '"[oops"').when(e == "click", '["Yes","No"]').otherwise('"[\\"Yes\\",\\"No\\"]"')
    body = F.concat(
        F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "volume": "", "volumeNum": '), F.col("value").cast("string"), F.lit(', "active": '), active,
        F.lit(', "endDate": '), end, F.lit(', "outcomes": '), outcomes, F.lit("}"),
    )
    rows = read(spark, sf, "events").select(F.parse_json(body).alias("record"))
    out = pages.normalise_markets(rows)
    return out.select(
        "id", r6("volume"), F.coalesce(F.col("active").cast("string"), F.lit("unusable")).alias("active"), F.size("issues").alias("issues"),
        F.coalesce(F.date_format("endDate", "yyyy-MM-dd"), F.lit("none")).alias("ends"), F.coalesce(F.size("outcomes"), F.lit(0)).alias("outcomes"),
    )


@query(
    """select cast(user_id as string) as condition_id, round(arg_min(value, event_id), 6) as yes_price from events group by 1""",
)
def quote_refresh(spark, sf):
    """First quote per market of the run; markets are users."""
    rows = read(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("conditionId"), F.array("value").alias("outcomePrices"), F.lit(None).cast("double").alias("bestBid"),
        F.lit(None).cast("double").alias("bestAsk"), F.col("ts").alias("updatedAt"), "event_id",
    )
    stored = rows.where("false").select(
        F.col("conditionId").alias("condition_id"), F.col("bestBid").alias("yes_price"), F.col("bestBid").alias("best_bid"), F.col("bestAsk").alias("best_ask"),
        F.col("updatedAt").alias("quoted_at"), F.col("updatedAt").alias("fetched_at"),
    )
    quotes, _ = tables.refresh_quotes(stored, rows.select(F.col("conditionId").alias("condition_id")), rows, now(), F.col("event_id"))
    return quotes.select("condition_id", r6("yes_price"))


# --- episodes and live state ----------------------------------------------------------------


@query(
    """select episode_id, status, checks, epoch_us(detected_at) as detected_at, round(life, 6) as lifetime_seconds, ever_confirmed, round(screen_magnitude, 6) as screen_magnitude,
       round(peak_magnitude, 6) as peak_magnitude, round(peak_net_profit, 6) as peak_net_profit, reason from episodes""",
    "checks", extra=EPISODE_CTES,
)
def episodes(spark, sf):
    out = ep.with_lifetime(all_episodes(spark, sf))
    return out.select(
        "episode_id", "status", "checks", us("detected_at"), r6("lifetime_seconds"), "ever_confirmed", r6("screen_magnitude"),
        r6("peak_magnitude"), r6("peak_net_profit"), "reason",
    )


LATEST_CHECK = "2024-01-16 00:00:00"
ONCE_CTES = [
    ("once", f"""select * from checks where check_ts < timestamp '{LATEST_CHECK}' union all
        select * replace (timestamp '{LATEST_CHECK}' as check_ts) from (select * from checks where check_ts >= timestamp '{LATEST_CHECK}'
        qualify row_number() over (partition by constraint_key order by check_ts, event_id) = 1)"""),
    *[(name, body.replace("from checks where", "from once where")) for name, body in EPISODE_CTES],
]


def after_latest_check(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The episodes before a time, and the first check of each constraint from then on recorded on them."""
    checks = project(spark, sf, "checks")
    at = F.lit(LATEST_CHECK).cast("timestamp")
    stored = ep.episodes(checks.where(F.col("check_ts") < at), tie=["event_id"])
    row = F.struct(*[c for c in checks.columns if c != "constraint_key"])
    latest = checks.where(F.col("check_ts") >= at).groupBy("constraint_key").agg(F.min_by(row, F.struct("check_ts", "event_id")).alias("r")).select("constraint_key", "r.*")
    seen = latest.where(~F.col("unscreenable"))
    bad = seen.where("violated").withColumn("status", F.when(F.col("confirmed"), "confirmed").otherwise("apparent"))
    return ep.record_check(stored, bad, bad, seen, at)


@query(
    """select episode_id, status, checks, epoch_us(detected_at) as detected_at, coalesce(epoch_us(resolved_at), -1) as resolved_at, ever_confirmed,
       round(screen_magnitude, 6) as screen_magnitude, round(peak_magnitude, 6) as peak_magnitude, round(peak_net_profit, 6) as peak_net_profit from episodes""",
    "checks", extra=ONCE_CTES,
)
def incremental_episodes(spark, sf):
    """One more check recorded on stored episodes equals the episodes of the whole history."""
    after, _ = after_latest_check(spark, sf)
    return after.select(
        "episode_id", "status", "checks", us("detected_at"), F.coalesce(F.unix_micros("resolved_at"), F.lit(-1)).alias("resolved_at"), "ever_confirmed", r6("screen_magnitude"), r6("peak_magnitude"), r6("peak_net_profit")
    )


@query(
    """select count(*) filter (where bad and not open) as opened, count(*) filter (where bad and open) as updated,
       count(*) filter (where bad and open and confirmed and not ever) as upgraded, count(*) filter (where not bad and open) as resolved from
       (select l.constraint_key, l.violated as bad, l.confirmed, e.episode_id is not null as open, coalesce(e.ever_confirmed, false) as ever
        from (select * from once where check_ts = timestamp '""" + LATEST_CHECK + """' and not unscreenable) l
        left join (select * from before_episodes where resolved_at is null) e on e.constraint_key = l.constraint_key)""",
    "checks",
    extra=[
        ONCE_CTES[0],
        *[(name if name != "episodes" else "before_episodes", body.replace("from checks where", f"from checks where check_ts < timestamp '{LATEST_CHECK}' and")) for name, body in EPISODE_CTES],
    ],
)
def incremental_counts(spark, sf):
    return after_latest_check(spark, sf)[1]


@query(
    """select count(resolved_at) as closed_episodes, count(*) filter (where resolved_at is not null and ever_confirmed) as closed_confirmed, count(*) filter (where resolved_at is null) as open_episodes,
       count(*) filter (where resolved_at is null and ever_confirmed) as open_confirmed, count(*) filter (where ever_confirmed) as total_confirmed_ever, round(max(peak_net_profit), 6) as best_net_profit,
       round(quantile_cont(life, 0.5), 6) as median_all, round(quantile_cont(life, 0.5) filter (where ever_confirmed), 6) as median_confirmed, round(quantile_cont(life, 0.9) filter (where ever_confirmed), 6) as p90_confirmed from episodes""",
    "checks", extra=EPISODE_CTES,
)
def lifetime_stats(spark, sf):
    s = ep.lifetime_stats(all_episodes(spark, sf))
    return s.select(
        "closed_episodes", "closed_confirmed", "open_episodes", "open_confirmed", "total_confirmed_ever", r6("best_net_profit"),
        r6("median_all"), r6("median_confirmed"), r6("p90_confirmed"),
    )


@query("select reason, count(*) as n from episodes where not ever_confirmed group by 1", "checks", extra=EPISODE_CTES)
def apparent_reasons(spark, sf):
    return ep.apparent_reasons(all_episodes(spark, sf))


@query(
    """select constraint_key, epoch_us(check_ts) as at, round(magnitude, 6) as magnitude from (select *, lag(violated) over (partition by constraint_key order by check_ts, event_id) as was from checks where not unscreenable)
       where violated and coalesce(not was, true)""",
    "checks",
)
def transitions(spark, sf):
    return watch.transitions(project(spark, sf, "checks"), tie=["event_id"]).select("constraint_key", us("check_ts", "at"), r6("magnitude"))


BOOK_STATE = "select token_id, side, price, arg_max(size, (ts, seq)) as size from level_changes group by 1, 2, 3 having arg_max(size, (ts, seq)) > 0"


@query(f"select token_id, side, round(price, 6) as price, round(size, 6) as size from ({BOOK_STATE})", "level_changes")
def book_state(spark, sf):
    return books.book_state(project(spark, sf, "level_changes")).select("token_id", "side", r6("price"), r6("size"))


@query(
    f"""select coalesce(a.token_id, b.token_id) as token_id, count(*) as differences from ({BOOK_STATE}) a full join
       ({BOOK_STATE.replace("group by", "where ts < timestamp '2024-01-20 00:00:00' group by")}) b on a.token_id = b.token_id and a.side = b.side and a.price = b.price
       where a.size is distinct from b.size group by 1""",
    "level_changes",
)
def book_divergence(spark, sf):
    """Levels of the book as held on 20 January that differ from the final book."""
    rows = project(spark, sf, "level_changes")
    held = books.book_state(rows.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp")))
    return books.level_differences(held, books.book_state(rows)).groupBy("token_id").agg(F.count("*").alias("differences"))


LATENCY_COLUMNS = [(f"le_{b:g}".replace(".", "_"), b) for b in B.LATENCY_SECONDS]


@query(
    "select event_type, " + ", ".join(f"count(*) filter (where s <= {b!r}) as {name}" for name, b in LATENCY_COLUMNS)
    + ", round(sum(s), 4) as total, count(*) as n from (select event_type, value as s from events) group by 1",
)
def latency_histogram(spark, sf):
    rows = read(spark, sf, "events").select("event_type", "value")
    out = stats.cumulative_histogram(rows, ["event_type"], "value", B.LATENCY_SECONDS)
    return out.select("event_type", *[name for name, _ in LATENCY_COLUMNS], F.round("sum", 4).alias("total"), F.col("count").alias("n"))


@query(
    """select max(value) filter (where rn = floor(0.5 * (n - 1)) + 1) as p50, max(value) filter (where rn = floor(0.9 * (n - 1)) + 1) as p90, max(value) filter (where rn = floor(0.99 * (n - 1)) + 1) as p99
       from (select value, row_number() over (order by value) as rn, count(*) over () as n from events)""",
)
def latency_quantiles(spark, sf):
    return watch.latency_quantiles(read(spark, sf, "events").select(F.col("value").alias("latency_ms")))


# --- alerts ---------------------------------------------------------------------------------

# Deliveries known before: one per user with a purchase, quoted at its first purchase.
DELIVERY_SQL = """select concat('violation:', e.episode_id) as alert_key, e.detected_at as last_sent_at, e.screen_magnitude / 10 as last_value,
    case when e.kind = 'partition' then e.detected_at end as resolved_notified_at from episodes e where e.ever_confirmed and e.peak_magnitude > 0.2"""


def deliveries_of(all_eps: DataFrame) -> DataFrame:
    known = all_eps.where(F.col("ever_confirmed") & (F.col("peak_magnitude") > 0.2))
    return known.select(
        alerts.violation_key(F.col("episode_id")).alias("alert_key"), F.lit("violation").alias("kind"), F.col("detected_at").alias("first_sent_at"),
        F.col("detected_at").alias("last_sent_at"), (F.col("screen_magnitude") / 10).alias("last_alert_value"), F.lit(1).alias("send_count"), F.lit(0).alias("escalations"),
        F.when(F.col("kind") == "partition", F.col("detected_at")).alias("resolved_notified_at"),
    )


@query(
    f"""select e.episode_id, case when not (coalesce(peak_net_edge, 0) >= 0.01 and coalesce(peak_net_profit, 0) >= 20) then 'below_threshold' when d.alert_key is null then 'send'
       when d.resolved_notified_at is not null then 'suppress' when epoch(timestamp '{NOW}') - epoch(d.last_sent_at) < 1800 then 'suppress' when d.last_value <= 0 then 'suppress'
       when peak_net_edge >= d.last_value * 2 then 'escalate' else 'suppress' end as decision
       from episodes e left join ({DELIVERY_SQL}) d on d.alert_key = concat('violation:', e.episode_id) where e.ever_confirmed""",
    "checks", extra=EPISODE_CTES,
)
def alert_decisions(spark, sf):
    eps = all_episodes(spark, sf).where("ever_confirmed")
    out = alerts.confirmed_decisions(eps, deliveries_of(eps), now(), 0.01, 20.0)
    return out.select("episode_id", "decision")


@query(
    f"""select e.episode_id, case when d.alert_key is null then 'suppress' when d.resolved_notified_at is null then 'resolve' else 'suppress' end as decision
       from episodes e left join ({DELIVERY_SQL}) d on d.alert_key = concat('violation:', e.episode_id) where e.resolved_at is not null and e.ever_confirmed""",
    "checks", extra=EPISODE_CTES,
)
def resolution_decisions(spark, sf):
    eps = all_episodes(spark, sf)
    closed = eps.where(F.col("resolved_at").isNotNull() & F.col("ever_confirmed"))
    return alerts.resolution_decisions(closed, deliveries_of(eps), now()).select("episode_id", "decision")


ALERT_CTES = EPISODE_CTES + [
    ("d", DELIVERY_SQL),
    ("dec", f"""select concat('violation:', e.episode_id) as alert_key, e.peak_net_edge as value, case when not (coalesce(peak_net_edge, 0) >= 0.01 and coalesce(peak_net_profit, 0) >= 20) then 'below_threshold' when d.alert_key is null then 'send'
       when d.resolved_notified_at is not null then 'suppress' when epoch(timestamp '{NOW}') - epoch(d.last_sent_at) < 1800 then 'suppress' when d.last_value <= 0 then 'suppress'
       when peak_net_edge >= d.last_value * 2 then 'escalate' else 'suppress' end as decision
       from episodes e left join d on d.alert_key = concat('violation:', e.episode_id) where e.ever_confirmed"""),
    ("acted", "select * from dec where decision in ('send', 'escalate')"),
]


@query(
    f"""select coalesce(d.alert_key, a.alert_key) as alert_key, case when a.alert_key is not null then epoch_us(timestamp '{NOW}') else epoch_us(d.last_sent_at) end as last_sent_at,
       round(case when a.alert_key is not null then a.value else d.last_value end, 6) as last_alert_value,
       (case when d.alert_key is not null then 1 else 0 end) + (case when a.alert_key is not null then 1 else 0 end) as send_count,
       case when d.alert_key is not null and a.decision = 'escalate' then 1 else 0 end as escalations, d.resolved_notified_at is not null as resolved
       from d full join acted a on a.alert_key = d.alert_key""",
    "checks", extra=ALERT_CTES,
)
def delivery_updates(spark, sf):
    """Deliveries after the alerts of this run; running it again changes nothing more than a second send would."""
    eps = all_episodes(spark, sf)
    known = deliveries_of(eps)
    decisions = alerts.confirmed_decisions(eps.where("ever_confirmed"), known, now(), 0.01, 20.0)
    out = alerts.updated_deliveries(known, decisions, now())
    return out.select("alert_key", us("last_sent_at"), r6("last_alert_value"), "send_count", "escalations", F.col("resolved_notified_at").isNotNull().alias("resolved"))


@query(
    f"""select coalesce(d.alert_key, concat('violation:', e.episode_id)) as alert_key, epoch_us(timestamp '{NOW}') as resolved_notified_at from episodes e join d on d.alert_key = concat('violation:', e.episode_id)
       where e.resolved_at is not null and e.ever_confirmed and d.resolved_notified_at is null""",
    "checks", extra=ALERT_CTES,
)
def resolution_updates(spark, sf):
    """Endings announced in this run are stamped once."""
    eps = all_episodes(spark, sf)
    known = deliveries_of(eps)
    closed = eps.where(F.col("resolved_at").isNotNull() & F.col("ever_confirmed"))
    after = alerts.updated_deliveries(known, alerts.resolution_decisions(closed, known, now()), now())
    return after.where(F.col("resolved_notified_at") == now()).select("alert_key", us("resolved_notified_at"))


@query(
    """select episode_id, epoch_us(resolved_at) as resolved_at from episodes e where ever_confirmed and resolved_at >= timestamp '2024-01-20 00:00:00' - interval 24 hours
       and exists (select 1 from d where d.alert_key = concat('violation:', e.episode_id) and d.resolved_notified_at is null)""",
    "checks", extra=ALERT_CTES,
)
def recently_resolved(spark, sf):
    eps = all_episodes(spark, sf)
    out = alerts.recently_resolved(eps, deliveries_of(eps), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return out.select("episode_id", us("resolved_at"))


@query(
    """select episode_id from episodes e where resolved_at is null and ever_confirmed and exists (select 1 from checks c where c.constraint_key = e.constraint_key and c.confirmed and c.violated)""",
    "checks", extra=ALERT_CTES,
)
def confirmed_to_alert(spark, sf):
    keys = project(spark, sf, "checks").where("confirmed and violated")
    return alerts.confirmed_to_alert(all_episodes(spark, sf), keys).select("episode_id")


@query(
    """select episode_id, round(screen_magnitude, 6) as screen_magnitude from episodes where not ever_confirmed and screen_magnitude is not null
       and detected_at >= timestamp '2024-01-10 00:00:00' and detected_at < timestamp '2024-01-12 00:00:00' order by episodes.screen_magnitude desc, episode_id limit 5""",
    "checks", extra=EPISODE_CTES,
)
def digest_worst(spark, sf):
    """The five worst gaps of a digest; its counts cover all entries."""
    start, end = (F.lit(f"2024-01-{d} 00:00:00").cast("timestamp") for d in (10, 12))
    return alerts.hourly_digest(all_episodes(spark, sf), start, end)["worst"].select("episode_id", r6("screen_magnitude"))


@query(
    """select epoch_us(date_trunc('hour', detected_at)) as hour, case when ever_confirmed then 'confirmed' when reason like '%spread and fees%' then 'spread and fees exceed the mispricing'
       when reason like '%too thin%' then 'edge real but immaterial' when reason like '%no order book%' then 'no order book for a leg' else reason end as reason, count(*) as n,
       round(max(screen_magnitude), 6) as worst from episodes group by 1, 2""",
    "checks", extra=EPISODE_CTES,
)
def hourly_digests(spark, sf):
    out = alerts.digests_by_hour(all_episodes(spark, sf))
    return out.select(us("hour"), "reason", "n", r6("worst"))


def streamed(df: DataFrame) -> DataFrame:
    """All a stream gives over what has landed, written to the shared folder."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    drop_at_end(folder)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


@query(
    """select epoch_us(hour) as hour, case when confirmed then 'confirmed' when reason like '%spread and fees%' then 'spread and fees exceed the mispricing'
       when reason like '%too thin%' then 'edge real but immaterial' when reason like '%no order book%' then 'no order book for a leg' else reason end as reason, count(*) as n, round(max(magnitude), 6) as worst
       from (select date_trunc('hour', detected) as hour, bool_or(confirmed) as confirmed, arg_max(reason, check_ts) as reason, arg_min(magnitude, check_ts) as magnitude from (
         select *, min(check_ts) over (partition by constraint_key, run) as detected from runs where violated)
         where check_ts < date_trunc('hour', detected) + interval 3 hours group by constraint_key, run, detected)
       where hour + interval 3 hours <= (select max(check_ts) from checks) - interval 10 minutes group by 1, 2""",
    "checks", extra=EPISODE_CTES[:2],
)
def stream_hourly_digests(spark, sf):
    """Digests told by one streaming query over the checks: episodes by state, hours by timers, each hour once its grace is over."""
    stored = read(spark, sf, "events")
    # As a pattern: the stream source takes a plain path for a folder.
    landed = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parque[t]")
    zoneless = [name for name, kind in landed.dtypes if kind == "timestamp_ntz"]
    events = landed.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else landed
    checks = spark.sql(PROJECTIONS["checks"], events=events.select(*stored.columns))
    out = streamed(watch.stream_digest(watch.stream_episode_changes(checks), "2 hours"))
    return out.select(us("hour"), "reason", "n", r6("worst"))


@query(
    """select source, epoch_us(sampled_at) as sampled_at, name, round(value, 9) as value from (
       select source, sampled_at, 'ingest-stale' as name, (epoch_us(sampled_at) - epoch_us(last_ingest_at)) / 1e6 as value from samples where epoch_us(sampled_at) - epoch_us(last_ingest_at) > 1800e6
       union all select source, sampled_at, 'rate-limit-spike', v from (select *, greatest(0, rate_limit_hits - lag(rate_limit_hits) over w) / ((epoch_us(sampled_at) - epoch_us(lag(sampled_at) over w)) / 1e6) * 600 as v from samples window w as (partition by source order by sampled_at, event_id)) where v > 50
       union all select source, sampled_at, 'queue-depth-growing', queue_depth from (select *, lag(queue_depth) over (partition by source order by sampled_at, event_id) as p from samples) where queue_depth > 5 and queue_depth > p
       union all select source, sampled_at, 'parse-failures', i / r from (select *, greatest(0, parse_issues - lag(parse_issues) over w) as i, records - lag(records) over w as r from samples window w as (partition by source order by sampled_at, event_id)) where r >= 200 and i / r > 0.05)""",
    "samples",
)
def system_findings(spark, sf):
    out = alerts.system_findings(project(spark, sf, "samples"))
    return out.select("source", us("sampled_at"), "name", F.round("value", 9).alias("value"))


# --- analytics ------------------------------------------------------------------------------


def report(spark: SparkSession, sf: str) -> DataFrame:
    markets = project(spark, sf, "markets").withColumn("end_date", F.lit("2024-03-01").cast("timestamp") + F.make_dt_interval(F.col("p_size")))
    return analytics.report_episodes(all_episodes(spark, sf), markets, now())


@query(
    """select (select count(*) from markets where not closed) as tracked, 0 as missing, (select count(*) from markets where closed) as closed, (select count(*) from ladder) as edges,
       (select count(distinct event_id) from markets where event_id like 'Brand#1%') as groups, count(*) filter (where resolved_at is null and ever_confirmed) as open_confirmed,
       count(*) filter (where resolved_at is null and not ever_confirmed) as open_apparent, count(*) filter (where ever_confirmed) as ever_confirmed, count(*) as total,
       round(quantile_cont(life, 0.5) filter (where ever_confirmed), 6) as median_lifetime_seconds from episodes""",
    "markets", "checks", extra=LADDER_CTES + EPISODE_CTES,
)
def status(spark, sf):
    out = analytics.status(project(spark, sf, "markets"), ladder(spark, sf), flagged_partitions(spark, sf).groups, all_episodes(spark, sf))
    return out.select("tracked", "missing", "closed", "edges", "groups", "open_confirmed", "open_apparent", "ever_confirmed", "total", r6("median_lifetime_seconds"))


@query(
    f"""select episode_id, question, round((epoch_us(timestamp '{NOW}') - epoch_us(detected_at)) / 1e6, 6) as age_seconds from episodes e left join markets m on m.condition_id = e.first_condition_id
       where resolved_at is null""",
    "markets", "checks", extra=EPISODE_CTES,
)
def open_violations(spark, sf):
    out = analytics.open_violations(all_episodes(spark, sf), project(spark, sf, "markets"), now())
    return out.select("episode_id", "question", r6("age_seconds"))


@query(
    f"""select episode_id, question, resolved_at is null as open, round((epoch_us(coalesce(resolved_at, timestamp '{NOW}')) - epoch_us(detected_at)) / 1e6, 6) as lifetime_seconds
       from episodes e left join markets m on m.condition_id = e.first_condition_id""",
    "markets", "checks", extra=EPISODE_CTES,
)
def violation_feed(spark, sf):
    out = analytics.violation_feed(all_episodes(spark, sf), project(spark, sf, "markets"), now())
    return out.select("episode_id", "question", "open", r6("lifetime_seconds"))


@query(
    """select k.which, count(e.episode_id) as total from (select unnest(['all', 'open', 'closed', 'confirmed', 'apparent']) as which) k
       left join episodes e on k.which = 'all' or (k.which = 'open' and resolved_at is null) or (k.which = 'closed' and resolved_at is not null)
       or (k.which = 'confirmed' and ever_confirmed) or (k.which = 'apparent' and not ever_confirmed) group by 1""",
    "checks", extra=EPISODE_CTES,
)
def violation_totals(spark, sf):
    return analytics.violation_totals(all_episodes(spark, sf))


@query("select 'ladder' as source, 'implies' as type, count(*) as total from ladder having count(*) > 0", "markets", extra=LADDER_CTES)
def relation_totals(spark, sf):
    return analytics.relation_totals(stored_ladder(spark, sf))


def bucket_sql(buckets: list, value: str, source: str, extra: str = "") -> str:
    parts = []
    for i, (name, low, high) in enumerate(buckets):
        upper = "" if high is None else f" and {value} < {high}"
        parts.append(f"select {i} as bucket, '{name}' as label, count(*) as n{extra} from {source} where {value} >= {low}{upper}")
    return " union all ".join(parts)


@query(
    bucket_sql(B.LIFETIME_DASHBOARD, "life", "(select * from episodes where resolved_at is not null)", ", count(*) filter (where ever_confirmed) as confirmed"),
    "checks", extra=EPISODE_CTES,
)
def lifetime_buckets(spark, sf):
    return analytics.lifetime_buckets(all_episodes(spark, sf)).select("bucket", "label", "n", "confirmed")


@query(bucket_sql(B.EDGE, "peak_net_edge", "episodes where ever_confirmed and true").replace("true where", "true and"), "checks", extra=EPISODE_CTES)
def edge_buckets(spark, sf):
    return analytics.edge_buckets(all_episodes(spark, sf)).select("bucket", "label", "n")


@query(
    """select count(*) as closed, round(max(life) filter (where rn = floor(0.5 * (n - 1)) + 1), 6) as median_seconds, round(max(life) filter (where rn = floor(0.9 * (n - 1)) + 1), 6) as p90_seconds,
       round((select max(life) filter (where rn = floor(0.5 * (n - 1)) + 1) from (select life, row_number() over (order by life) as rn, count(*) over () as n from episodes where life is not null and ever_confirmed)), 6) as confirmed_median_seconds
       from (select life, row_number() over (order by life) as rn, count(*) over () as n from episodes where life is not null)""",
    "checks", extra=EPISODE_CTES,
)
def lifetime_quantiles(spark, sf):
    out = analytics.lifetime_quantiles(all_episodes(spark, sf))
    return out.select("closed", r6("median_seconds"), r6("p90_seconds"), r6("confirmed_median_seconds"))


@query(
    """select id, from_condition_id, to_condition_id, f.question as from_question, t.question as to_question from ladder l
       left join markets f on f.condition_id = from_condition_id left join markets t on t.condition_id = to_condition_id""",
    "markets", extra=LADDER_CTES,
)
def relations_feed(spark, sf):
    out = analytics.relations_feed(stored_ladder(spark, sf), project(spark, sf, "markets"), "ladder", "implies")
    return out.select("id", "from_condition_id", "to_condition_id", "from_question", "to_question")


LIVE_ENDS = "select distinct condition_id from (select from_condition_id as condition_id from ladder union all select to_condition_id from ladder)"


@query(
    f"""select concat('event:', event_id) as key, 'ladder' as kind, min(question) as label, count(*) as members from markets m join ({LIVE_ENDS}) using (condition_id) where not closed group by event_id having count(*) > 1
       union all select concat('group:partition:neg-risk-event:', event_id), 'partition', concat('partition:neg-risk-event:', event_id), count(*) from markets where event_id like 'Brand#1%' and not closed group by event_id having count(*) > 1""",
    "markets", extra=LADDER_CTES,
)
def families(spark, sf):
    return analytics.families(flagged_partitions(spark, sf).members, ladder(spark, sf), project(spark, sf, "markets"))


@query(
    """select group_id, count(*) as members, count(*) as priced, round(sum(price), 6) as total, round(case when count(*) > 1 then sum(price) - 1 end, 6) as signed_magnitude,
       round(case when count(*) > 1 then abs(sum(price) - 1) end, 6) as magnitude, count(*) > 1 and abs(sum(price) - 1) > 0.005 as violated from partition_prices group by 1""",
    "partition_prices",
)
def partition_details(spark, sf):
    members, _, quotes = partition_members(spark, sf)
    markets = members.select("condition_id", F.lit(False).alias("closed"), F.lit(None).cast("timestamp").alias("missing_since"))
    out = analytics.partition_details(members, markets, quotes)
    return out.select("group_id", "members", "priced", r6("total"), r6("signed_magnitude"), r6("magnitude"), "violated")


@query(
    f"""select m.event_id, m.members, coalesce(e.edges, 0) as edges, round(e.worst, 6) as worst_slack, coalesce(e.worst > 0.005, false) as violated from
       (select event_id, count(*) as members from markets join ({LIVE_ENDS}) using (condition_id) where not closed group by 1) m left join
       (select l.event_id, count(*) as edges, max(f.yes_price - t.yes_price) as worst from ladder l left join markets f on f.condition_id = from_condition_id and not f.closed
        left join markets t on t.condition_id = to_condition_id and not t.closed group by 1) e on e.event_id = m.event_id""",
    "markets", extra=LADDER_CTES,
)
def ladder_details(spark, sf):
    markets = project(spark, sf, "markets")
    return analytics.ladder_details(ladder(spark, sf), markets, markets).select("event_id", "members", "edges", r6("worst_slack"), "violated")


SUMMARY = """count(life) as n, round(min(life), 6) as min, round(quantile_cont(life, 0.25), 6) as p25, round(quantile_cont(life, 0.5), 6) as median, round(quantile_cont(life, 0.75), 6) as p75,
    round(quantile_cont(life, 0.95), 6) as p95, round(max(life), 6) as max, round(avg(life), 4) as mean"""


def summary_columns(*first: str) -> list:
    return [*first, "n", *[r6(c) for c in ("min", "p25", "median", "p75", "p95", "max")], F.round("mean", 4).alias("mean")]


@query(f"select kind, {SUMMARY} from episodes where life is not null group by 1", "checks", extra=EPISODE_CTES)
def lifetime_by_kind(spark, sf):
    return analytics.lifetime_summary(report(spark, sf), ["kind"]).select(*summary_columns("kind"))


@query(f"select {SUMMARY.replace('life', 'peak_net_profit')} from episodes where ever_confirmed", "checks", extra=EPISODE_CTES)
def profit_summary(spark, sf):
    return analytics.profit_summary(all_episodes(spark, sf)).select(*summary_columns())


@query(
    f"select kind, {SUMMARY.replace('life', 'peak_magnitude')} from episodes where life is not null group by 1", "checks", extra=EPISODE_CTES
)
def magnitude_by_kind(spark, sf):
    return analytics.magnitude_summary_by_kind(report(spark, sf)).select(*summary_columns("kind"))


@query(
    " union all ".join(
        f"select {i} as bucket, '{n}' as label, {SUMMARY} from episodes where life is not null and peak_magnitude >= {a}{'' if b is None else f' and peak_magnitude < {b}'}"
        for i, (n, a, b) in enumerate(B.MAGNITUDE)
    ),
    "checks", extra=EPISODE_CTES,
)
def lifetime_by_magnitude(spark, sf):
    return analytics.lifetime_by_magnitude(report(spark, sf)).select(*summary_columns("bucket", "label"))


RANKS = "rank() over ({p}order by {c}) + (count(*) over (partition by {k}{c}) - 1) / 2.0"


def corr_sql(kind: str, part: str, key: str) -> str:
    x = RANKS.format(p=part, c="peak_magnitude", k=key)
    y = RANKS.format(p=part, c="life", k=key)
    return f"select {kind} as kind, corr(x, y) as rho, count(*) as n from (select kind, {x} as x, {y} as y from episodes where life is not null)"


# Both tails of the normal distribution by the same fixed series.
TAILS = " + ".join(f"{a} * power(u, {k})" for k, a in enumerate(stats.ERF, 1))


@query(
    f"""select kind, round(rho, 6) as rho, n, round(({TAILS}) * exp(-z * z / 2), 6) as p from (select *, 1 / (1 + {stats.ERF_P} * z / sqrt(2)) as u from (
        select *, abs(rho) * sqrt((n - 2) / greatest(1e-12, 1 - rho * rho)) as z from correlated))""",
    "checks",
    extra=[*EPISODE_CTES, ("correlated", corr_sql("'all'", "", "") + " union all " + corr_sql("kind", "partition by kind ", "kind, ") + " group by kind")],
)
def magnitude_correlation(spark, sf):
    return analytics.magnitude_correlation(report(spark, sf)).select("kind", r6("rho"), "n", r6("p"))


@query("select round(avg(case when life <= 120 then 1.0 else 0.0 end) filter (where life is not null), 6) as floor_share from episodes", "checks", extra=EPISODE_CTES)
def floor_share(spark, sf):
    return analytics.floor_share(report(spark, sf)).select(r6("floor_share"))


@query(
    """select constraint_key, count(*) as episodes, count(*) filter (where ever_confirmed) as confirmed, round(quantile_cont(life, 0.5), 6) as median_lifetime, round(max(peak_magnitude), 6) as peak_magnitude from episodes group by 1""",
    "checks", extra=EPISODE_CTES,
)
def family_ranking(spark, sf):
    out = analytics.rank_families(report(spark, sf))
    return out.select("constraint_key", "episodes", "confirmed", r6("median_lifetime"), r6("peak_magnitude"))


@query(
    """select c.constraint_key, c.episodes, round(c.edge, 6) as max_net_edge, f.question as from_question, t.question as to_question from
       (select constraint_key, count(*) as episodes, max(peak_net_edge) as edge from episodes where ever_confirmed and kind <> 'partition' group by 1) c
       left join markets f on cast(f.p_partkey as string) = split_part(constraint_key, ':', 2) left join markets t on t.p_partkey = f.p_partkey + 1""",
    "markets", "checks", extra=EPISODE_CTES,
)
def confirmed_constraints(spark, sf):
    """Relations link each part to the next; the constraint names the relation id."""
    markets = project(spark, sf, "markets")
    later = F.concat(F.lit("m"), F.lpad((F.col("p_partkey") + 1).cast("string"), 8, "0"))
    rel = markets.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("condition_id").alias("from_condition_id"), later.alias("to_condition_id"),
        F.lit("ladder").alias("source"), F.lit("r").alias("rationale"),
    )
    out = analytics.confirmed_constraints(all_episodes(spark, sf), rel, markets)
    return out.select("constraint_key", "episodes", r6("max_net_edge"), "from_question", "to_question")


@query(
    """select n.category, count(e.episode_id) as episodes, count(*) filter (where e.ever_confirmed) as confirmed, count(distinct e.constraint_key) as families, round(quantile_cont(e.life, 0.5), 6) as median_lifetime,
       any_value(x.markets) as markets, round(count(e.episode_id) * 1000.0 / any_value(x.markets), 6) as per_thousand
       from (select unnest(['sports', 'crypto', 'economics', 'politics', 'other']) as category) n left join (select *, case p_partkey % 5 when 0 then 'sports' when 1 then 'crypto' when 2 then 'economics' when 3 then 'politics' else 'other' end as category
         from episodes join markets on condition_id = first_condition_id) e on e.category = n.category
       left join (select case p_partkey % 5 when 0 then 'sports' when 1 then 'crypto' when 2 then 'economics' when 3 then 'politics' else 'other' end as category, count(*) as markets from markets group by 1) x on x.category = n.category group by 1""",
    "markets", "checks", extra=EPISODE_CTES,
)
def by_category(spark, sf):
    """Market questions end with a keyword of each class in turn, or none."""
    key = F.col("p_partkey") % 5
    topic = F.when(key == 0, " NBA").when(key == 1, " bitcoin").when(key == 2, " inflation").when(key == 3, " senate").otherwise("")
    markets = project(spark, sf, "markets").withColumn("question", F.concat("question", topic))
    known = all_episodes(spark, sf).join(markets.select(F.col("condition_id").alias("first_condition_id")), "first_condition_id", "left_semi")
    rep = analytics.report_episodes(known, markets, now())
    mix = markets.groupBy(text.category(F.col("question"), F.lit(None).cast("string")).alias("category")).agg(F.count("*").alias("markets"))
    return analytics.by_category(rep, mix).select("category", "episodes", "confirmed", "families", r6("median_lifetime"), "markets", r6("per_thousand"))


@query(
    """select label, count(e.episode_id) as episodes, round(quantile_cont(life, 0.5), 6) as median from (select unnest(['<7d', '7-30d', '30-90d', '90-365d', '>1y']) as label) b left join
       (select e.*, case when 29 + p_size < 30 then '7-30d' when 29 + p_size < 90 then '30-90d' else '90-365d' end as h from episodes e join markets m on m.condition_id = e.first_condition_id) e on e.h = b.label group by 1""",
    "markets", "checks", extra=EPISODE_CTES,
)
def by_horizon(spark, sf):
    return analytics.by_horizon(report(spark, sf)).select("label", "episodes", r6("median"))


@query(
    "select (dayofweek(detected_at) + 6) % 7 as weekday, " + ", ".join(f"count(*) filter (where hour(detected_at) = {h}) as h{h}" for h in range(24)) + " from episodes group by 1",
    "checks", extra=EPISODE_CTES,
)
def hour_grid(spark, sf):
    out = analytics.hour_grid(report(spark, sf))
    return out.select("weekday", *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h}") for h in range(24)])


@query("select h as hour, count(episode_id) as n from (select unnest(range(24)) as h) left join episodes on hour(detected_at) = h group by 1", "checks", extra=EPISODE_CTES)
def by_hour(spark, sf):
    return analytics.by_hour(report(spark, sf))


@query(
    "select kind, count(*) as episodes, count(*) filter (where not ever_confirmed) as apparent, count(*) filter (where ever_confirmed) as confirmed, round(avg(case when ever_confirmed then 1.0 else 0.0 end), 6) as share from episodes group by 1",
    "checks", extra=EPISODE_CTES,
)
def confirmed_share(spark, sf):
    return analytics.confirmed_share(all_episodes(spark, sf)).select("kind", "episodes", "apparent", "confirmed", r6("share"))


@query(
    f"""select (select count(*) from markets) as total, (select count(*) from markets where not closed) as active, (select count(*) from ({LIVE_ENDS})) as in_relation,
       (select count(*) from markets where event_id like 'Brand#1%') as in_group, (select count(*) from (select condition_id from ({LIVE_ENDS}) union select condition_id from markets where event_id like 'Brand#1%')) as covered,
       (select count(*) from markets where not closed and (event_id like 'Brand#1%' or condition_id in ({LIVE_ENDS}))) as active_covered,
       (select count(*) from reviewed) as proposals, (select round(count(*) filter (where status = 'accepted') / count(*) filter (where status in ('accepted', 'rejected')), 6) from reviewed) as acceptance_rate,
       round((select (epoch_us(max(coalesce(resolved_at, last_bad))) - epoch_us(min(detected_at))) / 3.6e9 from episodes), 4) as hours""",
    "markets", "reviewed", "checks", extra=LADDER_CTES + EPISODE_CTES,
)
def catalog_stats(spark, sf):
    out = analytics.catalog_stats(
        project(spark, sf, "markets"), ladder(spark, sf), flagged_partitions(spark, sf).members, project(spark, sf, "reviewed"), all_episodes(spark, sf)
    )
    return out.select("total", "active", "in_relation", "in_group", "covered", "active_covered", "proposals", r6("acceptance_rate"), F.round("hours", 4).alias("hours"))


@query(
    f"""select (select count(*) from markets where not closed) as active, (select count(*) from markets where not closed and (event_id like 'Brand#1%' or condition_id in ({LIVE_ENDS}))) as covered,
       (select count(*) from markets where not closed) as quoted, (select count(*) from pair) + (select count(distinct event_id) from markets where event_id like 'Brand#1%') as constraints""",
    "markets", extra=LADDER_CTES + IMPLIES_EVAL,
)
def coverage(spark, sf):
    parts = flagged_partitions(spark, sf)
    markets = project(spark, sf, "markets")
    return analytics.coverage(markets, ladder(spark, sf), parts.groups, parts.members, markets).select("active", "covered", "quoted", "constraints")
