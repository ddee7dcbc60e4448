"""Market-shaped views of the driver tables, as SQL both engines read.

``{part}`` and the like stand for the tables; every projection covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

PROJECTIONS = {
    # A market per part: one threshold ladder per brand and type.
    "markets": """
        select concat('m', lpad(cast(p_partkey as string), 8, '0')) as condition_id, p_brand as event_id,
               concat('Will ', p_type, ' index be above $', cast(p_size as string), 'k on September 4?') as question,
               p_name like 'small%' as closed, cast(null as timestamp) as missing_since,
               cast((p_partkey * 37 + p_size * 11) % 97 + 1 as double) / 100 as yes_price,
               p_partkey, p_name, p_type, p_size, p_brand
        from {part}""",
    # Levels of the Yes ('y') and No ('n') tokens of those markets.
    "levels": """
        select concat(case when l_returnflag = 'R' then 'n' else 'y' end, lpad(cast(l_partkey as string), 8, '0')) as token_id,
               case when l_linestatus = 'O' then 'bid' else 'ask' end as side,
               cast((l_partkey * 7 + l_suppkey * 13 + l_linenumber * 5) % 99 + 1 as double) / 100 as price,
               l_quantity as size
        from {lineitem}""",
    "cheap_levels": """
        select concat(case when l_returnflag = 'R' then 'n' else 'y' end, lpad(cast(l_partkey as string), 8, '0')) as token_id,
               'ask' as side, cast((l_suppkey * 13 + l_linenumber * 5) % 60 + 1 as double) / 100 as price, l_quantity as size
        from {lineitem}""",
    # Mutually exclusive sets: the lines of an order.
    "partition_prices": """
        select cast(l_orderkey as string) as group_id, concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) as condition_id,
               min(cast((l_partkey * 3 + l_linenumber * 17) % 60 + 1 as double) / 100) as price
        from {lineitem} group by l_orderkey, l_linenumber""",
    # A check of a constraint per event.
    "checks": """
        select concat(case when user_id < 75 then 'implies:' else 'partition:' end, cast(user_id as string)) as constraint_key,
               case when user_id < 75 then 'implies' else 'partition' end as kind,
               ts as check_ts, event_id, value > 50 as violated, event_type = 'error' as unscreenable,
               value / 500 as magnitude, event_type = 'purchase' as confirmed,
               case when event_type = 'purchase' then value end as net_profit,
               case when event_type = 'purchase' then value / 1000 end as net_edge, value / 10 as size,
               case event_type when 'click' then 'net edge -0.50c per unit: spread and fees exceed the mispricing'
                    when 'view' then 'a real gap, but too thin to be worth taking'
                    when 'signup' then 'no order book for a leg' else 'no reason given' end as reason,
               2 as members, concat('m', lpad(cast(user_id as string), 8, '0')) as first_condition_id
        from {events}""",
    "level_changes": """
        select cast(user_id as string) as token_id, case when event_type in ('click', 'view') then 'bid' else 'ask' end as side,
               cast(cast(floor(value) as bigint) % 99 + 1 as double) / 100 as price,
               case when event_type = 'error' then 0 else floor(value) end as size, ts, event_id as seq
        from {events}""",
    # Two crawls of a catalog: the orders before and from 1998, newest order per customer.
    "crawl_before": """
        select cast(o_custkey as string) as condition_id, o_orderstatus as question, o_orderpriority as description,
               o_orderstatus = 'F' as closed, o_orderdate as end_date, o_orderkey as arrival
        from {orders} where o_orderdate < timestamp '1998-01-01 00:00:00'""",
    "crawl_after": """
        select cast(o_custkey as string) as condition_id, o_orderstatus as question, o_orderpriority as description,
               o_orderstatus = 'F' as closed, cast(null as timestamp) as end_date, o_orderkey as arrival
        from {orders} where o_orderdate >= timestamp '1998-01-01 00:00:00'""",
    "deadlines": """
        select concat('d', cast(o_orderkey as string)) as condition_id,
               concat('Will a ', o_orderpriority, ' order of customer ', cast(o_custkey as string), ' clear by ', cast(year(o_orderdate) as string), '?') as question,
               o_orderdate as end_date
        from {orders}""",
    "negations": """
        select concat('m', lpad(cast(p_partkey as string), 8, '0')) as condition_id, p_brand as event_id,
               concat('Will ', p_name, case when p_size > 25 then ' not' else '' end, ' sell to ', p_type, '?') as question
        from {part}""",
    "band_markets": """
        select concat('b', lpad(cast(p_partkey as string), 8, '0')) as condition_id, p_brand as event_id,
               concat('Will ', p_type, ' close between $', cast(p_size as string), 'K and $', cast(p_size + 2 as string), 'K on Friday?') as question,
               cast(null as timestamp) as missing_since, p_type, p_size
        from {part}""",
    "vectors": "select vec_id as condition_id, cast(label as string) as event_id, embedding from {embeddings}",
    # Chains of customers in key order; a negative balance points back, which closes cycles.
    "customer_edges": """
        select cast(c_custkey as string) as from_condition_id,
               cast(case when c_acctbal >= 0 then c_custkey + 1 else c_custkey - c_nationkey - 1 end as string) as to_condition_id,
               'implies' as type, 'ladder' as source
        from {customer}""",
    # Orders of one status follow one another: three long chains.
    "order_line": """
        select lpad(cast(o_orderkey as string), 12, '0') as node, o_orderstatus as line, o_custkey as customer,
               o_orderkey as position, o_orderkey % 32 < 3 as returns
        from {orders}""",
    "proposals_in": """
        select cast(user_id as string) as a_condition_id, cast(cast(floor(value) as bigint) as string) as b_condition_id,
               case event_type when 'click' then 'implies' when 'view' then 'implied_by' when 'signup' then 'complement'
                    when 'error' then 'mutually_exclusive' else 'unrelated' end as relation,
               event_type as rationale, value / 500 as confidence, 'm1' as model, value / 600 as similarity, event_id as arrival
        from {events}""",
    "reviewed": """
        select cast(d.doc_id as string) as id, concat('a', cast(d.doc_id as string)) as low_condition_id, concat('b', cast(d.doc_id as string)) as high_condition_id,
               case d.lang when 'en' then 'implies' when 'fr' then 'implied_by' when 'de' then 'complement' else 'unrelated' end as proposed_type,
               d.source as rationale, cast(d.n_chars as double) / 100000 as model_confidence, 'm1' as model, cast(null as double) as similarity,
               case when l.quality = 1 then 'accepted' when l.quality = 0 then 'rejected' else 'pending' end as status,
               cast(null as string) as reviewed_by, cast(null as string) as review_note
        from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
    # Cumulative counters of a service, one sample per event.
    "samples": """
        select cast(user_id as string) as source, ts as sampled_at, date_trunc('hour', ts) as last_ingest_at,
               event_id + cast(floor(value) as bigint) as rate_limit_hits, cast(floor(value / 10) as bigint) as queue_depth,
               event_id * 50 as records, event_id * 2 + cast(floor(value * 10) as bigint) as parse_issues, event_id
        from {events}""",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table; its zone-less timestamps are UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    zoneless = [name for name, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def project(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = PROJECTIONS[name]
    used = {t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def ctes(*names: str) -> list[tuple[str, str]]:
    """The same projections as (name, text) for the other engine."""
    out = []
    for name in names:
        text = PROJECTIONS[name]
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        out.append((name, text))
    return out
