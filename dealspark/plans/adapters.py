"""Views of the given tables in the shape of the domain's: drafts, library, revenue, decks, emails, conversations.

Each view is one SQL text that Spark and DuckDB both run; Spark gets it over DataFrames, without registering anything."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "vDrafts": """select o_orderkey as id, o_custkey % 50 as user_id, c_name as company,
        case when o_orderpriority in ('1-URGENT','2-HIGH') then 'High' when o_orderpriority = '3-MEDIUM' then 'Medium' else 'Low' end as confidence,
        o_orderstatus as status, o_orderdate as created_at, o_totalprice as amount
        from orders join customer on o_custkey = c_custkey""",
    "vLibrary": """select l_orderkey * 10 + l_linenumber as id, c_name as company,
        replace(p_brand, '#', '_') || '_Pitch_Deck_v' || cast(p_size as varchar(20)) || '.pdf' as file_name,
        cast(floor(l_extendedprice * 1000) as bigint) as file_size,
        case l_returnflag when 'A' then 'application/pdf' when 'N' then 'text/csv' else 'text/plain' end as file_type,
        l_shipdate as date_uploaded, l_orderkey % 20 as upload_batch, l_linestatus = 'F' as processed
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey""",
    "vRevenue": """select c_name as company, cast(year(o_orderdate) as varchar(4)) as yr, sum(o_totalprice) as revenue
        from orders join customer on o_custkey = c_custkey group by c_name, year(o_orderdate)""",
    "vDecks": """select c_custkey as doc_id, c_name as company,
        'Company: ' || c_name || '. ' ||
        case c_mktsegment when 'AUTOMOBILE' then 'Electric vehicle fleet startup. ' when 'BUILDING' then 'SaaS subscription platform. '
            when 'HOUSEHOLD' then 'Retail marketplace with strong growth. ' when 'MACHINERY' then 'Factory production, debt is a risk. ' else 'Medical clinical product. ' end ||
        case when c_custkey % 3 = 0 then '' else 'Revenue: $' || cast(c_custkey % 90 + 1 as varchar(9)) || 'M. ' end ||
        case when c_custkey % 4 = 0 then '' else cast(c_custkey % 150 + 1 as varchar(9)) || '% growth YoY. ' end ||
        case when c_custkey % 5 = 0 then '' else cast(c_custkey % 700 + 10 as varchar(9)) || 'K users. ' end ||
        case when c_custkey % 7 = 0 then '' else 'TAM: $' || cast(c_custkey % 40 + 1 as varchar(9)) || 'B. ' end ||
        case c_custkey % 4 when 0 then 'Raising seed round. ' when 1 then 'Raising $5M Series A. ' when 2 then 'Pilot and MVP in beta. ' else '' end as text
        from customer""",
    "vEmails": """select event_id as id, ts as received_at, user_id,
        case event_id % 8 when 0 then 'We are interested and would like to schedule a call about the term sheet.'
            when 1 then 'Unfortunately this is not a fit for our fund, we will pass.'
            when 2 then 'Maybe, we need more info. Please follow up with questions.'
            when 3 then 'Please open the data room for due diligence, we need the cap table.'
            when 4 then 'Our team wants a demo and pricing for the product pilot.'
            when 5 then 'Not interested at this time.'
            when 6 then 'Hello, reaching out for an introduction to the founder.'
            else 'Thanks.' end as body
        from events""",
    "vConversations": """select conv_id * 100 + turn as id, conv_id, turn, text as query, response from (
        select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as response,
            lead(role) over (partition by conv_id order by turn) as next_role from conversations) t
        where role = 'user' and next_role = 'assistant'""",
}

_TABLES = ("orders", "customer", "lineitem", "part", "events", "conversations")


#: Views whose rows cost far more than their bytes tell (texts under many patterns): the file's rows are dealt to all tasks by this key.
_DEALT = {"vDecks": "c_custkey"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of a folder."""
    sql, args = VIEWS[name], {}
    for t in _TABLES:
        pattern = rf"\b(from|join) {t}\b"
        if re.search(pattern, sql):
            sql = re.sub(pattern, rf"\1 {{{t}}}", sql)
            args[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            if name in _DEALT:
                args[t] = args[t].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), _DEALT[name])
    return spark.sql(sql, **args)
