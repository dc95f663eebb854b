"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from dealspark.llm import centroids, decontaminate, infill, langid, licenses, mergedfa, neardup, packing, phrases, suffixarray, topk, toxicity, urlfilter
from dealspark.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": lambda spark, d: neardup.op1(read_table(spark, d, "documents")),
    "op2_passages": lambda spark, d: phrases.op2(read_table(spark, d, "documents")),
    "op3_url_filter": lambda spark, d: urlfilter.op3(read_table(spark, d, "pages")),
    "op4_decontamination": lambda spark, d: decontaminate.op4(read_table(spark, d, "documents"), read_table(spark, d, "benchmark")),
    "op5_licences": lambda spark, d: licenses.op5(read_table(spark, d, "documents")),
    "op6_topk": lambda spark, d: topk.op6(read_table(spark, d, "embeddings")),
    "op7_substrings": lambda spark, d: suffixarray.op7(read_table(spark, d, "documents")),
    "op8_packing": lambda spark, d: packing.op8(read_table(spark, d, "documents")),
    "op9_toxicity": lambda spark, d: toxicity.op9(read_table(spark, d, "documents"), read_table(spark, d, "labels")),
    "pipeline": corpus_pipeline.run,
    "op10_language_id": lambda spark, d: langid.op10(read_table(spark, d, "documents")),
    "op11_centroids": lambda spark, d: centroids.op11(read_table(spark, d, "embeddings")),
    "op12_bpe_automaton": lambda spark, d: mergedfa.op12(read_table(spark, d, "documents")),
    "op13_fill_in_middle": lambda spark, d: infill.op13(read_table(spark, d, "documents")),
}


def _kmeans_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """The rounds written out one after another; a centroid no vector is nearest to stays."""
    near = """select {keep} arg_min(c, d * {k} + c) as c, min(d) as d from (
        select n, any_value(vec_id) as vec_id, c, sum((x - y) * (x - y)) as d from (select n, vec_id, c, unnest(v) as x, unnest(m) as y from v, c{r}) group by n, c) group by n"""
    parts = [
        """e as materialized (select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
        where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0), v as materialized (select * from e)""",
        f"c0 as materialized (select row_number() over (order by h, v) - 1 as c, v as m from (select sha256('{seed}:' || coalesce(cast(vec_id as varchar), '')) as h, v from v order by h, v limit {k}))",
    ]
    for r in range(rounds):
        parts += [
            f"a{r} as materialized ({near.format(keep='n,', k=k, r=r)})",
            f"s{r} as (select c, i, sum(x) as s, count(*) as n from (select a.c, unnest(v) as x, unnest(range(64)) as i from a{r} a join v using (n)) group by 1, 2)",
            f"c{r + 1} as materialized (select c{r}.c, coalesce(t.m, c{r}.m) as m from c{r} left join (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as m from s{r} group by 1) t using (c))",
        ]
    parts.append(f"f as materialized ({near.format(keep='any_value(vec_id) as vec_id,', k=k, r=rounds)})")
    last = """select vec_id, cast(f.c as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by f.c) as bigint) as cluster_inertia,
        cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256 from f join c{r} using (c)"""
    return "with " + ", ".join(parts) + " " + last.format(r=rounds)

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op6_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
            from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0)
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
        qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
    """,
    "op11_centroids": _kmeans_sql(),
    "op13_fill_in_middle": r"""
        with t as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
        u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as u from t),
        n as (select *, len(u) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from u),
        c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
            case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from n),
        p as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from c)
        select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
            sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
        from p
    """,
}
