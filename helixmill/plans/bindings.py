"""Domain tables as deterministic views of the driver's tables, in Spark and, for the oracle, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.operators.pairs import cosines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranges(spark, sf_dir) -> DataFrame:
    """species, start, end, is_pan, ord"""
    blocks = table(spark, sf_dir, "part").selectExpr("p_partkey div 100 as b").distinct()
    return blocks.selectExpr("concat('S', b) as species", "b * 100 + 1 as start", "b * 100 + 97 as end", "cast(b % 2 as int) as is_pan", "b as ord")


def nodes(spark, sf_dir) -> DataFrame:
    """species, node_id, node_len"""
    parts = table(spark, sf_dir, "part").filter("p_partkey % 100 < 97")
    return parts.selectExpr("concat('S', p_partkey div 100) as species", "p_partkey + 1 as node_id", "cast(p_size as bigint) as node_len")


def lengths(spark, sf_dir) -> DataFrame:
    """species, len; one species in eleven is missing"""
    parts = table(spark, sf_dir, "part").filter("(p_partkey div 100) % 11 <> 9")
    return parts.groupBy(F.expr("concat('S', p_partkey div 100)").alias("species")).agg(F.sum("p_size").cast("double").alias("len"))


def reads(spark, sf_dir) -> DataFrame:
    """rid, read_id, read_len, mapq, path, read_start, read_end, matches, identity, span"""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey as l_partkey", "cast(p_size as bigint) as first_len")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount")
    joined = line.join(part, "l_partkey")
    joined = joined.selectExpr(
        "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rid",
        "cast(l_orderkey as string) as read_id",
        "cast(l_quantity as bigint) * 10 as read_len",
        "(l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 61 as m",
        "l_partkey div 100 as b",
        "transform(sequence(0, cast((l_linenumber + l_suppkey) % 5 as int)), k -> l_partkey + 1 + k + if(k >= 2, l_suppkey % 2, 0)) as ids",
        "(l_linenumber * 3) % first_len as read_start",
        "cast(l_quantity as bigint) as q",
        "l_discount as d",
    )
    return joined.selectExpr(
        "rid", "read_id", "read_len",
        "cast(case when b % 4 = 0 then m % 60 when b % 7 = 3 then if(m = 60, 60, 1) else m end as int) as mapq",
        "concat('>', array_join(transform(ids, x -> cast(x as string)), '>')) as path",
        "read_start", "read_start + q - 5 as read_end",
        "q * 20 as matches", "1.0D - d as identity", "q * 60 as span",
    )


def walks(spark, sf_dir) -> DataFrame:
    """species, hap_id, pos, node_id"""
    every = nodes(spark, sf_dir).crossJoin(spark.range(6).toDF("h"))  # six haplotypes by construction
    kept = every.filter("(node_id * (h + 3) + h * h) % 5 <> 0")
    return kept.selectExpr("species", "concat('H', h) as hap_id", "cast(row_number() over (partition by species, h order by node_id) as int) - 1 as pos", "node_id")


def sequences(spark, sf_dir) -> DataFrame:
    """genome, seq_id, seq"""
    return table(spark, sf_dir, "documents").selectExpr("source as genome", "doc_id as seq_id", "text as seq")


def genomes(spark, sf_dir) -> DataFrame:
    """label, genome, n50, is_ref: one per vector"""
    return table(spark, sf_dir, "embeddings").selectExpr("label", "vec_id as genome", "cast((vec_id * 37) % 1000 as bigint) as n50", "vec_id % 50 = 0 as is_ref")


def vectors(spark, sf_dir) -> DataFrame:
    """label, id, e: the vectors of the genomes"""
    return table(spark, sf_dir, "embeddings").selectExpr("label", "vec_id as id", "embedding as e")


def similarities(spark, sf_dir, least: float | None = None, among: DataFrame | None = None) -> DataFrame:
    """label, query, refer, ani: cosine in percent, each unordered pair of a label once; with ``least`` those that reach it, with ``among`` those of these genomes"""
    held = vectors(spark, sf_dir)
    if among is not None:
        held = held.join(among.select("label", F.col("genome").alias("id")), ["label", "id"], "left_semi")
    return cosines(held, least)


def links(spark, sf_dir, least: float) -> DataFrame:
    """Similarities of at least ``least`` that connect just the genomes that all of these connect."""
    return cosines(vectors(spark, sf_dir), least, spanning=True)


#: The same views in DuckDB, each using those before it.
VIEWS = {
    "b_range": """select 'S' || b as species, b * 100 + 1 as "start", b * 100 + 97 as "end", (b % 2)::int as is_pan, b as ord from (select distinct p_partkey // 100 as b from part)""",
    "b_node": "select 'S' || (p_partkey // 100) as species, p_partkey + 1 as node_id, p_size::bigint as node_len from part where p_partkey % 100 < 97",
    "b_len": "select 'S' || (p_partkey // 100) as species, sum(p_size)::double as len from part where (p_partkey // 100) % 11 <> 9 group by 1",
    "b_raw": """select concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) as rid, l_orderkey::varchar as read_id, l_quantity::bigint * 10 as read_len,
        (l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 61 as m, l_partkey // 100 as b, l_partkey, l_suppkey,
        list_transform(range(0, (l_linenumber + l_suppkey) % 5 + 1), lambda k: l_partkey + 1 + k + (case when k >= 2 then l_suppkey % 2 else 0 end)) as ids,
        (l_linenumber * 3) % p_size::bigint as read_start, l_quantity::bigint as q, l_discount as d from lineitem join part on p_partkey = l_partkey""",
    "b_read": """select rid, read_id, read_len, (case when b % 4 = 0 then m % 60 when b % 7 = 3 then (case when m = 60 then 60 else 1 end) else m end)::int as mapq,
        '>' || array_to_string(ids, '>') as path, ids, list_min(ids) as mn, list_max(ids) as mx, read_start, read_start + q - 5 as read_end, q * 20 as matches, 1.0 - d as identity, q * 60 as span from b_raw""",
    "b_class": """select r.*, coalesce(g.species, 'U') as species from b_read r left join b_range g on r.mn >= g."start" and r.mx <= g."end" """,
    "b_walk": """select species, 'H' || h as hap_id, (row_number() over (partition by species, h order by node_id) - 1)::int as pos, node_id
        from b_node, (select unnest(range(0, 6)) as h) where (node_id * (h + 3) + h * h) % 5 <> 0""",
    "b_seq": "select source as genome, doc_id as seq_id, text as seq from documents",
    "b_genome": "select label, vec_id as genome, ((vec_id * 37) % 1000)::bigint as n50, vec_id % 50 = 0 as is_ref from embeddings",
    "b_sim": """select a.label, a.vec_id as query, b.vec_id as refer, round(100 * list_dot_product(a.embedding::double[], b.embedding::double[])
        / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[])), 6) as ani
        from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id""",
}
