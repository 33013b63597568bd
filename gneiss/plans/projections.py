"""The engine's tables as projections of the test tables, for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW_LINES, OVERLAP_LINES = 20, 4


class Tables:
    """Lazily built engine tables over a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def files(self) -> DataFrame:
        """path, language, size_bytes, sha256, modified_time"""
        return self.raw("documents").select(
            F.concat("source", F.lit("/doc_"), "doc_id").alias("path"), F.col("lang").alias("language"), F.octet_length("text").cast("long").alias("size_bytes"),
            F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("modified_time"), "text",
        )

    @property
    def symbols(self) -> DataFrame:
        """qualified_name, name, kind, file_path, start_line, end_line"""

        def part(table: str, prefix: str, key: str, name, file_path) -> DataFrame:
            k = F.col(key).cast("long")
            return self.raw(table).select(
                F.concat(F.lit(prefix), k).alias("qualified_name"), name.alias("name"), F.lit(table).alias("kind"), file_path.alias("file_path"),
                ((k % 97) * 10 + 1).alias("start_line"), ((k % 97) * 10 + 1 + k % 13).alias("end_line"),
            )

        parts = [
            part("customer", "c", "c_custkey", F.col("c_name"), F.col("c_mktsegment")),
            part("orders", "o", "o_orderkey", F.concat(F.lit("order."), "o_orderpriority"), F.col("o_orderstatus")),
            part("part", "p", "p_partkey", F.col("p_name"), F.col("p_brand")),
            part("supplier", "s", "s_suppkey", F.col("s_name"), F.lit("supplier")),
            part("nation", "n", "n_nationkey", F.col("n_name"), F.lit("nation")),
            part("region", "r", "r_regionkey", F.col("r_name"), F.lit("region")),
        ]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def _relations(self, once: bool) -> DataFrame:
        def part(df: DataFrame, prefix: str, key: str, relation: str, other: str, to: str) -> DataFrame:
            return df.select(F.concat(F.lit(prefix), key).alias("source"), F.lit(relation).alias("relation"), F.concat(F.lit(other), to).alias("target"))

        def keys(table: str, *names: str) -> DataFrame:
            return self.raw(table).select(*[F.col(x).cast("long").alias(x) for x in names])

        def pairs(*names: str) -> DataFrame:
            """Repeats go while they are numbers, which is the least there is to shuffle."""
            return keys("lineitem", *names).distinct() if once else keys("lineitem", *names)

        return (
            part(keys("orders", "o_custkey", "o_orderkey"), "c", "o_custkey", "CALLS", "o", "o_orderkey")
            .unionByName(part(pairs("l_orderkey", "l_partkey"), "o", "l_orderkey", "REFERENCES", "p", "l_partkey"))
            .unionByName(part(pairs("l_partkey", "l_suppkey"), "p", "l_partkey", "USES_SERVICE", "s", "l_suppkey"))
            .unionByName(part(keys("supplier", "s_suppkey", "s_nationkey"), "s", "s_suppkey", "HAS_PROPERTY", "n", "s_nationkey"))
            .unionByName(part(keys("nation", "n_nationkey", "n_regionkey"), "n", "n_nationkey", "EXTENDS", "r", "n_regionkey"))
        )

    @property
    def edges(self) -> DataFrame:
        """source, relation, target: customer calls order, order references part, part uses supplier, and so on up to region."""
        return self._relations(once=True)

    @property
    def links(self) -> DataFrame:
        """edges, where those of lineitem may stand more than once: for what only asks whether there is an edge."""
        return self._relations(once=False)

    @property
    def event_edges(self) -> DataFrame:
        """Event type to the user's next one: small and cyclic."""
        return self.spark.sql(
            "select distinct event_type as source, 'IMPORTS' as relation, next as target from"
            " (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as next from {e}) where next is not null and next <> event_type",
            e=self.raw("events"),
        )

    @property
    def nation_edges(self) -> DataFrame:
        """Nations linked if a supplier of one sells a part that a supplier of the other sells too: a small undirected graph."""
        return self.spark.sql(
            """select distinct least(a.n, b.n) as source, 'CALLS' as relation, greatest(a.n, b.n) as target
            from (select distinct l_partkey as p, s_nationkey as n from {l} join {s} on l_suppkey = s_suppkey) a
            join (select distinct l_partkey as p, s_nationkey as n from {l} join {s} on l_suppkey = s_suppkey) b on a.p = b.p and a.n < b.n""",
            l=self.raw("lineitem"), s=self.raw("supplier"),
        )

    @property
    def steps(self) -> DataFrame:
        """process_id, step, symbol: the turns of conversations."""
        return self.raw("conversations").select(F.col("conv_id").alias("process_id"), F.col("turn").alias("step"), F.concat("role", F.lit("."), F.substring_index("text", " ", 1)).alias("symbol"))


SQL = {
    "files": "SELECT source || '/doc_' || doc_id AS path, lang AS language, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256, doc_id AS modified_time, text FROM documents",
    "symbols": """SELECT prefix || k AS qualified_name, name, kind, file_path, (k % 97) * 10 + 1 AS start_line, (k % 97) * 10 + 1 + k % 13 AS end_line FROM (
        SELECT 'c' AS prefix, c_custkey AS k, c_name AS name, 'customer' AS kind, c_mktsegment AS file_path FROM customer
        UNION ALL SELECT 'o', o_orderkey, 'order.' || o_orderpriority, 'orders', o_orderstatus FROM orders
        UNION ALL SELECT 'p', p_partkey, p_name, 'part', p_brand FROM part UNION ALL SELECT 's', s_suppkey, s_name, 'supplier', 'supplier' FROM supplier
        UNION ALL SELECT 'n', n_nationkey, n_name, 'nation', 'nation' FROM nation UNION ALL SELECT 'r', r_regionkey, r_name, 'region', 'region' FROM region)""",
    "edges": """SELECT 'c' || o_custkey AS source, 'CALLS' AS relation, 'o' || o_orderkey AS target FROM orders
        UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'REFERENCES', 'p' || l_partkey FROM lineitem
        UNION ALL SELECT DISTINCT 'p' || l_partkey, 'USES_SERVICE', 's' || l_suppkey FROM lineitem
        UNION ALL SELECT 's' || s_suppkey, 'HAS_PROPERTY', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'EXTENDS', 'r' || n_regionkey FROM nation""",
    "event_edges": """SELECT DISTINCT event_type AS source, 'IMPORTS' AS relation, next AS target FROM
        (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL AND next <> event_type""",
    "sold": "SELECT DISTINCT l_partkey AS p, s_nationkey AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "nation_edges": "SELECT DISTINCT a.n AS source, 'CALLS' AS relation, b.n AS target FROM sold AS a JOIN sold AS b ON a.p = b.p AND a.n < b.n",
    "steps": "SELECT conv_id AS process_id, turn AS step, role || '.' || split_part(text, ' ', 1) AS symbol FROM conversations",
}


def with_tables(tables: str, body: str) -> str:
    """body as SQL over the named engine tables. ``recursive`` among the names, or further CTEs in body before ``||``, are taken up."""
    names = tables.split()
    ctes = [f"{n} AS ({SQL[n]})" for n in names if n != "recursive"]
    more, _, main = body.rpartition("||select||")
    if more:
        ctes.append(more.strip().rstrip(","))
    head = ("WITH RECURSIVE " if "recursive" in names else "WITH ") + ", ".join(ctes) if ctes else ""
    return f"{head} {main}"
