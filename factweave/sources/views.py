"""Facts, edges, holders and the rest, read as plain projections of the given tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from factweave.functions.text import content_key
from factweave.schemas import MEMORY_TYPES

AS_OF = "2024-12-31 00:00:00"
STRATEGIES = ("preference_clash", "factual", "taste", "charter_deferred")
FAMILIES = ("IMPLIES", "BECAUSE", "CONTRADICTS", "SUPPORTS", "RELATES_TO")


def _mem(x) -> F.Column:
    return F.concat(F.lit("mem_"), x.cast("string"))


def _pick(values, k):
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


class Views:
    """The views of one folder of tables; each is built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n(self) -> int:
        return self.table("documents").count()

    @cached_property
    def memories(self) -> DataFrame:
        d = F.col("doc_id")
        day = lambda k: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        kind, text = _pick(MEMORY_TYPES, d % 8), F.coalesce("text", F.lit(""))
        return self.table("documents").select(
            "doc_id", _mem(d).alias("memory_id"), text.alias("content"), F.coalesce("source", F.lit("")).alias("user_id"), kind.alias("memory_type"),
            (d * 37 % 101).alias("certainty"), (d * 53 % 101).alias("importance"), day(d % 365).alias("created_at"),
            F.when(d % 5 == 0, "").when(d % 97 == 1, "not a time").otherwise(day(d % 365 - d % 30)).alias("valid_from"),
            F.when(d % 4 == 0, F.concat(F.lit('{"Lang:'), F.coalesce("lang", F.lit("")), F.lit('": 1, "work": 1}'))).when(d % 4 == 1, F.coalesce("lang", F.lit(""))).when(d % 4 == 2, "Work").otherwise("").alias("context_tags"),
            content_key(text, kind).alias("content_key"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        d, n = F.col("doc_id"), F.lit(self.n)
        docs = self.table("documents").select("doc_id")
        one = docs.select(_mem(d).alias("src"), _mem((d * 7 + 3) % n).alias("dst"), _pick(FAMILIES, d % 5).alias("edge_type"), (d * 29 % 101).alias("strength"))
        two = docs.select(_mem(d).alias("src"), _mem((d * 13 + 5) % n).alias("dst"), _pick(FAMILIES, (d + 2) % 5).alias("edge_type"), (d * 31 % 101).alias("strength"))
        hub = docs.where("doc_id % 50 = 0").select(_mem(d).alias("src"), F.lit("mem_0").alias("dst"), F.lit("RELATES_TO").alias("edge_type"), F.lit(50).cast("long").alias("strength"))
        return one.unionByName(two).unionByName(hub).where("src <> dst").groupBy("src", "dst", "edge_type").agg(F.max("strength").alias("strength"))

    @cached_property
    def supersedes(self) -> DataFrame:
        d = F.col("doc_id")
        return self.table("documents").where((d % 20 == 7) & (d + 1 < self.n)).select(_mem(d + 1).alias("src"), _mem(d).alias("dst"))

    @cached_property
    def contradicts(self) -> DataFrame:
        d = F.col("doc_id")
        return self.table("documents").where(d % 3 != 2).select(_mem(d - d % 2).alias("src"), _mem((d + 11) % self.n).alias("dst"), (d % 4 == 0).cast("int").alias("resolved"), _pick(STRATEGIES, d % 4).alias("strategy")).where("src <> dst")

    @cached_property
    def holders(self) -> DataFrame:
        m = self.memories.select("memory_id", "content_key", "user_id", "doc_id")
        who = m.select("content_key", "user_id").distinct()
        stance = F.when(F.col("doc_id") % 7 == 0, "disputes").when(F.col("doc_id") % 11 == 0, "").otherwise("knows")
        return m.select("memory_id", "content_key", stance.alias("stance")).join(who, "content_key").select("user_id", "memory_id", "stance")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(_mem(F.col("vec_id")).alias("memory_id"), "embedding", "vec_id")

    @cached_property
    def queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))

    @cached_property
    def vector_queries(self) -> DataFrame:
        """The searches: every vector whose id is divisible by 20."""
        return self.table("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")

    @cached_property
    def tagged(self) -> DataFrame:
        """The tags with their repetitions, for what makes sets of them itself."""
        part = self.table("part").select("p_partkey", "p_brand")
        return self.table("lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select(_mem(F.col("l_orderkey")).alias("memory_id"), F.col("p_brand").alias("category_id"))

    @cached_property
    def tags(self) -> DataFrame:
        return self.tagged.distinct()

    @cached_property
    def categories(self) -> DataFrame:
        return self.table("part").groupBy(F.col("p_brand").alias("category_id")).agg(F.min("p_type").alias("parent_id"), F.min("p_name").alias("description")).withColumn("name", F.lower("category_id"))

    @cached_property
    def entities(self) -> DataFrame:
        return self.table("lineitem").select(_mem(F.col("l_orderkey")).alias("memory_id"), F.col("l_suppkey").alias("entity_id")).distinct()

    @cached_property
    def memory_groups(self) -> DataFrame:
        owner = self.table("customer").select("c_custkey", "c_nationkey")
        return self.table("orders").select("o_orderkey", "o_custkey").join(owner, F.col("o_custkey") == F.col("c_custkey")).select(_mem(F.col("o_orderkey")).alias("memory_id"), F.concat(F.lit("g"), "c_nationkey").alias("group_id"), F.concat(F.lit("u"), "c_custkey").alias("owner"))

    @cached_property
    def groups(self) -> DataFrame:
        return self.table("nation").select(F.concat(F.lit("g"), "n_nationkey").alias("group_id"), F.when(F.col("n_regionkey") < 3, F.concat(F.lit("d"), "n_regionkey")).alias("dedup_group_id"))

    @cached_property
    def assignments(self) -> DataFrame:
        k = F.col("c_custkey")
        roles = ("administrator", "group-admin", "mod", "Member", "read-only", "lead")
        role = _pick(roles, k % 6)
        # one customer in six hundred is an administrator of everything
        glob = (k % 6 == 0) & (k % 600 == 0)
        return self.table("customer").select(F.concat(F.lit("u"), "c_custkey").alias("subject"), F.when(glob, F.lit(None).cast("string")).otherwise(F.concat(F.lit("g"), "c_nationkey")).alias("group_id"), F.when((k % 6 == 0) & ~glob, "worker").otherwise(role).alias("role"), F.when(k % 17 == 0, "revoked").otherwise("active").alias("status"))

    @cached_property
    def heartbeats(self) -> DataFrame:
        return self.table("events").select(F.concat(F.lit("agent-"), "user_id").alias("agent_id"), F.concat(F.lit("p"), F.col("user_id") % 30).alias("principal_id"), F.concat(F.lit("h"), F.col("user_id") % 7).alias("host"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "working").otherwise("idle").alias("status"), "ts", "event_id")

    @cached_property
    def history(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("memory_id"), F.col("event_type").alias("action"), "ts", "event_id", "value")


def _days(k: str) -> str:
    return f"strftime(DATE '2024-01-01' + CAST({k} AS INTEGER), '%Y-%m-%dT%H:%M:%SZ')"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_TYPE = f"({_list(MEMORY_TYPES)})[CAST(doc_id % 8 AS INTEGER) + 1]"
SQL = {
    "memories": f"""SELECT doc_id, 'mem_' || doc_id AS memory_id, coalesce(text, '') AS content, coalesce(source, '') AS user_id, {_TYPE} AS memory_type,
        doc_id * 37 % 101 AS certainty, doc_id * 53 % 101 AS importance, {_days("doc_id % 365")} AS created_at,
        CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 97 = 1 THEN 'not a time' ELSE {_days("doc_id % 365 - doc_id % 30")} END AS valid_from,
        CASE doc_id % 4 WHEN 0 THEN '{{"Lang:' || coalesce(lang, '') || '": 1, "work": 1}}' WHEN 1 THEN coalesce(lang, '') WHEN 2 THEN 'Work' ELSE '' END AS context_tags,
        sha256(lower({_TYPE}) || chr(0) || lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))) AS content_key FROM documents""",
    "timed": """SELECT *, coalesce(try_cast(nullif(valid_from, '') AS TIMESTAMPTZ), try_cast(created_at AS TIMESTAMPTZ)) AT TIME ZONE 'UTC' AS moment FROM memories""",
    "edges": f"""SELECT src, dst, edge_type, max(strength) AS strength FROM (
        SELECT 'mem_' || doc_id AS src, 'mem_' || ((doc_id * 7 + 3) % (SELECT count(*) FROM documents)) AS dst, ({_list(FAMILIES)})[CAST(doc_id % 5 AS INTEGER) + 1] AS edge_type, doc_id * 29 % 101 AS strength FROM documents
        UNION ALL SELECT 'mem_' || doc_id, 'mem_' || ((doc_id * 13 + 5) % (SELECT count(*) FROM documents)), ({_list(FAMILIES)})[CAST((doc_id + 2) % 5 AS INTEGER) + 1], doc_id * 31 % 101 FROM documents
        UNION ALL SELECT 'mem_' || doc_id, 'mem_0', 'RELATES_TO', 50 FROM documents WHERE doc_id % 50 = 0) WHERE src <> dst GROUP BY ALL""",
    "supersedes": "SELECT 'mem_' || (doc_id + 1) AS src, 'mem_' || doc_id AS dst FROM documents WHERE doc_id % 20 = 7 AND doc_id + 1 < (SELECT count(*) FROM documents)",
    "contradicts": f"""SELECT * FROM (SELECT 'mem_' || (doc_id - doc_id % 2) AS src, 'mem_' || ((doc_id + 11) % (SELECT count(*) FROM documents)) AS dst, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS resolved, ({_list(STRATEGIES)})[CAST(doc_id % 4 AS INTEGER) + 1] AS strategy FROM documents WHERE doc_id % 3 <> 2) WHERE src <> dst""",
    "holders": """SELECT w.user_id, m.memory_id, CASE WHEN doc_id % 7 = 0 THEN 'disputes' WHEN doc_id % 11 = 0 THEN '' ELSE 'knows' END AS stance FROM memories m JOIN (SELECT DISTINCT content_key, user_id FROM memories) w USING (content_key)""",
    "vectors": "SELECT 'mem_' || vec_id AS memory_id, embedding, vec_id FROM embeddings",
    "queries": "SELECT item_id AS query_id, coalesce(text, '') AS text FROM benchmark",
    "vector_queries": "SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0",
    "tags": "SELECT DISTINCT 'mem_' || l_orderkey AS memory_id, p_brand AS category_id FROM lineitem JOIN part ON l_partkey = p_partkey",
    "categories": "SELECT p_brand AS category_id, min(p_type) AS parent_id, min(p_name) AS description, lower(p_brand) AS name FROM part GROUP BY p_brand",
    "entities": "SELECT DISTINCT 'mem_' || l_orderkey AS memory_id, l_suppkey AS entity_id FROM lineitem",
    "memory_groups": "SELECT 'mem_' || o_orderkey AS memory_id, 'g' || c_nationkey AS group_id, 'u' || c_custkey AS owner FROM orders JOIN customer ON o_custkey = c_custkey",
    "groups": "SELECT 'g' || n_nationkey AS group_id, CASE WHEN n_regionkey < 3 THEN 'd' || n_regionkey END AS dedup_group_id FROM nation",
    "assignments": """SELECT 'u' || c_custkey AS subject, CASE WHEN c_custkey % 600 = 0 THEN NULL ELSE 'g' || c_nationkey END AS group_id, CASE WHEN c_custkey % 6 = 0 AND c_custkey % 600 <> 0 THEN 'worker' ELSE (['administrator', 'group-admin', 'mod', 'Member', 'read-only', 'lead'])[CAST(c_custkey % 6 AS INTEGER) + 1] END AS role, CASE WHEN c_custkey % 17 = 0 THEN 'revoked' ELSE 'active' END AS status FROM customer""",
    "bindings": """SELECT DISTINCT subject, group_id, CASE lower(role) WHEN 'administrator' THEN 'admin' WHEN 'group-admin' THEN 'groupadmin' WHEN 'mod' THEN 'moderator' WHEN 'member' THEN 'worker' WHEN 'worker' THEN 'worker' WHEN 'read-only' THEN 'viewer' WHEN 'lead' THEN 'teamlead' END AS role FROM assignments WHERE status = 'active'""",
    "heartbeats": "SELECT 'agent-' || user_id AS agent_id, 'p' || (user_id % 30) AS principal_id, 'h' || (user_id % 7) AS host, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'working' ELSE 'idle' END AS status, ts, event_id FROM events",
    "history": "SELECT user_id AS memory_id, event_type AS action, ts, event_id, value FROM events",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the definitions of the views that it names, directly or through others."""
    known = SQL | (extra or {})
    needed: list[str] = []

    def need(text: str, inside: tuple[str, ...] = ()) -> None:
        for name in known:
            if name not in needed and name not in inside and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(known[name], (*inside, name))
                needed.append(name)

    need(body)
    return ("WITH RECURSIVE " + ", ".join(f"{n} AS ({known[n]})" for n in needed) + " " if needed else "") + body
