"""The given tables seen as the domain's: a graph, a board, an event log, timers, files and mailboxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers and suppliers, and where they lie; roots are the regions.

    All orders link customers to the suppliers of their items, so that there are circles.
    """
    t = lambda n: table(spark, sf_dir, n)
    none = F.array().cast("array<string>")

    def entity(df: DataFrame, kind: str, prefix: str, key: str, text: str, shift: int) -> DataFrame:
        return df.select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("ref_id"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("name"), F.lit(kind).alias("entity_type"),
            F.col(text).alias("description"), none.alias("observations"), F.lit(prefix == "R:").alias("is_root"), (F.col(key).cast("long") * 4 + shift).alias("ord"),
        )

    def relation(df: DataFrame, kind: str, a: tuple[str, str], b: tuple[str, str], shift: int) -> DataFrame:
        one, other = (F.concat(F.lit(p), F.col(c).cast("string")) for p, c in (a, b))
        return df.select(
            F.concat(one, F.lit(">"), other).alias("ref_id"), one.alias("from_entity"), other.alias("to_entity"), F.lit(kind).alias("relation_type"), F.lit("").alias("description"),
            (F.col(a[1]).cast("long") * 1_000_000 + F.col(b[1]).cast("long") * 4 + shift).alias("ord"),
        )

    entities = entity(t("region"), "region", "R:", "r_regionkey", "r_name", 0)
    entities = entities.unionByName(entity(t("nation"), "nation", "N:", "n_nationkey", "n_name", 1))
    entities = entities.unionByName(entity(t("customer"), "customer", "C:", "c_custkey", "c_mktsegment", 2))
    entities = entities.unionByName(entity(t("supplier"), "supplier", "S:", "s_suppkey", "s_name", 3))
    relations = relation(t("nation"), "PART_OF", ("N:", "n_nationkey"), ("R:", "n_regionkey"), 0)
    relations = relations.unionByName(relation(t("customer"), "LOCATED_IN", ("C:", "c_custkey"), ("N:", "c_nationkey"), 1))
    relations = relations.unionByName(relation(t("supplier"), "LOCATED_IN", ("S:", "s_suppkey"), ("N:", "s_nationkey"), 2))
    ordered = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    relations = relations.unionByName(relation(ordered.select("o_custkey", "l_suppkey").distinct(), "ORDERED_FROM", ("C:", "o_custkey"), ("S:", "l_suppkey"), 3))
    return entities, relations


#: The same graph for DuckDB.
GRAPH_SQL = """
e as (
  select 'R:' || r_regionkey as name, 'region' as entity_type, r_name as description, true as is_root, r_regionkey::bigint * 4 as ord from region
  union all select 'N:' || n_nationkey, 'nation', n_name, false, n_nationkey::bigint * 4 + 1 from nation
  union all select 'C:' || c_custkey, 'customer', c_mktsegment, false, c_custkey * 4 + 2 from customer
  union all select 'S:' || s_suppkey, 'supplier', s_name, false, s_suppkey * 4 + 3 from supplier),
r as (
  select 'N:' || n_nationkey as a, 'R:' || n_regionkey as b, 'PART_OF' as t from nation
  union all select 'C:' || c_custkey, 'N:' || c_nationkey, 'LOCATED_IN' from customer
  union all select 'S:' || s_suppkey, 'N:' || s_nationkey, 'LOCATED_IN' from supplier
  union all select distinct 'C:' || o_custkey, 'S:' || l_suppkey, 'ORDERED_FROM' from orders join lineitem on o_orderkey = l_orderkey),
u as (select a, b, t from r union all select b, a, t from r)
"""


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: every seventh has no owner; the creator is a customer too."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("order "), "o_orderpriority").alias("description"),
        F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit("C"), (F.col("o_custkey") % 100).cast("string"))).alias("owner"),
        F.concat(F.lit("C"), (F.col("o_orderkey") % 50).cast("string")).alias("creator"), F.col("o_totalprice").cast("string").alias("output"), F.col("o_orderkey").alias("ord"),
    )


BOARD_SQL = """
tasks as (
  select o_orderkey as id, o_orderstatus as status, 'order ' || o_orderpriority as description,
    case when o_orderkey % 7 = 0 then '' else 'C' || (o_custkey % 100) end as owner, 'C' || (o_orderkey % 50) as creator, o_orderkey as ord from orders)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("ord"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One vector of the table, as the query."""
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are received, purchases processed; the message is the user's number in props; clicks are sent texts."""
    ev = table(spark, sf_dir, "events")
    n = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type") == "view", "received").when(F.col("event_type") == "purchase", "processed").when(F.col("event_type") == "click", "sent")
    return ev.select(
        kind.alias("kind"), F.concat(F.col("user_id").cast("string"), F.lit("-"), n).alias("message_id"), F.col("user_id").cast("string").alias("agent_id"),
        F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("#tool"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("name"),
        F.lit("role").alias("role"), (F.col("user_id") % 25 == 1).alias("is_user_proxy"), F.col("ts"), F.format_string("sent %d", "event_id").alias("text"), F.col("event_id").alias("ord"),
    ).filter("kind is not null")


LOG_SQL = """
log as (
  select case event_type when 'view' then 'received' when 'purchase' then 'processed' when 'click' then 'sent' end as kind,
    user_id || '-' || json_extract_string(props, '$.k') as message_id, user_id::varchar as agent_id,
    case when user_id % 10 = 0 then '#tool' || user_id else 'user' || user_id end as name, 'role' as role, user_id % 25 = 1 as is_user_proxy, ts, 'sent ' || event_id as text, event_id as ord
  from events where event_type in ('view', 'purchase', 'click'))
"""


def timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as timers of their customers, due some hours after the order by its priority."""
    o = table(spark, sf_dir, "orders")
    hours = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(
        F.col("o_orderkey").alias("notification_id"), F.col("o_custkey").cast("string").alias("owner_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("owner_name"),
        F.col("o_orderstatus").alias("content"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.make_dt_interval(hours=hours)).alias("fire_at"),
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers with a positive balance are present."""
    return table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("name"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/id.txt; a file's time goes with its id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("size"),
        F.timestamp_seconds(F.col("doc_id")).alias("mtime"),
    )


FILES_SQL = "files as (select source || '/' || lang || '/' || doc_id || '.txt' as path, text as content, n_chars as size, doc_id as mtime from documents)"


def mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as mailboxes of their assistants; every fifth text begins with a stop word."""
    c = table(spark, sf_dir, "conversations")
    kind = {"user": "UserMessage", "assistant": "ResultMessage", "system": "NotificationMessage"}
    type = F.col("role")
    for k, v in kind.items():
        type = F.when(F.col("role") == k, v).otherwise(type)
    content = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("/stop "), "text")).otherwise(F.col("text"))
    return c.select(
        F.concat(F.lit("owner"), (F.col("conv_id") % 20).cast("string")).alias("owner"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("msg_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.lit("message").alias("kind"), type.alias("type"), F.col("role").alias("sender"), content.alias("content"),
    )


MAILBOX_SQL = """
mail as (
  select 'owner' || (conv_id % 20) as owner, conv_id || '-' || turn as msg_id, conv_id * 1000 + turn as ord, role as sender,
    case role when 'user' then 'UserMessage' when 'assistant' then 'ResultMessage' when 'system' then 'NotificationMessage' else role end as type,
    case when turn % 5 = 4 then '/stop ' || text else text end as content from conversations)
"""
