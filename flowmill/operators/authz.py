"""Authorization (Z1-Z4): permissions are a dimension, a decision is a join and a regex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.functions.predicates import is_loopback, permission_name, permitted

#: Operation, permission, and which of its names the permission is checked against.
OPERATIONS = (
    ("exchange.declare", "configure", "exchange"), ("exchange.delete", "configure", "exchange"), ("queue.declare", "configure", "queue"), ("queue.delete", "configure", "queue"),
    ("basic.publish", "write", "exchange"), ("queue.bind", "write", "queue"), ("queue.bind", "read", "exchange"), ("queue.unbind", "write", "queue"), ("queue.unbind", "read", "exchange"),
    ("exchange.bind", "write", "destination"), ("exchange.bind", "read", "exchange"), ("exchange.unbind", "write", "destination"), ("exchange.unbind", "read", "exchange"),
    ("basic.consume", "read", "queue"), ("basic.get", "read", "queue"), ("queue.purge", "read", "queue"),
)


def decisions(requests: DataFrame, permissions: DataFrame, operations: DataFrame) -> DataFrame:
    """Requests (id, username, vhost, operation, exchange, queue[, destination]) and
    whether every permission that the operation needs is there. Patterns are valid regexes;
    invalid ones are to be removed beforehand, which denies."""
    x = requests.join(operations, "operation").join(permissions, ["username", "vhost"], "left")
    dest = F.when(F.col("part") == "destination", F.col("destination")) if "destination" in requests.columns else F.lit(None).cast("string")
    name = permission_name(F.when(F.col("part") == "exchange", F.col("exchange")).when(F.col("part") == "queue", F.col("queue")).otherwise(dest))
    pattern = F.when(F.col("permission") == "configure", F.col("configure")).when(F.col("permission") == "write", F.col("write")).otherwise(F.col("read"))
    return x.groupBy("id", "username", "vhost", "operation").agg(F.bool_and(F.coalesce(permitted(pattern, name), F.lit(False))).alias("allowed"))


def vhost_refused(connections: DataFrame, permissions: DataFrame) -> DataFrame:
    """Z3: connections of users without any permission row for the vhost (402)."""
    return connections.join(permissions.select("username", "vhost").distinct(), ["username", "vhost"], "left_anti").withColumn("reply_code", F.lit(402))


def loopback_refused(connections: DataFrame, users: DataFrame) -> DataFrame:
    """Users limited to the local host who come from elsewhere."""
    return connections.join(users.where("loopback_only").select("username"), "username", "left_semi").where(~is_loopback(F.col("remote_ip")))


def user_permissions(auth: DataFrame) -> DataFrame:
    """An auth file's users as permission rows. Legacy permissions (action, pattern) move
    to vhost / ; a missing action denies by ^$."""
    new = auth.select("username", F.explode("vhost_permissions").alias("p")).select("username", F.col("p.vhost").alias("vhost"), *[F.col(f"p.permission.{a}").alias(a) for a in ("configure", "write", "read")])
    pick = lambda a: F.coalesce(F.max(F.when(F.col("p.action") == a, F.col("p.pattern"))), F.lit("^$")).alias(a)
    old = auth.where((F.size(F.coalesce("vhost_permissions", F.array())) <= 0) & (F.size("permissions") > 0)).select("username", F.explode("permissions").alias("p")).groupBy("username").agg(*[pick(a) for a in ("configure", "write", "read")]).select("username", F.lit("/").alias("vhost"), "configure", "write", "read")
    return new.unionByName(old)
