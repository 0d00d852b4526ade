"""Small lookup tables: allowlists, channel aliases, host maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default allowlists and channel aliases of the two platforms.
WINDOWS_ALLOWLIST = {
    "security": ["4624", "4625", "4648"],
    "sysmon": ["1", "3", "22"],
    "firewall": ["2004", "2005", "2006", "5156", "5157"],
    "powershell": ["4103", "4104"],
}
WINDOWS_ALIASES = {
    "security": "security",
    "sysmon": "sysmon",
    "firewall": "firewall",
    "powershell": "powershell",
    "microsoft-windows-sysmon/operational": "sysmon",
    "microsoft-windows-windows firewall with advanced security/firewall": "firewall",
    "microsoft-windows-powershell/operational": "powershell",
    "windows powershell": "powershell",
}
MACOS_ALLOWLIST = {
    "auth": ["ssh_accept", "ssh_fail", "login_success", "login_fail", "sudo"],
    "net": ["tcp_established", "udp_flow", "tcp_listen"],
    "dns": ["query"],
    "process": ["exec", "sample"],
    "pf": ["pass", "block"],
}
MACOS_ALIASES = {
    "auth": "auth", "net": "net", "network": "net", "dns": "dns", "process": "process", "proc": "process", "pf": "pf", "firewall": "pf",
}


def allowlist_frame(spark: SparkSession, allow: dict[str, list[str]]) -> DataFrame:
    rows = [(ch, str(i)) for ch, ids in allow.items() for i in ids]
    return spark.createDataFrame(rows, "channel string, event_kind string")


def parse_allowlist(docs: DataFrame, defaults: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(channel, event_kind) of JSON documents (``value``); channels they do not name keep ``defaults``."""
    doc = docs.select(F.from_json("value", "map<string,string>").alias("m"))
    whole = F.from_json(F.to_json(F.map_filter("m", lambda k, v: k != "max_per_sec")), "map<string,string>")
    body = F.coalesce(F.from_json(F.col("m")["allowlist"], "map<string,string>"), whole)
    rows = doc.select(F.explode(body).alias("ch", "ids")).select("ch", F.explode(F.from_json("ids", "array<string>")).alias("id"))
    named = rows.select(alias_channel(F.col("ch"), aliases).alias("channel"), normal_kind(F.col("id")).alias("event_kind")).distinct()
    return named.unionByName(defaults.join(named.select("channel").distinct(), "channel", "left_anti"))


def load_allowlist(spark: SparkSession, path: str | None, defaults: dict[str, list[str]], aliases: dict[str, str]) -> DataFrame:
    base = allowlist_frame(spark, defaults)
    return base if path is None else parse_allowlist(spark.read.text(path, wholetext=True), base, aliases)


def alias_channel(raw: Column, aliases: dict[str, str]) -> Column:
    key = F.lower(F.trim(raw))
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(table[key], key)


def normal_kind(raw: Column) -> Column:
    """Event id text: ``4624.0`` becomes ``4624``, other text is kept."""
    return F.when(raw.rlike(r"^[0-9]+\.?[0-9]*$|^\.[0-9]+$"), raw.try_cast("double").cast("bigint").cast("string")).otherwise(raw)


def parse_host_map(docs: DataFrame) -> DataFrame:
    """(raw_host, host_id) of JSON documents, with the exact and the lower-case key; an exact key wins."""
    doc = docs.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "host_id"))
    both = doc.select(F.col("k").alias("raw_host"), "host_id", F.lit(0).alias("p")).union(
        doc.select(F.lower("k").alias("raw_host"), "host_id", F.lit(1).alias("p"))
    )
    return both.groupBy("raw_host").agg(F.min_by("host_id", F.struct("p", "host_id")).alias("host_id"))


def load_host_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_host_map(spark.read.text(path, wholetext=True))


def map_hosts(df: DataFrame, column: str, host_map: DataFrame | None) -> DataFrame:
    """Replace ``column`` by its mapped name: exact key, then lower-case key, then itself."""
    if host_map is None:
        return df
    exact = host_map.select(F.col("raw_host").alias(column), F.col("host_id").alias("_m1"))
    lower = host_map.select(F.col("raw_host").alias("_low"), F.col("host_id").alias("_m2"))
    return (
        df.withColumn("_low", F.lower(column))
        .join(exact, column, "left")
        .join(lower, "_low", "left")
        .withColumn(column, F.coalesce("_m1", "_m2", column))
        .drop("_low", "_m1", "_m2")
    )
