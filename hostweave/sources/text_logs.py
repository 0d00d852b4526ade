"""Parsers for plain-text host logs (a ``value`` column of lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOPBACK = ("127.0.0.1", "::1")


def parse_connection_log(lines: DataFrame) -> DataFrame:
    """Established connections from a socket table: ``cmd pid user ... local->foreign (STATE)``."""
    line = F.trim("value")
    parts = F.split(line, "\\s+")
    name = F.when(F.element_at(parts, -1).startswith("("), F.element_at(parts, -2)).otherwise(F.element_at(parts, -1))
    rows = lines.withColumn("_line", line).withColumn("_parts", parts)
    rows = rows.filter(~F.col("_line").startswith("COMMAND") & F.contains("_line", F.lit("->")) & (F.size("_parts") >= 9))
    rows = rows.withColumn("_name", name).filter(F.contains("_name", F.lit("->")))
    foreign = F.regexp_extract("_name", "->(.*)$", 1)
    v6 = foreign.rlike(r"^\[[^\]]+\]:[0-9]+$")
    v4 = foreign.rlike(r"^.*:[0-9]+$")
    host = F.when(v6, F.regexp_extract(foreign, r"^\[([^\]]+)\]:", 1)).when(v4, F.regexp_extract(foreign, r"^(.*):[0-9]+$", 1)).otherwise(foreign)
    port = F.when(v6 | v4, F.regexp_extract(foreign, r":([0-9]+)$", 1).try_cast("int")).otherwise(0)
    rows = rows.withColumns({"dst_ip": host, "dst_port": port})
    return rows.filter(~F.col("dst_ip").isin(*LOOPBACK)).withColumns(
        {
            "image": F.col("_parts")[0],
            "pid": F.col("_parts")[1].try_cast("int"),
            "user": F.col("_parts")[2],
            "bytes": F.lit(1500),
            "egress": F.lit(True),
        }
    ).drop("_line", "_parts", "_name")


def parse_auth_log(lines: DataFrame) -> DataFrame:
    """Log-on lines: accepted / logged in is a success, failed / invalid a failure, others are dropped."""
    low = F.lower("value")
    has = lambda word: F.contains(low, F.lit(word))
    good, bad = has("accepted") | has("logged in"), has("failed") | has("invalid")
    kind = F.when(good, F.when(has("ssh") | has("accepted"), "ssh_accept").otherwise("login_success")).when(bad, "ssh_fail")
    return (
        lines.withColumn("event_kind", kind)
        .filter(F.col("event_kind").isNotNull())
        .withColumns({"result": F.when(good, "success").otherwise("failure"), "raw_snip": F.substring("value", 1, 160)})
    )


def parse_dns_log(lines: DataFrame) -> DataFrame:
    """First domain-like token of each line; lines without one are dropped."""
    found = F.regexp_extract("value", r"([A-Za-z0-9_.-]+\.[A-Za-z]{2,})", 1)
    return lines.withColumn("query", F.rtrim(found, F.lit("."))).filter("query != ''").withColumn("qtype", F.lit("A"))


def parse_process_list(lines: DataFrame) -> DataFrame:
    """``user pid comm args`` lines; arguments keep 240 characters and default to the command."""
    line = F.trim("value")
    parts = F.split(line, "\\s+", 4)
    rows = lines.withColumn("_p", parts).filter(F.size("_p") >= 3)
    return rows.withColumns(
        {
            "user": F.col("_p")[0],
            "pid": F.when(F.col("_p")[1].rlike("^[0-9]+$"), F.col("_p")[1].try_cast("int")),
            "image": F.col("_p")[2],
            "command_line": F.substring(F.coalesce(F.get("_p", 3), F.col("_p")[2]), 1, 240),
        }
    ).drop("_p")
