"""Raw host records to flat unsigned events.

Input rows are (source, pos, rec) where ``rec`` maps field names to their text. Every mapping is one
narrow projection; only host maps and allowlists are joined, and running numbers use a distributed rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.functions.timestamps import normal_time, normal_time_seconds
from hostweave.session import cut, not_blank, with_place_rank
from hostweave.sources.dimensions import MACOS_ALIASES, WINDOWS_ALIASES, alias_channel, map_hosts, normal_kind

PAYLOAD_COLUMNS = (
    "user", "result", "src", "dst_ip", "dst_port", "bytes", "egress", "blocked", "image", "pid", "query", "qtype",
    "command_line", "script_sha256_16", "event_kind", "channel",
)


def first_of(rec: Column, *names: str) -> Column:
    """First field that is present and not empty."""
    return F.coalesce(*[not_blank(rec[n]) for n in names])


def with_event_data(rows: DataFrame, name: str) -> DataFrame:
    """Add ``EventData`` as a map; a ``Data`` list of Name/Value pairs is turned into one.

    Each step is a column of its own: inside one expression, or a lambda, the text would be parsed once for every use.
    """
    rec, raw, items = F.col("rec"), F.col("_raw"), F.col("_items")
    text = F.coalesce(not_blank(rec["EventData"]), not_blank(rec["event_data"]), F.lit("{}"))
    listed = F.filter(F.from_json(raw["Data"], "array<struct<Name:string,Value:string>>"), lambda i: not_blank(i["Name"]).isNotNull())
    pairs = F.aggregate(
        items,
        F.create_map().cast("map<string,string>"),
        lambda acc, i: F.map_concat(F.map_filter(acc, lambda k, v: k != i["Name"]), F.create_map(i["Name"], i["Value"])),
    )
    data = F.when(F.coalesce(F.size(items), F.lit(0)) > 0, pairs).otherwise(F.coalesce(raw, F.create_map().cast("map<string,string>")))
    rows = rows.withColumn("_raw", F.from_json(text, "map<string,string>")).withColumn("_items", listed)
    return rows.withColumn(name, data).drop("_raw", "_items")


def system_field(name: str) -> Column:
    return not_blank(F.col("_system")[name])


def with_windows_fields(rows: DataFrame) -> DataFrame:
    """Add the raw ``_channel``, ``_kind``, ``_host`` and ``_time`` of Windows records, each first present field, then that of ``System``.

    The id is the first present id field, else ``System.EventID`` (plain, or with ``#text``/``Value``). ``System`` is parsed once.
    """
    rec, inner, nested = F.col("rec"), F.col("_inner"), system_field("EventID")
    rows = rows.withColumn("_system", F.from_json(rec["System"], "map<string,string>")).withColumn("_inner", F.from_json(nested, "map<string,string>"))
    return rows.withColumns(
        {
            "_channel": F.coalesce(first_of(rec, "channel", "Channel", "LogName"), system_field("Channel"), F.lit("security")),
            "_kind": F.coalesce(rec["EventID"], rec["event_id"], rec["Id"], rec["id"], inner["#text"], inner["Value"], nested),
            "_host": F.coalesce(first_of(rec, "host_id", "Computer", "Hostname", "MachineName"), system_field("Computer")),
            "_time": F.coalesce(first_of(rec, "TimeCreated", "ts_utc", "@timestamp"), system_field("TimeCreated")),
        }
    ).drop("_system", "_inner")


def windows_user(rec: Column, ed: Column) -> Column:
    """First account name that is neither empty nor ``-``; top-level fields come first."""
    ok = lambda c: F.when((c != "") & (c != "-"), c)
    top = [ok(rec[n]) for n in ("TargetUserName", "user", "User", "AccountName")]
    nested = [ok(ed[n]) for n in ("TargetUserName", "SubjectUserName", "User")]
    return F.coalesce(*top, *nested, F.lit("unknown"))


def windows_source(rec: Column, ed: Column) -> Column:
    """Source address; loopback only counts as missing at the top level."""
    top = [F.when(~rec[n].isin("", "-", "::1", "127.0.0.1"), rec[n]) for n in ("IpAddress", "src", "SourceAddress")]
    nested = first_of(ed, "IpAddress", "SourceNetworkAddress")
    return F.coalesce(*top, F.when(nested != "-", nested), F.lit("0.0.0.0"))


def number(*cols: Column, default: int = 0) -> Column:
    """First value that is present and not zero, as a whole number."""
    picked = F.coalesce(*[F.when(~c.isin("", "0"), c) for c in cols])
    return F.coalesce(picked.try_cast("bigint"), picked.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def allowed(df: DataFrame, allowlist: DataFrame, channels: Sequence[str] | None, wildcard: bool = False) -> DataFrame:
    """Add ``allowed``: the channel is wanted and the kind is on its allowlist.

    With ``wildcard`` (macOS) a ``*`` entry or an empty list allows every kind of the channel.
    """
    known = allowlist.select("channel", "event_kind", F.lit(True).alias("_on")).distinct()
    # an allowlist is a few names; joined by key, all rows of a kind would meet in one task
    rows = df.join(F.broadcast(known), ["channel", "event_kind"], "left")
    ok = F.coalesce("_on", F.lit(False))
    if wildcard:
        per = allowlist.groupBy("channel").agg(F.max(F.col("event_kind") == "*").alias("_any"))
        rows = rows.join(F.broadcast(per), "channel", "left")
        ok = ok | F.coalesce("_any", F.lit(True))
    if channels is not None:
        ok = ok & F.col("channel").isin(*channels)
    else:
        named = allowlist.select("channel", F.lit(True).alias("_named")).distinct()
        rows = rows.join(F.broadcast(named), "channel", "left")
        ok = ok & F.coalesce("_named", F.lit(False))
    return rows.withColumn("allowed", ok).drop("_on", "_any", "_named")


TYPES = {"dst_port": "int", "bytes": "bigint", "egress": "boolean", "blocked": "boolean", "pid": "int"}


def _mapping_columns(cases: list[tuple[Column, str, dict[str, Column]]]) -> dict[str, Column]:
    """``payload_type``, ``adapted`` and one column per payload field from the first case that holds.

    Every field gets its own short CASE over the cases that set it, so the generated code stays small.
    """
    out = {}
    for name in ("payload_type", *[c for c in PAYLOAD_COLUMNS if c not in ("event_kind", "channel")]):
        col = None
        for cond, ptype, fields in cases:
            value = F.lit(ptype) if name == "payload_type" else fields.get(name)
            if value is not None:
                value = value.cast(TYPES.get(name, "string"))
                col = F.when(cond, value) if col is None else col.when(cond, value)
        out[name] = (F.lit(None) if col is None else col).cast(TYPES.get(name, "string"))
    hit = F.lit(False)
    for cond, _, _ in cases:
        hit = hit | F.coalesce(cond, F.lit(False))
    return {**out, "adapted": hit}


# --- Windows -------------------------------------------------------------------------------------


def parse_windows(records: DataFrame, ingest_ts: str, default_host: str = "host-a") -> DataFrame:
    """Fields that all channels share, plus ``ed`` (EventData) for the channel mappings."""
    rows = with_windows_fields(with_event_data(records, "ed"))
    return rows.select(
        "source", "pos", "rec", "ed",
        alias_channel(F.col("_channel"), WINDOWS_ALIASES).alias("channel"),
        normal_kind(F.col("_kind")).alias("event_kind"),
        F.coalesce(F.lower(F.split_part("_host", F.lit("."), F.lit(1))), F.lit(default_host)).alias("host_id"),
        normal_time(F.col("_time"), ingest_ts).alias("ts_utc"),
    )


def windows_mapping() -> dict[str, Column]:
    """Payload columns of a parsed Windows record that passed the allowlist."""
    rec, ed, eid, ch, on = F.col("rec"), F.col("ed"), F.col("event_kind"), F.col("channel"), F.col("allowed")
    user = windows_user(rec, ed)
    either = lambda *n: F.coalesce(*[x for k in n for x in (not_blank(ed[k]), not_blank(rec[k]))])
    body = F.coalesce(not_blank(ed["ScriptBlockText"]), not_blank(rec["ScriptBlockText"]), not_blank(ed["Payload"]), F.lit(""))
    digest = F.substring(F.sha2(body.cast("binary"), 256), 1, 16)
    prefix = F.translate(F.substring(body, 1, 80), "\n", " ")
    security = {"user": user, "result": F.when(eid == "4625", "failure").otherwise("success"), "src": windows_source(rec, ed)}
    process = {
        "image": F.coalesce(either("Image"), F.lit("unknown")),
        "command_line": F.substring(F.coalesce(either("CommandLine"), F.lit("")), 1, 240),
        "user": F.coalesce(either("User"), user),
    }
    conn = {
        "dst_ip": F.coalesce(either("DestinationIp"), F.lit("0.0.0.0")),
        "dst_port": number(ed["DestinationPort"], rec["DestinationPort"]),
        "bytes": number(ed["bytes"], rec["bytes"], default=1200),
        "egress": F.lit(True),
    }
    dns = {"query": F.coalesce(either("QueryName"), F.lit("unknown")), "qtype": F.coalesce(either("QueryType"), F.lit("A"))}
    wall = {
        "dst_ip": F.coalesce(first_of(ed, "DestAddress", "DestinationIp"), not_blank(rec["DestAddress"]), F.lit("0.0.0.0")),
        "dst_port": number(ed["DestPort"], ed["DestinationPort"], rec["DestPort"]),
        "bytes": number(ed["bytes"], default=800),
        "egress": F.lit(True),
        "blocked": eid.isin("5157", "2004") | F.lower(F.coalesce(ed["Action"], F.lit(""))).isin("block", "deny"),
    }
    shell = {
        "image": F.lit("powershell"),
        "command_line": F.concat(F.lit("script_sha256="), digest, F.when(prefix != "", F.concat(F.lit(" prefix="), prefix)).otherwise("")),
        "user": F.coalesce(not_blank(ed["UserId"]), not_blank(rec["UserId"]), user),
        "script_sha256_16": digest,
    }
    sysmon = on & (ch == "sysmon")
    return _mapping_columns(
        [
            (on & (ch == "security"), "auth", security),
            (sysmon & (eid == "1"), "process", process),
            (sysmon & (eid == "3"), "net_conn", conn),
            (sysmon & (eid == "22"), "dns", dns),
            (on & (ch == "firewall"), "net_conn", wall),
            (on & (ch == "powershell"), "process", shell),
        ]
    )


def _number_events(rows: DataFrame, prefix: str, producer_id: str, digits: int) -> DataFrame:
    """Ids ``prefix-channel-host-00001`` by input order within each source."""
    ranked = with_place_rank(cut(rows), "pos", "seq", ["source"])  # parsed once, not again for the counts
    padded = F.when(F.length(F.col("seq").cast("string")) >= digits, F.col("seq").cast("string")).otherwise(
        F.lpad(F.col("seq").cast("string"), digits, "0")
    )
    event_id = F.concat_ws("-", F.lit(prefix), "channel", "host_id", padded)
    return ranked.withColumns(
        {
            "event_id": event_id,
            "nonce": event_id,
            "schema_ver": F.lit("1"),
            "producer_id": F.lit(producer_id),
            "ts": F.try_to_timestamp("ts_utc"),
            "ingest_seq": F.col("seq"),
        }
    ).drop("seq")


def map_windows(
    records: DataFrame,
    allowlist: DataFrame,
    ingest_ts: str,
    host_map: DataFrame | None = None,
    channels: Sequence[str] | None = None,
    default_host: str = "host-a",
) -> DataFrame:
    """Mapped rows with ``adapted``; rows that are filtered or unmapped stay, with NULL payload."""
    rows = allowed(parse_windows(records, ingest_ts, default_host), allowlist, channels)
    rows = map_hosts(rows, "host_id", host_map)
    mapping = windows_mapping()
    return rows.select(
        "source", "pos", "channel", "event_kind", "host_id", "ts_utc", *[col.alias(name) for name, col in mapping.items()]
    )


def adapt_windows(
    records: DataFrame,
    allowlist: DataFrame,
    ingest_ts: str,
    host_map: DataFrame | None = None,
    channels: Sequence[str] | None = None,
    producer_id: str = "prod-windows",
    default_host: str = "host-a",
    id_prefix: str = "osw",
) -> tuple[DataFrame, DataFrame]:
    """(events, mapped rows); feed the second to :func:`adapt_stats`."""
    mapped = map_windows(records, allowlist, ingest_ts, host_map, channels, default_host)
    return _number_events(mapped.filter("adapted").drop("adapted"), id_prefix, producer_id, 5), mapped


def adapt_stats(mapped: DataFrame) -> DataFrame:
    """(channel, adapted, skipped), over all files."""
    return mapped.groupBy("channel").agg(F.count_if("adapted").alias("adapted"), F.count_if(~F.col("adapted")).alias("skipped"))


def adapt_windows_auth(
    records: DataFrame,
    ingest_ts: str,
    host_map: DataFrame | None = None,
    event_ids: Sequence[str] = ("4624",),
    producer_id: str = "prod-windows",
    default_host: str = "host-a",
) -> DataFrame:
    """Log-ons of a Windows security export; every kept id counts as a success."""
    rows = parse_windows(records, ingest_ts, default_host).filter(F.col("event_kind").isin(*event_ids))
    rows = map_hosts(rows, "host_id", host_map)
    rows = rows.select(
        "source", "pos", "host_id", "ts_utc", F.col("event_kind"), F.lit("auth").alias("channel"), F.lit("auth").alias("payload_type"),
        windows_user(F.col("rec"), F.col("ed")).alias("user"), F.lit("success").alias("result"),
        windows_source(F.col("rec"), F.col("ed")).alias("src"),
    )
    return _number_events(rows, "win", producer_id, 4)


FIREWALL_IDS = ("5156", "5157", "5158")
PROMOTED = (
    "Image", "CommandLine", "User", "DestinationIp", "DestinationPort", "SourceIp", "SourcePort", "QueryName", "QueryType",
    "TargetUserName", "SubjectUserName", "IpAddress", "DestAddress", "DestPort", "ScriptBlockText", "UserId",
)


def normalize_captured(records: DataFrame) -> DataFrame:
    """Flat public-capture rows in the shape of Windows records.

    Packet-filter ids logged on the security channel move to the firewall channel, flat fields move
    into EventData where it lacks them, and the capture's own time fields become ``TimeCreated``.
    """
    rec = F.col("rec")
    ch = alias_channel(F.coalesce(first_of(rec, "Channel", "channel"), F.lit("")), WINDOWS_ALIASES)
    eid = normal_kind(first_of(rec, "EventID", "event_id"))
    filtering = ch.isin("security", "") & F.coalesce(eid.isin(*FIREWALL_IDS), F.lit(False))
    data, merged, given = F.col("_data"), F.col("_merged"), F.col("_given")
    extra = F.map_filter(
        F.create_map(*[x for k in PROMOTED for x in (F.lit(k), rec[k])]), lambda k, v: v.isNotNull() & ~F.map_contains_key(data, k)
    )
    host = first_of(rec, "Computer", "Hostname", "hostname", "host")
    time = F.coalesce(first_of(rec, "TimeCreated", "@timestamp", "UtcTime"))
    put = F.map_filter(
        F.create_map(
            F.lit("channel"), F.when(filtering, "firewall").otherwise(ch), F.lit("Computer"), host, F.lit("TimeCreated"), time,
            F.lit("EventData"), F.when(F.size(merged) > 0, F.to_json(merged)),
        ),
        lambda k, v: v.isNotNull() & (v != ""),
    )
    rest = F.map_filter(rec, lambda k, v: ~F.map_contains_key(given, k) & ~k.isin("Channel"))
    rows = with_event_data(records, "_data").withColumn("_merged", F.map_concat(data, extra)).withColumn("_given", put)
    return rows.withColumn("rec", F.map_concat(rest, given)).drop("_data", "_merged", "_given")


# --- macOS ---------------------------------------------------------------------------------------


def map_macos(
    records: DataFrame,
    allowlist: DataFrame,
    ingest_ts: str,
    host_map: DataFrame | None = None,
    channels: Sequence[str] | None = None,
    default_host: str = "host-mac",
) -> DataFrame:
    rec = F.col("rec")
    rows = records.select(
        "source", "pos", "rec",
        alias_channel(F.coalesce(first_of(rec, "channel", "Channel"), F.lit("net")), MACOS_ALIASES).alias("channel"),
        F.lower(F.trim(F.coalesce(first_of(rec, "EventID", "event", "kind"), F.lit("unknown")))).alias("event_kind"),
        F.trim(F.coalesce(first_of(rec, "host_id", "Computer", "hostname"), F.lit(default_host))).alias("host_id"),
        normal_time_seconds(first_of(rec, "TimeCreated", "ts_utc", "timestamp"), ingest_ts).alias("ts_utc"),
    )
    rows = allowed(rows, allowlist, channels, wildcard=True)
    if host_map is not None:
        short = host_map.select(F.col("raw_host").alias("_short"), F.col("host_id").alias("_m3"))
        rows = rows.withColumn("_raw", F.col("host_id"))
        rows = map_hosts(rows, "host_id", host_map)
        rows = rows.withColumn("_short", F.regexp_extract("_raw", r"^(.*)\.local$", 1)).join(short, "_short", "left")
        rows = rows.withColumn("host_id", F.when(F.col("host_id") == F.col("_raw"), F.coalesce("_m3", "host_id")).otherwise(F.col("host_id")))
        rows = rows.drop("_raw", "_short", "_m3")
    kind, ch, on = F.col("event_kind"), F.col("channel"), F.col("allowed")
    failed = kind.isin("ssh_fail", "login_fail") | F.lower(F.coalesce(rec["result"], F.lit(""))).isin("failure", "fail", "denied")
    auth = {
        "user": F.coalesce(first_of(rec, "user", "User"), F.lit("unknown")), "result": F.when(failed, "failure").otherwise("success"),
        "src": first_of(rec, "src", "src_ip", "IpAddress"),
    }
    dst = first_of(rec, "dst_ip", "DestinationIp", "foreign_ip")
    net = {
        "dst_ip": dst,
        "dst_port": number(rec["dst_port"], rec["DestinationPort"], rec["foreign_port"]),
        "bytes": number(rec["bytes"], default=1200),
        "egress": F.coalesce(rec["egress"].try_cast("boolean"), ~dst.isin("127.0.0.1", "::1")),
        "image": not_blank(F.substring(first_of(rec, "image", "command"), 1, 120)),
        "pid": rec["pid"].try_cast("int"),
    }
    net_ok = dst.isNotNull() & ~dst.isin("*", "0.0.0.0", "::")
    query = not_blank(F.trim(first_of(rec, "query", "QueryName")))
    dns = {"query": query, "qtype": F.coalesce(first_of(rec, "qtype", "QueryType"), F.lit("A"))}
    script = not_blank(rec["script"])
    process = {
        "image": F.coalesce(first_of(rec, "image", "command", "comm"), F.lit("unknown")),
        "command_line": F.substring(F.coalesce(first_of(rec, "command_line", "args"), F.lit("")), 1, 240),
        "user": F.coalesce(first_of(rec, "user"), F.lit("unknown")),
        "script_sha256_16": F.substring(F.sha2(script.cast("binary"), 256), 1, 16),
    }
    blocked = (kind == "block") | (F.lower(F.coalesce(rec["action"], F.lit(""))) == "block")
    mapping = _mapping_columns(
        [
            (on & (ch == "auth"), "auth", auth),
            (on & (ch == "net") & net_ok, "net_conn", net),
            (on & (ch == "dns") & query.isNotNull(), "dns", dns),
            (on & (ch == "process"), "process", process),
            (on & (ch == "pf") & net_ok, "net_conn", {**net, "blocked": blocked}),
        ]
    )
    return rows.select(
        "source", "pos", "channel", "event_kind", "host_id", "ts_utc", rec["event_id"].alias("given_id"),
        *[col.alias(name) for name, col in mapping.items()],
    )


def adapt_macos(
    records: DataFrame,
    allowlist: DataFrame,
    ingest_ts: str,
    host_map: DataFrame | None = None,
    channels: Sequence[str] | None = None,
    producer_id: str = "prod-macos",
    default_host: str = "host-mac",
    id_prefix: str = "mac",
) -> tuple[DataFrame, DataFrame]:
    """(events, mapped rows). A supplied id is kept; others count the record's place in its source."""
    mapped = map_macos(records, allowlist, ingest_ts, host_map, channels, default_host)
    placed = with_place_rank(cut(mapped), "pos", "place", ["source"]).filter("adapted").drop("adapted")
    made = F.concat_ws("-", F.lit(id_prefix), "channel", "event_kind", (F.col("place") - 1).cast("string"))
    out = placed.withColumn("event_id", F.coalesce(not_blank("given_id"), made))
    nonce = F.substring(F.sha2(F.concat_ws("|", "event_id", "ts_utc", "host_id").cast("binary"), 256), 1, 24)
    out = out.withColumns(
        {"nonce": nonce, "schema_ver": F.lit("1"), "producer_id": F.lit(producer_id), "ts": F.try_to_timestamp("ts_utc"), "ingest_seq": F.col("place")}
    )
    return out.drop("given_id", "place"), mapped


def payload_json(events: DataFrame, columns: Sequence[str] = PAYLOAD_COLUMNS) -> DataFrame:
    """Add ``payload`` as JSON text; NULL fields are left out."""
    return events.withColumn("payload", F.to_json(F.struct(*columns)))


# --- flat rows, shapes, names --------------------------------------------------------------------


def adapt_flat(records: DataFrame, producers: DataFrame) -> DataFrame:
    """Add status ``ok / adapted / flat_skip / bad_shape`` and the flat event columns.

    ``producers`` (host_id, producer_id) names who may report a flat row's host.
    """
    rec = F.col("rec")
    signed = first_of(rec, "schema_ver").isNotNull() & first_of(rec, "payload_type").isNotNull()
    need = ("event_id", "producer_id", "host_id", "ts_utc", "nonce", "payload", "hmac")
    whole = F.lit(True)
    for n in need:
        whole = whole & F.map_contains_key(rec, n)
    whole = whole & F.from_json(rec["payload"], "map<string,string>").isNotNull()
    flat = first_of(rec, "kind").isNotNull() & first_of(rec, "host_id").isNotNull()
    kind = F.coalesce(first_of(rec, "kind"), first_of(rec, "payload_type"))
    rows = records.withColumn("host_id", rec["host_id"]).join(
        producers.select("host_id", F.col("producer_id").alias("_prod")), "host_id", "left"
    )
    usable = flat & kind.isin("net_conn", "auth") & F.col("_prod").isNotNull()
    status = F.when(signed, F.when(whole, "ok").otherwise("bad_shape")).when(usable, "adapted").otherwise("flat_skip")
    rows = rows.withColumn("status", status)
    made = F.col("status") == "adapted"
    net = made & (kind == "net_conn")
    log = made & (kind == "auth")
    return rows.select(
        "source", "pos", "rec", "status", "host_id",
        F.coalesce(rec["producer_id"], F.when(made, F.col("_prod"))).alias("producer_id"),
        F.when(made, kind).otherwise(rec["payload_type"]).alias("payload_type"),
        rec["ts_utc"].alias("ts_utc"),
        F.when(log, rec["user"]).alias("user"),
        F.when(log, rec["result"]).alias("result"),
        F.when(log, rec["src"]).alias("src"),
        F.when(net, rec["dst_ip"]).alias("dst_ip"),
        F.when(net, number(rec["dst_port"], default=443)).cast("int").alias("dst_port"),
        F.when(net, number(rec["bytes"])).alias("bytes"),
        F.when(net, F.coalesce(rec["egress"].try_cast("boolean"), F.lit(False))).alias("egress"),
    )


def apply_aliases(events: DataFrame, aliases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bring ``host_id`` and log-on sources to their persistent names (alias, asset).

    Aliases ``by`` run or pack grow with their number, and a guess of their size from compressed files and before ``explode``
    falls far short, so these are never broadcast.
    """
    if by:
        aliases = aliases.hint("merge")
    own = aliases.select(*by, F.col("alias").alias("host_id"), F.col("asset").alias("_h"))
    peer = aliases.select(*by, F.col("alias").alias("src"), F.col("asset").alias("_s"))
    return (
        events.join(own, [*by, "host_id"], "left")
        .join(peer, [*by, "src"], "left")
        .withColumns({"host_id": F.coalesce("_h", "host_id"), "src": F.coalesce("_s", "src")})
        .drop("_h", "_s")
    )


def shift_clocks(events: DataFrame, skew: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add each host's skew in seconds (host_id, skew_seconds) to ``ts`` and ``ts_utc``."""
    rows = events.join(skew.select(*by, "host_id", "skew_seconds"), [*by, "host_id"], "left")
    shifted = F.timestamp_micros(F.unix_micros("ts") + F.coalesce(F.round(F.col("skew_seconds") * 1_000_000).cast("bigint"), F.lit(0)))
    return rows.withColumn("ts", shifted).withColumn("ts_utc", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).drop("skew_seconds")


def drop_hosts(events: DataFrame, dropped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Leave out events of hosts that are out of service."""
    return events.join(dropped.select(*by, "host_id").distinct(), [*by, "host_id"], "left_anti")


def canonical_corpus(events: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """Short stable host ids for a captured corpus, and the same names in log-on sources.

    ``configured`` (raw_host lower-case, host_id) overrides the slug of a host.
    """
    from hostweave.functions.text import host_slug

    raw = events.select(F.lower("host_id").alias("raw_host")).distinct()
    hosts = raw.withColumn("canon", host_slug("raw_host"))
    if configured is not None:
        given = configured.select(F.lower("raw_host").alias("raw_host"), F.col("host_id").alias("_given"))
        hosts = raw.join(given, "raw_host", "full").select("raw_host", F.coalesce("_given", host_slug("raw_host")).alias("canon"))
    names = hosts.select(F.col("raw_host").alias("name"), "canon").union(
        hosts.select(host_slug("raw_host").alias("name"), "canon")
    ).union(hosts.select(F.lower(F.split_part("raw_host", F.lit("."), F.lit(1))).alias("name"), "canon"))
    names = names.groupBy("name").agg(F.max("canon").alias("canon"))
    rows = events.withColumn("_h", F.lower("host_id")).join(hosts.select(F.col("raw_host").alias("_h"), "canon"), "_h", "left")
    low = names.select(F.col("name").alias("_s1"), F.col("canon").alias("_c1"))
    slug = names.select(F.col("name").alias("_s2"), F.col("canon").alias("_c2"))
    rows = rows.withColumns({"_s1": F.lower("src"), "_s2": F.when(F.coalesce("src", F.lit("")) != "", host_slug("src"))})
    rows = rows.join(low, "_s1", "left").join(slug, "_s2", "left")
    return rows.withColumns(
        {"host_id": F.col("canon"), "src": F.coalesce("_c1", "_c2", "src"), "producer_id": F.concat(F.lit("prod-"), "canon")}
    ).drop("_h", "_s1", "_s2", "_c1", "_c2", "canon")
