"""Per-key clusters and the facts that decide which of them may merge.

Everything stays in long form (cluster x host) until a result row needs an array: no operator here
collects an unbounded group. ``by`` prefixes every key, so many packs run as one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.config import FuseConfig
from hostweave.functions.sets import quiet_gap, ranges_near
from hostweave.functions.text import dns_apex
from hostweave.operators.detect import fanout, is_small_egress
from hostweave.operators.sessions import members_of_slots, slice_of
from hostweave.session import attach_facts, cut, with_rank

# --- timed points and facts about the fleet ------------------------------------------------------


def key_points(events: DataFrame, cfg: FuseConfig = FuseConfig(), by: Sequence[str] = ()) -> DataFrame:
    """Timed (kind, key, host) points of all three cluster kinds, from one pass over the events.

    A log-on gives its host and, when its source names another host, that source too (``is_src``;
    ``peer`` is the other end of the hop).
    """
    none = F.lit(None).cast("string")

    def point(kind: str, key: Column, host: Column, is_src: bool, peer: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), key.alias("key"), host.alias("host"), F.lit(is_src).alias("is_src"), peer.alias("peer")
        )

    auth = (F.col("payload_type") == "auth") & (F.coalesce(F.col("user"), F.lit("")) != "")
    hop = F.coalesce(F.col("src").startswith(cfg.src_host_prefix) & (F.col("src") != F.col("host_id")), F.lit(False))
    apex = dns_apex("query")
    points = (
        F.when(
            auth & hop,
            F.array(
                point("lateral", F.col("user"), F.col("host_id"), False, F.col("src")),
                point("lateral", F.col("user"), F.col("src"), True, F.col("host_id")),
            ),
        )
        .when(auth, F.array(point("lateral", F.col("user"), F.col("host_id"), False, none)))
        .when(is_small_egress(cfg.max_small_bytes), F.array(point("exfil", F.col("dst_ip"), F.col("host_id"), False, none)))
        .when((F.col("payload_type") == "dns") & (apex != ""), F.array(point("dns", apex, F.col("host_id"), False, none)))
    )
    return (
        events.filter(F.col("ts").isNotNull())
        .select(*by, F.unix_micros("ts").alias("us"), "ts_utc", "ingest_seq", F.explode(points).alias("p"))
        .select(*by, "us", "ts_utc", "ingest_seq", "p.*")
    )


def key_slots(points: DataFrame, cfg: FuseConfig = FuseConfig(), by: Sequence[str] = ()) -> DataFrame:
    """Points brought down to one row per (kind, key, slice, host); the only large aggregation.

    Keys with fewer than ``min_hosts`` hosts overall are left out: they can form no cluster.
    ``seen`` is the first appearance of the key (time text, then arrival) within the slot.
    """
    key = [*by, "kind", "key"]
    slots = (
        points.withColumn("slice", slice_of(F.col("us"), cfg.window_us))
        .groupBy(*key, "slice", "host")
        .agg(
            F.min("us").alias("t0"),
            F.max("us").alias("t1"),
            F.min(F.when(~F.col("is_src"), F.struct("ts_utc", "ingest_seq"))).alias("seen"),
        )
    )
    keys = (
        slots.groupBy(*key, "host").agg(F.min("seen").alias("seen"))
        .groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("key_seen"))
        .filter(F.col("n") >= cfg.min_hosts)
    )
    return slots.drop("seen").join(keys.select(*key, "key_seen"), key)


def fleet_facts(events: DataFrame, cfg: FuseConfig = FuseConfig(), by: Sequence[str] = ()) -> DataFrame:
    """Fleet size and the two bars derived from it; one row per run."""
    src_ok = (
        (F.col("payload_type") == "auth")
        & (F.coalesce(F.col("user"), F.lit("")) != "")
        & F.col("ts").isNotNull()
        & F.col("src").startswith(cfg.src_host_prefix)
        & (F.col("src") != F.col("host_id"))
    )
    hosts = (
        events.select(*by, F.explode(F.array("host_id", F.when(src_ok, F.col("src")))).alias("host"))
        .filter(F.col("host").isNotNull())
        .distinct()
    )
    n = hosts.groupBy(*by).agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("fleet_n"))
    hub = (
        F.lit(int(cfg.hub_degree_bar)).cast("bigint")
        if cfg.hub_degree_bar is not None
        else F.greatest(F.lit(2).cast("bigint"), F.expr("fleet_n div 2"))
    )
    return n.select(
        *by, "fleet_n", F.greatest(F.lit(4).cast("bigint"), F.col("fleet_n") - 1).alias("fanout_bar"), hub.alias("hub_bar")
    )


def hop_edges(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both directions of every log-on hop, one row per (user, host, peer)."""
    hops = points.filter((F.col("kind") == "lateral") & F.col("peer").isNotNull())
    return hops.select(*by, F.col("key").alias("user"), "host", "peer").distinct()


def hop_degree(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct hop peers of each host, over all users."""
    peers = edges.select(*by, "host", "peer").distinct()
    return peers.groupBy(*by, "host").agg(F.count(F.lit(1)).alias("degree"))


def hop_hosts(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hosts that take part in a hop of each user."""
    return edges.select(*by, "user", "host").distinct()


# --- per-key clusters ----------------------------------------------------------------------------


def slot_members(slots: DataFrame, cfg: FuseConfig = FuseConfig(), by: Sequence[str] = ()) -> DataFrame:
    """Hosts of every gap session of every key: (kind, key, session_no, host, t0, t1)."""
    return members_of_slots(slots, [*by, "kind", "key"], "host", cfg.window_us)


def session_sizes(members: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return members.groupBy(*by, "kind", "key", "session_no").agg(F.count(F.lit(1)).alias("n_hosts"))


def lateral_members(
    members: DataFrame, edges: DataFrame, facts: DataFrame, cfg: FuseConfig = FuseConfig(), by: Sequence[str] = ()
) -> DataFrame:
    """Hosts of each accepted account cluster.

    A session that reaches the fan-out bar keeps only hosts on a hop of that account, and is dropped
    when fewer than ``min_hosts`` remain.
    """
    ident = [*by, "kind", "key", "session_no"]
    mine = members.filter(F.col("kind") == "lateral")
    sizes = session_sizes(mine, by).filter(F.col("n_hosts") >= cfg.min_hosts)
    sizes = attach_facts(sizes, facts, by, ["fanout_bar"]).select(*ident, (F.col("n_hosts") >= F.col("fanout_bar")).alias("wide"))
    hops = hop_hosts(edges, by).select(*by, F.col("user").alias("key"), "host", F.lit(True).alias("hopped"))
    kept = (
        mine.join(sizes, ident)
        .join(hops, [*by, "key", "host"], "left")
        .filter(~F.col("wide") | F.coalesce("hopped", F.lit(False)))
        .select(*members.columns)
    )
    enough = session_sizes(kept, by).filter(F.col("n_hosts") >= cfg.min_hosts).drop("n_hosts")
    return kept.join(enough, ident, "left_semi")


def poisoned_destinations(
    members: DataFrame, facts: DataFrame, cfg: FuseConfig = FuseConfig(), by: Sequence[str] = ()
) -> DataFrame:
    """Destinations that reached the fan-out bar in any session; they never form a cluster."""
    sizes = session_sizes(members.filter(F.col("kind") == "exfil"), by)
    widest = sizes.groupBy(*by, "kind", "key").agg(F.max("n_hosts").alias("widest"))
    return attach_facts(widest, facts, by, ["fanout_bar"]).filter(F.col("widest") >= F.col("fanout_bar")).drop("fanout_bar")


def exfil_members(
    members: DataFrame, facts: DataFrame, cfg: FuseConfig = FuseConfig(), by: Sequence[str] = ()
) -> DataFrame:
    """Hosts of each small-egress cluster whose destination is not poisoned."""
    mine = members.filter(F.col("kind") == "exfil")
    good = session_sizes(mine, by).filter(F.col("n_hosts") >= cfg.min_hosts).drop("n_hosts")
    poisoned = poisoned_destinations(members, facts, cfg, by).drop("widest")
    return mine.join(good, [*by, "kind", "key", "session_no"], "left_semi").join(poisoned, [*by, "kind", "key"], "left_anti")


def dns_members(members: DataFrame, cfg: FuseConfig = FuseConfig(), by: Sequence[str] = ()) -> DataFrame:
    """Hosts of each shared-zone cluster; no fan-out bar applies."""
    mine = members.filter(F.col("kind") == "dns")
    good = session_sizes(mine, by).filter(F.col("n_hosts") >= cfg.min_hosts).drop("n_hosts")
    return mine.join(good, [*by, "kind", "key", "session_no"], "left_semi")


def cluster_members(events: DataFrame, cfg: FuseConfig = FuseConfig(), by: Sequence[str] = ()) -> DataFrame:
    """All accepted clusters in long form, before numbering: (kind, key, session_no, host, t0, t1, seen)."""
    points = key_points(events, cfg, by)
    slots = cut(key_slots(points, cfg, by))
    facts = fleet_facts(events, cfg, by)
    members = slot_members(slots, cfg, by)
    out = (
        lateral_members(members, hop_edges(points, by), facts, cfg, by)
        .unionByName(exfil_members(members, facts, cfg, by))
        .unionByName(dns_members(members, cfg, by))
    )
    seen = slots.groupBy(*by, "kind", "key").agg(F.min("key_seen").alias("seen"))
    kind_no = F.when(F.col("kind") == "lateral", 1).when(F.col("kind") == "exfil", 2).otherwise(3)
    return out.join(seen, [*by, "kind", "key"]).select(
        *by, kind_no.alias("kind_no"), "kind", "key", "session_no", "host", "t0", "t1",
        F.col("seen.ts_utc").alias("seen_ts"), F.col("seen.ingest_seq").alias("seen_seq"),
    )


def numbered_clusters(events: DataFrame, cfg: FuseConfig = FuseConfig(), by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(clusters, members): clusters get their running number ``part`` and id; members carry ``part``.

    ``part`` counts accepted clusters in (kind, first appearance of the key, session) order.
    """
    members = cut(cluster_members(events, cfg, by))
    ident = [*by, "kind_no", "kind", "key", "session_no"]
    clusters = members.groupBy(*ident, "seen_ts", "seen_seq").agg(
        F.count(F.lit(1)).alias("n_hosts"), F.min("t0").alias("t0"), F.max("t1").alias("t1")
    )
    clusters = with_rank(clusters, ["kind_no", "seen_ts", "seen_seq", "session_no"], "part", by)
    clean = F.when(F.col("kind") == "lateral", F.col("key")).otherwise(F.translate("key", ".", "-"))
    cid = F.concat(F.lit("camp-"), "kind", F.lit("-"), clean, F.lit("-"), F.col("part").cast("string"))
    clusters = cut(clusters.withColumn("campaign_id", cid).drop("seen_ts", "seen_seq"))
    rows = members.select(*ident, "host").join(clusters.select(*ident, "part"), ident)
    return clusters, rows.select(*by, "part", "kind", "key", "host")


def recon_hosts(events: DataFrame, cfg: FuseConfig = FuseConfig(), by: Sequence[str] = ()) -> DataFrame:
    net = events.filter(F.col("payload_type") == "net_conn")
    return fanout(net, "host_id", "dst_ip", cfg.recon_min_distinct, by=by).select(*by, F.col("host_id").alias("host"))


def attach_recon(
    clusters: DataFrame, members: DataFrame, recon: DataFrame, by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Mark clusters that touch a fan-out host (``absorbs_recon``) and members that are one.

    Such a cluster takes in *all* fan-out hosts. The flag stands for them: the product
    (clusters x fan-out hosts) is only spelled out for the rows a caller asks for.
    """
    flagged = members.join(recon.withColumn("is_recon", F.lit(True)), [*by, "host"], "left").withColumn(
        "is_recon", F.coalesce("is_recon", F.lit(False))
    )
    touch = flagged.groupBy(*by, "part").agg(F.max("is_recon").alias("absorbs_recon"))
    return clusters.join(touch, [*by, "part"]), flagged


def cluster_stage(kind: Column, key: Column, hosts: Column) -> Column:
    """Stage struct of a single cluster."""
    name = F.when(kind == "lateral", "lateral_auth").when(kind == "exfil", "micro_exfil").otherwise("dns_beacon")
    return F.struct(
        name.alias("name"),
        F.when(kind == "lateral", key).alias("user"),
        F.when(kind == "exfil", key).alias("dst_ip"),
        F.when(kind == "dns", key).alias("apex"),
        hosts.alias("hosts"),
    )


STAGE_TYPE = "struct<name:string,user:string,dst_ip:string,apex:string,hosts:array<string>>"


def cluster_items(
    events: DataFrame, cfg: FuseConfig = FuseConfig(), by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(items, recon facts): merge input, one row per cluster, with its stages and own hosts.

    ``plain`` holds the hosts that are not fan-out hosts; ``absorbs_recon`` stands for all of those.
    ``hubs`` are the plain hosts whose hop degree reaches the bar.
    """
    clusters, members = numbered_clusters(events, cfg, by)
    recon = cut(recon_hosts(events, cfg, by))
    clusters, members = attach_recon(clusters, members, recon, by)
    degree = hop_degree(hop_edges(key_points(events, cfg, by), by), by)
    facts = fleet_facts(events, cfg, by)
    hubs = attach_facts(degree, facts, by, ["hub_bar"]).filter(F.col("degree") >= F.col("hub_bar"))
    hubs = cut(hubs.select(*by, "host", F.lit(True).alias("is_hub")))
    members = members.join(hubs, [*by, "host"], "left").withColumn("is_hub", F.coalesce("is_hub", F.lit(False)))
    pick = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("host"))))
    hosts = members.groupBy(*by, "part").agg(
        F.sort_array(F.collect_set("host")).alias("hosts"),
        pick(~F.col("is_recon")).alias("plain"),
        pick(F.col("is_recon")).alias("recon_own"),
        pick(F.col("is_hub") & ~F.col("is_recon")).alias("hubs"),
    )
    none = F.lit(None).cast("string")
    recon_stage = F.struct(
        F.lit("recon_fanout").alias("name"), none.alias("user"), none.alias("dst_ip"), none.alias("apex"),
        F.col("recon_own").alias("hosts"),
    ).cast(STAGE_TYPE)
    own_stage = cluster_stage(F.col("kind"), F.col("key"), F.col("hosts")).cast(STAGE_TYPE)
    items = clusters.join(hosts, [*by, "part"]).select(
        *by,
        F.col("part").alias("ord"),
        "campaign_id",
        "kind",
        "key",
        "plain",
        "hubs",
        "absorbs_recon",
        F.when(F.col("absorbs_recon"), F.array(recon_stage, own_stage)).otherwise(F.array(own_stage)).alias("stages"),
        "t0",
        "t1",
    )
    facts_of_recon = (
        recon.join(hubs, [*by, "host"], "left")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("recon_n"), F.max(F.coalesce("is_hub", F.lit(False))).alias("recon_hub"))
    )
    return items, facts_of_recon


# --- pair rules on single clusters ---------------------------------------------------------------


def pair_rules(a: str = "a", b: str = "b", cfg: FuseConfig = FuseConfig(), gap_us: int | None = None) -> dict[str, Column]:
    """The merge rules between two clusters, as columns over two struct columns ``a`` and ``b``.

    Each struct has: t0, t1, hosts, hubs, lateral_hosts, egress_hosts, exfil_hosts (arrays), names
    (sorted array of stage names), user (first account), dsts (array).
    """
    A = lambda f: F.col(f"{a}.{f}")
    B = lambda f: F.col(f"{b}.{f}")
    both = F.array_intersect(A("hosts"), B("hosts"))
    n = F.size(both)
    near = ranges_near(A("t0"), A("t1"), B("t0"), B("t1"), cfg.window_us if gap_us is None else gap_us)
    quiet = quiet_gap(A("t0"), A("t1"), B("t0"), B("t1"))
    same_user = F.coalesce(A("user") == B("user"), F.lit(False))
    other_user = F.coalesce(A("user") != B("user"), F.lit(False))
    a_lat, b_lat = F.array_contains(A("names"), "lateral_auth"), F.array_contains(B("names"), "lateral_auth")
    egress = F.array(F.lit("micro_exfil"), F.lit("dns_beacon"))
    a_eg, b_eg = F.arrays_overlap(A("names"), egress), F.arrays_overlap(B("names"), egress)
    meet = lambda x, y: F.size(F.array_intersect(F.array_intersect(both, x), y)) > 0
    crossing = meet(A("lateral_hosts"), B("egress_hosts")) | meet(B("lateral_hosts"), A("egress_hosts"))
    bridge = (n >= 2) | ((n == 1) & crossing & ~(a_lat & b_lat))
    shape = F.lit(cfg.split_on_shape_gap) & (quiet >= cfg.window_us) & (A("names") != B("names")) & ~same_user
    inside = (n == F.size(A("hosts"))) | (n == F.size(B("hosts")))
    on_hub = F.size(F.array_intersect(both, F.array_union(A("hubs"), B("hubs")))) > 0
    shared_dst = F.arrays_overlap(A("dsts"), B("dsts"))
    handoff = (F.size(F.array_intersect(both, F.array_union(A("exfil_hosts"), B("exfil_hosts")))) > 0) & (
        (a_lat & (F.size(B("exfil_hosts")) > 0)) | (b_lat & (F.size(A("exfil_hosts")) > 0))
    )
    hub = on_hub & (a_lat | b_lat) & ~same_user & ~inside & ~F.coalesce(shared_dst, F.lit(False)) & ~handoff
    cross_key = (a_lat & b_eg) | (b_lat & a_eg)
    users = other_user & ((~cross_key & ~((n > 0) & bridge)) | (a_lat & b_lat & ~(a_eg | b_eg)))
    return {
        "near": near,
        "quiet_gap": quiet,
        "n_shared": n,
        "same_user": same_user,
        "bridge_ok": bridge,
        "refuse_shape_gap": shape,
        "refuse_hub": hub,
        "refuse_users": users,
    }
