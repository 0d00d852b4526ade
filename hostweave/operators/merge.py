"""Exact ordered merge of clusters into campaigns, in many small groups.

The merge is greedy and order-dependent, so it is folded in order, but only inside small groups:

1. every cluster starts as its own group;
2. clusters of different groups that *could* meet (close in time, and sharing hosts or an account as
   the merge rules demand) link their groups;
3. linked groups are folded again, in order, from the original clusters;
4. steps 2 and 3 repeat until no two groups can meet.

Step 2 uses the exact rules for clusters that took nothing in, and a condition that no later or
smaller state of a merged one can escape otherwise (hosts and ranges only grow). Groups that cannot
meet never influence each other, so the result equals one fold over everything, while a group is about
as large as the campaigns it becomes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.config import FuseConfig
from hostweave.functions.sets import ranges_near
from hostweave.operators.components import component_labels
from hostweave.operators.fuse import STAGE_TYPE, cluster_items, pair_rules, recon_hosts
from hostweave.operators.sessions import range_islands
from hostweave.session import attach_facts, cut

EGRESS = ("micro_exfil", "dns_beacon")
HEAVY = 64
RECON_TOKEN = "\x00recon"  # stands for the whole set of fan-out hosts in a host array
ITEM_FIELDS = (
    "gid string, ord bigint, campaign_id string, plain array<string>, hubs array<string>, "
    f"absorbs_recon boolean, stages array<{STAGE_TYPE}>, t0 bigint, t1 bigint, n_items bigint, recon_pos bigint"
)


# --- the ordered fold of one group (small helper, runs inside tasks) -----------------------------


class _Node:
    """Mutable state of one cluster or merged campaign during the fold."""

    __slots__ = ("ord", "cid", "plain", "hubs", "recon", "stages", "held", "t0", "t1", "n", "names", "user", "lat", "egr", "exf", "dsts")

    def __init__(self, row):
        self.ord, self.cid = row["ord"], row["campaign_id"]
        self.plain, self.hubs, self.recon = set(row["plain"]), set(row["hubs"]), bool(row["absorbs_recon"])
        self.t0, self.t1 = row["t0"], row["t1"]
        self.n = row["n_items"]
        self.stages, self.held, self.names, self.user = [], set(), set(), None
        self.lat, self.egr, self.exf, self.dsts = set(), set(), set(), set()
        for stage in row["stages"]:
            self.add_stage(stage)

    def add_stage(self, stage):
        stage = (stage["name"], stage["user"], stage["dst_ip"], stage["apex"], tuple(stage["hosts"]))
        if stage in self.held:
            return
        self.held.add(stage)
        self.stages.append(stage)
        name, user, dst, _, hosts = stage
        self.names.add(name)
        if name == "lateral_auth":
            self.lat.update(hosts)
            self.user = self.user or user
        elif name in EGRESS:
            self.egr.update(hosts)
            if name == "micro_exfil":
                self.exf.update(hosts)
            if dst:
                self.dsts.add(dst)

    def take(self, other):
        self.plain |= other.plain
        self.hubs |= other.hubs
        self.recon |= other.recon
        self.n += other.n
        for name, user, dst, apex, hosts in other.stages:
            self.add_stage({"name": name, "user": user, "dst_ip": dst, "apex": apex, "hosts": hosts})
        starts = [t for t in (self.t0, other.t0) if t is not None]
        ends = [t for t in (self.t1, other.t1) if t is not None]
        self.t0, self.t1 = min(starts, default=None), max(ends, default=None)


def _gap(a, b):
    if None in (a.t0, a.t1, b.t0, b.t1):
        return None
    return max(0, b.t0 - a.t1, a.t0 - b.t1)


def _joins(c, m, gap_us, resume, rules):
    """Whether ``m`` takes in ``c``."""
    gap = _gap(c, m)
    if gap is not None and gap > gap_us:
        return False
    same_user = bool(c.user) and c.user == m.user
    shared = c.plain & m.plain
    recon = c.recon and m.recon
    size = len(shared) + (rules["recon_n"] if recon else 0)
    if not size and not (resume and same_user):
        return False
    if rules["split"] and (gap or 0) >= rules["shape_us"] and c.names != m.names and not same_user:
        return False
    lateral = ("lateral_auth" in c.names, "lateral_auth" in m.names)
    if size and not same_user and any(lateral):
        on_hub = bool(shared & (c.hubs | m.hubs)) or (recon and rules["recon_hub"])
        inside = (c.plain <= m.plain and (m.recon or not c.recon)) or (m.plain <= c.plain and (c.recon or not m.recon))
        if on_hub and not inside and not (c.dsts & m.dsts):
            carriers = c.exf | m.exf
            on_carrier = bool(shared & carriers) or (recon and bool((c.exf - c.plain) | (m.exf - m.plain)))
            if not (on_carrier and ((lateral[0] and m.exf) or (lateral[1] and c.exf))):
                return False
    egress = (bool(c.names & set(EGRESS)), bool(m.names & set(EGRESS)))
    if size >= 2:
        bridge = True
    elif size == 1:
        here = shared or ((c.lat | c.egr) - c.plain) | ((m.lat | m.egr) - m.plain)
        crossing = bool((here & c.lat & m.egr) | (here & m.lat & c.egr))
        bridge = crossing and not all(lateral)
    else:
        bridge = False
    if c.user and m.user and c.user != m.user:
        cross_key = (lateral[0] and egress[1]) or (lateral[1] and egress[0])
        if not cross_key and not bridge:
            return False
        if all(lateral) and not any(egress):
            return False
    return bridge or (resume and same_user)


def fold_group(rows: list[dict], gap_us: int, resume: bool, rules: dict) -> tuple[list[_Node], int | None]:
    """Fold clusters in order until a sweep takes nothing in.

    Only entries that share a host or an account with the cluster and are near it in time are looked at, in list order.
    Returns the entries and the place of the first one with fan-out hosts after the first sweep.
    """
    items = [_Node(r) for r in sorted(rows, key=lambda r: r["ord"])]
    recon_pos = None
    first = True
    while True:
        out: list[_Node] = []
        at = defaultdict(set)  # host, account or fan-out token -> positions in ``out``
        times = _TimeIndex(gap_us)
        took = False
        for c in items:
            around = times.around(c)
            near = set()
            for key in _keys(c, resume):
                near |= at[key] if around is None else at[key] & around
            for pos in sorted(near):
                if _joins(c, out[pos], gap_us, resume, rules):
                    out[pos].take(c)
                    took = True
                    break
            else:
                pos = len(out)
                out.append(c)
            for key in _keys(out[pos], resume):
                at[key].add(pos)
            times.put(pos, out[pos])
        if first:
            recon_pos = min((m.ord for m in out if m.recon), default=None)
            first = False
        items = out
        if not took:
            return out, recon_pos


class _TimeIndex:
    """Positions by the time slots, one gap long, that their ranges cover."""

    def __init__(self, gap_us: int):
        self.gap = gap_us
        self.slots = defaultdict(set)
        self.covered = {}  # position -> first and last slot
        self.timeless = set()

    def put(self, pos, node):
        """Enter a position, or the slots its range has gained."""
        if node.t0 is None or node.t1 is None:
            self.timeless.add(pos)
            return
        self.timeless.discard(pos)
        low, high = node.t0 // self.gap, node.t1 // self.gap
        was = self.covered.get(pos, (low, low - 1))
        for slot in (*range(low, was[0]), *range(was[1] + 1, high + 1)):
            self.slots[slot].add(pos)
        self.covered[pos] = (low, high)

    def around(self, node):
        """Positions whose ranges may be within the gap of the node's; None stands for all."""
        if node.t0 is None or node.t1 is None:
            return None
        out = set(self.timeless)
        for slot in range((node.t0 - self.gap) // self.gap, (node.t1 + self.gap) // self.gap + 1):
            if slot in self.slots:
                out |= self.slots[slot]
        return out


def _keys(node, resume):
    keys = [("h", h) for h in node.plain]
    if node.recon:
        keys.append(("r", ""))
    if resume and node.user:
        keys.append(("u", node.user))
    return keys


def _int(value) -> int:
    return 0 if value is None or pd.isna(value) else int(value)


def _folder(by, gap_us, resume, base_rules):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.to_dict("records")
        rules = dict(base_rules, recon_n=_int(rows[0]["recon_n"]), recon_hub=bool(_int(rows[0]["recon_hub"])))
        for r in rows:
            for f in ("t0", "t1"):
                r[f] = None if pd.isna(r[f]) else int(r[f])
        nodes, pos = fold_group(rows, gap_us, resume, rules)
        head = {c: rows[0][c] for c in by}
        return pd.DataFrame(
            [
                {
                    **head,
                    "gid": rows[0]["gid"],
                    "ord": n.ord,
                    "campaign_id": n.cid,
                    "plain": sorted(n.plain),
                    "hubs": sorted(n.hubs),
                    "absorbs_recon": n.recon,
                    "stages": [
                        {"name": s[0], "user": s[1], "dst_ip": s[2], "apex": s[3], "hosts": list(s[4])} for s in n.stages
                    ],
                    "t0": n.t0,
                    "t1": n.t1,
                    "n_items": n.n,
                    "recon_pos": pos,
                }
                for n in nodes
            ]
        ).astype({"t0": "Int64", "t1": "Int64", "recon_pos": "Int64"})

    return fold


# --- which groups can meet -----------------------------------------------------------------------


def _profile(states: DataFrame) -> DataFrame:
    """Columns the pair rules read, derived from the stages of each state."""
    hosts_of = lambda names: F.array_distinct(
        F.flatten(F.transform(F.filter("stages", lambda s: s["name"].isin(*names)), lambda s: s["hosts"]))
    )
    laterals = F.filter("stages", lambda s: s["name"] == "lateral_auth")
    return (
        states.withColumn("names", F.array_sort(F.array_distinct(F.transform("stages", lambda s: s["name"]))))
        .withColumn("users", F.array_distinct(F.transform(laterals, lambda s: s["user"])))
        .withColumn("user", F.get(F.col("users"), 0))
        .withColumn("lateral_hosts", hosts_of(["lateral_auth"]))
        .withColumn("egress_hosts", hosts_of(list(EGRESS)))
        .withColumn("exfil_hosts", hosts_of(["micro_exfil"]))
        .withColumn(
            "dsts", F.array_distinct(F.array_compact(F.transform("stages", lambda s: F.when(s["name"].isin(*EGRESS), s["dst_ip"]))))
        )
        .withColumn("hosts", F.when(F.col("absorbs_recon"), F.array_append("plain", RECON_TOKEN)).otherwise(F.col("plain")))
        .withColumn("single", F.col("n_items") == 1)
    )


def _buckets(gap_us: int) -> Column:
    """Time buckets covered by a range stretched by the gap; near ranges share at least one."""
    lo = F.expr(f"t0 div {gap_us}")
    hi = F.expr(f"(t1 + {gap_us}) div {gap_us}")
    return F.sequence(lo, hi)


def host_order(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many states hold each host: (by, host, freq)."""
    return states.select(*by, F.explode("plain").alias("host")).groupBy(*by, "host").agg(F.count(F.lit(1)).alias("freq"))


def lookup_rows(states: DataFrame, order: DataFrame, by: Sequence[str], gap_us: int) -> DataFrame:
    """One row per state, host and time slot. ``rare`` is false for the state's most common host in ``order``.

    Under any fixed order of the hosts, two states that share two hosts also share one that is rare for both: the lower of
    the two is not the most common host of either.
    """
    hosts = states.select(*by, "sid", "gid", "t0", "t1", "lateral_hosts", "egress_hosts", F.explode("plain").alias("host"))
    ranked = hosts.join(order, [*by, "host"])
    top = ranked.groupBy(*by, "sid").agg(F.max(F.struct("freq", "host")).alias("top"))
    return ranked.join(top, [*by, "sid"]).select(
        *by, "sid", "gid", "t0", "t1", "host",
        (F.col("host") != F.col("top.host")).alias("rare"),
        F.array_contains("lateral_hosts", F.col("host")).alias("lat"),
        F.array_contains("egress_hosts", F.col("host")).alias("egr"),
        F.explode(_buckets(gap_us)).alias("bucket"),
    )


def _meet(rows: DataFrame, key: Sequence[str], left: Column, right: Column, by: Sequence[str], gap_us: int) -> DataFrame:
    """Near pairs (a_sid, b_sid) of different groups that meet on the key, at least one of them changed."""
    a = rows.filter(left).select(*key, *[F.col(c).alias(f"a_{c}") for c in ("sid", "gid", "fresh", "t0", "t1")])
    b = rows.filter(right).select(*key, *[F.col(c).alias(f"b_{c}") for c in ("sid", "gid", "fresh", "t0", "t1")])
    first = F.greatest(F.expr(f"a_t0 div {gap_us}"), F.expr(f"b_t0 div {gap_us}"))
    return (
        a.join(b, list(key))
        .filter((F.col("a_gid") != F.col("b_gid")) & (F.col("a_fresh") | F.col("b_fresh")) & (F.col("bucket") == first))
        .filter(ranges_near(F.col("a_t0"), F.col("a_t1"), F.col("b_t0"), F.col("b_t1"), gap_us))
        .select(*by, F.least("a_sid", "b_sid").alias("a_sid"), F.greatest("a_sid", "b_sid").alias("b_sid"))
    )


def candidate_pairs(states: DataFrame, by: Sequence[str], gap_us: int) -> DataFrame:
    """Pairs of states that are near in time and may share two hosts, or one across kinds.

    * two shared hosts: a state is looked up by all its hosts except its most common one;
    * one shared host across kinds: account stages are matched with egress stages only.
    """
    key = [*by, "host", "bucket"]
    rows = cut(lookup_rows(states, host_order(states, by), by, gap_us).withColumn("fresh", F.lit(True)))
    two = _meet(rows, key, F.col("rare"), F.col("rare"), by, gap_us)
    return two.union(_meet(rows, key, F.col("lat"), F.col("egr"), by, gap_us)).distinct()


def _star(rows: DataFrame, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Link the groups of each key to its least group."""
    least = rows.groupBy(*key).agg(F.min("gid").alias("low"))
    linked = rows.join(least, list(key)).filter(F.col("gid") != F.col("low"))
    return linked.select(*by, F.col("gid").alias("u"), F.col("low").alias("v")).distinct()


def host_links(rows: DataFrame, states: DataFrame, by: Sequence[str], gap_us: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, edges) of the states that a changed one can meet on their hosts. ``rows`` are the lookup rows with ``fresh``.

    A (host, slot) that at most ``HEAVY`` states look up gives their pairs. In a fuller one the states are looked up by each second host
    besides, and where even that is full their groups are linked to the least one instead: the fold of a group decides
    exactly whatever is linked, so more links than needed cost time, never the result. So rows grow with the lookups.
    """
    key = [*by, "host", "bucket"]
    sizes = rows.groupBy(*key).agg(
        F.count_if("rare").alias("n_rare"), F.count_if("lat").alias("n_lat"), F.count_if("egr").alias("n_egr"), F.max("fresh").alias("touched")
    )
    # keys that no changed state looks up had their turn
    several = (F.col("n_rare") > 1) | ((F.col("n_lat") > 0) & (F.col("n_egr") > 0))
    live = rows.join(sizes.filter(several & F.col("touched")).drop("touched"), key)
    few, crossing = F.col("n_rare") <= HEAVY, F.col("n_lat") * F.col("n_egr") <= HEAVY * HEAVY
    pairs = _meet(live, key, F.col("rare") & few, F.col("rare") & few, by, gap_us)
    pairs = pairs.union(_meet(live, key, F.col("lat") & crossing, F.col("egr") & crossing, by, gap_us))
    edges = _star(live.filter(~crossing & (F.col("lat") | F.col("egr"))), key, by)

    second = [*key, "second"]
    others = states.select(*by, "sid", F.explode("plain").alias("second"))
    full = live.filter(F.col("rare") & ~few).join(others, [*by, "sid"]).filter("second != host")
    counts = full.groupBy(*second).agg(F.count(F.lit(1)).alias("n_second"), F.max("fresh").alias("touched"))
    full = full.join(counts.filter((F.col("n_second") > 1) & F.col("touched")).drop("touched"), second)
    light = F.col("n_second") <= HEAVY
    pairs = pairs.union(_meet(full, second, light, light, by, gap_us))
    return pairs.distinct(), edges.union(_star(full.filter(~light), second, by))


def _chain_links(rows: DataFrame, key: Sequence[str], by: Sequence[str], gap_us: int) -> DataFrame:
    """Link every group of an island to the island's least group (no pairs)."""
    island = [*key, "session_no"]
    chained = range_islands(rows, key, "t0", "t1", gap_us)
    least = chained.groupBy(*island).agg(F.min("gid").alias("low"))
    return (
        chained.join(least, island)
        .filter(F.col("gid") != F.col("low"))
        .select(*by, F.col("gid").alias("u"), F.col("low").alias("v"))
    )


def group_links(states: DataFrame, rows: DataFrame, cfg: FuseConfig, by: Sequence[str], gap_us: int, resume: bool) -> DataFrame:
    """Edges (u, v) between groups that can meet in this pass. ``rows``: lookup rows of ``states`` with ``fresh``."""
    pairs, full_keys = host_links(rows, states, by, gap_us)
    fields = ("gid", "t0", "t1", "hosts", "hubs", "lateral_hosts", "egress_hosts", "exfil_hosts", "names", "user", "dsts", "single")
    side = lambda n: states.select(*by, F.col("sid").alias(f"{n}_sid"), F.struct(*fields).alias(n))
    full = pairs.join(side("a"), [*by, "a_sid"]).join(side("b"), [*by, "b_sid"])
    rule = pair_rules("a", "b", cfg, gap_us)
    exact = rule["near"] & rule["bridge_ok"] & ~rule["refuse_shape_gap"] & ~rule["refuse_hub"] & ~rule["refuse_users"]
    # Candidates already are near and meet on a host in one of the two ways a bridge needs.
    both_single = F.col("a.single") & F.col("b.single")
    loose = (rule["n_shared"] >= 2) | F.arrays_overlap(
        F.array_intersect("a.lateral_hosts", "b.egress_hosts"), F.array_intersect("a.hosts", "b.hosts")
    ) | F.arrays_overlap(F.array_intersect("b.lateral_hosts", "a.egress_hosts"), F.array_intersect("a.hosts", "b.hosts"))
    edges = full.filter(F.when(both_single, exact).otherwise(loose)).select(
        *by, F.least("a.gid", "b.gid").alias("u"), F.greatest("a.gid", "b.gid").alias("v")
    )
    edges = edges.union(full_keys)
    flagged = states.filter("absorbs_recon").select(*by, "gid", "t0", "t1", F.lit(0).alias("_one"))
    edges = edges.union(_chain_links(flagged, [*by, "_one"], by, gap_us))
    if resume:
        users = states.select(*by, "gid", "t0", "t1", F.explode("users").alias("user"))
        edges = edges.union(_chain_links(users, [*by, "user"], by, gap_us))
    return edges.distinct()


_COLUMNS = ("gid", "ord", "campaign_id", "plain", "hubs", "absorbs_recon", "stages", "t0", "t1", "n_items", "recon_pos")


def _fold_groups(
    work: DataFrame, recon: DataFrame, cfg: FuseConfig, by: list[str], gap_us: int, resume: bool
) -> DataFrame:
    """Fold every group of ``work`` in order, one task call per group."""
    types = dict(work.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in by] + [ITEM_FIELDS])
    rules = {"split": cfg.split_on_shape_gap, "shape_us": cfg.window_us}
    if by:
        work = work.join(recon.select(*by, "recon_n", "recon_hub"), by, "left")
    else:
        work = attach_facts(work, recon, by, ["recon_n", "recon_hub"])
    return work.groupBy(*by, "gid").applyInPandas(_folder(by, gap_us, resume, rules), schema).select(*by, *_COLUMNS)


def merge_pass(
    items: DataFrame, recon: DataFrame, cfg: FuseConfig, by: Sequence[str], gap_us: int, resume: bool
) -> tuple[DataFrame, DataFrame]:
    """One merge pass to its fixpoint: (entries, original items with their final group).

    Groups grow by links between those that can meet. After the first round only states that changed look for others; the lookup
    rows and profiles of the rest are the ones written in their own round.
    """
    by = list(by)
    columns = [*by, *_COLUMNS]
    base = items.withColumn("gid", F.lpad(F.col("ord").cast("string"), 14, "0")).withColumn(
        "recon_pos", F.when(F.col("absorbs_recon"), F.col("ord"))
    )
    base = cut(base.withColumn("n_items", F.lit(1).cast("bigint")).select(*columns))
    order = cut(host_order(base, by))
    groups, states, changed = base, base, base
    profiles = rows = None
    while True:
        new = cut(_profile(changed.withColumn("sid", F.concat_ws("/", "gid", F.col("ord").cast("string")))))
        new_rows = cut(lookup_rows(new, order, by, gap_us))
        # what did not change keeps its profile and its lookup rows
        profiles = new if profiles is None else profiles.unionByName(new)
        fresh = new_rows.withColumn("fresh", F.lit(True))
        links = cut(group_links(profiles, fresh if rows is None else rows.withColumn("fresh", F.lit(False)).unionByName(fresh), cfg, by, gap_us, resume))
        if links.isEmpty():
            return states, groups
        labels = component_labels(links, by).withColumnRenamed("node", "gid")
        moved = groups.join(labels, [*by, "gid"], "left")
        work = moved.filter(F.col("label").isNotNull()).withColumn("gid", F.col("label")).select(*columns)
        gone = labels.select(*by, "gid")
        changed = cut(_fold_groups(work, recon, cfg, by, gap_us, resume).select(*columns))
        states = cut(states.join(gone, [*by, "gid"], "left_anti").select(*columns).unionByName(changed))
        profiles = profiles.join(gone, [*by, "gid"], "left_anti")
        rows = (new_rows if rows is None else rows.unionByName(new_rows)).join(gone, [*by, "gid"], "left_anti")
        groups = cut(moved.withColumn("gid", F.coalesce("label", "gid")).select(*columns))


def _with_recon_cluster(
    entries: DataFrame, groups: DataFrame, recon: DataFrame, recon_rows: DataFrame, cfg: FuseConfig, by: list[str]
) -> DataFrame:
    """Let the cluster of all fan-out hosts take part in the first pass.

    It is last in order, of unknown time, and changes neither hosts, range nor stage names of the
    entry that takes it in: the first one that already holds the fan-out hosts after one sweep. So
    only the group of that entry is folded again, with this cluster at its end.
    """
    counts = recon_rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("host")).alias("all_hosts"))
    none = F.lit(None).cast("string")
    stage = F.struct(
        F.lit("recon_fanout").alias("name"), none.alias("user"), none.alias("dst_ip"), none.alias("apex"),
        F.col("all_hosts").alias("hosts"),
    ).cast(STAGE_TYPE)
    nobody = F.array().cast("array<string>")
    unknown = F.lit(None).cast("bigint")
    cluster = counts.filter((F.col("n") >= cfg.min_hosts) & (F.col("n") > 0)).select(
        *by, F.lit("recon").alias("own_gid"), F.lit((1 << 62)).cast("bigint").alias("ord"),
        F.lit("camp-recon-multi").alias("campaign_id"), nobody.alias("plain"), nobody.alias("hubs"),
        F.lit(True).alias("absorbs_recon"), F.array(stage).alias("stages"), unknown.alias("t0"), unknown.alias("t1"),
        F.lit(1).cast("bigint").alias("n_items"), unknown.alias("recon_pos"),
    )
    if cluster.isEmpty():
        return entries
    first = entries.filter(F.col("recon_pos").isNotNull()).groupBy(*by).agg(F.min(F.struct("recon_pos", "gid")).alias("f"))
    target = first.filter(F.col("f").isNotNull()).select(*by, F.col("f.gid").alias("target_gid"))
    if by:
        cluster, aim = cluster.join(target, by, "left"), target.withColumnRenamed("target_gid", "gid")
    else:
        cluster = cluster.withColumn("target_gid", target.select("target_gid").scalar())
        aim = target.withColumnRenamed("target_gid", "gid")
    cluster = cut(cluster.withColumn("gid", F.coalesce("target_gid", "own_gid")).select(*by, *_COLUMNS))
    aim = cut(aim)
    work = groups.join(aim, [*by, "gid"], "left_semi").unionByName(cluster)
    folded = _fold_groups(work, recon, cfg, by, cfg.window_us, False)
    return cut(entries.join(aim, [*by, "gid"], "left_anti").unionByName(folded))


def merge_clusters(
    items: DataFrame, recon: DataFrame, recon_rows: DataFrame, cfg: FuseConfig = FuseConfig(), by: Sequence[str] = ()
) -> DataFrame:
    """Window pass, then resume pass (which also joins clusters of one account that share no host)."""
    by = list(by)
    entries, groups = merge_pass(items, recon, cfg, by, cfg.window_us, False)
    entries = _with_recon_cluster(entries, groups, recon, recon_rows, cfg, by)
    merged, _ = merge_pass(entries, recon, cfg, by, cfg.resume_us, True)
    return merged


def group_sizes(items: DataFrame, recon: DataFrame, cfg: FuseConfig = FuseConfig(), by: Sequence[str] = ()) -> DataFrame:
    """Clusters per fold group of the window pass: the size that one task has to hold."""
    _, groups = merge_pass(items, recon, cfg, by, cfg.window_us, False)
    return groups.groupBy(*by, "gid").agg(F.count(F.lit(1)).alias("n_clusters"))


# --- campaigns -----------------------------------------------------------------------------------


def campaign_hosts(merged: DataFrame, recon_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form (campaign_id, host_id): own hosts, plus all fan-out hosts where they were taken in."""
    own = merged.select(*by, "campaign_id", F.explode("plain").alias("host_id"))
    # The fan-out hosts of a run as one array: the same array its own cluster carries as a stage.
    everyone = recon_rows.groupBy(*by).agg(F.collect_list("host").alias("_all"))
    holders = attach_facts(merged.filter("absorbs_recon").select(*by, "campaign_id"), everyone, by, ["_all"])
    return own.unionByName(holders.select(*by, "campaign_id", F.explode("_all").alias("host_id")))


def campaign_evidence(hosts: DataFrame, signals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every signal on any member host of a campaign, in long form."""
    return hosts.join(signals, [*by, "host_id"])


def finalise(
    merged: DataFrame,
    recon_rows: DataFrame,
    signals: DataFrame | None,
    cfg: FuseConfig = FuseConfig(),
    by: Sequence[str] = (),
) -> DataFrame:
    """Campaign rows: sorted hosts, ordered stages, evidence (a sorted bag) and score."""
    by = list(by)
    hosts = campaign_hosts(merged, recon_rows, by)
    sets = hosts.groupBy(*by, "campaign_id").agg(F.sort_array(F.collect_list("host_id")).alias("host_ids"))
    out = merged.join(sets, [*by, "campaign_id"]).filter(F.size("host_ids") >= cfg.min_hosts)
    score = F.least(F.lit(1.0), F.lit(0.4) + F.lit(0.2) * F.size("host_ids") + F.lit(0.1) * F.size("stages"))
    out = out.select(*by, "ord", "campaign_id", "host_ids", "stages", score.alias("score"), "t0", "t1")
    if signals is None:
        return out
    rows = campaign_evidence(hosts, signals, by)
    bag = rows.groupBy(*by, "campaign_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("kind", "host_id", F.struct("user", "dst_ip", "apex", "host_count", "dst_count", "bytes").alias("attrs"))
            )
        ).alias("evidence")
    )
    empty = "array<struct<kind:string,host_id:string,attrs:struct<user:string,dst_ip:string,apex:string,host_count:bigint,dst_count:bigint,bytes:bigint>>>"
    return out.join(bag, [*by, "campaign_id"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(empty)))


def fused_campaigns(
    events: DataFrame, cfg: FuseConfig = FuseConfig(), by: Sequence[str] = (), with_evidence: bool = True
) -> DataFrame:
    """Cross-host campaigns of a whole event table."""
    from hostweave.operators.detect import all_signals

    by = list(by)
    items, recon = cluster_items(events, cfg, by)
    recon_rows = cut(recon_hosts(events, cfg, by))
    merged = merge_clusters(items, cut(recon), recon_rows, cfg, by)
    signals = all_signals(events, cfg.recon_min_distinct, cfg.max_small_bytes, by) if with_evidence else None
    return finalise(merged, recon_rows, signals, cfg, by)
