"""The ordered merge as DuckDB SQL: one recursive step per cluster, sweep after sweep, the window pass and then the resume pass."""

import re


def fold_sql(wus: int, rus: int, min_hosts: int) -> str:
    """CTEs over cid, recon and facts: ``folded``, the merged clusters after both passes of the ordered fold."""
    stage = "STRUCT(name VARCHAR, usr VARCHAR, dst VARCHAR, apex VARCHAR, hosts VARCHAR[])[]"
    of = lambda names, st: f"list_distinct(flatten(list_transform(list_filter({st}, lambda s: s.name IN ({names})), lambda s: s.hosts)))"
    egress = "'micro_exfil', 'dns_beacon'"

    def node(ord_, cid, hosts, st, t0, t1):
        return (
            f"{{'ord': {ord_}, 'cid': {cid}, 'h': {hosts}, 'st': {st}, 't0': {t0}, 't1': {t1}, "
            f"'nm': list_sort(list_distinct(list_transform({st}, lambda s: s.name))), 'u': list_filter({st}, lambda s: s.name = 'lateral_auth')[1].usr, "
            f"'lat': {of(chr(39) + 'lateral_auth' + chr(39), st)}, 'egr': {of(egress, st)}, 'exf': {of(chr(39) + 'micro_exfil' + chr(39), st)}, "
            f"'dst': list_distinct(list_transform(list_filter({st}, lambda s: s.name IN ({egress}) AND s.dst IS NOT NULL), lambda s: s.dst))}}"
        )

    lat = lambda x: f"list_contains({x}.nm, 'lateral_auth')"
    egr = lambda x: f"list_has_any({x}.nm, [{egress}])"
    c, m, sh = "c", "o", "list_intersect(c.h, o.h)"
    gap = "greatest(0, o.t0 - c.t1, c.t0 - o.t1)"
    known = "(c.t0 IS NOT NULL AND o.t0 IS NOT NULL)"
    same = "coalesce(c.u = o.u, false)"
    n = f"len({sh})"
    bridge = f"({n} >= 2 OR {n} = 1 AND (len(list_intersect(list_intersect({sh}, c.lat), o.egr)) > 0 OR len(list_intersect(list_intersect({sh}, o.lat), c.egr)) > 0) AND NOT ({lat(c)} AND {lat(m)}))"
    carrier = f"(len(list_intersect({sh}, list_concat(c.exf, o.exf))) > 0 AND ({lat(c)} AND len(o.exf) > 0 OR {lat(m)} AND len(c.exf) > 0))"
    joins = (
        f"({n} > 0 OR phase = 2 AND {same})"
        f" AND NOT (CASE WHEN {known} THEN {gap} ELSE 0 END >= {wus} AND c.nm <> o.nm AND NOT {same})"
        f" AND NOT ({n} > 0 AND NOT {same} AND ({lat(c)} OR {lat(m)}) AND len(list_intersect({sh}, hl)) > 0 AND {n} < len(c.h) AND {n} < len(o.h)"
        f" AND len(list_intersect(c.dst, o.dst)) = 0 AND NOT {carrier})"
        f" AND NOT (coalesce(c.u <> o.u, false) AND (NOT ({lat(c)} AND {egr(m)} OR {lat(m)} AND {egr(c)}) AND NOT {bridge} OR {lat(c)} AND {lat(m)} AND NOT {egr(c)} AND NOT {egr(m)}))"
        f" AND ({bridge} OR phase = 2 AND {same})"
    )
    near = f"NOT {known} OR {gap} <= CASE phase WHEN 1 THEN {wus} ELSE {rus} END"
    at = lambda cond: re.sub(r"\bo\.", "z.o.", cond)
    merged = node("m.ord", "m.cid", "list_sort(list_distinct(list_concat(m.h, c.h)))", "list_concat(m.st, list_filter(c.st, lambda x: NOT list_contains(m.st, x)))", "least(m.t0, c.t0)", "greatest(m.t1, c.t1)")
    one = "{{'name': {0}, 'usr': {1}, 'dst': {2}, 'apex': {3}, 'hosts': {4}}}".format
    own = one(
        "CASE kind WHEN 'lateral' THEN 'lateral_auth' WHEN 'exfil' THEN 'micro_exfil' ELSE 'dns_beacon' END", "CASE WHEN kind = 'lateral' THEN key END",
        "CASE WHEN kind = 'exfil' THEN key END", "CASE WHEN kind = 'dns' THEN key END", "hosts",
    )
    stages = f"CAST(CASE WHEN len(rc) > 0 THEN [{one(chr(39) + 'recon_fanout' + chr(39), 'NULL', 'NULL', 'NULL', 'rc')}, {own}] ELSE [{own}] END AS {stage})"
    last = f"CAST([{one(chr(39) + 'recon_fanout' + chr(39), 'NULL', 'NULL', 'NULL', 'rh')}] AS {stage})"
    return f"""rl AS (SELECT coalesce(list_sort(list(host)), []) AS rh FROM recon),
  hb AS (SELECT coalesce(list(host), []) AS hl FROM (SELECT host FROM hop GROUP BY 1 HAVING count(DISTINCT peer) >= (SELECT hub_bar FROM facts))),
  c0 AS (SELECT *, list_sort(list_intersect(hosts, rh)) AS rc FROM cid, rl),
  c1 AS (SELECT part AS ord, campaign_id AS cid, CASE WHEN len(rc) > 0 THEN list_sort(list_distinct(list_concat(hosts, rh))) ELSE hosts END AS h, {stages} AS st, t0, t1 FROM c0
    UNION ALL SELECT 4611686018427387904, 'camp-recon-multi', rh, {last}, NULL, NULL FROM rl WHERE len(rh) >= {min_hosts}),
  c2 AS (SELECT {node('ord', 'cid', 'h', 'st', 't0', 't1')} AS x FROM c1),
  f(id, phase, i, items, out, took) USING KEY (id) AS (
    SELECT 1, 1, 1, list(x ORDER BY x.ord), list(x) FILTER (WHERE false), false FROM c2
    UNION ALL
    SELECT id, CASE WHEN c IS NULL AND NOT took THEN phase + 1 ELSE phase END, CASE WHEN c IS NULL THEN 1 ELSE i + 1 END, CASE WHEN c IS NULL THEN out ELSE items END,
      CASE WHEN c IS NULL THEN [] WHEN p IS NULL THEN list_append(out, c) ELSE list_concat(list_append(out[:p - 1], {merged}), out[p + 1:]) END,
      c IS NOT NULL AND (took OR p IS NOT NULL)
    FROM (SELECT *, out[p] AS m FROM (
      SELECT *, list_filter(list_filter(list_transform(out, lambda o, j: {{'j': j, 'o': o}}), lambda z: {at(near)}), lambda z: {at(joins)})[1].j AS p
      FROM (SELECT id, phase, i, items, coalesce(out, []) AS out, took, items[i] AS c FROM f WHERE phase < 3), hb))),
  folded AS (SELECT unnest(items, recursive := false) AS x FROM f WHERE phase = 3)"""
