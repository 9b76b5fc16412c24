"""Queries of contig bridging: links by reads and of contigs alone, sessions, the contig graph and its paths; SQL beside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import bridge, pathgraph
from ..sources import projections as pr
from .oracles import _location
from .stages import Stages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Bases that ends may miss, a session's jump, links that have to cover it, how near a direct link is.
ERR, GAP, LEAST, REACH = 20, 200, 3, 60


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _contig(c: str, p: str) -> str:
    inner = f"{c} % 9 = 4"
    return f"case when {inner} then {c} * {pr.PITCH} - 4000 else {c} * {pr.PITCH} + {c} * 37 % 500 end as {p}_at, (case when {inner} then 2000 else 5800 + {c} * 101 % 1100 end)::bigint as {p}_size, {c} * 5 % 3 % 2 as {p}_turn"


def _placed(source: str, name: str) -> str:
    off = lambda r, a, b: f"(case when {r}_turn = 1 then {r}_at + {r}_size - {b} else {a} - {r}_at end)::integer"
    return f"""{name} as (select q::integer as qid, s::integer as sid, 99.0::double as ident, 0::integer as qdir, {off('q', 'lo', 'hi')} as qoff, {off('q', 'hi', 'lo')} as qend, q_size::integer as qsize,
  (case when q_turn = s_turn then 0 else 1 end)::integer as sdir, {off('s', 'lo', 'hi')} as soff, {off('s', 'hi', 'lo')} as send, s_size::integer as ssize from {source} where hi - lo >= 500)"""


def _between(p: str, fl: str, fh: str, tl: str, th: str, same: str) -> str:
    return f"""(case when {same} then case when {p} < {fl} then {tl} + ({p} - {fl}) when {p} < {fh} then {tl} + (({p} - {fl})::bigint * ({th} - {tl})) // ({fh} - {fl}) else {th} + ({p} - {fh}) end
    else case when {p} > {fh} then {tl} - ({p} - {fh}) when {p} > {fl} then {tl} - (({p} - {fh})::bigint * ({th} - {tl})) // ({fh} - {fl}) else {th} - ({p} - {fl}) end end)::bigint"""


def _link_columns(source: str, extra: str) -> str:
    """``source`` (pos0 to pos3, start1, end1, len1) with the ends on the target and where the source lies."""
    sign = lambda x: f"(case when {x} < -{ERR} then -1 when {x} > {ERR} then 1 else 0 end)"
    a, z = sign("lo"), sign("hi - len1")
    return f"""select {extra}, same, len0, len1, pos0, lo, hi, greatest(lo, 0)::bigint as expect_lo, least(hi, len1)::bigint as expect_hi, greatest(least(pos1, pos2), start1)::bigint as real_lo, least(greatest(pos1, pos2), end1)::bigint as real_hi,
  case when {a} < 0 and {z} < 0 then 'Left' when {a} > 0 and {z} > 0 then 'Right' when {a} = 0 and {z} = 0 then 'Equal' when {a} <= 0 and {z} >= 0 then 'Containing' when {a} >= 0 and {z} <= 0 then 'Contained' else 'Abnormal' end as loc
  from (select *, least(pos0, pos3) as lo, greatest(pos0, pos3) as hi from {source})"""


_READS = "tiles as (select distinct l_orderkey as q from lineitem), reads as (select q, q * 100 + q * 7919 % 80 as q_at, 3000 + q * 613 % 4000 as q_size, q * 31 % 64 % 2 as q_turn from tiles)"
_HITS = f"""{_READS},
near as (select *, {_contig('s', 's')} from (select *, unnest([q_at // {pr.PITCH} - 1, q_at // {pr.PITCH}, q_at // {pr.PITCH} + 1, q_at // {pr.PITCH} + 2]) as s from reads) where s >= 0),
shared as (select *, greatest(q_at, s_at) + q % 9 as lo, least(q_at + q_size, s_at + s_size) - q * 3 % 7 as hi from near), {_placed('shared', 'hits')}"""
_CTG = f"""{_READS}, begun as (select distinct q_at // {pr.PITCH} as q from reads),
beside as (select *, {_contig('q', 'q')}, {_contig('s', 's')} from (select q, unnest([q + 1, q + 2]) as s from begun)),
touching as (select *, greatest(q_at, s_at) as lo, least(q_at + q_size, s_at + s_size) as hi from beside), {_placed('touching', 'contig_rows')}"""
_VIEWS = f"""placed as (select *, case when loc = 'Left' and qdir = sdir then 'Right' when loc = 'Right' and qdir = sdir then 'Left' when loc = 'Containing' then 'Contained' when loc = 'Contained' then 'Containing' else loc end as view
  from (select *, {_location(ERR)} as loc from hits) where loc <> 'Abnormal')"""


def _on_target(p: str) -> str:
    return _between(_between(p, "a.soff", "a.send", "a.qoff", "a.qend", "(a.qdir = a.sdir)"), "b.qoff", "b.qend", "b.soff", "b.send", "(b.qdir = b.sdir)")


_LINKS = f"""{_HITS}, {_VIEWS},
joined as (
  select a.sid as c0, b.sid as c1, a.qid as read, (a.qdir = a.sdir) = (b.qdir = b.sdir) as same, a.ssize as len0, b.ssize as len1, b.soff as start1, b.send as end1,
    {_on_target('0')} as pos0, {_on_target('a.soff')} as pos1, {_on_target('a.send')} as pos2, {_on_target('a.ssize')} as pos3
  from placed a join placed b on a.qid = b.qid and a.sid < b.sid
  where (a.view = 'Left' and b.view = 'Right') or (a.view = 'Right' and b.view = 'Left') or a.view in ('Equal', 'Contained') or b.view in ('Equal', 'Contained')),
links as ({_link_columns('joined', 'c0, c1, read')})"""
_DIRECT = f"""sides as (
  select case when qid > sid then sid else qid end as c0, case when qid > sid then qid else sid end as c1, qdir = sdir as same, case when qid > sid then ssize else qsize end as len0, case when qid > sid then qsize else ssize end as len1,
    case when qid > sid then soff else qoff end as s0, case when qid > sid then send else qend end as e0, case when qid > sid then qoff else soff end as start1, case when qid > sid then qend else send end as end1
  from (select *, {_location(ERR)} as loc from contig_rows) where qid <> sid and loc <> 'Abnormal'),
mapped as (select *, {_between('0', 's0', 'e0', 'start1', 'end1', 'same')} as pos0, {_between('s0', 's0', 'e0', 'start1', 'end1', 'same')} as pos1, {_between('e0', 's0', 'e0', 'start1', 'end1', 'same')} as pos2, {_between('len0', 's0', 'e0', 'start1', 'end1', 'same')} as pos3 from sides),
direct as ({_link_columns('mapped', 'c0, c1, (e0 - s0 + end1 - start1) // 2 as aligned')})"""
_FOUND = f"""{_LINKS},
numbered as (select *, sum(fresh) over (partition by c0, c1, same order by pos0, read rows unbounded preceding)::bigint as session from (
  select *, case when coalesce(pos0 - lag(pos0) over (partition by c0, c1, same order by pos0, read) > {GAP}, true) then 1 else 0 end as fresh from links where loc <> 'Abnormal')),
summary as (
  select c0, c1, same, session, count(*) as links, min(pos0) as first, max(pos0) as last, arg_min(read, struct_pack(a := pos0, b := read)) as read, arg_min(loc, struct_pack(a := pos0, b := read)) as loc,
    min(pos0) as pos0, floor(sum(expect_lo)::double / count(*))::bigint as elo, floor(sum(expect_hi)::double / count(*))::bigint as ehi from numbered group by all),
events as (
  select n.c0, n.c1, n.same, n.session, s.elo, s.ehi, greatest(n.real_lo, s.elo) as a, least(n.real_hi, s.ehi) as z from numbered n join summary s on s.c0 = n.c0 and s.c1 = n.c1 and s.same = n.same and s.session = n.session),
points as (
  select c0, c1, same, session, elo, ehi, pt, sum(d) as d from (
    select *, a as pt, 1 as d from events where z > a union all select *, z, -1 from events where z > a union all select *, elo + {ERR}, 0 from events) group by all),
stretches as (select *, sum(d) over w as depth, coalesce(lead(pt) over w, ehi) as upto from points window w as (partition by c0, c1, same, session order by pt)),
depths as (select c0, c1, same, session, min(depth)::bigint as depth from stretches where upto > elo + {ERR} and pt < ehi - {ERR} and upto > pt group by all),
found as (
  select s.c0, s.c1, s.same, s.session, s.links, s.first, s.last, s.read, s.loc, s.pos0, d.depth
  from summary s left join depths d on d.c0 = s.c0 and d.c1 = s.c1 and d.same = s.same and d.session = s.session where s.ehi - s.elo <= {2 * ERR} or coalesce(d.depth, 0) > {LEAST})"""
_BUNCHES = f"""{_FOUND}, {_CTG.replace(_READS + ', ', '')}, {_DIRECT},
alone as (
  select c0, c1, same, loc, links as support, 'reads' as kind from (
    select *, row_number() over (partition by c0, c1 order by links desc, same desc, session) as r from found where (c0, c1) not in (select (c0, c1) from direct)) where r = 1),
agreeing as (
  select f.c0, f.c1, f.same, d.loc, f.links as support, 'direct' as kind, row_number() over (partition by f.c0, f.c1 order by f.links desc, f.same desc, f.session, d.aligned desc, d.pos0) as r
  from found f join direct d on d.c0 = f.c0 and d.c1 = f.c1 and d.same = f.same and abs(f.pos0 - d.pos0) < {REACH}),
bunches as (select * from alone union all select * exclude (r) from agreeing where r = 1)"""
_GRAPH = f"""{_BUNCHES},
gone as (select distinct case loc when 'Containing' then c1 when 'Contained' then c0 else greatest(c0, c1) end as contig from bunches where loc in ('Containing', 'Contained', 'Equal')),
free as (select * from bunches where loc in ('Left', 'Right') and c0 not in (select contig from gone) and c1 not in (select contig from gone)),
one_way as (select case when same then (case when loc = 'Left' then c1 + 1 else c0 + 1 end) when loc = 'Left' then c1 + 1 else -(c0 + 1) end as src,
  case when same then (case when loc = 'Left' then c0 + 1 else c1 + 1 end) when loc = 'Left' then -(c0 + 1) else c1 + 1 end as dst, support as score from free),
two_ways as (select src, dst, score from one_way union select -dst, -src, score from one_way),
cedges as (select src || '~' || dst as eid, (-dst) || '~' || (-src) as rid, src, dst, score, least(src || '~' || dst, (-dst) || '~' || (-src)) as name from two_ways)"""


def _links(s, d, keep):
    return keep(bridge.read_links(keep(pr.contig_hits(s, d), "hits"), ERR), "links")


def _bunches(s, d, keep):
    found = keep(bridge.supported_sessions(_links(s, d, keep), GAP, ERR, LEAST), "sessions")
    return keep(bridge.best_bunches(found, keep(bridge.direct_links(keep(pr.contig_overlaps(s, d), "rows"), ERR), "direct"), REACH), "bunches")


@query(f"with {_LINKS} select * from links")
def contig_links(s, d):
    """Links of two contigs by each read that lies on both."""
    return bridge.read_links(Stages(s, "links").keep(pr.contig_hits(s, d), "hits"), ERR)


@query(f"with {_CTG}, {_DIRECT} select * from direct")
def contig_direct_links(s, d):
    """Links of contigs that overlap each other."""
    return bridge.direct_links(Stages(s, "links").keep(pr.contig_overlaps(s, d), "rows"), ERR)


@query(f"with {_FOUND} select * from found")
def contig_sessions(s, d):
    """Sessions of read links that cover the part they should."""
    return bridge.supported_sessions(_links(s, d, Stages(s, "links").keep), GAP, ERR, LEAST)


@query(f"with {_BUNCHES} select * from bunches")
def contig_bunches(s, d):
    """The link of each pair of contigs, by reads alone or agreeing with a direct one."""
    return _bunches(s, d, Stages(s, "bunches").keep)


@query(f"with {_GRAPH} select eid, rid, src, dst, score from cedges")
def contig_graph_edges(s, d):
    """Edges between the ends of contigs that lie in no other."""
    return bridge.contig_graph(_bunches(s, d, Stages(s, "graph").keep))


@query(f"""with recursive {_GRAPH},
o as (select src as node, count(*) as n, arg_min(eid, struct_pack(a := -score, b := name)) as best from cedges group by src),
i as (select dst as node, count(*) as n, arg_min(eid, struct_pack(a := -score, b := name)) as best from cedges group by dst),
joins as (select i.best as e, o.best as next from i join o using (node) where i.n = 1 or o.n = 1),
line as (
  select eid as path, eid, 0 as pos from cedges where eid not in (select next from joins)
  union all select l.path, k.next, l.pos + 1 from line l join joins k on k.e = l.eid),
least_of as (select path, min(eid) as a, min(rid) as b from line join cedges using (eid) group by path)
select path, pos, eid, rid, a <= b as forward from line join cedges using (eid) join least_of using (path)""")  # fmt: skip
def contig_paths(s, d):
    """Paths over the best supported links of the contig graph, with their reverses."""
    keep = Stages(s, "contig_paths").keep
    return pathgraph.chosen_paths(keep(bridge.contig_graph(_bunches(s, d, keep)), "edges"), keep)


_LAYOUT = f"""{_GRAPH},
o as (select src as node, count(*) as n, arg_min(eid, struct_pack(a := -score, b := name)) as best from cedges group by src),
i as (select dst as node, count(*) as n, arg_min(eid, struct_pack(a := -score, b := name)) as best from cedges group by dst),
joins as (select i.best as e, o.best as next from i join o using (node) where i.n = 1 or o.n = 1),
line as (
  select eid as path, eid, 0 as pos from cedges where eid not in (select next from joins)
  union all select l.path, k.next, l.pos + 1 from line l join joins k on k.e = l.eid),
least_of as (select path, min(eid) as a, min(rid) as b from line join cedges using (eid) group by path),
first_reads as (select * from (select *, row_number() over (partition by c0, c1 order by links desc, same desc, session) as r from found) where r = 1),
near_ends as (
  select u.c0, u.c1, u.loc, f.read, (u.loc = 'Left') = (b.qdir = b.sdir) as up,
    case when (u.loc = 'Left') = u.same then {_between('a.ssize', 'a.soff', 'a.send', 'a.qoff', 'a.qend', '(a.qdir = a.sdir)')} else {_between('0', 'a.soff', 'a.send', 'a.qoff', 'a.qend', '(a.qdir = a.sdir)')} end as d0,
    case when u.loc = 'Left' then {_between('0', 'b.soff', 'b.send', 'b.qoff', 'b.qend', '(b.qdir = b.sdir)')} else {_between('b.ssize', 'b.soff', 'b.send', 'b.qoff', 'b.qend', '(b.qdir = b.sdir)')} end as d1
  from bunches u join first_reads f on f.c0 = u.c0 and f.c1 = u.c1 and f.same = u.same join placed a on a.qid = f.read and a.sid = u.c0 join placed b on b.qid = f.read and b.sid = u.c1
  where u.kind = 'reads' and u.loc in ('Left', 'Right')),
joints as (
  select c0, c1, case when up then d1 - d0 else d0 - d1 end as gap, read, least(d0, d1) as from_, greatest(d0, d1) as upto, not up as turned from near_ends
  union all
  select c0, c1, arg_max(case when loc = 'Left' then -hi else lo - len1 end, struct_pack(a := aligned, b := -pos0)), null, null, null, null
  from direct semi join (select c0, c1, same, loc from bunches where kind = 'direct' and loc in ('Left', 'Right')) using (c0, c1, same, loc) group by c0, c1),
sizes as (select distinct s as contig, s_size::bigint as len from near),
steps as (
  select path, pos, src, dst, abs(dst) - 1 as nxt, j.*, abs(src) > abs(dst) as back, z.len, least(greatest(-j.gap, 0), z.len) as cut
  from line join least_of using (path) join cedges using (eid) join joints j on j.c0 = least(abs(src), abs(dst)) - 1 and j.c1 = greatest(abs(src), abs(dst)) - 1 join sizes z on z.contig = abs(dst) - 1 where a <= b),
pieces as (
  select path, 0 as nth, 'contig' as kind, abs(src) - 1 as id, 0 as start, z.len as "end", src > 0 as turned from steps join sizes z on z.contig = abs(src) - 1 where pos = 0
  union all select path, 2 * pos + 1, 'read', read, from_, upto, turned <> back from steps where gap > 0
  union all select path, 2 * pos + 2, 'contig', nxt, case when dst < 0 then cut else 0 end, case when dst < 0 then len else len - cut end, dst > 0 from steps
  union all select contig::varchar, 0, 'contig', contig, 0, len, false from sizes where contig not in (select abs(src) - 1 from cedges) and contig not in (select contig from gone))"""


@query(f'with recursive {_LAYOUT} select path, nth::bigint as nth, kind, id::bigint as id, start::bigint as start, "end"::bigint as "end", turned from pieces')
def bridged_layout(s, d):
    """What every bridged contig is made of: contigs, and reads where two of them leave a gap."""
    keep = Stages(s, "layout").keep
    hits = keep(pr.contig_hits(s, d), "hits")
    found = keep(bridge.supported_sessions(keep(bridge.read_links(hits, ERR), "links"), GAP, ERR, LEAST), "sessions")
    direct = keep(bridge.direct_links(keep(pr.contig_overlaps(s, d), "rows"), ERR), "direct")
    bunches = keep(bridge.best_bunches(found, direct, REACH), "bunches")
    edges = keep(bridge.contig_graph(bunches), "edges")
    contigs = pr.contigs(s, d)
    return bridge.layout(pathgraph.chosen_paths(edges, keep), edges, keep(bridge.bridges(found, hits, direct, bunches), "joints"), contigs, bridge.contained_contigs(bunches))
