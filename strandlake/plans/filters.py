"""Queries of the overlap filter, of saturation and of the read database, SQL beside each. The filter runs over reads tiled
on a genome, where coverage has its usual shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import olfilter, quantiles
from ..operators import overlap as ov
from ..operators.saturation import base_coverage, taken_spans
from ..sources import projections as pr
from ..sources import seqdb
from ..sources.projections import BASES
from .oracles import _CONTAINED, _COVERAGE, _LAYOUTS, _ORDER, ALEN, _best, _location, _reads, _snapped
from .stages import Stages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
IDENTITY, OVERHANG, LENGTH, ALIGNED, BEST, DISCARD = 91.0, 20, 3000, 1000, 4, 1.0
#: What no read's own limits are stricter than.
LOCAL_IDENTITY, LOCAL_OVERHANG = 92.0, 8.0


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


_TILED = """olaps as (select * exclude (lo, hi, q, s, q_at, s_at, q_turn, s_turn) from (
  select q::integer as qid, s::integer as sid, ident, 0::integer as qdir,
    (case when q_turn = 1 then q_at + qsize - hi else lo - q_at end)::integer as qoff, (case when q_turn = 1 then q_at + qsize - lo else hi - q_at end)::integer as qend, qsize::integer as qsize,
    (case when q_turn = s_turn then 0 else 1 end)::integer as sdir,
    (case when s_turn = 1 then s_at + ssize - hi else lo - s_at end)::integer as soff, (case when s_turn = 1 then s_at + ssize - lo else hi - s_at end)::integer as send, ssize::integer as ssize, lo, hi, q, s, q_at, s_at, q_turn, s_turn
  from (
    select *, greatest(q_at, s_at) + noise % 12 + short as lo, least(q_at + qsize, s_at + ssize) - (noise + line) % 7 as hi
    from (
      select *, q * 100 + q * 7919 % 80 as q_at, s * 100 + s * 7919 % 80 as s_at, 3000 + q * 613 % 4000 as qsize, 3000 + s * 613 % 4000 as ssize, q * 31 % 64 % 2 as q_turn, s * 31 % 64 % 2 as s_turn
      from (
        select l_orderkey as q, l_orderkey + 1 + (l_partkey + 6 * nth) % 48 as s, round(100.0 - 100.0 * l_discount, 2)::double as ident, floor(l_quantity)::bigint as noise, l_linenumber as line,
          case when (l_orderkey + l_linenumber) % 40 = 0 then 40 else 0 end as short
        from lineitem, (select unnest(range(8)) as nth) where nth = 0 or l_orderkey // 60 % 6 <> 5)))
  where hi - lo >= 500))"""


def _median(source: str, name: str) -> str:
    """Weighted median of (read, v, w) rows and of their distances to it."""
    run = "select read, v, sum(w) over (partition by read order by v) as u, sum(w) over (partition by read) as a from"
    return f"""{name}_m as (select read, min(v) as median from ({run} {source}) where 2 * u >= a group by read),
{name}_d as (select read, abs(v - median) as v, w from {source} join {name}_m using (read)),
{name} as (select * from {name}_m join (select read, min(v) as mad from ({run} {name}_d) where 2 * u >= a group by read) using (read))"""


_LOCAL = f"""{_TILED}, {_LAYOUTS},
idents as (select read, round(ident * 100)::bigint / 100 as v, round(ident * 100)::bigint * {ALEN} as w from (select qid as read, * from olaps union all select sid, * from olaps)),
own_hangs as (select * from (select qid as read, q_hang::double as v, {ALEN}::bigint as w from overhangs union all select sid, s_hang, {ALEN} from overhangs) where v >= 0),
{_median('idents', 'im')}, {_median('own_hangs', 'hm')}"""


@query(f"with {_LOCAL} select read, im.median as ident, im.mad as ident_mad, hm.median as overhang, hm.mad as overhang_mad from im left join hm using (read)")
def local_statistics(s, d):
    """Weighted medians and deviations of every read's identities and overhangs."""
    return olfilter.local_statistics(pr.tiled_overlaps(s, d))


@query(f"""with {_LOCAL},
own as (select read, least(round(im.median - 6 * 1.4826 * im.mad, 6), {LOCAL_IDENTITY}) as low, greatest(round(hm.median + 6 * 1.4826 * hm.mad, 6), {LOCAL_OVERHANG}) as high from im left join hm using (read))
select distinct qid, sid from overhangs o join own a on a.read = qid join own b on b.read = sid
where ident < a.low or ident < b.low or (q_hang >= 0 and q_hang > a.high) or (s_hang >= 0 and s_hang > b.high)""")  # fmt: skip
def local_check(s, d):
    """Overlaps that the own limits of one of their reads drop."""
    o = pr.tiled_overlaps(s, d)
    limits = Stages(s, "local").keep(olfilter.local_limits(o, LOCAL_IDENTITY, LOCAL_OVERHANG), "limits")
    return olfilter.local_dropped(o, limits, LOCAL_IDENTITY, LOCAL_OVERHANG)


def _trough(source: str, value: str, limit: int = 100, window: int = 9) -> str:
    return f"""span as (select min({value})::bigint as least_v, max({value})::bigint as most_v from {source}),
dense as (
  select v, v - least_v as i, least(most_v - least_v + {2 - window}, {limit}) as n, coalesce(c, 0) as c
  from (select *, unnest(range(least_v, least(most_v, least_v + {limit + window - 2}) + 1)) as v from span) left join (select {value}::bigint as v, count(*) as c from {source} group by 1) using (v)),
sums as (select *, lag(c) over (order by v) > c as fall, sum(c) over (order by v rows between current row and {window - 1} following) as s from dense),
rises as (select *, s >= lag(s) over (order by v) and i < n as rise, coalesce((select min(i) - 1 from sums where fall and i < {limit // 10}), 0) as start from sums),
spot as (select min(i) filter (where rise and i > start) - 1 as spot from rises),
inside as (select v, c, min(c) over () as low, sum(c) over () as total, spot from dense, spot where spot is null or (i >= spot and i < spot + {window})),
trough as (select case when max(spot) is null then min(v) else coalesce(min(v) filter (where c * {window} <= total and c * 10 <= low * 11), min(v) filter (where c = low)) end as trough from inside)"""


_LOADED = f"""{_TILED},
loaded_raw as (select * from olaps where ident >= {IDENTITY} and qid <> sid and qsize >= {LENGTH} and ssize >= {LENGTH} and {ALEN} >= {ALIGNED} and {_location(OVERHANG)} <> 'Abnormal'),
{_snapped('loaded_raw', 'snapped', OVERHANG)}, {_best('snapped', 'loaded')}, {_COVERAGE.format('loaded')}, {_trough('cov', 'cov_min')}"""


@query(f"with {_LOADED} select trough from trough")
def coverage_trough(s, d):
    """The first dip in the least coverages of the tiled reads."""
    loaded = ov.snap_ends(ov.load_filter(pr.tiled_overlaps(s, d), IDENTITY, LENGTH, 2**31 - 1, ALIGNED, OVERHANG), OVERHANG)
    best = ov.best_of_pair(loaded.drop("qdir", "sdir"))
    return quantiles.first_trough(Stages(s, "trough").keep(olfilter.coverage(best), "coverage"), F.col("cov_min"))


def _upper(value: str) -> str:
    return f"(select min(v) from (select {value} as v, count(*) over (order by {value}) as run, count(*) over () as total from cov) where run >= total * (100 - {DISCARD}) / 100)"


def _without(source: str, reads: str) -> str:
    return f"(select * from {source} where qid not in (select read from {reads}) and sid not in (select read from {reads}))"


@query(f"""with {_LOADED},
cuts as (select trough as p0, {_upper('cov_max')} as p1, {_upper('cov_max - cov_min')} as p2 from trough),
dropped as (select read from cov, cuts where cov_min < p0 or cov_max > p1 or cov_max - cov_min > p2),
covered as {_without('loaded', 'dropped')},
adj as (select distinct * from (select qid as read, sid as other, qoff <= {OVERHANG} as at0, qsize - qend <= {OVERHANG} as at1 from covered union all select sid, qid, soff <= {OVERHANG}, ssize - send <= {OVERHANG} from covered)),
common as (select p.qid, p.sid, count(*) filter (where a.at0) as q0, count(*) filter (where a.at1) as q1, count(*) filter (where b.at0) as s0, count(*) filter (where b.at1) as s1
  from covered p join adj a on a.read = p.qid and a.other <> p.sid join adj b on b.read = p.sid and b.other = a.other group by p.qid, p.sid),
marks as (select *, (select greatest(p0 - 1, 1) from cuts) as need, {_location(0)} as loc from covered left join common using (qid, sid)),
supported as (select * exclude (q0, q1, s0, s1, need, loc) from marks where
  case when loc = 'Left' and qdir = sdir then q1 >= need and s0 >= need when loc = 'Right' and qdir = sdir then q0 >= need and s1 >= need when loc = 'Left' then q0 >= need and s0 >= need when loc = 'Right' then q1 >= need and s1 >= need
    when loc = 'Containing' then s0 >= need and s1 >= need when loc = 'Contained' then q0 >= need and q1 >= need when loc = 'Equal' then q0 >= need and q1 >= need and s0 >= need and s1 >= need else false end),
inner_reads as {_CONTAINED.format('supported')},
proper as {_without('supported', 'inner_reads')},
ends as (select *, {_location(0)} as loc, {ALEN} as alen from proper),
sides as (select *, qid as read, loc as side from ends where loc in ('Left', 'Right') union all select *, sid, case when qdir = sdir and loc = 'Left' then 'Right' when qdir = sdir then 'Left' else loc end from ends where loc in ('Left', 'Right')),
best as (select distinct qid, sid from (select *, row_number() over (partition by read, side order by {_ORDER}) as r from sides) where r <= {BEST})
select qid, sid, case when (qid, sid) not in (select (qid, sid) from covered) then 'Coverage' when (qid, sid) not in (select (qid, sid) from supported) then 'LackOfSupport'
  when (qid, sid) not in (select (qid, sid) from proper) then 'Contained' when (qid, sid) not in (select (qid, sid) from best) then 'BestN' end as reason from loaded""")  # fmt: skip
def filter_tiled(s, d):
    """All steps of the filter with coverage limits chosen from the reads, and the reason of each drop."""
    return olfilter.run(pr.tiled_overlaps(s, d), IDENTITY, OVERHANG, LENGTH, ALIGNED, BEST, DISCARD, Stages(s, "filter").keep).select("qid", "sid", "reason")


DEPTH, LEAST_SHORT = 2, 500
_SPANS = f"""{_TILED}, {_best('olaps', 'pairs')},
views as (select qid as subject, sid as other, qoff as a, qend as z, {ALEN} as alen, ident from pairs union all select sid, qid, soff, send, {ALEN}, ident from pairs),
spans as (select subject, a::bigint as a, z::bigint as z, row_number() over (partition by subject order by alen desc, ident desc, other)::integer as rank from views)"""
_TAKEN = f"""{_SPANS},
asked as (
  select subject, 0 as rank, []::struct(a bigint, z bigint)[] as acc, false as won from (select distinct subject from spans)
  union all
  select subject, rank, case when short >= {LEAST_SHORT} then list_append(acc, struct_pack(a := a, z := z)) else acc end, short >= {LEAST_SHORT}
  from (
    select *, list_sum(list_transform(range(1, len(pts)), lambda i: case when len(list_filter(acc, lambda x: x.a <= pts[i] and x.z > pts[i])) < {DEPTH} then pts[i + 1] - pts[i] else 0 end)) as short
    from (
      select k.subject, s.rank, k.acc, s.a, s.z, list_sort(list_distinct(list_concat([s.a, s.z], list_filter(list_concat(list_transform(k.acc, lambda x: x.a), list_transform(k.acc, lambda x: x.z)), lambda p: p > s.a and p < s.z)))) as pts
      from asked k join spans s on s.subject = k.subject and s.rank = k.rank + 1))),
taken as (select subject, rank from asked where won)"""


def _taken(s, d):
    best = ov.best_of_pair(pr.tiled_overlaps(s, d).select("qid", "sid", "ident", "qoff", "qend", "soff", "send"))
    side = lambda own, a, z, other: F.struct(F.col(own).alias("subject"), F.col(a).alias("a"), F.col(z).alias("z"), F.col(other).alias("other"))
    views = F.inline(F.array(side("qid", "qoff", "qend", "sid"), side("sid", "soff", "send", "qid")))
    spans = best.select(ov.aligned_length().alias("alen"), "ident", views)
    return taken_spans(spans, DEPTH, LEAST_SHORT, Stages(s, "saturation").keep, by=[F.desc("alen"), F.desc("ident"), F.col("other")])


@query(f"with recursive {_TAKEN} select subject, rank from taken")
def saturation(s, d):
    """Overlaps of every read that are taken, best first, until its coverage is full."""
    return _taken(s, d).select("subject", "rank")


@query(f"""with recursive {_TAKEN}, chosen as (select * from spans semi join taken using (subject, rank)),
points as (select subject, pt, sum(d) as d from (select subject, a as pt, 1 as d from chosen union all select subject, z, -1 from chosen) group by all)
select subject, lo, hi, depth::bigint as depth from (select subject, pt as lo, lead(pt) over w as hi, sum(d) over w as depth from points window w as (partition by subject order by pt)) where depth > 0""")
def consensus_coverage(s, d):
    """Coverage of every read by its taken overlaps."""
    return base_coverage(_taken(s, d))


DB_BASES, DB_READS, DB_LEAST = 150_000, 60, 300
_DATABASE = f"""{_reads(BASES[:25] + 'N')}, long_reads as (select * from reads where len >= {DB_LEAST}), o as (select *, row_number() over (order by read_id) as r from long_reads),
w as (select 1 as r, 1 as volume, 1 as n, len::bigint as mass from o where r = 1
  union all select o.r, case when w.mass >= {DB_BASES} or w.n >= {DB_READS} then w.volume + 1 else w.volume end, case when w.mass >= {DB_BASES} or w.n >= {DB_READS} then 1 else w.n + 1 end,
    case when w.mass >= {DB_BASES} or w.n >= {DB_READS} then o.len else w.mass + o.len end from w join o on o.r = w.r + 1),
rows_ as (select (r - 1)::bigint as id, volume::integer as volume, read_id, len, seq from o join w using (r))"""


def _database(s, d):
    """A database of all reads in a folder of its own."""
    folder = Stages(s, "database").root
    seqdb.build(s, pr.reads(s, d, to=pr.BASES[:25] + "N").select("read_id", "seq"), folder, DB_BASES, DB_READS, DB_LEAST)
    return folder


@query(f"with recursive {_DATABASE} select id, volume, read_id, len, md5(regexp_replace(seq, '[^ACGT]', 'A', 'g')) as coded, md5(seq) as sum from rows_ where volume in (select volume from rows_ where regexp_matches(seq, 'NN'))")
def database_scan(s, d):
    """The volumes of a built database that have a run of two ambiguous codes, read alone and restored."""
    folder = _database(s, d)
    wanted = s.read.parquet(f"{folder}/ambiguous").where("size >= 2").select("volume")
    rows = seqdb.scan(s, folder, wanted).withColumn("coded", F.md5("seq"))
    return seqdb.restored(s, folder, rows).select("id", "volume", "read_id", "len", "coded", F.md5("seq").alias("sum"))


@query(f"with recursive {_DATABASE} select volume, count(*)::bigint as reads, sum(len)::bigint as bases, min(id)::bigint as first_id, max(id)::bigint as last_id from rows_ group by volume")
def database_volumes(s, d):
    """What each volume of a built database holds."""
    rows = seqdb.scan(s, _database(s, d))
    return rows.groupBy("volume").agg(F.count("*").alias("reads"), F.sum(F.col("len").cast("long")).alias("bases"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
