"""The same rows as the catalogue's queries in ANSI SQL over the driver's tables."""

from __future__ import annotations

import re

from ..sources.projections import BASES, LETTERS


def _reads(to: str = BASES) -> str:
    return f"""reads as (select read_id, seq, length(seq)::integer as len from (
      select doc_id as read_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{to}') as seq from documents) where length(seq) >= 13)"""


def _overlaps(shapes: str = "0, 1, 2, 3") -> str:
    return f"""olaps as (select qid, sid, ident, 0::integer as qdir, qoff::integer as qoff, qend::integer as qend, qsize, sdir::integer as sdir, soff::integer as soff, send::integer as send, ssize from (
     select qid, sid, qsize, ssize, round(100.0 - 100.0 * l_discount, 2)::double as ident,
      case when m = 3 then 1 else 0 end as sdir,
      case m when 0 then qsize - al - oh when 2 then case when qsize <= ssize then 0 else (qsize - ssize) // 2 end else 0 end as qoff,
      case m when 0 then qsize - oh when 2 then case when qsize <= ssize then qsize else (qsize - ssize) // 2 + ssize end else al end as qend,
      case m when 1 then ssize - al - oh when 2 then case when qsize <= ssize then (ssize - qsize) // 2 else 0 end else 0 end as soff,
      case m when 1 then ssize - oh when 2 then case when qsize <= ssize then (ssize - qsize) // 2 + qsize else ssize end else al end as send
     from (select (l_orderkey % 2000)::integer as qid, (l_partkey % 2000)::integer as sid, l_discount::double as l_discount,
             (3100 + ((l_orderkey % 2000) * 7919) % 9000)::integer as qsize, (3100 + ((l_partkey % 2000) * 7919) % 9000)::integer as ssize,
             (2000 + (l_suppkey * 613 + l_linenumber * 97) % 1000)::integer as al, (floor(l_quantity)::integer % 12)::integer as oh, l_linenumber % 4 as m
           from lineitem) a
     where qid <> sid and m in ({shapes})) b)"""


def _location(err: int) -> str:
    qb, qe = f"case when qoff > {err} then 1 else 0 end", f"case when qend < qsize - {err} then -1 when qend > qsize + {err} then 1 else 0 end"
    sb, se = f"case when soff > {err} then 1 else 0 end", f"case when send < ssize - {err} then -1 when send > ssize + {err} then 1 else 0 end"
    return f"""(case
      when qdir = sdir and ({qb}) > 0 and ({qe}) = 0 and ({sb}) = 0 and ({se}) < 0 then 'Left'
      when qdir = sdir and ({qb}) = 0 and ({qe}) < 0 and ({sb}) > 0 and ({se}) = 0 then 'Right'
      when qdir <> sdir and ({qb}) = 0 and ({qe}) < 0 and ({sb}) = 0 and ({se}) < 0 then 'Left'
      when qdir <> sdir and ({qb}) > 0 and ({qe}) = 0 and ({sb}) > 0 and ({se}) = 0 then 'Right'
      when ({qb}) = 0 and ({qe}) = 0 and ({sb}) = 0 and ({se}) = 0 then 'Equal'
      when ({qb}) >= 0 and ({qe}) <= 0 and ({sb}) = 0 and ({se}) = 0 then 'Containing'
      when ({sb}) >= 0 and ({se}) <= 0 and ({qb}) = 0 and ({qe}) = 0 then 'Contained'
      else 'Abnormal' end)"""


ALEN = "(((qend - qoff) + (send - soff)) // 2)"
_ORDER = f"{ALEN} desc, ident desc, qid, sid, qoff, soff, qend, send, sdir, qdir"
_LAYOUTS = """layouts as (select *, qoff as a0, qsize - qend as a1, case when qdir = sdir then ssize - send else soff end as at0, case when qdir = sdir then soff else ssize - send end as at1 from olaps),
hangs as (select *, greatest(a0, at0) as h0, greatest(a1, at1) as h1, greatest(qoff, qsize - qend) as h2, greatest(soff, ssize - send) as h3 from layouts),
overhangs as (select *,
  (case least(h0, h1, h2, h3) when h0 then a0 when h1 then a1 when h2 then h2 else -1 end)::integer as q_hang,
  (case least(h0, h1, h2, h3) when h0 then at0 when h1 then at1 when h2 then -1 else h3 end)::integer as s_hang from hangs)"""


def _best(source: str, name: str) -> str:
    return f"{name} as (select * exclude (r) from (select *, row_number() over (partition by least(qid, sid), greatest(qid, sid) order by {_ORDER}) as r from {source}) where r = 1)"


def _snapped(source: str, name: str, reach: int) -> str:
    todo = f"({_location(0)} = 'Abnormal' and {_location(reach)} <> 'Abnormal')"
    r = reach
    return f"""{name} as (select qid, sid, ident, qdir,
      (case when not todo then qoff when qdir = sdir then case when qoff <= {r} then 0 when soff <= {r} then qoff - soff else qoff end
            else case when qoff <= {r} then 0 when ssize - send <= {r} then qoff - (ssize - send) else qoff end end)::integer as qoff,
      (case when not todo then qend when qdir = sdir then case when qsize - qend <= {r} then qsize when ssize - send <= {r} then qend + ssize - send else qend end
            else case when soff <= {r} and qsize - qend <= {r} then qsize when soff <= {r} then qend + soff when qsize - qend <= {r} then qsize else qend end end)::integer as qend,
      qsize, sdir,
      (case when not todo then soff when qdir = sdir then case when qoff <= {r} and soff <= {r} then 0 when qoff <= {r} then soff - qoff when soff <= {r} then 0 else soff end
            else case when soff <= {r} then 0 when qsize - qend <= {r} then soff - (qsize - qend) else soff end end)::integer as soff,
      (case when not todo then send when qdir = sdir then case when qsize - qend <= {r} and ssize - send <= {r} then ssize when qsize - qend <= {r} then send + qsize - qend when ssize - send <= {r} then ssize else send end
            else case when qoff <= {r} and ssize - send <= {r} then ssize when qoff <= {r} then send + qoff when ssize - send <= {r} then ssize else send end end)::integer as send,
      ssize from (select *, {todo} as todo from {source}))"""


def _by_read(source: str, name: str = "sides") -> str:
    return f"""{name} as (
      select *, qid as read, sid as other, qoff as a, qend as b, qsize as size_, soff as oa, send as ob, sdir as odir, qdir as dir_ from {source}
      union all select *, sid, qid, soff, send, ssize, qoff, qend, qdir, sdir from {source})"""


def _length_rows(percents: str, strict: bool) -> str:
    op = ">" if strict else ">="
    return f"""with {_reads()},
      ranked as (select len, row_number() over (order by len desc, read_id) as r, sum(len) over (order by len desc, read_id) as run, sum(len) over () as total from reads),
      marks as (select unnest([{percents}])::integer as percent)
      select percent, max(len)::integer as n_length, min(r)::bigint as l_count from ranked, marks where run * 100 {op} total * percent group by percent"""


def _kmers(source: str, step: int) -> str:
    return f"select read_id, len, pos, substr(seq, pos + 1, 13) as kmer from (select read_id, len, seq, unnest(range(0, len - 12, {step}))::integer as pos from {source})"


_INDEX = f"idx as (select kmer, read_id as sid, pos as soff, len as ssize from (select *, count(*) over (partition by kmer) as n from ({_kmers('reads', 10)})) where n <= 200)"
_SEEDS = f"seeds as (select p.read_id as qid, p.pos as qoff, i.sid, i.soff from idx i join ({_kmers('reads', 1)}) p using (kmer) where p.pos % 350 <= 137 and i.sid < p.read_id)"
_BLOCKS = """one as (select qid, sid, (soff // 2048)::bigint as block, least(count(distinct qoff), 80)::bigint as hits from seeds group by all),
blocks as (select qid, sid, block, hits, hits + case when lag(block) over w = block - 1 then lag(hits) over w else 0 end as score from one window w as (partition by qid, sid order by block))"""
_INTERVALS = "intervals as (select l_partkey as grp, l_orderkey % 5000 as lo, l_orderkey % 5000 + 100 + l_linenumber * 50 as hi from lineitem)"


def _merged(source: str, name: str, group: str = "grp", count: str = "count(*)") -> str:
    return f"""{name} as (select {group}, min(lo) as lo, max(hi) as hi, {count}::bigint as ct from (
      select *, sum(fresh) over (partition by {group} order by lo, hi rows unbounded preceding) as island from (
        select *, case when lo <= max(hi) over (partition by {group} order by lo, hi rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh
        from {source})) group by {group}, island)"""


def _depths(source: str, name: str, group: str = "grp") -> str:
    return f"""{name} as (select * from (select {group}, pos as lo, lead(pos) over (partition by {group} order by pos) as hi, sum(d) over (partition by {group} order by pos) as depth from (
      select {group}, pos, sum(d) as d from (select {group}, lo as pos, 1 as d from {source} union all select {group}, hi, -1 from {source}) group by all)) where depth > 0)"""


_READ_ROWS = f"""{_LAYOUTS}, rows_ as (
  select qid as read, qsize as len, ident, {ALEN} as alen, greatest(q_hang, s_hang) as oh from overhangs
  union all select sid, ssize, ident, {ALEN}, greatest(q_hang, s_hang) from overhangs)"""


def _weighted(value: str, weight: str, source: str) -> str:
    return f"""run as (select v, sum(w) over (order by v) as c, sum(w) over () as t from (select {value} as v, {weight} as w from {source})),
      med as (select min(v) as m from run where c >= t / 2.0),
      run2 as (select v, sum(w) over (order by v) as c, sum(w) over () as t from (select abs({value} - m) as v, {weight} as w from {source}, med)),
      mad as (select min(v) as d from run2 where c >= t / 2.0)"""


_STATS = f"""stats as (select read, max(len) as len, count(*) as n, round(sum(round(ident * 100)::bigint)::double / count(*) / 100, 6) as mean_ident, max(oh) as max_overhang from rows_ group by read)"""
_NORMAL = f"normal as (select * from olaps where ident > 70 and {_location(1000)} <> 'Abnormal')"
_COVERAGE = """cov_rows as (select qid as read, qsize as len, qoff as a, qend as b from {0} union all select sid, ssize, soff, send from {0}),
cov_events as (select read, len, pos, sum(d) as d from (select read, len, a as pos, 1 as d from cov_rows union all select read, len, b, -1 from cov_rows union all select read, len, 0, 0 from cov_rows) group by all),
cov as (select read, max(len)::integer as len, min(depth)::bigint as cov_min, max(depth)::bigint as cov_max from (select *, sum(d) over (partition by read order by pos) as depth from cov_events) where pos < len group by read)"""
_CONTAINED = f"""(select read, min(container)::integer as container from (
  select case loc when 'Contained' then qid when 'Containing' then sid when 'Equal' then greatest(qid, sid) end as read,
         case loc when 'Contained' then sid when 'Containing' then qid when 'Equal' then least(qid, sid) end as container
  from (select *, {_location(0)} as loc from {{0}})) where read is not null group by read)"""
_PROPER = f"{_overlaps('0, 1, 3')}, {_snapped('olaps', 'snapped', 11)}, {_best('snapped', 'pairs')}"
_ADMITTED = f"""{_PROPER}, contained as {_CONTAINED.format('pairs')},
free as (select * from pairs where qid not in (select read from contained) and sid not in (select read from contained)
  and qid <> sid and {_location(0)} in ('Left', 'Right') and ident >= 92.0 and least(qsize, ssize) >= 2500 and {ALEN} >= 2000),
{_best('free', 'admitted')}"""
_EDGES = f"""{_ADMITTED}, edge_list as (
  select case when qoff > 0 then -(qid + 1) else qid + 1 end as src,
         case when (qoff > 0) = (qdir = sdir) then -(sid + 1) else sid + 1 end as dst,
         sid as read, case when (qoff > 0) = (qdir = sdir) then send else soff end as start_, case when (qoff > 0) = (qdir = sdir) then ssize else 0 end as end_, {ALEN} as score, ident from admitted
  union all
  select case when (qoff > 0) = (qdir = sdir) then sid + 1 else -(sid + 1) end, case when qoff > 0 then qid + 1 else -(qid + 1) end,
         qid, case when qoff > 0 then qoff else qend end, case when qoff > 0 then 0 else qsize end, {ALEN}, ident from admitted),
edges as (select src::integer as src, dst::integer as dst, abs(end_ - start_)::integer as len, score::integer as score, ident, read::integer as read, start_::integer as "start", end_::integer as "end" from edge_list)"""
_BEST_EDGES = f"""{_EDGES},
best_out as (select src, dst from (select *, row_number() over (partition by src order by score desc, dst) as r from edges) where r = 1),
best_in as (select src, dst from (select *, row_number() over (partition by dst order by score desc, src) as r from edges) where r = 1),
best_marks as (select src, dst from best_out union select src, dst from best_in),
best_all as (select src, dst from best_marks union select -dst, -src from best_marks),
best as (select e.* from edges e join best_all using (src, dst))"""
_PATHS = f"""{_BEST_EDGES},
inner_ as (select node from (select src as node, 1 as o, 0 as i from best union all select dst, 0, 1 from best) group by node having sum(o) = 1 and sum(i) = 1),
heads as (select src, dst, len from best where src not in (select node from inner_)),
walk as (select src as fs, dst as fd, 0 as pos, src, dst, len from heads
  union all select w.fs, w.fd, w.pos + 1, b.src, b.dst, b.len from walk w join best b on b.src = w.dst where b.src in (select node from inner_)),
ring_edges as (select src, dst, len from best b where not exists (select 1 from walk w where w.src = b.src and w.dst = b.dst)),
ring_walk as (select src as fs, dst as fd, 0 as pos, src, dst, len from ring_edges
  union all select w.fs, w.fd, w.pos + 1, b.src, b.dst, b.len from ring_walk w join ring_edges b on b.src = w.dst where (b.src, b.dst) <> (w.fs, w.fd) and w.pos < 10000),
ring_firsts as (select fs, fd from ring_walk group by fs, fd having (fs, fd) = min((src, dst))),
paths as (select (fs || '~' || fd) as path, pos, src, dst, len from walk
  union all select (fs || '~' || fd), pos, src, dst, len from ring_walk where (fs, fd) in (select (fs, fd) from ring_firsts))"""
_SESSIONS = """rows_ as (select l_partkey % 50 as c0, l_suppkey % 10 as c1, l_orderkey % 50000 as pos from lineitem),
counted as (select c0, c1, pos, count(*) as n from rows_ group by all),
fresh as (select *, case when pos - lag(pos) over (partition by c0, c1 order by pos) <= 200 then 0 else 1 end as f from counted),
sessions as (select c0, c1, pos, n, sum(f) over (partition by c0, c1 order by pos)::bigint as session from fresh)"""
def _gaps(source: str) -> str:
    """Gaps between the two overlaps of a pair of reads that enough pairs show and few overlaps run across."""
    return f"""ranked as (select *, row_number() over (partition by qid, sid order by qoff, qend, soff, send) as r, count(*) over (partition by qid, sid) as n from {source}),
twins as (select x.qid as read, least(x.qend, y.qoff)::bigint as lo, (greatest(x.qend, y.qoff) + 1)::bigint as hi
  from ranked x join ranked y on x.qid = y.qid and x.sid = y.sid and x.r = 1 and y.r = 2 where x.n = 2
   and least(x.qend, y.qend) - greatest(x.qoff, y.qoff) <= 250 and least(x.send, y.send) - greatest(x.soff, y.soff) >= 250),
small as (select *, count(*) as votes from twins where hi - lo <= 4000 group by all), {_merged('small', 'merged', 'read', 'sum(votes)')}, {_by_read(source)},
across as (select m.read, m.lo, m.hi, count(*) as across from merged m join sides s on s.read = m.read and s.a < m.lo - 100 and s.b >= m.hi + 100 group by all),
gaps as (select read, lo, hi, ct from merged left join across using (read, lo, hi) where coalesce(across, 0) <= 9 and ct >= 3)"""


_TAGS = """flags as (select qid, sid, ident, qsize, qoff <= 200 and qsize - qend <= 200 as whole, qoff <= 200 as b, qsize - qend <= 200 as e, qdir <> sdir as t from olaps),
pair as (select qid, sid, max(qsize) as size, bool_or(whole) as whole, max(case when whole then ident end) as ident, bool_or(b and not whole) as b, bool_or(e and not whole) as e, bool_or(t) as rev, bool_or(not t) as fwd from flags group by all),
per_read as (select qid, max(size)::integer as size, count(*) filter (where whole) as nw, max(ident) as hi, min(ident) as lo, bool_or(b and e and not rev) as circ, bool_or(rev and fwd) as rcdup, bool_or(b or e) as ends from pair group by qid),
tags as (select qid as read, size, case when nw > 1 and hi - lo <= 8.0 then 'repeat' when nw > 0 then 'perfect' when circ then 'circular' when rcdup then 'rcdup' when not ends then 'unperfect' else 'normal' end as tag from per_read)"""

_P = "qid, sid, qoff, qend, soff, send"
_MAP = "(case when qdir = sdir then case when {0} < soff then qoff + ({0} - soff) when {0} < send then qoff + ((({0} - soff)::bigint * (qend - qoff)) // (send - soff)) else qend + ({0} - send) end else case when {0} > send then qoff - ({0} - send) when {0} > soff then qoff - ((({0} - send)::bigint * (qend - qoff)) // (send - soff)) else qend - ({0} - soff) end end)::bigint as p{0}"

ORACLES: dict[str, str] = {
    "reads_projection": f"with {_reads()} select read_id, len, md5(seq) as sum from reads",
    "read_length_nstats": _length_rows("10, 20, 30, 40, 50, 60, 70, 80, 90", False),
    "read_length_summary": f"""with {_reads()}, r as (select len, row_number() over (order by len desc) as k, count(*) over () as n from reads)
      select count(*)::bigint as reads, sum(len)::bigint as bases, max(len)::integer as longest, min(len)::integer as shortest, max(case when k = n // 2 + 1 then len end)::integer as median, (sum(len) // count(*))::bigint as mean from r""",
    "n50_strict": _length_rows("25, 50, 75", True),
    "ambig_runs": f"""with {_reads(BASES[:25] + 'N')} select read_id, len(regexp_extract_all(seq, '[^ACGT]+'))::integer as runs, length(regexp_replace(seq, '[ACGT]', '', 'g'))::integer as residues, true as valid from reads""",
    "longest_x_cutoff": f"""with {_reads()}, r as (select len, sum(len) over (order by len desc) as run from reads), c as (select coalesce(max(case when run >= 300000 then len end), 0)::integer as cutoff from r)
      select cutoff, count(*)::bigint as reads, sum(len)::bigint as bases from reads, c where len >= cutoff group by cutoff""",
    "longest_x_prefix": f"with {_reads()} select read_id, len from (select read_id, len, sum(len) over (order by len desc, read_id) - len as before from reads) where before < 300000",
    "volume_split": f"""with recursive {_reads()}, o as (select read_id, len, row_number() over (order by read_id) as r from reads),
      w as (select 1 as r, 1 as volume, read_id as first_read, 1::bigint as n, len::bigint as mass, len >= 100000 as full_ from o where r = 1
        union all select o.r, w.volume + w.full_::integer, case when w.full_ then o.read_id else w.first_read end, case when w.full_ then 1 else w.n + 1 end,
          case when w.full_ then o.len else w.mass + o.len end, case when w.full_ then o.len >= 100000 else w.mass + o.len >= 100000 or w.n + 1 >= 40 end
          from w join o on o.r = w.r + 1)
      select 0::integer as volume, min(read_id)::bigint as first_read, count(*)::bigint as reads, sum(len)::bigint as bases from reads
      union all select volume::integer, max(first_read)::bigint, max(n)::bigint, max(mass)::bigint from w group by volume""",
    "revcomp": f"with {_reads()} select read_id, md5(translate(reverse(seq), 'ACGT', 'TGCA')) as sum from reads",
    "kmer_spectrum": f"with {_reads()} select occ, count(*)::bigint as kmers from (select kmer, count(*)::bigint as occ from ({_kmers('reads', 1)}) group by kmer) group by occ",
    "kmer_capped_index": f"""with {_reads()}, {_INDEX} select kmer, count(*)::bigint as places, min(sid)::bigint as first_read,
      list_sum(list_transform(range(1, 14), lambda i: (strpos('ACGT', substr(kmer, i, 1)) - 1) * (4 ** (13 - i))::bigint))::bigint as code from idx group by kmer""",
    "seed_join": f"with {_reads()}, {_INDEX}, {_SEEDS} select qid, sid, count(*)::bigint as seeds, sum(qoff)::bigint as sum_qoff, sum(soff)::bigint as sum_soff from seeds group by qid, sid",
    "seed_blocks": f"with {_reads()}, {_INDEX}, {_SEEDS}, {_BLOCKS} select qid, sid, block, hits, score::bigint as score from blocks",
    "top_subjects": f"with {_reads()}, {_INDEX}, {_SEEDS}, {_BLOCKS} select qid, sid, score::bigint as score, r::integer as rank from (select *, row_number() over (partition by qid order by score desc, sid) as r from (select qid, sid, max(score) as score from blocks group by all having max(score) >= 3)) where r <= 3",
    "subject_window": f"""with {_overlaps()}, m as (select *, (soff + send) // 2 as s, (qoff + qend) // 2 as q from olaps), f as (select *, least(s, q) as l, least(ssize - s, qsize - q) as r from m)
      select qid, sid, qoff, soff, qsize, ssize, (case when ssize <= qsize + 2000 then 0 else greatest(0, s - l - least(l * 3 // 10, 2000)) end)::integer as sfrom,
        (case when ssize <= qsize + 2000 then ssize else least(ssize, s + r + least(r * 3 // 10, 2000)) end)::integer as sto from f""",
    "overlap_location": f"with {_overlaps()} select {_P}, {_location(0)} as exact, {_location(10)} as near from olaps",
    "overlap_location_other": f"""with {_overlaps()}, l as (select *, {_location(11)} as loc from olaps) select {_P},
      case when loc = 'Left' and qdir = sdir then 'Right' when loc = 'Right' and qdir = sdir then 'Left' when loc = 'Containing' then 'Contained' when loc = 'Contained' then 'Containing' else loc end as other,
      loc in ('Containing', 'Equal') as containing, loc in ('Contained', 'Equal') as contained, loc in ('Left', 'Right') as proper from l""",
    "overlap_overhang": f"with {_overlaps()}, {_LAYOUTS} select {_P}, q_hang, s_hang, {ALEN}::integer as alen from overhangs",
    "overlap_load_filter": f"with {_overlaps()} select * from olaps where ident >= 92 and qid <> sid and qsize between 2500 and 12000 and ssize between 2500 and 12000 and {ALEN} >= 2000 and {_location(10)} <> 'Abnormal'",
    "end_snap": f"with {_overlaps()}, {_snapped('olaps', 'snapped', 11)} select * from snapped",
    "coord_map": f"with {_overlaps()} select {_P}, {', '.join(_MAP.format(p) for p in (0, 2600, 9000))} from olaps",
    "symmetrize": f"""with {_overlaps()} select qid, sid, ident, (case when sdir = 1 then 1 - qdir else qdir end)::integer as qdir, qoff, qend, qsize, 0::integer as sdir, soff, send, ssize from
      (select * from olaps union all select sid, qid, ident, sdir, soff, send, ssize, qdir, qoff, qend, qsize from olaps)""",
    "partition_counts": f"with {_overlaps()} select (id // 100)::bigint as part, count(*)::bigint as records from (select sid as id from olaps union all select qid from olaps) group by part",
    "overlap_dedup": f"with {_overlaps()}, {_best('olaps', 'pairs')} select * from pairs",
    "overlap_coverage_test": f"with {_overlaps()} select {_P} from olaps where qend - qoff >= qsize * 0.6 or send - soff >= ssize * 0.6",
    "read_stats": f"""with {_overlaps()}, {_READ_ROWS} select read, max(len)::integer as len, count(*)::bigint as overlaps, round(sum(round(ident * 100)::bigint)::double / count(*) / 100, 6) as mean_ident,
      max(struct_pack(a := alen, i := ident)).i as best_ident, max(oh)::integer as max_overhang, sum(alen)::bigint as aligned from rows_ group by read""",
    "weighted_median_mad": f"with {_weighted('o_totalprice::double', 'o_custkey', 'orders')} select m::double as median, d::double as mad from med, mad",
    "median_mad": """with med as (select v as m from (select o_totalprice::double as v, row_number() over (order by o_totalprice) as r, count(*) over () as n from orders) where r = n // 2 + 1),
      mad as (select v as d from (select abs(o_totalprice::double - m) as v, row_number() over (order by abs(o_totalprice::double - m)) as r, count(*) over () as n from orders, med) where r = n // 2 + 1)
      select m::double as median, d::double as mad from med, mad""",
    "mean_deviation": """with o as (select round(o_totalprice)::hugeint as v, o_custkey::hugeint as w from orders), m as (select (sum(v * w) // sum(w))::hugeint as m from o)
      select max(m)::bigint as mean, round(sum(abs(v - m) * w)::double / sum(w)::double, 2) as deviation from o, m""",
    "auto_identity": f"with {_overlaps()}, {_NORMAL}, {_READ_ROWS.replace('from olaps', 'from normal')}, {_STATS}, {_weighted('mean_ident', 'len // 1000', 'stats')} select round(m - 6 * 1.4826 * d, 6)::double as min_identity from med, mad",
    "auto_overhang": f"with {_overlaps()}, {_NORMAL}, {_READ_ROWS.replace('from olaps', 'from normal')}, {_STATS}, {_weighted('max_overhang', 'len // 100', 'stats')} select floor(m + 6 * 1.4826 * d)::double as max_overhang from med, mad",
    "coverage_minmax": f"with {_overlaps()}, {_COVERAGE.format('olaps')} select * from cov",
    "coverage_percentile": "select " + ", ".join(f"(select min(v)::double from (select v, count(*) over (order by v) as c, count(*) over () as n from (select floor(l_quantity)::integer as v from lineitem)) where c * 100 >= n * {p}) as p{p}" for p in (1, 25, 50, 99)),
    "coverage_filter": f"with {_overlaps()}, {_COVERAGE.format('olaps')} select read, cov_min, cov_max from cov where cov_min < 4 or cov_max > 60 or cov_max - cov_min > 50",
    "support_filter": f"""with {_PROPER}, adj as (select distinct * from (select qid as read, sid as other, qoff <= 11 as at0, qsize - qend <= 11 as at1 from pairs union all select sid, qid, soff <= 11, ssize - send <= 11 from pairs)),
      common as (select p.qid, p.sid, count(*) filter (where a.at0) as q0, count(*) filter (where a.at1) as q1, count(*) filter (where b.at0) as s0, count(*) filter (where b.at1) as s1
        from pairs p join adj a on a.read = p.qid and a.other <> p.sid join adj b on b.read = p.sid and b.other = a.other group by p.qid, p.sid)
      select p.qid, p.sid from (select *, {_location(0)} as loc from pairs) p join common c using (qid, sid)
      where case when loc = 'Left' and qdir = sdir then q1 >= 2 and s0 >= 2 when loc = 'Right' and qdir = sdir then q0 >= 2 and s1 >= 2 when loc = 'Left' then q0 >= 2 and s0 >= 2 when loc = 'Right' then q1 >= 2 and s1 >= 2
        when loc = 'Containing' then s0 >= 2 and s1 >= 2 when loc = 'Contained' then q0 >= 2 and q1 >= 2 when loc = 'Equal' then q0 >= 2 and q1 >= 2 and s0 >= 2 and s1 >= 2 else false end""",
    "containment": f"with {_overlaps()} select * from {_CONTAINED.format('olaps')}",
    "bestn": f"""with {_PROPER}, l as (select *, {_location(0)} as loc, {ALEN} as alen from pairs), p as (select * from l where loc in ('Left', 'Right')),
      v as (select *, qid as read, loc as side from p union all select *, sid, case when qdir = sdir and loc = 'Left' then 'Right' when qdir = sdir then 'Left' else loc end from p)
      select distinct qid, sid from (select *, row_number() over (partition by read, side order by {_ORDER}) as r from v) where r <= 10""",
    "filter_report": f"""with {_overlaps()}, t as (select case when ident < 92 then 'identity' when least(qsize, ssize) < 2500 then 'length' when {ALEN} < 2500 then 'aligned' when {_location(10)} = 'Abnormal' then 'location' else 'kept' end as reason from olaps)
      select reason, count(*)::bigint as overlaps from t group by reason union all select 'total', count(*)::bigint from t""",
    "interval_merge": f"with {_INTERVALS}, {_merged('intervals', 'merged')} select * from merged",
    "interval_depth": f"with {_INTERVALS}, {_depths('intervals', 'd')} select grp, lo, hi, depth::bigint as depth from d",
    "interval_invert": f"""with {_INTERVALS}, {_merged('intervals', 'merged')}, i as (select *, row_number() over (partition by grp order by lo) as r, lead(lo) over (partition by grp order by lo) as nxt from merged where hi > 500 and lo < 4500)
      select grp, lo, hi from (select grp, 500::bigint as lo, lo as hi from i where r = 1 union all select grp, hi, coalesce(nxt, 4500) from i) where lo < hi""",
    "interval_intersect": f"""with {_INTERVALS}, e as (select * from intervals where lo % 2 = 0), o as (select * from intervals where lo % 2 = 1), {_merged('e', 'x')}, {_merged('o', 'y')}
      select x.grp, greatest(x.lo, y.lo) as lo, least(x.hi, y.hi) as hi from x join y on x.grp = y.grp and x.lo < y.hi and y.lo < x.hi""",
    "cover_range": f"""with {_overlaps()}, spans as (select qid as read, qoff::bigint as lo, qend::bigint as hi from olaps union all select sid, soff, send from olaps), {_depths('spans', 'd', 'read')},
      deep0 as (select read, lo, hi from d where depth >= 2), {_merged('deep0', 'deep', 'read')}, {_merged('spans', 'chained', 'read')},
      common as (select x.read, greatest(x.lo, y.lo) as lo, least(x.hi, y.hi) as hi from deep x join chained y on x.read = y.read and x.lo < y.hi and y.lo < x.hi)
      select read, lo as "left", hi as "right", hi - lo as size from (select *, row_number() over (partition by read order by hi - lo desc, lo) as r from common) where r = 1 and hi - lo >= 1000""",
    "clip_adjust": f"""with {_overlaps()}, x as (select *, qid % 40 as ql, 3100 + (qid * 7919) % 9000 - qid % 60 as qr, sid % 40 as sl, 3100 + (sid * 7919) % 9000 - sid % 60 as sr from olaps),
      c as (select *, greatest(ql - qoff, 0) as h, greatest(qend - qr, 0) as t, greatest(sl - soff, 0) as sh, greatest(send - sr, 0) as st, qend - qoff as qw, send - soff as sw from x),
      n as (select *, (qoff + greatest(h, round((case when qdir = sdir then sh else st end) * qw::double / sw)))::integer as q1, (qend - greatest(t, round((case when qdir = sdir then st else sh end) * qw::double / sw)))::integer as q2,
        (soff + greatest(sh, round((case when qdir = sdir then h else t end) * sw::double / qw)))::integer as s1, (send - greatest(st, round((case when qdir = sdir then t else h end) * sw::double / qw)))::integer as s2 from c)
      select qid, sid, ident, qdir, (case when q1 - ql < 15 then ql else q1 end)::integer as qoff, (case when qr - q2 < 15 then qr else q2 end)::integer as qend, qsize, sdir,
        (case when s1 - sl < 15 then sl else s1 end)::integer as soff, (case when sr - s2 < 15 then sr else s2 end)::integer as send, ssize from n where q1 < q2 and s1 < s2""",
    "top300": f"""with {_overlaps()}, {_by_read('olaps')}, r as (select *, {ALEN} as alen, row_number() over (partition by read order by ident desc, {ALEN} desc, other, a, b, oa, ob, odir, dir_) as k from sides)
      select read, count(*)::bigint as kept, min(ident) as worst, sum(alen)::bigint as aligned from r where k <= 300 group by read""",
    "cns_candidates60": f"""with {_overlaps()}, m as (select qid, sid, (qoff + qend) // 2 as q, (soff + send) // 2 as s, {ALEN} // 100 as score from olaps),
      r as (select *, row_number() over (partition by sid order by score desc, qid, q, s) as k, count(*) over (partition by sid) as n from m)
      select sid, count(*)::bigint as kept, min(score)::integer as worst, sum(qid)::bigint as sum_qid from r where n >= 4 and k <= 60 group by sid""",
    "coverage_runs": f"""with {_INTERVALS}, {_depths('intervals', 'd')}, deep as (select grp, lo, hi from d where depth >= 3), {_merged('deep', 'runs')}
      select grp, lo, hi, hi - lo as size from (select *, row_number() over (partition by grp order by hi - lo desc, lo) as r from runs) where r = 1 and hi - lo >= 50""",
    "edge_admission": f"with {_ADMITTED} select {_P} from admitted",
    "graph_edges": f"""with {_EDGES} select *, lpad((abs(src) - 1)::varchar, 9, '0') || case when src > 0 then ':B' else ':E' end as src_name, lpad((abs(dst) - 1)::varchar, 9, '0') || case when dst > 0 then ':B' else ':E' end as dst_name from edges""",
    "transitive_reduce": f"""with {_EDGES}, most as (select src, max(len) as most from edges group by src), shortest as (select src, dst from (select *, row_number() over (partition by src order by len, dst) as r from edges) where r = 1),
      found as (select distinct e.src, e.dst from edges e join edges f on f.src = e.src join edges g on g.src = f.dst and g.dst = e.dst join most m on m.src = e.src left join shortest s on s.src = f.dst
        where f.len + g.len < m.most + 500 or s.dst = e.dst or g.len < 500)
      select src, dst from found union select (-dst)::integer, (-src)::integer from found""",
    "best_edges": f"with {_BEST_EDGES} select src, dst, len, score from best",
    "simple_paths": f"with recursive {_PATHS} select path, max(case when pos = 0 then src end)::integer as first, arg_max(dst, pos)::integer as last, count(*)::bigint as edges, sum(len)::bigint as bases from paths group by path",
    "repeat_bridge": f"""with {_BEST_EDGES}, deg as (select node, sum(o) as o, sum(i) as i from (select src as node, 1 as o, 0 as i from best union all select dst, 0, 1 from best) group by node)
      select src, dst, len from best where len < 60000 and src in (select node from deg where i = 1 and o = 2) and dst in (select node from deg where i = 2 and o = 1)""",
    "contig_spell": f"""with recursive {_PATHS}, made as (select i::integer as read_id, substr(repeat(translate(md5(i::varchar), '0123456789abcdef', 'ACGTACGTACGTACGT'), 400), 1, (3100 + (i * 7919) % 9000)::integer) as seq from range(2000) t(i)),
      pieces as (select p.path, p.pos + 1 as pos, case when e."start" <= e."end" then substr(m.seq, e."start" + 1, e."end" - e."start") else translate(reverse(substr(m.seq, e."end" + 1, e."start" - e."end")), 'ACGT', 'TGCA') end as piece
          from paths p join best e using (src, dst) join made m on m.read_id = e.read
        union all select p.path, 0, case when p.src < 0 then m.seq else translate(reverse(m.seq), 'ACGT', 'TGCA') end from paths p join made m on m.read_id = abs(p.src) - 1 where p.pos = 0)
      select path, length(string_agg(piece, '' order by pos))::integer as len, md5(string_agg(piece, '' order by pos)) as sum from pieces group by path""",
    "ctg_pairs": f"with {_overlaps()}, h as (select distinct sid % 20 as contig, qid as read from olaps) select x.contig::integer as c0, y.contig::integer as c1, count(*)::bigint as reads from h x join h y on x.read = y.read and x.contig < y.contig group by all having count(*) >= 3",
    "link_sessions": f"with {_SESSIONS} select c0, c1, session, sum(n)::bigint as links, min(pos) as first, max(pos) as last from sessions group by c0, c1, session",
    "best_link": f"""with {_SESSIONS}, z as (select c0, c1, session, sum(n)::bigint as links, min(pos) as first, max(pos) as last from sessions group by c0, c1, session)
      select c0, c1, session, links, first, last from (select *, row_number() over (partition by c0, c1 order by links desc, session) as r from z) where r = 1""",
    "session_3sigma": f"""with {_SESSIONS}, m as (select c0, c1, session, (sum(n * pos) // sum(n))::bigint as mean from sessions group by all),
      d as (select s.c0, s.c1, s.session, any_value(mean) as mean, floor(sqrt(sum(n * (pos - mean) * (pos - mean))::double / sum(n)))::bigint as sd from sessions s join m using (c0, c1, session) group by all)
      select s.c0, s.c1, s.session, sum(n)::bigint as links, max(mean) as mean, max(sd) as sd from sessions s join d using (c0, c1, session) where abs(pos - mean) <= 3 * sd group by all""",
    "overlap_compare": f"""with {_overlaps()}, le as (select * from olaps where qoff % 5 <> 0), ri as (select * from olaps where ident >= 94), {_best('le', 'l')}, {_best('ri', 'r')},
      a as (select least(qid, sid) as low, greatest(qid, sid) as high, case when qid < sid then qoff else soff end as a, case when qid < sid then qend else send end as b, case when qid < sid then soff else qoff end as c, case when qid < sid then send else qend end as d from l),
      z as (select least(qid, sid) as low, greatest(qid, sid) as high, case when qid < sid then qoff else soff end as a, case when qid < sid then qend else send end as b, case when qid < sid then soff else qoff end as c, case when qid < sid then send else qend end as d from r)
      select low, high, case when a.a is null then 'only_right' when z.a is null then 'only_left' when abs(a.a - z.a) <= 250 and abs(a.b - z.b) <= 250 and abs(a.c - z.c) <= 250 and abs(a.d - z.d) <= 250 then 'similar' else 'not_similar' end as kind from a full join z using (low, high)""",
    "seq_tags": f"with {_overlaps()}, {_TAGS} select * from tags",
    "tag_report": f"""with {_overlaps()}, {_TAGS} select coalesce(tag, 'total') as tag, count(*)::bigint as sequences, sum(size)::bigint as residues, round(sum(size) * 100 / (select sum(size) from tags)::double, 4) as percent from tags group by rollup(tag)""",
    "subread_filter": """select * from (select event_id as subread_id, user_id as zm, floor(value * 10)::integer as ln, (500 + event_id % 500)::integer as rq, (event_id % 500)::integer as qs, (event_id % 4)::integer as bc1, (event_id % 3)::integer as bc2, (event_id % 100)::integer as bq, (1 + event_id % 9)::integer as np from events)
      where ln >= 500 and rq >= 750 and (np > 3 or bc1 = 2)""",
    "subread_regions": """with r as (select user_id as hole, (event_id % 500)::integer as lo, (event_id % 500 + floor(value * 10))::integer as hi from events), g as (select distinct hole, 300 as lo, (400 + hole % 300)::integer as hi from r)
      select r.hole, greatest(r.lo, g.lo)::integer as lo, least(r.hi, g.hi)::integer as hi from r join g using (hole) where r.lo < g.hi and g.lo < r.hi""",
    "name_ids": "select (row_number() over (order by name) - 1)::bigint as id, name from (select distinct source || '/' || lang as name from documents)",
    "trim_reads": f"with {_reads()} select row_number() over (order by read_id)::bigint as read_id, read_id as old_id, md5(substr(seq, (read_id % 7 + 1)::integer, (len - read_id % 5 - read_id % 7)::integer)) as sum from reads where read_id % 7 < len - read_id % 5",
    "common_neighbours": f"""with {_overlaps()}, {_best('olaps', 'pairs')}, adj as (select distinct qid as read, sid as other from olaps union select sid, qid from olaps)
      select p.qid, p.sid, count(*)::bigint as common from pairs p join adj a on a.read = p.qid and a.other <> p.sid join adj b on b.read = p.sid and b.other = a.other group by p.qid, p.sid""",
    "concat_subjects": f"""with {_reads()}, s as (select (read_id // 100)::bigint as bucket, md5(string_agg(seq, '' order by read_id)) as sum, sum(len)::bigint as bases from reads group by 1)
      select bucket, sum, bases, (sum(bases) over (order by bucket) - bases)::bigint as offset from s""",
    "partial_scan": f"with {_reads()}, {_overlaps()} select read_id, len from reads where read_id in (select qid from olaps where ident >= 99)",
    "residue_counts": f"with {_reads()} select base, sum(len(seq) - len(replace(seq, base, '')))::bigint as n from reads, (select unnest(['A', 'C', 'G', 'T']) as base) group by base",
    "evalues": f"""with {_overlaps()}, b as (select *, (0.267::double * ({ALEN} / 100.0::double) - ln(0.041::double)) / ln(2.0::double) as bits from olaps)
      select {_P}, round(bits, 4) as bits, round(qsize::bigint * ssize * pow(2.0::double, -bits), 4) as evalue from b""",
    "two_hop": f"""with {_BEST_EDGES} select src, count(*)::bigint as reached from (select src, dst from best union select a.src, b.dst from best a join best b on b.src = a.dst) group by src""",
    "m4_roundtrip": f"with {_overlaps()} select * from olaps",
    "paf_parse": f"""with {_overlaps()}, b as (select *, greatest(qend - qoff, send - soff) as block from olaps)
      select qid::varchar as qid, sid::varchar as sid, round(100.0::double * round(block * ident / 100)::integer / block, 4) as ident, (-block)::integer as score, 0::integer as qdir, qoff, qend, qsize, sdir, soff, send, ssize from b""",
}


def _materialized(sql: str) -> str:
    """The same SQL with its parts evaluated once each; several steps of a graph read the same edges."""
    return re.sub(r"(\b\w+) as \((?=select)", r"\1 as materialized (", sql)


ORACLES["best_edges"] = _materialized(ORACLES["best_edges"])
