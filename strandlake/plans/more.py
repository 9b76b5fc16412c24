"""Further queries, each with its SQL beside it: scans and sinks, candidate rules, effective ranges, limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import ids, olfilter, quantiles, seedgrid
from ..operators import overlap as ov
from ..operators import reads as rd
from ..sources import formats
from ..sources import projections as pr
from .oracles import _LAYOUTS, ALEN, _kmers, _location, _overlaps, _reads
from .stages import Stages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K, LEAST_SEEDS = 13, 3
_VIEWS = f"""views as (select qid as read, sid as other, qoff as lo, qend as hi, qsize as len, ident, {ALEN} as alen from olaps
  union all select sid, qid, soff, send, ssize, ident, {ALEN} from olaps)"""


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _views(s, d):
    o = pr.overlaps(s, d).withColumn("alen", ov.aligned_length())
    return ov.by_read(o).select("read", "other", F.col("start").alias("lo"), F.col("end").alias("hi"), "len", "ident", "alen")


@query(f"with {_overlaps()}, {_VIEWS} select count(*)::bigint as reads, sum(len)::bigint as bases, (sum(len) // count(*))::bigint as mean from (select read, max(len)::bigint as len from views group by read)")
def overlap_totals(s, d):
    """Number and lengths of the reads that overlaps name."""
    each = _views(s, d).groupBy("read").agg(F.max("len").cast("long").alias("len"))
    return each.agg(F.count("*").alias("reads"), F.sum("len").alias("bases"), F.floor(F.sum("len") / F.count("*")).cast("long").alias("mean"))


@query(f"""with {_overlaps()}, {_VIEWS}, v as (select distinct read, lo, hi, len from views),
w as (select read, bool_or(lo <= 500 and hi >= len - 500) as whole, max(len) as len from v group by read),
free as (select * from (select *, max(hi) over (partition by read order by lo, hi desc rows between unbounded preceding and 1 preceding) as before from v) where before is null or hi > before),
cuts as (select *, case when lag(hi) over (partition by read order by lo) - lo < 1000 then 1 else 0 end as cut from free),
runs as (select read, run, min(lo) as lo, max(hi) as hi from (select *, sum(cut) over (partition by read order by lo rows unbounded preceding) as run from cuts) group by read, run)
select read, 0 as lo, len as hi from w where whole union all select r.read, r.lo, r.hi from runs r join w using (read) where not whole and r.hi - r.lo >= 1900""")  # fmt: skip
def effective_ranges(s, d):
    """Parts of each read that consensus may use: the whole where an alignment nearly spans it, else runs of alignments
    that share 1000 bases with the one before, contained ones left out, of at least 1900 bases."""
    v = _views(s, d).select("read", "lo", "hi", "len").distinct()
    spans = v.groupBy("read").agg(F.max((F.col("lo") <= 500) & (F.col("hi") >= F.col("len") - 500)).alias("whole"), F.max("len").alias("len"))
    upto = Window.partitionBy("read").orderBy("lo", F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1)
    free = v.withColumn("before", F.max("hi").over(upto)).where("before is null or hi > before")
    w = Window.partitionBy("read").orderBy("lo")
    cut = F.coalesce(F.lag("hi").over(w) - F.col("lo") < 1000, F.lit(False)).cast("int")
    runs = free.withColumn("cut", cut).withColumn("run", F.sum("cut").over(w)).groupBy("read", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    parts = runs.join(spans.where("not whole").select("read"), "read").where("hi - lo >= 1900").select("read", "lo", "hi")
    return spans.where("whole").select("read", F.lit(0).alias("lo"), F.col("len").alias("hi")).union(parts)


@query(f"with {_overlaps()}, {_VIEWS} select read, other, lo, hi, alen::integer as alen, ident from (select *, row_number() over (partition by read, other order by alen desc, ident desc, lo, hi) as r from views) where r = 1")
def keep_better(s, d):
    """Each read's best overlap with each other read."""
    rank = F.row_number().over(Window.partitionBy("read", "other").orderBy(F.desc("alen"), F.desc("ident"), "lo", "hi"))
    return _views(s, d).withColumn("r", rank).where("r = 1").select("read", "other", "lo", "hi", "alen", "ident")


_TRIED = f"tried as (select * from (select *, {ALEN} as alen, row_number() over (partition by qid, sid order by {ALEN} desc, ident desc, qoff, soff, qend, send, sdir) as r from olaps) where r <= 3)"


@query(f"""with {_overlaps()}, {_TRIED},
free as (select a.* from tried a where not exists (select 1 from tried b where b.qid = a.qid and b.sid = a.sid and b.sdir = a.sdir and b.r < a.r
  and b.qoff <= a.qoff + 200 and b.qend >= a.qend - 200 and b.soff <= a.soff + 200 and b.send >= a.send - 200))
select qid, sid, qoff, qend, soff, send, sdir from (select *, row_number() over (partition by qid, sid order by r) as k from free) where k <= 2""")
def hits_per_subject(s, d):
    """At most two alignments of a query with a subject, of three tried, none inside a better one on the same strand."""
    key = ["qid", "sid", "sdir"]
    rank = F.row_number().over(Window.partitionBy("qid", "sid").orderBy(F.desc(ov.aligned_length()), F.desc("ident"), "qoff", "soff", "qend", "send", "sdir"))
    tried = Stages(s, "hits").keep(pr.overlaps(s, d).withColumn("r", rank).where("r <= 3"), "tried")
    better = tried.select(*key, *[F.col(c).alias(f"b_{c}") for c in ("r", "qoff", "qend", "soff", "send")])
    inside = tried.join(better, key).where("b_r < r and b_qoff <= qoff + 200 and b_qend >= qend - 200 and b_soff <= soff + 200 and b_send >= send - 200").select("qid", "sid", "r").distinct()
    k = F.row_number().over(Window.partitionBy("qid", "sid").orderBy("r"))
    return tried.join(inside, ["qid", "sid", "r"], "left_anti").withColumn("k", k).where("k <= 2").select("qid", "sid", "qoff", "qend", "soff", "send", "sdir")


@query(f"""with {_reads()}, c as (select kmer, count(*) as n from ({_kmers('reads', 10)}) group by kmer),
h as (select n, count(*) as k from c group by n), over_ as (select n, k, sum(k) over (order by n desc) - k as above, sum(k) over () as total from h),
cut as (select min(n) as most from over_ where above * 1000 <= total)
select most::bigint as most, sum(k)::bigint as kmers, sum(k * n)::bigint as places from h, cut where n <= most group by most""")
def repeat_cutoff(s, d):
    """The count over which at most a thousandth of the distinct k-mers lies, and what stays under it."""
    hist = rd.kmers(pr.reads(s, d), K, 10).groupBy("kmer").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    hist = Stages(s, "repeats").keep(hist, "histogram")  # a row a count
    above = F.sum("k").over(Window.orderBy(F.desc("n"))) - F.col("k")
    total = hist.agg(F.sum("k")).first()[0] or 0
    most = hist.withColumn("above", above).where(F.col("above") * 1000 <= total).agg(F.min("n").alias("most"))
    return hist.join(F.broadcast(most), F.col("n") <= F.col("most")).groupBy("most").agg(F.sum("k").alias("kmers"), F.sum(F.col("k") * F.col("n")).alias("places"))


@query(f"with {_overlaps()}, {_VIEWS} select n.other as neighbour from (select distinct other from views where read = 17) n join (select distinct other from views where read = 42) m using (other)")
def named_pair(s, d):
    """Reads that overlap both of two named reads."""
    of = lambda read: _views(s, d).where(F.col("read") == read).select(F.col("other").alias("neighbour")).distinct()
    return of(17).join(of(42), "neighbour")


@query(f"with {_overlaps()}, {_VIEWS} select other, lo, hi, alen::integer as alen, ident from views where read = 17")
def read_view(s, d):
    """All overlaps of one named read, from its side."""
    return _views(s, d).where("read = 17").select("other", "lo", "hi", "alen", "ident")


@query(f"""with {_reads()} select read_id, md5(case when read_id % 2 = 1 then translate(reverse(part), 'ACGT', 'TGCA') else part end) as sum
from (select read_id, substr(seq, (len // 4)::integer + 1, (len // 2)::integer) as part from reads)""")
def slice_by_strand(s, d):
    """The middle half of every read, of the other strand for odd ids."""
    quarter = F.floor(F.col("len") / 4).cast("int")
    part = sq.slice_strand(F.col("seq"), quarter, quarter + F.floor(F.col("len") / 2).cast("int"), F.col("read_id") % 2)
    return pr.reads(s, d).select("read_id", F.md5(part).alias("sum"))


@query("""with t as (select o_orderkey as id, floor(o_totalprice)::bigint as n, case o_orderkey % 4 when 0 then '' when 1 then 'k' when 2 then 'm' else 'g' end as unit from orders)
select id, format('{:,}', n) as commas, lpad((id % 100000000)::varchar, 8, '0') as fixed, (id % 1000)::bigint * case unit when '' then 1 when 'k' then 1024 when 'm' then 1048576 else 1073741824 end as size from t""")
def size_formats(s, d):
    """Numbers with thousands commas, ids of fixed width, and sizes such as 4g parsed to bytes."""
    key = F.col("o_orderkey")
    text = F.concat((key % 1000).cast("string"), F.element_at(F.array(*map(F.lit, ("", "k", "m", "g"))), (key % 4 + 1).cast("int")))
    return pr.table(s, d, "orders").select(key.alias("id"), F.format_number(F.floor("o_totalprice"), 0).alias("commas"), F.lpad((key % 100000000).cast("string"), 8, "0").alias("fixed"), sq.parsed_size(text).alias("size"))


@query(f"with {_reads()}, r as (select len, sum(len) over (order by len desc) as run from reads) select coalesce(max(case when run >= 300000 then len end), 2500)::integer as min_length from r")
def auto_min_length(s, d):
    """The length limit: the cutoff of the longest reads that make up a goal, 2500 where they do not."""
    hist = rd.length_histogram(pr.reads(s, d))
    return hist.agg(F.coalesce(F.max(F.when(F.col("mass_upto") >= 300_000, F.col("len"))), F.lit(2500)).cast("int").alias("min_length"))


_MEDIAN = "list_sort(list({0}))[count(*) // 2 + 1]"


@query(f"""with {_overlaps()}, {_LAYOUTS}, fine as (select ident, greatest(q_hang, s_hang) as hang from overhangs where ident >= 75 and {ALEN} >= 2000 and {_location(500)} <> 'Abnormal'),
m as (select {_MEDIAN.format('ident')} as mi, {_MEDIAN.format('hang')} as mh from fine),
dev as (select {_MEDIAN.format('abs(ident - mi)')} as di, {_MEDIAN.format('abs(hang - mh)')} as dh from fine, m)
select round(mi - 3 * 1.4826 * di, 6)::double as min_identity, floor(mh + 3 * 1.4826 * dh)::double as max_overhang from m, dev""")
def bridge_limits(s, d):
    """Limits of overlaps between reads and contigs: medians less and plus three robust deviations."""
    fine = pr.overlaps(s, d).where((F.col("ident") >= 75) & (ov.aligned_length() >= 2000) & (ov.location(500) != "Abnormal"))
    fine = Stages(s, "bridge").keep(fine.select("ident", F.greatest(*ov.overhangs()).alias("hang")), "fine")
    mi, di = quantiles.upper_median_mad(fine, F.col("ident"))
    mh, dh = quantiles.upper_median_mad(fine, F.col("hang"))
    return s.createDataFrame([(round(mi - 3 * olfilter.MAD * di, 6), float(np.floor(mh + 3 * olfilter.MAD * dh)))], "min_identity double, max_overhang double")


_GOOD, _PLAIN = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv-", "ACGTUacgtu"


@query(f"""with t as (select doc_id, regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]', '', 'g') as x from documents),
c as (select doc_id, length(regexp_replace(x, '[^{_GOOD}]', '', 'g'))::integer as good, length(regexp_replace(x, '[{_GOOD}]', '', 'g'))::integer as bad, length(regexp_replace(regexp_replace(x, '[^{_GOOD}]', '', 'g'), '[{_PLAIN}]', '', 'g'))::integer as ambiguous from t)
select *, 3 * bad >= good as rejected, 10 * ambiguous > 4 * good as warned from c""")
def plausible_lines(s, d):
    """Whether texts can be sequences: letters that are residues, others, and ambiguous ones."""
    x = F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\r\\n]", "")
    t = pr.table(s, d, "documents").select("doc_id", x.alias("x"))
    of = lambda pattern: F.length(F.regexp_replace("x", pattern, ""))
    c = t.select("doc_id", of(f"[^{_GOOD}]").alias("good"), of(f"[{_GOOD}]").alias("bad"), F.length(F.regexp_replace(F.regexp_replace("x", f"[^{_GOOD}]", ""), f"[{_PLAIN}]", "")).alias("ambiguous"))
    return c.withColumns({"rejected": 3 * F.col("bad") >= F.col("good"), "warned": 10 * F.col("ambiguous") > 4 * F.col("good")})


@query(f"with {_reads()} select symbol, count(*)::bigint as n from (select unnest(string_split(md5(seq), '')) as symbol from reads) where symbol <> '' group by symbol")
def symbol_histogram(s, d):
    """How often each symbol of the reads' quality streams (here sums of their bases) occurs."""
    return pr.reads(s, d).select(F.explode(F.split(F.md5("seq"), "")).alias("symbol")).where("symbol <> ''").groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"with {_reads()} select read_id, ((len + 3) // 4)::integer as bytes, md5(seq) as sum from reads")
def two_bit_roundtrip(s, d):
    """Reads packed to two bits a base and unpacked again."""
    packed = pr.reads(s, d).select("read_id", "seq").mapInArrow(formats.pack_bases, "read_id long, len long, packed binary")
    return packed.mapInArrow(formats.unpack_bases, "read_id long, bytes int, seq string").select("read_id", "bytes", F.md5("seq").alias("sum"))


@query(f"""with {_overlaps()}, c as (select qid, sid, sdir, qsize, (qoff + qend) // 2 as q, (soff + send) // 2 as s, {ALEN} // 100 as score from olaps)
select concat_ws(chr(9), qid, sid, 1 - sdir, score, case when sdir = 1 then qsize - 1 - q else q end, s) as line from c""")
def seqid_lines(s, d):
    """Candidates as text: 1 for forward queries, offsets of turned ones from the other end."""
    q, at = F.expr("(qoff + qend) div 2"), F.expr("(soff + send) div 2")
    fields = ["qid", "sid", 1 - F.col("sdir"), F.floor(ov.aligned_length() / 100), F.when(F.col("sdir") == 1, F.col("qsize") - 1 - q).otherwise(q), at]
    return pr.overlaps(s, d).select(F.concat_ws("\t", *[(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]).alias("line"))


@query(f"with {_reads()} select md5('>read_' || read_id || chr(10) || seq) as sum from reads")
def fasta_records(s, d):
    """Reads as FASTA records."""
    return formats.fasta_lines(pr.reads(s, d), F.concat(F.lit("read_"), F.col("read_id").cast("string"))).select(F.md5("value").alias("sum"))


@query(f"""with {_overlaps()}, t as (select qid, sid, case when ident < 92 then 'identity' when least(qsize, ssize) < 2500 then 'length' when {ALEN} < 2500 then 'aligned' when {_location(10)} = 'Abnormal' then 'location' end as reason from olaps)
select concat_ws(chr(9), qid, sid, reason) as line from t where reason is not null""")
def filter_audit(s, d):
    """Dropped overlaps as text, with the first reason that drops them."""
    reason = F.when(F.col("ident") < 92, "identity").when(F.least("qsize", "ssize") < 2500, "length").when(ov.aligned_length() < 2500, "aligned").when(ov.location(10) == "Abnormal", "location")
    rows = pr.overlaps(s, d).withColumn("reason", reason).where("reason is not null")
    return rows.select(F.concat_ws("\t", F.col("qid").cast("string"), F.col("sid").cast("string"), "reason").alias("line"))


@query(f"with {_reads()} select read_id, len, (sum(len) over (order by read_id) - len)::bigint as start from reads")
def concat_offsets(s, d):
    """Where each read starts in the concatenation of all reads by id."""
    return ids.running_starts(pr.reads(s, d).select("read_id", "len"), "read_id", "len", "start")


@query(f"with {_overlaps()} select * from olaps")
def binary_records(s, d):
    """Overlaps as binary records of fixed width, and read again."""
    types = "qid int, sid int, ident double, qdir int, qoff int, qend int, qsize int, sdir int, soff int, send int, ssize int"
    return pr.overlaps(s, d).mapInArrow(formats.to_records, "records binary").mapInArrow(formats.from_records, types)


@query(f"with {_overlaps()} select qid, sid, ident, qdir, qoff, qend, qsize, sdir, soff, send, ssize, (-{ALEN})::integer as score from olaps")
def m4_scan(s, d):
    """M4 lines with ids from 1 and turned queries: ids from 0, the query forward, the score from the lengths."""
    turned = pr.overlaps(s, d).withColumns({"qid": F.col("qid") + 1, "sid": F.col("sid") + 1, "qdir": 1 - F.col("qdir"), "sdir": 1 - F.col("sdir"), "score": F.lit(0)})
    return formats.normalized_m4(formats.parse_m4(formats.m4_lines(turned)))


@query(f"""with {_reads()}, both_ as (select read_id * 2 as read_id, seq, len from reads union all select read_id * 2 + 1, translate(reverse(seq), 'ACGT', 'TGCA'), len from reads),
idx as (select kmer, read_id as sid, pos as soff from (select *, count(*) over (partition by kmer) as n from ({_kmers('reads', 10)})) where n <= 200),
hits as (select p.read_id as qid, p.pos as qoff, i.sid, i.soff from idx i join ({_kmers('both_', 1)}) p using (kmer) where i.sid < p.read_id // 2),
few as (select qid, sid, soff, count(*) as n from hits group by all having count(*) <= 3),
blocks as (select qid, sid, soff // 2048 as block, sum(n) as hits from few group by all having sum(n) > {LEAST_SEEDS}),
scored as (select *, hits + case when hits < 20 and lag(block) over w = block - 1 then lag(hits) over w else 0 end as score from blocks window w as (partition by qid, sid order by block))
select (qid // 2)::bigint as qid, (qid % 2)::integer as qdir, sid, block::bigint as block, hits::bigint as hits, score::bigint as score from scored where score >= {2 * LEAST_SEEDS}""")
def strand_blocks(s, d):
    """Blocks of seeds of queries on both strands that qualify as candidates."""
    found = seedgrid.strand_pair_blocks(pr.reads(s, d), K, LEAST_SEEDS)
    return found.select(F.floor(F.col("qid") / 2).alias("qid"), (F.col("qid") % 2).cast("int").alias("qdir"), "sid", "block", "hits", "score")
