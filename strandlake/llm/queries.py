"""Queries of the training-data operators; each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document in shard files with Elias-Fano boundaries, read back from them."""
    import public_tokenizers

    from .token_store import tokenized

    return tokenized(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


QUERIES = {"op3_token_store": op3_token_store}
ORACLES: dict[str, str] = {}


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    from .packing import pack

    packed = pack(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES["op7_best_fit_packing"] = op7_best_fit_packing


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on four-word shingles."""
    from .near_dup import near_duplicates

    return near_duplicates(spark, _read(spark, sf_dir, "documents"), width=4)


QUERIES["op9_circulant_minhash"] = op9_circulant_minhash


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    from .toxicity import toxicity

    return toxicity(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES["op5_toxicity"] = op5_toxicity


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents and which a draw of the target's size keeps."""
    from .quality import importance_resample

    return importance_resample(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES["op6_importance_resampling"] = op6_importance_resampling


def op4_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage like a benchmark item, and which."""
    from .decontaminate import contaminated

    return contaminated(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES["op4_simhash_decontamination"] = op4_simhash_decontamination


def op1_metric_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    from .metric_search import top_k

    return top_k(spark, _read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


QUERIES["op1_metric_tree_search"] = op1_metric_tree_search
ORACLES["op1_metric_tree_search"] = """
with fine as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v)::bigint as score
  from fine q join fine c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored)
select query_id, r::integer as rank, vec_id, score from ranked where r <= 5
"""


def op10_maximum_subsequence_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html_main import extract

    return extract(spark, _read(spark, sf_dir, "pages"))


QUERIES["op10_maximum_subsequence_html"] = op10_maximum_subsequence_html


#: Tools of the conversations' calls: field to (type, required).
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", True), "exact": ("boolean", False)},
    "lookup": {"key": ("string", True)},
    "convert": {"unit": ("string", True), "value": ("integer", True)},
}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that stand for a conversation: assistant turns are calls, the user turns after them results.

    The length n of a turn's text picks its tool and, by its last digit, a fault: 3 a limit that is text, 5 a required
    field left out, 9 a cut-off argument text. A call needs the calls at half and a third of its turn number.
    """
    n = F.length("text")
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    digit = n % 10
    search = F.format_string(
        '{ "query": "%s", "limit": %s, "exact": %s }', word, F.when(digit == 3, F.format_string('"%d"', n % 50)).otherwise((n % 50).cast("string")), F.when(n % 2 == 0, F.lit("true")).otherwise(F.lit("false"))
    )
    full = F.when(n % 3 == 0, search).when(n % 3 == 1, F.format_string('{"key":"%s"}', word)).otherwise(F.format_string('{"value": %d, "unit":"%s"}', n, word))
    short = F.when(n % 3 == 0, F.format_string('{"limit":%d}', n % 50)).when(n % 3 == 1, F.lit("{}")).otherwise(F.format_string('{"unit":"%s"}', word))
    arguments = F.when(digit == 5, short).when(digit == 9, F.lit('{"query": ')).otherwise(full)
    name = F.when(n % 3 == 0, F.lit("search")).when(n % 3 == 1, F.lit("lookup")).when(n % 3 == 2, F.lit("convert"))
    call_id = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    turn = F.col("turn")
    needs = F.array(call_id(F.floor(turn / 2).cast("long")), call_id(F.floor(turn / 3).cast("long")))
    calls = conversations.where("role = 'assistant'").select("conv_id", call_id(turn).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), needs.alias("needs"))
    results = conversations.where("role = 'user'").select("conv_id", call_id(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all conversations with their results, levels, faults and canonical messages."""
    from .tool_calls import link

    return link(spark, *conversation_calls(_read(spark, sf_dir, "conversations")), SCHEMAS)


def listed_patterns(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own sites: which are listed and when follows from the MD5 of the pattern.

    Byte 1 of the sum picks every fifth pattern; it is listed on day byte 2 of 2024, taken off 30 days later and as many
    more as byte 3 says, and listed again 200 days after the first time.
    """
    from .url_filter import patterns, url_host, url_segment

    sites = pages.select(url_host(F.col("url")).alias("host"), url_segment(F.col("url")).alias("segment")).where("host is not null").distinct()
    found = sites.select(F.explode(patterns(F.col("host"), F.col("segment"))).alias("pattern")).distinct()
    byte = lambda i: F.conv(F.substring(F.md5("pattern"), 2 * i - 1, 2), 16, 10).cast("int")
    first = F.date_add(F.lit("2024-01-01").cast("date"), byte(2))
    event = lambda day, active: F.struct(day.alias("day"), F.lit(active).alias("active"))
    events = F.array(event(first, True), event(F.date_add(first, byte(3) + 30), False), event(F.date_add(first, 200), True))
    return found.where(byte(1) % 5 == 0).select("pattern", F.explode(events).alias("e")).select("pattern", "e.*")


def op8_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with the list's verdict at their fetch day, page_id mod 366 days into 2024."""
    from .url_filter import evaluate

    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    return evaluate(spark, pages.withColumn("day", day), listed_patterns(pages)).withColumnRenamed("day", "fetch_day")


QUERIES["op2_tool_call_linking"] = op2_tool_call_linking
QUERIES["op8_temporal_url_filter"] = op8_temporal_url_filter
ORACLES["op2_tool_call_linking"] = """
with recursive m as (select conv_id, turn, role, text, length(text) as n, regexp_extract(text, '[A-Za-z]+', 0) as w from conversations where conv_id is not null and turn is not null),
calls as (
  select conv_id, turn, 'call_' || turn as call_id, n, w,
    case n % 3 when 0 then 'search' when 1 then 'lookup' when 2 then 'convert' end as name,
    case when n % 10 = 9 then 'malformed'
         when n % 10 = 5 then case n % 3 when 0 then 'missing:query' when 1 then 'missing:key' else 'missing:value' end
         when n % 10 = 3 and n % 3 = 0 then 'type:limit' end as fault,
    case when n % 10 = 9 then null
         when n % 10 = 5 then case n % 3 when 0 then '{"limit":' || (n % 50) || '}' when 1 then '{}' else '{"unit":"' || w || '"}' end
         when n % 3 = 0 then '{"exact":' || (case when n % 2 = 0 then 'true' else 'false' end) || ',"limit":'
              || (case when n % 10 = 3 then '"' || (n % 50) || '"' else (n % 50)::varchar end) || ',"query":"' || w || '"}'
         when n % 3 = 1 then '{"key":"' || w || '"}'
         else '{"unit":"' || w || '","value":' || n || '}' end as arguments
  from m where role = 'assistant'),
needs as (select distinct conv_id, turn, p as parent from (select conv_id, turn, unnest([turn // 2, turn // 3]) as p from calls)),
edges as (select e.* from needs e join calls c on c.conv_id = e.conv_id and c.turn = e.parent where e.parent <> e.turn),
paths as (
  select conv_id, turn, 0 as level from calls
  union
  select e.conv_id, e.turn, p.level + 1 from paths p join edges e on e.conv_id = p.conv_id and e.parent = p.turn),
level as (select conv_id, turn, max(level) as level from paths group by 1, 2)
select c.conv_id, c.call_id, c.turn, c.name, l.level::integer as level,
  ((select count(*) from needs n where n.conv_id = c.conv_id and n.turn = c.turn)
   - (select count(*) from edges n where n.conv_id = c.conv_id and n.turn = c.turn))::integer as n_missing,
  c.arguments, c.fault, r.turn as result_turn, r.text as content,
  '{"arguments":' || coalesce(c.arguments, 'null') || ',"id":"' || c.call_id || '","name":' || coalesce('"' || c.name || '"', 'null')
    || ',"result":' || coalesce(to_json(r.text)::varchar, 'null') || '}' as message
from calls c join level l using (conv_id, turn) left join m r on r.conv_id = c.conv_id and r.turn = c.turn + 1 and r.role = 'user'
"""
ORACLES["op8_temporal_url_filter"] = r"""
with captures as (
  select page_id, url, date '2024-01-01' + (page_id % 366)::integer as fetch_day,
    nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)', 1) as segment
  from pages),
asked as (
  select distinct page_id, pattern from (
    select page_id, unnest(list_concat(
      list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
      case when segment <> '' then [host || '/' || segment] else [] end)) as pattern
    from captures where host is not null)),
sums as (select pattern, md5(pattern) as m from (select distinct pattern from asked)),
days as (
  select pattern, ('0x' || substr(m, 1, 2))::integer as b1, date '2024-01-01' + ('0x' || substr(m, 3, 2))::integer as first_day, ('0x' || substr(m, 5, 2))::integer as b3 from sums),
events as (
  select pattern, day, bool_or(active) as active from (
    select pattern, first_day as day, true as active from days where b1 % 5 = 0
    union all select pattern, first_day + b3 + 30, false from days where b1 % 5 = 0
    union all select pattern, first_day + 200, true from days where b1 % 5 = 0) group by 1, 2),
spans as (select pattern, day as valid_from, lead(day) over (partition by pattern order by day) as valid_to, active from events),
hits as (
  select c.page_id, a.pattern, s.valid_from from captures c join asked a using (page_id) join spans s using (pattern)
  where s.active and c.fetch_day >= s.valid_from and (s.valid_to is null or c.fetch_day < s.valid_to)),
best as (select *, count(*) over (partition by page_id) as n, row_number() over (partition by page_id order by length(pattern) desc, pattern) as r from hits)
select c.page_id, c.url, c.fetch_day::date as fetch_day, b.n is not null as blocked, coalesce(b.n, 0)::bigint as n_matches, b.pattern, b.valid_from::date as listed_from
from captures c left join best b on b.page_id = c.page_id and b.r = 1
"""
ORACLES["op9_circulant_minhash"] = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end) as s from words),
sizes as (select doc_id, count(*)::bigint as n from shingles group by doc_id),
common as (select x.doc_id as a, y.doc_id as b, count(*) as k from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by all),
links as (select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * k >= 80 * (p.n + q.n - k)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as node from words union select r.doc_id, e.b from reach r join both_ways e on e.a = r.node),
component as (select doc_id, min(node) as component_id from reach group by doc_id)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, c.component_id, w.doc_id = c.component_id as kept
from words w join component c using (doc_id) left join sizes using (doc_id)
"""


def op11_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mixture of all sources at their target weights takes of every document."""
    from .mixing import mix

    return mix(spark, _read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set each apart."""
    from .divergence import audit

    return audit(spark, _read(spark, sf_dir, "documents"))


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at each step of every order, by language."""
    from .interaction import audit

    return audit(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES["op11_weighted_mixing"] = op11_weighted_mixing
QUERIES["op12_source_divergence"] = op12_source_divergence
QUERIES["op13_filter_interaction"] = op13_filter_interaction
ORACLES["op11_weighted_mixing"] = r"""
with recursive docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    substr(md5('11:' || coalesce(doc_id::varchar, 'none')), 1, 16) as key from documents),
sources as (select source, sum(size)::hugeint as s from docs group by source),
ranked as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::hugeint as w from sources),
all_of as (select sum(s)::hugeint as total from sources),
rounds as (
  select 0 as n, source, s, w, false as stopped from ranked
  union all
  select n + 1, source, s, w, stopped or w * (3 * total - 4 * sum(case when stopped then s else 0 end) over ()) >= 4 * s * sum(case when stopped then 0 else w end) over ()
  from rounds, all_of where n < (select count(*) from sources)),
final as (
  select source, s, w, stopped, 3 * total - 4 * sum(case when stopped then s else 0 end) over () as rest, 2 * sum(case when stopped then 0 else w end) over () as ws
  from rounds, all_of where n = (select count(*) from sources)),
targets as (select source, s, case when stopped then (2 * s)::double else (w * rest)::double / ws::double end as target, (case when stopped then 2 * s else (w * rest) // ws end)::hugeint as budget from final),
placed as (
  select d.*, t.s, t.target, t.budget, coalesce(sum(size) over (partition by d.source order by key, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::hugeint as before
  from docs d join targets t on d.source is not distinct from t.source)
select doc_id, source, size, s::bigint as source_size, target,
  (case when s = 0 then 0 else (budget // s) * size + least(greatest(budget % s - before, 0), size) end)::bigint as taken
from placed
"""
ORACLES["op12_source_divergence"] = r"""
with docs as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
terms as (
  select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*)::hugeint as n from terms group by lang, term having count(distinct id) >= 30),
counts as (select lang, source, term, count(*)::hugeint as n from terms semi join kept using (lang, term) group by all),
pairs as (select distinct lang, source from docs),
langs as (select lang, count(term)::hugeint as v, coalesce(sum(n), 0)::hugeint as total from (select distinct lang from docs) left join kept using (lang) group by lang),
totals as (select lang, source, coalesce(sum(n), 0)::hugeint as total from pairs left join counts using (lang, source) group by lang, source),
p as (
  select lang, source, term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (t.total + 5 * l.v) as p
  from totals t join langs l using (lang) join kept k using (lang) left join counts c using (lang, source, term)),
q as (select lang, term, 1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v) as q from kept join langs using (lang)),
apart as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
both_parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from pairs a join pairs b on a.lang = b.lang and a.source <> b.source left join apart on apart.lang = a.lang and apart.source = a.source and apart.item = b.source
  union all
  select lang, source, 'term', term, (p - q)::bigint from p join q using (lang, term) where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as r from both_parts)
select lang, source, part, item, value, r::integer as rank from ranked where part = 'pair' or r <= 50
"""
ORACLES["op13_filter_interaction"] = r"""
with docs as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
rated as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by text) as least from docs),
marks as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
fails as (
  select part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, least is not null)] as f, coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from rated left join marks using (doc_id)),
sets as (select part, f, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic, len(list_filter(f, lambda x: x)) as k from fails group by part, f),
letters as (select unnest([1, 2, 3, 4, 5]) as i),
orders as (select [a.i, b.i, c.i, d.i, e.i] as o from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps as (select o, i as step, o[i] as x, array_to_string(list_transform(o, lambda j: substr('ABCDE', j, 1)), '') as filter_order from orders, letters),
gone as (select part, f, n, good, toxic, k, filter_order, step, x, f[x] as bad, len(list_filter(o[1:step - 1], lambda j: f[j])) > 0 as before from sets, steps),
sums as (
  select part, filter_order, step, x, sum(n) filter (where not before and not bad) as kept, sum(n) filter (where bad and not before) as removed, sum(n) filter (where bad and before) as redundant,
    sum(n) filter (where bad and k = 1) as unique_fails, sum(good) filter (where bad and not before) as good_lost, sum(toxic) filter (where bad and not before) as toxic_lost
  from gone group by all)
select part, filter_order, step::integer as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  (sum(coalesce(removed, 0)) over (partition by part, x))::bigint as shapley
from sums
"""
