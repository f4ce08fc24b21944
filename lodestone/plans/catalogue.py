"""The registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators import analytics as A
from lodestone.operators import compress as P
from lodestone.operators import dense as D
from lodestone.operators import evaluate as E
from lodestone.operators import fusion as U
from lodestone.operators import jsontext as N
from lodestone.operators import sparse as S
from lodestone.sources import store as K
from lodestone.streaming import jobs as J

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    """Sums depend on their order in the last digits: results are compared on six decimals."""
    return rows.withColumns({c: F.round(c, 6) for c in columns})


def cases(text: str, rules: list[tuple[str, str]], flags: str = "") -> str:
    """SQL: the label of the first pattern found."""
    return " ".join(f"when regexp_matches({text}, '{flags}{p.replace(chr(39), chr(39) * 2)}') then '{label}'" for label, p in rules)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- terms, postings, BM25

TERMS = r"list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda t: length(t) > 1)"
CUT = f"cut as (select doc_id, {TERMS} as terms from documents), post as (select doc_id, len(terms) as dl, t as term, count(*) as tf from cut, unnest(terms) as u(t) group by all), stats as (select count(*) as n, avg(len(terms)) as avgdl from cut where len(terms) > 0)"
ASKED = f"asked as (select query_id, t as term, count(*) as times from (select item_id as query_id, {TERMS} as terms from benchmark) q, unnest(terms) as u(t) group by all)"
BM25 = f"""{CUT}, {ASKED}, weight as (select term, count(*) as df from post group by term),
scored as (select query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
  from post join weight using (term) join asked using (term), stats group by all),
sparse as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from scored qualify rank <= 10)"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return K.table(spark, d, "documents").select("doc_id", "text")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return K.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@_query(f"with {CUT} select doc_id, len(terms) as n_terms, len(list_distinct(terms)) as n_distinct from cut")
def tokenize_terms(spark, d):
    t = T.terms(F.col("text"))
    return _documents(spark, d).select("doc_id", F.size(t).cast("long").alias("n_terms"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@_query(f"with {CUT} select term, count(*) as df from post group by term")
def doc_freq(spark, d):
    return S.document_frequency(S.postings(_documents(spark, d)))


@_query(f"with {CUT} select term, count(*) as df, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) as idf from post, stats group by term")
def idf_table(spark, d):
    docs = _documents(spark, d)
    rows = S.document_frequency(S.postings(docs)).crossJoin(F.broadcast(S.corpus_stats(docs)))
    return rows.select("term", "df", F.round(S.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@_query(f"with {CUT} select n, round(avgdl, 6) as avgdl from stats")
def corpus_stats(spark, d):
    return S.corpus_stats(_documents(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


@_query(f"with {BM25} select query_id, doc_id, round(score, 6) as score, rank from sparse")
def bm25_topk(spark, d):
    return rounded(S.bm25(_documents(spark, d), _asked(spark, d)), "score")


# --- vectors

COSINE = "(list_inner_product(list_transform(q.embedding, lambda x: x::double), list_transform(e.embedding, lambda x: x::double)) / (sqrt(list_inner_product(list_transform(q.embedding, lambda x: x::double), list_transform(q.embedding, lambda x: x::double))) * sqrt(list_inner_product(list_transform(e.embedding, lambda x: x::double), list_transform(e.embedding, lambda x: x::double)))))"


def _dense(asked: str, k: int = 10, where: str = "true") -> str:
    return f"dense as (select q.vec_id as query_id, e.vec_id as doc_id, {COSINE} as score, row_number() over (partition by q.vec_id order by round({COSINE}, 9) desc, e.vec_id) as rank from embeddings e, (select * from embeddings where {asked}) q where {where} qualify rank <= {k})"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return K.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _asking(v: DataFrame) -> DataFrame:
    return v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


@_query(f"with {_dense('vec_id % 50 = 0')} select query_id, doc_id, round(score, 6) as score, rank from dense")
def dense_topk(spark, d):
    v = _vectors(spark, d)
    return rounded(D.dense(v, _asking(v)), "score")


@_query(f"with {_dense('vec_id % 50 = 0', where='e.label < 7')} select query_id, doc_id, round(score, 6) as score, rank from dense")
def dense_topk_filtered(spark, d):
    v = _vectors(spark, d)
    return rounded(D.dense(v.where("label < 7"), _asking(v)), "score")


@_query(f"with {_dense('vec_id % 50 = 0')} select query_id, doc_id, round(score, 6) as score, rank from dense where score >= 0.3")
def dense_min_similarity(spark, d):
    v = _vectors(spark, d)
    return rounded(D.dense(v, _asking(v), least=0.3), "score")


HAMMING = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: case when (z[1] > 0) <> (z[2] > 0) then 1 else 0 end))"
STAGES = f"""near as (select q.vec_id as query_id, e.vec_id as doc_id, {COSINE} as cosine, row_number() over (partition by q.vec_id order by {HAMMING}, e.vec_id) as r, {HAMMING} as distance from embeddings e, (select * from embeddings where vec_id % 50 = 0) q qualify r <= 40)"""


@_query(f"with {STAGES} select query_id, doc_id, distance::bigint as distance from near")
def hamming_candidates(spark, d):
    v = _vectors(spark, d)
    return D.dense(v, _asking(v), 40, binary=True).select("query_id", "doc_id", (-F.col("score")).cast("long").alias("distance"))


@_query(f"with {STAGES} select query_id, doc_id, round(cosine, 6) as score, row_number() over (partition by query_id order by round(cosine, 9) desc, doc_id) as rank from near qualify rank <= 10")
def two_stage_rescore(spark, d):
    v = _vectors(spark, d)
    return rounded(D.two_stage(v, _asking(v)), "score")


@_query("select vec_id as doc_id, array_to_string(list_transform(embedding, lambda x: case when x > 0 then '1' else '0' end), '') as bits from embeddings")
def binary_quantise(spark, d):
    return _vectors(spark, d).select("doc_id", V.sign_bits(F.col("embedding")).alias("bits"))


@_query("select pos - 1 as pos, min(x::double) as lo, max(x::double) as hi from (select unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings) group by pos")
def int8_ranges(spark, d):
    return D.int8_ranges(_vectors(spark, d)).select(F.col("pos").cast("long").alias("pos"), "lo", "hi")


@_query(f"""with {BM25}, {_dense('vec_id in (select item_id from benchmark)')},
both_runs as (select query_id, doc_id, rank from sparse union all select query_id, doc_id, rank from dense),
fused as (select query_id, doc_id, sum(1 / (60 + rank)) as score from both_runs group by all)
select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from fused qualify rank <= 15""")
def hybrid_rrf(spark, d):
    v = _vectors(spark, d)
    asked = v.join(_asked(spark, d).select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "embedding")
    return rounded(U.rrf([S.bm25(_documents(spark, d), _asked(spark, d)), D.dense(v, asked)]), "score")


@_query(f"with {_dense('vec_id % 50 = 0')}, one as (select query_id, doc_id, round(score, 6) as score, rank from dense qualify row_number() over (partition by doc_id order by query_id, rank) = 1) select *, row_number() over (order by query_id, rank) as place from one")
def first_seen_dedupe(spark, d):
    return U.first_seen(dense_topk(spark, d))


@_query("with q as (select conv_id * 1000 + turn as pos, text from conversations where role = 'user') select min(pos) as pos, text from q group by text")
def distinct_queries(spark, d):
    rows = K.table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text")
    return U.distinct_queries(rows)


@_query("""with g as (select l_orderkey, count(*) as n, max(l_extendedprice) as best from lineitem group by 1),
merged as (select * from g where n >= 2 and l_orderkey in (select o_orderkey from orders))
select 'O' || l_orderkey as doc_id, best as score from merged union all
select 'L' || l_orderkey || '-' || l_linenumber, max(l_extendedprice) from lineitem where l_orderkey not in (select l_orderkey from merged) group by 1""")
def automerge(spark, d):
    lines = K.table(spark, d, "lineitem").select(F.concat(F.lit("L"), "l_orderkey", F.lit("-"), "l_linenumber").alias("doc_id"), F.concat(F.lit("O"), "l_orderkey").alias("parent_id"), F.col("l_extendedprice").alias("score"), F.lit(0).alias("query_id"))
    return U.auto_merge(lines, K.table(spark, d, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("parent_id"))).drop("query_id")


# --- store

@_query("select doc_id, sha256(text) as content_id from documents")
def doc_ids_sha256(spark, d):
    return _documents(spark, d).select("doc_id", K.content_id(F.col("text")).alias("content_id"))


@_query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def upsert_latest(spark, d):
    return K.latest(K.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@_query("select doc_id, 'store' as side from documents where doc_id not in (select vec_id from embeddings) union all select vec_id, 'index' from embeddings where vec_id not in (select doc_id from documents)")
def sync_diff(spark, d):
    return K.sync_diff(_documents(spark, d), _vectors(spark, d), "doc_id")


@_query("select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def delete_docs(spark, d):
    return K.delete(_documents(spark, d), K.table(spark, d, "labels").where("toxic = 1"), ["doc_id"]).select("doc_id")


@_query("select min(doc_id) as doc_id, count(*) as n from documents group by sha256(text) having count(*) > 1")
def exact_dup_docs(spark, d):
    rows = _documents(spark, d).withColumn("key", K.content_id(F.col("text")))
    return rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").drop("key")


@_query("select lang, source, count(*) as n, sum(n_chars)::bigint as chars from documents group by all")
def lang_counts(spark, d):
    return K.table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# --- text

@_query(r"select doc_id, trim(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g')) as cleaned from documents")
def clean_text(spark, d):
    return _documents(spark, d).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@_query("select doc_id, case when length(text) > 500 then substr(text, 1, 500) || '...' else text end as cut from documents")
def truncate_content(spark, d):
    return _documents(spark, d).select("doc_id", T.truncate(F.col("text"), 500).alias("cut"))


@_query(r"""with l as (select doc_id, trim(split_part(text, chr(10), 1)) as line from documents)
select doc_id, case when length(line) between 11 and 99 and line like '#%' then trim(regexp_replace(line, '^#+', ''))
  when length(line) between 11 and 99 and not regexp_matches(line, '[.!?:]$') then line end as title from l""")
def title_extract(spark, d):
    return _documents(spark, d).select("doc_id", T.title(F.col("text")).alias("title"))


@_query("select doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, '.')[1:20], lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: regexp_matches(s, '[0-9]') and length(s) > 20), lambda s: substr(s, 1, 100))[1:5], '|') as facts from documents")
def key_facts(spark, d):
    return _documents(spark, d).select("doc_id", F.array_join(T.key_facts(F.col("text")), "|").alias("facts"))


@_query(f"with s as (select doc_id, substr(text, 1, 2000) as t from documents) select doc_id, case {cases('t', R.DOCUMENT_TYPES, '(?m)')} else 'prose' end as doc_type from s")
def doc_type(spark, d):
    return _documents(spark, d).select("doc_id", T.document_type(F.col("text")).alias("doc_type"))


@_query(f"""with q as (select item_id, trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)) as t from benchmark), n as (select *, len(list_filter(string_split_regex(t, '[ \\t\\n\\r]+'), lambda w: w <> '')) as n from q)
select item_id, (n <= 5 or {" or ".join(f"starts_with(t, '{x}')" for x in R.OPENINGS)} or (n <= 10 and not ({" or ".join(f"contains(t, '{x}')" for x in R.MARKERS)}))) as simple from n""")
def simple_query_flag(spark, d):
    return K.table(spark, d, "benchmark").select("item_id", T.simple_query(F.col("text")).alias("simple"))


# --- html and urls

@_query("select page_id, nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)), '') as title from pages")
def html_title(spark, d):
    return K.table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


_HTML = "html"
for _p, _w in ((r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", ""), (r"<[^>]+>", " ")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', '{_w}', 'g')"
for _p, _w in R.ENTITIES:
    _HTML = f"replace({_HTML}, '{_p}', '{_w}')"


@_query(rf"select page_id, trim(regexp_replace({_HTML}, '[ \t\n\r\f]+', ' ', 'g')) as content from pages")
def html_text(spark, d):
    return K.table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("content"))


@_query(f"""with h as (select page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]+') as root, list_filter(list_transform(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1), lambda u: trim(u)), lambda u: u <> '' and not regexp_matches(u, '{R.NO_PAGES}')) as links from pages)
select page_id, array_to_string(list_sort(list_distinct(list_transform(links, lambda u: case when starts_with(u, '/') then root || u else u end))), ' ') as links from h""")
def html_links(spark, d):
    return K.table(spark, d, "pages").select("page_id", F.array_join(T.html_links(F.col("html"), F.col("url")), " ").alias("links"))


@_query(r"""with b as (select page_id, split_part(url, '#', 1) as u from pages), p as (select page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) as s,
  lower(regexp_extract(u, '^[A-Za-z]+://([^/?]+)', 1)) as h, regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?]+([^?]*)', 1), '/+$', '') as p,
  array_to_string(list_sort(string_split(regexp_extract(u, '\?(.*)$', 1), '&')), '&') as q from b)
select page_id, s || '://' || case s when 'http' then regexp_replace(h, ':80$', '') when 'https' then regexp_replace(h, ':443$', '') else h end || case when p = '' then '/' else p end || case when q = '' then '' else '?' || q end as url from p""")
def url_normalise(spark, d):
    return K.table(spark, d, "pages").select("page_id", T.url_normal(F.col("url")).alias("url"))


@_query("select lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) as domain, count(*) as n from pages group by 1")
def domain_counts(spark, d):
    return K.table(spark, d, "pages").groupBy(F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]+)", 1)).alias("domain")).agg(F.count("*").alias("n"))


def _event_json(spark: SparkSession, d: str) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    made = F.format_string('{"timestamp": "%s", "level": "%s", "message": "event %d", "props": %s}', at, "event_type", "event_id", "props")
    return K.table(spark, d, "events").select("event_id", made.alias("json"))


@_query("""select event_id, 'timestamp: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || 'level: ' || event_type || chr(10) || 'message: event ' || event_id || chr(10) || 'props.k: ' || (props->>'$.k') as content from events""")
def json_flatten(spark, d):
    return N.json_chunks(_event_json(spark, d), "event_id", how="flatten").select("event_id", "content")


@_query("""select event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] | [' || event_type || '] | event ' || event_id || ' | props: {"k": ' || (props->>'$.k') || '}' as line from events""")
def log_render(spark, d):
    return N.json_chunks(_event_json(spark, d), "event_id").select("event_id", F.col("content").alias("line"))


# --- conversations

@_query("select conv_id, turn, text from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 2")
def history_last_n(spark, d):
    return A.last_turns(K.table(spark, d, "conversations"), 2).select("conv_id", "turn", "text")


@_query("select conv_id, turn, text from conversations where role = 'user' qualify row_number() over (partition by conv_id order by turn desc) <= 3")
def recent_user_queries(spark, d):
    return A.last_turns(K.table(spark, d, "conversations").where("role = 'user'"), 3).select("conv_id", "turn", "text")


@_query("select conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) order by turn) as history from conversations group by 1")
def history_render(spark, d):
    return A.render_history(K.table(spark, d, "conversations"))


@_query("select conv_id, count(*) > 6 as compress, sum(length(text))::bigint as chars, sum(length(text)) > 3000 or max(length(text)) > 2000 as needs_summary from conversations group by 1")
def conversation_budget(spark, d):
    n = F.length("text")
    return K.table(spark, d, "conversations").groupBy("conv_id").agg((F.count("*") > 6).alias("compress"), F.sum(n).alias("chars"), ((F.sum(n) > 3000) | (F.max(n) > 2000)).alias("needs_summary"))


@_query("select conv_id, turn, greatest(200, floor(length(text)::double / sum(length(text)) over (partition by conv_id) * 3000 * 1.5::double))::bigint as budget from conversations")
def budget_allocation(spark, d):
    rows = K.table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), "turn", F.length("text").alias("score"))
    return P.budgets(rows).select(F.col("query_id").alias("conv_id"), "turn", "budget")


# --- verification, strategies, metrics

CLAIMS = "claims as (select doc_id, doc_id % 50 as answer_id, case when toxic = 1 then 'contradicted' when quality = 1 and doc_id % 2 = 0 then 'supported' when quality = 1 then 'partially_supported' when doc_id % 3 = 0 then 'unverifiable' else 'not_supported' end as status, (doc_id % 10) / 10 as confidence, doc_id % 7 <> 0 as requires from labels)"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    status = F.expr("case when toxic = 1 then 'contradicted' when quality = 1 and doc_id % 2 = 0 then 'supported' when quality = 1 then 'partially_supported' when doc_id % 3 = 0 then 'unverifiable' else 'not_supported' end")
    return K.table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 50).alias("answer_id"), status.alias("status"), (F.col("doc_id") % 10 / 10).alias("confidence"), (F.col("doc_id") % 7 != 0).alias("requires"))


@_query(f"""with {CLAIMS}, s as (select answer_id, count(*) as n, {", ".join(f"count(*) filter (status = '{x}') as {x}" for x in R.STATUS_WEIGHTS)},
  coalesce(avg(confidence * case status {" ".join(f"when '{x}' then {w}" for x, w in R.STATUS_WEIGHTS.items())} end) filter (requires), 1) as score from claims group by 1)
select answer_id, {", ".join(R.STATUS_WEIGHTS)}, round(score, 6) as score, round(score, 6) >= 0.7 and contradicted = 0 as is_factual, contradicted > 0 or not_supported > n * 0.3 as needs_correction from s""")
def status_pivot(spark, d):
    return rounded(E.factuality(_claims(spark, d)), "score")


OUTCOMES = "outcomes as (select user_id, event_type as strategy, least(value / 500, 1) as confidence, value > 100 as success from events)"
STATS = f"{OUTCOMES}, stats as (select user_id, strategy, count(*) as n, sum(confidence) as confidence, count(*) filter (success) as successes from outcomes group by all)"


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return K.table(spark, d, "events").select("user_id", F.col("event_type").alias("strategy"), F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"), (F.col("value") > 100).alias("success"))


@_query(f"with {STATS} select * replace (round(confidence, 6) as confidence) from stats")
def strategy_stats(spark, d):
    return rounded(A.strategy_stats(_outcomes(spark, d), ["user_id", "strategy"]), "confidence")


@_query(f"with {STATS} select user_id, strategy, round(confidence / n * successes / n, 6) as score from stats where n >= 2 qualify row_number() over (partition by user_id order by round(confidence / n * successes / n, 9) desc, strategy) = 1")
def best_strategy(spark, d):
    return rounded(A.best_strategy(A.strategy_stats(_outcomes(spark, d), ["user_id", "strategy"]), "user_id").drop("confidence"), "score")


@_query("select event_type as step, count(*) as n, count(*) filter (event_type <> 'error') as n_ok, avg((event_type <> 'error')::int) as rate, round(avg(value), 6) as avg_ms, min(value) as min_ms, max(value) as max_ms from events group by 1")
def step_stats(spark, d):
    return rounded(A.step_stats(_steps(spark, d), ["step"]), "avg_ms")


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return K.table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("step"), F.col("value").alias("ms"), (F.col("event_type") != "error").alias("ok"))


@_query(f"select bound, (select count(*) from events where value <= limit_) as n from (values {', '.join(f"('{b}', {b})" for b in R.LATENCY_BOUNDS)}, ('+Inf', 1e300)) b(bound, limit_)")
def latency_histogram(spark, d):
    found = A.histogram(_steps(spark, d), R.LATENCY_BOUNDS)
    return found.select(F.when(F.col("bound") == float("inf"), "+Inf").otherwise(F.format_string("%.0f", "bound")).alias("bound"), "n")


@_query("select event_id, case when max(value) over w = min(value) over w then 100 else round(100 * (value - min(value) over w) / (max(value) over w - min(value) over w), 6) end as score from events window w as (partition by user_id)")
def score_minmax(spark, d):
    rows = K.table(spark, d, "events").select("event_id", "user_id", F.col("value").alias("score"))
    return rounded(A.min_max(rows, "user_id").drop("user_id"), "score")


# --- timed segments and streams

SEGMENTS = "seg as (select event_id, user_id, event_type, epoch(ts) - min(epoch(ts)) over (partition by user_id) as start, epoch(ts) - min(epoch(ts)) over (partition by user_id) + value as stop from events)"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    start = at - F.min(at).over(Window.partitionBy("user_id"))
    return K.table(spark, d, "events").select("event_id", "user_id", "event_type", start.alias("start"), (start + F.col("value")).alias("stop"))


@_query(f"""with {SEGMENTS}, wide as (select *, unnest(range(greatest(0, floor((start - 600) / 500) + 1)::bigint, greatest(greatest(0, floor((start - 600) / 500) + 1), ceil(stop / 500) - 1)::bigint + 1)) as window_no from seg)
select user_id, window_no, count(*) as n from wide where stop > window_no * 500 and start < window_no * 500 + 600 group by all""")
def transcript_windows(spark, d):
    return A.overlapping(_segments(spark, d), 600, 500, 1e12).groupBy("user_id", "window_no").agg(F.count("*").alias("n"))


@_query(f"""with {SEGMENTS}, flagged as (select *, coalesce(start - lag(stop) over (partition by user_id order by start, event_id) > 3600, true)::int as begins from seg)
select event_id, user_id, sum(begins) over (partition by user_id order by start, event_id)::bigint as chapter from flagged""")
def chapters_by_gap(spark, d):
    return A.chapters(_segments(spark, d), "user_id", 3600).select("event_id", "user_id", "chapter")


@_query("""select to_timestamp(w * 50)::timestamp as window_start, event_type, count(*) as n, round(sum(value), 4) as total
  from (select *, unnest(range(floor((epoch(ts) - 60) / 50)::bigint + 1, floor(epoch(ts) / 50)::bigint + 1)) as w from events) group by all""")
def sliding_windows(spark, d):
    return J.windowed(K.table(spark, d, "events"))


@_query("""with f as (select *, coalesce(epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts) >= 120, true)::int as b from events),
  s as (select *, sum(b) over (partition by user_id order by ts, event_id) as session from f) select user_id, min(ts)::timestamp as session_start, count(*) as n from s group by user_id, session""")
def session_chapters(spark, d):
    return J.sessions(K.table(spark, d, "events"))


from lodestone.plans import library, stored  # noqa: E402, F401  register further queries
