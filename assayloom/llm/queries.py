"""Registered queries of the operators, each over its whole table, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayloom.llm import chat, collocations, extraction, hashing, jaccard, language, mixing, ngram, packing, quality, suffixes, topk, whitening
from assayloom.llm.common import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read_table(spark, sf_dir, "embeddings"), each_row=True)


ORACLES["op1_exact_top_k"] = """
with v as (select vec_id, [floor(256 * x::double) for x in embedding] as x from embeddings
           where embedding is not null and vec_id is not null
             and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score from v q, v c
      where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_documents(read_table(spark, sf_dir, "documents"))


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(read_table(spark, sf_dir, "documents")).drop("text_key", "group")


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), each_row=True)


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False).drop("spans")


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf_dir, "documents")).drop("source")


ORACLES["op8_source_mix"] = r"""
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5('mix:' || coalesce(doc_id::varchar, 'null')) as k from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as src from d group by source),
w as (select *, [1.0, 2.0, 3.0][src % 3 + 1]::double as w, (source_size * 3)::double as most from s),
l as (select *, (sum(source_size) over () - coalesce(sum(most) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level from w
      window before as (order by most / w, src rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, src, least(most, max(level) over () * w) as target, sum(source_size) over () as budget from l),
c as (select d.doc_id, d.size, d.k, t.*, sum(size) over (partition by t.src order by d.k, d.doc_id, d.size rows unbounded preceding) as cum from d join t on d.source is not distinct from t.source),
m as (select *, (e * source_size + cum)::double / target as vt from c, (select unnest([0, 1, 2]) as e) where size > 0 and target > 0),
f as (select *, sum(size) over (order by vt, src, e, k, doc_id, size rows unbounded preceding) as run from m where vt <= 2),
n as (select doc_id, k, src, size, cum, sum(size) as taken from f where run <= budget group by all)
select c.doc_id, c.size, c.source_size::bigint as source_size, c.target, coalesce(n.taken, 0)::bigint as taken from c
left join n on c.doc_id is not distinct from n.doc_id and c.src = n.src and c.cum = n.cum and c.size = n.size"""


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns, and conversation -1, whose texts hold control strings."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.unionByName(more)


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.format_conversations(chat_rows(spark, sf_dir))
    nl = F.lit("\n")
    back = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("pieces")).alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), nl, t["text"], nl)), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


_CONTROL = r"</?s>|\[/?INST\]|<<SYS>>|\[NEXT\]|\[ROLE\]|\[NULL\]"
ORACLES["op9_chat_format"] = rf"""
with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations
           union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
p as (select *, lag(role) over o is not distinct from role and row_number() over o > 1 as next from t
      window o as (partition by conv_id order by turn nulls first, role nulls first, text)),
m as (select *, case when next then 6 when role = 'user' then 6 when role = 'assistant' then 7 when role = 'system' then 7 when role is null then 6
                else 6 + len(replace(replace(role, '\', '\\'), chr(10), '\n')) end
                + 2 + len(text) + len(regexp_extract_all(text, '{_CONTROL}')) as chars from p)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by turn nulls first, role nulls first, text)) as turns_sha256,
       coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
       (sum(chars) + 8)::bigint as formatted_chars
from m group by conv_id"""


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = r"""
with recursive d as (select coalesce(lang, 'und') as lang,
                  regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as ps from documents),
p as (select lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') as w from d),
s as (select lang, len(w) as many, w, unnest(range(1, len(w) + 1)) as i from p),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from s, (select unnest([1, 2, 3, 4, 5]) as k) where i + k - 1 <= many),
f as (select lang, k, phrase, count(*)::hugeint as a from g group by all),
n as (select lang, sum(a)::hugeint as n from f where k = 1 group by lang),
c as (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k > 1 and a >= 100),
u as (select c.*, unnest(range(1, k)) as cut from c),
x as (select u.lang, u.k, u.phrase, u.a, u.cut, l.a as l, r.a as r, n.n, (1000 * u.a * n.n) // (l.a * r.a) as score from u join n using (lang)
      join f l on l.lang = u.lang and l.k = u.cut and l.phrase = array_to_string(w[1:cut], ' ')
      join f r on r.lang = u.lang and r.k = u.k - u.cut and r.phrase = array_to_string(w[cut + 1:], ' ')),
b as (select * from x qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inner_ as (select lang, array_to_string(w[unnest(range(1, k - j + 2)):][1:j], ' ') as phrase, a from c, (select unnest([2, 3, 4]) as j) where j < k),
covered as (select b.lang, b.phrase from b join inner_ i on b.lang = i.lang and b.phrase = i.phrase group by b.lang, b.phrase having max(100 * i.a) >= 100 * max(b.a)),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b
      where not exists (select 1 from covered v where v.lang = b.lang and v.phrase = b.phrase))
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from o where rank <= 2000"""


@query
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read_table(spark, sf_dir, "pages"))


# the article of pages marked up as those of the given table; a page's node densities cannot be written in SQL
ORACLES["op13_html_extraction"] = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as a from pages),
b as (select page_id, url, regexp_split_to_array(regexp_replace(a, '</?b>', '', 'g'), '</?(?:p|h1)>') as bs from a),
t as (select page_id, url, [trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'),
      '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&amp;', '&'), '[\s\x{00A0}]+', ' ', 'g')) for x in bs] as bs from b)
select page_id, url, array_to_string([x for x in bs if x <> ''], chr(10) || chr(10)) as text,
       len(array_to_string([x for x in bs if x <> ''], chr(10) || chr(10)))::bigint as n_chars from t"""
