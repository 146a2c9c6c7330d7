"""Registered queries of this package, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnsift.llm import (
    ann,
    chat,
    decontaminate,
    digestindex,
    htmltext,
    langid,
    lexical,
    licenses,
    mixing,
    phrases,
    simhash,
    tokenfile,
    urlfilter,
)
from txnsift.llm.common import load
from txnsift.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir) -> DataFrame`, with its SQL where one exists."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.fit_profiles(docs.filter(~langid.held_out(F.col("doc_id"))))
    predicted = langid.with_language(docs.select("doc_id", "text"), profiles)
    return predicted.select(
        "doc_id",
        langid.held_out(F.col("doc_id")).alias("held_out"),
        F.col("__lang_pred").alias("lang_pred"),
        F.col("__lang_score").alias("score"),
    )


def _license_sql() -> str:
    rows = ", ".join(
        "('{}', [{}])".format(name, ", ".join("'" + g + "'" for g in grams))
        for name, grams in licenses.template_bigrams(licenses.TEMPLATES).items()
    )
    return rf"""
with templates(name, grams) as (values {rows}),
docs as (select doc_id, row_number() over () as row_no, coalesce(text, '') as body from documents),
units as (
  select row_no, unnest(list_concat(string_split(body, chr(10)),
         list_filter(regexp_split_to_array(body, '\n[ \t\r]*\n'), lambda p: contains(p, chr(10))))) as unit from docs),
words as (
  select row_no, list_filter(string_split(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'), ' '), lambda w: w <> '') as w from units),
grams as (
  select row_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as grams
  from words where len(w) > 1),
scored as (
  select row_no, name, 2.0::double * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) as score
  from grams g, templates t),
best as (
  select row_no, name, score, row_number() over (partition by row_no order by score desc, name) as place
  from scored where score >= 0.8)
select d.doc_id, b.name as license, coalesce(b.score, 0.0::double) as score
from docs d left join best b on b.row_no = d.row_no and b.place = 1
"""


@query("op2_license_scan", _license_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(load(spark, sf_dir, "documents")).select("doc_id", "license", "score")


def tokenizer_file() -> str:
    """The vocabulary that the token queries use, installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_token_file")
def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_tokens(tokenfile.write_tokens(load(spark, sf_dir, "documents"), tokenizer_file()))


#: The rules of the url query: host, path, verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

_URL_SQL = r"""
with parts as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
ruled as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from parts)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
from ruled
"""


@query("op4_url_filter", _URL_SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(load(spark, sf_dir, "pages"), rules)


_CONTROL_SQL = r"([<\[])(\\*)(/?s>|/?INST\]|ROLE\]|NEXT\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>)"

_CHAT_SQL = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (
  select *, length(regexp_replace(role, '{_CONTROL_SQL}', '\1\\\2\3', 'g')) as role_chars,
    length(regexp_replace(text, '{_CONTROL_SQL}', '\1\\\2\3', 'g')) as text_chars,
    lag(role) over (partition by conv_id order by turn, role, text) as previous
  from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  sum(text_chars + case when previous = role then 6 else 13 + role_chars end)::bigint as formatted_chars
from sized group by conv_id
"""


@query("op5_chat_format", _CHAT_SQL)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns.unionByName(planted))
    read = formatted.select(
        "conv_id",
        chat.parse(F.col("formatted")).alias("turns"),
        F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op6_source_mix")
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    rows = mixing.sized_rows(docs, "doc_id", "text", "source", 17)
    placed = mixing.place(rows, mixing.plan_mix(rows))
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("shards")).alias("taken"),
    )


@query("op7_nearest")
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


_ITEM_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[0-9a-z\x{80}-\x{10FFFF}]+')"""

_DECONTAMINATE_SQL = f"""
with docs as (select doc_id, row_number() over () as row_no, {_ITEM_WORDS} as w from documents),
items as (select item_id, {_ITEM_WORDS} as w from benchmark),
windows as (
  select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as words
  from (select item_id, w, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i
        from items where len(w) > 0)),
sizes as (select distinct size from windows),
places as (select row_no, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, sizes where len(w) >= size),
found as (
  select distinct p.row_no, p.i, p.size, v.item_id
  from (select row_no, i, size, array_to_string(w[i:i + size - 1], ' ') as words from places) p
  join windows v on v.size = p.size and v.words = p.words),
hits as (select row_no, count(distinct word) as n_hit from (select row_no, unnest(range(i, i + size)) as word from found) group by 1),
owners as (
  select row_no, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct row_no, item_id::varchar as item from found) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (row_no) left join owners using (row_no)
"""


@query("op8_decontaminate", _DECONTAMINATE_SQL)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_spans(docs, load(spark, sf_dir, "benchmark"))
    hit = F.aggregate("__spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    items = F.array_sort(F.transform("__items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(load(spark, sf_dir, "pages"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


_PHRASE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A\x0B\x0C\x0D]')) as piece
  from documents),
worded as (select lang, regexp_extract_all(piece, '[^ \t]+') as w from pieces),
totals as (select lang, sum(len(w))::hugeint as n from worded group by lang),
grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from worded, range(1, 6) r(k) where len(w) >= k)),
f as (select lang, k, phrase, count(*) as a from grams group by 1, 2, 3 having count(*) >= 100),
words as (select *, string_split(phrase, ' ') as w from f),
inner_parts as (
  select distinct c.lang, array_to_string(c.w[i:i + size - 1], ' ') as phrase, c.a
  from (select lang, w, a, k, size, unnest(range(1, k - size + 2)) as i from words, range(2, 5) r(size) where size < k) c),
kept as (
  select * from words c where k > 1 and not exists (
    select 1 from inner_parts p where p.lang = c.lang and p.phrase = c.phrase and 100 * p.a >= 100 * c.a)),
cuts as (
  select c.lang, c.phrase, c.a, c.cut, l.a as l, r.a as r, t.n, ((1000 * c.a::hugeint * t.n) // (l.a::hugeint * r.a)) as score
  from (select lang, phrase, a, w, k, unnest(range(1, k)) as cut from kept) c
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.cut], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
  join totals t on t.lang = c.lang),
lowest as (select *, row_number() over (partition by lang, phrase order by score, cut) as place from cuts),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest where place = 1)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""


@query("op11_phrases", _PHRASE_SQL)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.collocations(load(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_DEDUP_SQL = """
with hashed as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256,
    row_number() over () as row_no
  from documents),
placed as (
  select *, max(doc_id) over g as keep_id, count(*) over g as group_size,
    row_number() over (partition by text_sha256 order by doc_id desc nulls last, row_no desc) as place
  from hashed window g as (partition by text_sha256))
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from placed
"""


@query("op12_exact_dedup", _DEDUP_SQL)
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = digestindex.DigestIndex(spark, scratch_path(spark, "digest-index"))
    decided = index.add(load(spark, sf_dir, "documents"), "documents")
    return decided.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


_LEXICAL_SQL = f"""
with docs as (select row_number() over () as row_no, doc_id, {_ITEM_WORDS} as w from documents),
sizes as (select row_no, doc_id, len(w) as n from docs where len(w) > 0),
totals as (select count(*) as n_docs, sum(n)::bigint as n_terms from sizes),
terms as (select row_no, term, count(*) as tf from (select row_no, unnest(w) as term from docs) group by 1, 2),
items as (
  select distinct item_no, item_id, term
  from (select row_number() over () as item_no, item_id, unnest({_ITEM_WORDS}) as term from benchmark)),
weights as (
  select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as weight
  from terms, totals group by term),
scored as (
  select item_no, item_id, s.doc_id,
    sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * s.n * n_docs) // n_terms))))::bigint as score
  from items join terms using (term) join weights using (term) join sizes s using (row_no), totals
  group by item_no, item_id, s.row_no, s.doc_id),
ranked as (select *, row_number() over (partition by item_no order by score desc, doc_id nulls last) as rank from scored where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 10
"""


@query("op13_ranked_search", _LEXICAL_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
