"""Queries over `documents` and `events`: text measures, keywords, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, keywords, near_duplicates
from .catalog import query, table

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ0-9][a-zà-ÿ0-9''-]+')"
_SENT = r"greatest(1, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: trim(regexp_replace(s, '[ \t-\r]+', ' ', 'g')) <> '')))"
_STATS = f"w as (select doc_id, source, text, {_WORDS} words, {_SENT} sentences from documents)"


@query(f"""with {_STATS} select doc_id, len(words)::int n_words, sentences::int sentences, round(len(words) / sentences::double, 1) words_per_sentence, len(words) < 200 thin,
  md5(coalesce(text, '')) content_md5, length(coalesce(text, ''))::int n_chars, octet_length(encode(coalesce(text, '')))::int n_bytes from w""")
def text_stats(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    own = table(spark, sf_dir, "documents").select(
        "doc_id", text.alias("text"), F.expr(T.words("coalesce(text, '')")).alias("words"), F.expr(T.sentence_count("coalesce(text, '')")).alias("sentences")
    )
    return own.select(
        "doc_id",
        F.size("words").alias("n_words"),
        "sentences",
        F.round(F.size("words") / F.col("sentences"), 1).alias("words_per_sentence"),
        (F.size("words") < 200).alias("thin"),
        F.md5("text").alias("content_md5"),
        F.length("text").alias("n_chars"),
        F.octet_length("text").alias("n_bytes"),
    )


def _votes() -> str:
    vote = {k: f"len(list_filter(words[1:2500], lambda w: w in ({T.quoted(v.split())})))" for k, v in T.LANGUAGE_WORDS.items()}
    best = f"greatest({', '.join(vote.values())})"
    return f"case when len(words) < 20 or {best} = 0 then null " + " ".join(f"when {v} = {best} then '{k}'" for k, v in vote.items()) + " end"


@query(f"with {_STATS} select doc_id, {_votes()} lang_detected from w")
def language_votes(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.expr(T.words("coalesce(text, '')")).alias("words"))
    return own.select("doc_id", F.expr(T.language("words")).alias("lang_detected"))


_FLESCH = f"""{_STATS}, l as (select doc_id, len(words) n, sentences s, list_sum(list_transform(words, lambda w: greatest(1, len(regexp_extract_all(w, '[{T.VOWELS}]+'))))) y, {_votes()} lang from w),
f as (select doc_id, n, y, lang, case when n < 30 then null when lang = 'nl' then round(206.84::double - 0.93::double * (n / s::double) - 77::double * (y / n::double), 1) else round(206.835::double - 1.015::double * (n / s::double) - 84.6::double * (y / n::double), 1) end flesch from l)"""


@query(f"with {_FLESCH} select doc_id, coalesce(y, 0)::bigint syllables, flesch, case when flesch is null then null " + " ".join(f"when flesch >= {a} then '{b}'" for a, b in T.READING) + " else 'zeer moeilijk' end reading_class from f")
def readability(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(T.words("coalesce(text, '')")).alias("words"), F.expr(T.sentence_count("coalesce(text, '')")).alias("s")
    )
    own = own.select(
        "doc_id",
        "s",
        F.size("words").alias("n"),
        F.expr(f"cast(aggregate(words, 0, (a, w) -> a + {T.syllables('w')}) as long)").alias("syllables"),
        F.expr(T.language("words")).alias("lang"),
    )
    own = own.withColumn("flesch", F.expr(T.flesch("n", "s", "syllables", "lang")))
    return own.select("doc_id", "syllables", "flesch", F.expr(T.reading_class("flesch")).alias("reading_class"))


def _grams(n: int) -> str:
    stop = T.quoted(T.KEYWORD_STOP)
    if n == 1:
        return f"list_filter(words, lambda w: w not in ({stop}) and not regexp_matches(w, '^[0-9]+$') and length(w) > 2)"
    return (
        f"list_transform(list_filter(list_transform(range(1, len(words) - {n - 2}), lambda i: words[i:i + {n - 1}]), "
        f"lambda g: g[1] not in ({stop}) and g[{n}] not in ({stop}) and not list_bool_and(list_transform(g, lambda w: regexp_matches(w, '^[0-9]+$')))), lambda g: array_to_string(g, ' '))"
    )


def _top(n: int, top: int) -> str:
    return f"""{_STATS}, g as (select doc_id, source, greatest(1, len(words)) total, {_grams(n)} terms from w),
e as (select doc_id, source, total, unnest(terms) term, generate_subscripts(terms, 1) - 1 pos from g),
c as (select doc_id, source, total, term, count(*) "count", min(pos) first_pos from e group by all),
r as (select *, row_number() over (partition by doc_id order by "count" desc, first_pos) place from c),
t as (select doc_id, source, term, "count", first_pos::int first_pos, round(100 * "count" * {n} / total::double, 2) density_pct, place::int place from r where place <= {top})"""


def _keyword_query(n: int):
    def run(spark, sf_dir):
        return keywords.profile(table(spark, sf_dir, "documents"), "doc_id", "text", n)

    run.__name__ = {1: "top_unigrams", 2: "top_bigrams", 3: "top_trigrams"}[n]
    return query(f"with {_top(n, keywords.KEPT[n])} select * exclude (source) from t")(run)


top_unigrams, top_bigrams, top_trigrams = (_keyword_query(n) for n in (1, 2, 3))


@query(f"""with {_top(1, 25)}, s as (select source, term, sum("count")::bigint uses, count(*) texts from t group by all),
p as (select *, row_number() over (partition by source order by uses desc, term)::int place from s) select * from p where place <= 30""")
def site_keywords(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = keywords.profile(docs, "doc_id", "text", 1).join(docs.select("doc_id", "source"), "doc_id")
    return keywords.site_terms(found, "source", 30)


@query("select md5(coalesce(text, '')) md5, count(*) copies, min(doc_id) \"first\" from documents group by 1 having count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return near_duplicates.exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


_SETS = r"""t as (select doc_id, md5(coalesce(text, '')) md5, regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ0-9]+') k from documents),
s as (select doc_id, md5, case when len(k) >= 5 then list_distinct(list_transform(range(1, len(k) - 3), lambda i: array_to_string(k[i:i + 4], ' '))) else list_distinct(k) end sh from t),
r as (select min(doc_id) id, md5, count(*) copies, any_value(sh) sh from s group by md5),
e as (select id, len(sh) n, unnest(sh) x from r),
p as (select a.id a, b.id b, count(*) shared, any_value(a.n + b.n) sizes from e a join e b on a.x = b.x and a.id < b.id group by 1, 2),
j as (select a, b, shared::int shared, (sizes - shared)::int together from p where 100 * shared >= 80 * (sizes - shared))"""


@query(f"with {_SETS} select a, b, shared, together, round(shared / together::double, 3) similarity from j")
def jaccard_pairs(spark, sf_dir):
    sets = near_duplicates.shingle_sets(table(spark, sf_dir, "documents"), "doc_id", "text")
    return near_duplicates.similar(sets, "doc_id").withColumn("similarity", F.expr(T.rounded("(shared / together)", 3)))


@query(f"""with recursive {_SETS}, b2 as (select a x, b y from j union all select b, a from j),
c as (select id x, id root from r union select b2.y, c.root from c join b2 on b2.x = c.x),
m as (select x id, min(root) cluster from c group by x),
v as (select m.cluster, max(round(shared / together::double, 3)) best from j join m on m.id = j.a group by 1),
g as (select m.cluster, sum(copies)::bigint size, bool_or(copies > 1) exact from r join m on m.id = r.id group by 1 having sum(copies) > 1)
select g.cluster, size, case when exact then 1.0::double else best end max_similarity, exact from g left join v on v.cluster = g.cluster""")
def near_duplicate_clusters(spark, sf_dir):
    sets = near_duplicates.shingle_sets(table(spark, sf_dir, "documents"), "doc_id", "text")
    pairs = graph.cut(near_duplicates.similar(sets, "doc_id"))
    return near_duplicates.clusters(sets, pairs, "doc_id", graph.connected)


@query("""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from documents)
select doc_id, count(*)::bigint n_lines, sum((length(trim(line)) = 0)::int)::bigint blank_lines, max(length(line))::int longest from l group by doc_id""")
def line_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum((F.length(F.trim("line")) == 0).cast("int")).alias("blank_lines"), F.max(F.length("line")).alias("longest")
    )


@query("""select source, l.quality, count(*) docs, round(avg(n_chars), 2) avg_chars from documents join labels l using (doc_id) group by 1, 2""")
def quality_by_source(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    own = docs.select("doc_id", "source", "n_chars").join(labels.select("doc_id", "quality"), "doc_id")
    return own.groupBy("source", "quality").agg(F.count("*").alias("docs"), F.round(F.avg("n_chars"), 2).alias("avg_chars"))
