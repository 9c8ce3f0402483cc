"""Queries of text functions, chunking and extraction, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import chunking, extraction
from loomgraph.sources.tables import table


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents", "doc_id", "text")


def token_count(spark, root):
    return _docs(spark, root).select("doc_id", X.count_tokens(F.col("text")).alias("n_tokens"))


def truncate_tokens(spark, root):
    return _docs(spark, root).select("doc_id", F.md5(X.truncate_tokens(F.col("text"), 100)).alias("cut_md5"))


def analyze_terms(spark, root):
    terms = _docs(spark, root).select("doc_id", F.explode(X.analyze(F.col("text"))).alias("term"))
    return terms.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.count_distinct("term").alias("n_distinct"), F.md5(F.array_join(F.array_sort(F.collect_set("term")), " ")).alias("terms_md5"))


def normalize_names(spark, root):
    return table(spark, root, "entities", "entity_id", "name").distinct().select("entity_id", X.normalize_name(F.col("name")).alias("normal"))


def normalize_answers(spark, root):
    return table(spark, root, "questions", "id", "answer").distinct().select("id", X.normalize_answer(F.col("answer")).alias("normal"))


def clean_fields(spark, root):
    m = table(spark, root, "entity_mentions", "mention_id", "name", "description").distinct()
    d = F.col("description")
    return m.select("mention_id", X.clean_field(F.concat(F.lit(' "'), F.col("name"), F.lit("\" "))).alias("field"), X.clean_cell(F.concat(d, F.lit("|\n x "))).alias("cell"), X.clean_sentence(F.concat(F.lit("## **"), d, F.lit("** -"))).alias("sentence"))


def between_markers(spark, root):
    m = table(spark, root, "entity_mentions", "mention_id", "name", "type").distinct()
    text = F.concat(F.lit("[[x]] [["), F.col("name"), F.lit("]] tail ]]"))
    return m.where("name is not null").select("mention_id", X.between(text, "[[", "]]").alias("inner"), X.between(F.col("name"), "[[", "]]").alias("nothing"))


def partial_dates(spark, root):
    f = table(spark, root, "facts", "fact_id", "valid_from").distinct().where("valid_from is not null")
    text = F.when(F.col("fact_id") % 3 == 0, F.date_format("valid_from", "yyyy")).when(F.col("fact_id") % 3 == 1, F.date_format("valid_from", "yyyy-MM")).otherwise(F.date_format("valid_from", "yyyy-MM-dd"))
    return f.select("fact_id", F.date_format(X.partial_date(text), "yyyy-MM-dd").alias("day"))


def json_reply(spark, root):
    e = table(spark, root, "events", "event_id", "props")
    got = X.tolerant_json(F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n``` done")), "k int")
    return e.select("event_id", got["k"].cast("bigint").alias("k"))


def term_overlap(spark, root):
    q = table(spark, root, "questions", "id", "question", "answer").distinct()
    return q.select("id", X.overlap(F.col("question"), F.coalesce("answer", F.lit(""))).cast("bigint").alias("shared"))


def sentence_split(spark, root):
    rows = _docs(spark, root).select("doc_id", F.explode(X.sentences(F.regexp_replace("text", r"[^\x00-\x7f]", "~"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"))


def chunk_fixed(spark, root):
    c = chunking.chunk_documents(_docs(spark, root), 300, 50)
    return c.select("unit_id", "doc_id", "ord", F.md5("text").alias("text_md5"), "n_tokens", "start_char", "end_char")


def chunk_sentences(spark, root):
    return chunking.chunk_documents(_docs(spark, root), 300, method="sentences")


def _outputs(spark, root) -> DataFrame:
    """A model's output per source: extraction records written from the tables, with chatter, quotes and bad records."""
    m = table(spark, root, "entity_mentions", "mention_id", "name", "type", "description").distinct().where("name is not null")
    t = F.coalesce(F.col("type"), F.lit("event kind"))
    ent = F.concat(F.lit('Sure ("entity"<|> "'), F.col("name"), F.lit('" <|>'), t, F.lit("<|>"), F.coalesce("description", F.lit("none")), F.lit("<|>more) ok"))
    return m.select(F.col("mention_id").alias("row_id"), F.concat(ent, F.lit('##("entity"<|>only)\nplain words<|COMPLETE|>')).alias("output"))


def parse_entities(spark, root):
    return extraction.parse_entities(extraction.records(_outputs(spark, root))).select("row_id", "name", "type", "description")


def parse_relationships(spark, root):
    r = table(spark, root, "relationships", "rel_id", "source", "target", "description", "strength").distinct().where("source is not null and target is not null and strength is not null")
    last = F.when(F.col("rel_id") % 5 == 0, F.lit("1.2.3")).when(F.col("rel_id") % 5 == 1, F.lit("strong")).otherwise(F.concat(F.lit("about "), F.col("strength").cast("int").cast("string")))
    d = F.regexp_replace(F.coalesce("description", F.lit("none")), r"[()\n]", " ")
    bare = lambda c: F.regexp_replace(c, r"[()\n]", " ")
    out = F.concat(F.lit("(relationship<|>"), bare("source"), F.lit("<|>"), bare("target"), F.lit("<|>"), d, F.lit("<|>"), last, F.lit(")"))
    rows = r.select(F.col("rel_id").alias("row_id"), out.alias("output"))
    return extraction.parse_relationships(extraction.records(rows)).select("row_id", "source", "target", "description", "strength")


def parse_claims(spark, root):
    f = table(spark, root, "facts", "fact_id", "source", "relation", "target", "valid_from", "valid_to").distinct()
    bare = lambda c: F.regexp_replace(c, r"[()\n]", " ")
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("NONE"))
    out = F.concat_ws("<|>", F.concat(F.lit("("), bare("source")), bare("target"), bare("relation"), F.lit("true"), day("valid_from"), day("valid_to"), F.lit("claim"), F.lit("text)"))
    rows = f.select(F.col("fact_id").alias("row_id"), out.alias("output"))
    return extraction.parse_claims(extraction.records(rows)).drop("ord")


def _mentions(spark, root):
    sents = extraction.unit_sentences(table(spark, root, "text_units", "id", "text").distinct())
    known = table(spark, root, "gazetteer", "name", "type").unionByName(table(spark, root, "entities", "name", "type"))
    known = known.select("name", F.upper(F.coalesce("type", F.lit(""))).alias("type"))
    return sents, extraction.gazetteer_mentions(sents, known)


def gazetteer_mentions(spark, root):
    return _mentions(spark, root)[1].groupBy("unit_id", "name", "type").agg(F.count(F.lit(1)).alias("n_sentences"))


def cooccurrence_edges(spark, root):
    sents, ms = _mentions(spark, root)
    return extraction.cooccurrences(ms, sents)


def dated_claims(spark, root):
    sents, ms = _mentions(spark, root)
    return extraction.dated_claims(ms, sents)


def gleaning_missing(spark, root):
    r = table(spark, root, "relationships", "rel_id", "source", "target", "strength").distinct()
    first = r.where("strength >= 5")
    return extraction.missing_records(r, first, ["source", "target"]).groupBy("source").agg(F.count(F.lit(1)).alias("n_missing"))


def queries() -> dict:
    return {f.__name__: f for f in (
        token_count, truncate_tokens, analyze_terms, normalize_names, normalize_answers, clean_fields, between_markers, partial_dates, json_reply, term_overlap, sentence_split,
        chunk_fixed, chunk_sentences, parse_entities, parse_relationships, parse_claims, gazetteer_mentions, cooccurrence_edges, dated_claims, gleaning_missing,
    )}


SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def terms_sql(c: str) -> str:
    """DuckDB list of the analyzed words of c."""
    return (
        f"list_transform(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: w not in ({_STOP})), "
        "lambda w: case when length(w) > 4 and w like '%s' and w not like '%ss' then w[1:-2] else w end)"
    )


def tokens_sql(c: str) -> str:
    return f"cast(coalesce(ceil(len(regexp_extract_all({c}, '[^{SPACE}]+')) * 4 / 3.0), 0) as integer)"


_SENTS = r"""
with p as (select id as unit_id, text as t from (select distinct id, text from text_units) where text is not null),
""" + "q as (select unit_id, " + "".join("regexp_replace(" for _ in X.ABBREVIATIONS) + "t" + "".join(rf", '(^|[^A-Za-z]){a.replace('.', chr(92) + '.')}', '\1{a.replace('.', '․')}', 'g')" for a in X.ABBREVIATIONS) + r""" as t from p),
s0 as (select unit_id, string_split(regexp_replace(regexp_replace(t, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), '\n', chr(1), 'g'), chr(1)) as l from q),
s1 as (select unit_id, list_filter(list_transform(l, lambda s: regexp_replace(replace(s, '․', '.'), '^[""" + SPACE + r"""]+|[""" + SPACE + r"""]+$', '', 'g')), lambda s: length(s) > 0) as l from s0),
s2 as (select unit_id, unnest(l) as raw, unnest(range(len(l))) as sent from s1),
s as (select unit_id, cast(sent as integer) as sent, regexp_replace(array_to_string(regexp_extract_all(replace(raw, '**', ''), '[^""" + SPACE + r"""]+'), ' '), '^[#*>\- ]+|[#*>\- ]+$', '', 'g') as sentence from s2),
g as (select distinct name, upper(coalesce(type, '')) as type from (select name, type from gazetteer union all select name, type from entities) where len(regexp_extract_all(name, '[^\s.,;:!?()"'']+')) > 0),
mc as materialized (select unit_id, sent, name, type, sentence from s, g where sentence <> '' and instr(sentence, name) > 0),
m0 as materialized (select unit_id, sent, name, type, regexp_extract(sentence, '(?s)^(|.*?[^A-Za-z0-9_.])' || regexp_escape(name) || '([^A-Za-z0-9_]|$)', 1) as pre, regexp_matches(sentence, '(^|[^A-Za-z0-9_.])' || regexp_escape(name) || '([^A-Za-z0-9_]|$)') as alone from mc),
m as (select unit_id, sent, name, type, length(pre) + 1 as at from m0 where alone)
"""


def oracles() -> dict[str, str]:
    words = f"regexp_extract_all(text, '[^{SPACE}]+')"
    pieces = f"regexp_extract_all(text, '[{SPACE}]*[^{SPACE}]+')"
    title = "|".join(X.TITLES)
    punct = r"[!-/:-@\[-`{-~]"
    return {
        "token_count": f"select doc_id, {tokens_sql('text')} as n_tokens from documents",
        "truncate_tokens": f"select doc_id, md5(case when {tokens_sql('text')} <= 100 then text else array_to_string({words}[1:75], ' ') end) as cut_md5 from documents",
        "analyze_terms": f"""with t as (select doc_id, unnest({terms_sql('text')}) as term from documents)
            select doc_id, count(*) as n_terms, count(distinct term) as n_distinct, md5(string_agg(distinct term, ' ' order by term)) as terms_md5 from t group by doc_id""",
        "normalize_names": rf"""select distinct entity_id, regexp_replace(array_to_string(regexp_extract_all(regexp_replace(upper(name), '[''’]S\b', '', 'g'), '[A-Z0-9]+'), ' '), '^(({title})( |$))+', '') as normal from entities""",
        "normalize_answers": rf"""select distinct id, array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(answer), '{punct}', '', 'g'), '[^{SPACE}]+'), lambda w: w not in ('a', 'an', 'the')), ' ') as normal from questions""",
        "clean_fields": rf"""select distinct mention_id, regexp_replace(' "' || name || '" ', '^\s*"*''*\s*|\s*''*"*\s*$', '', 'g') as field,
            regexp_replace(translate(description || '|' || chr(10) || ' x ', '|' || chr(10), '/ '), '^[{SPACE}]+|[{SPACE}]+$', '', 'g') as cell,
            regexp_replace(array_to_string(regexp_extract_all(replace('## **' || description || '** -', '**', ''), '[^{SPACE}]+'), ' '), '^[#*>\- ]+|[#*>\- ]+$', '', 'g') as sentence from entity_mentions""",
        "between_markers": "select distinct mention_id, name as inner, '' as nothing from entity_mentions where name is not null",
        "partial_dates": """select distinct fact_id, case fact_id % 3 when 0 then strftime(date_trunc('year', valid_from), '%Y-%m-%d') when 1 then strftime(date_trunc('month', valid_from), '%Y-%m-%d')
            else strftime(valid_from, '%Y-%m-%d') end as day from facts where valid_from is not null""",
        "json_reply": "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events",
        "term_overlap": f"select distinct id, len(list_intersect(list_distinct({terms_sql('question')}), {terms_sql('coalesce(answer, chr(32))')})) as shared from questions",
        "sentence_split": r"""with p as (select doc_id, regexp_replace(text, '[^\x00-\x7f]', '~', 'g') as t from documents where text is not null),
            """ + "q as (select doc_id, " + "".join("regexp_replace(" for _ in X.ABBREVIATIONS) + "t" + "".join(rf", '(^|[^A-Za-z]){a.replace('.', chr(92) + '.')}', '\1{a.replace('.', '․')}', 'g')" for a in X.ABBREVIATIONS) + r""" as t from p),
            r as (select doc_id, unnest(string_split(regexp_replace(regexp_replace(t, '([.!?])([ \t\r\n\f])', '\1' || chr(1) || '\2', 'g'), '\n', chr(1), 'g'), chr(1))) as s from q),
            u as (select doc_id, regexp_replace(s, '^\s+|\s+$', '', 'g') as s from r)
            select doc_id, count(*) as n_sentences, cast(sum(length(s)) as bigint) as n_chars from u where length(s) > 0 group by doc_id""",
        "chunk_fixed": f"""with w as (select doc_id, {pieces} as w from documents), n as (select *, greatest(1, cast(ceil((len(w) - 50) / 250.0) as integer)) as k from w where len(w) > 0),
            c as (select doc_id, w, unnest(range(k)) as o from n),
            r as (select doc_id, cast(o as integer) as ord, w[o * 250 + 1 : o * 250 + 300] as part, length(array_to_string(w[1 : o * 250], '')) as before, array_to_string(w[o * 250 + 1 : o * 250 + 300], '') as raw from c)
            select doc_id || '-' || lpad(cast(ord as varchar), 3, '0') as unit_id, doc_id, ord, md5(regexp_replace(raw, '^[{SPACE}]+', '')) as text_md5, cast(ceil(len(part) * 4 / 3.0) as integer) as n_tokens,
              cast(before + length(raw) - length(regexp_replace(raw, '^[{SPACE}]+', '')) as integer) as start_char, cast(before + length(raw) as integer) as end_char from r""",
        "parse_entities": r"""select distinct mention_id as row_id, upper(regexp_replace(' "' || name || '" ', '^\s*"*''*\s*|\s*''*"*\s*$', '', 'g')) as name,
            upper(replace(regexp_replace(coalesce(type, 'event kind'), '^\s*"*''*\s*|\s*''*"*\s*$', '', 'g'), ' ', '_')) as type, regexp_replace(coalesce(description, 'none'), '^\s*"*''*\s*|\s*''*"*\s*$', '', 'g') || '<|>more' as description
            from entity_mentions where name is not null""",
        "parse_relationships": r"""with r as (select distinct rel_id, regexp_replace(source, '[()\n]', ' ', 'g') as s, regexp_replace(target, '[()\n]', ' ', 'g') as t, regexp_replace(coalesce(description, 'none'), '[()\n]', ' ', 'g') as d, strength
              from relationships where source is not null and target is not null and strength is not null),
            f as (select rel_id, upper(regexp_replace(s, '^\s*"*''*\s*|\s*''*"*\s*$', '', 'g')) as source, upper(regexp_replace(t, '^\s*"*''*\s*|\s*''*"*\s*$', '', 'g')) as target, regexp_replace(d, '^\s*"*''*\s*|\s*''*"*\s*$', '', 'g') as d, strength from r)
            select rel_id as row_id, source, target, case when rel_id % 5 = 0 then d || '<|>1.2.3' else d end as description,
              case when rel_id % 5 <= 1 then 1.0::double else abs(trunc(strength))::double end as strength from f where source <> '' and target <> ''""",
        "parse_claims": r"""with c as (select distinct fact_id, source, target, relation, valid_from, valid_to from facts), b as (select fact_id, regexp_replace(regexp_replace(source, '[()\n]', ' ', 'g'), '^\s*"*''*\s*|\s*''*"*\s*$', '', 'g') as s,
              regexp_replace(regexp_replace(target, '[()\n]', ' ', 'g'), '^\s*"*''*\s*|\s*''*"*\s*$', '', 'g') as t, regexp_replace(relation, '^\s*"*''*\s*|\s*''*"*\s*$', '', 'g') as r, valid_from, valid_to from c)
            select fact_id as row_id, upper(s) as subject, upper(t) as object, upper(r) as type, 'TRUE' as status, strftime(valid_from, '%Y-%m-%d') as start_date, strftime(valid_to, '%Y-%m-%d') as end_date, 'claim' as description, 'text' as source_text from b""",
        "gazetteer_mentions": _SENTS + "select unit_id, name, type, count(*) as n_sentences from m group by all",
        "cooccurrence_edges": _SENTS + rf""", d as (select distinct unit_id, sent, m."at", m.name from m), k as (select *, row_number() over (partition by unit_id, sent order by "at", name) as pos from d),
            pp as (select unit_id, sent, upper(a.name) as source, upper(b.name) as target, a."at" as x, b."at" as y, length(a.name) as len from k a join k b using (unit_id, sent) where a.pos < b.pos and b.pos <= 5),
            f as (select * from pp where not list_has_all(string_split(target, ' '), string_split(source, ' ')) and not list_has_all(string_split(source, ' '), string_split(target, ' ')))
            select source, target, max(least(10, 2 + case when regexp_matches(substr(sentence, x, y - x + 1), '{extraction.CUES}') then 6 else 0 end + case when y - (x + len) < 40 then 1 else 0 end)) as strength, count(*) as n from f join s using (unit_id, sent) group by all""",
        "dated_claims": _SENTS + rf""", k as (select *, row_number() over (partition by unit_id, sent order by "at", name) as pos from (select distinct unit_id, sent, m."at", m.name from m)),
            c as (select s.unit_id, s.sent, sentence, a.name as first, b.name as second, regexp_extract(sentence, '\b(?:({'|'.join(extraction.MONTHS)})\s+)?(20\d\d)\b', 0) as found from s join k a on a.unit_id = s.unit_id and a.sent = s.sent and a.pos = 1 left join k b on b.unit_id = s.unit_id and b.sent = s.sent and b.pos = 2)
            select unit_id, sent, upper(first) as subject, upper(coalesce(second, 'NONE')) as object, case when regexp_matches(sentence, 'acquir') then 'ACQUISITION' when regexp_matches(sentence, 'invest|raise|Series') then 'FUNDING'
              when regexp_matches(sentence, 'CTO|CEO|chief|Chief|director|Director') then 'LEADERSHIP' when regexp_matches(sentence, 'suppl') then 'SUPPLY' else 'EVENT' end as type,
              regexp_extract(found, '20\d\d', 0) || '-' || lpad(cast(greatest(1, coalesce(list_position({extraction.MONTHS!r}, regexp_extract(found, '^[A-Za-z]+', 0)), 1)) as varchar), 2, '0') || '-01' as start_date from c where found <> ''""",
        "gleaning_missing": """with r as (select distinct rel_id, source, target, strength from relationships), f as (select distinct source, target from r where strength >= 5)
            select source, count(*) as n_missing from r where not exists (select 1 from f where f.source = r.source and f.target = r.target) group by source""",
    }
