"""Queries over documents and pages: statistics, gates, language and role of texts, cleaning, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.functions import udfs
from glyphmill.functions.profile import ENGLISH, profile, ratios
from glyphmill.operators import lexicon, pages
from glyphmill.operators.ordering import first_by
from glyphmill.plans.common import STATS, r6, read, sql_bare, sql_clean, sql_hits, sql_tokens, sql_words

#: Limits of the document gate (Q3, Q5): a text outside one of them carries its flag.
LEAST_TOKENS, MOST_CHARS, LEAST_ALPHA, MOST_DIGIT, MOST_SYMBOL, MOST_UPPER = 8, 5000, 0.75, 0.05, 0.20, 0.30


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("_p", profile(F.col("text"), words=False))
    return docs.select("*", "_p.len", "_p.tokens", *[c.alias(k) for k, c in ratios(F.col("_p")).items()]).drop("_p")


def doc_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, Q2."""
    return measured(spark, sf_dir).select("doc_id", "len", "tokens", *[r6(F.col(c)).alias(c) for c in ("alpha_ratio", "digit_ratio", "symbol_ratio", "upper_ratio")])


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measured(spark, sf_dir)
    found = X.flags(
        ("short", F.col("tokens") < LEAST_TOKENS),
        ("long", F.col("len") > MOST_CHARS),
        ("low_alpha", F.col("alpha_ratio") < LEAST_ALPHA),
        ("high_digit", F.col("digit_ratio") > MOST_DIGIT),
        ("high_symbol", F.col("symbol_ratio") > MOST_SYMBOL),
        ("high_upper", F.col("upper_ratio") > MOST_UPPER),
        ("odd_quote", F.regexp_count(X.text_or_empty(F.col("text")), F.lit('"')) % 2 == 1),
        ("trailing_quote", X.text_or_empty(F.col("text")).rlike(r"[\"'][ ]*$")),
        ("control", X.text_or_empty(F.col("text")).rlike(r"[\x00-\x08\x0E-\x1B]")),
        ("broken_placeholder", F.regexp_replace(X.text_or_empty(F.col("text")), "<gap>|<big_gap>", "").rlike("[<>]")),
    )
    return m.withColumn("flags", found)


SQL_FLAGS = f"""case when tokens < {LEAST_TOKENS} then 'short' end, case when len > {MOST_CHARS} then 'long' end, case when alpha < {LEAST_ALPHA} then 'low_alpha' end,
  case when digit > {MOST_DIGIT} then 'high_digit' end, case when symbol > {MOST_SYMBOL} then 'high_symbol' end, case when upper_share > {MOST_UPPER} then 'high_upper' end,
  case when len(regexp_extract_all(text, '"')) % 2 = 1 then 'odd_quote' end, case when regexp_matches(text, '["''][ ]*$') then 'trailing_quote' end,
  case when regexp_matches(text, '[\\x00-\\x08\\x0E-\\x1B]') then 'control' end, case when regexp_matches(regexp_replace(text, '<gap>|<big_gap>', '', 'g'), '[<>]') then 'broken_placeholder' end"""


def doc_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3-Q5, Q11-Q13."""
    return flagged(spark, sf_dir).select("doc_id", F.array_join("flags", ";").alias("flags"))


def flag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    return flagged(spark, sf_dir).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without flags by language, and their share."""
    return flagged(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.size("flags") == 0).alias("n_clean"), r6(F.avg((F.size("flags") == 0).cast("double"))).alias("clean_rate"))


def series_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length profile by language."""
    docs = read(spark, sf_dir, "documents").select("lang", F.length("text").alias("n"))
    q = F.percentile("n", F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    g = docs.groupBy("lang").agg(F.count("*").alias("rows"), F.min("n").cast("long").alias("least"), F.max("n").cast("long").alias("most"), r6(F.avg("n")).alias("mean"), r6(F.stddev_pop("n")).alias("std"), r6(F.avg((F.col("n") > 512).cast("double"))).alias("over_limit"), q.alias("q"))
    return g.select("lang", "rows", "least", "most", "mean", "std", "over_limit", *[r6(F.col("q")[i]).alias(f"p{p}") for i, p in enumerate((50, 90, 95, 99))])


def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty rate, unique ratio and average share of distinct tokens by source."""
    t = X.tokens(F.col("text"))
    docs = read(spark, sf_dir, "documents").select("source", "text", (F.size(F.array_distinct(t)) / F.greatest(F.size(t), F.lit(1))).alias("u"))
    return docs.groupBy("source").agg(F.count("*").alias("rows"), r6(F.avg((F.trim(X.text_or_empty(F.col("text"))) == "").cast("double"))).alias("empty_rate"), r6(F.countDistinct("text") / F.count("*")).alias("unique_ratio"), r6(F.avg("u")).alias("unique_tokens"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1."""
    return read(spark, sf_dir, "documents").select("doc_id", X.clean(F.col("text")).alias("text"))


def gap_and_caps_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10-A12."""
    t = X.tokens(F.col("text"))
    docs = read(spark, sf_dir, "documents").select("source", F.col("text").rlike("<gap>|<big_gap>").cast("double").alias("gap"), F.size(F.filter(t, lambda x: x.rlike("^[A-Z]{2,}[.,;:!?]*$"))).alias("caps"), F.size(t).alias("n"), F.length("text").alias("len"))
    return docs.groupBy("source").agg(r6(F.avg("gap")).alias("gap_rate"), r6(F.sum("caps") / F.greatest(F.sum("n"), F.lit(1))).alias("caps_rate"), r6(F.avg("len")).alias("avg_len"))


def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each block."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.blocks(F.col("text"))).alias("block", "text")).select("doc_id", F.col("block").cast("long").alias("block"), "text")


def sentence_endings_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N3 without protection."""
    return read(spark, sf_dir, "documents").select("doc_id", X.sentence_endings(F.col("text")).cast("long").alias("n_endings"))


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(udfs.apply("split_sentences", F.col("text"))).alias("sentence", "text"))


def languages(docs: DataFrame) -> DataFrame:
    d = docs.withColumn("_p", profile(F.col("text")))
    d = d.select("*", "_p.len", "_p.tokens", "_p.words", "_p.hits_english", *[F.col(f"_p.hits_{k}") for k in X.STOPWORDS], *[c.alias(k) for k, c in ratios(F.col("_p")).items()]).drop("_p")
    name, confidence = X.language_of({k: F.col(f"hits_{k}") for k in X.STOPWORDS}, F.col("tokens"), F.col("alpha_ratio"), F.col("upper_ratio"))
    return d.select("*", name.alias("detected"), confidence.alias("confidence"))


def stopword_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1-B3."""
    return languages(read(spark, sf_dir, "documents")).select("doc_id", "lang", "detected", r6(F.col("confidence")).alias("confidence"), *[f"hits_{k}" for k in X.STOPWORDS])


def sql_languages() -> str:
    names = list(X.STOPWORDS)
    hits = ", ".join(f"{sql_hits('w', k)} as hits_{k}" for k in names)
    ranked = "list_sort([" + ", ".join(f"{{'h': -hits_{k}, 'k': '{k}'}}" for k in names) + "])"
    return f"""{STATS}, worded as (select *, {sql_words('text')} as w from stats), hit as (select *, {hits}, {sql_hits('w', 'english')} as hits_english from worded), ranked as (select *, {ranked} as r from hit),
languages as (select *, case when r[1].h < 0 then r[1].k when alpha >= 0.72 and upper_share <= 0.28 then 'other' else 'unknown' end as detected,
  case when r[1].h < 0 then (r[2].h - r[1].h) / greatest(tokens, 1) else 0.0 end as confidence from ranked)"""


def translation_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4-B6."""
    d = languages(read(spark, sf_dir, "documents"))
    best = F.greatest(*[F.col(f"hits_{k}") for k in X.STOPWORDS])
    score = X.translation_score(F.col("alpha_ratio"), best, F.col("confidence"))
    like = (F.col("tokens") >= 8) & (F.col("alpha_ratio") >= 0.6) & (F.col("digit_ratio") <= 0.2) & (F.col("upper_ratio") <= 0.4) & ((best >= 2) | (F.col("detected") == "other"))
    return d.select("doc_id", r6(score).alias("translation_score"), r6(X.english_score(F.col("alpha_ratio"), F.col("hits_english"))).alias("english_score"), like.alias("is_translation"))


def translit_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7, B8, B10."""
    d = measured(spark, sf_dir)
    marks = X.marker_ratio(F.col("text"))
    return d.select("doc_id", r6(marks).alias("marker_ratio"), r6(F.greatest(marks, F.col("upper_ratio"))).alias("translit_score"), ((marks >= 0.35) | (F.col("upper_ratio") >= 0.35)).alias("is_translit"))


DROPPED = (r"^\s*\d{1,4}\s*$", r"^\s*(?:page|seite|p\.)\s*\d+\s*$", r"(?i)all rights reserved|copyright|license")
REMOVED = (r"\[\d{1,3}\]", r"https?://\S+")


def page_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of B11 with five rules of our own, not the reference's table: lines dropped, parts removed, and what stays. A14 is two counters of 18."""
    lines = F.split(X.text_or_empty(F.col("text")), "\n")
    d = read(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    d = d.withColumn("kept", F.filter("lines", lambda x: ~x.rlike("|".join(f"(?:{p})" for p in DROPPED))))
    joined = F.array_join("kept", "\n")
    d = d.select("doc_id", (F.size("lines") - F.size("kept")).cast("long").alias("lines_dropped"), F.regexp_count(joined, F.lit("|".join(REMOVED))).cast("long").alias("parts_removed"), joined.alias("j"))
    return d.select("doc_id", "lines_dropped", "parts_removed", X.clean(F.regexp_replace("j", "|".join(REMOVED), "")).alias("text"))


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, tag step."""
    return read(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("html"))


def template_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once after normalisation, by frequency."""
    d = read(spark, sf_dir, "documents").select(F.lower(X.clean(F.col("text"))).alias("t"))
    return d.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select(F.md5("t").alias("template"), "n")


def pair_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text and language."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat_ws("\t", "lang", X.clean(F.col("text")))).alias("pair_hash"))
    return first_by(d, ["pair_hash"], [F.asc("doc_id")])


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns absent from one side are null."""
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang").unionByName(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), allowMissingColumns=True)


def translation_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of other languages than English, one row for each distinct block, first seen first."""
    d = read(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id", "lang", "source", F.posexplode(X.blocks(F.col("text"))).alias("block", "text"))
    d = d.withColumn("block_hash", F.md5("text"))
    least = F.struct("doc_id", "block")
    g = d.groupBy("block_hash").agg(F.count("*").alias("occurrences"), F.min_by(F.struct("lang", "source", "doc_id", F.col("block").cast("long").alias("block")), least).alias("f"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))
    return g.select("block_hash", "occurrences", "sources", "f.lang", "f.source", "f.doc_id", "f.block")


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title): documents as pages of books named after parts; a document belongs to the part of its number."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), "p_brand").alias("title"))
    return parts.join(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", "leftsemi")


def part_keys(spark: SparkSession, sf_dir: str, make=pages.catalogue) -> DataFrame:
    """The parts' names with sizes, and brands, as keys of a catalogue."""
    fields = {"name": F.concat_ws(" ", "p_name", F.col("p_size").cast("string")), "brand": F.col("p_brand")}
    return make(read(spark, sf_dir, "part"), "p_partkey", fields)


def metadata_signature_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key of the parts' catalogue with its tokens and its rarest token that is no number."""
    return part_keys(spark, sf_dir).select(F.col("entry").alias("p_partkey"), "field", F.array_join("tokens", " ").alias("tokens"), "signature")


def metadata_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the parts whose keys they or their titles hold whole: the best five, and how far the second lies behind."""
    keys = part_keys(spark, sf_dir, pages.catalogue_keys)
    found = pages.hits(read(spark, sf_dir, "documents").select("doc_id", "text"), filed(spark, sf_dir), keys, "doc_id", "text", "title", top=5)
    return pages.hit_summary(found, 5).withColumnRenamed("page", "doc_id")


def placeholder_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the commonest words of their language as placeholders, and restored."""
    forms = lexicon.compiled({"PN": [w.capitalize() for w in X.STOPWORDS["en"]] + list(X.STOPWORDS["en"]), "GN": list(X.STOPWORDS["fr"])})

    @F.pandas_udf("text string, n_marks long, restored boolean")
    def run(texts):
        import pandas as pd

        rows = []
        for t in texts:
            new, pairs = lexicon.placeholders(t, forms)
            rows.append((new, len(pairs), lexicon.restored(new, pairs) == " ".join((t or "").split())))
        return pd.DataFrame(rows, columns=["text", "n_marks", "restored"])

    return read(spark, sf_dir, "documents").select("doc_id", run("text").alias("r")).select("doc_id", "r.*")


def slot_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and units as slots."""

    @F.pandas_udf("text string, n_slots long")
    def run(texts):
        import pandas as pd

        found = [lexicon.number_slots(t) for t in texts]
        return pd.DataFrame({"text": [a for a, _ in found], "n_slots": [len(b) for _, b in found]})

    return read(spark, sf_dir, "documents").select("doc_id", run("text").alias("r")).select("doc_id", "r.*")


def normalized_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in variants A, B and C."""
    docs = read(spark, sf_dir, "documents").select("doc_id", udfs.transliterations(F.col("text")).alias("v"))
    return docs.select("doc_id", F.explode(F.create_map(*[x for v in "ABC" for x in (F.lit(v), F.col(f"v.{v}"))])).alias("variant", "text"))


def normalized_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one normalised sentence each."""
    return read(spark, sf_dir, "documents").select("doc_id", udfs.apply("single_sentence", udfs.apply("normalize_output", F.col("text"))).alias("text"))


def lines_of(d: str) -> str:
    return f"list_filter(string_split({d}, chr(10)), lambda x: not regexp_matches(x, '{'|'.join(f'(?:{p})' for p in DROPPED)}'))"


def sql_blocks(text: str) -> str:
    s = f"regexp_replace({text}, '\\r\\n|\\r', chr(10), 'g')"
    flat = lambda parts: f"list_filter(list_transform({parts}, lambda p: {sql_clean('p')}), lambda p: p <> '')"
    wide, narrow = flat(f"regexp_split_to_array({s}, '\\n{{2,}}')"), flat(f"string_split({s}, chr(10))")
    return f"case when len({wide}) <= 1 then {narrow} else {wide} end"


_STRIPPED = "list_filter(list_transform({t}, lambda t: trim(t, '.,;:!?()[]{{}}<>\"''')), lambda t: t <> '')".format(t=sql_tokens("text"))
_HITS = ", ".join(f"hits_{k}" for k in X.STOPWORDS)
_MARKS = "len(list_filter(st, lambda t: regexp_matches(t, '[0-9.\\-''ŠḪṢṬšḫṣṭ]') or (length(t) >= 2 and t = upper(t) and t <> lower(t)))) / greatest(len(st), 1)"

_LOOKUP = lambda c: f"list_filter(string_split(regexp_replace(upper({c}), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"
_CATALOGUE = f"""parts as (select p_partkey as entry, 'name' as field, p_name || ' ' || p_size as raw from part union all select p_partkey, 'brand', p_brand from part), forms as (select * from (select *, {_LOOKUP('raw')} as t from parts) where len(t) between 1 and 6 and regexp_matches(raw, '[0-9]') and (len(t) > 2 or len(list_filter(t, lambda x: regexp_matches(x, '[A-Z]') and regexp_matches(x, '[0-9]'))) > 0)),
token as (select entry, field, unnest(list_distinct(t)) as x from forms), freq as (select x, count(*) as f from token group by x),
signed as (select entry, field, x as signature from (select *, row_number() over (partition by entry, field order by regexp_matches(x, '^[0-9]+$'), f, length(x), x) as k from token join freq using (x)) where k = 1),
keyed as (select entry, field, raw, t, array_to_string(t, ' ') as tokens, signature from forms join signed using (entry, field))"""

QUERIES = {f.__name__: f for f in (doc_text_stats, doc_quality_flags, flag_histogram, clean_rows, series_quantiles, text_profile, clean_text, gap_and_caps_rates, block_split, sentence_endings_naive, sentence_rows, stopword_language_id, translation_like, translit_like, page_cleaning, html_strip, template_counts, pair_dedupe, union_by_name, translation_jobs, metadata_signature_index, metadata_hits, placeholder_restore, slot_numbers, normalized_variants, normalized_output)}

ORACLE_SQL = {
    "doc_text_stats": f"with {STATS} select doc_id, len, cast(tokens as bigint) as tokens, round(alpha, 6) as alpha_ratio, round(digit, 6) as digit_ratio, round(symbol, 6) as symbol_ratio, round(upper_share, 6) as upper_ratio from stats",
    "doc_quality_flags": f"with {STATS} select doc_id, concat_ws(';', {SQL_FLAGS}) as flags from stats",
    "flag_histogram": f"with {STATS}, f as (select unnest(list_filter([{SQL_FLAGS}], lambda x: x is not null)) as flag from stats) select flag, count(*) as n from f group by flag",
    "clean_rows": f"with {STATS}, f as (select lang, concat_ws(';', {SQL_FLAGS}) = '' as ok from stats) select lang, count(*) as n, count(*) filter (ok) as n_clean, round(avg(cast(ok as int)), 6) as clean_rate from f group by lang",
    "series_quantiles": "with d as (select lang, length(text) as n from documents) select lang, count(*) as rows, min(n) as least, max(n) as most, round(avg(n), 6) as mean, round(stddev_pop(n), 6) as std, round(avg(cast(n > 512 as int)), 6) as over_limit, "
    + ", ".join(f"round(quantile_cont(n, {p / 100}), 6) as p{p}" for p in (50, 90, 95, 99))
    + " from d group by lang",
    "text_profile": f"with d as (select source, text, len(list_distinct({sql_tokens('text')})) / greatest(len({sql_tokens('text')}), 1) as u from documents) select source, count(*) as rows, round(avg(cast(trim(text) = '' as int)), 6) as empty_rate, round(count(distinct text) / count(*), 6) as unique_ratio, round(avg(u), 6) as unique_tokens from d group by source",
    "clean_text": f"select doc_id, {sql_clean('text')} as text from documents",
    "gap_and_caps_rates": f"with d as (select source, cast(regexp_matches(text, '<gap>|<big_gap>') as int) as gap, {sql_tokens('text')} as t, length(text) as n from documents) select source, round(avg(gap), 6) as gap_rate, round(sum(len(list_filter(t, lambda x: regexp_matches(x, '^[A-Z]{{2,}}[.,;:!?]*$')))) / greatest(sum(len(t)), 1), 6) as caps_rate, round(avg(n), 6) as avg_len from d group by source",
    "block_split": f"with b as (select doc_id, {sql_blocks('text')} as x from documents) select doc_id, cast(i - 1 as bigint) as block, x[i] as text from (select doc_id, x, unnest(range(1, len(x) + 1)) as i from b)",
    "sentence_endings_naive": "select doc_id, cast(len(regexp_extract_all(text, '[.!?]+')) as bigint) as n_endings from documents",
    "stopword_language_id": f"with {sql_languages()} select doc_id, lang, detected, round(confidence, 6) as confidence, {_HITS} from languages",
    "translation_like": f"with {sql_languages()} select doc_id, round(alpha * 0.55 + least(greatest({_HITS}), 3) / 3 * 0.30 + confidence * 0.15, 6) as translation_score, round(alpha * 0.7 + least(hits_english, 3) / 3 * 0.3, 6) as english_score, tokens >= 8 and alpha >= 0.6 and digit <= 0.2 and upper_share <= 0.4 and (greatest({_HITS}) >= 2 or detected = 'other') as is_translation from languages",
    "translit_like": f"with {STATS}, s as (select *, {_STRIPPED} as st from stats), m as (select *, {_MARKS} as marks from s) select doc_id, round(marks, 6) as marker_ratio, round(greatest(marks, upper_share), 6) as translit_score, marks >= 0.35 or upper_share >= 0.35 as is_translit from m",
    "page_cleaning": f"with l as (select doc_id, len(string_split(text, chr(10))) as n, {lines_of('text')} as kept from documents), j as (select doc_id, n - len(kept) as dropped, array_to_string(kept, chr(10)) as j from l) select doc_id, dropped as lines_dropped, cast(len(regexp_extract_all(j, '{'|'.join(REMOVED)}')) as bigint) as parts_removed, {sql_clean(f'''regexp_replace(j, '{'|'.join(REMOVED)}', '', 'g')''')} as text from j",
    "html_strip": "select page_id, regexp_replace(html, '(?i)</?(sup|sub|br|i|b|u|em|strong|span)(\\s[^>]*)?>', '', 'g') as html from pages",
    "template_counts": f"with d as (select lower({sql_clean('text')}) as t from documents) select md5(t) as template, count(*) as n from d group by t having count(*) > 1",
    "pair_dedupe": f"with d as (select doc_id, md5(lang || chr(9) || {sql_clean('text')}) as pair_hash from documents) select min(doc_id) as doc_id, pair_hash from d group by pair_hash",
    "union_by_name": "select cast(doc_id as varchar) as doc_id, text, lang, null::varchar as item_id from documents union all select null, text, null, cast(item_id as varchar) from benchmark",
    "translation_jobs": f"with b as (select doc_id, lang, source, {sql_blocks('text')} as x from documents where lang <> 'en'), r as (select *, i - 1 as block, md5(x[i]) as block_hash from (select *, unnest(range(1, len(x) + 1)) as i from b)), f as (select *, row_number() over (partition by block_hash order by doc_id, block) as k from r) select block_hash, count(*) as occurrences, array_to_string(list_sort(list(distinct source)), '|') as sources, max(lang) filter (k = 1) as lang, max(source) filter (k = 1) as source, max(doc_id) filter (k = 1) as doc_id, max(block) filter (k = 1) as block from f group by block_hash",
    "metadata_signature_index": f"with {_CATALOGUE} select entry as p_partkey, field, tokens, signature from keyed",
    "metadata_hits": f"""with {_CATALOGUE}, titled as (select doc_id, text, coalesce(p_name || ' ' || p_size || ' ' || p_brand, '') as title from documents left join part on p_partkey = doc_id),
docs as (select doc_id, list_distinct({_LOOKUP('strip_accents(text)')}) as in_page, list_distinct({_LOOKUP('title')}) as in_title from titled), probe as (select doc_id, in_page, in_title, unnest(list_distinct(list_concat(in_page, in_title))) as signature from docs),
met as (select doc_id, entry, field, raw, t, len(list_filter(t, lambda x: not list_contains(in_page, x))) = 0 as page_hit, len(list_filter(t, lambda x: not list_contains(in_title, x))) = 0 as title_hit from probe join keyed using (signature)),
scored as (select *, round(case when title_hit then 1.0 else 0.0 end + case when page_hit then 0.75 else 0.0 end + case when len(t) >= 3 then 0.15 else 0.0 end + case when len(list_filter(t, lambda x: regexp_matches(x, '[A-Z]') and regexp_matches(x, '[0-9]'))) > 0 then 0.1 else 0.0 end, 6) as score from met where (page_hit or title_hit) and (len(t) > 2 or title_hit)),
best as (select * from (select *, row_number() over (partition by doc_id, entry order by score desc, field, raw) as k from scored) where k = 1), ranked as (select * from (select *, row_number() over (partition by doc_id order by score desc, entry) as nth from best) where nth <= 5)
select doc_id, string_agg(cast(entry as varchar), '|' order by nth) as entries, count(*) as n_hits, max(score) as top_score, coalesce(max(score) filter (nth = 2), 0.0) as second_score, round(max(score) - coalesce(max(score) filter (nth = 2), 0.0), 6) as score_gap, count(*) filter (title_hit) as n_title, count(*) filter (page_hit) as n_page from ranked group by doc_id""",
}
