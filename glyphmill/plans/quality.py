"""Queries of gates, drop reasons, block roles, page neighbours and splits: each the operator on the test tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.functions import udfs
from glyphmill.functions.profile import STOPWORDS, profile
from glyphmill.operators import gates, pages
from glyphmill.plans.common import r6, read, sql_clean, sql_hits, sql_side, sql_tokens, sql_words
from glyphmill.plans.corpus import sql_blocks
from glyphmill.plans.dialogue import SQL_PAIRS, pairs, sql_anchors, sql_set_jaccard

#: As the reference configuration has it.
ALIGNED = gates.AlignedGate(0.25, 4.0, 3, 10, 0.5, 0.3, 0.3, 0.3, 0.5, 0.3, 0.4, 0.3, 1, 3, 80, 120, 600, 600, True, True)
OCR = gates.OcrGate()


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).select("conv_id", "turn", F.col("src").alias("src_sent"), F.col("tgt").alias("tgt_sent"))
    return gates.measured_pairs(p)


def aligned_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3, Q4, Q9: all flags of every pair."""
    m = measured(spark, sf_dir)
    return m.select("conv_id", "turn", F.array_join(gates.aligned_flags(ALIGNED), ";").alias("flags"), *[r6(F.col(c)).alias(c) for c in ("len_ratio", "align_score", "token_align_score")], F.col("tgt_sentence_ends").alias("ends"))


def ocr_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5, Q7, Q8, Q10, Q15: flags, tier, tranche and its rank, and score of every pair; odd conversations count as translated, every third as found by blocks alone."""
    m = measured(spark, sf_dir).withColumns({"flags": gates.ocr_flags(OCR), "grade": gates.tier()})
    translated, reason = F.col("conv_id") % 2 == 1, F.when(F.col("conv_id") % 3 == 0, "blocks_only").otherwise("metadata_and_blocks")
    doc, meta = F.col("align_score"), (F.col("conv_id") % 4).cast("double") / 2
    kind = gates.tranche(F.col("flags"), F.col("grade"), translated, F.lit("en"), reason, doc, meta)
    out = m.select("conv_id", "turn", F.array_join("flags", ";").alias("flags"), F.col("grade").alias("tier"), kind.alias("tranche"), r6(gates.quality_score(F.col("align_score"), doc, meta)).alias("quality_score"))
    return out.withColumn("tranche_rank", gates.tranche_rank(F.col("tranche")).cast("long"))


def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs go for each reason, and how many stay."""
    p = pairs(spark, sf_dir).select(X.clean(F.col("src")).alias("s"), X.clean(F.col("tgt")).alias("t"))
    p = p.withColumn("reason", F.coalesce(gates.drop_reason(F.col("s"), F.col("t"), udfs.apply("sentence_endings", F.col("t")), 600, 600, 4), F.lit("kept")))
    return p.groupBy("reason").agg(F.count("*").alias("n"))


def ambiguous_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, Q14: pairs whose source has several targets, or whose target has several sources; texts by their first word."""
    first = lambda c: F.lower(F.coalesce(F.get(X.tokens(F.col(c)), F.lit(0)), F.lit("")))
    p = pairs(spark, sf_dir).select("conv_id", "turn", first("src").alias("src_sent"), first("tgt").alias("tgt_sent"), F.array().cast("array<string>").alias("flags"))
    p = gates.ambiguous(gates.ambiguous(p, "src_multi_tgt", "src_sent", "tgt_sent", 1), "tgt_multi_src", "tgt_sent", "src_sent", 2)
    return p.select("conv_id", "turn", F.array_join("flags", ";").alias("flags"))


def text_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What audits count in texts, summed by source."""
    c = F.col("text")
    caps, titles, angles = gates.all_caps_tokens(c), gates.title_tokens(c), gates.unexpected_angles(c)
    d = read(spark, sf_dir, "documents").select("source", caps.alias("caps"), titles.alias("titles"), angles.alias("angles"), X.has_gap(c).cast("int").alias("gap"), X.has_determinative(c).cast("int").alias("det"), gates.hint_counts(c)[0].alias("hints"), *[v.alias(k) for k, v in gates.gap_runs(c).items()])
    return d.groupBy("source").agg(*[F.sum(k).cast("long").alias(k) for k in d.columns if k != "source"])


def length_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths by language: nearest-rank quantiles, population spread, share over a limit."""
    d = read(spark, sf_dir, "documents").select("lang", F.length(X.text_or_empty(F.col("text"))).cast("long").alias("n"))
    g = d.groupBy("lang").agg(F.count("*").alias("rows"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg((F.col("n") > 900).cast("double")).alias("over"), F.expr("percentile(n, array(0.5, 0.9, 0.95))").alias("q"))
    # the nearest rank, halves to even, of n values is percentile_disc at that rank
    rank = lambda q: F.bround((F.col("rows") - 1) * q).cast("long")
    wanted = g.select("lang", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), rank(q).alias("at")) for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95))])).alias("w")).select("lang", "w.*")
    counts = d.groupBy("lang", "n").agg(F.count("*").alias("k"))
    from pyspark.sql import Window

    running = counts.withColumn("upto", F.sum("k").over(Window.partitionBy("lang").orderBy("n")))
    met = wanted.join(running, "lang").where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("k") <= F.col("at"))).groupBy("lang").pivot("name", ["p50", "p90", "p95"]).agg(F.first("n"))
    return g.join(met, "lang").select("lang", "rows", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "least", "most", r6(F.col("over")).alias("over"), "p50", "p90", "p95")


def collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answers' distinct rate and mean length, and turns per conversation."""
    t = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    per = t.groupBy("conv_id").agg(F.count("*").alias("n")).agg(r6(F.percentile("n", F.lit(0.5))).alias("turns_p50"), r6(F.percentile("n", F.lit(0.9))).alias("turns_p90"), F.max("n").alias("turns_most"))
    whole = t.agg(F.count("*").alias("rows"), r6(F.count_distinct(X.clean(F.col("text"))) / F.count("*")).alias("distinct_rate"), r6(F.avg(F.length("text"))).alias("mean_len"))
    return whole.crossJoin(per)


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.blocks(F.col("text"))).alias("nth", "block"))


def block_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, markers and role of every block."""
    b = pages.classified(page_blocks(spark, sf_dir))
    return b.select("doc_id", F.col("nth").cast("long").alias("nth"), "lang", r6(F.col("marker_ratio")).alias("marker_ratio"), "english", F.coalesce("role", F.lit("")).alias("role"), r6(F.col("translation_score")).alias("translation_score"), r6(F.col("translit_score")).alias("translit_score"))


def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's counts, best scores and languages, and why it is a candidate; metadata as the document's number has it."""
    g = pages.page_scores(pages.classified(page_blocks(spark, sf_dir)), "doc_id")
    top, gap = (F.col("doc_id") % 5).cast("double") * 0.4, (F.col("doc_id") % 3).cast("double") * 0.1
    reason = gates.candidate_reason(F.col("n_translation"), F.col("n_translit"), F.col("doc_id") % 2 == 0, top, gap)
    return g.select("doc_id", "n_blocks", "n_english", "n_translation", "n_foreign", "n_translit", r6(F.col("translation_best")).alias("translation_best"), r6(F.col("translit_best")).alias("translit_best"), "lang_top", "lang_counts", F.coalesce(reason, F.lit("")).alias("reason"))


def page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns within two places; every third turn has one id, others by their conversation's parity."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.array(F.lit("x"))).when(F.col("turn") % 3 == 1, F.array(F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("ids"))
    return pages.page_context(t, "conv_id", "turn", "ids", 2).select(F.col("book").alias("conv_id"), "centre", F.col("page").alias("turn"))


def doc_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn the benchmark item, of four by its number, whose anchors overlap most with its own."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), X.anchors(F.col("text")).alias("anchors"))
    n = items.count()
    t = read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("block"), X.anchors(F.col("text")).alias("own"), F.array(*[(F.col("conv_id") * 7 + F.col("turn") + k) % n for k in range(4)]).alias("ids"))
    return pages.best_document(t, items, "block", "own", "ids").select("block", F.col("doc").cast("long").alias("doc"), r6(F.col("doc_score")).alias("doc_score"))


def block_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation, user's as sources, paired one to one with later answers."""
    t = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    src, tgt = t.where("role = 'user'"), t.where("role = 'assistant'")
    met = src.select("conv_id", F.col("turn").alias("source"), F.col("text").alias("s")).join(tgt.select("conv_id", F.col("turn").alias("target"), F.col("text").alias("t")), "conv_id")
    met = met.where(F.abs(F.col("target") - F.col("source")) <= 3).select("conv_id", "source", "target", r6(pages.pair_score(F.col("s"), F.col("t"))).alias("score"))
    return pages.paired_blocks(met, "conv_id")


QUERIES = {f.__name__: f for f in (aligned_gate, ocr_gate, drop_reasons, ambiguous_pairs, text_counters, length_report, collapse, block_roles, page_candidates, page_context, doc_match, block_pairing)}

# ---- SQL ----

_MEASURED = f"""{SQL_PAIRS}, sides as (select *, {sql_side('src', 's')}, {sql_side('tgt', 't')} from pairs),
m as (select *, s_len / greatest(t_len, 1) as len_ratio, least(s_len, t_len) / greatest(s_len, t_len, 1) as align_score, case when s_tokens > 0 and t_tokens > 0 then least(s_tokens, t_tokens) / greatest(s_tokens, t_tokens) else 0.0 end as token_align_score from sides)"""
_flags = lambda *checks: "concat_ws(';', " + ", ".join(f"case when {c} then '{k}' end" for k, c in checks) + ")"
_ALIGNED = _flags(
    ("empty_src", "s_len <= 0"), ("empty_tgt", "t_len <= 0"), ("len_ratio", "len_ratio < 0.25 or len_ratio > 4.0"), ("align_score", "align_score < 0.3"), ("token_align", "token_align_score < 0.3"), ("short_src", "s_tokens < 3"), ("long_src_tokens", "s_tokens > 120"), ("long_src_chars", "s_len > 600"),
    ("short_tgt", "t_len < 10"), ("short_tgt_tokens", "t_tokens < 3"), ("long_tgt_tokens", "t_tokens > 80"), ("long_tgt_chars", "t_len > 600"), ("low_alpha_src", "s_alpha < 0.5"), ("digit_heavy_src", "s_digit > 0.3"), ("symbol_heavy_src", "s_symbol > 0.4"), ("low_alpha_tgt", "t_alpha < 0.5"), ("digit_heavy_tgt", "t_digit > 0.3"),
    ("symbol_heavy_tgt", "t_symbol > 0.3"), ("multi_sentence_tgt", "t_ends > 1"), ("control_src", "s_control"), ("control_tgt", "t_control"), ("trailing_quote", "regexp_matches(rtrim(tgt), '[\"'']$')"), ("odd_quote", "(length(tgt) - length(replace(tgt, '\"', ''))) % 2 = 1"),
)
_OCR = _flags(
    ("empty_src", "s_len <= 0"), ("empty_tgt", "t_len <= 0"), ("len_ratio", "len_ratio < 0.2 or len_ratio > 5.0"), ("short_src", "s_tokens < 3"), ("short_tgt", "t_len < 20"), ("short_tgt_tokens", "t_tokens < 4"), ("long_tgt_tokens", "t_tokens > 80"), ("low_alpha_tgt", "t_alpha < 0.7"), ("symbol_heavy_tgt", "t_symbol > 0.2"), ("digit_heavy_tgt", "t_digit > 0.2"),
    ("symbol_heavy_src", "s_symbol > 0.5"), ("multi_sentence_tgt", "t_ends > 1"), ("low_stopword_tgt", "t_hits < 1"), ("broken_placeholder", "regexp_matches(regexp_replace(tgt, '(?i)<gap>|<big_gap>', '', 'g'), '[<>]')"), ("control_src", "s_control"), ("control_tgt", "t_control"),
)
_FIRST = lambda c: f"lower(coalesce(({sql_tokens(c)})[1], ''))"
_BLOCKS = f"blocks as (select doc_id, cast(i - 1 as bigint) as nth, x[i] as block from (select doc_id, x, unnest(range(1, len(x) + 1)) as i from (select doc_id, {sql_blocks('text')} as x from documents)))"
_STRIPPED = "list_filter(list_transform({t}, lambda t: trim(t, '.,;:!?()[]{{}}<>\"''')), lambda t: t <> '')".format(t=sql_tokens("block"))
_RANKED = "list_sort([" + ", ".join(f"{{'h': -h_{k}, 'k': '{k}'}}" for k in STOPWORDS) + "])"
_CLASSIFIED = f"""{_BLOCKS}, sided as (select *, {sql_side('block', 'b')}, {sql_words('block')} as w, {_STRIPPED} as st from blocks), hit as (select *, {', '.join(f"{sql_hits('w', k)} as h_{k}" for k in STOPWORDS)} from sided),
ranked as (select *, {_RANKED} as r, len(list_filter(st, lambda t: regexp_matches(t, '[0-9.\\-''ŠḪṢṬšḫṣṭ]') or (length(t) >= 2 and t = upper(t) and t <> lower(t)))) / greatest(len(st), 1) as marker_ratio from hit),
judged as (select *, case when r[1].h < 0 then r[1].k when b_alpha >= 0.72 and b_upper <= 0.28 then 'other' else 'unknown' end as lang, -r[1].h as best, (r[2].h - r[1].h) / greatest(b_tokens, 1) as confidence, b_symbol <= 0.2 and b_digit <= 0.2 and b_upper <= 0.4 and b_len >= 40 and b_tokens >= 6 as plain from ranked),
tested as (select *, plain and b_alpha >= 0.7 and b_hits >= 2 as english, plain and b_alpha >= 0.66 and (best >= 2 or lang = 'other' and b_alpha >= 0.75) as translation, b_len >= 10 and len(st) >= 3 and b_hits <= 2 and b_symbol <= 0.5 and (marker_ratio >= 0.35 or b_upper >= 0.35) as translit from judged),
classified as (select *, case when translit and (not english and not translation or translation and marker_ratio >= 0.35) then 'translit' when translation then 'translation' else '' end as role, b_alpha * 0.55 + least(best, 3) / 3 * 0.30 + confidence * 0.15 as translation_score, least(marker_ratio, 1.0) * 0.6 + least(b_upper, 1.0) * 0.4 as translit_score from tested)"""
_LEX = "trim(regexp_extract(text, '(?is)<LEX>(.*?)</LEX>', 1))"
_bare = lambda t: f"regexp_replace({t}, '^(?:\\{{[^}}]+\\}}|\\([^)]*\\))+', '')"

ORACLE_SQL = {
    "aligned_gate": f"with {_MEASURED} select conv_id, turn, {_ALIGNED} as flags, round(len_ratio, 6) as len_ratio, round(align_score, 6) as align_score, round(token_align_score, 6) as token_align_score, cast(t_ends as bigint) as ends from m",
    "ocr_gate": f"""with {_MEASURED}, g as (select *, {_OCR} as flags, case when align_score >= 0.55 and len_ratio between 0.5 and 2.2 and t_alpha >= 0.75 and t_symbol <= 0.12 and t_hits >= 2 then 'high' when align_score >= 0.4 and len_ratio between 0.35 and 3.0 and t_alpha >= 0.7 and t_symbol <= 0.18 and t_hits >= 1 then 'med' else 'low' end as tier, (conv_id % 4) / 2 as meta from m),
k as (select *, case when flags <> '' then 'T5' when tier = 'high' and conv_id % 2 = 0 and conv_id % 3 <> 0 and align_score >= 0.12 and meta >= 1.0 then 'T1' when tier = 'high' and conv_id % 2 = 0 then 'T2' when tier in ('high', 'med') and conv_id % 2 = 1 then 'T3' when tier = 'med' then 'T4' else 'T5' end as tranche from g)
select conv_id, turn, flags, tier, tranche, round(align_score + align_score * 0.35 + meta * 0.1, 6) as quality_score, cast(substr(tranche, 2, 1) as bigint) as tranche_rank from k""",
    "drop_reasons": f"with {SQL_PAIRS}, c as (select {sql_clean('src')} as src, {sql_clean('tgt')} as tgt from pairs), sided as (select *, {sql_side('tgt', 't')} from c) select case when src = '' or tgt = '' then 'empty' when length(src) > 600 or length(tgt) > 600 then 'length' when t_ends > 4 then 'sentence' else 'kept' end as reason, count(*) as n from sided group by reason",
    "ambiguous_pairs": f"with {SQL_PAIRS}, f as (select conv_id, turn, {_FIRST('src')} as s, {_FIRST('tgt')} as t from pairs), a as (select s, count(distinct t) as n from f group by s), b as (select t, count(distinct s) as m from f group by t) select conv_id, turn, concat_ws(';', case when n > 1 then 'src_multi_tgt' end, case when m > 2 then 'tgt_multi_src' end) as flags from f join a using (s) join b using (t)",
    "text_counters": f"""with d as (select source, text, {sql_tokens('text')} as tk, regexp_extract_all(text, '(?i)(?:^|[^A-Z0-9])(x{{2,}})(?:$|[^A-Z0-9])', 1) as xr, regexp_extract_all(text, '(?i)(?:^|[^A-Z0-9])(x(?:[\\s-]+x)+)(?:$|[^A-Z0-9])', 1) as xt, regexp_extract_all(text, '\\[[xX.\\s?…]+\\]') as br from documents)
select source, cast(sum(len(list_filter(tk, lambda t: regexp_matches(t, '\\p{{Lu}}.*\\p{{Lu}}') and t = upper(t)))) as bigint) as caps, cast(sum(len(list_filter(tk, lambda t: regexp_matches({_bare('t')}, '^[^\\p{{L}}]*\\p{{Lu}}') and regexp_matches({_bare('t')}, '\\p{{Ll}}')))) as bigint) as titles,
cast(sum(len(regexp_extract_all(regexp_replace(text, '<gap>|<big_gap>', '', 'g'), '[<>]'))) as bigint) as angles, cast(sum(cast(regexp_matches(text, '<gap>|<big_gap>') as int)) as bigint) as gap, cast(sum(cast(regexp_matches(text, '\\{{[^}}]+\\}}') as int)) as bigint) as det, cast(sum(case when {_LEX} = '' then 0 else len(string_split({_LEX}, '|')) end) as bigint) as hints,
cast(sum(len(list_filter(xr, lambda m: length(m) >= 4))) as bigint) as x_run_big, cast(sum(len(list_filter(xr, lambda m: length(m) < 4))) as bigint) as x_run_gap, cast(sum(len(list_filter(xt, lambda m: len(regexp_extract_all(m, '[xX]')) >= 4))) as bigint) as x_tokens_big, cast(sum(len(list_filter(xt, lambda m: len(regexp_extract_all(m, '[xX]')) < 4))) as bigint) as x_tokens_gap,
cast(sum(len(list_filter(br, lambda m: regexp_matches(m, '…|\\.{{3}}') or len(regexp_extract_all(m, '[xX]')) >= 4))) as bigint) as bracket_big, cast(sum(len(list_filter(br, lambda m: not (regexp_matches(m, '…|\\.{{3}}') or len(regexp_extract_all(m, '[xX]')) >= 4)))) as bigint) as bracket_gap from d group by source""",
    "length_report": "with d as (select lang, length(text) as n from documents), o as (select *, row_number() over (partition by lang order by n) - 1 as i, count(*) over (partition by lang) as rows from d) select lang, count(*) as rows, round(avg(n), 6) as mean, round(stddev_pop(n), 6) as std, min(n) as least, max(n) as most, round(avg(cast(n > 900 as int)), 6) as over, "
    + ", ".join(f"max(n) filter (i = cast(round_even((rows - 1) * {q}, 0) as bigint)) as {k}" for k, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95)))
    + " from o group by lang",
    "collapse": f"with t as (select * from conversations where role = 'assistant'), per as (select conv_id, count(*) as n from t group by conv_id), p as (select round(quantile_cont(n, 0.5), 6) as turns_p50, round(quantile_cont(n, 0.9), 6) as turns_p90, max(n) as turns_most from per), w as (select count(*) as rows, round(count(distinct {sql_clean('text')}) / count(*), 6) as distinct_rate, round(avg(length(text)), 6) as mean_len from t) select * from w, p",
    "block_roles": f"with {_CLASSIFIED} select doc_id, nth, lang, round(marker_ratio, 6) as marker_ratio, english, role, round(translation_score, 6) as translation_score, round(translit_score, 6) as translit_score from classified",
    "page_candidates": f"""with {_CLASSIFIED}, langs as (select doc_id, string_agg(lang || ':' || n, '|' order by n desc, lang) as lang_counts, first(lang order by n desc, lang) as lang_top from (select doc_id, lang, count(*) as n from classified where role = 'translation' group by all) group by doc_id),
g as (select doc_id, count(*) as n_blocks, count(*) filter (english) as n_english, count(*) filter (role = 'translation') as n_translation, count(*) filter (role = 'translation' and lang <> 'en') as n_foreign, count(*) filter (role = 'translit') as n_translit, round(coalesce(max(translation_score) filter (role = 'translation'), 0.0), 6) as translation_best, round(coalesce(max(translit_score) filter (role = 'translit'), 0.0), 6) as translit_best from classified group by doc_id)
select g.*, coalesce(lang_top, 'unknown') as lang_top, coalesce(lang_counts, '') as lang_counts, case when n_translation >= 1 and n_translit >= 1 then case when (doc_id % 5) * 0.4 >= 0.95 then 'metadata_and_blocks' else 'blocks_only' end when (doc_id % 5) * 0.4 >= 1.25 and (doc_id % 3) * 0.1 >= 0.1 and n_translation >= 1 then 'metadata_only' else '' end as reason from g left join langs using (doc_id)""",
    "page_context": "with t as (select conv_id, turn, case turn % 3 when 0 then ['x'] when 1 then ['y'] else [] end as ids, row_number() over (partition by conv_id order by turn) as k from conversations) select a.conv_id, a.turn as centre, b.turn as turn from t a join t b on a.conv_id = b.conv_id and abs(a.k - b.k) <= 2 and abs(a.turn - b.turn) <= 2 where a.k = b.k or len(a.ids) = 0 or len(b.ids) = 0 or len(list_intersect(a.ids, b.ids)) > 0",
    "doc_match": f"""with i as (select item_id, {sql_anchors('text')} as theirs from benchmark), t as (select conv_id || '-' || turn as block, {sql_anchors('text')} as own, unnest(range(4)) as nth, conv_id * 7 + turn as base from conversations),
m as (select block, item_id as doc, nth, {sql_set_jaccard('own', 'theirs')} as s from t join i on item_id = (base + nth) % (select count(*) from benchmark)), r as (select *, row_number() over (partition by block order by s desc, nth) as k from m where s > 0) select block, cast(doc as bigint) as doc, round(s, 6) as doc_score from r where k = 1""",
}
