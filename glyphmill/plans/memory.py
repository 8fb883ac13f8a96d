"""Queries over pools of candidates, a memory of pairs, and aligned documents (R6-R16, D5-D11, A18, W11, W12, DP2-DP7, S9, X2-X13, G1, V2, O10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.functions.profile import STOPWORDS
from glyphmill.operators import align, candidates, gates, mixing, pages, slots
from glyphmill.plans.common import r6, read, sql_tokens
from glyphmill.plans.dialogue import SQL_PAIRS, pairs
from glyphmill.plans.search import _CANDIDATES, sql_neighbours
from glyphmill.plans.search import candidates as nearest
from glyphmill.plans.search import items

WEIGHTS = [0.0, 0.5, 1.0]


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, translation, tag, rank, row, fwd, rev): the items near each item, halved by tag; scores that a model would give stand in: lengths and similarity."""
    c = nearest(spark, sf_dir)
    rank = F.col("rank").cast("long")
    return c.select(F.col("query").alias("id"), F.substring("text", 1, 40).alias("translation"), F.when(rank % 2 == 1, "odd").otherwise("even").alias("tag"), rank.alias("rank"), (F.col("query") * 10 + rank).alias("row"), (-F.length("text") / 100.0).alias("fwd"), r6(F.col("sim")).alias("rev"))


def noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each weight the best of each id's two candidates of best forward score; the scores stand in for models' (H5 is an adapter)."""
    kept = candidates.pruned(pool(spark, sf_dir).withColumn("fwd", F.when(F.col("rank") == 3, F.lit(None)).otherwise(F.col("fwd"))), 2, "fwd")
    return candidates.noisy_channel(kept, WEIGHTS).select("weight", "id", "translation", r6(F.col("total")).alias("total"))


def pool_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the distinct candidates of ids."""
    s = candidates.pool_statistics(candidates.distinct_candidates(pool(spark, sf_dir)))
    return s.select("rows", "ids", r6(F.col("mean")).alias("mean"), r6(F.col("p50")).alias("p50"), r6(F.col("p90")).alias("p90"), "least", "most")


def tag_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tag's first candidates."""
    return candidates.tag_first(pool(spark, sf_dir))


def pool_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each id's candidates begin with each word."""
    p = pool(spark, sf_dir).withColumn("translation", F.coalesce(F.get(X.tokens(F.col("translation")), F.lit(0)), F.lit("")))
    return candidates.pooled(p)


def editor_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for each item from others that are near enough and of like length."""
    own = items(spark, sf_dir).select(F.col("id").alias("query"), F.col("text").alias("gold"))
    c = nearest(spark, sf_dir).join(own, "query").where(gates.accepted_prototype(F.col("sim"), F.col("text"), F.col("gold"), 0.05, 0.5, 2.0))
    head = lambda c: F.substring(X.clean(F.col(c)), 1, 30)
    return c.select("query", "match", candidates.editor_prompt(head("gold"), head("text"), head("text")).alias("prompt"))


def oracle_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2, E3 with BLEU and chrF++ of sentences: each item's candidate that is nearest to its own beginning."""
    gold = items(spark, sf_dir).select("id", F.substring("text", 1, 40).alias("translation"))
    return candidates.oracle_choice(pool(spark, sf_dir), gold).select("id", "translation", *[r6(F.col(c)).alias(c) for c in ("bleu", "chrf", "gm")])


def mbr_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's candidate of greatest mean chrF++ against the others, by weight."""
    return candidates.mbr_choice(pool(spark, sf_dir)).select("id", "translation", r6(F.col("utility")).alias("utility"))


def memory_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"), "src", "tgt")


def memory_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for every item from the pairs of conversations."""
    q = items(spark, sf_dir).select("id", F.col("text").alias("src"))
    found = candidates.memory_candidates(q, memory_pairs(spark, sf_dir), 3)
    return found.withColumn("tm_sim", r6(F.col("tm_sim")))


def pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every item the answer of the nearest user's turn, where it is near enough."""
    q = items(spark, sf_dir).select("id", F.col("text").alias("src"))
    return candidates.pseudo_labels(q, memory_pairs(spark, sf_dir), 0.1).select("id", F.md5("translation").alias("translation"), r6(F.col("confidence")).alias("confidence"))


def hint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as sentence hints of their conversation: place and first word by turn."""
    t = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    first = F.get(X.tokens(F.col("text")), F.lit(0))
    return t.select(F.col("conv_id").alias("text_uuid"), F.col("turn").cast("string").alias("sentence_obj_in_text"), F.substring("text", 1, 60).alias("translation"), first.alias("first_word_transcription"), first.alias("first_word_spelling"), (F.col("turn") * 5).cast("string").alias("first_word_number"), F.lit("1").alias("line_number"))


def sentence_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence hints of each conversation in order."""
    h = pages.sentence_hints(hint_rows(spark, sf_dir))
    return h.select("oare_id", F.posexplode("hints").alias("nth", "h")).select("oare_id", F.col("nth").cast("long").alias("nth"), F.col("h.translation").alias("translation"), F.col("h.spelling").alias("spelling"), F.col("h.number").cast("long").alias("number"))


def anchored_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DP2-DP6, J2, A23: conversations' user turns as source against their answers, with hints and without, the better way of each."""
    t = read(spark, sf_dir, "conversations")
    joined = lambda role, name: F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])).alias(name)
    docs = t.groupBy(F.col("conv_id").alias("oare_id")).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])).alias("transliteration"), joined("assistant", "translation"))
    docs = docs.join(pages.sentence_hints(hint_rows(spark, sf_dir)), "oare_id", "left")
    rows = align.chosen_rows(align.aligned_documents(docs, "A"), gates.AlignedGate())
    return rows.select("oare_id", "method", "place", F.md5("src_sent").alias("src"), F.md5("tgt_sent").alias("tgt"), F.array_join("flags", ";").alias("flags"), "align_meta", r6(F.col("align_score")).alias("align_score"))


def lexicon(spark: SparkSession, sf_dir: str) -> slots.Lexicon:
    return {(w,): "PN" for w in STOPWORDS["en"]} | {(w,): "GN" for w in STOPWORDS["fr"]}


def placeholder_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How placeholders would do on documents in each mode."""
    docs = read(spark, sf_dir, "documents")
    common = frozenset(r.token for r in slots.common_tokens(docs, "text", 50).collect())
    out = slots.scorecards(docs, "text", lexicon(spark, sf_dir), ("all", "strict", "pattern"), common)
    return out.select("mode", "rows", *[r6(F.col(c)).alias(c) for c in ("coverage", "per_row", "common_rate", "short_rate", "score")])


def common_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred commonest tokens."""
    return slots.common_tokens(read(spark, sf_dir, "documents"), "text", 100)


def lemma_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the stop words' lemmas are met."""
    known = {(w,): (w, None) for w in STOPWORDS["en"] if w.isascii()}
    return slots.lemma_counts(read(spark, sf_dir, "documents"), "text", known)


def gloss_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents' beginnings with hints for their rarest known words."""
    known = {(w,): (w, "I") for w in STOPWORDS["en"] if len(w) > 2}
    g = slots.Gloss(known, {w: {"I": f'"{w} in English"; more'} for w in STOPWORDS["en"]}, most_hints=3)

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: slots.hinted(t, g), na_action=None)

    return read(spark, sf_dir, "documents").select("doc_id", run(F.substring("text", 1, 200)).alias("text"))


def tranche_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each tranche its share of documents, best first, under caps for source and language, filled up past them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 3).alias("tranche"), (-F.col("n_chars")).alias("order"))
    return mixing.select_greedy(gates.among(docs, lang=["en", "de", "fr"]), "tranche", ["order", "doc_id"], {"source": 20, "lang": 60}, 0.3).select("doc_id", "tranche")


QUERIES = {
    f.__name__: f
    for f in (noisy_channel, pool_report, tag_tops, pool_mass, editor_prompts, oracle_choice, mbr_choice, memory_candidates, pseudo_labels, sentence_hints, anchored_alignment, placeholder_scorecard, common_tokens, lemma_counts, gloss_hints, tranche_mix)
}

# ---- SQL ----

_POOL = f"{_CANDIDATES}, pool as (select query as id, substr(text, 1, 40) as translation, case when rank % 2 = 1 then 'odd' else 'even' end as tag, rank, query * 10 + rank as row, -length(text) / 100.0 as fwd, round(sim, 6) as rev from candidates)"
_ONE = lambda keys, order, n=1: f"row_number() over (partition by {keys} order by {order}) <= {n}"
ORACLE_SQL = {
    "noisy_channel": f"with {_POOL}, kept as (select *, case when rank = 3 then '-inf'::double else fwd end as f from pool qualify row_number() over (partition by id order by case when rank = 3 then null else fwd end desc nulls last, row) <= 2), each as (select *, rev + case when weight = 0 then 0.0 else weight * f end as total from kept, (select unnest([0.0::double, 0.5::double, 1.0::double]) as weight)) select weight, id, translation, round(total, 6) as total from each qualify {_ONE('weight, id', 'total desc, row')}",
    "pool_report": f"with {_POOL}, d as (select id, count(distinct translation) as n from pool group by id) select cast(sum(n) as bigint) as rows, count(*) as ids, round(avg(n), 6) as mean, round(quantile_cont(n, 0.5), 6) as p50, round(quantile_cont(n, 0.9), 6) as p90, min(n) as least, max(n) as most from d",
    "tag_tops": f"with {_POOL}, t as (select *, max(cast(rank = 1 as int)) over (partition by tag) as one from pool), k as (select * from t where one = 0 or rank = 1) select tag, id, translation from k qualify {_ONE('tag, id', 'row')}",
    "pool_mass": f"with {_POOL}, f as (select id, coalesce(({sql_tokens('translation')})[1], '') as translation from pool) select id, translation, count(*) as mass from f group by all",
    "editor_prompts": f"with {_CANDIDATES}, g as (select c.query, c.match, c.sim, c.text as t, i.text as gold, substr(trim(regexp_replace(i.text, '\\s+', ' ', 'g')), 1, 30) as a, substr(trim(regexp_replace(c.text, '\\s+', ' ', 'g')), 1, 30) as b from candidates c join items i on c.query = i.id) select query, match, trim('<SRC> ' || a || ' <TM_SRC> ' || b || ' <TM_TGT> ' || b) as prompt from g where sim >= 0.05 and greatest(length(trim(t)), 1) / greatest(length(trim(gold)), 1) between 0.5 and 2.0",
    "sentence_hints": f"with h as (select conv_id as oare_id, turn, substr(text, 1, 60) as translation, ({sql_tokens('text')})[1] as spelling, turn * 5 as number from conversations where role = 'assistant' and trim(substr(text, 1, 60)) <> '') select oare_id, row_number() over (partition by oare_id order by turn) - 1 as nth, translation, spelling, cast(number as bigint) as number from h",
    "common_tokens": f"select token, count(*) as n from (select unnest({sql_tokens('text')}) as token from documents) group by token order by n desc, token limit 100",
    "lemma_counts": "with t as (select unnest(regexp_split_to_array(text, '\\s+')) as token from documents), k as (select token, case when length(token) >= 4 and token like '%m' then substr(token, 1, length(token) - 1) else token end as lemma from t where list_contains([" + ", ".join(f"'{w}'" for w in STOPWORDS["en"] if w.isascii()) + "], token)) select lemma, count(*) as n from k group by lemma",
}
