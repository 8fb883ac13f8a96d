"""Queries over conversations: pair scores, tiers, context windows, shift search, audits, metrics, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.functions import udfs
from glyphmill.functions.sentences import split
from glyphmill.operators import align, metrics
from glyphmill.operators.ordering import first_by
from glyphmill.plans.common import r6, read, sql_bare, sql_grams, sql_jaccard, sql_tokens

GRAM, SHIFT = 4, 3
#: Audit thresholds.
SIM, MARGIN, NEAR, SHORT, LONG, TEMPLATE, TEMPLATE_SIM = 0.85, 0.08, 0.90, 0.35, 2.5, 5, 0.55


def by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, src, tgt): each user turn and the assistant turn after it."""
    t = turns(spark, sf_dir)
    after = t.select("conv_id", "turn", "role", F.col("text").alias("src"), F.lead("role").over(by_turn()).alias("next_role"), F.lead("text").over(by_turn()).alias("tgt"))
    return after.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "src", "tgt")


SQL_PAIRS = "pairs as (select conv_id, turn, text as src, next_text as tgt from (select *, lead(role) over w as next_role, lead(text) over w as next_text from conversations window w as (partition by conv_id order by turn)) where role = 'user' and next_role = 'assistant')"


def anchor_tokens_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors that a turn shares with the one before it."""
    t = turns(spark, sf_dir).select("conv_id", "turn", X.anchors(F.col("text")).alias("a"))
    t = t.withColumn("b", F.lag("a").over(by_turn())).where("b is not null")
    return t.select("conv_id", "turn", r6(X.jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).select("*", F.size(X.tokens(F.col("src"))).alias("n_src"), F.size(X.tokens(F.col("tgt"))).alias("n_tgt"), X.anchors(F.col("src")).alias("a"), X.anchors(F.col("tgt")).alias("b"))
    ratio, score = X.pair_scores(F.col("n_src"), F.col("n_tgt"))
    p = p.select("*", ratio.alias("len_ratio"), score.alias("align_score"), X.jaccard(F.col("a"), F.col("b")).alias("anchor"))
    return p.withColumn("pair_score", 0.7 * F.col("align_score") + 0.3 * F.col("anchor"))


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9, L11."""
    return scored(spark, sf_dir).select("conv_id", "turn", F.col("n_src").cast("long").alias("n_src"), F.col("n_tgt").cast("long").alias("n_tgt"), r6(F.col("len_ratio")).alias("len_ratio"), r6(F.col("align_score")).alias("align_score"), r6(F.col("pair_score")).alias("pair_score"))


def tier_tranche(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier by score and length ratio, tranche by flags and tier, and their counts."""
    p = scored(spark, sf_dir)
    ratio, score = F.col("len_ratio"), F.col("align_score") + 0.35 * F.col("anchor")
    flags = X.flags(("src_short", F.col("n_src") < 3), ("tgt_short", F.col("n_tgt") < 3), ("len_ratio", (ratio < 0.1) | (ratio > 4)))
    tier = F.when((score >= 0.55) & ratio.between(0.5, 2.2), "high").when((score >= 0.4) & ratio.between(0.35, 3.0), "med").otherwise("low")
    p = p.select(flags.alias("flags"), tier.alias("tier"), F.col("anchor"))
    tranche = F.when(F.size("flags") > 0, "T5").when(F.col("tier") == "high", F.when(F.col("anchor") >= 0.12, "T1").otherwise("T2")).when(F.col("tier") == "med", "T4").otherwise("T5")
    return p.select("tier", tranche.alias("tranche")).groupBy("tier", "tranche").agg(F.count("*").alias("n"))


def dup_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: pairs whose source has several targets, or whose target has several sources."""
    p = pairs(spark, sf_dir).select("conv_id", "turn", F.md5("src").alias("s"), F.md5("tgt").alias("t"))
    many = lambda key, other, name: p.groupBy(key).agg((F.countDistinct(other) > 1).alias(name))
    return p.join(many("s", "t", "src_multi_tgt"), "s").join(many("t", "s", "tgt_multi_src"), "t").select("conv_id", "turn", "src_multi_tgt", "tgt_multi_src")


def context_window(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    """Each turn between its k neighbours on either side, tagged."""
    tagged = lambda tag, c: F.concat(F.lit(f"<{tag}> "), c)
    text = X.clean(F.col("text"))
    t = turns(spark, sf_dir).select("conv_id", "turn", text.alias("text"))
    parts = [tagged(f"P{i}", F.lag("text", i).over(by_turn())) for i in range(k, 0, -1)] + [tagged("T", F.col("text"))] + [tagged(f"N{i}", F.lead("text", i).over(by_turn())) for i in range(1, k + 1)]
    return t.select("conv_id", "turn", F.concat_ws(" ", *parts).alias("context"))


# ---- audit ----

QUOTED, QUOTES = "“”„‘’‚", "\"\"\"'''"
DASHED, DASHES = "‐‑‒–—―−", "-------"
LOW = "₀₁₂₃₄₅₆₇₈₉ₓ"


def n0(c: Column) -> Column:
    """T21."""
    s = F.translate(udfs.apply("nfkc", c), QUOTED + DASHED + LOW, QUOTES + DASHES + "0123456789x")
    s = F.trim(F.regexp_replace(s, r"[ \t\r\n\x{A0}\x{2009}\x{202F}]+", " "))
    s = F.regexp_replace(s, r"(?i)<\s*big_gap\s*>", "<big_gap>")
    return F.regexp_replace(s, r"(?i)<\s*gap\s*>", "<gap>")


def n1(s: Column) -> Column:
    """T22, of n0."""
    return F.regexp_replace(s, r"\s+([,.;:!?])", "$1")


PUNCT = r"[!\"#$%&'()*+,\-./:;=?@\[\\\]^_`{|}~]"


def n2(s: Column) -> Column:
    """T23, of n1: gaps become the words gap and biggap."""
    s = F.lower(F.replace(F.replace(s, F.lit("<big_gap>"), F.lit(" biggap ")), F.lit("<gap>"), F.lit(" gap ")))
    return F.trim(F.regexp_replace(F.regexp_replace(s, PUNCT, " "), r"\s{2,}", " "))


STOP_NAMES = "If The A An In On At To From And Or But For When As This That These Those He She We They I You It His Her Our Your Their Seal Thus Witnessed".split()


def names_of(n1_text: Column) -> Column:
    """Name-like words but for the first word, in order, 8 at most."""
    w = F.regexp_extract_all(n1_text, F.lit("[A-Za-zŠṢḪṬšṣḫṭʾʼ'-]+"), F.lit(0))
    later = F.when(F.size(w) > 1, F.slice(w, 2, F.size(w))).otherwise(F.array().cast("array<string>"))
    stop = F.array(*map(F.lit, STOP_NAMES))
    return F.slice(F.array_distinct(F.filter(later, lambda t: ~F.array_contains(stop, t) & t.rlike("^[A-ZŠṢḪṬ]") & (t.contains("-") | t.rlike("[a-zšṣḫṭ]")))), 1, 8)


def multi_sentence(raw: Column, s: Column) -> Column:
    """S is n0 of raw."""
    return raw.rlike(r"[\n\r]") | F.regexp_replace(s, r"\.{3,}", "#").rlike(r"[!?.]\s+[\")'\]]*[A-Z]")


def repetition(s: Column) -> Column:
    """S is n0."""
    w = F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9']+"), F.lit(0))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(a: Column, t: Column) -> Column:
        run = F.when(a["last"] == t, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

    return X.let(w, lambda x: F.when(F.size(x) < 8, F.lit(0.0)).otherwise(F.greatest(F.aggregate(x, start, step)["most"] / 5, (F.lit(0.6) - F.size(F.array_distinct(x)) / F.size(x)) * 2)))


def gloss_leak(c: Column) -> Column:
    return c.rlike(r"(?i)<\s*/?\s*LEX\s*>|\b[a-z\-]{2,}\s*=\s*[a-z\-]{2,}\b") | c.contains("|")


def translit_leak(c: Column) -> Column:
    """Braces, gaps, or a dotted word in capitals."""

    def logogram(t: Column) -> Column:
        t = F.trim(t, F.lit("\"'`“”‘’()[]{}<>,;:!?."))
        parts = F.filter(F.split(t, r"\."), lambda p: p != "")
        return t.contains(".") & (F.size(parts) >= 2) & F.exists(parts, lambda p: F.length(p) > 1) & (t == F.upper(t)) & (t != F.lower(t))

    return c.rlike(r"[{}]|<gap>|<big_gap>") | F.exists(X.tokens(c), logogram)


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as references, assistant turns as predictions, with derived columns."""
    p = pairs(spark, sf_dir).select("conv_id", "turn", F.col("src").alias("ref"), F.col("tgt").alias("pred"))
    p = p.select("*", n0(F.col("ref")).alias("ref_n0"), n0(F.col("pred")).alias("pred_n0"))
    p = p.select("*", n1(F.col("ref_n0")).alias("ref_n1"), n1(F.col("pred_n0")).alias("pred_n1"))
    p = p.select("*", n2(F.col("ref_n1")).alias("ref_n2"), n2(F.col("pred_n1")).alias("pred_n2"))
    p = p.select("*", X.char_ngrams(F.col("pred_n2"), GRAM).alias("pg"), X.char_ngrams(F.col("ref_n2"), GRAM).alias("rg"))
    near = {k: (F.lag("rg", -k).over(by_turn()) if k < 0 else F.lead("rg", k).over(by_turn())) if k else F.col("rg") for k in range(-SHIFT, SHIFT + 1)}
    empty = F.array().cast("array<string>")
    p = p.select("*", *[F.coalesce(c, empty).alias(f"rg_{k + SHIFT}") for k, c in near.items()], F.concat_ws(" ", "ref_n2", F.coalesce(F.lead("ref_n2").over(by_turn()), F.lit(""))).alias("with_next"), F.concat_ws(" ", F.coalesce(F.lag("ref_n2").over(by_turn()), F.lit("")), "ref_n2").alias("with_prev"))
    sims = [X.gram_similarity(F.col("pg"), F.col(f"rg_{k + SHIFT}")).alias(f"sim_{k + SHIFT}") for k in near]
    merged = [X.gram_similarity(F.col("pg"), X.char_ngrams(F.col(f"with_{side}"), GRAM)).alias(f"sim_merge_{side}") for side in ("next", "prev")]
    p = p.select("*", *sims, *merged)
    # the first of equals: itself, then from the least offset on
    best = F.array_max(F.array(*[F.struct(F.col(f"sim_{k + SHIFT}").alias("sim"), F.lit(9 if not k else SHIFT - k).alias("turn_of"), F.lit(k).alias("k")) for k in near]))
    count = lambda c, tag: F.regexp_count(F.col(c), F.lit(tag))
    p = p.select(
        "conv_id", "turn", "ref", "pred", "ref_n0", "pred_n0", "ref_n1", "pred_n1", "ref_n2", "pred_n2", F.col(f"sim_{SHIFT}").alias("sim_self"), best.alias("best"), "sim_merge_next", "sim_merge_prev",
        ((F.length("pred_n0") + 1) / (F.length("ref_n0") + 1)).alias("len_ratio"),
        ((count("pred_n0", "<gap>") != count("ref_n0", "<gap>")) | (count("pred_n0", "<big_gap>") != count("ref_n0", "<big_gap>"))).alias("gap_differs"),
        (F.regexp_replace("pred_n0", "<gap>|<big_gap>", "").rlike(r"[<>\[\]˹˺]")).alias("modern"),
        multi_sentence(F.col("pred"), F.col("pred_n0")).alias("multi"), repetition(F.col("pred_n0")).alias("repetition"),
        F.regexp_count("ref", F.lit(r"\d")).alias("ref_digit"), F.regexp_count("pred", F.lit(r"\d")).alias("pred_digit"), gloss_leak(F.col("pred")).alias("gloss_leak"), translit_leak(F.col("pred")).alias("copy_src"),
        F.size(names_of(F.col("ref_n1"))).alias("ref_names"), F.size(names_of(F.col("pred_n1"))).alias("pred_names"), F.md5("pred_n2").alias("template"),
    )
    frequency = p.groupBy("template").agg(F.count("*").alias("template_count"))
    p = p.join(frequency, "template")
    c = F.col
    shifted = (c("best.k") != 0) & (c("best.sim") > SIM) & (c("best.sim") - c("sim_self") > MARGIN)
    merge = lambda side: (c(f"sim_merge_{side}") > SIM) & (c(f"sim_merge_{side}") - c("sim_self") > MARGIN)
    primary = (
        F.when(c("pred") == c("ref"), "T00_EXACT").when(c("pred_n0") == c("ref_n0"), "T01_UNICODE_OR_WS").when(c("pred_n1") == c("ref_n1"), "T02_PUNCT_SPACING").when(c("pred_n2") == c("ref_n2"), "T03_CASE_OR_MINOR_STYLE")
        .when(shifted, F.when(c("best.k") < 0, "T30_ALIGN_SHIFT_PREV").otherwise("T30_ALIGN_SHIFT_NEXT")).when(merge("next"), "T31_ALIGN_MERGE_WITH_NEXT").when(merge("prev"), "T31_ALIGN_MERGE_WITH_PREV")
        .when(c("multi"), "T20_MULTI_SENTENCE").when(c("repetition") >= 1, "T22_REPETITION").when(c("gap_differs"), "T10_GAP_MARKER").when(c("modern"), "T11_MODERN_NOTATION")
        .when(c("len_ratio") < SHORT, "T21_TRUNCATION").when(c("sim_self") >= NEAR, "T04_NEAR_MATCH").otherwise("T90_SEMANTIC_OR_MODEL")
    )
    number = F.when((c("ref_digit") > 0) & (c("pred_digit") == 0), "TAG_NUM_DROP").when((c("pred_digit") > 0) & (c("ref_digit") == 0), "TAG_NUM_HALLUC").when(F.abs(c("pred_digit") - c("ref_digit")) >= 3, "TAG_NUM_DIFF")
    name = F.when((c("ref_names") >= 1) & (c("pred_names") == 0), "TAG_NAME_DROP").when((c("pred_names") >= 1) & (c("ref_names") == 0), "TAG_NAME_HALLUC").when((c("ref_names") >= 2) & (c("pred_names") <= c("ref_names") - 2), "TAG_NAME_DROP")
    flagged = [F.when(cond, F.lit(tag)) for tag, cond in (("TAG_COPY_SRC", c("copy_src")), ("TAG_GAP_MISMATCH", c("gap_differs")), ("TAG_GLOSS_LEAK", c("gloss_leak")), ("TAG_MODERN", c("modern")), ("TAG_MULTI_SENT", c("multi")), ("TAG_REPEAT", c("repetition") >= 1), ("TAG_TEMPLATE", (c("template_count") >= TEMPLATE) & (c("sim_self") < TEMPLATE_SIM)), ("TAG_TOO_LONG", c("len_ratio") > LONG), ("TAG_TRUNC", c("len_ratio") < SHORT))]
    p = p.withColumn("primary", primary).withColumn("tags", F.array_sort(F.array_compact(F.array(*flagged, number, name))))
    has = lambda tag: F.array_contains("tags", tag)
    reason = F.when(has("TAG_GLOSS_LEAK"), "T90_GLOSS_LEAK").when(has("TAG_COPY_SRC"), "T90_COPY_SRC").when(has("TAG_TEMPLATE"), "T90_TEMPLATE_COLLAPSE").when(F.exists("tags", lambda t: t.startswith("TAG_NUM_")), "T90_NUMERIC").when(F.exists("tags", lambda t: t.startswith("TAG_NAME_")), "T90_NAME").otherwise("T90_OTHER")
    return p.withColumn("t90_reason", F.when(c("primary") == "T90_SEMANTIC_OR_MODEL", reason).otherwise(""))


def audit_primary_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U6, U7."""
    a = audited(spark, sf_dir)
    return a.select("conv_id", "turn", r6(F.col("sim_self")).alias("sim_self"), F.col("best.k").alias("best_offset"), r6(F.col("best.sim")).alias("best_sim"), r6(F.col("repetition")).alias("repetition"), "primary", F.array_join("tags", "|").alias("tags"), "t90_reason")


def shift_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbouring turn within three places that is most like each turn."""
    t = turns(spark, sf_dir).select("conv_id", "turn", X.char_ngrams(F.lower(F.col("text")), GRAM).alias("g"))
    offsets = [k for k in range(-SHIFT, SHIFT + 1) if k]
    t = t.select("*", *[(F.lag("g", -k) if k < 0 else F.lead("g", k)).over(by_turn()).alias(f"g_{k + SHIFT}") for k in offsets])
    t = t.select("conv_id", "turn", *[F.when(F.col(f"g_{k + SHIFT}").isNotNull(), X.gram_similarity(F.col("g"), F.col(f"g_{k + SHIFT}"))).otherwise(F.lit(-1.0)).alias(f"s_{k + SHIFT}") for k in offsets])
    best = F.array_max(F.array(*[F.struct(F.col(f"s_{k + SHIFT}").alias("s"), F.lit(-k).alias("o")) for k in offsets]))
    return t.select("conv_id", "turn", best.alias("b")).where("b.s >= 0").select("conv_id", "turn", (-F.col("b.o")).cast("long").alias("best_offset"), r6(F.col("b.s")).alias("best_sim"))


#: Where each type is mended.
ROUTES = {"T00": "OK", "T01": "OUTPUT_PP", "T02": "OUTPUT_PP", "T03": "OUTPUT_PP", "T04": "OUTPUT_PP", "T10": "INPUT_PP+OUTPUT_PP", "T11": "INPUT_PP+OUTPUT_PP", "T20": "DECODE+OUTPUT_PP", "T21": "DECODE", "T22": "DECODE", "T30": "ALIGN", "T31": "ALIGN", "T90": "MODEL"}
#: U8: kind, condition, priority and what to do; the first condition that holds counts. In the SQL that both engines read.
_HAS = lambda *tags: " or ".join(f"contains('|' || tags || '|', '|{t}|')" for t in tags)
_GAP_OF = lambda a, b: f"cast(abs({a} - {b}) as double) + case when {a} = {b} then 0.25 else 0.0 end"
TODO = (
    ("ALIGN_SHIFT", "kind like 'T30%'", "greatest(best_sim - sim_self, 0.0)", "alignment: the prediction fits the reference at offset"),
    ("ALIGN_MERGE", "kind like 'T31%'", "greatest(sim_merge_next - sim_self, sim_merge_prev - sim_self, 0.0)", "segmentation: the prediction fits the reference joined with its neighbour"),
    ("NUMERIC_PRESERVE", f"t90_reason = 'T90_NUMERIC' or {_HAS('TAG_NUM_DROP', 'TAG_NUM_HALLUC')}", _GAP_OF("ref_digit", "pred_digit"), "numbers differ: use number slots or copy constraints"),
    ("NAME_PRESERVE", f"t90_reason = 'T90_NAME' or {_HAS('TAG_NAME_DROP', 'TAG_NAME_HALLUC')}", _GAP_OF("ref_names", "pred_names"), "names differ: use name slots, or hints for them"),
    ("GLOSS_LEAK", "t90_reason = 'T90_GLOSS_LEAK' or gloss_leak", "1.0", "hints in the prediction: strip them from the output"),
    ("COPY_SRC", "t90_reason = 'T90_COPY_SRC' or copy_src", "greatest(1.0 - sim_self, 0.0)", "source words in the prediction: constrain or clean"),
    ("TEMPLATE_OR_REPETITION", f"t90_reason = 'T90_TEMPLATE_COLLAPSE' or kind = 'T22_REPETITION' or template_count >= {TEMPLATE}", "cast(greatest(template_count, 1) as double)", "many predictions are alike: constrain repetition when decoding"),
    ("TRUNCATION", "kind = 'T21_TRUNCATION'", "greatest(1.0 - len_ratio, 0.0)", "the prediction is short: raise length limits"),
    ("MULTI_SENTENCE", "kind = 'T20_MULTI_SENTENCE'", "0.5", "several sentences: make them one"),
    ("MODERN_NOTATION", "kind = 'T11_MODERN_NOTATION'", "0.5", "editorial marks in the prediction: normalise"),
    ("GAP_MARKER", "kind = 'T10_GAP_MARKER'", "0.5", "gaps differ: normalise them on both sides"),
    ("NEAR_MATCH", "kind = 'T04_NEAR_MATCH'", "sim_self", "nearly right: normalise the output"),
    ("STYLE_MINOR", "kind in ('T01_SPACE_OR_PUNCT', 'T03_CASE_OR_MINOR_STYLE')", "sim_self", "style alone: normalise the output"),
)
_CASE = lambda i, last="null": "case " + " ".join(f"when {t[1]} then {t[i] if i == 2 else repr(t[i])}" for t in TODO) + f" else {last} end"


def todo_rules(rows: DataFrame, per_group: int | None, group: str = "conv_id", place: str = "turn") -> DataFrame:
    """What an audit's rows ask for, by priority (then how much better another place fits), `per_group` of each group.

    todo_rank counts within the group; a rank over all rows is a sort of few columns (`ordering.numbered`), where one is wanted.
    """
    around = Window.partitionBy(group).orderBy(place)
    rows = rows.select("*", F.lag("ref").over(around).alias("ref_prev"), F.lead("ref").over(around).alias("ref_next"), F.col("primary").alias("kind"), F.array_join("tags", "|").alias("_tags")).drop("tags").withColumnRenamed("_tags", "tags")
    rows = rows.withColumns({"best_offset": F.col("best.k").cast("long"), "best_sim": F.col("best.sim"), "fix_route": F.element_at(F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv]), F.substring("kind", 1, 3))})
    for c in ("sim_self", "best_sim", "sim_merge_next", "sim_merge_prev", "len_ratio"):
        rows = rows.withColumn(c, r6(F.col(c)))
    rows = rows.select("*", F.expr(_CASE(0)).alias("todo_type"), r6(F.expr(_CASE(2)).cast("double")).alias("priority"), F.expr(_CASE(3)).alias("action")).where("todo_type is not null")
    rows = rows.withColumn("target", F.when((F.col("todo_type") == "ALIGN_SHIFT") & (F.col("best_offset") != 0), F.col(place) + F.col("best_offset")).otherwise(F.col(place)).cast("long"))
    order = [F.desc("priority"), F.desc(r6(F.col("best_sim") - F.col("sim_self"))), F.desc("best_sim"), F.desc("sim_self"), F.asc(place)]
    return first_by(rows, [group], order, per_group, "todo_rank")


def todo_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two most pressing rows of each conversation."""
    a = audited(spark, sf_dir)
    return todo_rules(a, 2).select("conv_id", "turn", "todo_rank", "todo_type", "priority", "action", "fix_route", "target", F.md5(F.coalesce("ref_prev", F.lit(""))).alias("ref_prev"), F.md5(F.coalesce("ref_next", F.lit(""))).alias("ref_next"))


def corpus_chrf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of clipped character n-gram matches by order over all pairs."""
    s = metrics.summed_statistics(pairs(spark, sf_dir), {"char": (metrics.bare(F.col("tgt")), metrics.bare(F.col("src")), metrics.CHAR_ORDERS)})
    return s.select(F.col("n").cast("long").alias("n"), "matches", "n_hyp", "n_ref")


def corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU, chrF++ and their geometric mean over all pairs."""
    return metrics.corpus_scores(pairs(spark, sf_dir), "tgt", "src").select(*[r6(F.col(c)).alias(c) for c in ("bleu", "chrf", "gm")])


def dp_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DP1, DP5, N1, N10: segments of each user turn for the sentences of the answer."""

    @F.pandas_udf("array<struct<src:string,tgt:string>>")
    def run(src, tgt):
        import pandas as pd

        return pd.Series([[{"src": a, "tgt": b} for a, b in align.aligned(s or "", split(t))] for s, t in zip(src, tgt)])

    p = pairs(spark, sf_dir).select("conv_id", "turn", F.posexplode(run("src", "tgt")).alias("segment", "s"))
    return p.select("conv_id", "turn", "segment", F.col("s.src").alias("src"), F.col("s.tgt").alias("tgt"), *[c.alias(n) for n, c in zip(("len_ratio", "align_score"), X.pair_scores(F.size(X.tokens(F.col("s.src"))), F.size(X.tokens(F.col("s.tgt")))))])


QUERIES = {f.__name__: f for f in (anchor_tokens_jaccard, pair_scores, tier_tranche, dup_flags, context_window, audit_primary_type, shift_similarity, todo_caps, corpus_chrf_stats, corpus_scores, dp_segments)}

# ---- SQL ----


def sql_anchors(text: str) -> str:
    stripped = f"list_filter(list_transform({sql_tokens(text)}, lambda t: upper(replace(trim(t, '.,;:!?()[]{{}}<>\"'''), 'ß', 'ss'))), lambda t: t <> '')"
    return f"list_distinct(list_filter({stripped}, lambda t: regexp_matches(t, '[0-9]') or length(t) >= 4))"


def sql_set_jaccard(a: str, b: str) -> str:
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0 else len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) end"


_W = "window w as (partition by conv_id order by turn)"
_SCORED = f"""{SQL_PAIRS}, counted as (select *, len({sql_tokens('src')}) as n_src, len({sql_tokens('tgt')}) as n_tgt, {sql_anchors('src')} as a, {sql_anchors('tgt')} as b from pairs),
scored as (select *, n_src / greatest(n_tgt, 1) as len_ratio, least(n_src, n_tgt) / greatest(n_src, n_tgt, 1) as align_score, {sql_set_jaccard('a', 'b')} as anchor from counted)"""


def sql_n0(c: str) -> str:
    quoted, plain = (QUOTED + DASHED + LOW).replace("'", "''"), (QUOTES + DASHES + "0123456789x").replace("'", "''")
    s = f"trim(regexp_replace(translate({c}, '{quoted}', '{plain}'), '[ \\t\\r\\n\\x{{A0}}\\x{{2009}}\\x{{202F}}]+', ' ', 'g'))"
    return f"regexp_replace(regexp_replace({s}, '(?i)<\\s*big_gap\\s*>', '<big_gap>', 'g'), '(?i)<\\s*gap\\s*>', '<gap>', 'g')"


def sql_n2(c: str) -> str:
    s = f"lower(replace(replace({c}, '<big_gap>', ' biggap '), '<gap>', ' gap '))"
    return f"trim(regexp_replace(regexp_replace({s}, '{PUNCT.replace(chr(39), chr(39) * 2)}', ' ', 'g'), '\\s{{2,}}', ' ', 'g'))"


def sql_names(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_NAMES)
    w = f"regexp_extract_all({c}, '[A-Za-zŠṢḪṬšṣḫṭʾʼ''-]+')"
    return f"least(len(list_distinct(list_filter(({w})[2:], lambda t: not list_contains([{stop}], t) and regexp_matches(t, '^[A-ZŠṢḪṬ]') and (contains(t, '-') or regexp_matches(t, '[a-zšṣḫṭ]'))))), 8)"


_OFFSETS = [k for k in range(-SHIFT, SHIFT + 1)]
_SHIFTED = ", ".join(f"coalesce({'lag' if k < 0 else 'lead'}(rg, {abs(k)}) over w, []) as rg_{k + SHIFT}" if k else f"rg as rg_{SHIFT}" for k in _OFFSETS)
_SIMS = ", ".join(f"{sql_jaccard('pg', f'rg_{k + SHIFT}')} as sim_{k + SHIFT}" for k in _OFFSETS)
_BEST = "list_sort([" + ", ".join(f"{{'sim': sim_{k + SHIFT}, 'turn_of': {9 if not k else SHIFT - k}, 'k': {k}}}" for k in _OFFSETS) + "], 'DESC')[1]"
_NUM = "case when ref_digit > 0 and pred_digit = 0 then 'TAG_NUM_DROP' when pred_digit > 0 and ref_digit = 0 then 'TAG_NUM_HALLUC' when abs(pred_digit - ref_digit) >= 3 then 'TAG_NUM_DIFF' end"
_NAME = "case when ref_names >= 1 and pred_names = 0 then 'TAG_NAME_DROP' when pred_names >= 1 and ref_names = 0 then 'TAG_NAME_HALLUC' when ref_names >= 2 and pred_names <= ref_names - 2 then 'TAG_NAME_DROP' end"
_LOGOGRAM = "len(list_filter(list_transform({t}, lambda t: trim(t, '\"''`“”‘’()[]{{}}<>,;:!?.')), lambda t: contains(t, '.') and len(list_filter(string_split(t, '.'), lambda p: p <> '')) >= 2 and len(list_filter(string_split(t, '.'), lambda p: length(p) > 1)) > 0 and t = upper(t) and t <> lower(t))) > 0".format(t=sql_tokens("pred"))
_AUDITED = f"""{SQL_PAIRS}, a0 as (select conv_id, turn, src as ref, tgt as pred, {sql_n0('src')} as ref_n0, {sql_n0('tgt')} as pred_n0 from pairs),
a1 as (select *, regexp_replace(ref_n0, '\\s+([,.;:!?])', '\\1', 'g') as ref_n1, regexp_replace(pred_n0, '\\s+([,.;:!?])', '\\1', 'g') as pred_n1 from a0),
a2 as (select *, {sql_n2('ref_n1')} as ref_n2, {sql_n2('pred_n1')} as pred_n2 from a1),
a3 as (select *, {sql_bare('ref_n2')} as rb, {sql_bare('pred_n2')} as pb, {sql_bare("ref_n2 || coalesce(lead(ref_n2) over w, '')")} as nb, {sql_bare("coalesce(lag(ref_n2) over w, '') || ref_n2")} as vb from a2 {_W}),
a4 as (select *, {sql_grams('rb', GRAM)} as rg, {sql_grams('pb', GRAM)} as pg, {sql_grams('nb', GRAM)} as ng, {sql_grams('vb', GRAM)} as vg from a3),
a5 as (select *, {_SHIFTED} from a4 {_W}),
a6 as (select *, {_SIMS}, {sql_jaccard('pg', 'ng')} as sim_merge_next, {sql_jaccard('pg', 'vg')} as sim_merge_prev, regexp_extract_all(lower(pred_n0), '[a-z0-9'']+') as w from a5),
words as (select conv_id, turn, unnest(w) as t, unnest(range(len(w))) as i from a6),
runs as (select conv_id, turn, t, i - row_number() over (partition by conv_id, turn, t order by i) as g from words),
longest as (select conv_id, turn, max(n) as most from (select conv_id, turn, t, g, count(*) as n from runs group by all) group by all),
a7 as (select a6.*, sim_{SHIFT} as sim_self, {_BEST} as best, (length(pred_n0) + 1) / (length(ref_n0) + 1) as len_ratio,
  len(regexp_extract_all(pred_n0, '<gap>')) <> len(regexp_extract_all(ref_n0, '<gap>')) or len(regexp_extract_all(pred_n0, '<big_gap>')) <> len(regexp_extract_all(ref_n0, '<big_gap>')) as gap_differs,
  regexp_matches(regexp_replace(pred_n0, '<gap>|<big_gap>', '', 'g'), '[<>\\[\\]˹˺]') as modern,
  regexp_matches(pred, '[\\n\\r]') or regexp_matches(regexp_replace(pred_n0, '\\.{{3,}}', '#', 'g'), '[!?.]\\s+[")''\\]]*[A-Z]') as multi,
  case when len(w) < 8 then 0.0 else greatest(most / 5, (0.6 - len(list_distinct(w)) / len(w)) * 2) end as repetition,
  len(regexp_extract_all(ref, '\\d')) as ref_digit, len(regexp_extract_all(pred, '\\d')) as pred_digit,
  regexp_matches(pred, '(?i)<\\s*/?\\s*LEX\\s*>|\\b[a-z\\-]{{2,}}\\s*=\\s*[a-z\\-]{{2,}}\\b') or contains(pred, '|') as gloss_leak,
  regexp_matches(pred, '[{{}}]|<gap>|<big_gap>') or {_LOGOGRAM} as copy_src, {sql_names('ref_n1')} as ref_names, {sql_names('pred_n1')} as pred_names, count(*) over (partition by pred_n2) as template_count
  from a6 left join longest using (conv_id, turn)),
a8 as (select *, case when pred = ref then 'T00_EXACT' when pred_n0 = ref_n0 then 'T01_UNICODE_OR_WS' when pred_n1 = ref_n1 then 'T02_PUNCT_SPACING' when pred_n2 = ref_n2 then 'T03_CASE_OR_MINOR_STYLE'
  when best.k <> 0 and best.sim > {SIM} and best.sim - sim_self > {MARGIN} then case when best.k < 0 then 'T30_ALIGN_SHIFT_PREV' else 'T30_ALIGN_SHIFT_NEXT' end
  when sim_merge_next > {SIM} and sim_merge_next - sim_self > {MARGIN} then 'T31_ALIGN_MERGE_WITH_NEXT' when sim_merge_prev > {SIM} and sim_merge_prev - sim_self > {MARGIN} then 'T31_ALIGN_MERGE_WITH_PREV'
  when multi then 'T20_MULTI_SENTENCE' when repetition >= 1 then 'T22_REPETITION' when gap_differs then 'T10_GAP_MARKER' when modern then 'T11_MODERN_NOTATION' when len_ratio < {SHORT} then 'T21_TRUNCATION'
  when sim_self >= {NEAR} then 'T04_NEAR_MATCH' else 'T90_SEMANTIC_OR_MODEL' end as "primary",
  list_sort(list_filter([case when copy_src then 'TAG_COPY_SRC' end, case when gap_differs then 'TAG_GAP_MISMATCH' end, case when gloss_leak then 'TAG_GLOSS_LEAK' end, case when modern then 'TAG_MODERN' end, case when multi then 'TAG_MULTI_SENT' end,
  case when repetition >= 1 then 'TAG_REPEAT' end, case when template_count >= {TEMPLATE} and sim_self < {TEMPLATE_SIM} then 'TAG_TEMPLATE' end, case when len_ratio > {LONG} then 'TAG_TOO_LONG' end, case when len_ratio < {SHORT} then 'TAG_TRUNC' end, {_NUM}, {_NAME}], lambda x: x is not null)) as tags from a7),
audited as (select *, case when "primary" <> 'T90_SEMANTIC_OR_MODEL' then '' when list_contains(tags, 'TAG_GLOSS_LEAK') then 'T90_GLOSS_LEAK' when list_contains(tags, 'TAG_COPY_SRC') then 'T90_COPY_SRC' when list_contains(tags, 'TAG_TEMPLATE') then 'T90_TEMPLATE_COLLAPSE'
  when len(list_filter(tags, lambda t: starts_with(t, 'TAG_NUM_'))) > 0 then 'T90_NUMERIC' when len(list_filter(tags, lambda t: starts_with(t, 'TAG_NAME_'))) > 0 then 'T90_NAME' else 'T90_OTHER' end as t90_reason from a8)"""
_TURN_OFFSETS = [k for k in _OFFSETS if k]

ORACLE_SQL = {
    "anchor_tokens_jaccard": f"with t as (select conv_id, turn, {sql_anchors('text')} as a from conversations), l as (select *, lag(a) over w as b from t {_W}) select conv_id, turn, round({sql_set_jaccard('a', 'b')}, 6) as jaccard from l where b is not null",
    "pair_scores": f"with {_SCORED} select conv_id, turn, cast(n_src as bigint) as n_src, cast(n_tgt as bigint) as n_tgt, round(len_ratio, 6) as len_ratio, round(align_score, 6) as align_score, round(0.7 * align_score + 0.3 * anchor, 6) as pair_score from scored",
    "tier_tranche": f"with {_SCORED}, t as (select *, n_src < 3 or n_tgt < 3 or len_ratio < 0.1 or len_ratio > 4 as flagged, case when align_score + 0.35 * anchor >= 0.55 and len_ratio between 0.5 and 2.2 then 'high' when align_score + 0.35 * anchor >= 0.4 and len_ratio between 0.35 and 3.0 then 'med' else 'low' end as tier from scored) select tier, case when flagged then 'T5' when tier = 'high' then case when anchor >= 0.12 then 'T1' else 'T2' end when tier = 'med' then 'T4' else 'T5' end as tranche, count(*) as n from t group by all",
    "dup_flags": f"with {SQL_PAIRS}, s as (select src, count(distinct tgt) > 1 as src_multi_tgt from pairs group by src), t as (select tgt, count(distinct src) > 1 as tgt_multi_src from pairs group by tgt) select conv_id, turn, src_multi_tgt, tgt_multi_src from pairs join s using (src) join t using (tgt)",
    "context_window": f"with t as (select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from conversations) select conv_id, turn, concat_ws(' ', '<P2> ' || lag(text, 2) over w, '<P1> ' || lag(text, 1) over w, '<T> ' || text, '<N1> ' || lead(text, 1) over w, '<N2> ' || lead(text, 2) over w) as context from t {_W}",
    "audit_primary_type": f"with {_AUDITED} select conv_id, turn, round(sim_self, 6) as sim_self, cast(best.k as int) as best_offset, round(best.sim, 6) as best_sim, round(repetition, 6) as repetition, \"primary\", array_to_string(tags, '|') as tags, t90_reason from audited",
    "shift_similarity": f"with t as (select conv_id, turn, {sql_bare('lower(text)')} as b from conversations), g as (select conv_id, turn, {sql_grams('b', GRAM)} as g from t), n as (select *, "
    + ", ".join(f"{'lag' if k < 0 else 'lead'}(g, {abs(k)}) over w as g_{k + SHIFT}" for k in _TURN_OFFSETS)
    + f" from g {_W}), s as (select conv_id, turn, list_sort(["
    + ", ".join(f"{{'s': case when g_{k + SHIFT} is null then -1.0 else {sql_jaccard('g', f'g_{k + SHIFT}')} end, 'o': {-k}}}" for k in _TURN_OFFSETS)
    + "], 'DESC')[1] as b from n) select conv_id, turn, cast(-b.o as bigint) as best_offset, round(b.s, 6) as best_sim from s where b.s >= 0",
    "todo_caps": f"""with {_AUDITED}, flat as (select conv_id, turn, "primary" as kind, array_to_string(tags, '|') as tags, t90_reason, round(sim_self, 6) as sim_self, cast(best.k as bigint) as best_offset, round(best.sim, 6) as best_sim, round(sim_merge_next, 6) as sim_merge_next, round(sim_merge_prev, 6) as sim_merge_prev,
  round(len_ratio, 6) as len_ratio, ref_digit, pred_digit, ref_names, pred_names, gloss_leak, copy_src, template_count, md5(coalesce(lag(ref) over w, '')) as ref_prev, md5(coalesce(lead(ref) over w, '')) as ref_next from audited {_W}),
  typed as (select *, {_CASE(0)} as todo_type, round(cast({_CASE(2)} as double), 6) as priority, {_CASE(3)} as action from flat), ranked as (select *, cast(row_number() over (partition by conv_id order by priority desc, round(best_sim - sim_self, 6) desc, best_sim desc, sim_self desc, turn) as int) as todo_rank from typed where todo_type is not null)
  select conv_id, turn, todo_rank, todo_type, priority, action, case substr(kind, 1, 3) {' '.join(f"when '{k}' then '{v}'" for k, v in ROUTES.items())} end as fix_route, case when todo_type = 'ALIGN_SHIFT' and best_offset <> 0 then cast(turn + best_offset as bigint) else cast(turn as bigint) end as target, ref_prev, ref_next from ranked where todo_rank <= 2""",
    "corpus_chrf_stats": f"with {SQL_PAIRS}, s as (select conv_id, turn, 0 as side, {sql_bare('tgt')} as t from pairs union all select conv_id, turn, 1, {sql_bare('src')} from pairs), g as (select conv_id, turn, side, n, unnest(list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n))) as gram from s, (select unnest(range(1, 7)) as n)), c as (select conv_id, turn, n, gram, count(*) filter (side = 0) as h, count(*) filter (side = 1) as r from g group by all) select n, cast(sum(least(h, r)) as bigint) as matches, cast(sum(h) as bigint) as n_hyp, cast(sum(r) as bigint) as n_ref from c group by n",
}
