"""Reading the tables, and SQL fragments that the catalogue's DuckDB queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.profile import ENGLISH, STOPWORDS
from glyphmill.functions.sentences import ABBREVIATIONS
from glyphmill.shared import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# ---- SQL ----


def sql_count(text: str, kind: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '{kind}', '', 'g')))"


def sql_tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda t: t <> '')"


def sql_words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '([a-z][a-z'']+)', 1)"


def sql_hits(words: str, language: str) -> str:
    listed = ", ".join(f"'{w}'" for w in (ENGLISH if language == "english" else STOPWORDS[language]))
    return f"len(list_filter({words}, lambda w: list_contains([{listed}], w)))"


def sql_bare(text: str) -> str:
    return f"regexp_replace({text}, '\\s+', '', 'g')"


def sql_clean(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def sql_grams(s: str, n: int) -> str:
    """The set of n-grams of a text without white space; s: a column name."""
    return f"case when length({s}) = 0 then [] when length({s}) <= {n} then [{s}] else list_distinct(list_transform(range(1, length({s}) - {n} + 2), lambda i: substr({s}, i, {n}))) end"


def sql_jaccard(a: str, b: str) -> str:
    """Of gram sets: 1 where both are empty."""
    return f"case when len({a}) = 0 and len({b}) = 0 then 1.0 else len(list_intersect({a}, {b})) / greatest(len(list_distinct(list_concat({a}, {b}))), 1) end"


STATS = f"""stats as (
  select *, greatest(len - n_space, 1) as content, n_alpha / greatest(len - n_space, 1) as alpha, n_digit / greatest(len - n_space, 1) as digit,
    (len - n_alpha - n_digit - n_space) / greatest(len - n_space, 1) as symbol, n_upper / greatest(n_alpha, 1) as upper_share
  from (select *, length(text) as len, len({sql_tokens('text')}) as tokens, {sql_count('text', '\\p{L}')} as n_alpha, {sql_count('text', '\\p{Nd}')} as n_digit,
    {sql_count('text', '\\p{Lu}')} as n_upper, {sql_count('text', '\\s')} as n_space from documents))"""


def sql_side(c: str, p: str) -> str:
    """What gates look at of a text column, named p_...: lengths, tokens, ratios, stop words, endings."""
    alpha, digit, upper, space = (sql_count(c, k) for k in ("\\p{L}", "\\p{Nd}", "\\p{Lu}", "\\s"))
    content = f"greatest(length({c}) - {space}, 1)"
    return f"""length({c}) as {p}_len, len({sql_tokens(c)}) as {p}_tokens, {alpha} / {content} as {p}_alpha, {digit} / {content} as {p}_digit, (length({c}) - {alpha} - {digit} - {space}) / {content} as {p}_symbol,
  {upper} / greatest({alpha}, 1) as {p}_upper, {sql_hits(sql_words(c), 'english')} as {p}_hits, regexp_matches({c}, '[\\x00-\\x08\\x0E-\\x1B]') as {p}_control, {sql_endings(c)} as {p}_ends"""


def sql_endings(c: str) -> str:
    """Abbreviations and initials before a word lose their dots first."""
    words = "|".join(a.replace(".", "\\.") for a in sorted(ABBREVIATIONS, key=len, reverse=True))
    before, after = "(^|[^\\p{L}\\p{N}_])", "(\\s+[\\p{L}\\p{N}_])"
    s = f"regexp_replace(regexp_replace({c}, '{before}(?:[A-Z]\\.){{2,}}{after}', '\\1X\\2', 'g'), '(?i){before}(?:{words})\\.{after}', '\\1x\\2', 'g')"
    return f"len(regexp_extract_all({s}, '[.!?](?:[\"'')\\]]*\\s|$)'))"
