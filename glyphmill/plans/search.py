"""Queries over benchmark items and documents: TF-IDF retrieval, reranking, ensembles, selection among candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators import retrieval
from glyphmill.operators.ordering import first_by
from glyphmill.plans.common import r6, read, sql_tokens


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


def tm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents nearest to each benchmark item by TF-IDF of three characters."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.search(items(spark, sf_dir), docs, "id", "text", 5, least=0.05)


def neighbours(spark: SparkSession, sf_dir: str, n: int = 3, k: int = 3) -> DataFrame:
    """(query, match, sim, rank) among the items themselves."""
    weights, _ = retrieval.tfidf(items(spark, sf_dir), "id", "text", n, n)
    return retrieval.top_k(weights, weights, "id", "id", k, exclude_self=True)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, match, sim, rank, text) of the n-best list."""
    return neighbours(spark, sf_dir).join(items(spark, sf_dir).withColumnRenamed("id", "match"), "match")


def knn_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the n-best list after penalties for marks, length and digits."""
    size = items(spark, sf_dir).agg(F.avg(F.length("text")).alias("mean"), F.stddev_pop(F.length("text")).alias("std"))
    scored = candidates(spark, sf_dir).crossJoin(F.broadcast(size))
    scored = scored.withColumn("score", r6(retrieval.rule_score(F.col("sim"), F.col("text"), F.col("mean"), F.col("std"))))
    return first_by(scored.select("query", "match", "rank", "score"), ["query"], [F.desc("score"), F.asc("rank")])


def retrieval_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two models pooled, mean similarity, best first."""
    pooled = neighbours(spark, sf_dir, 3).unionByName(neighbours(spark, sf_dir, 2))
    mean = pooled.groupBy("query", "match").agg(r6(F.avg("sim")).alias("sim"), F.count("*").alias("models"))
    return first_by(mean, ["query"], [F.desc("sim"), F.asc("match")])


def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of R15 with a proxy: similarity less a weight of length stands in for both scores (`noisy_channel` has R15 itself)."""
    grid = F.explode(F.array(*map(F.lit, (0.0, 0.5, 1.0)))).alias("weight")
    kept = candidates(spark, sf_dir).where("rank <= 2").select("query", "match", "rank", "sim", F.length("text").alias("n"), grid)
    scored = kept.withColumn("score", r6(F.col("sim") - F.col("weight") * F.log(F.col("n") + 1) / 10))
    return first_by(scored.select("weight", "query", "match", "rank", "score"), ["weight", "query"], [F.desc("score"), F.asc("rank")])


def oracle_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of E3 with a proxy, the F-measure of distinct words, that SQL can repeat (`oracle_choice` has E2 and E3 themselves)."""
    bag = lambda c: F.array_distinct(X.tokens(F.lower(F.col(c))))
    gold = items(spark, sf_dir).select(F.col("id").alias("query"), bag("text").alias("gold"))
    c = candidates(spark, sf_dir).select("query", "match", "rank", bag("text").alias("words")).join(gold, "query")
    c = c.withColumn("f", r6(2 * F.size(F.array_intersect("words", "gold")) / F.greatest(F.size("words") + F.size("gold"), F.lit(1))))
    return first_by(c.select("query", "match", "rank", "f"), ["query"], [F.desc("f"), F.asc("rank")])


QUERIES = {f.__name__: f for f in (tm_topk, knn_rerank, retrieval_ensemble, candidate_selection, oracle_pick)}


def sql_terms(source: str, n: int) -> str:
    s = "regexp_replace(text, '\\s\\s+', ' ', 'g')"
    return f"select id, term, count(*) as tf from (select id, unnest(list_transform(range(1, length({s}) - {n} + 2), lambda i: substr({s}, i, {n}))) as term from {source}) group by id, term"


def sql_weights(tf: str, idf: str) -> str:
    return f"select id, term, w / sqrt(sum(w * w) over (partition by id)) as weight from (select id, term, tf * idf as w from {tf} join {idf} using (term))"


def sql_neighbours(n: int) -> str:
    return f"""items_{n} as ({sql_terms('items', n)}), idf_{n} as (select term, ln((1 + (select count(*) from items)) / (1 + count(*))) + 1 as idf from items_{n} group by term), weights_{n} as ({sql_weights(f'items_{n}', f'idf_{n}')}),
sims_{n} as (select a.id as query, b.id as match, round(sum(a.weight * b.weight), 6) as sim from weights_{n} a join weights_{n} b using (term) where a.id <> b.id group by a.id, b.id),
near_{n} as (select * from (select *, row_number() over (partition by query order by sim desc, match) as rank from sims_{n} where sim >= 0) where rank <= 3)"""


_ITEMS = "items as (select item_id as id, text from benchmark)"
_CANDIDATES = f"{_ITEMS}, {sql_neighbours(3)}, candidates as (select query, match, sim, rank, text from near_3 join items on match = id)"
_PICK = lambda keys, order, columns, source: f"select {columns} from (select *, row_number() over (partition by {keys} order by {order}) as k from {source}) where k = 1"
_BAG = lambda c: f"list_distinct({sql_tokens(f'lower({c})')})"

ORACLE_SQL = {
    "knn_rerank": f"with {_CANDIDATES}, size as (select avg(length(text)) as mean, stddev_pop(length(text)) as std from items), scored as (select *, round(sim - 0.1 * cast(len(regexp_extract_all(text, '[.!?]')) > 1 as int) - 0.05 * abs(length(text) - mean) / case when std > 0 then std else 1.0 end - 0.2 * (length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1)), 6) as score from candidates, size) "
    + _PICK("query", "score desc, rank", "query, match, cast(rank as int) as rank, score", "scored"),
    "retrieval_ensemble": f"with {_ITEMS}, {sql_neighbours(3)}, {sql_neighbours(2)}, pooled as (select * from near_3 union all select * from near_2), mean as (select query, match, round(avg(sim), 6) as sim, count(*) as models from pooled group by query, match) "
    + _PICK("query", "sim desc, match", "query, match, sim, models", "mean"),
    "candidate_selection": f"with {_CANDIDATES}, scored as (select *, round(sim - weight * ln(length(text) + 1) / 10, 6) as score from candidates, (select unnest([0.0::double, 0.5::double, 1.0::double]) as weight) where rank <= 2) "
    + _PICK("weight, query", "score desc, rank", "weight, query, match, cast(rank as int) as rank, score", "scored"),
    "oracle_pick": f"with {_CANDIDATES}, scored as (select c.*, round(2 * len(list_intersect({_BAG('c.text')}, {_BAG('i.text')})) / greatest(len({_BAG('c.text')}) + len({_BAG('i.text')}), 1), 6) as f from candidates c join items i on c.query = i.id) "
    + _PICK("query", "f desc, rank", "query, match, cast(rank as int) as rank, f", "scored"),
}
