"""The catalogue's queries against their SQL in DuckDB, and entry points without the llm folders."""

import subprocess
import sys

import duckdb
import pytest

from glyphmill.operators import retrieval
from glyphmill.plans import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_parity(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(map(repr, df.select(*columns).toPandas().astype(str).values.tolist()))
    sql = con.execute(catalog.ORACLE_SQL[name]).fetchdf()
    assert sorted(sql.columns) == columns
    assert mine == sorted(map(repr, sql[columns].astype(str).values.tolist()))


def test_top_k_by_brute_force(spark):
    import math
    from collections import Counter

    texts = {1: "the river bank", 2: "the bank river", 3: "a mountain", 4: "river", 5: "the  river  bank"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    w, _ = retrieval.tfidf(df, "id", "text")
    found = {(r.query, r["rank"]): (r.match, r.sim) for r in retrieval.top_k(w, w, "id", "id", 2, exclude_self=True).collect()}
    grams = {k: Counter(s[i : i + 3] for i in range(len(s) - 2)) for k, t in texts.items() for s in [" ".join(t.split())]}
    df_of = Counter(g for c in grams.values() for g in c)
    vectors = {}
    for k, c in grams.items():
        v = {g: n * (math.log(6 / (1 + df_of[g])) + 1) for g, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[k] = {g: x / norm for g, x in v.items()}
    brute = {}
    for q in texts:
        sims = sorted(((-round(sum(x * vectors[m].get(g, 0) for g, x in vectors[q].items()), 6), m) for m in texts if m != q))
        for rank, (s, m) in enumerate([x for x in sims if x[0] < 0][:2], 1):
            brute[q, rank] = (m, -s)
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in brute.items()}
    assert all(found[k][1] == pytest.approx(brute[k][1], abs=2e-6) for k in brute)


def test_search_equals_postings(spark):
    import random

    from glyphmill.shared import ship

    ship(spark)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["river", "bank", "old  stone", "am", "é", ""]) for _ in range(rng.randint(0, 8)))) for k in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    corpus, idf = retrieval.tfidf(df, "id", "text")
    queries = df.where("id % 5 = 0")
    w = retrieval.weighted(retrieval.counts(queries, "id", "text", 3, 3), idf, "id")
    key = lambda r: (r.query, r["rank"])
    one, other = ({key(r): r for r in x.collect()} for x in (retrieval.search(queries, df, "id", "text", 4, least=0.05), retrieval.top_k(w, corpus, "id", "id", 4, least=0.05)))
    assert one.keys() == other.keys() and all(one[k].sim == pytest.approx(other[k].sim, abs=2e-6) for k in one)
    assert retrieval.terms_of("Der alte Fluss", 1, 2, words=True) == {"Der": 1, "alte": 1, "Fluss": 1, "Der alte": 1, "alte Fluss": 1}
    assert retrieval.search(queries, df, "id", "text", 1, 1, 2, words=True, min_df=2, max_features=3).count() > 0


def test_trigrams_as_numbers():
    import pyarrow as pa

    texts = ["the  river \n bank 😀\U0010ffff\0x", "ab", "", None, "aaaa"] * 3
    for t in texts:
        found = {retrieval.trigram_text(k): n for k, n in zip(*(x.tolist() for x in retrieval.trigrams(t)))}
        assert found == retrieval.terms_of(t, 3, 3) and all(retrieval.trigram_text(retrieval.trigram_number(x)) == x for x in found)
    (got,) = retrieval.trigram_frequencies(iter([pa.RecordBatch.from_pydict({"text": texts})] * 2))
    assert dict(zip(got["term"].to_pylist(), got["n"].to_pylist())) == {x: 6 for t in set(texts) for x in retrieval.terms_of(t, 3, 3)}
    assert [b.num_rows for b in retrieval.trigram_frequencies(iter([]))] == [0]


def test_nearest_is_the_same_in_all_ways(spark, monkeypatch):
    import random

    from glyphmill.shared import ship

    ship(spark)
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["river", "bank", "old", "stones", "é"]) for _ in range(rng.randint(0, 7)))
    corpus = spark.createDataFrame([(k, text()) for k in range(80)] + [(99, None)], "row long, text string")
    queries = spark.createDataFrame([(k, text()) for k in range(20)], "id long, text string")
    run = lambda: {(r.query, r["rank"]): (r.match, round(r.sim, 5)) for r in retrieval.nearest(queries, corpus, "id", "row", "text", 2, 3, 5).collect()}
    found = retrieval.nearest(queries, corpus, "id", "row", "text", 2, 3, 5)
    # no row for each term of each text is made
    assert "Generate" not in found._jdf.queryExecution().toString()
    want = run()
    monkeypatch.setattr(retrieval, "CELLS", 0)
    assert run() == want
    monkeypatch.setattr(retrieval, "TERMS", 3)
    assert run() == want


def test_entry_points_without_the_llm_folders(tmp_path):
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "glyphmill", tmp_path / "glyphmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) < set(e.queries()); assert not any(q.startswith('op') and q[2].isdigit() or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
