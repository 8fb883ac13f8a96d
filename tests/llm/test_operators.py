"""The operators and the pipeline's stages on tables: odd rows, empty tables, clashing columns, and brute force."""

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import bpe, decontam, html, neardup, pii, quality, queries, secrets, shard, tokenbin, toxicity
from glyphmill.llm.queries import VOCABULARY
from glyphmill.shared import ship, write_shared
from tests.conftest import SF

PROSE = "Nine quiet rivers cross the old valley, and each of them carries a different story toward the market towns below. "
ROWS = [(1, PROSE * 3), (1, PROSE * 3), (2, None), (3, ""), (None, "nobody's row of a few plain words, mail ann@site.org"), (4, " \n "), (5, "long " * 30000 + "x" * 5000), (6, PROSE * 3 + "Extra."), (7, "tie"), (8, "tie")]
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CLASHING = ["verdict", "ratio", "rid", "row", "key", "position", "shard", "h", "place", "n_tokens", "keep"]


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    return docs.withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture(scope="module")
def network(trained):
    return trained


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


def operators(spark, network):
    bench = spark.createDataFrame([(1, PROSE), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (6, 0, 0), (7, 1, None)], "doc_id long, quality int, toxic int")
    return {
        "decontam": lambda d: decontam.contaminated(d, bench), "drop": lambda d: decontam.drop_contaminated(d, bench), "html": lambda d: html.extract_pages(d, page_id="doc_id", html="text"), "pii": lambda d: pii.spans_of(d, network),
        "redact": lambda d: pii.redact_documents(d, network, length="n_chars"), "bpe": lambda d: bpe.encode_documents(d, bpe.Bpe(VOCABULARY)), "quality": quality.compression_ratios, "good": quality.keep_good, "shard": shard.shuffled,
        "tokens": lambda d: tokenbin.shards(d, tokenbin.TokenShards(VOCABULARY, length=16, per_shard=64)), "near": neardup.near_duplicates, "dedup": neardup.drop_near_duplicates, "toxic": lambda d: toxicity.toxic_documents(d, labels), "secrets": secrets.secrets,
    }


@pytest.mark.parametrize("name", ["decontam", "drop", "html", "pii", "redact", "bpe", "quality", "good", "shard", "tokens", "near", "dedup", "toxic", "secrets"])
def test_odd_rows_and_empty_tables(spark, odd, network, name):
    run = operators(spark, network)[name]
    assert run(odd.limit(0)).count() == 0
    out = run(odd)
    n = out.count()
    wanted = {"html": 10, "redact": 10, "bpe": 10, "quality": 10, "shard": 10}
    if name in wanted:
        assert n == wanted[name]
    if name in ("drop", "redact", "good", "dedup"):
        assert out.columns == odd.columns
    if name == "decontam":
        assert sorted((r.doc_id, r.item_id) for r in out.collect()) == [(1, 1), (1, 1), (6, 1)]
    if name == "good":
        assert {r.doc_id for r in out.select("doc_id").collect()} >= {7, 8} and not out.where("doc_id in (2, 3)").count()
    if name == "near":
        assert sorted((r.doc_id, r.kept_doc_id, r.rows) for r in out.collect()) == [(1, 1, 1), (6, 1, 1), (8, 7, 1)]
    if name == "dedup":
        assert sorted(r.doc_id or 0 for r in out.select("doc_id").collect()) == [0, 1, 2, 3, 4, 5, 7]
    if name == "shard":
        assert sorted(r.position for r in out.select("position").collect()) == list(range(10))
    if name == "bpe":
        assert all(r.round_trip for r in out.collect())
    if name == "drop":
        assert sorted(r.doc_id or 0 for r in out.select("doc_id").collect()) == [0, 2, 3, 4, 5, 7, 8]
    if name in ("toxic", "secrets"):
        assert n == 0
    if name == "pii":
        texts = [t for _, t in ROWS]
        wanted = pii._by_text(pa.array([t or "" for t in texts]), network, pii.Pii())
        assert sorted((r.doc_id or 0, [(x.start, x.end, x.label) for x in r.spans]) for r in out.collect()) == sorted((ROWS[i][0] or 0, x) for i, x in wanted.items())
    if name == "tokens":
        exact = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})
        assert sum(r.n_sequences for r in out.collect()) == sum(-(-(len(exact.encode_ordinary(t)) + 1) // 16) for _, t in ROWS if t)


def test_personal_data_carriers(spark, odd, table, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "fit", lambda texts, p: seen.append(texts) or {})
    for docs in (odd, odd.limit(0), table("documents")):
        pii.train(docs, pii.Pii(carriers=50))
    assert sorted(seen[0]) == sorted({t for _, t in ROWS if t}) and seen[1] == [] and len(seen[2]) == len(set(seen[2])) == 50
    pii.train(table("documents"), pii.Pii(carriers=50))
    assert seen[3] == seen[2]


def test_near_duplicates_against_brute_force(table):
    docs = table("documents").select("doc_id", "text")
    rows = docs.collect()
    found, at, key = neardup.shingles(pa.array([r.text for r in rows]), 3)
    sets = [set(found[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])]
    group = {r.doc_id: r.root for r in neardup.groups(docs).collect()}
    caught = [group.get(rows[i].doc_id) is not None and group.get(rows[i].doc_id) == group.get(rows[j].doc_id) for i, j in pairs]
    assert pairs and np.mean(caught) >= 0.9
    near = {d for p in pairs for d in (rows[p[0]].doc_id, rows[p[1]].doc_id)}
    assert set(group) <= near


def test_token_shards_hold_every_document(table, tmp_path):
    p = tokenbin.TokenShards(VOCABULARY, length=64, per_shard=128)
    docs = table("documents").select("doc_id", "text")
    made = tokenbin.shards(docs, p)
    written = tokenbin.write_shards(made, str(tmp_path)).collect()
    n = sum(r.bytes for r in written) // p.stride
    exact = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})
    rows = docs.withColumn("h", F.xxhash64("text")).orderBy("doc_id", "h").collect()
    sequences = []
    for r in rows:
        ids = [*exact.encode_ordinary(r.text), p.end]
        ids += [p.pad] * (-len(ids) % p.length)
        sequences += [ids[i : i + p.length] for i in range(0, len(ids), p.length)]
    assert len(sequences) == n
    slots = shard.permute(np.arange(n), n, p.key)
    for k in (0, 1, n // 2, n - 1):
        assert tokenbin.read_sequence(str(tmp_path), int(slots[k]), p).tolist() == sequences[k]
    assert not any(r.written for r in tokenbin.write_shards(made, str(tmp_path)).collect())


def test_token_query_writes_and_resumes(spark):
    made = queries.op7_token_binary(spark, SF)
    assert made.columns == ["shard", "first_slot", "n_sequences", "stride", "path", "bytes"]
    rows = made.collect()
    want = {r.shard: bytes(r.payload) for r in tokenbin.shards(spark.read.parquet(f"{SF}/documents.parquet"), tokenbin.TokenShards(VOCABULARY)).collect()}
    read = lambda: {r.shard: open(r.path, "rb").read() for r in rows}
    assert rows and read() == want and all(r.bytes == r.n_sequences * r.stride == len(want[r.shard]) for r in rows)
    with open(rows[0].path, "r+b") as f:
        f.write(bytes([want[rows[0].shard][0] ^ 1]))
    assert queries.op7_token_binary(spark, SF).collect() and read() == want


FEW = pytest.mark.xfail(strict=True, reason="with 35 confirmed toxic rows to learn from, 18 of 35 held-out ones are found")


@pytest.mark.parametrize("size", [pytest.param("sf0.01", marks=FEW), "sf0.1"])
def test_toxicity_held_out(spark, size):
    sf = f"/root/testdata/{size}"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    seen, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    found = {r.doc_id for r in toxicity.toxic_documents(docs, seen).collect()}
    truth = {r.doc_id: r.toxic for r in held.collect()}
    positive = {d for d, t in truth.items() if t}
    assert len(found & positive) >= 0.8 * len(positive)
    assert len(found & (set(truth) - positive)) <= 0.05 * len(truth)


def test_toxicity_counts_terms_over_all_documents(spark):
    ship(spark)
    # above both sample sizes: 40,000 documents, 4,100 of them confirmed, 12 of those by a word that few documents hold
    rare, common = "id < 18", "id % 8 = 0"
    text = f"concat('plain words of row ', cast(id % 7 as string), ' run on ', case when {rare} then 'zorgblat' when {common} then 'fraknor' else 'quietly' end, ' to their end')"
    docs = spark.range(40_000).selectExpr("id as doc_id", f"{text} as text")
    labels = spark.range(40_000).where(f"id < 12 or {common} and id >= 18 and id < 32722 or id % 8 = 1 and id >= 18").selectExpr("id as doc_id", f"cast(id < 12 or {common} as int) as toxic")
    found = {r.doc_id for r in toxicity.toxic_documents(docs, labels).collect()}
    assert set(range(18)) <= found
    assert found - set(range(18)) == {i for i in range(18, 40_000) if i % 8 == 0}


def test_pipeline_stages(spark, odd, table, network, monkeypatch):
    docs = table("documents")
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "decontamination", "pii", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        monkeypatch.setattr(pii, "train", lambda docs: network)
        assert stage(spark, odd.limit(0), SF).count() == 0
        strange = stage(spark, odd, SF)
        out = write_shared(stage(spark, docs, SF), "stage")
        n, kept = docs.count(), out.count()
        if name == "bpe":
            assert strange.count() == 10 and kept == n and all(r.round_trip for r in out.select("round_trip").collect())
            decoded = {r.doc_id: r.text for r in bpe.decode_documents(out, bpe.Bpe(VOCABULARY)).collect()}
            assert decoded == {r.doc_id: r.text for r in docs.collect()}
            continue
        assert strange.columns == odd.columns and out.columns == docs.columns and strange.count() == {"quality rules": quality.compression_ratios(odd).where("verdict = 'keep'").count(), "near dedup": 7, "decontamination": 10, "pii": 10}[name]
        assert kept == n if name == "pii" else kept < n and (name == "decontamination" or 0.6 * n < kept)
        if name == "pii":
            before, after = ({r.doc_id: r for r in d.collect()} for d in (docs, out))
            changed = [k for k in after if after[k].text != before[k].text]
            assert changed and all(after[k].n_chars == len(after[k].text) for k in after) and all("[" in after[k].text for k in changed)
        docs = out
