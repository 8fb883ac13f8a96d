"""Malformed and very long texts, ids of other types, rows that are alike, stale folders; kernels against plain definitions."""

import html.parser
import json
import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from glyphmill.llm import html as pages
from glyphmill.llm import neardup, pii, quality, secrets, shard, tokenbin, toxicity
from glyphmill.llm.queries import VOCABULARY
from glyphmill.shared import ship
from tests.conftest import SF


@pytest.mark.parametrize("page", ["<a " * 300_000, '<a "' * 250_000 + ">", '<a ">" ' * 150_000, "<div hidden>" + "<div>" * 150_000, "<a '\">" * 150_000, "<" * 500_000, "<!--" * 200_000])
def test_malformed_pages_take_linear_time(page):
    began = time.process_time()
    text, n, kept = pages.extract(page)
    assert time.process_time() - began < 30 and 0 <= kept <= n


def test_hidden_elements_end_with_their_own_tag():
    texts = lambda page: [b.text for b in pages.blocks(page)]
    assert texts("<div hidden><div></div> LEAKED</div><p>seen</p>") == ["seen"]
    assert texts("<div style='display: none'><p>a</p><div>b<br></div></div>after") == ["after"]
    assert texts("<p title='a > b'>x</p><p title=\"it's\">y</p>1 < 2 <3>") == ["x", "y", "1 < 2 <3>"]


class Plain(html.parser.HTMLParser):
    """Blocks of well-formed pages by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.found, self.parts, self.silent = [], [], 0

    def cut(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.found.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in pages.BLOCK and not self.silent:
            self.cut()
        if tag in pages.SILENT or tag == "title":
            self.silent += 1

    def handle_endtag(self, tag):
        if tag in pages.SILENT or tag == "title":
            self.silent = max(0, self.silent - 1)
        elif tag in pages.BLOCK and not self.silent:
            self.cut()

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def test_blocks_against_the_standard_parser():
    same = total = 0
    for page in pq.read_table(f"{SF}/pages.parquet")["html"].to_pylist():
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.cut()
        total += 1
        same += [b.text for b in pages.blocks(page)] == plain.found
    assert total and same >= 0.95 * total


def test_second_pass_against_its_definition():
    rng = random.Random(5)
    for _ in range(300):
        found = [pages.Block("x" * rng.choice((10, 90, 250)), "p", 0, False, rng.choice(("bad", "short", "good", "near_good"))) for _ in range(rng.randint(0, 12))]
        kinds = [b.kind for b in found]

        def near(kinds, i, way, skip):
            i += way
            while 0 <= i < len(kinds) and kinds[i] in skip:
                i += way
            return kinds[i] if 0 <= i < len(kinds) else "bad"

        second = list(kinds)
        for i, k in enumerate(kinds):
            if k == "short":
                sides = {way: near(kinds, i, way, ("short", "near_good")) for way in (-1, 1)}
                if sides[-1] == sides[1]:
                    second[i] = sides[1]
                else:
                    bad = -1 if sides[-1] == "bad" else 1
                    second[i] = "good" if near(kinds, i, bad, ("short",)) == "near_good" else "bad"
        wanted = [k == "good" or k == "near_good" and "good" in (near(second, i, -1, ("near_good",)), near(second, i, 1, ("near_good",))) for i, k in enumerate(second)]
        assert pages.decide(found, pages.Rules()) == wanted


@pytest.mark.parametrize("text", ["A" * 1_000_000, "ACGT" * 250_000, "aB" * 300_000, "a1!" * 200_000, "password=" * 100_000])
def test_secrets_in_very_long_runs_take_linear_time(text):
    began = time.process_time()
    secrets.find(pa.array([text]), secrets.Secrets())
    assert time.process_time() - began < 60


def test_secret_classes_against_patterns():
    rng = random.Random(8)
    for _ in range(4000):
        s = "".join(rng.choice("abAB_-/") for _ in range(rng.randint(1, 14)))
        wanted = "letters" if re.search(r"[a-z][A-Z].*[a-z][A-Z]|[A-Z]{2}.*[a-z].*[A-Z]", s) else "plain"
        assert secrets.kind_of(s.encode()) == wanted, s


def test_secrets_after_other_characters_than_ascii():
    text = "ñé漢 password=Xk9$v2Lq!mR7 ünd tökén"
    ((_, a, b, _, _),) = secrets.find(pa.array(["", text]), secrets.Secrets())
    assert text[a:b] == "Xk9$v2Lq!mR7"


def test_quality_verdicts_by_brute_force(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r.verdict for r in quality.compression_ratios(docs, columns=["doc_id"]).collect()}
    press = zstandard.ZstdCompressor(level=quality.Bands().level)
    ratio = {r.doc_id: len(data) / len(press.compress(data)) if (data := (r.text or "").encode()) else None for r in docs.collect()}
    kept = [ratio[k] for k, v in found.items() if v == "keep"]
    assert len(found) == len(ratio) and len(kept) > 100
    # whatever is squeezed hardest is rejected as repetitive
    assert all(found[k] != "keep" for k in sorted(ratio, key=lambda k: -(ratio[k] or 0))[:3] if ratio[k] > max(kept))


def test_ids_that_are_strings(spark):
    ship(spark)
    text = "Seven plain words stand in this row and then a few more of them"
    docs = spark.createDataFrame([("b", text), ("a", text + "."), ("c", "nothing like it at all"), (None, None)], "doc_id string, text string")
    assert [(r.doc_id, r.kept_doc_id) for r in neardup.near_duplicates(docs).collect()] == [("b", "a")]
    assert sorted(r.doc_id or "" for r in neardup.drop_near_duplicates(docs).collect()) == ["", "a", "c"]
    many = spark.range(300).selectExpr("concat('d', id) as doc_id", "concat('words of row ', id % 7, if(id % 5 = 0, ' fraknor', ' quietly'), ' and on') as text")
    labels = spark.range(150).selectExpr("concat('d', id) as doc_id", "cast(id % 5 = 0 as int) as toxic")
    assert {r.doc_id for r in toxicity.toxic_documents(many, labels).collect()} == {f"d{k}" for k in range(0, 300, 5)}
    assert sorted(r.position for r in shard.assign(docs).collect()) == [0, 1, 2, 3]


def test_rows_that_are_alike_are_spread(spark):
    ship(spark)
    n = 400_000
    docs = spark.range(n).selectExpr("if(id % 4 = 0, id, null) as doc_id", "cast(null as string) as text", "id % 3 as position")
    out = shard.assign(docs).cache()
    assert out.agg(F.count_distinct("position")).first()[0] == n == out.count()
    assert out.agg(F.max("position")).first()[0] == n - 1
    out.unpersist()
    ranged = docs.withColumn("s", F.pmod(F.monotonically_increasing_id(), F.lit(8192))).repartitionByRange(4, "doc_id", "text", "s")
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.5 * n


def test_components_on_the_driver_and_by_stars(spark):
    rng = random.Random(3)
    from glyphmill.shared import write_shared

    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + k, 501 + k) for k in range(40)] + [(1000, 1001 + k) for k in range(50)]
    edges = [(a, b) for a, b in edges if a != b]
    table = write_shared(spark.createDataFrame(edges, "a long, b long"), "edges")
    rows = [sorted((r.u, r.v) for r in neardup.components(table, local).collect()) for local in (10**6, 0)]
    assert rows[0] == rows[1]
    root = {k: k for e in edges for k in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert dict(rows[0]) == {k: v for k, v in root.items() if k != v}


def test_hubs_with_many_pairs_are_cut_into_runs(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(neardup, "SALT", 3)
    base = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(k, base + f" tail{k}") for k in range(20)] + [(30, "quite another text of its own")], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept_doc_id, r.rows) for r in neardup.near_duplicates(docs).collect()) == [(k, 0, 1) for k in range(1, 20)]


def test_batches_for_python_are_bounded_by_bytes(spark):
    ship(spark)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    long = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("some words "), 1000).alias("text"))
    found = long.mapInArrow(run, "n long, bytes long").collect()
    assert sum(r.n for r in found) == 4000 and max(r.bytes for r in found) < 8 << 20


def test_shards_of_another_key_or_corpus_are_not_kept(spark, tmp_path):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    read = lambda: {f.name: f.read_bytes() for f in tmp_path.glob("*.bin")}
    make = lambda d, **k: tokenbin.materialise(d, tokenbin.TokenShards(VOCABULARY, length=64, per_shard=128, rounds=3, **k), str(tmp_path)).collect()
    rows = make(docs)
    first = read()
    assert len(rows) == len(first) and all(r.written for r in rows)
    assert not any(r.written for r in make(docs)) and read() == first
    assert all(r.written for r in make(docs, key=5)) and read().keys() == first.keys() and all(read()[k] != first[k] for k in first)
    few = make(docs.where("doc_id < 20"))
    manifest = json.loads((tmp_path / "manifest.json").read_text())
    assert len(few) == len(read()) == manifest["shards"] < len(first) and manifest["key"] == 97
    with pytest.raises(ValueError, match="does not fit"):
        make(docs, end=70_000)


def test_a_round_of_shards_moves_its_sequences_alone(spark, tmp_path):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    p = tokenbin.TokenShards(VOCABULARY, length=64, per_shard=128, rounds=3)
    made = tokenbin.materialise(docs, p, str(tmp_path))
    assert len(made.inputFiles()) == 3
    held = tokenbin.sequences(docs, p)
    for first, last in ((0, 1), (5, held.n // 2), (held.n // 2, held.n + 9)):
        rows = tokenbin.slotted(spark, held, p, first, last).collect()
        assert sorted(r.slot for r in rows) == list(range(first, min(last, held.n)))
        assert all(bytes(r.ids) == tokenbin.read_sequence(str(tmp_path), r.slot, p).tobytes() for r in rows[:200])


def test_ids_of_tasks_that_failed_are_not_taken(spark, tmp_path, monkeypatch):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    p = tokenbin.TokenShards(VOCABULARY, length=64, per_shard=128)
    want = sorted(tokenbin.shards(docs, p).collect())
    real = tokenbin.tokenised

    def twice(rows, p, folder):
        assert real(rows.where("doc_id < 30"), p, folder).count() and real(rows, p, folder).count()
        return real(rows, p, folder)

    monkeypatch.setattr(tokenbin, "tokenised", twice)
    assert sorted(tokenbin.shards(docs, p).collect()) == want


def test_risk_and_gradient():
    rng = np.random.default_rng(0)
    for prior, shift in ((0.05, 0), (0.9, -3)):
        positive = np.arange(12) < 5
        z = rng.normal(size=12) + np.where(positive, -shift, shift)
        s = 1 / (1 + np.exp(-z))
        first, second, g = toxicity.risk_and_gradient(z, positive, prior)
        assert first == pytest.approx(prior * (1 - s[positive]).mean()) and second == pytest.approx(s[~positive].mean() - prior * s[positive].mean())
        for i in range(12):
            ends = []
            for step in (1e-5, -1e-5):
                moved = z.copy()
                moved[i] += step
                a, b, _ = toxicity.risk_and_gradient(moved, positive, prior)
                ends.append(a + b if second >= 0 else -b)
            assert g[i] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6)
