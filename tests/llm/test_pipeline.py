"""The pipeline's five stages, one by one and together, against plain versions."""

import random

import corpus_pipeline
import pytest

from roamgrid.llm import _components, mixing, packing
from tests.llm.test_brute_force import check_packing, named_tokenizer, pieces_of, rated

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Rated documents with exact and near copies, nulls, an empty text, repeated rows, and a column named like the operators' own."""
    path = str(tmp_path_factory.mktemp("spark-corpus"))
    rng = random.Random(1)
    rows, labels = [], []
    for i, text, grade in rated(3600, 8):
        text += f" number {i} {i * 7} {i * 31}"
        rows.append((i, text, "en", rng.choice("aaaabbc"), len(text)))
        labels.append((i, int(grade != 0), int(grade == 1)))
        if rng.random() < 0.05:
            rows.append((10_000 + i, text.upper(), "en", "b", len(text)))
        if rng.random() < 0.05:
            rows.append((20_000 + i, text + " end", "en", "c", len(text) + 4))
    rows += [(50_000, None, None, None, None), (50_001, "", "en", "a", 0), rows[2], rows[2]]
    spark.createDataFrame([(*r, "p", 1) for r in rows], f"{DOCS}, place string, bucket int").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    at = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = collected(docs)
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        at[name] = (before, collected(docs))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    before, after = at["quality classifier"]
    kept = {r[0] for r in after}
    clean = {i for i, _, g in rated(3600, 8) if g == 2}
    assert len(kept & clean) >= 0.98 * len(clean) and len({i for i in kept if i < 3600} - clean) <= 0.03 * 1440
    before, after = at["exact dedup"]
    best = {}
    for r in before:
        t = (r[1] or "").lower()
        best[t] = max(best.get(t, -1), r[0])
    assert sorted(r[0] for r in after) == sorted(best.values())
    before, after = at["n-gram Jaccard join"]
    shingles = {r[0]: {tuple(w[k : k + 5]) for w in [(r[1] or "").lower().split()] for k in range(max(1, len(w) - 4)) if w} for r in before}
    links = [(i, j) for i in shingles for j in shingles if j < i and shingles[i] and 100 * len(shingles[i] & shingles[j]) >= 75 * len(shingles[i] | shingles[j])]
    assert links
    root = _components.local_roots(*zip(*links, strict=True))
    assert sorted(r[0] for r in after) == sorted(i for i in shingles if root.get(i, i) == i)
    before, after = at["mixing sources"]
    assert before == after
    before, after = at["best-fit packing"]
    t = named_tokenizer()
    rows = docs.collect()
    check_packing(rows, {r[0]: pieces_of(t, r[1]) for r in before})
    assert collected(corpus_pipeline.run(spark, sf_dir)) == after


def test_sequences_follow_the_target_weights(spark, tmp_path, monkeypatch):
    """In the first sequences a source has about its target weight of the tokens; without mixing it would have its share of the corpus."""
    monkeypatch.setattr(packing.pack_in_order, "__kwdefaults__", {**packing.pack_in_order.__kwdefaults__, "segment": 100})
    rng = random.Random(2)
    rows = [(i, " ".join(["word"] * rng.randrange(100, 300)), "en", "big" if i < 1600 else "small", None) for i in range(2000)]
    rows = [(*r[:4], len(r[1])) for r in rows]
    docs = spark.createDataFrame(rows, DOCS)
    source = {r[0]: r[3] for r in rows}
    docs.write.parquet(f"{tmp_path}/docs")
    mixed = mixing.in_mixed_order(spark.read.parquet(f"{tmp_path}/docs"), weights={"big": 0.5, "small": 0.5}, block_size=2000)
    mixed.write.parquet(f"{tmp_path}/mixed")
    share = {}
    for name in ("docs", "mixed"):
        rows = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/{name}"), str(tmp_path)).collect()
        few = sorted({r["sequence_id"] for r in rows})[:100]
        tokens = [(source[r["doc_id"]], r["length"]) for r in rows if r["sequence_id"] <= few[-1]]
        share[name] = sum(n for s, n in tokens if s == "small") / sum(n for _, n in tokens)
    assert abs(share["mixed"] - 0.5) < 0.1 and abs(share["docs"] - 0.2) < 0.21 and share["mixed"] > share["docs"] + 0.1
