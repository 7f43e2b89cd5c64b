"""Whole operators against plain versions on small fixtures."""

import random
import zlib

import numpy as np
import pytest

from roamgrid.llm import _components, embedding_dedup, jaccard_join, packing, quality, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def named_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    return tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def corpus(n=120, seed=7):
    rng = random.Random(seed)
    words = ["tree", "house", "of", "the", "Fluß", "a", "1234", "...", "don't", "漢字", "\n\n", "🙂"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 300, 2500])))
        if rng.random() < 0.1:
            text += "<|endoftext|> and more"
        rows.append((i, None if i == 5 else text, "en", rng.choice("pqr"), len(text)))
    rows.append((n, " " * 1_000_000 + "a", "en", "p", 1_000_001))
    rows.append((n + 1, "\n" * 1_000_000, "en", "p", 1_000_000))
    rows.append((n + 2, "z" * 60_000, "en", "p", 60_000))
    return rows


def pieces_of(tokenizer, text):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.EOS]
    first = len(ids) % packing.CAPACITY
    cuts = [0, *range(first, len(ids), packing.CAPACITY), len(ids)] if first else [*range(0, len(ids), packing.CAPACITY), len(ids)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def check_packing(got, want, slack=2):
    """got rows against want {doc_id: pieces}: the same pieces, sequences without gaps, and few of them."""
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted((i, *p) for i, ps in want.items() for p in ps)
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= packing.CAPACITY
    least = -(-sum(filled.values()) // packing.CAPACITY)
    assert len(filled) <= least + max(slack, least // 50)
    return filled


def test_packing_in_every_column(spark):
    rows = corpus()
    t = named_tokenizer()
    got = packing.pack(spark.createDataFrame(rows, DOCS)).collect()
    check_packing(got, {r[0]: pieces_of(t, r[1]) for r in rows})


def test_sequences_follow_the_order_of_files(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(["word"] * rng.randrange(50, 400)), "en", "s", 0) for i in rng.sample(range(400), 400)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/d")
    got = packing.pack_in_order(spark.read.parquet(f"{tmp_path}/d"), segment=50).collect()
    place = {r[0]: k for k, r in enumerate(rows)}
    numbers = np.array([[place[r["doc_id"]], r["sequence_id"]] for r in got]).T
    assert np.corrcoef(numbers)[0, 1] > 0.95
    assert sorted(set(numbers[1])) == list(range(numbers[1].max() + 1))
    t = named_tokenizer()
    check_packing(got, {r[0]: pieces_of(t, r[1]) for r in rows}, slack=16)


@pytest.mark.parametrize(("shard", "dense"), [(8192, 0.0), (64, 0.0), (64, 0.5)])
def test_embeddings_with_links(spark, shard, dense, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", shard)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 100)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 16))
    v = []
    for i in range(500):
        c = centres[0] if rng.random() < dense else centres[rng.integers(60)]
        x = c + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.15, 1.0])
        v.append((i, [float(y) for y in x * rng.uniform(0.1, 10)], int(rng.integers(2))))
    unit = np.array([x / np.linalg.norm(x) for _, x, _ in v])
    label = np.array([x[2] for x in v])
    cosine = unit @ unit.T
    assert not ((cosine > 0.98 - 1e-9) & (cosine < 0.98 + 1e-9)).any()
    link = (cosine >= 0.98) & (label[:, None] == label) & ~np.eye(len(v), dtype=bool)
    assert link.sum() > 500
    a, b = np.nonzero(link)
    root = _components.local_roots(a.tolist(), b.tolist())
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_vectors(spark.createDataFrame(v, "vec_id long, embedding array<double>, label int")).collect()}
    want = {i: (int(link[i].sum()), root.get(i, i), root.get(i, i) == i) for i in range(len(v))}
    missing = sum(want[i][0] - got[i][0] for i in want)
    assert got.keys() == want.keys() and 0 <= missing <= 0.01 * link.sum()
    if not missing:
        assert got == want


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(_components, "LEAST_PART", 8)
    rng = random.Random(2)
    ids = rng.sample(range(10_000), 900)
    hub, chain = [(ids[0], x) for x in ids[1:400]], list(zip(ids[400:460], ids[401:461], strict=True))
    links = hub + chain + [(ids[460 + i], ids[460 + rng.randrange(max(1, i))]) for i in range(100)] + [(ids[399], ids[400]), (ids[7], ids[0])]
    got = {r["node"]: r["component"] for r in _components.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    root = _components.local_roots(*zip(*links, strict=True))
    assert got == {x: r for x, r in root.items() if x != r}


def test_long_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    links = [(i, j) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = _components.local_roots(*zip(*links, strict=True))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), root.get(i, i)) for i in range(150)}


def test_secrets_in_every_column(spark):
    import re

    rng = random.Random(9)
    token = lambda n: "".join(rng.choice("abcdef0123456789") for _ in range(n))
    shared = ["zz" + token(22) + "Q1", "yy" + token(30)]
    rows = []
    for i in range(80):
        parts = [rng.choice(["plain words", "password: hunter2x", f'api_key="{token(8)}"', "AKIA" + "Q7" * 9, token(24), "token=abc", "x" + token(25) + "Zé", *shared]) for _ in range(rng.randrange(6))]
        rows.append((i, None if i == 3 else " ~ ".join(parts), rng.choice("stu")))
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
    found = {}
    for i, t, _ in rows:
        t = t or ""
        base = [(m.start(), 0, m.end(), m.group(2)) for m in assign.finditer(t) if len(m.group(2)) >= 6]
        base += [(m.start(), 1, m.end(), m.group()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
        base += [(m.start(), 2, m.end(), m.group()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
        more = [(m.start(), 3, m.end(), m.group()) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t) if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())]
        found[i] = (sorted(base), [c for c in more if not any(b[0] < c[2] and c[0] < b[2] for b in base)])
    held = {}
    for i, _, s in rows:
        for c in found[i][0] + found[i][1]:
            held.setdefault(c[3], []).append((s, i))
    live = {v for v, h in held.items() if len({s for s, _ in h}) == 1 and len({i for _, i in h}) <= 4}
    copied = {v for v, h in held.items() if len({s for s, _ in h}) >= 3 or len({i for _, i in h}) >= 10}
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i in found:
        base, more = found[i]
        assert [tuple(x) for x in got[i]["base"]] == base
        assert [tuple(x) for x in got[i]["owned"]] == [c for c in more if c[3] in live]
        assert got[i]["n_live"] == sum(c[3] in live for c in base + more)
        assert got[i]["n_example"] == sum(c[3] in copied for c in base + more)


def rated(n=3600, seed=4):
    rng = random.Random(seed)
    good, low, toxic = ["river", "garden", "letter", "window", "summer"], ["click", "buy", "$$$", "free"], ["hatea", "hateb"]
    rows = []
    for i in range(n):
        grade = (0, 0, 1, 1, 2, 2, 2, 2, 2, 2)[i % 10]
        words = [rng.choice(good) for _ in range(rng.randrange(20, 60))]
        for k in range(len(words)):
            if grade == 0 and rng.random() < 0.4:
                words[k] = rng.choice(low)
            if grade == 1 and rng.random() < 0.2:
                words[k] = rng.choice(toxic)
        rows.append((i, " ".join(words), grade))
    return rows


def test_grades_of_held_out_rows(spark):
    rows = rated()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows if i < 3000], "doc_id long, grade int")
    got = {r["doc_id"]: r for r in quality.classify(docs, ratings).collect()}
    weights, thresholds = quality.train(docs, ratings)
    assert list(thresholds) == sorted(thresholds)
    right = 0
    for i, t, g in [*rows, (5000, None, None), (5001, "", None)]:
        index, value = quality.features(np.frombuffer((t or "").encode(), np.uint8))
        score = sum(float(weights[k]) * float(x) for k, x in zip(index, value, strict=True))
        above = [1 / (1 + np.exp(-(score - th))) for th in thresholds]
        assert got[i]["expected_grade"] == pytest.approx(sum(above), abs=1e-4)
        assert got[i]["p_tail"] == pytest.approx(above[quality.KEEP_GRADE - 1], abs=1e-4)
        assert got[i]["kept"] == (got[i]["p_tail"] >= quality.KEEP_PROBABILITY)
        if g is not None and i >= 3000:
            right += got[i]["kept"] == (g == 2)
    assert right >= 0.95 * 600
