import hashlib

import pytest

from roamgrid.llm import chat_format, embedding_dedup, exact_dedup, jaccard_join, mixing, packing, quality, secret_scan, substring_dedup, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, salt string, norm string"
WORDS = " ".join(f"w{i}" for i in range(120))
ROWS = [(0, WORDS), (1, "x " + WORDS), (2, WORDS.upper()), (3, None), (4, ""), (5, " \n"), (6, "a b"), (6, "a b"), (7, "Orre " * 300), (None, WORDS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 4 else "s", None if t is None else len(t), "q", "r") for i, t in ROWS], DOCS)


def test_exact(docs):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert (by[0]["keep_id"], by[0]["group_size"], by[2]["kept"]) == (2, 3, True)
    assert (by[3]["keep_id"], by[4]["kept"]) == (4, True)
    assert sum(r["kept"] for r in got if r["doc_id"] == 6) == 1
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5, 6, 7]


@pytest.mark.parametrize(("op", "n"), [(substring_dedup.dedup_substrings, 50), (suffix_dedup.dedup_bytes, 50)])
def test_repeats(docs, op, n):
    split = (lambda t: t.encode().split()) if op is substring_dedup.dedup_substrings else (lambda t: [bytes([b]) for b in t.encode()])
    units = {i: split(t or "") for i, t in ROWS if i is not None}
    rows = op(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        own = units.get(r["doc_id"], split(WORDS))
        seen = {tuple(u[s : s + n]) for i, u in units.items() if r["doc_id"] is not None and i < r["doc_id"] for s in range(len(u) - n + 1)}
        gone = {k for s in range(len(own) - n + 1) if tuple(own[s : s + n]) in seen for k in range(s, s + n)}
        kept = [u for k, u in enumerate(own) if k not in gone]
        sep = b" " if op is substring_dedup.dedup_substrings else b""
        assert r["kept_sha256"] == hashlib.sha256(sep.join(kept)).hexdigest(), r["doc_id"]


def test_jaccard(docs):
    got = jaccard_join.similar_components(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by[0] == (116, 0) and by[1] == (117, 0) and by[2] == (116, 0)
    assert by[3] == (0, 3) and by[5] == (0, 5) and by[6] == (1, 6) and by[7] == (1, 7)


def test_mixing(docs):
    got = mixing.mix(docs, block_size=50).collect()
    assert len(got) == len(ROWS) and {r["source"] for r in got} == {"s", ""}
    ordered = mixing.in_mixed_order(docs)
    assert ordered.columns == docs.columns and ordered.count() == len(ROWS)


def test_packing(docs):
    rows = packing.pack(docs).orderBy("sequence_id", "offset").collect()
    assert len(rows) >= len(ROWS)
    place = {}
    for r in rows:
        assert place.get(r["sequence_id"], 0) == r["offset"]
        place[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(place.values()) <= packing.CAPACITY


def test_tokens_are_those_of_the_named_library():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text in ("", " a  b\n\n", "don't stop", "äöü ñ 漢字 🙂", "x" * 3000, "\x00\t1234,;!!"):
        assert t.encode(text, add_special_tokens=False).ids == list(packing.encoder(packing.VOCABULARY)(text))


def test_added_tokens_are_matched_in_the_text():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    assert list(packing.encoder(packing.VOCABULARY)(f"hello {end} world")) == [31373, 220, 50256, 995]
    for text in (end, end * 3, f"a{end}b", f" {end}\n\n{end} x", f"<|endof{end}text|>", f"é🙂{end[:-1]}{end}'s", "<|endoftext |>", end.upper()):
        assert t.encode(text, add_special_tokens=False).ids == list(packing.encoder(packing.VOCABULARY)(text)), text


def test_quality(docs, spark):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, None), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, quality.graded(labels)).collect()
    assert len(got) == len(ROWS) and all(r["p_tail"] is not None for r in got)
    none = quality.classify(docs, quality.graded(labels.limit(0)))
    assert all(r["kept"] for r in none.collect())


def test_secrets(spark):
    rows = [(0, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" AKIA' + "Z" * 16), (1, None), (1, "Secret: abc"), (2, "é token=token:abcdefg")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = sorted(((r["doc_id"], len(r["base"])) for r in secret_scan.scan_secrets(docs).collect()))
    assert got == [(0, 3), (1, 0), (1, 0), (2, 0)]


def test_secrets_that_one_source_copies_are_examples(spark):
    often, four, five, spread = ("".join(f"{c}{k}" for k in range(10, 20)) for c in "GHJK")
    held = {often: [(i, "s") for i in range(30)], four: [(i, "s") for i in range(4)], five: [(i, "s") for i in range(5)], spread: [(30, "a"), (31, "b"), (32, "c")]}
    rows = {}
    for value, places in held.items():
        for place in places:
            rows.setdefault(place, []).append(value)
    docs = spark.createDataFrame([(i, " ".join(v), s) for (i, s), v in rows.items()], "doc_id long, text string, source string")
    got = {r["doc_id"]: ([x["value"] for x in r["owned"]], r["n_live"], r["n_example"]) for r in secret_scan.scan_secrets(docs).collect()}
    want = {i: ([four] if (i, "s") in held[four] else [], int((i, "s") in held[four]), 1) for i, _ in rows}
    assert got == want


def test_chats_come_back(spark):
    texts = ["<|im_end|>", "\\<|", "<\\|im_sep|>", None, "", "a\\\\<|b"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for t in texts for r in ("user", "assistant", "assistant"))] + [(None, None, None, None)]
    back = chat_format.read_chats(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    one = next(r for r in back if r["conv_id"] == 1)
    assert [(t["role"], t["text"]) for t in one["turns"]] == [(r, t or "") for _, _, r, t in rows[:-1]]
    assert one["loss_texts"] == [t or "" for _, _, r, t in rows[:-1] if r == "assistant"]


def test_embeddings(spark):
    v = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [1.0, 0.0], None), (7, [1.0, float("nan")], 1), (8, [1.0, 0.0], 1), (9, [1.0, 0.0], 2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link_vectors(spark.createDataFrame(v, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 8: (3, 0), **{k: (0, k) for k in (3, 4, 5, 6, 7, 9)}}


def test_empty_tables(docs):
    none = docs.limit(0)
    for op in (exact_dedup.exact_dedup, substring_dedup.dedup_substrings, jaccard_join.similar_components, mixing.mix, packing.pack, secret_scan.scan_secrets):
        assert op(none).count() == 0
