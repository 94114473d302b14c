import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import packing, token_counts, topk
from quillgraph.llm.tokens import byte_bpe, vocabulary, word_bpe

VECTORS = "vec_id long, embedding array<float>, label int"


def top_brute(rows, queries, k=5):
    import math

    q = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for i in queries:
        for v in q.get(i, []):
            s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, ws in q.items() if j != i for w in ws)[:k]
            out += [(i, rank + 1, j, -x) for rank, (x, j) in enumerate(s)]
    return sorted(out)


def top_rows(df, **more):
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), **more)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


def test_top_k_against_brute_force(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(12)]) for i in range(230)]
    rows += [(300 + i, [0.5] * 12) for i in range(20)]  # ties
    rows += [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (404, []), (405, [0.25] * 7), (406, [1e30] + [0.0] * 11), (450, [0.5] * 12)]
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    want = [(q, k, j, max(-(2**63), min(s, 2**63 - 1))) for q, k, j, s in top_brute(rows, range(0, 500, 50))]
    assert top_rows(df) == want


def test_top_k_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.0, 1.0], 0)], VECTORS)
    clash = df.withColumn("block", F.lit(1)).withColumn("score", F.lit("x"))
    assert top_rows(clash) == [(0, 1, 1, 32768), (0, 2, 2, 0)]
    assert top_rows(df.limit(0)) == []


def test_top_k_in_rounds_and_repeated_queries(spark, monkeypatch):
    """Many small rounds give what one gives; rows with a query's id are no candidates of it, and each query row has its own answer."""
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(160)] + [(50, [0.1] * 6), (7, [0.9] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    want = top_brute(rows, range(0, 200, 50))
    assert top_rows(df) == want
    monkeypatch.setattr(topk, "QUERIES", 1)
    monkeypatch.setattr(topk, "ROUND_BYTES", 1)
    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "_HELD", 8)
    assert top_rows(df) == want
    plan = topk.top_k(df, df.where("vec_id = 0"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


ODD = ["Ünïcode's ΣΑΣ İx don't we'LL 12ab <|endoftext|> a<|startoftext|>b", " x y\x1cz\x85q\u3000w", "à \u0300b", "'tis 'S _x_ x__.", "日本語 ǅ ß ﬁ", None, "", " \n", "word " * 3000, "x" * 5000]


def test_word_ids_equal_the_whole_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    from quillgraph.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 500)
    whole, r = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), random.Random(2)
    texts = [x or "" for x in ODD] + ["".join(r.choice("aBz é́'’.,!Σ9_<|>\n\t\x1c ßx") for _ in range(80)) for _ in range(400)]
    model = word_bpe()
    for part in (texts, texts[::-1]):
        assert model.ids(part) == [np.asarray(whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in part]


def test_words_of_a_batch_are_no_objects():
    """Texts are looked up as spans of bytes: each word as a string took 70 bytes and most of the CPU seconds of op6."""
    import tracemalloc

    r = random.Random(8)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(3000)]
    texts = [" ".join(r.choices(words, k=20_000)) for _ in range(200)]
    model = word_bpe()
    want = model.ids(texts[:1])
    tracemalloc.start()
    got = model.ids(texts)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert got[:1] == want and peak < 40 * len(texts) * 20_000


def test_units_of_words_at_the_edges_of_the_cache(monkeypatch):
    """Units of 7, 8, 15 and 16 bytes, with zero bytes, letters that are none, a cache of few places and one that is emptied."""
    from tokenizers import Tokenizer

    from quillgraph.llm import tokens

    whole, r = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), random.Random(11)
    texts = [" ".join("".join(r.choice(a) for _ in range(n)) + b for n in (1, 7, 8, 9, 15, 16, 17)) for a in ("a", "ab", "é", "aé×", "aªº", "a\0", ".", "a1", "É") for b in ("", ".", "!" * 15, "!" * 16, "×", "'s")]
    texts += ["Σ " + x for x in texts] + ["x" + "\0" * n for n in range(17)]
    monkeypatch.setattr(tokens, "PLACES", 4, raising=False)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 40)
    monkeypatch.setattr(tokens, "BLOCK", 300, raising=False)
    model = tokens.WordBpe()
    for part in (texts, texts[::-1], [x for x in texts for _ in range(2)]):
        assert model.ids(part) == [np.asarray(whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in part]


def test_long_texts_are_taken_in_pieces(monkeypatch):
    """A text longer than a block never has all of its words at hand; its ids and those of its head are the same."""
    from quillgraph.llm import tokens

    r = random.Random(12)
    texts = ["".join(r.choice("ab É.\n\t\x1cΣ<|\u3000") for _ in range(n)) for n in (0, 39, 40, 41, 500, 3000)] + ["a" * 500 + "\nb c" + "d" * 500, "x " * 300 + "\ny", "a" * 200]
    heads = [packing.prompt_of(x, r.choice([1, 5, 20])) for x in texts]
    want = word_bpe().ids_and_heads(texts, heads)
    monkeypatch.setattr(tokens, "BLOCK", 40)
    assert word_bpe().ids_and_heads(texts, heads) == want
    for x in texts:
        cuts = tokens.pieces(x, 40)
        assert "".join(x[a:b] for a, b in cuts) == x and all(b - a <= 40 or not any(c in x[a : b - 1] for c in tokens.WHITE) for a, b in cuts)
    texts, most = ["ab cd. " * 1_200_000], []
    monkeypatch.setattr(tokens, "BLOCK", 1 << 20)
    block = tokens.WordBpe._block
    monkeypatch.setattr(tokens.WordBpe, "_block", lambda self, part: most.append(sum(map(len, part))) or block(self, part))
    assert word_bpe().ids(texts) == [word_bpe().ids(["ab cd."])[0] * 1_200_000] and max(most) <= 1 << 20


def test_filling_with_prompts_does_not_walk_the_pool():
    """A sequence that loss closed once took three Python calls for each piece of the pool."""
    import sys

    r, calls = random.Random(10), 0
    packer = packing.Packer(0, packing.INSTRUCTION)

    def count(*_):
        nonlocal calls
        calls += 1

    sys.setprofile(count)
    try:
        for i in range(1500):
            packer.add(i, bytes(4 * r.randint(100, 1500)), r.randint(1, 40))
        packer.fill(0)
    finally:
        sys.setprofile(None)
    by_loss = {x[5] for x in packer.rows if x[8] == "loss"}
    assert len(by_loss) > 50 and calls < 1000 * packer.next


def check_packing(rows, pieces, limits=(2048, 128, 2048)):
    """Each id in one piece, gapless sequences within the limits, padded by a tenth at most. rows: (doc_id, text). Returns the padding's share."""
    whole = {}
    for (i, t), ids in zip(rows, word_bpe().ids([t or "" for _, t in rows])):
        whole[i] = np.concatenate([np.frombuffer(ids, "<u4"), [1]]).astype("<u4")
    seen, sequences = {}, {}
    for p in pieces:
        seen.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    assert set(seen) == set(whole)
    for i, own in seen.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(whole[i])
            assert p["ids_crc32"] == zlib.crc32(whole[i][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(whole[i])
    padded = full = 0
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        total = 0
        for p in own:
            assert p["offset"] == total
            total += p["length"]
        exact = total & (total - 1) == 0
        assert len(own) <= limits[1] and total <= limits[0] and (exact or total >= packing.FULL * limits[0])
        assert sum(p["length"] - (p["start"] == 0) for p in own) <= limits[2]
        padded += 0 if exact else limits[0] - total
        full += total
    return padded / max(full, 1)


@pytest.mark.parametrize("limits", [(2048, 128, 2048), (256, 4, 200), (64, 2, 64)])
def test_packing(docs, limits):
    r = random.Random(3)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(r.choice(["ab", "cde", "fgh."]) for _ in range(r.randint(0, 900)))) for i in range(150)]
    df = docs(rows, {"length": F.lit(1), "start": F.lit(2)})
    assert check_packing(rows, packing.pack(df, limits=limits, pool=16).collect(), limits) < 0.02


def prompt_tokens(text):
    """Tokens before the first that bears loss: those of the first of several lines, and a document's first."""
    head, line_end, _ = (text or "").partition("\n")
    return max(1, len(word_bpe().ids([head])[0]) // 4 if line_end else 0)


@pytest.mark.parametrize("limits", [packing.INSTRUCTION, (256, 4, 200), (64, 8, 40)])
def test_packing_with_prompts(docs, limits):
    """All three limits hold and the loss limit binds."""
    r = random.Random(4)
    say = lambda n: " ".join(r.choice(["ab", "cde", "fgh."]) for _ in range(n))
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, say(r.randint(0, 60)) + r.choice(["\n", ""]) + say(r.randint(0, 900))) for i in range(200)]
    pieces = packing.pack(docs(rows), limits=limits, pool=16, prompt_lines=1).collect()
    check_packing(rows, pieces, (limits[0], limits[1], limits[0]))
    free = {i: prompt_tokens(t) for i, t in rows}
    loss, closed = {}, {}
    for p in pieces:
        assert p["loss_tokens"] == sum(k >= free[p["doc_id"]] for k in range(p["start"], p["start"] + p["length"]))
        loss[p["sequence_id"]] = loss.get(p["sequence_id"], 0) + p["loss_tokens"]
        closed[p["sequence_id"]] = p["closed_by"]
    assert max(loss.values()) <= limits[2]
    assert "loss" in closed.values() and set(closed.values()) <= {"tokens", "segments", "loss", "end"}


def test_sequences_whose_loss_is_spent_are_filled_with_prompts(docs):
    """Half of the tokens that a loss limit leaves would be lost if such sequences were cut back to a power of two."""
    r = random.Random(6)
    say = lambda n: " ".join(r.choice(["ab", "cde", "fgh."]) for _ in range(n))
    rows = [(i, say(r.randint(20, 90)) + "\n" + say(r.randint(100, 1500))) for i in range(400)]
    pieces = packing.pack(docs(rows), limits=packing.INSTRUCTION, prompt_lines=1).collect()
    assert check_packing(rows, pieces, (2048, 128, 2048)) < 0.001
    used = {}
    for p in pieces:
        used.setdefault((p["sequence_id"], p["closed_by"]), []).append(p["length"])
    by_loss = [sum(v) for (_, why), v in used.items() if why == "loss"]
    assert by_loss and min(by_loss) > 0.98 * 2048
    assert sum(map(sum, used.values())) / len([1 for _, why in used if why != "end"]) > 0.98 * 2048


@pytest.mark.parametrize("text", ["a b\nc d", "\n", "ΑΣ\nΣ", "x\x1cy\nz", " \n a", "<|x|>\nB", "Q\u0130\n\u0130 q"])
def test_tokens_of_a_prompt_are_the_first_of_the_whole_text(text):
    head = packing.prompt_of(text, 1)
    ((ids, n),) = word_bpe().ids_and_heads([text], [head])
    assert [ids] == word_bpe().ids([text]) and 0 <= 4 * n <= len(ids)
    assert ids[4 * n :] == word_bpe().ids([text[len(head) :]])[0] or "Σ" in text


def test_prompts():
    assert [packing.prompt_of(t, 1) for t in ("", "a", "a\nb", "\n", "a\n")] == ["", "", "a\n", "\n", "a\n"]
    assert packing.prompt_of("a\nb\nc", 2) == "a\nb\n" and packing.prompt_of("a\nb", 2) == ""


def test_packing_is_repeatable_and_keeps_repeats(docs):
    df = docs([(1, "a b c"), (1, "a b c"), (2, "d")])
    once = sorted(map(tuple, packing.pack(df).collect()))
    assert once == sorted(map(tuple, packing.pack(df).collect()))
    assert sum(r[0] == 1 for r in once) == 2
    assert packing.pack(docs([])).count() == 0


def test_token_counts(docs):
    rows = [(1, "Hello there\nworld\n\n  and more"), (2, None), (3, ""), (4, "\n"), (5, "ß é\n日本語 text\n"), (6, "long line " * 20_000)]
    got = {}
    for x in token_counts.token_counts(docs(rows, {"section": F.lit("z")})).collect():
        got.setdefault(x["doc_id"], []).append(x)
    model = byte_bpe()
    for i, text in rows:
        own, text = sorted(got[i], key=lambda x: x["section"]), text or ""
        raw, ends = text.encode(), model.ends(text)
        assert not len(ends) or ends[-1] == len(raw)
        assert [x["section"] for x in own] == list(range(len(own))) and sum(x["n_bytes"] for x in own) == len(raw)
        assert sum(x["n_tokens"] for x in own) == own[0]["doc_tokens"] == len(ends)
        begins = [0, *ends[:-1]] if len(ends) else []
        for x in own:
            a, b = x["start_byte"], x["start_byte"] + x["n_bytes"]
            assert x["n_tokens"] == sum(a <= s < b for s in begins)
            assert x["crossing"] == sum(a <= s < b < e for s, e in zip(begins, ends))
    assert token_counts.token_counts(docs([])).count() == 0
