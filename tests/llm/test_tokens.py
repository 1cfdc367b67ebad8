import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxtally.llm import range_coder as R
from voxtally.llm import token_counts as C
from voxtally.llm import token_files as W

from .samples import awkward_docs, docs_table

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 1000, 70_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), rng.zipf(1.4, n) % 50_257, np.full(n, 50_256), np.tile(np.arange(7), n)[:n],
                rng.integers(0, 1_000_000, n)):
        block = R.encode_block(ids.astype(np.uint32))
        assert (R.decode_block(block) == ids).all()


def test_context_is_learned_and_damage_noticed():
    cycle = np.tile(np.random.default_rng(1).integers(0, 50_000, 50), 4000).astype(np.uint32)
    block = R.encode_block(cycle)
    assert len(block) < len(cycle) / 4
    for at in (30, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            R.decode_block(bytes(bad))


def want_files(rows):
    coder = Tokenizer.from_file(JSON)
    coder.encode_special_tokens = True
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    return out


def test_files_hold_the_ids_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 500)
    rows = awkward_docs(8) + [(None, "null id"), (7, "repeated"), (7, None), (70, "<|endoftext|>")]
    W.write_tokens(docs_table(spark, rows), str(tmp_path / "ids"), JSON)
    got = W.read_tokens(spark, str(tmp_path / "ids"), with_ids=True)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want_files(rows)
    assert spark.read.parquet(str(tmp_path / "ids")).count() > 5
    assert [tuple(r) for r in W.token_files(docs_table(spark, [(3, None)]), JSON).collect()] == [
        (3, 0, 1, zlib.crc32(bytes(4)))]
    assert W.token_files(docs_table(spark, []), JSON).collect() == []


def test_words_are_encoded_as_in_the_whole_text(monkeypatch):
    rng = random.Random(5)
    parts = ["the", " ", "  ", "\n", "'s", "don't", "1 2", "\u00a0", "\u3000x", "\x1f", "\x1c a", "\x85", "ing", "\0", "\0 b", "日本", "é",
             "<|endoftext|>", " <|endoftext|> ", "\t", "...", " -- ", "\u200b", "\r\n", "e\u0301"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]
    whole = W.Encoder(JSON)
    assert whole.by_word
    whole.by_word = False
    for cache in (W.CACHE, 40):
        monkeypatch.setattr(W, "CACHE", cache)
        words = W.Encoder(JSON)
        assert words.ids(texts[:50]) + words.ids(texts) == whole.ids(texts[:50]) + whole.ids(texts)
    lower = W.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not lower.by_word and len(lower.ids(["A b", ""])) == 2


def brute_counts(text, sections):
    """Each token to the section with most of its bytes, the earlier of equal ones."""
    coder, _ = C.load_ranks(RANKS, public_tokenizers.PATTERN)
    places = np.cumsum([0] + [len(c.encode()) for c in text])
    spans = [(places[min(a, len(text))], places[min(b, len(text))]) for a, b in sections]
    tokens, crossing, at = [0] * (len(spans) + 1), [0] * (len(spans) + 1), 0
    for token in coder.encode_ordinary(text):
        stop = at + len(coder.decode_single_token_bytes(token))
        shares = [max(0, min(stop, b) - max(at, a)) for a, b in spans]
        best = max(range(len(spans)), key=lambda i: (shares[i], -i), default=-1)
        best = best if spans and shares[best] else -1
        tokens[best] += 1
        crossing[best] += shares[best] < stop - at if best >= 0 else 0
        at = stop
    rows = [(i, tokens[i], crossing[i]) for i in range(len(spans))]
    return rows + [(-1, tokens[-1], 0)] * (tokens[-1] > 0)


def counted(df, **options):
    out = {}
    for r in C.token_counts(df, RANKS, public_tokenizers.PATTERN, **options).collect():
        out.setdefault(r.doc_id, []).append((r.section, r.n_tokens, r.n_crossing))
    return out


def test_lines_add_up_to_the_document(spark):
    rows = [(d, t) for d, t in awkward_docs(9)] + [(800, "a\n\n\n\nb  \n  日本\n\n"), (801, "\n"), (802, "é" * 50)]
    got = counted(docs_table(spark, rows))
    for doc, text in rows:
        at, sections = 0, []
        for line in (text or "").split("\n"):
            sections.append((at, min(at + len(line) + 1, len(text or ""))))
            at += len(line) + 1
        assert got[doc] == brute_counts(text or "", sections), doc


def test_crossing_tokens_gaps_and_fields(spark):
    rng = random.Random(4)
    rows, spans = [], {}
    for i in range(80):
        text = "".join(rng.choice(["the ", "ing", " ", "\n", "日本", "é", "token", "123"]) for _ in range(30))
        cuts = sorted(rng.sample(range(len(text) + 5), 8))
        spans[i] = [(cuts[j], cuts[j + 1]) for j in range(0, 7, rng.choice([1, 2]))]
        rows.append((i, text, [{"start": a, "stop": b} for a, b in spans[i]]))
    df = spark.createDataFrame(rows, f"doc_id long, text string, parts {C.SPAN}").withColumn("section", F.lit("x"))
    got = counted(df, sections=F.col("parts"))
    for i, text, _ in rows:
        assert got[i] == brute_counts(text, spans[i])
    pair = spark.createDataFrame([(1, "ab", None), (2, "", "日本")], "doc_id long, a string, b string")
    joined = pair.withColumn("text", F.concat_ws("\n", F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))))
    out = counted(joined, sections=C.field_sections(F.col("a"), F.col("b")))
    assert out[1] == brute_counts("ab\n", [(0, 2), (3, 3)]) and out[2] == brute_counts("\n日本", [(0, 0), (1, 3)])


def test_sections_may_not_overlap_and_null_lists(spark):
    with pytest.raises(ValueError):
        C.attribute(np.array([0]), np.array([4]), np.array([0, 2]), np.array([3, 4]))
    df = docs_table(spark, [(1, "a b"), (None, None), (1, "a b")])
    none = counted(df, sections=F.lit(None).cast(C.SPAN))
    assert none == {1: [(-1, 2, 0)] * 2}
    assert counted(docs_table(spark, [])) == {}


def test_only_new_words_are_encoded():
    words = W.Encoder(JSON)
    whole, handed = words.coder, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    words.coder = Counting()
    texts = [f"Some  words,\n\tsome  more words {i % 7}." for i in range(500)]
    assert words.ids(texts) == [np.array(e.ids, np.uint32).tobytes() for e in whole.encode_batch_fast(texts)]
    assert sum(map(len, handed)) < 200
    del handed[:]
    words.ids(texts)
    assert not any(handed)
