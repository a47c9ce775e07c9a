import random
import zlib

import numpy as np
import pytest

from factloom.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, start string"


def check(rows, pieces, most_short):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], np.uint32) for i, t in rows}
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            own = ids[i][r.start : r.start + r.length]
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i]) and r.ids_crc32 == zlib.crc32(own.tobytes())
            if "ids" in r:
                assert r.ids == own.tolist()
            at += r.length
        assert at == len(ids[i])
    short = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and len({r.step_group for r in parts}) == 1
        short += at & (at - 1) != 0
    assert short <= most_short
    return by_sequence


def test_every_id_lies_in_one_piece(spark):
    draw = random.Random(6)
    rows = [(i, " ".join(draw.choice(["the", "étude", "stones", "<|endoftext|>", "漢字"]) for _ in range(draw.choice([0, 1, 30, 200, 300, 700, 3000])))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " " * 5_000), (903, "z" * 30_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(3)
    pieces = packing.pack(df, held_tokens=20_000, step_tokens=8_192).collect()
    sequences = check(rows, pieces, 3)
    groups = {}
    for parts in sequences.values():
        groups[parts[0].step_group] = groups.get(parts[0].step_group, 0) + sum(r.length for r in parts)
    assert max(groups.values()) <= 2.5 * 8_192


def test_packing_edges(spark):
    rows = [(None, "a b"), (1, "same"), (1, "same")]
    pieces = packing.pack(spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA).coalesce(1)).collect()
    assert len(pieces) == 3 and {r.doc_id for r in pieces} == {None, 1} and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packer_fills_windows():
    draw = random.Random(2)
    packer, done, total = packing.Packer((64, 32, 16)), [], 0
    for doc in range(500):
        n = draw.choice([1, 5, 16, 17, 31, 33, 64, 65, 200])
        total += n
        done += packer.add(doc, n)
        if doc % 50 == 0:
            done += packer.pack()
    done += packer.pack()
    assert all(sum(p[2] for p in pieces) == tier for tier, pieces in done)
    done += packer.last()
    assert sum(p[2] for _, pieces in done for p in pieces) == total and sum(sum(p[2] for p in pieces) < 16 or sum(p[2] for p in pieces) not in (16, 32, 64) for _, pieces in done) <= 1
    assert {t for t, _ in done} == {64, 32, 16}


def test_the_query_finds_added_tokens_in_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    from factloom.llm.queries import op3_packing

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one<|endoftext|>two", "<|endoftext|><|endoftext|>", " <|endoftext|> x", "<|endoftext|", "<|endoftext|>" + "a" * 1_000_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op3_packing(spark, str(tmp_path)).collect()
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], np.uint32)
        parts = [r for r in rows if r.doc_id == i]
        assert parts and all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in parts)
        assert (50256 in ids) == (i != 3)


@pytest.mark.parametrize("special_tokens", [True, False])
def test_ids_are_those_of_the_library_on_odd_and_long_texts(special_tokens):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    if not special_tokens:
        library.encode_special_tokens = True
    ids = packing.encoder(packing.default_vocabulary(), special_tokens)
    draw = random.Random(2)
    signs = ["a", "Ab", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "é", "e\u0301", "😀", "字", "١", "²", "'s", "'LL", "!", "...", "<|endoftext|>", "<|endoftext", "|>", "\x00", "\u200b", "ß", "\r\n"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(40))) for _ in range(3000)]
    texts += ["hello <|endoftext|> x", " " * 1_500_000 + "x", "\n" * 1_200_000, "word " * 300_000, "a" * 1_100_000, "<|endoftext|>" + " " * 1_100_000 + "<|endoftext|>"]
    for t in texts:
        assert ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, t[:60]
    assert 50256 in ids("hello <|endoftext|> x") or not special_tokens
