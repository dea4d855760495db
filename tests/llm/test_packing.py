"""Packing against the tokenizers library on whole texts and a plain walk over all ids."""

from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_path())


@pytest.fixture(scope="module")
def spec():
    with open(packing.default_path(), encoding="utf-8") as f:
        return f.read()


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def holds(pieces, texts, library, length):
    """Every id lies in one piece, sequences have no gap, and are whole windows but for powers of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        want, at = ids_of(library, texts[doc_id]), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want)) and r.length > 0
            assert r.ids_crc32 == packing.crc_of(want[at : at + r.length])
            at += r.length
        assert at == len(want)
    sizes = []
    for sequence in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[sequence], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(sizes)))
    whole = sum(sizes) // length
    assert sizes[:whole] == [length] * whole
    assert all(s < length and s & s - 1 == 0 for s in sizes[whole:]) and len(set(sizes[whole:])) == len(sizes[whole:])


def unique_rows(rows):
    """The nasty rows, each under an id of its own."""
    return {k: t for k, (_, t) in enumerate(rows)}


@pytest.mark.parametrize("length", [1, 8, 64, 4096])
def test_pieces_by_brute_force(spark, scratch, rows, library, length):
    texts = unique_rows(rows)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    holds(packing.digests(docs, scratch, length=length).collect(), texts, library, length)


def test_query_over_its_table(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    holds(packing.op11_packing(spark, sf_dir).collect(), {r.doc_id: r.text for r in rows}, library, 4096)


def test_blocks_of_partitions(spark, scratch, rows, library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 2)
    monkeypatch.setattr(packing, "BROADCAST_PARTITIONS", 1)
    texts = unique_rows(rows)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(9)
    holds(packing.digests(docs, scratch, length=32).collect(), texts, library, 32)


def test_sequences_hold_the_ids(spark, scratch, rows, library):
    texts = unique_rows(rows)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    pieces = scratch.cut(packing.pack(docs, scratch, length=256))
    found = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    for p in pieces.collect():
        want = ids_of(library, texts[p.doc_id])[p.start : p.start + p.length]
        assert found[p.sequence_id].ids[p.offset : p.offset + p.length] == want and p.offset in found[p.sequence_id].doc_starts


def test_null_ids_and_repeats(spark, scratch):
    docs = spark.createDataFrame([(None, None), (None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    out = packing.digests(docs, scratch).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in out if r.start == 0) == [(0, 1), (0, 3), (1, 3), (1, 3)]
    assert sum(r.length for r in out) == 10


@pytest.mark.parametrize("total", [0, 1, 4095, 4096, 4097, 12345])
def test_tail_is_powers_of_two(total):
    cuts = packing.tail_cuts(total, 4096)
    sizes = [b - a for a, b in zip(cuts, cuts[1:])]
    assert cuts[0] == total // 4096 * 4096 and cuts[-1] == total and all(s & s - 1 == 0 for s in sizes)


odd_texts = st.lists(st.one_of(st.text(max_size=12), st.text("abcXYZ09ÀéßİıŁŉǅɏ²½ª¡\xad'-.,§", max_size=12), st.sampled_from(["<|endoftext|>", "<|startoftext|>", " ", "\x1c", "\x85", " ", "é", " ̖́", "İ", "Σ", "it's", "I'LL", "\r\n", "가"]))).map("".join)


@settings(max_examples=400, deadline=None)
@given(odd_texts)
def test_chunks_have_the_ids_of_the_whole(spec, library, text):
    text = text.encode("utf-8", "ignore").decode()
    encoder = packing._encoder(spec)
    assert encoder._by_chunk and encoder.encode(text.encode()) == packing.np.array(ids_of(library, text)[:-1], "<u4").tobytes()


def test_other_tokenizers_see_whole_texts():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    assert not packing.cuts_at_spaces(packing.json.loads(spec))
    encoder = packing.Encoder(spec)
    assert encoder.encode(b"a  b") == packing.np.array(encoder._tokenizer.encode("a  b").ids, "<u4").tobytes()
