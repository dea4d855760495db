import json

import pytest
from tokenizers import Tokenizer

from quern.llm import bpe
from tests.llm.conftest import key

TEXTS = ["Hello world", "", " ", "  two  spaces ", "it's we'll I'd", "日本語 🙂 é ß", "a<|endoftext|>b <|endoftext|>", "x" * 3000, "\n\n\t x\r\n", "12345 67a8b", "don't!!! ...###", "\x00\x01\x7f", "ab" * 500, "    q", "aaaaabbbbbccccc zzzzzz", "<|endoftext|>"]


@pytest.fixture(scope="module")
def tables():
    return bpe.automaton(bpe.read_spec(bpe.default_path()))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_encodes_and_decodes_as_the_library(tables, library, rows):
    import pyarrow.parquet as pq

    corpus = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for text in TEXTS + [t for _, t in rows if t] + corpus:
        want = library.encode(text, add_special_tokens=False).ids
        assert tables.encode(text) == want
        assert tables.decode(want) == library.decode(want, skip_special_tokens=False)


def test_decodes_by_labels(library):
    """What is decoded comes from the ids' labels: a label that spells something else shows."""
    tables = bpe.Automaton(json.loads(bpe.read_spec(bpe.default_path())))
    for text in TEXTS * 2:
        ids = library.encode(text, add_special_tokens=False).ids
        assert tables.encode(text) == ids and tables.in_decimal(ids) == ",".join(map(str, ids))
        assert tables.decode(ids) == library.decode(ids, skip_special_tokens=False)
    tables.label[library.encode("Hello").ids[0]] = b"Jello"
    assert tables.decode(tables.encode("Hello world")) == "Jello world"


@pytest.mark.parametrize("section, key, value", [("pre_tokenizer", "add_prefix_space", True), ("pre_tokenizer", "use_regex", False), ("model", "ignore_merges", True), ("model", "dropout", 0.1), ("added_tokens", "lstrip", True), ("normalizer", None, {"type": "NFC"}), ("pre_tokenizer", "type", "Whitespace")])
def test_refuses_what_would_change_ids(tmp_path, section, key, value):
    with open(bpe.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"], spec["model"]["merges"] = {}, []
    path = tmp_path / "spec.json"
    path.write_text(json.dumps(spec))
    bpe.read_spec(str(path))
    if key is None:
        spec[section] = value
    else:
        (spec[section][0] if section == "added_tokens" else spec[section])[key] = value
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="unsupported"):
        bpe.read_spec(str(path))


def test_encode_random_bytes(tables, library):
    import random

    rnd = random.Random(5)
    for _ in range(1500):
        text = "".join(rnd.choices("etaoin shrdluETA'.,#0123éü\n ", k=rnd.randint(1, 40)))
        assert tables.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_gadgets_accept_only_what_merging_makes():
    """All token pairs of a small vocabulary, against merging by rank."""
    symbols = {v: k for k, v in bpe.byte_symbols().items()}
    base = [symbols[b] for b in range(256)]
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("c", "a"), ("bc", "a"), ("a", "a"), ("aa", "b"), ("abc", "ab")]
    vocab = {t: i for i, t in enumerate(base + [a + b for a, b in merges])}
    tables = bpe.Automaton(json.loads(json.dumps({"vocab": vocab, "merges": merges, "special": []})))
    import itertools

    def merged(word):
        parts = list(word)
        while True:
            ranked = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
            if not ranked:
                return [vocab[p] for p in parts]
            rank, _ = min(ranked)
            out, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == merges[rank]:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out

    for n in range(1, 9):
        for word in itertools.product("abc", repeat=n):
            assert tables.encode_word("".join(word).encode()) == merged(word)


def test_tables(docs, rows, empty, library, spark):
    got = [tuple(r) for r in bpe.tokenize(docs).collect()]
    want = [(i, len(e := library.encode(t or "", add_special_tokens=False).ids), e, library.decode(e, skip_special_tokens=False)) for i, t in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sorted(((r[0], r[3]) for r in got), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert bpe.digests(docs).count() == len(rows)
    assert bpe.tokenize(empty).collect() == [] and bpe.digests(empty).collect() == []
