"""Byte-level BPE by a tokenization automaton.

*Construction.*  The automaton's arcs are tokens and its states are "after token t".  It
starts with the 256 bytes, where every token may follow every other, and takes one gadget
a merge (a, b) -> c in order of rank:

* after a, the arc b is cut, as a b would have been merged there;
* the new arc c leaves every state that a leaves (where a is cut, c is cut);
* the state after c is a copy of the state after b as of now (what b may not precede, c
  may not precede either).

So a cut arc (s, t) always comes from one merge (x, y) where x ends s and y begins t, and
x and y were still whole when that merge's turn came; of equal merges that overlap, the
left one comes first.  A full copy of these gadgets for 50,000 merges would hold billions
of arcs, so the automaton keeps a state's cuts as the merges themselves and resolves an
arc (s, t) the first time it is met, then holds it in the table.  What it accepts is
exactly the sequences of tokens that BPE makes.

*Encoding.*  A word's bytes drive a deterministic table.  Its states pair a node of the
vocabulary's suffix automaton, which lists the tokens that end at the present byte, with
the tokens that end at the bytes before; exactly one listed token may follow the one that
ends where it begins, and the transition records it.  A transition is made the first time
it is met; afterwards a byte is one look-up.  The path is read back from the end.

*Decoding* emits the arc labels: the bytes of each token.

The text is split into words beforehand as the vocabulary's pre-tokenizer does; strings of
special tokens in the text become their ids.  Merges and vocabulary, of fixed size, are
broadcast from the driver, which reads the file named by the ``path`` parameter.

Defined cases: a null text is empty; no tokens make the hash of the empty string; rows
that repeat come out as often; no documents give no rows; other columns are ignored.  A long
text costs memory in proportion to its tokens (some 40 bytes each); only words below 64
characters are kept.  A tokenizer file with options that change ids is refused.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import workers
from quern.llm.text import columns_of

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker keeps at most, with up to 1.5 transitions each; some 500 bytes a word.
KNOWN_WORDS = 400_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, to the byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Known(dict):
    """Words that were met, each with the path of its ids."""

    def __init__(self, tables: "Automaton"):
        super().__init__()
        self._tables = tables

    def __missing__(self, word: str) -> tuple[int, ...]:
        path = tuple(self._tables.encode_word(word.encode()))
        if len(word) < 64:
            self[word] = path
        return path


class Automaton:
    """Tables of one vocabulary; see the module's text."""

    def __init__(self, spec: dict):
        symbols = byte_symbols()
        vocabulary, merges = spec["vocab"], spec["merges"]
        raw = lambda token: bytes(symbols[c] for c in token)
        self.label = {i: raw(t) for t, i in vocabulary.items()}
        self.special = {t: i for t, i in spec["special"]}
        self.label |= {i: t.encode() for t, i in spec["special"]}
        self.decimal = {i: str(i) for i in self.label}
        special = sorted(self.special, key=len, reverse=True)
        self._split_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self._words = regex.compile(PATTERN)
        self._merge: dict[int, int] = {}
        self._begins: dict[int, list[tuple[int, int]]] = {}
        self._ends_with: dict[int, list[tuple[int, int]]] = {}
        self._made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pair, c = (vocabulary[a], vocabulary[b]), vocabulary[a + b]
            self._merge[pair[0] << 20 | pair[1]] = rank
            self._made.setdefault(c, (rank, *pair))
        self._reachable = {i for i in vocabulary.values() if len(self.label[i]) == 1}
        for c, (rank, a, b) in self._made.items():  # no arc for c where b was cut after a before
            if a in self._reachable and b in self._reachable and self.follows(a, b, rank):
                self._reachable.add(c)
        self._begins.clear()
        self._ends_with.clear()
        self._build_suffixes()
        self._forget()
        self._known = _Known(self)
        self.known_words = KNOWN_WORDS

    def _build_suffixes(self) -> None:
        """Goto and failure tables over the tokens' bytes; for each node, the tokens that end there, longest first."""
        goto: list[dict[int, int]] = [{}]
        ends: list[tuple[tuple[int, int], ...]] = [()]
        for token in sorted(self._reachable):
            node = 0
            for byte in self.label[token]:
                to = goto[node].get(byte)
                if to is None:
                    to = goto[node][byte] = len(goto)
                    goto.append({})
                    ends.append(())
                node = to
            ends[node] = ((len(self.label[token]), token),)
        fail, queue = [0] * len(goto), list(goto[0].values())
        for node in queue:
            for byte, to in goto[node].items():
                back = fail[node]
                while back and byte not in goto[back]:
                    back = fail[back]
                fail[to] = goto[back].get(byte, 0)
                ends[to] += ends[fail[to]]
                queue.append(to)
        depth = [0] * len(goto)
        for node in [0, *queue]:
            for to in goto[node].values():
                depth[to] = depth[node] + 1
        self._goto, self._fail, self._ends, self._depth = goto, fail, ends, depth

    def _spine(self, token: int, side: int, spines: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """The tokens that begin (1) or end (2) a token, itself first, each with the rank of the merge that it went into."""
        found = spines.get(token)
        if found is None:
            found, x, gone = [], token, 1 << 60
            while True:
                found.append((x, gone))
                if x not in self._made:
                    break
                gone, x = self._made[x][0], self._made[x][side]
            spines[token] = found
        return found

    def follows(self, s: int, t: int, before: int = 1 << 60) -> bool:
        """Is there an arc t after token s, before the merge of that rank?  Looks at the gadgets that could have cut it."""
        merge, begins = self._merge, self._spine(t, 1, self._begins)
        for x, x_gone in self._spine(s, 2, self._ends_with):
            for y, y_gone in begins:
                rank = merge.get(x << 20 | y)
                if rank is not None and rank < x_gone and rank <= y_gone and rank < before:
                    return False
        return True

    def _step(self, state: int, byte: int) -> tuple[int, int, int]:
        """The transition of a state on a byte: next state, and the token that ends there with its length.

        A state is a node of the suffix tables with the last tokens at its depth's positions.
        """
        node, window = self._states[state]
        while node and byte not in self._goto[node]:
            node = self._fail[node]
        node = self._goto[node].get(byte, 0)
        for length, token in self._ends[node]:
            before = window[-length]
            arc = before << 32 | token
            open_ = before < 0 or self._arcs.get(arc)
            if open_ is None:
                open_ = self._arcs[arc] = self.follows(before, token)
            if open_:
                break
        key = (node, (window + (token,))[-self._depth[node] - 1 :])
        after = self._numbers.get(key)
        if after is None:
            after = self._numbers[key] = len(self._states)
            self._states.append(key)
        step = self._table[state << 8 | byte] = (after, token, length)
        return step

    def _forget(self) -> None:
        """Empty tables that have grown: they fill again as they are met."""
        self._states, self._numbers, self._table, self._arcs = [(0, (-1,))], {(0, (-1,)): 0}, {}, {}

    def encode_word(self, word: bytes) -> list[int]:
        if len(self._table) > 1.5 * self.known_words:
            self._forget()
        table, state, steps = self._table, 0, []
        for byte in word:
            step = table.get(state << 8 | byte)
            if step is None:
                step = self._step(state, byte)
            steps.append(step)
            state = step[0]
        path, at = [], len(word) - 1
        while at >= 0:
            _, token, length = steps[at]
            path.append(token)
            at -= length
        path.reverse()
        return path

    def _parts(self, text: str):
        """Words of the text, and special tokens as their numbers."""
        parts = self._split_special.split(text) if self._split_special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield [], self.special[part]
            else:
                yield self._words.findall(part), None

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self._known
        if len(known) > self.known_words:
            known.clear()
        for words, special in self._parts(text or ""):
            out.extend(chain.from_iterable(map(known.__getitem__, words)))
            if special is not None:
                out.append(special)
        return out

    def in_decimal(self, ids) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode(errors="replace")


#: What the automaton takes for granted of a tokenizer file, by section.
_REQUIRED = {
    "normalizer": (None,),
    "pre_tokenizer": ({"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},),
    "decoder": ({"type": "ByteLevel"},),
    "model": ({"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},),
    "added_tokens": ({"single_word": False, "lstrip": False, "rstrip": False, "normalized": False},),
}


def unsupported(spec: dict) -> list[str]:
    """What of a tokenizer file this module doesn't do; a file that has any would get other ids than its library gives."""
    out = []
    for section, (wanted,) in _REQUIRED.items():
        found = spec.get(section)
        for one in found if isinstance(found, list) else [found]:
            if wanted is None or one is None:
                out += [section] if one is not wanted else []
            else:
                out += [f"{section}.{k}" for k, v in wanted.items() if one.get(k) not in ((v, "", None) if v is None else (v, None) if v is False else (v,))]
    return out


def read_spec(path: str) -> str:
    """What the automaton needs of a tokenizer file, as JSON: vocabulary, merges in order, special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if faults := unsupported(spec):
        raise ValueError(f"{path}: unsupported {', '.join(faults)}")
    model = spec["model"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    special = [(t["content"], t["id"]) for t in spec.get("added_tokens", [])]
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in dict(special)}
    return json.dumps({"vocab": vocabulary, "merges": merges, "special": special})


_automata: dict[str, Automaton] = {}


def automaton(spec: str) -> Automaton:
    """The automaton of a spec, built once in a process."""
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in _automata:
        _automata.clear()
        _automata[name] = Automaton(json.loads(spec))
    return _automata[name]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _applied(docs: DataFrame, path: str, fields: dict[str, object], row, known_words: int) -> DataFrame:
    """``row(automaton, text)`` for each text; columns doc_id and ``fields`` (name: Arrow type)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    names = ["doc_id", *fields]

    def of_batches(batches):
        tables = automaton(shared.value)
        tables.known_words = known_words
        workers.enter("bpe", _automata.clear)
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"]
            for at in range(0, len(texts), 500):
                rows = [row(tables, t or "") for t in texts.slice(at, 500).to_pylist()]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), fields.values())]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 500), *columns], names)

    docs = columns_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    kinds = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}
    return docs.mapInArrow(of_batches, ", ".join(["doc_id long", *(f"{n} {kinds[k]}" for n, k in fields.items())]))


def tokenize(docs: DataFrame, path: str | None = None, known_words: int = KNOWN_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids and decoded (the text that the ids give back)."""

    def row(tables: Automaton, text: str):
        ids = tables.encode(text)
        return len(ids), ids, tables.decode(ids)

    return _applied(docs, path or default_path(), {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}, row, known_words)


def digests(docs: DataFrame, path: str | None = None, known_words: int = KNOWN_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded text)."""

    def row(tables: Automaton, text: str):
        ids = tables.encode(text)
        return len(ids), hashlib.sha256(tables.in_decimal(ids).encode()).hexdigest(), hashlib.sha256(tables.decode(ids).encode()).hexdigest()

    return _applied(docs, path or default_path(), {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, row, known_words)


def op7_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
