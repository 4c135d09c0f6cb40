"""BPE encoding and decoding by a deterministic automaton.

``compile_merges`` adds the merges one after another, each as a gadget on the automaton over token labels whose states
are the last token read. The gadget for u v -> w (the r-th merge) takes the arc v away from state u from r on,
adds an arc w wherever an arc u followed by v stood when r came, and gives the new state w the arcs that state v had
then. So a gadget is four numbers: the two arcs' labels, the new state and r. The arcs of a state follow from its chain of right parts, and those into a token from its chain of left
parts, each link valid until the next longer token absorbs it; ``Automaton.arc`` reads one entry of the transition
table off the gadgets. Entries that were read are kept in a table of ``KEPT_ARCS`` at most, as the whole table would have two thousand million.

A sequence of tokens is the BPE encoding of its text exactly if the automaton has a path for it, and that path is unique. A second
table, ``step``, is a deterministic automaton over symbols that tells after each symbol the longest token that ends there; ``shorter`` tells the next one. Encoding takes one step for each symbol of a
pre-split word and keeps for each place the only state a path can be in: that of the longest token with an arc from the state where it begins. The labels along the path are the tokens. Decoding emits arc labels.

The pre-split follows the vocabulary file: canonical composition, white space folded, lower case, then contractions,
letter runs, single digits and runs of the rest; special tokens split the raw text first.

Null and empty texts give no tokens. Every row is reported, also if it repeats or has no doc_id; texts may be of any length; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words a task keeps with their encodings; beyond it the memory is cleared and filled anew.
KEPT_WORDS = 400_000
#: Entries of the transition table that a task keeps (about 100 bytes each).
KEPT_ARCS = 1_000_000
#: White space as the vocabulary's splitter has it, and its contractions.
SPACE = r"\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPLIT = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+", regex.V1)
_SPLIT_ASCII = re.compile(rf"{CONTRACTIONS}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>"):
        self.vocab, self.end = vocab, end
        self.labels = {i: t for t, i in vocab.items()}
        n = max(vocab.values(), default=-1) + 1
        #: The gadgets: when the arc of a pair goes; the parts and birth of each state (-1: a symbol).
        self.gone: dict[tuple[int, int], int] = {}
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        self.compile_merges(merges)
        self.table: dict[tuple[int, int], bool] = {}
        self.compile_symbols()

    def symbols(self, token: str) -> tuple[str, ...]:
        """A token as symbols: characters, the last one with the word-end mark if the token has it."""
        return (*token[: -len(self.end) - 1], token[-len(self.end) - 1 :]) if token.endswith(self.end) and len(token) > len(self.end) else tuple(token)

    def compile_merges(self, merges: list[tuple[str, str]]) -> None:
        for r, (u, v) in enumerate(merges):
            a, b, w = self.vocab[u], self.vocab[v], self.vocab[u + v]
            self.gone.setdefault((a, b), r)
            if self.born[w] < 0:
                self.left[w], self.right[w], self.born[w] = a, b, r

    def compile_symbols(self) -> None:
        """Steps over symbols: a state for each beginning of a token, with failure links, the longest token that ends there and the next shorter one."""
        self.step: list[dict[str, int]] = [{}]
        ends = [-1]
        self.size: dict[int, int] = {}
        for token, i in self.vocab.items():
            at, spelled = 0, self.symbols(token)
            self.size[i] = len(spelled)
            for c in spelled:
                if c not in self.step[at]:
                    self.step[at][c] = len(self.step)
                    self.step.append({})
                    ends.append(-1)
                at = self.step[at][c]
            ends[at] = i
        self.fail, self.longest = [0] * len(self.step), list(ends)
        self.shorter = [-1] * len(self.labels) if not self.vocab else [-1] * (max(self.vocab.values()) + 1)
        level = list(self.step[0].values())
        while level:
            below = []
            for at in level:
                back = self.longest[self.fail[at]]
                if ends[at] < 0:
                    self.longest[at] = back
                else:
                    self.shorter[ends[at]] = back
                for c, to in self.step[at].items():
                    self.fail[to] = self.after(self.fail[at], c)
                    below.append(to)
            level = below

    def after(self, at: int, symbol: str) -> int:
        """The state that one symbol leads to."""
        step, fail = self.step, self.fail
        while symbol not in step[at]:
            if at == 0:
                return 0
            at = fail[at]
        return step[at][symbol]

    def arc(self, a: int, b: int) -> bool:
        """Whether state a has an arc labelled b: no gadget removed it while both ends stood there."""
        got = self.table.get((a, b))
        if got is None:
            if len(self.table) >= KEPT_ARCS:
                self.table.clear()
            got = self.table[a, b] = self._arc(a, b)
        return got

    def _arc(self, a: int, b: int) -> bool:
        limit = 1 << 60  # gadgets from here on came after one of the two had been absorbed
        while True:
            r = self.gone.get((a, b))
            if r is not None and r < limit:
                return False
            x, y = self.born[a], self.born[b]
            if x < 0 and y < 0:
                return True
            if x >= y:  # state a was copied from its right part when it was born
                limit, a = min(limit, x), self.right[a]
            else:  # the arc b was laid along its left part; of overlapping pairs of one merge the left one goes first
                limit, b = min(limit, y + 1), self.left[b]

    def encode_symbols(self, word: list[str]) -> list[int]:
        """The labels of the only path that spells ``word``."""
        state, at, arc, size, longest, shorter = [-1] * (len(word) + 1), 0, self.arc, self.size, self.longest, self.shorter
        for i, symbol in enumerate(word, 1):
            at = self.after(at, symbol)
            token = longest[at]
            while token >= 0:
                begin = i - size[token]
                if begin == 0 or (state[begin] >= 0 and arc(state[begin], token)):
                    state[i] = token
                    break
                token = shorter[token]
        out, i = [], len(word)
        while i > 0:
            if state[i] < 0:
                raise ValueError("the vocabulary lacks a symbol")
            out.append(state[i])
            i -= size[state[i]]
        return out[::-1]


class Tokenizer:
    """Encodes and decodes whole texts with a vocabulary file (see /opt/tokenizers); the path is a parameter."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.bytes = byte_symbols()
        self.words = _Encoded(self)

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return _SPLIT_ASCII.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        return _SPLIT.findall(text.replace("Σ", "σ").lower())

    def encode_word(self, piece: str) -> list[int]:
        word = [self.bytes[b] for b in piece.encode()]
        word[-1] += self.automaton.end
        return self.automaton.encode_symbols(word)

    def encoded(self, text: str) -> list[tuple[int, str, str]]:
        """(number of ids, ids, labels) of each piece; special tokens are pieces of their own."""
        words = self.words
        if len(words) > KEPT_WORDS:
            words.clear()
        if not self.special_re or not self.special_re.search(text):
            return [words[p] for p in self.pieces(text)]
        out: list[tuple[int, str, str]] = []
        for part in self.special_re.split(text):
            out += [(1, str(self.special[part]), part)] if part in self.special else [words[p] for p in self.pieces(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for e in self.encoded(text) for x in e[1].split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.labels[i] for i in ids])


class _Encoded(dict):
    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> tuple[int, str, str]:
        ids = self.tokenizer.encode_word(piece)
        labels = self.tokenizer.labels
        got = (len(ids), " ".join(map(str, ids)), " ".join([labels[i] for i in ids]))
        if len(piece) <= 64:  # long pieces hardly come twice
            self[piece] = got
        return got


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def _digests(path: str):
    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            n, ids, back = [], [], []
            for text in batch.column("text"):
                e = t.encoded(text.as_py() or "")
                n.append(sum([x[0] for x in e]))
                ids.append(hashlib.sha256(" ".join([x[1] for x in e]).encode()).hexdigest())
                back.append(hashlib.sha256(" ".join([x[2] for x in e]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(path: str):
    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            ids = [t.encode(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            texts = [t.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and token ids of every text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that the ids stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Token counts and digests of ids and decoded text: encoding and decoding in one pass, without storing either."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded_rows(path: str):
    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            n, ids, sums, back = [], [], [], []
            flush = lambda a, b: pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(sums, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])  # noqa: B023, E731
            begin, held = 0, 0
            for i, text in enumerate(batch.column("text")):
                e = t.encoded(text.as_py() or "")
                joined = " ".join([x[1] for x in e])
                ids.append(np.array(joined.split(" ") if joined else [], np.int32))
                n.append(len(ids[-1]))
                sums.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(" ".join([x[2] for x in e]).encode()).hexdigest())
                held += n[-1]
                if held > 2_000_000:
                    yield flush(begin, i + 1)
                    n, ids, sums, back, begin, held = [], [], [], [], i + 1, 0
            if begin < batch.num_rows:
                yield flush(begin, batch.num_rows)

    return run


def encoded_rows(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text they decode to."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded_rows(path), "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5(spark, sf_dir: str) -> DataFrame:
    """op5_bpe: every whole text of documents, encoded and decoded."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
