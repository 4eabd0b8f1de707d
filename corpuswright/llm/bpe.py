"""Byte-level BPE encoding and decoding, from left to right.

For every prefix of a piece, its BPE encoding ends in one token, and the tokens before
it are the encoding of the prefix before. Tokens are the encoding if each two side by
side encode to themselves, which a pair test tells by undoing merges. So the longest
token of a trie that may follow is taken at each place, then shorter ones; a place from
which none leads on is dead for good, and the token before it is taken back. Each place
is entered once, so the work is linear in a piece.

The vocabulary must be one that merges have trained: every merged token is then
its own encoding. Its file must ask for this family's byte-level splitting and
for no normalizer, or it is refused.
"""

from __future__ import annotations

import hashlib
import json
import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh

#: Fixed value: the published split pattern of this tokenizer family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the white space of that pattern. Its pieces never run from other characters into white space.
_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNKS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in such vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Remembered(dict):
    """Results of `make`, remembered in two generations of `most` at most, so that frequent keys stay."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class SuffixAutomaton:
    """The suffix automaton of a set of words: a state a class of substrings that end at the same places. (Encoding uses a trie.)

    next_[state] leads on by a byte; link[state] is the state of the longest suffix
    in another class; words[state] are (length, id), longest first, of the words in the
    class and of those that are suffixes of its shortest substring.
    """

    def __init__(self, words: dict[bytes, int]):
        self.next_: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for w in sorted(words):
            last = 0
            for c in w:
                last = self._extended(last, c)
        own: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for w, i in words.items():
            at = 0
            for c in w:
                at = self.next_[at][c]
            own[at] = tuple(sorted((*own[at], (len(w), i)), reverse=True))
        self.words: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            parent = self.words[self.link[s]]
            self.words[s] = own[s] + parent if own[s] else parent

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next_.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extended(self, last: int, c: int) -> int:
        """The state of the words read so far, with one more byte."""
        q = self.next_[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next_[p]:
            self.next_[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next_[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        """Parts from q's class the substrings that p leads to."""
        copy = self._new(self.length[p] + 1, dict(self.next_[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next_[p].get(c) == q:
            self.next_[p][c] = copy
            p = self.link[p]
        return copy

    def ends(self, text: bytes):
        """For each place of the text, (length, id) of the words that end there, longest first."""
        state, matched = 0, 0
        for c in text:
            while state and c not in self.next_[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next_[state].get(c, 0)
            matched = matched + 1 if state else 0
            yield [x for x in self.words[state] if x[0] <= matched]


#: Pairs of tokens whose test is remembered, at most.
_MOST_PAIRS = 2_000_000


class ByteBPE:
    """Encoder and decoder of a vocabulary file's text; remembers the ids of some `most` chunks and pieces."""

    def __init__(self, vocabulary: str, most: int = 225_000):
        spec = json.loads(vocabulary)
        self._check(spec)
        back = {c: b for b, c in byte_letters().items()}
        to_bytes = lambda s: bytes(back[c] for c in s)
        model = spec["model"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        id_of = {to_bytes(t): i for t, i in model["vocab"].items() if t not in special}
        self.bytes_of = {i: b for b, i in id_of.items()}
        self.special = special
        self.text_of = {i: t for t, i in special.items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.rank = dict.fromkeys(self.bytes_of, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = map(to_bytes, m if isinstance(m, list) else m.split(" "))
            pair, whole = (id_of[a], id_of[b]), id_of[a + b]
            self.merge[pair] = rank
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = pair, rank
        self.n_ids = max(id_of.values()) + 1
        #: The tokens that merges make, and the bytes.
        self.own = {t: i for t, i in id_of.items() if len(t) == 1 or i in self.parts}
        self.longest = max(map(len, self.own))
        #: Of each token its bytes, and the longest other token that it starts with (-1: none).
        self.size, self.shorter = [0] * self.n_ids, [-1] * self.n_ids
        self.trie = self._grown()
        self.split = regex.compile(PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.names = list(map(str, range(self.n_ids)))
        self.name_bytes = {str(i): b for i, b in self.bytes_of.items()}
        self.chunks = _Remembered(self._chunk, most)
        self.known: dict[int, bool] = {}

    def _grown(self) -> dict:
        """The tokens' trie: a node has nodes by byte, and at -1 the longest token on the way to it."""
        root: dict = {-1: -1}
        for word in sorted(self.own):  # a word's prefixes come before it
            node = root
            for c in word[:-1]:
                node = node.setdefault(c, {-1: node[-1]})
            token = self.own[word]
            self.size[token], self.shorter[token] = len(word), node[-1]
            node[word[-1]] = {-1: token}
        return root

    @staticmethod
    def _check(spec: dict) -> None:
        """Raises unless the file asks for what is built here."""
        split = spec.get("pre_tokenizer") or {}
        steps = split.get("pretokenizers", [split])
        own = [x for x in steps if x.get("type") == "ByteLevel" and x.get("use_regex", True) and not x.get("add_prefix_space")]
        if spec["model"].get("type", "BPE") != "BPE" or spec.get("normalizer") or len(steps) != 1 or not own:
            raise ValueError("this vocabulary asks for another normalizer, split or model than byte-level BPE with the published pattern")
        if any(spec["model"].get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
            raise ValueError("this vocabulary asks for an option of BPE that is not built")

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay side by side: no merge across their border comes first.

        The later merge of the two sides is undone, step by step; a merge of the
        pieces then at the border that ranks before it would have been done instead.
        """
        limit = len(self.merge)
        while True:
            if self.merge.get((left, right), limit) < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a > b:
                limit, left = a, self.parts[left][1]
            elif b >= 0:
                limit, right = b + 1, self.parts[right][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of the split text."""
        whole = self.own.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        root, size, shorter = self.trie, self.size, self.shorter
        known, fits, n_ids, longest = self.known, self.fits, self.n_ids, self.longest
        out: list[int] = []
        dead = bytearray(n + 1)
        at, left, token = 0, -1, -1
        while at < n:
            if token < 0:
                node = root[piece[at]]  # every byte is a token
                for c in piece[at + 1 : at + longest]:
                    after = node.get(c)
                    if after is None:
                        break
                    node = after
                token = node[-1]
            while token >= 0:
                end = at + size[token]
                if not dead[end]:
                    if left < 0:
                        break
                    pair = left * n_ids + token
                    ok = known.get(pair)
                    if ok is None:
                        if len(known) >= _MOST_PAIRS:
                            known.clear()
                        known[pair] = ok = fits(left, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, left, token = end, token, -1
            else:  # this prefix's one encoding leads nowhere: back to a shorter one of its last token
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                left = out[-1] if out else -1
        return out

    def _piece(self, piece: str) -> str:
        return ",".join(map(self.names.__getitem__, self.encode_piece(piece.encode())))

    def _chunk(self, chunk: str) -> str:
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isascii() and word.isalpha():  # one piece, as most chunks are
            return self._piece(chunk)
        pieces = self.split.findall(chunk)
        if len(pieces) == 1 or len(chunk) > 256:  # not worth remembering
            return ",".join(map(self._piece, pieces))
        return ",".join(map(self.chunks.__getitem__, pieces))  # a piece by itself is split no further

    def encode(self, text: str) -> str:
        """A text's ids, decimal and joined by commas."""
        out = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(str(self.special[part]))
            else:
                out += map(self.chunks.__getitem__, _CHUNKS.findall(part))
        return ",".join(out)

    def decode(self, joined: str) -> str:
        """The text of comma-joined ids; bytes that aren't UTF-8 become U+FFFD, unknown ids are left out."""
        if not joined:
            return ""
        names = joined.split(",")
        try:
            return b"".join(map(self.name_bytes.__getitem__, names)).decode(errors="replace")
        except KeyError:  # special tokens among them
            out: list[str] = []
            run: list[bytes] = []
            for name in names:
                if int(name) in self.text_of:
                    out += [b"".join(run).decode(errors="replace"), self.text_of[int(name)]]
                    run = []
                else:
                    run.append(self.name_bytes.get(name, b""))
            return "".join(out) + b"".join(run).decode(errors="replace")


class Encoder:
    """A vocabulary on its way to the workers: each builds its tables once, and drops them with the broadcast."""

    def __init__(self, vocabulary: str):
        self.vocabulary, self.built = vocabulary, None

    def get(self) -> ByteBPE:
        if self.built is None:
            self.built = ByteBPE(self.vocabulary)
        return self.built


def _read_driver_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _extended(schema, **more: str):
    from pyspark.sql.types import StructType, _parse_datatype_string

    out = StructType(list(schema.fields))
    for name, kind in more.items():
        out = out.add(name, _parse_datatype_string(kind))
    return out


def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """docs with n_tokens, and with token_ids (array<int>) or the digests of an exact round trip.

    The vocabulary file, of a fixed size, is read on the driver and sent to the
    workers. Each text is encoded whole in the task that reads it: no shuffle. A
    null or empty text has no ids. Columns that had these names are replaced. A
    vocabulary that asks for another split or a normalizer raises.
    """
    import numpy as np
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(Encoder(_read_driver_file(vocabulary_path)))
    new = {"n_tokens": "long"} | ({"token_ids": "array<int>"} if ids else {}) | ({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {})
    docs = docs.drop(*(c for c in new if c != text_col))
    schema = _extended(docs.schema, **new)
    names = [f.name for f in schema]

    def run(batches):
        bpe = sent.value.get()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).cast(pa.string()).to_pylist()
            for i in range(0, len(texts), 256):
                got = [bpe.encode(t or "") for t in texts[i : i + 256]]
                n = [s.count(",") + 1 if s else 0 for s in got]
                cols = [*b.slice(i, len(got)).columns, pa.array(n, pa.int64())]
                if ids:
                    flat = np.array(",".join(s for s in got if s).split(",") if any(n) else [], dtype=np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, pa.int32())))
                if digests:
                    cols.append(pa.array([sha(s) for s in got], pa.string()))
                    cols.append(pa.array([sha(bpe.decode(s)) for s in got], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of each row's ids as out_col (a column of that name is replaced); null ids give an empty text."""
    import pyarrow as pa

    sent = df.sparkSession.sparkContext.broadcast(Encoder(_read_driver_file(vocabulary_path)))
    (ids,) = fresh(df, "_ids")
    df = df.withColumn(ids, F.array_join(F.col(ids_col).cast("array<string>"), ","))
    df = df.select(*(c for c in df.columns if c not in (out_col, ids)), ids)
    schema = _extended(df.drop(ids).schema, **{out_col: "string"})
    names = [f.name for f in schema]

    def run(batches):
        bpe = sent.value.get()
        for b in batches:
            texts = [bpe.decode(x or "") for x in b.column(b.num_columns - 1).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names)

    return df.mapInArrow(run, schema)
