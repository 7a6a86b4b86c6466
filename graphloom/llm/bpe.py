"""BPE encoding by prefix-sharing trie traversal, and decoding.

The encoding of a symbol string by ranked merges has a property that makes prefixes shareable: a token sequence
is the encoding of its text exactly if every token encodes to itself and every neighbouring pair encodes to
itself. So the last token of each prefix is unique, and it follows from the last tokens of shorter
prefixes: token t ends the prefix of length n if t and the last token of the prefix of length n - |t| make such
a pair. The distinct words of a batch are inserted into a trie and visited depth-first; a node holds the
last token of its prefix, computed once for all words below it. The last symbol of a word carries the
end-of-word mark and is a symbol of its own, so words end in leaves.

Whether two tokens make a pair is decided by plain merging of the two alone and remembered.

Decoding joins tokens by one space, as the file's tokenizer does that has no decoder.

Defined cases: a null or blank text has no token (both digests are those of the empty string); special tokens'
strings inside a text are their ids; repeated rows get equal results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidy


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> list[str]:
    """Byte-level BPE's printable sign of each byte: printable ones stand for themselves, others from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class Encoder:
    """Encoder for a word-level BPE file with an end-of-word suffix, byte-level signs and lower-casing."""

    def __init__(self, path: str, remember: int = 200_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ", 1)): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(x) for x in self.special)) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.sign = str.maketrans({chr(i): s for i, s in enumerate(_byte_signs())})
        self.names = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs, self.most_pairs = 0, 500_000
        self.known: dict[str, list[int]] = {}
        self.remember = remember
        self._own()

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a few symbols: the pair of lowest rank first, the leftmost of equals."""
        s = list(symbols)
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda i: (self.rank.get((s[i], s[i + 1]), 1 << 60), i))
            if (s[best], s[best + 1]) not in self.rank:
                break
            s[best : best + 2] = [s[best] + s[best + 1]]
        return s

    def symbols(self, token: str) -> list[str]:
        body, mark = (token[: -len(self.end)], True) if token.endswith(self.end) and len(token) > len(self.end) else (token, False)
        out = list(body)
        if mark:
            out[-1] += self.end
        return out

    def _own(self) -> None:
        """Tokens by their last symbol: length and text; whether a token encodes to itself is found when first asked."""
        self.longest = 1
        self.selfish: dict[str, bool] = {}
        for t in self.vocab:
            self.longest = max(self.longest, len(t) - (len(self.end) if t.endswith(self.end) and len(t) > len(self.end) else 0))

    def itself(self, token: str) -> bool:
        ok = self.selfish.get(token)
        if ok is None:
            s = self.symbols(token)
            ok = self.selfish[token] = len(s) == 1 or self.merge(s) == [token]
        return ok

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """ids of each distinct word (byte signs, without the mark), depth-first over the words' trie.

        Sorted order is the depth-first order of the trie: what a word shares with the one before it is the
        path that stays on the stack.
        """
        out: dict[str, list[int]] = {}
        vocab, end, longest, pairs, decide = self.vocab, self.end, self.longest, self.pairs, self._decide
        none: dict[str, bool] = {}
        last: list[str] = [""]  # last[n]: last token of the prefix of length n, without end of word
        before = ""
        for word in sorted(words):
            n = len(word)
            shared = 0
            top = min(len(last) - 1, n - 1, len(before))
            while shared < top and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for stop in range(shared + 1, n + 1):
                mark = end if stop == n else ""
                # the one token that can end the prefix; short ones are likelier, so they are tried first
                for start in range(stop - 1, max(-1, stop - longest - 1), -1):
                    t = word[start:stop] + mark
                    if t in vocab:
                        ok = pairs.get(last[start], none).get(t)
                        if decide(last[start], t) if ok is None else ok:
                            break
                else:
                    raise ValueError(f"no token ends {word[:stop]!r}")  # the file has a token for every byte
                last.append(t)
            final = last.pop()
            ids, at = [vocab[final]], n - (len(final) - len(end))
            while at > 0:
                t = last[at]
                ids.append(vocab[t])
                at -= len(t)
            out[word] = ids[::-1]
            before = word
        return out

    def _decide(self, a: str, b: str) -> bool:
        """Whether b can follow a (or begin a word, where a is empty); remembered up to a bound."""
        ok = self.itself(b) and (not a or self.merge(self.symbols(a) + self.symbols(b)) == [a, b])
        if self.n_pairs < self.most_pairs:
            self.pairs.setdefault(a, {})[b] = ok
            self.n_pairs += 1
        return ok

    def split(self, text: str) -> list[str]:
        """Words and special tokens, in order."""
        out: list[str] = []
        at = 0
        cuts = [(m.start(), m.end()) for m in self.cut.finditer(text)] if self.cut and "<|" in text else []
        for a, b in [*cuts, (len(text), len(text))]:
            part = text[at:a]
            if part:
                out += self.words.findall(_lower(unicodedata.normalize("NFC", part)))
            if b > a:
                out.append("\n" + text[a:b])  # no word begins with white space
            at = b
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[tuple[int, str, str, list[int]]]]:
        """For each text its words' encodings: number of tokens, the ids and the tokens joined by a space, the ids. Each distinct word is encoded once."""
        parts = [self.split(t) if t else [] for t in texts]
        known = self.known
        if len(known) > self.remember:
            known.clear()
        new: set[str] = set()
        for p in parts:
            new.update(p)
        new.difference_update(known)
        if new:
            signed = {w: w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.sign) for w in new if w[0] != "\n"}
            ids = self.encode_words(set(signed.values()))
            names = self.names
            for w, s in signed.items():
                x = ids[s]
                known[w] = (len(x), " ".join(map(str, x)), " ".join([names[i] for i in x]), x)
            for w in new.difference(signed):
                known[w] = (1, str(self.special[w[1:]]), w[1:], [self.special[w[1:]]])
        return [[known[w] for w in p] for p in parts]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [[i for e in p for i in e[3]] for p in self.encode_batch(texts)]

    def decode(self, ids: list[int]) -> str:
        names = self.names
        return " ".join([names[i] for i in ids])


#: One encoder a worker process and file, so what it has learnt about pairs and words serves later tasks as well.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _lower(s: str) -> str:
    """Lower case letter by letter (a final sigma is not special)."""
    return s.lower() if "Σ" not in s else "".join(c.lower() for c in s)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) a row: token ids of the whole text and their decoding."""
    return _run(docs, path, id_col, text_col, False)


def _run(docs, path, id_col, text_col, digests):
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from graphloom.llm import bpe  # the module's own cache, not a copy sent with the task

        e = bpe.encoder(path)
        hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
        e.known.clear()  # words of the task before; what is known of token pairs stays
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                if digests:
                    # the words' parts are joined as they are: the same bytes as joining the tokens one by one
                    cols = ([], [], [])
                    for w in e.encode_batch(part.column(1).to_pylist()):
                        n, ids, names, _ = zip(*w, strict=True) if w else ((), (), (), ())
                        cols[0].append(sum(n))
                        cols[1].append(hexed(" ".join(ids)))
                        cols[2].append(hexed(" ".join(names)))
                    cols = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    ids = e.encode(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([e.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])
        e.known.clear()

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) a row, without moving ids out of the encoder."""
    return _run(docs, path, "doc_id", "text", True)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
