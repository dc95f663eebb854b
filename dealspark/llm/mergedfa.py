"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, one gadget each and in their order, into a deterministic automaton over tokens that accepts
exactly the token sequences BPE gives. It starts as one state whose arcs, one per symbol, lead back to it. The gadget of a
merge u v -> w: let p be the state that u's arcs enter and r the one that p's arc v enters. u's arcs are led to a copy of
p without the arc v, and every state with an arc u gets an arc w to r. So all arcs of one label enter one state, and there
is at most one new state per merge. (Where u = v the copy has no arc w either: of three u the first two merge.)

Arcs are not listed. Tokens are numbered so that a token comes before those made of it by merges on its right, the
latest first; an arc that a gadget takes away then takes with it one run of numbers: that token and all that later merges
make of it. A state's row is the sorted borders of the runs it lacks: an arc is missing where an odd number of borders is
at or under its number. The table depends on the vocabulary alone, and every worker compiles it once.

To encode, texts are cut at ASCII white space, normalised and split into words as the tokenizer file says; a word's path
through the automaton is searched by arcs that spell its bytes, longest first. Any beginning of a word has one path only,
so a place that failed is never tried again and the work is linear in the word's length. Decoding emits the labels of
the arcs, joined by a space as the file has no decoder.

Null text is an empty text: no ids, and an empty decoded text. Rows are independent, so repeated rows, ties and null ids
stay as they are; an empty table gives an empty table; other columns are ignored. Long texts are cut, never shortened.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealspark.llm.common import slices

#: Keys are bytes as Latin-1 letters; this one, no byte, marks a word's end.
_END = "\u0100"
_END_MARK = "</w>"
#: Parts of texts and of words whose results a worker keeps, and the longest that is kept (bytes).
KEPT, KEPT_BYTES = 1 << 18, 64
#: Bytes of a text that are split at once (cut at white space).
PIECE_BYTES = 1 << 20
_SPACES = re.compile(rb"[\x20\t-\r]+")
#: Characters that are letters, numbers or other signs in every version of Unicode, stand alone under NFC, and whose lower
#: case depends on nothing around them; a part of a text with any other is normalised and split by the library.
_PLAIN = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]]


def _byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: bytes that print stand for themselves, the others
    follow from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class MergeAutomaton:
    """keys: each token's id by its bytes (with _END at a word's end); merges: pairs of ids and the id they give, in order."""

    def __init__(self, keys: dict[str, int], merges: list[tuple[int, int, int]]):
        made: set[int] = set()
        children: dict[int, list[tuple[int, int]]] = {}
        whole = {w for *_, w in merges}
        known = set(keys.values()) - whole
        for k, (u, v, w) in enumerate(merges):
            if u not in known or v not in known or w in made:
                raise ValueError("every merge must join symbols or earlier merges, and make a token of its own")
            made.add(w)
            known.add(w)
            children.setdefault(u, []).append((k, w))
        size = max(keys.values(), default=-1) + 1
        self.number, after = [-1] * size, [-1] * size
        n = 0
        for root in sorted(set(keys.values()) - whole):
            todo = [(root, False)]
            while todo:
                token, done = todo.pop()
                if done:
                    after[token] = n
                    continue
                self.number[token] = n
                n += 1
                todo.append((token, True))
                todo += [(w, False) for _, w in children.get(token, [])]  # the latest is taken first
        # a state is the one it was copied from and the run of numbers it lacks besides
        parent, low, high = [-1], [0], [0]
        self.state = [0] * size

        def lacks(state: int, number: int) -> bool:
            while state > 0:
                if low[state] <= number < high[state]:
                    return True
                state = parent[state]
            return False

        never: set[int] = set()  # tokens that no arc bears: their parts never meet
        for k, (u, v, w) in enumerate(merges):
            p, r = self.state[u], self.state[v]
            if u in never or v in never or lacks(p, self.number[v]):
                never.add(w)
            else:
                later = children.get(v, [])
                i = bisect_left(later, (k,))
                parent.append(p)
                low.append(self.number[v])
                high.append(after[later[i][1]] if i < len(later) else self.number[v] + 1)
                # children are numbered latest first: the run ends with the earliest of the later ones
                self.state[u] = len(parent) - 1
            self.state[w] = r
        self.ids = {t: i for t, i in keys.items() if i not in never}
        # the longest arc by the first three letters of its label: no longer ones are looked for
        self.longest: dict[str, int] = {}
        for t in self.ids:
            self.longest[t[:3]] = max(len(t), self.longest.get(t[:3], 0))
        self.rows: dict[int, list[int]] = {}
        for s in {0, *self.state}:
            runs, at = [], s
            while at > 0:
                runs.append((low[at], high[at]))
                at = parent[at]
            borders: list[int] = []
            for a, b in sorted(runs):
                if borders and a <= borders[-1]:
                    borders[-1] = max(borders[-1], b)
                else:
                    borders += [a, b]
            self.rows[s] = borders

    def accepts(self, tokens: list[int]) -> bool:
        """Whether tokens are what BPE gives for the text they spell."""
        states = [0, *(self.state[t] for t in tokens)]
        return all(not bisect_right(self.rows[s], self.number[t]) & 1 for s, t in zip(states, tokens, strict=False))

    def path(self, word: str) -> list[int]:
        """Labels of the one accepted path that spells a word: its tokens."""
        n, ids, rows, state, number, longest = len(word), self.ids, self.rows, self.state, self.number, self.longest
        path: list[int] = []
        ends: list[int] = []
        dead: set[int] = set()
        at, stop = 0, min(n, longest.get(word[:3], 2))
        while at < n:
            row = rows[state[path[-1]] if path else 0]
            while stop > at:
                if stop not in dead:
                    token = ids.get(word[at:stop])
                    if token is not None and not bisect_right(row, number[token]) & 1:
                        break
                stop -= 1
            else:
                if not path:
                    raise ValueError("a word that the vocabulary cannot spell")
                dead.add(at)
                path.pop()
                stop = ends.pop() - 1
                at = ends[-1] if ends else 0
                continue
            path.append(token)
            ends.append(stop)
            at, stop = stop, min(n, stop + longest.get(word[stop : stop + 3], 2))
        return path


class Codec:
    """A tokenizer file with byte-level BPE and word ends: encodes and decodes by the automaton of its merges."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        if model.get("end_of_word_suffix") != _END_MARK or spec["decoder"] is not None:
            raise ValueError("made for byte-level BPE files with </w> as word end and no decoder")

        def key(token: str) -> str:
            end = token.endswith(_END_MARK) and len(token) > len(_END_MARK)
            return "".join(chr(letters[c]) for c in (token[: -len(_END_MARK)] if end else token)) + (_END if end else "")

        vocabulary = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = MergeAutomaton({key(t): i for t, i in vocabulary.items()}, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs])
        self.labels = {i: t for t, i in vocabulary.items()}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        # every label with the space that parts it from the next
        self.labels = {i: t + " " for i, t in self.labels.items()} | {i: t.decode() + " " for t, i in self.special.items()}
        self.library = Tokenizer.from_file(path)
        self.letters = letters
        self.specials = re.compile(b"|".join(b"(?:" + re.escape(t) + b")" for t in sorted(self.special, key=len, reverse=True)) or rb"(?!)")
        kinds = {k: "".join(re.escape(c) for c in map(str.lower, _PLAIN) if len(c) == 1 and unicodedata.category(c)[0] == k) for k in "LN"}
        self.plain = re.compile("[" + "".join(map(re.escape, _PLAIN)) + "]+")
        # the rule of the file for plain characters; Turkish dotted I leaves a combining dot, no letter, when lower-cased
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^{kinds['L']}{kinds['N']}]+")
        self.kept_words: dict[bytes, list[int]] = {}
        self.kept_parts: dict[bytes, tuple[array, str]] = {}

    def split(self, part: str) -> list[bytes]:
        """Words of a part of a text that holds no special token."""
        if self.plain.fullmatch(part):
            return [w.encode() for w in self.words.findall(part.lower())]
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(self.letters[c] for c in w) for w, _ in found]

    def word(self, word: bytes) -> list[int]:
        ids = self.kept_words.get(word)
        if ids is None:
            ids = self.automaton.path(word.decode("latin-1") + _END)
            if len(word) <= KEPT_BYTES:
                if len(self.kept_words) >= KEPT:
                    self.kept_words.clear()
                self.kept_words[word] = ids
        return ids

    def part(self, part: bytes) -> tuple[array, str]:
        """Ids of a part of a text without ASCII white space, and their labels, each with a space after it."""
        known = self.kept_parts.get(part)
        if known is None:
            ids, at, labels = array("i"), 0, self.labels
            for m in self.specials.finditer(part):
                for word in self.split(part[at : m.start()].decode()):
                    ids.extend(self.word(word))
                ids.append(self.special[m.group()])
                at = m.end()
            for word in self.split(part[at:].decode()) if at < len(part) else ():
                ids.extend(self.word(word))
            known = ids, "".join([labels[i] for i in ids])
            if len(part) <= KEPT_BYTES:
                if len(self.kept_parts) >= KEPT:
                    self.kept_parts.clear()
                self.kept_parts[part] = known
        return known

    def encode(self, text: str) -> tuple[array, str]:
        """Ids of a whole text, and the text they decode to."""
        raw, ids, labels = text.encode(), array("i"), []
        at = 0
        while at < len(raw):
            space = _SPACES.search(raw, at + PIECE_BYTES) if len(raw) - at > PIECE_BYTES else None
            stop = space.end() if space else len(raw)
            for part in raw[at:stop].split():
                own, label = self.kept_parts.get(part) or self.part(part)
                ids.extend(own)
                labels.append(label)
            at = stop
        return ids, "".join(labels)[:-1]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Labels of ids; numbers that no token has give nothing."""
        return "".join(self.labels[i] for i in ids if i in self.labels)[:-1]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


_IDS = pa.list_(pa.int32())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id long, text. Returns doc_id, ids array<int> and decoded, the text that the ids decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", _IDS), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches, "text"):
            ids, ends, decoded = array("i"), [0], []
            for text in batch.column("text"):
                own, labels = c.encode(text.as_py() or "")
                ids.extend(own)
                ends.append(len(ids))
                decoded.append(labels)
            values = pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(decoded, pa.string())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id long, ids array<int> (null: none). Returns doc_id, decoded."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def op12(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    found = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
