"""Substring dedup on words: passages that recur anywhere are removed everywhere, found by repeated-phrase automata.

1. Word windows are filed by anchors (repeats.py). Blocks whose anchor occurs once drop out; one place of every block that
   recurs as a whole is confirmed as a passage, and of blocks that share an anchor but differ, the runs of windows that
   recur: one passage each, read from the text of one place.
2. The distinct passages are dealt to shards by anchor and compiled there to Aho-Corasick automata (pyahocorasick) whose
   letters are words, by their bytes.
3. All documents are read again and streamed, in pieces around their anchors, through the automata of every shard they can
   meet: a piece that holds an occurrence of a passage also holds its anchor. The words under occurrences are removed.
   Only the automata say where passages occur; shards with many passages or pieces are split, each piece meets all splits.

Words are runs without ASCII white space, unchanged. Null and empty texts have no words; texts shorter than `width` words
stay whole. A row that repeats another's doc_id and text counts as the same document (its windows don't recur by it) and
gets the same result; rows of one doc_id and different texts are documents of their own, and so are rows of null doc_id
whose texts differ. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealspark.llm.common import discard, materialise, record, rolling, slices, split_words
from dealspark.llm.repeats import KEY, blocks, known, pack_place, unpack_place

WIDTH, GRAM = 35, 8
#: Bytes of passages in one automaton, and pieces of text in one stream through it, about.
SHARD_BYTES, STREAM_ROWS = 2 << 20, 50_000
#: Bytes of text that a task works on at once.
_SLICE = 1 << 20

_FOUND = pa.schema([(k, pa.int64()) for k in ("anchor", "block", "doc", "variant", "place")])
_OCCURRENCE = ("doc", "variant", "place")


def find_blocks(texts: DataFrame, width: int, gram: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = split_words(batch.column("text"))
            anchor, block, row, start, windows, distance = blocks(words.hashes(), words.first, width, gram)
            doc, variant = (batch.column(k).to_numpy() for k in KEY)
            yield record(_FOUND, anchor, block, doc[row], variant[row], pack_place(start, windows, distance))

    return texts.mapInArrow(find, "anchor long, block long, doc long, variant long, place long")


def _at_several():
    """Whether a group has several occurrences (a repeated row is one)."""
    differ = [F.min(k) < F.max(k) for k in _OCCURRENCE]
    return differ[0] | differ[1] | differ[2]


_CONTENTS = pa.schema([("anchor", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("text", pa.binary()), ("windows", pa.list_(pa.int64()))])


def distinct_blocks(live: DataFrame) -> DataFrame:
    """live: blocks of anchors that occur at several places. One place of each, and whether it recurs as a whole."""
    return live.groupBy("anchor", "block").agg(*[F.first(k).alias(k) for k in _OCCURRENCE], _at_several().alias("whole"))


def recurring_passages(texts: DataFrame, contents: DataFrame, width: int) -> DataFrame:
    """contents: distinct_blocks. Returns anchor, passage (its words as they stand in one text)."""
    # where a block occurs once only, others of its anchor differ from it: windows are compared
    mixed = contents.where(~F.col("whole")).select("anchor").distinct().withColumn("open", F.lit(True))
    wanted = contents.join(mixed, "anchor", "left").select("anchor", "block", *_OCCURRENCE, "whole", F.coalesce("open", F.lit(False)).alias("open"))
    wanted = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "block", "place", "whole", "open")).alias("blocks"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            words = split_words(batch.column("text"))
            raw, names = words.data.tobytes(), words.hashes()
            b = batch.column("blocks").flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("blocks").offsets.to_numpy()))
            start, windows, _ = unpack_place(b.field("place").to_numpy())
            lo = words.first[row] + start
            hi = lo + windows - 1 + width
            open_ = b.field("open").to_numpy(zero_copy_only=False)
            piece = [raw[s:e] for s, e in zip(words.starts[lo].tolist(), words.ends[hi - 1].tolist(), strict=True)]
            hashes = [rolling(names[s:e], width).view(np.int64) if o else None for s, e, o in zip(lo.tolist(), hi.tolist(), open_.tolist(), strict=True)]
            yield record(_CONTENTS, b.field("anchor"), b.field("block"), b.field("whole"), piece, hashes)

    read_ = texts.select(*KEY, "text").join(wanted, list(KEY)).mapInArrow(read, "anchor long, block long, whole boolean, text binary, windows array<long>")
    # a repeated row is read twice
    pieces = materialise(read_)
    windows = pieces.where(F.col("windows").isNotNull()).select("anchor", "block", "whole", F.posexplode("windows").alias("nth", "window"))
    # a window recurs in a block that recurs, or if blocks of different content have it
    often = windows.groupBy("window").agg((F.max("whole") | (F.min("block") < F.max("block"))).alias("again")).where("again").select("window")
    runs = windows.where(~F.col("whole")).join(often, "window", "left_semi").groupBy("anchor", "block").agg(F.sort_array(F.collect_set("nth")).alias("runs"))
    part = pieces.where(~F.col("whole")).select("anchor", "block", "text").join(runs, ["anchor", "block"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, passages = [], []
            for anchor, text, runs in zip(*(batch.column(k).to_pylist() for k in ("anchor", "text", "runs")), strict=True):
                words = text.split()
                at = np.array(runs)
                edges = np.flatnonzero(np.diff(at) > 1) + 1
                for run in np.split(at, edges):
                    anchors.append(anchor)
                    passages.append(b" ".join(words[run[0] : run[-1] + width]))
            yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(passages, pa.binary())], ["anchor", "passage"])

    passages = pieces.where("whole").select("anchor", F.col("text").alias("passage")).unionByName(part.mapInArrow(cut, "anchor long, passage binary"))
    passages = materialise(passages.distinct())
    discard(pieces)
    return passages


class Automaton:
    """Aho-Corasick over words: each distinct word of the passages is a letter, all other words are one that none has."""

    def __init__(self, passages: list[bytes]):
        self.letters: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in passages:
            self.automaton.add_word("".join(self._letter(w) for w in p.split()))
        if passages:
            self.automaton.make_automaton()

    def _letter(self, word: bytes) -> str:
        # from 1 on, leaving out the surrogates
        return self.letters.setdefault(word, chr(n if (n := len(self.letters) + 1) < 0xD800 else n + 0x800))

    def covered(self, text: bytes) -> list[tuple[int, int]]:
        """Runs of words of text under occurrences of passages: first, end."""
        get, runs = self.letters.get, []
        if not self.letters:
            return runs
        for last, length in self.automaton.iter("".join([get(w, "\0") for w in text.split()])):
            first = last + 1 - length
            while runs and runs[-1][1] >= first:
                first = min(first, runs.pop()[0])
            runs.append((first, last + 1))
        return runs


def needed(starts: list[int], ends: list[int], whole: list[bool]) -> list[int]:
    """Which pieces of a text must be streamed: all but those that recur as a whole and lie under other such pieces."""
    out = [i for i, w in enumerate(whole) if not w]
    order = sorted((i for i, w in enumerate(whole) if w), key=lambda i: (starts[i], -ends[i]))
    done, best = -1, -1  # words before `done` are covered; `best` reaches furthest of the pieces that start before it
    for i in order:
        if best >= 0 and starts[i] > done:
            out.append(best)
            done, best = ends[best], -1
        if starts[i] > done:
            out.append(i)
            done = ends[i]
        elif ends[i] > done and (best < 0 or ends[i] > ends[best]):
            best = i
    return out + [best] * (best >= 0)


_PIECE = pa.schema([("shard", pa.int64()), ("deal", pa.int32()), ("side", pa.int32()), ("text", pa.binary()), ("at", pa.list_(pa.struct([("doc", pa.int64()), ("variant", pa.int64()), ("first", pa.int64())])))])
PIECE = "shard long, deal int, side int, text binary, at array<struct<doc:long,variant:long,first:long>>"
_HIT = pa.schema([(k, pa.int64()) for k in ("doc", "variant", "first", "end")])


def locate(texts: DataFrame, live: DataFrame, passages: DataFrame, width: int) -> DataFrame:
    """live: blocks, with whole. Streams the texts through the automata: doc, variant, first, end of runs of words under
    passages."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = passages.agg(F.coalesce(F.sum(F.octet_length("passage")), F.lit(0)).alias("n")).first()["n"]
    shards = F.lit(max(1, -(-size // (SHARD_BYTES // 4))))
    shard = F.pmod(F.xxhash64("anchor"), shards).alias("shard")
    routes = live.join(passages.select("anchor"), "anchor", "left_semi").select(shard, *_OCCURRENCE, "whole")
    # how a shard is split: by passages (pk) and by pieces (sk)
    weight = passages.groupBy(shard).agg(F.ceil(F.sum(F.octet_length("passage")) / SHARD_BYTES).cast("int").alias("pk"))
    grid = materialise(weight.join(routes.groupBy("shard").agg(F.ceil(F.count("*") / STREAM_ROWS).cast("int").alias("sk")), "shard"))
    routes = routes.join(grid, "shard").groupBy(*KEY).agg(F.collect_list(F.struct("shard", "pk", "sk", "place", "whole")).alias("routes"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            words = split_words(batch.column("text"))
            raw, r = words.data.tobytes(), batch.column("routes").flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("routes").offsets.to_numpy()))
            start, windows, _ = unpack_place(r.field("place").to_numpy())
            lo = words.first[row] + start
            hi = lo + windows - 1 + width
            chosen = np.array(needed(lo.tolist(), hi.tolist(), r.field("whole").to_pylist()), np.int64)
            r, row, start, lo, hi = r.take(pa.array(chosen)), row[chosen], start[chosen], lo[chosen], hi[chosen]
            doc, variant = (batch.column(k).to_numpy()[row].tolist() for k in KEY)
            # equal pieces of a slice are streamed once
            same: dict[tuple, list] = {}
            for shard, pk, sk, s, e, d, v, f in zip(*(r.field(k).to_pylist() for k in ("shard", "pk", "sk")), words.starts[lo].tolist(), words.ends[hi - 1].tolist(), doc, variant, start.tolist(), strict=True):
                same.setdefault((shard, pk, sk, raw[s:e]), []).append((d, v, f))
            rows = []
            for (shard, pk, sk, piece), at in same.items():
                some = at[0][0] % sk
                at = [{"doc": d, "variant": v, "first": f} for d, v, f in at]
                rows += [(shard, p * sk + some, 1, piece, at) for p in range(pk)]
            if rows:
                yield record(_PIECE, *zip(*rows, strict=True))

    streamed = texts.select(*KEY, "text").join(routes, list(KEY)).mapInArrow(pieces, PIECE)
    split = passages.select(shard, "passage").join(grid, "shard").withColumn("p", F.pmod(F.xxhash64("passage"), "pk"))
    compiled = split.select("shard", F.explode(F.sequence(F.lit(0), F.col("sk") - 1)).alias("s"), "sk", "p", "passage")
    compiled = compiled.select("shard", (F.col("p") * F.col("sk") + F.col("s")).cast("int").alias("deal"), F.lit(0).alias("side"), F.col("passage").alias("text"), F.lit(None).cast("array<struct<doc:long,variant:long,first:long>>").alias("at"))
    dealt = compiled.unionByName(streamed).repartition(parts, "shard", "deal").sortWithinPartitions("shard", "deal", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, automaton = None, [], None
        for batch in batches:
            rows = []
            for shard, deal, side, text, at in zip(*(batch.column(k).to_pylist() for k in ("shard", "deal", "side", "text", "at")), strict=True):
                if (shard, deal) != now:
                    now, held, automaton = (shard, deal), [], None
                if side == 0:
                    held.append(text)
                    continue
                if automaton is None:
                    automaton, held = Automaton(held), []
                for first, end in automaton.covered(text):
                    rows += [(o["doc"], o["variant"], o["first"] + first, o["first"] + end) for o in at]
            if rows:
                yield record(_HIT, *zip(*rows, strict=True))

    return dealt.mapInArrow(search, "doc long, variant long, first long, end long")


def occurrences(texts: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """texts: doc, variant, text. Returns doc, variant, first, end: words under passages (runs may overlap)."""
    texts = texts.where(F.col("text").isNotNull())
    found = materialise(find_blocks(texts, width, gram))
    # an anchor that occurs at one place has no recurring window
    # (written first, so that the join reads it by a shuffle of its own and splits frequent anchors)
    several = materialise(found.groupBy("anchor").agg(_at_several().alias("several")).where("several").select("anchor"))
    live = materialise(found.join(several, "anchor", "left_semi"))
    discard(found, several)
    contents = materialise(distinct_blocks(live))
    passages = recurring_passages(texts, contents, width)
    marked = live.join(contents.select("anchor", "block", "whole"), ["anchor", "block"])
    hits = materialise(locate(texts, marked, passages, width))
    discard(live, contents, passages)
    return hits


def remove_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, with_kept: bool = True, keep: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """docs: doc_id long, text. Returns doc_id, n_words, n_removed, kept (the words left, joined by one space; null
    without with_kept; the text itself if nothing was removed and as_is is set), kept_sha256, and the columns of docs
    named in keep, as keep_0, keep_1, ..."""
    aliases = [f"keep_{i}" for i in range(len(keep))]
    rows = known(docs.select("doc_id", "text", *[F.col(f"`{k}`").alias(a) for k, a in zip(keep, aliases, strict=True)]), *aliases)
    found = occurrences(rows, width, gram)
    found = found.groupBy(*KEY).agg(F.collect_list(F.struct("first", "end")).alias("runs"))
    joined = rows.join(found, list(KEY), "left").select("doc_id", "text", "runs", *aliases)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            out = []
            for doc_id, given, runs in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("runs"), strict=True):
                raw = given.as_buffer().to_pybytes() if given.is_valid else b""
                words = raw.split()
                n = len(words)
                if runs.is_valid:
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, runs.values.field("first").to_numpy(), 1)
                    np.add.at(step, runs.values.field("end").to_numpy(), -1)
                    stays = np.cumsum(step[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                kept = b" ".join(words)
                digest = hashlib.sha256(kept).hexdigest()
                if as_is and len(words) == n:
                    kept = raw if given.is_valid else None
                out.append((doc_id, n, n - len(words), kept if with_kept else None, digest))
            out = record(schema, *zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(c.cast(pa.string()) if c.type == pa.binary() else c for c in out.columns), *(batch.column(a) for a in aliases)], names=[*schema.names, *aliases])

    extra = "".join(f", {a} {docs.schema[k].dataType.simpleString()}" for k, a in zip(keep, aliases, strict=True))
    return joined.mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept string, kept_sha256 string{extra}")


def drop_passages(docs: DataFrame) -> DataFrame:
    """docs with recurring passages taken out of text (n_chars follows, where docs has it); other texts are unchanged,
    documents of which nothing is left go. Columns as in docs."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = remove_passages(docs, keep=rest, as_is=True).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    columns = {c: F.col(f"keep_{i}") for i, c in enumerate(rest)}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    columns |= {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def op2(docs: DataFrame) -> DataFrame:
    return remove_passages(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), with_kept=False).drop("kept")
