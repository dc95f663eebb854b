"""Chunkers (k01-k04): rows of chunk_id, pos, text, start. The place of a chunk depends on where the one before it ended:
k01 is a fold in expressions, the others are written per document in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealspark.functions import text as X

CHUNKS = "doc_id long, chunk_id string, pos int, start long, text string"
#: Characters of a text that the fold of k01 holds in hand at a time.
BLOCK = 4_096
#: The white space that is taken off a chunk's ends.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def sliding(text: str, size: int = 500, overlap: int = 100, least: int = 51) -> list[tuple[int, str]]:
    """k01 for one text (what `sliding_chunks` is held against): windows that end at a sentence end where there is one in the
    second half; short ones are dropped. The next window starts `overlap` before the end, or at the end if that would not
    get ahead."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            for i in range(end - 1, start + size // 2, -1):
                if text[i] in ".!?" and (i + 1 == n or text[i + 1] in " \n"):
                    end = i + 1
                    break
        if len(text[start:end].strip()) >= least:
            out.append((start, text[start:end].strip()))
        if end == n:
            break
        start = end - overlap if end - overlap > start else end
    return out


def sliding_spans(text: Column, size: int = 500, overlap: int = 100, least: int = 51, block: int = BLOCK) -> Column:
    """k01 as a column: array<struct<start, text>>. The text is cut into blocks once; a fold over the blocks carries the next
    window's start, and a fold within a block cuts the windows that start in it, so that a window costs a block's length at
    most, however long the text is."""
    block = max(block, 4 * size)
    first, last = size // 2 + 1, size - 1
    shortest = size // 2 + 2 if first <= last else size
    ahead = shortest - overlap if shortest > overlap else 1 if size > overlap else shortest
    text = F.coalesce(text, F.lit(""))
    span = "array<struct<start:bigint,text:string>>"
    state = lambda start, out: F.struct(start.cast("long").alias("start"), out.alias("out"))

    def window(at: Column, w: Column, n: Column) -> Column:
        snapped = F.length(F.regexp_extract(w, f"(?s)^(.{{{first},{last}}}[.!?])[ \n]", 1)) if first <= last else F.lit(0)
        long = F.when(n - at["start"] <= size, n - at["start"]).otherwise(X.let(snapped, lambda x: F.when(x > 0, x).otherwise(size))).cast("int")

        def cut(x: Column) -> Column:
            end = at["start"] + x
            after = F.when(end >= n, n).when(x > overlap, end - overlap).otherwise(end)
            body = F.btrim(F.substring(w, F.lit(1), x), F.lit(BLANKS))
            return X.let(body, lambda b: state(after, F.when(F.length(b) >= least, F.concat(at["out"], F.array(F.struct(at["start"].alias("start"), b.alias("text"))))).otherwise(at["out"])))

        return X.let(long, cut)

    def of_block(held: Column, base: Column, here: Column, n: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            inside = (at["start"] < n) & (at["start"] < base + block)
            return F.when(inside, window(at, F.substring(here, (at["start"] - base + 1).cast("int"), F.lit(size + 1)), n)).otherwise(at)

        windows = F.aggregate(F.sequence(F.lit(1), F.floor(F.length(here) / ahead).cast("int") + 1), state(held["start"], F.array().cast(span)), step)
        return X.let(windows, lambda w: state(w["start"], F.concat(held["out"], F.array(w["out"]))))

    def fold(blocks: Column, n: Column) -> Column:
        joined = F.transform(blocks, lambda b, i: F.struct(i.alias("i"), F.concat(b, F.coalesce(F.substring(F.get(blocks, i + 1), 1, size + 1), F.lit(""))).alias("t")))
        return F.aggregate(joined, state(F.lit(0), F.array().cast(f"array<{span}>")), lambda held, b: of_block(held, b["i"].cast("long") * block, b["t"], n), lambda held: F.flatten(held["out"]))

    return X.let(F.length(text).cast("long"), lambda n: X.let(F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{block}}})"), 1), lambda blocks: fold(blocks, n)))


def sliding_chunks(df: DataFrame, size: int = 500, overlap: int = 100, least: int = 51, pages: Column | None = None) -> DataFrame:
    """k01: df: doc_id, text. Null and empty texts have no chunk. With the number of pages of a document a chunk tells the page
    it starts on, taking pages to be of equal length; without pages (null, 0) that is page 1."""
    # the outer form, since Spark works out the argument of the other one again in a filter that it puts before it
    spans = df.select("doc_id", F.length("text").alias("_n"), (F.lit(None) if pages is None else pages).cast("long").alias("_pages"), F.posexplode_outer(sliding_spans(F.col("text"), size, overlap, least)).alias("pos", "_c")).where("pos is not null")
    page = F.when(F.col("_pages") > 0, F.least(F.floor(F.col("_c.start") / (F.col("_n") / F.col("_pages"))) + 1, F.col("_pages"))).otherwise(1)
    return spans.select("doc_id", F.format_string("chunk_%04d", "pos").alias("chunk_id"), "pos", F.col("_c.start").alias("start"), F.col("_c.text").alias("text"), *([] if pages is None else [page.cast("long").alias("page")]))


def paragraphs(text: str, size: int = 1500, least: int = 21) -> list[tuple[int, str]]:
    """k02: blank-line blocks packed while they fit; larger ones are sliced; tiny chunks are dropped."""
    out: list[tuple[int, str]] = []
    held, start, at = "", 0, 0
    for block in re.split(r"(\n\s*\n)", text):
        here, at = at, at + len(block)
        block = block.strip()
        if not block:
            continue
        if held and len(held) + len(block) >= size:
            out.append((start, held))
            held = ""
        if len(block) > size:
            out += [(here + i, block[i : i + size]) for i in range(0, len(block), size)]
        elif held:
            held += "\n\n" + block
        else:
            held, start = block, here
    if held:
        out.append((start, held))
    return [(s, t) for s, t in out if len(t) >= least]


def sentences(text: str, size: int = 500) -> list[tuple[int, str]]:
    """k03: pieces end after a period with white space or a newline and keep it; packed up to the size."""
    out: list[tuple[int, str]] = []
    held, start, at = "", 0, 0
    for m in re.finditer(r".*?(?:\.\s+|\n|$)", text, re.S):
        piece = m.group()
        if not piece:
            continue
        if held and len(held) + len(piece) > size:
            out.append((start, held))
            held, start = "", at
        held += piece
        at += len(piece)
    if held.strip():
        out.append((start, held))
    return out


def token_budget(text: str, least: int = 150, most: int = 300) -> list[tuple[int, str]]:
    """k04: whole if it fits, else parts at blank lines, bullets and sentence ends packed to the budget of blank-separated
    tokens; an oversize part is cut into sentences, a short last chunk is dropped."""
    if len(text.split()) <= most:
        return [(0, text)] if text.strip() else []
    parts: list[tuple[int, str]] = []
    for m in re.finditer(r"(?:(?!\n\s*\n|\n[-*•]).)+(?:\n\s*\n)?", text, re.S):
        if len(m.group().split()) > most:
            parts += [(m.start() + s.start(), s.group()) for s in re.finditer(r".+?(?:[.!?]\s+|$)", m.group(), re.S)]
        else:
            parts.append((m.start(), m.group()))
    out: list[tuple[int, str]] = []
    held, start, n = "", 0, 0
    for at, part in parts:
        size = len(part.split())
        if held and n + size > most:
            out.append((start, held))
            held, n = "", 0
        if not held:
            start = at
        held += part
        n += size
    if held and (n >= least or not out):
        out.append((start, held))
    return out


KINDS = {"sliding": sliding, "paragraphs": paragraphs, "sentences": sentences, "token_budget": token_budget}


def chunk(df: DataFrame, kind: str = "sliding", **options) -> DataFrame:
    """df: doc_id, text. Null and empty texts have no chunk."""
    if kind == "sliding":
        return sliding_chunks(df, **options)
    cut = KINDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc_id, f"chunk_{i:04d}", i, s, t) for i, (s, t) in enumerate(cut(text or "", **options))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "chunk_id", "pos", "start", "text"])

    return df.select("doc_id", "text").mapInArrow(run, CHUNKS)


def register_table_function(spark, name: str = "chunk_text") -> None:
    """g03: chunk_text(text [, kind]) for LATERAL joins in SQL. The kind is a constant, k01 where it isn't given; with
    token_budget the rows tell their tokens too. Null and empty texts have no row."""
    from pyspark.sql.functions import udtf
    from pyspark.sql.types import IntegerType, StringType, StructType
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    @udtf(useArrow=True)
    class ChunkText:
        @staticmethod
        def analyze(text: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
            chosen = "sliding" if kind is None else kind.value
            if chosen not in KINDS or (kind is not None and not kind.isConstantExpression):
                raise ValueError(f"the kind is one of {', '.join(KINDS)}, as a constant")
            rows = StructType().add("pos", IntegerType()).add("start", IntegerType()).add("chunk", StringType())
            return AnalyzeResult(rows.add("tokens", IntegerType()) if chosen == "token_budget" else rows)

        def eval(self, text: str, kind: str = "sliding"):
            for i, (s, t) in enumerate(KINDS[kind](text or "")):
                yield (i, s, t, len(t.split())) if kind == "token_budget" else (i, s, t)

    spark.udtf.register(name, ChunkText)
