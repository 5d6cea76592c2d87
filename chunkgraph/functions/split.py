"""Splitters that hand out the pieces of texts of any length in batches of bounded size."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

SEPARATORS = ("\n\n", "\n", " ", "")
HEADER = re.compile(r"(#{1,5})(?: (.*))?$")
FENCES = ("```", "~~~")


def _segments(text: str, separator: str) -> Iterator[str]:
    """Pieces that begin with the separator, but for the first."""
    if not separator:
        yield from text
        return
    start, at = 0, text.find(separator)
    while at >= 0:
        if at > start:
            yield text[start:at]
        start, at = at, text.find(separator, at + len(separator))
    if start < len(text):
        yield text[start:]


class _Packer:
    """Joins neighbours up to a size; the end of one result, up to the overlap, begins the next."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap, self.held, self.total = size, overlap, deque(), 0

    def put(self, piece: str) -> Iterator[str]:
        n = len(piece)
        if self.held and self.total + n > self.size:
            if text := "".join(self.held).strip():
                yield text
            while self.total > self.overlap or (self.total and self.total + n > self.size):
                self.total -= len(self.held.popleft())
        self.held.append(piece)
        self.total += n

    def close(self) -> Iterator[str]:
        if text := "".join(self.held).strip():
            yield text
        self.held, self.total = deque(), 0


def text_pieces(text: str, size: int = 512, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does, one after the other."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    packer, rest = _Packer(size, overlap), separators[at + 1 :]
    for piece in _segments(text, separators[at]):
        if len(piece) < size:
            yield from packer.put(piece)
            continue
        yield from packer.close()
        if rest:
            yield from text_pieces(piece, size, overlap, rest)
        else:
            yield piece
    yield from packer.close()


def split_text(text: str, size: int = 512, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    return list(text_pieces(text, size, overlap, separators))


def _lines(text: str) -> Iterator[str]:
    start = 0
    while (at := text.find("\n", start)) >= 0:
        yield text[start:at]
        start = at + 1
    yield text[start:]


def sections(text: str) -> Iterator[tuple[str, str]]:
    """(title, content) of the sections of a markdown text, one after the other; a title names all headers above."""
    above: list[tuple[int, str]] = []
    lines: list[str] = []
    held: tuple[tuple[tuple[int, str], ...], list[str]] | None = None
    fence = ""

    def shown(key, bodies) -> tuple[str, str]:
        return " / ".join(t for _, t in key if t) or "No Title", "  \n".join(bodies)

    def flush() -> Iterator[tuple[str, str]]:
        """What follows under the same headers belongs to the section that is held."""
        nonlocal held
        if lines:
            key, body = tuple(above), "\n".join(lines)
            lines.clear()
            if held is not None and held[0] == key:
                held[1].append(body)
                return
            if held is not None:
                yield shown(*held)
            held = (key, [body])

    for raw in _lines(text):
        line = "".join(c for c in raw.strip() if c.isprintable())
        if fence:
            lines.append(line)
            if line.startswith(fence):
                fence = ""
            continue
        if mark := next((f for f in FENCES if line.startswith(f) and line.count(f) == 1), ""):
            fence = mark
            lines.append(line)
            continue
        if m := HEADER.match(line):
            yield from flush()
            level = len(m[1])
            while above and above[-1][0] >= level:
                above.pop()
            above.append((level, (m[2] or "").strip()))
        elif line:
            lines.append(line)
        else:
            yield from flush()
    yield from flush()
    if held is not None:
        yield shown(*held)


def split_headers(text: str) -> list[tuple[str, str]]:
    return list(sections(text))


def markdown_pieces(text: str, size: int = 500, overlap: int = 50) -> Iterator[tuple[str, str]]:
    """Sections, those longer than ``size`` cut further."""
    for title, body in sections(text):
        for piece in text_pieces(body, size, overlap) if len(body) > size else (body,):
            yield title, piece


def split_markdown(text: str, size: int = 500, overlap: int = 50) -> list[tuple[str, str]]:
    return list(markdown_pieces(text, size, overlap))


#: Pieces and characters of a batch that a splitter hands out.
BATCH_PIECES, BATCH_CHARS = 4096, 4 << 20


def pieces_of(docs: DataFrame, text: str, cut: Callable[[str], Iterator[tuple[str, ...]]], names: list[str]) -> DataFrame:
    """The columns of docs but the text, with chunk_index and what ``cut`` gives for each piece, all of it text.

    Pieces leave the task in batches of bounded size, however long a text is, and are never one array. A null
    text has none."""
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = pa.Table.from_batches([batch]).drop_columns(["text_"])
            rows: list[int] = []
            places: list[int] = []
            parts: list[tuple[str, ...]] = []
            held = 0

            def handed() -> Iterator[pa.RecordBatch]:
                columns = [c.combine_chunks() for c in rest.take(pa.array(rows, pa.int64())).columns] if rest.num_columns else []
                told = [pa.array(c, pa.string()) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.int32()), *told], names=[*rest.column_names, "chunk_index", *names])

            texts = batch.column(batch.schema.get_field_index("text_"))
            for i in range(len(batch)):
                t = texts[i].as_py()
                for at, piece in enumerate(cut(t) if t is not None else ()):
                    rows.append(i)
                    places.append(at)
                    parts.append(piece)
                    held += sum(map(len, piece))
                    if len(rows) >= BATCH_PIECES or held >= BATCH_CHARS:
                        yield from handed()
                        rows, places, parts, held = [], [], [], 0
            if rows:
                yield from handed()

    inner = docs.select(*[F.col(c).alias(f"c{i}_") for i, c in enumerate(others)], F.col(text).cast("string").alias("text_"))
    added = StructType([StructField("chunk_index", IntegerType()), *[StructField(n, StringType()) for n in names]])
    found = inner.mapInArrow(run, StructType([*inner.schema.fields[:-1], *added.fields]))
    return found.select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(others)], "chunk_index", *names)


def chunk_documents(docs: DataFrame, text: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    """One row for each non-blank chunk: the columns of docs but the text, with chunk_index, chunk and size."""
    if not (100 <= size <= 2000 and 0 <= overlap <= 100 and overlap < size):
        raise ValueError("size must be 100 to 2000, overlap 0 to 100")
    rows = pieces_of(docs, text, lambda t: ((p,) for p in text_pieces(t, size, overlap)), ["chunk"])
    return rows.filter(F.length(F.trim("chunk")) > 0).withColumn("size", F.length("chunk"))


def chunk_markdown(files: DataFrame, text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    return pieces_of(files, text, lambda t: markdown_pieces(t, size, overlap), ["title", "chunk"]).withColumn("size", F.length("chunk"))


def first_text(*columns: Column) -> Column:
    """The first of the columns that holds text: stripped, and not one of the spellings of nothing."""
    out = F.lit(None).cast("string")
    for c in reversed(columns):
        t = F.trim(c.cast("string"))
        out = F.when(t.isNotNull() & ~t.isin("", "None", "null", "{}"), t).otherwise(out)
    return out


#: Where a chunk's text is looked for, in order.
TEXT_KEYS = ("content", "text", "page_content")


def text_of(chunks: DataFrame, column: str) -> Column:
    """The text of chunks of any kind: text itself, a struct's or map's first of ``TEXT_KEYS`` that holds text, or
    whatever it is as text (lists and other structs as JSON)."""
    kind, c = chunks.schema[column].dataType, F.col(column)
    if isinstance(kind, StructType):
        return first_text(*[c[k] for k in TEXT_KEYS if k in kind.names], F.when(c.isNotNull(), F.to_json(c)))
    if isinstance(kind, MapType):
        return first_text(*[c[k] for k in TEXT_KEYS], F.when(c.isNotNull(), F.to_json(c)))
    return first_text(F.to_json(c) if isinstance(kind, ArrayType) else c)


def accepted_ocr(results: DataFrame, least: float = 10.0) -> DataFrame:
    """Results with text and a confidence above ``least``; the text stripped."""
    return results.filter((F.col("confidence") > least) & (F.trim("text") != "")).withColumn("text", F.trim("text"))
