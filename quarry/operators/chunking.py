"""Cutting texts into chunks: fixed, by sentences, by headings, by paragraphs, scored, hierarchical."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import small_batches

SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
BLANK = re.compile(r"\n\s*\n")
HEADING = re.compile(r"^#{1,6}\s+.+$", re.M)
RULE = re.compile(r"^(?:-{3,}|\*{3,}|_{3,})\s*$", re.M)

Piece = tuple[str, int, int]  # text, start, end


def fixed(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 64, least: int = 10) -> DataFrame:
    """(id, chunk_index, text, start_char, end_char): windows of `size` characters that advance by
    size - overlap, the last one where it reaches the end; windows whose trimmed text is shorter than
    `least` are dropped, then numbered. Built-in functions only."""
    step = size - min(max(overlap, 0), size - 1)
    n = F.length(text_col)
    count = F.greatest(F.lit(1), F.ceil((n - size) / step) + 1).cast("int")
    cut = docs.where(n > 0).select(id_col, F.col(text_col).alias("_t"), F.explode(F.sequence(F.lit(0), count - 1)).alias("_i"))
    pieces = cut.select(id_col, (F.col("_i") * step).alias("start_char"), F.substring("_t", F.col("_i") * step + 1, F.lit(size)).alias("text"))
    kept = pieces.where(F.length(F.trim("text")) >= least)
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("start_char")) - 1
    return kept.select(id_col, number.alias("chunk_index"), "text", "start_char", (F.col("start_char") + F.length("text")).alias("end_char"))


def by_sentences(text: str, size: int = 512, overlap: int = 64) -> list[Piece]:
    """Sentences gathered until the next would reach `size` characters; a chunk begins with the last
    `overlap` characters of the one before. Offsets count joined sentences, so they are approximate."""
    out: list[Piece] = []
    held, start, at = "", 0, 0
    for sentence in SENTENCE_END.split(text):
        longer = f"{held} {sentence}".strip() if held else sentence
        if held and len(longer) >= size:
            out.append((held, start, start + len(held)))
            held, start = (f"{held[-overlap:]} {sentence}" if overlap else sentence), at
        else:
            start = start if held else at
            held = longer
        at += len(sentence) + 1
    return [*out, (held, start, start + len(held))] if held else out


def by_headings(text: str, size: int = 512, overlap: int = 64) -> list[Piece]:
    """Sections from one markdown heading to the next, what stands before the first one too; a text
    without headings is cut by sentences."""
    marks = [m.start() for m in HEADING.finditer(text)]
    if not marks:
        return by_sentences(text, size, overlap)
    edges = [0, *marks, len(text)]
    return [(part, a, b) for a, b in zip(edges, edges[1:], strict=False) if (part := text[a:b].strip())]


def _found(parts: Iterable[str], text: str) -> list[Piece]:
    """Parts with the place of their first occurrence."""
    out = []
    for part in parts:
        a = max(0, text.find(part))
        out.append((part, a, a + len(part)))
    return out


def by_paragraphs(text: str, target: int = 512) -> list[Piece]:
    """Paragraphs put together, by blank lines, up to `target` characters."""
    out, held = [], ""
    for part in filter(None, (p.strip() for p in BLANK.split(text))):
        longer = f"{held}\n\n{part}" if held else part
        if held and len(longer) > target:
            out.append(held)
            held = part
        else:
            held = longer
    return _found([*out, held] if held else out, text)


def recursively(text: str, target: int = 512, shared: int = 1) -> list[Piece]:
    """Sections by headings and rules, else paragraphs; those above `target` characters by sentences, a
    chunk beginning with the last `shared` sentences of the one before."""
    marks = sorted({m.start() for p in (HEADING, RULE) for m in p.finditer(text)} - {0})
    edges = [0, *marks, len(text)]
    parts = [text[a:b] for a, b in zip(edges, edges[1:], strict=False)] if marks else BLANK.split(text)
    out = []
    for part in filter(None, (p.strip() for p in parts)):
        if len(part) <= target:
            out.append(part)
            continue
        held: list[str] = []
        for sentence in (s.strip() for s in SENTENCE_END.split(part)):
            if held and len(" ".join([*held, sentence])) > target:
                out.append(" ".join(held))
                held = held[-shared:] if shared else []
            held.append(sentence)
        out.append(" ".join(held))
    return _found(out, text)


def _weights(text: str) -> dict[str, float]:
    tokens = re.findall(r"[a-z0-9]+", text.lower())
    return {t: n / max(1, len(tokens)) for t, n in Counter(tokens).items()}


def _cosine(a: dict[str, float], b: dict[str, float]) -> float:
    size = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
    return sum(v * b.get(t, 0.0) for t, v in a.items()) / size if size else 0.0


def scored(text: str, merge: float = 0.35, most: int = 2048, target: int = 512) -> list[Piece]:
    """Paragraphs joined with the next where their term vectors' cosine reaches `merge` and both have room
    in `most` characters; a text of one paragraph is cut by paragraphs."""
    parts = [p for p in (p.strip() for p in BLANK.split(text)) if p]
    if len(parts) < 2:
        return by_paragraphs(text, target)
    vectors = list(map(_weights, parts))
    out = [parts[0]]
    for i in range(1, len(parts)):
        longer = f"{out[-1]}\n\n{parts[i]}"
        if _cosine(vectors[i - 1], vectors[i]) >= merge and len(longer) <= most:
            out[-1] = longer
        else:
            out.append(parts[i])
    return _found(out, text)


STRATEGIES: dict[str, Callable[[str], list[Piece]]] = {
    "sentence": by_sentences, "topic": by_headings, "paragraph": by_paragraphs, "recursive": recursively, "scored": scored,
}


def chunked(docs: DataFrame, id_col: str, text_col: str, strategy: str, least: int = 1) -> DataFrame:
    """(id, chunk_index, text, start_char, end_char) by a named strategy; chunks shorter than `least` are
    dropped before numbering; null and empty texts have none."""
    cut = STRATEGIES[strategy]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["i"], batch["t"], strict=True):
                kept = [p for p in cut(text or "") if len(p[0]) >= least]
                rows += [(i, n, *p) for n, p in enumerate(kept)]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "text", "start_char", "end_char"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, f"{id_col} {kind}, chunk_index int, text string, start_char int, end_char int")


def with_neighbours(chunks: DataFrame, id_col: str, width: int = 50) -> DataFrame:
    """chunks with before and after, the end of the chunk before and the beginning of the next."""
    by = Window.partitionBy(id_col).orderBy("chunk_index")
    return chunks.withColumns({"before": F.expr(f"right(lag(text) over (partition by {id_col} order by chunk_index), {width})"), "after": F.substring(F.lead("text").over(by), 1, width)})


def nested(docs: DataFrame, id_col: str, text_col: str, parent: int = 1024, child: int = 256) -> DataFrame:
    """(id, parent_index, chunk_index, text): fixed children within fixed parents, without overlap."""
    top = fixed(docs, id_col, text_col, parent, 0, 1).withColumn("_k", F.struct(id_col, F.col("chunk_index").alias("parent_index")))
    inner = fixed(top.select("_k", F.col("text").alias("_text")), "_k", "_text", child, 0, 1)
    return inner.select(f"_k.{id_col}", "_k.parent_index", "chunk_index", "text")


def overlap_length(left: str, right: str, most: int = 200) -> int:
    """The longest end of one text that the other begins with, up to `most` characters."""
    return next((n for n in range(min(most, len(left), len(right)), 0, -1) if left.endswith(right[:n])), 0)
