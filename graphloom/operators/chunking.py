"""Paragraph chunking with document-global, half-open offsets.

Paragraphs are packed greedily up to a token budget; an oversize one is cut into sentences, an oversize sentence into
slices.  The packing restarts with each chunk, so it is a fold over a text and runs as Arrow batches, one text at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, index int, chunk_id string, text string, token_count long, start_char long, end_char long"
_SENTENCE = re.compile(r"[^.!?…]+[.!?…]*")
Part = tuple[str, int, int]


def tokens(text: str) -> int:
    return max(1, len(text) // 3) if text else 0


def _trimmed(text: str, at: int) -> Part | None:
    bare = text.strip()
    begin = at + len(text) - len(text.lstrip())
    return (bare, begin, begin + len(bare)) if bare else None


def paragraphs(text: str, separator: str) -> list[Part]:
    """Non-empty paragraphs between separators (a pattern), with offsets."""
    at, out = 0, []
    for gap in [*re.finditer(separator, text), None]:
        part = _trimmed(text[at : gap.start() if gap else len(text)], at)
        if part:
            out.append(part)
        at = gap.end() if gap else at
    return out


def packed(parts: list[Part], budget: int, glue: str, oversize) -> Iterator[Part]:
    """Runs of parts within the budget, joined by ``glue``; parts beyond it are cut by ``oversize``."""
    run: list[Part] = []

    def joined() -> Part:
        return glue.join(p[0] for p in run), run[0][1], run[-1][2]

    used = 0
    for part in parts:
        size = tokens(part[0])
        if run and used + size > budget:
            yield joined()
            run, used = [], 0
        if size > budget:
            yield from oversize(part)
        else:
            run.append(part)
            used += size
    if run:
        yield joined()


def chunks(text: str, budget: int, separator: str = r"\n\s*\n") -> list[Part]:
    def slices(part: Part) -> Iterator[Part]:
        for a in range(0, len(part[0]), 3 * budget):
            if piece := _trimmed(part[0][a : a + 3 * budget], part[1] + a):
                yield piece

    def by_sentence(part: Part) -> Iterator[Part]:
        found = (_trimmed(m[0], part[1] + m.start()) for m in _SENTENCE.finditer(part[0]))
        yield from packed([s for s in found if s], budget, " ", slices)

    return list(packed(paragraphs(text, separator), budget, "\n\n", by_sentence))


def chunk_documents(docs: DataFrame, budget: int, separator: str = r"\n\s*\n") -> DataFrame:
    """Chunks of every row of doc_id, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                for i, (body, start, end) in enumerate(chunks(text or "", budget, separator)):
                    digest = hashlib.sha256(f"{doc}:{i}:{body}".encode()).hexdigest()[:12]
                    rows.append((doc, i, f"chunk_{i}_{digest}", body, tokens(body), start, end))
            yield pd.DataFrame(rows, columns=["doc_id", "index", "chunk_id", "text", "token_count", "start_char", "end_char"])

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
