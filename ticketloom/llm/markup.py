"""Markup residue: structural elements and clean text of documents in HTML, Markdown, wiki or LaTeX notation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm import markup_blocks, markup_model
from ticketloom.llm.markup_blocks import NONE, Block, blocks, plain, raw
from ticketloom.llm.markup_model import KINDS, features, scores

#: Documents whose blocks are labelled together in a worker.
GROUP = 1024


@lru_cache(maxsize=4)
def trained(sample: int = markup_model.SAMPLE, epochs: int = markup_model.EPOCHS, seed: int = markup_model.SEED) -> dict[str, np.ndarray]:
    return markup_model.train(sample, epochs, seed)


def label(weights: dict[str, np.ndarray], docs: list[list[Block]]) -> list[list[str]]:
    """The kind of every block: the network's best of all kinds, in the context of the document's other blocks."""
    full = [k for k, d in enumerate(docs) if d]
    got = scores(weights, [features(docs[k]) for k in full]) if full else []
    out: list[list[str]] = [[] for _ in docs]
    for k, s in zip(full, got):
        out[k] = [KINDS[j] for j in s.argmax(axis=1).tolist()]
    return out


def _labelled(texts: list[str], weights: dict[str, np.ndarray]) -> Iterator[tuple[int, list[tuple[str, Block]]]]:
    for a in range(0, len(texts), GROUP):
        docs = [blocks(t) for t in texts[a:a + GROUP]]
        for k, (d, kinds) in enumerate(zip(docs, label(weights, docs))):
            yield a + k, list(zip(kinds, d))


def _content(kind: str, block: Block) -> str:
    return raw(block) if kind in ("code_block", "formula") else plain(block)


def elements(texts: DataFrame, keys: list[str], text: str = "text", weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """keys, kind, content: the distinct headings, list items, code blocks and formulas of every text.

    Texts are cut into leaf blocks with tag paths; a bidirectional LSTM labels each block of a document with one of all
    kinds, in the context of all its blocks. Null and empty texts have no elements; an element without content is none.
    Repeated rows count once; other columns are ignored; an empty table gives no rows.
    """
    w = weights if weights is not None else trained()
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, kind, c) for k, found in _labelled(pdf[text].tolist(), w) for kind, b in found if kind != NONE and (c := _content(kind, b))]
            at = [r[0] for r in rows]
            out = pdf[keys].iloc[at].reset_index(drop=True)
            out["kind"] = [r[1] for r in rows]
            out["content"] = [r[2] for r in rows]
            yield out

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", kind string, content string"
    return texts.where(F.length(F.trim(text)) > 0).select(*keys, text).mapInPandas(run, schema).distinct()


_SHAPE = {"heading": "# {}", "list_item": "- {}", "code_block": "```\n{}\n```", "formula": "$${}$$"}


def clean_text(texts: DataFrame, keys: list[str], text: str = "text", weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """keys and clean_text: every text without markup, one block a line, headings as '# ', list items as '- ', code fenced, formulas in '$$'.

    Null texts stay null; a text without markup keeps its words with white space squeezed per paragraph.
    """
    w = weights if weights is not None else trained()
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            null = pdf[text].isna()
            cleaned = [None] * len(pdf)
            for k, found in _labelled(pdf[text].fillna("").tolist(), w):
                parts = [(_SHAPE.get(kind, "{}"), _content(kind, b)) for kind, b in found]
                cleaned[k] = "\n".join(shape.format(c) if shape != "{}" else c for shape, c in parts if c)
            out = pdf[keys].copy()
            out["clean_text"] = pd.Series(cleaned, index=pdf.index, dtype=object).where(~null, None)
            yield out

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", clean_text string"
    return texts.select(*keys, text).mapInPandas(run, schema)


def issue_texts(tracker: DataFrame, issues: DataFrame) -> DataFrame:
    """field_name, issue_id, item_no, text of description_text of one table and of the comments of another (item_no: place in the array, nulls counted)."""
    described = tracker.select(F.lit("description_text").alias("field_name"), "issue_id", F.lit(0).alias("item_no"), F.col("description_text").alias("text"))
    commented = issues.select(F.lit("comments").alias("field_name"), "issue_id", F.posexplode("comments").alias("item_no", "text"))
    return described.unionByName(commented)
