"""Search units: chunks of a message's text with offsets, identity, context and content hash."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nul_joined, sha_hex, uuid5

#: Words of a chunk, and words that neighbouring chunks of a long paragraph share.
MAX_WORDS, OVERLAP = 512, 64

#: Bytes of texts that are cut at once.
PIECE = 4 << 20

#: A word: no white space in it, by Python's own notion, which the \S of Java and RE2 doesn't share.
WORD = r"[^\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def chunk_count(text: Column, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> Column:
    """An upper bound for budgets: one for each paragraph, blank ones too, more for paragraphs that need windows; at least one."""
    words = F.transform(F.filter(F.split(text, "\n"), lambda p: p != ""), lambda p: F.size(F.regexp_extract_all(p, F.lit(WORD), F.lit(0))))
    step = max_words - overlap
    each = F.transform(words, lambda n: F.when(n <= max_words, F.lit(1)).otherwise(1 + F.ceil((n - max_words) / step)).cast("bigint"))
    return F.greatest(F.aggregate(each, F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(1).cast("bigint"))


def chunk_spans(text: str, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Code point offsets of the chunks of a text; nothing but blank paragraphs lies between them.

    Paragraphs are the lines that aren't empty, each with its line feed. They are packed while their words fit and a chunk goes
    from the start of its first to the end of its last; a chunk doesn't start with a blank one unless it holds nothing else.
    A paragraph of more than max_words is cut into windows that share `overlap` words and go from a word's start to a word's end.
    A text without paragraphs is one chunk.
    """
    if not 0 <= overlap < max_words:
        raise ValueError("the overlap must be smaller than a chunk")
    out: list[tuple[int, int]] = []
    open_at, open_to, held = 0, 0, 0  # the chunk that is being packed, and its words
    for paragraph in re.finditer(r"[^\n]+\n?", text):
        words = [(paragraph.start() + m.start(), paragraph.start() + m.end()) for m in re.finditer(r"\S+", paragraph[0])]
        if held + len(words) > max_words and open_to > open_at and (held or len(words) > max_words):
            out.append((open_at, open_to))
            held = 0
        if len(words) > max_words:
            last = max(0, -((max_words - len(words)) // (max_words - overlap)))  # windows after the first
            out += [(words[k][0], words[min(k + max_words, len(words)) - 1][1]) for k in range(0, (last + 1) * (max_words - overlap), max_words - overlap)]
            open_at = open_to = paragraph.end()
            continue
        open_at = open_at if held else paragraph.start()
        open_to, held = paragraph.end(), held + len(words)
    if open_to > open_at:
        out.append((open_at, open_to))
    return out or [(0, len(text))]


def cutter(max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes batches (fullname, field, text) into batches of chunks, PIECE bytes of texts at a time."""
    columns = ("fullname", "focus_field", "focus_start", "focus_end", "focus_text", "whole")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * PIECE / max(batch.nbytes, 1)))  # so that memory doesn't follow the texts' length
            for at in range(0, batch.num_rows, step):
                rows = [
                    (name, field, a, b, text[a:b], (a, b) == (0, len(text)))
                    for name, field, text in zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True)
                    for a, b in chunk_spans(text, max_words, overlap)
                ]
                yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))})

    return cut


def chunks(messages: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """(fullname, focus_field, focus_start, focus_end, focus_text, whole): rows are cut where they are, without a shuffle. A comment's body is cut; a submission's body, or its title where the body is empty."""
    titled = (F.col("kind") != "comment") & (F.col("raw_body") == "")
    field = F.when(titled, "title").when(F.col("kind") == "comment", "body").otherwise("selftext")
    text = F.when(titled, F.col("raw_title")).otherwise(F.col("raw_body"))
    return messages.select("fullname", field.alias("field"), text.alias("text")).mapInArrow(cutter(max_words, overlap), "fullname string, focus_field string, focus_start bigint, focus_end bigint, focus_text string, whole boolean")


def unit_id(fullname: Column, revision: Column, field: Column, start: Column, end: Column, version: str) -> Column:
    return uuid5(nul_joined(fullname, revision, field, start.cast("string"), end.cast("string"), version))


def labelled(kind: Column, fullname: Column, text: Column) -> Column:
    return F.concat(F.lit("["), F.upper(kind), F.lit(" "), fullname, F.lit("]\n"), text)


def search_units(messages: DataFrame, chains: DataFrame, snapshot_id: str, chunking_version: str = "v2", recipe_version: str = "v1", max_words: int = MAX_WORDS, overlap: int = OVERLAP, context_from: DataFrame | None = None) -> DataFrame:
    """Units of messages with the labelled texts of their ancestors as context; context_from has the ancestors' texts (messages by default)."""
    texts = (messages if context_from is None else context_from).select(F.col("fullname").alias("__a"), labelled(F.col("kind"), F.col("fullname"), F.array_join(F.filter(F.array("raw_title", "raw_body"), lambda x: x != ""), "\n")).alias("block"))
    told = chains.select("fullname", F.posexplode_outer("ancestors").alias("pos", "__a")).join(texts, "__a", "left").groupBy("fullname").agg(F.sort_array(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("pos", "block", "__a")))).alias("told"))
    context = told.select("fullname", F.array_join(F.transform("told", lambda x: x["block"]), "\n\n").alias("context_only_text"), F.transform("told", lambda x: x["__a"]).alias("context_message_refs"))
    facts = messages.select("fullname", "thread_fullname", "kind", "subreddit", "created_utc", "permalink", "source_revision_id")
    rows = chunks(messages, max_words, overlap).join(facts, "fullname").join(context, "fullname").join(chains.select("fullname", "context_complete", F.col("missing_parent_ids").alias("missing_context_ids")), "fullname")
    span = F.when(F.col("whole"), "").otherwise(F.concat(F.lit(" "), F.col("focus_start").cast("string"), F.lit(":"), F.col("focus_end").cast("string")))
    focus = F.concat(F.lit("[FOCUS "), F.upper("kind"), F.lit(" "), F.col("fullname"), span, F.lit("]\n"), F.col("focus_text"))
    return rows.select(
        unit_id(F.col("fullname"), F.col("source_revision_id"), F.col("focus_field"), F.col("focus_start"), F.col("focus_end"), chunking_version).alias("unit_id"), F.lit(snapshot_id).alias("snapshot_id"),
        F.col("fullname").alias("message_fullname"), "thread_fullname", "source_revision_id", "subreddit", "created_utc", "permalink", "kind", "focus_field", "focus_start", "focus_end", "focus_text",
        "context_only_text", F.when(F.col("context_only_text") == "", focus).otherwise(F.concat("context_only_text", F.lit("\n\n"), focus)).alias("context_text"), "context_complete", "missing_context_ids", "context_message_refs",
        sha_hex(nul_joined(F.col("focus_text"), F.col("context_only_text"), chunking_version, recipe_version)).alias("content_hash"), F.lit(chunking_version).alias("chunking_version"),
    )
