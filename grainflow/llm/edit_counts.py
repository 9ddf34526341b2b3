"""Edit-aware token counts: a segment tree of counts per document, and re-encoding of what edits touch.

A document is cut where white space begins into segments of about ``segment_chars`` characters, the leaves of a binary tree. A node has
the characters and the tokens below it. Tokens never reach across white space, so a document's count is its root's. An edit goes down
the tree by characters to the leaves it touches. Those are encoded anew, with the leaf before them where the edit took away the
white space between; sums are updated on the way up. The tree's shape stays until a leaf has outgrown it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainflow.llm.common import text_or_empty
from grainflow.llm.encoding import SPACE, encoder, slices

SEGMENT_CHARS = 1024
TREE = "tree struct<chars:array<long>,tokens:array<long>>"
_TREE = pa.struct([("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])
EDIT = "struct<at:long,removed:long,inserted:string>"


class CountTree:
    """The segment tree of one text, in heap order: node k has the children 2k and 2k + 1, leaves are the last ``width`` nodes."""

    def __init__(self, text: str, count, segment_chars: int = SEGMENT_CHARS, arrays: tuple[list, list] | None = None):
        self.text, self.count, self.segment_chars, self.encoded = text, count, segment_chars, 0
        if arrays is None:
            self._build()
        else:
            self.chars, self.tokens = arrays
            self.width = len(self.chars) // 2

    def _build(self) -> None:
        parts = list(slices(self.text, self.segment_chars))
        self.width = 1 << max(0, (len(parts) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, part in enumerate(parts):
            self.chars[self.width + i], self.tokens[self.width + i] = len(part), self.count(part)
        for k in range(self.width - 1, 0, -1):
            self._sum(k)
        self.encoded += len(self.text)

    def _sum(self, k: int) -> None:
        self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_at(self, at: int) -> tuple[int, int]:
        """(leaf, its first character's place) of the character ``at``; the last one with characters if ``at`` is the text's end."""
        k, start, at = 1, 0, min(at, max(0, self.chars[1] - 1))
        while k < self.width:
            k *= 2
            if at >= start + self.chars[k]:
                start += self.chars[k]
                k += 1
        return k, start

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replaces ``removed`` characters at ``at`` by ``inserted``. What reaches beyond the text is cut off."""
        at = min(max(0, at), len(self.text))
        removed = min(max(0, removed), len(self.text) - at)
        if not removed and not inserted:
            return
        first, start = self.leaf_at(at)
        last, last_start = self.leaf_at(at + removed)  # the character behind the edit may now follow another
        end = last_start + self.chars[last]
        self.text = self.text[:at] + inserted + self.text[at + removed :]
        end += len(inserted) - removed
        while start and not (start < end and self.text[start] in SPACE):  # boundary context
            first, start = self.leaf_at(start - 1)
        region = self.text[start:end]
        if len(region) > 4 * self.segment_chars and len(self.text) > 2 * self.width * self.segment_chars:
            self._build()
            return
        changed = {first, *(k for k in range(first + 1, last + 1) if self.chars[k])}
        for k in changed:
            self.chars[k], self.tokens[k] = 0, 0
        self.chars[first], self.tokens[first] = len(region), self.count(region)
        self.encoded += len(region)
        while (changed := {k // 2 for k in changed} - {0}):
            for k in changed:
                self._sum(k)


def with_trees(docs: DataFrame, tokenizer: str, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """docs (doc_id, text and any other columns) and their trees in a column ``tree``, which stores keep between edits."""
    rows = docs.withColumn("text", text_or_empty()).drop("tree")
    names = rows.columns

    def build(batches):
        count = encoder(tokenizer).count
        for batch in batches:
            trees = [CountTree(t.as_py(), count, segment_chars) for t in batch.column(names.index("text"))]
            trees = pa.array([{"chars": t.chars, "tokens": t.tokens} for t in trees], _TREE)
            yield pa.RecordBatch.from_arrays([*batch.columns, trees], [*names, "tree"])

    return rows.mapInArrow(build, _schema(rows, TREE))


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def edited_counts(docs: DataFrame, tokenizer: str, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Applies to each row of docs (doc_id, text, tree, edits) its edits, one after the other.

    edits: an array of at, removed, inserted; null edits and nulls in an edit change nothing. Places are code points of the text as the edits before left it.
    Returns doc_id, text (as edited), tree, n_tokens_before, n_tokens, n_chars, reencoded_chars. A null text is an empty one. A null tree
    is built first, and its encoding counted. Repeated rows stay; other columns are ignored; no documents give no rows.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"), "tree", "edits")

    def apply(batches):
        count = encoder(tokenizer).count
        for batch in batches:
            out = []
            for text, tree, edits in zip(*(batch.column(k) for k in (1, 2, 3))):
                arrays = tree.as_py()
                t = CountTree(text.as_py(), count, segment_chars, None if arrays is None else (arrays["chars"], arrays["tokens"]))
                before = t.total
                for e in edits.as_py() or []:
                    if e is not None:
                        t.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
                out.append((t.text, {"chars": t.chars, "tokens": t.tokens}, before, t.total, len(t.text), t.encoded))
            columns = list(zip(*out)) or [()] * 6
            arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), _TREE, *[pa.int64()] * 4))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "text", "tree", "n_tokens_before", "n_tokens", "n_chars", "reencoded_chars"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"doc_id {kind}, text string, {TREE}, n_tokens_before long, n_tokens long, n_chars long, reencoded_chars long")


def standard_edits(text: str = "text") -> Column:
    """Three edits for any text: a word is put in at one third, 40 characters go at two thirds, the end gets a suffix."""
    n = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    edit = lambda at, removed, inserted: F.struct(at.cast("long").alias("at"), F.lit(removed).cast("long").alias("removed"), F.lit(inserted).alias("inserted"))
    return F.array(edit(F.floor(n / 3), 0, " corrected "), edit(F.floor(n * 2 / 3), 40, ""), edit(n + 11, 0, "suffix"))
