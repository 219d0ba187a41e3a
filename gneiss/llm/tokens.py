"""Operator 5: byte-level BPE encoding and decoding of whole texts.

Null texts count as empty.  Repeated rows give repeated results; other columns of the input are
neither read nor returned.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gneiss.llm.base import pick, slices, strings
from gneiss.llm.bpe import decoder, text_encoder


def encode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", decode: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of each text, as the tokenizers library encodes without adding
    special tokens; with decode=True also `decoded`, the text that the ids stand for."""
    rows = pick(df, doc_id=id_column, text=text_column)

    def run(batches):
        to_ids, to_text = text_encoder(path, True), decoder(path)
        for batch in slices(batches, "text"):
            ids, offset = to_ids(strings(batch, "text"))
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(ids))]
            if decode:
                columns.append(pa.array(to_text(ids, offset), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decode)


def decode(df: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id and text of each id list (null: empty text)."""
    rows = pick(df, doc_id=id_column, ids=ids_column)

    def run(batches):
        to_text = decoder(path)
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            flat = np.array([i for x in lists for i in x], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(to_text(flat, bounds), pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
