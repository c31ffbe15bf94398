"""The encoding of text files, by models of byte pairs and by the structure of their bytes.

A model is trained on texts of the kind that the files hold: these are encoded in every candidate, and the pairs of bytes counted of which one at least is beyond ASCII. A file's
bytes are then most likely under one of the models. Counting is partial in every partition; the driver gets one table of 256 x 256 pairs for each candidate, whatever the corpus."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions.repair import PREFERRED, encoding_vote

#: Weight of the vote by byte pairs; of that by structure, where bytes are valid UTF-8, ASCII only, or stand where ISO encodings have control characters.
PAIRS, VALID, PLAIN, CONTROLS = 2.0, 0.99, 1.0, 0.73
CELLS = 1 << 16


def _counts(data: bytes) -> np.ndarray:
    """How often each pair of bytes occurs that is not all ASCII; the file's ends count as line ends."""
    b = np.frombuffer(b"\n" + data + b"\n", np.uint8).astype(np.int64)
    pairs = b[:-1] << 8 | b[1:]
    return np.bincount(pairs[pairs & 0x8080 > 0], minlength=CELLS)


def train(texts: DataFrame, column: str = "text", candidates: tuple[str, ...] = PREFERRED) -> dict[str, np.ndarray]:
    """For each candidate the logarithms of the shares of byte pairs. A character that a candidate lacks is a question mark in its training, so that pairs which candidates
    have in common have one share in all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(candidates), CELLS), np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                for k, name in enumerate(candidates):
                    total[k] += _counts(data := (t or "").encode(name, "replace"))
                    total[k, 0] += len(data)  # a pair of zero bytes is no text; its cell holds the length
        k, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(cell, pa.int32()), pa.array(total[k, cell])], ["k", "cell", "n"])

    found = np.zeros((len(candidates), 256, 256))
    for r in texts.select(column).mapInArrow(run, "k int, cell int, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).collect():  # one row a cell at most
        found[r.k, r.cell >> 8, r.cell & 255] = r.n
    size = np.maximum(found[:, :1, :1], 1)
    return {name: np.log((f + 0.01) / n).reshape(-1) for name, f, n in zip(candidates, found, size, strict=True)}


def votes_for(data: bytes, model: dict[str, np.ndarray]) -> list[tuple[str, float]]:
    if data.startswith(codecs.BOM_UTF8):
        return [("utf-8", PAIRS), ("utf-8", PLAIN)]
    if data.isascii():
        return [("ascii", PAIRS), ("ascii", PLAIN)]
    counts = _counts(data)
    used = np.flatnonzero(counts)
    likely = {name: round(float(counts[used] @ logs[used]), 6) for name, logs in model.items()}
    best = max(likely.values())
    votes = [(next(n for n in model if likely[n] == best), PAIRS)]
    try:
        data.decode("utf-8")
        votes.append(("utf-8", VALID))
    except UnicodeDecodeError:
        if any(0x80 <= c < 0xA0 for c in data):
            votes.append(("cp1250", CONTROLS))
    return votes


def votes(files: DataFrame, model: dict[str, np.ndarray], key: str = "id", content: str = "content") -> DataFrame:
    """(key, encoding, weight): the votes for each file's encoding; none for an empty or missing one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, *v) for i, data in zip(b.column(0), b.column(1), strict=True) if (raw := data.as_py()) for v in votes_for(raw, model)]
            ids, names, weights = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(names, pa.string()), pa.array(weights, pa.float64())], [key, "encoding", "weight"])

    kind = files.select(key).schema.add("encoding", "string").add("weight", "double")
    return files.select(key, content).mapInArrow(run, kind)


def detected(files: DataFrame, model: dict[str, np.ndarray], key: str = "id", content: str = "content") -> DataFrame:
    """(key, encoding) of text files: what the votes say."""
    return encoding_vote(votes(files, model, key, content), key)
