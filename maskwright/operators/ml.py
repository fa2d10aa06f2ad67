"""Token classification: WordPiece, model gate, inference and the second detection layer."""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.detectors import FINDING, HIGH, finding
from maskwright.operators.policy import classify
from maskwright.operators.masking import mask_findings
from maskwright.operators.tags import decode_logits
from maskwright.settings import Settings

PIECES = "struct<ids:array<int>,offsets:array<struct<start:int,length:int>>>"
LEAST_RECALL = 0.85


def load_vocabulary(lines: list[str]) -> dict[str, int]:
    """Token to line number; the first of equal tokens counts."""
    out: dict[str, int] = {}
    for k, line in enumerate(lines):
        out.setdefault(line.strip(), k)
    return out


@lru_cache(1 << 16)
def _kind(c: str) -> str:
    """What a character is to WordPiece: a space, a mark or part of a word."""
    return " " if c.isspace() else "." if unicodedata.category(c)[0] in "PS" else "w"


def _cut(word: str, vocab: dict[str, int], longest: int) -> list[tuple[int, int, int]]:
    """(id, start, length) of the greedily longest pieces of a word; empty if it cannot be cut whole."""
    cut, i = [], 0
    while i < len(word):
        j = next((j for j in range(min(len(word), i + longest), i, -1) if ("##" if i else "") + word[i:j] in vocab), 0)
        if not j:
            return []
        cut.append((vocab[("##" if i else "") + word[i:j]], i, j - i))
        i = j
    return cut


def pieces(text: str, vocab: dict[str, int], most: int, known: dict | None = None) -> tuple[list[int], list[tuple[int, int]]]:
    """WordPiece ids and (start, length) offsets: [CLS], words and single punctuation marks, greedily longest pieces in lower
    case, a word that cannot be cut whole as [UNK], and [SEP] where there is room. ``known`` keeps the cut of words met before."""
    cls, sep, unk = vocab.get("[CLS]", 101), vocab.get("[SEP]", 102), vocab.get("[UNK]", 100)
    ids, offsets = [cls], [(0, 0)]
    longest, known = max(map(len, vocab), default=0), {} if known is None else known
    at = 0
    while at < len(text) and len(ids) < most - 1:
        kind = _kind(text[at])
        if kind == " ":
            at += 1
            continue
        stop = at + 1
        while kind == "w" and stop < len(text) and _kind(text[stop]) == "w":
            stop += 1
        word = text[at:stop].lower()
        cut = known.get(word)
        if cut is None:
            cut = _cut(word, vocab, longest)
            if len(word) <= 40 and len(known) < 50_000:
                known[word] = cut
        for token, start, size in cut or [(unk, 0, stop - at)]:
            if len(ids) < most - 1:
                ids.append(token)
                offsets.append((at + start, size))
        at = stop
    if len(ids) < most:
        ids.append(sep)
        offsets.append((0, 0))
    return ids, offsets


def tokenize(df: DataFrame, vocab: dict[str, int], text_col: str = "text", out: str = "pieces", most: int = 256) -> DataFrame:
    """``df`` with PIECES of the text; the vocabulary, of a fixed size, is broadcast."""
    held = df.sparkSession.sparkContext.broadcast(vocab)

    @F.arrow_udf(PIECES)
    def cut(texts: pa.Array) -> pa.Array:
        known: dict[str, list[tuple[int, int, int]]] = {}
        flat, ends = [array("i") for _ in range(3)], array("i", [0])  # a batch of long texts stays small
        for text in texts:
            ids, offsets = pieces(text.as_py() or "", held.value, most, known)
            flat[0].extend(ids)
            flat[1].extend(a for a, _ in offsets)
            flat[2].extend(b for _, b in offsets)
            ends.append(len(flat[0]))
        ids, starts, sizes = (pa.array(memoryview(x) if x else [], pa.int32()) for x in flat)
        at = pa.array(memoryview(ends), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, ids), pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([starts, sizes], ["start", "length"]))], ["ids", "offsets"])

    return df.withColumn(out, cut(F.col(text_col)))


def infer_batches(run: Callable[[np.ndarray], np.ndarray], rows: list[list[int]], most: int = 64) -> tuple[list[list], list[str | None]]:
    """(logits, error) of each row: rows of one length go through the model together; if that fails, each by itself."""
    found: list[list] = [[] for _ in rows]
    errors: list[str | None] = [None] * len(rows)
    by_length: dict[int, list[int]] = {}
    for k, ids in enumerate(rows):
        by_length.setdefault(len(ids), []).append(k)
    for length, every in sorted(by_length.items()):
        for a in range(0, len(every) if length else 0, most):
            some = every[a : a + most]
            try:
                for k, out in zip(some, run(np.array([rows[k] for k in some], np.int64)), strict=True):
                    found[k] = out.tolist()
            except Exception:  # the contract: no result rather than a failed task, and the reason beside it
                for k in some:
                    try:
                        found[k] = run(np.array([rows[k]], np.int64))[0].tolist()
                    except Exception as error:
                        errors[k] = f"{type(error).__name__}: {error}"
    return found, errors


def infer(df: DataFrame, model_path: str, ids_col: str = "ids", out: str = "logits", error: str = "error") -> DataFrame:
    """``df`` with token logits of an ONNX model, one session per task; a failing row gets none, and the reason in ``error``."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime

        session = onnxruntime.InferenceSession(model_path)  # the runtime's own choice: an accelerator where there is one
        for pdf in it:
            found, errors = infer_batches(lambda ids: session.run(None, {"input_ids": ids, "attention_mask": np.ones_like(ids)})[0], [list(x) for x in pdf[ids_col]])
            yield pdf.assign(**{out: found, error: errors})

    return df.mapInPandas(batches, df.schema.add(out, "array<array<double>>").add(error, "string"))


def model_findings(logits: Column, offsets: Column, threshold: float = 0.75) -> Column:
    """Decoded entities as findings of a constant confidence."""
    found = decode_logits(logits, offsets, threshold)
    return F.transform(found, lambda e: finding(e["category"], e["start"], e["length"], 0.95, HIGH, 100, source="MachineLearning")).cast(f"array<{FINDING}>")


def classify_layered(df: DataFrame, model: Column, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Classification with a model's findings (array<FINDING>) added where the second layer is on.

    Findings below the threshold are dropped; the policy runs again on the original text.
    """
    if not (settings.enabled and settings.mask_secrets and settings.ml_enabled):
        return classify(df, text_col, settings)
    return classify(df, text_col, settings, extra=F.filter(model, lambda f: f["confidence"] >= settings.ml_threshold))


def preview_for_model(df: DataFrame, text_col: str = "text", settings: Settings = Settings(), out: str = "preview") -> DataFrame:
    """The text a model sees: the preview by findings, of equal length, so its offsets hold for the original."""
    return classify(df, text_col, settings).withColumn(out, mask_findings(F.coalesce(F.col(text_col), F.lit("")), F.col("result")["findings"]))


def model_gate(folder: str) -> str:
    """Status of the model a folder points to: pointer, manifest, content hash, major version 1 and least recall, in that order."""
    try:
        with open(os.path.join(folder, "current.json"), encoding="utf-8") as f:
            version = json.load(f)["version"]
    except (OSError, ValueError, KeyError, TypeError):
        return "NoPointer"
    home = os.path.join(folder, "versions", str(version))
    try:
        with open(os.path.join(home, "model.manifest.json"), encoding="utf-8") as f:
            info = json.load(f)
    except (OSError, ValueError):
        return "NoManifest"
    try:
        with open(os.path.join(home, "model.onnx"), "rb") as f:
            digest = hashlib.sha256(f.read()).hexdigest()
    except OSError:
        return "NoModel"
    if digest != str(info.get("content_sha256", "")).lower():
        return "HashMismatch"
    if str(info.get("semver", "")).split(".")[0] != "1":
        return "IncompatibleVersion"
    if float((info.get("evaluation") or {}).get("span_recall_overall") or 0.0) < LEAST_RECALL:
        return "RecallTooLow"
    return "Loaded"


def gate_status(version: Column, info: Column, digest: Column) -> Column:
    """The same of a row: the pointed-to version, the manifest as struct<content_sha256, semver, recall> and the model's digest, each null where missing."""
    return (
        F.when(version.isNull(), "NoPointer").when(info.isNull(), "NoManifest").when(digest.isNull(), "NoModel")
        .when(F.lower(digest) != F.lower(F.coalesce(info["content_sha256"], F.lit(""))), "HashMismatch").when(F.substring_index(F.coalesce(info["semver"], F.lit("")), ".", 1) != "1", "IncompatibleVersion")
        .when(F.coalesce(info["recall"], F.lit(0.0)) < LEAST_RECALL, "RecallTooLow").otherwise("Loaded")
    )
