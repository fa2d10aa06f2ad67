"""Spans and BIO tags: tokenising, encoding, decoding and checking, as expressions on one row."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.spans import find_matches, let, running_sums

_TOKEN = re.compile(r"\w+|[^\w\s]", re.A)
# The labels, and the category of each type.
LABELS = ("O", "B-SECRET", "I-SECRET", "B-PII", "I-PII", "B-HOSTINFO", "I-HOSTINFO", "B-NETWORK", "I-NETWORK")
TYPES = ("SECRET", "PII", "HOSTINFO", "NETWORK")
SPAN = "struct<start:int,end:int,label:string>"
TAG_SPAN = "struct<start:int,end:int,type:string>"
CATEGORY = {"SECRET": "PasswordLike", "PII": "Email", "HOSTINFO": "Hostname", "NETWORK": "PublicIp"}


def tokens(text: Column) -> Column:
    r"""array<struct<token, start, end>> of ``\w+|[^\w\s]``; a null text has none.

    On Arrow batches: places by prefix sums of built-in expressions take 40 times as long on documents of hundreds of words.
    """

    @F.arrow_udf("array<struct<token:string,start:int,end:int>>")
    def cut(texts: pa.Array) -> pa.Array:
        found, starts, ends, at = [], array("i"), array("i"), array("i", [0])
        for text in texts:
            for m in _TOKEN.finditer(text.as_py() or ""):
                found.append(m[0])
                starts.append(m.start())
                ends.append(m.end())
            at.append(len(found))
        places = [pa.array(np.frombuffer(x, np.int32)) for x in (starts, ends)]
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(at, np.int32)), pa.StructArray.from_arrays([pa.array(found, pa.string()), *places], ["token", "start", "end"]))

    return cut(text)


def space_tokens(text: Column) -> Column:
    """Tokens of a split at single blanks, empty ones kept, with their places."""
    parts = F.split(text, " ", -1)
    empty = F.array().cast("array<struct<token:string,start:int,end:int>>")

    def step(acc: Column, p: Column) -> Column:
        stop = acc["at"] + F.length(p)
        return F.struct((stop + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(p.alias("token"), acc["at"].alias("start"), stop.alias("end")))).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def encode(toks: Column, spans: Column) -> Column:
    """A token inside the first span that contains it takes its label; B- unless the token before has the same label."""
    labels = F.transform(toks, lambda t: F.coalesce(F.get(F.filter(spans, lambda s: (s["start"] <= t["start"]) & (t["end"] <= s["end"])), F.lit(0))["label"], F.lit("O")))

    def tagged(inside: Column) -> Column:
        last = lambda i: F.when(i > 0, F.get(inside, i - 1)).otherwise("O")
        return F.transform(inside, lambda lab, i: F.when(lab == "O", "O").when(lab == last(i), F.concat(F.lit("I-"), lab)).otherwise(F.concat(F.lit("B-"), lab)))

    return let(labels, tagged)


def encode_spaced(toks: Column, spans: Column) -> Column:
    """B- only where token and span start together; the last span that contains the token decides."""

    def tag(t: Column) -> Column:
        found = F.filter(spans, lambda s: (s["start"] <= t["start"]) & (t["end"] <= s["end"]))
        last = F.get(found, F.size(found) - 1)
        return F.when(F.size(found) == 0, "O").when(last["start"] == t["start"], F.concat(F.lit("B-"), last["label"])).otherwise(F.concat(F.lit("I-"), last["label"]))

    return F.transform(toks, tag)


def span_errors(spans: Column, size: Column) -> Column:
    """Whether a span leaves the text, is empty or overlaps another."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    outside = F.exists(ordered, lambda s: (s["start"] < 0) | (s["end"] <= s["start"]) | (s["end"] > size))
    overlap = F.exists(F.transform(ordered, lambda s, i: F.coalesce((i > 0) & (F.get(ordered, F.greatest(i - 1, F.lit(0)))["end"] > s["start"]), F.lit(False))), lambda x: x)
    return outside | overlap


def decode(tags: Column) -> Column:
    """array<TAG_SPAN>: B opens, I of the same type extends; an I without its own span closes what is open and is dropped."""
    start = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("i"), F.lit("").alias("type"), F.array().cast(f"array<{TAG_SPAN}>").alias("out"))

    def closed(acc: Column) -> Column:
        one = F.struct(acc["start"].alias("start"), acc["i"].alias("end"), acc["type"].alias("type"))
        return F.when(acc["start"] >= 0, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])

    def step(acc: Column, tag: Column) -> Column:
        kind, name = F.substring(tag, F.lit(1), F.lit(2)), F.substring(tag, F.lit(3), F.length(tag))
        extends = (kind == "I-") & (acc["start"] >= 0) & (name == acc["type"])
        opens = kind == "B-"
        return F.struct(
            F.when(extends, acc["start"]).when(opens, acc["i"]).otherwise(-1).alias("start"), (acc["i"] + 1).alias("i"),
            F.when(extends, acc["type"]).when(opens, name).otherwise("").alias("type"), F.when(extends, acc["out"]).otherwise(closed(acc)).alias("out"),
        )

    return F.aggregate(tags, start, step, closed)


def record_errors(toks: Column, tags: Column) -> Column:
    """Names of what is wrong with a record: empty, length, label, transition."""
    known = F.forall(tags, lambda t: t.isin(*LABELS))
    follows = F.forall(F.transform(tags, lambda t, i: ~t.startswith("I-") | F.coalesce((i > 0) & F.substring(F.get(tags, F.greatest(i - 1, F.lit(0))), 3, 99).eqNullSafe(F.substring(t, 3, 99)), F.lit(False))), lambda ok: ok)
    found = F.array(F.when(F.size(toks) <= 0, "empty"), F.when(F.size(toks) != F.size(tags), "length"), F.when(~known, "label"), F.when(~follows, "transition"))
    return F.filter(found, lambda e: e.isNotNull())


def softmax(row: Column) -> Column:
    top = F.array_max(row)
    raised = F.transform(row, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def decode_logits(logits: Column, offsets: Column, threshold: float = 0.75) -> Column:
    """array<struct<category, start, length, confidence>> from token logits and (start, length) offsets.

    The first largest score is a token's label. O and B close what is open, I of another type closes it and opens its own,
    an I with nothing open opens. An entity's confidence is the mean over its tokens.
    """
    picked = F.transform(
        F.arrays_zip(F.transform(logits, softmax).alias("p"), offsets.alias("o")),
        lambda x: F.struct(F.array_max(x["p"]).alias("p"), F.element_at(F.array(*map(F.lit, LABELS)), F.array_position(x["p"], F.array_max(x["p"])).cast("int")).alias("tag"), x["o"]["start"].alias("start"), x["o"]["length"].alias("length")),
    )
    done = F.array().cast("array<struct<type:string,start:int,end:int,p:double,n:int>>")
    first = F.struct(F.lit("").alias("type"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("p"), F.lit(0).alias("n"), done.alias("out"))

    def closed(acc: Column) -> Column:
        one = F.struct(*(acc[c].alias(c) for c in ("type", "start", "end", "p", "n")))
        return F.when(acc["n"] > 0, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])

    def step(acc: Column, t: Column) -> Column:
        name = F.substring(t["tag"], F.lit(3), F.length(t["tag"]))
        extends, opens = t["tag"].startswith("I-") & (acc["n"] > 0) & (acc["type"] == name), t["tag"] != "O"
        stop = t["start"] + t["length"]
        pick = lambda a, b, c: F.when(extends, a).when(opens, b).otherwise(c)
        return F.struct(
            pick(acc["type"], name, F.lit("")).alias("type"), pick(acc["start"], t["start"], F.lit(0)).alias("start"), pick(stop, stop, F.lit(0)).alias("end"),
            pick(acc["p"] + t["p"], t["p"], F.lit(0.0)).alias("p"), pick(acc["n"] + 1, F.lit(1), F.lit(0)).alias("n"), F.when(extends, acc["out"]).otherwise(closed(acc)).alias("out"),
        )

    category = F.create_map(*(F.lit(x) for kv in CATEGORY.items() for x in kv))
    kept = F.filter(F.aggregate(picked, first, step, closed), lambda e: e["p"] / e["n"] >= threshold)
    return F.transform(kept, lambda e: F.struct(F.coalesce(category[e["type"]], F.lit("SecretLike")).alias("category"), e["start"].alias("start"), (e["end"] - e["start"]).alias("length"), (e["p"] / e["n"]).alias("confidence")))


# Fixed value: the markup of labelled text.
TAGGED = r"(?s)<(SECRET|PII|HOSTINFO|NETWORK)>(.*?)</\1>"


def parse_tagged(text: Column) -> Column:
    """struct<text, spans> of ``<LABEL>value</LABEL>`` markup: the text without marks and array<SPAN> of the values."""
    found = find_matches(text, TAGGED)

    def places(m: Column) -> Column:
        labels = F.transform(m, lambda x: F.regexp_extract(x["m"], TAGGED, 1))
        marks = F.transform(labels, lambda lab: 2 * F.length(lab) + 5)
        before = running_sums(marks)
        return F.transform(
            F.arrays_zip(m.alias("m"), labels.alias("label"), before.alias("before")),
            lambda x: F.struct((x["m"]["start"] - x["before"]).alias("start"), (x["m"]["start"] - x["before"] + F.length(x["m"]["m"]) - 2 * F.length(x["label"]) - 5).alias("end"), x["label"].alias("label")),
        )

    return F.struct(F.regexp_replace(text, TAGGED, "$2").alias("text"), let(found, places).alias("spans"))


def encode_overlap(toks: Column, spans: Column) -> Column:
    """Tags of tokens that overlap a span, even in part: B- where both start together, else I-."""

    def tag(t: Column) -> Column:
        first = F.get(F.filter(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])), F.lit(0))
        return F.when(first.isNull(), "O").when(first["start"] == t["start"], F.concat(F.lit("B-"), first["label"])).otherwise(F.concat(F.lit("I-"), first["label"]))

    return F.transform(toks, tag)


def keeps_spans(spans: Column, tags: Column) -> Column:
    """Whether tags open as many entities as there are spans; adjacent spans of one label fuse and fail this."""
    return F.size(spans) == F.size(F.filter(tags, lambda t: t.startswith("B-")))


def align_subwords(tags: Column, words: Column) -> Column:
    """Label ids for sub-words (``words``: index of each one's word, null for special tokens): -100 for specials, a word's first
    sub-word keeps its label, B- becomes I- on the others."""
    number = lambda t: F.array_position(F.array(*map(F.lit, LABELS)), t).cast("int") - 1

    def one(w: Column, i: Column) -> Column:
        again = (i > 0) & F.get(words, F.greatest(i - 1, F.lit(0))).eqNullSafe(w)
        tag = F.get(tags, w)
        return F.when(w.isNull(), -100).when(again & tag.startswith("B-"), number(F.concat(F.lit("I-"), F.substring(tag, F.lit(3), F.length(tag))))).otherwise(number(tag))

    return F.transform(words, one)


def word_labels(labels: Column, words: Column) -> Column:
    """One label for each word: that of its first sub-word."""
    firsts = F.filter(F.transform(labels, lambda lab, i: F.struct(i.alias("i"), lab.alias("lab"))), lambda x: F.get(words, x["i"]).isNotNull() & ((x["i"] == 0) | ~F.get(words, F.greatest(x["i"] - 1, F.lit(0))).eqNullSafe(F.get(words, x["i"]))))
    return F.transform(firsts, lambda x: x["lab"])
