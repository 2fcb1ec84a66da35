"""Licence scan by a positional index of rare words.

A template is a phrase or a passage of a licence.  Its rarest words over the corpus, those of the
highest inverse document frequency, are posted with their places.  A file's words are looked up
there; each hit says where the template would begin, and a beginning on which two rare words agree
(or the only one posted) is a candidate.  It is verified word by word, and its mandatory phrases
must stand there whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from colophon.llm.common import mapped, slices, table

#: rare words posted for each template
RARE = 3
BYTES_AT_ONCE = 8 << 20
#: bytes of words, A-Z in lower case; all others become spaces
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Template:
    """``share`` of the words must stand in their places, and every phrase of ``keys`` whole."""

    label: str
    words: str
    keys: tuple[str, ...] = ()
    share: float = 1.0
    base: bool = False


# The phrases asked for, then passages of public licences.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",), 0.8),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",), 0.8),
    Template("gpl", "gnu general public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl", "subject to the terms of the mozilla public license", ("mozilla public license",), 0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",), 0.8),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",), 0.8),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",), 0.8),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "cc0 1 0 universal"),
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def _found(words: list[bytes], phrase: list[bytes], low: int, high: int) -> bool:
    """Whether the phrase stands whole in ``words[low:high]``."""
    n = len(phrase)
    return any(words[i : i + n] == phrase for i in range(max(low, 0), min(high, len(words)) - n + 1))


class Index:
    """Postings of the rare words of templates; ``frequency`` is the number of documents with each word."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[bytes, int]):
        self.templates = templates
        self.words = [t.words.encode().split() for t in templates]
        self.keys = [[k.encode().split() for k in t.keys] for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.votes = []
        for k, words in enumerate(self.words):
            rare = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))[:RARE]
            for place, word in enumerate(words):
                if word in rare:
                    self.postings[word].append((k, place))
            self.votes.append(min(2, sum(w in rare for w in words)))

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Template, beginning and share of matching words of all verified places."""
        posted = self.postings
        seen: Counter = Counter()
        for i in [i for i, w in enumerate(words) if w in posted]:
            for k, place in posted[words[i]]:
                seen[k, i - place] += 1
        out = []
        for (k, begin), votes in seen.items():
            own = self.words[k]
            if votes < self.votes[k]:
                continue
            here = words[max(begin, 0) : begin + len(own)]
            share = sum(a == b for a, b in zip(here, own[max(-begin, 0) :])) / len(own)
            if share >= self.templates[k].share and all(_found(words, key, begin, begin + len(own)) for key in self.keys[k]):
                out.append((k, begin, share))
        return out


def word_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[bytes, int]:
    """In how many documents each word of the templates stands; a row a word of the templates reaches the driver."""
    vocabulary = frozenset(w for t in templates for w in t.words.encode().split())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, "text", BYTES_AT_ONCE):
            for text in batch.column("text").to_pylist():
                counts.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    found = mapped(docs.select("text"), work, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in found.collect()}


PLACES = "array<struct<label:string,begin:bigint,share:double,base:boolean>>"


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id``, ``n_words`` and all verified ``places`` of each row; null texts count as empty, every row stays."""
    rows = docs.select("doc_id", "text")
    frequency = word_frequencies(rows, templates)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("places", T._parse_datatype_string(PLACES))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, frequency)
        kind = pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("share", pa.float64()), ("base", pa.bool_())]))
        for batch in slices(batches, "text", BYTES_AT_ONCE):
            sizes, places = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                places.append([{"label": templates[k].label, "begin": at, "share": share, "base": templates[k].base} for k, at, share in sorted(index.scan(words), key=lambda x: (x[1], x[0]))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(places, kind)], ["doc_id", "n_words", "places"])

    return mapped(rows, work, schema)


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """Contract: places and labels of licence phrases in every document."""
    found = scanned(table(spark, sf_dir, "documents")).withColumn("base", F.filter("places", lambda p: p["base"]))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    begins = F.transform("base", lambda p: p["begin"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(begins).alias("first_word"), F.array_max(begins).alias("last_word"),
        labels("base").alias("base_labels"), labels("places").alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
