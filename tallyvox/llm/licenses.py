"""Licence scanning by a positional index of rare tokens.

The index holds, for each template, the offsets of its anchors: its words of the highest inverse
document frequency (over all documents), so many that at every start where the share LEAST can
be reached two of them at least stand in their place. In a file, each template whose mandatory
words all occur is tried: every place of its anchors votes for the start that it implies. Starts on which at least two different words agree (one, for a template
of one word) are verified: the mandatory phrases must stand there word by word, in reach of
the template, and the share of the template's words that stand in their place must reach LEAST.

Besides, the base phrases are found at every place where their words stand consecutively;
their labels always count.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.
A null text counts as empty and has no words: counts 0, places null, labels empty, score 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.shipping import Sent

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
LEAST, REACH = 0.6, 3

#: Base phrases and their labels (fixed values of the contract).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    required: tuple[str, ...]


#: Sentences of licence notices and texts (fixed values: wording of the published licences), with the phrases that must stand word by word.
TEMPLATES = (
    Template("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("unless required by applicable law or agreed to in writing",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", "are permitted")),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain",)),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", ("redistributions in binary form must reproduce",)),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("commons attribution 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial 4 0",)),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    Template("cc-by-nc-sa-4.0", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ("attribution noncommercial sharealike 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike 4 0",)),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("cc0-1.0", "waived all copyright and related or neighboring rights to this work", ("related or neighboring rights",)),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "either version 2 of the license")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "either version 3 of the license")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    Template("lgpl", "this work is licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge", "any person obtaining a copy")),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("copies or substantial portions of the software",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", ("authors be held liable for any damages",)),
)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(UPPER)) if text else []


class Index:
    """Each template's anchors with their offsets, by the inverse document frequency of its words."""

    def __init__(self, templates, base: dict[str, str], frequency: dict[str, int], documents: int):
        self.templates = [(t.label, t.text.split(), [p.split() for p in t.required]) for t in templates]
        self.base = [(p.split(), label) for p, label in base.items()]
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) for _, words, _ in self.templates for w in words}
        self.anchors: list[dict[str, list[int]]] = []
        for _, words, _ in self.templates:
            # a misplaced word is one anchor less at most
            misplaced = max((m for m in range(len(words)) if (len(words) - m) / len(words) >= LEAST), default=0)
            rarest = sorted(set(words), key=lambda w: (-self.idf[w], w))[: misplaced + 2]
            self.anchors.append({w: [i for i, x in enumerate(words) if x == w] for w in rarest})
        self.mandatory = [{w for p in required for w in p} for _, _, required in self.templates]
        self.wanted = {w for m in self.mandatory for w in m} | {w for p, _ in self.base for w in p}

    def scan(self, words: list[str]) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """Base places (count, first, last), base labels, the templates' labels, the best share."""
        there = self.wanted.intersection(words)
        phrases = [k for k, (phrase, _) in enumerate(self.base) if there.issuperset(phrase)]
        tried = [t for t, words_ in enumerate(self.mandatory) if words_ <= there]
        if not phrases and not tried:
            return 0, None, None, set(), set(), 0.0
        needed = {w for k in phrases for w in self.base[k][0]} | {w for t in tried for w in self.anchors[t]}
        at = defaultdict(list)
        for i, w in enumerate(words):
            if w in needed:
                at[w].append(i)
        starts: set[tuple[int, int]] = set()
        for k in phrases:
            phrase = self.base[k][0]
            rarest = min(range(len(phrase)), key=lambda i: len(at.get(phrase[i], ())))
            starts |= {(p - rarest, k) for p in at.get(phrase[rarest], ()) if p >= rarest and words[p - rarest : p - rarest + len(phrase)] == phrase}
        votes: Counter = Counter()
        for t in tried:
            for w, offsets in self.anchors[t].items():
                votes.update({(t, p - offset) for offset in offsets for p in at.get(w, ())})  # one vote a word
        labels, best = set(), 0.0
        for (t, start), n in votes.items():
            label, template, required = self.templates[t]
            if n < min(2, len(template)):
                continue
            share = sum(w == words[start + i] for i, w in enumerate(template) if 0 <= start + i < len(words)) / len(template)
            if share >= LEAST:
                near = words[max(0, start - REACH) : start + len(template) + REACH]
                if all(any(near[i : i + len(p)] == p for i in range(len(near) - len(p) + 1)) for p in required):
                    labels.add(label)
                    best = max(best, share)
        first = min((s for s, _ in starts), default=None)
        last = max((s for s, _ in starts), default=None)
        return len(starts), first, last, {self.base[k][1] for _, k in starts}, labels, best


def frequencies(docs: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """How many documents each word of the vocabulary stands in, and the number of documents; over all of them."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[""] += 1
                seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in sums.collect()}  # a row for each word of the vocabulary at most
    return found, found.pop("", 0)


def scanned(docs: DataFrame, templates=TEMPLATES, base: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row of docs."""
    base = BASE if base is None else base
    index = Sent(docs.sparkSession, Index(templates, base, *frequencies(docs, {w for t in templates for w in t.text.split()})))
    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                n, first, last, own, more, score = index.value.scan(words)
                rows.append((len(words), n, first, last, ",".join(sorted(own)), ",".join(sorted(own | more)), score))
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)
