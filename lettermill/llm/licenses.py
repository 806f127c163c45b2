"""License scans: winnowed template fingerprints pick candidates, banded alignment confirms them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.align import local_align
from lettermill.llm.common import whole_text
from lettermill.llm.decontaminate import _WORD, Items

GRAM = 3
WINDOW = 2
COVERAGE = 0.75
_NEVER = np.uint64(2**64 - 1)
_SPANS = (
    "array<struct<template:string,coverage:double,matched:int,template_words:int,"
    "first_word:int,end_word:int,start:int,end:int,passage:string>>"
)

# Short notices as they stand in files. A longer list is a parameter.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at"
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met:"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation"
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
}


def winnow(keys: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the fingerprints: the least key of every ``window`` keys in a row, ties all.

    A run of ``window`` keys that two texts share has a fingerprint in both.
    """
    if not len(keys):
        return np.zeros(0, np.int64)
    window = min(window, len(keys))
    runs = np.lib.stride_tricks.sliding_window_view(keys, window)
    least = np.concatenate([np.full(window - 1, _NEVER), runs.min(1), np.full(window - 1, _NEVER)])
    # Chosen if it equals the least key of one of the windows it lies in.
    chosen = np.zeros(len(keys), bool)
    for k in range(window):
        chosen |= keys == least[k : k + len(keys)]
    return np.flatnonzero(chosen & (keys != _NEVER))


class TemplateIndex:
    """Templates, and an inverted index from winnowed fingerprint to (template, place)."""

    def __init__(self, templates: Mapping[str, str], gram: int = GRAM, window: int = WINDOW):
        self.names = list(templates)
        self.items = Items.of([(k, text) for k, text in enumerate(templates.values())], gram)
        self.window = window
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.items.words):
            keys = self.items.keys(np.array(words, np.int64))
            for at in winnow(keys, window).tolist():
                self.places[int(keys[at])].append((k, at))
        self.fingerprints = np.array(sorted(self.places), np.uint64)

    def hits(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """(place in the text, fingerprint) of the text's winnowed fingerprints in the index.

        Only n-grams of template words have a key; others never are the least.
        """
        n = len(numbers) - self.items.size + 1
        if n <= 0:
            return []
        keys = np.full(n, _NEVER)
        at, gram = self.items.hits(numbers, self.items.grams)
        keys[at] = self.items.grams[gram]
        chosen = winnow(keys, self.window)
        chosen = chosen[np.isin(keys[chosen], self.fingerprints)]
        return [(int(p), int(keys[p])) for p in chosen]


def scan_text(text: str, index: TemplateIndex, least: float = COVERAGE) -> list[dict]:
    """Templates found in a whole text, each place with its matched coverage and spans."""
    numbers = index.items.numbers(text)
    starts: dict[int, set[int]] = defaultdict(set)
    for place, key in index.hits(numbers):
        for template, at in index.places[key]:
            starts[template].add(place - at)
    out, spans = [], None
    for template, diagonals in sorted(starts.items()):
        words = index.items.words[template]
        band, taken = max(3, len(words) // 8), -1
        for start in sorted(diagonals):
            low = max(0, start - band, taken)
            window = numbers[low : start + len(words) + band].tolist()
            score, matched, first, end = local_align(words, window, start - low, band)
            if matched < least * len(words):
                continue
            first, end = low + first, low + end
            taken = end
            spans = spans or [(m.start(), m.end()) for m in _WORD.finditer(text.lower())]
            begin, stop = spans[first][0], spans[end - 1][1]
            out.append(
                {
                    "template": index.names[template], "coverage": round(matched / len(words), 6),
                    "matched": matched, "template_words": len(words), "first_word": first, "end_word": end,
                    "start": begin, "end": stop, "passage": text[begin:stop],
                }
            )
    return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = COVERAGE) -> DataFrame:
    """License templates in documents: ``doc_id``, ``template``, ``coverage``, ``matched``,
    ``template_words``, word span ``first_word`` to ``end_word``, character span
    ``start`` to ``end`` and the ``passage`` itself.

    ``coverage`` is the share of the template's words matched in order; rows
    reach ``least``. One row per document row, template and place; places of
    one template do not overlap. Templates of fewer words than an n-gram match
    nothing, as do null and empty texts; repeated rows give their rows each;
    other columns are ignored. (Where lower-casing changes a text's length the
    character span is that of the lower-cased text.) The index is as large as
    the templates, which the caller holds, and is sent to every executor.
    """
    shared = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates))

    @F.pandas_udf(_SPANS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([scan_text(t, shared.value, least) for t in texts], dtype=object)

    rows = docs.select(docs["doc_id"].alias("doc_id"), F.explode(found(whole_text(docs))).alias("found"))
    return rows.select("doc_id", "found.*")
