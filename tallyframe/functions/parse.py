"""Typed labels from free-form or JSON answers.

A column of raw answers becomes a struct of ``pred`` (field to value) and ``parse_error``. Values are text: 0 or 1, a
declared label, or a number. An answer that decodes to a JSON object is judged by that object alone; any other one
by its decoded value and then by its text. JSON counts only from the start of the answer or of its fenced block.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that stand for a binary label or for no answer, and the marks that are cut off.
YES, NO = {"1", "true", "yes"}, {"0", "false", "no"}
VOID = {"na", "n/a", "not applicable", "none", "null", ""}
MARKS = " \"'.,!"
RESULT = "struct<pred: map<string, string>, parse_error: string>"
ITEM_RESULTS = "array<struct<pos: int, pred: map<string, string>, parse_error: string>>"


@dataclass(frozen=True)
class AnswerSpec:
    """What a task accepts: its kind, its fields, the labels of a categorical one, the range of a score."""

    kind: str
    fields: tuple[str, ...]
    labels: tuple[str, ...] = ()
    low: float = 0.0
    high: float = 100.0


class Unusable(Exception):
    """Why an answer has no label."""


def unfenced(text: str) -> str:
    """The inside of a json block if there is one, else of any block, else the text."""
    for opening in (r"```json\s*", r"```[a-z]*\s*"):
        if m := re.search(opening + r"(.*?)(?:```|\Z)", text, re.S | re.I):
            return m[1].strip()
    return text.strip()


def bare(text: str) -> str:
    return text.strip().strip(MARKS)


def binary(value: object) -> str:
    """0 or 1 as a boolean, a number or a word; arrays and objects are none."""
    if isinstance(value, str):
        word = bare(value).lower()
        if word in YES | NO:
            return "1" if word in YES else "0"
    elif isinstance(value, (bool, int, float)) and value in (0, 1):
        return str(int(value))
    raise Unusable(f"no binary label: {str(value)[:40]}")


def label(value: object, labels: Sequence[str]) -> str:
    """The declared label that a text is, whatever its case."""
    found = [x for x in labels if isinstance(value, str) and bare(value).upper() == x.upper()]
    if not found:
        raise Unusable(f"unknown label: {str(value)[:40]}")
    return found[0]


def label_in_text(text: str, labels: Sequence[str]) -> str:
    """The text itself, or the only label that stands in it as a whole word.

    A label that is part of another one that was found doesn't count, wherever it stands.
    """
    exact = [x for x in labels if x.upper() in (text.strip().upper(), bare(text).upper())]
    if exact:
        return exact[0]
    hits = [x for x in labels if re.search(rf"(?<![A-Za-z0-9]){re.escape(x.upper())}(?![A-Za-z0-9])", text.upper())]
    free = [x for x in hits if not any(x != y and x.upper() in y.upper() for y in hits)]
    if len(free) != 1:
        raise Unusable("no label" if not free else "several labels")
    return free[0]


def score(value: object, low: float, high: float) -> str:
    """A number in the range; null and the words for no answer, an empty text too, are ``not_applicable``."""
    if value is None or (isinstance(value, str) and bare(value).lower() in VOID):
        raise Unusable("not_applicable")
    try:
        number = None if isinstance(value, bool) else float(bare(value) if isinstance(value, str) else value)
    except (TypeError, ValueError):
        number = None
    if number is None or not low <= number <= high:
        raise Unusable(f"no number in range: {str(value)[:40]}")
    return repr(int(number)) if number == int(number) else repr(number)


def coerced(value: object, spec: AnswerSpec) -> str:
    if spec.kind == "score":
        return score(value, spec.low, spec.high)
    return label(value, spec.labels) if spec.kind == "categorical" else binary(value)


def from_value(value: object, spec: AnswerSpec) -> dict[str, str]:
    """Labels from a decoded answer: an object, alone or in an array, or the value of the only field."""
    if isinstance(value, list) and len(value) == 1 and isinstance(value[0], dict):
        value = value[0]
    if isinstance(value, dict):
        known = {str(k).strip().lower(): v for k, v in value.items()} | value
        got = {f: known.get(f, known.get(f.lower(), Unusable)) for f in spec.fields}
        missing = [f for f, v in got.items() if v is Unusable]
        if missing:
            raise Unusable(f"missing key: {missing[0]}")
        return {f: coerced(v, spec) for f, v in got.items()}
    if len(spec.fields) > 1:
        raise Unusable("no object")
    return {spec.fields[0]: coerced(value, spec)}


def parse_answer(text: str | None, spec: AnswerSpec) -> tuple[dict[str, str] | None, str | None]:
    """The labels of one answer, or why there are none."""
    inner, decoded = unfenced(text or ""), True
    try:
        value = json.JSONDecoder().raw_decode(inner)[0]
    except ValueError:
        value, decoded = None, False
    whole = isinstance(value, dict) or (isinstance(value, list) and len(value) == 1 and isinstance(value[0], dict))
    try:
        if whole or len(spec.fields) > 1:
            return from_value(value, spec), None
        if decoded and value is not None and spec.kind != "categorical":
            try:
                return from_value(value, spec), None
            except Unusable as e:
                if str(e) == "not_applicable":
                    raise
        found = label_in_text(inner, spec.labels) if spec.kind == "categorical" else coerced(inner, spec)
        return {spec.fields[0]: found}, None
    except Unusable as e:
        return None, str(e)


def several_values(text: str) -> list[object]:
    """The answers of a batch: an array, an object that holds one array, or values one after another."""
    inner, out, at = unfenced(text), [], 0
    decode = json.JSONDecoder().raw_decode
    while at < len(inner):
        if inner[at] in " \t\r\n,":
            at += 1
            continue
        value, at = decode(inner, at)
        out.append(value)
    if len(out) == 1 and isinstance(out[0], dict):
        arrays = [v for v in out[0].values() if isinstance(v, list)]
        return arrays[0] if len(arrays) == 1 else out
    return out[0] if len(out) == 1 and isinstance(out[0], list) else out


def parse_batch(text: str | None, n: int, spec: AnswerSpec) -> list[tuple[int, dict[str, str] | None, str | None]]:
    """A result for each of n items; another number of answers voids the whole batch."""
    try:
        values = several_values(text or "")
    except ValueError:
        values = []
    if len(values) != n:
        return [(i, None, f"{len(values)} answers for {n} items") for i in range(n)]
    out = []
    for i, value in enumerate(values):
        try:
            out.append((i, from_value(value, spec), None))
        except Unusable as e:
            out.append((i, None, str(e)))
    return out


def parsed(raw: Column, spec: AnswerSpec) -> Column:
    """``pred`` and ``parse_error`` of each answer."""

    @F.pandas_udf(RESULT)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([parse_answer(x, spec) for x in part], columns=["pred", "parse_error"])

    return run(raw)


def parsed_batch(raw: Column, n: Column, spec: AnswerSpec) -> Column:
    """An array with ``pos``, ``pred`` and ``parse_error`` of each item of a batch."""

    @F.pandas_udf(ITEM_RESULTS)
    def run(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([[{"pos": i, "pred": p, "parse_error": e} for i, p, e in parse_batch(t, int(k), spec)] for t, k in zip(texts, sizes, strict=True)])

    return run(raw, n)


def strict_object(raw: Column, fields: Sequence[str], kind: str = "binary", labels: Sequence[str] = (), low: float = 0, high: float = 100) -> Column:
    """Whether an answer is exactly an object with these keys and values of the right JSON type, natively.

    Keys are those of the object itself, not of objects inside it.
    """
    parsed_value = F.try_parse_json(raw)
    ok = F.coalesce(F.array_sort(F.json_object_keys(raw)) == F.array(*map(F.lit, sorted(fields))), F.lit(False))
    for f in fields:
        path = f"$['{f}']"
        typed = F.schema_of_variant(F.try_variant_get(parsed_value, path, "variant"))
        if kind == "binary":
            fits = (typed == "BIGINT") & F.try_variant_get(parsed_value, path, "long").isin(0, 1)
        elif kind == "score":
            number = F.try_variant_get(parsed_value, path, "double")
            fits = (typed.isin("BIGINT", "DOUBLE") | F.startswith(typed, F.lit("DECIMAL"))) & (number >= low) & (number <= high)
        else:
            fits = (typed == "STRING") & F.try_variant_get(parsed_value, path, "string").isin(*labels)
        ok = ok & F.coalesce(fits, F.lit(False))
    return ok
