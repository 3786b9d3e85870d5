"""Variants of items: consistent renaming."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import count
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

#: What is renamed: file stems, whole numbers, ids, and personal names that stand by themselves; letters of Chinese names.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗高郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦方白邹孟熊秦邱江尹薛段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔汤"
GIVEN = "芳洋伟敏静磊婷强军杰娜涛明超秀兰霞平刚桂英华玲丽勇艳斌博宇琳浩然欣怡子轩思远雨萱晨阳"
STEM = re.compile(r"(?<![\w.-])([A-Za-z0-9_\-一-鿿]{2,40})\.(?:txt|log|csv|md|json|tsv)\b")
NUMBER = re.compile(r"(?<![\d.])\d{3,9}(?![\d.])")
IDENTIFIER = re.compile(r"\b[A-Z]{1,4}-\d{2,6}\b")
PERSON = re.compile(rf"(?:(?<=[→:：、，,\s>|])|^)([{SURNAMES}][一-鿿]{{1,2}})(?=[\s，,。、；;|)）]|$)", re.M)


TRIES = 20  # of a length, before a new name gets one letter more


def strings(value: Any) -> list[str]:
    """All string leaves of a JSON value, in order."""
    if isinstance(value, str):
        return [value]
    children = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [s for v in children for s in strings(v)]


def flat_text(value: Any) -> str:
    """All leaves of a JSON value as one text; nothing for null."""
    if isinstance(value, dict | list):
        return " ".join(map(flat_text, value.values() if isinstance(value, dict) else value))
    return "" if value is None else str(value)


def _drawn(pool: str, *seed: Any) -> str:
    return pool[int(hashlib.sha256("\x1f".join(map(str, seed)).encode()).hexdigest()[:12], 16) % len(pool)]


def _fresh(word: str, *seed: Any) -> str:
    """Another word of the same shape: digits stay digits, letters letters of the same case, Chinese letters Chinese letters. No number begins with 0."""
    kinds = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    out = []
    for i, c in enumerate(word):
        pool = next((k for k in kinds if c in k), GIVEN if "一" <= c <= "鿿" else c)
        out.append(_drawn(pool[1:] if pool[0] == "0" and i == 0 and len(word) > 1 else pool, word, i, *seed))
    return "".join(out)


def renaming(texts: list[str], seed: str) -> dict[str, str]:
    """old -> new for every name in the texts: no two new names are alike, and none stands in the texts already."""
    blob = "\n".join(texts)
    found = [(STEM, lambda m: m[1]), (IDENTIFIER, lambda m: m[0]), (NUMBER, lambda m: m[0]), (PERSON, lambda m: m[1])]
    names = {name(m): pattern for pattern, name in reversed(found) for m in pattern.finditer(blob)}
    out: dict[str, str] = {}
    for word in sorted(names, key=lambda w: (-len(w), w)):
        for attempt in count():  # as long as it takes: a number grows by a digit after every few tries
            new = _drawn(SURNAMES, word, seed, attempt) + _fresh(word[1:] + word[-1] * (attempt // TRIES), seed, attempt) if names[word] is PERSON else _fresh(word + word[-1] * (attempt // TRIES), seed, attempt)
            if new not in blob and new not in out.values():
                out[word] = new
                break
    return out


def rename(value: Any, seed: str) -> Any:
    """A JSON value with its names replaced alike everywhere but in keys."""
    names = renaming(strings(value), seed)
    if not names:
        return value
    pattern = re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True))))

    def replaced(part: Any) -> Any:
        if isinstance(part, str):
            return pattern.sub(lambda m: names[m[0]], part)
        if isinstance(part, dict):
            return {k: replaced(v) for k, v in part.items()}
        return [replaced(v) for v in part] if isinstance(part, list) else part

    return replaced(value)


def rename_variants(rows: DataFrame, key: str, json_col: str) -> DataFrame:
    """key, variant: each row's JSON renamed under its own seed; what isn't JSON is renamed as text."""

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch[json_col], strict=True):
                try:
                    value = json.dumps(rename(json.loads(text), str(k)), ensure_ascii=False)
                except (TypeError, ValueError):
                    value = rename(text, str(k)) if text else text
                out.append(value)
            yield pd.DataFrame({key: batch[key], "variant": out})

    return rows.select(key, json_col).mapInPandas(per_batch, f"{key} {dict(rows.dtypes)[key]}, variant string")
