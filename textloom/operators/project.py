"""Settings of a project, its lock, approval of induced terms, and ordered rewriting rules."""

from __future__ import annotations

import json
import os
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.runs import LANGUAGES
from textloom.operators.store import config_hash
from textloom.operators.terms import merge_glossary


@dataclass(frozen=True)
class Project:
    """Scalars that travel as literals; unknown fields of a stored project are ignored."""

    name: str
    src_lang: str
    tgt_lang: str
    style_preset: str = "formal"
    custom_style_prompt: str = ""
    provider_id: str = ""
    model: str = ""
    ruby_policy: str = "keep"
    ruby_loose: bool = False
    created_at: str = ""
    context_slide: int | None = None

    @classmethod
    def load(cls, path: str) -> Project:
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        return cls(**{k: v for k, v in stored.items() if k in cls.__dataclass_fields__})

    def save(self, path: str) -> None:
        write_json(path, asdict(self))

    def change(self, **fields) -> Project:
        return replace(self, **fields)

    def slide(self, default: int = 2) -> int:
        """Context segments, 0 to 5."""
        return max(0, min(5, default if self.context_slide is None else self.context_slide))

    def hash(self, terms_hash: str) -> str:
        """Neither the source language nor the model nor the context makes translations stale; default reading settings don't either."""
        ruby = None if (self.ruby_policy, self.ruby_loose) == ("keep", False) else f"{self.ruby_policy}:{int(self.ruby_loose)}"
        return config_hash(self.style_preset, self.custom_style_prompt, self.tgt_lang, terms_hash, ruby)


@dataclass
class Settings:
    """Settings of all projects; a stored file overrides the defaults key by key."""

    concurrency: int = 4
    context_segments: int = 2
    ui_language: str = "zh"
    providers: list[dict] = field(default_factory=list)
    recent_projects: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Settings:
        try:
            with open(path, encoding="utf-8") as f:
                stored = json.load(f)
        except (OSError, ValueError):
            stored = {}
        return cls(**{k: v for k, v in stored.items() if k in cls.__dataclass_fields__})

    def save(self, path: str) -> None:
        write_json(path, asdict(self))

    def add_recent(self, path: str, keep: int = 10) -> None:
        self.recent_projects = [path, *(p for p in self.recent_projects if p != path)][:keep]

    def provider(self, provider_id: str) -> dict:
        found = next((p for p in self.providers if p.get("id") == provider_id), None)
        if found is None:
            raise KeyError(provider_id)
        return found


def write_json(path: str, value) -> None:
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1)
    os.replace(path + ".tmp", path)


class LockedError(RuntimeError):
    """Another process has the project open."""


@contextmanager
def lock(folder: str):
    """One process per project folder, by an operating-system lock that ends with the process."""
    import fcntl

    with open(os.path.join(folder, ".lock"), "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise LockedError(folder) from e
        yield


def normalize_language(code: Column) -> Column:
    """The known code for any case or separator, else for its first part, else the code itself."""
    exact = F.create_map(*[F.lit(x) for c in LANGUAGES for x in (c.lower(), c)])
    firsts = {c.lower().partition("-")[0]: c for c in reversed(LANGUAGES)}
    by_first = F.create_map(*[F.lit(x) for kv in firsts.items() for x in kv])
    low = F.replace(F.lower(F.trim(code)), F.lit("_"), F.lit("-"))
    return F.coalesce(F.try_element_at(exact, low), F.try_element_at(by_first, F.substring_index(low, "-", 1)), code)


def rewrite(text: Column, exact: dict[str, str], rules: list[tuple[str, str]], passes: int = 4) -> Column:
    """An exact replacement if there is one; else the first rule (pattern, Java replacement) that changes the text, up to ``passes`` times."""
    out = text
    for _ in range(passes if rules else 0):
        step = out
        for pattern, new in reversed(rules):
            changed = F.regexp_replace(out, "(?m)" + pattern, new)
            step = F.when(changed != out, changed).otherwise(step)
        out = step
    if not exact:
        return out
    table = F.create_map(*[F.lit(x) for kv in exact.items() for x in kv])
    return F.coalesce(F.try_element_at(table, text), out)


def approve(cache: DataFrame, terms: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cache, glossary): the chosen candidates (src) become approved and enter the glossary where it doesn't know them."""
    mark = chosen.select(F.col("src").alias("__src")).distinct()
    joined = cache.join(mark, F.col("src") == F.col("__src"), "left")
    new = joined.withColumn("status", F.when(F.col("__src").isNotNull(), "approved").otherwise(F.col("status"))).select(*cache.columns)
    picked = joined.filter("__src is not null").select("ord", "src", "cands", "note")
    return new, merge_glossary(terms.select("ord", "src", "cands", "note"), picked)


def reject(cache: DataFrame, chosen: DataFrame) -> DataFrame:
    mark = chosen.select(F.col("src").alias("__src")).distinct()
    out = cache.join(mark, F.col("src") == F.col("__src"), "left")
    return out.withColumn("status", F.when(F.col("__src").isNotNull(), "rejected").otherwise(F.col("status"))).select(*cache.columns)
